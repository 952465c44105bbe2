"""All stages from transcripts and a repository to the report, over the command line."""

import json
import os
import subprocess

import pytest

from tracework.plans import documents, stages


def test_end_to_end(spark, tmp_path, capsys):
    repo, logs = tmp_path / "repo", tmp_path / "logs"
    repo.mkdir()
    logs.mkdir()

    def git(*args, when="2026-02-01T10:30:00+00:00"):
        env = {"GIT_AUTHOR_DATE": when, "GIT_COMMITTER_DATE": when, "GIT_AUTHOR_NAME": "A", "GIT_AUTHOR_EMAIL": "a@b.c", "GIT_COMMITTER_NAME": "A", "GIT_COMMITTER_EMAIL": "a@b.c", "PATH": "/usr/bin:/bin", "HOME": str(tmp_path)}
        return subprocess.run(["git", "-C", str(repo), *args], check=True, capture_output=True, env=env, text=True).stdout

    git("init", "-q")
    (repo / "a.py").write_text("x = 1\n" * 20)
    git("add", ".")
    git("commit", "-qm", "feat: add a")
    say = lambda kind, content, ts: {"type": kind, "timestamp": ts, "message": {"role": kind, "content": content}}
    entries = [
        say("user", "add a module please", "2026-02-01T10:00:00Z"), say("assistant", [{"type": "text", "text": "Would you like option A or option B?"}], "2026-02-01T10:01:00Z"),
        say("user", "let's go with the first one because it is simple", "2026-02-01T10:02:00Z"), say("assistant", [{"type": "tool_use", "name": "Write", "id": "w", "input": {"file_path": "a.py", "content": "x"}}], "2026-02-01T10:20:00Z"),
    ]
    (logs / "one.jsonl").write_text("\n".join([*map(json.dumps, entries), "", "{broken"]))
    (logs / "two.jsonl").write_text(json.dumps(say("user", "unrelated", "2026-03-01T10:00:00Z")))
    notes, catalog, answers, scores = tmp_path / "notes", tmp_path / "catalog.json", tmp_path / "answers.jsonl", tmp_path / "scores.jsonl"
    notes.mkdir()
    (notes / "one.md").write_text("It went well. <session_intent> Shipping </session_intent>")
    catalog.write_text(json.dumps([{"key": "k", "title": "T", "category": "c", "pattern": "p"}]))
    answers.write_text(json.dumps({"session_id": "zzz", "batch_id": 0, "pos": 0, "index": 0, "is_decision": False}))
    scores.write_text(json.dumps({"episode_id": 1, "title": "Adding", "confidence": 1.0, "scores": {"steering": 7.0}}))
    out = lambda name: str(tmp_path / name)
    run = lambda *args: stages.main(list(args))
    run("condense", str(logs), "--out", out("condensed"))
    run("events", str(logs), "--out", out("work"))
    run("gitdata", "--repo", str(repo), "--logs", out("work"), "--out", out("git"), "--since", "2026-01-01T00:00:00Z")
    run("extract", "--events", out("work/events"), "--out", out("cand"))
    run("finalize", "--events", out("work/events"), "--answers", str(answers), "--catalog", str(catalog), "--out", out("decisions"))
    run("episodes", "--logs", out("work"), "--gitdata", out("git"), "--narratives", str(notes), "--decisions", out("decisions"), "--out", out("docs"))
    run("analytics", "--repo", str(repo), "--logs", out("work"), "--gitdata", out("git"), "--out", out("analytics.md"), "--json", out("analytics.json"), "--author-email", "A@B.C")
    run("report", "--logs", out("work"), "--gitdata", out("git"), "--scores", str(scores), "--decisions", out("decisions"), "--out", out("report.md"))
    e = {r.episode_id: r for r in spark.read.parquet(out("git/episodes")).collect()}
    assert e[1].session_ids == ["one"] and e[1].links[0].link_type == "timestamp_overlap" and e[1].added_lines == 20 and e[2].episode_type == "session_only"
    d = spark.read.parquet(out("decisions")).collect()
    assert [(r.proposal_type, r.domain) for r in d] == [("options", "general")] or len(d) == 1
    text = "\n".join(r.value for r in spark.read.text(out("docs/documents")).where("episode_id = 1").collect())
    assert "Episode type: feature" in text and "It went well." in text
    assert "Overall 7.00 (STRONG)." in (tmp_path / "report.md").read_text()
    shown = (tmp_path / "analytics.md").read_text()
    assert "- Code: 1 source files, avg 20 / median 20 lines, 0 god objects (>500), max 20" in shown and "## Profile\n- Project framework: generic" in shown
    assert "- Commit discipline: 1 commits, conventional 100.0%, reverts 0.0%, atomic 100.0%, avg size 20 lines" in shown and "- Infrastructure: none" in shown
    assert "- LOC: +20 / -0 (net 20), 20 net LOC/day over 1 days" in shown and "- Peak day: 2026-02-01 (+20 / 1 commits)" in shown and "- Authors: 1, ship-to-revert ratio: 1.0" in shown
    assert "- Author-scoped: +20 / -0 over 1 commits (20 net LOC/day)" in shown and "steering actions across" in shown and "- Dispatches: 0, returns: 0" in shown
    assert json.loads((tmp_path / "analytics.json").read_text())["code_quality"]["status"] == "complete"
    assert any('  "episode_id" : 1' in r.value for r in spark.read.text(out("git/episodes.json")).collect())
    told = capsys.readouterr().err
    assert "[skip]" in told and "1 commits, 1 groups, 2 episodes" in told and "1 candidate(s), 1 batch(es) from 2 session(s)" in told and "1 decision(s) from 1 candidate(s)" in told
    (tmp_path / "agg.json").write_text(json.dumps({"episodes": [{"scores": {"steering": 9}, "confidence": 0.5}, {"scores": {"steering": 5}}]}))
    run("aggregate", "--scores", out("agg.json"))
    assert json.loads(capsys.readouterr().out)["axes"] == {"steering": 6.54}


def test_analytics_of_nothing_and_of_errors():
    """Sections say what is missing; dimensions that failed are named."""
    from tracework.plans import report

    none = report.render_analytics({"session_count": 0, "code_quality": {"status": "no_repo", "dimensions": {}}, "profile": {"status": "no_repo"}})
    assert "status: no_repo" in none and "- No git data (no commits found)" in none and "- 0 steering actions across 0/0 sessions" in none
    broken = report.render_analytics({"code_quality": {"status": "complete", "file_count": 2, "dimensions": {"security_signals": {"status": "error"}, "documentation": {"doc_count": 1, "has_readme": True}, "infrastructure": {"has_ci": True, "has_docker": False}}}})
    assert "- Dimensions errored: security_signals" in broken and "- Docs: 1 files, README: True, CHANGELOG: False" in broken and "- Infrastructure: has_ci" in broken and "Security:" not in broken
    assert report.render_analytics({"code_quality": {"status": "error", "error": "E: x"}}).count("- Error: E: x") == 1


def test_documents_come_back_by_their_manifest(spark, tmp_path):
    docs = lambda a, b: spark.range(a, b).selectExpr("id AS episode_id", "'feature' AS episode_type", "concat('é ', id, '\n\n## end') AS text")
    documents.write(docs(0, 600), str(tmp_path))
    documents.write(docs(500, 1000), f"file://{tmp_path}")
    assert len(os.listdir(tmp_path / "documents")) == 500
    read = documents.read(spark.read.schema("episode_id long, episode_type string").json(str(tmp_path / "manifest")), str(tmp_path))
    assert {(r.episode_id, r.text) for r in read.collect()} == {(i, f"é {i}\n\n## end\n") for i in range(500, 1000)}
    (tmp_path / "documents" / "episode_id=700" / "text.txt").unlink()
    with pytest.raises(Exception, match="episode_id=700"):
        read.collect()


def test_many_documents_share_folders(spark, tmp_path):
    made = spark.sparkContext.accumulator(0)
    counted = lambda rows: (made.add(1) or r for r in rows)
    ids = spark.createDataFrame(spark.range(0, 600).rdd.mapPartitions(counted), "id long")
    docs = ids.selectExpr("if(id = 7, null, id) AS episode_id", "'feature' AS episode_type", "concat('é ', id, '\n\n## end') AS text")
    documents.write(docs, f"file://{tmp_path}", folders=16)
    assert made.value == 600  # texts and manifest come of one pass
    assert sorted(os.listdir(tmp_path / "documents"), key=int) == [str(i) for i in range(16)]
    assert len(list((tmp_path / "documents").glob("*/*"))) == 600
    read = documents.read(spark.read.schema("episode_id long, episode_type string, input_path string").json(str(tmp_path / "manifest")), str(tmp_path))
    assert {(r.episode_id, r.text) for r in read.collect()} == {(None if i == 7 else i, f"é {i}\n\n## end\n") for i in range(600)}
    documents.write(docs.where("episode_id < 5"), str(tmp_path), folders=16)
    assert sorted(p.stem for p in (tmp_path / "documents").glob("*/*")) == list("01234")
