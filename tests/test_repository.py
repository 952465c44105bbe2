"""Logs, groups, links, metrics of repositories."""

import subprocess

import pytest
from pyspark.sql import functions as F

from tracework.operators import codequality, grouping, linking, velocity
from tracework.plans import stages
from tracework.sources import gitlog, linefiles, repofiles

DAY = "2026-01-0"


@pytest.fixture(scope="module")
def commits(spark):
    rows = [(1, 4, "s1", f"{DAY}1 10:00:00", "fix: one"), (1, 3, "s2", f"{DAY}1 12:00:00", "two"), (1, 2, "s3", f"{DAY}1 16:00:01", "add three"), (1, 1, "s4", f"{DAY}2 10:00:00", "merge #12"), (1, 0, "s5", None, "undated #123")]
    return spark.createDataFrame(rows, "repo_id int, log_pos long, sha string, t string, subject string").withColumn("ts", F.col("t").cast("timestamp")).drop("t")


@pytest.fixture(scope="module")
def sessions(spark):
    rows = [
        ("a", 1, 12, "topic", [], [], f"{DAY}5 10:00:00", f"{DAY}5 11:00:00"), ("b", 2, None, None, [], ["s1"], None, None), ("c", 3, None, "x", ["y", "topic"], [], None, None),
        ("d", 4, None, None, [], [], f"{DAY}1 17:00:01", f"{DAY}1 18:00:00"), ("e", 5, None, None, [], [], f"{DAY}8 10:00:00", f"{DAY}8 11:00:00"),
    ]
    df = spark.createDataFrame(rows, "session_id string, sess_pos long, pr_number long, git_branch string, branches array<string>, shas array<string>, s string, e string")
    return df.withColumns({"repo_id": F.lit(1), "start": F.col("s").cast("timestamp"), "end": F.col("e").cast("timestamp"), "is_root": F.lit(True)})


def test_groups_and_links(spark, commits, sessions):
    numstat = spark.createDataFrame([(1, "s1", "f", 5, 1), (1, "s1", "g", 2, 0), (1, "s4", "f", 1, 1)], "repo_id int, sha string, file string, added long, deleted long")
    groups = grouping.commit_groups(commits, numstat, sessions).cache()
    got = [(r.id, r.group_type, sorted(r.commit_shas), r.title, r.branch, r.insertions, r.coverage) for r in groups.orderBy("id").collect()]
    assert got == [
        (1, "pr", ["s4", "s5"], "PR #12", "topic", 1, "partial"),  # 12 also takes 123
        (2, "commit_cluster", ["s1", "s2"], "2 commits: fix: one", None, 7, "partial"),  # exactly two hours
        (3, "single_commit", ["s3"], "add three", None, 0, "none"),
    ]
    e = {r.episode_id: r for r in linking.episodes(groups, sessions).collect()}
    assert [e[i].session_ids for i in range(1, 5)] == [["a", "c"], ["b"], ["d"], ["e"]]
    assert [e[i].episode_type for i in range(1, 5)] == ["implementation", "implementation", "feature", "session_only"]
    assert [e[i].confidence for i in range(1, 5)] == [0.85, 0.9, 0.5, 0.3]


def test_logs_of_a_real_repository(spark, tmp_path):
    run = lambda *a, when="2026-01-01T10:00:00+02:00": subprocess.run(["git", "-C", str(tmp_path), *a], check=True, capture_output=True, env={"GIT_AUTHOR_DATE": when, "GIT_COMMITTER_DATE": when, "GIT_AUTHOR_NAME": "A b", "GIT_AUTHOR_EMAIL": "a@b.c", "GIT_COMMITTER_NAME": "A b", "GIT_COMMITTER_EMAIL": "a@b.c", "PATH": "/usr/bin:/bin", "HOME": str(tmp_path)})
    run("init", "-q")
    (tmp_path / "x.py").write_text("a\nb\n")
    run("add", ".")
    run("commit", "-qm", "feat: one\ttab")
    (tmp_path / "x.py").write_text("a\nc\n")
    (tmp_path / "bin").write_bytes(b"\x00\x01")
    run("add", ".")
    run("commit", "-qm", "second", when="2026-01-02T10:00:00+02:00")
    c, n = gitlog.export(spark, str(tmp_path))
    assert [(r.subject, r.author, r.date[:10]) for r in c.orderBy("log_pos").collect()] == [("second", "A b", "2026-01-02"), ("feat: one\ttab", "A b", "2026-01-01")]
    assert sorted((r.file, r.added, r.deleted, r.is_binary) for r in n.collect()) == [("bin", 0, 0, True), ("x.py", 1, 1, False), ("x.py", 2, 0, False)]
    assert gitlog.export(spark, str(tmp_path), names=["nobody"])[0].count() == 2
    assert gitlog.export(spark, str(tmp_path), emails=["a@b.c"], since="2026-01-02T00:00:00+02:00")[0].count() == 1
    assert gitlog.escape("a+b.c") == r"a\+b\.c"


def test_malformed_log_lines(spark):
    df = spark.createDataFrame([("r", "a\tb\tc\td\te\tf\tg\nshort\tline\n\n")], "repo_id string, content string")
    assert [(r.sha, r.subject) for r in gitlog.commits(df).collect()] == [("a", "f\tg")]
    df = spark.createDataFrame([("r", "h1|2026-01-01|n|e|sub|ject\n3\t1\ta.py\n-\t-\tb\nh2|2026-01-02|n|e|s\n")], "repo_id string, content string")
    assert sorted((r.sha, r.path, r.added) for r in gitlog.combined(df).where("path is not null").collect()) == [("h1", "a.py", 3), ("h1", "b", 0)]


def test_velocity(spark):
    c = spark.createDataFrame([(1, "a", "X", "x@y", "2026-01-01", "Revert x"), (1, "b", "X", "x@y", "2026-01-03", "feat: y")], "repo_id int, sha string, author string, email string, d string, subject string").withColumn("date", F.to_date("d"))
    f = spark.createDataFrame([(1, "a", "src/a", 1, 8), (1, "b", "spec/b", 2, 2)], "repo_id int, sha string, path string, added long, deleted long")
    v = velocity.velocity(velocity.sizes(c, f), ["repo_id"]).first()
    assert (v.net_loc, v.loc_per_day, v.date_range_days, v.test_insertions, v.ship_to_revert_ratio) == (-7, -3, 3, 2, 0.5)
    d = velocity.discipline(velocity.sizes(c, f), ["repo_id"]).first()
    assert (d.conventional, d.reverts, d.avg_commit_size_lines) == (1, 1, 7)


def test_diff_stats(spark):
    lines = ["+++ b/spec/a.rb", "+x", "-y", "+++ b/src/b.rb", "+z", "+w", "--- a/q"]
    r = grouping.diff_stats(spark.createDataFrame([(1, i, x) for i, x in enumerate(lines)], "diff_id int, pos int, line string"), velocity.TEST_PATH).first()
    assert (r.insertions, r.deletions, r.files_changed, r.test_insertions) == (3, 1, 2, 1)


def test_code_quality(spark):
    files = [
        ("README.md", "# hi"), ("package.json", '{"dependencies": {"react": "1", "x": "2"}, "devDependencies": {"jest": "3"}}'), ("src/services/a.js", "try { eval (x) } catch (e) { retry() }\n" * 301),
        ("src/models/m.js", 'token = "abcdefgh1"\nlogger.info(cache)\n'), ("test/a.test.js", "eval(1)\n"), ("node_modules/z.js", "x"), ("CLAUDE.md", "- NEVER do\n- MUST do\n"), ("big.py", None), (".github/workflows/ci.yml", "on: push"),
        ("lib/e.py", "try:\n x\nexcept:\n y\nexcept Exception:\n z\nexcept ValueError:\n w\n"),
    ]
    df = spark.createDataFrame([("r", p, i, 200_000 if c is None else len(c), c) for i, (p, c) in enumerate(files)], "repo_id string, path string, file_pos long, size long, content string")
    c = spark.createDataFrame([("r", "s", "a", "e", "2026-01-01", "feat: x")], "repo_id string, sha string, author string, email string, d string, subject string").withColumn("date", F.to_date("d"))
    n = spark.createDataFrame([("r", "s", "src/a", 3, 1)], "repo_id string, sha string, path string, added long, deleted long")
    q = codequality.analyse(df, c, n).first()
    assert q.status == "complete" and q.project_framework == "node"
    assert q.dependencies.dependency_count == 3 and q.dependencies.frameworks == ["react", "jest"]
    assert {x.component: x.n for x in q.architecture.components} == {"services": 1, "models": 1}
    assert q.error_handling.rescue_specific == 302 and q.error_handling.rescue_generic == 2 and q.error_handling.has_retry_logic
    assert (q.security_signals.eval_usage, q.security_signals.hardcoded_secret_patterns) == (301, 1)
    assert q.code_quality.long_file_count == 1 and q.code_quality.total_source_files == 5
    assert q.agent_configs.tools_configured == ["claude_code"] and q.agent_configs.rules.rules_count == 2 and q.agent_configs.total_constraint_count == 2
    assert q.infrastructure.has_ci and not q.infrastructure.has_linter and q.test_quality.frameworks.jest
    assert q.production_readiness.has_logging and q.performance.has_caching and q.documentation.has_readme


def test_listing(tmp_path, spark):
    """Tracked files only, hidden ones too; links that lead outside and vendored files are left out."""
    repo, outside = tmp_path / "repo", tmp_path / "outside.py"
    outside.write_text("x")
    for name in ("a.py", "build/b.py", "node_modules/c.js", "lib/vendor/bundle/d.rb", ".github/workflows/ci.yml", "pkg/__init__.py"):
        (repo / name).parent.mkdir(parents=True, exist_ok=True)
        (repo / name).write_text("y = 1\n")
    (repo / "out.py").symlink_to(outside)
    (repo / "in.py").symlink_to(repo / "a.py")
    kept = [".github/workflows/ci.yml", "a.py", "build/b.py", "in.py", "pkg/__init__.py"]
    assert repofiles.listing(str(repo)) == kept
    got = repofiles.files(spark, str(repo)).orderBy("file_pos").collect()
    assert [(r.path, r.size, r.content) for r in got] == [(n, 6, "y = 1\n") for n in kept]
    subprocess.run(["git", "-C", str(repo), "init", "-q"], check=True)
    subprocess.run(["git", "-C", str(repo), "add", "a.py", "out.py", ".github"], check=True)
    assert repofiles.listing(str(repo)) == [".github/workflows/ci.yml", "a.py"]


def test_statuses(tmp_path, spark):
    c = spark.createDataFrame([], "repo_id string, sha string, author string, email string, date date, subject string")
    n = spark.createDataFrame([], "repo_id string, sha string, path string, added long, deleted long")
    assert stages.quality(spark, str(tmp_path / "none"), c, n) == {"status": "no_repo", "dimensions": {}}
    assert stages.quality(spark, str(tmp_path), c, n)["status"] == "empty_repo"
    (tmp_path / "a.py").write_text("x = 1\n")
    q = stages.quality(spark, str(tmp_path), c, n)
    assert q["status"] == "complete" and q["file_count"] == 1 and q["dimensions"]["code_quality"]["total_source_files"] == 1
    assert codequality.profile(q)["project_framework"] == "generic" and codequality.profile({"status": "no_repo", "dimensions": {}}) == {"status": "no_repo"}


def test_a_failing_dimension_is_alone(tmp_path, spark):
    (tmp_path / "a.py").write_text("x = 1\n")
    files = repofiles.files(spark, str(tmp_path), "r")
    c = spark.createDataFrame([("r", "s", "a", "e", "2026-01-01", "feat: x")], "repo_id string, sha string, author string, email string, d string, subject string").withColumn("date", F.to_date("d"))
    n = spark.createDataFrame([("r", "s", "src/a", 3, 1)], "repo_id string, sha string, path string, added long, deleted long")
    broken = codequality.analyse(files, c, n).withColumn("documentation", F.struct(F.raise_error(F.lit("no")).cast("string").alias("x")))
    q = codequality.evaluated(broken)
    assert q["status"] == "complete" and q["dimensions"]["documentation"]["status"] == "error" and q["dimensions"]["code_quality"]["total_source_files"] == 1


def test_links_to_a_neighbour_are_outside(tmp_path):
    """A link from ``repo`` to ``repo-private`` leads outside, whatever their names share."""
    repo, private = tmp_path / "repo", tmp_path / "repo-private"
    repo.mkdir()
    private.mkdir()
    (private / "secret.py").write_text("x")
    (repo / "own.py").write_text("x")
    (repo / "bad.py").symlink_to(private / "secret.py")
    (repo / "good.py").symlink_to(repo / "own.py")
    assert repofiles.listing(str(repo)) == ["good.py", "own.py"]


def test_notes_are_named_as_their_sessions(spark, tmp_path):
    # the name was an encoded part of an address before
    names = ["plain", "with space", "é%20x", "a.md"]
    rows = [(f"{n}.md", f"of {n} <SESSION_INTENT> shipping </session_intent>\n\nend") for n in names] + [("other.txt", "no"), ("deep/er.md", "no")]
    linefiles.write(spark.createDataFrame(rows, "path string, value string"), str(tmp_path))
    got = {r.session_id: (r.narrative, r.intent) for r in repofiles.narratives(spark, str(tmp_path)).collect()}
    assert got == {n: (f"of {n} \n\nend", "shipping") for n in names}


def test_very_many_notes_are_dealt_to_few_tasks(spark, tmp_path):
    linefiles.write(spark.range(1000).selectExpr("concat('s', id, '.md') AS path", "cast(id AS string) AS value"), str(tmp_path))
    notes = repofiles.narratives(spark, f"file://{tmp_path}")
    assert notes.rdd.getNumPartitions() == 4 and {(r.session_id, r.narrative) for r in notes.collect()} == {(f"s{i}", str(i)) for i in range(1000)}
