"""The stages as functions from paths to tables; each result is written as Parquet for the next."""

from __future__ import annotations

import argparse
import json
import os
import sys
from pathlib import Path

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions import times as TM
from ..operators import codequality, condense, decisions, events, grouping, linking, rollup, scans, steering, velocity
from ..sources import gitlog, repofiles, transcripts
from . import documents, report

ANSWERS = "session_id string, batch_id long, pos long, index long, is_decision boolean, decision_type string, confidence string, narrative string, law_key string"
SCORES = "episode_id long, title string, facts string, interpretation string, counterweight string, confidence double, scores map<string,double>"
CALLS = "stage string, target string, model string, total_tokens long, duration_s double"


def loaded(spark: SparkSession, paths: list[str], seen: Observation | None = None) -> DataFrame:
    """Transcripts under ``paths``, read and parsed once; ``seen`` observes that pass."""
    return transcripts.held(transcripts.read_lines(spark, paths), seen)


def condensed(lines: DataFrame) -> DataFrame:
    return condense.condensed(transcripts.entries(lines))


def extracted(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(sessions, events)."""
    found = transcripts.entries(lines)
    spread = scans.too_long(found, ["session_id"])
    return events.sessions(found, spread), events.extract(found, spread)[0]


def link_inputs(sessions: DataFrame, found: DataFrame, repo: str) -> DataFrame:
    """Session records as linking needs them, in order of their paths; their time is their own or that of their commits."""
    c = found.where("type = 'git_commit'").groupBy("session_id").agg(F.min("ts").alias("first_commit"), F.max("ts").alias("last_commit"))
    s = sessions.join(transcripts.sessions_in_order(sessions).select("session_id", "sess_pos"), "session_id").join(c, "session_id", "left")
    span = linking.time_range(TM.instant(F.col("session_created_at")), TM.instant(F.col("session_modified_at")), F.col("first_commit"), F.col("last_commit"))
    none = F.array().cast("array<string>")
    return s.withColumn("__span", span).select(
        F.lit(repo).alias("repo_id"), "sess_pos", "session_id", "pr_number", "git_branch",
        F.coalesce("event_branches", none).alias("branches"), F.coalesce("event_git_shas", none).alias("shas"), "__span.start", "__span.end", (~F.col("is_subagent")).alias("is_root"),
    )


def gitdata(spark: SparkSession, repo: str, sessions: DataFrame, found: DataFrame, since: str | None = None, names: list[str] = (), emails: list[str] = ()) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(groups, episodes, commits, numstat) of a local repository and the sessions that worked on it."""
    commits, numstat = gitlog.export(spark, repo, since or gitlog.default_since(sessions), names, emails)
    own = link_inputs(sessions, found, repo)
    groups = grouping.commit_groups(commits, numstat, own)
    return groups, linking.episodes(groups, own), commits, numstat


def candidates(spark: SparkSession, stored_events: str) -> tuple[DataFrame, DataFrame]:
    """(candidates, batches) for the external classifier."""
    found = decisions.candidates(spark.read.parquet(stored_events))
    return found, decisions.batches(found)


def finalised(spark: SparkSession, stored_events: str, answers: str, catalog: str) -> DataFrame:
    return decisions.finalise(spark.read.parquet(stored_events), repofiles.json_lines(spark, answers, ANSWERS), repofiles.catalog(spark, catalog))


def quality(spark: SparkSession, repo: str, commits: DataFrame, numstat: DataFrame) -> dict:
    """status (complete, empty_repo, no_repo, error), file_count and dimensions of a local repository."""
    try:
        if not os.path.isdir(repo):
            return {"status": "no_repo", "dimensions": {}}
        names = repofiles.listing(repo)
        if not names:
            return {"status": "empty_repo", "dimensions": {}}
        return codequality.evaluated(codequality.analyse(repofiles.files(spark, repo, repo), commits, numstat)) | {"file_count": len(names)}
    except Exception as e:
        return {"status": "error", "error": f"{type(e).__name__}: {e}", "dimensions": {}}


def analytics(spark: SparkSession, repo: str, commits: DataFrame, numstat: DataFrame, sessions: DataFrame, found: DataFrame, names: list[str] = (), emails: list[str] = ()) -> tuple[dict, str]:
    """Repository metrics, velocity, steering, parallelism and profile: as a record, and as markdown."""
    c = commits.withColumn("date", TM.wall_date(F.col("date")))
    files = numstat.select("repo_id", "sha", F.col("file").alias("path"), "added", "deleted")
    q = quality(spark, repo, c, files)
    sized = velocity.sizes(c, files)
    v = velocity.velocity(sized, ["repo_id"]).first()
    pace = v.asDict() if v else {}
    if v:
        days = velocity.daily(sized.where("date is not null"), ["repo_id"])
        top = velocity.peak_day(days, ["repo_id"]).first()
        pace |= {"peak_date": str(top.date), "peak_insertions": top.insertions, "peak_commits": top.commits} if top else {}
        pace["authors"] = velocity.by_author(sized, ["repo_id"]).count()
        if names or emails:
            own = velocity.velocity(velocity.sizes(velocity.scoped(c, list(names), list(emails)), files), ["repo_id"]).first()
            pace |= {f"author_{k}": own[k] for k in ("insertions", "deletions", "commits", "loc_per_day")} if own else {}
    turns = found.where("type = 'user_directive'")
    acted = steering.actions(turns, ["session_id"], "index")
    s = steering.totals(acted.drop("session_id"), []).orderBy(F.desc("n"), "action").collect()
    steered = {"actions": {r.action: r.n for r in s}, "sessions_with_actions": acted.select("session_id").distinct().count()}
    if "parent_session_id" not in sessions.columns:
        # logs don't name a parent, so sessions nested in others can't be told from main ones
        sessions = sessions.withColumn("parent_session_id", F.lit(None).cast("string"))
    p = steering.parallelism(sessions, found).first()
    record = {"session_count": sessions.count(), "code_quality": q, "velocity": pace, "steering": steered, "parallelism": p.asDict(), "profile": codequality.profile(q)}
    return record, report.render_analytics(record)


def aggregate(path: str) -> dict:
    """Rollup of a small JSON file of scored episodes, on the driver's session."""
    from ..session import session

    raw = json.loads(Path(path).read_text())
    eps = raw.get("episodes", []) if isinstance(raw, dict) else raw
    rows = [(i, a, float(s), e.get("confidence") if isinstance(e.get("confidence"), (int, float)) else None) for i, e in enumerate(eps) for a, s in (e.get("scores") or {}).items() if a in rollup.AXES and isinstance(s, (int, float))]
    cells = session().createDataFrame(rows, "episode_id int, axis string, score double, confidence double").withColumn("all", F.lit(1))
    r = rollup.rollup(cells, ["all"]).first()
    return {"episodes_scored": len(eps), "axes": r.axes if r else {}, "overall": r.overall if r else None, "band": r.band if r else None}


def export_json(df: DataFrame, path: str) -> None:
    """JSON lines, without null fields."""
    df.select(F.to_json(F.struct("*")).alias("value")).write.mode("overwrite").text(path)


def export_indented(df: DataFrame, path: str) -> None:
    """Indented JSON, a document a record."""
    df.select(F.to_json(F.struct("*"), {"pretty": "true"}).alias("value")).write.mode("overwrite").text(path)


def say(text: str) -> None:
    """A count or a skipped file, beside the results."""
    print(text, file=sys.stderr)


def say_seen(seen: Observation, lines: DataFrame) -> None:
    """What the pass over the transcripts has seen, and every file with lines that hold no entry, from the lines held."""
    got = seen.get
    say(f"[read] {got['lines']} line(s): {got['unparsable']} unparsable, {got['not_objects']} not an object, {got['errors']} read(s) ended early")
    if got["unparsable"] or got["not_objects"] or got["errors"]:
        skipped = transcripts.rejects(lines).groupBy("path").agg(F.count("*").alias("n"), F.min("reason").alias("reason"))
        for r in skipped.orderBy("path").toLocalIterator():
            say(f"[skip] {r.path}: {r.n} line(s), {r.reason}")


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tracework", description="Stages of the session-log pipeline; tables are Parquet folders.")
    sub = p.add_subparsers(dest="stage", required=True)

    def stage(name: str, *required: str, paths: bool = False, optional: tuple[str, ...] = (), many: tuple[str, ...] = ()) -> None:
        s = sub.add_parser(name)
        if paths:
            s.add_argument("paths", nargs="+")
        for a in required:
            s.add_argument(f"--{a}", required=True)
        for a in optional:
            s.add_argument(f"--{a}")
        for a in many:
            s.add_argument(f"--{a}", action="append", default=[])

    stage("condense", "out", paths=True)
    stage("events", "out", paths=True)
    stage("gitdata", "repo", "logs", "out", optional=("since",), many=("author-name", "author-email"))
    stage("extract", "events", "out")
    stage("finalize", "events", "answers", "catalog", "out")
    stage("episodes", "logs", "gitdata", "narratives", "decisions", "out")
    stage("aggregate", "scores")
    stage("analytics", "repo", "logs", "gitdata", "out", optional=("json",), many=("author-name", "author-email"))
    stage("report", "logs", "gitdata", "scores", "decisions", "out", optional=("llm-calls",))
    return p


def main(argv: list[str] | None = None) -> int:
    from ..session import session

    a = _parser().parse_args(argv)
    if a.stage == "aggregate":
        print(json.dumps(aggregate(a.scores), indent=2))
        return 0
    spark = session()
    load = lambda *parts: spark.read.parquet("/".join(parts))

    def save(df: DataFrame, *parts: str) -> None:
        df.write.mode("overwrite").parquet("/".join(parts))

    if a.stage in ("condense", "events"):
        seen = Observation("transcripts")
        lines = loaded(spark, a.paths, seen)
        say_seen(seen, lines)
        if a.stage == "condense":
            save(condensed(lines), a.out)
        else:
            s, e = extracted(lines)
            save(e, a.out, "events")
            save(s, a.out, "sessions")
        save(transcripts.rejects(lines), f"{a.out.rstrip('/')}-rejects")
    elif a.stage == "gitdata":
        made = gitdata(spark, a.repo, load(a.logs, "sessions"), load(a.logs, "events"), a.since, a.author_name, a.author_email)
        for name, df in zip(("groups", "episodes", "commits", "numstat"), made, strict=True):
            save(df, a.out, name)
        for name in ("groups", "episodes"):
            export_indented(load(a.out, name), f"{a.out}/{name}.json")
        say(f"[gitdata] {load(a.out, 'commits').count()} commits, {load(a.out, 'groups').count()} groups, {load(a.out, 'episodes').count()} episodes (since={a.since})")
    elif a.stage == "extract":
        found, packed = candidates(spark, a.events)
        save(found, a.out, "candidates")
        export_json(packed, f"{a.out}/batches")
        found = load(a.out, "candidates")
        say(f"{found.count()} candidate(s), {packed.count()} batch(es) from {load(a.events).select('session_id').distinct().count()} session(s)")
    elif a.stage == "finalize":
        save(finalised(spark, a.events, a.answers, a.catalog), a.out)
        export_indented(load(a.out), f"{a.out}.json")
        say(f"{load(a.out).count()} decision(s) from {decisions.candidates(load(a.events)).count()} candidate(s)")
    elif a.stage == "episodes":
        made = documents.documents(load(a.gitdata, "episodes"), load(a.logs, "sessions"), load(a.gitdata, "groups"), repofiles.narratives(spark, a.narratives), load(a.decisions), load(a.logs, "events"))
        documents.write(made, a.out)
    elif a.stage == "analytics":
        record, text = analytics(spark, a.repo, load(a.gitdata, "commits"), load(a.gitdata, "numstat"), load(a.logs, "sessions"), load(a.logs, "events"), a.author_name, a.author_email)
        Path(a.out).write_text(text)
        if a.json:
            Path(a.json).write_text(json.dumps(record, indent=2, ensure_ascii=False, default=str) + "\n")
    else:
        scores = repofiles.json_lines(spark, a.scores, SCORES).withColumn("pos", F.monotonically_increasing_id())
        calls = repofiles.json_lines(spark, a.llm_calls, CALLS) if a.llm_calls else None
        given = load(a.logs, "sessions"), load(a.logs, "events"), gitlog.payload(load(a.gitdata, "commits")), load(a.gitdata, "episodes"), scores, load(a.decisions), calls
        with open(a.out, "w", encoding="utf-8") as out:
            out.writelines(f"{line}\n" for line in report.lines(*given))
    return 0
