"""Version-control logs: text exports as tables, and their export from a local repository."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import times as TM
from ..operators import scans
from ..operators.scans import Stream
from . import linefiles

# Log formats and limits.
COMMITS_FORMAT, NUMSTAT_FORMAT = "%H%x09%h%x09%aN%x09%aE%x09%aI%x09%s", "COMMIT_BOUNDARY %H %aI %aN <%aE>"
COMMIT_LIMIT, LOOKBACK_DAYS = 1000, 7


def lines(spark: SparkSession, paths: str | list[str], suffix: str = ".log") -> DataFrame:
    """(repo_id, log_pos, line, error) of exported logs, a file a repository (its path): read in splits, in order of byte offsets."""
    return linefiles.read(spark, paths, suffix).select(F.col("path").alias("repo_id"), F.col("at").alias("log_pos"), F.col("raw").alias("line"), "error")


def rejects(found: DataFrame) -> DataFrame:
    """(repo_id, log_pos, reason) of reads that ended early."""
    return found.where("error is not null").select("repo_id", "log_pos", F.col("error").alias("reason"))


def _lines(df: DataFrame) -> DataFrame:
    """(repo_id, log_pos, line) of lines, or of whole logs (repo_id, content)."""
    if "line" in df.columns:
        return df.where("line is not null").select("repo_id", "log_pos", "line").where(F.trim("line") != "")
    return df.select("repo_id", F.posexplode(F.split("content", "\r\n|\n|\r")).alias("log_pos", "line")).withColumn("log_pos", F.col("log_pos").cast("long")).where(F.trim("line") != "")


def commits(logs: DataFrame) -> DataFrame:
    """(repo_id, log_pos, sha, short, author, email, date, ts, subject) of tab-separated logs (repo_id, content); lines of fewer than six fields are dropped, tabs stay in subjects."""
    parts = _lines(logs).withColumn("f", F.split("line", "\t", 6)).where(F.size("f") == 6)
    names = ("sha", "short", "author", "email", "date", "subject")
    out = parts.select("repo_id", "log_pos", *[F.get("f", i).alias(n) for i, n in enumerate(names)])
    return out.withColumn("ts", TM.instant(F.col("date")))


def numstat(logs: DataFrame, spread: bool = False) -> DataFrame:
    """(repo_id, sha, date, author, email, file, added, deleted, is_binary): file lines under the boundary line before them; ``-`` counts 0. ``spread``: a log too long for a task is scanned by ranges."""
    head = r"^COMMIT_BOUNDARY (\S+)(?: (\S+))?(?: (.*))?$"
    d = _lines(logs).withColumn("line", F.trim("line"))
    d = d.withColumn("h", F.when(F.col("line").startswith("COMMIT_BOUNDARY"), F.struct(*[F.regexp_extract("line", head, i).alias(n) for i, n in ((1, "sha"), (2, "date"), (3, "who"))])))
    d = Stream(d, ["repo_id"], ["log_pos"], spread).scan(h=scans.last(F.col("h"), own=True)).rows().where(F.col("line").rlike(r"^(\d+|-)\t(\d+|-)\t.+$") & F.col("h").isNotNull())
    f = F.split("line", "\t", 3)
    number = lambda i: F.coalesce(F.get(f, i).try_cast("long"), F.lit(0))
    who = r"^(.+?)\s+<([^>]+)>$"
    return d.select(
        "repo_id", "h.sha", "h.date", F.when(F.col("h.who").rlike(who), F.regexp_extract("h.who", who, 1)).otherwise(F.col("h.who")).alias("author"), F.nullif(F.regexp_extract("h.who", who, 2), F.lit("")).alias("email"),
        F.get(f, 2).alias("file"), number(0).alias("added"), number(1).alias("deleted"), (F.get(f, 0) == "-").alias("is_binary"),
    )


def combined(logs: DataFrame, spread: bool = False) -> DataFrame:
    """(repo_id, log_pos, sha, date, author, email, subject, path, added, deleted, is_binary) of logs with five fields cut by vertical bars, each followed by its files."""
    d = _lines(logs)
    f = F.split("line", r"\|", 5)
    isfile = F.col("line").rlike(r"^(\d+|-)\t(\d+|-)\t.+$")
    head = F.when(~isfile & (F.size(f) == 5), F.struct(*[F.get(f, i).alias(n) for i, n in enumerate(("sha", "date", "author", "email", "subject"))]))
    d = Stream(d, ["repo_id"], ["log_pos"], spread).scan(h=scans.last(head, own=True)).rows().where("h is not null")
    t = F.split("line", "\t", 3)
    number = lambda i: F.when(isfile, F.coalesce(F.get(t, i).try_cast("long"), F.lit(0)))
    return d.select("repo_id", "log_pos", "h.*", F.when(isfile, F.get(t, 2)).alias("path"), number(0).alias("added"), number(1).alias("deleted"), (isfile & (F.get(t, 0) == "-")).alias("is_binary"))


def payload(found: DataFrame) -> DataFrame:
    """(sha, date): what the report needs of each commit, dates as recorded."""
    return found.select("sha", "date")


def default_since(sessions: DataFrame) -> str | None:
    """A week before the first session began, as ISO text; None without a time."""
    first = sessions.agg(TM.iso(F.min(TM.instant(F.col("session_created_at"))) - F.expr(f"INTERVAL {LOOKBACK_DAYS} DAYS"))).first()[0]
    return first


def escape(value: str) -> str:
    """``value`` for git's basic author patterns."""
    return re.sub(r"([.+*?^$\[\]\\])", r"\\\1", value)


def author_flags(names: list[str], emails: list[str]) -> list[str]:
    return [f"--author=<{escape(e)}>" for e in emails if e] + [f"--author={escape(n)}" for n in names if n]


def export(spark: SparkSession, repos: str | list[str], since: str | None = None, names: list[str] = (), emails: list[str] = ()) -> tuple[DataFrame, DataFrame]:
    """(commits, numstat) of local repositories, each read in a task of its own: the author's log, both parts of it, where it isn't empty, else the newest thousand commits."""
    commit_lines, stat_lines = (export_lines(spark, repos, form, since, names, emails) for form in ([f"--format={COMMITS_FORMAT}"], [f"--format={NUMSTAT_FORMAT}", "--numstat"]))
    return commits(commit_lines), numstat(stat_lines)


def export_lines(spark: SparkSession, repos: str | list[str], form: list[str], since: str | None = None, names: list[str] = (), emails: list[str] = ()) -> DataFrame:
    """(repo_id, log_pos, line, error) of the logs of local repositories in a format; a repository that can't be read gives its error."""
    window = [f"--since={since}"] if since else []
    flags = author_flags(list(names), list(emails))
    found = linefiles.read_git(spark, [repos] if isinstance(repos, str) else list(repos), [*flags, *window] if flags else [], [f"-{COMMIT_LIMIT}", *window], form)
    return found.select(F.col("path").alias("repo_id"), F.col("at").alias("log_pos"), F.col("raw").alias("line"), "error")
