"""Velocity and commit metrics.

``commits``: repo_id, sha, author, email, date (author-local), subject. ``files``: repo_id, sha, path, added, deleted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import numeric as N
from . import sequence as S

# Test paths of velocity (anywhere, any case) and of quality (directories and suffixes), and kinds of subjects.
TEST_PATH = r"(?i)(?:test|spec|__tests__|_test\.go|_test\.rb|\.test\.|\.spec\.)"
REVERT_SUBJECT, REFACTOR_SUBJECT, VERSION_SUBJECT = r"(?i)\Arevert", r"(?i)refactor", r"(?i)bump|version|release|v\d+\.\d+"
CONVENTIONAL_SUBJECT = r"\A(feat|fix|docs|style|refactor|test|chore|perf|ci|build|revert)[(:]"
ATOMIC_FILES = 20


def sizes(commits: DataFrame, files: DataFrame, test: Column | None = None) -> DataFrame:
    """Commits with insertions, deletions, test_insertions and n_files."""
    is_test = F.col("path").rlike(TEST_PATH) if test is None else test
    s = files.groupBy("repo_id", "sha").agg(
        F.sum("added").alias("insertions"), F.sum("deleted").alias("deletions"), F.sum(F.when(is_test, F.col("added")).otherwise(0)).alias("test_insertions"),
        F.sum(F.when(is_test, F.col("deleted")).otherwise(0)).alias("test_deletions"), F.count("*").alias("n_files"),
    )
    return commits.join(s, ["repo_id", "sha"], "left").na.fill(0, ["insertions", "deletions", "test_insertions", "test_deletions", "n_files"])


def daily(sized: DataFrame, keys: list[str], date: str = "date") -> DataFrame:
    return sized.groupBy(*keys, date).agg(F.count("*").alias("commits"), F.sum("insertions").alias("insertions"), F.sum("deletions").alias("deletions"))


def by_author(sized: DataFrame, keys: list[str], author: str = "author") -> DataFrame:
    return sized.groupBy(*keys, author).agg(F.count("*").alias("commits"), F.sum("insertions").alias("insertions"), F.sum("deletions").alias("deletions"), F.count_distinct("date").alias("active_days"))


def peak_day(days: DataFrame, keys: list[str], date: str = "date") -> DataFrame:
    """The day with the most insertions; of equals the first."""
    return S.first_by(days, keys, [F.desc("insertions"), date])


def velocity(sized: DataFrame, keys: list[str], days_without_dates: int = 0) -> DataFrame:
    """Totals, span of days, lines a day (rounded down), test share and the share of commits that aren't reverts.

    ``days_without_dates`` is the span of a person's commits none of which has a date.
    """
    span = F.coalesce(F.datediff(F.max("date"), F.min("date")) + 1, F.lit(days_without_dates)).cast("long")
    v = sized.groupBy(*keys).agg(
        F.count("*").alias("commits"), F.sum("insertions").alias("insertions"), F.sum("deletions").alias("deletions"),
        F.sum("test_insertions").alias("test_insertions"), F.sum("test_deletions").alias("test_deletions"), span.alias("date_range_days"),
        F.count_if(F.coalesce("subject", F.lit("")).rlike(REVERT_SUBJECT)).alias("reverts"),
    )
    net = F.col("insertions") - F.col("deletions")
    return v.withColumns({
        "net_loc": net, "loc_per_day": N.floor_div(net, F.greatest(F.col("date_range_days"), F.lit(1))),
        "test_ratio": N.ratio(F.col("test_insertions"), F.col("insertions")), "ship_to_revert_ratio": N.ratio(F.col("commits") - F.col("reverts"), F.col("commits")),
    })


def scoped(commits: DataFrame, names: list[str], emails: list[str]) -> DataFrame:
    """Commits of one person, by any of their names or addresses, whatever the case."""
    low = lambda xs: [x.lower() for x in xs if x]
    return commits.where(F.lower(F.coalesce("author", F.lit(""))).isin(*low(names)) | F.lower(F.coalesce("email", F.lit(""))).isin(*low(emails)))


def discipline(sized: DataFrame, keys: list[str]) -> DataFrame:
    """Commit discipline, workflow and evolution as counts and ratios, in one aggregate."""
    subject, changed = F.coalesce("subject", F.lit("")), F.col("insertions") + F.col("deletions")
    d = sized.groupBy(*keys).agg(
        F.count("*").alias("total_commits"), F.count_if(subject.rlike(CONVENTIONAL_SUBJECT)).alias("conventional"), F.count_if(subject.rlike(REVERT_SUBJECT)).alias("reverts"),
        F.count_if(F.col("n_files") <= ATOMIC_FILES).alias("atomic"), F.sum(changed).alias("changed"), F.count_if(subject.rlike(VERSION_SUBJECT)).alias("version_commits"),
        F.count_distinct("date").alias("active_days"), F.count_if(subject.rlike(REFACTOR_SUBJECT)).alias("refactors"),
        F.sum("insertions").alias("total_lines_added"), F.sum("deletions").alias("total_lines_deleted"),
    )
    r = lambda a, b: N.ratio(F.col(a), F.col(b))
    return d.withColumns({
        "conventional_commit_ratio": r("conventional", "total_commits"), "revert_ratio": r("reverts", "total_commits"), "atomic_commit_ratio": r("atomic", "total_commits"),
        "avg_commit_size_lines": N.half_up(r("changed", "total_commits")), "commits_per_active_day": r("total_commits", "active_days"),
        "deletion_ratio": r("total_lines_deleted", "changed"), "refactor_commit_ratio": r("refactors", "total_commits"), "net_loc_change": F.col("total_lines_added") - F.col("total_lines_deleted"),
    })
