"""Commit groups: pull requests, time-gap clusters, single commits.

``commits``: repo_id, log_pos (newest first), sha, ts (null where the date can't be read), subject.
``numstat``: repo_id, sha, file, added, deleted. ``sessions``: repo_id, sess_pos, pr_number, git_branch.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import text as T
from . import sequence as S

KINDS = ("pr", "commit_cluster", "single_commit")


def line_sums(numstat: DataFrame) -> DataFrame:
    """(repo_id, sha, added, deleted): binary files count nothing."""
    return numstat.groupBy("repo_id", "sha").agg(F.sum("added").alias("added"), F.sum("deleted").alias("deleted"))


def pull_requests(commits: DataFrame, sessions: DataFrame) -> DataFrame:
    """(repo_id, pr_number, branch, sha): commits whose subject holds ``#`` and the number anywhere, so 12 also takes 123.

    Every number that starts where a subject has ``#`` is a possible key: all its prefixes of digits
    are exploded, which makes the substring test an equi-join.
    """
    prs = S.first_by(sessions.where("pr_number is not null"), ["repo_id", "pr_number"], ["sess_pos"]).select("repo_id", "pr_number", F.col("git_branch").alias("branch"))
    tags = F.explode(F.regexp_extract_all("subject", F.lit(r"#(\d+)"), F.lit(1)))
    c = commits.select("repo_id", "sha", tags.alias("tag"))
    heads = c.select("repo_id", "sha", F.explode(F.transform(F.sequence(F.lit(1), F.length("tag")), lambda n: F.left("tag", n))).alias("head"))
    heads = heads.withColumn("pr_number", F.col("head").try_cast("long")).where(F.col("pr_number").cast("string") == F.col("head")).select("repo_id", "sha", "pr_number").distinct()
    return prs.join(heads, ["repo_id", "pr_number"], "left")


def clusters(commits: DataFrame, gap_seconds: int = P.CLUSTER_GAP_HOURS * 3600) -> DataFrame:
    """Commits with ``cluster``, the number of their chain in time (gaps of at most ``gap_seconds``), for chains of more than one.

    Ties keep log order; a commit without a date sorts first and joins no chain.
    """
    known = commits.withColumn("__ts", F.coalesce("ts", F.timestamp_seconds(F.lit(0))))
    w = S.window(["repo_id"], ["__ts", "log_pos"])
    near = (F.unix_micros("ts") - F.unix_micros(F.lag("ts").over(w))) <= gap_seconds * 1_000_000
    c = known.withColumn("__new", (~F.coalesce(near, F.lit(False))).cast("int")).withColumn("cluster", F.sum("__new").over(w).cast("long"))
    c = c.withColumn("place", F.row_number().over(S.window(["repo_id", "cluster"], ["__ts", "log_pos"]))).withColumn("size", F.count("*").over(Window.partitionBy("repo_id", "cluster")))
    return c.where("size > 1").drop("__ts", "__new")


def commit_groups(commits: DataFrame, numstat: DataFrame, sessions: DataFrame) -> DataFrame:
    """All groups with their ids in creation order: pull requests by session, clusters in time, singles in log order.

    A pull request's commits leave the later kinds; one commit may be in several pull requests.
    """
    prs = pull_requests(commits, sessions)
    order = sessions.where("pr_number is not null").groupBy("repo_id", "pr_number").agg(F.min("sess_pos").alias("place"))
    in_pr = prs.where("sha is not null").select("repo_id", "sha").distinct()
    rest = commits.join(in_pr, ["repo_id", "sha"], "left_anti")
    chained = clusters(rest)
    single = rest.join(chained.select("repo_id", "sha"), ["repo_id", "sha"], "left_anti")
    title = F.concat(F.col("size").cast("string"), F.lit(" commits: "), T.truncate(F.coalesce("subject", F.lit("")), 60))
    names = S.first_by(chained, ["repo_id", "cluster"], ["place"]).select("repo_id", "cluster", title.alias("title"))
    none = F.lit(None).cast("string")
    members = (
        prs.join(order, ["repo_id", "pr_number"]).select("repo_id", F.lit(1).alias("kind"), "place", F.concat(F.lit("PR #"), "pr_number").alias("title"), "branch", "pr_number", "sha")
        .unionByName(chained.join(names, ["repo_id", "cluster"]).select("repo_id", F.lit(2).alias("kind"), F.col("cluster").alias("place"), "title", none.alias("branch"), F.lit(None).cast("long").alias("pr_number"), "sha"))
        .unionByName(single.select("repo_id", F.lit(3).alias("kind"), F.col("log_pos").alias("place"), T.truncate(F.col("subject"), 100).alias("title"), none.alias("branch"), F.lit(None).cast("long").alias("pr_number"), "sha"))
    )
    facts = members.join(commits.select("repo_id", "sha", "ts", "log_pos"), ["repo_id", "sha"], "left").join(line_sums(numstat), ["repo_id", "sha"], "left")
    by = F.when(F.col("kind") == 2, F.struct(F.unix_micros("ts").alias("a"), F.col("log_pos").alias("b"))).otherwise(F.struct(F.lit(0).cast("long").alias("a"), F.col("log_pos").alias("b")))
    g = facts.groupBy("repo_id", "kind", "place", "title", "branch", "pr_number").agg(
        F.transform(F.sort_array(F.collect_list(F.when(F.col("sha").isNotNull(), F.struct(by.alias("by"), "sha")))), lambda x: x.sha).alias("commit_shas"),
        F.coalesce(F.sum("added"), F.lit(0)).alias("insertions"), F.coalesce(F.sum("deleted"), F.lit(0)).alias("deletions"),
        F.min("ts").alias("earliest_commit_at"), F.max("ts").alias("latest_commit_at"), F.count("added").alias("covered"), F.count("sha").alias("size"),
    )
    g = g.withColumn("coverage", F.when(F.col("covered") == 0, "none").when(F.col("covered") == F.col("size"), "all").otherwise("partial"))
    g = g.withColumn("id", F.row_number().over(S.window(["repo_id"], ["kind", "place"])).cast("long"))
    kind = F.element_at(F.array(*map(F.lit, KINDS)), F.col("kind"))
    return g.select("repo_id", "id", kind.alias("group_type"), "commit_shas", "title", "branch", "pr_number", "insertions", "deletions", "earliest_commit_at", "latest_commit_at", "coverage")


def diff_stats(lines: DataFrame, test_path: str) -> DataFrame:
    """(diff_id, insertions, deletions, files_changed, test_insertions, test_deletions, test_loc_ratio) of unified diffs given as (diff_id, pos, line)."""
    new = F.regexp_extract("line", r"^\+\+\+ b/(.+)", 1)
    d = lines.withColumn("__file", S.forward_fill(["diff_id"], ["pos"], F.when(F.col("line").rlike(r"^\+\+\+ b/."), new)))
    test = F.coalesce(F.col("__file").rlike(test_path), F.lit(False))
    plus, minus = F.col("line").rlike(r"^\+(?!\+\+)"), F.col("line").rlike(r"^-(?!--)")
    s = d.groupBy("diff_id").agg(
        F.count_if(plus).alias("insertions"), F.count_if(minus).alias("deletions"), F.count_distinct("__file").alias("files_changed"),
        F.count_if(plus & test).alias("test_insertions"), F.count_if(minus & test).alias("test_deletions"),
    )
    return s.withColumn("test_loc_ratio", F.coalesce(F.try_divide(F.col("test_insertions").cast("double"), F.col("insertions").cast("double")), F.lit(0.0)))
