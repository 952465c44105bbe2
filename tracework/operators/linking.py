"""Links between sessions and commit groups, and the episodes they make.

``groups``: as :func:`grouping.commit_groups`. ``sessions``: repo_id, sess_pos, session_id,
pr_number, git_branch, branches (switched to, in order), shas, start, end, is_root.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..stored import stored
from . import sequence as S
from .decisions import first_of

# Link tiers and their confidence.
TIERS = (("pr_match", 1.0), ("sha_match", 0.9), ("branch_match", 0.7), ("timestamp_overlap", 0.5))
COMMIT_ONLY, SESSION_ONLY = 0.5, 0.3


def time_range(created: Column, modified: Column, first_commit: Column, last_commit: Column) -> Column:
    """(start, end): the session's own times if both are known, else those of its commits."""
    own = F.when(created.isNotNull() & modified.isNotNull(), F.struct(created.alias("start"), modified.alias("end")))
    return F.coalesce(own, F.when(first_commit.isNotNull(), F.struct(first_commit.alias("start"), last_commit.alias("end"))))


def edges(groups: DataFrame, sessions: DataFrame, tolerance_seconds: int = P.LINK_TOLERANCE_HOURS * 3600) -> DataFrame:
    """(repo_id, id, session_id, sess_pos, tier): every link of every tier, from one equi-join a tier and an interval join."""
    g = groups.withColumn("a_start", F.coalesce("earliest_commit_at", "latest_commit_at")).withColumn("a_end", F.coalesce("latest_commit_at", "earliest_commit_at"))
    who = ["repo_id", "id", "session_id", "sess_pos"]
    s = sessions.withColumn("__branch", F.coalesce(F.nullif(F.try_element_at("branches", F.lit(-1)), F.lit("")), F.nullif("git_branch", F.lit(""))))
    pr = g.where("pr_number is not null").join(s.select("repo_id", "session_id", "sess_pos", "pr_number"), ["repo_id", "pr_number"]).select(*who, F.lit(1).alias("tier"))
    sha = g.select("repo_id", "id", F.explode("commit_shas").alias("sha")).join(s.select("repo_id", "session_id", "sess_pos", F.explode("shas").alias("sha")), ["repo_id", "sha"]).select(*who, F.lit(2).alias("tier")).distinct()
    branch = g.where(F.nullif("branch", F.lit("")).isNotNull()).join(s.select("repo_id", "session_id", "sess_pos", F.col("__branch").alias("branch")), ["repo_id", "branch"]).select(*who, F.lit(3).alias("tier"))
    a = g.where("a_start is not null").select("repo_id", "id", "a_start", "a_end")
    b = s.where("start is not null and end is not null").select("repo_id", "session_id", "sess_pos", F.col("start").alias("b_start"), F.col("end").alias("b_end"))
    near = S.overlap_join(a, b, ["repo_id"], tolerance_seconds).select(*who, F.lit(4).alias("tier"))
    return pr.unionByName(sha).unionByName(branch).unionByName(near)


def best_links(found: DataFrame) -> DataFrame:
    """The strongest tier of each session and group."""
    return found.groupBy("repo_id", "id", "session_id", "sess_pos").agg(F.min("tier").alias("tier"))


def first_match(best: DataFrame) -> DataFrame:
    """Each session joins the first group, in creation order, that it has any link to; sessions are independent of each other."""
    return S.first_by(best, ["repo_id", "session_id"], ["id", "sess_pos"])


def tier_name(tier: Column) -> Column:
    return first_of([(tier == i + 1, n) for i, (n, _) in enumerate(TIERS)])


def tier_confidence(tier: Column) -> Column:
    return first_of([(tier == i + 1, F.lit(c)) for i, (_, c) in enumerate(TIERS)])


def episode_type(title: Column) -> Column:
    """From a group's title; "ci" and "add" count anywhere in it."""
    t = F.lower(F.coalesce(title, F.lit("")))
    return first_of(
        [(t.startswith("fix"), "bugfix"), (t.contains("refactor"), "refactor"), (t.startswith("feat") | t.contains("add"), "feature"), (t.contains("infra") | t.contains("ci") | t.contains("deploy"), "infrastructure")],
        "implementation",
    )


def episodes(groups: DataFrame, sessions: DataFrame) -> DataFrame:
    """One episode a group with the sessions that joined it, then one for each root session that joined none."""
    from ..functions.numeric import round_binary

    roots = sessions.where("is_root")
    # read twice below
    joined = stored(first_match(best_links(edges(groups, roots))))
    link = F.struct("sess_pos", "session_id", tier_name(F.col("tier")).alias("link_type"), tier_confidence(F.col("tier")).alias("link_confidence"))
    per = joined.groupBy("repo_id", "id").agg(F.sort_array(F.collect_list(link)).alias("links"), F.avg(tier_confidence(F.col("tier"))).alias("mean"))
    e = groups.join(per, ["repo_id", "id"], "left")
    none = F.array().cast("array<struct<sess_pos:bigint,session_id:string,link_type:string,link_confidence:double>>")
    linked = e.select(
        "repo_id", F.lit(1).alias("kind"), F.col("id").alias("place"), episode_type(F.col("title")).alias("episode_type"), F.coalesce(round_binary(F.col("mean"), 2), F.lit(COMMIT_ONLY)).alias("confidence"),
        F.coalesce("links", none).alias("links"), F.array("id").alias("commit_group_ids"), F.col("insertions").alias("added_lines"), F.col("deletions").alias("deleted_lines"),
    )
    alone = roots.join(joined.select("repo_id", "session_id"), ["repo_id", "session_id"], "left_anti").select(
        "repo_id", F.lit(2).alias("kind"), F.col("sess_pos").alias("place"), F.lit("session_only").alias("episode_type"), F.lit(SESSION_ONLY).alias("confidence"),
        F.array(F.struct("sess_pos", "session_id", F.lit(None).cast("string").alias("link_type"), F.lit(SESSION_ONLY).alias("link_confidence"))).alias("links"),
        F.array().cast("array<bigint>").alias("commit_group_ids"), F.lit(0).cast("long").alias("added_lines"), F.lit(0).cast("long").alias("deleted_lines"),
    )
    all_of = linked.unionByName(alone)
    all_of = all_of.withColumn("episode_id", F.row_number().over(S.window(["repo_id"], ["kind", "place"])).cast("long"))
    return all_of.withColumn("session_ids", F.transform("links", lambda x: x.session_id)).drop("kind", "place")
