"""Queries over orders, line items and purchases, which stand for commits and their files.

Day-level metrics take orders (o_custkey: author, o_orderpriority: subject) and line items
(l_quantity: added, l_linenumber: deleted, l_returnflag R: a test). Clusters and links take
purchases (user_id: repository) and 90-minute sessions of the same user's events.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import grouping as G
from ..operators import linking as L
from ..operators import sequence as S
from ..operators import velocity as V
from .streams import KEYS, ORDER, events


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def commits(spark, sf_dir) -> DataFrame:
    """Purchases as commits; the subject names a pull request for some."""
    p = events(spark, sf_dir).where("event_type = 'purchase'").withColumn("k", F.get_json_object("props", "$.k").cast("long"))
    place = F.row_number().over(S.window(["user_id"], [F.desc("ts"), F.desc("event_id")]))
    subject = F.when(F.col("k") % 5 == 0, F.concat(F.lit("fix #"), F.col("k").cast("string"))).otherwise(F.concat(F.lit("feat "), F.col("k").cast("string")))
    return p.select(F.col("user_id").alias("repo_id"), place.cast("long").alias("log_pos"), F.col("event_id").cast("string").alias("sha"), "ts", subject.alias("subject"), "k")


def numstat(spark, sf_dir) -> DataFrame:
    """Two of three purchases have line counts."""
    c = commits(spark, sf_dir).where("cast(sha as long) % 3 != 0")
    return c.select("repo_id", "sha", F.lit("f").alias("file"), F.col("k").alias("added"), (F.col("k") % 7).alias("deleted"))


def sessions(spark, sf_dir) -> DataFrame:
    runs = S.gap_sessions(events(spark, sf_dir), KEYS, "ts", 90 * 60, ORDER).withColumn("k", F.get_json_object("props", "$.k").cast("long"))
    s = runs.groupBy("user_id", "session").agg(
        F.min("ts").alias("start"), F.max("ts").alias("end"), F.min("k").alias("k"), F.collect_set(F.when((F.col("event_type") == "purchase") & (F.col("event_id") % 4 == 0), F.col("event_id").cast("string"))).alias("shas")
    )
    pr = F.when(F.col("session") % 10 == 0, F.col("k"))
    return s.select(
        F.col("user_id").alias("repo_id"), F.col("session").alias("sess_pos"), F.concat_ws("-", "user_id", "session").alias("session_id"), pr.alias("pr_number"),
        F.concat(F.lit("b"), (F.col("k") % 3).cast("string")).alias("git_branch"), F.array().cast("array<string>").alias("branches"), "shas", "start", "end", (F.col("session") % 11 != 0).alias("is_root"),
    )


def commit_clusters(spark, sf_dir):
    return G.clusters(commits(spark, sf_dir)).select("repo_id", "sha", "cluster", "place", "size")


def commit_groups(spark, sf_dir):
    g = G.commit_groups(commits(spark, sf_dir), numstat(spark, sf_dir), sessions(spark, sf_dir))
    return g.select("repo_id", "id", "group_type", F.concat_ws(",", F.array_sort("commit_shas")).alias("shas"), "title", "branch", "pr_number", F.col("insertions").cast("long"), F.col("deletions").cast("long"), "coverage")


def groups(spark, sf_dir) -> DataFrame:
    return G.commit_groups(commits(spark, sf_dir), numstat(spark, sf_dir), sessions(spark, sf_dir))


def _links(spark, sf_dir):
    g = groups(spark, sf_dir)
    s = sessions(spark, sf_dir).where("is_root")
    return g, s, L.edges(g, s)


def link_edges(spark, sf_dir):
    return _links(spark, sf_dir)[2].select("repo_id", "id", "session_id", "tier").distinct()


def link_best(spark, sf_dir):
    b = L.best_links(_links(spark, sf_dir)[2])
    return b.select("repo_id", "id", "session_id", L.tier_name(F.col("tier")).alias("link_type"), L.tier_confidence(F.col("tier")).alias("link_confidence"))


def link_first_match(spark, sf_dir):
    return L.first_match(L.best_links(_links(spark, sf_dir)[2])).select("repo_id", "id", "session_id", "tier")


def link_orphans(spark, sf_dir):
    _, s, e = _links(spark, sf_dir)
    return s.join(e.select("repo_id", "session_id").distinct(), ["repo_id", "session_id"], "left_anti").select("repo_id", "session_id", F.lit(0.3).alias("confidence"))


def episodes(spark, sf_dir):
    g, _, _ = _links(spark, sf_dir)
    e = L.episodes(g, sessions(spark, sf_dir))
    # confidences are sums of tenths over counts; whole hundredths leave no ties
    return e.select("repo_id", "episode_id", "episode_type", F.concat_ws(",", F.array_sort("session_ids")).alias("session_ids"), F.concat_ws(",", F.transform("commit_group_ids", lambda x: x.cast("string"))).alias("groups"), F.col("added_lines").cast("long"), F.col("deleted_lines").cast("long"))


def sized_orders(spark, sf_dir) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(
        F.lit(1).alias("repo_id"), F.col("o_orderkey").alias("sha"), F.col("o_custkey").cast("string").alias("author"), F.lit(None).cast("string").alias("email"), F.to_date("o_orderdate").alias("date"), F.col("o_orderpriority").alias("subject")
    )
    li = table(spark, sf_dir, "lineitem").select(
        F.lit(1).alias("repo_id"), F.col("l_orderkey").alias("sha"), F.when(F.col("l_returnflag") == "R", "spec/a").otherwise("src/a").alias("path"), F.col("l_quantity").cast("long").alias("added"), F.col("l_linenumber").cast("long").alias("deleted")
    )
    return V.sizes(o, li)


def velocity_daily(spark, sf_dir):
    d = V.daily(sized_orders(spark, sf_dir), [])
    return d.select(F.date_format("date", "yyyy-MM-dd").alias("day"), "commits", "insertions", "deletions")


def velocity_author(spark, sf_dir):
    return V.by_author(sized_orders(spark, sf_dir), []).select("author", "commits", "insertions", "deletions", "active_days")


def velocity_peak(spark, sf_dir):
    d = V.daily(sized_orders(spark, sf_dir), ["author"])
    return V.peak_day(d, ["author"]).select("author", F.date_format("date", "yyyy-MM-dd").alias("day"), "insertions")


def velocity_totals(spark, sf_dir):
    v = V.velocity(sized_orders(spark, sf_dir), ["author"])
    return v.select("author", "commits", "insertions", "deletions", "test_insertions", "test_deletions", "date_range_days", "net_loc", "loc_per_day")


def author_scope(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_name").alias("author"), F.concat(F.col("c_mktsegment"), F.lit("@X.org")).alias("email"), "c_custkey")
    return V.scoped(c, ["customer#000000007", "CUSTOMER#000000012"], ["building@x.ORG"]).select("c_custkey", "author", "email")


def commit_discipline(spark, sf_dir):
    s = sized_orders(spark, sf_dir)
    return V.discipline(s, ["author"]).select("author", "total_commits", "atomic", "changed", "active_days", "avg_commit_size_lines", "net_loc_change")


def substring_group_match(spark, sf_dir):
    """Commits (part names tagged with their key) that name a pull request number anywhere after #, as a prefix of it."""
    p = table(spark, sf_dir, "part")
    c = p.select(F.lit(1).alias("repo_id"), F.col("p_partkey").cast("string").alias("sha"), F.concat(F.col("p_name"), F.lit(" #"), F.col("p_partkey").cast("string")).alias("subject"))
    s = p.select(F.lit(1).alias("repo_id"), F.col("p_partkey").alias("sess_pos"), F.col("p_partkey").alias("pr_number"), F.col("p_brand").alias("git_branch"))
    return G.pull_requests(c, s).select("pr_number", "branch", "sha")


def default_since(spark, sf_dir):
    e = events(spark, sf_dir)
    return e.groupBy("user_id").agg(F.unix_seconds(F.min("ts") - F.expr("INTERVAL 7 DAYS")).alias("since_s"))


_K = "CAST(json_extract_string(props, '$.k') AS BIGINT)"
_COMMITS = f"""c AS (SELECT user_id AS repo_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS log_pos, CAST(event_id AS VARCHAR) AS sha, event_id, ts, {_K} AS k,
 CASE WHEN {_K} % 5 = 0 THEN 'fix #' ELSE 'feat ' END || {_K} AS subject FROM events WHERE event_type = 'purchase')"""
_SESSIONS = f"""r AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session FROM (
  SELECT *, CASE WHEN lag(ts) OVER w IS NULL OR epoch_us(ts) - epoch_us(lag(ts) OVER w) > 5400000000 THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))),
s AS (SELECT user_id AS repo_id, CAST(session AS BIGINT) AS sess_pos, user_id || '-' || CAST(session AS BIGINT) AS session_id, min(ts) AS b, max(ts) AS e, min({_K}) AS k,
 CASE WHEN session % 10 = 0 THEN min({_K}) END AS pr_number, 'b' || (min({_K}) % 3) AS git_branch, list(CAST(event_id AS VARCHAR)) FILTER (event_type = 'purchase' AND event_id % 4 = 0) AS shas, session % 11 <> 0 AS is_root
 FROM r GROUP BY user_id, session)"""
_CLUSTERS = """k AS (SELECT *, sum(new) OVER (PARTITION BY repo_id ORDER BY ts, log_pos) AS cluster FROM (
 SELECT *, CASE WHEN lag(ts) OVER w IS NULL OR epoch_us(ts) - epoch_us(lag(ts) OVER w) > 7200000000 THEN 1 ELSE 0 END AS new FROM {0} WINDOW w AS (PARTITION BY repo_id ORDER BY ts, log_pos))),
m AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY repo_id, cluster ORDER BY ts, log_pos) AS place, count(*) OVER (PARTITION BY repo_id, cluster) AS size FROM k) WHERE size > 1)"""
_GROUPS = f"""WITH {_COMMITS}, {_SESSIONS},
pr AS (SELECT repo_id, pr_number, arg_min(git_branch, sess_pos) AS branch, min(sess_pos) AS place FROM s WHERE pr_number IS NOT NULL GROUP BY repo_id, pr_number),
pc AS (SELECT pr.repo_id, pr.pr_number, pr.branch, pr.place, c.sha FROM pr LEFT JOIN c ON c.repo_id = pr.repo_id AND contains(c.subject, '#' || pr.pr_number)),
u AS (SELECT * FROM c WHERE NOT EXISTS (SELECT 1 FROM pc WHERE pc.repo_id = c.repo_id AND pc.sha = c.sha)),
{_CLUSTERS.format("u")},
mem AS (SELECT repo_id, 1 AS kind, place, 'PR #' || pr_number AS title, branch, pr_number, sha FROM pc
 UNION ALL SELECT repo_id, 2, CAST(cluster AS BIGINT), first_value(size || ' commits: ' || subject) OVER (PARTITION BY repo_id, cluster ORDER BY place), NULL, NULL, sha FROM m
 UNION ALL SELECT repo_id, 3, log_pos, subject, NULL, NULL, sha FROM u WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.repo_id = u.repo_id AND m.sha = u.sha)),
g AS (SELECT mem.repo_id, kind, place, title, branch, pr_number, string_agg(mem.sha, ',' ORDER BY mem.sha) AS shas, list(mem.sha) FILTER (mem.sha IS NOT NULL) AS sl, min(c.ts) AS gb, max(c.ts) AS ge,
 CAST(coalesce(sum(CASE WHEN event_id % 3 <> 0 THEN k END), 0) AS BIGINT) AS insertions, CAST(coalesce(sum(CASE WHEN event_id % 3 <> 0 THEN k % 7 END), 0) AS BIGINT) AS deletions,
 count(*) FILTER (event_id % 3 <> 0) AS covered, count(mem.sha) AS size
 FROM mem LEFT JOIN c ON c.repo_id = mem.repo_id AND c.sha = mem.sha GROUP BY ALL),
groups AS (SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY kind, place) AS id FROM g)"""
_EDGES = f"""{_GROUPS},
rs AS (SELECT * FROM s WHERE is_root),
edges AS (SELECT g.repo_id, g.id, rs.session_id, rs.sess_pos, 1 AS tier FROM groups g JOIN rs ON rs.repo_id = g.repo_id AND rs.pr_number = g.pr_number
 UNION ALL SELECT DISTINCT g.repo_id, g.id, rs.session_id, rs.sess_pos, 2 FROM groups g JOIN rs ON rs.repo_id = g.repo_id AND list_has_any(g.sl, rs.shas)
 UNION ALL SELECT g.repo_id, g.id, rs.session_id, rs.sess_pos, 3 FROM groups g JOIN rs ON rs.repo_id = g.repo_id AND rs.git_branch = g.branch
 UNION ALL SELECT g.repo_id, g.id, rs.session_id, rs.sess_pos, 4 FROM groups g JOIN rs ON rs.repo_id = g.repo_id AND rs.b - INTERVAL 1 HOUR <= g.ge AND g.gb <= rs.e + INTERVAL 1 HOUR),
best AS (SELECT repo_id, id, session_id, sess_pos, min(tier) AS tier FROM edges GROUP BY ALL),
joined AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY repo_id, session_id ORDER BY id) AS n FROM best) WHERE n = 1)"""
_SIZED = """SELECT o.o_orderkey AS sha, CAST(o_custkey AS VARCHAR) AS author, CAST(o_orderdate AS DATE) AS date, o_orderpriority AS subject, CAST(coalesce(i, 0) AS BIGINT) AS i, CAST(coalesce(d, 0) AS BIGINT) AS d, CAST(coalesce(ti, 0) AS BIGINT) AS ti, CAST(coalesce(td, 0) AS BIGINT) AS td, coalesce(n, 0) AS n
 FROM orders o LEFT JOIN (SELECT l_orderkey, sum(CAST(l_quantity AS BIGINT)) AS i, sum(l_linenumber) AS d, sum(CASE WHEN l_returnflag = 'R' THEN CAST(l_quantity AS BIGINT) ELSE 0 END) AS ti, sum(CASE WHEN l_returnflag = 'R' THEN l_linenumber ELSE 0 END) AS td, count(*) AS n FROM lineitem GROUP BY 1) l ON l.l_orderkey = o.o_orderkey"""
_TYPE = "CASE WHEN lower(title) LIKE 'fix%' THEN 'bugfix' WHEN contains(lower(title), 'refactor') THEN 'refactor' WHEN lower(title) LIKE 'feat%' OR contains(lower(title), 'add') THEN 'feature' WHEN contains(lower(title), 'infra') OR contains(lower(title), 'ci') OR contains(lower(title), 'deploy') THEN 'infrastructure' ELSE 'implementation' END"

ORACLE_SQL = {
    "commit_clusters": f"WITH {_COMMITS}, {_CLUSTERS.format('c')} SELECT repo_id, sha, CAST(cluster AS BIGINT) AS cluster, CAST(place AS INT) AS place, size FROM m",
    "commit_groups": f"{_GROUPS} SELECT repo_id, id, ['pr', 'commit_cluster', 'single_commit'][kind] AS group_type, coalesce(shas, '') AS shas, title, branch, pr_number, insertions, deletions, CASE WHEN covered = 0 THEN 'none' WHEN covered = size THEN 'all' ELSE 'partial' END AS coverage FROM groups",
    "link_edges": f"{_EDGES} SELECT DISTINCT repo_id, id, session_id, tier FROM edges",
    "link_best": f"{_EDGES} SELECT repo_id, id, session_id, ['pr_match', 'sha_match', 'branch_match', 'timestamp_overlap'][tier] AS link_type, CAST([1.0, 0.9, 0.7, 0.5][tier] AS DOUBLE) AS link_confidence FROM best",
    "link_first_match": f"{_EDGES} SELECT repo_id, id, session_id, tier FROM joined",
    "link_orphans": f"{_EDGES} SELECT repo_id, session_id, CAST(0.3 AS DOUBLE) AS confidence FROM rs WHERE NOT EXISTS (SELECT 1 FROM edges e WHERE e.repo_id = rs.repo_id AND e.session_id = rs.session_id)",
    "episodes": f"""{_EDGES},
j AS (SELECT repo_id, id, string_agg(session_id, ',' ORDER BY session_id) AS sids FROM joined GROUP BY ALL),
e AS (SELECT g.repo_id, 1 AS kind, g.id AS place, {_TYPE} AS episode_type, coalesce(sids, '') AS session_ids, CAST(g.id AS VARCHAR) AS groups, insertions AS added_lines, deletions AS deleted_lines FROM groups g LEFT JOIN j ON j.repo_id = g.repo_id AND j.id = g.id
 UNION ALL SELECT repo_id, 2, sess_pos, 'session_only', session_id, '', 0, 0 FROM rs WHERE NOT EXISTS (SELECT 1 FROM joined x WHERE x.repo_id = rs.repo_id AND x.session_id = rs.session_id))
SELECT repo_id, row_number() OVER (PARTITION BY repo_id ORDER BY kind, place) AS episode_id, episode_type, session_ids, groups, added_lines, deleted_lines FROM e""",
    "velocity_daily": f"SELECT strftime(date, '%Y-%m-%d') AS day, count(*) AS commits, CAST(sum(i) AS BIGINT) AS insertions, CAST(sum(d) AS BIGINT) AS deletions FROM ({_SIZED}) GROUP BY date",
    "velocity_author": f"SELECT author, count(*) AS commits, CAST(sum(i) AS BIGINT) AS insertions, CAST(sum(d) AS BIGINT) AS deletions, count(DISTINCT date) AS active_days FROM ({_SIZED}) GROUP BY author",
    "velocity_peak": f"SELECT author, strftime(date, '%Y-%m-%d') AS day, insertions FROM (SELECT author, date, CAST(sum(i) AS BIGINT) AS insertions, row_number() OVER (PARTITION BY author ORDER BY sum(i) DESC, date) AS r FROM ({_SIZED}) GROUP BY author, date) WHERE r = 1",
    "velocity_totals": f"SELECT *, insertions - deletions AS net_loc, CAST(floor((insertions - deletions) / greatest(date_range_days, 1)) AS BIGINT) AS loc_per_day FROM (SELECT author, count(*) AS commits, CAST(sum(i) AS BIGINT) AS insertions, CAST(sum(d) AS BIGINT) AS deletions, CAST(sum(ti) AS BIGINT) AS test_insertions, CAST(sum(td) AS BIGINT) AS test_deletions, CAST(max(date) - min(date) + 1 AS BIGINT) AS date_range_days FROM ({_SIZED}) GROUP BY author)",
    "author_scope": "SELECT c_custkey, c_name AS author, c_mktsegment || '@X.org' AS email FROM customer WHERE lower(c_name) IN ('customer#000000007', 'customer#000000012') OR lower(c_mktsegment || '@X.org') = 'building@x.org'",
    "commit_discipline": f"SELECT author, total_commits, atomic, changed, active_days, CAST(floor(changed / total_commits + 0.5) AS BIGINT) AS avg_commit_size_lines, net_loc_change FROM (SELECT author, count(*) AS total_commits, count(*) FILTER (n <= 20) AS atomic, CAST(sum(i + d) AS BIGINT) AS changed, count(DISTINCT date) AS active_days, CAST(sum(i) - sum(d) AS BIGINT) AS net_loc_change FROM ({_SIZED}) GROUP BY author)",
    "substring_group_match": "SELECT a.p_partkey AS pr_number, a.p_brand AS branch, CAST(b.p_partkey AS VARCHAR) AS sha FROM part a JOIN part b ON contains(b.p_name || ' #' || b.p_partkey, '#' || a.p_partkey)",
    "default_since": "SELECT user_id, CAST(floor(epoch(min(ts) - INTERVAL 7 DAY)) AS BIGINT) AS since_s FROM events GROUP BY user_id",
}
QUERIES = {name: globals()[name] for name in ORACLE_SQL}
