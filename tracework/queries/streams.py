"""Queries over the event stream: a user's events stand for a session's.

signup opens (a proposal, a dispatch), view answers (a directive, a return), click is a command,
error an error, purchase a commit; ``value`` above 50 passes a test.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import decisions as D
from ..operators import scans
from ..operators import sequence as S
from ..operators import steering

KEYS, ORDER = ["user_id"], ["ts", "event_id"]


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))


def indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.index_events(events(spark, sf_dir), KEYS, ORDER)


def gap_sessions(spark, sf_dir):
    runs = S.gap_sessions(events(spark, sf_dir), KEYS, "ts", 90 * 60, ORDER)
    return runs.groupBy("user_id", "session").agg(F.count("*").alias("n_events"), F.unix_seconds(F.min("ts")).alias("start_s"), F.unix_seconds(F.max("ts")).alias("end_s"))


def active_windows(spark, sf_dir):
    w = S.active_windows(events(spark, sf_dir), KEYS, "ts")
    return w.select("user_id", "window", F.unix_seconds("start").alias("start_s"), F.unix_seconds("end").alias("end_s"), "events")


def active_duration(spark, sf_dir):
    e = events(spark, sf_dir).withColumn("ts", F.date_trunc("second", "ts"))
    return S.active_seconds(e, KEYS, "ts").select("user_id", F.col("seconds").cast("long").alias("active_s"))


def event_index_cap(spark, sf_dir):
    capped = S.cap_events(events(spark, sf_dir), KEYS, ORDER, F.col("event_type") == "purchase", 30)
    return capped.select("user_id", "event_id", "event_type", "index")


def recovery_distance(spark, sf_dir):
    kind = F.col("event_type")
    fixed = ((kind == "view") & (F.col("value") > 50)) | (kind == "purchase")
    e = indexed(spark, sf_dir).withColumn("next", S.next_index(KEYS, ORDER, fixed)).where("event_type = 'error' and next is not null")
    return e.groupBy("user_id").agg(F.count("*").alias("n_recovered"), F.round(F.median(F.col("next") - F.col("index")), 1).alias("median_distance"))


def pair_within_window(spark, sf_dir):
    e = S.follow_up(indexed(spark, sf_dir), KEYS, ORDER, F.col("event_type") == "signup", F.col("event_type") == "view", F.col("event_id"))
    return e.where("event_type = 'signup'").select("user_id", F.col("event_id").alias("proposal_id"), "index", F.col("reply").alias("response_id"))


def nearest_context(spark, sf_dir):
    e = indexed(spark, sf_dir)
    e = e.withColumn("context_id", S.nearest(e, KEYS, ORDER, F.col("event_type") == "click", F.col("event_id"))).withColumn(
        "amplified", S.near_any(KEYS, ORDER, (F.col("event_type") == "error") & (F.col("value") > 50))
    )
    return e.where("event_type = 'view'").select("user_id", "event_id", "context_id", "amplified")


def segment_outcomes(spark, sf_dir):
    e, kind, good = indexed(spark, sf_dir), F.col("event_type"), (F.col("value") > 50).cast("long")
    sums = D.segment_sums(e, KEYS, ORDER, kind == "signup", kind == "view", kind == "error", kind == "purchase", (kind == "click") & (F.col("value") > 99), good, 1 - good)
    return sums.select("user_id", F.col("event_index").alias("proposal"), *D.outcome_columns())


def dispatch_intervals(spark, sf_dir) -> DataFrame:
    """First dispatch (signup) and first return (view) of each (user, k mod 40), end not before start."""
    e = events(spark, sf_dir).withColumn("tool", F.pmod(F.get_json_object("props", "$.k").cast("long"), F.lit(40)))
    d = S.first_by(e.where("event_type = 'signup'"), ["user_id", "tool"], ORDER).select("user_id", "tool", F.col("ts").alias("start"), F.col("event_id").alias("dispatch_id"))
    r = S.first_by(e.where("event_type = 'view'"), ["user_id", "tool"], ORDER).select("user_id", "tool", F.col("ts").alias("end"), F.col("event_id").alias("return_id"))
    return d.join(r, ["user_id", "tool"]).where("end >= start")


def max_concurrency(spark, sf_dir):
    return S.max_concurrency(dispatch_intervals(spark, sf_dir), KEYS, "start", "end")


def peak_hours_circular(spark, sf_dir):
    p = events(spark, sf_dir).where("event_type = 'purchase'").withColumn("hour", F.hour("ts"))
    return S.busiest_hours(p, KEYS, "hour").select("user_id", F.col("start").alias("start_hour"), F.col("n").alias("n_in_window"), "peak_hour", "peak_n")


def ship_day(spark, sf_dir):
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").withColumn("weekday", F.date_format("o_orderdate", "EEEE"))
    return S.most_common(o, ["o_custkey"], "weekday").select("o_custkey", "weekday", F.col("n").alias("n_commits"))


def ordered_session(spark, sf_dir):
    """Ordered collection of each user's event kinds."""
    e = indexed(spark, sf_dir)
    return e.groupBy("user_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("index", "event_type"))), lambda x: x.event_type), ">").alias("path"))


def site_sessions(spark, sf_dir):
    """All events as one stream: its runs without a pause of more than 20 seconds."""
    runs = S.gap_sessions(events(spark, sf_dir), [], "ts", 20, ORDER, spread=True)
    return runs.groupBy("session").agg(F.count("*").alias("n_events"), F.unix_seconds(F.min("ts")).alias("start_s"), F.unix_seconds(F.max("ts")).alias("end_s"))


def site_states(spark, sf_dir):
    """All events as one stream: what each error finds before and after it, as a state machine would hold it."""
    kind = F.col("event_type")
    s = scans.Stream(events(spark, sf_dir), [], ORDER, spread=True).scan(
        n_before=scans.total(F.lit(1), own=False), spent=scans.total(F.when(kind == "purchase", F.floor("value").cast("long"))),
        last_purchase=scans.last(F.when(kind == "purchase", F.col("event_id"))), next_signup=scans.following(F.when(kind == "signup", F.col("event_id"))),
    )
    return s.rows().where("event_type = 'error'").select("event_id", F.col("n_before").cast("long").alias("n_before"), "spent", "last_purchase", "next_signup")


def site_concurrency(spark, sf_dir):
    """Most dispatches open at once over all users, and most order lines on their way at once over all orders."""
    d = scans.peak(dispatch_intervals(spark, sf_dir), [], "start", "end").select(F.lit("dispatches").alias("what"), "peak")
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_shipdate", F.date_add("l_shipdate", (F.col("l_quantity") % 30).cast("int")).alias("arrives"))
    return d.unionByName(scans.peak(lines, [], "l_shipdate", "arrives").select(F.lit("lines").alias("what"), "peak"))


def sessions_since(spark, sf_dir):
    """Customers as sessions: those whose last event is no older than a day in the second half, and those without any event."""
    last = events(spark, sf_dir).groupBy(F.col("user_id").alias("c_custkey")).agg(F.max("ts").alias("last"))
    c = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey").join(last, "c_custkey", "left")
    middle = F.date_trunc("day", F.timestamp_seconds((F.unix_seconds(F.min("last")) + F.unix_seconds(F.max("last"))) / 2))
    cutoff = c.agg(middle.alias("cutoff"))
    return steering.since(c.join(F.broadcast(cutoff)), F.col("last"), F.col("cutoff")).select("c_custkey", F.unix_seconds("last").alias("last_s"))


def site_medians(spark, sf_dir):
    """The middle values of all events and of each kind, few and large groups; no group is held in one place."""
    e = events(spark, sf_dir)
    kinds = scans.medians(e, ["event_type"], "value").select(F.col("event_type").alias("what"), "n", "low", "high")
    return kinds.unionByName(scans.medians(e, [], "value").select(F.lit("all").alias("what"), "n", "low", "high"))


_IDX = "SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i FROM events"
_PAIR = """SELECT *, CASE WHEN k1 = 'signup' THEN NULL WHEN k1 = 'view' THEN e1 WHEN k2 = 'signup' THEN NULL WHEN k2 = 'view' THEN e2 WHEN k3 = 'signup' THEN NULL WHEN k3 = 'view' THEN e3 END AS response_id
FROM (SELECT *, lead(event_type, 1) OVER w AS k1, lead(event_type, 2) OVER w AS k2, lead(event_type, 3) OVER w AS k3,
             lead(event_id, 1) OVER w AS e1, lead(event_id, 2) OVER w AS e2, lead(event_id, 3) OVER w AS e3,
             row_number() OVER w - 1 AS i
      FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) WHERE event_type = 'signup'"""
_K = "CAST(json_extract_string(props, '$.k') AS BIGINT)"
_DISPATCH = f"""SELECT d.user_id, d.tool, d.ts AS s, r.ts AS e, d.event_id AS dispatch_id, r.event_id AS return_id FROM
 (SELECT *, {_K} % 40 AS tool, row_number() OVER (PARTITION BY user_id, {_K} % 40 ORDER BY ts, event_id) AS n FROM events WHERE event_type = 'signup') d
 JOIN (SELECT *, {_K} % 40 AS tool, row_number() OVER (PARTITION BY user_id, {_K} % 40 ORDER BY ts, event_id) AS n FROM events WHERE event_type = 'view') r
 ON d.user_id = r.user_id AND d.tool = r.tool AND d.n = 1 AND r.n = 1 AND r.ts >= d.ts"""


def _gap(seconds: int, name: str) -> str:
    return f"""SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS {name} FROM (
  SELECT *, CASE WHEN lag(ts) OVER w IS NULL OR epoch_us(ts) - epoch_us(lag(ts) OVER w) > {seconds * 1000000} THEN 1 ELSE 0 END AS new
  FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))"""


ORACLE_SQL = {
    "gap_sessions": f"SELECT user_id, CAST(s AS BIGINT) AS session, count(*) AS n_events, CAST(floor(epoch(min(ts))) AS BIGINT) AS start_s, CAST(floor(epoch(max(ts))) AS BIGINT) AS end_s FROM ({_gap(5400, 's')}) GROUP BY user_id, s",
    "active_windows": f'SELECT user_id, CAST(s AS BIGINT) AS "window", CAST(floor(epoch(min(ts))) AS BIGINT) AS start_s, CAST(floor(epoch(max(ts))) AS BIGINT) AS end_s, count(*) AS events FROM ({_gap(900, "s")}) GROUP BY user_id, s',
    "active_duration": "SELECT user_id, CAST(sum(CASE WHEN gap <= 5400 THEN gap ELSE 0 END) AS BIGINT) AS active_s FROM (SELECT user_id, CAST(epoch(t) - epoch(lag(t) OVER (PARTITION BY user_id ORDER BY t)) AS BIGINT) AS gap FROM (SELECT user_id, date_trunc('second', ts) AS t FROM events)) GROUP BY user_id",
    "event_index_cap": f'SELECT user_id, event_id, event_type, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS BIGINT) AS "index" FROM ({_IDX}) WHERE i < 30 OR event_type = \'purchase\'',
    "recovery_distance": f"SELECT user_id, count(*) AS n_recovered, round(median(n - i), 1) AS median_distance FROM (SELECT *, first_value(CASE WHEN (event_type = 'view' AND value > 50) OR event_type = 'purchase' THEN i END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY i ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS n FROM ({_IDX})) WHERE event_type = 'error' AND n IS NOT NULL GROUP BY user_id",
    "pair_within_window": f'SELECT user_id, event_id AS proposal_id, i AS "index", response_id FROM ({_PAIR})',
    "nearest_context": """SELECT user_id, event_id, context_id, amplified FROM (SELECT *, coalesce(last_value(CASE WHEN event_type = 'click' THEN event_id END IGNORE NULLS) OVER (w ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), first_value(CASE WHEN event_type = 'click' THEN event_id END IGNORE NULLS) OVER (w ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING)) AS context_id,
 coalesce(bool_or(event_type = 'error' AND value > 50) OVER (w ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING), FALSE) AS amplified FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) WHERE event_type = 'view'""",
    "segment_outcomes": f"""WITH x AS ({_IDX}), p AS (SELECT user_id, i AS proposal, lead(i) OVER (PARTITION BY user_id ORDER BY i) AS nxt FROM x WHERE event_type = 'signup'),
s AS (SELECT p.user_id, proposal, count(*) FILTER (event_type = 'view') AS t, count(*) FILTER (event_type = 'error') AS e, count(*) FILTER (event_type = 'purchase') AS c,
 coalesce(bool_or(event_type = 'click' AND value > 99), FALSE) AS r, arg_max(value > 50, x.i) FILTER (event_type = 'view') AS ok,
 count(*) FILTER (event_type = 'view' AND value > 50) AS p, count(*) FILTER (event_type = 'view' AND NOT value > 50) AS f
 FROM p JOIN x ON x.user_id = p.user_id AND x.i > p.proposal AND (p.nxt IS NULL OR x.i < p.nxt) GROUP BY p.user_id, proposal),
n AS (SELECT *, t + CAST(e > 0 AS INT) + CAST(c > 0 AS INT) + CAST(r AS INT) AS n FROM s)
SELECT user_id, proposal,
 CASE WHEN r THEN 'negative' WHEN ok THEN 'positive' WHEN NOT ok THEN 'negative' WHEN c > 0 AND f = 0 THEN 'positive' WHEN e > 0 THEN 'mixed' ELSE 'neutral' END AS signal,
 CASE n WHEN 0 THEN CAST(0.3 AS DOUBLE) WHEN 1 THEN CAST(0.5 AS DOUBLE) WHEN 2 THEN CAST(0.7 AS DOUBLE) ELSE CAST(0.9 AS DOUBLE) END AS confidence,
 coalesce(nullif(concat_ws('. ', CASE WHEN t > 0 THEN t || ' test run(s): ' || p || ' passed, ' || f || ' failed' END, CASE WHEN e > 0 THEN e || ' error(s) encountered' END, CASE WHEN c > 0 THEN c || ' commit(s) made' END, CASE WHEN r THEN 'User reversed direction' END), ''), 'No signal events after decision') AS evidence
FROM n""",
    "site_sessions": "SELECT CAST(s AS BIGINT) AS session, count(*) AS n_events, CAST(floor(epoch(min(ts))) AS BIGINT) AS start_s, CAST(floor(epoch(max(ts))) AS BIGINT) AS end_s FROM (SELECT *, sum(new) OVER (ORDER BY ts, event_id) AS s FROM (SELECT *, CASE WHEN lag(ts) OVER w IS NULL OR epoch_us(ts) - epoch_us(lag(ts) OVER w) > 20000000 THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (ORDER BY ts, event_id))) GROUP BY s",
    "site_states": "SELECT event_id, CAST(row_number() OVER w - 1 AS BIGINT) AS n_before, CAST(coalesce(sum(CASE WHEN event_type = 'purchase' THEN CAST(floor(value) AS BIGINT) END) OVER w, 0) AS BIGINT) AS spent, last_value(CASE WHEN event_type = 'purchase' THEN event_id END IGNORE NULLS) OVER w AS last_purchase, first_value(CASE WHEN event_type = 'signup' THEN event_id END IGNORE NULLS) OVER (ORDER BY ts, event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS next_signup FROM events WINDOW w AS (ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) QUALIFY event_type = 'error'",
    "site_concurrency": f"SELECT what, CAST(max(o) AS BIGINT) AS peak FROM (SELECT what, sum(d) OVER (PARTITION BY what ORDER BY tt, d ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS o FROM (SELECT 'dispatches' AS what, epoch_us(s) AS tt, 1 AS d FROM ({_DISPATCH}) UNION ALL SELECT 'dispatches', epoch_us(e), -1 FROM ({_DISPATCH}) UNION ALL SELECT 'lines', epoch_us(l_shipdate), 1 FROM lineitem UNION ALL SELECT 'lines', epoch_us(l_shipdate) + CAST(l_quantity AS BIGINT) % 30 * 86400000000, -1 FROM lineitem)) GROUP BY what",
    "sessions_since": "WITH l AS (SELECT user_id, max(ts) AS last FROM events GROUP BY user_id), c AS (SELECT c_custkey, last FROM customer LEFT JOIN l ON user_id = c_custkey), m AS (SELECT date_trunc('day', make_timestamp(CAST(floor((floor(epoch(min(last))) + floor(epoch(max(last)))) / 2) AS BIGINT) * 1000000)) AS cutoff FROM c) SELECT c_custkey, CAST(floor(epoch(last)) AS BIGINT) AS last_s FROM c, m WHERE last IS NULL OR last >= cutoff",
    "site_medians": "SELECT what, count(*) AS n, min(value) FILTER (r IN ((m + 1) // 2, m // 2 + 1)) AS low, max(value) FILTER (r IN ((m + 1) // 2, m // 2 + 1)) AS high FROM (SELECT *, row_number() OVER (PARTITION BY what ORDER BY value) AS r, count(*) OVER (PARTITION BY what) AS m FROM (SELECT event_type AS what, value FROM events UNION ALL SELECT 'all', value FROM events) WHERE value IS NOT NULL) GROUP BY what",
    "max_concurrency": f"SELECT user_id, CAST(max(o) AS BIGINT) AS peak FROM (SELECT user_id, sum(d) OVER (PARTITION BY user_id ORDER BY tt, d ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS o FROM (SELECT user_id, s AS tt, 1 AS d FROM ({_DISPATCH}) UNION ALL SELECT user_id, e, -1 FROM ({_DISPATCH}))) GROUP BY user_id",
    "peak_hours_circular": """WITH h AS (SELECT user_id, CAST(hour(ts) AS INT) AS h, count(*) AS n FROM events WHERE event_type = 'purchase' GROUP BY ALL),
w AS (SELECT u.user_id, CAST(s.s AS INT) AS s, (SELECT sum(h.n) FROM h WHERE h.user_id = u.user_id AND (h.h - s.s + 24) % 24 < 4) AS n FROM (SELECT DISTINCT user_id FROM h) u, (SELECT unnest(range(24)) AS s) s)
SELECT w.user_id, s AS start_hour, CAST(w.n AS BIGINT) AS n_in_window, p.h AS peak_hour, p.n AS peak_n FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC NULLS LAST, s) AS r FROM w) w
JOIN (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, h) AS r FROM h) p ON p.user_id = w.user_id AND p.r = 1 WHERE w.r = 1""",
    "ship_day": "SELECT o_custkey, weekday, n AS n_commits FROM (SELECT o_custkey, dayname(o_orderdate) AS weekday, count(*) AS n, row_number() OVER (PARTITION BY o_custkey ORDER BY count(*) DESC, dayname(o_orderdate)) AS r FROM orders GROUP BY o_custkey, dayname(o_orderdate)) WHERE r = 1",
    "ordered_session": f"SELECT user_id, string_agg(event_type, '>' ORDER BY i) AS path FROM ({_IDX}) GROUP BY user_id",
}
QUERIES = {name: globals()[name] for name in ORACLE_SQL}
