"""Queries over scores, usage, batches and answers.

documents with labels stand for scored cells (source: episode, lang: axis) and classifier answers;
events for messages with a model and token counts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import decisions as D
from ..operators import rollup as R
from ..operators import sequence as S
from ..operators import signals as G
from .repository import table
from .streams import ORDER, events
from .texts import turns

MODELS = ("claude-haiku-4", "claude-sonnet-x", "claude-opus-9", "gpt-other", "claude-sonnet")


def cells(spark, sf_dir) -> DataFrame:
    """Whole scores 0 to 10 and confidences in quarters, so that sums are exact; some confidences are missing, some zero."""
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    conf = F.when(F.col("doc_id") % 5 != 0, ((F.col("doc_id") % 5) - 1) / 4.0)
    return d.select(F.col("source").alias("episode_id"), F.col("lang").alias("axis"), (F.col("n_chars") % 11).cast("double").alias("score"), conf.alias("confidence"))


def score_rollup(spark, sf_dir):
    m = R.axis_means(cells(spark, sf_dir), ["episode_id"], default=0.75)
    return m.select("episode_id", "axis", (F.col("score_sum") * 4).cast("long").alias("sum4"), (F.col("weight") * 4).cast("long").alias("weight4"), "contributions", F.floor(F.col("mean") * 100).cast("long").alias("mean_floor"))


def score_bands(spark, sf_dir):
    c = cells(spark, sf_dir)
    return c.groupBy("axis", R.band(F.col("score")).alias("band")).agg(F.count("*").alias("n"))


def lowest_cells(spark, sf_dir):
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    c = d.select("source", F.col("doc_id").alias("episode_id"), F.col("lang").alias("axis"), (F.col("n_chars") % 11).alias("score"))
    return R.lowest_cells(c, ["source"], 5).select("source", "episode_id", "axis", "score", "rank")


def messages(spark, sf_dir) -> DataFrame:
    e = events(spark, sf_dir).withColumn("k", F.get_json_object("props", "$.k").cast("long"))
    model = F.element_at(F.array(*map(F.lit, MODELS)), (F.col("k") % 5 + 1).cast("int"))
    usage = F.when(F.col("event_type") != "error", F.struct(F.col("k").alias("input_tokens"), (F.col("k") * 2).alias("output_tokens"), (F.col("k") * 10).alias("cache_read_input_tokens"), F.lit(1).cast("long").alias("cache_creation_input_tokens")))
    return e.select(F.col("user_id").alias("session_id"), F.col("event_id").alias("seq"), F.when(F.col("k") % 9 != 0, F.col("k") % 40).alias("msg_id"), model.alias("model"), usage.alias("usage"), (F.col("event_type") != "signup").alias("counted"))


def usage_dedupe(spark, sf_dir):
    return R.usage(messages(spark, sf_dir))


def cost_by_model_rollup(spark, sf_dir):
    t = R.model_totals(R.priced(R.usage(messages(spark, sf_dir))))
    return t.select("model", "input_tokens", "output_tokens", "cache_read_tokens", "cache_write_tokens", "is_total", F.round("cost", 4).alias("cost"))


def price_prefix_join(spark, sf_dir):
    prices = spark.createDataFrame([(k, *v) for k, v in R.PRICES.items()] + [("claude-sonnet-x", 1.0, 1.0, 1.0, 1.0)], "prefix string, p_in double, p_out double, p_read double, p_write double")
    u = messages(spark, sf_dir).groupBy("model").agg(F.count("*").alias("n"))
    return R.price_join(u, prices).select("model", "n", F.col("price.prefix").alias("prefix"), F.col("price.p_in").alias("p_in"))


def costly_sessions(spark, sf_dir):
    u = R.usage(messages(spark, sf_dir)).where("model != 'gpt-other'").withColumn("cost", F.col("input_tokens").cast("double"))
    return R.costly_sessions(u, 3)


def model_of_session(spark, sf_dir):
    """Primary model: most messages, ties by name."""
    return S.most_common(messages(spark, sf_dir), ["session_id"], "model").select("session_id", "model", "n")


def ledger(spark, sf_dir):
    e = events(spark, sf_dir).select(F.col("event_type").alias("stage"), F.pmod(F.col("user_id"), F.lit(3)).alias("model"), F.get_json_object("props", "$.k").cast("long").alias("total_tokens"), F.lit(1).alias("duration_s"))
    return R.ledger(e).select("stage", "model", "calls", "total_tokens")


def batch_packing(spark, sf_dir):
    t = S.index_events(turns(spark, sf_dir), ["session_id"], ["seq"], "position").select("session_id", "position", F.col("text").alias("agent_text"), F.col("text").alias("user_text"))
    b = D.batches(t, 2)
    return b.select("session_id", "batch", F.size("candidates").cast("long").alias("n"), F.md5("input_text").alias("prompt_md5"))


def plan_versions(spark, sf_dir):
    """Documents of one source and language as versions of a file: numbers, and the newest."""
    d = table(spark, sf_dir, "documents").withColumn("version", F.row_number().over(S.window(["source", "lang"], ["doc_id"])).cast("long"))
    return G.latest_plans(d.select(F.col("source").alias("session_id"), F.col("lang").alias("filename"), "version", F.col("doc_id").cast("string").alias("content")))


def lower_median(spark, sf_dir):
    """Median of medians, the lower middle."""
    m = events(spark, sf_dir).withColumn("v", F.floor("value").cast("long")).groupBy("user_id").agg(F.expr("percentile_disc(0.5) within group (order by v)").cast("long").alias("m"))
    return m.groupBy((F.col("user_id") % 5).alias("bucket")).agg(F.expr("percentile_disc(0.5) within group (order by m)").cast("long").alias("median"))


def floor_division(spark, sf_dir):
    from ..functions.numeric import floor_div, percent

    o = table(spark, sf_dir, "customer")
    n = F.floor("c_acctbal").cast("long")
    return o.select("c_custkey", floor_div(n, F.col("c_nationkey").cast("long")).alias("per_nation"), percent(F.col("c_nationkey"), F.lit(25)).alias("share"))


_K = "CAST(json_extract_string(props, '$.k') AS BIGINT)"
_CELLS = "SELECT source AS episode_id, lang AS axis, CAST(n_chars % 11 AS DOUBLE) AS score, CASE WHEN doc_id % 5 <> 0 THEN ((doc_id % 5) - 1) / CAST(4 AS DOUBLE) END AS confidence FROM documents JOIN labels USING (doc_id)"
_MODEL = "[" + ", ".join(f"'{m}'" for m in MODELS) + f"][CAST({_K} % 5 + 1 AS INT)]"
_USAGE = f"""SELECT session_id, model, count(*) AS messages, CAST(coalesce(sum(CASE WHEN u THEN k END), 0) AS BIGINT) AS input_tokens, CAST(coalesce(sum(CASE WHEN u THEN k * 2 END), 0) AS BIGINT) AS output_tokens, CAST(coalesce(sum(CASE WHEN u THEN k * 10 END), 0) AS BIGINT) AS cache_read_tokens, CAST(coalesce(sum(CASE WHEN u THEN 1 END), 0) AS BIGINT) AS cache_write_tokens, count(*) FILTER (u) AS assistant_turns
 FROM (SELECT *, row_number() OVER (PARTITION BY session_id, mid ORDER BY event_id) AS n FROM (SELECT user_id AS session_id, event_id, {_K} AS k, CASE WHEN {_K} % 9 <> 0 THEN {_K} % 40 END AS mid, {_MODEL} AS model, event_type <> 'error' AS u FROM events WHERE event_type <> 'signup')) WHERE mid IS NULL OR n = 1 GROUP BY session_id, model"""
_COST = "CASE WHEN model LIKE 'claude-haiku%' THEN (input_tokens * CAST(1 AS DOUBLE) + output_tokens * CAST(5 AS DOUBLE) + cache_read_tokens * CAST(0.1 AS DOUBLE) + cache_write_tokens * CAST(1.25 AS DOUBLE)) / 1e6 WHEN model LIKE 'claude-sonnet%' THEN (input_tokens * CAST(3 AS DOUBLE) + output_tokens * CAST(15 AS DOUBLE) + cache_read_tokens * CAST(0.3 AS DOUBLE) + cache_write_tokens * CAST(3.75 AS DOUBLE)) / 1e6 WHEN model LIKE 'claude-opus%' THEN (input_tokens * CAST(5 AS DOUBLE) + output_tokens * CAST(25 AS DOUBLE) + cache_read_tokens * CAST(0.5 AS DOUBLE) + cache_write_tokens * CAST(6.25 AS DOUBLE)) / 1e6 END"

ORACLE_SQL = {
    "score_rollup": f"SELECT episode_id, axis, CAST(s * 4 AS BIGINT) AS sum4, CAST(w * 4 AS BIGINT) AS weight4, n AS contributions, CAST(floor(s / w * 100) AS BIGINT) AS mean_floor FROM (SELECT episode_id, axis, sum(score * coalesce(confidence, CAST(0.75 AS DOUBLE))) AS s, sum(coalesce(confidence, CAST(0.75 AS DOUBLE))) AS w, count(*) AS n FROM ({_CELLS}) GROUP BY ALL) WHERE w > 0",
    "score_bands": f"SELECT axis, CASE WHEN score < 4 THEN 'WEAK' WHEN score < 6 THEN 'LIMITED' WHEN score < 8 THEN 'STRONG' WHEN score < 9 THEN 'ELITE' ELSE 'EXEMPLAR' END AS band, count(*) AS n FROM ({_CELLS}) GROUP BY ALL",
    "lowest_cells": "SELECT source, doc_id AS episode_id, lang AS axis, score, r AS rank FROM (SELECT source, doc_id, lang, n_chars % 11 AS score, row_number() OVER (PARTITION BY source ORDER BY n_chars % 11, doc_id, lang) AS r FROM documents JOIN labels USING (doc_id)) WHERE r <= 5",
    "usage_dedupe": _USAGE,
    "cost_by_model_rollup": f"SELECT model, CAST(sum(input_tokens) AS BIGINT) AS input_tokens, CAST(sum(output_tokens) AS BIGINT) AS output_tokens, CAST(sum(cache_read_tokens) AS BIGINT) AS cache_read_tokens, CAST(sum(cache_write_tokens) AS BIGINT) AS cache_write_tokens, CAST(grouping(model) AS INT) AS is_total, round(sum({_COST}), 4) AS cost FROM ({_USAGE}) GROUP BY ROLLUP (model)",
    "price_prefix_join": f"SELECT model, n, CASE WHEN model LIKE 'claude-sonnet-x%' THEN 'claude-sonnet-x' WHEN model LIKE 'claude-haiku%' THEN 'claude-haiku' WHEN model LIKE 'claude-sonnet%' THEN 'claude-sonnet' WHEN model LIKE 'claude-opus%' THEN 'claude-opus' END AS prefix, CAST(CASE WHEN model LIKE 'claude-sonnet-x%' THEN 1 WHEN model LIKE 'claude-haiku%' THEN 1 WHEN model LIKE 'claude-sonnet%' THEN 3 WHEN model LIKE 'claude-opus%' THEN 5 END AS DOUBLE) AS p_in FROM (SELECT {_MODEL} AS model, count(*) AS n FROM events GROUP BY 1)",
    "costly_sessions": f"SELECT session_id, CAST(sum(input_tokens) AS DOUBLE) AS cost FROM ({_USAGE}) WHERE model <> 'gpt-other' GROUP BY session_id ORDER BY cost DESC, session_id LIMIT 3",
    "model_of_session": f"SELECT session_id, model, n FROM (SELECT user_id AS session_id, {_MODEL} AS model, count(*) AS n, row_number() OVER (PARTITION BY user_id ORDER BY count(*) DESC, {_MODEL}) AS r FROM events GROUP BY user_id, {_MODEL}) WHERE r = 1",
    "ledger": f"SELECT event_type AS stage, user_id % 3 AS model, count(*) AS calls, CAST(sum({_K}) AS BIGINT) AS total_tokens FROM events GROUP BY ALL",
    "batch_packing": "SELECT session_id, b AS batch, count(*) AS n, md5('Classify these ' || count(*) || ' exchanges:' || chr(10) || chr(10) || string_agg('Exchange ' || (i % 2) || ':' || chr(10) || 'Agent: ' || t || chr(10) || 'Developer: ' || t || chr(10), chr(10) ORDER BY i)) AS prompt_md5 FROM (SELECT session_id, i, i // 2 AS b, CASE WHEN length(text) > 2000 THEN left(text, 1997) || '...' ELSE text END AS t FROM (SELECT conv_id AS session_id, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i FROM conversations WHERE role = 'user')) GROUP BY ALL",
    "plan_versions": "SELECT source AS session_id, lang AS filename, count(*) AS version_count, CAST(max(doc_id) AS VARCHAR) AS content FROM documents GROUP BY ALL",
    "lower_median": "SELECT user_id % 5 AS bucket, CAST(quantile_disc(m, 0.5) AS BIGINT) AS median FROM (SELECT user_id, quantile_disc(CAST(floor(value) AS BIGINT), 0.5) AS m FROM events GROUP BY user_id) GROUP BY 1",
    "floor_division": "SELECT c_custkey, CASE WHEN c_nationkey <> 0 THEN CAST(floor(CAST(floor(c_acctbal) AS BIGINT) / CAST(c_nationkey AS DOUBLE)) AS BIGINT) END AS per_nation, CAST(c_nationkey * 4 AS BIGINT) AS share FROM customer",
}
QUERIES = {name: globals()[name] for name in ORACLE_SQL}
