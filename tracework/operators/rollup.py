"""Score rollups, bands, usage and cost."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import sequence as S
from .decisions import first_of

# Axes, band cuts, default confidence, list prices in dollars per million tokens (input, output, cache read, cache write).
AXES = ("execution_leverage", "steering", "engineering_quality", "product_thinking", "planning")
BANDS = (("WEAK", 4.0), ("LIMITED", 6.0), ("STRONG", 8.0), ("ELITE", 9.0))
TOP_BAND, DEFAULT_CONFIDENCE = "EXEMPLAR", 0.8
PRICES = {"claude-haiku": (1.00, 5.00, 0.10, 1.25), "claude-sonnet": (3.00, 15.00, 0.30, 3.75), "claude-opus": (5.00, 25.00, 0.50, 6.25), "claude-fable": (10.00, 50.00, 1.00, 12.50)}
TOKEN_KINDS = ("input_tokens", "output_tokens", "cache_read_tokens", "cache_write_tokens")


def band(score: Column) -> Column:
    """Cut points belong to the band above; below zero counts as the lowest."""
    return F.when(score.isNotNull(), first_of([(score < cut, name) for name, cut in BANDS], TOP_BAND))


def axis_means(cells: DataFrame, keys: list[str], default: float = DEFAULT_CONFIDENCE) -> DataFrame:
    """(keys, axis, score_sum, weight, mean): confidence-weighted; a missing confidence has the default, an explicit 0 no weight; axes without weight are left out."""
    w = F.coalesce("confidence", F.lit(default))
    m = cells.where("score is not null").groupBy(*keys, "axis").agg(F.sum(F.col("score") * w).alias("score_sum"), F.sum(w).alias("weight"), F.count("*").alias("contributions"))
    return m.where("weight > 0").withColumn("mean", F.col("score_sum") / F.col("weight"))


def rollup(cells: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, axes, overall, band): axis means and their mean, each rounded half to even on its exact value."""
    from ..functions.numeric import round_even

    m = axis_means(cells, keys).withColumn("mean", round_even(F.col("mean"), 2))
    o = m.groupBy(*keys).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("axis", "mean")))).alias("axes"), F.avg("mean").alias("overall"))
    return o.withColumn("overall", round_even(F.col("overall"), 2)).withColumn("band", band(F.col("overall")))


def lowest_cells(cells: DataFrame, keys: list[str], k: int = 5) -> DataFrame:
    """The ``k`` lowest (score, episode, axis) cells of each key."""
    return S.top_by(cells.where("score is not null"), keys, ["score", "episode_id", "axis"], k)


def usage(messages: DataFrame) -> DataFrame:
    """(session_id, model, messages, tokens, assistant_turns): a message id counts once a session, at its first entry; entries without an id all count.

    ``messages``: session_id, seq, msg_id, model, usage (struct or null), counted (not of another agent's side chain).
    """
    m = messages.where("counted").withColumn("__n", F.row_number().over(S.window(["session_id", "msg_id"], ["seq"]))).where("msg_id is null or __n = 1")
    tokens = {"input_tokens": "input_tokens", "output_tokens": "output_tokens", "cache_read_tokens": "cache_read_input_tokens", "cache_write_tokens": "cache_creation_input_tokens"}
    return m.groupBy("session_id", F.coalesce("model", F.lit("unknown")).alias("model")).agg(
        F.count("*").alias("messages"), *[F.coalesce(F.sum(F.coalesce(f"usage.{src}", F.lit(0))), F.lit(0)).alias(name) for name, src in tokens.items()], F.count("usage").alias("assistant_turns")
    )


def priced(used: DataFrame, prices: dict[str, tuple[float, ...]] | None = None, model: str = "model") -> DataFrame:
    """Adds ``cost`` by the longest price prefix that the model starts with; null without one."""
    table = prices or PRICES
    cost = lambda p: reduce(lambda a, b: a + b, (F.col(k) * F.lit(float(x)) for k, x in zip(TOKEN_KINDS, p, strict=True))) / F.lit(1e6)
    longest = sorted(table, key=lambda p: (-len(p), p))
    return used.withColumn("cost", first_of([(F.col(model).startswith(p), cost(table[p])) for p in longest], F.lit(None).cast("double")))


def price_join(used: DataFrame, prices: DataFrame, model: str = "model") -> DataFrame:
    """Like :func:`priced` for a price table (prefix, p_in, p_out, p_read, p_write) of any size: prefixes of the distinct models are exploded, so it is an equi-join."""
    names = used.select(F.col(model)).distinct()
    heads = names.select(model, F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.length(model), F.lit(1))), lambda n: F.left(F.col(model), n))).alias("prefix"))
    best = heads.join(prices, "prefix").groupBy(model).agg(F.max_by(F.struct("prefix", "p_in", "p_out", "p_read", "p_write"), F.length("prefix")).alias("price"))
    return used.join(best, model, "left")


def model_totals(used: DataFrame) -> DataFrame:
    """Totals by model and, with a null model, over all."""
    return used.rollup("model").agg(*[F.sum(k).alias(k) for k in TOKEN_KINDS], F.sum("cost").alias("cost"), F.grouping("model").cast("int").alias("is_total"))


def costly_sessions(used: DataFrame, k: int = 3) -> DataFrame:
    """The ``k`` dearest sessions among those whose models all have a price."""
    c = used.groupBy("session_id").agg(F.sum("cost").alias("cost"), F.count_if(F.col("cost").isNull()).alias("unpriced")).where("unpriced = 0")
    return c.orderBy(F.desc("cost"), "session_id").limit(k).drop("unpriced")


def ledger(calls: DataFrame) -> DataFrame:
    return calls.groupBy("stage", "model").agg(F.count("*").alias("calls"), F.sum("total_tokens").alias("total_tokens"), F.sum("duration_s").alias("duration_s"))
