"""Preference formatting of chosen and rejected conversations; DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The turn template.
OPEN, MIDDLE, CLOSE = "<|im_start|>", "\n", "<|im_end|>\n"


def render(turns: Column) -> Column:
    """Turns as text, in order."""
    return F.array_join(F.transform(turns, lambda t: F.concat(F.lit(OPEN), t.role, F.lit(MIDDLE), t.text, F.lit(CLOSE))), "")


def mask(turns: Column, before: Column) -> Column:
    """``begin:end`` code point spans of what a model should learn in the rendered turns: assistants' texts with their end marks. ``before``: length of what was rendered before them."""

    def span(t: Column) -> Column:
        end = t["at"] - before
        return F.concat_ws(":", (end - len(CLOSE) - F.length(t.text)).cast("string"), (end - 1).cast("string"))

    return F.array_join(F.transform(F.filter(turns, lambda t: t.role == "assistant"), span), ",")


def turn_rows(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) with null roles and texts empty."""
    text = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(c) for c in ("role", "text")]
    return rows.select(F.col("`conv_id`").cast("long").alias("conv_id"), F.col("`turn`").cast("long").alias("turn"), *text)


def _length(role: Column, text: Column) -> Column:
    return (F.length(role) + F.length(text) + len(OPEN) + len(MIDDLE) + len(CLOSE)).cast("long")


def conversations(turns: DataFrame) -> DataFrame:
    """(conv_id, turns: array of (role, text, at)) of turn rows, in order of turn, role and text; ``at`` is the rendered length up to the turn's end. Rows without an id are left out."""
    w = Window.partitionBy("conv_id").orderBy("turn", "role", "text").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = turns.where("conv_id is not null").withColumn("at", F.sum(_length(F.col("role"), F.col("text"))).over(w))
    grouped = placed.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "at", "role", "text"))).alias("turns"))
    return grouped.withColumn("turns", F.transform("turns", lambda t: F.struct(t.role.alias("role"), t.text.alias("text"), t["at"].alias("at"))))


def format_preferences(pairs: DataFrame) -> DataFrame:
    """pairs (pair_id, chosen, rejected: arrays of (role, text, at)) to prompt and masked completions.

    The prompt is the longest common turn prefix, rendered once; each completion is the rest of its
    conversation, with the spans to learn in it. A missing conversation counts as one without turns:
    the prompt is empty and ``paired`` false. Equal conversations give two empty completions.
    """
    none = F.array().cast("array<struct<role:string,text:string,at:long>>")
    p = pairs.select("*", F.coalesce("chosen", none).alias("_c"), F.coalesce("rejected", none).alias("_r"))
    same = F.zip_with("_c", "_r", lambda a, b: F.coalesce((a.role == b.role) & (a.text == b.text), F.lit(False)))
    shared = F.least(F.coalesce(F.nullif(F.array_position(same, False), F.lit(0)) - 1, F.size("_c")), F.size("_c"), F.size("_r")).cast("int")
    p = p.withColumn("_n", shared).withColumn("_before", F.coalesce(F.get("_c", F.col("_n") - 1)["at"], F.lit(0)))
    rest = {k: F.slice(k, F.col("_n") + 1, F.greatest(F.size(k), F.lit(1))) for k in ("_c", "_r")}
    return p.select(
        "pair_id", (F.col("chosen").isNotNull() & F.col("rejected").isNotNull()).alias("paired"), F.col("_n").cast("long").alias("n_prompt_turns"),
        render(F.slice("_c", 1, F.col("_n"))).alias("prompt"),
        render(rest["_c"]).alias("chosen_completion"), mask(rest["_c"], F.col("_before")).alias("chosen_mask"),
        render(rest["_r"]).alias("rejected_completion"), mask(rest["_r"], F.col("_before")).alias("rejected_mask"),
    )


def preferences(rows: DataFrame) -> DataFrame:
    """Conversations 2n and 2n + 1 are the chosen and the rejected answer of pair n; see :func:`format_preferences`.

    ``rows``: conv_id, turn, role, text in any order; other columns are ignored. A row without a
    conversation belongs to none: it comes back as a pair without id, its turn the only one of chosen. Turns that tie in
    number stand in order of role and text; repeated rows are repeated turns. One conversation is one row of
    the result, so its rendered text must be shorter than 2 GB.
    """
    turns = turn_rows(rows)
    talks = conversations(turns)
    first = F.pmod("conv_id", F.lit(2)) == 0
    both = talks.groupBy(F.floor(F.col("conv_id") / 2).cast("long").alias("pair_id")).agg(
        F.any_value(F.when(first, F.col("turns")), True).alias("chosen"), F.any_value(F.when(~first, F.col("turns")), True).alias("rejected")
    )
    alone = F.array(F.struct("role", "text", _length(F.col("role"), F.col("text")).alias("at")))
    loose = turns.where("conv_id is null").select(F.col("conv_id").alias("pair_id"), alone.alias("chosen"))
    return format_preferences(both.unionByName(loose, allowMissingColumns=True))
