"""Mixing sources to target weights by hash-threshold histograms; DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, id_column, real_id, written

#: A document's lot has 60 bits, refined ten at a time: at most 1024 sums a source and level.
BITS, LEVEL_BITS, MOST_COPIES = 60, 10, 3


def n_words(text: Column) -> Column:
    """Number of words: each run is replaced by one letter, blanks are dropped, then letters are counted."""
    return F.length(F.translate(F.regexp_replace(F.coalesce(text, F.lit("")), WORD, "x"), " \t\n\x0b\x0c\r", "")).cast("long")


def lot(k: Column, text: Column) -> Column:
    """60 uniform bits of a document: the first 15 hexadecimal digits of the MD5 of its id's decimal form, a colon and its text."""
    name = F.concat_ws(":", F.coalesce(k.cast("string"), F.lit("null")), F.coalesce(text, F.lit("")))
    return F.conv(F.substring(F.md5(name), 1, BITS // 4), 16, 10).cast("long")


def own_lots(rows: DataFrame, name: str, source: str) -> DataFrame:
    """``rows`` with lots (column ``name``) that no two rows of a ``source`` share: the first keeps it, each further one gets the hash of it and of its number.

    Rows of a source with equal lots are equal in id and text, so it doesn't matter which is which: each partition numbers its own and
    begins where those before it end. Only lots that stand more than once are dealt; without such rows this is a count.
    """
    key = [source, name]
    twice = written(rows.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1").select(F.col(source).alias("__s"), F.col(name).alias("__l")))
    if twice.isEmpty():
        return rows
    same = (rows[source] == twice["__s"]) & (rows[name] == twice["__l"])
    alone = rows.join(twice, same, "left_anti")
    many = written(rows.join(twice, same, "left_semi").withColumn("__part", F.spark_partition_id()))
    within = F.row_number().over(Window.partitionBy(*key, "__part").orderBy(F.lit(0))) - 1
    # one row a lot and partition
    sums = many.groupBy(*key, "__part").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy(*key).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = many.withColumn("__nth", within).join(sums.select(*key, "__part", before.alias("__before")), [*key, "__part"])
    nth = F.col("__nth") + F.col("__before")
    further = F.conv(F.substring(F.md5(F.concat_ws(":", F.col(name).cast("string"), nth.cast("string"))), 1, BITS // 4), 16, 10).cast("long")
    placed = placed.withColumn(name, F.when(nth == 0, F.col(name)).otherwise(further))
    return alone.unionByName(placed.select(*rows.columns))


def targets(sizes: DataFrame, most: int = MOST_COPIES) -> DataFrame:
    """sizes (source, source_size) with ``target``: weights 1, 2, 3, 1, ... by code point order, nulls last.

    Targets share the sum of all sizes by weight but stop at ``most`` times the source's size; what is
    over is shared anew by weight among the others until none is above. In order of ``most * size /
    weight`` those that stop come first: the share per weight that is left after each tells where
    they end. The two ordered windows run over one row a source.
    """
    named = Window.orderBy(F.col("source").asc_nulls_last())
    w = sizes.withColumn("weight", (F.row_number().over(named) - 1) % 3 + 1).withColumn("cap", F.lit(most) * F.col("source_size"))
    filling = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before, all_rows = filling.rowsBetween(Window.unboundedPreceding, -1), filling.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    w = w.withColumn("left", F.sum("source_size").over(all_rows) - F.coalesce(F.sum("cap").over(before), F.lit(0)))
    w = w.withColumn("weights", F.sum("weight").over(all_rows) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
    w = w.withColumn("stops", F.col("cap") * F.col("weights") <= F.col("left") * F.col("weight"))
    share = F.first(F.when(~F.col("stops"), F.struct("left", "weights")), ignorenulls=True).over(all_rows)
    w = w.withColumn("share", share)
    level = F.col("share.left").cast("double") * F.col("weight") / F.col("share.weights")
    return w.select("source", "source_size", F.when(F.col("stops"), F.col("cap").cast("double")).otherwise(level).alias("target"))


def thresholds(sized: DataFrame, budgets: DataFrame) -> DataFrame:
    """budgets (key, budget) with ``below`` and ``held``: the documents of the key (``sized``: key, lot, size) with ``lot < below`` weigh ``held``, at most ``budget``, and any higher bound weighs more.

    Level by level, sizes are summed by key and the next bits of the lot, for the boundary
    bucket of the level before only; a running sum over at most 1024 buckets finds the next boundary.
    """
    at = budgets.select("key", "budget", F.lit(0).cast("long").alias("prefix"), F.lit(0).cast("long").alias("held"))
    top = 1 << LEVEL_BITS
    for level in range(BITS // LEVEL_BITS):
        rest = BITS - LEVEL_BITS * (level + 1)
        head = F.shiftrightunsigned("lot", rest)
        inside = sized.join(at.select("key", "prefix"), "key").where(F.shiftrightunsigned("lot", rest + LEVEL_BITS) == F.col("prefix"))
        sums = inside.groupBy("key", head.alias("bucket")).agg(F.sum("size").alias("weight"))
        running = F.sum("weight").over(Window.partitionBy("key").orderBy("bucket"))
        sums = sums.withColumn("upto", running).join(at, "key")
        over = F.col("held") + F.col("upto") > F.col("budget")
        edge = sums.groupBy("key").agg(
            F.min(F.when(over, F.col("bucket"))).alias("edge"), F.coalesce(F.max(F.when(~over, F.col("upto"))), F.lit(0)).alias("more")
        )
        # without a bucket that goes over the budget the bound is the end of the range
        end = F.col("prefix") * top + top
        at = written(
            at.join(edge, "key", "left").select(
                "key", "budget", F.coalesce("edge", end).alias("prefix"), (F.col("held") + F.coalesce("more", F.lit(0))).alias("held")
            )
        )
    return at.select("key", F.col("prefix").alias("below"), "held")


def fill(left: Column, sizes: Column) -> Column:
    """What of a source's further documents fits into ``left`` words, from the largest size down; ``sizes``: (size, n) descending.

    Of each size as many are taken as fit, so in the end fewer words are left than any document not
    taken has. The result lists the sizes where that changes, (size, take, all): from one with ``all`` down
    every document is taken; of one without, ``take``, and none of the sizes after it. Sizes before the
    first are taken whole. What is left halves from change to change, so the list is as long as its logarithm.
    """
    none = F.array().cast("array<struct<size:long,take:long,all:boolean>>")
    begin = F.struct(left.alias("left"), F.lit(False).alias("closed"), none.alias("changes"))

    def step(s: Column, x: Column) -> Column:
        take = F.least(x.n, F.floor(s.left / x.size).cast("long"))
        everything = take == x.n
        change = F.struct(x.size.alias("size"), take.alias("take"), everything.alias("all"))
        told = (everything & s.closed) | (~everything & ((take > 0) | ~s.closed))
        return F.struct((s.left - take * x.size).alias("left"), (~everything).alias("closed"), F.when(told, F.concat(s.changes, F.array(change))).otherwise(s.changes).alias("changes"))

    return F.aggregate(sizes, begin, step, lambda s: s.changes)


def _key(source: Column) -> Column:
    return F.when(source.isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), source))


def plan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", most: int = MOST_COPIES) -> tuple[DataFrame, DataFrame]:
    """(sized, plan): k, skey, size and lot of every row, read from the texts once; skey, source_size, target, rounds, below, spare and changes of every source."""
    text = F.col(f"`{text_col}`").cast("string")
    sized = docs.select(id_column(id_col).alias("k"), F.col(f"`{source_col}`").cast("string").alias("source"), n_words(text).alias("size"), lot(id_column(id_col), text).alias("lot"))
    sized = written(sized.withColumn("skey", _key(F.col("source"))))
    told = own_lots(sized, "lot", "skey")
    sized = sized if told is sized else written(told)
    goal = targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), most)
    # full rounds, and the budget of words for the last one
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    goal = goal.withColumn("rounds", whole).withColumn("budget", F.floor(F.col("target")).cast("long") - F.col("rounds") * F.col("source_size"))
    goal = written(goal.withColumn("skey", _key(F.col("source"))).drop("source"))
    below = thresholds(sized.select(F.col("skey").alias("key"), "lot", "size"), goal.select(F.col("skey").alias("key"), "budget"))
    # written, so that its size is known: the rows below join it without being dealt by source
    goal = written(goal.join(below.withColumnRenamed("key", "skey"), "skey").withColumn("spare", F.col("budget") - F.col("held")).drop("budget", "held"))
    # a document larger than what is left is passed over; those after it that fit are taken by size
    rest = sized.join(goal.select("skey", "below", "spare"), "skey").where("lot >= below and size between 1 and spare")
    sizes = rest.groupBy("skey", "size").agg(F.count("*").alias("n")).groupBy("skey").agg(F.sort_array(F.collect_list(F.struct("size", "n")), False).alias("sizes"))
    goal = written(goal.join(sizes, "skey", "left").withColumn("changes", fill(F.col("spare"), F.col("sizes"))).drop("sizes"))
    parts = goal.select("skey", F.explode("changes").alias("c")).select("skey", "c.size", F.col("c.take").alias("budget"), "c.all").where("not all and budget > 0")
    key = F.concat_ws(":", F.col("size").cast("string"), F.col("skey"))
    parts = written(parts.withColumn("key", key))
    # of a size that is taken in part, those with the smallest lots
    some = rest.join(parts.select("skey", "size", "key"), ["skey", "size"]).select("key", "lot", F.lit(1).cast("long").alias("size"))
    bounds = thresholds(some, parts.select("key", "budget")).withColumnRenamed("below", "upto").drop("held")
    c = F.explode_outer("changes").alias("c")
    changes = goal.select("skey", c).withColumn("key", F.concat_ws(":", F.col("c.size").cast("string"), F.col("skey"))).join(bounds, "key", "left")
    change = F.when(F.col("c").isNotNull(), F.struct("c.size", "c.all", F.coalesce("upto", F.lit(0)).alias("upto")))
    return sized, written(goal.drop("changes").join(changes.groupBy("skey").agg(F.collect_list(change).alias("changes")), "skey"))


def _copies(p: str, size: Column, lot: Column, most: int) -> Column:
    """How often a document is taken; ``p`` stands before the names of the plan's columns."""
    below, spare, changes = (F.col(f"{p}{c}") for c in ("below", "spare", "changes"))
    change = F.array_min(F.filter(changes, lambda c: c.size >= size))
    fits = (size > 0) & (size <= spare) & (change.isNull() | change["all"] | ((change["size"] == size) & (lot < change["upto"])))
    return F.least(F.col(f"{p}rounds") + F.when((lot < below) | fits, 1).otherwise(0), F.lit(most)).cast("long")


def with_copies(docs: DataFrame, planned: DataFrame, name: str, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", most: int = MOST_COPIES, size: str | None = None) -> DataFrame:
    """``docs`` with every column, how often the mix takes each row and, if named, its number of words."""
    p = planned.select(*[F.col(c).alias(f"__mix_{c}") for c in planned.columns])
    text = F.col(f"`{text_col}`").cast("string")
    facts = F.struct(n_words(text).alias("__mix_size"), lot(id_column(id_col), text).alias("__mix_lot"), _key(F.col(f"`{source_col}`").cast("string")).alias("__mix_key"))
    # a row of an array of one: what costs a pass over the text is computed once
    rows = own_lots(docs.select("*", F.inline(F.array(facts))), "__mix_lot", "__mix_key").join(p, F.col("__mix_key") == F.col("__mix_skey"))
    rows = rows.withColumn(name, _copies("__mix_", F.col("__mix_size"), F.col("__mix_lot"), most))
    rows = rows.withColumn(size, F.col("__mix_size")) if size else rows
    return rows.drop("__mix_key", "__mix_size", "__mix_lot", *p.columns)


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", most: int = MOST_COPIES) -> DataFrame:
    """How often each document enters a mix of its source's target size.

    Size: words of the text (null: 0). A source whose target is ``c`` times its size takes every
    document floor(c) times, and those whose lot lies below the source's threshold once more, as far
    as the budget goes. A document larger than what is left then is passed over and further ones
    that fit are taken, the largest sizes first, so fewer words are left than any document not taken has.
    The lot depends on the id and the text alone, so reruns agree. Of rows equal in both, each further one has a lot of its own;
    which of them that is doesn't matter, as many are taken in each run.

    Returns doc_id, size, source_size, target (the source's), taken (words) and copies. A null
    source is a source of its own, last in order; null ids are drawn by their texts. An empty
    table gives an empty result. Other columns are ignored.
    """
    sized, planned = plan(docs, id_col, text_col, source_col, most)
    out = sized.drop("source").join(planned, "skey").withColumn("copies", _copies("", F.col("size"), F.col("lot"), most))
    return out.select(real_id("k").alias("doc_id"), "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies")
