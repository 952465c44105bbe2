"""Prefix scans over ordered streams, also over one stream that is too long for a task.

A window over a stream is one task a key. :class:`Stream` with ``spread`` cuts streams by ranges of their order instead: each
range is scanned by itself, leaves one row of totals a key, those few rows are scanned, and what
they carry is added to each range. A key of any size then takes as many tasks as it has ranges.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..stored import stored

RANGE = "__range"
#: Rows of a key from which :func:`too_long` advises to spread.
LONG = 5_000_000


class Scan(NamedTuple):
    """What a row gets from the rows before (or after) it in its stream; ``own`` says whether it counts itself."""

    kind: str
    value: Column
    own: bool


def total(value: Column, own: bool = True) -> Scan:
    """Sum of ``value``, nulls left out; 0 before the first."""
    return Scan("total", value, own)


def last(value: Column, own: bool = False) -> Scan:
    """The last ``value`` that isn't null."""
    return Scan("last", value, own)


def following(value: Column, own: bool = False) -> Scan:
    """The next ``value`` that isn't null."""
    return Scan("following", value, own)


class Stream:
    """``df`` in streams of equal ``keys`` (none: one stream), each in the total order of the columns ``order``, nulls first.

    Plain, a scan is a window over a stream. With ``spread`` rows are sorted into ranges of (keys, order), ``ranges`` of them or as
    many as the session's shuffle partitions, and stored; a scan runs in each range, and a join with one row
    a range and key adds what comes from the others. Null keys are a stream.
    """

    def __init__(self, df: DataFrame, keys: Sequence[str], order: Sequence[str], spread: bool = False, ranges: int | None = None):
        self.keys, self.order, self.spread = list(keys), list(order), spread
        if spread:
            by = [F.col(c) for c in [*self.keys, *self.order]]
            df = (df.repartitionByRange(ranges, *by) if ranges else df.repartitionByRange(*by)).sortWithinPartitions(*by)
            df = stored(df.withColumn(RANGE, F.spark_partition_id()))
        self.df = df

    def _with(self, df: DataFrame) -> Stream:
        out = Stream(df, self.keys, self.order)
        out.spread = self.spread
        return out

    def map(self, change) -> Stream:
        """The stream with its rows changed by a function of DataFrames that keeps keys, order and rows' ranges."""
        return self._with(change(self.df))

    def window(self, back: bool = False):
        """The stream's order within a range, or within the whole stream where it isn't spread."""
        return Window.partitionBy(*self.keys, *([RANGE] if self.spread else [])).orderBy(*[F.desc_nulls_last(c) if back else F.asc_nulls_first(c) for c in self.order])

    def _within(self, s: Scan) -> Column:
        frame = self.window(s.kind == "following").rowsBetween(Window.unboundedPreceding, 0 if s.own else -1)
        return F.coalesce(F.sum(s.value).over(frame), F.lit(0)) if s.kind == "total" else F.last(s.value, True).over(frame)

    def _summed(self, s: Scan) -> Column:
        if s.kind == "total":
            return F.coalesce(F.sum(s.value), F.lit(0))
        place = F.when(s.value.isNotNull(), F.struct(*self.order))
        return F.max_by(s.value, place) if s.kind == "last" else F.min_by(s.value, place)

    def carried(self, **sums: tuple[str, Column]) -> DataFrame:
        """(keys, RANGE, names): for each range and key what the ranges before it (``following``: after it) come to; a sum is (kind, aggregate)."""
        rows = self.df.groupBy(*self.keys, RANGE).agg(*[a.alias(n) for n, (_, a) in sums.items()])

        def over(kind: str):
            return Window.partitionBy(*self.keys).orderBy(F.desc(RANGE) if kind == "following" else F.asc(RANGE)).rowsBetween(Window.unboundedPreceding, -1)

        # one row a range and key
        return rows.select(*self.keys, RANGE, *[(F.coalesce(F.sum(n).over(over(k)), F.lit(0)) if k == "total" else F.last(n, True).over(over(k))).alias(n) for n, (k, _) in sums.items()])

    def scan(self, **scans: Scan) -> Stream:
        """Adds a column for each scan."""
        within = self.df.withColumns({n: self._within(s) for n, s in scans.items()})
        if not self.spread:
            return self._with(within)
        carry = self.carried(**{n: (s.kind, self._summed(s)) for n, s in scans.items()})
        carry = carry.select(F.col(RANGE).alias("__r"), *[F.col(k).alias(f"__k{i}") for i, k in enumerate(self.keys)], *[F.col(n).alias(f"__c_{n}") for n in scans])
        same = reduce(and_, [F.col(k).eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(self.keys)], F.col(RANGE) == F.col("__r"))
        out = within.join(carry, same)
        whole = {n: F.col(n) + F.col(f"__c_{n}") if s.kind == "total" else F.coalesce(F.col(n), F.col(f"__c_{n}")) for n, s in scans.items()}
        return self._with(out.withColumns(whole).drop("__r", *[f"__k{i}" for i in range(len(self.keys))], *[f"__c_{n}" for n in scans]))

    def rows(self) -> DataFrame:
        return self.df.drop(RANGE)


def too_long(df: DataFrame, keys: Sequence[str], limit: int = LONG) -> bool:
    """Whether a key has more than ``limit`` rows, so that its stream should be spread. Counts are combined before they move."""
    return (df.groupBy(*keys).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0) > limit


def peak(df: DataFrame, keys: Sequence[str], start: str, end: str, ranges: int | None = None) -> DataFrame:
    """(keys, peak): most intervals open at once, an end at an instant before a start; no keys: over the whole table.

    Marks of an instant are added up first, whatever their number. A range of instants comes to its sum and its highest
    prefix; the sums of the ranges before it are added to the latter.
    """
    marks = df.select(*keys, F.col(start).alias("at"), F.lit(1).alias("step")).unionByName(df.select(*keys, F.col(end).alias("at"), F.lit(-1).alias("step")))
    steps = Stream(marks.groupBy(*keys, "at").agg(F.sum("step").alias("step")), keys, ["at"], True, ranges)
    running = steps.df.withColumn("open", F.sum("step").over(steps.window().rowsBetween(Window.unboundedPreceding, 0)))
    tops = running.groupBy(*keys, RANGE).agg(F.sum("step").alias("step"), F.max("open").alias("top"))
    before = F.coalesce(F.sum("step").over(Window.partitionBy(*keys).orderBy(RANGE).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    best = F.greatest(F.max("high"), F.lit(0)).cast("long").alias("peak")
    high = tops.select(*keys, (F.col("top") + before).alias("high"))
    return high.groupBy(*keys).agg(best) if keys else high.agg(F.coalesce(best, F.lit(0).cast("long")).alias("peak"))


def medians(df: DataFrame, keys: Sequence[str], value: str, ranges: int | None = None, spread: bool = True) -> DataFrame:
    """(keys, n, low, high): the two middle values of each key, equal where n is odd; nulls are left out, keys without a value too.

    Equal values are added up first, then a scan over the distinct ones tells how many stand before each, so no group
    is held in one place, however many values it has. (low + high) / 2 is the median, low the lower one.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("__v")).agg(F.count("*").alias("__n"))
    s = Stream(counts, keys, ["__v"], spread, ranges).scan(__before=total(F.col("__n"), own=False))
    whole = counts.groupBy(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)]).agg(F.sum("__n").alias("n"))
    same = reduce(and_, [F.col(k).eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(keys)], F.lit(True))
    rows = s.rows().join(whole, same) if keys else s.rows().join(F.broadcast(whole))
    holds = lambda rank: (F.col("__before") <= rank) & (rank < F.col("__before") + F.col("__n"))
    low, high = F.floor((F.col("n") - 1) / 2), F.floor(F.col("n") / 2)
    return rows.where(holds(low) | holds(high)).groupBy(*keys).agg(F.max("n").alias("n"), F.min("__v").alias("low"), F.max("__v").alias("high")).where("n is not null")
