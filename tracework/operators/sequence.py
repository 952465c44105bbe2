"""Generic operators over ordered streams; every analysis of sessions is composed of these.

``keys`` are the columns of a stream (a session, a user, a repository), ``order`` its total order.
Each operator shuffles by ``keys`` at most once, so several in a row share one exchange.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..stored import stored
from . import scans
from .scans import Stream

Keys = Sequence[str]


def window(keys: Keys, order: Sequence[str | Column]):
    return Window.partitionBy(*keys).orderBy(*order)


def index_events(df: DataFrame, keys: Keys, order: Sequence[str | Column], name: str = "index") -> DataFrame:
    """Adds the position of each event in its stream, from 0."""
    return df.withColumn(name, (F.row_number().over(window(keys, order)) - 1).cast("long"))


def numbered(df: DataFrame, order: Sequence[str | Column], name: str) -> DataFrame:
    """Adds each row's place, from 1, in the order of the whole table: ranges are sorted apart, each begins where the counts of those before it end."""
    sorted_ = df.repartitionByRange(*order).sortWithinPartitions(*order)
    held = stored(sorted_.select("*", F.spark_partition_id().alias("__part"), F.monotonically_increasing_id().alias("__place")))
    counts = held.groupBy("__part").agg(F.count("*").alias("__n"), F.min("__place").alias("__first"))
    # one row a range
    begins = counts.withColumn("__before", F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    out = held.join(F.broadcast(begins.drop("__n")), "__part")
    return out.withColumn(name, (F.col("__before") + F.col("__place") - F.col("__first") + 1).cast("long")).drop("__part", "__place", "__first", "__before")


def cap_events(df: DataFrame, keys: Keys, order: Sequence[str], structural: Column, cap: int, name: str = "index", spread: bool = False) -> DataFrame:
    """Keeps an event if fewer than ``cap`` were kept before it or it is structural, and numbers what is kept from 0.

    Until the cap is reached everything is kept, so an event's place among all events decides; a kept one's number is how many
    were kept before it. ``spread``: see :class:`Stream`.
    """
    s = Stream(df, keys, order, spread).scan(__n=scans.total(F.lit(1)))
    kept = F.when((F.col("__n") <= cap) | structural, 1)
    s = s.map(lambda d: d.withColumn("__kept", kept)).scan(**{name: scans.total(F.col("__kept"), own=False)})
    return s.rows().where("__kept = 1").drop("__n", "__kept").withColumn(name, F.col(name).cast("long"))


def gap_sessions(df: DataFrame, keys: Keys, ts: str, gap_seconds: int, order: Sequence[str] | None = None, name: str = "session", break_on_null: bool = False, spread: bool = False, ranges: int | None = None) -> DataFrame:
    """Adds the number (from 1) of the run of events whose gaps are at most ``gap_seconds``; optionally a null time starts and ends a run.

    ``spread`` (over ``ranges`` ranges) is for streams too long for a task, and for a table that is one stream: see :class:`Stream`.
    """
    s = Stream(df, keys, order or [ts], spread, ranges).scan(__before=scans.last(F.struct(F.col(ts).alias("t"))))
    gap = (F.unix_micros(F.col(ts)) - F.unix_micros(F.col("__before.t"))) > gap_seconds * 1_000_000
    starts = F.col("__before").isNull() | F.coalesce(gap, F.lit(break_on_null))
    s = s.map(lambda d: d.withColumn("__starts", starts.cast("int"))).scan(**{name: scans.total(F.col("__starts"))})
    return s.rows().drop("__before", "__starts").withColumn(name, F.col(name).cast("long"))


def active_windows(df: DataFrame, keys: Keys, ts: str, gap_seconds: int = 15 * 60, spread: bool = False, ranges: int | None = None) -> DataFrame:
    """(keys, window, start, end): bare extents of runs; a gap of exactly ``gap_seconds`` still joins. Null times are left out."""
    runs = gap_sessions(df.where(F.col(ts).isNotNull()), keys, ts, gap_seconds, name="window", spread=spread, ranges=ranges)
    return runs.groupBy(*keys, "window").agg(F.min(ts).alias("start"), F.max(ts).alias("end"), F.count("*").alias("events"))


def active_seconds(df: DataFrame, keys: Keys, ts: str, gap_seconds: int = 90 * 60, spread: bool = False, ranges: int | None = None) -> DataFrame:
    """(keys, seconds): sum of the gaps of at most ``gap_seconds``."""
    s = Stream(df.where(F.col(ts).isNotNull()), keys, [ts], spread, ranges).scan(__before=scans.last(F.col(ts)))
    gap = F.unix_micros(F.col(ts)) - F.unix_micros("__before")
    counted = s.rows().withColumn("__gap", F.when(gap <= gap_seconds * 1_000_000, gap).otherwise(0))
    return counted.groupBy(*keys).agg((F.sum("__gap") / 1e6).alias("seconds"))


def follow_up(df: DataFrame, keys: Keys, order: Sequence[str | Column], opens: Column, answers: Column, value: Column, reach: int = 3) -> DataFrame:
    """Adds ``reply``: the value of the first answer within ``reach`` events after an opening, unless another opening comes first."""
    w = window(keys, order)
    kind = F.when(opens, 1).when(answers, 2)
    reply = None
    for step in range(reach, 0, -1):
        k, v = F.lead(kind, step).over(w), F.lead(value, step).over(w)
        reply = F.when(k == 1, F.lit(None)).when(k == 2, v).otherwise(reply if reply is not None else F.lit(None))
    return df.withColumn("reply", F.when(opens, reply))


def nearest(df: DataFrame, keys: Keys, order: Sequence[str | Column], wanted: Column, value: Column, reach: int = 5) -> Column:
    """The value of the nearest wanted event before within ``reach``, else the nearest after."""
    w = window(keys, order)
    found = F.when(wanted, value)
    before = F.last(found, True).over(w.rowsBetween(-reach, -1))
    after = F.first(found, True).over(w.rowsBetween(1, reach))
    return F.coalesce(before, after)


def near_any(keys: Keys, order: Sequence[str | Column], flag: Column, reach: int = 5) -> Column:
    """Whether any event within ``reach`` on either side, or itself, has the flag."""
    return F.coalesce(F.bool_or(flag).over(window(keys, order).rowsBetween(-reach, reach)), F.lit(False))


def next_value(keys: Keys, order: Sequence[str], value: Column) -> Column:
    """The next value that isn't null after this event; null if none. The stream is walked backwards, as a frame that only grows costs one step an event."""
    back = window(keys, [F.desc_nulls_last(o) for o in order])
    return F.last(value, True).over(back.rowsBetween(Window.unboundedPreceding, -1))


def next_index(keys: Keys, order: Sequence[str], wanted: Column, index: str = "index") -> Column:
    """Index of the next wanted event after this one; null if none."""
    return next_value(keys, order, F.when(wanted, F.col(index)))


def previous_value(keys: Keys, order: Sequence[str | Column], wanted: Column, value: Column) -> Column:
    """Value of the last wanted event before this one; null if none."""
    return F.last(F.when(wanted, value), True).over(window(keys, order).rowsBetween(Window.unboundedPreceding, -1))


def forward_fill(keys: Keys, order: Sequence[str | Column], value: Column) -> Column:
    return F.last(value, True).over(window(keys, order).rowsBetween(Window.unboundedPreceding, Window.currentRow))


def first_by(df: DataFrame, keys: Keys, order: Sequence[str | Column]) -> DataFrame:
    """The first row of each key in the given order: first match, first wins, last wins (descending)."""
    return df.withColumn("__n", F.row_number().over(window(keys, order))).where("__n = 1").drop("__n")


def top_by(df: DataFrame, keys: Keys, order: Sequence[str | Column], k: int, rank: str = "rank") -> DataFrame:
    """The first ``k`` rows of each key, ranked."""
    return df.withColumn(rank, F.row_number().over(window(keys, order)).cast("long")).where(F.col(rank) <= k)


def capped_text(df: DataFrame, keys: Keys, order: Sequence[str], value: Column, cap: int, separator: str, name: str, mark: str = "...", spread: bool = False, ranges: int | None = None) -> DataFrame:
    """(keys, name): values that aren't null in order, joined and cut to ``cap`` characters with the mark included, as if all had been gathered.

    Where each value would begin is known from the lengths before it, so what lies beyond the cap is dropped and the last value cut
    before anything is gathered: a key costs its cap, whatever stands under it.
    """
    held = df.select(*keys, *order, value.cast("string").alias("__v")).where("__v is not null")
    s = Stream(held, keys, order, spread, ranges).scan(__begin=scans.total(F.length("__v") + len(separator), own=False))
    # the separator before a value may be what goes beyond the cap
    near = s.rows().where(F.col("__begin") - len(separator) <= cap)
    cut = F.struct("__begin", *order, F.left("__v", F.greatest(cap + 1 - F.col("__begin"), F.lit(0)).cast("int")).alias("v"))
    lines = near.groupBy(*keys).agg(F.sort_array(F.collect_list(cut)).alias("__all"))
    text = F.array_join(F.transform("__all", lambda x: x.v), separator)
    return lines.select(*keys, F.when(F.length(text) > cap, F.concat(F.left(text, F.lit(max(cap - len(mark), 0))), F.lit(mark))).otherwise(text).alias(name))


def most_common(df: DataFrame, keys: Keys, value: str, order: Sequence[str | Column] | None = None) -> DataFrame:
    """(keys, value, n): the value with the most rows; ties by ``order``, by default the smaller value."""
    counts = df.groupBy(*keys, value).agg(F.count("*").alias("n"))
    return first_by(counts, keys, [F.desc("n"), *(order or [F.asc(value)])])


def max_concurrency(df: DataFrame, keys: Keys, start: str, end: str) -> DataFrame:
    """(keys, peak): most intervals open at once; an end at an instant counts before a start. For one stream over a whole table: :func:`scans.peak`."""
    marks = df.select(*keys, F.col(start).alias("at"), F.lit(1).alias("step")).unionByName(df.select(*keys, F.col(end).alias("at"), F.lit(-1).alias("step")))
    steps = marks.groupBy(*keys, "at").agg(F.sum("step").alias("step"))
    open_now = F.sum("step").over(window(keys, ["at"]).rowsBetween(Window.unboundedPreceding, 0))
    return steps.withColumn("open", open_now).groupBy(*keys).agg(F.greatest(F.max("open"), F.lit(0)).cast("long").alias("peak"))


def busiest_hours(df: DataFrame, keys: Keys, hour: str, width: int = 4) -> DataFrame:
    """(keys, start, n, peak_hour, peak_n): the circular run of ``width`` hours with the most rows, and the busiest hour; ties go to the lower hour."""
    counts = df.where(F.col(hour).isNotNull()).groupBy(*keys, F.col(hour).alias("h")).agg(F.count("*").alias("n"))
    starts = counts.select(*keys, "h", "n", F.explode(F.sequence(F.lit(0), F.lit(width - 1))).alias("back"))
    runs = starts.groupBy(*keys, F.pmod(F.col("h") - F.col("back"), F.lit(24)).cast("int").alias("start")).agg(F.sum("n").alias("n"))
    best = first_by(runs, keys, [F.desc("n"), "start"])
    peak = first_by(counts, keys, [F.desc("n"), "h"]).select(*keys, F.col("h").cast("int").alias("peak_hour"), F.col("n").alias("peak_n"))
    return best.join(peak, list(keys)) if keys else best.join(peak)


def _nodes(df: DataFrame, low: str, high: str) -> DataFrame:
    """Deals each interval of cells ``low`` to ``high`` to the dyadic nodes (``__level``, ``__node``) that make it up: two a level at most."""
    # on level k what is left of an interval begins at cell ceil(low / 2**k) and ends before floor((high + 1) / 2**k)
    left, right = f"-shiftright(-{low}, k)", f"shiftright({high} + 1, k)"
    ends = f"filter(array(struct(k AS level, {left} AS node, ({left}) % 2 <> 0 AS odd), struct(k AS level, {right} - 1 AS node, {right} % 2 <> 0 AS odd)), e -> e.odd AND {left} < {right})"
    top = f"CAST(ceil(log2({high} - {low} + 1)) AS INT)"
    return df.withColumn("__n", F.expr(f"explode(flatten(transform(sequence(0, {top}), k -> {ends})))")).withColumns({"__level": F.col("__n.level"), "__node": F.col("__n.node")}).drop("__n")


def _ancestors(df: DataFrame, cell: str, levels: DataFrame) -> DataFrame:
    """Deals each cell to the nodes above it, on the levels that the other side has."""
    return df.join(F.broadcast(levels)).withColumn("__level", F.explode("__levels")).withColumn("__node", F.expr(f"shiftright({cell}, __level)")).drop("__levels")


def _levels(nodes: DataFrame) -> DataFrame:
    """One row: the levels of ``nodes``, at most 63."""
    return nodes.agg(F.sort_array(F.collect_set("__level")).alias("__levels"))


def overlap_join(a: DataFrame, b: DataFrame, keys: Keys, pad_seconds: int, cell_seconds: int = 3600) -> DataFrame:
    """Inner join of intervals (``a_start``, ``a_end``) and (``b_start``, ``b_end``) that meet when ``b`` is padded on both sides, ends included.

    Two intervals meet if one begins in the other. So the beginnings of each side are dealt to the dyadic nodes above their cell, the
    intervals of the other side to the nodes that make them up, of which exactly one holds a beginning within: an equi-join without
    repeats, in which an interval of any length costs twice the logarithm of its cells.
    """
    width, pad = cell_seconds * 1_000_000, pad_seconds * 1_000_000

    def ready(df: DataFrame, side: str, low: Column, high: Column) -> DataFrame:
        df = df.withColumns({f"__{side}l": low, f"__{side}h": high}).where(F.col(f"__{side}l") <= F.col(f"__{side}h"))
        return df.withColumns({f"__{side}0": F.floor(F.col(f"__{side}l") / width).cast("long"), f"__{side}1": F.floor(F.col(f"__{side}h") / width).cast("long")})

    left = ready(a, "a", F.unix_micros("a_start"), F.unix_micros("a_end"))
    right = ready(b, "b", F.unix_micros("b_start") - pad, F.unix_micros("b_end") + pad)
    made = [f"__{side}{end}" for side in "ab" for end in "lh01"]
    by = [*keys, "__level", "__node"]
    held_a, held_b = _nodes(left, "__a0", "__a1"), _nodes(right, "__b0", "__b1")
    first = _ancestors(left, "__a0", _levels(held_b)).join(held_b, by).where("__al between __bl and __bh")
    second = held_a.join(_ancestors(right, "__b0", _levels(held_a)), by).where("__bl > __al and __bl <= __ah")
    return first.unionByName(second).drop("__level", "__node", *made)
