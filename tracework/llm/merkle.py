"""Merkle manifest of a dataset: levels are built bottom-up and kept, proofs are pushed top-down; DataFrame operations throughout."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

#: Nodes that one parent takes.
RUN = 8
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
_PATH = "array<struct<l: string, r: string>>"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def field(value: Column) -> Column:
    """A value as it enters a leaf: ``-`` if null, else its UTF-8 length in bytes, a colon and its decimal or text form."""
    value = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))


def leaf(values: Sequence[Column]) -> Column:
    return F.sha2(F.concat(*[field(v) for v in values]), 256)


def tampered(text: Column, key: Column) -> Column:
    """``text`` with A-Z lower-cased where 3 divides the CRC-32 of the key's decimal form."""
    return F.when(F.crc32(key.cast("string")) % 3 == 0, F.translate(text, _UPPER, _LOWER)).otherwise(text)


def _placed(leaves: DataFrame) -> DataFrame:
    """Adds ``i``, a leaf's place from 0 in its group, and ``n``, how many there are: ranges are sorted apart, and each group's part of a range begins where its parts before end."""
    order = [F.col("g"), F.col("id").asc_nulls_first(), F.col("h"), F.col("tie")]
    ranged = leaves.repartitionByRange(*order).sortWithinPartitions(*order)
    held = written(ranged.drop("tie").select("*", F.spark_partition_id().alias("p"), F.monotonically_increasing_id().alias("at")))
    # one row a range and group that meet
    counts = held.groupBy("p", "g").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("g").orderBy("p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    begins = counts.select("p", "g", "first", before.alias("before"), F.sum("n").over(Window.partitionBy("g")).alias("n"))
    return held.join(begins, ["p", "g"]).select("g", "id", "h", "h2", (F.col("before") + F.col("at") - F.col("first")).alias("i"), "n")


def _parents(nodes: DataFrame) -> DataFrame:
    """Runs of ``RUN`` consecutive nodes (g, i, n, h and more): (g, i of the parent, n of its level, kids in order, h of the parent)."""
    kid = F.struct("i", *[c for c in nodes.columns if c not in ("g", "i", "n")])
    runs = nodes.groupBy("g", F.expr(f"i div {RUN}").alias("up")).agg(F.sort_array(F.collect_list(kid)).alias("kids"), F.first("n").alias("below"))
    digest = F.sha2(F.array_join(F.transform("kids", lambda k: k.h), ""), 256)
    return runs.select("g", F.col("up").alias("i"), F.expr(f"(below + {RUN - 1}) div {RUN}").alias("n"), "kids", digest.alias("h"))


def build(nodes: DataFrame) -> tuple[list[DataFrame], list[DataFrame]]:
    """Levels of runs (g, i, n, kids, h), leaves' first, and for each height the groups whose tree ends there (g, h, and leaf columns at height 0).

    While a group has more than one node, its nodes of a level become runs of the next. Every level is a written table.
    """
    nodes = written(nodes)
    most = nodes.agg(F.max("n")).first()[0] or 0
    levels, tops = [], []
    while True:
        tops.append(nodes.where("n = 1").drop("n"))
        if most <= 1:
            return levels, tops
        levels.append(written(_parents(nodes.where("n > 1"))))
        nodes = levels[-1].select("g", "i", "n", "h")
        most = -(-most // RUN)


def _siblings(kids: Column, i: Column) -> Column:
    """The digests on both sides of kid ``i`` in its run, each side joined."""
    def side(keep):
        return F.array_join(F.transform(F.filter(kids, keep), lambda k: k.h), "")

    return F.struct(side(lambda k: k.i < i).alias("l"), side(lambda k: k.i > i).alias("r"))


def push(levels: list[DataFrame], tops: list[DataFrame], inherited: DataFrame) -> DataFrame:
    """Kids of the lowest level with the path of (left, right) siblings from them to the top: (g, kid, path, and what ``inherited`` holds).

    ``inherited`` has (g, path, ...) for each group's top. Persisted levels join children to parents; each child
    prepends its siblings to the suffix that its parent passed on. Between leaves and their parents nothing
    but runs moves: a leaf's path is made where its run met its parent's.
    """
    more = [c for c in inherited.columns if c not in ("g", "path")]

    def top(height: int) -> DataFrame:
        kid = F.struct(F.lit(0).cast("long").alias("i"), *[c for c in tops[height].columns if c not in ("g", "i")])
        return tops[height].select("g", kid.alias("kid")).join(inherited, "g").select("g", "kid", "path", *more)

    held = top(len(levels))
    for height in range(len(levels) - 1, -1, -1):
        above = held.select("g", F.col("kid.i").alias("i"), "path", *more)
        if height < len(levels) - 1:
            above = written(above)
        runs = levels[height].select("g", "i", "kids").join(above, ["g", "i"])
        kids = runs.select("g", F.explode("kids").alias("kid"), "kids", "path", *more)
        held = kids.select("g", "kid", F.concat(F.array(_siblings(F.col("kids"), F.col("kid.i"))), "path").alias("path"), *more)
        held = held.unionByName(top(height))
    return held


def manifest(docs: DataFrame, columns: Sequence[str] = COLUMNS, id_col: str = "doc_id", group_col: str = "lang", text_col: str = "text") -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified and n_levels for every row.

    A leaf digests the row's ``columns``. Leaves of a group ascend by id; every ``RUN`` consecutive nodes become
    their parent until one remains, the group's subroot; subroots, in order of their group, give the root likewise.
    proof_sha256 digests the siblings on the way to the root; folded_root is recomputed from the tampered
    leaf (text lower-cased where 3 divides the CRC-32 of the id) and the original siblings.

    Null ids come first, rows that share an id in the order of their leaves; equal rows are leaves of their own.
    A null group is a group and the first one. Rows without an id are not tampered with, null texts stay. Columns other than
    ``columns`` are ignored. An empty table gives an empty one.

    Leaves of one group are dealt to runs by place, so a group of any size is spread over all tasks. A row moves
    as 64 hex digits and its id; proofs reach runs, not leaves, so an eighth as many are moved as there are rows.
    """
    at = {c: docs[f"`{c}`"] for c in (*columns, id_col, group_col, text_col)}
    other = {**at, text_col: tampered(at[text_col], at[id_col])}
    group = F.coalesce(F.concat(F.lit("g"), at[group_col].cast("string")), F.lit(""))
    changed = F.coalesce(F.crc32(at[id_col].cast("string")) % 3 == 0, F.lit(False))
    digests = docs.select(
        group.alias("g"), at[id_col].cast("long").alias("id"), leaf([at[c] for c in columns]).alias("h"),
        F.when(changed, leaf([other[c] for c in columns])).alias("h2"), F.monotonically_increasing_id().alias("tie"),
    )
    levels, tops = build(_placed(written(digests)))
    subroots = tops[0].select("g", "h")
    for t in tops[1:]:
        subroots = subroots.unionByName(t.select("g", "h"))
    # subroots are leaves of a tree of their own
    above = subroots.select(F.lit("").alias("g"), F.col("g").alias("id"), "h", F.lit(None).cast("string").alias("h2"), F.lit(0).alias("tie"))
    top_levels, top_tops = build(_placed(written(above)))
    root = top_tops[-1].select("h").first()
    start = docs.sparkSession.range(1).select(F.lit("").alias("g"), F.array().cast(_PATH).alias("path"))
    inherited = written(push(top_levels, top_tops, start).select(F.col("kid.id").alias("g"), "path", F.col("kid.h").alias("subroot")))
    held = push(levels, tops, inherited)
    proof = F.sha2(F.array_join(F.transform("path", lambda s: F.concat(s.l, s.r)), ""), 256)
    fold = F.aggregate("path", F.coalesce("kid.h2", "kid.h"), lambda h, s: F.sha2(F.concat(s.l, h, s.r), 256))
    out = held.select(
        F.col("kid.id").alias("doc_id"), F.col("kid.h").alias("leaf"), "subroot", F.lit(root[0] if root else None).cast("string").alias("root"),
        proof.alias("proof_sha256"), fold.alias("folded_root"), F.size("path").cast("long").alias("n_levels"),
    )
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
