"""Embedding near-duplicates: random-hyperplane tables, exact cosine verification, connected components."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, id_column, partitions, real_id, written

SEED, RECALL, ROWS_A_LOT = 7, 0.999, 50_000
#: Classes that a bucket of a table should hold, and those from which it is cut into blocks; rows and columns of one product; bits of a sketch.
BUCKET, BLOCK, TILE, SKETCH = 256, 4096, 1024, 256


def tables_for(rows: int, threshold: float, recall: float = RECALL) -> tuple[int, int]:
    """(bits, tables): bits grow with the logarithm of the rows, tables so that a pair at the threshold is met with probability ``recall``."""
    bits = max(8, round(math.log2(max(rows, 2) / BUCKET)))
    agree = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, math.ceil(math.log(1 - recall) / math.log1p(-agree))


def differing(threshold: float) -> int:
    """Bits of a sketch in which a pair at the threshold differs at most, but for one pair in 10**11: seven deviations above the mean."""
    p = math.acos(threshold) / math.pi
    return math.ceil(SKETCH * p + 7 * math.sqrt(SKETCH * p * (1 - p)))


def _clean(column: str):
    x = F.transform(F.col(f"`{column}`"), lambda v: v.cast("double"))
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    return F.when(finite & F.exists(x, lambda v: v != 0), x)


def _unit(vectors: np.ndarray) -> np.ndarray:
    scaled = vectors / np.abs(vectors).max(1, keepdims=True)
    return scaled / np.sqrt((scaled * scaled).sum(1, keepdims=True))


def _sign(bits: int, count: int):
    def run(batches):
        for batch in batches:
            raw = batch.column("v").to_pylist()
            sizes = np.array([len(v) for v in raw])
            for size in np.unique(sizes).tolist():
                at = np.flatnonzero(sizes == size)
                vectors = np.array([raw[i] for i in at], np.float64)
                planes = np.random.default_rng((SEED, size)).standard_normal((size, bits * count + SKETCH))
                up = _unit(vectors) @ planes >= 0
                sig = (up[:, : bits * count].reshape(len(at), count, bits) * (1 << np.arange(bits, dtype=np.int64))).sum(2).astype(np.int32)
                sketch = np.packbits(up[:, bits * count :], axis=1)
                # as floats where nothing is lost by it
                short = vectors.astype(np.float32)
                stored = [(f if (f == v).all() else v).tobytes() for f, v in zip(short, vectors, strict=True)]
                held = batch.take(pa.array(at))
                yield pa.RecordBatch.from_arrays(
                    [held.column("c"), held.column("copies"), pa.array(np.full(len(at), size, np.int32)), pa.array(stored, pa.binary()), pa.array(list(sig), pa.list_(pa.int32()))]
                    + [pa.array([x.tobytes() for x in sketch], pa.binary())],
                    names=["c", "copies", "dim", "v", "sig", "sketch"],
                )

    return run


def _groups(table: pa.Table, names: tuple[str, ...]):
    """Index arrays of the rows that agree in ``names``."""
    cols = [table.column(c).to_numpy() for c in names]
    by = np.lexsort(cols)
    new = np.zeros(len(by), bool)
    for c in cols:
        new[1:] |= c[by][1:] != c[by][:-1]
    return np.split(by, np.flatnonzero(new))


def _sift(limit: int):
    """Members of a bucket whose sketch comes within ``limit`` bits of another member's."""

    def run(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        sketch = np.frombuffer(b"".join(group.column("sketch").to_pylist()), np.uint64).reshape(group.num_rows, -1)
        near = np.zeros(group.num_rows, bool)
        for at in _groups(group, ("s", "dim", "t")):
            for lo in range(0, len(at) - 1, 256):
                x = at[lo : lo + 256]
                y = at[lo + 1 :]
                apart = sum(np.bitwise_count(sketch[x, None, w] ^ sketch[None, y, w]).astype(np.int16) for w in range(sketch.shape[1]))
                # each pair once: y starts one place after x
                i, j = np.nonzero((apart <= limit) & (np.arange(len(y))[None, :] >= np.arange(len(x))[:, None]))
                near[x[i]] = True
                near[y[j]] = True
        return group.filter(pa.array(near)).select(["c", "t", "s"])

    return run


def _roots(n: int, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """For each of ``n`` nodes the smallest node that the edges (x, y) lead to."""
    low = np.arange(n)
    while True:
        now = low.copy()
        np.minimum.at(now, x, low[y])
        np.minimum.at(now, y, low[x])
        now = now[now]
        if (now == low).all():
            return low
        low = now


def _meet(unit, sig, size, own, t: int, i: int, j: int, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Of one block pair of a bucket: how many copies each member links with, and the smallest member its links lead to."""
    n = len(unit)
    links, nodes = np.zeros(n, np.int64), np.arange(n)
    root = nodes
    a, b = np.flatnonzero(own == i), np.flatnonzero(own == j)
    for lo in range(0, len(a), TILE):
        rows = a[lo : lo + TILE]
        for lo2 in range(0, len(b), TILE):
            cols = b[lo2 : lo2 + TILE]
            x, y = np.nonzero(unit[rows] @ unit[cols].T >= threshold)
            x, y = rows[x], cols[y]
            if i == j:
                x, y = x[x < y], y[x < y]
            if t and len(x):
                # a pair counts in the first table in which it meets
                fresh = np.ones(len(x), bool)
                for at in range(0, len(x), 65536):
                    fresh[at : at + 65536] = ~(sig[x[at : at + 65536], :t] == sig[y[at : at + 65536], :t]).any(1)
                x, y = x[fresh], y[fresh]
            if len(x):
                np.add.at(links, x, size[y])
                np.add.at(links, y, size[x])
                # what joins the members of this block pair is enough
                root = _roots(n, np.r_[x, nodes], np.r_[y, root])
    return links, root


def _vectors(blobs: list[bytes], dim: int) -> np.ndarray:
    """Unit vectors in double precision."""
    if all(len(b) == 4 * dim for b in blobs):
        return _unit(np.frombuffer(b"".join(blobs), np.float32).reshape(len(blobs), dim).astype(np.float64))
    return _unit(np.array([np.frombuffer(b, np.float32 if len(b) == 4 * dim else np.float64) for b in blobs], np.float64))


def _compare(threshold: float):
    def run(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        size, t, dim, i, j, own = (group.column(c).to_numpy() for c in ("copies", "t", "dim", "i", "j", "block"))
        vectors, sigs = group.column("v"), group.column("sig")
        first, links, to = [], [], []
        for at in _groups(group, ("j", "i", "s", "dim", "t")):
            if len(at) < 2:
                continue
            take = pa.array(at)
            unit = _vectors(vectors.take(take).to_pylist(), int(dim[at[0]]))
            sig = np.array(sigs.take(take).to_pylist(), np.int32)
            n, root = _meet(unit, sig, size[at], own[at], *(int(c[at[0]]) for c in (t, i, j)), threshold)
            met = np.flatnonzero((n > 0) | (root != np.arange(len(at))))
            first.append(at[met])
            links.append(n[met])
            to.append(at[root[met]])
        cat = [np.concatenate(c) if c else np.empty(0, np.int64) for c in (first, links, to)]
        named = [group.column("c").take(pa.array(cat[k])).cast(pa.binary()) for k in (0, 2)]
        return pa.table({"c": named[0], "links": pa.array(cat[1], pa.int64()), "to": named[1]})

    return run


def near_duplicates(vectors: DataFrame, threshold: float = 0.95, id_col: str = "vec_id", vector_col: str = "embedding", recall: float = RECALL, exact: bool = False) -> DataFrame:
    """Link vectors with cosine >= ``threshold`` (double precision) and group what links reach.

    Returns vec_id, n_links (other rows linked directly), component_id (smallest vec_id reachable),
    kept (vec_id = component_id). Null, empty or zero vectors and vectors with null or non-finite
    components link with nothing. Vectors of different lengths never link. Equal vectors are one
    class before any comparison. A null id counts as the smallest and stays null. Rows that share an
    id are told apart by their vectors. Other columns are ignored.

    A pair at the threshold shares a bucket in some table with probability ``recall`` (closer ones
    more likely); every link found is verified exactly. ``exact`` (or ``recall=1``) loses none: all classes are one bucket,
    whose block pairs are compared in a task each, at the cost of the square of the classes. Tables hold ids and sketches of 256 more signs;
    only members whose sketch comes near another one's of the bucket fetch their vectors. Buckets of
    more than ``BLOCK`` classes skip the sketches, are cut into blocks and compared block by block, each
    block pair in a task of its own; only link counts and the edges of a spanning forest leave it.
    """
    least_lots = partitions(vectors.sparkSession)
    exact = exact or recall >= 1
    rows = vectors.select(id_column(id_col).alias("k"), _clean(vector_col).alias("v"))
    # a class is known by the first 128 bits of a hash of its vector; -0.0 counts as 0.0
    plain = F.array_join(F.transform("v", lambda x: (x + 0.0).cast("string")), ",")
    rows = rows.withColumn("c", F.when(F.col("v").isNotNull(), F.substring(F.unhex(F.sha2(plain, 256)), 1, 16)))
    classes = written(rows.where("c is not null").groupBy("c").agg(F.min("k").alias("rep"), F.count("*").alias("copies"), F.any_value("v").alias("v")))
    n_classes = classes.count()
    # exact: one table with one bucket, which is compared block by block
    bits, count = (0, 1) if exact else tables_for(n_classes, threshold, recall)
    signed = written(classes.select("c", "copies", "v").mapInArrow(_sign(bits, count), "c binary, copies long, dim int, v binary, sig array<int>, sketch binary"))
    in_tables = signed.select("c", "dim", "sketch", F.posexplode("sig").alias("t", "s"))
    hot = in_tables.groupBy("t", "dim", "s").agg(F.count("*").alias("n")).where(F.col("n") > (0 if exact else BLOCK))
    hot = written(hot.select("t", "dim", "s", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks")))
    lots = max(least_lots, -(-count * n_classes // ROWS_A_LOT))
    small = in_tables.join(hot, ["t", "dim", "s"], "left_anti").withColumn("lot", F.pmod(F.xxhash64("t", "dim", "s"), F.lit(lots)))
    near = small.groupBy("lot").applyInArrow(_sift(differing(threshold)), "c binary, t int, s int").withColumn("blocks", F.lit(1))
    near = near.unionByName(in_tables.join(hot, ["t", "dim", "s"]).select("c", "t", "s", "blocks"))
    # a class's places in the tables are as many as tables at most
    near = written(near.groupBy("c").agg(F.collect_list(F.struct("t", "s", "blocks")).alias("places")))
    met = signed.drop("sketch").join(near, "c").select("*", F.inline("places")).drop("places")
    met = met.withColumn("block", F.pmod(F.xxhash64("c"), F.col("blocks")).cast("int"))
    # a member goes to each pair of blocks that its own block is in
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    dealt = met.select("*", other.alias("o")).withColumns({"i": F.least("block", "o"), "j": F.greatest("block", "o")})
    # one Python call takes the block pairs of a lot; lots are as many as block pairs need, a few megabytes each
    rows_met = near.agg(F.sum(F.aggregate("places", F.lit(0).cast("long"), lambda a, p: a + p.blocks))).first()[0] or 0
    dealt = dealt.withColumn("lot", F.pmod(F.xxhash64("t", "dim", "s", "i", "j"), F.lit(max(least_lots, -(-rows_met // ROWS_A_LOT)))))
    met = written(dealt.groupBy("lot").applyInArrow(_compare(threshold), "c binary, links long, to binary"))
    found = written(connected_components(met.where("c != to").select(F.col("c").alias("a"), F.col("to").alias("b"))))
    counts = met.groupBy("c").agg(F.sum("links").alias("links"))
    linked = classes.select("c", "rep", "copies").join(counts, "c", "left").join(found, F.col("c") == found.node, "left")
    linked = linked.select("c", "rep", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "c").alias("component"))
    least = linked.groupBy("component").agg(F.min("rep").alias("least"))
    named = linked.join(least, "component").select("c", "n_links", "least")
    out = rows.select("k", "c").join(named, "c", "left").withColumn("least", F.coalesce("least", "k"))
    return out.select(real_id("k").alias("vec_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), real_id("least").alias("component_id"), (F.col("k") == F.col("least")).alias("kept"))
