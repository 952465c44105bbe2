"""Vector code compression: product codes by Lloyd rounds with Yinyang bounds, all in integers where it decides."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import NULL_ID, dropped, id_column, real_id, tidy, written

PARTS, ENTRIES, ROUNDS, SCALE, GROUPS = 8, 16, 6, 4096, 4
#: Integer components stop at this size either way, so that sums of squares stay within 64 bits.
MOST = 2**24
_BATCH = 4096
_STATE = "k long, label string, v binary, code binary, upper binary, lower binary"


def integers(column: str) -> Column:
    """floor(SCALE * x) of each component; null if the vector is null or holds a null or non-finite component."""
    x = F.transform(F.col(f"`{column}`"), lambda v: v.cast("double"))
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    return F.when(finite, F.transform(x, lambda v: F.floor(F.greatest(F.lit(-float(MOST)), F.least(F.lit(float(MOST)), v * SCALE))).cast("int")))


def entry_groups(book: np.ndarray, count: int = GROUPS) -> np.ndarray:
    """Group of each codebook entry: a few rounds of Lloyd over the entries, begun at entries far from one another."""
    x = book.astype(np.float64)
    centres = [x[0]]
    while len(centres) < min(count, len(x)):
        centres.append(x[np.argmax(np.min([((x - c) ** 2).sum(1) for c in centres], axis=0))])
    centres = np.array(centres)
    for _ in range(5):
        own = ((x[:, None] - centres[None]) ** 2).sum(2).argmin(1)
        centres = np.array([x[own == g].mean(0) if (own == g).any() else centres[g] for g in range(len(centres))])
    return own


def _apart(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Exact squared distances of the rows of ``x`` to the rows of ``entries``, as int64."""
    return np.stack([((x - e) ** 2).sum(1) for e in entries], axis=1) if len(entries) else np.empty((len(x), 0), np.int64)


def _up(d):
    return (np.asarray(d, np.float64) * (1 + 1e-6) + 1e-6).astype(np.float32)


def _down(d):
    return np.maximum(np.asarray(d, np.float64) * (1 - 1e-6) - 1e-6, 0).astype(np.float32)


def assign_first(x: np.ndarray, book: np.ndarray, groups: np.ndarray, n_groups: int):
    """Nearest entry (ties to the lower index), an upper bound of its distance, and per group a lower bound of that of its other entries."""
    d = _apart(x, book)
    own = d.argmin(1)
    root = np.sqrt(d.astype(np.float64))
    upper = _up(root[np.arange(len(x)), own])
    root[np.arange(len(x)), own] = np.inf
    lower = np.stack([_down(root[:, groups == g].min(1)) if (groups == g).any() else np.full(len(x), np.inf, np.float32) for g in range(n_groups)], axis=1)
    return own, upper, lower


def assign_again(x: np.ndarray, book: np.ndarray, before: np.ndarray, groups: np.ndarray, own: np.ndarray, upper: np.ndarray, lower: np.ndarray):
    """The same after the entries moved from ``before`` to ``book``: only groups whose drift-adjusted bound fails are scanned.

    Bounds are rounded outwards, so an entry as near as the own one is always scanned; what decides is the
    integer distance and then the index. Returns own, upper, lower and the number of distances computed.
    """
    drift = np.sqrt(((book - before).astype(np.float64) ** 2).sum(1))
    n_groups = lower.shape[1]
    moved = np.array([drift[groups == g].max(initial=0.0) for g in range(n_groups)])
    upper, lower, own = _up(upper + drift[own]), _down(lower - moved[None]), own.copy()
    open_ = np.flatnonzero(lower.min(1, initial=np.inf) <= upper)
    made = len(open_)
    if not made:
        return own, upper, lower, 0
    # tighten the bound of the own entry
    exact = ((x[open_] - book[own[open_]]) ** 2).sum(1)
    upper[open_] = _up(np.sqrt(exact.astype(np.float64)))
    fails = lower[open_] <= upper[open_, None]
    best, old, least = own[open_].copy(), own[open_], exact.copy()
    scanned = {}
    for g in range(n_groups):
        at = np.flatnonzero(fails[:, g])
        members = np.flatnonzero(groups == g)
        if not len(at) or not len(members):
            continue
        d = _apart(x[open_[at]], book[members])
        made += d.size
        scanned[g] = at, members, d
        pick = d.argmin(1)  # the lowest index of equals
        near, entry = d[np.arange(len(at)), pick], members[pick]
        better = (near < least[at]) | ((near == least[at]) & (entry < best[at]))
        best[at[better]], least[at[better]] = entry[better], near[better]
    for g, (at, members, d) in scanned.items():
        root = np.sqrt(d.astype(np.float64))
        root[members[None] == best[at][:, None]] = np.inf
        lower[open_[at], g] = _down(root.min(1))
    # the entry left behind is one of the others of its group
    left = np.flatnonzero(best != old)
    if len(left):
        g = groups[old[left]]
        lower[open_[left], g] = np.minimum(lower[open_[left], g], _down(np.sqrt(exact[left].astype(np.float64))))
    own[open_] = best
    upper[open_] = _up(np.sqrt(least.astype(np.float64)))
    return own, upper, lower, made


def _blobs(a: np.ndarray) -> pa.Array:
    a = np.ascontiguousarray(a)
    size = a.itemsize * int(np.prod(a.shape[1:]))
    return pa.array([bytes(x) for x in a.reshape(len(a), -1).view(np.uint8).reshape(len(a), size)], pa.binary()) if size else pa.array([b""] * len(a), pa.binary())


def _array(column: pa.Array, kind, shape: tuple[int, ...]) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), *shape)


def _small(batches):
    for batch in batches:
        for at in range(0, batch.num_rows, _BATCH):
            yield batch.slice(at, _BATCH)


def _assign(books: np.ndarray, before: np.ndarray | None, groups: np.ndarray):
    parts, _, width = books.shape

    def run(batches):
        for batch in _small(batches):
            n = batch.num_rows
            x = _array(batch.column("v"), np.int32, (parts, width)).astype(np.int64)
            code = np.empty((n, parts), np.uint8)
            upper, lower = np.empty((n, parts), np.float32), np.empty((n, parts, GROUPS), np.float32)
            if before is not None:
                old = _array(batch.column("code"), np.uint8, (parts,)).astype(np.int64)
                u, w = _array(batch.column("upper"), np.float32, (parts,)), _array(batch.column("lower"), np.float32, (parts, GROUPS))
            for p in range(parts):
                if before is None:
                    code[:, p], upper[:, p], lower[:, p] = assign_first(x[:, p], books[p], groups[p], GROUPS)
                else:
                    code[:, p], upper[:, p], lower[:, p], _ = assign_again(x[:, p], books[p], before[p], groups[p], old[:, p], u[:, p], w[:, p])
            yield pa.RecordBatch.from_arrays([batch.column("k"), batch.column("label"), batch.column("v"), _blobs(code), _blobs(upper), _blobs(lower)], names=["k", "label", "v", "code", "upper", "lower"])

    return run


def _sums(parts: int, entries: int, width: int):
    """Sum and count of the parts of each entry, a task's at once: (slot, at, n), at -1 for the count."""

    def run(batches):
        total, count = np.zeros((parts, entries, width), np.int64), np.zeros((parts, entries), np.int64)
        for batch in _small(batches):
            x = _array(batch.column("v"), np.int32, (parts, width)).astype(np.int64)
            code = _array(batch.column("code"), np.uint8, (parts,))
            for p in range(parts):
                np.add.at(total[p], code[:, p], x[:, p])
                count[p] += np.bincount(code[:, p], minlength=entries)
        every = np.concatenate([count[:, :, None], total], axis=2).reshape(parts * entries, width + 1)
        slot, at = np.nonzero(every)
        yield pa.RecordBatch.from_arrays([pa.array(slot.astype(np.int32)), pa.array((at - 1).astype(np.int32)), pa.array(every[slot, at])], names=["slot", "at", "n"])

    return run


def _told(books: np.ndarray):
    parts, _, width = books.shape

    def run(batches):
        for batch in _small(batches):
            x = _array(batch.column("v"), np.int32, (parts, width)).astype(np.int64)
            code = _array(batch.column("code"), np.uint8, (parts,))
            error = sum(((x[:, p] - books[p][code[:, p]]) ** 2).sum(1) for p in range(parts))
            names = [bytes(c).hex() for c in code]
            yield pa.RecordBatch.from_arrays([batch.column("k"), batch.column("label"), pa.array(names), pa.array(error, pa.int64())], names=["k", "label", "code", "error"])

    return run


def codebooks(kept: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[np.ndarray, DataFrame]:
    """(parts, entries, width) codebooks after ``rounds`` of Lloyd over ``kept`` (k, label, v), and the state (v, code, bounds) under them.

    A round assigns parts and moves each entry to the floor of its parts' mean. The state of a round, bounds included, is a table
    in the shared folder, from which the next round starts; the one before goes. Only sums of entries reach the driver.
    """
    spark = kept.sparkSession
    width = -(-(kept.agg(F.max(F.size("v"))).first()[0] or 0) // parts)
    first = [r.v for r in kept.orderBy("k", "v").limit(entries).collect()]
    books = np.zeros((len(first), parts * width), np.int64)
    for i, v in enumerate(first):
        books[i, : len(v)] = v
    books = books.reshape(len(first), parts, width).transpose(1, 0, 2).copy()
    groups = np.array([entry_groups(b) if len(b) else np.empty(0, np.int64) for b in books])

    def packed(batches):
        for batch in _small(batches):
            vectors = batch.column("v").to_pylist()
            x = np.zeros((len(vectors), parts * width), np.int32)
            for i, v in enumerate(vectors):
                x[i, : len(v)] = v
            empty = pa.array([b""] * len(vectors), pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("k"), batch.column("label"), _blobs(x), empty, empty, empty], names=["k", "label", "v", "code", "upper", "lower"])

    state = kept.mapInArrow(packed, _STATE)
    before, held = None, None
    for n in range(rounds + 1):
        now = written(state.mapInArrow(tidy(_assign(books, before, groups)), _STATE)) if len(first) else written(state)
        if held is not None:
            dropped(held)
        state = held = now
        if n == rounds or not len(first):
            break
        sums = state.select("v", "code").mapInArrow(_sums(parts, len(first), width), "slot int, at int, n long").groupBy("slot", "at").agg(F.sum("n").alias("n"))
        # as many rows as the codebooks have components
        found = sums.toArrow()
        every = np.zeros((parts * len(first), width + 1), np.int64)
        every[found.column("slot").to_numpy(), found.column("at").to_numpy() + 1] = found.column("n").to_numpy()
        every = every.reshape(parts, len(first), width + 1)
        before, books = books, np.where(every[:, :, :1] > 0, every[:, :, 1:] // np.maximum(every[:, :, :1], 1), books)
    return books, spark.read.schema(_STATE).parquet(held._tracework_path)


def codes(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """vec_id, code, error, label_error and codebooks_sha256 for every vector whose components are all finite numbers.

    Codebooks start as the parts of the ``entries`` smallest ids (of rows that share an id, or have none, by
    component; null ids first); with fewer vectors they have fewer entries. Each round assigns every part to the nearest entry,
    ties to the lower index, and moves entries to the floor of the mean; unused entries stay. error is the squared distance
    to the assigned entries, label_error its sum over equal labels, nulls together.

    Vectors that are null or hold a null or non-finite component are dropped. Vectors shorter than the longest one, or than
    a multiple of ``parts``, are filled with zeros. Components whose integer lies beyond 2**24 either way stand for that bound. Repeated
    rows count each. An empty table gives an empty one. Other columns are ignored.
    """
    rows = vectors.select(id_column(id_col).alias("k"), F.col(f"`{label_col}`").cast("string").alias("label"), integers(vector_col).alias("v"))
    books, state = codebooks(written(rows.where("v is not null")), parts, entries, rounds)
    digest = hashlib.sha256(",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()
    if not books.size and not books.shape[1]:
        told = state.select("k", "label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"))
    else:
        told = state.select("k", "label", "v", "code").mapInArrow(_told(books), "k long, label string, code string, error long")
    told = written(told)
    # a label has one row; each task adds up its own first
    sums = told.groupBy(F.col("label").alias("l")).agg(F.sum(F.col("error").cast("decimal(38,0)")).alias("label_error"))
    out = told.join(sums, F.col("label").eqNullSafe(F.col("l")))
    return out.select(real_id("k").alias("vec_id"), "code", "error", F.least("label_error", F.lit(2**63 - 1)).cast("long").alias("label_error"), F.lit(digest).alias("codebooks_sha256"))
