"""SimHash near-duplicates found by decoding fingerprint segments with the binary Golay code."""

from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, id_column, partitions, real_id, tidy, written

SEED, LINK_BITS = 42, 3
#: Fixed value: the generator polynomial of the [23, 12, 7] Golay code.
GOLAY_POLYNOMIAL = 0b101011100011
#: A run of equal keys longer than this is cut by further segments before it is compared.
LONG_RUN = 4096
#: Keys that a fingerprint has at most, and keys that one bucket takes.
MOST_KEYS, BUCKET_KEYS = 48, 2_000_000


def fingerprint(text: bytes, shingle: int = 3) -> int:
    """Unsigned 64-bit SimHash of lower-cased word shingles; 0 for no words."""
    words = text.lower().split()
    if not words:
        return 0
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    begins = np.r_[0, ends[:-1] + 1][: len(words) - shingle + 1].tolist()
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(line[a:b], SEED) for a, b in zip(begins, ends[shingle - 1 :].tolist(), strict=True)], np.uint64)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(h), 65536):
        ones += np.unpackbits(h[at : at + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    bits = 2 * ones > len(h)
    return int(np.packbits(bits, bitorder="little").view(np.uint64)[0])


def _fingerprints(shingle: int):
    def run(batches):
        for batch in batches:
            fp = [fingerprint((t.as_py() or "").encode("utf-8", "surrogatepass"), shingle) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array(fp, np.uint64).view(np.int64))], names=["k", "fp"])

    return run


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """(k, fp): SimHash of every whole text; fp holds the 64 bits as a signed long."""
    rows = docs.select(id_column(id_col).alias("k"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return rows.mapInArrow(tidy(_fingerprints(shingle)), "k long, fp long")


@cache
def golay_keys() -> np.ndarray:
    """[65536, 6]: the indices of codewords near each 16-bit word (padded to 23 bits), -1 where there are fewer.

    Every 23-bit word lies within 3 bits of one codeword. If two words one bit apart have different
    nearest codewords, both lie at distance 3 from their own and 4 from the other's. So the nearest
    codeword and, for words at distance 3, the five at distance 4 make any two words within one bit
    share a key.
    """
    codewords = np.zeros(4096, np.uint32)
    for bit in range(12):
        with_bit = (np.arange(4096) >> bit & 1).astype(bool)
        codewords[with_bit] ^= np.uint32(GOLAY_POLYNOMIAL << bit)
    keys = np.full((65536, 6), -1, np.int16)
    for at in range(0, 65536, 4096):
        near = np.bitwise_count(np.arange(at, at + 4096, dtype=np.uint32)[:, None] ^ codewords[None, :])
        least = near.min(1)
        keys[at : at + 4096, 0] = near.argmin(1)
        rows, cols = np.nonzero((near == 4) & (least == 3)[:, None])
        place = np.arange(len(rows)) - np.searchsorted(rows, rows)
        keys[at + rows, 1 + place] = cols
    return keys


def _segments(fp: np.ndarray) -> list[np.ndarray]:
    return [(fp >> np.uint64(16 * i)).astype(np.uint64) & np.uint64(0xFFFF) for i in range(4)]


def pair_keys(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, key): keys of which two fingerprints within three bits share at least one.

    Of four segments with at most three errors together one has none; of any two of the other three
    at least one has at most one error. So a key is an exact segment and a codeword index of one of
    the two segments after it.
    """
    seg, table, rows, keys = _segments(fp), golay_keys(), [], []
    for i in range(4):
        for step in (1, 2):
            code = table[seg[(i + step) % 4].astype(np.int64)]
            row, col = np.nonzero(code >= 0)
            kind = np.uint64(2 * i + step - 1)
            rows.append(row)
            keys.append(kind << np.uint64(28) | seg[i][row] << np.uint64(12) | code[row, col].astype(np.uint64))
    return np.concatenate(rows), np.concatenate(keys)


def _finer_runs(fp: np.ndarray) -> list[np.ndarray]:
    """Index groups of a long run. Three of the four segments have at most one error, so segments 0 and 1 or 2 and 3 both share a key."""
    seg, table, out = _segments(fp), golay_keys(), []
    for i, j in ((0, 1), (2, 3)):
        a, b = table[seg[i].astype(np.int64)], table[seg[j].astype(np.int64)]
        row, x, y = np.nonzero((a >= 0)[:, :, None] & (b >= 0)[:, None, :])
        key = a[row, x].astype(np.int64) << 12 | b[row, y]
        by = np.argsort(key, kind="stable")
        out += [np.unique(row[g]) for g in np.split(by, np.flatnonzero(np.diff(key[by])) + 1) if len(g) > 1]
    return out


def _forest(fp: np.ndarray, bits: int) -> list[tuple[int, int]]:
    """A spanning forest of the links among ``fp``: each fingerprint is compared with those not yet reached."""
    left, edges = np.arange(len(fp)), []
    while len(left) > 1:
        front, left = [left[0]], left[1:]
        while front and len(left):
            x = front.pop()
            near = np.bitwise_count(fp[left] ^ fp[x]) <= bits
            if near.any():
                edges += [(x, y) for y in left[near].tolist()]
                front += left[near].tolist()
                left = left[~near]
    return edges


def _deal_keys(buckets: int):
    def run(batches):
        for batch in batches:
            fp = batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)
            row, key = pair_keys(fp)
            lot = (key * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)) % np.uint64(buckets)
            by = np.argsort(lot, kind="stable")
            cuts = np.searchsorted(lot[by], np.arange(buckets + 1, dtype=np.uint64))
            full = [b for b in range(buckets) if cuts[b] < cuts[b + 1]]
            parts = [by[cuts[b] : cuts[b + 1]] for b in full]
            yield pa.RecordBatch.from_arrays(
                [pa.array(full, pa.int32())] + [pa.array([x[i].tobytes() for i in parts], pa.binary()) for x in (key, fp[row])],
                names=["bucket", "keys", "fps"],
            )

    return run


def _verify(bits: int):
    def run(group: pa.Table) -> pa.Table:
        key, fp = (np.frombuffer(b"".join(group.column(c).to_pylist()), np.uint64) for c in ("keys", "fps"))
        by = np.argsort(key, kind="stable")
        key, fp = key[by], fp[by]
        heads = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        size = np.diff(np.r_[heads, len(key)])
        pairs = []
        short = np.repeat(size <= 64, size)
        for d in range(1, int(size[size <= 64].max(initial=1))):
            i = np.flatnonzero(short[:-d] & (key[d:] == key[:-d]))
            i = i[np.bitwise_count(fp[i] ^ fp[i + d]) <= bits]
            pairs.append((fp[i], fp[i + d]))
        for a, n in zip(heads[size > 64].tolist(), size[size > 64].tolist(), strict=True):
            f = fp[a : a + n]
            for part in [np.arange(n)] if n <= LONG_RUN else _finer_runs(f):
                if edges := _forest(f[part], bits):
                    e = part[np.array(edges)]
                    pairs.append((f[e[:, 0]], f[e[:, 1]]))
        a = np.concatenate([p[0] for p in pairs]) if pairs else np.empty(0, np.uint64)
        b = np.concatenate([p[1] for p in pairs]) if pairs else np.empty(0, np.uint64)
        e = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], 1), axis=0).view(np.int64)
        return pa.table({"a": pa.array(e[:, 0], pa.int64()), "b": pa.array(e[:, 1], pa.int64())})

    return run


def links(classes: DataFrame, bits: int = LINK_BITS) -> DataFrame:
    """(a, b): links between fingerprints; all components of the full link graph are connected by them.

    There are as many buckets of keys as the fingerprints need, each a task of its own.
    """
    if bits > LINK_BITS:
        raise ValueError(f"the keys hold for at most {LINK_BITS} differing bits")
    buckets = max(partitions(classes.sparkSession), -(-classes.count() * MOST_KEYS // BUCKET_KEYS))
    dealt = classes.select("fp").mapInArrow(tidy(_deal_keys(buckets)), "bucket int, keys binary, fps binary")
    return dealt.repartitionById(buckets, F.col("bucket")).groupBy("bucket").applyInArrow(_verify(bits), "a long, b long").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, bits: int = LINK_BITS) -> DataFrame:
    """Group documents whose SimHash fingerprints link at ``bits`` or fewer differing bits, directly or over others.

    Returns doc_id, fingerprint (16 hex digits) and component_id (smallest doc_id reachable).
    Equal fingerprints form one class before any comparison, so copies cost one row. Null, empty
    and white-space texts have fingerprint zero and link like any other; a null doc_id counts as
    the smallest id and stays null. Rows that share an id are kept, each with its own fingerprint.
    Other columns are ignored.
    """
    prints = written(fingerprints(docs, id_col, text_col, shingle))
    classes = written(prints.groupBy("fp").agg(F.min("k").alias("rep")))
    found = written(connected_components(links(classes, bits)))
    linked = classes.join(found, classes.fp == found.node, "left").select("fp", "rep", F.coalesce("component", "fp").alias("component"))
    least = linked.groupBy("component").agg(F.min("rep").alias("least"))
    named = linked.join(least, "component").select("fp", "least")
    return prints.join(named, "fp").select(real_id("k").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), real_id("least").alias("component_id"))
