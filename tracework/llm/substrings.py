"""Substring de-duplication: repeated fixed-length word windows merge into removal intervals."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Remembered, id_column, partitions, real_id, tidy

_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_MIX = np.uint64(0xD6E8FEB86659FD93)
#: Windows that one map chunk holds, and bytes of text whose windows one bucket takes.
CHUNK_WINDOWS, BUCKET_BYTES = 1_500_000, 24_000_000


def rolling(hashes: np.ndarray, width: int, base: int = _BASES[0]) -> np.ndarray:
    """Rabin-Karp hash of every ``width`` consecutive entries, modulo 2**64, by differences of prefix sums."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    powers = np.full(len(hashes), base, np.uint64)
    powers[0] = 1
    powers = np.multiply.accumulate(powers)
    sums = np.concatenate([np.zeros(1, np.uint64), np.add.accumulate(hashes * powers)])
    back = np.full(n, pow(base, -1, 2**64), np.uint64)
    back[0] = 1
    return (sums[width:] - sums[:-width]) * np.multiply.accumulate(back)


def _pack(k: np.ndarray, t: np.ndarray, doc: np.ndarray, start: np.ndarray) -> bytes:
    """Places ordered by document and start: ids and text numbers of the documents met (``doc`` indexes ``k`` and ``t``) with
    counts, then starts as one byte of their gap and a list of the larger rests. Text numbers that are all zero take no room."""
    ids, first, counts = np.unique(doc, return_index=True, return_counts=True)
    gap = np.diff(start, prepend=0)
    gap[first] = start[first]
    rest = np.flatnonzero(gap >> 8)
    key, text = k[ids], t[ids]
    step = np.diff(key, prepend=key[:1])
    wide = len(ids) and (int(step.max(initial=0)) >= 2**32 or int(step.min(initial=0)) < 0)
    told = bool(text.any())
    head = np.array([len(doc), len(ids), len(rest), bool(wide), told, key[0] if len(ids) else 0], np.int64)
    return b"".join(
        [head.tobytes(), step.astype(np.int64 if wide else np.uint32).tobytes(), text.tobytes() if told else b"", counts.astype(np.uint32).tobytes()]
        + [(gap & 255).astype(np.uint8).tobytes(), rest.astype(np.uint32).tobytes(), (gap[rest] >> 8).astype(np.uint32).tobytes()]
    )


def _unpack(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(k, t, start) of every place."""
    n, docs, r, wide, told, low = np.frombuffer(blob, np.int64, 6).tolist()
    at = 48
    kind = np.int64 if wide else np.uint32
    step = np.frombuffer(blob, kind, docs, at).astype(np.int64)
    at += step.size * np.dtype(kind).itemsize
    text = np.frombuffer(blob, np.int64, docs, at) if told else np.zeros(docs, np.int64)
    at += 8 * docs * told
    counts = np.frombuffer(blob, np.uint32, docs, at).astype(np.int64)
    at += 4 * docs
    gap = np.frombuffer(blob, np.uint8, n, at).astype(np.int64)
    at += n
    rest = np.frombuffer(blob, np.uint32, r, at)
    gap[rest] += np.frombuffer(blob, np.uint32, r, at + 4 * r).astype(np.int64) << 8
    total = np.cumsum(gap)
    begin = np.cumsum(counts) - counts
    base = total[begin] - gap[begin]
    ids = np.cumsum(step) + low if docs else step
    return np.repeat(ids, counts), np.repeat(text, counts), total - np.repeat(base, counts)


def _map_windows(width: int, buckets: int):
    def flush(docs: dict[tuple[int, int], np.ndarray]) -> pa.RecordBatch:
        names = sorted(docs)
        k, t = (np.array([n[i] for n in names], np.int64) for i in (0, 1))
        sizes = np.array([len(docs[n]) for n in names], np.int64)
        flat = np.concatenate([docs[n] for n in names])
        begin = np.cumsum(sizes) - sizes
        doc = np.repeat(np.arange(len(names)), sizes)
        start = np.arange(len(flat)) - begin[doc]
        whole = np.flatnonzero(start[: len(flat) - width + 1] <= sizes[doc[: len(flat) - width + 1]] - width)
        doc, start = doc[whole], start[whole]
        key = rolling(flat, width, _BASES[0])[whole]
        # the second hash stirs the words' numbers, so that windows must agree in both
        other = rolling((flat ^ (flat >> np.uint64(31))) * _MIX, width, _BASES[1])[whole]
        key = (key & ~np.uint64(255)) | (other >> np.uint64(56))
        tail = (other >> np.uint64(48)).astype(np.uint8)
        # the first place of each window goes on; what follows it here is repeated for certain
        by = np.argsort(key, kind="stable")
        same = np.r_[False, (key[by][1:] == key[by][:-1]) & (tail[by][1:] == tail[by][:-1])]
        go, dup = np.sort(by[~same]), np.sort(by[same])
        bucket = ((((other >> np.uint64(4)) & np.uint64(0xFFFFFFFF)) * _MIX >> np.uint64(32)) % np.uint64(buckets))[go]
        by = np.argsort(bucket.astype(np.int32), kind="stable")
        cuts = np.searchsorted(bucket[by], np.arange(buckets + 1, dtype=np.uint64))
        rows = []
        for b in np.flatnonzero(np.diff(cuts)).tolist():
            i = go[by[cuts[b] : cuts[b + 1]]]
            rows.append((b, key[i].tobytes() + tail[i].tobytes(), _pack(k, t, doc[i], start[i]), None))
        if len(dup):
            # any bucket will do for these; they are dealt by document
            lot = k[doc[dup]] % buckets
            for b in np.unique(lot).tolist():
                i = dup[lot == b]
                rows.append((b, None, None, _pack(k, t, doc[i], start[i])))
        return pa.RecordBatch.from_arrays(
            [pa.array([r[0] for r in rows], pa.int32())] + [pa.array([r[i] for r in rows], pa.binary()) for i in (1, 2, 3)],
            names=["bucket", "hashes", "places", "repeated"],
        )

    def run(batches):
        words, docs, held = Remembered(xxhash.xxh3_64_intdigest), {}, 0
        for batch in batches:
            for k, t, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                text = text.as_py()
                parts = text.encode("utf-8", "surrogatepass").split() if text else ()
                # equal rows are one document
                if len(parts) < width or (k, t) in docs:
                    continue
                docs[k, t] = np.fromiter(map(words.__getitem__, parts), np.uint64, len(parts))
                held += len(parts)
                if held >= CHUNK_WINDOWS:
                    yield flush(docs)
                    docs, held = {}, 0
        if docs:
            yield flush(docs)

    return run


def _reduce_bucket(lots: int):
    def run(group: pa.Table) -> pa.Table:
        keys, tails, places, out = [], [], [], []
        for h, place, repeated in zip(group.column("hashes"), group.column("places"), group.column("repeated"), strict=True):
            if repeated.is_valid:
                out.append(_unpack(repeated.as_py()))
                continue
            raw = h.as_py()
            n = len(raw) // 9
            keys.append(np.frombuffer(raw, np.uint64, n))
            tails.append(np.frombuffer(raw, np.uint8, n, 8 * n))
            places.append(place.as_py())
        if keys:
            key, tail = np.concatenate(keys), np.concatenate(tails)
            sizes = np.cumsum([0, *map(len, keys)])
            del keys, tails
            by = np.argsort(key, kind="stable")
            again = key[by][1:] == key[by][:-1]
            shared = np.sort(by[np.r_[again, False] | np.r_[False, again]])
            del by, again
            # places are unpacked piece by piece, for windows that stand more than once only
            cuts = np.searchsorted(shared, sizes)
            parts = [tuple(c[shared[a:b] - n] for c in _unpack(p)) for p, n, a, b in zip(places, sizes, cuts, cuts[1:], strict=False) if a < b]
            if parts:
                k, t, s = (np.concatenate([p[i] for p in parts]) for i in range(3))
                key, tail = key[shared], tail[shared]
                by = np.lexsort((s, t, k, tail, key))
                key, tail, k, t, s = (c[by] for c in (key, tail, k, t, s))
                new = np.r_[True, (key[1:] != key[:-1]) | (tail[1:] != tail[:-1])]
                lead = np.maximum.accumulate(np.where(new, np.arange(len(key)), 0))
                later = (k != k[lead]) | (t != t[lead]) | (s != s[lead])
                out.append((k[later], t[later], s[later]))
        k, t, s = (np.concatenate([o[i] for o in out]) if out else np.empty(0, np.int64) for i in range(3))
        # what is repeated goes on in one piece for each lot of documents
        lot = ((k.view(np.uint64) ^ (t.view(np.uint64) >> np.uint64(7))) * _MIX >> np.uint64(33)) % np.uint64(lots)
        by = np.lexsort((s, t, k, lot))
        k, t, s, lot = k[by], t[by], s[by], lot[by]
        full, first = np.unique(lot, return_index=True)
        blobs = [_pack(*_docs(k[a:b], t[a:b]), s[a:b]) for a, b in zip(first, np.r_[first[1:], len(k)][: len(first)], strict=True)]
        return pa.table({"lot": pa.array(full.astype(np.int32)), "repeated": pa.array(blobs, pa.binary())})

    return run


def _docs(k: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct documents of ordered places, and the index of each place's."""
    new = np.r_[True, (k[1:] != k[:-1]) | (t[1:] != t[:-1])][: len(k)]
    return k[new], t[new], np.cumsum(new) - 1


def _merge_lot(group: pa.Table) -> pa.Table:
    parts = [_unpack(x.as_py()) for x in group.column("repeated")]
    k, t, s = (np.concatenate([p[i] for p in parts]) for i in range(3))
    by = np.lexsort((s, t, k))
    k, t, s = k[by], t[by], s[by].astype(np.uint32)
    ids, texts, doc = _docs(k, t)
    first = np.searchsorted(doc, np.arange(len(ids) + 1))
    blobs = [s[a:b].tobytes() for a, b in zip(first, first[1:], strict=False)]
    return pa.table({"k": pa.array(ids, pa.int64()), "t": pa.array(texts, pa.int64()), "starts": pa.array(blobs, pa.binary())})


def intervals(starts: bytes | None, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Maximal [begin, end) word intervals that the windows at ``starts`` cover."""
    at = np.unique(np.frombuffer(starts or b"", np.uint32)).astype(np.int64)
    if not len(at):
        return at, at
    new = np.r_[True, np.diff(at) > width]
    return at[new], at[np.r_[new[1:], True]] + width


def _rows(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, int]:
    """(k, t, text) of every row, and the bytes of all texts. t tells texts that share an id apart; it is 0 throughout where no two do."""
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    rows = docs.select(id_column(id_col).alias("k"), text.alias("text"))
    per_id = rows.groupBy("k").agg(F.min(F.xxhash64("text")).alias("low"), F.max(F.xxhash64("text")).alias("high"), F.sum(F.octet_length("text")).alias("bytes"))
    known = per_id.agg(F.sum("bytes"), F.max((F.col("low") != F.col("high")).cast("int"))).first()
    t = F.xxhash64("text") if known[1] else F.lit(0).cast("long")
    return rows.select("k", t.alias("t"), "text"), known[0] or 0


def _repeated(rows: DataFrame, width: int, buckets: int) -> DataFrame:
    dealt = rows.mapInArrow(tidy(_map_windows(width, buckets)), "bucket int, hashes binary, places binary, repeated binary")
    found = dealt.repartitionById(buckets, F.col("bucket")).groupBy("bucket").applyInArrow(_reduce_bucket(buckets), "lot int, repeated binary")
    return found.repartitionById(buckets, F.col("lot")).groupBy("lot").applyInArrow(_merge_lot, "k long, t long, starts binary")


def repeated_windows(docs: DataFrame, width: int = 20, id_col: str = "doc_id", text_col: str = "text", buckets: int | None = None) -> DataFrame:
    """(k, t, starts): for each document, the starts (uint32, little endian) of windows that also start earlier.

    A document is an id and a text; t tells texts with one id apart. Every window of every whole
    text is hashed (Rabin-Karp over 64-bit word hashes, with two bases) and counted: a map chunk
    keeps the first of equal windows and knows the others for repeated, so one window reaches its
    bucket once a chunk however often it occurs; buckets get 9 bytes of hash and about two of
    place a window. A window is known by those 72 bits and its bucket, which other bits choose: 10**12
    windows have some 10**5 buckets, and one false match among them is met with a chance below 0.001. There are as many
    buckets as the texts' bytes need, each a task of its own and of the same size.
    """
    rows, n_bytes = _rows(docs, id_col, text_col)
    return _repeated(rows, width, buckets or _buckets(docs, n_bytes))


def _buckets(docs: DataFrame, n_bytes: int) -> int:
    return max(partitions(docs.sparkSession), -(-n_bytes // BUCKET_BYTES))


def _cut(width: int):
    def run(batches):
        for batch in batches:
            out = []
            for text, starts in zip(batch.column(1), batch.column(2), strict=True):
                parts = text.as_py().encode("utf-8", "surrogatepass").split()
                begin, end = intervals(starts.as_py(), width)
                kept, last = [], 0
                for a, b in zip(begin.tolist(), end.tolist(), strict=True):
                    kept += parts[last:a]
                    last = b
                kept += parts[last:]
                spans = ",".join(f"{a}:{b}" for a, b in zip(begin.tolist(), end.tolist(), strict=True))
                out.append((len(parts), len(parts) - len(kept), b" ".join(kept), spans))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([r[0] for r in out], pa.int64()), pa.array([r[1] for r in out], pa.int64())]
                + [pa.array([hashlib.sha256(r[2]).hexdigest() for r in out]), pa.array([r[3] for r in out]), pa.array([r[2] for r in out], pa.binary())],
                names=["k", "n_words", "n_removed", "kept_sha256", "removed_spans", "kept"],
            )

    return run


def dedup_substrings(docs: DataFrame, width: int = 20, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False) -> DataFrame:
    """Remove every word covered by a window of ``width`` words that starts earlier elsewhere.

    Earlier: a smaller document id, or the same document and an earlier start; judged on the
    input. Returns doc_id, n_words, n_removed, kept_sha256, removed_spans (maximal word intervals
    ``begin:end``) and, if asked, kept_text (kept words joined by one space).

    Null or empty texts have no words. Equal rows are one document, so they don't remove each other.
    Rows that share an id and differ in text are documents of their own, in the order of a hash of
    their texts; so are rows without an id, which come first. Other columns are ignored.
    """
    rows, n_bytes = _rows(docs, id_col, text_col)
    found = _repeated(rows, width, _buckets(docs, n_bytes))
    cut = rows.join(found, ["k", "t"], "left").select("k", "text", "starts")
    out = cut.mapInArrow(_cut(width), "k long, n_words long, n_removed long, kept_sha256 string, removed_spans string, kept binary")
    cols = [real_id("k").alias("doc_id"), "n_words", "n_removed", "kept_sha256", "removed_spans"]
    return out.select(*cols, *([F.decode("kept", "UTF-8").alias("kept_text")] if with_text else []))
