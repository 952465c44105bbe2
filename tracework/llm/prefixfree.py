"""Suffix-array de-duplication of bytes by prefix-free parsing: rolling-hash triggers cut phrases, orders of dictionary and parse give the corpus order."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import partitions, real_id, tidy, written
from .substrings import _docs, _pack, _rows, _unpack

#: Bytes of a window; bytes of a trigger; one position in so many is a trigger.
WIDTH, TRIGGER, DENSITY = 400, 16, 52
#: Bytes parsed at once; bytes of a document's piece; parse entries a chunk holds; bytes of text whose entries one bucket takes.
BLOCK, PIECE, CHUNK, BUCKET_BYTES = 1_000_000, 1_000_000, 1_000_000, 48_000_000
#: Entries ordered by one call; entries of one stretch of phrases from which their windows are counted in Spark instead.
LOT, HOT = 20_000, 5_000
_BASE = 0x9E3779B97F4A7C15
_MIX = np.uint64(0xD6E8FEB86659FD93)
_DIGITS = np.random.default_rng(11).integers(0, 2**64, 256, np.uint64)


def _stir(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _MIX
    x = (x ^ (x >> np.uint64(29))) * _MIX
    return x ^ (x >> np.uint64(32))


@lru_cache(maxsize=1)
def _table(n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(n, _BASE, np.uint64), np.full(n, pow(_BASE, -1, 2**64), np.uint64)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, ``n`` at least."""
    return _table(max(BLOCK + PIECE + 4096, n))


class Parse(NamedTuple):
    """Entries of the parse of some documents: runs of windows that begin at ``lo`` to ``hi`` of document ``doc`` and hold the same triggers.

    ``first`` and ``last`` are where the first and the last trigger of these windows end, in ``data`` (which has ``lo`` at
    ``at``); both are -1 for a window without a trigger, which is an entry of its own.
    """

    doc: np.ndarray
    lo: np.ndarray
    hi: np.ndarray
    at: np.ndarray
    first: np.ndarray
    last: np.ndarray
    data: np.ndarray
    sums: np.ndarray

    def hashes(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Rabin-Karp hashes of ``data[begin:end]``, stirred with the lengths."""
        down = _powers(len(self.sums))[1]
        return _stir((self.sums[end] - self.sums[begin]) * down[begin] + (end - begin).astype(np.uint64) * _MIX)


def _parse(pieces: list[tuple[int, int, bytes]], width: int, trigger: int, density: int) -> Parse:
    """Parse of (document, place of the piece in it, bytes) together."""
    data = np.frombuffer(b"".join(p[2] for p in pieces), np.uint8)
    sizes = np.array([len(p[2]) for p in pieces], np.int64)
    end = np.cumsum(sizes)
    begin = end - sizes
    up, down = _powers(len(data) + 1)
    sums = np.concatenate([np.zeros(1, np.uint64), np.add.accumulate(_DIGITS[data] * up[: len(data)])])
    # triggers: a position ends one if the hash of the bytes before it is a multiple of the density
    n = max(len(data) - trigger + 1, 0)
    rolling = _stir((sums[trigger:] - sums[: n and -trigger]) * down[:n]) if n else np.empty(0, np.uint64)
    cut = np.flatnonzero((rolling >> np.uint64(33)) % np.uint64(density) == 0) + trigger
    piece = np.searchsorted(end, cut, "left")
    inside = cut - trigger >= begin[piece] if len(cut) else np.empty(0, bool)
    cut, piece = cut[inside], piece[inside]
    # where the first or the last trigger of the window changes, a run begins
    whole = np.flatnonzero(sizes >= width)
    at = np.concatenate([begin[whole], cut - trigger + 1, cut - width])
    own = np.concatenate([whole, piece, piece])
    ok = (at >= begin[own]) & (at <= end[own] - width)
    at = np.unique(at[ok])
    own = np.searchsorted(end, at, "right")
    hi = np.r_[at[1:] - 1, np.int64(-1)][: len(at)]
    hi = np.where(np.r_[own[1:] == own[:-1], False][: len(at)], hi, end[own] - width)
    f, t = np.searchsorted(cut, at + trigger, "left"), np.searchsorted(cut, at + width, "right") - 1
    free = np.flatnonzero(f > t)
    held = np.flatnonzero(f <= t)
    counts = hi[free] - at[free] + 1
    alone = np.repeat(at[free], counts) + np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    at, hi = np.r_[at[held], alone], np.r_[hi[held], alone]
    none = np.full(len(alone), -1, np.int64)
    first, last = np.r_[cut[f[held]], none], np.r_[cut[t[held]], none]
    own = np.r_[own[held], np.repeat(own[free], counts)]
    shift = np.array([p[1] for p in pieces], np.int64)[own] - begin[own]
    return Parse(np.array([p[0] for p in pieces], np.int64)[own], at + shift, hi + shift, at, first, last, data, sums)


def parses(texts: Iterator[bytes], width: int = WIDTH, trigger: int = TRIGGER, density: int = DENSITY) -> Iterator[Parse]:
    """Parses of documents, a block at a time. A long document is parsed in pieces that overlap by a window, always the same ones."""
    held, size = [], 0
    for doc, text in enumerate(texts):
        for at in range(0, max(len(text) - width + 1, 0), PIECE):
            piece = text[at : at + PIECE + width - 1]
            held.append((doc, at, piece))
            size += len(piece)
            if size >= BLOCK:
                yield _parse(held, width, trigger, density)
                held, size = [], 0
    if held:
        yield _parse(held, width, trigger, density)


def _keys(p: Parse, width: int, trigger: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each entry: a hash of its stretch of phrases, from the first to the last trigger, and one of what stands on both sides."""
    free = p.first < 0
    begin, end = np.where(free, p.at, p.first - trigger), np.where(free, p.at + width, p.last)
    key = p.hashes(begin, end)
    left = p.hashes(p.at, np.where(free, p.at + width // 2, p.first))
    right = p.hashes(np.where(free, p.at, p.last), np.where(free, p.at, p.at + (p.hi - p.lo) + width))
    sides = _stir(left * _MIX + right + (p.hi - p.lo).astype(np.uint64))
    return key, sides >> np.uint64(25)  # 39 bits


def _utf8(column: pa.ChunkedArray | pa.Array) -> Iterator[bytes]:
    for x in column.cast(pa.binary()):
        yield x.as_py() or b""


def _map_entries(width: int, trigger: int, density: int, buckets: int):
    def flush(names: list[tuple[int, int]], parts: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        key, sides, doc, lo = (np.concatenate([x[i] for x in parts]) for i in range(4))
        order = sorted(range(len(names)), key=names.__getitem__)
        rank = np.empty(len(names), np.int64)
        rank[order] = np.arange(len(names))
        k, t = (np.array([names[i][c] for i in order], np.int64) for c in (0, 1))
        doc = rank[doc]
        by = np.lexsort((lo, doc, sides, key))
        key, sides, doc, lo = key[by], sides[by], doc[by], lo[by]
        new_key = np.r_[True, key[1:] != key[:-1]]
        new = new_key | np.r_[True, sides[1:] != sides[:-1]]
        again = ~new
        repeated = again | np.r_[again[1:], False]  # equal on both sides within the chunk
        lead = np.flatnonzero(new_key)
        several = np.add.reduceat(new.astype(np.int64), lead) > 1 if len(lead) else np.empty(0, bool)
        contested = np.repeat(several, np.diff(np.r_[lead, len(key)])) & new
        rows = []
        bucket = (key[lead] >> np.uint64(7)) % np.uint64(buckets)
        by = np.lexsort((lo[lead], doc[lead], bucket))
        cuts = np.searchsorted(bucket[by], np.arange(buckets + 1, dtype=np.uint64))
        tail = sides[lead] | (several.astype(np.uint64) << np.uint64(39))
        for b in np.flatnonzero(np.diff(cuts)).tolist():
            i = by[cuts[b] : cuts[b + 1]]
            five = tail[i].view(np.uint8).reshape(-1, 8)[:, :5]
            rows.append((b, key[lead[i]].tobytes() + five.tobytes(), _pack(k, t, doc[lead[i]], lo[lead[i]]), None, None))
        # what the chunk knows goes on by document
        lot = (_stir(k.view(np.uint64)) % np.uint64(buckets)).astype(np.int64)
        known = [np.flatnonzero(x) for x in (repeated, contested)]
        for b in np.unique(np.concatenate([lot[doc[x]] for x in known])).tolist():
            blobs = []
            for x in known:
                i = x[lot[doc[x]] == b]
                i = i[np.lexsort((lo[i], doc[i]))]
                blobs.append(_pack(k, t, doc[i], lo[i]) if len(i) else None)
            rows.append((b, None, None, *blobs))
        kinds = [pa.int32(), *[pa.binary()] * 4]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kinds[i]) for i in range(5)], names=["bucket", "hashes", "places", "repeated", "contested"])

    def run(batches):
        names, parts, held = [], [], 0
        for batch in batches:
            k, t = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for p in parses(_utf8(batch.column(2)), width, trigger, density):
                used, doc = np.unique(p.doc, return_inverse=True)
                parts.append((*_keys(p, width, trigger), doc + len(names), p.lo))
                names += [(k[i], t[i]) for i in used.tolist()]
                held += len(p.lo)
                if held >= CHUNK:
                    yield flush(names, parts)
                    names, parts, held = [], [], 0
        if held:
            yield flush(names, parts)

    return run


def _by_lot(kinds: list[list[tuple[np.ndarray, ...]]], lots: int) -> pa.Table:
    """Places of each kind in one piece for each lot of documents."""
    found: dict[int, list[bytes | None]] = {}
    for n, places in enumerate(kinds):
        k, t, s = (np.concatenate([o[i] for o in places]) if places else np.empty(0, np.int64) for i in range(3))
        lot = _stir(k.view(np.uint64) ^ (t.view(np.uint64) >> np.uint64(7))) % np.uint64(lots)
        by = np.lexsort((s, t, k, lot))
        k, t, s, lot = k[by], t[by], s[by], lot[by]
        full, first = np.unique(lot, return_index=True)
        for at, a, b in zip(full.tolist(), first, np.r_[first[1:], len(k)][: len(first)], strict=True):
            found.setdefault(at, [None, None])[n] = _pack(*_docs(k[a:b], t[a:b]), s[a:b])
    cols = [pa.array([x[n] for x in found.values()], pa.binary()) for n in (0, 1)]
    return pa.table({"lot": pa.array(list(found), pa.int32()), "repeated": cols[0], "contested": cols[1]})


def _reduce_entries(lots: int):
    def run(group: pa.Table) -> pa.Table:
        keys, sides, places, out = [], [], [], ([], [])
        for h, place, *known in zip(*(group.column(c) for c in ("hashes", "places", "repeated", "contested")), strict=True):
            for x, held in zip(known, out, strict=True):
                if x.is_valid:
                    held.append(_unpack(x.as_py()))
            if h.is_valid:
                raw = h.as_py()
                n = len(raw) // 13
                keys.append(np.frombuffer(raw, np.uint64, n))
                wide = np.zeros((n, 8), np.uint8)
                wide[:, :5] = np.frombuffer(raw, np.uint8, offset=8 * n).reshape(n, 5)
                sides.append(wide.view(np.uint64)[:, 0])
                places.append(place.as_py())
        if keys:
            key, side = np.concatenate(keys), np.concatenate(sides)
            sizes = np.cumsum([0, *map(len, keys)])
            by = np.lexsort((side, key))
            key, side = key[by], side[by]
            lead = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            count = np.diff(np.r_[lead, len(key)])
            equal = (side[lead] == side[lead + count - 1]) & ~(side[lead] >> np.uint64(39)).astype(bool)
            for held, wanted in zip(out, (equal, ~equal), strict=True):
                at = np.sort(by[np.repeat(wanted & (count > 1), count)])
                cuts = np.searchsorted(at, sizes)
                # places are unpacked piece by piece, and only those wanted are kept
                held += [tuple(c[at[a:b] - n] for c in _unpack(p)) for p, n, a, b in zip(places, sizes, cuts, cuts[1:], strict=False) if a < b]
        return _by_lot(list(out), lots)

    return run


def _merge(group: pa.Table) -> pa.Table:
    """(k, t, repeated, contested): starts of entries of each document, as uint32."""
    found: dict[tuple[int, int], list[bytes | None]] = {}
    for n, name in enumerate(("repeated", "contested")):
        parts = [_unpack(x.as_py()) for x in group.column(name) if x.is_valid]
        if not parts:
            continue
        k, t, s = (np.concatenate([p[i] for p in parts]) for i in range(3))
        by = np.lexsort((s, t, k))
        k, t, s = k[by], t[by], s[by].astype(np.uint32)
        ids, texts, doc = _docs(k, t)
        first = np.searchsorted(doc, np.arange(len(ids) + 1))
        for i, x, a, b in zip(ids.tolist(), texts.tolist(), first, first[1:], strict=False):
            found.setdefault((i, x), [None, None])[n] = np.unique(s[a:b]).tobytes()
    cols = [pa.array([x[n] for x in found.values()], pa.binary()) for n in (0, 1)]
    return pa.table({"k": pa.array([x[0] for x in found], pa.int64()), "t": pa.array([x[1] for x in found], pa.int64()), "repeated": cols[0], "contested": cols[1]})


def _picked(p: Parse, starts: list[np.ndarray]) -> np.ndarray:
    """Entries of ``p`` that begin at the given starts of their documents."""
    docs = np.unique(p.doc)
    wanted = np.concatenate([starts[d] + (d << 32) for d in docs.tolist()]) if len(docs) else np.empty(0, np.int64)
    return np.flatnonzero(np.isin(p.lo + (p.doc << 32), wanted))


def _starts(column: pa.Array) -> list[np.ndarray]:
    return [np.frombuffer(x.as_py() or b"", np.uint32).astype(np.int64) for x in column]


def _entries(width: int, trigger: int, density: int):
    """The wanted entries with what stands on both sides of their stretch: (m, s, e, g, k, t, lo)."""

    def run(batches):
        for batch in batches:
            starts = _starts(batch.column("contested"))
            k, t = (batch.column(c).to_numpy() for c in ("k", "t"))
            for p in parses(_utf8(batch.column("text")), width, trigger, density):
                at = _picked(p, starts)
                at = at[p.first[at] >= 0]
                if not len(at):
                    continue
                p = Parse(*(x[at] for x in p[:6]), p.data, p.sums)
                raw = p.data.tobytes()
                key = _keys(p, width, trigger)[0].view(np.int64)
                e = [raw[a:b] for a, b in zip(p.at.tolist(), p.first.tolist(), strict=True)]
                g = [raw[a:b] for a, b in zip(p.last.tolist(), (p.at + p.hi - p.lo + width).tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key), pa.array((width - p.last + p.first).astype(np.int32)), pa.array(e, pa.binary()), pa.array(g, pa.binary())]
                    + [pa.array(k[p.doc]), pa.array(t[p.doc]), pa.array(p.lo)],
                    names=["m", "s", "e", "g", "k", "t", "lo"],
                )

    return run


def _common(texts: list[bytes], order: list[int], new: np.ndarray) -> np.ndarray:
    """Length of the common prefix of each text with the one before it in ``order``; -1 where ``new``."""
    out = np.full(len(order), -1, np.int64)
    for lo in range(1, len(order), 2048):
        at = order[lo - 1 : lo + 2048]
        size = np.array([len(texts[i]) for i in at])
        wide = np.zeros((len(at), max(int(size.max()), 1)), np.uint8)
        for j, i in enumerate(at):
            wide[j, : size[j]] = np.frombuffer(texts[i], np.uint8)
        differ = wide[1:] != wide[:-1]
        same = np.where(differ.any(1), differ.argmax(1), wide.shape[1])
        out[lo : lo + len(at) - 1] = np.minimum(same, np.minimum(size[1:], size[:-1]))
    out[new] = -1
    return out


def repeated_in_order(m: np.ndarray, s: np.ndarray, e: list[bytes], g: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(entry, a) of every window that another entry of the same stretch ``m`` holds too.

    A window of an entry begins ``a`` bytes before its first trigger's end: it is the phrase suffix of ``a`` bytes,
    the stretch, and the first ``s - a`` bytes of what follows. Entries are put in the suffix order of the dictionary (what stands
    before, read backwards) and in the order of the parse (what follows), with common lengths of neighbours. For each ``a``
    both orders fall into classes of equal suffixes and of equal continuations; entries in the same two classes
    are neighbours in the corpus order that have the whole window in common.
    """
    n = len(m)
    most, least = np.array([len(x) for x in e], np.int64), s.astype(np.int64) - np.array([len(x) for x in g], np.int64)
    back = [x[::-1] for x in e]
    found = []
    orders = []
    for texts in (back, g):
        order = sorted(range(n), key=lambda i, texts=texts: (m[i], texts[i]))
        o = np.array(order)
        orders.append((o, _common(texts, order, np.r_[True, m[o][1:] != m[o][:-1]])))
    (o1, lcs), (o2, lcp) = orders
    rest = s.astype(np.int64)[o2]
    for a in range(int(least.min()), int(most.max()) + 1):
        at = np.flatnonzero((least <= a) & (a <= most))
        if len(at) < 2:
            continue
        suffix, follows = np.empty(n, np.int64), np.empty(n, np.int64)
        suffix[o1] = np.cumsum(lcs < a)
        follows[o2] = np.cumsum(lcp < rest - a)
        both = suffix[at] * (n + 1) + follows[at]
        by = np.argsort(both, kind="stable")
        same = both[by][1:] == both[by][:-1]
        at = at[by[np.r_[same, False] | np.r_[False, same]]]
        found.append((at, np.full(len(at), a, np.int64)))
    if not found:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def _ordered(group: pa.Table) -> pa.Table:
    """(k, t, x, y): ranges of starts of repeated windows."""
    group = group.combine_chunks()
    m, s, k, t, lo = (group.column(c).to_numpy() for c in ("m", "s", "k", "t", "lo"))
    e, g = group.column("e").to_pylist(), group.column("g").to_pylist()
    row, a = repeated_in_order(m, s, e, g)
    start = lo[row] + np.array([len(x) for x in e], np.int64)[row] - a
    by = np.lexsort((start, row))
    row, start = row[by], start[by]
    new = np.r_[True, (row[1:] != row[:-1]) | (start[1:] != start[:-1] + 1)][: len(row)]
    end = np.r_[new[1:], True][: len(row)]
    return pa.table({"k": k[row[new]], "t": t[row[new]], "x": pa.array(start[new]), "y": pa.array(start[end])})


def _windows(batches):
    """(w, k, t, x): a 128-bit name of each window of hot entries, and where it begins."""
    for batch in batches:
        names, rows = [], []
        for i, (m, s, e, g, lo) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("m", "s", "e", "g", "lo")), strict=True)):
            for a in range(max(s - len(g), 0), len(e) + 1):
                names.append(xxhash.xxh3_128_digest(b"%d:%d:" % (m, a) + e[len(e) - a :] + g[: s - a]))
                rows.append((i, lo + len(e) - a))
        at = pa.array([r[0] for r in rows], pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.binary()), batch.column("k").take(at), batch.column("t").take(at), pa.array([r[1] for r in rows], pa.int64())], names=["w", "k", "t", "x"])


def _cut(width: int, trigger: int, density: int):
    def run(batches):
        for batch in batches:
            texts = list(_utf8(batch.column("text")))
            starts = _starts(batch.column("repeated"))
            low, high = [[] for _ in texts], [[] for _ in texts]
            for i, spans in enumerate(batch.column("spans").to_pylist()):
                for span in spans or ():
                    low[i].append(span["x"])
                    high[i].append(span["y"])
            marked = [i for i, x in enumerate(starts) if len(x)]
            for p in parses((texts[i] for i in marked), width, trigger, density):
                at = _picked(p, [starts[i] for i in marked])
                for d in np.unique(p.doc[at]).tolist():
                    own = at[p.doc[at] == d]
                    low[marked[d]] += p.lo[own].tolist()
                    high[marked[d]] += p.hi[own].tolist()
            out = []
            for text, lo, hi in zip(texts, low, high, strict=True):
                spans, kept, last = [], [], 0
                for a, b in sorted(zip(lo, hi, strict=True)):
                    if spans and a <= spans[-1][1]:
                        spans[-1][1] = max(spans[-1][1], b + width)
                    else:
                        spans.append([a, b + width])
                for a, b in spans:
                    kept.append(text[last:a])
                    last = b
                rest = b"".join([*kept, text[last:]])
                out.append((len(text), len(text) - len(rest), len(spans), hashlib.sha256(rest).hexdigest(), ",".join(f"{a}:{b}" for a, b in spans), rest))
            kinds = [pa.int64()] * 3 + [pa.string()] * 2 + [pa.binary()]
            yield pa.RecordBatch.from_arrays([batch.column("k")] + [pa.array([r[i] for r in out], kinds[i]) for i in range(6)], names=["k", "n_bytes", "n_removed", "n_spans", "kept_sha256", "removed_spans", "kept"])

    return run


def _spans(contested: DataFrame) -> DataFrame:
    """(k, t, x, y): ranges of starts of windows that contested entries have in common with others of the same stretch."""
    spark = contested.sparkSession
    sizes = contested.groupBy("m").agg(F.count("*").alias("n"))
    hot = written(sizes.where(F.col("n") > HOT).select("m"))
    lots = max(partitions(spark), -(-contested.count() // LOT))
    alike = contested.join(hot, "m", "left_anti").withColumn("lot", F.pmod(F.xxhash64("m"), F.lit(lots)))
    found = alike.groupBy("lot").applyInArrow(_ordered, "k long, t long, x long, y long")
    # windows of stretches with many entries are counted: equal ones are added up before they move
    windows = contested.join(hot, "m", "left_semi").mapInArrow(_windows, "w binary, k long, t long, x long")
    twice = windows.groupBy("w").agg(F.count("*").alias("n")).where("n > 1").select("w")
    return found.unionByName(windows.join(twice, "w", "left_semi").select("k", "t", "x", F.col("x").alias("y")))


def dedup_bytes(docs: DataFrame, width: int = WIDTH, id_col: str = "doc_id", text_col: str = "text", with_bytes: bool = False, trigger: int = TRIGGER, density: int = DENSITY) -> DataFrame:
    """Remove every byte covered by a ``width``-byte string that also starts anywhere else, in the same document or another.

    Texts are UTF-8 bytes; matches never cross documents and are judged on the input. Returns doc_id, n_bytes, n_removed,
    n_spans and removed_spans (maximal byte intervals ``begin:end``), kept_sha256 and, if asked, kept_bytes (which may begin or end within a character).

    Triggers of a rolling hash cut documents into phrases. A window is a phrase suffix, a stretch of whole phrases
    and the beginning of a phrase; consecutive windows with the same stretch are one entry of the parse. Entries that have their stretch
    alone can't repeat. Those whose stretch and both sides are equal repeat as a whole. Only where sides differ the orders of
    phrase suffixes and of continuations are made, which together order the windows of a stretch as the corpus' suffix array does
    (:func:`repeated_in_order`). A stretch that many entries share has its windows counted by Spark instead.
    A window without any trigger is an entry of its own. Stretches are known by 64 bits, and sides by 39 more or by their bytes.

    Null and empty texts have no bytes. Equal rows are documents of their own and remove each other; so are rows that share
    an id, or have none. Other columns are ignored. An empty table gives an empty one. A chunk sends one entry of a stretch to its bucket,
    whatever it holds of it; documents of any length are parsed in pieces.
    """
    rows, n_bytes = _rows(docs, id_col, text_col)
    buckets = max(partitions(docs.sparkSession), -(-n_bytes // BUCKET_BYTES))
    dealt = rows.mapInArrow(tidy(_map_entries(width, trigger, density, buckets)), "bucket int, hashes binary, places binary, repeated binary, contested binary")
    found = dealt.repartitionById(buckets, F.col("bucket")).groupBy("bucket").applyInArrow(_reduce_entries(buckets), "lot int, repeated binary, contested binary")
    found = written(found.repartitionById(buckets, F.col("lot")).groupBy("lot").applyInArrow(_merge, "k long, t long, repeated binary, contested binary"))
    wanted = rows.join(found.where("contested is not null").select("k", "t", "contested"), ["k", "t"])
    contested = written(wanted.mapInArrow(tidy(_entries(width, trigger, density)), "m long, s int, e binary, g binary, k long, t long, lo long"))
    spans = written(_spans(contested).groupBy("k", "t").agg(F.collect_list(F.struct("x", "y")).alias("spans")))
    marked = found.select("k", "t", "repeated").join(spans, ["k", "t"], "full")
    cut = rows.join(marked, ["k", "t"], "left").select("k", "text", "repeated", "spans")
    out = cut.mapInArrow(tidy(_cut(width, trigger, density)), "k long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, removed_spans string, kept binary")
    cols = [real_id("k").alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept_sha256", "removed_spans"]
    return out.select(*cols, *([F.col("kept").alias("kept_bytes")] if with_bytes else []))
