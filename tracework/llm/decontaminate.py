"""Benchmark decontamination: n-gram seeds, then Smith-Waterman alignment of words."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Remembered, id_column, real_id, tidy

#: Words of a seed; score of a match, a changed word and a gap; share of an item's best score from which a passage counts as a copy.
SEED_WORDS, MATCH, MISMATCH, GAP, COPY = 3, 2, -1, -1, 0.5
#: Benchmark words that one scan of the documents looks for; a larger benchmark is taken in blocks.
BLOCK_WORDS = 500_000
_EDGES = re.compile(r"^\W+|\W+$")


class Vocabulary(Remembered):
    """Number of a text's raw word in the benchmark's vocabulary, 0 outside it."""

    def __init__(self, words: dict[str, int]):
        super().__init__(lambda raw: words.get(_EDGES.sub("", raw), 0), room=32_000_000)


def words_of(text: str | None) -> list[str]:
    """Lower-cased words without the marks around them."""
    return [w for w in (_EDGES.sub("", raw) for raw in (text or "").lower().split()) if w]


class Block:
    """Items of a benchmark block with their vocabulary and sorted keys of their n-grams; an item of fewer words is one n-gram by itself."""

    def __init__(self, items: list[tuple[int, str | None]], n: int = SEED_WORDS):
        self.ids = [i for i, _ in items]
        self.words: dict[str, int] = {}
        self.items = [np.array([self.words.setdefault(w, len(self.words) + 1) for w in words_of(t)], np.int64) for _, t in items]
        found: dict[tuple[int, int], list[tuple[int, int]]] = {}
        for item, seq in enumerate(self.items):
            size = min(n, len(seq))
            for at, key in enumerate(self.keys(seq, size).tolist()):
                found.setdefault((size, key), []).append((item, at))
        names = sorted(found)
        self.places = [found[x] for x in names]
        #: For each length of seeds their sorted keys and the number of the first.
        self.seeds = [(size, np.array([k for z, k in names if z == size], np.int64), sum(z < size for z, _ in names)) for size in sorted({z for z, _ in names})]

    @staticmethod
    def keys(seq: np.ndarray, n: int) -> np.ndarray:
        """One number for each n-gram, -1 where a word is outside the vocabulary."""
        m = len(seq) - n + 1
        if m <= 0 or not n:
            return np.empty(0, np.int64)
        key, inside = np.zeros(m, np.int64), np.ones(m, bool)
        for k in range(n):
            part = seq[k : k + m]
            # exact for vocabularies of up to two million words: three of 21 bits
            key = key << np.int64(21) | part
            inside &= part > 0
        return np.where(inside, key, -1)

    def hits(self, seq: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(position, seed) of every n-gram that the block has too."""
        met = []
        for size, known, first in self.seeds:
            key = self.keys(seq, size)
            pos = np.flatnonzero(key >= 0)
            at = np.minimum(np.searchsorted(known, key[pos]), len(known) - 1)
            same = known[at] == key[pos]
            met.append((pos[same], at[same] + first))
        return tuple(np.concatenate([m[i] for m in met]) if met else np.empty(0, np.int64) for i in (0, 1))


def align(item: np.ndarray, seq: np.ndarray) -> tuple[int, int]:
    """Best local alignment (score, end in ``seq``); number 0 matches nothing."""
    span = np.arange(len(seq) + 1) * -GAP
    row, best, end = np.zeros(len(seq) + 1, np.int64), 0, 0
    for word in item.tolist():
        new = np.maximum(row + GAP, 0)
        np.maximum(new[1:], row[:-1] + np.where(seq == word, MATCH, MISMATCH), out=new[1:])
        row = np.maximum.accumulate(new + span) - span
        at = int(row.argmax())
        if row[at] > best:
            best, end = int(row[at]), at
    return best, end


def _finder(block: Block, copy: float):
    sizes = np.array([len(seq) for seq in block.items], np.int64)
    counts = np.array([len(places) for places in block.places], np.int64)
    first = np.cumsum(counts) - counts
    places = np.array([p for places in block.places for p in places], np.int64).reshape(-1, 2)

    def windows(n: int, pos: np.ndarray, seed: np.ndarray):
        """(item, begin, stop) of the windows around each item's hits, merged where they meet.

        A local alignment has no more gaps beyond a seed than its matches there can pay for, two
        each, so no alignment through a seed leaves three times the item's words on that side.
        """
        take = counts[seed]
        mine = np.repeat(first[seed] - (np.cumsum(take) - take), take) + np.arange(take.sum())
        item, at = places[mine].T
        pos = np.repeat(pos, take)
        lo = np.maximum(pos - 3 * at, 0)
        hi = np.minimum(pos + 3 * (sizes[item] - at), n)
        by = np.lexsort((lo, item))
        item, base = item[by], item[by] * (n + 1)
        lo, top = lo[by] + base, np.maximum.accumulate(hi[by] + base)
        new = np.r_[True, lo[1:] > top[:-1]]
        return item[new].tolist(), (lo - base)[new].tolist(), (top - base)[np.r_[new[1:], True]].tolist()

    def within(text: str | None, vocabulary: Vocabulary, present: np.ndarray) -> Iterator[tuple[int, float, int, int]]:
        """(item, share, begin, end) of each copy in a text."""
        raw = text.lower().split() if text else ()
        seq = np.fromiter(map(vocabulary.__getitem__, raw), np.int64, len(raw))
        pos, seed = block.hits(seq)
        if not len(pos):
            return
        for item, begin, stop in zip(*windows(len(seq), pos, seed), strict=True):
            words, part = block.items[item], seq[begin:stop]
            # words that the window lacks can't match, so no alignment scores more than those it has
            present[part] = True
            shared = np.count_nonzero(present[words])
            present[part] = False
            if shared / len(words) < copy:
                continue
            score, end = align(words, part)
            share = score / (MATCH * len(words))
            if share >= copy:
                _, length = align(words[::-1], part[:end][::-1])
                yield item, share, begin + end - length, begin + end

    return within


def _passage_rows(block: Block, copy: float):
    def run(batches):
        within, vocabulary, present = _finder(block, copy), Vocabulary(block.words), np.zeros(len(block.words) + 1, bool)
        for batch in batches:
            out = [(k, block.ids[item], *rest) for k, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True) for item, *rest in within(text.as_py(), vocabulary, present)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[c] for r in out], t) for c, t in enumerate((pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64()))],
                names=["k", "item", "score", "begin", "end"],
            )

    return run


def _clean_rows(block: Block, copy: float):
    def run(batches):
        within, vocabulary, present = _finder(block, copy), Vocabulary(block.words), np.zeros(len(block.words) + 1, bool)
        for batch in batches:
            clean = [next(within(text.as_py(), vocabulary, present), None) is None for text in batch.column(0)]
            kept = batch.filter(pa.array(clean, pa.bool_()))
            yield pa.RecordBatch.from_arrays(kept.columns[1:], names=kept.schema.names[1:])

    return run


def blocks(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", block_words: int = BLOCK_WORDS, seed_words: int = SEED_WORDS) -> Iterator[Block]:
    """The benchmark in blocks of about ``block_words`` words, each small enough for the driver and for a closure."""
    rows = benchmark.select(id_column(id_col).alias("k"), F.col(f"`{text_col}`").cast("string").alias("text"))
    n_words = rows.agg(F.sum(F.size(F.split("text", r"\s+")))).first()[0] or 0
    parts = -(-n_words // block_words)
    for part in range(parts):
        mine = rows.where(F.pmod(F.xxhash64("k", "text"), F.lit(parts)) == part) if parts > 1 else rows
        yield Block(sorted({(r.k, r.text or "") for r in mine.collect()}), seed_words)


def passages(docs: DataFrame, benchmark: DataFrame, copy: float = COPY, id_col: str = "doc_id", text_col: str = "text", seed_words: int = SEED_WORDS) -> DataFrame | None:
    """(k, item, score, begin, end): where documents hold copies of benchmark items, in words; None for an empty benchmark.

    Each block's scan of the whole texts takes every n-gram that a document shares with an item as a
    seed, however frequent it is, and aligns the windows around an item's seeds with it.
    """
    rows = docs.select(id_column(id_col).alias("k"), F.col(f"`{text_col}`").cast("string").alias("text"))
    out = None
    for block in blocks(benchmark, seed_words=seed_words):
        got = rows.mapInArrow(tidy(_passage_rows(block, copy)), "k long, item long, score double, begin long, end long")
        out = got if out is None else out.unionByName(got)
    return out


def clean(docs: DataFrame, benchmark: DataFrame, copy: float = COPY, text_col: str = "text", seed_words: int = SEED_WORDS) -> DataFrame:
    """Rows of ``docs``, with every column, whose text holds no copy of a benchmark item; each is judged where it is read, and nothing is shuffled."""
    for block in blocks(benchmark, seed_words=seed_words):
        rows = docs.select(F.col(f"`{text_col}`").cast("string").alias("__tracework_text"), *[F.col(f"`{c}`") for c in docs.columns])
        docs = rows.mapInArrow(tidy(_clean_rows(block, copy)), docs.schema)
    return docs


def contaminated(docs: DataFrame, benchmark: DataFrame, copy: float = COPY, seed_words: int = SEED_WORDS) -> DataFrame:
    """One row for each document id: doc_id, contaminated, n_items, item_id and score of the best copy, spans ``item:begin:end`` in words.

    A copy aligns with at least ``copy`` of the item's best possible score (local alignment: match 2,
    changed word -1, gap -1), verbatim 1.0. Words are lower-cased and freed of marks around them.
    A copy without ``seed_words`` words in a row of its item is not met (an item of fewer words is one seed); with ``seed_words=1``
    every word is a seed and every copy is met, as an alignment has a match at least, at the price of many more windows. Null texts hold nothing. Rows
    that share an id are one document. The benchmark's repeated rows count once.
    """
    ids = docs.select(id_column("doc_id").alias("k")).distinct()
    got = passages(docs, benchmark, copy, seed_words=seed_words)
    if got is None:
        got = docs.sparkSession.createDataFrame([], "k long, item long, score double, begin long, end long")
    best = got.groupBy("k", "item").agg(F.max(F.struct("score", (-F.col("begin")).alias("first"), "end")).alias("b"))
    best = best.groupBy("k").agg(
        F.count("*").alias("n_items"),
        F.max(F.struct("b.score", (-F.col("item")).alias("item"))).alias("top"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("item", (-F.col("b.first")).alias("begin"), F.col("b.end").alias("end")))), lambda s: F.concat_ws(":", s.item, s.begin, s.end)), ",").alias("spans"),
    )
    out = ids.join(best, "k", "left")
    return out.select(
        real_id("k").alias("doc_id"), F.col("n_items").isNotNull().alias("contaminated"), F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"),
        (-F.col("top.item")).alias("item_id"), F.round("top.score", 6).alias("score"), F.coalesce("spans", F.lit("")).alias("spans"),
    )
