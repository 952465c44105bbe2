"""Quality classifier: naive Bayes support vectors over n-gram indicators of words and of word shapes."""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import Remembered, id_column, real_id, release, tidy

#: Labelled documents of each class that a classifier is fitted on at most, and bytes of their texts; feature slots, and the score from which a document is good.
SAMPLE, SAMPLE_BYTES, SLOTS, GOOD = 4000, 32_000_000, 1 << 18, 0.7
COST, ROUNDS, SEED = 1.0, 30, 11
_RUNS = re.compile(r"(.)\1*", re.DOTALL)


def _numbers(word: str) -> int:
    """Numbers of a word's lower-cased form (high half) and of its shape (low half): runs of capitals, small letters and digits as A, a and 0, other runs as their character."""
    kinds = _RUNS.sub(r"\1", "".join("A" if c.isupper() else "a" if c.isalpha() else "0" if c.isdigit() else c for c in word))
    low, shape = (xxhash.xxh32_intdigest(x.encode("utf-8", "surrogatepass")) for x in (word.lower(), kinds))
    return low << 32 | shape


def _grams(ids: np.ndarray, sizes: tuple[int, ...], salt: int) -> list[np.ndarray]:
    out = []
    for n in sizes:
        if len(ids) >= n:
            g = np.full(len(ids) - n + 1, salt + n, np.uint64)
            for k in range(n):
                g = (g ^ ids[k : len(ids) - n + 1 + k]) * np.uint64(0x9E3779B97F4A7C15)
                g ^= g >> np.uint64(31)
            out.append(g)
    return out


def features(text: str, numbers: dict) -> np.ndarray:
    """Slots of the 1- and 2-grams of words and the 1- to 3-grams of word shapes that the whole text has; a word like the one before has a shape of its own."""
    words = text.split()
    ids = np.fromiter(map(numbers.__getitem__, words), np.uint64, len(words))
    low, shape = ids >> np.uint64(32), ids & np.uint64(0xFFFFFFFF)
    if len(ids) > 1:
        shape = np.where(np.r_[False, low[1:] == low[:-1]], np.uint64(7), shape)
    ends = np.array([1], np.uint64), np.array([2], np.uint64)
    g = np.concatenate(_grams(low, (1, 2), 16) + _grams(np.concatenate([ends[0], shape, ends[1]]), (1, 2, 3), 0))
    return np.unique((g ^ (g >> np.uint64(32))) % np.uint64(SLOTS)).astype(np.int32)


def _feature_rows(batches):
    numbers = Remembered(_numbers)
    for batch in batches:
        slots = [features(t or "", numbers) for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch.column("k"), batch.column("y"), pa.array([s.tobytes() for s in slots], pa.binary())], names=["k", "y", "slots"]
        )


@dataclass
class Model:
    """Weights of the slots, bias, and the line that turns a margin into the logit of the score."""

    weights: np.ndarray
    bias: float
    slope: float
    shift: float

    def margin(self, slots: np.ndarray) -> float:
        return (float(self.weights[slots].sum()) / np.sqrt(len(slots)) if len(slots) else 0.0) + self.bias

    def score(self, slots: np.ndarray) -> float:
        z = self.slope * self.margin(slots) + self.shift
        return float(1 / (1 + np.exp(-z))) if z >= 0 else float(np.exp(z) / (1 + np.exp(z)))


def fit(rows: list[np.ndarray], y: np.ndarray, cost: float = COST, rounds: int = ROUNDS) -> tuple[np.ndarray, float]:
    """Weights and bias: indicators scaled by class log-count ratios, then a linear hinge loss by dual coordinate descent.

    ``rows`` are slot sets, scaled to unit length before the ratios; ``y`` is 1 or -1. Classes
    weigh alike, so that the rarer one isn't drowned.
    """
    present = {s: np.ones(SLOTS) for s in (1, -1)}
    for x, s in zip(rows, y.tolist(), strict=True):
        present[s][x] += 1
    ratio = np.log(present[1] / present[1].sum()) - np.log(present[-1] / present[-1].sum())
    scaled = [ratio[x] / np.sqrt(max(len(x), 1)) for x in rows]
    square = np.array([float(v @ v) + 1.0 for v in scaled])
    upper = {s: cost * len(y) / (2 * max(1, int((y == s).sum()))) for s in (1, -1)}
    w, b, alpha = np.zeros(SLOTS), 0.0, np.zeros(len(y))
    order = np.random.default_rng(SEED)
    for _ in range(rounds):
        moved = 0.0
        for i in order.permutation(len(y)).tolist():
            s = float(y[i])
            slope = s * (float(w[rows[i]] @ scaled[i]) + b) - 1.0
            new = min(max(alpha[i] - slope / square[i], 0.0), upper[int(s)])
            step = new - alpha[i]
            if step:
                alpha[i] = new
                w[rows[i]] += step * s * scaled[i]
                b += step * s
                moved = max(moved, abs(step))
        if moved < 1e-4:
            break
    return w * ratio, b


def _line(margins: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a logistic line through margins, by Newton's method; a weak pull keeps separable classes finite."""
    goal, ab = (y > 0).astype(float), np.array([1.0, 0.0])
    x = np.stack([margins, np.ones(len(margins))], 1)
    weight = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())) * len(y)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ ab, -30, 30)))
        grad = x.T @ (weight * (p - goal)) + 0.01 * (ab - [1.0, 0.0])
        hess = (x * (weight * p * (1 - p))[:, None]).T @ x + 0.01 * np.eye(2)
        step = np.linalg.solve(hess, grad)
        ab = ab - step
        if np.abs(step).max() < 1e-8:
            break
    return float(ab[0]), float(ab[1])


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample_bytes: int = SAMPLE_BYTES) -> Model:
    """A model from at most ``sample`` labelled documents of each class, those with the smallest hashes of their ids; texts that don't fit in what is left of ``sample_bytes`` are passed over (but never the first).

    Rows whose crc32 of the id as text leaves 2 when divided by 4 are held out. Null ids and labels
    are left out; an id with both labels counts as good; of texts that share an id the one with the smallest hash counts. Without
    labels of both classes every document scores 1 for a known good class or no class, 0 for a known bad one.
    """
    known = labels.select(F.col(f"`{id_col}`").cast("long").alias("k"), F.col(f"`{label_col}`").cast("int").alias("y")).where("k is not null and y in (0, 1)")
    known = known.where(F.crc32(F.col("k").cast("string").cast("binary")) % 4 != 2).groupBy("k").agg(F.max("y").alias("y"))
    lot = F.md5(F.col("k").cast("string"))
    # the ids of the sample are bounded, so their join is a broadcast of known size
    few = [r for y in (0, 1) for r in known.where(f"y = {y}").orderBy(lot, "k").limit(sample).collect()]
    spark = docs.sparkSession
    texts = docs.select(F.col(f"`{id_col}`").cast("long").alias("k"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))
    texts = texts.join(F.broadcast(spark.createDataFrame([(r.k, r.y) for r in few], "k long, y int")), "k")
    found = {r.k: r for r in texts.groupBy("k").agg(F.min(F.struct(F.xxhash64("text").alias("t"), F.octet_length("text").alias("n"))).alias("first")).select("k", "first.*").collect()}
    chosen = []
    for y in (0, 1):
        room = sample_bytes
        for r in (r for r in few if r.y == y and r.k in found):
            if room < sample_bytes and found[r.k].n > room:
                continue
            room -= found[r.k].n
            chosen.append((r.k, r.y, found[r.k].t))
    if len({y for _, y, _ in chosen}) < 2:
        return Model(np.zeros(SLOTS), 0.0, 0.0, -30.0 if {y for _, y, _ in chosen} == {0} else 30.0)
    picked = F.broadcast(spark.createDataFrame(chosen, "k long, y int, t long").select("k", "t"))
    rows = texts.withColumn("t", F.xxhash64("text")).join(picked, ["k", "t"]).dropDuplicates(["k"])
    got = rows.select("k", "y", "text").mapInArrow(tidy(_feature_rows), "k long, y int, slots binary").toArrow().sort_by("k")
    rows = [np.frombuffer(x.as_buffer() or b"", np.int32) for x in got.column("slots")]
    y = np.where(got.column("y").to_numpy() == 1, 1, -1)
    # folds give margins that the weights were not fitted to, for the line
    fold = np.arange(len(y)) % 3
    margins = np.zeros(len(y))
    for f in range(3):
        fitted = [i for i in range(len(y)) if fold[i] != f]
        m = Model(*fit([rows[i] for i in fitted], y[fold != f]), 1.0, 0.0)
        margins[fold == f] = [m.margin(rows[i]) for i in np.flatnonzero(fold == f)]
    model = Model(*fit(rows, y), *_line(margins, y))
    del got, rows, m
    release()
    return model


def _scores(model: Model):
    def run(batches):
        numbers = Remembered(_numbers)
        for batch in batches:
            score = [model.score(features(t or "", numbers)) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(score, pa.float64())], names=[*batch.schema.names[1:], SCORE])

    return run


#: Names of columns that operators add to a caller's rows; unlikely to clash.
SCORE = "__tracework_score"


def with_score(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` with every column, and SCORE (0 to 1, higher: better). Null texts score as empty ones."""
    rows = docs.select(F.col(f"`{text_col}`").cast("string").alias("__tracework_text"), *[F.col(f"`{c}`") for c in docs.columns])
    schema = StructType([*docs.schema.fields, StructField(SCORE, DoubleType())])
    return rows.mapInArrow(tidy(_scores(model)), schema)


def score(docs: DataFrame, labels: DataFrame, good: float = GOOD, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score and predicted (1: score >= ``good``) of every whole text.

    Only the text is an input of the score: null and empty texts score alike. Repeated rows are scored
    each; a null id is not held out. Other columns are ignored. An empty table gives an empty result.
    """
    model = train(docs, labels, sample)
    rows = docs.select(id_column("doc_id").alias("k"), F.col("text").cast("string").alias("text"))
    out = with_score(rows, model).withColumn("doc_id", real_id("k"))
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    return out.select("doc_id", held.alias("held_out"), F.col(SCORE).alias("score"), (F.col(SCORE) >= good).cast("int").alias("predicted"))
