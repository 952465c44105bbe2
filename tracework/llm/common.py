"""Shared pieces of the corpus operators: word rules, bounded memory, connected components."""

from __future__ import annotations

import ctypes
import gc
from sys import getsizeof

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..stored import dropped, stored

#: A word is a maximal run of anything but ASCII white space. ``bytes.split()`` cuts at the same six characters.
WORD = r"[^\x20\x09-\x0D]+"
#: Stands for a null id inside operators, so that null ids order first and join.
NULL_ID = -(2**63)
#: A table in the shared folder, which cuts the lineage; :func:`dropped` deletes it.
written = stored


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


class Remembered(dict):
    """What ``make`` gives for a word, kept for words of moderate length only and while all that is kept takes no more than ``room`` bytes; then it begins anew."""

    def __init__(self, make, room: int = 48_000_000, longest: int = 64):
        super().__init__()
        self.make, self.room, self.longest, self.held = make, room, longest, 0

    def __missing__(self, word):
        value = self.make(word)
        if len(word) <= self.longest:
            # the word, its value and what a tuple holds, and the entry in the table
            size = getsizeof(word) + getsizeof(value) + 100 + (sum(map(getsizeof, value)) if type(value) is tuple else 0)
            if self.held + size > self.room:
                self.clear()
                self.held = 0
            self.held += size
            self[word] = value
        return value


def release() -> None:
    """Give memory that is no longer held back to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def tidy(run):
    """A function over Arrow batches that gives memory back at its end: workers are used again and would keep what they once held."""

    def held(batches):
        yield from run(batches)
        release()

    return held


def id_column(name: str) -> Column:
    return F.coalesce(F.col(f"`{name}`").cast("long"), F.lit(NULL_ID))


def real_id(name: str) -> Column:
    return F.when(F.col(name) != NULL_ID, F.col(name))


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component): the smallest node that each node of ``edges`` (a, b of any ordered type) reaches.

    Alternating large-star and small-star rounds: every round is a ``min`` per node (combined
    map-side) and a join back, so a hub with any number of neighbours is never gathered in one
    place. Each round is written to the shared folder and the one before deleted.
    """
    e = written(
        edges.where("a is not null and b is not null and a != b")
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .distinct()
    )

    def mark(df: DataFrame):
        return df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()

    seen = mark(e)
    for _ in range(max_rounds):
        if not seen[0]:
            break
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = written(both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(low, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = written(moved.unionByName(low.select("u", F.col("m").alias("v"))).distinct())
        now = mark(small)
        dropped(e)
        dropped(large)
        e = small
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    leaves = e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return leaves.unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
