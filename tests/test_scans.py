"""Scans of streams that are cut into ranges against windows and plain loops on random streams."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tracework.operators import scans
from tracework.operators import sequence as S

T0 = dt.datetime(2026, 1, 1, tzinfo=dt.UTC)


def stream(spark, rng, n, keys):
    rows = [(rng.choice(keys), i, rng.choice([None, *"pdx"]), rng.randint(-3, 3), T0 + dt.timedelta(seconds=40 * i + rng.randint(0, 30)) if rng.random() > 0.05 else None) for i in range(n)]
    rng.shuffle(rows)
    return rows, spark.createDataFrame(rows, "s string, i int, kind string, v int, ts timestamp").repartition(5)


@pytest.mark.parametrize(("n", "keys", "ranges"), [(900, ["a"], 7), (900, ["a", "b", None], 5), (300, [f"k{i}" for i in range(80)], 9), (40, ["a"], 30), (0, ["a"], 3)])
def test_spread_scans_are_windows(spark, n, keys, ranges):
    _, df = stream(spark, random.Random(n + ranges), n, keys)
    what = {
        "sum_own": scans.total(F.col("v")), "sum_before": scans.total(F.col("v"), own=False), "last_before": scans.last(F.col("kind")), "last_own": scans.last(F.col("kind"), own=True),
        "next_after": scans.following(F.when(F.col("kind") == "p", F.col("i"))), "next_own": scans.following(F.when(F.col("kind") == "p", F.col("i")), own=True),
    }
    plain, spread = (scans.Stream(df, ["s"], ["i"], on, ranges).scan(**what).rows() for on in (False, True))
    assert spread.columns == plain.columns
    assert sorted(map(str, spread.collect())) == sorted(map(str, plain.collect()))


def test_ranges_bound_tasks(spark):
    one = spark.range(20_000).select(F.lit("all").alias("s"), F.col("id").alias("i"))
    s = scans.Stream(one, ["s"], ["i"], True, 16)
    sizes = [r["count"] for r in s.df.groupBy(scans.RANGE).count().collect()]
    assert len(sizes) == 16 and max(sizes) < 3 * 20_000 / 16
    got = s.scan(n=scans.total(F.lit(1))).rows()
    assert got.where("n != i + 1").count() == 0


@pytest.mark.parametrize("keys", [[], ["s"]])
def test_peak(spark, keys):
    rng = random.Random(9)
    rows = []
    for _ in range(400):
        a = rng.randint(0, 60)
        rows.append((rng.choice("ab"), a, a + rng.choice([0, 1, 5, 30])))
    df = spark.createDataFrame(rows, "s string, a int, b int")
    want = {}
    for key in {r[0] if keys else None for r in rows}:
        now = best = 0
        for _, step in sorted(m for s, a, b in rows if not keys or s == key for m in ((a, 1), (b, -1))):
            now += step
            best = max(best, now)
        want[key] = best
    got = {(r.s if keys else None): r.peak for r in scans.peak(df, keys, "a", "b", 6).collect()}
    assert got == want
    if keys:
        assert {r.s: r.peak for r in S.max_concurrency(df, keys, "a", "b").collect()} == want
    else:
        assert [r.peak for r in scans.peak(df.limit(0), [], "a", "b").collect()] == [0]


def test_spread_sessions_and_caps(spark):
    rows, df = stream(spark, random.Random(2), 700, ["a", "b"])
    for broken in (False, True):
        plain, spread = (S.gap_sessions(df, ["s"], "ts", 60, ["i"], break_on_null=broken, spread=on, ranges=6) for on in (False, True))
        assert sorted(map(str, plain.collect())) == sorted(map(str, spread.select(*plain.columns).collect()))
    plain, spread = (S.active_seconds(df, ["s"], "ts", 60, spread=on, ranges=6).collect() for on in (False, True))
    assert sorted(map(str, plain)) == sorted(map(str, spread))
    plain, spread = (S.active_windows(df, [], "ts", 60, spread=on, ranges=6).collect() for on in (False, True))
    assert sorted(map(str, plain)) == sorted(map(str, spread))
    kept = S.cap_events(df, ["s"], ["i"], F.col("kind") == "p", 25, spread=True)
    want = []
    for key in "ab":
        own = sorted(r for r in rows if r[0] == key)
        held = [r for n, r in enumerate(own) if n < 25 or r[2] == "p"]
        want += [(key, r[1], n) for n, r in enumerate(held)]
    assert sorted((r.s, r.i, r["index"]) for r in kept.collect()) == sorted(want)


def test_a_stream_of_many_events_takes_its_ranges(spark):
    """One key, no session of its own: as many tasks as ranges, and the window's result."""
    n = 1_000_000
    one = spark.range(n).select(F.col("id"), F.timestamp_seconds(F.col("id") * 10 + F.when(F.col("id") % 997 == 0, 5000).otherwise(0)).alias("ts"))
    got = S.gap_sessions(one, [], "ts", 60, ["id"], spread=True, ranges=32)
    last = got.agg(F.max("session"), F.count("*"), F.sum("session")).first()
    plain = S.gap_sessions(one, [], "ts", 60, ["id"]).agg(F.max("session"), F.count("*"), F.sum("session")).first()
    assert tuple(last) == tuple(plain)


def test_too_long(spark):
    df = spark.range(100).select((F.col("id") % 3).alias("s"))
    assert scans.too_long(df, ["s"], 33) and not scans.too_long(df, ["s"], 34) and not scans.too_long(df.limit(0), ["s"])


@pytest.mark.parametrize("spread", [False, True])
def test_medians(spark, spread):
    rng = random.Random(31)
    rows = [(k, rng.choice([None, rng.randint(0, 9), rng.uniform(-5, 5)])) for k in ["hot"] * 3000 + ["a", "b", None] * 40 + ["one"]] + [("none", None)]
    rows = [(k, None if v is None else float(v)) for k, v in rows]
    df = spark.createDataFrame(rows, "k string, v double").repartition(6)
    got = {r.k: (r.n, r.low, r.high) for r in scans.medians(df, ["k"], "v", 5, spread).collect()}
    want = {}
    for key in {k for k, _ in rows}:
        own = sorted(v for k, v in rows if k == key and v is not None)
        if own:
            want[key] = (len(own), own[(len(own) - 1) // 2], own[len(own) // 2])
    assert got == want
    whole = sorted(v for _, v in rows if v is not None)
    assert [tuple(r) for r in scans.medians(df, [], "v", 5, spread).collect()] == [(len(whole), whole[(len(whole) - 1) // 2], whole[len(whole) // 2])]
    assert scans.medians(df.limit(0), [], "v", 5, spread).collect() == []


def test_median_of_one_large_group(spark):
    big = spark.range(3_000_000).select(F.pmod(F.xxhash64("id"), F.lit(10_000_019)).alias("v"))
    r = scans.medians(big, [], "v", 16).first()
    assert (r.low + r.high) / 2 == big.agg(F.median("v")).first()[0]
