"""Sequence operators against plain loops on random streams; results don't depend on partitioning."""

import random

import pytest
from pyspark.sql import functions as F

from tracework.operators import sequence as S

KEYS, ORDER = ["s"], ["i"]


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    return [(s, i, rng.choice("pdxet"), rng.randint(0, 3)) for s in range(40) for i in range(rng.randint(1, 30))]


@pytest.fixture(scope="module", params=[1, 7])
def stream(request, spark, rows):
    return spark.createDataFrame(rows, "s int, i int, kind string, v int").repartition(request.param)


def by_stream(rows):
    out = {}
    for r in rows:
        out.setdefault(r[0], []).append(r)
    return out


def test_follow_up(stream, rows):
    got = {(r.s, r.i): r.reply for r in S.follow_up(stream, KEYS, ORDER, F.col("kind") == "p", F.col("kind") == "d", F.col("i")).where("kind = 'p'").collect()}
    want = {}
    for s, es in by_stream(rows).items():
        for n, e in enumerate(es):
            if e[2] == "p":
                want[s, e[1]] = None
                for f in es[n + 1 : n + 4]:
                    if f[2] == "p":
                        break
                    if f[2] == "d":
                        want[s, e[1]] = f[1]
                        break
    assert got == want


def test_nearest(stream, rows):
    got = {(r.s, r.i): r.c for r in stream.withColumn("c", S.nearest(stream, KEYS, ORDER, F.col("kind") == "t", F.col("i"))).collect()}
    for s, es in by_stream(rows).items():
        for n, e in enumerate(es):
            near = [f[1] for f in es[max(0, n - 5) : n][::-1] if f[2] == "t"] + [f[1] for f in es[n + 1 : n + 6] if f[2] == "t"]
            assert got[s, e[1]] == (near[0] if near else None)


def test_next_and_previous(stream, rows):
    d = stream.withColumn("index", F.col("i")).withColumns({"n": S.next_index(KEYS, ORDER, F.col("kind") == "e"), "p": S.previous_value(KEYS, ORDER, F.col("kind") == "x", F.col("v"))})
    got = {(r.s, r.i): (r.n, r.p) for r in d.collect()}
    for s, es in by_stream(rows).items():
        for n, e in enumerate(es):
            after = [f[1] for f in es[n + 1 :] if f[2] == "e"]
            before = [f[3] for f in es[:n] if f[2] == "x"]
            assert got[s, e[1]] == (after[0] if after else None, before[-1] if before else None)


def test_cap(stream, rows):
    got = {}
    for r in S.cap_events(stream, KEYS, ORDER, F.col("kind") == "e", 6).collect():
        got.setdefault(r.s, []).append((r["index"], r.i))
    for s, es in by_stream(rows).items():
        kept = [e[1] for n, e in enumerate(es) if n < 6 or e[2] == "e"]
        assert sorted(got[s]) == list(enumerate(kept))


def test_gap_boundaries(spark):
    e = spark.sql("select 1 s, timestamp_seconds(t) ts from values (0), (900), (1801), (1900) as x(t)")
    w = [(r["window"], r.events) for r in S.active_windows(e, ["s"], "ts", 900).orderBy("window").collect()]
    assert w == [(1, 2), (2, 2)]
    assert [r.seconds for r in S.active_seconds(e, ["s"], "ts", 900).collect()] == [999.0]


def test_concurrency(spark):
    rng = random.Random(4)
    rows = [(k, a, a + rng.randint(0, 9)) for k in range(20) for a in (rng.randint(0, 40) for _ in range(12))]
    got = {r.k: r.peak for r in S.max_concurrency(spark.createDataFrame(rows, "k int, a int, b int"), ["k"], "a", "b").collect()}
    for k in range(20):
        own = [(a, b) for x, a, b in rows if x == k]
        cur = best = 0
        for _, d in sorted([(a, 1) for a, _ in own] + [(b, -1) for _, b in own]):
            cur += d
            best = max(best, cur)
        assert got[k] == best


def test_busiest_hours(spark):
    rng = random.Random(5)
    rows = [(k, rng.randint(0, 23)) for k in range(10) for _ in range(15)]
    got = {r.k: (r.start, r.n, r.peak_hour) for r in S.busiest_hours(spark.createDataFrame(rows, "k int, h int"), ["k"], "h").collect()}
    for k in range(10):
        hist = [sum(1 for x, h in rows if x == k and h == i) for i in range(24)]
        sums = [sum(hist[(s + i) % 24] for i in range(4)) for s in range(24)]
        best = max(range(24), key=lambda s: (sums[s], -s))
        assert got[k] == (best, sums[best], max(range(24), key=lambda h: (hist[h], -h)))


def test_overlap_join(spark):
    rng = random.Random(6)
    span = lambda: sorted((rng.randint(0, 200_000), rng.randint(0, 200_000)))
    a, b = ([(i, *span()) for i in range(40)] for _ in range(2))
    left = spark.createDataFrame(a, "x int, p int, q int").selectExpr("1 k", "x", "timestamp_seconds(p) a_start", "timestamp_seconds(q) a_end")
    right = spark.createDataFrame(b, "y int, p int, q int").selectExpr("1 k", "y", "timestamp_seconds(p) b_start", "timestamp_seconds(q) b_end")
    got = sorted((r.x, r.y) for r in S.overlap_join(left, right, ["k"], 3600).collect())
    assert got == sorted((i, j) for i, p, q in a for j, u, v in b if u - 3600 <= q and p <= v + 3600)


def test_overlap_join_of_seconds_and_years(spark):
    """Intervals from a second to ten years, before and after the epoch, with shared ends; each is dealt to twice the logarithm of its cells at most."""
    rng = random.Random(16)

    def span():
        p = rng.choice([rng.randint(-400_000_000, 400_000_000), rng.randint(0, 50) * 3600])
        return p, p + rng.choice([0, 1, 60, 3600, 86_400, 7 * 86_400, 300_000_000, rng.randint(0, 315_360_000)])

    a, b = ([(i, *span(), rng.choice("xy")) for i in range(150)] for _ in range(2))
    a += [(1000, 5, 3, "x"), (1001, None, 3, "x")]
    left = spark.createDataFrame(a, "x long, p long, q long, k string").selectExpr("k", "x", "timestamp_seconds(p) a_start", "timestamp_seconds(q) a_end")
    right = spark.createDataFrame(b, "y long, p long, q long, k string").selectExpr("k", "y", "timestamp_seconds(p) b_start", "timestamp_seconds(q) b_end")
    for cell, pad in ((3600, 3600), (7, 0), (10**7, 1)):
        got = sorted((r.x, r.y) for r in S.overlap_join(left, right, ["k"], pad, cell).collect())
        assert got == sorted((i, j) for i, p, q, k in a for j, u, v, m in b if k == m and p is not None and p <= q and u - pad <= q and p <= v + pad)
    cells = spark.createDataFrame([(i, low := rng.randint(-10_000, 10_000), low + n) for i, n in enumerate([0, 1, 2, 7, 8, 63, 1000, 87_600, 10**9])], "i int, low long, high long")
    n = {r.i: (r.n, r.cells) for r in S._nodes(cells, "low", "high").groupBy("i").agg(F.count("*").alias("n"), F.sum(F.expr("shiftleft(1L, __level)")).alias("cells")).collect()}
    size = {r.i: r.high - r.low + 1 for r in cells.collect()}
    assert all(n[i][1] == size[i] and n[i][0] <= max(1, 2 * size[i].bit_length()) for i in size)


def test_a_long_stream_takes_linear_time(spark):
    import time

    df = spark.range(100_000).select(F.lit(1).alias("s"), F.col("id").alias("index"), (F.col("id") % 50_000 == 49_999).alias("x"))
    began = time.perf_counter()
    got = df.withColumn("n", S.next_index(KEYS, ["index"], F.col("x"))).agg(F.sum("n"), F.count("n")).first()
    assert tuple(got) == (49_999 * 49_999 + 99_999 * 50_000, 99_999)
    assert time.perf_counter() - began < 20


def test_numbered(spark):
    df = spark.range(1000).select(((F.col("id") * 37) % 1000).alias("x")).repartition(5)
    got = sorted((r.x, r.n) for r in S.numbered(df, ["x"], "n").collect())
    assert got == [(x, x + 1) for x in range(1000)]
    assert S.numbered(df.limit(0), ["x"], "n").collect() == []


@pytest.mark.parametrize("spread", [False, True])
def test_capped_text(spark, spread):
    rng = random.Random(12)
    rows = [(k, i, rng.choice([None, "", "a", "é" * 3, "word " * rng.randint(0, 30)])) for k in ("a", "b", None) for i in range(60)] + [("c", 0, None), ("d", 0, ""), ("d", 1, "")]
    df = spark.createDataFrame(rows, "k string, i int, t string").repartition(4)
    for cap in (0, 2, 10, 57, 400, 10**6):
        got = {r.k: r.text for r in S.capped_text(df, ["k"], ["i"], F.col("t"), cap, " | ", "text", spread=spread, ranges=5).collect()}
        want = {}
        for key in ("a", "b", None, "d"):
            whole = " | ".join(t for k, _, t in rows if k == key and t is not None)
            want[key] = whole if len(whole) <= cap else whole[: max(cap - 3, 0)] + "..."
        assert got == want, cap


def test_a_text_beyond_its_cap_is_not_gathered(spark):
    df = spark.range(200_000).select(F.lit(1).alias("k"), "id", F.repeat(F.lit("x"), 1000).alias("t"))
    out = S.capped_text(df, ["k"], ["id"], F.col("t"), 5000, "\n", "text")
    assert len(out.first().text) == 5000
