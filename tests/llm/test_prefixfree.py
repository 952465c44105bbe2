"""Repeated byte strings against a table of all windows."""

import collections
import hashlib
import random

import numpy as np
import pytest

from tracework.llm import prefixfree


def plain(rows, width):
    texts = [(t or "").encode() for _, t in rows]
    seen = collections.Counter(b[s : s + width] for b in texts for s in range(len(b) - width + 1))
    out = []
    for (doc, _), b in zip(rows, texts, strict=True):
        gone = bytearray(len(b))
        for s in range(len(b) - width + 1):
            if seen[b[s : s + width]] > 1:
                gone[s : s + width] = b"\x01" * width
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        runs = sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1]))
        out.append((doc, len(b), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(map(str, out))


def found(spark, rows, width, **more):
    df = spark.createDataFrame([(*r, *[None] * 5) for r in rows], "doc_id long, text string, k string, t int, m string, spans string, lo int").repartition(3)
    got = prefixfree.dedup_bytes(df, width, **more).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
    return sorted(map(str, map(tuple, got)))


def corpus(rng):
    def noise(n, letters="abcdefghij ü"):
        return "".join(rng.choice(letters) for _ in range(n))

    passage, long = noise(150), noise(700)
    rows = [(i, noise(rng.randint(0, 400))) for i in range(40)]
    rows += [(100 + i, noise(60) + passage[rng.randint(0, 30) : 150 - rng.randint(0, 30)] + noise(60)) for i in range(40)]  # edges differ on both sides
    rows += [(200 + i, long) for i in range(4)]  # copies
    rows += [(300 + i, long[:at] + "X" + long[at + 1 :]) for i, at in enumerate((50, 333, 600, 601))]  # edited copies
    rows += [(400, "a" * 500), (401, "a" * 90), (402, "ab" * 300), (403, None), (404, ""), (405, passage + passage), (406, long[::-1] * 3)]
    rows += [rows[3], rows[3], (None, rows[41][1]), (None, long[100:400]), (5, passage)]
    return rows


@pytest.mark.parametrize(("width", "trigger", "density"), [(40, 4, 7), (64, 8, 20), (30, 3, 200), (25, 5, 1)])
def test_against_all_windows(spark, width, trigger, density):
    rows = corpus(random.Random(width))
    assert found(spark, rows, width, trigger=trigger, density=density) == plain(rows, width)


def test_as_registered(spark):
    rng = random.Random(4)
    words = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyzé") for _ in range(rng.randint(1, 9))) for _ in range(500)]
    prose = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 900))) for _ in range(40)]
    rows = list(enumerate(prose))
    rows += [(100 + i, prose[i % 3][rng.randint(0, 80) :]) for i in range(9)]
    rows += [(200 + i, prose[20 + i][:300] + prose[5][1000 : 1400 + i * 10] + prose[21 + i][:300]) for i in range(12)]
    rows += [(300, "z" * 3000), (301, "z" * 500), (302, prose[7] * 40)]
    assert found(spark, rows, 400) == plain(rows, 400)


def test_windows_of_hot_stretches_are_counted(spark, monkeypatch):
    monkeypatch.setattr(prefixfree, "HOT", 3)
    rows = corpus(random.Random(8))
    assert found(spark, rows, 40, trigger=4, density=7) == plain(rows, 40)


def test_empty(spark):
    assert found(spark, [], 40) == []
    assert found(spark, [(1, None), (2, "short")], 40) == plain([(1, None), (2, "short")], 40)


def test_pieces_hold_each_window_once(monkeypatch):
    rng = np.random.default_rng(2)
    text = bytes(rng.integers(97, 105, 20_000, np.uint8))
    for piece, block in ((20_000, 20_000), (700, 5_000), (401, 1)):
        monkeypatch.setattr(prefixfree, "PIECE", piece)
        monkeypatch.setattr(prefixfree, "BLOCK", block)
        starts = [i for p in prefixfree.parses([text, text[:399], text[:400]]) for d, a, b in zip(p.doc, p.lo, p.hi, strict=True) for i in range((d << 32) + a, (d << 32) + b + 1)]
        assert sorted(starts) == [*range(20_000 - 399), 2 << 32]


def test_kept_bytes(spark):
    rows = [(1, "é" * 100 + "tail"), (2, "é" * 100)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (bytes(r.kept_bytes), r.removed_spans) for r in prefixfree.dedup_bytes(df, 40, with_bytes=True).collect()}
    assert got == {1: (b"tail", "0:200"), 2: (b"", "0:200")}
