"""Vector codes and the manifest against plain loops, on tables with nulls, ties, repeated rows and clashing columns."""

import collections
import hashlib
import math
import random
import zlib

import numpy as np
import pytest

from tracework.llm import merkle, vectorcodes

# --- op12 ---

CLASH = "k long, v string, code string, slot int, l string, upper string"


def plain_codes(rows, parts=8, entries=16, rounds=6):
    """Lloyd with whole numbers of any size, all distances computed."""
    kept = [(i, lab, [max(-(2**24), min(2**24, math.floor(4096 * float(x)))) for x in v]) for i, lab, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    longest = max((len(v) for *_, v in kept), default=0)
    width = -(-longest // parts)
    kept = [(i, lab, v + [0] * (width * parts - len(v))) for i, lab, v in kept]
    kept.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[2]))
    books = [[v[p * width : (p + 1) * width] for _, _, v in kept[:entries]] for p in range(parts)]

    def nearest(p, x):
        return min((sum((a - b) ** 2 for a, b in zip(x, e, strict=True)), j) for j, e in enumerate(books[p]))

    def told():
        return [[nearest(p, v[p * width : (p + 1) * width]) for p in range(parts)] for *_, v in kept]

    for _ in range(rounds):
        got = told()
        for p in range(parts):
            for j in range(len(books[p])):
                mine = [v[p * width : (p + 1) * width] for (*_, v), g in zip(kept, got, strict=True) if g[p][1] == j]
                if mine:
                    books[p][j] = [sum(c) // len(mine) for c in zip(*mine, strict=True)]
    got = told()
    by = collections.Counter()
    for (_, lab, _), g in zip(kept, got, strict=True):
        by[lab] += sum(d for d, _ in g)
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return [(i, "".join(f"{j:02x}" for _, j in g), sum(d for d, _ in g), by[lab], digest) for (i, lab, _), g in zip(kept, got, strict=True)]


def frame(spark, rows):
    return spark.createDataFrame([(i, v, lab, *[None] * 6) for i, lab, v in rows], f"vec_id long, embedding array<float>, label int, {CLASH}").repartition(3)


def codes_of(df):
    return sorted(map(str, map(tuple, vectorcodes.codes(df).collect())))


def test_codes_with_odd_rows(spark):
    rng = random.Random(3)
    rows = [(i, rng.choice([None, 1, 2]), [rng.choice([-1.5, 0.0, 0.25, rng.uniform(-1, 1)]) for _ in range(16)]) for i in range(120)]
    rows += [(500, 1, None), (501, 1, [None] * 16), (502, 1, [float("nan")] * 16), (503, 2, [float("inf")] + [0.0] * 15), (504, 2, [0.0] * 16)]
    rows += [rows[5], rows[5], (None, None, rows[7][2]), (7, 1, rows[9][2]), (600, 1, [3e38] * 16), (601, 1, [0.5] * 3), (602, 2, [])]
    rows += [(700 + i, 1, rows[3][2]) for i in range(60)]  # ties
    assert codes_of(frame(spark, rows)) == sorted(map(str, plain_codes(rows)))


def test_codes_of_few_and_none(spark):
    rows = [(3, 1, [0.5, 1.0, -1.0]), (1, None, [0.25, -2.0, 0.0])]
    assert codes_of(frame(spark, rows)) == sorted(map(str, plain_codes(rows)))
    assert codes_of(frame(spark, rows).limit(0)) == []
    assert codes_of(frame(spark, [(1, 1, None)])) == []


def test_bounds_decide_as_all_distances_do():
    rng = np.random.default_rng(1)
    x = rng.integers(-40, 40, (3000, 4))
    book = x[:16].copy()
    groups = vectorcodes.entry_groups(book)
    own, upper, lower = vectorcodes.assign_first(x, book, groups, vectorcodes.GROUPS)
    made = 0
    for step in range(12):
        moved = book + rng.integers(-4 if step < 6 else -1, 2, book.shape)
        own, upper, lower, n = vectorcodes.assign_again(x, moved, book, groups, own, upper, lower)
        made += n
        book = moved
        d = ((x[:, None] - book[None]) ** 2).sum(2)
        assert (own == d.argmin(1)).all()
        exact = np.sqrt(d)
        assert (upper >= exact[np.arange(len(x)), own]).all()
        exact[np.arange(len(x)), own] = np.inf
        for g in range(vectorcodes.GROUPS):
            assert (lower[:, g] <= exact[:, groups == g].min(1, initial=np.inf)).all()
    assert made < 12 * x.shape[0] * len(book) * 0.8


# --- op13 ---


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def tree(hashes):
    """Root, and for each leaf the joined siblings on its left and right, level by level."""
    paths, own, nodes = [[] for _ in hashes], list(range(len(hashes))), hashes
    while len(nodes) > 1:
        for j, i in enumerate(own):
            low = i // 8 * 8
            paths[j].append(("".join(nodes[low:i]), "".join(nodes[i + 1 : low + 8])))
        own = [i // 8 for i in own]
        nodes = [digest(*nodes[b : b + 8]) for b in range(0, len(nodes), 8)]
    return nodes[0], paths


def plain_manifest(rows):
    by = collections.defaultdict(list)
    for doc, text, lang, source, n in rows:
        low = text
        if text is not None and doc is not None and zlib.crc32(str(doc).encode()) % 3 == 0:
            low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
        leaf, other = (digest(*map(field, (doc, source, lang, n, t))) for t in (text, low))
        by[lang].append((doc is not None, doc or 0, leaf, other))
    order = sorted(by, key=lambda g: (g is not None, (g or "").encode()))
    held = {g: (sorted(by[g]), *tree([x[2] for x in sorted(by[g])])) for g in order}
    root, above = tree([held[g][1] for g in order]) if order else (None, [])
    out = []
    for g, up in zip(order, above, strict=True):
        leaves, sub, paths = held[g]
        for (known, doc, leaf, other), path in zip(leaves, paths, strict=True):
            h = other
            for a, b in path + up:
                h = digest(a, h, b)
            out.append((doc if known else None, leaf, sub, root, digest(*[a + b for a, b in path + up]), h, h == root))
    return out


COLS = "doc_id long, text string, lang string, source string, n_chars long, g string, i long, h string, path string, kid int"


def manifest_of(spark, rows):
    df = spark.createDataFrame([(*r, *[None] * 5) for r in rows], COLS).repartition(3)
    got = merkle.manifest(df).select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()
    return sorted(map(str, map(tuple, got)))


@pytest.mark.parametrize("langs", [[None, "en", "de", "", "fr"], [f"l{i}" for i in range(20)], ["en"]])
def test_manifest(spark, langs):
    rng = random.Random(len(langs))
    rows = [(i, rng.choice([None, "", "A b Ü", "lower", "X" * 5000, f"Text {i}"]), rng.choice(langs), rng.choice([None, "s"]), rng.choice([None, i])) for i in range(150)]
    rows += [rows[3]] * 10 + [(None, "No id", langs[0], "s", 1), (3, "Same id", rows[3][2], None, None)]
    assert manifest_of(spark, rows) == sorted(map(str, plain_manifest(rows)))


def test_manifest_of_one_and_none(spark):
    one = [(0, "One Row", None, None, None)]
    assert manifest_of(spark, one) == sorted(map(str, plain_manifest(one)))
    assert manifest_of(spark, []) == []


def test_tampering_is_seen(spark):
    rows = [(i, f"Doc {i}" if i % 2 else f"doc {i}", "en", "s", 5) for i in range(70)]
    df = spark.createDataFrame([(*r, *[None] * 5) for r in rows], COLS)
    found = {r.doc_id: r.verified for r in merkle.manifest(df).collect()}
    assert found == {i: not (i % 2 and zlib.crc32(str(i).encode()) % 3 == 0) for i in range(70)}
