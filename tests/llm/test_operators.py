"""The corpus operators against brute force, on fixtures with nulls, empties, copies, long texts and clashing columns."""

import hashlib
import random
import re

import numpy as np
import pytest
import xxhash

from tracework.llm import chat, decontaminate, embeddings, mixing, pii, quality, simhash, substrings, tokencount, urlrules

WORD = re.compile(r"[^\x20\x09-\x0D]+")
EXTRA = "k string, fp int, size string, component_id string, rep int, lot string, bucket int, t int, terms string, starts int, rule int, url int, copies int, skey int"
N_EXTRA = len(EXTRA.split(","))


def prose(rng, n):
    return " ".join(rng.choice(VOCABULARY) for _ in range(n))


_rng = random.Random(5)
VOCABULARY = ["".join(_rng.choice("abcdefghijklmnop") for _ in range(_rng.randint(1, 7))) for _ in range(400)] + ["État", "naïve", "über", "Ünï"]


def corpus():
    rng = random.Random(1)
    base = [prose(rng, rng.randint(1, 120)) for _ in range(40)]
    shared = prose(rng, 60)
    rows = [(i, t) for i, t in enumerate(base)]
    rows += [(100 + i, base[3]) for i in range(12)]  # copies
    rows += [(200 + i, f"{prose(rng, 20)} {shared}\t{prose(rng, 9)}") for i in range(6)]  # a passage that repeats
    rows += [(300, None), (301, ""), (302, " \n\t "), (303, "one"), (304, "one two"), (305, " a b " * 3000), (306, prose(rng, 9000))]
    rows += [(1, base[1]), (1, base[1]), (None, base[2])]  # repeated rows, no id
    words = base[5].split()
    rows += [(400, " ".join(["edited", *words[1:]]))]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", f"s{(i or 0) % 4}" if (i or 0) % 9 else None, *[None] * N_EXTRA) for i, t in corpus()]
    return spark.createDataFrame(rows, f"doc_id long, text string, lang string, source string, {EXTRA}").repartition(3)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


def words(text):
    return WORD.findall(text or "")


def as_counts(rows):
    return sorted(map(str, rows))


def components(n, pairs):
    up = list(range(n))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return [root(x) for x in range(n)]


# --- op9 ---


def brute_substrings(rows):
    """(doc, words, words removed, hash of the rest) by a table of all windows; texts that share an id come in the order of their hashes."""
    def place(doc, text, s=0):
        return doc is not None, doc or 0, np.uint64(xxhash.xxh64_intdigest((text or "").encode(), 42)).astype(np.int64), s

    seen, want = {}, []
    for doc, text in sorted(rows, key=lambda r: place(*r)):
        w = words(text)
        for s in range(len(w) - 19):
            seen.setdefault(tuple(w[s : s + 20]), place(doc, text, s))
    for doc, text in rows:
        w, gone = words(text), set()
        for s in range(len(w) - 19):
            if seen[tuple(w[s : s + 20])] != place(doc, text, s):
                gone.update(range(s, s + 20))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        want.append((doc, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return want


def test_substrings(docs, empty):
    want = brute_substrings(corpus())
    got = [(r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in substrings.dedup_substrings(docs).collect()]
    assert as_counts(got) == as_counts(want)
    assert sum(r[2] for r in want) > 1000
    texts = {(r.doc_id, r.kept_sha256): r.kept_text for r in substrings.dedup_substrings(docs, with_text=True).collect()}
    assert all(hashlib.sha256(t.encode()).hexdigest() == h for (_, h), t in texts.items())
    assert substrings.dedup_substrings(empty).collect() == []


def test_substrings_of_texts_that_share_an_id(spark):
    """A text keeps its words though another text of its id repeats; texts without an id are documents of their own."""
    rng = random.Random(31)
    a, b, c, d = (prose(rng, 40) for _ in range(4))
    rows = [(1, a), (2, a), (2, b), (None, c), (None, d), (None, f"{d} {c}"), (3, c), (4, f"{b} {b}"), (5, prose(rng, 30)), (5, None), (2, b)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = [(r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in substrings.dedup_substrings(df).collect()]
    assert as_counts(got) == as_counts(brute_substrings(rows))
    assert (2, 40, 0, hashlib.sha256(b.encode()).hexdigest()) in got


def test_substring_chunks_agree(docs, monkeypatch):
    """Small map chunks and many buckets give the same windows."""
    one = {(r.k, r.t): r.starts for r in substrings.repeated_windows(docs, buckets=2).collect()}
    monkeypatch.setattr(substrings, "CHUNK_WINDOWS", 200)
    assert one == {(r.k, r.t): r.starts for r in substrings.repeated_windows(docs, buckets=31).collect()}


def test_rolling_hash_is_exact():
    rng = np.random.default_rng(1)
    h = rng.integers(0, 2**63, 200, dtype=np.uint64)
    got = substrings.rolling(h, 7)
    want = [sum(int(h[i + j]) * pow(substrings._BASES[0], j, 2**64) for j in range(7)) % 2**64 for i in range(len(h) - 6)]
    assert [int(x) for x in got] == want


def test_places_round_trip():
    ids = np.array([-(2**63), 5, 5, 2**40], np.int64)
    doc, start = np.array([0, 1, 1, 1, 2, 3, 3]), np.array([3, 0, 1, 900, 2, 7, 70000], np.int64)
    for text in (np.array([9, -4, 2**62, 0], np.int64), np.zeros(4, np.int64)):
        got = substrings._unpack(substrings._pack(ids, text, doc, start))
        assert [x.tolist() for x in got] == [ids[doc].tolist(), text[doc].tolist(), start.tolist()]


# --- op6 ---


def brute_fingerprint(text):
    w = words((text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
    shingles = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash(docs, empty):
    rows = sorted(corpus(), key=lambda r: (r[0] is not None, r[0] or 0))
    fp = [brute_fingerprint(t) for _, t in rows]
    pairs = [(i, j) for i in range(len(rows)) for j in range(i) if (fp[i] ^ fp[j]).bit_count() <= 3]
    c = components(len(rows), pairs)
    want = [(rows[i][0], f"{fp[i]:016x}", rows[c[i]][0]) for i in range(len(rows))]
    got = [(r.doc_id, r.fingerprint, r.component_id) for r in simhash.near_duplicates(docs).collect()]
    assert as_counts(got) == as_counts(want)
    assert simhash.near_duplicates(empty).collect() == []


def test_golay_keys_meet():
    """Any two fingerprints within three bits share a key; words of a segment one bit apart share a codeword."""
    keys = simhash.golay_keys()
    assert (keys >= 0).sum(1).max() == 6 and (keys[:, 0] >= 0).all()
    sets = [set(k[k >= 0].tolist()) for k in keys]
    assert all(sets[x] & sets[x ^ (1 << b)] for x in range(0, 65536, 37) for b in range(16))
    rng = random.Random(2)
    for _ in range(300):
        a = rng.getrandbits(64)
        b = a
        for bit in rng.sample(range(64), rng.randint(0, 3)):
            b ^= 1 << bit
        _, ka = simhash.pair_keys(np.array([a], np.uint64))
        _, kb = simhash.pair_keys(np.array([b], np.uint64))
        assert set(ka.tolist()) & set(kb.tolist())


def test_long_runs_keep_links(monkeypatch):
    rng = random.Random(3)
    fp = np.array(sorted({0xABCD << 48 | rng.getrandbits(9) << 20 | rng.getrandbits(4) for _ in range(900)}), np.uint64)
    links = [(i, j) for i in range(len(fp)) for j in range(i) if int(fp[i] ^ fp[j]).bit_count() <= 3]
    want = components(len(fp), links)
    parts = [(int(p[a]), int(p[b])) for p in simhash._finer_runs(fp) for a, b in simhash._forest(fp[p], 3)]
    assert components(len(fp), parts) == want
    assert components(len(fp), simhash._forest(fp, 3)) == want


# --- op2 ---


def test_embeddings(spark):
    rng = np.random.default_rng(4)
    base = rng.standard_normal((60, 16))
    rows = [(i, v.astype(np.float32).tolist()) for i, v in enumerate(base)]
    rows += [(100 + i, base[0].astype(np.float32).tolist()) for i in range(30)]
    rows += [(200 + i, (base[i % 7] + 0.05 * rng.standard_normal(16)).astype(np.float32).tolist()) for i in range(150)]
    # id 300 stands twice, for different vectors
    rows += [(300, (2 * base[1]).astype(np.float32).tolist()), (400, None), (401, []), (402, [0.0] * 16), (403, [float("nan")] + [1.0] * 15), (404, [None] + [1.0] * 15), (405, [float("inf")] + [1.0] * 15), (406, [1.0, 2.0]), (1, rows[1][1])]
    df = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id long, embedding array<float>, label int, t int").repartition(3)
    got = embeddings.near_duplicates(df).collect()
    good = [i for i, (_, v) in enumerate(rows) if v and len(v) == 16 and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    u = np.array([rows[i][1] for i in good], float)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    near = (u @ u.T) >= 0.95
    np.fill_diagonal(near, False)
    order = sorted(range(len(good)), key=lambda x: rows[good[x]][0])
    rank = {x: r for r, x in enumerate(order)}
    c = components(len(good), [(rank[a], rank[b]) for a, b in zip(*map(list, np.nonzero(near)), strict=True)])
    want = {(rows[good[x]][0], int(near[x].sum()), rows[good[order[c[rank[x]]]]][0]) for x in range(len(good))}
    want |= {(rows[i][0], 0, rows[i][0]) for i in range(len(rows)) if i not in good}
    assert len(got) == len(rows)
    assert {(r.vec_id, r.n_links, r.component_id) for r in got} == want and len(want) > 150
    assert all(r.kept == (r.vec_id == r.component_id) for r in got)
    assert embeddings.near_duplicates(df.limit(0)).collect() == []


def test_blocks_find_the_same_links(spark, monkeypatch):
    rng = np.random.default_rng(6)
    v = rng.standard_normal(8)
    df = spark.createDataFrame([(i, (v + 0.08 * rng.standard_normal(8)).tolist()) for i in range(120)], "vec_id long, embedding array<double>")
    want = {(r.vec_id, r.n_links, r.component_id) for r in embeddings.near_duplicates(df).collect()}
    monkeypatch.setattr(embeddings, "BLOCK", 16)
    assert {(r.vec_id, r.n_links, r.component_id) for r in embeddings.near_duplicates(df).collect()} == want


def test_links_at_the_threshold_are_met(spark):
    """Of 500 planted pairs with cosine from 0.95 to 0.951 among 6000 rows, the tables meet the promised share; no pair below 0.95 links."""
    rng = np.random.default_rng(8)
    base = rng.standard_normal((5000, 48))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    side = rng.standard_normal((1000, 48))
    side -= (side * base[:1000]).sum(1, keepdims=True) * base[:1000]
    side /= np.linalg.norm(side, axis=1, keepdims=True)
    goal = np.r_[rng.uniform(0.95 + 1e-9, 0.951, 500), rng.uniform(0.949, 0.95 - 1e-9, 500)][:, None]
    vectors = np.concatenate([base, goal * base[:1000] + np.sqrt(1 - goal**2) * side])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>")
    got = {r.vec_id: r for r in embeddings.near_duplicates(df).collect()}
    linked = [i for i in range(500) if got[i].n_links == 1 and got[5000 + i].component_id == i]
    assert len(linked) >= 495
    assert sum(r.n_links for r in got.values()) == 2 * len(linked) and len(got) == 6000
    for every in (embeddings.near_duplicates(df, exact=True), embeddings.near_duplicates(df, recall=1.0)):
        found = {r.vec_id: r for r in every.collect()}
        assert all(found[i].n_links == 1 and found[5000 + i].component_id == i for i in range(500)) and sum(r.n_links for r in found.values()) == 1000


def test_ties_at_the_threshold_link(spark):
    """Cosines that are the threshold itself, to the last bit, link; the next double below doesn't."""
    rows = [(0, [4.0, 3.0]), (1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [3.0, 4.0]), (4, [0.0, -1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    links = lambda at: {r.vec_id: r.n_links for r in embeddings.near_duplicates(df, at, exact=True).collect()}
    assert links(0.8) == {0: 2, 1: 1, 2: 1, 3: 2, 4: 0}
    assert links(float(np.nextafter(0.8, 1))) == {0: 1, 1: 0, 2: 0, 3: 1, 4: 0}


# --- op3 ---

PATTERNS = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]


def brute_spans(text):
    out = []
    for kind, p in enumerate(PATTERNS):
        for m in re.finditer(p, text):
            digits = re.sub("[^0-9]", "", m[0])
            total = sum(d if k % 2 == 0 else 2 * d - 9 * (d > 4) for k, d in enumerate(map(int, digits[::-1])))
            if (kind == 1 and any(int(x) > 255 for x in m[0].split("."))) or (kind == 2 and not (16 <= len(digits) <= 19 and total % 10 == 0)) or (kind == 3 and not 8 <= len(digits) <= 15):
                continue
            out.append((kind, *m.span()))
    return out


def test_base_spans_match_the_patterns():
    rng = random.Random(8)
    pieces = ["a", "b.c", "@", "@x.y", "x@y.z-w.q", ".", "-", " ", "+", "1", "12.3.4.255", "1.2.3.256", "4644348398010899", "4644 3483-9801 0899", "+1 (743) 555-3824", "é", "%", "\n", "00", "255.1.1.1.7.8.9.10", "user@@h.io", "+44"]
    for _ in range(4000):
        text = "".join(rng.choice(pieces) for _ in range(rng.randint(1, 12)))
        assert pii.base_spans(text) == brute_spans(text), text


def test_pii_terms(spark, empty):
    """A word that only ever stands beside one number, in different contexts, discloses it; copies of one text don't."""
    rng = random.Random(9)
    rows = [(i, f"{prose(rng, 12)} zorblax +1 (743) 555-3824 {prose(rng, 12)}") for i in range(6)]
    rows += [(50 + i, prose(rng, 40)) for i in range(60)]
    copy = f"{prose(rng, 5)} quuxly me@example.org {prose(rng, 5)}"
    rows += [(200 + i, copy) for i in range(5)] + [(300, None), (301, ""), (None, "call 10.0.0.1"), (1, rows[1][1])]
    df = spark.createDataFrame([(i, t, 1, 1) for i, t in rows], "doc_id long, text string, terms int, near int")
    got = pii.personal_data(df).collect()
    assert len(got) == len(rows)
    text = {i: t or "" for i, t in rows}
    for r in got:
        base = brute_spans(text[r.doc_id])
        line = pii.joined(base)
        assert r.base_sha256 == hashlib.sha256(line.encode()).hexdigest()
        assert r.spans.startswith(line) and (r.n_email, r.n_phone) == (sum(k == 0 for k, *_ in base), sum(k == 3 for k, *_ in base))
        terms = {text[r.doc_id][int(s.split(":")[1]) : int(s.split(":")[2])] for s in r.spans.split(",") if s.startswith("term")}
        assert terms == ({"zorblax"} if r.doc_id is not None and r.doc_id < 6 else set())
    assert pii.personal_data(empty).collect() == []


def test_terms_of_rare_entities(spark):
    """Two documents are enough for an entity, and a term counts and is marked anywhere in them; near copies and a single document aren't."""
    rng = random.Random(16)
    mail = "regards from here bob@site.org bye for now"
    rows = [(i, f"{prose(rng, 20)} Zorblax {prose(rng, 30)} {mail} {prose(rng, 20)} zorblax") for i in range(2)]
    near = prose(rng, 60).split()
    rows += [(10 + i, f"Quuxly {' '.join(near[:30])} call {('one', 'two')[i]} 10.0.0.1 {' '.join(near[30:])}") for i in range(2)]
    rows += [(20, f"{prose(rng, 20)} Plimsy {prose(rng, 9)} 10.0.0.2"), *((100 + i, f"{prose(rng, 40)} regards from here bye for now call") for i in range(400))]
    got = {r.doc_id: r for r in pii.personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for k, text in rows:
        terms = [text[int(s.split(":")[1]) : int(s.split(":")[2])] for s in got[k].spans.split(",") if s.startswith("term")]
        assert terms == (["Zorblax", "zorblax"] if k < 2 else []) and got[k].n_terms == len(terms), k


def brute_terms(rows, alpha=pii.ALPHA, generalise=pii.GENERALISE, remove=pii.REMOVE):
    """{(id, text): {(begin, end, removed)}} by tables of all documents, entities and terms, from the definitions."""
    from math import log2

    docs = [(k, t or "", brute_spans(t or "")) for k, t in rows]
    held = [(k, t, {(s[0], (t[s[1] : s[2]].lower() if s[0] < 2 else re.sub("[^0-9]", "", t[s[1] : s[2]]))) for s in spans}, pii.terms_of(t, spans)) for k, t, spans in docs if spans]
    n_docs, tests = len(docs), max(sum(len({w for w, *_ in terms}) for *_, terms in held), 1)
    bound = log2(alpha / tests)

    def origin_count(texts):
        marks = [pii.origins([w for w, *_ in x]) for x in texts]
        return sorted(len({m[i] for m in marks}) for i in range(3))[1]

    def accident(total, m, n):
        rest = total - m
        return m * log2(total / m) + (rest * log2(total / rest) if rest else 0) + m * log2(min(n / n_docs, 1))

    out = {}
    for e in set().union(*(h[2] for h in held)):
        mine = [h for h in held if e in h[2]]
        total = origin_count([h[3] for h in mine])
        if len(mine) >= n_docs:
            continue
        for term in {w for h in mine for w, *_ in h[3]}:
            both = [h for h in mine if any(w == term for w, *_ in h[3])]
            known = min(origin_count([h[3] for h in both]), total)
            n = sum(term in {w for raw in t.split() for w in re.findall(r"[^\W_]+", raw.lower())} for _, t, _ in docs)
            information = log2(n_docs / len(mine))
            share = (information + log2(min(len(both) / n, 1))) / information
            if share > generalise and accident(total, known, max(n - len(both), 0) + known) <= bound:
                for k, t, _, terms in both:
                    for w, a, b in terms:
                        if w == term:
                            out.setdefault((k, t), {})[a, b] = out.get((k, t), {}).get((a, b), False) or share > remove
    return {key: {(a, b, gone) for (a, b), gone in v.items()} for key, v in out.items()}


def test_terms_against_tables(spark):
    """All terms of a corpus with shared numbers, common and rare words beside them, nulls, copies and a text of 4000 addresses."""
    rng = random.Random(19)
    names = [f"Name{c}{c}" for c in "abcdefghijkl"]
    rows = []
    for i in range(260):
        e = i % 12 if i % 3 == 0 else None
        extra = "" if e is None else f" {names[e]} +1 (743) 555-38{e:02d} {names[e] if rng.random() < 0.3 else ''} {'often' if rng.random() < 0.9 else ''}"
        rows.append((i, f"{prose(rng, rng.randint(15, 40))}{extra} {prose(rng, 15)}"))
    rows += [(300, f"{prose(rng, 20)} Nameaa {prose(rng, 20)}"), (None, None), (None, rows[0][1]), (0, rows[0][1]), (400, ""), (401, " ".join(f"user{i}@host{i}.org" for i in range(4000)))]
    got = {}
    for r in pii.find(spark.createDataFrame(rows, "doc_id long, text string")).join(spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "xxhash64(coalesce(text, '')) as t"), "t").select("k", "doc_id", "text", "terms").collect():
        if r.terms and (r.k == r.doc_id or (r.doc_id is None and r.k == -(2**63))):
            got[r.doc_id, r.text] = {(x.begin, x.end, x.removed) for x in r.terms}
    want = brute_terms(rows)
    assert got == want and sum(map(len, want.values())) > 50


def test_many_addresses_take_linear_time():
    import time

    text = " ".join(f"user{i}@host{i}.org and words" for i in range(40_000))
    began = time.perf_counter()
    spans = pii.base_spans(text)
    assert len(spans) == 40_000 and len(pii.terms_of(text, spans)) == 80_000
    assert time.perf_counter() - began < 5


def test_terms_are_outside_spans():
    rng = random.Random(17)
    for _ in range(500):
        text = "".join(rng.choice(["ab", "c", "_", " ", "12", "é", "-", "DE"]) for _ in range(rng.randint(1, 30)))
        spans = [(0, a, a + rng.randint(1, 9)) for a in (rng.randrange(len(text)) for _ in range(rng.randint(0, 4)))]
        want = [(m[0].lower(), *m.span()) for m in re.finditer(r"[^\W_]+", text) if len(m[0]) > 1 and not m[0].isdigit() and not any(a < m.end() and m.start() < b for _, a, b in spans)]
        assert pii.terms_of(text, spans) == want


def test_sanitised():
    assert pii.sanitised("mail a@b.co or zed now", "email:5:11", [(15, 18, False), (19, 22, True)]) == "mail <email> or <term> "


# --- op4 ---


def test_quality(spark, empty):
    rng = random.Random(10)
    rows, labels = [], []
    for i in range(500):
        bad = i % 4 == 0
        t = prose(rng, rng.randint(10, 60))
        rows.append((i, " ".join(w.upper() + "!!" for w in t.split()) if bad else t.capitalize() + "."))
        labels.append((i, 0 if bad else 1))
    rows += [(900, None), (901, ""), (None, "plain text here"), (1, rows[1][1])]
    docs = spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id long, text string, score int")
    known = spark.createDataFrame(labels + [(None, 1), (5, None)], "doc_id long, quality int")
    got = quality.score(docs, known).collect()
    assert len(got) == len(rows)
    truth = dict(labels)
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert len(held) > 50 and sum(r.predicted == truth[r.doc_id] for r in held) / len(held) > 0.97
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got)
    assert quality.score(empty, known).collect() == []
    only_good = quality.score(docs, known.where("quality = 1")).collect()
    assert all(r.predicted == 1 for r in only_good)


def test_fit_against_a_plain_solver(monkeypatch):
    """Ratios from counts, and the primal optimum of the hinge loss by subgradients of every example, slowly."""
    monkeypatch.setattr(quality, "SLOTS", 32)
    rng = np.random.default_rng(5)
    y = np.where(rng.random(60) < 0.3, -1, 1)
    rows = [np.flatnonzero(rng.random(32) < np.where(np.arange(32) % 3 == 0, 0.3 + 0.25 * s, 0.2)).astype(np.int32) for s in y]
    w, b = quality.fit(rows, y, rounds=3000)
    dense = np.zeros((60, 32))
    for i, x in enumerate(rows):
        dense[i, x] = 1 / np.sqrt(max(len(x), 1))
    counts = [1 + sum(np.isin(np.arange(32), x) for x, s in zip(rows, y, strict=True) if s == c) for c in (1, -1)]
    ratio = np.log(counts[0] / counts[0].sum()) - np.log(counts[1] / counts[1].sum())
    scaled = dense * ratio
    cost = np.array([60 / (2 * (y == s).sum()) for s in y])

    def loss(v, c):
        return 0.5 * (v @ v + c * c) + (cost * np.maximum(0, 1 - y * (scaled @ v + c))).sum()

    v, c, best = np.zeros(32), 0.0, np.inf
    for step in range(1, 60_001):
        inside = cost * y * (y * (scaled @ v + c) < 1)
        v, c = v - (v - inside @ scaled) / step, c - (c - inside.sum()) / step
        best = min(best, loss(v, c))
    inner = np.divide(w, ratio, out=np.zeros(32), where=ratio != 0)
    assert loss(inner, b) <= best * 1.0001 and loss(inner, b) >= best * 0.98


def test_quality_samples(spark):
    """Ids that repeat among labels and documents, ties, a bound of bytes, a text of 200 000 words: one model, whatever the partitions."""
    rng = random.Random(23)
    rows = [(i, prose(rng, 30) if i % 2 else prose(rng, 30).upper() + " !!") for i in range(160)]
    rows += [(1, prose(rng, 5)), (2, rows[2][1]), (2, rows[2][1]), (777, prose(rng, 200_000)), (779, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    known = spark.createDataFrame([(i, i % 2) for i in range(160)] + [(3, 0), (3, 1), (5, 1), (777, 1), (779, 0), (999, 1)], "doc_id long, quality int")
    one, two = (quality.train(d, known, sample=50, sample_bytes=4000) for d in (docs.repartition(1), docs.repartition(5)))
    assert (one.weights == two.weights).all() and one.score(np.empty(0, np.int32)) == two.score(np.empty(0, np.int32))
    got = quality.score(docs, known, sample=50).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    assert len({r.score for r in got if r.doc_id == 2}) == 1


# --- op5 ---

RULES = [("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/"), ("block", "a.org", ""), ("allow", "a.org", "/x"), ("block", "a.org", "/x/y"), ("allow", "A.org", "/x/y")]


def test_url_rules(spark):
    rng = random.Random(11)
    hosts = ["example.com", "EXAMPLE.com", "b.example.com", "com", "xcom", "example.net", "a.org", "z.a.org", "za.org", "", "org", "net."]
    paths = ["", "/", "/en/", "/en/7", "/en/75/x", "/en", "/de/8", "/de/9", "/es/", "/x", "/x/y", "/x/yz", "/w", "/\xff", "/en/7\U0010ffff"]
    rows = [(i, f"http{rng.choice(['', 's'])}://{rng.choice(hosts)}{rng.choice(paths)}{rng.choice(['', '?a=://q', '#t'])}") for i in range(400)]
    rows += [(900, None), (901, ""), (902, "no scheme/en/"), (3, rows[3][1]), (3, rows[3][1]), (None, "https://example.com/en/1")]

    def judged(url):
        m = re.search(r"://([^/?#]*)([^?#]*)", url or "", re.S)
        host, path = (m[1].translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")), m[2]) if m else ("", "")
        best = max(((len(h) + len(p), len(h), h + p, a) for a, h, p in ((a, h.lower(), p) for a, h, p in RULES) if (host == h or host.endswith("." + h)) and path.startswith(p)), default=None)
        return host, path, best and best[2], best[3] if best else "allow"

    df = spark.createDataFrame([(i, u, 1, 2) for i, u in rows], "page_id long, url string, host int, rule int")
    got = [(r.page_id, r.host, r.path, r.rule, r.verdict) for r in urlrules.judge(df, urlrules.rules_frame(spark, RULES)).collect()]
    assert as_counts(got) == as_counts([(i, *judged(u)) for i, u in rows])
    assert len(urlrules.judge(df, urlrules.rules_frame(spark, [])).where("verdict = 'allow'").collect()) == len(rows)
    assert urlrules.judge(df.limit(0), urlrules.rules_frame(spark, RULES)).collect() == []


def test_lanes_of_a_hot_host(spark):
    df = spark.createDataFrame([(i, f"https://example.com/en/{i}") for i in range(200)], "page_id long, url string")
    got = {r.page_id: r.verdict for r in urlrules.judge(df, urlrules.rules_frame(spark, RULES)).collect()}
    assert got == {i: "allow" if str(i).startswith("7") else "block" for i in range(200)}


# --- op7 ---


def test_decontaminate(spark, empty):
    rng = random.Random(12)
    items = [(i, prose(rng, 40)) for i in range(5)]
    w = items[2][1].split()
    edited = " ".join(x if k % 7 else "changed" for k, x in enumerate(w))
    rows = [(i, prose(rng, 150)) for i in range(40)]
    rows += [(100 + i, f"{prose(rng, 30)} {items[0][1].upper()}, {prose(rng, 30)}") for i in range(25)]  # one passage in many documents
    rows += [(200, f"{prose(rng, 10)} {edited} {prose(rng, 10)}"), (201, items[3][1]), (300, None), (301, ""), (None, items[4][1]), (201, items[3][1])]
    docs = spark.createDataFrame([(i, t, 1, 1) for i, t in rows], "doc_id long, text string, item_id int, score int")
    bench = spark.createDataFrame([*items, (None, "few words"), (9, None), items[1]], "item_id long, text string")
    got = {r.doc_id: r for r in decontaminate.contaminated(docs, bench).collect()}
    assert len(got) == len({i for i, _ in rows})
    assert {k for k, r in got.items() if r.contaminated} == {*range(100, 125), 200, 201, None}
    assert got[110].score == 1.0 and got[110].item_id == 0 and 0.5 <= got[200].score < 1.0 and got[200].item_id == 2
    begin, end = map(int, got[110].spans.split(":")[1:])
    assert (begin, end) == (30, 70)
    assert not any(r.contaminated for r in decontaminate.contaminated(docs, bench.limit(0)).collect())
    assert decontaminate.contaminated(empty, bench).collect() == []


def test_copies_with_few_trigrams_left(spark):
    """Copies that lost more than half of their item's trigrams are met, with and without verbatim copies elsewhere."""
    rng = random.Random(15)
    items = [(i, prose(rng, 40)) for i in range(13)]
    rows = [(i, prose(rng, 150)) for i in range(20)]
    for i, text in items[:12]:
        # each item has one worn copy, and none, one or three verbatim ones
        w = text.split()
        worn = [" ".join(x if k % 4 else "changed" for k, x in enumerate(w)), " ".join(x if k % 5 else "changed" for k, x in enumerate(w)), " ".join(w[:20]), " ".join(w[20:])][i % 4]
        rows += [(100 + i, f"{prose(rng, 30)} {worn} {prose(rng, 30)}")]
        rows += [(200 + 10 * i + j, f"{prose(rng, 9)} {text}") for j in range((0, 1, 3)[i // 4])]
    # a copy with words put in between, more than half of its item's length
    w = items[12][1].split()
    rows += [(400, " ".join(w[:20]) + " " + prose(rng, 24) + " " + " ".join(w[20:]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in decontaminate.contaminated(docs, spark.createDataFrame(items, "item_id long, text string")).collect()}
    for k, text in rows:
        best = max((brute_alignment(t.split(), text.split()) / (2 * len(t.split())), -i) for i, t in items)
        assert got[k].contaminated == (best[0] >= 0.5), k
        assert not got[k].contaminated or (got[k].item_id, got[k].score) == (-best[1], round(best[0], 6)), k
    assert all(got[100 + i].contaminated for i in range(12)) and got[400].contaminated


def test_short_items_and_worn_copies(spark):
    """Items of one or two words are seeds by themselves; with every word for a seed each copy is met."""
    rng = random.Random(21)
    items = [(0, "zebrafish"), (1, "quantum lobster"), (2, prose(rng, 30)), (3, prose(rng, 31)), (4, ""), (5, None)]
    third = " ".join(w if k % 3 else "changed" for k, w in enumerate(items[2][1].split()))
    apart = " ".join(f"{w} between" for w in items[3][1].split())
    rows = [(0, "a zebrafish swims"), (1, "the quantum lobster"), (2, "quantum and lobster"), (3, f"{prose(rng, 9)} {third} {prose(rng, 9)}"), (4, apart), (5, prose(rng, 50)), (6, None), (7, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert {r.doc_id for r in decontaminate.contaminated(docs, bench).collect() if r.contaminated} >= {0, 1}
    got = {r.doc_id: r for r in decontaminate.contaminated(docs, bench, seed_words=1).collect()}
    for k, text in rows:
        best = max(brute_alignment(t.split(), (text or "").split()) / (2 * len(t.split())) for _, t in items if t)
        assert got[k].contaminated == (best >= 0.5), k
        assert not got[k].contaminated or got[k].score == round(best, 6)
    assert got[3].contaminated and got[4].contaminated
    for seeds in (1, 3):
        clean = {r.doc_id for r in decontaminate.clean(docs, bench, seed_words=seeds).collect()}
        assert clean == {r.doc_id for r in decontaminate.contaminated(docs, bench, seed_words=seeds).collect() if not r.contaminated}


def test_seeds_meet_worn_copies(spark):
    """Recall of trigram seeds over all items: copies with 5 to 30 % of words changed, dropped or doubled, against every word as a seed."""
    rng = random.Random(22)
    items = [(i, prose(rng, rng.randint(3, 60))) for i in range(80)]
    rows = []
    for i, text in items:
        for wear in (0.05, 0.15, 0.3):
            out = []
            for w in text.split():
                out += [w] if rng.random() > wear else rng.choice([["changed"], [], [w, "more"]])
            rows.append((len(rows), f"{prose(rng, 40)} {' '.join(out)} {prose(rng, 40)}"))
    docs, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    met, every = ({r.doc_id for r in decontaminate.contaminated(docs, bench, seed_words=n).collect() if r.contaminated} for n in (3, 1))
    assert met <= every and len(every) > 200 and len(met) / len(every) >= 0.9


def brute_alignment(a, b):
    h = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a, 1):
        for j, y in enumerate(b, 1):
            h[i][j] = max(0, h[i - 1][j - 1] + (2 if x == y else -1), h[i - 1][j] - 1, h[i][j - 1] - 1)
    return max(map(max, h))


def test_alignment_is_smith_waterman():
    rng = random.Random(13)
    for _ in range(300):
        a, b = ([rng.randint(1, 5) for _ in range(rng.randint(1, 15))] for _ in range(2))
        assert decontaminate.align(np.array(a), np.array(b))[0] == brute_alignment(a, b)


def test_blocks_cover_the_benchmark(spark):
    bench = spark.createDataFrame([(i, prose(random.Random(i), 30)) for i in range(20)], "item_id long, text string")
    parts = list(decontaminate.blocks(bench, block_words=100))
    assert len(parts) > 1 and sorted(i for p in parts for i in p.ids) == list(range(20))


# --- op8 ---


def test_token_counts(docs, empty, spark, monkeypatch):
    public_tokenizers = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = str(public_tokenizers.path("word_bpe_49k.json"))
    tok = Tokenizer.from_file(path)
    odd = ["It's  we'll don't", "a<|endoftext|>b <|startoftext|>", "é É İ", "x y\u0085z", "12345 !!!???", "日本語 テキスト", "\x00a\x1cb", "Σας ΣΑΣ", "a\r\nb\x0bc\x0cd"]
    rows = corpus() + [(700 + i, t) for i, t in enumerate(odd)]
    df = spark.createDataFrame([(i, t) for i, t in rows], "doc_id long, text string")
    want = [(i, len((t or "").encode()), len(tok.encode(t or "", add_special_tokens=False).ids)) for i, t in rows]
    got = tokencount.token_counts(df, path, 100).collect()
    assert as_counts([(r.doc_id, r.n_bytes, r.n_tokens) for r in got]) == as_counts(want)
    assert all(r.over_limit == (r.n_tokens > 100) for r in got)
    assert tokencount.token_counts(empty, path).collect() == []
    monkeypatch.setattr(tokencount, "CHUNK_WORDS", 500)
    assert as_counts(tokencount.token_counts(df.repartition(3), path, 100).collect()) == as_counts(got)
    with pytest.raises(ValueError, match="white space"):
        tokencount.check(str(public_tokenizers.path("byte_bpe_50k.json")))


def test_numbers_by_bytes():
    for v in ([], [0], [1, 255, 256, 70000, 2**40], [3] * 9):
        assert tokencount._values(tokencount._planes(np.array(v, np.int64))).tolist() == v


# --- op10 ---


def brute_targets(sizes):
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    total, stopped = sum(sizes.values()), set()
    while True:
        free = [s for s in names if s not in stopped]
        left = total - sum(3 * sizes[s] for s in stopped)
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] > 3 * sizes[s]}
        if not over:
            return {s: 3 * sizes[s] if s in stopped else share[s] for s in names}
        stopped |= over


def near_targets(rows, want):
    """Fewer words are left of a target than any document not taken in the last round has."""
    for s in want:
        mine = [(size, copies) for source, size, copies in rows if source == s and size]
        rounds = min((c for _, c in mine), default=0)
        left = int(want[s] + 1e-9) - sum(size * c for size, c in mine)
        assert 0 <= left
        if len({c for _, c in mine}) == 2 or want[s] < 3 * sum(size for size, _ in mine) - 1e-6:
            assert left < min(size for size, c in mine if c == rounds), s


@pytest.mark.parametrize("seed", range(3))
def test_mixing_passes_over_what_is_too_large(spark, seed):
    """Documents larger than the rest of a budget don't end the sweep, wherever their lots lie."""
    rng = random.Random(seed)
    rows = [(i, rng.choice([1, 7, 10, 10, 10, rng.randint(1, 300)]), rng.choice("abcd")) for i in range(300)]
    rows += [(1000 + i, rng.randint(3000, 9000), s) for i, s in enumerate("aabcd")] + [(2000, 5000, "e"), *((2001 + i, 10, "e") for i in range(100))]
    df = spark.createDataFrame([(i, "w " * n, s) for i, n, s in rows], "doc_id long, text string, source string")
    sizes = {s: sum(n for _, n, x in rows if x == s) for s in "abcde"}
    got = mixing.mix(df).collect()
    source = {i: s for i, _, s in rows}
    near_targets([(source[r.doc_id], r.size, r.copies) for r in got], brute_targets(sizes))
    again = mixing.with_copies(df, mixing.plan(df)[1], "n").collect()
    assert {(r.doc_id, r.n) for r in again} == {(r.doc_id, r.copies) for r in got}


def test_mixing(spark, docs, empty):
    rng = random.Random(14)
    rows = [(i, prose(rng, rng.randint(1, 50)), rng.choice(["a", "b", "b", "b", "b", "é", "zz", None, ""])) for i in range(900)]
    rows += [(2000 + i, prose(rng, 5), "tiny") for i in range(3)] + [(3000, None, "none"), (None, "x y", "a"), (1, rows[1][1], rows[1][2])]
    df = spark.createDataFrame([(i, t, s, 1) for i, t, s in rows], "doc_id long, text string, source string, size int")
    got = mixing.mix(df).collect()
    assert len(got) == len(rows)
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len(words(t))
    want = brute_targets(sizes)
    source = {i: s for i, _, s in rows}
    for r in got:
        s = source[r.doc_id]
        assert r.source_size == sizes[s] and abs(r.target - want[s]) < 1e-6 and r.taken in (0, r.size, 2 * r.size, 3 * r.size)
    near_targets([(source[r.doc_id], r.size, r.copies) for r in got], want)
    again = mixing.mix(df.repartition(7)).collect()
    assert as_counts(again) == as_counts(got)
    assert mixing.mix(empty).collect() == []
    n = [(r.doc_id, r.size) for r in mixing.mix(docs).collect()]
    assert as_counts(n) == as_counts([(i, len(words(t))) for i, t in corpus()])


@pytest.mark.parametrize("doc", [7, None])
def test_mixing_takes_as_many_of_equal_rows_as_fit(spark, doc):
    """Equal rows are interchangeable, so a target is met within one row of them."""
    rows = [(doc, "w " * 10, "a")] * 900 + [(10_000 + i, "w " * 10, "b") for i in range(90)] + [(doc, "w " * 10, "c")] * 300
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    got = mixing.mix(df).collect()
    taken, target = {}, {}
    for r in got:
        taken[r.source_size] = taken.get(r.source_size, 0) + r.taken
        target[r.source_size] = r.target
    assert len(got) == 1290 and set(taken) == {9000, 900, 3000}
    assert all(target[s] - 10 < taken[s] <= target[s] for s in taken)
    assert max(r.copies for r in got) <= 3
    assert as_counts(mixing.mix(df.repartition(2)).collect()) == as_counts(got)
    again = mixing.with_copies(df, mixing.plan(df)[1], "n").groupBy("doc_id", "source", "n").count().collect()
    assert sum(r["count"] * r.n * 10 for r in again) == sum(r.taken for r in got)


# --- op1 ---


def test_preferences(spark):
    rows = [
        (0, 0, "system", "be kind"), (0, 1, "user", "hi"), (0, 2, "assistant", "hello"), (0, 3, "user", None), (0, 4, "assistant", "bye"),
        (1, 1, "user", "hi"), (1, 0, "system", "be kind"), (1, 2, "assistant", "go away"),
        (2, 0, "user", "alone"), (5, 0, None, "odd"), (None, 0, "user", "no id"),
        (6, 0, "user", "same"), (6, 0, "user", "same"), (7, 0, "user", "same"), (7, 0, "user", "same"),
    ]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "conv_id long, turn long, role string, text string, turns int, chosen int")
    got = {r.pair_id: r for r in chat.preferences(df).collect()}
    a = got[0]
    assert a.paired and a.n_prompt_turns == 2 and a.prompt == "<|im_start|>system\nbe kind<|im_end|>\n<|im_start|>user\nhi<|im_end|>\n"
    assert a.rejected_completion == "<|im_start|>assistant\ngo away<|im_end|>\n"
    spans = [tuple(map(int, s.split(":"))) for s in a.chosen_mask.split(",")]
    assert [a.chosen_completion[b:e] for b, e in spans] == ["hello<|im_end|>", "bye<|im_end|>"]
    assert not got[1].paired and got[1].rejected_completion == "" and got[1].prompt == ""
    assert not got[2].paired and got[2].chosen_completion == "" and got[2].rejected_mask == ""
    assert got[3].n_prompt_turns == 2 and got[3].chosen_completion == got[3].rejected_completion == ""
    assert not got[None].paired and got[None].chosen_completion.startswith("<|im_start|>user\nno id")
    assert chat.preferences(df.limit(0)).collect() == []


def brute_preferences(rows):
    """(pair, paired, turns shared, prompt, completions with masks), by loops over sorted turns."""
    talks = {}
    for n, (conv, turn, role, text) in enumerate(rows):
        talks.setdefault(("row", n) if conv is None else conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    pairs = {}
    for conv, turns in talks.items():
        key, side = (conv, 0) if isinstance(conv, tuple) else divmod(conv, 2)
        pairs.setdefault(key, [None, None])[side] = [t[2:] for t in sorted(turns)]
    out = []
    for key, (c, r) in pairs.items():
        n = 0
        while c and r and n < min(len(c), len(r)) and c[n] == r[n]:
            n += 1
        row = [None if isinstance(key, tuple) else key, bool(c and r), n, "".join(f"<|im_start|>{x}\n{y}<|im_end|>\n" for x, y in (c or [])[:n])]
        for rest in ((c or [])[n:], (r or [])[n:]):
            text, spans = "", []
            for role, said in rest:
                begin = len(text) + 13 + len(role)
                text += f"<|im_start|>{role}\n{said}<|im_end|>\n"
                if role == "assistant":
                    spans.append(f"{begin}:{len(text) - 1}")
            row += [text, ",".join(spans)]
        out.append(tuple(row))
    return out


def test_preferences_against_loops(spark):
    """Ties in the number of a turn, repeated rows, nulls in every column, a conversation of 3000 turns and a text of 10**6 characters."""
    rng = random.Random(41)
    rows = [(rng.choice([None, *range(-6, 12)]), rng.choice([None, 0, 1, 1, 2, 3]), rng.choice(["user", "assistant", None, "é"]), rng.choice(["a", "b", None, "", "ü\n"])) for _ in range(250)]
    rows += [(100 + s, i, ("user", "assistant")[i % 2], f"turn {i}" if i < 1500 else f"{s} {i}") for s in (0, 1) for i in range(3000)]
    rows += [(200, 0, "assistant", "x" * 10**6)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)
    assert as_counts(map(tuple, chat.preferences(df).collect())) == as_counts(brute_preferences(rows))
