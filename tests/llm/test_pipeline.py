"""The pipeline's stages, one by one and whole, on small tables."""

import random

import pytest

import corpus_pipeline
from tracework.llm.queries import ORACLE_SQL, QUERIES

_rng = random.Random(3)
WORDS = ["".join(_rng.choice("abcdefghijklmnop") for _ in range(_rng.randint(2, 7))) for _ in range(500)]


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n)).capitalize() + "."


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("sf"))
    rng = random.Random(21)
    item = prose(rng, 40)
    docs = [(i, prose(rng, 60), "en", f"s{i % 3}") for i in range(200)]
    docs += [(1000 + i, " ".join(w.upper() + "!!" for w in prose(rng, 40).split()), "en", "s0") for i in range(60)]
    docs += [(2000 + i, docs[7][1], "en", "s1") for i in range(5)]
    docs += [(3000, f"{prose(rng, 20)} {item} {prose(rng, 20)}", "en", "s2"), (3001, f"{prose(rng, 30)} mail bob@site.org {prose(rng, 30)}", "en", None), (7, docs[7][1], "en", "s1")]
    schema = "doc_id long, text string, lang string, source string"
    spark.createDataFrame(docs, schema).selectExpr("*", "cast(length(text) as bigint) as n_chars", "'x' as size").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, 0 if i >= 1000 else 1, 0) for i in [*range(150), *range(1000, 1050)]], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return d


def test_stages(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    columns = docs.columns
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, tables).cache()
        kept[name] = {r.doc_id: r for r in docs.collect()}
        if name != "mixing":
            assert docs.columns == columns, name
    good = kept["quality"]
    assert not any(1000 <= i < 1060 for i in good) and set(range(200)) <= set(good)
    near = kept["near_duplicates"]
    assert 7 in near and not any(2000 <= i < 2005 for i in near) and set(range(200)) <= set(near)
    assert 3000 not in kept["decontamination"] and set(range(200)) <= set(kept["decontamination"])
    private = kept["personal_data"][3001]
    assert "bob@site.org" not in private.text and "<email>" in private.text and private.n_chars == len(private.text)
    assert kept["personal_data"].keys() == kept["decontamination"].keys()
    assert all(r.copies in (1, 2, 3) and r.taken == r.copies * len(r.text.split()) for r in kept["mixing"].values())


def test_rows_that_share_an_id(spark, tables):
    """Different texts with one id or none are documents of their own; equal ones are not."""
    rng = random.Random(22)
    item = spark.read.parquet(f"{tables}/benchmark.parquet").first().text
    texts = [prose(rng, 60) for _ in range(12)]
    rows = [*((None, t) for t in texts[:6]), *((5, t) for t in texts[6:]), (9, texts[0]), (5, texts[7])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = corpus_pipeline.near_duplicate_stage(spark, docs, tables)
    assert sorted(r.text for r in kept.collect()) == sorted(texts)
    bad = [(None, f"{texts[0]} {item}"), (5, f"{texts[6]} {item}")]
    clean = corpus_pipeline.decontamination_stage(spark, spark.createDataFrame(rows + bad, docs.schema), tables)
    assert sorted(map(str, clean.collect())) == sorted(map(str, docs.collect()))


def test_odd_rows(spark, tables):
    """Nulls in any column, empty and very long texts, ties, repeated rows and columns with clashing names pass every stage."""
    rng = random.Random(27)
    item = spark.read.parquet(f"{tables}/benchmark.parquet").first().text
    long = prose(rng, 60_000)
    texts = [None, "", " \n", "one", long, f"{long} {item}", f"{long} mail ann@site.org", prose(rng, 50), prose(rng, 50)]
    rows = [(i if i % 3 else None, t, "en" if i % 2 else None, f"s{i % 2}" if i % 4 else None) for i, t in enumerate(texts)]
    rows += [rows[7], rows[7], (None, texts[8], None, None), (1, texts[8], "en", "s0")]
    extra = ["k", "t", "fp", "item", "score", "size", "terms", "component_id", "lot", "skey", "copies", "taken"]
    docs = spark.createDataFrame([(*r, *range(len(extra))) for r in rows], "doc_id long, text string, lang string, source string, " + ", ".join(f"{c} int" for c in extra)).repartition(3)
    near = corpus_pipeline.near_duplicate_stage(spark, docs, tables).collect()
    # blank texts are one group, as are the equal ones; the long texts with an end of their own may link
    shown = [r.text for r in near]
    assert len(set(shown)) == len(shown) and set(texts[7:9]) <= set(shown) and "one" in shown and sum(not (t or "").strip() for t in shown) == 1
    clean = corpus_pipeline.decontamination_stage(spark, docs, tables).collect()
    assert sorted(str(r.text) for r in clean) == sorted(str(t) for _, t, *_ in rows if t is None or item not in t)
    private = corpus_pipeline.personal_data_stage(spark, docs, tables).collect()
    assert sorted(str(r.text) for r in private) == sorted(str(t and t.replace("ann@site.org", "<email>")) for _, t, *_ in rows)
    good = corpus_pipeline.quality_stage(spark, docs, tables)
    assert good.columns == docs.columns and all(list(r)[4:] == list(range(len(extra))) for r in near + clean + private)
    kept = {r.text for r in good.collect()}
    assert long in kept and set(texts[7:9]) <= kept
    mixed = corpus_pipeline.mixing_stage(spark, docs, tables).collect()
    assert all(1 <= r.copies <= 3 and r.taken == r.copies * len((r.text or "").split()) for r in mixed)


def test_run_agrees_with_the_stages(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, tables)
    assert sorted(map(str, corpus_pipeline.run(spark, tables).collect())) == sorted(map(str, docs.collect()))


def test_empty_tables(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, tables)
        assert docs.collect() == []


def test_every_operator_is_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
    assert set(ORACLE_SQL) <= set(QUERIES)
