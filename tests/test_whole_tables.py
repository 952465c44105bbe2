"""Registered queries take whole tables: against their SQL without its cut, and on small tables."""

import hashlib
import os

import duckdb
import pytest
from test_queries import SF, TABLES, shown

from tracework.queries import ORACLE_SQL, QUERIES

#: What the SQL of a query cuts off, and what stands there without the cut.
CUTS = {
    "display_formats": (" WHERE o_orderkey % 10 = 0", ""),
    "substring_group_match": ("a.p_partkey <= 60 AND ", ""),
    "secret_scrub": (" WHERE n_chars < 3000", ""),
}


@pytest.mark.skipif(not os.path.isdir(SF), reason="no driver tables")
@pytest.mark.parametrize("name", sorted(CUTS))
def test_whole_table(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    cur = con.execute(ORACLE_SQL[name].replace(*CUTS[name]))
    names = [c[0] for c in cur.description]
    want = sorted(tuple(map(shown, r)) for r in cur.fetchall())
    got = sorted(tuple(map(shown, r)) for r in QUERIES[name](spark, SF).select(*names).collect())
    assert got == want


def same_as_sql(spark, name, folder, *tables):
    """The query's rows over ``tables`` in ``folder`` are those of its SQL, which may cut nothing there."""
    con = duckdb.connect()
    for t in tables:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet/*.parquet'")
    cur = con.execute(ORACLE_SQL[name])
    names = [c[0] for c in cur.description]
    want = sorted(tuple(map(shown, r)) for r in cur.fetchall())
    got = sorted(tuple(map(shown, r)) for r in QUERIES[name](spark, str(folder)).select(*names).collect())
    assert got == want and want


#: Queries over files of repositories that take every source, also beyond the operators' first 10 000 of a repository.
@pytest.mark.parametrize("name", ["agent_files", "repo_contents", "repo_analysis"])
def test_more_sources_than_are_read_by_default(spark, tmp_path, name):
    d = spark.range(30_000).selectExpr("id AS doc_id", "'some text' AS text", "'en' AS lang", "'one' AS source", "id % 40 AS n_chars")
    d.write.parquet(f"{tmp_path}/documents.parquet")
    same_as_sql(spark, name, tmp_path, "documents")


@pytest.mark.parametrize("name", ["steering_listed", "steering_multilabel"])
def test_words_beside_letters_beyond_ascii(spark, tmp_path, name):
    said = ["zu testö und", "ätest", "enüadd", "TESTß", "no_é wrongé", "must é\nuse", "mustä.. ßfollow", "ſhip K shiṕ", "test it", "plain"]
    rows = [(i, t, "user", f"{x} {'x' * (i * 45)} {x}") for i in range(12) for t, x in enumerate(said)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    same_as_sql(spark, name, tmp_path, "conversations")


def test_numbers_of_events_beyond_a_billion_tokens(spark, tmp_path):
    # times 997 these lie around a thousand, a million and a billion, and on both sides of halves
    e = spark.range(4_000).selectExpr("explode(array(id, id + 1001000, id + 1000000000)) AS event_id").selectExpr("event_id", "timestamp'2024-01-01' AS ts", "event_id % 7 AS user_id", "'view' AS event_type", "1.0D AS value", "'{}' AS props")
    e.write.parquet(f"{tmp_path}/events.parquet")
    same_as_sql(spark, "text_rules", tmp_path, "events")


def test_secrets_in_long_documents(spark, tmp_path):
    long = "word " * 2000
    rows = [(7, f"{long}hf_{'b' * 24} {long}", 20028), (15, "hf_" + "c" * 24, None), (23, None, None)]
    spark.createDataFrame(rows, "doc_id long, text string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.scrubbed_md5, r.n_redacted) for r in QUERIES["secret_scrub"](spark, str(tmp_path)).collect()}
    want = {7: f"{long}[REDACTED_HF_TOKEN] {long} none", 15: "[REDACTED_HF_TOKEN] none", 23: "none"}
    assert got == {k: (hashlib.md5(t.encode()).hexdigest(), t.count("REDACTED")) for k, t in want.items()}
