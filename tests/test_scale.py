"""Queries over whole episodes at the scale of the correctness run: equal to their SQL, and within a time."""

import os
import time

import duckdb
import pytest
from test_queries import TABLES, shown

from tracework.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.01"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no driver tables")
@pytest.mark.parametrize("name", ["link_labels", "session_episode", "matched_scores", "episode_order", "secret_scrub", "typed_events"])
def test_in_time(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    began = time.perf_counter()
    cur = con.execute(ORACLE_SQL[name])
    names = [c[0] for c in cur.description]
    want = sorted(tuple(map(shown, r)) for r in cur.fetchall())
    mid = time.perf_counter()
    got = sorted(tuple(map(shown, r)) for r in QUERIES[name](spark, SF).select(*names).collect())
    assert got == want
    # generous: other work may share the machine
    assert mid - began < 60 and time.perf_counter() - mid < 60
