"""Candidates, batches, decisions, outcomes, documents and the report."""

import pytest
from pyspark.sql import functions as F

from tracework.operators import decisions as D
from tracework.operators import rollup as R
from tracework.plans import documents, report

LONG = "instead of patching we should really rethink the cache layer because every request goes through it twice and nobody noticed until now"
EVENTS = [
    ("agent_proposal", "Option A or option B?", "options", 2), ("agent_thinking", "key insight here", None, None), ("user_directive", "No, revert that and build something entirely novel please", None, None),
    ("test_run", None, None, None), ("git_commit", None, None, None), ("agent_proposal", "Shall we?", "question", None), ("agent_proposal", "Or this?", "question", None), ("error_encountered", None, None, None),
    ("user_directive", "yes", None, None), ("agent_thinking", "this changes a lot", None, None), ("user_directive", LONG, None, None), ("user_directive", f"Implement the following plan {LONG}", None, None),
]


@pytest.fixture(scope="module")
def events(spark):
    rows = [("s", i, t, x, p, n, 3 if t == "test_run" else None, 0 if t == "test_run" else None) for i, (t, x, p, n) in enumerate(EVENTS)]
    return spark.createDataFrame(rows, "session_id string, index long, type string, text string, proposal_type string, option_count long, passed long, failed long").repartition(3).cache()


def test_candidates(events):
    got = [(r.position, r.source, r.event_index, r.response_index) for r in D.candidates(events).orderBy("position").collect()]
    assert got == [(0, "paired", 0, 2), (1, "paired", 6, 8), (2, "unpaired", 10, 10)]


def test_batches(events):
    b = D.batches(D.candidates(events), 2).orderBy("batch").collect()
    assert [r.candidates for r in b] == [[0, 1], [2]]
    assert b[0].input_text.startswith("Classify these 2 exchanges:\n\nExchange 0:\nAgent: Option A or option B?\nDeveloper: No, revert")


def test_fallback_and_outcomes(spark, events):
    none = spark.createDataFrame([], "session_id string, batch_id long, pos long, index long, is_decision boolean, decision_type string, confidence string, narrative string, law_key string")
    catalog = spark.createDataFrame([("k1",)], "key string")
    got = {r.event_index: r for r in D.finalise(events, none, catalog).collect()}
    assert (got[0].proposal_type, got[0].significance, got[0].agent_recognized) == ("counter_proposal", "strategic", True)
    assert (got[0].outcome.signal, got[0].outcome.confidence, got[0].outcome.evidence) == ("negative", 0.9, "1 test run(s): 3 passed, 0 failed. 1 commit(s) made. User reversed direction")
    assert got[6].outcome.signal == "negative" and got[10].proposal_type == "proactive_insight"
    assert set(got) == {0, 6, 10}


def test_classified_last_batch_wins(spark, events):
    rows = [("s", 0, 0, 0, True, "option_selection", "high", "n", "k1"), ("s", 1, 0, 0, True, "product_insight", "low", "m", "zz"), ("s", 0, 1, 1, False, None, None, None, None)]
    answers = spark.createDataFrame(rows, "session_id string, batch_id long, pos long, index long, is_decision boolean, decision_type string, confidence string, narrative string, law_key string")
    got = D.finalise(events, answers, spark.createDataFrame([("k1",)], "key string")).collect()
    assert [(r.event_index, r.decision_type, r.significance, r.law_key) for r in got] == [(0, "product_insight", "strategic", None)]


def test_rollup(spark):
    cells = spark.createDataFrame([("e1", "steering", 8.0, 0.5), ("e2", "steering", 4.0, None), ("e3", "steering", 0.0, 0.0), ("e1", "planning", 9.0, 1.0), ("e2", "x", 1.0, 0.0)], "episode_id string, axis string, score double, confidence double").withColumn("all", F.lit(1))
    r = R.rollup(cells, ["all"]).first()
    assert r.axes == {"planning": 9.0, "steering": round((8 * 0.5 + 4 * 0.8) / 1.3, 2)} and r.band == "STRONG"
    assert [x.b for x in spark.createDataFrame([(3.99,), (4.0,), (8.0,), (9.5,), (None,)], "s double").select(R.band(F.col("s")).alias("b")).collect()] == ["WEAK", "LIMITED", "ELITE", "EXEMPLAR", None]


@pytest.fixture(scope="module")
def world(spark):
    sig = "struct<user_message_count:bigint,courtesy_messages:bigint,test_run_count:bigint,prompt_types:map<string,bigint>,repeated_prompts:array<struct<norm:string,count:bigint,example:string>>," + ",".join(f"{k}:bigint" for k in documents.SIGNALS) + ">"
    schema = f"session_id string, first_prompt string, user_highlights string, session_modified_at string, plan_files array<struct<filename:string,version:bigint,content:string>>, session_signals {sig}, prompt_stats struct<median_words:double,short_prompt_count:bigint,caps_quotes:array<struct<text:string,caps_ratio:double>>>, model_usage map<string,bigint>, token_usage map<string,struct<input_tokens:bigint,output_tokens:bigint,cache_read_tokens:bigint,cache_write_tokens:bigint,assistant_turns:bigint>>"
    signals = lambda n: (12, 3, 1, {"correction": 5}, [("go on", 4, "Go on!")], *[n] * len(documents.SIGNALS))
    rows = [
        ("a", "first", "high", "2026-01-01T10:00:00Z", [("PLAN.md", 1, "old"), ("PLAN.md", 2, "new")], signals(1), (4.0, 6, [("DO IT NOW", 1.0)]), {"claude-opus-1": 5}, {"claude-opus-1": (1_000_000, 0, 0, 0, 5)}),
        ("b", "first", None, "2026-01-02T10:00:00Z", [], signals(0), (9.0, 1, []), {"claude-opus-1": 1, "z": 1}, {}),
    ]
    sessions = spark.createDataFrame(rows, schema)
    e = spark.createDataFrame([("a", 0, "subagent_dispatch", "t", "2026-01-01 10:00:00"), ("a", 1, "subagent_return", "t", "2026-01-01 10:05:00"), ("a", 2, "git_commit", None, None)], "session_id string, index long, type string, tool_use_id string, x string").withColumn("ts", F.col("x").cast("timestamp"))
    episodes = spark.createDataFrame([(1, "feature", ["a", "b", "gone"], [7], 10, 2, [("pr_match",), ("pr_match",)]), (2, "session_only", ["b"], [], 0, 0, [])], "episode_id long, episode_type string, session_ids array<string>, commit_group_ids array<long>, added_lines long, deleted_lines long, links array<struct<link_type:string>>")
    groups = spark.createDataFrame([(7, 10, 2, "2026-01-01 11:00:00")], "id long, insertions long, deletions long, t string").withColumn("latest_commit_at", F.col("t").cast("timestamp"))
    decisions = spark.createDataFrame([("a", 3, "strategic", "scope", "why", "text", True, "product_insight", "high", "k", ("positive",))], "session_id string, event_index long, significance string, domain string, decision_narrative string, redacted_response_text string, agent_recognized boolean, decision_type string, classification_confidence string, law_key string, outcome struct<signal:string>")
    notes = spark.createDataFrame([("a", "note a", "shipping"), ("b", None, "exploration")], "session_id string, narrative string, intent string")
    commits = spark.createDataFrame([(str(i), f"2026-01-0{1 + i % 2}T22:00:00+02:00") for i in range(6)], "sha string, date string")
    scores = spark.createDataFrame([(1, 0, "t1", 0.5, {"steering": 8.0, "planning": 6.0}), (1, 1, "late", 0.5, {"steering": 0.0}), (99, 2, "lost", 0.5, {})], "episode_id long, pos long, title string, confidence double, scores map<string,double>")
    return sessions, e, episodes, groups, decisions, notes, commits, scores


def test_documents(world):
    sessions, events, episodes, groups, decisions, notes, _, _ = world
    d = {r.episode_id: r for r in documents.documents(episodes, sessions, groups, notes, decisions, events).collect()}
    text = d[1].text
    assert text.startswith("Episode type: feature\n\nSessions: 2, Commit groups: 1\n\nCode volume: +10/-2 lines (from this episode's commits)\n\nFirst prompts: first\n\n## Session Narratives\nnote a\n\n## User Highlights\nhigh\n\n## Decision Exchanges\n")
    assert "### PLAN.md (2 version(s))\nnew" in text and "kill_decisions: 1, self_corrections: 1" in text and "Dispatches: 1 | Committed-return ratio: 1.00" in text
    assert "Session intent: exploration" in d[2].text and "Code volume" not in d[2].text


def test_report(world):
    sessions, events, episodes, groups, decisions, _, commits, scores = world
    make = lambda: report.render(sessions, events, commits, episodes, scores, decisions)
    text = make()
    assert text == make()
    assert "Overall 7.00 (STRONG)." in text and "| total | 1,000,000 |" in text and "$5.00" in text and "1 scores without an episode" in text
    st = report.stats(sessions, events, commits, episodes).first()
    assert (st.max_parallel, st.start, st.peak_hour, st.day, st.longest.s, st.archetype) == (1, 19, 22, "Friday", 300, "The Architect")
    keys = [c["key"] for c in report.cards(st)]
    assert keys == ["archetype", "model", "peak_hours", "goto_prompt", "brevity", "politeness", "steering", "longest_run", "crash_out", "lines", "ship_day"]
    assert {r.episode_id: r.label for r in report.link_labels(episodes).collect()} == {1: "PR", 2: "session only, no commits"}
    assert [r.episode_id for r in report.episode_order(episodes, groups, sessions).collect()] == [2, 1]
