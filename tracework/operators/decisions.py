"""Decision exchanges: candidates, batches, classified and pattern-based decisions, outcomes, redaction.

``events``: session_id, index, type, text, proposal_type, option_count, passed, failed.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import decision_patterns as P
from ..functions import literals
from ..functions import text as T
from . import sequence as S

KEYS, ORDER = ["session_id"], ["index"]


def any_match(s: Column, patterns: tuple[str, ...]) -> Column:
    return F.coalesce(reduce(lambda a, b: a | b, (literals.matches(s, p) for p in patterns)), F.lit(False))


def first_of(cases: list[tuple[Column, Column | str]], otherwise: Column | str | None = None) -> Column:
    """The value of the first true case."""
    out = None
    for when, value in cases:
        v = value if isinstance(value, Column) else F.lit(value)
        out = F.when(when, v) if out is None else out.when(when, v)
    return out.otherwise(otherwise if isinstance(otherwise, Column) else F.lit(otherwise))


def domain(s: Column) -> Column:
    return first_of([(literals.matches(s, p), name) for name, p in P.DOMAINS.items()], "general")


def reversibility(s: Column) -> Column:
    return first_of([(s.rlike(P.ONE_WAY), "one_way"), (s.rlike(P.REVERSIBLE), "reversible")], "unknown")


def significance(response: Column, combined: Column) -> Column:
    n, d = F.size(T.words_leading(response)), domain(combined)
    deep = (n > 30) & ((d == "architecture") | combined.rlike(P.ONE_WAY) | response.rlike(P.RATIONALE))
    return first_of([(deep, "strategic"), ((n > 15) | ~d.isin("debugging", "tooling"), "moderate")], "tactical")


def escalated(level: Column) -> Column:
    return first_of([(level == "tactical", "moderate"), (level == "moderate", "strategic")], level)


def inferred_significance(decision_type: Column) -> Column:
    return first_of([(decision_type == k, v) for k, v in P.SIGNIFICANCE.items()], "tactical")


def counter_proposal(proposal_type: Column, agent: Column, user: Column) -> Column:
    """An answer to options that takes none of them and brings new words or a reversal; repeated new words count each."""
    old = F.regexp_extract_all(F.lower(agent), F.lit(P.LONG_WORD), F.lit(0))
    new = F.filter(F.regexp_extract_all(F.lower(user), F.lit(P.LONG_WORD), F.lit(0)), lambda w: ~F.array_contains(old, w))
    own = (F.size(new) >= P.NOVEL_WORDS) | user.rlike(P.REVERSAL)
    return F.coalesce((proposal_type == "options") & ~any_match(user, P.OPTION_REFERENCES) & own, F.lit(False))


def redact(s: Column) -> Column:
    """Code, identifiers and paths replaced by markers, in six passes; at most 2000 characters.

    Text is cut at code fences; each fence says its language and about how many lines it had.
    """
    fences = F.regexp_extract_all(s, F.lit(f"({P.FENCE})"), F.lit(1))
    language = lambda f: F.regexp_extract(f, r"```([A-Za-z0-9_]+)", 1)
    lines = lambda f: (F.length(f) - F.length(F.replace(f, F.lit("\n"), F.lit(""))) - 1).cast("string")
    marks = F.transform(
        fences,
        lambda f: F.when(language(f) != "", F.concat(F.lit("["), language(f), F.lit(" code, ~"), lines(f), F.lit(" lines]"))).otherwise(F.concat(F.lit("[code block, ~"), lines(f), F.lit(" lines]"))),
    )
    around = F.split(s, P.FENCE)
    joined = F.array_join(F.transform(around, lambda part, i: F.concat(part, F.coalesce(F.get(marks, i), F.lit("")))), "")
    out = F.when(F.size(fences) > 0, joined).otherwise(s)
    for pattern, mark in ((P.INDENTED, "[code line]"), (P.SHORT_IDENTIFIER, "[identifier]"), (P.LONG_INLINE, "[identifier]"), (P.PATHS, " [path]"), (P.COLLAPSE, "[code] ")):
        out = F.regexp_replace(out, pattern, mark)
    return F.when(T.blank(s), F.lit("")).otherwise(T.truncate(T.strip(out), 2000))


def candidates(events: DataFrame) -> DataFrame:
    """Paired candidates (a proposal and the directive that answers it), then directives of at least 20 words that answer none, with the nearest thinking."""
    kind = F.col("type")
    text = F.coalesce("text", F.lit(""))
    e = S.follow_up(events, KEYS, ORDER, kind == "agent_proposal", kind == "user_directive", F.struct(F.col("index").alias("at"), text.alias("said")), P.RESPONSE_WINDOW)
    e = e.withColumn("thought", S.nearest(e, KEYS, ORDER, kind == "agent_thinking", text, P.THINKING_WINDOW))
    amplifies = (kind == "agent_thinking") & any_match(text, P.AMPLIFICATIONS)
    e = e.withColumn("amplified", S.near_any(KEYS, ORDER, amplifies, P.THINKING_WINDOW))
    paired = e.where(F.col("reply").isNotNull()).select(
        "session_id", F.lit("paired").alias("source"), text.alias("agent_text"), F.col("reply.said").alias("user_text"), "proposal_type", "option_count",
        F.col("index").alias("event_index"), F.col("reply.at").alias("response_index"),
    )
    near = e.select("session_id", F.col("index").alias("response_index"), F.col("amplified").alias("near_amplified"))
    paired = paired.join(near, ["session_id", "response_index"])
    answered = paired.select("session_id", F.col("response_index").alias("index")).distinct()
    long = (F.size(T.words_leading(text)) >= P.PROACTIVE_WORDS) & ~text.startswith(P.CONTINUATION) & ~text.startswith(P.PLAN_PASTE)
    alone = e.where((kind == "user_directive") & long).join(answered, ["session_id", "index"], "left_anti").select(
        "session_id", F.lit("unpaired").alias("source"), F.coalesce("thought", F.lit("")).alias("agent_text"), text.alias("user_text"),
        F.lit(None).cast("string").alias("proposal_type"), F.lit(None).cast("long").alias("option_count"),
        F.col("index").alias("event_index"), F.col("index").alias("response_index"), F.col("amplified").alias("near_amplified"),
    )
    both = paired.unionByName(alone)
    # numbered within the session, paired first
    return S.index_events(both, KEYS, [F.when(F.col("source") == "paired", 0).otherwise(1), "event_index"], "position")


def batches(found: DataFrame, size: int = P.BATCH_SIZE) -> DataFrame:
    """(session_id, batch, candidates, input_text): consecutive slices of each session's candidates as prompts for the external classifier."""
    cut = lambda c: T.truncate(F.col(c), P.MAX_PROMPT_SIDE)
    c = found.withColumn("batch", F.floor(F.col("position") / size)).withColumn("slot", F.col("position") % size)
    line = F.format_string("Exchange %d:\nAgent: %s\nDeveloper: %s\n", "slot", cut("agent_text"), cut("user_text"))
    g = c.groupBy("session_id", "batch").agg(F.sort_array(F.collect_list(F.struct("slot", line.alias("line"), "position"))).alias("items"))
    head = F.format_string("Classify these %d exchanges:\n\n", F.size("items"))
    return g.select("session_id", "batch", F.transform("items", lambda x: x.position).alias("candidates"), F.concat(head, F.array_join(F.transform("items", lambda x: x.line), "\n")).alias("input_text"))


def classified(found: DataFrame, answers: DataFrame, catalog: DataFrame) -> DataFrame:
    """Decisions that the external classifier found.

    ``answers``: session_id, batch_id, pos, index, is_decision, decision_type, confidence, narrative,
    law_key. Of answers to one index of a session the last batch's last wins; a law key that the
    catalog (``key``) lacks becomes null.
    """
    last = S.first_by(answers, ["session_id", "index"], [F.desc("batch_id"), F.desc("pos")])
    known = catalog.select(F.col("key").alias("law_key")).distinct()
    last = last.join(known.withColumn("__known", F.lit(True)), "law_key", "left").withColumn("law_key", F.when(F.col("__known"), F.col("law_key")))
    c = found.join(last.where("is_decision").withColumnRenamed("index", "position"), ["session_id", "position"])
    kind = F.coalesce("proposal_type", F.when(F.col("source") == "unpaired", "proactive_insight").otherwise("options"))
    return c.select(*_decision(F.col("agent_text"), F.col("user_text"), kind, inferred_significance(F.col("decision_type")), (F.col("source") != "paired") | F.col("near_amplified")),
                    "decision_type", "law_key", F.col("confidence").alias("classification_confidence"), F.col("narrative").alias("decision_narrative"), "option_count")


def by_patterns(found: DataFrame) -> DataFrame:
    """Decisions of sessions without any classification, from patterns alone."""
    paired, amplified = F.col("source") == "paired", F.col("near_amplified")
    proposal = F.when(paired | ~T.blank(F.col("agent_text")), F.col("agent_text")).otherwise(P.NO_CONTEXT)
    combined = F.concat_ws(" ", proposal, F.col("user_text"))
    counter = counter_proposal(F.col("proposal_type"), F.col("agent_text"), F.col("user_text"))
    level = F.when(counter, "strategic").otherwise(significance(F.col("user_text"), combined))
    level = F.when(~paired, "strategic").when(amplified, escalated(level)).otherwise(level)
    kind = F.when(~paired, "proactive_insight").when(counter, "counter_proposal").otherwise(F.coalesce("proposal_type", F.lit("question")))
    keep = paired | (any_match(F.col("user_text"), P.REFRAMES) & amplified)
    none = lambda name: F.lit(None).cast("string").alias(name)
    return found.where(keep).select(*_decision(proposal, F.col("user_text"), kind, level, ~paired | amplified),
                                    none("decision_type"), none("law_key"), none("classification_confidence"), none("decision_narrative"), "option_count")


def _decision(proposal: Column, response: Column, kind: Column, level: Column, recognised: Column) -> list[Column]:
    combined = F.concat_ws(" ", proposal, response)
    return [
        F.col("session_id"), F.col("event_index"), T.truncate(proposal, P.MAX_EXCHANGE).alias("proposal_text"), T.truncate(response, P.MAX_EXCHANGE).alias("response_text"),
        kind.alias("proposal_type"), F.size(T.words_leading(response)).cast("long").alias("response_word_count"), domain(combined).alias("domain"),
        level.alias("significance"), reversibility(combined).alias("reversibility"), recognised.alias("agent_recognized"),
    ]


def outcome_columns() -> list[Column]:
    """signal, confidence and evidence from test_runs, errors, commits, reversed, passed, failed, last_passed, last_failed."""
    c = F.col
    signal = first_of(
        [
            (c("reversed"), "negative"),
            (F.coalesce((c("last_failed") == 0) & (c("last_passed") > 0), F.lit(False)), "positive"),
            (F.coalesce(c("last_failed") > 0, F.lit(False)), "negative"),
            ((c("commits") > 0) & (c("failed") == 0), "positive"),
            (c("errors") > 0, "mixed"),
        ],
        "neutral",
    )
    n = c("test_runs") + (c("errors") > 0).cast("int") + (c("commits") > 0).cast("int") + c("reversed").cast("int")
    confidence = first_of([(n == 0, F.lit(0.3)), (n == 1, F.lit(0.5)), (n == 2, F.lit(0.7))], F.lit(0.9))
    parts = F.concat_ws(
        ". ",
        F.when(c("test_runs") > 0, F.format_string("%d test run(s): %d passed, %d failed", "test_runs", "passed", "failed")),
        F.when(c("errors") > 0, F.format_string("%d error(s) encountered", "errors")),
        F.when(c("commits") > 0, F.format_string("%d commit(s) made", "commits")),
        F.when(c("reversed"), F.lit("User reversed direction")),
    )
    return [signal.alias("signal"), confidence.alias("confidence"), F.when(parts == "", "No signal events after decision").otherwise(parts).alias("evidence")]


def segment_sums(events: DataFrame, keys: list[str], order: list[str], opens: Column, test: Column, error: Column, commit: Column, reverses: Column, passed: Column, failed: Column) -> DataFrame:
    """(keys, event_index, sums): what happens between each opening and the next one. Every event has one opening before it, so this is a forward fill and one aggregate."""
    e = events.withColumn("event_index", S.forward_fill(keys, order, F.when(opens, F.col("index"))))
    own = e.where("event_index is not null and index > event_index")
    zero = lambda x: F.coalesce(x, F.lit(0)).cast("long")
    return own.groupBy(*keys, "event_index").agg(
        F.count_if(test).alias("test_runs"), F.count_if(error).alias("errors"), F.count_if(commit).alias("commits"), F.coalesce(F.bool_or(reverses), F.lit(False)).alias("reversed"),
        zero(F.sum(F.when(test, passed))).alias("passed"), zero(F.sum(F.when(test, failed))).alias("failed"),
        F.max_by(F.when(test, passed), F.when(test, F.col("index"))).cast("long").alias("last_passed"), F.max_by(F.when(test, failed), F.when(test, F.col("index"))).cast("long").alias("last_failed"),
    )


def outcomes(decisions: DataFrame, events: DataFrame) -> DataFrame:
    """Adds ``outcome`` (signal, confidence, evidence) of the events after each decision up to the next proposal; null at the very end of a session.

    Decisions may start anywhere, so their index bounds an event range of their own session.
    """
    kind = F.col("type")
    bounds = events.withColumn("stop", S.next_index(KEYS, ORDER, kind == "agent_proposal")).select("session_id", F.col("index").alias("event_index"), "stop")
    last = events.groupBy("session_id").agg(F.max("index").alias("last"))
    d = decisions.select("session_id", "event_index").distinct().join(bounds, ["session_id", "event_index"]).join(last, "session_id").where("event_index < last")
    told = kind.isin("test_run", "error_encountered", "git_commit", "user_directive")
    e = d.join(events.where(told).select("session_id", "index", "type", "text", "passed", "failed"), "session_id", "left")
    inside = F.coalesce((F.col("index") > F.col("event_index")) & (F.col("stop").isNull() | (F.col("index") < F.col("stop"))), F.lit(False))
    test = inside & (kind == "test_run")
    number = lambda c: F.coalesce(F.col(c), F.lit(0))
    sums = e.groupBy("session_id", "event_index").agg(
        F.count_if(test).alias("test_runs"), F.count_if(inside & (kind == "error_encountered")).alias("errors"), F.count_if(inside & (kind == "git_commit")).alias("commits"),
        F.coalesce(F.bool_or(inside & (kind == "user_directive") & F.coalesce("text", F.lit("")).rlike(P.REVERSAL)), F.lit(False)).alias("reversed"),
        F.coalesce(F.sum(F.when(test, number("passed"))), F.lit(0)).alias("passed"), F.coalesce(F.sum(F.when(test, number("failed"))), F.lit(0)).alias("failed"),
        F.max_by(F.when(test, number("passed")), F.when(test, F.col("index"))).alias("last_passed"), F.max_by(F.when(test, number("failed")), F.when(test, F.col("index"))).alias("last_failed"),
    )
    sums = sums.select("session_id", "event_index", F.struct(*outcome_columns()).alias("outcome"))
    return decisions.join(sums, ["session_id", "event_index"], "left")


def finalise(events: DataFrame, answers: DataFrame, catalog: DataFrame) -> DataFrame:
    """All decisions with outcomes and redacted texts; sessions without any answer fall back to patterns."""
    found = candidates(events)
    silent = found.join(answers.select("session_id").distinct(), "session_id", "left_anti")
    d = classified(found, answers, catalog).unionByName(by_patterns(silent))
    return outcomes(d, events).withColumns({"redacted_proposal_text": redact(F.col("proposal_text")), "redacted_response_text": redact(F.col("response_text"))})


def summary(decisions: DataFrame, shown: int = 10) -> DataFrame:
    """(session_id, counts, lines): counts over all decisions, and the first ``shown`` that aren't tactical as lines in order."""
    serious = F.col("significance") != "tactical"
    d = decisions.withColumn("__rank", F.row_number().over(Window.partitionBy("session_id", serious).orderBy("event_index")))
    line = F.concat_ws(" ", F.concat(F.lit("- ["), "significance", F.lit("/"), "domain", F.lit("]")), F.coalesce("decision_narrative", "redacted_response_text"))
    line = F.when(serious & (F.col("__rank") <= shown), F.struct("event_index", line.alias("line")))
    return d.groupBy("session_id").agg(
        F.count("*").alias("total"), F.count_if(F.col("significance") == "strategic").alias("strategic"), F.count_if(F.col("significance") == "moderate").alias("moderate"),
        F.count_if(F.col("significance") == "tactical").alias("tactical"), F.count_if("agent_recognized").alias("recognized"),
        F.count_if(F.col("outcome.signal") == "positive").alias("positive"), F.count_if(F.col("outcome.signal") == "negative").alias("negative"),
        F.array_join(F.transform(F.sort_array(F.collect_list(line)), lambda x: x.line), "\n").alias("lines"),
    )
