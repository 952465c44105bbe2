"""Signals of a session's user messages and events.

``messages``: session_id, seq, text, word_count. ``events``: session_id, index, type, path, command, passed, failed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import literals
from ..functions import numeric as N
from ..functions import patterns as P
from ..functions import text as T
from . import sequence as S
from .decisions import first_of

KEYS = ["session_id"]
TYPES = ("directive", "question", "correction", "debugging", "review", "other")


def first_word(text: Column) -> Column:
    return F.lower(F.try_element_at(T.words(text), F.lit(1)))


def flags(text: Column, patterns: dict[str, str] | None = None, imperatives: tuple[str, ...] = P.IMPERATIVES) -> dict[str, Column]:
    """Which signals a message carries; signals count messages, not occurrences."""
    out = {name: literals.matches(text, p) for name, p in (patterns or P.FLAGS).items()}
    return out | {"imperative_prompts": F.coalesce(first_word(text).isin(*imperatives), F.lit(False))}


def flag_counts(messages: DataFrame, keys: list[str], text: Column, patterns: dict[str, str] | None = None, imperatives: tuple[str, ...] = P.IMPERATIVES) -> DataFrame:
    return messages.groupBy(*keys).agg(*[F.count_if(c).alias(n) for n, c in flags(text, patterns, imperatives).items()])


def prompt_type(text: Column, imperatives: tuple[str, ...] = P.IMPERATIVES, openings: tuple[str, ...] = P.QUESTION_OPENINGS, patterns: dict[str, str] | None = None) -> Column:
    """directive, question, correction, debugging, review or other; the first that fits."""
    p = patterns or P.FLAGS
    s = F.lower(T.strip(F.coalesce(text, F.lit(""))))
    asks = s.endswith("?")
    for o in openings:
        asks = asks | s.startswith(o)
    corrects = literals.matches(s, p["self_corrections"]) | literals.matches(s, p["domain_corrections"])
    return first_of(
        [(F.coalesce(first_word(s).isin(*imperatives), F.lit(False)), "directive"), (asks, "question"), (corrects, "correction"), (literals.matches(s, p["debugging_messages"]), "debugging"), (literals.matches(s, p["review_checks"]), "review")],
        "other",
    )


def prompt_type_counts(messages: DataFrame, keys: list[str], kind: Column) -> DataFrame:
    counts = messages.groupBy(*keys, kind.alias("prompt_type")).agg(F.count("*").alias("n"))
    return counts.groupBy(*keys).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("prompt_type", "n")))).alias("prompt_types"))


def repeated(messages: DataFrame, keys: list[str], order: str, norm: Column | None = None, most: int = P.MAX_REPEATED_PROMPTS, longest: int = P.SHORT_PROMPT_WORDS) -> DataFrame:
    """(keys, norm, count, example, rank): short prompts by how often they come; ties by text, example from the first."""
    m = messages.where((F.col("word_count") > 0) & (F.col("word_count") <= longest)).withColumn("norm", T.normalise_prompt(F.col("text")) if norm is None else norm)
    m = m.where(F.length("norm") >= 2)
    example = T.truncate(T.strip(T.scrub(F.col("text"))), 80)
    c = m.groupBy(*keys, "norm").agg(F.count("*").alias("count"), F.min_by(example, F.col(order)).alias("example"))
    return S.top_by(c, keys, [F.desc("count"), "norm"], most)


def charged(messages: DataFrame, keys: list[str], order: str, most: int = P.MAX_CHARGED) -> DataFrame:
    """(keys, charged_messages): the first ``most`` charged messages of at most 280 characters, then without repeats."""
    m = messages.withColumn("__s", T.strip(F.coalesce("text", F.lit("")))).where((F.col("__s") != "") & (F.length("__s") <= 280) & T.charged(F.col("__s")))
    m = S.top_by(m, keys, [order], most, "__rank")
    shown = F.struct("__rank", T.truncate(T.strip(T.scrub(F.col("__s"))), 200).alias("t"))
    return m.groupBy(*keys).agg(F.array_distinct(F.transform(F.sort_array(F.collect_list(shown)), lambda x: x.t)).alias("charged_messages"))


def word_stats(messages: DataFrame, keys: list[str], words: str = "word_count") -> DataFrame:
    """Counts of messages by length, and the median number of words."""
    w = F.col(words)
    s = messages.groupBy(*keys).agg(
        F.count("*").alias("user_message_count"), F.sum(w).alias("total_user_words"), F.count_if(w > 15).alias("substantive_messages"), F.count_if(w <= 5).alias("terse_messages"),
        F.count_if((w > 0) & (w <= P.SHORT_PROMPT_WORDS)).alias("short_prompt_count"), F.median(w).alias("median_words"),
    )
    n = F.col("user_message_count")
    return s.withColumn("avg_prompt_length_words", N.round_repr(F.col("total_user_words") / n, 1)).withColumn("substantive_ratio", N.round_repr(F.col("substantive_messages") / n, 2))


def caps_quotes(messages: DataFrame, keys: list[str], k: int = 3, least: float = 0.6, min_words: int = 3) -> DataFrame:
    """(keys, text, caps_ratio, rank): the loudest messages."""
    m = messages.withColumn("__s", T.strip(F.coalesce("text", F.lit("")))).withColumn("__r", T.caps_ratio(F.col("__s"))).where((F.col("word_count") >= min_words) & (F.col("__r") >= least))
    m = m.select(*keys, T.truncate(F.col("__s"), 200).alias("text"), N.round_repr(F.col("__r"), 2).alias("caps_ratio"))
    return S.top_by(m, keys, [F.desc("caps_ratio"), "text"], k)


def highlights(messages: DataFrame, keys: list[str], order: str, most: int = 50) -> DataFrame:
    """(keys, user_highlights): the first ``most`` messages of more than 15 words, cut to 2000 characters."""
    m = S.top_by(messages.where("word_count > 15"), keys, [order], most, "__rank")
    g = m.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("__rank", T.truncate(F.col("text"), 2000).alias("t")))).alias("l"))
    return g.select(*keys, T.or_null(F.array_join(F.transform("l", lambda x: x.t), "\n---\n")).alias("user_highlights"))


def first_prompt(messages: DataFrame, keys: list[str], order: str, length: int = P.FIRST_PROMPT) -> DataFrame:
    return messages.groupBy(*keys).agg(F.min_by(T.truncate(F.col("text"), length), F.col(order)).alias("first_prompt"))


def event_signals(events: DataFrame) -> DataFrame:
    """Counts, pass rate, test-first, recovery and retry of each session's events; null where a session has nothing to measure."""
    kind, order = F.col("type"), ["index"]
    plan = F.coalesce("path", F.lit("")).rlike(P.PLAN_PATH)
    edit = kind.isin("file_edit", "file_create")
    fixed = ((kind == "test_run") & (F.col("passed") > 0)) | (kind == "git_commit")
    bash, error = kind == "bash_command", kind == "error_encountered"
    w = S.window(KEYS, order)
    e = events.withColumns({
        "__next": S.next_index(KEYS, order, fixed), "__cmd": S.previous_value(KEYS, order, bash, F.col("command")),
        "__soon": F.collect_list(F.when(bash, F.col("command"))).over(w.rowsBetween(1, 5)),
    })
    first_test, first_edit = F.min(F.when(kind == "test_run", F.col("index"))), F.min(F.when(edit & ~plan, F.col("index")))
    s = e.groupBy("session_id").agg(
        F.count_if(edit).alias("files_modified_count"), F.count_if(kind == "test_run").alias("test_run_count"), F.count_if(error).alias("error_count"),
        F.count_if((kind == "file_create") & plan).alias("__plans"), F.sum(F.when(kind == "test_run", F.col("passed"))).alias("__passed"), F.sum(F.when(kind == "test_run", F.col("failed"))).alias("__failed"),
        first_test.alias("__test"), first_edit.alias("__edit"), F.median(F.when(error, F.col("__next") - F.col("index"))).alias("__recovery"),
        F.count_if(error & F.coalesce(F.array_contains("__soon", F.col("__cmd")), F.lit(False))).alias("__retried"), F.count_if(kind == "git_commit").alias("git_commit_count"),
    )
    total = F.col("__passed") + F.col("__failed")
    ahead = F.col("__test").isNotNull() & (F.col("__edit").isNull() | (F.col("__test") < F.col("__edit")))
    return s.select(
        "session_id", "files_modified_count", "test_run_count", "error_count", F.when(F.col("__plans") > 0, F.col("__plans")).alias("plan_file_count"),
        F.when(total > 0, N.round_repr(F.col("__passed") / total, 3)).alias("test_pass_rate"),
        F.when(F.col("__test").isNotNull() | F.col("__edit").isNotNull(), ahead.cast("double")).alias("tdd_discipline_ratio"), N.round_repr(F.col("__recovery"), 1).alias("recovery_speed"),
        F.when(F.col("error_count") > 0, N.round_repr(F.col("__retried") / F.col("error_count"), 3)).alias("error_retry_ratio"), "git_commit_count",
    )


def session_signals(messages: DataFrame, events: DataFrame, tools: DataFrame, turns: DataFrame, times: DataFrame) -> DataFrame:
    """The whole signals row of every session with user messages.

    ``tools``: session_id, name. ``turns``: session_id, assistant_count. ``times``: session_id, seq, ts.
    """
    text = T.truncate(F.coalesce("text", F.lit("")), P.MAX_USER_TEXT)
    m = messages.withColumn("__t", text)
    used = tools.groupBy("session_id").agg(
        F.count("*").alias("tool_count"), F.count_distinct("name").alias("unique_tools"), *[F.bool_or(F.col("name") == n).alias(c) for c, n in (("plan_mode_used", "EnterPlanMode"), ("task_tool_used", "Task"), ("worktree_used", "EnterWorktree"))]
    )
    known = times.where("ts is not null")
    span = known.groupBy("session_id").agg(F.count("*").alias("__n"))
    active = S.active_seconds(known, KEYS, "ts", P.ACTIVE_GAP_MINUTES * 60).join(span, "session_id")
    minutes = active.select("session_id", N.round_repr(F.col("seconds") / 60, 1).alias("duration_minutes"))
    types = prompt_type_counts(m, KEYS, prompt_type(F.col("__t")))
    again = repeated(m, KEYS, "seq").groupBy("session_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "norm", "count", "example"))), lambda x: F.struct(x.norm.alias("norm"), x["count"].alias("count"), x.example.alias("example"))).alias("repeated_prompts"))
    s = word_stats(m, KEYS).drop("median_words", "short_prompt_count").join(flag_counts(m, KEYS, F.col("__t")), "session_id")
    for other in (used, turns, minutes, event_signals(events), types, again, charged(m, KEYS, "seq")):
        s = s.join(other, "session_id", "left")
    s = s.na.fill(0, ["tool_count", "unique_tools", "assistant_count", "duration_minutes", "git_commit_count"]).na.fill(False, ["plan_mode_used", "task_tool_used", "worktree_used"])
    n = F.col("user_message_count")
    return s.withColumn("messages_per_minute", F.when(F.col("duration_minutes") > 0, N.round_repr(n / F.col("duration_minutes"), 2)).otherwise(0.0)).withColumn("tools_per_message", N.round_repr(F.col("tool_count") / n, 2))


def prompt_stats(messages: DataFrame) -> DataFrame:
    """(session_id, median_words, short_prompt_count, caps_quotes)."""
    w = word_stats(messages, KEYS).select("session_id", N.round_repr(F.col("median_words"), 1).alias("median_words"), "short_prompt_count")
    q = caps_quotes(messages, KEYS).groupBy("session_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "text", "caps_ratio"))), lambda x: F.struct(x.text.alias("text"), x.caps_ratio.alias("caps_ratio"))).alias("caps_quotes"))
    return w.join(q, "session_id", "left")


def plan_files(writes: DataFrame) -> DataFrame:
    """Versions of plan files: ``writes`` (session_id, seq, path, content, is_edit); edits get no number."""
    name = T.basename(F.col("path"))
    p = writes.where(F.col("path").rlike(P.PLAN_PATH) & ~F.col("is_edit") & ~T.blank(F.col("content"))).withColumn("filename", name)
    p = p.withColumn("version", F.row_number().over(Window.partitionBy("session_id", "filename").orderBy("seq")).cast("long"))
    c = T.scrub(F.col("content"))
    return p.select("session_id", "filename", F.col("path").alias("full_path"), "version", c.alias("content"), c.rlike(P.PLAN_VERIFIES).alias("has_verification"), c.rlike(P.PLAN_ALTERNATIVES).alias("has_alternatives"), c.rlike(P.PLAN_EDGE_CASES).alias("has_edge_cases"))


def latest_plans(plans: DataFrame, limit: int = 5000) -> DataFrame:
    """(session_id, filename, version_count, content): the newest version of each file."""
    return plans.groupBy("session_id", "filename").agg(F.count("*").alias("version_count"), F.max_by(T.truncate(F.col("content"), limit), F.col("version")).alias("content"))
