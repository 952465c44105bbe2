"""Steering actions of user turns, and how delegated work came back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import literals
from ..functions import text as T

# Actions in order, with their patterns, and the most that are listed.
ACTIONS = {
    "explore": r"(?iu)let's (try|explore|look at|investigate|check)|what if|how about|i wonder",
    "constrain": r"(?iudU)\b(must|should|always|never|require|constraint|rule)\b.*\b(use|follow|apply|enforce)\b",
    "delegate": r"(?iuU)\b(implement|build|create|write|add|fix|update|deploy|run|test|make)\b",
    "inspect": r"(?iuU)\b(show me|let me see|what does|how does|look at|check|verify|review)\b",
    "reject": r"(?iuU)\b(no|wrong|bad|don't|stop|that's not|revert|undo|scratch that|kill)\b",
    "redirect": r"(?iuU)\b(actually|instead|wait|change|switch|pivot|different approach|on second thought)\b",
    "verify": r"(?iuU)\b(test|verify|check|confirm|make sure|does it|is it|run the)\b",
    "ship": r"(?iuU)\b(ship|deploy|push|release|merge|commit|done|good to go|looks good)\b",
    "debug": r"(?iuU)\b(why|error|fail|bug|broken|wrong|issue|crash|exception|trace)\b",
    "recover": r"(?iuU)\b(fix|resolve|recover|restore|rollback|patch|workaround|fallback)\b",
}
LISTED = 100


def actions(turns: DataFrame, keys: list[str], order: str, text: str = "text", patterns: dict[str, str] | None = None) -> DataFrame:
    """(keys, line, action, text): one row for each pattern that a turn matches; a turn may match several.

    Turns are numbered from 0 in each stream, stripped and cut to 500 characters before matching.
    """
    from .sequence import index_events

    t = index_events(turns, keys, [order], "line").withColumn("__text", T.truncate(T.strip(F.coalesce(F.col(text), F.lit(""))), 500)).where("__text != ''")
    named = F.array(*[F.when(literals.matches(F.col("__text"), p), F.struct(F.lit(i).alias("rank"), F.lit(n).alias("action"))) for i, (n, p) in enumerate((patterns or ACTIONS).items())])
    return t.select(*keys, "line", F.explode(F.filter(named, lambda a: a.isNotNull())).alias("a"), T.truncate(F.col("__text"), 200).alias("text")).select(*keys, "line", "a.rank", "a.action", "text")


def totals(found: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, action, n) of all actions; nothing is capped here."""
    return found.groupBy(*keys, "action").agg(F.count("*").alias("n"))


def listed(found: DataFrame, keys: list[str], most: int = LISTED) -> DataFrame:
    """The first ``most`` actions of each stream."""
    from .sequence import top_by

    return top_by(found, keys, ["line", "rank"], most, "place")


def closed_loops(events: DataFrame, key: str = "session_id") -> DataFrame:
    """(session, dispatches, returns, matched, committed): whether a dispatched id came back, and whether a commit follows the first return."""
    kind = F.col("type")
    e = events.groupBy(key).agg(
        F.count_if(kind == "subagent_dispatch").alias("dispatches"), F.count_if(kind == "subagent_return").alias("returns"),
        F.arrays_overlap(F.collect_set(F.when(kind == "subagent_dispatch", F.col("tool_use_id"))), F.collect_set(F.when(kind == "subagent_return", F.col("tool_use_id")))).alias("matched"),
        F.coalesce(F.min(F.when(kind == "subagent_return", F.col("index"))) < F.max(F.when(kind == "git_commit", F.col("index"))), F.lit(False)).alias("committed"),
    )
    return e.withColumn("matched", F.coalesce("matched", F.lit(False)))


def parallelism(sessions: DataFrame, events: DataFrame) -> DataFrame:
    """One row: dispatches and returns of main sessions, those that closed the loop, and subagents without a parent.

    Two metrics need child sessions that logs don't link; they are null.
    """
    main = ~F.col("is_subagent") & F.col("parent_session_id").isNull()
    s = sessions.withColumn("is_subagent", F.coalesce("is_subagent", F.lit(False))).join(closed_loops(events), "session_id", "left")
    return s.agg(
        F.coalesce(F.sum(F.when(main, F.col("dispatch_count"))), F.lit(0)).alias("dispatch_count"), F.coalesce(F.sum(F.when(main, F.col("return_count"))), F.lit(0)).alias("return_count"),
        F.count_if(main & (F.col("dispatches") > 0) & F.col("matched") & F.col("committed")).alias("dispatch_with_committed_return_count"),
        F.count_if("is_subagent").alias("subagent_count"), F.count_if(F.col("is_subagent") & F.col("parent_session_id").isNull()).alias("orphan_subagent_count"),
        F.lit(None).cast("long").alias("concurrent_pairs_with_ships_count"), F.lit(None).cast("long").alias("review_separation_count"),
    )


def dispatch_stats(loops: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, dispatch_count, committed_return_ratio): over sessions that dispatched at all."""
    d = loops.where("dispatches > 0")
    return d.groupBy(*keys).agg(F.sum("dispatches").alias("dispatch_count"), F.avg(F.col("committed").cast("int")).alias("committed_return_ratio"))


def since(sessions: DataFrame, last_event: Column, cutoff: Column) -> DataFrame:
    """Sessions without any time, or with an event at or after ``cutoff``."""
    return sessions.where(last_event.isNull() | (last_event >= cutoff))
