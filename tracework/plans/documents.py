"""Scorer input documents: everything known of an episode as one text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.numeric import round_binary
from ..operators import sequence as S
from ..operators import steering
from ..sources import linefiles

# Limits, and the signals that are summed, in order.
MAX_NARRATIVES, MAX_HIGHLIGHTS, MAX_PROMPTS = 50_000, 10_000, 5
SIGNALS = (
    "kill_decisions", "self_corrections", "hypothesis_driven", "domain_corrections", "debugging_messages", "architecture_discussions",
    "product_references", "imperative_prompts", "review_checks", "critiques",
)
SEPARATOR, RULE = "\n\n", "\n---\n"


def _in_order(value: Column, *by: str) -> Column:
    return F.transform(F.sort_array(F.collect_list(F.when(value.isNotNull(), F.struct(*by, value.alias("v"))))), lambda x: x.v)


def members(episodes: DataFrame, sessions: DataFrame) -> DataFrame:
    """(episode_id, place, session columns): sessions of an episode in its order; unknown ids drop out."""
    m = episodes.select("episode_id", F.posexplode("session_ids").alias("place", "session_id"))
    return m.join(sessions, "session_id")


def intent(tally: DataFrame) -> DataFrame:
    """(episode_id, intent): the most frequent intent of its sessions, ambiguous on a tie."""
    n = tally.where("intent is not null").groupBy("episode_id", "intent").agg(F.count("*").alias("n"))
    top = n.withColumn("r", F.rank().over(Window.partitionBy("episode_id").orderBy(F.desc("n")))).where("r = 1")
    return top.groupBy("episode_id").agg(F.when(F.count("*") == 1, F.max("intent")).otherwise("ambiguous").alias("intent"))


def signal_line(sums: list[Column]) -> Column:
    return T.or_null(F.concat_ws(", ", *sums))


def documents(episodes: DataFrame, sessions: DataFrame, groups: DataFrame, notes: DataFrame, decisions: DataFrame, events: DataFrame) -> DataFrame:
    """(episode_id, session_count, commit_group_count, first_prompt, text).

    ``sessions``: session_id, first_prompt, user_highlights, plan_files, session_signals. ``groups``:
    id, insertions, deletions. ``notes``: session_id, narrative, intent. ``decisions``: as
    :func:`decisions.finalise`. Blocks without content are left out.
    """
    from ..operators.decisions import summary

    e = episodes.select("episode_id", "episode_type")
    m = members(episodes, sessions).join(notes, "session_id", "left").join(steering.closed_loops(events), "session_id", "left")
    signal = lambda k: F.sum(F.coalesce(F.col(f"session_signals.{k}"), F.lit(0)))
    dispatching = F.col("dispatches") > 0
    s = m.groupBy("episode_id").agg(
        F.count("*").alias("session_count"), F.min_by("first_prompt", F.when(F.col("first_prompt").isNotNull(), F.col("place"))).alias("opening"), *[signal(k).alias(f"s_{k}") for k in SIGNALS],
        F.coalesce(F.sum("dispatches"), F.lit(0)).alias("dispatch_count"), F.avg(F.when(dispatching, F.col("committed").cast("int"))).alias("closed"),
    )
    # texts are cut before they are gathered, prompts counted once
    told_by = [S.capped_text(m, ["episode_id"], ["place"], F.col(c), n, RULE, name) for c, n, name in (("narrative", MAX_NARRATIVES, "narratives"), ("user_highlights", MAX_HIGHLIGHTS, "highlights"))]
    own = m.where(F.col("first_prompt").isNotNull() & ~F.ltrim("first_prompt").startswith("You are Codex")).groupBy("episode_id", "first_prompt").agg(F.min("place").alias("place"))
    prompts = S.top_by(own, ["episode_id"], ["place"], MAX_PROMPTS).groupBy("episode_id").agg(_in_order(F.col("first_prompt"), "place").alias("prompts"))
    g = episodes.select("episode_id", F.explode("commit_group_ids").alias("id")).join(groups.select("id", "insertions", "deletions"), "id")
    g = g.groupBy("episode_id").agg(F.count("*").alias("commit_group_count"), F.sum("insertions").alias("added"), F.sum("deletions").alias("deleted"))
    p = m.select("episode_id", "place", F.posexplode("plan_files").alias("n", "p")).select("episode_id", "place", "n", "p.*")
    last = p.groupBy("episode_id", "place", "filename").agg(F.min("n").alias("n"), F.count("*").alias("versions"), F.max_by(T.truncate(F.col("content"), 5000), F.struct("version", F.col("n"))).alias("content"))
    last = last.withColumn("r", F.row_number().over(Window.partitionBy("episode_id", "filename").orderBy("place", "n"))).where("r = 1")
    plan = F.format_string("### %s (%d version(s))\n%s", "filename", "versions", "content")
    plans = last.groupBy("episode_id").agg(_in_order(plan, "place", "n").alias("plans"))
    # decisions of all sessions of an episode count together, in order of their events
    d = decisions.join(members(episodes, sessions).select("episode_id", "session_id"), "session_id").where("significance != 'tactical'").drop("session_id").withColumnRenamed("episode_id", "session_id")
    told = summary(d).select(F.col("session_id").alias("episode_id"), F.format_string("%d decision(s): %d strategic, %d moderate; %d positive, %d negative outcome(s)\n%s", "total", "strategic", "moderate", "positive", "negative", "lines").alias("decisions"))
    for part in (*told_by, prompts):
        e = e.join(part, "episode_id", "left")
    x = e.join(s, "episode_id", "left").join(g, "episode_id", "left").join(plans, "episode_id", "left").join(told, "episode_id", "left").join(intent(m.select("episode_id", "intent")), "episode_id", "left")
    x = x.na.fill(0, ["session_count", "commit_group_count", "added", "deleted", "dispatch_count"])
    block = lambda title, body: F.when(~T.blank(body), F.concat(F.lit(f"## {title}\n"), body))
    ratio = F.coalesce(F.format_string("%.2f", round_binary(F.col("closed"), 2)), F.lit("n/a"))
    text = F.concat_ws(
        SEPARATOR,
        F.concat(F.lit("Episode type: "), "episode_type"),
        F.format_string("Sessions: %d, Commit groups: %d", "session_count", "commit_group_count"),
        F.when((F.col("commit_group_count") > 0) & (F.col("added") + F.col("deleted") > 0), F.format_string("Code volume: +%d/-%d lines (from this episode's commits)", "added", "deleted")),
        F.when((F.col("episode_type") == "session_only") & F.col("intent").isNotNull(), F.concat(F.lit("Session intent: "), "intent")),
        F.when(F.size("prompts") > 0, F.concat(F.lit("First prompts: "), F.array_join("prompts", " | "))),
        block("Session Narratives", F.col("narratives")), block("User Highlights", F.col("highlights")), block("Decision Exchanges", F.col("decisions")),
        block("Plan Files", F.array_join("plans", SEPARATOR)),
        block("Session Signals", signal_line([F.when(F.col(f"s_{k}") > 0, F.format_string(f"{k}: %d", F.col(f"s_{k}"))) for k in SIGNALS])),
        F.when(F.col("dispatch_count") > 0, F.concat(F.format_string("## Subagent Dispatch Activity\nDispatches: %d | Committed-return ratio: ", "dispatch_count"), ratio)),
    )
    return x.select("episode_id", "episode_type", "session_count", "commit_group_count", F.coalesce("opening", F.lit("")).alias("first_prompt"), text.alias("text"))


def _placed(folders: int = 0) -> Column:
    """Where a document lies: a folder an episode, or a file an episode in one of so many folders."""
    name = F.coalesce(F.col("episode_id").cast("string"), F.lit("__HIVE_DEFAULT_PARTITION__"))
    if not folders:
        return F.concat(F.lit("episode_id="), name, F.lit("/text.txt"))
    return F.concat(F.pmod(F.xxhash64("episode_id"), F.lit(folders)), F.lit("/"), name, F.lit(".txt"))


def write(docs: DataFrame, path: str, folders: int = 0) -> None:
    """One text an episode, and the manifest beside it, whose ``input_path`` tells where the text lies. Tasks write the texts and pass the rows on to the manifest.

    A text has a folder of its own, or is a file in one of ``folders``. The latter is for many episodes: each of these folders is made by one task and takes
    its name at once, whereas tasks that make a folder a text in one place wait for each other.
    """
    linefiles.emptied(f"{path}/documents")
    placed = docs.withColumn("input_path", _placed(folders)).withColumn("path", F.col("input_path"))
    linefiles.texts_to(placed, f"{path}/documents", F.substring_index("path", "/", 1)).write.mode("overwrite").json(f"{path}/manifest")


def read(manifest: DataFrame, path: str) -> DataFrame:
    """``manifest``, as :func:`write` left it, with ``text``, which ends with a newline: its rows tell the files, so no folder is listed. Without ``input_path`` each text has a folder of its own."""
    at = F.col("input_path") if "input_path" in manifest.columns else _placed()
    return linefiles.texts_at(manifest.withColumn("path", at).repartition("path"), f"{path}/documents").drop("path")
