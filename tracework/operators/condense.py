"""Condensed sessions: the transcript as short lines, with counts of what happened."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import text as T
from ..sources.transcripts import V, blocks, get, kind_of

EDIT_TOOLS, DISPATCH_TOOLS = ("Write", "Edit", "MultiEdit", "NotebookEdit"), ("Task", "Agent")


def dumped_bytes(body: Column) -> Column:
    """Bytes of a value as JSON with ``", "`` and ``": "`` separators and ASCII escapes; 0 for none."""
    j = F.to_json(body)
    bare = F.regexp_replace(j, r'"(?:[^"\\]|\\.)*"', '""')
    escapes = 5 * F.regexp_count(j, F.lit(r"[^\x00-\x7F]")) + 6 * F.regexp_count(j, F.lit(r"[\x{10000}-\x{10FFFF}]"))
    return F.when(body.isNull(), 0).otherwise(F.length(j) + escapes + F.regexp_count(bare, F.lit("[,:]"))).cast("long")


def tool_summary(name: Column, inp: Column) -> Column:
    """A tool call in one line: bodies as byte counts, prompts as counts and hashes, of unknown tools only the names of their inputs."""
    f = lambda k: get(inp, f"$.{k}")
    c = lambda k, n: T.clip(f(k), n)
    lit, cat = F.lit, F.concat
    path = T.clip(F.coalesce(T.or_null(f("file_path")), f("notebook_path")), 200)
    edits = F.size(F.coalesce(get(inp, "$.edits", "array<variant>"), F.array().cast("array<variant>"))).cast("string")
    keys = F.array_join(F.array_sort(F.json_object_keys(F.to_json(inp))), ", ")
    return (
        F.when(name == "Write", cat(lit("Write(file_path="), c("file_path", 200), lit(", content="), T.byte_marker(f("content")), lit(")")))
        .when(name == "Edit", cat(lit("Edit(file_path="), c("file_path", 200), lit(", old_string="), T.byte_marker(f("old_string")), lit(", new_string="), T.byte_marker(f("new_string")), lit(")")))
        .when(name.isin("MultiEdit", "NotebookEdit"), cat(name, lit("(file_path="), path, lit(", edits=["), edits, lit(" edits])")))
        .when(name.isin(*DISPATCH_TOOLS), cat(lit("Task(description="), c("description", 120), lit(", subagent_type="), c("subagent_type", 40), lit(", prompt="), T.prompt_marker(f("prompt")), lit(")")))
        .when(name == "Bash", cat(lit("Bash(command="), c("command", 160), lit(", description="), c("description", 80), lit(")")))
        .when(name == "Read", cat(lit("Read(file_path="), c("file_path", 200), lit(")")))
        .when(name == "Grep", cat(lit("Grep(pattern="), c("pattern", 160), lit(", path="), c("path", 200), lit(")")))
        .when(name == "Glob", cat(lit("Glob(pattern="), c("pattern", 200), lit(")")))
        .otherwise(cat(name, lit("("), F.coalesce(keys, lit("")), lit(")")))
    )


def condensed(found: DataFrame) -> DataFrame:
    """One row a session: condensed_text, token_estimate, too_short and facts.

    Side chains count here, as do tool results as user messages. A line that isn't an object is no entry.
    """
    keep = ["session_id", "path", "rollout", "seq", "role"]
    b = blocks(found.where("content is not null"), keep).withColumns({"input": get("b", "$.input", V), "body": get("b", "$.content", V)})
    user, agent = F.col("role") == "user", F.col("role") == "assistant"
    said = F.left(T.scrub(F.col("btext")), F.lit(P.MAX_USER_TEXT))
    name = F.coalesce("name", F.lit("Tool"))
    line = (
        F.when(user & (F.col("btype") == "text") & ~T.blank(said), F.concat(F.lit("USER: "), said))
        .when(user & (F.col("btype") == "tool_result"), F.concat(F.lit("[ToolResult: "), dumped_bytes(F.col("body")).cast("string"), F.lit(" bytes]")))
        .when(agent & (F.col("btype") == "text") & ~T.blank(said), F.concat(F.lit("ASSISTANT: "), said))
        .when(agent & (F.col("btype") == "tool_use"), F.concat(F.lit("TOOL_USE: "), tool_summary(name, F.col("input"))))
    )
    use = agent & (F.col("btype") == "tool_use")
    plan = F.col("rollout") & (F.coalesce(get("input", "$.file_path"), F.lit("")) == P.ROLLOUT_PLAN)
    b = b.withColumn("line", line).withColumn("at", F.struct("seq", "bpos"))
    s = b.groupBy("session_id").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col("line").isNotNull(), F.struct("at", "line")))), lambda x: x.line), "\n").alias("condensed_text"),
        F.count_if(use).alias("tool_uses"), F.count_if(user & (F.col("btype") == "tool_result")).alias("tool_results"), F.count_if(use & name.isin(*DISPATCH_TOOLS)).alias("subagent_dispatches"),
        F.count_if(use & name.isin(*EDIT_TOOLS) & ~plan).alias("code_edits"), F.count_if(use & (name == "Bash") & F.coalesce(get("input", "$.command"), F.lit("")).rlike(r"(?U)\bgit\s+commit\b")).alias("git_commits"),
        F.min_by(F.left(said, F.lit(P.CONDENSED_FIRST_PROMPT)), F.when(user & (F.col("btype") == "text") & ~T.blank(said), F.col("at"))).alias("first_prompt"),
    )
    m = found.groupBy("session_id").agg(
        F.min("path").alias("path"), F.bool_or("rollout").alias("rollout"), F.count_if(user).alias("user_messages"), F.count_if(agent).alias("assistant_messages"),
        F.min_by("cwd", F.when(F.col("cwd").isNotNull(), F.col("seq"))).alias("cwd"),
    )
    out = m.join(s, "session_id", "left").withColumn("condensed_text", F.coalesce("condensed_text", F.lit("")))
    counts = ["tool_uses", "tool_results", "subagent_dispatches", "code_edits", "git_commits"]
    out = out.na.fill(0, counts).withColumn("token_estimate", T.tokens(F.col("condensed_text"))).withColumn("too_short", T.too_short(F.col("condensed_text")))
    facts = F.struct("user_messages", "assistant_messages", *counts, "first_prompt")
    return out.select("session_id", "path", F.when(F.col("rollout"), "codex_cli").otherwise("claude_code").alias("agent_type"), "cwd", "condensed_text", "token_estimate", "too_short", facts.alias("facts"))
