"""Transcripts of two agents as one table of canonical entries.

Agent A writes one entry a line; agent B ("rollouts") wraps payloads, or writes them bare in older
files. Lines that don't parse, or aren't objects, and reads that end early go to :func:`rejects`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import text as T
from ..operators.sequence import numbered
from ..stored import stored
from . import linefiles

V = "variant"


def get(v: Column | str, path: str, kind: str = "string") -> Column:
    v = F.col(v) if isinstance(v, str) else v
    return F.try_variant_get(v, path, kind)


def kind_of(v: Column | str) -> Column:
    """STRING, OBJECT, ARRAY, BIGINT, ... of a variant; null for null."""
    v = F.col(v) if isinstance(v, str) else v
    return F.regexp_extract(F.schema_of_variant(v), "^[A-Z]+", 0)


def read_lines(spark: SparkSession, paths: str | list[str], split: int = linefiles.SPLIT, suffix: str = ".jsonl") -> DataFrame:
    """(path, seq, raw, error) of every line that isn't blank of every file under ``paths`` that ends in ``suffix``, compressed or not; ``seq`` is the line's byte offset.

    Large files are read in splits. A file that can't be read to its end gives the lines before the error and one row with ``error``,
    which :func:`rejects` tells; errors of the storage fail the read.
    """
    lines = linefiles.read(spark, paths, suffix, split).select(F.regexp_replace("path", "^file:/*", "/").alias("path"), F.col("at").alias("seq"), "raw", "error")
    return lines.where(F.col("error").isNotNull() | ~T.blank(F.col("raw")))


def _opens(v: Column) -> Column:
    opens = (get(v, "$.type") == "session_meta") | F.contains(F.coalesce(get(v, "$.originator"), F.lit("")), F.lit("codex"))
    return F.coalesce(opens & (kind_of(v) == "OBJECT"), F.lit(False))


def formats(lines: DataFrame) -> DataFrame:
    """(path, rollout): whether a file's first line that isn't blank opens a rollout; one that doesn't parse means it doesn't."""
    first = lines.where("raw is not null").groupBy("path").agg(F.min_by("raw", "seq").alias("raw")).withColumn("v", F.try_parse_json(T.strip(F.col("raw"))))
    return first.select("path", _opens(F.col("v")).alias("rollout"))


def held(lines: DataFrame, seen: Observation | None = None) -> DataFrame:
    """(path, seq, rollout, v, error): lines parsed once and stored, with what opened their file; NUL characters are dropped from transcripts only.

    ``seen`` observes the pass: lines, and of them ``unparsable``, ``not_objects`` and ``errors`` (reads that ended early).
    """
    error = F.col("error") if "error" in lines.columns else F.lit(None).cast("string")
    # both readings agree where a line has no NUL, so the text is parsed before its format is known
    v = F.try_parse_json(T.strip(F.col("raw")))
    clean = F.when(F.contains("raw", F.lit("\x00")), F.try_parse_json(T.strip(F.replace("raw", F.lit("\x00"), F.lit(""))))).otherwise(v)
    p = lines.select("path", "seq", v.alias("v"), clean.alias("clean"), (v.isNotNull() & _opens(v)).alias("opens"), error.alias("error"))
    if seen is not None:
        object_ = kind_of("clean") == "OBJECT"
        p = p.observe(
            seen, F.count_if(F.col("error").isNull()).alias("lines"), F.count_if(F.col("error").isNull() & F.col("clean").isNull()).alias("unparsable"),
            F.count_if(F.col("clean").isNotNull() & ~object_).alias("not_objects"), F.count_if(F.col("error").isNotNull()).alias("errors"),
        )
    p = stored(p)
    # one row a file
    first = p.where("error is null").groupBy("path").agg(F.min_by("opens", "seq").alias("rollout"))
    rollout = F.coalesce("rollout", F.lit(False))
    return p.join(first, "path", "left").select("path", "seq", rollout.alias("rollout"), F.when(rollout, F.col("v")).otherwise(F.col("clean")).alias("v"), "error")


def rejects(lines: DataFrame) -> DataFrame:
    """(path, seq, reason) of lines that hold no entry, and of reads that ended early; ``lines`` may be :func:`held` ones."""
    p = lines if "v" in lines.columns else held(lines)
    reason = F.coalesce("error", F.when(F.col("v").isNull(), "unparsable").when(kind_of("v") != "OBJECT", "not an object"))
    return p.select("path", "seq", reason.alias("reason")).where("reason is not null")


def entries(lines: DataFrame) -> DataFrame:
    """Canonical entries of both agents: path, session_id, rollout, seq, etype, role, content, ts_raw, is_sidechain, git_branch, cwd, msg_id, model, usage; ``lines`` may be :func:`held` ones."""
    p = (lines if "v" in lines.columns else held(lines)).where(kind_of("v") == "OBJECT").drop("error")
    return _transcript(p.where("not rollout")).unionByName(_rollout(p.where("rollout")))


_USAGE = "struct<input_tokens:bigint,output_tokens:bigint,cache_read_input_tokens:bigint,cache_creation_input_tokens:bigint>"


def _stem(path: Column) -> Column:
    return F.regexp_replace(T.basename(path), r"\.jsonl(\.gz)?$", "")


def _transcript(p: DataFrame) -> DataFrame:
    message = get("v", "$.message", V)
    truth = lambda c: F.coalesce(get("v", c, "boolean"), F.lit(False))
    out = p.withColumn("m", message)
    return out.select(
        "path", _stem(F.col("path")).alias("session_id"), "rollout", "seq", get("v", "$.type").alias("etype"), F.coalesce(get("m", "$.role"), get("v", "$.type")).alias("role"),
        F.coalesce(kind_of("m") == "OBJECT", F.lit(False)).alias("has_message"), get("m", "$.content", V).alias("content"), get("v", "$.timestamp").alias("ts_raw"), truth("$.isSidechain").alias("is_sidechain"),
        T.or_null(get("v", "$.gitBranch")).alias("git_branch"), T.or_null(get("v", "$.cwd")).alias("cwd"), get("m", "$.id").alias("msg_id"), get("m", "$.model").alias("model"),
        F.when(kind_of(get("m", "$.usage", V)) == "OBJECT", get("m", "$.usage", _USAGE)).alias("usage"), F.lit(None).cast("string").alias("meta_branch"),
    )


def _as_variant(x: Column) -> Column:
    """A column's value as a variant, whatever its type."""
    return F.try_variant_get(F.parse_json(F.to_json(F.struct(x.alias("c")))), "$.c", V)


def _tool(name: Column, **fields: Column) -> Column:
    return F.struct(F.lit("tool_use").alias("type"), name.alias("name"), F.struct(*[c.alias(k) for k, c in fields.items()]).alias("input"))


def _patch_blocks(patch: Column) -> Column:
    """A write or edit for each file marker of a patch; only paths are kept."""
    marks = F.arrays_zip(F.regexp_extract_all(patch, F.lit(P.PATCH_FILE), F.lit(1)).alias("op"), F.regexp_extract_all(patch, F.lit(P.PATCH_FILE), F.lit(2)).alias("file"))
    return F.transform(marks, lambda m: _tool(F.when(m["op"].startswith("Add"), "Write").otherwise("Edit"), file_path=T.strip(m["file"])))


def boilerplate(text: Column) -> Column:
    out = F.ltrim(text).startswith(P.ROLLOUT_PREAMBLE)
    for mark in P.ROLLOUT_BOILERPLATE:
        out = out | F.contains(text, F.lit(mark))
    return out


def _rollout(p: DataFrame) -> DataFrame:
    own = get("v", "$.payload", V)
    bare_meta = get("v", "$.originator", V).isNotNull() | (get("v", "$.id", V).isNotNull() & get("v", "$.cwd", V).isNotNull())
    typed = get("v", "$.type", V).isNotNull() & get("v", "$.timestamp", V).isNotNull()
    p = p.withColumn("b", F.coalesce(own, F.col("v"))).where(kind_of("b") == "OBJECT")
    meta = (get("b", "$.type") == "session_meta") | (get("v", "$.type") == "session_meta") | (own.isNull() & ~typed & bare_meta)
    p = p.withColumn("is_meta", F.coalesce(meta, F.lit(False))).withColumn("kind", F.coalesce(get("b", "$.type"), F.lit("")))
    context = get("b", "$.model", V).isNotNull() & get("b", "$.approval_policy", V).isNotNull()
    # session metadata: the first line that has a value; an id is pinned by the first session_meta even if it has none
    w = ["path"]
    m = p.where("is_meta").groupBy(*w).agg(
        F.min_by(F.struct(get("b", "$.id").alias("x")), F.col("seq")).alias("id"), F.min_by(F.struct(get("b", "$.cwd").alias("x")), F.col("seq")).alias("cwd"),
        F.min_by(get("b", "$.git.branch"), F.when(get("b", "$.git.branch").isNotNull(), F.col("seq"))).alias("branch"),
    )
    body = p.where(~F.col("is_meta") & ~F.coalesce(context, F.lit(False)) & ~F.col("kind").isin(*P.ROLLOUT_SKIPPED))
    text = F.coalesce(get("b", "$.message"), F.lit(""))
    args = F.try_parse_json(F.coalesce(get("b", "$.arguments"), F.lit("")))
    body = body.withColumns({"text": text, "args": args, "name": F.coalesce(get("b", "$.name"), F.lit(""))})
    # an apply_patch call is a list whose first word is literally that
    cmd = F.coalesce(get("args", "$.cmd", "array<string>"), get("args", "$.command", "array<string>"))
    envelope = F.coalesce(F.try_element_at(F.filter(F.slice(cmd, 2, F.greatest(F.size(cmd), F.lit(1))), lambda s: F.contains(s, F.lit(P.PATCH_BEGIN))), F.lit(1)), F.lit(""))
    patch = F.when((F.get(cmd, 0) == "apply_patch") & (envelope != ""), _patch_blocks(envelope))
    steps = get("args", "$.plan", "array<variant>")
    step = lambda s: F.concat(F.lit("- ["), F.coalesce(T.or_null(T.strip(get(s, "$.status"))), F.lit("pending")), F.lit("] "), T.strip(get(s, "$.step")))
    shown = F.transform(F.filter(steps, lambda s: ~T.blank(get(s, "$.step"))), step)
    rendered = F.array_join(F.concat(F.filter(F.array(T.strip(get("args", "$.explanation"))), lambda e: ~T.blank(e)), shown), "\n")
    raw_command = F.coalesce(get("args", "$.cmd", V), get("args", "$.command", V))
    command = F.coalesce(F.when(kind_of(raw_command) == "ARRAY", F.regexp_replace(F.to_json(raw_command), r'("(?:[^"\\]|\\.)*"),', "$1, ")).otherwise(F.coalesce(get("args", "$.cmd"), get("args", "$.command"))), F.concat(F.lit("["), F.col("name"), F.lit("]")))
    bad_args = F.col("args").isNotNull() & (kind_of("args") != "OBJECT")
    call = (
        F.when(bad_args, F.lit(None))
        .when(F.size(F.coalesce(patch, F.array().cast("array<struct<type:string,name:string,input:struct<file_path:string>>>"))) > 0, _as_variant(patch))
        .when((F.col("name") == "update_plan") & (F.size(F.coalesce(steps, F.array().cast("array<variant>"))) > 0), _as_variant(F.array(_tool(F.lit("Write"), file_path=F.lit(P.ROLLOUT_PLAN), content=rendered))))
        .when(F.col("name") == "update_plan", F.lit(None))
        .otherwise(_as_variant(F.array(_tool(F.lit("Bash"), command=command))))
    )
    custom = F.coalesce(get("b", "$.input"), F.lit(""))
    custom_blocks = F.when((F.col("name") == "apply_patch") & F.contains(custom, F.lit(P.PATCH_BEGIN)), _patch_blocks(custom))
    output = F.coalesce(get("b", "$.output"), F.lit(""))
    thinking = F.when(
        F.col("kind") == "reasoning", F.array_join(F.filter(F.transform(get("b", "$.summary", "array<variant>"), lambda s: get(s, "$.text")), lambda s: s.isNotNull()), "\n")
    ).otherwise(get("b", "$.text"))
    parts = F.transform(F.filter(get("b", "$.content", "array<variant>"), lambda c: get(c, "$.type").isin("input_text", "text")), lambda c: F.coalesce(get(c, "$.text"), F.lit("")))
    said = F.when(kind_of(get("b", "$.content", V)) == "STRING", get("b", "$.content")).otherwise(F.coalesce(F.array_join(parts, "\n"), F.lit("")))
    block = lambda **f: _as_variant(F.array(F.struct(*[c.alias(k) for k, c in f.items()])))
    k = F.col("kind")
    content = (
        F.when((k == "user_message") & ~T.blank(F.col("text")) & ~boilerplate(F.col("text")), _as_variant(F.col("text")))
        .when((k == "agent_message") & ~T.blank(F.col("text")), _as_variant(F.col("text")))
        .when(k == "function_call", call)
        .when((k == "custom_tool_call") & (F.size(F.coalesce(custom_blocks, F.array().cast("array<struct<type:string,name:string,input:struct<file_path:string>>>"))) > 0), _as_variant(custom_blocks))
        .when((k == "function_call_output") & ~T.blank(output), block(type=F.lit("tool_result"), content=output))
        .when(k.isin("reasoning", "agent_reasoning") & ~T.blank(thinking), block(type=F.lit("thinking"), thinking=thinking))
        .when((k == "message") & (F.coalesce(get("b", "$.role"), F.lit("")) != "developer") & ~T.blank(said) & ~boilerplate(said), _as_variant(said))
    )
    role = F.when(k.isin("user_message", "function_call_output") | ((k == "message") & (get("b", "$.role") == "user")), "user").otherwise("assistant")
    none = lambda t: F.lit(None).cast(t)
    out = body.withColumn("content", content).where("content is not null").join(m, "path", "left")
    return out.select(
        "path", F.coalesce(T.or_null(F.col("id.x")), _stem(F.col("path"))).alias("session_id"), "rollout", "seq", role.alias("etype"), role.alias("role"), F.lit(True).alias("has_message"), "content",
        get("v", "$.timestamp").alias("ts_raw"), F.lit(False).alias("is_sidechain"), none("string").alias("git_branch"), F.col("cwd.x").alias("cwd"), none("string").alias("msg_id"), none("string").alias("model"), none(_USAGE).alias("usage"), F.col("branch").alias("meta_branch"),
    )


def blocks(found: DataFrame, keep: list[str]) -> DataFrame:
    """One row a content block with ``bpos``: a string is one text block, bare strings in a list are text blocks, other values are dropped.

    ``b`` is the block as a variant; ``is_list`` tells whether the content was a list, ``bare`` whether the block was a string in one.
    """
    text = F.struct(F.lit("text").alias("type"), F.col("content").cast("string").alias("text"))
    is_list = F.coalesce(kind_of("content") == "ARRAY", F.lit(False))
    listed = F.transform(get("content", "$", "array<variant>"), lambda b: F.when(kind_of(b) == "STRING", F.try_variant_get(F.parse_json(F.to_json(F.struct(F.struct(F.lit("text").alias("type"), b.cast("string").alias("text"), F.lit(True).alias("bare")).alias("c")))), "$.c", V)).otherwise(b))
    as_list = F.when(is_list, listed).when(kind_of("content") == "STRING", F.array(_as_variant(text)))
    out = found.select(*keep, is_list.alias("is_list"), F.posexplode(as_list).alias("bpos", "b"))
    out = out.where(kind_of("b") == "OBJECT")
    return out.withColumns({"btype": get("b", "$.type"), "btext": get("b", "$.text"), "name": get("b", "$.name"), "tool_id": get("b", "$.id"), "tool_use_id": get("b", "$.tool_use_id"), "bare": F.coalesce(get("b", "$.bare", "boolean"), F.lit(False))})


def sessions_in_order(found: DataFrame) -> DataFrame:
    """(session_id, path, sess_pos): sessions in order of their paths."""
    return numbered(found.groupBy("session_id").agg(F.min("path").alias("path")), ["path", "session_id"], "sess_pos")
