"""Typed events of sessions: a state machine written as windows.

Every piece of state is a question about the neighbours in order (seq, bpos, sub): the result that
answers a commit is the first that isn't blank after it, a branch is the last one named, and so on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import text as T
from ..functions import times as TM
from ..sources.transcripts import V, blocks, get, kind_of
from . import scans
from . import sequence as S
from .decisions import any_match, first_of

ORDER = ["seq", "bpos", "sub"]
#: Columns of an event beside session_id, the order and index.
FIELDS = {
    "type": "string", "path": "string", "command": "string", "text": "string", "message": "string", "sha": "string", "branch": "string", "tool_use_id": "string", "subagent_id": "string",
    "description": "string", "prompt_hash": "string", "run_in_background": "boolean", "return_text_length": "bigint", "indicates_error": "boolean", "framework": "string",
    "passed": "bigint", "failed": "bigint", "pending": "bigint", "proposal_type": "string", "option_count": "bigint",
}


def group(s: Column, pattern: str, n: int) -> Column:
    """A group of the first match; null where the pattern doesn't match, also for an empty group that takes no part."""
    return F.when(s.rlike(pattern), F.regexp_extract(s, pattern, n))


def flattened(body: Column) -> Column:
    """A tool result's text: a string as it is, of a list the texts of its objects joined by a space."""
    listed = F.transform(F.filter(get(body, "$", "array<variant>"), lambda b: kind_of(b) == "OBJECT"), lambda b: F.coalesce(get(b, "$.text"), F.lit("")))
    return F.when(kind_of(body) == "STRING", get(body, "$")).when(kind_of(body) == "ARRAY", F.array_join(listed, " ")).otherwise("")


def user_text(s: Column) -> Column:
    """What a user really wrote in a text: null for reminders, local commands, skill templates and blanks; notifications cut out."""
    s = F.replace(s, F.lit("\x00"), F.lit(""))
    starts = lambda x, marks: F.coalesce(first_of([(x.startswith(m), F.lit(True)) for m in marks], F.lit(False)), F.lit(False))
    cut = T.strip(F.regexp_replace(s, P.TASK_NOTIFICATION, ""))
    drop = starts(s, P.REMINDERS) | (cut == "") | starts(cut, P.LOCAL_COMMANDS) | any_match(cut, P.SKILL_TEMPLATES)
    return F.when(~F.coalesce(drop, F.lit(True)), T.scrub(cut))


def commit_message(command: Column) -> Column:
    """Message of a commit command: double quoted, single quoted, here-document, else interactive; an empty message stays empty."""
    here = T.strip(F.regexp_extract(command, P.MESSAGE_HEREDOC, 1))
    return (
        F.when(command.rlike(P.MESSAGE_DOUBLE), F.regexp_extract(command, P.MESSAGE_DOUBLE, 1)).when(command.rlike(P.MESSAGE_SINGLE), F.regexp_extract(command, P.MESSAGE_SINGLE, 1))
        .when(command.rlike(P.MESSAGE_HEREDOC), here).otherwise("[interactive commit]")
    )


def test_result(s: Column) -> Column:
    """(framework, passed, failed, pending) of the first runner that the text speaks of."""
    n = lambda p, g: F.coalesce(F.regexp_extract(s, p, g).try_cast("long"), F.lit(0))
    made = lambda name, ok, bad, rest: F.struct(F.lit(name).alias("framework"), ok.alias("passed"), bad.alias("failed"), rest.cast("long").alias("pending"))
    none = F.lit(None)
    return (
        F.when(s.rlike(P.RSPEC), made("rspec", n(P.RSPEC, 1) - n(P.RSPEC, 2), n(P.RSPEC, 2), n(P.RSPEC, 3))).when(s.rlike(P.JEST), made("jest", n(P.JEST, 2), n(P.JEST, 1), none))
        .when(s.rlike(P.CARGO), made("cargo", n(P.CARGO, 1), n(P.CARGO, 2), none)).when(s.rlike(P.PYTEST), made("pytest", n(P.PYTEST, 1), n(P.PYTEST, 2), none))
    )


def proposal(s: Column) -> Column:
    """(proposal_type, option_count) of an agent's text; null if it proposes nothing. Fewer than two options have no count."""
    markers, names = F.regexp_count(s, F.lit(P.OPTION_MARKER)), F.regexp_count(s, F.lit(P.OPTION_WORD))
    count = F.when(markers >= 2, markers).when(names >= 2, names).cast("long")
    none = F.lit(None).cast("long")
    made = lambda kind, n: F.struct(F.lit(kind).alias("proposal_type"), n.alias("option_count"))
    return F.when(~T.blank(s) & any_match(s, P.OPTIONS), made("options", count)).when(~T.blank(s) & any_match(s, P.QUESTIONS), made("question", none)).when(~T.blank(s) & s.rlike(P.TRADEOFF), made("tradeoff", none))


def _event(kind: str, sub: int, when: Column, **fields: Column) -> Column:
    cols = [F.lit(sub).alias("sub"), *[(F.lit(kind) if k == "type" else fields.get(k, F.lit(None))).cast(t).alias(k) for k, t in FIELDS.items()]]
    return F.when(F.coalesce(when, F.lit(False)), F.struct(*cols))


def visible(found: DataFrame) -> DataFrame:
    """Entries with a message, without other agents' side chains; of a subagent's transcript (by its path, or all side chain) everything."""
    m = found.where("has_message")
    whole = m.groupBy("session_id").agg((F.bool_or(F.contains("path", F.lit("/subagents/"))) | F.bool_and("is_sidechain")).alias("is_subagent"))
    return m.join(whole, "session_id").where("not is_sidechain or is_subagent")


def candidates(seen: DataFrame) -> DataFrame:
    """All events before the cap, with ``raw`` facts that the state needs: one row an event, or a row of type null for a fact alone."""
    keep = ["session_id", "seq", "ts_raw", "etype"]
    b = blocks(seen, keep).withColumns({"input": get("b", "$.input", V), "body": get("b", "$.content", V)})
    is_input = kind_of("input") == "OBJECT"
    use = (F.col("etype") == "assistant") & F.col("is_list") & (F.col("btype") == "tool_use") & F.col("name").isNotNull() & F.coalesce(is_input, F.lit(False))
    path, command = T.scrub(get("input", "$.file_path")), F.coalesce(get("input", "$.command"), F.lit(""))
    shell = use & F.col("name").isin(*P.SHELL_TOOLS)
    branch = group(command, P.CHECKOUT, 1)
    switches = shell & branch.isNotNull() & ~branch.startswith("-")
    dispatch = use & F.col("name").rlike(P.DISPATCH_TOOL) & (F.coalesce("tool_id", F.lit("")) != "")
    agent = F.coalesce(*[F.when(~T.blank(get("input", k)), get("input", k)) for k in ("$.subagent_type", "$.agent_type")], F.lit("general-purpose"))
    about = T.scrub(get("input", "$.description"))
    result = (F.col("etype") == "user") & F.col("is_list") & (F.col("btype") == "tool_result")
    b = b.withColumn("result", F.when(result, flattened(F.col("body"))))
    said = ~T.blank(F.col("result"))
    text = (F.col("etype") == "assistant") & (F.col("btype") == "text") & ~F.col("bare")
    b = b.withColumns({"test": F.when(said, test_result(F.col("result"))), "idea": F.when(text, proposal(F.col("btext")))})
    wrong = F.col("result").rlike(P.ERROR_LINE)
    thought = T.truncate(T.scrub(get("b", "$.thinking")), P.MAX_THINKING)
    made = F.array(
        _event("file_edit", 0, use & (F.col("name") == "Edit") & ~T.blank(path), path=path),
        _event("file_create", 0, use & (F.col("name") == "Write") & ~T.blank(path), path=path),
        _event("file_read", 0, use & (F.col("name") == "Read") & ~T.blank(path), path=path),
        _event("git_branch_switch", 0, switches, branch=branch),
        _event("git_push", 1, shell & F.contains(command, F.lit("git push"))),
        _event("git_commit", 2, shell & F.contains(command, F.lit("git commit")), message=T.scrub(commit_message(command))),
        _event("bash_command", 3, shell & ~F.contains(command, F.lit("git ")), command=T.truncate(T.scrub(command), P.MAX_COMMAND)),
        _event(
            "subagent_dispatch", 0, dispatch & ~shell, tool_use_id=F.col("tool_id"), subagent_id=T.truncate(agent, 64), description=F.when(~T.blank(about), T.truncate(about, P.MAX_DESCRIPTION)),
            prompt_hash=T.prompt_hash(get("input", "$.prompt")), run_in_background=T.truthy(get("input", "$.run_in_background")),
        ),
        _event("subagent_return", 0, result & ~T.blank(F.col("tool_use_id")), tool_use_id=F.col("tool_use_id"), return_text_length=F.length("result"), indicates_error=F.coalesce(get("b", "$.is_error", "boolean"), F.lit(False)) | wrong),
        _event("test_run", 1, F.col("test").isNotNull(), framework=F.col("test.framework"), passed=F.col("test.passed"), failed=F.col("test.failed"), pending=F.col("test.pending")),
        _event("error_encountered", 2, said & wrong, message=T.truncate(T.scrub(T.first_line_matching(F.col("result"), P.ERROR_LINE)), P.MAX_TEXT)),
        _event("agent_proposal", 0, F.col("idea").isNotNull(), text=T.truncate(T.scrub(F.col("btext")), P.MAX_TEXT), proposal_type=F.col("idea.proposal_type"), option_count=F.col("idea.option_count")),
        _event("agent_thinking", 0, (F.col("etype") == "assistant") & F.col("is_list") & (F.col("btype") == "thinking") & ~T.blank(get("b", "$.thinking")), text=thought),
    )
    facts = b.select(
        *keep, "bpos", F.filter(made, lambda e: e.isNotNull()).alias("made"), F.when(said, F.col("result")).alias("result"), "tool_use_id", F.when(shell, command).alias("shell"), "tool_id"
    )
    directives = user_messages(seen).select(
        "session_id", "seq", "ts_raw", F.lit("user").alias("etype"), F.lit(2**31 - 1).alias("bpos"), F.array(_event("user_directive", 0, F.lit(True), text=T.truncate(T.scrub(F.col("full")), P.MAX_TEXT))).alias("made"),
        *[F.lit(None).cast("string").alias(c) for c in ("result", "tool_use_id", "shell", "tool_id")],
    )
    return facts.unionByName(directives)


def user_messages(seen: DataFrame) -> DataFrame:
    """(session_id, seq, ts_raw, text, full, word_count): what users wrote, a message an entry; parts of a list are joined by a space."""
    own = seen.where("etype = 'user'")
    b = blocks(own, ["session_id", "seq", "ts_raw"])
    # a whole string is stripped before reminders are looked for, list parts aren't
    raw = F.when(F.col("is_list"), F.col("btext")).otherwise(T.strip(F.replace("btext", F.lit("\x00"), F.lit(""))))
    # bare strings in a list are not user text
    b = b.where((F.col("btype") == "text") & ~F.col("bare")).withColumn("part", user_text(raw)).where("part is not null")
    m = b.groupBy("session_id", "seq", "ts_raw").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("bpos", "part"))), lambda x: x.part), " ").alias("full"))
    return m.select("session_id", "seq", "ts_raw", T.truncate(F.col("full"), P.MAX_USER_TEXT).alias("text"), "full", T.n_words(F.col("full")).alias("word_count"))


def marked(c: DataFrame) -> DataFrame:
    """Facts of blocks (made, shell, result, tool_id, tool_use_id) with what the state asks of each: does it commit, say something, ask for a pull request; which sha, request number and branch does it name."""
    named = [
        (group(F.col("shell"), P.CHECKOUT, 1), 0), (group(F.col("result"), P.COMMIT_OUTPUT, 1), 1), (group(F.col("result"), P.ON_BRANCH, 1), 2), (group(F.col("result"), P.SWITCHED, 1), 3),
    ]
    marks = F.array_compact(F.array(*[F.when(n.isNotNull() & ~((F.lit(r) == 0) & n.startswith("-")), F.struct(F.lit(r).alias("r"), n.alias("n"))) for n, r in named]))
    return c.withColumns({
        "commits": F.coalesce(F.exists("made", lambda e: e.type == "git_commit"), F.lit(False)), "said": F.col("result").isNotNull(), "asks": F.coalesce(F.col("shell").rlike(P.PR_CREATE), F.lit(False)),
        "asked_by": F.when(~T.blank(F.col("tool_id")), F.col("tool_id")), "said_sha": group(F.col("result"), P.COMMIT_OUTPUT, 2), "said_pr": group(F.col("result"), P.PR_URL, 1).try_cast("long"),
        "said_branch": F.when(F.size(marks) > 0, F.array_max(marks).n),
    })


def resolved(s: S.Stream) -> S.Stream:
    """Marked facts in order with ``sha`` of each commit and ``pr`` where a result answers a request; :mod:`streaming.states` finds the same as rows come in."""
    s = s.map(lambda c: c.withColumn("at", F.struct("seq", "bpos")))
    # a commit is answered by the next result, unless another commit comes before it
    heard = F.when(F.col("said") | F.col("commits"), F.struct("said", "said_sha"))
    # a result answers the newest request for a pull request before it, if ids agree or the request has none
    s = s.scan(__next=scans.following(heard), __ask=scans.last(F.when(F.col("asks"), F.struct("at", "asked_by"))))
    matches = F.col("said") & F.col("__ask").isNotNull() & (F.col("__ask.asked_by").isNull() | (F.col("__ask.asked_by") == F.col("tool_use_id")))
    s = s.map(lambda c: c.withColumns({"sha": F.when(F.col("commits") & F.col("__next.said"), F.col("__next.said_sha")), "__match": F.coalesce(matches, F.lit(False))}))
    # only the first answer of a request counts
    s = s.scan(__answered=scans.last(F.when(F.col("__match"), F.col("__ask.at"))))
    first = F.col("__match") & ~F.col("__answered").eqNullSafe(F.col("__ask.at"))
    return s.map(lambda c: c.withColumn("pr", F.when(first, F.col("said_pr"))).drop("__next", "__ask", "__match", "__answered"))


def extract(found: DataFrame, spread: bool = False, ranges: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(events, states). Events: session_id, index, ts_raw, ts and FIELDS. States: session_id, detected_branch, pr_number, shas and branches in order.

    ``spread`` (over ``ranges`` ranges) scans sessions that are too long for a task by ranges of their order.
    """
    c = resolved(S.Stream(marked(candidates(visible(found))), ["session_id"], ["seq", "bpos"], spread, ranges)).rows()
    states = c.groupBy("session_id").agg(F.max_by("said_branch", F.when(F.col("said_branch").isNotNull(), F.col("at"))).alias("detected_branch"), F.max_by("pr", F.when(F.col("pr").isNotNull(), F.col("at"))).alias("pr_number"))
    e = c.select("session_id", "seq", "bpos", "ts_raw", F.col("sha").alias("__sha"), F.explode("made").alias("e")).select("session_id", "seq", "bpos", "ts_raw", "__sha", "e.*")
    e = e.withColumn("sha", F.when(F.col("type") == "git_commit", F.col("__sha"))).drop("__sha")
    # a return counts only after a dispatch of its id; other events need no company
    alone = F.when(~F.col("type").isin("subagent_dispatch", "subagent_return"), F.struct(*ORDER))
    sent = F.min(F.when(F.col("type") == "subagent_dispatch", F.struct(*ORDER))).over(Window.partitionBy("session_id", "tool_use_id", alone))
    e = e.withColumn("__sent", sent).where((F.col("type") != "subagent_return") | (F.col("__sent") < F.struct(*ORDER))).drop("__sent")
    e = S.cap_events(e, ["session_id"], ORDER, F.col("type").isin(*P.STRUCTURAL), P.MAX_EVENTS, spread=spread)
    events = e.select("session_id", "index", "ts_raw", TM.instant(F.col("ts_raw")).alias("ts"), *FIELDS)
    git = events.where("type in ('git_commit', 'git_branch_switch')").groupBy("session_id").agg(_ordered("sha").alias("event_git_shas"), _ordered("branch").alias("event_branches"))
    return events, states.join(git, "session_id", "left")


def _ordered(column: str) -> Column:
    return F.transform(F.sort_array(F.collect_list(F.when(F.col(column).isNotNull(), F.struct("index", column)))), lambda x: x[column])


def tools(seen: DataFrame) -> DataFrame:
    """(session_id, name) of every tool call."""
    b = blocks(seen.where("etype = 'assistant'"), ["session_id", "seq"])
    return b.where(F.col("is_list") & (F.col("btype") == "tool_use")).select("session_id", F.coalesce("name", F.lit("")).alias("name"))


def assistant_turns(seen: DataFrame) -> DataFrame:
    """(session_id, assistant_count): entries with a tool call, a text that isn't blank, or a plain string."""
    b = blocks(seen.where("etype = 'assistant'"), ["session_id", "seq"])
    counts = ~F.col("is_list") | (F.col("btype") == "tool_use") | ((F.col("btype") == "text") & ~F.col("bare") & ~T.blank(F.col("btext")))
    turns = b.groupBy("session_id", "seq").agg(F.bool_or(counts).alias("counted"))
    return turns.groupBy("session_id").agg(F.count_if("counted").alias("assistant_count"))


def dispatch_metadata(events: DataFrame) -> DataFrame:
    sent = F.col("type") == "subagent_dispatch"
    return events.groupBy("session_id").agg(
        F.count_if(sent).alias("dispatch_count"), F.count_if(F.col("type") == "subagent_return").alias("return_count"), F.count_if(sent & F.col("run_in_background")).alias("run_in_background_count"),
        F.sort_array(F.collect_set(F.when(sent, F.col("subagent_id")))).alias("unique_subagent_ids"),
    )


def sessions(found: DataFrame, spread: bool = False) -> DataFrame:
    """The session record: one row a session, with times, windows, branch, prompts, signals, usage and plan files.

    ``events`` stays a table of its own, from :func:`extract`.
    """
    from . import rollup, signals

    seen = visible(found).persist()
    events, states = extract(found, spread)
    # read by several aggregates below; lost blocks are computed again
    events, said = events.persist(), user_messages(seen).persist()
    first = lambda c, by: F.min_by(c, F.when(F.col(c).isNotNull(), F.col(by)))
    stamped = F.when(F.coalesce("ts_raw", F.lit("")) != "", F.col("seq"))
    base = seen.groupBy("session_id").agg(
        F.min("path").alias("path"), F.min_by("ts_raw", stamped).alias("session_created_at"), F.max_by("ts_raw", stamped).alias("session_modified_at"),
        F.coalesce(first("git_branch", "seq"), F.max("meta_branch")).alias("entry_branch"), F.bool_or("is_subagent").alias("is_subagent"),
    )
    times = seen.select("session_id", "seq", TM.instant(F.col("ts_raw")).alias("ts"))
    windows = S.active_windows(times, ["session_id"], "ts", P.WINDOW_GAP_MINUTES * 60, spread=spread).groupBy("session_id").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("start", "end"))), lambda x: F.struct(TM.iso(x["start"]).alias("start"), TM.iso(x["end"]).alias("end"))).alias("active_time_windows")
    )
    usage = rollup.usage(seen.where("etype = 'assistant'").withColumn("counted", F.lit(True)))
    per_model = usage.groupBy("session_id").agg(
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("model", "messages")))).alias("model_usage"),
        F.map_from_entries(F.sort_array(F.collect_list(F.when(F.col("assistant_turns") > 0, F.struct("model", F.struct(*rollup.TOKEN_KINDS, "assistant_turns").alias("u")))))).alias("token_usage"),
    )
    b = blocks(seen.where("etype = 'assistant'"), ["session_id", "seq"]).where(F.col("is_list") & (F.col("btype") == "tool_use") & F.col("name").isin("Write", "Edit"))
    writes = b.select("session_id", (F.col("seq") * 100_000 + F.col("bpos")).alias("seq"), T.scrub(get(get("b", "$.input", V), "$.file_path")).alias("path"), get(get("b", "$.input", V), "$.content").alias("content"), (F.col("name") == "Edit").alias("is_edit"))
    plans = signals.plan_files(writes).groupBy("session_id").agg(F.sort_array(F.collect_list(F.struct("filename", "version", "full_path", "content", "has_verification", "has_alternatives", "has_edge_cases"))).alias("plan_files"))
    s = signals.session_signals(said, events, tools(seen), assistant_turns(seen), times)
    s = s.select("session_id", F.struct(*[c for c in s.columns if c != "session_id"]).alias("session_signals"))
    stats = signals.prompt_stats(said)
    stats = stats.select("session_id", F.struct("median_words", "short_prompt_count", "caps_quotes").alias("prompt_stats"))
    out = base
    for part in (states, signals.first_prompt(said, ["session_id"], "seq"), signals.highlights(said, ["session_id"], "seq"), windows, per_model, plans, s, stats, dispatch_metadata(events)):
        out = out.join(part, "session_id", "left")
    return out.withColumn("git_branch", F.coalesce("entry_branch", "detected_branch")).drop("entry_branch", "detected_branch")
