"""Queries over transcripts: every event of a user becomes a line of that user's log, by templates, and goes through the transcript operators.

Users whose number divides by three write rollouts, others the plain format; those that divide by
seven are subagents by their path. The SQL tells each line's entries and events from its kind alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import condense as C
from ..operators import decisions as D
from ..operators import events as E
from ..operators import signals as G
from ..operators import steering as ST
from ..plans import report as R
from ..sources import transcripts as T
from ..stored import stored
from . import streams

_HEAD = '"timestamp":"@T","cwd":"/w",'
_USE = '{"type":"assistant",' + _HEAD + '"message":{"role":"assistant","id":"m@P","model":"big-@R","usage":{"input_tokens":@N,"output_tokens":2},"content":[{"type":"tool_use",%s}]}}'
_RESULT = '{"type":"user",' + _HEAD + '"message":{"role":"user","content":[{"type":"tool_result",%s}]}}'
#: Lines of the plain format by their kind. @N: k, @0: k with two digits, @J, @P, @R, @M: k modulo 4, 5, 3, 10, @T: time, @U: user, @Z: a NUL character.
PLAIN = (
    '{"type":"user","timestamp":"@T","gitBranch":"main","cwd":"/w","message":{"role":"user","content":"please fix item @N, thanks"}}',
    '{"type":"user",' + _HEAD + '"message":{"role":"user","content":["bare",{"type":"text","text":"<system-reminder>x</system-reminder>"},{"type":"text","text":"go with option A@N and stop"}]}}',
    _RESULT % '"tool_use_id":"t@M","content":"@N passed, @J failed\\nTypeError: bad @N"',
    _RESULT % '"tool_use_id":"p@P","is_error":true,"content":[{"type":"text","text":"see https://github.com/o/r/pull/@N"},{"type":"text","text":"done"}]',
    '{"type":"assistant",' + _HEAD + '"message":{"role":"assistant","id":"m@P","model":"big-@R","usage":{"input_tokens":@N,"output_tokens":2},"content":[{"type":"text","text":"Would you like option A or option B? @N"}]}}',
    _USE.replace("[{", '[{"type":"thinking","thinking":"a key insight @N"},{') % '"id":"e@N","name":"Edit","input":{"file_path":"src/f@N.py","old_string":"x","new_string":"yy"}',
    _USE % '"id":"w@N","name":"Write","input":{"file_path":"docs/PLAN.md","content":"- [ ] verify @N"}',
    _USE % '"id":"c@N","name":"Bash","input":{"command":"git commit -m \\"fix: @N\\""}',
    _RESULT % '"tool_use_id":"b","content":"[topic/b@R a1b2c@0] fix"',
    _USE % '"id":"g@N","name":"Bash","input":{"command":"git checkout -b br@R && git push"}',
    _USE % '"id":"t@M","name":"Task","input":{"description":"look @N","prompt":"go @N","subagent_type":"scout","run_in_background":true}',
    _USE % '"id":"p@P","name":"Bash","input":{"command":"gh pr create --fill"}',
    "not json @N",
    "[1, @N]",
    _USE.replace("{", '{"isSidechain":true,', 1) % '"id":"l@N","name":"Bash","input":{"command":"ls @J"}',
    '{"type":"user",' + _HEAD + '"message":{"role":"user","content":"drop@Z table @N and then write all of the rows back one by one so that the order stays the same as before"}}',
)
_PAYLOAD = '{"timestamp":"@T","type":"response_item","payload":{%s}}'
META = '{"timestamp":"@T","type":"session_meta","payload":{"id":"s@U","cwd":"/b@U","git":{"branch":"dev"}}}'
#: Lines of a rollout by their kind; its first line is META.
ROLLOUT = (
    _PAYLOAD % '"type":"user_message","message":"build @N things"',
    _PAYLOAD % '"type":"user_message","message":"<environment_context> @N"',
    _PAYLOAD % '"type":"function_call","name":"shell","arguments":"{\\"command\\":[\\"ls\\",\\"-l\\",\\"f@N\\"]}"',
    _PAYLOAD % '"type":"function_call","name":"shell","arguments":"{\\"command\\":[\\"apply_patch\\",\\"*** Begin Patch\\\\n*** Add File: n@N.py\\\\n+x\\\\n*** Update File: o@N.py\\\\n*** End Patch\\"]}"',
    _PAYLOAD % '"type":"function_call","name":"update_plan","arguments":"{\\"plan\\":[{\\"step\\":\\"one @N\\",\\"status\\":\\"done\\"},{\\"step\\":\\"two\\"}],\\"explanation\\":\\"why\\"}"',
    _PAYLOAD % '"type":"function_call","name":"shell","arguments":"[1]"',
    _PAYLOAD % '"type":"function_call_output","output":"@N examples, @J failures"',
    _PAYLOAD % '"type":"message","role":"developer","content":"hidden"',
    _PAYLOAD % '"type":"reasoning","summary":[{"type":"s","text":"thinking @N"}]',
    _PAYLOAD % '"type":"message","role":"assistant","content":[{"type":"text","text":"done @N"}]',
    _PAYLOAD % '"type":"token_count"',
    _PAYLOAD % '"type":"custom_tool_call","name":"apply_patch","input":"*** Begin Patch\\n*** Update File: c@N.py\\n*** End Patch"',
    _PAYLOAD % '"type":"agent_message","message":"I will do @N"',
    '{"timestamp":"@T","type":"agent_message","message":"bare @N"}',
    _PAYLOAD % '"type":"x","model":"g","approval_policy":"never"',
    _PAYLOAD % '"type":"user_message","message":"drop@Z @N"',
)


def lines(spark, sf_dir) -> DataFrame:
    """(path, seq, raw) of all users' logs."""
    e = streams.indexed(spark, sf_dir).withColumn("k", F.get_json_object("props", "$.k").cast("long"))
    kind = (F.col("event_id") % 16 + 1).cast("int")
    rollout = F.col("user_id") % 3 == 0
    raw = F.when(rollout & (F.col("index") == 0), META).when(rollout, F.element_at(F.array(*map(F.lit, ROLLOUT)), kind)).otherwise(F.element_at(F.array(*map(F.lit, PLAIN)), kind))
    text = lambda c: c.cast("string")
    marks = {
        "@N": text(F.col("k")), "@0": F.lpad(text(F.col("k")), 2, "0"), "@J": text(F.col("k") % 4), "@P": text(F.col("k") % 5), "@R": text(F.col("k") % 3), "@M": text(F.col("k") % 10),
        "@U": text(F.col("user_id")), "@Z": F.lit("\x00"), "@T": F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("Z")),
    }
    for mark, value in marks.items():
        raw = F.replace(raw, F.lit(mark), value)
    path = F.concat(F.when(F.col("user_id") % 7 == 0, "/logs/subagents/").otherwise("/logs/"), F.when(rollout, "r").otherwise("u"), text(F.col("user_id")), F.lit(".jsonl"))
    return e.select(path.alias("path"), F.col("index").alias("seq"), raw.alias("raw"))


def entries(spark, sf_dir) -> DataFrame:
    return T.entries(lines(spark, sf_dir))


def events(spark, sf_dir) -> DataFrame:
    """Typed events as the next stage reads them, from a table."""
    return stored(E.extract(stored(entries(spark, sf_dir)))[0])


def transcript_formats(spark, sf_dir):
    return T.formats(lines(spark, sf_dir))


def transcript_rejects(spark, sf_dir):
    return T.rejects(lines(spark, sf_dir))


def transcript_entries(spark, sf_dir):
    """Entries of both formats with their metadata; a content list counts its parts."""
    e = entries(spark, sf_dir)
    text = F.when(T.kind_of("content") == "STRING", T.get("content", "$"))
    n = F.when(T.kind_of("content") == "ARRAY", F.size(T.get("content", "$", "array<variant>")))
    return e.select(
        "session_id", "seq", "rollout", "etype", "role", "has_message", "is_sidechain", "git_branch", "cwd", "meta_branch", "msg_id", "model", "ts_raw",
        F.col("usage.input_tokens").alias("input_tokens"), text.alias("text"), n.cast("long").alias("n_parts"),
    )


def transcript_blocks(spark, sf_dir):
    """Content blocks: patches give one for each file, plans a written file, other calls a shell command."""
    b = T.blocks(entries(spark, sf_dir), ["session_id", "seq"])
    field = lambda k: T.get("b", f"$.input.{k}")
    return b.select("session_id", "seq", F.col("bpos").cast("long"), "btype", "btext", "name", "tool_id", "tool_use_id", "bare", field("file_path").alias("file_path"), field("command").alias("command"), field("content").alias("body"))


def user_messages(spark, sf_dir):
    return E.user_messages(E.visible(entries(spark, sf_dir))).select("session_id", "seq", "text", "word_count")


def typed_events(spark, sf_dir):
    e = events(spark, sf_dir)
    return e.select("session_id", "index", "ts_raw", F.unix_micros("ts").alias("us"), *[c for c in E.FIELDS if c != "prompt_hash"], F.col("prompt_hash"))


def session_states(spark, sf_dir):
    """Branch, pull request, commits and branch switches that results tell of."""
    s = E.extract(entries(spark, sf_dir))[1]
    return s.select("session_id", "detected_branch", "pr_number", F.array_join("event_git_shas", ",").alias("shas"), F.array_join("event_branches", ",").alias("branches"))


def condensed_sessions(spark, sf_dir):
    c = C.condensed(entries(spark, sf_dir))
    return c.select("session_id", "agent_type", "cwd", F.md5("condensed_text").alias("text_md5"), "token_estimate", "too_short", "facts.*")


def tool_turns(spark, sf_dir):
    """Tool calls, distinct tools and assistant turns of each session."""
    seen = E.visible(entries(spark, sf_dir))
    t = E.tools(seen).groupBy("session_id").agg(F.count("*").alias("tool_count"), F.count_distinct("name").alias("unique_tools"))
    return E.assistant_turns(seen).join(t, "session_id", "left")


def dispatch_metadata(spark, sf_dir):
    d = E.dispatch_metadata(events(spark, sf_dir))
    return d.withColumn("unique_subagent_ids", F.array_join("unique_subagent_ids", ","))


def event_signals(spark, sf_dir):
    """Counts, pass rate, test-first, recovery and retry of each session's typed events."""
    s = G.event_signals(events(spark, sf_dir))
    return s.select("session_id", "files_modified_count", "test_run_count", "error_count", "plan_file_count", "test_pass_rate", "tdd_discipline_ratio", "recovery_speed", "error_retry_ratio", "git_commit_count")


def closed_loops(spark, sf_dir):
    """Whether a dispatched id came back, and whether a commit follows the first return."""
    return ST.closed_loops(events(spark, sf_dir)).select("session_id", "dispatches", "returns", "matched", "committed")


def dispatch_stats(spark, sf_dir):
    """Dispatches and the share of sessions with a commit after a return, by whether a session is a rollout."""
    loops = ST.closed_loops(events(spark, sf_dir)).withColumn("kind", F.left("session_id", F.lit(1)))
    return ST.dispatch_stats(loops, ["kind"])


def parallelism(spark, sf_dir):
    """Main sessions' dispatches and returns, and subagents; every second subagent has a parent."""
    e, found = entries(spark, sf_dir), events(spark, sf_dir)
    sub = E.visible(e).groupBy("session_id").agg(F.bool_or("is_subagent").alias("is_subagent"))
    s = sub.join(E.dispatch_metadata(found), "session_id", "left")
    number = F.substring("session_id", 2, 9).cast("long")
    s = s.withColumn("parent_session_id", F.when(F.col("is_subagent") & (number % 2 == 0), F.lit("parent")))
    return ST.parallelism(s, found)


def dispatch_windows(spark, sf_dir):
    """First dispatch and first return of each id, and the most that were open at once."""
    w = R.dispatch_windows(events(spark, sf_dir))
    return w.select("session_id", "tool_use_id", F.unix_micros("start").alias("start_us"), F.unix_micros("end").alias("end_us"))


def decision_candidates(spark, sf_dir):
    """Proposals with the directive that answers them, then long directives that answer none."""
    c = D.candidates(events(spark, sf_dir))
    return c.select("session_id", "source", "position", "event_index", "response_index", "user_text", "proposal_type", "option_count", "near_amplified")


def pattern_decisions(spark, sf_dir):
    """Decisions from patterns alone: kind, words, domain, significance, reversibility."""
    d = D.by_patterns(D.candidates(events(spark, sf_dir)))
    return d.select("session_id", "event_index", "proposal_type", "response_word_count", "domain", "significance", "reversibility", "agent_recognized", "response_text", F.col("option_count"))


def decision_outcomes(spark, sf_dir):
    """Outcomes of pattern decisions from the events up to the next proposal."""
    e = events(spark, sf_dir)
    d = D.outcomes(D.by_patterns(D.candidates(e)), e)
    return d.select("session_id", "event_index", "outcome.signal", "outcome.confidence", "outcome.evidence")


def session_records(spark, sf_dir):
    """The session record: times, branch, prompts, counts, plan versions and active windows."""
    s = E.sessions(entries(spark, sf_dir))
    sig = "session_signals"
    return s.select(
        "session_id", "session_created_at", "session_modified_at", "git_branch", "is_subagent", "first_prompt", "dispatch_count", "return_count", f"{sig}.user_message_count", f"{sig}.total_user_words",
        f"{sig}.tool_count", f"{sig}.assistant_count", f"{sig}.test_run_count", f"{sig}.courtesy_messages", f"{sig}.kill_decisions", F.size("active_time_windows").cast("long").alias("n_windows"),
        F.coalesce(F.size("plan_files"), F.lit(0)).cast("long").alias("plan_versions"), F.array_max(F.transform("plan_files", lambda p: p.version)).alias("last_version"),
        F.exists("plan_files", lambda p: ~p.has_verification).alias("unverified"),
    )


_K = "CAST(json_extract_string(props, '$.k') AS BIGINT)"
#: One row a line: session, place, kind, k and whether other operators see it.
_LINES = rf"""l AS (
  SELECT user_id AS u, i AS seq, k, CASE WHEN user_id % 3 = 0 AND i = 0 THEN 99 ELSE v END AS v, user_id % 3 = 0 AS r, user_id % 7 = 0 AS sub, strftime(ts, '%Y-%m-%dT%H:%M:%S.%fZ') AS t, epoch_us(ts) AS us,
         CASE WHEN user_id % 3 = 0 THEN 's' ELSE 'u' END || user_id AS sid
  FROM (SELECT *, {_K} AS k, event_id % 16 AS v, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i FROM events)),
e AS (
  SELECT *, v = 14 AND NOT r AS side, CASE WHEN r THEN CASE WHEN v IN (0, 6) THEN 'user' ELSE 'assistant' END ELSE CASE WHEN v IN (0, 1, 2, 3, 8, 15) THEN 'user' ELSE 'assistant' END END AS role
  FROM l WHERE CASE WHEN r THEN v IN (0, 2, 3, 4, 6, 8, 9, 11, 12, 13) ELSE v NOT IN (12, 13) END),
seen AS (SELECT * FROM e WHERE NOT side OR sub)"""
_PLAN_TEXT = "'why' || chr(10) || '- [done] one ' || k || chr(10) || '- [pending] two'"
#: One row a content block.
_BLOCKS = f"""b AS (
  SELECT x.*, p.bpos, p.btype, p.btext, p.name, p.tool_id, p.use_id, p.bare, p.path, p.command, p.body FROM e x, LATERAL (VALUES
    (0, NOT r AND v = 0, 'text', 'please fix item ' || k || ', thanks', NULL, NULL, NULL, FALSE, NULL, NULL, NULL), (0, NOT r AND v = 15, 'text', 'drop table ' || k || ' and then write all of the rows back one by one so that the order stays the same as before', NULL, NULL, NULL, FALSE, NULL, NULL, NULL),
    (0, NOT r AND v = 1, 'text', 'bare', NULL, NULL, NULL, TRUE, NULL, NULL, NULL), (1, NOT r AND v = 1, 'text', '<system-reminder>x</system-reminder>', NULL, NULL, NULL, FALSE, NULL, NULL, NULL),
    (2, NOT r AND v = 1, 'text', 'go with option A' || k || ' and stop', NULL, NULL, NULL, FALSE, NULL, NULL, NULL),
    (0, NOT r AND v = 2, 'tool_result', NULL, NULL, NULL, 't' || k % 10, FALSE, NULL, NULL, NULL), (0, NOT r AND v = 3, 'tool_result', NULL, NULL, NULL, 'p' || k % 5, FALSE, NULL, NULL, NULL), (0, NOT r AND v = 8, 'tool_result', NULL, NULL, NULL, 'b', FALSE, NULL, NULL, NULL),
    (0, NOT r AND v = 4, 'text', 'Would you like option A or option B? ' || k, NULL, NULL, NULL, FALSE, NULL, NULL, NULL),
    (0, NOT r AND v = 5, 'thinking', NULL, NULL, NULL, NULL, FALSE, NULL, NULL, NULL), (1, NOT r AND v = 5, 'tool_use', NULL, 'Edit', 'e' || k, NULL, FALSE, 'src/f' || k || '.py', NULL, NULL),
    (0, NOT r AND v = 6, 'tool_use', NULL, 'Write', 'w' || k, NULL, FALSE, 'docs/PLAN.md', NULL, '- [ ] verify ' || k), (0, NOT r AND v = 7, 'tool_use', NULL, 'Bash', 'c' || k, NULL, FALSE, NULL, 'git commit -m "fix: ' || k || '"', NULL),
    (0, NOT r AND v = 9, 'tool_use', NULL, 'Bash', 'g' || k, NULL, FALSE, NULL, 'git checkout -b br' || k % 3 || ' && git push', NULL), (0, NOT r AND v = 10, 'tool_use', NULL, 'Task', 't' || k % 10, NULL, FALSE, NULL, NULL, NULL),
    (0, NOT r AND v = 11, 'tool_use', NULL, 'Bash', 'p' || k % 5, NULL, FALSE, NULL, 'gh pr create --fill', NULL), (0, NOT r AND v = 14, 'tool_use', NULL, 'Bash', 'l' || k, NULL, FALSE, NULL, 'ls ' || k % 4, NULL),
    (0, r AND v = 0, 'text', 'build ' || k || ' things', NULL, NULL, NULL, FALSE, NULL, NULL, NULL), (0, r AND v = 2, 'tool_use', NULL, 'Bash', NULL, NULL, FALSE, NULL, '["ls", "-l", "f' || k || '"]', NULL),
    (0, r AND v = 3, 'tool_use', NULL, 'Write', NULL, NULL, FALSE, 'n' || k || '.py', NULL, NULL), (1, r AND v = 3, 'tool_use', NULL, 'Edit', NULL, NULL, FALSE, 'o' || k || '.py', NULL, NULL),
    (0, r AND v = 4, 'tool_use', NULL, 'Write', NULL, NULL, FALSE, 'CODEX_PLAN.md', NULL, {_PLAN_TEXT}), (0, r AND v = 6, 'tool_result', NULL, NULL, NULL, NULL, FALSE, NULL, NULL, NULL), (0, r AND v = 8, 'thinking', NULL, NULL, NULL, NULL, FALSE, NULL, NULL, NULL),
    (0, r AND v = 9, 'text', 'done ' || k, NULL, NULL, NULL, FALSE, NULL, NULL, NULL), (0, r AND v = 11, 'tool_use', NULL, 'Edit', NULL, NULL, FALSE, 'c' || k || '.py', NULL, NULL),
    (0, r AND v = 12, 'text', 'I will do ' || k, NULL, NULL, NULL, FALSE, NULL, NULL, NULL), (0, r AND v = 13, 'text', 'bare ' || k, NULL, NULL, NULL, FALSE, NULL, NULL, NULL)
  ) AS p(bpos, fits, btype, btext, name, tool_id, use_id, bare, path, command, body) WHERE p.fits)"""
_MESSAGE = "CASE WHEN r THEN 'build ' || k || ' things' WHEN v = 0 THEN 'please fix item ' || k || ', thanks' WHEN v = 1 THEN 'go with option A' || k || ' and stop' ELSE 'drop table ' || k || ' and then write all of the rows back one by one so that the order stays the same as before' END"
_SAID = "SELECT * FROM seen WHERE CASE WHEN r THEN v = 0 ELSE v IN (0, 1, 15) END"
_RETURNED = "CASE v WHEN 2 THEN length(k || ' passed, ' || k % 4 || ' failed TypeError: bad ' || k) ELSE length('see https://github.com/o/r/pull/' || k || ' done') END"
#: Typed events. A result answers the last commit before it; a return needs a dispatch of its id before it.
_EVENTS = f"""answers AS (
  SELECT *, min(CASE WHEN NOT r AND v IN (2, 3, 8) OR r AND v = 6 THEN seq END) OVER (PARTITION BY sid ORDER BY seq ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS to_seq FROM seen),
last_commits AS (SELECT sid, to_seq, max(seq) AS seq FROM answers WHERE NOT r AND v = 7 GROUP BY ALL),
shas AS (
  SELECT c.sid, c.seq, 'a1b2c' || lpad(CAST(a.k AS VARCHAR), 2, '0') AS sha FROM last_commits c JOIN seen a ON a.sid = c.sid AND a.seq = c.to_seq AND a.v = 8 AND NOT a.r),
raw_ev AS (
  SELECT x.*, p.place, p.type, p.path, p.command, p.text, p.message, p.branch, p.tool_use_id, p.passed, p.failed, p.framework FROM seen x, LATERAL (VALUES
    (900, CASE WHEN r THEN v = 0 ELSE v IN (0, 1, 15) END, 'user_directive', NULL, NULL, {_MESSAGE}, NULL, NULL, NULL, NULL, NULL, NULL),
    (1, NOT r AND v = 2, 'subagent_return', NULL, NULL, NULL, NULL, NULL, 't' || k % 10, NULL, NULL, NULL), (2, NOT r AND v = 2, 'test_run', NULL, NULL, NULL, NULL, NULL, NULL, k, k % 4, 'pytest'),
    (3, NOT r AND v = 2, 'error_encountered', NULL, NULL, NULL, k || ' passed, ' || k % 4 || ' failed', NULL, NULL, NULL, NULL, NULL), (1, NOT r AND v = 3, 'subagent_return', NULL, NULL, NULL, NULL, NULL, 'p' || k % 5, NULL, NULL, NULL),
    (1, NOT r AND v = 4, 'agent_proposal', NULL, NULL, 'Would you like option A or option B? ' || k, NULL, NULL, NULL, NULL, NULL, NULL), (1, NOT r AND v = 5, 'agent_thinking', NULL, NULL, 'a key insight ' || k, NULL, NULL, NULL, NULL, NULL, NULL),
    (11, NOT r AND v = 5, 'file_edit', 'src/f' || k || '.py', NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL), (1, NOT r AND v = 6, 'file_create', 'docs/PLAN.md', NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL),
    (1, NOT r AND v = 7, 'git_commit', NULL, NULL, NULL, 'fix: ' || k, NULL, NULL, NULL, NULL, NULL), (1, NOT r AND v = 9, 'git_branch_switch', NULL, NULL, NULL, NULL, 'br' || k % 3, NULL, NULL, NULL, NULL), (2, NOT r AND v = 9, 'git_push', NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL),
    (1, NOT r AND v = 10, 'subagent_dispatch', NULL, NULL, NULL, NULL, NULL, 't' || k % 10, NULL, NULL, NULL), (1, NOT r AND v = 11, 'bash_command', NULL, 'gh pr create --fill', NULL, NULL, NULL, NULL, NULL, NULL, NULL),
    (1, NOT r AND v = 14, 'bash_command', NULL, 'ls ' || k % 4, NULL, NULL, NULL, NULL, NULL, NULL, NULL), (1, r AND v = 2, 'bash_command', NULL, '["ls", "-l", "f' || k || '"]', NULL, NULL, NULL, NULL, NULL, NULL, NULL),
    (1, r AND v = 3, 'file_create', 'n' || k || '.py', NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL), (11, r AND v = 3, 'file_edit', 'o' || k || '.py', NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL), (1, r AND v = 4, 'file_create', 'CODEX_PLAN.md', NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL),
    (1, r AND v = 6, 'test_run', NULL, NULL, NULL, NULL, NULL, NULL, k - k % 4, k % 4, 'rspec'), (1, r AND v = 8, 'agent_thinking', NULL, NULL, 'thinking ' || k, NULL, NULL, NULL, NULL, NULL, NULL), (1, r AND v = 11, 'file_edit', 'c' || k || '.py', NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL)
  ) AS p(place, fits, type, path, command, text, message, branch, tool_use_id, passed, failed, framework) WHERE p.fits),
ev AS (
  SELECT z.*, s.sha, row_number() OVER (PARTITION BY z.sid ORDER BY z.seq, place) - 1 AS idx
  FROM (SELECT *, min(CASE WHEN type = 'subagent_dispatch' THEN seq END) OVER (PARTITION BY sid, tool_use_id) AS sent FROM raw_ev) z LEFT JOIN shas s ON s.sid = z.sid AND s.seq = z.seq AND type = 'git_commit'
  WHERE type <> 'subagent_return' OR sent < z.seq)"""
_PAIRED = f"""{_EVENTS},
pp AS (SELECT *, lead(type, 1) OVER w AS k1, lead(type, 2) OVER w AS k2, lead(type, 3) OVER w AS k3, lead(idx, 1) OVER w AS i1, lead(idx, 2) OVER w AS i2, lead(idx, 3) OVER w AS i3,
  coalesce(bool_or(type = 'agent_thinking' AND NOT r) OVER (PARTITION BY sid ORDER BY idx ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING), FALSE) AS amp FROM ev WINDOW w AS (PARTITION BY sid ORDER BY idx)),
pr AS (SELECT *, CASE WHEN k1 = 'agent_proposal' THEN NULL WHEN k1 = 'user_directive' THEN i1 WHEN k2 = 'agent_proposal' THEN NULL WHEN k2 = 'user_directive' THEN i2 WHEN k3 = 'agent_proposal' THEN NULL WHEN k3 = 'user_directive' THEN i3 END AS reply
  FROM pp WHERE type = 'agent_proposal'),
cand AS (SELECT pr.sid, pr.idx AS event_index, pr.reply AS response_index, d.text AS user_text, pr.text AS agent_text, d.amp, row_number() OVER (PARTITION BY pr.sid ORDER BY pr.idx) - 1 AS position FROM pr JOIN pp d ON d.sid = pr.sid AND d.idx = pr.reply)"""
_LEN = "CAST(ceil(length(t) / 4) AS BIGINT)"
_BASH = "'Bash(command=' || {} || ', description=)'"
#: A result's size as JSON with spaces after separators.
_DUMP = "CASE WHEN r THEN length(k || ' examples, ' || k % 4 || ' failures') + 2 WHEN v = 2 THEN length(k || ' passed, ' || k % 4 || ' failed') + length('TypeError: bad ' || k) + 4 WHEN v = 8 THEN length('[topic/b0 a1b2c00] fix') + 2 ELSE length('[{\"text\": \"see https://github.com/o/r/pull/' || k || '\", \"type\": \"text\"}, {\"text\": \"done\", \"type\": \"text\"}]') END"
_LINE = f"""CASE WHEN btype = 'text' THEN CASE role WHEN 'user' THEN 'USER: ' ELSE 'ASSISTANT: ' END || btext WHEN btype = 'tool_result' THEN '[ToolResult: ' || {_DUMP} || ' bytes]'
 WHEN name = 'Bash' THEN 'TOOL_USE: ' || {_BASH.format("command")} WHEN name = 'Write' THEN 'TOOL_USE: Write(file_path=' || path || ', content=[' || strlen(coalesce(body, '')) || ' bytes])'
 WHEN name = 'Edit' THEN 'TOOL_USE: Edit(file_path=' || path || ', old_string=[' || CASE WHEN r THEN 0 ELSE 1 END || ' bytes], new_string=[' || CASE WHEN r THEN 0 ELSE 2 END || ' bytes])'
 WHEN name = 'Task' THEN 'TOOL_USE: Task(description=look ' || k || ', subagent_type=scout, prompt=[' || strlen('go ' || k) || ' bytes, sha=' || left(sha256('go ' || k), 12) || '])' END"""
_WORDS = "len(string_split(user_text, ' '))"
#: Reply words "item", "fix", "option" and so on, as the domain and reversal rules see them beside the proposal.
_OUT = f"""{_PAIRED},
stops AS (SELECT sid, idx, min(CASE WHEN type = 'agent_proposal' THEN idx END) OVER (PARTITION BY sid ORDER BY idx ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS stop, max(idx) OVER (PARTITION BY sid) AS last FROM ev),
out_s AS (SELECT c.sid, c.event_index, count(*) FILTER (type = 'test_run') AS t, count(*) FILTER (type = 'error_encountered') AS e, count(*) FILTER (type = 'git_commit') AS c,
  CAST(coalesce(sum(passed) FILTER (type = 'test_run'), 0) AS BIGINT) AS p, CAST(coalesce(sum(failed) FILTER (type = 'test_run'), 0) AS BIGINT) AS f, arg_max(passed, ev.idx) FILTER (type = 'test_run') AS lp, arg_max(failed, ev.idx) FILTER (type = 'test_run') AS lf
  FROM cand c JOIN stops s ON s.sid = c.sid AND s.idx = c.event_index AND c.event_index < s.last LEFT JOIN ev ON ev.sid = c.sid AND ev.idx > c.event_index AND (s.stop IS NULL OR ev.idx < s.stop) GROUP BY ALL)"""

ORACLE_SQL = {
    "transcript_formats": f"WITH {_LINES} SELECT CASE WHEN sub THEN '/logs/subagents/' ELSE '/logs/' END || CASE WHEN r THEN 'r' ELSE 'u' END || u || '.jsonl' AS path, r AS rollout FROM l WHERE seq = 0",
    "transcript_rejects": f"WITH {_LINES} SELECT CASE WHEN sub THEN '/logs/subagents/' ELSE '/logs/' END || CASE WHEN r THEN 'r' ELSE 'u' END || u || '.jsonl' AS path, seq, CASE WHEN v = 13 THEN 'not an object' ELSE 'unparsable' END AS reason FROM l WHERE NOT r AND v IN (12, 13) OR r AND v = 15",
    "transcript_entries": f"""WITH {_LINES} SELECT sid AS session_id, seq, r AS rollout, role AS etype, role, TRUE AS has_message, side AS is_sidechain, CASE WHEN NOT r AND v = 0 THEN 'main' END AS git_branch, CASE WHEN r THEN '/b' || u ELSE '/w' END AS cwd,
 CASE WHEN r THEN 'dev' END AS meta_branch, CASE WHEN NOT r AND role = 'assistant' THEN 'm' || k % 5 END AS msg_id, CASE WHEN NOT r AND role = 'assistant' THEN 'big-' || k % 3 END AS model, t AS ts_raw, CASE WHEN NOT r AND role = 'assistant' THEN k END AS input_tokens,
 CASE WHEN r THEN CASE v WHEN 0 THEN 'build ' || k || ' things' WHEN 9 THEN 'done ' || k WHEN 12 THEN 'I will do ' || k WHEN 13 THEN 'bare ' || k END WHEN v = 0 THEN 'please fix item ' || k || ', thanks' WHEN v = 15 THEN 'drop table ' || k || ' and then write all of the rows back one by one so that the order stays the same as before' END AS text,
 CAST(CASE WHEN r THEN CASE WHEN v = 3 THEN 2 WHEN v NOT IN (0, 9, 12, 13) THEN 1 END WHEN v = 1 THEN 3 WHEN v = 5 THEN 2 WHEN v NOT IN (0, 15) THEN 1 END AS BIGINT) AS n_parts FROM e""",
    "transcript_blocks": f"WITH {_LINES}, {_BLOCKS} SELECT sid AS session_id, seq, CAST(bpos AS BIGINT) AS bpos, btype, btext, name, tool_id, use_id AS tool_use_id, bare, path AS file_path, command, body FROM b",
    "user_messages": f"WITH {_LINES} SELECT sid AS session_id, seq, text, len(string_split(text, ' ')) AS word_count FROM (SELECT *, {_MESSAGE} AS text FROM ({_SAID}))",
    "typed_events": f"""WITH {_LINES}, {_EVENTS} SELECT sid AS session_id, idx AS "index", t AS ts_raw, us, type, path, command, text, message, sha, branch, tool_use_id, CASE WHEN type = 'subagent_dispatch' THEN 'scout' END AS subagent_id,
 CASE WHEN type = 'subagent_dispatch' THEN 'look ' || k END AS description, CASE WHEN type = 'subagent_dispatch' THEN TRUE END AS run_in_background, CAST(CASE WHEN type = 'subagent_return' THEN {_RETURNED} END AS BIGINT) AS return_text_length,
 CASE WHEN type = 'subagent_return' THEN TRUE END AS indicates_error, framework, passed, failed, CASE WHEN framework = 'rspec' THEN 0 END AS pending, CASE WHEN type = 'agent_proposal' THEN 'options' END AS proposal_type,
 CASE WHEN type = 'agent_proposal' THEN 2 END AS option_count, CASE WHEN type = 'subagent_dispatch' THEN left(sha1('go ' || k), 12) END AS prompt_hash FROM ev""",
    "session_states": f"""WITH {_LINES}, {_EVENTS},
asks AS (SELECT *, last_value(CASE WHEN v = 11 THEN seq END IGNORE NULLS) OVER w AS ask, last_value(CASE WHEN v = 11 THEN k % 5 END IGNORE NULLS) OVER w AS ask_id FROM seen WHERE NOT r WINDOW w AS (PARTITION BY sid ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
prs AS (SELECT sid, arg_max(k, seq) AS pr FROM (SELECT sid, ask, min(seq) AS seq, arg_min(k, seq) AS k FROM asks WHERE v = 3 AND ask_id = k % 5 GROUP BY sid, ask) GROUP BY sid)
SELECT s.sid AS session_id, d.b AS detected_branch, p.pr AS pr_number, g.shas, g.branches FROM (SELECT DISTINCT sid FROM seen) s
LEFT JOIN (SELECT sid, arg_max(CASE v WHEN 9 THEN 'br' || k % 3 ELSE 'topic/b' || k % 3 END, seq) AS b FROM seen WHERE NOT r AND v IN (8, 9) GROUP BY sid) d USING (sid) LEFT JOIN prs p USING (sid)
LEFT JOIN (SELECT sid, coalesce(string_agg(sha, ',' ORDER BY idx), '') AS shas, coalesce(string_agg(branch, ',' ORDER BY idx), '') AS branches FROM ev WHERE type IN ('git_commit', 'git_branch_switch') GROUP BY sid) g USING (sid)""",
    "condensed_sessions": f"""WITH {_LINES}, {_BLOCKS}, c AS (SELECT sid, string_agg({_LINE}, chr(10) ORDER BY seq, bpos) AS t, count(*) FILTER (btype = 'tool_use') AS tool_uses, count(*) FILTER (btype = 'tool_result') AS tool_results, count(*) FILTER (name = 'Task') AS subagent_dispatches,
  count(*) FILTER (name IN ('Write', 'Edit') AND path <> 'CODEX_PLAN.md') AS code_edits, count(*) FILTER (contains(command, 'git commit')) AS git_commits, arg_min(btext, seq * 10 + bpos) FILTER (role = 'user' AND btype = 'text') AS first_prompt FROM b GROUP BY sid)
SELECT sid AS session_id, CASE WHEN m.r THEN 'codex_cli' ELSE 'claude_code' END AS agent_type, m.cwd, md5(t) AS text_md5, {_LEN} AS token_estimate, {_LEN} < 200 AS too_short, user_messages, assistant_messages, tool_uses, tool_results, subagent_dispatches, code_edits, git_commits, first_prompt
FROM c JOIN (SELECT sid, any_value(r) AS r, any_value(CASE WHEN r THEN '/b' || u ELSE '/w' END) AS cwd, count(*) FILTER (role = 'user') AS user_messages, count(*) FILTER (role = 'assistant') AS assistant_messages FROM e GROUP BY sid) m USING (sid)""",
    "tool_turns": f"""WITH {_LINES}, {_BLOCKS} SELECT sid AS session_id, assistant_count, tool_count, unique_tools FROM (SELECT sid, count(DISTINCT seq) FILTER (btype IN ('tool_use', 'text')) AS assistant_count FROM b WHERE role = 'assistant' AND (NOT side OR sub) GROUP BY sid)
LEFT JOIN (SELECT sid, count(*) AS tool_count, count(DISTINCT name) AS unique_tools FROM b WHERE btype = 'tool_use' AND (NOT side OR sub) GROUP BY sid) USING (sid)""",
    "dispatch_metadata": f"WITH {_LINES}, {_EVENTS} SELECT sid AS session_id, count(*) FILTER (type = 'subagent_dispatch') AS dispatch_count, count(*) FILTER (type = 'subagent_return') AS return_count, count(*) FILTER (type = 'subagent_dispatch') AS run_in_background_count, CASE WHEN bool_or(type = 'subagent_dispatch') THEN 'scout' ELSE '' END AS unique_subagent_ids FROM ev GROUP BY sid",
    "event_signals": f"""WITH {_LINES}, {_EVENTS},
n AS (SELECT *, first_value(CASE WHEN type = 'test_run' AND passed > 0 OR type = 'git_commit' THEN idx END IGNORE NULLS) OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS nxt,
  last_value(CASE WHEN type = 'bash_command' THEN command END IGNORE NULLS) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS cmd, list(CASE WHEN type = 'bash_command' THEN command END) OVER (w ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING) AS soon FROM ev WINDOW w AS (PARTITION BY sid ORDER BY idx)),
g AS (SELECT sid, count(*) FILTER (type IN ('file_edit', 'file_create')) AS files_modified_count, count(*) FILTER (type = 'test_run') AS test_run_count, count(*) FILTER (type = 'error_encountered') AS error_count, count(*) FILTER (type = 'file_create' AND path LIKE '%PLAN.md') AS plans,
  sum(passed) AS p, sum(failed) AS f, min(idx) FILTER (type = 'test_run') AS ft, min(idx) FILTER (type IN ('file_edit', 'file_create') AND path NOT LIKE '%PLAN.md') AS fe, median(nxt - idx) FILTER (type = 'error_encountered') AS rec,
  count(*) FILTER (type = 'error_encountered' AND coalesce(list_contains(soon, cmd), FALSE)) AS again, count(*) FILTER (type = 'git_commit') AS git_commit_count FROM n GROUP BY sid)
SELECT sid AS session_id, files_modified_count, test_run_count, error_count, CASE WHEN plans > 0 THEN plans END AS plan_file_count, CASE WHEN p + f > 0 THEN round(p / (p + f), 3) END AS test_pass_rate,
 CAST(CASE WHEN ft IS NOT NULL OR fe IS NOT NULL THEN CASE WHEN ft IS NOT NULL AND (fe IS NULL OR ft < fe) THEN 1 ELSE 0 END END AS DOUBLE) AS tdd_discipline_ratio, round(rec, 1) AS recovery_speed, CASE WHEN error_count > 0 THEN round(again / error_count, 3) END AS error_retry_ratio, git_commit_count FROM g""",
    "closed_loops": f"WITH {_LINES}, {_EVENTS} SELECT sid AS session_id, count(*) FILTER (type = 'subagent_dispatch') AS dispatches, count(*) FILTER (type = 'subagent_return') AS returns, count(*) FILTER (type = 'subagent_return') > 0 AS matched, coalesce(min(idx) FILTER (type = 'subagent_return') < max(idx) FILTER (type = 'git_commit'), FALSE) AS committed FROM ev GROUP BY sid",
    "dispatch_stats": f"WITH {_LINES}, {_EVENTS} SELECT left(sid, 1) AS kind, CAST(sum(d) AS BIGINT) AS dispatch_count, avg(CAST(c AS INT)) AS committed_return_ratio FROM (SELECT sid, count(*) FILTER (type = 'subagent_dispatch') AS d, coalesce(min(idx) FILTER (type = 'subagent_return') < max(idx) FILTER (type = 'git_commit'), FALSE) AS c FROM ev GROUP BY sid) WHERE d > 0 GROUP BY 1",
    "parallelism": f"""WITH {_LINES}, {_EVENTS}, s AS (SELECT sid, any_value(u) AS u, bool_or(sub) OR bool_and(side) AS sub FROM seen GROUP BY sid),
g AS (SELECT sid, count(*) FILTER (type = 'subagent_dispatch') AS d, count(*) FILTER (type = 'subagent_return') AS n, coalesce(min(idx) FILTER (type = 'subagent_return') < max(idx) FILTER (type = 'git_commit'), FALSE) AS c FROM ev GROUP BY sid)
SELECT CAST(coalesce(sum(d) FILTER (NOT sub), 0) AS BIGINT) AS dispatch_count, CAST(coalesce(sum(n) FILTER (NOT sub), 0) AS BIGINT) AS return_count, count(*) FILTER (NOT sub AND d > 0 AND n > 0 AND c) AS dispatch_with_committed_return_count, count(*) FILTER (sub) AS subagent_count,
 count(*) FILTER (sub AND u % 2 <> 0) AS orphan_subagent_count, CAST(NULL AS BIGINT) AS concurrent_pairs_with_ships_count, CAST(NULL AS BIGINT) AS review_separation_count FROM s LEFT JOIN g USING (sid)""",
    "dispatch_windows": f"""WITH {_LINES}, {_EVENTS} SELECT d.sid AS session_id, d.tool_use_id, d.us AS start_us, n.us AS end_us FROM (SELECT sid, tool_use_id, arg_min(us, idx) AS us FROM ev WHERE type = 'subagent_dispatch' GROUP BY ALL) d
JOIN (SELECT sid, tool_use_id, arg_min(us, idx) AS us FROM ev WHERE type = 'subagent_return' GROUP BY ALL) n ON n.sid = d.sid AND n.tool_use_id = d.tool_use_id AND n.us >= d.us""",
    "decision_candidates": f"""WITH {_LINES}, {_PAIRED} SELECT session_id, source, row_number() OVER (PARTITION BY session_id ORDER BY source, event_index) - 1 AS position, event_index, response_index, user_text, proposal_type, option_count, near_amplified FROM (
 SELECT sid AS session_id, 'paired' AS source, event_index, response_index, user_text, 'options' AS proposal_type, 2 AS option_count, amp AS near_amplified FROM cand
 UNION ALL SELECT sid, 'unpaired', idx, idx, text, NULL, NULL, amp FROM pp WHERE type = 'user_directive' AND NOT r AND v = 15 AND NOT EXISTS (SELECT 1 FROM cand c WHERE c.sid = pp.sid AND c.response_index = pp.idx))""",
    "pattern_decisions": f"""WITH {_LINES}, {_PAIRED} SELECT sid AS session_id, event_index, CASE WHEN starts_with(user_text, 'go') THEN 'options' ELSE 'counter_proposal' END AS proposal_type, {_WORDS} AS response_word_count, CASE WHEN contains(user_text, 'fix') THEN 'debugging' ELSE 'general' END AS domain,
 CASE WHEN amp OR NOT starts_with(user_text, 'go') THEN 'strategic' ELSE 'moderate' END AS significance, 'unknown' AS reversibility, amp AS agent_recognized, user_text AS response_text, 2 AS option_count FROM cand""",
    "decision_outcomes": f"""WITH {_LINES}, {_OUT} SELECT c.sid AS session_id, c.event_index, CASE WHEN o.t IS NULL THEN NULL WHEN lf = 0 AND lp > 0 THEN 'positive' WHEN lf > 0 THEN 'negative' WHEN c > 0 AND f = 0 THEN 'positive' WHEN e > 0 THEN 'mixed' ELSE 'neutral' END AS signal,
 CASE CAST(t AS INT) + CAST(e > 0 AS INT) + CAST(c > 0 AS INT) WHEN 0 THEN CAST(0.3 AS DOUBLE) WHEN 1 THEN CAST(0.5 AS DOUBLE) WHEN 2 THEN CAST(0.7 AS DOUBLE) ELSE CASE WHEN t IS NOT NULL THEN CAST(0.9 AS DOUBLE) END END AS confidence,
 CASE WHEN t IS NOT NULL THEN coalesce(nullif(concat_ws('. ', CASE WHEN t > 0 THEN t || ' test run(s): ' || p || ' passed, ' || f || ' failed' END, CASE WHEN e > 0 THEN e || ' error(s) encountered' END, CASE WHEN c > 0 THEN c || ' commit(s) made' END), ''), 'No signal events after decision') END AS evidence
FROM cand c LEFT JOIN out_s o ON o.sid = c.sid AND o.event_index = c.event_index""",
    "session_records": f"""WITH {_LINES}, {_BLOCKS}, {_EVENTS},
m AS (SELECT sid, count(*) AS n, CAST(sum(len(string_split(x, ' '))) AS BIGINT) AS w, arg_min(x, seq) AS first, count(*) FILTER (contains(x, 'thanks')) AS courtesy, count(*) FILTER (contains(x, 'drop')) AS kills FROM (SELECT *, {_MESSAGE} AS x FROM ({_SAID})) GROUP BY sid),
w AS (SELECT sid, count(*) FILTER (new) AS n FROM (SELECT sid, coalesce(us - lag(us) OVER (PARTITION BY sid ORDER BY us) > 900000000, TRUE) AS new FROM seen) GROUP BY sid),
p AS (SELECT sid, count(*) AS n FROM b WHERE path IN ('docs/PLAN.md', 'CODEX_PLAN.md') AND (NOT side OR sub) GROUP BY sid),
tl AS (SELECT sid, count(*) FILTER (btype = 'tool_use') AS n, count(DISTINCT seq) FILTER (btype IN ('tool_use', 'text')) AS a FROM b WHERE role = 'assistant' AND (NOT side OR sub) GROUP BY sid),
g AS (SELECT sid, count(*) FILTER (type = 'subagent_dispatch') AS d, count(*) FILTER (type = 'subagent_return') AS rt, count(*) FILTER (type = 'test_run') AS tests FROM ev GROUP BY sid),
d AS (SELECT sid, arg_max(CASE v WHEN 9 THEN 'br' || k % 3 ELSE 'topic/b' || k % 3 END, seq) AS b FROM seen WHERE NOT r AND v IN (8, 9) GROUP BY sid)
SELECT s.sid AS session_id, created AS session_created_at, modified AS session_modified_at, CASE WHEN s.r THEN 'dev' WHEN main THEN 'main' ELSE d.b END AS git_branch, s.sub AS is_subagent, m.first AS first_prompt, g.d AS dispatch_count, g.rt AS return_count, m.n AS user_message_count, m.w AS total_user_words,
 CASE WHEN m.n IS NOT NULL THEN coalesce(tl.n, 0) END AS tool_count, CASE WHEN m.n IS NOT NULL THEN coalesce(tl.a, 0) END AS assistant_count, CASE WHEN m.n IS NOT NULL THEN g.tests END AS test_run_count, m.courtesy AS courtesy_messages, m.kills AS kill_decisions, w.n AS n_windows, coalesce(p.n, 0) AS plan_versions, p.n AS last_version, CASE WHEN p.n IS NOT NULL THEN s.r END AS unverified
FROM (SELECT sid, any_value(r) AS r, bool_or(sub) AS sub, arg_min(t, seq) AS created, arg_max(t, seq) AS modified, bool_or(NOT r AND v = 0) AS main FROM seen GROUP BY sid) s LEFT JOIN m USING (sid) LEFT JOIN w USING (sid) LEFT JOIN p USING (sid) LEFT JOIN tl USING (sid) LEFT JOIN g USING (sid) LEFT JOIN d USING (sid)""",
}
QUERIES = {name: globals()[name] for name in ORACLE_SQL}
