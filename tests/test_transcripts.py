"""Transcripts of both agents, from files to session records."""

import json

import pytest

from tracework.operators import condense, events
from tracework.sources import linefiles, transcripts


def line(kind, content, ts, **more):
    return {"type": kind, "timestamp": ts, "message": {"role": kind, "content": content, **more.pop("message", {})}, **more}


def use(name, tool_id, **inp):
    return {"type": "tool_use", "name": name, "id": tool_id, "input": inp}


def result(tool_id, content, **more):
    return {"type": "tool_result", "tool_use_id": tool_id, "content": content, **more}


A = [
    line("user", "please fix the login bug, thanks", "2026-02-01T09:00:00Z", gitBranch="main", cwd="/w"),
    line("assistant", [{"type": "thinking", "thinking": "hmm"}, use("Edit", "e1", file_path="src/a.py", old_string="x", new_string="y")], "2026-02-01T09:01:00Z", message={"id": "m1", "model": "big-1", "usage": {"input_tokens": 10, "output_tokens": 5}}),
    line("assistant", [use("Bash", "b1", command='git commit -m "fix: login"')], "2026-02-01T09:02:00Z", message={"id": "m1", "model": "big-1", "usage": {"input_tokens": 10, "output_tokens": 5}}),
    line("user", [result("b1", "  ")], "2026-02-01T09:02:01Z"),
    line("user", [result("b1", "[topic/x 1a2b3c4] fix: login")], "2026-02-01T09:02:04Z"),
    line("assistant", [use("Task", "t1", description="look", prompt="go", subagent_type="scout", run_in_background=True), use("Bash", "p1", command="gh pr create --fill"), use("Bash", "b2", command="pytest -q")], "2026-02-01T09:03:00Z"),
    line("user", [result("b2", "see https://github.com/o/r/pull/9\n3 passed, 1 failed\nTypeError: bad"), result("p1", "https://github.com/o/r/pull/12"), result("t1", [{"type": "text", "text": "found"}, {"type": "text", "text": "it"}]), result("zz", "orphan")], "2026-02-01T09:30:00Z"),
    line("assistant", "Would you like option A or option B?", "2026-02-01T09:31:00Z"),
    line("user", ["bare", {"type": "text", "text": "<system-reminder>x</system-reminder>"}, {"type": "text", "text": "go with option A"}], "2026-02-01T09:32:00Z"),
    line("assistant", [use("Write", "w1", file_path="docs/PLAN.md", content="- [ ] verify it"), use("Bash", "b3", command="git checkout -b topic/y && git push")], "2026-02-01T12:00:00Z"),
    line("assistant", [use("Bash", "s1", command="rm x")], "2026-02-01T12:01:00Z", isSidechain=True),
]
B = [
    {"timestamp": "2026-03-01T10:00:00Z", "type": "session_meta", "payload": {"id": "sess-b", "cwd": "/b", "git": {"branch": "dev"}}},
    {"timestamp": "2026-03-01T10:00:01Z", "type": "event_msg", "payload": {"type": "user_message", "message": "<environment_context> stuff"}},
    {"timestamp": "2026-03-01T10:00:02Z", "type": "event_msg", "payload": {"type": "user_message", "message": "build the thing"}},
    {"timestamp": "2026-03-01T10:00:03Z", "type": "response_item", "payload": {"type": "function_call", "name": "shell", "arguments": json.dumps({"command": ["ls", "-l"]})}},
    {"timestamp": "2026-03-01T10:00:04Z", "type": "response_item", "payload": {"type": "function_call", "name": "shell", "arguments": json.dumps({"command": ["apply_patch", "*** Begin Patch\n*** Add File: n.py\n+x\n*** Update File: o.py\n*** End Patch"]})}},
    {"timestamp": "2026-03-01T10:00:05Z", "type": "response_item", "payload": {"type": "function_call", "name": "update_plan", "arguments": json.dumps({"plan": [{"step": "one", "status": "done"}, {"step": "two"}], "explanation": "why"})}},
    {"timestamp": "2026-03-01T10:00:06Z", "type": "response_item", "payload": {"type": "function_call", "name": "shell", "arguments": "[1]"}},
    {"timestamp": "2026-03-01T10:00:07Z", "type": "response_item", "payload": {"type": "function_call_output", "output": "2 examples, 1 failure"}},
    {"timestamp": "2026-03-01T10:00:08Z", "type": "response_item", "payload": {"type": "message", "role": "developer", "content": "hidden"}},
    {"timestamp": "2026-03-01T10:00:09Z", "type": "response_item", "payload": {"type": "reasoning", "summary": [{"type": "s", "text": "thinking hard"}]}},
    {"timestamp": "2026-03-01T10:00:10Z", "type": "response_item", "payload": {"type": "message", "role": "assistant", "content": [{"type": "text", "text": "done"}]}},
    {"timestamp": "2026-03-01T10:00:11Z", "type": "event_msg", "payload": {"type": "token_count"}},
]


@pytest.fixture(scope="module")
def found(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("logs")
    (d / "sub").mkdir()
    body = "\n".join(map(json.dumps, A)) + "\nnot json\n\n[1, 2]\n"
    (d / "one.jsonl").write_text(body)
    (d / "sub" / "two.jsonl").write_text("\n".join(map(json.dumps, B)))
    (d / "skip.txt").write_text("x")
    return transcripts.read_lines(spark, str(d))


@pytest.fixture(scope="module")
def entries(found):
    return transcripts.entries(found).cache()


def test_rejects(found):
    assert sorted(r.reason for r in transcripts.rejects(found).collect()) == ["not an object", "unparsable"]


def test_event_order_and_state(entries):
    e, states = events.extract(entries)
    got = [(r.type, r["index"]) for r in e.where("session_id = 'one'").orderBy("index").collect()]
    assert [t for t, _ in got] == [
        "user_directive", "agent_thinking", "file_edit", "git_commit", "subagent_dispatch", "bash_command", "bash_command", "test_run", "error_encountered", "subagent_return",
        "agent_proposal", "user_directive", "file_create", "git_branch_switch", "git_push",
    ]
    assert [i for _, i in got] == list(range(len(got)))
    rows = {r.type: r for r in e.where("session_id = 'one'").collect()}
    assert rows["git_commit"].sha == "1a2b3c4" and rows["git_commit"].message == "fix: login"
    assert (rows["test_run"].framework, rows["test_run"].passed, rows["test_run"].failed) == ("pytest", 3, 1)
    # the first line that matches; the count of failures does
    assert rows["error_encountered"].message == "3 passed, 1 failed"
    assert rows["subagent_return"].return_text_length == len("found it")
    assert rows["subagent_dispatch"].subagent_id == "scout" and rows["subagent_dispatch"].run_in_background
    assert (rows["agent_proposal"].proposal_type, rows["agent_proposal"].option_count) == ("options", 2)
    s = {r.session_id: r for r in states.collect()}["one"]
    assert (s.detected_branch, s.pr_number, s.event_git_shas, s.event_branches) == ("topic/y", 12, ["1a2b3c4"], ["topic/y"])


def test_rollout(entries):
    e, _ = events.extract(entries)
    got = [(r.type, r.path or r.command or r.text) for r in e.where("session_id = 'sess-b'").orderBy("index").collect()]
    assert got == [
        ("user_directive", "build the thing"), ("bash_command", '["ls", "-l"]'), ("file_create", "n.py"), ("file_edit", "o.py"), ("file_create", "CODEX_PLAN.md"), ("test_run", None), ("agent_thinking", "thinking hard"),
    ]


def test_session_record(entries):
    r = {x.session_id: x for x in events.sessions(entries).collect()}
    a, b = r["one"], r["sess-b"]
    assert a.git_branch == "main" and b.git_branch == "dev"
    assert [tuple(w) for w in a.active_time_windows] == [("2026-02-01T09:00:00Z", "2026-02-01T09:03:00Z"), ("2026-02-01T09:30:00Z", "2026-02-01T09:32:00Z"), ("2026-02-01T12:00:00Z", "2026-02-01T12:00:00Z")]
    assert a.first_prompt == "please fix the login bug, thanks"
    assert a.model_usage == {"big-1": 1, "unknown": 3} and a.token_usage["big-1"].input_tokens == 10
    assert [(p.filename, p.version, p.has_verification) for p in a.plan_files] == [("PLAN.md", 1, True)]
    s = a.session_signals
    assert (s.user_message_count, s.courtesy_messages, s.debugging_messages, s.imperative_prompts) == (2, 1, 1, 0)
    assert s.test_pass_rate == 0.75 and s.tdd_discipline_ratio == 0.0 and s.duration_minutes == 32.0 and s.plan_file_count == 1
    assert s.prompt_types == {"debugging": 1, "other": 1}
    assert (a.dispatch_count, a.return_count, a.unique_subagent_ids) == (1, 1, ["scout"])


def test_condensed(entries):
    r = {x.session_id: x for x in condense.condensed(entries).collect()}
    text = r["one"].condensed_text.split("\n")
    assert text[0] == "USER: please fix the login bug, thanks"
    assert "TOOL_USE: Edit(file_path=src/a.py, old_string=[1 bytes], new_string=[1 bytes])" in text
    assert any(t.startswith("TOOL_USE: Task(description=look, subagent_type=scout, prompt=[2 bytes, sha=") for t in text)
    assert "USER: bare" in text and text.count("[ToolResult: 4 bytes]") == 1
    f = r["one"].facts
    assert (f.git_commits, f.code_edits, f.subagent_dispatches, f.tool_results) == (1, 2, 1, 6)
    assert r["sess-b"].facts.code_edits == 2 and r["sess-b"].agent_type == "codex_cli" and r["sess-b"].cwd == "/b"


def test_lines_of_split_files(spark, tmp_path):
    """A file read in many splits keeps each line once, at its offset."""
    rows = [f"line {i} " + "x" * (i % 300) for i in range(20_000)]
    (tmp_path / "a.jsonl").write_text("\n".join(rows))
    (tmp_path / "b.jsonl").write_text("one\r\n\r\nthree")
    lines = transcripts.read_lines(spark, str(tmp_path), split=100_000)
    got = {(r.path[-7], r.seq): r.raw for r in lines.collect()}
    at, want = 0, {}
    for r in rows:
        want["a", at] = r
        at += len(r) + 1
    assert got == want | {("b", 0): "one", ("b", 7): "three"}


def test_many_logs_are_read_by_few_tasks(spark, tmp_path):
    rows = spark.range(400).selectExpr("concat('u', id, '.jsonl') AS path", """concat('{"type":"user","message":{"role":"user","content":"hi ', id, '"}}') AS value""")
    linefiles.write(rows, str(tmp_path))
    read = transcripts.read_lines(spark, str(tmp_path), split=50_000)
    assert read.rdd.getNumPartitions() == 2 and transcripts.entries(read).select("session_id").distinct().count() == 400
