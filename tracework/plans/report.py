"""The report: stats, cards, warnings and markdown, rendered on the driver from small frames."""

from __future__ import annotations

import re
import string
from collections.abc import Iterable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import times as TM
from ..operators import rollup as R
from ..operators import scans
from ..operators import sequence as S
from ..operators import steering
from ..operators.decisions import first_of

# Thresholds and names.
SHORT_WORDS, PEAK_HOURS, CAPS_LEAST = 8, 4, 0.6
LINK_NAMES = {"pr_match": "PR", "sha_match": "commit SHA", "branch_match": "branch", "timestamp_overlap": "time overlap", None: "session only, no commits"}


def peak_label(start: Column) -> Column:
    return first_of([((start >= 20) | (start < 5), "Night owl"), (start < 9, "Early bird")], "Daytime shipper")


def archetype(plan_ratio: Column, correction_rate: Column, max_parallel: Column, median_words: Column) -> Column:
    return first_of(
        [(plan_ratio >= 0.5, "The Architect"), (correction_rate >= 0.3, "The Director"), (max_parallel >= 4, "The Conductor"), (F.coalesce(median_words <= SHORT_WORDS, F.lit(False)), "The Minimalist")], "The Builder"
    )


def dispatch_windows(events: DataFrame) -> DataFrame:
    """(session_id, start, end): each dispatch with its first return, unreturned ones left out."""
    d = S.first_by(events.where("type = 'subagent_dispatch'"), ["session_id", "tool_use_id"], ["index"]).select("session_id", "tool_use_id", F.col("ts").alias("start"))
    r = S.first_by(events.where("type = 'subagent_return'"), ["session_id", "tool_use_id"], ["index"]).select("session_id", "tool_use_id", F.col("ts").alias("end"))
    return d.join(r, ["session_id", "tool_use_id"]).where("end >= start")


def go_to_prompt(sessions: DataFrame) -> DataFrame:
    """(norm, n, example) of the prompt repeated most over all sessions; interruption marks aren't prompts."""
    r = sessions.select("session_id", F.explode("session_signals.repeated_prompts").alias("p")).select("session_id", "p.*").where(~F.col("norm").startswith("request interrupted"))
    return r.groupBy("norm").agg(F.sum("count").alias("n"), F.min_by("example", "session_id").alias("example")).orderBy(F.desc("n"), "norm").limit(1)


def stats(sessions: DataFrame, events: DataFrame, commits: DataFrame, episodes: DataFrame) -> DataFrame:
    """One row of figures. ``commits``: sha, date (author-local text). Each input is aggregated to one row by itself."""
    sig = "session_signals"
    zero = lambda c: F.coalesce(F.sum(c), F.lit(0))
    s = sessions.agg(
        F.count("*").alias("n_sessions"), zero(f"{sig}.user_message_count").alias("prompts"), zero(F.try_element_at(F.col(f"{sig}.prompt_types"), F.lit("correction"))).alias("corrections"),
        zero(f"{sig}.courtesy_messages").alias("courtesy"), F.count_if(F.col(f"{sig}.courtesy_messages") > 0).alias("courtesy_sessions"), zero("prompt_stats.short_prompt_count").alias("short_prompts"),
        F.count_if(F.size("plan_files") > 0).alias("plan_sessions"), zero(f"{sig}.test_run_count").alias("test_runs"),
    )
    # the middle of the sessions' medians, the lower one of two
    words = scans.medians(sessions.select(F.col("prompt_stats.median_words").alias("m")), [], "m").agg(F.max("low").alias("median_words"))
    w = dispatch_windows(events)
    # the whole corpus is one stream
    peak = scans.peak(w, [], "start", "end")
    longest = w.agg(F.max(F.struct((F.unix_seconds("end") - F.unix_seconds("start")).alias("s"), (-F.unix_seconds("start")).alias("at"))).alias("longest"))
    loops = steering.closed_loops(events).agg(zero("dispatches").alias("dispatch_count"), F.count_if(F.col("dispatches") > 0).alias("dispatching_sessions"), F.count_if((F.col("dispatches") > 0) & F.col("committed")).alias("committed_after_return_sessions"))
    c = commits.select(F.lit(1).alias("all"), TM.wall_hour(F.col("date")).alias("hour"), TM.wall_weekday(F.col("date")).alias("day"))
    hours = S.busiest_hours(c, ["all"], "hour", PEAK_HOURS).select("start", F.col("n").alias("peak_window_count"), "peak_hour")
    day = S.most_common(c.where("day is not null"), ["all"], "day").select("day", F.col("n").alias("day_count"))
    e = episodes.agg(F.count("*").alias("n_episodes"), zero("added_lines").alias("added_lines"), zero("deleted_lines").alias("deleted_lines"))
    n = commits.agg(F.count("*").alias("commit_count"))
    quotes = sessions.select(F.explode("prompt_stats.caps_quotes").alias("q")).select("q.*").where(F.col("caps_ratio") >= CAPS_LEAST).orderBy(F.desc("caps_ratio"), "text").limit(1).select(F.struct("text", "caps_ratio").alias("crash"))
    models = sessions.select(F.explode("model_usage").alias("model", "m")).groupBy("model").agg(F.sum("m").alias("m"))
    top = models.orderBy(F.desc("m"), "model").limit(1).select(F.struct("model", "m").alias("top_model")).join(models.agg(F.sum("m").alias("model_messages")))
    goto = go_to_prompt(sessions).select(F.struct("example", "n").alias("goto"))
    out = s
    for part in (words, loops, e, n, longest, peak.select(F.col("peak").alias("max_parallel"))):
        out = out.join(part)
    for part in (hours, day, quotes, top, goto):
        out = out.join(part, how="left")
    rate = lambda a, b: F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b).cast("double")), F.lit(0.0))
    return out.withColumn("archetype", archetype(rate("plan_sessions", "n_sessions"), rate("corrections", "prompts"), F.col("max_parallel"), F.col("median_words")))


def _pct(a: float, b: float) -> int:
    return int(100.0 * a / b + 0.5) if b else 0


def duration(seconds: int) -> str:
    h, m, s = seconds // 3600, seconds % 3600 // 60, seconds % 60
    return f"{h}h {m:02d}m" if h else f"{m}m {s:02d}s" if m else f"{s}s"


def cards(st) -> list[dict[str, str]]:
    """Up to thirteen cards of a stats row; all but the first only above a floor."""
    made = []

    def card(key: str, shown: bool, headline, caption) -> None:
        if shown:
            made.append({"key": key, "headline": headline(), "caption": caption()})

    n, prompts, commits = st.n_sessions, st.prompts, st.commit_count
    why = {
        "The Architect": lambda: f"Plan files in {st.plan_sessions} of {n} sessions ({_pct(st.plan_sessions, n)}%).", "The Director": lambda: f"{st.corrections} of {prompts} prompts ({_pct(st.corrections, prompts)}%) changed course.",
        "The Conductor": lambda: f"As many as {st.max_parallel} subagents at once.", "The Minimalist": lambda: f"The median prompt has {st.median_words:g} words.", "The Builder": lambda: f"Steady output across {n} sessions.",
    }
    card("archetype", True, lambda: st.archetype, why[st.archetype])
    card("model", st.top_model is not None, lambda: st.top_model.model, lambda: f"{st.top_model.m:,} of {st.model_messages:,} assistant messages ({_pct(st.top_model.m, st.model_messages)}%).")
    a = st.start
    card("peak_hours", commits >= 5 and a is not None, lambda: "Night owl" if a >= 20 or a < 5 else "Early bird" if a < 9 else "Daytime shipper", lambda: f"{st.peak_window_count} of {commits} commits between {a:02d}:00 and {(a + PEAK_HOURS) % 24:02d}:00, most around {st.peak_hour:02d}:00.")
    card("planning_share", n >= 3, lambda: f"{_pct(st.plan_sessions, n)}% with a written plan", lambda: f"{st.plan_sessions} of {n} sessions.")
    card("goto_prompt", st.goto is not None and st.goto.n >= 3, lambda: f'"{st.goto.example}"', lambda: f"Sent {st.goto.n} times.")
    card("parallel", st.max_parallel >= 2, lambda: f"{st.max_parallel} agents in parallel", lambda: f"{st.dispatch_count} dispatches across {st.dispatching_sessions} sessions.")
    card("brevity", prompts >= 10, lambda: f"{_pct(st.short_prompts, prompts)}% short prompts", lambda: f"{st.short_prompts} of {prompts} have {SHORT_WORDS} words or fewer.")
    card("politeness", st.courtesy >= 3, lambda: f"{st.courtesy} thanks", lambda: f"Across {st.courtesy_sessions} sessions.")
    per10 = int(100.0 * st.corrections / prompts + 0.5) / 10 if prompts else 0
    card("steering", prompts >= 10, lambda: f"{per10:g} correction{'' if per10 == 1 else 's'} per 10 prompts", lambda: f"{st.corrections} of {prompts} prompts.")
    card("longest_run", st.longest is not None, lambda: duration(st.longest.s), lambda: "The longest subagent run.")
    card("crash_out", st.crash is not None and len(st.crash.text.split()) >= 3, lambda: f'"{st.crash.text}"', lambda: f"{round(st.crash.caps_ratio * 100)}% of its letters are capitals.")
    card("lines", commits >= 1, lambda: f"{st.added_lines:,} lines added", lambda: f"{st.added_lines:,} added / {st.deleted_lines:,} deleted in {commits} commits and {st.n_episodes} episodes.")
    card("ship_day", commits >= 5 and st.day is not None, lambda: f"{st.day}s", lambda: f"{st.day_count} of {commits} commits ({_pct(st.day_count, commits)}%).")
    return made


def warnings(st) -> list[str]:
    """What the evidence doesn't cover."""
    rules = [
        (st.n_sessions < 5, "Few sessions: every figure rests on little."), (st.commit_count == 0, "No commits: outcomes can't be told from shipping."), (st.test_runs == 0, "No test runs were seen."),
        (st.prompts < 10, "Few prompts: rates are coarse."), (st.plan_sessions == 0, "No plan files were seen."),
    ]
    return [text for hit, text in rules if hit]


def matched_scores(scores: DataFrame, episodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(matched, unmatched): the first score of each known episode; scores of unknown ones."""
    known = episodes.select("episode_id").distinct()
    return S.first_by(scores.join(known, "episode_id"), ["episode_id"], ["pos"]), scores.join(known, "episode_id", "left_anti")


def session_episode(episodes: DataFrame) -> DataFrame:
    """(session_id, episode_id): the first episode that lists a session."""
    return episodes.select("episode_id", F.explode("session_ids").alias("session_id")).groupBy("session_id").agg(F.min("episode_id").alias("episode_id"))


def link_labels(episodes: DataFrame) -> DataFrame:
    """(episode_id, label): the most frequent link type, ties by label."""
    name = first_of([(F.col("t") == k, v) for k, v in LINK_NAMES.items() if k], LINK_NAMES[None])
    links = episodes.select("episode_id", F.explode("links.link_type").alias("t")).withColumn("label", name)
    best = S.most_common(links, ["episode_id"], "label").select("episode_id", "label")
    return episodes.select("episode_id", "commit_group_ids").join(best, "episode_id", "left").select("episode_id", F.coalesce("label", F.when(F.size("commit_group_ids") > 0, "commits only, no linked sessions").otherwise(LINK_NAMES[None])).alias("label"))


def episode_order(episodes: DataFrame, groups: DataFrame, sessions: DataFrame) -> DataFrame:
    """Episodes by latest activity, newest first, then by id."""
    g = episodes.select("episode_id", F.explode("commit_group_ids").alias("id")).join(groups.select("id", "latest_commit_at"), "id").groupBy("episode_id").agg(F.max("latest_commit_at").alias("a"))
    s = episodes.select("episode_id", F.explode("session_ids").alias("session_id")).join(sessions.select("session_id", TM.instant(F.col("session_modified_at")).alias("m")), "session_id").groupBy("episode_id").agg(F.max("m").alias("b"))
    out = episodes.join(g, "episode_id", "left").join(s, "episode_id", "left").withColumn("latest", F.coalesce("a", "b")).drop("a", "b")
    return out.orderBy(F.desc_nulls_last("latest"), "episode_id")


def decision_kinds(decisions: DataFrame) -> DataFrame:
    """(decision_type, n), the most frequent first; decisions without a type count together."""
    return decisions.groupBy("decision_type").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "decision_type")


def top_decisions(decisions: DataFrame, k: int = 3) -> DataFrame:
    """The ``k`` decisions of the highest confidence, then in order of session and event."""
    rank = first_of([(F.col("classification_confidence") == c, F.lit(i)) for i, c in enumerate(("high", "medium", "low"))], F.lit(3))
    return decisions.orderBy(rank, "session_id", "event_index").limit(k)


def parse_rubric(text: str) -> dict[str, list[str]]:
    """Lines of a caller's rubric by the heading above them."""
    out: dict[str, list[str]] = {}
    head = ""
    for line in text.splitlines():
        m = re.match(r"#+\s+(.*)", line)
        if m:
            head = m[1].strip()
        elif line.strip():
            out.setdefault(head, []).append(line.strip())
    return out


def table(head: Iterable[str], rows: Iterable[Iterable[object]]) -> str:
    head = list(head)
    lines = ["| " + " | ".join(head) + " |", "|" + "---|" * len(head)]
    return "\n".join(lines + ["| " + " | ".join("—" if v is None else str(v) for v in r) + " |" for r in rows])


def work_lines(episodes: DataFrame) -> DataFrame:
    """(episode_id, line): an episode as the report lists it."""
    number = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("None"))
    text = F.concat(F.lit("- episode "), F.col("episode_id").cast("string"), F.lit(" ("), F.coalesce("episode_type", F.lit("None")), F.lit(", "), F.col("label"), F.lit("): +"), number("added_lines"), F.lit("/-"), number("deleted_lines"))
    return episodes.join(link_labels(episodes), "episode_id").select("episode_id", text.alias("line"))


def _around(sessions: DataFrame, events: DataFrame, commits: DataFrame, episodes: DataFrame, scores: DataFrame, decisions: DataFrame, calls: DataFrame | None, titles: dict[str, str] | None) -> tuple[list[str], list[str]]:
    """Lines before and after those of the episodes. What is collected is cut to a few rows, or has one a model, axis or kind."""
    st = stats(sessions, events, commits, episodes).first()
    matched, unmatched = matched_scores(scores, episodes)
    cells = matched.select("episode_id", "confidence", F.explode("scores").alias("axis", "score")).withColumn("all", F.lit(1))
    roll = R.rollup(cells, ["all"]).first()
    usage = sessions.select("session_id", F.explode("token_usage").alias("model", "u")).select("session_id", "model", "u.*")
    used = R.priced(usage)
    head = ["# Work report", "", "## Verdict"]
    if roll:
        head += [f"Overall {roll.overall:.2f} ({roll.band}).", "", table(["axis", "score"], sorted(roll.axes.items(), key=lambda kv: (-kv[1], R.AXES.index(kv[0]) if kv[0] in R.AXES else 99)))]
    else:
        head.append("Nothing was scored.")
    head += ["", "## Why", table(["episode", "title", "confidence"], [(r.episode_id, r.title, r.confidence) for r in matched.orderBy(F.desc("confidence"), "episode_id").limit(20).collect()])]
    low = R.lowest_cells(cells, ["all"], 5).orderBy("rank").collect()
    head += ["", "## Improve", *[f"- episode {r.episode_id}: {r.axis} {r.score:g}" for r in low], *[f"- {w}" for w in warnings(st)], "", "## Work"]
    totals = R.model_totals(used).orderBy(F.desc("is_total"), "model").collect()
    foot = ["", "## Numbers", table(["model", "input", "output", "cache read", "cache write", "cost"], [("total" if r.is_total else r.model, f"{r.input_tokens or 0:,}", f"{r.output_tokens or 0:,}", f"{r.cache_read_tokens or 0:,}", f"{r.cache_write_tokens or 0:,}", None if r.cost is None else f"${r.cost:.2f}") for r in totals])]
    foot += ["", "Dearest sessions: " + ", ".join(f"{r.session_id} (${r.cost:.2f})" for r in R.costly_sessions(used).collect())]
    kinds = decision_kinds(decisions).collect()
    foot += ["", table(["decision", "n"], [(r.decision_type or "unclassified", r.n) for r in kinds])]
    for r in top_decisions(decisions).collect():
        foot.append(f"- {(titles or {}).get(r.law_key, r.law_key) or r.domain}: {r.redacted_response_text[:200]}")
    foot += ["", "## Highlights", *[f"- **{c['headline']}** {c['caption']}" for c in cards(st)]]
    foot += ["", "## Fine print", f"{st.n_sessions} sessions, {st.n_episodes} episodes, {unmatched.count()} scores without an episode."]
    foot += ["", "## Appendix"]
    if calls is not None:
        foot.append(table(["stage", "model", "calls", "tokens"], [(r.stage, r.model, r.calls, f"{r.total_tokens:,}") for r in R.ledger(calls).orderBy("stage", "model").collect()]))
    return head, foot


def lines(sessions: DataFrame, events: DataFrame, commits: DataFrame, episodes: DataFrame, scores: DataFrame, decisions: DataFrame, calls: DataFrame | None = None, titles: dict[str, str] | None = None) -> Iterator[str]:
    """The report line by line; equal inputs give equal bytes. Episodes' lines are made in tasks and come a sorted range at a time, so the driver holds one range."""
    head, foot = _around(sessions, events, commits, episodes, scores, decisions, calls, titles)
    yield from head
    for r in work_lines(episodes).orderBy("episode_id").toLocalIterator():
        yield r.line
    yield from foot


def render(*args, **more) -> str:
    """The whole report as markdown, for as many episodes as a text may hold; see :func:`lines`."""
    return "\n".join(lines(*args, **more)) + "\n"


def export(path: str, sessions: DataFrame, events: DataFrame, commits: DataFrame, episodes: DataFrame, scores: DataFrame, decisions: DataFrame, calls: DataFrame | None = None, titles: dict[str, str] | None = None) -> None:
    """The report as a folder of text parts whose names are in its order; nothing of the episodes passes through the driver."""
    head, foot = _around(sessions, events, commits, episodes, scores, decisions, calls, titles)
    spark, schema = episodes.sparkSession, "part int, place long, line string"
    ends = spark.createDataFrame([(part, i, x) for part, some in ((0, head), (2, foot)) for i, x in enumerate(some)], schema)
    work = work_lines(episodes).select(F.lit(1).alias("part"), F.col("episode_id").cast("long").alias("place"), "line")
    ends.unionByName(work).orderBy("part", "place").select(F.col("line").alias("value")).write.mode("overwrite").text(path)


# What the analytics say of each dimension, and the field without which a line is left out.
ANALYTICS_LINES = (
    ("commit_discipline", "total_commits", "Commit discipline: {total_commits} commits, conventional {conventional_commit_ratio:share}, reverts {revert_ratio:share}, atomic {atomic_commit_ratio:share}, avg size {avg_commit_size_lines} lines"),
    ("test_quality", None, "Tests: {test_file_count:n} test files, test/prod LOC ratio {test_ratio:n}, frameworks: {frameworks:names}"),
    ("code_quality", "total_source_files", "Code: {total_source_files} source files, avg {avg_file_length} / median {median_file_length} lines, {god_object_count} god objects (>500), max {max_file_length}"),
    ("error_handling", None, "Error handling: {rescue_total:n} handlers, bare/generic ratio {bare_rescue_ratio:n}, retry logic: {has_retry_logic:flag}"),
    ("security_signals", None, "Security: eval {eval_usage:n}, exec {exec_usage:n}, SQL interpolation {sql_interpolation_count:n}, hardcoded-secret patterns {hardcoded_secret_patterns:n}"),
    ("architecture", None, "Architecture: {total_components:n} components across {component_types:n} types (separation of concerns: {has_separation_of_concerns:flag})"),
    ("documentation", None, "Docs: {doc_count:n} files, README: {has_readme:flag}, CHANGELOG: {has_changelog:flag}"),
    ("agent_configs", None, "Agent configs: {tools_configured:names} ({total_word_count:n} words, {total_constraint_count:n} constraints)"),
    ("infrastructure", None, "Infrastructure: {*:names}"),
    ("dependencies", None, "Dependencies: {dependency_count:n} declared, lockfile: {has_lockfile:flag}, frameworks: {frameworks:names}"),
    ("git_workflow", "active_days", "Git workflow: {active_days} active days, {commits_per_active_day} commits/day, {version_commits} version commits"),
    ("code_evolution", "total_lines_added", "Evolution: +{total_lines_added} / -{total_lines_deleted} (net {net_loc_change}), deletion ratio {deletion_ratio}, refactor commits {refactor_commit_ratio:share}"),
    ("performance", None, "Performance awareness: {*:names}"),
    ("production_readiness", None, "Production readiness: {*:names}"),
)
VELOCITY_LINES = (
    ("insertions", "LOC: +{insertions} / -{deletions} (net {net_loc}), {loc_per_day} net LOC/day over {date_range_days} days"), ("insertions", "Test insertions: {test_insertions} (ratio {test_ratio})"),
    ("peak_date", "Peak day: {peak_date} (+{peak_insertions} / {peak_commits} commits)"), ("insertions", "Authors: {authors:n}, ship-to-revert ratio: {ship_to_revert_ratio}"),
    ("author_insertions", "Author-scoped: +{author_insertions} / -{author_deletions} over {author_commits} commits ({author_loc_per_day} net LOC/day)"),
)


class _Fields(string.Formatter):
    """Fields of a record by name (``*``: all of it), with formats for counts, shares, flags and names."""

    def get_value(self, key, args, record):
        return record if key == "*" else record.get(key)

    def format_field(self, value, spec: str) -> str:
        if spec == "share":
            return f"{value * 100:.1f}%" if isinstance(value, (int, float)) else "n/a"
        if spec == "names":
            return ", ".join([k for k, on in value.items() if on is True] if isinstance(value, dict) else value or []) or "none"
        return str((value or 0) if spec == "n" else bool(value) if spec == "flag" else value)


def render_analytics(record: dict) -> str:
    """The analytics record as markdown, section by section."""
    say = _Fields().vformat
    q, v, steered, p, about = (record.get(k) or {} for k in ("code_quality", "velocity", "steering", "parallelism", "profile"))
    dims = q.get("dimensions") or {}
    out = ["# Repository analytics", "", f"- Sessions analyzed: {record.get('session_count', 0)}", "", f"## Code Quality — status: {q.get('status', 'error')}"]
    if q.get("status") == "complete":
        out.append(f"- Files analyzed: {q.get('file_count')}")
        whole = {d: x for d, x in dims.items() if isinstance(x, dict) and x and x.get("status") != "error"}
        out += [f"- {say(text, (), whole[d])}" for d, needed, text in ANALYTICS_LINES if d in whole and (needed is None or whole[d].get(needed) is not None)]
        broken = [d for d, x in dims.items() if isinstance(x, dict) and x.get("status") == "error"]
        out += [f"- Dimensions errored: {', '.join(broken)}"] if broken else []
    elif q.get("error"):
        out.append(f"- Error: {q['error']}")
    told = [f"- {say(text, (), v)}" for needed, text in VELOCITY_LINES if v.get(needed) is not None]
    out += ["", "## Velocity", *(told or ["- No git data (no commits found)"])]
    counts = steered.get("actions") or {}
    out += ["", "## Steering", f"- {sum(counts.values())} steering actions across {steered.get('sessions_with_actions', 0)}/{record.get('session_count', 0)} sessions"]
    out += ["- Action mix: " + ", ".join(f"{k} {n}" for k, n in counts.items())] if counts else []
    out += [
        "", "## Parallelism", f"- Dispatches: {p.get('dispatch_count', 0)}, returns: {p.get('return_count', 0)}",
        f"- Sessions with dispatch + matched return + commit after return: {p.get('dispatch_with_committed_return_count', 0)}",
        "- concurrent_pairs_with_ships_count / review_separation_count: null (need child subagent session records that don't exist locally)", "", "## Profile",
    ]
    if "status" in about or not about:
        out.append(f"- status: {about.get('status', 'error')}")
    else:
        names = lambda xs: ", ".join(xs) or "none"
        out += [
            f"- Project framework: {about['project_framework']}", f"- Frameworks detected: {names(about['frameworks'])}; {about['dependency_count']} dependencies", f"- Agent configs: {names(about['agent_config_stats'].get('tools_configured') or [])}",
            f"- Documentation files: {about['documentation'].get('doc_count', 0)}", f"- Infra signals: {names(sorted(about['infra_signals']))}",
        ]
    return "\n".join(out) + "\n"
