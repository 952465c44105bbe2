"""The state machine of a session over a stream of its blocks: state and timers in place of windows."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: What a row of the stream holds beside its session; see :func:`operators.events.marked`.
FACTS = "seq long, bpos int, ts timestamp, commits boolean, said boolean, asks boolean, asked_by string, tool_use_id string, said_sha string, said_pr long, said_branch string"
FOUND = "session_id string, kind string, seq long, bpos int, value string"
_NAMES = [f.split()[0] for f in FACTS.split(", ")]
_HELD = "ms long, commits boolean, said boolean, asks boolean, asked_by string, tool_use_id string, said_sha string, said_pr long, said_branch string"
_MACHINE = "commit_seq long, commit_bpos int, ask_seq long, ask_bpos int, ask_id string, answered boolean, run_seq long, run_bpos int, run_start long, run_end long, run_n long"


def _none(x):
    return None if x is None or x is pd.NaT or (isinstance(x, float) and x != x) or x is pd.NA else x


class Machine:
    """What a session waits for: an answer to its last commit and to its newest request, and the end of its open run."""

    def __init__(self, held: tuple | None = None):
        self.commit_seq, self.commit_bpos, self.ask_seq, self.ask_bpos, self.ask_id, self.answered, self.run_seq, self.run_bpos, self.run_start, self.run_end, self.run_n = map(_none, held) if held else (None,) * 11

    def held(self) -> tuple:
        return (self.commit_seq, self.commit_bpos, self.ask_seq, self.ask_bpos, self.ask_id, self.answered, self.run_seq, self.run_bpos, self.run_start, self.run_end, self.run_n)

    def close(self) -> Iterator[tuple]:
        if self.run_n:
            yield "run", self.run_seq, self.run_bpos, f"{self.run_start}:{self.run_end}:{self.run_n}"
        self.run_n = None

    def step(self, seq: int, bpos: int, ms: int, gap_ms: int, commits, said, asks, asked_by, tool_use_id, sha, pr, branch) -> Iterator[tuple]:
        """(kind, seq, bpos, value) of what this block settles."""
        if self.run_n and ms - self.run_end > gap_ms:
            yield from self.close()
        if not self.run_n:
            self.run_seq, self.run_bpos, self.run_start, self.run_end, self.run_n = seq, bpos, ms, ms, 0
        self.run_end, self.run_n = max(self.run_end, ms), self.run_n + 1
        if said and self.commit_seq is not None:
            if sha is not None:
                yield "sha", self.commit_seq, self.commit_bpos, sha
            self.commit_seq = self.commit_bpos = None
        if said and self.ask_seq is not None and not self.answered and (self.ask_id is None or self.ask_id == tool_use_id):
            self.answered = True
            if pr is not None:
                yield "pr", seq, bpos, str(pr)
        if branch is not None:
            yield "branch", seq, bpos, branch
        if commits:
            self.commit_seq, self.commit_bpos = seq, bpos
        if asks:
            self.ask_seq, self.ask_bpos, self.ask_id, self.answered = seq, bpos, asked_by, False


class SessionStates(StatefulProcessor):
    """Holds a session's blocks until the watermark has passed them, then takes them in order; a timer closes a run that nothing follows."""

    def __init__(self, gap_ms: int):
        self.gap_ms = gap_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.blocks = handle.getMapState("blocks", "seq long, bpos int", _HELD)
        self.machine = handle.getValueState("machine", _MACHINE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        first = None
        for pdf in rows:
            for r in pdf[_NAMES].itertuples(index=False):
                ms = int(r.ts.value // 1_000_000)
                self.blocks.updateValue((int(r.seq), int(r.bpos)), (ms, bool(r.commits), bool(r.said), bool(r.asks), _none(r.asked_by), _none(r.tool_use_id), _none(r.said_sha), None if _none(r.said_pr) is None else int(r.said_pr), _none(r.said_branch)))
                first = ms if first is None else min(first, ms)
        if first is not None:
            self.handle.registerTimer(max(first, timerValues.getCurrentWatermarkInMs()) + 1)
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs()
        held = sorted((k, v) for k, v in self.blocks.iterator())
        machine = Machine(self.machine.get() if self.machine.exists() else None)
        out, later = [], None
        for (seq, bpos), (ms, *facts) in held:
            if ms > mark or later is not None:
                # what comes after a block that must wait, waits too
                later = ms if later is None else min(later, ms)
                continue
            out += machine.step(seq, bpos, ms, self.gap_ms, *map(_none, facts))
            self.blocks.removeKey((seq, bpos))
        if later is not None:
            self.handle.registerTimer(max(later, mark) + 1)
        elif machine.run_n:
            if mark > machine.run_end + self.gap_ms:
                out += machine.close()
            else:
                self.handle.registerTimer(machine.run_end + self.gap_ms + 1)
        self.machine.update(machine.held())
        if out:
            yield pd.DataFrame([(key[0], *r) for r in out], columns=[f.split()[0] for f in FOUND.split(", ")])

    def close(self) -> None:
        pass


def states(facts: DataFrame, gap_minutes: int = 15, late: str = "1 hour") -> DataFrame:
    """(session_id, kind, seq, bpos, value) over a stream of marked facts (session_id and FACTS): kind is ``sha`` of the commit there, ``pr`` or ``branch`` named there, or ``run`` that began there (start:end in milliseconds and blocks).

    Equal to :func:`operators.events.resolved` and :func:`operators.sequence.active_windows` over the same rows, in whatever order and
    micro-batches they come, as long as none is later than ``late`` and a session's times don't fall from block to block. State of a
    session: its blocks within ``late``, and one row. Needs the RocksDB state store.
    """
    rows = facts.select("session_id", *_NAMES).where("ts is not null").withWatermark("ts", late)
    return rows.groupBy("session_id").transformWithStateInPandas(SessionStates(gap_minutes * 60_000), FOUND, "append", "eventTime")
