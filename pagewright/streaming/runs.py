"""Runs while they go on: which of their children are pending, which settle in time, and when a run has gone quiet.

Time is the collector's own, ``seen_at``: when it saw a record. It runs alike for all sessions, so no session's clock expires another's run. Two keyed operators
follow one another. The first, by session, reads turns off the records and sends each to the session it belongs to: a child's to the one that named the child last. The
second, by that session, holds its open runs and their unfinished children in map states, with a timer at the next end of a wait. Both give up what has ended, so
state is what is going on. Output is append-only.

A run is its turn, from its prompt to its end. Its children are those its records name; a child's records count for the run that named it last. A child is pending
from then until its turn ends. A run whose turn ended is over once no child is pending, or ``settle`` later, with those left as orphans. A run without a record of its
own turn or its children for ``idle`` is abandoned. A child that another run takes over before it finished is an orphan of the first.
"""
from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from pagewright.operators.states import IDLE
from pagewright.operators.turns import FINISHED, MARKER, STARTED, marked_run
from pagewright.streaming.transcripts import keyed_state

# What a row of the second operator says, and what it answers.
OPENED, ALIVE, ENDED = "opened", "alive", "ended"
NAMED, SETTLED, ORPHAN = "named", "settled", "orphan"
COMPLETED, WITH_ORPHANS, ABANDONED = "completed", "completed_with_orphans", "abandoned"
ROUTED = "root string, at timestamp, ms long, place long, session_id string, what string, run_id string, child_ids array<string>"
VERDICTS = "run_id string, child_id string, what string, ms long, pending long"
_SENT, _SAID = (Row(*(c.split()[0] for c in schema.split(", "))) for schema in (ROUTED, VERDICTS))
#: How long a session's turn is remembered when nothing comes, and how long a run's children may take after its end.
FORGET = "1 day"
SETTLE = "30 seconds"


def _ms(span: str) -> int:
    return int(pd.Timedelta(span).total_seconds() * 1000)


@dataclass
class Turn:
    """Where a session stands: its last lifecycle record (or ``open`` and ``FINISHED`` where it has none), its turn's run, and the session that named it last."""
    frame: str = ""
    framed: bool = False
    run_id: str = ""
    prompted: bool = False
    parent: str = ""

    def take(self, session: str, row) -> tuple[str, str, str] | None:
        """``(root, what, run_id)`` of a record, if it belongs to a run or a named child."""
        ended = False
        if row.lifecycle == STARTED:
            self.frame, self.framed, self.run_id, self.prompted = STARTED, True, "", False
        elif row.lifecycle:
            self.frame, self.framed = row.lifecycle, True
            ended = row.lifecycle == FINISHED
        elif row.kind == "user":
            if self.frame in ("", "open", FINISHED):
                self.frame, self.framed, self.run_id, self.prompted = "open", False, "", False
        elif row.kind == "assistant" and not self.framed and row.stop in ("end", "error"):
            ended, self.frame = self.frame == "open", FINISHED
        opened = row.kind == "user" and not self.prompted and self.frame != FINISHED
        if opened:
            self.prompted, self.run_id = True, row.run_id
        what = ENDED if ended else OPENED if opened else ALIVE
        run_id = self.run_id
        if ended:
            self.run_id = ""
        if run_id:
            return session, what, run_id
        return (self.parent, what, "") if self.parent else None


def routed(session: str, turn: Turn, rows: list) -> list[tuple]:
    """The rows a session's records give the second operator. ``rows`` are its records and the records that name it, as from ``family_rows``."""
    out = []
    for row in sorted(rows, key=lambda r: (r.ms, r.parent == "", r.place)):
        if row.parent:
            turn.parent = row.parent
            continue
        sent = turn.take(session, row)
        if sent:
            root, what, run_id = sent
            out.append((root, row.at, row.ms, row.place, session, what, run_id, list(row.child_ids) if run_id and row.child_ids is not None else []))
    return out


class _Route(StatefulProcessor):
    """Rows come and go as rows, and a key's state is read and written once a batch: a group is a few records, for which a frame of each costs more than the work."""

    def __init__(self, forget_ms: int):
        self.forget_ms = forget_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.turn = handle.getValueState("turn", "frame string, framed boolean, run_id string, prompted boolean, parent string, last long")

    def handleInputRows(self, key, rows, timerValues):
        kept, held = self.turn.get(), list(rows)
        turn = Turn(*kept[:5]) if kept else Turn()
        out = routed(key[0], turn, held)
        last = max(r.ms for r in held)
        self.turn.update((turn.frame, turn.framed, turn.run_id, turn.prompted, turn.parent, last))
        if not kept:
            # a session's only timer: where records came since, it is set anew when it is due
            self.handle.registerTimer(last + self.forget_ms)
        for row in out:
            yield _SENT(*row)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        due = self.turn.get()[5] + self.forget_ms
        if due > expiredTimerInfo.getExpiryTimeInMs():
            self.handle.registerTimer(due)
        else:
            self.turn.clear()
        yield from ()


def _wake(handle: StatefulProcessorHandle, at: int | None) -> None:
    """Let the key's only timer stand at ``at``, in milliseconds."""
    standing = [t[0] if isinstance(t, tuple) else t for t in handle.listTimers()]
    for t in standing:
        if t != at:
            handle.deleteTimer(t)
    if at is not None and at not in standing:
        handle.registerTimer(at)


@dataclass
class Family:
    """The open runs of one session, ``(last record, end of its turn or None)``, and their unfinished children."""
    idle_ms: int
    settle_ms: int
    runs: dict[str, tuple[int, int | None]] = field(default_factory=dict)
    children: dict[str, str] = field(default_factory=dict)
    out: list[tuple] = field(default_factory=list)

    def pending(self, run_id: str) -> list[str]:
        return sorted(c for c, r in self.children.items() if r == run_id)

    def due(self, run_id: str) -> int:
        """The last moment at which a record still counts."""
        last, ended = self.runs[run_id]
        return last + self.idle_ms if ended is None else ended + self.settle_ms

    def _close(self, run_id: str, verdict: str, at: int) -> None:
        left = self.pending(run_id)
        for i, child in enumerate(left, 1):
            del self.children[child]
            self.out.append((run_id, child, ORPHAN, at, len(left) - i))
        del self.runs[run_id]
        self.out.append((run_id, None, WITH_ORPHANS if left and verdict == COMPLETED else verdict, at, 0))

    def expire(self, now: int) -> None:
        """Close what was waited for until before ``now``."""
        for due, run_id in sorted((self.due(r), r) for r in self.runs):
            if due < now:
                self._close(run_id, ABANDONED if self.runs[run_id][1] is None else COMPLETED, due)

    def take(self, root: str, row) -> None:
        self.expire(row.ms)
        own = row.session_id == root and row.run_id != ""
        if own:
            if row.what == OPENED:
                self.runs[row.run_id] = (row.ms, None)
            if row.run_id not in self.runs:
                return
            if self.runs[row.run_id][1] is None:
                self.runs[row.run_id] = (row.ms, row.ms if row.what == ENDED else None)
            for child in row.child_ids:
                first = self.children.get(child)
                if first != row.run_id:
                    if first is not None:
                        del self.children[child]
                        self.out.append((first, child, ORPHAN, row.ms, len(self.pending(first))))
                        self._over(first, row.ms)
                    self.children[child] = row.run_id
                    self.out.append((row.run_id, child, NAMED, row.ms, len(self.pending(row.run_id))))
            self._over(row.run_id, row.ms)
        elif row.session_id in self.children:
            run_id = self.children[row.session_id]
            if self.runs[run_id][1] is None:
                self.runs[run_id] = (row.ms, None)
            if row.what == ENDED:
                del self.children[row.session_id]
                self.out.append((run_id, row.session_id, SETTLED, row.ms, len(self.pending(run_id))))
                self._over(run_id, row.ms)

    def _over(self, run_id: str, at: int) -> None:
        if run_id in self.runs and self.runs[run_id][1] is not None and not self.pending(run_id):
            self._close(run_id, COMPLETED, at)


class _Judge(StatefulProcessor):
    def __init__(self, idle_ms: int, settle_ms: int):
        self.idle_ms, self.settle_ms = idle_ms, settle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.runs = handle.getMapState("runs", "run_id string", "last long, ended long")
        self.children = handle.getMapState("children", "child_id string", "run_id string")

    def _families(self) -> tuple[Family, Family]:
        """What the state holds, read once, and a copy to go on with."""
        runs, children = {k[0]: (v[0], v[1]) for k, v in self.runs.iterator()}, {k[0]: v[0] for k, v in self.children.iterator()}
        return Family(self.idle_ms, self.settle_ms, runs, children), Family(self.idle_ms, self.settle_ms, dict(runs), dict(children))

    def _keep(self, before: Family, after: Family):
        for state, old, new in ((self.runs, before.runs, after.runs), (self.children, before.children, after.children)):
            for k in old.keys() - new.keys():
                state.removeKey((k,))
            for k, v in new.items():
                if old.get(k) != v:
                    state.updateValue((k,), v if isinstance(v, tuple) else (v,))
        _wake(self.handle, min((after.due(r) + 1 for r in after.runs), default=None))
        for row in after.out:
            yield _SAID(*row)

    def handleInputRows(self, key, rows, timerValues):
        before, now = self._families()
        for row in sorted(rows, key=lambda r: (r.ms, r.session_id != key[0], r.session_id, r.place)):
            now.take(key[0], row)
        yield from self._keep(before, now)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        before, now = self._families()
        now.expire(expiredTimerInfo.getExpiryTimeInMs())
        yield from self._keep(before, now)


def family_rows(events: DataFrame, marker: str = MARKER) -> DataFrame:
    """Records ``(session_id, index, kind, lifecycle, stop, content, child_ids, seen_at)`` as rows by session, and a row more for each child a record names, by child."""
    run_id = F.when(F.col("kind") == "user", marked_run(F.col("content"), marker)).otherwise("")
    shared = [F.col("seen_at").alias("at"), F.unix_millis("seen_at").alias("ms"), F.col("index").cast("long").alias("place")]
    own = events.select("session_id", *shared, "kind", "lifecycle", "stop", run_id.alias("run_id"), "child_ids", F.lit("").alias("parent"))
    named = events.filter(F.size("child_ids") > 0).select(
        F.explode("child_ids").alias("session_id"), *shared, "kind", "lifecycle", "stop", F.lit("").alias("run_id"),
        F.array().cast("array<string>").alias("child_ids"), F.col("session_id").alias("parent"))
    return own.unionByName(named)


def stream_runs(events: DataFrame, idle: str = IDLE, settle: str = SETTLE, lateness: str = "0 seconds", forget: str = FORGET, marker: str = MARKER) -> DataFrame:
    """``(run_id, child_id, what, ms, pending)``: what happens to runs and their children, each thing once, at ``ms``.

    With a child: ``named``, then ``settled`` when its turn ended in time or ``orphan``; ``pending`` is how many of the run's children are unfinished then. Without
    one: ``completed``, ``completed_with_orphans`` or ``abandoned``, after which the run's later records say nothing any more. A turn without a run's marker belongs to no
    run. ``seen_at`` must rise within what belongs together, but for ``lateness``; a verdict that nothing later brings comes when the clock of all has passed its end.
    """
    keyed_state(events.sparkSession)
    rows = family_rows(events.withWatermark("seen_at", lateness), marker)
    sent = rows.groupBy("session_id").transformWithState(_Route(_ms(forget)), ROUTED, "append", "EventTime", eventTimeColumnName="at")
    return sent.groupBy("root").transformWithState(_Judge(_ms(idle), _ms(settle)), VERDICTS, "append", "EventTime")


def pending_children(verdicts: DataFrame) -> DataFrame:
    """``(run_id, named, finished, pending)`` of ``stream_runs``' rows so far: pending children are those named and neither settled nor given up."""
    count = lambda *what: F.count(F.when(F.col("what").isin(*what), 1))
    counted = verdicts.groupBy("run_id").agg(count(NAMED).alias("named"), count(SETTLED, ORPHAN).alias("finished"))
    return counted.withColumn("pending", F.col("named") - F.col("finished"))


def run_verdicts(verdicts: DataFrame) -> DataFrame:
    """``(run_id, state, ms)`` of the runs that are over."""
    over = reduce(lambda a, b: a | b, (F.col("what") == w for w in (COMPLETED, WITH_ORPHANS, ABANDONED)))
    return verdicts.filter(over).select("run_id", F.col("what").alias("state"), "ms")
