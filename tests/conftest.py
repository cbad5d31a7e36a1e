from __future__ import annotations

import json
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from pagewright.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    yield local_session(8, folder=str(tmp_path_factory.mktemp("shared")))


@pytest.fixture
def table(spark):
    """A DataFrame of tuples under a DDL schema, or of dicts whose missing keys are null."""
    def make(schema: str, data: list):
        names = spark.createDataFrame([], schema).columns
        return spark.createDataFrame([tuple(d.get(n) for n in names) if isinstance(d, dict) else tuple(d) for d in data], schema)
    return make


@pytest.fixture
def sent():
    """What a DataFrame's plan, as made before it runs, sends to the driver to be broadcast: a text for each such part."""
    def found(df) -> list[str]:
        out, todo = [], [df._jdf.queryExecution().executedPlan()]
        while todo:
            node = todo.pop()
            node = node.initialPlan() if node.nodeName() == "AdaptiveSparkPlan" else node
            out += [node.toString()] * node.nodeName().startswith("BroadcastExchange")
            todo += [node.children().apply(i) for i in range(node.children().size())]
        return out
    return found


# A transcript in a test is a script: one line a record, ``kind``, ``value`` and whatever fields the record has beside. What a kind is as a
# record is said once, here. Time runs a second a line from the script's start.
KIND_ROLES = {"ask": "user", "say": "assistant", "use": "assistant", "get": "toolResult", "note": "system-message", "mark": "turn-lifecycle",
              "meta": "user-message-metadata"}


def record_of(kind: str, value, fields: dict, at: int) -> dict:
    """One script line as a record. ``use`` takes ``{tool: arguments}`` pairs, ``get`` a tool and its text, ``mark`` a phase; ``alien`` a role unknown here."""
    out = {"role": KIND_ROLES.get(kind, value), "timestamp": at}
    if kind == "mark":
        out["event"] = value
    elif kind == "get":
        tool, body = value
        out |= {"toolName": tool, "content": body}
    elif kind == "use":
        out |= {"stopReason": "toolUse", "content": [{"type": "toolCall", "name": n, "arguments": a} for n, a in value]}
    elif kind in ("ask", "say"):
        out["content"] = value if isinstance(value, list) else [{"type": "text", "text": value}]
        if kind == "say":
            out["stopReason"] = "stop"
    elif kind == "note":
        out["content"] = value
    return out | fields


def script_rows(sessions: dict[str, list[tuple]], start: dict[str, int] | None = None) -> list[tuple[str, int, str]]:
    rows = []
    for name, lines in sessions.items():
        began = (start or {}).get(name, 1_000_000)
        for i, (kind, value, *more) in enumerate(lines):
            made = value if kind == "raw" else json.dumps(record_of(kind, value, more[0] if more else {}, began + 1000 * i), ensure_ascii=False)
            rows.append((name, i, made))
    return rows


@pytest.fixture
def scripted(spark):
    """Everything the library derives of scripts: events, turns, and for the run ids given their scope and evidence."""
    from pagewright.operators import events, evidence, turns
    from pagewright.session import stored

    class Derived:
        def __init__(self, sessions: dict[str, list[tuple]], runs: list[str] = (), start: dict[str, int] | None = None):
            records = spark.createDataFrame(script_rows(sessions, start), "session_id string, index bigint, raw string")
            self.events = stored(turns.segment_turns(events.normalize_events(records)), "events")
            self.turns = stored(turns.turns_of(self.events), "turns")
            self.prompts = turns.prompts_of(self.events, self.turns)
            ids = spark.createDataFrame([(r,) for r in runs], "run_id string")
            self.run_turns = stored(turns.run_turns(turns.run_session_join(ids, self.prompts), self.turns), "run-turns")
            self.own = turns.run_scope(self.run_turns, self.events)
            self.named = stored(turns.named_children(self.own), "named")
            self.tasks = stored(turns.child_tasks(self.run_turns, self.named, self.turns), "tasks")
            self.scoped = stored(turns.whole_scope(self.own, turns.child_scope(self.tasks, self.events, self.turns)), "scoped")
            self.orphans = turns.orphan_children(self.named, self.tasks, self.turns)
            self.answers = evidence.final_answer(self.run_turns, self.events)
            self.child_answers = evidence.child_answers(self.tasks, self.turns, self.events)

        def typed(self) -> list:
            return self.events.orderBy("session_id", "index").collect()
    return Derived


def marker(run: str) -> str:
    return f"(run-marker:{run} — for the record)"
