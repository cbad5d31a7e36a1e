"""Transcripts against plain models: random scripts, tables of cases made from a rule's dimensions."""
from __future__ import annotations

import itertools
import json
import random

import pytest
from conftest import marker
from pyspark.sql import functions as F

from pagewright.operators import answers, audit, events, evidence, logs, states, turns
from pagewright.session import stored
from pagewright.sources import transcripts

# --- records ---


def test_every_role_and_stop_has_its_kind(scripted) -> None:
    stops = {"toolUse": "tool", "stop": "end", "error": "error", "unheard-of": "", None: ""}
    lines = [(k, v) for k, v in (("ask", "q"), ("note", "n"), ("mark", "started"), ("mark", "finished"), ("meta", None), ("get", ("t", "x")), ("alien", "tool-beta"), ("alien", None))]
    lines += [("say", "w", {"stopReason": s}) for s in stops] + [("alien", "compaction"), ("raw", "{ torn"), ("raw", "7")]
    got = scripted({"S1": lines}).typed()
    kinds = ["user", "system", "lifecycle", "lifecycle", "meta", "tool_result", "raw", "raw"] + ["assistant"] * len(stops) + ["meta", "raw", "raw"]
    assert [e.kind for e in got] == kinds
    assert [e.stop for e in got if e.kind == "assistant"] == list(stops.values())
    assert [e.content for e in got[-2:]] == ["{ torn", "7"]


def test_contents_follow_their_blocks(scripted) -> None:
    blocks = {"text": {"type": "text", "text": "αβ"}, "empty": {"type": "text", "text": ""}, "image": {"type": "image", "data": "Zg"}, "new": {"type": "hologram", "depth": 2}}
    shapes = [list(c) for n in range(4) for c in itertools.product(blocks, repeat=n)]
    lines = [("get", ("t", [blocks[b] for b in s])) for s in shapes] + [("say", [blocks[b] for b in s]) for s in shapes]
    lines += [("get", ("t", "[not, a list]")), ("get", ("t", None)), ("say", [], {"content": "plain words"})]
    got = scripted({"S1": lines}).typed()
    for shape, e in zip(shapes, got, strict=False):
        texts = [blocks[b].get("text") for b in shape]
        assert (e.content if all(t is not None for t in texts) else json.loads(e.content)) == ("\n".join(texts) if all(t is not None for t in texts) else [blocks[b] for b in shape])
    for shape, e in zip(shapes, got[len(shapes):], strict=False):
        assert e.content == "\n".join(blocks[b]["text"] for b in shape if "text" in blocks[b])
        assert e.unknown_blocks == sum(b == "new" for b in shape)
    assert [e.content for e in got[-3:]] == ["[not, a list]", "", "plain words"]


def test_what_a_page_read_gave(scripted) -> None:
    """Tool, error flag, status line, download and overflow notices in every combination."""
    cases, lines = list(itertools.product(("webfetch", "lookup"), (False, True), ("", "\nHTTP 500 gone", "\n\nHTTP 500 in prose"), (None, 0, 12), (False, True))), []
    for i, (tool, failed, status, size, kept) in enumerate(cases):
        body = f"<web-citation id=\"{i}\" />{status}\nrest"
        if size is not None:
            body += f"\nDownloaded to: /h/sessions/2025-02-03_S1/tmp/f{i}.bin\nMIME type: x/y\nFile size: {size} bytes"
        if kept:
            body = f"[Output too large (2KB). Full output saved to: /h/k{i}.txt — read it with care]\n\nPreview (first 1KB):\n{body}"
        lines.append(("get", (tool, body), {"isError": failed, "details": {"sources": [{"id": f"i{i}", "url": f"https://p.test/{i}"}]}}))
    made = scripted({"S1": lines})
    for (tool, failed, status, size, kept), e in zip(cases, made.typed(), strict=True):
        refused = status == "\nHTTP 500 gone"
        opened = tool == "webfetch" and not failed and not refused
        saved = "" if tool != "webfetch" else (f"/h/sessions/2025-02-03_S1/tmp/f{e['index']}.bin" if size and not refused else "") if size is not None else f"/h/k{e['index']}.txt" if kept and not refused else ""
        (s,) = e.sources
        assert (s.opened, s.holds_page, s.saved_path) == (opened, opened and size is None, saved)
    owned = {r["index"] for r in events.downloads(made.events).collect()}
    assert owned == {i for i, (tool, failed, status, size, kept) in enumerate(cases) if tool == "webfetch" and size and status != "\nHTTP 500 gone"}


@pytest.mark.parametrize("path,inside", [("/u/sessions/2025-02-03_S1/tmp/a.pdf", True), ("/u/sessions/2025-02-03_S2/tmp/a.pdf", False), ("/u/x_S1/sessions/2025-02-03_S2/a.pdf", False),
                                         ("/u/other_S1/a.pdf", False), ("/u/sessions/2025-02-03_S1/../b/a.pdf", False), ("sessions/2025-02-03_S1/a.pdf", True)])
def test_a_download_lies_in_its_sessions_folder(scripted, path, inside) -> None:
    line = ("get", ("webfetch", f"<web-citation id=\"1\" />\n\nDownloaded to: {path}\nMIME type: a/b\nFile size: 9 bytes"), {"details": {"sources": [{"id": "1", "url": "https://p.test/"}]}})
    assert events.downloads(scripted({"S1": [line]}).events).count() == inside


def test_browser_pages_are_read_off_its_print(scripted) -> None:
    shown = [(f"https://tab.test/{i}({i})", f"Seite {i} → x") for i in range(3)]
    body = "\n".join([f'- title: "{shown[0][1]}" [url={shown[0][0]}]', "  a line page → No (https://not.test/)", f"✔︎ Opened a tab, page → {shown[1][1]} ({shown[1][0]})",
                      f"✔ Opened it again, page → {shown[1][1]} ({shown[1][0]})", f'- title: "{shown[2][1]}" [url={shown[2][0]}]'])
    made = scripted({"S1": [("get", ("repl", body)), ("get", ("webfetch", body))]})
    assert [(r.url, r.title) for r in events.browser_pages(made.events).orderBy("pos").collect()] == shown


def test_calls_tell_what_they_reach_for(scripted) -> None:
    calls = [("a", {"description": " two\n words "}), ("b", {"url": "https://u:p@www.Host.test:8/x"}), ("c", {"objective": "goal", "url": None}), ("d", {}), ("b", {"url": "https://www.host.test/"}), ("d", {"n": 1})]
    made = scripted({"S1": [("use", calls), ("say", "done")]})
    assert [(r.name, r.target) for r in events.tool_calls(made.events).orderBy("pos").collect()] == [
        ("a", "two words"), ("b", "www.host.test"), ("c", "goal"), ("d", ""), ("b", "www.host.test"), ("d", "")]
    assert logs.tool_usage_progress(made.events).first().usage == "a×1[two words] b×2[www.host.test, www.host.test] c×1[goal] d×2"
    assert {r.name: r.calls for r in audit.known_tools_audit(made.events, ["a"]).collect()} == {"b": 2, "c": 1, "d": 2}


# --- turns: a plain state machine beside the library ---


def random_session(rng: random.Random, framed: bool) -> list[tuple]:
    lines: list[tuple] = []
    for n in range(rng.randint(0, 4)):
        if framed:
            lines.append(("mark", "started"))
        lines.append(("ask", f"prompt {n}"))
        for _ in range(rng.randint(0, 3)):
            lines.append(rng.choice([("use", [("t", {})]), ("get", ("t", "r")), ("note", "n"), ("say", "half", {"stopReason": "toolUse"}), ("alien", "odd")]))
        end = rng.choice(["answer", "fail", "open", "ask again"])
        if end == "answer":
            lines.append(("say", f"answer {n}"))
        elif end == "fail":
            lines.append(("say", "", {"stopReason": "error", "errorMessage": "quota"}))
        elif end == "ask again" and framed:
            lines.append(("ask", "more of the same turn"))
        if framed and end != "open" and rng.random() < 0.8:
            lines += [("mark", "final-started"), ("mark", "finished")]
    return lines


def plain_turns(lines: list[tuple]) -> tuple[list[int], dict[int, dict]]:
    number, frame, numbers, by = 0, None, [], {}
    for i, (kind, value, *more) in enumerate(lines):
        if kind == "mark" and value == "started" or kind == "ask" and frame in (None, "finished"):
            number += 1
        if kind == "mark":
            frame = value
        numbers.append(number)
        turn = by.setdefault(number, {"frames": [], "spoken": None, "prompt": None, "end": None})
        if kind == "mark":
            turn["frames"].append(value)
        if kind in ("ask", "use", "say", "get"):
            turn["spoken"] = more[0]["stopReason"] if more and "stopReason" in more[0] else {"say": "stop"}.get(kind, "no")
        if kind == "ask" and turn["prompt"] is None:
            turn["prompt"] = i
        if kind == "say" and not more:
            turn["end"] = i
    return numbers, by


def test_turns_equal_a_state_machine(scripted) -> None:
    rng = random.Random(8)
    sessions = {f"S{i}": random_session(rng, i % 2 == 0) for i in range(60)}
    made = scripted(sessions)
    numbers = {}
    for e in made.typed():
        numbers.setdefault(e.session_id, []).append(e.turn_no)
    got = {(r.session_id, r.turn_no): r for r in made.turns.collect()}
    busy = {r.session_id: r.busy for r in turns.session_busy(made.turns).collect()}
    for name, lines in sessions.items():
        want, by = plain_turns(lines)
        assert numbers.get(name, []) == want
        for n, turn in by.items():
            r = got[name, n]
            finished = turn["frames"][-1] == "finished" if turn["frames"] else turn["spoken"] in ("stop", "error")
            assert (r.prompt_index, r.last_end_index, r.finished, r.failed) == (turn["prompt"], turn["end"], finished, turn["spoken"] == "error")
        if lines:
            last = max(by)
            assert busy[name] == (last > 0 and not got[name, last].finished)


def test_sessions_list_and_status(scripted, table) -> None:
    made = scripted({f"S{i}": [("ask", f"topic {i % 2} {marker('r' + str(i)) if i < 4 else ''}"), ("say", "ok")] for i in range(6)}, start={f"S{i}": 10_000 * i for i in range(6)})
    assert [r.session_id for r in turns.sessions_list(made.events, made.turns, limit=3).collect()] == ["S5", "S4", "S3"]
    mine = turns.sessions_list(made.events, made.turns, mine=True, search="topic 1").collect()
    assert [(r.session_id, r.run_id) for r in mine] == [("S3", "r3"), ("S1", "r1")]
    status = table("session_id string, status string", [("S0", "running"), ("S1", "idle")])
    busy = {r.session_id: (r.busy, r.reason) for r in turns.session_busy(made.turns, status).collect()}
    assert busy["S0"] == (True, "it is still working") and busy["S1"] == (False, "")


# --- runs and children ---


def test_a_marker_names_one_run_whole(scripted) -> None:
    made = scripted({"S1": [("ask", f"x {marker('r-1')}"), ("say", "one"), ("ask", f"y {marker('r-12')}"), ("say", "two")]}, ["r-1", "r-12", "r-123"])
    assert {r.run_id: r.answer for r in made.answers.collect()} == {"r-1": "one", "r-12": "two"}
    assert {(r.run_id, r["index"]) for r in made.own.collect()} == {("r-1", 0), ("r-1", 1), ("r-12", 2), ("r-12", 3)}


def test_children_belong_by_time(scripted) -> None:
    """Parents' turns and children's tasks at random times, against the rule said plainly."""
    rng = random.Random(4)
    sessions, start, runs, asked, given = {}, {}, [], {}, {}
    for p in range(12):
        lines, at = [], 1_000_000 * (p + 1)
        name = f"P{p}"
        kids = [f"K{p}x{k}" for k in range(3)]
        for t in range(3):
            run = f"{name}-{t}"
            runs.append(run)
            named = [k for k in kids if rng.random() < 0.7]
            asked[run] = {"start": at + 1000 * len(lines), "parent": name, "turn": t, "named": named}
            lines += [("ask", f"go {marker(run)}"), ("get", ("spawn", "ok"), {"details": {"taskIds": named}})] + [("note", "wait")] * rng.randint(1, 4) + [("say", "end")]
        sessions[name], start[name] = lines, at
        for k in kids:
            tasks, clock = [], at + 500 + 1000 * rng.randint(0, len(lines))
            start[k] = clock
            for n in range(rng.randint(0, 3)):
                tasks += [("ask", f"task {n}"), ("say", f"{k} did {n}")] if rng.random() < 0.7 else [("ask", f"task {n}"), ("use", [("t", {})])]
            sessions[k] = tasks
            opened = [clock + 1000 * i for i, line in enumerate(tasks) if line[0] == "ask"]
            done = [tasks[i + 1][0] == "say" for i, line in enumerate(tasks) if line[0] == "ask"]
            given[k] = list(zip(range(1, len(opened) + 1), opened, done, strict=True))
    made = scripted(sessions, runs, start)
    want, orphans = set(), set()
    for run, a in asked.items():
        following = asked.get(f"{a['parent']}-{a['turn'] + 1}")
        until = following["start"] if following else float("inf")
        for k in a["named"]:
            inside = [g for g in given[k] if a["start"] <= g[1] < until]
            mine = inside or [g for g in given[k] if g[1] < until][-1:]
            want |= {(run, k, g[0], g is mine[-1]) for g in mine}
            if not mine or not mine[-1][2]:
                orphans.add((run, k))
    assert {(r.run_id, r.child_id, r.turn_no, r.last_task) for r in made.tasks.collect()} == want
    assert {(r.run_id, r.child_id) for r in made.orphans.collect()} == orphans
    done = {(r.run_id, r.child_id): r.answer for r in made.child_answers.collect()}
    assert done == {(run, k): f"{k} did {n - 1}" for run, k, n, last in want if last and (run, k) not in orphans}


def test_two_children_of_one_record_stay_apart_however_long(scripted) -> None:
    """One record names two children; the first one's records reach past a chunk. Numbers follow child, then record."""
    fetch = lambda u: ("get", ("webfetch", "<web-citation id=\"1\" />\n\npage"), {"details": {"sources": [{"id": u, "url": f"https://{u}.test/"}]}})
    first = [("ask", "one"), fetch("early"), *[("note", "x")] * 4200, fetch("late"), ("say", "A done")]
    sessions = {"P": [("ask", marker("r")), ("get", ("wait", "ok"), {"details": {"taskIds": ["KA", "KB"]}}), ("say", "all")], "KA": first, "KB": [("ask", "two"), fetch("other"), ("say", "B done")]}
    made = scripted(sessions, ["r"], {"P": 1_000_000, "KA": 1_001_000, "KB": 1_001_000})
    assert [r.url for r in evidence.merge_sources(made.scoped).orderBy("n").collect()] == ["https://early.test/", "https://late.test/", "https://other.test/"]
    lines = [r.line for r in logs.log_lines(made.scoped).filter(F.col("line").contains("answer")).orderBy("line_no").collect()]
    assert lines == ["answer: all", "[child KA] answer: A done", "[child KB] answer: B done"]
    whole = evidence.answer_with_children(made.answers, made.child_answers).collect()
    assert [r.answer for r in whole] == ["all\n\n--- child KA ---\nA done\n\n--- child KB ---\nB done"]


def test_run_references(table) -> None:
    ids = [f"2501{d:02d}-{n}" for d in range(1, 4) for n in ("a", "ab", "b")]
    runs = table("run_id string, group string, created_at bigint", [(i, None, n) for n, i in enumerate(ids)])
    refs = ["250101-a", "250102-b", "250103", "2501", "25", "none", "250101-ab"]
    got: dict[str, list] = {}
    for r in turns.resolve_run_ref(runs, table("ref string", [(r,) for r in refs]), candidates=4).collect():
        got.setdefault(r.ref, []).append((r.run_id, r.verdict, r.n))
    for ref in refs:
        begun = sorted(i for i in ids if i.startswith(ref))
        if ref in ids:
            assert got[ref] == [(ref, "exact", len(begun))]
        elif not begun:
            assert got[ref] == [(None, "unknown", 0)]
        else:
            assert sorted(got[ref]) == [(i, "prefix" if len(begun) == 1 else "candidate", len(begun)) for i in begun[:4]]
    assert [r.run_id for r in turns.recent_runs(runs, 2).collect()] == ids[:-3:-1]
    grouped = table("run_id string, group string, created_at bigint", [("a", "g", 1), ("b", "g", 5), ("c", None, 3), ("d", "h", 4)])
    assert sorted(r.run_id for r in turns.latest_group(grouped).collect()) == ["a", "b"]


# --- evidence ---


def test_usage_adds_up_over_children(scripted) -> None:
    spent = lambda n: {"usage": {"input": n, "output": 2 * n, "totalTokens": 3 * n, "cost": {"total": n / 4}}}
    made = scripted({"P": [("ask", marker("r")), ("use", [("s", {})], spent(5)), ("get", ("s", ""), {"details": {"taskId": "K"}}), ("say", "x", spent(7))], "K": [("ask", "t"), ("say", "y", spent(11))]},
                    ["r"], {"K": 1_002_500})
    r = evidence.usage_totals(made.scoped).first()
    assert (r.input, r.output, r.total_tokens, r.cost) == (23, 46, 69, 23 / 4)


def test_sources_merge_and_keep_the_best_text(scripted) -> None:
    listed = lambda **s: {"details": {"sources": [s]}}
    page = lambda body, **s: ("get", ("webfetch", f"<web-citation id=\"q\" />\n\n{body}"), listed(**s))
    lines = [("ask", marker("r")), ("get", ("search", "hits"), {"details": {"sources": [{"id": "1", "url": "https://a.test/", "excerpt": "from the list"}, {"id": "2", "url": "https://b.test/", "title": "B"}]}}),
             page("short", id="3", url="https://b.test/"), page("a much longer page", id="4", url="https://b.test/", title="later"), page("  \n", id="5", url="https://a.test/"),
             ("get", ("search", "says so"), listed(id="6", url="https://c.test/")), ("say", "x")]
    made = scripted({"P": lines}, ["r"])
    merged = evidence.merge_sources(made.scoped)
    assert [(r.n, r.url, r.title, r.opened) for r in merged.orderBy("n").collect()] == [(0, "https://a.test/", "", True), (1, "https://b.test/", "B", True), (2, "https://c.test/", "", False)]
    assert tuple(evidence.source_summary(merged).first()) == ("r", 3, 2)
    text = {r.url: r.content.split("\n")[-1] for r in evidence.source_content(made.scoped).collect()}
    assert text == {"https://a.test/": "from the list", "https://b.test/": "a much longer page", "https://c.test/": "says so"}
    assert {(r.url, r.id) for r in evidence.source_ids(made.scoped).collect()} == {(f"https://{u}.test/", i) for u, i in ("a1", "a5", "b2", "b3", "b4", "c6")}
    assert [(r.no, r.tool_name) for r in evidence.tool_result_no(made.own).orderBy("no").collect()] == list(enumerate(["search", "webfetch", "webfetch", "webfetch", "search"]))


def test_citations_resolve_inside_out(table) -> None:
    """Answers are built together with what they must become."""
    rng = random.Random(6)
    known = {f"k{i}": f"https://cite.test/{i}" for i in range(4)}

    def built(depth: int) -> tuple[str, str]:
        inner = [built(depth - 1) if depth and rng.random() < 0.5 else (w, w) for w in rng.sample(["north", "südlich", "a < b", "x"], rng.randint(1, 2))]
        held, shown = " ".join(a for a, _ in inner), " ".join(b for _, b in inner)
        ids = rng.sample([*known, "lost"], rng.randint(1, 2))
        name = rng.choice(["citation", "quote"])
        urls = [known[i] for i in ids if i in known]
        fresh = [u for u in urls if not any(f"{a}{u}{b}" in shown for a in "(, " for b in ",)")]
        return f'<{name} {rng.choice(["refs", "ref", "source"])}="{", ".join(ids)}">{held}</{name}>', f"{shown} ({', '.join(fresh)})" if fresh else shown

    cases = [built(2) for _ in range(80)] + [("no tags & none", "no tags & none"), ("<citation refs=\"k1\">never closed", "<citation refs=\"k1\">never closed")]
    rows = table("run_id string, answer string", [(str(i), a) for i, (a, _) in enumerate(cases)])
    ids = table("run_id string, url string, id string", [(str(i), u, k) for i in range(len(cases)) for k, u in known.items()])
    got = {r.run_id: r.answer for r in answers.resolve_citations(rows, ids).collect()}
    assert [got[str(i)] for i in range(len(cases))] == [b for _, b in cases]


NAMES = ["plain.csv", "with blank.txt", "deep/er/path.md", "한글 보고서.pdf", "per%cent.txt", "q-" + "가" * 80 + ".pdf", "a.b.c"]


def test_mentions_of_saved_files(table) -> None:
    """Every name in every way of writing it, between every pair of neighbours; near misses differ by one sign behind the name."""
    from urllib.parse import quote
    rows, want = [], set()
    for n, name in enumerate(NAMES):
        for f, form in enumerate(dict.fromkeys([name, name.replace(" ", "%20"), quote(name, safe="/-_.*")])):
            for h, head in enumerate(["artifacts/", "sandbox:artifacts/", "/u/sessions/2025-01-01_OTHER/artifacts/"]):
                for b, (left, right) in enumerate([("see ", " there"), ("(", ")"), ("", ""), ('"', '"'), ("", ". Next")]):
                    run = f"{n}.{f}.{h}.{b}"
                    rows.append((run, "MINE", f"{left}{head}{form}{right}"))
                    want.add((run, "OTHER" if h == 2 else "MINE", name))
            rows += [(f"{n}.{f}.miss{i}", "MINE", f"see artifacts/{form}{tail}") for i, tail in enumerate(["x", "/more", "-2", ".bak", "%20"])]
            rows.append((f"{n}.{f}.glued", "MINE", f"myartifacts/{form}"))
    said = table("run_id string, author string, answer string", rows)
    files = table("session_id string, rel_path string", [(s, n) for s in ("MINE", "OTHER") for n in NAMES])
    assert {(r.run_id, r.session_id, r.rel_path) for r in answers.referenced_artifacts(said, files).collect()} == want
    only = {(r.run_id, r.rel_path) for r in answers.referenced_artifacts(said, files, absolute_only=True).collect()}
    assert only == {(run, name) for run, owner, name in want if owner == "OTHER"}
    refs = answers.artifact_mentions(said, files).select("run_id", "written", F.concat(F.lit("/copy/"), "rel_path").alias("copy"))
    changed = {r.run_id: r.answer for r in answers.rewrite_artifact_refs(said.select("run_id", "answer"), refs).collect()}
    named = {run: name for run, _, name in want}
    for run, _, answer in rows:
        assert (changed[run] == answer) == (run not in named)
        assert run not in named or f"/copy/{named[run]}" in changed[run]


def test_files_go_to_the_turn_they_were_written_in(scripted, table) -> None:
    made = scripted({"P": [("ask", marker("r1")), ("say", "a"), ("ask", marker("r2")), ("say", "b")]}, ["r1", "r2"])
    files = table("session_id string, rel_path string, path string, mtime bigint", [("P", f"f{i}", f"/f{i}", at) for i, at in enumerate([999_999, 1_000_000, 1_001_999, 1_002_000, 9_000_000_000])])
    owned = turns.artifact_turn(files, made.turns)
    assert {r.rel_path: r.turn_no for r in owned.collect()} == {"f0": 0, "f1": 1, "f2": 1, "f3": 2, "f4": 2}
    named = table("run_id string, session_id string, rel_path string", [("r2", "P", "f1"), ("r1", "P", "f4"), ("r1", "P", "f1")])
    got = {(r.run_id, r.rel_path): r.error for r in turns.run_artifacts(made.run_turns, owned, named).collect()}
    assert got == {("r1", "f1"): None, ("r1", "f2"): None, ("r2", "f3"): None, ("r2", "f4"): None, ("r2", "f1"): None, ("r1", "f4"): "changed after a later turn began"}


# --- verdicts ---


def plain_state(now: int, r: dict) -> str:
    found, over = r["turn_no"] is not None, r["turn_no"] is not None and bool(r["finished"])
    if r["recorded"]:
        return r["recorded"]
    if over and r["failed"]:
        return "failed"
    if r["exit_code"] and not r["ended_by_supervisor"] and (over or not found):
        return "failed"
    if over:
        return "completed_with_orphans" if r["orphans"] else "completed"
    if not r["supervised"]:
        return "abandoned" if now - r["created_at"] > 60_000 else "starting"
    if not found and r["exit_code"] is not None:
        return "completed_unstructured"
    if not r["alive"]:
        return "abandoned"
    return "abandoned" if now - (r["last"] or r["created_at"]) > 600_000 else "running"


def test_states_over_all_facts(table) -> None:
    now, rows = 10_000_000, []
    facts = itertools.product((None, "completed"), (True, False), (True, False), (None, 0, 3), (True, False), (None, (1, False, False), (1, True, False), (1, True, True)), (0, 2), (None, now - 1, now - 700_000),
                              (now - 1000, now - 100_000, now - 900_000))
    for i, (recorded, supervised, alive, code, by, turn, orphans, last, created) in enumerate(facts):
        no, finished, failed = turn or (None, None, None)
        rows.append({"run_id": str(i), "recorded": recorded, "supervised": supervised, "alive": alive, "exit_code": code, "ended_by_supervisor": by, "turn_no": no, "finished": finished, "failed": failed,
                     "orphans": orphans, "last": last, "created_at": created})
    runs = table("run_id string, created_at bigint, supervised boolean, alive boolean, exit_code int, ended_by_supervisor boolean, recorded string, reason string, turn_no bigint, finished boolean, failed boolean, "
                 "error string", rows)
    activity = table("run_id string, last_ts bigint", [(r["run_id"], r["last"]) for r in rows if r["last"]])
    orphans = table("run_id string, child_id string", [(r["run_id"], f"k{i}") for r in rows for i in range(r["orphans"])])
    got = {r.run_id: r.state for r in states.run_state(runs, activity, orphans, F.lit(now)).collect()}
    assert [got[r["run_id"]] for r in rows] == [plain_state(now, r) for r in rows]


def test_group_verdicts(table) -> None:
    members = [("completed", False), ("completed", True), ("failed", True), ("abandoned", False), ("running", True)]
    groups = [c for n in (1, 2) for c in itertools.combinations_with_replacement(members, n)]
    rows = table("group string, state string, empty boolean", [(str(i), *m) for i, g in enumerate(groups) for m in g])
    got = {r.group: (r.verdict, r.going) for r in states.group_verdict(rows).collect()}
    for i, g in enumerate(groups):
        bad, going = any(s in ("failed", "abandoned") for s, _ in g), any(s == "running" for s, _ in g)
        assert got[str(i)] == (4 if bad else 5 if all(e and s != "running" for s, e in g) else 0, going)


def test_a_record_too_large_to_read_is_shown_and_counted(table, scripted, monkeypatch) -> None:
    monkeypatch.setattr(events, "VARIANT_BYTES", 40)
    typed = events.normalize_events(table("session_id string, index bigint, raw string", [("s", 0, "not json " * 9), ("s", 1, "short"), ("s", 2, '{"role": "user", "content": "' + "x" * 90 + '"}')]))
    assert [r.kind for r in typed.orderBy("index").collect()] == ["oversized", "raw", "user"]
    assert audit.unread_records(typed).first().unread == 2
    counts = audit.session_kinds(typed).first()
    assert (counts.oversized, counts.raw, counts.user) == (1, 1, 1)
    scoped = typed.selectExpr("*", "'r' as run_id", "'' as child_id", "-1L as stream")
    assert states.unread_note(scoped).first().unread == 2
    assert [r.line.split("]")[0] for r in logs.log_lines(scoped, "steps").orderBy("line_no").collect()][:2] == ["oversized[0", "raw[1"]


def test_empty_and_unread(table, scripted) -> None:
    rows = table("run_id string, answer string, sources_total bigint", [("a", " \n", None), ("b", "nothing was found", 0), ("c", None, 2), ("d", None, 0)])
    assert {r.run_id for r in states.empty_result(rows).filter("empty").collect()} == {"a", "d"}
    made = scripted({"P": [("ask", marker("r")), ("alien", "beta"), ("raw", "?"), ("say", "x")], "Q": [("ask", marker("s")), ("alien", "beta")], "T": [("ask", marker("u"))]}, ["r", "s", "u"])
    assert {r.run_id: r.note for r in states.unread_note(made.scoped).collect()} == {"r": "2 records in this run's transcript could not be read", "s": "1 record in this run's transcript could not be read"}


def test_bursts_equal_a_plain_split(table) -> None:
    """One user has most of a day, one only null keys, times tie; all like a walk over the sorted times."""
    rng = random.Random(2)
    rows = [(u, t, i) for i, (u, t) in enumerate([(rng.choice(["busy", "busy", "busy", "b", None]), rng.randrange(0, 3 * 86_400_000, 50_000)) for _ in range(900)])]
    got = {(r.user_id, r.start_ts, r.end_ts, r.n) for r in states.activity_sessions(table("user_id string, ts bigint, event_id bigint", rows), 600_000).collect()}
    want, last = set(), {}
    for u in ("busy", "b", None):
        burst: list[int] = []
        for t in [*sorted(t for v, t, _ in rows if v == u), float("inf")]:
            if burst and t - burst[-1] >= 600_000:
                want.add((u, burst[0], burst[-1], len(burst)))
                burst = []
            burst.append(t)
    assert got == want and not last


# --- logs ---


def test_log_levels(scripted) -> None:
    long = "first line\n" + "z" * 2500
    lines = [("mark", "started"), ("note", "sys one\nsys two"), ("ask", f"{'p' * 250} {marker('r')}"), ("use", [("look", {"objective": "owls", "n": 1})]), ("get", ("look", long), {"details": {"sources": [{"id": "1", "url": "https://o.test/"}]}}),
             ("get", ("look", "bad"), {"isError": True}), ("say", "closing words\nand more"), ("mark", "finished"), ("meta", None)]
    made = scripted({"P": lines}, ["r"])
    read = lambda level, **o: [r.line for r in logs.log_lines(made.scoped, level, **o).orderBy("line_no").collect()]
    prompt = f"{'p' * 250} {marker('r')}"
    assert read("progress") == [f"prompt: {'p' * 200} …(+{len(prompt) - 200})", "look×1[owls]", "look ERROR: bad", "answer: closing words …(+9)"]
    steps = read("steps")
    assert steps[0] == f"user: {'p' * 200}…(+{len(prompt) - 200})" and steps[1] == 'call look({"objective": "owls", "n": 1})'
    assert steps[2:] == ["#0 look out=2511B sources=1", "#1 look ERROR out=3B", "closing words", "and more", "turn finished"]
    full = read("full")
    assert f"{'z' * (2000 - 11)}…(+511)" in full and prompt.split("\n")[0] in full[0]
    assert [json.loads(x)["role"] for x in read("raw")] == ["user", "assistant", "toolResult", "toolResult", "assistant", "turn-lifecycle"]
    assert read("progress", widths=logs.Widths(prompt=7))[0].startswith("prompt: ppppppp …(+")
    with pytest.raises(ValueError):
        logs.log_lines(made.scoped, "chatty")


# --- files ---


def test_transcripts_are_cut_at_line_feeds_alone(spark, tmp_path) -> None:
    rng = random.Random(1)
    want = {}
    for name in ("Aa1", "Bb2"):
        folder = tmp_path / f"2025-03-04_{name}"
        folder.mkdir()
        kept = [json.dumps({"role": "user", "content": rng.choice(["x", "a\u0085b", " ", "é" * rng.randint(1, 400)])}, ensure_ascii=False) for _ in range(300)]
        with_blanks = "".join(k + "\n" + rng.choice(["", "\n", "  \n"]) for k in kept)
        (folder / "messages.jsonl").write_bytes((with_blanks + '{"role": "to').encode())
        want[name] = kept
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16k")
    try:
        got = transcripts.scan_transcripts(spark, str(tmp_path)).orderBy("session_id", "index").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert {n: [r.raw for r in got if r.session_id == n] for n in want} == want
    for r in got:
        data = (tmp_path / f"2025-03-04_{r.session_id}" / "messages.jsonl").read_bytes()
        assert data[r.byte_start:].decode("utf-8", "ignore").startswith(r.raw)


def test_records_are_the_same_however_files_are_split_and_when_that_changes(spark, tmp_path, monkeypatch) -> None:
    """Blocks of one scan only: the size of a split changes right after the lines were read."""
    rng = random.Random(6)
    want = {}
    for s in range(3):
        lines = ["" if rng.random() < 0.1 else f"{i} " + "é" * rng.randint(0, 60) for i in range(400 * (s + 1))]
        (tmp_path / f"2025-03-04_T{s}").mkdir()
        (tmp_path / f"2025-03-04_T{s}" / "messages.jsonl").write_text("\n".join(lines) + "\nnot ended")
        at = n = 0
        for line in lines:
            if line:
                want[f"T{s}", n] = (at, line)
                n += 1
            at += len(line.encode()) + 1
    size, least = "spark.sql.files.maxPartitionBytes", "spark.sql.files.minPartitionNum"
    was, written = spark.conf.get(size), transcripts.stored

    def moving(df, name, **options):
        out = written(df, name, **options)
        spark.conf.set(size, "20000")
        spark.conf.set(least, "1")
        return out
    monkeypatch.setattr(transcripts, "stored", moving)
    try:
        for bytes_, parts in ((4000, 8), (50_000, 1)):
            spark.conf.set(size, str(bytes_))
            spark.conf.set(least, str(parts))
            got = {(r.session_id, r["index"]): (r.byte_start, r.raw) for r in transcripts.scan_transcripts(spark, str(tmp_path)).collect()}
            assert got == want
    finally:
        spark.conf.set(size, was)
        spark.conf.unset(least)


def test_printed_answers(spark, tmp_path) -> None:
    dim = lambda s: f"\x1b[2m{s}\x1b[0m"
    logs_ = {"plain": "  only\nwords \n", "tools": f"get(https://t.test/1,) {dim('out')} go https://t.test/2\n{dim('more')}\n\x1b[1mFinal\x1b[0m words\n", "silent": dim("nothing after")}
    for name, text in logs_.items():
        (tmp_path / name).mkdir()
        (tmp_path / name / "stdout.log").write_text(text)
    got = {r.run_id: (r.answer, r.urls) for r in transcripts.scan_stdout_answer(spark, str(tmp_path)).collect()}
    assert got == {"plain": ("only\nwords", []), "tools": ("Final words", ["https://t.test/1", "https://t.test/2"]), "silent": ("", [])}


def test_saved_files_without_links(spark, tmp_path) -> None:
    home = tmp_path / "2025-03-04_Zz9" / "artifacts"
    (home / "sub").mkdir(parents=True)
    (home / "sub" / "two words.txt").write_text("12345")
    (home / "one").write_text("1")
    (tmp_path / "2025-03-04_Zz9" / "notes.txt").write_text("not saved")
    (home / "link").symlink_to(home / "one")
    (home / "sub" / "deep" / "er").mkdir(parents=True)
    (home / "sub" / "deep" / "er" / "_x").write_text("123")
    (home / ".hidden").write_text("12")
    (home / "_empty").touch()
    (home / "away").symlink_to(tmp_path)
    got = {(r.session_id, r.rel_path, r.length) for r in transcripts.scan_artifacts(spark, str(tmp_path)).collect()}
    assert got == {("Zz9", "sub/two words.txt", 5), ("Zz9", "one", 1), ("Zz9", "sub/deep/er/_x", 3), ("Zz9", ".hidden", 2), ("Zz9", "_empty", 0)}


# --- audits ---


def test_audits(scripted, table, spark) -> None:
    made = scripted({"S1": [("get", ("webfetch", f"[Output too large (1KB). Full output saved to: /k{i}]\n\nPreview (first 1KB):\nx"), {"timing": {"durationMs": 10.0 * i}, "isError": i == 2, "details": {"sources": [{"url": "https://a.test/"}]}}) for i in range(3)] + [("alien", "x")]})
    missing = audit.saved_path_audit(made.events, table("path string", [("/k0",), ("/k2",)]))
    assert [r.saved_path for r in missing.collect()] == ["/k1"]
    profile = {r.tool: r for r in audit.session_profile(made.events).collect()}
    assert (profile["webfetch"].results, profile["webfetch"].errors, profile["webfetch"].longest_ms, profile[None].median_ms) == (3, 1, 20.0, 10.0)
    kinds = audit.session_kinds(made.events).first()
    assert (kinds.tool_result, kinds.raw, kinds.span_ms) == (3, 1, 3000)
    assert audit.unread_records(made.events).first().unread == 1
    records = made.events.select("session_id", "index", "raw")
    assert audit.record_counts(records, made.events).count() == 0
    lost = audit.record_counts(records, made.events.filter("index <> 1")).first()
    assert (lost.records, lost.events) == (4, 3)


def test_a_record_is_typed_once_whatever_is_taken_of_it(spark, capsys) -> None:
    typed = events.normalize_events(spark.createDataFrame([("S", 0, "{}")], "session_id string, index bigint, raw string"))
    for taken in (events.downloads, events.tool_calls, events.child_ids):
        taken(typed).explain()
        plan = capsys.readouterr().out
        assert "try_variant_get" in plan
        assert not [line for line in plan.splitlines() if "Filter" in line and "try_variant_get" in line]


def test_a_tasks_share_of_a_table_does_not_grow_with_it(spark, tmp_path) -> None:
    from pagewright.plans.layout import spread
    parts = []
    for n in (400, 4000):
        spark.range(n).write.parquet(str(tmp_path / str(n)))
        dealt = spread(spark.read.parquet(str(tmp_path / str(n))), "id", 100)
        assert dealt.distinct().count() == n
        parts.append(dealt.rdd.getNumPartitions())
    assert parts == [max(4, spark.sparkContext.defaultParallelism), 40]


def test_many_folders_are_listed_in_few_batches(tmp_path) -> None:
    import pandas as pd
    for i in range(300):
        (tmp_path / f"s{i}" / "deep").mkdir(parents=True)
        (tmp_path / f"s{i}" / "deep" / "f.txt").write_text("x" * i)
    folders = pd.DataFrame({"folder": [str(tmp_path / f"s{i}") for i in range(300)], "rel": [f"/s{i}" for i in range(300)]})
    listed = list(transcripts._files(True)(iter([folders[:200], folders[200:]])))
    assert len(listed) == 1
    assert sorted(zip(listed[0]["rel"], listed[0]["length"], strict=True)) == sorted((f"/s{i}/deep/f.txt", i) for i in range(300))


def test_files_are_written_by_tasks_whole_and_in_order(spark, tmp_path) -> None:
    from pagewright.plans.scratch import write_files
    rows = spark.range(6000).selectExpr("concat(id % 7, '/f', id % 50, '.txt') AS file", "id", "concat('é', id, '\n') AS value")
    n = write_files(rows.repartition(5, "file").sortWithinPartitions("file", "id"), f"file:{tmp_path}/out")
    found = {str(p.relative_to(tmp_path / "out")): p.read_bytes().decode() for p in (tmp_path / "out").rglob("*.txt")}
    assert n == len(found) == 350
    assert found["3/f24.txt"] == "".join(f"é{i}\n" for i in range(6000) if i % 7 == 3 and i % 50 == 24)


def test_a_raw_line_says_whose_record_it_is(scripted) -> None:
    """Two children write the same record: each line is there once, with its own session, and no line is looked up by its text."""
    call = lambda child: ("get", ("agent", "spawned"), {"details": {"taskId": child}})
    kid = [("ask", "look", {"timestamp": 1_002_500}), ("say", "found", {"timestamp": 1_002_600})]
    made = scripted({"P": [("ask", f"go {marker('r')}"), call("K1"), call("K2"), ("say", "done")], "K1": kid, "K2": kid}, ["r"])
    rows = logs.log_lines(made.scoped, "raw", also=("session_id",)).orderBy("line_no").collect()
    assert [(r.line_no, r.session_id) for r in rows] == list(enumerate(["P"] * 4 + ["K1"] * 2 + ["K2"] * 2))
    assert len({r.line for r in rows}) == 6


def test_wide_rows_are_dealt_by_their_number(spark) -> None:
    from pagewright.plans.layout import dealt
    rows = spark.range(100)
    few = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert dealt(rows, ["id"], 100, 10).rdd.getNumPartitions() == 10 > few
    assert dealt(rows, ["id"], 10 * few, 10) is rows


def test_a_store_writes_what_its_query_reads(spark) -> None:
    from pagewright.plans.transcript_queries import TURNED, Store
    d = "/root/testdata/sf0.001"
    assert sorted(Store(spark, d, ("raw",)).events.columns) == sorted([*TURNED, "raw", "turn_no"])
    every = Store(spark, d)
    assert sorted(every.events.columns) == sorted([*every.typed.columns, "turn_no"])


def test_turns_runs_and_children_are_not_sent_to_the_driver(spark, scripted, sent) -> None:
    """They grow with the transcripts, and Spark takes a stored table for as small as its compressed files; all a plan sends are the numbers of copies."""
    lines = [("mark", "started"), ("ask", f"go {marker('r1')}"), ("get", ("subagent", "spawned"), {"details": {"taskId": "K1"}}), ("say", "done"), ("mark", "finished")]
    derived = scripted({"P1": lines, "K1": [("mark", "started"), ("ask", "task"), ("say", "did"), ("mark", "finished")]}, ["r1"], {"K1": 1_002_000})
    ids = stored(spark.createDataFrame([("r1",), ("r2",)], "run_id string"), "ids")
    prompts = turns.prompts_of(derived.events, derived.turns)
    joined = turns.run_session_join(ids, stored(prompts, "prompts"))
    timed = derived.run_turns.select("run_id", F.col("last_ts").alias("ended_ts"))
    children = stored(derived.tasks.select("run_id", "child_id", F.lit(0).cast("long").alias("finished_ts")), "children")
    settled = states.settle_window(timed, children, 500)
    tasks = turns.child_tasks(derived.run_turns, derived.named, derived.turns)
    plans = [turns.segment_turns(derived.events.select("session_id", "index", "kind", "lifecycle")), prompts, joined, turns.run_turns(stored(joined, "joined"), derived.turns), tasks, settled]
    assert not [part for plan in plans for part in sent(plan) if "Range (0" not in part or "FileScan" in part]
    assert [(r.run_id, r.child_id, r.last_task) for r in tasks.collect()] == [("r1", "K1", True)]
    assert [tuple(r) for r in settled.collect()] == [("r1", "K1", True)]
