"""Live runs beside plain models, and records cut anywhere."""
from __future__ import annotations

import random
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from pagewright.plans.stream_queries import drain
from pagewright.streaming import runs as live
from pagewright.streaming import transcripts as follow


# --- a transcript's bytes ---


def lines_of(whole: bytes) -> list[tuple[int, str]]:
    out, at = [], 0
    for line in whole.split(b"\n")[:-1]:
        if line.strip():
            out.append((at, line.decode()))
        at += len(line) + 1
    return out


def transcript(seed: int, n: int = 9) -> bytes:
    rng = random.Random(seed)
    lines = ["" if rng.random() < 0.15 else " é"[rng.randint(0, 1)] * rng.randint(0, 3) + f"r{i}" + "x" * rng.randint(0, 5) for i in range(n)]
    return "\n".join(lines).encode() + b"\n"


def test_a_record_cut_at_any_byte_comes_once_and_whole():
    whole = transcript(1)
    for cut in range(len(whole) + 1):
        first, read = follow.new_records([(0, whole[:cut])], []) if cut else ([], [])
        second, read = follow.new_records([(cut, whole[cut:])], read) if cut < len(whole) else ([], read)
        assert first + second == lines_of(whole)
        assert all(at + len(text.encode()) < cut for at, text in first)
        assert [(i.start, i.stop, i.head, i.tail) for i in read] == [(0, len(whole), None, b"")]


@pytest.mark.parametrize("seed", range(40))
def test_segments_of_any_cut_in_any_order_with_copies_give_each_record_once(seed):
    rng = random.Random(seed)
    whole = transcript(seed, 30) + rng.choice([b"", b"an unfinished line"])
    cuts = sorted({0, len(whole), *(rng.randint(0, len(whole)) for _ in range(rng.randint(0, 25)))})
    pieces = list(zip(cuts, cuts[1:]))
    pieces += [(a, min(len(whole), a + rng.randint(1, 40))) for a in (rng.randrange(len(whole)) for _ in range(6))]
    rng.shuffle(pieces)
    read, got, seen = [], [], set()
    while pieces:
        some, pieces = pieces[:3], pieces[3:]
        found, read = follow.new_records([(a, whole[a:b]) for a, b in some], read)
        got += found
        seen |= {i for a, b in some for i in range(a, b)}
        # what is whole and cannot be the end of an earlier line has come
        ready = {at for at, text in lines_of(whole) if set(range(max(at - 1, 0), at + len(text.encode()) + 1)) <= seen}
        assert ready <= {at for at, _ in got}
    assert sorted(got) == lines_of(whole) and len(read) == 1


def test_a_stream_of_cut_segments_over_restarts_and_a_copy_that_is_there(spark, tmp_path):
    rng = random.Random(5)
    source, copy, out = tmp_path / "in", tmp_path / "copy", str(tmp_path / "q")
    sessions = {f"S{i}": transcript(i + 70, 20) for i in range(5)}
    had = {"S0": 0, "S1": 17, "S2": len(sessions["S2"])}
    for s, n in had.items():
        (copy / f"2025-05-06_{s}").mkdir(parents=True)
        (copy / f"2025-05-06_{s}" / "messages.jsonl").write_bytes(sessions[s][:n])
    copied = follow.copied_so_far(spark, str(copy))
    assert {r.session_id: (r.stop, bytes(r.tail)) for r in copied.collect()} == {
        s: (n, sessions[s][:n].split(b"\n")[-1]) for s, n in had.items() if n}
    for turn in range(2):
        for s, whole in sessions.items():
            (source / f"2025-05-06_{s}").mkdir(parents=True, exist_ok=True)
            half = len(whole) // 2
            start, stop = ((0, half), (half, len(whole)))[turn]
            cuts = sorted({start, stop, *(rng.randint(start, stop) for _ in range(4))})
            for no, (a, b) in enumerate(zip(cuts, cuts[1:])):
                # a copy that got ahead, and goes on behind its own end
                b = min(len(whole), b + rng.choice([0, 0, 9]))
                (source / f"2025-05-06_{s}" / f"{a:06d}-{turn}{no}.jsonl").write_bytes(whole[a:b])
        got = drain(follow.stream_transcripts(spark, str(source), copied=copied), "append", out).collect()
    assert sorted((r.session_id, r.byte_start, r.raw) for r in got) == sorted(
        (s, at, text) for s, whole in sessions.items() for at, text in lines_of(whole) if at + len(text.encode()) >= had.get(s, 0))


# --- runs ---

IDLE, SETTLE = 100, 10


def record(session, ms, kind="assistant", lifecycle="", stop="", run_id="", names=(), parent="") -> SimpleNamespace:
    return SimpleNamespace(session=session, ms=ms, place=ms, at=None, kind="lifecycle" if lifecycle else kind, lifecycle=lifecycle, stop=stop, run_id=run_id,
                           child_ids=list(names), parent=parent)


def world(seed: int) -> list[SimpleNamespace]:
    """Records of parents, each with runs one after another, and of children they share; every time is another."""
    rng = random.Random(seed)
    rows, last, frames = [], 0, {}
    kids = [f"K{i}" for i in range(3)]
    for step in range(rng.randint(20, 90)):
        last += rng.choice([2, 3, 3, 6, 9, 40, 150, 400]) if rng.random() < 0.5 else 2
        who = rng.choice(["P1", "P2", *kids])
        framed = who != "P2"
        on = frames.get(who, False)
        if (not on or not framed) and rng.random() < (0.2 if on else 0.8):
            if framed:
                rows.append(record(who, last, lifecycle="started"))
                last += 1
            rows.append(record(who, last, kind="user", run_id=f"{who}-{step}" if who.startswith("P") and rng.random() < 0.9 else ""))
            frames[who] = True
        elif on and rng.random() < 0.3:
            rows.append(record(who, last, lifecycle="finished") if framed else record(who, last, stop="end"))
            frames[who] = False
        else:
            names = [rng.choice(kids)] if who.startswith("P") and rng.random() < 0.6 else []
            rows.append(record(who, last, kind="tool_result", names=names))
    return rows


def plain(rows: list[SimpleNamespace]) -> list[tuple]:
    """What happens to runs, from the whole history at once: each run's own records and, for each of its children, the records until another names it."""
    own, ended, turn = {}, {}, {}
    for r in rows:
        run, frame = turn.get(r.session, ("", ""))
        if r.lifecycle == "started":
            run, frame = "", "started"
        elif r.kind == "user" and frame in ("", "open", "finished"):
            run, frame = r.run_id, "open"
        elif r.kind == "user" and frame == "started":
            run, frame = r.run_id, "prompted"
        done = r.lifecycle == "finished" or (frame == "open" and r.stop == "end")
        r.run, r.done = run, done
        if run:
            own.setdefault(run, []).append(r)
            if done:
                ended[run] = r.ms
        turn[r.session] = ("", "finished") if done else (run, frame)
    named = sorted((r.ms, c, run) for run, rs in own.items() for r in rs for c in r.child_ids)
    out = []
    # a run's end depends on its children's and on what others name, so the runs are gone through by the clock
    alive, kids = {}, {}
    moments = sorted([(r.ms, r) for r in rows], key=lambda m: m[0])

    def close(run, verdict, at):
        left = sorted(c for c, x in kids.items() if x == run)
        for c in left:
            del kids[c]
            out.append((run, c, "orphan", at))
        out.append((run, None, "completed_with_orphans" if left and verdict == "completed" else verdict, at))
        del alive[run]

    def until(now):
        while True:
            late = sorted((ended[x] + SETTLE if alive[x] == "ended" else alive[x] + IDLE, x) for x in alive)
            if not late or late[0][0] >= now:
                return
            at, run = late[0]
            close(run, "completed" if alive[run] == "ended" else "abandoned", at)

    def settle(run, at):
        if run in alive and alive[run] == "ended" and run not in kids.values():
            close(run, "completed", at)

    for ms, r in moments:
        until(ms)
        if r.run:
            if r is own[r.run][0]:
                alive[r.run] = ms
            if r.run in alive:
                alive[r.run] = "ended" if r.done else ms
                for at, c, run in named:
                    if at == ms and run == r.run and kids.get(c) != run:
                        before = kids.get(c)
                        kids[c] = run
                        if before:
                            out.append((before, c, "orphan", ms))
                            settle(before, ms)
                        out.append((run, c, "named", ms))
                settle(r.run, ms)
        elif r.session in kids:
            run = kids[r.session]
            if alive[run] != "ended":
                alive[run] = ms
            if r.done:
                del kids[r.session]
                out.append((run, r.session, "settled", ms))
                settle(run, ms)
    until(10 ** 9)
    return out


def routed_rows(rows: list[SimpleNamespace]) -> dict[str, list]:
    """The first operator over all sessions at once."""
    by = {}
    for r in rows:
        by.setdefault(r.session, []).append(r)
        for c in r.child_ids:
            by.setdefault(c, []).append(SimpleNamespace(**{**vars(r), "parent": r.session, "child_ids": [], "run_id": ""}))
    out = {}
    for session, held in by.items():
        for root, at, ms, place, s, what, run_id, names in live.routed(session, live.Turn(), held):
            out.setdefault(root, []).append(SimpleNamespace(ms=ms, place=place, session_id=s, what=what, run_id=run_id, child_ids=names))
    return out


@pytest.mark.parametrize("seed", range(150))
def test_runs_equal_a_plain_model_in_any_batches(seed):
    """Children named by two parents are left to the stream's own tests: here each parent has children of its own."""
    rows = world(seed)
    for r in rows:
        r.child_ids = [f"{c}{r.session}" for c in r.child_ids]
        if r.session.startswith("K"):
            r.session += "P1" if seed % 2 else "P2"
    want = sorted(plain(rows), key=repr)
    rng, got = random.Random(seed), []
    for root, held in routed_rows(rows).items():
        held.sort(key=lambda r: (r.ms, r.session_id != root, r.place))
        runs, kids = {}, {}
        while held:
            n = rng.randint(1, 9)
            some, held = held[:n], held[n:]
            family = live.Family(IDLE, SETTLE, dict(runs), dict(kids))
            for r in some:
                family.take(root, r)
            counts = {}
            for run_id, child, what, ms, pending in family.out:
                got.append((run_id, child, what, ms))
                counts[run_id] = pending
            # pending is what was named less what has finished, after every batch
            for run_id, pending in counts.items():
                mine = [g for g in got if g[0] == run_id and g[1]]
                assert pending == sum(1 if g[2] == "named" else -1 for g in mine)
            runs, kids = family.runs, family.children
        family = live.Family(IDLE, SETTLE, runs, kids)
        family.expire(10 ** 9)
        assert not family.runs and not family.children
        got += [o[:4] for o in family.out]
    assert sorted(got, key=repr) == want


def test_a_stream_of_runs_equals_the_same_records_at_once(spark, tmp_path):
    """Sessions run at one time and are cut between batches; a session that runs far ahead ends no other's run; what is over leaves no state."""
    rows = []
    for p in range(6):
        family = world(1000 + p)
        for r in family:
            name = lambda s, p=p: f"{s}x{p}"
            rows.append((name(r.session), r.ms, r.kind, r.lifecycle, r.stop, f"(run-marker:{name(r.run_id)} — q)" if r.run_id else "", [name(c) for c in r.child_ids], r.ms))
    rows.sort(key=lambda r: r[7])
    schema = "session_id string, index long, kind string, lifecycle string, stop string, content string, child_ids array<string>, ms long"
    df = spark.createDataFrame(rows, schema).withColumn("seen_at", F.timestamp_millis("ms"))
    step = len(rows) // 4 + 1
    for i in range(0, len(rows), step):
        part = df.filter(F.col("ms").between(rows[i][7], rows[min(i + step, len(rows)) - 1][7]))
        if i:
            part = part.filter(F.col("ms") > rows[i - 1][7])
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    # a last record long after lets every timer fire
    spark.createDataFrame([("Z", 10 ** 7, "user", "", "", "", [], 10 ** 7)], schema).withColumn("seen_at", F.timestamp_millis("ms")).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = drain(live.stream_runs(stream, f"{IDLE} milliseconds", f"{SETTLE} milliseconds"), "append", str(tmp_path / "q"))
    want = []
    for root, held in routed_rows([SimpleNamespace(session=r[0], ms=r[7], place=r[1], at=None, kind=r[2], lifecycle=r[3], stop=r[4],
                                                   run_id=r[5][12:].split(" ")[0] if r[5] else "", child_ids=r[6], parent="") for r in rows]).items():
        family = live.Family(IDLE, SETTLE)
        for r in sorted(held, key=lambda r: (r.ms, r.session_id != root, r.session_id, r.place)):
            family.take(root, r)
        family.expire(10 ** 9)
        want += family.out
    assert want and sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want))
    counts = live.pending_children(got).collect()
    assert counts and all(r.pending == 0 for r in counts)
    assert {r.state for r in live.run_verdicts(got).collect()} <= {"completed", "completed_with_orphans", "abandoned"}


def test_a_session_costs_a_reading_and_a_writing_a_batch_and_is_remembered_from_its_last_record():
    """The router sets one timer for a session; when that is due and records came since, it is set anew and the turn stays."""
    calls, timers, kept = [], [], []
    state = SimpleNamespace(get=lambda: calls.append("get") or (kept[-1] if kept else None), update=lambda v: calls.append("update") or kept.append(v), clear=lambda: kept.clear())
    handle = SimpleNamespace(getValueState=lambda name, schema: state, registerTimer=timers.append)
    route = live._Route(100)
    route.init(handle)
    row = lambda ms, kind, run_id="": SimpleNamespace(at=ms, ms=ms, place=ms, kind=kind, lifecycle="", stop="", run_id=run_id, child_ids=None, parent="")
    assert [(r.what, r.run_id) for r in route.handleInputRows(("s",), iter([row(1, "user", "a"), row(2, "assistant")]), None)] == [("opened", "a"), ("alive", "a")]
    assert [(r.what, r.run_id) for r in route.handleInputRows(("s",), iter([row(90, "assistant")]), None)] == [("alive", "a")]
    assert calls == ["get", "update"] * 2 and timers == [102]
    due = lambda at: SimpleNamespace(getExpiryTimeInMs=lambda: at)
    assert not list(route.handleExpiredTimer(("s",), None, due(102))) and kept and timers == [102, 190]
    assert not list(route.handleExpiredTimer(("s",), None, due(190))) and not kept and timers == [102, 190]


def test_a_span_of_time_is_written_in_as_many_files_as_the_others(spark, tmp_path):
    """A batch is one span whole, and no span is written by one task, though one holds most rows; few rows are one file a span."""
    from pagewright.plans.stream_queries import _in_slices
    from pagewright.session import stored
    rows = stored(spark.range(4000).select(F.when(F.col("id") < 3400, F.col("id") % 100).otherwise(100 + F.col("id") % 300).alias("at")).repartition(8), "t")
    for name, file_rows, files in (("many", 500, 7), ("one", 10_000, 1)):
        assert _in_slices(rows, F.col("at"), 4, str(tmp_path / name), file_rows) == files
        got = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", files).parquet(str(tmp_path / name))
        seen = {r._b: (r.n, r.least // 100, r.most // 100) for r in _batches(got, str(tmp_path / f"{name}-q"))}
        assert {b: s[1:] for b, s in seen.items()} == {i: (i, i) for i in range(4)} and sum(s[0] for s in seen.values()) == 4000


def _batches(stream, folder: str) -> list:
    drain(stream, "update", folder)
    read = stream.sparkSession.read.parquet(f"{folder}/out")
    return read.groupBy(F.col("_batch").alias("_b")).agg(F.count("*").alias("n"), F.min("at").alias("least"), F.max("at").alias("most")).collect()
