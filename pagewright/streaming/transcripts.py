"""Following transcripts while they are written.

A collector drops what a session's transcript gained as a segment file ``<date>_<session>/<byte start>.jsonl``: immutable,
named by the byte of the transcript it starts at, cut wherever the transcript stood. The file source, the query's checkpoint and each session's state then give
each record once and whole, across restarts; a segment delivered again under another name carries the same bytes and falls out by them.

The other states of this module are native streaming aggregations: they combine before the shuffle, so one busy session is no hot spot.
"""
from __future__ import annotations

from bisect import bisect_right
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from pagewright.operators.events import normalize_events
from pagewright.session import ship_package
from pagewright.sources.transcripts import SESSION, placed_lines, session_named, transcript_lines

#: The session and the byte a segment's path names.
SEGMENT = r"_([A-Za-z0-9]+)/0*([0-9]+)[^/]*\.jsonl$"
#: How long a record may be late in its own time.
LATENESS = "10 minutes"


@dataclass
class Island:
    """A stretch of bytes that were read, ``start`` to ``stop``, with what of it is no whole record yet.

    ``head`` is its first bytes up to the first line end, while it is not known whether a line begins at ``start``; None once it is. ``tail`` is what follows the last
    line end; None while the stretch has no line end and ``head`` is all of it.
    """
    start: int
    stop: int
    head: bytes | None
    tail: bytes | None


def _joined(left: Island | None, start: int, data: bytes, right: Island | None) -> tuple[list[tuple[int, bytes]], Island]:
    """The records that ``data`` makes whole between its neighbours, and the one stretch all three are then."""
    # what the left one has left over comes before the data, what the right one began with after it
    before = (left.head if left.tail is None else left.tail) if left else b""
    known = start == 0 if left is None else left.tail is not None
    head = (left.head if left.tail is not None else b"") if left else None if start == 0 else b""
    whole = before + data + (right.head if right else b"")
    lines = whole.split(b"\n")
    at, records = start - len(before), []
    tail: bytes | None = lines.pop()
    if not known:
        if lines:
            head = lines.pop(0) + b"\n"
            at += len(head)
        else:
            head, tail = whole, None
    for line in lines:
        if line.strip():
            records.append((at, line))
        at += len(line) + 1
    if right and right.tail is not None:
        tail = right.tail
    return records, Island(left.start if left else start, right.stop if right else start + len(data), head, tail)


def new_records(segments: list[tuple[int, bytes]], islands: list[Island]) -> tuple[list[tuple[int, str]], list[Island]]:
    """Records ``(byte, text)`` that segments make whole, by their bytes, and the stretches read now. Bytes read before fall out, wherever a segment was cut."""
    out: list[tuple[int, bytes]] = []
    islands = list(islands)
    for start, data in segments:
        at, stop = start, start + len(data)
        while at < stop:
            place = bisect_right([i.start for i in islands], at)
            left = islands[place - 1] if place else None
            if left and at < left.stop:
                at = left.stop
                continue
            right = islands[place] if place < len(islands) else None
            until = min(stop, right.start) if right else stop
            near = [left if left and left.stop == at else None, right if right and right.start == until else None]
            found, merged = _joined(near[0], at, data[at - start:until - start], near[1])
            out += found
            islands[place - (near[0] is not None):place + (near[1] is not None)] = [merged]
            at = until
    return [(at, line.decode("utf-8", "replace")) for at, line in sorted(out)], islands


class _Follow(StatefulProcessor):
    """A session's records: its state is the stretches read, one unless segments are missing."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.read = handle.getListState("read", "start long, stop long, head binary, tail binary")

    def handleInitialState(self, key, initialState, timerValues) -> None:
        for stop, tail in zip(initialState["stop"].tolist(), initialState["tail"], strict=True):
            if stop:
                self.read.put([(0, int(stop), None, bytes(tail or b""))])

    def handleInputRows(self, key, rows, timerValues):
        islands = [Island(start, stop, None if head is None else bytes(head), None if tail is None else bytes(tail)) for start, stop, head, tail in self.read.get()]
        out = []
        for batch in rows:
            found, islands = new_records(list(zip(batch["start"].tolist(), map(bytes, batch["data"]), strict=True)), islands)
            out += found
        out.sort()
        self.read.put([(i.start, i.stop, i.head, i.tail) for i in islands])
        yield pd.DataFrame({"session_id": key[0], "index": [f[0] for f in out], "byte_start": [f[0] for f in out], "raw": [f[1] for f in out]},
                           columns=["session_id", "index", "byte_start", "raw"]).astype({"session_id": "object", "index": "int64", "byte_start": "int64", "raw": "object"})


def keyed_state(spark: SparkSession) -> None:
    """Keyed state with lists, maps and timers needs the engine's embedded store; a session that names none gets it. Workers get this package, which says what state does."""
    ship_package(spark)
    store = "spark.sql.streaming.stateStore.providerClass"
    if not spark.conf.get(store, "").endswith("RocksDBStateStoreProvider"):
        spark.conf.set(store, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def listed_by_cores(spark: SparkSession) -> None:
    """A batch's files are listed once more when it is read, by a task for each of up to 10,000 files; in a session that has not set their number they are some for each core."""
    tasks = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    if int(spark.conf.get(tasks)) == 10_000:
        spark.conf.set(tasks, 4 * spark.sparkContext.defaultParallelism)


def copied_so_far(spark: SparkSession, path: str, glob: str = "*.jsonl", session: str = SESSION) -> DataFrame:
    """``(session_id, stop, tail)`` of the transcripts under ``path``: the bytes of each, and those of its last line that is not ended yet."""
    lines = transcript_lines(spark, path, glob)
    placed = placed_lines(lines)
    cut = F.when(F.col("_end") > F.col("_s"), F.struct(F.col("raw").cast("binary").alias("tail")))
    return (placed.groupBy(session_named(session).alias("session_id"), "_f").agg(F.max("_s").alias("stop"), F.max_by(cut, "_end")["tail"].alias("tail"))
            .groupBy("session_id").agg(F.max_by(F.struct("stop", "tail"), "stop").alias("c")).select("session_id", "c.stop", F.coalesce("c.tail", F.lit(b"")).alias("tail")))


def stream_transcripts(spark: SparkSession, path: str, files_per_trigger: int = 1000, pattern: str = "*.jsonl", segment: str = SEGMENT,
                       copied: DataFrame | None = None) -> DataFrame:
    """``(session_id, index, byte_start, raw)`` of every record that arrives under ``path``, each once and whole.

    ``index`` is the record's first byte in its transcript: it orders a session's records like their numbers do. A segment may be cut anywhere: a record comes out
    when all its bytes are there, from however many segments. A segment can be read without those before it; only its first, perhaps cut line waits
    for them. Each session's state is the byte stretches that were read, one unless segments are missing, with the line ends they lack, so copies and overlaps
    fall out and no segment is too old. ``copied`` ``(session_id, stop, tail)``, as from ``copied_so_far``, is what an earlier copy holds already: none of its
    records comes again, and its unfinished line goes on. A file whose name tells no session and start byte is refused.
    """
    keyed_state(spark)
    listed_by_cores(spark)
    files = (spark.readStream.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern)
             .option("maxFilesPerTrigger", files_per_trigger).schema("path string, modificationTime timestamp, length bigint, content binary").load(path))
    named = F.regexp_extract("path", segment, 2)
    start = F.when(named.rlike("^[0-9]+$"), named.cast("long")).otherwise(
        F.raise_error(F.concat(F.lit("a segment's name must tell its session and first byte: "), F.col("path"))).cast("long"))
    segments = files.select(F.regexp_extract("path", segment, 1).alias("session_id"), start.alias("start"), F.col("content").alias("data"))
    first = None if copied is None else copied.select("session_id", "stop", "tail").groupBy("session_id")
    return segments.groupBy("session_id").transformWithStateInPandas(_Follow(), "session_id string, index long, byte_start long, raw string", "append", "None", first)


def live_events(records: DataFrame) -> DataFrame:
    """The typed events of streamed records, with their own time ``at``."""
    return normalize_events(records).withColumn("at", F.timestamp_millis("ts"))


def _last(condition: Column, code: Column) -> Column:
    return F.max(F.when(condition, F.col("index") * 4 + code))


def turn_state(events: DataFrame) -> DataFrame:
    """Per session: whether its last turn is open, when it last wrote, and how many different children it named; which of them are pending, ``runs.stream_runs`` says.

    Works on a stream (in update mode, or complete) and on a table alike; the batch form is the stream's check. The last
    record of a kind is a numeric maximum, see ``operators.turns.turns_of``.
    """
    phase = F.when(F.col("lifecycle") == "finished", 2).when(F.col("lifecycle") == "final-started", 1).otherwise(0)
    spoken = F.when(F.col("kind") != "assistant", 0).when(F.col("stop") == "end", 1).when(F.col("stop") == "error", 2).otherwise(3)
    # a row for each child a record names, so the state holds each child once, however often it is named
    named = events.select("session_id", "index", "kind", "lifecycle", "stop", "at", F.posexplode_outer("child_ids").alias("_pos", "_child"))
    states = named.groupBy("session_id").agg(
        _last(F.col("lifecycle") != "", phase).alias("_phase"),
        _last(F.col("kind").isin("user", "assistant", "tool_result"), spoken).alias("_spoken"),
        F.max("at").alias("last_at"), F.count_if(F.coalesce(F.col("_pos"), F.lit(0)) == 0).alias("records"),
        F.size(F.collect_set("_child")).cast("long").alias("children_named"))
    closed = F.when(F.col("_phase").isNotNull(), F.col("_phase") % 4 == 2).otherwise(F.coalesce((F.col("_spoken") % 4).isin(1, 2), F.lit(False)))
    return states.select("session_id", (~closed).alias("open"), "last_at", "records", "children_named")


def stream_turn_state(events: DataFrame) -> DataFrame:
    """The live state of each session. Write it in update mode."""
    return turn_state(events)


def stream_idle(events: DataFrame, idle: str = "10 minutes", lateness: str | None = LATENESS) -> DataFrame:
    """Bursts of a session's activity that ended because nothing came for ``idle``: ``(session_id, start, end, records, open)``.

    ``open`` says the burst ended inside a turn: quiet past the limit, and abandoned. A child's records count for the
    session that gave it its task where ``events`` names that one as ``session_id``. In append mode a burst comes out once
    the watermark has passed its limit, so the limit itself is the timer; the watermark is all sessions' together, and a record later than
    ``lateness`` behind it is lost. Without ``lateness`` write in complete mode: nothing is lost, and the last bursts come too.
    """
    timed = events.withWatermark("at", lateness) if events.isStreaming and lateness else events
    phase = F.when(F.col("lifecycle") == "finished", 2).when(F.col("lifecycle") == "final-started", 1).otherwise(0)
    spoken = F.when(F.col("kind") != "assistant", 0).when(F.col("stop") == "end", 1).when(F.col("stop") == "error", 2).otherwise(3)
    bursts = timed.groupBy("session_id", F.session_window("at", idle).alias("burst")).agg(
        _last(F.col("lifecycle") != "", phase).alias("_phase"),
        _last(F.col("kind").isin("user", "assistant", "tool_result"), spoken).alias("_spoken"), F.count("*").alias("records"))
    closed = F.when(F.col("_phase").isNotNull(), F.col("_phase") % 4 == 2).otherwise(F.coalesce((F.col("_spoken") % 4).isin(1, 2), F.lit(False)))
    return bursts.select("session_id", F.col("burst.start").alias("start"), F.col("burst.end").alias("end"), "records", (~closed).alias("open"))


def stream_activity(events: DataFrame, gap: str = "10 minutes", key: str = "user_id", lateness: str | None = LATENESS) -> DataFrame:
    """Bursts of activity of each key, split where nothing happened for ``gap``: ``(key, start, end, n)``; ``end`` is the last
    event plus the gap. ``events`` holds ``(key, ts)``. ``lateness`` as in ``stream_idle``."""
    timed = events.withWatermark("ts", lateness) if events.isStreaming and lateness else events
    return (timed.groupBy(key, F.session_window("ts", gap).alias("burst")).agg(F.count("*").alias("n"))
            .select(key, F.col("burst.start").alias("start"), F.col("burst.end").alias("end"), "n"))


def stream_settled(parents: DataFrame, children: DataFrame, settle: str = "30 seconds") -> DataFrame:
    """``(run_id, child_id, ended_at, finished_at)``: children that finished within the settle window after their parent ended.

    Two streams, ``(run_id, ended_at)`` and ``(run_id, child_id, finished_at)``, joined by run. A child may finish any time before its parent ends and
    either row may come late, so neither side expires: the state is one narrow row a run and one a child. A child without a row is an orphan.
    """
    ended = parents.select(F.col("run_id").alias("_run"), "ended_at")
    in_time = (F.col("run_id") == F.col("_run")) & (F.col("finished_at") <= F.col("ended_at") + F.expr(f"INTERVAL {settle}"))
    return children.join(ended, in_time).select("run_id", "child_id", "ended_at", "finished_at")
