"""Streams against their batch forms."""
from __future__ import annotations

import os
import random
import time

import pytest
from pyspark.sql import functions as F

from pagewright.plans.stream_queries import drain
from pagewright.streaming import transcripts as live


def test_each_byte_of_a_transcript_is_read_once(spark, tmp_path) -> None:
    """Segments that overlap, repeat, come in any order and over several runs, each ending inside a record; one is as old as a restored copy."""
    rng = random.Random(5)
    lines = [(f"record {i} " + "é" * rng.randint(0, 9) + "\n").encode() for i in range(60)]
    starts = [sum(map(len, lines[:i])) for i in range(61)]
    whole = b"".join(lines)
    source, folder = tmp_path / "in", str(tmp_path / "q")
    (source / "2025-05-06_Seg1").mkdir(parents=True)
    cuts = [(0, 20), (15, 35), (35, 50), (10, 12), (48, 60), (0, 20)]
    rng.shuffle(cuts)
    for n, (a, b) in enumerate(cuts):
        file = source / "2025-05-06_Seg1" / f"{starts[a]:09d}-{n}.jsonl"
        file.write_bytes(whole[starts[a]:starts[b] + 4])
        os.utime(file, (1_000_000 + n, 1_000_000 + n) if n == 1 else None)
        if n % 2:
            got = drain(live.stream_transcripts(spark, str(source)), "append", folder).collect()
            place = {at: i for i, at in enumerate(starts[:-1])}
            assert all(r.session_id == "Seg1" and r.raw == lines[place[r.byte_start]].decode().rstrip("\n") for r in got)
            assert len({r.byte_start for r in got}) == len(got)
    assert sorted(r.byte_start for r in got) == starts[:-1]
    (source / "2025-05-06_Seg1" / "nameless.jsonl").write_bytes(b"x\n")
    with pytest.raises(Exception, match="first byte"):
        drain(live.stream_transcripts(spark, str(source)), "append", folder)


def test_a_long_segment_is_split_in_one_pass() -> None:
    data = b"0123456789\n" * 400_000
    began = time.process_time()
    found, read = live.new_records([(0, data)], [])
    assert len(found) == 400_000 and [(i.start, i.stop, i.tail) for i in read] == [(0, len(data), b"")] and time.process_time() - began < 10


def test_turn_state_of_a_stream_is_the_tables(spark, tmp_path) -> None:
    data = [(f"s{i % 7}", i, "lifecycle" if i % 3 == 0 else "assistant", ["started", "final-started", "finished"][i % 9 // 3] if i % 3 == 0 else "",
             "" if i % 3 == 0 else ["tool", "end"][i % 2], [] if i % 5 else ["k"], 1000 * i) for i in range(200)]
    df = spark.createDataFrame(data, "session_id string, index bigint, kind string, lifecycle string, stop string, child_ids array<string>, ms bigint")
    table = df.withColumn("at", F.timestamp_millis("ms")).drop("ms")
    table.repartition(6).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(table.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    states = drain(live.stream_turn_state(stream), "update", str(tmp_path / "q"))
    last = states.groupBy("session_id").agg(F.max_by(F.struct("open", "last_at", "records", "children_named"), "_batch").alias("s")).select("session_id", "s.*")
    key = lambda d: sorted(map(tuple, d.collect()))
    assert key(last) == key(live.turn_state(table))


def test_a_batchs_files_are_not_listed_by_a_task_each(spark, tmp_path) -> None:
    for i in range(120):
        (tmp_path / "in" / f"d_S{i}").mkdir(parents=True)
        (tmp_path / "in" / f"d_S{i}" / "0.jsonl").write_text('{"role": "user"}\n')
    records = live.stream_transcripts(spark, str(tmp_path / "in"))
    # a stream keeps the settings it was started with
    run = records.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    run.awaitTermination()
    tracker = spark.sparkContext.statusTracker()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 120
    assert int(spark.conf.get("spark.sql.sources.parallelPartitionDiscovery.parallelism")) < 120
    assert max(tracker.getStageInfo(s).numTasks for j in tracker.getJobIdsForGroup(str(run.runId)) for s in tracker.getJobInfo(j).stageIds if tracker.getStageInfo(s)) < 120
