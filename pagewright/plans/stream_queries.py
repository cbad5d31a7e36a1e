"""The streaming operators, run to the end over what the tables hold."""
from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from pagewright.operators.events import normalize_events
from pagewright.operators.ordered import chunk_of, numbered, running_sum
from pagewright.plans import corpora
from pagewright.plans.registry import query
from pagewright.plans.scratch import scratch, write_files
from pagewright.session import stored
from pagewright.streaming import runs as live_runs
from pagewright.streaming import transcripts as live

E = f"WITH {corpora.EVENTS_SQL}"


def drain(stream: DataFrame, mode: str, folder: str) -> DataFrame:
    """Run a stream until its input is used up and return what it wrote.

    Append goes to a table of files. Update rewrites a row's state, so each batch is written beside its number and the
    last state of a key is the answer: see the callers. Complete writes all rows anew; the last batch is the answer.
    """
    spark, out = stream.sparkSession, f"{folder}/out"
    if mode == "append":
        writer = stream.writeStream.format("parquet").option("path", out).outputMode("append")
    else:
        def write(batch: DataFrame, number: int) -> None:
            batch.withColumn("_batch", F.lit(number)).write.mode("overwrite").parquet(f"{out}/_b={number}")
        writer = stream.writeStream.foreachBatch(write).outputMode(mode)
    run = writer.option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).queryName(f"q{uuid.uuid4().hex}").start()
    run.awaitTermination()
    if mode == "complete":
        written = spark.read.parquet(out)
        last = written.agg(F.max("_batch")).first()[0]
        return written.filter(F.col("_batch") == F.lit(last)).drop("_batch", "_b")
    return spark.read.schema(stream.schema if mode == "append" else StructType([*stream.schema.fields, StructField("_batch", IntegerType())])).option("recursiveFileLookup", mode != "append").parquet(out)


def _segments(spark: SparkSession, d: str) -> tuple[str, int]:
    """The transcripts as segment files of some twenty records, named for their session and first byte, and how many they are. Each begins and ends inside a record, behind a quotation mark of its second
    half, and holds the last five of the one before again."""
    folder = scratch(spark, "segments")
    raw = numbered(corpora.transcripts(spark, d), ["session_id"], ["index"], "n", chunk_of(F.col("index")))
    placed = running_sum(raw, ["session_id"], ["n"], (F.octet_length("raw") + 1).cast("long"), "stop", chunk_of(F.col("n")))
    sizes = placed.groupBy("session_id").agg(F.max("n").alias("last"))
    half = F.expr("locate('\"', raw, cast(length(raw) div 2 as int))")
    cut = placed.join(sizes, "session_id").withColumn("h", half)
    cut = cut.withColumns({"before": F.expr("left(raw, h - 1)"), "after": F.expr("substring(raw, h + 1)")})
    own = F.floor(F.col("n") / 20)
    parts = cut.withColumn("part", F.explode(F.sequence(own, F.least(F.floor((F.col("n") + 6) / 20), F.floor(F.col("last") / 20)))))
    opens, ends = (F.col("n") == F.col("part") * 20 - 6), (F.col("n") == F.col("part") * 20 + 19) & (F.col("n") < F.col("last"))
    line = F.concat(F.when(opens, F.col("after")).when(ends, F.col("before")).otherwise(F.col("raw")), F.when(ends | (F.col("n") == F.col("last")), "").otherwise("\n"))
    at = F.col("stop") - F.octet_length("raw") - 1 + F.when(opens, F.octet_length("before") + 1).otherwise(0)
    whole = parts.groupBy("session_id", "part", "last").agg(F.min(at).alias("start"), F.max("n").alias("until"), F.array_sort(F.collect_list(F.struct("n", line.alias("line")))).alias("all"))
    text = F.concat(F.array_join(F.transform("all", lambda x: x["line"]), ""), F.when(F.col("until") == F.col("last"), "\n").otherwise('"'))
    name = F.concat(F.substring(F.md5("session_id"), 1, 2), F.lit("/"), "session_id", F.lit("-"), F.col("start").cast("string"), F.lit(".jsonl"))
    return folder, write_files(whole.select(name.alias("file"), text.alias("value")), folder)


#: Rows of narrow typed records a file of a stream's batch holds.
FILE_ROWS = 1 << 16


def _in_slices(rows: DataFrame, at: Column, n: int, folder: str, file_rows: int = FILE_ROWS) -> int:
    """Writes a stored table's ``rows`` as ``n`` spans of ``at``, a number, one after another, each in as many files, and says in how many: a stream that takes so many at a time takes a span in a batch.

    A span is dealt in turn by the tasks that read it. Of those one reads its share at least, so a span of as many rows as tasks times files leaves no file out.
    """
    least, most = rows.agg(F.min(at), F.max(at)).first()
    cuts = [least + (most + 1 - least) * i // n for i in range(n + 1)]
    spans = [rows.filter(at.between(a, b - 1)) for a, b in zip(cuts, cuts[1:], strict=False)]
    sizes = rows.agg(*(F.count_if(at.between(a, b - 1)) for a, b in zip(cuts, cuts[1:], strict=False))).first()
    files = max(1, min(-(-max(sizes) // file_rows), min(sizes) // rows.rdd.getNumPartitions()))
    for span in spans:
        (span.repartition(files) if files > 1 else span.coalesce(1)).write.mode("append").parquet(folder)
    return files


def _events(spark: SparkSession, d: str, files_per_trigger: int) -> DataFrame:
    """The typed records as a stream over a written table."""
    folder = scratch(spark, "live-events")
    typed = live.live_events(corpora.transcripts(spark, d))
    typed.select("session_id", "index", "kind", "lifecycle", "stop", "child_ids", "at").repartition(8, "session_id").write.parquet(folder)
    return spark.readStream.schema(spark.read.parquet(folder).schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


@query("stream_transcripts", f"""{E} SELECT session_id, row_number() OVER (PARTITION BY session_id ORDER BY idx) - 1 AS n, kind, md5(content) AS content, ts FROM ev""")
def _(spark: SparkSession, d: str) -> DataFrame:
    source, files = _segments(spark, d)
    # sixteen batches or more: what a batch costs beside its files does not grow with the table, and sessions are cut between them
    records = live.stream_transcripts(spark, source, max(1000, files // 16), segment=r"/([A-Za-z0-9]+)-([0-9]+)\.jsonl$")
    read = normalize_events(drain(records, "append", scratch(spark, "tail"))).select("session_id", "index", "kind", F.md5("content").alias("content"), "ts")
    return numbered(stored(read, "read"), ["session_id"], ["index"], "n", chunk_of(F.col("index"), 1 << 22)).drop("index")


@query("stream_turn_state", f"""{E}, l AS (SELECT session_id, arg_max(lifecycle, idx) FILTER (lifecycle <> '') AS phase,
  arg_max(CASE WHEN kind = 'assistant' THEN stop ELSE '' END, idx) FILTER (kind IN ('user', 'assistant', 'tool_result')) AS spoken,
  max(ts) AS last_ms, count(*) AS records, count(DISTINCT child) AS children_named FROM ev GROUP BY session_id)
SELECT session_id, NOT CASE WHEN phase IS NOT NULL THEN phase = 'finished' ELSE coalesce(spoken IN ('end', 'error'), false) END AS open,
  last_ms, records, children_named FROM l""")
def _(spark: SparkSession, d: str) -> DataFrame:
    states = drain(live.stream_turn_state(_events(spark, d, 4)), "update", scratch(spark, "state"))
    last = states.groupBy("session_id").agg(F.max_by(F.struct("open", "last_at", "records", "children_named"), "_batch").alias("s"))
    return last.select("session_id", "s.open", F.unix_millis("s.last_at").alias("last_ms"), "s.records", "s.children_named")


@query("stream_idle_abandon", f"""{E}, g AS (SELECT *, ts - lag(ts) OVER (PARTITION BY session_id ORDER BY ts, idx) AS gap FROM ev),
b AS (SELECT *, sum(CASE WHEN gap IS NULL OR gap >= 60000 THEN 1 ELSE 0 END) OVER (PARTITION BY session_id ORDER BY ts, idx) AS no FROM g),
m AS (SELECT session_id, min(ts) AS start_ms, max(ts) + 60000 AS end_ms, count(*) AS records, arg_max(lifecycle, idx) FILTER (lifecycle <> '') AS phase,
  arg_max(CASE WHEN kind = 'assistant' THEN stop ELSE '' END, idx) FILTER (kind IN ('user', 'assistant', 'tool_result')) AS spoken FROM b GROUP BY session_id, no)
SELECT session_id, start_ms, end_ms, records,
  NOT CASE WHEN phase IS NOT NULL THEN phase = 'finished' ELSE coalesce(spoken IN ('end', 'error'), false) END AS open
FROM m""")
def _(spark: SparkSession, d: str) -> DataFrame:
    # sessions stand in the table in any order, so none may expire another: complete mode, without a watermark
    bursts = live.stream_idle(_events(spark, d, 4), "1 minute", lateness=None)
    done = drain(bursts, "complete", scratch(spark, "idle"))
    return done.select("session_id", F.unix_millis("start").alias("start_ms"), F.unix_millis("end").alias("end_ms"), "records", "open")


@query("stream_activity", """WITH m AS (SELECT user_id, event_id, epoch_us(ts) AS t FROM events),
g AS (SELECT *, t - lag(t) OVER (PARTITION BY user_id ORDER BY t, event_id) AS gap FROM m),
s AS (SELECT *, sum(CASE WHEN gap IS NULL OR gap >= 3600000000 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY t, event_id) AS no FROM g),
b AS (SELECT user_id, min(t) AS s, max(t) + 3600000000 AS e, count(*) AS n FROM s GROUP BY user_id, no)
SELECT user_id, s AS start_us, e AS end_us, n FROM b""")
def _(spark: SparkSession, d: str) -> DataFrame:
    schema = spark.read.parquet(f"{d}/events.parquet").schema
    table = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d)
    stream = table.select("user_id", F.timestamp_micros(corpora.micros(table, "ts")).alias("ts"))
    bursts = live.stream_activity(stream, "1 hour", lateness=None)
    done = drain(bursts, "complete", scratch(spark, "activity"))
    return done.select("user_id", F.unix_micros("start").alias("start_us"), F.unix_micros("end").alias("end_us"), "n")


@query("stream_settled", f"""{E} SELECT t.run_id, t.child_id, j.last_ts AS finished_ms FROM tasks t
JOIN judged j ON j.session_id = t.child_id AND j.turn_no = t.turn_no JOIN rt ON rt.run_id = t.run_id
WHERE t.last_task AND j.finished AND j.last_ts <= rt.last_ts - 3000 + 1000""")
def _(spark: SparkSession, d: str) -> DataFrame:
    from pagewright.plans.transcript_queries import Store
    store, folder = Store(spark, d, ()), scratch(spark, "ended")
    store.run_turns.select("run_id", F.timestamp_millis(F.col("last_ts") - 3000).alias("ended_at")).write.parquet(f"{folder}/parents")
    (store.tasks.filter("last_task").join(store.turns.filter("finished").select(F.col("session_id").alias("child_id"), "turn_no", "last_ts"),
                                          ["child_id", "turn_no"])
     .select("run_id", "child_id", F.timestamp_millis("last_ts").alias("finished_at")).write.parquet(f"{folder}/children"))
    read = lambda name: spark.readStream.schema(spark.read.parquet(f"{folder}/{name}").schema).parquet(f"{folder}/{name}")
    joined = drain(live.stream_settled(read("parents"), read("children"), "1 second"), "append", scratch(spark, "settled"))
    return joined.select("run_id", "child_id", F.unix_millis("finished_at").alias("finished_ms"))


_SEEN = f"(ts - {corpora.BASE_MS}) % 10000000 + CASE WHEN session_id LIKE 'K%' THEN ((ts - {corpora.BASE_MS}) {{div}} 100000) % 3 * 3000 ELSE 0 END"


@query("stream_runs", f"""{E}, s AS (SELECT *, {_SEEN.format(div="//")} AS seen FROM tn),
o AS (SELECT own.run_id, s.* FROM own JOIN s ON s.session_id = own.session_id AND s.idx = own.idx),
e AS (SELECT run_id, min(seen) FILTER (lifecycle = 'finished' OR (conv % 4 = 0 AND kind = 'assistant' AND stop IN ('end', 'error'))) AS ended FROM o GROUP BY run_id),
n AS (SELECT o.run_id, child AS child_id, min(seen) AS named FROM o JOIN e ON e.run_id = o.run_id WHERE child IS NOT NULL AND (ended IS NULL OR seen <= ended) GROUP BY ALL),
nn AS (SELECT *, lead(named) OVER (PARTITION BY child_id ORDER BY named) AS taken FROM n),
k AS (SELECT nn.run_id, nn.child_id, seen, lifecycle = 'finished' OR (conv % 4 = 0 AND kind = 'assistant' AND stop = 'end') AS done
  FROM nn JOIN s ON s.session_id = nn.child_id AND seen >= named AND (taken IS NULL OR seen < taken)),
act AS (SELECT run_id, seen FROM o UNION ALL SELECT run_id, seen FROM k),
a AS (SELECT act.run_id, ended, seen, lead(seen) OVER (PARTITION BY act.run_id ORDER BY seen) AS later FROM act JOIN e ON e.run_id = act.run_id WHERE ended IS NULL OR seen <= ended),
q AS (SELECT run_id, min(seen) AS quiet FROM a WHERE (later IS NULL AND ended IS NULL) OR later - seen > 120000 GROUP BY run_id),
d AS (SELECT e.run_id, ended, quiet, coalesce(quiet + 120000, ended + 1000) AS due FROM e LEFT JOIN q ON q.run_id = e.run_id),
cc AS (SELECT nn.*, d.due, (SELECT min(seen) FROM k WHERE k.run_id = nn.run_id AND k.child_id = nn.child_id AND done AND seen <= d.due) AS fin FROM nn JOIN d ON d.run_id = nn.run_id),
w AS (SELECT max(seen) AS w FROM s),
f AS (SELECT *, CASE WHEN fin IS NULL AND taken <= due THEN taken ELSE due END AS left_at, fin IS NULL AND coalesce(taken > due, true) AS late FROM cc),
r AS (SELECT d.run_id, d.due, d.quiet, d.ended, coalesce(bool_or(late), false) AS late, max(coalesce(fin, left_at)) AS last FROM d LEFT JOIN f ON f.run_id = d.run_id GROUP BY ALL),
v AS (SELECT run_id, '' AS child_id, 'named' AS what, named AS ms, false AS waits, child_id AS ch FROM n
  UNION ALL SELECT run_id, '', 'settled', fin, false, child_id FROM f WHERE fin IS NOT NULL
  UNION ALL SELECT run_id, '', 'orphan', left_at, late, child_id FROM f WHERE fin IS NULL
  UNION ALL SELECT run_id, '', CASE WHEN quiet IS NOT NULL THEN 'abandoned' WHEN late THEN 'completed_with_orphans' ELSE 'completed' END,
    CASE WHEN quiet IS NOT NULL OR late THEN due ELSE greatest(ended, coalesce(last, ended)) END, quiet IS NOT NULL OR late, '' FROM r)
SELECT run_id, ch AS child_id, what, ms::BIGINT AS ms FROM v, w WHERE NOT waits OR ms < w""")
def _(spark: SparkSession, d: str) -> DataFrame:
    # all sessions at one time, and children's records seen late; four spans of time, written one after another, so that every session is cut between them
    typed = live.live_events(corpora.transcripts(spark, d))
    seen = F.timestamp_millis(F.expr(_SEEN.format(div="DIV")))
    # only a prompt's text tells its run
    prompt = F.when(F.col("kind") == "user", F.col("content"))
    rows = stored(typed.select("session_id", "index", "kind", "lifecycle", "stop", prompt.alias("content"), "child_ids", seen.alias("seen_at")), "seen")
    folder = scratch(spark, "seen")
    files = _in_slices(rows, F.unix_millis("seen_at"), 4, folder)
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", files).parquet(folder)
    said = drain(live_runs.stream_runs(stream, "2 minutes", "1 second"), "append", scratch(spark, "runs"))
    return said.select("run_id", F.coalesce("child_id", F.lit("")).alias("child_id"), "what", "ms")
