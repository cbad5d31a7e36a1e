"""How runs ended."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewright.operators.events import UNREAD
from pagewright.operators.ordered import HOT_ROWS, by_range, last_before, salted_join

#: Quiet time after which a turn is no longer waited for, and how long a reserved run may stay without a supervisor.
IDLE = "10 minutes"
START_LIMIT = "1 minute"
# End states, and what a verdict is about.
ENDED = ["completed", "completed_with_orphans", "completed_unstructured", "failed", "abandoned"]
QUIET = "the turn went quiet before it finished"
GONE = "the supervisor is gone"
NEVER_STARTED = "the supervisor never started"
FROM_STDOUT = "stdout only"
OK, FAILED, EMPTY = 0, 4, 5


def _ms(span: str) -> Column:
    return F.expr(f"CAST(unix_millis(timestamp_millis(0) + INTERVAL {span}) AS BIGINT)")


def run_activity(scoped: DataFrame) -> DataFrame:
    """``(run_id, last_ts)``: the last record of a run's turn or of its own children, and no one else's."""
    return scoped.groupBy("run_id").agg(F.max("ts").alias("last_ts"))


def idle_abandon(runs: DataFrame, activity: DataFrame, now: Column, idle: str = IDLE) -> DataFrame:
    """``runs`` (with ``finished``) with ``last_ts`` and ``abandoned``: unfinished, and quiet for longer than ``idle``."""
    joined = runs.drop("last_ts").join(activity, "run_id", "left")
    quiet = (now - F.coalesce("last_ts", F.col("created_at"))) > _ms(idle)
    return joined.withColumn("abandoned", ~F.coalesce("finished", F.lit(False)) & quiet)


def settle_window(runs: DataFrame, children: DataFrame, settle_ms: int) -> DataFrame:
    """``(run_id, child_id, settled)``: whether each child finished by the end of the settle window after its parent.

    ``runs`` holds ``(run_id, ended_ts)``; ``children`` holds ``(run_id, child_id, finished_ts)``, null while it works.
    """
    # merged: both grow with the transcripts, and Spark sizes stored ones by their compressed files
    joined = salted_join(children.hint("merge"), runs.select("run_id", "ended_ts"), ["run_id"], F.col("child_id"))
    in_time = F.col("finished_ts") <= F.col("ended_ts") + settle_ms
    return joined.select("run_id", "child_id", F.coalesce(in_time, F.lit(False)).alias("settled"))


def run_state(runs: DataFrame, activity: DataFrame, orphans: DataFrame, now: Column, idle: str = IDLE) -> DataFrame:
    """``(run_id, state, reason, orphans)`` of every run.

    ``runs`` holds ``run_id, created_at, supervised, alive, exit_code, ended_by_supervisor, recorded, reason`` and, where a
    turn was found, ``turn_no, finished, failed, error``. ``recorded`` is a state already written: a finished run is never
    judged again. A turn is judged by its last message and by an exit code of the process's own.
    """
    left = orphans.groupBy("run_id").agg(F.count("*").alias("orphans"))
    judged = idle_abandon(runs, activity, now, idle).join(left, "run_id", "left").withColumn("orphans", F.coalesce("orphans", F.lit(0)))
    found = F.col("turn_no").isNotNull()
    own_exit = F.coalesce((F.col("exit_code") != 0) & ~F.coalesce("ended_by_supervisor", F.lit(False)), F.lit(False))
    exited = F.col("exit_code").isNotNull()
    over = found & F.coalesce("finished", F.lit(False))
    old = (now - F.col("created_at")) > _ms(START_LIMIT)
    rules = [
        (F.col("recorded").isin(ENDED), F.col("recorded"), F.col("reason")),
        (over & F.col("failed"), F.lit("failed"), F.col("error")),
        (own_exit & (over | ~found), F.lit("failed"), F.concat(F.lit("exit code "), F.col("exit_code").cast("string"))),
        (over & (F.col("orphans") > 0), F.lit("completed_with_orphans"), F.lit("children were still working")),
        (over, F.lit("completed"), F.lit(None).cast("string")),
        (~F.col("supervised") & old, F.lit("abandoned"), F.lit(NEVER_STARTED)),
        (~F.col("supervised"), F.lit("starting"), F.lit(None).cast("string")),
        (~found & exited, F.lit("completed_unstructured"), F.lit(FROM_STDOUT)),
        (~F.col("alive"), F.lit("abandoned"), F.lit(GONE)),
        (F.col("abandoned"), F.lit("abandoned"), F.lit(QUIET)),
    ]
    state, reason = F.when(rules[0][0], rules[0][1]), F.when(rules[0][0], rules[0][2])
    for condition, name, why in rules[1:]:
        state, reason = state.when(condition, name), reason.when(condition, why)
    return judged.select("run_id", state.otherwise("running").alias("state"), reason.alias("reason"), "orphans")


def empty_result(results: DataFrame) -> DataFrame:
    """``results`` (``answer, sources_total``) with ``empty``: no answer and no sources. A negative finding is an answer."""
    return results.withColumn("empty", ~F.coalesce("answer", F.lit("")).rlike(r"\S") & (F.coalesce("sources_total", F.lit(0)) == 0))


def unread_note(scoped: DataFrame) -> DataFrame:
    """``(run_id, unread, note)`` of runs with records that could not be read."""
    counted = scoped.groupBy("run_id").agg(F.count_if(F.col("kind").isin(*UNREAD)).alias("unread")).filter("unread > 0")
    return counted.withColumn("note", F.concat(
        F.col("unread").cast("string"), F.when(F.col("unread") == 1, " record").otherwise(" records"),
        F.lit(" in this run's transcript could not be read")))


def group_verdict(results: DataFrame) -> DataFrame:
    """``(group, verdict, going)`` of ``(group, state, empty)``: 4 when any member failed or was abandoned, 5 when all ended
    empty, else 0. A member still going keeps the group from being empty."""
    ended = F.col("state").isin(ENDED)
    grouped = results.groupBy("group").agg(
        F.max(F.col("state").isin("failed", "abandoned")).alias("_bad"), F.min(ended & F.col("empty")).alias("_empty"),
        F.max(~ended).alias("going"))
    return grouped.select("group", F.when(F.col("_bad"), FAILED).when(F.col("_empty"), EMPTY).otherwise(OK).alias("verdict"), "going")


def activity_sessions(events: DataFrame, gap_ms: int, key: str = "user_id", hot_rows: int = HOT_ROWS) -> DataFrame:
    """``(key, start_ts, end_ts, n)``: bursts of activity, split where nothing happened for ``gap_ms``.

    ``events`` holds ``(key, ts)`` in milliseconds and ``event_id``. The batch form of a session window, without gathering
    a key: see ``ordered``.
    """
    order, chunk = ["ts", "event_id"], F.col("_range")
    ranged = by_range(events.select(key, "ts", "event_id"), [key], "ts", hot_rows)
    before = last_before(ranged, [key], order, {"_prev": F.col("ts")}, chunk)
    opens = F.col("_prev").isNull() | (F.col("ts") - F.col("_prev") >= gap_ms)
    begun = last_before(before, [key], order, {"start_ts": F.when(opens, F.col("ts"))}, chunk, including=True)
    return begun.groupBy(key, "start_ts").agg(F.max("ts").alias("end_ts"), F.count("*").alias("n"))
