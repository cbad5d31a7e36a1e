"""Turns of sessions, the runs that opened them, and what belongs to a run.

A session is one ordered stream of events and may be very long; a run is one turn of it, and its children are turns of
other sessions. Everything here goes through ``turns_of``, one narrow row a turn, made by partial aggregation; events
themselves are only joined by ``(session_id, turn_no)``.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewright.operators.ordered import by_range, chunk_of, first_n, last_before, running_sum, salted_join
from pagewright.session import stored

#: What a run's prompt carries so that its session can be found: ``(<MARKER>:<run id> — ...)``.
MARKER = "run-marker"
# The records that frame a turn.
STARTED, FINAL, FINISHED = "started", "final-started", "finished"

def segment_turns(events: DataFrame) -> DataFrame:
    """``events`` with ``turn_no``: 0 before the first turn, then 1, 2, ...

    A turn opens at ``started``. In a session, or a stretch of one, without lifecycle records it opens at a user's record:
    one that no open turn already has room for.
    """
    chunk = chunk_of(F.col("index"))
    framed = last_before(events, ["session_id"], ["index"],
                         {"_frame": F.when(F.col("lifecycle") != "", F.col("lifecycle"))}, chunk)
    opens = (F.col("lifecycle") == STARTED) | ((F.col("kind") == "user") & (F.coalesce("_frame", F.lit(FINISHED)) == FINISHED))
    counted = running_sum(framed, ["session_id"], ["index"], opens.cast("long"), "turn_no", chunk)
    return counted.drop("_frame")


def turns_of(events: DataFrame) -> DataFrame:
    """One row a turn: ``session_id, turn_no, start_index, start_ts, prompt_index, finished_index, last_ts, last_end_index,
    framed, finished, failed``.

    ``finished`` is read off the last lifecycle record where the turn has any, else off its last message, which must be an
    assistant's that stopped. The last record of a kind is found as the maximum of ``index * 4 + code``, a number, so the
    turns are made in hash aggregates that combine before the shuffle.
    """
    def coded(condition: Column, code: Column) -> Column:
        return F.max(F.when(condition, F.col("index") * 4 + code))

    frame = F.col("lifecycle") != ""
    phase = F.when(F.col("lifecycle") == FINISHED, 2).when(F.col("lifecycle") == FINAL, 1).otherwise(0)
    message = F.col("kind").isin("user", "assistant", "tool_result")
    spoken = F.when(F.col("kind") != "assistant", 0).when(F.col("stop") == "end", 1).when(F.col("stop") == "error", 2).otherwise(3)
    end = (F.col("kind") == "assistant") & (F.col("stop") == "end")
    grouped = events.groupBy("session_id", "turn_no").agg(
        F.min("index").alias("start_index"), F.min(F.when(F.col("kind") == "user", F.col("index"))).alias("prompt_index"),
        F.min("ts").alias("start_ts"), F.max("ts").alias("last_ts"), F.count("*").alias("records"),
        F.min(F.when(F.col("lifecycle") == FINISHED, F.col("index"))).alias("finished_index"),
        F.max(F.when(end, F.col("index"))).alias("last_end_index"),
        coded(frame, phase).alias("_phase"), coded(message, spoken).alias("_spoken"))
    last = F.col("_spoken") % 4
    return (grouped.withColumn("framed", F.col("_phase").isNotNull())
            .withColumn("finished", F.when(F.col("framed"), F.col("_phase") % 4 == 2).otherwise(F.coalesce(last.isin(1, 2), F.lit(False))))
            .withColumn("failed", F.coalesce(last == 2, F.lit(False)))
            .withColumn("error_index", F.when(F.col("failed"), F.floor(F.col("_spoken") / 4)))
            .drop("_phase", "_spoken"))


def turn_finished(turns: DataFrame) -> DataFrame:
    return turns.filter("turn_no > 0").select("session_id", "turn_no", "finished")


def session_busy(turns: DataFrame, status: DataFrame | None = None) -> DataFrame:
    """``(session_id, busy, reason)``: whether a session's last turn is open, or its status row says it is working.

    Without a status table the transcript alone decides.
    """
    last = turns.groupBy("session_id").agg(F.max(F.struct("turn_no", "finished")).alias("_l"))
    open_ = (F.col("_l.turn_no") > 0) & ~F.col("_l.finished")
    if status is None:
        return last.select("session_id", open_.alias("busy"), F.when(open_, "a turn is in flight").otherwise("").alias("reason"))
    running = status.filter(F.col("status") == "running").select("session_id", F.lit(True).alias("_running")).distinct()
    joined = last.join(running, "session_id", "left")
    works = F.coalesce("_running", F.lit(False))
    return joined.select("session_id", (open_ | works).alias("busy"),
                         F.when(open_, "a turn is in flight").when(works, "it is still working").otherwise("").alias("reason"))


def marked_run(content: Column, marker: str = MARKER) -> Column:
    """The run id a prompt's marker carries, whole: up to the blank or bracket after it."""
    return F.regexp_extract(content, rf"\({marker}:([^\s)]+)", 1)


def prompts_of(events: DataFrame, turns: DataFrame, marker: str = MARKER) -> DataFrame:
    """``(session_id, turn_no, prompt_index, prompt, run_id)``: the prompt that opened each turn."""
    asked = events.filter(F.col("kind") == "user").select("session_id", F.col("index").alias("prompt_index"), "content")
    opened = turns.filter(F.col("prompt_index").isNotNull()).select("session_id", "turn_no", "prompt_index")
    return opened.hint("merge").join(asked, ["session_id", "prompt_index"]).select(
        "session_id", "turn_no", "prompt_index", F.col("content").alias("prompt"), marked_run(F.col("content"), marker).alias("run_id"))


def sessions_list(events: DataFrame, turns: DataFrame, mine: bool = False, search: str | None = None, limit: int = 20,
                  marker: str = MARKER) -> DataFrame:
    """``(session_id, prompt, run_id, last_ts)`` of the latest sessions, by their opening prompt."""
    first = turns.groupBy("session_id").agg(F.min("prompt_index").alias("prompt_index"), F.max("last_ts").alias("last_ts"))
    asked = events.filter(F.col("kind") == "user").select("session_id", F.col("index").alias("prompt_index"),
                                                          F.col("content").alias("prompt"))
    listed = first.join(asked, ["session_id", "prompt_index"]).withColumn("run_id", marked_run(F.col("prompt"), marker))
    if mine:
        listed = listed.filter(F.col("run_id") != "")
    if search is not None:
        listed = listed.filter(F.contains("prompt", F.lit(search)))
    return (listed.select("session_id", "prompt", "run_id", "last_ts")
            .orderBy(F.desc_nulls_last("last_ts"), "session_id").limit(limit))


def run_session_join(runs: DataFrame, prompts: DataFrame) -> DataFrame:
    """``runs`` with ``session_id, turn_no, prompt_index`` of the turn each run's own prompt opened."""
    found = (prompts.filter(F.col("run_id") != "").groupBy("run_id")
             .agg(F.max(F.struct("session_id", "turn_no", "prompt_index")).alias("_p"))
             .select("run_id", "_p.session_id", "_p.turn_no", "_p.prompt_index"))
    return runs.hint("merge").join(found, "run_id")


def run_turns(joined: DataFrame, turns: DataFrame) -> DataFrame:
    """One row a run: its turn, and when the session's next turn began (``next_ts``)."""
    here = turns.select("session_id", "turn_no", "start_ts", "last_ts", "finished_index", "last_end_index", "finished", "failed",
                        "error_index")
    later = turns.select("session_id", (F.col("turn_no") - 1).alias("turn_no"), F.col("start_ts").alias("next_ts"))
    return joined.hint("merge").join(here, ["session_id", "turn_no"]).join(later.hint("merge"), ["session_id", "turn_no"], "left")


def run_scope(runs: DataFrame, events: DataFrame) -> DataFrame:
    """The records of each run: its turn's, from its prompt to its own ``finished``.

    ``runs`` as from ``run_turns``, ``events`` as from ``segment_turns``. A run whose turn is not there yet has none.
    """
    frames = runs.select("run_id", "session_id", "turn_no", F.col("prompt_index").alias("_from"), F.col("finished_index").alias("_to"))
    inside = (F.col("index") >= F.col("_from")) & (F.col("_to").isNull() | (F.col("index") <= F.col("_to")))
    return salted_join(events, frames, ["session_id", "turn_no"], F.col("index")).filter(inside).drop("_from", "_to")


def named_children(scoped: DataFrame) -> DataFrame:
    """``(run_id, child_id, mention)``: the children a run's own records name, by their first mention."""
    return (scoped.select("run_id", "index", F.explode("child_ids").alias("child_id"))
            .groupBy("run_id", "child_id").agg(F.min("index").alias("mention")))


def child_tasks(runs: DataFrame, named: DataFrame, turns: DataFrame) -> DataFrame:
    """``(run_id, child_id, mention, turn_no, last_task)``: the child's turns that are the run's.

    A child's tasks opened while the run's turn lasted are all the run's. Where there is none, the latest task before the
    session's next turn is: this run collected it late. Found by one pass over each child's timeline, on which runs of a
    session do not overlap, not by pairing runs with tasks.
    """
    frames = (salted_join(named.hint("merge"), runs.select("run_id", F.col("session_id").alias("parent"), "start_ts", "next_ts"), ["run_id"], F.col("child_id"))
              .withColumn("start_ts", F.coalesce("start_ts", F.lit(0).cast("long"))))
    parents = frames.select("child_id", "parent").distinct()
    given_at = turns.filter("turn_no > 0").select(F.col("session_id").alias("child_id"), "turn_no",
                                                  F.coalesce("start_ts", F.lit(0).cast("long")).alias("at"))
    tasks = salted_join(given_at.hint("merge"), parents, ["child_id"], F.col("turn_no"))
    never = F.lit(2**62).cast("long")
    none = F.lit(None).cast("long")
    line = (
        frames.select("child_id", "parent", "run_id", "mention", none.alias("turn_no"), F.col("start_ts").alias("at"), F.lit(1).alias("what"),
                      "next_ts")
        .unionByName(frames.select("child_id", "parent", "run_id", "mention", none.alias("turn_no"), F.coalesce("next_ts", never).alias("at"),
                                   F.lit(0).alias("what"), "next_ts"))
        .unionByName(tasks.select("child_id", "parent", F.lit(None).cast("string").alias("run_id"), none.alias("mention"), "turn_no",
                                  "at", F.lit(2).alias("what"), none.alias("next_ts"))))
    start, task = F.col("what") == 1, F.col("what") == 2
    seen = last_before(
        by_range(stored(line, "timeline"), ["child_id", "parent"], "at"), ["child_id", "parent"], ["at", "what", "turn_no", "run_id"],
        {"_run": F.when(start, F.struct("run_id", "mention", "next_ts")), "_task": F.when(task, F.col("turn_no"))},
        F.col("_range")).drop("_range")
    given = task & F.col("_run").isNotNull() & (F.col("_run.next_ts").isNull() | (F.col("at") < F.col("_run.next_ts")))
    late = (F.col("what") == 0) & F.col("_task").isNotNull()
    found = seen.filter(given | late).select(
        "child_id", late.alias("late"), *(F.when(late, F.col(c)).otherwise(F.col(f"_run.{c}")).alias(c) for c in ("run_id", "mention")),
        F.when(late, F.col("_task")).otherwise(F.col("turn_no")).alias("turn_no"))
    # a late task counts only where the run gave none
    best = found.groupBy("run_id", "child_id").agg(
        F.min("late").alias("_late"), F.max(F.struct((~F.col("late")).alias("given"), "turn_no"))["turn_no"].alias("_last"))
    return (salted_join(found.hint("merge"), best, ["run_id", "child_id"], F.col("turn_no")).filter(F.col("late") == F.col("_late"))
            .select("run_id", "child_id", "mention", "turn_no", (F.col("turn_no") == F.col("_last")).alias("last_task")))


def child_scope(tasks: DataFrame, events: DataFrame, turns: DataFrame) -> DataFrame:
    """The children's records that are a run's, each task from its prompt on."""
    frames = (tasks.join(turns.select(F.col("session_id").alias("child_id"), "turn_no", F.col("prompt_index").alias("_from")),
                         ["child_id", "turn_no"])
              .select("run_id", "child_id", "mention", F.col("child_id").alias("session_id"), "turn_no", "_from", "last_task"))
    return (salted_join(events, frames, ["session_id", "turn_no"], F.col("index"))
            .filter(F.col("_from").isNull() | (F.col("index") >= F.col("_from"))).drop("_from"))


def whole_scope(own: DataFrame, children: DataFrame) -> DataFrame:
    """A run's own records and its children's as one stream each: ``stream`` is -1 for its own, else the child's mention."""
    mine = own.withColumn("child_id", F.lit("")).withColumn("stream", F.lit(-1).cast("long"))
    theirs = children.withColumn("stream", F.col("mention")).drop("mention", "last_task")
    return mine.unionByName(theirs)


def orphan_children(named: DataFrame, tasks: DataFrame, turns: DataFrame) -> DataFrame:
    """``(run_id, child_id, mention)``: children whose last task of the run is not finished, or that left no transcript."""
    done = (tasks.filter("last_task").join(turns.filter("finished").select(F.col("session_id").alias("child_id"), "turn_no"),
                                           ["child_id", "turn_no"]).select("run_id", "child_id"))
    return named.join(done, ["run_id", "child_id"], "left_anti")


def resolve_run_ref(runs: DataFrame, refs: DataFrame, candidates: int = 10) -> DataFrame:
    """``(ref, run_id, verdict, n)``: the run each typed reference names, and how many runs it begins.

    A whole id wins over a longer one it begins; else a prefix only one run has; a shared prefix gives its first ``candidates`` runs in the
    order of their ids. Prefixes are found by equality: each run offers those as long as some reference is.
    """
    asked = refs.select("ref").distinct()
    lengths = asked.select(F.length("ref").alias("_n")).distinct().withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(15))))
    dealt = runs.select("run_id").withColumn("_salt", F.pmod(F.xxhash64("run_id"), F.lit(16)).cast("int"))
    offered = dealt.join(lengths, "_salt").filter(F.length("run_id") >= F.col("_n")).select("run_id", F.expr("left(run_id, _n)").alias("ref"))
    found = salted_join(offered, asked, ["ref"], F.col("run_id"))
    counts = found.groupBy("ref").agg(F.count("*").alias("_n"), F.max(F.col("run_id") == F.col("ref")).alias("_whole"))
    judged = salted_join(found, counts, ["ref"], F.col("run_id"))
    exact = F.col("run_id") == F.col("ref")
    verdict = F.when(F.col("_whole"), "exact").when(F.col("_n") == 1, "prefix").otherwise("candidate")
    named = first_n(judged.filter(~F.col("_whole") | exact), ["ref"], ["run_id"], candidates).select("ref", "run_id", verdict.alias("verdict"), F.col("_n").alias("n"))
    missing = asked.join(counts, "ref", "left_anti").select(
        "ref", F.lit(None).cast("string").alias("run_id"), F.lit("unknown").alias("verdict"), F.lit(0).cast("long").alias("n"))
    return named.unionByName(missing)


def recent_runs(runs: DataFrame, k: int = 10) -> DataFrame:
    """The latest runs, for a reference that names none."""
    return runs.orderBy(F.desc("created_at"), F.desc("run_id")).limit(k)


def offered_instead(runs: DataFrame, resolved: DataFrame, k: int = 10) -> DataFrame:
    """``(ref, place, run_id)``: for each reference that ``resolve_run_ref`` found to name no run, the ``k`` latest runs, from 1."""
    # one row by construction, of at most k ids; of one time the larger id comes first
    latest = recent_runs(runs, k).agg(F.sort_array(F.collect_list(F.struct("created_at", "run_id")), asc=False).alias("_all"))
    one = latest.select(F.lit("unknown").alias("verdict"), F.transform("_all", lambda r: r["run_id"]).alias("_ids"))
    unknown = resolved.filter("verdict = 'unknown'").select("ref", "verdict")
    return unknown.join(F.broadcast(one), "verdict").select("ref", F.posexplode("_ids").alias("_at", "run_id")).select("ref", (F.col("_at") + 1).alias("place"), "run_id")


def latest_group(runs: DataFrame) -> DataFrame:
    """The runs of the most recent group, or the most recent run where it has none."""
    unit = F.coalesce(F.col("group"), F.col("run_id"))
    newest = runs.agg(F.max(F.struct("created_at", unit.alias("unit"))).alias("_m")).select(F.col("_m.unit").alias("_unit"))
    # one row by construction: an aggregate without keys
    return runs.withColumn("_unit", unit).join(F.broadcast(newest), "_unit").drop("_unit")


def artifact_turn(artifacts: DataFrame, turns: DataFrame) -> DataFrame:
    """``artifacts`` with ``turn_no``: the session's turn that was on when the file was last written.

    ``mtime`` is in milliseconds. An as-of join: files and turn starts on one timeline, each file takes the last start.
    """
    starts = turns.filter("turn_no > 0").select("session_id", F.coalesce("start_ts", F.lit(0).cast("long")).alias("at"),
                                                F.lit(0).alias("what"), F.col("turn_no").alias("_turn"))
    files = artifacts.select("session_id", F.col("mtime").alias("at"), F.lit(1).alias("what"), "rel_path", "path")
    line = files.unionByName(starts, allowMissingColumns=True)
    owned = last_before(by_range(line, ["session_id"], "at"), ["session_id"], ["at", "what", "_turn", "rel_path"], {"turn_no": F.col("_turn")}, F.col("_range"))
    return owned.filter("what = 1").select("session_id", "rel_path", "path", F.col("at").alias("mtime"),
                                           F.coalesce("turn_no", F.lit(0).cast("long")).alias("turn_no"))


def run_artifacts(runs: DataFrame, owned: DataFrame, named: DataFrame) -> DataFrame:
    """``(run_id, session_id, rel_path, path, error)``: a run's files.

    Those its turn wrote; earlier ones only where its answer names them; one its answer names that a later turn wrote
    over is missing, with the reason. ``named`` holds ``(run_id, session_id, rel_path)``.
    """
    mine = (salted_join(owned, runs.select("run_id", "session_id", "turn_no"), ["session_id", "turn_no"], F.col("rel_path"))
            .select("run_id", "session_id", "rel_path", "path", F.lit(None).cast("string").alias("error")))
    other = (named.join(owned.withColumnRenamed("turn_no", "_wrote"), ["session_id", "rel_path"])
             .join(runs.select("run_id", "session_id", "turn_no"), ["run_id", "session_id"])
             .filter(F.col("_wrote") != F.col("turn_no"))
             .select("run_id", "session_id", "rel_path", "path",
                     F.when(F.col("_wrote") > F.col("turn_no"), "changed after a later turn began").alias("error")))
    return mine.unionByName(other)


def download_owner(downloads: DataFrame) -> DataFrame:
    """``downloads`` with ``owns_path`` and ``is_url_file``: of two that wrote one path, and of two of one URL, the later counts.

    ``downloads`` holds ``(run_id, url, saved_path, ts, session_id, index)``; streams are compared by time.
    """
    place = F.struct("ts", "session_id", "index", "pos")
    by_path = downloads.groupBy("run_id", "saved_path").agg(F.max(place).alias("_p"))
    paths = salted_join(downloads, by_path, ["run_id", "saved_path"], place).withColumn("owns_path", place == F.col("_p")).drop("_p")
    by_url = paths.filter("owns_path").groupBy("run_id", "url").agg(F.max(place).alias("_u"))
    return (salted_join(paths, by_url, ["run_id", "url"], place, how="left")
            .withColumn("is_url_file", F.col("owns_path") & F.coalesce(place == F.col("_u"), F.lit(False))).drop("_u"))
