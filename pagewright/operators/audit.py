"""Checks over whole stores of transcripts."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright.operators.events import UNREAD, event_sources, tool_calls

# Tools whose results this reads.
KNOWN_TOOLS = ["websearch", "webfetch", "repl", "bash", "read_file", "subagent", "subagent_wait", "write_todos", "get_time",
               "memory_search", "history_search", "closeTab"]


def known_tools_audit(events: DataFrame, known: list[str] | None = None) -> DataFrame:
    """``(name, calls)`` of tools never seen before."""
    new = tool_calls(events).filter(~F.col("name").isin(KNOWN_TOOLS if known is None else known))
    return new.groupBy("name").agg(F.count("*").alias("calls"))


def unread_records(events: DataFrame) -> DataFrame:
    """``(session_id, unread)`` of sessions with records of an unknown role, or too large to read."""
    return events.filter(F.col("kind").isin(*UNREAD)).groupBy("session_id").agg(F.count("*").alias("unread"))


def record_counts(records: DataFrame, events: DataFrame) -> DataFrame:
    """Sessions whose number of events is not their number of records. Always empty, unless records are split or lost."""
    read = records.groupBy("session_id").agg(F.count("*").alias("records"))
    made = events.groupBy("session_id").agg(F.count("*").alias("events"))
    both = read.join(made, "session_id", "full").fillna(0, ["records", "events"])
    return both.filter(F.col("records") != F.col("events"))


def saved_path_audit(events: DataFrame, files: DataFrame) -> DataFrame:
    """``(session_id, index, saved_path)``: files that results name and ``files`` ``(path)`` does not list."""
    named = event_sources(events).filter(F.col("saved_path") != "").select("session_id", "index", "saved_path").distinct()
    return named.join(files.select(F.col("path").alias("saved_path")).distinct(), "saved_path", "left_anti")


def session_profile(events: DataFrame) -> DataFrame:
    """Per session and tool, with the session's subtotal (``tool`` null): results, errors, children, longest and median time.

    One row set a session; the subtotals come from the same aggregation by ``rollup``.
    """
    results = events.filter(F.col("kind") == "tool_result")
    rolled = results.rollup("session_id", F.col("tool_name").alias("tool")).agg(
        F.count("*").alias("results"), F.count_if("is_error").alias("errors"), F.sum(F.size("child_ids")).alias("children"),
        F.max("duration_ms").alias("longest_ms"), F.percentile_approx("duration_ms", 0.5).alias("median_ms"))
    return rolled.filter(F.col("session_id").isNotNull())


def session_kinds(events: DataFrame) -> DataFrame:
    """Per session: events of each kind, tokens, and the time from its first record to its last."""
    kinds = ["user", "assistant", "tool_result", "system", "lifecycle", "meta", *UNREAD]
    return events.groupBy("session_id").agg(
        *(F.count_if(F.col("kind") == k).alias(k) for k in kinds), F.sum("usage.total_tokens").alias("total_tokens"),
        (F.max("ts") - F.min("ts")).alias("span_ms"))
