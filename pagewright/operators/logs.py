"""A run's events as the lines of a log, at four levels of detail."""
from __future__ import annotations

import json
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from pagewright.operators.events import UNREAD
from pagewright.operators.ordered import chunk_of, numbered, running_sum

LEVELS = ["progress", "steps", "full", "raw"]
#: Characters a line keeps of what the full level prints.
OUTPUT_CHARS = 2000


@dataclass(frozen=True)
class Widths:
    """Characters a line keeps of each part below the full level, and of a record of an unknown role."""
    prompt: int = 200
    system: int = 200
    argument: int = 200
    text: int = 400
    raw: int = 120


def cut(text: Column, n: int) -> Column:
    """The first ``n`` characters, and how many more there are."""
    more = F.concat(F.lit("…(+"), (F.length(text) - n).cast("string"), F.lit(")"))
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n), more)).otherwise(text)


def first_line(text: Column, chars: int = Widths.prompt) -> Column:
    """A text's first line, up to ``chars`` characters, and how much follows it."""
    line = F.substring(F.substring_index(text, "\n", 1), 1, chars)
    left = F.length(text) - F.length(line)
    return F.when(left > 0, F.concat(line, F.lit(" …(+"), left.cast("string"), F.lit(")"))).otherwise(line)


@F.pandas_udf(ArrayType(StringType()))
def _arguments(raw: pd.Series) -> pd.Series:
    """Each call's arguments as JSON, keys in the order they were written in."""
    def written(record: str | None) -> list[str] | None:
        if record is None:
            return None
        blocks = json.loads(record).get("content")
        calls = [b for b in blocks if isinstance(b, dict) and b.get("type") == "toolCall"] if isinstance(blocks, list) else []
        return [json.dumps(b.get("arguments"), ensure_ascii=False) for b in calls]
    return raw.map(written)


def tool_usage(calls: Column) -> Column:
    """What a message reached for: ``name×count[targets]`` per tool, in order of first use."""
    def one(name: Column) -> Column:
        of_name = F.filter(calls, lambda c: c["name"] == name)
        targets = F.filter(F.transform(of_name, lambda c: c["target"]), lambda t: t != "")
        shown = F.when(F.size(targets) > 0, F.concat(F.lit("["), F.array_join(targets, ", "), F.lit("]"))).otherwise("")
        return F.concat(name, F.lit("×"), F.size(of_name).cast("string"), shown)

    return F.transform(F.array_distinct(F.transform(calls, lambda c: c["name"])), one)


def tool_usage_progress(events: DataFrame) -> DataFrame:
    """``(session_id, index, usage)`` of every message that called tools."""
    calling = events.filter(F.size("tool_calls") > 0)
    return calling.select("session_id", "index", F.array_join(tool_usage(F.col("tool_calls")), " ").alias("usage"))


def _blocks_note() -> Column:
    return F.when(F.col("unknown_blocks") > 0, F.concat(F.lit("["), F.col("unknown_blocks").cast("string"),
                                                        F.lit(" unrecognised block(s)]")))


def _labelled(label: str, text: Column) -> Column:
    return F.when(text != "", F.concat(F.lit(label), text))


def _progress(widths: Widths) -> Column:
    said = first_line(F.col("content"), widths.prompt)
    usage = F.array_join(tool_usage(F.col("tool_calls")), " ")
    answered = (F.col("stop") == "end")
    message = F.array(F.when(usage != "", usage), F.when(answered, _labelled("answer: ", said)).otherwise(_labelled("says: ", said)),
                      _blocks_note(), _labelled("error: ", first_line(F.col("error"), widths.prompt)))
    failed = F.array(F.concat(F.col("tool_name"), F.lit(" ERROR: "), said))
    return (F.when(F.col("kind") == "user", F.array(F.concat(F.lit("prompt: "), said)))
            .when(F.col("kind") == "assistant", message)
            .when((F.col("kind") == "tool_result") & F.col("is_error"), failed)
            .when(F.col("kind") == "system", F.array(F.concat(F.lit("system: "), F.substring_index("content", "\n", 1)))))


def _detail(full: bool, widths: Widths) -> Column:
    limit = (lambda n: OUTPUT_CHARS) if full else (lambda n: n)
    text = lambda n: cut(F.col("content"), limit(n))
    calls = F.transform(F.arrays_zip(F.col("tool_calls.name").alias("n"), F.col("_arguments").alias("a")),
                        lambda c: F.concat(F.lit("call "), c["n"], F.lit("("), cut(c["a"], limit(widths.argument)), F.lit(")")))
    message = F.concat(F.coalesce(calls, F.array().cast("array<string>")),
                       F.array(F.when(F.col("content") != "", text(widths.text)), _blocks_note(), _labelled("error: ", F.col("error"))))
    number = F.when(F.col("stream") < 0, F.concat(F.lit("#"), (F.col("_results") - 1).cast("string"), F.lit(" "))).otherwise("")
    count = F.size("sources")
    line = F.concat(number, F.col("tool_name"), F.when(F.col("is_error"), " ERROR").otherwise(""), F.lit(" out="),
                    F.length("content").cast("string"), F.lit("B"),
                    F.when(count > 0, F.concat(F.lit(" sources="), count.cast("string"))).otherwise(""))
    result = F.array(line, F.when(F.lit(full) & (F.col("content") != ""), text(OUTPUT_CHARS)))
    raw = F.concat(F.col("kind"), F.lit("["), F.col("index").cast("string"), F.lit("] "), cut(F.col("content"), widths.raw))
    return (F.when(F.col("kind") == "user", F.array(F.concat(F.lit("user: "), text(widths.prompt))))
            .when(F.col("kind") == "assistant", message)
            .when(F.col("kind") == "tool_result", result)
            .when(F.col("kind") == "system", F.array(F.concat(F.lit("system: "), text(widths.system))))
            .when(F.col("kind") == "lifecycle", F.array(F.concat(F.lit("turn "), F.col("lifecycle"))))
            .when(F.col("kind").isin(*UNREAD), F.array(raw)))


def log_lines(scoped: DataFrame, level: str = "progress", widths: Widths = Widths(), also: tuple[str, ...] = ()) -> DataFrame:
    """``(run_id, line_no, line)``: the log of each run, its own stream first, then each child's; with ``also``, columns of the event a line is of.

    Every line of a child's event carries the child's prefix. The steps and full levels print call arguments as they were
    written, through a small Arrow UDF; progress stays in the JVM.
    """
    if level not in LEVELS:
        raise ValueError(f"level must be one of {LEVELS}")
    if level == "raw":
        shown = scoped.withColumn("_parts", F.array("raw"))
    elif level == "progress":
        shown = scoped.withColumn("_parts", _progress(widths))
    else:
        counted = running_sum(scoped, ["run_id", "child_id"], ["index"], (F.col("kind") == "tool_result").cast("long"), "_results",
                              chunk_of(F.col("index")))
        called = F.when(F.size("tool_calls") > 0, F.col("raw"))
        shown = counted.withColumn("_arguments", _arguments(called)).withColumn("_parts", _detail(level == "full", widths))
    texts = F.filter("_parts", lambda p: p.isNotNull())
    lines = F.flatten(F.transform(texts, lambda t: F.array(t) if level == "raw" else F.split(t, "\n")))
    rows = shown.select("run_id", "stream", "child_id", "index", *also, F.posexplode(lines).alias("_pos", "_line"))
    prefix = F.concat(F.lit("[child "), F.col("child_id"), F.lit("]"), F.when(F.col("_line") == "", "").otherwise(" "))
    written = F.when(F.col("child_id") == "", F.col("_line")).otherwise(F.concat(prefix, F.col("_line")))
    placed = numbered(rows, ["run_id"], ["stream", "child_id", "index", "_pos"], "line_no",
                      F.struct("stream", "child_id", chunk_of(F.col("index"))))
    return placed.select("run_id", "line_no", F.when(F.lit(level == "raw"), F.col("_line")).otherwise(written).alias("line"), *also)
