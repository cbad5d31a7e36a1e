"""Transcript records as typed events.

A record is one JSON value of an open schema. It is parsed once into a variant; what is known is projected, what is not
is kept, and nothing fails on a role, a block or a shape met for the first time.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewright.functions.urls import authority_host

# Roles of records, and the kinds of event they are.
KINDS = {"user": "user", "assistant": "assistant", "toolResult": "tool_result", "system-message": "system",
         "turn-lifecycle": "lifecycle", "user-message-metadata": "meta", "compaction": "meta"}
# Why a message stopped.
STOPS = {"toolUse": "tool", "stop": "end", "error": "error"}
# Blocks this reads.
BLOCKS = ["text", "toolCall", "thinking", "image"]
# Tools that open pages.
PAGE_TOOL = "webfetch"
BROWSER_TOOL = "repl"
# Notices in tool results.
OVERFLOW = r"^\[Output too large \([^)]*\)\. Full output saved to: (.+?)(?: — read it with [^\n]*)?\]\n"
PREVIEW = r"^\[Output too large [^\n]*\]\n\nPreview \(first [^)]*\):\n"
REFUSAL = r"^<[a-z]+-citation [^>]*/>\nHTTP [45][0-9][0-9]"
DOWNLOAD = r"\nDownloaded to: ([^\n]+)\nMIME type: [^\n]*\nFile size: ([0-9]+) bytes"
SNAPSHOT_LINE = r"(?s)^- title: \"(.*)\" \[url=(.+)\]$"
OPENED_LINE = r"(?s)^✔\x{FE0E}? Opened .* page → (.*?) \((https?://.*)\)$"

SOURCE = "struct<id:string,url:string,title:string,excerpt:string,opened:boolean,holds_page:boolean,saved_path:string>"


def _get(value: Column, path: str, kind: str = "string") -> Column:
    return F.try_variant_get(value, path, kind)


def _text(block: Column) -> Column:
    return F.coalesce(_get(block, "$.text"), F.lit(""))


def _is(block: Column, kind: str) -> Column:
    return F.coalesce(_get(block, "$.type") == kind, F.lit(False))


def one_line(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def flatten_content(content: Column) -> Column:
    """A result's content as text: text blocks joined by line feeds; a list with any other block as JSON; a string as is."""
    blocks = _get(content, "$", "array<variant>")
    only_text = F.forall(blocks, lambda b: _is(b, "text"))
    return (F.when(blocks.isNull(), _get(content, "$"))
            .when(only_text, F.array_join(F.transform(blocks, _text), "\n"))
            .otherwise(F.to_json(content)))


def spoken_text(content: Column) -> Column:
    """What a message says: its text blocks, whatever stands beside them."""
    blocks = _get(content, "$", "array<variant>")
    said = F.array_join(F.transform(F.filter(blocks, lambda b: _is(b, "text")), _text), "\n")
    return F.when(blocks.isNull(), _get(content, "$")).otherwise(said)


def unknown_blocks(content: Column) -> Column:
    """How many blocks of a content are of a type not known here."""
    blocks = _get(content, "$", "array<variant>")
    strange = F.filter(blocks, lambda b: ~F.coalesce(_get(b, "$.type").isin(BLOCKS), F.lit(False)))
    return F.when(blocks.isNull(), 0).otherwise(F.size(strange)).cast("int")


def _calls(content: Column) -> Column:
    def call(block: Column) -> Column:
        url = _get(block, "$.arguments.url")
        target = F.coalesce(_get(block, "$.arguments.description"), F.when(url.isNotNull(), authority_host(url)),
                            _get(block, "$.arguments.objective"), F.lit(""))
        return F.struct(F.coalesce(_get(block, "$.name"), F.lit("")).alias("name"), one_line(target).alias("target"))

    blocks = F.coalesce(_get(content, "$", "array<variant>"), F.array().cast("array<variant>"))
    return F.transform(F.filter(blocks, lambda b: _is(b, "toolCall")), call)


def page_text(content: Column) -> Column:
    """A tool result's text without the notice that it was kept in a file."""
    return F.regexp_replace(content, PREVIEW, "")


def http_refusal(content: Column) -> Column:
    """Whether a fetch got an error status: the status line stands right after the citation tag, with no blank line."""
    return F.coalesce(page_text(content).rlike(REFUSAL), F.lit(False))


def overflow_pointer(content: Column) -> Column:
    """The file a result too large to keep inline was saved to, or the empty string."""
    return F.when(http_refusal(content), "").otherwise(F.regexp_extract(content, OVERFLOW, 1))


def download_path(content: Column) -> Column:
    """The file a fetch downloaded: none when it is empty or came with an error status."""
    size = F.regexp_extract(content, DOWNLOAD, 2)
    held = (size != "") & ~size.rlike("^0+$") & ~http_refusal(content)
    return F.when(held, F.regexp_extract(content, DOWNLOAD, 1)).otherwise("")


def _printed_pages(content: Column) -> Column:
    """Pages a browser tool's text says it opened or read, in printed order, each URL once."""
    def page(line: Column) -> Column:
        read = F.regexp_extract(line, SNAPSHOT_LINE, 2)
        return F.struct(
            F.when(read != "", read).otherwise(F.regexp_extract(line, OPENED_LINE, 2)).alias("url"),
            F.when(read != "", F.regexp_extract(line, SNAPSHOT_LINE, 1)).otherwise(F.regexp_extract(line, OPENED_LINE, 1)).alias("title"))

    lines = F.filter(F.split(content, "\n"), lambda line: line.startswith("- title: ") | line.startswith("✔"))
    pages = F.filter(F.transform(lines, page), lambda p: p["url"] != "")
    urls = F.transform(pages, lambda p: p["url"])
    return F.filter(pages, lambda p, i: F.array_position(urls, p["url"]) == i + 1)


def _sources(record: Column, tool: Column, content: Column, failed: Column) -> Column:
    listed = F.coalesce(_get(record, "$.details.sources", "array<variant>"), F.array().cast("array<variant>"))
    opened = (tool == PAGE_TOOL) & ~failed & ~http_refusal(content)
    downloaded = F.regexp_extract(content, DOWNLOAD, 1) != ""
    saved = F.when(tool == PAGE_TOOL, F.when(downloaded, download_path(content)).otherwise(overflow_pointer(content))).otherwise("")

    def source(s: Column) -> Column:
        return F.struct(*(F.coalesce(_get(s, f"$.{k}"), F.lit("")).alias(k) for k in ("id", "url", "title", "excerpt")),
                        opened.alias("opened"), (opened & ~downloaded).alias("holds_page"), saved.alias("saved_path"))

    def printed(p: Column) -> Column:
        return F.struct(F.lit("").alias("id"), p["url"].alias("url"), p["title"].alias("title"), F.lit("").alias("excerpt"),
                        F.lit(True).alias("opened"), F.lit(True).alias("holds_page"), F.lit("").alias("saved_path"))

    return F.when(tool == BROWSER_TOOL, F.concat(F.transform(listed, source), F.transform(_printed_pages(content), printed))
                  ).otherwise(F.transform(listed, source)).cast(f"array<{SOURCE}>")


def _children(record: Column) -> Column:
    none = F.array().cast("array<string>")
    results = F.coalesce(_get(record, "$.details.results", "array<variant>"), F.array().cast("array<variant>"))
    named = F.concat(F.array(_get(record, "$.details.taskId")), F.coalesce(_get(record, "$.details.taskIds", "array<string>"), none),
                     F.transform(results, lambda r: _get(r, "$.taskId")))
    return F.array_distinct(F.filter(named, lambda c: F.coalesce(c.rlike("^[A-Za-z0-9]+$"), F.lit(False))))


def _usage(record: Column) -> Column:
    def count(key: str) -> Column:
        return F.coalesce(_get(record, f"$.usage.{key}", "bigint"), F.lit(0).cast("long"))

    return F.struct(count("input").alias("input"), count("output").alias("output"), count("cacheRead").alias("cache_read"),
                    count("cacheWrite").alias("cache_write"), count("reasoning").alias("reasoning"),
                    count("totalTokens").alias("total_tokens"),
                    F.coalesce(_get(record, "$.usage.cost.total", "double"), F.lit(0.0)).alias("cost"))


#: Kinds of records that could not be read: of an unknown role or no JSON, and larger than the engine's variant type holds.
UNREAD = ("raw", "oversized")
#: From this size on a record may not fit the engine's variant type.
VARIANT_BYTES = 128 * 1024 * 1024


def normalize_events(records: DataFrame) -> DataFrame:
    """One event a record of ``(session_id, index, raw)``; a record of an unknown role is an event of kind ``raw``.

    A record that is JSON but larger than a variant may be is of kind ``oversized``, so it is not taken for one of an unknown role.
    """
    mapped = lambda names, value: F.coalesce(*(F.when(value == k, v) for k, v in names.items()))
    parsed = records.withColumn("_r", F.try_parse_json("raw"))
    typed = (parsed.withColumn("_role", _get(F.col("_r"), "$.role"))
             .withColumn("kind", F.coalesce(mapped(KINDS, F.col("_role")), F.when(F.col("_r").isNull() & (F.octet_length("raw") >= VARIANT_BYTES), "oversized"), F.lit("raw")))
             .withColumn("_content", _get(F.col("_r"), "$.content", "variant"))
             .withColumn("tool_name", F.coalesce(_get(F.col("_r"), "$.toolName"), F.lit("")))
             .withColumn("is_error", F.coalesce(_get(F.col("_r"), "$.isError", "boolean"), F.lit(False))))
    is_result, is_message = F.col("kind") == "tool_result", F.col("kind").isin("assistant", "user")
    content = (F.when(is_message, spoken_text(F.col("_content"))).when(F.col("kind").isin(*UNREAD), F.col("raw"))
               .otherwise(flatten_content(F.col("_content"))))
    read = typed.withColumn("content", F.coalesce(content, F.lit("")))
    stop = F.when(F.col("kind") == "assistant", F.coalesce(mapped(STOPS, _get(F.col("_r"), "$.stopReason")), F.lit(""))).otherwise("")
    none = F.array().cast
    return (read.withColumn("lifecycle", F.when(F.col("kind") == "lifecycle", F.coalesce(_get(F.col("_r"), "$.event"), F.lit(""))).otherwise(""))
            .withColumn("stop", stop).withColumn("stopped", F.col("stop").isin("end", "error"))
            .withColumn("error", F.coalesce(_get(F.col("_r"), "$.errorMessage"), F.lit("")))
            .withColumn("ts", _get(F.col("_r"), "$.timestamp", "bigint"))
            .withColumn("tool_calls", F.when(F.col("kind") == "assistant", _calls(F.col("_content")))
                        .otherwise(none("array<struct<name:string,target:string>>")))
            .withColumn("sources", F.when(is_result, _sources(F.col("_r"), F.col("tool_name"), F.col("content"), F.col("is_error")))
                        .otherwise(none(f"array<{SOURCE}>")))
            .withColumn("child_ids", F.when(is_result, _children(F.col("_r"))).otherwise(none("array<string>")))
            .withColumn("usage", F.when(F.col("kind") == "assistant", _usage(F.col("_r"))))
            .withColumn("unknown_blocks", F.when(is_message, unknown_blocks(F.col("_content"))).otherwise(0))
            .withColumn("duration_ms", _get(F.col("_r"), "$.timing.durationMs", "double"))
            .drop("_r", "_role", "_content"))


def _each(events: DataFrame, keep: list[str], array: str, out: str) -> DataFrame:
    """``keep`` with one row an entry of ``array``, and its place ``pos``.

    Exploded outer: an inner explode also filters rows by the array's size, below the typing, where a column made from a record is worked out anew for each condition.
    """
    return events.select(*keep, F.posexplode_outer(array).alias("pos", out)).filter(F.col("pos").isNotNull())


def tool_calls(events: DataFrame) -> DataFrame:
    """``(session_id, index, pos, name, target)``: what was called, and in one line what for."""
    return _each(events, ["session_id", "index"], "tool_calls", "_c").select("session_id", "index", "pos", "_c.name", "_c.target")


def event_sources(events: DataFrame, *also: str) -> DataFrame:
    """One row a source an event names, with its place in the event."""
    keep = [c for c in ("run_id", "child_id", "stream", "session_id", "turn_no", "index", "ts", "tool_name", *also) if c in events.columns]
    return _each(events, keep, "sources", "_s").select(*keep, "pos", "_s.*")


def downloads(events: DataFrame) -> DataFrame:
    """Documents that fetches saved in their own session's folder; a path outside of it names no document."""
    rows = event_sources(events).filter((F.col("saved_path") != "") & ~F.col("holds_page"))
    # .../sessions/<date>_<session>/...: the session's own folder, not a folder of that name elsewhere in the path
    own = F.regexp_extract("saved_path", r"^(?:.*/)?sessions/[0-9]{4}-[0-9]{2}-[0-9]{2}_([A-Za-z0-9]+)/", 1)
    return rows.filter((own == F.col("session_id")) & ~F.contains("saved_path", F.lit("/../")))


def browser_pages(events: DataFrame) -> DataFrame:
    """Pages read in browser tabs."""
    return event_sources(events.filter(F.col("tool_name") == BROWSER_TOOL)).filter("opened")


def usage_rows(events: DataFrame) -> DataFrame:
    return events.filter(F.col("usage").isNotNull()).select("session_id", "index", "usage.*")


def child_ids(events: DataFrame) -> DataFrame:
    """``(session_id, index, child_id)``: child sessions an event names."""
    return _each(events, ["session_id", "index"], "child_ids", "child_id").select("session_id", "index", "child_id")
