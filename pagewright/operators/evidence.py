"""What a run gathered: usage, sources, their text, its answer.

``scoped`` is ``turns.whole_scope``: the records of a run and its children, with ``run_id``, ``stream`` (-1 for the run's
own), ``child_id``, ``session_id`` and ``index``. Results are long tables, one row a source, an id, an answer: nothing
gathers a run into one array.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewright.operators.events import BROWSER_TOOL, event_sources, page_text
from pagewright.operators.ordered import chunk_of, copied_join, numbered, pages_of_text, salted_join

USAGE = ["input", "output", "cache_read", "cache_write", "reasoning", "total_tokens"]
#: Rank of a text for a source: a page that was read, the source's own excerpt, whatever else the result says.
PAGE, EXCERPT, RESULT = 3, 2, 1
CITATION_TAG = r"^<[a-z]+-citation [^>]*/>\n*"
OPENED_NOTICE = r"(?m)^✔\x{FE0E}? Opened [^\n]* page → [^\n]*$"


def usage_totals(scoped: DataFrame) -> DataFrame:
    """Tokens and cost of each run, its children's part included."""
    used = scoped.filter(F.col("usage").isNotNull())
    return used.groupBy("run_id").agg(*(F.sum(f"usage.{k}").alias(k) for k in USAGE), F.sum("usage.cost").alias("cost"))


def _place() -> Column:
    return F.struct("stream", "child_id", "index", "pos")


def _in_session(rows: DataFrame) -> Column:
    # one record may name several children, so their records come after each other, not by index
    return F.struct("stream", "child_id", chunk_of(F.col("index")))


def scoped_sources(scoped: DataFrame) -> DataFrame:
    return event_sources(scoped).filter(F.col("url") != "")


def merge_sources(scoped: DataFrame) -> DataFrame:
    """``(run_id, n, url, title, opened)``: each page once, numbered as first seen, the run's own stream first.

    A page counts as opened when any stream opened it. Its ids are in ``source_ids``.
    """
    rows = scoped_sources(scoped)
    named = F.when(F.col("title") != "", _place())
    merged = rows.groupBy("run_id", "url").agg(F.min(_place()).alias("_first"), F.max("opened").alias("opened"),
                                               F.min_by("title", named).alias("title"))
    placed = merged.withColumns({c: F.col(f"_first.{c}") for c in ("stream", "child_id", "index")})
    counted = numbered(placed, ["run_id"], ["_first", "url"], "n", _in_session(placed))
    return counted.select("run_id", "n", "url", F.coalesce("title", F.lit("")).alias("title"), "opened")


def with_files(rows: DataFrame, owned: DataFrame) -> DataFrame:
    """Rows ``(run_id, url, ...)``, one a source, with ``file``: where the document that is this source's was saved, null where there is none.

    ``owned`` as from ``turns.download_owner``: of a URL's downloads the last one that was not written over. Text kept in a file is a page's, no document.
    """
    files = owned.filter("is_url_file").select("run_id", "url", F.col("saved_path").alias("file"))
    return rows.join(files, ["run_id", "url"], "left")


def source_ids(scoped: DataFrame) -> DataFrame:
    """``(run_id, url, id)``: every id a run's records gave a page. Either of them cites it."""
    return scoped_sources(scoped).filter(F.col("id") != "").select("run_id", "url", "id").distinct()


def source_summary(sources: DataFrame) -> DataFrame:
    """``(run_id, sources_total, sources_opened)``; the opened ones are the rows of ``sources`` that say so."""
    return sources.groupBy("run_id").agg(F.count("*").alias("sources_total"), F.count_if("opened").alias("sources_opened"))


def source_content(scoped: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """``(run_id, url, content, rank)``: the best text there is for each source.

    The longest page that was read; else the source's own excerpt; else what the result that named it says. An empty read
    hides nothing. ``files`` holds ``(path, text)`` of results that were kept in a file: their whole text is the page.
    The best row is chosen on lengths alone, then its text is fetched.
    """
    # a line that says a page was opened names the page, it is none of its text
    held = F.regexp_replace(F.regexp_replace(page_text(F.col("content")), CITATION_TAG, ""), OPENED_NOTICE + r"|\s+", "")
    measured = event_sources(scoped.withColumn("_page", F.length(held)), "_page").filter(F.col("url") != "")
    if files is not None:
        kept = files.select(F.col("path").alias("saved_path"), F.length("text").alias("_kept"))
        measured = measured.join(kept, "saved_path", "left")
    else:
        measured = measured.withColumn("_kept", F.lit(None).cast("int"))
    read = F.col("holds_page") & (F.coalesce("_kept", "_page") > 0)
    rank = (F.when(read, PAGE).when(F.col("excerpt") != "", EXCERPT)
            .when(~F.col("holds_page") & (F.col("saved_path") == "") & (F.col("_page") > 0), RESULT)
            .when(F.col("tool_name") == BROWSER_TOOL, RESULT).otherwise(0))
    size = F.when(rank == PAGE, F.coalesce("_kept", "_page")).otherwise(0)
    best = (measured.withColumn("rank", rank).withColumn("_size", size)
            .groupBy("run_id", "url").agg(F.max(F.struct("rank", "_size", (-F.col("stream")).alias("s"), (-F.col("index")).alias("i"),
                                                         F.col("session_id").alias("session_id"), "pos",
                                                         F.when(F.col("_kept").isNotNull(), F.col("saved_path")).alias("kept"),
                                                         "excerpt")).alias("_b")))
    chosen = best.select("run_id", "url", F.col("_b.rank").alias("rank"), F.col("_b.session_id").alias("session_id"),
                         (-F.col("_b.i")).alias("index"), F.col("_b.kept").alias("path"), F.col("_b.excerpt").alias("excerpt"))
    texts = scoped.select("run_id", "session_id", "index", page_text(F.col("content")).alias("_text"))
    joined = chosen.join(texts, ["run_id", "session_id", "index"])
    content = F.when(F.col("rank") == EXCERPT, F.col("excerpt")).when(F.col("rank") == 0, "").otherwise(F.col("_text"))
    if files is not None:
        joined = joined.join(files.select("path", F.regexp_replace("text", CITATION_TAG, "").alias("_whole")), "path", "left")
        content = F.when((F.col("rank") == PAGE) & F.col("_whole").isNotNull(), F.col("_whole")).otherwise(content)
    return joined.select("run_id", "url", content.alias("content"), "rank")


def tool_result_no(own: DataFrame) -> DataFrame:
    """``(run_id, no, session_id, index, tool_name, content)``: a run's own tool results, numbered from 0."""
    results = own.filter(F.col("kind") == "tool_result")
    placed = numbered(results, ["run_id"], ["index"], "no", chunk_of(F.col("index")))
    return placed.select("run_id", "no", "session_id", "index", "tool_name", "content")


def tool_result_at(own: DataFrame, asked: DataFrame) -> DataFrame:
    """``(run_id, no, found, results, tool_name, content)`` of the tool results asked for by ``(run_id, no)``: ``results`` is how many the run has, also where ``no`` is none of them."""
    there = tool_result_no(own)
    counts = there.groupBy("run_id").agg(F.count("*").alias("results"))
    wanted = salted_join(asked.select("run_id", "no").distinct(), counts, ["run_id"], F.col("no"), "left")
    met = wanted.join(there.select("run_id", "no", "tool_name", "content", F.lit(True).alias("found")), ["run_id", "no"], "left")
    return met.select("run_id", "no", F.coalesce("found", F.lit(False)).alias("found"), F.coalesce("results", F.lit(0)).alias("results"), "tool_name", "content")


def final_answer(runs: DataFrame, events: DataFrame) -> DataFrame:
    """``(run_id, answer)``: the last message of a finished turn that stopped to answer; nothing of an unfinished one.

    ``runs`` as from ``turns.run_turns``.
    """
    said = events.filter((F.col("kind") == "assistant") & (F.col("stop") == "end")).select(
        "session_id", F.col("index").alias("last_end_index"), "content")
    return (runs.select("run_id", "session_id", F.when(F.col("finished"), F.col("last_end_index")).alias("last_end_index"))
            .join(said, ["session_id", "last_end_index"], "left")
            .select("run_id", F.coalesce("content", F.lit("")).alias("answer")))


def child_answers(tasks: DataFrame, turns: DataFrame, events: DataFrame) -> DataFrame:
    """``(run_id, child_id, mention, answer)``: each child's answer to its last task of the run, if it finished that."""
    done = tasks.filter("last_task").join(
        turns.filter("finished").select(F.col("session_id").alias("child_id"), "turn_no", "last_end_index"), ["child_id", "turn_no"])
    said = events.filter((F.col("kind") == "assistant") & (F.col("stop") == "end")).select(
        F.col("session_id").alias("child_id"), F.col("index").alias("last_end_index"), F.col("content").alias("answer"))
    # a child is usually named by one run, so its answer is sent once; copies of a task in many runs are spread by run
    return (copied_join(done, said, ["child_id", "last_end_index"], F.col("run_id"))
            .filter(F.col("answer") != "").select("run_id", "child_id", "mention", "answer"))


def answer_with_children(answers: DataFrame, children: DataFrame) -> DataFrame:
    """``(run_id, page, answer)``: a run's answer and its children's after it, each under its child's id.

    One page for all but enormous answers, whose pages put end to end are the whole.
    """
    own = answers.select("run_id", F.lit(-1).cast("long").alias("mention"), F.lit("").alias("child_id"), F.col("answer").alias("_part"))
    heading = F.concat(F.lit("\n\n--- child "), F.col("child_id"), F.lit(" ---\n"))
    theirs = children.select("run_id", "mention", "child_id", F.concat(heading, F.col("answer")).alias("_part"))
    return pages_of_text(own.unionByName(theirs), ["run_id"], ["mention", "child_id"], F.col("_part"), "answer",
                         chunk_of(F.col("mention")))
