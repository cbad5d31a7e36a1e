"""From a log of fetch attempts to one outcome per URL.

A log row is one attempt: ``url, attempt_no, via`` (``fetch`` or ``tab``) and the response's fields. The decisions work on
narrow rows: a body is read for its status and left behind before anything is shuffled.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewright.functions.urls import authority_host
from pagewright.operators.ordered import chunk_of, numbered, salted_join
from pagewright.operators.pages import page_status
from pagewright.session import stored

# Errors a browser reports.
TIMEOUT = "timeout"
DETACHED = "CDP session detached"


def assign_batches(urls: DataFrame, k: int, keys: list[str] | None = None) -> DataFrame:
    """``batch``: the list cut into batches of ``k`` in its order ``ord``."""
    placed = numbered(urls, keys or ["root"], [F.col("ord"), F.col("url")], "_n", chunk_of(F.col("ord")))
    return placed.withColumn("batch", F.floor(F.col("_n") / k).cast("long")).drop("_n")


def _fetch() -> Column:
    return F.coalesce(F.col("via"), F.lit("fetch")) == "fetch"


def retry_set(log: DataFrame) -> DataFrame:
    """URLs to fetch once more on their own: their only fetch timed out. An HTTP error is an answer."""
    timed_out = (F.col("kind") == "error") & (F.col("error") == TIMEOUT)
    return (log.filter(_fetch()).groupBy("url").agg(F.count("*").alias("_n"), F.count_if(timed_out).alias("_t"))
            .filter((F.col("_n") == 1) & (F.col("_t") == 1)).select("url"))


def detached_retry(log: DataFrame) -> DataFrame:
    """URLs to open in a tab once more: their only tab lost its session. No other tab error is worth a second try."""
    lost = (F.col("kind") == "error") & F.contains(F.col("error"), F.lit(DETACHED))
    return (log.filter(F.col("via") == "tab").groupBy("url").agg(F.count("*").alias("_n"), F.count_if(lost).alias("_d"))
            .filter((F.col("_n") == 1) & (F.col("_d") == 1)).select("url"))


def judged(log: DataFrame, min_words: int = 80, place: str | None = None) -> DataFrame:
    """Each attempt with its status, without its body."""
    ready = log.withColumn("_threw", F.coalesce(F.col("threw"), F.lit(False)))
    return page_status(ready, min_words).select("url", "attempt_no", "via", F.col("kind"), F.col("_threw").alias("threw"), "status",
                                                "http_status", "error", "words", "title", "body_kind", "ext", *([place] if place else []))


def _number(place: str | None) -> Column:
    """What the last attempt is the largest of: its number, and of one number, where a URL was listed more than once, the first ``place``."""
    if place is None:
        return F.col("attempt_no")
    return F.when(F.col("attempt_no").isNotNull(), F.struct("attempt_no", (-F.col(place)).alias("_place")))


def _per_url(attempts: DataFrame, place: str | None = None) -> DataFrame:
    """The last fetch and the last tab of each URL."""
    fields = F.struct("kind", "threw", "status", "http_status", "error", "words", "title", "body_kind", "ext")
    fetch, tab = _fetch(), F.col("via") == "tab"
    return attempts.groupBy("url").agg(
        F.max_by(fields, F.when(fetch, _number(place))).alias("_f_any"),
        F.max_by(fields, F.when(tab, _number(place))).alias("_t_any"),
        F.count_if(fetch).alias("_nf"), F.count_if(tab).alias("_nt"),
        F.min("attempt_no").alias("_first")).select(
            "url", "_nf", "_nt", "_first", F.when(F.col("_nf") > 0, F.col("_f_any")).alias("f"),
            F.when(F.col("_nt") > 0, F.col("_t_any")).alias("t"))


def _outcomes(log: DataFrame, min_words: int, place: str | None) -> DataFrame:
    """``_per_url`` of a log, written once: what hosts said is read from it again, and no page is judged twice."""
    return stored(_per_url(judged(log, min_words, place), place), "outcomes")


def _hosts(last: DataFrame) -> DataFrame:
    """Per host: whether a tab opened there, whether one could not, what it said, and the first URL a fetch threw on."""
    host = authority_host(F.col("url")).alias("host")
    failed = F.col("t.kind") == "error"
    return last.groupBy(host).agg(
        F.max(failed).alias("tab_failed"), F.max(F.col("t").isNotNull() & ~failed).alias("tab_opened"),
        F.min_by(F.col("t.error"), F.when(failed, F.col("url"))).alias("_said"),
        F.min(F.when(F.col("f.threw") & F.col("t").isNull(), F.col("url"))).alias("first_thrown"))


def escalation_set(log: DataFrame, min_words: int = 80, place: str | None = None) -> DataFrame:
    """URLs to read in a browser tab: shells, bot checks, misread pages and fetches that threw.

    Not those a tab already read, and none of a host where a tab could not be opened. Where nothing is known of a host's
    tabs, the first URL a fetch threw on goes alone: its tab answers for the host.
    """
    last = _outcomes(log, min_words, place).filter(F.col("f").isNotNull() | F.col("t").isNotNull())
    page = F.col("f.status").isin("shell", "challenge")
    wanted = last.filter(F.col("t").isNull() & (page | F.col("f.threw"))).withColumn("host", authority_host(F.col("url")))
    placed = salted_join(wanted, _hosts(last), ["host"], F.col("url"))
    goes = ~F.coalesce(F.col("tab_failed"), F.lit(False)) & (
        page | F.coalesce(F.col("tab_opened"), F.lit(False)) | (F.col("url") == F.col("first_thrown")))
    return placed.filter(goes).select("url", F.col("f.status").alias("status"))


def resolve_attempts(log: DataFrame, min_words: int = 80, place: str | None = None) -> DataFrame:
    """One item per URL: the tab's answer where it gave one, else the fetch's, with what each of them said.

    A URL may be listed more than once and its attempts share their numbers; ``place`` names a number of the log that says which was listed first, and that one counts.
    """
    last = _outcomes(log, min_words, place).withColumn("host", authority_host(F.col("url")))
    failed = _hosts(last).filter("tab_failed").select("host", F.col("_said").alias("_host_said"))
    rows = salted_join(last, failed, ["host"], F.col("url"), how="left")
    tab_error = F.col("t.kind") == "error"
    tab_read = F.col("t").isNotNull() & ~tab_error
    threw = F.coalesce(F.col("f.threw"), F.lit(False))
    fetch_said = F.when(F.col("f.kind") == "error", F.col("f.error"))
    in_tab = F.concat(F.lit("in a tab: "), F.col("t.error"))
    error = (F.when(tab_read & (F.col("t.status") == "ok"), F.lit(None).cast("string"))
             .when(tab_read & threw, F.concat_ws("; in a tab: ", fetch_said, F.col("t.error")))
             .when(tab_read, F.col("t.error"))
             .when(tab_error, F.concat_ws("; ", F.coalesce(fetch_said, F.col("f.error")), in_tab))
             .when(threw & F.col("_host_said").isNotNull(), F.concat_ws("; in a tab: ", fetch_said, F.col("_host_said")))
             .otherwise(F.col("f.error")))
    from_tab = tab_read | F.col("f").isNull()

    def best(field: str) -> Column:
        return F.when(from_tab, F.col(f"t.{field}")).otherwise(F.col(f"f.{field}"))

    return rows.select("url", best("status").alias("status"), best("http_status").alias("http_status"), error.alias("error"),
                       F.when(from_tab, "tab").otherwise("fetch").alias("via"), best("words").alias("words"),
                       best("title").alias("title"), best("ext").alias("ext"), (F.col("_nf") + F.col("_nt")).alias("attempts"))


def resolved_statuses(log: DataFrame, min_words: int = 80, place: str | None = None, **also: Column) -> DataFrame:
    """``(url, status, http_status)`` as ``resolve_attempts`` has them, in one aggregate: titles, messages and hosts are not looked at. ``also`` are aggregates of the log."""
    narrow = page_status(log, min_words)
    fields = F.struct("kind", "status", "http_status")
    fetch, tab = _fetch(), F.col("via") == "tab"
    last = narrow.groupBy("url").agg(F.max_by(fields, F.when(fetch, _number(place))).alias("f"), F.max_by(fields, F.when(tab, _number(place))).alias("t"),
                                     F.count_if(fetch).alias("_nf"), F.count_if(tab).alias("_nt"), *(c.alias(k) for k, c in also.items()))
    from_tab = ((F.col("_nt") > 0) & (F.col("t.kind") != "error")) | (F.col("_nf") == 0)
    return last.select("url", *(F.when(from_tab, F.col(f"t.{c}")).otherwise(F.col(f"f.{c}")).alias(c) for c in ("status", "http_status")), *also)
