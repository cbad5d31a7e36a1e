"""Page corpora and fetch logs."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

UNREADABLE = "a line of the log is not a record"
FETCH_SCHEMA = ("url string, final_url string, status int, content_type string, kind string, text string, body_b64 string, "
                "ext string, error string, threw boolean, via string, attempt_no int, requested int, elapsed_ms long, "
                "hit_budget boolean, unreadable string")


def scan_pages(spark: SparkSession, folder: str) -> DataFrame:
    """The page table of ``folder`` as responses that were read."""
    pages = spark.read.parquet(f"{folder}/pages.parquet")
    return pages.select("page_id", "url", F.col("url").alias("final_url"), F.lit(200).alias("status"),
                        F.lit("text/html; charset=utf-8").alias("content_type"), F.lit("text").alias("kind"),
                        F.col("html").alias("text"))


def scan_fetch_log(spark: SparkSession, path: str) -> DataFrame:
    """A fetch log: one JSON record a line, ended by a line feed alone; batch trailers are left out.

    A line that is no record stays, as an error of its own with the line itself in ``unreadable``: it counts, and nothing vanishes.
    """
    log = _records(spark, path)
    bad = F.col("unreadable").isNotNull()
    return (log.filter(bad | ~F.coalesce(F.col("kind") == "batch_done", F.lit(False))).drop("requested", "elapsed_ms", "hit_budget")
            .withColumn("kind", F.when(bad, "error").otherwise(F.col("kind"))).withColumn("error", F.when(bad, UNREADABLE).otherwise(F.col("error"))))


def _records(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(FETCH_SCHEMA).option("lineSep", "\n").option("columnNameOfCorruptRecord", "unreadable").json(path)


def batch_trailers(spark: SparkSession, path: str) -> DataFrame:
    """The trailers of a fetch log: what each batch asked for and whether its budget ran out."""
    log = _records(spark, path)
    return log.filter(F.col("kind") == "batch_done").select("requested", "elapsed_ms", "hit_budget")


def write_pages(items: DataFrame, path: str) -> None:
    """Save page texts, a folder per site and crawl. A destination that already holds something is refused."""
    items.write.mode("errorifexists").partitionBy("site", "crawl_id").parquet(path)
