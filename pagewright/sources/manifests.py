"""Map and crawl manifests."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.operators.ordered import chunk_of, numbered, salted_join

#: URLs one manifest document holds; a larger site is written as several documents, in order.
PART_URLS = 10_000


def read_manifest(spark: SparkSession, path: str, multiline: bool = False) -> DataFrame:
    """``(root, ord, url)`` of map manifests (``urls``) and crawl manifests (``pages``, then what they left).

    A document is one line, or with ``multiline`` one file; one of several says at which place its list begins. A document of another shape is refused, not read as empty.
    """
    docs = (spark.read.option("recursiveFileLookup", True).text(path, wholetext=multiline, lineSep=None if multiline else "\n")
            .filter(F.trim("value") != "").select(F.col("value").alias("doc"), F.col("_metadata.file_path").alias("file")))
    v = F.try_parse_json(F.col("doc"))
    typed = docs.select(
        "file", v.alias("v"), F.schema_of_variant(v).alias("shape"),
        F.schema_of_variant(F.try_variant_get(v, "$.root", "variant")).alias("root_type"),
        F.schema_of_variant(F.try_variant_get(v, "$.urls", "variant")).alias("urls_type"),
        F.schema_of_variant(F.try_variant_get(v, "$.pages[0]", "variant")).alias("page_type"),
        F.try_variant_get(v, "$.root", "string").alias("root"),
        F.coalesce(F.try_variant_get(v, "$.first", "bigint"), F.lit(0)).alias("first"),
        F.try_variant_get(v, "$.urls", "array<string>").alias("urls"),
        F.try_variant_get(v, "$.pages", "array<struct<url:string>>").alias("pages"),
        F.try_variant_get(v, "$.not_crawled", "array<string>").alias("left"))
    strings = F.col("urls_type").isin("ARRAY<STRING>", "ARRAY<VOID>")
    rows = F.col("pages").isNotNull() & (F.col("page_type").isNull() | F.col("page_type").startswith("OBJECT"))
    sound = (F.col("shape").startswith("OBJECT") & (F.col("root_type").isNull() | (F.col("root_type") == "STRING"))
             & F.when(F.col("urls_type").isNotNull(), strings).otherwise(rows))
    checked = typed.filter(F.when(F.coalesce(sound, F.lit(False)), True).otherwise(F.raise_error(
        F.concat(F.lit("not a map or crawl manifest: "), F.col("file"))).cast("boolean")))
    listed = F.concat(F.coalesce(F.col("urls"), F.array().cast("array<string>")),
                      F.coalesce(F.transform("pages", lambda p: p["url"]), F.array().cast("array<string>")),
                      F.coalesce(F.col("left"), F.array().cast("array<string>")))
    return (checked.select("root", "first", F.posexplode(listed).alias("pos", "url"))
            .select("root", (F.col("first") + F.col("pos")).alias("ord"), "url"))


def write_manifest(listing: DataFrame, path: str, part_urls: int = PART_URLS) -> None:
    """Map manifests as JSON lines: ``{"root", "part", "first", "urls": [...]}``, ``first`` the place of the part's first URL.

    ``listing`` holds ``(root, ord, url)``. A document carries a bounded stretch of one site, so a site of any size is
    written by many tasks and read back whole by ``read_manifest``.
    """
    placed = numbered(listing, ["root"], [F.col("ord"), F.col("url")], "_n", chunk_of(F.col("ord")))
    parts = (placed.withColumn("part", F.floor(F.col("_n") / part_urls)).groupBy("root", "part")
             .agg(F.array_sort(F.collect_list(F.struct("_n", "url"))).alias("rows")))
    doc = F.struct("root", "part", (F.col("part") * part_urls).alias("first"), F.transform("rows", lambda r: r["url"]).alias("urls"))
    parts.select(F.to_json(doc).alias("value")).write.mode("errorifexists").text(path)


def write_crawl_manifest(items: DataFrame, left: DataFrame, path: str, part_urls: int = PART_URLS) -> None:
    """Crawl manifests as JSON lines: the pages asked for, then the URLs the crawl left, both in order.

    ``items`` holds ``(root, n, url, final_url, file, title, status, via, words, http_status, error)`` and ``left`` holds
    ``(root, ord, url)``.
    """
    fields = ["n", "url", "final_url", "file", "title", "status", "via", "words", "http_status", "error"]
    pages = (items.withColumn("part", F.floor(F.col("n") / part_urls)).groupBy("root", "part")
             .agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("pages"), F.count("*").alias("count"))
             .select("root", F.to_json(F.struct("root", "part", (F.col("part") * part_urls).alias("first"), "pages", F.array().cast("array<string>").alias("not_crawled"),
                                                "count")).alias("value")))
    first = items.groupBy("root").agg((F.floor(F.max("n") / part_urls) + 1).alias("_from"))
    placed = numbered(left, ["root"], [F.col("ord"), F.col("url")], "_n", chunk_of(F.col("ord")))
    rest = (salted_join(placed, first, ["root"], F.col("url"), how="left")
            .withColumn("part", F.coalesce("_from", F.lit(0)) + F.floor(F.col("_n") / part_urls)).groupBy("root", "part")
            .agg(F.array_sort(F.collect_list(F.struct("_n", "url"))).alias("rows"))
            .select("root", F.to_json(F.struct("root", "part", (F.col("part") * part_urls).alias("first"), F.array().cast("array<struct<url:string>>").alias("pages"),
                                               F.transform("rows", lambda r: r["url"]).alias("not_crawled"),
                                               F.lit(0).alias("count"))).alias("value")))
    pages.unionByName(rest).select("value").write.mode("errorifexists").text(path)
