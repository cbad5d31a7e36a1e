"""Helpers the operators of this package share."""
from __future__ import annotations

import sys

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagewright.session import ship_package, stored

#: Bytes A-Z to a-z, every other byte as it is; parts of longer UTF-8 sequences lie outside A-Z.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))

__all__ = ["LOWER", "components", "fold", "lower_az", "numbered", "ship_package", "table", "text_of", "unused"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(name: str = "text") -> Column:
    """A text column with null as the empty text."""
    return F.coalesce(F.col(name), F.lit(""))


def lower_az(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def unused(df: DataFrame, name: str) -> str:
    """``name``, with underscores added until ``df`` has no such column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


#: Files of a table whose numbers are sent to every worker; the rows of one with more are written anew.
MOST_FILES = 100_000


def rows_of_files(df: DataFrame) -> bool:
    """Whether each row of ``df`` is one row of a file: a scan, its rows perhaps chosen and its columns changed, and nothing else."""
    try:
        node = df._jdf.queryExecution().analyzed()
        while node.nodeName() in ("Project", "Filter", "SubqueryAlias"):
            node = node.children().head()
        return node.nodeName() == "LogicalRelation" and len(df.select("_metadata.row_index", "_metadata.file_path").columns) == 2
    except Exception:  # no such plan, or no such columns: the rows are not a file's own
        return False


def numbered(df: DataFrame, row: str = "_row") -> DataFrame:
    """``df`` with a number for each row that stays with it in every job.

    ``monotonically_increasing_id()`` counts within the splits of a job, which differ between jobs when executors come or go. A row read from a file has a
    number of its own there, however the file is split; the files are numbered by their paths, in a table of at most ``MOST_FILES`` rows that is
    broadcast. Rows that are not a file's own, or of more files, are written once with their numbers and read from there.
    """
    path, index, first = (unused(df, c) for c in ("_file", "_index", "_first"))
    if rows_of_files(df):
        placed = df.select("*", F.col("_metadata.file_path").alias(path), F.col("_metadata.row_index").alias(index))
        files = stored(placed.select(path).distinct(), "files")
        if files.count() <= MOST_FILES:
            no = F.row_number().over(Window.orderBy(path)).cast("long")
            named = stored(files.coalesce(1).select(path, F.shiftleft(no, 40).alias(first)), "files")
            return placed.join(F.broadcast(named), path).withColumn(row, F.col(first) + F.col(index)).drop(path, index, first)
    return stored(df.withColumn(row, F.monotonically_increasing_id()), "rows", compression="zstd")


def fold(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo ``n``; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(n)).cast("int")


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of undirected edges: ``(node, root)``, root the smallest node reachable.

    Rounds of large and small stars. A node's smallest neighbour is a partial aggregate, joined back to its edges; each round is
    written, so lineage stays short. Nodes without an edge do not come. Edges with a null end are left out.
    """
    now = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    now, seen = stored(now, "edges"), None
    while True:
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen or state[0] == 0:
            break
        seen = state
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").unionByName(down.select("u", F.col("m").alias("v")))
        now = stored(small.distinct(), "edges")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


if sys.byteorder != "little":  # the bit layouts of fingerprints and hash files are little-endian
    raise RuntimeError("little-endian machines only")
