"""Transcripts, run logs and saved files."""
from __future__ import annotations

import os
from urllib.parse import unquote

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.operators.ordered import running_sums
from pagewright.session import ship_package, stored

#: The session a transcript's path names: ``<date>_<id>/messages.jsonl``, or a copied ``<id>.jsonl``.
SESSION = r"(?:_([A-Za-z0-9]+)/messages|/([A-Za-z0-9]+))\.jsonl$"
#: The session and the relative path a saved file's path names.
ARTIFACT = r"_([A-Za-z0-9]+)/artifacts/(.+)$"

# How a terminal log marks dimmed tool output, and its escape sequences.
LAST_DIMMED = r"(?s)^.*\x1B\[2m.*?\x1B\[0m"
ESCAPES = r"\x1B\[[0-9;]*[A-Za-z]"
LOGGED_URL = r"https?://[^\s<>\"'`)\]\\]+"


def scan_transcripts(spark: SparkSession, path: str, glob: str = "*.jsonl", session: str = SESSION) -> DataFrame:
    """``(session_id, index, byte_start, raw)``: the whole records of every transcript under ``path``.

    A record ends at a line feed alone. Blank lines are no records, and neither is a last line that is not ended yet: its
    bytes would reach past the end of the file by the line feed it lacks. A transcript of any size is read in blocks.
    """
    return whole_records(transcript_lines(spark, path, glob), session_named(session))


def transcript_lines(spark: SparkSession, path: str, glob: str = "*.jsonl") -> DataFrame:
    """Lines of transcripts with their file, its size, the block and the place they were read at: ``(raw, _f, _s, _b, _at)``.

    Written once, in the order they were read: blocks are those of one scan, and what joins on them must not scan again in other blocks.
    """
    lines = (spark.read.option("lineSep", "\n").option("recursiveFileLookup", True).option("pathGlobFilter", glob)
             .text(path)
             .select(F.col("value").alias("raw"), F.col("_metadata.file_path").alias("_f"),
                     F.col("_metadata.file_size").alias("_s"), F.col("_metadata.file_block_start").alias("_b"),
                     F.monotonically_increasing_id().alias("_at")))
    return stored(lines, "lines")


def session_named(session: str = SESSION) -> Column:
    """The session that the file ``_f`` of a line is named for: the first group of the pattern that holds one."""
    groups = session.count("(") - session.count("(?:")
    return F.coalesce(*(F.nullif(F.regexp_extract("_f", session, g + 1), F.lit("")) for g in range(groups)))


def placed_lines(lines: DataFrame) -> DataFrame:
    """Lines with the byte behind their line end (``_end``) and the number of records up to them (``_n``) in their file."""
    record = lines["raw"].rlike(r"\S")
    return running_sums(lines, ["_f"], ["_b", "_at"], {"_end": (F.octet_length("raw") + 1).cast("long"), "_n": record.cast("long")}, F.col("_b"))


def whole_records(lines: DataFrame, session: Column) -> DataFrame:
    """The records among lines read with their file, its size, the block and the place they were read at (``raw, _f, _s, _b, _at``)."""
    whole = placed_lines(lines).filter(F.col("raw").rlike(r"\S") & (F.col("_end") <= F.col("_s")))
    return whole.select(session.alias("session_id"), (F.col("_n") - 1).alias("index"),
                        (F.col("_end") - F.octet_length("raw") - 1).alias("byte_start"), "raw")


def scan_stdout_answer(spark: SparkSession, path: str) -> DataFrame:
    """``(run_id, answer, urls)`` of run folders' ``stdout.log``: the message after the last dimmed tool output.

    Without any tool output, everything printed is the message and it names no pages. A log is one run's and is read
    whole, because the last dimmed block decides.
    """
    logs = (spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "stdout.log").text(path, wholetext=True)
            .select(F.col("value"), F.regexp_extract("_metadata.file_path", r"/([^/]+)/stdout\.log$", 1).alias("run_id")))
    return stdout_answer(logs)


def stdout_answer(logs: DataFrame) -> DataFrame:
    """The same for logs ``(run_id, value)`` at hand."""
    used_tools = F.col("value").contains("\x1b[2m")
    plain = F.regexp_replace("value", ESCAPES, "")
    answer = F.regexp_replace(F.regexp_replace(F.regexp_replace("value", LAST_DIMMED, ""), ESCAPES, ""), r"^\s+|\s+$", "")
    found = F.transform(F.regexp_extract_all(plain, F.lit(LOGGED_URL), 0), lambda u: F.regexp_replace(u, r"[.,;:]+$", ""))
    urls = F.when(used_tools, F.array_distinct(found)).otherwise(F.array().cast("array<string>"))
    return logs.select("run_id", answer.alias("answer"), urls.alias("urls"))


LISTED = "path string, rel string, mtime timestamp, length long"
_FOLDERS = "folder string, rel string"


def local_path(path: str) -> str:
    """A mounted folder's path without a scheme."""
    return unquote(path.removeprefix("file:")) if path.startswith("file:") else path


def _folders(batches):
    """What stands in folders ``(folder, rel)``: the folders in them; links are not followed."""
    for batch in batches:
        rows = [(entry.path, f"{rel}/{entry.name}") for folder, rel in zip(batch["folder"], batch["rel"], strict=True)
                for entry in os.scandir(folder) if entry.is_dir(follow_symlinks=False)]
        yield pd.DataFrame(rows, columns=["folder", "rel"], dtype="object")


#: Files that a listing hands on at once, however many folders they stand in.
LISTED_AT_ONCE = 5000


def _rows(found: list[tuple]) -> pd.DataFrame:
    paths, rels, times, sizes = zip(*found, strict=True) if found else ((), (), (), ())
    return pd.DataFrame({"path": pd.Series(paths, dtype="object"), "rel": pd.Series(rels, dtype="object"),
                         "mtime": pd.Series(times, dtype="int64").astype("datetime64[us]"), "length": pd.Series(sizes, dtype="int64")})


def _files(deep: bool):
    """The files in folders ``(folder, rel)``, links left out, and with ``deep`` those of the folders below too."""
    def files(batches):
        found = []
        for batch in batches:
            for folder, rel in zip(batch["folder"], batch["rel"], strict=True):
                at = [(folder, rel)]
                while at:
                    here, name = at.pop()
                    for entry in os.scandir(here):
                        if entry.is_dir(follow_symlinks=False):
                            if deep:
                                at.append((entry.path, f"{name}/{entry.name}"))
                        elif entry.is_file(follow_symlinks=False):
                            stat = entry.stat(follow_symlinks=False)
                            found.append((entry.path, f"{name}/{entry.name}", stat.st_mtime_ns // 1000, stat.st_size))
                            if len(found) == LISTED_AT_ONCE:
                                yield _rows(found)
                                found = []
        yield _rows(found)
    return files


def listed_files(spark: SparkSession, path: str, spread: int = 2) -> DataFrame:
    """``(path, rel, mtime, length)`` of every file under a mounted folder, whatever its name, empty ones too; ``rel`` is its path below ``path``, after a slash.

    The folders of the first ``spread`` levels are listed level by level and dealt out, each then walked by one task, a row a file.
    """
    ship_package(spark)
    # dealt by a number: the names of many folders are few bytes, which the engine would gather in one task
    tasks = 4 * spark.sparkContext.defaultParallelism
    level = spark.createDataFrame([(local_path(path).rstrip("/"), "")], _FOLDERS)
    found = level.mapInPandas(_files(spread == 0), LISTED)
    for d in range(1, spread + 1):
        level = level.mapInPandas(_folders, _FOLDERS).repartition(tasks, "folder")
        found = found.unionByName(level.mapInPandas(_files(d == spread), LISTED))
    return found


def scan_artifacts(spark: SparkSession, path: str, place: str = ARTIFACT) -> DataFrame:
    """``(session_id, rel_path, path, mtime, length)`` of every file under a session's ``artifacts`` folder.

    Only metadata is read. A mounted folder is listed by tasks of its own: empty files and names that start with ``_`` or ``.`` are files like others, links and what
    stands behind them are left out. Elsewhere the engine's file source lists, which has neither such files nor links.
    """
    if path.startswith(("/", "file:")):
        files = listed_files(spark, path).select(F.concat(F.lit("file:"), "path").alias("path"), F.col("path").alias("_p"), "mtime", "length")
    else:
        files = (spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
                 .select("path", F.col("path").alias("_p"), F.col("modificationTime").alias("mtime"), "length"))
    return files.select(F.regexp_extract("_p", place, 1).alias("session_id"), F.regexp_extract("_p", place, 2).alias("rel_path"),
                        "path", "mtime", "length").filter(F.col("rel_path") != "")
