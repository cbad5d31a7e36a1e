"""SimHash near-dedup by segment popcounts.

A fingerprint's 64 bits are cut into segments; the bits set in each make a point of small integers. Points lie no farther apart
(Manhattan) than their fingerprints (Hamming), so fingerprints within ``MOST_BITS`` = 2 have points within 2, and two such points have a
grid point within 1 of both. Every distinct fingerprint therefore goes to the grid cells within 1 of its point, cells are joined by
equality, and the pairs that meet are verified bit by bit. Cells of more than ``CELL_ROWS`` fingerprints are not paired: there each
fingerprint goes on to the 65 words within one bit of it, exact by the same argument, and links to the smallest that meets it.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright.llm.common import LOWER, components, numbered, ship_package, text_of, unused
from pagewright.session import stored

SHINGLE_WORDS = 3
SEED = 42
MOST_BITS = 2
#: 16 segments of four bits: 33 cells a fingerprint; a count is 0 to 4, packed in three bits.
SEGMENTS = 16
CELL_ROWS = 256
#: Shingle hashes whose bits are counted at once.
HASHES_AT_ONCE = 1 << 16


def fingerprint(text: bytes) -> int:
    """The fingerprint of a text, as a signed word; 0 without words."""
    words = text.translate(LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    width = min(SHINGLE_WORDS, len(words))
    starts = np.concatenate([[0], ends[:-1] + 1])[: len(words) - width + 1].tolist()
    ends = ends[width - 1:].tolist()
    hashed, counts = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for at in range(0, len(starts), HASHES_AT_ONCE):
        part = slice(at, at + HASHES_AT_ONCE)
        some = np.array([hashed(joined[s:e], SEED) for s, e in zip(starts[part], ends[part], strict=True)], np.uint64)
        counts += np.unpackbits(some.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(starts), bitorder="little").view(np.int64)[0])


def _fingerprints(batches):
    for batch in batches:
        found = [fingerprint(v.as_py()) for v in batch.column(2).cast(pa.large_binary())]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.int64())], ["_row", "doc_id", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """``(_row, doc_id, fp)`` of every row; a null text is empty, an empty one has fingerprint 0."""
    return _printed(docs.select(F.monotonically_increasing_id().alias("_row"), F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")))


def _printed(rows: DataFrame) -> DataFrame:
    ship_package(rows.sparkSession)
    return rows.mapInArrow(_fingerprints, "_row long, doc_id long, fp long")


def cells(nodes: DataFrame) -> DataFrame:
    """``(cell, fp)``: the grid cells within one step of each distinct fingerprint's point."""
    width = 64 // SEGMENTS
    counts = [F.bit_count(F.shiftrightunsigned("fp", width * i).bitwiseAND(F.lit((1 << width) - 1))).cast("long") for i in range(SEGMENTS)]
    point = sum((F.shiftleft(c, 3 * i) for i, c in enumerate(counts[1:], 1)), counts[0])
    placed = nodes.select("fp", point.alias("_at"))
    digit = lambda i: F.shiftright("_at", 3 * i).bitwiseAND(F.lit(7))
    steps = [F.col("_at")]
    for i in range(SEGMENTS):
        steps += [F.when(digit(i) < width, F.col("_at") + (1 << 3 * i)), F.when(digit(i) > 0, F.col("_at") - (1 << 3 * i))]
    return placed.select("fp", F.explode(F.array(*steps)).alias("cell")).filter("cell is not null")


def links(nodes: DataFrame, cell_rows: int = CELL_ROWS) -> DataFrame:
    """``(a, b)``: links among distinct fingerprints that connect whatever differs in at most ``MOST_BITS`` bits; every link is within it.

    Cells and words are many a fingerprint, but Spark takes an exploded table for as large as it was before: both sides of these joins are merged, else the driver
    would be sent one of them whole.
    """
    spread = cells(nodes)
    full = stored(spread.groupBy("cell").count().filter(F.col("count") > cell_rows).select("cell"), "cells")
    few = spread.join(full, "cell", "left_anti")
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= MOST_BITS
    pairs = few.withColumnRenamed("fp", "a").hint("merge").join(few.withColumnRenamed("fp", "b"), "cell").filter(F.col("a") < F.col("b")).filter(near).select("a", "b")
    flips = F.array(F.col("fp"), *(F.col("fp").bitwiseXOR(F.lit(1 << i if i < 63 else -(1 << 63)).cast("long")) for i in range(64)))
    stars = spread.join(full, "cell", "left_semi").select("fp").distinct().select("fp", F.explode(flips).alias("word"))
    least = stars.groupBy("word").agg(F.min("fp").alias("a"), F.count("*").alias("n")).filter("n > 1").select("word", "a")
    starred = stars.hint("merge").join(least, "word").select("a", F.col("fp").alias("b")).filter(F.col("a") < F.col("b")).filter(near)
    return pairs.unionByName(starred).distinct()


def near_classes(docs: DataFrame) -> DataFrame:
    """``(_row, doc_id, fp, component_id)`` of every row: the smallest ``doc_id`` reachable over links of at most two bits.

    Rows of one fingerprint are one node. Null ids are never a component's id unless all of its ids are null. ``docs`` may hold any other
    columns. ``_row`` is a number for each row, given as ``docs`` is read, which is once. Long texts are read whole, an empty table gives no rows.
    """
    return _classes(fingerprints(docs))


def _classes(prints: DataFrame) -> DataFrame:
    marks = stored(prints, "simhash")
    nodes = stored(marks.groupBy("fp").agg(F.min("doc_id").alias("first")), "nodes")
    found = components(links(nodes)).withColumnRenamed("node", "fp")
    linked = nodes.join(found, "fp")
    least = linked.groupBy("root").agg(F.min("first").alias("least"))
    placed = stored(nodes.join(linked.join(least, "root").select("fp", "least"), "fp", "left")
                    .select("fp", F.coalesce("least", "first").alias("component_id")), "placed")
    return marks.join(placed, "fp").select("_row", "doc_id", "fp", "component_id")


def near_dedup(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, all their columns: of each component the row with the smallest id, one where it is repeated.

    ``docs`` is read once.
    """
    row = unused(docs, "_row")
    rows = numbered(docs, row)
    classes = stored(_classes(_printed(rows.select(F.col(row).alias("_row"), F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")))), "classes")
    apart = F.when(F.col("component_id").isNull(), F.col("fp")).alias("apart")  # rows that all lack an id are told apart by fingerprint
    kept = classes.groupBy("component_id", apart).agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "_row")).alias("s")).select(F.col("s._row").alias(row))
    return rows.join(kept, row, "left_semi").drop(row)
