"""Best-fit packing under conflicts.

Documents become pieces of at most ``capacity`` words; a full piece is a bin of its own. The others are dealt by a hash into groups of
about ``GROUP_ROWS``, packed one group a task, largest first. Bins of a group lie in the order of their residual capacity and carry a bitmap
of their sources and one of their duplicate clusters. A piece goes to the tightest compatible bin: the search starts at the smallest
residual that holds it and goes on to the next one until a bin has none of the piece's cluster and room for its source
(``most_sources`` different ones a bin); otherwise it opens a bin.
"""
from __future__ import annotations

from bisect import bisect_left, insort

import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright.llm.common import LOWER, ship_package, text_of
from pagewright.session import stored

CAPACITY = 4096
MOST_SOURCES = 4
GROUP_ROWS = 8192
_WORD = regex.compile(r"[^\x20\x09-\x0D]+")
PIECE = "_row long, doc_id long, source string, cluster long, piece long, start long, stop long, n_words long"


def cuts(text: str, capacity: int) -> list[tuple[int, int, int]]:
    """``(start, stop, words)`` of a text's pieces, in code points; put end to end they are the text. An empty text is one piece of no words."""
    words = len(text.encode("utf-8", "surrogatepass").split())
    if words <= capacity:
        return [(0, len(text), words)]
    starts = [m.start() for i, m in enumerate(_WORD.finditer(text)) if i % capacity == 0]
    starts[0] = 0
    return [(a, b, min(capacity, words - i * capacity)) for i, (a, b) in enumerate(zip(starts, [*starts[1:], len(text)], strict=True))]


def _pieces(capacity: int):
    def pieces(batches):
        names = [part.split()[0] for part in PIECE.split(", ")]
        for batch in batches:
            out = [(row, doc_id, source, xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass").translate(LOWER)) - (1 << 63), no, *cut)
                   for row, doc_id, source, text in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True)
                   for no, cut in enumerate(cuts(text, capacity))]
            columns = list(zip(*out, strict=True)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string() if n == "source" else pa.int64()) for n, c in zip(names, columns, strict=True)], names)
    return pieces


class Bins:
    """The open bins of one group, by residual capacity."""

    def __init__(self, capacity: int, most_sources: int):
        self.capacity, self.most_sources = capacity, most_sources
        self.residuals: list[int] = []  # those that occur, ascending
        self.at: dict[int, list[int]] = {}  # bins by residual, oldest first
        self.sources: list[int] = []  # a bit for each source of the group
        self.cluster_bits: list[int] = []  # a bit for each of 64 classes of clusters, and the clusters
        self.clusters: list[set[int]] = []

    def _compatible(self, b: int, source: int, cluster: int) -> bool:
        if self.cluster_bits[b] >> (cluster & 63) & 1 and cluster in self.clusters[b]:
            return False
        return bool(self.sources[b] >> source & 1) or self.sources[b].bit_count() < self.most_sources

    def put(self, size: int, source: int, cluster: int) -> tuple[int, int]:
        """``(bin, words before)`` of a piece, which the bin then holds."""
        found = None
        for i in range(bisect_left(self.residuals, size), len(self.residuals)):
            residual = self.residuals[i]
            found = next((b for b in self.at[residual] if self._compatible(b, source, cluster)), None)
            if found is not None:
                self.at[residual].remove(found)
                if not self.at[residual]:
                    del self.at[residual], self.residuals[i]
                break
        if found is None:
            found, residual = len(self.sources), self.capacity
            self.sources.append(0)
            self.cluster_bits.append(0)
            self.clusters.append(set())
        self.sources[found] |= 1 << source
        self.cluster_bits[found] |= 1 << (cluster & 63)
        self.clusters[found].add(cluster)
        left = residual - size
        if left not in self.at:
            self.at[left] = []
            insort(self.residuals, left)
        self.at[left].append(found)
        return found, self.capacity - residual


def _packed(capacity: int, most_sources: int):
    def packed(table: pa.Table) -> pa.Table:
        bins, known, out = Bins(capacity, most_sources), {}, []
        rows = zip(*(table.column(c).to_pylist() for c in ("n_words", "_row", "piece", "source", "cluster")), strict=True)
        for size, row, piece, source, cluster in sorted(rows, key=lambda r: (-r[0], r[1], r[2])):
            out.append((row, piece, *bins.put(size, known.setdefault(source, len(known)), cluster)))
        row, piece, found, before = zip(*out, strict=True)
        return pa.table({"_row": pa.array(row, pa.int64()), "piece": pa.array(piece, pa.int64()), "bin": pa.array(found, pa.int64()), "before": pa.array(before, pa.int64()),
                         "group": pa.array(table.column("group").to_pylist(), pa.int64())})
    return packed


def pack(docs: DataFrame, capacity: int = CAPACITY, most_sources: int = MOST_SOURCES, group_rows: int = GROUP_ROWS) -> DataFrame:
    """One row for each piece: ``(_row, doc_id, source, piece, start, stop, n_words, bin_id, before)``.

    ``start`` and ``stop`` are code points of the text (null: empty), ``before`` the words of the bin that come before the piece. Equal texts (but for the
    case of A-Z) are one cluster, so rows repeated never share a bin. A null source is a source. An empty table packs into nothing.
    """
    ship_package(docs.sparkSession)
    rows = docs.select(F.monotonically_increasing_id().alias("_row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), text_of().alias("text"))
    pieces = stored(rows.mapInArrow(_pieces(capacity), PIECE), "pieces")
    open_ = pieces.filter(F.col("n_words") < capacity)
    groups = max(1, -(-open_.count() // group_rows))
    dealt = open_.select("_row", "piece", "n_words", "cluster", "source", F.pmod(F.xxhash64("_row", "piece"), F.lit(groups)).alias("group"))
    placed = dealt.groupBy("group").applyInArrow(_packed(capacity, most_sources), "_row long, piece long, bin long, before long, group long")
    full = pieces.filter(F.col("n_words") >= capacity).select("_row", "piece", F.concat_ws("-", F.lit("f"), "_row", "piece").alias("bin_id"), F.lit(0).cast("long").alias("before"))
    bins = placed.select("_row", "piece", F.concat_ws("-", F.lit("g"), "group", "bin").alias("bin_id"), "before").unionByName(full)
    # merged: Spark sizes pieces by their compressed file, a small part of their rows, and would send them to the driver
    return pieces.drop("cluster").hint("merge").join(bins, ["_row", "piece"])


def sequences(docs: DataFrame, packed: DataFrame) -> DataFrame:
    """``(bin_id, n_words, doc_ids, texts)``: a bin's pieces in order. A bin holds at most its capacity in words, so its group is bounded."""
    texts = docs.select(F.monotonically_increasing_id().alias("_row"), text_of().alias("_text"))
    cut = packed.join(texts, "_row").withColumn("_text", F.expr("substring(_text, cast(start + 1 as int), cast(stop - start as int))"))
    held = cut.groupBy("bin_id").agg(F.sum("n_words").alias("n_words"), F.array_sort(F.collect_list(F.struct("before", "doc_id", "piece", "_row", "_text"))).alias("_all"))
    return held.select("bin_id", "n_words", F.transform("_all", lambda x: x["doc_id"]).alias("doc_ids"), F.transform("_all", lambda x: x["_text"]).alias("texts"))
