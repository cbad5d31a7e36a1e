"""Exact dedup by composable polynomial fingerprints.

A text is cut into chunks of bytes. A chunk's hash is its polynomial modulo two primes; two neighbours' hashes make that of both
by shifting the first by the second's length, so chunks may be hashed anywhere and put together in any grouping. Rows whose
fingerprint and length agree are then compared chunk by chunk with the first row of their group; a row that differs (a collision)
goes through another round with the others that differ, so classes are exact.
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright.llm.common import LOWER, numbered, ship_package, text_of, unused
from pagewright.session import stored

PRIMES = (2147483647, 2147483629)
BASES = (1000003, 998244353)
CHUNK_BYTES = 1 << 16
#: Members of one group that are compared beside one copy of the group's first row.
GROUP_ROWS = 500

Hash = tuple[int, int, int]  # bytes, and the polynomial modulo each prime
EMPTY: Hash = (0, 0, 0)


def _powers(base: int, prime: int, n: int) -> np.ndarray:
    out = np.ones(1, np.uint64)
    while len(out) < n:
        out = np.concatenate([out, out * np.uint64(pow(base, len(out), prime)) % np.uint64(prime)])
    return out[:n][::-1].copy()


_DOWN = [_powers(b, p, CHUNK_BYTES) for b, p in zip(BASES, PRIMES, strict=True)]


def chunk_hash(chunk: bytes) -> Hash:
    """The hash of at most ``CHUNK_BYTES`` bytes. A byte counts one more than its value, so leading zeros count."""
    values = np.frombuffer(chunk, np.uint8).astype(np.uint64) + np.uint64(1)
    n = len(values)
    first, second = (int(np.dot(values, down[CHUNK_BYTES - n:])) % p for down, p in zip(_DOWN, PRIMES, strict=True))
    return n, first, second


def combined(left: Hash, right: Hash) -> Hash:
    """The hash of two neighbours put together: the left one's is shifted by the right one's length."""
    return (left[0] + right[0], *((left[i + 1] * pow(BASES[i], right[0], PRIMES[i]) + right[i + 1]) % PRIMES[i] for i in (0, 1)))


def fingerprint(data: bytes, hash_chunk=chunk_hash) -> Hash:
    if len(data) <= CHUNK_BYTES:
        return hash_chunk(data)
    whole = EMPTY
    for at in range(0, len(data), CHUNK_BYTES):
        whole = combined(whole, hash_chunk(data[at:at + CHUNK_BYTES]))
    return whole


def _normal(column: pa.Array) -> Iterator[bytes]:
    for value in column.cast(pa.large_binary()):
        yield value.as_py().translate(LOWER)


def _marks(hash_chunk):
    def marks(batches):
        for batch in batches:
            found = [(len(b), *fingerprint(b, hash_chunk)[1:], hashlib.sha256(b).hexdigest()) for b in _normal(batch.column(2))]
            n, first, second, sha = zip(*found, strict=True) if found else ((), (), (), ())
            print_ = [a << 31 | b for a, b in zip(first, second, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(print_, pa.int64()), pa.array(sha, pa.string())],
                                             ["_row", "doc_id", "n_bytes", "_fp", "text_sha256"])
    return marks


def _chunks(batches):
    """Rows of ``(_row, _first, _salt, _salts, text)`` as their chunks, a bounded number of bytes at a time."""
    for batch in batches:
        keys = list(zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True))
        out, held = [], 0
        for key, b in zip(keys, _normal(batch.column(4)), strict=True):
            for no, at in enumerate(range(0, max(len(b), 1), CHUNK_BYTES)):
                out.append((*key, no, b[at:at + CHUNK_BYTES]))
                held += len(out[-1][5])
            if held > 1 << 24:
                yield _chunk_batch(out)
                out, held = [], 0
        yield _chunk_batch(out)


def _chunk_batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [()] * 6
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(),) * 4 + (pa.int64(), pa.binary()), strict=True)],
                                      ["_row", "_first", "_salt", "_salts", "_no", "_data"])


def exact_classes(docs: DataFrame, hash_chunk=chunk_hash) -> DataFrame:
    """``(_row, doc_id, n_bytes, text_sha256, keep_id, group_size, kept)``, one row for each row of ``docs``.

    Texts are equal when identical after lower-casing A-Z; a null text counts as empty, and empty texts are equal to each other. The row
    with the largest ``doc_id`` stays (a null id is the smallest); of rows repeated under that id, one stays. ``_row`` is a number that stays with each row. Long texts
    are compared chunk by chunk; an empty table gives no rows; other columns of ``docs`` are not looked at.
    """
    return _classes(numbered(docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))), hash_chunk)


def _classes(rows: DataFrame, hash_chunk=chunk_hash) -> DataFrame:
    """``exact_classes`` of stored rows ``(_row, doc_id, text)``."""
    ship_package(rows.sparkSession)
    tagged = rows.select("_row", "doc_id", "text")
    marks = stored(tagged.mapInArrow(_marks(hash_chunk), "_row long, doc_id long, n_bytes long, _fp long, text_sha256 string"), "marks")
    settled, pending, turn = None, marks, 0
    while True:
        groups = stored(pending.groupBy("_fp", "n_bytes").agg(F.count("*").alias("_n"), F.min("_row").alias("_first")).filter("_n > 1"), "groups")
        members = pending.join(groups, ["_fp", "n_bytes"]).select("_row", "_first", F.ceil(F.col("_n") / GROUP_ROWS).cast("long").alias("_salts"))
        keyed = members.withColumn("_salt", F.pmod(F.xxhash64("_row"), F.col("_salts")))
        chunks = stored(tagged.join(keyed, "_row").select("_row", "_first", "_salt", "_salts", "text")
                        .mapInArrow(_chunks, "_row long, _first long, _salt long, _salts long, _no long, _data binary"), "chunks")
        firsts = (chunks.filter("_row = _first").withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_salts") - 1)))
                  .select("_first", "_salt", "_no", F.col("_data").alias("_same")))
        # merged: texts, sized by their compressed files and as if there were one copy of each, are not sent to the driver
        compared = (chunks.filter("_row <> _first").join(firsts.hint("merge"), ["_first", "_salt", "_no"], "left")
                    .groupBy("_row").agg(F.min(F.coalesce(F.col("_data") == F.col("_same"), F.lit(False))).alias("_ok")))
        differ = stored(compared.filter("not _ok").select("_row"), "differ")
        over = differ.isEmpty()
        here = (pending if over else pending.join(differ, "_row", "left_anti")).withColumn("_turn", F.lit(turn))
        settled = here if settled is None else settled.unionByName(here)
        if over:
            break
        pending, turn = stored(pending.join(differ, "_row"), "pending"), turn + 1
    classes = ["_fp", "n_bytes", "_turn"]
    best = stored(settled.groupBy(*classes).agg(F.count("*").alias("group_size"), F.max(F.struct("doc_id", "_row")).alias("_best")).filter("group_size > 1"), "best")
    joined = settled.join(best, classes, "left")
    alone = F.col("_best").isNull()
    return joined.select("_row", "doc_id", "n_bytes", "text_sha256", F.when(alone, F.col("doc_id")).otherwise(F.col("_best.doc_id")).alias("keep_id"),
                         F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"), (alone | (F.col("_best._row") == F.col("_row"))).alias("kept"))


def exact_dedup(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, all their columns. ``docs`` is read once."""
    row = unused(docs, "_row")
    rows = numbered(docs, row)
    classes = _classes(rows.select(F.col(row).alias("_row"), F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")))
    return rows.join(classes.filter("not kept").select(F.col("_row").alias(row)), row, "left_anti").drop(row)
