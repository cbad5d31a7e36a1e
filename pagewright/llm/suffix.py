"""Suffix-array dedup: bytes covered by a string of ``LENGTH`` that starts earlier are removed.

Every window of ``LENGTH`` bytes has a minimizer, the smallest hash among its strings of ``GRAM`` bytes; windows of equal content have the same one.
A text is cut into pieces, runs of windows that share one place of the minimizer, so equal windows of any two texts lie in pieces of one key. Equal
pieces become one, at their first place (in each task that cuts texts, and again where a key's pieces meet); all windows of the others are repetitions.
A key left with one piece has nothing to share and stays behind. The pieces of a bucket of keys are then a collection of short documents whose
Burrows-Wheeler transform is built column by column: each round inserts one symbol of every document, right to left, and the common prefixes of the new
neighbours follow from those of the suffixes one symbol shorter. Suffixes with ``LENGTH`` symbols in common are one window; all but its earliest place
are removed. A bucket is bounded, so the two columns are arrays of one task.
"""
from __future__ import annotations

import hashlib
import uuid

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright.llm.arrays import blocks_by_bucket, by_bucket
from pagewright.llm.common import numbered, ship_package, text_of
from pagewright.session import shared_folder, stored

LENGTH = 100
GRAM = 32
#: Windows of a text that are hashed at once; a place among them takes 19 bits.
WINDOWS_AT_ONCE = 1 << 18
_PLACE = np.uint64((1 << 19) - 1)
#: Bytes of text whose runs meet in one bucket, and bytes of pieces in one collection.
RUN_BYTES, COLLECTION_BYTES = 32 << 20, 192 << 10
#: A key with more different pieces is cut again, each window for itself, by its own hash.
HOT_PIECES = 4_000
_BASE, _OTHER_BASE = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
#: In order a null id comes before all others.
NO_ID = -(1 << 63)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, np.uint64(base))
    out[0] = 1
    return np.multiply.accumulate(out)


_UP, _OTHER_UP = (_powers(int(b), WINDOWS_AT_ONCE + 2 * LENGTH) for b in (_BASE, _OTHER_BASE))
_DOWN, _OTHER_DOWN = (_powers(pow(int(b), -1, 1 << 64), WINDOWS_AT_ONCE + 2 * LENGTH) for b in (_BASE, _OTHER_BASE))


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


Runs = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def runs(data: bytes) -> Runs:
    """Keys, marks (a hash of the piece's bytes), first windows and numbers of windows of a text's runs, which cover each of its windows once."""
    found = [_runs(data[at:at + WINDOWS_AT_ONCE + LENGTH - 1], at) for at in range(0, len(data) - LENGTH + 1, WINDOWS_AT_ONCE)]
    if not found:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.uint32), np.zeros(0, np.uint8)
    return tuple(np.concatenate(c) for c in zip(*found, strict=True))


def _sums(values: np.ndarray, powers: np.ndarray) -> np.ndarray:
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * powers[:len(values)], out=sums[1:])
    return sums


def _runs(data: bytes, offset: int) -> Runs:
    n, span = len(data), LENGTH - GRAM + 1
    values = np.frombuffer(data, np.uint8).astype(np.uint64) + np.uint64(1)
    sums = _sums(values, _UP)
    hashed = _mixed((sums[GRAM:] - sums[:-GRAM]) * _DOWN[:n - GRAM + 1])
    placed = (hashed & ~_PLACE) | np.arange(len(hashed), dtype=np.uint64)
    windows = n - LENGTH + 1
    rows = np.concatenate([placed, np.full(-len(placed) % span, ~np.uint64(0))]).reshape(-1, span)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    at = np.minimum(behind[:windows], ahead[span - 1:span - 1 + windows]) & _PLACE
    first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    size = np.diff(np.append(first, windows))
    other = _sums(values, _OTHER_UP)
    stop = first + size + LENGTH - 1
    # two hashes of the whole piece, and its length
    marks = _mixed((other[stop] - other[first]) * _OTHER_DOWN[first] + _mixed((sums[stop] - sums[first]) * _DOWN[first] + size.astype(np.uint64)))
    return hashed[at[first].astype(np.int64)], marks, (first + offset).astype(np.uint32), size.astype(np.uint8)


# --- the collection's transform --------------------------------------------------------------------


def transform(pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray, list[tuple[int, np.ndarray, np.ndarray]]]:
    """``(bwt, lcp, places)`` of a collection of pieces under 255 bytes without the byte 255.

    ``lcp[k]`` is the common prefix of suffixes k - 1 and k. ``places`` has, for each suffix length of at least ``LENGTH``, the pieces that have such a suffix
    and where it lies. End marks, written 255, sort before all bytes and by their piece; the marks themselves begin the first ``len(pieces)`` suffixes.
    """
    n = len(pieces)
    sizes = np.fromiter(map(len, pieces), np.int64, n)
    longest = int(sizes.max())
    symbols = np.full((n, longest + 1), 255, np.uint8)  # row i: its bytes right to left, then its mark
    for i, piece in enumerate(pieces):
        symbols[i, :len(piece)] = np.frombuffer(piece, np.uint8)[::-1]
    count = np.arange(int(sizes.sum()) + n + 1)
    bwt, lcp = symbols[:, 0].copy(), np.zeros(n, np.uint8)
    alive, at = np.arange(n), np.arange(n)
    for length in range(1, longest + 1):
        going = sizes[alive] >= length
        alive, at = alive[going], at[going]  # ``at``: where each one's suffix of length - 1 lies
        order = np.argsort(bwt, kind="stable")  # bytes ascending, so place n + i of the next column starts with bwt[order[i]]
        rank = np.empty(len(bwt), np.int64)
        rank[order] = count[:len(bwt)]
        mine = rank[at]
        sorting = np.argsort(mine)
        alive, at, mine = alive[sorting], at[sorting], mine[sorting]
        symbol = bwt[at]
        before, after = order[np.maximum(mine - 1, 0)], order[np.minimum(mine + 1, len(order) - 1)]
        has_before, has_after = (mine > 0) & (bwt[before] == symbol), (mine + 1 < len(order)) & (bwt[after] == symbol)
        guarded = np.append(lcp, np.uint8(0))
        new_before = _prefixes(guarded, before, at, has_before)
        new_after = _prefixes(guarded, at, after, has_after)
        size = len(bwt) + len(alive)
        new = n + mine
        # both columns move in one pass: the symbol in the low byte, the prefix in the high one
        old = np.ones(size, bool)
        old[new] = False
        both = np.empty((size, 2), np.uint8)
        both[:, 0][new], both[:, 1][new] = symbols[alive, length], new_before
        both.view(np.uint16).ravel()[old] = np.column_stack([bwt, lcp]).view(np.uint16).ravel()
        inside = new + 1 < size
        both[:, 1][new[inside] + 1] = new_after[inside]
        bwt, lcp, at = both[:, 0].copy(), both[:, 1].copy(), new
    order = np.argsort(bwt, kind="stable")
    rank = np.empty(len(bwt), np.int64)
    rank[order] = np.arange(len(bwt))
    places, alive, at = [], np.arange(n), np.arange(n)
    for length in range(1, longest + 1):
        going = sizes[alive] >= length
        alive = alive[going]
        at = n + rank[at[going]]
        if length >= LENGTH:
            places.append((length, alive, at))
    return bwt, lcp, places


def _prefixes(lcp: np.ndarray, left: np.ndarray, right: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """One more than the least common prefix after ``left`` up to ``right`` where wanted, else 0."""
    out = np.zeros(len(left), np.uint8)
    if wanted.any():
        bounds = np.empty(2 * int(wanted.sum()), np.int64)
        bounds[0::2], bounds[1::2] = left[wanted] + 1, right[wanted] + 1
        out[wanted] = np.minimum.reduceat(lcp, bounds)[0::2] + 1
    return out


def repeats(pieces: list[bytes], order: np.ndarray) -> list[tuple[int, int]]:
    """``(piece, window)`` of every window that an earlier one equals: earlier by the piece's place in ``order``, then within it."""
    _, lcp, places = transform(pieces)
    never = np.iinfo(np.int64).max
    value = np.full(len(lcp), never)
    sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
    for length, piece, at in places:
        value[at] = order[piece] * 256 + sizes[piece] - length
    first = np.flatnonzero(np.concatenate([[True], lcp[1:] < LENGTH]))
    least = np.repeat(np.minimum.reduceat(value, first), np.diff(np.append(first, len(value))))
    found = np.sort(value[(value != never) & (value > least)])
    back = np.empty(len(pieces), np.int64)
    back[order] = np.arange(len(pieces))
    return list(zip(back[found >> 8].tolist(), (found & 255).tolist(), strict=True))


# --- Spark ----------------------------------------------------------------------------------------


def _facts(batches):
    for batch in batches:
        texts = [v.as_py() for v in batch.column(2).cast(pa.large_binary())]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(map(len, texts), pa.int64()), pa.array([hashlib.sha256(t).hexdigest() for t in texts])],
                                         ["_row", "doc_id", "n_bytes", "_sha"])


def _packed_texts(batches):
    for batch in batches:
        texts = [zstandard.compress(v.as_py(), 1) for v in batch.column(2).cast(pa.large_binary())]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.large_binary())], ["_row", "doc_id", "_text"])


def _run_blocks(buckets: int):
    """Blocks of runs for the buckets of their keys, and, under bucket -1, of those whose piece came earlier in the same batch."""
    def blocks(batches):
        for batch in batches:
            ids = batch.column(1).to_pylist()
            rows = batch.column(0).to_pylist()
            texts = batch.column(2).cast(pa.large_binary())
            some, held = [], 0
            for i in sorted(range(len(rows)), key=lambda i: (NO_ID if ids[i] is None else ids[i], rows[i])):
                data = texts[i].as_py()
                keys, marks, starts, sizes = runs(data)
                some.append((keys, marks, np.full(len(keys), NO_ID if ids[i] is None else ids[i], np.int64), np.full(len(keys), rows[i], np.int64), starts, sizes))
                held += len(data)
                if held > RUN_BYTES // 2:
                    yield from _run_block(some, buckets)
                    some, held = [], 0
            if some:
                yield from _run_block(some, buckets)
    return blocks


def _run_block(some: list[tuple[np.ndarray, ...]], buckets: int):
    columns = [np.concatenate(c) for c in zip(*some, strict=True)]
    order = np.lexsort((columns[1], columns[0]))  # stable, so equal pieces stay in the order of their places
    columns = [c[order] for c in columns]
    keys, marks = columns[:2]
    again = np.concatenate([[False], (keys[1:] == keys[:-1]) & (marks[1:] == marks[:-1])])[:len(keys)]
    first = [c[~again] for c in columns]
    yield blocks_by_bucket(((first[0] * _BASE) >> np.uint64(33)).astype(np.int64) % buckets, *first)
    later = [c[again] for c in columns[3:]]
    order = np.argsort(later[0], kind="stable")
    yield blocks_by_bucket(np.full(len(order), -1, np.int64), *(c[order] for c in later))


WANTED, LATER, HOT = 0, 1, 2
_FOUND = "what long, key long, _row long, start long, windows long"


def _found_batch(what, keys, row, start, size) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c).astype(np.int64)) for c in (what, keys.view(np.int64), row, start, size)], ["what", "key", "_row", "start", "windows"])


def _repeated(hot_pieces: int):
    """Of a bucket's runs, those whose key comes more than once: later places of a piece, and the pieces whose key has several."""
    def repeated(batches):
        for _, (keys, marks, ids, rows, starts, sizes) in by_bucket(batches, np.uint64, np.uint64, np.int64, np.int64, np.uint32, np.uint8):
            order = np.argsort(keys)
            same = keys[order][1:] == keys[order][:-1]
            order = order[np.concatenate([[False], same]) | np.concatenate([same, [False]])] if len(keys) else order
            order = order[np.lexsort((starts[order], rows[order], ids[order], marks[order], keys[order]))]
            keys, marks, rows, starts, sizes = keys[order], marks[order], rows[order], starts[order], sizes[order]
            new_key = np.concatenate([[True], keys[1:] != keys[:-1]])[:len(keys)]
            first = new_key | np.concatenate([[True], marks[1:] != marks[:-1]])[:len(keys)]
            group = np.cumsum(new_key) - 1
            pieces = np.bincount(group[first], minlength=int(new_key.sum()))[group] if len(keys) else group
            what = np.where(~first, LATER, np.where(pieces > hot_pieces, HOT, WANTED))
            kept = ~first | (pieces > 1)
            yield _found_batch(what[kept], keys[kept], rows[kept], starts[kept], sizes[kept])
    return repeated


def _places(batches):
    for _, (rows, starts, sizes) in by_bucket(batches, np.int64, np.uint32, np.uint8):
        yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in (rows, starts, sizes)], ["_row", "start", "windows"])


_PIECE = "what long, key long, _row long, doc_id long, start long, windows long, piece binary"


def _piece_batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * 7
    kinds = (pa.int64(),) * 6 + (pa.binary(),)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], [p.split()[0] for p in _PIECE.split(", ")])


def _cut(batches):
    """The pieces of a row's wanted runs; a hot key's are cut to single windows under their own hash."""
    for batch in batches:
        out = []
        for row, doc_id, text, found in zip(*(batch.column(c).to_pylist() for c in ("_row", "doc_id", "_text", "_runs")), strict=True):
            data = zstandard.decompress(text)
            for r in found:
                at, n = r["start"], r["windows"]
                if r["what"] == HOT:
                    some = [data[at + i:at + i + LENGTH] for i in range(n)]
                    out.extend((HOT, xxhash.xxh3_64_intdigest(w, 7) - (1 << 63), row, doc_id, at + i, 1, w) for i, w in enumerate(some))
                else:
                    out.append((WANTED, r["key"], row, doc_id, at, n, data[at:at + n + LENGTH - 1]))
                if len(out) >= 50_000:
                    yield _piece_batch(out)
                    out = []
        yield _piece_batch(out)


def _removed(table: pa.Table) -> pa.Table:
    """Runs of removed windows of a bucket's pieces."""
    rows = sorted(zip(*(table.column(c).to_pylist() for c in ("doc_id", "_row", "start", "piece")), strict=True), key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    out: list[list[int]] = []
    for i, window in repeats([r[3] for r in rows], np.arange(len(rows))):
        row, start = rows[i][1], rows[i][2] + window
        if out and out[-1][0] == row and out[-1][1] + out[-1][2] == start:
            out[-1][2] += 1
        else:
            out.append([row, start, 1])
    columns = list(zip(*out, strict=True)) or [()] * 3
    return pa.table({k: pa.array(c, pa.int64()) for k, c in zip(("_row", "start", "windows"), columns, strict=True)})


def _kept(batches):
    for batch in batches:
        out = []
        for row, text, found in zip(*(batch.column(c).to_pylist() for c in ("_row", "_text", "_gone")), strict=True):
            data = zstandard.decompress(text)
            spans: list[list[int]] = []
            for start, windows in sorted((r["start"], r["windows"]) for r in found):
                stop = start + windows + LENGTH - 1
                if spans and start <= spans[-1][1]:
                    spans[-1][1] = max(spans[-1][1], stop)
                else:
                    spans.append([start, stop])
            sha, at = hashlib.sha256(), 0
            for start, stop in spans:
                sha.update(data[at:start])
                at = stop
            sha.update(data[at:])
            out.append((row, sum(b - a for a, b in spans), len(spans), sha.hexdigest(), [{"start": a, "stop": b} for a, b in spans]))
        columns = list(zip(*out, strict=True)) or [()] * 5
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())])))
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["_row", "_removed", "_spans", "_kept", "spans"])


def _firsts(windows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Different windows at their first place, and the places of their repetitions. A place is a row and a window."""
    place = F.struct(F.col("doc_id").isNotNull(), F.col("doc_id"), F.col("_row"), F.col("start"))
    first = stored(windows.groupBy("key", "piece").agg(F.min(place).alias("p")).select("p._row", "p.start"), "windows-first")
    return windows.join(first, ["_row", "start"]), windows.select("_row", "start", "windows").join(first, ["_row", "start"], "left_anti")


def _compact(df: DataFrame, name: str) -> DataFrame:
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex[:12]}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def repeated_spans(docs: DataFrame, hot_pieces: int = HOT_PIECES) -> DataFrame:
    """``(doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans)`` of every row; ``spans`` are the removed byte ranges, null where there is none.

    Earlier means a smaller ``doc_id`` (null the smallest), or the same row and an earlier byte; rows of one id go in the order of the plan. A null text is
    empty; texts under ``LENGTH`` bytes lose nothing. An empty table gives no rows; other columns of ``docs`` are not looked at. Rows have numbers that stay with them.
    """
    ship_package(docs.sparkSession)
    given = numbered(docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))).select("_row", "doc_id", "text")
    facts = stored(given.mapInArrow(_facts, "_row long, doc_id long, n_bytes long, _sha string"), "facts")
    size = facts.agg(F.coalesce(F.sum("n_bytes"), F.lit(0))).first()[0]
    buckets = size // RUN_BYTES + 1
    texts = given.mapInArrow(_packed_texts, "_row long, doc_id long, _text binary")
    blocks = _compact(given.mapInArrow(_run_blocks(buckets), "bucket long, block binary"), "runs")
    found = stored(blocks.filter("bucket >= 0").repartition(buckets, "bucket").mapInArrow(_repeated(hot_pieces), _FOUND), "repeated")
    later = blocks.filter("bucket < 0").mapInArrow(_places, "_row long, start long, windows long").unionByName(found.filter(F.col("what") == LATER).select("_row", "start", "windows"))
    wanted = found.filter(F.col("what") != LATER).groupBy("_row").agg(F.collect_list(F.struct("what", "key", "start", "windows")).alias("_runs"))
    pieces = _compact(texts.join(wanted, "_row").mapInArrow(_cut, _PIECE), "pieces")
    firsts = pieces.filter(F.col("what") == WANTED).drop("what")
    windows = pieces.filter(F.col("what") == HOT).drop("what")
    if not windows.isEmpty():
        some, again = _firsts(windows)
        twice = windows.groupBy("key").agg(F.count("*").alias("_n")).filter("_n > 1").select("key")
        firsts, later = firsts.unionByName(some.join(twice, "key", "left_semi")), later.unionByName(again)
    held = firsts.agg(F.coalesce(F.sum(F.octet_length("piece")), F.lit(0))).first()[0]
    dealt = firsts.withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(held // COLLECTION_BYTES + 1)))
    inner = dealt.select("bucket", "doc_id", "_row", "start", "piece").groupBy("bucket").applyInArrow(_removed, "_row long, start long, windows long")
    gone = stored(later.unionByName(inner), "gone").groupBy("_row").agg(F.collect_list(F.struct("start", "windows")).alias("_gone"))
    spans = "array<struct<start: bigint, stop: bigint>>"
    cut = texts.join(gone, "_row").mapInArrow(_kept, f"_row long, _removed long, _spans long, _kept string, spans {spans}")
    return facts.join(cut, "_row", "left").select("doc_id", "n_bytes", F.coalesce("_removed", F.lit(0)).cast("long").alias("n_removed"),
                                                  F.coalesce("_spans", F.lit(0)).cast("long").alias("n_spans"), F.coalesce("_kept", "_sha").alias("kept_sha256"), "spans")
