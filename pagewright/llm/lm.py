"""A bigram model with interpolated modified Kneser-Ney smoothing, counted in Spark, kept as sorted hash arrays that workers map.

Three passes over the training texts' tokens. Words go by their 64-bit hash; the first pass counts them into parts by the hash's leading bits, so
a word's number is its place in these sorted arrays. The second counts pairs of numbers into parts, and what the smoothing needs of each word:
how many pairs it begins that occur once, twice, more often, and how many different words it follows. The third, over any texts, looks pairs up.
"""
from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright.llm.arrays import blocks_by_bucket, by_bucket, mapped, place, save, summed, work_folder
from pagewright.llm.common import LOWER, fold, ship_package, text_of
from pagewright.session import stored

#: A part holds what about so many bytes of text give.
PART_BYTES = 32 << 20
#: Texts whose tokens are held at once, in bytes.
AT_ONCE = 4 << 20
#: No word holds white space, so these name the end and the start of a text.
END, START = (np.uint64(xxhash.xxh64_intdigest(x)) for x in (b" ", b"\n"))
_MIX = np.uint64(0x9E3779B97F4A7C15)


def tokens(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all texts' words, each text closed by ``END``, and the number of tokens of each text."""
    hashed, end = xxhash.xxh64_intdigest, int(END)
    out, sizes = [], []
    for text in texts:
        words = text.translate(LOWER).split()
        out.extend(map(hashed, words))
        out.append(end)
        sizes.append(len(words) + 1)
    return np.array(out, np.uint64), np.array(sizes, np.int64)


def _in_turns(column: pa.Array) -> Iterator[list[bytes]]:
    held, size = [], 0
    for value in column.cast(pa.large_binary()):
        held.append(value.as_py())
        size += len(held[-1])
        if size > AT_ONCE:
            yield held
            held, size = [], 0
    yield held


@dataclass
class Vocabulary:
    folder: str
    bits: int  # a word's part is the leading bits of its hash
    starts: list[int]  # the number of each part's first word

    def part_of(self, hashes: np.ndarray) -> np.ndarray:
        return (hashes >> np.uint64(64 - self.bits)).astype(np.int64) if self.bits else np.zeros(len(hashes), np.int64)

    def numbers(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The numbers of sorted distinct hashes, and whether they are known."""
        number, known, part = np.zeros(len(hashes), np.int64), np.zeros(len(hashes), bool), self.part_of(hashes)
        for p in np.unique(part):
            here = part == p
            at, known[here] = place(mapped(self.folder, f"word-{p}"), hashes[here])
            number[here] = at + self.starts[p]
        return number, known

    def of(self, name: str, numbers: np.ndarray) -> np.ndarray:
        """An attribute of the words of these numbers."""
        part = np.searchsorted(np.array(self.starts), numbers, side="right") - 1
        out = np.zeros(len(numbers), np.int64)
        for p in np.unique(part):
            here = part == p
            out[here] = mapped(self.folder, f"{name}-{p}")[numbers[here] - self.starts[p]]
        return out


@dataclass
class Model:
    words: Vocabulary
    parts: int
    n: int  # training tokens
    v: int  # different ones
    texts: int
    pairs: int  # different pairs
    high: tuple[float, float, float]  # discounts of pairs seen once, twice, more often
    low: tuple[float, float, float]  # of words that follow one, two, more different words
    low_rest: float  # mass the lower order leaves

    def score(self, texts: list[bytes]) -> tuple[np.ndarray, ...]:
        """Tokens, known tokens, base score and score of each text, the scores in log10."""
        sizes, count, base, own = self.token_scores(texts)
        first = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64)
        sums = lambda x: np.add.reduceat(x, first) if len(sizes) else np.zeros(0)
        return sizes, sums((count > 0).astype(np.int64)), sums(base), sums(own)

    def token_scores(self, texts: list[bytes]) -> tuple[np.ndarray, ...]:
        """Each text's number of tokens; each token's count in training, and its log10 probability by the base and by the model."""
        hashes, sizes = tokens(texts)
        unique, which = np.unique(np.concatenate([hashes, [START]]), return_inverse=True)
        number, known = self.words.numbers(unique)
        start = which[-1]
        count = np.where(known, self.words.of("count", np.where(known, number, 0)), 0) if self.v else np.zeros(len(unique), np.int64)
        count[start] = 0
        follows = self._attribute("follows", number, known)
        once, twice, more = (self._attribute(k, number, known) for k in ("once", "twice", "more"))
        after = np.where(np.arange(len(unique)) == start, self.texts, count).astype(np.float64)
        own = which[:-1]
        prior = before_index(own, sizes, start)
        base = np.log10((count[own] + 0.1) / (self.n + 0.1 * (self.v + 1)))
        below = (follows - discounted(follows, self.low)) / max(self.pairs, 1) + self.low_rest / (self.v + 1)
        both = known[own] & (known[prior] | (prior == start))
        key = np.where(both, (number[prior].astype(np.uint64) << np.uint64(32)) | number[own].astype(np.uint64), np.uint64(0))
        pair = np.where(both, self._pairs(key, both), 0)
        held = after[prior]
        rest = np.where(after > 0, (self.high[0] * once + self.high[1] * twice + self.high[2] * more) / np.maximum(after, 1), 1.0)
        p = np.where(held > 0, (pair - discounted(pair, self.high)) / np.maximum(held, 1), 0.0) + rest[prior] * below[own]
        return sizes, count[own], base, np.log10(p)

    def _attribute(self, name: str, number: np.ndarray, known: np.ndarray) -> np.ndarray:
        return np.where(known, self.words.of(name, np.where(known, number, 0)), 0) if self.v else np.zeros(len(number), np.int64)

    def _pairs(self, key: np.ndarray, wanted: np.ndarray) -> np.ndarray:
        unique, which = np.unique(key, return_inverse=True)
        out, part = np.zeros(len(unique), np.int64), pair_part(unique, self.parts)
        for p in np.unique(part) if wanted.any() else []:
            here = part == p
            at, found = place(mapped(self.words.folder, f"pair-{p}"), unique[here])
            counts = mapped(self.words.folder, f"times-{p}")
            got = np.zeros(len(at), np.int64)
            got[found] = counts[at[found]]
            out[here] = got
        return out[which]


def before_index(own: np.ndarray, sizes: np.ndarray, start: int) -> np.ndarray:
    out = np.concatenate([[start], own[:-1]]) if len(own) else own
    out[np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64)[: len(sizes)]] = start
    return out


def pair_part(keys: np.ndarray, parts: int) -> np.ndarray:
    return ((keys * _MIX) >> np.uint64(33)).astype(np.int64) % parts


def discounted(counts: np.ndarray, by: tuple[float, float, float]) -> np.ndarray:
    return np.array([0.0, *by])[np.minimum(counts, 3)]


def discounts(n1: int, n2: int, n3: int, n4: int) -> tuple[float, float, float]:
    """The modified discounts from the numbers of things seen once to four times; a half where they are too few to say."""
    if not n1 or not n2:
        return (0.5, 0.5, 0.5)
    y = n1 / (n1 + 2 * n2)
    return tuple(min(max(k - (k + 1) * y * after / here, 0.0), float(k)) if here else k * 0.5 for k, here, after in ((1, n1, n2), (2, n2, n3), (3, n3, n4)))


def _word_blocks(bits: int):
    def blocks(batches):
        for batch in batches:
            parts = [summed(h, np.ones(len(h), np.uint32)) for texts in _in_turns(batch.column(0)) for h in [np.append(tokens(texts)[0], np.repeat(START, len(texts)))]]
            keys, counts = summed(*(np.concatenate(c) for c in zip(*parts, strict=True)))
            yield blocks_by_bucket((keys >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(keys), np.int64), keys, counts.astype(np.uint32))
    return blocks


def _save_words(folder: str):
    def saved(batches):
        for bucket, columns in by_bucket(batches, np.uint64, np.uint32):
            keys, counts = summed(*columns)
            save(folder, f"word-{bucket}", keys)
            save(folder, f"count-{bucket}", counts.astype(np.int64))
            real = keys != START
            yield pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in (bucket, len(keys), int(real.sum()), int(counts[real].sum(dtype=np.int64)), int(counts[~real].sum(dtype=np.int64)))],
                                             ["bucket", "words", "v", "n", "texts"])
    return saved


def _pair_blocks(words: Vocabulary, parts: int):
    def blocks(batches):
        for batch in batches:
            some = []
            for texts in _in_turns(batch.column(0)):
                hashes, sizes = tokens(texts)
                unique, which = np.unique(np.concatenate([hashes, [START]]), return_inverse=True)
                number, _ = words.numbers(unique)
                number = number.astype(np.uint64)
                key = (number[before_index(which[:-1], sizes, which[-1])] << np.uint64(32)) | number[which[:-1]]
                some.append(summed(key, np.ones(len(key), np.uint32)))
            keys, counts = summed(*(np.concatenate(c) for c in zip(*some, strict=True)))
            yield blocks_by_bucket(pair_part(keys, parts), keys, counts.astype(np.uint32))
    return blocks


def _save_pairs(words: Vocabulary, parts: int):
    """Files of a part's pairs; its seen-once-to-four-times counts, and what its pairs say of words, as blocks for the words' parts."""
    def saved(batches):
        for bucket, columns in by_bucket(batches, np.uint64, np.uint32):
            keys, counts = summed(*columns)
            save(words.folder, f"pair-{bucket}", keys)
            save(words.folder, f"times-{bucket}", counts.astype(np.uint32))
            yield _seen(len(keys), counts)
            left, right = (keys >> np.uint64(32)).astype(np.int64), (keys & np.uint64(0xFFFFFFFF)).astype(np.int64)
            zero = np.zeros(len(keys), np.int64)
            said = summed(np.concatenate([left, right]), *(np.concatenate(c) for c in (
                (counts == 1, zero), (counts == 2, zero), (counts > 2, zero), (zero, zero + 1))))
            part = np.searchsorted(np.array(words.starts), said[0], side="right") - 1
            blocks = blocks_by_bucket(part, said[0], *(c.astype(np.uint32) for c in said[1:]))
            n = blocks.num_rows
            yield pa.RecordBatch.from_arrays([*blocks.columns, *(pa.array([0] * n, pa.int64()) for _ in range(5))], [*blocks.schema.names, "pairs", "n1", "n2", "n3", "n4"])
    return saved


def _seen(n: int, counts: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([None], pa.int64()), pa.array([None], pa.large_binary()), *(pa.array([x], pa.int64()) for x in (n, *(int((counts == k).sum()) for k in (1, 2, 3, 4))))],
                                      ["bucket", "block", "pairs", "n1", "n2", "n3", "n4"])


def _save_said(words: Vocabulary):
    def saved(batches):
        for bucket, columns in by_bucket(batches, np.int64, *[np.uint32] * 4):
            numbers, *said = summed(*columns)
            at = numbers - words.starts[bucket]
            for name, values in zip(("once", "twice", "more", "follows"), said, strict=True):
                whole = np.zeros(len(mapped(words.folder, f"word-{bucket}")), np.uint32)
                whole[at] = values
                save(words.folder, f"{name}-{bucket}", whole)
            follows = said[3]
            yield pa.RecordBatch.from_arrays([pa.array([int(x)], pa.int64()) for x in (
                *((follows == k).sum() for k in (1, 2, 3, 4)), (follows >= 3).sum())], ["n1", "n2", "n3", "n4", "more"])
    return saved


def train(texts: DataFrame, n_bytes: int) -> Model:
    """A model of the column ``text`` (no nulls) of ``texts``, about ``n_bytes`` of it. Its size follows the number of different words and pairs."""
    spark = texts.sparkSession
    ship_package(spark)
    folder = work_folder(spark, "ngrams")
    bits = max(0, (n_bytes // (4 * PART_BYTES)).bit_length())
    met = texts.mapInArrow(_word_blocks(bits), "bucket long, block binary").repartition(1 << bits, "bucket")
    rows = {r.bucket: r for r in met.mapInArrow(_save_words(folder), "bucket long, words long, v long, n long, texts long").collect()}  # a row a part
    sizes = [rows[b].words if b in rows else 0 for b in range(1 << bits)]
    words = Vocabulary(folder, bits, [0, *accumulate(sizes)][:-1])
    for b in range(1 << bits):
        if b not in rows:
            for name in ("word", "count", "once", "twice", "more", "follows"):
                save(folder, f"{name}-{b}", np.zeros(0, np.uint64 if name == "word" else np.int64))
    n, v, count = (sum(r[k] for r in rows.values()) for k in ("n", "v", "texts"))
    if sum(sizes) >= 1 << 32:
        raise ValueError("a pair holds two word numbers of 32 bits; this corpus has more words")
    parts = max(1, n_bytes // PART_BYTES + 1)
    pairs = texts.mapInArrow(_pair_blocks(words, parts), "bucket long, block binary").repartition(parts, "bucket")
    said = stored(pairs.mapInArrow(_save_pairs(words, parts), "bucket long, block binary, pairs long, n1 long, n2 long, n3 long, n4 long"), "said")
    seen = said.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("pairs", "n1", "n2", "n3", "n4"))).first()
    low = (said.filter("bucket is not null").select("bucket", "block").repartition(1 << bits, "bucket").mapInArrow(_save_said(words), "n1 long, n2 long, n3 long, n4 long, more long")
           .agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n1", "n2", "n3", "n4", "more"))).first())
    high_d, low_d = discounts(*(seen[f"n{k}"] for k in (1, 2, 3, 4))), discounts(*(low[f"n{k}"] for k in (1, 2, 3, 4)))
    rest = (low_d[0] * low.n1 + low_d[1] * low.n2 + low_d[2] * low.more) / seen.pairs if seen.pairs else 1.0
    return Model(words, parts, n, v, count, seen.pairs, high_d, low_d, rest)


def _scores(model: Model):
    def scores(batches):
        names = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
        for batch in batches:
            at = 0
            for texts in _in_turns(batch.column(2)):
                if texts:
                    sizes, known, base, score = model.score(texts)
                    here = batch.slice(at, len(texts))
                    at += len(texts)
                    yield pa.RecordBatch.from_arrays([here.column(0), here.column(1), pa.array(sizes), pa.array(known), pa.array(np.full(len(sizes), model.n, np.int64)),
                                                      pa.array(base, pa.float64()), pa.array(score, pa.float64())], names)
    return scores


def perplexities(docs: DataFrame, held_out_of: int = 10) -> DataFrame:
    """Every row's log10 probability under a model of the rows whose fold of ``held_out_of`` is not 0, beside a base's.

    ``(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score)``; perplexity is ``10 ** (-score / n_tokens)``. A null text is empty and
    has one token, its end. A null id's fold is that of the empty text. Without training rows every word has the same probability. Long texts are scored whole; rows
    repeated count as often in training and are each scored; an empty table gives no rows; other columns of ``docs`` are not looked at.
    """
    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (fold(F.col("doc_id"), held_out_of) == 0).alias("held_out"), text_of().alias("text"))
    learned = given.filter("not held_out").select("text")
    size = learned.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    model = train(learned, size)
    return given.mapInArrow(_scores(model), "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
