"""Toxicity by compression distance.

Two zstandard dictionaries are made of labelled texts. Both start from one trained on windows of ordinary text, so their entropy tables and
common content are the same; the toxic one goes on with the words that mark toxic texts, by their likelihood ratio, the ordinary one with as many zeros. A text is cut into
windows of ``WINDOW_BYTES``; a window's margin is its length under the ordinary dictionary less that under the toxic one. Labelled texts that
made no dictionary calibrate the margin above which a window counts and how a text's margins become a probability.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright.llm.common import LOWER, fold, ship_package, text_of, unused
from pagewright.session import stored

WINDOW_BYTES = 128
#: Labelled rows learned from, the smallest by a hash of their id: at most so many of either class.
TOXIC_ROWS, ORDINARY_ROWS = 8_000, 16_000
#: Windows of ordinary text the common dictionary is trained on (about so many, by a hash), its bytes, and the bytes of fragments of each class.
TRAIN_WINDOWS, DICTIONARY_BYTES, FRAGMENT_BYTES = 40_000, 1 << 15, 1 << 10
#: A fragment's least root of the likelihood ratio, and the least number of its class's texts that have it.
LEAST_ROOT, LEAST_TEXTS = 4.5, 3
#: Shares of ordinary windows that may reach the margins from which a window counts.
ORDINARY_ABOVE = (0.1, 0.02, 0.004)
#: From this score on a text counts as toxic.
REJECT = 0.3
_PARAMETERS = dict(window_log=17, hash_log=15, chain_log=16, search_log=6, min_match=3, target_length=64, strategy=zstandard.STRATEGY_BTLAZY2,
                   write_checksum=0, write_content_size=0, write_dict_id=0)


def windows(data: bytes) -> list[bytes]:
    return [data[at:at + WINDOW_BYTES] for at in range(0, len(data), WINDOW_BYTES)]


class Compressors:
    """A compressor for each class's dictionary; made where it is used, since dictionaries do not travel."""

    def __init__(self, dictionaries: tuple[bytes, bytes]):
        parameters = zstandard.ZstdCompressionParameters(**_PARAMETERS)
        self.compress = []
        for content in dictionaries:
            made = zstandard.ZstdCompressionDict(content)
            made.precompute_compress(compression_params=parameters)
            self.compress.append(zstandard.ZstdCompressor(dict_data=made, compression_params=parameters).compress)

    def margins(self, text: str) -> np.ndarray:
        ordinary, toxic = self.compress
        return np.array([len(ordinary(w)) - len(toxic(w)) for w in windows(text.encode("utf-8", "surrogatepass").translate(LOWER))], np.float64)


def features(margins: np.ndarray, above: list[float]) -> list[float]:
    """Mean, largest and mean of the three largest margins, share of windows that reach each threshold, number of windows; all 0 for an empty text."""
    if not len(margins):
        return [0.0] * (4 + len(ORDINARY_ABOVE))
    return [margins.mean(), margins.max(), np.sort(margins)[-3:].mean(), *((margins >= a).mean() for a in above), np.log1p(len(margins))]


def logistic(x: np.ndarray, y: np.ndarray, penalty: float = 1.0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Means, deviations and weights of a logistic fit by Newton's steps, the prior's log odds where a class is missing."""
    mean, dev = (x.mean(axis=0), x.std(axis=0) + 1e-2) if len(x) else (np.zeros(x.shape[1]), np.ones(x.shape[1]))
    z = np.column_stack([np.ones(len(x)), (x - mean) / dev])
    w = np.zeros(z.shape[1])
    w[0] = np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5))
    if 0 < y.sum() < len(y):
        ridge = np.diag([1e-6] + [penalty] * x.shape[1])
        for _ in range(30):
            p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
            w = w - np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + ridge, z.T @ (p - y) + ridge @ w)
    return mean, dev, w


class Model:
    def __init__(self, dictionaries: tuple[bytes, bytes], above: list[float], mean: np.ndarray, dev: np.ndarray, weights: np.ndarray):
        self.dictionaries, self.above, self.mean, self.dev, self.weights = dictionaries, above, mean, dev, weights

    def score(self, compressors: Compressors, text: str) -> float:
        z = (np.array(features(compressors.margins(text), self.above)) - self.mean) / self.dev
        return float(1 / (1 + np.exp(-np.clip(self.weights[0] + z @ self.weights[1:], -30, 30))))

    def column(self, text: str = "text"):
        """The score of a text column (null: empty), between 0 and 1."""
        model = self

        @F.pandas_udf("double")
        def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            compressors = Compressors(model.dictionaries)
            for texts in batches:
                yield pd.Series([model.score(compressors, t) for t in texts], dtype="float64")
        return scored(text_of(text))


def _fragments(sample: DataFrame) -> tuple[bytes, bytes]:
    """What either dictionary ends in: zero bytes, and the words that mark toxic texts, the strongest last, at most ``FRAGMENT_BYTES``.

    Words are counted over texts, in Spark. Equal lengths keep what the dictionaries share equally far back in both.
    """
    n = {r.toxic: r.n for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    n1, n0 = n.get(1, 0), n.get(0, 0)
    if not n1 or not n0:
        return b" ", b" "
    words = sample.select("toxic", F.explode(F.array_distinct(F.split(F.lower("text"), r"[\x20\x09-\x0D]+"))).alias("w")).filter(F.length("w").between(3, 64))
    counted = words.groupBy("w").agg(F.sum("toxic").alias("k1"), F.sum(1 - F.col("toxic")).alias("k0"))
    part = lambda k, n: F.when(F.col(k) > 0, F.col(k) * F.log(F.col(k) * (n1 + n0) / (n * (F.col("k1") + F.col("k0"))))).otherwise(0.0)
    root = F.sqrt(F.greatest(2 * (part("k1", n1) + part("k0", n0)), F.lit(0.0)))
    marking = counted.filter((F.col("k1") >= LEAST_TEXTS) & (F.col("k1") / n1 > F.col("k0") / n0)).withColumn("root", root).filter(F.col("root") >= LEAST_ROOT)
    toxic = _joined([r.w for r in marking.orderBy(F.desc("root"), "w").limit(FRAGMENT_BYTES // 4).collect()], FRAGMENT_BYTES)
    return b"\0" * len(toxic), toxic


def _joined(words: list[str], most: int) -> bytes:
    """The words, first ones last, as many as ``most`` bytes hold."""
    out, used = [], 1
    for w in (w.encode() for w in words):
        used += len(w) + 1
        if used > most:
            break
        out.append(w)
    return b" " + b" ".join(reversed(out)) + b" " if out else b" "


def _cut(batches):
    for batch in batches:
        out = [w for t in batch.column(0).to_pylist() for w in windows(t.encode("utf-8", "surrogatepass").translate(LOWER))]
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["w"])


def _common(ordinary: DataFrame) -> bytes:
    cut = ordinary.select("text").mapInArrow(_cut, "w binary").withColumn("h", F.xxhash64("w"))
    n = cut.count()
    some = cut.filter(F.pmod("h", F.lit(n)) < TRAIN_WINDOWS) if n > TRAIN_WINDOWS else cut
    sample = [bytes(r.w) for r in some.select("w").collect()]
    sample.sort(key=lambda w: (xxhash.xxh64_intdigest(w), w))
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, sample).as_bytes()
    except (zstandard.ZstdError, ValueError):  # too few windows to train on: their bytes themselves
        return b"".join(sample)[-DICTIONARY_BYTES:]


def _measured(dictionaries: tuple[bytes, bytes]):
    def measured(batches):
        compressors = Compressors(dictionaries)
        for batch in batches:
            for toxic, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                m = compressors.margins(text)
                yield pa.RecordBatch.from_arrays([pa.array([toxic], pa.int32()), pa.array([m.tolist()], pa.list_(pa.float64()))], ["toxic", "margins"])
    return measured


def _features(above: list[float]):
    def rows(batches):
        for batch in batches:
            out = [features(np.array(m, np.float64), above) for m in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(pa.float64()))], ["toxic", "x"])
    return rows


def train(docs: DataFrame, labels: DataFrame, toxic_rows: int = TOXIC_ROWS, ordinary_rows: int = ORDINARY_ROWS) -> Model:
    """A model of the labelled rows whose fold of four is not 2: folds 0 and 1 make the dictionaries, fold 3 calibrates.

    The sample's rows, windows and fragments are bounded by the parameters; everything counted over it is counted in Spark. Labels that are null or
    neither 0 nor 1 are left out; a document labelled twice counts by its larger label. Without labels every score is one half. Texts are windowed whole, however
    long; rows repeated count as often as they come; of ids with one hash the smaller is sampled first. Other columns are not looked at.
    """
    ship_package(docs.sparkSession)
    known = labels.filter("toxic in (0, 1) and doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    known = known.withColumn("_fold", fold(F.col("doc_id"), 4)).filter("_fold <> 2")
    chosen = [known.filter(F.col("toxic") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n) for k, n in ((1, toxic_rows), (0, ordinary_rows))]
    ids = stored(chosen[0].unionByName(chosen[1]), "labelled")  # at most toxic_rows + ordinary_rows rows of three numbers
    sample = stored(docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).join(F.broadcast(ids), "doc_id").select("toxic", "_fold", "text"), "sample")
    making, checking = sample.filter("_fold in (0, 1)"), sample.filter("_fold = 3")
    common = _common(making.filter("toxic = 0"))
    own = _fragments(making)
    dictionaries = (common + own[0], common + own[1])
    margins = stored(checking.select("toxic", "text").mapInArrow(_measured(dictionaries), "toxic int, margins array<double>"), "margins")
    seen = margins.filter("toxic = 0").select(F.explode("margins").alias("m")).groupBy(F.greatest(F.lit(-64.0), F.least(F.lit(64.0), "m")).alias("m")).count().collect()
    above = [_above({r.m: r["count"] for r in seen}, share) for share in ORDINARY_ABOVE]
    rows = margins.mapInArrow(_features(above), "toxic int, x array<double>").collect()
    x = np.array([r.x for r in rows], np.float64).reshape(len(rows), 4 + len(ORDINARY_ABOVE))
    return Model(dictionaries, above, *logistic(x, np.array([r.toxic for r in rows], np.float64)))


def _above(seen: dict[float, int], share: float) -> float:
    """The least margin above 0 that at most ``share`` of the ordinary windows reach."""
    reached, above = 0, max([1.0, *(m + 1 for m in seen)])
    for m in sorted(seen, reverse=True):
        reached += seen[m]
        if m <= 0 or reached > share * sum(seen.values()):
            break
        above = m
    return above


def scores(docs: DataFrame, model: Model) -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` of every row of ``docs``; a null text counts as empty.

    Texts are scored whole, however long; rows repeated have one score and come as often; a null id is in the fold of the empty text; an empty table gives no rows.
    Other columns of ``docs`` are not looked at.
    """
    scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), model.column().alias("score"))
    return scored.select("doc_id", (fold(F.col("doc_id"), 4) == 2).alias("held_out"), "score", (F.col("score") >= REJECT).cast("int").alias("predicted"))


def accepted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that do not count as toxic, all their columns, whatever their names. A null text counts as empty; rows repeated stay or go together;
    a score at the limit goes; an empty table stays empty."""
    model = train(docs, labels)
    score = unused(docs, "_score")
    return docs.withColumn(score, model.column()).filter(F.col(score) < REJECT).drop(score)
