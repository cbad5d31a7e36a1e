"""The corpus pipeline: toxic documents go, exact copies go, one document of each near-duplicate group stays, sources are mixed, documents are packed.

``STAGES`` names the stages; each function takes ``(spark, docs, sf_dir)`` and returns a DataFrame, which is written and read again before the next one.
"""
from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from pagewright.llm import exact, mixing, packing, simhash, toxicity
from pagewright.session import shared_folder


def toxic_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below the rejecting one, learned from ``labels``; without labels all stay.

    A null text counts as empty and is scored like any other, long texts are scored whole, rows repeated stay or go together, an empty table stays empty.
    """
    return toxicity.accepted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact_copies_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the document with the largest id; a null id is the smallest, and of rows repeated under the largest one stays.

    Null and empty texts are equal to each other. Long texts are compared whole. An empty table stays empty.
    """
    return exact.exact_dedup(docs)


def near_copies_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts linked by their fingerprints, the document with the smallest id, one where it is repeated; a null id goes after all others.

    Texts without words, null ones too, have one fingerprint and are linked. Long texts are read whole. An empty table stays empty.
    """
    return simhash.near_dedup(docs)


def sources_mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as the mix takes them; one taken twice comes twice.

    A null source is a source; a text without words, or null, has size 0 and comes with the block it lies in. Rows repeated are rows like others, and of one too long
    for what is left of its source's target, later ones fill it. An empty table gives an empty mix.
    """
    return mixing.mixed(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document lies in the packed sequences.

    A long text is cut into pieces; an empty or null one is a piece of no words. Equal texts, so also rows repeated, never share a sequence; of sequences that
    fit alike the oldest is taken. An empty table packs into nothing.
    """
    return packing.pack(docs).drop("_row")


STAGES = [("toxicity", toxic_out), ("exact_dedup", exact_copies_out), ("simhash_near_dedup", near_copies_out), ("source_mixing", sources_mixed),
          ("best_fit_packing", packed)]

# Columns of ``documents`` beside the ones named here stay with their rows up to the last stage, whatever their names.

#: Compression lengths, hash permutations and greedy packing have no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex[:12]}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
