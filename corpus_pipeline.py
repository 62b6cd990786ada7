"""A corpus made ready for training, stage by stage; each stage reads what the one before has written."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termloom.llm import bpe, langid, linededup, mixing, neardup
from termloom.llm.common import checkpoint_root, fresh, remove
from termloom.llm.queries import vocabulary


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents without letters and those of which no learned language makes up half."""
    return langid.keep_languages(docs, langid.train(docs))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop frequent lines; n_chars follows the text."""
    n_lines, n_dropped = fresh(docs, "n_lines", "n_dropped")
    out = linededup.line_dedup(docs).drop(n_lines, n_dropped)
    return out.withColumn("n_chars", F.char_length("text").cast("long")).select(*docs.columns) if "n_chars" in docs.columns else out


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays."""
    return neardup.near_dedup(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replicate documents to the target weights and shuffle them globally."""
    return mixing.poisson_mix(docs, mixing.WEIGHTS, mixing.OTHER).select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each text."""
    out = bpe.bpe_encode(docs, vocabulary())
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [("language", language), ("lines", lines), ("near", near), ("mix", mix), ("encode", encode)]

#: Mixture inference, components and BPE have no SQL; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = f"{checkpoint_root(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{i}-{name}")
        docs = spark.read.parquet(f"{base}/{i}-{name}")
        if i:
            remove(spark, f"{base}/{i - 1}-{STAGES[i - 1][0]}")
    return docs
