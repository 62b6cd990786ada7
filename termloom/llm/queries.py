"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termloom.llm import bpe, fingerprint, langid, linededup, media, mixing, neardup, paradedup, quality, secrets
from termloom.llm.common import table


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_bpe_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = bpe.bpe_encode(table(spark, sf_dir, "documents"), vocabulary(), decode=True)
    ids = F.array_join(F.col("ids").cast("array<string>"), ",")
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op2_quality_gam(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = quality.train(docs, labels.filter(~quality.held_out(F.col("doc_id"))))
    return quality.score(docs, model).select("doc_id", quality.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = secrets.secret_scan(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("base_spans", 256).alias("base_sha256"), "spans", "n_key", "n_jwt")


def op4_poisson_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.poisson_mix(table(spark, sf_dir, "documents"), mixing.WEIGHTS, mixing.OTHER).select("doc_id", "source", "text", "copy_no", "n_copies", "shuffle_key")


def op5_language_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.train(docs.filter(~langid.held_out(F.col("doc_id"))))
    return langid.detect(docs, model).select("doc_id", langid.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "langs")


def op8_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.text_media(table(spark, sf_dir, "documents")).drop("tile")


def op9_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.fingerprint_edits(table(spark, sf_dir, "documents"))


def op6_chosen_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = neardup.near_components(table(spark, sf_dir, "documents"), k=3, percent=85)
    return out.select("doc_id", "n_shingles", "component_id", (F.col("doc_id") == F.col("component_id")).alias("kept"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = linededup.line_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op10_paragraph_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return paradedup.repeated_paragraphs(docs).unionByName(paradedup.repeated_passages(docs)).drop("g_hash")


QUERIES = {f.__name__: f for f in (op1_bpe_tree, op2_quality_gam, op3_secret_scan, op4_poisson_mixing, op5_language_mixture, op6_chosen_path, op7_line_dedup, op8_media_columns, op9_fingerprint, op10_paragraph_bands)}
ORACLES = {"op4_poisson_mixing": mixing.ORACLE, "op7_line_dedup": linededup.ORACLE}
