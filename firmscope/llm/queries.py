"""The registered queries of the corpus operators, each over its whole table, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import avi, langid, licenses, mixing, neardup, oracles, packing, pieces, quality, repair, sharding, spelling, tokens, warczip
from .common import stage


def _table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of all documents in files with Elias-Fano bounds, read back."""
    docs = _table(spark, sf_dir, "documents", "doc_id", "text")
    blocks = tokens.write_token_blocks(docs, "byte_bpe_50k.json", keeps_space=True, end_id=0)
    return tokens.read_token_blocks(blocks)


def op2_vector_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 16 shards of near-equal bytes (and tokens and rows); equal texts share a shard."""
    measured = sharding.measure(_table(spark, sf_dir, "documents", "doc_id", "text")).drop("text")
    rows = sharding.assign_shards(stage(measured, "shard-measures"))
    return rows.select(
        "doc_id", F.col("shard_size").alias("size"), F.col("shard_text_crc32").alias("text_crc32"), F.lit("bytes").alias("law"), "shard", F.col("shard_slot").alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )


def op3_license_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licenses that all documents name, by ordered signature rules."""
    return licenses.license_report(_table(spark, sf_dir, "documents", "doc_id", "text"))


def op4_robust_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics of all documents and the verdict of the base rule and the MCD rule."""
    return quality.quality_report(_table(spark, sf_dir, "documents", "doc_id", "text", "lang", "source"))


def op5_avi_shots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents stored as motion-JPEG movies and read back."""
    return avi.movie_digests(_table(spark, sf_dir, "documents", "doc_id", "text"))


def op6_zip_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages as WARC records in ZIP packages, read back by ranges."""
    packages = warczip.write_packages(_table(spark, sf_dir, "pages", "page_id", "url", "html"))
    return warczip.read_packages(packages).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op7_bayes_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate groups of all documents at 85 of 100."""
    return neardup.linked_groups(_table(spark, sf_dir, "documents", "doc_id", "text"))


def op8_best_fit_packs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents' ids in sequences of at most 2048."""
    return packing.pack_documents(_table(spark, sf_dir, "documents", "doc_id", "text"))


def op9_word_backoff_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of all documents, by words and n-grams learned from three folds of four."""
    return langid.language_report(_table(spark, sf_dir, "documents", "doc_id", "text", "lang"))


def op10_pfair_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in a schedule that holds each source to the square root of its size."""
    rows = mixing.mix_sources(_table(spark, sf_dir, "documents", "doc_id", "source"))
    return rows.select("doc_id", "source", F.round("mix_weight", 6).alias("weight"), F.col("mix_block").alias("block"), F.col("mix_slot").alias("slot"), F.col("mix_place").alias("place"))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations damaged and repaired by the cheapest edits."""
    return repair.repair_report(_table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All words of all documents with their near words and the form they are variants of."""
    return spelling.variant_report(_table(spark, sf_dir, "documents", "doc_id", "text"))


def op13_piece_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents encoded by a table of distinct chunks, and decoded."""
    return pieces.piece_digests(_table(spark, sf_dir, "documents", "doc_id", "text"), "piece_bpe_32k.model")


QUERIES = {
    "op1_token_files": op1_token_files,
    "op2_vector_shards": op2_vector_shards,
    "op3_license_rules": op3_license_rules,
    "op4_robust_quality": op4_robust_quality,
    "op5_avi_shots": op5_avi_shots,
    "op6_zip_warc": op6_zip_warc,
    "op7_bayes_near_duplicates": op7_bayes_near_duplicates,
    "op8_best_fit_packs": op8_best_fit_packs,
    "op9_word_backoff_language": op9_word_backoff_language,
    "op10_pfair_mix": op10_pfair_mix,
    "op11_conversation_repair": op11_conversation_repair,
    "op12_spelling_variants": op12_spelling_variants,
    "op13_piece_chunks": op13_piece_chunks,
}

def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(oracles.ORACLE)
