"""The registered queries of this folder: each operator over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, codes, fingerprint, line_dedup, lm, media, mixing, neardup, ngram_join, phrases, quality, tokencount, toxicity
from .common import fold, table
from .sql import CODES_SQL, NEAR_COPIES_SQL, PHRASES_SQL


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels").where(fold("doc_id", 5) != 0)
    scores = toxicity.toxicity_scores(docs, toxicity.fit(docs, labels))
    return scores.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score", "predicted")


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    done = bpe.encode_decode(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, digest=True)
    return done.select("doc_id", "n_tokens", F.lower(F.hex("ids")).alias("ids_sha256"), F.lower(F.hex("decoded")).alias("decoded_sha256"))


def op3_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = lm.lm_scores(table(spark, sf_dir, "documents"), fold("doc_id", 7) != 2)
    return scores.select("doc_id", (fold("doc_id", 7) == 2).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels").where(fold("doc_id", 4) != 2)
    scores = quality.quality_scores(docs, quality.fit(docs, labels))
    return scores.select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "score", "predicted")


def op5_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.similar_documents(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_links", "n_copies", F.col("size").alias("n_shingles"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_plan(table(spark, sf_dir, "documents")).select("doc_id", "size", F.col("source_size").cast("long").alias("source_size"), "target", "taken", "copies")


def op7_png_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_columns(table(spark, sf_dir, "documents"), keep_media=False)


def op8_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.compare_neighbours(fingerprint.with_next(table(spark, sf_dir, "documents")))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = line_dedup.without_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select("row.doc_id", "removed_lines", "removed_words", "partners", "text")


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return tokencount.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codes.compressed(table(spark, sf_dir, "embeddings"))


def op12_near_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_copies(table(spark, sf_dir, "embeddings"))


def op13_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_toxicity, op2_byte_bpe, op3_lm_score, op4_quality, op5_ngram_join, op6_mixing, op7_png_media, op8_fingerprint, op9_line_dedup, op10_token_counts, op11_vector_codes, op12_near_copies, op13_phrases)}


def oracle_sql() -> dict[str, str]:
    """The others cannot be written in SQL; tests/llm holds each against a brute-force version."""
    return {"op11_vector_codes": CODES_SQL, "op12_near_copies": NEAR_COPIES_SQL, "op13_phrases": PHRASES_SQL}
