"""Registered queries of the text operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from paytrace.llm import (
    extract, langid, masked_lm, mixing, neardup, neighbours, pieces, quality, shards, spans, toxicity, variants, whitening,
)

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_near_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    return neardup.components(_table(spark, folder, "documents"))


def op2_main_text(spark: SparkSession, folder: str) -> DataFrame:
    return extract.extract(_table(spark, folder, "pages"))


def op3_shards(spark: SparkSession, folder: str) -> DataFrame:
    return shards.place(_table(spark, folder, "documents"))


def op5_quality(spark: SparkSession, folder: str) -> DataFrame:
    return quality.judge(_table(spark, folder, "documents")).drop("words_removed", "key")


def op4_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.rate_documents(_table(spark, folder, "documents"), _table(spark, folder, "labels"))


def op6_masked_lm(spark: SparkSession, folder: str) -> DataFrame:
    return masked_lm.score_documents(_table(spark, folder, "documents"))


def op7_language(spark: SparkSession, folder: str) -> DataFrame:
    return langid.languages(_table(spark, folder, "documents"))


def op8_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    return neighbours.nearest(_table(spark, folder, "embeddings"))


def op9_pieces(spark: SparkSession, folder: str) -> DataFrame:
    return pieces.encode_documents(_table(spark, folder, "documents"))


def op10_mixing(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.balance(_table(spark, folder, "documents")).select(
        "doc_id", "size", "source_size", "target", "taken")


def op11_variants(spark: SparkSession, folder: str) -> DataFrame:
    return variants.variants(_table(spark, folder, "documents"))


def op12_whitening(spark: SparkSession, folder: str) -> DataFrame:
    return whitening.whiten(_table(spark, folder, "embeddings"))


def op13_spans(spark: SparkSession, folder: str) -> DataFrame:
    return spans.dedup(_table(spark, folder, "documents"))


QUERIES: dict[str, Query] = {
    "op1_near_duplicates": op1_near_duplicates,
    "op2_main_text": op2_main_text,
    "op3_shards": op3_shards,
    "op4_toxicity": op4_toxicity,
    "op5_quality": op5_quality,
    "op6_masked_lm": op6_masked_lm,
    "op7_language": op7_language,
    "op8_neighbours": op8_neighbours,
    "op9_pieces": op9_pieces,
    "op10_mixing": op10_mixing,
    "op11_variants": op11_variants,
    "op12_whitening": op12_whitening,
    "op13_spans": op13_spans,
}
