"""The corpus pipeline: quality rules, language, near duplicates, source mix, token ids.

Each stage takes (spark, docs, sf_dir), decides over all rows of ``docs`` and returns a DataFrame, which is
written and read again before the next stage. All but the last keep the columns of ``documents``. Nulls,
empty texts, repeated rows and further columns are handled as the operators' docstrings say; an empty
table passes through every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from paytrace.llm import langid, mixing, neardup, pieces, quality
from paytrace.llm.common import stored


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or are depleted by lines their source repeats go; the others lose these lines."""
    return quality.keep(docs)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text is in no language that ``lang`` teaches go, unless their own label was hardly learned."""
    return langid.keep(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (80 % of their 5-word shingles) stays, the one with the smallest doc_id."""
    return neardup.keep(docs, 80)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are repeated or left out so that the sources meet their target words."""
    return mixing.repeat(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, lang, n_pieces, ids and round_trip per copy."""
    return pieces.encode_documents(docs, columns=("doc_id", "source", "lang"))


STAGES = [
    ("quality_rules", quality_rules),
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("source_mix", source_mix),
    ("token_ids", token_ids),
]

# Trained models, components, Newton steps and token ids are beyond SQL; tests/llm holds brute-force twins.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
