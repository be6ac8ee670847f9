"""Tables that several plans of one session share, built once per session and input folder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_KEPT: dict[tuple, object] = {}


def once(spark: SparkSession, folder: str, name: str, build: Callable[[], object]):
    """The result of ``build``, kept while the session lives. Use it for checkpointed tables, fitted
    models and plain numbers."""
    key = (spark.sparkContext.applicationId, folder, name)
    if key not in _KEPT:
        _KEPT[key] = build()
    return _KEPT[key]


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    """Doubles rounded for comparison and display."""
    from pyspark.sql import functions as F

    return df.select(*[F.round(c, places).alias(c) if kind == "double" else F.col(c) for c, kind in df.dtypes])
