"""The flagship query: raw transfers through the whole pipeline to ranked, explained reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import validate
from ..sources import views
from ..sources.session import cut
from . import pipeline


def reports(spark: SparkSession, folder: str) -> DataFrame:
    """Validated transfers, all detectors, anomaly and composite score, evidence; riskiest first."""
    tx = cut(validate.valid(validate.check(views.tx_raw(spark, folder))))
    found, _ = pipeline.run(tx)
    return found.select(
        "account_id", "risk_score", "risk_level", F.array_join("patterns", ",").alias("patterns"), "typology",
        F.array_join("evidence", " | ").alias("evidence"))
