"""Readers and writers for transfers, configuration, results and metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .session import prepare


RAW_SCHEMA = (
    "transaction_id string, tx_id string, sender_id string, sender string, receiver_id string, receiver string, "
    "amount variant, timestamp variant, tx_type string, location string, device_id string, _corrupt_record string"
)


def read_transfers(spark: SparkSession, path: str, fmt: str = "json", **options: str) -> DataFrame:
    """Raw transfers; records that do not parse keep their text in ``_corrupt_record``.

    JSON keeps whether an amount or a time was a number, a text or something else; everything else is text.
    CSV has the same columns, all text, and keeps broken lines as well.


    JSON may be one record per line or, with ``multiLine="true"``, an array. Parquet keeps its types.
    """
    prepare(spark)
    if fmt == "parquet":
        return spark.read.options(**options).parquet(path)
    if fmt == "orc":
        return spark.read.options(**options).orc(path)
    reader = spark.read.schema(RAW_SCHEMA).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record")
    if fmt == "csv":
        names = spark.read.option("header", "true").options(**options).csv(path).columns
        return spark.read.schema(", ".join(f"`{c}` string" for c in [*names, "_corrupt_record"])).option("header", "true").option(
            "mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record").options(**options).csv(path)
    return reader.options(**options).json(path)


def malformed(raw: DataFrame) -> DataFrame:
    """Records the reader could not parse, as quarantine rows."""
    # Spark reads files for the corrupt record only together with another column
    read = F.length(F.coalesce(F.col(raw.columns[0]).cast("string"), F.lit(""))) >= 0
    return raw.where(F.col("_corrupt_record").isNotNull() & read).select(
        F.lit("Malformed transaction record").alias("error"), F.col("_corrupt_record").alias("raw"))


def read_risk_areas(spark: SparkSession, path: str) -> DataFrame:
    """Listed areas from the configuration file; a missing or unreadable file means none."""
    empty = spark.createDataFrame([], "area string")
    try:
        raw = spark.read.schema("risk_areas array<string>").option("multiLine", "true").json(path)
    except Exception as problem:  # the path does not exist
        if "PATH_NOT_FOUND" in str(problem):
            return empty
        raise
    return raw.select(F.explode("risk_areas").alias("area")).distinct()


def write_payload(reports: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite") -> None:
    """Account reports, one folder per risk level."""
    reports.write.mode(mode).partitionBy("risk_level").format(fmt).save(path)


def publish_metrics(metrics: DataFrame, path: str, section: str, run_at: str | Column) -> None:
    """Appends (run_at, section, metric, value) rows; earlier runs stay."""
    when = F.lit(run_at) if isinstance(run_at, str) else run_at
    names = [c for c, kind in metrics.dtypes if kind in ("double", "float", "int", "bigint") or kind.startswith("decimal")]
    long = metrics.select(F.explode(F.array(*[
        F.struct(F.lit(n).alias("metric"), F.col(n).cast("double").alias("value")) for n in names])).alias("m")).select("m.*")
    long.select(when.alias("run_at"), F.lit(section).alias("section"), "metric", "value").write.mode("append").parquet(path)


def latest_metrics(spark: SparkSession, path: str) -> DataFrame:
    """The newest value of every metric."""
    rows = spark.read.parquet(path)
    return rows.groupBy("section", "metric").agg(F.max_by("value", "run_at").alias("value"), F.max("run_at").alias("run_at"))


