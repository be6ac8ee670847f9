"""Small column expressions shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import fixed

EPS = 1e-6


def dbl(col: str | Column) -> Column:
    return (F.col(col) if isinstance(col, str) else col).cast("double")


def r4(col: Column) -> Column:
    return F.round(col.cast("double"), 4)


def near_threshold(amount: Column, threshold=fixed.REPORTING_THRESHOLD) -> Column:
    """Amount in [0.85 T, T): the upper bound is exclusive."""
    return (amount >= F.lit(fixed.NEAR_RATIO * threshold)) & (amount < F.lit(threshold))


def sub_threshold(amount: Column, threshold=fixed.REPORTING_THRESHOLD) -> Column:
    return (amount >= F.lit(fixed.SUB_RATIO * threshold)) & (amount < F.lit(threshold))


def fundable(receipt: Column, payment: Column, low=fixed.FLOW_MIN_RATIO, high=fixed.FLOW_MAX_RATIO) -> Column:
    """The payment is a comparable part of the receipt; exact decimal comparison."""
    return (payment >= F.lit(low) * receipt) & (payment <= F.lit(high) * receipt)


def bucket(t: str | Column, width: int) -> Column:
    """Epoch-aligned bucket; floors negative times too."""
    t = F.col(t) if isinstance(t, str) else t
    return F.floor(t / F.lit(width)).cast("bigint")


def postings(tx: DataFrame) -> DataFrame:
    """Two rows per transfer, one per side, from a single scan.

    ``is_out`` marks the sender's row; ``counterparty`` is the other end.
    """
    sides = F.array(
        F.struct(F.col("sender_id").alias("account_id"), F.col("receiver_id").alias("counterparty"),
                 F.lit(True).alias("is_out")),
        F.struct(F.col("receiver_id").alias("account_id"), F.col("sender_id").alias("counterparty"),
                 F.lit(False).alias("is_out")),
    )
    keep = [c for c in tx.columns if c not in ("sender_id", "receiver_id")]
    return tx.select(*keep, F.explode(sides).alias("side")).select("side.*", *keep)


def finite(col: Column) -> Column:
    """Infinite, NaN and null become 0."""
    x = col.cast("double")
    return F.when(x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))), 0.0).otherwise(x)


def plain_number(col: Column) -> Column:
    """A double as text without an exponent and with at least one decimal, e.g. ``5000000000.0``."""
    text = F.regexp_replace(col.cast("decimal(38,6)").cast("string"), r"0+$", "")
    return F.when(text.endswith("."), F.concat(text, F.lit("0"))).otherwise(text)


def thousands(col: Column) -> Column:
    """Whole number with thousands separators, e.g. ``38,850``."""
    return F.format_number(F.bround(col.cast("double"), 0), 0)
