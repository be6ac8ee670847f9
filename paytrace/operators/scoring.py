"""Score calibration and the composite 0-100 risk score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.order import exact_percentiles

# Output name: (feature, percentile, value used when there is nothing to measure).
BASELINES = {
    "velocity_p75": ("transaction_velocity", 0.75, 5.0),
    "velocity_p90": ("transaction_velocity", 0.90, 10.0),
    "max_amt_p75": ("maximum_transaction_amount", 0.75, 1500.0),
    "max_amt_p90": ("maximum_transaction_amount", 0.90, 4000.0),
    "passthrough_p75": ("passthrough_ratio", 0.75, 0.70),
    "imbalance_p75": ("flow_imbalance_magnitude", 0.75, 0.75),
    "diversity_p25": ("counterparty_diversity", 0.25, 0.50),
}
DEFAULT_BASELINES = {name: default for name, (_, _, default) in BASELINES.items()}


def spread(scored: DataFrame, score: str = "raw_score") -> tuple[float, float]:
    """(median, spread) of a score column; the spread is 1.4826 x MAD, or the deviation if MAD is tiny."""
    median = exact_percentiles(scored, {"m": (score, 0.5)})["m"]
    away = scored.select(F.abs(F.col(score) - median).alias("away"))
    mad = 1.4826 * exact_percentiles(away, {"m": ("away", 0.5)})["m"]
    if mad < 1e-4:
        mad = max(scored.agg(F.stddev_pop(score)).first()[0], 0.05)
    return median, mad


def calibrate(scored: DataFrame, mad: float, score: str = "raw_score") -> DataFrame:
    """0-100 anomaly score: inliers (>= 0) map into the low band, outliers into 50-98."""
    s = F.col(score)
    d = -s / F.lit(max(mad, 0.05))
    risk = F.when(s >= 0, 38.0 * F.exp(d)).otherwise(50.0 + 48.0 * F.tanh(0.75 * d))
    return scored.withColumn("ml_anomaly_score", F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.round(risk, 2)))).withColumn(
        "is_anomaly", s < 0)


def baselines(features: DataFrame) -> dict[str, float]:
    """Exact population percentiles that behaviour points are measured against."""
    found = exact_percentiles(features, {name: (col, p) for name, (col, p, _) in BASELINES.items()})
    return {name: DEFAULT_BASELINES[name] if value is None else value for name, value in found.items()}


def level(score: Column) -> Column:
    return (F.when(score >= 90.0, "CRITICAL").when(score >= 70.0, "HIGH").when(score >= 40.0, "MEDIUM").otherwise("LOW"))


def _has(pattern: str) -> Column:
    return F.array_contains("patterns", pattern)


def ml_component(tier: Column, anomaly: Column, probability: Column) -> Column:
    """The stronger of anomaly score and classifier; business tiers count the classifier alone."""
    percent = F.round(100.0 * probability, 2)
    return (F.when(probability.isNull(), anomaly).when(tier.isin(*fixed.BUSINESS_TIERS), percent)
            .otherwise(F.greatest(anomaly, percent)))


def graph_points(tier_aware: bool = True) -> Column:
    """Points for network evidence. Business as usual is not held against agents and merchants."""
    business = F.col("account_tier").isin(*fixed.BUSINESS_TIERS) if tier_aware else F.lit(False)
    feature = {"circular_flow": F.col("cycle_detected") > 0, "structuring": F.col("structuring_detected") > 0}
    total = F.lit(0.0)
    for pattern, points in fixed.PATTERN_POINTS.items():
        fires = _has(pattern) | feature[pattern] if pattern in feature else _has(pattern)
        if pattern in fixed.BUSINESS_AS_USUAL:
            fires = fires & ~business
        total = total + F.when(fires, points).otherwise(0.0)
    total = total + F.when(F.col("chain_length") >= 3, fixed.CHAIN_POINTS).otherwise(0.0)
    total = total + F.when(F.col("suspicious_neighbor_count") >= 2, fixed.NEIGHBOUR_POINTS).otherwise(0.0)
    return F.least(F.lit(100.0), total)


def behaviour_points(base: dict[str, float]) -> Column:
    """Points for unusual behaviour against the population baselines."""
    velocity, top, ratio = F.col("transaction_velocity"), F.col("maximum_transaction_amount"), F.col("incoming_outgoing_ratio")
    total = F.when(velocity >= base["velocity_p90"], 30.0).when(velocity >= base["velocity_p75"], 15.0).otherwise(0.0)
    total = total + F.when(
        (ratio > 5.0) | (ratio < 0.2) | (F.col("flow_imbalance_magnitude") >= base["imbalance_p75"]), 25.0).otherwise(0.0)
    total = total + F.when(top >= base["max_amt_p90"], 25.0).when(top >= base["max_amt_p75"], 12.0).otherwise(0.0)
    total = total + F.when(
        (F.col("passthrough_ratio") >= base["passthrough_p75"]) & (F.col("total_incoming") > 500), 20.0).otherwise(0.0)
    total = total + F.when(
        (F.col("transaction_count") >= 3) & (F.col("counterparty_diversity") <= base["diversity_p25"]), 15.0).otherwise(0.0)
    return F.least(F.lit(100.0), total)


def composite(rows: DataFrame, base: dict[str, float] | None = None, weights=fixed.SCORE_WEIGHTS,
              tier_aware: bool = True) -> DataFrame:
    """Adds the three components, ``risk_score`` and ``risk_level``.

    ``rows`` holds the feature vector plus ``patterns``, ``account_tier``, ``ml_anomaly_score`` and
    ``supervised_probability`` (null without a classifier).
    """
    base = base or DEFAULT_BASELINES
    w_ml, w_graph, w_beh = (w / sum(weights) for w in weights)
    out = rows.withColumn("ml_component", ml_component(
        F.col("account_tier"), F.col("ml_anomaly_score"), F.col("supervised_probability")))
    out = out.withColumn("graph_component", graph_points(tier_aware)).withColumn("behavioral_component", behaviour_points(base))
    mixed = w_ml * F.col("ml_component") + w_graph * F.col("graph_component") + w_beh * F.col("behavioral_component")
    final = F.greatest(mixed, fixed.GRAPH_FLOOR * F.col("graph_component"))
    out = out.withColumn("risk_score", F.round(F.greatest(F.lit(0.0), F.least(F.lit(100.0), final)), 2))
    return out.withColumn("risk_level", level(F.col("risk_score")))


def account_patterns(flags: DataFrame) -> DataFrame:
    """Patterns per account in catalogue order; at most one entry per pattern."""
    rank = F.array(*[F.lit(p) for p in fixed.PATTERN_ORDER])
    return flags.groupBy("account_id").agg(F.collect_set("pattern").alias("found")).select(
        "account_id", F.filter(rank, lambda p: F.array_contains("found", p)).alias("patterns"))


def infer_tier(account: Column) -> Column:
    """Tier from the naming convention of account ids."""
    name = F.upper(account)
    return (
        F.when(name.contains("AGENT") | name.contains("CASHOUT") | name.startswith("AGT"), "agent")
        .when(name.contains("MERCH") | name.startswith("MER") | name.contains("BILLER"), "merchant")
        .otherwise("personal")
    )


def tiers(accounts: DataFrame, given: DataFrame | None = None) -> DataFrame:
    """(account_id, tier): the given map, personal where it is silent; without a map, by name."""
    if given is None:
        return accounts.select("account_id", infer_tier(F.col("account_id")).alias("tier"))
    return accounts.select("account_id").join(given.select("account_id", "tier"), "account_id", "left").withColumn(
        "tier", F.coalesce("tier", F.lit("personal")))


def risk_reports(scored: DataFrame) -> DataFrame:
    """Report rows, riskiest first."""
    return scored.orderBy(F.desc("risk_score"), "account_id")
