"""Behavioural features (set A), graph features and the joined anomaly feature vector."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.exprs import EPS, dbl, near_threshold, postings, r4, sub_threshold
from . import graph


def account_totals(tx: DataFrame, threshold=fixed.REPORTING_THRESHOLD) -> DataFrame:
    """Every plain aggregate of an account in one pass, combined map-side."""
    out = F.col("is_out")
    amount = F.col("amount")
    hour = F.pmod(F.floor(F.col("t") / fixed.HOUR), F.lit(24))
    step = F.pmod(amount, F.lit(fixed.ROUND_STEP).cast("decimal(18,4)"))
    near = near_threshold(amount, threshold)
    return postings(tx).groupBy("account_id").agg(
        F.count("*").alias("transaction_count"),
        F.count_if(out).alias("sent_count"),
        F.count_if(~out).alias("received_count"),
        dbl(F.coalesce(F.sum(F.when(~out, amount)), F.lit(0))).alias("total_incoming"),
        dbl(F.coalesce(F.sum(F.when(out, amount)), F.lit(0))).alias("total_outgoing"),
        dbl(F.max("amount")).alias("maximum_transaction_amount"),
        F.stddev_pop(dbl("amount")).alias("std_pop"),
        F.coalesce(F.stddev_samp(dbl("amount")), F.lit(0.0)).alias("std_samp"),
        F.count_if(near & out).alias("near_out"),
        F.count_if(near & ~out).alias("near_in"),
        F.count_if(sub_threshold(amount, threshold)).alias("sub_count"),
        F.count_if(step == 0).alias("round_count"),
        F.count_if(hour < 6).alias("night_count"),
        F.min("t").alias("first_t"),
        F.max("t").alias("last_t"),
    )


def _ratios(base: DataFrame, std: str) -> dict:
    total_in, total_out, n = F.col("total_incoming"), F.col("total_outgoing"), F.col("transaction_count")
    volume = total_in + total_out
    avg = volume / n
    most = F.greatest(total_in, total_out)
    return {
        "net_flow": total_in - total_out,
        "average_transaction_amount": avg,
        "std_transaction_amount": F.col(std),
        "incoming_outgoing_ratio": total_in / (total_out + 1.0),
        "passthrough_ratio": F.when(most > 0, F.least(total_in, total_out) / (most + EPS)).otherwise(0.0),
        "flow_imbalance_magnitude": F.when(volume > 0, F.abs(total_in - total_out) / (volume + EPS)).otherwise(0.0),
        "counterparty_diversity": F.col("unique_counterparties") / n,
        "amount_volatility": F.when(avg > 0, F.col(std) / (avg + EPS)).otherwise(0.0),
    }


def behaviour_features(totals: DataFrame, degree: DataFrame) -> DataFrame:
    """Set A: 17 columns, population deviation, rounded to four places."""
    base = totals.join(degree, "account_id")
    span = F.greatest((F.col("last_t") - F.col("first_t")) / 3600.0, F.lit(0.1))
    n = F.col("transaction_count")
    ratio = _ratios(base, "std_pop")
    return base.select(
        "account_id", "transaction_count", "sent_count", "received_count",
        r4(F.col("total_incoming")).alias("total_incoming"),
        r4(F.col("total_outgoing")).alias("total_outgoing"),
        r4(F.col("maximum_transaction_amount")).alias("maximum_transaction_amount"),
        F.col("in_degree").alias("unique_senders"),
        F.col("out_degree").alias("unique_receivers"),
        r4(F.when(n >= 2, n / span).otherwise(n)).alias("transaction_velocity"),
        *[r4(expr).alias(name) for name, expr in ratio.items()],
    )


def graph_features(
    degree: DataFrame,
    totals: DataFrame,
    components: DataFrame,
    neighbours: DataFrame,
    flags: DataFrame,
    cycle_counts: DataFrame,
    chain_lengths: DataFrame,
    near_counts: DataFrame,
) -> DataFrame:
    """17 graph columns per account.

    ``components``: account_id, component_size. ``neighbours``: node, nbr. ``flags``: account_id,
    pattern. ``cycle_counts``: account_id, cycle_count. ``chain_lengths``: account_id, chain_length.
    ``near_counts``: account_id, near_threshold_tx_count.
    """
    flagged = flags.where(F.col("pattern").isin(*fixed.NEIGHBOUR_PATTERNS)).select("account_id").distinct()
    suspicious = (
        neighbours.join(flagged.withColumnRenamed("account_id", "nbr"), "nbr", "left_semi")
        .groupBy(F.col("node").alias("account_id")).agg(F.count("*").alias("suspicious_neighbor_count"))
    )
    marks = flags.groupBy("account_id").agg(
        F.max(F.when(F.col("pattern") == "circular_flow", 1).otherwise(0)).alias("cycle_detected"),
        F.max(F.when(F.col("pattern") == "structuring", 1).otherwise(0)).alias("structuring_detected"),
    )
    base = degree_features(degree, totals)
    for part in (components.select("account_id", F.col("component_size").alias("network_size")),
                 marks, cycle_counts, chain_lengths, near_counts, suspicious):
        base = base.join(part, "account_id", "left")
    counted = ("cycle_detected", "structuring_detected", "cycle_count", "chain_length",
               "near_threshold_tx_count", "suspicious_neighbor_count")
    return base.na.fill(0, list(counted)).na.fill(1, ["network_size"])


def degree_features(degree: DataFrame, totals: DataFrame) -> DataFrame:
    base = degree.join(totals.select("account_id", "total_incoming", "total_outgoing"), "account_id")
    i, o = F.col("in_degree"), F.col("out_degree")

    def fan(a, b):
        return F.when(a >= 3, F.least(F.lit(1.0), a / F.greatest(F.lit(1), b * 2))).otherwise(0.0)

    return base.select(
        "account_id", "in_degree", "out_degree", (i + o).alias("total_degree"),
        r4(i / (o + 1.0)).alias("degree_ratio"),
        r4(F.col("total_incoming")).alias("weighted_in_degree"),
        r4(F.col("total_outgoing")).alias("weighted_out_degree"),
        r4(F.col("total_incoming") - F.col("total_outgoing")).alias("net_weight_flow"),
        "unique_counterparties",
        r4(fan(i, o)).alias("fan_in_score"), r4(fan(o, i)).alias("fan_out_score"),
    )


def feature_vector(behaviour: DataFrame, graph_part: DataFrame) -> DataFrame:
    """Set A joined with the graph columns, accounts of either side kept, gaps filled with 0."""
    joined = behaviour.join(graph_part, "account_id", "full")
    return joined.na.fill(0)


def inputs(tx: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(totals, degrees) of a transfer table."""
    return account_totals(tx), graph.degrees(graph.account_pairs(tx))
