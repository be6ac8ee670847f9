"""Account feature store (set B): 83 columns in five families.

Sample deviation, no rounding, and day buckets counted from the first transfer of the data set.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.exprs import EPS, bucket, dbl, finite, postings
from .behaviour import _ratios


def clean(tx: DataFrame) -> DataFrame:
    """Drop rows without a time, with amount <= 0 or paid to oneself."""
    return tx.where("t IS NOT NULL AND amount > 0 AND sender_id <> receiver_id")


def first_time(tx: DataFrame) -> Column:
    """Scalar subquery: the earliest transfer."""
    return tx.select(F.min("t")).scalar()


def transactional(totals: DataFrame, degree: DataFrame) -> DataFrame:
    base = totals.join(degree, "account_id")
    n = F.col("transaction_count")
    ratio = _ratios(base, "std_samp")
    return base.select(
        "account_id",
        *[dbl(c).alias(c) for c in ("transaction_count", "sent_count", "received_count", "total_incoming",
                                    "total_outgoing", "maximum_transaction_amount")],
        *[expr.alias(name) for name, expr in ratio.items()],
        dbl("near_out").alias("near_threshold_out"), dbl("near_in").alias("near_threshold_in"),
        (F.col("sub_count") / n).alias("sub_threshold_share"),
        (F.col("round_count") / n).alias("round_amount_share"),
    )


def pace(totals: DataFrame) -> DataFrame:
    """Span, velocity and night share: plain functions of the totals."""
    span = F.greatest((F.col("last_t") - F.col("first_t")) / 3600.0, F.lit(0.0))
    n = F.col("transaction_count")
    return totals.select(
        "account_id", span.alias("active_span_hours"),
        (n / F.greatest(span, F.lit(0.1))).alias("transaction_velocity"),
        (F.col("night_count") / n).alias("night_share"),
    )


def hourly(tx: DataFrame) -> DataFrame:
    """Busiest clock hour and entropy over the 24 hours of the day."""
    per_hour = postings(tx).groupBy("account_id", bucket("t", fixed.HOUR).alias("hour")).agg(F.count("*").alias("c"))
    per_hod = per_hour.groupBy("account_id", F.pmod("hour", F.lit(24)).alias("hod")).agg(
        F.sum("c").alias("c"), F.max("c").alias("peak"),
    )
    # -sum(p ln p) = ln N - sum(c ln c) / N
    total = F.sum("c")
    return per_hod.groupBy("account_id").agg(
        dbl(F.max("peak")).alias("max_tx_per_hour"),
        F.greatest(F.lit(0.0), F.log(total) - F.sum(F.col("c") * F.log("c")) / total).alias("hour_entropy"),
    )


def daily_sums(tx: DataFrame) -> DataFrame:
    """Money in and out per account and day since the first transfer."""
    day = F.floor((F.col("t") - first_time(tx)) / fixed.DAY).cast("bigint")
    out = F.col("is_out")
    return postings(tx).withColumn("day", day).groupBy("account_id", "day").agg(
        F.coalesce(F.sum(F.when(~out, F.col("amount"))), F.lit(0)).alias("day_in"),
        F.coalesce(F.sum(F.when(out, F.col("amount"))), F.lit(0)).alias("day_out"),
    )


def daily(per_day: DataFrame) -> DataFrame:
    return per_day.groupBy("account_id").agg(
        dbl(F.count("*")).alias("active_days"),
        (dbl(F.sum(F.least("day_in", "day_out"))) / (dbl(F.sum("day_in")) + 1.0)).alias("same_day_turnover"),
    )


def two_hourly(tx: DataFrame) -> DataFrame:
    """Most distinct senders and receivers in one epoch-aligned two-hour bucket."""
    cells = postings(tx).groupBy(
        "account_id", "counterparty", bucket("t", fixed.TWO_HOURS).alias("slot")
    ).agg(F.max("is_out").alias("paid"), F.max(~F.col("is_out")).alias("got"))
    slots = cells.groupBy("account_id", "slot").agg(
        F.count_if("got").alias("senders"), F.count_if("paid").alias("receivers")
    )
    return slots.groupBy("account_id").agg(
        dbl(F.max("senders")).alias("max_senders_2h"), dbl(F.max("receivers")).alias("max_receivers_2h")
    )


def gaps(tx: DataFrame) -> DataFrame:
    """Inter-arrival gaps per account with their multiplicity: (account_id, gap, c).

    Rows are first combined per second, then each account-day is scanned by itself; the step from one
    active day to the next joins the days' end points. A hot account is therefore many small windows.
    """
    instants = postings(tx).groupBy("account_id", "t").agg(F.count("*").alias("c")).withColumn(
        "day", bucket("t", fixed.DAY)
    )
    inside = Window.partitionBy("account_id", "day").orderBy("t")
    steps = instants.select(
        "account_id", (F.col("t") - F.lag("t").over(inside)).alias("gap"), F.lit(1).cast("bigint").alias("c")
    ).where("gap IS NOT NULL")
    ties = instants.where("c > 1").select("account_id", F.lit(0).cast("bigint").alias("gap"), (F.col("c") - 1).alias("c"))
    ends = instants.groupBy("account_id", "day").agg(F.min("t").alias("a"), F.max("t").alias("b"))
    days = Window.partitionBy("account_id").orderBy("day")
    across = ends.select(
        "account_id", (F.col("a") - F.lag("b").over(days)).alias("gap"), F.lit(1).cast("bigint").alias("c")
    ).where("gap IS NOT NULL")
    return steps.unionByName(ties).unionByName(across).groupBy("account_id", "gap").agg(F.sum("c").alias("c"))


def rhythm(tx: DataFrame) -> DataFrame:
    """Median, variation and burstiness of inter-arrival gaps; accounts with two or more transfers."""
    g, c = F.col("gap").cast("double"), F.col("c")
    stats = gaps(tx).groupBy("account_id").agg(
        F.sum("c").alias("n"), F.sum(g * c).alias("s"), F.sum(g * g * c).alias("q"),
        F.percentile("gap", 0.5, F.col("c")).alias("inter_arrival_median_s"),
    )
    mean = F.col("s") / F.col("n")
    var = F.when(F.col("n") > 1, (F.col("q") - F.col("s") * mean) / (F.col("n") - 1)).otherwise(0.0)
    std = F.sqrt(F.greatest(var, F.lit(0.0)))
    return stats.select(
        "account_id", "inter_arrival_median_s",
        (std / (mean + EPS)).alias("inter_arrival_cv"),
        ((std - mean) / (std + mean + EPS)).alias("burstiness"),
    )


def tier_flags(accounts: DataFrame, tiers: DataFrame) -> DataFrame:
    """One-hot tier; an account without a tier is personal, an unknown tier is none of the three."""
    tier = F.coalesce("tier", F.lit("personal"))
    return accounts.select("account_id").join(tiers, "account_id", "left").select(
        "account_id", *[F.when(tier == t, 1.0).otherwise(0.0).alias(f"tier_{t}") for t in fixed.TIERS]
    )


def flow_columns(flow_accounts: DataFrame, totals: DataFrame, suffix: str) -> DataFrame:
    """Feature columns of one tracing pass, 0 (dwell -1) where an account forwards nothing."""
    joined = totals.select("account_id", "total_incoming").join(flow_accounts, "account_id", "left")
    return joined.select(
        "account_id",
        F.coalesce(dbl("forward_count"), F.lit(0.0)).alias(f"forward_count_{suffix}"),
        F.coalesce(dbl("forwarded_amount") / (F.col("total_incoming") + 1.0), F.lit(0.0)).alias(f"forward_share_{suffix}"),
        F.coalesce(dbl("chain_length"), F.lit(0.0)).alias(f"chain_length_{suffix}"),
        F.coalesce(dbl("cycle_count"), F.lit(0.0)).alias(f"cycle_count_{suffix}"),
        F.coalesce(dbl("dwell_mean"), F.lit(-1.0)).alias(f"dwell_{suffix}_s"),
    )


def message_base(features: DataFrame) -> DataFrame:
    """The ten columns that are averaged over neighbours (needs degrees, totals and slow flow columns)."""
    return features.select(
        "account_id",
        F.log1p("total_incoming").alias("log_total_incoming"),
        F.log1p("total_outgoing").alias("log_total_outgoing"),
        "passthrough_ratio", "chain_length_slow",
        F.least(F.col("forward_share_slow"), F.lit(2.0)).alias("forward_share_slow"),
        (F.col("near_threshold_out") + F.col("near_threshold_in")).alias("near_threshold_total"),
        F.least(F.col("cycle_count_slow"), F.lit(10.0)).alias("cycle_count_slow"),
        "night_share",
        F.log1p("in_degree").alias("log_in_degree"), F.log1p("out_degree").alias("log_out_degree"),
    )


def neighbour_mean(links: DataFrame, base: DataFrame, key: str, other: str, prefix: str) -> DataFrame:
    """Mean of every base column over an account's linked accounts.

    A hub's links meet one base row each; the averages combine map-side, and adaptive execution splits
    a skewed join partition.
    """
    names = [c for c in base.columns if c != "account_id"]
    return (
        links.join(base.withColumnRenamed("account_id", other), other)
        .groupBy(F.col(key).alias("account_id")).agg(*[F.avg(c).alias(f"{prefix}{c}") for c in names])
    )


def neighbourhood(pairs: DataFrame, both: DataFrame, base: DataFrame) -> DataFrame:
    """Means over payers, over payees, and the mean of means over all neighbours."""
    nb_in = neighbour_mean(pairs, base, "dst", "src", "nb_in_")
    nb_out = neighbour_mean(pairs, base, "src", "dst", "nb_out_")
    once = neighbour_mean(both, base, "node", "nbr", "")
    nb2 = neighbour_mean(both, once, "node", "nbr", "nb2_")
    return base.select("account_id").join(nb_in, "account_id", "left").join(
        nb_out, "account_id", "left").join(nb2, "account_id", "left")


def temporal(tx: DataFrame, totals: DataFrame) -> DataFrame:
    """The temporal family without the dwell columns."""
    out = pace(totals)
    for part in (hourly(tx), daily(daily_sums(tx)), two_hourly(tx), rhythm(tx)):
        out = out.join(part, "account_id", "left")
    return out.na.fill({"inter_arrival_median_s": -1.0, "inter_arrival_cv": 0.0, "burstiness": 0.0})


def finalise(features: DataFrame) -> DataFrame:
    """The 83 columns in their fixed order, finite and without nulls."""
    return features.select("account_id", *[finite(F.col(c)).alias(c) for c in fixed.ALL_FEATURES])
