"""Detectors that judge an account against its own history: takeovers and informal remittance."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.exprs import bucket, dbl
from ..functions.order import running_before
from ..sources.session import cut, tabled


# -------------------------------------------------------------------------- account takeover
def location_takeover(
    tx: DataFrame,
    risk_areas: DataFrame,
    min_history: int = 3,
    usual_share: float = 0.10,
    episode: int = fixed.DAY,
    drain_multiple: float = 3.0,
    drain_min: float = 5000.0,
    alert_score: int = 30,
) -> tuple[DataFrame, DataFrame]:
    """Wallets suddenly used from a risk area: (alerts, window payments of the alerts).

    ``risk_areas`` holds ``area``. A payment from a risk area that is unusual for its sender opens an
    episode; the episode's payments are scored against the sender's baseline. Flagged payments never
    join the baseline, unflagged ones do, so an account's episodes must be judged in order: each round
    judges the next episode of every account that still has one, all accounts at once. Only senders
    with a payment from a risk area are read. Rows are ordered by (t, receiver, amount, id).
    """
    order = F.struct("t", F.col("receiver_id").alias("r"), "amount", "transaction_id")
    areas = risk_areas.select(F.col("area").alias("location")).distinct()
    hits = tx.join(areas, "location", "left_semi").select("sender_id").distinct()
    mine = tx.join(hits, "sender_id", "left_semi").select(
        F.col("sender_id").alias("account_id"), F.col("receiver_id").alias("receiver"), "amount", "t",
        F.nullif(F.col("location"), F.lit("")).alias("area"), F.nullif(F.col("device_id"), F.lit("")).alias("device"),
        order.alias("ord"))
    mine = mine.join(areas.select(F.col("location").alias("area"), F.lit(True).alias("risky")), "area", "left").withColumn(
        "risky", F.coalesce("risky", F.lit(False)))
    mine = cut(mine)
    plain = mine.where("NOT risky")
    located = running_before(
        mine, ["account_id"], "ord", "t", fixed.DAY, "plain_before",
        F.when(F.col("area").isNotNull() & ~F.col("risky"), 1).otherwise(0))
    risky = cut(located.where("risky").drop("risky").withColumn("excluded", F.lit(False)))
    active = risky.select("account_id", F.lit(-1).cast("bigint").alias("episode_end")).distinct()
    alerts, payments = [], []
    while True:
        # Where does the next episode of each account start?
        kept = F.when(F.col("excluded"), 0).otherwise(1)
        seen = running_before(
            risky.join(active, "account_id"), ["account_id"], "ord", "t", fixed.DAY, "risky_before", kept)
        seen = running_before(seen, ["account_id", "area"], "ord", "t", fixed.DAY, "area_before", kept)
        base_size = F.col("plain_before") + F.col("risky_before")
        unusual = (base_size >= min_history) & (F.col("area_before") < usual_share * base_size)
        points = cut(
            seen.where((F.col("t") > F.col("episode_end")) & unusual).groupBy("account_id").agg(
                F.min(F.struct("ord", "area", "device", "t", base_size.alias("located"))).alias("p"))
            .select("account_id", F.col("p.ord").alias("p_ord"), F.col("p.area").alias("p_area"),
                    F.col("p.device").alias("p_device"), F.col("p.t").alias("p_t"), F.col("p.located").alias("located"))
        )
        if points.isEmpty():
            break
        # The baseline before the episode: everything earlier that was not flagged.
        columns = ["account_id", "receiver", "amount", "t", "area", "device", "ord"]
        base = plain.select(*columns).unionByName(risky.where("NOT excluded").select(*columns)).join(points, "account_id").where(
            F.col("ord") < F.col("p_ord"))
        typical = base.groupBy("account_id", bucket("t", fixed.DAY).alias("day")).agg(F.sum("amount").alias("out")).groupBy(
            "account_id").agg(F.percentile(dbl("out"), 0.5).alias("typical"))
        devices = base.groupBy("account_id").agg(
            (F.count("device") > 0).alias("had_device"), F.coalesce(F.max(F.col("device") == F.col("p_device")), F.lit(False)).alias("same_device"))
        usual = (
            base.where("area IS NOT NULL").groupBy("account_id", "area", "located").agg(F.count("*").alias("c"))
            .where(F.col("c") / F.col("located") >= usual_share)
            .groupBy("account_id").agg(F.sort_array(F.collect_list("area")).alias("usual_areas"))  # at most 1 / share areas
        )
        paid = base.select("account_id", "receiver").distinct().withColumn("known", F.lit(True))
        window = (
            risky.join(points, "account_id")
            .where((F.col("area") == F.col("p_area")) & (F.col("ord") >= F.col("p_ord")) & (F.col("t") - F.col("p_t") <= episode))
            .join(paid, ["account_id", "receiver"], "left")
            .select("account_id", "receiver", "amount", "t", F.col("p_t"), F.col("known").isNull().alias("new_receiver"))
        )
        totals = window.groupBy("account_id").agg(
            dbl(F.sum("amount")).alias("outflow"), F.count("*").alias("transactions"),
            dbl(F.coalesce(F.sum(F.when(F.col("new_receiver"), F.col("amount"))), F.lit(0))).alias("to_new"))
        judged = points.join(totals, "account_id")
        for part in (typical, devices, usual):
            judged = judged.join(part, "account_id", "left")
        typical_day = F.coalesce("typical", F.lit(0.0))
        new_device = F.col("p_device").isNotNull() & F.coalesce("had_device", F.lit(False)) & ~F.coalesce("same_device", F.lit(False))
        drain = F.col("outflow") >= F.greatest(drain_multiple * typical_day, F.lit(drain_min))
        mostly_new = (F.col("outflow") > 0) & (F.col("to_new") / F.col("outflow") >= 0.5)
        first, handset, fast, strangers = fixed.TAKEOVER_SIGNALS
        judged = judged.select(
            "account_id", F.col("p_area").alias("risk_area"), F.col("p_t").alias("first_seen"), "p_ord",
            F.coalesce("usual_areas", F.array().cast("array<string>")).alias("usual_areas"),
            new_device.alias("new_device"), F.round("outflow", 2).alias("outflow_24h"),
            F.round(typical_day, 2).alias("typical_daily_outflow"), "transactions",
            F.array_compact(F.array(
                F.lit(first), F.when(new_device, F.lit(handset)), F.when(drain, F.lit(fast)),
                F.when(mostly_new, F.lit(strangers)))).alias("signals"),
            (15 + F.when(new_device, 15).otherwise(0) + F.when(drain, 15).otherwise(0)
             + F.when(mostly_new, 10).otherwise(0)).alias("signal_score"))
        judged = cut(judged.withColumn("alert", F.col("signal_score") >= alert_score))
        hit = judged.where("alert")
        alerts.append(hit.drop("alert", "p_ord"))
        payments.append(cut(
            window.join(hit.select("account_id", "risk_area", F.col("first_seen").alias("p_t")), ["account_id", "p_t"])
            .select("account_id", F.col("p_t").alias("first_seen"), "risk_area", "receiver", "amount", "t", "new_receiver")))
        # Every flagged risk-area payment of the next 24 hours leaves the baseline.
        closed = judged.select(
            "account_id", F.col("first_seen").alias("s"), F.col("p_ord").alias("s_ord"), F.col("alert").alias("s_alert"))
        risky = cut(
            risky.join(closed, "account_id").withColumn(
                "excluded", F.col("excluded") | (F.col("s_alert") & (F.col("ord") >= F.col("s_ord"))
                                                 & (F.col("t") - F.col("s") <= episode)))
            .drop("s", "s_ord", "s_alert"))
        active = judged.select("account_id", (F.col("first_seen") + episode).alias("episode_end"))
    if not alerts:
        spark = tx.sparkSession
        return (
            spark.createDataFrame([], "account_id string, risk_area string, first_seen bigint, usual_areas array<string>, "
                                      "new_device boolean, outflow_24h double, typical_daily_outflow double, transactions bigint, "
                                      "signals array<string>, signal_score int"),
            spark.createDataFrame([], "account_id string, first_seen bigint, risk_area string, receiver string, "
                                      "amount decimal(18,4), t bigint, new_receiver boolean"),
        )
    all_alerts, all_payments = alerts[0], payments[0]
    for a, p in zip(alerts[1:], payments[1:]):
        all_alerts, all_payments = all_alerts.unionByName(a), all_payments.unionByName(p)
    return all_alerts, all_payments


def takeover_collectors(window_payments: DataFrame, min_victims: int = 2) -> DataFrame:
    """Receivers newly paid by several wallets during their flagged episodes."""
    new = window_payments.where("new_receiver")
    per_victim = new.groupBy("receiver", "account_id").agg(F.sum("amount").alias("amount"))
    areas = new.select("receiver", "risk_area").distinct().groupBy("receiver").agg(
        F.sort_array(F.collect_list("risk_area")).alias("risk_areas"))  # at most the configured list
    found = per_victim.groupBy("receiver").agg(
        F.count("*").alias("victim_count"), F.round(dbl(F.sum("amount")), 2).alias("amount_collected")
    ).where(F.col("victim_count") >= min_victims)
    return found.join(areas, "receiver").withColumnRenamed("receiver", "account_id")


def takeover_victims(collectors: DataFrame, window_payments: DataFrame) -> DataFrame:
    """The victims of each collector, in long form."""
    return (
        window_payments.where("new_receiver").select(F.col("receiver").alias("account_id"), F.col("account_id").alias("member"))
        .distinct().join(collectors.select("account_id"), "account_id", "left_semi")
    )


# ------------------------------------------------------------------------ informal remittance
def _with_tier(df: DataFrame, tiers: DataFrame, key: str) -> DataFrame:
    side = tiers.select(F.col("account_id").alias(key), F.col("tier").alias("__tier"))
    return df.join(side, key, "left").withColumn("__tier", F.coalesce("__tier", F.lit("personal")))


def informal_inflows(tx: DataFrame, tiers: DataFrame, min_amount: float = 10000.0) -> DataFrame:
    """Large transfers of an informal type that no merchant sent."""
    informal = F.coalesce(~F.col("tx_type").isin(*fixed.FORMAL_TX_TYPES), F.lit(True))
    big = tx.where((F.col("amount") >= min_amount) & informal)
    return _with_tier(big, tiers, "sender_id").where("__tier <> 'merchant'").drop("__tier")


def payouts(tx: DataFrame, tiers: DataFrame, low: float = 3000.0, high: float = 50000.0) -> DataFrame:
    """Remittance-sized transfers to personal accounts."""
    allowed = F.coalesce(~F.col("tx_type").isin(*fixed.NOT_PAYOUT_TX_TYPES), F.lit(True))
    sized = tx.where(F.col("amount").between(low, high) & allowed)
    return _with_tier(sized, tiers, "receiver_id").where("__tier = 'personal'").drop("__tier")


def funders(inflows: DataFrame) -> DataFrame:
    return inflows.groupBy(F.col("receiver_id").alias("account_id"), F.col("sender_id").alias("funder")).agg(
        F.count("*").alias("transfers"), F.sum("amount").alias("amount"))


def funded_accounts(funder_rows: DataFrame, min_inflows: int = 3, min_total: float = 50000.0, max_funders: int = 6) -> DataFrame:
    """Accounts with enough informal money from few enough funders."""
    gate = funder_rows.groupBy("account_id").agg(
        F.sum("transfers").alias("inflow_count"), F.sum("amount").alias("inflow_total"), F.count("*").alias("funder_count"))
    return gate.where((F.col("inflow_count") >= min_inflows) & (F.col("inflow_total") >= min_total)
                      & (F.col("funder_count") <= max_funders))


def funding_cycles(inflows: DataFrame, gated: DataFrame, gap: int = 3 * fixed.DAY) -> DataFrame:
    """Funding split where nothing arrives for ``gap`` seconds or more: (account_id, cycle, start_t, end_t).

    Inflows are first combined into bins no wider than the gap, which cannot contain a break, so the
    scan per account covers bins and not transfers.
    """
    width = max(1, min(gap, fixed.DAY))
    bins = (
        inflows.select(F.col("receiver_id").alias("account_id"), "t").join(gated.select("account_id"), "account_id", "left_semi")
        .groupBy("account_id", bucket("t", width).alias("bin")).agg(F.min("t").alias("a"), F.max("t").alias("b"))
    )
    w = Window.partitionBy("account_id").orderBy("bin")
    fresh = F.when(F.col("a") - F.lag("b").over(w) >= gap, 1).otherwise(0)
    numbered = bins.withColumn("fresh", fresh).withColumn("cycle", F.sum("fresh").over(w))
    return numbered.groupBy("account_id", "cycle").agg(F.min("a").alias("start_t"), F.max("b").alias("end_t"))


def cycle_payouts(cycles: DataFrame, payout_rows: DataFrame, funder_rows: DataFrame, window: int = fixed.DAY) -> DataFrame:
    """Payouts from the start of a cycle to ``window`` after its last inflow, funders left out."""
    paid = payout_rows.select(F.col("sender_id").alias("account_id"), F.col("receiver_id").alias("beneficiary"), "amount", "t")
    return (
        paid.join(cycles, "account_id").where((F.col("t") >= F.col("start_t")) & (F.col("t") <= F.col("end_t") + window))
        .join(funder_rows.select("account_id", F.col("funder").alias("beneficiary")), ["account_id", "beneficiary"], "left_anti")
        .withColumn("delay_hours", (F.col("t") - F.col("start_t")) / 3600.0)
    )


def hundi_operators(gated: DataFrame, cycle_rows: DataFrame, min_beneficiaries: int = 5, min_ratio: float = 0.6,
                    min_cycles: int = 2, min_repeat: float = 0.4) -> DataFrame:
    """Accounts that keep paying informal money out to the same beneficiaries."""
    per_cycle = cycle_rows.groupBy("account_id", "beneficiary", "cycle").agg(F.sum("amount").alias("paid"))
    per_beneficiary = per_cycle.groupBy("account_id", "beneficiary").agg(
        F.count("*").alias("times"), F.sum("paid").alias("paid"))
    spread = per_beneficiary.groupBy("account_id").agg(
        F.count("*").alias("beneficiary_count"), F.sum("paid").alias("payout_total"),
        F.count_if(F.col("times") >= 2).alias("repeated"))
    used = per_cycle.select("account_id", "cycle").distinct().groupBy("account_id").agg(F.count("*").alias("cycles"))
    delay = cycle_rows.groupBy("account_id").agg(F.percentile("delay_hours", 0.5).alias("delay"))
    repeat = F.col("repeated") / F.col("beneficiary_count")
    return (
        gated.join(spread, "account_id").join(used, "account_id").join(delay, "account_id")
        .where((F.col("beneficiary_count") >= min_beneficiaries)
               & (dbl("payout_total") >= min_ratio * dbl("inflow_total"))
               & (F.col("cycles") >= min_cycles) & (repeat >= min_repeat))
        .select(
            "account_id", F.col("inflow_count").alias("informal_inflow_count"),
            F.round(dbl("inflow_total"), 2).alias("informal_inflow_total"), "funder_count", "beneficiary_count",
            F.round(dbl("payout_total"), 2).alias("payout_total"),
            F.round(dbl("payout_total") / dbl("inflow_total"), 3).alias("payout_ratio"), "cycles",
            F.round(repeat, 3).alias("repeat_beneficiary_share"),
            F.round("delay", 2).alias("median_payout_delay_hours"))
    )


def hundi_funders(operators: DataFrame, funder_rows: DataFrame) -> DataFrame:
    """Every funder of an operator with its transfers."""
    return funder_rows.join(operators.select("account_id"), "account_id", "left_semi").select(
        F.col("funder").alias("account_id"), F.col("account_id").alias("operator"), "transfers",
        F.round(dbl("amount"), 2).alias("amount"))


def hundi_funding(tx: DataFrame, tiers: DataFrame, gate: dict | None = None, gap: int = 3 * fixed.DAY) -> dict[str, DataFrame]:
    """The funding side of the detector: funder rows, gated accounts and their funding cycles."""
    inflows = informal_inflows(tx, tiers)
    funder_rows = funders(inflows)
    gated = funded_accounts(funder_rows, **(gate or {}))
    return {"funder_rows": funder_rows, "gated": gated, "cycles": funding_cycles(inflows, gated, gap)}


def hundi(tx: DataFrame, tiers: DataFrame, gate: dict | None = None, gap: int = 3 * fixed.DAY, rule: dict | None = None) -> dict[str, DataFrame]:
    """The whole detector: operators, funders, funder rows and cycle payouts.

    Gated accounts, payouts and operators are written: everything meets on the account, so in one plan the joins and all
    aggregations over the payouts would hold their memory in the same tasks, and be computed once per reader.
    """
    found = hundi_funding(tx, tiers, gate, gap)
    funder_rows, gated = found["funder_rows"], tabled(found["gated"])
    paid = tabled(cycle_payouts(tabled(found["cycles"]), payouts(tx, tiers), funder_rows))
    operators = tabled(hundi_operators(gated, paid, **(rule or {})))
    return found | {"operators": operators, "funders": hundi_funders(operators, funder_rows), "payouts": paid, "gated": gated}


def context_flags(alerts: DataFrame, collectors: DataFrame, operators: DataFrame, operator_funders: DataFrame) -> DataFrame:
    """Flag rows of the four context patterns. Beneficiaries are never flagged."""
    from .detectors import flags

    return flags({"location_anomaly": alerts, "takeover_collector": collectors,
                  "hundi_operator": operators, "hundi_funder": operator_funders})
