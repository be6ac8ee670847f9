"""Evidence, case briefings and the tables a dashboard or an analyst reads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.exprs import dbl, postings, thousands
from .scoring import _has, account_patterns

# Detail columns per pattern, with their types. Each detail table holds account_id and these columns.
DETAILS = {
    "circular_flow": {"loop_length": "int", "loop_path": "array<string>", "loop_seconds": "double", "loop_retained": "double"},
    "rapid_movement": {"rapid_latency": "double", "rapid_forwards": "bigint", "rapid_destinations": "bigint"},
    "fan_in": {"fan_in_burst": "bigint"},
    "fan_out": {"fan_out_burst": "bigint"},
    "structuring": {"near_role": "string", "near_count": "bigint", "near_total": "double", "near_limit": "double"},
    "coordinated_network": {"cluster_size": "bigint", "cluster_density": "double"},
    "location_anomaly": {"risk_area": "string", "usual_areas": "array<string>", "outflow_24h": "double", "signals": "array<string>"},
    "takeover_collector": {"collected": "double", "victim_count": "bigint", "risk_areas": "array<string>"},
    "hundi_operator": {"op_inflows": "bigint", "op_total": "double", "op_funders": "bigint", "op_beneficiaries": "bigint",
                       "op_cycles": "bigint", "op_repeat": "double"},
    "hundi_funder": {"fund_operator": "string", "fund_transfers": "bigint", "fund_amount": "double"},
}


def loop_details(loops: DataFrame) -> DataFrame:
    """The earliest loop of each account on one. Needs nodes, length, loop_duration_seconds,
    amount_retained_ratio and t."""
    pick = F.min(F.struct("t", "nodes", "length", "loop_duration_seconds", "amount_retained_ratio"))
    return loops.select("*", F.explode("nodes").alias("account_id")).groupBy("account_id").agg(pick.alias("p")).select(
        "account_id", F.col("p.length").alias("loop_length"),
        F.concat("p.nodes", F.slice("p.nodes", 1, 1)).alias("loop_path"),
        dbl("p.loop_duration_seconds").alias("loop_seconds"), F.col("p.amount_retained_ratio").alias("loop_retained"))


def structuring_details(found: DataFrame) -> DataFrame:
    """One structuring record per account; the sending role comes first."""
    pick = F.min(F.struct(F.when(F.col("role") == "splitter", 0).otherwise(1).alias("o"), "role", "near_threshold_count",
                          "total_amount", "reporting_threshold"))
    return found.groupBy("account_id").agg(pick.alias("p")).select(
        "account_id", F.col("p.role").alias("near_role"), F.col("p.near_threshold_count").alias("near_count"),
        F.col("p.total_amount").alias("near_total"), F.col("p.reporting_threshold").alias("near_limit"))


def rapid_details(found: DataFrame) -> DataFrame:
    return found.select("account_id", dbl("fastest_latency_seconds").alias("rapid_latency"),
                        F.col("forwards").alias("rapid_forwards"), F.col("destinations").alias("rapid_destinations"))


def takeover_details(alerts: DataFrame) -> DataFrame:
    pick = F.min(F.struct("first_seen", "risk_area", "usual_areas", "outflow_24h", "signals"))
    return alerts.groupBy("account_id").agg(pick.alias("p")).select(
        "account_id", "p.risk_area", "p.usual_areas", "p.outflow_24h", "p.signals")


def collector_details(found: DataFrame) -> DataFrame:
    return found.select("account_id", F.col("amount_collected").alias("collected"), "victim_count", "risk_areas")


def operator_details(found: DataFrame) -> DataFrame:
    return found.select(
        "account_id", F.col("informal_inflow_count").alias("op_inflows"), F.col("informal_inflow_total").alias("op_total"),
        F.col("funder_count").alias("op_funders"), F.col("beneficiary_count").alias("op_beneficiaries"),
        F.col("cycles").alias("op_cycles"), F.col("repeat_beneficiary_share").alias("op_repeat"))


def funder_details(found: DataFrame) -> DataFrame:
    """One operator per funder: the first by id."""
    pick = F.min(F.struct("operator", "transfers", "amount"))
    return found.groupBy("account_id").agg(pick.alias("p")).select(
        "account_id", F.col("p.operator").alias("fund_operator"), F.col("p.transfers").alias("fund_transfers"),
        F.col("p.amount").alias("fund_amount"))


def attach_details(rows: DataFrame, details: dict[str, DataFrame]) -> DataFrame:
    """Left-joins the detail tables at hand; columns of the others are null."""
    for pattern, columns in DETAILS.items():
        if pattern in details:
            rows = rows.join(details[pattern].select("account_id", *columns), "account_id", "left")
        else:
            rows = rows.select("*", *[F.lit(None).cast(kind).alias(name) for name, kind in columns.items()])
    return rows


# --------------------------------------------------------------------------------------- text parts
def _whole(x: Column) -> Column:
    return F.bround(x.cast("double"), 0).cast("bigint").cast("string")


def _one(x: Column) -> Column:
    return F.bround(x.cast("double"), 1).cast("string")


def _text(*parts) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def _bdt(x: Column) -> Column:
    return _text("BDT ", thousands(F.coalesce(x.cast("double"), F.lit(0.0))))


def _general(x: Column) -> Column:
    """Six significant digits without trailing zeros."""
    digits = F.when(x == 0, F.lit(0)).otherwise(F.floor(F.log10(F.abs(x))).cast("int"))
    small = F.regexp_replace(F.regexp_replace(F.format_string("%.6f", x), r"0+$", ""), r"\.$", "")
    mid = F.regexp_replace(F.regexp_replace(F.format_string("%.2f", x), r"0+$", ""), r"\.$", "")
    big = F.regexp_replace(F.format_string("%.5e", x), r"\.?0+e", "e")
    return F.when(F.abs(x) >= 1e6, big).when(digits >= 3, mid).otherwise(small)


def _when_latency() -> Column:
    return F.when(F.col("rapid_latency") < 60, F.lit("under a minute")).otherwise(
        _text(_whole(F.col("rapid_latency") / 60), " minutes"))


def evidence() -> Column:
    """Evidence sentences of one account, in their fixed order; only measured facts."""
    c = F.col
    chain, ratio = c("chain_length"), c("incoming_outgoing_ratio")
    loop = F.when(
        c("loop_seconds").isNotNull(),
        _text("Circular flow pattern detected: funds travelled a ", c("loop_length"), "-account loop (",
              F.concat_ws(" -> ", "loop_path"), ") and returned in ", _whole(c("loop_seconds") / 60), " minutes with ",
              _whole(c("loop_retained") * 100), "% of the value."),
    ).otherwise(_text("Circular flow pattern detected: account participates in ", c("cycle_count"), " directed cycle(s)."))
    rapid = F.when(
        c("rapid_latency").isNotNull(), _text("Rapid fund movement detected: funds forwarded within ", _when_latency(), " of receipt.")
    ).otherwise(F.lit("Rapid fund movement detected: funds forwarded shortly after receipt."))
    near = F.when(
        (c("near_count") > 0) & (c("near_limit") > 0),
        _text("Structuring detected: ", F.when(c("near_role") == "splitter", "sent").otherwise("received"), " ", c("near_count"),
              " transactions just under the ", thousands(c("near_limit")), " threshold (total ", thousands(c("near_total")),
              ") within 24 hours."),
    ).otherwise(F.lit("Structuring detected: repeated transactions kept just under the monitoring threshold."))
    usual = F.coalesce(F.nullif(F.array_join("usual_areas", ", "), F.lit("")), F.lit("elsewhere"))
    other_signals = F.coalesce(F.nullif(F.array_join(F.slice("signals", 2, 10), "; "), F.lit("")), F.lit("unusual for this customer"))
    takeover = _text(
        "Possible account takeover: the wallet normally transacts from ", usual, " but suddenly moved BDT ",
        thousands(c("outflow_24h")), " in 24 hours from risk area ", c("risk_area"), " (", other_signals,
        "). Protective alert: confirm with the customer.")
    collector = _text("Takeover collector: received BDT ", thousands(c("collected")), " from ", c("victim_count"),
                      " wallets during suspected account takeovers in ", F.array_join("risk_areas", ", "), ".")
    operator = _text(
        "Hundi-style payout: ", c("op_inflows"), " large informal transfers (BDT ", thousands(c("op_total")), ") from ",
        c("op_funders"), " funder(s) were paid out to ", c("op_beneficiaries"), " beneficiaries over ", c("op_cycles"), " cycles; ",
        _whole(100 * c("op_repeat")), "% of beneficiaries were paid in more than one cycle. "
        "No licensed inward-remittance or distributor funding is involved.")
    funder = _text("Hundi funder: sent ", c("fund_transfers"), " large transfers (BDT ", thousands(c("fund_amount")),
                   ") to suspected hundi operator ", c("fund_operator"), ".")
    found = F.array_compact(F.array(
        F.when(_has("circular_flow"), loop),
        F.when(_has("rapid_movement"), rapid),
        F.when(_has("fan_in"), _text("Fan-in pattern detected: received funds from ", c("in_degree"),
                                     " distinct senders with only ", c("out_degree"), " outgoing counterparties.")),
        F.when(_has("fan_out"), _text("Fan-out pattern detected: dispersed funds to ", c("out_degree"),
                                      " distinct receivers from ", c("in_degree"), " incoming source(s).")),
        F.when(_has("structuring"), near),
        F.when(_has("location_anomaly"), takeover),
        F.when(_has("takeover_collector"), collector),
        F.when(_has("hundi_operator"), operator),
        F.when(_has("hundi_funder"), funder),
        F.when(_has("coordinated_network"),
               F.lit("Coordinated network membership: account is part of a densely interconnected transaction cluster.")),
        F.when(chain >= 3, _text("Transaction chain detected: participates in a multi-hop path spanning ", chain, " hops.")),
        F.when(c("transaction_velocity") >= 10.0,
               _text("High transaction velocity: ", _one(c("transaction_velocity")), " transactions per hour.")),
        F.when(ratio >= 8.0, _text("Severe fund imbalance: incoming funds exceed outgoing by ", _one(ratio), "x.")).when(
            (ratio <= 0.15) & (c("total_outgoing") > 0),
            F.lit("Severe fund depletion: outgoing funds heavily outweigh incoming receipts.")),
        F.when(c("suspicious_neighbor_count") >= 2,
               _text("High network exposure: directly connected to ", c("suspicious_neighbor_count"), " accounts with flagged patterns.")),
        F.when((c("passthrough_ratio") >= 0.85) & (c("total_incoming") > 1000),
               _text("High layering passthrough ratio: ", _one(c("passthrough_ratio") * 100), "% of incoming funds forwarded onward.")),
        F.when((c("transaction_count") >= 4) & (c("counterparty_diversity") <= 0.40),
               _text("High counterparty concentration: transactions restricted to only ", c("unique_counterparties"), " counterparty(s).")),
        F.when(c("is_anomaly"),
               _text("Statistical multivariate anomaly flagged by Isolation Forest (anomaly score: ", c("ml_component"), "/100).")),
    ))
    normal = F.array(F.lit("Normal transactional behavior: no anomalous patterns or metric deviations detected."))
    return F.when(F.size(found) > 0, found).otherwise(normal)


def with_classifier_sentence(rows: DataFrame, threshold: float, driver_rows: DataFrame) -> DataFrame:
    """Puts the classifier's sentence first for accounts at or above its threshold; a lone "normal"
    sentence gives way to it. ``driver_rows`` is the output of ``models.drivers``."""
    part = _text(F.col("label"), " = ", _general(F.col("value")), " (typical ", _general(F.col("typical")), ")")
    why = driver_rows.groupBy("account_id").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", part.alias("s")))), lambda x: x["s"]), "; ").alias("why"))
    rows = rows.join(why, "account_id", "left")
    sentence = _text("Trained classifier rates this account ", _whole(F.col("supervised_probability") * 100),
                     "% similar to known laundering typologies")
    full = F.when(F.col("why").isNotNull(), _text(sentence, ". Main drivers: ", F.col("why"), ".")).otherwise(_text(sentence, "."))
    kept = F.filter("evidence", lambda e: ~e.startswith("Normal transactional behavior"))
    fires = F.coalesce(F.col("supervised_probability") >= threshold, F.lit(False))
    return rows.withColumn("evidence", F.when(fires, F.concat(F.array(full), kept)).otherwise(F.col("evidence"))).drop("why")


# ----------------------------------------------------------------------------------------- briefing
def _typology(field: int) -> Column:
    out = None
    for rule in fixed.TYPOLOGIES:
        fits = F.size(F.array_except(F.array(*[F.lit(p) for p in rule[0]]), "patterns")) == 0
        out = F.when(fits, F.lit(rule[field])) if out is None else out.when(fits, F.lit(rule[field]))
    return out.otherwise(F.lit(fixed.NO_TYPOLOGY[field - 1]))


def typology() -> Column:
    """Name of the first rule whose patterns the account has."""
    return _typology(1)


def _degree_sentence(prefix: str, degree: str, burst: str) -> Column:
    base = _text(prefix, " ", F.col(degree), " different wallets")
    b = F.coalesce(F.col(burst), F.lit(0))
    return (F.when(b == 0, _text(base, ".")).when(b >= F.col(degree), _text(base, ", all within two hours."))
            .otherwise(_text(base, ", ", b, " of them within two hours.")))


def key_findings() -> Column:
    c = F.col
    forwards = F.when(c("rapid_forwards") == 1, F.lit("once")).otherwise(_text(c("rapid_forwards"), " times"))
    return F.array_compact(F.array(
        F.when(_has("structuring"), _text(
            F.when(c("near_role") == "splitter", "Sent").otherwise("Received"), " ", F.coalesce(c("near_count").cast("string"), F.lit("several")),
            " transfers just under ", _bdt(F.coalesce("near_limit", F.lit(10000.0))), ", totalling ", _bdt(c("near_total")), " within 24 hours.")),
        F.when(_has("fan_in"), _degree_sentence("Received money from", "in_degree", "fan_in_burst")),
        F.when(_has("fan_out"), _degree_sentence("Sent money to", "out_degree", "fan_out_burst")),
        F.when(_has("rapid_movement"), _text(
            "Passed received money straight on ", forwards, " (to ", c("rapid_destinations"), " wallet",
            F.when(c("rapid_destinations") != 1, "s").otherwise(""), "), the fastest within ", _when_latency(), " of receipt.")),
        F.when(_has("circular_flow") & c("loop_path").isNotNull(), _text(
            "Money went around the loop ", F.concat_ws(" -> ", "loop_path"), " in ", _whole(c("loop_seconds") / 60), " minutes and ",
            _whole(c("loop_retained") * 100), "% of it came back.")),
        F.when(_has("transaction_chain") & (c("chain_length") > 0),
               _text("Part of a transfer chain spanning ", c("chain_length"), " hops.")),
        F.when(_has("coordinated_network"), _text(
            "Member of a closed cluster of ", F.coalesce(c("cluster_size").cast("string"), F.lit("several")),
            " wallets with internal density ", F.coalesce(c("cluster_density").cast("string"), F.lit("high")), ".")),
        F.when((c("passthrough_ratio") >= 0.85) & (c("total_incoming") > 1000),
               _text("Passed on ", _whole(c("passthrough_ratio") * 100), "% of everything it received, keeping almost nothing.")),
        F.when(c("is_anomaly"), _text(
            "The Isolation Forest model ranks its overall behaviour as a statistical outlier (ML score ", _whole(c("ml_component")), "/100).")),
    ))


def related_accounts(members: dict[str, DataFrame], limit: int = fixed.MAX_RELATED) -> DataFrame:
    """The first distinct accounts linked by an account's patterns: (account_id, related).

    ``members`` maps a pattern to (account_id, member). Order: pattern, then member id. Only the first
    ``limit`` per account are ever collected; the row-number filter is applied before the shuffle.
    """
    rows = None
    for rank, pattern in enumerate(fixed.PATTERN_ORDER):
        if pattern in members:
            part = members[pattern].where("account_id <> member").select("account_id", "member", F.lit(rank).alias("rank"))
            rows = part if rows is None else rows.unionByName(part)
    first = rows.groupBy("account_id", "member").agg(F.min("rank").alias("rank"))
    w = Window.partitionBy("account_id").orderBy("rank", "member")
    top = first.withColumn("n", F.row_number().over(w)).where(F.col("n") <= limit)
    return top.groupBy("account_id").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("n", "member"))), lambda x: x["member"]).alias("related"))


def next_steps() -> Column:
    """At most five checks in priority order, then linked cases and the closing step of the level."""
    none = F.array().cast("array<string>")
    checks = F.flatten(F.array(*[
        F.when(_has(pattern), F.array(*[F.lit(s) for s in steps])).otherwise(none) for pattern, steps in fixed.NEXT_STEPS]))
    related = F.coalesce("related", none)
    linked = _text("Open linked cases for ", F.array_join(F.slice(related, 1, 4), ", "),
                   F.when(F.size(related) > 4, " and others").otherwise(""), " in the network view.")
    level = F.col("risk_level")
    closing = F.when(level == "CRITICAL", fixed.CLOSING_STEPS["CRITICAL"]).when(level == "HIGH", fixed.CLOSING_STEPS["HIGH"]).when(
        level == "MEDIUM", fixed.CLOSING_STEPS["MEDIUM"]).otherwise(fixed.CLOSING_STEPS["LOW"])
    tail = F.array_compact(F.array(F.when((F.size(related) > 0) & (level != "LOW"), linked), closing))
    return F.concat(F.slice(F.array_distinct(checks), 1, fixed.MAX_STEPS), tail)


def headline() -> Column:
    return F.when(F.size("patterns") > 0, _text(typology(), ": ", F.col("account_id"))).otherwise(
        _text("Routine activity: ", F.col("account_id")))


def summary_text() -> Column:
    c = F.col
    labels = F.create_map(*[F.lit(x) for pair in fixed.PATTERN_LABELS.items() for x in pair])
    names = F.array_join(F.transform("patterns", lambda p: F.coalesce(labels[p], p)), ", ")
    start = _text(c("account_id"), " scores ", F.format_string("%.1f", c("risk_score")), "/100 (", c("risk_level"), "). ")
    with_patterns = _text(
        start, "It ", _typology(2), ". Detected patterns: ", names, ". Received ", _bdt(c("total_incoming")), " and sent ",
        _bdt(c("total_outgoing")), " across ", c("transaction_count"), " transactions.")
    without = _text(start, "No network pattern was detected; ", c("transaction_count"), " transactions look like ordinary activity.",
                    F.when(c("is_anomaly"), " The ML model still ranks it as an outlier, so a quick manual look is worthwhile.").otherwise(""))
    return F.when(F.size("patterns") > 0, with_patterns).otherwise(without)


def briefed(rows: DataFrame) -> DataFrame:
    """Adds evidence, typology, findings, steps and texts. ``rows`` needs the scored feature vector,
    the detail columns and ``related``."""
    return rows.select(
        "*", evidence().alias("evidence"), typology().alias("typology"), key_findings().alias("key_findings"),
        next_steps().alias("next_steps"), headline().alias("headline"), summary_text().alias("summary"))


# ------------------------------------------------------------------------------------ display tables
def node_table(reports: DataFrame, degree: DataFrame) -> DataFrame:
    """Accounts as drawn in the network view; unscored accounts count as LOW with a score of 15."""
    none = F.array().cast("array<string>")
    return degree.select("account_id", "in_degree", "out_degree").join(reports.drop("in_degree", "out_degree"), "account_id", "left").select(
        "account_id", F.round(F.coalesce("risk_score", F.lit(15.0)), 2).alias("risk_score"),
        F.coalesce("risk_level", F.lit("LOW")).alias("risk_level"),
        F.coalesce("patterns", none).alias("patterns"), (F.size(F.coalesce("patterns", none)) > 0).alias("has_patterns"),
        "in_degree", "out_degree", (F.col("in_degree") + F.col("out_degree")).alias("total_degree"),
        F.round(F.coalesce("weighted_in_degree", F.lit(0.0)), 2).alias("incoming_amount"),
        F.round(F.coalesce("weighted_out_degree", F.lit(0.0)), 2).alias("outgoing_amount"),
        F.round(F.coalesce("weighted_in_degree", F.lit(0.0)) - F.coalesce("weighted_out_degree", F.lit(0.0)), 2).alias("net_flow"),
        F.coalesce("transaction_count", F.col("in_degree") + F.col("out_degree")).alias("transaction_count"))


def catalog(df: DataFrame) -> DataFrame:
    return df.sparkSession.createDataFrame(list(fixed.PATTERN_CATALOG), "pattern string, title string, severity string")


def pattern_summary(flags: DataFrame) -> DataFrame:
    """Every catalogue pattern with its number of accounts and status."""
    counts = flags.distinct().groupBy("pattern").agg(F.count("*").alias("affected"))
    return catalog(flags).join(counts, "pattern", "left").select(
        "pattern", "title", "severity", F.coalesce("affected", F.lit(0)).alias("affected_accounts"),
        F.when(F.coalesce("affected", F.lit(0)) > 0, "Detected").otherwise("Clean").alias("status"))


def global_stats(tx: DataFrame, reports: DataFrame, multi_components: DataFrame, summary: DataFrame, network: DataFrame) -> DataFrame:
    """One row of totals for the dashboard header. ``network`` is the one row of ``graph.summary``."""
    level = F.col("risk_level")
    out = reports.agg(
        F.count("*").alias("total_accounts"), F.count_if(level.isin("HIGH", "CRITICAL")).alias("high_risk_accounts"),
        F.count_if(level == "MEDIUM").alias("medium_risk_accounts"),
        F.round(F.coalesce(F.avg("risk_score"), F.lit(0.0)), 1).alias("average_risk_score"))
    detected = summary.where("status = 'Detected'").select(F.count("*"))
    return (
        out.withColumn("total_transactions", tx.select(F.count("*")).scalar())
        .withColumn("active_detection_patterns", detected.scalar())
        .withColumn("suspicious_networks", multi_components.scalar() + F.col("active_detection_patterns"))
        .withColumns({c: network.select(c).scalar() for c in (
            "density", "weakly_connected_components", "strongly_connected_components")})
    )


def volume_timeline(tx: DataFrame) -> DataFrame:
    """Volume and count per clock hour."""
    hour = F.date_format(F.timestamp_seconds("t"), "yyyy-MM-dd HH")
    return tx.groupBy(hour.alias("time")).agg(
        F.round(dbl(F.sum("amount")), 2).alias("volume"), F.count("*").alias("count"))


def risk_distribution(reports: DataFrame) -> DataFrame:
    levels = reports.sparkSession.createDataFrame([(x,) for x in fixed.LEVELS], "risk_level string")
    counts = reports.groupBy("risk_level").agg(F.count("*").alias("c"))
    return levels.join(counts, "risk_level", "left").select("risk_level", F.coalesce("c", F.lit(0)).alias("accounts"))


def top_accounts(reports: DataFrame, limit: int = 15) -> DataFrame:
    return reports.orderBy(F.desc("risk_score"), "account_id").limit(limit)


def search_accounts(reports: DataFrame, risk: str | None = None, pattern: str | None = None, search: str | None = None,
                    limit: int | None = None, exact: bool = False) -> DataFrame:
    """Filter by level, by part of a pattern name and by part of an id (or the id itself); riskiest first."""
    if risk:
        reports = reports.where(F.col("risk_level") == risk.upper())
    if pattern:
        reports = reports.where(F.exists("patterns", lambda p: F.lower(p).contains(pattern.lower())))
    if search:
        name = F.lower("account_id")
        reports = reports.where(name == search.lower() if exact else name.contains(search.lower()))
    reports = reports.orderBy(F.desc("risk_score"), "account_id")
    return reports if limit is None else reports.limit(limit)


def ledger(tx: DataFrame, search: str | None = None, sender: str | None = None, receiver: str | None = None,
           min_amount: float | None = None, page: int = 1, page_size: int = 15) -> DataFrame:
    """One page of transfers in time order."""
    if search:
        q = search.lower()
        tx = tx.where(F.lower("transaction_id").contains(q) | F.lower("sender_id").contains(q) | F.lower("receiver_id").contains(q))
    if sender:
        tx = tx.where(F.lower("sender_id") == sender.lower())
    if receiver:
        tx = tx.where(F.lower("receiver_id") == receiver.lower())
    if min_amount is not None:
        tx = tx.where(F.col("amount") >= min_amount)
    return tx.orderBy("t", "transaction_id").offset((page - 1) * page_size).limit(page_size)


def linked_transactions(tx: DataFrame, accounts: DataFrame | None = None, limit: int = 60) -> DataFrame:
    """The newest ``limit`` transfers touching each account, with direction and counterparty."""
    rows = postings(tx.select("transaction_id", "sender_id", "receiver_id", "amount", "t"))
    if accounts is not None:
        rows = rows.join(accounts.select("account_id"), "account_id", "left_semi")
    # The rank filter runs before the shuffle too, so a hot account sends ``limit`` rows per task.
    w = Window.partitionBy("account_id").orderBy(F.desc("t"), "transaction_id")
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit).select(
        "account_id", "rank", "transaction_id", "t", F.when(F.col("is_out"), "OUT").otherwise("IN").alias("direction"),
        "counterparty", "amount")


