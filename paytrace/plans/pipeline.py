"""The whole path from validated transfers to explained risk reports."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..operators import behaviour, context, detectors, flow, graph, models, report, scoring, store, topology
from ..sources.session import cut, tabled


@dataclass
class Network:
    """Everything measured on one transfer table. Heavy parts are materialised once."""

    tx: DataFrame
    pairs: DataFrame
    degree: DataFrame
    totals: DataFrame
    weak: DataFrame
    strong: DataFrame
    flags: DataFrame
    details: dict[str, DataFrame] = field(default_factory=dict)
    members: dict[str, DataFrame] = field(default_factory=dict)
    loops: DataFrame | None = None
    chain_lengths: DataFrame | None = None
    cycle_counts: DataFrame | None = None
    near_counts: DataFrame | None = None
    traced: dict[int, dict[str, DataFrame]] = field(default_factory=dict)


def trace_all(tx: DataFrame) -> dict[int, dict[str, DataFrame]]:
    """Both tracing passes with their paths, loops and account columns."""
    chain_paths = tabled(flow.paths(flow.trace(tx)))
    found = flow.loops(chain_paths)
    out = {}
    for window in (fixed.FAST_WINDOW, fixed.SLOW_WINDOW):
        mine, loops = chain_paths.where(F.col("window") == window), found.where(F.col("window") == window)
        out[window] = {"paths": mine, "loops": loops, "accounts": flow.accounts(mine, loops)}
    return out


def analyse(tx: DataFrame, tiers: DataFrame | None = None, risk_areas: DataFrame | None = None,
            temporal: bool = True) -> Network:
    """Graph, detectors and context detectors of one validated transfer table.

    Loops and chains come from flow tracing, whatever the size. ``temporal=False`` searches them
    exhaustively, which is meant for small networks.
    """
    tx = cut(tx)
    pairs = cut(graph.edge_pairs(tx))
    totals, degree = (cut(df) for df in behaviour.inputs(tx))
    weak, strong = topology.weak_components(pairs), topology.strong_components(pairs)
    traced = trace_all(tx)
    if temporal:
        fast, slow = traced[fixed.FAST_WINDOW], traced[fixed.SLOW_WINDOW]
        loops = cut(flow.distinct_loops(fast["loops"], slow["loops"]))
        circular = flow.circular_accounts(fast["accounts"], slow["accounts"])
        chained = flow.chain_accounts(fast["accounts"], slow["accounts"])
        chain_members = None
    else:
        loops = cut(detectors.circular_flows(tx, strong))
        circular = detectors.members_of(loops, "nodes")
        chains = cut(detectors.transaction_chains(pairs))
        chained = chains.select(F.explode("path").alias("account_id"), "hops").groupBy("account_id").agg(
            F.max("hops").alias("chain_length"))
        chain_members = chains
    fan_in, fan_out = cut(detectors.fan_in(tx, degree)), cut(detectors.fan_out(tx, degree))
    rapid = cut(detectors.rapid_payments(tx))
    rapid_accounts = detectors.rapid_movement(rapid)
    near = cut(detectors.structuring(tx))
    clusters = detectors.coordinated_networks(pairs, strong)
    cluster_members = detectors.coordinated_members(clusters, strong)
    found = {"fan_in": fan_in, "fan_out": fan_out, "circular_flow": circular, "transaction_chain": chained,
             "rapid_movement": rapid, "structuring": near, "coordinated_network": cluster_members}
    details = {
        "circular_flow": report.loop_details(loops),
        "rapid_movement": report.rapid_details(rapid_accounts),
        "fan_in": fan_in.select("account_id", F.col("burst").alias("fan_in_burst")),
        "fan_out": fan_out.select("account_id", F.col("burst").alias("fan_out_burst")),
        "structuring": report.structuring_details(near),
        "coordinated_network": cluster_members.select(
            "account_id", F.col("size").alias("cluster_size"), F.col("density").alias("cluster_density")),
    }
    members = {
        "fan_in": detectors.fan_members(fan_in, pairs, True),
        "fan_out": detectors.fan_members(fan_out, pairs, False),
        "circular_flow": loops.select("nodes", F.explode("nodes").alias("account_id")).select(
            "account_id", F.explode("nodes").alias("member")),
        "rapid_movement": detectors.rapid_members(tx),
        "structuring": detectors.structuring_members(near, tx).select("account_id", "member"),
        "coordinated_network": detectors.cluster_sample(cluster_members, fixed.MAX_RELATED + 1),
    }
    if chain_members is not None:
        members["transaction_chain"] = chain_members.select("path", F.explode("path").alias("account_id")).select(
            "account_id", F.explode("path").alias("member"))
    if "location" in tx.columns:
        known = tiers if tiers is not None else scoring.tiers(degree)
        if risk_areas is not None:
            alerts, payments = context.location_takeover(tx, risk_areas)
            collectors = cut(context.takeover_collectors(payments))
            found |= {"location_anomaly": alerts, "takeover_collector": collectors}
            details |= {"location_anomaly": report.takeover_details(alerts),
                        "takeover_collector": report.collector_details(collectors)}
            members |= {"location_anomaly": payments.select("account_id", F.col("receiver").alias("member")).distinct(),
                        "takeover_collector": context.takeover_victims(collectors, payments)}
        hundi = context.hundi(tx, known)
        operators = cut(hundi["operators"])
        op_funders = context.hundi_funders(operators, hundi["funder_rows"])
        found |= {"hundi_operator": operators, "hundi_funder": op_funders}
        details |= {"hundi_operator": report.operator_details(operators), "hundi_funder": report.funder_details(op_funders)}
        members["hundi_operator"] = hundi["payouts"].select("account_id", F.col("beneficiary").alias("member")).unionByName(
            hundi["funder_rows"].select("account_id", F.col("funder").alias("member"))).join(
            operators.select("account_id"), "account_id", "left_semi").distinct()
    return Network(
        tx=tx, pairs=pairs, degree=degree, totals=totals, weak=weak, strong=strong,
        flags=cut(detectors.flags(found)), details=details, members=members, loops=loops,
        chain_lengths=chained.select("account_id", "chain_length") if "chain_length" in chained.columns else chained,
        cycle_counts=loops.select(F.explode("nodes").alias("account_id")).groupBy("account_id").agg(
            F.count("*").alias("cycle_count")),
        near_counts=near.groupBy("account_id").agg(F.max("near_threshold_count").alias("near_threshold_tx_count")),
        traced=traced,
    )


def feature_vector(net: Network) -> DataFrame:
    """The 34-column vector for anomaly scoring."""
    behaviour_part = behaviour.behaviour_features(net.totals, net.degree)
    graph_part = behaviour.graph_features(
        net.degree, net.totals, net.weak, graph.undirected(net.pairs), net.flags, net.cycle_counts,
        net.chain_lengths, net.near_counts)
    return behaviour.feature_vector(behaviour_part, graph_part)


def feature_store(tx: DataFrame, tiers: DataFrame | None = None, traced=None, pairs: DataFrame | None = None,
                  strong: DataFrame | None = None) -> DataFrame:
    """The 83-column account feature store of a transfer table."""
    tx = tabled(store.clean(tx))
    pairs = tabled(graph.edge_pairs(tx)) if pairs is None else pairs
    both = tabled(graph.undirected(pairs))
    totals, degree = (tabled(df) for df in behaviour.inputs(tx))
    traced = trace_all(tx) if traced is None else traced
    strong = topology.strong_components(pairs) if strong is None else strong
    edge_table = graph.edges(tx)
    rows = store.transactional(totals, degree)
    base_degree = degree.select(
        "account_id", F.col("in_degree").cast("double").alias("in_degree"), F.col("out_degree").cast("double").alias("out_degree"),
        (F.col("in_degree") / (F.col("out_degree") + 1.0)).alias("degree_ratio"))
    parts = [
        store.temporal(tx, totals), base_degree, topology.reciprocity(degree), topology.pagerank(edge_table),
        strong.select("account_id", F.col("component_size").cast("double").alias("scc_size")),
        topology.triangles(pairs),
        topology.two_hop(pairs).withColumnRenamed("reach", "two_hop_out"),
        topology.two_hop(pairs, outward=False).withColumnRenamed("reach", "two_hop_in"),
        topology.neighbour_degree(both),
        store.flow_columns(traced[fixed.FAST_WINDOW]["accounts"], totals, "fast"),
        store.flow_columns(traced[fixed.SLOW_WINDOW]["accounts"], totals, "slow"),
        store.tier_flags(degree, scoring.tiers(degree, tiers)),
    ]
    for part in parts:
        rows = rows.join(part, "account_id", "left")
    rows = tabled(rows)
    return store.finalise(rows.join(store.neighbourhood(pairs, both, store.message_base(rows)), "account_id", "left"))


def score_path(tx: DataFrame, classifier: models.Classifier, tiers: DataFrame | None = None) -> DataFrame:
    """Feature store and classifier: (account_id, probability)."""
    return classifier.score(feature_store(tx, tiers)).select("account_id", "probability")


def recent_day(tx: DataFrame) -> DataFrame:
    """Transfers of the most recent UTC day: what a micro-batch re-scores."""
    last = tx.select(F.max("t")).scalar()
    return tx.where(F.floor(F.col("t") / fixed.DAY) == F.floor(last / fixed.DAY))


def run(tx: DataFrame, tiers: DataFrame | None = None, risk_areas: DataFrame | None = None, temporal: bool = True,
        classifier: models.Classifier | None = None, contamination: float = 0.1, trees: int = 150) -> tuple[DataFrame, Network]:
    """Validated transfers to risk reports, riskiest first.

    With a classifier the ML component becomes the stronger of anomaly score and probability, scores
    become tier-aware and every account above its threshold gets model drivers.
    """
    net = analyse(tx, tiers, risk_areas, temporal)
    vector = cut(feature_vector(net))
    forest = models.IsolationForest(fixed.VECTOR, trees=trees, contamination=contamination).fit(vector)
    raw = cut(forest.decision(vector))
    _, mad = scoring.spread(raw)
    rows = vector.join(scoring.calibrate(raw, mad), "account_id")
    known = scoring.tiers(vector, tiers)
    rows = rows.join(known.withColumnRenamed("tier", "account_tier"), "account_id")
    features = None
    if classifier is None:
        rows = rows.withColumn("supervised_probability", F.lit(None).cast("double"))
    else:
        features = cut(feature_store(net.tx, known, net.traced, net.pairs, net.strong))
        rows = rows.join(classifier.score(features, "supervised_probability").select("account_id", "supervised_probability"), "account_id", "left")
    patterns = scoring.account_patterns(net.flags)
    rows = rows.join(patterns, "account_id", "left").withColumn(
        "patterns", F.coalesce("patterns", F.array().cast("array<string>")))
    scored = scoring.composite(rows, scoring.baselines(vector), tier_aware=classifier is not None)
    scored = report.attach_details(scored, net.details).join(report.related_accounts(net.members), "account_id", "left")
    out = report.briefed(scored)
    if classifier is not None:
        flagged = rows.where(F.col("supervised_probability") >= classifier.threshold)
        drivers = cut(models.drivers(classifier, features, flagged))
        out = report.with_classifier_sentence(out, classifier.threshold, drivers)
    return scoring.risk_reports(out), net
