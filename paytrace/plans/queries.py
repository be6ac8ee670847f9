"""Registered queries: each reads the given tables and returns one operator's result.

A query name starts with the id of the operator it covers. Parameters that differ from the defaults
are loosened so that the sample data yields rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.exprs import dbl, postings
from ..operators import (
    behaviour, context, detectors, evaluate, flow, graph, models, report, scoring, store, topology, validate, workflow,
)
from ..sources import views
from ..sources.session import cut, new_folder, tabled
from ..streaming import stream
from . import pipeline
from .shared import once, rounded

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(name: str) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[name] = f
        return f

    return register


def columns_of(prefix: str, build: Query, parts: dict[str, tuple[str, ...]], key: str = "account_id") -> None:
    """One query per group of columns of a wide table; unused columns are pruned from each plan."""
    for name, names in parts.items():
        QUERIES[f"{prefix}{name}"] = lambda spark, folder, names=names: rounded(build(spark, folder).select(key, *names))


# ------------------------------------------------------------------------------- shared inputs
def ev(spark, folder):
    # written before the filter, which would read every event's properties a second time
    return once(spark, folder, "tx_events", lambda: tabled(views.tx_events_raw(spark, folder)).where("sender_id <> receiver_id").drop("row_index"))


def li(spark, folder):
    return views.tx_lineitem(spark, folder)


def li_kept(spark, folder):
    """The line-item transfers joined once, for queries that read them several times."""
    def build():
        path = new_folder(spark, "tx_lineitem")
        joined = li(spark, folder)
        joined.write.parquet(path)
        return spark.read.schema(joined.schema).parquet(path)

    return once(spark, folder, "tx_lineitem", build)


def dy(spark, folder):
    return once(spark, folder, "tx_daily", lambda: cut(views.tx_daily(spark, folder)))


def ev_pairs(spark, folder):
    return once(spark, folder, "ev_pairs", lambda: tabled(graph.edge_pairs(ev(spark, folder))))


def dy_pairs(spark, folder):
    return once(spark, folder, "dy_pairs", lambda: cut(graph.edge_pairs(dy(spark, folder))))


def ev_inputs(spark, folder):
    return once(spark, folder, "ev_inputs", lambda: tuple(tabled(df) for df in behaviour.inputs(ev(spark, folder))))


def dy_weak(spark, folder):
    return once(spark, folder, "dy_weak", lambda: cut(topology.weak_components(dy_pairs(spark, folder))))


def dy_strong(spark, folder):
    return once(spark, folder, "dy_strong", lambda: cut(topology.strong_components(dy_pairs(spark, folder))))


def ev_traced(spark, folder):
    return once(spark, folder, "ev_traced", lambda: pipeline.trace_all(ev(spark, folder)))


def ev_store(spark, folder):
    return once(spark, folder, "ev_store", lambda: tabled(
        pipeline.feature_store(ev(spark, folder), traced=ev_traced(spark, folder), pairs=ev_pairs(spark, folder))))


def checked(spark, folder):
    return validate.check(views.tx_raw(spark, folder))


# ------------------------------------------------------------------------- sources, validation
@query("io4_tiers")
def _(spark, folder):
    return scoring.tiers(graph.nodes(li(spark, folder)))


def _errors(prefix: str) -> Query:
    return lambda spark, folder: validate.quarantine(checked(spark, folder)).where(
        F.col("error").startswith(prefix)).select("row_index", "error")


QUERIES["val02_missing_fields"] = _errors("Missing")
QUERIES["val03_blank_ids"] = _errors("Invalid sender_id")
QUERIES["val04_self_transfers"] = _errors("Self-transfer")
QUERIES["val05_amount_format"] = _errors("Invalid amount format")
QUERIES["val06_amount_range"] = lambda spark, folder: validate.quarantine(checked(spark, folder)).where(
    F.col("error").rlike("^(Invalid amount: |Extreme)")).select("row_index", "error")
QUERIES["val08_duplicates"] = _errors("Duplicate")


@query("val07_times")
def _(spark, folder):
    bad = validate.quarantine(checked(spark, folder)).where("error LIKE 'Invalid timestamp%'")
    good = validate.valid(checked(spark, folder)).select("row_index", "t")
    return good.unionByName(bad.select("row_index", F.lit(-1).cast("bigint").alias("t")))


@query("val10_context")
def _(spark, folder):
    return validate.valid(checked(spark, folder)).select("row_index", *fixed.CONTEXT_FIELDS)


@query("val11_normalised")
def _(spark, folder):
    return validate.valid(checked(spark, folder)).select(
        "row_index", "transaction_id", "sender_id", "receiver_id", dbl("amount").alias("amount"), "timestamp").where(
        "transaction_id NOT RLIKE '^TX_[0-9A-F]{12,}$'")


@query("val12_summary")
def _(spark, folder):
    return validate.summary(checked(spark, folder))


# ------------------------------------------------------------------------------------- graph
@query("gr1_multigraph")
def _(spark, folder):
    return graph.multigraph(ev(spark, folder)).withColumn("amount", dbl("amount"))


@query("gr2_edges")
def _(spark, folder):
    return graph.edges(ev(spark, folder)).withColumn("weight", dbl("weight"))


@query("gr3_nodes")
def _(spark, folder):
    return graph.nodes(li(spark, folder))


@query("gr4_summary")
def _(spark, folder):
    return graph.summary(dy(spark, folder), dy_weak(spark, folder), dy_strong(spark, folder))


@query("gr5_weak_components")
def _(spark, folder):
    return dy_weak(spark, folder)


@query("gr6_strong_components")
def _(spark, folder):
    return dy_strong(spark, folder)


@query("gr7_multi_components")
def _(spark, folder):
    return topology.multi_account_components(dy_strong(spark, folder))


def _ego(spark, folder):
    pairs = dy_pairs(spark, folder)
    return graph.ego_nodes(pairs, graph.nodes(dy(spark, folder)), hops=2)


@query("gr8_ego_nodes")
def _(spark, folder):
    return _ego(spark, folder)


@query("gr8_ego_counts")
def _(spark, folder):
    members = _ego(spark, folder)
    return graph.ego_counts(members, graph.ego_edges(dy_pairs(spark, folder), members))


@query("gr11_pagerank")
def _(spark, folder):
    ranks = topology.pagerank(graph.edges(ev(spark, folder)))
    return ranks.withColumn("pagerank", F.round("pagerank", 4))


@query("gr12_two_hop")
def _(spark, folder):
    pairs = ev_pairs(spark, folder)
    out, inn = topology.two_hop(pairs), topology.two_hop(pairs, outward=False)
    both = out.withColumnRenamed("reach", "two_hop_out").join(inn.withColumnRenamed("reach", "two_hop_in"), "account_id", "full")
    return both.na.fill(0)


@query("gr13_triangles")
def _(spark, folder):
    return topology.triangles(ev_pairs(spark, folder))


@query("gr14_reciprocity")
def _(spark, folder):
    return rounded(topology.reciprocity(ev_inputs(spark, folder)[1]))


@query("gr15_neighbour_degree")
def _(spark, folder):
    return rounded(topology.neighbour_degree(graph.undirected(ev_pairs(spark, folder))))


def _message_base(spark, folder):
    tx, (totals, degree) = ev(spark, folder), ev_inputs(spark, folder)
    rows = store.transactional(totals, degree).join(store.pace(totals), "account_id").join(
        degree.select("account_id", "in_degree", "out_degree"), "account_id")
    slow = store.flow_columns(ev_traced(spark, folder)[fixed.SLOW_WINDOW]["accounts"], totals, "slow")
    return once(spark, folder, "message_base", lambda: tabled(store.message_base(rows.join(slow, "account_id"))))


@query("fs17_message_base")
def _(spark, folder):
    return rounded(_message_base(spark, folder))


def _neighbourhood(spark, folder):
    pairs = ev_pairs(spark, folder)
    return store.neighbourhood(pairs, graph.undirected(pairs), _message_base(spark, folder)).na.fill(0.0)


for _name, _prefix in (("gr16_payer_means", "nb_in_"), ("gr16_payee_means", "nb_out_"), ("gr16_two_step_means", "nb2_")):
    QUERIES[_name] = lambda spark, folder, p=_prefix: rounded(_neighbourhood(spark, folder).select(
        "account_id", *[f"{p}{c}" for c in fixed.MESSAGE_BASE]))
QUERIES["fs18_neighbourhood"] = lambda spark, folder: rounded(_neighbourhood(spark, folder))


# --------------------------------------------------------------------------------- detectors
@query("pt0_burst_payers")
def _(spark, folder):
    tx = ev(spark, folder)
    return detectors.max_distinct_in_window(tx.select(
        F.col("receiver_id").alias("account_id"), F.col("sender_id").alias("counterparty"), "t"))


@query("pt0_burst_payees")
def _(spark, folder):
    tx = ev(spark, folder)
    return detectors.max_distinct_in_window(tx.select(
        F.col("sender_id").alias("account_id"), F.col("receiver_id").alias("counterparty"), "t"))


def _li_fan(inward: bool) -> Query:
    def run(spark, folder):
        tx = li_kept(spark, folder)
        find = detectors.fan_in if inward else detectors.fan_out
        return find(tx, graph.degrees(graph.account_pairs(tx)), min_ratio=1.0, window=7 * fixed.DAY)

    return run


QUERIES["pt1_fan_in"] = lambda spark, folder: detectors.fan_in(
    ev(spark, folder), ev_inputs(spark, folder)[1], min_ratio=1.05)
QUERIES["pt2_fan_out"] = lambda spark, folder: detectors.fan_out(
    ev(spark, folder), ev_inputs(spark, folder)[1], min_ratio=1.05)
QUERIES["pt1_fan_in_weekly"] = _li_fan(True)
QUERIES["pt2_fan_out_weekly"] = _li_fan(False)


@query("pt1_fan_in_members")
def _(spark, folder):
    found = detectors.fan_in(ev(spark, folder), ev_inputs(spark, folder)[1], min_ratio=1.05)
    return detectors.fan_members(found, ev_pairs(spark, folder), True)


def _loops(spark, folder):
    return detectors.circular_flows(ev(spark, folder))


@query("pt3_circular_flow")
def _(spark, folder):
    return _loops(spark, folder).select(F.array_join("nodes", ">").alias("nodes"), "length", "instances")


@query("pt3d_loop_details")
def _(spark, folder):
    return _loops(spark, folder).select(
        F.array_join("nodes", ">").alias("nodes"), "t", "loop_duration_seconds", "amount_retained_ratio",
        F.array_join(F.transform("hops", lambda h: h["transaction_id"]), ">").alias("hops"))


@query("pt4_transaction_chains")
def _(spark, folder):
    return detectors.transaction_chains(dy_pairs(spark, folder)).select(
        F.array_join("path", ">").alias("path"), "hops", "start", "end")


@query("pt5_rapid_movement")
def _(spark, folder):
    return detectors.rapid_movement(detectors.rapid_payments(ev(spark, folder)))


@query("pt5_rapid_payments")
def _(spark, folder):
    return detectors.rapid_payments(ev(spark, folder)).select("account_id", "payment_id", "latency", "matches")


@query("pt6_structuring")
def _(spark, folder):
    return detectors.structuring(ev(spark, folder))


@query("pt6_structuring_members")
def _(spark, folder):
    tx = ev(spark, folder)
    return detectors.structuring_members(detectors.structuring(tx), tx)


@query("pt7_coordinated_networks")
def _(spark, folder):
    return detectors.coordinated_networks(dy_pairs(spark, folder), dy_strong(spark, folder))


@query("pt8_traced_loops")
def _(spark, folder):
    traced = ev_traced(spark, folder)
    return flow.distinct_loops(traced[fixed.FAST_WINDOW]["loops"], traced[fixed.SLOW_WINDOW]["loops"]).withColumn(
        "nodes", F.array_join("nodes", ">"))


@query("pt9_traced_chains")
def _(spark, folder):
    traced = ev_traced(spark, folder)
    return flow.chain_accounts(traced[fixed.FAST_WINDOW]["accounts"], traced[fixed.SLOW_WINDOW]["accounts"])


@query("pt11_flags_exhaustive")
def _(spark, folder):
    tx, pairs, strong = dy(spark, folder), dy_pairs(spark, folder), dy_strong(spark, folder)
    loops = detectors.circular_flows(tx, strong, window=fixed.DAY)
    chains = detectors.transaction_chains(pairs)
    return detectors.network_flags(
        tx, graph.degrees(graph.account_pairs(tx)), pairs, strong,
        detectors.members_of(loops, "nodes"), detectors.members_of(chains, "path"))


@query("pt11_flags_traced")
def _(spark, folder):
    traced = ev_traced(spark, folder)
    fast, slow = traced[fixed.FAST_WINDOW]["accounts"], traced[fixed.SLOW_WINDOW]["accounts"]
    pairs = ev_pairs(spark, folder)
    strong = once(spark, folder, "ev_strong", lambda: cut(topology.strong_components(pairs)))
    return detectors.network_flags(ev(spark, folder), ev_inputs(spark, folder)[1], pairs, strong,
                                   flow.circular_accounts(fast, slow), flow.chain_accounts(fast, slow))


# ------------------------------------------------------------------------------- flow tracing
def _links(window: int) -> Query:
    return lambda spark, folder: detectors.funded_payments(ev(spark, folder), window, strict=True).select(
        "payment_id", F.col("matches").alias("receipts"), F.col("latency").alias("newest"), F.col("longest").alias("oldest"))


QUERIES["fl1_candidate_links_fast"] = _links(fixed.FAST_WINDOW)
QUERIES["fl1_candidate_links_slow"] = _links(fixed.SLOW_WINDOW)


@query("fl2_funding")
def _(spark, folder):
    traced = ev_traced(spark, folder)
    both = traced[fixed.FAST_WINDOW]["paths"].unionByName(traced[fixed.SLOW_WINDOW]["paths"])
    return both.select("window", "tx", "funded_by", "depth", "wait")


def _both_windows(spark: SparkSession, folder: str, part: str, change: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """One traced table of the fast and the slow window, told apart by ``window``."""
    traced = ev_traced(spark, folder)
    tables = [change(traced[w][part]).withColumn("window", F.lit(w)) for w in (fixed.FAST_WINDOW, fixed.SLOW_WINDOW)]
    return tables[0].unionByName(tables[1])


@query("fl3_paths")
def _(spark, folder):
    return _both_windows(spark, folder, "paths", lambda df: df.select("tx", "depth", F.array_join("members", ">").alias("path")))


def _flow_accounts(*names: str) -> Query:
    return lambda spark, folder: rounded(_both_windows(spark, folder, "accounts", lambda df: df.select("account_id", *names)))


QUERIES["fl4_chain_length"] = _flow_accounts("chain_length")
QUERIES["fl5_loop_counts"] = _flow_accounts("cycle_count")
QUERIES["fl6_forwards"] = _flow_accounts("forward_count", "forwarded_amount")
QUERIES["fl7_dwell"] = _flow_accounts("dwell_mean")


@query("fl5_loops")
def _(spark, folder):
    return _both_windows(spark, folder, "loops", lambda df: df.withColumn("nodes", F.array_join("nodes", ">")))


@query("fl8_chain_details")
def _(spark, folder):
    return _both_windows(spark, folder, "paths", lambda df: flow.chain_details(df).withColumn(
        "chain_path", F.array_join("chain_path", ">")))


# ---------------------------------------------------------------------------- context detectors
def _takeover(spark, folder):
    def build():
        areas = spark.createDataFrame([("Zone-13",), ("Zone-14",)], "area string")
        alerts, payments = context.location_takeover(ev(spark, folder), areas)
        return cut(alerts), cut(payments)

    return once(spark, folder, "takeover", build)


@query("cx1_location_takeover")
def _(spark, folder):
    return _takeover(spark, folder)[0].select(
        "account_id", "risk_area", "first_seen", "new_device", "outflow_24h", "typical_daily_outflow", "transactions", "signal_score")


@query("cx2_takeover_details")
def _(spark, folder):
    return _takeover(spark, folder)[0].select(
        "account_id", "first_seen", F.array_join("usual_areas", ",").alias("usual_areas"), F.array_join("signals", ";").alias("signals"))


@query("cx3_takeover_collectors")
def _(spark, folder):
    return context.takeover_collectors(_takeover(spark, folder)[1], min_victims=1).withColumn(
        "risk_areas", F.array_join("risk_areas", ","))


def _ev_tiers(spark, folder):
    """Every tenth wallet is an agent, every eleventh a merchant."""
    number = F.substring("account_id", 2, 12).cast("bigint")
    return graph.nodes(ev(spark, folder)).select("account_id", F.when(number % 10 == 0, "agent").when(
        number % 11 == 0, "merchant").otherwise("personal").alias("tier"))


HUNDI_GATE = dict(min_inflows=3, min_total=30000.0, max_funders=20)
HUNDI_GAP = fixed.DAY // 4
HUNDI_RULE = dict(min_beneficiaries=3, min_ratio=0.2, min_cycles=2, min_repeat=0.05)


def _hundi(spark, folder):
    return once(spark, folder, "hundi", lambda: context.hundi(
        ev(spark, folder), _ev_tiers(spark, folder), HUNDI_GATE, HUNDI_GAP, HUNDI_RULE))


def _hundi_funding(spark, folder):
    return context.hundi_funding(ev(spark, folder), _ev_tiers(spark, folder), HUNDI_GATE, HUNDI_GAP)


@query("cx4_informal_inflows")
def _(spark, folder):
    return context.informal_inflows(ev(spark, folder), _ev_tiers(spark, folder)).select("transaction_id", dbl("amount").alias("amount"))


@query("cx5_payouts")
def _(spark, folder):
    return context.payouts(ev(spark, folder), _ev_tiers(spark, folder)).select("transaction_id", dbl("amount").alias("amount"))


@query("cx6_funding_gates")
def _(spark, folder):
    return _hundi_funding(spark, folder)["gated"].withColumn("inflow_total", dbl("inflow_total"))


@query("cx7_funding_cycles")
def _(spark, folder):
    return _hundi_funding(spark, folder)["cycles"]


@query("cx8_cycle_payouts")
def _(spark, folder):
    return rounded(_hundi(spark, folder)["payouts"].groupBy("account_id", "cycle").agg(
        F.count("*").alias("payouts"), dbl(F.sum("amount")).alias("paid"), F.max("delay_hours").alias("longest_delay")))


@query("cx9_hundi_operators")
def _(spark, folder):
    return _hundi(spark, folder)["operators"]


@query("cx10_hundi_funders")
def _(spark, folder):
    return _hundi(spark, folder)["funders"]


@query("cx11_context_flags")
def _(spark, folder):
    alerts, payments = _takeover(spark, folder)
    hundi = _hundi(spark, folder)
    return context.context_flags(alerts, context.takeover_collectors(payments), hundi["operators"], hundi["funders"])


# ---------------------------------------------------------------------------- behaviour (set A)
def _li_behaviour(spark, folder):
    return behaviour.behaviour_features(*behaviour.inputs(li(spark, folder)))


columns_of("fa", _li_behaviour, {
    "1_counts": ("transaction_count", "sent_count", "received_count"),
    "2_totals": ("total_incoming", "total_outgoing", "net_flow"),
    "3_amounts": ("average_transaction_amount", "maximum_transaction_amount", "std_transaction_amount"),
    "4_counterparties": ("unique_senders", "unique_receivers"),
    "5_in_out_ratio": ("incoming_outgoing_ratio",),
    "6_diversity": ("counterparty_diversity",),
    "7_passthrough": ("passthrough_ratio",),
    "8_volatility": ("amount_volatility",),
    "9_imbalance": ("flow_imbalance_magnitude",),
    "10_velocity": ("transaction_velocity",),
})


def _ev_behaviour(spark, folder):
    return behaviour.behaviour_features(*ev_inputs(spark, folder))


def _li_degrees(spark, folder):
    totals, degree = behaviour.inputs(li(spark, folder))
    return behaviour.degree_features(degree, totals)


columns_of("gf", _li_degrees, {
    "1_degrees": ("in_degree", "out_degree", "total_degree", "degree_ratio"),
    "2_weighted_degrees": ("weighted_in_degree", "weighted_out_degree", "net_weight_flow"),
    "3_counterparties": ("unique_counterparties",),
    "4_fan_scores": ("fan_in_score", "fan_out_score"),
})


def _ev_graph_features(spark, folder):
    """Graph features of the event transfers with exhaustive loops; the network has no account nobody
    pays, so its exhaustive chains are left to the daily network."""
    def build():
        tx, (totals, degree), pairs = ev(spark, folder), ev_inputs(spark, folder), ev_pairs(spark, folder)
        loops, near = cut(_loops(spark, folder)), cut(detectors.structuring(tx))
        flags = cut(detectors.flags({
            "fan_in": detectors.fan_in(tx, degree, min_ratio=1.05),
            "fan_out": detectors.fan_out(tx, degree, min_ratio=1.05),
            "circular_flow": detectors.members_of(loops, "nodes"),
            "rapid_movement": detectors.rapid_payments(tx, window=600),
            "structuring": near,
        }))
        weak = topology.weak_components(pairs)
        part = behaviour.graph_features(
            degree, totals, weak, graph.undirected(pairs), flags,
            loops.select(F.explode("nodes").alias("account_id")).groupBy("account_id").agg(F.count("*").alias("cycle_count")),
            spark.createDataFrame([], "account_id string, chain_length int"),
            near.groupBy("account_id").agg(F.max("near_threshold_count").alias("near_threshold_tx_count")))
        return cut(part), flags, near

    return once(spark, folder, "ev_graph_features", build)


columns_of("gf", lambda spark, folder: _ev_graph_features(spark, folder)[0], {
    "5_cycles": ("cycle_detected", "cycle_count"),
    "7_structuring": ("structuring_detected", "near_threshold_tx_count"),
    "8_network_size": ("network_size",),
    "9_suspicious_neighbours": ("suspicious_neighbor_count",),
})


@query("gf6_chain_length")
def _(spark, folder):
    chains = detectors.transaction_chains(dy_pairs(spark, folder))
    return chains.select(F.explode("path").alias("account_id"), "hops").groupBy("account_id").agg(F.max("hops").alias("chain_length"))


def _vector(spark, folder):
    return once(spark, folder, "ev_vector", lambda: cut(
        behaviour.feature_vector(_ev_behaviour(spark, folder), _ev_graph_features(spark, folder)[0])))


@query("gf10_feature_vector")
def _(spark, folder):
    return _vector(spark, folder)


# --------------------------------------------------------------------------- feature store (set B)
def _transactional(spark, folder):
    return store.transactional(*behaviour.inputs(li(spark, folder)))


columns_of("fs", _transactional, {
    "1_transactional": fixed.TRANSACTIONAL[:14],
    "2_near_threshold": ("near_threshold_out", "near_threshold_in"),
    "3_sub_threshold_share": ("sub_threshold_share",),
    "4_round_amount_share": ("round_amount_share",),
})
QUERIES["fs5_active_days"] = lambda spark, folder: store.daily(store.daily_sums(ev(spark, folder))).select("account_id", "active_days")
QUERIES["fs6_span_velocity"] = lambda spark, folder: rounded(store.pace(ev_inputs(spark, folder)[0]).select(
    "account_id", "active_span_hours", "transaction_velocity"))
QUERIES["fs7_max_tx_per_hour"] = lambda spark, folder: store.hourly(ev(spark, folder)).select("account_id", "max_tx_per_hour")
QUERIES["fs8_two_hour_counterparties"] = lambda spark, folder: store.two_hourly(ev(spark, folder))
QUERIES["fs9_night_share"] = lambda spark, folder: rounded(store.pace(ev_inputs(spark, folder)[0]).select("account_id", "night_share"))
QUERIES["fs10_hour_entropy"] = lambda spark, folder: rounded(store.hourly(ev(spark, folder)).select("account_id", "hour_entropy"))
QUERIES["fs11_inter_arrival"] = lambda spark, folder: rounded(store.rhythm(ev(spark, folder)), 5)
QUERIES["fs12_same_day_turnover"] = lambda spark, folder: rounded(
    store.daily(store.daily_sums(ev(spark, folder))).select("account_id", "same_day_turnover"))
QUERIES["fs14_degrees"] = lambda spark, folder: rounded(ev_inputs(spark, folder)[1].select(
    "account_id", dbl("in_degree").alias("in_degree"), dbl("out_degree").alias("out_degree"),
    (F.col("in_degree") / (F.col("out_degree") + 1.0)).alias("degree_ratio")))


@query("fs13_dwell")
def _(spark, folder):
    return rounded(ev_store(spark, folder).select("account_id", "dwell_fast_s", "dwell_slow_s"))


@query("fs15_topology")
def _(spark, folder):
    return rounded(ev_store(spark, folder).select(
        "account_id", "reciprocity", "pagerank", "scc_size", "triad_cycles", "two_hop_out", "two_hop_in", "avg_neighbor_degree"), 4)


@query("fs16_flow_columns")
def _(spark, folder):
    return rounded(ev_store(spark, folder).select("account_id", *fixed.GRAPH[10:]))


@query("fs19_tier_flags")
def _(spark, folder):
    accounts = graph.nodes(li(spark, folder))
    return store.tier_flags(accounts, scoring.tiers(accounts))


@query("fs20_feature_store")
def _(spark, folder):
    return rounded(ev_store(spark, folder), 4)


# ------------------------------------------------------------------------------------- scoring
def _raw(spark, folder):
    """A score column spread around 0, as an anomaly model would give."""
    return _vector(spark, folder).select(
        "account_id", F.round(F.lit(0.12) - F.abs(F.col("degree_ratio") - 0.95) * 0.6, 6).alias("raw_score"))


def _spread(spark, folder):
    return once(spark, folder, "spread", lambda: scoring.spread(_raw(spark, folder)))


@query("ml1_robust_scaling")
def _(spark, folder):
    names = ("transaction_count", "total_incoming", "cycle_count", "degree_ratio", "amount_volatility")
    found = models.scale_parameters(_vector(spark, folder), names)
    x = models.scaled(found)
    return rounded(_vector(spark, folder).withColumn("x", x).select("account_id", *[F.col("x")[i].alias(n) for i, n in enumerate(names)]))


@query("ml3_mad_spread")
def _(spark, folder):
    median, mad = _spread(spark, folder)
    n = _raw(spark, folder).agg(F.count("*").alias("accounts"))
    return n.select("accounts", F.round(F.lit(median), 6).alias("median"), F.round(F.lit(mad), 6).alias("spread"))


def _calibrated(spark, folder):
    return scoring.calibrate(_raw(spark, folder), _spread(spark, folder)[1])


QUERIES["ml4_calibration"] = lambda spark, folder: _calibrated(spark, folder).select("account_id", "ml_anomaly_score")
QUERIES["ml5_is_anomaly"] = lambda spark, folder: _calibrated(spark, folder).select("account_id", "is_anomaly")


@query("ml8_best_f1_threshold")
def _(spark, folder):
    return rounded(evaluate.best_f1_threshold(views.scores(spark, folder), ["network_id"]))


def _baselines(spark, folder):
    return once(spark, folder, "baselines", lambda: scoring.baselines(_vector(spark, folder)))


@query("ml11_baselines")
def _(spark, folder):
    found = _baselines(spark, folder)
    return _vector(spark, folder).agg(*[F.round(F.lit(found[c]), 6).alias(c) for c in scoring.BASELINES])


def _scored(spark, folder):
    """Composite scores of the event network; the probability is a stand-in column."""
    def build():
        rows = _vector(spark, folder).join(_calibrated(spark, folder), "account_id")
        rows = rows.join(_ev_tiers(spark, folder).withColumnRenamed("tier", "account_tier"), "account_id")
        rows = rows.join(scoring.account_patterns(_ev_graph_features(spark, folder)[1]), "account_id", "left").withColumn(
            "patterns", F.coalesce("patterns", F.array().cast("array<string>")))
        rows = rows.withColumn("supervised_probability", F.when(
            F.col("transaction_count") >= 100, F.round(F.col("passthrough_ratio") * 0.5, 4)))
        return cut(scoring.composite(rows, _baselines(spark, folder)))

    return once(spark, folder, "scored", build)


QUERIES["ml12_ml_component"] = lambda spark, folder: _scored(spark, folder).select("account_id", "account_tier", "ml_component")
QUERIES["ml13_graph_points"] = lambda spark, folder: _scored(spark, folder).select("account_id", "graph_component")
QUERIES["ml14_untiered_points"] = lambda spark, folder: _scored(spark, folder).select(
    "account_id", scoring.graph_points(tier_aware=False).alias("untiered"), F.col("graph_component").alias("tiered"))
QUERIES["ml15_behaviour_points"] = lambda spark, folder: _scored(spark, folder).select("account_id", "behavioral_component")
QUERIES["ml16_final_score"] = lambda spark, folder: _scored(spark, folder).select("account_id", "risk_score")
QUERIES["ml17_risk_level"] = lambda spark, folder: _scored(spark, folder).select("account_id", "risk_level")
QUERIES["ml18_account_patterns"] = lambda spark, folder: scoring.account_patterns(
    _ev_graph_features(spark, folder)[1]).withColumn("patterns", F.array_join("patterns", ","))
QUERIES["ml19_risk_reports"] = lambda spark, folder: scoring.risk_reports(_scored(spark, folder)).select(
    "account_id", "risk_score", "risk_level", "ml_component", "graph_component", "behavioral_component")


# ------------------------------------------------------------------------------------ reporting
def _detailed(spark, folder):
    near = _ev_graph_features(spark, folder)[2]
    rapid = detectors.rapid_movement(detectors.rapid_payments(ev(spark, folder), window=600))
    rows = report.attach_details(_scored(spark, folder), {
        "structuring": report.structuring_details(near), "rapid_movement": report.rapid_details(rapid),
        "circular_flow": report.loop_details(_loops(spark, folder))})
    return rows


@query("rp1_evidence")
def _(spark, folder):
    return _detailed(spark, folder).select("account_id", F.posexplode(report.evidence()).alias("position", "sentence"))


@query("rp3_typology")
def _(spark, folder):
    return _scored(spark, folder).select("account_id", report.typology().alias("typology"))


@query("rp4_key_findings")
def _(spark, folder):
    return _detailed(spark, folder).select("account_id", F.posexplode(report.key_findings()).alias("position", "finding"))


def _related(spark, folder):
    tx = ev(spark, folder)
    near = _ev_graph_features(spark, folder)[2]
    return report.related_accounts({
        "circular_flow": _loops(spark, folder).select("nodes", F.explode("nodes").alias("account_id")).select(
            "account_id", F.explode("nodes").alias("member")),
        "structuring": detectors.structuring_members(near, tx).select("account_id", "member")})


@query("rp5_related_accounts")
def _(spark, folder):
    return _related(spark, folder).withColumn("related", F.array_join("related", ","))


@query("rp6_next_steps")
def _(spark, folder):
    rows = _scored(spark, folder).join(_related(spark, folder), "account_id", "left")
    return rows.select("account_id", F.posexplode(report.next_steps()).alias("position", "step"))


@query("rp7_summaries")
def _(spark, folder):
    return _scored(spark, folder).select("account_id", report.headline().alias("headline"), report.summary_text().alias("summary"))


@query("rp8_node_table")
def _(spark, folder):
    return report.node_table(_scored(spark, folder), ev_inputs(spark, folder)[1]).withColumn("patterns", F.array_join("patterns", ","))


def _pattern_summary(spark, folder):
    return report.pattern_summary(_ev_graph_features(spark, folder)[1])


QUERIES["rp9_pattern_summary"] = _pattern_summary


@query("rp10_global_stats")
def _(spark, folder):
    strong = once(spark, folder, "ev_strong", lambda: cut(topology.strong_components(ev_pairs(spark, folder))))
    weak = once(spark, folder, "ev_weak", lambda: cut(topology.weak_components(ev_pairs(spark, folder))))
    return report.global_stats(ev(spark, folder), _scored(spark, folder), topology.multi_account_components(strong),
                               _pattern_summary(spark, folder), graph.summary(ev(spark, folder), weak, strong))


QUERIES["rp11_volume_timeline"] = lambda spark, folder: report.volume_timeline(ev(spark, folder))
QUERIES["rp12_risk_distribution"] = lambda spark, folder: report.risk_distribution(_scored(spark, folder))
QUERIES["rp13_top_accounts"] = lambda spark, folder: report.top_accounts(_scored(spark, folder)).select(
    "account_id", "risk_score", "risk_level", "transaction_count", "total_incoming", "total_outgoing")
QUERIES["rp14_account_search"] = lambda spark, folder: report.search_accounts(
    _scored(spark, folder), risk="medium", pattern="struct", search="u1").select("account_id", "risk_score")
QUERIES["rp16_ledger_page"] = lambda spark, folder: report.ledger(
    ev(spark, folder), search="u1", min_amount=5000, page=3).select("transaction_id", "sender_id", "receiver_id", dbl("amount").alias("amount"), "t")
QUERIES["rp17_linked_transactions"] = lambda spark, folder: report.linked_transactions(ev(spark, folder)).withColumn("amount", dbl("amount"))


@query("gr9_ego_filtered")
def _(spark, folder):
    pairs = ev_pairs(spark, folder)
    members = graph.ego_nodes(pairs, graph.nodes(ev(spark, folder)), hops=1)
    kept = graph.ego_filtered(members, _scored(spark, folder), "ELEVATED")
    return graph.ego_counts(kept, graph.ego_edges(pairs, kept))


@query("gr10_suspicious_edges")
def _(spark, folder):
    return graph.suspicious_edges(ev_pairs(spark, folder), _scored(spark, folder)).withColumn(
        "shared_patterns", F.array_join("shared_patterns", ","))


@query("rp25_masking")
def _(spark, folder):
    customers = spark.read.parquet(f"{folder}/customer.parquet")
    profiles = customers.select(
        F.col("c_custkey").alias("account_id"), F.concat("c_name", F.lit(" "), "c_mktsegment").alias("holder_name"),
        F.concat(F.lit("01"), F.lpad(F.col("c_custkey").cast("string"), 9, "7")).alias("phone"), (F.col("c_custkey") * 7919).alias("national_id"))
    return workflow.mask_profiles(profiles).select(F.col("account_id").alias("c_custkey"), F.col("holder_name").alias("name"), "phone", "national_id")


# ------------------------------------------------------------------------------------ evaluation
def _rule_inputs(spark, folder):
    """Store columns the rules read, and the daily sums, from the line-item transfers."""
    tx = li_kept(spark, folder)
    totals, degree = behaviour.inputs(tx)
    per_day = store.daily_sums(tx)
    features = totals.select("account_id", "total_incoming", "total_outgoing", "maximum_transaction_amount")
    for part in (store.hourly(tx).select("account_id", "max_tx_per_hour"), store.two_hourly(tx),
                 store.daily(per_day).select("account_id", "same_day_turnover"),
                 store.tier_flags(totals, scoring.tiers(totals))):
        features = features.join(part, "account_id")
    return tx, features, per_day


def _rules(spark, folder):
    return evaluate.rules(*_rule_inputs(spark, folder))


QUERIES["ev1_rules"] = lambda spark, folder: _rules(spark, folder).drop("log_volume")
QUERIES["ev2_rule_scores"] = lambda spark, folder: rounded(evaluate.rule_scores(_rules(spark, folder)).select("account_id", "score"))
QUERIES["ev3_confusion"] = lambda spark, folder: rounded(evaluate.confusion(views.scores(spark, folder), ["network_id"]))
QUERIES["ev4_average_precision"] = lambda spark, folder: rounded(evaluate.average_precision(views.scores(spark, folder), ["network_id"]))
QUERIES["ev5_roc_auc"] = lambda spark, folder: rounded(evaluate.roc_auc(views.scores(spark, folder), ["network_id"]))


@query("ev6_mean_std")
def _(spark, folder):
    per_network = evaluate.metrics(views.scores(spark, folder), ["network_id"])
    return rounded(evaluate.mean_std(per_network, ["precision", "recall", "f1", "pr_auc", "roc_auc"]))


QUERIES["ev7_recall_by_typology"] = lambda spark, folder: rounded(evaluate.recall_by(views.scores(spark, folder), "typology"))


def _compared(spark, folder):
    """Scores with the rules' alert: long documents."""
    return views.scores(spark, folder).withColumn("rule_alert", F.col("score") >= 2000)


QUERIES["ev8_missed_by_rules"] = lambda spark, folder: evaluate.missed_by_rules(_compared(spark, folder), "typology")
QUERIES["ev12_rates_by_tier"] = lambda spark, folder: rounded(evaluate.rates_by(views.scores(spark, folder), "network_id"))
QUERIES["ev12_rate_gap"] = lambda spark, folder: rounded(evaluate.rate_gap(evaluate.rates_by(views.scores(spark, folder), "network_id")))
QUERIES["ev13_independence"] = lambda spark, folder: rounded(evaluate.independence(views.scores(spark, folder), "typology"))
QUERIES["ev15_workload"] = lambda spark, folder: rounded(evaluate.workload(_compared(spark, folder)))


@query("ev14_detector_quality")
def _(spark, folder):
    hundi = _hundi(spark, folder)
    alerts, payments = _takeover(spark, folder)
    flags = context.context_flags(alerts, context.takeover_collectors(payments), hundi["operators"], hundi["funders"])
    truth = graph.nodes(ev(spark, folder)).select(
        "account_id", F.explode(F.array(*[F.lit(p) for p in fixed.CONTEXT_PATTERNS])).alias("pattern"),
    ).join(_ev_tiers(spark, folder), "account_id").withColumn("is_true", F.col("tier") == "agent").withColumn(
        "merchants", F.col("tier") == "merchant")
    return rounded(evaluate.detector_quality(flags, truth, ["merchants"]))


@query("ev16_scenario_verdicts")
def _(spark, folder):
    reports = _scored(spark, folder).withColumn("scenario", F.col("account_tier"))
    planted = reports.groupBy("scenario").agg(F.max(F.struct("risk_score", "account_id"))["account_id"].alias("target")).withColumn(
        "expected_pattern", F.lit("structuring"))
    return evaluate.scenario_verdicts(planted, reports)


@query("ev17_dataset_summary")
def _(spark, folder):
    labels = views.scores(spark, folder).select(F.col("network_id").alias("tier"), F.col("y").alias("label"), "typology")
    return evaluate.dataset_summary(li(spark, folder), labels)


# --------------------------------------------------------------------------------------- models
def _labelled(spark, folder):
    """Store features labelled by the rules baseline, a weak label the data itself gives."""
    def build():
        tx, features = ev(spark, folder), ev_store(spark, folder)
        fired = evaluate.rules(tx, features, store.daily_sums(tx))
        weak = fired.select("account_id", (F.col("rules_fired") >= 2).cast("int").alias("label"),
                            F.when(F.col("r3_structuring"), "structuring").when(F.col("r5_rapid_passthrough"), "passthrough")
                            .otherwise("other").alias("typology"))
        return tabled(features.join(weak, "account_id"))

    return once(spark, folder, "labelled", build)


def _split(spark, folder, part: str) -> DataFrame:
    """Accounts by a hash: six tenths train, two choose the threshold, two test."""
    slot = F.pmod(F.xxhash64("account_id"), F.lit(10))
    wanted = {"train": slot < 6, "choose": (slot >= 6) & (slot < 8), "test": slot >= 8}
    return _labelled(spark, folder).where(wanted[part])


def _boosted(spark, folder):
    def build():
        model = models.fit_boosting(_split(spark, folder, "train"))
        return models.with_best_threshold(model, _split(spark, folder, "choose"))

    return once(spark, folder, "boosted", build)


def _forest(spark, folder):
    return once(spark, folder, "isolation", lambda: models.IsolationForest(fixed.VECTOR).fit(_vector(spark, folder)))


@query("ml2_isolation_forest")
def _(spark, folder):
    return rounded(_forest(spark, folder).decision(_vector(spark, folder)))


@query("ml6_boosting")
def _(spark, folder):
    return rounded(_boosted(spark, folder).score(_labelled(spark, folder)).select("account_id", "label", "probability"))


@query("ml7_random_forest")
def _(spark, folder):
    forest = once(spark, folder, "random_forest", lambda: models.fit_forest(_split(spark, folder, "train")))
    return rounded(forest.score(_labelled(spark, folder)).select("account_id", "label", "probability"))


@query("ml9_score_path")
def _(spark, folder):
    return rounded(_boosted(spark, folder).score(ev_store(spark, folder)).select("account_id", "probability"))


@query("ml10_drivers")
def _(spark, folder):
    model = _boosted(spark, folder)
    flagged = model.score(ev_store(spark, folder)).where(F.col("probability") >= model.threshold)
    return rounded(models.drivers(model, ev_store(spark, folder), flagged))


@query("ev9_ablation")
def _(spark, folder):
    test = _split(spark, folder, "test").withColumn("network", F.pmod(F.xxhash64("account_id"), F.lit(10)))
    return rounded(models.ablation(_split(spark, folder, "train"), test, "network"))


def _importance(spark, folder):
    return once(spark, folder, "importance", lambda: cut(models.permutation_importance(
        _boosted(spark, folder), _split(spark, folder, "test"), repeats=3)))


@query("ev10_permutation_importance")
def _(spark, folder):
    return rounded(_importance(spark, folder))


@query("ev10_family_share")
def _(spark, folder):
    return rounded(models.family_share(_importance(spark, folder)))


@query("ev11_leave_one_out")
def _(spark, folder):
    train, choose, test = (_split(spark, folder, part) for part in ("train", "choose", "test"))
    return rounded(models.leave_one_out(train, test, ("structuring", "passthrough", "other"), validation=choose))


@query("pipeline_reports")
def _(spark, folder):
    areas = spark.createDataFrame([("Zone-13",), ("Zone-14",)], "area string")
    reports = once(spark, folder, "pipeline", lambda: cut(pipeline.run(
        ev(spark, folder), _ev_tiers(spark, folder), areas, temporal=True)[0]))
    return reports.select("account_id", "risk_score", "risk_level", F.array_join("patterns", ",").alias("patterns"), "typology",
                          "headline", "summary", F.array_join("evidence", " | ").alias("evidence"))


# ------------------------------------------------------------------------------------ streaming
def _daily_store(spark, folder):
    return once(spark, folder, "daily_store", lambda: stream.daily_store_of_table(spark, folder))


@query("st1_recent_day")
def _(spark, folder):
    """The most recent day as one batch."""
    today = store.transactional(*behaviour.inputs(pipeline.recent_day(ev(spark, folder))))
    return rounded(today.select("account_id", *fixed.TRANSACTIONAL))


@query("st1_latest_day_of_store")
def _(spark, folder):
    kept = _daily_store(spark, folder)
    return rounded(kept.features(kept.latest_day()).select("account_id", *fixed.TRANSACTIONAL))


@query("st1_incremental_store")
def _(spark, folder):
    return rounded(_daily_store(spark, folder).features().select("account_id", *fixed.TRANSACTIONAL))


@query("st1_recent_scores")
def _(spark, folder):
    """The accounts of the most recent day, scored from the incremental store by a model of its columns."""
    kept = _daily_store(spark, folder)
    model = once(spark, folder, "daily_model", lambda: models.fit_boosting(
        kept.features().join(_labelled(spark, folder).select("account_id", "label"), "account_id"), columns=fixed.TRANSACTIONAL))
    return rounded(model.score(kept.features(kept.latest_day())).select("account_id", "probability"))


@query("st2_tumbling_counts")
def _(spark, folder):
    return stream.tumbling_counts_of_table(spark, folder)


@query("st3_takeover_stream")
def _(spark, folder):
    return stream.takeover_of_table(spark, folder)


@query("st4_stream_duplicates")
def _(spark, folder):
    return stream.deduplicated_table(spark, folder)
