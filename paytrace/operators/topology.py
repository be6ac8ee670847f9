"""Iterative graph measures built from joins: components, PageRank, reach, loops of three.

Every loop materialises one table per round in the shared checkpoint folder, so a lost executor
costs one round, and stops when a round changes nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.session import cut, tabled
from .graph import undirected

WEDGE_LIMIT = 50_000_000


def _sized(labels: DataFrame) -> DataFrame:
    """Name each component after its smallest member and add its size."""
    facts = labels.groupBy("component").agg(F.min("account_id").alias("name"), F.count("*").alias("component_size"))
    return labels.join(facts, "component").select(
        "account_id", F.col("name").alias("component"), "component_size"
    )


def weak_components(pairs: DataFrame) -> DataFrame:
    """Weakly connected components: (account_id, component, component_size).

    Each round every root adopts the neighbour with the smallest hashed id, chains of adoption are
    flattened by pointer doubling, and links are rewritten to roots. Links shrink with every round and
    hashing the ids keeps the number of rounds logarithmic whatever the ids look like.
    """
    return _sized(_merged(pairs))


def _merged(pairs: DataFrame) -> DataFrame:
    """(account_id, component) of the accounts in ``pairs``, joined whichever way money went."""
    links = tabled(undirected(pairs))
    labels = links.select(F.col("node").alias("account_id")).distinct().withColumn("component", F.col("account_id"))
    labels = tabled(labels)
    while not links.isEmpty():
        best = F.min(F.struct(F.xxhash64("nbr").alias("h"), F.col("nbr").alias("id")))
        picked = links.groupBy("node").agg(best.alias("best"))
        own = F.struct(F.xxhash64("node").alias("h"), F.col("node").alias("id"))
        parent = tabled(picked.select("node", F.least(own, F.col("best"))["id"].alias("parent")))
        while True:
            up = parent.select(F.col("node").alias("parent"), F.col("parent").alias("grand"))
            parent = tabled(parent.join(up, "parent").select(
                "node", F.col("grand").alias("parent"), (F.col("grand") != F.col("parent")).alias("moved")))
            if parent.where("moved").isEmpty():
                break
        root = parent.select("node", "parent")
        labels = tabled(
            labels.join(root.withColumnRenamed("node", "component"), "component", "left")
            .select("account_id", F.coalesce("parent", "component").alias("component"))
        )
        links = tabled(
            links.join(root.withColumnRenamed("parent", "a"), "node")
            .join(root.select(F.col("node").alias("nbr"), F.col("parent").alias("b")), "nbr")
            .where("a <> b").select(F.col("a").alias("node"), F.col("b").alias("nbr")).distinct()
        )
    return labels


def strong_components(pairs: DataFrame) -> DataFrame:
    """Strongly connected components: (account_id, component, component_size).

    While half of the links are mutual, accounts that pay each other are merged, which collapses a dense
    network in few rounds. On what is left, dead ends are trimmed, every node learns the
    smallest id that reaches it and the smallest id it reaches, and where both are the same id the node
    shares a component with it. Links between nodes that disagree cannot lie inside a component and are
    dropped before the next round.
    """
    labels = tabled(pairs.select(F.explode(F.array("src", "dst")).alias("account_id")).distinct().withColumn(
        "component", F.col("account_id")))
    live = tabled(pairs)
    while not live.isEmpty():
        back = live.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
        mutual = tabled(live.join(back, ["src", "dst"], "left_semi"))
        # Worth a merge only where it removes much of the network.
        if 2 * mutual.count() < max(live.count(), 1):
            break
        labels, live = _contract(labels, live, _merged(mutual))
    while True:
        live = _trim(live)
        if live.isEmpty():
            return _sized(labels)
        reach = _two_way_minimum(live)
        named = reach.where("up = down").select(F.col("node").alias("account_id"), F.col("up").alias("component"))
        ends = reach.select("node", "up", "down")
        live = tabled(
            live.join(ends.toDF("src", "up", "down"), "src")
            .join(ends.toDF("dst", "up2", "down2"), "dst")
            .where("up = up2 AND down = down2 AND up <> down").select("src", "dst")
        )
        labels, _ = _contract(labels, None, named)


def _contract(labels: DataFrame, live: DataFrame | None, merged: DataFrame):
    """Labels and links rewritten to the merged accounts' representatives."""
    to = merged.select(F.col("account_id").alias("component"), F.col("component").alias("__to"))
    labels = tabled(labels.join(to, "component", "left").select("account_id", F.coalesce("__to", "component").alias("component")))
    if live is None:
        return labels, None
    a = merged.select(F.col("account_id").alias("src"), F.col("component").alias("a"))
    b = merged.select(F.col("account_id").alias("dst"), F.col("component").alias("b"))
    live = live.join(a, "src", "left").join(b, "dst", "left").select(
        F.coalesce("a", "src").alias("src"), F.coalesce("b", "dst").alias("dst"))
    return labels, tabled(live.where("src <> dst").distinct())


def _trim(live: DataFrame, rounds: int = 3) -> DataFrame:
    """Drop links whose start nothing pays or whose end pays nothing; they close no loop."""
    for _ in range(rounds):
        paid = live.select(F.col("dst").alias("src")).distinct()
        payers = live.select(F.col("src").alias("dst")).distinct()
        live = tabled(live.join(paid, "src", "left_semi").join(payers, "dst", "left_semi").select("src", "dst"))
    return live


def _two_way_minimum(live: DataFrame) -> DataFrame:
    """Smallest id reaching each node (``up``) and smallest id each node reaches (``down``)."""
    start = live.select(F.explode(F.array("src", "dst")).alias("node")).distinct()
    state = tabled(start.select("node", F.col("node").alias("up"), F.col("node").alias("down")))
    while True:
        forward = live.join(state, live.src == state.node).select(
            F.col("dst").alias("node"), "up", F.lit(None).cast("string").alias("down"))
        backward = live.join(state, live.dst == state.node).select(
            F.col("src").alias("node"), F.lit(None).cast("string").alias("up"), "down")
        own = state.select("node", "up", "down", F.col("up").alias("old_up"), F.col("down").alias("old_down"))
        spread = own.unionByName(forward, allowMissingColumns=True).unionByName(backward, allowMissingColumns=True)
        state = tabled(
            spread.groupBy("node").agg(
                F.min("up").alias("up"), F.min("down").alias("down"),
                F.max("old_up").alias("old_up"), F.max("old_down").alias("old_down"),
            ).select("node", "up", "down", ((F.col("up") < F.col("old_up")) | (F.col("down") < F.col("old_down"))).alias("moved"))
        )
        if state.where("moved").isEmpty():
            return state.select("node", "up", "down")
        state = state.drop("moved")


def multi_account_components(strong: DataFrame) -> DataFrame:
    """Number of strong components with more than one account."""
    return strong.where("component_size > 1").agg(F.count_distinct("component").alias("components"))


def pagerank(edge_table: DataFrame, damping: float = 0.85, iterations: int = 30) -> DataFrame:
    """Weighted PageRank scaled so the average account has 1: (account_id, pagerank).

    ``edge_table`` holds one row per (src, dst) with ``weight``. Links stay partitioned by payer; each
    iteration shuffles only partially summed shares. The mass of accounts that pay nobody is what the
    shares lack to 1 and is spread evenly.
    """
    weights = edge_table.select("src", "dst", F.col("weight").cast("double").alias("w"))
    out = weights.groupBy("src").agg(F.sum("w").alias("total"))
    links = tabled(weights.join(out, "src").select("src", "dst", (F.col("w") / F.col("total")).alias("share")))
    accounts = tabled(edge_table.select(F.explode(F.array("src", "dst")).alias("account_id")).distinct())
    n = accounts.count()
    rank = accounts.select("account_id", F.lit(1.0 / n).alias("rank")) if n else None
    if rank is None:
        return accounts.withColumn("pagerank", F.lit(1.0))
    base = accounts.select("account_id", F.lit(0.0).alias("got"))
    for _ in range(iterations):
        paid = links.join(rank, links.src == rank.account_id).select(
            F.col("dst").alias("account_id"), (F.col("share") * F.col("rank")).alias("got"))
        received = tabled(paid.unionByName(base).groupBy("account_id").agg(F.sum("got").alias("got")))
        lost = 1.0 - received.agg(F.sum("got")).first()[0]
        rank = received.select(
            "account_id", (F.lit((1 - damping) / n) + damping * (F.col("got") + F.lit(lost / n))).alias("rank"))
    return rank.select("account_id", (F.col("rank") * n).alias("pagerank"))


def two_hop(pairs: DataFrame, outward: bool = True, wedge_limit: int = WEDGE_LIMIT) -> DataFrame:
    """Distinct accounts two steps away, following or against the money: (account_id, reach).

    A middle account with ``a`` payers and ``b`` payees would emit ``a*b`` rows. Middles above
    ``wedge_limit`` are taken out of the join: accounts are grouped by the exact set of such hubs they
    touch, each set's reach is computed once, and only ordinary paths not already covered by the set
    are added. The count is exact for any limit.
    """
    step = pairs.select("src", "dst") if outward else pairs.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    load = (
        step.groupBy(F.col("dst").alias("mid")).agg(F.count("*").alias("a"))
        .join(step.groupBy(F.col("src").alias("mid")).agg(F.count("*").alias("b")), "mid")
    )
    heavy = load.where(F.col("a") * F.col("b") > wedge_limit).select("mid")
    onward = step.select(F.col("src").alias("mid"), F.col("dst").alias("far"))
    inward = step.select(F.col("src").alias("account_id"), F.col("dst").alias("mid"))
    if heavy.isEmpty():
        return (
            inward.join(onward, "mid").select("account_id", "far").distinct()
            .groupBy("account_id").agg(F.count("*").alias("reach"))
        )
    heavy = cut(heavy)
    light = inward.join(heavy, "mid", "left_anti").join(onward, "mid").select("account_id", "far").distinct()
    touched = inward.join(heavy, "mid", "left_semi").groupBy("account_id").agg(
        F.sort_array(F.collect_set("mid")).alias("hubs"))
    touched = cut(touched.withColumn("hubs_key", F.concat_ws("\u0001", "hubs")))
    covered = cut(
        touched.select("hubs_key", "hubs").distinct().select("hubs_key", F.explode("hubs").alias("mid"))
        .join(onward, "mid").select("hubs_key", "far").distinct()
    )
    sizes = covered.groupBy("hubs_key").agg(F.count("*").alias("hub_reach"))
    extra = (
        light.join(touched.select("account_id", "hubs_key"), "account_id", "left")
        .join(covered, ["hubs_key", "far"], "left_anti")
        .groupBy("account_id").agg(F.count("*").alias("extra"))
    )
    through = touched.join(sizes, "hubs_key").select("account_id", "hub_reach")
    return extra.join(through, "account_id", "full").select(
        "account_id", (F.coalesce("extra", F.lit(0)) + F.coalesce("hub_reach", F.lit(0))).alias("reach"))


def triangles(pairs: DataFrame) -> DataFrame:
    """Directed loops of three through each account: (account_id, triad_cycles).

    Each loop is found once, from its account of lowest degree, so a hub is never the middle of a
    join: the wedges stay within E^1.5 whatever the skew.
    """
    both = undirected(pairs)
    degree = both.groupBy("node").agg(F.count("*").alias("d"))
    ranked = (
        pairs.join(degree.select(F.col("node").alias("src"), F.struct("d", F.col("node").alias("id")).alias("ks")), "src")
        .join(degree.select(F.col("node").alias("dst"), F.struct("d", F.col("node").alias("id")).alias("kd")), "dst")
    )
    leave = ranked.where("ks < kd").select(F.col("src").alias("low"), F.col("dst").alias("payee"))
    enter = ranked.where("kd < ks").select(F.col("dst").alias("low"), F.col("src").alias("payer"))
    closing = pairs.select(F.col("src").alias("payee"), F.col("dst").alias("payer"))
    loops = leave.join(enter, "low").where("payee <> payer").join(closing, ["payee", "payer"], "left_semi")
    return (
        loops.select(F.explode(F.array("low", "payee", "payer")).alias("account_id"))
        .groupBy("account_id").agg(F.count("*").alias("triad_cycles"))
    )


def neighbour_degree(both: DataFrame) -> DataFrame:
    """Mean number of counterparties over an account's counterparties."""
    degree = both.groupBy(F.col("node").alias("nbr")).agg(F.count("*").alias("d"))
    return both.join(degree, "nbr").groupBy(F.col("node").alias("account_id")).agg(
        F.avg("d").alias("avg_neighbor_degree"))


def reciprocity(degree: DataFrame) -> DataFrame:
    """Share of counterparties both paid and paid by."""
    return degree.select("account_id", (F.col("mutual") / F.greatest("unique_counterparties", F.lit(1))).alias("reciprocity"))
