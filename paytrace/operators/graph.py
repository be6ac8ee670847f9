"""The transfer graph as DataFrames: edges, nodes, pairs, summary, ego networks, suspicious edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import postings


def multigraph(tx: DataFrame) -> DataFrame:
    """One edge per transfer. Also the long form of an aggregated edge's transfer list."""
    return tx.select(
        F.col("sender_id").alias("src"), F.col("receiver_id").alias("dst"),
        "transaction_id", "amount", "t",
    )


def edges(tx: DataFrame) -> DataFrame:
    """One row per (src, dst): total, count, latest time and the first transfer's id.

    "First" is the earliest by (t, amount, transaction_id). The nested transfer list of a pair stays in
    long form (``multigraph``): one busy pair would not fit one row.
    """
    return (
        tx.groupBy(F.col("sender_id").alias("src"), F.col("receiver_id").alias("dst"))
        .agg(
            F.sum("amount").alias("weight"),
            F.count("*").alias("cnt"),
            F.max("t").alias("last_ts"),
            F.min(F.struct("t", "amount", "transaction_id"))["transaction_id"].alias("first_tx"),
        )
    )


def edge_pairs(tx: DataFrame) -> DataFrame:
    """Distinct directed pairs."""
    return tx.select(F.col("sender_id").alias("src"), F.col("receiver_id").alias("dst")).distinct()


def nodes(tx: DataFrame) -> DataFrame:
    return (
        tx.select(F.explode(F.array("sender_id", "receiver_id")).alias("account_id")).distinct()
    )


def undirected(pairs: DataFrame) -> DataFrame:
    """Both directions of every pair, distinct: ``node``, ``nbr``."""
    both = F.array(
        F.struct(F.col("src").alias("node"), F.col("dst").alias("nbr")),
        F.struct(F.col("dst").alias("node"), F.col("src").alias("nbr")),
    )
    return pairs.select(F.explode(both).alias("e")).select("e.*").distinct()


def account_pairs(tx: DataFrame) -> DataFrame:
    """One row per (account, counterparty) with transfers in each direction.

    Grouping by the pair first spreads a hub over its counterparties; everything that needs distinct
    counterparties is then a plain count of these rows.
    """
    return postings(tx).groupBy("account_id", "counterparty").agg(
        F.count_if("is_out").alias("sent"),
        F.count_if(~F.col("is_out")).alias("received"),
    )


def degrees(pairs: DataFrame) -> DataFrame:
    """Distinct senders, receivers, counterparties and mutual partners per account."""
    return pairs.groupBy("account_id").agg(
        F.count_if(F.col("received") > 0).alias("in_degree"),
        F.count_if(F.col("sent") > 0).alias("out_degree"),
        F.count("*").alias("unique_counterparties"),
        F.count_if((F.col("received") > 0) & (F.col("sent") > 0)).alias("mutual"),
    )


def summary(tx: DataFrame, weak: DataFrame, strong: DataFrame) -> DataFrame:
    """One row: accounts, edges, density and component counts (from the topology operators)."""
    n = nodes(tx).select(F.count("*")).scalar()
    e = edge_pairs(tx).select(F.count("*")).scalar()
    w = weak.select(F.count_distinct("component")).scalar()
    s = strong.select(F.count_distinct("component")).scalar()
    one = tx.sparkSession.range(1).select(
        n.alias("num_accounts"), e.alias("num_edges"),
        w.alias("weakly_connected_components"), s.alias("strongly_connected_components"),
    )
    n, e = F.col("num_accounts"), F.col("num_edges")
    return one.withColumn("density", F.when(n > 1, F.round(e / (n * (n - 1)), 6)).otherwise(0.0))


def ego_nodes(pairs: DataFrame, targets: DataFrame, hops: int = 1) -> DataFrame:
    """Nodes within ``hops`` undirected steps of each target: (target, node, is_target).

    ``targets`` holds ``account_id`` and is matched without regard to case.
    """
    if hops not in (1, 2, 3):
        raise ValueError("hops must be 1, 2 or 3")
    links = undirected(pairs)
    wanted = targets.select(F.lower("account_id").alias("key")).distinct()
    seen = (
        links.select("node").distinct().withColumn("key", F.lower("node")).join(wanted, "key", "left_semi")
        .select(F.col("node").alias("target"), "node")
    )
    frontier = seen
    for _ in range(hops):
        reached = frontier.join(links, "node").select("target", F.col("nbr").alias("node")).distinct()
        frontier = reached.join(seen, ["target", "node"], "left_anti")
        seen = seen.unionByName(frontier)
    return seen.withColumn("is_target", F.col("node") == F.col("target"))


def ego_edges(edge_table: DataFrame, members: DataFrame) -> DataFrame:
    """Edges with both ends among a target's members."""
    ends = members.select("target", "node")
    return (
        edge_table.join(ends.withColumnRenamed("node", "src"), "src")
        .join(ends.withColumnRenamed("node", "dst"), ["target", "dst"])
    )


def ego_counts(members: DataFrame, induced: DataFrame) -> DataFrame:
    counted = members.groupBy("target").agg(F.count("*").alias("node_count"))
    linked = induced.groupBy("target").agg(F.count("*").alias("edge_count"))
    return counted.join(linked, "target", "left").na.fill(0, ["edge_count"])


def ego_filtered(members: DataFrame, reports: DataFrame, mode: str) -> DataFrame:
    """Keep the target and elevated-risk (``ELEVATED``) or patterned (``PATTERNS_ONLY``) nodes."""
    facts = reports.select(F.col("account_id").alias("node"), "risk_level", "patterns")
    keep = {
        "ALL": F.lit(True),
        "ELEVATED": F.coalesce(F.col("risk_level"), F.lit("LOW")) != "LOW",
        "PATTERNS_ONLY": F.coalesce(F.size("patterns"), F.lit(0)) > 0,
    }[mode]
    return members.join(facts, "node", "left").where(F.col("is_target") | keep).select(members.columns)


def suspicious_edges(edge_table: DataFrame, reports: DataFrame) -> DataFrame:
    """Edges with the patterns both ends share and a suspicion flag."""
    def end(prefix: str, key: str) -> DataFrame:
        return reports.select(
            F.col("account_id").alias(key),
            F.col("patterns").alias(f"{prefix}_patterns"), F.col("risk_level").alias(f"{prefix}_level"),
        )

    joined = edge_table.join(end("s", "src"), "src", "left").join(end("d", "dst"), "dst", "left")
    none = F.array().cast("array<string>")
    shared = F.sort_array(F.array_intersect(F.coalesce("s_patterns", none), F.coalesce("d_patterns", none)))
    s, d = F.coalesce("s_level", F.lit("LOW")), F.coalesce("d_level", F.lit("LOW"))
    high = ("HIGH", "CRITICAL")
    return joined.select(
        *edge_table.columns, shared.alias("shared_patterns"),
        ((F.size(shared) > 0) | s.isin(*high) | d.isin(*high)
         | ((s == "MEDIUM") & (d == "MEDIUM"))).alias("is_suspicious"),
    )
