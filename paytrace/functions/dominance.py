"""Counting points in ranges without listing pairs.

A probe asks how many points of its group have a value in ``[lo, hi]`` and a time up to (or from) its own, and for the
newest of them. Points are ranked by value; each belongs to one block of 1, 2, 4, ... consecutive ranks per level, and a
range of ranks is the union of at most two blocks a level. Inside a block, points and probes in time order need only
running counts and extremes. So n points and m probes cost (n + m) log n rows, however many pairs match.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _levels(n: Column) -> Column:
    return F.sequence(F.lit(0), F.floor(F.log2(n)).cast("int"))


def _blocks_of(low: Column, high: Column) -> Column:
    """Blocks (level, block) that together hold the ranks from ``low`` up to, not including, ``high``."""

    def at(level: Column) -> Column:
        one = F.call_function("shiftleft", F.lit(1).cast("long"), level)
        first = F.call_function("shiftright", low + one - 1, level)
        end = F.call_function("shiftright", high, level)
        inside = first < end
        left = F.when(inside & (first % 2 == 1), F.struct(level.alias("level"), first.alias("block")))
        right = F.when(inside & (end % 2 == 1), F.struct(level.alias("level"), (end - 1).alias("block")))
        return F.array_compact(F.array(left, right))

    return F.flatten(F.transform(_levels(high), at))


def count_in_ranges(points: DataFrame, probes: DataFrame, group: Sequence[str], ids: Sequence[str]) -> DataFrame:
    """(*ids, hits, newest, oldest) of probes with at least one point; rows of equal ids are added up (ids may name group columns).

    ``points``: group columns, v, t. ``probes``: group columns, ids, lo, hi, t and ``upto``: true for points with times up to t,
    false for points from t on.
    """
    group, keys = list(group), list(ids)
    ids = [c for c in keys if c not in group]
    none = [F.lit(None).cast(probes.schema[c].dataType).alias(c) for c in ids]
    no_flag = F.lit(None).cast("boolean").alias("upto")
    events = points.select(*group, "v", F.lit(1).alias("kind"), "t", no_flag, *none)
    for kind, edge in ((0, "lo"), (2, "hi")):  # a lower edge comes before equal values, an upper edge behind them
        events = events.unionByName(probes.select(*group, F.col(edge).alias("v"), F.lit(kind).alias("kind"), "t", "upto", *ids))
    is_point = (F.col("kind") == 1).cast("long")
    upto = Window.partitionBy(*group).orderBy("v", "kind").rowsBetween(Window.unboundedPreceding, 0)
    ranked = events.withColumn("below", F.sum(is_point).over(upto)).withColumn(
        "size", F.sum(is_point).over(Window.partitionBy(*group)))
    owned = ranked.where("kind = 1").withColumn("level", F.explode(_levels(F.col("size")))).select(
        *group, "level", F.call_function("shiftright", F.col("below") - 1, F.col("level")).alias("block"), "t",
        F.lit(0).alias("kind"), no_flag, *none)
    edges = ranked.where("kind <> 1").groupBy(*group, *ids, "t", "upto").agg(
        F.max(F.when(F.col("kind") == 0, F.col("below"))).alias("a"), F.max(F.when(F.col("kind") == 2, F.col("below"))).alias("b"))
    asked = edges.where("a < b").withColumn("n", F.explode(_blocks_of(F.col("a"), F.col("b")))).select(
        *group, "n.level", "n.block", "t", F.lit(1).alias("kind"), "upto", *ids)
    place = Window.partitionBy(*group, "level", "block")
    rows = owned.unionByName(asked)
    seen = F.when(F.col("kind") == 0, F.col("t"))
    for name, order in (("older", F.col("t").asc()), ("newer", F.col("t").desc())):  # points before probes of their second
        running = place.orderBy(order, "kind").rowsBetween(Window.unboundedPreceding, 0)
        for what, run in (("hits", F.count), ("last", F.max), ("first", F.min)):
            rows = rows.withColumn(f"{name}_{what}", run(seen).over(running))

    def told(what: str) -> Column:
        return F.when(F.col("upto"), F.col(f"older_{what}")).otherwise(F.col(f"newer_{what}"))

    found = rows.where("kind = 1").select(*keys, told("hits").alias("hits"), told("last").alias("newest"), told("first").alias("oldest"))
    return found.where("hits > 0").groupBy(*keys).agg(
        F.sum("hits").alias("hits"), F.max("newest").alias("newest"), F.min("oldest").alias("oldest"))
