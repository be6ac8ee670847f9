"""Exact order statistics and running totals that never gather a column in one task.

``percentile`` and an unpartitioned window both pull every distinct value into one reducer. These
helpers first cut the value range at approximate quantiles and then work per slice, so each task
holds one slice. The cuts only decide how work is split; results are exact for any cut.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ACCURACY = 10_000


def exact_percentiles(df: DataFrame, wanted: dict[str, tuple[str, float]]) -> dict[str, float | None]:
    """Exact linearly interpolated percentiles of whole columns.

    ``wanted`` maps an output name to (column, p). An approximate percentile with a proven rank error
    brackets each rank; only values inside the brackets are ranked, so the ranked part stays at about
    ``4 / ACCURACY`` of the distinct values however large the input is. Returns plain numbers: one per
    request. An empty column gives ``None``.
    """
    spark = df.sparkSession
    columns = sorted({c for c, _ in wanted.values()})
    values = F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("v")) for c in columns]))
    long = df.select(values.alias("s")).select("s.*").where("v IS NOT NULL")
    n = {r["name"]: r["n"] for r in long.groupBy("name").agg(F.count("*").alias("n")).collect()}
    if not n:
        return dict.fromkeys(wanted)
    eps = 2.0 / ACCURACY + 2.0 / min(n.values())
    points = sorted({p for _, p in wanted.values()})
    ends = F.array(*[F.lit(min(1.0, max(0.0, p + d))) for p in points for d in (-eps, eps)])
    near = {
        r["name"]: r["b"]
        for r in long.groupBy("name").agg(F.percentile_approx("v", ends, F.lit(ACCURACY)).alias("b")).collect()
    }
    slots = [
        (out, c, near[c][2 * points.index(p)], near[c][2 * points.index(p) + 1], p * (n[c] - 1))
        for out, (c, p) in wanted.items() if c in n
    ]
    # One row per request, so the broadcast is as small as the request list.
    table = spark.createDataFrame(slots, "out string, name string, lo double, hi double, pos double")
    listed = (
        long.join(F.broadcast(table), "name").where(F.col("v") <= F.col("hi"))
        .groupBy("out", "pos", F.when(F.col("v") >= F.col("lo"), F.col("v")).alias("v")).agg(F.count("*").alias("c"))
    )
    # v is null for everything below the bracket; nulls sort first.
    upto = Window.partitionBy("out").orderBy(F.col("v").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    ranked = listed.withColumn("end", F.sum("c").over(upto)).withColumn("start", F.col("end") - F.col("c"))
    k0, k1 = F.floor("pos"), F.ceil("pos")
    picks = ranked.groupBy("out", "pos").agg(
        F.max(F.when((F.col("start") <= k0) & (k0 < F.col("end")), F.col("v"))).alias("v0"),
        F.max(F.when((F.col("start") <= k1) & (k1 < F.col("end")), F.col("v"))).alias("v1"),
    )
    result: dict[str, float | None] = dict.fromkeys(wanted)
    for row in picks.collect():
        if row.v0 is None or row.v1 is None:
            raise ArithmeticError(f"rank of {row.out} fell outside its bracket")
        result[row.out] = row.v0 + (row.v1 - row.v0) * (row.pos - int(row.pos))
    return result


def numbered(df: DataFrame, key: str, seed: int, name: str, slices: int = 1024) -> DataFrame:
    """Adds 0-based row numbers in a random order fixed by ``seed``, without a global sort."""
    placed = df.withColumn("__h", F.xxhash64(F.lit(seed), F.col(key))).withColumn("__s", F.pmod("__h", F.lit(slices)))
    sizes = placed.groupBy("__s").agg(F.count("*").alias("c"))
    prior = Window.orderBy("__s").rowsBetween(Window.unboundedPreceding, -1)  # one row per slice
    offsets = sizes.select("__s", F.coalesce(F.sum("c").over(prior), F.lit(0)).alias("__off"))
    inside = Window.partitionBy("__s").orderBy("__h", key)
    return placed.withColumn("__r", F.row_number().over(inside)).join(offsets, "__s").withColumn(
        name, F.col("__r") - 1 + F.col("__off")).drop("__h", "__s", "__r", "__off")


def running_totals(
    df: DataFrame,
    group: Sequence[str],
    key: str,
    values: Sequence[str],
    descending: bool = True,
    slices: int = 256,
) -> DataFrame:
    """Inclusive running totals of ``values`` over ``key`` within ``group``; one row per distinct key.

    Adds ``cum_<value>`` and ``before_<value>``. Ties on the key are one step. A group of any size is
    split into key slices: totals per slice are summed first, then each slice is scanned on its own.
    """
    group = list(group)
    steps = df.groupBy(*group, key).agg(*[F.sum(v).alias(v) for v in values])
    grid = F.array(*[F.lit(i / slices) for i in range(1, slices)])
    cuts = steps.groupBy(*group).agg(F.array_distinct(F.percentile_approx(key, grid, F.lit(slices * 4))).alias("cuts"))
    if group:
        placed = steps.join(cuts, group)
    else:
        placed = steps.withColumn("cuts", cuts.scalar())
    placed = placed.withColumn(
        "slice", F.size(F.filter("cuts", lambda c: c < F.col(key)))
    ).drop("cuts")
    order = F.desc if descending else F.asc
    per_slice = placed.groupBy(*group, "slice").agg(*[F.sum(v).alias(v) for v in values])
    prior = Window.partitionBy(*group).orderBy(order("slice")).rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_slice.select(
        *group, "slice", *[F.coalesce(F.sum(v).over(prior), F.lit(0)).alias(f"off_{v}") for v in values]
    )
    inside = Window.partitionBy(*group, "slice").orderBy(order(key)).rowsBetween(Window.unboundedPreceding, 0)
    out = placed.join(offsets, [*group, "slice"])
    for v in values:
        out = out.withColumn(f"cum_{v}", F.sum(v).over(inside) + F.col(f"off_{v}"))
        out = out.withColumn(f"before_{v}", F.col(f"cum_{v}") - F.col(v))
    return out.drop("slice", *[f"off_{v}" for v in values])


def timeline_totals(df: DataFrame, group: Sequence[str], t: str, width: int, values: dict[str, Column]) -> DataFrame:
    """Running totals over time per group, split by time slice so a hot group is many small windows.

    ``df`` should already hold one row per (group, t). Adds the running total of each value under its
    name; the per-slice totals scanned per group are one row per ``width`` seconds.
    """
    group = list(group)
    names = list(values)
    placed = df.select("*", F.floor(F.col(t) / width).cast("bigint").alias("slice"),
                       *[values[n].alias(f"__{n}") for n in names])
    per_slice = placed.groupBy(*group, "slice").agg(*[F.sum(f"__{n}").alias(n) for n in names])
    prior = Window.partitionBy(*group).orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_slice.select(
        *group, "slice", *[F.coalesce(F.sum(n).over(prior), F.lit(0)).alias(f"off_{n}") for n in names]
    )
    inside = Window.partitionBy(*group, "slice").orderBy(t).rowsBetween(Window.unboundedPreceding, 0)
    out = placed.join(offsets, [*group, "slice"])
    for n in names:
        out = out.withColumn(n, F.sum(f"__{n}").over(inside) + F.col(f"off_{n}"))
    return out.drop("slice", *[f"__{n}" for n in names], *[f"off_{n}" for n in names])


def running_before(df: DataFrame, group: Sequence[str], order: str, t: str, width: int, name: str, value: Column) -> DataFrame:
    """Adds ``name``: the sum of ``value`` over earlier rows of the group in ``order``.

    ``order`` must sort by ``t`` first. Each group is cut into ``width``-second slices, so the sort of a
    hot group is spread over its slices.
    """
    group = list(group)
    placed = df.withColumn("__slice", F.floor(F.col(t) / width).cast("bigint")).withColumn("__v", value)
    per_slice = placed.groupBy(*group, "__slice").agg(F.sum("__v").alias("__s"))
    prior = Window.partitionBy(*group).orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_slice.select(*group, "__slice", F.coalesce(F.sum("__s").over(prior), F.lit(0)).alias("__off"))
    inside = Window.partitionBy(*group, "__slice").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return (
        placed.withColumn(name, F.coalesce(F.sum("__v").over(inside), F.lit(0)))
        .join(offsets, [*group, "__slice"]).withColumn(name, F.col(name) + F.col("__off"))
        .drop("__slice", "__v", "__off")
    )
