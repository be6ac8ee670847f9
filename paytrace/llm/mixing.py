"""Mixing sources to target token counts by entropy balancing.

Every document gets the rate closest to 1 in relative entropy such that the words of each source meet
its target: ``min(cap, exp(l * size / mean))`` with one multiplier ``l`` per source. The multipliers
solve the convex dual by safeguarded Newton steps; a step is one Spark aggregation over the counts per
(source, size). Rates are then rounded to whole copies.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paytrace.functions.order import running_totals
from paytrace.llm.common import WORD, ranked, scratch, stored

WEIGHTS = (5, 2, 1)
CAP = 3
ROUNDS = 60
CLOSE = 1e-9
GROUP = 256  # documents of one (source, size) that are ranked together
EXACT = "decimal(38,10)"  # sums of rates: exact, so their order does not matter and reruns agree


def word_count(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """Adds target: weight shares of all words, stopped at ``cap`` times the source's own words.

    Resharing the excess until none is above ends at ``min(cap * words, c * weight)`` for one level c,
    and c is the largest of the levels that follow from capping the first k sources by words per weight.
    """
    number = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("nth") % len(weights) + 1).cast("int"))
    weighed = ranked(sources, [F.col("source").asc_nulls_last()], "nth", "sources").select(
        "source", "source_size", "docs", number.cast("long").alias("weight"))
    weighed = weighed.withColumn("most", F.col("source_size") * cap).withColumn(
        "per_weight", F.col("most") / F.col("weight"))
    steps = running_totals(weighed, [], "per_weight", ["most", "weight"], descending=False)
    whole = weighed.agg(F.sum("source_size").alias("s"), F.sum("weight").alias("w"))
    level = steps.agg(F.max((whole.select("s").scalar() - F.col("before_most"))
                            / (whole.select("w").scalar() - F.col("before_weight"))).alias("c"))
    return weighed.withColumn(
        "target", F.least(F.col("most").cast("double"), level.scalar() * F.col("weight"))).drop("per_weight", "weight")


def _rate(cap: int) -> Column:
    open_rate = F.exp(F.least(F.col("mult") * F.col("size") / F.col("mean"), F.lit(50.0)))
    return F.when(F.col("full"), F.lit(float(cap))).otherwise(F.least(F.lit(float(cap)), open_rate))


def multipliers(sizes: DataFrame, wanted: DataFrame, cap: int = CAP) -> DataFrame:
    """One row per source: the multiplier ``mult`` of its rates. ``full`` sources take every word ``cap`` times."""
    ratio = F.col("target") / F.col("source_size")
    state = stored(wanted.select(
        "source", "source_size", "target",
        (F.col("source_size") / F.greatest(F.col("docs"), F.lit(1))).alias("mean"),
        (F.col("target") >= F.col("most")).alias("full"),
        F.when(F.col("source_size") > 0, F.round(F.log(ratio), 12)).otherwise(0.0).alias("mult"),
        F.lit(-1e4).alias("low"), F.lit(1e4).alias("high")), "mult")
    for _ in range(ROUNDS):
        at = sizes.join(state, sizes["source"].eqNullSafe(state["source"])).drop(sizes["source"]).where("size > 0 AND NOT full")
        words = F.col("n") * F.col("size") * _rate(cap)
        slope = F.when(_rate(cap) < cap, words * F.col("size") / F.col("mean")).otherwise(0.0)
        sums = at.groupBy("source").agg(F.sum(words.cast(EXACT)).cast("double").alias("words"),
                                        F.sum(slope.cast(EXACT)).cast("double").alias("slope"))
        joined = state.join(sums.withColumnRenamed("source", "s"), F.col("s").eqNullSafe(F.col("source")), "left").drop("s")
        over = F.col("words") > F.col("target")
        low = F.when(over, F.col("low")).otherwise(F.greatest("low", "mult"))
        high = F.when(over, F.least("high", "mult")).otherwise(F.col("high"))
        newton = F.col("mult") - F.log(F.col("words") / F.col("target")) * F.col("words") / F.col("slope")
        off = F.abs(F.col("words") / F.col("target") - 1)
        moved = joined.withColumn("off", F.coalesce(off, F.lit(0.0))).withColumn("new_low", low).withColumn("new_high", high)
        inside = (F.col("newton") > F.col("new_low")) & (F.col("newton") < F.col("new_high"))
        moved = moved.withColumn("newton", newton).withColumn("next", F.round(
            F.when(inside, F.col("newton")).otherwise((F.col("new_low") + F.col("new_high")) / 2), 13))
        keep = (F.col("off") <= CLOSE) | F.col("words").isNull()
        state = stored(moved.select(
            "source", "source_size", "target", "mean", "full", F.when(keep, F.col("mult")).otherwise(F.col("next")).alias("mult"),
            F.coalesce("new_low", F.lit(-1e4)).alias("low"), F.coalesce("new_high", F.lit(1e4)).alias("high"), "off"), "mult")
        if (state.agg(F.max("off")).first()[0] or 0.0) <= CLOSE:
            break
        state = state.drop("off")
    return state.select("source", "source_size", "target", "mean", "full", "mult")


def _round_sizes(rows: pd.DataFrame) -> pd.DataFrame:
    """Copies per size of one source, from the largest size down; each size makes up for what those above left over."""
    rows = rows.sort_values("size", ascending=False, kind="stable")
    carry, copies = 0.0, []
    for size, n, rate, cap in zip(rows["size"], rows["n"], rows["rate"], rows["cap"]):
        if size == 0:
            copies.append(n)
            continue
        want = n * rate * size + carry
        taken = int(min(max(round(want / size), 0), cap * n))
        carry = want - taken * size
        copies.append(taken)
    rows["copies_all"] = copies
    return rows[["source", "size", "n", "rate", "copies_all"]]


def balance(documents: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """Per document: doc_id, source, size, source_size, target, rate, copies, taken.

    Null text has size 0; documents of size 0 keep one copy, which takes no words. Null is a source of its
    own, last in order. Documents of one source and size share a rate and get copies that differ by one at
    most, in the order of a hash of doc_id; rows that repeat a doc_id get equal copies. A group handed to
    one Python call has one row per distinct size of a source, at most sqrt(2 * words) of them. An empty
    table gives an empty result.
    """
    rows = stored(documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"),
                                   word_count().alias("size")), "sizes")
    sizes = stored(rows.groupBy("source", "size").agg(F.count("*").alias("n")), "hist")
    sources = sizes.groupBy("source").agg(F.sum(F.col("n") * F.col("size")).alias("source_size"), F.sum("n").alias("docs"))
    solved = multipliers(sizes, targets(sources, weights, cap), cap)
    rated = sizes.join(solved.withColumnRenamed("source", "s"), F.col("s").eqNullSafe(F.col("source"))).withColumn(
        "rate", _rate(cap)).select("source", "size", "n", "rate", F.lit(cap).alias("cap"))
    whole = rated.groupBy("source").applyInPandas(
        _round_sizes, "source string, size long, n long, rate double, copies_all long")
    whole = stored(whole, "copies").select(
        F.col("source").alias("s"), F.col("size").alias("z"), "n", "rate", "copies_all",
        F.ceil(F.col("n") / GROUP).alias("parts"))
    drawn = rows.join(whole, F.col("s").eqNullSafe(F.col("source")) & (F.col("z") == F.col("size"))).drop("s", "z")
    drawn = drawn.withColumn("h", F.xxhash64("doc_id")).withColumn("part", F.pmod("h", F.col("parts")))
    counts = drawn.groupBy("source", "size", "part").agg(F.count("*").alias("c"))
    prior = Window.partitionBy("source", "size").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(F.col("source").alias("s"), F.col("size").alias("z"), F.col("part").alias("p"),
                           F.coalesce(F.sum("c").over(prior), F.lit(0)).alias("start"))
    place = F.rank().over(Window.partitionBy("source", "size", "part").orderBy("h", "doc_id")) - 1
    drawn = drawn.withColumn("place", place).join(
        starts, F.col("s").eqNullSafe(F.col("source")) & (F.col("z") == F.col("size")) & (F.col("p") == F.col("part")))
    more = (F.col("start") + F.col("place")) < F.col("copies_all") % F.col("n")
    drawn = drawn.withColumn("copies", (F.expr("copies_all div n") + more.cast("long")).cast("int")).drop("s", "z", "p")
    of = solved.select(F.col("source").alias("s"), "source_size", "target")
    return drawn.join(of, F.col("s").eqNullSafe(F.col("source"))).select(
        "doc_id", "source", "size", "source_size", "target", "rate", "copies",
        (F.col("copies") * F.col("size")).cast("long").alias("taken"))


def repeat(documents: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """The rows of ``documents``, each as often as its copies say, all columns as they were."""
    with scratch() as kept:
        copies = kept(stored(balance(documents, weights, cap).select(
            F.col("doc_id").alias("__id"), F.col("source").alias("__source"), F.col("size").alias("__size"),
            F.col("copies").alias("__copies")).distinct(), "drawn"))
    sized = documents.withColumn("__words", word_count())
    on = (F.col("__id").eqNullSafe(F.col("doc_id").cast("long")) & F.col("__source").eqNullSafe(F.col("source"))
          & (F.col("__size") == F.col("__words")))
    times = F.explode(F.sequence(F.lit(1), F.col("__copies")))
    return sized.join(copies.where("__copies > 0").hint("merge"), on).select(
        *documents.columns, times.alias("__nth")).drop("__nth")
