"""Pattern detectors over transfers and pairs."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.exprs import bucket, dbl, fundable, near_threshold, postings
from ..functions.dominance import count_in_ranges
from ..functions.order import timeline_totals
from ..sources.session import cut
from . import graph

DENSE_PAIRS = 1 << 16  # pairs of one (account, time slice, amount cell) beyond which they are counted, not joined


# ------------------------------------------------------------------ distinct in a sliding window
def max_distinct_in_window(events: DataFrame, window: int = fixed.TWO_HOURS) -> DataFrame:
    """Most distinct counterparties inside any window ``[t - window, t]``: (account_id, burst).

    ``events`` holds account_id, counterparty, t. A counterparty counts from a transfer until
    ``window`` seconds after its last one, so each quiet stretch opens with +1 and closes with -1 and
    the answer is the highest running sum. No set is ever collected: rows are combined per second,
    and the running sum of a hot account is split by day.
    """
    seen = events.select("account_id", "counterparty", "t").distinct()
    own = Window.partitionBy("account_id", "counterparty").orderBy("t")
    edge = seen.select(
        "account_id", "t",
        (F.col("t") - F.lag("t").over(own)).alias("before"),
        (F.lead("t").over(own) - F.col("t")).alias("after"),
    )
    steps = F.array_compact(F.array(
        F.when(F.col("before").isNull() | (F.col("before") > window), F.struct("t", F.lit(1).alias("step"))),
        F.when(F.col("after").isNull() | (F.col("after") > window),
               F.struct((F.col("t") + window + 1).alias("t"), F.lit(-1).alias("step"))),
    ))
    deltas = (
        edge.select("account_id", F.explode(steps).alias("s")).select("account_id", "s.*")
        .groupBy("account_id", "t").agg(F.sum("step").alias("step"))
    )
    running = timeline_totals(deltas, ["account_id"], "t", fixed.DAY, {"active": F.col("step")})
    return running.groupBy("account_id").agg(F.max("active").alias("burst"))


def _fan(tx: DataFrame, degree: DataFrame, inward: bool, min_degree: int, min_ratio: float, window: int | None) -> DataFrame:
    many, few = ("in_degree", "out_degree") if inward else ("out_degree", "in_degree")
    ratio = F.col(many) / F.when(F.col(few) > 0, dbl(few)).otherwise(0.5)
    candidates = degree.where((F.col(many) >= min_degree) & (ratio >= min_ratio)).select(
        "account_id", "in_degree", "out_degree", F.round(ratio, 2).alias("ratio"))
    me, other = ("receiver_id", "sender_id") if inward else ("sender_id", "receiver_id")
    # Only candidates pay for the window scan.
    own = tx.select(F.col(me).alias("account_id"), F.col(other).alias("counterparty"), "t", "amount").join(
        candidates.select("account_id"), "account_id", "left_semi")
    total = own.groupBy("account_id").agg(F.round(dbl(F.sum("amount")), 2).alias("total_amount"))
    out = candidates.join(total, "account_id")
    if window is None:
        return out.withColumn("burst", F.lit(None).cast("bigint"))
    return out.join(max_distinct_in_window(own, window), "account_id").where(F.col("burst") >= min_degree)


def fan_in(tx: DataFrame, degree: DataFrame, min_degree=fixed.FAN_MIN_DEGREE, min_ratio=fixed.FAN_MIN_RATIO,
           window: int | None = fixed.TWO_HOURS) -> DataFrame:
    """Collectors: many distinct payers, few payees, and a burst of payers."""
    return _fan(tx, degree, True, min_degree, min_ratio, window)


def fan_out(tx: DataFrame, degree: DataFrame, min_degree=fixed.FAN_MIN_DEGREE, min_ratio=fixed.FAN_MIN_RATIO,
            window: int | None = fixed.TWO_HOURS) -> DataFrame:
    """Distributors: the mirror image of fan-in."""
    return _fan(tx, degree, False, min_degree, min_ratio, window)


def fan_members(found: DataFrame, pairs: DataFrame, inward: bool) -> DataFrame:
    """The payers of each collector or payees of each distributor, in long form."""
    me, other = ("dst", "src") if inward else ("src", "dst")
    return pairs.select(F.col(me).alias("account_id"), F.col(other).alias("member")).join(
        found.select("account_id"), "account_id", "left_semi")


# ------------------------------------------------------------------------------- banded joins
def _cells(low: Column, high: Column, span: float) -> Column:
    """Logarithmic amount cells that cover [low, high]; the factor guards against rounding in log."""
    base = math.log(span)
    a = F.floor(F.log(dbl(low) * (1 - 1e-9)) / base)
    b = F.floor(F.log(dbl(high) * (1 + 1e-9)) / base)
    return F.explode(F.sequence(a.cast("bigint"), b.cast("bigint")))


def _cell(amount: Column, span: float) -> Column:
    return F.floor(F.log(dbl(amount)) / math.log(span)).cast("bigint")


def funding_links(tx: DataFrame, window: int, strict: bool, min_amount=fixed.FLOW_MIN_AMOUNT) -> DataFrame:
    """Receipts that could fund a payment of the same account, one row per (receipt, payment).

    An equi-join on (account, time slice, amount cell): slices are one window wide and cells one ratio
    band wide, so a payment probes four cells and meets few receipts outside its band. ``strict``
    leaves out receipts of the same second and payments below 0.7 x ``min_amount``. Callers aggregate
    the rows at once; they are combined where they arise and never shuffled as pairs.
    """
    low, high = fixed.FLOW_MIN_RATIO, fixed.FLOW_MAX_RATIO
    span = float(high / low)
    receipts = tx.where(F.col("amount") >= F.lit(min_amount)).select(
        F.col("receiver_id").alias("account_id"), bucket("t", window).alias("slice"),
        _cell(F.col("amount"), span).alias("cell"),
        F.col("transaction_id").alias("receipt_id"), F.col("sender_id").alias("payer"),
        F.col("amount").alias("receipt_amount"), F.col("t").alias("receipt_t"),
    )
    probe = F.explode(F.array(bucket("t", window), bucket("t", window) - 1)).alias("slice")
    payments = tx.where(F.col("amount") >= F.lit(low * min_amount)).select(
        F.col("sender_id").alias("account_id"), F.col("transaction_id").alias("payment_id"),
        F.col("receiver_id").alias("payee"), F.col("amount").alias("payment_amount"), F.col("t").alias("payment_t"),
        probe,
    ).select("*", _cells(dbl("payment_amount") / float(high), dbl("payment_amount") / float(low), span).alias("cell"))
    wait = F.col("payment_t") - F.col("receipt_t")
    in_time = (wait > 0) if strict else (wait >= 0)
    return (
        payments.join(receipts, ["account_id", "slice", "cell"])
        .where(in_time & (wait <= window) & fundable(F.col("receipt_amount"), F.col("payment_amount")))
        .drop("slice", "cell").withColumn("latency", wait)
    )


def _units(amount: Column) -> Column:
    """Amount in 1/10,000 units, so that the ratio test is exact integer arithmetic."""
    return (amount * 10000).cast("bigint")


def _split_dense(points: DataFrame, probes: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Points and probes of calm cells, then those of cells in which a join would compare too many pairs."""
    key = ["account_id", "slice", "cell"]
    load = points.groupBy(*key).agg(F.count("*").alias("n")).join(probes.groupBy(*key).agg(F.count("*").alias("m")), key)
    dense = cut(load.where(F.col("n") * F.col("m") > DENSE_PAIRS).select(*key))
    if dense.isEmpty():
        return points, probes, points.limit(0), probes.limit(0)
    return (points.join(dense, key, "left_anti"), probes.join(dense, key, "left_anti"),
            points.join(dense, key, "left_semi"), probes.join(dense, key, "left_semi"))


def _matched(points: DataFrame, probes: DataFrame, ids: list[str], window: int, strict: bool, before: bool) -> DataFrame:
    """(*ids, hits, newest, oldest): points with a value in [lo, hi] at most ``window`` seconds before (or after) each probe.

    ``points``: account_id, v, t; ``probes``: account_id, ids, lo, hi, t. An equi-join on (account, time slice, amount cell)
    where few pairs meet; cells that many meet in are counted by ranks and running totals, no pair is listed.
    """
    span = float(fixed.FLOW_MAX_RATIO / fixed.FLOW_MIN_RATIO)
    gap = 1 if strict else 0
    placed = points.select("account_id", bucket("t", window).alias("slice"), _cell(F.col("v"), span).alias("cell"), "v", "t")
    here = bucket("t", window)
    # in its own slice the probe's time decides, in the neighbouring one the far end of the window
    near, far = ((F.col("t") - gap, F.col("t") - window) if before else (F.col("t") + gap, F.col("t") + window))
    ends = F.explode(F.array(
        F.struct(here.alias("slice"), near.alias("edge"), F.lit(before).alias("upto")),
        F.struct((here - 1 if before else here + 1).alias("slice"), far.alias("edge"), F.lit(not before).alias("upto"))))
    asked = probes.where("lo <= hi").select("*", ends.alias("e")).select(
        "account_id", *[c for c in ids if c != "account_id"], "lo", "hi", F.col("e.slice").alias("slice"), F.col("e.edge").alias("t"), F.col("e.upto").alias("upto"),
        _cells(F.col("lo"), F.col("hi"), span).alias("cell"))
    calm, calm_asked, dense, dense_asked = _split_dense(placed, asked)
    pairs = calm_asked.withColumnRenamed("t", "edge").join(calm, ["account_id", "slice", "cell"]).where(
        F.col("v").between(F.col("lo"), F.col("hi")) & F.when(F.col("upto"), F.col("t") <= F.col("edge")).otherwise(F.col("t") >= F.col("edge")))
    counted = count_in_ranges(dense, dense_asked, ["account_id", "slice", "cell"], ids)
    return pairs.select(*ids, F.lit(1).cast("bigint").alias("hits"), F.col("t").alias("newest"), F.col("t").alias("oldest")).unionByName(counted).groupBy(*ids).agg(
        F.sum("hits").alias("hits"), F.max("newest").alias("newest"), F.min("oldest").alias("oldest"))


def _flows(tx: DataFrame, min_amount) -> tuple[DataFrame, DataFrame]:
    """Receipts that count and payments large enough to pass one on, in exact units."""
    receipts = tx.where(F.col("amount") >= F.lit(min_amount)).select(
        F.col("receiver_id").alias("account_id"), F.col("sender_id").alias("payer"), _units(F.col("amount")).alias("units"), "t")
    payments = tx.where(F.col("amount") >= F.lit(fixed.FLOW_MIN_RATIO * min_amount)).select(
        F.col("sender_id").alias("account_id"), F.col("transaction_id").alias("payment_id"), F.col("receiver_id").alias("payee"),
        F.col("t").alias("payment_t"), F.col("amount").alias("payment_amount"), _units(F.col("amount")).alias("units"))
    return receipts, payments


def funded_payments(tx: DataFrame, window: int, strict: bool, min_amount=fixed.FLOW_MIN_AMOUNT) -> DataFrame:
    """Payments that receipts of the ``window`` seconds before could fund: how many, the shortest and the longest wait.

    The counts of ``funding_links`` without its pairs: an account with very many receipts and payments of like amounts in
    one slice costs n log n.
    """
    receipts, payments = _flows(tx, min_amount)
    ids = ["account_id", "payment_id", "payee", "payment_t", "payment_amount"]
    low, high = (int(10 * r) for r in (fixed.FLOW_MIN_RATIO, fixed.FLOW_MAX_RATIO))
    asked = payments.withColumn("t", F.col("payment_t")).withColumn("lo", F.ceil(F.col("units") * 10 / F.lit(high).cast("decimal(10,0)")).cast("bigint")).withColumn(
        "hi", F.floor(F.col("units") * 10 / F.lit(low).cast("decimal(10,0)")).cast("bigint"))
    found = _matched(receipts.select("account_id", F.col("units").alias("v"), "t"), asked.drop("units"), ids, window, strict, True)
    return found.select(*ids, (F.col("payment_t") - F.col("newest")).alias("latency"), F.col("hits").alias("matches"),
                        (F.col("payment_t") - F.col("oldest")).alias("longest"))


def rapid_payments(tx: DataFrame, window: int = fixed.HOUR, min_amount=fixed.FLOW_MIN_AMOUNT) -> DataFrame:
    """Payments that pass a receipt on within the window, with the shortest wait and receipts matched."""
    return funded_payments(tx, window, strict=False, min_amount=min_amount).drop("longest")


def rapid_movement(payments: DataFrame) -> DataFrame:
    """Intermediaries: matched pairs, distinct forwards and destinations, fastest wait."""
    per_target = payments.groupBy("account_id", "payee").agg(
        F.sum("matches").alias("matches"), F.count_distinct("payment_t").alias("forwards"),
        F.min("latency").alias("fastest"))
    return per_target.groupBy("account_id").agg(
        F.sum("matches").alias("match_count"), F.sum("forwards").alias("forwards"),
        F.count("*").alias("destinations"), F.min("fastest").alias("fastest_latency_seconds"))


def rapid_members(tx: DataFrame, window: int = fixed.HOUR, min_amount=fixed.FLOW_MIN_AMOUNT) -> DataFrame:
    """Payers and payees of the matched receipts and payments, in long form."""
    receipts, payments = _flows(tx, min_amount)
    low, high = (int(10 * r) for r in (fixed.FLOW_MIN_RATIO, fixed.FLOW_MAX_RATIO))
    asked = receipts.groupBy("account_id", "payer", "units", "t").agg(
        F.ceil(F.col("units") * low / F.lit(10).cast("decimal(10,0)")).cast("bigint").alias("lo"),
        F.floor(F.col("units") * high / F.lit(10).cast("decimal(10,0)")).cast("bigint").alias("hi"))
    points = payments.select("account_id", F.col("units").alias("v"), F.col("payment_t").alias("t"))
    paid = _matched(points, asked, ["account_id", "payer"], window, False, False).select("account_id", F.col("payer").alias("member"))
    sent = funded_payments(tx, window, False, min_amount).select("account_id", F.col("payee").alias("member"))
    return paid.unionByName(sent).distinct()


# -------------------------------------------------------------------------------- structuring
def near_events(tx: DataFrame, threshold=fixed.REPORTING_THRESHOLD) -> DataFrame:
    """Near-threshold transfers seen from both ends, with the role of each end."""
    near = tx.where(near_threshold(F.col("amount"), threshold))
    return postings(near.select("sender_id", "receiver_id", "amount", "t")).select(
        "account_id", F.when(F.col("is_out"), "splitter").otherwise("collector").alias("role"),
        "counterparty", "amount", "t")


def structuring(tx: DataFrame, threshold=fixed.REPORTING_THRESHOLD, min_transactions: int = 3,
                window: int = fixed.DAY) -> DataFrame:
    """Accounts whose busiest window holds enough near-threshold transfers that exceed the threshold.

    The busiest window ends at the earliest second with the highest count. Transfers are combined per
    second, then each window-wide time slice is scanned with the slice before it as history, so a hot
    account is many bounded windows.
    """
    seconds = near_events(tx, threshold).groupBy("account_id", "role", "t").agg(
        F.count("*").alias("c"), F.sum("amount").alias("s"), F.max("amount").alias("m"))
    home = bucket("t", window)
    placed = seconds.select("*", home.alias("home"), F.explode(F.array(home, home + 1)).alias("slice"))
    back = Window.partitionBy("account_id", "role", "slice").orderBy("t").rangeBetween(-window, 0)
    ending = placed.select(
        "account_id", "role", "t", "home", "slice",
        F.sum("c").over(back).alias("n"), F.sum("s").over(back).alias("total"),
        F.max("m").over(back).alias("largest"), F.min("t").over(back).alias("start"),
    ).where("home = slice")
    best = ending.groupBy("account_id", "role").agg(
        F.max(F.struct("n", (-F.col("t")).alias("neg_end"), "total", "largest", "start")).alias("b"))
    return best.where((F.col("b.n") >= min_transactions) & (F.col("b.total") > F.lit(threshold))).select(
        "account_id", "role", F.col("b.n").alias("near_threshold_count"),
        F.round(dbl("b.total"), 2).alias("total_amount"), F.round(dbl("b.largest"), 2).alias("largest_amount"),
        F.lit(float(threshold)).alias("reporting_threshold"),
        F.col("b.start").alias("window_start"), (-F.col("b.neg_end")).alias("window_end"),
    )


def structuring_members(found: DataFrame, tx: DataFrame, threshold=fixed.REPORTING_THRESHOLD) -> DataFrame:
    """Counterparties inside each reported window, in long form."""
    return (
        near_events(tx, threshold).join(found.select("account_id", "role", "window_start", "window_end"), ["account_id", "role"])
        .where("t BETWEEN window_start AND window_end")
        .select("account_id", "role", F.col("counterparty").alias("member")).distinct()
    )


# ------------------------------------------------------------------- circular flow, exhaustive
def circular_flows(tx: DataFrame, strong: DataFrame | None = None, lengths=(3, 4, 5, 6),
                   window: int = fixed.LOOP_WINDOW, low=fixed.LOOP_MIN_RATIO, high=fixed.LOOP_MAX_RATIO) -> DataFrame:
    """Every loop of distinct accounts that money travels in time order: one row per node cycle.

    Each hop starts no earlier than the one before, the loop closes within ``window`` of its first
    hop, and each amount lies in [low, high] x the previous one. A loop is put together from two paths of at
    most three hops that meet at both ends: the second begins where the first ends and ends where it begins. Hops and halves
    are joined on (account, time slice, amount cell), halves on both accounts, so open paths never grow beyond
    half a loop. Transfers outside strong components of three or more accounts cannot take part and are dropped first
    when ``strong`` is given. The reported instance is the earliest one.
    """
    span = float(high / low)
    hop = F.struct(F.col("sender_id").alias("src"), F.col("receiver_id").alias("dst"), "amount", "t", "transaction_id")
    use = tx.select("sender_id", "receiver_id", "amount", "t", "transaction_id")
    if strong is not None:
        inside = strong.where("component_size >= 3").select("account_id", "component")
        use = (
            use.join(inside.toDF("sender_id", "c1"), "sender_id").join(inside.toDF("receiver_id", "c2"), "receiver_id")
            .where("c1 = c2").drop("c1", "c2")
        )
    use = cut(use)
    single = use.select(
        F.col("sender_id").alias("start"), F.col("receiver_id").alias("at"), F.col("t").alias("start_t"), F.col("t").alias("last_t"),
        F.col("amount").alias("first_amount"), F.col("amount").alias("last_amount"), F.array("sender_id", "receiver_id").alias("path"), F.array(hop).alias("hops"))

    def ahead(paths: DataFrame) -> DataFrame:
        """Paths with the slices and cells in which they may go on."""
        slices = F.sequence(bucket("last_t", window), bucket(F.col("start_t") + window, window))
        return paths.select("*", F.explode(slices).alias("slice")).select(
            "*", _cells(dbl("last_amount") * float(low), dbl("last_amount") * float(high), span).alias("cell"))

    def coming(paths: DataFrame) -> DataFrame:
        """The same paths as what comes next, by the slice and cell they begin in."""
        named = paths.select(*[F.col(c).alias(f"n_{c}") for c in paths.columns])
        return named.withColumn("slice", bucket("n_start_t", window)).withColumn("cell", _cell(F.col("n_first_amount"), span))

    fits = ((F.col("n_start_t") >= F.col("last_t")) & (F.col("n_last_t") <= F.col("start_t") + window)
            & (F.col("n_first_amount") >= F.lit(low) * F.col("last_amount")) & (F.col("n_first_amount") <= F.lit(high) * F.col("last_amount")))
    here = (F.col("n_start") == F.col("at")) & (F.col("n_slice") == F.col("slice")) & (F.col("n_cell") == F.col("cell"))

    def met(first: DataFrame, second: DataFrame, extra: Column) -> DataFrame:
        other = coming(second).withColumnsRenamed({"slice": "n_slice", "cell": "n_cell"})
        return ahead(first).join(other, here & extra).where(fits)

    halves = {1: single}
    for n in range(2, (max(lengths) + 1) // 2 + 1):
        longer = met(halves[n - 1], single, ~F.array_contains("path", F.col("n_at"))).select(
            "start", F.col("n_at").alias("at"), "start_t", F.col("n_last_t").alias("last_t"), "first_amount",
            F.col("n_last_amount").alias("last_amount"), F.concat("path", F.array("n_at")).alias("path"), F.concat("hops", "n_hops").alias("hops"))
        halves[n] = cut(longer)
    loops = None
    for length in lengths:
        first = (length + 1) // 2
        inner = F.slice("n_path", F.lit(2), F.lit(length - first - 1))
        closed = met(halves[first], halves[length - first], F.col("n_at") == F.col("start")).where(~F.arrays_overlap(inner, "path")).select(
            F.concat("path", inner).alias("path"), F.lit(length).alias("length"), "start_t", F.col("n_last_t").alias("end_t"),
            "first_amount", F.col("n_last_amount").alias("closing_amount"), F.concat("hops", "n_hops").alias("hops"))
        loops = closed if loops is None else loops.unionByName(closed)
    first = F.array_position("path", F.array_min("path")).cast("int")
    canonical = F.concat(F.slice("path", first, F.size("path")), F.slice("path", F.lit(1), first - 1))
    ids = F.array_join(F.transform("hops", lambda h: h["transaction_id"]), ">")
    order = F.struct("start_t", "end_t", "first_amount", "closing_amount", ids.alias("ids"), "hops")
    best = loops.select(canonical.alias("nodes"), "length", order.alias("o")).groupBy("nodes", "length").agg(
        F.min("o").alias("o"), F.count("*").alias("instances"))
    return best.select(
        "nodes", "length", "instances", (F.col("o.end_t") - F.col("o.start_t")).alias("loop_duration_seconds"),
        F.round(dbl("o.closing_amount") / dbl("o.first_amount"), 3).alias("amount_retained_ratio"),
        F.col("o.start_t").alias("t"), F.col("o.hops").alias("hops"),
    )


# ----------------------------------------------------------------- transaction chain, exhaustive
def transaction_chains(pairs: DataFrame, min_hops: int = 3) -> DataFrame:
    """Every simple path of ``min_hops`` to ``min_hops + 2`` hops from accounts nobody pays.

    Without such accounts every payer is a start. This lists all paths and is meant for networks
    small enough to search exhaustively; flow tracing finds chains at any size.
    """
    paid = pairs.select(F.col("dst").alias("src")).distinct()
    payers = pairs.select("src").distinct()
    sources = payers.join(paid, "src", "left_anti")
    starts = payers if sources.isEmpty() else sources
    paths = pairs.join(starts, "src", "left_semi").select(F.array("src", "dst").alias("path"), F.col("dst").alias("at"))
    step = pairs.select(F.col("src").alias("at"), F.col("dst").alias("to"))
    found = None
    for hops in range(2, min_hops + 3):
        paths = paths.join(step, "at").where(~F.array_contains("path", F.col("to"))).select(
            F.concat("path", F.array("to")).alias("path"), F.col("to").alias("at"))
        if hops >= min_hops:
            rows = paths.select("path", F.lit(hops).alias("hops"))
            found = rows if found is None else found.unionByName(rows)
    return found.select("path", "hops", F.element_at("path", 1).alias("start"), F.element_at("path", -1).alias("end"))


def members_of(lists: DataFrame, column: str) -> DataFrame:
    return lists.select(F.explode(column).alias("account_id")).distinct()


# ------------------------------------------------------------------------- coordinated network
def coordinated_networks(pairs: DataFrame, strong: DataFrame, min_size: int = 4, min_density: float = 0.4) -> DataFrame:
    """Strong components that are large and dense enough: (component, size, edge_count, density)."""
    big = strong.where(F.col("component_size") >= min_size).select("account_id", "component", "component_size")
    inner = (
        pairs.join(big.select(F.col("account_id").alias("src"), "component", "component_size"), "src")
        .join(big.select(F.col("account_id").alias("dst"), F.col("component").alias("c2")), "dst")
        .where("component = c2").groupBy("component", F.col("component_size").alias("size"))
        .agg(F.count("*").alias("edge_count"))
    )
    density = F.col("edge_count") / (F.col("size") * (F.col("size") - 1))
    return inner.where(density >= min_density).withColumn("density", F.round(density, 3))


def coordinated_members(networks: DataFrame, strong: DataFrame) -> DataFrame:
    return strong.select("account_id", "component").join(networks.select("component", "size", "density"), "component")


def cluster_sample(cluster_members: DataFrame, limit: int) -> DataFrame:
    """The first ``limit`` members of each account's cluster by id, for the related-accounts list."""
    w = Window.partitionBy("component").orderBy("account_id")
    first = cluster_members.select("component", F.col("account_id").alias("member"), F.row_number().over(
        w).alias("n")).where(F.col("n") <= limit).drop("n")
    return cluster_members.select("account_id", "component").join(first, "component").select("account_id", "member")


# ------------------------------------------------------------------------------------ flag table
def flag(accounts: DataFrame, pattern: str) -> DataFrame:
    return accounts.select("account_id").distinct().withColumn("pattern", F.lit(pattern))


def flags(found: dict[str, DataFrame]) -> DataFrame:
    """Long flag table (account_id, pattern) from accounts per pattern."""
    out = None
    for pattern in fixed.PATTERN_ORDER:
        if pattern in found:
            rows = flag(found[pattern], pattern)
            out = rows if out is None else out.unionByName(rows)
    return out


def network_flags(tx: DataFrame, degree: DataFrame, pairs: DataFrame, strong: DataFrame,
                  circular: DataFrame, chains: DataFrame) -> DataFrame:
    """All seven network detectors. Pass the exhaustive or the traced circular and chain accounts."""
    return flags({
        "fan_in": fan_in(tx, degree),
        "fan_out": fan_out(tx, degree),
        "circular_flow": circular,
        "transaction_chain": chains,
        "rapid_movement": rapid_payments(tx),
        "structuring": structuring(tx),
        "coordinated_network": coordinated_members(coordinated_networks(pairs, strong), strong),
    })
