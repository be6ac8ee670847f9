from __future__ import annotations

import random
from collections import defaultdict

import pytest

from .conftest import accounts

from paytrace.operators import behaviour, detectors, graph, topology


def test_edges_and_nodes(tx):
    df = tx([("A", "B", 100, "2026-03-01T15:30:00Z"), ("A", "B", 200, "2026-03-01T10:00:00Z"), ("B", "C", 5, "2026-03-01T11:00:00Z")])
    ab = graph.edges(df).where("src = 'A'").first()
    assert (float(ab.weight), ab.cnt, ab.first_tx) == (300.0, 2, "T00001") and ab.last_ts == 1772379000
    assert accounts(graph.nodes(df)) == ["A", "B", "C"]
    pairs = graph.edge_pairs(df)
    row = graph.summary(df, topology.weak_components(pairs), topology.strong_components(pairs)).first()
    assert (row.num_accounts, row.num_edges, row.weakly_connected_components, row.strongly_connected_components) == (3, 2, 1, 3)
    assert row.density == round(2 / 6, 6)


def test_degrees_and_behaviour(tx):
    df = tx([("A", "B", 100, 1000), ("C", "B", 200, 2000)])
    totals, degree = behaviour.inputs(df)
    b = behaviour.degree_features(degree, totals).where("account_id = 'B'").first()
    assert (b.in_degree, b.out_degree, b.weighted_in_degree, b.unique_counterparties) == (2, 0, 300.0, 2)
    a = behaviour.behaviour_features(*behaviour.inputs(tx([("A", "B", 100, 0), ("A", "C", 200, 10)]))).where("account_id = 'A'").first()
    assert (a.transaction_count, a.total_outgoing, a.average_transaction_amount, a.maximum_transaction_amount, a.unique_receivers) == (2, 300, 150, 200, 2)
    assert a.std_transaction_amount == 50.0 and a.transaction_velocity == 20.0


def _fan(tx, rows, find, **kw):
    df = tx(rows)
    return find(df, graph.degrees(graph.account_pairs(df)), **kw).collect()


def test_fans(tx):
    inward = [(f"S{i}", "HUB", 500, 60 * i) for i in range(5)]
    found = _fan(tx, inward, detectors.fan_in)
    assert [(r.account_id, r.in_degree, r.ratio, r.burst, r.total_amount) for r in found] == [("HUB", 5, 10.0, 5, 2500.0)]
    outward = [("HUB", f"D{i}", 300, 60 * i) for i in range(5)]
    assert [(r.account_id, r.out_degree) for r in _fan(tx, outward, detectors.fan_out)] == [("HUB", 5)]
    slow = [(f"S{i}", "HUB", 500, 7000 * i) for i in range(5)]
    assert _fan(tx, slow, detectors.fan_in) == [] and len(_fan(tx, slow, detectors.fan_in, window=None)) == 1


def test_sliding_distinct_counts_match_brute_force(spark):
    rng = random.Random(5)
    rows = [("HOT" if rng.random() < 0.5 else f"A{rng.randrange(4)}", f"C{rng.randrange(9)}", rng.randrange(300000)) for _ in range(400)]
    window = 20000
    want = defaultdict(int)
    for a, _, t in rows:
        want[a] = max(want[a], len({c for b, c, s in rows if b == a and t - window <= s <= t}))
    got = detectors.max_distinct_in_window(spark.createDataFrame(rows, "account_id string, counterparty string, t bigint"), window)
    assert {r.account_id: r.burst for r in got.collect()} == dict(want)


def test_rapid_movement(tx):
    df = tx([("SRC", "MID", 5000, "2026-03-01T14:00:00Z"), ("MID", "DST", 4800, "2026-03-01T14:05:00Z"),
             ("X", "Y", 5000, 0), ("Y", "Z", 5000, 0), ("P", "Q", 900, 0), ("Q", "R", 900, 60), ("K", "L", 5000, 0), ("L", "M", 5600, 60)])
    found = {r.account_id: r for r in detectors.rapid_movement(detectors.rapid_payments(df)).collect()}
    assert set(found) == {"MID", "Y"}  # the same second counts, small and unequal amounts do not
    assert found["MID"].fastest_latency_seconds == 300 and found["Y"].fastest_latency_seconds == 0
    assert accounts(detectors.rapid_members(df).where("account_id = 'MID'"), "member") == ["DST", "SRC"]


def test_banded_join_equals_plain_join(tx):
    rng = random.Random(11)
    rows = [(f"A{rng.randrange(5)}", f"B{rng.randrange(5)}", rng.choice([700, 770, 1000, 1100, 1570, 7000, 9999.99]), rng.randrange(9000)) for _ in range(150)]
    rows += [(b, a, x, t) for a, b, x, t in rows[:80]]
    df = tx(rows)
    got = {(r.receipt_id, r.payment_id) for r in detectors.funding_links(df, 3600, strict=True).collect()}
    items = [r for r in df.collect()]
    want = {(q.transaction_id, p.transaction_id) for q in items for p in items
            if q.receiver_id == p.sender_id and 0 < p.t - q.t <= 3600 and q.amount >= 1000
            and 7 * q.amount <= 10 * p.amount <= 11 * q.amount}
    assert got == want and want


def test_counts_equal_listed_pairs(tx, monkeypatch):
    """Counting by ranks and by joining give what the listed pairs give, for every split between the two."""
    rng = random.Random(21)
    rows = [(f"A{rng.randrange(4)}", f"A{rng.randrange(4)}", rng.choice([700, 769.99, 770, 1000, 1099.99, 1100, 1100.01, 1570, 7000, 9999.99]),
             rng.choice([rng.randrange(9000), 3600, 7200])) for _ in range(260)]
    df = tx(rows)
    for strict in (True, False):
        links = detectors.funding_links(df, 3600, strict=strict).collect()
        want = defaultdict(list)
        for r in links:
            want[r.payment_id].append(r.latency)
        ends = {(r.account_id, r.payer) for r in links} | {(r.account_id, r.payee) for r in links}
        for limit in (1 << 16, 0, 30):
            monkeypatch.setattr(detectors, "DENSE_PAIRS", limit)
            got = {r.payment_id: (r.matches, r.latency, r.longest) for r in detectors.funded_payments(df, 3600, strict).collect()}
            assert got == {k: (len(v), min(v), max(v)) for k, v in want.items()} and got
            if not strict:
                assert {(r.account_id, r.member) for r in detectors.rapid_members(df).collect()} == ends


def test_hot_account_is_counted_without_pairs(spark):
    """40,000 receipts and as many payments of one account in one hour: 1.6 * 10^9 pairs at most, each payment answered."""
    n = 40_000
    from pyspark.sql import functions as F
    rows = spark.range(2 * n).select(
        F.concat(F.lit("T"), "id").alias("transaction_id"),
        F.when(F.col("id") < n, F.concat(F.lit("S"), F.col("id") % 50)).otherwise(F.lit("HOT")).alias("sender_id"),
        F.when(F.col("id") < n, F.lit("HOT")).otherwise(F.concat(F.lit("R"), F.col("id") % 70)).alias("receiver_id"),
        (F.lit(1000) + F.pmod(F.xxhash64("id"), F.lit(400))).cast("decimal(18,4)").alias("amount"),
        F.pmod(F.xxhash64("id", F.lit(1)), F.lit(3600)).alias("t"))
    from collections import Counter
    items = rows.select("sender_id", "amount", "t").collect()
    receipts = Counter((int(r.amount), r.t) for r in items if r.sender_id != "HOT")
    got = {r.payment_id: r for r in detectors.rapid_payments(rows).collect()}
    sample = rows.where("sender_id = 'HOT'").where(F.pmod(F.xxhash64("transaction_id"), F.lit(4000)) == 0).collect()
    for p in sample:
        fits = {k: c for k, c in receipts.items() if k[1] <= p.t and 7 * k[0] <= 10 * int(p.amount) <= 11 * k[0]}
        assert (got[p.transaction_id].matches if fits else 0) == sum(fits.values())
        assert not fits or got[p.transaction_id].latency == p.t - max(k[1] for k in fits)
    assert len(got) > 0.99 * n and len(sample) > 5


def test_loops_of_three_to_six_accounts_match_a_plain_search(tx):
    rng = random.Random(31)
    rows = [(f"A{rng.randrange(9)}", f"A{rng.randrange(9)}", rng.choice([1000, 1050, 1100, 900, 600]), rng.randrange(3000)) for _ in range(110)]
    for k in (5, 6):  # planted ones
        rows += [(f"L{k}{j}", f"L{k}{(j + 1) % k}", 5000 - 10 * j, 100 * j) for j in range(k)]
    df = tx([r for r in rows if r[0] != r[1]])
    items = df.collect()
    want = set()

    def walk(path, hops):
        for p in items:
            last = hops[-1]
            if p.sender_id != last.receiver_id or p.t < last.t or p.t > hops[0].t + 1500 or not 5 * last.amount <= 10 * p.amount <= 11 * last.amount:
                continue
            if p.receiver_id == path[0] and len(path) >= 3:
                low = path.index(min(path))
                want.add((tuple(path[low:] + path[:low]), len(path)))
            elif p.receiver_id not in path and len(path) < 6:
                walk([*path, p.receiver_id], [*hops, p])

    for first in items:
        walk([first.sender_id, first.receiver_id], [first])
    got = {(tuple(r.nodes), r.length) for r in detectors.circular_flows(df, window=1500).collect()}
    assert got == want and {n for _, n in want} == {3, 4, 5, 6}


def test_structuring(tx):
    rows = [("SPLITTER", "COLLECTOR", a, f"2026-03-01T{10 + i}:00:00Z") for i, a in enumerate([9500, 9800, 9650, 9900])]
    found = {r.account_id: r for r in detectors.structuring(tx(rows)).collect()}
    assert {a: r.role for a, r in found.items()} == {"SPLITTER": "splitter", "COLLECTOR": "collector"}
    assert found["SPLITTER"].near_threshold_count == 4 and found["SPLITTER"].total_amount == 38850.0
    quiet = [("X", "Y", 2000, f"2026-03-01T{10 + i}:00:00Z") for i in range(5)]
    quiet += [("P", "Q", 9700, f"2026-03-0{1 + 2 * i}T10:00:00Z") for i in range(4)]
    quiet += [("M", "N", 10000, f"2026-03-01T{10 + i}:00:00Z") for i in range(4)]
    assert detectors.structuring(tx(quiet)).count() == 0


def test_circular_flow(tx):
    loop = [("A", "B", 1000, "2026-03-01T12:00:00Z"), ("B", "C", 980, "2026-03-01T12:15:00Z"), ("C", "A", 950, "2026-03-01T12:30:00Z")]
    df = tx(loop)
    found = detectors.circular_flows(df, topology.strong_components(graph.edge_pairs(df))).collect()
    assert [(r.nodes, r.length, r.loop_duration_seconds, r.amount_retained_ratio) for r in found] == [(["A", "B", "C"], 3, 1800, 0.95)]
    wrong = [("C", "A", 950, "2026-03-01T09:00:00Z"), ("B", "C", 970, "2026-03-01T09:30:00Z"), ("A", "B", 1000, "2026-03-03T10:00:00Z")]
    assert detectors.circular_flows(tx(wrong)).count() == 0
    six = [(f"N{i}", f"N{(i + 1) % 6}", 1000 - i, 600 * i) for i in range(6)]
    assert [r.length for r in detectors.circular_flows(tx(six)).collect()] == [6]
    rotated = [(f"N{i}", f"N{(i + 1) % 5}", 1000, 600 * ((i + 2) % 5)) for i in range(5)]
    assert [r.length for r in detectors.circular_flows(tx(rotated)).collect()] == [5]


def test_chains_and_clusters(tx):
    df = tx([(f"N{i}", f"N{i + 1}", 100, 600 * i) for i in range(4)])
    chains = detectors.transaction_chains(graph.edge_pairs(df))
    assert sorted(r.hops for r in chains.collect()) == [3, 4]
    assert {"N1", "N2", "N3"} <= set(accounts(detectors.members_of(chains, "path")))
    cluster = tx([("A", "B", 1, 0), ("B", "C", 1, 1), ("C", "A", 1, 2), ("A", "C", 1, 3)])
    pairs = graph.edge_pairs(cluster)
    strong = topology.strong_components(pairs)
    found = detectors.coordinated_networks(pairs, strong, min_size=3)
    assert found.first().asDict() == {"component": "A", "size": 3, "edge_count": 4, "density": 0.667}
    assert accounts(detectors.coordinated_members(found, strong)) == ["A", "B", "C"]
    assert detectors.coordinated_networks(pairs, strong).count() == 0


def _closure(edges, nodes):
    reach = {n: {n} for n in nodes}
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            for n in nodes:
                if a in reach[n] and b not in reach[n]:
                    reach[n].add(b)
                    changed = True
    return reach


def test_components_match_closure(spark):
    rng = random.Random(3)
    edges = {(f"n{rng.randrange(40)}", f"n{rng.randrange(40)}") for _ in range(45)}
    edges |= {(f"p{i}", f"p{i + 1}") for i in range(25)} | {(f"r{i}", f"r{(i + 1) % 12}") for i in range(12)}
    edges = {(a, b) for a, b in edges if a != b}
    nodes = {x for e in edges for x in e}
    pairs = spark.createDataFrame(sorted(edges), "src string, dst string")
    reach, both = _closure(edges, nodes), _closure(edges | {(b, a) for a, b in edges}, nodes)
    weak = {r.account_id: (r.component, r.component_size) for r in topology.weak_components(pairs).collect()}
    assert weak == {n: (min(both[n]), len(both[n])) for n in nodes}
    mutual = {n: {m for m in reach[n] if n in reach[m]} for n in nodes}
    strong = {r.account_id: (r.component, r.component_size) for r in topology.strong_components(pairs).collect()}
    assert strong == {n: (min(mutual[n]), len(mutual[n])) for n in nodes}
    assert topology.multi_account_components(topology.strong_components(pairs)).first()[0] == len(
        {min(m) for m in mutual.values() if len(m) > 1})


def test_two_hop_is_exact_with_and_without_hubs(spark):
    rng = random.Random(8)
    edges = {("hub" if rng.random() < 0.3 else f"n{rng.randrange(25)}", "hub" if rng.random() < 0.3 else f"n{rng.randrange(25)}") for _ in range(160)}
    edges = sorted((a, b) for a, b in edges if a != b)
    pairs = spark.createDataFrame(edges, "src string, dst string")
    step = defaultdict(set)
    for a, b in edges:
        step[a].add(b)
    want = {a: len({c for b in mids for c in step[b]}) for a, mids in list(step.items())}
    want = {a: n for a, n in want.items() if n}
    for limit in (10**9, 60, 5, 0):
        assert {r.account_id: r.reach for r in topology.two_hop(pairs, wedge_limit=limit).collect()} == want
    loops = defaultdict(int)
    for a, b in edges:
        for c in step[b]:
            if a in step[c]:
                loops[a] += 1
    assert {r.account_id: r.triad_cycles for r in topology.triangles(pairs).collect()} == dict(loops)


def test_pagerank_sums_to_the_number_of_accounts(tx):
    df = tx([("A", "B", 10, 0), ("B", "C", 10, 1), ("D", "C", 30, 2)])
    ranks = {r.account_id: r.pagerank for r in topology.pagerank(graph.edges(df)).collect()}
    assert abs(sum(ranks.values()) - 4) < 1e-9 and ranks["C"] > ranks["B"] > ranks["A"]


def test_ego_networks(spark):
    pairs = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d"), ("x", "y")], "src string, dst string")
    targets = spark.createDataFrame([("A",)], "account_id string")
    two = graph.ego_nodes(pairs, targets, 2)
    assert {r.node for r in two.collect()} == {"a", "b", "c"}
    assert [r.node for r in two.where("is_target").collect()] == ["a"]
    counts = graph.ego_counts(two, graph.ego_edges(pairs, two)).first()
    assert (counts.node_count, counts.edge_count) == (3, 2)
    assert graph.ego_nodes(pairs, targets, 3).count() == 4
    with pytest.raises(ValueError):
        graph.ego_nodes(pairs, targets, 9)


def test_component_rounds_do_not_multiply_size_estimates(spark):
    """Rounds that carry their plans' estimates along double the driver's planning time with each of them."""
    way = spark.createDataFrame([(f"n{i}", f"n{i + 1}") for i in range(60)], "src string, dst string")
    found = topology.weak_components(way)
    assert {(r.component, r.component_size) for r in found.collect()} == {("n0", 61)} and found.count() == 61
    assert found._jdf.queryExecution().optimizedPlan().stats().sizeInBytes() < 10 ** 40
