from __future__ import annotations

import random
import time
from collections import deque
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from paytrace.functions import fixed
from paytrace.operators import flow
from paytrace.sources import views


def replay(rows, window, min_amount=1000, max_inbox=64):
    """One global pass over (t, sender, receiver, amount, id): id -> (depth, funded_by, path)."""
    box, out = {}, {}
    for t, s, r, amount, key in sorted(rows):
        depth, source, path = 1, None, (s,)
        mine = box.get(s)
        if mine and 10 * amount >= 7 * min_amount:
            while mine and t - mine[0][0] > window:
                mine.popleft()
            best = None
            for j in range(len(mine) - 1, -1, -1):
                rt, ra, rd, rk, rp = mine[j]
                if rt < t and 7 * ra <= 10 * amount <= 11 * ra and (best is None or rd > mine[best][2]):
                    best = j
            if best is not None:
                _, _, rd, source, rp = mine[best]
                del mine[best]
                depth, path = rd + 1, (rp + (s,))[-8:]
        out[key] = (depth, source, path + (r,))
        if amount >= min_amount:
            box.setdefault(r, deque(maxlen=max_inbox)).append((t, amount, depth, key, path))
    return out


def compare(df, window, **settings):
    rows = [(r.t, r.sender_id, r.receiver_id, r.amount, r.transaction_id) for r in df.collect()]
    want = replay(rows, window, max_inbox=settings.get("max_inbox", 64))
    traced = flow.trace(df, windows=(window,), **settings)
    got = {r.tx: (r.depth, r.funded_by) for r in traced.collect()}
    for _, _, _, amount, key in rows:
        if 10 * amount >= 7000:
            assert got[key] == want[key][:2], key
    paths = {r.tx: tuple(r.members) for r in flow.paths(traced).collect()}
    assert paths == {k: p for k, (d, s, p) in want.items() if s}
    return paths


def random_rows(seed, accounts, n, span, hot=0.0):
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        a = "HOT" if rng.random() < hot else f"A{rng.randrange(accounts)}"
        b = "HOT" if rng.random() < hot else f"A{rng.randrange(accounts)}"
        if a != b:
            out.append((a, b, rng.choice([650, 800, 1000, 1050, 1400, 2000, 2100, 9000]), rng.randrange(span)))
    return out


def test_cycle_vector(tx):
    df = tx([("P0", "P1", 5000, 0), ("P1", "P2", 4900, 600), ("P2", "P3", 4800, 1200), ("P3", "P1", 4700, 1800)])
    paths = flow.paths(flow.trace(df, windows=(3600,)))
    loops = flow.loops(paths)
    rows = {r.account_id: r for r in flow.accounts(paths, loops).collect()}
    assert paths.agg(F.max("depth")).first()[0] == 4
    assert [rows[f"P{i}"].forward_count for i in range(4)] == [0, 1, 1, 1]
    assert [rows[f"P{i}"].cycle_count for i in range(4)] == [0, 1, 1, 1]
    found = loops.first()
    assert (found.length, found.duration_seconds, found.first_amount, found.closing_amount) == (3, 1200, 4900.0, 4700.0)
    assert rows["P1"].dwell_mean == 600 and rows["P0"].dwell_mean == -1 and rows["P0"].chain_length == 4


def test_windows_and_unrelated_amounts(tx):
    late = tx([("A", "B", 5000, 0), ("B", "C", 4900, 3 * 3600)])
    traced = flow.trace(late)
    assert {r.window for r in traced.where("funded_by IS NOT NULL").collect()} == {fixed.SLOW_WINDOW}
    assert flow.trace(tx([("A", "B", 5000, 0), ("B", "C", 800, 600)])).where("funded_by IS NOT NULL").count() == 0
    assert flow.trace(tx([("A", "B", 5000, 600), ("B", "C", 5000, 600)])).where("funded_by IS NOT NULL").count() == 0


@pytest.mark.parametrize("seed", [1, 2])
def test_random_networks_match_the_global_replay(tx, seed):
    compare(tx(random_rows(seed, 6, 150, 14000)), 2500)


def test_inbox_evictions_match(tx):
    compare(tx(random_rows(7, 3, 200, 4000)), 3600, max_inbox=5)


@pytest.mark.parametrize("task_rows", [flow.TASK_ROWS, 25])
def test_hot_accounts_are_cut_into_chunks_without_changing_results(tx, task_rows):
    df = tx(random_rows(4, 4, 110, 16000, hot=0.35))
    compare(df, 5000, chunk_rows=12, max_inbox=4, task_rows=task_rows)


def test_parts_that_announce_lengths_to_each_other_match(tx):
    compare(tx(random_rows(5, 12, 160, 9000)), 2500, task_rows=20)


def test_unmatched_payments_of_one_account_replay_in_linear_time():
    """200,000 receipts and as many payments that none of them fits; and as many that all fit."""
    box = flow._Inbox(64)
    start = time.time()
    for t in range(200_000):
        box.put(t, 10_000_000, f"R{t}", 1 + t % 3)
        assert box.serve(t, 50_000_000, 43_200) == (0, None, None)
    assert len(box.rest()) == 64 and time.time() - start < 20
    box = flow._Inbox(64)
    for t in range(1, 100_000):
        box.put(2 * t, 10_000_000, f"R{t}", 1)
        assert box.serve(2 * t + 1, 10_000_000, 43_200) == (1, f"R{t}", 1)
    assert not box.rest() and time.time() - start < 30


def test_sample_events_match_the_global_replay(spark):
    compare(views.tx_events(spark, "/root/testdata/sf0.001"), 43200)


def test_partitioning_does_not_change_the_result(spark, tx):
    df = tx(random_rows(9, 5, 80, 9000))
    seen = {frozenset((r.tx, r.depth, r.funded_by) for r in flow.trace(df.repartition(n), windows=(3600,), task_rows=n * 9).collect()) for n in (1, 7, 64)}
    assert len(seen) == 1


def test_chain_details_and_accounts(tx):
    df = tx([(f"N{i}", f"N{i + 1}", 5000 - i, 600 * i) for i in range(11)])
    paths = flow.paths(flow.trace(df, windows=(3600,)))
    longest = paths.orderBy(F.desc("depth")).first()
    assert longest.depth == 11 and len(longest.path) == 8 and longest.members[-1] == "N11"
    details = flow.chain_details(paths, min_hops=3, limit=2).collect()
    assert [r.hops for r in details] == [3, 4]
    none = flow.loops(paths)
    fast = flow.accounts(paths, none)
    assert flow.circular_accounts(fast, fast).count() == 0
    assert flow.chain_accounts(fast, fast.limit(0)).where("account_id = 'N11'").first().chain_length == 11
    # N0 to N2 have left the eight-hop path of the last transfer but keep the longest chain they were in
    got = {r.account_id: r.chain_length for r in fast.collect()}
    assert got["N0"] == 8 and got["N2"] == 10
    assert Decimal(details[0].amount) == Decimal("4998")


def test_expired_receipts_leave_the_inbox_and_a_receipt_without_a_time_funds_nothing():
    box = flow._Inbox(64, window=100)
    for t in range(0, 5000, 50):
        box.put(t, 10_000_000, f"R{t}", 1)
    assert len(box.rest()) == 3  # before: 64, walked by every payment
    box = flow._Inbox(64, window=100)
    box.put(flow.NEVER, 10_000_000, "N", 5)
    box.put(10, 10_000_000, "R", 1)
    assert box.serve(20, 10_000_000, 100) == (1, "R", 10)
    assert box.serve(flow.NEVER, 10_000_000, 100) == (0, None, None)


def test_transfers_without_a_time_are_traced(spark, tx):
    df = tx([("a", "b", 2000, 100), ("b", "c", 2000, 200), ("x", "b", 2000, 50), ("b", "d", 2000, 300)])
    df = df.withColumn("t", F.when(F.col("sender_id") != "x", F.col("t")))
    got = {(r.sender, r.account): (r.depth, r.funded_by is not None) for r in flow.trace(df, windows=(3600,)).collect()}
    assert got == {("a", "b"): (1, False), ("b", "c"): (2, True), ("x", "b"): (1, False), ("b", "d"): (1, False)}


def test_no_receipt_inside_the_window_is_dropped(tx):
    """90 receipts wait, and the only one that fits came first; before, an inbox held 64."""
    rows = [("A", "B", 5000, 0)] + [("A", "B", 90000 + i, 1 + i) for i in range(89)] + [("B", "C", 5000, 600)]
    funded = flow.trace(tx(rows), windows=(3600,)).where("funded_by IS NOT NULL").collect()
    assert [(r.tx, r.funded_by, r.wait) for r in funded] == [("T00090", "T00000", 600)]


@pytest.mark.parametrize("most", [0, 3, 10**9])
def test_many_receipts_of_an_account_are_served_from_a_tree_with_the_same_result(spark, monkeypatch, most):
    """Whether pairs are listed or receipts wait in a tree, every payment gets what the global replay gives it."""
    def step(windows, min_units):
        monkeypatch.setattr(flow, "PAIRS_A_PAYMENT", most)
        monkeypatch.setattr(flow, "PAIRS_AT_ONCE", 50)
        return list(flow._candidates(windows, min_units)(iter([batch])))

    rows = sorted((t, a, b, amount * 10000, f"T{i}") for i, (a, b, amount, t) in enumerate(random_rows(11, 5, 700, 9000, hot=0.3)))
    want = replay([(t, a, b, u / 10000, k) for t, a, b, u, k in rows], 2500, max_inbox=None)
    used = [(a, row[0], row[3], i, i, a == row[1]) for i, row in enumerate(rows) for a in row[1:3]]
    batch = flow.pa.RecordBatch.from_arrays([flow.pa.array(c) for c in zip(*used)], names=["account", "t", "units", "rank", "same", "pays"])
    told = flow.pa.Table.from_batches(step([2500], 10_000_000)).sort_by([("rank", "ascending"), ("kind", "ascending")]).combine_chunks()
    got = [r for b in flow._served(len(rows))(told.to_batches()) for r in b.to_pylist()]
    assert {rows[r["p"]][4]: (r["depth"], rows[r["r"]][4]) for r in got} == {k: v[:2] for k, v in want.items() if v[1]}


def test_copies_of_a_transfer_bring_what_the_last_of_them_brought(spark, tx):
    df = tx([("A", "B", 5000, 0), ("B", "C", 5000, 100), ("C", "D", 5000, 200), ("C", "E", 5000, 300)])
    twice = df.unionByName(df.where("sender_id = 'B'"))
    got = {(r.tx, r.depth) for r in flow.trace(twice, windows=(3600,)).where("funded_by IS NOT NULL").collect()}
    assert got == {("T00001", 2), ("T00002", 2), ("T00003", 2)}
