from __future__ import annotations

import random
import statistics
from collections import defaultdict

from .conftest import accounts

from paytrace.operators import context, evaluate


def history(account, area, device):
    return [(account, "SHOP", 400, f"2026-03-0{d + 1}T10:00:00Z", "payment", area, device) for d in range(4)]


TAKEOVER = (
    history("VICTIM", "Zone-02", "V1") + history("VICTIM2", "Zone-04", "W1") + history("RESIDENT", "Zone-13", "R1") + history("TRAVELLER", "Zone-02", "T1")
    + [("VICTIM", "COLLECTOR", 9000, "2026-03-06T02:00:00Z", "send_money", "Zone-13", "STOLEN"),
       ("VICTIM2", "COLLECTOR", 8000, "2026-03-06T02:30:00Z", "send_money", "Zone-13", "STOLEN2"),
       ("RESIDENT", "COLLECTOR", 9000, "2026-03-06T03:00:00Z", "send_money", "Zone-13", "R1"),
       ("TRAVELLER", "SHOP", 450, "2026-03-06T12:00:00Z", "payment", "Zone-13", "T1")]
)


def areas(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "area string")


def test_takeover_needs_a_break_from_the_baseline(spark, tx):
    alerts, payments = context.location_takeover(tx(TAKEOVER), areas(spark, "Zone-13"))
    rows = {r.account_id: r for r in alerts.collect()}
    assert set(rows) == {"VICTIM", "VICTIM2"}
    v = rows["VICTIM"]
    assert v.usual_areas == ["Zone-02"] and v.new_device and v.signal_score == 55 and v.outflow_24h == 9000 and v.typical_daily_outflow == 400
    assert "new handset" in v.signals and len(v.signals) == 4
    collectors = context.takeover_collectors(payments).collect()
    assert [(r.account_id, r.victim_count, r.amount_collected, r.risk_areas) for r in collectors] == [("COLLECTOR", 2, 17000.0, ["Zone-13"])]
    none, _ = context.location_takeover(tx(TAKEOVER), areas(spark))
    assert none.count() == 0


def brute_takeover(rows, risk):
    """Straight reading of the rules, one sender at a time: {(account, time): (score, outflow)}."""
    by, out = defaultdict(list), {}
    for r in rows:
        by[r.sender_id].append(r)
    for account, sent in by.items():
        sent.sort(key=lambda r: (r.t, r.receiver_id, r.amount, r.transaction_id))
        counts, devices, paid, days = defaultdict(int), set(), set(), defaultdict(float)
        episode_end = flagged_until = -1
        for i, r in enumerate(sent):
            located = sum(counts.values())
            if r.location in risk and located >= 3 and counts[r.location] / located < 0.1 and r.t > episode_end:
                window = [x for x in sent[i:] if x.t - r.t <= 86400 and x.location == r.location]
                outflow = float(sum(x.amount for x in window))
                new = float(sum(x.amount for x in window if x.receiver_id not in paid))
                typical = statistics.median(days.values()) if days else 0.0
                score = 15 + 15 * (bool(r.device_id) and bool(devices) and r.device_id not in devices)
                score += 15 * (outflow >= max(3 * typical, 5000)) + 10 * (outflow > 0 and new / outflow >= 0.5)
                if score >= 30:
                    out[account, r.t] = (score, round(outflow, 2))
                    flagged_until = r.t + 86400
                episode_end = r.t + 86400
            if not (r.t <= flagged_until and r.location in risk):
                if r.location:
                    counts[r.location] += 1
                if r.device_id:
                    devices.add(r.device_id)
                paid.add(r.receiver_id)
                days[r.t // 86400] += float(r.amount)
    return out


def test_takeover_rounds_match_a_straight_reading(spark, tx):
    rng = random.Random(2)
    rows = []
    for _ in range(420):
        s = f"A{rng.randrange(6)}"
        risky = rng.random() < 0.08
        area = rng.choice(["Zone-13", "Zone-14"]) if risky else rng.choice([None, f"Zone-0{s[1]}", "Zone-09"])
        device = rng.choice([None, f"D{s}", f"X{rng.randrange(300)}"]) if risky else f"D{s}"
        rows.append((s, f"B{rng.randrange(60)}", rng.choice([100, 900, 7000, 60000 if risky else 2000]), rng.randrange(6 * 86400),
                     "send_money", area, device))
    df = tx(rows)
    alerts, _ = context.location_takeover(df, areas(spark, "Zone-13", "Zone-14"))
    got = {(r.account_id, r.first_seen): (r.signal_score, r.outflow_24h) for r in alerts.collect()}
    want = brute_takeover(df.collect(), {"Zone-13", "Zone-14"})
    assert got == want and len(want) > 5


def hundi(operator, kind, cycles=2, sender="FUNDER"):
    rows = []
    for c in range(cycles):
        day = 2 + 7 * c
        rows += [(f"{sender}{k % 2}", operator, 20000, f"2026-03-{day:02d}T10:{k}0:00Z", kind, "Zone-05", "D") for k in range(3)]
        rows += [(operator, f"{operator}_FAMILY{b}", 9000, f"2026-03-{day:02d}T14:{b}0:00Z", "cash_in", "Zone-05", "D") for b in range(6)]
    return rows


def test_hundi_needs_informal_funding_and_recurrence(spark, tx):
    tiers = spark.createDataFrame(
        [("AGENT_H", "agent"), ("AGENT_F", "agent"), ("PARTNER0", "merchant"), ("PARTNER1", "merchant")], "account_id string, tier string")
    df = tx(hundi("AGENT_H", "send_money") + hundi("AGENT_F", "inward_remittance", sender="PARTNER")
            + hundi("ONE_OFF", "send_money", cycles=1, sender="RELATIVE"))
    found = context.hundi(df, tiers)
    rows = found["operators"].collect()
    assert [r.account_id for r in rows] == ["AGENT_H"]
    r = rows[0]
    assert (r.cycles, r.beneficiary_count, r.repeat_beneficiary_share, r.funder_count, r.payout_ratio) == (2, 6, 1.0, 2, 0.9)
    assert accounts(found["funders"]) == ["FUNDER0", "FUNDER1"]
    flags = context.context_flags(df.limit(0).selectExpr("sender_id AS account_id"), df.limit(0).selectExpr("sender_id AS account_id"),
                                  found["operators"], found["funders"])
    assert not [r for r in flags.collect() if "FAMILY" in r.account_id]


def test_a_gap_of_exactly_three_days_starts_a_new_cycle(tx):
    df = tx([("F", "O", 20000, 0), ("F", "O", 20000, 3 * 86400), ("F", "O", 20000, 6 * 86400 - 1)])
    cycles = context.funding_cycles(df, df.selectExpr("receiver_id AS account_id").distinct())
    assert sorted((r.start_t, r.end_t) for r in cycles.collect()) == [(0, 0), (259200, 518399)]


def test_detector_quality_counts_lookalikes(spark):
    flags = spark.createDataFrame([("A", "p"), ("B", "p")], "account_id string, pattern string")
    truth = spark.createDataFrame([("A", "p", True, False), ("B", "p", False, True), ("C", "p", True, False), ("D", "p", False, True)],
                                  "account_id string, pattern string, is_true boolean, residents boolean")
    r = evaluate.detector_quality(flags, truth, ["residents"]).first()
    assert (r.true_cases, r.flagged_cases, r.precision, r.recall, r.false_positive_rate, r.residents, r.residents_flagged) == (2, 2, 0.5, 0.5, 0.5, 2, 1)


def test_remittance_steps_are_tables(tx):
    """In one plan the payouts and all aggregations over them share the memory of a task, and each reader runs them again."""
    found = context.hundi(tx([("A", "B", 20000, 1000, "cash_in"), ("B", "C", 5000, 2000, "send_money")]), tx([]).selectExpr("sender_id AS account_id", "'personal' AS tier"))
    assert all(found[step].inputFiles() for step in ("gated", "payouts", "operators"))
