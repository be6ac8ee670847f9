from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from paytrace.functions import fixed
from paytrace.functions.order import exact_percentiles, numbered, running_totals
from paytrace.operators import evaluate, report, scoring, store

FEATURES = {
    "in_degree": 5, "out_degree": 1, "total_incoming": 2000.0, "total_outgoing": 1900.0, "transaction_count": 6,
    "transaction_velocity": 0.0, "incoming_outgoing_ratio": 1.0, "flow_imbalance_magnitude": 0.0, "maximum_transaction_amount": 0.0,
    "passthrough_ratio": 0.0, "counterparty_diversity": 1.0, "unique_counterparties": 6, "cycle_detected": 0, "cycle_count": 0,
    "structuring_detected": 0, "chain_length": 0, "suspicious_neighbor_count": 0, "ml_anomaly_score": 5.0,
}


def rows(spark, *cases):
    out = spark.createDataFrame(
        [(f"A{i}", c.get("patterns", []), c.get("tier", "personal"), c.get("prob"), c.get("is_anomaly", False)) for i, c in enumerate(cases)],
        "account_id string, patterns array<string>, account_tier string, supervised_probability double, is_anomaly boolean")
    for name, value in FEATURES.items():
        given = F.create_map(*[x for i, c in enumerate(cases) for x in (F.lit(f"A{i}"), F.lit(c.get(name, value)))])
        out = out.withColumn(name, given[F.col("account_id")])
    return out


def test_score_floor_levels_and_tiers(spark):
    got = {r.account_id: r for r in scoring.composite(rows(
        spark, dict(patterns=["circular_flow", "rapid_movement", "structuring", "fan_in"]), {},
        dict(patterns=["fan_in", "fan_out", "rapid_movement"], ml_anomaly_score=10.0),
        dict(patterns=["fan_in", "fan_out", "rapid_movement"], tier="agent", prob=0.1), dict(patterns=["circular_flow"], tier="agent"),
        dict(prob=0.97), dict(patterns=["location_anomaly"]), dict(patterns=["hundi_operator"]))).collect()}
    assert got["A0"].risk_score >= 75 and got["A0"].risk_level == "HIGH"
    assert got["A1"].risk_score < 10 and got["A1"].risk_level == "LOW"
    assert (got["A2"].graph_component, got["A3"].graph_component, got["A4"].graph_component) == (80, 0, 35)
    assert got["A3"].ml_component == 10.0 and got["A5"].ml_component == 97.0
    assert got["A6"].risk_level == "MEDIUM" and got["A7"].risk_level == "HIGH"
    levels = spark.createDataFrame([(95.0,), (75.0,), (55.0,), (25.0,)], "s double").select(scoring.level(F.col("s")))
    assert [r[0] for r in levels.collect()] == ["CRITICAL", "HIGH", "MEDIUM", "LOW"]


def test_calibration_stays_in_bounds(spark):
    df = spark.createDataFrame([(x / 100,) for x in range(-60, 61)], "raw_score double")
    _, mad = scoring.spread(df)
    got = scoring.calibrate(df, mad).orderBy("raw_score").collect()
    assert all(0 <= r.ml_anomaly_score <= 100 for r in got)
    assert all(a.ml_anomaly_score >= b.ml_anomaly_score for a, b in zip(got, got[1:]))
    assert scoring.spread(spark.createDataFrame([(0.1,)] * 5, "raw_score double")) == (0.1, 0.05)


def test_percentiles_and_running_totals_are_exact(spark):
    rng = random.Random(1)
    values = [rng.choice([0.0, rng.random() * 100]) for _ in range(3001)]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    got = exact_percentiles(df, {f"p{p}": ("v", p / 100) for p in (0, 3, 25, 50, 75, 97, 100)})
    for p in (0, 3, 25, 50, 75, 97, 100):
        assert got[f"p{p}"] == pytest.approx(np.percentile(values, p), abs=1e-12)
    assert exact_percentiles(df.limit(0), {"p": ("v", 0.5)}) == {"p": None}
    whole = [rng.randrange(40) for _ in range(500)]
    counted = spark.createDataFrame([(v, 1) for v in whole], "v int, n int")
    for r in running_totals(counted, [], "v", ["n"], slices=7).collect():
        assert (r.cum_n, r.before_n) == (sum(x >= r.v for x in whole), sum(x > r.v for x in whole))
    order = numbered(df.withColumn("k", F.monotonically_increasing_id()), "k", 3, "i", slices=5).select("i").collect()
    assert sorted(r.i for r in order) == list(range(len(values)))


def test_metrics(spark):
    data = [(1, 0.9, True), (0, 0.8, True), (1, 0.7, False), (0, 0.7, False), (0, 0.1, False)]
    df = spark.createDataFrame(data, "y int, score double, alert boolean")
    c = evaluate.confusion(df).first()
    assert (c.true_positives, c.false_positives, c.false_negatives, c.true_negatives, c.precision, c.recall) == (1, 1, 1, 2, 0.5, 0.5)
    assert evaluate.average_precision(df).first()[0] == pytest.approx(0.5 * 1 + 0.5 * 2 / 4)
    assert evaluate.roc_auc(df).first()[0] == pytest.approx((3 + 1.5) / 6)
    assert evaluate.best_f1_threshold(df).first().threshold == 0.7


def test_evidence_typology_and_steps(spark):
    base = rows(spark, dict(patterns=["fan_in", "structuring"], transaction_velocity=12.34, passthrough_ratio=0.95), {},
                dict(patterns=["rapid_movement", "transaction_chain"], chain_length=4, is_anomaly=True))
    near = spark.createDataFrame([("A0", "collector", 4, 38850.0, 10000.0)],
                                 "account_id string, near_role string, near_count bigint, near_total double, near_limit double")
    rapid = spark.createDataFrame([("A2", 330.0, 2, 1)], "account_id string, rapid_latency double, rapid_forwards bigint, rapid_destinations bigint")
    related = spark.createDataFrame([("A0", ["X", "Y"])], "account_id string, related array<string>")
    scored = report.attach_details(scoring.composite(base), {"structuring": near, "rapid_movement": rapid}).join(related, "account_id", "left")
    got = {r.account_id: r for r in report.briefed(scored).collect()}
    a = got["A0"]
    assert a.evidence[0] == "Fan-in pattern detected: received funds from 5 distinct senders with only 1 outgoing counterparties."
    assert a.evidence[1] == "Structuring detected: received 4 transactions just under the 10,000 threshold (total 38,850) within 24 hours."
    assert "High transaction velocity: 12.3 transactions per hour." in a.evidence
    assert "High layering passthrough ratio: 95.0% of incoming funds forwarded onward." in a.evidence
    assert a.typology == "Structured deposit collection" and a.headline == "Structured deposit collection: A0"
    assert "just under BDT 10,000" in a.key_findings[0] and len(a.next_steps) == 6
    assert a.next_steps[-2] == "Open linked cases for X, Y in the network view." and a.next_steps[-1] == fixed.CLOSING_STEPS[a.risk_level]
    assert got["A1"].evidence == ["Normal transactional behavior: no anomalous patterns or metric deviations detected."]
    assert got["A1"].headline == "Routine activity: A1" and got["A1"].typology == "No suspicious typology"
    assert got["A2"].typology == "Pass-through mule"
    assert "Passed received money straight on 2 times (to 1 wallet), the fastest within 6 minutes of receipt." in got["A2"].key_findings
    assert any("Isolation Forest" in e for e in got["A2"].evidence)
    drivers = spark.createDataFrame([("A1", 1, "number of payments", 3.0, 1.5)], "account_id string, place int, label string, value double, typical double")
    said = report.with_classifier_sentence(report.briefed(scored).withColumn("supervised_probability", F.lit(0.93)), 0.5, drivers)
    assert said.where("account_id = 'A1'").first().evidence == [
        "Trained classifier rates this account 93% similar to known laundering typologies. Main drivers: number of payments = 3 (typical 1.5)."]


def test_related_accounts_are_capped_and_ordered(spark):
    members = spark.createDataFrame([("A", f"M{i:02d}") for i in range(30)] + [("A", "A")], "account_id string, member string")
    got = report.related_accounts({"structuring": members, "fan_in": spark.createDataFrame([("A", "Z")], "account_id string, member string")}).first()
    assert got.related == ["Z"] + [f"M{i:02d}" for i in range(11)]


def test_store_of_one_transfer_is_finite(tx):
    df = tx([("A", "B", 100, 1000)])
    from paytrace.operators import behaviour

    totals, degree = behaviour.inputs(df)
    got = store.temporal(df, totals).join(store.transactional(totals, degree), "account_id").collect()
    assert len(got) == 2
    for r in got:
        assert all(v is not None and np.isfinite(v) for k, v in r.asDict().items() if k != "account_id")
        assert r.inter_arrival_median_s == -1 and r.std_transaction_amount == 0
