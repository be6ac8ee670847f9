from __future__ import annotations

from pyspark.sql import functions as F

from paytrace.functions import fixed
from paytrace.operators import workflow

EVENTS = "case_id string, account_id string, seq bigint, at string, by string, can_decide boolean, status string, reason string"


def test_case_states_and_violations(spark):
    events = spark.createDataFrame([
        ("C1", "A", 1, "t1", "ann", False, "OPEN", None), ("C1", "A", 2, "t2", "ann", False, None, "note"),
        ("C1", "A", 3, "t3", "ann", False, "ESCALATED", None), ("C1", "A", 4, "t4", "cat", True, "SAR_FILED", "confirmed"),
        ("C2", "B", 1, "t1", "ann", False, "OPEN", None), ("C2", "B", 2, "t2", "ann", False, "SAR_FILED", "x"),
        ("C3", "B", 1, "t1", "ann", False, "OPEN", None), ("C3", "B", 2, "t2", "cat", True, "CLOSED_FALSE_POSITIVE", " "),
        ("C4", "D", 1, "t1", "ann", False, "OPEN", None), ("C5", "D", 1, "t1", "ann", False, "OPEN", None),
        ("C6", "E", 1, "t1", "ann", False, "OPEN", None), ("C6", "E", 2, "t2", "ann", False, "CLOSED_FALSE_POSITIVE", "fine"),
    ], EVENTS)
    problems = {(r.case_id, r.problem) for r in workflow.case_violations(events).collect()}
    assert problems == {("C2", "move not allowed"), ("C3", "decision needs a reason"), ("C6", "decision needs a compliance officer")}
    states = workflow.case_states(events)
    c1 = states.where("case_id = 'C1'").first()
    assert (c1.status, c1.decided_by, c1.disposition, c1.created_at) == ("SAR_FILED", "cat", "confirmed_suspicious", "t1")
    assert [r.account_id for r in workflow.duplicate_active_cases(states).collect()] == ["D"]
    reports = spark.createDataFrame([("D", 95.0, "CRITICAL"), ("Z", 75.0, "HIGH"), ("Y", 10.0, "LOW")], "account_id string, risk_score double, risk_level string")
    due = workflow.open_cases(reports, states).collect()
    assert [(r.account_id, r.priority, r.snapshot.risk_score) for r in due] == [("Z", "P2", 75.0)]


def test_case_lists_stats_and_labels(spark):
    cases = spark.createDataFrame([
        ("C1", "A", "OPEN", "P2", "ann", "2026-01-02 00:00:00", None, None), ("C2", "B", "SAR_FILED", "P1", "ann", "2026-01-01 00:00:00", "2026-01-01 06:00:00", "confirmed_suspicious"),
        ("C3", "C", "CLOSED_FALSE_POSITIVE", "P2", "bob", "2026-01-03 00:00:00", "2026-01-03 03:00:00", "false_positive"),
    ], "case_id string, account_id string, status string, priority string, assignee string, created_at string, decided_at string, disposition string")
    cases = cases.withColumn("created_at", F.to_timestamp("created_at")).withColumn("decided_at", F.to_timestamp("decided_at")).withColumn(
        "snapshot", F.struct(F.lit(80.0).alias("risk_score"), F.lit("HIGH").alias("risk_level"))).withColumn("decided_by", F.lit("cat"))
    assert [r.case_id for r in workflow.list_cases(cases).collect()] == ["C2", "C3", "C1"]
    assert [r.case_id for r in workflow.list_cases(cases, status="open", account="a", assignee="ann").collect()] == ["C1"]
    s = workflow.case_stats(cases).first()
    assert (s.total, s.active, s.decided, s.confirmed_rate, s.average_hours_to_decision) == (3, 1, 2, 0.5, 4.5)
    assert {r.status: r.cases for r in workflow.case_counts(cases).collect()}["ESCALATED"] == 0
    assert {(r.account_id, r.label) for r in workflow.decision_labels(cases).collect()} == {("B", 1), ("C", 0)}
    linked = spark.createDataFrame([("A", 1, "T1", 5, "IN", "X", 10.0), ("A", 2, "T2", 4, "OUT", "Y", 4.0)],
                                   "account_id string, rank int, transaction_id string, t bigint, direction string, counterparty string, amount double")
    reports = spark.createDataFrame([("A", 91.0, "CRITICAL")], "account_id string, risk_score double, risk_level string")
    drafts = workflow.report_drafts(cases, linked, reports, F.lit("head")).where("case_id = 'C1'").first()
    assert drafts.report.transactions.total_incoming == 10.0 and drafts.report.current_level == "CRITICAL" and len(drafts.content_sha256) == 64


def _log(spark, n):
    schema = ("seq bigint, timestamp string, actor string, role string, action string, target string, outcome string, "
              "details map<string,string>, prev_hash string")
    entries, prev = [], fixed.GENESIS_HASH
    for i in range(1, n + 1):
        row = (i, f"t{i}", "ann", "analyst", "case.open", None, "success", {"k": str(i)}, prev)
        prev = spark.createDataFrame([row], schema).select(workflow.entry_hash()).first()[0]
        entries.append((*row, prev))
    return spark.createDataFrame(entries, schema + ", hash string")


def test_audit_chain(spark):
    log = _log(spark, 4).cache()
    ok = workflow.verify_audit(log).first()
    assert ok.valid and ok.entries == 4 and ok.broken_at_seq is None and ok.head_hash == log.where("seq = 4").first().hash
    edited = log.withColumn("action", F.when(F.col("seq") == 2, "x").otherwise(F.col("action")))
    assert workflow.verify_audit(edited).first().broken_at_seq == 2
    dropped = workflow.verify_audit(log.where("seq <> 2")).first()
    assert dropped.broken_at_seq == 3 and dropped.head_hash == log.where("seq = 1").first().hash
    assert [r.seq for r in workflow.list_audit(log, actor="ann", limit=2).collect()] == [4, 3]


def test_masks(spark):
    row = spark.createDataFrame([("Ada B Lovelace", "01712345678", "1234567890", "12345", "12")], "n string, p string, i string, s string, t string").select(
        workflow.mask_name(F.col("n")), workflow.mask_phone(F.col("p")), workflow.mask_national_id(F.col("i")), workflow.mask_phone(F.col("s")),
        workflow.mask_national_id(F.col("t"))).first()
    assert tuple(row) == ("A*** * L*******", "017*****678", "******7890", "*****", "**")
