"""Analytics over the analyst workflow: cases, decisions, audit chain, masked profiles, report drafts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.exprs import dbl

AUDIT_BODY = ("seq", "timestamp", "actor", "role", "action", "target", "outcome", "details", "prev_hash")


# -------------------------------------------------------------------------------------------- cases
def priority(level: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in fixed.PRIORITY_BY_LEVEL.items() for x in pair])
    return F.coalesce(table[level], F.lit("P4"))


def list_cases(cases: DataFrame, status: str | None = None, account: str | None = None, assignee: str | None = None) -> DataFrame:
    """Cases by priority, newest first."""
    if status:
        cases = cases.where(F.col("status") == status.upper())
    if account:
        cases = cases.where(F.lower("account_id") == account.lower())
    if assignee:
        cases = cases.where(F.col("assignee") == assignee)
    return cases.orderBy("priority", F.desc("created_at"), "case_id")


def case_counts(cases: DataFrame) -> DataFrame:
    """Cases per status, statuses without a case included."""
    every = cases.sparkSession.createDataFrame([(s,) for s in fixed.STATUSES], "status string")
    counts = cases.groupBy("status").agg(F.count("*").alias("c"))
    return every.join(counts, "status", "left").select("status", F.coalesce("c", F.lit(0)).alias("cases"))


def case_stats(cases: DataFrame) -> DataFrame:
    """Totals, share of confirmed decisions and mean hours to a decision; times are timestamps."""
    decided = F.count_if(F.col("status").isin(*fixed.DECISIONS))
    filed = F.count_if(F.col("status") == "SAR_FILED")
    hours = (F.unix_micros("decided_at") - F.unix_micros("created_at")) / 3.6e9
    return cases.agg(
        F.count("*").alias("total"), (F.count("*") - decided).alias("active"), decided.alias("decided"),
        F.when(decided > 0, F.round(filed / F.greatest(decided, F.lit(1)), 3)).alias("confirmed_rate"),
        F.round(F.avg(F.when(F.col("decided_at").isNotNull(), hours)), 2).alias("average_hours_to_decision"))


def decision_labels(cases: DataFrame) -> DataFrame:
    """Decisions as training labels."""
    return cases.where("disposition IS NOT NULL").select(
        "account_id", F.when(F.col("disposition") == "confirmed_suspicious", 1).otherwise(0).alias("label"),
        "disposition", "case_id", "decided_by", "decided_at",
        F.col("snapshot.risk_score").alias("model_risk_score"), F.col("snapshot.risk_level").alias("model_risk_level"))


def _ordered(events: DataFrame) -> DataFrame:
    w = Window.partitionBy("case_id").orderBy("seq")
    moves = events.where("status IS NOT NULL")
    return moves.withColumn("from_status", F.lag("status").over(w))


def case_violations(events: DataFrame) -> DataFrame:
    """Status events that break the workflow: (case_id, seq, problem).

    ``events``: case_id, account_id, seq, at, by, can_decide, status (null when unchanged), reason.
    """
    allowed = F.create_map(*[
        x for source, targets in fixed.TRANSITIONS.items() for x in (F.lit(source), F.array(*[F.lit(t) for t in targets]))])
    rows = _ordered(events).where("from_status IS NULL OR from_status <> status")
    first = F.col("from_status").isNull()
    decision, reopening = F.col("status").isin(*fixed.DECISIONS), F.col("from_status").isin(*fixed.DECISIONS)
    problem = (
        F.when(~F.col("status").isin(*fixed.STATUSES), "unknown status")
        .when(first & (F.col("status") != "OPEN"), "case does not start open")
        .when(first, F.lit(None))
        .when(~F.array_contains(F.coalesce(allowed[F.col("from_status")], F.array().cast("array<string>")), F.col("status")), "move not allowed")
        .when((decision | reopening) & ~F.col("can_decide"), "decision needs a compliance officer")
        .when(decision & (F.coalesce(F.trim("reason"), F.lit("")) == ""), "decision needs a reason")
    )
    return rows.withColumn("problem", problem).where("problem IS NOT NULL").select("case_id", "seq", "from_status", "status", "problem")


def case_states(events: DataFrame) -> DataFrame:
    """Current state per case: the last status event, with the decision when it is one."""
    last = F.max(F.struct("seq", "status", "at", "by", "reason")).alias("last")
    first = F.min(F.struct("seq", "at", "by")).alias("first")
    out = events.where("status IS NOT NULL").groupBy("case_id", "account_id").agg(first, last)
    decision = F.col("last.status").isin(*fixed.DECISIONS)
    return out.select(
        "case_id", "account_id", F.col("last.status").alias("status"), F.col("first.at").alias("created_at"),
        F.col("first.by").alias("created_by"), F.col("last.at").alias("updated_at"),
        F.when(decision, F.col("last.at")).alias("decided_at"), F.when(decision, F.col("last.by")).alias("decided_by"),
        F.when(F.col("last.status") == "SAR_FILED", "confirmed_suspicious").when(
            F.col("last.status") == "CLOSED_FALSE_POSITIVE", "false_positive").alias("disposition"),
        F.when(decision, F.col("last.reason")).alias("disposition_reason"))


def duplicate_active_cases(states: DataFrame) -> DataFrame:
    """Accounts with more than one undecided case."""
    return states.where(~F.col("status").isin(*fixed.DECISIONS)).groupBy("account_id").agg(
        F.count("*").alias("active_cases")).where("active_cases > 1")


def open_cases(reports: DataFrame, states: DataFrame, levels=("HIGH", "CRITICAL")) -> DataFrame:
    """Accounts due for a case: risky enough and without an active one, with the risk picture frozen."""
    active = states.where(~F.col("status").isin(*fixed.DECISIONS)).select("account_id").distinct()
    return reports.where(F.col("risk_level").isin(*levels)).join(active, "account_id", "left_anti").select(
        "account_id", priority(F.col("risk_level")).alias("priority"), F.lit("OPEN").alias("status"),
        F.struct(*[c for c in ("risk_score", "risk_level", "is_anomaly", "patterns", "evidence", "typology", "headline",
                               "summary", "next_steps", "related") if c in reports.columns]).alias("snapshot"))


# -------------------------------------------------------------------------------------------- audit
def entry_hash() -> Column:
    """SHA-256 of an entry's JSON body, the hash left out; nulls are written."""
    return F.sha2(F.to_json(F.struct(*AUDIT_BODY), {"ignoreNullFields": "false"}), 256)


def verify_audit(log: DataFrame) -> DataFrame:
    """One row: whether the chain holds, entries, first broken sequence number, last good hash.

    Each entry meets its predecessor through a join on the sequence number, so the chain is checked in
    parallel and a missing predecessor shows as a break.
    """
    before = log.select((F.col("seq") + 1).alias("seq"), F.col("hash").alias("expected")).dropDuplicates(["seq"])
    twice = log.groupBy("seq").agg(F.count("*").alias("copies"))
    rows = log.join(before, "seq", "left").join(twice, "seq").withColumn(
        "expected", F.when(F.col("seq") == 1, F.lit(fixed.GENESIS_HASH)).otherwise(F.col("expected")))
    broken = (~F.col("prev_hash").eqNullSafe(F.col("expected"))) | (~F.col("hash").eqNullSafe(entry_hash())) | (F.col("copies") > 1)
    checked = rows.select("seq", "hash", broken.alias("broken"))
    facts = checked.agg(F.count("*").alias("entries"), F.min(F.when(F.col("broken"), F.col("seq"))).alias("broken_at_seq"))
    first = facts.select("broken_at_seq").scalar()
    head = checked.where(first.isNull() | (F.col("seq") < first)).agg(F.max(F.struct("seq", "hash"))["hash"])
    return facts.select(
        F.col("broken_at_seq").isNull().alias("valid"), "entries", "broken_at_seq",
        F.coalesce(head.scalar(), F.lit(fixed.GENESIS_HASH)).alias("head_hash"))


def list_audit(log: DataFrame, action: str | None = None, actor: str | None = None, limit: int | None = None) -> DataFrame:
    """Matching entries, newest first; the last ``limit`` if a caller asks for a page."""
    if action:
        log = log.where(F.col("action") == action)
    if actor:
        log = log.where(F.col("actor") == actor)
    newest = log.orderBy(F.desc("seq"))
    return newest if limit is None else newest.limit(limit)


# ------------------------------------------------------------------------------------------ masking
def _stars(n: Column) -> Column:
    return F.repeat(F.lit("*"), n.cast("int"))


def mask_name(name: Column) -> Column:
    words = F.filter(F.split(F.coalesce(name, F.lit("")), r"\s+"), lambda w: w != "")
    return F.array_join(F.transform(words, lambda w: F.when(F.length(w) <= 1, F.lit("*")).otherwise(
        F.concat(F.substring(w, 1, 1), _stars(F.greatest(F.length(w) - 1, F.lit(3)))))), " ")


def mask_phone(phone: Column) -> Column:
    """Keeps the first and last three digits."""
    p = F.coalesce(phone.cast("string"), F.lit(""))
    n = F.length(p)
    return F.when(n < 7, _stars(n)).otherwise(F.concat(F.substring(p, 1, 3), _stars(n - 6), F.right(p, F.lit(3))))


def mask_national_id(number: Column) -> Column:
    """Keeps the last four digits."""
    p = F.coalesce(number.cast("string"), F.lit(""))
    n = F.length(p)
    return F.when(n <= 4, _stars(n)).otherwise(F.concat(_stars(n - 4), F.right(p, F.lit(4))))


def mask_profiles(profiles: DataFrame) -> DataFrame:
    """Profiles as shown by default: plain non-sensitive columns, masked personal ones."""
    plain = [c for c in ("account_id", "account_tier", "kyc_level", "district", "division", "account_age_days", "opened_on")
             if c in profiles.columns]
    return profiles.select(
        *plain, mask_name(F.col("holder_name")).alias("holder_name"), mask_phone(F.col("phone")).alias("phone"),
        mask_national_id(F.col("national_id")).alias("national_id"), F.lit(True).alias("masked"))


# ------------------------------------------------------------------------------------- report draft
def report_drafts(cases: DataFrame, linked: DataFrame, reports: DataFrame, audit_head: Column) -> DataFrame:
    """Draft content per case: case, suspicion, risk then and now, linked transfers, and a content hash.

    ``linked`` is ``report.linked_transactions`` and so holds a bounded number of rows per account.
    """
    item = F.struct("rank", "transaction_id", "t", "direction", "counterparty", "amount")
    transfers = linked.groupBy("account_id").agg(
        F.count("*").alias("count"),
        F.round(dbl(F.coalesce(F.sum(F.when(F.col("direction") == "IN", F.col("amount"))), F.lit(0))), 2).alias("total_incoming"),
        F.round(dbl(F.coalesce(F.sum(F.when(F.col("direction") == "OUT", F.col("amount"))), F.lit(0))), 2).alias("total_outgoing"),
        F.sort_array(F.collect_list(item)).alias("items"))
    now = reports.select("account_id", F.col("risk_score").alias("current_score"), F.col("risk_level").alias("current_level"))
    rows = cases.join(transfers, "account_id", "left").join(now, "account_id", "left")
    case_part = [c for c in ("case_id", "title", "status", "priority", "created_at", "created_by", "assignee", "disposition",
                             "disposition_reason", "decided_by", "decided_at") if c in cases.columns]
    body = F.struct(
        F.lit("Suspicious Transaction Report (draft)").alias("report_type"),
        F.concat(F.lit("STR-DRAFT-"), "case_id").alias("report_reference"),
        F.struct(*case_part).alias("case"), F.col("account_id"), F.col("snapshot"),
        "current_score", "current_level",
        F.struct(F.coalesce("count", F.lit(0)).alias("count"), F.coalesce("total_incoming", F.lit(0.0)).alias("total_incoming"),
                 F.coalesce("total_outgoing", F.lit(0.0)).alias("total_outgoing"), "items").alias("transactions"),
        audit_head.alias("audit_log_head_hash"))
    return rows.select("case_id", "account_id", body.alias("report")).withColumn(
        "content_sha256", F.sha2(F.to_json("report", {"ignoreNullFields": "false"}), 256))
