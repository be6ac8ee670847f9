"""Registered queries of readers, writers, validation modes and the analyst workflow, with their DuckDB twins.

The workflow tables are views of the sample tables: an order is a case, an event a step of a case, a supplier an audit entry.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.exprs import dbl
from ..operators import graph, report, scoring, validate, workflow
from ..sources import io, views
from ..sources.session import cut, new_folder, tabled
from .oracle import CTES, r, sql, tier_of

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, twin: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[name] = f
        if twin:
            ORACLES[name] = sql(twin)
        return f

    return register


# ------------------------------------------------------------------------------ readers, writers
def _lines(spark: SparkSession, folder: str) -> str:
    """Every event as a line of JSON, the amount as number or text, one line in fifty cut short."""
    events = spark.read.parquet(f"{folder}/events.parquet")
    number = F.to_json(F.struct(F.concat(F.lit("TX_"), "event_id").alias("tx_id"), F.concat(F.lit("U"), "user_id").alias("sender"),
                                F.lit("B").alias("receiver_id"), F.col("event_id").alias("amount"), F.lit(1704067200).alias("timestamp")))
    text = F.to_json(F.struct(F.concat(F.lit("TX_"), "event_id").alias("transaction_id"), F.concat(F.lit("U"), "user_id").alias("sender_id"),
                              F.lit("B").alias("receiver"), F.col("event_id").cast("string").alias("amount"), F.lit("2024-01-01").alias("timestamp")))
    line = F.when(F.col("event_id") % 50 == 0, F.concat(F.lit('{"tx_id":"TX_'), F.col("event_id").cast("string"))).when(
        F.col("event_id") % 2 == 0, number).otherwise(text)
    path = new_folder(spark, "io")
    events.select(line.alias("value")).write.text(path)
    return path


@query("io1_malformed_records", """
SELECT 'Malformed transaction record' AS error, '{"tx_id":"TX_'||event_id AS raw FROM events WHERE event_id % 50 = 0""")
def _(spark, folder):
    return io.malformed(io.read_transfers(spark, _lines(spark, folder)))


@query("io1_read_transfers", """
SELECT 'TX_'||event_id AS transaction_id, 'U'||user_id AS sender_id, 'B' AS receiver_id, CAST(event_id AS DOUBLE) AS amount, 1704067200 AS t
FROM events WHERE event_id % 50 <> 0 AND event_id > 0""")
def _(spark, folder):
    raw = io.read_transfers(spark, _lines(spark, folder))
    parsed = raw.where("_corrupt_record IS NULL").drop("_corrupt_record")
    return validate.valid(validate.check(parsed)).select("transaction_id", "sender_id", "receiver_id", dbl("amount").alias("amount"), "t")


CTES["zones"] = "SELECT DISTINCT 'Zone-'||lpad(CAST(user_id % 12 + 1 AS VARCHAR), 2, '0') AS area FROM events WHERE value > 50"


@query("io3_risk_areas", "SELECT area FROM zones")
def _(spark, folder):
    areas = spark.read.parquet(f"{folder}/events.parquet").where("value > 50").select(
        F.concat(F.lit("Zone-"), F.lpad((F.col("user_id") % 12 + 1).cast("string"), 2, "0")).alias("area")).distinct()
    path = new_folder(spark, "io")
    areas.agg(F.collect_list("area").alias("risk_areas")).write.json(path)  # at most twelve
    return io.read_risk_areas(spark, path)


CTES["payload"] = f"""
SELECT account_id, CAST(sum(amount) AS DOUBLE) AS risk_score, CASE WHEN sum(amount) >= 2000000 THEN 'HIGH' ELSE 'LOW' END AS risk_level,
       {tier_of('account_id')} AS tier FROM li_po GROUP BY 1"""


def _payload(spark, folder) -> DataFrame:
    tx = views.tx_lineitem(spark, folder)
    sums = tabled(tx.select(F.explode(F.array("sender_id", "receiver_id")).alias("account_id"), "amount").groupBy("account_id").agg(
        F.sum("amount").alias("s")))  # one row per account, read several times
    return scoring.tiers(sums).join(sums, "account_id").select(
        "account_id", dbl("s").alias("risk_score"), F.when(F.col("s") >= 2000000, "HIGH").otherwise("LOW").alias("risk_level"), "tier")


@query("io5_payload", "SELECT account_id, round(risk_score, 4) AS risk_score, risk_level, tier FROM payload")
def _(spark, folder):
    path = new_folder(spark, "io")
    io.write_payload(_payload(spark, folder), path)
    return spark.read.parquet(path).select("account_id", F.round("risk_score", 4).alias("risk_score"), "risk_level", "tier")


@query("io6_latest_metrics", """
SELECT 'accounts' AS section, metric, value, 'run-2' AS run_at FROM (
  SELECT unnest([{'metric': 'accounts', 'value': CAST(count(*) AS DOUBLE)}, {'metric': 'high', 'value': CAST(count(*) FILTER (risk_level = 'HIGH') AS DOUBLE)}], recursive := true)
  FROM payload)
UNION ALL SELECT 'tiers', 'agents', CAST(count(*) FILTER (tier = 'merchant') AS DOUBLE), 'run-1' FROM payload""")
def _(spark, folder):
    rows, path = _payload(spark, folder), new_folder(spark, "io")
    facts = rows.agg(F.count("*").alias("accounts"), F.count_if(F.col("risk_level") == "HIGH").alias("high"))
    io.publish_metrics(facts.withColumn("high", F.col("high") + 1), path, "accounts", "run-1")
    io.publish_metrics(rows.agg(F.count_if(F.col("tier") == "merchant").alias("agents")), path, "tiers", "run-1")
    io.publish_metrics(facts, path, "accounts", "run-2")
    return io.latest_metrics(spark, path)


# --------------------------------------------------------------------------------- validation
@query("val01_aliases", "SELECT row_index, s AS sender_id, rr AS receiver_id FROM vcheck WHERE error IS NULL")
def _(spark, folder):
    """Only alias names for sender and id; for the receiver the main name on even rows, the alias on odd ones."""
    raw = views.tx_raw(spark, folder).withColumnsRenamed({"sender_id": "sender", "transaction_id": "tx_id"})
    even = F.col("row_index") % 2 == 0
    raw = raw.withColumn("receiver", F.when(~even, F.col("receiver_id"))).withColumn("receiver_id", F.when(even, F.col("receiver_id")))
    return validate.valid(validate.check(raw)).select("row_index", "sender_id", "receiver_id")


@query("val07_iso_forms", """
SELECT event_id, CASE event_id % 6 WHEN 0 THEN d WHEN 1 THEN d WHEN 2 THEN d + h*3600 WHEN 3 THEN d + h*3600 + m*60 - 19800 WHEN 4 THEN d + h*3600 + m*60 + s
  ELSE d + h*3600 + m*60 + s + 12600 END AS t
FROM (SELECT event_id, epoch_us(ts)//86400000000*86400 AS d, hour(ts) AS h, minute(ts) AS m, second(ts) AS s FROM events)""")
def _(spark, folder):
    """Times written as week, basic, hour, compact, comma and offset forms, read back."""
    ts = F.col("ts")
    year = F.date_format(F.date_add(F.to_date(ts), (3 - F.weekday(ts)).cast("int")), "yyyy")
    week = F.concat(year, F.lit("-W"), F.lpad(F.weekofyear(ts).cast("string"), 2, "0"), F.lit("-"), (F.weekday(ts) + 1).cast("string"))
    forms = [week, F.date_format(ts, "yyyyMMdd"), F.date_format(ts, "yyyy-MM-dd'T'HH"), F.concat(F.date_format(ts, "yyyyMMdd'T'HHmm"), F.lit("+0530")),
             F.concat(F.date_format(ts, "yyyy-MM-dd HH:mm:ss"), F.lit(",25Z")), F.concat(F.date_format(ts, "yyyy-MM-dd'T'HHmmss"), F.lit("-03:30"))]
    events = spark.read.parquet(f"{folder}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    text = F.element_at(F.array(*forms), (F.col("event_id") % 6 + 1).cast("int"))
    rows = events.select("event_id", text.alias("timestamp"))
    return rows.select("event_id", F.floor(F.unix_micros(validate.parse_time(rows)) / 1_000_000).cast("bigint").alias("t"))


@query("val09_made_ids", "SELECT row_index, TRUE AS made FROM vcheck WHERE error IS NULL AND gid IS NULL")
def _(spark, folder):
    """Rows without an id get one that no other row has."""
    rows = cut(validate.valid(validate.check(views.tx_raw(spark, folder))).select("row_index", "transaction_id"))
    once = rows.groupBy("transaction_id").agg(F.min("row_index").alias("row_index"), F.count("*").alias("n"))
    return once.where(F.col("transaction_id").rlike("^TX_[0-9A-F]{12,16}$")).select("row_index", (F.col("n") == 1).alias("made"))


@query("val13_strict_mode", "SELECT 'Row '||row_index||': '||error AS problem FROM vcheck WHERE error IS NOT NULL ORDER BY row_index LIMIT 1")
def _(spark, folder):
    raw = views.tx_raw(spark, folder)
    try:
        validate.validate(raw, strict=True)
        problems: list[tuple[str]] = []
    except validate.TransferValidationError as problem:
        problems = [(str(problem),)]
    return spark.createDataFrame(problems, "problem string")


# ------------------------------------------------------------------------------------ workflow
CASES = """
SELECT concat('C', o_orderkey) AS case_id, concat('A', o_custkey) AS account_id,
       CASE o_orderstatus WHEN 'O' THEN 'OPEN' WHEN 'P' THEN 'ESCALATED' ELSE CASE WHEN o_custkey % 3 = 0 THEN 'CLOSED_FALSE_POSITIVE' ELSE 'SAR_FILED' END END AS status,
       concat('P', least(CAST(substr(o_orderpriority, 1, 1) AS INT), 4)) AS priority, concat('analyst', o_orderkey % 5) AS assignee, o_orderdate AS created_at,
       CASE WHEN o_orderstatus = 'F' THEN o_orderdate + INTERVAL 6 HOUR * (o_orderkey % 10) END AS decided_at,
       CASE WHEN o_orderstatus = 'F' THEN CASE WHEN o_custkey % 3 = 0 THEN 'false_positive' ELSE 'confirmed_suspicious' END END AS disposition,
       CASE WHEN o_orderstatus = 'F' THEN concat('officer', o_orderkey % 3) END AS decided_by,
       CAST(floor(o_totalprice / 10000) AS DOUBLE) AS risk_score, CASE WHEN o_totalprice > 300000 THEN 'HIGH' ELSE 'MEDIUM' END AS risk_level
FROM {orders}"""
CTES["cases"] = CASES.format(orders="orders").replace("concat(", "concat_ws('', ")


def _cases(spark, folder) -> DataFrame:
    text = CASES.replace("INTERVAL 6 HOUR * (o_orderkey % 10)", "make_dt_interval(0, CAST(6 * (o_orderkey % 10) AS INT))")
    rows = spark.sql(text, orders=spark.read.parquet(f"{folder}/orders.parquet"))
    return rows.withColumn("created_at", F.col("created_at").cast("timestamp")).withColumn("decided_at", F.col("decided_at").cast("timestamp")).withColumn(
        "snapshot", F.struct("risk_score", "risk_level")).drop("risk_score", "risk_level")


@query("rp19_case_list", "SELECT case_id, account_id, priority, assignee FROM cases WHERE status = 'OPEN' AND assignee = 'analyst2'")
def _(spark, folder):
    return workflow.list_cases(_cases(spark, folder), status="open", assignee="analyst2").select("case_id", "account_id", "priority", "assignee")


@query("rp20_case_counts", f"""
SELECT status, count(case_id) AS cases FROM (SELECT unnest({list(fixed.STATUSES)}) AS status) LEFT JOIN cases USING (status) GROUP BY 1""")
def _(spark, folder):
    return workflow.case_counts(_cases(spark, folder))


@query("rp20_case_stats", """
SELECT count(*) AS total, count(*) FILTER (disposition IS NULL) AS active, count(disposition) AS decided,
       round(count(*) FILTER (status = 'SAR_FILED')/count(disposition), 3) AS confirmed_rate, round(avg(epoch(decided_at - created_at)/3600), 2) AS average_hours_to_decision FROM cases""")
def _(spark, folder):
    return workflow.case_stats(_cases(spark, folder))


@query("rp21_decision_labels", """
SELECT account_id, CASE WHEN disposition = 'confirmed_suspicious' THEN 1 ELSE 0 END AS label, disposition, case_id, decided_by, epoch_us(decided_at)//1000000 AS decided_at,
       risk_score AS model_risk_score, risk_level AS model_risk_level FROM cases WHERE disposition IS NOT NULL""")
def _(spark, folder):
    return workflow.decision_labels(_cases(spark, folder)).withColumn("decided_at", F.unix_seconds("decided_at"))


STEPS = """
SELECT concat('C', user_id, '_', CAST({k} AS BIGINT) % 10) AS case_id, concat('A', user_id % 40) AS account_id, event_id AS seq, concat('t', event_id) AS at,
       concat('u', event_id % 7) AS by, event_id % 3 > 0 AS can_decide,
       CASE event_type WHEN 'click' THEN 'OPEN' WHEN 'signup' THEN 'ESCALATED' WHEN 'purchase' THEN CASE WHEN event_id % 4 = 0 THEN 'CLOSED_FALSE_POSITIVE' ELSE 'SAR_FILED' END
            WHEN 'error' THEN CASE WHEN value > 100 THEN 'PENDING' ELSE 'IN_REVIEW' END END AS status,
       CASE WHEN value > 40 THEN 'seen' WHEN value > 20 THEN ' ' END AS reason
FROM {events}"""
CTES["steps"] = STEPS.format(k="json_extract_string(props, '$.k')", events="events").replace("concat(", "concat_ws('', ")
CTES["moves"] = """
SELECT *, lag(status) OVER (PARTITION BY case_id ORDER BY seq) AS from_status, row_number() OVER (PARTITION BY case_id ORDER BY seq) AS place,
       row_number() OVER (PARTITION BY case_id ORDER BY seq DESC) AS back FROM steps WHERE status IS NOT NULL"""
_ALLOWED = " OR ".join(f"(from_status = '{a}' AND status IN ({', '.join(repr(b) for b in bs)}))" for a, bs in fixed.TRANSITIONS.items())
_DECIDED = f"({', '.join(repr(d) for d in fixed.DECISIONS)})"
CTES["faults"] = f"""
SELECT case_id, seq, from_status, status, CASE WHEN status NOT IN ({', '.join(repr(s) for s in fixed.STATUSES)}) THEN 'unknown status'
  WHEN from_status IS NULL THEN CASE WHEN status <> 'OPEN' THEN 'case does not start open' END
  WHEN NOT ({_ALLOWED}) THEN 'move not allowed'
  WHEN (status IN {_DECIDED} OR from_status IN {_DECIDED}) AND NOT can_decide THEN 'decision needs a compliance officer'
  WHEN status IN {_DECIDED} AND coalesce(trim(reason), '') = '' THEN 'decision needs a reason' END AS problem
FROM moves WHERE from_status IS NULL OR from_status <> status"""
CTES["states"] = f"""
SELECT case_id, account_id, max(CASE WHEN back = 1 THEN status END) AS status, max(CASE WHEN place = 1 THEN "at" END) AS created_at, max(CASE WHEN place = 1 THEN "by" END) AS created_by,
       max(CASE WHEN back = 1 THEN "at" END) AS updated_at, max(CASE WHEN back = 1 AND status IN {_DECIDED} THEN "at" END) AS decided_at,
       max(CASE WHEN back = 1 AND status IN {_DECIDED} THEN "by" END) AS decided_by,
       max(CASE WHEN back = 1 AND status = 'SAR_FILED' THEN 'confirmed_suspicious' WHEN back = 1 AND status = 'CLOSED_FALSE_POSITIVE' THEN 'false_positive' END) AS disposition,
       max(CASE WHEN back = 1 AND status IN {_DECIDED} THEN reason END) AS disposition_reason FROM moves GROUP BY 1, 2"""


def _steps(spark, folder) -> DataFrame:
    return spark.sql(STEPS.format(k="get_json_object(props, '$.k')", events="{events}"), events=spark.read.parquet(f"{folder}/events.parquet"))


@query("rp22_case_violations", "SELECT case_id, seq, from_status, status, problem FROM faults WHERE problem IS NOT NULL")
def _(spark, folder):
    return workflow.case_violations(_steps(spark, folder))


@query("rp22_case_states", "SELECT * FROM states")
def _(spark, folder):
    return workflow.case_states(_steps(spark, folder))


@query("rp22_duplicate_active_cases", f"""
SELECT account_id, count(*) AS active_cases FROM states WHERE status NOT IN {_DECIDED} GROUP BY 1 HAVING count(*) > 1""")
def _(spark, folder):
    return workflow.duplicate_active_cases(workflow.case_states(_steps(spark, folder)))


@query("rp22_open_cases", f"""
SELECT account_id, 'P2' AS priority, 'OPEN' AS status, risk_score FROM (
  SELECT DISTINCT 'A'||user_id AS account_id, CAST(user_id AS DOUBLE) AS risk_score FROM events WHERE user_id % 2 = 0)
WHERE account_id NOT IN (SELECT account_id FROM states WHERE status NOT IN {_DECIDED})""")
def _(spark, folder):
    users = spark.read.parquet(f"{folder}/events.parquet").select("user_id").distinct()
    reports = users.select(F.concat(F.lit("A"), "user_id").alias("account_id"), dbl("user_id").alias("risk_score"),
                           F.when(F.col("user_id") % 2 == 0, "HIGH").otherwise("MEDIUM").alias("risk_level"))
    due = workflow.open_cases(reports, workflow.case_states(_steps(spark, folder)))
    return due.select("account_id", "priority", "status", F.col("snapshot.risk_score").alias("risk_score"))


AUDIT = """
SELECT CAST(s_suppkey + 1 AS BIGINT) AS seq, concat('t', s_suppkey) AS timestamp, concat('u', s_suppkey % 7) AS actor, 'analyst' AS role,
       CASE WHEN s_suppkey % 2 = 0 THEN 'case.open' ELSE 'case.move' END AS action, s_name AS target, 'success' AS outcome FROM {supplier}"""


def _audit(spark, folder) -> DataFrame:
    """Entries with self-consistent hashes; each chained to what its predecessor names, but for every thirtieth."""
    rows = spark.sql(AUDIT, supplier=spark.read.parquet(f"{folder}/supplier.parquet"))
    rows = rows.withColumn("details", F.create_map(F.lit("at"), F.col("timestamp")))
    named = F.when(F.col("seq") == 1, F.lit(fixed.GENESIS_HASH)).otherwise(F.sha2(F.concat(F.lit("entry"), (F.col("seq") - 1).cast("string")), 256))
    rows = rows.withColumn("prev_hash", named)
    return rows.withColumn("hash", workflow.entry_hash())


CTES["entries"] = AUDIT.format(supplier="supplier").replace("concat(", "concat_ws('', ")
CTES["hashed"] = f"""
SELECT *, CASE WHEN seq = 1 THEN '{fixed.GENESIS_HASH}' ELSE sha256('entry'||(seq - 1)) END AS prev_hash FROM entries"""
CTES["sealed"] = """
SELECT *, sha256('{"seq":'||seq||',"timestamp":"'||timestamp||'","actor":"'||actor||'","role":"'||role||'","action":"'||action||'","target":"'||target||'","outcome":"'||outcome
  ||'","details":{"at":"'||timestamp||'"},"prev_hash":"'||prev_hash||'"}') AS hash FROM hashed"""


@query("rp23_audit_hashes", "SELECT seq, prev_hash, hash FROM sealed")
def _(spark, folder):
    return _audit(spark, folder).select("seq", "prev_hash", "hash")


@query("rp23_audit_chain", """
SELECT min(bad) IS NULL AS valid, any_value(n) AS entries, min(bad) AS broken_at_seq, (SELECT hash FROM sealed WHERE seq = (SELECT min(seq) FROM sealed)) AS head_hash FROM (
  SELECT count(*) OVER () AS n, CASE WHEN a.seq > 1 AND a.prev_hash IS DISTINCT FROM b.hash THEN a.seq END AS bad FROM sealed a LEFT JOIN sealed b ON b.seq = a.seq - 1)""")
def _(spark, folder):
    """The second entry names a hash that the first does not have: the break is found, the head is the first entry."""
    return workflow.verify_audit(_audit(spark, folder))


@query("rp24_audit_page", "SELECT seq, actor, target FROM entries WHERE action = 'case.open' AND actor = 'u3' ORDER BY seq DESC LIMIT 10")
def _(spark, folder):
    return workflow.list_audit(_audit(spark, folder), action="case.open", actor="u3", limit=10).select("seq", "actor", "target")


# -------------------------------------------------------------------------------------- reports
CTES["linked"] = """
SELECT account_id, count(*) AS n, sum(amount) FILTER (direction = 'IN') AS tin, sum(amount) FILTER (direction = 'OUT') AS tout FROM (
  SELECT *, row_number() OVER (PARTITION BY account_id ORDER BY t DESC, transaction_id) AS rank FROM (
    SELECT sender_id AS account_id, 'OUT' AS direction, transaction_id, t, amount FROM ev UNION ALL SELECT receiver_id, 'IN', transaction_id, t, amount FROM ev)) WHERE rank <= 60 GROUP BY 1"""


@query("rp18_report_drafts", f"""
SELECT c.case_id, c.account_id, 'STR-DRAFT-'||c.case_id AS reference, c.status, coalesce(n, 0) AS linked, {r('coalesce(tin, 0)', 2)} AS total_incoming,
       {r('coalesce(tout, 0)', 2)} AS total_outgoing, i AS current_score, 64 AS digits
FROM (SELECT case_id, 'U'||substr(account_id, 2) AS account_id, status FROM cases) c LEFT JOIN linked USING (account_id)
LEFT JOIN ev_deg USING (account_id)""")
def _(spark, folder):
    tx = cut(views.tx_events(spark, folder))
    cases = _cases(spark, folder).withColumn("account_id", F.concat(F.lit("U"), F.expr("substr(account_id, 2)")))
    reports = graph.degrees(graph.account_pairs(tx)).select("account_id", F.col("in_degree").alias("risk_score"), F.lit("HIGH").alias("risk_level"))
    drafts = workflow.report_drafts(cases, report.linked_transactions(tx), reports, F.lit(fixed.GENESIS_HASH))
    got = F.col("report")
    return drafts.select(
        "case_id", "account_id", got["report_reference"].alias("reference"), got["case"]["status"].alias("status"), got["transactions"]["count"].alias("linked"),
        got["transactions"]["total_incoming"].alias("total_incoming"), got["transactions"]["total_outgoing"].alias("total_outgoing"),
        got["current_score"].alias("current_score"), F.length("content_sha256").alias("digits"))


@query("rp2_classifier_sentence", """
SELECT account_id, CASE WHEN u >= 30 THEN 'Trained classifier rates this account '||least(u, 100)||'% similar to known laundering typologies'
    ||CASE WHEN i > o THEN '. Main drivers: payers = '||i||' (typical 20); payees = '||o||' (typical 25).' ELSE '.' END
    ||CASE WHEN mutual >= 5 THEN ' | Mutual partners.' ELSE '' END
  WHEN mutual >= 5 THEN 'Mutual partners.' ELSE 'Normal transactional behavior: no anomalous patterns or metric deviations detected.' END AS evidence FROM ev_deg""")
def _(spark, folder):
    degree = cut(graph.degrees(graph.account_pairs(views.tx_events(spark, folder))))
    normal = F.array(F.lit("Normal transactional behavior: no anomalous patterns or metric deviations detected."))
    rows = degree.select("account_id", (F.least("unique_counterparties", F.lit(100)) / 100).alias("supervised_probability"),
                         F.when(F.col("mutual") >= 5, F.array(F.lit("Mutual partners."))).otherwise(normal).alias("evidence"))
    parts = F.explode(F.array(
        F.struct(F.lit(1).alias("place"), F.lit("payers").alias("label"), dbl("in_degree").alias("value"), F.lit(20.0).alias("typical")),
        F.struct(F.lit(2).alias("place"), F.lit("payees").alias("label"), dbl("out_degree").alias("value"), F.lit(25.0).alias("typical"))))
    why = degree.where("in_degree > out_degree").select("account_id", parts.alias("p")).select("account_id", "p.*")
    return report.with_classifier_sentence(rows, 0.3, why).select("account_id", F.array_join("evidence", " | ").alias("evidence"))
