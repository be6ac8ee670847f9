"""DuckDB twins of the takeover detector and of what is computed from it.

A keyed recursion judges the next episode of every account per step. What an alerting episode flagged leaves the baseline of the
account's later episodes, so each step looks at all episodes judged so far.
"""

from __future__ import annotations

from ..functions import fixed
from .oracle import CTES, HEADS, ORACLES, r, sql

_FIRST, _HANDSET, _FAST, _STRANGERS = fixed.TAKEOVER_SIGNALS

CTES["placed"] = """
SELECT 'TX_'||event_id AS transaction_id, CASE WHEN event_id % 97 = 0 THEN 'Zone-13' ELSE 'Zone-'||lpad(CAST(user_id % 12 + 1 AS VARCHAR), 2, '0') END AS area,
       'DEV-'||user_id||CASE WHEN event_id % 97 = 0 THEN '-X' ELSE '-1' END AS device FROM events"""
CTES["tk_rows"] = """
SELECT *, row_number() OVER (PARTITION BY account ORDER BY t, receiver, amount, transaction_id) AS o FROM (
  SELECT sender_id AS account, receiver_id AS receiver, amount, t, transaction_id, area, device, area IN ('Zone-13', 'Zone-14') AS risky
  FROM ev JOIN placed USING (transaction_id)) WHERE account IN (SELECT sender_id FROM ev JOIN placed USING (transaction_id) WHERE area IN ('Zone-13', 'Zone-14'))"""
HEADS["tk_rows"] = "tk_rows AS MATERIALIZED"
_TOTAL = "15 + CASE WHEN handset THEN 15 ELSE 0 END + CASE WHEN drain THEN 15 ELSE 0 END + CASE WHEN strangers THEN 10 ELSE 0 END"
CTES["tk"] = f"""
SELECT account, 0::BIGINT, 0::BIGINT, -1000000::BIGINT, ''::VARCHAR, 0::BIGINT, 0::DOUBLE, 0::DOUBLE, 0::BIGINT, FALSE, FALSE, FALSE, FALSE FROM tk_rows GROUP BY account
UNION (
WITH gone AS (SELECT DISTINCT y.account, y.o FROM tk_rows y JOIN recurring.tk e ON e.account = y.account AND e.alert AND y.risky AND y.o >= e.o AND y.t - e.t <= 86400),
 basis AS (SELECT y.* FROM tk_rows y LEFT JOIN gone USING (account, o) WHERE gone.o IS NULL),
 counted AS (SELECT x.account, e.k + 1 AS k, x.o, x.t, x.area, x.device, count(y.area) AS located, count(y.area) FILTER (y.area = x.area) AS same
   FROM tk e JOIN tk_rows x ON x.account = e.account AND x.risky AND x.t > e.t + 86400 JOIN basis y ON y.account = x.account AND y.o < x.o GROUP BY ALL),
 start AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY account ORDER BY o) AS first FROM counted WHERE located >= 3 AND same < 0.1*located) WHERE first = 1),
 before AS (SELECT s.account, y.* EXCLUDE (account) FROM start s JOIN basis y ON y.account = s.account AND y.o < s.o),
 usual AS (SELECT account, median(paid) AS typical FROM (SELECT account, t//86400 AS day, CAST(sum(amount) AS DOUBLE) AS paid FROM before GROUP BY 1, 2) GROUP BY 1),
 sets AS (SELECT s.account, count(b.device) > 0 AS had, coalesce(bool_or(b.device = s.device), FALSE) AS same_device FROM start s JOIN before b ON b.account = s.account GROUP BY 1),
 inside AS (SELECT s.account, CAST(sum(x.amount) AS DOUBLE) AS paid, count(*) AS n,
     CAST(coalesce(sum(x.amount) FILTER (NOT EXISTS (SELECT 1 FROM before b WHERE b.account = s.account AND b.receiver = x.receiver)), 0) AS DOUBLE) AS fresh
   FROM start s JOIN tk_rows x ON x.account = s.account AND x.risky AND x.area = s.area AND x.o >= s.o AND x.t - s.t <= 86400 GROUP BY 1),
 told AS (SELECT s.account, s.k, s.o, s.t, s.area, s.located, i.paid, coalesce(u.typical, 0) AS typical, i.n, s.device IS NOT NULL AND had AND NOT same_device AS handset,
     i.paid >= greatest(3.0*coalesce(u.typical, 0), 5000.0) AS drain, i.paid > 0 AND i.fresh/i.paid >= 0.5 AS strangers
   FROM start s JOIN inside i USING (account) JOIN sets USING (account) LEFT JOIN usual u USING (account))
SELECT account, k, o, t, area, located, paid, typical, n, handset, drain, strangers, {_TOTAL} >= 30 FROM told)"""
HEADS["tk"] = "tk(account, k, o, t, area, located, paid, typical, n, handset, drain, strangers, alert) USING KEY (account, k) AS"
CTES["alerts"] = f"SELECT *, {_TOTAL} AS score FROM tk WHERE k > 0 AND alert"
HEADS["alerts"] = "alerts AS MATERIALIZED"
ORACLES["cx1_location_takeover"] = sql(f"""
SELECT account AS account_id, area AS risk_area, t AS first_seen, handset AS new_device, {r('paid', 2)} AS outflow_24h, {r('typical', 2)} AS typical_daily_outflow,
       n AS transactions, score AS signal_score FROM alerts""")
ORACLES["st3_takeover_stream"] = sql(f"""
SELECT account AS account_id, t AS first_seen, area AS risk_area, {r('paid', 2)} AS outflow_24h, n AS transactions, score AS signal_score FROM alerts""")
CTES["flagged"] = """
SELECT DISTINCT y.account, y.o, e.k FROM tk_rows y JOIN alerts e ON e.account = y.account AND y.risky AND y.o >= e.o AND y.t - e.t <= 86400"""
CTES["basis_of"] = """
SELECT e.account, e.k, y.receiver, y.area AS base_area FROM alerts e JOIN tk_rows y ON y.account = e.account AND y.o < e.o
LEFT JOIN flagged f ON f.account = y.account AND f.o = y.o WHERE f.o IS NULL"""
HEADS["basis_of"] = "basis_of AS MATERIALIZED"
CTES["usual_areas"] = """
SELECT account, k, list_sort(list(base_area)) AS areas FROM (
  SELECT b.account, b.k, base_area FROM basis_of b JOIN alerts e ON e.account = b.account AND e.k = b.k WHERE base_area IS NOT NULL
  GROUP BY 1, 2, 3, located HAVING count(*)/located >= 0.1) GROUP BY 1, 2"""
ORACLES["cx2_takeover_details"] = sql(f"""
SELECT e.account AS account_id, t AS first_seen, array_to_string(coalesce(areas, []), ',') AS usual_areas,
       '{_FIRST}'||CASE WHEN handset THEN ';{_HANDSET}' ELSE '' END||CASE WHEN drain THEN ';{_FAST}' ELSE '' END||CASE WHEN strangers THEN ';{_STRANGERS}' ELSE '' END AS signals
FROM alerts e LEFT JOIN usual_areas u ON u.account = e.account AND u.k = e.k""")
CTES["taken"] = """
SELECT e.account, e.k, e.area, x.receiver, x.amount, NOT EXISTS (SELECT 1 FROM basis_of b WHERE b.account = e.account AND b.k = e.k AND b.receiver = x.receiver) AS fresh
FROM alerts e JOIN tk_rows x ON x.account = e.account AND x.risky AND x.area = e.area AND x.o >= e.o AND x.t - e.t <= 86400"""
CTES["collectors"] = f"""
SELECT receiver AS account_id, count(DISTINCT account) AS victim_count, {r('sum(amount)', 2)} AS amount_collected,
       array_to_string(list_sort(list(DISTINCT area)), ',') AS risk_areas FROM taken WHERE fresh GROUP BY 1"""
ORACLES["cx3_takeover_collectors"] = sql("SELECT * FROM collectors")
CTES["context_flags"] = """
SELECT account AS account_id, 'location_anomaly' AS pattern FROM alerts UNION SELECT account_id, 'takeover_collector' FROM collectors WHERE victim_count >= 2
UNION SELECT account_id, 'hundi_operator' FROM operators UNION SELECT funder, 'hundi_funder' FROM funders WHERE account_id IN (SELECT account_id FROM operators)"""
ORACLES["cx11_context_flags"] = sql("SELECT account_id, pattern FROM context_flags")
_KINDS = ", ".join(f"'{p}'" for p in fixed.CONTEXT_PATTERNS)
CTES["judged_flags"] = f"""
SELECT p.pattern, tier = 'agent' AS is_true, tier = 'merchant' AS merchants, f.pattern IS NOT NULL AS flagged
FROM ev_tiers CROSS JOIN (SELECT unnest([{_KINDS}]) AS pattern) p LEFT JOIN context_flags f ON f.account_id = ev_tiers.account_id AND f.pattern = p.pattern"""
_HIT = "count(*) FILTER (flagged AND is_true)"
ORACLES["ev14_detector_quality"] = sql(f"""
SELECT pattern, count(*) FILTER (is_true) AS true_cases, count(*) FILTER (flagged) AS flagged_cases, {_HIT} AS true_positives,
       count(*) FILTER (flagged AND NOT is_true) AS false_positives, count(*) FILTER (merchants) AS merchants,
       count(*) FILTER (merchants AND flagged AND NOT is_true) AS merchants_flagged,
       {r(f'CASE WHEN count(*) FILTER (flagged) > 0 THEN {_HIT}/count(*) FILTER (flagged) ELSE 0 END')} AS "precision",
       {r(f'CASE WHEN count(*) FILTER (is_true) > 0 THEN {_HIT}/count(*) FILTER (is_true) ELSE 0 END')} AS recall,
       {r('CASE WHEN count(*) FILTER (NOT is_true) > 0 THEN count(*) FILTER (flagged AND NOT is_true)/count(*) FILTER (NOT is_true) ELSE 0 END')} AS false_positive_rate
FROM judged_flags GROUP BY 1""")
