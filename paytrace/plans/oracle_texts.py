"""DuckDB twins of the analyst texts: findings, headlines and summaries."""

from __future__ import annotations

from ..functions import fixed
from .oracle import CTES, ORACLES, ORDERED, quoted, r, sql, thousands, whole


def money(x: str) -> str:
    return f"'BDT '||{thousands(x)}"


def typology(field: int) -> str:
    rules = " ".join("WHEN " + " AND ".join(f"list_contains(found, '{p}')" for p in rule[0]) + f" THEN {quoted(rule[field])}" for rule in fixed.TYPOLOGIES)
    return f"CASE {rules} ELSE {quoted(fixed.NO_TYPOLOGY[field - 1])} END"


FINDINGS = (
    ("list_contains(found, 'structuring')",
     f"CASE WHEN z.role = 'splitter' THEN 'Sent' ELSE 'Received' END||' '||z.near_threshold_count||' transfers just under BDT 10,000, totalling '||{money('z.total_amount')}||' within 24 hours.'"),
    ("list_contains(found, 'fan_in')", "'Received money from '||in_degree||' different wallets.'"),
    ("list_contains(found, 'fan_out')", "'Sent money to '||out_degree||' different wallets.'"),
    ("list_contains(found, 'rapid_movement')",
     "'Passed received money straight on '||CASE WHEN q.forwards = 1 THEN 'once' ELSE q.forwards||' times' END||' (to '||q.destinations||' wallet'||CASE WHEN q.destinations <> 1 THEN 's' ELSE '' END"
     f"||'), the fastest within '||CASE WHEN q.fastest_latency_seconds < 60 THEN 'under a minute' ELSE {whole('q.fastest_latency_seconds/60')}||' minutes' END||' of receipt.'"),
    ("list_contains(found, 'circular_flow')",
     f"'Money went around the loop '||array_to_string(list_append(l.path, l.path[1]), ' -> ')||' in '||{whole('l.secs/60')}||' minutes and '"
     f"||{whole(r('CAST(a1 AS DOUBLE)/CAST(a0 AS DOUBLE)', 3) + '*100')}||'% of it came back.'"),
    ("passthrough_ratio >= 0.85 AND total_incoming > 1000", f"'Passed on '||{whole('passthrough_ratio*100')}||'% of everything it received, keeping almost nothing.'"),
    ("is_anomaly", f"'The Isolation Forest model ranks its overall behaviour as a statistical outlier (ML score '||{whole('ml_component')}||'/100).'"),
)
CTES["findings"] = ("SELECT account_id, list_filter([" + ", ".join(f"CASE WHEN {c} THEN {t} END" for c, t in FINDINGS) + """], lambda x: x IS NOT NULL) AS told
FROM scored LEFT JOIN loop_of l USING (account_id) LEFT JOIN ev_rapid10_acc q USING (account_id) LEFT JOIN str_of z USING (account_id)""")
ORACLES["rp4_key_findings"] = sql("""
SELECT account_id, i - 1 AS position, told[i] AS finding FROM (SELECT account_id, told, unnest(range(1, len(told) + 1)) AS i FROM findings)""")
_LABELS = "MAP {" + ", ".join(f"'{p}': {quoted(t)}" for p, t in fixed.PATTERN_LABELS.items()) + "}"
ORACLES["rp7_summaries"] = sql(f"""
SELECT account_id, CASE WHEN len(found) > 0 THEN {typology(1)}||': '||account_id ELSE 'Routine activity: '||account_id END AS headline,
       account_id||' scores '||CAST(round(CAST(risk_score AS DECIMAL(12,2)), 1) AS DECIMAL(12,1))||'/100 ('||risk_level||'). '||CASE WHEN len(found) > 0 THEN
         'It '||{typology(2)}||'. Detected patterns: '||array_to_string(list_transform({ORDERED}, lambda p: coalesce(({_LABELS})[p], p)), ', ')
         ||'. Received '||{money('total_incoming')}||' and sent '||{money('total_outgoing')}||' across '||transaction_count||' transactions.'
       ELSE 'No network pattern was detected; '||transaction_count||' transactions look like ordinary activity.'
         ||CASE WHEN is_anomaly THEN ' The ML model still ranks it as an outlier, so a quick manual look is worthwhile.' ELSE '' END END AS summary FROM scored""")
