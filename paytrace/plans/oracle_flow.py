"""DuckDB twins of flow tracing and of what is computed from it.

Every payment that some receipt could fund waits for the payments it depends on: the one before it of its account, and those
that brought its candidate receipts. Levels of that order are found first; then a keyed recursion serves one level after another.
A receipt is served once; the deepest, then the newest, candidate is taken. No account of the sample has more receipts inside a
window than an inbox holds, so the twin needs no eviction.
"""

from __future__ import annotations

from ..functions import fixed
from .oracle import CTES, HEADS, ORACLES, d, fan, r, rc, sql, tier_of

WINDOWS = {"fast": fixed.FAST_WINDOW, "slow": fixed.SLOW_WINDOW}

CTES["flow_tx"] = """
SELECT *, row_number() OVER (ORDER BY t, sender, receiver, units, tx) AS i FROM (
  SELECT transaction_id AS tx, sender_id AS sender, receiver_id AS receiver, CAST(amount*10000 AS BIGINT) AS units, t FROM ev) WHERE units >= 7000000"""
for _v, _w in WINDOWS.items():
    CTES[f"could_{_v}"] = f"""
SELECT p.i AS p, p.sender AS account, p.t - r.t AS gap, r.i AS r FROM flow_tx p JOIN flow_tx r ON r.receiver = p.sender AND r.units >= 10000000
 AND r.t < p.t AND p.t - r.t <= {_w} AND 7*r.units <= 10*p.units AND 10*p.units <= 11*r.units"""
    CTES[f"turn_{_v}"] = f"SELECT p, lag(p) OVER (PARTITION BY account ORDER BY p) AS prior FROM (SELECT DISTINCT p, account FROM could_{_v})"
    CTES[f"after_{_v}"] = f"SELECT p, prior AS q FROM turn_{_v} WHERE prior IS NOT NULL UNION SELECT c.p, c.r FROM could_{_v} c JOIN turn_{_v} u ON u.p = c.r"
    CTES[f"level_{_v}"] = f"""
SELECT p, 1::BIGINT AS level FROM turn_{_v} UNION
(SELECT a.p, max(l.level) + 1 FROM level_{_v} l JOIN after_{_v} a ON a.q = l.p JOIN recurring.level_{_v} c ON c.p = a.p
 GROUP BY a.p, c.level HAVING max(l.level) + 1 > c.level)"""
    HEADS[f"level_{_v}"] = f"level_{_v}(p, level) USING KEY (p) AS"
    CTES[f"plan_{_v}"] = f"SELECT c.*, l.level FROM could_{_v} c JOIN level_{_v} l ON l.p = c.p"
    # the row of p = -1 holds the level served last
    CTES[f"served_{_v}"] = f"""
SELECT -1::BIGINT, 0::BIGINT, -1::BIGINT, 0::BIGINT, 0::BIGINT UNION
(SELECT s.p, max(coalesce(z.depth, 1)) + 1, max_by(s.r, struct_pack(a := coalesce(z.depth, 1), b := s.r)),
        max_by(s.gap, struct_pack(a := coalesce(z.depth, 1), b := s.r)), any_value(s.level)
 FROM (SELECT max(n) AS n FROM served_{_v}) now JOIN plan_{_v} s ON s.level = now.n + 1 LEFT JOIN recurring.served_{_v} z ON z.p = s.r
 WHERE s.r NOT IN (SELECT r FROM recurring.served_{_v}) GROUP BY s.p
 UNION ALL SELECT -1, 0, -1, 0, n FROM (SELECT max(n) + 1 AS n FROM served_{_v}) WHERE n <= (SELECT max(level) FROM plan_{_v}))"""
    HEADS[f"served_{_v}"] = f"served_{_v}(p, depth, r, gap, n) USING KEY (p) AS"
    for _name in ("could", "turn", "after", "plan"):
        HEADS[f"{_name}_{_v}"] = f"{_name}_{_v} AS MATERIALIZED"
HEADS["flow_tx"] = "flow_tx AS MATERIALIZED"
CTES["funded"] = " UNION ALL ".join(f"SELECT {_w} AS w, p, r, depth, gap FROM served_{_v} WHERE p >= 0" for _v, _w in WINDOWS.items())
HEADS["funded"] = "funded AS MATERIALIZED"
CTES["walk"] = f"""
SELECT w, p, r AS back, [p] AS hops FROM funded UNION ALL
SELECT k.w, k.p, z.r, list_prepend(k.back, k.hops) FROM walk k LEFT JOIN funded z ON z.w = k.w AND z.p = k.back WHERE k.back IS NOT NULL AND len(k.hops) < {fixed.FLOW_MAX_PATH}"""
CTES["traced_path"] = f"""
SELECT z.w, z.p, z.depth, z.gap, x.tx, x.receiver AS account, x.sender, x.t, x.units, h.path, h.ts, h.us FROM funded z JOIN flow_tx x ON x.i = z.p JOIN (
  SELECT w, p, list(sender ORDER BY k) AS path, list(t ORDER BY k) AS ts, list(units ORDER BY k) AS us FROM (
    SELECT w, p, unnest(hops) AS i, generate_subscripts(hops, 1) AS k FROM walk WHERE back IS NULL OR len(hops) = {fixed.FLOW_MAX_PATH}) JOIN flow_tx USING (i) GROUP BY 1, 2) h
ON h.w = z.w AND h.p = z.p"""
HEADS["traced_path"] = "traced_path AS MATERIALIZED"
CTES["traced_loop"] = """
SELECT w, tx, t, path[pos:] AS nodes, t - ts[pos] AS duration, us[pos]/10000 AS first, units/10000 AS closing
FROM (SELECT *, list_position(path, account) AS pos FROM traced_path) WHERE pos > 0 AND len(path) - pos + 1 >= 3"""
CTES["flow_accounts"] = """
SELECT c.w, c.account_id, c.chain_length, coalesce(f.n, 0) AS forward_count, coalesce(f.amount, 0) AS forwarded_amount, coalesce(f.gap, -1) AS dwell_mean,
       coalesce(l.n, 0) AS cycle_count
FROM (SELECT w, account_id, max(depth) AS chain_length FROM (SELECT w, depth, unnest(list_append(path, account)) AS account_id FROM traced_path) GROUP BY 1, 2) c
LEFT JOIN (SELECT w, sender AS account_id, count(*) AS n, CAST(sum(units) AS DOUBLE)/10000 AS amount, avg(gap) AS gap FROM traced_path GROUP BY 1, 2) f
  ON f.w = c.w AND f.account_id = c.account_id
LEFT JOIN (SELECT w, account_id, count(*) AS n FROM (SELECT w, unnest(nodes) AS account_id FROM traced_loop) GROUP BY 1, 2) l ON l.w = c.w AND l.account_id = c.account_id"""
HEADS["flow_accounts"] = "flow_accounts AS MATERIALIZED"

ORACLES["fl2_funding"] = sql("SELECT z.w AS window, a.tx, b.tx AS funded_by, depth, gap AS wait FROM funded z JOIN flow_tx a ON a.i = z.p JOIN flow_tx b ON b.i = z.r")
ORACLES["fl3_paths"] = sql("SELECT w AS window, tx, depth, array_to_string(list_append(path, account), '>') AS path FROM traced_path")
ORACLES["fl4_chain_length"] = sql("SELECT account_id, chain_length, w AS window FROM flow_accounts")
ORACLES["fl5_loop_counts"] = sql("SELECT account_id, cycle_count, w AS window FROM flow_accounts")
ORACLES["fl5_loops"] = sql("""
SELECT w AS window, tx, t, array_to_string(nodes, '>') AS nodes, len(nodes) AS length, duration AS duration_seconds, first AS first_amount, closing AS closing_amount FROM traced_loop""")
ORACLES["fl6_forwards"] = sql(f"SELECT account_id, forward_count, {rc('forwarded_amount')}, w AS window FROM flow_accounts")
ORACLES["fl7_dwell"] = sql(f"SELECT account_id, {rc('dwell_mean')}, w AS window FROM flow_accounts")
ORACLES["fl8_chain_details"] = sql("""
SELECT array_to_string(list_append(path, account), '>') AS chain_path, depth AS hops, t AS end_time, units/10000 AS amount, tx, w AS window
FROM traced_path WHERE depth >= 3 AND NOT list_contains(path, account)""")
CTES["told_loops"] = """
SELECT array_to_string(nodes, '>') AS nodes, len(nodes) AS length, round(CAST(duration AS DOUBLE), 1) AS loop_duration_seconds,
       round(closing/greatest(first, 1e-9), 3) AS amount_retained_ratio, t, tx
FROM (SELECT *, row_number() OVER (PARTITION BY list_sort(nodes) ORDER BY w, t, tx) AS k FROM traced_loop) WHERE k = 1"""
ORACLES["pt8_traced_loops"] = sql("SELECT * FROM told_loops")
CTES["told_chains"] = f"""
SELECT account_id, max(chain_length) AS chain_length FROM flow_accounts GROUP BY 1
HAVING max(CASE WHEN w = {WINDOWS['fast']} THEN chain_length END) >= 3 OR max(CASE WHEN w = {WINDOWS['slow']} THEN chain_length END) >= 4"""
ORACLES["pt9_traced_chains"] = sql("SELECT * FROM told_chains")
CTES["ev_scc"] = """
SELECT a AS account_id, min(b) AS component, count(*) AS component_size
FROM (SELECT x.a, x.b FROM ev_reach x JOIN ev_reach y ON x.a = y.b AND x.b = y.a UNION SELECT account_id, account_id FROM ev_nodes) GROUP BY a"""
CTES["ev_clusters"] = CTES["dy_clusters"].replace("dy_", "ev_").replace("ev_strong", "ev_scc")
CTES["ev_wide_in"], CTES["ev_wide_out"] = fan("ev", True, 2.0), fan("ev", False, 2.0)
ORACLES["pt11_flags_traced"] = sql("""
SELECT account_id, 'fan_in' AS pattern FROM ev_wide_in UNION SELECT account_id, 'fan_out' FROM ev_wide_out
UNION SELECT account_id, 'circular_flow' FROM flow_accounts WHERE cycle_count > 0 UNION SELECT account_id, 'transaction_chain' FROM told_chains
UNION SELECT account_id, 'rapid_movement' FROM ev_rapid UNION SELECT account_id, 'structuring' FROM ev_str
UNION SELECT account_id, 'coordinated_network' FROM ev_scc JOIN ev_clusters USING (component)""")

# ------------------------------------------------------------------------------- feature store
CTES["flow_columns"] = "SELECT ev_tot.account_id, " + ", ".join(
    f"coalesce({_v}.forward_count, 0)::DOUBLE AS forward_count_{_v}, coalesce({_v}.forwarded_amount/(tin + 1.0), 0) AS forward_share_{_v}, "
    f"coalesce({_v}.chain_length, 0)::DOUBLE AS chain_length_{_v}, coalesce({_v}.cycle_count, 0)::DOUBLE AS cycle_count_{_v}, coalesce({_v}.dwell_mean, -1) AS dwell_{_v}_s"
    for _v in WINDOWS) + " FROM ev_tot " + " ".join(
    f"LEFT JOIN (SELECT * FROM flow_accounts WHERE w = {_w}) {_v} ON {_v}.account_id = ev_tot.account_id" for _v, _w in WINDOWS.items())
ORACLES["fs13_dwell"] = sql(f"SELECT account_id, {rc('dwell_fast_s')}, {rc('dwell_slow_s')} FROM flow_columns")
ORACLES["fs16_flow_columns"] = sql("SELECT account_id, " + ", ".join(rc(c) for c in fixed.GRAPH[10:]) + " FROM flow_columns")
CTES["msg10"] = """
SELECT account_id, ln(1 + tin) AS log_total_incoming, ln(1 + tout) AS log_total_outgoing, passthrough_ratio, chain_length_slow,
       least(forward_share_slow, 2.0) AS forward_share_slow, near_out + near_in AS near_threshold_total, least(cycle_count_slow, 10.0) AS cycle_count_slow,
       night/n AS night_share, ln(1 + i) AS log_in_degree, ln(1 + o) AS log_out_degree
FROM ev_tot JOIN ev_deg USING (account_id) JOIN ev_fs USING (account_id) JOIN flow_columns USING (account_id)"""
HEADS["msg10"] = "msg10 AS MATERIALIZED"
_MSG = fixed.MESSAGE_BASE
ORACLES["fs17_message_base"] = sql("SELECT account_id, " + ", ".join(rc(c) for c in _MSG) + " FROM msg10")
_MEANS = ", ".join(f"avg({c}) AS {c}" for c in _MSG)
CTES["nb10_in_"] = f"SELECT dst AS account_id, {_MEANS} FROM ev_pairs JOIN msg10 ON src = account_id GROUP BY dst"
CTES["nb10_out_"] = f"SELECT src AS account_id, {_MEANS} FROM ev_pairs JOIN msg10 ON dst = account_id GROUP BY src"
CTES["nb10_one"] = f"SELECT node AS account_id, {_MEANS} FROM ev_both JOIN msg10 ON nbr = account_id GROUP BY node"
CTES["nb10_two"] = f"SELECT node AS account_id, {_MEANS} FROM ev_both JOIN nb10_one ON nbr = account_id GROUP BY node"
_SIDES = {"nb_in_": "nb10_in_", "nb_out_": "nb10_out_", "nb2_": "nb10_two"}
for _q, _p in (("gr16_payer_means", "nb_in_"), ("gr16_payee_means", "nb_out_"), ("gr16_two_step_means", "nb2_")):
    ORACLES[_q] = sql("SELECT n.account_id, " + ", ".join(f"coalesce({r('x.' + c)}, 0) AS {_p}{c}" for c in _MSG)
                      + f" FROM ev_nodes n LEFT JOIN {_SIDES[_p]} x ON x.account_id = n.account_id")
CTES["neighbour_columns"] = "SELECT n.account_id, " + ", ".join(
    f"coalesce({_p}x.{c}, 0) AS {_p}{c}" for _p in _SIDES for c in _MSG) + " FROM ev_nodes n " + " ".join(
    f"LEFT JOIN {_cte} {_p}x ON {_p}x.account_id = n.account_id" for _p, _cte in _SIDES.items())
ORACLES["fs18_neighbourhood"] = sql("SELECT account_id, " + ", ".join(rc(c) for c in fixed.NEIGHBOURHOOD) + " FROM neighbour_columns")
CTES["temporal_columns"] = """
SELECT ev_tot.account_id, active_days, (t1 - t0)/3600.0 AS active_span_hours, n/greatest((t1 - t0)/3600.0, 0.1) AS transaction_velocity, h.c AS max_tx_per_hour,
       z.s AS max_senders_2h, z.p AS max_receivers_2h, night/n AS night_share, e.hour_entropy, coalesce(g.m, -1) AS inter_arrival_median_s,
       coalesce(g.s/(g.a + 1e-6), 0) AS inter_arrival_cv, coalesce((g.s - g.a)/(g.s + g.a + 1e-6), 0) AS burstiness, same_day_turnover
FROM ev_tot JOIN ev_daily USING (account_id) JOIN (SELECT account_id, max(c) AS c FROM ev_hours GROUP BY 1) h USING (account_id)
JOIN (SELECT account_id, max(s) AS s, max(p) AS p FROM ev_slots GROUP BY 1) z USING (account_id)
JOIN (SELECT account_id, greatest(0.0, -sum(p*ln(p))) AS hour_entropy FROM (
  SELECT account_id, sum(c)/sum(sum(c)) OVER (PARTITION BY account_id) AS p FROM ev_hours GROUP BY account_id, h % 24) GROUP BY 1) e USING (account_id)
LEFT JOIN (SELECT account_id, median(g) AS m, avg(g) AS a, coalesce(stddev_samp(g), 0) AS s FROM ev_gaps GROUP BY 1) g USING (account_id)"""
CTES["graph_columns"] = """
SELECT ev_deg.account_id, i AS in_degree, o AS out_degree, i/(o + 1.0) AS degree_ratio, mutual/u AS reciprocity, k.v*(SELECT count(*) FROM ev_nodes) AS pagerank,
       component_size AS scc_size, coalesce(c, 0) AS triad_cycles, coalesce(f, 0) AS two_hop_out, coalesce(g, 0) AS two_hop_in, a.m AS avg_neighbor_degree
FROM ev_deg JOIN rank_30 k USING (account_id) JOIN ev_scc USING (account_id) LEFT JOIN triads USING (account_id) LEFT JOIN hops_out USING (account_id)
LEFT JOIN hops_in USING (account_id) JOIN (SELECT node AS account_id, avg(u) AS m FROM ev_both JOIN ev_deg ON nbr = account_id GROUP BY 1) a USING (account_id)"""
_FLAGS = ", ".join(f"CASE WHEN {tier_of('account_id')} = '{t}' THEN 1 ELSE 0 END AS tier_{t}" for t in fixed.TIERS)
CTES["whole_store"] = f"""
SELECT account_id, x.* EXCLUDE (account_id, transaction_velocity, unique_senders, unique_receivers), y.* EXCLUDE (account_id), g.* EXCLUDE (account_id), q.* EXCLUDE (account_id),
       b.* EXCLUDE (account_id), {_FLAGS}
FROM ev_fs x JOIN temporal_columns y USING (account_id) JOIN graph_columns g USING (account_id) JOIN flow_columns q USING (account_id) JOIN neighbour_columns b USING (account_id)"""
ORACLES["fs20_feature_store"] = sql("SELECT account_id, " + ", ".join(f"{r(d(c), 4)} AS {c}" for c in fixed.ALL_FEATURES) + " FROM whole_store")
