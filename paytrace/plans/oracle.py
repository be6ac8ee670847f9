"""DuckDB texts that compute the registered queries independently, for checking.

``CTES`` holds named building blocks; ``sql`` puts the needed ones, in order, in front of a select.
"""

from __future__ import annotations

import re

from ..functions import fixed

CTES: dict[str, str] = {}
HEADS: dict[str, str] = {}  # building blocks that are not plain, e.g. computed once or keyed recursions
ORACLES: dict[str, str] = {}


def sql(select: str) -> str:
    """The select preceded by every building block it mentions, directly or through others."""
    needed: list[str] = []

    def need(text: str, own: str = "") -> None:
        for name in CTES:
            if name != own and name not in needed and re.search(rf"\b{name}\b", text):
                need(CTES[name], name)
                if name not in needed:
                    needed.append(name)

    need(select)
    if not needed:
        return select
    # Chained iterations are computed once each instead of being expanded into one another.
    kept = {n: HEADS.get(n, f"{n} AS MATERIALIZED" if n.startswith("rank_") else f"{n} AS") for n in needed}
    return "WITH RECURSIVE " + ",\n".join(f"{kept[n]} ({CTES[n]})" for n in needed) + "\n" + select


def r(x: str, places: int = 6) -> str:
    """Half-up rounding on the decimal value, as Spark rounds doubles."""
    return f"CAST(round(CAST({x} AS DECIMAL(32,12)), {places}) AS DOUBLE)"


def rc(x: str, places: int = 6) -> str:
    """A rounded column under its own name."""
    return f"{r(x, places)} AS {x}"


def d(x: str) -> str:
    return f"CAST({x} AS DOUBLE)"


# ------------------------------------------------------------------------------------ views
CTES["ev_raw"] = """
SELECT 'TX_'||event_id AS transaction_id, 'U'||user_id AS sender_id,
       'U'||abs(user_id + CAST(json_extract_string(props,'$.k') AS BIGINT) % 20 - 10) AS receiver_id,
       CAST(round(value*200,2) AS DECIMAL(18,4)) AS amount,
       1704067200 + (epoch_us(ts)//1000000 - 1704067200)//8 AS t,
       CASE event_type WHEN 'click' THEN 'send_money' WHEN 'view' THEN 'payment' WHEN 'signup' THEN 'cash_in'
            WHEN 'purchase' THEN 'cash_out' ELSE 'inward_remittance' END AS tx_type
FROM events"""
CTES["ev"] = "SELECT * FROM ev_raw WHERE sender_id <> receiver_id"
CTES["li"] = """
SELECT 'L_'||l_orderkey||'_'||l_linenumber||'_'||l_partkey AS transaction_id,
       CASE WHEN l_returnflag='R' THEN 'MERCH_'||l_suppkey ELSE 'C_'||o_custkey END AS sender_id,
       CASE WHEN l_returnflag='R' THEN 'C_'||o_custkey ELSE 'MERCH_'||l_suppkey END AS receiver_id,
       CAST(l_extendedprice AS DECIMAL(18,4)) AS amount, epoch_us(l_shipdate)//1000000 AS t
FROM lineitem JOIN orders ON l_orderkey=o_orderkey"""
CTES["dy"] = """
SELECT * FROM (
  SELECT 'TX_'||event_id AS transaction_id, 'U'||user_id||'_'||dd AS sender_id,
         'U'||(user_id//6*6 + k%6)||'_'||dd AS receiver_id,
         CAST(round(value*200,2) AS DECIMAL(18,4)) AS amount, epoch_us(ts)//1000000 AS t
  FROM (SELECT *, CAST(json_extract_string(props,'$.k') AS BIGINT) AS k, epoch_us(ts)//86400000000 AS dd FROM events))
WHERE sender_id <> receiver_id"""
CTES["sc"] = """
SELECT lang AS network_id, 'D'||doc_id AS account_id, toxic AS y, CAST(n_chars AS DOUBLE) AS score,
       quality = 0 AS alert, source AS typology
FROM labels JOIN documents USING (doc_id)"""
CTES["today"] = "SELECT * FROM ev WHERE t//86400 = (SELECT max(t)//86400 FROM ev)"
for _v in ("ev", "li", "dy", "today"):
    CTES[f"{_v}_po"] = (
        f"SELECT sender_id AS account_id, receiver_id AS cp, TRUE AS is_out, amount, t FROM {_v} "
        f"UNION ALL SELECT receiver_id, sender_id, FALSE, amount, t FROM {_v}")
    CTES[f"{_v}_pairs"] = f"SELECT DISTINCT sender_id AS src, receiver_id AS dst FROM {_v}"
    CTES[f"{_v}_nodes"] = f"SELECT DISTINCT account_id FROM {_v}_po"
    CTES[f"{_v}_both"] = f"SELECT DISTINCT account_id AS node, cp AS nbr FROM {_v}_po"
    CTES[f"{_v}_tot"] = f"""
SELECT account_id, count(*) AS n, count(*) FILTER (is_out) AS sent, count(*) FILTER (NOT is_out) AS recv,
       CAST(coalesce(sum(amount) FILTER (NOT is_out),0) AS DOUBLE) AS tin, CAST(coalesce(sum(amount) FILTER (is_out),0) AS DOUBLE) AS tout,
       CAST(max(amount) AS DOUBLE) AS mx, stddev_pop(CAST(amount AS DOUBLE)) AS sp, coalesce(stddev_samp(CAST(amount AS DOUBLE)),0) AS ss,
       count(*) FILTER (is_out AND amount >= 8500 AND amount < 10000) AS near_out,
       count(*) FILTER (NOT is_out AND amount >= 8500 AND amount < 10000) AS near_in,
       count(*) FILTER (amount >= 5000 AND amount < 10000) AS sub, count(*) FILTER (amount % 500 = 0) AS rnd,
       count(*) FILTER ((t//3600) % 24 < 6) AS night, min(t) AS t0, max(t) AS t1
FROM {_v}_po GROUP BY account_id"""
    CTES[f"{_v}_deg"] = f"""
SELECT account_id, count(*) FILTER (got > 0) AS i, count(*) FILTER (paid > 0) AS o, count(*) AS u,
       count(*) FILTER (got > 0 AND paid > 0) AS mutual
FROM (SELECT account_id, cp, count(*) FILTER (is_out) AS paid, count(*) FILTER (NOT is_out) AS got FROM {_v}_po GROUP BY 1,2)
GROUP BY account_id"""
    for _tag, _std in (("fa", "sp"), ("fs", "ss")):
        CTES[f"{_v}_{_tag}"] = f"""
SELECT account_id, n AS transaction_count, sent AS sent_count, recv AS received_count, tin AS total_incoming, tout AS total_outgoing,
       tin - tout AS net_flow, (tin + tout)/n AS average_transaction_amount, mx AS maximum_transaction_amount, {_std} AS std_transaction_amount,
       i AS unique_senders, o AS unique_receivers, tin/(tout + 1.0) AS incoming_outgoing_ratio,
       n / CASE WHEN n >= 2 THEN greatest((t1 - t0)/3600.0, 0.1) ELSE 1.0 END AS transaction_velocity,
       u / n AS counterparty_diversity,
       CASE WHEN greatest(tin, tout) > 0 THEN least(tin, tout)/(greatest(tin, tout) + 1e-6) ELSE 0 END AS passthrough_ratio,
       CASE WHEN tin + tout > 0 THEN {_std}/((tin + tout)/n + 1e-6) ELSE 0 END AS amount_volatility,
       CASE WHEN tin + tout > 0 THEN abs(tin - tout)/(tin + tout + 1e-6) ELSE 0 END AS flow_imbalance_magnitude,
       near_out AS near_threshold_out, near_in AS near_threshold_in, sub/n AS sub_threshold_share, rnd/n AS round_amount_share
FROM {_v}_tot JOIN {_v}_deg USING (account_id)"""
FA = ("total_incoming", "total_outgoing", "net_flow", "average_transaction_amount", "maximum_transaction_amount",
      "std_transaction_amount", "incoming_outgoing_ratio", "transaction_velocity", "counterparty_diversity",
      "passthrough_ratio", "amount_volatility", "flow_imbalance_magnitude")
COUNTS = ("transaction_count", "sent_count", "received_count", "unique_senders", "unique_receivers")
for _v in ("ev", "li"):
    CTES[f"{_v}_fa4"] = (f"SELECT account_id, {', '.join(COUNTS)}, " + ", ".join(rc(c, 4) for c in FA) + f" FROM {_v}_fa")

# -------------------------------------------------------------------------------- validation
CTES["raw_tx"] = """
SELECT event_id AS row_index,
       CASE WHEN event_type = 'signup' THEN 'TX_'||(event_id//2) WHEN value < 1 THEN '  ' ELSE 'TX_'||event_id END AS transaction_id,
       CASE WHEN value < 0.5 THEN NULL WHEN value < 0.8 THEN '   ' ELSE ' U'||user_id||' ' END AS sender_id,
       CASE WHEN value > 300 THEN NULL ELSE 'U'||abs(user_id + k % 20 - 10) END AS receiver_id,
       CASE WHEN event_type <> 'error' THEN v WHEN value < 10 THEN 'NaN' WHEN value < 20 THEN 'Infinity' WHEN value < 30 THEN '-'||v
            WHEN value < 35 THEN '0' WHEN value < 40 THEN 'abc'
            WHEN value < 42 THEN '5d' WHEN value < 44 THEN '7f' WHEN value < 46 THEN '0x1p3' WHEN value < 48 THEN '1_000' WHEN value > 200 THEN '5e9' ELSE v END AS amount,
       CASE WHEN event_type = 'click' AND value < 5 THEN 'not-a-date'
            WHEN event_type = 'click' THEN strftime(ts, '%Y-%m-%d %H:%M:%S')
            WHEN event_type = 'view' THEN strftime(ts, '%Y-%m-%dT%H:%M:%S')||'Z'
            WHEN event_type = 'signup' THEN strftime(ts, '%Y-%m-%dT%H:%M:%S')||'+06:00'
            WHEN event_type = 'purchase' THEN CAST(epoch_us(ts)//1000000 AS VARCHAR)
            ELSE strftime(ts, '%Y-%m-%dT%H:%M:%S') END AS ts_text,
       CASE WHEN value < 2 THEN 'nan' ELSE ' '||event_type||chr(7) END AS tx_type,
       CASE WHEN value < 4 THEN '' ELSE 'Zone-'||(user_id % 12) END AS location,
       repeat('D'||user_id, 30) AS device_id
FROM (SELECT *, CAST(json_extract_string(props,'$.k') AS BIGINT) AS k,
             CAST(CAST(round(value*200,2) AS DECIMAL(18,2)) AS VARCHAR) AS v FROM events)"""
CTES["parsed"] = """
SELECT *, TRY_CAST(replace(trim(amount), '_', '') AS DOUBLE) AS a,
       CASE WHEN regexp_matches(ts_text, '^[0-9]+$') THEN NULL
            WHEN ts_text LIKE '%+06:00' THEN epoch_us(CAST(replace(ts_text, '+06:00', '') AS TIMESTAMP))//1000000 - 21600
            ELSE epoch_us(TRY_CAST(replace(ts_text, 'Z', '') AS TIMESTAMP))//1000000 END AS pt,
       trim(sender_id) AS s, trim(receiver_id) AS rr, nullif(trim(transaction_id), '') AS gid,
       concat_ws(', ', CASE WHEN sender_id IS NULL THEN 'sender_id' END, CASE WHEN receiver_id IS NULL THEN 'receiver_id' END,
                 CASE WHEN amount IS NULL THEN 'amount' END, CASE WHEN ts_text IS NULL THEN 'timestamp' END) AS missing
FROM raw_tx"""
CTES["judged"] = """
SELECT *, CASE
  WHEN missing <> '' THEN 'Missing required fields: '||missing
  WHEN s = '' THEN 'Invalid sender_id: must be non-empty string or integer identifier'
  WHEN rr = '' THEN 'Invalid receiver_id: must be non-empty string or integer identifier'
  WHEN s = rr THEN 'Self-transfer detected: sender_id equals receiver_id ('||s||')'
  WHEN a IS NULL THEN 'Invalid amount format: cannot parse '''||amount||''' as numeric'
  WHEN isnan(a) THEN 'Invalid amount: NaN is strictly prohibited'
  WHEN isinf(a) THEN 'Invalid amount: infinite value detected'
  WHEN a < 0 THEN 'Invalid amount: negative value ('||CAST(a AS VARCHAR)||') is not permitted'
  WHEN a = 0 THEN 'Invalid amount: zero-value transactions are invalid'
  WHEN a > 1e9 THEN 'Extreme amount: '||CAST(a AS VARCHAR)||' exceeds maximum allowed limit (1000000000.0)'
  WHEN pt IS NULL THEN 'Invalid timestamp: '''||ts_text||''' cannot be parsed as a valid ISO-8601 or epoch date' END AS reason
FROM parsed"""
CTES["vcheck"] = """
SELECT *, coalesce(reason, CASE WHEN gid IS NOT NULL AND row_number() OVER (PARTITION BY gid, reason IS NULL ORDER BY row_index) > 1
                                THEN 'Duplicate transaction_id detected: '''||gid||'''' END) AS error FROM judged"""
for _name, _cond in {
    "val02_missing_fields": "error LIKE 'Missing%'", "val03_blank_ids": "error LIKE 'Invalid sender_id%'",
    "val04_self_transfers": "error LIKE 'Self-transfer%'", "val05_amount_format": "error LIKE 'Invalid amount format%'",
    "val06_amount_range": "error LIKE 'Invalid amount: %' OR error LIKE 'Extreme%'", "val08_duplicates": "error LIKE 'Duplicate%'",
}.items():
    ORACLES[_name] = sql(f"SELECT row_index, error FROM vcheck WHERE {_cond}")
ORACLES["val07_times"] = sql(
    "SELECT row_index, CASE WHEN error IS NULL THEN pt ELSE -1 END AS t FROM vcheck WHERE error IS NULL OR error LIKE 'Invalid timestamp%'")
ORACLES["val10_context"] = sql("""
SELECT row_index, CASE WHEN lower(trim(tx_type)) NOT IN ('', 'nan') THEN regexp_replace(trim(tx_type), '\\p{C}', '', 'g')[1:64] END AS tx_type,
       CASE WHEN lower(trim(location)) NOT IN ('', 'nan') THEN trim(location)[1:64] END AS location, trim(device_id)[1:64] AS device_id
FROM vcheck WHERE error IS NULL""")
ORACLES["val11_normalised"] = sql("""
SELECT row_index, gid AS transaction_id, s AS sender_id, rr AS receiver_id, round(a, 4) AS amount,
       strftime(make_timestamp(pt*1000000), '%Y-%m-%dT%H:%M:%S')||'+00:00' AS timestamp
FROM vcheck WHERE error IS NULL AND gid IS NOT NULL""")
ORACLES["val12_summary"] = sql("""
SELECT count(*) AS total_processed, count(*) FILTER (error IS NULL) AS valid_count, count(*) FILTER (error IS NOT NULL) AS invalid_count,
       count(*) FILTER (error IS NOT NULL) = 0 AND count(*) FILTER (error IS NULL) > 0 AS is_valid FROM vcheck""")


# -------------------------------------------------------------------------------------- graph
def tier_of(x: str) -> str:
    u = f"upper({x})"
    return (f"CASE WHEN {u} LIKE '%AGENT%' OR {u} LIKE '%CASHOUT%' OR {u} LIKE 'AGT%' THEN 'agent' "
            f"WHEN {u} LIKE '%MERCH%' OR {u} LIKE 'MER%' OR {u} LIKE '%BILLER%' THEN 'merchant' ELSE 'personal' END")


ORACLES["io4_tiers"] = sql(f"SELECT account_id, {tier_of('account_id')} AS tier FROM li_nodes")
ORACLES["gr1_multigraph"] = sql(
    "SELECT sender_id AS src, receiver_id AS dst, transaction_id, CAST(amount AS DOUBLE) AS amount, t FROM ev")
ORACLES["gr2_edges"] = sql("""
SELECT src, dst, CAST(sum(amount) AS DOUBLE) AS weight, count(*) AS cnt, max(t) AS last_ts,
       max(CASE WHEN rn = 1 THEN transaction_id END) AS first_tx
FROM (SELECT sender_id AS src, receiver_id AS dst, amount, t, transaction_id,
             row_number() OVER (PARTITION BY sender_id, receiver_id ORDER BY t, amount, transaction_id) AS rn FROM ev)
GROUP BY src, dst""")
ORACLES["gr3_nodes"] = sql("SELECT account_id FROM li_nodes")
CTES["dy_joined"] = "SELECT node AS a, nbr AS b FROM dy_both UNION SELECT j.a, e.nbr FROM dy_joined j JOIN dy_both e ON e.node = j.b"
CTES["dy_weak"] = """
SELECT a AS account_id, min(b) AS component, count(*) AS component_size
FROM (SELECT a, b FROM dy_joined UNION SELECT account_id, account_id FROM dy_nodes) GROUP BY a"""
CTES["dy_reach"] = "SELECT src AS a, dst AS b FROM dy_pairs UNION SELECT j.a, e.dst FROM dy_reach j JOIN dy_pairs e ON e.src = j.b"
CTES["dy_strong"] = """
SELECT a AS account_id, min(b) AS component, count(*) AS component_size
FROM (SELECT x.a, x.b FROM dy_reach x JOIN dy_reach y ON x.a = y.b AND x.b = y.a UNION SELECT account_id, account_id FROM dy_nodes) GROUP BY a"""
ORACLES["gr5_weak_components"] = sql("SELECT * FROM dy_weak")
ORACLES["gr6_strong_components"] = sql("SELECT * FROM dy_strong")
ORACLES["gr7_multi_components"] = sql("SELECT count(DISTINCT component) AS components FROM dy_strong WHERE component_size > 1")
ORACLES["gr4_summary"] = sql("""
SELECT n AS num_accounts, e AS num_edges, (SELECT count(DISTINCT component) FROM dy_weak) AS weakly_connected_components,
       (SELECT count(DISTINCT component) FROM dy_strong) AS strongly_connected_components, round(e/(n*(n-1)), 6) AS density
FROM (SELECT (SELECT count(*) FROM dy_nodes) AS n, (SELECT count(*) FROM dy_pairs) AS e)""")
CTES["ego"] = """
SELECT account_id AS target, account_id AS node FROM dy_nodes UNION SELECT node, nbr FROM dy_both
UNION SELECT x.node, y.nbr FROM dy_both x JOIN dy_both y ON x.nbr = y.node"""
ORACLES["gr8_ego_nodes"] = sql("SELECT target, node, target = node AS is_target FROM ego")
ORACLES["gr8_ego_counts"] = sql("""
SELECT n.target, node_count, coalesce(edge_count, 0) AS edge_count
FROM (SELECT target, count(*) AS node_count FROM ego GROUP BY 1) n
LEFT JOIN (SELECT a.target, count(*) AS edge_count FROM dy_pairs p JOIN ego a ON a.node = p.src
           JOIN ego b ON b.node = p.dst AND b.target = a.target GROUP BY 1) e USING (target)""")
CTES["links"] = "SELECT sender_id AS src, receiver_id AS dst, sum(CAST(amount AS DOUBLE)) AS w FROM ev GROUP BY 1, 2"
CTES["shares"] = "SELECT src, dst, w / sum(w) OVER (PARTITION BY src) AS share FROM links"
CTES["payers"] = "SELECT DISTINCT src FROM links"
CTES["rank_0"] = "SELECT account_id, 1.0::DOUBLE/(SELECT count(*) FROM ev_nodes) AS v FROM ev_nodes"
for _i in range(1, 31):
    CTES[f"rank_{_i}"] = f"""
SELECT n.account_id, 0.15/(SELECT count(*) FROM ev_nodes) + 0.85*(coalesce(g.got, 0)
  + coalesce((SELECT sum(v) FROM rank_{_i - 1} WHERE account_id NOT IN (SELECT src FROM payers)), 0)/(SELECT count(*) FROM ev_nodes)) AS v
FROM ev_nodes n LEFT JOIN (SELECT dst, sum(share*v) AS got FROM shares JOIN rank_{_i - 1} ON src = account_id GROUP BY dst) g ON g.dst = n.account_id"""
ORACLES["gr11_pagerank"] = sql(f"SELECT account_id, {r('v*(SELECT count(*) FROM ev_nodes)', 4)} AS pagerank FROM rank_30")
CTES["hops_out"] = "SELECT a.src AS account_id, count(DISTINCT b.dst) AS f FROM ev_pairs a JOIN ev_pairs b ON a.dst = b.src GROUP BY 1"
CTES["hops_in"] = "SELECT b.dst AS account_id, count(DISTINCT a.src) AS g FROM ev_pairs a JOIN ev_pairs b ON a.dst = b.src GROUP BY 1"
CTES["triads"] = """
SELECT a.src AS account_id, count(*) AS c FROM ev_pairs a JOIN ev_pairs b ON a.dst = b.src JOIN ev_pairs c ON b.dst = c.src AND c.dst = a.src GROUP BY 1"""
ORACLES["gr12_two_hop"] = sql("""
SELECT account_id, coalesce(f, 0) AS two_hop_out, coalesce(g, 0) AS two_hop_in
FROM (SELECT a.src AS account_id, count(DISTINCT b.dst) AS f FROM ev_pairs a JOIN ev_pairs b ON a.dst = b.src GROUP BY 1)
FULL JOIN (SELECT b.dst AS account_id, count(DISTINCT a.src) AS g FROM ev_pairs a JOIN ev_pairs b ON a.dst = b.src GROUP BY 1) USING (account_id)""")
ORACLES["gr13_triangles"] = sql("""
SELECT a.src AS account_id, count(*) AS triad_cycles FROM ev_pairs a JOIN ev_pairs b ON a.dst = b.src
JOIN ev_pairs c ON b.dst = c.src AND c.dst = a.src GROUP BY 1""")
ORACLES["gr14_reciprocity"] = sql(f"SELECT account_id, {r('mutual/u')} AS reciprocity FROM ev_deg")
ORACLES["gr15_neighbour_degree"] = sql(f"SELECT node AS account_id, {r('avg(u)')} AS avg_neighbor_degree FROM ev_both JOIN ev_deg ON nbr = account_id GROUP BY 1")


# ---------------------------------------------------------------------------------- detectors
def burst(view: str, inward: bool, window: int) -> str:
    me, other = ("receiver_id", "sender_id") if inward else ("sender_id", "receiver_id")
    return f"""
SELECT account_id, max(c) AS burst FROM (
  SELECT e.{me} AS account_id, e.t, count(DISTINCT f.{other}) AS c
  FROM (SELECT DISTINCT {me}, t FROM {view}) e JOIN {view} f ON f.{me} = e.{me} AND f.t BETWEEN e.t - {window} AND e.t GROUP BY 1, 2)
GROUP BY account_id"""


for _v, _w in (("ev", 7200), ("li", 7 * 86400), ("dy", 7200)):
    CTES[f"{_v}_burst_in"], CTES[f"{_v}_burst_out"] = burst(_v, True, _w), burst(_v, False, _w)
ORACLES["pt0_burst_payers"] = sql("SELECT * FROM ev_burst_in")
ORACLES["pt0_burst_payees"] = sql("SELECT * FROM ev_burst_out")


def fan(view: str, inward: bool, min_ratio: float) -> str:
    a, b, side = ("i", "o", "in") if inward else ("o", "i", "out")
    money = "tin" if inward else "tout"
    return f"""
SELECT account_id, i AS in_degree, o AS out_degree, {r(f'{a}/CASE WHEN {b} > 0 THEN {b} ELSE 0.5 END', 2)} AS ratio,
       {r(money, 2)} AS total_amount, burst
FROM {view}_deg JOIN {view}_tot USING (account_id) JOIN {view}_burst_{side} USING (account_id)
WHERE {a} >= 4 AND {a}/CASE WHEN {b} > 0 THEN {b} ELSE 0.5 END >= {min_ratio} AND burst >= 4"""


CTES["ev_fan_in"], CTES["ev_fan_out"] = fan("ev", True, 1.05), fan("ev", False, 1.05)
CTES["dy_fan_in"], CTES["dy_fan_out"] = fan("dy", True, 2.0), fan("dy", False, 2.0)
ORACLES["pt1_fan_in"], ORACLES["pt2_fan_out"] = sql("SELECT * FROM ev_fan_in"), sql("SELECT * FROM ev_fan_out")
ORACLES["pt1_fan_in_weekly"], ORACLES["pt2_fan_out_weekly"] = sql(fan("li", True, 1.0)), sql(fan("li", False, 1.0))
ORACLES["pt1_fan_in_members"] = sql("SELECT account_id, src AS member FROM ev_fan_in JOIN ev_pairs ON dst = account_id")


def loops(view: str, window: int) -> str:
    """Loops of three to six accounts as one row per closing instance."""
    def step(k: int) -> str:
        return (f"JOIN {view} h{k} ON h{k}.sender_id = h{k - 1}.receiver_id AND h{k}.t >= h{k - 1}.t AND h{k}.t <= h1.t + {window} "
                f"AND h{k}.amount >= 0.5*h{k - 1}.amount AND h{k}.amount <= 1.1*h{k - 1}.amount")

    def length(k: int) -> str:
        nodes = ", ".join(f"h{j}.sender_id" for j in range(1, k + 1))
        hops = "||'>'||".join(f"h{j}.transaction_id" for j in range(1, k + 1))
        distinct = " AND ".join(f"h{a}.sender_id <> h{b}.sender_id" for a in range(1, k + 1) for b in range(a + 1, k + 1))
        return (f"SELECT [{nodes}] AS path, {k} AS length, h1.t AS t0, h{k}.t AS t1, h1.amount AS a0, h{k}.amount AS a1, {hops} AS hops "
                f"FROM {view} h1 {' '.join(step(j) for j in range(2, k + 1))} AND h{k}.receiver_id = h1.sender_id WHERE {distinct}")

    return " UNION ALL ".join(length(k) for k in range(3, 7))


CTES["ev_loops"], CTES["dy_loops"] = loops("ev", 21600), loops("dy", 86400)
CTES["ev_named"] = """
SELECT array_to_string(list_concat(path[list_position(path, list_min(path)):], path[1:list_position(path, list_min(path))-1]), '>') AS nodes, *
FROM ev_loops"""
ORACLES["pt3_circular_flow"] = sql("SELECT nodes, length, count(*) AS instances FROM ev_named GROUP BY 1, 2")
CTES["ev_first_loop"] = """
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY nodes ORDER BY t0, t1, a0, a1, hops) AS rn FROM ev_named) WHERE rn = 1"""
ORACLES["pt3d_loop_details"] = sql(
    f"SELECT nodes, t0 AS t, t1 - t0 AS loop_duration_seconds, {r('CAST(a1 AS DOUBLE)/CAST(a0 AS DOUBLE)', 3)} AS amount_retained_ratio, hops FROM ev_first_loop")
CTES["dy_sources"] = "SELECT DISTINCT src FROM dy_pairs WHERE src NOT IN (SELECT dst FROM dy_pairs)"
CTES["dy_paths"] = """
SELECT [src, dst] AS path, 1 AS hops FROM dy_pairs WHERE src IN (SELECT src FROM dy_sources)
UNION ALL SELECT list_append(path, dst), hops + 1 FROM dy_paths JOIN dy_pairs ON src = path[-1] WHERE hops < 5 AND NOT list_contains(path, dst)"""
ORACLES["pt4_transaction_chains"] = sql(
    "SELECT array_to_string(path, '>') AS path, hops, path[1] AS start, path[-1] AS \"end\" FROM dy_paths WHERE hops >= 3")
ORACLES["gf6_chain_length"] = sql(
    "SELECT account_id, max(hops) AS chain_length FROM (SELECT unnest(path) AS account_id, hops FROM dy_paths WHERE hops >= 3) GROUP BY 1")


def pairs_in_time(view: str, window: int, strict: bool) -> str:
    return f"""
SELECT p.sender_id AS account_id, p.transaction_id AS payment_id, p.receiver_id AS payee, p.t AS payment_t, q.sender_id AS payer, p.t - q.t AS latency
FROM {view} p JOIN {view} q ON q.receiver_id = p.sender_id AND q.t {'<' if strict else '<='} p.t AND p.t - q.t <= {window}
 AND q.amount >= 1000 AND p.amount >= 0.70*q.amount AND p.amount <= 1.10*q.amount"""


CTES["ev_rapid"], CTES["ev_rapid10"] = pairs_in_time("ev", 3600, False), pairs_in_time("ev", 600, False)
CTES["dy_rapid"] = pairs_in_time("dy", 3600, False)
CTES["ev_slow_links"], CTES["ev_fast_links"] = pairs_in_time("ev", 43200, True), pairs_in_time("ev", 3600, True)
for _cte in ("ev_rapid", "ev_rapid10"):
    CTES[f"{_cte}_acc"] = f"""
SELECT account_id, count(*) AS match_count, count(DISTINCT (payee, payment_t)) AS forwards, count(DISTINCT payee) AS destinations,
       min(latency) AS fastest_latency_seconds FROM {_cte} GROUP BY 1"""
ORACLES["pt5_rapid_movement"] = sql("SELECT * FROM ev_rapid_acc")
ORACLES["pt5_rapid_payments"] = sql("SELECT account_id, payment_id, min(latency) AS latency, count(*) AS matches FROM ev_rapid GROUP BY 1, 2")
for _q, _cte in (("fl1_candidate_links_fast", "ev_fast_links"), ("fl1_candidate_links_slow", "ev_slow_links")):
    ORACLES[_q] = sql(f"SELECT payment_id, count(*) AS receipts, min(latency) AS newest, max(latency) AS oldest FROM {_cte} GROUP BY 1")
for _v in ("ev", "dy"):
    CTES[f"{_v}_near"] = f"SELECT account_id, CASE WHEN is_out THEN 'splitter' ELSE 'collector' END AS role, cp, amount, t FROM {_v}_po WHERE amount >= 8500 AND amount < 10000"
    CTES[f"{_v}_str"] = f"""
SELECT account_id, role, n AS near_threshold_count, {r('total', 2)} AS total_amount, {r('largest', 2)} AS largest_amount,
       10000.0::DOUBLE AS reporting_threshold, start AS window_start, t AS window_end
FROM (SELECT *, row_number() OVER (PARTITION BY account_id, role ORDER BY n DESC, t) AS rn FROM (
        SELECT DISTINCT account_id, role, t, count(*) OVER w AS n, sum(amount) OVER w AS total, max(amount) OVER w AS largest, min(t) OVER w AS start
        FROM {_v}_near WINDOW w AS (PARTITION BY account_id, role ORDER BY t RANGE BETWEEN 86400 PRECEDING AND CURRENT ROW)))
WHERE rn = 1 AND n >= 3 AND total > 10000"""
ORACLES["pt6_structuring"] = sql("SELECT * FROM ev_str")
CTES["ev_str_members"] = """
SELECT DISTINCT account_id, role, cp AS member FROM ev_near JOIN ev_str USING (account_id, role) WHERE t BETWEEN window_start AND window_end"""
ORACLES["pt6_structuring_members"] = sql("SELECT * FROM ev_str_members")
CTES["dy_clusters"] = """
SELECT s.component, s.component_size AS size, count(*) AS edge_count, round(count(*)/(s.component_size*(s.component_size-1)), 3) AS density
FROM dy_pairs JOIN dy_strong s ON s.account_id = src JOIN dy_strong z ON z.account_id = dst AND z.component = s.component
WHERE s.component_size >= 4 GROUP BY 1, 2 HAVING count(*)/(s.component_size*(s.component_size-1)) >= 0.4"""
ORACLES["pt7_coordinated_networks"] = sql("SELECT * FROM dy_clusters")
ORACLES["pt11_flags_exhaustive"] = sql("""
SELECT account_id, 'fan_in' AS pattern FROM dy_fan_in UNION SELECT account_id, 'fan_out' FROM dy_fan_out
UNION SELECT unnest(path), 'circular_flow' FROM dy_loops
UNION SELECT unnest(path), 'transaction_chain' FROM dy_paths WHERE hops >= 3
UNION SELECT account_id, 'rapid_movement' FROM dy_rapid UNION SELECT account_id, 'structuring' FROM dy_str
UNION SELECT account_id, 'coordinated_network' FROM dy_strong JOIN dy_clusters USING (component)""")

# -------------------------------------------------------------------------- context detectors
CTES["ev_tiers"] = """
SELECT account_id, CASE WHEN CAST(account_id[2:] AS BIGINT) % 10 = 0 THEN 'agent' WHEN CAST(account_id[2:] AS BIGINT) % 11 = 0 THEN 'merchant'
       ELSE 'personal' END AS tier FROM ev_nodes"""
CTES["inflows"] = f"""
SELECT ev.* FROM ev JOIN ev_tiers ON account_id = sender_id
WHERE amount >= 10000 AND tx_type NOT IN ({', '.join(repr(x) for x in fixed.FORMAL_TX_TYPES)}) AND tier <> 'merchant'"""
CTES["outflows"] = """
SELECT ev.* FROM ev JOIN ev_tiers ON account_id = receiver_id
WHERE amount BETWEEN 3000 AND 50000 AND tx_type NOT IN ('float_return', 'settlement', 'payment') AND tier = 'personal'"""
CTES["funders"] = "SELECT receiver_id AS account_id, sender_id AS funder, count(*) AS transfers, sum(amount) AS amount FROM inflows GROUP BY 1, 2"
CTES["gated"] = """
SELECT receiver_id AS account_id, count(*) AS inflow_count, CAST(sum(amount) AS DOUBLE) AS inflow_total, count(DISTINCT sender_id) AS funder_count
FROM inflows GROUP BY 1 HAVING count(*) >= 3 AND sum(amount) >= 30000 AND count(DISTINCT sender_id) <= 20"""
CTES["cycles"] = """
SELECT account_id, cycle, min(t) AS start_t, max(t) AS end_t FROM (
  SELECT account_id, t, sum(fresh) OVER (PARTITION BY account_id ORDER BY t RANGE UNBOUNDED PRECEDING) AS cycle FROM (
    SELECT receiver_id AS account_id, t, CASE WHEN t - lag(t) OVER (PARTITION BY receiver_id ORDER BY t) >= 21600 THEN 1 ELSE 0 END AS fresh
    FROM inflows WHERE receiver_id IN (SELECT account_id FROM gated)))
GROUP BY 1, 2"""
CTES["paid_out"] = """
SELECT c.account_id, CAST(c.cycle AS BIGINT) AS cycle, o.receiver_id AS beneficiary, o.amount, (o.t - c.start_t)/3600.0 AS delay
FROM cycles c JOIN outflows o ON o.sender_id = c.account_id AND o.t BETWEEN c.start_t AND c.end_t + 86400
WHERE NOT EXISTS (SELECT 1 FROM funders f WHERE f.account_id = c.account_id AND f.funder = o.receiver_id)"""
ORACLES["cx4_informal_inflows"] = sql("SELECT transaction_id, CAST(amount AS DOUBLE) AS amount FROM inflows")
ORACLES["cx5_payouts"] = sql("SELECT transaction_id, CAST(amount AS DOUBLE) AS amount FROM outflows")
ORACLES["cx6_funding_gates"] = sql("SELECT * FROM gated")
ORACLES["cx7_funding_cycles"] = sql("SELECT account_id, CAST(cycle AS BIGINT) AS cycle, start_t, end_t FROM cycles")
ORACLES["cx8_cycle_payouts"] = sql(
    f"SELECT account_id, cycle, count(*) AS payouts, CAST(sum(amount) AS DOUBLE) AS paid, {r('max(delay)')} AS longest_delay FROM paid_out GROUP BY 1, 2")
CTES["operators"] = f"""
SELECT g.account_id, g.inflow_count AS informal_inflow_count, {r('g.inflow_total', 2)} AS informal_inflow_total, g.funder_count, b.beneficiary_count,
       {r('b.paid', 2)} AS payout_total, {r('b.paid/g.inflow_total', 3)} AS payout_ratio, c.cycles, {r('b.repeated/b.beneficiary_count', 3)} AS repeat_beneficiary_share,
       {r('c.delay', 2)} AS median_payout_delay_hours
FROM gated g
JOIN (SELECT account_id, count(*) AS beneficiary_count, CAST(sum(paid) AS DOUBLE) AS paid, count(*) FILTER (times >= 2) AS repeated
      FROM (SELECT account_id, beneficiary, count(DISTINCT cycle) AS times, sum(amount) AS paid FROM paid_out GROUP BY 1, 2) GROUP BY 1) b USING (account_id)
JOIN (SELECT account_id, count(DISTINCT cycle) AS cycles, quantile_cont(CAST(delay AS DOUBLE), 0.5) AS delay FROM paid_out GROUP BY 1) c USING (account_id)
WHERE b.beneficiary_count >= 3 AND b.paid >= 0.2*g.inflow_total AND c.cycles >= 2 AND b.repeated/b.beneficiary_count >= 0.05"""
ORACLES["cx9_hundi_operators"] = sql("SELECT * FROM operators")
ORACLES["cx10_hundi_funders"] = sql(f"""
SELECT funder AS account_id, account_id AS operator, transfers, {r('amount', 2)} AS amount
FROM funders WHERE account_id IN (SELECT account_id FROM operators)""")

# ------------------------------------------------------------------------------------ features
for _name, _cols in {
    "fa1_counts": COUNTS[:3], "fa2_totals": FA[:3], "fa3_amounts": FA[3:6], "fa4_counterparties": COUNTS[3:],
    "fa5_in_out_ratio": ("incoming_outgoing_ratio",), "fa6_diversity": ("counterparty_diversity",), "fa7_passthrough": ("passthrough_ratio",),
    "fa8_volatility": ("amount_volatility",), "fa9_imbalance": ("flow_imbalance_magnitude",), "fa10_velocity": ("transaction_velocity",),
}.items():
    ORACLES[_name] = sql(f"SELECT account_id, {', '.join(_cols)} FROM li_fa4")
for _v in ("ev", "li"):
    CTES[f"{_v}_gf"] = f"""
SELECT account_id, i AS in_degree, o AS out_degree, i + o AS total_degree, {r('i/(o + 1.0)', 4)} AS degree_ratio,
       {r('tin', 4)} AS weighted_in_degree, {r('tout', 4)} AS weighted_out_degree, {r('tin - tout', 4)} AS net_weight_flow, u AS unique_counterparties,
       {r('CASE WHEN i >= 3 THEN least(1.0, i/greatest(1, o*2)) ELSE 0 END', 4)} AS fan_in_score,
       {r('CASE WHEN o >= 3 THEN least(1.0, o/greatest(1, i*2)) ELSE 0 END', 4)} AS fan_out_score
FROM {_v}_deg JOIN {_v}_tot USING (account_id)"""
for _name, _cols in {
    "gf1_degrees": "in_degree, out_degree, total_degree, degree_ratio", "gf2_weighted_degrees": "weighted_in_degree, weighted_out_degree, net_weight_flow",
    "gf3_counterparties": "unique_counterparties", "gf4_fan_scores": "fan_in_score, fan_out_score",
}.items():
    ORACLES[_name] = sql(f"SELECT account_id, {_cols} FROM li_gf")
CTES["ev_flags"] = """
SELECT account_id, 'fan_in' AS pattern FROM ev_fan_in UNION SELECT account_id, 'fan_out' FROM ev_fan_out
UNION SELECT unnest(path), 'circular_flow' FROM ev_loops UNION SELECT account_id, 'rapid_movement' FROM ev_rapid10
UNION SELECT account_id, 'structuring' FROM ev_str"""
CTES["ev_strong"] = """
SELECT a AS account_id, count(*) AS size FROM (SELECT x.a, x.b FROM ev_reach x JOIN ev_reach y ON x.a = y.b AND x.b = y.a
UNION SELECT account_id, account_id FROM ev_nodes) GROUP BY a"""
CTES["ev_joined"] = "SELECT node AS a, nbr AS b FROM ev_both UNION SELECT j.a, e.nbr FROM ev_joined j JOIN ev_both e ON e.node = j.b"
CTES["ev_graph"] = """
SELECT g.*, coalesce(c.cycle_count, 0) AS cycle_count, CASE WHEN c.cycle_count > 0 THEN 1 ELSE 0 END AS cycle_detected, 0 AS chain_length,
       coalesce(s.near, 0) AS near_threshold_tx_count, CASE WHEN s.near > 0 THEN 1 ELSE 0 END AS structuring_detected,
       w.network_size, coalesce(f.suspicious, 0) AS suspicious_neighbor_count
FROM ev_gf g
LEFT JOIN (SELECT account_id, count(*) AS cycle_count FROM (SELECT DISTINCT nodes, unnest(path) AS account_id FROM ev_named) GROUP BY 1) c USING (account_id)
LEFT JOIN (SELECT account_id, max(near_threshold_count) AS near FROM ev_str GROUP BY 1) s USING (account_id)
LEFT JOIN (SELECT a AS account_id, count(*) AS network_size FROM ev_joined GROUP BY 1) w USING (account_id)
LEFT JOIN (SELECT node AS account_id, count(*) AS suspicious FROM ev_both WHERE nbr IN (SELECT account_id FROM ev_flags) GROUP BY 1) f USING (account_id)"""
for _name, _cols in {
    "gf5_cycles": "cycle_detected, cycle_count", "gf7_structuring": "structuring_detected, near_threshold_tx_count",
    "gf8_network_size": "network_size", "gf9_suspicious_neighbours": "suspicious_neighbor_count",
}.items():
    ORACLES[_name] = sql(f"SELECT account_id, {_cols} FROM ev_graph")
CTES["vec"] = "SELECT * FROM ev_fa4 JOIN ev_graph USING (account_id)"
ORACLES["gf10_feature_vector"] = sql("SELECT * FROM vec")
FS1 = fixed.TRANSACTIONAL[:14]
for _name, _cols in {
    "fs1_transactional": FS1, "fs2_near_threshold": ("near_threshold_out", "near_threshold_in"),
    "fs3_sub_threshold_share": ("sub_threshold_share",), "fs4_round_amount_share": ("round_amount_share",),
}.items():
    ORACLES[_name] = sql("SELECT account_id, " + ", ".join(rc(c) for c in _cols) + " FROM li_fs")
for _v in ("ev", "li"):
    CTES[f"{_v}_days"] = f"""
SELECT account_id, (t - (SELECT min(t) FROM {_v}))//86400 AS day, coalesce(sum(amount) FILTER (NOT is_out), 0) AS day_in,
       coalesce(sum(amount) FILTER (is_out), 0) AS day_out FROM {_v}_po GROUP BY 1, 2"""
    CTES[f"{_v}_daily"] = f"""
SELECT account_id, CAST(count(*) AS DOUBLE) AS active_days, CAST(sum(least(day_in, day_out)) AS DOUBLE)/(CAST(sum(day_in) AS DOUBLE) + 1.0) AS same_day_turnover
FROM {_v}_days GROUP BY 1"""
    CTES[f"{_v}_hours"] = f"SELECT account_id, t//3600 AS h, count(*) AS c FROM {_v}_po GROUP BY 1, 2"
    CTES[f"{_v}_slots"] = f"""
SELECT account_id, count(DISTINCT cp) FILTER (NOT is_out) AS s, count(DISTINCT cp) FILTER (is_out) AS p FROM {_v}_po GROUP BY account_id, t//7200"""
ORACLES["fs5_active_days"] = sql("SELECT account_id, active_days FROM ev_daily")
ORACLES["fs12_same_day_turnover"] = sql(f"SELECT account_id, {rc('same_day_turnover')} FROM ev_daily")
ORACLES["fs6_span_velocity"] = sql(
    f"SELECT account_id, {r('(t1 - t0)/3600.0')} AS active_span_hours, {r('n/greatest((t1 - t0)/3600.0, 0.1)')} AS transaction_velocity FROM ev_tot")
ORACLES["fs7_max_tx_per_hour"] = sql("SELECT account_id, CAST(max(c) AS DOUBLE) AS max_tx_per_hour FROM ev_hours GROUP BY 1")
ORACLES["fs8_two_hour_counterparties"] = sql(
    "SELECT account_id, CAST(max(s) AS DOUBLE) AS max_senders_2h, CAST(max(p) AS DOUBLE) AS max_receivers_2h FROM ev_slots GROUP BY 1")
ORACLES["fs9_night_share"] = sql(f"SELECT account_id, {r('night/n')} AS night_share FROM ev_tot")
ORACLES["fs10_hour_entropy"] = sql(f"""
SELECT account_id, {r('greatest(0.0, -sum(p*ln(p)))')} AS hour_entropy
FROM (SELECT account_id, sum(c)/sum(sum(c)) OVER (PARTITION BY account_id) AS p FROM ev_hours GROUP BY account_id, h % 24) GROUP BY 1""")
CTES["ev_gaps"] = """
SELECT account_id, CAST(g AS DOUBLE) AS g FROM (SELECT account_id, t - lag(t) OVER (PARTITION BY account_id ORDER BY t) AS g FROM ev_po) WHERE g IS NOT NULL"""
ORACLES["fs11_inter_arrival"] = sql(f"""
SELECT account_id, m AS inter_arrival_median_s, {r('s/(a + 1e-6)', 5)} AS inter_arrival_cv, {r('(s - a)/(s + a + 1e-6)', 5)} AS burstiness
FROM (SELECT account_id, median(g) AS m, avg(g) AS a, coalesce(stddev_samp(g), 0) AS s FROM ev_gaps GROUP BY 1)""")
ORACLES["fs14_degrees"] = sql(
    f"SELECT account_id, CAST(i AS DOUBLE) AS in_degree, CAST(o AS DOUBLE) AS out_degree, {r('i/(o + 1.0)')} AS degree_ratio FROM ev_deg")
ORACLES["fs19_tier_flags"] = sql(
    "SELECT account_id, " + ", ".join(f"CASE WHEN {tier_of('account_id')} = '{t}' THEN 1.0 ELSE 0.0 END::DOUBLE AS tier_{t}" for t in fixed.TIERS) + " FROM li_nodes")

# ------------------------------------------------------------------------------------- scoring
CTES["raw_score"] = f"SELECT account_id, {r('0.12 - abs(degree_ratio - 0.95)*0.6')} AS s FROM vec"
CTES["mid"] = "SELECT median(s) AS m FROM raw_score"
CTES["mad"] = """
SELECT CASE WHEN mad < 1e-4 THEN greatest(dev, 0.05) ELSE mad END AS spread
FROM (SELECT 1.4826*median(abs(s - (SELECT m FROM mid))) AS mad, stddev_pop(s) AS dev FROM raw_score)"""
SCALED = ("transaction_count", "total_incoming", "cycle_count", "degree_ratio", "amount_volatility")
CTES["quartiles"] = "SELECT " + ", ".join(
    f"quantile_cont(CAST({c} AS DOUBLE), 0.5) AS {c}_m, quantile_cont(CAST({c} AS DOUBLE), 0.75) - quantile_cont(CAST({c} AS DOUBLE), 0.25) AS {c}_w" for c in SCALED) + " FROM vec"
ORACLES["ml1_robust_scaling"] = sql("SELECT account_id, " + ", ".join(
    r(f"({c} - {c}_m)/CASE WHEN {c}_w = 0 THEN 1 ELSE {c}_w END") + f" AS {c}" for c in SCALED) + " FROM vec, quartiles")
ORACLES["ml3_mad_spread"] = sql(
    f"SELECT (SELECT count(*) FROM raw_score) AS accounts, {r('m')} AS median, {r('spread')} AS spread FROM mid, mad")
CTES["calibrated"] = f"""
SELECT account_id, s < 0 AS is_anomaly, greatest(0.0, least(100.0, {r('CASE WHEN s >= 0 THEN 38.0*exp(-s/greatest(spread, 0.05)) ELSE 50.0 + 48.0*tanh(0.75*(-s/greatest(spread, 0.05))) END', 2)})) AS ml_anomaly_score
FROM raw_score, mad"""
ORACLES["ml4_calibration"] = sql("SELECT account_id, ml_anomaly_score FROM calibrated")
ORACLES["ml5_is_anomaly"] = sql("SELECT account_id, is_anomaly FROM calibrated")
BASE = {
    "velocity_p75": ("transaction_velocity", .75), "velocity_p90": ("transaction_velocity", .9), "max_amt_p75": ("maximum_transaction_amount", .75),
    "max_amt_p90": ("maximum_transaction_amount", .9), "passthrough_p75": ("passthrough_ratio", .75),
    "imbalance_p75": ("flow_imbalance_magnitude", .75), "diversity_p25": ("counterparty_diversity", .25),
}
CTES["base"] = "SELECT " + ", ".join(f"quantile_cont({c}, {p}) AS {n}" for n, (c, p) in BASE.items()) + " FROM vec"
ORACLES["ml11_baselines"] = sql("SELECT " + ", ".join(rc(n) for n in BASE) + " FROM base")
CTES["pats"] = "SELECT account_id, list(pattern) AS found FROM ev_flags GROUP BY 1"
CTES["rows_in"] = f"""
SELECT vec.*, tier AS account_tier, ml_anomaly_score, is_anomaly, coalesce(found, []) AS found,
       CASE WHEN transaction_count >= 100 THEN {r('passthrough_ratio*0.5', 4)} END AS prob
FROM vec JOIN calibrated USING (account_id) JOIN ev_tiers USING (account_id) LEFT JOIN pats USING (account_id)"""


def points(business: str) -> str:
    def has(p: str) -> str:
        return f"list_contains(found, '{p}')"

    return (f"CASE WHEN {has('circular_flow')} THEN 35.0 ELSE 0 END + CASE WHEN {has('rapid_movement')} AND NOT {business} THEN 30.0 ELSE 0 END"
            f" + CASE WHEN {has('structuring')} AND NOT {business} THEN 55.0 ELSE 0 END + CASE WHEN {has('fan_in')} AND NOT {business} THEN 25.0 ELSE 0 END"
            f" + CASE WHEN {has('fan_out')} AND NOT {business} THEN 25.0 ELSE 0 END + CASE WHEN suspicious_neighbor_count >= 2 THEN 15.0 ELSE 0 END")


CTES["parts"] = f"""
SELECT *, CAST(CASE WHEN prob IS NULL THEN ml_anomaly_score WHEN account_tier <> 'personal' THEN {r('100*prob', 2)}
            ELSE greatest(ml_anomaly_score, {r('100*prob', 2)}) END AS DOUBLE) AS ml_component,
       CAST(least(100.0, {points("(account_tier <> 'personal')")}) AS DOUBLE) AS graph_component, CAST(least(100.0, {points("FALSE")}) AS DOUBLE) AS untiered,
       CAST(least(100.0, CASE WHEN transaction_velocity >= velocity_p90 THEN 30.0 WHEN transaction_velocity >= velocity_p75 THEN 15.0 ELSE 0 END
         + CASE WHEN incoming_outgoing_ratio > 5 OR incoming_outgoing_ratio < 0.2 OR flow_imbalance_magnitude >= imbalance_p75 THEN 25.0 ELSE 0 END
         + CASE WHEN maximum_transaction_amount >= max_amt_p90 THEN 25.0 WHEN maximum_transaction_amount >= max_amt_p75 THEN 12.0 ELSE 0 END
         + CASE WHEN passthrough_ratio >= passthrough_p75 AND total_incoming > 500 THEN 20.0 ELSE 0 END
         + CASE WHEN transaction_count >= 3 AND counterparty_diversity <= diversity_p25 THEN 15.0 ELSE 0 END) AS DOUBLE) AS behavioral_component
FROM rows_in, base"""
CTES["scored"] = f"""
SELECT *, CASE WHEN risk_score >= 90 THEN 'CRITICAL' WHEN risk_score >= 70 THEN 'HIGH' WHEN risk_score >= 40 THEN 'MEDIUM' ELSE 'LOW' END AS risk_level
FROM (SELECT *, {r('greatest(0.4*ml_component + 0.4*graph_component + 0.2*behavioral_component, 0.75*graph_component)', 2)} AS risk_score FROM parts)"""
ORACLES["ml12_ml_component"] = sql("SELECT account_id, account_tier, ml_component FROM scored")
ORACLES["ml13_graph_points"] = sql("SELECT account_id, graph_component FROM scored")
ORACLES["ml14_untiered_points"] = sql("SELECT account_id, untiered, graph_component AS tiered FROM scored")
ORACLES["ml15_behaviour_points"] = sql("SELECT account_id, behavioral_component FROM scored")
ORACLES["ml16_final_score"] = sql("SELECT account_id, risk_score FROM scored")
ORACLES["ml17_risk_level"] = sql("SELECT account_id, risk_level FROM scored")
ORDERED = "list_filter([" + ", ".join(f"'{p}'" for p in fixed.PATTERN_ORDER) + "], lambda p: list_contains(found, p))"
ORACLES["ml18_account_patterns"] = sql(f"SELECT account_id, array_to_string({ORDERED}, ',') AS patterns FROM pats")
ORACLES["ml19_risk_reports"] = sql(
    "SELECT account_id, risk_score, risk_level, ml_component, graph_component, behavioral_component FROM scored ORDER BY risk_score DESC, account_id")

# ----------------------------------------------------------------------------------- reporting
CTES["loop_of"] = """
SELECT account_id, length, path, t1 - t0 AS secs, a1, a0 FROM (
  SELECT account_id, l.length, string_split(l.nodes, '>') AS path, l.t0, l.t1, l.a0, l.a1,
         row_number() OVER (PARTITION BY account_id ORDER BY l.t0, string_split(l.nodes, '>')) AS k
  FROM (SELECT *, unnest(path) AS account_id FROM ev_first_loop) l) WHERE k = 1"""
CTES["str_of"] = """
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY account_id ORDER BY role DESC) AS k FROM ev_str) WHERE k = 1"""


def whole(x: str) -> str:
    return f"CAST(CAST(round_even({x}, 0) AS BIGINT) AS VARCHAR)"


def thousands(x: str) -> str:
    return f"format('{{:,}}', CAST(round_even({x}, 0) AS BIGINT))"


def one(x: str) -> str:
    return f"CAST(round_even({x}, 1) AS VARCHAR)"


SENTENCES = (
    ("list_contains(found, 'circular_flow')",
     f"'Circular flow pattern detected: funds travelled a '||l.length||'-account loop ('||array_to_string(list_append(l.path, l.path[1]), ' -> ')||') and returned in '||{whole('l.secs/60')}||' minutes with '||{whole(r('CAST(a1 AS DOUBLE)/CAST(a0 AS DOUBLE)', 3) + '*100')}||'% of the value.'"),
    ("list_contains(found, 'rapid_movement')",
     f"'Rapid fund movement detected: funds forwarded within '||CASE WHEN q.fastest_latency_seconds < 60 THEN 'under a minute' ELSE {whole('q.fastest_latency_seconds/60')}||' minutes' END||' of receipt.'"),
    ("list_contains(found, 'fan_in')", "'Fan-in pattern detected: received funds from '||in_degree||' distinct senders with only '||out_degree||' outgoing counterparties.'"),
    ("list_contains(found, 'fan_out')", "'Fan-out pattern detected: dispersed funds to '||out_degree||' distinct receivers from '||in_degree||' incoming source(s).'"),
    ("list_contains(found, 'structuring')",
     f"'Structuring detected: '||CASE WHEN z.role = 'splitter' THEN 'sent' ELSE 'received' END||' '||z.near_threshold_count||' transactions just under the 10,000 threshold (total '||{thousands('z.total_amount')}||') within 24 hours.'"),
    ("transaction_velocity >= 10", f"'High transaction velocity: '||{one('transaction_velocity')}||' transactions per hour.'"),
    ("incoming_outgoing_ratio >= 8", f"'Severe fund imbalance: incoming funds exceed outgoing by '||{one('incoming_outgoing_ratio')}||'x.'"),
    ("incoming_outgoing_ratio <= 0.15 AND total_outgoing > 0", "'Severe fund depletion: outgoing funds heavily outweigh incoming receipts.'"),
    ("suspicious_neighbor_count >= 2", "'High network exposure: directly connected to '||suspicious_neighbor_count||' accounts with flagged patterns.'"),
    ("passthrough_ratio >= 0.85 AND total_incoming > 1000", f"'High layering passthrough ratio: '||{one('passthrough_ratio*100')}||'% of incoming funds forwarded onward.'"),
    ("transaction_count >= 4 AND counterparty_diversity <= 0.4", "'High counterparty concentration: transactions restricted to only '||unique_counterparties||' counterparty(s).'"),
    ("is_anomaly", "'Statistical multivariate anomaly flagged by Isolation Forest (anomaly score: '||CAST(ml_component AS VARCHAR)||'/100).'"),
)
CTES["said"] = ("SELECT account_id, list_filter([" + ", ".join(f"CASE WHEN {c} THEN {t} END" for c, t in SENTENCES) + """], lambda x: x IS NOT NULL) AS said
FROM scored LEFT JOIN loop_of l USING (account_id) LEFT JOIN ev_rapid10_acc q USING (account_id) LEFT JOIN str_of z USING (account_id)""")
ORACLES["rp1_evidence"] = sql("""
SELECT account_id, i - 1 AS position, said[i] AS sentence FROM (
  SELECT account_id, said, unnest(range(1, len(said) + 1)) AS i FROM (
    SELECT account_id, CASE WHEN len(said) = 0 THEN ['Normal transactional behavior: no anomalous patterns or metric deviations detected.'] ELSE said END AS said FROM said))""")


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


ORACLES["rp3_typology"] = sql("SELECT account_id, CASE " + " ".join(
    "WHEN " + " AND ".join(f"list_contains(found, '{p}')" for p in rule[0]) + f" THEN {quoted(rule[1])}" for rule in fixed.TYPOLOGIES)
    + f" ELSE {quoted(fixed.NO_TYPOLOGY[0])} END AS typology FROM scored")
CTES["related_all"] = """
SELECT account_id, member, min(k) AS k FROM (
  SELECT account_id, member, 2 AS k FROM (SELECT nodes, path, unnest(path) AS account_id FROM ev_named), unnest(path) AS u(member)
  UNION ALL SELECT account_id, member, 5 FROM ev_str_members) WHERE account_id <> member GROUP BY 1, 2"""
ORACLES["rp5_related_accounts"] = sql("""
SELECT account_id, string_agg(member, ',' ORDER BY n) AS related
FROM (SELECT *, row_number() OVER (PARTITION BY account_id ORDER BY k, member) AS n FROM related_all) WHERE n <= 12 GROUP BY 1""")
_lists = [f"CASE WHEN list_contains(found, '{p}') THEN [{', '.join(quoted(t) for t in steps)}] ELSE CAST([] AS VARCHAR[]) END" for p, steps in fixed.NEXT_STEPS]
CTES["advice"] = f"""
SELECT account_id, list_concat(flatten([{', '.join(_lists)}])[1:{fixed.MAX_STEPS}],
  list_filter([CASE WHEN k.related IS NOT NULL AND risk_level <> 'LOW' THEN 'Open linked cases for '||array_to_string(k.related[1:4], ', ')
                 ||CASE WHEN len(k.related) > 4 THEN ' and others' ELSE '' END||' in the network view.' END,
               CASE risk_level {' '.join(f"WHEN '{lv}' THEN {quoted(t)}" for lv, t in fixed.CLOSING_STEPS.items())} END], lambda x: x IS NOT NULL)) AS steps
FROM scored LEFT JOIN (SELECT account_id, list(member ORDER BY n) AS related
  FROM (SELECT *, row_number() OVER (PARTITION BY account_id ORDER BY k, member) AS n FROM related_all) WHERE n <= 12 GROUP BY 1) k USING (account_id)"""
ORACLES["rp6_next_steps"] = sql("""
SELECT account_id, i - 1 AS position, steps[i] AS step FROM (SELECT account_id, steps, unnest(range(1, len(steps) + 1)) AS i FROM advice)""")
ORACLES["rp8_node_table"] = sql(f"""
SELECT account_id, risk_score, risk_level, array_to_string({ORDERED}, ',') AS patterns, len(found) > 0 AS has_patterns, in_degree, out_degree, total_degree,
       {r('weighted_in_degree', 2)} AS incoming_amount, {r('weighted_out_degree', 2)} AS outgoing_amount, {r('net_weight_flow', 2)} AS net_flow, transaction_count FROM scored""")
_catalog = ", ".join(f"('{p}', '{t}', '{s}')" for p, t, s in fixed.PATTERN_CATALOG)
CTES["catalog"] = f"SELECT * FROM (VALUES {_catalog}) v(pattern, title, severity)"
CTES["pattern_counts"] = """
SELECT c.pattern, c.title, c.severity, count(f.account_id) AS affected_accounts, CASE WHEN count(f.account_id) > 0 THEN 'Detected' ELSE 'Clean' END AS status
FROM catalog c LEFT JOIN ev_flags f USING (pattern) GROUP BY 1, 2, 3"""
ORACLES["rp9_pattern_summary"] = sql("SELECT * FROM pattern_counts")
CTES["ev_reach"] = "SELECT src AS a, dst AS b FROM ev_pairs UNION SELECT j.a, e.dst FROM ev_reach j JOIN ev_pairs e ON e.src = j.b"
CTES["ev_joined"] = "SELECT node AS a, nbr AS b FROM ev_both UNION SELECT j.a, e.nbr FROM ev_joined j JOIN ev_both e ON e.node = j.b"
CTES["ev_weak"] = """
SELECT a AS account_id, min(b) AS component FROM (SELECT a, b FROM ev_joined UNION SELECT account_id, account_id FROM ev_nodes) GROUP BY a"""
CTES["ev_multi"] = """
SELECT count(DISTINCT m) AS c FROM (SELECT x.a, min(x.b) AS m FROM ev_reach x JOIN ev_reach y ON x.a = y.b AND x.b = y.a GROUP BY 1 HAVING count(*) > 1)"""
ORACLES["rp10_global_stats"] = sql(f"""
SELECT count(*) AS total_accounts, count(*) FILTER (risk_level IN ('HIGH','CRITICAL')) AS high_risk_accounts, count(*) FILTER (risk_level = 'MEDIUM') AS medium_risk_accounts,
       {r('avg(risk_score)', 1)} AS average_risk_score, (SELECT count(*) FROM ev) AS total_transactions,
       (SELECT count(*) FROM pattern_counts WHERE status = 'Detected') AS active_detection_patterns,
       (SELECT c FROM ev_multi) + (SELECT count(*) FROM pattern_counts WHERE status = 'Detected') AS suspicious_networks,
       (SELECT round(e/(n*(n - 1)), 6) FROM (SELECT (SELECT count(*) FROM ev_nodes) AS n, (SELECT count(*) FROM ev_pairs) AS e)) AS density,
       (SELECT count(DISTINCT component) FROM ev_weak) AS weakly_connected_components,
       (SELECT CAST(round(sum(1.0/size)) AS BIGINT) FROM ev_strong) AS strongly_connected_components FROM scored""")
ORACLES["fs15_topology"] = sql(f"""
SELECT n.account_id, {r('mutual/u', 4)} AS reciprocity, {r('v*(SELECT count(*) FROM ev_nodes)', 4)} AS pagerank, {d('z.size')} AS scc_size,
       {d('coalesce(t.c, 0)')} AS triad_cycles, {d('coalesce(f, 0)')} AS two_hop_out, {d('coalesce(g, 0)')} AS two_hop_in, {r('m.a', 4)} AS avg_neighbor_degree
FROM ev_deg n JOIN rank_30 k USING (account_id) JOIN ev_strong z USING (account_id) LEFT JOIN triads t USING (account_id)
LEFT JOIN hops_out USING (account_id) LEFT JOIN hops_in USING (account_id)
JOIN (SELECT node AS account_id, avg(u) AS a FROM ev_both JOIN ev_deg ON nbr = account_id GROUP BY 1) m USING (account_id)""")
ORACLES["rp11_volume_timeline"] = sql(
    f"SELECT strftime(make_timestamp(t*1000000), '%Y-%m-%d %H') AS time, {r('sum(amount)', 2)} AS volume, count(*) AS count FROM ev GROUP BY 1")
ORACLES["rp12_risk_distribution"] = sql("""
SELECT l.risk_level, count(s.account_id) AS accounts FROM (VALUES ('LOW'), ('MEDIUM'), ('HIGH'), ('CRITICAL')) l(risk_level)
LEFT JOIN scored s USING (risk_level) GROUP BY 1""")
ORACLES["rp13_top_accounts"] = sql(
    "SELECT account_id, risk_score, risk_level, transaction_count, total_incoming, total_outgoing FROM scored ORDER BY risk_score DESC, account_id LIMIT 15")
ORACLES["rp14_account_search"] = sql("""
SELECT account_id, risk_score FROM scored WHERE risk_level = 'MEDIUM' AND list_contains(found, 'structuring') AND lower(account_id) LIKE '%u1%'
ORDER BY risk_score DESC, account_id LIMIT 100""")
ORACLES["rp16_ledger_page"] = sql("""
SELECT transaction_id, sender_id, receiver_id, CAST(amount AS DOUBLE) AS amount, t FROM ev
WHERE (lower(transaction_id) LIKE '%u1%' OR lower(sender_id) LIKE '%u1%' OR lower(receiver_id) LIKE '%u1%') AND amount >= 5000
ORDER BY t, transaction_id LIMIT 15 OFFSET 30""")
ORACLES["rp17_linked_transactions"] = sql("""
SELECT account_id, rank, transaction_id, t, direction, counterparty, CAST(amount AS DOUBLE) AS amount FROM (
  SELECT *, row_number() OVER (PARTITION BY account_id ORDER BY t DESC, transaction_id) AS rank FROM (
    SELECT sender_id AS account_id, 'OUT' AS direction, receiver_id AS counterparty, transaction_id, t, amount FROM ev
    UNION ALL SELECT receiver_id, 'IN', sender_id, transaction_id, t, amount FROM ev)) WHERE rank <= 60""")
CTES["ego1"] = """
SELECT target, node FROM (SELECT account_id AS target, account_id AS node FROM ev_nodes UNION SELECT node, nbr FROM ev_both)
JOIN scored ON account_id = node WHERE target = node OR risk_level <> 'LOW'"""
ORACLES["gr9_ego_filtered"] = sql("""
SELECT n.target, node_count, coalesce(edge_count, 0) AS edge_count
FROM (SELECT target, count(*) AS node_count FROM ego1 GROUP BY 1) n
LEFT JOIN (SELECT a.target, count(*) AS edge_count FROM ev_pairs p JOIN ego1 a ON a.node = p.src
           JOIN ego1 b ON b.node = p.dst AND b.target = a.target GROUP BY 1) e USING (target)""")
ORACLES["gr10_suspicious_edges"] = sql("""
SELECT src, dst, array_to_string(shared, ',') AS shared_patterns,
       len(shared) > 0 OR l1 IN ('HIGH','CRITICAL') OR l2 IN ('HIGH','CRITICAL') OR (l1 = 'MEDIUM' AND l2 = 'MEDIUM') AS is_suspicious
FROM (SELECT src, dst, list_sort(list_intersect(a.found, b.found)) AS shared, a.risk_level AS l1, b.risk_level AS l2
      FROM ev_pairs JOIN scored a ON a.account_id = src JOIN scored b ON b.account_id = dst)""")
ORACLES["rp25_masking"] = """
SELECT c_custkey, array_to_string(list_transform(string_split_regex(c_name||' '||c_mktsegment, '\\s+'),
         lambda w: CASE WHEN length(w) <= 1 THEN '*' ELSE w[1]||repeat('*', greatest(length(w) - 1, 3)) END), ' ') AS name,
       p[1:3]||repeat('*', length(p) - 6)||p[-3:] AS phone,
       CASE WHEN length(n) <= 4 THEN repeat('*', length(n)) ELSE repeat('*', length(n) - 4)||n[-4:] END AS national_id
FROM (SELECT *, '01'||lpad(CAST(c_custkey AS VARCHAR), 9, '7') AS p, CAST(c_custkey*7919 AS VARCHAR) AS n FROM customer)"""

# ---------------------------------------------------------------------------------- evaluation
CTES["fired"] = f"""
SELECT account_id, p AND mx >= 25000 AS r1_large_transaction, p AND max_daily >= 50000 AS r2_daily_volume, coalesce(near, 0) >= 3 AS r3_structuring,
       p AND per_hour >= 8 AS r4_velocity, same_day_turnover >= 0.8 AND tin >= 20000 AS r5_rapid_passthrough, p AND (s >= 10 OR q >= 10) AS r6_many_counterparties,
       ln(1 + tin + tout) AS log_volume
FROM (SELECT *, {tier_of('account_id')} = 'personal' AS p FROM li_tot)
JOIN (SELECT account_id, max(greatest(day_in, day_out)) AS max_daily FROM li_days GROUP BY 1) USING (account_id)
JOIN li_daily USING (account_id)
JOIN (SELECT account_id, max(c) AS per_hour FROM li_hours GROUP BY 1) USING (account_id)
JOIN (SELECT account_id, max(s) AS s, max(p) AS q FROM li_slots GROUP BY 1) USING (account_id)
LEFT JOIN (SELECT account_id, max(c) AS near FROM (SELECT account_id, is_out, (t - (SELECT min(t) FROM li))//86400 AS day, count(*) AS c FROM li_po
           WHERE amount >= 8500 AND amount < 10000 GROUP BY 1, 2, 3) GROUP BY 1) USING (account_id)"""
RULES = ("r1_large_transaction", "r2_daily_volume", "r3_structuring", "r4_velocity", "r5_rapid_passthrough", "r6_many_counterparties")
_fired = " + ".join(f"CAST({x} AS BIGINT)" for x in RULES)
ORACLES["ev1_rules"] = sql(f"SELECT account_id, {', '.join(RULES)}, {_fired} AS rules_fired, {_fired} >= 1 AS alert FROM fired")
ORACLES["ev2_rule_scores"] = sql(
    f"SELECT account_id, {r(f'({_fired}) + 0.5*log_volume/(SELECT greatest(max(log_volume), 1.0) FROM fired)')} AS score FROM fired")
CTES["conf"] = """
SELECT network_id, count(*) FILTER (alert AND y = 1) AS tp, count(*) FILTER (alert AND y = 0) AS fp, count(*) FILTER (NOT alert AND y = 1) AS fn,
       count(*) FILTER (NOT alert AND y = 0) AS tn FROM sc GROUP BY 1"""
CTES["conf2"] = """
SELECT *, tp/greatest(tp + fp, 1) AS precision, tp/greatest(tp + fn, 1) AS recall, fp/greatest(fp + tn, 1) AS fpr FROM conf"""
CTES["conf3"] = "SELECT *, 2*precision*recall/greatest(precision + recall, 1e-12) AS f1 FROM conf2"
ORACLES["ev3_confusion"] = sql(f"""
SELECT network_id, tp AS true_positives, fp AS false_positives, fn AS false_negatives, tn AS true_negatives, {rc('precision')}, {rc('recall')}, {rc('f1')},
       {r('fpr')} AS false_positive_rate, tp + fp AS alerts, {r('1000.0*(tp + fp)/(tp + fp + fn + tn)')} AS alerts_per_1000 FROM conf3""")


def steps(group: str | None) -> str:
    part = f"PARTITION BY {group} " if group else ""
    g = f"{group}, " if group else ""
    return f"""
SELECT {g}score, pos, n, sum(pos) OVER ({part}ORDER BY score DESC) AS cp, sum(n) OVER ({part}ORDER BY score DESC) AS cn,
       sum(pos) OVER ({part[:-1]}) AS p_all, sum(n) OVER ({part[:-1]}) AS n_all
FROM (SELECT {g}score, count(*) FILTER (y = 1) AS pos, count(*) AS n FROM sc GROUP BY {g}score)"""


CTES["steps"], CTES["all_steps"] = steps("network_id"), steps(None)
CTES["ap"] = "SELECT network_id, sum(pos/greatest(p_all, 1)*cp/cn) AS pr_auc FROM steps GROUP BY 1"
CTES["auc"] = """
SELECT network_id, sum(pos*((n_all - p_all) - (cn - cp) + 0.5*(n - pos)))/greatest(max(p_all*(n_all - p_all)), 1) AS roc_auc FROM steps GROUP BY 1"""
ORACLES["ev4_average_precision"] = sql(f"SELECT network_id, {rc('pr_auc')} FROM ap")
ORACLES["ev5_roc_auc"] = sql(f"SELECT network_id, {rc('roc_auc')} FROM auc")
ORACLES["ml8_best_f1_threshold"] = sql(f"""
SELECT network_id, score AS threshold, {rc('f1')} FROM (
  SELECT *, row_number() OVER (PARTITION BY network_id ORDER BY f1 DESC, score) AS k FROM (
    SELECT *, round(2*(cp/cn)*(cp/greatest(p_all, 1))/greatest(cp/cn + cp/greatest(p_all, 1), 1e-12), 12) AS f1 FROM steps)) WHERE k = 1""")
_metrics = ("precision", "recall", "f1", "pr_auc", "roc_auc")
ORACLES["ev6_mean_std"] = sql(" UNION ALL ".join(
    f"SELECT '{m}' AS metric, {r(f'avg({m})')} AS mean, {r(f'stddev_pop({m})')} AS std FROM conf3 JOIN ap USING (network_id) JOIN auc USING (network_id)" for m in _metrics))
ORACLES["ev7_recall_by_typology"] = sql(
    f"SELECT typology, count(*) AS accounts, {r('avg(CAST(alert AS INT))')} AS recall FROM sc WHERE y = 1 GROUP BY 1")
ORACLES["ev8_missed_by_rules"] = sql("""
SELECT typology, count(*) FILTER (y = 1) AS suspicious, count(*) FILTER (y = 1 AND score < 2000) AS missed_by_rules,
       count(*) FILTER (y = 1 AND score < 2000 AND alert) AS caught_by_model, count(*) FILTER (y = 0 AND score >= 2000) AS rule_false_positives,
       count(*) FILTER (y = 0 AND alert) AS model_false_positives FROM sc GROUP BY 1""")
CTES["rates"] = """
SELECT network_id, count(*) FILTER (y = 0) AS legitimate_accounts, count(*) FILTER (y = 1) AS suspicious_accounts,
       avg(CAST(alert AS INT)) FILTER (y = 0) AS false_positive_rate, avg(CAST(alert AS INT)) FILTER (y = 1) AS recall FROM sc GROUP BY 1"""
ORACLES["ev12_rates_by_tier"] = sql(
    f"SELECT network_id, legitimate_accounts, suspicious_accounts, {rc('false_positive_rate')}, {rc('recall')} FROM rates")
ORACLES["ev12_rate_gap"] = sql(
    f"SELECT {r('max(false_positive_rate)')} AS max_rate, {r('min(false_positive_rate)')} AS min_rate, {r('100*(max(false_positive_rate) - min(false_positive_rate))')} AS gap_percentage_points FROM rates")
CTES["cells"] = "SELECT typology, count(*) AS n, count(*) FILTER (alert) AS a, sum(count(*)) OVER () AS nn, sum(count(*) FILTER (alert)) OVER () AS aa FROM sc WHERE y = 0 GROUP BY 1"
CTES["tested"] = """
SELECT sum(power(CASE WHEN k = 2 THEN abs(a - e) - least(abs(a - e), 0.5) ELSE abs(a - e) END, 2)*(1/e + 1/(n - e))) AS x, count(*) - 1 AS d,
       min(a/n) AS low, max(a/n) AS high FROM (SELECT *, n*aa/nn AS e, count(*) OVER () AS k FROM cells)"""
# the lower tail as a series, long enough for the sample
CTES["tail"] = """
SELECT *, 1 - list_sum(list_transform(range(0, 400), lambda i: exp(-x/2 + (d/2 + i)*ln(x/2) - lgamma(d/2 + i + 1)))) AS p FROM tested"""
ORACLES["ev13_independence"] = sql(f"""
SELECT {r('x')} AS chi_square, d AS degrees, {r('low')} AS min_false_positive_rate, {r('high')} AS max_false_positive_rate,
       {r('p')} AS p_value, p > 0.05 AS independent FROM tail""")
ORACLES["ev15_workload"] = sql(f"""
SELECT accounts AS accounts_scored, ra AS rule_alerts, rh AS rule_hits, ma AS model_alerts, mh AS model_hits, CAST(needed AS BIGINT) AS alerts_to_match_rules,
       {r('1.0 - needed/greatest(ra, 1)')} AS alert_reduction_at_equal_recall, {r('coalesce(hb, 0)/greatest(p, 1)')} AS recall_at_rules_budget,
       {r('1.0 - ma/greatest(ra, 1)')} AS alert_reduction_at_operating_point, {r('(ra - ma)*20/60.0')} AS analyst_hours_saved,
       {r('ra*20/greatest(rh, 1)')} AS rule_minutes_per_hit, {r('ma*20/greatest(mh, 1)')} AS model_minutes_per_hit
FROM (SELECT f.*, (SELECT min(cn) FROM all_steps WHERE cp >= rh) AS needed, (SELECT max(cp) FROM all_steps WHERE cn <= ra) AS hb
      FROM (SELECT count(*) AS accounts, count(*) FILTER (y = 1) AS p, count(*) FILTER (score >= 2000) AS ra, count(*) FILTER (score >= 2000 AND y = 1) AS rh,
                   count(*) FILTER (alert) AS ma, count(*) FILTER (alert AND y = 1) AS mh FROM sc) f)""")
ORACLES["ev16_scenario_verdicts"] = sql("""
SELECT account_tier AS scenario, account_id AS target, 'structuring' AS expected_pattern, list_contains(found, 'structuring') AS pattern_found,
       risk_score, risk_level, CASE WHEN list_contains(found, 'structuring') AND risk_score >= 40 THEN 'PASS' ELSE 'FAIL' END AS status
FROM (SELECT *, row_number() OVER (PARTITION BY account_tier ORDER BY risk_score DESC, account_id DESC) AS k FROM scored) WHERE k = 1""")
ORACLES["ev17_dataset_summary"] = sql(f"""
SELECT 'transactions' AS section, 'all' AS name, CAST(count(*) AS DOUBLE) AS value FROM li
UNION ALL SELECT 'total_volume', 'all', {r('sum(amount)', 2)} FROM li
UNION ALL SELECT 'accounts_by_tier', network_id, CAST(count(*) AS DOUBLE) FROM sc GROUP BY network_id
UNION ALL SELECT 'suspicious_by_typology', typology, CAST(count(*) AS DOUBLE) FROM sc WHERE y = 1 GROUP BY typology""")

# ----------------------------------------------------------------------------------- streaming
for _q, _v in (("st1_recent_day", "today"), ("st1_latest_day_of_store", "today"), ("st1_incremental_store", "ev")):
    ORACLES[_q] = sql("SELECT account_id, " + ", ".join(rc(c) for c in fixed.TRANSACTIONAL) + f" FROM {_v}_fs")
ORACLES["st2_tumbling_counts"] = sql("""
SELECT account_id, max_tx_per_hour, max_senders_2h, max_receivers_2h FROM (SELECT account_id, max(c) AS max_tx_per_hour FROM ev_hours GROUP BY 1)
JOIN (SELECT account_id, max(s) AS max_senders_2h, max(p) AS max_receivers_2h FROM ev_slots GROUP BY 1) USING (account_id)""")
ORACLES["st4_stream_duplicates"] = sql("SELECT transaction_id, t FROM ev")
