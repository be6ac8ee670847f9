"""Thresholds, windows, catalogues and texts that decide what the results are."""

from __future__ import annotations

from decimal import Decimal

# --- Fixed values: validation -------------------------------------------------------------
MAX_AMOUNT = 1_000_000_000.0
CONTEXT_FIELDS = ("tx_type", "location", "device_id")
CONTEXT_WIDTH = 64

# --- Fixed values: time -------------------------------------------------------------------
HOUR = 3600
TWO_HOURS = 7200
DAY = 86400

# --- Fixed values: pattern detectors ------------------------------------------------------
FAN_MIN_DEGREE = 4
FAN_MIN_RATIO = 2.0
REPORTING_THRESHOLD = Decimal("10000")
NEAR_RATIO = Decimal("0.85")
SUB_RATIO = Decimal("0.5")
ROUND_STEP = 500
FLOW_MIN_AMOUNT = Decimal("1000")
FLOW_MIN_RATIO = Decimal("0.70")
FLOW_MAX_RATIO = Decimal("1.10")
FLOW_MAX_PATH = 8
FLOW_MAX_INBOX = 64
FAST_WINDOW = 3600
SLOW_WINDOW = 43200
LOOP_WINDOW = 6 * 3600
LOOP_MIN_RATIO = Decimal("0.5")
LOOP_MAX_RATIO = Decimal("1.1")

# --- Fixed values: context detectors ------------------------------------------------------
FORMAL_TX_TYPES = (
    "inward_remittance", "float_topup", "float_return", "salary", "settlement", "cash_out", "payment",
)
NOT_PAYOUT_TX_TYPES = ("float_return", "settlement", "payment")
CONTEXT_PATTERNS = ("location_anomaly", "takeover_collector", "hundi_operator", "hundi_funder")
TAKEOVER_SIGNALS = (
    "first activity from this risk area",
    "new handset",
    "unusually large outflow in 24 hours",
    "money sent to receivers never paid before",
)

# --- Fixed values: composite score --------------------------------------------------------
PATTERN_POINTS = {
    "circular_flow": 35.0,
    "rapid_movement": 30.0,
    "coordinated_network": 40.0,
    "structuring": 55.0,
    "fan_in": 25.0,
    "fan_out": 25.0,
    "location_anomaly": 55.0,
    "takeover_collector": 95.0,
    "hundi_operator": 95.0,
    "hundi_funder": 55.0,
}
CHAIN_POINTS = 20.0
NEIGHBOUR_POINTS = 15.0
BUSINESS_TIERS = ("agent", "merchant")
BUSINESS_AS_USUAL = ("fan_in", "fan_out", "rapid_movement", "structuring")
SCORE_WEIGHTS = (0.40, 0.40, 0.20)
GRAPH_FLOOR = 0.75
LEVELS = ("LOW", "MEDIUM", "HIGH", "CRITICAL")

# Order in which an account's patterns are listed.
PATTERN_ORDER = (
    "fan_in", "fan_out", "circular_flow", "transaction_chain", "rapid_movement", "structuring",
    "coordinated_network", "location_anomaly", "takeover_collector", "hundi_operator", "hundi_funder",
)
# Patterns that make a neighbour suspicious (no chain, no context patterns).
NEIGHBOUR_PATTERNS = (
    "fan_in", "fan_out", "rapid_movement", "coordinated_network", "circular_flow", "structuring",
)

# (id, title, severity) of the pattern catalogue.
PATTERN_CATALOG = (
    ("fan_in", "Fan-In Hub", "HIGH"),
    ("fan_out", "Fan-Out Hub", "HIGH"),
    ("rapid_movement", "Rapid Passthrough", "CRITICAL"),
    ("transaction_chain", "Multi-Hop Chain", "MEDIUM"),
    ("circular_flow", "Circular Loop", "CRITICAL"),
    ("structuring", "Structured Transfers", "HIGH"),
    ("hundi_operator", "Hundi Payout", "CRITICAL"),
    ("hundi_funder", "Hundi Funder", "HIGH"),
    ("location_anomaly", "Possible Takeover", "HIGH"),
    ("takeover_collector", "Takeover Collector", "CRITICAL"),
    ("coordinated_network", "Coordinated Cluster", "CRITICAL"),
)

PATTERN_LABELS = {
    "fan_in": "fan-in collection",
    "fan_out": "fan-out dispersal",
    "rapid_movement": "rapid pass-through",
    "transaction_chain": "multi-hop chain",
    "circular_flow": "circular flow",
    "structuring": "structuring",
    "coordinated_network": "coordinated cluster",
    "location_anomaly": "risk-area activity outside the customer's baseline",
    "takeover_collector": "collection from suspected takeovers",
    "hundi_operator": "hundi-style recurring payout",
    "hundi_funder": "funding of a hundi operator",
}

# Most to least specific: (needed patterns, name, text).
TYPOLOGIES = (
    (("hundi_operator",), "Hundi operator (informal remittance payout)",
     "repeatedly receives large informal transfers from a few funders and pays them out to the same beneficiaries, outside licensed remittance channels"),
    (("hundi_funder",), "Hundi funder",
     "repeatedly sends large transfers to a wallet that pays them out as informal remittance"),
    (("takeover_collector",), "Account-takeover collector",
     "collects money from several wallets that were suddenly emptied from a risk area"),
    (("location_anomaly",), "Possible account takeover (customer at risk)",
     "was suddenly used from a risk area, outside this customer's normal pattern, to move money out fast"),
    (("fan_in", "rapid_movement", "structuring"), "Money-mule collection hub",
     "collects split deposits from many wallets and forwards them almost immediately"),
    (("structuring", "fan_in"), "Structured deposit collection",
     "receives many near-threshold deposits from different wallets"),
    (("structuring",), "Structuring (smurfing)",
     "moves money in repeated amounts kept just under the monitoring threshold"),
    (("circular_flow", "rapid_movement"), "Layering loop",
     "passes funds quickly around a loop that returns them to their origin"),
    (("circular_flow",), "Round-tripping",
     "sends funds around a closed loop that brings most of the value back"),
    (("coordinated_network",), "Coordinated account cluster",
     "transacts densely with a closed group of wallets"),
    (("rapid_movement", "transaction_chain"), "Pass-through mule",
     "relays funds along a multi-hop chain within minutes"),
    (("rapid_movement",), "Pass-through account",
     "forwards most incoming funds onward within the hour"),
    (("fan_out",), "Dispersal account",
     "spreads funds to many receivers in a short burst"),
    (("fan_in",), "Collection account",
     "receives funds from many different senders in a short burst"),
    (("transaction_chain",), "Chain intermediary",
     "sits inside a multi-hop transfer chain"),
)
NO_TYPOLOGY = ("No suspicious typology", "shows no network pattern that matches a known typology")

# Recommended checks, in the order in which patterns take priority.
NEXT_STEPS = (
    ("hundi_operator", (
        "Compare the payouts with licensed inward-remittance records; payouts with no matching formal remittance indicate hundi.",
        "Interview the agent or wallet owner about the source of the large transfers and review the funders' KYC and income profile.",
        "Check whether the same beneficiaries are paid on a monthly cycle and whether they have relatives working abroad.",
    )),
    ("hundi_funder", (
        "Establish the source of the funds sent to the operator and whether the funder is linked to an overseas hundi network.",
    )),
    ("takeover_collector", (
        "Hold outgoing transfers and cash-out on the collecting wallet under internal policy and review its KYC, device and agent linkage.",
        "List every wallet that paid it during the suspected takeovers and contact those customers.",
    )),
    ("location_anomaly", (
        "Treat the customer as a possible victim: trigger step-up authentication (PIN reset, OTP to the registered SIM) and call the registered number.",
        "Check for a recent SIM replacement or device change on the wallet and consider a temporary hold on outgoing transfers under company policy.",
        "If the customer confirms the activity is theirs, close as a false positive; the area then becomes part of their normal pattern.",
    )),
    ("structuring", (
        "Pull the full list of near-threshold transfers and check whether one person controls the sending wallets (same NID, device or SIM).",
        "Compare the combined amount with the account's declared income or business profile.",
    )),
    ("fan_in", (
        "Identify the sending wallets and check how recently they were opened and whether they share a device, SIM or agent.",
        "Contact a sample of senders to confirm the purpose of their payments.",
    )),
    ("rapid_movement", (
        "Review the timing of each receive-and-forward pair; funds held for minutes suggest the wallet is a relay, not the beneficiary.",
        "Check cash-out records for the destination wallets and the agents involved.",
    )),
    ("circular_flow", (
        "Map every hop in the loop and confirm whether the wallets share an owner or beneficiary.",
        "Look for a business reason for money returning to its origin; absent one, treat it as layering.",
    )),
    ("fan_out", (
        "Trace where the receiving wallets sent the money next and whether they cashed out through the same agents.",
    )),
    ("transaction_chain", (
        "Follow the chain to its final destination wallet and review that wallet's cash-out activity.",
    )),
    ("coordinated_network", (
        "Review the cluster's KYC records together: shared addresses, devices, SIMs or registration agents point to common control.",
    )),
)
CLOSING_STEPS = {
    "CRITICAL": "Escalate to the compliance officer today; consider a temporary hold on outgoing transfers under internal policy and prepare a Suspicious Transaction Report (STR) for BFIU if the review confirms the pattern.",
    "HIGH": "Escalate for priority review and decide on enhanced due diligence or an STR once the checks above are complete.",
    "MEDIUM": "Place the account on enhanced monitoring and review again if similar activity repeats.",
    "LOW": "The score is below the review threshold, so keep the account on routine monitoring; the checks above apply only if the pattern repeats.",
}
MAX_STEPS = 5
MAX_RELATED = 12

# Plain-language names of model features.
FEATURE_LABELS = {
    "forward_share_fast": "share of received money forwarded within an hour",
    "forward_share_slow": "share of received money forwarded within 12 hours",
    "forward_count_fast": "payments forwarded within an hour of receipt",
    "forward_count_slow": "payments forwarded within 12 hours of receipt",
    "chain_length_fast": "length of the fast flow chain it sits in (hops)",
    "chain_length_slow": "length of the flow chain it sits in (hops)",
    "cycle_count_fast": "times money looped back within the hour",
    "cycle_count_slow": "times money looped back to it",
    "dwell_fast_s": "seconds money rests before being forwarded",
    "dwell_slow_s": "seconds money rests before being forwarded (12h window)",
    "passthrough_ratio": "pass-through ratio (money out vs money in)",
    "same_day_turnover": "share of receipts that leave the same day",
    "near_threshold_out": "payments sent just under the threshold",
    "near_threshold_in": "payments received just under the threshold",
    "sub_threshold_share": "share of transactions at 50-100% of the threshold",
    "max_senders_2h": "most distinct senders within 2 hours",
    "max_receivers_2h": "most distinct receivers within 2 hours",
    "in_degree": "number of distinct senders",
    "out_degree": "number of distinct receivers",
    "reciprocity": "share of counterparties it both pays and is paid by",
    "night_share": "share of activity between midnight and 6am",
    "total_incoming": "total received (BDT)",
    "total_outgoing": "total sent (BDT)",
    "average_transaction_amount": "average transaction amount (BDT)",
    "maximum_transaction_amount": "largest transaction (BDT)",
    "counterparty_diversity": "distinct counterparties per transaction",
    "triad_cycles": "three-account loops through it",
    "transaction_count": "number of transactions",
    "active_days": "days active",
}
NEIGHBOUR_LABELS = (
    ("nb_in_", "average over the accounts that pay it: "),
    ("nb_out_", "average over the accounts it pays: "),
    ("nb2_", "average over its 2-hop neighbourhood: "),
)

# --- Fixed values: feature families -------------------------------------------------------
TRANSACTIONAL = (
    "transaction_count", "sent_count", "received_count", "total_incoming", "total_outgoing", "net_flow",
    "average_transaction_amount", "maximum_transaction_amount", "std_transaction_amount",
    "incoming_outgoing_ratio", "passthrough_ratio", "flow_imbalance_magnitude", "counterparty_diversity",
    "amount_volatility", "near_threshold_out", "near_threshold_in", "sub_threshold_share", "round_amount_share",
)
TEMPORAL = (
    "active_days", "active_span_hours", "transaction_velocity", "max_tx_per_hour", "max_senders_2h",
    "max_receivers_2h", "night_share", "hour_entropy", "inter_arrival_median_s", "inter_arrival_cv",
    "burstiness", "same_day_turnover", "dwell_fast_s", "dwell_slow_s",
)
GRAPH = (
    "in_degree", "out_degree", "degree_ratio", "reciprocity", "pagerank", "scc_size", "triad_cycles",
    "two_hop_out", "two_hop_in", "avg_neighbor_degree",
    "forward_count_fast", "forward_share_fast", "chain_length_fast", "cycle_count_fast",
    "forward_count_slow", "forward_share_slow", "chain_length_slow", "cycle_count_slow",
)
MESSAGE_BASE = (
    "log_total_incoming", "log_total_outgoing", "passthrough_ratio", "chain_length_slow", "forward_share_slow",
    "near_threshold_total", "cycle_count_slow", "night_share", "log_in_degree", "log_out_degree",
)
NEIGHBOURHOOD = tuple(f"{p}{m}" for p in ("nb_in_", "nb_out_", "nb2_") for m in MESSAGE_BASE)
TIERS = ("personal", "agent", "merchant")
TIER_FLAGS = tuple(f"tier_{t}" for t in TIERS)
FAMILIES = {
    "transactional": TRANSACTIONAL,
    "temporal": TEMPORAL,
    "graph": GRAPH,
    "neighbourhood": NEIGHBOURHOOD,
    "account_type": TIER_FLAGS,
}
ALL_FEATURES = tuple(c for family in FAMILIES.values() for c in family)
TABULAR_FEATURES = TRANSACTIONAL + tuple(c for c in TEMPORAL if not c.startswith("dwell_")) + TIER_FLAGS

# --- Fixed values: case workflow ----------------------------------------------------------
STATUSES = ("OPEN", "IN_REVIEW", "ESCALATED", "SAR_FILED", "CLOSED_FALSE_POSITIVE")
DECISIONS = ("SAR_FILED", "CLOSED_FALSE_POSITIVE")
TRANSITIONS = {
    "OPEN": ("IN_REVIEW", "ESCALATED", "CLOSED_FALSE_POSITIVE"),
    "IN_REVIEW": ("ESCALATED", "OPEN", "CLOSED_FALSE_POSITIVE"),
    "ESCALATED": ("SAR_FILED", "CLOSED_FALSE_POSITIVE", "IN_REVIEW"),
    "SAR_FILED": ("IN_REVIEW",),
    "CLOSED_FALSE_POSITIVE": ("IN_REVIEW",),
}
PRIORITY_BY_LEVEL = {"CRITICAL": "P1", "HIGH": "P2", "MEDIUM": "P3", "LOW": "P4"}
GENESIS_HASH = "0" * 64
MINUTES_PER_ALERT = 20


# Labels of the feature ladder and the columns of the anomaly vector.
LADDER = (
    ("transactional", ("transactional", "account_type")),
    ("+ temporal", ("transactional", "account_type", "temporal")),
    ("+ graph and flow tracing", ("transactional", "account_type", "temporal", "graph")),
    ("+ 2-hop neighbourhood", ("transactional", "account_type", "temporal", "graph", "neighbourhood")),
)

VECTOR = (
    "transaction_count", "sent_count", "received_count", "total_incoming", "total_outgoing", "net_flow",
    "average_transaction_amount", "maximum_transaction_amount", "std_transaction_amount", "unique_senders",
    "unique_receivers", "incoming_outgoing_ratio", "transaction_velocity", "counterparty_diversity",
    "passthrough_ratio", "amount_volatility", "flow_imbalance_magnitude", "in_degree", "out_degree", "total_degree",
    "degree_ratio", "weighted_in_degree", "weighted_out_degree", "net_weight_flow", "unique_counterparties",
    "fan_in_score", "fan_out_score", "cycle_detected", "cycle_count", "chain_length", "structuring_detected",
    "near_threshold_tx_count", "network_size", "suspicious_neighbor_count",
)
