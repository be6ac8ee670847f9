"""Evaluation: rules baseline, classification metrics, fairness, workload."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.exprs import dbl, near_threshold, postings
from ..functions.tails import chi_square_tail
from ..functions.order import running_totals
from . import store


def _ratio(a: Column, b: Column) -> Column:
    """a / max(b, 1): 0 where there is nothing to divide."""
    return a / F.greatest(b, F.lit(1))


# -------------------------------------------------------------------------------- rules baseline
def rules(tx: DataFrame, features: DataFrame, per_day: DataFrame) -> DataFrame:
    """Six conventional rules per account, their count, a ranking score and the alert.

    ``features`` holds the store's columns used below and ``tier_personal``; ``per_day`` is
    ``store.daily_sums``. Large amount, daily volume, velocity and counterparty rules watch personal
    accounts only.
    """
    max_daily = per_day.groupBy("account_id").agg(dbl(F.max(F.greatest("day_in", "day_out"))).alias("max_daily"))
    day = F.floor((F.col("t") - store.first_time(tx)) / fixed.DAY)
    near = postings(tx.where(near_threshold(F.col("amount"))).select("sender_id", "receiver_id", "t"))
    max_near = near.withColumn("day", day).groupBy("account_id", "day", "is_out").agg(F.count("*").alias("c")).groupBy(
        "account_id").agg(F.max("c").alias("max_near"))
    rows = features.join(max_daily, "account_id", "left").join(max_near, "account_id", "left").na.fill(
        {"max_daily": 0.0, "max_near": 0})
    personal = F.col("tier_personal") > 0
    fired = {
        "r1_large_transaction": personal & (F.col("maximum_transaction_amount") >= 25000),
        "r2_daily_volume": personal & (F.col("max_daily") >= 50000),
        "r3_structuring": F.col("max_near") >= 3,
        "r4_velocity": personal & (F.col("max_tx_per_hour") >= 8),
        "r5_rapid_passthrough": (F.col("same_day_turnover") >= 0.8) & (F.col("total_incoming") >= 20000),
        "r6_many_counterparties": personal & ((F.col("max_senders_2h") >= 10) | (F.col("max_receivers_2h") >= 10)),
    }
    total = sum((F.when(rule, 1).otherwise(0) for rule in fired.values()), F.lit(0))
    return rows.select(
        "account_id", *[rule.alias(name) for name, rule in fired.items()], total.cast("bigint").alias("rules_fired"),
        F.log1p(F.col("total_incoming") + F.col("total_outgoing")).alias("log_volume"),
    ).withColumn("alert", F.col("rules_fired") >= 1)


def rule_scores(fired: DataFrame) -> DataFrame:
    """Rules fired, with half a point at most for volume to break ties."""
    top = fired.select(F.greatest(F.max("log_volume"), F.lit(1.0))).scalar()
    return fired.withColumn("score", F.col("rules_fired") + 0.5 * F.col("log_volume") / top)


# --------------------------------------------------------------------------------------- metrics
def confusion(scored: DataFrame, group: Sequence[str] = ()) -> DataFrame:
    """Precision, recall, F1, false positive rate and alert counts. Needs y and alert."""
    hit, bad = F.col("alert").cast("boolean"), F.col("y") == 1
    counts = scored.groupBy(*group).agg(
        F.count_if(hit & bad).alias("true_positives"), F.count_if(hit & ~bad).alias("false_positives"),
        F.count_if(~hit & bad).alias("false_negatives"), F.count_if(~hit & ~bad).alias("true_negatives"))
    tp, fp, fn, tn = (F.col(c) for c in ("true_positives", "false_positives", "false_negatives", "true_negatives"))
    precision, recall = _ratio(tp, tp + fp), _ratio(tp, tp + fn)
    return counts.withColumn("precision", precision).withColumn("recall", recall).select(
        "*", (2 * precision * recall / F.greatest(precision + recall, F.lit(1e-12))).alias("f1"),
        _ratio(fp, fp + tn).alias("false_positive_rate"), (tp + fp).alias("alerts"),
        (1000.0 * (tp + fp) / (tp + fp + fn + tn)).alias("alerts_per_1000"))


def score_steps(scored: DataFrame, group: Sequence[str] = ()) -> DataFrame:
    """Running positives and rows per distinct score, highest first: the ranking every curve uses."""
    rows = scored.select(*group, "score", F.when(F.col("y") == 1, 1).otherwise(0).alias("pos"), F.lit(1).alias("n"))
    return running_totals(rows, group, "score", ["pos", "n"])


def _with_totals(steps: DataFrame, group: Sequence[str]) -> DataFrame:
    totals = steps.groupBy(*group).agg(F.sum("pos").alias("all_pos"), F.sum("n").alias("all_n"))
    if group:
        return steps.join(totals, list(group))
    return steps.withColumn("all_pos", totals.select("all_pos").scalar()).withColumn("all_n", totals.select("all_n").scalar())


def average_precision(scored: DataFrame, group: Sequence[str] = ()) -> DataFrame:
    """Step-wise average precision."""
    steps = _with_totals(score_steps(scored, group), group)
    gain = F.col("pos") / F.greatest("all_pos", F.lit(1)) * F.col("cum_pos") / F.col("cum_n")
    return steps.groupBy(*group).agg(F.sum(gain).alias("pr_auc"))


def roc_auc(scored: DataFrame, group: Sequence[str] = ()) -> DataFrame:
    """Probability that a positive outranks a negative, ties counting half."""
    steps = _with_totals(score_steps(scored, group), group)
    negatives = F.col("all_n") - F.col("all_pos")
    here = F.col("n") - F.col("pos")
    below = negatives - (F.col("cum_n") - F.col("cum_pos"))
    wins = F.sum(F.col("pos") * (below + 0.5 * here))
    return steps.groupBy(*group).agg((wins / F.greatest(F.max(F.col("all_pos") * negatives), F.lit(1))).alias("roc_auc"))


def best_f1_threshold(scored: DataFrame, group: Sequence[str] = ()) -> DataFrame:
    """Score with the best F1 when everything at or above it alerts; the lowest one on ties."""
    steps = _with_totals(score_steps(scored, group), group)
    precision = F.col("cum_pos") / F.col("cum_n")
    recall = _ratio(F.col("cum_pos"), F.col("all_pos"))
    f1 = F.round(2 * precision * recall / F.greatest(precision + recall, F.lit(1e-12)), 12)
    best = F.max(F.struct(f1.alias("f1"), (-F.col("score")).alias("neg")))
    return steps.groupBy(*group).agg(best.alias("b")).select(
        *group, (-F.col("b.neg")).alias("threshold"), F.col("b.f1").alias("f1"))


def metrics(scored: DataFrame, group: Sequence[str]) -> DataFrame:
    return confusion(scored, group).join(average_precision(scored, group), list(group)).join(
        roc_auc(scored, group), list(group))


def mean_std(per_network: DataFrame, names: Sequence[str], group: Sequence[str] = ()) -> DataFrame:
    """Mean and population deviation of metrics over networks, in long form."""
    pairs = F.explode(F.array(*[F.struct(F.lit(n).alias("metric"), dbl(n).alias("v")) for n in names]))
    return per_network.select(*group, pairs.alias("m")).select(*group, "m.*").groupBy(*group, "metric").agg(
        F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"))


def recall_by(scored: DataFrame, by: str) -> DataFrame:
    """Suspicious accounts and the share alerted, per value of ``by``."""
    return scored.where("y = 1").groupBy(by).agg(
        F.count("*").alias("accounts"), F.avg(F.col("alert").cast("int")).alias("recall"))


def missed_by_rules(joined: DataFrame, by: str) -> DataFrame:
    """Suspicious accounts no rule fired on and how many of them the model alerts on.

    ``joined`` holds y, rule_alert and alert.
    """
    missed = (F.col("y") == 1) & ~F.col("rule_alert")
    return joined.groupBy(by).agg(
        F.count_if(F.col("y") == 1).alias("suspicious"), F.count_if(missed).alias("missed_by_rules"),
        F.count_if(missed & F.col("alert")).alias("caught_by_model"),
        F.count_if((F.col("y") == 0) & F.col("rule_alert")).alias("rule_false_positives"),
        F.count_if((F.col("y") == 0) & F.col("alert")).alias("model_false_positives"))


def rates_by(scored: DataFrame, by: str) -> DataFrame:
    """False positive rate and recall per tier (or any column)."""
    legit, bad, alert = F.col("y") == 0, F.col("y") == 1, F.col("alert").cast("int")
    return scored.groupBy(by).agg(
        F.count_if(legit).alias("legitimate_accounts"), F.count_if(bad).alias("suspicious_accounts"),
        F.avg(F.when(legit, alert)).alias("false_positive_rate"), F.avg(F.when(bad, alert)).alias("recall"))


def rate_gap(rates: DataFrame) -> DataFrame:
    hi, lo = F.max("false_positive_rate"), F.min("false_positive_rate")
    return rates.agg(hi.alias("max_rate"), lo.alias("min_rate"), (100 * (hi - lo)).alias("gap_percentage_points"))


def independence(scored: DataFrame, by: str, level: float = 0.05) -> DataFrame:
    """Whether alerts on legitimate accounts are independent of ``by``: chi-square test and the rate range.

    Two groups are tested with a continuity correction. Where nobody or everybody is alerted there is no
    statistic and no p-value, and nothing speaks against independence.
    """
    table = scored.where("y = 0").groupBy(by).agg(
        F.count("*").alias("n"), F.sum(F.col("alert").cast("int")).alias("a"))
    totals = table.agg(F.sum("n").alias("n"), F.sum("a").alias("a"), F.count("*").alias("k"))
    rows = table.withColumn("all_n", totals.select("n").scalar()).withColumn("all_a", totals.select("a").scalar()).withColumn(
        "groups", totals.select("k").scalar())
    expect_a = F.col("n") * F.col("all_a") / F.col("all_n")
    expect_q = F.col("n") - expect_a
    off = F.abs(F.col("a") - expect_a)
    miss = F.pow(F.when(F.col("groups") == 2, off - F.least(off, F.lit(0.5))).otherwise(off), 2)
    mixed = (F.col("all_a") > 0) & (F.col("all_a") < F.col("all_n"))
    stat = F.when(mixed, miss / F.when(mixed, expect_a) + miss / F.when(mixed, expect_q)).otherwise(0.0)
    tested = rows.agg(
        F.sum(stat).alias("chi_square"), (F.count("*") - 1).alias("degrees"),
        F.min(F.col("a") / F.col("n")).alias("min_false_positive_rate"),
        F.max(F.col("a") / F.col("n")).alias("max_false_positive_rate"), F.coalesce(F.max(mixed), F.lit(False)).alias("mixed"))
    p = F.when(F.col("mixed") & (F.col("degrees") > 0), chi_square_tail(F.col("chi_square"), F.col("degrees")))
    return tested.withColumn("p_value", p).withColumn("independent", F.col("p_value").isNull() | (F.col("p_value") > level)).drop("mixed")


def detector_quality(flags: DataFrame, truth: DataFrame, lookalikes: Sequence[str] = ()) -> DataFrame:
    """Precision and recall per detector, and how many look-alikes it flags.

    ``flags``: account_id, pattern. ``truth``: account_id, pattern, is_true, and a boolean column per
    kind of legitimate look-alike.
    """
    rows = truth.join(flags.select("account_id", "pattern", F.lit(True).alias("flagged")).distinct(),
                      ["account_id", "pattern"], "left").withColumn("flagged", F.coalesce("flagged", F.lit(False)))
    flagged, true = F.col("flagged"), F.col("is_true")
    out = rows.groupBy("pattern").agg(
        F.count_if(true).alias("true_cases"), F.count_if(flagged).alias("flagged_cases"),
        F.count_if(flagged & true).alias("true_positives"), F.count_if(flagged & ~true).alias("false_positives"),
        F.count_if(~true).alias("negatives"),
        *[F.count_if(F.col(c)).alias(c) for c in lookalikes],
        *[F.count_if(F.col(c) & flagged & ~true).alias(f"{c}_flagged") for c in lookalikes])
    return out.withColumn("precision", _ratio(F.col("true_positives"), F.col("true_positives") + F.col("false_positives"))).withColumn(
        "recall", _ratio(F.col("true_positives"), F.col("true_cases"))).withColumn(
        "false_positive_rate", _ratio(F.col("false_positives"), F.col("negatives"))).drop("negatives")


def workload(scored: DataFrame, minutes: int = fixed.MINUTES_PER_ALERT) -> DataFrame:
    """Alerts the model needs for the rules' recall, and its recall on the rules' alert budget.

    ``scored`` holds y, score, alert and rule_alert. Accounts with the same score alert together.
    """
    steps = score_steps(scored)
    facts = scored.agg(
        F.count("*").alias("accounts_scored"), F.count_if(F.col("y") == 1).alias("suspicious"),
        F.count_if("rule_alert").alias("rule_alerts"), F.count_if(F.col("rule_alert") & (F.col("y") == 1)).alias("rule_hits"),
        F.count_if("alert").alias("model_alerts"), F.count_if(F.col("alert") & (F.col("y") == 1)).alias("model_hits"))
    placed = steps.withColumn("need", facts.select("rule_hits").scalar()).withColumn("budget", facts.select("rule_alerts").scalar())
    marks = placed.agg(
        F.min(F.when(F.col("cum_pos") >= F.col("need"), F.col("cum_n"))).alias("needed"),
        F.max(F.when(F.col("cum_n") <= F.col("budget"), F.col("cum_pos"))).alias("hits_at_budget"))
    out = facts.withColumn("needed", marks.select("needed").scalar()).withColumn(
        "hits_at_budget", marks.select("hits_at_budget").scalar())
    needed = F.when(F.col("rule_hits") > 0, F.col("needed")).otherwise(0)
    return out.select(
        "accounts_scored", "rule_alerts", "rule_hits", "model_alerts", "model_hits",
        needed.alias("alerts_to_match_rules"), (1.0 - _ratio(needed, F.col("rule_alerts"))).alias("alert_reduction_at_equal_recall"),
        _ratio(F.coalesce("hits_at_budget", F.lit(0)), F.col("suspicious")).alias("recall_at_rules_budget"),
        (1.0 - _ratio(F.col("model_alerts"), F.col("rule_alerts"))).alias("alert_reduction_at_operating_point"),
        ((F.col("rule_alerts") - F.col("model_alerts")) * minutes / 60.0).alias("analyst_hours_saved"),
        _ratio(F.col("rule_alerts") * minutes, F.col("rule_hits")).alias("rule_minutes_per_hit"),
        _ratio(F.col("model_alerts") * minutes, F.col("model_hits")).alias("model_minutes_per_hit"))


def scenario_verdicts(scenarios: DataFrame, reports: DataFrame, max_high_percent: float = 15.0) -> DataFrame:
    """PASS or FAIL per scenario.

    ``scenarios``: scenario, target (null for the normal baseline), expected_pattern. ``reports``:
    scenario, account_id, risk_score, risk_level, patterns. A planted target passes when its pattern is
    found and it scores 40 or more; the baseline passes with no CRITICAL and few HIGH accounts.
    """
    spread = reports.groupBy("scenario").agg(
        F.count("*").alias("accounts"), F.count_if(F.col("risk_level") == "HIGH").alias("high"),
        F.count_if(F.col("risk_level") == "CRITICAL").alias("critical"))
    target = reports.select("scenario", F.col("account_id").alias("target"), "risk_score", "risk_level", "patterns")
    rows = scenarios.join(spread, "scenario", "left").join(target, ["scenario", "target"], "left")
    found = F.coalesce(F.array_contains("patterns", F.col("expected_pattern")), F.lit(False))
    elevated = F.coalesce(F.col("risk_score") >= 40.0, F.lit(False))
    share = 100.0 * (F.col("high") + F.col("critical")) / F.col("accounts")
    quiet = (F.col("critical") == 0) & (share <= max_high_percent)
    passed = F.when(F.col("target").isNull(), quiet).otherwise(found & elevated)
    return rows.select("scenario", "target", "expected_pattern", found.alias("pattern_found"), "risk_score", "risk_level",
                       F.when(passed, "PASS").otherwise("FAIL").alias("status"))


def dataset_summary(tx: DataFrame, labels: DataFrame) -> DataFrame:
    """Counts in long form: transfers, volume, accounts per tier, suspicious accounts per typology."""
    base = tx.agg(F.count("*").alias("n"), dbl(F.sum("amount")).alias("v"))
    rows = base.select(F.explode(F.array(
        F.struct(F.lit("transactions").alias("section"), F.lit("all").alias("name"), dbl("n").alias("value")),
        F.struct(F.lit("total_volume").alias("section"), F.lit("all").alias("name"), F.round("v", 2).alias("value")),
    )).alias("r")).select("r.*")
    tier = labels.groupBy(F.lit("accounts_by_tier").alias("section"), F.col("tier").alias("name")).agg(dbl(F.count("*")).alias("value"))
    kind = labels.where("label = 1").groupBy(F.lit("suspicious_by_typology").alias("section"), F.col("typology").alias("name")).agg(
        dbl(F.count("*")).alias("value"))
    return rows.unionByName(tier).unionByName(kind)
