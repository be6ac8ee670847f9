from __future__ import annotations

import math

from pyspark.sql import functions as F

from paytrace.functions.tails import chi_square_tail
from paytrace.operators import evaluate


def exact(x, k):
    """Closed forms for whole degrees of freedom."""
    y = x / 2
    if k % 2 == 0:
        return math.exp(-y) * math.fsum(math.exp(j * math.log(y) - math.lgamma(j + 1)) for j in range(k // 2))
    return math.erfc(math.sqrt(y)) + math.exp(-y) * math.fsum(math.exp((j + 0.5) * math.log(y) - math.lgamma(j + 1.5)) for j in range((k - 1) // 2))


def test_tail_equals_closed_forms(spark):
    cases = [(x, k) for k in (1, 2, 3, 4, 5, 9, 10, 63, 64, 200) for x in (1e-6, 0.1, 0.5, 1.0, 3.841458820694124, 9.21, 30.0, 63.5, 210.0, 400.0)]
    df = spark.createDataFrame(cases, "x double, k int")
    for r in df.select("x", "k", chi_square_tail(F.col("x"), F.col("k")).alias("p")).collect():
        assert abs(r.p - exact(r.x, r.k)) <= 1e-9 * max(exact(r.x, r.k), 1e-3), (r.x, r.k)
    rest = spark.createDataFrame([(0.0, 3), (None, 3)], "x double, k int").select(chi_square_tail(F.col("x"), F.col("k")).alias("p")).collect()
    assert [r.p for r in rest] == [1.0, None]


def test_two_groups_are_corrected_and_one_sided_tables_have_no_test(spark):
    rows = [("a", 0, i < 12) for i in range(40)] + [("b", 0, i < 3) for i in range(30)] + [("a", 1, True)] * 5
    got = evaluate.independence(spark.createDataFrame(rows, "g string, y int, alert boolean"), "g").first()
    e = 40 * 15 / 70
    stat = (abs(12 - e) - 0.5) ** 2 * (1 / e + 1 / (40 - e) + 1 / (15 - e) + 1 / (55 - (40 - e)))
    assert abs(got.chi_square - stat) < 1e-12 and abs(got.p_value - exact(stat, 1)) < 1e-10 and got.independent == (got.p_value > 0.05)
    none = evaluate.independence(spark.createDataFrame([(g, 0, False) for g in "abc"], "g string, y int, alert boolean"), "g").first()
    assert none.p_value is None and none.independent and none.chi_square == 0
