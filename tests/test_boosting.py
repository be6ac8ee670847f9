"""Leaf-wise boosting against a plain twin that grows one tree after another in memory."""

from __future__ import annotations

import random

import numpy as np
from pyspark.sql import functions as F

from paytrace.operators import boosting, models


def table(spark, n=700, seed=3):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        a, b, c = rng.gauss(0, 1), rng.randrange(6), rng.random()
        y = int(a * a + (b == 3) * 2 + rng.gauss(0, 0.5) > 2)
        rows.append((f"A{i:04d}", a, float(b), None if i % 50 == 0 else c, 5.0, rng.choice(["x", "y", None]), y))
    return spark.createDataFrame(rows, "account_id string, a double, b double, c double, d double, typology string, label int")


def twin(bins, y, rounds, step=0.06, leaves=31, l2=1.0, least=20):
    """Best leaf first, every cut of every feature tried on the rows themselves."""
    base = float(np.log(y.mean() / (1 - y.mean())))
    raw, shapes = np.full(len(y), base), []

    def best(rows, g, h):
        found = (0.0, None)
        whole = g[rows].sum() ** 2 / (h[rows].sum() + l2)
        for f in range(bins.shape[1]):
            for cut in np.unique(bins[rows, f])[:-1]:
                low, high = rows[bins[rows, f] <= cut], rows[bins[rows, f] > cut]
                if min(len(low), len(high)) >= least and min(h[low].sum(), h[high].sum()) >= 1e-3:
                    gain = g[low].sum() ** 2 / (h[low].sum() + l2) + g[high].sum() ** 2 / (h[high].sum() + l2) - whole
                    if gain > found[0] * (1 + 1e-9) + 1e-12:
                        found = (gain, (f, int(cut), low, high))
        return found

    for _ in range(rounds):
        p = 1 / (1 + np.exp(-raw))
        g, h = p - y, p * (1 - p)
        everyone = np.arange(len(y))
        open_, splits = [(everyone, best(everyone, g, h))], []
        while len(open_) < leaves:
            at = max(range(len(open_)), key=lambda i: (open_[i][1][0], -i))
            if open_[at][1][1] is None:
                break
            f, cut, low, high = open_.pop(at)[1][1]
            splits.append((f, cut))
            open_ += [(low, best(low, g, h)), (high, best(high, g, h))]
        for rows, _ in open_:
            raw[rows] += -step * g[rows].sum() / (h[rows].sum() + l2)
        shapes.append((len(open_), sorted(splits)))
    return base, raw, shapes


def matrix(df, columns):
    rows = df.orderBy("account_id").collect()
    return np.array([[r[c] or 0.0 for c in columns] for r in rows], float), np.array([r["label"] for r in rows])


def test_trees_equal_the_twin(spark):
    columns = ("a", "b", "c", "d")
    for df in (table(spark).coalesce(1), table(spark).repartition(3)):
        model = boosting.fit(df, columns=columns, iterations=12)
        values, y = matrix(df, columns)
        bins = np.column_stack([np.searchsorted(model.cuts[i], values[:, i], "left") for i in range(4)])
        base, raw, shapes = twin(bins, y, 12)
        got = [(sum(f < 0 for f in t.feature), sorted((f, c) for f, c in zip(t.feature, t.cut) if f >= 0)) for t in model.trees]
        assert abs(model.base - base) < 1e-12 and got == shapes and shapes[0][0] > 4
        assert np.allclose(model.probability(values), 1 / (1 + np.exp(-raw)), atol=1e-12)
        scored = np.array([r.p for r in model.score(df, "p").orderBy("account_id").collect()])
        assert np.allclose(scored, model.probability(values), atol=1e-15)


def test_models_fitted_together_equal_models_fitted_alone(spark):
    df = table(spark, 500, 5).coalesce(2)
    wanted = [(("a", "b"), None), (("b", "c", "a"), ~F.col("typology").eqNullSafe("x")), (("d",), None), (("a",), F.lit(False))]
    together = boosting.fit_many(df, wanted, iterations=6, leaves=9)
    for (columns, rows), model in zip(wanted[:2], together):
        alone = boosting.fit(df if rows is None else df.where(rows), columns=columns, iterations=6, leaves=9)
        values, _ = matrix(df, columns)
        assert model.columns == columns
        if rows is None:
            assert [vars(t) for t in model.trees] == [vars(t) for t in alone.trees]
    assert all(t.feature == [-1] for t in together[2].trees) and together[3].trees == []
    assert all(sum(f < 0 for f in t.feature) <= 9 for t in together[0].trees)


def test_experiments_share_a_fit(spark):
    train, test = table(spark, 500, 6), table(spark, 300, 7)
    found = {r.typology: r for r in models.leave_one_out(train, test, ("x", "y"), columns=("a", "b"), iterations=8).collect()}
    assert set(found) == {"x", "y"} and all(0.6 < r.pr_auc <= 1 for r in found.values())


def test_replaced_columns_score_as_whole_rows_do(spark):
    columns = ("a", "b", "c", "d")
    model = boosting.fit(table(spark).repartition(3), columns=columns, iterations=8)  # few rows of three partitions: no job per pass
    own, _ = matrix(table(spark, 200, 11), columns)
    given = own[::-1].copy()
    for at, got in zip([0, 1, 2, 3, None], model.probabilities_replaced(own, given, [0, 1, 2, 3, None])):
        values = own.copy()
        if at is not None:
            values[:, at] = given[:, at]
        assert (got == model.probability(values)).all()


def test_few_rows_of_several_partitions_give_the_trees_of_added_up_passes(spark, monkeypatch):
    df = table(spark, 400, 9).repartition(3)
    wanted = [(("a", "b"), None), (("b", "c"), ~F.col("typology").eqNullSafe("x"))]
    near = boosting.fit_many(df, wanted, iterations=3, leaves=6)
    monkeypatch.setattr(boosting, "ALONE_ROWS", 0)
    far = boosting.fit_many(df, wanted, iterations=3, leaves=6)
    for one, other in zip(near, far):
        assert [t.feature for t in one.trees] == [t.feature for t in other.trees] and [t.cut for t in one.trees] == [t.cut for t in other.trees]


def test_a_table_of_more_than_32768_rows_takes_few_jobs(spark):
    """Before, every level of every tree was a job: 300 trees over 54,000 accounts took over an hour."""
    rows = spark.range(40_000).select(*[(F.pmod(F.xxhash64("id", F.lit(i)), F.lit(1000)) / 1000).alias(f"c{i}") for i in range(3)])
    rows = rows.withColumn("label", (F.col("c0") + F.col("c1") * F.col("c2") > 0.7).cast("int")).repartition(4)
    spark.sparkContext.setJobGroup("boosting of 40,000 rows", "")
    model = boosting.fit(rows, columns=("c0", "c1", "c2"), iterations=12)
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("boosting of 40,000 rows"))
    spark.sparkContext.setJobGroup("", "")
    scored = model.score(rows).select(((F.col("probability") > 0.5) == (F.col("label") == 1)).cast("int").alias("right"))
    assert len(model.trees) == 12 and jobs < 12 and scored.agg(F.avg("right")).first()[0] > 0.9


def test_sums_of_the_larger_child_from_its_parent_give_the_same_trees(spark, monkeypatch):
    rows = spark.range(3_000).select(*[(F.pmod(F.xxhash64("id", F.lit(i)), F.lit(300)) / 300).alias(f"c{i}") for i in range(4)])
    rows = rows.withColumn("label", (F.col("c0") + F.col("c1") * F.col("c2") > 0.7).cast("int")).coalesce(1)
    found = []
    for limit in (10**9, 0):
        # the limit is read where the trees are grown, in this process
        monkeypatch.setattr(boosting, "SUMS_ROWS", limit)
        table = rows.toPandas()
        columns = ["c0", "c1", "c2", "c3"]
        cuts = [np.unique(np.quantile(table[c], np.arange(1, 255) / 255)) for c in columns]
        bins = boosting._binned(table[columns].to_numpy(), cuts)
        row = dict(rows=len(bins), bins=bins.tobytes(), y=table["label"].to_numpy(np.uint8).tobytes(), use=bytes([1] * len(bins)), scores=b"", number=0, model=0)
        batch = boosting.pa.RecordBatch.from_pylist([row])
        told = next(boosting._locally(iter([batch]), np.array([-0.5]), [{0, 1, 2, 3}], 20, 31, 0.1, 1.0, 20, 256))
        found.append([boosting.json.loads(t) for t in told.column(2).to_pylist()])
    for a, b in zip(*found):
        assert all(a[k] == b[k] for k in ("feature", "cut", "left", "right")) and np.allclose(a["value"], b["value"], rtol=1e-9)
