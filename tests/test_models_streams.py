from __future__ import annotations

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

import __spark_entry__ as entry
from paytrace.functions import fixed
from paytrace.operators import behaviour, context, models, store
from paytrace.plans import pipeline
from paytrace.sources import views
from paytrace.streaming import daily as stream_daily
from paytrace.streaming import stream

SF = "/root/testdata/sf0.001"


def _points(spark, n=300):
    rng = random.Random(4)
    rows = [(f"A{i:04d}", rng.gauss(0, 1), rng.gauss(5, 2), 0.0, 0) for i in range(n)] + [("OUT", 40.0, -30.0, 9.0, 1)]
    return spark.createDataFrame(rows, "account_id string, a double, b double, c double, label int")


def test_isolation_forest_ranks_the_outlier_last_and_repeats(spark):
    df = _points(spark)
    one = models.IsolationForest(("a", "b", "c"), trees=40).fit(df)
    scores = {r.account_id: r.raw_score for r in one.decision(df).collect()}
    assert min(scores, key=scores.get) == "OUT" and scores["OUT"] < 0
    below = sum(s < 0 for s in scores.values())
    assert 0.08 * len(scores) <= below <= 0.12 * len(scores)
    again = models.IsolationForest(("a", "b", "c"), trees=40).fit(df.repartition(7))
    assert {r.account_id: r.raw_score for r in again.decision(df).collect()} == scores


def test_classifier_saves_loads_and_explains(spark, tmp_path):
    df = _points(spark).withColumn("label", (F.col("a") > 0.5).cast("int"))
    model = models.with_best_threshold(models.fit_boosting(df, columns=("a", "b", "c"), iterations=5), df)
    model.save(str(tmp_path / "model"))
    back = models.load_classifier(str(tmp_path / "model"))
    assert back.columns == ("a", "b", "c") and back.threshold == model.threshold
    scored = back.score(df.drop("c"))
    assert scored.where("label = 1").agg(F.min("probability")).first()[0] > scored.where("label = 0").agg(F.max("probability")).first()[0]
    why = models.drivers(back, df, df.where("account_id = 'OUT'")).orderBy("place").collect()
    assert why[0].feature == "a" and why[0].contribution > 0 and why[0].label == "a"


def test_takeover_stream_agrees_with_the_batch_detector(spark):
    areas = ("Zone-13", "Zone-14")
    batch, _ = context.location_takeover(views.tx_events(spark, SF), spark.createDataFrame([(a,) for a in areas], "area string"))
    want = {(r.account_id, r.first_seen, r.outflow_24h, r.transactions, r.signal_score) for r in batch.collect()}
    got = {(r.account_id, r.first_seen, r.outflow_24h, r.transactions, r.signal_score) for r in stream.takeover_of_table(spark, SF).collect()}
    assert got == want and want


def test_stream_drops_second_copies(spark):
    assert stream.deduplicated_table(spark, SF).count() == views.tx_events(spark, SF).count()


def test_entry_points(spark):
    queries, oracles = entry.queries(), entry.oracle_sql()
    assert set(oracles) <= set(queries) and len(oracles) > 130
    assert entry.entry(spark).count() > 0


def test_draws_do_not_vanish_at_scale():
    for n in (100, 10**6, 10**9, 10**12):
        limit = models.draw_limit(512, n)
        share = (limit + (1 << 63)) / (1 << 64)
        assert abs(share - min(1, 512 / n)) <= 1e-9 * share


def test_takeover_state_expires(spark, tmp_path):
    """Silent senders are forgotten: the same rows give an alert with a long retention and none with a short one."""
    day = 86_400
    usual = [(f"T{k}", "S", f"R{k % 3}", 100.0, k * day, "Home", "D1") for k in range(6)]
    late = [("T90", "OTHER", "X", 50.0, 40 * day, "Home", "D9"), ("T91", "OTHER", "X", 50.0, 41 * day, "Home", "D9")]
    theft = [("T7", "S", "NEW", 9000.0, 44 * day, "Zone-13", "D2"), ("T8", "S", "NEW2", 9000.0, 44 * day + 60, "Zone-13", "D2")]
    schema = "transaction_id string, sender_id string, receiver_id string, amount double, t bigint, location string, device_id string"
    for k, rows in enumerate((usual, late[:1], late[1:], theft)):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    found = []
    for retention in (400 * day, 20 * day):
        source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        alerts = stream.takeover_alerts(stream.with_time(source), ("Zone-13",), str(tmp_path / f"run{retention}"), retention=retention)
        found.append([(r.account_id, r.first_seen, r.outflow_24h, r.transactions) for r in alerts.collect()])
    assert found == [[("S", 44 * day, 18000.0, 2)], []]


def test_parts_of_the_stream_are_several_files_each(spark, tmp_path, monkeypatch):
    """A batch is one part, in time order, and no part is left to one task; parts with too few rows are filled up with empty files."""
    monkeypatch.setattr(stream, "ROWS_A_FILE", 10)
    start = datetime(2024, 1, 1)
    for name, hours in (("spread", range(120)), ("one_time", [7] * 100 + [90] * 2)):
        rows = [(k, start + timedelta(hours=h), k % 9, "click", 5.0 + k, '{"k": 3}') for k, h in enumerate(hours)]
        spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double, props string").write.parquet(
            str(tmp_path / name / "events.parquet"))
        got, files = [], []

        def batch(df, number):
            got.append(sorted(r.t for r in df.select("t").collect()))
            files.append(df.select("transaction_id", F.input_file_name().alias("f")).select("f").distinct().count())

        stream._run(stream.read_events(spark, str(tmp_path / name), files=3), batch, str(tmp_path / f"run_{name}"))
        want = views.tx_events(spark, str(tmp_path / name))
        assert len(got) <= 3 and sum(got, []) == sorted(r.t for r in want.select("t").collect())
        assert max(files) == 4


def test_daily_store_equals_the_batch_features_and_replaces_repeated_batches(spark, tmp_path):
    tx = views.tx_events(spark, SF)
    kept = stream.DailyStore(spark, str(tmp_path / "store"))
    scores = stream.score_batches(stream.read_events(spark, SF, files=3), kept, lambda f: f.select("account_id", "total_incoming"), str(tmp_path / "run"))
    want = {r.account_id: r for r in store.transactional(*behaviour.inputs(tx)).collect()}
    for _ in range(2):
        got = {r.account_id: r for r in kept.features().collect()}
        assert set(got) == set(want)
        assert all(abs(got[a][c] - want[a][c]) <= 1e-9 * max(1, abs(want[a][c])) for a in want for c in fixed.TRANSACTIONAL)
        # a batch that is delivered again after a failure
        slots = sorted(int(p.name.split("=")[1]) for p in (tmp_path / "store" / "sums").iterdir() if p.name.startswith("batch="))
        assert slots == [0, 1, 2]
        last = tx.select(F.max("t")).first()[0]
        again = [r.t for r in kept._read("sums", stream_daily.SUMS, None).where("batch = 2").agg(F.min("first_t").alias("t")).collect()][0]
        kept.add(tx.where((F.col("t") >= again) & (F.col("t") <= last)), 2)
    day = kept.latest_day()
    today = {r.account_id: r.total_incoming for r in store.transactional(*behaviour.inputs(pipeline.recent_day(tx))).collect()}
    assert {r.account_id: r.total_incoming for r in kept.features(day).collect()} == today
    assert {r.account_id: r.total_incoming for r in scores.where("batch = 2").collect()} == today
