from __future__ import annotations

from datetime import datetime, timezone

import json

import pytest
from pyspark.sql import functions as F

from paytrace.operators import validate
from paytrace.sources import io

GOOD = dict(transaction_id="G", sender_id="A", receiver_id="B", amount="10", timestamp="2026-03-01T10:00:00Z")


def _read(spark, tmp_path, records):
    path = tmp_path / "in.json"
    path.write_text("\n".join(json.dumps(r) for r in records))
    raw = io.read_transfers(spark, str(path))
    return raw.withColumn("row_index", F.monotonically_increasing_id())


def _errors(spark, tmp_path, *changes):
    records = [{k: v for k, v in {**GOOD, "transaction_id": f"G{i}", **c}.items() if v != "absent"} for i, c in enumerate(changes)]
    checked = validate.check(_read(spark, tmp_path, records))
    return [r.error for r in checked.orderBy("row_index").collect()]


def test_each_fault_has_its_reason(spark, tmp_path):
    errors = _errors(
        spark, tmp_path, {}, dict(sender_id="absent", amount="absent"), dict(sender_id="  "), dict(receiver_id="A"),
        dict(amount="-50"), dict(amount="0"), dict(amount="NaN"), dict(amount="Infinity"), dict(amount="5e9"),
        dict(amount="abc"), dict(timestamp="not-a-date"), dict(timestamp="2026-13-01T10:00:00Z"), dict(receiver_id=" "))
    assert errors[0] is None
    assert errors[1] == "Missing required fields: sender_id, amount"
    assert errors[2].startswith("Invalid sender_id")
    assert errors[3] == "Self-transfer detected: sender_id equals receiver_id (A)"
    assert errors[4] == "Invalid amount: negative value (-50.0) is not permitted"
    assert errors[5] == "Invalid amount: zero-value transactions are invalid"
    assert errors[6] == "Invalid amount: NaN is strictly prohibited"
    assert errors[7] == "Invalid amount: infinite value detected"
    assert errors[8] == "Extreme amount: 5000000000.0 exceeds maximum allowed limit (1000000000.0)"
    assert errors[9] == "Invalid amount format: cannot parse 'abc' as numeric"
    assert errors[10] == "Invalid timestamp: 'not-a-date' cannot be parsed as a valid ISO-8601 or epoch date"
    assert errors[11].startswith("Invalid timestamp") and errors[12].startswith("Invalid receiver_id")


def test_duplicate_ids_register_only_valid_rows(spark, tmp_path):
    records = [dict(GOOD, amount="-1"), GOOD, GOOD, dict(GOOD, transaction_id="  "), dict(GOOD, transaction_id="  ")]
    checked = validate.check(_read(spark, tmp_path, records)).orderBy("row_index").collect()
    assert [r.error and r.error.split(":")[0] for r in checked] == [
        "Invalid amount", None, "Duplicate transaction_id detected", None, None]
    made = {r.transaction_id for r in checked[3:]}
    assert len(made) == 2 and all(m.startswith("TX_") for m in made)


def test_times_aliases_and_context(spark, tmp_path):
    records = [
        dict(tx_id="a", sender="A", receiver="B", amount="1.23456", timestamp="2026-03-01T10:00:00Z", location=" Zone\u0007-1 ", tx_type="nan"),
        dict(tx_id="b", sender="A", receiver="C", amount="1", timestamp="2026-03-01 10:00:00", device_id="x" * 80),
        dict(tx_id="c", sender="A", receiver="D", amount="1", timestamp=1772360000),
        dict(tx_id="d", sender="A", receiver="E", amount="1", timestamp="2026-03-01T16:00:00+06:00"),
    ]
    good, bad = validate.validate(_read(spark, tmp_path, records))
    rows = {r.transaction_id: r for r in good.collect()}
    assert bad.count() == 0 and set(rows) == set("abcd")
    assert rows["a"].t == rows["b"].t == rows["d"].t == 1772359200 and rows["c"].t == 1772360000
    assert rows["a"].timestamp == "2026-03-01T10:00:00+00:00"
    assert float(rows["a"].amount) == 1.2346 and rows["a"].location == "Zone-1" and rows["a"].tx_type is None
    assert len(rows["b"].device_id) == 64


def test_only_plain_numbers_are_amounts_and_only_numbers_are_epochs(spark, tmp_path):
    errors = _errors(
        spark, tmp_path, dict(amount="5d"), dict(amount="7f"), dict(amount="0x1p3"), dict(amount=True), dict(amount=[1]),
        dict(timestamp="1704067200"), dict(timestamp=True), dict(amount="1_000"), dict(amount=12.5), dict(timestamp=1704067200),
        dict(timestamp="20240101T000000"), dict(timestamp="2024-01-01T00:00:00,5"))
    assert [e.split(":")[0] if e else None for e in errors] == [
        *["Invalid amount format"] * 3, *["Invalid amount type"] * 2, *["Invalid timestamp"] * 2, *[None] * 5]
    assert errors[3] == "Invalid amount type: bool"


def test_broken_csv_lines_are_kept(spark, tmp_path):
    path = tmp_path / "in.csv"
    path.write_text("sender_id,receiver_id,amount,timestamp\nA,B,10,2024-01-01\nA,B,10\n")
    raw = io.read_transfers(spark, str(path), "csv").cache()
    assert io.malformed(raw).count() == 1


def test_booleans_numbers_and_strict_mode(spark):
    flags = spark.createDataFrame([("A", "B", True, "2026-03-01")], "sender_id string, receiver_id string, amount boolean, timestamp string")
    assert validate.check(flags).first().error == "Invalid amount type: bool"
    timed = spark.createDataFrame([("A", "B", 1.0, True)], "sender_id string, receiver_id string, amount double, timestamp boolean")
    assert validate.check(timed).first().error.startswith("Invalid timestamp")
    ids = spark.createDataFrame([(1, 2, 5.0, 1772360000)], "sender_id int, receiver_id int, amount double, timestamp bigint")
    assert validate.valid(validate.check(ids)).first().sender_id == "1"
    with pytest.raises(validate.TransferValidationError, match="Invalid amount"):
        validate.validate(flags, strict=True)
    with pytest.raises(validate.TransferValidationError, match="Empty dataset"):
        validate.validate(flags.limit(0), strict=True)
    row = validate.summary(validate.check(ids)).first()
    assert (row.total_processed, row.valid_count, row.invalid_count, row.is_valid) == (1, 1, 0, True)


def test_corrupt_records_and_payload_and_metrics(spark, tmp_path):
    path = tmp_path / "bad.json"
    path.write_text(json.dumps(GOOD) + "\n{not json\n")
    raw = io.read_transfers(spark, str(path)).cache()
    assert io.malformed(raw).count() == 1
    assert io.read_risk_areas(spark, str(tmp_path / "none.json")).count() == 0
    (tmp_path / "areas.json").write_text(json.dumps({"risk_areas": ["Zone-13", "Zone-14"]}, indent=2))
    assert {r.area for r in io.read_risk_areas(spark, str(tmp_path / "areas.json")).collect()} == {"Zone-13", "Zone-14"}
    reports = spark.createDataFrame([("A", "HIGH", 75.0), ("B", "LOW", 1.0)], "account_id string, risk_level string, risk_score double")
    io.write_payload(reports, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).where("risk_level = 'HIGH'").first().account_id == "A"
    numbers = spark.createDataFrame([(0.5, 2)], "precision double, alerts int")
    io.publish_metrics(numbers, str(tmp_path / "m"), "rules", "2026-01-01")
    io.publish_metrics(numbers.selectExpr("precision + 0.1 AS precision", "alerts"), str(tmp_path / "m"), "rules", "2026-01-02")
    latest = {r.metric: r.value for r in io.latest_metrics(spark, str(tmp_path / "m")).collect()}
    assert latest == {"precision": 0.6, "alerts": 2.0} and spark.read.parquet(str(tmp_path / "m")).count() == 4


def test_every_iso_form(spark):
    """The forms that the standard library reads, naive ones in UTC; what it rejects is rejected."""
    texts = [
        "2024-01-01", "20240101", "2024-W01-1", "2024W011", "2024-W01", "2020-W53-7", "2021-W53-1", "2024-W00-1", "2024-W01-8", "2024-01-01T10", "2024-01-01 10",
        "20240101T000000Z", "20240101T000000+0600", "20240101T1015", "2024-W10-3T101530.25+05:30", "2024-01-01T10:15+06", "2024-01-01T10:15:30,123456789Z",
        "2024-01-01T10:15:30.5", "2024-01-01T101530-0330", "2024-01-01x10:15", "2024-01-01T1", "2024-01-01T10:1", "2024-13-01", "20241301", "2024-01-01T25:00",
        "2024-1-1", "2024-01-01T10:15:30+0", "20240101T10:15", "2024-02-30T10", "1704067200", "2024-01-01T10-05:00", "2024-01-01T10Z",
    ]
    def read(text):
        try:
            found = datetime.fromisoformat(text[:-1] + "+00:00" if text.endswith("Z") else text)
        except ValueError:
            return None
        return (found if found.tzinfo else found.replace(tzinfo=timezone.utc)).timestamp()
    df = spark.createDataFrame([(t,) for t in texts], "timestamp string")
    got = {r.timestamp: r.s for r in df.select("timestamp", (F.unix_micros(validate.parse_time(df)) / 1e6).alias("s")).collect()}
    assert {t: got[t] for t in texts} == {t: read(t) for t in texts}


def test_payload_reads_the_line_items_once(spark):
    """Metrics read the payload several times; the join below it is not run again for each."""
    from paytrace.plans import records

    rows = records._payload(spark, "/root/testdata/sf0.001")
    assert rows.count() > 0 and not [f for f in rows.inputFiles() if "lineitem" in f or "orders" in f]
