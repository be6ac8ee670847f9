"""The same measures on a stream of transfers (Structured Streaming).

Streams hold transaction_id, sender_id, receiver_id, amount, t, location, device_id and ``ts`` (event
time). Results of a batch are written under its batch id, so a batch that is run again after a failure
replaces its own output.
"""

from __future__ import annotations

import contextlib
import statistics
import uuid
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from ..functions import fixed
from ..functions.exprs import bucket, postings
from ..sources import views
from ..sources.session import shared_folder
from .daily import DailyStore

HORIZON = "2 days"
RETENTION = 400 * fixed.DAY  # a sender that was silent for so long is forgotten
ROWS_A_FILE = 250_000  # of a part of the stream
STATE_STORE = "spark.sql.streaming.stateStore.providerClass"


def read_events(spark: SparkSession, folder: str, files: int = 4) -> DataFrame:
    """The events table as a stream of transfers with event time, one part of ``files`` a batch, in time order.

    Each part is as many files as its rows ask for, which all cores write and read; an empty file fills up a part that has fewer.
    """
    events = spark.read.parquet(f"{folder}/events.parquet")
    place = f"{_place(spark)}/arrivals"
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    facts = events.agg(F.percentile_approx(at, [i / files for i in range(1, files)], 1000).alias("cuts"), F.count("*").alias("rows")).first()
    cuts, pieces = facts["cuts"] or [], max(1, -(-facts["rows"] // (files * ROWS_A_FILE)))
    written = spark.read.schema(events.schema).parquet
    for number, (low, high) in enumerate(zip([None, *cuts], [*cuts, None]), 1):
        part = events.where((F.lit(True) if low is None else at > low) & (F.lit(True) if high is None else at <= high))
        part.repartition(pieces).write.mode("append").parquet(place)  # files are read in the order in which parts were written
        for _ in range(number * pieces - len(written(place).inputFiles())):
            events.limit(0).coalesce(1).write.mode("append").parquet(place)
    source = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", pieces).parquet(place)
    return with_time(spark.sql(views.TX_EVENTS, events=source)).where("sender_id <> receiver_id")


def with_time(tx: DataFrame) -> DataFrame:
    return tx.withColumn("ts", F.timestamp_seconds("t"))


def _run(stream: DataFrame, batch: Callable[[DataFrame, int], None], place: str, mode: str = "append") -> None:
    """Runs a stream over everything that is there and waits for it."""
    stream.writeStream.outputMode(mode).option("checkpointLocation", f"{place}/progress").trigger(
        availableNow=True).foreachBatch(batch).start().awaitTermination()


def _place(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/streams/{uuid.uuid4().hex}"


# ----------------------------------------------------------------------- micro-batch re-scoring
def grow_store(stream: DataFrame, kept: DailyStore, place: str) -> DailyStore:
    """Feeds every micro-batch of transfers to the store; a batch that is run again replaces its own sums."""
    _run(stream, kept.add, place)
    return kept


def score_batches(stream: DataFrame, kept: DailyStore, score: Callable[[DataFrame], DataFrame], path: str) -> DataFrame:
    """Grows the store batch by batch and re-scores the accounts of its most recent day after each: results per ``batch``."""
    def batch(df: DataFrame, number: int) -> None:
        kept.add(df, number)
        score(kept.features(kept.latest_day())).write.mode("overwrite").parquet(f"{path}/scores/batch={number}")

    _run(stream, batch, path)
    return stream.sparkSession.read.parquet(f"{path}/scores")


def daily_store_of_table(spark: SparkSession, folder: str) -> DailyStore:
    place = _place(spark)
    return grow_store(read_events(spark, folder), DailyStore(spark, f"{place}/store"), place)


# ---------------------------------------------------------------------------- tumbling counts
def tumbling_counts(stream: DataFrame, path: str, horizon: str = HORIZON) -> DataFrame:
    """Busiest clock hour and most counterparties in a two-hour bucket, kept up to date per account.

    Each (account, counterparty, direction, bucket) passes the stream once, so adding up the counts of
    all batches gives exact distinct counts without holding sets; state older than ``horizon`` is dropped.
    """
    spark = stream.sparkSession
    sides = postings(stream.select("sender_id", "receiver_id", "t", "ts"))

    def hours(df: DataFrame, number: int) -> None:
        df.groupBy("account_id", bucket("t", fixed.HOUR).alias("hour")).agg(F.count("*").alias("c")).write.mode(
            "overwrite").parquet(f"{path}/hours/batch={number}")

    _run(sides, hours, f"{path}/h")
    # The end of the bucket is the event time, so state is dropped once a whole bucket is past.
    slots = sides.withColumn("ts", F.timestamp_seconds((bucket("t", fixed.TWO_HOURS) + 1) * fixed.TWO_HOURS)).withWatermark(
        "ts", horizon).dropDuplicates(["account_id", "counterparty", "is_out", "ts"])

    def distinct(df: DataFrame, number: int) -> None:
        df.groupBy("account_id", bucket("t", fixed.TWO_HOURS).alias("slot")).agg(
            F.count_if(~F.col("is_out")).alias("senders"), F.count_if("is_out").alias("receivers")).write.mode(
            "overwrite").parquet(f"{path}/slots/batch={number}")

    _run(slots, distinct, f"{path}/s")
    per_hour = spark.read.parquet(f"{path}/hours").groupBy("account_id", "hour").agg(F.sum("c").alias("c")).groupBy(
        "account_id").agg(F.max("c").alias("max_tx_per_hour"))
    per_slot = spark.read.parquet(f"{path}/slots").groupBy("account_id", "slot").agg(
        F.sum("senders").alias("s"), F.sum("receivers").alias("r")).groupBy("account_id").agg(
        F.max("s").alias("max_senders_2h"), F.max("r").alias("max_receivers_2h"))
    return per_hour.join(per_slot, "account_id")


def tumbling_counts_of_table(spark: SparkSession, folder: str) -> DataFrame:
    return tumbling_counts(read_events(spark, folder), _place(spark))


# ------------------------------------------------------------------------------ takeover trigger
@contextlib.contextmanager
def _large_state(spark: SparkSession):
    """State outside of the heap, which keyed maps and timers need, for the queries started inside."""
    was = spark.conf.get(STATE_STORE, None)
    spark.conf.set(STATE_STORE, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.unset(STATE_STORE) if was is None else spark.conf.set(STATE_STORE, was)


ALERT = "account_id string, first_seen bigint, risk_area string, outflow_24h double, transactions bigint, signal_score int, step bigint"


NO_EPISODE = dict(open=False, start=0, area="", first=0, handset=False, out=0.0, fresh=0.0, n=0, typical=0.0)
HEAD = ("rows bigint, located bigint, last bigint, open boolean, start bigint, area string, first bigint, handset boolean, "
        "out double, fresh double, n bigint, typical double")
HELD = "number bigint, receiver string, amount double, t bigint, location string, device string"


class _Known:
    """A map of the state store, read once per key and call; changes are written when the call ends."""

    def __init__(self, store):
        self.store, self.read, self.changed = store, {}, {}

    def get(self, key, default=None):
        if key not in self.read:
            self.read[key] = self.store.getValue((key,))[0] if self.store.containsKey((key,)) else default
        return default if self.read[key] is None else self.read[key]

    def put(self, key, value) -> None:
        self.read[key] = self.changed[key] = value

    def flush(self) -> None:
        for key, value in self.changed.items():
            self.store.updateValue((key,), (value,))


class TakeoverProcessor(StatefulProcessor):
    """One sender's baseline and open episode, kept in the state store.

    The baseline is a map per area, device, receiver and day, so a row reads and writes the few entries it touches. Payments of an
    open episode are held until it ends. A timer closes an episode whose day has passed, another drops a sender that was
    silent for ``retention`` seconds.
    """

    def __init__(self, areas: frozenset, episode: int, min_history: int, usual_share: float, drain_multiple: float, drain_min: float, retention: int):
        self.risky, self.episode, self.min_history, self.usual_share = areas, episode, min_history, usual_share
        self.drain_multiple, self.drain_min, self.retention = drain_multiple, drain_min, retention

    def init(self, handle) -> None:
        self.handle = handle
        self.head = handle.getValueState("head", HEAD)
        self.held = handle.getListState("held", HELD)
        self.stores = {
            "areas": handle.getMapState("areas", "area string", "n bigint"), "devices": handle.getMapState("devices", "device string", "n bigint"),
            "paid": handle.getMapState("paid", "receiver string", "number bigint"), "days": handle.getMapState("days", "day bigint", "paid double")}

    def _opened(self) -> tuple[dict, dict[str, _Known]]:
        names = [c.split()[0] for c in HEAD.split(", ")]
        head = dict(zip(names, self.head.get())) if self.head.exists() else dict(rows=0, located=0, last=0, **NO_EPISODE)
        return head, {name: _Known(store) for name, store in self.stores.items()}

    def _learn(self, head: dict, known: dict[str, _Known], receiver: str, amount: float, t: int, location, device, number: int) -> None:
        if location:
            known["areas"].put(location, known["areas"].get(location, 0) + 1)
            head["located"] += 1
        if device:
            known["devices"].put(device, 1)
        if known["paid"].get(receiver) is None:
            known["paid"].put(receiver, number)
        known["days"].put(t // 86400, known["days"].get(t // 86400, 0.0) + amount)

    def _points(self, head: dict) -> int:
        drain = head["out"] >= max(self.drain_multiple * head["typical"], self.drain_min)
        strangers = head["out"] > 0 and head["fresh"] / head["out"] >= 0.5
        return 15 + 15 * head["handset"] + 15 * drain + 10 * strangers

    def _close(self, head: dict, known: dict[str, _Known], held: list[tuple]) -> None:
        """An episode that never reached the alert score joins the baseline after all."""
        if self._points(head) < 30:
            for number, receiver, amount, t, location, device in held:
                self._learn(head, known, receiver, amount, t, location, device, number)
        held.clear()
        head.update(NO_EPISODE)

    def _saved(self, head: dict, known: dict[str, _Known], held: list[tuple]) -> None:
        for part in known.values():
            part.flush()
        if held:
            self.held.put(held)
        else:
            self.held.clear()
        self.head.update(tuple(head.values()))

    def _usual_days(self, days: _Known) -> list[float]:
        days.flush()
        return [value for (value,) in self.stores["days"].values()]

    def handleInputRows(self, key, rows, timerValues):
        head, known = self._opened()
        held = [tuple(r) for r in self.held.get()] if head["open"] else []
        began, updates = head["start"] if head["open"] else None, {}
        batch = pd.concat(list(rows)).sort_values(["t", "receiver_id", "amount", "transaction_id"])  # one sender's rows of a batch
        for row in batch.itertuples(index=False):
            number, head["rows"] = head["rows"], head["rows"] + 1
            head["last"] = max(head["last"], int(row.t))
            location, device = row.location or None, row.device_id or None
            if head["open"] and row.t > head["start"] + self.episode:
                self._close(head, known, held)
            risky = location in self.risky
            if not head["open"] and risky and head["located"] >= self.min_history and (
                    known["areas"].get(location, 0) / head["located"] < self.usual_share):
                seen = self.stores["devices"].keys() if device else ()
                handset = bool(device) and known["devices"].get(device) is None and (bool(known["devices"].changed) or any(True for _ in seen))
                usual = self._usual_days(known["days"])
                head.update(open=True, start=int(row.t), area=location, first=number, handset=handset, out=0.0, fresh=0.0, n=0,
                            typical=float(statistics.median(usual)) if usual else 0.0)
            if head["open"] and risky:
                if location == head["area"]:
                    head["n"] += 1
                    head["out"] += row.amount
                    if known["paid"].get(row.receiver_id, number) >= head["first"]:
                        head["fresh"] += row.amount
                    updates[head["start"]] = (key[0], head["start"], head["area"], round(head["out"], 2), head["n"], self._points(head), head["rows"])
                held.append((number, row.receiver_id, float(row.amount), int(row.t), location, device))
            else:
                self._learn(head, known, row.receiver_id, float(row.amount), int(row.t), location, device, number)
        self._saved(head, known, held)
        self.handle.registerTimer((head["last"] + self.retention) * 1000)
        if head["open"] and head["start"] != began:
            self.handle.registerTimer((head["start"] + self.episode + 1) * 1000)
        yield pd.DataFrame(list(updates.values()), columns=[c.split()[0] for c in ALERT.split(", ")])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        now = expiredTimerInfo.getExpiryTimeInMs() // 1000
        head, known = self._opened()
        if head["open"] and now > head["start"] + self.episode:
            held = [tuple(r) for r in self.held.get()]
            self._close(head, known, held)
            self._saved(head, known, held)
        if self.head.exists() and now >= head["last"] + self.retention:
            for state in (self.head, self.held, *self.stores.values()):
                state.clear()
        yield pd.DataFrame([], columns=[c.split()[0] for c in ALERT.split(", ")])

    def close(self) -> None:
        pass


def takeover_updates(stream: DataFrame, areas, episode: int = fixed.DAY, min_history: int = 3, usual_share: float = 0.10,
                     drain_multiple: float = 3.0, drain_min: float = 5000.0, horizon: str = HORIZON, retention: int = RETENTION) -> DataFrame:
    """Episodes of risk-area activity as they develop: one row per episode and batch that touches it.

    The latest row of an episode holds its score so far; 30 or more is an alert. ``areas`` is the
    configured list. Rows of one sender must arrive in time order across batches, at most ``horizon`` late.
    """
    step = TakeoverProcessor(frozenset(areas), episode, min_history, usual_share, drain_multiple, drain_min, retention)
    use = stream.withWatermark("ts", horizon).select(
        "sender_id", "receiver_id", F.col("amount").cast("double").alias("amount"), "t", "location", "device_id", "transaction_id", "ts")
    return use.groupBy("sender_id").transformWithStateInPandas(step, ALERT, "append", "EventTime")


def takeover_alerts(stream: DataFrame, areas, path: str, **settings) -> DataFrame:
    """Runs ``takeover_updates`` and returns the alerts: the latest state of each episode at 30 or more."""
    def batch(df: DataFrame, number: int) -> None:
        df.write.mode("overwrite").parquet(f"{path}/updates/batch={number}")

    with _large_state(stream.sparkSession):
        _run(takeover_updates(stream, areas, **settings), batch, path)
    updates = stream.sparkSession.read.parquet(f"{path}/updates")
    last = F.max(F.struct("step", "risk_area", "outflow_24h", "transactions", "signal_score")).alias("l")
    return updates.groupBy("account_id", "first_seen").agg(last).select("account_id", "first_seen", "l.*").drop("step").where(
        "signal_score >= 30")


def takeover_of_table(spark: SparkSession, folder: str) -> DataFrame:
    return takeover_alerts(read_events(spark, folder), ("Zone-13", "Zone-14"), _place(spark))


# ------------------------------------------------------------------------------------ duplicates
def deduplicated(stream: DataFrame, horizon: str = HORIZON) -> DataFrame:
    """The first transfer per id within the horizon."""
    return stream.withWatermark("ts", horizon).dropDuplicatesWithinWatermark(["transaction_id"])


def deduplicated_table(spark: SparkSession, folder: str) -> DataFrame:
    """The events, each delivered twice, without the second copies."""
    twice = read_events(spark, folder).withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2))))
    path = _place(spark)

    def batch(df: DataFrame, number: int) -> None:
        df.select("transaction_id", "t").write.mode("overwrite").parquet(f"{path}/out/batch={number}")

    _run(deduplicated(twice), batch, path)
    return spark.read.parquet(f"{path}/out").select("transaction_id", "t")
