"""An account store that grows with a stream: mergeable sums per account and day.

Each micro-batch leaves its own partial sums, in folders named after its number and day, so a batch that is run again replaces what it
left before. Features are finished from the merged sums of all days or of the latest one, which reads that day's folders only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.exprs import bucket, dbl, near_threshold, postings, sub_threshold
from ..operators import behaviour, graph, store

SUMS = ("account_id string, n bigint, sent bigint, received bigint, total_in decimal(38,4), total_out decimal(38,4), largest decimal(18,4), "
        "mean double, squares double, near_out bigint, near_in bigint, sub bigint, rounded bigint, night bigint, first_t bigint, last_t bigint, "
        "batch bigint, day bigint")
PAIRS = "account_id string, counterparty string, sent bigint, received bigint, batch bigint, day bigint"


class DailyStore:
    """Partial sums below ``path``. ``add`` takes a micro-batch of transfers, ``features`` finishes the account features."""

    def __init__(self, spark: SparkSession, path: str, threshold=fixed.REPORTING_THRESHOLD):
        self.spark, self.path, self.threshold = spark, path, threshold

    def add(self, tx: DataFrame, batch: int) -> None:
        """Writes the partial sums of a batch in place of any that an earlier attempt at it has left."""
        out, amount = F.col("is_out"), F.col("amount")
        near = near_threshold(amount, self.threshold)
        sides = postings(tx.select("sender_id", "receiver_id", "amount", "t")).withColumn("day", bucket("t", fixed.DAY))
        sums = sides.groupBy("account_id", "day").agg(
            F.count("*").alias("n"), F.count_if(out).alias("sent"), F.count_if(~out).alias("received"),
            F.sum(F.when(~out, amount)).cast("decimal(38,4)").alias("total_in"), F.sum(F.when(out, amount)).cast("decimal(38,4)").alias("total_out"),
            F.max("amount").cast("decimal(18,4)").alias("largest"), F.avg(dbl("amount")).alias("mean"),
            (F.var_pop(dbl("amount")) * F.count("*")).alias("squares"), F.count_if(near & out).alias("near_out"), F.count_if(near & ~out).alias("near_in"),
            F.count_if(sub_threshold(amount, self.threshold)).alias("sub"),
            F.count_if(F.pmod(amount, F.lit(fixed.ROUND_STEP).cast("decimal(18,4)")) == 0).alias("rounded"),
            F.count_if(F.pmod(F.floor(F.col("t") / fixed.HOUR), F.lit(24)) < 6).alias("night"), F.min("t").alias("first_t"), F.max("t").alias("last_t"))
        pairs = sides.groupBy("account_id", "counterparty", "day").agg(F.count_if(out).alias("sent"), F.count_if(~out).alias("received"))
        for name, rows in (("sums", sums), ("pairs", pairs)):
            rows.write.mode("overwrite").partitionBy("day").parquet(f"{self.path}/{name}/batch={batch}")

    def _read(self, name: str, schema: str, day: int | None) -> DataFrame:
        rows = self.spark.read.schema(schema).parquet(f"{self.path}/{name}")
        return rows if day is None else rows.where(F.col("day") == day)

    def latest_day(self) -> int | None:
        return self._read("sums", SUMS, None).agg(F.max("day")).first()[0]

    def totals(self, day: int | None = None) -> DataFrame:
        """What ``behaviour.account_totals`` gives on the transfers of that day, or of all days."""
        rows = self._read("sums", SUMS, day)
        mean = (F.sum(F.col("mean") * F.col("n")) / F.sum("n")).alias("whole_mean")
        means = rows.groupBy("account_id").agg(mean)
        # squares around the common mean: those of each part around its own, and the distance of the two
        spread = F.sum(F.col("squares") + F.col("n") * (F.col("mean") - F.col("whole_mean")) ** 2)
        counts = {"transaction_count": "n", "sent_count": "sent", "received_count": "received"}
        more = {"near_out": "near_out", "near_in": "near_in", "sub_count": "sub", "round_count": "rounded", "night_count": "night"}
        return rows.join(means, "account_id").groupBy("account_id").agg(
            *[F.sum(c).alias(name) for name, c in counts.items()],
            dbl(F.coalesce(F.sum("total_in"), F.lit(0))).alias("total_incoming"), dbl(F.coalesce(F.sum("total_out"), F.lit(0))).alias("total_outgoing"),
            dbl(F.max("largest")).alias("maximum_transaction_amount"), F.sqrt(spread / F.sum("n")).alias("std_pop"),
            F.when(F.sum("n") > 1, F.sqrt(spread / (F.sum("n") - 1))).otherwise(0.0).alias("std_samp"),
            *[F.sum(c).alias(name) for name, c in more.items()], F.min("first_t").alias("first_t"), F.max("last_t").alias("last_t"))

    def degrees(self, day: int | None = None) -> DataFrame:
        pairs = self._read("pairs", PAIRS, day).groupBy("account_id", "counterparty").agg(F.sum("sent").alias("sent"), F.sum("received").alias("received"))
        return graph.degrees(pairs)

    def features(self, day: int | None = None) -> DataFrame:
        """The transactional columns of the feature store."""
        return store.transactional(self.totals(day), self.degrees(day))

    def behaviour(self, day: int | None = None) -> DataFrame:
        """The behavioural columns (set A)."""
        return behaviour.behaviour_features(self.totals(day), self.degrees(day))
