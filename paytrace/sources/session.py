"""Session settings and lineage cutting."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(cpus: int | str = "*", shuffle_partitions: int = 8, **extra: str) -> SparkSession:
    """A local session for tests and the bench. On a cluster, pass your own session instead."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("paytrace")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in extra.items():
        builder = builder.config(key.replace("__", "."), value)
    return prepare(builder.getOrCreate())


def prepare(spark: SparkSession) -> SparkSession:
    """Session settings the results depend on. Safe to call again.

    Times are epoch seconds in UTC. A union must not claim its children's partitioning: adaptive
    execution coalesces the children separately (seen in 4.1.2), and a shuffle skipped on the strength
    of that claim would leave rows of one key in two tasks. Batches for Python are kept small, as rows hold
    whole texts: a batch is held in the executor and, twice, in its worker.
    """
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.unionOutputPartitioning", "false")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """Folder that survives lost executors: the one the session names in ``spark.checkpoint.dir``.

    Where that is unset, as in tests, a folder below the warehouse; a cluster has to name one.
    """
    sc = prepare(spark).sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not folder:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/paytrace-checkpoints"
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(folder)
    return folder


def new_folder(spark: SparkSession, name: str) -> str:
    """A path below the shared folder that no other table uses."""
    return f"{shared_folder(spark).rstrip('/')}/{name}/{uuid.uuid4().hex}"


def drop_folder(spark: SparkSession, path: str) -> None:
    """Deletes a folder of intermediate tables that nothing reads any more."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder and drop its lineage."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def tabled(df: DataFrame) -> DataFrame:
    """Materialise ``df`` as a table in the shared folder, for loops that feed each round to the next.

    A checkpointed table keeps the optimizer's size estimate and constraints of the plan it came from. Where every round
    joins the rounds before, the estimates are multiplied and the constraints combined, which doubles the driver's planning
    time and memory per round; a table that is read again knows its own size only. It is also computed once, a checkpoint twice.
    """
    path = new_folder(df.sparkSession, "rounds")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
