"""Session and shared-storage helpers."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession


def get_session(app: str = "factloom", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings this engine expects; an existing session is reused."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    } | conf
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder the cluster names in spark.checkpoint.dir.

    Only where none is named and the master is local (tests, one machine) a temporary folder is set.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not named:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        named = os.path.join(tempfile.gettempdir(), "factloom-checkpoints")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(named)
    return named


#: Rows of a checkpoint to a file, where it is known how many there are at most.
FILE_ROWS = 1 << 14


def cut(df: DataFrame, most: int | None = None) -> DataFrame:
    """Materialise df in the shared checkpoint folder and cut its lineage.

    most: rows at most of df and of each table that its last stage reads, where that is known: it is then written in no
    more files than these need, whatever the number of shuffle partitions. Each file costs processes for its permissions where Hadoop's native library is
    missing, and until such a process has begun it counts as much memory as its JVM.
    """
    checkpoint_dir(df.sparkSession)
    if most is not None:
        df = df.coalesce(max(1, -(-most // FILE_ROWS)))
    return df.checkpoint(eager=True)


def settled(df: DataFrame) -> DataFrame:
    """cut, for what a loop joins in each round: by exchange and merge, never by sending it to all tasks.

    A checkpoint keeps the size that was estimated for its plan. Estimates start from the bytes of compressed files and
    shrink with every column left out, so tables of millions of rows pass for small and are broadcast, once a round.
    """
    df = cut(df)
    spark, scan = df.sparkSession, df._jdf.queryExecution().analyzed()
    nothing = spark._jvm.scala.Option.empty()
    plain = scan.copy(scan.output(), scan.rdd(), scan.outputPartitioning(), scan.outputOrdering(), scan.isStreaming(), scan.stream(), spark._jsparkSession, nothing, nothing)
    return DataFrame(spark._jvm.org.apache.spark.sql.classic.Dataset.ofRows(spark._jsparkSession, plain), spark).hint("merge")


#: Rows of a table to a task, where what is made of a row costs more than to send it.
TASK_ROWS = 1 << 16


def spread(rows: DataFrame, *keys: str) -> DataFrame:
    """rows of a table dealt by keys to as many tasks as they need, whatever the number and size of its files."""
    return rows.repartition(max(1, -(-rows.count() // TASK_ROWS)), *keys)
