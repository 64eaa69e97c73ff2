"""Session settings every job relies on."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Captures carry page bodies: batches bounded by rows and bytes keep one Python worker within memory.
    "spark.sql.execution.arrow.maxRecordsPerBatch": "1000",
    "spark.sql.execution.arrow.maxBytesPerBatch": "32m",
}


def bounded_batches(spark: SparkSession) -> SparkSession:
    """The session with Arrow batches no larger than the jobs rely on; a given one may have none of this.

    A worker holds a batch whole: at Spark's ten thousand rows that is ten thousand page bodies.
    """
    for name in ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"):
        spark.conf.set(name, SETTINGS[name])
    return spark


def local_session(cpus: int | str = "*", app: str = "pagecensus") -> SparkSession:
    """A local session for tests and the bench; on a cluster use the session you are given."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("SPARK_DRIVER_MEMORY", "8g"))
        .config("spark.sql.shuffle.partitions", str(cpus) if cpus != "*" else "8")
        # Test tables are tiny: without this AQE would put CPU-bound work into one partition.
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "64k")
        .config("spark.local.dir", tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
    )
    for name, value in SETTINGS.items():
        builder = builder.config(name, value)
    session = builder.getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    return session


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder that ``spark.checkpoint.dir`` names.

    Only a session on one machine gets a folder of its own where none is set: on a cluster each
    executor would write to its own disk, so there a missing setting is an error.
    """
    if spark.sparkContext.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not spark.sparkContext.master.startswith("local["):
                raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
            folder = tempfile.mkdtemp(prefix="spark-checkpoint-", dir="/tmp")
        spark.sparkContext.setCheckpointDir(folder)
    return spark.sparkContext.getCheckpointDir()


def _own_folder(spark: SparkSession) -> str:
    return f"{ensure_checkpoint_dir(spark)}/{spark.sparkContext.applicationId}-tables"


def materialised(df: DataFrame) -> DataFrame:
    """The rows as a table in the shared checkpoint folder.

    For results several later steps read: they are computed once, survive lost executors, and come
    back with column pruning and real sizes for join planning.
    """
    spark = df.sparkSession
    path = f"{_own_folder(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def shuffled(df: DataFrame) -> DataFrame:
    """One side of a join that grows with the input: it is shuffled, never sent to every executor.

    Spark estimates a table by its packed files and an exploded one by what was exploded.  Both may lie
    far below what a broadcast would then put into the driver's memory.
    """
    return df.hint("merge")


def drop_materialised(spark: SparkSession) -> None:
    """Deletes what this application has materialised; for the end of a run, when results are written."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(_own_folder(spark))
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def spread(df: DataFrame, tasks: int = 1) -> DataFrame:
    """Rows over all cores, ``tasks`` for each, when the files give fewer partitions than that.

    Only a small input is moved: files of any size beyond have more splits than there are cores.
    Rows that become far larger ask for several tasks, or a few more splits than cores take two rounds.
    """
    wanted = df.sparkSession.sparkContext.defaultParallelism * tasks
    return df.repartition(wanted) if df.rdd.getNumPartitions() < wanted else df
