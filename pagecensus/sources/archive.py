"""Bundles per run date: whole ones or none, each with a record of what it holds.

A bundle is written beside the archive's own folders, then a commit record (files, rows, checksums)
is added to it, and one rename makes it visible as ``run_date=.../bundle=...``.  A writer that is
stopped on the way leaves a folder that no reader looks at; a bundle that exists is never touched.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

COMMIT = "_commit"
_RECORD = "dataset string, file string, rows bigint, checksum decimal(38,0)"


def _files(spark: SparkSession, folder: str):
    path = spark._jvm.org.apache.hadoop.fs.Path
    return path, path(folder).getFileSystem(spark._jsc.hadoopConfiguration())


def _contents(spark: SparkSession, folder: str, datasets: list[str]) -> DataFrame:
    """(dataset, file, rows, checksum) of every data file; the checksum does not depend on row order."""

    def of(name: str) -> DataFrame:
        lines = spark.read.text(f"{folder}/{name}").select(F.col("_metadata.file_name").alias("file"), "value")
        return lines.groupBy("file").agg(
            F.count("*").alias("rows"), F.sum(F.xxhash64("value").cast("decimal(38,0)")).alias("checksum")
        ).select(F.lit(name).alias("dataset"), "file", "rows", F.col("checksum").cast("decimal(38,0)").alias("checksum"))

    return reduce(DataFrame.unionByName, map(of, datasets))


def publish(tables: dict[str, DataFrame], root: str, run_date: str, name: str) -> str:
    """Writes the tables as one bundle of a run date and returns its folder.

    A bundle of that date and name must not exist: a rerun is refused, whatever it would write.
    """
    spark = next(iter(tables.values())).sparkSession
    path, files = _files(spark, root)
    target = f"{root.rstrip('/')}/run_date={run_date}/bundle={name}"
    if files.exists(path(target)):
        raise FileExistsError(f"the bundle exists already: {target}")
    staging = f"{root.rstrip('/')}/_staging-{uuid.uuid4().hex}"
    try:
        for dataset, table in tables.items():
            table.write.mode("errorifexists").json(f"{staging}/{dataset}")
        _contents(spark, staging, list(tables)).coalesce(1).write.json(f"{staging}/{COMMIT}")
        files.mkdirs(path(target).getParent())
        if files.exists(path(target)) or not files.rename(path(staging), path(target)):
            raise FileExistsError(f"the bundle appeared meanwhile: {target}")
    except BaseException:
        files.delete(path(staging), True)
        raise
    return target


def bundles(spark: SparkSession, root: str) -> list[tuple[str, str, str]]:
    """(run date, name, folder) of the bundles that are committed; one entry per bundle."""
    path, files = _files(spark, root)
    found = files.globStatus(path(f"{root.rstrip('/')}/run_date=*/bundle=*/{COMMIT}")) or []
    folders = sorted(str(status.getPath().getParent().toString()) for status in found)
    return [(f.split("/run_date=")[1].split("/")[0], f.rsplit("/bundle=", 1)[1], f) for f in folders]


def read_archive(spark: SparkSession, root: str, dataset: str, schema: str) -> DataFrame:
    """The rows of a dataset in all committed bundles, with their ``run_date`` and ``bundle``."""
    folders = [f"{folder}/{dataset}" for _, _, folder in bundles(spark, root)]
    path, files = _files(spark, root)
    held = [f for f in folders if files.exists(path(f))]
    both = f"{schema}, run_date string, bundle string"
    if not held:
        return spark.createDataFrame([], both)
    base = files.makeQualified(path(root)).toString()
    return spark.read.schema(both).option("basePath", base).json(held)


def unsound(spark: SparkSession, root: str) -> DataFrame:
    """(run_date, bundle, dataset, file, problem): committed bundles whose files are not the recorded ones."""
    result = spark.createDataFrame([], "run_date string, bundle string, dataset string, file string, problem string")
    for run_date, name, folder in bundles(spark, root):
        stated = spark.read.schema(_RECORD).json(f"{folder}/{COMMIT}")
        path, files = _files(spark, folder)
        datasets = [s.getPath().getName() for s in files.listStatus(path(folder)) if s.isDirectory() and s.getPath().getName() != COMMIT]
        there = _contents(spark, folder, datasets) if datasets else spark.createDataFrame([], _RECORD)
        met = stated.toDF("dataset", "file", "n", "sum").join(there, ["dataset", "file"], "full")
        problem = F.when(F.col("rows").isNull(), "missing").when(F.col("n").isNull(), "unrecorded").when(
            (F.col("rows") != F.col("n")) | ~F.col("sum").eqNullSafe(F.col("checksum")), "changed"
        )
        bad = met.withColumn("problem", problem).where("problem is not null")
        result = result.unionByName(bad.select(F.lit(run_date).alias("run_date"), F.lit(name).alias("bundle"), "dataset", "file", "problem"))
    return result
