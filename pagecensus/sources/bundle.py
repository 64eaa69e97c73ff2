"""The evidence bundle: one dataset per document type in a fresh folder, read back and compared."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Document types of a bundle; a singleton type has one document per run.
SINGLETONS = ["analysis_run_request", "analysis_run_state", "site_inventory", "sampling_manifest"]


def write_bundle(tables: dict[str, DataFrame], out_dir: str) -> None:
    """Writes every table as JSON under ``out_dir``, all or nothing.

    The folder must not exist: nothing is merged.  Tables are written to a folder beside it, which
    takes the name in one step when all are there, and goes if one fails.
    """
    spark = next(iter(tables.values())).sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path
    folder, staging = path(out_dir), path(f"{out_dir.rstrip('/')}.{uuid.uuid4().hex}")
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    if files.exists(folder):
        raise FileExistsError(f"the bundle folder exists already: {out_dir}")
    try:
        for name, table in tables.items():
            table.write.mode("errorifexists").json(f"{staging.toString()}/{name}")
        if files.exists(folder) or not files.rename(staging, folder):
            raise FileExistsError(f"the bundle folder appeared meanwhile: {out_dir}")
    except BaseException:
        files.delete(staging, True)
        raise


def read_bundle(spark: SparkSession, tables: dict[str, DataFrame], out_dir: str) -> dict[str, DataFrame]:
    """The datasets of a bundle, under the schemas of the tables it was written from."""
    return {name: spark.read.schema(table.schema).json(f"{out_dir}/{name}") for name, table in tables.items()}


def differences(expected: DataFrame, present: DataFrame, document_type: str) -> DataFrame:
    """Documents missing from what was read, and documents nobody wrote, copies counted."""
    columns = expected.columns
    both = expected.select(*columns, F.lit(1).alias("__n")).unionByName(present.select(*columns, F.lit(-1).alias("__n")))
    # One aggregate for both directions: what is left over on a side counts its copies.
    left = both.groupBy(*columns).agg(F.sum("__n").alias("__n")).where("__n <> 0")
    return left.select(
        "run_id", F.lit(document_type).alias("document_type"),
        F.when(F.col("__n") > 0, "missing").otherwise("unexpected").alias("problem"),
        F.explode(F.sequence(F.lit(1).cast("long"), F.abs("__n"))).alias("__copy"),
    ).drop("__copy")


def misshapen(present: DataFrame, document_type: str) -> DataFrame:
    """Runs with more than one document of a singleton type."""
    return present.groupBy("run_id").agg(F.count("*").alias("n")).where(
        (F.col("n") != 1) & F.lit(document_type in SINGLETONS)
    ).select("run_id", F.lit(document_type).alias("document_type"), F.lit("not one document").alias("problem"))


def reconcile(spark: SparkSession, tables: dict[str, DataFrame], out_dir: str) -> DataFrame:
    """Everything wrong with a bundle as read back; empty when it is what was written."""
    result = None
    for name, present in read_bundle(spark, tables, out_dir).items():
        found = differences(tables[name], present, name).unionByName(misshapen(present, name))
        result = found if result is None else result.unionByName(found)
    return result
