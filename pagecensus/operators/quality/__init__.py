"""Data-quality jobs: tables in, violations (run_id, pointer, rule) out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagecensus.operators.ranking import with_position

VIOLATION = ["run_id", "pointer", "rule"]


def rows_where(df: DataFrame, bad: Column, pointer: Column, rule: str) -> DataFrame:
    """One violation per row for which ``bad`` holds; an unknown condition is not a violation."""
    return df.where(F.coalesce(bad, F.lit(False))).select(
        "run_id", pointer.alias("pointer"), F.lit(rule).alias("rule")
    )


def at(collection: str, position: str = "pos") -> Column:
    return F.concat(F.lit(f"/{collection}/"), F.col(position).cast("string"))


def all_violations(*parts: DataFrame) -> DataFrame:
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result


def repeats(df: DataFrame, collection: str, key: str, rule: str) -> DataFrame:
    """Every later occurrence of a key within a document.

    Keys that occur twice are found by a combinable aggregate; only their rows meet them again, so
    a key repeated a billion times is spread by AQE rather than windowed in one task.
    """
    present = df.where(F.col(key).isNotNull())
    first = present.groupBy("run_id", key).agg(
        F.min("pos").alias("__first"), F.count("*").alias("__n")
    ).where("__n > 1")
    later = present.join(first, ["run_id", key]).where("pos > __first")
    return later.select("run_id", at(collection).alias("pointer"), F.lit(rule).alias("rule"))


def withhold(documents: DataFrame, violations: DataFrame) -> DataFrame:
    """Only the documents of runs without any violation: one broken rule withholds the whole run."""
    return documents.join(violations.select("run_id").distinct(), "run_id", "left_anti")


def problem_errors(violations: DataFrame, of: str = "keyword") -> DataFrame:
    """Every violation as a row with its number within its document, by (pointer, keyword)."""
    return with_position(violations, ["run_id"], [F.col("pointer"), F.col(of)], "error_no").select(
        "run_id", "error_no", "pointer", F.col(of).alias("keyword")
    )


def problems(violations: DataFrame, contract: str, total_of: str = "keyword", listed: int = 50) -> DataFrame:
    """One short problem per document: code, total, and the first ``listed`` errors.

    ``problem_errors`` has them all.  The list is cut by rank before it is collected.
    """
    order = Window.partitionBy("run_id").orderBy("pointer", total_of)
    shown = (
        violations.withColumn("__n", F.row_number().over(order))
        .where(F.col("__n") <= listed)
        .groupBy("run_id")
        .agg(
            F.array_sort(F.collect_list(F.struct("__n", "pointer", F.col(total_of).alias("keyword"))))
            .alias("__errors")
        )
    )
    totals = violations.groupBy("run_id").agg(
        F.count("*").alias("total"),
        F.max((F.col("pointer") == "/schema_version") & (F.col(total_of) == "const")).alias("__version"),
    )
    reported = F.size("__errors")
    subject = F.when(
        F.col("__version"), "declares a schema version not supported by"
    ).otherwise("does not satisfy")
    return totals.join(shown, "run_id").select(
        "run_id",
        F.when(F.col("__version"), "SCHEMA_VERSION_UNSUPPORTED")
        .otherwise("CONTRACT_VALIDATION_FAILED").alias("code"),
        F.format_string(
            f"Document %s contract '{contract}': %d violation(s), %d reported.",
            subject, F.col("total"), reported,
        ).alias("detail"),
        "total",
        F.transform("__errors", lambda e: F.struct(e["pointer"].alias("pointer"), e["keyword"].alias("keyword")))
        .alias("errors"),
    )
