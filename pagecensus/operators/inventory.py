"""Observations -> admitted observations -> candidates, with sources and counts.

The working form is long: one row per candidate, per form and per source.  A URL seen a billion
times or under a million forms is therefore never one array in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagecensus.functions import fixed_values as V
from pagecensus.functions.classify import type_of_words, words
from pagecensus.functions.columns import is_persistable
from pagecensus.functions.url import (
    is_page_resource, origin_of, path_of, query_of, with_url_identity,
)


def admitted_observations(observations: DataFrame) -> DataFrame:
    """Distinct observations whose written form may be recorded and has an identity.

    Copies collapse before any URL work, so a form is keyed once however often it was seen.
    """
    distinct = observations.where(is_persistable(F.col("observed_form"))).select(
        "run_id", "site", "observed_form", "source_id",
        F.when(F.col("label") != "", F.col("label")).alias("label"),
    ).distinct()
    return with_url_identity(distinct, "observed_form").where("url_key is not null").drop(
        "url_refusal"
    )


def candidates(admitted: DataFrame) -> DataFrame:
    """One row per (run, URL key) with its eligibility and page type.

    Labels are reduced to the first one, in text order, that places the page: a bounded value, so
    the aggregation combines on the map side whatever a key's share of the rows is.
    """
    labelled = admitted.withColumn("__words", words(F.col("label"))).withColumn(
        "__label_type",
        F.when(F.length("label") <= V.MAX_LABEL_LENGTH, type_of_words(F.col("__words"))),
    )
    grouped = labelled.groupBy("run_id", "site", "url_key").agg(
        F.min_by("__label_type", F.when(F.col("__label_type").isNotNull(), F.col("label"))).alias(
            "__label_type"
        )
    )
    judged = with_eligibility(grouped)
    return with_page_type(judged).drop("__label_type")


def with_eligibility(keyed: DataFrame) -> DataFrame:
    """Off-origin is tested before the resource suffix; anything else is eligible."""
    off_origin = ~F.coalesce(origin_of(F.col("url_key")) == F.col("site"), F.lit(False))
    return keyed.withColumn(
        "exclusion_reason",
        F.when(off_origin, "OFF_ORIGIN").when(
            ~is_page_resource(F.col("url_key")), "NON_PAGE_RESOURCE"
        ),
    ).withColumn(
        "eligibility_state",
        F.when(F.col("exclusion_reason").isNull(), "ELIGIBLE").otherwise("EXCLUDED"),
    )


def with_page_type(judged: DataFrame) -> DataFrame:
    """The seed is the homepage; else the path places, then the query, then the labels."""
    return judged.withColumns({
        "__path": words(path_of(F.col("url_key"))), "__query": words(query_of(F.col("url_key"))),
    }).withColumn(
        "page_type",
        F.when(F.col("eligibility_state") == "EXCLUDED", None)
        .when(F.col("url_key") == F.col("site"), V.HOMEPAGE)
        .otherwise(
            F.coalesce(
                type_of_words(F.col("__path")), type_of_words(F.col("__query")), "__label_type"
            )
        ),
    ).drop("__path", "__query")


def candidate_forms(admitted: DataFrame) -> DataFrame:
    return admitted.select("run_id", "site", "url_key", "observed_form").distinct()


def candidate_sources(admitted: DataFrame) -> DataFrame:
    return admitted.select("run_id", "site", "url_key", "source_id").distinct()


def source_counts(attempts: DataFrame, sources: DataFrame) -> DataFrame:
    """Every attempted source with the number of candidates naming it; zero when none does."""
    counted = sources.groupBy("run_id", "source_id").agg(F.count("*").alias("candidate_count"))
    return attempts.join(counted, ["run_id", "source_id"], "left").withColumn(
        "candidate_count", F.coalesce("candidate_count", F.lit(0).cast("bigint"))
    )


def non_idempotent_keys(keyed: DataFrame) -> DataFrame:
    """Keys that are not their own identity: they belong to no origin."""
    again = with_url_identity(keyed, "url_key", "again_")
    return again.where(~F.col("url_key").eqNullSafe(F.col("again_url_key")))
