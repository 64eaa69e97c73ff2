"""Evidence and the measurements behind it -> findings by the fixed rules."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagecensus.functions import fixed_values as V
from pagecensus.functions.columns import stable_id
from pagecensus.sources.captures import rule_dimension


def _triggered():
    """A rule's condition on a known value of the right type; anything else triggers nothing."""
    rule, value = F.col("rule_id"), F.col("result")
    flag = F.when(value["value_type"] == "BOOLEAN", value["boolean_value"])
    status = F.when(value["value_type"] == "INTEGER", value["integer_value"])
    return F.coalesce(
        ((rule == "HTTP_ERROR_RESPONSE") & (status >= V.HTTP_ERROR_THRESHOLD))
        | (rule.isin("NON_HTTPS_FINAL_TRANSPORT", "MISSING_HOMEPAGE_TITLE") & ~flag)
        | ((rule == "HOMEPAGE_EXPLICIT_NOINDEX") & flag),
        F.lit(False),
    )


def findings(evidence: DataFrame, measured: DataFrame) -> DataFrame:
    """One finding per rule and piece of evidence whose decisive measurement triggers the rule.

    The measurement side is cut to known values of the four metrics before the join; the decisive
    reference is the first one of the rule's metric, kept by a bounded aggregate.
    """
    spark = evidence.sparkSession
    rules = rule_dimension(spark)
    decisive_metrics = [rule["metric_id"] for rule in V.FINDING_RULES]
    known = measured.where(
        (F.col("assessment.result_state") == "KNOWN")
        & F.col("metric_id").isin(decisive_metrics)
        & F.col("result").isNotNull()
    ).select("run_id", "measurement_id", "metric_id", "result")
    refs = evidence.where("assessment.result_state = 'KNOWN'").select(
        "run_id", "evidence_id", F.posexplode("measurement_refs").alias("ref_no", "measurement_id")
    )
    decided = (
        refs.join(known, ["run_id", "measurement_id"])
        .groupBy("run_id", "evidence_id", "metric_id")
        .agg(F.min_by("result", "ref_no").alias("result"))
    )
    return (
        decided.join(F.broadcast(rules), "metric_id")
        .where(_triggered())
        .select(
            "run_id",
            stable_id("f", F.col("rule_id"), F.col("evidence_id")).alias("finding_id"),
            "rule_no", "rule_id", F.lit(V.RULE_VERSION).alias("rule_version"), "finding_class",
            F.array("evidence_id").alias("evidence_refs"),
            "finding_summary", "business_impact", "recommended_action", "limitation",
        )
    )
