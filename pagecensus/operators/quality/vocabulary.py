"""Closed vocabularies of document members, held against what the documents say."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagecensus.functions import fixed_values as V
from pagecensus.operators.quality import structure as S

# The members that take tokens of a closed set only, by dataset, and their sets.
VOCABULARIES: dict[tuple[str, str], list[str]] = {
    ("analysis_run_request", "scan_mode"): ["PUBLIC_NON_INVASIVE", "OWNER_VERIFIED_CONTROLLED"],
    ("analysis_run_state", "state"): V.RUN_STATES,
    ("stage_executions", "status"): ["RUNNING", *V.TERMINAL_STATES],
    ("measurements", "assessment.collection_mode"): S.COLLECTION_MODES,
    ("measurements", "assessment.result_state"): S.RESULT_STATES,
    ("measurements", "assessment.not_assessed_reason"): S.NOT_ASSESSED_REASONS,
    ("measurements", "result.value_type"): ["BOOLEAN", "INTEGER", "TEXT", "URL"],
    ("website_evidence", "assessment.collection_mode"): S.COLLECTION_MODES,
    ("website_evidence", "assessment.result_state"): S.RESULT_STATES,
    ("website_evidence", "assessment.not_assessed_reason"): S.NOT_ASSESSED_REASONS,
    ("website_evidence", "polarity"): ["POSITIVE", "NEGATIVE"],
    ("sources", "outcome"): V.SOURCE_OUTCOMES,
    ("candidates", "eligibility_state"): ["ELIGIBLE", "EXCLUDED"],
    ("candidates", "exclusion_reason"): S.EXCLUSION_REASONS,
    ("sampling_manifest", "mode"): ["CENSUS", "STRATIFIED_SAMPLE"],
    ("sampling_manifest", "incompleteness_cause"): ["SELECTION_BUDGET_EXHAUSTED", "SAFETY_LIMIT_REACHED", "RUNTIME_LIMIT_REACHED"],
    ("selections", "selection_reason"): ["SEED", "CENSUS", "STRATUM_QUOTA"],
    ("exclusions", "reason"): ["NOT_SELECTED_BY_POLICY", "SELECTION_BUDGET_EXHAUSTED", "INELIGIBLE_IN_INVENTORY"],
    ("page_acquisitions", "observation_mode"): ["STATIC_HTTP", "RENDERED_BROWSER"],
    ("page_acquisitions", "acquisition_outcome"): S.OUTCOMES,
    ("page_acquisitions", "measurements_withheld_reason"): [V.WITHHELD_REASON],
}


def stated_tokens(datasets: dict[str, DataFrame]) -> DataFrame:
    """(dataset, member, value): every token that a closed member of a dataset takes, once.

    A dataset is read once for all of its members, and tokens are made distinct in the map tasks.
    """

    def tokens(name: str, rows: DataFrame) -> DataFrame:
        members = [m for d, m in VOCABULARIES if d == name]
        each = F.array(*[F.struct(F.lit(m).alias("member"), F.col(m).cast("string").alias("value")) for m in members])
        return rows.select(F.inline(each)).where("value is not null").distinct().withColumn("dataset", F.lit(name))

    return reduce(DataFrame.unionByName, (tokens(name, rows) for name, rows in datasets.items()))


def vocabulary_audit(datasets: dict[str, DataFrame]) -> DataFrame:
    """(dataset, member, value, problem): tokens that no vocabulary declares, and declared ones that no
    row of the given datasets uses."""
    stated = stated_tokens(datasets)
    declared = stated.sparkSession.createDataFrame(
        [(d, m, v) for (d, m), values in VOCABULARIES.items() if d in datasets for v in values], "dataset string, member string, value string"
    )
    key = ["dataset", "member", "value"]
    undeclared = stated.join(declared, key, "leftanti").withColumn("problem", F.lit("undeclared"))
    return undeclared.select(*key, "problem").unionByName(declared.join(stated, key, "leftanti").withColumn("problem", F.lit("unused")))
