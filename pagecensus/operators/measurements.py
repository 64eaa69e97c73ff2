"""Observed pages -> measurements, evidence and acquisition records.

Wide to long in one projection: no shuffle, the metric order is a column.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagecensus import schemas
from pagecensus.functions import fixed_values as V
from pagecensus.operators.observation import latest_capture
from pagecensus.functions.columns import (
    instant, is_contract_url, lookup, representable, single_line, stable_id,
)
from pagecensus.session import shuffled


def _assessment(mode=None, state=None, reason=None) -> Column:
    values = [v if isinstance(v, Column) else F.lit(v).cast("string") for v in (mode, state, reason)]
    names = ["collection_mode", "result_state", "not_assessed_reason"]
    return F.struct(*[v.alias(n) for v, n in zip(values, names)])


def _result(value_type: str, value: Column) -> Column:
    slots = {
        "BOOLEAN": ("boolean_value", "boolean"), "INTEGER": ("integer_value", "bigint"),
        "TEXT": ("text_value", "string"), "URL": ("url_value", "string"),
    }
    return F.struct(
        F.lit(value_type).alias("value_type"),
        *[
            (value.cast(kind) if slot == value_type else F.lit(None).cast(kind)).alias(name)
            for slot, (name, kind) in slots.items()
        ],
    )


def _fact(assessment: Column, result: Column | None = None) -> Column:
    none = F.lit(None).cast(schemas.RESULT)
    return F.struct(
        assessment.alias("assessment"), (none if result is None else result).alias("result")
    )


def _known(mode: str, value_type: str, value: Column) -> Column:
    return _fact(_assessment(mode, "KNOWN"), _result(value_type, value))


def _established_nothing(state: str) -> Column:
    return _fact(_assessment("OBSERVED", state))


def _not_assessed(reason) -> Column:
    return _fact(_assessment(reason=reason))


def _transport_facts() -> dict[str, Column]:
    content_type = representable(F.coalesce("content_type", F.lit("")))
    return {
        "HTTP_STATUS": _known("MEASURED", "INTEGER", F.col("status_code")),
        "FINAL_URL": _known("OBSERVED", "URL", F.col("final_url")),
        "TRANSPORT_IS_HTTPS": _known("OBSERVED", "BOOLEAN", F.col("is_https")),
        "REDIRECT_COUNT": _known("MEASURED", "INTEGER", F.col("redirect_count")),
        "CONTENT_TYPE": F.when(
            content_type.isNotNull(), _known("OBSERVED", "TEXT", content_type)
        ).otherwise(_established_nothing("UNKNOWN")),
    }


def _presence_and_value(raw: str, line: str, value_type: str, value: Column) -> tuple[Column, Column]:
    """Presence and value are separate questions; a cut read answers neither for what it missed."""
    unseen = F.col(raw).isNull() & F.col("truncated")
    present = F.col(line) != ""
    presence = F.when(unseen, _established_nothing("UNKNOWN")).otherwise(
        _known("OBSERVED", "BOOLEAN", present)
    )
    content = (
        F.when(unseen, _established_nothing("UNKNOWN"))
        .when(~present, _established_nothing("NOT_APPLICABLE"))
        .when(value.isNull(), _established_nothing("UNKNOWN"))
        .otherwise(_known("OBSERVED", value_type, value))
    )
    return presence, content


def _document_facts(homepage: bool) -> dict[str, Column]:
    def bounded(line: str) -> Column:
        return F.when(F.length(line) <= V.MAX_TEXT_LENGTH, F.col(line))

    canonical = F.when(is_contract_url(F.col("page.canonical_url")), F.col("page.canonical_url"))
    if homepage:
        absolute = F.col("page.canonical_url").rlike(r"(?i)^https?://[^/?#]")
        fits = (F.length("page.canonical_url") <= V.MAX_URL_LENGTH) & (F.length("__canonical") <= V.MAX_TEXT_LENGTH)
        canonical = F.when(absolute & fits, F.col("page.canonical_url"))
    pairs = [
        _presence_and_value("page.title", "__title", "TEXT", bounded("__title")),
        _presence_and_value("page.meta_description", "__description", "TEXT", bounded("__description")),
        _presence_and_value("page.canonical_href", "__canonical", "URL", canonical),
    ]
    read = dict(zip(V.DOCUMENT_METRICS, [fact for pair in pairs for fact in pair]))
    status = F.col("document_status")
    return {
        metric: F.when(status == "READ", fact)
        .when(status == "NOT_A_DOCUMENT", _established_nothing("NOT_APPLICABLE"))
        .when(status == "UNREADABLE", _not_assessed("RUNTIME_ERROR"))
        .otherwise(_not_assessed("UNSUPPORTED"))
        for metric, fact in read.items()
    }


def _noindex_fact(verdict: str) -> Column:
    v = F.col(verdict)
    return (
        F.when(v.isNull(), _not_assessed("UNSUPPORTED"))
        .when(v == "UNASSESSED", _not_assessed("RUNTIME_ERROR"))
        .when(v == "INDETERMINATE", _established_nothing("UNKNOWN"))
        .when(v == "NOT_APPLICABLE", _established_nothing("NOT_APPLICABLE"))
        .otherwise(_known("OBSERVED", "BOOLEAN", v == "PRESENT"))
    )


def measurements(observed: DataFrame, requested: str = "url_key", homepage: bool = False) -> DataFrame:
    """One row per page and metric: 13 for a selected page, 14 for a homepage.

    A page without a response has every metric with the reason it was not assessed; a withheld
    page has none.
    """
    channels = {V.META_NOINDEX: "meta_noindex", V.HEADER_NOINDEX: "header_noindex"}
    if homepage:
        channels[V.COMBINED_NOINDEX] = "combined_noindex"
    answered = {
        **_transport_facts(), **_document_facts(homepage),
        **{metric: _noindex_fact(column) for metric, column in channels.items()},
    }
    declared = [*V.TRANSPORT_METRICS, *V.DOCUMENT_METRICS, *channels]
    emitted = [*V.TRANSPORT_EMISSION, *V.DOCUMENT_METRICS, *channels]
    failed = F.col("document_status") == "NO_RESPONSE"
    missing = _not_assessed(
        F.coalesce(lookup(V.NOT_ASSESSED_REASON, F.col("failure_kind")), F.lit("RUNTIME_ERROR"))
    )
    rows = [
        F.struct(
            F.when(failed, declared.index(metric) + 1).otherwise(emitted.index(metric) + 1)
            .alias("measurement_no"),
            F.lit(metric).alias("metric_id"),
            F.when(failed, missing).otherwise(answered[metric]).alias("fact"),
        )
        for metric in declared
    ]
    lines = {
        "__title": "page.title", "__description": "page.meta_description",
        "__canonical": "page.canonical_href",
    }
    prepared = observed.where("document_status <> 'WITHHELD'").withColumns({
        name: F.coalesce(single_line(F.col(source)), F.lit("")) for name, source in lines.items()
    })
    long = prepared.select(
        "run_id", F.col(requested).alias("url_key"), "final_url",
        instant(F.col("captured_at")).alias("observed_at"),
        F.explode(F.array(*rows)).alias("m"),
    )
    at_request = F.col("final_url").isNull() | F.col("m.metric_id").isin(V.PATH_METRICS)
    return long.select(
        "run_id", "url_key", F.col("m.measurement_no").alias("measurement_no"),
        stable_id("m", F.col("run_id"), F.col("url_key"), F.col("m.metric_id")).alias("measurement_id"),
        F.col("m.metric_id").alias("metric_id"),
        F.when(at_request, F.col("url_key")).otherwise(F.col("final_url")).alias("source_url"),
        "observed_at",
        F.lit(V.HOMEPAGE_COLLECTOR if homepage else V.PAGE_COLLECTOR).alias("collector"),
        F.lit(V.COLLECTOR_VERSION).alias("collector_version"),
        F.col("m.fact.assessment").alias("assessment"),
        F.col("m.fact.result").alias("result"),
    )


def evidence(measured: DataFrame, homepage: bool = False) -> DataFrame:
    """Evidence mirroring each measurement: same context, same assessment, no polarity."""
    return measured.select(
        "run_id", "url_key", "measurement_no",
        stable_id("e", F.col("measurement_id")).alias("evidence_id"),
        "source_url", "observed_at",
        F.lit(V.HOMEPAGE_SCENARIO if homepage else V.PAGE_SCENARIO).alias("scenario"),
        "collector", "collector_version", "assessment",
        F.lit(None).cast("string").alias("polarity"),
        F.array("measurement_id").alias("measurement_refs"),
    )


def selected_captures(selected: DataFrame, observed: DataFrame, manifests: DataFrame) -> DataFrame:
    """Every selection with its observed capture and its manifest, exactly one row per selection.

    A selection nobody captured is a failure of our runtime, never a fact about the page.
    """
    captured = latest_capture(observed.drop("site"), ["run_id", "url_key"])
    bound = selected.join(
        manifests.select(
            "run_id", "sampling_manifest_id", "generated_at",
            F.col("output_digest").alias("manifest_output_digest"),
        ),
        "run_id",
    )
    joined = bound.join(shuffled(captured), ["run_id", "url_key"], "left")
    lost = F.col("acquisition_outcome").isNull()
    return joined.withColumns({
        "failure_kind": F.when(lost, "RUNTIME_ERROR").otherwise(F.col("failure_kind")),
        "document_status": F.when(lost, "NO_RESPONSE").otherwise(F.col("document_status")),
        "acquisition_outcome": F.coalesce("acquisition_outcome", F.lit("RUNTIME_ERROR")),
        "captured_at": F.coalesce("captured_at", "generated_at"),
    })


def acquisition_records(acquired: DataFrame) -> DataFrame:
    """One record per selected capture, its measurement references in emission order.

    The references are computed from the ids, which are deterministic; nothing is collected.
    """
    channels = [V.META_NOINDEX, V.HEADER_NOINDEX]
    ids = {
        metric: stable_id("m", F.col("run_id"), F.col("url_key"), F.lit(metric))
        for metric in [*V.TRANSPORT_METRICS, *V.DOCUMENT_METRICS, *channels]
    }
    failed = F.col("acquisition_outcome") != "RESPONSE_RECEIVED"
    none = F.array().cast("array<string>")
    refs = F.when(F.col("withheld_reason").isNotNull(), none).when(
        failed, F.array(*[ids[m] for m in [*V.TRANSPORT_METRICS, *V.DOCUMENT_METRICS, *channels]])
    ).otherwise(
        F.array(*[ids[m] for m in [*V.TRANSPORT_EMISSION, *V.DOCUMENT_METRICS, *channels]])
    )
    return acquired.select(
        "run_id",
        stable_id("a", F.col("run_id"), F.col("url_key")).alias("acquisition_id"),
        F.col("selection_rank"),
        F.col("sampling_manifest_id").alias("sampling_manifest_ref"),
        F.col("manifest_output_digest").alias("sampling_manifest_output_digest"),
        "url_key",
        F.lit(V.OBSERVATION_MODE).alias("observation_mode"),
        F.lit(V.ACQUISITION_METHOD).alias("acquisition_method"),
        F.lit(V.ACQUISITION_METHOD_VERSION).alias("acquisition_method_version"),
        instant(F.col("captured_at")).alias("acquired_at"),
        "acquisition_outcome",
        F.when(~failed, F.col("status_code").cast("bigint")).alias("http_status"),
        F.when(~failed, F.col("final_url_key")).alias("final_url_key"),
        F.when(~failed, F.col("redirect_count").cast("bigint")).alias("redirect_count"),
        F.when(~failed, F.col("truncated")).alias("body_truncated"),
        F.when(~failed, ~F.col("undecodable")).alias("body_decoded"),
        F.when(~failed, F.col("body_digest")).alias("body_digest"),
        refs.alias("measurement_refs"),
        F.col("withheld_reason").alias("measurements_withheld_reason"),
    )
