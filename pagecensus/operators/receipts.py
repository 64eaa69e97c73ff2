"""What a run produced, read off its documents: page receipts, document-set digests, summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagecensus.functions import fixed_values as V
from pagecensus.operators import digests
from pagecensus.session import shuffled


def page_receipts(
    records: DataFrame, selections: DataFrame, measurements: DataFrame, evidence: DataFrame
) -> DataFrame:
    """One row per acquired page, following evidence to measurement to record.

    A record has at most thirteen references, so what is gathered per record is bounded.
    """
    refs = records.select("run_id", "acquisition_id", F.posexplode("measurement_refs").alias("no", "measurement_id"))
    reasons = measurements.select(
        "run_id", "measurement_id", F.col("assessment.not_assessed_reason").alias("reason")
    )
    cited = evidence.select("run_id", "evidence_id", F.explode("measurement_refs").alias("measurement_id"))
    followed = (
        refs.join(shuffled(reasons), ["run_id", "measurement_id"], "left")
        .join(shuffled(cited), ["run_id", "measurement_id"], "left")
        .groupBy("run_id", "acquisition_id")
        .agg(
            F.array_sort(F.collect_set("reason")).alias("not_assessed_reasons"),
            F.transform(
                F.array_sort(
                    F.collect_list(F.when(F.col("evidence_id").isNotNull(), F.struct("no", "evidence_id")))
                ),
                lambda e: e["evidence_id"],
            ).alias("evidence_refs"),
        )
    )
    none = F.array().cast("array<string>")
    ranks = selections.select("run_id", "url_key", F.col("selection_rank").alias("__rank"))
    return (
        records.drop("selection_rank")
        .join(shuffled(ranks), ["run_id", "url_key"], "left")
        .join(shuffled(followed), ["run_id", "acquisition_id"], "left")
        .select(
            "run_id", F.col("__rank").alias("selection_rank"), "url_key", "acquisition_id", "acquisition_outcome",
            "http_status", "final_url_key", "redirect_count", "body_truncated", "body_decoded", "body_digest",
            "measurement_refs", F.coalesce("evidence_refs", none).alias("evidence_refs"),
            F.coalesce("not_assessed_reasons", none).alias("not_assessed_reasons"),
            "measurements_withheld_reason",
        )
    )


def _json(names: str, **replaced: Column) -> Column:
    """A canonical document: members in name order, absent ones left out."""
    columns = {name: F.col(name) for name in names.split()} | replaced
    columns["schema_version"] = F.lit(V.SCHEMA_VERSION)
    return F.to_json(F.struct(*[columns[name].alias(name) for name in sorted(columns)]))


def _sorted_assessment() -> Column:
    names = ["collection_mode", "not_assessed_reason", "result_state"]
    return F.struct(*[F.col(f"assessment.{n}").alias(n) for n in names])


def measurement_json() -> Column:
    names = ["boolean_value", "integer_value", "text_value", "url_value", "value_type"]
    result = F.when(
        F.col("result").isNotNull(), F.struct(*[F.col(f"result.{n}").alias(n) for n in names])
    )
    return _json(
        "run_id measurement_id metric_id source_url observed_at collector collector_version",
        assessment=_sorted_assessment(), result=result,
    )


def evidence_json() -> Column:
    return _json(
        "run_id evidence_id source_url observed_at scenario collector collector_version measurement_refs polarity",
        assessment=_sorted_assessment(),
    )


def record_json() -> Column:
    return _json(
        "run_id acquisition_id sampling_manifest_ref sampling_manifest_output_digest url_key observation_mode "
        "acquisition_method acquisition_method_version acquired_at acquisition_outcome http_status final_url_key "
        "redirect_count body_truncated body_decoded body_digest measurement_refs measurements_withheld_reason"
    )


def document_set_digests(records: DataFrame, measurements: DataFrame, evidence: DataFrame) -> DataFrame:
    """(run_id, document_type, count, digest) over each set in emission order, in one shuffle."""
    ranks = records.select("run_id", "url_key", "selection_rank")
    page = digests.rank_key(F.col("selection_rank"))
    place = digests.rank_key(F.col("measurement_no"))
    sets = {
        "page_acquisitions": (records, [page], record_json()),
        "measurements": (measurements.join(shuffled(ranks), ["run_id", "url_key"]), [page, place], measurement_json()),
        "website_evidence": (evidence.join(shuffled(ranks), ["run_id", "url_key"]), [page, place], evidence_json()),
    }
    fragments = counts = None
    for name, (documents, order, text) in sets.items():
        tagged = digests.list_fragments(documents, order, text).withColumn(
            "doc_id", F.concat(F.lit(name + "|"), "doc_id")
        )
        counted = documents.groupBy("run_id").agg(F.count("*").alias("count")).withColumn("document_type", F.lit(name))
        fragments = tagged if fragments is None else fragments.unionByName(tagged)
        counts = counted if counts is None else counts.unionByName(counted)
    hashed = digests.streamed_digests(fragments).select(
        F.substring_index("doc_id", "|", 1).alias("document_type"),
        F.expr("substring(doc_id, instr(doc_id, '|') + 1)").alias("run_id"), "digest",
    )
    return counts.join(hashed, ["run_id", "document_type"]).select("run_id", "document_type", "count", "digest")


def run_summaries(inventories: DataFrame, manifests: DataFrame) -> DataFrame:
    """One row per run: what was found, what was selected, and the digests that pin both."""
    found = inventories.select(
        "run_id", "inventory_id", "target_origin", F.col("input_digest").alias("inventory_input_digest"),
        F.col("output_digest").alias("inventory_digest"),
    )
    return found.join(manifests, "run_id", "left").select(
        "run_id", "target_origin", "inventory_id", "inventory_input_digest", "inventory_digest",
        "sampling_manifest_id", "candidate_count", "selected_count", "selection_complete", "incompleteness_cause",
        F.col("input_digest").alias("manifest_input_digest"), F.col("output_digest").alias("manifest_digest"),
    )


def reproduced_digests(found) -> DataFrame:
    """The digests a discovery's stored tables give when computed again.

    The input digest of an inventory covers observations its documents do not carry, so it is not
    among them.
    """
    runs = found.inventories.select("run_id", F.col("target_origin").alias("site"))
    inventory = digests.streamed_digests(
        digests.inventory_fragments(runs, found.candidates, found.forms, found.sources, found.attempts)
    ).select(F.col("doc_id").alias("run_id"), F.col("digest").alias("inventory_output"))
    manifest = digests.streamed_digests(
        digests.manifest_fragments(found.summary, found.selections, found.exclusions)
    ).select(F.col("doc_id").alias("run_id"), F.col("digest").alias("manifest_output"))
    inputs = found.manifests.select("run_id", digests.manifest_input_digest().alias("manifest_input"))
    return inventory.join(manifest, "run_id").join(inputs, "run_id")
