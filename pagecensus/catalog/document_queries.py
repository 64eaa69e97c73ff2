"""Queries over assembled documents: digests, receipts, admission, bundles, JSON scans."""

from __future__ import annotations

import gzip
import uuid
import zlib

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagecensus.catalog import inputs
from pagecensus.catalog.oracle import CTES, _candidate_json, sql_id, sql_quoted
from pagecensus.catalog.queries import (
    _RECORDS, _acquisition, _discovery, joined, register,
)
from pagecensus.catalog.quality_queries import _page_documents
from pagecensus.functions import fixed_values as V
from pagecensus.functions.content import in_slices
from pagecensus.operators import digests, receipts
from pagecensus.operators.measurements import measurements
from pagecensus.operators.quality import documents as rules
from pagecensus.plans.acquisition import observed_captures
from pagecensus.session import ensure_checkpoint_dir, materialised
from pagecensus.sources import archive, bundle, readback
from pagecensus.sources.captures import normalise_captures, split_documents

CTES.update({
    "records": _RECORDS,
    "cited": f"SELECT *, {sql_id('e', 'measurement_id')} AS evidence_id FROM measured",
})


@register("page_receipts", """SELECT r.run_id, selection_rank, r.url_key, acquisition_id, acquisition_outcome, http_status, body_digest,
    measurement_refs, c.evidence_refs, c.reasons AS not_assessed_reasons, measurements_withheld_reason
    FROM records r LEFT JOIN (SELECT run_id, url_key, string_agg(evidence_id, '|' ORDER BY measurement_no) AS evidence_refs,
      coalesce(array_to_string(list_sort(list(DISTINCT not_assessed_reason) FILTER (not_assessed_reason IS NOT NULL)), '|'), '') AS reasons
      FROM cited GROUP BY ALL) c ON c.run_id = r.run_id AND c.url_key = r.url_key""")
def page_receipts(spark, sf_dir):
    found, got = _acquisition(spark, sf_dir)
    return receipts.page_receipts(got.records, found.selections, got.measurements, got.evidence).select(
        "run_id", "selection_rank", "url_key", "acquisition_id", "acquisition_outcome", "http_status", "body_digest",
        joined("measurement_refs"), joined("evidence_refs"), joined("not_assessed_reasons"), "measurements_withheld_reason",
    )


_ASSESSMENT = """'"assessment":{' || CASE WHEN not_assessed_reason IS NOT NULL THEN '"not_assessed_reason":"' || not_assessed_reason || '"}'
    ELSE '"collection_mode":"' || collection_mode || '","result_state":"' || result_state || '"}' END"""
_RESULT = f"""CASE value_type WHEN 'BOOLEAN' THEN ',"result":{{"boolean_value":' || boolean_value || ',"value_type":"BOOLEAN"}}'
    WHEN 'INTEGER' THEN ',"result":{{"integer_value":' || integer_value || ',"value_type":"INTEGER"}}'
    WHEN 'TEXT' THEN ',"result":{{"text_value":' || {sql_quoted('text_value')} || ',"value_type":"TEXT"}}'
    WHEN 'URL' THEN ',"result":{{"url_value":' || {sql_quoted('url_value')} || ',"value_type":"URL"}}' ELSE '' END"""
_CONTEXT = f""",\"collector\":\"{V.PAGE_COLLECTOR}\",\"collector_version\":\"1.0.0\""""
_MEASUREMENT_JSON = f"""'{{' || {_ASSESSMENT} || '{_CONTEXT},"measurement_id":"' || measurement_id || '","metric_id":"' || metric_id
    || '","observed_at":"' || observed_at || '"' || {_RESULT} || ',"run_id":"' || run_id || '","schema_version":"1.0.0","source_url":'
    || {sql_quoted('source_url')} || '}}'"""
_EVIDENCE_JSON = f"""'{{' || {_ASSESSMENT} || '{_CONTEXT},"evidence_id":"' || evidence_id || '","measurement_refs":["' || measurement_id
    || '"],"observed_at":"' || observed_at || '","run_id":"' || run_id || '","scenario":"{V.PAGE_SCENARIO}","schema_version":"1.0.0","source_url":'
    || {sql_quoted('source_url')} || '}}'"""


_RECORD_JSON = f"""'{{"acquired_at":"' || acquired_at || '","acquisition_id":"' || acquisition_id || '","acquisition_method":"{V.ACQUISITION_METHOD}"'
    || ',"acquisition_method_version":"{V.ACQUISITION_METHOD_VERSION}","acquisition_outcome":"' || acquisition_outcome || '"'
    || coalesce(',"body_decoded":' || body_decoded, '') || coalesce(',"body_digest":"' || body_digest || '"', '')
    || coalesce(',"body_truncated":' || body_truncated, '') || coalesce(',"final_url_key":' || {sql_quoted('final_url_key')}, '')
    || coalesce(',"http_status":' || http_status, '') || ',"measurement_refs":["' || replace(measurement_refs, '|', '","') || '"]'
    || ',"observation_mode":"{V.OBSERVATION_MODE}"' || coalesce(',"redirect_count":' || redirect_count, '') || ',"run_id":"' || run_id
    || '","sampling_manifest_output_digest":"' || sampling_manifest_output_digest || '","sampling_manifest_ref":"' || sampling_manifest_ref
    || '","schema_version":"1.0.0","url_key":' || {sql_quoted('url_key')} || '}}'"""


@register("document_set_digests", f"""SELECT run_id, 'measurements' AS document_type, count(*) AS count,
      'sha256:' || sha256('[' || string_agg({_MEASUREMENT_JSON}, ',' ORDER BY selection_rank, measurement_no) || ']') AS digest
      FROM (SELECT c.*, r.selection_rank FROM cited c JOIN records r USING (run_id, url_key)) GROUP BY run_id
    UNION ALL SELECT run_id, 'website_evidence', count(*),
      'sha256:' || sha256('[' || string_agg({_EVIDENCE_JSON}, ',' ORDER BY selection_rank, measurement_no) || ']')
      FROM (SELECT c.*, r.selection_rank FROM cited c JOIN records r USING (run_id, url_key)) GROUP BY run_id
    UNION ALL SELECT run_id, 'page_acquisitions', count(*), 'sha256:' || sha256('[' || string_agg({_RECORD_JSON}, ',' ORDER BY selection_rank) || ']')
      FROM records GROUP BY run_id""")
def document_set_digests(spark, sf_dir):
    got = _acquisition(spark, sf_dir)[1]
    return receipts.document_set_digests(got.records, got.measurements, got.evidence)


@register("run_summaries", """SELECT i.run_id, i.site AS target_origin, inventory_id, i.input_digest AS inventory_input_digest,
    i.output_digest AS inventory_digest, sampling_manifest_id, candidate_count, selected_count, selection_complete, incompleteness_cause,
    m.input_digest AS manifest_input_digest, m.output_digest AS manifest_digest FROM inventories i JOIN b_manifests m USING (run_id)""")
def run_summaries(spark, sf_dir):
    found = _discovery(spark, sf_dir)
    return receipts.run_summaries(found.inventories, found.manifests)


@register("digest_reproduction", """SELECT i.run_id, i.output_digest AS inventory_output, m.input_digest AS manifest_input,
    m.output_digest AS manifest_output FROM inventories i JOIN b_manifests m USING (run_id)""")
def digest_reproduction(spark, sf_dir):
    return receipts.reproduced_digests(_discovery(spark, sf_dir))


@register("dq_admission", """SELECT run_id, '/run_id' AS pointer, 'manifest_binds_run' AS rule FROM runs WHERE page_id % 5 = 0
    UNION ALL SELECT run_id, '/inventory_ref', 'manifest_binds_inventory' FROM runs WHERE page_id % 4 = 0 OR page_id % 3 = 0
    UNION ALL SELECT run_id, '/inventory_output_digest', 'inventory_digest_reproduces' FROM runs WHERE page_id % 3 = 0
    UNION ALL SELECT run_id, '/output_digest', 'manifest_digests_reproduce' FROM runs WHERE page_id % 7 = 0
    UNION ALL SELECT run_id, '/selections', 'selection_present' FROM runs WHERE page_id % 11 = 0""")
def dq_admission(spark, sf_dir):
    """Manifests and inventories tampered with by the first page id of their site."""
    found = _discovery(spark, sf_dir)
    first = inputs.seeds(spark, sf_dir).select("run_id", "page_id")
    pid = F.col("page_id")

    def tampered(df, **changes):
        step = df.join(first, "run_id")
        for name, (modulus, value) in changes.items():
            step = step.withColumn(name, F.when(pid % modulus == 0, value).otherwise(F.col(name)))
        return step

    manifests = tampered(
        found.manifests.withColumn("executing_run", F.col("run_id")), executing_run=(5, "other"),
        inventory_ref=(4, "other"), output_digest=(7, "other"),
    )
    inventories = tampered(found.inventories.withColumn("executing_run", F.col("run_id")), output_digest=(3, "other"))
    selections = tampered(found.selections, selection_rank=(11, F.lit(None).cast("bigint")))
    return rules.admission(manifests, inventories, selections, receipts.reproduced_digests(found))


def _characters(fragments):
    """The length of every assembled document, over all its parts."""
    return digests.document_texts(fragments).groupBy(F.col("doc_id").alias("run_id")).agg(
        F.sum(F.length("text")).alias("characters")
    )


# An inventory is the digested text plus its envelope, whose members have known lengths.
CTES["inventory_texts"] = f"""SELECT c.run_id, length('{{"candidates":[' || items || '],"classifier":"{V.CLASSIFIER}","classifier_version":"1.0.0",'
    || '"discovery_method":"{V.DISCOVERY_METHOD}","discovery_method_version":"1.0.0","generated_at":"' || r.generated_at || '","input_digest":"'
    || i.input_digest || '","inventory_id":"' || i.inventory_id || '","output_digest":"' || i.output_digest || '","run_id":"' || c.run_id
    || '","schema_version":"1.0.0","sources":[' || items2 || '],"target_origin":"' || c.site || '"}}') AS characters
    FROM (SELECT run_id, site, string_agg({_candidate_json()}, ',') AS items FROM candidates GROUP BY run_id, site) c
    JOIN (SELECT run_id, string_agg('{{"candidate_count":' || candidate_count || ',"outcome":"' || outcome || '","source_id":"' || source_id || '"}}', ',') AS items2
      FROM counts GROUP BY run_id) s USING (run_id) JOIN inventories i USING (run_id) JOIN runs r USING (run_id)"""
CTES["manifest_texts"] = """SELECT m.run_id, length('{"budgets":{"max_selected_pages":5},"exclusions":[' || coalesce(e.items, '') || '],"generated_at":"' || r.generated_at || '"'
    || CASE WHEN m.incompleteness_cause IS NULL THEN '' ELSE ',"incompleteness":{"cause":"' || m.incompleteness_cause || '"}' END
    || ',"input_digest":"' || m.input_digest || '","inventory_output_digest":"' || m.inventory_output_digest || '","inventory_ref":"' || m.inventory_ref
    || '","mode":"CENSUS","output_digest":"' || m.output_digest || '","policy_id":"CENSUS_FIRST_DETERMINISTIC","policy_version":"1.0.0","run_id":"' || m.run_id
    || '","sampling_manifest_id":"' || m.sampling_manifest_id || '","schema_version":"1.0.0","selection_complete":' || m.selection_complete
    || ',"selections":[' || x.items || ']}') AS characters
    FROM b_manifests m JOIN runs r USING (run_id)
    LEFT JOIN (SELECT run_id, string_agg('{"candidate_count":' || candidate_count || ',"reason":"' || reason || '"}', ',') AS items FROM b_exclusions GROUP BY run_id) e USING (run_id)
    JOIN (SELECT run_id, string_agg('{"selection_rank":' || selection_rank || ',"selection_reason":"' || selection_reason || '","stratum":"' || stratum
      || '","url_key":"' || url_key || '"}', ',') AS items FROM b_selections GROUP BY run_id) x USING (run_id)"""


@register("inventory_documents", "SELECT run_id, CAST(characters AS BIGINT) AS characters FROM inventory_texts")
def inventory_documents(spark, sf_dir):
    found = _discovery(spark, sf_dir)
    headers = found.inventories.withColumn("site", F.col("target_origin"))
    return _characters(
        digests.inventory_fragments(headers, found.candidates, found.forms, found.sources, found.attempts, whole=True)
    )


@register("manifest_documents", "SELECT run_id, CAST(characters AS BIGINT) AS characters FROM manifest_texts")
def manifest_documents(spark, sf_dir):
    found = _discovery(spark, sf_dir)
    return _characters(digests.whole_manifest_fragments(found.manifests, found.selections, found.exclusions))


@register("receipt_differences", """SELECT run_id, 'receipt' AS document_type, 'missing' AS problem FROM records WHERE http_status = 404
    UNION ALL SELECT run_id, 'receipt', 'unexpected' FROM records WHERE http_status = 404""")
def receipt_differences(spark, sf_dir):
    """Receipts whose status was changed, against the ones the documents determine."""
    found, got = _acquisition(spark, sf_dir)
    derived = materialised(receipts.page_receipts(got.records, found.selections, got.measurements, got.evidence))
    stated = derived.withColumn("http_status", F.when(F.col("http_status") == 404, 200).otherwise(F.col("http_status")))
    return bundle.differences(derived, stated, "receipt")


@register("refused_final_urls", f"""SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'WITHHELD' WHEN 1 THEN 'NO_RESPONSE' ELSE 'READ' END AS document_status,
    CASE page_id % 3 WHEN 1 THEN 'INVALID_REDIRECT' ELSE 'RESPONSE_RECEIVED' END AS acquisition_outcome,
    CASE page_id % 3 WHEN 0 THEN '{V.WITHHELD_REASON}' END AS withheld_reason, CAST(CASE page_id % 3 WHEN 0 THEN 0 ELSE 13 END AS BIGINT) AS measurements
    FROM pages""")
def refused_final_urls(spark, sf_dir):
    """Responses whose final URL no document can carry, or that has no identity."""
    pid = F.col("page_id")
    final = F.when(pid % 3 == 0, F.concat("url", F.lit("#a b"))).when(
        pid % 3 == 1, F.replace("url", F.lit("://"), F.lit("://u@"))
    ).otherwise(F.col("url"))
    rows = inputs.site_pages(spark, sf_dir).select(
        pid.cast("string").alias("run_id"), "site", F.col("url").alias("requested_url"),
        F.lit(None).cast("string").alias("failure_kind"), final.alias("final_url"), F.lit(200).alias("status_code"),
        F.lit("text/html").alias("content_type"), F.array().cast("array<string>").alias("x_robots_tag"), F.lit(True).alias("is_https"),
        F.lit(0).alias("redirect_count"), F.encode("html", "UTF-8").alias("body"), F.lit(False).alias("truncated"),
        F.lit(False).alias("undecodable"), F.lit("utf-8").alias("declared_charset"), F.timestamp_seconds(pid).alias("captured_at"),
    )
    observed = materialised(observed_captures(rows))
    counted = measurements(observed).groupBy("run_id").agg(F.count("*").alias("measurements"))
    return observed.join(counted, "run_id", "left").select(
        F.col("run_id").cast("bigint").alias("page_id"), "document_status", "acquisition_outcome", "withheld_reason",
        F.coalesce("measurements", F.lit(0)).alias("measurements"),
    )


@register("bundle_differences", """SELECT run_id, 'measurements' AS document_type, 'missing' AS problem FROM placed WHERE page_id % 3 = 0
    UNION ALL SELECT run_id, 'measurements', 'unexpected' FROM placed WHERE page_id % 3 = 0
    UNION ALL SELECT run_id, 'sampling_manifest', 'unexpected' FROM heads WHERE page_id % 4 = 0
    UNION ALL SELECT run_id, 'sampling_manifest', 'not one document' FROM heads WHERE page_id % 4 = 0""")
def bundle_differences(spark, sf_dir):
    """A bundle written with some documents changed and some manifests doubled, read back."""
    t = _page_documents(spark, sf_dir)
    first = inputs.seeds(spark, sf_dir).select("run_id", "page_id")
    own = materialised(t["measurements"])
    expected = {"measurements": own, "sampling_manifest": t["manifests"]}
    changed = own.withColumn(
        "metric_id",
        F.when(F.regexp_extract("measurement_id", r"^m-(\d+)$", 1).try_cast("bigint") % 3 == 0, "CHANGED").otherwise(F.col("metric_id")),
    )
    doubled = t["manifests"].join(first, "run_id").where(F.col("page_id") % 4 == 0).drop("page_id")
    folder = f"{ensure_checkpoint_dir(spark)}/bundle-{uuid.uuid4().hex}"
    bundle.write_bundle(
        {"measurements": changed, "sampling_manifest": t["manifests"].unionByName(doubled)}, folder
    )
    return bundle.reconcile(spark, expected, folder)


@register("bundle_problems", """SELECT CASE WHEN k = 7 THEN 'other-' || run_id ELSE run_id END AS run_id, document_type, problem
    FROM (SELECT run_id, page_id % 8 AS k FROM runs) JOIN (VALUES
      (1, 'website_evidence', 'missing'), (1, 'receipt', 'does not summarise the documents beside it'),
      (2, 'measurements', 'changed'), (2, 'measurements', 'member collector_version changed'),
      (3, 'page_acquisitions', 'changed'), (3, 'page_acquisitions', 'member extra added'), (3, 'page_acquisitions', ' [additionalProperties]'),
      (4, 'page_acquisitions', 'changed'), (4, 'page_acquisitions', 'member observation_mode missing'), (4, 'page_acquisitions', ' [required]'),
      (4, 'page_documents', 'record_declares_this_producer'), (5, 'measurements', 'repeated'),
      (6, 'website_evidence', 'changed'), (6, 'website_evidence', ' [json]'), (6, 'receipt', 'does not summarise the documents beside it'),
      (7, 'page_acquisitions', 'unexpected'), (7, 'page_acquisitions', 'belongs to no run of the bundle'), (7, 'page_documents', 'record_binds_manifest'),
      (7, 'page_documents', 'refs_name_a_measurement'), (7, 'receipt', 'does not summarise the documents beside it')) v(k, document_type, problem) USING (k)
    UNION ALL SELECT NULL, 'notes', 'not part of this bundle'""")
def bundle_problems(spark, sf_dir):
    """The page documents of all sites in a bundle, one kind of damage per remainder of a site's first page."""
    found, got = _acquisition(spark, sf_dir)
    written = {name: materialised(lines) for name, lines in readback.page_bundle(got, found.selections).items()}
    kinds = inputs.seeds(spark, sf_dir).select(F.col("run_id").alias("of"), (F.col("page_id") % 8).alias("k"))
    value = F.col("value")
    member = F.regexp_extract("value", '"run_id":"([^"]*)"', 1)

    def damaged(name, *changes):
        rows = written[name].withColumn("of", member).join(kinds, "of")
        for k, new in changes:
            rows = rows.withColumn("value", F.when(F.col("k") == k, new).otherwise(value))
        return rows.where("value is not null").select("value", "of", "k")

    records = damaged(
        "page_acquisitions", (3, F.concat(F.substring(value, F.lit(1), F.length(value) - 1), F.lit(',"extra":1}'))),
        (4, F.replace(value, F.lit(f',"observation_mode":"{V.OBSERVATION_MODE}"'), F.lit(""))),
    )
    strangers = records.where("k = 7").withColumn("value", F.replace(value, F.concat(F.lit('"run_id":"'), "of"), F.concat(F.lit('"run_id":"other-'), "of")))
    measured = damaged("measurements", (2, F.replace(value, F.lit('"collector_version":"1.0.0"'), F.lit('"collector_version":"9.9.9"'))))
    evidence = damaged("website_evidence", (1, F.lit(None).cast("string")), (6, F.substring(value, F.lit(1), F.length(value) - 1)))
    lying = {
        "page_acquisitions": records.unionByName(strangers), "measurements": measured.unionByName(measured.where("k = 5")),
        "website_evidence": evidence, "receipt": written["receipt"], "notes": spark.range(1).select(F.lit("x").alias("value")),
    }
    folder = f"{ensure_checkpoint_dir(spark)}/bundle-{uuid.uuid4().hex}"
    for name, rows in lying.items():
        rows.select("value").write.text(f"{folder}/{name}")
    return readback.bundle_problems(written, found.manifests, found.selections, folder)


@register("published_bundles", """SELECT CASE WHEN r.page_id % 2 = 0 THEN '2026-01-01' ELSE '2026-01-02' END AS run_date, r.run_id, count(*) AS observations
    FROM page_observations o JOIN runs r USING (run_id) GROUP BY ALL""")
def published_bundles(spark, sf_dir):
    """The observations of all sites, published in two runs on two dates, read as one table."""
    root = f"{ensure_checkpoint_dir(spark)}/archive-{uuid.uuid4().hex}"
    rows = inputs.page_observations(spark, sf_dir).join(inputs.seeds(spark, sf_dir).select("run_id", "page_id"), "run_id")
    for remainder, day in ((0, "2026-01-01"), (1, "2026-01-02")):
        archive.publish({"observations": rows.where(F.col("page_id") % 2 == remainder).drop("page_id")}, root, day, "sites")
    found = archive.read_archive(spark, root, "observations", "run_id string, observed_form string")
    return found.groupBy("run_date", "run_id").agg(F.count("*").alias("observations"))


_TEXTS = """CASE page_id % 5 WHEN 0 THEN '{"run_id":"' || page_id || '","n":1}' WHEN 1 THEN '{"run_id":"' || page_id || '","n":NaN}'
    WHEN 2 THEN '{"run_id":"' || page_id WHEN 3 THEN '{"run_id":"' || page_id || '"}' ELSE '{"run_id":"' || page_id || '"} x' END"""


def _json_lines(spark, sf_dir):
    return inputs.pages(spark, sf_dir).select("page_id", F.expr(_TEXTS).alias("text"))


@register("json_documents", """SELECT page_id, CAST(page_id AS VARCHAR) AS run_id, CAST(CASE WHEN page_id % 5 = 0 THEN 1 END AS BIGINT) AS n
    FROM pages WHERE page_id % 5 IN (0, 3)""")
def json_documents(spark, sf_dir):
    found = split_documents(_json_lines(spark, sf_dir), "text", "run_id string, n bigint")[0]
    return found.select("page_id", "document.run_id", "document.n")


@register("json_quarantine", f"SELECT page_id, {_TEXTS} AS text FROM pages WHERE page_id % 5 NOT IN (0, 3)")
def json_quarantine(spark, sf_dir):
    return split_documents(_json_lines(spark, sf_dir), "text", "run_id string, n bigint")[1]


@F.arrow_udf(T.BinaryType())
def _wire(body: pa.Array, kind: pa.Array) -> pa.Array:
    """Bodies as a server would send them: plain, gzip or deflate."""
    pack = {1: gzip.compress, 2: zlib.compress}
    return in_slices(lambda b, k: pack.get(k, bytes)(b), pa.binary(), body, kind)


@register("capture_normalisation", """SELECT page_id, CASE WHEN page_id % 4 = 3 THEN 'sha256-of-empty' ELSE sha256(html) END AS body_digest,
    page_id % 4 = 3 AS undecodable, 'utf-8' AS declared_charset, starts_with(url, 'https://') AS is_https FROM pages""")
def capture_normalisation(spark, sf_dir):
    """Pages as plain, gzip and deflate wire bytes, and one encoding nobody can undo."""
    pid = F.col("page_id")
    raw = inputs.pages(spark, sf_dir).select(
        pid.cast("string").alias("run_id"), F.lit("").alias("site"), F.col("url").alias("requested_url"),
        F.lit(None).cast("string").alias("failure_kind"), F.col("url").alias("final_url"), F.lit(200).alias("status_code"),
        F.lit('text/html; Charset="utf-8"').alias("content_type"),
        F.get(F.array(F.lit(None), F.lit(" GZip"), F.lit("deflate"), F.lit("br")), (pid % 4).cast("int")).alias("content_encoding"),
        F.array().cast("array<string>").alias("x_robots_tag"), F.lit(0).alias("redirect_count"),
        _wire(F.encode("html", "UTF-8"), (pid % 4).cast("int")).alias("wire_body"), F.current_timestamp().alias("captured_at"),
    )
    found = normalise_captures(raw)
    return found.select(
        F.col("run_id").cast("bigint").alias("page_id"),
        F.when(F.length("body") == 0, "sha256-of-empty").otherwise(F.sha2("body", 256)).alias("body_digest"),
        "undecodable", "declared_charset", "is_https",
    )
