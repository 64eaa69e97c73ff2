"""Structural queries: every page yields one document per type, broken in a way its id decides."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from pagecensus.catalog import inputs
from pagecensus.catalog.queries import register
from pagecensus.operators.quality.structure import structural_violations

TIME, DIGEST = "2026-01-01T00:00:00Z", "sha256:" + "a" * 64
_CONTEXT = {
    "schema_version": "1.0.0", "run_id": "run-@ID", "source_url": "@URL", "observed_at": TIME, "collector": "COLLECTOR",
    "collector_version": "1.0.0", "assessment": {"collection_mode": "OBSERVED", "result_state": "KNOWN"},
}
BASE = {
    "analysis-run-request": {
        "schema_version": "1.0.0", "run_id": "run-@ID", "request_id": "q", "requested_at": TIME, "target_url": "@URL",
        "scan_mode": "PUBLIC_NON_INVASIVE",
    },
    "analysis-run-state": {
        "schema_version": "1.0.0", "run_id": "run-@ID", "state": "FAILED", "entered_at": TIME, "finished_at": TIME,
        "failure": {"code": "X1"},
    },
    "stage-execution-record": {
        "schema_version": "1.0.0", "run_id": "run-@ID", "stage_id": "PAGE_FETCH", "status": "SUCCEEDED",
        "started_at": TIME, "finished_at": TIME,
    },
    "measurement-record": {
        **_CONTEXT, "measurement_id": "m-@ID", "metric_id": "HTTP_STATUS",
        "result": {"value_type": "INTEGER", "integer_value": 200},
    },
    "website-evidence": {**_CONTEXT, "evidence_id": "e-@ID", "scenario": "FETCH", "measurement_refs": ["m-@ID"]},
    "diagnostic-finding": {
        "schema_version": "1.0.0", "run_id": "run-@ID", "finding_id": "f", "rule_id": "R1", "rule_version": "1.0.0",
        "finding_class": "C1", "evidence_refs": ["e-@ID"], "finding_summary": "a b", "business_impact": "b",
        "recommended_action": "c", "limitation": "d",
    },
    "site-inventory": {
        "schema_version": "1.0.0", "run_id": "run-@ID", "inventory_id": "i", "generated_at": TIME,
        "target_origin": "https://s.example/", "discovery_method": "DM", "discovery_method_version": "1",
        "classifier": "CL", "classifier_version": "1",
        "sources": [{"source_id": "S1", "outcome": "USED", "candidate_count": 1}],
        "candidates": [{"url_key": "@URL", "observed_forms": ["@URL"], "provenance": ["S1"], "eligibility": {"state": "ELIGIBLE"}}],
        "input_digest": DIGEST, "output_digest": DIGEST,
    },
    "sampling-manifest": {
        "schema_version": "1.0.0", "run_id": "run-@ID", "sampling_manifest_id": "s", "generated_at": TIME,
        "inventory_ref": "i", "inventory_output_digest": DIGEST, "policy_id": "P1", "policy_version": "1",
        "budgets": {"max_selected_pages": 5}, "mode": "CENSUS", "selection_complete": False,
        "incompleteness": {"cause": "SELECTION_BUDGET_EXHAUSTED"},
        "selections": [{"url_key": "@URL", "selection_rank": 1, "selection_reason": "SEED", "stratum": "OFFER"}],
        "exclusions": [{"reason": "INELIGIBLE_IN_INVENTORY", "candidate_count": 2}],
        "input_digest": DIGEST, "output_digest": DIGEST,
    },
    "page-acquisition-record": {
        "schema_version": "1.0.0", "run_id": "run-@ID", "acquisition_id": "a", "sampling_manifest_ref": "s",
        "sampling_manifest_output_digest": DIGEST, "url_key": "@URL", "observation_mode": "STATIC_HTTP",
        "acquisition_method": "AM", "acquisition_method_version": "1", "acquired_at": TIME,
        "acquisition_outcome": "RESPONSE_RECEIVED", "http_status": 200, "final_url_key": "@URL", "redirect_count": 0,
        "body_truncated": False, "body_decoded": True, "body_digest": DIGEST, "measurement_refs": ["m-@ID"],
    },
    "problem": {
        "schema_version": "1.0.0", "code": "C1", "title": "t", "detail": "d @ID",
        "errors": [{"pointer": "/a", "keyword": "type"}],
    },
}
_VERSION = ('"schema_version":"1.0.0"', '"schema_version":"2.0.0"', [("/schema_version", "const")])
# (text, replacement, violations) per document type; the first document of each cycle is valid.
BREAKS = {
    "analysis-run-request": [
        _VERSION, ('"request_id":"q",', "", [("", "required")]), ('"request_id":"q"', '"request_id":""', [("/request_id", "minLength"), ("/request_id", "pattern")]),
        ('"PUBLIC_NON_INVASIVE"', '"LOUD"', [("/scan_mode", "enum")]), ('"request_id":"q"', '"request_id":7', [("/request_id", "type")]),
        ('"scan_mode"', '"extra":1,"scan_mode"', [("", "additionalProperties")]), ('"@URL"', '"ftp://s.example/"', [("/target_url", "pattern")]),
        (TIME, "2026-13-01T00:00:00Z", [("/requested_at", "pattern")]), ("{", "", [("", "json")]), ('"q"', "NaN", [("", "json")]),
    ],
    "analysis-run-state": [
        _VERSION, ('"FAILED"', '"RUNNING"', [("", "not"), ("", "not")]), (f',"finished_at":"{TIME}"', "", [("", "required")]),
        (',"failure":{"code":"X1"}', "", [("", "required")]), ('"X1"', '"x"', [("/failure/code", "minLength"), ("/failure/code", "pattern")]),
        ('{"code":"X1"}', '"X1"', [("/failure", "type")]), ('"FAILED"', '"SUCCEEDED"', [("", "not")]), ('"FAILED"', "null", [("/state", "type"), ("/state", "enum"), ("", "not"), ("", "not")]),
    ],
    "stage-execution-record": [
        _VERSION, ('"SUCCEEDED"', '"RUNNING"', [("", "not")]), (f',"finished_at":"{TIME}"', "", [("", "required")]),
        ('"PAGE_FETCH"', '"page"', [("/stage_id", "pattern")]), ('"SUCCEEDED"', '"DONE"', [("/status", "enum"), ("", "not")]),
    ],
    "measurement-record": [
        _VERSION, (',"result":{"value_type":"INTEGER","integer_value":200}', "", [("", "required")]),
        ('"KNOWN"', '"UNKNOWN"', [("", "not")]), ('"integer_value":200', '"integer_value":200.5', [("/result/integer_value", "type")]),
        ('"integer_value":200', '"text_value":"x"', [("/result", "required"), ("/result", "not")]), ('"integer_value":200', '"integer_value":2e2', []),
        ('{"collection_mode":"OBSERVED","result_state":"KNOWN"}', '{"not_assessed_reason":"TIMEOUT"}', [("", "not")]),
        ('"collection_mode":"OBSERVED",', '"not_assessed_reason":"TIMEOUT",', [("/assessment", "not")]),
        ('"collection_mode":"OBSERVED",', "", [("/assessment", "required")]), ('"OBSERVED"', '"SEEN"', [("/assessment/collection_mode", "enum")]),
        ('"INTEGER"', '"FLOAT"', [("/result/value_type", "enum"), ("/result", "not")]),
    ],
    "website-evidence": [
        _VERSION, ('["m-@ID"]', "[]", [("/measurement_refs", "minItems")]), ('["m-@ID"]', '["a","a"]', [("/measurement_refs", "uniqueItems")]),
        ('["m-@ID"]', '["a",1," b"]', [("/measurement_refs/1", "type"), ("/measurement_refs/2", "pattern")]),
        ('"scenario"', '"polarity":"NEGATIVE","scenario"', []), ('"scenario"', '"polarity":"BAD","scenario"', [("/polarity", "enum")]),
        ('"KNOWN"}', '"UNKNOWN"},"polarity":"NEGATIVE"', [("", "not")]), ('["m-@ID"]', '"m"', [("/measurement_refs", "type")]),
    ],
    "diagnostic-finding": [
        _VERSION, ('["e-@ID"]', "[]", [("/evidence_refs", "minItems")]), ('"a b"', '"a\\nb"', [("/finding_summary", "pattern")]),
        ('"a b"', '" a"', [("/finding_summary", "pattern")]), ('"a b"', f'"{"x" * 501}"', [("/finding_summary", "maxLength")]),
        ('"finding_id":"f"', f'"finding_id":"{"x" * 501}"', [("/finding_id", "maxLength"), ("/finding_id", "maxLength")]),
    ],
    "site-inventory": [
        _VERSION, ('"USED"', '"ABSENT"', [("/sources/0/candidate_count", "const")]), ('"candidate_count":1', '"candidate_count":-1', [("/sources/0/candidate_count", "minimum")]),
        ('{"state":"ELIGIBLE"}', '{"state":"EXCLUDED"}', [("/candidates/0/eligibility", "required")]),
        ('{"state":"ELIGIBLE"}', '{"state":"ELIGIBLE","exclusion_reason":"OFF_ORIGIN"}', [("/candidates/0/eligibility", "not")]),
        ('["S1"]', '["s1"]', [("/candidates/0/provenance/0", "pattern")]), ('["S1"]', "[]", [("/candidates/0/provenance", "minItems")]),
        ('["@URL"]', '["@URL","@URL"]', [("/candidates/0/observed_forms", "uniqueItems")]), ("https://s.example/\"", "https://s.example/a\"", [("/target_origin", "pattern")]),
        ('[{"source_id":"S1","outcome":"USED","candidate_count":1}]', "[]", [("/sources", "minItems")]), ('"input_digest":"sha256:a', '"input_digest":"sha256:A', [("/input_digest", "pattern")]),
        ('["@URL"]', '["HTTPS://s.example/"]', [("/candidates/0/observed_forms/0", "pattern")]),
    ],
    "sampling-manifest": [
        _VERSION, ('"budgets":{"max_selected_pages":5},', "", [("", "required")]), ('{"max_selected_pages":5}', "{}", [("/budgets", "minProperties")]),
        ('"selection_complete":false', '"selection_complete":true', [("", "not")]), ('"incompleteness":{"cause":"SELECTION_BUDGET_EXHAUSTED"},', "", [("", "required")]),
        ('"selection_rank":1', '"selection_rank":0', [("/selections/0/selection_rank", "minimum")]), ('"SEED"', '"LUCK"', [("/selections/0/selection_reason", "enum")]),
        ('"candidate_count":2', '"candidate_count":0', [("/exclusions/0/candidate_count", "minimum")]), ('"stratum":"OFFER"', '"stratum":"offer"', [("/selections/0/stratum", "pattern")]),
        ('"mode":"CENSUS"', '"mode":"ALL"', [("/mode", "enum")]), ('"max_selected_pages":5', '"max_selected_pages":true', [("/budgets/max_selected_pages", "type")]),
    ],
    "page-acquisition-record": [
        _VERSION, ('"http_status":200,', "", [("", "required")]), ('"RESPONSE_RECEIVED"', '"TIMEOUT"', [("", "not")]),
        ('"body_decoded":true', '"body_decoded":false', [("", "not")]), (f',"body_digest":"{DIGEST}"', "", [("", "required")]),
        ('["m-@ID"]', "[]", [("", "required")]), ('["m-@ID"]', '["m-@ID"],"measurements_withheld_reason":"SOURCE_URL_NOT_REPRESENTABLE"', [("", "not")]),
        ('"http_status":200', '"http_status":99', [("/http_status", "minimum")]), ('"http_status":200', '"http_status":1000', [("/http_status", "maximum")]),
        ('"redirect_count":0', '"redirect_count":"0"', [("/redirect_count", "type")]), ('"STATIC_HTTP"', '"OTHER"', [("/observation_mode", "enum")]),
    ],
    "problem": [
        _VERSION, ('"keyword":"type"', '"keyword":"a b"', [("/errors/0/keyword", "pattern")]), ('"pointer":"/a"', '"pointer":"a"', [("/errors/0/pointer", "pattern")]),
        ('{"pointer":"/a","keyword":"type"}', ",".join(['{"pointer":"/a","keyword":"type"}'] * 51), [("/errors", "maxItems")]),
        ('"title":"t"', f'"title":"{"x" * 121}"', [("/title", "maxLength")]), ('"pointer":"/a",', "", [("/errors/0", "required")]),
    ],
}


def _documents(spark, sf_dir, contract):
    """One JSON text per page: the base document, broken by the page id."""
    base = json.dumps(BASE[contract], separators=(",", ":"))
    texts = [base, *[base.replace(old, new) for old, new, _ in BREAKS[contract]]]
    pid = F.col("page_id")
    text = F.get(F.array(*[F.lit(t) for t in texts]), (pid % len(texts)).cast("int"))
    text = F.replace(F.replace(text, F.lit("@ID"), pid.cast("string")), F.lit("@URL"), F.col("url_key"))
    return inputs.site_pages(spark, sf_dir).select(pid.cast("string").alias("run_id"), text.alias("text"))


def _expected(contract):
    cases = BREAKS[contract]
    rows = [(no, p, k) for no, (_, _, found) in enumerate(cases, start=1) for p, k in found]
    listed = ", ".join(f"({no}, '{p}', '{k}')" for no, p, k in rows)
    return f"""SELECT CAST(page_id AS VARCHAR) AS run_id, pointer, keyword FROM pages
        JOIN (VALUES {listed}) v(no, pointer, keyword) ON page_id % {len(cases) + 1} = no"""


def _query(contract):
    def query(spark, sf_dir):
        return structural_violations(_documents(spark, sf_dir, contract), contract)

    return query


for _contract in BASE:
    register("structure_" + _contract.replace("-", "_"), _expected(_contract))(_query(_contract))
