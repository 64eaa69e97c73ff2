"""Explicit schemas of the working tables; nothing is ever inferred."""

CAPTURE = """
    run_id string, site string, requested_url string, failure_kind string, final_url string,
    status_code int, content_type string, x_robots_tag array<string>, is_https boolean,
    redirect_count int, body binary, truncated boolean, undecodable boolean,
    declared_charset string, captured_at timestamp
"""
RESPONSE_COLUMNS = [
    "final_url", "status_code", "content_type", "x_robots_tag", "is_https", "redirect_count",
    "body", "truncated", "undecodable", "declared_charset",
]
RAW_CAPTURE = """
    run_id string, site string, requested_url string, failure_kind string, final_url string,
    status_code int, content_type string, content_encoding string, x_robots_tag array<string>,
    redirect_count int, wire_body binary, captured_at timestamp
"""
OBSERVATION = "run_id string, site string, observed_form string, source_id string, label string"
SOURCE_ATTEMPT = "run_id string, site string, source_id string, outcome string"
REQUEST = """
    run_id string, request_id string, requested_at timestamp, target_url string,
    scan_mode string, requester_ref string
"""
ASSESSMENT = "struct<collection_mode:string,result_state:string,not_assessed_reason:string>"
RESULT = (
    "struct<value_type:string,boolean_value:boolean,integer_value:bigint,"
    "text_value:string,url_value:string>"
)
MEASUREMENT = f"""
    run_id string, url_key string, measurement_no int, measurement_id string, metric_id string,
    source_url string, observed_at string, collector string, collector_version string,
    assessment {ASSESSMENT}, result {RESULT}
"""
EVIDENCE = f"""
    run_id string, evidence_id string, source_url string, observed_at string, scenario string,
    collector string, collector_version string, assessment {ASSESSMENT}, polarity string,
    measurement_refs array<string>
"""
