"""The registered queries: each reads the given tables and runs one job over all of them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagecensus.catalog import inputs
from pagecensus.catalog.oracle import sql, sql_id, sql_key, sql_origin
from pagecensus.functions import fixed_values as V
from pagecensus.functions.columns import is_contract_url
from pagecensus.functions.url import is_page_resource, with_url_identity
from pagecensus.operators import census, inventory
from pagecensus.operators.observation import observe_pages, page_links
from pagecensus.plans.acquisition import acquire, analyse_homepages, observed_captures
from pagecensus.plans.discovery import discover, established_runs, seed_observations
from pagecensus.sources.captures import with_failure_tokens, with_header_fields

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def register(name: str, oracle: str | None = None):
    def add(query: Query) -> Query:
        QUERIES[name] = query
        if oracle is not None:
            ORACLE[name] = sql(oracle)
        return query

    return add


def joined(column: str):
    """An array column as text, for comparison."""
    return F.array_join(column, "|").alias(column)


def flat_measurements(measured: DataFrame) -> DataFrame:
    return measured.select(
        "run_id", "url_key", F.col("measurement_no").cast("bigint").alias("measurement_no"),
        "measurement_id", "metric_id", "source_url", "observed_at", "collector", "assessment.*", "result.*",
    )


# --- identity and scans -------------------------------------------------------------------------

@register("url_identity", f"SELECT page_id, url, {sql_key('url')} AS url_key, CAST(NULL AS VARCHAR) AS url_refusal, "
          f"{sql_origin('url')} AS origin FROM pages")
def url_identity(spark, sf_dir):
    return with_url_identity(inputs.pages(spark, sf_dir).select("page_id", "url"), "url")


@register("capture_headers", """SELECT run_id, requested_url, failure_kind, content_type,
    lower(split_part(content_type, ';', 1)) AS media_type, nullif(split_part(content_type, 'charset=', 2), '') AS charset
    FROM captures""")
def capture_headers(spark, sf_dir):
    found = with_header_fields(inputs.captures(spark, sf_dir))
    return found.select("run_id", "requested_url", "failure_kind", "content_type", "media_type", "charset")


@register("page_links", "SELECT page_url, pos, href, label FROM links")
def links(spark, sf_dir):
    found = page_links(inputs.link_captures(spark, sf_dir))
    return found.select("page_url", F.col("pos").cast("bigint").alias("pos"), "href", "label")


@register("seed_observations", """SELECT run_id, site, site AS observed_form, 'CANONICAL_SEED' AS source_id,
    CAST(NULL AS VARCHAR) AS label FROM runs""")
def seeds(spark, sf_dir):
    return seed_observations(inputs.runs(spark, sf_dir))


# --- inventory ----------------------------------------------------------------------------------

@register("observation_union", """SELECT source_id, count(*) AS observations, count(DISTINCT observed_form) AS forms,
    count(label) AS labelled FROM observations GROUP BY source_id""")
def observation_union(spark, sf_dir):
    return inputs.observations(spark, sf_dir).groupBy("source_id").agg(
        F.count("*").alias("observations"), F.countDistinct("observed_form").alias("forms"),
        F.count("label").alias("labelled"),
    )


@register("admitted_observations", "SELECT run_id, site, observed_form, source_id, label, url_key FROM admitted")
def admitted(spark, sf_dir):
    return inventory.admitted_observations(inputs.observations(spark, sf_dir)).select(
        "run_id", "site", "observed_form", "source_id", "label", "url_key"
    )


@register("inventory_candidates", """SELECT run_id, site, url_key, eligibility_state, exclusion_reason, page_type
    FROM candidates""")
def candidates(spark, sf_dir):
    found = inventory.admitted_observations(inputs.observations(spark, sf_dir))
    return inventory.candidates(found).select(
        "run_id", "site", "url_key", "eligibility_state", "exclusion_reason", "page_type"
    )


@register("candidate_forms", "SELECT run_id, url_key, unnest(forms) AS observed_form FROM candidates")
def candidate_forms(spark, sf_dir):
    found = inventory.admitted_observations(inputs.observations(spark, sf_dir))
    return inventory.candidate_forms(found).drop("site")


@register("candidate_sources", "SELECT run_id, url_key, unnest(sources) AS source_id FROM candidates")
def candidate_sources(spark, sf_dir):
    found = inventory.admitted_observations(inputs.observations(spark, sf_dir))
    return inventory.candidate_sources(found).drop("site")


@register("source_counts", "SELECT run_id, source_id, outcome, candidate_count FROM counts")
def source_counts(spark, sf_dir):
    found = inventory.admitted_observations(inputs.observations(spark, sf_dir))
    return inventory.source_counts(
        inputs.attempts(spark, sf_dir), inventory.candidate_sources(found)
    ).select("run_id", "source_id", "outcome", "candidate_count")


@register("same_origin_pages", f"""SELECT DISTINCT run_id, url_key FROM admitted
    WHERE {sql_origin('url_key')} = site
      AND regexp_extract(lower(regexp_extract(url_key, '^https?://[^/?]*([^?]*)', 1)), '[^/](\\.[^./]*)$', 1)
      NOT IN ('.pdf')""")
def same_origin_pages(spark, sf_dir):
    found = inventory.admitted_observations(inputs.observations(spark, sf_dir))
    return found.where((F.col("origin") == F.col("site")) & is_page_resource(F.col("url_key"))).select(
        "run_id", "url_key"
    ).distinct()


@register("non_idempotent_keys", "SELECT run_id, url_key FROM admitted WHERE false")
def non_idempotent_keys(spark, sf_dir):
    found = inventory.admitted_observations(inputs.observations(spark, sf_dir))
    return inventory.non_idempotent_keys(found.select("run_id", "url_key").distinct()).select("run_id", "url_key")


# --- census -------------------------------------------------------------------------------------

def _candidates(spark, sf_dir):
    return inventory.candidates(inventory.admitted_observations(inputs.observations(spark, sf_dir)))


@register("census_budgeted", "SELECT run_id, url_key, selection_rank, selection_reason, stratum FROM b_selections")
def census_budgeted(spark, sf_dir):
    return census.selections(_candidates(spark, sf_dir), 5).drop("site")


@register("census_complete", "SELECT run_id, url_key, selection_rank, selection_reason, stratum FROM selections")
def census_complete(spark, sf_dir):
    return census.selections(_candidates(spark, sf_dir)).drop("site")


@register("census_completeness", """SELECT run_id, candidate_count, selected_count, ineligible_count, left_by_budget,
    selection_complete, incompleteness_cause FROM b_summary""")
def census_completeness(spark, sf_dir):
    return census.plan_summary(_candidates(spark, sf_dir), 5).drop("site", "max_selected_pages")


@register("census_exclusions", "SELECT run_id, reason, candidate_count FROM b_exclusions")
def census_exclusions(spark, sf_dir):
    return census.exclusions(census.plan_summary(_candidates(spark, sf_dir), 5))


def _discovery(spark, sf_dir, budget=5):
    return discover(
        inputs.runs(spark, sf_dir), inputs.observations(spark, sf_dir), inputs.attempts(spark, sf_dir), budget
    )


@register("inventory_digests", "SELECT run_id, inventory_id, input_digest, output_digest FROM inventories")
def inventory_digests(spark, sf_dir):
    return _discovery(spark, sf_dir).inventories.select("run_id", "inventory_id", "input_digest", "output_digest")


@register("manifest_digests", """SELECT run_id, sampling_manifest_id, inventory_ref, inventory_output_digest,
    selection_complete, incompleteness_cause, selected_count, input_digest, output_digest FROM b_manifests""")
def manifest_digests(spark, sf_dir):
    return _discovery(spark, sf_dir).manifests.select(
        "run_id", "sampling_manifest_id", "inventory_ref", "inventory_output_digest", "selection_complete",
        "incompleteness_cause", "selected_count", "input_digest", "output_digest",
    )


# --- observation and measurement ----------------------------------------------------------------

@register("failure_tokens", """SELECT run_id, requested_url, failure_kind,
    CASE failure_kind WHEN 'TIMEOUT' THEN 'TIMEOUT' WHEN 'DNS_FAILURE' THEN 'PROVIDER_FAILURE'
      WHEN 'BLOCKED_TARGET' THEN 'PERMISSION_DENIED' END AS not_assessed_reason,
    CASE WHEN failure_kind = 'TIMEOUT' THEN 'TIMEOUT' WHEN failure_kind = 'BLOCKED_TARGET' THEN 'TARGET_POLICY_REFUSED'
      WHEN failure_kind = 'DNS_FAILURE' OR status_code = 503 THEN 'PROVIDER_FAILURE'
      WHEN status_code = 404 THEN 'ABSENT' END AS source_outcome,
    CASE failure_kind WHEN 'TIMEOUT' THEN 'TIMEOUT' WHEN 'DNS_FAILURE' THEN 'UNREACHABLE'
      WHEN 'BLOCKED_TARGET' THEN 'TARGET_REFUSED' END AS bootstrap_failure,
    CASE failure_kind WHEN 'TIMEOUT' THEN 'SITE_DISCOVERY_TIMEOUT' WHEN 'DNS_FAILURE' THEN 'SITE_DISCOVERY_TARGET_UNREACHABLE'
      WHEN 'BLOCKED_TARGET' THEN 'TARGET_NOT_PERMITTED' END AS discovery_failure_code,
    CASE WHEN failure_kind = 'BLOCKED_TARGET' THEN 'TARGET_NOT_PERMITTED' WHEN failure_kind IS NOT NULL
      THEN 'PAGE_FETCH_FAILED' END AS homepage_failure_code
    FROM captures""")
def failure_tokens(spark, sf_dir):
    return with_failure_tokens(inputs.captures(spark, sf_dir)).select(
        "run_id", "requested_url", "failure_kind", "not_assessed_reason", "source_outcome",
        "bootstrap_failure", "discovery_failure_code", "homepage_failure_code",
    )


@register("established_sites", """SELECT run_id, site FROM seed_captures WHERE failure_kind IS NULL""")
def established_sites(spark, sf_dir):
    return established_runs(inputs.seed_captures(spark, sf_dir))[0].select("run_id", "site")


@register("failed_bootstraps", """SELECT run_id,
    CASE failure_kind WHEN 'TIMEOUT' THEN 'TIMEOUT' WHEN 'DNS_FAILURE' THEN 'UNREACHABLE' ELSE 'TARGET_REFUSED' END AS bootstrap_failure,
    CASE failure_kind WHEN 'TIMEOUT' THEN 'SITE_DISCOVERY_TIMEOUT' WHEN 'DNS_FAILURE' THEN 'SITE_DISCOVERY_TARGET_UNREACHABLE'
      ELSE 'TARGET_NOT_PERMITTED' END AS failure_code
    FROM seed_captures WHERE failure_kind IS NOT NULL""")
def failed_bootstraps(spark, sf_dir):
    return established_runs(inputs.seed_captures(spark, sf_dir))[1]


@register("page_observations", """SELECT run_id, requested_url, document_status, title, meta_noindex, header_noindex,
    CASE WHEN NOT undecodable THEN 'sha256:' || sha256(html) END AS body_digest FROM observed""")
def page_observations(spark, sf_dir):
    found = observe_pages(inputs.captures(spark, sf_dir), requested="requested_url")
    title = F.when(F.col("page.title").isNotNull(), F.trim(F.regexp_replace("page.title", r"\s+", " ")))
    return found.select(
        "run_id", "requested_url", "document_status", title.alias("title"), "meta_noindex", "header_noindex",
        "body_digest",
    )


@register("indexability", """SELECT run_id, requested_url, array_to_string(x_robots_tag, '|') AS x_robots_tag,
    array_to_string(line_verdicts, '|') AS line_verdicts, header_noindex, meta_noindex,
    CASE WHEN header_noindex IS NULL THEN NULL WHEN 'PRESENT' IN (meta_noindex, header_noindex) THEN 'PRESENT'
      WHEN meta_noindex IN ('INDETERMINATE', 'UNASSESSED') OR header_noindex = 'INDETERMINATE' THEN 'INDETERMINATE'
      ELSE 'ABSENT' END AS combined_noindex
    FROM home_observed""")
def indexability(spark, sf_dir):
    from pagecensus.functions.indexability import line_verdicts

    found = observe_pages(inputs.homepage_captures(spark, sf_dir), requested="requested_url", homepage=True)
    return found.withColumn("line_verdicts", line_verdicts(F.col("x_robots_tag"))).select(
        "run_id", "requested_url", joined("x_robots_tag"), joined("line_verdicts"), "header_noindex",
        "meta_noindex", "combined_noindex",
    )


def _acquisition(spark, sf_dir):
    found = discover(
        inputs.runs(spark, sf_dir), inputs.page_observations(spark, sf_dir),
        inputs.page_attempts(spark, sf_dir),
    )
    captured = inputs.captures(spark, sf_dir).unionByName(inputs.seed_captures(spark, sf_dir))
    return found, acquire(found.selections, captured, found.manifests)


@register("page_measurements", "SELECT * FROM measured")
def page_measurements(spark, sf_dir):
    return flat_measurements(_acquisition(spark, sf_dir)[1].measurements)


@register("homepage_measurements", "SELECT * FROM home_measured")
def homepage_measurements(spark, sf_dir):
    return flat_measurements(analyse_homepages(inputs.homepage_captures(spark, sf_dir)).measurements)


def flat_evidence(mirrored: DataFrame) -> DataFrame:
    return mirrored.select(
        "run_id", "evidence_id", "source_url", "observed_at", "scenario", "collector", "assessment.*",
        "polarity", joined("measurement_refs"),
    )


_EVIDENCE = f"""SELECT run_id, {{id}} AS evidence_id, source_url, observed_at, '{{scenario}}' AS scenario, collector,
    collection_mode, result_state, not_assessed_reason, CAST(NULL AS VARCHAR) AS polarity,
    measurement_id AS measurement_refs FROM {{table}}"""


@register("homepage_evidence", _EVIDENCE.format(
    id=sql_id("e", "measurement_id"), scenario=V.HOMEPAGE_SCENARIO, table="home_measured"))
def homepage_evidence(spark, sf_dir):
    return flat_evidence(analyse_homepages(inputs.homepage_captures(spark, sf_dir)).evidence)


@register("findings", f"""SELECT run_id, {sql_id('f', 'rule_id', 'evidence_id')} AS finding_id, rule_id, finding_class,
    evidence_id AS evidence_refs, finding_summary, business_impact, recommended_action, limitation
    FROM (SELECT *, {sql_id('e', 'measurement_id')} AS evidence_id FROM home_measured) m
    JOIN (VALUES {", ".join("(" + ", ".join("'" + str(r[k]).replace("'", "''") + "'" for k in (
        "rule_id", "finding_class", "metric_id", "finding_summary", "business_impact", "recommended_action",
        "limitation")) + ")" for r in V.FINDING_RULES)})
      r(rule_id, finding_class, metric_id, finding_summary, business_impact, recommended_action, limitation)
    USING (metric_id)
    WHERE result_state = 'KNOWN' AND ((rule_id = 'HTTP_ERROR_RESPONSE' AND integer_value >= 400)
      OR (rule_id IN ('NON_HTTPS_FINAL_TRANSPORT', 'MISSING_HOMEPAGE_TITLE') AND NOT boolean_value)
      OR (rule_id = 'HOMEPAGE_EXPLICIT_NOINDEX' AND boolean_value))""")
def homepage_findings(spark, sf_dir):
    return analyse_homepages(inputs.homepage_captures(spark, sf_dir)).findings.select(
        "run_id", "finding_id", "rule_id", "finding_class", joined("evidence_refs"), "finding_summary",
        "business_impact", "recommended_action", "limitation",
    )


_TRIGGERED = """result_state = 'KNOWN' AND ((metric_id = 'HTTP_STATUS' AND integer_value >= 400)
    OR (metric_id IN ('TRANSPORT_IS_HTTPS', 'PAGE_TITLE_PRESENT') AND NOT boolean_value)
    OR (metric_id = 'HOMEPAGE_GENERIC_NOINDEX_PRESENT' AND boolean_value))"""


@register("selected_findings", f"""SELECT s.run_id, s.url_key, s.selection_rank, s.stratum, h.rule_id FROM f_selections s
    LEFT JOIN (SELECT p.url_key, CASE metric_id WHEN 'HTTP_STATUS' THEN 'HTTP_ERROR_RESPONSE' WHEN 'TRANSPORT_IS_HTTPS' THEN 'NON_HTTPS_FINAL_TRANSPORT'
        WHEN 'PAGE_TITLE_PRESENT' THEN 'MISSING_HOMEPAGE_TITLE' ELSE 'HOMEPAGE_EXPLICIT_NOINDEX' END AS rule_id
      FROM home_measured m JOIN pg p ON m.run_id = 'home-' || p.page_id WHERE {_TRIGGERED}) h USING (url_key)""")
def selected_findings(spark, sf_dir):
    """Which pages the census of each site selects first, and which findings they carry."""
    found = inventory.candidates(inventory.admitted_observations(inputs.page_observations(spark, sf_dir)))
    selected = census.selections(found, 5).select("run_id", "url_key", "selection_rank", "stratum")
    pages = inputs.site_pages(spark, sf_dir).select(
        F.concat(F.lit("home-"), F.col("page_id").cast("string")).alias("home_run"), "url_key"
    )
    carried = analyse_homepages(inputs.homepage_captures(spark, sf_dir)).findings.select(
        F.col("run_id").alias("home_run"), "rule_id"
    )
    return selected.join(pages.join(carried, "home_run").drop("home_run"), "url_key", "left")


def _sql_refs(page: str, metrics: list[str]) -> str:
    return "concat_ws('|', " + ", ".join(
        "(" + sql_id("m", "run_id", page, f"'{metric}'") + ")" for metric in metrics) + ")"


_TAIL = [*V.DOCUMENT_METRICS, V.META_NOINDEX, V.HEADER_NOINDEX]
_RECORDS = f"""SELECT run_id, {sql_id('a', 'run_id', 'page_key')} AS acquisition_id, selection_rank,
    sampling_manifest_id AS sampling_manifest_ref, manifest_digest AS sampling_manifest_output_digest,
    page_key AS url_key, observed_at AS acquired_at, coalesce(failure_kind, 'RESPONSE_RECEIVED') AS acquisition_outcome,
    CAST(status_code AS BIGINT) AS http_status, CASE WHEN failure_kind IS NULL THEN {sql_key('final_url')} END AS final_url_key,
    CAST(redirect_count AS BIGINT) AS redirect_count, truncated AS body_truncated, NOT undecodable AS body_decoded,
    CASE WHEN NOT undecodable THEN 'sha256:' || sha256(html) END AS body_digest,
    CASE WHEN failure_kind IS NULL THEN {_sql_refs('page_key', V.TRANSPORT_EMISSION + _TAIL)}
      ELSE {_sql_refs('page_key', V.TRANSPORT_METRICS + _TAIL)} END AS measurement_refs,
    CAST(NULL AS VARCHAR) AS measurements_withheld_reason FROM acquired"""


@register("acquisition_records", _RECORDS)
def acquisition_records(spark, sf_dir):
    return _acquisition(spark, sf_dir)[1].records.drop(
        "observation_mode", "acquisition_method", "acquisition_method_version"
    ).withColumn("measurement_refs", F.array_join("measurement_refs", "|"))


@register("page_evidence", _EVIDENCE.format(
    id=sql_id("e", "measurement_id"), scenario=V.PAGE_SCENARIO, table="measured"))
def page_evidence(spark, sf_dir):
    return flat_evidence(_acquisition(spark, sf_dir)[1].evidence)
