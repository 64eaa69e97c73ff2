"""Data-quality queries over deliberately broken documents derived from every page."""

from __future__ import annotations

from dataclasses import fields, replace

from pyspark.sql import functions as F

from pagecensus.catalog import inputs
from pagecensus.catalog.oracle import CTES
from pagecensus.catalog.queries import joined, register
from pagecensus.functions import fixed_values as V
from pagecensus.functions.columns import lookup
from pagecensus.operators import lifecycle
from pagecensus.operators import quality
from pagecensus.plans import gates
from pagecensus.plans.acquisition import acquire
from pagecensus.plans.discovery import discover
from pagecensus.operators.quality import documents as rules
from pagecensus.operators.quality import vocabulary
from pagecensus.operators.quality.vocabulary import VOCABULARIES
from pagecensus.operators.ranking import with_position
from pagecensus.session import materialised

SOURCES = [
    ("CANONICAL_SEED", "USED", 2), ("PAGE_CAPTURE", "ABSENT", 2), ("PAGE_CAPTURE", "USED", 1),
    ("lower", "EMPTY", 0), ("SITEMAP", "MALFORMED", 0),
]


def _placed(spark, sf_dir):
    """Every page with its place in its site's document."""
    rows = inputs.site_pages(spark, sf_dir).drop("html")
    sizes = rows.groupBy("run_id").agg(F.count("*").alias("n"), F.min("page_id").alias("first_id"))
    placed = with_position(rows, ["run_id"], [F.col("page_id")], "place")
    return placed.join(sizes, "run_id").withColumn("pos", F.col("place") - 1).drop("place")


def _broken(spark, sf_dir):
    rows = materialised(_placed(spark, sf_dir))
    pid = F.col("page_id")
    heads = rows.where("pos = 0")
    candidates = rows.select(
        "run_id", "pos", F.when(pid % 4 == 0, F.col("site")).otherwise(F.col("url")).alias("url_key"),
        F.when(pid % 3 == 0, "EXCLUDED").otherwise("ELIGIBLE").alias("eligibility_state"), "page_id",
    )
    names = F.array(
        F.when(pid % 2 == 0, "CANONICAL_SEED").otherwise("PAGE_CAPTURE"),
        F.when(pid % 13 == 0, "bad-name").otherwise("SITEMAP"),
    )
    listed = F.array(*[
        F.struct(F.lit(i).cast("bigint").alias("pos"), F.lit(s).alias("source_id"), F.lit(o).alias("outcome"),
                 F.lit(c).cast("bigint").alias("candidate_count"))
        for i, (s, o, c) in enumerate(SOURCES)
    ])
    excluded = F.array(*[
        F.struct(F.lit(i).cast("bigint").alias("pos"), F.lit("INELIGIBLE_IN_INVENTORY").alias("reason"),
                 F.lit(i + 1).cast("bigint").alias("candidate_count"))
        for i in range(2)
    ])
    return {
        "inventories": heads.select("run_id", F.col("site").alias("target_origin")),
        "candidates": candidates,
        "provenance": candidates.select("run_id", "pos", F.explode(names).alias("source_id")),
        "sources": heads.select("run_id", F.inline(listed)),
        "exclusions": heads.select("run_id", F.inline(excluded)),
        "selections": rows.select(
            "run_id", "pos", F.when(pid % 5 == 0, F.col("site")).otherwise(F.col("url")).alias("url_key"),
            F.when(pid % 11 == 0, None).when(pid % 7 == 0, 1).otherwise(F.col("pos") + 1).cast("bigint")
            .alias("selection_rank"),
            F.when(pid % 6 == 0, "").otherwise("OFFER").alias("stratum"),
        ),
        "manifests": heads.select(
            "run_id", F.when(pid % 3 == 0, "STRATIFIED_SAMPLE").otherwise("CENSUS").alias("mode"),
            (pid % 2 == 0).alias("selection_complete"),
            F.when(pid % 5 != 0, "SELECTION_BUDGET_EXHAUSTED").alias("incompleteness_cause"),
            F.when(pid % 4 != 0, 2).cast("bigint").alias("max_selected_pages"),
        ),
    }


_LISTED = ", ".join(f"({i}, '{s}', '{o}', {c})" for i, (s, o, c) in enumerate(SOURCES))
CTES.update({
    "placed": """SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY page_id) - 1 AS pos,
        count(*) OVER (PARTITION BY run_id) AS n, min(page_id) OVER (PARTITION BY run_id) AS first_id FROM pg""",
    "heads": "SELECT * FROM placed WHERE pos = 0",
    "bad_candidates": """SELECT run_id, site, pos, CASE WHEN page_id % 4 = 0 THEN site ELSE url END AS url_key,
        CASE WHEN page_id % 3 = 0 THEN 'EXCLUDED' ELSE 'ELIGIBLE' END AS state, page_id FROM placed""",
    "bad_provenance": """SELECT run_id, site, pos, url_key, state, CASE WHEN page_id % 2 = 0 THEN 'CANONICAL_SEED' ELSE 'PAGE_CAPTURE' END AS source_id FROM bad_candidates
        UNION ALL SELECT run_id, site, pos, url_key, state, CASE WHEN page_id % 13 = 0 THEN 'bad-name' ELSE 'SITEMAP' END FROM bad_candidates""",
    "bad_sources": f"SELECT run_id, s.* FROM heads, (VALUES {_LISTED}) s(pos, source_id, outcome, candidate_count)",
    "bad_selections": """SELECT run_id, pos, CASE WHEN page_id % 5 = 0 THEN site ELSE url END AS url_key,
        CASE WHEN page_id % 11 = 0 THEN NULL WHEN page_id % 7 = 0 THEN 1 ELSE pos + 1 END AS selection_rank,
        CASE WHEN page_id % 6 = 0 THEN '' ELSE 'OFFER' END AS stratum FROM placed""",
    "contributed": "SELECT run_id, source_id, count(*) AS n FROM bad_provenance GROUP BY ALL",
    "seed_rank": """SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY pos) AS k FROM bad_candidates WHERE url_key = site""",
})


def _later(table, key, collection, rule):
    return f"""SELECT run_id, '/{collection}/' || pos AS pointer, '{rule}' AS rule FROM (SELECT *, row_number() OVER
        (PARTITION BY run_id, {key} ORDER BY pos) AS k FROM {table} WHERE {key} IS NOT NULL) WHERE k > 1"""


@register("dq_inventory_semantics", _later("bad_sources", "source_id", "sources", "unique_source_id") + " UNION ALL "
          + _later("bad_candidates", "url_key", "candidates", "unique_candidate_url_key"))
def dq_inventory_semantics(spark, sf_dir):
    t = _broken(spark, sf_dir)
    return rules.inventory_semantics(t["sources"], t["candidates"])


_SEMANTICS = (_later("bad_selections", "url_key", "selections", "unique_selected_url_key") + " UNION ALL "
          + _later("bad_selections", "selection_rank", "selections", "unique_selection_rank") + """
          UNION ALL SELECT run_id, '/selections', 'dense_selection_rank' FROM bad_selections GROUP BY run_id
            HAVING count(*) = count(selection_rank) AND list_sort(list(selection_rank)) <> range(1, count(*) + 1)
          UNION ALL SELECT run_id, '/exclusions/1', 'unique_exclusion_reason' FROM heads""")


@register("dq_manifest_semantics", _SEMANTICS)
def dq_manifest_semantics(spark, sf_dir):
    t = _broken(spark, sf_dir)
    return rules.manifest_semantics(t["selections"], t["exclusions"])


@register("dq_inventory_producer", """
    SELECT run_id, '/candidates' AS pointer, 'seed_candidate_present' AS rule FROM heads WHERE run_id NOT IN
      (SELECT run_id FROM seed_rank WHERE k = 1 AND page_id % 2 = 0)
    UNION ALL SELECT run_id, '/candidates', 'seed_candidate_eligible' FROM seed_rank
      WHERE k = 1 AND page_id % 2 = 0 AND state <> 'ELIGIBLE'
    UNION ALL SELECT run_id, '/candidates', 'source_declared_for_every_provenance' FROM contributed WHERE source_id = 'bad-name'
    UNION ALL SELECT run_id, '/sources/4', 'admitting_outcome_for_contributed_source' FROM contributed WHERE source_id = 'SITEMAP'
    UNION ALL SELECT run_id, '/sources/' || pos, 'source_id_is_a_code' FROM bad_sources WHERE NOT regexp_full_match(source_id, '[A-Z][A-Z0-9_]+')
    UNION ALL SELECT run_id, '/candidates', 'source_id_is_a_code' FROM contributed WHERE source_id = 'bad-name'
    UNION ALL SELECT s.run_id, '/sources/' || pos, 'candidate_count_matches_provenance' FROM bad_sources s
      LEFT JOIN contributed c USING (run_id, source_id) WHERE candidate_count <> coalesce(n, 0)""")
def dq_inventory_producer(spark, sf_dir):
    t = _broken(spark, sf_dir)
    return rules.inventory_producer(t["inventories"], t["sources"], t["candidates"], t["provenance"])


_PRODUCER = """
    SELECT run_id, '/mode' AS pointer, 'census_never_emits_a_sample' AS rule FROM heads WHERE page_id % 3 = 0
    UNION ALL SELECT run_id, '/selections/' || s.pos, CASE WHEN c.ok IS NULL THEN 'selection_is_an_inventory_candidate'
        ELSE 'selection_is_eligible_in_inventory' END
      FROM bad_selections s LEFT JOIN (SELECT run_id, url_key, bool_or(state = 'ELIGIBLE') AS ok FROM bad_candidates GROUP BY ALL) c
        USING (run_id, url_key) WHERE c.ok IS NULL OR NOT c.ok
    UNION ALL SELECT run_id, '/selections/' || pos, 'every_selection_carries_a_stratum' FROM bad_selections WHERE stratum = ''
    UNION ALL SELECT run_id, '/exclusions', 'exclusions_account_for_the_remainder' FROM bad_candidates GROUP BY run_id
      HAVING count(*) + 3 <> count(DISTINCT url_key)
    UNION ALL SELECT run_id, '/incompleteness', 'incompleteness_matches_completeness' FROM heads
      WHERE (page_id % 2 = 0) = (page_id % 5 <> 0)
    UNION ALL SELECT run_id, '/budgets', 'budget_cause_declares_its_budget' FROM heads WHERE page_id % 5 <> 0 AND page_id % 4 = 0"""


@register("dq_manifest_producer", _PRODUCER)
def dq_manifest_producer(spark, sf_dir):
    t = _broken(spark, sf_dir)
    return rules.manifest_producer(t["manifests"], t["selections"], t["exclusions"], t["candidates"])


def _violations(spark, sf_dir):
    t = _broken(spark, sf_dir)
    return t, rules.manifest_semantics(t["selections"], t["exclusions"]).unionByName(
        rules.manifest_producer(t["manifests"], t["selections"], t["exclusions"], t["candidates"])
    )


CTES["broken"] = f"SELECT * FROM ({_SEMANTICS} UNION ALL {_PRODUCER})"


@register("dq_problems", """SELECT run_id, 'CONTRACT_VALIDATION_FAILED' AS code, count(*) AS total,
    'Document does not satisfy contract ''sampling-manifest'': ' || count(*) || ' violation(s), ' || least(count(*), 50) || ' reported.' AS detail,
    array_to_string(list(pointer || ' ' || rule ORDER BY pointer, rule)[:50], '|') AS errors
    FROM broken GROUP BY run_id""")
def dq_problems(spark, sf_dir):
    found = quality.problems(materialised(_violations(spark, sf_dir)[1]), "sampling-manifest", "rule")
    listed = F.transform("errors", lambda e: F.concat_ws(" ", e["pointer"], e["keyword"]))
    return found.withColumn("errors", F.array_join(listed, "|"))


@register("all_problems", """SELECT run_id, row_number() OVER (PARTITION BY run_id ORDER BY pointer, rule) AS error_no, pointer, rule FROM broken""")
def all_problems(spark, sf_dir):
    """Every violation of every document, numbered; nothing is cut."""
    return quality.problem_errors(_violations(spark, sf_dir)[1], "rule").withColumnRenamed("keyword", "rule")


@register("dq_withheld_runs", """SELECT run_id, url_key FROM bad_selections WHERE run_id NOT IN
    (SELECT run_id FROM bad_selections WHERE stratum = '')""")
def dq_withheld_runs(spark, sf_dir):
    t = _broken(spark, sf_dir)
    bad = quality.rows_where(
        t["selections"], F.col("stratum") == "", quality.at("selections"), "every_selection_carries_a_stratum"
    )
    return quality.withhold(t["selections"], bad).select("run_id", "url_key")


# --- page documents -------------------------------------------------------------------------------

def _page_documents(spark, sf_dir):
    rows = materialised(_placed(spark, sf_dir))
    pid, name = F.col("page_id"), F.concat(F.lit("m-"), F.col("page_id").cast("string"))
    shared = F.concat(F.lit("shared-"), F.col("run_id"))
    heads = rows.where("pos = 0")
    moment = F.concat(F.lit("t"), F.col("first_id").cast("string"))
    refs = (
        F.when(pid % 6 == 0, F.array().cast("array<string>"))
        .when(pid % 6 == 1, F.array(name, F.lit("m-missing")))
        .when(pid % 6 == 2, F.array(name, shared))
        .otherwise(F.array(name))
    )
    text = F.lit(None).cast("string")
    records = rows.select(
        "run_id", "pos", "page_id", F.col("url").alias("url_key"),
        F.when(pid % 8 == 0, "a-dup").otherwise(F.concat(F.lit("a-"), pid.cast("string"))).alias("acquisition_id"),
        F.when(pid % 9 == 0, "x").otherwise(F.col("run_id")).alias("sampling_manifest_ref"),
        F.lit("d").alias("sampling_manifest_output_digest"),
        F.when(pid % 10 == 0, "RENDERED_BROWSER").otherwise(V.OBSERVATION_MODE).alias("observation_mode"),
        F.lit(V.ACQUISITION_METHOD).alias("acquisition_method"),
        F.lit(V.ACQUISITION_METHOD_VERSION).alias("acquisition_method_version"),
        F.when(pid % 14 == 0, "raw").alias("raw_artifact_ref"), refs.alias("measurement_refs"),
        F.when(pid % 12 == 0, V.WITHHELD_REASON).alias("measurements_withheld_reason"),
        moment.alias("acquired_at"),
        F.when(pid % 3 == 0, "TIMEOUT").otherwise("RESPONSE_RECEIVED").alias("acquisition_outcome"),
    )
    own = rows.select(
        "run_id", "pos", name.alias("measurement_id"),
        F.when(pid % 2 == 0, "HTTP_STATUS").otherwise("FINAL_URL").alias("metric_id"),
        F.when(pid % 4 == 0, F.col("site")).otherwise(F.col("url")).alias("source_url"),
        F.when(pid % 15 == 0, "later").otherwise(moment).alias("observed_at"),
    )
    extra = heads.select(
        "run_id", F.col("n").alias("pos"), shared.alias("measurement_id"), F.lit("HTTP_STATUS").alias("metric_id"),
        F.concat("site", F.lit("other")).alias("source_url"), moment.alias("observed_at"),
    )
    evidence = rows.select(
        "run_id", "pos", F.when(pid % 16 == 0, "e-dup").otherwise(F.concat(F.lit("e-"), pid.cast("string"))).alias("evidence_id"),
        F.when(pid % 18 == 0, "NEGATIVE").alias("polarity"),
        F.when(pid % 5 == 0, F.array(name, shared)).otherwise(F.array(name)).alias("measurement_refs"),
        F.when(pid % 4 == 0, F.col("site")).otherwise(F.col("url")).alias("source_url"), moment.alias("observed_at"),
    )
    rank = F.when(F.col("first_id") % 2 == 0, F.col("pos") + 1).otherwise(F.col("n") - F.col("pos"))
    return {
        "records": records, "measurements": own.unionByName(extra), "evidence": evidence,
        "manifests": heads.select(
            "run_id", F.col("run_id").alias("sampling_manifest_id"), F.lit("d").alias("output_digest"),
            F.lit(2).cast("bigint").alias("max_selected_pages"),
        ),
        "selections": rows.select("run_id", "pos", F.col("url").alias("url_key"), rank.alias("selection_rank"), text.alias("stratum")),
    }


CTES.update({
    "recs": """SELECT *, CASE page_id % 6 WHEN 0 THEN CAST([] AS VARCHAR[]) WHEN 1 THEN ['m-' || page_id, 'm-missing']
        WHEN 2 THEN ['m-' || page_id, 'shared-' || run_id] ELSE ['m-' || page_id] END AS refs FROM placed""",
    "recrefs": "SELECT run_id, pos, page_id, site, url, first_id, unnest(refs) AS ref, generate_subscripts(refs, 1) AS no FROM recs",
    "meas": """SELECT run_id, pos, 'm-' || page_id AS id, CASE WHEN page_id % 2 = 0 THEN 'HTTP_STATUS' ELSE 'FINAL_URL' END AS metric,
        CASE WHEN page_id % 4 = 0 THEN site ELSE url END AS src, CASE WHEN page_id % 15 = 0 THEN 'later' ELSE 't' || first_id END AS seen FROM placed
        UNION ALL SELECT run_id, n, 'shared-' || run_id, 'HTTP_STATUS', site || 'other', 't' || first_id FROM heads""",
    "ranked_refs": """SELECT r.*, row_number() OVER (PARTITION BY r.run_id, ref ORDER BY r.pos, no) AS k, m.metric, m.src, m.seen
        FROM recrefs r JOIN meas m ON m.run_id = r.run_id AND m.id = r.ref""",
    "owned": "SELECT * FROM ranked_refs WHERE k = 1",
    "evid": """SELECT *, CASE WHEN page_id % 16 = 0 THEN 'e-dup' ELSE 'e-' || page_id END AS evidence_id,
        CASE WHEN page_id % 5 = 0 THEN ['m-' || page_id, 'shared-' || run_id] ELSE ['m-' || page_id] END AS refs,
        CASE WHEN page_id % 4 = 0 THEN site ELSE url END AS src FROM placed""",
    "evidrefs": "SELECT run_id, pos, src, 't' || first_id AS seen, unnest(refs) AS ref FROM evid",
})


@register("dq_acquisition", """
    SELECT DISTINCT run_id, '/page_acquisitions' AS pointer, 'one_record_per_selection' AS rule FROM placed WHERE first_id % 2 <> 0 AND n > 1
    UNION ALL SELECT run_id, '/page_acquisitions/' || pos, 'record_binds_manifest' FROM placed WHERE page_id % 9 = 0
    UNION ALL SELECT run_id, '/page_acquisitions/' || pos, 'record_declares_this_producer' FROM placed WHERE page_id % 10 = 0
    UNION ALL SELECT run_id, '/page_acquisitions/' || pos, 'unique_acquisition_id' FROM (SELECT *, row_number() OVER
      (PARTITION BY run_id ORDER BY pos) AS k FROM placed WHERE page_id % 8 = 0) WHERE k > 1
    UNION ALL SELECT run_id, '/page_acquisitions/' || pos, 'raw_artifact_ref_absent' FROM placed WHERE page_id % 14 = 0
    UNION ALL SELECT run_id, '/page_acquisitions/' || pos, 'refs_empty_iff_withheld' FROM placed WHERE (page_id % 6 = 0) <> (page_id % 12 = 0)
    UNION ALL SELECT run_id, '/page_acquisitions/' || pos, 'measurement_owned_once' FROM ranked_refs WHERE k > 1
    UNION ALL SELECT run_id, '/page_acquisitions/' || pos, 'refs_name_a_measurement' FROM placed WHERE page_id % 6 = 1
    UNION ALL SELECT m.run_id, '/measurements/' || m.pos, 'every_measurement_is_owned' FROM meas m
      LEFT JOIN owned o ON o.run_id = m.run_id AND o.ref = m.id WHERE o.ref IS NULL
    UNION ALL SELECT run_id, '/website_evidence/' || pos, 'no_polarity_on_page_evidence' FROM placed WHERE page_id % 18 = 0
    UNION ALL SELECT e.run_id, '/website_evidence/' || e.pos, 'evidence_within_one_page' FROM evidrefs e
      LEFT JOIN owned o ON o.run_id = e.run_id AND o.ref = e.ref GROUP BY e.run_id, e.pos
      HAVING count(DISTINCT o.pos) <> 1 OR bool_or(o.pos IS NULL)""")
def dq_acquisition(spark, sf_dir):
    t = _page_documents(spark, sf_dir)
    return rules.acquisition(t["records"], t["manifests"], t["selections"], t["measurements"], t["evidence"])


@register("dq_linkage", """
    SELECT run_id, '/website_evidence/' || pos AS pointer, 'unique_evidence_id' AS rule FROM (SELECT *, row_number() OVER
      (PARTITION BY run_id ORDER BY pos) AS k FROM placed WHERE page_id % 16 = 0) WHERE k > 1
    UNION ALL SELECT run_id, '/page_acquisitions/' || pos, 'measured_at_acquisition_instant' FROM owned WHERE seen <> 't' || first_id
    UNION ALL SELECT run_id, '/page_acquisitions/' || pos, 'metric_measured_once' FROM owned GROUP BY run_id, pos, metric HAVING count(*) > 1
    UNION ALL SELECT run_id, '/page_acquisitions/' || pos, 'one_response_url' FROM owned WHERE src <> url GROUP BY run_id, pos, page_id
      HAVING count(DISTINCT src) > CASE WHEN page_id % 3 = 0 THEN 0 ELSE 1 END
    UNION ALL SELECT e.run_id, '/website_evidence/' || e.pos, 'evidence_context_matches' FROM evidrefs e
      JOIN meas m ON m.run_id = e.run_id AND m.id = e.ref WHERE e.src <> m.src OR e.seen <> m.seen
    UNION ALL SELECT run_id, '/measurements/' || (pos + 100000), 'unique_measurement_id' FROM meas WHERE pos % 6 = 1
    UNION ALL SELECT run_id, '/selections', 'selections_within_budget' FROM heads WHERE n > 2""")
def dq_linkage(spark, sf_dir):
    """Some measurements are named again at the end; the first of a name is the one that counts."""
    t = _page_documents(spark, sf_dir)
    again = t["measurements"].where("pos % 6 = 1").withColumns({"pos": F.col("pos") + 100_000, "metric_id": F.lit("OTHER")})
    return rules.linkage(t["records"], t["manifests"], t["selections"], t["measurements"].unionByName(again), t["evidence"])


@register("dq_bundle_run", "SELECT run_id, '/page_acquisitions/' || pos AS pointer, 'belongs_to_run' AS rule FROM placed WHERE page_id % 5 = 0")
def dq_bundle_run(spark, sf_dir):
    rows = _placed(spark, sf_dir).withColumns({
        "bundle_run": F.col("run_id"), "run_id": F.when(F.col("page_id") % 5 == 0, "other").otherwise(F.col("run_id")),
    })
    return rules.foreign_documents(rows, "page_acquisitions")


# --- lifecycles -----------------------------------------------------------------------------------

STATES = {"signup": "CREATED", "view": "QUEUED", "click": "RUNNING", "purchase": "SUCCEEDED", "error": "FAILED"}
_STATE = "CASE WHEN event_id % 97 = 0 THEN 'LOST' " + " ".join(f"WHEN event_type = '{k}' THEN '{v}'" for k, v in STATES.items()) + " END"
_KNOWN = "('" + "', '".join(V.RUN_STATES) + "')"
_EDGES = " OR ".join(f"(previous = '{a}' AND state = '{b}')" for a, b in V.LEGAL_TRANSITIONS)
CTES.update({
    "steps": f"""SELECT CAST(user_id AS VARCHAR) AS run_id, {_STATE} AS state,
        row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS place FROM events""",
    "paired": """SELECT *, lag(state) OVER (PARTITION BY run_id ORDER BY place) AS previous,
        min(CASE WHEN state IN ('SUCCEEDED', 'FAILED', 'CANCELLED') THEN place END) OVER (PARTITION BY run_id) AS ended FROM steps""",
})


@register("lifecycle_audit", f"""SELECT run_id, place, previous, state, 'illegal_transition' AS rule FROM paired
      WHERE state IN {_KNOWN} AND coalesce(previous, 'CREATED') IN {_KNOWN} AND CASE WHEN previous IS NULL THEN state <> 'CREATED' ELSE NOT ({_EDGES}) END
    UNION ALL SELECT run_id, place, previous, state, 'unknown_state' FROM paired WHERE state NOT IN {_KNOWN}
    UNION ALL SELECT run_id, place, previous, state, 'activity_after_end' FROM paired WHERE place > ended""")
def lifecycle_audit(spark, sf_dir):
    return lifecycle.audit(_transitions(spark, sf_dir), ["ts", "event_id"])


def _transitions(spark, sf_dir):
    return inputs.events(spark, sf_dir).select(
        F.col("user_id").cast("string").alias("run_id"), "ts", "event_id",
        F.when(F.col("event_id") % 97 == 0, "LOST").otherwise(lookup(STATES, F.col("event_type"))).alias("state"),
    )


_REQUESTS = """SELECT 'run-' || page_id AS run_id, 'req-' || page_id AS request_id,
    CASE page_id % 4 WHEN 0 THEN replace(url, '://', '://user:pw@') ELSE url END AS target_url,
    CASE page_id % 5 WHEN 0 THEN 'OWNER_VERIFIED_CONTROLLED' ELSE 'PUBLIC_NON_INVASIVE' END AS scan_mode, page_id FROM pages"""


def _requests(spark, sf_dir):
    pid = F.col("page_id")
    return inputs.pages(spark, sf_dir).select(
        F.concat(F.lit("run-"), pid.cast("string")).alias("run_id"),
        F.concat(F.lit("req-"), pid.cast("string")).alias("request_id"),
        F.when(pid % 4 == 0, F.replace("url", F.lit("://"), F.lit("://user:pw@"))).otherwise(F.col("url")).alias("target_url"),
        F.when(pid % 5 == 0, "OWNER_VERIFIED_CONTROLLED").otherwise("PUBLIC_NON_INVASIVE").alias("scan_mode"),
    )


@register("requests_admitted", f"SELECT run_id, request_id, target_url, scan_mode FROM ({_REQUESTS}) WHERE page_id % 4 <> 0 AND page_id % 5 <> 0")
def requests_admitted(spark, sf_dir):
    return lifecycle.screened_requests(_requests(spark, sf_dir))[0]


@register("requests_refused", f"""SELECT run_id, request_id, CASE WHEN page_id % 4 = 0 THEN 'TARGET_NOT_PERMITTED'
    ELSE 'SCAN_MODE_NOT_SUPPORTED' END AS code FROM ({_REQUESTS}) WHERE page_id % 4 = 0 OR page_id % 5 = 0""")
def requests_refused(spark, sf_dir):
    return lifecycle.screened_requests(_requests(spark, sf_dir))[1]


def _homepages(spark, sf_dir):
    from pagecensus.operators.observation import observe_pages

    return observe_pages(inputs.homepage_captures(spark, sf_dir), requested="requested_url", homepage=True)


@register("homepage_stages", """SELECT run_id, 'PAGE_FETCH' AS stage_id, CASE WHEN failure_kind IS NULL THEN 'SUCCEEDED' ELSE 'FAILED' END AS status,
      observed_at AS started_at, observed_at AS finished_at FROM home_observed
    UNION ALL SELECT run_id, 'HTML_OBSERVATION', CASE WHEN document_status = 'UNREADABLE' THEN 'FAILED' ELSE 'SUCCEEDED' END,
      observed_at, observed_at FROM home_observed WHERE failure_kind IS NULL""")
def homepage_stages(spark, sf_dir):
    return lifecycle.homepage_stages(_homepages(spark, sf_dir))


@register("homepage_states", """SELECT run_id, CASE WHEN failure_kind IS NULL THEN 'SUCCEEDED' ELSE 'FAILED' END AS state,
    observed_at AS entered_at, observed_at AS finished_at, CASE WHEN failure_kind = 'BLOCKED_TARGET' THEN 'TARGET_NOT_PERMITTED'
      WHEN failure_kind IS NOT NULL THEN 'PAGE_FETCH_FAILED' END AS failure_code FROM home_observed""")
def homepage_states(spark, sf_dir):
    return lifecycle.homepage_states(_homepages(spark, sf_dir))


def _gated(spark, sf_dir):
    """A discovery and its pages, tampered with by the first page id of each site, through all gates."""
    heads = materialised(inputs.seeds(spark, sf_dir).withColumn("requested_at", F.timestamp_seconds(F.col("page_id") + inputs.EPOCH)))
    pid, first = F.col("page_id"), heads.select("run_id", "page_id")
    found = discover(inputs.runs(spark, sf_dir), inputs.page_observations(spark, sf_dir), inputs.page_attempts(spark, sf_dir))

    def tampered(df, column, modulus, value):
        step = df.join(first, "run_id")
        return step.withColumn(column, F.when(pid % modulus == 0, value).otherwise(F.col(column))).drop("page_id")

    twice = found.attempts.unionByName(found.attempts.join(first.where(pid % 7 == 0), "run_id", "leftsemi"))
    broken = replace(
        found, attempts=twice, selections=tampered(found.selections, "stratum", 5, F.lit("")),
        manifests=tampered(found.manifests, "output_digest", 3, F.lit("other")),
    )

    def acquiring(selections, captures, manifests):
        got = acquire(selections, captures, manifests)
        return replace(got, records=tampered(got.records, "observation_mode", 2, F.lit("RENDERED_BROWSER")))

    failed = heads.where(pid % 11 == 0).select("run_id", F.lit("SITE_DISCOVERY_TIMEOUT").alias("failure_code"))
    none = {f.name: getattr(broken, f.name).join(failed, "run_id", "leftanti") for f in fields(broken)}
    captured = inputs.captures(spark, sf_dir).unionByName(inputs.seed_captures(spark, sf_dir))
    return gates.gated(heads, failed, replace(broken, **none), captured, acquiring)


_FLAGS = """SELECT run_id, generated_at, page_id % 11 = 0 AS b, page_id % 7 = 0 AS i, page_id % 5 = 0 AS m, page_id % 3 = 0 AS a,
    page_id % 2 = 0 AS p FROM runs"""


@register("site_runs", f"""SELECT run_id, CASE WHEN b OR i OR m OR a OR p THEN 'FAILED' ELSE 'SUCCEEDED' END AS state, generated_at AS entered_at,
    CASE WHEN b THEN 'SITE_DISCOVERY_TIMEOUT' WHEN i THEN 'SITE_INVENTORY_NOT_EMITTABLE' WHEN m THEN 'SAMPLING_MANIFEST_NOT_EMITTABLE'
      WHEN a THEN 'SAMPLING_MANIFEST_NOT_ADMISSIBLE' WHEN p THEN 'PAGE_ACQUISITION_NOT_EMITTABLE' END AS failure_code,
    NOT (b OR i) AS has_inventory, NOT (b OR i OR m OR a) AS has_manifest, NOT (b OR i OR m OR a OR p) AS has_page_documents
    FROM ({_FLAGS})""")
def site_runs(spark, sf_dir):
    return _gated(spark, sf_dir).runs.select(
        "run_id", "state", "entered_at", "failure_code", "has_inventory", "has_manifest", "has_page_documents"
    )


@register("site_stages", f"""SELECT run_id, 'SITE_DISCOVERY' AS stage_id, CASE WHEN b OR i THEN 'FAILED' ELSE 'SUCCEEDED' END AS status FROM ({_FLAGS})
    UNION ALL SELECT run_id, 'SAMPLING_PLAN', CASE WHEN m THEN 'FAILED' ELSE 'SUCCEEDED' END FROM ({_FLAGS}) WHERE NOT (b OR i)
    UNION ALL SELECT run_id, 'PAGE_ACQUISITION', CASE WHEN a OR p THEN 'FAILED' ELSE 'SUCCEEDED' END FROM ({_FLAGS}) WHERE NOT (b OR i OR m)""")
def site_stages(spark, sf_dir):
    return lifecycle.site_stages(_gated(spark, sf_dir).runs)


_DECLARED = ", ".join(f"('{d}', '{m}', '{v}')" for (d, m), values in VOCABULARIES.items() for v in values)
_STATED = {
    ("sources", "outcome"): "SELECT CASE WHEN source_id = 'PAGE_CAPTURE' AND candidate_count > 3 THEN 'LOST' ELSE outcome END FROM a_counts",
    ("candidates", "eligibility_state"): "SELECT eligibility_state FROM a_candidates",
    ("candidates", "exclusion_reason"): "SELECT exclusion_reason FROM a_candidates",
    ("sampling_manifest", "mode"): "SELECT 'CENSUS'", ("sampling_manifest", "incompleteness_cause"): "SELECT incompleteness_cause FROM a_summary",
    ("selections", "selection_reason"): "SELECT CASE WHEN stratum = 'HOMEPAGE' THEN selection_reason ELSE lower(selection_reason) END FROM a_selections",
    ("exclusions", "reason"): "SELECT reason FROM a_exclusions", ("page_acquisitions", "observation_mode"): f"SELECT '{V.OBSERVATION_MODE}'",
    ("page_acquisitions", "acquisition_outcome"): "SELECT coalesce(failure_kind, 'RESPONSE_RECEIVED') FROM acquired",
    ("measurements", "result.value_type"): "SELECT value_type FROM measured",
    **{(d, f"assessment.{m}"): f"SELECT {m} FROM measured" for d in ("measurements", "website_evidence")
       for m in ("collection_mode", "result_state", "not_assessed_reason")},
    ("analysis_run_state", "state"): "SELECT state FROM steps", ("stage_executions", "status"): f"SELECT CASE WHEN i OR b THEN 'FAILED' ELSE 'SUCCEEDED' END FROM ({{flags}})",
    ("analysis_run_request", "scan_mode"): "SELECT CASE page_id % 3 WHEN 0 THEN 'PUBLIC_NON_INVASIVE' WHEN 1 THEN 'LOUD_' || page_id % 5 END FROM pages",
}


CTES["declared_tokens"] = f"SELECT * FROM (VALUES {_DECLARED}) t(dataset, member, value)"
CTES["stated_tokens"] = " UNION ".join(
    f"SELECT '{d}' AS dataset, '{m}' AS member, value FROM ({q.format(flags=_FLAGS)}) t(value) WHERE value IS NOT NULL" for (d, m), q in _STATED.items()
)


@register("vocabulary_audit", """SELECT *, 'undeclared' AS problem FROM (SELECT * FROM stated_tokens EXCEPT SELECT * FROM declared_tokens)
    UNION ALL SELECT *, 'unused' FROM (SELECT * FROM declared_tokens EXCEPT SELECT * FROM stated_tokens)""")
def vocabulary_audit(spark, sf_dir):
    """All closed members of the documents of all sites, some of them with tokens of no vocabulary."""
    found = discover(inputs.runs(spark, sf_dir), inputs.page_observations(spark, sf_dir), inputs.page_attempts(spark, sf_dir))
    captured = inputs.captures(spark, sf_dir).unionByName(inputs.seed_captures(spark, sf_dir))
    got = acquire(found.selections, captured, found.manifests)
    pid = F.col("page_id")
    heads = inputs.seeds(spark, sf_dir)
    lost = (F.col("source_id") == "PAGE_CAPTURE") & (F.col("candidate_count") > 3)
    return vocabulary.vocabulary_audit({
        "sources": found.attempts.withColumn("outcome", F.when(lost, "LOST").otherwise(F.col("outcome"))),
        "candidates": found.candidates, "exclusions": found.exclusions,
        "selections": found.selections.withColumn(
            "selection_reason", F.when(F.col("stratum") == "HOMEPAGE", F.col("selection_reason")).otherwise(F.lower("selection_reason"))
        ),
        "sampling_manifest": found.manifests, "page_acquisitions": got.records, "measurements": got.measurements,
        "website_evidence": got.evidence, "analysis_run_state": _transitions(spark, sf_dir),
        "stage_executions": heads.select(F.when((pid % 7 == 0) | (pid % 11 == 0), "FAILED").otherwise("SUCCEEDED").alias("status")),
        "analysis_run_request": inputs.pages(spark, sf_dir).select(
            F.when(pid % 3 == 0, "PUBLIC_NON_INVASIVE").when(pid % 3 == 1, F.concat(F.lit("LOUD_"), (pid % 5).cast("string"))).alias("scan_mode")
        ),
    })


@register("gated_runs", f"""SELECT f.run_id, CASE WHEN b OR i THEN 0 ELSE c.n END AS candidates, CASE WHEN b OR i OR m OR a THEN 0 ELSE s.n END AS selections,
    CASE WHEN b OR i OR m OR a OR p THEN 0 ELSE s.n END AS records, CASE WHEN b OR i OR m OR a OR p THEN 0 ELSE x.n END AS measurements,
    concat_ws('|', CASE WHEN NOT b AND (a OR i OR m) THEN 'admission' END, CASE WHEN NOT b AND i THEN 'inventory' END, CASE WHEN NOT b AND m THEN 'manifest' END,
      CASE WHEN NOT (b OR i OR m OR a) AND p THEN 'pages' END) AS gates
    FROM ({_FLAGS}) f JOIN (SELECT run_id, count(*) AS n FROM a_candidates GROUP BY run_id) c USING (run_id)
    JOIN (SELECT run_id, count(*) AS n FROM acquired GROUP BY run_id) s USING (run_id)
    JOIN (SELECT run_id, count(*) AS n FROM measured GROUP BY run_id) x USING (run_id)""")
def gated_runs(spark, sf_dir):
    """What is left of each run's documents, and which gates withheld the rest."""
    out = _gated(spark, sf_dir)
    counts = out.runs.select("run_id")
    for name, table in (
        ("candidates", out.found.candidates), ("selections", out.found.selections), ("records", out.got.records),
        ("measurements", out.got.measurements),
    ):
        counts = counts.join(table.groupBy("run_id").agg(F.count("*").alias(name)), "run_id", "left").fillna(0, subset=[name])
    named = out.verdicts.groupBy("run_id").agg(F.array_join(F.array_sort(F.collect_set("gate")), "|").alias("gates"))
    return counts.join(named, "run_id", "left").fillna("", subset=["gates"])
