"""The same results as plain SQL over the given tables.

Each query is a chain of common table expressions.  The page markup of the given tables is regular
(one title, double-quoted links), so regular expressions stand in for the HTML reader here.
"""

from __future__ import annotations

from pagecensus.catalog.inputs import ATTEMPTS, EPOCH, LABELS
from pagecensus.functions import fixed_values as V

PATH_SAFE = r"A-Za-z0-9\-._~/!$&''()*+,;=:@%"


def sql_list(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def sql_in(values) -> str:
    return "(" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + ")"


def sql_id(kind: str, *parts: str) -> str:
    return f"'{kind}-' || substr(sha256(concat_ws(chr(31), {', '.join(parts)})), 1, 32)"


def sql_instant(page_id: str) -> str:
    return f"strftime(make_timestamp(({EPOCH} + {page_id}) * 1000000), '%Y-%m-%dT%H:%M:%SZ')"


def sql_encoded(text: str, safe: str) -> str:
    return (
        f"array_to_string(list_transform(regexp_extract_all({text}, '[{safe}]+|[^{safe}]'), "
        f"lambda p: CASE WHEN regexp_full_match(p, '[{safe}]+') THEN p ELSE url_encode(p) END), '')"
    )


def sql_key(form: str) -> str:
    """Identity of the plain forms in the given tables."""
    addressed = f"split_part({form}, '#', 1)"
    host = f"lower(regexp_extract({addressed}, '^(https?://[^/?]*)', 1))"
    path = f"regexp_extract({addressed}, '^https?://[^/?]*([^?]*)', 1)"
    path = sql_encoded(f"CASE WHEN {path} = '' THEN '/' ELSE {path} END", PATH_SAFE)
    query = f"regexp_extract({addressed}, '\\?(.*)$', 1)"
    query = (
        f"array_to_string(list_filter(string_split({query}, '&'), lambda x: x <> '' AND NOT "
        f"starts_with(lower(split_part(x, '=', 1)), 'utm_')), '&')"
    )
    query = sql_encoded(query, PATH_SAFE + "?")
    return f"{host} || {path} || CASE WHEN {query} = '' THEN '' ELSE '?' || {query} END"


def sql_origin(key: str) -> str:
    return f"regexp_extract({key}, '^(https?://[^/?#]+)', 1) || '/'"


def sql_words(text: str) -> str:
    plain = (
        f"replace(regexp_replace(regexp_replace(lower({text}), '\\.[a-z0-9]{{1,8}}$', ''), "
        f"'%[0-9a-f][0-9a-f]', ' ', 'g'), '_', '-')"
    )
    return (
        f"list_concat(regexp_split_to_array({plain}, '[^a-z0-9-]+'), "
        f"regexp_split_to_array({plain}, '[^a-z0-9]+'))"
    )


def sql_type(words: str) -> str:
    cases = " ".join(
        f"WHEN list_has_any({words}, {sql_list(listed)}) THEN '{page_type}'"
        for page_type, listed in V.PAGE_TYPE_WORDS.items()
    )
    return f"CASE {cases} END"


def sql_by_id(modulus: int, values: list[str], otherwise: str) -> str:
    cases = " ".join(f"WHEN {no} THEN {value}" for no, value in enumerate(values))
    return f"CASE page_id % {modulus} {cases} ELSE {otherwise} END"


def sql_noindex(directives: str) -> str:
    return f"len(list_filter({directives}, lambda d: lower(d) IN {sql_in(V.NOINDEX_DIRECTIVES)})) > 0"


def sql_directives(line: str) -> str:
    return f"list_filter(list_transform(string_split({line}, ','), lambda d: trim(d)), lambda d: d <> '')"


def sql_line_verdict(line: str) -> str:
    found = sql_directives(line)
    name = f"lower(trim(split_part({found}[1], ':', 1)))"
    rest = f"({found})[2:]"

    def seen(directives):
        return f"CASE WHEN {sql_noindex(directives)} THEN 'PRESENT' ELSE 'ABSENT' END"

    return (
        f"CASE WHEN len({found}) = 0 THEN 'ABSENT' WHEN NOT contains({found}[1], ':') THEN {seen(found)} "
        f"WHEN {name} = '' OR {name} IN {sql_in(V.NOINDEX_DIRECTIVES)} THEN 'INDETERMINATE' "
        f"WHEN {name} IN {sql_in(V.VALUE_BEARING_RULES)} THEN {seen(rest)} ELSE 'ABSENT' END"
    )


def sql_combined(channels: str) -> str:
    return (
        f"CASE WHEN list_contains({channels}, 'PRESENT') THEN 'PRESENT' "
        f"WHEN list_has_any({channels}, ['INDETERMINATE', 'UNASSESSED']) THEN 'INDETERMINATE' "
        f"WHEN list_contains({channels}, 'ABSENT') THEN 'ABSENT' ELSE 'NOT_APPLICABLE' END"
    )


def sql_unescaped(text: str) -> str:
    return f"regexp_replace(replace({text}, '&quot;', '\"'), '&amp;?', '&', 'g')"


def sql_lookup(mapping: dict[str, str], key: str) -> str:
    cases = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in mapping.items())
    return f"CASE {key} {cases} END"


def sql_quoted(text: str) -> str:
    return f"CAST(to_json({text}) AS VARCHAR)"


_RUN = "'run-' || substr(sha256(site), 1, 16)"
_FAILURE = sql_by_id(17, ["'TIMEOUT'", "'DNS_FAILURE'", "'BLOCKED_TARGET'"], "NULL")


def _captures(rows: str) -> str:
    html = "CASE WHEN page_id % 5 = 0 THEN regexp_replace(html, '<title>[^<]*</title>', '') ELSE html END"
    html = (
        f"CASE WHEN page_id % 9 = 0 THEN replace({html}, '</head>', "
        f"'<meta name=\"robots\" content=\"none\"></head>') ELSE {html} END"
    )
    return f"""
      SELECT page_id, run_id, site, requested_url, failure_kind, {sql_instant('page_id')} AS observed_at,
        CASE WHEN failure_kind IS NULL THEN requested_url END AS final_url,
        CASE WHEN failure_kind IS NULL THEN {sql_by_id(11, ['404', '503'], '200')} END AS status_code,
        CASE WHEN failure_kind IS NULL THEN
          {sql_by_id(13, ["'application/pdf'", 'NULL'], "'text/html; charset=utf-8'")} END AS content_type,
        CASE WHEN failure_kind IS NULL THEN {sql_by_id(7, [
            "['noindex']", "['googlebot: noindex']", "['max-snippet: 20, noindex']", "['noindex: yes']",
            "['googlebot: follow', 'noindex']"], "CAST([] AS VARCHAR[])")} END AS x_robots_tag,
        CASE WHEN failure_kind IS NULL THEN starts_with(requested_url, 'https://') END AS is_https,
        CASE WHEN failure_kind IS NULL THEN page_id % 4 END AS redirect_count,
        CASE WHEN failure_kind IS NULL THEN {html} END AS html,
        CASE WHEN failure_kind IS NULL THEN page_id % 19 = 0 END AS truncated,
        CASE WHEN failure_kind IS NULL THEN page_id % 23 = 0 END AS undecodable
      FROM (SELECT *, {_FAILURE} AS failure_kind FROM {rows})"""


def _observed(captures: str, homepage: bool) -> str:
    error = "" if homepage else "WHEN status_code NOT BETWEEN 200 AND 299 THEN 'NON_SUCCESS_STATUS'"
    title = sql_unescaped("regexp_extract(html, '<title>([^<]*)</title>', 1)")
    return f"""
      SELECT *,
        CASE WHEN document_status = 'READ' THEN
          CASE WHEN page_id % 9 = 0 THEN 'PRESENT' WHEN truncated THEN 'INDETERMINATE' ELSE 'ABSENT' END
          WHEN document_status = 'NOT_A_DOCUMENT' THEN 'NOT_APPLICABLE'
          WHEN document_status = 'UNREADABLE' THEN 'UNASSESSED' END AS meta_noindex,
        CASE WHEN failure_kind IS NULL THEN
          CASE WHEN len(x_robots_tag) = 0 THEN 'ABSENT' ELSE {sql_combined('line_verdicts')} END END AS header_noindex,
        CASE WHEN document_status = 'READ' AND regexp_matches(html, '<title>') THEN
          regexp_replace(trim({title}), '\\s+', ' ', 'g') END AS title
      FROM (SELECT *, list_transform(x_robots_tag, lambda x: {sql_line_verdict('x')}) AS line_verdicts,
        CASE WHEN failure_kind IS NOT NULL THEN 'NO_RESPONSE' {error}
          WHEN content_type IS NULL OR content_type NOT LIKE 'text/html%' THEN 'NOT_A_DOCUMENT'
          WHEN undecodable THEN 'UNREADABLE' ELSE 'READ' END AS document_status
        FROM {captures})"""


def _measured(observed: str, page: str, homepage: bool) -> str:
    channels = [V.META_NOINDEX, V.HEADER_NOINDEX] + ([V.COMBINED_NOINDEX] if homepage else [])
    declared = [*V.TRANSPORT_METRICS, *V.DOCUMENT_METRICS, *channels]
    emitted = [*V.TRANSPORT_EMISSION, *V.DOCUMENT_METRICS, *channels]
    metrics = ", ".join(f"('{x}', {declared.index(x) + 1}, {emitted.index(x) + 1})" for x in declared)
    verdict = f"""CASE metric_id WHEN '{V.META_NOINDEX}' THEN meta_noindex
        WHEN '{V.HEADER_NOINDEX}' THEN header_noindex
        WHEN '{V.COMBINED_NOINDEX}' THEN {sql_combined('[meta_noindex, header_noindex]')} END"""
    documents = sql_in(V.DOCUMENT_METRICS)
    always = sql_in(["HTTP_STATUS", "FINAL_URL", "TRANSPORT_IS_HTTPS", "REDIRECT_COUNT"])
    collector = V.HOMEPAGE_COLLECTOR if homepage else V.PAGE_COLLECTOR
    return f"""
      SELECT run_id, url_key, measurement_no, {sql_id('m', 'run_id', 'url_key', 'metric_id')} AS measurement_id,
        metric_id, source_url, observed_at, '{collector}' AS collector,
        CASE WHEN state IS NULL THEN NULL WHEN metric_id IN ('HTTP_STATUS', 'REDIRECT_COUNT') THEN 'MEASURED'
          ELSE 'OBSERVED' END AS collection_mode,
        state AS result_state, reason AS not_assessed_reason,
        CASE WHEN state <> 'KNOWN' OR state IS NULL THEN NULL
          WHEN metric_id IN ('HTTP_STATUS', 'REDIRECT_COUNT') THEN 'INTEGER' WHEN metric_id = 'FINAL_URL' THEN 'URL'
          WHEN metric_id IN ('CONTENT_TYPE', 'PAGE_TITLE') THEN 'TEXT' ELSE 'BOOLEAN' END AS value_type,
        CASE WHEN state = 'KNOWN' THEN CASE WHEN metric_id = 'TRANSPORT_IS_HTTPS' THEN is_https
          WHEN metric_id = 'PAGE_TITLE_PRESENT' THEN coalesce(title, '') <> ''
          WHEN metric_id IN ('META_DESCRIPTION_PRESENT', 'CANONICAL_PRESENT') THEN false
          WHEN verdict IS NOT NULL THEN verdict = 'PRESENT' END END AS boolean_value,
        CAST(CASE WHEN state = 'KNOWN' THEN CASE metric_id WHEN 'HTTP_STATUS' THEN status_code
          WHEN 'REDIRECT_COUNT' THEN redirect_count END END AS BIGINT) AS integer_value,
        CASE WHEN state = 'KNOWN' THEN CASE metric_id WHEN 'CONTENT_TYPE' THEN content_type
          WHEN 'PAGE_TITLE' THEN title END END AS text_value,
        CASE WHEN state = 'KNOWN' AND metric_id = 'FINAL_URL' THEN final_url END AS url_value
      FROM (SELECT *,
        CASE WHEN reason IS NOT NULL THEN NULL WHEN metric_id IN {always} THEN 'KNOWN'
          WHEN metric_id = 'CONTENT_TYPE' THEN CASE WHEN content_type IS NULL THEN 'UNKNOWN' ELSE 'KNOWN' END
          WHEN metric_id IN {documents} AND document_status = 'NOT_A_DOCUMENT' THEN 'NOT_APPLICABLE'
          WHEN metric_id IN ('PAGE_TITLE_PRESENT', 'PAGE_TITLE') AND title IS NULL AND truncated THEN 'UNKNOWN'
          WHEN metric_id = 'PAGE_TITLE_PRESENT' THEN 'KNOWN'
          WHEN metric_id = 'PAGE_TITLE' THEN CASE WHEN coalesce(title, '') = '' THEN 'NOT_APPLICABLE' ELSE 'KNOWN' END
          WHEN metric_id IN {documents} AND truncated THEN 'UNKNOWN'
          WHEN metric_id IN ('META_DESCRIPTION_PRESENT', 'CANONICAL_PRESENT') THEN 'KNOWN'
          WHEN metric_id IN {documents} THEN 'NOT_APPLICABLE'
          WHEN verdict = 'INDETERMINATE' THEN 'UNKNOWN' WHEN verdict = 'NOT_APPLICABLE' THEN 'NOT_APPLICABLE'
          ELSE 'KNOWN' END AS state
        FROM (SELECT *, {page} AS url_key, {verdict} AS verdict,
          CAST(CASE WHEN document_status = 'NO_RESPONSE' THEN declared_no ELSE emitted_no END AS BIGINT) AS measurement_no,
          CASE WHEN final_url IS NULL OR metric_id IN ('FINAL_URL', 'REDIRECT_COUNT') THEN {page} ELSE final_url END AS source_url,
          CASE WHEN document_status = 'NO_RESPONSE' THEN {sql_lookup(V.NOT_ASSESSED_REASON, 'failure_kind')}
            WHEN metric_id IN {documents} OR metric_id = '{V.META_NOINDEX}' THEN
              CASE document_status WHEN 'NON_SUCCESS_STATUS' THEN 'UNSUPPORTED' WHEN 'UNREADABLE' THEN 'RUNTIME_ERROR' END
            END AS reason
          FROM {observed}, (VALUES {metrics}) AS m(metric_id, declared_no, emitted_no)))"""


def _candidate_json() -> str:
    eligibility = (
        "'{\"eligibility\":{' || CASE WHEN exclusion_reason IS NULL THEN '' ELSE "
        "'\"exclusion_reason\":\"' || exclusion_reason || '\",' END || '\"state\":\"' || eligibility_state || '\"}'"
    )
    forms = f"',\"observed_forms\":[' || array_to_string(list_transform(forms, lambda x: {sql_quoted('x')}), ',') || ']'"
    kind = "CASE WHEN page_type IS NULL THEN '' ELSE ',\"page_type\":\"' || page_type || '\"' END"
    names = f"',\"provenance\":[' || array_to_string(list_transform(sources, lambda x: {sql_quoted('x')}), ',') || ']'"
    return f"{eligibility} || {forms} || {kind} || {names} || ',\"url_key\":' || {sql_quoted('url_key')} || '}}'"


def _inventory(prefix: str, observations: str, attempts: list[tuple[str, str]]) -> dict[str, str]:
    """Observation rows -> candidates, counts, digests, plan; names carry ``prefix``."""
    p = prefix
    method = (
        f'],"classifier":"{V.CLASSIFIER}","classifier_version":"{V.CLASSIFIER_VERSION}",'
        f'"discovery_method":"{V.DISCOVERY_METHOD}","discovery_method_version":"{V.DISCOVERY_METHOD_VERSION}","sources":['
    )
    listed = ", ".join(f"('{s}', '{o}')" for s, o in attempts)
    return {
        f"{p}admitted": f"""SELECT DISTINCT run_id, site, observed_form, source_id, nullif(label, '') AS label,
            {sql_key('observed_form')} AS url_key FROM {observations}""",
        f"{p}typed": f"""SELECT *, {sql_type('words')} AS label_type
            FROM (SELECT *, {sql_words("coalesce(label, '')")} AS words FROM {p}admitted)""",
        f"{p}grouped": f"""SELECT run_id, site, url_key, list_sort(list(DISTINCT observed_form)) AS forms,
            list_sort(list(DISTINCT source_id)) AS sources,
            arg_min(label_type, label) FILTER (label_type IS NOT NULL) AS label_type,
            CASE WHEN {sql_origin('url_key')} <> site THEN 'OFF_ORIGIN'
              WHEN regexp_extract(lower(regexp_extract(url_key, '^https?://[^/?]*([^?]*)', 1)), '[^/](\\.[^./]*)$', 1)
                IN {sql_in(V.NON_PAGE_SUFFIXES)} THEN 'NON_PAGE_RESOURCE' END AS exclusion_reason
            FROM {p}typed GROUP BY run_id, site, url_key""",
        f"{p}candidates": f"""SELECT run_id, site, url_key, forms, sources, exclusion_reason,
            CASE WHEN exclusion_reason IS NULL THEN 'ELIGIBLE' ELSE 'EXCLUDED' END AS eligibility_state,
            CASE WHEN exclusion_reason IS NOT NULL THEN NULL WHEN url_key = site THEN 'HOMEPAGE'
              ELSE coalesce({sql_type('path_words')}, {sql_type('query_words')}, label_type) END AS page_type
            FROM (SELECT *, {sql_words("regexp_extract(url_key, '^https?://[^/?]*([^?]*)', 1)")} AS path_words,
              {sql_words("regexp_extract(url_key, '[?](.*)$', 1)")} AS query_words FROM {p}grouped)""",
        f"{p}counts": f"""SELECT r.run_id, r.site, a.source_id, a.outcome,
            count(c.url_key) AS candidate_count
            FROM runs r CROSS JOIN (VALUES {listed}) a(source_id, outcome)
            LEFT JOIN (SELECT run_id, url_key, unnest(sources) AS source_id FROM {p}candidates) c
              ON c.run_id = r.run_id AND c.source_id = a.source_id
            GROUP BY ALL""",
        f"{p}input_digests": f"""SELECT run_id, 'sha256:' || sha256('[' || string_agg(
              '{{' || CASE WHEN label IS NULL THEN '' ELSE '"label":' || {sql_quoted('label')} || ',' END
              || '"observed_form":' || {sql_quoted('observed_form')} || ',"source_id":' || {sql_quoted('source_id')} || '}}',
              ',' ORDER BY observed_form, source_id, coalesce(label, '')) || ']') AS input_digest
            FROM {p}admitted GROUP BY run_id""",
        f"{p}output_digests": f"""SELECT c.run_id, 'sha256:' || sha256('{{"candidates":[' || items || '{method}'
              || s.items2 || '],"target_origin":' || {sql_quoted('c.site')} || '}}') AS output_digest
            FROM (SELECT run_id, site, string_agg({_candidate_json()}, ',' ORDER BY url_key) AS items
              FROM {p}candidates GROUP BY run_id, site) c
            JOIN (SELECT run_id, string_agg('{{"candidate_count":' || candidate_count || ',"outcome":"' || outcome
              || '","source_id":"' || source_id || '"}}', ',' ORDER BY source_id) AS items2
              FROM {p}counts GROUP BY run_id) s USING (run_id)""",
        f"{p}inventories": f"""SELECT r.run_id, r.site, {sql_id('i', 'r.run_id')} AS inventory_id, input_digest, output_digest
            FROM runs r JOIN {p}input_digests USING (run_id) JOIN {p}output_digests USING (run_id)""",
    }


def _plan(prefix: str, source: str, budget: int | None) -> dict[str, str]:
    p, ceiling = prefix, "NULL::BIGINT" if budget is None else f"{budget}::BIGINT"
    limit = "true" if budget is None else f"selection_rank <= {budget}"
    budgets = "" if budget is None else f'"budgets":{{"max_selected_pages":{budget}}},'
    return {
        f"{p}selections": f"""SELECT * FROM (SELECT run_id, site, url_key,
            row_number() OVER (PARTITION BY run_id ORDER BY url_key <> site, url_key) AS selection_rank,
            CASE WHEN url_key = site THEN 'SEED' ELSE 'CENSUS' END AS selection_reason,
            coalesce(page_type, 'UNCLASSIFIED') AS stratum
            FROM {source}candidates WHERE eligibility_state = 'ELIGIBLE') WHERE {limit}""",
        f"{p}summary": f"""SELECT *, eligible_count - selected_count AS left_by_budget,
            eligible_count = selected_count AS selection_complete,
            CASE WHEN eligible_count > selected_count THEN 'SELECTION_BUDGET_EXHAUSTED' END AS incompleteness_cause
            FROM (SELECT run_id, site, count(*) AS candidate_count,
              count(*) FILTER (eligibility_state = 'ELIGIBLE') AS eligible_count,
              count(*) FILTER (eligibility_state <> 'ELIGIBLE') AS ineligible_count,
              least(count(*) FILTER (eligibility_state = 'ELIGIBLE'),
                coalesce({ceiling}, count(*))) AS selected_count
              FROM {source}candidates GROUP BY run_id, site)""",
        f"{p}exclusions": f"""SELECT * FROM (
            SELECT run_id, 'INELIGIBLE_IN_INVENTORY' AS reason, ineligible_count AS candidate_count FROM {p}summary
            UNION ALL SELECT run_id, 'SELECTION_BUDGET_EXHAUSTED', left_by_budget FROM {p}summary)
            WHERE candidate_count > 0""",
        f"{p}manifests": f"""SELECT s.run_id, {sql_id('s', 's.run_id')} AS sampling_manifest_id,
            i.inventory_id AS inventory_ref, i.output_digest AS inventory_output_digest,
            s.selection_complete, s.incompleteness_cause, s.candidate_count, s.selected_count,
            'sha256:' || sha256('{{{budgets}"inventory_output_digest":"' || i.output_digest || '","inventory_ref":"'
              || i.inventory_id || '","policy_id":"{V.POLICY_ID}","policy_version":"{V.POLICY_VERSION}"}}') AS input_digest,
            'sha256:' || sha256('{{"exclusions":[' || coalesce(e.items, '') || '],' ||
              CASE WHEN s.incompleteness_cause IS NULL THEN '' ELSE '"incompleteness":{{"cause":"' || s.incompleteness_cause || '"}},' END
              || '"mode":"CENSUS","selection_complete":' || s.selection_complete || ',"selections":[' || x.items || ']}}') AS output_digest
            FROM {p}summary s JOIN {source}inventories i USING (run_id)
            LEFT JOIN (SELECT run_id, string_agg('{{"candidate_count":' || candidate_count || ',"reason":"' || reason || '"}}',
              ',' ORDER BY reason) AS items FROM {p}exclusions GROUP BY run_id) e USING (run_id)
            JOIN (SELECT run_id, string_agg('{{"selection_rank":' || selection_rank || ',"selection_reason":"' || selection_reason
              || '","stratum":"' || stratum || '","url_key":' || {sql_quoted('url_key')} || '}}', ',' ORDER BY selection_rank) AS items
              FROM {p}selections GROUP BY run_id) x USING (run_id)""",
    }


_MENU = f"""CASE page_id % 3 WHEN 0 THEN url WHEN 1 THEN site || 'produkte/' || page_id || '.html'
    ELSE site || 'p?section=ueber_uns&n=' || page_id END"""
_ASSET = "CASE page_id % 2 WHEN 0 THEN site || 'files/' || page_id || '.pdf' ELSE 'https://cdn.example.com/a/' || page_id END"

CTES: dict[str, str] = {
    "keyed": f"SELECT page_id, url, html, {sql_origin('url')} AS site, {sql_key('url')} AS url_key FROM pages",
    "pg": f"SELECT *, {_RUN} AS run_id FROM keyed",
    "first_pages": "SELECT run_id, site, min(page_id) AS page_id FROM pg GROUP BY run_id, site",
    "runs": f"SELECT run_id, site, page_id, {sql_instant('page_id')} AS generated_at FROM first_pages",
    "hrefs": """SELECT run_id, site, url, unnest(regexp_extract_all(html, '<a href="[^"]*">[^<]*</a>')) AS tag,
        generate_subscripts(regexp_extract_all(html, '<a href="[^"]*">[^<]*</a>'), 1) - 1 AS pos FROM pg""",
    "links": f"""SELECT run_id, site, url AS page_url, CAST(pos AS BIGINT) AS pos,
        regexp_extract(url, '^(https?://[^/]+)', 1) || regexp_extract(tag, '"([^"]*)"', 1) AS href,
        nullif(regexp_replace(trim({sql_unescaped("regexp_extract(tag, '>([^<]*)<', 1)")}), '\\s+', ' ', 'g'), '') AS label FROM hrefs""",
    "observations": f"""SELECT run_id, site, site AS observed_form, 'CANONICAL_SEED' AS source_id, NULL AS label FROM pg
        UNION ALL SELECT run_id, site, url, 'PAGE_CAPTURE', NULL FROM pg
        UNION ALL SELECT run_id, site, {_MENU}, 'MENU_ENTRY', {sql_list(LABELS)}[page_id % {len(LABELS)} + 1] FROM pg
        UNION ALL SELECT run_id, site, {_ASSET}, 'ASSET_REFERENCE', NULL FROM pg
        UNION ALL SELECT run_id, site, href, 'SAME_ORIGIN_PAGE_LINKS', label FROM links""",
    **_inventory("", "observations", ATTEMPTS),
    **_plan("b_", "", 5),
    **_plan("", "", None),
    "page_observations": """SELECT run_id, site, site AS observed_form, 'CANONICAL_SEED' AS source_id, NULL AS label FROM pg
        UNION ALL SELECT run_id, site, url, 'PAGE_CAPTURE', NULL FROM pg""",
    **_inventory("a_", "page_observations", [a for a in ATTEMPTS if a[0] in ("CANONICAL_SEED", "PAGE_CAPTURE")]),
    **_plan("a_", "a_", None),
    **_plan("f_", "a_", 5),
    "page_rows": "SELECT page_id, run_id, site, url AS requested_url, html FROM pg",
    "seed_rows": """SELECT p.page_id, p.run_id, p.site, p.site AS requested_url, html
        FROM pg p JOIN first_pages f ON f.page_id = p.page_id""",
    "home_rows": "SELECT page_id, 'home-' || page_id AS run_id, site, url AS requested_url, html FROM pg",
    "captures": _captures("page_rows"),
    "seed_captures": _captures("seed_rows"),
    "home_captures": _captures("home_rows"),
    "site_captures": "SELECT * FROM captures UNION ALL SELECT * FROM seed_captures",
    "observed": _observed("captures", False),
    "home_observed": _observed("home_captures", True),
    "site_observed": _observed("site_captures", False),
    "latest": f"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY run_id, page_key ORDER BY page_id DESC) AS n
        FROM (SELECT *, {sql_key('requested_url')} AS page_key FROM site_observed)) WHERE n = 1""",
    "acquired": """SELECT l.*, s.selection_rank, m.sampling_manifest_id, m.output_digest AS manifest_digest
        FROM latest l JOIN a_selections s ON s.run_id = l.run_id AND s.url_key = l.page_key
        JOIN a_manifests m ON m.run_id = l.run_id""",
    "measured": _measured("acquired", "page_key", False),
    "home_measured": _measured("home_observed", "requested_url", True),
}


def sql(final: str) -> str:
    """The final select with the expressions it needs, in dependency order."""
    import re

    needed: dict[str, None] = {}

    def visit(text: str) -> None:
        for name in CTES:
            if name not in needed and re.search(rf"(?:FROM|JOIN|,)\s+{name}\b", text):
                visit(CTES[name])
                needed[name] = None

    visit(final)
    ordered = [name for name in needed]
    if not ordered:
        return final
    return "WITH " + ",\n".join(f"{name} AS ({CTES[name]})" for name in ordered) + "\n" + final
