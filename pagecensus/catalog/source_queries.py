"""Queries over discovery sources, targets and redirects; every page is its own small run here."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagecensus.catalog import inputs
from pagecensus.catalog.oracle import CTES, sql_key, sql_lookup, sql_unescaped
from pagecensus.catalog.queries import register
from pagecensus.operators import targets
from pagecensus.plans.discovery import discover_sites, established_runs
from pagecensus.sources import discovery

OTHER = "https://other.example.com/"


def _page_runs(spark, sf_dir, tasks=1):
    return inputs.site_pages(spark, sf_dir, tasks).withColumn(
        "run_id", F.concat(F.lit("sm-"), F.col("page_id").cast("string"))
    )


def _response(rows, url, body, media):
    """Every page answers for ``url`` with the status, failure and flags of its page id."""
    pid = F.col("page_id")
    failure = F.when(pid % 17 == 0, "TIMEOUT").when(pid % 17 == 1, "DNS_FAILURE").when(pid % 17 == 2, "BLOCKED_TARGET")
    return rows.select(
        "run_id", "site", "page_id", url.alias("requested_url"), url.alias("final_url"), failure.alias("failure_kind"),
        F.when(pid % 11 == 0, 404).when(pid % 11 == 1, 503).otherwise(200).alias("status_code"),
        media.alias("content_type"), F.encode(body, "UTF-8").alias("body"), (pid % 19 == 0).alias("truncated"),
        (pid % 23 == 0).alias("undecodable"), F.lit("utf-8").alias("declared_charset"),
    )


def _by_page(modulus, values):
    return F.get(F.array(*values), (F.col("page_id") % modulus).cast("int"))


def _robots(spark, sf_dir):
    rows, site = _page_runs(spark, sf_dir).drop("html"), F.col("site")
    body = _by_page(6, [
        F.lit("# none\nUser-agent: *\nDisallow:\n"),
        F.concat(F.lit("Sitemap: "), site, F.lit("a.xml\r\nsitemap : /b.xml # x\nSitemap:\n")),
        F.lit("<html>Sitemap: /a.xml"),
        F.concat(F.lit("\ufeffSITEMAP:"), site, F.lit("idx.xml\nSitemap: " + OTHER + "x.xml\n")),
        F.lit("Sitemap: http://[::1\n"),
        F.concat(F.lit("Sitemap: "), site, F.lit("a.xml\nSitemap: "), site, F.lit("a.xml#f\nSitemap: "), site, F.lit("c.xml")),
    ])
    return _response(rows, F.concat(site, F.lit("robots.txt")), body, F.lit("text/plain"))


_BLOCKED = f"""CASE WHEN page_id % 17 < 3 THEN {sql_lookup({'0': 'TIMEOUT', '1': 'PROVIDER_FAILURE', '2': 'TARGET_POLICY_REFUSED'}, "CAST(page_id % 17 AS VARCHAR)")}
    WHEN page_id % 11 = 0 THEN 'ABSENT' WHEN page_id % 11 = 1 THEN 'PROVIDER_FAILURE' WHEN page_id % 23 = 0 THEN 'RUNTIME_ERROR' END"""
CTES.update({
    "smp": f"SELECT *, 'sm-' || page_id AS srun, {_BLOCKED} AS blocked, page_id % 19 = 0 AS cut FROM pg",
    "robots_said": """SELECT *, CASE page_id % 6 WHEN 1 THEN [site || 'a.xml', site || 'b.xml'] WHEN 3 THEN [site || 'idx.xml', 'https://other.example.com/x.xml']
        WHEN 5 THEN [site || 'a.xml', site || 'a.xml', site || 'c.xml'] ELSE CAST([] AS VARCHAR[]) END AS said FROM smp WHERE blocked IS NULL""",
})


@register("robots_declarations", """SELECT srun AS run_id, unnest(said) AS declared_url, generate_subscripts(said, 1) - 1 AS pos FROM robots_said""")
def robots_declarations(spark, sf_dir):
    found = discovery.robots_declarations(_robots(spark, sf_dir))[0]
    return found.select("run_id", "declared_url", F.col("pos").cast("bigint").alias("pos"))


@register("robots_outcomes", """SELECT srun AS run_id, 'ROBOTS_DECLARATION' AS source_id, coalesce(blocked, CASE WHEN page_id % 6 = 2 THEN 'MALFORMED'
    WHEN cut THEN 'BUDGET_EXHAUSTED' WHEN page_id % 6 = 0 THEN 'NO_SITEMAP_DECLARATION' WHEN page_id % 6 = 4 THEN 'MALFORMED' ELSE 'USED' END) AS outcome FROM smp""")
def robots_outcomes(spark, sf_dir):
    return discovery.robots_declarations(_robots(spark, sf_dir))[1].drop("site")


def _encoded_robots(spark, sf_dir):
    """Declarations in UTF-16, in what is declared as ASCII but is not, and in UTF-8."""
    plain = _robots(spark, sf_dir).where("failure_kind is null and status_code = 200 and not undecodable")
    text = F.concat(F.lit("Sitemap: "), F.col("site"), F.lit("caf\u00e9.xml"))
    kind = F.col("page_id") % 3
    return plain.withColumns({
        "body": F.when(kind == 0, F.encode(text, "UTF-16")).otherwise(F.encode(text, "UTF-8")),
        "declared_charset": F.when(kind == 0, "utf-16").when(kind == 1, "us-ascii").otherwise("utf-8"),
        "truncated": F.lit(False),
    })


@register("robots_encodings", """SELECT srun AS run_id, CASE WHEN page_id % 3 = 0 THEN 'MALFORMED' ELSE 'USED' END AS outcome,
    CASE page_id % 3 WHEN 1 THEN site || 'caf' || chr(65533) || chr(65533) || '.xml' WHEN 2 THEN site || 'caf\u00e9.xml' END AS declared_url
    FROM smp WHERE blocked IS NULL""")
def robots_encodings(spark, sf_dir):
    declared, attempts = discovery.robots_declarations(_encoded_robots(spark, sf_dir))
    return attempts.join(declared, "run_id", "left").select("run_id", "outcome", "declared_url")


def _sitemaps(spark, sf_dir):
    """Each run serves a.xml, b.xml (malformed), c.xml (empty), idx.xml and sitemap.xml."""
    rows, site = _page_runs(spark, sf_dir).drop("html"), F.col("site")
    pid = F.col("page_id").cast("string")
    ns = '<urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">'

    def loc(url, entry="url"):
        return F.concat(F.lit(f"<{entry}><loc> "), F.replace(url, F.lit("&"), F.lit("&amp;")), F.lit(f"</loc></{entry}>"))

    files = {
        "a.xml": F.concat(F.lit(ns), loc(F.col("url")), loc(F.concat(site, F.lit("x/"), pid)), loc(F.col("url")), F.lit("</urlset>")),
        "b.xml": F.lit("<urlset><url><loc>http://a.example/</loc></url>"),
        "c.xml": F.lit("<urlset></urlset>"),
        "idx.xml": F.concat(
            F.lit("<sitemapindex>"), loc(F.concat(site, F.lit("a.xml")), "sitemap"), loc(F.concat(site, F.lit("c.xml")), "sitemap"),
            loc(F.lit(OTHER + "d.xml"), "sitemap"), loc(F.concat(site, F.lit("idx.xml")), "sitemap"), F.lit("</sitemapindex>"),
        ),
        "sitemap.xml": F.concat(F.lit("<urlset>"), loc(F.concat(site, F.lit("s/"), pid)), F.lit("</urlset>")),
    }
    served = F.array(*[F.struct(F.lit(name).alias("name"), text.alias("text")) for name, text in files.items()])
    each = rows.select("run_id", "site", "page_id", F.explode(served).alias("f"))
    plain = each.select(
        "run_id", "site", F.concat("site", F.col("f.name")).alias("requested_url"),
        F.lit(None).cast("string").alias("failure_kind"), F.lit(200).alias("status_code"),
        F.encode(F.col("f.text"), "UTF-8").alias("body"), F.lit(False).alias("truncated"), F.lit(False).alias("undecodable"),
    )
    return plain


@register("sitemap_documents", """SELECT srun AS run_id, site || name AS doc_key, outcome, root, locs FROM smp, (VALUES
      ('a.xml', 'USED', 'urlset', 3), ('b.xml', 'MALFORMED', 'urlset', 0), ('c.xml', 'EMPTY', 'urlset', 0),
      ('idx.xml', 'USED', 'sitemapindex', 4), ('sitemap.xml', 'USED', 'urlset', 1)) f(name, outcome, root, locs)""")
def sitemap_documents(spark, sf_dir):
    found = discovery.sitemap_documents(_sitemaps(spark, sf_dir))
    return found.withColumn("locs", F.size("locs"))


@register("sitemap_copies", """SELECT srun AS run_id, site || name AS doc_key, outcome, locs FROM smp, (VALUES
      ('a.xml', 'USED', 3), ('b.xml', 'MALFORMED', 0), ('c.xml', 'EMPTY', 0), ('idx.xml', 'USED', 4), ('sitemap.xml', 'USED', 1)) f(name, outcome, locs)""")
def sitemap_copies(spark, sf_dir):
    """Each document was first answered with 404 and is there later: the later capture speaks."""
    there = _sitemaps(spark, sf_dir).withColumn("captured_at", F.timestamp_seconds(F.lit(2)))
    gone = there.withColumns({"captured_at": F.timestamp_seconds(F.lit(1)), "status_code": F.lit(404)})
    found = discovery.sitemap_documents(gone.unionByName(there))
    return found.select("run_id", "doc_key", "outcome", F.size("locs").alias("locs"))


def _tree(spark, sf_dir, **bounds):
    runs = _page_runs(spark, sf_dir).select("run_id", "site")
    declared = discovery.robots_declarations(_robots(spark, sf_dir))[0]
    return discovery.sitemap_tree(runs, declared, _sitemaps(spark, sf_dir), **bounds)


# What a run's robots file leads to: 0 the conventional sitemap, 1 a and b, 3 index with a and c, 5 a and c.
_KIND = "CASE WHEN blocked IS NULL AND page_id % 6 IN (1, 3, 5) THEN page_id % 6 ELSE 0 END"
CTES["trees"] = f"SELECT *, {_KIND} AS kind FROM smp"


@register("sitemap_entries", """SELECT srun AS run_id, unnest(CASE WHEN kind = 0 THEN [site || 's/' || page_id]
    ELSE [url, site || 'x/' || page_id] END) AS observed_form, 'SITEMAP' AS source_id FROM trees""")
def sitemap_entries(spark, sf_dir):
    return _tree(spark, sf_dir)[0].select("run_id", "observed_form", "source_id")


@register("sitemap_outcomes", """SELECT srun AS run_id, 'SITEMAP' AS source_id, 'USED' AS outcome FROM trees
    UNION ALL SELECT srun, 'REFUSED_SITEMAP', 'TARGET_POLICY_REFUSED' FROM trees WHERE kind = 3""")
def sitemap_outcomes(spark, sf_dir):
    return _tree(spark, sf_dir)[1].drop("site")


@register("sitemap_budgets", """SELECT srun AS run_id, 'SITEMAP' AS source_id, CASE WHEN kind = 0 THEN 'USED' ELSE 'BUDGET_EXHAUSTED' END AS outcome FROM trees
    UNION ALL SELECT srun, 'REFUSED_SITEMAP', 'TARGET_POLICY_REFUSED' FROM trees WHERE kind = 3""")
def sitemap_budgets(spark, sf_dir):
    return _tree(spark, sf_dir, max_documents=2, max_entries=1)[1].drop("site")


@register("all_sitemap_entries", """SELECT srun AS run_id, site || 'e/' || d || '/' || e AS observed_form, 'SITEMAP' AS source_id
    FROM smp, range(7) t(d), range(80) u(e)""")
def all_sitemap_entries(spark, sf_dir):
    """An index of an index of seven documents with eighty locations each; nothing is left out."""
    rows, site = _page_runs(spark, sf_dir, tasks=4).drop("html"), F.col("site")

    def listed(root, entry, urls):
        parts = F.transform(urls, lambda u: F.concat(F.lit(f"<{entry}><loc>"), u, F.lit(f"</loc></{entry}>")))
        return F.concat(F.lit(f"<{root}>"), F.array_join(parts, ""), F.lit(f"</{root}>"))

    def numbered(prefix, n, suffix):
        return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.concat(site, F.lit(prefix), i.cast("string"), F.lit(suffix)))

    files = [F.struct(F.lit("sitemap.xml").alias("name"), listed("sitemapindex", "sitemap", F.array(F.concat(site, F.lit("more.xml")))).alias("text")),
             F.struct(F.lit("more.xml").alias("name"), listed("sitemapindex", "sitemap", numbered("part", 7, ".xml")).alias("text"))]
    files += [
        F.struct(F.lit(f"part{d}.xml").alias("name"), listed("urlset", "url", numbered(f"e/{d}/", 80, "")).alias("text")) for d in range(7)
    ]
    bodies = rows.select("run_id", "site", F.explode(F.array(*files)).alias("f")).select(
        "run_id", "site", F.concat("site", F.col("f.name")).alias("requested_url"),
        F.lit(None).cast("string").alias("failure_kind"), F.lit(200).alias("status_code"),
        F.encode(F.col("f.text"), "UTF-8").alias("body"), F.lit(False).alias("truncated"), F.lit(False).alias("undecodable"),
    )
    declared = discovery.robots_declarations(_robots(spark, sf_dir))[0].limit(0)
    found = discovery.sitemap_tree(rows.select("run_id", "site"), declared, bodies)[0]
    return found.select("run_id", "observed_form", "source_id")


@register("source_outcomes", """SELECT run_id, CASE WHEN bool_or(r = 0) THEN 'TIMEOUT' WHEN bool_or(r = 1) THEN 'USED'
    WHEN bool_or(r = 2) THEN 'TARGET_POLICY_REFUSED' WHEN bool_or(r = 3) THEN 'MALFORMED' WHEN bool_or(r = 4) THEN 'EMPTY' ELSE 'ABSENT' END AS outcome
    FROM (SELECT run_id, page_id % 29 AS r FROM pg) GROUP BY run_id""")
def source_outcomes(spark, sf_dir):
    listed = ["TIMEOUT", "USED", "TARGET_POLICY_REFUSED", "MALFORMED", "EMPTY", "ABSENT"]
    reads = inputs.site_pages(spark, sf_dir).select(
        "run_id",
        F.get(F.array(*[F.lit(x) for x in listed]), F.least(F.col("page_id") % 29, F.lit(5)).cast("int")).alias("outcome"),
    )
    return discovery.source_outcome(reads)


def _link_seeds(spark, sf_dir):
    rows = _page_runs(spark, sf_dir)
    media = _by_page(13, [F.lit("application/pdf"), F.lit(None).cast("string"), *[F.lit("text/html")] * 11])
    return _response(rows, F.col("url"), F.col("html"), media)


# The links of every page by itself: two pages may have one URL.
CTES.update({
    "own_links": f"""SELECT srun, page_id, site, pos - 1 AS pos, regexp_extract(url, '^(https?://[^/]+)', 1) || regexp_extract(tag, '"([^"]*)"', 1) AS href,
        nullif(regexp_replace(trim({sql_unescaped("regexp_extract(tag, '>([^<]*)<', 1)")}), '\\s+', ' ', 'g'), '') AS label
        FROM (SELECT srun, page_id, site, url, unnest(regexp_extract_all(html, '<a href="[^"]*">[^<]*</a>')) AS tag,
          generate_subscripts(regexp_extract_all(html, '<a href="[^"]*">[^<]*</a>'), 1) AS pos FROM smp WHERE blocked IS NULL AND page_id % 13 <> 0)""",
    "own_firsts": "SELECT *, row_number() OVER (PARTITION BY srun ORDER BY pos) AS k FROM (SELECT srun, href, min(pos) AS pos FROM own_links GROUP BY ALL)",
    "own_stops": "SELECT srun, min(pos) AS stop FROM own_firsts WHERE k > 3 GROUP BY srun",
})
CTES.update({
    "sl": "SELECT 'sm-' || p.page_id AS srun, p.page_id, p.site, l.pos, l.href, l.label FROM smp p JOIN links l ON l.page_url = p.url WHERE p.blocked IS NULL AND p.page_id % 13 <> 0",
    "slf": "SELECT *, row_number() OVER (PARTITION BY srun ORDER BY pos) AS k FROM (SELECT srun, href, min(pos) AS pos FROM sl GROUP BY ALL)",
    "stops": "SELECT srun, min(pos) AS stop FROM slf WHERE k > 3 GROUP BY srun",
})


@register("link_budget", """SELECT DISTINCT srun AS run_id, href AS observed_form, 'SAME_ORIGIN_PAGE_LINKS' AS source_id, label
    FROM own_links LEFT JOIN own_stops USING (srun) WHERE stop IS NULL OR pos < stop""")
def link_budget(spark, sf_dir):
    return discovery.seed_page_links(_link_seeds(spark, sf_dir), max_links=3, max_examined=5)[0].drop("site")


@register("link_budget_outcomes", """SELECT srun AS run_id, 'SAME_ORIGIN_PAGE_LINKS' AS source_id, CASE WHEN page_id % 17 < 3 OR page_id % 11 < 2 THEN blocked
      WHEN page_id % 13 = 0 THEN 'MALFORMED' WHEN blocked IS NOT NULL THEN blocked
      WHEN stop IS NOT NULL OR cut THEN 'BUDGET_EXHAUSTED' ELSE 'USED' END AS outcome FROM smp LEFT JOIN stops USING (srun)""")
def link_budget_outcomes(spark, sf_dir):
    return discovery.seed_page_links(_link_seeds(spark, sf_dir), max_links=3, max_examined=5)[1].drop("site")


@register("all_page_links", """SELECT DISTINCT srun AS run_id, href AS observed_form, 'SAME_ORIGIN_PAGE_LINKS' AS source_id, label FROM own_links""")
def all_page_links(spark, sf_dir):
    return discovery.seed_page_links(_link_seeds(spark, sf_dir))[0].drop("site")


@register("site_discovery", f"""SELECT DISTINCT run_id, url_key, source_id FROM (
    SELECT srun AS run_id, site AS url_key, 'CANONICAL_SEED' AS source_id FROM smp WHERE page_id % 17 > 2
    UNION ALL SELECT srun, {sql_key('href')}, 'SAME_ORIGIN_PAGE_LINKS' FROM own_links
    UNION ALL SELECT srun, {sql_key('form')}, 'SITEMAP' FROM (SELECT srun, page_id, unnest(CASE WHEN kind = 0 THEN [site || 's/' || page_id]
      ELSE [url, site || 'x/' || page_id] END) AS form FROM trees) WHERE page_id % 17 > 2)""")
def site_discovery(spark, sf_dir):
    """Seeds, robots files and sitemaps of every run to the sources of its candidates."""
    seeds = _link_seeds(spark, sf_dir).withColumn("captured_at", F.timestamp_seconds("page_id"))
    found, _ = discover_sites(seeds, _robots(spark, sf_dir), _sitemaps(spark, sf_dir))
    return found.sources.select("run_id", "url_key", "source_id")


@register("site_discovery_failures", """SELECT 'sm-' || page_id AS run_id FROM pg WHERE page_id % 17 < 3""")
def site_discovery_failures(spark, sf_dir):
    return established_runs(_link_seeds(spark, sf_dir).withColumn("captured_at", F.timestamp_seconds("page_id")))[1].select("run_id")


# --- targets and redirects ------------------------------------------------------------------------

CTES["verdicts"] = """SELECT regexp_extract(url, '^https?://([^/]*)', 1) AS host, bool_and(page_id % 5 = 0 OR page_id % 31 <> 0) AS ok
    FROM pg WHERE page_id % 3 <> 0 GROUP BY ALL"""


@register("target_admissibility", """SELECT page_id, p.url, CASE WHEN page_id % 7 = 1 THEN 'BLOCKED_TARGET'
    WHEN page_id % 7 = 2 THEN CASE WHEN page_id % 8 IN (0, 1, 5) OR page_id % 8 = 4 AND page_id % 256 BETWEEN 16 AND 31 THEN 'BLOCKED_TARGET' END
    WHEN v.ok IS NULL THEN 'DNS_FAILURE' WHEN NOT v.ok THEN 'BLOCKED_TARGET' END AS failure_kind
    FROM pg p LEFT JOIN verdicts v ON v.host = regexp_extract(p.url, '^https?://([^/]*)', 1)""")
def target_admissibility(spark, sf_dir):
    rows = inputs.site_pages(spark, sf_dir).drop("html", "url_key")
    pid = F.col("page_id")
    octet = _by_page(8, [F.lit(x) for x in ("10", "127", "8", "203", "172", "224", "93", "93")])
    second = (pid % 256).cast("string")
    literal = F.concat(F.lit("http://"), octet, F.lit("."), second, F.lit(".113.7/"))
    wanted = rows.withColumn("page_url", F.col("url")).withColumn(
        "url",
        F.when(pid % 7 == 1, F.replace("url", F.lit("://"), F.lit("://u@"))).when(pid % 7 == 2, literal).otherwise(F.col("url")),
    )
    resolved = rows.where(pid % 3 != 0).select(
        F.regexp_extract("url", "^https?://([^/]*)", 1).alias("host"),
        F.when(pid % 5 == 0, F.concat(F.lit("2600:db8::"), F.lower(F.hex(F.shiftright(pid, 16))), F.lit(":"), F.lower(F.hex(pid % 65536))))
        .when(pid % 31 == 0, F.lit("::ffff:10.0.0.1"))
        .otherwise(F.concat(F.lit("93."), second, F.lit(".113.7"))).alias("address"),
    )
    return targets.admissible_targets(wanted, resolved).select("page_id", F.col("page_url").alias("url"), "failure_kind")


@register("public_addresses", """SELECT page_id, address, CASE WHEN a = 10 OR a = 127 OR a >= 224 OR a = 0 OR (a = 100 AND b BETWEEN 64 AND 127)
      OR (a = 169 AND b = 254) OR (a = 172 AND b BETWEEN 16 AND 31) OR (a = 192 AND b = 168) OR (a = 198 AND b IN (18, 19))
      OR (a = 192 AND b = 0 AND c IN (0, 2) AND NOT (c = 0 AND d IN (9, 10))) OR (a = 198 AND b = 51 AND c = 100)
      OR (a = 203 AND b = 0 AND c = 113) THEN false ELSE true END AS is_public
    FROM (SELECT *, a || '.' || b || '.' || c || '.' || d AS address FROM (SELECT page_id,
      [0, 10, 100, 127, 169, 172, 192, 198, 203, 224, 240, 8][page_id % 12 + 1] AS a,
      [0, 16, 18, 31, 51, 64, 127, 128, 168, 254, 1][page_id % 11 + 1] AS b, [0, 2, 100, 113][page_id % 4 + 1] AS c, page_id % 13 AS d FROM pages))""")
def public_addresses(spark, sf_dir):
    parts = [
        _by_page(12, [F.lit(x) for x in (0, 10, 100, 127, 169, 172, 192, 198, 203, 224, 240, 8)]),
        _by_page(11, [F.lit(x) for x in (0, 16, 18, 31, 51, 64, 127, 128, 168, 254, 1)]),
        _by_page(4, [F.lit(x) for x in (0, 2, 100, 113)]), F.col("page_id") % 13,
    ]
    rows = inputs.pages(spark, sf_dir).select(
        "page_id", F.concat_ws(".", *[p.cast("string") for p in parts]).alias("address")
    )
    return targets.with_public_flag(rows, "address").drop("is_address")


@register("redirect_chains", """SELECT page_id, CASE page_id % 7 WHEN 0 THEN 'RESPONSE_RECEIVED' WHEN 1 THEN 'RESPONSE_RECEIVED' WHEN 2 THEN 'TOO_MANY_REDIRECTS'
      WHEN 3 THEN 'INVALID_REDIRECT' WHEN 4 THEN 'BLOCKED_TARGET' WHEN 5 THEN 'CONNECTION_FAILURE' ELSE 'RESPONSE_RECEIVED' END AS outcome,
    CAST(CASE page_id % 7 WHEN 0 THEN 0 WHEN 1 THEN 2 WHEN 2 THEN 3 WHEN 3 THEN 0 WHEN 4 THEN 1 WHEN 5 THEN 1 ELSE 3 END AS BIGINT) AS redirect_count,
    CASE page_id % 7 WHEN 0 THEN url WHEN 1 THEN site || 'h2' WHEN 6 THEN site || 'h3' END AS final_url,
    CAST(CASE page_id % 7 WHEN 0 THEN 200 WHEN 1 THEN 404 WHEN 6 THEN 200 END AS BIGINT) AS final_status FROM pg""")
def redirect_chains(spark, sf_dir):
    """Chains of zero to four hops; scope is the page's own site."""
    rows = inputs.site_pages(spark, sf_dir).drop("html").withColumn("chain_id", F.col("page_id").cast("string"))
    site, kind = F.col("site"), F.col("page_id") % 7

    def hop(url, status, location):
        return F.struct(url.alias("url"), F.lit(status).alias("status"), location.cast("string").alias("location"))

    def at(n):
        return F.concat(site, F.lit(f"h{n}"))

    none = F.lit(None)
    paths = [
        F.array(hop(F.col("url"), 200, none)),
        F.array(hop(F.col("url"), 301, F.lit(" /h1 ")), hop(at(1), 302, at(2)), hop(at(2), 404, none)),
        F.array(hop(F.col("url"), 301, at(1)), hop(at(1), 307, at(2)), hop(at(2), 308, at(3)), hop(at(3), 303, F.col("url"))),
        F.array(hop(F.col("url"), 301, F.lit(" "))),
        F.array(hop(F.col("url"), 302, F.lit(OTHER)), hop(F.lit(OTHER), 200, none)),
        F.array(hop(F.col("url"), 301, at(9))),
        F.array(hop(F.col("url"), 301, at(1)), hop(at(1), 301, at(2)), hop(at(2), 301, F.lit("h3")), hop(at(3), 200, none)),
    ]
    path = F.get(F.array(*paths), kind.cast("int"))
    hops = rows.select("chain_id", F.inline(path))
    starts = rows.select("chain_id", "url", site.alias("scope"))
    found = targets.redirect_chains(starts, hops, max_redirects=3)
    return found.select(
        F.col("chain_id").cast("bigint").alias("page_id"), "outcome", F.col("redirect_count").cast("bigint").alias("redirect_count"),
        "final_url", F.col("final_status").cast("bigint").alias("final_status"),
    )


@register("long_redirects", """SELECT page_id, CASE page_id % 3 WHEN 1 THEN 'TOO_MANY_REDIRECTS' ELSE 'RESPONSE_RECEIVED' END AS outcome,
    CASE page_id % 3 WHEN 0 THEN site || 'r9' WHEN 2 THEN url END AS final_url FROM pg""")
def long_redirects(spark, sf_dir):
    """Ten redirects to an answer, a circle of three, and none."""
    rows = inputs.site_pages(spark, sf_dir).drop("html").withColumn("chain_id", F.col("page_id").cast("string"))
    places = [F.col("url"), *[F.concat("site", F.lit(f"r{n}")) for n in range(10)]]

    def hop(n, status, to):
        return F.struct(places[n].alias("url"), F.lit(status).alias("status"), to.cast("string").alias("location"))

    none = F.lit(None)
    paths = [
        F.array(*[hop(n, 301, places[n + 1]) for n in range(10)], hop(10, 200, none)),
        F.array(hop(0, 302, places[1]), hop(1, 302, places[2]), hop(2, 302, places[0])),
        F.array(hop(0, 200, none)),
    ]
    hops = rows.select("chain_id", F.inline(F.get(F.array(*paths), (F.col("page_id") % 3).cast("int"))))
    found = targets.redirect_chains(rows.select("chain_id", "url", F.col("site").alias("scope")), hops)
    return found.select(F.col("chain_id").cast("bigint").alias("page_id"), "outcome", "final_url")
