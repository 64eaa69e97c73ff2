"""Working tables derived from the given ``pages`` and ``events`` tables.

Every branch of the jobs has to occur, so captures take their outcome, status, headers and flags
from the page id.  Every row of the given table is used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagecensus.functions.html import with_page
from pagecensus.functions.url import with_url_identity
from pagecensus.session import bounded_batches, spread

EPOCH = 1767225600  # 2026-01-01T00:00:00Z
LABELS = ["Kontakt", "Unser Team", "Preise & Tarife", "Impressum", "Blog_News", "Case-Studies", "Zeug"]
ATTEMPTS = [
    ("CANONICAL_SEED", "USED"), ("PAGE_CAPTURE", "USED"), ("SAME_ORIGIN_PAGE_LINKS", "USED"),
    ("MENU_ENTRY", "BUDGET_EXHAUSTED"), ("ASSET_REFERENCE", "USED"), ("SITEMAP", "ABSENT"),
    ("ROBOTS_DECLARATION", "NO_SITEMAP_DECLARATION"),
]


def pages(spark: SparkSession, sf_dir: str, tasks: int = 1) -> DataFrame:
    return spread(bounded_batches(spark).read.parquet(f"{sf_dir}/pages.parquet"), tasks)


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def run_of(site: Column) -> Column:
    return F.concat(F.lit("run-"), F.substring(F.sha2(site, 256), 1, 16))


def _by_id(modulus: int, values: list, otherwise=None) -> Column:
    """``values`` for the first remainders of the page id, ``otherwise`` for the rest."""
    listed = [v if isinstance(v, Column) else F.lit(v) for v in [*values, otherwise]]
    return F.get(F.array(*listed), F.least(F.col("page_id") % modulus, F.lit(len(values))).cast("int"))


def _lines(*values: str) -> Column:
    return F.array(*[F.lit(v) for v in values]).cast("array<string>")


def site_pages(spark: SparkSession, sf_dir: str, tasks: int = 1) -> DataFrame:
    """Pages with their site and run; ``html`` is only read by who needs it."""
    keyed = with_url_identity(pages(spark, sf_dir, tasks), "url").where("origin is not null")
    return keyed.withColumnRenamed("origin", "site").withColumn("run_id", run_of(F.col("site"))).drop(
        "url_refusal"
    )


def seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first page id of each site: the page its seed was captured as."""
    return site_pages(spark, sf_dir).groupBy("run_id", "site").agg(F.min("page_id").alias("page_id"))


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return seeds(spark, sf_dir).select(
        "run_id", "site", F.timestamp_seconds(F.col("page_id") + EPOCH).alias("generated_at")
    )


def _as_captures(rows: DataFrame) -> DataFrame:
    """page_id, run_id, site, requested_url, html -> captures."""
    html = F.when(
        F.col("page_id") % 5 == 0, F.regexp_replace("html", "<title>[^<]*</title>", "")
    ).otherwise(F.col("html"))
    html = F.when(
        F.col("page_id") % 9 == 0,
        F.replace(html, F.lit("</head>"), F.lit('<meta name="robots" content="none"></head>')),
    ).otherwise(html)
    response = {
        "final_url": F.col("requested_url"),
        "status_code": _by_id(11, [404, 503], 200),
        "content_type": _by_id(13, ["application/pdf", F.lit(None).cast("string")], "text/html; charset=utf-8"),
        "x_robots_tag": _by_id(
            7,
            [_lines("noindex"), _lines("googlebot: noindex"), _lines("max-snippet: 20, noindex"),
             _lines("noindex: yes"), _lines("googlebot: follow", "noindex")],
            _lines(),
        ),
        "is_https": F.col("requested_url").startswith("https://"),
        "redirect_count": (F.col("page_id") % 4).cast("int"),
        "body": F.encode(html, "UTF-8"),
        "truncated": F.col("page_id") % 19 == 0,
        "undecodable": F.col("page_id") % 23 == 0,
        "declared_charset": _by_id(13, [F.lit(None).cast("string"), F.lit(None).cast("string")], "utf-8"),
    }
    failure = _by_id(17, ["TIMEOUT", "DNS_FAILURE", "BLOCKED_TARGET"])
    return rows.withColumn("failure_kind", failure).select(
        "run_id", "site", "requested_url", "failure_kind",
        *[F.when(F.col("failure_kind").isNull(), c).alias(n) for n, c in response.items()],
        F.timestamp_seconds(F.col("page_id") + EPOCH).alias("captured_at"),
    )


def captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One capture per page."""
    return _as_captures(
        site_pages(spark, sf_dir).withColumn("requested_url", F.col("url"))
    )


def seed_captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One capture per site root, with the content of the site's first page."""
    first = seeds(spark, sf_dir).drop("run_id", "site")
    rows = site_pages(spark, sf_dir).join(first, "page_id").withColumn("requested_url", F.col("site"))
    return _as_captures(rows)


def homepage_captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page taken as the homepage of its own run."""
    rows = site_pages(spark, sf_dir).withColumns({
        "requested_url": F.col("url"), "run_id": F.concat(F.lit("home-"), F.col("page_id").cast("string")),
    })
    return _as_captures(rows)


def link_captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages as plain responses, for link reading."""
    return site_pages(spark, sf_dir).select(
        "run_id", "site", F.lit(None).cast("string").alias("failure_kind"),
        F.col("url").alias("final_url"), F.encode("html", "UTF-8").alias("body"),
        F.lit("utf-8").alias("declared_charset"),
    )


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every source wrote about every site."""
    rows = with_page(site_pages(spark, sf_dir), F.encode("html", "UTF-8"), F.lit("utf-8"), F.col("url"), links=True)
    rows = rows.withColumn("__links", F.col("page.links")).drop("html", "page")
    page_id = F.col("page_id").cast("string")
    menu = _by_id(
        3,
        [F.col("url"), F.concat("site", F.lit("produkte/"), page_id, F.lit(".html"))],
        F.concat("site", F.lit("p?section=ueber_uns&n="), page_id),
    )
    asset = _by_id(
        2, [F.concat("site", F.lit("files/"), page_id, F.lit(".pdf"))],
        F.concat(F.lit("https://cdn.example.com/a/"), page_id),
    )
    label = F.get(F.array(*[F.lit(x) for x in LABELS]), (F.col("page_id") % len(LABELS)).cast("int"))

    def written(source: str, form: Column, text: Column | None = None) -> Column:
        text = F.lit(None) if text is None else text
        return F.struct(
            F.lit(source).alias("source_id"), form.alias("observed_form"), text.cast("string").alias("label")
        )

    direct = F.array(
        written("CANONICAL_SEED", F.col("site")), written("PAGE_CAPTURE", F.col("url")),
        written("MENU_ENTRY", menu, label), written("ASSET_REFERENCE", asset),
    )
    links = F.transform("__links", lambda x: written("SAME_ORIGIN_PAGE_LINKS", x["href"], x["label"]))
    return rows.select("run_id", "site", F.inline(F.concat(direct, links))).select(
        "run_id", "site", "observed_form", "source_id", "label"
    )


def attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same sources were attempted for every site."""
    listed = F.array(*[
        F.struct(F.lit(s).alias("source_id"), F.lit(o).alias("outcome")) for s, o in ATTEMPTS
    ])
    return runs(spark, sf_dir).select("run_id", "site", F.explode(listed).alias("a")).select(
        "run_id", "site", "a.source_id", "a.outcome"
    )


def page_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seeds and captured pages only: what an acquisition can answer completely."""
    rows = site_pages(spark, sf_dir).drop("html")
    none = F.lit(None).cast("string").alias("label")
    forms = F.array(
        F.struct(F.lit("CANONICAL_SEED").alias("source_id"), F.col("site").alias("form")),
        F.struct(F.lit("PAGE_CAPTURE").alias("source_id"), F.col("url").alias("form")),
    )
    return rows.select("run_id", "site", F.explode(forms).alias("w")).select(
        "run_id", "site", F.col("w.form").alias("observed_form"), "w.source_id", none
    )


def page_attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return attempts(spark, sf_dir).where(F.col("source_id").isin("CANONICAL_SEED", "PAGE_CAPTURE"))
