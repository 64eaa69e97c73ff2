"""Site discovery end to end: observations and source attempts -> inventory and manifest."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagecensus.functions import fixed_values as V
from pagecensus.functions.columns import lookup
from pagecensus.functions.url import with_url_identity
from pagecensus.operators import census, digests, inventory
from pagecensus.session import materialised
from pagecensus.sources import discovery as sources
from pagecensus.sources.captures import with_failure_tokens


@dataclass(frozen=True)
class Discovery:
    """The tables of one discovery, all keyed by ``run_id``."""

    admitted: DataFrame
    candidates: DataFrame
    forms: DataFrame
    sources: DataFrame
    attempts: DataFrame
    inventories: DataFrame
    summary: DataFrame
    selections: DataFrame
    exclusions: DataFrame
    manifests: DataFrame


def discover(
    runs: DataFrame, observations: DataFrame, attempts: DataFrame, budget: int | None = None
) -> Discovery:
    """``runs`` carries run_id, site (the established origin) and generated_at."""
    admitted = materialised(inventory.admitted_observations(observations))
    found = materialised(inventory.candidates(admitted))
    forms = inventory.candidate_forms(admitted)
    sources = inventory.candidate_sources(admitted)
    counted = inventory.source_counts(attempts, sources)
    inventory_digests = digests.inventory_digests(runs, admitted, found, forms, sources, counted)
    inventories = materialised(digests.inventories(runs, inventory_digests))
    summary = census.plan_summary(found, budget)
    selected = materialised(census.selections(found, budget))
    excluded = census.exclusions(summary)
    outputs = digests.streamed_digests(digests.manifest_fragments(summary, selected, excluded))
    manifests = materialised(digests.manifests(summary, outputs, inventories))
    return Discovery(
        admitted, found, forms, sources, counted, inventories, summary, selected, excluded, manifests
    )


def established_runs(seed_captures: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Seed captures -> (established runs, failed runs with their code).

    The latest capture of a run speaks.  The origin is the one of the seed's final URL; a failed bootstrap establishes nothing and the
    run emits neither an inventory nor a manifest.
    """
    attempt = Window.partitionBy("run_id").orderBy(F.desc("captured_at"), "failure_kind", "final_url")
    latest = seed_captures.select("run_id", "failure_kind", "status_code", "final_url", "captured_at")
    latest = latest.withColumn("__n", F.row_number().over(attempt)).where("__n = 1").drop("__n")
    keyed = with_failure_tokens(with_url_identity(latest, "final_url", "final_"))
    judged = keyed.withColumn(
        "bootstrap_failure",
        F.coalesce(
            "bootstrap_failure",
            F.when(F.col("failure_kind").isNotNull(), F.lit("RUNTIME_ERROR")),
            F.when(F.col("final_origin").isNull(), F.lit("TARGET_REFUSED")),
        ),
    )

    established = judged.where("bootstrap_failure is null").select(
        "run_id", F.col("final_origin").alias("site"), F.col("captured_at").alias("generated_at")
    )
    failed = judged.where("bootstrap_failure is not null").select(
        "run_id", "bootstrap_failure",
        lookup(V.DISCOVERY_FAILURE_CODE, F.col("bootstrap_failure")).alias("failure_code"),
    )
    return established, failed


def seed_observations(runs: DataFrame) -> DataFrame:
    """One seed observation per established run."""
    return runs.select(
        "run_id", "site", F.col("site").alias("observed_form"),
        F.lit(V.SEED_SOURCE).alias("source_id"), F.lit(None).cast("string").alias("label"),
    )


def discover_sites(
    seed_captures: DataFrame, robots: DataFrame, sitemaps: DataFrame, budget: int | None = None
) -> tuple[Discovery, DataFrame]:
    """Captures of seeds, robots files and sitemaps -> (the discovery, failed runs with their code).

    Every source is read once, for the runs whose seed established an origin: links of the seed
    document, sitemaps that the robots file declares (else the conventional one) and what they list.
    """
    established, failed = established_runs(seed_captures)
    runs = materialised(established)
    links, tried_links = sources.seed_page_links(seed_captures, runs=runs)
    declared, tried_robots = (sources.of_runs(found, runs) for found in sources.robots_declarations(robots))
    entries, tried_sitemaps = sources.sitemap_tree(runs, declared, sitemaps)
    tried_seed = runs.select(
        "run_id", "site", F.lit(V.SEED_SOURCE).alias("source_id"), F.lit("USED").alias("outcome")
    )
    seen = seed_observations(runs).unionByName(links).unionByName(entries)
    attempts = tried_seed.unionByName(tried_links).unionByName(tried_robots).unionByName(tried_sitemaps)
    return discover(runs, seen, materialised(attempts), budget), failed
