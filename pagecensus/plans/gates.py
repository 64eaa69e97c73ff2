"""Run admission inside the plans: what a run's documents break decides which of them go out.

Each gate runs data-quality rules over narrow projections of the stored documents and ends in a
verdict per run and rule.  A broken inventory withholds everything of its run; a broken plan, or a
selection that does not bind and reproduce its documents, keeps the inventory; broken page
documents withhold all page documents and nothing else.
"""

from __future__ import annotations

from dataclasses import dataclass, fields, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagecensus.operators import lifecycle, receipts
from pagecensus.operators.quality import all_violations, withhold
from pagecensus.operators.quality import documents as rules
from pagecensus.plans.acquisition import Acquisition, acquire
from pagecensus.plans.discovery import Discovery, discover_sites
from pagecensus.session import materialised

INVENTORY, MANIFEST, ADMISSION, PAGES = "inventory", "manifest", "admission", "pages"
#: Which gates a table of a discovery has to pass.
_PLANNED = {"summary", "selections", "exclusions", "manifests"}


@dataclass(frozen=True)
class Gated:
    """What goes out, how far each run got, and why: verdicts are (run_id, gate, rule)."""

    found: Discovery
    got: Acquisition
    runs: DataFrame
    verdicts: DataFrame


def _numbered(df: DataFrame) -> DataFrame:
    """A place for every row.  Verdicts tell runs and rules apart, not places, so any will do."""
    return materialised(df.withColumn("pos", F.monotonically_increasing_id()))


def _verdict(violations: DataFrame, gate: str) -> DataFrame:
    return violations.select("run_id", F.lit(gate).alias("gate"), "rule").distinct()


def discovery_verdicts(found: Discovery, executing_run: str = "run_id") -> DataFrame:
    """The verdicts of the gates before any page is acquired.

    ``executing_run`` names the column of manifests and inventories that holds the run they are
    handed to.
    """
    sources = _numbered(found.attempts.select("run_id", "source_id", "outcome", "candidate_count"))
    candidates = _numbered(found.candidates.select("run_id", "url_key", "eligibility_state"))
    places = candidates.groupBy("run_id", "url_key").agg(F.min("pos").alias("pos"))
    provenance = found.sources.select("run_id", "url_key", "source_id").join(places, ["run_id", "url_key"]).drop("url_key")
    inventories = found.inventories.select(
        "run_id", "inventory_id", "target_origin", "output_digest", F.col(executing_run).alias("executing_run")
    )
    selections = _numbered(found.selections.select("run_id", "url_key", "selection_rank", "stratum"))
    exclusions = _numbered(found.exclusions.select("run_id", "reason", "candidate_count"))
    manifests = found.manifests.withColumn("executing_run", F.col(executing_run))
    return materialised(all_violations(
        _verdict(rules.inventory_semantics(sources, candidates), INVENTORY),
        _verdict(rules.inventory_producer(inventories, sources, candidates, provenance), INVENTORY),
        _verdict(rules.manifest_semantics(selections, exclusions), MANIFEST),
        _verdict(rules.manifest_producer(manifests, selections, exclusions, candidates), MANIFEST),
        _verdict(rules.admission(manifests, inventories, selections, receipts.reproduced_digests(found)), ADMISSION),
    ))


def page_verdicts(found: Discovery, got: Acquisition) -> DataFrame:
    """The verdicts on the page documents that ``got`` holds for the selections of ``found``."""
    text = F.lit(None).cast("string")
    records = got.records.withColumns({"pos": F.col("selection_rank") - 1, "raw_artifact_ref": text})
    selections = found.selections.select("run_id", "url_key", "selection_rank", (F.col("selection_rank") - 1).alias("pos"))
    evidence = _numbered(got.evidence.select("run_id", "measurement_refs", "polarity"))
    measurements = _numbered(got.measurements.select("run_id", "measurement_id"))
    return materialised(_verdict(rules.acquisition(records, found.manifests, selections, measurements, evidence), PAGES))


def _of(verdicts: DataFrame, *gates: str) -> DataFrame:
    return verdicts.where(F.col("gate").isin(*gates))


def admitted(found: Discovery, verdicts: DataFrame) -> Discovery:
    """The documents that pass: plans of runs without any verdict before acquisition, inventories of
    runs without one on the inventory."""
    refused = {name: _of(verdicts, INVENTORY, MANIFEST, ADMISSION) if name in _PLANNED else _of(verdicts, INVENTORY) for name in (f.name for f in fields(found))}
    return replace(found, **{name: withhold(getattr(found, name), bad) for name, bad in refused.items()})


def gated(requests: DataFrame, failed: DataFrame, found: Discovery, captures: DataFrame, acquiring=acquire) -> Gated:
    """Judges a discovery, acquires what may be acquired, judges that, and gives out what is left.

    ``requests`` carries run_id and requested_at; ``failed`` the runs without a site and their code.
    """
    before = discovery_verdicts(found)
    passed = admitted(found, before)
    got = acquiring(passed.selections, captures, passed.manifests)
    after = page_verdicts(passed, got)
    pages = Acquisition(*(withhold(getattr(got, f.name), after) for f in fields(got)))
    runs = lifecycle.site_runs(requests, failed, *(_of(before, g) for g in (INVENTORY, MANIFEST, ADMISSION)), after)
    return Gated(passed, pages, runs, before.unionByName(after))


def analyse_sites(
    requests: DataFrame, seed_captures: DataFrame, robots: DataFrame, sitemaps: DataFrame, captures: DataFrame,
    budget: int | None = None,
) -> Gated:
    """From captures to gated documents: sites are discovered, their selected pages acquired."""
    found, failed = discover_sites(seed_captures, robots, sitemaps, budget)
    return gated(requests, failed, found, captures)
