"""Page acquisition end to end: selections and captures -> records, measurements, evidence."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagecensus.functions.url import with_url_identity
from pagecensus.operators import measurements as m
from pagecensus.operators.findings import findings
from pagecensus.operators.observation import observe_pages
from pagecensus.session import materialised, shuffled


@dataclass(frozen=True)
class Acquisition:
    acquired: DataFrame
    records: DataFrame
    measurements: DataFrame
    evidence: DataFrame


def observed_captures(captures: DataFrame, homepage: bool = False) -> DataFrame:
    """Captures keyed by the identity of the requested URL, read once, bodies dropped."""
    keyed = with_url_identity(captures, "requested_url").drop("url_refusal", "origin")
    return observe_pages(keyed, homepage=homepage)


def wanted_captures(selections: DataFrame, captures: DataFrame) -> DataFrame:
    """The latest captures of the selected pages, bodies included and unread.

    Which ones these are is found without the bodies: one ranking over three narrow columns, which
    sends no more than a page's latest captures on, and only what it leaves meets the captures again,
    ahead of the parser.  Captures without a time are earlier than all others, and count.
    """
    keyed = with_url_identity(captures.select("run_id", "requested_url", "captured_at"), "requested_url").select(
        "run_id", "url_key", "requested_url", "captured_at"
    )
    latest = Window.partitionBy("run_id", "url_key").orderBy(F.desc_nulls_last("captured_at"))
    forms = (
        keyed.join(shuffled(selections.select("run_id", "url_key")), ["run_id", "url_key"])
        .withColumn("place", F.rank().over(latest)).where("place = 1")
        .select("run_id", "requested_url", "captured_at").distinct()
        .toDF("__run", "__form", "__at")
    )
    # Written first: where the list is small, its size is known before any body would be shuffled.
    forms = materialised(forms)
    met = (F.col("run_id") == F.col("__run")) & (F.col("requested_url") == F.col("__form"))
    return captures.join(forms, met & F.col("captured_at").eqNullSafe(F.col("__at")), "leftsemi")


def acquire(selections: DataFrame, captures: DataFrame, manifests: DataFrame) -> Acquisition:
    chosen = observed_captures(wanted_captures(selections, captures))
    acquired = materialised(m.selected_captures(selections, chosen, manifests))
    measured = m.measurements(acquired)
    return Acquisition(acquired, m.acquisition_records(acquired), measured, m.evidence(measured))


@dataclass(frozen=True)
class HomepageAnalysis:
    observed: DataFrame
    measurements: DataFrame
    evidence: DataFrame
    findings: DataFrame


def analyse_homepages(captures: DataFrame) -> HomepageAnalysis:
    """One capture per run, read under the homepage profile, with the findings it supports."""
    observed = observe_pages(captures, requested="requested_url", homepage=True)
    measured = materialised(m.measurements(observed, requested="requested_url", homepage=True))
    mirrored = m.evidence(measured, homepage=True)
    return HomepageAnalysis(observed, measured, mirrored, findings(mirrored, measured))
