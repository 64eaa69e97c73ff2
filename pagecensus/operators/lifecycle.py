"""Run lifecycles: terminal states, stages, failed runs, and the audit of state histories."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagecensus.functions import fixed_values as V
from pagecensus.functions.columns import instant
from pagecensus.functions.url import with_url_identity
from pagecensus.operators.ranking import in_ranges
from pagecensus.sources.captures import transition_dimension


def audit(states: DataFrame, order: list[str]) -> DataFrame:
    """State histories -> illegal successions, unknown tokens, activity after an end.

    ``order`` is the total order of a run's rows.  They are judged range by range, so a run holding a
    third of all events is spread like any other.  What lies ahead of a range in the same run is one
    row: a range's first run alone goes on from an earlier one.
    """
    ranged, keys = in_ranges(states.select("run_id", "state", *order), ["run_id"], [F.col(c) for c in order])
    piece = Window.partitionBy("__range", "run_id").orderBy(*keys)
    run = Window.partitionBy("run_id").orderBy("__range")
    terminal = F.coalesce(F.col("state").isin(V.TERMINAL_STATES), F.lit(False))
    local = ranged.select(
        "run_id", "__range", "state",
        F.row_number().over(piece).alias("__local"),
        F.lag("state").over(piece).alias("__before"),
        F.max(terminal).over(piece.rowsBetween(Window.unboundedPreceding, -1)).alias("__ended"),
        F.lead(F.lit(True)).over(piece).isNull().alias("__last"),
    )
    earlier = run.rowsBetween(Window.unboundedPreceding, -1)
    carried = local.where("__last").select(
        F.col("run_id").alias("__run"), F.col("__range").alias("__in"),
        F.sum("__local").over(earlier).alias("__offset"),
        F.lag("state").over(run).alias("__carried"),
        F.max(F.coalesce("__ended", F.lit(False)) | terminal).over(earlier).alias("__over"),
    ).where("__offset is not null")
    edges = F.broadcast(transition_dimension(states.sparkSession)).select(
        F.col("from_state").alias("previous"), F.col("to_state").alias("state"), F.lit(True).alias("legal")
    )
    judged = (
        local.join(
            F.broadcast(carried), (F.col("__range") == F.col("__in")) & F.col("run_id").eqNullSafe(F.col("__run")), "left"
        )
        .withColumn("place", (F.col("__local") + F.coalesce("__offset", F.lit(0))).cast("bigint"))
        .withColumn("previous", F.when(F.col("__local") == 1, F.col("__carried")).otherwise(F.col("__before")))
        .join(edges, ["previous", "state"], "left")
    )
    unknown = ~F.col("state").isin(V.RUN_STATES)
    readable = ~unknown & F.coalesce(F.col("previous").isin(V.RUN_STATES), F.lit(True))
    illegal = F.when(F.col("previous").isNull(), F.col("state") != "CREATED").otherwise(
        F.col("legal").isNull()
    )
    found = F.array(
        F.when(unknown, F.lit("unknown_state")),
        F.when(readable & illegal, F.lit("illegal_transition")),
        F.when(F.col("__ended") | F.col("__over"), F.lit("activity_after_end")),
    )
    return judged.select(
        "run_id", "place", "previous", "state", F.explode(F.array_compact(found)).alias("rule")
    )


def screened_requests(requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(admitted, refused).  A refused request is never echoed: its target is dropped."""
    judged = with_url_identity(requests, "target_url").drop("url_key", "origin")
    credentials = F.coalesce(F.col("url_refusal") == "CREDENTIALS_PRESENT", F.lit(False))
    mode = F.coalesce(F.col("scan_mode") == V.SUPPORTED_SCAN_MODE, F.lit(False))
    admitted = judged.where(~credentials & mode).drop("url_refusal")
    refused = judged.where(credentials | ~mode).select(
        "run_id", "request_id",
        F.when(credentials, V.TARGET_REFUSED_CODE).otherwise("SCAN_MODE_NOT_SUPPORTED").alias("code"),
    )
    return admitted, refused


def homepage_stages(observed: DataFrame) -> DataFrame:
    """The fetch, and the reading of the document if a response arrived.

    A response that is no document is not a failure of the reading stage.
    """
    failed = F.col("failure_kind").isNotNull()
    fetch = F.struct(
        F.lit("PAGE_FETCH").alias("stage_id"), F.when(failed, "FAILED").otherwise("SUCCEEDED").alias("status")
    )
    reading = F.struct(
        F.lit("HTML_OBSERVATION").alias("stage_id"),
        F.when(F.col("document_status") == "UNREADABLE", "FAILED").otherwise("SUCCEEDED").alias("status"),
    )
    moment = instant(F.col("captured_at"))
    return observed.select(
        "run_id", F.explode(F.when(failed, F.array(fetch)).otherwise(F.array(fetch, reading))).alias("s"),
        moment.alias("started_at"), moment.alias("finished_at"),
    ).select("run_id", "s.stage_id", "s.status", "started_at", "finished_at")


def homepage_states(observed: DataFrame) -> DataFrame:
    """One terminal state per homepage run."""
    failed = F.col("failure_kind").isNotNull()
    moment = instant(F.col("captured_at"))
    return observed.select(
        "run_id", F.when(failed, "FAILED").otherwise("SUCCEEDED").alias("state"),
        moment.alias("entered_at"), moment.alias("finished_at"),
        F.when(F.col("failure_kind") == "BLOCKED_TARGET", V.TARGET_REFUSED_CODE)
        .when(failed, V.PAGE_FETCH_FAILED_CODE).alias("failure_code"),
    )


def site_runs(
    requests: DataFrame, bootstrap_failures: DataFrame, inventory_violations: DataFrame,
    manifest_violations: DataFrame, admission_violations: DataFrame, acquisition_violations: DataFrame,
) -> DataFrame:
    """How far each run got: its state, failure code, and which documents survive.

    A broken inventory withholds everything after it, a broken plan keeps the inventory, a refused
    selection drops the manifest, broken page documents withhold all page documents.
    """

    def marked(violations: DataFrame, name: str) -> DataFrame:
        return violations.select("run_id").distinct().withColumn(name, F.lit(True))

    runs = requests.select("run_id", "requested_at").join(
        bootstrap_failures.select("run_id", F.col("failure_code").alias("__bootstrap")), "run_id", "left"
    )
    breaches = {
        "__inventory": inventory_violations, "__manifest": manifest_violations,
        "__admission": admission_violations, "__pages": acquisition_violations,
    }
    for name, violations in breaches.items():
        runs = runs.join(marked(violations, name), "run_id", "left").fillna(False, subset=[name])
    no_site = F.col("__bootstrap").isNotNull()
    code = (
        F.when(no_site, F.col("__bootstrap"))
        .when(F.col("__inventory"), V.INVENTORY_WITHHELD_CODE)
        .when(F.col("__manifest"), V.MANIFEST_WITHHELD_CODE)
        .when(F.col("__admission"), V.SELECTION_REFUSED_CODE)
        .when(F.col("__pages"), V.ACQUISITION_WITHHELD_CODE)
    )
    no_inventory = no_site | F.col("__inventory")
    no_manifest = no_inventory | F.col("__manifest") | F.col("__admission")
    return runs.select(
        "run_id", F.when(code.isNull(), "SUCCEEDED").otherwise("FAILED").alias("state"),
        instant(F.col("requested_at")).alias("entered_at"), code.alias("failure_code"),
        (~no_inventory).alias("has_inventory"), (~no_manifest).alias("has_manifest"),
        (~(no_manifest | F.col("__pages"))).alias("has_page_documents"),
        F.when(no_inventory, "FAILED").otherwise("SUCCEEDED").alias("SITE_DISCOVERY"),
        F.when(no_inventory, None).when(F.col("__manifest"), "FAILED").otherwise("SUCCEEDED").alias("SAMPLING_PLAN"),
        F.when(no_inventory | F.col("__manifest"), None)
        .when(F.col("__admission") | F.col("__pages"), "FAILED").otherwise("SUCCEEDED").alias("PAGE_ACQUISITION"),
    )


def site_stages(runs: DataFrame) -> DataFrame:
    """The stages each run executed; a stage that never ran has no row."""
    return runs.unpivot(
        ["run_id"], ["SITE_DISCOVERY", "SAMPLING_PLAN", "PAGE_ACQUISITION"], "stage_id", "status"
    ).where("status is not null")
