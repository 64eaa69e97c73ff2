"""The census: which eligible candidates a run sets out to acquire, in which order, and what is left."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagecensus.functions import fixed_values as V
from pagecensus.operators.ranking import with_position


def checked_budget(budget: int | None) -> int | None:
    """A budget is absent or a whole number of at least one."""
    if budget is not None and (isinstance(budget, bool) or not isinstance(budget, int) or budget < 1):
        raise ValueError("the selection budget must be a whole number of at least 1")
    return budget


def selections(candidates: DataFrame, budget: int | None = None) -> DataFrame:
    """Seed first, then ascending key, up to the budget.

    With a budget the rank filter becomes a group limit ahead of the shuffle, so no site sends more
    than ``budget`` rows per task.  Without one, positions are computed over ranges.  A run whose
    inventory offers no eligible seed plans nothing.
    """
    checked_budget(budget)
    eligible = candidates.where("eligibility_state = 'ELIGIBLE'").withColumn(
        "__after_seed", F.col("url_key") != F.col("site")
    )
    rank, after_seed = F.col("selection_rank"), F.col("__after_seed")
    if budget is None:
        ranked = with_position(eligible, ["run_id"], [after_seed, F.col("url_key")], "selection_rank")
        headless = ranked.where((rank == 1) & after_seed).select("run_id")
        ranked = ranked.join(headless, "run_id", "left_anti")
    else:
        whole = Window.partitionBy("run_id")
        order = whole.orderBy("__after_seed", "url_key")
        ranked = eligible.withColumn("selection_rank", F.row_number().over(order)).where(rank <= budget)
        # The seed sorts first, so a run without one shows within the few rows that are left.
        ranked = ranked.withColumn("__headless", F.min(after_seed).over(whole)).where("not __headless")
    return ranked.select(
        "run_id", "site", "url_key", rank.cast("bigint").alias("selection_rank"),
        F.when(after_seed, "CENSUS").otherwise("SEED").alias("selection_reason"),
        F.coalesce("page_type", F.lit(V.UNCLASSIFIED)).alias("stratum"),
    )


def plan_summary(candidates: DataFrame, budget: int | None = None) -> DataFrame:
    """One row per run: counts, completeness and, when cut, the cause."""
    checked_budget(budget)
    eligible = F.count_if(F.col("eligibility_state") == "ELIGIBLE")
    ceiling = F.lit(budget).cast("bigint")
    grouped = candidates.groupBy("run_id", "site").agg(
        F.count("*").alias("candidate_count"),
        eligible.alias("eligible_count"),
        F.max(
            (F.col("url_key") == F.col("site")) & (F.col("eligibility_state") == "ELIGIBLE")
        ).alias("__seed"),
    ).where("__seed").drop("__seed")
    selected = F.least(F.col("eligible_count"), F.coalesce(ceiling, F.col("eligible_count")))
    return grouped.withColumn("selected_count", selected).select(
        "run_id", "site", "candidate_count", "selected_count",
        (F.col("candidate_count") - F.col("eligible_count")).alias("ineligible_count"),
        (F.col("eligible_count") - F.col("selected_count")).alias("left_by_budget"),
        (F.col("eligible_count") == F.col("selected_count")).alias("selection_complete"),
        F.when(F.col("eligible_count") > F.col("selected_count"), "SELECTION_BUDGET_EXHAUSTED")
        .alias("incompleteness_cause"),
        ceiling.alias("max_selected_pages"),
    )


def exclusions(summary: DataFrame) -> DataFrame:
    """Per run and reason, how many candidates were not taken; a zero is omitted."""
    reasons = F.array(
        F.struct(F.lit("INELIGIBLE_IN_INVENTORY").alias("reason"),
                 F.col("ineligible_count").alias("candidate_count")),
        F.struct(F.lit("SELECTION_BUDGET_EXHAUSTED").alias("reason"),
                 F.col("left_by_budget").alias("candidate_count")),
    )
    return summary.select("run_id", F.explode(reasons).alias("e")).select(
        "run_id", "e.reason", "e.candidate_count"
    ).where("candidate_count > 0")
