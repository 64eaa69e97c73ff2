"""Rules over inventories, manifests and page documents, held as long tables with positions.

Rows carry ``run_id`` and ``pos``, the zero-based place in their document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagecensus.functions import fixed_values as V
from pagecensus.functions.columns import is_code
from pagecensus.operators.quality import all_violations, at, repeats, rows_where
from pagecensus.operators.ranking import with_position
from pagecensus.session import shuffled


def _fixed(pointer: str):
    return F.lit(pointer)


def inventory_semantics(sources: DataFrame, candidates: DataFrame) -> DataFrame:
    """Each source and each identity once per inventory."""
    return all_violations(
        repeats(sources, "sources", "source_id", "unique_source_id"),
        repeats(candidates, "candidates", "url_key", "unique_candidate_url_key"),
    )


def manifest_semantics(selections: DataFrame, exclusions: DataFrame) -> DataFrame:
    """Each page, rank and exclusion reason once per manifest; ranks exactly 1..n."""
    return all_violations(
        repeats(selections, "selections", "url_key", "unique_selected_url_key"),
        repeats(selections, "selections", "selection_rank", "unique_selection_rank"),
        _sparse_ranks(selections),
        repeats(exclusions, "exclusions", "reason", "unique_exclusion_reason"),
    )


def _sparse_ranks(selections: DataFrame) -> DataFrame:
    """Density is only judged where every rank is a whole number."""
    rank = F.col("selection_rank")
    ranks = selections.groupBy("run_id").agg(
        F.count("*").alias("n"), F.count(rank).alias("whole"), F.min(rank).alias("low"),
        F.max(rank).alias("high"), F.countDistinct(rank).alias("distinct"),
    )
    dense = (F.col("low") == 1) & (F.col("high") == F.col("n")) & (F.col("distinct") == F.col("n"))
    return rows_where(
        ranks, (F.col("whole") == F.col("n")) & ~dense, _fixed("/selections"), "dense_selection_rank"
    )


def inventory_producer(
    inventories: DataFrame, sources: DataFrame, candidates: DataFrame, provenance: DataFrame
) -> DataFrame:
    """What a producer may emit: an eligible seed, declared and admitting sources, right counts.

    ``provenance`` has one row per candidate occurrence and source name.
    """
    origins = inventories.select("run_id", "target_origin")
    seeds = candidates.join(
        origins,
        (candidates["run_id"] == origins["run_id"]) & (candidates["url_key"] == origins["target_origin"]),
        "left_semi",
    )
    first_seed = seeds.groupBy("run_id").agg(
        F.min(F.struct("pos", "eligibility_state")).alias("seed")
    ).select("run_id", "seed.pos", "seed.eligibility_state")
    named = provenance.where(F.col("source_id") == V.SEED_SOURCE).select("run_id", "pos").distinct()
    seeded = first_seed.join(named, ["run_id", "pos"], "left_semi")
    absent = inventories.join(seeded, "run_id", "left_anti")
    contributed = provenance.groupBy("run_id", "source_id").agg(F.count("*").alias("n"))
    # A source listed twice counts under its last entry.
    last = sources.groupBy("run_id", "source_id").agg(
        F.max_by(F.struct("pos", "outcome"), "pos").alias("s")
    ).select("run_id", "source_id", "s.pos", "s.outcome")
    undeclared = contributed.join(last, ["run_id", "source_id"], "left_anti")
    admitted = contributed.join(last, ["run_id", "source_id"])
    stated = sources.where("source_id is not null").join(contributed, ["run_id", "source_id"], "left")
    badly_named = contributed.where(~is_code(F.col("source_id"))).select("run_id").distinct()
    yes = F.lit(True)
    return all_violations(
        rows_where(absent, yes, _fixed("/candidates"), "seed_candidate_present"),
        rows_where(
            seeded, ~F.col("eligibility_state").eqNullSafe("ELIGIBLE"), _fixed("/candidates"),
            "seed_candidate_eligible",
        ),
        rows_where(undeclared, yes, _fixed("/candidates"), "source_declared_for_every_provenance"),
        rows_where(
            admitted, ~F.coalesce(F.col("outcome").isin(V.ADMITTING_OUTCOMES), F.lit(False)),
            at("sources"), "admitting_outcome_for_contributed_source",
        ),
        rows_where(sources, ~is_code(F.col("source_id")), at("sources"), "source_id_is_a_code"),
        rows_where(badly_named, yes, _fixed("/candidates"), "source_id_is_a_code"),
        rows_where(
            stated, ~F.col("candidate_count").eqNullSafe(F.coalesce("n", F.lit(0))), at("sources"),
            "candidate_count_matches_provenance",
        ),
    )


def manifest_producer(
    manifests: DataFrame, selections: DataFrame, exclusions: DataFrame, candidates: DataFrame
) -> DataFrame:
    """What a manifest may say about its inventory."""
    keys = candidates.groupBy("run_id", "url_key").agg(
        F.max(F.coalesce(F.col("eligibility_state") == "ELIGIBLE", F.lit(False))).alias("eligible")
    )
    placed = selections.join(keys, ["run_id", "url_key"], "left")
    counts = (
        manifests.select("run_id")
        .join(keys.groupBy("run_id").agg(F.count("*").alias("total")), "run_id", "left")
        .join(selections.groupBy("run_id").agg(F.count("*").alias("selected")), "run_id", "left")
        .join(exclusions.groupBy("run_id").agg(F.sum("candidate_count").alias("excluded")), "run_id", "left")
    )
    zero = F.lit(0)
    accounted = F.coalesce("selected", zero) + F.coalesce("excluded", zero)
    complete, cause = F.col("selection_complete"), F.col("incompleteness_cause")
    return all_violations(
        rows_where(manifests, ~F.col("mode").eqNullSafe("CENSUS"), _fixed("/mode"), "census_never_emits_a_sample"),
        rows_where(placed, F.col("eligible").isNull(), at("selections"), "selection_is_an_inventory_candidate"),
        rows_where(placed, ~F.col("eligible"), at("selections"), "selection_is_eligible_in_inventory"),
        rows_where(
            selections, F.coalesce("stratum", F.lit("")) == "", at("selections"),
            "every_selection_carries_a_stratum",
        ),
        rows_where(
            counts, accounted != F.coalesce("total", zero), _fixed("/exclusions"),
            "exclusions_account_for_the_remainder",
        ),
        rows_where(
            manifests, (~complete & cause.isNull()) | (complete & cause.isNotNull()),
            _fixed("/incompleteness"), "incompleteness_matches_completeness",
        ),
        rows_where(
            manifests, (cause == "SELECTION_BUDGET_EXHAUSTED") & F.col("max_selected_pages").isNull(),
            _fixed("/budgets"), "budget_cause_declares_its_budget",
        ),
    )


def admission(
    manifests: DataFrame, inventories: DataFrame, selections: DataFrame, reproduced: DataFrame
) -> DataFrame:
    """Whether a manifest may be acquired at all.

    ``manifests`` and ``inventories`` carry ``executing_run``, the run they are handed to;
    ``reproduced`` the three digests recomputed from their content.
    """
    pair = manifests.join(
        inventories.select(
            "run_id", F.col("executing_run").alias("__inventory_run"), "inventory_id",
            F.col("output_digest").alias("__inventory_digest"),
        ),
        "run_id", "left",
    ).join(reproduced, "run_id", "left")
    usable = selections.groupBy("run_id").agg(
        F.count("*").alias("n"), F.count("selection_rank").alias("ranked")
    ).where("n = ranked").select("run_id")
    bound = F.col("inventory_ref").eqNullSafe(F.col("inventory_id")) & F.col(
        "inventory_output_digest"
    ).eqNullSafe(F.col("__inventory_digest"))
    own = F.col("executing_run").eqNullSafe(F.col("run_id")) & F.col("__inventory_run").eqNullSafe(F.col("run_id"))
    same = F.col("input_digest").eqNullSafe(F.col("manifest_input")) & F.col(
        "output_digest"
    ).eqNullSafe(F.col("manifest_output"))
    return all_violations(
        rows_where(pair, ~own, _fixed("/run_id"), "manifest_binds_run"),
        rows_where(pair, ~bound, _fixed("/inventory_ref"), "manifest_binds_inventory"),
        rows_where(
            pair, ~F.col("__inventory_digest").eqNullSafe(F.col("inventory_output")),
            _fixed("/inventory_output_digest"), "inventory_digest_reproduces",
        ),
        rows_where(pair, ~same, _fixed("/output_digest"), "manifest_digests_reproduce"),
        rows_where(
            manifests.join(usable, "run_id", "left_anti"), F.lit(True), _fixed("/selections"),
            "selection_present",
        ),
    )


def _references(df: DataFrame) -> DataFrame:
    return df.select("run_id", "pos", F.posexplode("measurement_refs").alias("ref_no", "measurement_id"))


def _owners(records: DataFrame) -> DataFrame:
    """The record that names a measurement first, in record order."""
    return _references(records).groupBy("run_id", "measurement_id").agg(
        F.min(F.struct("pos", "ref_no")).alias("first"), F.count("*").alias("named")
    )


def acquisition(
    records: DataFrame, manifests: DataFrame, selections: DataFrame, measurements: DataFrame,
    evidence: DataFrame,
) -> DataFrame:
    """What the emitted set of page documents must satisfy as a whole."""
    known = measurements.select("run_id", "measurement_id").distinct()
    refs = _references(records)
    owners = _owners(records).join(shuffled(known), ["run_id", "measurement_id"], "left_semi")
    dangling = refs.join(shuffled(known), ["run_id", "measurement_id"], "left_anti").select("run_id", "pos").distinct()
    shared = owners.where("named > 1").select(
        "run_id", "measurement_id", F.col("first.pos").alias("__pos"), F.col("first.ref_no").alias("__no")
    )
    again = refs.join(shuffled(shared), ["run_id", "measurement_id"]).where(
        (F.col("pos") != F.col("__pos")) | (F.col("ref_no") != F.col("__no"))
    )
    bound = records.join(
        manifests.select(
            "run_id", F.col("sampling_manifest_id").alias("__id"), F.col("output_digest").alias("__digest")
        ),
        "run_id", "left",
    )
    declared = (
        F.col("observation_mode").eqNullSafe(V.OBSERVATION_MODE)
        & F.col("acquisition_method").eqNullSafe(V.ACQUISITION_METHOD)
        & F.col("acquisition_method_version").eqNullSafe(V.ACQUISITION_METHOD_VERSION)
    )
    unowned = measurements.join(shuffled(owners), ["run_id", "measurement_id"], "left_anti")
    pages = _references(evidence).join(
        shuffled(owners.select("run_id", "measurement_id", F.col("first.pos").alias("owner"))),
        ["run_id", "measurement_id"], "left",
    ).groupBy("run_id", "pos").agg(
        F.countDistinct("owner").alias("owners"), F.max(F.col("owner").isNull()).alias("missing")
    )
    yes = F.lit(True)
    return all_violations(
        _out_of_order(records, selections),
        rows_where(
            bound,
            ~(F.col("sampling_manifest_ref").eqNullSafe(F.col("__id"))
              & F.col("sampling_manifest_output_digest").eqNullSafe(F.col("__digest"))),
            at("page_acquisitions"), "record_binds_manifest",
        ),
        rows_where(records, ~declared, at("page_acquisitions"), "record_declares_this_producer"),
        repeats(records, "page_acquisitions", "acquisition_id", "unique_acquisition_id"),
        rows_where(records, F.col("raw_artifact_ref").isNotNull(), at("page_acquisitions"), "raw_artifact_ref_absent"),
        rows_where(
            records,
            (F.size("measurement_refs") == 0) != F.col("measurements_withheld_reason").isNotNull(),
            at("page_acquisitions"), "refs_empty_iff_withheld",
        ),
        rows_where(again, yes, at("page_acquisitions"), "measurement_owned_once"),
        rows_where(dangling, yes, at("page_acquisitions"), "refs_name_a_measurement"),
        rows_where(unowned, yes, at("measurements"), "every_measurement_is_owned"),
        rows_where(evidence, F.col("polarity").isNotNull(), at("website_evidence"), "no_polarity_on_page_evidence"),
        rows_where(
            pages, (F.col("owners") != 1) | F.col("missing"), at("website_evidence"), "evidence_within_one_page"
        ),
    )


def _out_of_order(records: DataFrame, selections: DataFrame) -> DataFrame:
    """Runs whose records are not exactly the selected pages in rank order.

    Both sides are numbered and compared place by place, so neither is collected.
    """
    usable = selections.groupBy("run_id").agg(
        F.count("*").alias("n"), F.count("selection_rank").alias("ranked")
    ).where("n = ranked").select("run_id")
    expected = with_position(
        selections.join(usable, "run_id", "left_semi").select("run_id", "url_key", "selection_rank", "pos"),
        ["run_id"], [F.col("selection_rank"), F.col("pos")], "place",
    ).select("run_id", "place", F.col("url_key").alias("expected"))
    observed = records.join(usable, "run_id", "left_semi").select(
        "run_id", (F.col("pos") + 1).cast("bigint").alias("place"), F.col("url_key").alias("observed")
    )
    differing = expected.join(observed, ["run_id", "place"], "full").where(
        ~F.col("expected").eqNullSafe(F.col("observed"))
    )
    return differing.select("run_id").distinct().select(
        "run_id", F.lit("/page_acquisitions").alias("pointer"), F.lit("one_record_per_selection").alias("rule")
    )


def linkage(
    records: DataFrame, manifests: DataFrame, selections: DataFrame, measurements: DataFrame,
    evidence: DataFrame,
) -> DataFrame:
    """Whether the documents of a bundle fit together, beyond what a producer checks itself."""
    facts = measurements.groupBy("run_id", "measurement_id").agg(
        F.min_by(F.struct("metric_id", "source_url", "observed_at"), "pos").alias("m")
    ).select("run_id", "measurement_id", "m.*")
    owned = (
        _owners(records)
        .select("run_id", "measurement_id", F.col("first.pos").alias("pos"))
        .join(shuffled(facts), ["run_id", "measurement_id"])
        .join(shuffled(records.select("run_id", "pos", "url_key", "acquired_at", "acquisition_outcome")), ["run_id", "pos"])
    )
    twice = owned.groupBy("run_id", "pos", "metric_id").agg(F.count("*").alias("n")).where("n > 1")
    foreign = owned.where(F.col("source_url") != F.col("url_key")).groupBy(
        "run_id", "pos", "acquisition_outcome"
    ).agg(F.countDistinct("source_url").alias("n"))
    allowed = F.when(F.col("acquisition_outcome") == "RESPONSE_RECEIVED", 1).otherwise(0)
    context = _references(evidence).join(shuffled(facts), ["run_id", "measurement_id"]).join(
        shuffled(evidence.select("run_id", "pos", F.col("source_url").alias("__url"), F.col("observed_at").alias("__at"))),
        ["run_id", "pos"],
    )
    selected = selections.groupBy("run_id").agg(F.count("*").alias("n")).join(manifests, "run_id")
    yes = F.lit(True)
    return all_violations(
        repeats(measurements, "measurements", "measurement_id", "unique_measurement_id"),
        repeats(evidence, "website_evidence", "evidence_id", "unique_evidence_id"),
        rows_where(
            owned, F.col("observed_at") != F.col("acquired_at"), at("page_acquisitions"),
            "measured_at_acquisition_instant",
        ),
        rows_where(twice, yes, at("page_acquisitions"), "metric_measured_once"),
        rows_where(foreign, F.col("n") > allowed, at("page_acquisitions"), "one_response_url"),
        rows_where(
            context, (F.col("source_url") != F.col("__url")) | (F.col("observed_at") != F.col("__at")),
            at("website_evidence"), "evidence_context_matches",
        ),
        rows_where(
            selected, F.col("n") > F.col("max_selected_pages"), _fixed("/selections"),
            "selections_within_budget",
        ),
    )


def foreign_documents(documents: DataFrame, collection: str) -> DataFrame:
    """Documents that state another run than the bundle they lie in (``bundle_run``)."""
    return documents.where(~F.col("run_id").eqNullSafe(F.col("bundle_run"))).select(
        F.col("bundle_run").alias("run_id"), at(collection).alias("pointer"), F.lit("belongs_to_run").alias("rule")
    )
