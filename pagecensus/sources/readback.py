"""Everything wrong with a bundle of page documents as it lies in its folder.

Nothing is read under the writer's schema: documents are lines of text, known by their run and
identity, and compared with the lines they were written from.  What was read is then judged by itself:
its structure, its runs, the rules of its producer, and the receipt beside it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagecensus.operators import receipts
from pagecensus.operators.quality import documents as rules
from pagecensus.operators.quality.structure import structural_violations
from pagecensus.plans.acquisition import Acquisition
from pagecensus.session import materialised, shuffled

#: Datasets of page documents: the member that tells documents apart, and the contract.
DATASETS = {
    "page_acquisitions": ("acquisition_id", "page-acquisition-record"),
    "measurements": ("measurement_id", "measurement-record"),
    "website_evidence": ("evidence_id", "website-evidence"),
    "receipt": ("acquisition_id", None),
}
_FIELDS = {
    "page_acquisitions": """run_id string, acquisition_id string, url_key string, sampling_manifest_ref string,
        sampling_manifest_output_digest string, observation_mode string, acquisition_method string, acquisition_method_version string,
        acquisition_outcome string, http_status bigint, final_url_key string, redirect_count bigint, body_truncated boolean,
        body_decoded boolean, body_digest string, measurement_refs array<string>, measurements_withheld_reason string, raw_artifact_ref string""",
    "measurements": "run_id string, measurement_id string, assessment struct<not_assessed_reason:string>",
    "website_evidence": "run_id string, evidence_id string, measurement_refs array<string>, polarity string",
}


def _receipt(records: DataFrame, selections: DataFrame, measurements: DataFrame, evidence: DataFrame) -> DataFrame:
    rows = receipts.page_receipts(records, selections, measurements, evidence)
    return rows.select(F.to_json(F.struct(*rows.columns)).alias("value"))


def page_bundle(got: Acquisition, selections: DataFrame) -> dict[str, DataFrame]:
    """The canonical lines (``value``) of every dataset of page documents, the receipt included."""
    return {
        "page_acquisitions": got.records.select(receipts.record_json().alias("value")),
        "measurements": got.measurements.select(receipts.measurement_json().alias("value")),
        "website_evidence": got.evidence.select(receipts.evidence_json().alias("value")),
        "receipt": _receipt(got.records, selections, got.measurements, got.evidence),
    }


def _member(name: str) -> Column:
    """A text member as it is written, in lines that may be broken too."""
    return F.regexp_extract("value", f'"{name}":"([^"]*)"', 1)


def _present(spark: SparkSession, folder: str) -> list[str]:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    statuses = path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(path)
    return sorted(s.getPath().getName() for s in statuses)


def _row(run: Column, dataset: str, problem: Column | str) -> list[Column]:
    return [run.alias("run_id"), F.lit(dataset).alias("document_type"), (F.lit(problem) if isinstance(problem, str) else problem).alias("problem")]


def compared(expected: DataFrame, present: DataFrame, dataset: str) -> DataFrame:
    """Documents that are missing, unexpected, repeated or changed, and the members of those changed."""
    identity = DATASETS[dataset][0]

    def known(lines: DataFrame) -> DataFrame:
        keyed = lines.select(_member("run_id").alias("run_id"), _member(identity).alias("identity"), "value")
        return keyed.groupBy("run_id", "identity").agg(
            F.count("*").alias("n"), F.sum(F.xxhash64("value").cast("decimal(38,0)")).alias("sum"), F.min("value").alias("value")
        )

    there = known(present).toDF("run_id", "identity", "m", "there_sum", "there")
    met = materialised(known(expected).join(there, ["run_id", "identity"], "full").withColumn(
        "problem",
        F.when(F.col("m").isNull(), "missing").when(F.col("n").isNull(), "unexpected").when(F.col("n") != F.col("m"), "repeated")
        .when(F.col("sum") != F.col("there_sum"), "changed"),
    ).where("problem is not null"))
    none = F.create_map().cast("map<string,string>")
    read = {c: F.coalesce(F.from_json(c, "map<string,string>"), none) for c in ("value", "there")}
    changed = met.where("problem = 'changed'").select("run_id", *[v.alias(c) for c, v in read.items()]).where("size(there) > 0")
    each = changed.select("run_id", "value", "there", F.explode(F.array_union(F.map_keys("value"), F.map_keys("there"))).alias("member"))
    was, now = F.try_element_at("value", F.col("member")), F.try_element_at("there", F.col("member"))
    what = F.when(was.isNull(), "added").when(now.isNull(), "missing").when(was != now, "changed")
    told = each.withColumn("what", what).where("what is not null")
    return met.select(*_row(F.col("run_id"), dataset, F.col("problem"))).unionByName(
        told.select(*_row(F.col("run_id"), dataset, F.concat_ws(" ", F.lit("member"), "member", "what")))
    )


def bundle_problems(
    expected: dict[str, DataFrame], manifests: DataFrame, selections: DataFrame, folder: str
) -> DataFrame:
    """(run_id, document_type, problem), each once: what differs from the lines that were written, and
    what is wrong with those that are there.

    ``manifests`` and ``selections`` are those the pages were acquired for; their runs are the
    bundle's.  A dataset nobody wrote has no run.
    """
    spark = manifests.sparkSession
    names = _present(spark, folder)
    lines = {
        name: materialised(spark.read.text(f"{folder}/{name}")) if name in names else spark.createDataFrame([], "value string")
        for name in expected
    }
    runs = manifests.select("run_id").distinct()
    found = [
        spark.createDataFrame([(None, n, "not part of this bundle") for n in names if n not in expected], "run_id string, document_type string, problem string")
    ]
    for name, present in lines.items():
        found.append(compared(expected[name], present, name))
        stated = present.select(_member("run_id").alias("run_id"), F.col("value").alias("text"))
        foreign = stated.join(runs, "run_id", "leftanti")
        found.append(foreign.select(*_row(F.col("run_id"), name, "belongs to no run of the bundle")))
        if contract := DATASETS[name][1]:
            broken = structural_violations(stated, contract)
            found.append(broken.select(*_row(F.col("run_id"), name, F.concat("pointer", F.lit(" ["), "keyword", F.lit("]")))))
    typed = {
        name: materialised(lines[name].select(F.from_json("value", fields).alias("d")).where("d.run_id is not null").select("d.*").distinct())
        for name, fields in _FIELDS.items()
    }
    ranks = selections.select("run_id", "url_key", "selection_rank")
    records = typed["page_acquisitions"].join(shuffled(ranks), ["run_id", "url_key"], "left").withColumn("pos", F.col("selection_rank") - 1)
    placed = {n: typed[n].withColumn("pos", F.monotonically_increasing_id()) for n in ("measurements", "website_evidence")}
    broken = rules.acquisition(
        records, manifests, ranks.withColumn("pos", F.col("selection_rank") - 1), placed["measurements"], placed["website_evidence"]
    )
    found.append(broken.select(*_row(F.col("run_id"), "page_documents", F.col("rule"))))
    derived = _receipt(typed["page_acquisitions"], selections, typed["measurements"], typed["website_evidence"])
    told = compared(derived, lines["receipt"], "receipt")
    found.append(told.select(*_row(F.col("run_id"), "receipt", "does not summarise the documents beside it")))
    return reduce(DataFrame.unionByName, found).distinct()
