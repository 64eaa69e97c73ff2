"""Scans of captures and JSON documents, and the normalisation of raw captures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagecensus import schemas
from pagecensus.functions import fixed_values as V
from pagecensus.functions.columns import declared_charset, lookup, media_type, strict_json, stripped
from pagecensus.functions.content import undone_content
from pagecensus.sources.json_ranges import is_long, long_parts


def read_captures(spark: SparkSession, path: str) -> DataFrame:
    """Fetch attempts, responses and failures in one shape.  Body columns are pruned if unused."""
    return spark.read.schema(schemas.CAPTURE).parquet(path)


def read_documents(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """JSON lines -> (documents, quarantine).  Malformed text, ``NaN`` and ``Infinity`` included,
    never becomes a document and never fails the scan."""
    lines = spark.read.text(path).withColumnRenamed("value", "text")
    return split_documents(lines, "text", schema)


def split_documents(lines: DataFrame, column: str, schema: str) -> tuple[DataFrame, DataFrame]:
    options = {
        "mode": "PERMISSIVE",
        "columnNameOfCorruptRecord": "_malformed",
        "allowNonNumericNumbers": "false",
    }
    text = F.col(column)
    parsed = lines.withColumn("document", F.from_json(text, f"{schema}, _malformed string", options))
    unread = ~is_long(text) & strict_json(F.when(~is_long(text), text)).isNull()
    # Long lines are judged in parts, by their digest: equal lines have one verdict.
    digest = F.when(is_long(text), F.sha2(text, 256))
    long = long_parts(lines.select(digest.alias("name"), text.alias("text")))
    if long is None:
        malformed = unread
    else:
        bad = long.shells.where("value is null").select(F.col("name").alias("__digest")).distinct().withColumn("__bad", F.lit(True))
        parsed = parsed.withColumn("__digest", digest).join(bad, "__digest", "left").withColumn("__bad", F.col("__bad").isNotNull())
        malformed = unread | F.col("__bad")
    malformed = F.col("document").isNull() | F.col("document._malformed").isNotNull() | malformed
    documents = parsed.where(~malformed).withColumn("document", F.col("document").dropFields("_malformed"))
    return documents.drop(column, "__digest", "__bad"), parsed.where(malformed).drop("document", "__digest", "__bad")


def normalise_captures(raw: DataFrame) -> DataFrame:
    """Raw captures (header fields and wire bytes) -> captures.

    Only rows with a content encoding visit the Python worker; the rest stay in the JVM.  Bodies are
    whole; ``truncated`` is what the capture itself says, if it says anything.
    """
    token = F.lower(stripped(F.coalesce("content_encoding", F.lit(""))))
    encoded = ~token.isin("", "identity") & F.col("failure_kind").isNull()
    wire = F.when(F.col("__encoded"), F.col("wire_body"))
    decoded = raw.withColumns({"__encoded": encoded, "__token": token})
    decoded = decoded.withColumn("__decoded", undone_content(wire, F.col("__token")))
    answered = F.col("failure_kind").isNull()
    cut = F.coalesce("truncated", F.lit(False)) if "truncated" in raw.columns else F.lit(False)
    lost = F.col("__encoded") & F.col("__decoded").isNull()
    return decoded.select(
        "run_id", "site", "requested_url", "failure_kind",
        F.when(answered, F.col("final_url")).alias("final_url"),
        F.when(answered, F.col("status_code")).alias("status_code"),
        F.when(answered, F.col("content_type")).alias("content_type"),
        F.when(answered, F.col("x_robots_tag")).alias("x_robots_tag"),
        F.when(answered, F.lower(F.col("final_url")).startswith("https://")).alias("is_https"),
        F.when(answered, F.col("redirect_count")).alias("redirect_count"),
        F.when(
            answered,
            F.when(F.col("__encoded"), F.coalesce("__decoded", F.lit(b""))).otherwise(F.col("wire_body")),
        ).alias("body"),
        F.when(answered, cut).alias("truncated"),
        F.when(answered, lost).alias("undecodable"),
        F.when(answered, declared_charset(F.col("content_type"))).alias("declared_charset"),
        "captured_at",
    )


def with_header_fields(captures: DataFrame) -> DataFrame:
    """Adds the bare media type and the declared charset of the content type."""
    return captures.withColumns({
        "media_type": media_type(F.col("content_type")),
        "charset": declared_charset(F.col("content_type")),
    })


def status_source_outcome(status: Column) -> Column:
    """Why a response may not be read as a source; null when it may."""
    return F.when(status.between(200, 299), None).when(
        status.isin(V.ABSENT_STATUSES), "ABSENT"
    ).otherwise("PROVIDER_FAILURE")


def with_failure_tokens(captures: DataFrame) -> DataFrame:
    """What a fetch failure or a status means to each consumer of the capture."""
    kind = F.col("failure_kind")
    bootstrap = lookup(V.BOOTSTRAP_FAILURE, kind)
    return captures.withColumns({
        "not_assessed_reason": lookup(V.NOT_ASSESSED_REASON, kind),
        "source_outcome": F.when(
            kind.isNotNull(), lookup(V.SOURCE_OUTCOME_OF_FAILURE, kind)
        ).otherwise(status_source_outcome(F.col("status_code"))),
        "bootstrap_failure": bootstrap,
        "discovery_failure_code": lookup(V.DISCOVERY_FAILURE_CODE, bootstrap),
        "homepage_failure_code": F.when(kind == "BLOCKED_TARGET", V.TARGET_REFUSED_CODE).when(
            kind.isNotNull(), V.PAGE_FETCH_FAILED_CODE
        ),
    })


def rule_dimension(spark: SparkSession) -> DataFrame:
    """The finding rules: four rows of fixed values, always small enough to broadcast."""
    fields = [
        "rule_no", "rule_id", "finding_class", "metric_id", "finding_summary", "business_impact",
        "recommended_action", "limitation",
    ]
    rows = [tuple(rule[f] for f in fields) for rule in V.FINDING_RULES]
    schema = "rule_no int, " + ", ".join(f"{f} string" for f in fields[1:])
    return spark.createDataFrame(rows, schema)


def transition_dimension(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(V.LEGAL_TRANSITIONS, "from_state string, to_state string")
