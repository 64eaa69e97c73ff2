"""Captures -> what was read off each page: outcome, document status, head facts, verdicts.

One pass over the bodies: the parsed facts and the body digest are kept and the body is dropped in
the same stage, so no shuffle ever carries page text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagecensus import schemas
from pagecensus.functions import fixed_values as V
from pagecensus.functions.columns import digest_text, is_contract_url, media_type, settled
from pagecensus.functions.html import with_page
from pagecensus.functions.indexability import combined_verdict, header_verdict, meta_verdict
from pagecensus.functions.url import with_url_identity


def with_acquisition_outcome(captures: DataFrame, strict: bool = True) -> DataFrame:
    """A response whose final URL has no identity is an invalid redirect and carries no response.

    The homepage profile is not strict: it reports the response under the URL it came from.
    """
    keyed = with_url_identity(captures, "final_url", "final_").drop("final_url_refusal", "final_origin")
    keyed = keyed.withColumn(
        "failure_kind",
        F.coalesce(
            "failure_kind",
            F.when(F.col("final_url_key").isNull() & F.lit(strict), F.lit("INVALID_REDIRECT")),
        ),
    )
    answered = F.col("failure_kind").isNull()
    cleared = {
        name: F.when(answered, F.col(name)) for name in [*schemas.RESPONSE_COLUMNS, "final_url_key"]
    }
    return keyed.withColumns(cleared).withColumn(
        "acquisition_outcome", F.coalesce("failure_kind", F.lit("RESPONSE_RECEIVED"))
    )


def with_withheld_reason(captures: DataFrame, requested: str) -> DataFrame:
    """Why nothing is published about a page whose own URLs no document can carry."""
    unfit = ~is_contract_url(F.col(requested)) | (
        F.col("final_url").isNotNull() & ~is_contract_url(F.col("final_url"))
    )
    return captures.withColumn(
        "withheld_reason", F.when(unfit, V.WITHHELD_REASON)
    )


def _status_before_reading(homepage: bool):
    """The document status as far as it is known before the body is parsed."""
    success = F.coalesce(F.col("status_code").between(200, 299), F.lit(False))
    is_document = F.coalesce(
        media_type(F.col("content_type")).isin(V.DOCUMENT_MEDIA_TYPES), F.lit(False)
    )
    chain = F.when(F.col("withheld_reason").isNotNull(), "WITHHELD").when(
        F.col("failure_kind").isNotNull(), "NO_RESPONSE"
    )
    if not homepage:
        chain = chain.when(~success, "NON_SUCCESS_STATUS")
    return (
        chain.when(~is_document, "NOT_A_DOCUMENT")
        .when(F.coalesce("undecodable", F.lit(False)), "UNREADABLE")
        .otherwise("READ")
    )


def observe_pages(
    captures: DataFrame, requested: str = "url_key", homepage: bool = False, links: bool = False
) -> DataFrame:
    """Adds outcome, document status, ``page`` (the parsed facts), verdicts and the body digest.

    Only bodies that are documents reach the parser; every other row sends a null.
    The homepage profile also reads the document of an error response.
    """
    df = with_withheld_reason(with_acquisition_outcome(captures, not homepage), requested)
    if homepage:
        df = df.withColumn("withheld_reason", F.lit(None).cast("string"))
    df = df.withColumn("document_status", _status_before_reading(homepage))
    read = F.col("document_status") == "READ"
    df = with_page(df, F.when(read, F.col("body")), F.col("declared_charset"), F.col("final_url"), links).withColumn(
        "document_status",
        F.when(read & ~F.coalesce("page.readable", F.lit(False)), "UNREADABLE").otherwise(
            F.col("document_status")
        ),
    ).withColumn(
        "body_digest",
        F.when(~F.coalesce("undecodable", F.lit(True)), digest_text(F.col("body"))),
    )
    status = F.col("document_status")
    df = df.withColumns({
        "meta_noindex": F.when(
            status == "READ", meta_verdict(F.col("page.robots"), F.col("truncated"))
        ).when(status == "NOT_A_DOCUMENT", "NOT_APPLICABLE").when(status == "UNREADABLE", "UNASSESSED"),
        "header_noindex": F.when(
            ~status.isin("WITHHELD", "NO_RESPONSE"), header_verdict(F.col("x_robots_tag"))
        ),
    })
    if homepage:
        df = df.withColumn(
            "combined_noindex",
            F.when(
                F.col("header_noindex").isNotNull(),
                combined_verdict(F.array("meta_noindex", "header_noindex")),
            ),
        )
    derived = [c for c in df.columns if c not in captures.columns or c in schemas.RESPONSE_COLUMNS]
    return settled(
        df.drop("body"), ["failure_kind", *[c for c in derived if c != "body"]]
    )


def latest_capture(observed: DataFrame, keys: list[str]) -> DataFrame:
    """One observed capture per page: the latest attempt, ties broken by content.

    Runs after the body is gone; the row-number filter becomes a group limit before the shuffle,
    so a page captured a million times sends one row per task.
    """
    order = Window.partitionBy(*keys).orderBy(
        F.col("captured_at").desc(), F.col("acquisition_outcome"), F.col("body_digest"),
        F.col("status_code"), F.col("final_url"),
    )
    return observed.withColumn("__n", F.row_number().over(order)).where("__n = 1").drop("__n")


def page_links(captures: DataFrame) -> DataFrame:
    """Every link of every readable document, resolved, in document order, with its label."""
    read = captures.where("failure_kind is null").select(
        "run_id", "site", F.col("final_url").alias("page_url"), "body", "declared_charset"
    )
    return (
        with_page(read, F.col("body"), F.col("declared_charset"), F.col("page_url"), links=True)
        .select("run_id", "site", "page_url", F.explode("page.links").alias("link"))
        .select("run_id", "site", "page_url", "link.pos", "link.href", "link.label")
    )
