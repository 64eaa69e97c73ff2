"""Exact dedup by content sort, in DataFrame functions only.

Rows are range-partitioned on their normalised bytes by sampled splitters, sorted externally, and
each row is compared in full with its sorted neighbour.  The splitters see the first characters of
the normalised text and, to part texts with a common opening, its 64-bit hash: the sample that
reaches the driver stays small however long the texts are, and equal texts still sort adjacent.

A text whose copies exceed a fair partition's rows or bytes is dealt over several ranges by a hash
of the identifier.  Its group is summed before the shuffle (one row per task), so that every range
knows the whole group.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagecensus.llm.common import as_row, shuffle_parts, squeezed, whole
from pagecensus.session import materialised

OPENING = 32


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Groups rows whose texts are equal without blanks.

    Returns one row per input row: ``row`` (struct of all input columns), ``keep_id`` (identifier
    of the row that stays: most code points in the original text, then smallest identifier),
    ``group_size``, ``kept`` and ``text_sha256`` (of the normalised text).

    A null text counts as empty; all empty texts are one group.  A null identifier sorts last.
    Exactly one row of a group is kept, also where whole rows repeat.  An empty table gives an
    empty result.  Input columns may have any names.
    """
    text = whole(F.col("row").getField(text_col))
    named = docs.select(as_row(docs)).withColumn("id", F.col("row").getField(id_col))
    norm = squeezed(text)
    keyed = named.select(
        "row", "id", F.left(norm, F.lit(OPENING)).alias("opening"), F.xxhash64(norm).alias("hash"),
        F.octet_length(norm).cast("long").alias("bytes"),
    )
    by_hash = materialised(
        keyed.groupBy("hash").agg(F.count("*").alias("copies"), F.sum("bytes").alias("bytes"))
    )
    rows, size = by_hash.agg(F.sum("copies"), F.sum("bytes")).first()
    parts = shuffle_parts(docs, size or 0)
    # At most two hashes per partition can hold more than a fair share: a proven bound.
    share = F.greatest(F.col("copies") / F.lit(rows or 1), F.col("bytes") / F.lit(size or 1))
    hot = by_hash.where((F.col("copies") > 1) & (share * parts > 1)).select(
        "hash", F.least(F.ceil(share * parts), F.col("copies")).cast("long").alias("splits")
    )
    salted = keyed.drop("bytes").join(F.broadcast(hot), "hash", "left").withColumn(
        "salt",
        F.when(F.col("splits").isNotNull(), F.pmod(F.xxhash64("id", F.lit("salt")), "splits")).otherwise(0),
    )
    place = ["opening", "hash", "salt"]
    ranged = (
        salted.repartitionByRange(parts, *place)
        .withColumns({"text": text, "norm": norm})
        .withColumn("n", F.length("text"))
        .drop("text")
    )
    # The ranges already hold whole (opening, hash, salt) groups: the window only sorts them, and
    # closes a group where a row differs in full from the one before it.
    copies = Window.partitionBy(*place, "norm").orderBy(F.desc("n"), F.asc_nulls_last("id"))
    group = copies.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    local = ranged.select(
        "row", "id", "n", "hash", "splits",
        F.sha2(F.col("norm").cast("binary"), 256).alias("text_sha256"),
        F.row_number().over(copies).alias("place"),
        F.first("id").over(group).alias("first_id"), F.count("*").over(group).alias("copies"),
    )
    whole_hot = _hot_groups(keyed, hot, norm, text)
    spread = F.col("splits").isNotNull()
    keep = F.when(spread, F.col("hot_id")).otherwise(F.col("first_id"))
    return local.join(F.broadcast(whole_hot), ["hash", "text_sha256"], "left").select(
        "row",
        keep.alias("keep_id"),
        F.when(spread, F.col("hot_copies")).otherwise(F.col("copies")).alias("group_size"),
        ((F.col("place") == 1) & (~spread | (F.col("id").eqNullSafe(keep) & (F.col("n") == F.col("hot_n"))))).alias("kept"),
        "text_sha256",
    )


def _hot_groups(keyed: DataFrame, hot: DataFrame, norm, text) -> DataFrame:
    """The whole group of each hot text, summed in the map tasks; a row per hot text.

    Texts are grouped in full.  The row that stays is the minimum of (minus length, no identifier,
    identifier).
    """
    rows = keyed.join(F.broadcast(hot.select("hash")), "hash").select(
        "hash", norm.alias("norm"), F.length(text).alias("n"), "id"
    )
    first = F.min(F.struct(-F.col("n"), F.col("id").isNull(), F.col("id").alias("id"), "n"))
    return rows.groupBy("hash", "norm").agg(first.alias("first"), F.count("*").alias("hot_copies")).select(
        "hash", F.sha2(F.col("norm").cast("binary"), 256).alias("text_sha256"),
        F.col("first.id").alias("hot_id"), F.col("first.n").alias("hot_n"), "hot_copies",
    )


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that stay, with the input's columns."""
    return exact_dedup(docs, id_col, text_col).where("kept").select("row.*")
