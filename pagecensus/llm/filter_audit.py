"""How filters of a corpus interact: what each removes in every order of applying them.

A document's mask says which filters it fails; an order is a permutation of the filters.  With M
the masks (0 where a filter is failed, infinite elsewhere) and P the places of the filters in each
order (the inverse permutations), the min-plus product M (x) P, the minimum of M + P over the
filters, is the step at which a document goes.  Documents are counted per part and mask, so the product is
taken over the 2^k masks only; its steps scatter the weights of the counts into the report.
"""

from __future__ import annotations

import itertools

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagecensus.functions.columns import settled
from pagecensus.llm.common import BLANK, whole

#: Filters of the audited set, by letter; a mask has bit i for the i-th.
FILTERS = "ABCDE"


def _words(text: Column) -> Column:
    """Maximal runs of non-blanks; an empty array for none."""
    bare = F.regexp_replace(text, f"^[{BLANK}]+|[{BLANK}]+\\z", "")
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, f"[{BLANK}]+"))


def _own_failures(text: Column, words: Column) -> Column:
    """The bits of the four filters that a text fails by itself.

    A: under 100 words.  B: fewer than 80 of 100 words are distinct.  C: more than a tenth of the code
    points are A-Z.  D: it holds one of # $ % & * |.
    """
    n = F.size(words)
    fails = [
        n < 100,
        F.size(F.array_distinct(words)) * F.lit(100) < n * F.lit(80),
        F.length(F.regexp_replace(text, "[^A-Z]+", "")) * F.lit(100) > F.length(text) * F.lit(10),
        text.rlike(r"[#$%&*|]"),
    ]
    return sum((F.when(f, 1 << i).otherwise(0) for i, f in enumerate(fails[1:], 1)), F.when(fails[0], 1).otherwise(0))


def fates(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """(part, mask, good, toxic, n): documents by the filters they fail and by what labels say.

    The fifth filter fails a document whose text another document of a smaller identifier has,
    anywhere in the table, removed or not; texts are compared by their SHA-256.  A document without
    an identifier has no smaller ones and is no smaller one.  Null texts are empty, null parts the
    empty string.  Repeated rows count as often as they occur and are no copies of each other.
    Several labels of one identifier add up: it is good or toxic if one of them says so.

    Only digests, identifiers and masks are shuffled.  Rows of one text are counted in the map tasks,
    so a text with a third of all rows costs a few rows per task.
    """
    text = whole(f"`{text_col}`")
    read = settled(docs.select(
        F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{part_col}`"), F.lit("")).alias("part"),
        text.alias("text"), _words(text).alias("words"),
    ), ["words"])
    rows = settled(read.select(
        "id", "part", F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("digest"), _own_failures(F.col("text"), F.col("words")).alias("mask")
    ), ["digest", "mask"])
    # Rows without an identifier meet no label; they are dealt by their digest.
    known = rows.withColumns({
        "named": F.col("id").isNotNull(), "key": F.coalesce("id", F.xxhash64("digest")),
    }).groupBy("named", "key", "digest", "mask", "part").agg(F.count("*").alias("n"))
    said = labels.where(F.col(f"`{id_col}`").isNotNull()).groupBy(F.col(f"`{id_col}`").alias("key")).agg(
        F.coalesce(F.bool_or(F.col("quality") == 1), F.lit(False)).alias("good"),
        F.coalesce(F.bool_or(F.col("toxic") == 1), F.lit(False)).alias("toxic"),
    ).withColumn("named", F.lit(True))
    marked = known.join(said, ["named", "key"], "left").select(
        "digest", "mask", "part", F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic"),
        "n", F.when(F.col("named"), F.struct("key", "n")).alias("least"),
    )
    # Rows of one smallest identifier may differ in part: the struct's own count is of one part only.
    groups = marked.groupBy("digest", "mask", "part", "good", "toxic").agg(
        F.sum("n").alias("n"), F.sum(F.when(F.col("least").isNull(), F.col("n"))).alias("nameless"), F.min("least").alias("least"),
    )
    first = F.min("least.key").over(Window.partitionBy("digest"))
    original = F.coalesce("nameless", F.lit(0)) + F.when(F.col("least.key") == F.col("first"), F.col("least.n")).otherwise(0)
    split = groups.withColumn("first", first).select(
        "part", "good", "toxic", F.explode(F.array(
            F.struct(F.col("mask").alias("mask"), original.alias("n")),
            F.struct(F.col("mask").bitwiseOR(F.lit(16)).alias("mask"), (F.col("n") - original).alias("n")),
        )).alias("of")
    ).select("part", "of.mask", "good", "toxic", "of.n").where("n > 0")
    return split.groupBy("part", "mask", "good", "toxic").agg(F.sum("n").alias("n"))


def removal_steps(filters: int) -> tuple[list[tuple[int, ...]], np.ndarray]:
    """All orders, and the step at which a mask goes in each; filters + 1 for the mask of no failure.

    Entry [mask, order] is the minimum over the filters of the mask's entry (0 or infinite) plus the
    filter's place in the order.
    """
    orders = list(itertools.permutations(range(filters)))
    places = np.argsort(np.array(orders), axis=1).T + 1
    held = (np.arange(1 << filters)[:, None] >> np.arange(filters)) & 1 == 1
    masks = np.where(held, 0.0, np.inf)
    least = np.min(masks[:, :, None] + places[None], axis=1)
    return orders, np.where(np.isinf(least), filters + 1, least).astype("int32")


def _steps_table(spark: SparkSession, names: str) -> DataFrame:
    """(mask, filter_order, step, filter, removed_at) for all masks, orders and steps: 2^k k! k rows."""
    orders, steps = removal_steps(len(names))
    rows = [
        (mask, "".join(names[f] for f in order), [int(f) for f in order], int(steps[mask, at]))
        for at, order in enumerate(orders) for mask in range(1 << len(names))
    ]
    table = spark.createDataFrame(rows, "mask int, filter_order string, filters array<int>, removed_at int")
    return table.select("mask", "filter_order", "removed_at", F.posexplode("filters").alias("step", "filter")).withColumn(
        "step", F.col("step") + 1
    )


def audit(counts: DataFrame, names: str = FILTERS) -> DataFrame:
    """The report on documents counted by (part, mask, good, toxic): a row per part, order and step.

    kept: documents left after the step; removed: that go at it; redundant: that fail its filter and
    went before; unique_fails: that fail its filter alone; good_lost, toxic_lost: of the removed;
    shapley: removed by its filter, over all orders, at whatever step.  A part's rows with nothing to
    count hold zeros; no documents give no rows.
    """
    spark = counts.sparkSession
    # 2^5 masks in 120 orders of 5 steps: 19,200 rows for five filters, whatever the corpus.
    at = counts.join(F.broadcast(_steps_table(spark, names)), "mask")
    bit = F.expr("shiftleft(1, filter)")
    fails = F.col("mask").bitwiseAND(bit) != 0
    here = F.col("removed_at") == F.col("step")

    def weight(condition: Column) -> Column:
        return F.sum(F.when(condition, F.col("n")).otherwise(0))

    report = at.groupBy("part", "filter_order", "step", "filter").agg(
        weight(F.col("removed_at") > F.col("step")).alias("kept"),
        weight(here).alias("removed"),
        weight(fails & (F.col("removed_at") < F.col("step"))).alias("redundant"),
        weight(F.col("mask") == bit).alias("unique_fails"),
        weight(here & F.col("good")).alias("good_lost"),
        weight(here & F.col("toxic")).alias("toxic_lost"),
    )
    shares = F.sum("removed").over(Window.partitionBy("part", "filter"))
    return report.withColumn("shapley", shares).drop("filter")
