"""Near-duplicate documents by MinHash bands and odd sketches, confirmed on the full sets.

One pass over the texts gives each document its set's size and digest, 40 band keys and an odd
sketch: the 200 MinHash samples folded into 512 parity bits.  Documents with equal sets are one
class.  Classes that share a band are candidates; the population count of two sketches' XOR
estimates their similarity, and only pairs that may reach the threshold are compared in full.

A second parity bitmap folds the whole set.  Its XOR never has more bits than the sets differ in, so
where it has too many the pair cannot be linked: up to a few thousand words this refutes nearly all
that the estimate leaves, without ever refuting a link.

No group emits all its pairs.  First every class of a band is compared with the band's smallest
class, and the links found are closed to components.  Then, only where a band still holds several
components, the classes outside its largest one meet the others, in blocks, and only pairs that pass
both bitmaps leave that join.  After that, no two classes that share a band and pass the bitmaps are
left uncompared, unless they are known to be in one component.

What this can miss: a link at exactly 0.8 shares no band with probability (1 - 0.8^5)^40 = 1.2e-7,
and fails the sketch (0.2 below the threshold is more than five standard deviations) about as
rarely.  Sets hold 64-bit hashes of the shingles.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagecensus.llm.common import as_row, whole
from pagecensus.llm.components import connected
from pagecensus.session import materialised

BANDS, ROWS = 40, 5
#: 64-bit words of the sketch of the samples and of the whole set.
SKETCH_LONGS, PARITY_LONGS = 8, 32
#: Pairs whose estimated similarity lies so far under the threshold are not compared in full.
MARGIN = 0.2
#: Members of one band that a row outside its largest component meets in one task, on average.
BLOCK = 1024

_STEP = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str, width: int) -> np.ndarray:
    """Sorted distinct hashes of the text's word shingles; A-Z count as a-z.

    A text with fewer words than ``width`` has one shingle, its whole sequence; one without, none.
    """
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, dtype="uint64")
    h = _mixed(np.fromiter(map(xxhash.xxh3_64_intdigest, words), "uint64", len(words)))
    if len(h) < width:
        total = np.array([len(h)], dtype="uint64")
        for i in range(len(h)):
            total = _mixed(total * _STEP + h[i : i + 1])
        return total
    n = len(h) - width + 1
    total = h[:n].copy()
    for i in range(1, width):
        total = total * _STEP + h[i : i + n]
    return np.unique(_mixed(total))


def _parities(values: np.ndarray, longs: int) -> np.ndarray:
    """One bit per residue: whether an odd number of values has it."""
    bits = np.bincount((values % np.uint64(64 * longs)).astype("int64"), minlength=64 * longs) & 1
    return np.packbits(bits.astype("uint8")).view("int64")


def _signatures(width: int, seed: int):
    factors = _mixed(np.arange(1, BANDS * ROWS + 1, dtype="uint64") * _STEP + np.uint64(seed)) | np.uint64(1)
    places = np.arange(BANDS * ROWS, dtype="uint64") * _STEP
    bands = np.arange(1, BANDS + 1, dtype="uint64") * _STEP

    def sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sizes, digests, keys, sketches, parities = [], [], [], [], []
            for text in batch["text"]:
                s = shingle_set(text, width)
                sizes.append(len(s))
                if not len(s):
                    for column in (digests, keys, sketches, parities):
                        column.append(None)
                    continue
                digests.append(xxhash.xxh3_128_digest(s.tobytes()))
                least = np.full(BANDS * ROWS, np.iinfo("uint64").max, dtype="uint64")
                for at in range(0, len(s), 2048):
                    np.minimum(least, (s[at : at + 2048, None] * factors).min(axis=0), out=least)
                key = bands.copy()
                for i in range(ROWS):
                    key = _mixed(key * _STEP + least[i::ROWS])
                keys.append(key.view("int64"))
                sketches.append(_parities(_mixed(least + places), SKETCH_LONGS))
                parities.append(_parities(s, PARITY_LONGS))
            yield pd.DataFrame({
                "id": batch["id"], "known": batch["known"], "n": sizes, "digest": digests, "keys": keys, "sketch": sketches, "parity": parities,
            })

    return sign


def _sets(width: int):
    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({
                "id": batch["id"], "members": [shingle_set(t, width).view("int64") for t in batch["text"]],
            })

    return read


def _differing(a: str, b: str, longs: int) -> Column:
    """Population count of two bitmaps' XOR."""
    bits = [F.bit_count(F.col(a)[i].bitwiseXOR(F.col(b)[i])) for i in range(longs)]
    return sum(bits[1:], bits[0])


def _most_differing(similarity: float) -> float:
    """Expected population count of two sketches' XOR at this similarity of the sets."""
    size, changed = 64 * SKETCH_LONGS, 2 * BANDS * ROWS * (1 - similarity)
    return size * (1 - (1 - 2 / size) ** changed) / 2


def _may_link(percent: int) -> Column:
    """Whether sizes (n, m), sketches (sketch, other) and parities of two classes allow a link."""
    sizes = F.least("n", "m") * 100 >= F.greatest("n", "m") * percent
    near = _differing("sketch", "other", SKETCH_LONGS) <= _most_differing(percent / 100 - MARGIN)
    # Linked sets differ in at most (1 - t) / (1 + t) of their sizes' sum.
    apart = _differing("parity", "other_parity", PARITY_LONGS) * (100 + percent)
    return sizes & near & (apart <= (F.col("n") + F.col("m")) * (100 - percent))


def _renamed(size: DataFrame, names: str) -> DataFrame:
    return size.select("id", "n", "sketch", "parity").toDF(*names.split())


def _sets_of(texts: DataFrame, ids: DataFrame, width: int) -> DataFrame:
    """(id, members) of these identifiers, written once; the texts are shuffled at any size."""
    wanted = texts.join(ids.distinct().hint("merge"), "id", "leftsemi").dropDuplicates(["id", "text"])
    return materialised(wanted.mapInPandas(_sets(width), "id long, members array<long>"))


def _confirmed(sets: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets meet the threshold."""
    both = pairs.join(sets.toDF("a", "x"), "a").join(sets.toDF("b", "y"), "b")
    shared = F.size(F.array_intersect("x", "y"))
    return both.where(shared * 100 >= (F.size("x") + F.size("y") - shared) * percent).select("a", "b").distinct()


def near_duplicates(
    docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", seed: int = 1,
) -> DataFrame:
    """Components of documents linked by 100 * intersection >= percent * union of word shingles.

    Returns one row per input row: ``row`` (struct of all input columns), ``n_shingles``,
    ``component_id`` (smallest identifier reachable, itself included), ``kept`` (the row is its
    component's first).  Words are runs of non-blanks, A-Z as a-z.

    Null and empty texts have no shingles and are linked with nothing: each stays, as itself.
    Rows of one identifier are one document with several texts: it is linked where one of them is,
    and has the size of the largest set.  Each row with a null identifier is a document of its own,
    known in the graph by a 64-bit hash of its text.  Null counts as the largest: a component of such
    rows only has a null ``component_id``, and one of them is kept.  An empty table gives an empty
    result.  Input columns may have any names.
    """
    named = docs.select(as_row(docs), F.col(f"`{id_col}`").alias("own"), whole(text_col).alias("text"))
    named = named.withColumn("id", F.coalesce(F.col("own").cast("long"), F.xxhash64(F.lit("no id"), "text")))
    named = named.withColumn("known", F.col("own").cast("long").isNotNull())
    signed = materialised(named.select("id", "known", "text").mapInPandas(
        _signatures(width, seed), "id long, known boolean, n long, digest binary, keys array<long>, sketch array<long>, parity array<long>"
    ))
    classes = materialised(
        signed.where("n > 0").groupBy("digest").agg(
            F.min("id").alias("id"), F.first("n").alias("n"), F.first("keys").alias("keys"),
            F.first("sketch").alias("sketch"), F.first("parity").alias("parity"),
        )
    )
    size = classes.select("id", "n", "sketch", "parity")
    banded = classes.select("id", F.explode("keys").alias("key"))
    shared = materialised(
        banded.groupBy("key").agg(F.min("id").alias("hub"), F.count("*").alias("members")).where("members > 1")
    )
    members = materialised(banded.join(shared, "key"))
    pairs = members.where("id <> hub").select(F.col("id").alias("b"), F.col("hub").alias("a")).distinct()
    first = _near(pairs, size, percent)
    texts = named.select("id", "text")
    sets = _sets_of(texts, first.select(F.explode(F.array("a", "b")).alias("id")), width)
    links = materialised(_confirmed(sets, first, percent).unionByName(_own_links(signed, classes)))
    parts = connected(links)
    rest = _near_other_parts(members, size, parts, percent)
    more = rest.select(F.explode(F.array("a", "b")).alias("id")).join(sets.select("id").distinct(), "id", "leftanti")
    sets = sets.unionByName(_sets_of(texts, more, width))
    links = materialised(links.unionByName(_confirmed(sets, rest, percent)))
    parts = connected(links)
    found = classes.select("digest", "id").join(parts.toDF("id", "component"), "id", "left").select(
        "digest", F.coalesce("component", "id").alias("component")
    )
    return _answers(named, signed, found)


def _own_links(signed: DataFrame, classes: DataFrame) -> DataFrame:
    """Links (a, b) between the classes of one identifier: it is one document with several texts."""
    texts = signed.where("n > 0").select("id", "digest")
    several = texts.groupBy("id").agg(F.min("digest").alias("low"), F.max("digest").alias("high")).where("low <> high").select("id")
    nodes = texts.join(several, "id").distinct().join(classes.select("digest", F.col("id").alias("b")), "digest")
    least = nodes.groupBy("id").agg(F.min("b").alias("a"))
    return nodes.join(least, "id").where("a <> b").select("a", "b").distinct()


def representatives(docs: DataFrame, **options) -> DataFrame:
    """One document of each component, with the input's columns."""
    return near_duplicates(docs, **options).where("kept").select("row.*")


def _near(pairs: DataFrame, size: DataFrame, percent: int) -> DataFrame:
    """Candidate pairs (a, b) that sizes and sketches let through, written once."""
    both = pairs.join(_renamed(size, "a n sketch parity"), "a").join(_renamed(size, "b m other other_parity"), "b")
    return materialised(both.where(_may_link(percent)).select("a", "b"))


def _near_other_parts(members: DataFrame, size: DataFrame, parts: DataFrame, percent: int) -> DataFrame:
    """Candidate pairs (a, b) of different components that share a band, beside those with its hub.

    The classes outside a band's largest component meet its members in blocks.
    """
    placed = members.join(parts.toDF("id", "component"), "id", "left").withColumn(
        "component", F.coalesce("component", "id")
    )
    by_part = placed.groupBy("key", "component").agg(F.count("*").alias("rows"))
    mixed_keys = by_part.groupBy("key").agg(
        F.max(F.struct("rows", "component")).alias("most"), F.sum("rows").alias("all"), F.count("*").alias("parts")
    ).where("parts > 1 and all > 2").select(
        "key", F.col("most.component").alias("largest"), F.ceil(F.col("all") / BLOCK).cast("int").alias("blocks")
    )
    inside = materialised(placed.join(mixed_keys, "key").where("id <> hub").select("key", "id", "component", "largest", "blocks"))
    left = inside.where("component <> largest").join(size, "id").select(
        "key", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.col("id").alias("a"),
        F.col("component").alias("of_a"), "n", "sketch", "parity",
    )
    right = inside.join(_renamed(size, "id m other other_parity"), "id").select(
        F.col("key").alias("key_b"), F.pmod(F.hash("id"), "blocks").alias("block_b"), F.col("id").alias("b"),
        F.col("component").alias("of_b"), "largest", "m", "other", "other_parity",
    )
    apart = (F.col("of_a") != F.col("of_b")) & ((F.col("of_b") == F.col("largest")) | (F.col("a") < F.col("b")))
    met = (F.col("key") == F.col("key_b")) & (F.col("block") == F.col("block_b")) & apart & _may_link(percent)
    pairs = left.join(right, met).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    return materialised(pairs.distinct())


def _answers(named: DataFrame, signed: DataFrame, found: DataFrame) -> DataFrame:
    """The component of each row, by its smallest identifier that is not null."""
    placed = signed.join(found, "digest", "left").select(
        "id", "known", "n", "digest", F.coalesce("component", "id").alias("component")
    )
    repeated = materialised(placed.groupBy("id", "known").agg(
        F.count("*").alias("rows"), F.max("n").alias("n"), F.min("component").alias("component")
    ))
    # Only in components with null identifiers the smallest node may be none of the identifiers.
    renamed = materialised(
        repeated.groupBy("component").agg(F.min(F.when(F.col("known"), F.col("id"))).alias("least"), F.min("known").alias("all"))
        .where(~F.col("all")).select("component", F.col("least"), F.lit(True).alias("some"))
    )
    named_part = F.when(F.col("some"), F.col("least")).otherwise(F.col("component"))
    first = F.when(named_part.isNotNull(), F.col("known") & (F.col("id") == named_part)).otherwise(F.col("id") == F.col("component"))
    narrow = materialised(repeated.join(renamed, "component", "left").select(
        F.col("id").alias("__id"), F.col("known").alias("__known"), F.col("n").alias("n_shingles"),
        named_part.alias("component_id"), first.alias("kept"),
        (first & ~F.col("known") & (F.col("n") > 0) & (F.col("rows") > 1)).alias("copied"),
    ))
    met = (F.col("id") == F.col("__id")) & (F.col("known") == F.col("__known"))
    joined = named.drop("text").join(narrow, met)
    columns = ["row", "n_shingles", "component_id", "kept"]
    if narrow.where("copied").isEmpty():
        return joined.select(*columns)
    # Rows with one text and no identifier, whose component has none: the first one written is kept.
    copies = materialised(joined.where("copied").select("id", *columns).withColumn("at", F.monotonically_increasing_id()))
    firsts = copies.groupBy("id").agg(F.min("at").alias("at")).select("at", F.lit(True).alias("is_first"))
    chosen = copies.drop("kept").join(firsts, "at", "left").withColumn("kept", F.coalesce("is_first", F.lit(False)))
    return joined.where("not copied").select(*columns).unionByName(chosen.select(*columns))
