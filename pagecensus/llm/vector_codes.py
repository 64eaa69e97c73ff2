"""Product codes of vectors with integer codebooks; nearest entries by LAESA pivots.

A vector of integers is cut into consecutive parts, and each part position has a codebook.  The
distances of every part to a few fixed pivots are computed once and kept.  In each round only the
distances between pivots and entries are new: |d(part, pivot) - d(pivot, entry)| bounds the
distance of part and entry from below.  Entries are tried in the order of their bounds, in exact
integers, until the next bound exceeds the best distance found.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagecensus.llm.common import as_row
from pagecensus.session import materialised

SCALE, PARTS, ENTRIES, ROUNDS = 1024, 4, 256, 4
PIVOTS = 12
#: Vectors worked on at once, and entries tried between two looks at the bounds.
SLICE, TRIED = 2048, 8
#: Components up to this size have squared distances within 64 bits whatever the part's width (to 2^21).
EXACT = 1 << 20
#: Relative slack of the bounds against rounding; it can only let more entries through.
SLACK = 1e-9
LIMB = 40
#: Ways in which the vectors of one label are dealt when the label's total meets them.
SALTS = 64


def _wholes(vector: Column) -> Column:
    """floor(1024 x) of each component; null if a component is null or its product not finite.

    Doubles: such products and floors are exact in them, and they hold what 64 bits do not.
    """
    grown = F.transform(vector, lambda x: x.cast("double") * SCALE)
    finite = F.forall(grown, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.when(F.coalesce(finite, F.lit(False)), F.transform(grown, _floor))


def _floor(x: Column) -> Column:
    """The floor of a double as double; from 2^53 on all doubles are whole."""
    return F.when(F.abs(x) < 2.0**53, F.floor(x).cast("double")).otherwise(x)


def _cut(flat: np.ndarray, width: int) -> np.ndarray:
    """Components as [vector, part, position]: 64-bit integers, or Python's where those may overflow."""
    cut = flat.reshape(len(flat), PARTS, width)
    if not flat.size or np.abs(flat).max() <= EXACT:
        return cut.astype("int64")
    return np.frompyfunc(int, 1, 1)(cut)


def _squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact squared distances along the last axis."""
    if a.dtype == object or b.dtype == object:
        a, b = a.astype(object), b.astype(object)
    return ((a - b) ** 2).sum(-1) if a.shape[-1] else np.zeros(np.broadcast_shapes(a.shape, b.shape)[:-1], "int64")


def _apart(rows: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Distances of all rows to all others as doubles."""
    return _roots(_squares(rows[:, None], others[None]))


def _roots(squares: np.ndarray) -> np.ndarray:
    """Square roots as doubles; beyond 1e308 that value, which leaves differences no larger than they are."""
    if squares.dtype != object:
        return np.sqrt(squares.astype("float64"))
    root = np.frompyfunc(lambda n: math.sqrt(n) if n < 1 << 1000 else float(min(math.isqrt(n), 10**308)), 1, 1)
    return root(squares).astype("float64")


def chosen_pivots(entries: np.ndarray, wanted: int) -> np.ndarray:
    """Entries far from each other: each next one has the largest sum of distances to those taken."""
    taken = [0]
    total = np.zeros(len(entries))
    for _ in range(min(wanted, len(entries)) - 1):
        total = total + _apart(entries, entries[taken[-1]][None])[:, 0]
        left = total.copy()
        left[taken] = -1
        taken.append(int(left.argmax()))
    return entries[taken]


def nearest(parts: np.ndarray, to_pivots: np.ndarray, pivots: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(index, squared distance) of each part's nearest entry, ties to the lower index, and how many
    distances were evaluated."""
    between = _apart(pivots, entries)
    bound = np.zeros((len(parts), len(entries)))
    for p in range(len(pivots)):
        np.maximum(bound, np.abs(to_pivots[:, p, None] - between[p]), out=bound)
    bound -= SLACK * (to_pivots.max(1)[:, None] + between.max())
    order = np.argsort(bound, axis=1, kind="stable")
    best = np.full(len(parts), -1, parts.dtype)
    index = np.zeros(len(parts), "int64")
    live, evaluated = np.arange(len(parts)), 0
    for at in range(0, len(entries), TRIED):
        tried = order[live, at : at + TRIED]
        if at:
            reach = _roots(best[live]) * (1 + SLACK)
            open_ = bound[live, tried[:, 0]] <= reach
            live, tried = live[open_], tried[open_]
            if not len(live):
                break
        evaluated += tried.size
        found = _squares(parts[live][:, None], entries[tried])
        least = found.min(1)
        # Of the nearest among those tried, the lowest index.
        name = np.where(found == least[:, None], tried, len(entries)).min(1)
        old, known = best[live], index[live]
        better = (old < 0) | (least < old) | ((least == old) & (name < known))
        best[live], index[live] = np.where(better, least, old), np.where(better, name, known)
    return index, best, evaluated


def _matrix(column: pa.ListArray, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width) if width else np.zeros((len(column), 0))


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE):
            yield batch.slice(at, SLICE)


def _with_pivots(pivots: list[np.ndarray], width: int):
    """Adds the distances of a vector's parts to the pivots of their positions, in one array."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _batches(batches):
            cut = _cut(_matrix(batch.column("v"), PARTS * width), width)
            away = np.concatenate([_apart(cut[:, p], pivots[p]) for p in range(PARTS)], axis=1)
            offsets = np.arange(len(cut) + 1, dtype="int32") * away.shape[1]
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(away.ravel()))
            yield pa.record_batch([*batch.columns, lists], names=[*batch.schema.names, "away"])

    return each


def _assigned(batch: pa.RecordBatch, pivots, books, width: int):
    cut = _cut(_matrix(batch.column("v"), PARTS * width), width)
    away = _matrix(batch.column("away"), sum(map(len, pivots)))
    low = 0
    for p in range(PARTS):
        high = low + len(pivots[p])
        index, best, _ = nearest(cut[:, p], away[:, low:high], pivots[p], books[p])
        yield cut[:, p], index, best
        low = high


def _limbs(total: int) -> list[int]:
    """A number as digits to the base 2^40, least first; their sums over all tasks fit 64 bits."""
    sign, total, digits = (-1 if total < 0 else 1), abs(total), []
    while total or not digits:
        digits.append(sign * (total & (1 << LIMB) - 1))
        total >>= LIMB
    return digits


def _sums(pivots, books, width: int):
    """Per task and used entry: the number of parts nearest to it and the sum of each component."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = np.zeros((PARTS, ENTRIES), "int64")
        total = np.zeros((PARTS, ENTRIES, width), object)
        for batch in _batches(batches):
            for p, (cut, index, _) in enumerate(_assigned(batch, pivots, books, width)):
                count[p] += np.bincount(index, minlength=ENTRIES)
                own = np.zeros((ENTRIES, width), cut.dtype)
                np.add.at(own, index, cut)
                total[p] += own
        part, entry = np.nonzero(count)
        rows = [
            (p, e, place, int(count[p, e]), limb, digit)
            for p, e in zip(part.tolist(), entry.tolist()) for place in range(width)
            for limb, digit in enumerate(_limbs(int(total[p, e, place])))
        ]
        kinds = [pa.int32()] * 3 + [pa.int64(), pa.int32(), pa.int64()]
        columns = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)]
        yield pa.record_batch(columns, names=["part", "entry", "place", "n", "limb", "digit"])

    return each


def _codes(pivots, books, width: int):
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _batches(batches):
            found = [(index, best) for _, index, best in _assigned(batch, pivots, books, width)]
            codes = ["".join(f"{i:02x}" for i in row) for row in zip(*(index.tolist() for index, _ in found))]
            error = [str(sum(row)) for row in zip(*(best.tolist() for _, best in found))]
            yield pa.record_batch([batch.column("row"), pa.array(codes, pa.string()), pa.array(error, pa.string())], names=["row", "code", "error"])

    return each


def _trained(rows: DataFrame, pivots, books, width: int) -> list[np.ndarray]:
    """The codebooks after one round."""
    kind = "part int, entry int, place int, n long, limb int, digit long"
    found = rows.select("v", "away").mapInArrow(_sums(pivots, books, width), kind).groupBy("part", "entry", "place", "limb").agg(
        F.sum("n").alias("n"), F.sum("digit").alias("digit")
    ).collect()  # a few rows per component of the codebooks: 1,024 times a part's width
    totals: dict[tuple[int, int, int], list[int]] = {}
    for r in found:
        mean = totals.setdefault((r.part, r.entry, r.place), [0, 0])
        mean[0] += r.digit << LIMB * r.limb
        mean[1] = max(mean[1], r.n)  # every task gives the lowest digit
    fresh = [book.astype(object) for book in books]
    for (part, entry, place), (total, n) in totals.items():
        fresh[part][entry, place] = total // n
    return [_narrow(book) for book in fresh]


def _narrow(book: np.ndarray) -> np.ndarray:
    return book.astype("int64") if all(abs(int(x)) <= EXACT for x in book.ravel()) else book


def digest(books: list[np.ndarray]) -> str:
    """SHA-256 of all components by part, entry and position."""
    return hashlib.sha256(",".join(str(int(x)) for book in books for x in book.ravel()).encode()).hexdigest()


def compressed(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", pivots: int = PIVOTS,
) -> tuple[DataFrame, list[np.ndarray]]:
    """Every kept row (``row``) with its code and error, and the codebooks ([entry, position] per part).

    Components count as floor(1024 x).  Rows whose vector is null or holds null or non-finite
    components are dropped.  Codebooks start as the parts of the 256 rows of the smallest identifiers
    (nulls last; of one identifier, by vector); fewer rows give fewer entries.  Each of the four
    rounds assigns every part to the nearest entry, ties to the lower one, and moves each used entry
    to the floor of its parts' mean.  ``error`` is the sum of the final squared distances as a
    decimal, null beyond 38 digits.  Repeated rows count as often as they occur.  Vectors whose length is
    not the longest one's, rounded up to a multiple of four, count as filled up with zeros; empty
    vectors therefore too.  An empty table gives no rows and empty codebooks.
    """
    spark = vectors.sparkSession
    v = F.col(f"`{vector_col}`")
    kept = vectors.select(as_row(vectors), F.col(f"`{id_col}`").alias("id"), _wholes(v).alias("v")).where("v is not null")
    longest = kept.agg(F.max(F.size("v"))).first()[0]
    if longest is None:
        kind = T.StructType([kept.schema["row"], T.StructField("code", T.StringType()), T.StructField("error", T.DecimalType(38, 0))])
        return spark.createDataFrame([], kind), [np.zeros((0, 0), "int64")] * PARTS
    width = -(-longest // PARTS)
    fill = F.array_repeat(F.lit(0.0), F.lit(PARTS * width) - F.size("v"))
    rows = kept.withColumn("v", F.concat("v", fill))
    first = rows.select("id", "v").orderBy(F.asc_nulls_last("id"), "v").limit(ENTRIES).collect()
    start = _cut(np.array([r.v for r in first], dtype="float64"), width)
    books = [_narrow(start[:, p]) for p in range(PARTS)]
    fixed = [chosen_pivots(book, pivots) for book in books]
    kind = T.StructType([*rows.select("row", "v").schema.fields, T.StructField("away", T.ArrayType(T.DoubleType()))])
    table = materialised(rows.select("row", "v").mapInArrow(_with_pivots(fixed, width), kind))
    for _ in range(ROUNDS):
        books = _trained(table, fixed, books, width)
    kind = T.StructType([table.schema["row"], T.StructField("code", T.StringType()), T.StructField("error", T.StringType())])
    coded = table.select("row", "v", "away").mapInArrow(_codes(fixed, books, width), kind)
    return coded.withColumn("error", F.expr("try_cast(error as decimal(38,0))")), books


def label_errors(coded: DataFrame, label: Column, identifier: Column) -> DataFrame:
    """The rows with ``label_error``: the error summed over the rows of equal labels, nulls together.

    Totals are summed in the map tasks and meet the rows by label and salt (of the identifier), so that
    a label with a third of all rows is dealt over many tasks.  Beyond 38 digits a total is null.
    """
    named = coded.withColumns({"label": label, "salt": F.pmod(F.xxhash64(identifier), F.lit(SALTS)).cast("int")})
    totals = coded.groupBy(label.alias("of")).agg(F.try_sum("error").alias("label_error")).withColumn(
        "dealt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    )
    return named.join(totals, F.col("label").eqNullSafe(F.col("of")) & (F.col("salt") == F.col("dealt")), "left").drop("of", "salt", "dealt", "label")
