"""JSON texts of any size, taken apart over ranges.

A long text is cut into ranges.  A range alone knows its quotes and, for either state at its start
(inside a string or not), by how much it changes the depth; sums over the ranges before it give each
range its true state.  Ranges are then read side by side: everything between the commas of a
container that the document itself holds becomes a row of its own, and what is left is the shell, a
short document with emptied arrays.

The text is JSON exactly if its shell and all rows are, so no value as large as the document is ever
parsed.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagecensus.functions.columns import settled, strict_json
from pagecensus.session import materialised

#: Characters up to which a text is parsed whole, and bytes of one range.
WHOLE, RANGE = 4 << 20, 1 << 20
#: Numbers that stand for the items of an emptied array, at most; bounds on items are below it.
STAND_INS = 1000
_QUOTE, _SLASH, _COMMA = ord('"'), ord("\\"), ord(",")
_STEP = np.zeros(256, "int64")
_STEP[[ord("{"), ord("[")]] = 1
_STEP[[ord("}"), ord("]")]] = -1
_MARK = _STEP != 0
_MARK[_COMMA] = True


def _edges(data: np.ndarray) -> list[int]:
    """Where ranges begin: at characters, and never behind a backslash."""
    edges, at = [0], RANGE
    while at < len(data):
        near = data[at - 1 : at + RANGE]
        fits = ((near[1:] & 0xC0) != 0x80) & (near[:-1] != _SLASH)
        if not fits.any():
            at += len(fits)
            continue
        at += int(fits.argmax())
        edges.append(at)
        at += RANGE
    return edges + [len(data)]


def _inside(data: np.ndarray) -> np.ndarray:
    """Whether each byte is inside a string if the range starts outside one; escaped quotes do not count."""
    at = np.flatnonzero(data == _QUOTE)
    slash = data == _SLASH
    if slash.any():
        last = np.maximum.accumulate(np.where(slash, -1, np.arange(len(data))))
        before = np.where(at > 0, last[np.maximum(at, 1) - 1], -1)
        at = at[(at - 1 - before) % 2 == 0]
    turns = np.zeros(len(data), "int8")
    turns[at] = 1
    return np.cumsum(turns, dtype="int64") & 1 == 1


def _texts(column: pa.Array) -> Iterator[np.ndarray]:
    for value in column:
        yield np.frombuffer(value.as_buffer() if value.is_valid else b"", "uint8")


def _ranged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for doc, name, data in zip(batch.column("doc"), batch.column("name"), _texts(batch.column("text"))):
            edges = _edges(data)
            for no, (low, high) in enumerate(zip(edges, edges[1:])):
                piece = data[low:high]
                inside, step = _inside(piece), _STEP[piece]
                state = [int(inside[-1]) if len(piece) else 0, int(step[~inside].sum()), int(step[inside].sum())]
                yield pa.record_batch(
                    [pa.array([doc.as_py()]), pa.array([name.as_py()], pa.string()), pa.array([no], pa.int32()), pa.array([piece.tobytes()], pa.binary())]
                    + [pa.array([s], pa.int64()) for s in state],
                    names=["doc", "name", "no", "piece", "odd", "outside", "inside"],
                )


def _fragments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The range between the marks that part the rows of the document's own containers."""
    for batch in batches:
        for row in range(batch.num_rows):
            doc, name, no, start, depth = (batch.column(c)[row].as_py() for c in ("doc", "name", "no", "start", "depth"))
            data = next(_texts(batch.column("piece").slice(row, 1)))
            at = np.flatnonzero(_MARK[data] & (_inside(data) == bool(start)))
            step = _STEP[data[at]]
            after = depth + np.cumsum(step)
            opens, closes = (step == 1) & (after == 2), (step == -1) & (after == 1)
            cut = opens | closes | ((step == 0) & (after == 2))
            at, opens, closes = at[cut], opens[cut], closes[cut]
            begin = np.concatenate(([0], at + ~closes))
            end = np.append(at + opens, len(data))
            count = np.concatenate(([0], np.cumsum(opens)))
            item = np.concatenate(([depth >= 2], ~closes))
            blob = data.tobytes()
            n = len(begin)
            yield pa.record_batch(
                [
                    pa.array(np.full(n, doc)), pa.array([name] * n, pa.string()), pa.array(np.full(n, no, "int32")), pa.array(np.arange(n)),
                    pa.array(count), pa.array(item), pa.array([blob[a:b].decode() for a, b in zip(begin.tolist(), end.tolist())], pa.string()),
                ],
                names=["doc", "name", "no", "seq", "opens", "item", "text"],
            )


@dataclass(frozen=True)
class Parts:
    """shells: (name, value), null where the text is no JSON.  items: (name, member, place, text, value)
    of the arrays that the documents hold themselves."""

    shells: DataFrame
    items: DataFrame


def _before(of: Column) -> Column:
    """The sum over the document's earlier ranges; a document has as many ranges as its text has MiB."""
    return F.coalesce(F.sum(of).over(Window.partitionBy("doc").orderBy("no").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))


def is_long(text: Column) -> Column:
    return F.coalesce(F.length(text) > WHOLE, F.lit(False))


def long_parts(documents: DataFrame) -> Parts | None:
    """(name, text) -> the parts of the texts above ``WHOLE`` characters; None if there are none.

    Names may repeat: each row is a document of its own.  A row that is longer than a variant can hold
    (a single array item or scalar of that size) makes its document unreadable.
    """
    numbered = documents.where(is_long(F.col("text"))).select(F.monotonically_increasing_id().alias("doc"), "name", "text")
    ranges = materialised(numbered.mapInArrow(
        _ranged, "doc long, name string, no int, piece binary, odd long, outside long, inside long"
    ))
    if ranges.isEmpty():
        return None
    known = ranges.select("doc", "no", "odd", "outside", "inside").withColumn("start", F.pmod(_before(F.col("odd")), F.lit(2)))
    known = known.withColumn("depth", _before(F.when(F.col("start") == 1, F.col("inside")).otherwise(F.col("outside"))))
    cores = documents.sparkSession.sparkContext.defaultParallelism
    placed = ranges.select("doc", "name", "no", "piece").join(known.select("doc", "no", "start", "depth"), ["doc", "no"])
    cut = materialised(placed.repartition(cores * 4, "doc", "no").mapInArrow(
        _fragments, "doc long, name string, no int, seq long, opens long, item boolean, text string"
    ))
    last = cut.groupBy("doc", "no").agg(F.max("seq").alias("last"), F.max("opens").alias("opened"))
    offsets = last.select("doc", "no", "last", _before(F.col("last")).alias("first"), _before(F.col("opened")).alias("earlier"))
    numbered = cut.join(offsets, ["doc", "no"]).select(
        "doc", "name", "no", "item", (F.col("first") + F.col("seq")).alias("number"), (F.col("earlier") + F.col("opens")).alias("opens"),
        "text", ((F.col("seq") == 0) | (F.col("seq") == F.col("last"))).alias("edge"),
    )
    # A fragment at the edge of a range may go on in the next one.
    joined = numbered.where("edge").groupBy("doc", "name", "item", "number", "opens").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("no", "text"))), lambda x: x["text"]), "").alias("text")
    )
    fragments = materialised(numbered.where("not edge").select(joined.columns).unionByName(joined))
    return _parts(fragments)


def _parts(fragments: DataFrame) -> Parts:
    shell = fragments.where("not item")
    opener = F.right("text", F.lit(1))
    key = F.regexp_extract("text", r'"([^"\\]*+(?:\\.[^"\\]*+)*+)"\s*:\s*\[\z', 1)
    named = F.coalesce(F.try_variant_get(F.try_parse_json(F.concat(F.lit('"'), key, F.lit('"'))), "$", "string"), F.lit(""))
    containers = shell.select(
        "doc", (F.col("opens") + 1).alias("opens"), F.col("number").alias("opened"), (opener == "[").alias("listed"), named.alias("member")
    )
    rows = fragments.where("item").join(containers, ["doc", "opens"]).withColumn("place", F.col("number") - F.col("opened") - 1)
    blank = F.col("place").eqNullSafe(F.lit(0)) & (F.trim(F.translate("text", "\t\r\n", "   ")) == "")
    items = rows.where("listed").select("doc", "name", "opens", "member", "place", "text", blank.alias("blank"), strict_json(F.col("text")).alias("value"))
    items = materialised(settled(items, ["value"]).withColumn("same", F.sha2(F.to_json("value"), 256)))
    # Rows of a container that is no array belong to the shell, with the commas between them.
    inner = rows.where("not listed").select("doc", "number", F.concat(F.when(F.col("place") > 0, ",").otherwise(""), F.col("text")).alias("text"))
    sizes = items.groupBy("doc", "opens", "same").agg(F.count("*").alias("n"), F.max("blank").alias("blank")).groupBy("doc", "opens").agg(
        F.sum("n").alias("n"), F.bool_or("blank").alias("blank"), F.max("n").alias("most")
    )
    # "[]" is one blank row; a blank row among others is none.
    n = F.when((F.col("n") == 1) & F.col("blank"), 0).otherwise(F.col("n"))
    numbers = F.array_join(F.sequence(F.lit(1), F.least(n, F.lit(STAND_INS))), ",")
    stand_in = F.when(n == 0, "").otherwise(F.concat(numbers, F.when(F.col("most") > 1, ",1").otherwise("")))
    filled = shell.withColumn("opens", F.col("opens") + 1).join(
        sizes.select("doc", "opens", stand_in.alias("stand_in")), ["doc", "opens"], "left"
    ).select("doc", "number", F.concat("text", F.coalesce("stand_in", F.lit(""))).alias("text"))
    broken = items.where("value is null").join(sizes.where(n == 0).select("doc", "opens"), ["doc", "opens"], "leftanti").select("doc").distinct()
    names = fragments.select("doc", "name").distinct()
    whole = filled.unionByName(inner).groupBy("doc").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("number", "text"))), lambda x: x["text"]), "").alias("text")
    )
    readable = names.join(whole, "doc").join(broken.withColumn("broken", F.lit(True)), "doc", "left")
    value = F.when(F.col("broken").isNull(), strict_json(F.col("text")))
    shells = materialised(readable.select("doc", "name", value.alias("value")))
    good = shells.where("value is not null").select("doc")
    return Parts(
        shells.select("name", "value"),
        items.where("value is not null").join(good, "doc", "leftsemi").select("name", "member", "place", "text", "value"),
    )
