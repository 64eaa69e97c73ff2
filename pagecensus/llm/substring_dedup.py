"""Removal of passages that occur elsewhere, exact to the word, by super-k-mers.

Every window of so many words has a minimiser: the smallest hash of the short word runs in it.
Consecutive windows with one minimiser form a super-k-mer and travel as one packed string (their
words, joined by blanks) to the minimiser's bucket, where the strings and then the windows in them
are sorted and equal neighbours counted.  Equal windows have equal minimisers, so they meet.

A minimiser that occurs in one place belongs to windows that occur once: such super-k-mers stay at
home.  Which ones repeat is found on hashes alone.  A bucket beyond ``BUCKET`` strings is cut into chunks;
what a chunk cannot settle (one copy of each window) is compared across its chunks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagecensus.llm.common import whole
from pagecensus.session import materialised

#: Words of the runs whose hashes are compared, and windows that one packed string holds at most.
RUN, PACKED = 8, 64
#: Strings of one chunk of a bucket, on average.
BUCKET = 2000
#: Bytes of text, and words of one text, worked on at once.
SLICE_BYTES, SLICE_WORDS = 1 << 20, 1 << 18
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_IS_BLANK = np.zeros(256, bool)
_IS_BLANK[[0x20, *range(9, 14)]] = True


def _mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    steps = np.full(n, base, "uint64")
    steps[:1] = 1
    return np.cumprod(steps, dtype="uint64")


_BLOCK = 1 << 16
_UP, _DOWN = _powers(_BASE, _BLOCK), _powers(_BASE_INVERSE, _BLOCK)


class Words:
    """The words of some texts: bytes with one blank behind each word, and where they stand."""

    def __init__(self, texts: list[str | None]):
        data = np.frombuffer("".join(f"{t or ''}\n" for t in texts).encode(), "uint8")
        blank = _IS_BLANK[data]
        start = np.flatnonzero(~blank & np.concatenate(([True], blank[:-1]))) if len(data) else np.zeros(0, "int64")
        behind = blank & ~np.concatenate(([True], blank[:-1])) if len(data) else blank
        sizes = np.fromiter((len((t or "").encode()) + 1 for t in texts), "int64", len(texts))
        self.text = np.searchsorted(np.cumsum(sizes), start, side="right")  # the text of each word
        keep = ~blank | behind
        self.data = np.where(blank, np.uint8(0x20), data)[keep]
        self.start = start - np.searchsorted(np.flatnonzero(~keep), start)
        self.end = np.append(self.start[1:], len(self.data)) - 1
        self.count = np.bincount(self.text, minlength=len(texts))
        self.first = np.cumsum(self.count) - self.count


def _prefix_sums(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The sum of base^i (data[i] + 1) over i below each of the ascending positions, modulo 2^64."""
    out, carry, scale = np.zeros(len(at), "uint64"), np.uint64(0), np.uint64(1)
    for low in range(0, len(data) + 1, _BLOCK):
        block = data[low : low + _BLOCK]
        sums = np.zeros(len(block) + 1, "uint64")
        np.cumsum(_UP[: len(block)] * scale * (block + np.uint64(1)), out=sums[1:])
        a, b = np.searchsorted(at, [low, low + _BLOCK])
        out[a:b] = sums[at[a:b] - low] + carry
        carry, scale = carry + sums[-1], scale * _UP[-1] * _BASE
    return out


def _run_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each run of words, which does not depend on where it stands."""
    if not len(start):
        return np.zeros(0, "uint64")
    zero, block = start[0], np.uint64(_BLOCK)
    data = data[zero : end[-1]]
    with np.errstate(over="ignore"):
        sums = _prefix_sums(data, end - zero) - _prefix_sums(data, start - zero)
        far = _powers(_DOWN[-1] * _BASE_INVERSE, len(data) // _BLOCK + 1)
        shift = (start - zero).astype("uint64")
        return _mixed(sums * _DOWN[shift % block] * far[shift // block])


def _lowest(values: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The minimum of each ``width`` neighbours and its first place, in logarithmically many passes."""
    reach, at = 1, np.arange(len(values))
    while reach < width:
        step = min(reach, width - reach)
        later = values[step:] < values[:-step]
        values, at = np.where(later, values[step:], values[:-step]), np.where(later, at[step:], at[:-step])
        reach += step
    return values, at


def _super_kmers(words: Words, window: int) -> tuple[np.ndarray, ...]:
    """(text, first window, windows, minimiser, moves) of every super-k-mer, by text and window.

    Windows are numbered by their first word, over all words of the slice.  ``moves``: the minimiser's
    first place is not the same in all windows, so the super-k-mer may hold equal windows.
    """
    none = np.zeros(0, "int64")
    found = [(none, none, none, np.zeros(0, "uint64"), np.zeros(0, bool))]
    total, run = len(words.start), min(RUN, window)
    # One long text is cut at fixed words; texts that share a slice are short.
    step = SLICE_WORDS if len(words.count) == 1 else max(total, 1)
    for low in range(0, max(0, total - window + 1), step):
        high = min(total, low + step + window - 1)
        start, end, text = words.start[low:high], words.end[low:high], words.text[low:high]
        hashes = _run_hashes(words.data, start[: len(start) - run + 1], end[run - 1 :])
        least, at = _lowest(hashes, window - run + 1)
        last = text[window - 1 :]
        whole_window = text[: len(last)] == last
        place = np.flatnonzero(whole_window)
        if not len(place):
            continue
        fresh = np.ones(len(place), bool)
        fresh[1:] = (least[place[1:]] != least[place[:-1]]) | (place[1:] != place[:-1] + 1) | (text[place[1:]] != text[place[:-1]])
        begin = np.flatnonzero(fresh)
        size = np.diff(np.append(begin, len(place)))
        pieces = -(-size // PACKED)
        of = np.repeat(np.arange(len(begin)), pieces)
        nth = np.arange(len(of)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        first, held = place[begin[of]] + nth * PACKED, np.minimum(PACKED, size[of] - nth * PACKED)
        found.append((text[first], low + first, held, least[first], at[first] != at[first + held - 1]))
    return tuple(np.concatenate(x) for x in zip(*found))


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in slices of bounded text (``size`` in bytes); a longer text is one of its own."""
    for batch in batches:
        begin, held = 0, 0
        for i, size in enumerate(batch.column("size").to_pylist()):
            if i > begin and held + size > SLICE_BYTES:
                yield batch.slice(begin, i - begin)
                begin, held = i, 0
            held += size
        if batch.num_rows:
            yield batch.slice(begin)


def _small(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The texts compressed, for the shuffles that bring them to what is found about them."""
    for batch in _slices(batches):
        blobs = [None if t is None else pa.compress(t.encode(), codec="zstd", asbytes=True) for t in batch.column("text").to_pylist()]
        at = batch.schema.get_field_index("text")
        yield batch.set_column(at, "text", pa.array(blobs, pa.binary()))


def _texts(batch: pa.RecordBatch) -> list[str | None]:
    return [
        None if b is None else pa.decompress(b, n, "zstd", asbytes=True).decode()
        for b, n in zip(batch.column("text").to_pylist(), batch.column("size").to_pylist())
    ]


def _lists(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    offsets = np.concatenate(([0], np.cumsum(counts))).astype("int32")
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, kind))


def _minimisers(window: int):
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            text, _, _, least, moves = _super_kmers(Words(batch.column("text").to_pylist()), window)
            lists = [
                _lists(least[held].view("int64"), np.bincount(text[held], minlength=batch.num_rows), pa.int64())
                for held in (slice(None), moves)
            ]
            yield pa.record_batch([batch.column("key"), *lists], names=["key", "hashes", "again"])

    return each


def _packed(window: int):
    """The wanted super-k-mers of the texts, each with its bucket, chunk and first word."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            words = Words(_texts(batch))
            text, first, size, least, _ = _super_kmers(words, window)
            counts = np.bincount(text, minlength=batch.num_rows)
            begin = np.cumsum(counts) - counts
            wanted = batch.column("wanted")
            asked = np.diff(wanted.offsets.to_numpy())
            held = wanted.flatten()
            of = np.repeat(np.arange(batch.num_rows), asked)
            at = begin[of] + held.field("nth").to_numpy()
            chunks = held.field("chunks").to_numpy()
            keys = np.array([int.from_bytes(k[:8], "little") for k in batch.column("key").to_pylist()], dtype="uint64")
            with np.errstate(over="ignore"):
                chunk = (_mixed(keys[of] + at.astype("uint64") - begin[of].astype("uint64")) % chunks.astype("uint64")).astype("int32")
            low, high = words.start[first[at]], words.end[first[at] + size[at] + window - 2]
            data = words.data.tobytes()
            # Repeated rows lie next to each other: their strings travel once, with their number.
            rows: dict[tuple, int] = {}
            places = first[at] - words.first[of]
            names = batch.column("key").to_pylist()
            for i, (t, place) in enumerate(zip(of.tolist(), places.tolist())):
                rows.setdefault((names[t], place), [i, 0])[1] += 1
            index = np.array([r[0] for r in rows.values()], dtype="int64")
            yield pa.record_batch([
                pa.array(least[at[index]].view("int64"), pa.int64()), pa.array(chunk[index], pa.int32()),
                pa.array((chunks[index] > 1)), pa.array([k for k, _ in rows], pa.binary()),
                pa.array([p for _, p in rows], pa.int32()), pa.array([r[1] for r in rows.values()], pa.int64()),
                pa.array([data[a:b].decode() for a, b in zip(low[index].tolist(), high[index].tolist())], pa.string()),
            ], names=["bucket", "chunk", "split", "key", "place", "times", "words"])

    return each


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
    """Rows of one chunk of a bucket, from batches sorted by both."""
    name, held = None, []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if row[:2] != name:
                if held:
                    yield held
                name, held = row[:2], []
            held.append(row[2:])
    if held:
        yield held


def _counted(window: int):
    """Counts the windows of each chunk by sorting.

    Gives the spans of words under repeated windows; from a chunk of a larger bucket also one copy
    of each window, to be met by those of the other chunks.
    """

    def judge(group: list[tuple]) -> Iterator[tuple]:
        split = group[0][0]
        group.sort(key=lambda r: r[4])
        texts: list[list] = []  # [words, rows, number of rows]
        for _, key, place, times, text in group:
            if not texts or texts[-1][0] != text:
                texts.append([text, [], 0])
            texts[-1][1].append((key, place))
            texts[-1][2] += times
        cut = []
        for number, (text, _, _) in enumerate(texts):
            edges = [-1, *(i for i, c in enumerate(text) if c == " "), len(text)]
            cut += [(text[edges[i] + 1 : edges[i + window]], number, i) for i in range(len(edges) - window)]
        cut.sort()
        again: list[list[int]] = [[] for _ in texts]
        begin = 0
        for i in range(1, len(cut) + 1):
            if i < len(cut) and cut[i][0] == cut[begin][0]:
                continue
            many = i - begin > 1 or texts[cut[begin][1]][2] > 1
            if many:
                for _, number, at in cut[begin:i]:
                    again[number].append(at)
            if split:
                passage, number, at = cut[begin]
                key, place = texts[number][1][0]
                yield key, place + at, place + at + window, passage, not many
            begin = i
        for (_, rows, _), places in zip(texts, again):
            for low, high in _runs(sorted(places), window):
                for key, place in dict.fromkeys(rows):
                    yield key, place + low, place + high, None, False

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = []
        for group in _groups(batches):
            for row in judge(group):
                rows.append(row)
                if len(rows) == 10_000:
                    yield _spans(rows)
                    rows = []
        if rows:
            yield _spans(rows)

    return each


def _runs(places: list[int], window: int) -> Iterator[tuple[int, int]]:
    """The spans of words that windows at ascending places cover; touching ones are one."""
    low = high = None
    for at in places:
        if high is not None and at <= high:
            high = at + window
            continue
        if high is not None:
            yield low, high
        low, high = at, at + window
    if high is not None:
        yield low, high


def _spans(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.binary(), pa.int32(), pa.int32(), pa.string(), pa.bool_()]
    names = ["key", "low", "high", "passage", "single"]
    return pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in _slices(batches):
        texts = _texts(batch)
        words = Words(texts)
        spans = batch.column("spans")
        asked = np.diff(spans.offsets.to_numpy())
        held, of = spans.flatten(), np.repeat(np.arange(batch.num_rows), asked)
        edge = np.zeros(len(words.start) + 1, "int64")
        np.add.at(edge, words.first[of] + held.field("low").to_numpy(), 1)
        np.add.at(edge, words.first[of] + held.field("high").to_numpy(), -1)
        gone = np.cumsum(edge)[:-1] > 0
        sizes = words.end - words.start + 1
        data = words.data[np.repeat(~gone, sizes)]
        removed = np.bincount(words.text[gone], minlength=batch.num_rows)
        ends = np.cumsum(np.bincount(words.text[~gone], sizes[~gone], minlength=batch.num_rows)).astype("int64")
        kept, low, blob = [], 0, data.tobytes()
        for high in ends.tolist():
            kept.append(blob[low : max(low, high - 1)].decode())
            low = high
        yield pa.record_batch([
            batch.column("rest"), pa.array(texts, pa.string()), pa.array(words.count, pa.int64()), pa.array(removed, pa.int64()),
            pa.array(kept, pa.string()),
        ], names=["rest", "text", "n_words", "n_removed", "kept_text"])


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The text (null as it is), its bytes, a key of identifier and text, and the other columns."""
    text = F.col(f"`{text_col}`")
    name = F.concat(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")), F.lit("\n"), whole(text))
    rest = [F.col(f"`{c}`") for c in docs.columns if c != text_col]
    return docs.select(
        F.struct(F.lit(1).alias("_"), *rest).alias("rest"), text.alias("text"), F.octet_length(whole(text)).alias("size"),
        F.unhex(F.md5(name.cast("binary"))).alias("key"),
    )


def _compressed(keyed: DataFrame) -> DataFrame:
    kinds = [T.StructField(f.name, T.BinaryType()) if f.name == "text" else f for f in keyed.schema]
    return keyed.mapInArrow(_small, T.StructType(kinds))


def repeated_spans(docs: DataFrame, window: int = 35, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(key, spans): the spans of words that a repeated window covers, per identifier and text."""
    spark = docs.sparkSession
    texts = _keyed(docs, id_col, text_col).select("key", "text", "size")
    marks = materialised(texts.mapInArrow(_minimisers(window), "key binary, hashes array<long>, again array<long>"))
    often = marks.select(F.explode(F.concat("hashes", "again")).alias("hash")).groupBy("hash").count().where("count > 1")
    wanted = marks.select("key", F.posexplode("hashes").alias("nth", "hash")).join(often, "hash").select(
        "key", F.struct("nth", F.ceil(F.col("count") / BUCKET).cast("int").alias("chunks")).alias("one")
    ).groupBy("key").agg(F.collect_set("one").alias("wanted"))  # at most a text's own super-k-mers
    packed = _compressed(texts).join(wanted, "key").mapInArrow(
        _packed(window), "bucket long, chunk int, split boolean, key binary, place int, times long, words string"
    )
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    met = materialised(
        packed.repartition(parts, "bucket", "chunk").sortWithinPartitions("bucket", "chunk").mapInArrow(
            _counted(window), "key binary, low int, high int, passage string, single boolean"
        )
    )
    # One copy of each window per chunk: of a passage no more rows than its bucket has chunks.
    across = met.where("passage is not null").withColumn("n", F.count("*").over(Window.partitionBy("passage")))
    spans = met.where("passage is null").select("key", "low", "high").unionByName(
        across.where("single and n > 1").select("key", "low", "high")
    )
    return spans.groupBy("key").agg(F.collect_set(F.struct("low", "high")).alias("spans"))  # a text's own spans


def without_repeats(docs: DataFrame, window: int = 35, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row (``row``) with n_words, n_removed and kept_text, its kept words joined by one blank.

    Words are maximal runs of characters other than blank, tab, line feed, vertical tab, form feed
    and carriage return.  A word goes if some ``window`` consecutive words around it also start
    anywhere else, in the same text or another one.  Null texts are empty, texts of fewer words are
    kept whole; repeated rows repeat each other's passages, so they lose every word of a window.
    Rows without an identifier are rows like others; an empty table gives no rows.
    """
    spans = repeated_spans(docs, window, id_col, text_col)
    keyed = _keyed(docs, id_col, text_col)
    kind = T.StructType([
        keyed.schema["rest"], keyed.schema["text"], T.StructField("n_words", T.LongType()),
        T.StructField("n_removed", T.LongType()), T.StructField("kept_text", T.StringType()),
    ])
    none = F.array().cast("array<struct<low:int,high:int>>")
    found = _compressed(keyed).join(spans, "key", "left").select("rest", "text", "size", F.coalesce("spans", none).alias("spans")).mapInArrow(_kept, kind)
    row = [F.col("text").alias(c) if c == text_col else F.col(f"rest.`{c}`") for c in docs.columns]
    return found.select(F.struct(*row).alias("row"), "n_words", "n_removed", "kept_text")
