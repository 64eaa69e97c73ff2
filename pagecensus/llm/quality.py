"""Document quality by histogram gradient-boosted trees over statistics of the whole text."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagecensus.llm import boosting
from pagecensus.llm.common import as_row, whole

#: Labelled rows that the forest is fitted on, those with the lowest hashes; all rows are scored.
MAX_TRAINING_ROWS = 20_000
FOLDS = 5

_CLASSES = {
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "lower": b"abcdefghijklmnopqrstuvwxyz", "digit": b"0123456789",
    "stop": b".,;:?", "shout": b"!", "sign": b"#$%&*+/<=>@\\^_`{|}~", "bracket": b"()[]\"'", "dash": b"-",
    "blank": b" \t", "line": b"\n\r",
}
_OF_CLASS = np.zeros(256, dtype="int64") + len(_CLASSES)
for _number, _members in enumerate(_CLASSES.values()):
    _OF_CLASS[list(_members)] = _number
_SIGNS = frozenset(_CLASSES["shout"] + _CLASSES["sign"])
STATISTICS = [
    *_CLASSES, "other", "log_bytes", "entropy", "log_words", "word_length", "longest_word", "distinct_words",
    "top_word", "repeated_word", "capital_words", "signed_words", "log_lines", "line_length", "distinct_lines", "top_line",
    "line_ends", "short_lines",
]


def statistics(text: str) -> list[float]:
    """The statistics of one text; an empty one gives zeros."""
    raw = text.encode("utf-8", "surrogatepass")
    if not raw:
        return [0.0] * len(STATISTICS)
    size = len(raw)
    by_byte = np.bincount(np.frombuffer(raw, dtype="uint8"), minlength=256)
    shares = np.bincount(_OF_CLASS, by_byte, len(_CLASSES) + 1) / size
    p = by_byte[by_byte > 0] / size
    words = raw.split()
    out = [*shares.tolist(), np.log1p(size), float(-(p * np.log2(p)).sum())]
    n = len(words)
    if n:
        counts = Counter(words)
        letters = sum(map(len, words))
        again = sum(map(bytes.__eq__, words, words[1:]))
        capital = sum(map(bytes.isupper, words))
        signed = sum(w[-1] in _SIGNS for w in counts)
        out += [
            np.log1p(n), letters / n, max(map(len, counts)), len(counts) / n, max(counts.values()) / n, again / n,
            capital / n, signed / len(counts),
        ]
    else:
        out += [0.0] * 8
    lines = [x for x in raw.split(b"\n") if x.strip()]
    m = len(lines)
    if m:
        counts = Counter(lines)
        ends = sum(x.rstrip()[-1:] in (b".", b"?", b"!", b":", b";", b",") for x in counts)
        short = sum(len(x) < 30 for x in counts)
        out += [
            np.log1p(m), size / m, len(counts) / m, max(counts.values()) / m, ends / len(counts), short / len(counts),
        ]
    else:
        out += [0.0] * 6
    return out


def remainder(identifier: str | Column, folds: int = FOLDS) -> Column:
    """crc32 of the identifier as text, by the number of folds; null for null."""
    identifier = F.col(identifier) if isinstance(identifier, str) else identifier
    return F.crc32(identifier.cast("string").cast("binary")) % folds


def labelled_sample(labels: DataFrame, id_col: str, label_col: str, most: int, seed: int = 1) -> DataFrame:
    """(id, label) of at most ``most`` labelled rows outside the held-out fold, the lowest hashes first.

    A row labelled twice with different labels has the higher one.
    """
    known = labels.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{label_col}`").cast("int").alias("label"))
    known = known.where("id is not null and label in (0, 1)").where(remainder("id") != 0)
    return known.groupBy("id").agg(F.max("label").alias("label")).orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(most)


def fitted(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
    most: int = MAX_TRAINING_ROWS,
) -> boosting.Forest:
    """The forest from labelled rows outside the held-out fold.

    Identifier and label only choose and mark the rows.  Without labelled rows, or with one label
    only, the forest is a constant.
    """
    wanted = labelled_sample(labels, id_col, label_col, most)  # at most ``most`` rows: safe to broadcast
    texts = docs.select(F.col(f"`{id_col}`").alias("id"), whole(F.col(f"`{text_col}`")).alias("text"))
    rows = texts.join(F.broadcast(wanted), "id")

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({
                "id": batch["id"], "label": batch["label"], "stats": [statistics(t) for t in batch["text"]],
            })

    seen = rows.mapInPandas(measure, f"id {docs.schema[id_col].dataType.simpleString()}, label int, stats array<double>")
    # Of an identifier's repeated rows the smallest statistics count, so that reruns agree.
    sample = seen.groupBy("id").agg(F.first("label").alias("label"), F.min("stats").alias("stats")).collect()
    sample.sort(key=lambda r: r.id)
    stats = np.array([r.stats for r in sample], dtype="float64").reshape(len(sample), len(STATISTICS))
    return boosting.fit(stats, np.array([r.label for r in sample], dtype="float64"))


def scored(docs: DataFrame, forest: boosting.Forest, text_col: str = "text") -> DataFrame:
    """``row`` (struct of all input columns) and ``score`` (0 to 1, of the whole text) per input row.

    Null counts as empty; empty texts are scored like any other.  Repeated rows have equal scores.
    An empty table gives an empty result; columns may have any names.
    """

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            stats = np.array([statistics(t) for t in texts], dtype="float64").reshape(len(texts), len(STATISTICS))
            yield pd.Series(forest.probability(stats))

    return docs.select(as_row(docs), score(whole(F.col(f"`{text_col}`"))).alias("score"))


def accepted(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, **options) -> DataFrame:
    """The rows that the classifier does not reject, with the input's columns."""
    return scored(docs, fitted(docs, labels, **options)).where(F.col("score") >= threshold).select("row.*")
