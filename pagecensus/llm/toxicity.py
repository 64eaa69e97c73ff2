"""Toxicity by a classifier chain over linear models of a text's words and their openings.

The categories are predicted one after another; each model sees the words and the probabilities of
the categories before it.  In training those probabilities come from models that did not see the
row (out of fold), as they will in use.

``labels`` marks documents as toxic only.  The narrower categories are taught by declared word
families: a document labelled toxic that uses a family's words is a positive row of its category.
What marks a category in a text is then learned from the rows, over all words that tell labelled
documents apart.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagecensus.llm.common import as_row, whole
from pagecensus.llm.quality import labelled_sample, remainder
from pagecensus.session import materialised

MAX_TRAINING_ROWS = 8_000
#: Marks that the models may use: those that best tell toxic from other labelled documents.
MAX_MARKS = 2_000
LEAST_DOCUMENTS = 5
#: Word families of the narrower categories, in chain order; a parameter of the operator.
FAMILIES = {
    "insult": "idiot moron stupid clown loser dumb fool imbecile cretin dimwit",
    "degradation": "scum trash garbage vermin filth parasite subhuman pig rat",
    "contempt": "pathetic worthless disgusting useless vile repulsive contemptible",
}
_SIGNS = "".join(map(chr, (*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)))) + "«»“”„‘’…¿¡"


def marks_of(text: str) -> set[str]:
    """Distinct lower-case words without the signs around them, and their openings.

    An opening of 5 to 7 characters counts once, and again with a longer mark for two and for three
    distinct words that share it: endings vary, and one chance word says less than several.
    """
    words = {w.strip(_SIGNS) for w in text.lower().split()}
    found = set(words)
    for size in (5, 6, 7):
        for opening, n in Counter(w[:size] for w in words if len(w) >= size).items():
            found.add(f"{opening}*")
            if n > 1:
                found.add(f"{opening}**")
                if n > 2:
                    found.add(f"{opening}***")
    return found


class Linear:
    """Logistic regression over present words and some dense columns."""

    def __init__(self, words: int, dense: int):
        self.word, self.column, self.start = np.zeros(words), np.zeros(dense), 0.0

    def log_odds(self, line: np.ndarray, word: np.ndarray, dense: np.ndarray) -> np.ndarray:
        found = np.bincount(line, self.word[word], len(dense)) if len(line) else np.zeros(len(dense))
        return self.start + found + dense @ self.column

    def probability(self, line, word, dense) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.log_odds(line, word, dense), -40, 40)))

    def fit(self, line, word, dense, label, rounds: int = 300, ridge: float = 0.1) -> Linear:
        """Descent with momentum.

        Each weight's step is bounded by what its rows hold in all, which keeps the descent stable
        however the words go together.
        """
        n = max(len(label), 1)
        rate = min(max(label.mean() if len(label) else 0.5, 1e-3), 1 - 1e-3)
        self.start = float(np.log(rate / (1 - rate)))
        held = np.bincount(line, minlength=len(label)) + dense.shape[1] + 1.0
        step_w = 1 / (0.25 * np.bincount(word, held[line], len(self.word)) + ridge)
        step_c = 1 / (0.25 * dense.T @ held + ridge) if dense.shape[1] else np.zeros(0)
        step_s = 1 / (0.25 * held.sum() + 1e-9)
        drift_w, drift_c, drift_s = np.zeros_like(self.word), np.zeros_like(self.column), 0.0
        for _ in range(rounds if len(label) else 0):
            error = self.probability(line, word, dense) - label
            drift_w = 0.9 * drift_w - step_w * (np.bincount(word, error[line], len(self.word)) + ridge * self.word)
            drift_c = 0.9 * drift_c - step_c * (dense.T @ error + ridge * self.column)
            drift_s = 0.9 * drift_s - step_s * error.sum()
            self.word, self.column, self.start = self.word + drift_w, self.column + drift_c, self.start + drift_s
        return self


class Chain:
    """Linear models in order; each has the probabilities of those before it as columns."""

    def __init__(self, categories: list[str], vocabulary: dict[str, int]):
        self.categories, self.vocabulary, self.models = categories, vocabulary, []

    def fit(self, line, word, labels: np.ndarray, fold: np.ndarray) -> Chain:
        rows = len(labels)
        dense = np.zeros((rows, 0))
        for c in range(len(self.categories)):
            unseen = np.zeros(rows)
            for f in np.unique(fold):
                learn, judge = fold != f, fold == f
                model = self._one(line, word, dense, labels[:, c], learn)
                own = judge[line]
                place = np.cumsum(judge) - 1
                unseen[judge] = model.probability(place[line[own]], word[own], dense[judge])
            self.models.append(self._one(line, word, dense, labels[:, c], np.ones(rows, dtype=bool)))
            dense = np.column_stack([dense, unseen])
        return self

    def _one(self, line, word, dense, label, rows) -> Linear:
        own = rows[line]
        place = np.cumsum(rows) - 1
        model = Linear(len(self.vocabulary), dense.shape[1])
        return model.fit(place[line[own]], word[own], dense[rows], label[rows])

    def probabilities(self, texts: list[str]) -> np.ndarray:
        """(texts, categories)."""
        line, word = [], []
        for i, text in enumerate(texts):
            found = [self.vocabulary[w] for w in marks_of(text) if w in self.vocabulary]
            line += [i] * len(found)
            word += found
        line, word = np.array(line, dtype="int64"), np.array(word, dtype="int64")
        dense = np.zeros((len(texts), 0))
        for model in self.models:
            dense = np.column_stack([dense, model.probability(line, word, dense)])
        return dense


def fitted(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
    most: int = MAX_TRAINING_ROWS, families: dict[str, str] = FAMILIES,
) -> Chain:
    """The chain from at most ``most`` labelled rows outside the held-out fold (crc32 of the id).

    Of an identifier's repeated rows the words are taken together.  Without labels every
    probability is one constant.
    """
    wanted = labelled_sample(labels, id_col, label_col, most)  # at most ``most`` rows: safe to broadcast
    texts = docs.select(F.col(f"`{id_col}`").alias("id"), whole(F.col(f"`{text_col}`")).alias("text"))
    kind = docs.schema[id_col].dataType.simpleString()

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch[["id", "label", "fold"]].assign(marks=[sorted(marks_of(t)) for t in batch["text"]])

    rows = texts.join(F.broadcast(wanted), "id").withColumn("fold", remainder("id"))
    seen = rows.mapInPandas(read, f"id {kind}, label int, fold long, marks array<string>")
    # A row per identifier of the sample: of repeated ones the marks that sort first.
    seen = materialised(seen.groupBy("id", "label", "fold").agg(F.min("marks").alias("marks")))
    uses = [F.arrays_overlap("marks", F.lit(w.split())).cast("int").alias(c) for c, w in families.items()]
    sample = sorted(seen.select("id", "label", "fold", *uses).collect())
    toxic = sum(r.label for r in sample)
    clean = len(sample) - toxic
    held = seen.select("label", F.explode("marks").alias("mark")).groupBy("mark").agg(
        F.sum("label").alias("t"), F.sum(1 - F.col("label")).alias("c")
    )
    odds = F.log((F.col("t") + 0.5) / (toxic + 0.5 - F.col("t"))) - F.log((F.col("c") + 0.5) / (clean + 0.5 - F.col("c")))
    telling = F.abs(odds) / F.sqrt(1 / (F.col("t") + 0.5) + 1 / (F.col("c") + 0.5))
    best = held.where(F.col("t") + F.col("c") >= LEAST_DOCUMENTS).orderBy(telling.desc(), "mark").limit(MAX_MARKS)
    vocabulary = {r.mark: i for i, r in enumerate(best.select("mark").collect())}
    chain = Chain([*families, "toxic"], vocabulary)
    if not sample:
        return chain.fit(np.zeros(0, "int64"), np.zeros(0, "int64"), np.zeros((0, len(families) + 1)), np.zeros(0))
    place = {r.id: i for i, r in enumerate(sample)}
    used = seen.select("id", F.array_intersect("marks", F.lit(list(vocabulary) or [""])).alias("marks"))
    pairs = sorted((place[r.id], vocabulary[m]) for r in used.collect() for m in r.marks if m in vocabulary)
    line, word = np.array(pairs, dtype="int64").reshape(len(pairs), 2).T
    labels_of = np.array([[*(r.label * r[c] for c in families), r.label] for r in sample], dtype="float64")
    return chain.fit(line, word, labels_of, np.array([r.fold for r in sample]))


def scored(docs: DataFrame, chain: Chain, text_col: str = "text") -> DataFrame:
    """``row`` (struct of all input columns) and ``p`` (struct of a probability per category).

    Whole texts are read; null counts as empty, and an empty text has the categories' base rates.
    Repeated rows have equal results; an empty table gives an empty result; columns may have any
    names.
    """
    kind = ", ".join(f"{c} double" for c in chain.categories)

    @F.pandas_udf(kind)
    def judge(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            yield pd.DataFrame(chain.probabilities(list(texts)), columns=chain.categories)

    return docs.select(as_row(docs), judge(whole(F.col(f"`{text_col}`"))).alias("p"))
