"""License mentions by ordered signature rules, in DataFrame functions only.

A text becomes its words with one blank between them.  Only texts that hold one of a few fragments
are looked at further; there each rule is tried only where its gate, a literal name, occurs.  What
the rules find are word intervals: one that lies within another is dropped, equal ones leave the
rule of first priority, and of those that overlap the one of better priority stays.
"""

from __future__ import annotations

from itertools import groupby

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagecensus.llm.common import as_row, whole
from pagecensus.llm.license_rules import Rule, rules

#: Phrases that always count, with their labels.
BASE = {
    "gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit",
}
_GAP, _WORD = r"\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F", r"^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F"
_OPEN, _CLOSE = "\x01", "\x02"
_CHAIN = "array<struct<priority:int,minus_size:bigint,start:bigint,end:bigint,label:string,confidence:double>>"
_SPAN = "array<struct<start:bigint,end:bigint,priority:int,label:string,confidence:double>>"


def fragments(ordered: list[Rule]) -> list[str]:
    """A word, or part of one, out of every gate and base phrase: a text with a match holds one."""
    words = [phrase.split() for phrase in [*(r.gate for r in ordered), *BASE]]
    return sorted({"licen" if any("licen" in w for w in own) else max(own, key=len) for own in words})


def _n_words(text: Column) -> Column:
    marks = F.regexp_replace(text, f"[{_GAP}]*[{_WORD}]+[{_GAP}]*", "x")
    return F.when(text.rlike(f"[{_WORD}]"), F.length(marks)).otherwise(0).cast("long")


def _normal(text: Column) -> Column:
    """The words in lower case (A-Z only), each after one blank, and a blank at the end."""
    lower = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.regexp_replace(F.concat(F.lit(" "), lower, F.lit(" ")), f"[{_GAP}]+", " ")


def _places(normal: Column, pattern: Column) -> tuple[Column, Column]:
    """First and last words of a pattern's matches, counted from 0.

    Matches are marked in the text; marks are no word characters, so the words keep their places.
    """
    marked = F.regexp_replace(normal, F.concat(F.lit(" ("), pattern, F.lit(")(?= )")), F.lit(f" {_OPEN}$1{_CLOSE}"))
    words = F.split(F.trim(marked), " ")

    def where(test) -> Column:
        return F.filter(F.transform(words, lambda w, i: F.when(test(w), i.cast("long"))), lambda i: i.isNotNull())

    return where(lambda w: w.startswith(_OPEN)), where(lambda w: w.endswith(_CLOSE))


def _found(normal: Column, ordered: list[Rule]) -> Column:
    """All intervals that rules match, of rules whose gate occurs."""
    by_gate = sorted(ordered, key=lambda r: r.gate)
    groups = F.array(*[
        F.struct(
            F.lit(f" {gate} ").alias("gate"),
            F.array(*[
                F.struct(F.lit(r.label).alias("label"), F.lit(r.priority).alias("priority"),
                         F.lit(r.pattern).alias("pattern"), F.lit(r.confidence).alias("confidence"))
                for r in own
            ]).alias("rules"),
        )
        for gate, own in groupby(by_gate, key=lambda r: r.gate)
    ])
    # Gates are names in running words; between a name's words the text may hold anything but words.
    tried = F.flatten(F.transform(F.filter(groups, lambda g: F.contains(normal, g["gate"])), lambda g: g["rules"]))

    def intervals(rule: Column) -> Column:
        first, last = _places(normal, rule["pattern"])
        return F.transform(
            F.arrays_zip(first.alias("first"), last.alias("last")),
            lambda x: F.struct(
                x["first"].alias("start"), (x["last"] + 1).alias("end"), rule["priority"].alias("priority"),
                rule["label"].alias("label"), rule["confidence"].alias("confidence"),
            ),
        )

    return F.flatten(F.transform(tried, intervals)).cast(_SPAN)


def _kept(found: Column) -> Column:
    """The intervals that stand: none within another, and of those that overlap the best priorities.

    Intervals in a chain of overlaps are taken by priority, then length, then start; each stands if no
    better one of the chain overlaps it, whether that one begins before or after it.
    """
    ordered = F.array_sort(F.transform(found, lambda x: F.struct(
        x["start"].alias("start"), (-x["end"]).alias("minus_end"), x["priority"].alias("priority"),
        x["label"].alias("label"), x["confidence"].alias("confidence"),
    )))

    def chained(state: Column, x: Column) -> Column:
        end = -x["minus_end"]
        own = F.array(F.struct(
            x["priority"].alias("priority"), (x["start"] - end).alias("minus_size"), x["start"].alias("start"), end.alias("end"),
            x["label"].alias("label"), x["confidence"].alias("confidence"),
        ))
        joins = x["start"] < state["until"]
        return F.when(end <= state["until"], state).otherwise(F.struct(
            end.alias("until"), F.when(joins, state["done"]).otherwise(F.concat(state["done"], F.array(state["open"]))).alias("done"),
            F.when(joins, F.concat(state["open"], own)).otherwise(own).alias("open"),
        ))

    def best(chain: Column) -> Column:
        def take(spans: Column, x: Column) -> Column:
            clear = ~F.exists(spans, lambda y: (y["start"] < x["end"]) & (x["start"] < y["end"]))
            own = F.array(F.struct(*[x[n].alias(n) for n in ("start", "end", "priority", "label", "confidence")]))
            return F.when(clear, F.concat(spans, own)).otherwise(spans)

        return F.aggregate(F.array_sort(chain), F.array().cast(_SPAN), take)

    start = F.struct(F.lit(0).cast("long").alias("until"), F.array().cast(f"array<{_CHAIN}>").alias("done"), F.array().cast(_CHAIN).alias("open"))
    chains = F.aggregate(ordered, start, chained, lambda s: F.concat(s["done"], F.array(s["open"])))
    return F.array_sort(F.flatten(F.transform(chains, best)))


def license_scan(docs: DataFrame, text_col: str = "text", ordered: list[Rule] | None = None) -> DataFrame:
    """License mentions of each whole text.

    Returns one row per input row: ``row`` (struct of all input columns), ``n_words``, ``n_base``
    (places of the base phrases), ``first_word`` and ``last_word`` (their smallest and largest start,
    from 0; null without any), ``base_labels``, ``spans`` (what the rules found: start, end, priority,
    label, confidence; end exclusive), ``labels`` (base and rules, distinct, sorted, comma-joined) and
    ``score`` (highest confidence of a span, at least 0.6 with a base phrase, else 0).

    Null counts as empty; texts without words or mentions have empty labels and score 0.  Repeated
    rows have equal results; an empty table gives an empty result; columns may have any names.
    """
    text = whole(F.col(f"`{text_col}`"))
    lower = F.lower(text)
    ordered = ordered or rules()
    maybe = F.lit(False)
    for fragment in fragments(ordered):
        maybe = maybe | F.contains(lower, F.lit(fragment))
    normal = F.when(maybe, _normal(text)).otherwise(" ")
    named = docs.select(as_row(docs), _n_words(text).alias("n_words"), normal.alias("normal"))
    some = F.col("normal") != " "
    none = F.array().cast("array<bigint>")
    starts = {
        label: F.when(F.contains("normal", F.lit(f" {phrase} ")), _places(F.col("normal"), F.lit(phrase))[0]).otherwise(none)
        for phrase, label in BASE.items()
    }
    spans = F.when(some, _kept(_found(F.col("normal"), ordered))).otherwise(F.array().cast(_SPAN))
    seen = named.select("row", "n_words", spans.alias("spans"), *[c.alias(f"at_{k}") for k, c in starts.items()])
    base = F.concat(*[F.col(f"`at_{k}`") for k in starts])
    own = F.array_compact(F.array(*[F.when(F.size(F.col(f"`at_{k}`")) > 0, F.lit(k)) for k in starts]))
    by_rule = F.transform("spans", lambda s: s["label"])
    trust = F.greatest(
        F.coalesce(F.array_max(F.transform("spans", lambda s: s["confidence"])), F.lit(0.0)),
        F.when(F.size(base) > 0, 0.6).otherwise(0.0),
    )
    return seen.select(
        "row", "n_words", F.size(base).cast("long").alias("n_base"), F.array_min(base).alias("first_word"),
        F.array_max(base).alias("last_word"), F.array_join(F.array_sort(own), ",").alias("base_labels"), "spans",
        F.array_join(F.array_sort(F.array_distinct(F.concat(own, by_rule))), ",").alias("labels"), trust.alias("score"),
    )
