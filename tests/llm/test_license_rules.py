"""License rules: each written notice is found, and overlaps are resolved as a brute-force pass does."""

import random
import re._parser as parser

from pyspark.sql import functions as F

from pagecensus.llm import license_scan as L
from pagecensus.llm.license_rules import NOTICES, TEXTS, rules


def example(items, draw):
    """A text that a pattern of words, choices and repetitions matches."""
    out = ""
    for kind, value in items:
        name = str(kind)
        if name == "LITERAL":
            out += chr(value)
        elif name == "SUBPATTERN":
            out += example(value[3], draw)
        elif name == "BRANCH":
            out += example(draw.choice(value[1]), draw)
        elif name in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT"):
            low, high, what = value
            for _ in range(draw.randint(low, min(int(high), low + 2))):
                out += example(what, draw)
        elif name == "IN":
            out += "x"
        else:
            raise ValueError(name)
    return out


def test_every_notice_is_found(spark):
    draw = random.Random(1)
    rows = []
    for n, (label, gate, pattern) in enumerate([*TEXTS, *NOTICES]):
        text = example(parser.parse(pattern), draw)
        words = text if gate in text else f"{gate} and then {text}"
        rows.append((n, label, f"Some words before. {words.upper() if n % 2 else words.replace(' ', '-')}, and some after."))
    df = spark.createDataFrame(rows, "doc_id int, label string, text string")
    missed = [
        (r.row.label, r.row.text, r.labels) for r in L.license_scan(df).collect()
        if not any(s.label.startswith(r.row.label.split("-")[0]) and s.confidence == 1.0 for s in r.spans)
    ]
    assert missed == []
    assert len(NOTICES) >= 200 and len(rules()) > 800


def test_standard_notices(spark):
    cases = {
        "GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version": "gpl-3.0-or-later",
        "This is GPLv2+ code": "gpl-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\")": "apache-2.0",
        "https://creativecommons.org/licenses/by-nc-sa/4.0/": "cc-by-nc-sa-4.0", "under the same terms as Perl itself.": "artistic-perl",
        "Use of this source code is governed by a BSD-style license": "bsd",
    }
    df = spark.createDataFrame(list(enumerate(cases)), "doc_id int, text string")
    found = {r.row.text: r.labels.split(",") for r in L.license_scan(df).collect()}
    for text, label in cases.items():
        assert label in found[text], (text, found[text])


def greedy(spans):
    held = [x for x in spans if not any((y[0] <= x[0] and x[1] <= y[1] and (y[0], y[1]) != (x[0], x[1])) for y in spans)]
    best = {}
    for start, end, priority, label in held:
        best[start, end] = min(best.get((start, end), (99, "")), (priority, label))
    out = []
    for (start, end), (priority, label) in sorted(best.items(), key=lambda x: (x[1][0], x[0][0] - x[0][1], x[0][0])):
        if not any(s < end and start < e for s, e, _, _ in out):
            out.append((start, end, priority, label))
    return sorted(out)


def test_overlaps_are_resolved_on_both_sides(spark):
    draw = random.Random(5)
    rows = []
    for n in range(400):
        spans = []
        for _ in range(draw.randint(0, 9)):
            start = draw.randint(0, 20)
            spans.append((start, start + draw.randint(1, 6), draw.randint(0, 4), draw.choice("abc"), 0.5))
        rows.append((n, spans))
    df = spark.createDataFrame(rows, f"n int, spans {L._SPAN}")
    for r in df.withColumn("kept", L._kept(F.col("spans"))).collect():
        got = [(s.start, s.end, s.priority, s.label) for s in r.kept]
        assert got == greedy([(s.start, s.end, s.priority, s.label) for s in r.spans])
