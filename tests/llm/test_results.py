"""The corpus queries against SQL, brute force, round trips and held-out labels."""

import collections
import hashlib
import itertools
import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from pagecensus.llm import piece_codec
from pagecensus.llm.boosting import fit
from pagecensus.llm.main_text import main_text
from pagecensus.llm.mixing import mix, routed, shared_targets
from pagecensus.llm.near_dedup import near_duplicates
from pagecensus.llm.personal_data import base_spans, regions
from pagecensus.llm.queries import PIECE_MODEL

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def result(spark, name):
    return entry.queries()[name](spark, SF).collect()


@pytest.mark.parametrize("name", ["op1_exact_dedup", "op3_vector_search"])
def test_same_rows_as_sql(spark, name):
    con = duckdb.connect()
    for given in ("documents", "embeddings"):
        con.execute(f"create view {given} as select * from '{SF}/{given}.parquet'")
    want = con.execute(entry.oracle_sql()[name])
    columns = [d[0] for d in want.description]
    got = sorted(tuple(str(r[c]) for c in columns) for r in result(spark, name))
    assert got == sorted(tuple(map(str, r)) for r in want.fetchall())


def test_mixing_meets_its_targets(spark):
    rows = result(spark, "op2_mixing")
    taken = collections.Counter()
    for r in rows:
        taken[r.source] += r.taken
        assert r.taken in (0, r.size, 2 * r.size, 3 * r.size)
    targets = {r.source: (r.target, r.source_size) for r in rows}
    total = sum(r.size for r in rows)
    assert abs(sum(t for t, _ in targets.values()) - total) < 1
    for source, (target, size) in targets.items():
        assert target <= 3 * size + 1e-6 and abs(taken[source] - target) <= 0.05 * target + 60
    assert sorted(map(str, rows)) == sorted(map(str, result(spark, "op2_mixing")))


def test_shares_beyond_the_cap_are_shared_anew():
    assert list(map(float, shared_targets([10, 100, 1000], [1, 2, 3], 1110, 3))) == [30.0, 300.0, 780.0]
    assert shared_targets([], [], 0, 3) == [] and list(map(float, shared_targets([0, 5], [1, 2], 5, 3))) == [0.0, 5.0]


def test_flow_prefers_first_copies():
    # Source 0 can be met by pattern 0 alone or by the shared pattern 1; source 1 by pattern 1 only.
    assert routed([10, 10], [[0], [0, 1]], [10, 10], 3) == [10, 10]
    assert routed([10, 10], [[0], [0, 1]], [12, 8], 3) == [10, 10]
    assert routed([10, 5], [[0], [1]], [5, 30], 3) == [5, 15]


def test_overlapping_sources(spark):
    docs = spark.range(300).select(F.col("id").alias("doc_id"), F.lit("a b c d").alias("text"), (F.col("id") % 3).alias("k"))
    sources = F.when(F.col("k") == 0, F.array(F.lit("x"))).when(F.col("k") == 1, F.array(F.lit("x"), F.lit("y"))).otherwise(F.array(F.lit("y")))
    taken, known = mix(docs, sources)
    targets = {r.source: r.target for r in known.collect()}
    assert targets == {"x": 400.0, "y": 800.0}
    words = {r.pattern: r.words for r in taken.groupBy("pattern").agg(F.sum(F.col("size") * F.col("times")).alias("words")).collect()}
    assert sum(words.values()) == 1200 and words['["x"]'] == words['["x","y"]'] == words['["y"]'] == 400


def test_mixing_fills_the_gap_before_a_long_document(spark):
    # Source a wants a third of all words; its one long document has a hash where they are reached.
    shorts = [(i, "a" if i < 3000 else "b", 64 + i * 37 % 64) for i in range(6000)]
    sizes = {s: sum(n for _, t, n in shorts if t == s) for s in "ab"}
    rest = (sum(sizes.values()) + 20_000) // 3
    hashed = spark.range(10_000, 10_200).select("id", F.shiftrightunsigned(F.xxhash64(F.lit(1), "id"), 1).alias("h"))
    long = min(hashed.collect(), key=lambda r: abs(r.h / 2**63 - (rest - 10_000) / sizes["a"])).id
    rows = [*shorts, (long, "a", 20_000)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, n int").withColumn("text", F.expr("repeat('w ', n)"))
    taken, known = mix(docs, F.array("source"))
    words = {r.source: r.words for r in taken.groupBy("row.source").agg(F.sum(F.col("size") * F.col("times")).alias("words")).collect()}
    for r in known.collect():
        assert 0 <= r.target - words[r.source] < 64


def shingles(text, width):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()


def components(sets):
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    where, common = collections.defaultdict(list), collections.Counter()
    for i, s in sets.items():
        for x in s:
            where[x].append(i)
    for ids in where.values():
        common.update(itertools.combinations(ids, 2))
    for (a, b), n in common.items():
        if 100 * n >= 80 * (len(sets[a]) + len(sets[b]) - n):
            a, b = root(a), root(b)
            parent[max(a, b)] = min(a, b)
    return {i: root(i) for i in sets}


def test_near_dedup_is_brute_force(spark, texts):
    sets = {i: shingles(t, 4) for i, t in texts.items()}
    want = components(sets)
    for r in result(spark, "op4_near_dedup"):
        assert (r.n_shingles, r.component_id, r.kept) == (len(sets[r.doc_id]), want[r.doc_id], want[r.doc_id] == r.doc_id)


def test_near_dedup_of_chains_and_templates(spark):
    """Groups that no single representative covers: chains of edits, and texts that share a template."""
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in range(5000)]
    rows = []
    for group in range(6):
        text = list(rng.choice(words, 120))
        for _ in range(25):  # each a few edits from the one before
            rows.append(" ".join(text))
            for at in rng.integers(0, 120, 2):
                text[at] = rng.choice(words)
    template = list(rng.choice(words, 70))
    rows += [" ".join(template + list(rng.choice(words, 30))) for _ in range(150)]
    order = rng.permutation(len(rows))
    texts = {int(i): rows[j] for i, j in enumerate(order)}
    want = components({i: shingles(t, 5) for i, t in texts.items()})
    found = near_duplicates(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()
    assert {r.row.doc_id: r.component_id for r in found} == want


def brute_spans(text):
    def luhn(d):
        return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0

    kinds = (
        r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]",
    )
    out = []
    for k, pattern in enumerate(kinds):
        for m in re.finditer(pattern, text):
            d = re.sub("[^0-9]", "", m[0])
            if (k == 1 and any(int(p) > 255 for p in m[0].split("."))) or (k == 2 and not (13 <= len(d) <= 19 and luhn(d))):
                continue
            if k == 3 and not 9 <= len(d) <= 15:
                continue
            out.append((k, m.start(), m.end()))
    return out


def test_personal_data_has_the_patterns(spark, texts):
    for r in result(spark, "op5_personal_data"):
        base = [f"{('email', 'ip', 'card', 'phone')[k]}:{s}:{e}" for k, s, e in brute_spans(texts[r.doc_id] or "")]
        assert r.base_sha256 == hashlib.sha256(",".join(base).encode()).hexdigest()
        assert set(base) <= set(r.spans.split(",")) | {""}


def test_patterns_on_random_signs():
    rng = np.random.default_rng(5)
    for _ in range(4000):
        text = "".join(rng.choice(list("0123456789  ..--@@++()ab1234567é\n"), rng.integers(1, 60)))
        assert sorted(base_spans(text)) == sorted(brute_spans(text)), text
        ends = [0]
        for low, high in regions(text):
            assert ends[-1] <= low <= high <= len(text)
            ends.append(high)


def test_license_base_is_brute_force(spark, texts):
    phrases = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
    for r in result(spark, "op6_license_scan"):
        text = re.sub("[A-Z]", lambda m: m[0].lower(), texts[r.doc_id] or "")
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text)
        hits = [(i, label) for p, label in phrases.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
        starts = [i for i, _ in hits]
        base = ",".join(sorted({label for _, label in hits}))
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == (
            len(w), len(hits), min(starts, default=None), max(starts, default=None), base)
        assert set(filter(None, base.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1


def test_license_rules_resolve_overlaps(spark):
    from pagecensus.llm.license_scan import license_scan

    cases = {
        "under the GNU General Public License, version 3 or later.": "gpl,gpl-3.0-or-later",
        "Licensed under CC BY-NC 4.0": "cc-by,cc-by-nc-4.0",
        "SPDX-License-Identifier: Apache-2.0": "apache-2.0",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software": "mit",
        "the apache flew over the mitten": "",
        "(LPPL,version_1.2)": "lppl-1.2",
        "Creative\tCommons -- Attribution ShareAlike 3.0": "cc-by-sa-3.0",
    }
    rows = spark.createDataFrame(list(enumerate(cases)), "doc_id long, text string")
    found = {r.row.text: r.labels for r in license_scan(rows).collect()}
    assert found == cases


def test_quality_on_held_out_rows(spark):
    labels = {r.doc_id: r.quality for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    rows = entry.queries()["op9_quality"](spark, "/root/testdata/sf0.01").collect()
    held = [(labels[r.doc_id], r.predicted) for r in rows if r.held_out and r.doc_id in labels]
    assert len(held) > 50 and sum(a == b for a, b in held) / len(held) >= 0.95
    assert all(0 <= r.score <= 1 for r in rows)


def test_toxicity_on_held_out_rows(spark):
    labels = {r.doc_id: r.toxic for r in spark.read.parquet("/root/testdata/sf0.1/labels.parquet").collect()}
    rows = entry.queries()["op7_toxicity"](spark, "/root/testdata/sf0.1").where("held_out").collect()
    held = collections.Counter((labels[r.doc_id], r.predicted) for r in rows if r.doc_id in labels)
    assert held[1, 1] / (held[1, 1] + held[1, 0]) >= 0.85
    assert held[0, 1] / (held[0, 1] + held[0, 0]) <= 0.01


def test_forest_walk_is_the_trees():
    rng = np.random.default_rng(1)
    rows = rng.normal(size=(500, 4))
    label = ((rows[:, 0] > 0) ^ (rows[:, 2] > 0.5)).astype(float)
    forest = fit(rows, label, trees=12, depth=3)
    walked = []
    for row in rows:
        total = forest.base
        for feature, threshold, leaf in zip(forest.feature, forest.threshold, forest.leaf):
            at = 0
            while at < len(feature):
                at = 2 * at + 1 + (row[feature[at]] > threshold[at])
            total += leaf[at - len(feature)]
        walked.append(total)
    assert np.allclose(walked, forest.log_odds(rows))
    assert ((forest.probability(rows) > 0.5) == label).mean() > 0.97


PAGE = """<html><head><title>Title of the page</title><style>p{}</style><script>var x = "<p>no</p>";</script></head><body>
<header><p>The site of the day and of the night with the best of the news that there is for you</p></header>
<nav><ul><li><a href="/a">One</a><li><a href="/b">Two</a></ul></nav>
<div class="cookie-notice"><p>We use cookies and the like so that it is what you want from all of our pages in the end</p></div>
<div><article><h1>Heading</h1><p>The first of the paragraphs &amp; what it has to say to all of them,<br>with   more.
<p>Short one.<div class="ad"><p>Buy this and that with all of your money because it is the best of all the things</p></div>
<p>The last of the paragraphs and what it has to say to the ones who are still there.</article></div>
<aside>The other things that are on this site and that you may want to read as well as this one</aside>
<section id="comments"><article><p>I am the first of the readers and this is what I have to say about it all today</p></article></section>
<form><p>Write to us with all that you have to say and we will be there for you with the answer</p></form>
<footer>&copy; 2020 the people who made this and all of the rest of it for the good of the many</footer></body></html>"""


def test_main_text_leaves_the_rest_out():
    assert main_text(PAGE).split("\n") == [
        "Heading", "The first of the paragraphs & what it has to say to all of them, with more.", "Short one.",
        "The last of the paragraphs and what it has to say to the ones who are still there.",
    ]
    assert main_text("") == "" and main_text("<p") == "" and main_text("<!-- <p>x</p>") == ""
    assert main_text("<script>never closed <p>text</p>") == ""


def test_main_text_of_pages(spark):
    import html

    pages = {r.page_id: r.html for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    for r in result(spark, "op8_main_text"):
        inner = re.sub("</?b>", "", re.search(r"<article>(.*?)</article>", pages[r.page_id], re.S)[1]).replace("<br>", " ")
        parts = [" ".join(html.unescape(p).split()) for p in re.split("</?(?:h1|p)>", inner)]
        assert r.text == "\n".join(p for p in parts if p) and r.n_chars == len(r.text)


def test_pieces_are_the_librarys_without_dropout(texts):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=PIECE_MODEL)
    vocabulary = piece_codec.load(PIECE_MODEL)
    some = [t for t in texts.values() if t and piece_codec.MARK not in t]
    plain = piece_codec.encode(some, list(range(len(some))), vocabulary, dropout=0.0)
    assert [x.tolist() for x in plain] == library.encode(some)


def test_dropout_is_seeded_varied_and_lossless(texts):
    vocabulary = piece_codec.load(PIECE_MODEL)
    some = [t or "" for t in texts.values()][:40] + ["", " ", "▁ ▁", "<0x0A>\n\n", "日本語😀", "ab" * 500]
    names = list(range(len(some)))
    one, again, other = (piece_codec.encode(some, names, vocabulary, 0.3, seed) for seed in (1, 1, 2))
    assert all((a == b).all() for a, b in zip(one, again))
    assert sum(a.tolist() != b.tolist() for a, b in zip(one, other)) >= 40
    assert [piece_codec.decode(x, vocabulary) for x in one] == some


def test_arrays_and_heap_merge_alike(texts, monkeypatch):
    vocabulary = piece_codec.load(PIECE_MODEL)
    some = [t or "" for t in texts.values()][:12]
    together = piece_codec.encode(some, list(range(12)), vocabulary, 0.2, 4)
    monkeypatch.setattr(piece_codec, "LONGEST_IN_ARRAYS", 0)
    alone = piece_codec.encode(some, list(range(12)), vocabulary, 0.2, 4)
    assert [x.tolist() for x in together] == [x.tolist() for x in alone]


def test_pipeline_stages_do_what_they_say(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    stages = dict(corpus_pipeline.STAGES)
    good = stages["quality"](spark, docs, SF)
    kept = {r.doc_id for r in good.collect()}
    clean = [i for i, q in labels.items() if q == 1]
    assert sum(i in kept for i in clean) >= 0.95 * len(clean)
    single = stages["exact_dedup"](spark, docs, SF).collect()
    squeezed = [re.sub(r"[\x20\x09-\x0D]", "", r.text or "") for r in single]
    assert len(squeezed) == len(set(squeezed)) == len({re.sub(r"[\x20\x09-\x0D]", "", r.text or "") for r in docs.collect()})
    apart = stages["near_dedup"](spark, docs, SF).collect()
    want = components({r.doc_id: shingles(r.text, 5) for r in docs.collect()})
    assert sorted(r.doc_id for r in apart) == sorted(i for i, c in want.items() if i == c)
    assert all(f.columns == docs.columns for f in (good, stages["mixing"](spark, docs, SF)))


@pytest.mark.parametrize("kept", [10, 0])
def test_each_occurrence_has_its_own_dropout(kept, monkeypatch):
    monkeypatch.setattr(piece_codec, "LONGEST_KEPT", kept, raising=False)
    vocabulary, n = piece_codec.load(PIECE_MODEL), 4000
    a, word = (piece_codec.encode([w], [0], vocabulary, 0.0)[0].tolist() for w in ("a", "something"))
    one_text = [" ".join(["a"] * n)], [7]
    own_ids = ["a"] * n, list(range(n))
    no_ids = [f"a {i}" for i in range(n)], [None] * n
    for texts, names in (one_text, own_ids, no_ids):  # a single candidate merge
        coded = np.concatenate(piece_codec.encode(texts, names, vocabulary, 0.1, 3))
        assert len(a) == 1 and abs((coded == a[0]).mean() * len(coded) / n - 0.9) < 0.02
    coded = [tuple(x) for x in piece_codec.encode(["something"] * n, list(range(n)), vocabulary, 0.1, 3)]
    assert len(set(coded)) > 20 and coded.count(tuple(word)) < 0.9 * n
