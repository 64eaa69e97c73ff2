"""Filter audit, removal of repeated passages and vector codes: SQL, brute force and edge cases."""

import collections
import hashlib
import itertools

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from pagecensus.llm import substring_dedup, vector_codes
from pagecensus.llm.filter_audit import audit, fates, removal_steps
from pagecensus.llm.substring_dedup import without_repeats
from pagecensus.llm.vector_codes import compressed, label_errors

SF = "/root/testdata/sf0.001"
LONG = "the quick brown fox jumps over the lazy dog and runs away. " * 8000
TEXTS = [
    (1, "A B C", "en"), (2, "A B C", "fr"), (2, "A B C", "fr"), (3, None, None), (4, "", "en"), (5, " \t\n", ""), (None, "A B C", "en"),
    (None, None, None), (6, LONG, "de"), (7, LONG + "x", "de"), (8, " ".join(f"w{i}" for i in range(120)), "en"),
    (9, "# " + " ".join(f"v{i}" for i in range(120)), "fr"), (10, "ÀÉ 日本 😀 ▁ end", "es"), (0, "A B C", "fr"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(TEXTS, "doc_id long, text string, lang string")


def clashing(df):
    names = ["row", "key", "text_", "spans", "part", "mask", "n", "id", "v", "away", "code", "error", "label_error", "salt", "wanted", "digest"]
    return df.withColumns({c: F.lit("own") for c in names})


@pytest.mark.parametrize("name", ["op11_filter_audit", "op12_substring_dedup", "op13_vector_codes"])
def test_same_rows_as_sql(spark, name):
    con = duckdb.connect()
    for given in ("documents", "embeddings", "labels"):
        con.execute(f"create view {given} as select * from '{SF}/{given}.parquet'")
    want = con.execute(entry.oracle_sql()[name])
    columns = [d[0] for d in want.description]
    got = sorted(tuple(str(r[c]) for c in columns) for r in entry.queries()[name](spark, SF).collect())
    assert got == sorted(tuple(map(str, r)) for r in want.fetchall())


def words_of(text):
    return [w.decode() for w in (text or "").encode().split()]


def brute_audit(rows, good, toxic):
    """The report by applying the filters one after the other."""
    facts = []
    for i, text, lang in rows:
        text, words = text or "", words_of(text)
        fails = {
            "A": len(words) < 100, "B": 100 * len(set(words)) < 80 * len(words),
            "C": 100 * sum("A" <= c <= "Z" for c in text) > 10 * len(text), "D": any(c in "#$%&*|" for c in text),
            "E": i is not None and any(j is not None and j < i and (t or "") == text for j, t, _ in rows),
        }
        facts.append((lang or "", {f for f, bad in fails.items() if bad}, i in good, i in toxic))
    report, shares = {}, collections.Counter()
    for part in {f[0] for f in facts}:
        for order in map("".join, itertools.permutations("ABCDE")):
            left, gone = [f for f in facts if f[0] == part], []
            for step, letter in enumerate(order, 1):
                hit = [f for f in left if letter in f[1]]
                redundant = sum(letter in f[1] for f in gone)
                left, gone = [f for f in left if letter not in f[1]], gone + hit
                unique = sum(f[0] == part and f[1] == {letter} for f in facts)
                report[part, order, step] = [len(left), len(hit), redundant, unique, sum(f[2] for f in hit), sum(f[3] for f in hit)]
                shares[part, letter] += len(hit)
    return {k: (*v, shares[k[0], k[1][k[2] - 1]]) for k, v in report.items()}


def test_audit_is_brute_force(spark, docs):
    rng = np.random.default_rng(5)
    more = [
        (int(i), " ".join(rng.choice(["A", "b", "c#", "dd"], int(rng.integers(0, 150)))) if i % 3 else "same text", ["en", "fr", None][i % 3])
        for i in rng.integers(20, 200, 150)
    ]
    rows = TEXTS + more
    marks = [(i, int(i % 2 == 0), int(i % 5 == 0)) for i in range(0, 200, 3)] + [(6, 0, 1), (6, None, None), (None, 1, 1), (2, 1, 0)]
    labels = spark.createDataFrame(marks, "doc_id long, quality int, toxic int").withColumn("text", F.lit("own"))
    good = {i for i, q, _ in marks if q == 1 and i is not None}
    toxic = {i for i, _, t in marks if t == 1 and i is not None}
    found = audit(fates(clashing(spark.createDataFrame(rows, "doc_id long, text string, lang string")), labels)).collect()
    got = {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in found}
    assert len(got) == len(found) and got == brute_audit(rows, good, toxic)
    assert audit(fates(docs.limit(0), labels)).collect() == [] and audit(fates(docs, labels.limit(0))).count() == 5 * 600


def test_removal_steps_of_three_filters():
    orders, steps = removal_steps(3)
    for at, order in enumerate(orders):
        for mask in range(8):
            failed = [place for place, f in enumerate(order, 1) if mask >> f & 1]
            assert steps[mask, at] == min(failed, default=4)


def brute_kept(rows, window):
    where = collections.Counter()
    for _, text, *_ in rows:
        w = words_of(text)
        where.update(tuple(w[i : i + window]) for i in range(len(w) - window + 1))
    found = []
    for i, text, *_ in rows:
        w = words_of(text)
        gone = set()
        for k in range(len(w) - window + 1):
            if where[tuple(w[k : k + window])] > 1:
                gone.update(range(k, k + window))
        found.append((i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return sorted(found, key=str)


def kept(df, window=35):
    return sorted(((r.row.doc_id, r.n_words, r.n_removed, r.kept_text) for r in without_repeats(df, window).collect()), key=str)


@pytest.mark.parametrize("window", [1, 5, 35])
def test_repeats_are_brute_force(spark, docs, window):
    rng = np.random.default_rng(window)
    few, many = [f"a{i}" for i in range(4)], [f"é{i}" for i in range(900)]
    passages = [list(rng.choice(many, 60)) for _ in range(4)]
    rows = [(i, t) for i, t, _ in TEXTS if t is None or len(t) < 9999]
    for i in range(120):
        parts = [list(rng.choice(many, int(rng.integers(0, 90)))), passages[i % 4][: int(rng.integers(20, 61))], list(rng.choice(few, int(rng.integers(0, 50))))]
        rows.append((100 + i, " \n".join(x for p in rng.permutation(3) for x in parts[p])))
    rows += [(300, "z " * 200), (301, "p q r " * 60), rows[30], rows[30], (None, rows[40][1])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert kept(clashing(df).repartition(5), window) == brute_kept(rows, window)


def test_a_bucket_in_chunks_gives_the_same(spark, monkeypatch):
    """Chunks settle across each other: windows that meet in none of them, in one, and in several."""
    monkeypatch.setattr(substring_dedup, "BUCKET", 2)
    rng = np.random.default_rng(9)
    many = [f"m{i}" for i in range(400)]
    passage = list(rng.choice(many, 50))
    rows = [(i, " ".join([*rng.choice(many, 20), *passage[i % 9 : 36 + i % 13], *rng.choice(many, 20)])) for i in range(60)]
    rows += [(i, " ".join(passage)) for i in range(70, 90)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert kept(df) == brute_kept(rows, 35)


def test_long_texts_and_empty_tables(spark, docs, monkeypatch):
    found = {(i, n): (gone, text) for i, n, gone, text in kept(docs)}
    assert found[6, 96000] == (96000, "") and found[7, 96001] == (96000, "x")
    assert found[8, 120][0] == 0 and found[None, 0] == (0, "")
    assert kept(docs.limit(0)) == []
    monkeypatch.setattr(substring_dedup, "SLICE_WORDS", 100)
    monkeypatch.setattr(substring_dedup, "SLICE_BYTES", 50)
    assert len(substring_dedup._super_kmers(substring_dedup.Words([LONG]), 35)[0]) >= 96000 // 100
    text = "y " * 10 + "b" * 3_000_000 + " " + " ".join(f"u{i}" for i in range(60))
    found = substring_dedup._super_kmers(substring_dedup.Words([text]), 35)
    again = substring_dedup._super_kmers(substring_dedup.Words(["k " * 40000 + "#", text]), 35)
    assert found[3].tolist() == again[3][again[0] == 1].tolist()


def brute_codes(rows, parts=4, entries=256, rounds=4):
    cut = []
    for _, v in rows:
        whole = [int(np.floor(float(x) * 1024)) for x in v]
        width = len(whole) // parts
        cut.append([tuple(whole[p * width : (p + 1) * width]) for p in range(parts)])
    books = [[c[p] for c in cut[:entries]] for p in range(parts)]

    def near(part, book):
        return min((sum((a - b) ** 2 for a, b in zip(part, e)), i) for i, e in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            held = collections.defaultdict(list)
            for c in cut:
                held[near(c[p], books[p])[1]].append(c[p])
            books[p] = [tuple(sum(x) // len(held[i]) for x in zip(*held[i])) if i in held else e for i, e in enumerate(books[p])]
    final = [[near(c[p], books[p]) for p in range(parts)] for c in cut]
    text = ",".join(str(x) for book in books for e in book for x in e)
    return [("".join(f"{i:02x}" for _, i in f), sum(d for d, _ in f)) for f in final], hashlib.sha256(text.encode()).hexdigest()


@pytest.mark.parametrize("scale,kind", [(0.05, "float"), (1.0, "float"), (1e12, "float"), (1e30, "double")])
def test_codes_are_brute_force(spark, scale, kind):
    rng = np.random.default_rng(4)
    points = (rng.normal(size=(330, 12)) * scale).astype("float32" if kind == "float" else "float64")
    points[200:260] = points[:60]  # equal entries: ties go to the lower one
    rows = [(i, points[i].tolist()) for i in range(330)]
    rows += [(7, points[3].tolist())] * 3 + [(None, points[5].tolist())]
    bad = [(-1, None), (-2, [float("nan")] * 12), (-3, [None] + [0.0] * 11), (-4, [float("inf")] * 12)]
    ordered = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    want, books = brute_codes(ordered)
    df = clashing(spark.createDataFrame(bad + rows, f"vec_id long, embedding array<{kind}>"))
    coded, found = compressed(df.repartition(3))
    got = sorted((str(r.row.vec_id), str(r.row.embedding), r.code, r.error) for r in coded.collect())
    fits = [(code, error if error < 10**38 else None) for code, error in want]
    assert [(g[0], g[2], None if g[3] is None else int(g[3])) for g in got] == [
        (x[0], x[2], x[3]) for x in sorted((str(i), str(v), c, e) for (i, v), (c, e) in zip(ordered, fits))
    ]
    assert vector_codes.digest(found) == books


def test_pivots_prune_and_change_nothing():
    rng = np.random.default_rng(8)
    centres = rng.integers(-5000, 5000, (256, 8))
    parts = centres[rng.integers(0, 256, 3000)] + rng.integers(-40, 41, (3000, 8))
    pivots = vector_codes.chosen_pivots(centres, 12)
    index, best, evaluated = vector_codes.nearest(parts, vector_codes._apart(parts, pivots), pivots, centres)
    squares = ((parts[:, None] - centres[None]) ** 2).sum(2)
    assert (index == squares.argmin(1)).all() and (best == squares.min(1)).all()
    assert evaluated < 0.1 * squares.size


def test_vectors_of_other_lengths_and_labels(spark):
    rows = [(1, [1.0, 2.0, 3.0, 4.0, 5.0, 6.0], 1), (2, [1.0, 2.0], None), (3, [], None), (4, [0.5] * 8, 1), (5, None, 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    coded, books = compressed(df)
    assert [b.shape for b in books] == [(4, 2)] * 4
    found = {r.row.vec_id: (r.code, int(r.error), int(r.label_error)) for r in label_errors(coded, F.col("row.label"), F.col("row.vec_id")).collect()}
    assert found[1] == ("00000000", 0, 0) and found[2] == ("00010100", 0, 0) and found[3][0] == "02010100"
    assert set(found) == {1, 2, 3, 4}
    coded, books = compressed(df.limit(0))
    assert coded.collect() == [] and vector_codes.digest(books) == hashlib.sha256(b"").hexdigest()
    coded, _ = compressed(df.where("vec_id = 3"))
    assert [(r.code, int(r.error)) for r in coded.collect()] == [("00000000", 0)]
