"""Every corpus operator and stage on nulls, empty and very long texts, ties, repeated rows, empty
tables and clashing column names."""

import hashlib

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from pagecensus.llm import personal_data, piece_codec, quality, toxicity
from pagecensus.llm.exact_dedup import deduplicated, exact_dedup
from pagecensus.llm.license_scan import license_scan
from pagecensus.llm.main_text import extracted
from pagecensus.llm.mixing import mix, mixed
from pagecensus.llm.near_dedup import near_duplicates, representatives
from pagecensus.llm.queries import PIECE_MODEL
from pagecensus.llm.vector_search import top_k

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
CLASHES = ["row", "id", "norm", "hash", "size", "pattern", "n", "digest", "keys", "score", "text_sha256", "kept", "pieces", "spans", "base"]
LONG = "the quick brown fox jumps over the lazy dog and runs away. " * 8000
ROWS = [
    (1, "one two three four five six", "en", "a", 0), (2, "one two  three four\nfive six", "en", "b", 0),
    (3, None, None, None, None), (4, "", "en", "a", 0), (5, " \t\n", "en", "b", 0),
    (6, LONG, "de", None, 1), (7, LONG + "x", "de", "b", 1), (8, LONG, "de", "a", 1), (8, LONG, "de", "a", 1),
    (None, "one two three four five six", "en", "a", 0), (9, "MIT License mail me@x.org", "en", "é", 3),
    (10, "seven words are in this short text", "en", "b", 2), (11, "ÀÉ 日本 😀 ▁   end", "fr", "b", 2),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, DOCS)


@pytest.fixture(scope="module")
def clashing(docs):
    return docs.withColumns({c: F.lit("own") for c in CLASHES})


@pytest.fixture(scope="module")
def labels(spark):
    rows = [(1, 1, 0), (2, 0, 1), (6, 1, 0), (7, 0, 1), (10, None, None), (None, 1, 1), (11, 0, 0), (11, 1, 1)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def operators(labels):
    return {
        "exact_dedup": exact_dedup, "mixing": lambda d: mix(d, F.array("source"))[0], "near_dedup": near_duplicates,
        "personal_data": lambda d: personal_data.personal_data(d, personal_data.fitted(d)), "license_scan": license_scan,
        "toxicity": lambda d: toxicity.scored(d, toxicity.fitted(d, labels)),
        "quality": lambda d: quality.scored(d, quality.fitted(d, labels)),
        "piece_codec": lambda d: piece_codec.encoded(d, PIECE_MODEL),
        "main_text": lambda d: extracted(d, html_col="text"),
    }


NAMES = ["exact_dedup", "mixing", "near_dedup", "personal_data", "license_scan", "toxicity", "quality", "piece_codec", "main_text"]


@pytest.mark.parametrize("name", NAMES)
def test_every_row_and_column_comes_back(name, clashing, labels):
    found = operators(labels)[name](clashing)
    back = found.select("row.*")
    assert back.columns == clashing.columns
    assert sorted(map(str, back.collect())) == sorted(map(str, clashing.collect()))


@pytest.mark.parametrize("name", NAMES)
def test_an_empty_table_gives_an_empty_result(name, docs, labels):
    assert operators(labels)[name](docs.limit(0)).collect() == []


@pytest.mark.parametrize("name", ["quality", "toxicity"])
def test_without_labels_scores_are_constant(name, docs, labels):
    found = operators(labels.limit(0))[name](docs).drop("row").distinct().collect()
    assert len(found) == 1


@pytest.mark.parametrize("stage", [deduplicated, representatives, lambda d: mixed(d, F.array("source"))])
def test_stages_keep_columns_and_lose_nothing_on_empty_tables(stage, docs):
    assert stage(docs).columns == docs.columns
    assert stage(docs.limit(0)).collect() == []


def test_pipeline_stages(spark, docs, labels, tmp_path):
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    found = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert found and all(r.lossless for r in found)


def test_exact_dedup_groups(docs):
    found = {(r.row.doc_id, i): r for i, r in enumerate(exact_dedup(docs).collect())}
    by_id = {}
    for (doc_id, _), r in found.items():
        by_id.setdefault(doc_id, []).append(r)
    assert [r.keep_id for r in by_id[1] + by_id[2] + by_id[None]] == [2, 2, 2]  # most code points stays
    assert {r.group_size for r in by_id[1]} == {3}
    assert [by_id[i][0].keep_id for i in (3, 4, 5)] == [5, 5, 5]  # null and empty are one text
    assert sorted(r.kept for r in by_id[8]) == [False, False] and by_id[6][0].kept
    assert by_id[4][0].text_sha256 == hashlib.sha256(b"").hexdigest()
    assert sum(r.kept for r in found.values()) == len({r.text_sha256 for r in found.values()})


def test_exact_dedup_splits_a_hot_text(spark):
    rows = [(i, "same  text" if i % 3 else f"text {i}") for i in range(900)] + [(1, "same  text")]
    found = exact_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    hot = [r for r in found if r.row.text == "same  text"]
    assert {(r.keep_id, r.group_size) for r in hot} == {(1, 601)}
    assert sum(r.kept for r in hot) == 1
    assert all(r.kept and r.group_size == 1 for r in found if r.row.text != "same  text")


def test_near_dedup_ids(docs):
    found = {}
    for r in near_duplicates(docs).collect():
        found.setdefault(r.row.doc_id, []).append((r.n_shingles, r.component_id, r.kept))
    assert found[1] == [(2, 1, True)] and found[2] == [(2, 1, False)] and found[None] == [(2, 1, False)]
    assert found[3] == [(0, 3, True)] and found[4] == [(0, 4, True)] and found[5] == [(0, 5, True)]
    assert found[7] == [(found[6][0][0] + 1 - 0, 6, False)] or found[7][0][1] == 6
    assert len(found[8]) == 2 and {x[1] for x in found[8]} == {6}


def test_near_dedup_of_rows_without_an_id(spark):
    words = [" ".join(f"{w}{i}" for i in range(60)) for w in "abcde"]
    rows = [
        (5, words[0]), (None, words[0] + " x"), (None, words[1]), (None, words[2]), (None, words[2] + " x"), (None, words[2]),
        (None, words[3]), (None, words[3]), (None, ""), (None, " "), (None, ""), (6, words[4]),
    ]
    found = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(found) == len(rows)
    by_text = {}
    for r in found:
        by_text.setdefault(r.row.text[:1].strip(), []).append((r.row.doc_id, r.component_id, r.kept))
    assert sorted(by_text["a"], key=str) == [(5, 5, True), (None, 5, False)]
    assert by_text["b"] == [(None, None, True)] and by_text["e"] == [(6, 6, True)]
    assert sorted(by_text["c"], key=str) == [(None, None, False)] * 2 + [(None, None, True)]
    assert sorted(by_text["d"], key=str) == [(None, None, False), (None, None, True)]
    assert by_text[""] == [(None, None, True)] * 3


def test_license_edges(docs):
    found = {r.row.doc_id: r for r in license_scan(docs).collect()}
    assert (found[3].n_words, found[3].n_base, found[3].first_word, found[3].labels, found[3].score) == (0, 0, None, "", 0.0)
    assert (found[9].n_words, found[9].n_base, found[9].first_word, found[9].base_labels) == (6, 1, 0, "mit")


def test_personal_data_edges(docs):
    found = {r.row.doc_id: r for r in personal_data.personal_data(docs, {}).collect()}
    assert found[9].base == ["email:17:25"] and found[9].n_email == 1
    assert found[3].base == [] and found[3].spans == []


def test_piece_codec_gives_back_every_text(docs):
    coded = piece_codec.decoded(piece_codec.encoded(docs, PIECE_MODEL), PIECE_MODEL, out="again").collect()
    assert all(r.decoded == r.again == (r.row.text or "") for r in coded)
    assert [len(r.pieces) for r in coded if not r.row.text] == [0, 0]


def test_vectors_with_gaps_take_no_part(spark):
    rows = [
        (0, [1.0, 0.5]), (1, [1.0, 0.25]), (2, None), (3, [float("nan"), 1.0]), (4, [1.0, None]), (5, []), (None, [9.0, 9.0]),
        (6, [1.0, 0.25]), (7, [-1.0, 0.0]), (50, [0.0, 1.0]), (50, [0.0, 1.0]), (8, [float("inf"), 0.0]),
    ]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("id", F.lit(1))
    found = top_k(vectors, F.col("vec_id") % 50 == 0).collect()
    want = {0: [(1, 73728), (6, 73728), (50, 32768), (50, 32768), (7, -65536)], 50: [(0, 32768), (1, 16384), (6, 16384), (7, 0)]}
    for query, best in want.items():
        own = sorted((r.rank, r.vec_id, r.score) for r in found if r.query_id == query)
        assert own == [(i + 1, v, s) for i, (v, s) in enumerate(best)]
    assert top_k(vectors.limit(0), F.col("vec_id") % 50 == 0).collect() == []
