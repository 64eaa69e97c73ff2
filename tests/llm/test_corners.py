"""Cases beyond the given tables: huge and uneven vectors, repeated identifiers, very many sources."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagecensus.llm.mixing import allotted, mix, routed
from pagecensus.llm.near_dedup import near_duplicates
from pagecensus.llm.vector_search import top_k


def best(rows, k=5):
    whole = [(i, [int(np.floor(float(x) * 256)) for x in v]) for i, v in rows]
    found = []
    for q, a in sorted({(i, tuple(v)) for i, v in whole if i % 50 == 0}):
        scored = sorted((-sum(x * y for x, y in zip(a, v)), i) for i, v in whole if i != q)
        found += [(q, n, i, -s if abs(s) < 1 << 63 else None) for n, (s, i) in enumerate(scored[:k], 1)]
    return found


@pytest.mark.parametrize("size", [1.0, 1e6, 3e8, 1e12])
def test_scores_are_exact_at_any_size(spark, size):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(160, 6)) * size
    base[40:80] = base[:40]
    base[40:80, 5] += 1 / 256  # differs from its twin in the last place only
    rows = [(int(i), base[i].tolist()) for i in range(160)] + [(50, base[50].tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in top_k(df, F.col("vec_id") % 50 == 0).collect())
    assert found == sorted(best(rows))


def test_vectors_of_other_lengths_are_filled_up(spark):
    rows = [(0, [1.0, 2.0, 3.0]), (1, [1.0]), (2, [0.0, 1.0]), (3, [0.0, 0.0, 1.0]), (50, [2.0])]
    df = spark.createDataFrame([*rows, (4, [1e30, 0.0, 0.0])], "vec_id long, embedding array<double>")
    found = [(r.query_id, r["rank"], r.vec_id, r.score) for r in top_k(df, F.col("vec_id") % 50 == 0).orderBy("query_id", "rank").collect()]
    assert found == [(0, 1, 3, 3 * 65536), (0, 2, 2, 2 * 65536), (0, 3, 50, 2 * 65536), (0, 4, 1, 65536)] + [
        (50, 1, 0, 2 * 65536), (50, 2, 1, 2 * 65536), (50, 3, 2, 0), (50, 4, 3, 0),
    ]


def test_an_identifier_with_several_texts_joins_their_components(spark):
    a, b, c, d = (" ".join(f"{w}{i}" for i in range(40)) for w in "abcd")
    rows = [(5, a), (7, a), (7, b), (9, b), (9, c), (12, d), (13, c + " x"), (14, d)]
    found = {(r.row.doc_id, r.component_id, r.kept) for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found == {(5, 5, True), (7, 5, False), (9, 5, False), (13, 5, False), (12, 12, True), (14, 12, False)}


def test_more_sources_than_one_network_holds(spark):
    docs = spark.range(30_000).select(F.col("id").alias("doc_id"), F.lit("a b c").alias("text"), (F.col("id") % 6000).cast("string").alias("source"))
    taken, known = mix(docs, F.array("source"))
    assert known.count() == 6000
    words = {r.source: r.words for r in taken.groupBy("row.source").agg(F.sum(F.col("size") * F.col("times")).alias("words")).collect()}
    for r in known.collect():
        assert 0 <= r.target - words[r.source] < 3


def test_separate_networks_route_like_one():
    rng = np.random.default_rng(6)
    for _ in range(30):
        groups = int(rng.integers(1, 5))
        members, quotas = [], []
        for g in range(groups):
            held = list(range(len(quotas), len(quotas) + int(rng.integers(1, 4))))
            quotas += [int(x) for x in rng.integers(0, 60, len(held))]
            members += [sorted({int(x) for x in rng.choice(held, 2)}) for _ in range(int(rng.integers(1, 4)))]
        tokens = [int(x) for x in rng.integers(0, 40, len(members))]
        apart, one = allotted(tokens, members, quotas, 3), routed(tokens, members, quotas, 3)
        assert sum(apart) == sum(one)

        def cost(flows):
            return sum(sum(again * min(words, max(0, flow - again * words)) for again in range(3)) for words, flow in zip(tokens, flows))

        assert cost(apart) == cost(one)
