"""The segment field of personal data: brute-force cuts, held-out forms, very long texts."""

import random
import tracemalloc

import pytest

from pagecensus.llm import personal_data as P
from pagecensus.llm.personal_forms import written


@pytest.fixture(scope="module")
def weights():
    return P.fit(written(P.KINDS, P.WRITTEN, 1))


def best_cut(text, base, w):
    """The highest score of any set of segments that do not overlap, by trying all of them."""
    total = 0.0
    for low, high in P.regions(text):
        tokens, segments = P.lattice(text, low, high)
        free = [x for x in segments if not any(tokens[x[0]][0] < e and s < tokens[x[1] - 1][1] for _, s, e in base)]

        def most(at, free=free, size=len(tokens)):
            if at >= size:
                return 0.0
            found = most(at + 1)
            for first, after, _, features in free:
                if first == at:
                    found = max(found, sum(w.get(f, 0.0) for f in features) + most(after))
            return found

        total += most(0)
    return total


def score_of(text, spans, w):
    total = 0.0
    for low, high in P.regions(text):
        tokens, segments = P.lattice(text, low, high)
        for first, after, kind, features in segments:
            if (kind, tokens[first][0], tokens[after - 1][1]) in spans:
                total += sum(w.get(f, 0.0) for f in features)
    return total


def test_the_cut_is_the_best_of_all(weights):
    draw = random.Random(3)
    noise = {f: draw.gauss(0, 1) for f in weights}
    for w in (weights, noise):
        for text, _ in written(P.KINDS, 150, 21):
            base = P.base_spans(text)
            spans = P.added(text, base, w)
            assert sorted(spans, key=lambda x: x[1]) == sorted(set(spans), key=lambda x: x[1])
            assert abs(score_of(text, set(spans), w) - best_cut(text, base, w)) < 1e-9
            ends = sorted((s, e) for _, s, e in [*spans, *((k, s, e) for k, s, e in base)])
            for (_, e), (s, _) in zip(sorted((s, e) for _, s, e in spans), sorted((s, e) for _, s, e in spans)[1:]):
                assert e <= s
            assert ends == sorted(ends)


def test_forms_beyond_the_patterns_are_found(weights):
    found = missed = wrong = 0
    for text, spans in written(P.KINDS, 1500, 99):
        base = set(P.base_spans(text))
        extra = set(P.added(text, sorted(base), weights))
        found += len(set(spans) & (extra | base))
        missed += len(set(spans) - extra - base)
        wrong += len(extra - set(spans))
    assert found > 900 and missed <= 0.02 * found and wrong <= 0.02 * found
    for text, want in [
        ("call (415) 555-0132 now", "phone"), ("555-123-4567", "phone"), ("Telefon 0171 2345678 bitte", "phone"), ("10.0.0.999", None),
        ("joe@localhost", None), ("4785380592391138", None), ("on 2024-01-15 we", None), ('token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"', "secret"),
    ]:
        assert [P.KINDS[k] for k, _, _ in P.added(text, P.base_spans(text), weights)] == ([want] if want else []), text


def test_numbers_without_end_take_little_memory(weights):
    draw = random.Random(1)
    text = " ".join(str(draw.randint(1000, 9999)) for _ in range(40_000))
    tracemalloc.start()
    spans = P.added(text, P.base_spans(text), weights)
    _, peak = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert peak < 60 * len(text) and all(0 <= s < e <= len(text) for _, s, e in spans)
