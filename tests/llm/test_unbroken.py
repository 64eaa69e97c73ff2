"""Pieces of texts without blanks, and of documents that a mix holds several times."""

import base64
import random

import numpy as np
import pytest
import sentencepiece

from pagecensus.llm import piece_codec
from pagecensus.llm.queries import PIECE_MODEL, coded


@pytest.fixture(scope="module")
def vocabulary():
    return piece_codec.load(PIECE_MODEL)


def unbroken():
    draw = random.Random(4)
    yield "".join(draw.choice(["the", "quick", "brown", "Fuchs", "über", "señor", "and"]) for _ in range(800))
    yield "".join(chr(draw.randint(0x4E00, 0x9FFF)) for _ in range(2000))
    yield base64.b64encode(draw.randbytes(3000)).decode()
    yield "a" * 3000
    yield "".join(draw.choice("ab▁é😀1") for _ in range(2000))


def test_cuts_change_no_segmentation(vocabulary):
    model = sentencepiece.SentencePieceProcessor(model_file=PIECE_MODEL)
    for text in unbroken():
        got = piece_codec.encode([text], [1], vocabulary, dropout=0.0)[0].tolist()
        assert piece_codec.decode(np.array(got), vocabulary) == text
        if "▁" not in text:
            assert got == model.encode(text)


def test_unbroken_texts_have_draws_of_their_own(vocabulary):
    for text in unbroken():
        several = piece_codec.encode([text] * 3, [1, 2, 1], vocabulary, dropout=0.3)
        assert all(piece_codec.decode(p, vocabulary) == text for p in several)
        assert several[0].tolist() == several[2].tolist()
        assert several[0].tolist() != several[1].tolist() or len(set(text)) > 1000


def test_repeats_of_a_mix_are_cut_anew(spark, vocabulary):
    text = "the members of the committee were not amused by these remarkable observations " * 5
    rows = [(1, text)] * 3 + [(2, text)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    plain, numbered = ([r.pieces_sha256 for r in coded(spark, docs, n).collect()] for n in (False, True))
    assert len(set(plain)) == 2 and len(set(numbered)) == 4
    assert numbered[0] == plain[0] and numbered == [r.pieces_sha256 for r in coded(spark, docs, True).collect()]
