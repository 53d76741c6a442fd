import hashlib
import random

import pytest
import sentencepiece

from accesslens.llm import pieces
from accesslens.llm.queries import PIECE_MODEL, QUERIES
from accesslens.llm.shared import table

LIBRARY = sentencepiece.SentencePieceProcessor(model_file=PIECE_MODEL)


def test_query_against_the_library(spark):
    sf = "/root/testdata/sf0.001"
    expected = set()
    for row in table(spark, sf, "documents").collect():
        ids = LIBRARY.encode(row.text)
        digest = [hashlib.sha256(x.encode()).hexdigest() for x in (",".join(map(str, ids)), LIBRARY.decode(ids))]
        expected.add((row.doc_id, len(ids), *digest))
    assert {tuple(r) for r in QUERIES["op9_pieces"](spark, sf).collect()} == expected


@pytest.mark.parametrize("symbols", [256, 3])
def test_odd_texts(monkeypatch, symbols):
    monkeypatch.setattr(pieces, "ROUND_SYMBOLS", symbols)
    random.seed(1)
    some = "ab  ▁\n\tthe,.éñ①²漢字🙂́\x00　<s>0x"
    texts = ["".join(random.choices(some, k=random.randint(0, 40))) for _ in range(4000)]
    texts += ["".join(random.choices("theandionr", k=2000)) for _ in range(3)]
    texts += ["", " ", "▁", "  ", "a" * 3000, " " * 700, *map(chr, range(1, 3000))]
    assert pieces.Coder(PIECE_MODEL).encode(texts) == LIBRARY.encode(texts)


def test_forgetting_changes_nothing(monkeypatch):
    monkeypatch.setattr(pieces, "CACHE_WORDS", 3)
    monkeypatch.setattr(pieces, "CACHE_CHARS", 4)
    coder = pieces.Coder(PIECE_MODEL)
    for texts in (["one two three four", "five"], ["one six seven", ""], ["two two"]):
        assert coder.encode(texts) == LIBRARY.encode(texts)


def test_odd_rows(spark, odd_rows):
    rows = odd_rows()
    found = pieces.coded(rows, PIECE_MODEL).collect()
    assert len(found) == rows.count()
    assert all((r.ids, r.decoded) == ([], "") for r in found if r.doc_id in (2, 3))
    assert pieces.coded(rows.where("false"), PIECE_MODEL).count() == 0
