import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from accesslens.llm import token_files as t
from accesslens.llm.queries import QUERIES, WORD_TOKENIZER
from accesslens.llm.shared import table


def test_query_against_the_library(spark):
    sf = "/root/testdata/sf0.001"
    library = Tokenizer.from_file(WORD_TOKENIZER)
    start, expected = 0, []
    for row in table(spark, sf, "documents").orderBy("doc_id").collect():
        ids = np.array([*library.encode(row.text, add_special_tokens=False).ids, 2], "<u4")
        expected.append((row.doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert sorted(map(tuple, QUERIES["op6_token_files"](spark, sf).collect())) == expected


def test_chunks_encode_as_whole_texts():
    random.seed(3)
    some = "ab 'S.;\"<>\n\t ,é①漢🙂\u0301\u0338\x1c\x85 ſK9×÷²<|endoftext|>"
    texts = ["".join(random.choices(some, k=random.randint(0, 40))) for _ in range(3000)]
    texts += ["a<|endoftext|>b", " <|ENDoftext|> x", "<|startoftext|>"]
    library = Tokenizer.from_file(WORD_TOKENIZER)
    ours = t.Encoder(WORD_TOKENIZER).encode(texts)
    for text, ids, theirs in zip(texts, ours, library.encode_batch(texts, add_special_tokens=False)):
        assert ids.tolist() == theirs.ids, repr(text)


@pytest.mark.parametrize("limit", [4, 7, 16])
def test_code_lengths_are_the_best_of_their_limit(limit):
    random.seed(limit)
    for _ in range(30):
        n = random.randint(2, min(8, 1 << limit))
        counts = np.array([random.randint(1, 4) ** random.randint(1, 9) for _ in range(n)])
        lengths = t.code_lengths(counts, limit).astype(int)
        assert lengths.max() <= limit and sum(2.0**-lengths) <= 1
        assert int((lengths * counts).sum()) == _best(sorted(counts.tolist(), reverse=True), limit)


def _best(counts, limit):
    """By trying all ascending lengths."""

    def cost(k, room, least):
        if k == len(counts):
            return 0
        options = [
            counts[k] * size + cost(k + 1, room - 2.0**-size, size)
            for size in range(least, limit + 1)
            if 2.0**-size <= room
        ]
        return min(options, default=float("inf"))

    return cost(0, 1.0, 1)


def test_round_trip_of_blocks():
    random = np.random.default_rng(1)
    for n in (1, 127, 128, 129, 5000):
        ids = np.minimum(random.geometric(0.02, n), 3000).astype(np.uint32)
        code = t.Code(t.code_lengths(np.bincount(ids, minlength=3001)))
        payload, checkpoints = t.packed(ids, code.codes(), code.lengths)
        assert (t.unpacked(payload, checkpoints, n, code.table()) == ids).all()
        assert len(payload) == -(-int(code.lengths[ids].astype(int).sum()) // 8)


def test_order_and_blocks(spark, odd_rows, tmp_path, monkeypatch):
    rows = odd_rows()
    path = str(tmp_path / "files")
    t.write_token_files(rows, path, WORD_TOKENIZER, 2, rows_per_shard=2)
    files = t.token_digests(t.read_token_files(spark, path)).orderBy("start").collect()
    assert [r.doc_id for r in files] == [None, None, 1, 1, 1, 2, 3, 4, 5]
    assert [r.n_tokens for r in files if r.doc_id in (2, 3, 5)] == [1, 1, 1]
    assert all(b.start == a.start + a.n_tokens for a, b in zip(files, files[1:]))
    empty = str(tmp_path / "empty")
    t.write_token_files(rows.where("false"), empty, WORD_TOKENIZER, 2)
    assert t.read_token_files(spark, empty).count() == 0


def test_plain_words_go_to_the_library_together(monkeypatch):
    rng = random.Random(4)
    words = ["".join(rng.choices("abcdefghéüßÀÿxyzQ", k=rng.randint(2, 12))) for _ in range(6000)]
    texts = [" ".join(rng.choices(words, k=300)) + rng.choice([".", "!?", " 'tis\n", " 42x"]) for _ in range(60)]
    expected = [e.ids for e in Tokenizer.from_file(WORD_TOKENIZER).encode_batch(texts, add_special_tokens=False)]
    ours = t.Encoder(WORD_TOKENIZER)
    sent = []

    class Counted:
        def __init__(self, library):
            self.library = library

        def encode_batch_fast(self, some, **options):
            sent.extend(some)
            return self.library.encode_batch_fast(some, **options)

    for name in ("library", "words"):
        if hasattr(ours, name):
            setattr(ours, name, Counted(getattr(ours, name)))
    # small batches, and fewer remembered words than there are
    monkeypatch.setattr(t, "CACHE_CHUNKS", 3000)
    coded = [ids.tolist() for k in range(0, 60, 20) for ids in ours.encode(texts[k : k + 20])]
    assert coded == expected
    assert len(sent) < 30


def test_remembered_ids_are_bounded(monkeypatch):
    monkeypatch.setattr(t, "CACHE_IDS", 500)
    library, ours = Tokenizer.from_file(WORD_TOKENIZER), t.Encoder(WORD_TOKENIZER)
    for k in range(20):
        texts = [f"{k} word{k} {'long' * 500}{k} end.", "", "end."]
        expected = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
        assert [ids.tolist() for ids in ours.encode(texts)] == expected
        assert len(ours.pool) < 2500
    assert ours.encode([]) == []
