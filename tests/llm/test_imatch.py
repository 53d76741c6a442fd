import collections
import hashlib
import re

import numpy as np
import xxhash

from accesslens.llm import imatch
from accesslens.llm.queries import QUERIES
from accesslens.llm.shared import table


M = (1 << 64) - 1


def terms_of(text):
    return {xxhash.xxh3_64_intdigest(t.encode()) for t in re.findall(r"[^\W_]+", text.lower())}


def band_of(texts):
    """Terms of 0.05 to 5 percent of the texts, and of two at least, counted one by one."""
    counted = collections.Counter(t for text in texts for t in terms_of(text))
    return {t for t, n in counted.items() if max(2, 0.0005 * len(texts)) <= n <= max(2, 0.05 * len(texts))}


def printed(text, band):
    """36 subsets of six densities, and a place for texts without any term of the band."""
    parts, chosen = [], terms_of(text) & band
    for k in range(36):
        seed = xxhash.xxh3_64_intdigest(f"subset {k}")
        some = []
        for t in sorted(chosen):
            h = (t ^ seed) * 0x9E3779B97F4A7C15 & M
            h = (h ^ h >> 32) * 0xD6E8FEB86659FD93 & M
            if h < 2 ** (60 - k // 6):
                some.append(t.to_bytes(8, "little"))
        parts.append(xxhash.xxh3_64_hexdigest(b"".join(some))[:6] if some else "000000")
    strange = [t.to_bytes(8, "little") for t in sorted(terms_of(text))] if not chosen else []
    return parts + [xxhash.xxh3_64_hexdigest(b"".join(strange))[:6] if strange else "000000"]


def alike(a, b):
    used = [(x, y) for x, y in zip(a, b) if (x, y) != ("000000", "000000")]
    return 1.0 if a == b else sum(x == y for x, y in used) / len(used)


def test_query_against_plain_loops(spark):
    sf = "/root/testdata/sf0.001"
    docs = table(spark, sf, "documents")
    texts = [r.text for r in docs.orderBy("doc_id", ascending=False).collect()]
    rows = QUERIES["op8_imatch"](spark, sf).orderBy("doc_id", ascending=False).collect()
    band = band_of(texts)
    assert len(rows) == len(texts)
    for k, (text, row) in enumerate(zip(texts, rows)):
        after = texts[(k + 1) % len(texts)]
        edited = text[: len(text) - len(text) // 3] + after[: len(text) // 3]
        prints = [printed(t, band) for t in (text, edited, after)]
        assert row.n_chars == len(text) and row.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert (row.fingerprint, row.edited_fingerprint) == ("".join(prints[0]), "".join(prints[1]))
        assert row.near_edited == alike(*prints[:2]) and row.near_next == alike(*prints[::2])
    assert sum(r.near_edited > r.near_next for r in rows) > 0.9 * len(rows)


def test_few_lexicon_terms_are_still_what_counts():
    """A text keeps its likeness when one of eight, or of two, lexicon terms goes."""
    hashed = {w: xxhash.xxh3_64_intdigest(w.encode()) for w in (f"known{k}" for k in range(8))}
    printer = imatch.Fingerprinter(imatch.Lexicon(np.sort(np.array(list(hashed.values()), np.uint64))))
    other = " ".join(f"strange{k}" for k in range(200))
    for n in (8, 2):
        words = list(hashed)[:n]
        whole, less = (printer.of(" ".join(w) + " " + other) for w in (words, words[1:]))
        assert whole == printer.of(" ".join(words)) and whole[-1] == "000000"
        assert whole[:-1] == printed(" ".join(words), set(hashed.values()))[:-1]
    first, second = printer.of("strange things"), printer.of("other things")
    assert imatch.likeness(first, second) == 0.0 and first[-1] != "000000" == first[0]
    assert imatch.likeness(printer.of(""), printer.of(" . ")) == 1.0


def test_document_frequencies(spark):
    docs = spark.createDataFrame([(1, "a b b"), (2, "A c"), (3, None)], "id long, text string").fillna("")
    counted = {r.term: r.n for r in imatch.document_frequencies(docs.repartition(2)).collect()}
    assert sorted(counted.values()) == [1, 1, 2]


def test_many_shards_agree_with_one(spark):
    docs = table(spark, "/root/testdata/sf0.001", "documents")
    lexicon = imatch.Lexicon.of(docs, "doc_id", "text", 0.01, 0.2)
    one, many = (imatch.edit_likeness(docs, lexicon, rows_per_shard=n) for n in (10_000, 7))
    assert sorted(one.collect()) == sorted(many.collect())


def test_odd_rows(spark, odd_rows):
    rows = odd_rows()
    lexicon = imatch.Lexicon.of(rows, "doc_id", "text", 0.0, 1.0)
    for size in (2, 100):
        found = imatch.edit_likeness(rows, lexicon, rows_per_shard=size)
        assert found.count() == rows.count()
        same = {r.fingerprint for r in found.where("n_chars in (0, 4)").collect()}
        assert len(same) == 1  # texts without terms
    prints = [r.fingerprint for r in imatch.fingerprints(rows, lexicon).where("doc_id = 1").collect()]
    assert len(set(prints)) == 2
    single = rows.where("doc_id = 4")
    assert imatch.edit_likeness(single, lexicon).first().near_next == 1.0
    assert imatch.edit_likeness(rows.where("false"), lexicon).count() == 0
    assert len(imatch.Lexicon.of(rows.where("false"), "doc_id", "text", 0.0, 1.0).terms) == 0
