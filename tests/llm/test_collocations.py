import collections
import random
import re

import duckdb
import numpy as np
from pyspark.sql import functions as F

from accesslens.llm import collocations as co
from accesslens.llm.queries import ORACLE_SQL, QUERIES


def by_hand(rows, least, most, absorbed=100):
    """(lang, rank, phrase, a, l, r, n, score) of (text, lang) rows, phrase by phrase."""
    f, n = collections.Counter(), collections.Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", lower):
            words = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in range(len(words)):
                for m in range(1, 6):
                    if k + m <= len(words):
                        f[lang, tuple(words[k : k + m])] += 1
    done = []
    for lang in n:
        mine = {p: a for (x, p), a in f.items() if x == lang and len(p) > 1 and a >= least}
        found, most_around = [], collections.Counter()
        for q, b in mine.items():
            for m in range(2, len(q)):
                for k in range(len(q) - m + 1):
                    most_around[q[k : k + m]] = max(b, most_around[q[k : k + m]])
        for p, a in mine.items():
            inside = p in most_around and 100 * most_around[p] >= absorbed * a
            cuts = [(1000 * a * n[lang] // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p))]
            score, k = min(cuts)
            if not inside:
                found.append((-score, -a, " ".join(p).encode(), f[lang, p[:k]], f[lang, p[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(found)[:most], 1):
            done.append((lang, rank, phrase.decode(), -a, left, right, n[lang], -score))
    return sorted(done)


def rows_of(frame):
    return sorted(tuple(r) for r in frame.collect())


def test_query_against_sql(spark):
    sf = "/root/testdata/sf0.01"
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    ours, theirs = QUERIES["op13_collocations"](spark, sf), duck.sql(ORACLE_SQL["op13_collocations"])
    assert ours.columns == theirs.columns
    found = rows_of(ours)
    assert found == sorted(theirs.fetchall()) and len(found) > 50


def texts(seed, n=120):
    rng = random.Random(seed)
    words = ["de", "la", "LA", "maison", "été", "\x00x", "a\xa0b", "Zoë", "🙂"]
    ends = [" ", " ", " ", "  ", "\t", ". ", ",", "\n", "\v", "!?"]
    made = [
        ("".join(rng.choice(words[: rng.randint(2, 9)]) + rng.choice(ends) for _ in range(rng.randint(0, 60))), rng.choice(["fr", "en", None, ""]))
        for _ in range(n)
    ]
    return made + [(None, "fr"), (None, None), ("", "x"), (" . ", "y"), ("one", "z")] + made[:5] * 3


def test_against_brute_force(spark):
    rows = texts(1)
    frame = spark.createDataFrame([(t, g, 1, "w") for t, g in rows], "text string, lang string, n long, words string")
    for entries in (co.TRIE_ENTRIES, 40):
        for least, kept, absorbed in ((5, 1000, 100), (3, 7, 60)):
            found = co.collocations(frame.repartition(3), "text", "lang", least, kept, absorbed, entries)
            assert rows_of(found) == by_hand(rows, least, kept, absorbed)


def test_ties_go_by_bytes(spark):
    rows = [("z a", "x"), ("é b", "x"), ("b c", "x"), ("🙂 d", "x"), ("ﬀ e", "x")] * 3
    frame = spark.createDataFrame(rows, "text string, lang string")
    assert rows_of(co.collocations(frame, min_count=3, most=4)) == by_hand(rows, 3, 4)


def test_products_past_64_bits(spark):
    big = 3_000_000_007
    value = spark.range(1).select(F.lit(big).cast("decimal(19,0)").alias("a"), F.lit(10**13).cast("decimal(19,0)").alias("n"))
    up = value.select((F.lit(1000) * F.col("a") * F.col("n")).alias("up"), (F.col("a") * F.col("a")).alias("down"))
    assert up.select(F.expr("up div down")).first()[0] == 1000 * big * 10**13 // big**2


def test_trie_gives_back_what_was_added():
    rng = np.random.default_rng(3)
    trie, wanted, got = co.HatTrie(5, burst=8, most=150), collections.Counter(), collections.Counter()
    runs, depth = [], 0
    for k in range(60):
        rows = rng.integers(1, 2 + k % 7, (rng.integers(1, 60), 5)).astype(np.uint64)
        rows[rng.random(len(rows)) < 0.3, 3:] = 0
        trie.add(rows)
        wanted.update(map(tuple, rows.tolist()))
        runs += trie.spilled()
        assert trie.entries <= 150
        depth = max([depth, *(isinstance(c, co._Node) for c in trie.root.children)])
    runs += trie.rest()
    assert depth and len(trie.root.children) > 3  # both kinds of containers have burst
    for rows, counts in runs:
        keys = [tuple(row) for row in rows.tolist()]
        assert keys == sorted(set(keys))
        for key, n in zip(keys, counts.tolist()):
            got[key] += n
    assert got == wanted and trie.entries == 0


def test_no_candidate_is_filtered_out(spark):
    keys = [np.array([k, k * k + 1], ">u8").tobytes() for k in range(20_000)]
    frame = spark.createDataFrame([(bytearray(k),) for k in keys], "words binary")
    bits = co.Filter.of(frame)
    first, second = np.arange(20_000, dtype=np.uint64), np.arange(20_000, dtype=np.uint64) ** 2 + 1
    assert bits.has([first, second]).all()
    assert bits.has([first, second + np.uint64(7)]).mean() < 0.02


def test_hot_pair_and_empty_tables(spark, odd_rows):
    hot = [("of the " * 3000, "en")] * 40 + [("the of", "en"), ("of the end", "en")] * 30
    frame = spark.createDataFrame(hot, "text string, lang string").repartition(6)
    assert rows_of(co.collocations(frame, min_count=50)) == by_hand(hot, 50, 2000)
    counted = co.sorted_runs(frame, co.Filter.of(co_words(frame)), None, "text", "lang").count()
    assert counted < 60  # a row for each pair and task, not for each occurrence
    rows = odd_rows().withColumnRenamed("source", "lang")
    assert co.collocations(rows, min_count=2).count() == len(by_hand([(r.text, r.lang) for r in rows.collect()], 2, 2000))
    assert co.collocations(rows.where("false")).count() == 0


def co_words(frame):
    counted = co.word_counts(frame).where("word IS NOT NULL")
    return counted.select(F.concat(co._id_bytes("lang"), co._id_bytes("word")).alias("words"))
