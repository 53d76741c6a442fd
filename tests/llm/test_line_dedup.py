import collections

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from accesslens.llm import line_dedup
from accesslens.llm.queries import ORACLE_SQL, QUERIES

BLANKS = " \t\n\v\f\r"


def key(line):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(BLANKS))


def by_hand(rows, least=3):
    """Text, lines and dropped lines of each (key, text) row; NULL keys are smallest."""
    holders = collections.defaultdict(list)
    for doc, text in rows:
        for k in {key(line) for line in (text or "").split("\n")}:
            holders[k].append(-(10**9) if doc is None else doc)
    done = []
    for doc, text in rows:
        lines, doc = (text or "").split("\n"), -(10**9) if doc is None else doc
        kept = [
            line
            for line in lines
            if len(key(line)) < 20 or len(holders[key(line)]) < least or max(holders[key(line)]) == doc
        ]
        done.append(("\n".join(kept), len(lines), len(lines) - len(kept)))
    return done


def test_query_against_sql(spark):
    sf = "/root/testdata/sf0.01"
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    ours = QUERIES["op11_line_dedup"](spark, sf)
    theirs = duck.sql(ORACLE_SQL["op11_line_dedup"])
    assert ours.columns == theirs.columns
    assert sorted(tuple(r) for r in ours.collect()) == sorted(theirs.fetchall())


@pytest.mark.parametrize("n", [0, 1, 2, 63, 5000])
def test_perfect_hash(n):
    rng = np.random.default_rng(n)
    lo, hi = (rng.integers(0, 1 << 63, n).astype(np.uint64) for _ in range(2))
    hi[: n // 2] = 5
    lo[n // 2 :] = 7  # halves repeat, keys do not
    place = line_dedup.PerfectHash.of(lo, hi)
    assert sorted(place.slots(lo, hi)) == list(range(n))
    assert len(place.bits) * 64 <= 6 * n + 640
    shard = line_dedup.Shard.of(lo.view(np.int64), hi.view(np.int64), np.arange(n), -np.arange(n))
    again = line_dedup.Shard.read(shard.row(3).to_pylist()[0])
    slots = again.found(lo.view(np.int64), hi.view(np.int64))
    assert (again.counts[slots] == np.arange(n)).all() and (again.keepers[slots] == -np.arange(n)).all()
    others = rng.integers(0, 1 << 62, 1000)
    assert (again.found(others, others) == -1).all()


def test_common_lines_nulls_and_odd_texts(spark, monkeypatch):
    often, twice = "A line that many documents share", "a line that two documents share"
    rows = [(k, f"{often.upper()}\n own line of the document {k}\n\v{often} ") for k in range(40)]
    rows += [(k, f"{twice}\nshort\n{twice}") for k in (50, 51)]
    rows += [(60, None), (61, ""), (62, "\n\n"), (None, often), (None, often), (63, "é" * 19), (64, "é" * 19), (65, "é" * 19)]
    rows += [(66, "é" * 20 + "\r"), (67, "é" * 20), (68, "\t" + "é" * 20), (68, "\t" + "é" * 20)]
    rows += [(70 + k, "\n".join([often] * 3000 + [f"line number {j:09d}" for j in range(20_000)])) for k in range(3)]
    frame = spark.createDataFrame([(d, t, 7, 8.0) for d, t in rows], "doc_id long, text string, n_lines int, gone double")
    for parts in (4, 4096):  # a common line answered in the reading task, and none
        monkeypatch.setattr(line_dedup, "COMMON_PARTS", parts)
        found = line_dedup.deduplicated(frame.repartition(3))
        assert found.columns == ["doc_id", "text", "n_lines", "gone", "n_dropped"]
        got = sorted((str(r.doc_id), r.text, r.n_lines, r.n_dropped) for r in found.collect())
        assert got == sorted((str(d), *out) for (d, _), out in zip(rows, by_hand(rows)))


def test_copies_and_empty_tables(spark, odd_rows):
    rows = odd_rows()
    assert line_dedup.deduplicated(rows).count() == rows.count()
    assert line_dedup.deduplicated(rows.where("false")).count() == 0
    copies = spark.range(500).select(F.col("id").alias("doc_id"), F.lit("the same text in all of them").alias("text"))
    found = line_dedup.deduplicated(copies)
    assert found.where("n_dropped = 0").collect()[0].doc_id == 499
    assert found.agg(F.sum("n_dropped")).first()[0] == 499


def test_counts_are_added_up_before_the_shuffle(spark):
    copies = spark.range(2000, numPartitions=2).select(
        F.col("id").alias("doc_id"), F.lit("the same text in all of them").alias("text")
    )
    counted = line_dedup.line_counts(copies)
    assert counted.select("n", "keeper").collect() == [(2000, 1999)]
