import random
from collections import Counter

import pytest
from conftest import executed_plan, tuples
from pyspark.sql import functions as F

from accesslens.operators import heavy, referrers
from accesslens.operators.selection import top
from accesslens.plans.rollups import rollup


def ranked(rows, k, *keys):
    weight = F.sum("hits") if "hits" in rows.columns else F.count(F.lit(1))
    return tuples(top(rows.groupBy(*keys).agg(weight.alias("count")), k, "count", *keys))


def skewed(seed, n, keys):
    rng = random.Random(seed)
    return [(None if rng.random() < 0.01 else f"k{int(rng.paretovariate(0.7)) % keys}", rng.randint(0, 2)) for _ in range(n)]


@pytest.mark.parametrize("counters", [4, 40, 100_000])
@pytest.mark.parametrize("seed", [1, 2])
def test_rankings_are_those_of_all_rows(spark, seed, counters):
    rows = spark.createDataFrame(skewed(seed, 6000, 3000), "key string, other long").repartition(5)
    for keys in (("key",), ("key", "other")):
        for k in (1, 10):
            found = heavy.heavy_rows(rows, k, *keys, counters=counters)
            assert ranked(found, k, *keys) == ranked(rows, k, *keys)


def test_only_candidates_are_left(spark):
    hot = [("hot", 1)] * 3000 + [("warm", 1)] * 1000
    rows = spark.createDataFrame(hot + [(f"rare{k}", 1) for k in range(3000)], "key string, hits long").repartition(4)
    found = heavy.heavy_rows(rows, 2, "key", counters=64)
    assert Counter(r.key for r in found.collect()) == {"hot": 3000, "warm": 1000}
    plan = executed_plan(top(found.groupBy("key").agg(F.sum("hits").alias("count")), 2, "count", "key"))
    assert "LeftSemi" in plan


def test_ties_and_flat_distributions(spark):
    flat = spark.range(900).select((F.col("id") % 300).cast("string").alias("key"))
    for counters in (2, 7, 1000):
        assert ranked(heavy.heavy_rows(flat, 10, "key", counters=counters), 10, "key") == ranked(flat, 10, "key")
    tied = spark.createDataFrame([(k,) for k in "aaabbbcccdddefgh"], "key string").repartition(3)
    assert ranked(heavy.heavy_rows(tied, 2, "key", counters=3), 2, "key") == [("a", 3), ("b", 3)]


def test_too_flat_for_counters_gives_all_rows_back(spark, monkeypatch):
    monkeypatch.setattr(heavy, "MOST_COUNTERS", 16)
    flat = spark.range(500).select(F.col("id").cast("string").alias("key"))
    assert heavy.heavy_rows(flat, 3, "key", counters=4).count() == 500


def test_few_keys_rollups_and_empty_tables(spark, make_log):
    rows = spark.createDataFrame([("a",), ("a",), (None,)], "key string")
    assert heavy.heavy_rows(rows, 5, "key").count() == 3
    assert heavy.heavy_rows(rows.where("false"), 5, "key").count() == 0
    log = make_log(*[{"at": f"2024-01-01 10:00:{s:02d}", "url_path": f"/{s % 7 % 4}"} for s in range(60)])
    small = rollup(log, "url_path")
    period = ("2024-01-01", "2024-01-01")
    for table in (log, small):
        assert tuples(referrers.top_paths(heavy.heavy_rows(table, 2, "url_path"), *period, k=2)) == tuples(
            referrers.top_paths(log, *period, k=2)
        )
