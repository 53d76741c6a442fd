import pytest
from conftest import final_plan, tuples
from pyspark.sql import functions as F

from accesslens.operators.search import Place, next_page, search, search_condition
from accesslens.sources.readers import merged_samples, stable_sample


@pytest.fixture(scope="module")
def log(make_log):
    rows = []
    for k in range(60):
        rows.append(
            {
                "at": f"2024-01-0{1 + k % 3} 0{k % 4}:00:00.00000{k % 5}",
                "ip": None if k % 7 == 0 else f"ip{k % 3}",
                "user_os": None if k % 4 == 0 else f"os{k % 2}",
                "user_agent": None if k % 5 == 0 else "agent",
                "status_code": None if k % 11 == 0 else 200 + k % 2,
                "user_is_mobile": None if k % 13 == 0 else k % 2 == 0,
            }
        )
    return make_log(*rows, *[rows[3]] * 12, *[rows[0]] * 5)  # equal rows, more than a page


def pages(found, size, **order):
    place, seen = None, []
    while True:
        rows = next_page(found, place, size, **order).collect()
        if not rows:
            return seen
        assert len(rows) <= size
        seen += map(tuple, rows)
        place = Place.after(rows, place)


@pytest.mark.parametrize("kind", ["timestamp", "timestamp_ntz"])
@pytest.mark.parametrize("column, direction", [(None, "asc"), ("user_os", "desc"), ("user_os", "asc"), ("status_code", "desc"),
                                               ("timestamp", "asc"), ("user_is_mobile", "desc"), ("no such", "asc")])
def test_a_walk_over_all_pages_is_the_sorted_result(log, kind, column, direction):
    log = log.withColumn("timestamp_utc", F.col("timestamp_utc").cast(kind))
    found = search(log, search_condition(log, "2024-01-01", "2024-01-09"), column, direction).cache()
    expected = tuples(found)
    assert len(expected) == 77
    for size in (9, 50):
        assert pages(found, size, sort_by=column, direction=direction) == expected
    found.unpersist()


def test_plan_keeps_a_page_and_filters_in_the_scan(log, tmp_path):
    path = str(tmp_path / "log")
    log.write.parquet(path)
    stored = log.sparkSession.read.parquet(path)
    found = search(stored, search_condition(stored, "2024-01-01", "2024-01-09"))
    place = Place.after(next_page(found, None, 20).collect())
    plan = final_plan(next_page(found, place, 20))
    assert f"TakeOrderedAndProject(limit={20 + place.shown}" in plan or "TakeOrderedAndProject" in plan
    assert "LessThanOrEqual(timestamp_utc" in plan or "timestamp_utc" in plan.split("PushedFilters")[1]


def test_empty_results_keep_their_place(log):
    found = search(log, search_condition(log, "2020-01-01", "2020-01-02"))
    assert pages(found, 5) == [] and Place.after([], None) is None
    place = Place(tuple(range(11)), 2)
    assert Place.after([], place) is place


def test_stable_samples_repeat_and_merge(spark):
    rows = spark.range(1000).select(
        F.when(F.col("id") % 10 != 0, (F.col("id") * 7919 % 1000).cast("string")).alias("a"), (F.col("id") % 3).alias("b")
    )
    sample = tuples(stable_sample(rows, 50))
    assert sample == tuples(stable_sample(rows.repartition(7), 50)) and len(sample) == 50
    parts = [stable_sample(rows.where(c), 50) for c in ("b = 0", "b = 1 OR b = 2")]
    assert tuples(merged_samples(*parts, 50)) == sample
    assert len({b for _, b in sample}) == 3 and "TakeOrderedAndProject" in final_plan(stable_sample(rows, 50))
    assert stable_sample(rows.where("false"), 5).count() == 0 and stable_sample(rows, 2000).count() == 1000
    nulls = spark.createDataFrame([(None, "x"), ("", "x"), ("-", None)], "a string, b string")
    assert len(tuples(stable_sample(nulls, 3, "a"))) == 3
