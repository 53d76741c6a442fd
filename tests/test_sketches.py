import datetime as dt

import pytest
from conftest import executed_plan, tuples
from pyspark.sql import functions as F

from accesslens.operators import traffic, visitors
from accesslens.plans import rollups, sketches
from accesslens.sources.writers import write_days

PERIOD = ("2024-01-04", "2024-01-09")


@pytest.fixture(scope="module")
def many(spark):
    """300,000 requests of 60,000 addresses, more than a sketch holds, over 12 days."""
    n = F.col("id")
    day = F.date_add(F.lit("2024-01-01").cast("date"), (F.xxhash64(n) % 12 + 12).cast("int") % 12)
    ip = F.when(n % 97 != 0, (n * n % 60_013).cast("string"))
    agent = F.when(n % 89 != 0, (n % 2).cast("string"))
    rows = spark.range(300_000).select(day.alias("day"), ip.alias("ip"), agent.alias("user_agent"))
    return rows.withColumn("timestamp_utc", F.col("day").cast("timestamp_ntz"))


def near(found, exact, margin):
    assert margin > 0 and abs(found - exact) <= margin


def test_estimates_of_many(many):
    days = sketches.day_sketches(many)
    exact = dict(tuples(traffic.unique_users_per_day(many, *PERIOD)))
    for day, users, margin in tuples(sketches.users_per_day(days, *PERIOD)):
        near(users, exact[day], margin)
    users, margin = sketches.users_in(days, *PERIOD).first()
    near(users, many.where(F.col("day").between(*PERIOD)).agg(F.count_distinct("ip")).first()[0], margin)
    exact = dict(tuples(traffic.trailing_users(many, *PERIOD, 3)))
    rows = tuples(sketches.trailing_users(days, *PERIOD, 3))
    assert [r[0] for r in rows] == sorted(exact)
    for day, users, margin in rows:
        near(users, exact[day], margin)


def test_new_and_returning_visitors_of_many(many):
    found = sketches.visitor_counts(sketches.day_sketches(many), *PERIOD).first()
    exact = visitors.visitor_counts(many, *PERIOD).first()
    for name in ("total_visitors", "new_visitors", "returning_visitors"):
        near(found[name], exact[name], found.margin)
    assert exact.new_visitors > 2 * found.margin and exact.returning_visitors > 10 * found.margin


def visit(at, ip, agent="x"):
    return {"at": f"2024-01-{at} 10:00:00", "ip": ip, "user_agent": agent}


@pytest.fixture(scope="module")
def few(make_log):
    return make_log(
        visit("02", "old"), visit("04", "old"), visit("04", "new"), visit("04", "new"),
        visit("05", "twice"), visit("07", "twice"), visit("09", "last"), visit("11", "after"),
        visit("05", None), visit("05", "no agent", None), visit("04", "ab", "c"), visit("05", "a", "bc"),
    )


def test_few_are_counted_exactly(few):
    days = sketches.day_sketches(few)
    for start, end in (PERIOD, ("2024-01-01", "2024-01-31"), ("2024-01-05", "2024-01-05"), ("2024-02-01", "2024-02-02")):
        (exact,) = tuples(visitors.visitor_counts(few, start, end))
        assert tuples(sketches.visitor_counts(days, start, end)) == [(*exact, 0)]
        users = [(d, n) for d, n, _ in tuples(sketches.users_per_day(days, start, end))]
        assert users == tuples(traffic.unique_users_per_day(few, start, end))
        week = [(d, n) for d, n, _ in tuples(sketches.trailing_users(days, start, end))]
        assert week == tuples(traffic.trailing_users(few, start, end))
    assert sketches.users_in(days, "2024-02-01", "2024-02-02").first().users == 0


def test_trailing_users_by_hand(few):
    found = dict(tuples(traffic.trailing_users(few, "2024-01-05", "2024-01-11", 3)))
    D = dt.date
    # 3rd to 5th: old, new, ab, twice, no agent, a; 5th to 7th: twice, no agent, a; then last, twice; after, last
    assert found == {D(2024, 1, 5): 6, D(2024, 1, 7): 3, D(2024, 1, 9): 2, D(2024, 1, 11): 2}


def test_stored_merged_and_from_a_rollup(few, spark, tmp_path):
    path = str(tmp_path / "days")
    early, late = few.where("ip != 'twice'"), few.where("ip = 'twice' OR ip IS NULL")
    merged = sketches.merged_days(sketches.day_sketches(early), sketches.day_sketches(late))
    write_days(merged, path)
    write_days(sketches.day_sketches(few).where("day = '2024-01-04'"), path)  # a rerun of one day
    stored = spark.read.parquet(path)
    rolled = sketches.day_sketches(rollups.rollup(few, *rollups.VISITOR_DIMENSIONS))
    for days in (stored, rolled):
        assert days.agg(F.sum("hits")).first()[0] == few.count()
        (exact,) = tuples(visitors.visitor_counts(few, *PERIOD))
        assert tuples(sketches.visitor_counts(days, *PERIOD)) == [(*exact, 0)]
    plan = executed_plan(sketches.users_in(stored, *PERIOD))
    assert "PartitionFilters: [isnotnull(day" in plan and "visitors" not in plan.split("ReadSchema")[1]


def test_missing_columns_and_empty_tables(few, spark):
    with pytest.raises(ValueError, match="user_agent"):
        sketches.day_sketches(few.drop("user_agent"))
    nothing = sketches.day_sketches(few.where("false"))
    assert nothing.count() == 0 and tuples(sketches.visitor_counts(nothing, *PERIOD)) == [(0, 0, 0, 0)]
    assert tuples(traffic.trailing_users(few.where("false"), *PERIOD)) == []
