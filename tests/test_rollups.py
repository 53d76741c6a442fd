import pytest
from conftest import tuples

from accesslens.functions.measures import grain_of, require_grain, with_grain
from accesslens.operators import geography, referrers, selection, statuses, traffic, visitors
from accesslens.plans.rollups import rollup
from accesslens.sources.readers import open_log
from accesslens.sources.writers import write_days

PERIOD = ("2024-01-01", "2024-01-02")
DIMENSIONS = ["status_code", "ip", "user_agent", "user_is_mobile", "geo", "user_is_bot", "url_path"]

BY_HOUR = {
    "t2": lambda log: traffic.traffic_per_hour(log, *PERIOD),
    "t3": lambda log: traffic.traffic_avg_per_hour(log, *PERIOD),
    "t6": traffic.hourly_trend,
    "r4 closed hours": selection.in_closed_hours,
    "h7": lambda log: statuses.hourly_statuses(log, *PERIOD),
}
BY_TIME = {
    "r4": selection.in_last_hours,
    "h2": statuses.status_codes_24h,
    "f10": referrers.top_paths_24h,
    "g10": lambda log: geography.country_counts_24h(log, log.selectExpr("geo AS alias", "ip AS iso3", "ip AS continent")),
    "v1": visitors.first_visit_times,
    "v2": visitors.last_visit_times,
    "v4": visitors.visitor_counts_24h,
}


@pytest.fixture(scope="module")
def log(make_log):
    return make_log(
        {"at": "2024-01-01 05:10:00", "ip": "a", "status_code": 200, "geo": "France, Paris"},
        {"at": "2024-01-01 06:20:00", "ip": "a", "status_code": 404, "geo": "France, Paris"},
        {"at": "2024-01-02 05:50:00", "ip": "b", "status_code": 200, "geo": "Iran, Tehran"},
    )


@pytest.mark.parametrize("name", [*BY_HOUR, *BY_TIME])
def test_too_coarse_times_are_refused(log, name):
    operator = {**BY_HOUR, **BY_TIME}[name]
    with pytest.raises(ValueError, match="day are too coarse"):
        operator(rollup(log, *DIMENSIONS))
    by_hour = rollup(log, *DIMENSIONS, grain="hour")
    if name in BY_TIME:
        with pytest.raises(ValueError, match="hour are too coarse"):
            operator(by_hour)
    else:
        operator(by_hour).collect()
    operator(log)


def test_grain_is_stored_with_the_table(spark, log, tmp_path):
    assert grain_of(log) == "exact"
    for grain in ("hour", "day"):
        path = str(tmp_path / grain)
        write_days(rollup(log, "status_code", grain=grain), path)
        stored = open_log(spark, path)
        assert grain_of(stored) == grain_of(stored.where("hits > 0").select("hits", "day")) == grain
    stored.write.saveAsTable("rollup_by_day")
    assert grain_of(spark.table("rollup_by_day")) == "day"
    spark.sql("DROP TABLE rollup_by_day")


def test_rollups_of_rollups(log):
    by_hour = rollup(log, "status_code", grain="hour")
    assert sorted(tuples(rollup(by_hour, grain="day"))) == sorted(tuples(rollup(log, grain="day")))
    with pytest.raises(ValueError, match="day are too coarse"):
        rollup(rollup(log), grain="hour")


def test_rollups_that_do_not_tell(log):
    bare = rollup(log, grain="hour").withMetadata("hits", {})
    assert tuples(traffic.traffic_per_day(bare, *PERIOD)) == tuples(traffic.traffic_per_day(log, *PERIOD))
    with pytest.raises(ValueError, match="with_grain"):
        traffic.traffic_per_hour(bare, *PERIOD)
    told = with_grain(bare, "hour")
    assert tuples(traffic.traffic_per_hour(told, *PERIOD)) == tuples(traffic.traffic_per_hour(log, *PERIOD))
    assert require_grain(told, "day") is told
    with pytest.raises(ValueError, match="unknown grain"):
        with_grain(bare, "minute")
