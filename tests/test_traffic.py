import datetime as dt

import pytest
from conftest import tuples

from accesslens.operators import traffic
from accesslens.plans.rollups import rollup

D = dt.date
PERIOD = ("2024-01-01", "2024-01-03")


@pytest.fixture(scope="module")
def log(make_log):
    return make_log(
        {"at": "2024-01-01 05:10:00", "ip": "a", "status_code": 200},
        {"at": "2024-01-01 05:20:00", "ip": "a", "status_code": 404},
        {"at": "2024-01-01 05:30:00", "ip": None, "status_code": 200},
        {"at": "2024-01-02 05:00:00", "ip": "b", "status_code": 200},
        {"at": "2024-01-02 05:01:00", "ip": "c", "status_code": 200},
        {"at": "2024-01-03 07:00:00", "ip": "c", "status_code": 500},
        {"at": "2024-01-09 09:00:00", "ip": "z", "status_code": 200},
    )


def test_per_day(log):
    expected = [(D(2024, 1, 1), 3), (D(2024, 1, 2), 2), (D(2024, 1, 3), 1)]
    assert tuples(traffic.traffic_per_day(log, *PERIOD)) == expected


def test_per_hour_has_no_empty_hours(log):
    assert tuples(traffic.traffic_per_hour(log, *PERIOD)) == [(5, 5), (7, 1)]


def test_average_ignores_days_without_the_hour_and_rounds_half_up(log):
    # hour 5: 3 and 2 requests on two of the three days -> 2.5 -> 3
    assert tuples(traffic.traffic_avg_per_hour(log, *PERIOD)) == [(5, 3), (7, 1)]


def test_unique_users_skip_null_ips(log):
    expected = [(D(2024, 1, 1), 1), (D(2024, 1, 2), 2), (D(2024, 1, 3), 1)]
    assert tuples(traffic.unique_users_per_day(log, *PERIOD)) == expected
    assert tuples(traffic.unique_users_per_day(log, *PERIOD, approx_rsd=0.01)) == expected


def test_one_pass_equals_the_join(log):
    left = traffic.traffic_per_day(log, *PERIOD)
    joined = left.join(traffic.unique_users_per_day(log, *PERIOD), "day", "left").orderBy("day")
    assert tuples(traffic.traffic_and_users_per_day(log, *PERIOD)) == tuples(joined)
    assert traffic.traffic_and_users_long(log, *PERIOD).count() == 6


def test_trend_lists_closed_hours_only(make_log):
    log = make_log(
        {"at": "2024-01-02 05:30:00"},
        {"at": "2024-01-02 04:10:00"},
        {"at": "2024-01-02 04:20:00"},
        {"at": "2024-01-01 06:00:00"},
        {"at": "2024-01-01 05:00:00"},
    )
    expected = [("2024-01-01 06:00", 1), ("2024-01-02 04:00", 2)]
    assert tuples(traffic.hourly_trend(log)) == expected


def test_series(log):
    found = tuples(traffic.hourly_series(log, "2024-01-01", "2024-01-02"))
    assert found == [(dt.datetime(2024, 1, 1, 5), 3), (dt.datetime(2024, 1, 2, 5), 2)]


@pytest.mark.parametrize(
    "operator",
    [
        lambda log: traffic.traffic_per_day(log, *PERIOD),
        lambda log: traffic.traffic_per_hour(log, *PERIOD),
        lambda log: traffic.traffic_avg_per_hour(log, *PERIOD),
        traffic.hourly_trend,
    ],
)
def test_rollup_stands_in_for_the_log(log, operator):
    assert tuples(operator(rollup(log, "status_code", grain="hour"))) == tuples(operator(log))


def test_unknown_grain(log):
    with pytest.raises(ValueError):
        rollup(log, grain="minute")
