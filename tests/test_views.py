"""The trailing-day view: each part equals its operator, with and without a known anchor."""

import pytest
from conftest import moment, tuples

from accesslens.plans.views import last_day_view
from contract import fixture


@pytest.fixture(scope="module")
def log(make_log):
    row = {"user_agent": "x", "geo": "France, Paris", "url_path": "/p"}
    return make_log(
        {"at": "2024-01-01 09:00:00", "ip": "a", "status_code": 500, **row},
        {"at": "2024-01-02 08:30:00", "ip": "a", "status_code": 200, **row},
        {"at": "2024-01-02 10:10:00", "ip": "b", "status_code": 404, **row},
        {"at": "2024-01-02 10:30:00", "ip": "b", "status_code": 404, **row},
        {"at": "2024-01-02 11:00:00", "ip": "c", "status_code": 200, **row},
    )


@pytest.mark.parametrize("anchor", [None, moment("2024-01-02 11:00:00")])
def test_last_day(log, spark, anchor):
    view = {k: tuples(v) for k, v in last_day_view(log, fixture.countries(spark), anchor).items()}
    assert view["visitors"] == [(3, 1, 2)]
    assert view["countries"] == [("France", 4, "FRA")]
    assert sorted(view["statuses"]) == [
        ("2xx", 200, 2, 50.0, 1.0), ("4xx", 400, 2, 50.0, 1.0),
    ]
    assert view["trend"] == [("2024-01-02 08:00", 1), ("2024-01-02 10:00", 2)]
    assert view["pages"] == [("/p", 4)]
