import pytest
from conftest import tuples

from accesslens.operators import statuses
from accesslens.plans.rollups import rollup

PERIOD = ("2024-01-01", "2024-01-01")


def hit(code, ip="a", hour=5, geo=None, at=None):
    return {"at": at or f"2024-01-01 {hour:02d}:00:00", "status_code": code, "ip": ip, "geo": geo}


@pytest.fixture(scope="module")
def log(make_log):
    return make_log(
        hit(200), hit(200), hit(204), hit(304), hit(404, hour=6), hit(100, hour=6), hit(None, hour=7),
        hit(600, hour=6), hit(500, at="2024-01-02 09:00:00"),
    )


def test_groups(log):
    assert tuples(statuses.status_groups(log, *PERIOD)) == [
        (None, 1), (100, 1), (200, 3), (300, 1), (400, 1), (600, 1),
    ]
    assert tuples(statuses.status_headline(log, *PERIOD)) == [(3, 1, 1, 0)]


def test_classes_and_details(log):
    codes = statuses.status_codes(log, *PERIOD)
    assert (200, 200, 2) in tuples(codes)
    classes = statuses.status_classes(codes)
    assert sorted(tuples(classes)) == [
        ("1xx", 100, 1), ("2xx", 200, 3), ("3xx", 300, 1), ("4xx", 400, 1), ("6xx", 600, 1),
    ]
    details = dict(tuples(statuses.status_details(codes)))
    assert details["2xx"] == "200: 2\n204: 1"
    shares = {r.status_class: r.percentage for r in statuses.status_shares(classes).collect()}
    assert shares["2xx"] == pytest.approx(300 / 7)
    chosen = statuses.selected_classes(classes, ["4xx", "1xx", "9xx"])
    assert [r.status_class for r in chosen.collect()] == ["1xx", "4xx"]


def test_trailing_day(log):
    assert tuples(statuses.status_codes_24h(log)) == [(500, 500, 1)]


def test_hourly_table_is_dense(log):
    hourly = statuses.hourly_statuses(log, *PERIOD)
    table = tuples(statuses.hourly_status_table(hourly))
    assert [r[0] for r in table] == list(range(24))
    assert table[5] == (5, 0, 3, 1, 0, 0)
    assert table[6] == (6, 1, 0, 0, 1, 0)
    assert table[7] == (7, 0, 0, 0, 0, 0)


def test_percentages_are_of_every_class(log):
    table = tuples(statuses.hourly_status_percent(statuses.hourly_statuses(log, *PERIOD)))
    assert table[5] == (5, 0, 75, 25, 0, 0)
    # the request with code 600 counts in the whole
    assert table[6][1:] == pytest.approx((100 / 3, 0, 0, 100 / 3, 0))
    assert table[0] == (0, 0, 0, 0, 0, 0)


def test_available_classes(log):
    found = dict(tuples(statuses.available_classes(statuses.status_groups(log, *PERIOD))))
    assert found == {"1xx": True, "2xx": True, "3xx": True, "4xx": True, "5xx": False}


def test_error_ips(make_log):
    log = make_log(
        hit(404, "b", geo="Y"), hit(499, "b", geo="X"), hit(400, "a"), hit(400, None, geo="N"),
        hit(500, "a"), hit(399, "z"), hit(503, "c"), hit(503, "c"),
    )
    assert tuples(statuses.error_ips(log, *PERIOD, "4xx")) == [
        (1, "b", 2, "X"), (2, "a", 1, None), (3, None, 1, "N"),
    ]
    assert tuples(statuses.error_ips(log, *PERIOD, "4xx", k=1)) == [(1, "b", 2, "X")]
    both = tuples(statuses.error_ips_by_class(log, *PERIOD, k=2))
    assert both == [
        ("4xx", 1, "b", 2, "X"), ("4xx", 2, "a", 1, None),
        ("5xx", 1, "c", 2, None), ("5xx", 2, "a", 1, None),
    ]


def test_rollup_stands_in_for_the_log(log):
    small = rollup(log, "status_code", grain="hour")
    for operator in (
        statuses.status_groups,
        statuses.status_headline,
        statuses.status_codes,
        statuses.hourly_statuses,
    ):
        assert sorted(tuples(operator(small, *PERIOD)), key=repr) == sorted(
            tuples(operator(log, *PERIOD)), key=repr
        )
