import pytest
from conftest import tuples

from accesslens.operators import search

PERIOD = ("2024-01-01", "2024-01-02")


@pytest.fixture(scope="module")
def log(make_log):
    return make_log(
        {"at": "2024-01-01 08:59:59.999999", "ip": "early"},
        {
            "at": "2024-01-01 09:00:00", "ip": "10.0.0.1", "geo": "Iran, Tehran",
            "user_os": "Linux", "status_code": 500,
        },
        {
            "at": "2024-01-01 12:00:00", "ip": "10.0.0.2", "url": "/Shop?q=100%",
            "user_browser": "Chrome", "status_code": 200,
        },
        {
            "at": "2024-01-02 17:30:59.999999", "ip": "10.0.0.3", "user_agent": "old chrome",
            "user_os": "Android", "status_code": None,
        },
        {"at": "2024-01-02 17:31:00", "ip": "late"},
    )


def found(log, sort_by=None, direction="asc", **terms):
    condition = search.search_condition(log, *PERIOD, "09:00", "17:30", **terms)
    return [r.ip[-1] for r in search.search(log, condition, sort_by, direction).collect()]


def test_time_bounds_cover_the_end_minute(log):
    assert found(log) == ["3", "2", "1"]


def test_terms(log):
    assert found(log, geo="TEHRAN") == ["1"]
    assert found(log, url="shop") == ["2"]
    assert found(log, user_agent="CHROME") == ["3", "2"]
    assert found(log, user_agent="linux") == ["1"]
    assert found(log, ip="10.0", geo="iran") == ["1"]
    assert found(log, ip="") == ["3", "2", "1"]


def test_wildcards_and_odd_characters(log):
    assert found(log, ip="10_0_0_2") == ["2"]
    assert found(log, url="q=100%") == ["2"]
    assert found(log, url="back\\slash") == []
    assert found(log, url="' OR '1'='1") == []


def test_sort(log):
    assert found(log, "ip") == ["1", "2", "3"]
    assert found(log, "ip", "desc") == ["3", "2", "1"]
    assert found(log, "status_code") == ["3", "2", "1"]  # NULL first
    assert found(log, "status_code", "desc") == ["1", "2", "3"]  # NULL last
    assert found(log, "timestamp") == ["1", "2", "3"]
    assert found(log, "user_agent") == ["3", "2", "1"]  # not sortable: newest first


def test_columns_and_display(log):
    result = search.search(log, search.search_condition(log, *PERIOD, "09:00", "17:30"))
    assert result.columns == search.RESULT_COLUMNS
    assert search.displayed(result).first().timestamp == "2024-01-02 17:30:59"


def test_cap_and_pages(make_log):
    log = make_log(*[{"at": f"2024-01-01 10:00:{s:02d}", "ip": f"{s:02d}"} for s in range(25)])
    condition = search.search_condition(log, *PERIOD)
    result = search.search(log, condition, cap=23)
    assert result.count() == 23
    first, last = search.search_page(result, 0), search.search_page(result, 2)
    assert [r.ip for r in first.collect()] == [f"{s:02d}" for s in range(24, 14, -1)]
    assert [r.ip for r in last.collect()] == ["04", "03", "02"]
    assert tuples(search.page_info(result, 2)) == [(23, 21, 23, 3)]
    assert tuples(search.search_page(result, 9)) == []
    ascending = search.search_page(result, 0, 2, "ip", "asc")
    assert [r.ip for r in ascending.collect()] == ["02", "03"]
    assert tuples(search.page_info(search.search(log, condition), 2)) == [(25, 21, 25, 3)]
    with pytest.raises(ValueError):
        search.search(log, condition, "ip", "downwards")
    empty = search.search(log, search.search_condition(log, *PERIOD, ip="none"))
    assert tuples(search.page_info(empty, 0)) == [(0, 0, 0, 0)]
