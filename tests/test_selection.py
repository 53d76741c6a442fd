import datetime as dt

import pytest
from conftest import moment, tuples
from pyspark.sql import functions as F

from accesslens.operators import selection
from accesslens.schema import require_columns

D = dt.date


@pytest.fixture(scope="module")
def log(make_log):
    return make_log(
        {"at": "2024-01-01 00:00:00", "ip": "a", "url_path": "/", "user_is_mobile": True, "geo": "-"},
        {"at": "2024-01-01 23:59:59.999999", "ip": "b", "url_path": "", "user_is_mobile": False, "geo": ""},
        {"at": "2024-01-02 00:00:00", "ip": "c", "url_path": None, "user_is_mobile": None, "geo": "X, Y"},
        {"at": "2024-01-03 12:00:00", "ip": "d", "url_path": "/p", "user_is_bot": True, "referrer_domain": "r"},
        {"at": "2024-01-04 12:00:00", "ip": "e", "url_path": "/q", "user_is_bot": False, "referrer_domain": ""},
    )


def ips(df):
    return "".join(sorted(r.ip for r in df.collect()))


def test_dates(log):
    assert tuples(selection.log_dates(log)) == [(D(2024, 1, d),) for d in (1, 2, 3, 4)]
    assert tuples(selection.date_range(log)) == [(D(2024, 1, 1), D(2024, 1, 4))]


def test_dates_of_an_empty_log(log):
    none = log.where("false")
    assert tuples(selection.date_range(none)) == [(None, None)]
    today = tuples(none.sparkSession.range(1).select(F.current_date()))[0][0]
    assert tuples(selection.date_range_or_default(none)) == [(D(2019, 1, 1), today)]


@pytest.mark.parametrize("select", [selection.on_days, selection.on_dates])
def test_period_bounds_are_inclusive(log, select):
    assert ips(select(log, "2024-01-01", "2024-01-02")) == "abc"
    assert ips(select(log, D(2024, 1, 2), D(2024, 1, 3))) == "cd"
    assert ips(select(log, None, "2024-01-01")) == "ab"
    assert ips(select(log, "2024-01-02", None)) == "cde"
    assert ips(select(log, None, None)) == "abcde"


def test_period_without_day_column(log):
    assert ips(selection.on_dates(log.drop("day"), "2024-01-01", "2024-01-02")) == "abc"


@pytest.mark.parametrize("kind", ["timestamp", "timestamp_ntz"])
def test_period_and_window_for_both_timestamp_types(log, kind):
    typed = log.withColumn("timestamp_utc", F.col("timestamp_utc").cast(kind))
    assert ips(selection.on_dates(typed, "2024-01-02", "2024-01-03")) == "cd"
    assert ips(selection.in_last_hours(typed)) == "de"
    assert ips(selection.in_last_hours(typed, 24, moment("2024-01-03 00:00:00"))) == "c"
    assert ips(selection.in_closed_hours(typed, 24)) == "d"


def test_trailing_window_includes_both_ends(log):
    assert ips(selection.in_last_hours(log)) == "de"
    assert ips(selection.in_last_hours(log, 23)) == "e"
    assert ips(selection.in_last_hours(log, 24, moment("2024-01-02 23:59:59"))) == "bc"
    assert ips(selection.in_last_hours(log.drop("day"))) == "de"
    assert ips(selection.in_last_hours(log.where("false"))) == ""


def test_closed_hours_leave_out_the_current_hour(make_log):
    log = make_log(
        {"at": "2024-01-02 05:30:00", "ip": "n"},
        {"at": "2024-01-02 05:00:00", "ip": "x"},
        {"at": "2024-01-02 04:59:59", "ip": "a"},
        {"at": "2024-01-01 06:00:00", "ip": "b"},
        {"at": "2024-01-01 05:59:59", "ip": "y"},
    )
    assert ips(selection.in_closed_hours(log)) == "ab"


def test_row_filters(log):
    assert ips(selection.with_known_geo(log)) == "c"
    assert ips(selection.with_rankable_path(log)) == "de"
    assert ips(selection.with_referrer(log)) == "d"


def test_device_filter_drops_unknown_devices(log):
    assert ips(selection.on_device(log)) == "abcde"
    assert ips(selection.on_device(log, "mobile")) == "a"
    assert ips(selection.on_device(log, "desktop")) == "b"
    with pytest.raises(ValueError):
        selection.on_device(log, "tablet")


def test_membership(log):
    assert ips(selection.with_values(log, "user_is_bot", [True, False])) == "de"
    assert ips(selection.with_values(log, "user_is_bot", [])) == ""


def test_nulls_and_names(log):
    assert ips(selection.without_nulls(log, "url_path", "user_is_mobile")) == "ab"
    assert selection.renamed(log.select("ip"), {"ip": "client"}).columns == ["client"]


def test_required_columns(log):
    assert require_columns(log, ["ip", "geo"]) is log
    with pytest.raises(ValueError, match="nope, none"):
        require_columns(log, ["ip", "nope", "none"])


def test_top_breaks_ties_by_key(spark):
    df = spark.createDataFrame([("b", 2), ("a", 2), ("c", 3), ("d", 1)], "k string, count long")
    assert [r.k for r in selection.top(df, 3, "count", "k").collect()] == ["c", "a", "b"]
