import datetime as dt

import pytest
from conftest import tuples

from accesslens.operators import referrers
from accesslens.plans.rollups import rollup
from accesslens.plans.views import referrer_view

D = dt.date
PERIOD = ("2024-01-01", "2024-01-02")


def hit(at, domain, url=None, path=None):
    return {"at": at, "referrer_domain": domain, "url": url, "url_path": path}


@pytest.fixture(scope="module")
def log(make_log):
    one, two = "2024-01-01 10:00:0", "2024-01-02 10:00:0"
    return make_log(
        hit(one + "0", None, "u1", "/a"),
        hit(one + "1", "", "u1", "/a"),
        hit(one + "2", "m.facebook.com", "u2", "/b"),
        hit(one + "3", "facebook.com.google.com", "u2", "/b"),
        hit(two + "0", "www.google.com", "u3", "/"),
        hit(two + "1", "t.co", "u3", ""),
        hit(two + "2", "www.zanbil.ir", None, None),
        hit("2024-01-03 10:00:00", "bing.com", "u9", "/z"),
    )


def test_overlapping_patterns_are_subtracted_twice(log):
    # 7 requests: 2 direct, 2 social, 2 search; one domain is both, so others is 1, not 2
    assert tuples(referrers.referrer_counts(log, *PERIOD)) == [(7, 2, 2, 2, 1)]
    for channel, count in [("all", 7), ("direct", 2), ("social", 2), ("search", 2), ("others", 1)]:
        assert tuples(referrers.referrer_count(log, *PERIOD, channel)) == [(count,)]
    with pytest.raises(ValueError):
        referrers.referrer_count(log, *PERIOD, "email")


def test_distribution_counts_each_request_once(log):
    found = tuples(referrers.channel_distribution(log, *PERIOD))
    assert [(r[0], r[1]) for r in found] == [("direct", 2), ("others", 2), ("social", 2), ("search", 1)]
    assert sum(r[2] for r in found) == pytest.approx(100)


def test_daily_and_series(log):
    daily = referrers.daily_referrers(log, *PERIOD)
    assert tuples(daily) == [(D(2024, 1, 1), 2, 2, 1, -1), (D(2024, 1, 2), 0, 0, 1, 2)]
    assert referrers.channel_series(daily).count() == 8
    assert tuples(referrers.channel_series(daily, "search")) == [
        (D(2024, 1, 1), "search", 1), (D(2024, 1, 2), "search", 1),
    ]


def test_channel_filter_follows_the_top_k(log):
    assert len(tuples(referrers.top_referrers(log, *PERIOD))) == 5
    # ties in domain order: the three kept are facebook.com.google.com, m.facebook.com, t.co
    assert tuples(referrers.top_referrers(log, *PERIOD, channel="social", k=3)) == [
        ("m.facebook.com", 1, "social"), ("t.co", 1, "social"),
    ]
    assert tuples(referrers.top_referrers(log, *PERIOD, channel="social", k=1)) == []


def test_row_filter(log):
    found = referrers.filter_by_channel(log, *PERIOD, channel="direct")
    assert [r.referrer_domain for r in found.orderBy("timestamp_utc").collect()] == [
        None, "", "www.zanbil.ir",
    ]
    assert referrers.filter_by_channel(log).count() == 8


def test_paths(log, make_log):
    assert tuples(referrers.top_paths(log, *PERIOD)) == [("/a", 2), ("/b", 2)]
    assert tuples(referrers.top_paths_24h(log)) == [("/z", 1)]
    assert tuples(referrers.top_paths(log, *PERIOD, k=1)) == [("/a", 2)]


def test_latest_rows(log):
    newest = tuples(referrers.latest_rows(log, limit=2))
    assert [r[1] for r in newest] == ["bing.com", "www.zanbil.ir"]
    assert referrers.latest_rows(log, limit=None).count() == 8
    assert referrers.latest_rows(log, None, "2024-01-01", None).count() == 4
    with pytest.raises(ValueError, match="url"):
        referrers.latest_rows(log.drop("url"))


@pytest.mark.parametrize("limit", [1, 2, 4, 5, 7, 8, 9, 100])
def test_latest_rows_for_any_limit(log, limit):
    expected = tuples(referrers.latest_rows(log, limit=None))[:limit]
    assert tuples(referrers.latest_rows(log, limit=limit)) == expected
    assert tuples(referrers.latest_rows(log.drop("day"), limit=limit)) == expected


def test_rows_without_a_time_come_last(log, make_log):
    timeless = make_log(hit("2024-01-01 00:00:00", "none")).selectExpr(
        *["NULL AS timestamp_utc", "NULL AS day"],
        *[f"`{c}`" for c in log.columns if c not in ("timestamp_utc", "day")],
    )
    both = log.unionByName(timeless)
    assert tuples(referrers.latest_rows(both, limit=9))[-1][1] == "none"
    assert tuples(referrers.latest_rows(both, limit=8)) == tuples(referrers.latest_rows(log, limit=8))


def test_sample_analysis(log):
    view = {k: tuples(v) for k, v in referrer_view(referrers.latest_rows(log, *PERIOD)).items()}
    assert view["daily"] == [(D(2024, 1, 1), 2, 1, 1, 0), (D(2024, 1, 2), 1, 1, 1, 0)]
    assert view["domains"][0] == ("", "direct", 1)  # empty is a domain, NULL is not
    assert len(view["domains"]) == 6
    assert view["channels"] == [("direct", 3), ("search", 2), ("social", 2)]
    assert view["urls"] == [("u1", 2), ("u2", 2), ("u3", 2)]
    assert view["dates"] == [(D(2024, 1, 1), D(2024, 1, 2))]
    with pytest.raises(ValueError):
        referrer_view(log.drop("referrer_domain"))


def test_rollup_stands_in_for_the_log(log):
    small = rollup(log, "referrer_domain")
    for operator in (
        referrers.referrer_counts,
        referrers.daily_referrers,
        referrers.top_referrers,
        referrers.channel_distribution,
    ):
        assert tuples(operator(small, *PERIOD)) == tuples(operator(log, *PERIOD))
    empty = referrers.referrer_counts(small, "1999-01-01", "1999-01-01")
    assert tuples(empty) == [(0, 0, 0, 0, 0)]
