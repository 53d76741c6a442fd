import datetime as dt
import random
import re

import pytest
from conftest import final_plan, moment, tuples

from accesslens.operators import visitors
from accesslens.plans import rollups, views
from accesslens.plans.first_seen import (
    append_first_seen,
    first_seen_additions,
    merge_first_seen,
    save_first_seen,
)

D = dt.date


def visit(at, ip="a", agent="x", **more):
    return {"at": at, "ip": ip, "user_agent": agent, **more}


def test_three_notions_of_new(make_log):
    log = make_log(
        visit("2024-01-01 10:00:00", "old"),  # first seen before the period
        visit("2024-01-06 10:00:00", "old"),
        visit("2024-01-05 10:00:00", "back"),  # first seen in the period, back on a later day
        visit("2024-01-07 10:00:00", "back"),
        visit("2024-01-06 08:00:00", "once"),  # two requests on one day
        visit("2024-01-06 09:00:00", "once"),
    )
    period = ("2024-01-05", "2024-01-07")
    # whole history, day level: only `once` is new
    assert tuples(visitors.visitor_counts(log, *period)) == [(3, 1, 2)]
    # first date within the period: everyone is new once
    assert tuples(visitors.daily_visitors(log, *period)) == [
        (D(2024, 1, 5), 1, 1, 0), (D(2024, 1, 6), 2, 2, 0), (D(2024, 1, 7), 1, 0, 1),
    ]
    # exact timestamps: `back` in the last 24h, first seen earlier
    assert tuples(visitors.visitor_counts_24h(log)) == [(2, 0, 2)]
    single = make_log(visit("2024-01-06 08:00:00", "once"), visit("2024-01-06 08:00:00", "once"))
    assert tuples(visitors.visitor_counts_24h(single)) == [(1, 1, 0)]


def test_null_keys_count_only_where_nothing_is_matched(make_log):
    log = make_log(
        visit("2024-01-05 10:00:00", None, "x"),
        visit("2024-01-05 10:00:00", "a", None),
        visit("2024-01-05 10:00:00", "a", "x"),
    )
    period = ("2024-01-05", "2024-01-05")
    assert tuples(visitors.visitor_counts(log, *period)) == [(1, 1, 0)]
    assert tuples(visitors.visitor_counts_24h(log)) == [(1, 1, 0)]
    assert tuples(visitors.daily_visitors(log, *period)) == [(D(2024, 1, 5), 3, 3, 0)]
    assert tuples(visitors.visitor_counts_by_device(log, *period)) == [(3, 0, 0)]
    assert visitors.first_visits(log).count() == 3


@pytest.fixture(scope="module")
def devices(make_log):
    at = "2024-01-05 10:00:00"
    return make_log(
        visit(at, "a", user_is_mobile=True, user_browser="B1", user_os="O1"),
        visit(at, "a", user_is_mobile=True, user_browser="B1", user_os="O1"),
        visit(at, "b", user_is_mobile=False, user_browser="B1", user_os="O2"),
        visit(at, "c", user_is_mobile=None, user_browser=None, user_os="O2"),
        visit(at, "d", user_is_mobile=True, user_browser=None, user_os=None),
    )


DAY = ("2024-01-05", "2024-01-05")


def test_device_counts(devices):
    assert tuples(visitors.visitor_counts_by_device(devices, *DAY)) == [(4, 2, 1)]
    stats = visitors.environment_stats(devices, *DAY)
    assert sorted(tuples(stats), key=repr) == [
        ("B1", "O1", 1, 1, 0), ("B1", "O2", 1, 0, 1), (None, "O2", 1, 0, 0), (None, None, 1, 1, 0),
    ]
    assert tuples(visitors.environment_stats(devices, *DAY, "desktop")) == [("B1", "O2", 1, 0, 1)]


def test_distributions(devices):
    stats = visitors.environment_stats(devices, *DAY)
    found = tuples(visitors.device_distribution(stats))
    assert [r[:2] for r in found] == [("mobile", 2), ("desktop", 1)]
    assert found[0][2] == pytest.approx(200 / 3)
    assert tuples(visitors.browser_distribution(stats)) == [("B1", 2)]
    assert tuples(visitors.os_distribution(stats)) == [("O2", 2), ("O1", 1)]
    assert tuples(visitors.os_distribution(stats, k=1)) == [("O2", 2)]


def test_empty_period_has_no_share(devices):
    stats = visitors.environment_stats(devices, "1999-01-01", "1999-01-02")
    assert [r.share for r in visitors.device_distribution(stats).collect()] == [None, None]
    assert tuples(visitors.visitor_counts(devices, "1999-01-01", "1999-01-02")) == [(0, 0, 0)]


def test_all_distributions_in_one_pass(devices):
    found = sorted(tuples(views.environment_totals(devices, *DAY)))
    assert found == [
        ("browser", "B1", 2), ("device", "desktop", 1), ("device", "mobile", 2), ("os", "O1", 1), ("os", "O2", 2),
    ]


def random_log(make_log, seed, n=400):
    """A third of the requests belong to one visitor; some keys are missing."""
    rng = random.Random(seed)
    start = moment("2024-01-01 00:00:00")
    rows = []
    for _ in range(n):
        hot = rng.random() < 1 / 3
        at = start + dt.timedelta(minutes=15 * rng.randrange(10 * 96))
        rows.append(
            visit(
                at.strftime("%Y-%m-%d %H:%M:%S"),
                "hot" if hot else rng.choice(["a", "b", "c", "d", "e", None]) ,
                "x" if hot else rng.choice(["x", "y", "z", None]),
            )
        )
    return rows, make_log(*rows)


def brute_force(rows, start, end):
    seen = {}
    for r in rows:
        seen.setdefault((r["ip"], r["user_agent"]), []).append(dt.datetime.fromisoformat(r["at"]))
    newest = max(max(v) for v in seen.values())
    known = {k: v for k, v in seen.items() if None not in k}
    period, recent, daily = [0, 0], [0, 0], {}
    for visits in known.values():
        inside = [v.date() for v in visits if start <= v.date() <= end]
        if inside:
            period[max(inside) != min(visits).date()] += 1
        late = [v for v in visits if v >= newest - dt.timedelta(hours=24)]
        if late:
            recent[max(late) != min(visits)] += 1
    for visits in seen.values():
        dates = sorted({v.date() for v in visits if start <= v.date() <= end})
        for d in dates:
            daily.setdefault(d, [0, 0])[d != dates[0]] += 1
    return period, recent, [(d, n + o, n, o) for d, (n, o) in sorted(daily.items())]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_counts_against_brute_force(make_log, seed):
    rows, log = random_log(make_log, seed)
    start, end = D(2024, 1, 4), D(2024, 1, 8)
    (new, back), (new24, back24), daily = brute_force(rows, start, end)
    assert tuples(visitors.visitor_counts(log, start, end)) == [(new + back, new, back)]
    assert tuples(visitors.visitor_counts_24h(log)) == [(new24 + back24, new24, back24)]
    assert tuples(visitors.daily_visitors(log, start, end)) == daily

    first = visitors.first_visit_times(log)
    assert tuples(visitors.visitor_counts(log, start, end, first_seen=first)) == [(new + back, new, back)]
    assert tuples(visitors.visitor_counts_24h(log, first_seen=first)) == [(new24 + back24, new24, back24)]

    per_day = rollups.rollup(log, *rollups.VISITOR_DIMENSIONS)
    assert tuples(visitors.visitor_counts(per_day, start, end)) == [(new + back, new, back)]
    assert tuples(visitors.daily_visitors(per_day, start, end)) == daily


@pytest.mark.parametrize(
    "start, end",
    [
        ("2024-01-03", "2024-01-03"),  # one day
        ("2024-01-02", "2024-03-05"),  # 64 days: one full word
        ("2024-01-02", "2024-03-06"),  # 65 days: two words
        ("2023-11-03", "2024-01-08"),  # days in the last bits of a word
        ("2023-01-01", "2024-05-27"),  # 513 days: nine words
        ("1900-01-01", "2100-12-31"),  # two centuries
        ("2024-01-08", "2024-01-02"),  # empty
    ],
)
def test_daily_visitors_for_short_and_long_periods(make_log, start, end):
    rows, log = random_log(make_log, 5)
    far = [visit("2024-03-05 01:00:00", "hot", "x"), visit("2024-05-26 01:00:00", None, "x")]
    rows, log = rows + far, log.unionByName(make_log(*far))
    expected = brute_force(rows, D.fromisoformat(start), D.fromisoformat(end))[2]
    assert tuples(visitors.daily_visitors(log, start, end)) == expected


def test_first_seen_accepts_late_and_repeated_requests(make_log):
    _, log = random_log(make_log, 7)
    late, early = log.where("day >= '2024-01-04'"), log.where("day <= '2024-01-06'")
    merged = merge_first_seen(visitors.first_visit_times(late), early)
    whole = visitors.first_visit_times(log)
    assert sorted(tuples(merged), key=repr) == sorted(tuples(whole), key=repr)


@pytest.fixture()
def table(spark):
    name = "first_seen_test"
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield name
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    spark.sql(f"DROP TABLE IF EXISTS {name}")


def test_saved_first_seen_joins_without_moving(spark, make_log, table):
    _, log = random_log(make_log, 8)
    save_first_seen(visitors.first_visit_times(log), table, buckets=2)
    stored = spark.table(table)
    for counts, expected in (
        (
            visitors.visitor_counts(log, "2024-01-04", "2024-01-08", first_seen=stored),
            visitors.visitor_counts(log, "2024-01-04", "2024-01-08"),
        ),
        (visitors.visitor_counts_24h(log, first_seen=stored), visitors.visitor_counts_24h(log)),
    ):
        assert "SortMergeJoin" in final_plan(counts)
        assert len(re.findall(r"Exchange hashpartitioning\(ip", final_plan(counts))) == 1
        assert tuples(counts) == tuples(expected)


def test_first_seen_grows_by_additions(spark, make_log, table):
    _, log = random_log(make_log, 9)
    days = ["2024-01-06", "2024-01-02", "2024-01-09", "2024-01-02"]  # out of order, one twice
    save_first_seen(visitors.first_visit_times(log.where("day = '2024-01-04'")), table, buckets=2)
    for day in days:
        # a day's upkeep moves the day's visitors, and the few with a NULL key part
        added = first_seen_additions(spark.table(table), log.where(f"day = '{day}'"))
        stored = re.findall(r"Exchange hashpartitioning\(ip", final_plan(added))
        assert len(stored) <= 3
        append_first_seen(added, table)
        # the same day again adds nothing, whatever this session's partitions
        spark.conf.set("spark.sql.shuffle.partitions", "3")
        assert first_seen_additions(spark.table(table), log.where(f"day = '{day}'")).count() == 0
        spark.conf.set("spark.sql.shuffle.partitions", "2")
    seen = log.where(f"day IN ('2024-01-04', {', '.join(repr(d) for d in days)})")
    expected = tuples(visitors.first_visit_times(seen))
    assert sorted(tuples(visitors.settled(spark.table(table))), key=repr) == sorted(expected, key=repr)
    assert tuples(
        visitors.visitor_counts(seen, "2024-01-02", "2024-01-06", first_seen=spark.table(table))
    ) == tuples(visitors.visitor_counts(seen, "2024-01-02", "2024-01-06"))
