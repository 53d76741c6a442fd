"""What the plans must look like for the operators to scale."""

import re

import pytest
from conftest import executed_plan, final_plan
from pyspark.sql import functions as F

from accesslens.functions.periods import latest_timestamp
from accesslens.operators import geography, referrers, search, selection, statuses, traffic, visitors
from accesslens.plans import views
from accesslens.sources.readers import open_log
from accesslens.sources.writers import write_log
from contract import fixture
from contract.queries import QUERIES

SF = "/root/testdata/sf0.01"
PERIOD = ("2024-01-05", "2024-01-25")


@pytest.fixture(scope="module")
def log(production, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("log") / "requests")
    write_log(fixture.requests(production, SF, urls=True), path)
    return open_log(production, path)


def scans(plan: str) -> list[str]:
    return [line for line in plan.splitlines() if "FileScan" in line]


def test_period_prunes_partitions_columns_and_row_groups(log):
    (scan,) = scans(final_plan(traffic.traffic_per_day(log, *PERIOD)))
    assert "PartitionFilters: [isnotnull(day" in scan and "ReadSchema: struct<>" in scan
    (scan,) = scans(final_plan(statuses.status_groups(log, *PERIOD)))
    assert "PartitionFilters: [isnotnull(day" in scan
    assert "ReadSchema: struct<status_code:int>" in scan  # no timestamps
    for df in (
        visitors.visitor_counts(log, *PERIOD),
        visitors.daily_visitors(log, *PERIOD),
        referrers.daily_referrers(log, *PERIOD),
        geography.geo_cube(log),
    ):
        assert "timestamp_utc" not in scans(final_plan(df))[0]
    pushed = log.sparkSession.read.parquet(log.inputFiles()[0]).drop("day")
    (scan,) = scans(final_plan(selection.on_dates(pushed, *PERIOD)))
    assert "GreaterThanOrEqual(timestamp_utc" in scan and "LessThan(timestamp_utc" in scan


@pytest.mark.parametrize("kind", ["timestamp", "timestamp_ntz"])
def test_period_reaches_the_scan_for_both_timestamp_types(production, tmp_path, kind):
    path = str(tmp_path / kind)
    rows = production.range(10).select(
        F.timestamp_seconds(F.col("id") * 86400 + 1704067200).cast(kind).alias("timestamp_utc")
    )
    rows.write.parquet(path)
    selected = selection.on_dates(production.read.parquet(path), "2024-01-02", "2024-01-03")
    (scan,) = scans(final_plan(selected))
    assert "GreaterThanOrEqual(timestamp_utc" in scan
    assert selected.count() == 2


def files_read(df) -> list[int]:
    """Partitions read by each scan of the executed plan."""
    df.collect()
    return [int(n) for n in re.findall(r"number of partitions read: (\d+)", metrics(df))]


def metrics(df) -> str:
    found, stack = [], [df._jdf.queryExecution().executedPlan()]
    while stack:
        node = stack.pop()
        name = node.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            stack.append(node.executedPlan())
        elif name.endswith("QueryStageExec"):
            stack.append(node.plan())
        elif name == "FileSourceScanExec":
            read = node.metrics().get("numPartitions")
            if read.isDefined():
                found.append(f"number of partitions read: {read.get().value()}")
        children = node.children()
        stack.extend(children.apply(i) for i in range(children.size()))
    return "\n".join(found)


def test_trailing_window_reads_the_last_days_only(log):
    assert files_read(selection.in_last_hours(log).select("ip")) == [2]
    # the newest timestamp itself comes from one partition; the last day from no column
    newest, last_day = log.select(latest_timestamp(log).alias("t")).limit(1), log.agg(F.max("day"))
    assert "ReadSchema: struct<>" in scans(final_plan(last_day))[0]
    assert re.search(r"PartitionFilters: \[isnotnull\(day#\d+\), \(day#\d+ = Subquery", executed_plan(newest))


def test_latest_rows_read_the_last_days_only(log):
    per_day = [r.n for r in log.groupBy("day").agg(F.count("*").alias("n")).orderBy(F.desc("day")).collect()]
    for limit in (1, 200, 2000):
        needed = next(d for d in range(1, 31) if sum(per_day[:d]) >= limit)
        assert needed < 10
        assert files_read(referrers.latest_rows(log, limit=limit)) == [needed]


def test_daily_visitors_read_the_log_once_for_any_period(log):
    for period in (PERIOD, ("1990-01-01", "2050-12-31")):
        plan = executed_plan(visitors.daily_visitors(log, *period))
        assert "Window" not in plan and "SortAggregate" not in plan and "Join" not in plan
        assert len(scans(plan)) == 1 and plan.count("ReusedExchange") == 1
        assert re.search(r"Exchange hashpartitioning\(ip#\d+, user_agent#\d+, word#\d+", plan)
        assert re.search(r"keys=\[ip#\d+, user_agent#\d+\], functions=\[partial_min", plan)


def test_top_k_never_sorts_everything(log):
    for df in (
        referrers.top_referrers(log, *PERIOD),
        referrers.top_paths(log, *PERIOD),
        referrers.latest_rows(log, limit=10_000),
        search.search(log, search.search_condition(log, *PERIOD, geo="iran"), cap=1000),
        search.search_page(search.search(log, search.search_condition(log, *PERIOD, geo="iran")), 3),
        statuses.error_ips(log, *PERIOD, "4xx").drop("rank"),
        visitors.browser_distribution(visitors.environment_stats(log, *PERIOD)),
    ):
        assert "TakeOrderedAndProject" in final_plan(df)


def test_grouped_ranking_is_limited_before_the_shuffle(log):
    plan = final_plan(statuses.error_ips_by_class(log, *PERIOD))
    assert re.search(r"WindowGroupLimit .* 10, Partial", plan)


def test_visitor_counts_scan_once_without_a_join(log):
    plan = final_plan(visitors.visitor_counts(log, *PERIOD))
    assert len(scans(plan)) == 1 and "Join" not in plan
    assert plan.count("Exchange hashpartitioning") == 1


def test_requests_are_combined_before_every_shuffle(log):
    """A key holding most requests costs each task one row, not one row per request."""
    for df, partial in (
        (visitors.visitor_counts(log, *PERIOD), "partial_min"),
        (visitors.daily_visitors(log, *PERIOD), "partial_bit_or"),
        (visitors.daily_visitors(log, "2020-01-01", "2024-01-31"), "partial_bit_or"),
        (traffic.unique_users_per_day(log, *PERIOD), r"HashAggregate\(keys=\[day#\d+, ip"),
        (referrers.channel_distribution(log, *PERIOD), "partial_count"),
        (geography.geo_cube(log), "partial_count"),
        (statuses.error_ips(log, *PERIOD, "4xx"), r"HashAggregate\(keys=\[ip#\d+, geo#\d+\], functions=\[partial_count"),
        (statuses.error_ips_by_class(log, *PERIOD), r"HashAggregate\(keys=\[\w+#\d+, ip#\d+, geo#\d+\], functions=\[partial_count"),
    ):
        plan = final_plan(df)
        below_first_shuffle = plan[plan.rindex("Exchange hashpartitioning"):]
        assert re.search(partial, below_first_shuffle), below_first_shuffle


def test_geo_text_is_parsed_after_counting(log, production):
    dims = fixture.countries(production), fixture.cities(production)
    view = views.region_view(geography.geo_cube(log), *dims, "city", *PERIOD)
    plan = view._jdf.queryExecution().optimizedPlan().toString()
    at_the_scan = plan[plan.rindex("Filter"):]
    assert "geo" in at_the_scan and "regexp_replace" not in at_the_scan
    assert "regexp_replace" in plan


def test_lookups_are_broadcast_by_size_only(log, production):
    dims = fixture.countries(production), fixture.cities(production)
    cube = geography.geo_cube(log)
    assert executed_plan(views.region_view(cube, *dims, "city")).count("BroadcastHashJoin") == 2
    production.conf.set("spark.sql.autoBroadcastJoinThreshold", "1")
    production.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "1")
    try:
        plan = executed_plan(views.region_view(cube, *dims, "city"))
        assert "BroadcastHashJoin" not in plan and "SortMergeJoin" in plan
    finally:
        production.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        production.conf.unset("spark.sql.adaptive.autoBroadcastJoinThreshold")


STREAMED = {"s1_streamed_hourly_counts"}


@pytest.mark.parametrize("name", sorted(set(QUERIES) - STREAMED))
def test_no_python_no_cross_join(production, name):
    plan = final_plan(QUERIES[name](production, SF))
    for unwanted in ("Python", "ArrowEval", "MapInPandas", "CartesianProduct", "BroadcastNestedLoopJoin"):
        assert unwanted not in plan
