"""One query per operator, over the request table derived from the given tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import partial, reduce
from operator import and_

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from accesslens.functions.channels import channel_by_like, channel_by_list
from accesslens.functions.periods import latest_timestamp
from accesslens.operators import geography, heavy, referrers, search, selection, statuses, traffic, visitors
from accesslens.plans import first_seen, rollups, sketches, text_index, views
from accesslens.schema import require_columns
from accesslens.session import shared_folder
from accesslens.sources import readers, writers
from accesslens.sources.countries import country_table
from accesslens.streaming.first_visits import streamed_first_visits, write_first_visits
from accesslens.streaming.hourly import upserted_hours, write_hourly_counts, write_hourly_upserts
from contract import fixture

START, END = "2024-01-05", "2024-01-25"
SPLIT = "2024-01-15"
ROW = ["timestamp_utc", "ip", "user_agent"]

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def _register(name: str, run: Query) -> None:
    if name in QUERIES:
        raise ValueError(f"query registered twice: {name}")
    QUERIES[name] = run


def on_log(name: str, operator: Callable[[DataFrame], DataFrame], urls: bool = False) -> None:
    """Register an operator that takes the request table only."""
    _register(name, lambda spark, sf: operator(fixture.requests(spark, sf, urls)))


def on_period(name: str, operator: Callable[..., DataFrame], urls: bool = False, **kw) -> None:
    """Register an operator that takes the request table and a period."""
    on_log(name, lambda log: operator(log, START, END, **kw), urls)


def query(name: str) -> Callable[[Query], Query]:
    def add(run: Query) -> Query:
        _register(name, run)
        return run

    return add


# -- sources and sinks -------------------------------------------------------

DAILY_SQL = """
SELECT day, count(*) AS traffic_sum FROM {log}
WHERE day BETWEEN :start AND :end GROUP BY day ORDER BY day
"""


@query("a1_run_sql")
def _(spark, sf):
    args = {"start": START, "end": END}
    return readers.run_sql(spark, DAILY_SQL, args, log=fixture.requests(spark, sf))


def _new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


@query("a2_sample_rows")
def _(spark, sf):
    """Any 1,000 rows: how many came, and how many of them the table has."""
    log = fixture.requests(spark, sf, urls=True).select("timestamp_utc", "ip", "url")
    same = [F.col(f"s.{c}").eqNullSafe(F.col(f"t.{c}")) for c in log.columns]
    # the sample differs from run to run, so it is taken once
    path = _new_folder(spark, "sample")
    readers.sample_rows(log, 1000).write.parquet(path)
    sample = spark.read.parquet(path)
    known = sample.alias("s").join(log.alias("t"), same, "left_semi")
    counted = sample.select(F.lit(False).alias("known")).union(known.select(F.lit(True)))
    return counted.agg(F.count_if(~F.col("known")).alias("n_rows"), F.count_if("known").alias("n_known"))


SAMPLED = ["timestamp_utc", "ip", "user_agent", "status_code"]


def sample_by_days(log: DataFrame) -> DataFrame:
    """A sample of 500 requests, merged from those of two parts of the log."""
    parts = [selection.on_dates(log, None, SPLIT), log.where(F.col("day") > SPLIT)]
    micros = F.unix_micros(F.col("timestamp_utc").cast("timestamp"))
    parts = [p.withColumn("micros", micros).select("micros", *SAMPLED) for p in parts]
    keys = ["micros", *SAMPLED[1:]]
    samples = [readers.stable_sample(p, 500, *keys) for p in parts]
    return readers.merged_samples(*samples, 500, *keys).drop("micros")


on_log("a2_stable_sample", sample_by_days)


@query("a3_open_table")
def _(spark, sf):
    fixture.events_table(spark, sf).createOrReplaceTempView("accesslens_events")
    log = fixture.request_log(readers.open_log(spark, "accesslens_events"))
    return log.groupBy("http_method").agg(F.count(F.lit(1)).alias("count"))


on_log("a4_full_scan", lambda log: log, urls=True)


@query("a5_read_cities")
def _(spark, sf):
    """A city file made of the places in the log, read back by column name."""
    cube = geography.geo_cube(fixture.requests(spark, sf))
    places = selection.without_nulls(cube, "city").groupBy("city", "country").agg(
        F.sum("count").alias("population"),
        (F.countDistinct("day") * 1.5).alias("lat"),
        (F.countDistinct("day") * -2.5).alias("lng"),
    )
    path = _new_folder(spark, "cities")
    places.select("lng", "city", "population", "lat", "country").write.csv(path, header=True)
    return readers.read_cities(spark, path)


on_log("a6_latest_rows", partial(referrers.latest_rows, limit=10_000), urls=True)
on_log("a6_latest_rows_period", lambda log: referrers.latest_rows(log, START, END, None), urls=True)
on_log("a7_export_records", lambda log: writers.as_records(traffic.traffic_per_day(log, START, END)))
on_log("a7_export_records_nulls", lambda log: writers.as_records(log.select("ip", "user_os", "status_code")))


@query("a7_written_log")
def _(spark, sf):
    """The whole log written by day, then read for a period."""
    path = _new_folder(spark, "log")
    writers.write_log(fixture.requests(spark, sf, urls=True), path)
    return selection.on_dates(readers.open_log(spark, path), START, END)


# -- date discovery, filters, projections -------------------------------------

on_log("r1_log_dates", selection.log_dates)
on_log("r1_default_dates", selection.date_range_or_default)




on_log("r2_date_range", selection.date_range)
on_period("r3_day_filter", lambda log, a, b: selection.on_days(log, a, b).select(*ROW, "day"))
on_period("r3b_date_filter", lambda log, a, b: selection.on_dates(log, a, b).select(ROW))
on_period(
    "r3b_timestamp_filter",
    lambda log, a, b: selection.on_dates(log.drop("day"), a, b).select(ROW),
)
on_log("r3c_open_start", lambda log: selection.on_dates(log.drop("day"), None, END).select(ROW))
on_log("r3c_open_end", lambda log: selection.on_dates(log.drop("day"), START, None).select(ROW))
on_log("r4_last_24h", lambda log: selection.in_last_hours(log).select(ROW))
on_log("r5_known_geo", lambda log: selection.with_known_geo(log).select(*ROW, "geo"))
on_log(
    "r6_rankable_paths",
    lambda log: selection.with_rankable_path(log).select(*ROW, "url_path"),
    urls=True,
)
on_log("r7_with_referrer", lambda log: selection.with_referrer(log).select(*ROW, "referrer_domain"))
for _device in ("all", "mobile", "desktop"):
    on_log(
        f"r8_device_{_device}",
        lambda log, device=_device: selection.on_device(log, device).select(*ROW, "user_is_mobile"),
    )
on_log(
    "r9_bot_membership",
    lambda log: selection.with_values(log, "user_is_bot", [True]).select(*ROW, "user_is_bot"),
)
on_log("r10_drop_null_keys", lambda log: selection.without_nulls(log, "ip", "user_os").select(*ROW, "user_os"))
on_log(
    "r11_required_columns",
    lambda log: require_columns(log, referrers.REFERRER_COLUMNS).select(*referrers.REFERRER_COLUMNS),
    urls=True,
)
on_period(
    "r12_renamed",
    lambda log, a, b: selection.renamed(
        traffic.traffic_and_users_per_day(log, a, b), {"traffic_sum": "requests", "users": "visitors"}
    ),
)

# -- traffic -------------------------------------------------------------------

on_period("t1_traffic_per_day", traffic.traffic_per_day)
on_period("t2_traffic_per_hour", traffic.traffic_per_hour)
on_period("t3_traffic_avg_per_hour", traffic.traffic_avg_per_hour)
on_period("t4_unique_users_per_day", traffic.unique_users_per_day)
on_period("t4_trailing_users", traffic.trailing_users)
on_period("t5_traffic_and_users", traffic.traffic_and_users_per_day)
on_period("t5_traffic_and_users_long", traffic.traffic_and_users_long)
on_log("t6_hourly_trend", traffic.hourly_trend)
on_period("t7_hourly_series", traffic.hourly_series)


def traffic_rollup(log: DataFrame) -> DataFrame:
    return rollups.rollup(log, *rollups.TRAFFIC_DIMENSIONS, grain="hour")


on_log("t1_from_rollup", lambda log: traffic.traffic_per_day(traffic_rollup(log), START, END))
on_log("t3_from_rollup", lambda log: traffic.traffic_avg_per_hour(traffic_rollup(log), START, END))
on_log("t6_from_rollup", lambda log: traffic.hourly_trend(traffic_rollup(log)))

# -- visitors --------------------------------------------------------------------



def stored_sketches(spark: SparkSession, log: DataFrame) -> DataFrame:
    """Day sketches, written by day and read again."""
    path = _new_folder(spark, "sketches")
    writers.write_days(sketches.day_sketches(log), path)
    return spark.read.parquet(path)


def bounded(exact: DataFrame, estimated: DataFrame, key: str | None = None) -> DataFrame:
    """The exact counts, and whether each estimate is within its margin of them; without a key, of one row."""
    counts = [c for c in exact.columns if c != key]
    if key:
        told = estimated.select(key, *(F.col(c).alias(f"near_{c}") for c in [*counts, "margin"]))
        rows, near = exact.join(told, key), {c: F.col(f"near_{c}") for c in [*counts, "margin"]}
    else:
        rows, near = exact, {c: estimated.select(c).scalar() for c in [*counts, "margin"]}
    within = [F.abs(F.col(c) - near[c]) <= near["margin"] for c in counts]
    return rows.select(*exact.columns, reduce(and_, within).alias("within_margin"))


@query("t4_users_from_sketches")
def _(spark, sf):
    log = fixture.requests(spark, sf)
    per_day = sketches.users_per_day(stored_sketches(spark, log), START, END)
    return bounded(traffic.unique_users_per_day(log, START, END), per_day, "day")


@query("t4_trailing_users_from_sketches")
def _(spark, sf):
    log = fixture.requests(spark, sf)
    weeks = sketches.trailing_users(stored_sketches(spark, log), START, END, 7)
    return bounded(traffic.trailing_users(log, START, END, 7), weeks, "day")


@query("v3_from_sketches")
def _(spark, sf):
    log = fixture.requests(spark, sf)
    counts = sketches.visitor_counts(stored_sketches(spark, log), START, END)
    return bounded(visitors.visitor_counts(log, START, END), counts)


on_log("v1_first_visits", visitors.first_visits)
on_log("v1_first_visit_times", visitors.first_visit_times)
on_period("v2_last_visits", visitors.last_visits)
on_log("v2_last_visit_times_24h", visitors.last_visit_times)
on_period("v3_visitor_counts", visitors.visitor_counts)
on_log("v4_visitor_counts_24h", visitors.visitor_counts_24h)
on_period("v5_visitors_by_device", visitors.visitor_counts_by_device)
on_period("v6_daily_visitors", visitors.daily_visitors)


def spread_out(log: DataFrame) -> DataFrame:
    """The log with its days dealt over 600: twenty for each, by the minute of the request."""
    apart = F.date_diff("day", F.lit("2024-01-01")) * 20 + F.minute("timestamp_utc") % 20
    return log.withColumn("day", F.date_add(F.lit("2022-09-01").cast("date"), apart))


on_log("v6_daily_visitors_600_days", lambda log: visitors.daily_visitors(spread_out(log), "2022-09-11", "2024-05-02"))
for _device in ("all", "mobile", "desktop"):
    on_period(f"v7_environment_{_device}", visitors.environment_stats, device=_device)


def on_environment(name: str, operator: Callable[[DataFrame], DataFrame]) -> None:
    on_period(name, lambda log, a, b: operator(visitors.environment_stats(log, a, b)))


on_environment("v8_device_distribution", visitors.device_distribution)
on_environment("v9_browser_distribution", visitors.browser_distribution)
on_environment("v10_os_distribution", visitors.os_distribution)
on_period("v8_v9_v10_in_one_pass", views.environment_totals)


def merged_first_seen(log: DataFrame) -> DataFrame:
    """First visits built from the days up to a split, then brought up to date."""
    old = visitors.first_visit_times(selection.on_dates(log, None, SPLIT))
    return first_seen.merge_first_seen(old, selection.on_dates(log, SPLIT, None))


on_log("v1_first_seen_merged", merged_first_seen)


def added_first_seen(log: DataFrame) -> DataFrame:
    """The same table grown by additions: a visitor may have several rows."""
    old = visitors.first_visit_times(selection.on_dates(log, SPLIT, None))
    added = first_seen.first_seen_additions(old, selection.on_dates(log, None, SPLIT))
    return old.unionByName(added)


def stale_first_seen(log: DataFrame, before) -> DataFrame:
    """A table that ends inside the span that is asked for, for lack of later upkeep."""
    return visitors.first_visit_times(log.where(F.col("timestamp_utc") < before))


on_log("v1_first_seen_added", lambda log: visitors.settled(added_first_seen(log)))
on_log(
    "v3_from_first_seen",
    lambda log: visitors.visitor_counts(log, START, END, first_seen=merged_first_seen(log)),
)
on_log(
    "v3_from_stale_first_seen",
    lambda log: visitors.visitor_counts(
        log, START, END, first_seen=stale_first_seen(log, F.lit("2024-01-19").cast("timestamp_ntz"))
    ),
)
on_log(
    "v4_from_stale_first_seen",
    lambda log: visitors.visitor_counts_24h(
        log, first_seen=stale_first_seen(log, latest_timestamp(log) - F.expr("INTERVAL 12 HOURS"))
    ),
)
on_log(
    "v4_from_first_seen",
    lambda log: visitors.visitor_counts_24h(log, first_seen=added_first_seen(log)),
)

# -- referrers ---------------------------------------------------------------------


@query("f1_channel_by_list")
def _(spark, sf):
    domain = F.col("referrer_domain")
    counted = fixture.requests(spark, sf).groupBy(domain).agg(F.count(F.lit(1)).alias("count"))
    return counted.select(domain, channel_by_list(domain).alias("channel"), "count")


@query("f1_channel_by_list_exact")
def _(spark, sf):
    domain = F.col("referrer_domain")
    counted = fixture.requests(spark, sf).groupBy(domain).agg(F.count(F.lit(1)).alias("count"))
    return counted.select(domain, channel_by_list(domain, mode="exact").alias("channel"), "count")


@query("f2_channel_by_like")
def _(spark, sf):
    domain = F.col("referrer_domain")
    counted = fixture.requests(spark, sf).groupBy(domain).agg(F.count(F.lit(1)).alias("count"))
    return counted.select(domain, channel_by_like(domain).alias("channel"), "count")


on_period(
    "f3_filter_by_channel",
    lambda log, a, b: referrers.filter_by_channel(log, a, b, "social").select(
        *ROW, "referrer_domain", "channel"
    ),
)
on_log(
    "f3_filter_all_channels",
    lambda log: referrers.filter_by_channel(log).select(*ROW, "referrer_domain", "channel"),
)
on_period("f4_referrer_counts", referrers.referrer_counts)
on_period("f4_referrer_count_others", referrers.referrer_count, channel="others")
on_period("f5_daily_referrers", referrers.daily_referrers)
on_period("f6_channel_series", lambda log, a, b: referrers.channel_series(referrers.daily_referrers(log, a, b)))
on_period(
    "f6_channel_series_search",
    lambda log, a, b: referrers.channel_series(referrers.daily_referrers(log, a, b), "search"),
)
on_period("f7_top_referrers", referrers.top_referrers)
on_period("f7_top_referrers_social", referrers.top_referrers, channel="social")
on_period("f8_channel_distribution", referrers.channel_distribution)
on_log(
    "f8_from_rollup",
    lambda log: referrers.channel_distribution(
        rollups.rollup(log, *rollups.REFERRER_DIMENSIONS), START, END
    ),
)
on_period("f9_top_paths", referrers.top_paths, urls=True)
on_log(
    "f9_top_paths_by_candidates",
    lambda log: referrers.top_paths(
        heavy.heavy_rows(selection.with_rankable_path(selection.on_dates(log, START, END)), 10, "url_path"), START, END
    ),
    urls=True,
)
on_log("f10_top_paths_24h", referrers.top_paths_24h, urls=True)


def on_latest(name: str, operator: Callable[[DataFrame], DataFrame]) -> None:
    """Register a result over all referrers; none of the five needs their order."""
    on_log(name, lambda log: operator(log.select(*referrers.REFERRER_COLUMNS)), urls=True)


on_latest("f11_daily_channel_pivot", referrers.daily_channel_pivot)
on_latest("f12_top_domains", referrers.top_domains)
on_latest("f13_channel_totals", referrers.channel_totals)
on_latest("f14_top_urls", referrers.top_urls)
on_latest(
    "f14_top_urls_by_candidates",
    lambda rows: referrers.top_urls(heavy.heavy_rows(selection.without_nulls(rows, "url"), 10, "url")),
)
on_latest("f15_sample_date_range", referrers.sample_date_range)

# -- geography ------------------------------------------------------------------------


@query("g1_parsed_geo")
def _(spark, sf):
    parsed = geography.parsed_geo(selection.with_known_geo(fixture.requests(spark, sf)))
    return parsed.select("timestamp_utc", "geo", "country", "city")


on_log("g2_geo_cube", geography.ordered_geo_cube)


def _country_info(column: str) -> Query:
    def run(spark, sf):
        cube = geography.geo_cube(fixture.requests(spark, sf))
        named = cube.groupBy("country").agg(F.sum("count").alias("count"))
        info = geography.with_country_info(named, fixture.countries(spark))
        return info.select("country", column, "count")

    return run


_register("g3_country_iso3", _country_info("iso_alpha"))
_register("g4_country_continent", _country_info("continent"))


@query("r2_cube_date_range")
def _(spark, sf):
    cube = geography.geo_cube(fixture.requests(spark, sf))
    return geography.cube_date_range(geography.located(cube, fixture.countries(spark)))


@query("g5_cube_slice")
def _(spark, sf):
    cube = geography.geo_cube(fixture.requests(spark, sf))
    return geography.cube_slice(cube, START, END, [False])


def on_cube(name: str, operator: Callable[[DataFrame], DataFrame]) -> None:
    """Register a view of the located cube, sliced to the period and to both kinds of user."""

    def run(spark, sf):
        cube = geography.geo_cube(fixture.requests(spark, sf))
        sliced = geography.cube_slice(cube, START, END, [True, False])
        return operator(geography.located(sliced, fixture.countries(spark)))

    _register(name, run)


on_cube("g6_country_counts", geography.country_counts)
on_cube("g7_continent_counts", geography.continent_counts)
on_cube("g7_continent_totals", geography.continent_totals)
on_cube("g8_city_counts", geography.city_counts)


def _region(level: str) -> Query:
    def run(spark, sf):
        return views.region_view(
            geography.geo_cube(fixture.requests(spark, sf)),
            fixture.countries(spark),
            fixture.cities(spark),
            level,
            START,
            END,
        )

    return run


_register("g9_city_geocode", _region("city"))


@query("g9_city_geocode_by_country")
def _(spark, sf):
    cube = geography.located(
        geography.geo_cube(fixture.requests(spark, sf)), fixture.countries(spark)
    )
    counts = selection.without_nulls(cube, "city").groupBy("city", "country")
    counted = counts.agg(F.sum("count").alias("count"))
    return geography.geocoded(counted, fixture.cities(spark), match_country=True)


@query("g9_city_geocode_by_code")
def _(spark, sf):
    """Country names of the log against those of the city file, both by the shipped table."""
    cube = geography.geo_cube(fixture.requests(spark, sf))
    counts = selection.without_nulls(cube, "city").groupBy("city", "country")
    counted = counts.agg(F.sum("count").alias("count"))
    return geography.geocoded(counted, fixture.cities(spark), True, country_table(spark))


def shipped_countries(log: DataFrame) -> DataFrame:
    """The period's requests of countries that the table derived from locale data knows."""
    sliced = geography.cube_slice(geography.geo_cube(log), START, END, [True, False])
    return geography.located(sliced, country_table(log.sparkSession))


on_log("g3_shipped_countries", lambda log: geography.country_counts(shipped_countries(log)))
on_log("g4_shipped_continents", lambda log: geography.continent_totals(shipped_countries(log)))


@query("g10_country_counts_24h")
def _(spark, sf):
    return geography.country_counts_24h(fixture.requests(spark, sf), fixture.countries(spark))


# -- statuses ----------------------------------------------------------------------------

on_period("h1_status_groups", statuses.status_groups)
on_period("h1_status_headline", statuses.status_headline)
on_period("h2_status_codes", statuses.status_codes)
on_log("h2_status_codes_24h", statuses.status_codes_24h)


def on_codes(name: str, operator: Callable[[DataFrame], DataFrame]) -> None:
    on_period(name, lambda log, a, b: operator(statuses.status_codes(log, a, b)))


on_codes("h3_status_classes", statuses.status_classes)
on_codes("h4_status_details", statuses.status_details)
on_codes("h5_status_shares", lambda codes: statuses.status_shares(statuses.status_classes(codes)))
on_codes("h6_status_log_values", lambda codes: statuses.status_log_values(statuses.status_classes(codes)))
on_log(
    "h6_status_log_values_24h",
    lambda log: statuses.status_log_values(statuses.status_classes(statuses.status_codes_24h(log))),
)
on_period("h7_hourly_statuses", statuses.hourly_statuses)
on_period(
    "h8_hourly_status_table",
    lambda log, a, b: statuses.hourly_status_table(statuses.hourly_statuses(log, a, b)),
)
on_period(
    "h9_hourly_status_percent",
    lambda log, a, b: statuses.hourly_status_percent(statuses.hourly_statuses(log, a, b)),
)
on_codes(
    "h10_selected_classes",
    lambda codes: statuses.selected_classes(statuses.status_classes(codes), ["5xx", "2xx", "4xx"]),
)
on_log(
    "h11_available_classes_24h",
    lambda log: statuses.available_classes(
        statuses.status_classes(statuses.status_codes_24h(log))
    ),
)
on_period(
    "h11_available_classes",
    lambda log, a, b: statuses.available_classes(statuses.status_groups(log, a, b)),
)
on_period("h12_error_ips_4xx", statuses.error_ips, status="4xx")
on_period("h12_error_ips_5xx", statuses.error_ips, status="5xx")


def heavy_error_ips(log: DataFrame) -> DataFrame:
    errors = selection.on_dates(log, START, END).where(F.col("status_code").between(500, 599))
    return statuses.error_ips(heavy.heavy_rows(errors, 10, "ip"), START, END, "5xx")


on_log("h12_error_ips_5xx_by_candidates", heavy_error_ips)
on_period("h13_error_ips_by_class", statuses.error_ips_by_class)
on_log("h1_from_rollup", lambda log: statuses.status_groups(traffic_rollup(log), START, END))

# -- log search ------------------------------------------------------------------------------


def _found(
    log: DataFrame, sort_by: str | None = None, direction: str = "asc", cap: int | None = None, **terms
) -> DataFrame:
    condition = search.search_condition(log, START, END, "06:30", "18:15", **terms)
    return search.search(log, condition, sort_by, direction, cap)


def on_search(name: str, then: Callable[[DataFrame], DataFrame] = lambda found: found, **kw) -> None:
    on_log(name, lambda log: then(_found(log, **kw)), urls=True)


def _matches(log: DataFrame, **terms) -> DataFrame:
    condition = search.search_condition(log, START, END, "06:30", "18:15", **terms)
    return search.search_columns(log.where(condition))


on_log("l1_search_matches", partial(_matches, geo="IRAN", user_agent="chrome"), urls=True)
on_log("l1_search_wildcard", partial(_matches, ip="10._.0", url="HTTP%/"), urls=True)


@query("l1_search_indexed")
def _(spark, sf):
    """The stored log, its files chosen by the trigrams of an address and of an agent."""
    path = _new_folder(spark, "indexed")
    writers.write_log(fixture.requests(spark, sf, urls=True), f"{path}/log")
    text_index.build_index(readers.open_log(spark, f"{path}/log")).write.parquet(f"{path}/index")
    terms = {"ip": "172.16.3%5", "user_agent": "chrome"}
    kept = text_index.pruned_log(spark, f"{path}/log", spark.read.parquet(f"{path}/index"), **terms)
    return _matches(kept.log, **terms)


on_log("l2_search_columns", search.search_columns, urls=True)
on_search("l3_sorted_by_os_desc", sort_by="user_os", direction="desc", geo="iran")
on_search("l3_sorted_by_status_asc", sort_by="status_code", user_agent="Windows")
on_search("l3_unknown_column", sort_by="no_such_column", geo="germany")
on_search("l4_capped_search", cap=1000)
on_search("l5_page", lambda found: search.search_page(found, 3), user_agent="chrome")
on_search("l5_last_page", lambda found: search.search_page(found, 6, 150))


def walked(found: DataFrame, pages: int, size: int, **order) -> DataFrame:
    """The last of some pages, each found from the last row of the one before."""
    place = None
    for _ in range(pages - 1):
        place = search.Place.after(search.next_page(found, place, size, **order).collect(), place)
    return search.next_page(found, place, size, **order)


on_search("l5_next_page", lambda found: walked(found, 4, 10), user_agent="chrome")
on_search(
    "l5_next_page_by_os",
    lambda found: walked(found, 3, 40, sort_by="user_os", direction="desc"),
    user_agent="opera",
)
on_search("l5_page_info", lambda found: search.page_info(found, 3), user_agent="chrome")
on_search("l6_displayed", lambda found: search.displayed(search.search_page(found, 0, 50)), geo="iran")

# -- streaming ---------------------------------------------------------------------------------


def streamed(spark: SparkSession, sf: str, name: str, write: Callable) -> str:
    """Run the events through a stream into a new folder, and its path."""
    stream = spark.readStream.schema(fixture.EVENTS_SCHEMA)
    arrivals = stream.option("pathGlobFilter", "events.parquet").parquet(sf)
    folder = _new_folder(spark, name)
    write(fixture.request_log(arrivals), f"{folder}/out", f"{folder}/checkpoint").awaitTermination()
    return f"{folder}/out"


@query("s1_streamed_hourly_counts")
def _(spark, sf):
    hours = spark.read.parquet(streamed(spark, sf, "hourly", write_hourly_counts))
    bounds = {c: F.col(c).cast("timestamp_ntz") for c in ("window_start", "window_end")}
    return hours.withColumns(bounds)


@query("s1_upserted_hourly_counts")
def _(spark, sf):
    hours = upserted_hours(spark, streamed(spark, sf, "upserts", write_hourly_upserts), START, END)
    bounds = {c: F.col(c).cast("timestamp_ntz") for c in ("window_start", "window_end")}
    return hours.withColumns(bounds)


@query("v1_streamed_first_visits")
def _(spark, sf):
    found = streamed_first_visits(spark, streamed(spark, sf, "first-visits", write_first_visits))
    return found.withColumn("first_visit_time", F.col("first_visit_time").cast("timestamp_ntz"))
