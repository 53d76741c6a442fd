"""Results that belong together, sharing the work they have in common."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from accesslens.functions.periods import DateLike
from accesslens.operators import geography, referrers, statuses, traffic, visitors


def last_day_view(log: DataFrame, countries: DataFrame, anchor=None) -> dict[str, DataFrame]:
    """The trailing-24-hour figures: visitors, countries, statuses, hours, pages.

    Pass `anchor` (the newest timestamp), if known, to spare each result its look-up.
    """
    classes = statuses.status_classes(statuses.status_codes_24h(log, anchor=anchor))
    return {
        "visitors": visitors.visitor_counts_24h(log, anchor=anchor),
        "countries": geography.country_counts_24h(log, countries, anchor=anchor),
        "statuses": statuses.status_log_values(statuses.status_shares(classes)),
        "trend": traffic.hourly_trend(log, anchor=anchor),
        "pages": referrers.top_paths_24h(log, anchor=anchor),
    }


def environment_totals(
    log: DataFrame, start: DateLike, end: DateLike, device: str = "all"
) -> DataFrame:
    """`dimension, value, visitors` for device, browser and operating system.

    All three come from one `environment_stats`: its few rows are grouped three
    ways at once by grouping sets, where separate queries would find the distinct
    visitors three times.
    """
    stats = visitors.environment_stats(log, start, end, device)
    devices = stats.unpivot(
        ["user_browser", "user_os"],
        [
            F.col("mobile_visitors").alias("mobile"),
            F.col("desktop_visitors").alias("desktop"),
            (
                F.col("total_visitors") - F.col("mobile_visitors") - F.col("desktop_visitors")
            ).alias("unknown"),
        ],
        "device",
        "visitors",
    ).withColumn("device", F.nullif("device", F.lit("unknown")))
    keys = ["device", "user_browser", "user_os"]
    sets = [[F.col(k)] for k in keys]
    names = F.array(*[F.lit(n) for n in ("device", "browser", "os")])
    # grouping_id is 3, 5 or 6 depending on the key that is kept
    kept = F.when(F.grouping_id() == 3, 0).when(F.grouping_id() == 5, 1).otherwise(2)
    grouped = devices.groupingSets(sets, *[F.col(k) for k in keys]).agg(
        kept.alias("which"), F.sum("visitors").alias("visitors")
    )
    value = F.coalesce(*[F.col(k) for k in keys])
    return grouped.select(
        F.get(names, F.col("which")).alias("dimension"), value.alias("value"), "visitors"
    ).where(F.col("value").isNotNull())


def referrer_view(rows: DataFrame, k: int = 10) -> dict[str, DataFrame]:
    """The five results over the newest requests (`referrers.latest_rows`).

    Persist `rows` beforehand when it is capped; it is read five times.
    """
    return {
        "daily": referrers.daily_channel_pivot(rows),
        "domains": referrers.top_domains(rows, k),
        "channels": referrers.channel_totals(rows),
        "urls": referrers.top_urls(rows, k),
        "dates": referrers.sample_date_range(rows),
    }


def region_view(
    cube: DataFrame,
    countries: DataFrame,
    cities: DataFrame,
    level: str,
    start: DateLike | None = None,
    end: DateLike | None = None,
    bots: Sequence[bool] = (True, False),
) -> DataFrame:
    """Counts per `country`, `continent` or `city` from a (persisted) `geo_cube`."""
    known = geography.located(geography.cube_slice(cube, start, end, bots), countries)
    if level == "country":
        return geography.country_counts(known)
    if level == "continent":
        return geography.continent_counts(known)
    if level == "city":
        return geography.geocoded(geography.city_counts(known), cities)
    raise ValueError(f"unknown level: {level}")
