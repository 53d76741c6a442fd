"""Acquisition channels, referring domains and landing pages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from accesslens.functions.channels import (
    CHANNELS,
    channel_by_like,
    channel_by_list,
    is_direct,
    is_search,
    is_social,
)
from accesslens.functions.measures import hits, hits_if, share_pct
from accesslens.functions.periods import DateLike, last_hours, request_date
from accesslens.operators.selection import (
    date_range,
    on_dates,
    top,
    with_rankable_path,
    with_referrer,
    with_values,
    without_nulls,
)
from accesslens.schema import require_columns

REFERRER_COLUMNS = ["timestamp_utc", "referrer_domain", "url"]
ALL = "all"


def checked_channel(channel: str | None) -> str:
    """The channel's name; `None` stands for all."""
    if channel is None:
        return ALL
    if channel not in [*CHANNELS, ALL]:
        raise ValueError(f"unknown channel: {channel}")
    return channel


def latest_rows(
    log: DataFrame,
    start: DateLike | None = None,
    end: DateLike | None = None,
    limit: int | None = None,
) -> DataFrame:
    """Newest requests first: `timestamp_utc, referrer_domain, url`.

    With a limit only the last days that together hold enough rows are read, and
    each task keeps its own newest rows; `limit=None` returns all rows of the
    period in order.
    """
    rows = on_dates(require_columns(log, REFERRER_COLUMNS), start, end)
    if limit is not None:
        rows = _last_days_with(rows, limit)
    rows = rows.select(*REFERRER_COLUMNS)
    rows = rows.orderBy(F.col("timestamp_utc").desc(), "referrer_domain", "url")
    return rows if limit is None else rows.limit(limit)


def _last_days_with(rows: DataFrame, limit: int) -> DataFrame:
    """Rows of the fewest last days that hold at least `limit` rows, else all rows.

    Rows are counted per day, which needs no column of a table partitioned by
    `day`; the running total spans one row per day. The scan of the other columns
    then evaluates the first day needed before it selects partitions.
    """
    rows = rows.withColumn("day", request_date(rows))
    running = F.sum("n").over(Window.orderBy(F.col("day").desc()))
    per_day = rows.groupBy("day").agg(F.count(F.lit(1)).alias("n"))
    enough = per_day.withColumn("running", running).where(F.col("running") >= limit)
    first_day = enough.agg(F.max("day")).scalar()
    # NULL when there are fewer rows than the limit: then every row stays
    return rows.where(F.coalesce(F.col("day") >= first_day, F.lit(True)))


def filter_by_channel(
    log: DataFrame,
    start: DateLike | None = None,
    end: DateLike | None = None,
    channel: str | None = None,
) -> DataFrame:
    """Rows of the period with their list-based `channel`, optionally of one channel."""
    channel = checked_channel(channel)
    rows = on_dates(log, start, end).withColumn(
        "channel", channel_by_list(F.col("referrer_domain"))
    )
    return rows if channel in (None, ALL) else rows.where(F.col("channel") == channel)


def _channel_hits(log: DataFrame, suffix: str) -> list:
    domain = F.col("referrer_domain")
    return [
        hits(log).alias("total" + suffix),
        hits_if(log, is_direct(domain)).alias("direct" + suffix),
        hits_if(log, is_social(domain)).alias("social" + suffix),
        hits_if(log, is_search(domain)).alias("search" + suffix),
    ]


def _others(suffix: str):
    named = F.col("direct" + suffix) + F.col("social" + suffix) + F.col("search" + suffix)
    return (F.col("total" + suffix) - named).alias("others" + suffix)


def referrer_counts(log: DataFrame, start: DateLike, end: DateLike) -> DataFrame:
    """`total_count, direct_count, social_count, search_count, others_count` in one row.

    The three named counts are independent, so a domain matching a social and a
    search pattern is in both and is subtracted twice from others.
    """
    rows = on_dates(log, start, end)
    return rows.agg(*_channel_hits(log, "_count")).select("*", _others("_count"))


def referrer_count(
    log: DataFrame, start: DateLike, end: DateLike, channel: str | None = ALL
) -> DataFrame:
    """`count` of one channel, or of all requests."""
    channel = checked_channel(channel)
    name = "total" if channel == ALL else channel
    return referrer_counts(log, start, end).select(F.col(f"{name}_count").alias("count"))


def daily_referrers(log: DataFrame, start: DateLike, end: DateLike) -> DataFrame:
    """`visit_date, direct_count, social_count, search_count, others_count`."""
    rows = on_dates(log, start, end).withColumn("visit_date", request_date(log))
    per_day = rows.groupBy("visit_date").agg(*_channel_hits(log, "_count"))
    return per_day.select(
        "visit_date", "direct_count", "social_count", "search_count", _others("_count")
    ).orderBy("visit_date")


def channel_series(daily: DataFrame, channel: str | None = ALL) -> DataFrame:
    """`visit_date, channel, count` from `daily_referrers`: all channels or one."""
    channel = checked_channel(channel)
    chosen = CHANNELS if channel == ALL else [channel]
    wide = daily.select("visit_date", *[F.col(f"{c}_count").alias(c) for c in chosen])
    return wide.unpivot("visit_date", list(chosen), "channel", "count")


def top_referrers(
    log: DataFrame, start: DateLike, end: DateLike, channel: str | None = ALL, k: int = 10
) -> DataFrame:
    """`referrer_domain, count, channel` of the busiest domains.

    The channel filter comes after the top-k, so it may leave fewer than `k` rows.
    """
    channel = checked_channel(channel)
    counted = (
        with_referrer(on_dates(log, start, end))
        .groupBy("referrer_domain")
        .agg(hits(log).alias("count"))
    )
    best = top(counted, k, "count", "referrer_domain").withColumn(
        "channel", channel_by_list(F.col("referrer_domain"))
    )
    return best if channel == ALL else with_values(best, "channel", [channel])


def channel_distribution(log: DataFrame, start: DateLike, end: DateLike) -> DataFrame:
    """`channel, count, share`, each request in exactly one channel; share is in percent."""
    rows = on_dates(log, start, end)
    counted = rows.groupBy(channel_by_like(F.col("referrer_domain")).alias("channel")).agg(
        hits(log).alias("count")
    )
    return counted.withColumn("share", share_pct("count")).orderBy(
        F.col("count").desc(), "channel"
    )


def _top_paths(rows: DataFrame, log: DataFrame, k: int) -> DataFrame:
    counted = with_rankable_path(rows).groupBy("url_path").agg(hits(log).alias("count"))
    return top(counted, k, "count", "url_path")


def top_paths(log: DataFrame, start: DateLike, end: DateLike, k: int = 10) -> DataFrame:
    """`url_path, count` of the most requested pages other than the root."""
    return _top_paths(on_dates(log, start, end), log, k)


def top_paths_24h(log: DataFrame, hours: int = 24, anchor=None, k: int = 10) -> DataFrame:
    """`top_paths` over the trailing hours."""
    return _top_paths(log.where(last_hours(log, hours, anchor, bounded=False)), log, k)


def with_list_channel(rows: DataFrame) -> DataFrame:
    require_columns(rows, REFERRER_COLUMNS)
    return rows.withColumn("channel", channel_by_list(F.col("referrer_domain")))


def daily_channel_pivot(rows: DataFrame) -> DataFrame:
    """`visit_date, direct, social, search, others`, zero where a channel has no request."""
    marked = with_list_channel(rows)
    cells = [hits_if(rows, F.col("channel") == c).alias(c) for c in CHANNELS]
    dates = request_date(rows).alias("visit_date")
    return marked.groupBy(dates).agg(*cells).orderBy("visit_date")


def top_domains(rows: DataFrame, k: int = 10) -> DataFrame:
    """`referrer_domain, channel, count`; NULL domains are left out, empty ones are not.

    The channel depends on the domain alone, so it is computed for the `k` domains kept.
    """
    require_columns(rows, REFERRER_COLUMNS)
    counted = (
        without_nulls(rows, "referrer_domain")
        .groupBy("referrer_domain")
        .agg(hits(rows).alias("count"))
    )
    return top(counted, k, "count", "referrer_domain").select(
        "referrer_domain", channel_by_list(F.col("referrer_domain")).alias("channel"), "count"
    )


def channel_totals(rows: DataFrame) -> DataFrame:
    """`channel, count`, largest first."""
    counted = with_list_channel(rows).groupBy("channel").agg(hits(rows).alias("count"))
    return counted.orderBy(F.col("count").desc(), "channel")


def top_urls(rows: DataFrame, k: int = 10) -> DataFrame:
    """`url, count` of the most requested full URLs."""
    require_columns(rows, REFERRER_COLUMNS)
    counted = without_nulls(rows, "url").groupBy("url").agg(hits(rows).alias("count"))
    return top(counted, k, "count", "url")


def sample_date_range(rows: DataFrame) -> DataFrame:
    """`start, end`: dates covered by the rows."""
    return date_range(require_columns(rows, REFERRER_COLUMNS)).toDF("start", "end")
