"""Date-range predicates and the data-anchored trailing window."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from accesslens.functions.measures import require_grain

DateLike = str | dt.date


def as_date(value: DateLike) -> dt.date:
    return dt.date.fromisoformat(str(value))


def date_lit(value: DateLike | Column) -> Column:
    return value if isinstance(value, Column) else F.lit(str(value)).cast("date")


def dates_within(date: Column, start: DateLike | None, end: DateLike | None) -> Column:
    """Inclusive bounds, either of which may be open."""
    condition = F.lit(True)
    if start is not None:
        condition = condition & (date >= date_lit(start))
    if end is not None:
        condition = condition & (date <= date_lit(end))
    return condition


def request_date(log: DataFrame) -> Column:
    """UTC date of a request: `day` where the table has it, else from the timestamp.

    As a partition column `day` costs nothing to read, while the timestamps are
    among the largest columns of a log. Drop `day` from a table whose `day` means
    something else than `DATE(timestamp_utc)`.
    """
    return F.col("day") if "day" in log.columns else F.to_date("timestamp_utc")


def in_period(log: DataFrame, start: DateLike | None, end: DateLike | None) -> Column:
    """Request date within the inclusive bounds.

    With `day` this prunes partitions. Without, it is written as a range of
    timestamps, which the Parquet scan can use to skip row groups.
    """
    if "day" in log.columns:
        return dates_within(F.col("day"), start, end)
    moment = F.col("timestamp_utc")
    condition = F.lit(True)
    if start is not None:
        condition = condition & (moment >= as_log_time(log, date_lit(start)))
    if end is not None:
        condition = condition & (moment < as_log_time(log, F.date_add(date_lit(end), 1)))
    return condition


def as_log_time(log: DataFrame, moment: Column) -> Column:
    """Cast to the type of `timestamp_utc`, so that no cast lands on the log's column.

    A cast around the column would keep the comparison out of the scan's filters.
    """
    return moment.cast(log.schema["timestamp_utc"].dataType)


def latest_timestamp(log: DataFrame) -> Column:
    """The log's newest timestamp as a lazy scalar subquery.

    With `day`, the last day is found first, which needs no data column of a
    partitioned table, and the timestamps of that day alone are read.
    """
    if "day" in log.columns:
        log = log.where(F.col("day") == log.agg(F.max("day")).scalar())
    return log.agg(F.max("timestamp_utc")).scalar()


def since(log: DataFrame, moment: Column) -> Column:
    """`timestamp_utc >= moment`, with the partition column bounded alongside.

    Both comparisons stay prunable when `moment` comes from a subquery: the scan
    evaluates it first, then selects partitions and row groups.
    """
    moment = as_log_time(log, moment)
    condition = F.col("timestamp_utc") >= moment
    if "day" in log.columns:
        condition = condition & (F.col("day") >= F.to_date(moment))
    return condition


def last_hours(
    log: DataFrame,
    hours: int,
    anchor: Column | dt.datetime | None = None,
    bounded: bool = True,
) -> Column:
    """Requests of the `hours` before the newest one, both ends included.

    `anchor` replaces the newest timestamp when the caller already knows it.
    `bounded=False` leaves the upper end open; against the log's own newest
    timestamp the result is the same.
    """
    require_grain(log, "exact")
    newest = _moment(log, anchor)
    condition = since(log, newest - F.expr(f"INTERVAL {int(hours)} HOURS"))
    if bounded and anchor is not None:
        condition = condition & (F.col("timestamp_utc") <= as_log_time(log, newest))
    return condition


def closed_hours(log: DataFrame, hours: int, anchor: Column | dt.datetime | None = None) -> Column:
    """The `hours` full clock hours before the hour of the newest request."""
    require_grain(log, "hour")
    current = F.date_trunc("hour", _moment(log, anchor))
    condition = since(log, current - F.expr(f"INTERVAL {int(hours)} HOURS"))
    return condition & (F.col("timestamp_utc") < as_log_time(log, current))


def _moment(log: DataFrame, anchor: Column | dt.datetime | None) -> Column:
    if anchor is None:
        return latest_timestamp(log)
    if isinstance(anchor, Column):
        return as_log_time(log, anchor)
    if anchor.tzinfo is not None:
        anchor = anchor.astimezone(dt.timezone.utc).replace(tzinfo=None)
    literal = F.lit(anchor.isoformat(sep=" "))
    if isinstance(log.schema["timestamp_utc"].dataType, T.TimestampNTZType):
        return literal.cast("timestamp_ntz")
    # naming the zone keeps the literal in UTC under any session time zone
    return F.concat(literal, F.lit("+00:00")).cast("timestamp")
