"""Date discovery, row filters and projections shared by all subjects."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from accesslens.functions.periods import (
    DateLike,
    closed_hours,
    date_lit,
    dates_within,
    in_period,
    last_hours,
    request_date,
)
from accesslens.functions.places import is_known_geo

FIRST_LOG_DATE = "2019-01-01"  # fixed value: start of the range shown for an empty log


def log_dates(log: DataFrame) -> DataFrame:
    """Distinct request dates, ascending."""
    return log.select(request_date(log).alias("date")).distinct().orderBy("date")


def date_range(log: DataFrame) -> DataFrame:
    """First and last request date in one row; both NULL for an empty log."""
    date = request_date(log)
    return log.agg(F.min(date).alias("min_date"), F.max(date).alias("max_date"))


def date_range_or_default(
    log: DataFrame, first: DateLike = FIRST_LOG_DATE, last: DateLike | None = None
) -> DataFrame:
    """`date_range`, with `first` .. today (or `last`) in place of NULLs."""
    newest = F.current_date() if last is None else date_lit(last)
    return date_range(log).select(
        F.coalesce("min_date", date_lit(first)).alias("min_date"),
        F.coalesce("max_date", newest).alias("max_date"),
    )


def on_days(log: DataFrame, start: DateLike | None, end: DateLike | None) -> DataFrame:
    """Rows whose `day` lies within the inclusive bounds."""
    return log.where(dates_within(F.col("day"), start, end))


def on_dates(log: DataFrame, start: DateLike | None, end: DateLike | None) -> DataFrame:
    """Rows whose request date lies within the inclusive bounds; either may be None."""
    return log.where(in_period(log, start, end))


def in_last_hours(log: DataFrame, hours: int = 24, anchor=None) -> DataFrame:
    """Rows of the `hours` up to the newest request (or up to `anchor`)."""
    return log.where(last_hours(log, hours, anchor))


def in_closed_hours(log: DataFrame, hours: int = 23, anchor=None) -> DataFrame:
    """Rows of the `hours` full clock hours before the newest request's hour."""
    return log.where(closed_hours(log, hours, anchor))


def with_known_geo(log: DataFrame) -> DataFrame:
    return log.where(is_known_geo(F.col("geo")))


def with_rankable_path(log: DataFrame) -> DataFrame:
    path = F.col("url_path")
    return log.where(path.isNotNull() & ~path.isin("", "/"))


def with_referrer(log: DataFrame) -> DataFrame:
    domain = F.col("referrer_domain")
    return log.where(domain.isNotNull() & (domain != ""))


def on_device(log: DataFrame, device: str = "all") -> DataFrame:
    """`mobile` or `desktop` rows; a NULL flag passes under `all` only."""
    if device == "all":
        return log
    if device not in ("mobile", "desktop"):
        raise ValueError(f"unknown device: {device}")
    return log.where(F.col("user_is_mobile") == F.lit(device == "mobile"))


def with_values(df: DataFrame, column: str, values: Sequence) -> DataFrame:
    """Rows whose `column` is one of `values`; an empty list selects nothing."""
    return df.where(F.col(column).isin(list(values)) if values else F.lit(False))


def without_nulls(df: DataFrame, *columns: str) -> DataFrame:
    """Rows with a value in every one of `columns`.

    One test per column, because those reach the scan and `dropna` does not.
    """
    return df.where(reduce(and_, [F.col(c).isNotNull() for c in columns]))


def renamed(df: DataFrame, names: Mapping[str, str]) -> DataFrame:
    return df.withColumnsRenamed(dict(names))


def top(df: DataFrame, k: int, count: str, *keys: str | Column) -> DataFrame:
    """The `k` rows with the largest `count`, ties in ascending key order.

    Sorting plus limit is planned as TakeOrderedAndProject: each task keeps only
    its own best `k` rows, so no full sort takes place.
    """
    return df.orderBy(F.col(count).desc(), *keys).limit(k)
