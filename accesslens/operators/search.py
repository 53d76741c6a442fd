"""Log search: filter, sort, cap, page."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

from accesslens.functions.display import clock_seconds
from accesslens.functions.periods import DateLike, as_log_time, dates_within

PAGE_SIZE = 10

RESULT_COLUMNS = [
    "ip", "status_code", "timestamp", "url", "geo", "http_method",
    "user_agent", "user_browser", "user_os", "user_is_mobile", "user_is_bot",
]
SORTABLE = [c for c in RESULT_COLUMNS if c != "user_agent"]
TIE_COLUMNS = [
    "ip", "url", "user_agent", "status_code", "geo", "http_method",
    "user_browser", "user_os", "user_is_mobile", "user_is_bot",
]
USER_AGENT_COLUMNS = ["user_browser", "user_os", "user_agent"]


def _contains(column: str, term: str) -> Column:
    """Case-insensitive substring test; `%` and `_` in the term are wildcards."""
    return F.col(column).ilike("%" + term.replace("\\", "\\\\") + "%")


def search_condition(
    log: DataFrame,
    start_date: DateLike,
    end_date: DateLike,
    start_time: str = "00:00",
    end_time: str = "23:59",
    ip: str | None = None,
    url: str | None = None,
    geo: str | None = None,
    user_agent: str | None = None,
) -> Column:
    """Requests from the start minute to the end of the end minute that match all terms.

    Times are bound as typed values. The user-agent term may match the browser,
    the operating system or the raw text.
    """
    first = as_log_time(log, F.lit(f"{start_date} {start_time}:00.000000"))
    last = as_log_time(log, F.lit(f"{end_date} {end_time}:59.999999"))
    condition = F.col("timestamp_utc").between(first, last)
    if "day" in log.columns:
        condition = condition & dates_within(F.col("day"), start_date, end_date)
    for column, term in (("ip", ip), ("url", url), ("geo", geo)):
        if term:
            condition = condition & _contains(column, term)
    if user_agent:
        matches = [_contains(c, user_agent) for c in USER_AGENT_COLUMNS]
        condition = condition & (matches[0] | matches[1] | matches[2])
    return condition


def search_columns(rows: DataFrame) -> DataFrame:
    """The eleven columns of a search result."""
    return rows.withColumnRenamed("timestamp_utc", "timestamp").select(*RESULT_COLUMNS)


def search_order(column: str | None = None, direction: str = "asc") -> list[Column]:
    """Sort keys: one listed column, else newest first; ties are broken by the others.

    All columns of the result are keys, so pages and caps repeat. NULLs come first
    ascending and last descending. An unlisted column means newest first, any direction
    but `asc` and `desc` is refused.
    """
    if direction not in ("asc", "desc"):
        raise ValueError(f"unknown direction: {direction}")
    newest = F.col("timestamp").desc()
    if column not in SORTABLE:
        keys = [newest]
    else:
        chosen = F.col(column)
        keys = [chosen.desc() if direction == "desc" else chosen.asc()]
        if column != "timestamp":
            keys.append(newest)
    return keys + [F.col(c).asc() for c in TIE_COLUMNS]


def search(
    log: DataFrame,
    condition: Column,
    sort_by: str | None = None,
    direction: str = "asc",
    cap: int | None = None,
) -> DataFrame:
    """All matches in sort order, or the first `cap` of them.

    A page or a count of the result takes no full sort: `search_page` keeps the rows of
    the first pages in each task, `page_info` only counts.
    """
    found = search_columns(log.where(condition)).orderBy(*search_order(sort_by, direction))
    return found if cap is None else found.limit(cap)


def search_page(
    found: DataFrame,
    page: int,
    size: int = PAGE_SIZE,
    sort_by: str | None = None,
    direction: str = "asc",
) -> DataFrame:
    """Rows of page `page` (from 0) of a search result."""
    ordered = found.orderBy(*search_order(sort_by, direction))
    return ordered.offset(page * size).limit(size)


@dataclass(frozen=True)
class Place:
    """Where a page ended: the last row, and how many rows equal to it have been shown."""

    row: tuple
    shown: int

    @classmethod
    def after(cls, rows: Sequence[Row], before: Place | None = None) -> Place | None:
        """The place behind the rows of a page; `before` is the place at which the page began."""
        if not rows:
            return before
        last = tuple(rows[-1][c] for c in RESULT_COLUMNS)
        shown = sum(tuple(r[c] for c in RESULT_COLUMNS) == last for r in rows)
        if before is not None and before.row == last:
            shown += before.shown
        return cls(last, shown)


def next_page(
    found: DataFrame,
    place: Place | None = None,
    size: int = PAGE_SIZE,
    sort_by: str | None = None,
    direction: str = "asc",
) -> DataFrame:
    """The `size` rows of a search result that follow `place`; its first rows for None.

    Rows before the place are filtered out by their sort keys, in the scan where it can. So
    each task keeps `size` rows on any page, where `search_page` keeps those of all pages
    before as well. All columns are sort keys: only rows equal to the last one shown are
    read again, and their number is skipped.
    """
    order = search_order(sort_by, direction)
    if place is None:
        return found.orderBy(*order).limit(size)
    values = dict(zip(RESULT_COLUMNS, place.row, strict=True))
    rest = found.where(_from_place(found, values, _directions(sort_by, direction)))
    return rest.orderBy(*order).offset(place.shown).limit(size)


def _directions(sort_by: str | None, direction: str) -> list[tuple[str, bool]]:
    """The columns of `search_order`, and whether each descends."""
    keys = [("timestamp", True)]
    if sort_by in SORTABLE:
        keys = [(sort_by, direction == "desc")] + (keys if sort_by != "timestamp" else [])
    return keys + [(c, False) for c in TIE_COLUMNS]


def _from_place(found: DataFrame, values: dict, keys: list[tuple[str, bool]]) -> Column:
    """The row of these values and all after it. NULLs come first ascending, last descending."""
    rest = F.lit(True)
    for column, descending in reversed(keys):
        c, value = F.col(column), values[column]
        if value is None:
            later = F.lit(False) if descending else c.isNotNull()
            same = c.isNull()
        else:
            bound = _typed(found, column, value)
            later = (c < bound) | c.isNull() if descending else c > bound
            same = c == bound
        rest = later | (same & rest)
    # the first key alone, for the scan
    column, descending = keys[0]
    if values[column] is not None:
        bound = _typed(found, column, values[column])
        c = F.col(column)
        rest = rest & ((c <= bound) | c.isNull() if descending else c >= bound)
    return rest


def _typed(found: DataFrame, column: str, value) -> Column:
    kind = found.schema[column].dataType
    if isinstance(value, dt.datetime):
        if isinstance(kind, T.TimestampType):
            # rows bring it in the local zone of this process
            value = value.astimezone(dt.timezone.utc)
        value = value.isoformat(sep=" ")
    return F.lit(value).cast(kind)


def page_info(found: DataFrame, page: int, size: int = PAGE_SIZE) -> DataFrame:
    """`total_count, start_row, end_row, page_count` of a search result."""
    total = F.col("total_count")
    return found.agg(F.count(F.lit(1)).alias("total_count")).select(
        total,
        F.when(total > 0, F.lit(page * size + 1)).otherwise(0).cast("bigint").alias("start_row"),
        F.least(F.lit((page + 1) * size), total).cast("bigint").alias("end_row"),
        F.ceil(total / size).cast("bigint").alias("page_count"),
    )


def displayed(found: DataFrame) -> DataFrame:
    """`timestamp` as text to the second."""
    return found.withColumn("timestamp", clock_seconds(F.col("timestamp")))
