"""Visitors: new and returning, device, browser and operating system.

A visitor is an (ip, user_agent) pair. Three notions of "new" coexist:

* `visitor_counts`: the last visit in the period is on the day of the first visit ever;
* `visitor_counts_24h`: the same on exact timestamps;
* `daily_visitors`: the day is the visitor's first one within the period.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from accesslens.functions.measures import require_grain
from accesslens.functions.periods import DateLike, date_lit, in_period, last_hours, request_date
from accesslens.operators.selection import on_dates, on_device, top, without_nulls
from accesslens.schema import VISITOR_KEY

WORD = 64  # days in the bits of a BIGINT


def first_visits(log: DataFrame) -> DataFrame:
    """`ip, user_agent, first_visit_date` over the whole history."""
    return log.groupBy(VISITOR_KEY).agg(
        F.min(request_date(log)).alias("first_visit_date")
    )


def first_visit_times(log: DataFrame) -> DataFrame:
    """`ip, user_agent, first_visit_time` over the whole history."""
    require_grain(log, "exact")
    return log.groupBy(VISITOR_KEY).agg(F.min("timestamp_utc").alias("first_visit_time"))


def settled(first_seen: DataFrame) -> DataFrame:
    """One row per visitor of a first-seen table: the smallest `first_visit_time`."""
    return first_seen.groupBy(VISITOR_KEY).agg(F.min("first_visit_time").alias("first_visit_time"))


def last_visits(log: DataFrame, start: DateLike, end: DateLike) -> DataFrame:
    """`ip, user_agent, last_visit_date` within the period."""
    rows = on_dates(log, start, end)
    return rows.groupBy(VISITOR_KEY).agg(F.max(request_date(log)).alias("last_visit_date"))


def last_visit_times(log: DataFrame, hours: int = 24, anchor=None) -> DataFrame:
    """`ip, user_agent, last_visit_time` within the trailing hours."""
    rows = log.where(last_hours(log, hours, anchor, bounded=False))
    return rows.groupBy(VISITOR_KEY).agg(F.max("timestamp_utc").alias("last_visit_time"))


def _new_or_returning(visits: DataFrame, last: str, first: str) -> DataFrame:
    return visits.agg(
        F.count(F.lit(1)).alias("total_visitors"),
        F.count_if(F.col(last) == F.col(first)).alias("new_visitors"),
        F.count_if(F.col(last) != F.col(first)).alias("returning_visitors"),
    )


def visitor_counts(
    log: DataFrame, start: DateLike, end: DateLike, first_seen: DataFrame | None = None
) -> DataFrame:
    """`total_visitors, new_visitors, returning_visitors` of the period, day-level.

    First-ever and last-in-period dates come from one scan and one shuffle: the
    second is a conditional maximum, so no self-join of the log is needed. Days
    after the period are not read: a visitor counted has an earlier visit in it.
    Visitors with a NULL key part never match and are left out before the shuffle.

    With a maintained `first_seen` table (`accesslens.plans.first_seen`) only the
    period is read, and joined to it. The table may end inside the period: visitors it
    doesn't know count by their first visit in the period.
    """
    identified = without_nulls(log, *VISITOR_KEY)
    visit_date = request_date(log)
    if first_seen is None:
        visits = on_dates(identified, None, end).groupBy(VISITOR_KEY).agg(
            F.min(visit_date).alias("first_visit_date"),
            F.max(F.when(in_period(log, start, end), visit_date)).alias("last_visit_date"),
        )
        visits = visits.where(F.col("last_visit_date").isNotNull())
    else:
        first = settled(first_seen).select(
            *VISITOR_KEY, F.to_date("first_visit_time").alias("first_visit_date")
        )
        visits = (
            on_dates(identified, start, end)
            .groupBy(VISITOR_KEY)
            .agg(F.min(visit_date).alias("first_in_period"), F.max(visit_date).alias("last_visit_date"))
            .join(first, VISITOR_KEY, "left")
            # of NULL and a value, the value: visitors that the table doesn't know yet
            .withColumn("first_visit_date", F.least("first_visit_date", "first_in_period"))
        )
    return _new_or_returning(visits, "last_visit_date", "first_visit_date")


def visitor_counts_24h(
    log: DataFrame, hours: int = 24, anchor=None, first_seen: DataFrame | None = None
) -> DataFrame:
    """The same counts over the trailing hours, on exact timestamps.

    "New" therefore means a single distinct timestamp in the whole history. As in
    `visitor_counts`, one aggregation gives both ends.
    """
    identified = without_nulls(log, *VISITOR_KEY)
    recent = last_hours(log, hours, anchor, bounded=False)
    if first_seen is None:
        visits = identified.groupBy(VISITOR_KEY).agg(
            F.min("timestamp_utc").alias("first_visit_time"),
            F.max(F.when(recent, F.col("timestamp_utc"))).alias("last_visit_time"),
        )
        visits = visits.where(F.col("last_visit_time").isNotNull())
    else:
        visits = (
            identified.where(recent)
            .groupBy(VISITOR_KEY)
            .agg(
                F.min("timestamp_utc").alias("first_in_period"),
                F.max("timestamp_utc").alias("last_visit_time"),
            )
            .join(settled(first_seen), VISITOR_KEY, "left")
            .withColumn("first_visit_time", F.least("first_visit_time", "first_in_period"))
        )
    return _new_or_returning(visits, "last_visit_time", "first_visit_time")


def _by_device() -> list:
    mobile = F.col("user_is_mobile")
    return [
        F.count(F.lit(1)).alias("total_visitors"),
        F.count_if(mobile).alias("mobile_visitors"),
        F.count_if(~mobile).alias("desktop_visitors"),
    ]


def visitor_counts_by_device(log: DataFrame, start: DateLike, end: DateLike) -> DataFrame:
    """`total_visitors, mobile_visitors, desktop_visitors`.

    Counts distinct (ip, user_agent, user_is_mobile), NULL parts included; a NULL
    flag counts in the total only.
    """
    visitors = on_dates(log, start, end).select(*VISITOR_KEY, "user_is_mobile").distinct()
    return visitors.agg(*_by_device())


def daily_visitors(log: DataFrame, start: DateLike, end: DateLike) -> DataFrame:
    """`visit_date, total_visitors, new_visitors, returning_visitors`.

    A visitor is new on the first of their days within the period, which may be of any
    length. Days are held as bits of 64-day words keyed by visitor and word: `bit_or`
    combines on the map side, so a visitor with a third of all requests costs each task
    one row a word. The words are shuffled once and read twice: their bits are the day
    totals, and the least day of a visitor, again combined before its shuffle, is the day
    on which they are new.
    """
    words = _days_in_words(on_dates(log, start, end), start)
    days = words.select(F.explode(_days_of_word()).alias("day"), F.lit(0).alias("is_new"))
    first = words.groupBy(VISITOR_KEY).agg(F.min(F.get(_days_of_word(), F.lit(0))).alias("day"))
    counted = days.union(first.select("day", F.lit(1)))
    total, new = F.count_if(F.col("is_new") == 0), F.count_if(F.col("is_new") == 1)
    return (
        counted.groupBy(F.date_add(date_lit(start), F.col("day")).alias("visit_date"))
        .agg(
            total.alias("total_visitors"),
            new.alias("new_visitors"),
            (total - new).alias("returning_visitors"),
        )
        .orderBy("visit_date")
    )


def _days_in_words(rows: DataFrame, start: DateLike) -> DataFrame:
    """`ip, user_agent, word, bits`: bit b of word w is day 64 w + b after `start`."""
    day = F.date_diff(request_date(rows), date_lit(start))
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), day.bitwiseAND(F.lit(WORD - 1)))
    dated = rows.select(*VISITOR_KEY, F.shiftright(day, 6).alias("word"), bit.alias("bit"))
    return dated.groupBy(*VISITOR_KEY, "word").agg(F.bit_or("bit").alias("bits"))


def _days_of_word() -> Column:
    """The days after the start whose bits are set, ascending."""
    bits = F.filter(F.sequence(F.lit(0), F.lit(WORD - 1)), lambda b: F.getbit(F.col("bits"), b) == 1)
    return F.transform(bits, lambda b: F.col("word") * WORD + b)


def environment_stats(
    log: DataFrame, start: DateLike, end: DateLike, device: str = "all"
) -> DataFrame:
    """`user_browser, user_os, total_visitors, mobile_visitors, desktop_visitors`."""
    visitors = (
        on_device(on_dates(log, start, end), device)
        .select(*VISITOR_KEY, "user_is_mobile", "user_browser", "user_os")
        .distinct()
    )
    return visitors.groupBy("user_browser", "user_os").agg(*_by_device())


def device_distribution(environment: DataFrame) -> DataFrame:
    """`device, visitors, share` from `environment_stats`; share is in percent."""
    totals = environment.agg(
        F.sum("mobile_visitors").alias("mobile"), F.sum("desktop_visitors").alias("desktop")
    )
    both = F.col("mobile") + F.col("desktop")
    devices = F.array(
        *[
            F.struct(
                F.lit(name).alias("device"),
                F.col(name).alias("visitors"),
                (F.try_divide(F.col(name).cast("double"), both) * 100.0).alias("share"),
            )
            for name in ("mobile", "desktop")
        ]
    )
    return totals.select(F.inline(devices))


def _top_values(environment: DataFrame, column: str, k: int) -> DataFrame:
    totals = without_nulls(environment, column).groupBy(column)
    return top(totals.agg(F.sum("total_visitors").alias("visitors")), k, "visitors", column)


def browser_distribution(environment: DataFrame, k: int = 5) -> DataFrame:
    """`user_browser, visitors`: the top browsers from `environment_stats`."""
    return _top_values(environment, "user_browser", k)


def os_distribution(environment: DataFrame, k: int = 5) -> DataFrame:
    """`user_os, visitors`: the top operating systems from `environment_stats`."""
    return _top_values(environment, "user_os", k)
