"""HTTP status classes, hourly status mix and error-prone clients."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from accesslens.functions.display import thousands
from accesslens.functions.measures import hits, hits_if, require_grain, share_pct
from accesslens.functions.periods import DateLike
from accesslens.functions.statuses import (
    STATUS_CLASSES,
    class_codes,
    log_display,
    status_class,
    status_group,
)
from accesslens.operators.selection import (
    in_last_hours,
    on_dates,
    top,
    with_values,
    without_nulls,
)


def status_groups(log: DataFrame, start: DateLike, end: DateLike) -> DataFrame:
    """`status_group, count` with groups 100, 200, ..."""
    rows = on_dates(log, start, end)
    counted = rows.groupBy(status_group(F.col("status_code")).alias("status_group"))
    return counted.agg(hits(log).alias("count")).orderBy("status_group")


def status_headline(log: DataFrame, start: DateLike, end: DateLike) -> DataFrame:
    """`2xx, 3xx, 4xx, 5xx` counts in one row, zero when a class is absent."""
    rows = on_dates(log, start, end)
    group = status_group(F.col("status_code"))
    return rows.agg(
        *[hits_if(log, group == class_codes(c)[0]).alias(c) for c in STATUS_CLASSES[1:]]
    )


def _status_codes(rows: DataFrame, log: DataFrame) -> DataFrame:
    counted = rows.groupBy("status_code").agg(hits(log).alias("count"))
    return counted.select(
        "status_code", status_group(F.col("status_code")).alias("status_group"), "count"
    )


def status_codes(log: DataFrame, start: DateLike, end: DateLike) -> DataFrame:
    """`status_code, status_group, count`."""
    return _status_codes(on_dates(log, start, end), log)


def status_codes_24h(log: DataFrame, hours: int = 24, anchor=None) -> DataFrame:
    """`status_codes` over the trailing hours."""
    return _status_codes(in_last_hours(log, hours, anchor), log)


def status_classes(codes: DataFrame) -> DataFrame:
    """`status_class, status_group, count` from `status_codes`."""
    labelled = without_nulls(codes, "status_code")
    return labelled.groupBy(
        status_class(F.col("status_group")).alias("status_class"), "status_group"
    ).agg(F.sum("count").alias("count"))


def status_details(codes: DataFrame) -> DataFrame:
    """`status_class, details`: one ``code: count`` line per code, in code order.

    A class has at most a hundred codes, which bounds the collected list.
    """
    line = F.concat(F.col("status_code").cast("string"), F.lit(": "), thousands(F.col("count")))
    entry = F.struct(F.col("status_code"), line.alias("line"))
    return (
        without_nulls(codes, "status_code")
        .groupBy(status_class(F.col("status_group")).alias("status_class"))
        .agg(F.sort_array(F.collect_list(entry)).alias("entries"))
        .select("status_class", F.array_join("entries.line", "\n").alias("details"))
    )


def status_shares(classes: DataFrame) -> DataFrame:
    """`status_classes` with `percentage` of all requests."""
    return classes.withColumn("percentage", share_pct("count"))


def status_log_values(classes: DataFrame) -> DataFrame:
    """`status_classes` with `display_value` on a logarithmic scale."""
    return classes.withColumn("display_value", log_display("count"))


def hourly_statuses(log: DataFrame, start: DateLike, end: DateLike) -> DataFrame:
    """`hour, status_group, count` by hour of the day."""
    require_grain(log, "hour")
    rows = on_dates(log, start, end)
    return rows.groupBy(
        F.hour("timestamp_utc").alias("hour"),
        status_group(F.col("status_code")).alias("status_group"),
    ).agg(hits(log).alias("count"))


def _hour_by_class(hourly: DataFrame, total: bool = False) -> DataFrame:
    """Class columns per hour for all 24 hours, from `hourly_statuses`.

    Both sides of the join have at most 24 rows.
    """
    cells = [
        F.sum(F.when(F.col("status_group") == class_codes(c)[0], F.col("count"))).alias(c)
        for c in STATUS_CLASSES
    ]
    if total:
        cells.append(F.sum("count").alias("total"))
    table = without_nulls(hourly, "status_group").groupBy("hour").agg(*cells)
    hours = hourly.sparkSession.range(24).select(F.col("id").cast("int").alias("hour"))
    return hours.join(F.broadcast(table), "hour", "left").fillna(0)


def hourly_status_table(hourly: DataFrame) -> DataFrame:
    """`hour, 1xx, .., 5xx`: dense over the 24 hours, zero where nothing happened."""
    return _hour_by_class(hourly).orderBy("hour")


def hourly_status_percent(hourly: DataFrame) -> DataFrame:
    """`hourly_status_table` in percent of each hour's requests of every class."""
    table = _hour_by_class(hourly, total=True)
    percent = [
        F.when(F.col("total") > 0, F.col(c) / F.col("total") * 100.0).otherwise(0.0).alias(c)
        for c in STATUS_CLASSES
    ]
    return table.select("hour", *percent).orderBy("hour")


def selected_classes(classes: DataFrame, chosen: Sequence[str]) -> DataFrame:
    """Rows of `status_classes` for the chosen labels, in the fixed class order."""
    order = F.array_position(F.array(*[F.lit(c) for c in STATUS_CLASSES]), F.col("status_class"))
    known = [c for c in chosen if c in STATUS_CLASSES]
    return with_values(classes, "status_class", known).orderBy(order)


def available_classes(groups: DataFrame) -> DataFrame:
    """`status_class, available` for every class, from `status_groups`."""
    spark = groups.sparkSession
    master = spark.range(1, len(STATUS_CLASSES) + 1).select(
        F.concat(F.col("id").cast("string"), F.lit("xx")).alias("status_class")
    )
    observed = groups.select(
        status_class(F.col("status_group")).alias("status_class"), F.lit(True).alias("seen")
    )
    return master.join(observed, "status_class", "left").select(
        "status_class", F.coalesce("seen", F.lit(False)).alias("available")
    )


def _per_error_ip(log: DataFrame, rows: DataFrame, *keys: str) -> DataFrame:
    """`keys, ip, request_count, geo`, with the smallest `geo` of each IP.

    Any of an IP's places would do; the smallest makes the result repeatable. Requests
    are counted per place by hash; only those few counts are sorted for the smallest text.
    """
    places = rows.groupBy(*keys, "ip", "geo").agg(hits(log).alias("place_count"))
    return places.groupBy(*keys, "ip").agg(
        F.sum("place_count").alias("request_count"), F.min("geo").alias("geo")
    )


def _ranking(*keys: str) -> Column:
    order = [F.col("request_count").desc(), F.col("ip").asc_nulls_last()]
    return F.row_number().over(Window.partitionBy(*keys).orderBy(*order))


def error_ips(
    log: DataFrame, start: DateLike, end: DateLike, status: str, k: int = 10
) -> DataFrame:
    """`rank, ip, request_count, geo`: clients with most responses of a class such as ``4xx``.

    The rank is numbered on the `k` rows kept, never on all clients.
    """
    rows = on_dates(log, start, end).where(F.col("status_code").between(*class_codes(status)))
    best = top(_per_error_ip(log, rows), k, "request_count", F.col("ip").asc_nulls_last())
    ranked = best.withColumn("rank", _ranking())
    return ranked.select("rank", "ip", "request_count", "geo").orderBy("rank")


def error_ips_by_class(
    log: DataFrame,
    start: DateLike,
    end: DateLike,
    classes: Sequence[str] = ("4xx", "5xx"),
    k: int = 10,
) -> DataFrame:
    """`status_class, rank, ip, request_count, geo` for several classes from one scan.

    Spark applies the rank filter before the shuffle too (window group limit): a
    task passes on at most `k` clients of a class, so no task sorts a whole class.
    """
    code = F.col("status_code")
    wanted = reduce(or_, [code.between(*class_codes(c)) for c in classes])
    rows = on_dates(log, start, end).where(wanted).withColumn("status_class", status_class(code))
    per_ip = _per_error_ip(log, rows, "status_class")
    ranked = per_ip.withColumn("rank", _ranking("status_class")).where(F.col("rank") <= k)
    return ranked.select("status_class", "rank", "ip", "request_count", "geo").orderBy(
        "status_class", "rank"
    )
