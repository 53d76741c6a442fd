"""Traffic per day and hour, unique users, and the trailing hourly trend."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from accesslens.functions.display import hour_label
from accesslens.functions.measures import hits, require_grain
from accesslens.functions.periods import DateLike, as_log_time, date_lit
from accesslens.operators.selection import in_closed_hours, on_days


def traffic_per_day(log: DataFrame, start: DateLike, end: DateLike) -> DataFrame:
    """`day, traffic_sum`."""
    rows = on_days(log, start, end)
    return rows.groupBy("day").agg(hits(log).alias("traffic_sum")).orderBy("day")


def traffic_per_hour(log: DataFrame, start: DateLike, end: DateLike) -> DataFrame:
    """`hour_to_24, traffic_sum`; hours without requests are absent."""
    require_grain(log, "hour")
    rows = on_days(log, start, end).withColumn("hour_to_24", F.hour("timestamp_utc"))
    return rows.groupBy("hour_to_24").agg(hits(log).alias("traffic_sum")).orderBy("hour_to_24")


def traffic_avg_per_hour(log: DataFrame, start: DateLike, end: DateLike) -> DataFrame:
    """`hour_to_24, avg_traffic`: mean over the days that have requests in that hour."""
    require_grain(log, "hour")
    rows = on_days(log, start, end).withColumn("hour_to_24", F.hour("timestamp_utc"))
    per_day = rows.groupBy("day", "hour_to_24").agg(hits(log).alias("n"))
    mean = F.round(F.avg("n")).cast("bigint")
    return per_day.groupBy("hour_to_24").agg(mean.alias("avg_traffic")).orderBy("hour_to_24")


def _unique_ips(approx_rsd: float | None):
    if approx_rsd is None:
        return F.count_distinct("ip")
    return F.approx_count_distinct("ip", approx_rsd)


def unique_users_per_day(
    log: DataFrame, start: DateLike, end: DateLike, approx_rsd: float | None = None
) -> DataFrame:
    """`day, users`: distinct non-NULL IPs.

    Exact counting first reduces to (day, ip) pairs on the map side, so a busy IP
    costs one row per task. `approx_rsd` trades exactness for a sketch per day.
    """
    rows = on_days(log, start, end)
    return rows.groupBy("day").agg(_unique_ips(approx_rsd).alias("users")).orderBy("day")


def trailing_users(log: DataFrame, start: DateLike, end: DateLike, days: int = 7) -> DataFrame:
    """`day, users`: distinct non-NULL IPs of the `days` days up to each day with requests.

    Each address and day, reduced to one row first, counts on the following days. For long
    spans `accesslens.plans.sketches` keeps what this recounts.
    """
    rows = on_days(log, F.date_sub(date_lit(start), days - 1), end).select("day", "ip")
    counted_on = F.explode(F.sequence("day", F.date_add("day", days - 1))).alias("day")
    spread = rows.distinct().select(counted_on, "ip")
    present = on_days(rows, start, end).select("day").distinct()
    users = spread.groupBy("day").agg(F.count_distinct("ip").alias("users"))
    return users.join(present, "day").orderBy("day")


def traffic_and_users_per_day(
    log: DataFrame, start: DateLike, end: DateLike, approx_rsd: float | None = None
) -> DataFrame:
    """`day, traffic_sum, users` in one pass.

    Both measures cover the same rows, so one aggregation gives what joining
    `traffic_per_day` with `unique_users_per_day` on `day` would.
    """
    rows = on_days(log, start, end)
    measures = [hits(log).alias("traffic_sum"), _unique_ips(approx_rsd).alias("users")]
    return rows.groupBy("day").agg(*measures).orderBy("day")


def traffic_and_users_long(log: DataFrame, start: DateLike, end: DateLike) -> DataFrame:
    """`day, measure, value`: the same comparison in long form."""
    wide = traffic_and_users_per_day(log, start, end)
    return wide.unpivot("day", ["traffic_sum", "users"], "measure", "value")


def hourly_trend(log: DataFrame, hours: int = 23, anchor=None) -> DataFrame:
    """`hour_label, count` for the full hours before the current one.

    Only closed hours are listed (23 by default); hours without requests are absent.
    """
    rows = in_closed_hours(log, hours, anchor)
    per_hour = rows.groupBy(F.date_trunc("hour", "timestamp_utc").alias("h")).agg(
        hits(log).alias("count")
    )
    return per_hour.orderBy("h").select(hour_label(F.col("h")).alias("hour_label"), "count")


def hourly_series(log: DataFrame, start: DateLike, end: DateLike) -> DataFrame:
    """`ds, y`: the hourly series as a forecasting tool would take it."""
    per_hour = on_days(log, start, end).groupBy("hour").agg(hits(log).alias("y"))
    stamp = as_log_time(log, F.to_timestamp("hour", "yyyy-MM-dd'T'HH"))
    return per_hour.select(stamp.alias("ds"), F.col("y").cast("bigint").alias("y")).orderBy("ds")
