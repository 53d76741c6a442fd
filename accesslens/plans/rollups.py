"""Pre-aggregated request tables that the count operators accept in place of the log.

A rollup keeps `timestamp_utc` (truncated to its grain), `day`, the chosen
dimensions and the request count `hits`. Operators that count requests sum `hits`
when it is there, so `traffic_per_day(rollup(log, grain="day"), ...)` equals
`traffic_per_day(log, ...)` at a fraction of the reading. Write one per day with
`accesslens.sources.writers.write_days`; late requests replace their day only.

An operator that needs finer times than a rollup has raises `ValueError`: hours of the day
take at least the hour grain, the trailing 24 hours the log itself.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from accesslens.functions.measures import hits, require_grain
from accesslens.functions.periods import as_log_time, request_date

GRAINS = ("hour", "day")

TRAFFIC_DIMENSIONS = ["status_code"]  # hour grain: traffic and status operators
REFERRER_DIMENSIONS = ["referrer_domain"]  # day grain: channel operators
PATH_DIMENSIONS = ["url_path"]  # day grain: page ranking
VISITOR_DIMENSIONS = [  # day grain: day-level visitor operators
    "ip", "user_agent", "user_is_mobile", "user_browser", "user_os",
]


def rollup(log: DataFrame, *dimensions: str, grain: str = "day") -> DataFrame:
    """`timestamp_utc, day, dimensions, hits`, one row per combination."""
    if grain not in GRAINS:
        raise ValueError(f"unknown grain: {grain}")
    require_grain(log, grain)
    moment = request_date(log) if grain == "day" else F.date_trunc(grain, "timestamp_utc")
    start = as_log_time(log, moment)
    keys = ["timestamp_utc", "day", *dimensions]
    return log.withColumn("timestamp_utc", start).groupBy(*keys).agg(hits(log).alias("hits", metadata={"grain": grain}))
