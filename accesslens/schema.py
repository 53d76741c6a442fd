"""Column contract of the request table and of the two lookup tables."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import types as T

# One row per HTTP request. `day` repeats DATE(timestamp_utc) so that it can be
# the physical partition column; `write_log` guarantees that the two agree.
WEBLOG_SCHEMA = T.StructType(
    [
        T.StructField("timestamp_utc", T.TimestampType()),
        T.StructField("day", T.DateType()),
        T.StructField("hour", T.StringType()),
        T.StructField("ip", T.StringType()),
        T.StructField("user_agent", T.StringType()),
        T.StructField("user_browser", T.StringType()),
        T.StructField("user_os", T.StringType()),
        T.StructField("user_is_mobile", T.BooleanType()),
        T.StructField("user_is_bot", T.BooleanType()),
        T.StructField("status_code", T.IntegerType()),
        T.StructField("http_method", T.StringType()),
        T.StructField("url", T.StringType()),
        T.StructField("url_path", T.StringType()),
        T.StructField("referrer_domain", T.StringType()),
        T.StructField("geo", T.StringType()),
    ]
)

CITY_SCHEMA = T.StructType(
    [
        T.StructField("city", T.StringType()),
        T.StructField("country", T.StringType()),
        T.StructField("lat", T.DoubleType()),
        T.StructField("lng", T.DoubleType()),
    ]
)

# `alias` is a lower-case country name or code and is unique in the table.
COUNTRY_SCHEMA = T.StructType(
    [
        T.StructField("alias", T.StringType()),
        T.StructField("iso3", T.StringType()),
        T.StructField("continent", T.StringType()),
    ]
)

VISITOR_KEY = ["ip", "user_agent"]


def require_columns(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """Return `df` unchanged, or raise `ValueError` naming the columns it lacks."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df
