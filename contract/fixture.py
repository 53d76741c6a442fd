"""The request table, derived from the given `events` and `pages` tables.

Small fixed lists are looked up by array position instead of joined, so a query
that does not use a column does not pay for it. `pages` is joined only where URLs
are asked for.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# User agent, browser, operating system, mobile flag, bot flag.
AGENTS = [
    ("Mozilla/5.0 (Windows NT 10.0; Win64; x64) Chrome/72.0", "Chrome", "Windows", False, False),
    ("Mozilla/5.0 (Linux; Android 8.0) Mobile Chrome/71.0", "Chrome Mobile", "Android", True, False),
    ("Mozilla/5.0 (iPhone; CPU iPhone OS 12_1) Mobile Safari/604.1", "Mobile Safari", "iOS", True, False),
    ("Mozilla/5.0 (X11; Linux x86_64) Firefox/64.0", "Firefox", "Linux", False, False),
    ("Mozilla/5.0 (compatible; Googlebot/2.1)", "Googlebot", "Other", False, True),
    ("Mozilla/5.0 (compatible; bingbot/2.0)", "bingbot", "Other", False, True),
    ("Mozilla/5.0 (Macintosh; Intel Mac OS X 10_14) Safari/605.1", "Safari", "Mac OS X", False, False),
    ("Opera/9.80", "Opera", None, None, False),
    (None, None, None, False, False),
]
GEOS = [
    "Iran (Islamic Republic of), Tehran", "Iran (Islamic Republic of), Mashhad",
    "United States of America, Ashburn", "Germany, Falkenstein", "Korea (Republic of), Seoul",
    "France, Paris", "Brazil, Sao Paulo", "Nowhereland, Atlantis", "Singapore",
    "-", "", None, "Antarctica, McMurdo",
]
REFERRERS = [
    None, "", "www.zanbil.ir", "www.zanbil.ir", "www.google.com", "www.google.co.uk",
    "m.facebook.com", "t.co", "www.microsoft.com", "bing.com", "blog.zanbil.ir", "duckduckgo.com",
    "facebook.com.google.com", "direct", "torob.com", "localhost", "lnkd.in",
]
COUNTRIES = [
    ("iran", "IRN", "Asia"), ("united states of america", "USA", "North America"),
    ("germany", "DEU", "Europe"), ("korea", "KOR", "Asia"), ("france", "FRA", "Europe"),
    ("brazil", "BRA", "South America"), ("singapore", "SGP", "Asia"), ("antarctica", "ATA", None),
]
CITIES = [
    ("Tehran", "Iran", 35.7, 51.4), ("Ashburn", "United States", 39.0, -77.5),
    ("Falkenstein", "Germany", 50.5, 12.4), ("Seoul", "Korea, South", 37.6, 127.0),
    ("Paris", "France", 48.9, 2.4), ("Paris", "United States", 33.7, -95.5),
    ("Sao Paulo", "Brazil", -23.6, -46.6),
]


EVENTS_SCHEMA = "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING"
PAGES_SCHEMA = "page_id BIGINT, url STRING"


def _literal(value) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return str(value).lower()
    return f"CAST({value} AS DOUBLE)" if isinstance(value, float) else f"'{value}'"


def _pick(values: list, index: str) -> str:
    listed = ", ".join(_literal(v) for v in values)
    return f"get(array({listed}), CAST({index} AS INT))"


AGENT = "(user_id * 5 + IF(event_id % 11 = 0, 1, 0)) % 9"
PLACE = "(user_id * user_id + IF(event_id % 5 = 0, event_id, 0)) % 13"
SOURCE = "((event_id % 17) * (event_id % 3)) % 17"

COLUMNS = {
    "timestamp_utc": "ts",
    "day": "to_date(ts)",
    "hour": "date_format(ts, \"yyyy-MM-dd'T'HH\")",
    "ip": """CASE
        WHEN event_id % 997 = 0 THEN NULL
        WHEN event_id % 5 = 0 THEN concat('172.16.', (event_id div 256) % 256, '.', event_id % 256)
        ELSE concat('10.0.', user_id div 256, '.', user_id % 256) END""",
    "user_agent": _pick([a[0] for a in AGENTS], AGENT),
    "user_browser": _pick([a[1] for a in AGENTS], AGENT),
    "user_os": _pick([a[2] for a in AGENTS], AGENT),
    "user_is_mobile": _pick([a[3] for a in AGENTS], AGENT),
    "user_is_bot": _pick([a[4] for a in AGENTS], AGENT),
    "status_code": """CAST(CASE
        WHEN event_id % 499 = 0 THEN 100
        WHEN event_type = 'error' AND event_id % 3 = 0 THEN 500 + event_id % 4
        WHEN event_type = 'error' THEN 400 + event_id % 5
        WHEN event_type = 'click' AND event_id % 4 = 0 THEN 302
        WHEN event_type = 'click' AND event_id % 4 = 1 THEN 304
        ELSE 200 END AS INT)""",
    "http_method": """CASE
        WHEN event_type = 'purchase' THEN 'POST'
        WHEN event_id % 17 = 0 THEN 'HEAD' ELSE 'GET' END""",
    "referrer_domain": _pick(REFERRERS, SOURCE),
    "geo": _pick(GEOS, PLACE),
}
URL_COLUMNS = {
    "url": "url",
    "url_path": r"""CASE
        WHEN event_id % 41 = 0 THEN '/'
        WHEN event_id % 43 = 0 THEN NULL
        WHEN event_id % 47 = 0 THEN ''
        ELSE regexp_extract(url, '^https?://[^/]+(/[^?#]*)', 1) END""",
}


def _columns(expressions: dict[str, str]) -> list[str]:
    return [f"{text} AS {name}" for name, text in expressions.items()]


def request_log(events: DataFrame, pages: DataFrame | None = None) -> DataFrame:
    """One request per event; with `pages` also `url` and `url_path`.

    Works on a stream of events as long as `pages` is not asked for.
    """
    if pages is None:
        return events.selectExpr(*_columns(COLUMNS))
    # every page is some request's target: ids run from 0 to count - 1
    n = pages.agg(F.count(F.lit(1))).scalar()
    e = F.col("event_id")
    keyed = events.withColumn("page_id", ((e % n) * (e % 7)) % n)
    return keyed.join(pages, "page_id", "left").selectExpr(*_columns(COLUMNS | URL_COLUMNS))


def events_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.schema(EVENTS_SCHEMA).parquet(f"{sf_dir}/events.parquet")


def pages_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.schema(PAGES_SCHEMA).parquet(f"{sf_dir}/pages.parquet")


def requests(spark: SparkSession, sf_dir: str, urls: bool = False) -> DataFrame:
    pages = pages_table(spark, sf_dir) if urls else None
    return request_log(events_table(spark, sf_dir), pages)


def _values(spark: SparkSession, rows: list[tuple], names: str) -> DataFrame:
    body = ", ".join("(" + ", ".join(_literal(v) for v in row) + ")" for row in rows)
    return spark.sql(f"SELECT * FROM VALUES {body} AS t({names})")


def countries(spark: SparkSession) -> DataFrame:
    return _values(spark, COUNTRIES, "alias, iso3, continent")


def cities(spark: SparkSession) -> DataFrame:
    return _values(spark, CITIES, "city, country, lat, lng")
