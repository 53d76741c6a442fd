"""DuckDB SQL for the same results, written from the definitions rather than the Spark plans.

Each text starts from the request table as a common table expression over the
given `events` and `pages` views.
"""

from __future__ import annotations

WEBLOG = r"""
ua AS (SELECT * FROM (VALUES
  (0,'Mozilla/5.0 (Windows NT 10.0; Win64; x64) Chrome/72.0','Chrome','Windows',false,false),
  (1,'Mozilla/5.0 (Linux; Android 8.0) Mobile Chrome/71.0','Chrome Mobile','Android',true,false),
  (2,'Mozilla/5.0 (iPhone; CPU iPhone OS 12_1) Mobile Safari/604.1','Mobile Safari','iOS',true,false),
  (3,'Mozilla/5.0 (X11; Linux x86_64) Firefox/64.0','Firefox','Linux',false,false),
  (4,'Mozilla/5.0 (compatible; Googlebot/2.1)','Googlebot','Other',false,true),
  (5,'Mozilla/5.0 (compatible; bingbot/2.0)','bingbot','Other',false,true),
  (6,'Mozilla/5.0 (Macintosh; Intel Mac OS X 10_14) Safari/605.1','Safari','Mac OS X',false,false),
  (7,'Opera/9.80','Opera',NULL,NULL,false),
  (8,NULL,NULL,NULL,false,false)
) AS t(ua_id,user_agent,user_browser,user_os,user_is_mobile,user_is_bot)),
gd AS (SELECT * FROM (VALUES
  (0,'Iran (Islamic Republic of), Tehran'),(1,'Iran (Islamic Republic of), Mashhad'),
  (2,'United States of America, Ashburn'),(3,'Germany, Falkenstein'),(4,'Korea (Republic of), Seoul'),
  (5,'France, Paris'),(6,'Brazil, Sao Paulo'),(7,'Nowhereland, Atlantis'),(8,'Singapore'),
  (9,'-'),(10,''),(11,NULL),(12,'Antarctica, McMurdo')
) AS t(geo_id,geo)),
rd AS (SELECT * FROM (VALUES
  (0,NULL),(1,''),(2,'www.zanbil.ir'),(3,'www.zanbil.ir'),(4,'www.google.com'),(5,'www.google.co.uk'),
  (6,'m.facebook.com'),(7,'t.co'),(8,'www.microsoft.com'),(9,'bing.com'),(10,'blog.zanbil.ir'),(11,'duckduckgo.com'),
  (12,'facebook.com.google.com'),(13,'direct'),(14,'torob.com'),(15,'localhost'),(16,'lnkd.in')
) AS t(ref_id,referrer_domain)),
np AS (SELECT count(*) AS n FROM pages),
e AS (SELECT event_id AS e, user_id AS u, event_type, ts, ((event_id % n) * (event_id % 7)) % n AS page_key
      FROM events, np),
weblog AS (
SELECT e.ts AS timestamp_utc, CAST(e.ts AS DATE) AS day, strftime(e.ts, '%Y-%m-%dT%H') AS hour,
  CASE WHEN e.e % 997 = 0 THEN NULL
       WHEN e.e % 5 = 0 THEN '172.16.' || ((e.e // 256) % 256) || '.' || (e.e % 256)
       ELSE '10.0.' || (e.u // 256) || '.' || (e.u % 256) END AS ip,
  ua.user_agent, ua.user_browser, ua.user_os, ua.user_is_mobile, ua.user_is_bot,
  CAST(CASE WHEN e.e % 499 = 0 THEN 100
       WHEN e.event_type = 'error' AND e.e % 3 = 0 THEN 500 + e.e % 4
       WHEN e.event_type = 'error' THEN 400 + e.e % 5
       WHEN e.event_type = 'click' AND e.e % 4 = 0 THEN 302
       WHEN e.event_type = 'click' AND e.e % 4 = 1 THEN 304
       ELSE 200 END AS INTEGER) AS status_code,
  CASE WHEN e.event_type = 'purchase' THEN 'POST' WHEN e.e % 17 = 0 THEN 'HEAD' ELSE 'GET' END AS http_method,
  p.url AS url,
  CASE WHEN e.e % 41 = 0 THEN '/' WHEN e.e % 43 = 0 THEN NULL WHEN e.e % 47 = 0 THEN ''
       ELSE regexp_extract(p.url, '^https?://[^/]+(/[^?#]*)', 1) END AS url_path,
  rd.referrer_domain, gd.geo
FROM e
JOIN ua ON ua.ua_id = (e.u * 5 + (CASE WHEN e.e % 11 = 0 THEN 1 ELSE 0 END)) % 9
JOIN gd ON gd.geo_id = (e.u * e.u + CASE WHEN e.e % 5 = 0 THEN e.e ELSE 0 END) % 13
JOIN rd ON rd.ref_id = ((e.e % 17) * (e.e % 3)) % 17
LEFT JOIN pages p ON p.page_id = e.page_key)
"""

COUNTRIES = """
dim_country AS (SELECT * FROM (VALUES
  ('iran','IRN','Asia'),('united states of america','USA','North America'),('germany','DEU','Europe'),
  ('korea','KOR','Asia'),('france','FRA','Europe'),('brazil','BRA','South America'),
  ('singapore','SGP','Asia'),('antarctica','ATA',NULL)
) AS t(alias, iso3, continent))
"""

CITIES = """
dim_city AS (SELECT * FROM (VALUES
  ('Tehran','Iran',35.7::DOUBLE,51.4::DOUBLE),('Ashburn','United States',39.0,-77.5),
  ('Falkenstein','Germany',50.5,12.4),('Seoul','Korea, South',37.6,127.0),
  ('Paris','France',48.9,2.4),('Paris','United States',33.7,-95.5),
  ('Sao Paulo','Brazil',-23.6,-46.6)
) AS t(city, country, lat, lng))
"""

# what ISO 3166 says of the names in the log and the city file; a bare "Korea" is in no such table
ISO_NAMES = """
iso AS (SELECT * FROM (VALUES
  ('iran','IRN','Asia'),('united states of america','USA','North America'),('united states','USA','North America'),
  ('germany','DEU','Europe'),('france','FRA','Europe'),('brazil','BRA','South America'),
  ('singapore','SGP','Asia'),('antarctica','ATA',NULL)
) AS t(alias, iso3, continent))
"""

PERIOD = "CAST(timestamp_utc AS DATE) BETWEEN DATE '2024-01-05' AND DATE '2024-01-25'"
DAYS = "day BETWEEN DATE '2024-01-05' AND DATE '2024-01-25'"
NEWEST = "(SELECT max(timestamp_utc) FROM weblog)"
LAST_24H = f"timestamp_utc >= {NEWEST} - INTERVAL 24 HOUR"
BOTH_ENDS = f"{LAST_24H} AND timestamp_utc <= {NEWEST}"
KNOWN_GEO = "geo IS NOT NULL AND geo != '-' AND geo != ''"
RANKABLE = "url_path IS NOT NULL AND url_path != '' AND url_path != '/'"
HITS = "CAST(count(*) AS BIGINT)"
ROW = "timestamp_utc, ip, user_agent"

DIRECT = "(referrer_domain IS NULL OR referrer_domain = '')"
SOCIAL = (
    "(referrer_domain LIKE '%facebook.com%' OR referrer_domain LIKE '%instagram.com%'"
    " OR referrer_domain LIKE '%twitter.com%' OR referrer_domain LIKE '%linkedin.com%')"
)
SEARCH = (
    "(referrer_domain LIKE '%google.com%' OR referrer_domain LIKE '%naver.com%'"
    " OR referrer_domain LIKE '%daum.net%' OR referrer_domain LIKE '%bing.com%')"
)
LIKE_CHANNEL = (
    f"CASE WHEN {DIRECT} THEN 'direct' WHEN {SOCIAL} THEN 'social'"
    f" WHEN {SEARCH} THEN 'search' ELSE 'others' END"
)
_BASE = "array_to_string(list_slice(string_split(referrer_domain, '.'), -2, -1), '.')"
_SOCIAL_LIST = "['facebook.com','instagram.com','twitter.com','linkedin.com','t.co','fb.com','lnkd.in','social.com']"
_SEARCH_LIST = "['google.com','naver.com','daum.net','bing.com','yahoo.com','duckduckgo.com']"
_DIRECT_LIST = "('direct','(direct)','','zanbil.ir','znbl.ir','www.zanbil.ir','www.znbl.ir')"


def _list_channel(match: str) -> str:
    def any_of(names: str) -> str:
        return f"len(list_filter({names}, lambda s: {match})) > 0"

    return (
        f"CASE WHEN referrer_domain IS NULL OR referrer_domain IN {_DIRECT_LIST} THEN 'direct'"
        f" WHEN {any_of(_SOCIAL_LIST)} THEN 'social' WHEN {any_of(_SEARCH_LIST)} THEN 'search'"
        " ELSE 'others' END"
    )


LIST_CHANNEL = _list_channel(f"contains({_BASE}, s)")
EXACT_CHANNEL = _list_channel("referrer_domain = s OR suffix(referrer_domain, '.' || s)")

_PLAIN = r"regexp_replace(geo, '\s*\([^)]*\)', '', 'g')"
COUNTRY = f"trim(string_split({_PLAIN}, ',')[1])"
CITY = f"trim(string_split({_PLAIN}, ',')[2])"
GROUP = "CAST(floor(status_code / 100) * 100 AS INTEGER)"
CLASS = "CAST(CAST(floor(status_code / 100) AS INTEGER) AS VARCHAR) || 'xx'"

CUBE = f"""
base AS (SELECT {COUNTRY} AS country, {CITY} AS city, day, user_is_bot FROM weblog WHERE {KNOWN_GEO}),
cube AS (SELECT country, city, day, user_is_bot, {HITS} AS count FROM base GROUP BY ALL)
"""
LOCATED = f"""
{CUBE}, {COUNTRIES},
located AS (SELECT c.*, d.iso3 AS iso_alpha, d.continent
            FROM cube c JOIN dim_country d ON lower(c.country) = d.alias WHERE {DAYS})
"""
CLASSES = f"""
codes AS (SELECT status_code, {GROUP} AS status_group, {HITS} AS count FROM weblog WHERE {{}} GROUP BY ALL),
classes AS (SELECT {CLASS.replace('status_code', 'status_group')} AS status_class, status_group,
            CAST(sum(count) AS BIGINT) AS count FROM codes GROUP BY ALL)
"""
PERIOD_CLASSES, DAY_CLASSES = CLASSES.format(PERIOD), CLASSES.format(BOTH_ENDS)
LOG_VALUES = """
v AS (SELECT *, log10(greatest(1, count)) AS x FROM classes)
SELECT status_class, status_group, count,
  CASE WHEN min(x) OVER () < 1 THEN x - min(x) OVER () + 1 ELSE x END AS display_value FROM v
"""
HOURLY = f"""
hourly AS (SELECT CAST(hour(timestamp_utc) AS INTEGER) AS hour, {GROUP} AS status_group, {HITS} AS count
           FROM weblog WHERE {PERIOD} GROUP BY ALL),
spine AS (SELECT CAST(range AS INTEGER) AS hour FROM range(24))
"""
_CLASS_NAMES = ["1xx", "2xx", "3xx", "4xx", "5xx"]

LATEST = "latest AS (SELECT timestamp_utc, referrer_domain, url FROM weblog)"
FIRST_EVER = "f AS (SELECT ip, user_agent, min(timestamp_utc) AS first_time FROM weblog GROUP BY ip, user_agent)"
ENVIRONMENT = f"""
d AS (SELECT DISTINCT ip, user_agent, user_is_mobile, user_browser, user_os FROM weblog WHERE {PERIOD} {{}}),
env AS (SELECT user_browser, user_os, {HITS} AS total_visitors,
        CAST(count(*) FILTER (WHERE user_is_mobile) AS BIGINT) AS mobile_visitors,
        CAST(count(*) FILTER (WHERE NOT user_is_mobile) AS BIGINT) AS desktop_visitors
        FROM d GROUP BY user_browser, user_os)
"""
ALL_ENVIRONMENT = ENVIRONMENT.format("")
SEARCH_ROWS = (
    "ip, status_code, timestamp_utc AS timestamp, url, geo, http_method, user_agent,"
    " user_browser, user_os, user_is_mobile, user_is_bot"
)
SEARCH_TIME = (
    "timestamp_utc >= TIMESTAMP '2024-01-05 06:30:00'"
    " AND timestamp_utc <= TIMESTAMP '2024-01-25 18:15:59.999999'"
)
SEARCH_TIES = (
    "timestamp DESC NULLS LAST, ip NULLS FIRST, url NULLS FIRST, user_agent NULLS FIRST, status_code NULLS FIRST,"
    " geo NULLS FIRST, http_method NULLS FIRST, user_browser NULLS FIRST, user_os NULLS FIRST,"
    " user_is_mobile NULLS FIRST, user_is_bot NULLS FIRST"
)


def _agent(term: str) -> str:
    return f"(user_browser ILIKE '%{term}%' OR user_os ILIKE '%{term}%' OR user_agent ILIKE '%{term}%')"


def _found(where: str = "true", order: str = "", cap: int | None = None) -> str:
    return (
        f"found AS (SELECT {SEARCH_ROWS} FROM weblog WHERE {SEARCH_TIME} AND {where}"
        f" ORDER BY {order}{SEARCH_TIES}{f' LIMIT {cap}' if cap else ''})"
    )


def _sql(body: str, *tables: str) -> str:
    return "WITH " + ",\n".join([WEBLOG, *tables]) + "\n" + body


def _trailing_users(*more: str) -> str:
    return _sql(
        f"SELECT d.day, CAST(count(DISTINCT w.ip) AS BIGINT) AS users{''.join(more)}"
        f" FROM (SELECT DISTINCT day FROM weblog WHERE {DAYS}) d"
        " JOIN weblog w ON w.day BETWEEN d.day - 6 AND d.day GROUP BY d.day"
    )


def _counts(last: str, first: str) -> str:
    return (
        f"SELECT {HITS} AS total_visitors, CAST(count(*) FILTER (WHERE {last} = {first}) AS BIGINT) AS new_visitors,"
        f" CAST(count(*) FILTER (WHERE {last} != {first}) AS BIGINT) AS returning_visitors"
        " FROM p JOIN f ON p.ip = f.ip AND p.user_agent = f.user_agent"
    )


def _last_times(where: str) -> str:
    return (
        "p AS (SELECT ip, user_agent, max(timestamp_utc) AS last_time"
        f" FROM weblog WHERE {where} GROUP BY ip, user_agent)"
    )


PERIOD_VISITORS = _sql(
    _counts("CAST(p.last_time AS DATE)", "CAST(f.first_time AS DATE)"), FIRST_EVER, _last_times(PERIOD)
)
RECENT_VISITORS = _sql(_counts("p.last_time", "f.first_time"), FIRST_EVER, _last_times(LAST_24H))


def _named(condition: str, alias: str) -> str:
    return f"CAST(count(*) FILTER (WHERE {condition}) AS BIGINT) AS {alias}"


REFERRER_COUNTS = (
    f"{HITS} AS total_count, {_named(DIRECT, 'direct_count')}, {_named(SOCIAL, 'social_count')},"
    f" {_named(SEARCH, 'search_count')}"
)
OTHERS = "total_count - (direct_count + social_count + search_count) AS others_count"
DAILY_REFERRERS = f"""
daily AS (SELECT visit_date, direct_count, social_count, search_count, {OTHERS} FROM (
  SELECT CAST(timestamp_utc AS DATE) AS visit_date, {REFERRER_COUNTS} FROM weblog WHERE {PERIOD} GROUP BY 1))
"""
TOP_REFERRERS = f"""
best AS (SELECT referrer_domain, {HITS} AS count FROM weblog WHERE {PERIOD}
  AND referrer_domain IS NOT NULL AND referrer_domain != ''
  GROUP BY referrer_domain ORDER BY count DESC, referrer_domain LIMIT 10)
"""


def _trend() -> str:
    newest = "(SELECT date_trunc('hour', max(timestamp_utc)) FROM weblog)"
    return f"""
SELECT strftime(h, '%Y-%m-%d %H:00') AS hour_label, {HITS} AS count
FROM (SELECT date_trunc('hour', timestamp_utc) AS h FROM weblog
      WHERE timestamp_utc >= {newest} - INTERVAL 23 HOUR AND timestamp_utc < {newest})
GROUP BY h"""


PER_DAY = f"SELECT day, {HITS} AS traffic_sum FROM weblog WHERE {DAYS} GROUP BY day"
USERS = "CAST(count(DISTINCT ip) AS BIGINT)"
HOUR = "CAST(hour(timestamp_utc) AS INTEGER)"
AVG_PER_HOUR = f"""
SELECT hour_to_24, CAST(round(avg(n)) AS BIGINT) AS avg_traffic
FROM (SELECT day, {HOUR} AS hour_to_24, count(*) AS n FROM weblog WHERE {DAYS} GROUP BY ALL)
GROUP BY hour_to_24"""
CHANNEL_DISTRIBUTION = f"""
SELECT channel, count, CAST(count AS DOUBLE) / sum(count) OVER () * 100.0 AS share
FROM (SELECT {LIKE_CHANNEL} AS channel, {HITS} AS count FROM weblog WHERE {PERIOD} GROUP BY 1)"""
STATUS_GROUPS = f"SELECT {GROUP} AS status_group, {HITS} AS count FROM weblog WHERE {PERIOD} GROUP BY 1"


def _by_domain(channel: str) -> str:
    return f"""
SELECT referrer_domain, {channel} AS channel, {HITS} AS count
FROM weblog GROUP BY referrer_domain"""


def _top(column: str, source: str, where: str) -> str:
    return (
        f"SELECT {column}, {HITS} AS count FROM {source} WHERE {where}"
        f" GROUP BY {column} ORDER BY count DESC, {column} LIMIT 10"
    )


def _error_ips(low: int, high: int) -> str:
    return f"""
SELECT CAST(row_number() OVER (ORDER BY request_count DESC, ip NULLS LAST) AS INTEGER) AS rank, ip, request_count, geo
FROM (SELECT ip, {HITS} AS request_count, min(geo) AS geo FROM weblog
      WHERE {PERIOD} AND status_code BETWEEN {low} AND {high} GROUP BY ip)
ORDER BY rank LIMIT 10"""


def _page(number: int, size: int) -> str:
    return f"SELECT * FROM found ORDER BY {SEARCH_TIES} LIMIT {size} OFFSET {number * size}"


def _info(number: int, size: int) -> str:
    return f"""
SELECT {HITS} AS total_count, CAST(CASE WHEN count(*) > 0 THEN {number * size + 1} ELSE 0 END AS BIGINT) AS start_row,
  CAST(least({(number + 1) * size}, count(*)) AS BIGINT) AS end_row,
  CAST(ceil(count(*) / {size}) AS BIGINT) AS page_count FROM found"""


def _available(source: str) -> str:
    return f"""
SELECT c AS status_class, EXISTS (SELECT 1 FROM {source} s WHERE s.status_class = c) AS available
FROM (SELECT unnest({_CLASS_NAMES}) AS c)"""


def _cells(template: str) -> str:
    return ", ".join(template.format(group=int(c[0]) * 100, name=f'"{c}"') for c in _CLASS_NAMES)


ORACLE_SQL: dict[str, str] = {
    # sources and sinks
    "a1_run_sql": _sql(PER_DAY),
    "a2_stable_sample": _sql(
        "SELECT timestamp_utc, ip, user_agent, status_code FROM keyed"
        " ORDER BY md5(array_to_string([coalesce(length(x) || ':' || x, '-') FOR x IN keys], '|')),"
        " timestamp_utc, ip NULLS FIRST, user_agent NULLS FIRST, status_code NULLS FIRST LIMIT 500",
        "keyed AS (SELECT *, [CAST(epoch_us(timestamp_utc) AS VARCHAR), ip, user_agent, CAST(status_code AS VARCHAR)] AS keys"
        " FROM weblog)",
    ),
    "a3_open_table": _sql(f"SELECT http_method, {HITS} AS count FROM weblog GROUP BY http_method"),
    "a4_full_scan": _sql("SELECT * FROM weblog"),
    "a5_read_cities": _sql(
        "SELECT city, country, count(DISTINCT day) * CAST(1.5 AS DOUBLE) AS lat,"
        " count(DISTINCT day) * CAST(-2.5 AS DOUBLE) AS lng FROM base WHERE city IS NOT NULL GROUP BY city, country",
        CUBE,
    ),
    "a2_sample_rows": _sql(
        "SELECT least(count(*), 1000) AS n_rows, least(count(*), 1000) AS n_known FROM weblog"
    ),
    "a6_latest_rows": _sql(
        "SELECT * FROM latest ORDER BY timestamp_utc DESC, referrer_domain NULLS FIRST, url NULLS FIRST LIMIT 10000",
        LATEST,
    ),
    "a6_latest_rows_period": _sql(f"SELECT timestamp_utc, referrer_domain, url FROM weblog WHERE {PERIOD}"),
    "a7_export_records": _sql(
        "SELECT '{\"day\":\"' || day || '\",\"traffic_sum\":' || traffic_sum || '}' AS record FROM (" + PER_DAY + ")"
    ),
    "a7_export_records_nulls": _sql(
        "SELECT '{\"ip\":' || coalesce('\"' || ip || '\"', 'null') || ',\"user_os\":' || coalesce('\"' || user_os || '\"', 'null')"
        " || ',\"status_code\":' || coalesce(CAST(status_code AS VARCHAR), 'null') || '}' AS record FROM weblog"
    ),
    "a7_written_log": _sql(f"SELECT * FROM weblog WHERE {PERIOD}"),
    # date discovery, filters, projections
    "r1_log_dates": _sql("SELECT DISTINCT CAST(timestamp_utc AS DATE) AS date FROM weblog"),
    "r1_default_dates": _sql(
        "SELECT min(CAST(timestamp_utc AS DATE)) AS min_date, max(CAST(timestamp_utc AS DATE)) AS max_date FROM weblog"
    ),
    "r2_date_range": _sql(
        "SELECT min(CAST(timestamp_utc AS DATE)) AS min_date, max(CAST(timestamp_utc AS DATE)) AS max_date FROM weblog"
    ),
    "r2_cube_date_range": _sql(
        "SELECT min(day) AS min_date, max(day) AS max_date FROM cube"
        " WHERE lower(country) IN (SELECT alias FROM dim_country)",
        CUBE,
        COUNTRIES,
    ),
    "r3_day_filter": _sql(f"SELECT {ROW}, day FROM weblog WHERE {DAYS}"),
    "r3b_date_filter": _sql(f"SELECT {ROW} FROM weblog WHERE {PERIOD}"),
    "r3b_timestamp_filter": _sql(f"SELECT {ROW} FROM weblog WHERE {PERIOD}"),
    "r3c_open_start": _sql(f"SELECT {ROW} FROM weblog WHERE CAST(timestamp_utc AS DATE) <= DATE '2024-01-25'"),
    "r3c_open_end": _sql(f"SELECT {ROW} FROM weblog WHERE CAST(timestamp_utc AS DATE) >= DATE '2024-01-05'"),
    "r4_last_24h": _sql(f"SELECT {ROW} FROM weblog WHERE {BOTH_ENDS}"),
    "r5_known_geo": _sql(f"SELECT {ROW}, geo FROM weblog WHERE {KNOWN_GEO}"),
    "r6_rankable_paths": _sql(f"SELECT {ROW}, url_path FROM weblog WHERE {RANKABLE}"),
    "r7_with_referrer": _sql(
        f"SELECT {ROW}, referrer_domain FROM weblog WHERE referrer_domain IS NOT NULL AND referrer_domain != ''"
    ),
    "r8_device_all": _sql(f"SELECT {ROW}, user_is_mobile FROM weblog"),
    "r8_device_mobile": _sql(f"SELECT {ROW}, user_is_mobile FROM weblog WHERE user_is_mobile = TRUE"),
    "r8_device_desktop": _sql(f"SELECT {ROW}, user_is_mobile FROM weblog WHERE user_is_mobile = FALSE"),
    "r9_bot_membership": _sql(f"SELECT {ROW}, user_is_bot FROM weblog WHERE user_is_bot IN (TRUE)"),
    "r10_drop_null_keys": _sql(f"SELECT {ROW}, user_os FROM weblog WHERE ip IS NOT NULL AND user_os IS NOT NULL"),
    "r11_required_columns": _sql("SELECT timestamp_utc, referrer_domain, url FROM weblog"),
    "r12_renamed": _sql(f"SELECT day, {HITS} AS requests, {USERS} AS visitors FROM weblog WHERE {DAYS} GROUP BY day"),
    # traffic
    "t1_traffic_per_day": _sql(PER_DAY),
    "t1_from_rollup": _sql(PER_DAY),
    "t2_traffic_per_hour": _sql(f"SELECT {HOUR} AS hour_to_24, {HITS} AS traffic_sum FROM weblog WHERE {DAYS} GROUP BY 1"),
    "t3_traffic_avg_per_hour": _sql(AVG_PER_HOUR),
    "t3_from_rollup": _sql(AVG_PER_HOUR),
    "t4_users_from_sketches": _sql(
        f"SELECT day, {USERS} AS users, true AS within_margin FROM weblog WHERE {DAYS} GROUP BY day"
    ),
    "t4_trailing_users": _trailing_users(),
    "t4_trailing_users_from_sketches": _trailing_users(", true AS within_margin"),
    "v3_from_sketches": PERIOD_VISITORS.replace("SELECT " + HITS, "SELECT true AS within_margin, " + HITS),
    "t4_unique_users_per_day": _sql(f"SELECT day, {USERS} AS users FROM weblog WHERE {DAYS} GROUP BY day"),
    "t5_traffic_and_users": _sql(
        "SELECT t.day, t.traffic_sum, u.users FROM t LEFT JOIN u ON t.day = u.day",
        f"t AS ({PER_DAY})",
        f"u AS (SELECT day, {USERS} AS users FROM weblog WHERE {DAYS} GROUP BY day)",
    ),
    "t5_traffic_and_users_long": _sql(
        "SELECT day, 'traffic_sum' AS measure, traffic_sum AS value FROM t"
        f" UNION ALL SELECT day, 'users', {USERS} FROM weblog WHERE {DAYS} GROUP BY day",
        f"t AS ({PER_DAY})",
    ),
    "t6_hourly_trend": _sql(_trend()),
    "t6_from_rollup": _sql(_trend()),
    "t7_hourly_series": _sql(
        f"SELECT strptime(hour, '%Y-%m-%dT%H') AS ds, {HITS} AS y FROM weblog WHERE {DAYS} GROUP BY hour"
    ),
    # visitors
    "v1_first_visits": _sql(
        "SELECT ip, user_agent, min(CAST(timestamp_utc AS DATE)) AS first_visit_date FROM weblog GROUP BY ip, user_agent"
    ),
    "v1_streamed_first_visits": _sql("SELECT ip, user_agent, first_time AS first_visit_time FROM f", FIRST_EVER),
    "v1_first_visit_times": _sql("SELECT ip, user_agent, first_time AS first_visit_time FROM f", FIRST_EVER),
    "v1_first_seen_merged": _sql("SELECT ip, user_agent, first_time AS first_visit_time FROM f", FIRST_EVER),
    "v1_first_seen_added": _sql("SELECT ip, user_agent, first_time AS first_visit_time FROM f", FIRST_EVER),
    "v2_last_visits": _sql(
        "SELECT ip, user_agent, max(CAST(timestamp_utc AS DATE)) AS last_visit_date"
        f" FROM weblog WHERE {PERIOD} GROUP BY ip, user_agent"
    ),
    "v2_last_visit_times_24h": _sql(
        f"SELECT ip, user_agent, max(timestamp_utc) AS last_visit_time FROM weblog WHERE {LAST_24H} GROUP BY ip, user_agent"
    ),
    "v3_visitor_counts": PERIOD_VISITORS,
    "v3_from_first_seen": PERIOD_VISITORS,
    "v4_visitor_counts_24h": RECENT_VISITORS,
    "v4_from_first_seen": RECENT_VISITORS,
    "v3_from_stale_first_seen": PERIOD_VISITORS,
    "v4_from_stale_first_seen": RECENT_VISITORS,
    "v5_visitors_by_device": _sql(
        f"SELECT {HITS} AS total_visitors, {_named('user_is_mobile', 'mobile_visitors')},"
        f" {_named('NOT user_is_mobile', 'desktop_visitors')}"
        f" FROM (SELECT DISTINCT ip, user_agent, user_is_mobile FROM weblog WHERE {PERIOD})"
    ),
    "v6_daily_visitors": _sql(
        f"SELECT visit_date, {HITS} AS total_visitors, {_named('visit_date = first_visit', 'new_visitors')},"
        f" {_named('visit_date != first_visit', 'returning_visitors')}"
        " FROM (SELECT *, min(visit_date) OVER (PARTITION BY ip, user_agent) AS first_visit FROM d) GROUP BY visit_date",
        f"d AS (SELECT DISTINCT CAST(timestamp_utc AS DATE) AS visit_date, ip, user_agent FROM weblog WHERE {PERIOD})",
    ),
    "v6_daily_visitors_600_days": _sql(
        f"SELECT visit_date, {HITS} AS total_visitors, {_named('visit_date = first_visit', 'new_visitors')},"
        f" {_named('visit_date != first_visit', 'returning_visitors')}"
        " FROM (SELECT *, min(visit_date) OVER (PARTITION BY ip, user_agent) AS first_visit FROM d) GROUP BY visit_date",
        "s AS (SELECT ip, user_agent, DATE '2022-09-01' + CAST((day - DATE '2024-01-01') * 20"
        " + minute(timestamp_utc) % 20 AS INTEGER) AS visit_date FROM weblog)",
        "d AS (SELECT DISTINCT * FROM s WHERE visit_date BETWEEN DATE '2022-09-11' AND DATE '2024-05-02')",
    ),
    "v7_environment_all": _sql("SELECT * FROM env", ALL_ENVIRONMENT),
    "v7_environment_mobile": _sql("SELECT * FROM env", ENVIRONMENT.format("AND user_is_mobile = TRUE")),
    "v7_environment_desktop": _sql("SELECT * FROM env", ENVIRONMENT.format("AND user_is_mobile = FALSE")),
    "v8_device_distribution": _sql(
        "SELECT 'mobile' AS device, m AS visitors, CAST(m AS DOUBLE) / (m + d) * 100.0 AS share FROM s"
        " UNION ALL SELECT 'desktop', d, CAST(d AS DOUBLE) / (m + d) * 100.0 FROM s",
        ALL_ENVIRONMENT,
        "s AS (SELECT CAST(sum(mobile_visitors) AS BIGINT) AS m, CAST(sum(desktop_visitors) AS BIGINT) AS d FROM env)",
    ),
    "v9_browser_distribution": _sql(
        "SELECT user_browser, CAST(sum(total_visitors) AS BIGINT) AS visitors FROM env WHERE user_browser IS NOT NULL"
        " GROUP BY user_browser ORDER BY visitors DESC, user_browser LIMIT 5",
        ALL_ENVIRONMENT,
    ),
    "v10_os_distribution": _sql(
        "SELECT user_os, CAST(sum(total_visitors) AS BIGINT) AS visitors FROM env WHERE user_os IS NOT NULL"
        " GROUP BY user_os ORDER BY visitors DESC, user_os LIMIT 5",
        ALL_ENVIRONMENT,
    ),
    "v8_v9_v10_in_one_pass": _sql(
        "SELECT 'browser' AS dimension, user_browser AS value, CAST(sum(total_visitors) AS BIGINT) AS visitors"
        " FROM env WHERE user_browser IS NOT NULL GROUP BY user_browser"
        " UNION ALL SELECT 'os', user_os, CAST(sum(total_visitors) AS BIGINT) FROM env WHERE user_os IS NOT NULL GROUP BY user_os"
        " UNION ALL SELECT 'device', 'mobile', CAST(sum(mobile_visitors) AS BIGINT) FROM env"
        " UNION ALL SELECT 'device', 'desktop', CAST(sum(desktop_visitors) AS BIGINT) FROM env",
        ALL_ENVIRONMENT,
    ),
    # referrers
    "f1_channel_by_list": _sql(_by_domain(LIST_CHANNEL)),
    "f1_channel_by_list_exact": _sql(_by_domain(EXACT_CHANNEL)),
    "f2_channel_by_like": _sql(_by_domain(LIKE_CHANNEL)),
    "f3_filter_by_channel": _sql(
        f"SELECT * FROM (SELECT {ROW}, referrer_domain, {LIST_CHANNEL} AS channel FROM weblog WHERE {PERIOD})"
        " WHERE channel = 'social'"
    ),
    "f3_filter_all_channels": _sql(f"SELECT {ROW}, referrer_domain, {LIST_CHANNEL} AS channel FROM weblog"),
    "f4_referrer_counts": _sql(f"SELECT *, {OTHERS} FROM (SELECT {REFERRER_COUNTS} FROM weblog WHERE {PERIOD})"),
    "f4_referrer_count_others": _sql(
        f"SELECT {OTHERS.replace('others_count', 'count')} FROM (SELECT {REFERRER_COUNTS} FROM weblog WHERE {PERIOD})"
    ),
    "f5_daily_referrers": _sql("SELECT * FROM daily", DAILY_REFERRERS),
    "f6_channel_series": _sql(
        " UNION ALL ".join(
            f"SELECT visit_date, '{c}' AS channel, {c}_count AS count FROM daily"
            for c in ("direct", "social", "search", "others")
        ),
        DAILY_REFERRERS,
    ),
    "f6_channel_series_search": _sql(
        "SELECT visit_date, 'search' AS channel, search_count AS count FROM daily", DAILY_REFERRERS
    ),
    "f7_top_referrers": _sql(f"SELECT *, {LIST_CHANNEL} AS channel FROM best", TOP_REFERRERS),
    "f7_top_referrers_social": _sql(
        f"SELECT * FROM (SELECT *, {LIST_CHANNEL} AS channel FROM best) WHERE channel = 'social'", TOP_REFERRERS
    ),
    "f8_channel_distribution": _sql(CHANNEL_DISTRIBUTION),
    "f8_from_rollup": _sql(CHANNEL_DISTRIBUTION),
    "f9_top_paths": _sql(_top("url_path", "weblog", f"{PERIOD} AND {RANKABLE}")),
    "f9_top_paths_by_candidates": _sql(_top("url_path", "weblog", f"{PERIOD} AND {RANKABLE}")),
    "f10_top_paths_24h": _sql(_top("url_path", "weblog", f"{LAST_24H} AND {RANKABLE}")),
    "f11_daily_channel_pivot": _sql(
        "SELECT CAST(timestamp_utc AS DATE) AS visit_date, "
        + ", ".join(_named(f"channel = '{c}'", c) for c in ("direct", "social", "search", "others"))
        + f" FROM (SELECT *, {LIST_CHANNEL} AS channel FROM latest) GROUP BY 1",
        LATEST,
    ),
    "f12_top_domains": _sql(
        f"SELECT referrer_domain, {LIST_CHANNEL} AS channel, {HITS} AS count FROM latest"
        " WHERE referrer_domain IS NOT NULL GROUP BY referrer_domain ORDER BY count DESC, referrer_domain LIMIT 10",
        LATEST,
    ),
    "f13_channel_totals": _sql(f"SELECT {LIST_CHANNEL} AS channel, {HITS} AS count FROM latest GROUP BY 1", LATEST),
    "f14_top_urls": _sql(_top("url", "latest", "url IS NOT NULL"), LATEST),
    "f14_top_urls_by_candidates": _sql(_top("url", "latest", "url IS NOT NULL"), LATEST),
    "f15_sample_date_range": _sql(
        'SELECT min(CAST(timestamp_utc AS DATE)) AS "start", max(CAST(timestamp_utc AS DATE)) AS "end" FROM latest', LATEST
    ),
    # geography
    "g1_parsed_geo": _sql(
        f"SELECT timestamp_utc, geo, {COUNTRY} AS country, {CITY} AS city FROM weblog WHERE {KNOWN_GEO}"
    ),
    "g2_geo_cube": _sql("SELECT * FROM cube", CUBE),
    "g3_country_iso3": _sql(
        "SELECT c.country, d.iso3 AS iso_alpha, CAST(sum(c.count) AS BIGINT) AS count"
        " FROM cube c LEFT JOIN dim_country d ON lower(c.country) = d.alias GROUP BY ALL",
        CUBE,
        COUNTRIES,
    ),
    "g4_country_continent": _sql(
        "SELECT c.country, d.continent, CAST(sum(c.count) AS BIGINT) AS count"
        " FROM cube c LEFT JOIN dim_country d ON lower(c.country) = d.alias GROUP BY ALL",
        CUBE,
        COUNTRIES,
    ),
    "g5_cube_slice": _sql(f"SELECT * FROM cube WHERE {DAYS} AND user_is_bot IN (FALSE)", CUBE),
    "g6_country_counts": _sql(
        "SELECT iso_alpha, country, CAST(sum(count) AS BIGINT) AS count FROM located GROUP BY ALL", LOCATED
    ),
    "g7_continent_counts": _sql(
        "SELECT iso_alpha, continent, country, CAST(sum(count) AS BIGINT) AS count FROM located"
        " WHERE continent IS NOT NULL GROUP BY ALL",
        LOCATED,
    ),
    "g7_continent_totals": _sql(
        "SELECT continent, country, CAST(sum(count) AS BIGINT) AS count FROM located"
        " WHERE continent IS NOT NULL GROUP BY GROUPING SETS ((continent, country), (continent))",
        LOCATED,
    ),
    "g8_city_counts": _sql(
        "SELECT city, CAST(sum(count) AS BIGINT) AS count FROM located WHERE city IS NOT NULL GROUP BY city", LOCATED
    ),
    "g3_shipped_countries": _sql(
        "SELECT i.iso3 AS iso_alpha, c.country, CAST(sum(c.count) AS BIGINT) AS count"
        f" FROM cube c JOIN iso i ON lower(c.country) = i.alias WHERE {DAYS} GROUP BY ALL",
        CUBE,
        ISO_NAMES,
    ),
    "g4_shipped_continents": _sql(
        "SELECT i.continent, c.country, CAST(sum(c.count) AS BIGINT) AS count"
        f" FROM cube c JOIN iso i ON lower(c.country) = i.alias WHERE {DAYS} AND i.continent IS NOT NULL"
        " GROUP BY GROUPING SETS ((i.continent, c.country), (i.continent))",
        CUBE,
        ISO_NAMES,
    ),
    "g9_city_geocode_by_code": _sql(
        "SELECT c.city, c.count, c.country, d.lat, d.lng, c.count * CAST(1.5 AS DOUBLE) AS scaled_count"
        " FROM c LEFT JOIN iso i ON lower(c.country) = i.alias"
        " LEFT JOIN (SELECT * FROM dim_city LEFT JOIN iso ON lower(country) = alias) d"
        " ON c.city = d.city AND coalesce(i.iso3, lower(c.country)) = coalesce(d.iso3, lower(d.country))",
        CUBE,
        CITIES,
        ISO_NAMES,
        "c AS (SELECT city, country, CAST(sum(count) AS BIGINT) AS count FROM cube WHERE city IS NOT NULL GROUP BY ALL)",
    ),
    "g9_city_geocode": _sql(
        "SELECT c.city, c.count, d.country, d.lat, d.lng, c.count * CAST(1.5 AS DOUBLE) AS scaled_count"
        " FROM c LEFT JOIN dim_city d ON c.city = d.city",
        LOCATED,
        CITIES,
        "c AS (SELECT city, CAST(sum(count) AS BIGINT) AS count FROM located WHERE city IS NOT NULL GROUP BY city)",
    ),
    "g9_city_geocode_by_country": _sql(
        "SELECT c.city, c.count, c.country, d.lat, d.lng, c.count * CAST(1.5 AS DOUBLE) AS scaled_count"
        " FROM c LEFT JOIN dim_city d ON c.city = d.city AND c.country = d.country",
        CUBE,
        COUNTRIES,
        CITIES,
        "c AS (SELECT city, country, CAST(sum(count) AS BIGINT) AS count FROM cube WHERE city IS NOT NULL"
        " AND lower(country) IN (SELECT alias FROM dim_country) GROUP BY city, country)",
    ),
    "g10_country_counts_24h": _sql(
        "SELECT r.country, r.count, d.iso3 AS iso_alpha FROM r JOIN dim_country d ON lower(r.country) = d.alias",
        COUNTRIES,
        f"r AS (SELECT {COUNTRY} AS country, {HITS} AS count FROM weblog WHERE {KNOWN_GEO} AND {BOTH_ENDS} GROUP BY 1)",
    ),
    # statuses
    "h1_status_groups": _sql(STATUS_GROUPS),
    "h1_from_rollup": _sql(STATUS_GROUPS),
    "h1_status_headline": _sql(
        "SELECT "
        + ", ".join(_named(f"{GROUP} = {int(c[0]) * 100}", f'"{c}"') for c in _CLASS_NAMES[1:])
        + f" FROM weblog WHERE {PERIOD}"
    ),
    "h2_status_codes": _sql("SELECT * FROM codes", PERIOD_CLASSES),
    "h2_status_codes_24h": _sql("SELECT * FROM codes", DAY_CLASSES),
    "h3_status_classes": _sql("SELECT * FROM classes", PERIOD_CLASSES),
    "h4_status_details": _sql(
        f"SELECT {CLASS} AS status_class,"
        " string_agg(status_code || ': ' || format('{:,}', count), chr(10) ORDER BY status_code) AS details"
        " FROM codes GROUP BY 1",
        PERIOD_CLASSES,
    ),
    "h5_status_shares": _sql(
        "SELECT *, CAST(count AS DOUBLE) / sum(count) OVER () * 100.0 AS percentage FROM classes", PERIOD_CLASSES
    ),
    "h6_status_log_values": "WITH " + ",\n".join([WEBLOG, PERIOD_CLASSES, LOG_VALUES]),
    "h6_status_log_values_24h": "WITH " + ",\n".join([WEBLOG, DAY_CLASSES, LOG_VALUES]),
    "h7_hourly_statuses": _sql("SELECT * FROM hourly", HOURLY),
    "h8_hourly_status_table": _sql(
        "SELECT s.hour, "
        + _cells("CAST(coalesce(sum(h.count) FILTER (WHERE h.status_group = {group}), 0) AS BIGINT) AS {name}")
        + " FROM spine s LEFT JOIN hourly h ON s.hour = h.hour GROUP BY s.hour",
        HOURLY,
    ),
    "h9_hourly_status_percent": _sql(
        "SELECT s.hour, "
        + _cells(
            "CASE WHEN sum(h.count) > 0 THEN coalesce(sum(h.count) FILTER (WHERE h.status_group = {group}), 0)"
            " / CAST(sum(h.count) AS DOUBLE) * 100.0 ELSE 0.0 END AS {name}"
        )
        + " FROM spine s LEFT JOIN hourly h ON s.hour = h.hour GROUP BY s.hour",
        HOURLY,
    ),
    "h10_selected_classes": _sql(
        "SELECT * FROM classes WHERE status_class IN ('5xx', '2xx', '4xx')", PERIOD_CLASSES
    ),
    "h11_available_classes": _sql(_available("classes"), PERIOD_CLASSES),
    "h11_available_classes_24h": _sql(_available("classes"), DAY_CLASSES),
    "h12_error_ips_4xx": _sql(_error_ips(400, 499)),
    "h12_error_ips_5xx": _sql(_error_ips(500, 599)),
    "h12_error_ips_5xx_by_candidates": _sql(_error_ips(500, 599)),
    "h13_error_ips_by_class": _sql(
        f"SELECT '4xx' AS status_class, * FROM ({_error_ips(400, 499)})"
        f" UNION ALL SELECT '5xx', * FROM ({_error_ips(500, 599)})"
    ),
    # log search
    "l1_search_matches": _sql(
        f"SELECT {SEARCH_ROWS} FROM weblog WHERE {SEARCH_TIME} AND geo ILIKE '%IRAN%' AND {_agent('chrome')}"
    ),
    "l1_search_wildcard": _sql(
        f"SELECT {SEARCH_ROWS} FROM weblog WHERE {SEARCH_TIME} AND ip ILIKE '%10._.0%' AND url ILIKE '%HTTP%/%'"
    ),
    "l1_search_indexed": _sql(
        f"SELECT {SEARCH_ROWS} FROM weblog WHERE {SEARCH_TIME} AND ip ILIKE '%172.16.3%5%' AND {_agent('chrome')}"
    ),
    "l2_search_columns": _sql(f"SELECT {SEARCH_ROWS} FROM weblog"),
    "l3_sorted_by_os_desc": _sql(
        "SELECT * FROM found", _found("geo ILIKE '%iran%'", "user_os DESC NULLS LAST, ")
    ),
    "l3_sorted_by_status_asc": _sql(
        "SELECT * FROM found", _found(_agent("Windows"), "status_code ASC NULLS FIRST, ")
    ),
    "l3_unknown_column": _sql("SELECT * FROM found", _found("geo ILIKE '%germany%'")),
    "l4_capped_search": _sql("SELECT * FROM found", _found(cap=1000)),
    "l5_page": _sql(_page(3, 10), _found(_agent("chrome"))),
    "l5_last_page": _sql(_page(6, 150), _found()),
    "l5_next_page": _sql(_page(3, 10), _found(_agent("chrome"))),
    "l5_next_page_by_os": _sql(
        f"SELECT * FROM found ORDER BY user_os DESC NULLS LAST, {SEARCH_TIES} LIMIT 40 OFFSET 80", _found(_agent("opera"))
    ),
    "l5_page_info": _sql(_info(3, 10), _found(_agent("chrome"))),
    "l6_displayed": _sql(
        f"SELECT * REPLACE (strftime(timestamp, '%Y-%m-%d %H:%M:%S') AS timestamp) FROM ({_page(0, 50)})",
        _found("geo ILIKE '%iran%'"),
    ),
    # streaming: the hours that end at or before the newest request minus one hour
    "s1_streamed_hourly_counts": _sql(
        f"SELECT h AS window_start, h + INTERVAL 1 HOUR AS window_end, {HITS} AS traffic_sum, "
        + _cells("CAST(count(*) FILTER (WHERE g = {group}) AS BIGINT) AS {name}")
        + f" FROM (SELECT date_trunc('hour', timestamp_utc) AS h, {GROUP} AS g FROM weblog)"
        f" GROUP BY h HAVING h + INTERVAL 1 HOUR <= {NEWEST} - INTERVAL 1 HOUR"
    ),
    # every hour of the period, the last ones too, though none has closed behind them
    "s1_upserted_hourly_counts": _sql(
        f"SELECT CAST(h AS DATE) AS day, h AS window_start, h + INTERVAL 1 HOUR AS window_end, {HITS} AS traffic_sum, "
        + _cells("CAST(count(*) FILTER (WHERE g = {group}) AS BIGINT) AS {name}")
        + f" FROM (SELECT date_trunc('hour', timestamp_utc) AS h, {GROUP} AS g FROM weblog WHERE {DAYS}) GROUP BY h"
    ),
}
