"""Column builders on hand-written values."""

import pytest
from conftest import tuples
from pyspark.sql import functions as F

from accesslens.functions.channels import channel_by_like, channel_by_list
from accesslens.functions.display import thousands
from accesslens.functions.places import city_of, country_of, is_known_geo
from accesslens.functions.statuses import log_display, status_class, status_group

# domain, by list, by exact list, by pattern
DOMAINS = [
    (None, "direct", "direct", "direct"),
    ("", "direct", "direct", "direct"),
    ("direct", "direct", "direct", "others"),
    ("(direct)", "direct", "direct", "others"),
    ("zanbil.ir", "direct", "direct", "others"),
    ("www.znbl.ir", "direct", "direct", "others"),
    ("blog.zanbil.ir", "others", "others", "others"),
    ("m.facebook.com", "social", "social", "social"),
    ("t.co", "social", "social", "others"),
    ("www.microsoft.com", "social", "others", "others"),
    ("reddit.com", "social", "others", "others"),
    ("pinterest.com", "social", "others", "others"),
    ("lnkd.in", "social", "social", "others"),
    ("www.google.com", "search", "search", "search"),
    ("www.google.co.uk", "others", "others", "others"),
    ("WWW.GOOGLE.COM", "others", "others", "others"),
    ("duckduckgo.com", "search", "search", "others"),
    ("search.yahoo.com", "search", "search", "others"),
    ("facebook.com.google.com", "search", "search", "social"),
    ("google.com.evil.net", "others", "others", "search"),
    ("localhost", "others", "others", "others"),
    ("torob.com", "others", "others", "others"),
    ("trailing.google.com.", "others", "others", "search"),
]


def test_channels(spark):
    df = spark.createDataFrame([(d[0],) for d in DOMAINS], "domain string")
    domain = F.col("domain")
    found = df.select(
        domain,
        channel_by_list(domain),
        channel_by_list(domain, mode="exact"),
        channel_by_like(domain),
    )
    assert tuples(found) == DOMAINS


def test_own_sites_are_a_parameter(spark):
    df = spark.createDataFrame([("shop.example",), ("zanbil.ir",)], "domain string")
    found = df.select(channel_by_list(F.col("domain"), own_sites=["shop.example"]))
    assert tuples(found) == [("direct",), ("others",)]


def test_unknown_mode():
    with pytest.raises(ValueError):
        channel_by_list(F.lit("x"), mode="fuzzy")


GEOS = [
    ("Iran (Islamic Republic of), Tehran", True, "Iran", "Tehran"),
    ("Korea (Republic of) , Seoul ", True, "Korea", "Seoul"),
    ("A (b) (c), D (e), F", True, "A", "D"),
    ("Singapore", True, "Singapore", None),
    ("Tab\t(x),\tCity\n", True, "Tab", "City"),
    ("Trailing,", True, "Trailing", ""),
    ("Open (paren, City", True, "Open (paren", "City"),
    ("-", False, "-", None),
    ("", False, "", None),
    (None, False, None, None),
]


def test_places(spark):
    df = spark.createDataFrame([(g[0],) for g in GEOS], "geo string")
    geo = F.col("geo")
    assert tuples(df.select(geo, is_known_geo(geo), country_of(geo), city_of(geo))) == GEOS


def test_status_labels(spark):
    df = spark.createDataFrame([(100,), (199,), (404,), (599,), (None,)], "code int")
    code = F.col("code")
    assert tuples(df.select(status_group(code), status_class(code))) == [
        (100, "1xx"), (100, "1xx"), (400, "4xx"), (500, "5xx"), (None, None),
    ]


@pytest.mark.parametrize(
    "counts, expected",
    [
        ([1000, 10], [3.0, 1.0]),  # smallest is 1: unchanged
        ([1000, 1], [4.0, 1.0]),  # smallest is 0: shifted up by one
        ([0, 100], [1.0, 3.0]),  # zero is raised to one first
    ],
)
def test_log_display(spark, counts, expected):
    df = spark.createDataFrame([(c,) for c in counts], "n long")
    found = {r[0]: r[1] for r in tuples(df.select("n", log_display("n")))}
    assert [pytest.approx(found[c]) for c in counts] == expected


def test_thousands(spark):
    assert tuples(spark.range(1).select(thousands(F.lit(1234567)))) == [("1,234,567",)]
