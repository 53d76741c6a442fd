"""Country lookup: name or code -> ISO-3166 alpha-3 code and continent."""

from __future__ import annotations

import functools

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from accesslens.schema import COUNTRY_SCHEMA

# ISO and everyday names that differ from the English display name.
EXTRA_NAMES = {
    "BN": ["brunei darussalam"],
    "BO": ["bolivia, plurinational state of"],
    "CD": ["congo, the democratic republic of the"],
    "CG": ["congo"],
    "CI": ["ivory coast", "cote d'ivoire"],
    "CV": ["cape verde", "cabo verde"],
    "CZ": ["czech republic"],
    "FM": ["micronesia, federated states of"],
    "GB": ["great britain", "united kingdom of great britain and northern ireland"],
    "HK": ["hong kong"],
    "IR": ["iran, islamic republic of"],
    "KP": ["korea, democratic people's republic of"],
    "KR": ["korea, republic of"],
    "LA": ["lao people's democratic republic"],
    "MD": ["moldova, republic of"],
    "MK": ["macedonia"],
    "MM": ["myanmar", "burma"],
    "MO": ["macao", "macau"],
    "PS": ["palestine", "palestine, state of"],
    "RU": ["russian federation"],
    "SY": ["syrian arab republic"],
    "SZ": ["swaziland"],
    "TR": ["turkey"],
    "TW": ["taiwan, province of china"],
    "TZ": ["tanzania, united republic of"],
    "US": ["united states of america"],
    "VA": ["holy see"],
    "VE": ["venezuela, bolivarian republic of"],
    "VN": ["viet nam"],
}

# UN M.49 area codes.
CONTINENT_OF_AREA = {"002": "Africa", "142": "Asia", "150": "Europe", "009": "Oceania"}
AMERICAS, SOUTH_AMERICA = "019", "005"
OUTLYING = "QO"


def read_countries(spark: SparkSession, path: str) -> DataFrame:
    """Country table (`alias, iso3, continent`) from a CSV file with a header."""
    raw = spark.read.csv(path, header=True, inferSchema=False)
    return raw.select(
        F.lower("alias").alias("alias"), *[F.col(f.name) for f in COUNTRY_SCHEMA.fields[1:]]
    )


def country_table(spark: SparkSession) -> DataFrame:
    """Country table derived from the locale data that ships with Spark.

    Codes, English names and the UN M.49 containment of each territory come from
    the ICU library on Spark's class path. Uninhabited outlying territories such
    as Antarctica have no continent. The table has about a thousand short rows
    (four aliases for each of the 249 territories).
    """
    table = pa.Table.from_pylist(
        list(_icu_rows(spark)), schema=pa.schema([(c, pa.string()) for c in COUNTRY_SCHEMA.names])
    )
    return spark.createDataFrame(table)


@functools.lru_cache(maxsize=1)
def _icu_rows(spark: SparkSession) -> tuple[dict, ...]:
    jvm = spark._jvm
    locale, region = jvm.com.ibm.icu.util.ULocale, jvm.com.ibm.icu.util.Region
    rows = {}
    for code in jvm.java.util.Locale.getISOCountries():
        territory = region.getInstance(code)
        iso3 = locale.getISO3Country(f"und_{code}")
        name = locale.getDisplayCountry(f"und_{code}", "en")
        row = {"iso3": iso3, "continent": _continent(territory)}
        numeric = f"{territory.getNumericCode():03d}"
        aliases = [code, iso3, numeric, name, name.replace("&", "and"), *EXTRA_NAMES.get(code, [])]
        for alias in aliases:
            rows.setdefault(alias.lower(), row)
    return tuple({"alias": alias, **row} for alias, row in rows.items())


def _continent(territory) -> str | None:
    areas = []
    area = territory.getContainingRegion()
    while area is not None:
        areas.append(area.toString())
        area = area.getContainingRegion()
    if OUTLYING in areas:
        return None
    if AMERICAS in areas:
        return "South America" if SOUTH_AMERICA in areas else "North America"
    return next((CONTINENT_OF_AREA[a] for a in areas if a in CONTINENT_OF_AREA), None)
