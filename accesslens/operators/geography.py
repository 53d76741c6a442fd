"""Requests per country, continent and city.

The base is a small cube (country, city, day, bot flag); every view is a rollup
of it. Lookup tables are joined after aggregation and carry no broadcast hint:
Spark broadcasts them while their size is below its threshold and falls back to
a shuffle join beyond it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from accesslens.functions.measures import hits
from accesslens.functions.periods import DateLike
from accesslens.functions.places import city_of, country_of
from accesslens.operators.selection import (
    in_last_hours,
    on_days,
    with_known_geo,
    with_values,
    without_nulls,
)

CITY_SCALE = 1.5


def parsed_geo(log: DataFrame) -> DataFrame:
    """`log` with `country` and `city` taken from `geo`."""
    geo = F.col("geo")
    return log.withColumns({"country": country_of(geo), "city": city_of(geo)})


def geo_cube(log: DataFrame) -> DataFrame:
    """`country, city, day, user_is_bot, count` over rows with a known location.

    Requests are counted per raw `geo` text first. The regular expression then
    runs once per distinct text and day rather than once per request, and texts
    that parse alike are merged afterwards.
    """
    per_text = _per_geo_text(with_known_geo(log), log, "day", "user_is_bot")
    cube = per_text.groupBy("country", "city", "day", "user_is_bot")
    return cube.agg(F.sum("count").alias("count"))


def _per_geo_text(rows: DataFrame, log: DataFrame, *keys: str) -> DataFrame:
    """Requests per `geo` text and `keys`, with the text parsed.

    The parsed columns depend on the count, which is always positive. Without
    that, the optimizer would move filters on them (a known country, a present
    city) below the aggregation and parse every request's text again.
    """
    counted = parsed_geo(rows.groupBy("geo", *keys).agg(hits(log).alias("count")))
    held = {c: F.when(F.col("count") > 0, F.col(c)) for c in ("country", "city")}
    return counted.withColumns(held)


def ordered_geo_cube(log: DataFrame) -> DataFrame:
    """`geo_cube`, largest count first."""
    return geo_cube(log).orderBy(F.col("count").desc(), "country", "city", "day", "user_is_bot")


def with_country_info(df: DataFrame, countries: DataFrame) -> DataFrame:
    """Add `iso_alpha` and `continent` by country name; both NULL when unknown.

    `countries` has one row per alias, so the join keeps the number of rows.
    """
    info = countries.select(
        F.col("alias"), F.col("iso3").alias("iso_alpha"), F.col("continent")
    )
    return df.join(info, F.lower(df["country"]) == info["alias"], "left").drop("alias")


def located(cube: DataFrame, countries: DataFrame) -> DataFrame:
    """Cube rows whose country is known, with `iso_alpha` and `continent`."""
    return without_nulls(with_country_info(cube, countries), "iso_alpha")


def cube_date_range(cube: DataFrame) -> DataFrame:
    """`min_date, max_date` of a (located) cube."""
    return cube.agg(F.min("day").alias("min_date"), F.max("day").alias("max_date"))


def cube_slice(
    cube: DataFrame, start: DateLike | None, end: DateLike | None, bots: Sequence[bool]
) -> DataFrame:
    """Cube rows of the days and of the chosen kinds of user."""
    return with_values(on_days(cube, start, end), "user_is_bot", bots)


def country_counts(cube: DataFrame) -> DataFrame:
    """`iso_alpha, country, count` from a located cube."""
    return cube.groupBy("iso_alpha", "country").agg(F.sum("count").alias("count"))


def continent_counts(cube: DataFrame) -> DataFrame:
    """`iso_alpha, continent, country, count`; countries without a continent are left out."""
    known = without_nulls(cube, "continent", "country")
    return known.groupBy("iso_alpha", "continent", "country").agg(F.sum("count").alias("count"))


def continent_totals(cube: DataFrame) -> DataFrame:
    """`continent, country, count` with a NULL country in each continent's total row."""
    known = without_nulls(cube, "continent", "country")
    rolled = known.rollup("continent", "country").agg(F.sum("count").alias("count"))
    return rolled.where(F.col("continent").isNotNull())


def city_counts(cube: DataFrame) -> DataFrame:
    """`city, count` from a located cube; rows without a city are left out."""
    return without_nulls(cube, "city").groupBy("city").agg(F.sum("count").alias("count"))


def geocoded(
    counts: DataFrame,
    cities: DataFrame,
    match_country: bool = False,
    countries: DataFrame | None = None,
) -> DataFrame:
    """City counts with `lat, lng` and `scaled_count`.

    Cities match by name only, so a name listed twice yields two rows and an
    unlisted one has NULL coordinates. `match_country=True` also compares the
    country, which `counts` must then carry. Logs and city files name countries
    differently: with `countries` both names are looked up there and their codes
    compared; a name it lacks is compared as it stands, in any letter case.
    """
    places = cities.select("city", "country", "lat", "lng")
    if match_country and countries is not None:
        places = _with_country_key(places.withColumnRenamed("country", "listed"), "listed", countries).drop("listed")
        joined = _with_country_key(counts, "country", countries).join(places, ["city", "country_key"], "left")
    else:
        joined = counts.join(places, ["city", "country"] if match_country else ["city"], "left")
    return joined.withColumn("scaled_count", F.col("count") * F.lit(CITY_SCALE)).select(
        "city", "count", "country", "lat", "lng", "scaled_count"
    )


def _with_country_key(df: DataFrame, column: str, countries: DataFrame) -> DataFrame:
    """`country_key`: the code of a country, or its own name where it is unknown."""
    codes = countries.select(F.col("alias").alias("known_alias"), F.col("iso3").alias("known_code"))
    name = F.lower(F.trim(column))
    found = df.join(codes, name == F.col("known_alias"), "left")
    return found.withColumn("country_key", F.coalesce("known_code", name)).drop("known_alias", "known_code")


def country_counts_24h(
    log: DataFrame, countries: DataFrame, hours: int = 24, anchor=None
) -> DataFrame:
    """`country, count, iso_alpha` over the trailing hours, largest first."""
    recent = with_known_geo(in_last_hours(log, hours, anchor))
    per_text = _per_geo_text(recent, log)
    counted = per_text.groupBy("country").agg(F.sum("count").alias("count"))
    return (
        located(counted, countries)
        .select("country", "count", "iso_alpha")
        .orderBy(F.col("count").desc(), "country")
    )
