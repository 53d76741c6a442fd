"""Parsing of `geo` values such as ``Iran (Islamic Republic of), Tehran``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BLANKS = " \t\n\r\f\v"


def is_known_geo(geo: Column) -> Column:
    return geo.isNotNull() & ~geo.isin("-", "")


def _part(geo: Column, index: int) -> Column:
    plain = F.regexp_replace(geo, r"\s*\([^)]*\)", "")
    return F.btrim(F.get(F.split(plain, ","), F.lit(index)), F.lit(BLANKS))


def country_of(geo: Column) -> Column:
    """Text before the first comma, without parenthesised qualifiers."""
    return _part(geo, 0)


def city_of(geo: Column) -> Column:
    """Text between the first and second comma; NULL when there is no comma."""
    return _part(geo, 1)
