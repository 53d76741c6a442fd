"""Presentation helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def thousands(number: Column) -> Column:
    """1234567 -> ``1,234,567``."""
    return F.format_number(number, 0)


def clock_seconds(moment: Column) -> Column:
    return F.date_format(moment, "yyyy-MM-dd HH:mm:ss")


def hour_label(moment: Column) -> Column:
    return F.date_format(moment, "yyyy-MM-dd HH:00")
