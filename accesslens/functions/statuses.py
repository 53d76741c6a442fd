"""HTTP status classes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.window import Window

STATUS_CLASSES = ["1xx", "2xx", "3xx", "4xx", "5xx"]


def status_group(code: Column) -> Column:
    """404 -> 400."""
    return (F.floor(code / 100) * 100).cast("int")


def status_class(code: Column) -> Column:
    """404 (or 400) -> ``4xx``."""
    return F.concat(F.floor(code / 100).cast("string"), F.lit("xx"))


def class_codes(name: str) -> tuple[int, int]:
    """``4xx`` -> (400, 499)."""
    first = int(name[0]) * 100
    return first, first + 99


def log_display(count: str) -> Column:
    """log10 of the count, shifted to start at 1 when the smallest would be below 1.

    Windows over all rows: for aggregated input only.
    """
    value = F.log10(F.greatest(F.lit(1), F.col(count)))
    smallest = F.min(value).over(Window.partitionBy())
    return F.when(smallest < 1, value - smallest + 1).otherwise(value)
