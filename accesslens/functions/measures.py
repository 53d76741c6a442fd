"""Request counts over raw logs and over rollups alike.

A raw log has one row per request. A rollup (`accesslens.plans.rollups`) has one
row per group and carries the number of requests in `hits`. Counting through
these helpers lets the same operator run on either.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


#: How exact the times of a table are, finest first.
GRAINS = ("exact", "hour", "day")


def grain_of(log: DataFrame) -> str | None:
    """`exact` for a raw log, the grain of a rollup, None for one that does not tell.

    The grain is metadata of `hits`, which Spark keeps in the files and the catalog: it is
    known before anything is read.
    """
    if "hits" not in log.columns:
        return "exact"
    return log.schema["hits"].metadata.get("grain")


def with_grain(rollup: DataFrame, grain: str) -> DataFrame:
    """A rollup that came from elsewhere, with its grain told."""
    if grain not in GRAINS:
        raise ValueError(f"unknown grain: {grain}")
    return rollup.withMetadata("hits", {**rollup.schema["hits"].metadata, "grain": grain})


def require_grain(log: DataFrame, needed: str) -> DataFrame:
    """Return `log` unchanged, or raise `ValueError` where its times are too coarse for the operator."""
    grain = grain_of(log)
    if grain not in GRAINS:
        raise ValueError("a rollup without a known grain: name it with measures.with_grain")
    if GRAINS.index(grain) > GRAINS.index(needed):
        raise ValueError(f"times by {grain} are too coarse: this needs {needed} ones")
    return log


def hits(log: DataFrame) -> Column:
    """Number of requests."""
    if "hits" in log.columns:
        return F.coalesce(F.sum("hits"), F.lit(0).cast("bigint"))
    return F.count(F.lit(1))


def hits_if(log: DataFrame, condition: Column) -> Column:
    """Number of requests for which `condition` is true (NULL counts as false)."""
    if "hits" in log.columns:
        return F.coalesce(F.sum(F.when(condition, F.col("hits"))), F.lit(0).cast("bigint"))
    return F.count_if(condition)


def share_pct(count: str) -> Column:
    """Percent of the column's total.

    The window spans the whole input, so apply it to aggregated rows only (one
    per channel or status class), never to requests.
    """
    return F.col(count).cast("double") / F.sum(count).over(Window.partitionBy()) * F.lit(100.0)
