"""A maintained table of first visits, so that visitor counts need not read all history.

The table is append-only and bucketed by visitor. A day's upkeep shuffles that
day's visitors only: `first_seen_additions` finds the rows to add and
`append_first_seen` adds them. A visitor may have several rows when requests
arrive out of order; the smallest time counts, which `settled` and the visitor
operators take care of without a shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from accesslens.operators.visitors import first_visit_times, settled
from accesslens.schema import VISITOR_KEY


def merge_first_seen(first_seen: DataFrame, new_requests: DataFrame) -> DataFrame:
    """The whole `first_seen` brought up to date with further requests.

    The minimum is taken over both inputs, so requests may arrive late, out of
    order or twice.
    """
    arrivals = first_visit_times(new_requests)
    return settled(first_seen.select(*arrivals.columns).unionByName(arrivals))


def first_seen_additions(first_seen: DataFrame, new_requests: DataFrame) -> DataFrame:
    """Visitors of `new_requests` that are unknown, or known from a later time only.

    Visitors with a NULL key part, few rows of both tables, are matched apart: a
    null-safe join of all visitors could not use the table's buckets.
    """
    known = settled(first_seen).withColumnRenamed("first_visit_time", "known_time")
    arrivals = first_visit_times(new_requests)
    whole = F.lit(True)
    for column in VISITOR_KEY:
        whole = whole & F.col(column).isNotNull()
    found = arrivals.where(whole).join(known.where(whole), VISITOR_KEY, "left")
    partly, known_partly = arrivals.where(~whole).alias("a"), known.where(~whole).alias("k")
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"k.{c}")) for c in VISITOR_KEY]
    found = found.unionByName(partly.join(known_partly, same, "left").select("a.*", "known_time"))
    earlier = F.col("known_time").isNull() | (F.col("first_visit_time") < F.col("known_time"))
    return found.where(earlier).drop("known_time")


def save_first_seen(first_seen: DataFrame, table: str, buckets: int) -> None:
    """Save as a new table bucketed by visitor, which later joins need not shuffle.

    With as many buckets as the later jobs' shuffle partitions, the shuffle that
    aggregates a period's visits matches the table and the join adds none.
    """
    _write(first_seen, table, "error", buckets)


def append_first_seen(additions: DataFrame, table: str) -> None:
    """Add `first_seen_additions` to the table, in as many buckets as it has."""
    described = additions.sparkSession.sql(f"DESCRIBE EXTENDED {table}")
    buckets = described.where("col_name = 'Num Buckets'").first().data_type
    _write(additions, table, "append", int(buckets))


def _write(rows: DataFrame, table: str, mode: str, buckets: int) -> None:
    # spread by bucket first: one file per bucket, not one per task and bucket
    (
        rows.repartition(buckets, *VISITOR_KEY)
        .write.bucketBy(buckets, *VISITOR_KEY)
        .sortBy(*VISITOR_KEY)
        .mode(mode)
        .format("parquet")
        .saveAsTable(table)
    )
