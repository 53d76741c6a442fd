"""Sinks: day-partitioned tables and record exports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_days(df: DataFrame, path: str, *order: str, fmt: str = "parquet") -> None:
    """Write a table partitioned by its `day` column.

    REBALANCE sizes the output by bytes: a day far larger than the others is split
    over several tasks and files instead of filling one. With dynamic partition
    overwrite a rerun replaces exactly the days it contains.
    """
    (
        df.hint("rebalance", F.col("day"))
        .sortWithinPartitions("day", *order)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("day")
        .format(fmt)
        .save(path)
    )


def write_log(log: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Write requests partitioned by `day`, in time order within each file.

    `day` is recomputed from the timestamp, so a filter on either one selects the
    same rows. Time order keeps the timestamp ranges of row groups narrow.
    """
    dated = log.withColumn("day", F.to_date("timestamp_utc"))
    write_days(dated, path, "timestamp_utc", fmt=fmt)


def as_records(df: DataFrame) -> DataFrame:
    """One JSON object per row, in column `record`; NULL fields keep their key."""
    return df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("record"))
