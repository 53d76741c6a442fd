"""Requests per clock hour over a stream, with a watermark for late ones.

Two sinks: files that hold an hour once it has closed, and a table in which the open hours
stand too and are replaced as they grow.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from accesslens.functions.periods import DateLike
from accesslens.functions.statuses import STATUS_CLASSES, class_codes, status_group
from accesslens.operators.selection import on_days
from accesslens.schema import require_columns


def hourly_counts(requests: DataFrame, lateness: str = "1 hour") -> DataFrame:
    """`window_start, window_end, traffic_sum, 1xx, .., 5xx` per hour.

    Works on a stream or a batch. On a stream, requests older than the newest one
    minus `lateness` are dropped and an hour is emitted once that point has passed
    its end. State is a handful of counters per open hour, combined in each task
    before the shuffle.
    """
    require_columns(requests, ["timestamp_utc", "status_code"])
    group = status_group(F.col("status_code"))
    counters = [F.count_if(group == class_codes(c)[0]).alias(c) for c in STATUS_CLASSES]
    # event time must be a TIMESTAMP: a zone-less column cannot carry a watermark
    timed = requests.withColumn("timestamp_utc", F.col("timestamp_utc").cast("timestamp"))
    return (
        timed.withWatermark("timestamp_utc", lateness)
        .groupBy(F.window("timestamp_utc", "1 hour").alias("hour_window"))
        .agg(F.count(F.lit(1)).alias("traffic_sum"), *counters)
        .select(
            F.col("hour_window.start").alias("window_start"),
            F.col("hour_window.end").alias("window_end"),
            "traffic_sum",
            *STATUS_CLASSES,
        )
    )


def write_hourly_counts(
    requests: DataFrame, path: str, checkpoint: str, lateness: str = "1 hour"
) -> StreamingQuery:
    """Process what is available into Parquet files and stop.

    `path` and `checkpoint` must lie in storage all executors share: after a loss
    the run resumes from the checkpoint, and the file sink's log keeps each hour
    from appearing twice.
    """
    return (
        hourly_counts(requests, lateness)
        .writeStream.outputMode("append")
        .format("parquet")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start(path)
    )


def upsert_hours(hours: DataFrame, batch_id: int, path: str) -> None:
    """Put a batch of `hourly_counts` rows into the table at `path`.

    A batch owns one partition in each day that it touches and overwrites just these, so
    running it again, whole or after half of it was written, leaves the same table. What
    earlier batches wrote is never touched, so a failure cannot lose it. A day gets a
    partition per batch while its hours are open, and no more after that.
    """
    stamped = hours.withColumns({"day": F.to_date("window_start"), "batch_id": F.lit(batch_id).cast("bigint")})
    (
        stamped.coalesce(1)  # one row per hour that changed
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("day", "batch_id")
        .parquet(path)
    )


def write_hourly_upserts(
    requests: DataFrame, path: str, checkpoint: str, lateness: str = "1 hour"
) -> StreamingQuery:
    """Process what is available into the table that `upserted_hours` reads, and stop.

    Every hour with requests is there after each batch, the open ones included. `path` and
    `checkpoint` must lie in storage all executors share.
    """
    return (
        hourly_counts(requests, lateness)
        .writeStream.outputMode("update")
        .foreachBatch(lambda hours, batch_id: upsert_hours(hours, batch_id, path))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def upserted_hours(
    spark: SparkSession, path: str, start: DateLike | None = None, end: DateLike | None = None
) -> DataFrame:
    """The newest counts of each hour, `day` and the columns of `hourly_counts`.

    A batch has the whole counts of the hours it changed, so the row of the last batch is
    taken; of the days, only those within the bounds are read.
    """
    rows = on_days(spark.read.parquet(path), start, end)
    columns = [c for c in rows.columns if c not in ("day", "batch_id", "window_start")]
    newest = F.max_by(F.struct(*columns), "batch_id").alias("newest")
    return rows.groupBy("day", "window_start").agg(newest).select("day", "window_start", "newest.*")
