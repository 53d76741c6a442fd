import datetime as dt

import pytest
from conftest import moment, tuples
from pyspark.sql import functions as F

from accesslens.streaming.hourly import (
    hourly_counts,
    upsert_hours,
    upserted_hours,
    write_hourly_counts,
    write_hourly_upserts,
)

SCHEMA = "timestamp_utc timestamp, status_code int"


def put(spark, folder, *rows):
    """Add one file with the given (time, status) rows to a source folder."""
    values = [(moment(f"2024-01-01 {at}"), code) for at, code in rows]
    spark.createDataFrame(values, SCHEMA).coalesce(1).write.mode("append").parquet(folder)


def run(spark, source, out, checkpoint):
    stream = spark.readStream.schema(SCHEMA).parquet(source)
    query = write_hourly_counts(stream, out, checkpoint)
    query.awaitTermination()
    found = spark.read.parquet(out).orderBy("window_start")
    return [(r.window_start.hour, r.traffic_sum) for r in found.collect()]


def test_hours_close_behind_the_watermark(spark, tmp_path):
    source, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "checkpoint"))
    put(spark, source, ("05:10:00", 200), ("05:50:00", 404), ("06:30:00", 200))
    # newest 06:30, watermark 05:30: no hour has ended before it
    assert run(spark, source, out, checkpoint) == []
    put(spark, source, ("05:59:00", 500), ("07:10:00", 200))
    # late but not too late, then watermark 06:10 closes hour 5
    assert run(spark, source, out, checkpoint) == [(5, 3)]
    put(spark, source, ("05:00:00", 200), ("08:30:00", 200))
    # too late for hour 5: dropped; hour 6 closes
    assert run(spark, source, out, checkpoint) == [(5, 3), (6, 1)]
    # nothing new: a restart from the checkpoint adds nothing
    assert run(spark, source, out, checkpoint) == [(5, 3), (6, 1)]


def test_batch_form_lists_every_hour(spark):
    rows = [("05:10:00", 200), ("05:50:00", 404), ("06:30:00", 100)]
    batch = spark.createDataFrame([(moment(f"2024-01-01 {a}"), c) for a, c in rows], SCHEMA)
    for kind in ("timestamp", "timestamp_ntz"):
        typed = batch.withColumn("timestamp_utc", F.col("timestamp_utc").cast(kind))
        found = hourly_counts(typed).orderBy("window_start")
        assert tuples(found) == [
            (dt.datetime(2024, 1, 1, 5), dt.datetime(2024, 1, 1, 6), 2, 0, 1, 0, 1, 0),
            (dt.datetime(2024, 1, 1, 6), dt.datetime(2024, 1, 1, 7), 1, 1, 0, 0, 0, 0),
        ]


def test_required_columns(spark):
    with pytest.raises(ValueError, match="status_code"):
        hourly_counts(spark.range(1).select(F.current_timestamp().alias("timestamp_utc")))


def upserted(spark, source, out, checkpoint):
    stream = spark.readStream.schema(SCHEMA).parquet(source)
    write_hourly_upserts(stream, out, checkpoint).awaitTermination()
    found = upserted_hours(spark, out).orderBy("window_start")
    return [(r.window_start.hour, r.traffic_sum, r["2xx"]) for r in found.collect()]


def test_open_hours_are_replaced_as_they_grow(spark, tmp_path):
    source, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "checkpoint"))
    put(spark, source, ("05:10:00", 200), ("05:50:00", 404), ("06:30:00", 200))
    assert upserted(spark, source, out, checkpoint) == [(5, 2, 1), (6, 1, 1)]
    put(spark, source, ("05:59:00", 500), ("07:10:00", 200), ("06:31:00", 200))
    assert upserted(spark, source, out, checkpoint) == [(5, 3, 1), (6, 2, 2), (7, 1, 1)]
    put(spark, source, ("05:00:00", 200), ("08:30:00", 200))  # too late for hour 5
    after = [(5, 3, 1), (6, 2, 2), (7, 1, 1), (8, 1, 1)]
    assert upserted(spark, source, out, checkpoint) == after
    assert upserted(spark, source, out, checkpoint) == after


def test_a_replayed_batch_changes_nothing(spark, tmp_path):
    out = str(tmp_path / "out")
    rows = [("05:10:00", 200), ("05:50:00", 404), ("23:50:00", 100)]
    batch = spark.createDataFrame([(moment(f"2024-01-0{d} {a}"), c) for d in (1, 2) for a, c in rows], SCHEMA)
    first, grown = hourly_counts(batch.where("status_code > 200")), hourly_counts(batch)
    upsert_hours(first, 3, out)
    upsert_hours(grown, 4, out)
    before = sorted(tuples(upserted_hours(spark, out)))
    files = spark.read.parquet(out).inputFiles()
    assert len(before) == 4 and sum(r[3] for r in before) == 6
    upsert_hours(grown, 4, out)  # again
    upsert_hours(grown.where("day(window_start) = 1"), 4, out)  # and cut off after its first day
    assert sorted(tuples(upserted_hours(spark, out))) == before
    assert len(spark.read.parquet(out).inputFiles()) == len(files)
    (day,) = {r.day for r in upserted_hours(spark, out, "2024-01-02", None).collect()}
    assert day == dt.date(2024, 1, 2)
