import pytest
from conftest import moment, tuples
from pyspark.sql import functions as F

from accesslens.operators.visitors import first_visit_times
from accesslens.streaming.first_visits import first_visit_additions, streamed_first_visits, write_first_visits

SCHEMA = "ip string, user_agent string, timestamp_utc timestamp"


def put(spark, folder, *rows):
    values = [(ip, agent, moment(f"2024-01-{at}")) for ip, agent, at in rows]
    spark.createDataFrame(values, SCHEMA).repartition(2).write.mode("append").parquet(folder)


def run(spark, folders, **kw):
    source, out, checkpoint = folders
    stream = spark.readStream.schema(SCHEMA).parquet(source)
    write_first_visits(stream, out, checkpoint, **kw).awaitTermination()
    found = tuples(streamed_first_visits(spark, out))
    assert sorted(found, key=repr) == sorted(tuples(first_visit_times(spark.read.parquet(source))), key=repr)
    return spark.read.parquet(out).count()


@pytest.fixture
def folders(tmp_path):
    return [str(tmp_path / n) for n in ("in", "out", "checkpoint")]


def test_stream_agrees_with_batch_after_restarts_and_with_late_rows(spark, folders):
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    hot = [("hot", "x", f"05 {h:02d}:00:00") for h in range(24)] * 20
    put(spark, folders[0], *hot, ("a", "x", "05 10:00:00"), (None, "x", "05 11:00:00"), ("a", None, "05 12:00:00"))
    assert run(spark, folders) == 4
    put(spark, folders[0], ("a", "x", "06 10:00:00"), ("b", "x", "06 10:00:00"), (None, "x", "04 11:00:00"))
    assert run(spark, folders) == 6  # b, and an earlier request without an address
    put(spark, folders[0], ("hot", "x", "01 00:00:00"), ("b", "x", "06 10:00:00"))
    assert run(spark, folders) == 7  # late, and repeated
    assert run(spark, folders) == 7  # nothing new: a restart adds nothing
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass") == before


def test_forgotten_visitors_only_add_later_rows(spark, folders):
    put(spark, folders[0], ("a", "x", "05 10:00:00"))
    assert run(spark, folders, remember_days=1 / (24 * 60 * 60 * 1000)) == 1  # one millisecond
    put(spark, folders[0], ("a", "x", "06 10:00:00"))
    assert run(spark, folders, remember_days=1 / (24 * 60 * 60 * 1000)) == 2


def test_required_columns(spark):
    with pytest.raises(ValueError, match="ip"):
        first_visit_additions(spark.range(1).select(F.current_timestamp().alias("timestamp_utc")))
