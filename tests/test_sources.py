import datetime as dt
import json
import os
from types import SimpleNamespace

import pytest
from conftest import tuples
from pyspark.sql import functions as F

from accesslens.operators import traffic
from accesslens.plans.rollups import rollup
from accesslens.session import shared_folder, spark_session
from accesslens.sources.readers import open_log, run_sql, sample_rows
from accesslens.sources.writers import as_records, write_days, write_log

D = dt.date


@pytest.fixture(scope="module")
def log(make_log):
    return make_log(
        {"at": "2024-01-01 10:00:00", "ip": "a"},
        {"at": "2024-01-01 09:00:00", "ip": "b"},
        {"at": "2024-01-02 10:00:00", "ip": "c"},
    )


@pytest.mark.parametrize("fmt", ["parquet", "orc", "json", "csv"])
def test_files_round_trip(log, tmp_path, fmt):
    path = str(tmp_path / fmt)
    log.write.format(fmt).option("header", "true").save(path)
    back = open_log(log.sparkSession, path, fmt)
    assert dict(back.dtypes) == dict(log.dtypes)
    assert sorted(tuples(back.select(log.columns))) == sorted(tuples(log))


def test_unknown_format(spark):
    with pytest.raises(Exception, match="no_such_format"):
        open_log(spark, "/x", "no_such_format")


def test_catalog_table(spark, log):
    log.createOrReplaceTempView("requests_view")
    assert open_log(spark, "requests_view").count() == 3


def test_written_log_is_partitioned_and_rewritten_by_day(spark, log, make_log, tmp_path):
    path = str(tmp_path / "log")
    write_log(log.drop("day"), path)
    assert sorted(d for d in os.listdir(path) if "=" in d) == ["day=2024-01-01", "day=2024-01-02"]
    again = make_log({"at": "2024-01-02 11:00:00", "ip": "d"}, {"at": "2024-01-02 12:00:00", "ip": "e"})
    for _ in range(2):  # a rerun replaces, it does not add
        write_log(again, path)
    found = traffic.traffic_per_day(open_log(spark, path), "2024-01-01", "2024-01-02")
    assert tuples(found) == [(D(2024, 1, 1), 2), (D(2024, 1, 2), 2)]


def test_stored_rollup(spark, log, tmp_path):
    path = str(tmp_path / "rollup")
    write_days(rollup(log, "status_code", grain="hour"), path, "timestamp_utc")
    found = traffic.traffic_per_day(open_log(spark, path), "2024-01-01", "2024-01-02")
    assert tuples(found) == [(D(2024, 1, 1), 2), (D(2024, 1, 2), 1)]


def test_given_shuffle_partitions_stay(spark):
    name, start = "spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
    before = spark.conf.get(name), spark.conf.get(start)
    try:
        session = spark_session(settings={name: "200"})
        assert (session.conf.get(name), session.conf.get(start)) == ("200", "200")
        session = spark_session()
        assert (session.conf.get(name), session.conf.get(start)) == ("200", "2000")
    finally:
        spark.conf.set(name, before[0])
        spark.conf.set(start, before[1])


def test_query_text(spark, log):
    query = "SELECT ip FROM {log} WHERE ip >= :low ORDER BY ip"
    assert tuples(run_sql(spark, query, {"low": "b"}, log=log)) == [("b",), ("c",)]
    assert tuples(run_sql(spark, query, {"low": "b"}, limit=1, log=log)) == [("b",)]
    # a bound value stays a value
    assert tuples(run_sql(spark, query, {"low": "' OR '1'='1"}, log=log)) == tuples(log.select("ip").orderBy("ip"))
    with pytest.raises(Exception, match="no_such_table"):
        run_sql(spark, "SELECT * FROM no_such_table").collect()


def test_sample(log):
    assert sample_rows(log, 2).count() == 2
    assert sample_rows(log, 9).count() == 3


def test_records(log):
    found = [json.loads(r.record) for r in as_records(log.select("day", "ip")).collect()]
    assert {"day": "2024-01-02", "ip": "c"} in found
    without = as_records(log.select("ip", F.lit(None).cast("string").alias("geo"))).first().record
    assert json.loads(without)["geo"] is None


def test_shared_folder_comes_from_the_cluster(spark):
    def session(**conf):
        conf = {k.replace("_", "."): v for k, v in conf.items()}
        return SimpleNamespace(conf=SimpleNamespace(get=lambda k, default="": conf.get(k, default)))

    named = session(spark_checkpoint_dir="/shared/checkpoints/", spark_master="yarn")
    assert shared_folder(named) == "/shared/checkpoints"
    # the warehouse is shared too; never a machine-local folder
    assert shared_folder(session(spark_sql_warehouse_dir="hdfs:/tables/")) == "hdfs:/tables/_shared"
