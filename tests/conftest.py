from __future__ import annotations

import datetime as dt
import os
import sys

import pyarrow as pa
import pytest
from pyspark.sql.pandas.types import to_arrow_schema

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

from accesslens.schema import WEBLOG_SCHEMA  # noqa: E402
from accesslens.session import spark_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    warehouse = tmp_path_factory.mktemp("warehouse")
    session = spark_session(
        "accesslens-tests",
        master="local[8]",
        settings={
            **SMALL,
            **FULL_PLAN_TEXT,
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": "8g",
            "spark.sql.warehouse.dir": str(warehouse),
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


# Compiling a stage costs more than running it on a handful of rows, so the small
# fixtures run interpreted. Oracle and plan tests restore the defaults.
SMALL = {"spark.sql.codegen.wholeStage": "false", "spark.sql.shuffle.partitions": "2"}
PRODUCTION = {"spark.sql.codegen.wholeStage": "true", "spark.sql.shuffle.partitions": "8"}
FULL_PLAN_TEXT = {"spark.sql.maxMetadataStringLength": "10000"}


@pytest.fixture(scope="module")
def production(spark):
    for key, value in PRODUCTION.items():
        spark.conf.set(key, value)
    yield spark
    for key, value in SMALL.items():
        spark.conf.set(key, value)


def moment(text: str) -> dt.datetime:
    return dt.datetime.fromisoformat(text).replace(tzinfo=dt.timezone.utc)


@pytest.fixture(scope="session")
def make_log(spark):
    """Build a request table from partial rows; `at` is the UTC time as text."""

    def build(*rows: dict):
        complete = []
        for row in rows:
            row = dict(row)
            at = moment(row.pop("at"))
            complete.append(
                {
                    "timestamp_utc": at,
                    "day": at.date(),
                    "hour": at.strftime("%Y-%m-%dT%H"),
                    **row,
                }
            )
        columns = {f.name: [r.get(f.name) for r in complete] for f in WEBLOG_SCHEMA.fields}
        schema = to_arrow_schema(WEBLOG_SCHEMA)
        return spark.createDataFrame(pa.Table.from_pydict(columns, schema=schema))

    return build


def tuples(df) -> list[tuple]:
    return [tuple(r) for r in df.collect()]


def final_plan(df) -> str:
    """Text of the physical plan before execution."""
    return df._jdf.queryExecution().executedPlan().toString()


def executed_plan(df) -> str:
    """Text of the plan after adaptive execution has run it."""
    df.collect()
    return final_plan(df).split("== Initial Plan ==")[0]
