"""Where request logs come from: files, catalog tables, or a SQL text."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from accesslens.schema import CITY_SCHEMA, WEBLOG_SCHEMA


def open_log(spark: SparkSession, source: str, fmt: str | None = None) -> DataFrame:
    """A catalog table by name, or what `source` holds in a format Spark can load.

    Without `fmt`, a name containing a slash is a Parquet path. Text formats get
    the request table's column types; any other format with a connector on the
    class path works too and brings its own types.
    """
    if fmt is None and "/" not in source:
        return spark.table(source)
    if fmt == "csv":
        return _typed(spark.read.csv(source, header=True, inferSchema=False))
    if fmt == "json":
        return spark.read.schema(WEBLOG_SCHEMA).json(source)
    return spark.read.format(fmt or "parquet").load(source)


def _typed(log: DataFrame) -> DataFrame:
    types = {f.name: f.dataType for f in WEBLOG_SCHEMA.fields}
    return log.select([F.col(c).cast(types.get(c, "string")) for c in log.columns])


def run_sql(
    spark: SparkSession,
    query: str,
    args: dict[str, Any] | None = None,
    limit: int | None = None,
    **tables: DataFrame,
) -> DataFrame:
    """Run a query text; values come in as bound `:name` parameters, never by splicing.

    `tables` are usable as `{name}` in the text. Errors are raised, not swallowed.
    """
    result = spark.sql(query, args=args, **tables)
    return result if limit is None else result.limit(limit)


def sample_rows(log: DataFrame, limit: int) -> DataFrame:
    """Any `limit` rows."""
    return log.limit(limit)


def stable_sample(rows: DataFrame, limit: int, *keys: str) -> DataFrame:
    """The `limit` rows with the least hash of `keys` (all columns if none are named).

    The same rows come out on every run and however the table is cut; a row's hash is its
    own, so samples of parts, such as days, merge by `merged_samples` into the sample of the
    whole. Each task passes on `limit` rows. Rows of one hash are taken in the order of the
    keys; equal rows are all of one hash, so a row that is there often does not come alone.
    """
    keys = keys or tuple(rows.columns)
    # NULL and text differ by their first letter; lengths keep neighbours apart
    told = [F.coalesce(F.concat(F.length(c), F.lit(":"), c), F.lit("-")) for c in (F.col(k).cast("string") for k in keys)]
    return rows.orderBy(F.md5(F.concat_ws("|", *told).cast("binary")), *keys).limit(limit)


def merged_samples(first: DataFrame, second: DataFrame, limit: int, *keys: str) -> DataFrame:
    """The sample of both tables from the `stable_sample` of each, by the same keys."""
    return stable_sample(first.unionByName(second), limit, *keys)


def read_cities(spark: SparkSession, path: str) -> DataFrame:
    """City table from a CSV file with a header; extra columns are ignored.

    The columns are selected by name from the file's own header, so their order
    in the file does not matter.
    """
    raw = spark.read.csv(path, header=True, inferSchema=False)
    return raw.select([F.col(f.name).cast(f.dataType) for f in CITY_SCHEMA.fields])
