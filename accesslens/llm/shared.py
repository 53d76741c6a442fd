"""What several text operators need: Arrow maps, checkpoints, a column picker."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Rows of one Arrow batch: a few MB of ordinary documents in a Python worker.
BATCH_ROWS = 1024
#: And its bytes, for tables of very long texts.
BATCH_BYTES = 32 << 20

Batches = Iterator[pa.RecordBatch]


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: where checkpoints go.

    It is the session's `spark.checkpoint.dir`; where that is unset, a folder beside the
    tables of the session's warehouse.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        warehouse = spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
        context.setCheckpointDir(folder or f"{warehouse}/_checkpoints")
    return context.getCheckpointDir().rstrip("/")


def checkpointed(df: DataFrame) -> DataFrame:
    """`df`, written once to the shared folder and read from there."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """`df`, written once to the shared folder as Parquet and read from there.

    Takes less disk than a checkpoint; for frames whose column names are our own.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/stored-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def arrow_map(
    df: DataFrame,
    start: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch]],
    schema: str | StructType,
    rows: int = BATCH_ROWS,
) -> DataFrame:
    """Apply to each Arrow batch the function that `start` makes once per task.

    Batches that Spark makes larger are cut into `rows` rows.
    """
    small_batches(df.sparkSession)
    owner = start.__module__

    def run(batches: Batches) -> Batches:
        drop_caches_of_others(owner)
        each = start()
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                yield each(batch.slice(at, rows))

    return df.mapInArrow(run, schema)


_PROCESS_CACHES: dict[str, Callable[[], None]] = {}


def keep_in_process(owner: str, drop: Callable[[], None]) -> None:
    """Tell that a module keeps something from task to task in this worker process, and how to drop it."""
    _PROCESS_CACHES[owner] = drop


def drop_caches_of_others(owner: str) -> None:
    """Worker processes outlive a stage: what another operator keeps would stand beside our own."""
    for name in [name for name in _PROCESS_CACHES if name != owner]:
        _PROCESS_CACHES.pop(name)()
    pa.default_memory_pool().release_unused()


def small_batches(spark: SparkSession) -> None:
    """Bound what one Arrow batch holds; documents are much longer than Spark expects of rows."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def record(schema: str | pa.Schema, *columns) -> pa.RecordBatch:
    """A batch of `columns` under the names and types of `schema`."""
    arrays = [
        c if isinstance(c, pa.Array) else pa.array(c, type=field.type)
        for c, field in zip(columns, schema, strict=True)
    ]
    return pa.RecordBatch.from_arrays(arrays, schema=schema)


def identified(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Only the key and the text, as `id` and `text`; a NULL text becomes empty."""
    return docs.select(
        F.col(quoted(id_col)).alias("id"),
        F.coalesce(F.col(quoted(text_col)).cast("string"), F.lit("")).alias("text"),
    )


def quoted(name: str) -> str:
    """A column name that may hold dots or spaces, for `F.col`."""
    return "`" + name.replace("`", "``") + "`"


def row_key(id_col: str, text_col: str) -> Column:
    """128 bits of key and text; only repeated rows share them."""
    key = F.coalesce(F.col(quoted(id_col)).cast("long").cast("string"), F.lit("-"))
    text = F.coalesce(F.col(quoted(text_col)).cast("string"), F.lit(""))
    return F.md5(F.concat_ws(":", key, text).cast("binary"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
