"""Rankings over keys too many to shuffle: find the few that can be among the first, count only those.

`heavy_rows` keeps the rows whose key may be one of the `k` most frequent. Any ranking of these
rows equals that of all rows, and what it shuffles are the candidates alone:

    top_paths(heavy_rows(with_rankable_path(log), 10, "url_path"), start, end)
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import reduce
from operator import and_

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from accesslens.session import shared_folder

#: Counters of a task in the first round, how many more in each further one, and the most.
COUNTERS = 8192
MORE = 8
MOST_COUNTERS = 1 << 21


def heavy_rows(rows: DataFrame, k: int, *keys: str, counters: int = COUNTERS) -> DataFrame:
    """The rows whose `keys` can be among the `k` most frequent, ties of the last included.

    A task keeps Misra-Gries counters: when there are too many, the largest that is left out
    is taken off all, and what was taken off bounds the error of each. Summed over the
    tasks, a key has at least its counter and at most that plus all errors; a key without
    a counter has at most the errors. Once these are less than the k-th largest counter, no
    other key can be among the first. Otherwise the next round has more counters; where even
    two million of a task do not separate them, all rows are returned. Rounds are jobs, of
    which three numbers reach the driver.

    NULL is a key like others; rollups count their `hits`. With fewer than `k` keys, all
    rows come back.
    """
    while counters <= MOST_COUNTERS:
        found, lost, kth = _bounded(rows, k, keys, counters)
        if lost == 0 or kth > lost:
            candidates = found.where(F.col("n") + lost >= kth).alias("c")
            same = [F.col(f"r.{key}").eqNullSafe(F.col(f"c.{key}")) for key in keys]
            return rows.alias("r").join(candidates, reduce(and_, same), "left_semi")
        counters *= MORE
    return rows


def _bounded(rows: DataFrame, k: int, keys: tuple[str, ...], counters: int) -> tuple[DataFrame, int, int]:
    """Keys with the sum `n` of their counters, the sum of all errors, and the k-th largest `n` (0 for fewer keys)."""
    spark = rows.sparkSession
    weight = F.col("hits") if "hits" in rows.columns else F.lit(1)
    counted = rows.select(*keys, weight.cast("bigint").alias("n"))
    schema = StructType([StructField(f.name, f.dataType) for f in counted.withColumn("lost", F.col("n")).schema])
    summary = counted.mapInArrow(_misra_gries(list(keys), counters), schema)
    path = f"{shared_folder(spark)}/heavy-{uuid.uuid4().hex}"
    summary.write.parquet(path)
    summary = spark.read.parquet(path)
    found = summary.where("lost IS NULL").groupBy(*keys).agg(F.sum("n").alias("n"))
    lost = summary.agg(F.coalesce(F.sum("lost"), F.lit(0))).first()[0]
    first = found.orderBy(F.desc("n")).limit(k).agg(F.count(F.lit(1)), F.min("n")).first()
    return found, lost, first[1] if first[0] == k else 0


def _misra_gries(keys: list[str], counters: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, lost, schema = None, 0, None
        for batch in batches:
            schema = pa.schema([(field.name, field.type) for field in batch.schema])
            part = pa.Table.from_batches([batch]).cast(schema)
            both = part if held is None else pa.concat_tables([held, part])
            held = both.group_by(keys).aggregate([("n", "sum")]).rename_columns([*keys, "n"]).cast(schema)
            if held.num_rows > counters:
                n = held.column("n").to_numpy()
                cut = int(np.partition(n, -counters - 1)[-counters - 1])
                lost += cut
                kept = n > cut
                held = held.filter(pa.array(kept)).set_column(len(keys), "n", pa.array(n[kept] - cut))
        if held is not None:
            schema = schema.append(pa.field("lost", pa.int64()))
            held = held.append_column("lost", pa.nulls(held.num_rows, pa.int64())).cast(schema)
            yield from held.combine_chunks().to_batches()
            yield pa.RecordBatch.from_pylist([{"n": 0, "lost": lost}], schema)

    return run
