"""First visits kept up by a stream: state per visitor, rows for the first-seen table.

The stream remembers the earliest request of each visitor and adds a row whenever an earlier
one arrives, the first time included. What it adds is append-only, like the table of
`accesslens.plans.first_seen`: the smallest time counts, so a visitor forgotten by the stream
who comes back only adds a later row. That lets the state expire instead of holding every
visitor ever seen.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery

from accesslens.operators.visitors import settled
from accesslens.schema import VISITOR_KEY, require_columns

DAY_MS = 24 * 60 * 60 * 1000
# state on disk; and no batches without data, which would follow each other without end in
# processing time
_SETTINGS = {
    "spark.sql.streaming.stateStore.providerClass": (
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    ),
    "spark.sql.streaming.noDataMicroBatches.enabled": "false",
}
_ARRIVALS = "ip string, user_agent string, at long"


def first_visit_additions(requests: DataFrame, remember_days: float = 90) -> DataFrame:
    """`ip, user_agent, first_visit_time`: requests earlier than all that the stream remembers of their visitor.

    Each task first reduces a batch of rows to the earliest per visitor, so a visitor with a
    third of all requests moves a few rows. State is one time per visitor, kept on disk and
    dropped when it has not changed for `remember_days` of processing time. NULL key parts
    count as values.
    """
    require_columns(requests, [*VISITOR_KEY, "timestamp_utc"])
    at = F.unix_micros(F.col("timestamp_utc").cast("timestamp"))
    arrivals = requests.where("timestamp_utc IS NOT NULL").select(*VISITOR_KEY, at.alias("at"))
    earliest = arrivals.mapInArrow(_earliest(), _ARRIVALS)
    # state variables with a lifetime need this time mode
    found = earliest.groupBy(*VISITOR_KEY).transformWithState(
        _first_visit_processor(max(1, round(remember_days * DAY_MS))), _ARRIVALS, "Append", "ProcessingTime"
    )
    return found.select(*VISITOR_KEY, F.timestamp_micros("at").alias("first_visit_time"))


def _earliest():
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            least = pa.Table.from_batches([batch]).group_by(["ip", "user_agent"]).aggregate([("at", "min")])
            yield from least.rename_columns(["ip", "user_agent", "at"]).to_batches()

    return run


def _first_visit_processor(lifetime_ms: int) -> StatefulProcessor:
    class FirstVisit(StatefulProcessor):
        def init(self, handle):
            self.first = handle.getValueState("first", "at long", lifetime_ms)

        def handleInputRows(self, key, rows, timerValues):
            at = min(row.at for row in rows)
            known = self.first.get()
            if known is None or at < known[0]:
                self.first.update((at,))
                yield Row(ip=key[0], user_agent=key[1], at=at)

        def close(self):
            pass

    return FirstVisit()


@contextmanager
def _with(spark: SparkSession, settings: dict[str, str]):
    """Queries started inside run under these settings; the session's own come back."""
    before = {key: spark.conf.get(key, None) for key in settings}
    for key, value in settings.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            if value is None:
                spark.conf.unset(key)
            else:
                spark.conf.set(key, value)


def write_first_visits(
    requests: DataFrame, path: str, checkpoint: str, remember_days: float = 90
) -> StreamingQuery:
    """Add what is available to Parquet files under `path`, and stop.

    `path` and `checkpoint` lie in storage all executors share. After a loss the run resumes
    from the checkpoint; the file sink's log keeps a batch from being added twice.
    """
    with _with(requests.sparkSession, _SETTINGS):
        return (
            first_visit_additions(requests, remember_days)
            .writeStream.outputMode("append")
            .format("parquet")
            .option("checkpointLocation", checkpoint)
            .trigger(availableNow=True)
            .start(path)
        )


def streamed_first_visits(spark: SparkSession, path: str) -> DataFrame:
    """`ip, user_agent, first_visit_time`, one row per visitor of what `write_first_visits` wrote.

    Also what `first_seen.append_first_seen` takes to bring a bucketed table up to date.
    """
    return settled(spark.read.parquet(path))
