"""Session settings the operators rely on."""

from __future__ import annotations

from pyspark.sql import SparkSession

# UTC because every date and hour of a request is a UTC date and hour; adaptive
# execution because partition counts, skewed visitor joins and the choice of a
# broadcast are all left to run-time sizes.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # the most that a shuffle is cut into; adaptive execution merges them by size, and
    # never splits those of an aggregation
    "spark.sql.adaptive.coalescePartitions.initialPartitionNum": "2000",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
}


def spark_session(
    app: str = "accesslens",
    master: str | None = None,
    settings: dict[str, str] | None = None,
) -> SparkSession:
    """Build a session; `master` stays unset when a cluster launcher supplies it.

    Given the number of shuffle partitions, shuffles are cut into just so many. Else they
    start from many small ones, whatever the cores at the start, and are merged by size.
    """
    settings = settings or {}
    if "spark.sql.shuffle.partitions" in settings:
        settings = {
            "spark.sql.adaptive.coalescePartitions.initialPartitionNum": settings["spark.sql.shuffle.partitions"],
            **settings,
        }
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **settings}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """Folder every executor can reach: `spark.checkpoint.dir`, else one in the warehouse."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_shared"
