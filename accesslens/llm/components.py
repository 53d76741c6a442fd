"""Connected components of a large graph, by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from accesslens.llm.shared import stored


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """`node`, `root` for every node of `links`: root is the smallest node it reaches.

    Links may repeat and point either way; loops and links with a NULL end are
    ignored. Each round every node hangs its larger neighbours under its smallest one,
    then its smaller neighbours, until only stars are left (a logarithmic number of
    rounds). Rounds are cut by written tables; nothing but two sums reaches the driver.
    """
    edges = (
        links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
        .where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col("u") != F.col("v")))
        .distinct()
    )
    edges = stored(edges)
    state = _digest(edges)
    while True:
        edges = stored(_small_star(_large_star(edges)))
        before, state = state, _digest(edges)
        if state == before:
            break
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
        edges.select("v", "v").distinct()
    )


def _digest(edges: DataFrame) -> tuple:
    hashed = F.xxhash64("u", "v")
    return tuple(
        edges.agg(
            F.count("*"),
            F.sum(hashed.cast("decimal(38,0)")),
            F.bit_xor(hashed),
        ).first()
    )


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node's larger neighbours under the smallest of its neighbours and itself."""
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.min("v").alias("m"))
    return (
        both.join(low, "u")
        .where(F.col("v") > F.col("u"))
        .select(F.col("v").alias("u"), F.least("u", "m").alias("v"))
        .distinct()
    )


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node's smaller neighbours, and itself, under the smallest of them."""
    low = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(low, "u").where(F.col("v") != F.col("m"))
    return (
        low.select("u", F.col("m").alias("v"))
        .union(moved.select(F.col("v").alias("u"), F.col("m").alias("v")))
        .distinct()
    )
