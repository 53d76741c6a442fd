"""Near-duplicate documents by SimHash, with vantage-point trees over the fingerprints.

A fingerprint is 64 bits; two link at `max_bits` or fewer differing bits. Pairs come
from a vantage-point tree in two parts:

* The upper tree deals fingerprints to shards. Each of its four levels measures the
  Hamming distance to its own vantage point over its own 16 bits and branches by ring.
  The levels read disjoint bits, so by the triangle inequality the ring differences of
  a linked pair add up to at most `max_bits`: a query spends that budget on its way
  down, visits its home shard and the shards within the budget across a boundary, and
  prunes all others. Vantage points are chosen on a bounded sample; that affects
  balance, never the result.
* In each cell of a shard a lower tree over whole fingerprints halves the points at a
  median radius and descends into a half only if the triangle bound allows a link.

Each pair meets in exactly one shard, that of its larger ring code. Oversized shards
are cut in both directions into cells of bounded size. A cell returns a spanning
forest of its links, never the pairs of a dense ball.
"""

from __future__ import annotations

from itertools import product

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from accesslens.llm.components import components
from accesslens.llm.shared import Batches, arrow_map, checkpointed, identified, record, row_key

BITS = 64
LEVELS = 4
LEVEL_BITS = BITS // LEVELS
RINGS = LEVEL_BITS + 1
#: Fingerprints that the choice of vantage points looks at.
SAMPLE = 4096
#: Most home points, and most queries, of one cell.
CELL_HOMES = 4096
CELL_QUERIES = 32_768
#: Pairs that one leaf of the lower tree compares at once.
LEAF_PAIRS = 1 << 16
HASH_SEED = 42

_OUT = pa.schema([("id", pa.int64()), ("row_key", pa.string()), ("fp", pa.int64())])
_VISITS = pa.schema([("cell", pa.int64()), ("home", pa.bool_()), ("fp", pa.int64())])
_LINKS = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def fingerprint(text: bytes, words_per_shingle: int) -> int:
    """Signed 64 bits; a bit is set if over half of the shingle hashes have it.

    Words are runs of bytes other than ASCII white space, A-Z in lower case. Fewer
    words than a shingle: all of them are the shingle. No words: zero.
    """
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    size = min(words_per_shingle, len(words))
    begins = np.r_[0, ends[:-1] + 1][: len(words) - size + 1].tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.array(
        [digest(joined[a:b], HASH_SEED) for a, b in zip(begins, ends[size - 1 :].tolist(), strict=True)],
        np.uint64,
    )
    bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    majority = 2 * bits.sum(axis=0, dtype=np.int64) > len(hashes)
    return int(np.packbits(majority, bitorder="little").view(np.int64)[0])


def fingerprints(
    docs: DataFrame, words_per_shingle: int, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """`id`, `row_key`, `fp` (signed) of every row; a NULL text counts as empty."""

    def start():
        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = batch.column(1).cast(pa.binary()).to_pylist()
            return record(_OUT, batch.column(0), batch.column(2), [fingerprint(t, words_per_shingle) for t in texts])

        return each

    texts = identified(docs, id_col, text_col)
    keyed = texts.select(F.col("id").cast("long"), "text", row_key("id", "text").alias("k"))
    return arrow_map(keyed, start, "id long, row_key string, fp long")


class UpperTree:
    """Vantage points of the levels and the shards that hold points."""

    def __init__(self, vantage: list[int], max_bits: int):
        self.vantage = vantage
        steps = [
            s
            for s in product(range(-max_bits, max_bits + 1), repeat=LEVELS)
            if sum(map(abs, s)) <= max_bits and s > (0,) * LEVELS
        ]
        self.steps = np.array(steps, np.int64).reshape(-1, LEVELS)
        self.sizes = np.zeros(RINGS**LEVELS, np.int64)

    @classmethod
    def fitted(cls, sample: np.ndarray, max_bits: int) -> UpperTree:
        """Choose at each level, among the sample's values, the one with the evenest rings."""
        vantage = []
        for level in range(LEVELS):
            values = _level_bits(sample, level)
            best = (-1.0, 0)
            for point in np.unique(values)[:: max(1, len(np.unique(values)) // 64)].tolist():
                share = np.bincount(np.bitwise_count(values ^ np.uint64(point)), minlength=RINGS)
                share = share[share > 0] / len(values)
                best = max(best, (float(-(share * np.log(share)).sum()), point))
            vantage.append(best[1])
        return cls(vantage, max_bits)

    def rings(self, points: np.ndarray) -> np.ndarray:
        """Distance to each level's vantage point, one row per point."""
        return np.stack(
            [np.bitwise_count(_level_bits(points, k) ^ np.uint64(v)) for k, v in enumerate(self.vantage)], 1
        ).astype(np.int64)

    def visits(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the point and shard, for every occupied shard behind its own."""
        reached = self.rings(points)[:, None, :] + self.steps[None, :, :]
        inside = ((reached >= 0) & (reached < RINGS)).all(2)
        who, which = np.nonzero(inside)
        shards = _code(reached[who, which])
        held = self.sizes[shards] > 0
        return who[held], shards[held]


def _level_bits(points: np.ndarray, level: int) -> np.ndarray:
    shift, mask = np.uint64(level * LEVEL_BITS), np.uint64((1 << LEVEL_BITS) - 1)
    return (points.view(np.uint64) >> shift) & mask


def _code(rings: np.ndarray) -> np.ndarray:
    code = rings[:, 0]
    for k in range(1, LEVELS):
        code = code * RINGS + rings[:, k]
    return code


def linked(points: DataFrame, max_bits: int) -> DataFrame:
    """`a`, `b`: a spanning forest of all pairs of distinct `fp` within `max_bits`.

    `points` has one row per distinct fingerprint.
    """
    spark = points.sparkSession
    sample = points.orderBy(F.xxhash64("fp")).limit(SAMPLE).collect()
    if not sample:
        return spark.createDataFrame([], "a long, b long")
    tree = UpperTree.fitted(np.array([r.fp for r in sample], np.int64), max_bits)

    def start_home():
        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            values = batch.column(0).to_numpy()
            homes = _code(tree.rings(values)) if len(values) else np.zeros(0, np.int64)
            return record(pa.schema([("shard", pa.int64())]), homes)

        return each

    # at most RINGS ** LEVELS rows, whatever the input
    for shard, n in arrow_map(points.select("fp"), start_home, "shard long").groupBy("shard").count().collect():
        tree.sizes[shard] = n
    home_cuts = -(-tree.sizes // CELL_HOMES)
    arrivals = _arrivals(tree) + tree.sizes
    query_cuts = np.maximum(1, -(-arrivals // CELL_QUERIES)) * (tree.sizes > 0)
    first_cell = np.r_[0, np.cumsum(home_cuts * query_cuts)[:-1]]
    shared = spark.sparkContext.broadcast((tree, home_cuts, query_cuts, first_cell))

    def start_visits():
        tree, home_cuts, query_cuts, first_cell = shared.value

        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            values = batch.column(0).to_numpy()
            if not len(values):
                return record(_VISITS, [], [], [])
            own = _code(tree.rings(values))
            who, shards = tree.visits(values)
            who, shards = np.r_[np.arange(len(values)), who], np.r_[own, shards]
            mixed = (values.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
            mixed = mixed.astype(np.int64)
            # a home point goes to its row of cells, a query to its column of cells
            row, copies = mixed % home_cuts[own], query_cuts[own]
            h = np.repeat(np.arange(len(values)), copies)
            across = np.arange(len(h)) - np.repeat(np.cumsum(copies) - copies, copies)
            h_cell = first_cell[own[h]] + row[h] * query_cuts[own[h]] + across
            column, copies = mixed[who] % query_cuts[shards], home_cuts[shards]
            q = np.repeat(np.arange(len(who)), copies)
            down = np.arange(len(q)) - np.repeat(np.cumsum(copies) - copies, copies)
            q_cell = first_cell[shards[q]] + down * query_cuts[shards[q]] + column[q]
            return record(
                _VISITS,
                np.r_[h_cell, q_cell],
                np.arange(len(h) + len(q)) < len(h),
                np.r_[values[h], values[who[q]]],
            )

        return each

    visits = arrow_map(points.select("fp"), start_visits, "cell long, home boolean, fp long")
    by_cell = visits.repartition("cell").sortWithinPartitions("cell")

    def cells(batches: Batches) -> Batches:
        cell, kept = None, []
        for batch in batches:
            ids = batch.column(0).to_numpy()
            cuts = np.flatnonzero(np.diff(ids)) + 1
            for a, b in zip(np.r_[0, cuts], np.r_[cuts, len(ids)], strict=True):
                if a == b:
                    continue
                if kept and ids[a] != cell:
                    yield _forest(kept, max_bits)
                    kept = []
                cell = ids[a]
                kept.append(batch.slice(a, b - a))
        if kept:
            yield _forest(kept, max_bits)

    return by_cell.mapInArrow(cells, "a long, b long")


def _arrivals(tree: UpperTree) -> np.ndarray:
    """Queries that reach each shard from other shards."""
    arrivals = np.zeros_like(tree.sizes)
    held = np.flatnonzero(tree.sizes)
    rings = np.stack(np.unravel_index(held, (RINGS,) * LEVELS), 1)
    for step in tree.steps:
        reached = rings + step
        inside = ((reached >= 0) & (reached < RINGS)).all(1)
        np.add.at(arrivals, _code(reached[inside]), tree.sizes[held[inside]])
    return arrivals


def _forest(parts: list[pa.RecordBatch], max_bits: int) -> pa.RecordBatch:
    """Links that connect what the pairs of one cell connect."""
    merged = pa.Table.from_batches(parts)
    home = merged.column(1).to_numpy()
    values = merged.column(2).to_numpy()
    nodes, index = np.unique(values, return_inverse=True)
    label = np.arange(len(nodes))
    points = nodes.view(np.uint64)
    _descend(points, np.unique(index[home]), np.unique(index[~home]), max_bits, label)
    moved = np.flatnonzero(label != np.arange(len(nodes)))
    return record(_LINKS, nodes[moved], nodes[label[moved]])


def _descend(points, homes, queries, max_bits: int, label) -> None:
    """Join the labels of linked homes and queries; lower vantage-point tree."""
    if not len(homes) or not len(queries):
        return
    if len(homes) * len(queries) > LEAF_PAIRS and len(homes) > 1:
        vantage = points[homes[0]]
        near = np.bitwise_count(points[homes] ^ vantage)
        reach = np.bitwise_count(points[queries] ^ vantage).astype(np.int64)
        radius = int(np.median(near))
        within = near <= radius
        if within.all():
            within = near < radius
            radius -= 1
        if within.any() and not within.all():
            _descend(points, homes[within], queries[reach <= radius + max_bits], max_bits, label)
            _descend(points, homes[~within], queries[reach > radius - max_bits], max_bits, label)
            return
    step = max(1, LEAF_PAIRS // len(queries))
    for at in range(0, len(homes), step):
        some = homes[at : at + step]
        near = np.bitwise_count(points[some][:, None] ^ points[queries][None, :]) <= max_bits
        for k in np.flatnonzero(near.sum(1) > np.isin(some, queries, kind="table")):
            touched = np.unique(np.append(label[queries[near[k]]], label[some[k]]))
            if len(touched) > 1:
                label[np.isin(label, touched, kind="table")] = touched[0]


def near_duplicates(
    docs: DataFrame,
    words_per_shingle: int = 3,
    max_bits: int = 3,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """`doc_id`, `fingerprint`, `component_id`, `row_key`, `component_key` of every row.

    `component_id` is the smallest key reachable over links, the row's own included;
    NULL keys count only where a component has no other. `component_key` names the
    component itself (its smallest signed fingerprint), so that it stays unique where
    keys repeat. Repeated rows give repeated rows; texts without words share the
    fingerprint zero, which links like any other.
    """
    rows = checkpointed(fingerprints(docs, words_per_shingle, id_col, text_col))
    points = checkpointed(rows.groupBy("fp").agg(F.min("id").alias("low")))
    roots = components(linked(points, max_bits))
    placed = points.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", "low", F.coalesce("root", "fp").alias("component_key")
    )
    lowest = placed.groupBy("component_key").agg(F.min("low").alias("component_id"))
    known = placed.join(lowest, "component_key").select("fp", "component_id", "component_key")
    return rows.join(known, "fp").select(
        F.col("id").alias("doc_id"),
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        "component_id",
        "row_key",
        "component_key",
    )


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row of `docs` per component, that of its smallest key, with all columns."""
    found = near_duplicates(docs, id_col=id_col, text_col=text_col, **options)
    # NULL keys last
    first = F.struct(F.col("doc_id").isNull(), "doc_id", "row_key")
    kept = found.groupBy("component_key").agg(F.min(first).alias("first")).select("first.row_key")
    # both steps on the same key: the texts move once
    keyed = docs.withColumn("__row_key", row_key(id_col, text_col))
    joined = keyed.join(kept.withColumnRenamed("row_key", "__row_key"), "__row_key", "left_semi")
    return joined.dropDuplicates(["__row_key"]).drop("__row_key")
