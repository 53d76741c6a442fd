"""A character-trigram index of a stored log: which files can hold a search term at all.

`ilike '%term%'` reads every file of the period, because Parquet statistics say nothing of
the inside of a text. The index keeps a Bloom filter of the trigrams of each searched column
and file (16 KB); a file without one of a term's trigrams cannot match and is not opened.
Files that the index does not know yet are always read, so an old index is slower but right.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from operator import and_, or_
from urllib.parse import unquote

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from accesslens.operators.search import USER_AGENT_COLUMNS
from accesslens.sources.readers import open_log

INDEXED = ("ip", "url", "geo", *USER_AGENT_COLUMNS)
BITS = 1 << 17
_HASHES = 3


def _places(trigrams: np.ndarray) -> np.ndarray:
    """Bits of trigrams, one row for each, of three code points packed into 64 bits."""
    mixed = trigrams * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(29)
    mixed *= np.uint64(0xD6E8FEB86659FD93)
    return np.stack([(mixed >> np.uint64(17 * k)) % np.uint64(BITS) for k in range(_HASHES)], axis=1)


def _trigrams(texts: list[str]) -> np.ndarray:
    """Distinct trigrams of texts; none reaches from one into the next."""
    points = np.frombuffer("\0".join(texts).encode("utf-32-le"), np.uint32).astype(np.uint64)
    if len(points) < 3:
        return np.zeros(0, np.uint64)
    parts = points[:-2], points[1:-1], points[2:]
    inside = (parts[0] != 0) & (parts[1] != 0) & (parts[2] != 0)
    packed = (parts[0] << np.uint64(42)) | (parts[1] << np.uint64(21)) | parts[2]
    return np.unique(packed[inside])


def build_index(log: DataFrame, columns: tuple[str, ...] = INDEXED) -> DataFrame:
    """`file` and a binary filter for each of `columns`, one row per file of a stored log.

    A task marks the trigrams of the distinct texts of a batch and passes on one row per
    file, so a busy page or agent costs it nothing more. Texts are lower-cased as `ilike`
    does. Write the result where later searches find it; only new files need indexing.
    """
    columns = tuple(c for c in columns if c in log.columns)
    schema = "file string, " + ", ".join(f"{c} binary" for c in columns)

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}
        for batch in batches:
            table = pa.Table.from_batches([batch])
            for file in table.column("file").unique().to_pylist():
                rows = table.filter(pa.compute.equal(table.column("file"), file))
                bits = held.setdefault(file, np.zeros((len(columns), BITS), bool))
                for k, column in enumerate(columns):
                    texts = rows.column(column).drop_null().unique().to_pylist()
                    bits[k, _places(_trigrams(texts)).ravel().astype(np.int64)] = True
            while len(held) > 16:  # files of a task follow each other
                file = next(iter(held))
                yield packed({file: held.pop(file)})
        if held:
            yield packed(held)

    def packed(held: dict[str, np.ndarray]) -> pa.RecordBatch:
        filters = [[np.packbits(bits[k]).tobytes() for bits in held.values()] for k in range(len(columns))]
        kinds = [pa.string(), *[pa.binary()] * len(columns)]
        values = [pa.array(v, t) for v, t in zip([list(held), *filters], kinds)]
        return pa.RecordBatch.from_arrays(values, names=["file", *columns])

    def merged(table: pa.Table) -> pa.Table:
        def union(values: pa.ChunkedArray) -> bytes:
            return reduce(np.bitwise_or, (np.frombuffer(v, np.uint8) for v in values.to_pylist())).tobytes()

        filters = [pa.array([union(table.column(c))], pa.binary()) for c in columns]
        return pa.table([table.column("file")[:1], *filters], names=["file", *columns])

    texts = [F.lower(F.col(c)).alias(c) for c in columns]
    marked = log.select(F.col("_metadata.file_path").alias("file"), *texts).mapInArrow(mark, schema)
    # a file is read by as many tasks as it has splits
    return marked.groupBy("file").applyInArrow(merged, schema)


@dataclass(frozen=True)
class Pruned:
    """What is left of a log: `log`, and `note` on the files left out or why none were."""

    log: DataFrame
    note: str


def pruned_log(
    spark: SparkSession, path: str, index: DataFrame, user_agent: str | None = None, **terms: str | None
) -> Pruned:
    """The stored log without files that cannot match the terms of `search.search_condition`.

    Search it with the same terms. Wildcards (`%`, `_`) part a term into pieces, of which
    those of three ASCII characters or more are looked up; a term without such a piece
    selects nothing and is named in the note. The files left out are listed on the driver, as
    Spark lists those of any table.
    """
    log = open_log(spark, path)
    wanted: list[Column] = []
    unused = []
    asked = [((c,), t) for c, t in terms.items() if t]
    if user_agent:
        asked.append((tuple(USER_AGENT_COLUMNS), user_agent))
    for columns, term in asked:
        pieces = [p for p in re.split("[%_]", term.lower()) if len(p) >= 3 and p.isascii()]
        if not pieces or not set(columns) <= set(index.columns):
            unused.append(term)
            continue
        wanted.append(reduce(or_, [reduce(and_, [_holds(c, p) for p in pieces]) for c in columns]))
    note = f"not looked up: {', '.join(unused)}" if unused else ""
    if not wanted:
        return Pruned(log, note)
    without = {_name(r.file) for r in index.where(~reduce(and_, wanted)).select("file").collect()}
    files = [f for f in log.inputFiles() if _name(f) not in without]
    note = "; ".join(filter(None, [f"{len(without)} files left out", note]))
    if not files:
        return Pruned(log.where("false"), note)
    return Pruned(spark.read.schema(log.schema).option("basePath", path).parquet(*map(unquote, files)), note)


def _name(file: str) -> str:
    """A file's address in one spelling: Spark writes `file:/a%20b` and `file:///a%20b`."""
    return re.sub("^([a-z0-9]+):/+", r"\1:/", unquote(file))


def _holds(column: str, piece: str) -> Column:
    """Whether all bits of a piece's trigrams are set in a filter."""
    held = F.lit(True)
    for place in np.unique(_places(_trigrams([piece]))).tolist():
        byte = F.conv(F.hex(F.substring(column, place // 8 + 1, 1)), 16, 10).cast("int")
        held = held & (byte.bitwiseAND(F.lit(128 >> place % 8)) != 0)
    return held
