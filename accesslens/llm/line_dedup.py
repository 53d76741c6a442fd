"""Repeated lines: a sharded minimal perfect hash over their hashes, which documents probe.

One pass counts the lines of all documents by 128-bit hash. The hashes found in enough
documents go to shards; each shard is a minimal perfect hash whose slots index arrays of
fingerprints, counts and keepers (the largest key that holds the line). A second pass sends
16-byte hashes, not lines, to the shards and gets back which lines of a document go.

A line that makes up more than a 4096th of the occurrences of repeated lines is answered in
the reading task from a shard of its own, which is broadcast: there are fewer than 4096 such
lines. So no shard receives more than that share for one line.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from accesslens.llm.ordering import NULL_KEY, key_column
from accesslens.llm.shared import arrow_map, quoted, record, stored

#: What a line loses at both ends before it is compared.
BLANKS = b" \t\n\v\f\r"
#: A line with a larger share of all occurrences than one in so many is answered at once.
COMMON_PARTS = 4096
#: Lines of one shard, at most about (21 MB of arrays in a task), and their occurrences.
SHARD_LINES = 1 << 20
SHARD_OCCURRENCES = 1 << 22
MAX_COUNT = (1 << 32) - 1

_COUNTED = pa.schema([("lo", pa.int64()), ("hi", pa.int64()), ("n", pa.int64()), ("keeper", pa.int64())])
_SHARD = pa.schema(
    [("shard", pa.int32()), ("n", pa.int64()), ("sizes", pa.binary()), ("bits", pa.binary())]
    + [(name, pa.binary()) for name in ("prints", "counts", "keepers")]
)
_PROBES = pa.schema(
    [("shard", pa.int32()), ("row_a", pa.int64()), ("row_b", pa.int64()), ("first", pa.int32())]
    + [("key", pa.int64()), ("lo", pa.int64()), ("hi", pa.int64()), ("settled", pa.bool_())]
)
_DROPS = pa.schema([("row_a", pa.int64()), ("row_b", pa.int64()), ("first", pa.int32())])


def _ddl(schema: pa.Schema) -> str:
    names = {pa.int32(): "int", pa.int64(): "long", pa.binary(): "binary", pa.bool_(): "boolean"}
    return ", ".join(f"{field.name} {names[field.type]}" for field in schema)


def _mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


@dataclass(frozen=True)
class PerfectHash:
    """Distinct 128-bit keys to 0 .. n-1, in about four bits a key.

    Level by level, keys that are alone at their place of the level's bit array stay
    there; the others go on to the next level. A key's slot is the number of bits set
    before its own.
    """

    sizes: np.ndarray
    bits: np.ndarray

    @classmethod
    def of(cls, lo: np.ndarray, hi: np.ndarray) -> PerfectHash:
        sizes, levels = [], []
        while len(lo):
            size = -(-2 * len(lo) // 64) * 64
            place = cls._place(lo, hi, len(sizes), size)
            alone = np.bincount(place, minlength=size) == 1
            sizes.append(size)
            levels.append(np.packbits(alone, bitorder="little").view(np.uint64))
            left = ~alone[place]
            lo, hi = lo[left], hi[left]
        bits = np.concatenate(levels) if levels else np.zeros(0, np.uint64)
        return cls(np.array(sizes, np.int64), bits)

    @staticmethod
    def _place(lo: np.ndarray, hi: np.ndarray, level: int, size: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            turned = _mixed(hi + np.uint64(level) * np.uint64(0xA24BAED4963EE407))
            return (_mixed(lo ^ turned) % np.uint64(size)).astype(np.int64)

    def slots(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """The slot of each key; of a key that was not given, any slot or -1."""
        before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.bits).astype(np.int64))])
        found = np.full(len(lo), -1, np.int64)
        open_, start = np.arange(len(lo)), 0
        for level, size in enumerate(self.sizes.tolist()):
            place = self._place(lo[open_], hi[open_], level, size) + start
            word, bit = self.bits[place >> 6], (place & 63).astype(np.uint64)
            here = (word >> bit) & np.uint64(1) == 1
            below = word[here] & ((np.uint64(1) << bit[here]) - np.uint64(1))
            found[open_[here]] = before[place[here] >> 6] + np.bitwise_count(below)
            open_ = open_[~here]
            start += size
        return found


@dataclass(frozen=True)
class Shard:
    """Repeated lines of one shard: the perfect hash and its arrays.

    The fingerprint is the half of a line's hash that does not choose the shard, so a line
    that is not in the index passes for one that is with a probability under 2 ** -64.
    """

    place: PerfectHash
    prints: np.ndarray
    counts: np.ndarray
    keepers: np.ndarray

    @classmethod
    def of(cls, lo: np.ndarray, hi: np.ndarray, counts: np.ndarray, keepers: np.ndarray) -> Shard:
        lo, hi = lo.view(np.uint64), hi.view(np.uint64)
        place = PerfectHash.of(lo, hi)
        order = np.argsort(place.slots(lo, hi))
        return cls(place, hi[order], np.minimum(counts, MAX_COUNT)[order].astype(np.uint32), keepers[order])

    def row(self, shard: int) -> pa.RecordBatch:
        arrays = (self.place.sizes, self.place.bits, self.prints, self.counts, self.keepers)
        return record(_SHARD, [shard], [len(self.prints)], *([a.tobytes()] for a in arrays))

    @classmethod
    def read(cls, row: dict) -> Shard:
        kinds = {"sizes": np.int64, "bits": np.uint64, "prints": np.uint64, "counts": np.uint32, "keepers": np.int64}
        a = {name: np.frombuffer(row[name], kind) for name, kind in kinds.items()}
        return cls(PerfectHash(a["sizes"], a["bits"]), a["prints"], a["counts"], a["keepers"])

    def found(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """The slot of each line; -1 for lines that are not in the shard."""
        lo, hi = lo.view(np.uint64), hi.view(np.uint64)
        slots = self.place.slots(lo, hi)
        if len(self.prints):
            slots[(slots >= 0) & (self.prints[slots] != hi)] = -1
        return slots


def key_of(line: bytes) -> bytes:
    """What lines are compared by: A-Z as a-z, without white space at both ends."""
    return line.lower().strip(BLANKS)


def _code_points(line: bytes) -> int:
    return len(line) if line.isascii() else len(line.decode("utf-8", "replace"))


@dataclass
class _Lines:
    """Distinct long enough lines of a batch of texts, by document."""

    doc: np.ndarray
    first: np.ndarray
    lo: np.ndarray
    hi: np.ndarray

    @classmethod
    def of(cls, texts: pa.Array, min_chars: int) -> _Lines:
        docs, firsts, digests = [], [], []
        for d, text in enumerate(texts.cast(pa.binary()).to_pylist()):
            first: dict[bytes, int] = {}
            for k, line in enumerate(text.lower().split(b"\n")):
                if len(line) >= min_chars:
                    first.setdefault(line.strip(BLANKS), k)
            for line, k in first.items():
                if len(line) >= 4 * min_chars or _code_points(line) >= min_chars:
                    docs.append(d)
                    firsts.append(k)
                    digests.append(xxhash.xxh3_128_digest(line))
        halves = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
        return cls(np.array(docs, np.int64), np.array(firsts, np.int32), halves[:, 0].copy(), halves[:, 1].copy())


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Key, text and 128 bits of both; only repeated rows share these."""
    text = F.coalesce(F.col(quoted(text_col)).cast("string"), F.lit(""))
    key = key_column(quoted(id_col))
    return docs.select(key.alias("key"), text.alias("text"), *_row_bits(key, text))


def _row_bits(key: Column, text: Column) -> list[Column]:
    return [F.xxhash64(F.lit(seed), key, text).alias(name) for seed, name in ((1, "row_a"), (2, "row_b"))]


def line_counts(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 20
) -> DataFrame:
    """`lo`, `hi`, `n`, `keeper` per distinct line: its hash, the documents that hold it, their largest key.

    Lines under `min_chars` code points are left out. Every row counts as a document.
    Batches and then tasks add up equal lines before anything is shuffled.
    """

    def start():
        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            lines = _Lines.of(batch.column("text"), min_chars)
            keys = batch.column("key").to_numpy()[lines.doc]
            order = np.lexsort((lines.hi, lines.lo))
            lo, hi = lines.lo[order], lines.hi[order]
            new = np.ones(len(lo), bool)
            new[1:] = (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1])
            at = np.flatnonzero(new)
            if not len(at):
                return record(_COUNTED, [], [], [], [])
            keepers = np.maximum.reduceat(keys[order], at)
            return record(_COUNTED, lo[at], hi[at], np.diff(np.append(at, len(lo))), keepers)

        return run

    each = arrow_map(_texts(docs, id_col, text_col).select("key", "text"), start, _ddl(_COUNTED))
    return each.groupBy("lo", "hi").agg(F.sum("n").alias("n"), F.max("keeper").alias("keeper"))


@dataclass(frozen=True)
class LineIndex:
    """Repeated lines: `shards` has one row per shard, `common` is the shard of the most frequent ones."""

    shards: DataFrame
    n_shards: int
    common: Shard

    @classmethod
    def of(cls, repeated: DataFrame) -> LineIndex:
        """Index rows of `line_counts`, usually those above some number of documents.

        As many shards as the session has shuffle partitions, and more where a shard would
        hold over a million lines or four million occurrences.
        """
        spark = repeated.sparkSession
        repeated = stored(repeated)
        lines, occurrences = repeated.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
        least = int(spark.conf.get("spark.sql.shuffle.partitions"))
        n_shards = max(least, -(-lines // SHARD_LINES), -(-occurrences // SHARD_OCCURRENCES))
        is_common = F.col("n") * COMMON_PARTS > occurrences
        top = repeated.where(is_common).toArrow()  # fewer than COMMON_PARTS rows
        common = Shard.of(*(top.column(c).to_numpy() for c in ("lo", "hi", "n", "keeper")))

        def build(batches):
            parts = [b for b in batches if b.num_rows]
            if parts:
                t = pa.Table.from_batches(parts)
                shard = Shard.of(*(t.column(c).to_numpy() for c in ("lo", "hi", "n", "keeper")))
                yield shard.row(t.column("shard")[0].as_py())

        rest = repeated.where(~is_common).withColumn("shard", F.pmod("lo", F.lit(n_shards)).cast("int"))
        dealt = rest.repartitionById(n_shards, "shard")
        return cls(stored(dealt.mapInArrow(build, _ddl(_SHARD))), n_shards, common)

    def repeated_elsewhere(
        self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 20
    ) -> DataFrame:
        """`row_a`, `row_b`, `first`: the lines that a document loses, by the place where each first stands in it.

        A document keeps the lines whose keeper it is, and those the index does not hold.
        """
        spark = docs.sparkSession
        n_shards, common = self.n_shards, spark.sparkContext.broadcast(self.common)

        def start():
            top = common.value

            def run(batch: pa.RecordBatch) -> pa.RecordBatch:
                lines = _Lines.of(batch.column("text"), min_chars)
                keys, a, b = (batch.column(c).to_numpy()[lines.doc] for c in ("key", "row_a", "row_b"))
                slots = top.found(lines.lo, lines.hi)
                settled = slots >= 0
                asked = ~settled
                asked[settled] = top.keepers[slots[settled]] != keys[settled]
                shard = np.where(settled, a, lines.lo) % n_shards
                columns = (shard.astype(np.int32), a, b, lines.first, keys, lines.lo, lines.hi, settled)
                return record(_PROBES, *(c[asked] for c in columns))

            return run

        probes = arrow_map(_texts(docs, id_col, text_col), start, _ddl(_PROBES))
        arrays = self.shards.select("shard", F.struct("sizes", "bits", "prints", "counts", "keepers").alias("arrays"))
        both = arrays.unionByName(probes, allowMissingColumns=True)
        dealt = both.repartitionById(n_shards, "shard").sortWithinPartitions(F.col("arrays").isNull())

        def probe(batches):
            shard = None
            for batch in batches:
                if shard is None and batch.num_rows:
                    arrays = batch.column("arrays")[0].as_py()
                    shard = Shard.read(arrays) if arrays else Shard.of(*(np.zeros(0, np.int64),) * 4)
                    batch = batch.slice(1 if arrays else 0)
                if not batch.num_rows:
                    continue
                lo, hi, key = (batch.column(c).to_numpy() for c in ("lo", "hi", "key"))
                gone = batch.column("settled").to_numpy(zero_copy_only=False).copy()
                slots = shard.found(lo, hi)
                known = np.flatnonzero(~gone & (slots >= 0))
                gone[known] = shard.keepers[slots[known]] != key[known]
                yield batch.select(_DROPS.names).filter(pa.array(gone))

        return dealt.mapInArrow(probe, _ddl(_DROPS))


def deduplicated(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_chars: int = 20,
    min_documents: int = 3,
) -> DataFrame:
    """`docs` without lines repeated elsewhere, and `n_lines`, `n_dropped` per row.

    Lines end at \\n; a NULL or empty text is one empty line. Lines are compared by
    `key_of`. One of at least `min_chars` code points that stands in `min_documents` rows or
    more goes everywhere but in the rows of the largest key that holds it; there, and for
    other lines, all repetitions stay. Every row counts as a document, repeated rows too; a
    NULL key sorts before all others. Other columns pass through, but `n_lines` and
    `n_dropped` are replaced. An empty table gives an empty table.
    """
    counted = line_counts(docs, id_col, text_col, min_chars)
    index = LineIndex.of(counted.where(F.col("n") >= min_documents))
    gone = index.repeated_elsewhere(docs, id_col, text_col, min_chars)
    gone = stored(gone.groupBy("row_a", "row_b").agg(F.collect_set("first").alias("gone")))

    text = F.coalesce(F.col(quoted(text_col)).cast("string"), F.lit(""))
    key = key_column(quoted(id_col))
    others = [F.col(quoted(c)) for c in docs.columns if c != text_col]
    rows = docs.select(F.struct(*others).alias("other"), text.alias("text"), *_row_bits(key, text))
    rows = rows.join(gone, ["row_a", "row_b"], "left").select("other", "text", "gone")
    schema = rows.select("other", "text").schema.add("n_lines", "long").add("n_dropped", "long")

    def start():
        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            kept, sizes, dropped = [], [], []
            for text, gone in zip(batch.column("text").to_pylist(), batch.column("gone").to_pylist()):
                lines = text.split("\n")
                sizes.append(len(lines))
                if gone:
                    lines = _without(lines, set(gone))
                kept.append("\n".join(lines) if gone else text)
                dropped.append(sizes[-1] - len(lines))
            columns = [batch.column("other"), *map(pa.array, (kept, sizes, dropped))]
            return pa.RecordBatch.from_arrays(columns, names=["other", "text", "n_lines", "n_dropped"])

        return run

    done = arrow_map(rows, start, schema)
    named = {"n_lines": F.col("n_lines"), "n_dropped": F.col("n_dropped"), text_col: F.col("text")}
    columns = [named.get(c, F.col(f"other.{quoted(c)}")).alias(c) for c in docs.columns]
    return done.select(*columns, *(c.alias(n) for n, c in named.items() if n not in docs.columns))


def _without(lines: list[str], gone: set[int]) -> list[str]:
    """Lines but those equal to a line that first stands at one of the places `gone`."""
    first: dict[bytes, int] = {}
    return [line for k, line in enumerate(lines) if first.setdefault(key_of(line.encode()), k) not in gone]
