"""Document fingerprints by I-Match over randomised lexicons.

The lexicon holds the terms whose document frequency lies in a band: terms of nearly
all documents say nothing, terms of a handful are typing errors. It is cut into random
subsets of several densities. A document's distinct terms of the lexicon are sorted,
and each subset's share of them is hashed; the fingerprint is the row of these hashes.
Two texts agree on a subset unless their terms differ inside it, so the share of agreed
subsets falls as the texts drift apart.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from accesslens.llm.ordering import SHARD_ROWS, Shards, key_column
from accesslens.llm.shared import Batches, arrow_map, identified, record, small_batches

#: The band as shares of all documents. The lower end bounds the lexicon: at most the
#: mean number of distinct terms of a document divided by it.
LEAST_SHARE, MOST_SHARE = 0.0005, 0.05
#: Subsets keep one term in 16, 32, ... 512, six subsets of each density: a subset with
#: a few terms of a text survives an edit, one with many hardly ever does.
DENSITIES = [2.0**-k for k in range(4, 10) for _ in range(6)]
HEX_DIGITS = 6
_CACHE_TERMS = 300_000

_TERM = re.compile(r"[^\W_]+")
_COUNTS = pa.schema([("term", pa.int64()), ("n", pa.int64())])


class Terms:
    """Distinct terms of texts as 64-bit hashes, which a worker remembers."""

    def __init__(self):
        self.known: dict[str, int] = {}

    def of(self, text: str) -> np.ndarray:
        terms = set(_TERM.findall(text.lower()))
        known = self.known
        for term in terms.difference(known):
            known[term] = xxhash.xxh3_64_intdigest(term.encode())
        out = np.fromiter(map(known.__getitem__, terms), np.uint64, len(terms))
        if len(known) > _CACHE_TERMS:
            known.clear()
        out.sort()
        return out


def document_frequencies(texts: DataFrame) -> DataFrame:
    """`term` (its hash), `n`: documents of `texts` that have it. Summed in each task first."""

    def run(batches: Batches) -> Batches:
        terms = Terms()
        held, size = [], 0

        def summed() -> pa.RecordBatch:
            names, n = np.unique(np.concatenate(held), return_counts=True)
            return record(_COUNTS, names.view(np.int64), n)

        for batch in batches:
            for text in batch.column(0).to_pylist():
                held.append(terms.of(text))
                size += len(held[-1])
            if size > 4_000_000:
                yield summed()
                held, size = [], 0
        if held:
            yield summed()

    small_batches(texts.sparkSession)
    return texts.select("text").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))


@dataclass(frozen=True)
class Lexicon:
    """Sorted hashes of the terms in the band, and the subsets' seeds and thresholds."""

    terms: np.ndarray

    @property
    def seeds(self) -> np.ndarray:
        return np.array([xxhash.xxh3_64_intdigest(f"subset {k}") for k in range(len(DENSITIES))], np.uint64)

    @property
    def thresholds(self) -> np.ndarray:
        return np.array([int(d * 2**64) for d in DENSITIES], np.uint64)

    @classmethod
    def of(cls, docs: DataFrame, id_col: str, text_col: str, least: float, most: float) -> Lexicon:
        """Counts the terms of all documents; only the band reaches the driver."""
        texts = identified(docs, id_col, text_col)
        total = texts.count()
        counted = document_frequencies(texts)
        # a term of a single document tells nothing about likeness
        band = counted.where((F.col("n") >= max(2, least * total)) & (F.col("n") <= max(2, most * total)))
        terms = band.select("term").toArrow().column(0).to_numpy()
        return cls(np.sort(terms.view(np.uint64)))


class Fingerprinter:
    def __init__(self, lexicon: Lexicon):
        self.lexicon = lexicon.terms
        self.seeds, self.thresholds = lexicon.seeds, lexicon.thresholds
        self.terms = Terms()

    def of(self, text: str) -> list[str]:
        """One hash per subset, zeros where the text has no term of it, and one more.

        The last one is for texts without any term of the lexicon: the hash of all their
        terms, which keeps different ones apart. It is zeros for all other texts.
        """
        every = self.terms.of(text)
        at = np.searchsorted(self.lexicon, every)
        inside = at < len(self.lexicon)
        inside[inside] = self.lexicon[at[inside]] == every[inside]
        terms = every[inside]
        mixed = (terms[:, None] ^ self.seeds) * np.uint64(0x9E3779B97F4A7C15)
        mixed = (mixed ^ (mixed >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        chosen = mixed < self.thresholds
        out = []
        for k, some in enumerate(chosen.any(0).tolist()):
            digest = xxhash.xxh3_64_hexdigest(terms[chosen[:, k]].tobytes()) if some else "0" * HEX_DIGITS
            out.append(digest[:HEX_DIGITS])
        strange = len(every) and not len(terms)
        out.append(xxhash.xxh3_64_hexdigest(every.tobytes())[:HEX_DIGITS] if strange else "0" * HEX_DIGITS)
        return out


def likeness(a: list[str], b: list[str]) -> float:
    """Agreed subsets out of those in which either text has terms; 1 for equal fingerprints."""
    if a == b:
        return 1.0
    empty = "0" * HEX_DIGITS
    pairs = [(x, y) for x, y in zip(a, b, strict=True) if x != empty or y != empty]
    return sum(x == y for x, y in pairs) / len(pairs)


_OUT = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("n_chars", pa.int64()),
        ("edited_sha256", pa.string()),
        ("fingerprint", pa.string()),
        ("edited_fingerprint", pa.string()),
        ("near_edited", pa.float64()),
        ("near_next", pa.float64()),
    ]
)
_SCHEMA = (
    "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string,"
    " near_edited double, near_next double"
)


def fingerprints(docs: DataFrame, lexicon: Lexicon, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`doc_id`, `fingerprint` of every row; equal texts have equal fingerprints."""
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)
    out = pa.schema([("doc_id", pa.int64()), ("fingerprint", pa.string())])

    def start():
        printer = Fingerprinter(shared.value)

        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            return record(out, batch.column(0), ["".join(printer.of(t)) for t in batch.column(1).to_pylist()])

        return each

    texts = identified(docs, id_col, text_col).select(F.col("id").cast("long"), "text")
    return arrow_map(texts, start, "doc_id long, fingerprint string")


def edit_likeness(
    docs: DataFrame,
    lexicon: Lexicon,
    id_col: str = "doc_id",
    text_col: str = "text",
    rows_per_shard: int = SHARD_ROWS,
) -> DataFrame:
    """Each text's fingerprint against those of its edited text and of the next document.

    The next document is the one of next smaller key (after the smallest, the largest);
    rows of equal keys follow each other by text. The edited text has the last third of
    the code points, rounded down, replaced by as many from the start of the next
    document. Keys are dealt to range shards; the row that follows a shard's smallest
    key is copied to that shard, so no row looks outside its task. NULL keys come last,
    NULL texts are empty, every row gives one row; a single row is its own next.
    """
    spark = docs.sparkSession
    texts = identified(docs, id_col, text_col).select(F.col("id").cast("long"), key_column("id").alias("key"), "text")
    shards = Shards.of(texts.select("key"), rows_per_shard)
    dealt = texts.withColumn("shard", shards.column(F.col("key")))
    # one row per shard
    highest = sorted((r.shard, r.key) for r in dealt.groupBy("shard").agg(F.max("key").alias("key")).collect())
    if not highest:
        return spark.createDataFrame([], _SCHEMA)
    follows = [(key, highest[(k + 1) % len(highest)][0]) for k, (_, key) in enumerate(highest)]
    borders = F.broadcast(spark.createDataFrame(follows, "key long, shard int"))
    copies = texts.join(borders, "key").select("id", "key", "text", "shard", F.lit(True).alias("copy"))
    placed = dealt.withColumn("copy", F.lit(False)).union(copies)
    in_order = placed.repartitionById(shards.count, F.col("shard")).sortWithinPartitions(
        "shard", "copy", F.desc("key"), F.desc("text")
    )
    shared = spark.sparkContext.broadcast(lexicon)

    def run(batches: Batches) -> Batches:
        printer = Fingerprinter(shared.value)
        waiting: tuple | None = None  # shard, id, text, fingerprint
        for batch in batches:
            rows = []
            for shard, copy, doc, text in _rows(batch):
                if copy and (waiting is None or waiting[0] != shard):
                    continue
                prints = printer.of(text)
                if waiting is not None:
                    rows.append(_compared(waiting, text, prints, printer))
                waiting = None if copy else (shard, doc, text, prints)
            yield record(_OUT, *(zip(*rows, strict=True) if rows else [[]] * len(_OUT)))

    return in_order.select("shard", "copy", "id", "text").mapInArrow(run, _SCHEMA)


def _rows(batch: pa.RecordBatch) -> Iterator[tuple]:
    return zip(*(c.to_pylist() for c in batch.columns), strict=True)


def _compared(row: tuple, next_text: str, next_prints: list[str], printer: Fingerprinter) -> tuple:
    _, doc, text, prints = row
    n = len(text)
    edited = text[: n - n // 3] + next_text[: n // 3]
    edited_prints = printer.of(edited)
    return (
        doc,
        n,
        hashlib.sha256(edited.encode()).hexdigest(),
        "".join(prints),
        "".join(edited_prints),
        likeness(prints, edited_prints),
        likeness(prints, next_prints),
    )
