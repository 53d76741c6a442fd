"""Phrases whose words stand together more often than they do elsewhere.

Phrases are counted in three passes: words, pairs, then windows of three to five words. A
phrase is frequent only if all of its parts are, so pairs are counted between frequent words
and windows along frequent pairs. The tasks know these by filters of a fixed largest size
that may let more through, never less.

Words are 64-bit hashes. A task counts windows in a HAT-trie: hash containers under a shallow
trie of word ids, where a container that grows too large bursts. Past a number of entries,
whole subtrees leave as sorted runs. Spark deals the runs by the prefix
that all phrases of a pass have (two words, or three), sorts them, and each partition adds up
its runs in order, giving the counts of all phrase lengths at once. Equal windows of a task
leave as one row, so a hot pair or prefix costs its distinct continuations, not its
occurrences.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from accesslens.llm.shared import quoted, record, small_batches, stored

LONGEST = 5
#: Entries of a container before it bursts, and of a trie before subtrees are spilled (100 MB).
BURST = 32_768
TRIE_ENTRIES = 1_500_000
#: Words and their ids that a task remembers, and distinct words that it counts, at a time.
KNOWN_WORDS = 300_000
#: Bytes of text that are split into words together.
SLICE_BYTES = 2 << 20
#: Bits of a filter per key; segments of a filter; the largest filter is 128 MB.
FILTER_BITS = 16
SEGMENT_BITS = 1 << 16
MAX_SEGMENTS = 1 << 14

_BREAK = b"\xff"  # in no UTF-8 text
_LETTERS = bytes.maketrans(
    bytes(range(65, 91)) + b".,;:!?\n\v\f\r", bytes(range(97, 123)) + _BREAK * len(b".,;:!?\n\v\f\r")
)
_RUNS = pa.schema([("words", pa.binary()), ("n", pa.int64())])
_WORDS = pa.schema([("lang", pa.string()), ("word", pa.string()), ("n", pa.int64())])
_RUNS_DDL = "words binary, n long"


def split_words(text: bytes) -> list[bytes]:
    """Words with A-Z as a-z; pieces end at a word that is one byte, FF."""
    return text.translate(_LETTERS).replace(_BREAK, b" \xff ").split()


def word_id(word: bytes) -> int:
    return xxhash.xxh64_intdigest(word, 42)


def _id_bytes(text: Column) -> Column:
    """The eight bytes of `word_id` of a text column."""
    return F.unhex(F.lpad(F.hex(F.xxhash64(text)), 16, "0"))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9FB21C651E98DF25)
    x = (x ^ (x >> np.uint64(28))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def _hashed(columns: list[np.ndarray]) -> np.ndarray:
    """One number for each row of id columns."""
    with np.errstate(over="ignore"):
        return reduce(lambda h, ids: _mixed(h * np.uint64(3) + ids), columns, np.zeros(1, np.uint64))


@dataclass(frozen=True)
class Filter:
    """A Bloom filter in segments; three bits a key, all in the segment of the key."""

    bits: np.ndarray

    @classmethod
    def of(cls, keys: DataFrame) -> Filter:
        """Over the `words` keys of a stored table; built by segment, at most 128 MB in all."""
        wanted = -(-keys.count() * FILTER_BITS // SEGMENT_BITS)
        segments = min(1 << max(wanted - 1, 0).bit_length(), MAX_SEGMENTS)
        small_batches(keys.sparkSession)

        def hashes(batches):
            for batch in batches:
                ids = _id_matrix(batch.column("words"))
                hashed = _hashed(list(ids.T))
                segment = (hashed >> np.uint64(48)).astype(np.int64) & (segments - 1)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(segment.astype(np.int32)), pa.array(hashed.view(np.int64))], names=["segment", "hashed"]
                )

        def build(table: pa.Table) -> pa.Table:
            bits = np.zeros(SEGMENT_BITS // 8, np.uint8)
            for place in cls._places(table.column("hashed").to_numpy().view(np.uint64)):
                np.bitwise_or.at(bits, place >> 3, np.uint8(1) << (place & 7).astype(np.uint8))
            return pa.table({"segment": table.column("segment")[:1], "bits": pa.array([bits.tobytes()])})

        hashed = keys.select("words").mapInArrow(hashes, "segment int, hashed long").distinct()
        rows = hashed.groupBy("segment").applyInArrow(build, "segment int, bits binary").toArrow()
        bits = np.zeros((segments, SEGMENT_BITS // 8), np.uint8)
        for segment, part in zip(rows.column("segment").to_pylist(), rows.column("bits").to_pylist()):
            bits[segment] = np.frombuffer(part, np.uint8)
        return cls(bits)

    @staticmethod
    def _places(hashed: np.ndarray) -> list[np.ndarray]:
        return [((hashed >> np.uint64(16 * k)) & np.uint64(0xFFFF)).astype(np.int64) for k in range(3)]

    def has(self, columns: list[np.ndarray]) -> np.ndarray:
        hashed = _hashed(columns)
        segment = (hashed >> np.uint64(48)).astype(np.int64) & (len(self.bits) - 1)
        found = np.ones(len(hashed), bool)
        for place in self._places(hashed):
            found &= (self.bits[segment, place >> 3] >> (place & 7).astype(np.uint8)) & 1 == 1
        return found


def _id_matrix(words: pa.Array, width: int | None = None) -> np.ndarray:
    """Keys of equal or unequal length as rows of ids, filled up with zeros."""
    offsets = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1]
    sizes = np.diff(offsets) // 8
    width = width or int(sizes.max(initial=1))
    ids = np.zeros((len(words), width), np.uint64)
    if len(words):
        flat = np.frombuffer(words.buffers()[2], np.uint8)[offsets[0] : offsets[-1]].view(">u8")
        ids[np.arange(width) < sizes[:, None]] = flat
    return ids


class _Container:
    """Windows of a trie range by their hash; new ones wait until they are as many as the counted ones."""

    def __init__(self, hashes: np.ndarray, rows: np.ndarray, counts: np.ndarray):
        self.hashes, self.rows, self.counts = hashes, rows, counts
        self.waiting: list[tuple[np.ndarray, np.ndarray]] = []
        self.entries = len(hashes)

    def add(self, hashes: np.ndarray, rows: np.ndarray) -> None:
        self.waiting.append((hashes, rows))
        self.entries += len(hashes)

    def settle(self) -> None:
        """Count what waits; windows of one hash are compared in full."""
        if not self.waiting:
            return
        hashes = np.concatenate([self.hashes, *(h for h, _ in self.waiting)])
        rows = np.concatenate([self.rows, *(r for _, r in self.waiting)])
        counts = np.concatenate([self.counts, np.ones(len(hashes) - len(self.counts), np.int64)])
        self.waiting = []
        order = np.argsort(hashes)
        hashes = hashes[order]
        new = np.ones(len(hashes), bool)
        new[1:] = hashes[1:] != hashes[:-1]
        same = np.flatnonzero(~new)
        new[same] = (rows[order[same]] != rows[order[same - 1]]).any(axis=1)
        at = np.flatnonzero(new)
        self.hashes, self.rows = hashes[at], rows[order[at]]
        self.counts = np.add.reduceat(counts[order], at)
        self.entries = len(at)

    def part(self, chosen: np.ndarray) -> _Container:
        return _Container(self.hashes[chosen], self.rows[chosen], self.counts[chosen])

    def leaves(self) -> list[_Container]:
        self.settle()
        return [self]


class _Node:
    """Children by the word at one depth; a child covers the words from its bound to the next."""

    def __init__(self, depth: int, child: _Container):
        self.depth, self.children = depth, [child]
        self.bounds = np.zeros(1, np.uint64)

    @property
    def entries(self) -> int:
        return sum(child.entries for child in self.children)

    def add(self, hashes: np.ndarray, rows: np.ndarray, burst: int) -> None:
        child = np.searchsorted(self.bounds, rows[:, self.depth], side="right") - 1
        order = np.argsort(child.astype(np.uint16), kind="stable")
        ends = np.cumsum(np.bincount(child, minlength=len(self.children)))
        for k in range(len(self.children) - 1, -1, -1):  # from the last, because children may burst
            mine = order[ends[k - 1] if k else 0 : ends[k]]
            if not len(mine):
                continue
            to = self.children[k]
            if isinstance(to, _Node):
                to.add(hashes[mine], rows[mine], burst)
                continue
            to.add(hashes[mine], rows[mine])
            if to.entries > burst + 2 * len(to.hashes):
                to.settle()
                self._burst(k, burst)

    def _burst(self, k: int, burst: int) -> None:
        """Halve the words of a container that is too large; one of a single word becomes a node."""
        whole = self.children[k]
        if whole.entries <= burst or len(self.children) >= 1 << 15:
            return
        words = whole.rows[:, self.depth]
        low, middle = words.min(), np.partition(words, len(words) // 2)[len(words) // 2]
        if low == words.max():
            if self.depth + 1 < whole.rows.shape[1]:
                self.children[k] = _Node(self.depth + 1, whole)
                self.children[k]._burst(0, burst)
            return
        cut = middle if middle > low else words[words > low].min()
        self.children[k : k + 1] = [whole.part(words < cut), whole.part(words >= cut)]
        self.bounds = np.insert(self.bounds, k + 1, cut)
        self._burst(k + 1, burst)
        self._burst(k, burst)

    def leaves(self) -> list[_Container]:
        return [leaf for child in self.children for leaf in child.leaves()]


class HatTrie:
    """Counts of windows of word ids: hash containers under a shallow trie of words.

    A container covers a range of words at its depth and bursts into two; one that covers a
    single word bursts into a node of the next depth. Windows are rows of ids, filled up
    with zeros.
    """

    def __init__(self, width: int, burst: int = BURST, most: int = TRIE_ENTRIES):
        self.width, self.burst, self.most = width, burst, most
        self.root = _Node(0, self._empty())

    def _empty(self) -> _Container:
        return _Container(np.zeros(0, np.uint64), np.zeros((0, self.width), np.uint64), np.zeros(0, np.int64))

    @property
    def entries(self) -> int:
        return self.root.entries

    def add(self, rows: np.ndarray) -> None:
        self.root.add(_hashed(list(rows.T)), rows, self.burst)

    def spilled(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Once the trie is full, its largest subtrees, until half of the entries are left."""
        if self.entries <= self.most:
            return
        self.root.leaves()  # settles all
        left = self.entries
        for k in sorted(range(len(self.root.children)), key=lambda k: -self.root.children[k].entries):
            if 2 * left <= self.most:
                return
            left -= self.root.children[k].entries
            yield from self._taken(k)

    def rest(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for k in range(len(self.root.children)):
            yield from self._taken(k)

    def _taken(self, k: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """A subtree as a sorted run of windows and counts; its place stays, empty."""
        leaves = self.root.children[k].leaves()
        self.root.children[k] = self._empty()
        for leaf in leaves:  # the words of leaves ascend, so runs of leaves follow each other
            if leaf.entries:
                order = np.lexsort(leaf.rows.T[::-1])
                yield leaf.rows[order], leaf.counts[order]


def _run(lang: np.uint64, rows: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
    """Windows as keys: the language and the words, eight bytes each."""
    full = np.concatenate([np.full((len(rows), 1), lang, np.uint64), rows], axis=1)
    held = np.concatenate([np.ones((len(rows), 1), bool), rows != 0], axis=1)
    offsets = np.concatenate([[0], np.cumsum(8 * held.sum(axis=1))]).astype(np.int32)
    flat = full[held].astype(">u8").tobytes()
    words = pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(flat)])
    return record(_RUNS, words, counts)


def _by_language(batch: pa.RecordBatch) -> Iterator[tuple[str, bytes]]:
    """Texts of one language, some MB at a time, with breaks between them."""
    langs = batch.column("lang").to_pylist()
    texts = batch.column("text").cast(pa.binary()).to_pylist()
    held: dict[str, list[bytes]] = {}
    sizes: Counter[str] = Counter()
    for lang, text in zip(langs, texts):
        held.setdefault(lang, []).append(text)
        sizes[lang] += len(text)
        if sizes[lang] > SLICE_BYTES:
            yield lang, _BREAK.join(held.pop(lang))
            del sizes[lang]
    for lang, texts in held.items():
        yield lang, _BREAK.join(texts)


def _texts(docs: DataFrame, text_col: str, lang_col: str) -> DataFrame:
    text = F.coalesce(F.col(quoted(text_col)).cast("string"), F.lit(""))
    lang = F.coalesce(F.col(quoted(lang_col)).cast("string"), F.lit("und"))
    return docs.select(lang.alias("lang"), text.alias("text"))


def word_counts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """`lang`, `word`, `n`: the occurrences of each word; under a NULL word, those of all words."""
    small_batches(docs.sparkSession)

    def run(batches):
        counted: dict[str, Counter[bytes]] = {}

        def taken():
            for lang, words in counted.items():
                total = words.total()
                names = [word.decode("utf-8") for word in words]
                yield record(_WORDS, [lang] * (len(names) + 1), [*names, None], [*words.values(), total])
            counted.clear()

        for batch in batches:
            for lang, text in _by_language(batch):
                words = counted.setdefault(lang, Counter())
                words.update(split_words(text))
                del words[_BREAK]
            if sum(map(len, counted.values())) > KNOWN_WORDS:
                yield from taken()
        yield from taken()

    each = _texts(docs, text_col, lang_col).mapInArrow(run, "lang string, word string, n long")
    return each.groupBy("lang", "word").agg(F.sum("n").alias("n"))


class _Ids(dict):
    """Ids of the words of one language that pass a filter; 0 of all others."""

    def __init__(self, lang: np.uint64, words: Filter):
        self.lang, self.words = lang, words
        self[_BREAK] = 0

    def of(self, words: list[bytes]) -> np.ndarray:
        new = list(set(words).difference(self))
        if new:
            if len(self) + len(new) > KNOWN_WORDS:
                self.clear()
                self[_BREAK] = 0
                new = list(set(words) - {_BREAK})
            ids = np.fromiter(map(word_id, new), np.uint64, len(new))
            ids[~self.words.has([np.full(len(ids), self.lang), ids])] = 0
            self.update(zip(new, ids.tolist()))
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def _windows(lang: np.uint64, ids: np.ndarray, pairs: Filter | None) -> np.ndarray:
    """Rows of ids, filled up with zeros.

    Without a filter of pairs, all pairs; with it, windows of three to five words whose
    pairs pass it, as long as they can be from each word on.
    """
    width = LONGEST if pairs else 2
    ids = np.concatenate([ids, np.zeros(width, np.uint64)])
    joined = (ids[:-1] != 0) & (ids[1:] != 0)
    if pairs:
        at = np.flatnonzero(joined)
        joined[at] = pairs.has([np.full(len(at), lang), ids[at], ids[at + 1]])
    size = np.ones(len(ids) - width, np.int64)
    on = np.ones(len(size), bool)
    for k in range(width - 1):
        on &= joined[k : k + len(size)]
        size += on
    at = np.flatnonzero(size >= (3 if pairs else 2))
    columns = [np.where(k < size[at], ids[at + k], 0) for k in range(width)]
    return np.stack(columns, axis=1)


def sorted_runs(
    docs: DataFrame, words: Filter, pairs: Filter | None, text_col: str, lang_col: str, most: int = TRIE_ENTRIES
) -> DataFrame:
    """`words`, `n`: keys of windows and their counts, as each task's trie gives them up."""
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast((words, pairs))

    width = LONGEST if pairs else 2

    def run(batches):
        words, pairs = shared.value
        tries: dict[str, HatTrie] = {}
        known: dict[str, _Ids] = {}

        def taken():
            for lang, trie in tries.items():
                yield from (_run(known[lang].lang, *part) for part in trie.rest())
            tries.clear()
            known.clear()

        for batch in batches:
            for lang, text in _by_language(batch):
                if lang not in known:
                    known[lang] = _Ids(np.uint64(word_id(lang.encode())), words)
                ids = known[lang].of(split_words(text))
                # a trie for each language: they share no words
                trie = tries.setdefault(lang, HatTrie(width, min(BURST, most // 8), most))
                rows = _windows(known[lang].lang, ids, pairs)
                if len(rows):
                    trie.add(rows)
                    yield from (_run(known[lang].lang, *part) for part in trie.spilled())
            if sum(trie.entries for trie in tries.values()) > 2 * most or len(known) > 64:
                yield from taken()
        yield from taken()

    return _texts(docs, text_col, lang_col).mapInArrow(run, _RUNS_DDL)


def merged_runs(runs: DataFrame, shortest: int, longest: int, min_count: int) -> DataFrame:
    """`words`, `n` of all phrases of these lengths with at least `min_count` occurrences.

    Runs meet by their first `shortest` words, in order; a phrase's count is that of all
    windows that begin with it, which follow each other.
    """
    dealt = runs.repartition(F.substring("words", 1, 8 * (shortest + 1))).sortWithinPartitions("words")
    width = longest + 1

    def run(batches):
        open_ = {m: (np.zeros(m + 1, np.uint64), 0) for m in range(shortest, longest + 1)}
        for batch in batches:
            ids, n = _id_matrix(batch.column("words"), width), batch.column("n").to_numpy()
            for m in open_:
                held, (open_[m], phrases, counts) = open_[m], _added(ids, n, m, open_[m])
                del held
                yield _frequent(phrases, counts, min_count)
        for last, total in open_.values():
            yield _frequent(last[None, :], np.array([total]), min_count)

    return dealt.mapInArrow(run, _RUNS_DDL)


def _added(ids: np.ndarray, n: np.ndarray, m: int, before: tuple) -> tuple:
    """Closed groups of equal first `m` words, after the open one, and what is open now."""
    full = ids[:, m] != 0
    rows = np.concatenate([before[0][None, :], ids[full, : m + 1]])
    n = np.concatenate([[before[1]], n[full]])
    new = np.ones(len(rows), bool)
    new[1:] = (rows[1:] != rows[:-1]).any(axis=1)
    at = np.flatnonzero(new)
    sums = np.add.reduceat(n, at)
    return (rows[at[-1]], int(sums[-1])), rows[at[:-1]], sums[:-1]


def _frequent(rows: np.ndarray, counts: np.ndarray, min_count: int) -> pa.RecordBatch:
    kept = counts >= min_count
    return record(_RUNS, [row.tobytes() for row in rows[kept].astype(">u8")], counts[kept])


def frequent_phrases(
    docs: DataFrame,
    min_count: int,
    text_col: str = "text",
    lang_col: str = "lang",
    trie_entries: int = TRIE_ENTRIES,
) -> tuple[DataFrame, DataFrame]:
    """The words of `word_counts` with at least `min_count` occurrences, and `words`, `n` of phrases of one to five.

    `words` holds eight bytes for the language and eight for each word.
    """
    counted = word_counts(docs, text_col, lang_col)
    words = stored(counted.where((F.col("n") >= min_count) | F.col("word").isNull()))
    singles = words.where("word IS NOT NULL").select(F.concat(_id_bytes("lang"), _id_bytes("word")).alias("words"), "n")
    of_words = Filter.of(singles)
    pairs = stored(merged_runs(sorted_runs(docs, of_words, None, text_col, lang_col, trie_entries), 2, 2, min_count))
    of_pairs = Filter.of(pairs)
    windows = sorted_runs(docs, of_words, of_pairs, text_col, lang_col, trie_entries)
    longer = stored(merged_runs(windows, 3, LONGEST, min_count))
    return words, singles.union(pairs).union(longer)


def _part(words: Column, start: Column | int, size: Column) -> Column:
    """`size` words of a key from word `start` (0 is the first), under the same language."""
    return F.concat(F.substring(words, 1, 8), F.substring(words, start * 8 + 9, size * 8))


def collocations(
    docs: DataFrame,
    text_col: str = "text",
    lang_col: str = "lang",
    min_count: int = 100,
    most: int = 2000,
    absorbed: int = 100,
    trie_entries: int = TRIE_ENTRIES,
) -> DataFrame:
    """The `most` best phrases of two to five words of each language.

    Returns `lang`, `rank`, `phrase`, its count `a`, the counts `l` and `r` of its parts at
    the cut of least score, the words `n` of the language, and `score`, the whole number
    1000 a n / (l r). A phrase inside a longer frequent one that has at least `absorbed`
    percent of its count is left out. Ties go to the higher count, then to the lesser phrase
    by UTF-8 bytes; tied cuts to the earlier one. A NULL text has no words, a NULL language
    is `und`; repeated rows count again, keys and other columns are not read. Without
    frequent phrases the result is empty.
    """
    words, phrases = frequent_phrases(docs, min_count, text_col, lang_col, trie_entries)
    length = (F.octet_length("words") / 8 - 1).cast("int")
    candidates = phrases.withColumn("length", length).where("length > 1")

    longer = candidates.where("length > 2").select(
        F.explode(F.array(*(_part(F.col("words"), k, F.col("length") - 1) for k in (0, 1)))).alias("words"), "n"
    )
    longer = longer.groupBy("words").agg(F.max("n").alias("n_longer"))
    alone = (
        candidates.join(longer, "words", "left")
        .where(F.coalesce(100 * F.col("n_longer") < absorbed * F.col("n"), F.lit(True)))
        .select("words", "length", F.col("n").alias("a"))
    )

    cut = alone.select("*", F.explode(F.sequence(F.lit(1), F.col("length") - 1)).alias("k"))
    for name, start, size in (("l", F.lit(0), F.col("k")), ("r", F.col("k"), F.col("length") - F.col("k"))):
        part = phrases.select(F.col("words").alias("part"), F.col("n").alias(name))
        cut = cut.withColumn("part", _part(F.col("words"), start, size)).join(part, "part").drop("part")
    totals = words.where("word IS NULL").select(_id_bytes("lang").alias("root"), "lang", "n")
    big = {c: F.col(c).cast("decimal(19,0)") for c in ("a", "l", "r", "n")}
    cut = (
        cut.withColumn("root", F.substring("words", 1, 8))
        .join(totals, "root")
        .withColumns({"up": F.lit(1000) * big["a"] * big["n"], "down": big["l"] * big["r"]})
        .withColumn("score", F.expr("up div down"))
    )
    least = F.min(F.struct("score", "k", "l", "r")).alias("cut")
    scored = cut.groupBy("words", "length", "a", "lang", "n").agg(least)
    scored = scored.select("words", "length", "lang", "a", "cut.l", "cut.r", "n", "cut.score")

    by_score = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"))
    best = scored.withColumn("rank", F.rank().over(by_score)).where(F.col("rank") <= most).drop("rank")
    best = stored(best)
    named = words.where("word IS NOT NULL").select(F.concat(_id_bytes("lang"), _id_bytes("word")).alias("one"), "word")
    spelled = (
        best.select("words", F.explode(F.sequence(F.lit(0), F.col("length") - 1)).alias("at"))
        .withColumn("one", _part(F.col("words"), F.col("at"), F.lit(1)))
        .join(named, "one")
        .groupBy("words")
        .agg(F.array_sort(F.collect_list(F.struct("at", "word"))).alias("spelled"))
        .select("words", F.array_join("spelled.word", " ").alias("phrase"))
    )
    in_order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = best.join(spelled, "words").withColumn("rank", F.row_number().over(in_order).cast("long"))
    return ranked.where(F.col("rank") <= most).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
