"""Passages that repeat across documents, by compact windows.

The tokens of a text are its five-word shingles. For a hash function, the Cartesian
tree over the token hashes gives every token the widest stretch in which it is the
least; all subsequences inside that stretch and over that token share the min-hash. Of
these compact windows only those as long as the shortest passage count, about 2n / t
for n tokens. Their tokens are exactly the sliding minima, and so are all their
ancestors in the tree, so the tree is built over sliding minima alone.

Windows meet by hash function and min-hash. Windows with the same words for a passage's
length on both sides are one class and link as they are; only one of each class goes
on. What remains of a min-hash is compared stretch by stretch, in cells of rows that
share shingles far from the token, and links each row to the first one of its group.
Components of all links are the classes of documents.
"""

from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from accesslens.llm.components import components
from accesslens.llm.shared import (
    Batches,
    arrow_map,
    drop_caches_of_others,
    identified,
    record,
    row_key,
    small_batches,
    stored,
)

SHINGLE = 5
#: Words of the shortest passage, and the similarity of shingle sets that links.
PASSAGE_WORDS, SIMILARITY = 50, 0.8
#: A passage of similarity 0.8 misses all of these with probability 0.2 ** 6.
HASHES = 6
#: Words inserted or dropped that the comparison looks past.
SLACK = 2
#: Shingles past a stretch, or past the token before it, among which one of another partner matches: a passage
#: misses at most 5 of 46, and ends at most 4 before the token.
BEYOND = 4 + 5 + 1
#: Most windows on either side of a cell.
CELL = 1024
#: Keys of over so many cells are looked through by several tasks.
MANY = 32
#: Cells of at most so many rows have all pairs compared.
FEW = 8
#: Rows of the cells that are compared together, about, and pairs compared at once.
CELLS_ROWS, PAIRS = 16384, 2048
#: Pairs of a round, about.
ROUND = 1 << 16
#: Cells of more rows have their pairs looked through by one byte of each shingle first, so many at once.
WIDE, BLOCK = 64, 8192

#: Windows go to so many shards by their key; those packed and those sorted at once, about.
SHARD_BITS, WINDOWS_ROWS = 12, 400_000
#: Kinds of rows from one pass, and what is told of a window.
ROW, LINK, WINDOW = 0, 1, 2
AGAIN, COMMON = 1, 2

_MIX = np.uint64(0x9E3779B97F4A7C15)
_WINDOWS = pa.schema(
    [("key", pa.int64()), ("around", pa.int64()), ("text_id", pa.int64()), ("at", pa.int32()),
     ("first", pa.int32()), ("last", pa.int32()), ("again", pa.bool_())]
)
_TAGGED = pa.schema(
    [("kind", pa.int32()), ("a", pa.int64()), ("b", pa.int64()), ("first", pa.int32()), ("last", pa.int32()),
     ("row_key", pa.string()), ("n", pa.int64()), ("shard", pa.int32()), ("packed", pa.binary())]
)
_TAGGED_TYPE = "kind int, a long, b long, first int, last int, row_key string, n long, shard int, packed binary"
_WINDOWS_TYPE = "key long, around long, text_id long, at int, first int, last int, again boolean"
_CONTEXTS = pa.schema(
    [("key", pa.int64()), ("text_id", pa.int64()), ("at", pa.int32()), ("outer", pa.list_(pa.int64())),
     ("context", pa.binary())]
)
_CELLS = ("key", "part_of", "i", "j", "home", "text_id", "at", "context")
_LINKS = pa.schema(
    [("a", pa.int64()), ("b", pa.int64()), ("first", pa.int32()), ("last", pa.int32())]
)


def _mixed(values: np.ndarray) -> np.ndarray:
    values = (values ^ (values >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return values ^ (values >> np.uint64(29))


@cache
def _characters() -> tuple[np.ndarray, np.ndarray]:
    """Of every code point: whether words hold it, and a number that ignores its case."""
    every = [chr(c) if not 0xD800 <= c < 0xE000 else " " for c in range(0x110000)]
    inside = np.array([c.isalnum() for c in every])
    lowered = np.array([ord(c.lower()[0]) for c in every], np.uint64)
    return inside, _mixed(lowered * _MIX + np.uint64(1))


def word_hashes(texts: list[str]) -> list[np.ndarray]:
    """Each text's words as 64-bit hashes; all texts are hashed on one flat array."""
    inside, number = _characters()
    codes = np.frombuffer("\n".join(texts).encode("utf-32-le"), np.uint32)
    place = np.flatnonzero(inside[codes])
    if not len(place):
        return [np.zeros(0, np.uint64)] * len(texts)
    fresh = np.r_[True, np.diff(place) > 1]
    starts = np.flatnonzero(fresh)
    offset = np.arange(len(place)) - np.repeat(starts, np.diff(np.r_[starts, len(place)]))
    spread = _mixed(number[codes[place]] + offset.astype(np.uint64) * _MIX)
    words = _mixed(np.add.reduceat(spread, starts))
    ends = np.cumsum([len(t) + 1 for t in texts])
    cuts = np.searchsorted(place[starts], ends[:-1])
    return np.split(words, cuts)


def text_id(words: np.ndarray) -> int:
    """One number for a sequence of words."""
    return int(np.int64(np.uint64(xxhash.xxh3_64_intdigest(words.tobytes())).view(np.int64)))


def shingles(words: np.ndarray) -> np.ndarray:
    out = np.zeros(max(0, len(words) - SHINGLE + 1), np.uint64)
    for k in range(SHINGLE):
        out = _mixed(out * _MIX + words[k : k + len(out)])
    return out


def compact_windows(hashes: np.ndarray, ends: np.ndarray, shortest: int) -> tuple[np.ndarray, ...]:
    """Token, first and last token of every compact window of `shortest` tokens or more.

    `hashes` holds the tokens of several texts, each up to one of `ends`. Hashes count by
    their first 40 bits (fewer in batches of over 16 million tokens); of equal ones the first token is the least.
    """
    n = len(hashes)
    if n < shortest:
        return (np.zeros(0, np.int64),) * 3
    begins = np.r_[0, ends[:-1]]
    low = np.uint64((1 << max(24, n.bit_length())) - 1)
    ranked = (hashes & ~low) | np.arange(n, dtype=np.uint64)
    least, width = ranked, 1
    while width < shortest:
        step = min(width, shortest - width)
        least = np.minimum(least[: len(least) - step], least[step:])
        width += step
    # stretches over the end of a text don't count
    text = np.repeat(np.arange(len(ends)), ends - begins)
    inside = text[: len(least)] == text[shortest - 1 :]
    chosen = np.zeros(n, bool)
    chosen[(least[inside] & low).astype(np.int64)] = True
    at = np.flatnonzero(chosen)
    # Cartesian trees over the minima: the nearest smaller ones end a window
    of, ranks = text[at], ranked[at]
    low, high = np.searchsorted(of, of), np.searchsorted(of, of, side="right")
    before, after = _smaller_before(ranks, low), len(at) - 1 - _smaller_before(ranks[::-1], len(at) - high[::-1])[::-1]
    first = np.where(before >= low, at[before] + 1, begins[of])
    last = np.where(after < high, at[np.minimum(after, len(at) - 1)] - 1, ends[of] - 1)
    return at, first, last


def _smaller_before(ranks: np.ndarray, low: np.ndarray) -> np.ndarray:
    """Of each rank the place of the nearest smaller one before it, less than `low` if there is none from there on.

    A rank looks at the one before it. While that is larger, it looks at what that one
    looks at, since all between them are larger still.
    """
    look = np.arange(-1, len(ranks) - 1)
    live = np.arange(len(ranks))
    while True:
        live = live[(look[live] >= low[live]) & (ranks[look[live]] > ranks[live])]
        if not len(live):
            return look
        look[live] = look[look[live]]


class Runs:
    """Runs of equal tokens in texts that go up to `ends`."""

    def __init__(self, tokens: np.ndarray, ends: np.ndarray):
        text = np.repeat(np.arange(len(ends)), np.diff(np.r_[0, ends]))
        start = np.flatnonzero(np.r_[True, (tokens[1:] != tokens[:-1]) | (text[1:] != text[:-1])])
        sizes = np.diff(np.r_[start, len(tokens)])
        self.tokens, self.long = tokens, sizes > 1
        self.begin, self.finish = start, start + sizes - 1
        # the last tokens of the runs, by token, then by place
        tops = self.finish[self.long]
        self.kinds = np.unique(tokens[tops])
        self.tops = np.sort(np.searchsorted(self.kinds, tokens[tops]) * len(tokens) + tops)


def at_runs_ends(runs: Runs, found: tuple[np.ndarray, ...], shortest: int) -> tuple[np.ndarray, ...]:
    """Windows like those of `compact_windows`, fewer of them where one word comes over and over.

    Every token of a run of equal ones is a minimum, so the run has as many windows. A
    stretch of `shortest` tokens from one of them on lies in the run, and then any such
    stretch of the run says the same, or it holds the run's last token. So instead stand
    the first token, every `shortest`-th one after it, and the last one; a minimum stands
    for the last tokens of all runs of its like in its stretch, which an edit may have parted.
    """
    at, first, last = found
    if not len(runs.tops):
        return found
    run = np.searchsorted(runs.begin, at, side="right") - 1
    in_long = runs.long[run]
    if not in_long.any():
        return found
    tokens, kinds, tops = runs.tokens, runs.kinds, runs.tops
    begin, finish = runs.begin[run], runs.finish[run]
    inside = np.flatnonzero(in_long & (at + shortest - 1 <= finish))
    step = begin[inside] + (at[inside] - begin[inside]) // shortest * shortest
    number = np.searchsorted(kinds, tokens[at])
    known = kinds[np.minimum(number, len(kinds) - 1)] == tokens[at]
    low = np.searchsorted(tops, number * len(tokens) + at)
    high = np.searchsorted(tops, number * len(tokens) + np.minimum(at + shortest - 1, last), side="right")
    count = np.where(known, high - low, 0)
    count[inside] = 0
    of = np.repeat(np.arange(len(at)), count)
    top = tops[np.repeat(low, count) + np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count)] % len(tokens)
    alone = np.flatnonzero(~in_long | (at == begin))
    at = np.concatenate([at[alone], step, top])
    first = np.concatenate([first[alone], step, first[of]])
    last = np.concatenate([last[alone], step + shortest - 1, last[of]])
    # what stands for several windows covers them all
    order = np.argsort(at, kind="stable")
    one = np.flatnonzero(np.r_[True, np.diff(at[order]) != 0])
    return at[order][one], np.minimum.reduceat(first[order], one), np.maximum.reduceat(last[order], one)


class Stretches:
    """Hashes of any stretch of an array of words, from sums of words times powers."""

    BASE = np.uint64(0xD1342543DE82EF95)

    def __init__(self, words: np.ndarray):
        n = len(words)
        inverse = np.uint64(pow(int(self.BASE), -1, 1 << 64))
        powers = np.multiply.accumulate(np.full(n, self.BASE))
        self.shifts = np.r_[np.uint64(1), np.multiply.accumulate(np.full(n, inverse))]
        self.sums = np.r_[np.uint64(0), np.cumsum(_mixed(words) * powers, dtype=np.uint64)]

    def of(self, first: np.ndarray, end: np.ndarray) -> np.ndarray:
        same_place = (self.sums[end] - self.sums[first]) * self.shifts[first]
        return _mixed(same_place + (end - first).astype(np.uint64) * _MIX)


def _seeds(hashes: int) -> list[np.uint64]:
    return [np.uint64(xxhash.xxh3_64_intdigest(f"function {k}")) for k in range(hashes)]


def _windows_of(texts: list[np.ndarray], names: np.ndarray, passage_words: int, seeds: list[np.uint64]) -> list[np.ndarray]:
    """The columns of `windows` for texts of at least `passage_words` words."""
    shortest, reach = passage_words - SHINGLE + 1, passage_words - 1
    words, sizes = np.concatenate(texts), np.array([len(w) for w in texts])
    begins = np.cumsum(sizes) - sizes
    # a text's last words begin no shingle of its own
    own = np.ones(len(words), bool)
    for k in range(1, SHINGLE):
        own[begins + sizes - k] = False
    tokens, place = shingles(words)[own[: len(words) - SHINGLE + 1]], np.flatnonzero(own)
    ends = np.cumsum(sizes - SHINGLE + 1)
    stretches, runs = Stretches(words), Runs(tokens, ends)
    parts: list[tuple] = []
    for seed in seeds:
        values = _mixed(tokens ^ seed)
        at, first, last = at_runs_ends(runs, compact_windows(values, ends, shortest), shortest)
        least = values[at]
        of = np.searchsorted(ends, at, side="right")
        at, begin, end = place[at], place[first], place[last] + SHINGLE
        begin, finish = np.maximum(begin, at - reach), np.minimum(end, at + SHINGLE + reach)
        around = _mixed(stretches.of(begin, finish) ^ (at - begin).astype(np.uint64))
        parts.append((least, around, of, at, begin, finish - 1))
    keys, around, of, at, begin, finish = map(np.concatenate, zip(*parts, strict=True))
    # windows of the same words and text side by side, in their order
    order = np.argsort(_mixed(keys ^ (around + of.astype(np.uint64)) * _MIX), kind="stable")
    keys, around, of, at, begin, finish = (c[order] for c in (keys, around, of, at, begin, finish))
    fresh = np.r_[True, (np.diff(keys) != 0) | (np.diff(around) != 0) | (np.diff(of) != 0)]
    group = np.flatnonzero(fresh)
    turn = (at - np.repeat(at[group], np.diff(np.r_[group, len(at)]))) // shortest
    one = np.flatnonzero(fresh | np.r_[True, (np.diff(turn) != 0) | (np.diff(at) > passage_words)])
    base = begins[of[one]]
    places = [at[one] - base, begin[one] - base, finish[np.r_[one[1:], len(at)] - 1] - base]
    return [keys[one], around[one], names[of[one]], *(p.astype(np.int32) for p in places), ~fresh[one]]


def windows(texts: DataFrame, passage_words: int, hashes: int) -> DataFrame:
    """`key`, `around`, `text_id`, `at`, `first`, `last`, `again` of the compact windows of all texts.

    `key` names hash function and min-hash, so the windows of equal runs always share one;
    `around` names the words of the window within a passage's length of its token, `first` and `last` where they are.
    Windows of the same words that follow each other closely are one row, which covers them;
    `again` tells that such a row is not the first of its text.
    """
    seeds = _seeds(hashes)

    def start():
        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = [w for w in word_hashes(batch.column(0).to_pylist()) if len(w) >= passage_words]
            if not texts:
                return record(_WINDOWS, *[[]] * 7)
            names = np.array([text_id(w) for w in texts], np.int64)
            keys, around, *others = _windows_of(texts, names, passage_words, seeds)
            return record(_WINDOWS, keys.view(np.int64), around.view(np.int64), *others)

        return each

    return arrow_map(texts.select("text"), start, _WINDOWS_TYPE, rows=256)


def _packed(passage_words: int) -> np.dtype:
    """A window in as few bytes as it takes: `left` and `right` tell how far its words go from the token."""
    far = np.min_scalar_type(4 * passage_words)
    return np.dtype(
        [("key", "<u8"), ("around", "<u8"), ("text", "<i8"), ("at", "<i4"), ("left", far), ("right", far), ("flags", "u1")]
    )


class _Classes:
    """Packed windows without repeats, by class (the same key and words), then by text and place."""

    def __init__(self, rows: np.ndarray):
        rows = rows[np.lexsort((rows["at"], rows["text"], rows["around"], rows["key"]))]
        fresh = np.r_[True, (np.diff(rows["key"]) != 0) | (np.diff(rows["around"]) != 0)]
        common = np.bitwise_or.reduceat(rows["flags"], np.flatnonzero(fresh)) & COMMON > 0
        other = fresh | np.r_[True, (np.diff(rows["text"]) != 0) | (np.diff(rows["at"]) != 0)]
        self.rows, fresh = rows[other], fresh[other]
        self.begin, self.of = np.flatnonzero(fresh), np.cumsum(fresh) - 1
        self.size = np.diff(np.r_[self.begin, len(self.rows)])
        self.low = self.rows["text"][self.begin]
        #: Classes of several texts.
        self.common = common | (self.low != self.rows["text"][self.begin + self.size - 1])

    def links(self) -> tuple[np.ndarray, ...]:
        """Text, least text of the class, first and last word of the windows of common classes."""
        of = np.flatnonzero(self.common[self.of])
        rows = self.rows[of]
        return rows["text"], self.low[self.of[of]], rows["at"] - rows["left"], rows["at"] + rows["right"]


def _dealt(columns: list[np.ndarray], passage_words: int) -> Batches:
    """Packed windows by shard of their keys, and the links of classes that are common here.

    Of such a class only the least window goes on, so a passage that every text has is one row.
    """
    key, around, text, at, first, last, again = columns
    mixed = _mixed(key * _MIX)
    order = np.argsort(mixed)
    mixed = mixed[order]
    rows = np.empty(len(key), _packed(passage_words))
    for name, values in zip(rows.dtype.names, (key, around, text, at, at - first, last - at, again * AGAIN), strict=True):
        rows[name] = values[order]
    repeated = mixed[1:] == mixed[:-1]
    met = np.flatnonzero(np.r_[False, repeated] | np.r_[repeated, False])
    if len(met):
        classes = _Classes(rows[met])
        a, b, first, last = classes.links()
        shard = (a.view(np.uint64) >> np.uint64(64 - SHARD_BITS)).astype(np.int32)
        yield _tagged(LINK, a, b, first, last, shard=shard)
        some = np.ones(len(classes.rows), bool)
        some[classes.common[classes.of]] = False
        some[classes.begin] = True
        classes.rows["flags"][classes.begin[classes.common]] |= COMMON
        rows = np.concatenate([np.delete(rows, met), classes.rows[some]])
        mixed = _mixed(rows["key"] * _MIX)
        order = np.argsort(mixed)
        rows, mixed = rows[order], mixed[order]
    shard, begin = np.unique(mixed >> np.uint64(64 - SHARD_BITS), return_index=True)
    offsets = (np.r_[begin, len(rows)] * rows.itemsize).astype(np.int32)
    packed = pa.Array.from_buffers(pa.binary(), len(shard), [None, pa.py_buffer(offsets), pa.py_buffer(rows)])
    yield _tagged(WINDOW, shard=shard.astype(np.int32), packed=packed)


def _tagged(kind: int, a=None, b=None, first=None, last=None, row_key=None, n=None, shard=None, packed=None) -> pa.RecordBatch:
    """Rows of one kind; columns that it does not use are NULL."""
    given = [a, b, first, last, row_key, n, shard, packed]
    rows = next(len(c) for c in given if c is not None)
    nulls = (pa.nulls(rows, field.type) for field in list(_TAGGED)[1:])
    return record(_TAGGED, np.full(rows, kind, np.int32), *(n if c is None else c for c, n in zip(given, nulls, strict=True)))


def _met(rows: np.ndarray, many: int) -> Batches:
    """Links and windows to compare of the packed windows of whole keys."""
    rows = rows[np.argsort(rows["key"])]
    begin = np.flatnonzero(np.r_[True, np.diff(rows["key"]) != 0])
    low, high = np.minimum.reduceat(rows["text"], begin), np.maximum.reduceat(rows["text"], begin)
    shared = (low != high) | (np.bitwise_or.reduceat(rows["flags"], begin) & COMMON > 0)
    rows = rows[np.repeat(shared, np.diff(np.r_[begin, len(rows)]))]
    if not len(rows):
        return
    classes = _Classes(rows)
    yield _tagged(LINK, *classes.links())
    # where no other text has these words, what is near the first place may be near the others
    wanted = ~classes.common[classes.of] & (classes.rows["flags"] & AGAIN > 0)
    wanted[classes.begin] = True
    rows = classes.rows[wanted]
    # the windows of one text are not compared with each other
    begin = np.flatnonzero(np.r_[True, np.diff(rows["key"]) != 0])
    several = np.minimum.reduceat(rows["text"], begin) != np.maximum.reduceat(rows["text"], begin)
    size = np.diff(np.r_[begin, len(rows)])
    rows, size = rows[np.repeat(several, size)], np.repeat(size[several], size[several])
    yield _tagged(WINDOW, rows["text"], rows["key"].view(np.int64), rows["at"], (size > many).astype(np.int32))


def shared_windows(texts: DataFrame, passage_words: int, hashes: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows of the texts, links and windows to compare, from one pass over `id`, `row_key` and `text`.

    `doc_id`, `row_key`, `text_id`, `n_words` of every row; `a`, `b`, `first`, `last`: texts whose
    windows have the same key and words, b the least of their class, and a's words there;
    `key`, `text_id`, `at`, `many`: one window of each class of a key, where several texts have it.
    Windows go by shard of their key, packed, to be sorted there.
    """
    small_batches(texts.sparkSession)
    seeds, many, owner = _seeds(hashes), MANY * CELL, __name__

    def found(batches: Batches) -> Batches:
        drop_caches_of_others(owner)
        kept: list[list[np.ndarray]] = []
        for batch in (b.slice(k, 256) for b in batches for k in range(0, b.num_rows, 256)):
            words = word_hashes(batch.column(2).to_pylist())
            names, sizes = np.array([text_id(w) for w in words], np.int64), np.array([len(w) for w in words])
            shard = (names.view(np.uint64) >> np.uint64(64 - SHARD_BITS)).astype(np.int32)
            yield _tagged(ROW, batch.column(0), names, row_key=batch.column(1), n=sizes, shard=shard)
            # copies have the same windows
            some = np.unique(names, return_index=True)[1]
            some = some[sizes[some] >= passage_words]
            if len(some):
                kept.append(_windows_of([words[k] for k in some], names[some], passage_words, seeds))
            if sum(len(c[0]) for c in kept) >= WINDOWS_ROWS:
                yield from _dealt([np.concatenate(c) for c in zip(*kept, strict=True)], passage_words)
                kept = []
        if kept:
            yield from _dealt([np.concatenate(c) for c in zip(*kept, strict=True)], passage_words)

    def met(batches: Batches) -> Batches:
        drop_caches_of_others(owner)
        kind, untagged = _packed(passage_words), list(range(7))
        # whole shards go together until they hold enough rows
        kept: list[bytes] = []
        size, last = 0, -1

        for batch in batches:
            packed = batch.column(8)
            yield batch.filter(packed.is_null()).select(untagged)
            batch = batch.filter(packed.is_valid())
            for shard, rows in zip(batch.column(7).to_pylist(), batch.column(8).to_pylist(), strict=True):
                if shard != last and size >= WINDOWS_ROWS:
                    yield from (b.select(untagged) for b in _met(np.frombuffer(b"".join(kept), kind), many))
                    kept, size = [], 0
                kept.append(rows)
                size, last = size + len(rows) // kind.itemsize, shard
        if kept:
            yield from (b.select(untagged) for b in _met(np.frombuffer(b"".join(kept), kind), many))

    dealt = texts.select(F.col("id").cast("long"), "row_key", "text").mapInArrow(found, _TAGGED_TYPE)
    dealt = dealt.repartition("shard").sortWithinPartitions("shard")
    every = stored(dealt.mapInArrow(met, _TAGGED_TYPE.partition(", shard")[0]))
    rows = every.where(F.col("kind") == ROW)
    links, wanted = every.where(F.col("kind") == LINK), every.where(F.col("kind") == WINDOW)
    return (
        rows.select(F.col("a").alias("doc_id"), "row_key", F.col("b").alias("text_id"), F.col("n").alias("n_words")),
        links.select("a", "b", "first", "last"),
        wanted.select(
            F.col("b").alias("key"), F.col("a").alias("text_id"), F.col("first").alias("at"), (F.col("last") > 0).alias("many")
        ),
    )


def _near(ones: np.ndarray, others: np.ndarray, passage_words: int, similarity: float) -> tuple:
    """Which pairs of contexts hold near passages, and where: first and last shingles of either.

    Contexts are columns with two bytes per word; equal words match, which those past the
    ends of a text never are. Shingles match at the same place or up to SLACK words
    aside. A passage is a stretch of the least length over the common token, in which the
    matched shingles m of either side reach the Jaccard similarity: m / (2 * length - m).
    What is reported begins and ends with a matched shingle.
    """
    length = passage_words - SHINGLE + 1
    size = len(ones) - SHINGLE + 1
    matched = np.zeros((2, size, ones.shape[1]), bool)
    for shift in range(-SLACK, SLACK + 1):
        a, b = max(0, -shift), max(0, shift)
        n = len(ones) - abs(shift)
        same = ones[a : a + n] == others[b : b + n]
        runs = same[: n - SHINGLE + 1].copy()
        for k in range(1, SHINGLE):
            runs &= same[k : n - SHINGLE + 1 + k]
        matched[0, a : a + len(runs)] |= runs
        matched[1, b : b + len(runs)] |= runs
    return _stretches(matched, length, similarity)


def _stretches(matched: np.ndarray, length: int, similarity: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs whose matches, by side and place, make up a near passage, and its first and last shingles on either side."""
    size = matched.shape[1]
    least = int(np.ceil(2 * length * similarity / (1 + similarity) - 1e-9))
    found = np.empty((size - length + 1, matched.shape[2]), bool)
    count = matched[:, :length].sum(1, dtype=np.uint16)
    for k in range(len(found)):
        np.any(count >= least, axis=0, out=found[k])
        if k + length < size:
            count += matched[:, k + length]
            count -= matched[:, k]
    near = np.flatnonzero(found.any(0))
    found = found[:, near]
    place = np.arange(size)[:, None]
    first, last = found.argmax(0), len(found) - 1 - found[::-1].argmax(0) + length - 1
    common = matched[:, :, near] & (place >= first) & (place <= last)
    return near, common.argmax(1), size - 1 - common[:, ::-1].argmax(1)


def _likely_near(ones: np.ndarray, others: np.ndarray, passage_words: int, similarity: float) -> tuple:
    """What `_near` finds, by two bytes of each shingle: all of its pairs, and stretches at least as wide."""
    size = len(ones)
    matched = np.zeros((2, size, ones.shape[1]), bool)
    for shift in range(-SLACK, SLACK + 1):
        a, b, n = max(0, -shift), max(0, shift), size - abs(shift)
        same = ones[a : a + n] == others[b : b + n]
        matched[0, a : a + n] |= same
        matched[1, b : b + n] |= same
    return _stretches(matched, passage_words - SHINGLE + 1, similarity)


def _shingles_of(contexts: np.ndarray, cell: np.ndarray) -> np.ndarray:
    """Hashes of the shingles of contexts in columns, four words of two bytes at once; they differ by cell."""
    size = len(contexts) - SHINGLE + 1
    hashes = np.zeros((size, contexts.shape[1]), np.uint64) + _mixed(cell.astype(np.uint64) * _MIX)
    for k in range(0, SHINGLE, 4):
        words = contexts[k : k + size].copy()
        for j in range(k + 1, min(k + 4, SHINGLE)):
            words |= contexts[j : j + size] << np.uint64(16 * (j - k))
        hashes = _mixed((hashes + words) * _MIX)
    return hashes


class _Shared:
    """Which rows of a cell hold the same shingle at about the same place."""

    def __init__(self, cell: np.ndarray, contexts: np.ndarray):
        size, n = len(contexts) - SHINGLE + 1, contexts.shape[1]
        hashes, inside = np.empty((size, n), np.uint64), np.ones((size, n), bool)
        for k in range(0, n, 512):
            part = slice(k, k + 512)
            hashes[:, part] = _shingles_of(contexts[:, part].astype(np.uint64), cell[part])
        for k in range(SHINGLE):
            inside &= contexts[k : k + size] > 0
        self.hashes = hashes
        # by hash, then by place; that few bits of the hash are left can only make more rows partners
        low = np.uint64((1 << hashes.size.bit_length()) - 1)
        places = np.flatnonzero(inside)
        values = (hashes.ravel()[places] & ~low) | places.astype(np.uint64)
        values.sort()
        same = np.flatnonzero(values[1:] & ~low == values[:-1] & ~low)
        twice = np.zeros(len(values), bool)
        twice[same] = twice[same + 1] = True
        values = values[twice]
        self.places, values = (values & low).astype(np.int64), values & ~low
        self.begin, self.count = np.zeros((2, hashes.size), np.int32)
        self.weight = np.zeros(hashes.size, np.int16)
        if not len(values):
            return
        # of each place, where the same shingles at most SLACK aside stand: by shingle, then by place
        group = np.cumsum(np.r_[False, values[1:] != values[:-1]])
        at = group * (size + 2 * SLACK) + self.places // n
        fresh = np.r_[True, at[1:] != at[:-1]]
        of, begin = np.cumsum(fresh) - 1, np.flatnonzero(fresh)
        one, end = at[begin], np.r_[begin[1:], len(at)]
        begins, ends = begin.copy(), end.copy()
        for k in range(1, SLACK + 1):
            close = np.flatnonzero(one[k:] - one[:-k] <= SLACK)
            begins[close + k], ends[close] = begin[close], end[close + k]
        counts = (ends - begins)[of]
        self.begin[self.places] = begins[of]
        self.count[self.places] = np.where(counts > 1, counts, 0)
        # matches pair one to one unless a row has the shingle again within twice SLACK
        again = np.zeros(hashes.shape, bool)
        for k in range(1, 2 * SLACK + 1):
            again[k:] |= (hashes[k:] == hashes[:-k]) & inside[k:]
        most = np.where(np.bincount(group, again.ravel()[self.places]) > 0, 2 * SLACK + 1, 1)
        self.weight[self.places] = np.where(counts > 1, most[group], 0)

    def bounds(self, passage_words: int, similarity: float) -> tuple[np.ndarray, np.ndarray]:
        """First and last shingle that a near passage of each row can reach with any partners.

        A place counts if its shingle stands at most SLACK aside once more, and as often as
        one row can match it. Matches of one partner lie up to SLACK past a stretch.
        """
        size, n = self.hashes.shape
        length = passage_words - SHINGLE + 1
        weight = self.weight.reshape(size, n)
        total = np.cumsum(np.pad(weight, ((1, 0), (0, 0))), axis=0, dtype=np.int16)
        start = np.arange(size - length + 1)
        within = total[np.minimum(size, start + length + SLACK)] - total[np.maximum(0, start - SLACK)]
        enough = within >= 2 * length * similarity / (1 + similarity) - 1e-9
        some = enough.any(0)
        low = np.where(some, enough.argmax(0), size)
        high = np.where(some, len(enough) - 1 - enough[::-1].argmax(0) + length - 1, -1)
        place = np.arange(size)[:, None]
        reached = (weight > 0) & (place >= low) & (place <= high)
        some = reached.any(0)
        return np.where(some, reached.argmax(0), size), np.where(some, size - 1 - reached[::-1].argmax(0), -1)

    def partners(self, rows: np.ndarray, edge: np.ndarray, step: int, turn: np.ndarray) -> tuple:
        """Of each row, whether it has a partner number `turn` past its edge, which, and whether it is new."""
        size, n = self.hashes.shape
        place = edge + step * np.arange(1, BEYOND + 1)[:, None]
        inside = (place >= 0) & (place < size)
        at = np.where(inside, place, 0) * n + rows
        sums = np.cumsum(np.where(inside, self.count[at], 0), axis=0)
        live = np.flatnonzero(turn < sums[-1])
        which = (sums[:, live] <= turn[live]).sum(0)
        before = np.where(which > 0, sums[which - 1, live], 0)
        at = at[which, live]
        other, row = np.divmod(self.places[self.begin[at] + turn[live] - before], n)
        own = at // n
        new = (row != rows[live]) & (abs(other - own) <= SLACK)
        # the shingle before it matched as well, so it has had its turn
        earlier, aside = own - step, other - step
        known = (which > 0) & (aside >= 0) & (aside < size)
        known[known] = self.hashes[earlier[known], rows[live[known]]] == self.hashes[aside[known], row[known]]
        return live, row, new & ~known


def _ranges(begin: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Numbers from each `begin` on, `count` of them, one range after the other."""
    return np.repeat(begin - np.cumsum(count) + count, count) + np.arange(count.sum())


def _united(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """`label`, where both ends of each edge a, b get one; labels are places, the least one wins."""
    while True:
        one, other = label[a], label[b]
        differ = one != other
        if not differ.any():
            return label
        a, b, one, other = a[differ], b[differ], one[differ], other[differ]
        moved = np.arange(len(label))
        np.minimum.at(moved, np.maximum(one, other), np.minimum(one, other))
        while (moved[moved] != moved).any():
            moved = moved[moved]
        label = moved[label]


def _parted(cell: np.ndarray, contexts: np.ndarray, passage_words: int, similarity: float) -> np.ndarray:
    """Cells cut into parts that share no shingle far from the token, so no near passage has rows in two of them.

    Cells of at most FEW rows stay as they are.
    """
    sizes = np.unique(cell, return_counts=True)[1]
    many = np.flatnonzero(np.repeat(sizes > FEW, sizes))
    if not len(many) or _sides(passage_words, similarity)[0] < 4:
        return cell
    hashes, inside = _outer(contexts[many], passage_words, similarity)
    hashes = _mixed(hashes ^ _mixed(cell[many].astype(np.uint64) * _MIX)[:, None])
    row = np.repeat(np.arange(len(many)), inside.sum(1))
    values = hashes[inside]
    order = np.argsort(values)
    row, values = row[order], values[order]
    same = np.flatnonzero(values[1:] == values[:-1])
    parts = cell.copy()
    parts[many] = cell[-1] + 1 + _united(np.arange(len(many)), row[same], row[same + 1])
    return parts


def _able(cell: np.ndarray, contexts: np.ndarray, passage_words: int, similarity: float) -> np.ndarray:
    """Rows of sorted cells that may hold a near passage: enough of their shingles stand there twice.

    Rows of cells of at most FEW are all compared and so are not looked at.
    """
    sizes = np.unique(cell, return_counts=True)[1]
    able = np.repeat((sizes > 1) & (sizes <= FEW), sizes)
    many = np.flatnonzero(np.repeat(sizes > FEW, sizes))
    if len(many):
        first, last = _Shared(cell[many], contexts[many].T).bounds(passage_words, similarity)
        able[many[first <= last]] = True
    return np.flatnonzero(able)


def _maybe(ones: np.ndarray, others: np.ndarray, passage_words: int, similarity: float) -> np.ndarray:
    """Which of `ones` may be near which of `others`, by one byte of each shingle, in columns.

    What `_near` asks of matches, for all pairs of two sets at once and without telling where they are.
    """
    length, size = passage_words - SHINGLE + 1, len(ones)
    enough = int(np.ceil(2 * length * similarity / (1 + similarity) - 1e-9))
    matched = np.zeros((2, size, ones.shape[1], others.shape[1]), bool)
    for shift in range(-SLACK, SLACK + 1):
        a, b, n = max(0, -shift), max(0, shift), size - abs(shift)
        same = ones[a : a + n, :, None] == others[b : b + n, None, :]
        matched[0, a : a + n] |= same
        matched[1, b : b + n] |= same
    matched, near = matched.view(np.uint8), np.zeros(matched.shape[2:], bool)
    count = matched[:, :length].sum(1, dtype=np.uint16)
    for k in range(size - length + 1):
        near |= (count >= enough).any(0)
        if k + length < size:
            count += matched[:, k + length]
            count -= matched[:, k]
    return near


def _forests(
    cell: np.ndarray, home: np.ndarray, names: np.ndarray, places: np.ndarray, contexts: np.ndarray,
    passage_words: int, similarity: float,
) -> pa.RecordBatch:
    """Links from each row to the first one that near passages of its cell join it to, with its widest stretch.

    A round compares some homes of every cell with the later rows not yet joined to them,
    homes before the others: so a group of copies joins in its first round. After that,
    joined rows are compared with those that share a shingle just past their stretch,
    until no stretch grows or all that the shared shingles allow is reached. What goes
    on without a gain takes twice as many homes or partners each time.
    """
    order = np.argsort(cell, kind="stable")
    cell, home, names, places, contexts = cell[order], home[order], names[order], places[order], contexts[order]
    cell = _parted(cell, contexts, passage_words, similarity)
    # the first homes of a cell are of several texts, as rows of one text are joined by rows of others
    mixed = _mixed((names.view(np.uint64) * _MIX + places.astype(np.uint64)) * _MIX)
    order = np.lexsort((mixed, ~home, cell))
    cell, home, names, places, contexts = cell[order], home[order], names[order], places[order], contexts[order]
    kept = _able(cell, contexts, passage_words, similarity)
    cell, home, names, places = cell[kept], home[kept], names[kept], places[kept]
    if not len(cell):
        return record(_LINKS, [], [], [], [])
    ones = contexts[kept].T.copy()
    # words are odd bytes and the space past an end is zero
    others = ones + (ones == 0) * np.uint16(2)
    start = np.flatnonzero(np.r_[True, np.diff(cell) != 0])
    end = np.r_[start[1:], len(cell)]
    part = np.repeat(np.arange(len(start)), end - start)
    # the last row of a cell has none after it
    homes_end = np.minimum(start + np.add.reduceat(home.astype(np.int64), start), end - 1)
    label, at, groups = np.arange(len(cell)), start.copy(), end - start
    few = groups <= FEW
    turns, wide = np.where(few, FEW, 1), groups > WIDE
    # two bytes of each shingle; those past an end are 0 on one side and 1 on the other
    coded = np.flatnonzero(~few[part])
    code_of = np.cumsum(~few[part]) - 1
    codes = np.empty((len(ones) - SHINGLE + 1, len(coded)), np.uint16)
    codes_of_others = codes.copy()
    for k in range(0, len(coded), 512):
        words = ones[:, coded[k : k + 512]]
        inside = words[: len(codes)] > 0
        for j in range(1, SHINGLE):
            inside &= words[j : j + len(codes)] > 0
        code = (_shingles_of(words.astype(np.uint64), np.zeros(1, np.int64)) >> np.uint64(48)).astype(np.uint16)
        codes[:, k : k + 512] = (code | np.uint16(2)) * inside
        codes_of_others[:, k : k + 512] = codes[:, k : k + 512] + ~inside
    size = len(ones) - SHINGLE + 1
    first, last = np.full(len(cell), size), np.full(len(cell), -1)

    def compared(h: np.ndarray, q: np.ndarray, sifted: bool = True) -> np.ndarray:
        """The near ones of the pairs that join two groups, and the stretches of rows then cover those of all pairs.

        By two bytes of their shingles most pairs are seen to change nothing; they are `sifted` out.
        """
        hits = [np.zeros(0, np.int64)]
        for k in range(0, len(h), PAIRS):
            hs, qs = h[k : k + PAIRS], q[k : k + PAIRS]
            some = np.arange(len(hs))
            if sifted:
                some, begin, finish = _likely_near(
                    codes[:, code_of[hs]], codes_of_others[:, code_of[qs]], passage_words, similarity
                )
                wider = label[hs[some]] != label[qs[some]]
                for rows, a, b in ((hs[some], begin[0], finish[0]), (qs[some], begin[1], finish[1])):
                    wider |= (a < first[rows]) | (b > last[rows])
                some = some[wider]
            if not len(some):
                continue
            hs, qs = hs[some], qs[some]
            near, begin, finish = _near(ones[:, hs], others[:, qs], passage_words, similarity)
            for rows, a, b in ((hs[near], begin[0], finish[0]), (qs[near], begin[1], finish[1])):
                np.minimum.at(first, rows, a)
                np.maximum.at(last, rows, b)
            hits.append(some[near] + k)
        return np.concatenate(hits)

    def likely(homes: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
        """The pairs of a home and a later row that may be near and are not joined yet."""
        found = [(homes[:0], homes[:0])]
        later = np.arange(homes[0] + 1, end)
        # most homes are of one group, whose rows they have no need of
        labels, counts = np.unique(label[homes], return_counts=True)
        group = labels[counts.argmax()]
        for own, rows in (
            (homes[label[homes] == group], later[label[later] != group]),
            (homes[label[homes] != group], later),
        ):
            for k in range(0, len(rows) if len(own) else 0, BLOCK):
                block = rows[k : k + BLOCK]
                for hs in np.array_split(own, -(-len(own) * len(block) // BLOCK)):
                    one, other = _maybe(
                        codes[:, code_of[hs]].astype(np.uint8), codes[:, code_of[block]].astype(np.uint8), passage_words, similarity
                    ).nonzero()
                    found.append((hs[one], block[other]))
        h, q = map(np.concatenate, zip(*found, strict=True))
        return h[q > h], q[q > h]

    while True:
        live = np.flatnonzero(((groups > 1) | few) & (at < homes_end))
        if not len(live):
            break
        # pairs of a round are bounded, but for those of one home
        most = 1 + ROUND // (end[live] - at[live]) * np.where(wide[live], 8, 1)
        count = np.minimum(np.minimum(turns[live], homes_end[live] - at[live]), most)
        small = ~wide[live]
        h = _ranges(at[live[small]], count[small])
        later = end[part[h]] - h - 1
        q, h = _ranges(h + 1, later), np.repeat(h, later)
        for k, n in zip(live[~small].tolist(), count[~small].tolist()):
            some = likely(np.arange(at[k], at[k] + n), end[k])
            h, q = np.r_[h, some[0]], np.r_[q, some[1]]
        open_ = ((label[h] != label[q]) | few[part[h]]) & (names[h] != names[q])
        h, q = h[open_], q[open_]
        alike = few[part[h]]
        order = np.argsort(~alike, kind="stable")
        h, q, n = h[order], q[order], alike.sum()
        linked = np.r_[compared(h[:n], q[:n], False), n + compared(h[n:], q[n:])]
        at[live] += count
        turns[live] = np.minimum(2 * turns[live], ROUND)
        linked = linked[label[h[linked]] != label[q[linked]]]
        if len(linked):
            label = _united(label, h[linked], q[linked])
            groups = np.bincount(part[label == np.arange(len(label))], minlength=len(start))
    met = np.flatnonzero(last >= 0)
    if not len(met):
        return record(_LINKS, [], [], [], [])
    # where every pair was compared, no stretch can grow
    rows = met[~np.repeat(few, end - start)[met]]
    shared = _Shared(cell[rows], ones[:, rows])
    least, most = shared.bounds(passage_words, similarity)
    # passages of two partners may lie on either side of the token
    token = passage_words - 1
    for edges, step, bound, beside in ((last, 1, most, np.maximum), (first, -1, least, np.minimum)):
        live, turn = np.flatnonzero(edges[rows] * step < bound * step), np.zeros(len(rows), np.int64)
        while len(live):
            before, edge = edges[rows], beside(edges[rows], token - step)
            count = np.minimum(turn[live] + 1, 1 + ROUND // len(live))
            of = np.repeat(live, count)
            has, partner, new = shared.partners(of, edge[of], step, _ranges(turn[live], count))
            turn[live] += count
            a, b = rows[of[has[new]]], rows[partner[new]]
            different = names[a] != names[b]
            compared(a[different], b[different])
            # done are those whose last turn had no partner
            more = np.zeros(len(of), bool)
            more[has] = True
            live = live[more[np.cumsum(count) - 1]]
            # a wider stretch looks past its new edge, also where it was done
            grown = np.flatnonzero(edges[rows] != before)
            turn[grown] = 0
            live = np.union1d(live, grown)
            live = live[edges[rows[live]] * step < bound[live] * step]
    base = places[met] - (passage_words - 1)
    begin, finish = base + first[met], base + last[met] + SHINGLE - 1
    return record(_LINKS, names[met], names[label[met]], begin.astype(np.int32), finish.astype(np.int32))


def _cell_ids(rows: pa.RecordBatch | pa.Table) -> np.ndarray:
    return np.stack([rows.column(k).to_numpy().astype(np.int64) for k in range(4)], 1)


def _sides(passage_words: int, similarity: float) -> tuple[int, int]:
    """How far from the token places stand of which every near passage matches one on either side: least and most.

    A stretch of a passage's length in a context holds the places of one side wholly,
    and they are one more than the shingles that a near passage may miss.
    """
    length = passage_words - SHINGLE + 1
    misses = length - int(np.ceil(2 * length * similarity / (1 + similarity) - 1e-9))
    most = passage_words // 2 - 3
    return most - misses, most


def _outer(contexts: np.ndarray, passage_words: int, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the shingles of each context on both sides of its token, and which are whole.

    Matches stand up to SLACK aside, so two contexts of a near passage share one of them.
    """
    token = passage_words - 1
    least, most = _sides(passage_words, similarity)
    near, far = least - SLACK, most + SLACK
    places = np.r_[token - far : token - near + 1, token + near : token + far + 1]
    hashes, inside = np.zeros((len(contexts), len(places)), np.uint64), np.ones((len(contexts), len(places)), bool)
    for k in range(SHINGLE):
        hashes = _mixed(hashes * _MIX + contexts[:, places + k])
        inside &= contexts[:, places + k] > 0
    return hashes, inside


def contexts_of(candidates: DataFrame, texts: DataFrame, rows: DataFrame, passage_words: int, similarity: float) -> DataFrame:
    """`key`, `text_id`, `at`, `outer`, `context` of the windows to compare.

    A context has the words within a passage's length of the token; `outer`, of keys with
    `many` rows only, the key's shingles far from it.
    """
    reach = passage_words - 1
    width = 2 * reach + SHINGLE
    # stretches of short passages, or of little similarity, need hold no such places
    sifted = _sides(passage_words, similarity)[0] >= 4
    # a text's wanted windows are bounded by its own length
    by_text = candidates.groupBy("text_id").agg(F.collect_list(F.struct("key", "at", "many")).alias("wanted"))
    one_row = rows.groupBy("text_id").agg(F.min("row_key").alias("row_key"))
    named = texts.select("row_key", "text").join(by_text.join(one_row, "text_id"), "row_key")
    owner = __name__

    def cut(batch: pa.RecordBatch) -> Batches:
        wanted = batch.column(2)
        of = np.repeat(np.arange(batch.num_rows), pc.list_value_length(wanted).to_numpy())
        key, at, many = (c.to_numpy(zero_copy_only=False) for c in wanted.flatten().flatten())
        names = batch.column(0).to_numpy()
        # two bytes per word, never zero; zeros past the ends match nothing
        words = word_hashes(batch.column(1).to_pylist())
        begins = np.cumsum([reach] + [len(w) + reach for w in words])
        flat = np.zeros(begins[-1] + SHINGLE, np.uint16)
        for begin, w in zip(begins.tolist(), words):
            flat[begin : begin + len(w)] = (w >> np.uint64(48)).astype(np.uint16) | np.uint16(1)
        for k in range(0, len(at), CELLS_ROWS):
            part = slice(k, k + CELLS_ROWS)
            contexts = flat[(begins[of[part]] + at[part])[:, None] + np.arange(-reach, width - reach)]
            offsets = np.arange(len(contexts) + 1, dtype=np.int32) * np.int32(2 * width)
            context = pa.Array.from_buffers(
                pa.binary(), len(contexts), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(contexts))]
            )
            own, outer = np.flatnonzero(many[part]), pa.nulls(len(contexts), pa.list_(pa.int64()))
            if len(own):
                sizes, values = np.zeros(len(contexts), np.int64), np.zeros(0, np.int64)
                if sifted:
                    hashes, inside = _outer(contexts[own], passage_words, similarity)
                    hashes = np.sort(_mixed(hashes ^ key[part][own].view(np.uint64)[:, None]) * inside, 1)
                    once = hashes != np.pad(hashes, ((0, 0), (1, 0)))[:, :-1]
                    sizes[own], values = once.sum(1), hashes[once].view(np.int64)
                outer = pa.ListArray.from_arrays(
                    np.r_[0, np.cumsum(sizes)].astype(np.int32), values, mask=pa.array(~many[part])
                )
            yield record(_CONTEXTS, key[part], names[of[part]], at[part], outer, context)

    def run(batches: Batches) -> Batches:
        drop_caches_of_others(owner)
        seen: set[int] = set()
        for batch in (b.slice(k, 64) for b in batches for k in range(0, b.num_rows, 64)):
            # rows that repeat have one key
            names = batch.column(0).to_pylist()
            fresh = [k for k, name in enumerate(names) if not (name in seen or seen.add(name))]
            yield from cut(batch if len(fresh) == len(names) else batch.take(pa.array(fresh, pa.int64())))

    return named.select("text_id", "text", "wanted").mapInArrow(
        run, "key long, text_id long, at int, outer array<long>, context binary"
    )


def _cut_keys(left: DataFrame, similar: bool) -> DataFrame:
    """Cells of the contexts of keys with many rows.

    No near passage has rows in two groups that share no outer shingle, so those that
    are linked by them make up a group; large ones are cut into cells in both directions.
    """
    left = left.withColumn("node", F.xxhash64("key", "text_id", "at"))
    if similar:
        outer = left.select("node", F.explode("outer").alias("shingle"))
        least = outer.groupBy("shingle").agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low != high")
        groups = components(outer.join(least, "shingle").select("node", "low").distinct(), "node", "low")
        left = left.join(groups, "node").withColumnRenamed("root", "part_of")
    else:
        left = left.withColumn("part_of", F.lit(0).cast("long"))
    counts = left.groupBy("key", "part_of").agg(F.ceil(F.count("*") / CELL).cast("int").alias("cuts"))
    part = F.pmod(F.xxhash64("text_id", "at"), F.col("cuts")).cast("int")
    cell = lambda i, j, home: F.struct(i.alias("i"), j.alias("j"), F.lit(home).alias("home"))
    homes = F.transform(F.sequence("part", F.col("cuts") - 1), lambda j: cell(F.col("part"), j, True))
    others = F.transform(F.sequence(F.lit(0), F.col("part") - 1), lambda i: cell(i, F.col("part"), False))
    dealt = F.when(F.col("part") > 0, F.concat(homes, others)).otherwise(homes)
    left = left.join(counts, ["key", "part_of"]).withColumn("part", part).select("*", F.explode(dealt).alias("cell"))
    return left.select("key", "part_of", "cell.*", "text_id", "at", "context").select(*_CELLS)


def near_passages(
    candidates: DataFrame, texts: DataFrame, rows: DataFrame, passage_words: int, similarity: float
) -> DataFrame:
    """`a`, `b`, `first`, `last`: links among the windows of each key, and a's words in them.

    `candidates` has the windows to compare, `texts` the texts by `row_key` and `rows` the ids of both. A key is one cell;
    one with many rows is cut into groups of rows that share shingles far from the token.
    """
    width = 2 * (passage_words - 1) + SHINGLE
    contexts = stored(contexts_of(candidates, texts, rows, passage_words, similarity))
    zero = F.lit(0).cast("int")
    whole = [F.lit(0).cast("long").alias("part_of"), zero.alias("i"), zero.alias("j"), F.lit(True).alias("home")]
    placed = contexts.where("outer is null").select("key", *whole, "text_id", "at", "context")
    many = contexts.where("outer is not null")
    if not many.isEmpty():
        placed = placed.union(_cut_keys(many, _sides(passage_words, similarity)[0] >= 4))
    cell = list(_CELLS[:4])
    cells = placed.repartition(*cell).sortWithinPartitions(*cell)

    def run(batches: Batches) -> Batches:
        # whole cells go together until they hold enough rows
        kept: list[pa.RecordBatch] = []
        rows, last = 0, None

        def finished() -> pa.RecordBatch:
            merged = pa.Table.from_batches(kept)
            ids = _cell_ids(merged)
            cell = np.cumsum(np.r_[0, (np.diff(ids, axis=0) != 0).any(1)])
            contexts = np.frombuffer(b"".join(merged.column(7).to_pylist()), np.uint16).reshape(-1, width)
            home = merged.column(4).to_numpy()
            return _forests(
                cell, home, merged.column(5).to_numpy(), merged.column(6).to_numpy().astype(np.int64), contexts,
                passage_words, similarity,
            )

        for batch in batches:
            if not batch.num_rows:
                continue
            ids = _cell_ids(batch)
            if rows >= CELLS_ROWS:
                joined = ids if last is None else np.r_[last[None], ids]
                breaks = np.flatnonzero((np.diff(joined, axis=0) != 0).any(1))
                if len(breaks):
                    kept.append(batch.slice(0, breaks[0]))
                    yield finished()
                    batch = batch.slice(breaks[0])
                    kept, rows = [], 0
            kept.append(batch)
            rows, last = rows + batch.num_rows, ids[-1]
        if kept:
            yield finished()

    return cells.mapInArrow(run, "a long, b long, first int, last int")


def repeated_passages(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    passage_words: int = PASSAGE_WORDS,
    similarity: float = SIMILARITY,
    hashes: int = HASHES,
) -> DataFrame:
    """`doc_id`, `class_id`, `n_words`, `n_passages`, `passages` of every row.

    `class_id` is the smallest key that shares passages with the document, directly or
    over others, its own included; documents without one are their own class.
    `passages` lists the repeated stretches as (first, last) words, merged where they
    overlap; a text that occurs whole in several rows is one passage. Words are runs of
    letters and digits without case. NULL texts are empty; texts shorter than a passage
    have none. NULL keys count only where a class has no other.
    """
    spark = docs.sparkSession
    small_batches(spark)
    texts = identified(docs, id_col, text_col).withColumn("row_key", row_key("id", "text"))
    rows, same, candidates = shared_windows(texts, passage_words, hashes)
    by_text = rows.groupBy("text_id").agg(
        F.min("doc_id").alias("low"), F.count("*").alias("n"), F.max("n_words").alias("n_words")
    )
    near = near_passages(candidates, texts, rows, passage_words, similarity)
    links = stored(same.union(near))
    roots = components(links)
    placed = by_text.join(roots.withColumnRenamed("node", "text_id"), "text_id", "left").select(
        "text_id", "low", "n", "n_words", F.coalesce("root", "text_id").alias("class")
    )
    lowest = placed.groupBy("class").agg(F.min("low").alias("class_id"))
    stretches = links.select("a", F.struct("first", "last").alias("s")).distinct()
    spans = stretches.groupBy(F.col("a").alias("text_id")).agg(F.sort_array(F.collect_list("s")).alias("spans"))
    known = placed.join(lowest, "class").join(spans, "text_id", "left")
    whole = (F.col("n") > 1) & (F.col("n_words") >= passage_words)
    end = F.col("n_words").cast("int") - 1
    passages = F.when(whole, F.array(F.struct(F.lit(0).alias("first"), end.alias("last")))).otherwise(
        _merged(F.col("spans"), end)
    )
    known = known.select("text_id", "class_id", passages.alias("passages"))
    return rows.join(known, "text_id").select(
        "doc_id", "class_id", "n_words", F.size("passages").cast("long").alias("n_passages"), "passages"
    )


def _merged(spans, end):
    """Sorted spans cut at the text's end, joined where they overlap."""
    none = F.array().cast("array<struct<first:int,last:int>>")

    def add(done, span):
        top = F.try_element_at(done, F.lit(-1))
        last = F.least(span["last"], end)
        wider = F.struct(top["first"].alias("first"), F.greatest(top["last"], last).alias("last"))
        fresh = F.struct(span["first"].alias("first"), last.alias("last"))
        joined = (F.size(done) > 0) & (span["first"] <= top["last"] + 1)
        return F.when(joined, F.concat(F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))), F.array(wider))).otherwise(
            F.concat(done, F.array(fresh))
        )

    return F.aggregate(F.coalesce(spans, none), none, add)
