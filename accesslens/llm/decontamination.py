"""Benchmark items that documents contain, up to a few word edits.

Pigeonhole edit matching: an item of m words with an error budget of k edits is cut
into k + 1 pieces, so an occurrence within the budget leaves one piece untouched. An
Aho-Corasick automaton finds exact hits of all pieces in one pass over a text, and
Myers' bit-parallel distance, with words as symbols, verifies the stretch around each
hit. Words are lower-case runs of letters and digits: case, punctuation and white
space don't count as edits.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from accesslens.llm.shared import arrow_map, identified, quoted, record

#: Edits allowed per word of an item.
EDIT_RATE = 0.2
#: Words of one block of items; a larger benchmark takes several passes.
BLOCK_WORDS = 500_000

_WORD = re.compile(r"[^\W_]+")
_OUT = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("item_id", pa.int64()),
        ("distance", pa.int32()),
        ("first_word", pa.int64()),
        ("n_words", pa.int64()),
        ("item_words", pa.int64()),
    ]
)

Item = tuple[int | None, list[str]]


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


class Pattern:
    """Myers' distance of one item against stretches of text."""

    def __init__(self, words: list[str]):
        self.size = len(words)
        self.forward = self._masks(words)
        self.backward = self._masks(words[::-1])

    @staticmethod
    def _masks(words: list[str]) -> dict[str, int]:
        masks: dict[str, int] = defaultdict(int)
        for k, word in enumerate(words):
            masks[word] |= 1 << k
        return dict(masks)

    def _best(self, masks: dict[str, int], text: list[str], anchored: bool) -> tuple[int, int]:
        """Least distance to text[i:j], and the first j; i is free or 0."""
        top, full = 1 << (self.size - 1), (1 << self.size) - 1
        plus, minus, score = full, 0, self.size
        best = (score, 0)
        for j, word in enumerate(text, 1):
            same = masks.get(word, 0)
            vertical = same | minus
            horizontal = (((same & plus) + plus) ^ plus) | same
            up = minus | (full & ~(horizontal | plus))
            down = plus & horizontal
            score += bool(up & top) - bool(down & top)
            up = ((up << 1) | anchored) & full
            down = (down << 1) & full
            plus = down | (full & ~(vertical | up))
            minus = up & vertical
            if score < best[0]:
                best = (score, j)
        return best

    def locate(self, text: list[str]) -> tuple[int, int, int]:
        """Least distance and the stretch text[i:j] that has it."""
        distance, end = self._best(self.forward, text, False)
        _, back = self._best(self.backward, text[:end][::-1], True)
        return distance, end - back, end


class Matcher:
    """The automaton over the pieces of a block of items."""

    def __init__(self, items: list[Item], edit_rate: float):
        self.items = items
        self.patterns = [Pattern(words) for _, words in items]
        self.budgets = [int(edit_rate * len(words)) for _, words in items]
        pieces: dict[str, list[tuple[int, int]]] = defaultdict(list)
        for at, (_, words) in enumerate(items):
            n = self.budgets[at] + 1
            cuts = [len(words) * k // n for k in range(n + 1)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                pieces[f" {' '.join(words[a:b])} "].append((at, a))
        self.automaton = ahocorasick.Automaton()
        for piece, places in pieces.items():
            self.automaton.add_word(piece, (len(piece), places))
        self.automaton.make_automaton()

    def found(self, text: str) -> Iterator[tuple]:
        """Item, distance, first word, words: the nearest occurrence of each item within budget."""
        words = words_of(text)
        joined = f" {' '.join(words)} "
        starts: dict[int, set[int]] = defaultdict(set)
        word, counted = 0, 0
        for end, (length, places) in self.automaton.iter(joined):
            begin = end - length + 1
            # hits come by their end; count words between hits only
            if begin >= counted:
                word += joined.count(" ", counted, begin)
            else:
                word -= joined.count(" ", begin, counted)
            counted = begin
            for at, offset in places:
                starts[at].add(word - offset)
        for at, diagonals in sorted(starts.items()):
            pattern, budget = self.patterns[at], self.budgets[at]
            best = None
            for low, high in _merged(sorted(diagonals), pattern.size + 2 * budget):
                low = max(0, low - budget)
                distance, i, j = pattern.locate(words[low : high + pattern.size + budget])
                if distance <= budget and (best is None or distance < best[0]):
                    best = (distance, low + i, j - i)
            if best:
                yield self.items[at][0], *best, pattern.size


def _merged(starts: list[int], gap: int) -> Iterator[tuple[int, int]]:
    """Ranges of starts whose stretches touch."""
    low = high = starts[0]
    for s in starts[1:]:
        if s > high + gap:
            yield low, high
            low = s
        high = s
    yield low, high


def blocks(
    benchmark: DataFrame, item_col: str = "item_id", text_col: str = "text", block_words: int = BLOCK_WORDS
) -> Iterator[list[Item]]:
    """The items with words, in blocks of about `block_words` words.

    Rows reach the driver one partition at a time. Equal texts may repeat under several
    keys; each is looked for.
    """
    items, held = [], 0
    rows = benchmark.select(F.col(quoted(item_col)).cast("long"), F.col(quoted(text_col)))
    for item, text in rows.toLocalIterator():
        if words := words_of(text or ""):
            items.append((item, words))
            held += len(words)
        if held >= block_words:
            yield items
            items, held = [], 0
    if items:
        yield items


def contaminations(
    docs: DataFrame,
    benchmark: DataFrame,
    edit_rate: float = EDIT_RATE,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    block_words: int = BLOCK_WORDS,
) -> DataFrame:
    """One row per document and item that it contains within the item's budget.

    The budget is `edit_rate` word edits per word of the item, rounded down; items too
    short for one edit match exactly. `distance`, `first_word` and `n_words` are those
    of the nearest occurrence, the first of equals. NULL texts and items without words
    match nothing; repeated rows give repeated results.
    """
    spark = docs.sparkSession
    texts = identified(docs, id_col, text_col).select(F.col("id").cast("long"), "text")
    found = spark.createDataFrame([], _SCHEMA)
    for items in blocks(benchmark, item_col, item_text_col, block_words):
        shared = spark.sparkContext.broadcast(items)

        def start(shared=shared):
            matcher = Matcher(shared.value, edit_rate)

            def each(batch: pa.RecordBatch) -> pa.RecordBatch:
                rows = [
                    (doc, *hit)
                    for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)
                    for hit in matcher.found(text)
                ]
                return record(_OUT, *(zip(*rows, strict=True) if rows else [[]] * len(_OUT)))

            return each

        found = found.union(arrow_map(texts, start, _SCHEMA))
    return found


_SCHEMA = "doc_id long, item_id long, distance int, first_word long, n_words long, item_words long"


def without_contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    edit_rate: float = EDIT_RATE,
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    block_words: int = BLOCK_WORDS,
) -> DataFrame:
    """The rows of `docs` that contain no item within its budget, with all columns."""
    at = docs.columns.index(text_col)
    kept = docs
    for items in blocks(benchmark, item_col, item_text_col, block_words):
        shared = docs.sparkSession.sparkContext.broadcast(items)

        def start(shared=shared):
            matcher = Matcher(shared.value, edit_rate)

            def each(batch: pa.RecordBatch) -> pa.RecordBatch:
                clean = [next(matcher.found(t or ""), None) is None for t in batch.column(at).to_pylist()]
                return batch.filter(pa.array(clean, pa.bool_()))

            return each

        kept = arrow_map(kept, start, docs.schema)
    return kept
