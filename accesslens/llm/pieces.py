"""SentencePiece BPE encoding by vectorised merge rounds, and decoding.

A text is cut into words before each run of spaces and between letters and marks,
wherever no piece of the vocabulary reaches across (worked out from the pieces when a
model is read). All words that a batch of texts adds
to the known ones are merged together: one flat array holds the symbols of all words,
each round finds every word's best-ranked pair (the leftmost of equals) by a segmented
minimum, merges it in all words at once, and drops the symbols used up and the words
that are finished. One merge per word and round keeps the library's order exactly.
"""

from __future__ import annotations

import heapq
import re
from collections import defaultdict
from collections.abc import Iterable
from itertools import chain

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from accesslens.llm.shared import arrow_map, identified, keep_in_process, record

SPACE = "▁"
#: Words kept per worker, and the longest that are kept.
CACHE_WORDS, CACHE_CHARS = 400_000, 64
#: Longer words are merged one at a time over a heap: rounds would be as many as symbols.
ROUND_SYMBOLS = 256

_NONE = np.int64(1) << 30
_OUT = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32())), ("decoded", pa.string())])


class Coder:
    """Encodes and decodes as the library does with `model_path`; BPE with byte fallback."""

    def __init__(self, model_path: str):
        self.library = sp = sentencepiece.SentencePieceProcessor(model_file=model_path)
        size = sp.get_piece_size()
        pieces = [sp.id_to_piece(i) for i in range(size)]
        normal = {
            p: i
            for i, p in enumerate(pieces)
            if not (sp.is_control(i) or sp.is_byte(i) or sp.is_unknown(i) or sp.is_unused(i))
        }
        if any(SPACE in p.lstrip(SPACE) for p in normal):
            raise ValueError("a piece of this model reaches over a space")
        self.words = _word_pattern(normal)
        self.bytes = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.size = size
        #: symbol of each character: its piece, or one past the vocabulary
        self.symbol = np.arange(size, size + 0x110000, dtype=np.int64)
        for p, i in normal.items():
            if len(p) == 1:
                self.symbol[ord(p)] = i
        scores = sorted({sp.get_score(i) for i in normal.values()}, reverse=True)
        ranks = {s: k for k, s in enumerate(scores)}
        pairs: dict[int, tuple[int, int]] = {}
        for piece, i in normal.items():
            for cut in range(1, len(piece)):
                left, right = piece[:cut], piece[cut:]
                if (cut == 1 or left in normal) and (len(right) == 1 or right in normal):
                    a = normal.get(left, size + ord(left[0]))
                    b = normal.get(right, size + ord(right[0]))
                    pairs[a << 32 | b] = (ranks[sp.get_score(i)], i)
        self.keys = np.array(sorted(pairs), np.int64)
        self.ranks = np.array([pairs[k][0] for k in self.keys.tolist()] + [_NONE], np.int64)
        self.merged = np.array([pairs[k][1] for k in self.keys.tolist()] + [0], np.int64)
        self.pairs = pairs
        self.known: dict[str, tuple[int, ...]] = {}

    def _found(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Index of each pair in the table; the index past its end for others."""
        key = left << 32 | right
        at = np.searchsorted(self.keys, key)
        at[at == len(self.keys)] = 0
        return np.where(self.keys[at] == key, at, len(self.keys))

    def _symbols(self, joined: str) -> np.ndarray:
        return self.symbol[np.frombuffer(joined.encode("utf-32-le"), np.uint32)]

    def merge_rounds(self, words: list[str]) -> list[list[int]]:
        """The symbols left of each word when no pair can merge."""
        out: list[list[int]] = [[]] * len(words)
        names = np.arange(len(words))
        lengths = np.array([len(w) for w in words], np.int64)
        symbols = self._symbols("".join(words))
        last = np.zeros(len(symbols), bool)
        last[np.cumsum(lengths) - 1] = True
        pair = np.full(len(symbols), len(self.keys))
        inner = np.flatnonzero(~last)
        pair[inner] = self._found(symbols[inner], symbols[inner + 1])
        while len(names):
            heads = np.cumsum(lengths) - lengths
            best = np.minimum.reduceat(self.ranks[pair] << 32 | np.arange(len(symbols)), heads)
            live = best >> 32 < _NONE
            if not live.all():
                for k in np.flatnonzero(~live).tolist():
                    out[names[k]] = symbols[heads[k] : heads[k] + lengths[k]].tolist()
                stay = np.repeat(live, lengths)
                shift = np.cumsum(stay) - 1
                symbols, last, pair = symbols[stay], last[stay], pair[stay]
                names, lengths, best = names[live], lengths[live], best[live]
                if not len(names):
                    break
                at = shift[best & 0xFFFFFFFF]
            else:
                at = best & 0xFFFFFFFF
            symbols[at] = self.merged[pair[at]]
            last[at] = last[at + 1]
            stay = np.ones(len(symbols), bool)
            stay[at + 1] = False
            at = at - np.arange(len(at))  # one symbol gone in every word before
            symbols, last, pair = symbols[stay], last[stay], pair[stay]
            lengths = lengths - 1
            heads = np.cumsum(lengths) - lengths
            # only the pairs at the merged symbol and before it changed
            pair[at] = len(self.keys)
            right = at[~last[at]]
            pair[right] = self._found(symbols[right], symbols[right + 1])
            left = at[at > heads] - 1
            pair[left] = self._found(symbols[left], symbols[left + 1])
        return out

    def merge_heap(self, word: str) -> list[int]:
        """The same for one long word."""
        symbols, n = self._symbols(word).tolist(), len(word)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        queue: list[tuple[int, int, int, int]] = []

        def offer(i: int) -> None:
            if i >= 0 and (j := after[i]) < n and (found := self.pairs.get(symbols[i] << 32 | symbols[j])):
                heapq.heappush(queue, (found[0], i, symbols[i], symbols[j]))

        for i in range(n - 1):
            offer(i)
        while queue:
            _, i, a, b = heapq.heappop(queue)
            j = after[i]
            if symbols[i] != a or j >= n or symbols[j] != b:
                continue
            symbols[i], symbols[j] = self.pairs[a << 32 | b][1], -1
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            offer(before[i])
            offer(i)
        return [s for s in symbols if s >= 0]

    def _ids(self, symbols: list[int]) -> list[int]:
        if max(symbols) < self.size:
            return symbols
        out: list[int] = []
        for s in symbols:
            if s < self.size:
                out.append(s)
            else:
                out += [self.bytes[b] for b in chr(s - self.size).encode()]
        return out

    def _learnt(self, words: list[str]) -> dict[str, tuple[int, ...]]:
        short = [w for w in words if len(w) <= ROUND_SYMBOLS]
        out = {w: tuple(self._ids(s)) for w, s in zip(short, self.merge_rounds(short), strict=True)}
        for word in words:
            if len(word) > ROUND_SYMBOLS:
                out[word] = tuple(self._ids(self.merge_heap(word)))
        return out

    def encode(self, texts: list[str]) -> list[list[int]]:
        split = [self.words(SPACE + t.replace(" ", SPACE)) if t else [] for t in texts]
        used = set().union(*split)
        new = self._learnt(list(used.difference(self.known)))
        if len(self.known) + len(new) > CACHE_WORDS:
            self.known = {w: self.known[w] for w in used.intersection(self.known)}
        self.known.update(new)
        out = [list(chain.from_iterable(map(self.known.__getitem__, words))) for words in split]
        for word in new:
            if len(word) > CACHE_CHARS:
                del self.known[word]
        return out

    def decode(self, ids: list[list[int]]) -> list[str]:
        return [self.library.decode(i) for i in ids]


def _word_pattern(pieces: Iterable[str]):
    """Cuts a text into stretches that no piece reaches across.

    Besides the runs of spaces, letters and digits are parted from all else; a letter
    that some piece holds next to anything else counts as all else, until none is left.
    """
    beside = defaultdict(set)
    for piece in pieces:
        for a, b in zip(piece, piece[1:], strict=False):
            beside[a].add(b)
            beside[b].add(a)
    letters = {c for c in beside if c.isalnum()}
    while mixed := {c for c in letters if beside[c] - letters - {SPACE}}:
        letters -= mixed
    kind = re.escape("".join(sorted(letters))) or SPACE
    return re.compile(f"{SPACE}*(?:[{kind}]+|[^{kind}{SPACE}]+)|{SPACE}+").findall


_CODERS: dict[str, Coder] = {}


def coder(model_path: str) -> Coder:
    """One coder per worker process and model."""
    keep_in_process(__name__, _CODERS.clear)
    if model_path not in _CODERS:
        _CODERS[model_path] = Coder(model_path)
    return _CODERS[model_path]


def coded(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`doc_id`, `ids`, `decoded` of every row: whole texts, no begin or end ids.

    The model file must be readable under its path on every worker, as an installed
    package is. An empty or NULL text has no ids and decodes to the empty text; repeated
    rows give repeated results.
    """

    def start():
        model = coder(model_path)

        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            ids = model.encode(batch.column(1).to_pylist())
            return record(_OUT, batch.column(0), ids, model.decode(ids))

        return each

    texts = identified(docs, id_col, text_col).select(F.col("id").cast("long"), "text")
    return arrow_map(texts, start, "doc_id long, ids array<int>, decoded string", rows=512)
