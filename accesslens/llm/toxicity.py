"""Toxicity scores from subword-bag embeddings under a linear softmax.

A word is the mean of the vectors of its character n-grams and of the word itself, a
window of words is the mean of its words, and a two-class linear softmax reads the
window. Vectors and softmax are trained together in numpy. Only documents carry
labels, so a document's training logit is a soft maximum over its windows; that keeps
one insult in a long text from being averaged away. A misspelling that never occurred
in training still shares most n-grams with the word it comes from.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from accesslens.llm.shared import arrow_map, identified, quoted, record

#: Labelled documents per class that training may use, and the longest of them.
DOCS_PER_CLASS = 1500
MAX_CHARS = 20_000
#: Documents, and distinct words, whose windows and n-grams training looks at together.
GROUP_DOCS = 100
GROUP_WORDS = 20_000

_EDGES = re.compile(r"^[\W_]+|[\W_]+$")
_NGRAMS = (3, 4, 5)
_CACHE_WORDS = 300_000
_OUT = pa.schema([("id", pa.int64()), ("score", pa.float64())])


@dataclass(frozen=True)
class Model:
    """One number per n-gram bucket: its vector against the softmax direction."""

    weights: np.ndarray
    bias: float
    window: int
    slope: float
    shift: float


def words_of(text: str) -> list[str]:
    """Lower-cased words without outer punctuation; all-punctuation words are left out."""
    stripped = (_EDGES.sub("", w) if not w.isalpha() else w for w in text.lower().split())
    return [w for w in stripped if w]


def ngram_ids(words: list[str], buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of every n-gram of `<word>` and of the word, and the word each is from.

    Sorted by word. All n-grams of all words are hashed together on one flat array.
    """
    marked = [f"<{w}>" for w in words]
    flat = np.frombuffer("".join(marked).encode("utf-32-le"), np.uint32).astype(np.uint64)
    owner = np.repeat(np.arange(len(words)), [len(m) for m in marked])
    ids = [np.array([zlib.crc32(m.encode()) for m in marked], np.uint64)]
    owners = [np.arange(len(words))]
    for size in _NGRAMS:
        count = max(0, len(flat) - size + 1)
        hashed = np.full(count, size, np.uint64)
        for k in range(size):
            hashed = (hashed ^ flat[k : k + count]) * np.uint64(0x9E3779B97F4A7C15)
            hashed ^= hashed >> np.uint64(29)
        whole = owner[:count] == owner[size - 1 : size - 1 + count]
        ids.append(hashed[whole])
        owners.append(owner[:count][whole])
    ids, owners = np.concatenate(ids), np.concatenate(owners)
    order = np.argsort(owners, kind="stable")
    return (ids[order] % np.uint64(buckets)).astype(np.int64), owners[order]


def windows_of(n_words: int, window: int) -> np.ndarray:
    """First word of each window; the last window ends with the text."""
    starts = np.arange(0, max(1, n_words), window)
    starts[-1] = max(0, min(starts[-1], n_words - window))
    return starts


def train(
    texts: list[str],
    labels: list[int],
    buckets: int = 1 << 16,
    dim: int = 8,
    window: int = 2,
    epochs: int = 30,
    rate: float = 0.1,
    decay: float = 1e-5,
    seed: int = 0,
) -> Model:
    """Fit vectors and softmax by gradient steps on all windows of the given documents.

    Without documents of both classes the model scores everything by the share of
    toxic documents it was given (0 for none).
    """
    labels = np.array(labels, np.float64)
    if len(set(labels.tolist())) < 2:
        share = float(labels.mean()) if len(labels) else 0.0
        share = min(max(share, 1e-3), 1 - 1e-3)
        return Model(np.zeros(buckets), 0.0, window, 1.0, float(np.log(share / (1 - share))))
    bag = _Bag.of(texts, labels, buckets, window)
    random = np.random.default_rng(seed)
    parameters = [
        random.uniform(-1 / dim, 1 / dim, shape).astype(np.float32) for shape in ((buckets, dim), (dim, 2))
    ]
    parameters.append(np.zeros(2, np.float32))
    speed = [np.zeros_like(p) for p in parameters]
    for _ in range(epochs):
        gradients = bag.gradients(*parameters)
        gradients[0] += decay * parameters[0]
        for p, g, v in zip(parameters, gradients, speed, strict=True):
            v *= 0.8
            v += g / (np.abs(g).max() + 1e-8)
            p -= rate * v
    vectors, softmax, offset = parameters
    slope, shift = _calibrated(bag.highest_logits(*parameters), bag.y)
    direction = (softmax[:, 1] - softmax[:, 0]).astype(np.float64)
    bias = float(offset[1] - offset[0])
    return Model(vectors @ direction, bias, window, slope, shift)


@dataclass(frozen=True)
class _Group:
    """Windows of some documents: first word and number of words of each, and each document's windows."""

    tokens: np.ndarray
    starts: np.ndarray
    sizes: np.ndarray
    doc_ptr: np.ndarray
    docs: slice

    def slots(self) -> tuple[np.ndarray, np.ndarray]:
        """The words of each window one after another, and where each window begins among them."""
        ptr = np.cumsum(self.sizes) - self.sizes
        at = np.repeat(self.starts - ptr, self.sizes) + np.arange(self.sizes.sum())
        return self.tokens[at], ptr


@dataclass(frozen=True)
class _Bag:
    """Labelled documents as windows of word numbers, words as bags of n-grams.

    Nothing of the size of all windows times the length of a vector is ever held: a step
    goes over groups of documents and adds up the gradient of all of them.
    """

    groups: list[_Group]
    y: np.ndarray
    weight: np.ndarray
    grams: np.ndarray
    gram_word: np.ndarray
    gram_ptr: np.ndarray
    buckets: int

    @classmethod
    def of(cls, texts: list[str], labels: np.ndarray, buckets: int, window: int) -> _Bag:
        vocabulary: dict[str, int] = {}
        groups, y = [], []
        for at in range(0, len(texts), GROUP_DOCS):
            tokens, starts, sizes, ptr, base = [], [], [], [], 0
            before = len(y)
            for text, label in zip(texts[at : at + GROUP_DOCS], labels[at : at + GROUP_DOCS]):
                words = words_of(text)
                if not words:
                    continue
                tokens.append(np.array([vocabulary.setdefault(w, len(vocabulary)) for w in words], np.int32))
                begin = windows_of(len(words), window)
                ptr.append(sum(map(len, starts)))
                starts.append((begin + base).astype(np.int32))
                sizes.append(np.minimum(window, len(words) - begin).astype(np.int32))
                base += len(words)
                y.append(label)
            if ptr:
                parts = (np.concatenate(p) for p in (tokens, starts, sizes))
                groups.append(_Group(*parts, np.array(ptr), slice(before, len(y))))
        grams, gram_word = ngram_ids(list(vocabulary), buckets)
        gram_ptr = np.searchsorted(gram_word, np.arange(len(vocabulary)))
        y = np.array(y, np.float64)
        weight = np.where(y == 1, 0.5 / max(1, y.sum()), 0.5 / max(1, (1 - y).sum()))
        return cls(groups, y, weight, grams.astype(np.int32), gram_word.astype(np.int32), gram_ptr, buckets)

    def _word_vectors(self, vectors: np.ndarray) -> np.ndarray:
        """The mean of the vectors of each word's n-grams."""
        ends = np.append(self.gram_ptr, len(self.grams))
        found = np.empty((len(self.gram_ptr), vectors.shape[1]), np.float32)
        for a in range(0, len(found), GROUP_WORDS):
            b = min(a + GROUP_WORDS, len(found))
            part = vectors[self.grams[ends[a] : ends[b]]]
            found[a:b] = np.add.reduceat(part, self.gram_ptr[a:b] - ends[a]) / np.diff(ends[a : b + 1])[:, None]
        return found

    @staticmethod
    def _forward(group: _Group, word: np.ndarray, softmax: np.ndarray, offset: np.ndarray):
        slot_word, ptr = group.slots()
        mean = np.add.reduceat(word[slot_word], ptr) / group.sizes.astype(np.float32)[:, None]
        out = mean @ softmax + offset
        return slot_word, mean, out[:, 1] - out[:, 0]

    def highest_logits(self, vectors: np.ndarray, softmax: np.ndarray, offset: np.ndarray) -> np.ndarray:
        """Of each document, the logit of its highest window."""
        word = self._word_vectors(vectors)
        found = [np.maximum.reduceat(self._forward(g, word, softmax, offset)[2], g.doc_ptr) for g in self.groups]
        return np.concatenate(found) if found else np.zeros(0)

    def loss(self, vectors: np.ndarray, softmax: np.ndarray, offset: np.ndarray) -> float:
        """The weighted cross-entropy that `gradients` derives."""
        word, total = self._word_vectors(vectors), 0.0
        for group in self.groups:
            z = self._forward(group, word, softmax, offset)[2]
            pooled, *_ = _soft_maximum(z, group.doc_ptr)
            signed = np.where(self.y[group.docs] == 1, -pooled, pooled)
            total += float((np.logaddexp(0, signed) * self.weight[group.docs]).sum())
        return total

    def gradients(self, vectors: np.ndarray, softmax: np.ndarray, offset: np.ndarray) -> list[np.ndarray]:
        """Of the loss of all documents, by vectors, softmax and offset."""
        word = self._word_vectors(vectors)
        d_word = np.zeros(word.shape, np.float32)
        d_softmax, d_offset = np.zeros_like(softmax), np.zeros_like(offset)
        for group in self.groups:
            slot_word, mean, z = self._forward(group, word, softmax, offset)
            pooled, raised, total, size = _soft_maximum(z, group.doc_ptr)
            error = (1 / (1 + np.exp(-pooled)) - self.y[group.docs]) * self.weight[group.docs]
            dz = (np.repeat(error / total, size) * raised).astype(np.float32)
            d_out = np.stack([-dz, dz], 1)
            d_softmax += mean.T @ d_out
            d_offset += d_out.sum(0)
            d_mean = (d_out @ softmax.T) / group.sizes.astype(np.float32)[:, None]
            window = np.repeat(np.arange(len(group.sizes), dtype=np.int32), group.sizes)
            for k in range(word.shape[1]):
                d_word[:, k] += np.bincount(slot_word, d_mean[window, k], len(word))
        d_word /= np.diff(np.append(self.gram_ptr, len(self.grams))).astype(np.float32)[:, None]
        d_vectors = np.empty_like(vectors)
        for k in range(word.shape[1]):
            d_vectors[:, k] = np.bincount(self.grams, d_word[self.gram_word, k], self.buckets)
        return [d_vectors, d_softmax, d_offset]


def _soft_maximum(z: np.ndarray, doc_ptr: np.ndarray) -> tuple[np.ndarray, ...]:
    """Per document the logarithm of the mean of e to its windows' logits, and what it is made of."""
    size = np.diff(np.append(doc_ptr, len(z)))
    top = np.maximum.reduceat(z, doc_ptr)
    raised = np.exp(z - np.repeat(top, size))
    total = np.add.reduceat(raised, doc_ptr)
    return top + np.log(total / size), raised, total, size


def _calibrated(z: np.ndarray, y: np.ndarray, rounds: int = 400) -> tuple[float, float]:
    """Slope and shift of a logistic curve from the highest window logit to the label."""
    middle, spread = z.mean(), z.std() + 1e-6
    x = (z - middle) / spread
    slope, shift = 1.0, 0.0
    for _ in range(rounds):
        error = 1 / (1 + np.exp(-np.clip(slope * x + shift, -30, 30))) - y
        slope -= (error * x).mean() + 1e-4 * slope
        shift -= error.mean()
    slope = max(slope, 1e-2) / spread
    return float(slope), float(shift - slope * middle)


class Scorer:
    """Scores texts; keeps the numbers of words it has met."""

    def __init__(self, model: Model):
        self.model = model
        self.known: dict[str, float] = {}

    def _word_scores(self, words: list[str]) -> np.ndarray:
        known = self.known
        new = [w for w in dict.fromkeys(words) if w not in known]
        if new:
            if len(known) + len(new) > _CACHE_WORDS:
                known.clear()
                new = list(dict.fromkeys(words))
            ids, owner = ngram_ids(new, len(self.model.weights))
            total = np.bincount(owner, self.model.weights[ids], len(new))
            known.update(zip(new, (total / np.bincount(owner)).tolist(), strict=True))
        return np.fromiter(map(known.__getitem__, words), np.float64, len(words))

    def scores(self, texts: list[str]) -> list[float]:
        model, out = self.model, []
        split = [words_of(t) for t in texts]
        flat = self._word_scores([w for words in split for w in words])
        sums, at = np.r_[0.0, np.cumsum(flat)], 0
        for words in split:
            n = len(words)
            z = model.bias
            if n:
                begin = windows_of(n, model.window)
                size = min(model.window, n)
                z += float((sums[at + begin + size] - sums[at + begin]).max()) / size
                at += n
            z = min(max(model.slope * z + model.shift, -30.0), 30.0)
            out.append(1 / (1 + float(np.exp(-z))))
        return out


def labelled_sample(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    per_class: int = DOCS_PER_CLASS,
    max_chars: int = MAX_CHARS,
) -> tuple[list[str], list[int]]:
    """Texts and labels of at most `per_class` documents of either class.

    Chosen by the hash of the key, so repeated runs agree. A key labelled twice takes
    the higher label; rows without key or label are left out, and so are documents of
    more than `max_chars` characters, which bounds what reaches the driver.
    """
    spark = docs.sparkSession
    known = (
        labels.select(
            F.col(quoted(id_col)).cast("long").alias("id"), F.col(quoted(label_col)).alias("y")
        )
        .where("id is not null and y in (0, 1)")
        .groupBy("id")
        .agg(F.max("y").cast("int").alias("y"))
    )
    chosen = [
        row
        for y in (0, 1)
        for row in known.where(F.col("y") == y).orderBy(F.xxhash64("id"), "id").limit(per_class).collect()
    ]
    ids = spark.createDataFrame(chosen, "id long, y int")
    texts = identified(docs, id_col, text_col).where(F.length("text") <= max_chars)
    # at most 2 * per_class keys
    rows = texts.join(F.broadcast(ids), "id").groupBy("id", "y").agg(F.max("text").alias("text"))
    rows = sorted((r.id, r.y, r.text) for r in rows.collect())
    return [r[2] for r in rows], [r[1] for r in rows]


def toxicity_scores(
    docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """`id`, `score` for every row: 0 to 1, higher where toxic is likelier.

    One row per input row, repeated keys included. A NULL or empty text, or one without
    words, gets the score of the bias alone. Only the text is read for the score.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def start():
        scorer = Scorer(shared.value)

        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            return record(_OUT, batch.column(0), scorer.scores(batch.column(1).to_pylist()))

        return each

    texts = identified(docs, id_col, text_col)
    return arrow_map(texts.select(F.col("id").cast("long"), "text"), start, "id long, score double", rows=256)


def without_toxic(
    docs: DataFrame, model: Model, text_col: str = "text", threshold: float = 0.5
) -> DataFrame:
    """The rows of `docs` that score under `threshold`, with all their columns."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def start():
        scorer = Scorer(shared.value)

        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            scores = scorer.scores([t or "" for t in batch.column(at).to_pylist()])
            return batch.filter(pa.array([s < threshold for s in scores], pa.bool_()))

        return each

    return arrow_map(docs, start, docs.schema, rows=256)
