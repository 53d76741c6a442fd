"""Token ids in Huffman-coded binary files, and back.

Ids are counted over the whole corpus; a canonical Huffman code of limited length is
made from the counts (package-merge). Documents are put in order of their key, encoded,
and packed into blocks, each of which decodes by itself. A block carries the bit offset
of every `STRIDE`-th id, so a decoder reads all strides of a block side by side: each
step looks up the next bits of every stride in one table of 2 ** MAX_BITS entries.

Files: `<path>/blocks` is a Parquet data set with one row per block, in directories
`shard=<k>` of ascending keys; rows of a file ascend. Parquet only contains the
payloads; Spark commits its files atomically wherever the shared folder lies, which a
worker that opens files of its own could not. `<path>/code` holds id and code length,
`<path>/shards` the number of ids before each shard.

  payload       codes of the block's ids, most significant bit first, zero-padded
  checkpoints   bit offsets of ids 0, STRIDE, 2 * STRIDE, ... (uint32 little-endian,
                or uint64 where a block exceeds 512 MB)
  doc_ids, n_tokens   the block's documents and their numbers of ids
  before        ids of the shard before the block
"""

from __future__ import annotations

import os
import re
import uuid
from array import array
from codecs import charmap_decode
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer
from tokenizers.pre_tokenizers import CharDelimiterSplit

from accesslens.llm.ordering import SHARD_ROWS, Shards, key_column
from accesslens.llm.shared import Batches, arrow_map, identified, record, shared_folder, small_batches

MAX_BITS = 16
#: Ids of a block (whole documents, one at least) and between two checkpoints.
BLOCK_IDS, STRIDE = 1 << 17, 128
#: Chunks of text whose ids a worker remembers, the longest of them, and all their ids (both sums may
#: be passed by one batch).
CACHE_CHUNKS, CACHE_CHARS, CACHE_IDS = 300_000, 64, 4_000_000
#: Words that go to the library's model in one call.
JOINED_WORDS = 10_000


# fixed values: characters between which the tokenizers always cut
_LETTER = "A-Za-zÀ-ÖØ-öø-ÿ"
_MARK = "!-&(-/:-@\\[-`{-~"
_CUTS = re.compile(f"(?<=[{_LETTER}])(?=[{_MARK}])|(?<=[{_MARK}])(?=[{_LETTER}])")
_PLAIN = re.compile(f"[{_LETTER}]+")
_WORD_END = "</w>"


def _byte_characters() -> str:
    """The character that byte-level models have for each byte; the space stays, it parts words here."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = (chr(256 + k) for k in range(256))
    names = [chr(b) if b in shown else next(hidden) for b in range(256)]
    return "".join(names[:32] + [" "] + names[33:])


def _pieces(pool: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The stretches of `pool` that begin and last so, one after the other."""
    ends = np.cumsum(size)
    return pool[np.repeat(begin - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)]


def _split(lines: list[str]) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Number of words between spaces in each line, each word's place among the distinct ones, and those."""
    words = pc.split_pattern(pa.array(lines, pa.string()), " ")
    distinct = words.flatten().dictionary_encode()
    return pc.list_value_length(words).to_numpy(), distinct.indices.to_numpy(), distinct.dictionary.to_numpy(False).tolist()


class Encoder:
    """Ids as `encode` of the library gives them for whole texts.

    Its tokenizers drop or split at white space before anything else, and part letters
    from marks (all but the apostrophe of contractions), so the stretches between such
    cuts are independent and encoded once each. A stretch of plain letters is one word of
    the library's model: many go to it in one call, lower-cased and by bytes, as its
    normalizer and splitter hand them over. All others go through the whole library.
    """

    def __init__(self, tokenizer_path: str):
        # Spark runs a worker per core; the library's own threads would only contend
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.library = Tokenizer.from_file(tokenizer_path)
        #: texts that hold one of these are encoded whole
        self.special = [t.content.lower() for t in self.library.get_added_tokens_decoder().values()]
        self.bytes = _byte_characters()
        vocabulary = self.library.get_vocab()
        self.ends_word = np.zeros(max(vocabulary.values(), default=0) + 1, bool)
        self.ends_word[[k for name, k in vocabulary.items() if name.endswith(_WORD_END)]] = True
        self.words = Tokenizer(self.library.model)
        self.words.pre_tokenizer = CharDelimiterSplit(" ")
        self.by_words = self._same_words()
        self._forget()

    def _forget(self) -> None:
        #: number of each word and stretch; where its ids lie in `pool`, and how many they are
        self.known: dict[str, int] = {}
        self.begin, self.size, self.pool = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def _by_bytes(self, words: list[str]) -> str:
        return charmap_decode(" ".join(words).lower().encode(), "strict", self.bytes)[0]

    def _same_words(self) -> bool:
        """Whether this tokenizer turns plain letters into what `_by_bytes` makes of them."""
        every = [chr(c) for c in range(0x100) if _PLAIN.match(chr(c))]
        samples = ["".join(every), "".join(reversed(every)), *every]
        normalizer, splitter = self.library.normalizer, self.library.pre_tokenizer
        if normalizer is None or splitter is None or getattr(self.library.model, "end_of_word_suffix", None) != _WORD_END:
            return False
        split = [splitter.pre_tokenize_str(normalizer.normalize_str(w)) for w in samples]
        return [[piece for piece, _ in s] for s in split] == [[w] for w in self._by_bytes(samples).split(" ")]

    def _add(self, names: list[str], size: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Keep the ids of words; their numbers."""
        first = len(self.size)
        self.begin = np.r_[self.begin, len(self.pool) + np.cumsum(size) - size]
        self.size = np.r_[self.size, size]
        self.pool = np.concatenate([self.pool, ids])
        # long ones are not looked up again
        self.known.update((w, k) for k, w in enumerate(names, first) if len(w) <= CACHE_CHARS)
        return np.arange(first, first + len(names))

    def _found(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The words' numbers, -1 of unknown ones, and where those are."""
        numbers = np.fromiter(map(self.known.get, words, repeat(-1)), np.int64, len(words))
        return numbers, np.flatnonzero(numbers < 0)

    def _stretches(self, chunks: list[str]) -> np.ndarray:
        """Numbers of stretches; new ones are encoded."""
        numbers, new = self._found(chunks)
        plain = np.array([self.by_words and bool(_PLAIN.fullmatch(chunks[k])) for k in new], bool)
        for k in range(0, plain.sum(), JOINED_WORDS):
            at = new[plain][k : k + JOINED_WORDS]
            some = [chunks[i] for i in at]
            (coded,) = self.words.encode_batch_fast([self._by_bytes(some)], add_special_tokens=False)
            ids = np.array(coded.ids, np.uint32)
            numbers[at] = self._add(some, np.diff(np.flatnonzero(self.ends_word[ids]), prepend=-1), ids)
        other = [chunks[i] for i in new[~plain]]
        coded = [e.ids for e in self.library.encode_batch_fast(other, add_special_tokens=False)]
        size = np.array([len(ids) for ids in coded], np.int64)
        numbers[new[~plain]] = self._add(other, size, np.array([i for ids in coded for i in ids], np.uint32))
        return numbers

    def _numbers(self, words: list[str]) -> np.ndarray:
        """Numbers of words; unknown ones are cut into stretches."""
        numbers, new = self._found(words)
        if not len(new):
            return numbers
        names = [words[k] for k in new]
        # words hold neither spaces nor line ends
        counts, which, chunks = _split(_CUTS.sub(" ", "\n".join(names)).split("\n"))
        parts = self._stretches(chunks)[which]
        first = np.cumsum(counts) - counts
        numbers[new] = parts[first]
        several = np.flatnonzero(counts > 1)
        own = np.repeat(counts > 1, counts)
        ids = _pieces(self.pool, self.begin[parts[own]], self.size[parts[own]])
        size = np.add.reduceat(self.size[parts], first)[several]
        numbers[new[several]] = self._add([names[k] for k in several], size, ids)
        return numbers

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        whole = {}
        for k, text in enumerate(texts):
            lowered = text.lower()
            if any(s in lowered for s in self.special):
                whole[k] = np.array(self.library.encode(text, add_special_tokens=False).ids, np.uint32)
        counts, which, words = _split([t.replace("\n", " ") if k not in whole else "" for k, t in enumerate(texts)])
        if len(self.known) > CACHE_CHUNKS or len(self.pool) > CACHE_IDS:
            numbers, new = self._found(words)
            kept, numbers = [w for w, k in zip(words, numbers.tolist(), strict=True) if k >= 0], numbers[numbers >= 0]
            size, ids = self.size[numbers], _pieces(self.pool, self.begin[numbers], self.size[numbers])
            self._forget()
            self._add(kept, size, ids)
        numbers = self._numbers(words)[which]
        size = self.size[numbers]
        ids = _pieces(self.pool, self.begin[numbers], size)
        ends = np.r_[0, np.cumsum(size)][np.cumsum(counts)]
        out = np.split(ids, ends[:-1]) if len(texts) else []
        for k, own in whole.items():
            out[k] = own
        return out


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder per worker process and tokenizer."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def id_counts(encoded: DataFrame) -> DataFrame:
    """`id`, `n` over all blocks of ids; summed in each task first."""
    out = pa.schema([("id", pa.int32()), ("n", pa.int64())])

    def run(batches: Batches) -> Batches:
        total = np.zeros(0, np.int64)
        for batch in batches:
            for raw in batch.column(0).to_pylist():
                n = np.bincount(_ids(raw))
                total = np.pad(total, (0, max(0, len(n) - len(total))))
                total[: len(n)] += n
        used = np.flatnonzero(total)
        yield record(out, used.astype(np.int32), total[used])

    return encoded.select("ids").mapInArrow(run, "id int, n long").groupBy("id").agg(F.sum("n").alias("n"))


def _raw(ids: np.ndarray) -> bytes:
    """Ids as they wait for their code: compressed 32-bit numbers."""
    return zstandard.ZstdCompressor(level=1).compress(ids.astype("<u4").tobytes())


def _ids(raw: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), "<u4")


def code_lengths(counts: np.ndarray, max_bits: int = MAX_BITS) -> np.ndarray:
    """Length of each symbol's code, the best with at most `max_bits`; 0 for a count of 0.

    Package-merge: on each level the symbols are merged with pairs of the level before;
    a symbol's length is the number of levels that choose it.
    """
    used = np.flatnonzero(counts)
    lengths = np.zeros(len(counts), np.uint8)
    if len(used) < 2:
        lengths[used] = 1
        return lengths
    if len(used) > 1 << max_bits:
        raise ValueError(f"{len(used)} symbols don't fit {max_bits} bits")
    order = used[np.argsort(counts[used], kind="stable")]
    weights = counts[order].astype(np.float64)
    levels, row = [], np.zeros(0)
    for _ in range(max_bits):
        packages = row[: len(row) // 2 * 2].reshape(-1, 2).sum(1)
        row = np.concatenate([weights, packages])
        rank = np.argsort(row, kind="stable")
        levels.append(rank < len(weights))
        row = row[rank]
    take = 2 * len(order) - 2
    for symbols in reversed(levels):
        chosen = int(symbols[:take].sum())
        lengths[order[:chosen]] += 1
        take = 2 * (take - chosen)
    return lengths


@dataclass(frozen=True)
class Code:
    """The canonical code of given lengths: shorter first, equal lengths by id."""

    lengths: np.ndarray

    def codes(self) -> np.ndarray:
        codes = np.zeros(len(self.lengths), np.uint64)
        ids = np.flatnonzero(self.lengths)
        ids = ids[np.lexsort((ids, self.lengths[ids]))]
        # each code starts where the one before ends, on the scale of the longest
        room = np.uint64(1) << (MAX_BITS - self.lengths[ids].astype(np.uint64))
        starts = np.r_[np.uint64(0), np.cumsum(room)[:-1]].astype(np.uint64)
        codes[ids] = starts >> (MAX_BITS - self.lengths[ids].astype(np.uint64))
        return codes

    def table(self) -> tuple[np.ndarray, np.ndarray]:
        """Id and length for every value of the next MAX_BITS bits."""
        ids = np.flatnonzero(self.lengths)
        ids = ids[np.lexsort((ids, self.lengths[ids]))]
        room = 1 << (MAX_BITS - self.lengths[ids].astype(np.int64))
        symbol, size = np.zeros(1 << MAX_BITS, np.uint32), np.zeros(1 << MAX_BITS, np.int64)
        symbol[: room.sum()] = np.repeat(ids, room)
        size[: room.sum()] = np.repeat(self.lengths[ids], room)
        return symbol, size


def packed(ids: np.ndarray, codes: np.ndarray, lengths: np.ndarray) -> tuple[bytes, bytes]:
    """Payload and checkpoints of a block."""
    size = lengths[ids].astype(np.int64)
    ends = np.cumsum(size)
    begins = ends - size
    # a code lies in one or two 32-bit words; the parts of a word never overlap
    word, room = begins >> 5, 64 - (begins & 31) - size
    pair = codes[ids] << room.astype(np.uint64)
    n = int(ends[-1] >> 5) + 2
    high = np.bincount(word, (pair >> np.uint64(32)).astype(np.float64), n)
    low = np.bincount(word + 1, (pair & np.uint64(0xFFFFFFFF)).astype(np.float64), n)
    payload = (high + low).astype(np.uint32).astype(">u4").tobytes()[: int(ends[-1] + 7) >> 3]
    kind = "<u4" if ends[-1] < 1 << 32 else "<u8"
    return payload, begins[::STRIDE].astype(kind).tobytes()


def unpacked(payload: bytes, checkpoints: bytes, n: int, table: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The `n` ids of a block; all strides advance together."""
    symbol, size = table
    strides = -(-n // STRIDE)
    at = np.frombuffer(checkpoints, "<u4" if len(checkpoints) == 4 * strides else "<u8").astype(np.int64)
    raw = np.frombuffer(payload + b"\0" * 4, np.uint8).astype(np.uint32)
    # the 32 bits that start at each byte
    window = raw[:-3] << 24 | raw[1:-2] << 16 | raw[2:-1] << 8 | raw[3:]
    out = np.zeros((STRIDE, strides), np.uint32)
    for k in range(STRIDE):
        if k == n - (strides - 1) * STRIDE:
            at = at[:-1]  # the last stride has ended
        bits = window[at >> 3] >> (32 - MAX_BITS - (at & 7)).astype(np.uint32) & ((1 << MAX_BITS) - 1)
        out[k, : len(at)] = symbol[bits]
        at = at + size[bits]
    return out.T.reshape(-1)[:n]


_BLOCKS = pa.schema(
    [
        ("shard", pa.int32()),
        ("before", pa.int64()),
        ("doc_ids", pa.list_(pa.int64())),
        ("n_tokens", pa.list_(pa.int64())),
        ("checkpoints", pa.binary()),
        ("payload", pa.binary()),
    ]
)
_BLOCKS_SCHEMA = (
    "shard int, before long, doc_ids array<long>, n_tokens array<long>, checkpoints binary, payload binary"
)
_ENCODED = pa.schema([*list(_BLOCKS)[:4], ("ids", pa.binary())])
_ENCODED_SCHEMA = "shard int, before long, doc_ids array<long>, n_tokens array<long>, ids binary"
_DOCS = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("ids", pa.binary())])


def write_token_files(
    docs: DataFrame,
    path: str,
    tokenizer_path: str,
    end_id: int,
    id_col: str = "doc_id",
    text_col: str = "text",
    rows_per_shard: int = SHARD_ROWS,
) -> None:
    """Encode every document, `end_id` after each, and write the files under `path`.

    Ascending keys, NULL keys first, equal keys by text; NULL texts are empty; every row
    is a document. The counts of the vocabulary and one number per shard reach the
    driver. The tokenizer must be readable under its path on every worker.
    """
    spark = docs.sparkSession
    small_batches(spark)
    texts = identified(docs, id_col, text_col).select(F.col("id").cast("long"), key_column("id").alias("key"), "text")
    shards = Shards.of(texts.select("key"), rows_per_shard)
    in_order = (
        texts.withColumn("shard", shards.column(F.col("key")))
        .repartitionById(shards.count, F.col("shard"))
        .sortWithinPartitions("shard", "key", "text")
    )

    def run(batches: Batches) -> Batches:
        model = encoder(tokenizer_path)
        shard, before, doc_ids, held, size = None, 0, [], [], 0

        def block() -> pa.RecordBatch:
            sizes = [len(ids) for ids in held]
            return record(_ENCODED, [shard], [before], [doc_ids], [sizes], [_raw(np.concatenate(held))])

        for batch in batches:
            coded = model.encode(batch.column(2).to_pylist())
            rows = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), coded, strict=True)
            for at, doc, ids in rows:
                ids = np.append(ids, np.uint32(end_id))
                if held and (at != shard or size + len(ids) > BLOCK_IDS):
                    yield block()
                    before, doc_ids, held, size = before + size, [], [], 0
                if at != shard:
                    shard, before = at, 0
                doc_ids.append(doc)
                held.append(ids)
                size += len(ids)
        if held:
            yield block()

    # read twice, for the counts and for the files; lost parts are encoded again
    encoded = in_order.select("shard", "id", "text").mapInArrow(run, _ENCODED_SCHEMA)
    encoded = encoded.persist(StorageLevel.DISK_ONLY)
    counted = id_counts(encoded).collect()
    counts = np.zeros(max((r.id for r in counted), default=0) + 1, np.int64)
    for r in counted:
        counts[r.id] = r.n
    code = Code(code_lengths(counts))
    known = pd.DataFrame({"id": np.flatnonzero(code.lengths), "bits": code.lengths[code.lengths > 0].astype(np.int64)})
    spark.createDataFrame(known, "id long, bits long").write.parquet(f"{path}/code")
    shared = spark.sparkContext.broadcast(code)

    def pack(batches: Batches) -> Batches:
        codes, lengths = shared.value.codes(), shared.value.lengths
        for batch in batches:
            done = [packed(_ids(raw), codes, lengths) for raw in batch.column(4).to_pylist()]
            payloads, checkpoints = [d[0] for d in done], [d[1] for d in done]
            yield record(_BLOCKS, *batch.columns[:4], checkpoints, payloads)

    blocks = encoded.mapInArrow(pack, _BLOCKS_SCHEMA)
    blocks.write.partitionBy("shard").parquet(f"{path}/blocks")
    encoded.unpersist()
    _shard_starts(spark, path).write.parquet(f"{path}/shards")


def _shard_starts(spark: SparkSession, path: str) -> DataFrame:
    sizes = (
        _read_blocks(spark, path)
        .select("shard", F.aggregate("n_tokens", F.lit(0).cast("long"), lambda a, b: a + b).alias("n"))
        .groupBy("shard")
        .agg(F.sum("n").alias("n"))
    )
    rows, start = [], 0
    for shard, n in sorted(map(tuple, sizes.collect())):
        rows.append((shard, start))
        start += n
    return spark.createDataFrame(rows, "shard int, start long")


def _read_blocks(spark: SparkSession, path: str) -> DataFrame:
    try:
        blocks = spark.read.parquet(f"{path}/blocks")
    except Exception as error:  # no documents, no file to take a schema from
        if "UNABLE_TO_INFER_SCHEMA" not in str(error):
            raise
        return spark.createDataFrame([], _BLOCKS_SCHEMA)
    return blocks.select("shard", "before", "doc_ids", "n_tokens", "checkpoints", "payload")


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """`doc_id`, `start` (ids of all documents before), `ids` (uint32, little-endian) of each."""
    known = spark.read.parquet(f"{path}/code").toPandas()
    lengths = np.zeros(int(known["id"].max()) + 1 if len(known) else 1, np.uint8)
    lengths[known["id"]] = known["bits"]
    starts = dict(map(tuple, spark.read.parquet(f"{path}/shards").collect()))
    shared = spark.sparkContext.broadcast((Code(lengths), starts))

    def start():
        code, starts = shared.value
        table = code.table()

        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            docs, begins, out = [], [], []
            for shard, before, doc_ids, sizes, checkpoints, payload in zip(
                *(c.to_pylist() for c in batch.columns), strict=True
            ):
                ids = unpacked(payload, checkpoints, sum(sizes), table).astype("<u4")
                ends = np.cumsum(sizes)
                docs += doc_ids
                begins.append(starts[shard] + before + ends - sizes)
                out += [ids[b - n : b].tobytes() for b, n in zip(ends.tolist(), sizes, strict=True)]
            return record(_DOCS, docs, np.concatenate(begins) if begins else [], out)

        return each

    return arrow_map(_read_blocks(spark, path), start, "doc_id long, start long, ids binary", rows=16)


def token_digests(files: DataFrame) -> DataFrame:
    """`doc_id`, `start`, `n_tokens`, `ids_crc32` of documents read from the files."""
    return files.select(
        "doc_id",
        "start",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.crc32("ids").alias("ids_crc32"),
    )


def new_path(spark: SparkSession) -> str:
    """A folder for one set of files, among what the executors share."""
    return f"{shared_folder(spark)}/token_files-{uuid.uuid4().hex}"

