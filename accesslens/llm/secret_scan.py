"""Secrets in texts, and who owns them across the whole corpus.

Pattern matches give the base spans. Every value found, and every other token that
looks random, is a candidate; candidates are hashed and counted over the corpus by
distinct repository and distinct owner. A value that many owners share, or many
repositories of one owner, is an example that was copied about; one that a single owner
has in few repositories looks live. Random-looking tokens outside the base spans become
further spans (`owned`) if they look live.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from accesslens.llm.shared import arrow_map, checkpointed, quoted, record

#: Owners up to which a value counts as owner-specific.
LIVE_OWNERS = 1
#: Repositories up to which it does: the owner's own reuse, and not a text copied about.
LIVE_REPOSITORIES = 10
#: A random-looking token: length, and bits of entropy per character.
TOKEN_CHARS, TOKEN_BITS = 20, 3.5

# fixed values: the patterns of the kinds
_WORD = "|".join(
    "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)
    for word in ("password", "passwd", "secret", "token", "api_?key")
)
_ASSIGN = re.compile(f"({_WORD})[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
_ACCESS = re.compile("AKIA[A-Z0-9]+")
_HEX = re.compile("[0-9a-f]{24,}")
_TOKEN = re.compile(f"[A-Za-z0-9+/_=-]{{{TOKEN_CHARS},}}")
_HINTS = ("password", "passwd", "secret", "token", "apikey", "api_key")
KINDS = ("assign", "access", "hex", "owned")

Span = tuple[str, int, int, str]


def base_spans(text: str) -> list[Span]:
    """Kind, start, end and value of the pattern matches, by start, then kind."""
    found = []
    lowered = text.lower()
    if any(h in lowered for h in _HINTS):
        found += [
            (m.start(), 0, m.end(), m.group(2)) for m in _ASSIGN.finditer(text) if len(m.group(2)) >= 6
        ]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end(), m.group()) for m in _ACCESS.finditer(text) if len(m.group()) >= 20]
    # a run of under 24 fails as a whole, so whole runs of 24 or more are the matches
    found += [(m.start(), 2, m.end(), m.group()) for m in _HEX.finditer(text)]
    return [(KINDS[kind], start, end, value) for start, kind, end, value in sorted(found)]


def random_tokens(text: str, taken: list[Span]) -> list[Span]:
    """Tokens of mixed characters and high entropy that touch no span of `taken`."""
    found = []
    for match in _TOKEN.finditer(text):
        value = match.group()
        if value.isalpha() or not any(c.isdigit() for c in value) or not any(c.isalpha() for c in value):
            continue
        n = len(value)
        bits = -sum(k / n * math.log2(k / n) for k in Counter(value).values())
        if bits >= TOKEN_BITS and not any(a < match.end() and match.start() < b for _, a, b, _ in taken):
            found.append(("owned", match.start(), match.end(), value))
    return found


_SPAN = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("hash", pa.string())])
_OUT = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("repository", pa.string()),
        ("owner", pa.string()),
        ("base", pa.list_(_SPAN)),
        ("more", pa.list_(_SPAN)),
    ]
)
_SPAN_TYPE = "array<struct<kind:string,start:int,end:int,hash:string>>"


def candidates(
    docs: DataFrame, id_col: str, text_col: str, repository_col: str, owner_col: str
) -> DataFrame:
    """Base spans and random-looking tokens of every row, values as 128-bit hashes."""

    def hashed(spans: list[Span]) -> list[tuple]:
        return [(k, a, b, xxhash.xxh3_128_hexdigest(v.encode())) for k, a, b, v in spans]

    def start():
        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            base, more = [], []
            for text in batch.column(3).to_pylist():
                spans = base_spans(text)
                base.append(hashed(spans))
                more.append(hashed(random_tokens(text, spans)))
            return record(_OUT, *batch.columns[:3], base, more)

        return each

    chosen = docs.select(
        F.col(quoted(id_col)).cast("long"),
        F.coalesce(F.col(quoted(repository_col)).cast("string"), F.lit("")),
        F.coalesce(F.col(quoted(owner_col)).cast("string"), F.lit("")),
        F.coalesce(F.col(quoted(text_col)).cast("string"), F.lit("")),
    ).toDF("doc_id", "repository", "owner", "text")
    schema = f"doc_id long, repository string, owner string, base {_SPAN_TYPE}, more {_SPAN_TYPE}"
    return arrow_map(chosen, start, schema)


def ownership(found: DataFrame) -> DataFrame:
    """`hash`, `n_repositories`, `n_owners` of every candidate value of the corpus.

    Values are reduced to one row per repository before they meet by value, so a value
    that holds a large part of all rows costs each task one row.
    """
    each = found.select("owner", "repository", F.explode(F.concat("base", "more")).alias("s"))
    per_repository = each.groupBy(F.col("s.hash").alias("hash"), "owner", "repository").agg(F.lit(1).alias("one"))
    per_owner = per_repository.groupBy("hash", "owner").agg(F.count("*").alias("n"))
    return per_owner.groupBy("hash").agg(F.sum("n").alias("n_repositories"), F.count("*").alias("n_owners"))


def secrets(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    repository_col: str = "doc_id",
    owner_col: str = "source",
    live_owners: int = LIVE_OWNERS,
    live_repositories: int = LIVE_REPOSITORIES,
) -> DataFrame:
    """`doc_id`, `base`, `owned`, `n_live`, `n_copied`, `n_repositories` of every row.

    `base` and `owned` are arrays of (kind, start, end, hash) in order of their start, in
    code points, ends exclusive. `n_live` counts base spans whose value at most
    `live_owners` owners have in at most `live_repositories` repositories, `n_copied` the
    others; `owned` has the tokens of which the same holds. `n_repositories` is how many
    repositories have each value of the row, by hash. A NULL text is empty; a NULL owner
    or repository is one of its own; every row gives one row.
    """
    found = checkpointed(candidates(docs, id_col, text_col, repository_col, owner_col))
    found = found.withColumn("row", F.monotonically_increasing_id())
    owners = ownership(found)
    live = (F.col("n_owners") <= live_owners) & (F.col("n_repositories") <= live_repositories)
    spans = found.select("row", F.explode(F.concat("base", "more")).alias("s"))
    judged = spans.join(owners, F.col("s.hash") == owners["hash"]).groupBy("row").agg(
        F.sort_array(
            F.collect_list(
                F.when(
                    (F.col("s.kind") == "owned") & live,
                    F.struct(F.col("s.start").alias("start"), F.col("s.end").alias("end"), "s.kind", "s.hash"),
                )
            )
        ).alias("owned"),
        F.count_if((F.col("s.kind") != "owned") & live).alias("n_live"),
        F.count_if((F.col("s.kind") != "owned") & ~live).alias("n_copied"),
        F.map_from_entries(F.collect_set(F.struct("s.hash", "n_repositories"))).alias("n_repositories"),
    )
    nothing = F.array().cast("array<struct<start:int,end:int,kind:string,hash:string>>")
    return found.join(judged, "row", "left").select(
        "doc_id",
        "base",
        F.transform(
            F.coalesce("owned", nothing), lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["hash"].alias("hash"))
        ).alias("owned"),
        F.coalesce("n_live", F.lit(0)).alias("n_live"),
        F.coalesce("n_copied", F.lit(0)).alias("n_copied"),
        F.coalesce("n_repositories", F.create_map().cast("map<string,bigint>")).alias("n_repositories"),
    )


def described(spans: Column) -> Column:
    """`kind:start:end` of each span, joined by commas, by start, then kind as listed."""
    rank = F.create_map(*(F.lit(x) for k, kind in enumerate(KINDS) for x in (kind, k)))
    keyed = F.transform(spans, lambda s: F.struct(s["start"].alias("a"), rank[s["kind"]].alias("k"), s["kind"].alias("kind"), s["end"].alias("b")))
    return F.array_join(
        F.transform(F.sort_array(keyed), lambda s: F.concat_ws(":", s["kind"], s["a"].cast("string"), s["b"].cast("string"))), ","
    )
