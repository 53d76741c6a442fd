"""The operators with production parameters over their whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from accesslens.llm import (
    collocations,
    conversation_repair,
    decontamination,
    html_text,
    imatch,
    line_dedup,
    passages,
    pieces,
    pseudonyms,
    secret_scan,
    simhash,
    token_files,
    toxicity,
)
from accesslens.llm.html_examples import labelled_pages
from accesslens.llm.ordering import key_column
from accesslens.llm.shared import table

WORD_TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
WORD_END_ID = 2
PIECE_MODEL = public_tokenizers.path("piece_bpe_32k.model")
#: Whoever runs this for real passes a key of their own.
PSEUDONYM_KEY = b"accesslens"


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), words_per_shingle=3, max_bits=3)
    return found.select("doc_id", "fingerprint", "component_id")


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.secrets(table(spark, sf_dir, "documents"))
    kinds = F.transform("base", lambda s: s["kind"])
    counted = [
        (F.size(kinds) - F.size(F.array_remove(kinds, kind))).cast("long").alias(f"n_{kind}")
        for kind in secret_scan.KINDS[:3]
    ]
    return found.select(
        "doc_id",
        *counted,
        F.sha2(secret_scan.described(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        secret_scan.described(F.concat("base", "owned")).alias("spans"),
        "n_live",
        "n_copied",
        F.coalesce(F.array_max(F.map_values("n_repositories")), F.lit(0)).alias("n_repositories"),
    )


def held_out(id_col: str = "doc_id"):
    return F.crc32(F.col(id_col).cast("string")) % 5 == 0


def toxicity_model(docs: DataFrame, labels: DataFrame) -> toxicity.Model:
    """Trained on labelled rows outside the held-out fold."""
    return toxicity.train(*toxicity.labelled_sample(docs, labels.where(~held_out())))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity_model(docs, table(spark, sf_dir, "labels"))
    return toxicity.toxicity_scores(docs, model).select(
        F.col("id").alias("doc_id"),
        held_out("id").alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


def op4_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = html_text.train(labelled_pages())
    found = html_text.extracted(table(spark, sf_dir, "pages"), model)
    return found.withColumn("n_chars", F.length("text").cast("long"))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    done = pseudonyms.with_pseudonyms(docs, PSEUDONYM_KEY, spans_col="spans")
    return done.select("doc_id", "text", *pseudonyms.counted_kinds("spans"), "spans")


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = token_files.new_path(spark)
    token_files.write_token_files(table(spark, sf_dir, "documents"), path, WORD_TOKENIZER, WORD_END_ID)
    return token_files.token_digests(token_files.read_token_files(spark, path))


def op7_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = passages.repeated_passages(table(spark, sf_dir, "documents"))
    spans = F.transform("passages", lambda s: F.concat_ws(":", s["first"].cast("string"), s["last"].cast("string")))
    return found.select("doc_id", "class_id", "n_words", "n_passages", F.array_join(spans, ",").alias("passages"))


def op8_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    lexicon = imatch.Lexicon.of(docs, "doc_id", "text", imatch.LEAST_SHARE, imatch.MOST_SHARE)
    return imatch.edit_likeness(docs, lexicon)


def op9_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_digests(pieces.coded(table(spark, sf_dir, "documents"), PIECE_MODEL))


def piece_digests(coded: DataFrame) -> DataFrame:
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contaminations(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = line_dedup.deduplicated(docs, min_chars=20, min_documents=3)
    return found.select(
        "doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256")
    )


def damaged(rows: DataFrame) -> DataFrame:
    """Conversation rows with the faults that the CRC of `conv_id:turn` says, NULLs as one space."""
    told = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn", "role", "text")]
    kind = F.crc32(F.concat(told[0], F.lit(":"), told[1])) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(told[3], "[.!?]", "")).otherwise(told[3])
    return rows.where(kind != 0).select(
        "conv_id",
        "turn",
        F.when(kind == 4, "user").otherwise(told[2]).alias("role"),
        text.alias("text"),
        F.explode(F.array_repeat(F.lit(0), F.when(kind == 3, 2).otherwise(1))).alias("copy"),
    ).drop("copy")


def op12_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    found = conversation_repair.summaries(conversation_repair.stretches(damaged(rows)))
    every = rows.select("conv_id", key_column("conv_id").alias("conv")).distinct()
    numbers = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    return every.join(found, "conv", "left").select(
        "conv_id",
        *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in numbers),
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"),
    )


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"), min_count=100, most=2000, absorbed=100)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_simhash": op1_simhash,
    "op2_secrets": op2_secrets,
    "op3_toxicity": op3_toxicity,
    "op4_html_text": op4_html_text,
    "op5_pii": op5_pii,
    "op6_token_files": op6_token_files,
    "op7_passages": op7_passages,
    "op8_imatch": op8_imatch,
    "op9_pieces": op9_pieces,
    "op10_decontamination": op10_decontamination,
    "op11_line_dedup": op11_line_dedup,
    "op12_conversations": op12_conversations,
    "op13_collocations": op13_collocations,
}

_LINE_DEDUP_SQL = r"""
WITH lines AS (
    SELECT doc_id, u.place, u.line,
        translate(regexp_replace(u.line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'),
            'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
    FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents) d,
        LATERAL (SELECT unnest(d.l) AS line, unnest(range(len(d.l))) AS place) u
), repeated AS (
    SELECT key, max(doc_id) AS keeper FROM lines
    WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3
), marked AS (
    SELECT l.doc_id, l.place, l.line, coalesce(r.keeper <> l.doc_id, false) AS gone
    FROM lines l LEFT JOIN repeated r USING (key)
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
    sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""

_COLLOCATIONS_SQL = r"""
WITH pieces AS (
    SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w
    FROM (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(
            translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
            '[.,;:!?\x0A-\x0D]')) AS piece FROM documents)
), starts AS (
    SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM pieces
), windows AS (
    SELECT lang, w[i:least(i + 4, len(w))] AS w FROM starts
), grams AS (
    SELECT lang, w[1:m] AS w FROM (SELECT lang, w, unnest(range(1, len(w) + 1)) AS m FROM windows)
), f AS (
    SELECT lang, w, array_to_string(w, ' ') AS phrase, count(*) AS f FROM grams GROUP BY lang, w
), total AS (
    SELECT lang, count(*) AS n FROM starts GROUP BY lang
), candidates AS (
    SELECT * FROM f WHERE len(w) > 1 AND f >= 100
), cuts AS (
    SELECT c.lang, c.phrase, c.f AS a, c.k, l.f AS l, r.f AS r, t.n,
        (1000::HUGEINT * c.f * t.n) // (l.f::HUGEINT * r.f) AS score
    FROM (SELECT *, unnest(range(1, len(w))) AS k FROM candidates) c
    JOIN f l ON l.lang = c.lang AND l.w = c.w[1:c.k]
    JOIN f r ON r.lang = c.lang AND r.w = c.w[c.k + 1:]
    JOIN total t ON t.lang = c.lang
), cut AS (
    SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank,
    phrase, a, l, r, n, score::BIGINT AS score
FROM cut
WHERE NOT EXISTS (
    SELECT 1 FROM candidates o WHERE o.lang = cut.lang AND len(o.phrase) > len(cut.phrase)
        AND contains(' ' || o.phrase || ' ', ' ' || cut.phrase || ' ') AND 100 * o.f >= 100 * cut.a)
QUALIFY rank <= 2000
"""

#: The first ten cannot be expressed in SQL; tests/llm holds their brute-force versions.
ORACLE_SQL: dict[str, str] = {
    "op11_line_dedup": _LINE_DEDUP_SQL,
    "op13_collocations": _COLLOCATIONS_SQL,
}
