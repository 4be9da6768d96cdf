"""The queries opN_<name> over whole tables, with the SQL that checks them where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.session import read_table
from .alignment import align
from .bytebpe import bpe_decode, bpe_encode
from .chat import format_chats, masked_text, read_turns, text_part
from .decontaminate import find_leaks
from .langid import identify
from .license import licence_scan
from .mixing import mix
from .neardup import HyperMinHash, near_duplicates
from .pii import find_pii
from .quality import quality_scores
from .resample import resample
from .rules import quality_rules
from .secrets import find_secrets, span_text


def count_kind(kind: str) -> Column:
    return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")


def digests(found: DataFrame, kinds: tuple[str, ...], more: tuple[str, ...]) -> DataFrame:
    counts = [count_kind(k).alias(f"n_{k}") for k in kinds]
    base = F.sha2(span_text(F.col("spans"), kinds).cast("binary"), 256).alias("base_sha256")
    return found.select("doc_id", *counts, base, span_text(F.col("spans"), kinds + more).alias("spans"))


def op1_secret_novelty(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(find_secrets(read_table(spark, sf_dir, "documents")), ("assign", "access", "hex"), ("novel",))


def op2_quality_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op4_pii_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(find_pii(read_table(spark, sf_dir, "documents")), ("email", "ip", "card", "phone"), ("login", "account", "street"))


def op3_soft_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op5_latent_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op6_license_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licence_scan(read_table(spark, sf_dir, "documents"))


def op10_language_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages by all evidence, and documents, whose source stands for a host and which declare nothing."""
    docs, pages = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "pages")
    records = pages.select(F.lit("page").alias("kind"), F.col("page_id").alias("id"), F.col("url").alias("address"), F.col("html").alias("text"))
    records = records.unionByName(docs.select(F.lit("document").alias("kind"), F.col("doc_id").alias("id"), F.col("source").alias("address"), "text"))
    found = identify(records, docs.select(F.col("doc_id").alias("id"), "lang", "text"))
    own = lambda kind: F.when(F.col("kind") == kind, F.col("id"))
    return found.select(own("page").alias("page_id"), own("document").alias("doc_id"), "lang", F.round("posterior", 6).alias("posterior"), "text_lang", "declared", "host", "kept")


def op7_hyperminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read_table(spark, sf_dir, "documents"), params=HyperMinHash(width=4))


OP7_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i+3], ' ')) END) AS g
  FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
i AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT i.a, i.b FROM i JOIN n x ON x.doc_id = i.a JOIN n y ON y.doc_id = i.b WHERE 100 * i.c >= 80 * (x.n + y.n - i.c)),
both_ways AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (SELECT doc_id AS v, doc_id AS c FROM n UNION SELECT both_ways.b, r.c FROM r JOIN both_ways ON both_ways.a = r.v WHERE r.c < both_ways.b)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, coalesce(m.c, d.doc_id) AS component_id, coalesce(m.c, d.doc_id) = d.doc_id AS kept
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN (SELECT v, min(c) AS c FROM r GROUP BY v) m ON m.v = d.doc_id
"""

def op8_rule_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(read_table(spark, sf_dir, "documents"))


OP8_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws, string_split(text, chr(10)) AS ls FROM d),
g AS (SELECT doc_id, i, array_to_string(ws[i:i+4], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 3)) AS i FROM w WHERE len(ws) > 5)),
c AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM g),
r AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 5)) AS p FROM c WHERE c > 1) GROUP BY doc_id),
m AS (
  SELECT w.doc_id, text, ls, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
    CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(list_filter(ls, lambda x: regexp_matches(x, '[^\x20\x09-\x0D]'))) - len(list_distinct(list_filter(ls, lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(r.n, 0) AS BIGINT) AS n_repeat_words
  FROM w LEFT JOIN r ON r.doc_id = w.doc_id),
f AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR n_symbols > n_words OR 10 * (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g'))) > 6 * word_chars
    OR length(text) - length(regexp_replace(text, '[!?]', '', 'g')) > n_words OR word_chars < 2 * n_words OR word_chars > 25 * n_words OR 2 * n_dup_lines > len(ls)) AS kept
FROM f
"""


def op9_chat_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    tricky = F.lit("</s>[INST] ok [/INST]")
    extra = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), tricky.alias("text"))
    turns = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    chats = format_chats(turns.withColumn("parts", text_part(F.coalesce("text", F.lit("")))))
    read = F.array_join(F.transform(read_turns(F.col("formatted")), lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    out = chats.withColumn("read", read).withColumn("loss", masked_text(F.col("formatted"), F.col("loss_spans")))
    return out.select(
        "conv_id",
        F.size(read_turns(F.col("formatted"))).cast("long").alias("n_turns"),
        F.sha2(F.col("read").cast("binary"), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


OP9_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (
  SELECT *, length(regexp_replace(replace(text, '\', '\\'), '([\[<])(/?INST\]|/?s>|\|)', '\1\\\2', 'g')) AS n,
    length(regexp_replace(replace(role, '\', '\\'), '([\[<])(/?INST\]|/?s>|\|)', '\1\\\2', 'g')) AS r FROM t)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(7 + sum(6 + r + 3 + n + 7) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""


def tokenizer_file(name: str) -> str:
    """The place of a public tokenizer's file, as installed."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align(read_table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"), tokenizer_file("piece_bpe_32k.model"))[0]


def op12_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = tokenizer_file("byte_bpe_50k.tiktoken")
    coded = bpe_decode(bpe_encode(read_table(spark, sf_dir, "documents"), ranks), ranks)
    return coded.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


# CRC-32 byte by byte over the hex digits of a feature, with its table made by rule; each feature is hashed once.
OP13_SQL = r"""
WITH crc AS (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END)) AS t),
w AS (
  SELECT 0 AS side, row_number() OVER () AS row, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents
  UNION ALL SELECT 1, row_number() OVER (), NULL, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') FROM benchmark),
f AS (
  SELECT side, row, f, count(*) AS n FROM (
    SELECT side, row, unnest(list_concat(ws, list_concat(list_transform(range(1, len(ws)), lambda i: array_to_string(ws[i:i+1], ' ')), list_transform(range(1, len(ws) - 1), lambda i: array_to_string(ws[i:i+2], ' '))))) AS f FROM w)
  GROUP BY ALL),
h AS (SELECT f, hex(encode(f)) AS x FROM (SELECT DISTINCT f FROM f)),
b AS (
  SELECT f, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(range(1, len(x), 2), lambda i: (instr('0123456789ABCDEF', x[i]) - 1) * 16 + instr('0123456789ABCDEF', x[i + 1]) - 1)),
    lambda c, y: xor(t[(xor(c, y) & 255) + 1], c >> 8))) % 10000 AS bucket FROM h, crc),
p AS (SELECT side, row, bucket, sum(n)::BIGINT AS n FROM f JOIN b USING (f) GROUP BY ALL),
c AS (SELECT bucket, coalesce(sum(n) FILTER (side = 0), 0)::DOUBLE AS s, coalesce(sum(n) FILTER (side = 1), 0)::DOUBLE AS t FROM p GROUP BY bucket),
a AS (SELECT coalesce(sum(s), 0)::DOUBLE AS s, coalesce(sum(t), 0)::DOUBLE AS t FROM c),
g AS (SELECT bucket, floor(1000 * ln((c.t + 1) * (a.s + 10000) / ((c.s + 1) * (a.t + 10000))))::BIGINT AS gain FROM c, a),
d AS (SELECT row, sum(n)::BIGINT AS n_features, sum(n * gain)::BIGINT AS weight FROM p JOIN g USING (bucket) WHERE side = 0 GROUP BY row),
e AS (
  SELECT w.doc_id, len(ws) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight, ('0x' || sha256('42:' || coalesce(w.doc_id::VARCHAR, ''))[1:8])::BIGINT AS h
  FROM w LEFT JOIN d USING (row) WHERE side = 0),
r AS (SELECT *, weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score FROM e),
o AS (SELECT *, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST, n_features) AS n FROM r WHERE n_words >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN n <= (SELECT count(*) * 5 // 100 FROM o) THEN n END AS rank FROM o
UNION ALL SELECT doc_id, n_features, weight, score, NULL FROM r WHERE n_words < 20
"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_secret_novelty": op1_secret_novelty,
    "op2_quality_crf": op2_quality_crf,
    "op3_soft_mixing": op3_soft_mixing,
    "op4_pii_anchors": op4_pii_anchors,
    "op5_latent_decontamination": op5_latent_decontamination,
    "op6_license_paragraphs": op6_license_paragraphs,
    "op7_hyperminhash": op7_hyperminhash,
    "op8_rule_cascade": op8_rule_cascade,
    "op9_chat_parts": op9_chat_parts,
    "op10_language_fusion": op10_language_fusion,
    "op11_token_alignment": op11_token_alignment,
    "op12_byte_bpe": op12_byte_bpe,
    "op13_importance_resampling": op13_importance_resampling,
}
SQL: dict[str, str] = {"op7_hyperminhash": OP7_SQL, "op8_rule_cascade": OP8_SQL, "op9_chat_parts": OP9_SQL, "op13_importance_resampling": OP13_SQL}
