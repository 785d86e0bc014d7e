"""The registered queries of this subpackage, and SQL for those that SQL can express.

A query is a thin layer: it runs its operator over the whole table and derives
the contract's columns from what the operator returns.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .chat_format import CONTROL, MARK, TEMPLATE, conversation_digests, format_turns
from .common import table, written
from .decontaminate import find_leaks
from .language_id import identify
from .language_id import train as train_language
from .line_dedup import LineIndex, drop_lines
from .near_dups import near_duplicates
from .phrase_mining import collocations
from .piece_codec import encode_checked
from .quality_rules import apply_rules
from .quality_model import score as quality_score
from .quality_model import train as train_quality
from .source_divergence import audit
from .token_counts import count_tokens
from .toxicity import score as toxicity_score
from .toxicity import train as train_toxicity
from .warc_bundles import read_bundles, write_bundles


#: Conversation -1 of the contract: its one text, said by both sides.
PLANTED = "</s>[INST] ok [/INST]"


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    more = spark.createDataFrame([(-1, 0, "user", PLANTED), (-1, 1, "assistant", PLANTED)], "conv_id long, turn long, role string, text string")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(more)
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    blocks = written(format_turns(turns, ranks, public_tokenizers.PATTERN), "chat")
    return conversation_digests(blocks, ranks, public_tokenizers.PATTERN)


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return drop_lines(docs, LineIndex.build(docs, min_docs=10, min_chars=1)).select(
        "doc_id", F.col("__n_lines").alias("n_lines"), F.col("__n_dropped").alias("n_dropped"), F.sha2("text", 256).alias("kept_sha256"))


def op3_near_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), percent=85)


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    weights = train_quality(docs, table(spark, sf_dir, "labels"), ~held_out)
    return quality_score(docs, weights).select(
        "doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = F.crc32(F.col("doc_id").cast("string")) % 3 == 1
    index = train_toxicity(docs, table(spark, sf_dir, "labels"), ~held_out)
    return toxicity_score(docs, index).select(
        "doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"),
        F.transform("evidence", lambda x: x["id"]).alias("neighbours"))


def op7_warc_bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    bundles = written(write_bundles(table(spark, sf_dir, "pages")), "warc")
    return read_bundles(bundles, payloads=False).select(
        F.col("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


def op8_piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = public_tokenizers.path("piece_bpe_32k.model")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return encode_checked(docs, model).select("doc_id", F.size("token_ids").cast("long").alias("n_tokens"), "token_ids", "round_trip")


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return apply_rules(table(spark, sf_dir, "documents")).drop("rejected_by")


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


def op13_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.crc32(F.col("doc_id").cast("string")) % 3 == 1
    model = train_language(docs, ~held_out)
    return identify(docs.select("doc_id", "text"), model).select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "lang_pred", "score")


QUERIES = {
    "op1_chat_format": op1_chat_format,
    "op2_line_dedup": op2_line_dedup,
    "op3_near_dups": op3_near_dups,
    "op4_decontaminate": op4_decontaminate,
    "op5_quality_model": op5_quality_model,
    "op6_toxicity": op6_toxicity,
    "op7_warc_bundles": op7_warc_bundles,
    "op8_piece_codec": op8_piece_codec,
    "op9_token_counts": op9_token_counts,
    "op10_quality_rules": op10_quality_rules,
    "op11_source_divergence": op11_source_divergence,
    "op12_collocations": op12_collocations,
    "op13_language_id": op13_language_id,
}

_W = r"[\x20\x09-\x0D]"
_SQL10 = rf"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t,
         list_filter(regexp_split_to_array(coalesce(text, ''), '{_W}+'), lambda x: x <> '') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
  FROM documents),
g AS (
  SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d)),
twice AS (SELECT doc_id, g FROM g GROUP BY doc_id, g HAVING count(*) > 1),
r AS (
  SELECT doc_id, count(*) AS n FROM (
    SELECT DISTINCT doc_id, unnest([i, i + 1, i + 2]) AS p FROM g JOIN twice USING (doc_id, g)) GROUP BY doc_id),
m AS (
  SELECT doc_id, w, l, t, len(w) AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS word_chars,
         length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
         len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words
  FROM d LEFT JOIN r USING (doc_id)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
       n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, base_failed,
       NOT (base_failed
            OR word_chars < 2 * n_words OR word_chars > 20 * n_words
            OR 10 * n_symbols > 3 * n_words
            OR 2 * n_dup_lines > len(l)
            OR 5 * len(list_filter(w, lambda x: x <> '|')) < 4 * n_words
            OR 20 * len(list_distinct(w)) < n_words
            OR 5 * len(regexp_extract_all(t, '!!([\x20\x09-\x0D]|$)')) > n_words) AS kept
FROM b
"""

_SQL2 = r"""
WITH l AS (
  SELECT doc_id, generate_subscripts(x, 1) AS i, unnest(x) AS line
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS x FROM documents)),
k AS (
  SELECT *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM l),
f AS (SELECT key FROM k WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10)
SELECT doc_id, count(*) AS n_lines, count(f.key) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE f.key IS NULL), '')) AS kept_sha256
FROM k LEFT JOIN f USING (key) GROUP BY doc_id
"""

_B32 = " || ".join(
    f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(h, {5 * g + 1}, 5))::BIGINT >> {15 - 5 * k}) & 31)::INT + 1, 1)"
    for g in range(8) for k in range(4))
_SQL7 = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS t, sha1(coalesce(html, '')) AS h FROM pages),
m AS (SELECT t, max(page_id) AS holder FROM p GROUP BY t)
SELECT page_id, octet_length(encode(t))::BIGINT AS payload_bytes, {_B32} AS payload_digest,
       CASE WHEN holder = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN holder <> page_id THEN holder END AS refers_to
FROM p JOIN m USING (t)
"""

_ESCAPED = "length({x}) + " + " + ".join(
    f"(length({{x}}) - length(replace({{x}}, '{c}', ''))) // {len(c)} * {1 if c == MARK else 2}" for c in (MARK, *CONTROL))
_SQL1 = f"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '{PLANTED}' UNION ALL SELECT -1, 1, 'assistant', '{PLANTED}')
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       sum({_ESCAPED.format(x="role")} + {_ESCAPED.format(x="text")} + {sum(map(len, TEMPLATE))})::BIGINT AS formatted_chars
FROM t GROUP BY conv_id
"""

_SQL3 = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS g
  FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
i AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
e AS (SELECT a, b FROM i JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 85 * (x.n + y.n - i)),
r(v, c) AS (SELECT doc_id, doc_id FROM documents UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.v)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, min(r.c) AS component_id, d.doc_id = min(r.c) AS kept
FROM documents d LEFT JOIN n USING (doc_id) JOIN r ON r.v = d.doc_id GROUP BY d.doc_id, n.n
"""

_SHARE = "(1 + (1000000000::HUGEINT * ({0} + 5)) // ({1} + 5 * v))"
_SQL11 = rf"""
WITH d AS (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
o AS (SELECT lang, source, id, unnest(w) AS term FROM d),
c AS (SELECT lang, source, term, count(*) AS n, count(DISTINCT id) AS docs FROM o GROUP BY lang, source, term),
k AS (SELECT lang, term, sum(n) AS n FROM c GROUP BY lang, term HAVING sum(docs) >= 30),
g AS (SELECT DISTINCT lang, source FROM d),
l AS (SELECT lang, count(*) AS v, sum(n) AS n FROM k GROUP BY lang),
gn AS (SELECT lang, source, coalesce(sum(c.n), 0) AS n FROM g LEFT JOIN (SELECT c.* FROM c SEMI JOIN k USING (lang, term)) c USING (lang, source) GROUP BY lang, source),
p AS (SELECT lang, gn.source, k.term, coalesce(c.n, 0) AS n, {_SHARE.format("coalesce(c.n, 0)", "gn.n")} AS p, {_SHARE.format("k.n", "l.n")} AS q
  FROM gn JOIN l USING (lang) JOIN k USING (lang) LEFT JOIN c USING (lang, source, term)),
f AS (SELECT lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b USING (lang, term) WHERE a.source <> b.source GROUP BY lang, a.source, b.source),
pair AS (SELECT lang, a.source, b.source AS item, coalesce(value, 0)::BIGINT AS value FROM g a JOIN g b USING (lang) LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source WHERE a.source <> b.source),
term AS (SELECT lang, source, term AS item, (p - q)::BIGINT AS value FROM p WHERE n > 0 AND p > q)
SELECT lang, source, 'pair' AS part, item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item)::INT AS rank FROM pair UNION ALL
SELECT lang, source, 'term', item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item)::INT AS rank FROM term
QUALIFY rank <= 50
"""
_GRAMS12 = " UNION ALL ".join(f"SELECT lang, {n} AS size, array_to_string(w[i:i + {n - 1}], ' ') AS phrase FROM (SELECT lang, w, unnest(range(1, len(w) - {n - 2})) AS i FROM pw)" for n in range(1, 6))
_SQL12 = rf"""
WITH pw AS (SELECT lang, list_filter(regexp_split_to_array(p, '[\x20\x09]+'), lambda x: x <> '') AS w FROM (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS p FROM documents)),
tot AS (SELECT lang, sum(len(w))::BIGINT AS n FROM pw GROUP BY lang),
f AS MATERIALIZED (SELECT lang, size, phrase, count(*) AS a FROM ({_GRAMS12}) GROUP BY ALL HAVING count(*) >= 100),
c AS (SELECT *, string_split(phrase, ' ') AS w FROM f WHERE size >= 2),
inside AS (SELECT lang, array_to_string(w[b:b + m - 1], ' ') AS phrase, max(a) AS longer FROM (
  SELECT *, unnest(range(1, size - m + 2)) AS b FROM (SELECT *, unnest(range(2, size)) AS m FROM c)) GROUP BY ALL),
k AS (SELECT c.* FROM c LEFT JOIN inside USING (lang, phrase) WHERE longer IS NULL OR 100 * longer < 100 * a),
cut AS (SELECT k.lang, k.phrase, k.a, x.a AS l, y.a AS r, i, tot.n, ((1000::HUGEINT * k.a * tot.n) // (x.a::HUGEINT * y.a))::BIGINT AS score
  FROM (SELECT *, unnest(range(1, size)) AS i FROM k) k JOIN tot USING (lang)
  JOIN f x ON x.lang = k.lang AND x.phrase = array_to_string(w[1:i], ' ') JOIN f y ON y.lang = k.lang AND y.phrase = array_to_string(w[i + 1:], ' ')),
low AS (SELECT * FROM cut QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, i) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM low QUALIFY rank <= 2000
"""

ORACLES = {
    "op12_collocations": _SQL12,
    "op11_source_divergence": _SQL11,
    "op3_near_dups": _SQL3,
    "op1_chat_format": _SQL1,
    "op7_warc_bundles": _SQL7,
    "op2_line_dedup": _SQL2,
    "op10_quality_rules": _SQL10,
}
