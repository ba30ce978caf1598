"""Registered queries of the training-data operators, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from covenant.llm import bm25, bpe, chat, embedding_dedup, exact_dedup, katz, langid, lexical, line_dedup, mixing, resample, simhash, toxicity
from covenant.llm.common import fold


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return bpe.round_trip(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


#: Score from which a text counts as toxic.
TOXIC = 0.7


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.learn(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", (fold(F.col("doc_id"), 3) == 1).alias("held_out"), "score", (F.col("score") >= TOXIC).cast("int").alias("predicted"), F.size("hits").alias("n_hits"))


def op3_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup.deduplicate(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


OP4_SQL = r"""
WITH l AS (
  SELECT doc_id, unnest(range(len(a))) AS pos, unnest(a) AS line
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS a FROM documents)),
k AS (
  SELECT *, regexp_replace(regexp_replace(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', '') AS key FROM l),
c AS (
  SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 40
  GROUP BY key HAVING count(DISTINCT doc_id) >= 5)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE doc_id <> keeper) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE keeper IS NULL OR doc_id = keeper), '')) AS kept_sha256
FROM k LEFT JOIN c USING (key) GROUP BY doc_id
"""


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.cluster(table(spark, sf_dir, "documents"))


#: Documents reported for a query, and decimals of a reported score.
TOP, TOLD = 10, 4


def op6_bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = bm25.top_k(docs, docs.where(F.col("doc_id") % 20 == 0), TOP)
    return found.withColumn("score", F.round("score", TOLD))


OP6_SQL = f"""
WITH w AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+')) AS term FROM documents),
t AS (SELECT doc_id, term, CAST(count(*) AS DOUBLE) AS tf FROM w GROUP BY ALL),
l AS (SELECT doc_id, sum(tf) AS len FROM t GROUP BY doc_id),
n AS (SELECT (SELECT count(*) FROM documents) AS docs, (SELECT sum(len) FROM l) / (SELECT count(*) FROM documents) AS mean),
i AS (SELECT term, ln(1 + ((SELECT docs FROM n) - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM t GROUP BY term),
p AS (
  SELECT doc_id, term, idf * tf * {bm25.K1 + 1} / (tf + {bm25.K1} * (1 - {bm25.B} + {bm25.B} * len / (SELECT mean FROM n))) AS part
  FROM t JOIN i USING (term) JOIN l USING (doc_id)),
s AS (
  SELECT q.doc_id AS query_id, p.doc_id, round(sum(part), {bm25.DECIMALS}) AS score
  FROM t q JOIN p ON p.term = q.term WHERE q.doc_id % 20 = 0 GROUP BY ALL)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, round(score, {TOLD}) AS score
FROM s QUALIFY rank <= {TOP}
"""


def op7_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    return katz.score(table(spark, sf_dir, "documents"))


def op8_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.learn(docs)
    held_out = (fold(F.col("doc_id"), 3) == 1).alias("held_out")
    return langid.identify(docs.select("doc_id", "text"), model).select("doc_id", held_out, "lang_pred", "score", "rejected")


#: What conversation -1 says in both of its turns.
ODD_TURN = "</s>[INST] ok [/INST]"


def op9_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    odd = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(ODD_TURN).alias("text"))
    return chat.read_back(chat.format_chats(given.unionByName(odd)))


def op9_sql(template: chat.Template = chat.Template()) -> str:
    def escaped(column: str) -> str:
        told = f"replace({column}, '\\', '\\\\')"
        for mark in template.controls():
            told = f"replace({told}, '{mark}', '{mark[0]}\\{mark[1:]}')"
        return told

    marks = len(template.turn) + len(template.text) + len(template.end)
    return f"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '{ODD_TURN}' UNION ALL SELECT -1, 1, 'assistant', '{ODD_TURN}')
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum({marks} + length({escaped('role')}) + length({escaped('text')})) AS BIGINT) AS formatted_chars
FROM c GROUP BY conv_id
"""


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "source", "lang", "topic", "tokens", F.round("scale", 6).alias("scale"), F.round("chance", 6).alias("chance"), "sampled")


OP10_SQL = f"""
WITH {mixing.mix_sql()}
SELECT doc_id, source, lang, topic, tokens, round(scale, 6) AS scale, round(chance, 6) AS chance, sampled FROM mixed
"""


def op11_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.rank_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


#: A text in lower case, A-Z only, as SQL.
LOWERED = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
OP11_TERMS = rf"unnest(regexp_extract_all({LOWERED}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term"
OP11_SQL = f"""
WITH t AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, {OP11_TERMS} FROM documents) GROUP BY ALL),
l AS (SELECT doc_id, CAST(sum(tf) AS BIGINT) AS size FROM t GROUP BY doc_id),
a AS (SELECT count(*) AS docs, CAST(sum(size) AS BIGINT) AS terms FROM l),
w AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * any_value(docs) + 2 AS DOUBLE) / (2 * count(*) + 1))) AS BIGINT) AS weight FROM t, a GROUP BY term),
i AS (SELECT item_id, term, count(*) AS n FROM (SELECT item_id, {OP11_TERMS} FROM benchmark) GROUP BY ALL),
v AS (
  SELECT doc_id, term, weight * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * size * docs) // terms))) AS part
  FROM t JOIN l USING (doc_id) JOIN w USING (term), a),
s AS (SELECT item_id, doc_id, CAST(sum(n * part) AS BIGINT) AS score FROM i JOIN v USING (term) GROUP BY ALL)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
FROM s WHERE score > 0 QUALIFY rank <= 20
"""


def op12_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_dedup.classes(table(spark, sf_dir, "documents"), digest=True)
    return found.select("doc_id", "keep_id", "group_size", "kept", F.col("full").alias("text_sha256"))


OP12_SQL = """
WITH n AS (SELECT doc_id, length(coalesce(text, '')) AS chars, translate(coalesce(text, ''), chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '') AS norm FROM documents)
SELECT doc_id, first(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size, row_number() OVER w = 1 AS kept, sha256(norm) AS text_sha256
FROM n WINDOW w AS (PARTITION BY norm ORDER BY chars DESC, doc_id)
"""


def op13_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = resample.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


def op13_sql(buckets: int = resample.BUCKETS, percent: int = resample.PERCENT, least: int = resample.LEAST_WORDS, seed: int = resample.SEED) -> str:
    """For runs of one word. CRC-32 is told by its rule: a table of the eight shifts
    of each byte, then a step for each byte of each distinct word."""
    words = rf"unnest(regexp_extract_all({LOWERED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word"
    return f"""
WITH c AS (SELECT list(list_reduce([b, 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END) ORDER BY b) AS crc FROM (SELECT unnest(range(256)) AS b)),
d AS (SELECT doc_id, word, count(*) AS n FROM (SELECT doc_id, {words} FROM documents) GROUP BY ALL),
b AS (SELECT word, count(*) AS n FROM (SELECT {words} FROM benchmark) GROUP BY ALL),
h AS (SELECT word, hex(encode(word)) AS told FROM (SELECT word FROM d UNION SELECT word FROM b)),
k AS (
  SELECT word, xor(list_reduce(list_concat([4294967295], list_transform(range(CAST(length(told) // 2 AS BIGINT)), lambda i: CAST('0x' || substr(told, 2 * i + 1, 2) AS BIGINT))),
    lambda x, y: xor(x >> 8, crc[(xor(x, y) & 255) + 1])), 4294967295) % {buckets} AS bucket FROM h, c),
s AS (SELECT bucket, CAST(sum(n) AS BIGINT) AS s FROM d JOIN k USING (word) GROUP BY bucket),
t AS (SELECT bucket, CAST(sum(n) AS BIGINT) AS t FROM b JOIN k USING (word) GROUP BY bucket),
g AS (
  SELECT bucket, CAST(floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * ((SELECT coalesce(sum(s), 0) FROM s) + {buckets})::DOUBLE
    / ((coalesce(s, 0) + 1)::DOUBLE * ((SELECT coalesce(sum(t), 0) FROM t) + {buckets})::DOUBLE))) AS BIGINT) AS gain
  FROM s FULL JOIN t USING (bucket)),
w AS (SELECT doc_id, CAST(sum(n) AS BIGINT) AS n_features, CAST(sum(n * gain) AS BIGINT) AS weight FROM d JOIN k USING (word) JOIN g USING (bucket) GROUP BY doc_id),
r AS (
  SELECT doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('{seed}:' || doc_id), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score
  FROM documents LEFT JOIN w USING (doc_id)),
o AS (SELECT *, row_number() OVER (PARTITION BY n_features >= {least} ORDER BY score DESC, doc_id) AS place, count(*) OVER (PARTITION BY n_features >= {least}) AS able FROM r)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= {least} AND place <= {percent} * able // 100 THEN place END AS rank FROM o
"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_bpe": op1_bpe,
    "op2_toxicity": op2_toxicity,
    "op3_embedding_dedup": op3_embedding_dedup,
    "op4_line_dedup": op4_line_dedup,
    "op5_simhash": op5_simhash,
    "op6_bm25": op6_bm25,
    "op7_katz": op7_katz,
    "op8_langid": op8_langid,
    "op9_chat": op9_chat,
    "op10_mixing": op10_mixing,
    "op11_lexical": op11_lexical,
    "op12_exact_dedup": op12_exact_dedup,
    "op13_resample": op13_resample,
}

ORACLE_SQL: dict[str, str] = {
    "op4_line_dedup": OP4_SQL,
    "op6_bm25": OP6_SQL,
    "op9_chat": op9_sql(),
    "op10_mixing": OP10_SQL,
    "op11_lexical": OP11_SQL,
    "op12_exact_dedup": OP12_SQL,
    "op13_resample": op13_sql(),
}
