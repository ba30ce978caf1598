"""The corpus pipeline: stages over documents, each a table for the next one.

Stages: toxic documents go; lines that many documents share go; of each group of
near-duplicates the document of least id stays; documents are sampled so that
sources, languages and topics meet their target weights; texts become tokens.
Each stage but the last returns the columns of documents. Null ids, texts and
other columns pass through as each operator states; tables may be empty and hold
further columns, which are dropped.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from covenant.llm import bpe, line_dedup, mixing, simhash_verified, toxicity
from covenant.llm.common import DOCUMENT_COLUMNS, materialize
from covenant.llm.queries import TOXIC

#: Share of the tokens that the mixing stage samples.
MIX_SHARE = 0.8


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = toxicity.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.score(docs.select(DOCUMENT_COLUMNS), model).where(F.col("score") < TOXIC).select(DOCUMENT_COLUMNS)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines that many documents share. A document that had
    text and has none left but ASCII white space goes, clean or not; a null text
    stays null."""
    kept = line_dedup.deduplicate(docs.select(DOCUMENT_COLUMNS))
    text = F.when(F.col("n_dropped") > 0, F.col("kept")).otherwise(F.col("text"))
    bare = (F.col("n_dropped") > 0) & ~text.rlike(r"[^\x20\x09-\x0D]")
    size = F.when(F.col("n_dropped") > 0, F.char_length(text).cast("long")).otherwise(F.col("n_chars"))
    return kept.where(~bare).select("doc_id", text.alias("text"), "lang", "source", size.alias("n_chars"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of texts that share 0.8 of their five-word shingles
    stays: the one of least id. Rows without an id stay; of rows that repeat an id one
    of each group stays."""
    return simhash_verified.one_of_each(docs.select(DOCUMENT_COLUMNS))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs.select(DOCUMENT_COLUMNS), share=MIX_SHARE).where("sampled").select(DOCUMENT_COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.encode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN).withColumn("n_tokens", F.size("ids").cast("long"))


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_lines),
    ("near-duplicates", drop_near_duplicates),
    ("mixing", mix_sources),
    ("bpe", encode),
]

#: Scores, fingerprints and tokens are beyond SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
