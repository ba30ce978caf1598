import collections
import hashlib

import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from covenant.llm import bpe, mixing, queries
from covenant.llm.common import DOCUMENT_COLUMNS
from tests.llm.test_line_dedup import brute as brute_lines
from tests.llm.test_simhash_verified import brute_kept

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def stages(spark):
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, stage in pipeline.STAGES:
        after = stage(spark, docs, SF).persist()
        out.append((name, docs, after))
        docs = after
    yield out


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)


def test_columns(stages):
    for _, _, after in stages[:-1]:
        assert after.columns == DOCUMENT_COLUMNS and after.count() > 0


def test_toxicity(spark, stages):
    _, before, after = stages[0]
    rejected = {r.doc_id for r in queries.QUERIES["op2_toxicity"](spark, SF).where("predicted = 1").collect()}
    assert {r.doc_id for r in after.select("doc_id").collect()} == {r.doc_id for r in before.select("doc_id").collect()} - rejected and rejected


def test_lines(stages):
    _, before, after = stages[1]
    want = [(i, t) for i, n, lost, t in brute_lines(rows(before, "doc_id", "text")) if not lost or t.strip()]
    assert rows(after, "doc_id", "text") == sorted(want, key=str)
    assert all(len(t) == n for t, n in rows(after, "text", "n_chars"))


def test_near_duplicates(stages):
    _, before, after = stages[2]
    texts = dict(rows(before, "doc_id", "text"))
    want, pairs = brute_kept(texts)
    kept = dict(rows(after, "doc_id", "text"))
    assert want <= kept.keys() and all(texts[i] == t for i, t in kept.items())
    near = [(a, b) for a, b, similar in pairs if similar < 1]
    assert near and sum(not {a, b} <= kept.keys() for a, b in near) >= 0.9 * len(near)
    assert not [p for p in pairs if p[2] == 1 and {p[0], p[1]} <= kept.keys()]


def test_mixing(stages):
    _, before, after = stages[3]
    mixed = mixing.mix(before, share=pipeline.MIX_SHARE)
    assert rows(after, "doc_id") == rows(mixed.where("sampled"), "doc_id")
    total = before.select(F.sum(mixing.tokens_of(F.col("text")))).first()[0]
    assert after.select(F.sum(mixing.tokens_of(F.col("text")))).first()[0] / total == pytest.approx(pipeline.MIX_SHARE, abs=0.12)


def test_tokens(spark, stages):
    _, before, after = stages[4]
    back = bpe.decode(after, public_tokenizers.path("byte_bpe_50k.tiktoken"))
    assert {r.doc_id: bytes(r.bytes).decode() for r in back.collect()} == dict(rows(before, "doc_id", "text"))
    assert rows(pipeline.run(spark, SF), "doc_id", "n_tokens") == rows(after, "doc_id", "n_tokens")


def test_odd_rows(spark):
    text = "some words of a line that many documents share with each other " * 2
    given = [(1, text, "en", "a", 5), (1, text, "en", "a", 5), (2, None, None, None, None), (3, "", "en", "a", 0), (None, text, "en", "a", 1), (None, None, None, None, None)] + [(i, text + f"\nown line {i} " + hashlib.md5(str(i).encode()).hexdigest() * 3, "en", "b", 9) for i in range(10, 20)]
    docs = spark.createDataFrame(given, "doc_id long, text string, lang string, source string, n_chars long").withColumns({"score": F.lit("x"), "topic": F.lit(1), "kept": F.lit("k"), "fingerprint": F.lit(2)})
    for name, stage in pipeline.STAGES:
        out = stage(spark, docs, SF)
        assert stage(spark, docs.limit(0), SF).count() == 0, name
        if name != "bpe":
            assert out.columns == DOCUMENT_COLUMNS
        assert out.count() >= 1, name
    kept = collections.Counter(r.doc_id for r in pipeline.drop_near_duplicates(spark, docs, SF).collect())
    assert kept[1] == 1 and kept[None] == 2


def test_bare_documents_go(spark):
    """A clean document of nothing but lines that others share goes, whatever white space is left."""
    shared = [f"a clean passage number {i} that a lot of the documents share" for i in range(2)]
    docs = spark.createDataFrame([(i, "\n".join(shared) + "\n\t\r", "en", "a", 1) for i in range(9)], "doc_id long, text string, lang string, source string, n_chars long")
    assert [r.doc_id for r in pipeline.drop_lines(spark, docs, SF).collect()] == [8]


def test_repeated_id_keeps_each_group(spark):
    """Rows of one id stay apart unless they are near-duplicates of a lesser id or of each other."""
    texts = [" ".join(hashlib.md5(f"{k} {j}".encode()).hexdigest() for j in range(60)) for k in "abc"]
    given = [(3, texts[0]), (7, texts[0]), (7, texts[1]), (7, texts[2]), (7, texts[2].upper()), (9, texts[1])]
    docs = spark.createDataFrame([(i, t, "en", "a", len(t)) for i, t in given], "doc_id long, text string, lang string, source string, n_chars long")
    got = rows(pipeline.drop_near_duplicates(spark, docs, SF), "doc_id", "text")
    assert got == sorted([(3, texts[0]), (7, texts[1]), (7, texts[2].upper())], key=str)
