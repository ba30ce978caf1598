import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from covenant.llm import langid, queries


def counts_of(texts):
    out = {}
    for w in " ".join(texts).split():
        s = langid.BEGIN + w + langid.END
        for i in range(1, len(s)):
            g = s[max(0, i - 4) : i + 1]
            out[g] = out.get(g, 0) + 1
    return out


def test_probabilities_sum_to_one():
    rng = random.Random(1)
    words = lambda a: ["".join(rng.choice(a) for _ in range(rng.randint(1, 6))) for _ in range(400)]
    model = langid.Model.build({"x": counts_of(words("abcd")), "y": counts_of(words("cdeé"))})
    chars = "abcdeé" + langid.END
    uniform = 1 / (len(chars) + 1)

    def p(history, c):
        """Probability of ``c`` by differences of the log probabilities of prefixes."""
        s = langid.BEGIN + history + c
        value = model.floor.astype(float)
        for n in range(1, min(5, len(s)) + 1):
            at, hit = langid.found(model.grams[n - 1][0], langid.hashes([s[-n:]]))
            if hit[0]:
                value = model.grams[n - 1][1][at[0]].astype(float)
            elif n > 1:
                at, hit = langid.found(model.passed[n - 1][0], langid.hashes([s[-n:-1]]))
                value = value * (model.passed[n - 1][1][at[0]] if hit[0] else 1)
        return value

    for history in ("", "a", "ab", "dcd", "abcd", "éé", "zzz"):
        total = sum(p(history, c) for c in chars) + model.floor / 1.0 * 0
        unknown = p(history, "☃")
        assert np.allclose(total + unknown, 1, atol=1e-3), (history, total, unknown)
    got = model.log2(["abcd", "é", "dcdabca", "☃x"])
    for w, row in zip(["abcd", "é", "dcdabca", "☃x"], got, strict=True):
        want = sum(np.log2(p(w[:i], (w + langid.END)[i])) for i in range(len(w) + 1))
        assert np.allclose(row, want, atol=1e-3)
    assert uniform < 1


def test_held_out(spark):
    sf = "/root/testdata/sf0.1"
    got = queries.QUERIES["op8_langid"](spark, sf)
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang")
    rows = got.where("held_out").join(docs, "doc_id").select("lang", "lang_pred", "score").collect()
    assert sum(r.lang == r.lang_pred for r in rows) / len(rows) > 0.95
    assert all(0 <= r.score <= 1 for r in rows)


def test_odd_rows(spark):
    train = [(i, w * 30, k) for i in range(40) for w, k in (("hello world the ", "en"), ("bonjour monde le ", "fr"))]
    model = langid.learn(spark.createDataFrame(train, "doc_id long, text string, lang string"))
    assert model.languages == ["en", "fr"]
    odd = [(1, None), (2, ""), (3, "123 ?! ²"), (4, "Hello THE"), (5, "bonjour"), (None, "le monde " * 90000), (7, "漢字 漢字")]
    df = spark.createDataFrame([(i, t, "a", 1) for i, t in odd], "doc_id long, text string, lang_pred string, bits int")
    by = {r.doc_id: r for r in langid.identify(df, model).collect()}
    assert [by[i].lang_pred for i in (1, 2, 3, 4, 5, None)] == ["und"] * 3 + ["en", "fr", "fr"]
    assert by[7].rejected and by[7].lang_pred in model.languages and not by[4].rejected and by[1].score == 0
    assert langid.identify(df.limit(0), model).count() == 0
    none = langid.learn(df.withColumn("lang", df.lang_pred).limit(0))
    assert {r.lang_pred for r in langid.identify(df, none).collect()} == {"und"}




def kneser_ney(raw):
    """The probability of a character after a history, for each language, from
    the definition: ``raw`` has the counts of the longest grams of each."""
    counts = {}
    for lang, grams in raw.items():
        by = {n: {} for n in range(1, 6)}
        for g, c in grams.items():
            by[len(g)][g] = by[len(g)].get(g, 0) + c
        for n in range(4, 0, -1):
            for g in by[n + 1]:
                by[n][g[1:]] = by[n].get(g[1:], 0) + 1
        counts[lang] = by
    chars = {g for by in counts.values() for g in by[1]}
    discounts = {}
    for lang, by in counts.items():
        for n in by:
            once, twice = (sum(c == k for c in by[n].values()) for k in (1, 2))
            discounts[lang, n] = min(0.95, max(0.1, once / (once + 2 * twice) if once else 0.5))
    following = {}
    for lang, by in counts.items():
        for n in by:
            for g, c in by[n].items():
                following.setdefault((lang, g[:-1]), []).append(c)

    def p(lang, history, c):
        below = p(lang, history[1:], c) if history else 1 / (len(chars) + 1)
        after = following.get((lang, history))
        if after is None:
            return below
        n = len(history) + 1
        d, total = discounts[lang, n], sum(after)
        return max(counts[lang][n].get(history + c, 0) - d, 0) / total + d * len(after) / total * below

    return p


def test_query_like_definition(spark):
    """Every text of a small table, by plain recursion over counts made anew."""
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    tune = F.pmod(F.xxhash64(F.lit("tune"), "doc_id"), F.lit(5)) == 0
    rows = docs.select("doc_id", "text", "lang", tune.alias("tune"), (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 != 1).alias("learned")).collect()
    words_of = lambda t: [w for w in re.findall(r"[^\W\d_]+", (t or "").lower())]
    raw = {}
    for r in rows:
        if r.learned and not r.tune and r.lang is not None and r.text is not None:
            into = raw.setdefault(r.lang, {})
            for g, n in counts_of([" ".join(words_of(r.text))]).items():
                into[g] = into.get(g, 0) + n
    p, languages = kneser_ney(raw), sorted(raw)
    model = langid.learn(docs)
    assert model.languages == languages
    known = {}

    def bits(w):
        if w not in known:
            s = langid.BEGIN + w + langid.END
            known[w] = [-sum(math.log2(p(k, s[max(0, i - 4) : i], s[i])) for i in range(1, len(s))) for k in languages]
        return known[w]

    got = {r.doc_id: r for r in queries.QUERIES["op8_langid"](spark, sf).collect()}
    assert len(got) == len(rows)
    for r in rows:
        words = words_of(r.text)
        if not words:
            assert got[r.doc_id].lang_pred == "und" and got[r.doc_id].score == 0
            continue
        entropy = [sum(column) / sum(len(w) + 1 for w in words) for column in zip(*map(bits, words), strict=True)]
        least = min(entropy)
        assert languages[entropy.index(least)] == got[r.doc_id].lang_pred
        assert got[r.doc_id].score == pytest.approx(1 / sum(2.718281828459045 ** (model.temperature * (least - e)) for e in entropy), abs=1e-3)


def test_repeated_rows_and_bounds(spark):
    train = spark.createDataFrame([(i, w * 30, k) for i in range(40) for w, k in (("hello world the ", "en"), ("bonjour monde le ", "fr"))], "doc_id long, text string, lang string")
    got = langid.identify(spark.createDataFrame([(1, "hello you"), (1, "hello you"), (2, "hello you")], "doc_id long, text string"), langid.learn(train)).collect()
    assert len(got) == 3 and len({(r.lang_pred, r.score, r.bits) for r in got}) == 1
    with pytest.raises(ValueError):
        langid.learn(train, max_languages=1)
    with pytest.raises(ValueError):
        langid.learn(train, max_grams=10)
