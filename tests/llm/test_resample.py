import collections
import hashlib
import math
import os
import random
import re
import zlib

import pytest

from covenant.llm import queries, resample
from tests.compare import connection, mismatch

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01")


def words_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(rows, target, n=1, buckets=50, percent=10, least=20, seed=2024):
    def found(text):
        w = words_of(text)
        return len(w), [zlib.crc32(" ".join(w[i : i + k]).encode()) % buckets for k in range(1, n + 1) for i in range(len(w) - k + 1)]

    s, t = (collections.Counter(b for x in texts for b in found(x)[1]) for texts in ([x for _, x in rows], target))
    S, T = s.total(), t.total()
    gain = [math.floor(1000 * math.log((t[b] + 1) * (S + buckets) / ((s[b] + 1) * (T + buckets)))) for b in range(buckets)]
    out = []
    for i, text in rows:
        count, features = found(text)
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in features)
        out.append([i, count, len(features), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))])
    able = sorted((r for r in out if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    for rank, r in enumerate(able[: percent * len(able) // 100], 1):
        r.append(rank)
    return sorted((tuple(r) if len(r) == 6 else (*r, None) for r in out), key=str)


def told(spark, rows, target, **options):
    df = spark.createDataFrame([(i, t, 1, "x", 2, 3) for i, t in rows], "doc_id long, text string, pos int, id string, rank int, weight int")
    found = resample.resample(df, spark.createDataFrame([(t,) for t in target], "text string"), buckets=50, **options)
    return sorted((tuple(r) for r in found.select("doc_id", "n_words", "n_features", "weight", "score", "rank").collect()), key=str)


def texts(rng, n):
    return [" ".join(rng.choice(["the", "Of", "é9", "w" + str(rng.randint(0, 30))]) + rng.choice(["", ",", "\n", "_x"]) for _ in range(rng.randint(0, 60))) for _ in range(n)]


TARGET = ["The w1 w2 of", None, "", "w3, w3; w4"]


@pytest.mark.parametrize("options", [{}, {"percent": 100, "least_words": 0}, {"n": 3, "percent": 50}])
def test_random(spark, monkeypatch, options):
    monkeypatch.setattr(resample, "BLOCK_ROWS", (16, 16))
    monkeypatch.setattr(resample, "DIGIT_BITS", 5)
    rng = random.Random(4)
    rows = list(enumerate(texts(rng, 300), -7)) + [(9000, None), (9001, ""), (9002, "...!"), (9003, "long " * 80000)]
    want = brute(rows, TARGET, n=options.get("n", 1), percent=options.get("percent", 10), least=options.get("least_words", 20))
    assert told(spark, rows, TARGET, **options) == want


def test_ids_far_apart_null_and_repeated(spark, monkeypatch):
    monkeypatch.setattr(resample, "BLOCK_ROWS", (8, 8))
    rng = random.Random(5)
    rows = [(rng.choice([-(1 << 63), (1 << 63) - 1, 0, 5, None, rng.randint(-(1 << 62), 1 << 62)]), "a b c " + t) for t in texts(rng, 80)]
    assert told(spark, rows, TARGET, percent=100, least_words=3) == brute(rows, TARGET, percent=100, least=3)
    rows = [(i, "same words") for i in [3, 3, None, 1, 2, 1 << 40]]
    assert told(spark, rows, TARGET, percent=100, least_words=0) == brute(rows, TARGET, percent=100, least=0)


def test_empty(spark):
    assert told(spark, [], TARGET) == [] and told(spark, [(1, "a " * 30)], [], percent=100) == brute([(1, "a " * 30)], [], percent=100)


def test_radix_sort_is_stable(spark, monkeypatch):
    monkeypatch.setattr(resample, "DIGIT_BITS", 2)
    rng = random.Random(6)
    rows = [(i * 3, rng.randint(0, 20), rng.randint(0, 2)) for i in range(200)]
    df = spark.createDataFrame(rows, "pos long, a long, b long").withColumnRenamed("pos", "was")
    got = resample.radix_sort(df.withColumn("pos", df["was"]), [("b", 2), ("a", 5)], 10).orderBy("pos").collect()
    assert [(r.was, r.a, r.b) for r in got] == sorted(rows, key=lambda r: (r[2], r[1])) and [r.pos for r in got] == list(range(200))


def test_query_like_sql(spark):
    assert mismatch(spark, connection(SF), queries.op13_resample, queries.ORACLE_SQL["op13_resample"], SF) is None
