import collections
import math
import re
import zlib

import pytest

from covenant.llm import katz


def brute(rows):
    """Katz over every pair of words, from the definition."""
    words = lambda t: re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    texts = [(i, words(t) + [None]) for i, t in rows]
    train = [t for i, t in texts if zlib.crc32(str("" if i is None else i).encode()) % 5 != 1]
    c = collections.Counter(w for t in train for w in t)
    total, room = sum(c.values()), sum(c.values()) + 0.5 * (len(c) + 1)
    pairs = collections.Counter((u, v) for t in train for u, v in zip(["START", *t], t, strict=False))
    d = katz.good_turing(collections.Counter(pairs.values()))
    after = collections.defaultdict(dict)
    for (u, v), n in pairs.items():
        after[u][v] = n
    base = lambda v: (c[v] + 0.5) / room
    share, back = {}, {}
    for u, followers in after.items():
        history = sum(followers.values())
        assert history == (len(train) if u == "START" else c[u])
        kept = 0.5 * (min(followers.values()) > 5)  # for the unseen, where no follower is discounted
        for v, n in followers.items():
            share[u, v] = (d[n - 1] if n <= 5 else 1) * n / (history + kept)
        back[u] = (1 - sum(share[u, v] for v in followers)) / (1 - sum(base(v) for v in followers))
    if len(c) < 2000:
        for u in after:  # exactly normalised: all words and the unknown one
            assert sum(share.get((u, v), back[u] * base(v)) for v in c) + back[u] * 0.5 / room == pytest.approx(1)
    out = []
    for i, t in texts:
        p = [share.get((u, v)) or back.get(u, 1.0) * base(v) for u, v in zip(["START", *t], t, strict=False)]
        out.append((i, len(t), sum(c[w] > 0 for w in t), total, sum(math.log10(base(w)) for w in t), sum(map(math.log10, p))))
    return out


def compare(got, want):
    order = lambda r: (str(r[0]), r[1:3], round(r[4], 4))
    got, want = sorted(got, key=order), sorted(want, key=order)
    assert [g[:4] for g in got] == [w[:4] for w in want]
    for g, w in zip(got, want, strict=True):
        assert g[4:] == pytest.approx(w[4:], abs=1e-6)


def told(df):
    return [(r.doc_id, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in df.collect()]


def test_odd_rows(spark, monkeypatch):
    rows = [(i, " ".join(["the", "Cat", "sat", "on", f"w{i % 7}", "THE", f"x{i}"][: 1 + i % 7] * (1 + i % 3))) for i in range(80)]
    rows += [(1, "the cat again"), (1, "the cat again"), (2, "another text"), (None, None), (None, "the cat"), (90, ""), (91, None), (92, "the cat sat " * 40000)]
    df = spark.createDataFrame([(i, t, "k", 1) for i, t in rows], "doc_id long, text string, key string, n int")
    compare(told(katz.score(df)), brute(rows))
    for name, least in (("CHUNK", 50), ("PART_TOKENS", 1000), ("SPLIT", 400)):  # many chunks and partitions, most histories spread
        monkeypatch.setattr(katz, name, least)
        compare(told(katz.score(df)), brute(rows))
    assert katz.score(df.limit(0)).count() == 0


def test_every_pair_counts(spark):
    """Pairs of words that are rare (here below 1e-5 of all tokens) are counted too."""
    rows = [(i, f"rare{i // 2} pair{i // 2} " + "common " * 3000) for i in range(120)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = told(katz.score(df))
    compare(got, brute(rows))
    assert min(r[3] for r in got) * 1e-5 > 2


def test_every_pair_of_documents_counts(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [tuple(r) for r in df.select("doc_id", "text").collect()]
    compare(told(katz.score(df)), brute(rows))
