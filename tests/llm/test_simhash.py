import re

import numpy as np
import xxhash

from covenant.llm import simhash
from covenant.llm.common import components, spanning


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(ids, prints, budget=3):
    group = {i: {i} for i in ids}
    for x, a in enumerate(ids):
        for b, pb in zip(ids[x + 1 :], prints[x + 1 :], strict=True):
            if bin(prints[x] ^ pb).count("1") <= budget and group[a] is not group[b]:
                group[a] |= group[b]
                for c in group[b]:
                    group[c] = group[a]
    return {i: min(group[i]) for i in ids}


def test_fingerprint():
    for text in (None, "", " \n", "One", "a b", "The cat sat on THE mat", "é è\xa0x y z\x0bq", "word " * 70000):
        assert simhash.fingerprint(text, 3, 42) == brute_fingerprint(text)


def test_trie_like_brute_force():
    rng = np.random.default_rng(3)
    seeds = rng.integers(0, 2**63, 60, dtype=np.uint64) * np.uint64(2) + rng.integers(0, 2, 60, dtype=np.uint64)
    values = []
    for s in seeds.tolist():
        for _ in range(12):
            v = s
            for b in rng.choice(64, rng.integers(0, 6), replace=False).tolist():
                v ^= 1 << b
            values.append(v)
    values = sorted(set(values) | {0, 2**64 - 1, 7})
    want = brute_components(values, values)
    edges = []
    for k in range(4):
        roll = lambda v, n: (v << n | v >> (64 - n)) & (2**64 - 1) if n else v  # noqa: B023,E731
        a, b = simhash.trie_links(np.array([roll(v, 16 * k) for v in values], np.uint64), 16, 3)
        edges += [(roll(x, (64 - 16 * k) % 64), roll(y, (64 - 16 * k) % 64)) for x, y in zip(a.tolist(), b.tolist(), strict=True)]
    for a, b in edges:
        assert want[a] == want[b]
    a, b = spanning(*np.array(edges, np.uint64).T)
    got = dict(zip(a.tolist(), b.tolist(), strict=True))
    assert {v: got.get(v, v) for v in values} == want


def test_components(spark):
    pairs = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 102), (100, 102), (5, 5), (None, 3)] + [(200 + i, 200) for i in range(1, 30)]
    got = dict(map(tuple, components(spark.createDataFrame(pairs, "a long, b long")).collect()))
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in (100, 101, 102)} | {200 + i: 200 for i in range(30)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_cluster(spark):
    base = "the quick brown fox jumps over the lazy dog and runs far away from all the noise of a big town " * 6
    texts = [base, base, base + "end", base.upper(), None, "", "hi", "x", base.replace("dog", "cat", 1), "a b c d " * 900]
    rows = [(i, t, "f", "c", i) for i, t in enumerate(texts)] + [(1, base, "f", "c", 1), (None, "x", "f", "c", 0), (None, "alone here now", "f", "c", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, fingerprint string, component_id string, least long")
    got = simhash.cluster(df).collect()
    assert len(got) == len(rows)
    ids = [i for i, _ in enumerate(texts)]
    want = brute_components(ids, [brute_fingerprint(t) for t in texts])
    for r in got:
        if r.doc_id is not None:
            assert r.fingerprint == f"{brute_fingerprint(texts[r.doc_id]):016x}"
            assert r.component_id == want[r.doc_id]
    assert {r.component_id for r in got if r.doc_id is None} == {want[7], None}
    assert simhash.cluster(df.limit(0)).count() == 0


def test_cluster_on_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.cluster(docs).collect()}
    texts = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    ids = sorted(texts)
    prints = [brute_fingerprint(texts[i]) for i in ids[:150]]
    assert [got[i][0] for i in ids[:150]] == [f"{p:016x}" for p in prints]
    all_prints = [int(got[i][0], 16) for i in ids]
    want = brute_components(ids, all_prints)
    assert {i: got[i][1] for i in ids} == want
    assert len(set(want.values())) < len(ids)
