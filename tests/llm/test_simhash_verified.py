import collections
import itertools
import re

import numpy as np
import pytest
import xxhash

from covenant.llm import simhash_verified as verified

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def brute_set(text, width=5):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return frozenset(" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))) if words else frozenset()


def brute_pairs(texts, similarity=0.8):
    """All pairs of ids whose texts are similar, with how much."""
    sets = {i: brute_set(t) for i, t in texts.items()}
    holders, pairs = collections.defaultdict(list), []
    for i, s in sets.items():
        shared = collections.Counter(j for x in s for j in holders[x])
        pairs += [(j, i, n / (len(s) + len(sets[j]) - n)) for j, n in shared.items() if n / (len(s) + len(sets[j]) - n) >= similarity]
        for x in s:
            holders[x].append(i)
    return sets, pairs


def brute_kept(texts, similarity=0.8):
    """Least ids of the groups that all similar pairs make, and the pairs."""
    sets, pairs = brute_pairs(texts, similarity)
    up = {i: i for i in texts}

    def top(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    bare = [i for i in texts if not sets[i]]
    for a, b in [p[:2] for p in pairs] + [(bare[0], b) for b in bare[1:]]:
        a, b = top(a), top(b)
        up[max(a, b)] = min(a, b)
    return {i for i in texts if top(i) == i}, pairs


def prose(rng, n):
    return [f"w{x}" for x in rng.integers(0, 5000, n).tolist()]


def test_shingles_and_sketch():
    for text in (None, "", " \n", "One", "a b c", "The cat sat on THE mat", "é è\xa0x y z\x0bq b c", "word " * 9000):
        assert verified.shingles(text, 5, 42).tolist() == sorted(xxhash.xxh64_intdigest(x.encode(), 42) for x in brute_set(text))
    rng = np.random.default_rng(1)
    same = rng.integers(0, 2**63, 20000).astype(np.uint64)
    a, b = (verified.sketch(np.sort(np.concatenate([same, rng.integers(0, 2**63, 2500).astype(np.uint64)])), 40) for _ in range(2))
    far = verified.sketch(rng.integers(0, 2**63, 9000).astype(np.uint64), 40)
    # a cosine of 0.889 is an angle of 0.1515 half turns
    assert np.bitwise_count(a ^ b).sum() / 1280 == pytest.approx(0.1515, abs=0.05)
    assert np.bitwise_count(a ^ far).sum() / 1280 == pytest.approx(0.5, abs=0.07)


@pytest.mark.parametrize("small", [0, 1, 16])
def test_trie_join_like_brute_force(small, monkeypatch):
    monkeypatch.setattr(verified, "SMALL", small)
    monkeypatch.setattr(verified, "FRONT", 500)
    rng = np.random.default_rng(5)
    seeds = rng.integers(0, 2**32, 60).tolist()
    value = np.sort(np.array([s ^ sum(1 << b for b in rng.choice(32, rng.integers(0, 4), replace=False).tolist()) for s in seeds for _ in range(9)] + [7] * 40, np.uint64))
    check = rng.integers(0, 2**63, len(value)).astype(np.uint64)
    check[rng.random(len(value)) < 0.7] = 3
    label = rng.integers(0, 30, len(value))
    got = [tuple(sorted(p)) for a, b in verified.candidates(value, check, label, 10) for p in zip(a.tolist(), b.tolist(), strict=True)]
    v, c = value.tolist(), check.tolist()
    want = {(i, j) for i, j in itertools.combinations(range(len(v)), 2) if v[i] >> 22 == v[j] >> 22 and (v[i] ^ v[j]).bit_count() <= 2 and (c[i] ^ c[j]).bit_count() <= 21 and label[i] != label[j]}
    assert set(got) == want and len(got) == len(want) > 100


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_documents_like_brute_force(spark, sf):
    docs = spark.read.parquet(f"/root/testdata/{sf}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    want, pairs = brute_kept(texts)
    kept = {r.doc_id for r in verified.one_of_each(docs).select("doc_id").collect()}
    assert want <= kept  # no pair below 0.8 is linked
    near = [(a, b) for a, b, similar in pairs if similar < 1]
    assert near and sum(not {a, b} <= kept for a, b in near) >= 0.9 * len(near)
    assert len(kept - want) <= 0.1 * (len(texts) - len(want))


def test_pairs_just_above_and_below(spark):
    rng = np.random.default_rng(9)
    given, above, below = [], [], []
    for i in range(0, 800, 2):
        words = prose(rng, 300)
        other = list(words)
        for at in rng.choice(60, 6 if i % 4 else 12, replace=False).tolist():
            other[at * 5] = "changed"
        given += [(i, " ".join(words)), (i + 1, " ".join(other))]
        a, b = brute_set(given[-1][1]), brute_set(given[-2][1])
        (above if len(a & b) / len(a | b) >= 0.8 else below).append(i + 1)
    df = spark.createDataFrame([(i, t, "en", "a", len(t)) for i, t in given], COLUMNS)
    kept = {r.doc_id for r in verified.one_of_each(df).select("doc_id").collect()}
    assert len(above) > 100 and len(below) > 100 and {i for i, _ in given if i % 2 == 0} | set(below) <= kept
    assert len(kept & set(above)) <= 0.1 * len(above)


def test_large_group_of_near_copies(spark):
    """Copies of one text with a word changed each leave one; few pairs are verified."""
    rng = np.random.default_rng(2)
    words = prose(rng, 400)
    given = [(i, " ".join(words[:i] + [f"x{i}"] + words[i + 1 :]), "en", "a", 1) for i in range(400)] + [(1000 + i, " ".join(prose(rng, 40)), "en", "a", 1) for i in range(50)]
    df = spark.createDataFrame(given, COLUMNS)
    assert {r.doc_id for r in verified.one_of_each(df).select("doc_id").collect()} == {0} | {1000 + i for i in range(50)}


def test_odd_rows(spark):
    long = " ".join(f"w{i}" for i in range(30000))
    given = [(5, long, None, "a", 1), (4, long + " end", None, "a", 1), (4, long.upper(), None, "a", 1), (None, long, "en", None, None), (None, None, None, None, None), (9, None, "x", "a", 0), (8, " \n", "x", "a", 0), (7, "two words", "x", "a", 0), (6, "Two\twords", "x", "a", 0), (3, "two word", "x", "a", 0), (2, "same row", "x", "a", 0), (2, "same row", "x", "a", 0)]
    df = spark.createDataFrame([(*r, "s", 1) for r in given], COLUMNS + ", row string, name long")
    out = verified.one_of_each(df)
    assert out.columns == df.columns
    got = sorted(((r.doc_id, r.text) for r in out.collect()), key=str)
    assert got == sorted([(4, long.upper()), (None, long), (None, None), (8, " \n"), (6, "Two\twords"), (3, "two word"), (2, "same row")], key=str)
    assert verified.one_of_each(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        verified.one_of_each(df, tables=2)
