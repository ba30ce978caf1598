import collections
import math
import os
import random
import re

import numpy as np
import pytest

from covenant.llm import lexical, queries
from tests.compare import connection, mismatch

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01")


def terms_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, k):
    held = [(i, collections.Counter(terms_of(t))) for i, t in docs]
    df = collections.Counter(w for _, c in held for w in c)
    n, total = sum(1 for _, c in held if c), sum(c.total() for _, c in held)
    asked = collections.defaultdict(collections.Counter)
    for i, t in items:
        asked[i].update(terms_of(t))
    out = []
    for item, wanted in asked.items():
        found = []
        for i, c in held:
            m = 100 - 25 + 25 * c.total() * n // max(total, 1)
            score = sum(q * math.floor(1000 * math.log((2 * n + 2) / (2 * df[w] + 1))) * (1000000000 * c[w] // (1000 * c[w] + 12 * m)) for w, q in wanted.items() if c[w])
            if score > 0:
                found.append((-score, i is None, i or 0))
        out += [(item, r, None if unknown else i, -s) for r, (s, unknown, i) in enumerate(sorted(found)[:k], 1)]
    return sorted(out, key=str)


def told(spark, docs, items, k, **options):
    df = spark.createDataFrame([(i, t, 1, "x", b"") for i, t in docs], "doc_id long, text string, block int, item string, terms binary")
    asked = spark.createDataFrame([(i, t, 1, 2) for i, t in items], "item_id long, text string, doc_id int, rank int")
    return sorted((tuple(r) for r in lexical.rank_documents(df, asked, k, **options).select("item_id", "rank", "doc_id", "score").collect()), key=str)


def corpus(rng):
    word = lambda: rng.choice(["W", "w"]) + f"{int(rng.paretovariate(0.7))}"
    some = lambda most: rng.choice([" ", "-", ". "]).join(word() for _ in range(rng.randint(0, most)))
    docs = [(i, some(60)) for i in range(400)]
    docs += [(7, docs[7][1]), (900, None), (901, ""), (902, "é_é w1"), (None, docs[3][1]), (903, docs[3][1]), (904, "W1 " * 50000), (905, " w".join(map(str, range(5000))))]
    items = [(i, some(20)) for i in range(60)] + [(70, None), (71, "unheard"), (3, "w1 w2"), (None, "w3 W3 w3"), (None, "w4"), (72, docs[9][1])]
    rng.shuffle(docs)
    return docs, items


@pytest.mark.parametrize("exact", [1 << 53, 1])
def test_random(spark, exact):
    """Small blocks, leaves, packs and tables of bits; as doubles and as integers."""
    sizes = lexical.Sizes(block_docs=16, leaf_docs=4, block_terms=200, pack_items=9, pack_terms=60, leaf_items=2, fan=2, held_items=24, shard_docs=100, asked=64, merge=30, exact=exact)
    docs, items = corpus(random.Random(8))
    assert told(spark, docs, items, 5, sizes=sizes) == brute(docs, items, 5)


def test_defaults_and_empty_tables(spark):
    docs, items = corpus(random.Random(9))
    assert told(spark, docs, items, 20) == brute(docs, items, 20)
    assert told(spark, [], items, 3) == [] and told(spark, docs, [], 3) == [] and told(spark, [(1, None)], items, 3) == []


def test_bounds_prune(monkeypatch):
    """Once the best are known, a block of weaker documents is not scored."""
    scored = []
    dense = lexical.Documents.dense
    monkeypatch.setattr(lexical.Documents, "dense", lambda self, lo, hi, use, dtype: scored.append(lo) or dense(self, lo, hi, use, dtype))
    items = lexical.Items({"items": np.array([1]).tobytes(), "i_each": np.array([2], np.int32).tobytes(), "i_terms": np.array([10, 20]).tobytes(), "i_worth": np.array([50, 3]).tobytes()}, 2, lexical.Sizes())

    def block(term, ids):
        row = {"lengths": np.full(len(ids), 10), "each": np.ones(len(ids), np.int32), "terms": np.full(len(ids), term, np.uint64), "counts": np.ones(len(ids), np.int32)}
        return lexical.Documents({k: v.tobytes() for k, v in row.items()} | {"ids": ids}, 100, 1000)

    items.search(block(10, [5, 6, 7]))
    first = len(scored)
    items.search(block(20, list(range(100, 180))))
    assert len(scored) - first == 3  # the leaves' maxima, no scores
    assert items.best[3].tolist() == [5, 6] and items.kth[0] == items.best[1][1] > 0


def test_query_like_sql(spark):
    assert mismatch(spark, connection(SF), queries.op11_lexical, queries.OP11_SQL, SF) is None
