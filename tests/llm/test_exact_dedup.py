import collections
import hashlib
import os
import random

import pytest

from covenant.llm import exact_dedup, queries
from tests.compare import connection, mismatch

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01")


def plain(text):
    return "".join(c for c in text or "" if c not in " \t\n\x0b\x0c\r")


def brute(rows):
    groups = collections.defaultdict(list)
    for i, t in rows:
        groups[plain(t)].append((-len(t or ""), i is None, i or 0))
    out = []
    for text, members in groups.items():
        members.sort()
        keep = None if members[0][1] else members[0][2]
        out += [(None if m[1] else m[2], keep, len(members), n == 0, hashlib.sha256(text.encode()).hexdigest()) for n, m in enumerate(members)]
    return sorted(out, key=str)


def told(spark, rows, **options):
    df = spark.createDataFrame([(i, t, "x", 1, b"b", 2) for i, t in rows], "doc_id long, text string, hash string, row int, bits binary, size int")
    found = exact_dedup.classes(df, digest=True, **options)
    return sorted(((r.doc_id, r.keep_id, r.group_size, r.kept, r.full) for r in found.collect()), key=str)


ROWS = [
    (1, "one two"), (2, "one  two"), (3, "onetwo"), (4, "one two"), (5, None), (6, ""), (7, " \t\n\x0b\x0c\r"), (8, "One two"),
    (9, "é" * 70000), (10, "é " * 70000), (None, "one two "), (None, "only without an id"), (11, "x" * 64 + "a"), (12, "x" * 64 + "b"), (12, "x" * 64 + "b"), (12, "twice\n"), (12, "t wice"),
]


def test_cases(spark):
    assert told(spark, ROWS) == brute(ROWS)
    assert told(spark, []) == []


@pytest.mark.parametrize("seed", range(2))
def test_random(spark, monkeypatch, seed):
    """Few bits, so that many keys share one, a short prefix, and hot groups."""
    monkeypatch.setattr(exact_dedup, "BITS", 64)
    monkeypatch.setattr(exact_dedup, "PREFIX", 2)
    monkeypatch.setattr(exact_dedup, "HOT", 8)
    rng = random.Random(seed)
    rows = [(i, "".join(rng.choice("ab \n") for _ in range(rng.randint(0, 12)))) for i in range(300)] + [(i, "the  same") for i in range(300, 450)]
    rng.shuffle(rows)
    assert told(spark, rows) == brute(rows)


def test_hashes_only_survivors(spark):
    df = spark.createDataFrame([(1, "alone"), (2, "length1"), (3, "length2"), (4, "pair"), (5, "p air")], "doc_id long, text string")
    hashed = {r.doc_id for r in exact_dedup.classes(df).where("full IS NOT NULL").collect()}
    assert hashed == {4, 5}


def test_deduplicate_keeps_whole_rows(spark):
    df = spark.createDataFrame([(1, "a", 0.5), (2, "a ", 1.5), (3, "b", 2.5), (None, "b", 3.5), (4, "c", 4.5), (4, " a", 5.5)], "doc_id long, text string, own double")
    assert sorted(r.own for r in exact_dedup.deduplicate(df).collect()) == [1.5, 2.5, 3.5, 4.5, 5.5]


def test_query_like_sql(spark):
    assert mismatch(spark, connection(SF), queries.op12_exact_dedup, queries.OP12_SQL, SF) is None
