import random

import pytest

from covenant.operators.keyindex import TIER_RUNS, KeyIndex
from covenant.plans.store import CommitConflict
from tests.spent import spent

KEY = [("a", "int"), ("b", "string")]


def test_like_brute_force(spark, tmp_path):
    rng = random.Random(1)
    index, kept = KeyIndex(spark, str(tmp_path / "i"), KEY, 4), set()
    for turn in range(7):
        rows = [(rng.choice([None, *range(12)]), rng.choice([None, "x", "y"])) for _ in range(14)]
        df = spark.createDataFrame([(a, b, "more") for a, b in rows], "a int, b string, extra string")
        if turn % 3 == 2:
            index.remove(df)
            kept -= set(rows)
            continue
        full = [r for r in rows if None not in r]
        want = {(*k, full.count(k), "known" if k in kept else "repeated") for k in full if k in kept or full.count(k) > 1}
        assert {tuple(r) for r in index.clashes(df).collect()} == want, turn
        index.add(df)
        kept |= set(full)
    assert {(r.a, r.b) for r in index.latest(index.runs()[1]).where("NOT __gone").collect()} == kept
    assert len(index.runs()[1]) < 7 and {r.tier for r in index.runs()[1]} == {0, 1}


def test_small_batches_read_little(spark, tmp_path):
    """What a batch reads is that of its own buckets, and runs stay few."""
    index = KeyIndex(spark, str(tmp_path / "i"), [("id", "bigint")], 64)
    for i in range(TIER_RUNS + 1):
        index.add(spark.range(i * 8000, (i + 1) * 8000))
    assert len(index.runs()[1]) == 2
    batch = spark.createDataFrame([(5,), (10**9,), (10**9,)], "id long")
    before = spent(spark)[0]
    assert {(r.id, r.rows, r.reason) for r in index.clashes(batch).collect()} == {(5, 1, "known"), (10**9, 2, "repeated")}
    assert spent(spark)[0] - before < 8000  # of 40,000 keys, those of two buckets


def test_empty_and_conflict(spark, tmp_path):
    index = KeyIndex(spark, str(tmp_path / "i"), [("id", "bigint")])
    assert index.clashes(spark.range(3)).count() == 0 and index.runs() == (0, [])
    index.add(spark.range(0))
    assert index.clashes(spark.range(3)).count() == 0
    index.manifests.put(2, {"runs": []})
    other = KeyIndex(spark.newSession(), str(tmp_path / "i"), [("id", "bigint")])
    with pytest.raises(CommitConflict):
        other.manifests.put(2, {"runs": []})
