import random

import pytest
from pyspark.sql import functions as F

from covenant.operators import diff, partition, scan
from tests.spent import spent

SCHEMA = "k string, o int, v int"


def rows_of(rng, n):
    """One key holds half the rows; some keys and values are null."""
    orders = rng.sample(range(10 * n), n)
    return [(rng.choice(["hot", "hot", "hot", rng.choice([None, "a", "b", "c"])]), o, rng.choice([None, rng.randint(-9, 9)])) for o in orders]


def brute(rows, op, inclusive):
    fold = {"max": max, "min": min, "sum": lambda a, b: a + b, "last": lambda a, b: b}[op]
    out, held = [], {}
    for k, o, v in sorted(rows, key=lambda r: r[1]):
        before = held.get(k)
        if v is not None:
            held[k] = v if before is None else fold(before, v)
        out.append((k, o, held.get(k) if inclusive else before))
    return sorted(out, key=str)


@pytest.mark.parametrize("parts", [1, 7, 40])
def test_like_brute_force(spark, parts):
    rows = rows_of(random.Random(parts), 300)
    df = spark.createDataFrame(rows, SCHEMA)
    for inclusive in (False, True):
        got = scan.running(df, ["k"], ["o"], {op: (op, F.col("v")) for op in scan.MONOIDS}, inclusive, parts).collect()
        for op in scan.MONOIDS:
            assert sorted(((r.k, r.o, r[op]) for r in got), key=str) == brute(rows, op, inclusive), (op, inclusive)


def test_without_key_empty_and_before(spark):
    df = spark.createDataFrame([("a", i, None if i % 3 else i) for i in range(50)], SCHEMA)
    got = {r.o: r.n for r in scan.running(df, [], ["o"], {"n": ("sum", F.lit(1))}, parts=6).collect()}
    assert got == {i: i or None for i in range(50)}
    got = {r.o: (r.was, r.at) for r in scan.before(df, ["k"], ["o"], {"was": F.col("v"), "at": F.col("o")}, parts=6).collect()}
    assert got == {i: ((None if (i - 1) % 3 else i - 1), i - 1) if i else (None, None) for i in range(50)}
    assert scan.running(df.limit(0), ["k"], ["o"], {"n": ("max", F.col("v"))}).count() == 0


def test_hot_key_is_spread(spark):
    """No task of the local scan has more than twice the mean."""
    df = spark.range(20_000).selectExpr("CASE WHEN id % 2 = 0 THEN 'hot' ELSE cast(id AS string) END AS k", "id AS o", "id AS v")
    out = scan.running(df, ["k"], ["o"], {"n": ("max", F.col("v"))}, parts=8)
    sizes = [r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) == 8 and max(sizes) <= 2 * sum(sizes) / len(sizes)


def test_overlaps(spark):
    rng = random.Random(2)
    rows = [(i, rng.choice(["a", "a", "b", None]), rng.randint(0, 200), rng.choice([0, 1, 5, 400])) for i in range(150)]
    rows = [(i, k, lo, lo + w) for i, k, lo, w in rows] + [(900, "a", None, 5), (901, "a", 5, None)]
    want = sorted((x[0], y[0]) for x in rows for y in rows if x[0] < y[0] and x[1] is not None and x[1] == y[1] and None not in x[2:] and None not in y[2:] and x[2] < x[3] and y[2] < y[3] and x[2] < y[3] and y[2] < x[3])
    df = spark.createDataFrame(rows, "id int, k string, lo int, hi int")
    assert sorted(map(tuple, scan.overlaps(df, "id", ["k"], "lo", "hi", parts=5).collect())) == want


def test_overlaps_shuffles_no_pairs(spark):
    """Rows that all overlap: what is shuffled grows with them, not with their pairs."""
    n, most = 3000, spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    df = spark.range(n).selectExpr("id", "'a' AS k", "id AS lo", f"id + {n} AS hi")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        before = spent(spark)[1]
        pairs = scan.overlaps(df, "id", ["k"], "lo", "hi", parts=4)
        assert pairs.agg(F.count("*"), F.count_if(F.col("a") < F.col("b"))).first() == (n * (n - 1) // 2,) * 2
        assert spent(spark)[1] - before < 1000 * n
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", most)


def test_pairs_take_little_space(spark, tmp_path):
    """Keys that are not in the order of the ranges: pairs are given out in an order
    that files keep small, and none is lost by it."""
    n = 6000
    df = spark.range(n).selectExpr(f"id * 2741 % {n} AS id", "'a' AS k", "id AS lo", f"id + {n // 3} AS hi")
    scan.overlaps(df, "id", ["k"], "lo", "hi", parts=4).write.parquet(f"{tmp_path}/pairs")
    pairs = spark.read.parquet(f"{tmp_path}/pairs")
    rows = (n - n // 3) * (n // 3 - 1) + (n // 3) * (n // 3 - 1) // 2
    assert pairs.count() == rows and pairs.where("a < b").distinct().count() == rows
    size = sum(f.stat().st_size for f in (tmp_path / "pairs").glob("*.parquet"))
    assert size < 0.7 * rows, size / rows


def test_locate(spark):
    rng = random.Random(3)
    edges = sorted(rng.sample(range(1000), 30)) + [10**6]
    bounds = [("low", None, edges[0])] + [(f"b{i}", a, b) for i, (a, b) in enumerate(zip(edges, edges[1:], strict=False)) if i % 4] + [("high", 10**6, None)]
    rows = [(i, rng.choice([None, rng.randint(-5, 1100), 10**7])) for i in range(300)]
    inside = lambda v: next((n for n, a, b in bounds if v is not None and (a is None or a <= v) and (b is None or v < b)), None)
    df = spark.createDataFrame(rows, "id int, at int")
    got = scan.locate(df, "at", spark.createDataFrame(bounds, "name string, start int, end int"), parts=6)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(((i, v, inside(v)) for i, v in rows), key=str)


def test_route_tree(spark):
    kinds = "parent string, name string, start int, end int, values array<string>, is_default boolean"
    top = spark.createDataFrame([(None, "eu", None, None, ["de", "fr"], False), (None, "us", None, None, ["us"], False)], kinds)
    below = spark.createDataFrame([("eu", "low", None, 10, None, False), ("eu", "rest", None, None, None, True), ("us", "high", 10, None, None, False)], kinds)
    df = spark.createDataFrame([("de", 5), ("fr", 10), ("fr", None), ("us", 5), ("us", 11), ("jp", 1), (None, 1)], "land string, n int")
    got = sorted(((r.land, r.n, r.partition) for r in partition.route_tree(df, [("land", top), ("n", below)]).collect()), key=str)
    want = [("de", 5, "eu/low"), ("fr", 10, "eu/rest"), ("fr", None, "eu/rest"), ("us", 5, None), ("us", 11, "us/high"), ("jp", 1, None), (None, 1, None)]
    assert got == sorted(want, key=str)


def test_insert_positions_of_a_large_enum(spark):
    """Like its definition, and a large enum is spread over tasks."""
    rng = random.Random(4)
    new = [(k, f"{k}{i}", i) for k, n in (("hot", 400), ("a", 5), (None, 3)) for i in rng.sample(range(2 * n), n)]
    old = [r for r in new if rng.random() < 0.5 and r[2] > 20]
    want = []
    for k in ("hot", "a", None):
        labels = [r[1] for r in sorted((r for r in new if r[0] == k), key=lambda r: r[2])]
        there = {r[1] for r in old if r[0] == k and k is not None}
        for i, label in enumerate(labels):
            after = next((x for x in labels[i + 1 :] if x in there), None)
            if label not in there:
                want.append((k, label, "after", labels[i - 1]) if i else (k, label, "before" if after else "append", after))
    a, b = (spark.createDataFrame(x, "k string, label string, ordinal int") for x in (old, new))
    found = diff.insert_positions(a, b, ["k"])
    assert sorted(map(tuple, found.collect()), key=str) == sorted(want, key=str)
    sizes = [r["count"] for r in found.where("k = 'hot'").groupBy(F.spark_partition_id()).count().collect()]
    assert max(sizes) <= sum(sizes) / 2
