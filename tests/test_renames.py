import random
import time

from covenant.operators.diff import resolve_renames


def brute(names, renames):
    """``renames``: old, new, ordinal, crossed; one after the other."""
    there, out = set(names), []
    for old, new, ordinal, crossed in sorted(renames, key=lambda r: (r[2], r[0], r[1])):
        if old == new or old not in there and new in there:
            status = "noop"
        elif old not in there:
            status = "missing_source"
        elif new in there:
            status = "dest_exists"
        elif crossed:
            status = "cross_schema"
        else:
            status = "applied"
            there = there - {old} | {new}
        out.append((old, new, ordinal, status))
    return sorted(out)


def resolved(spark, graphs):
    names = spark.createDataFrame([(g, n) for g, (ns, _) in enumerate(graphs) for n in ns], "db_id int, name string")
    asked = spark.createDataFrame([(g, o, n, i, "a", "b" if c else "a") for g, (_, rs) in enumerate(graphs) for o, n, i, c in rs], "db_id int, old string, new string, ordinal int, old_schema string, new_schema string")
    got = [[] for _ in graphs]
    for r in resolve_renames(names, asked.selectExpr("db_id", "new AS name"), asked).collect():
        got[r.db_id].append((r.old, r.new, r.ordinal, r.rename_status))
    return [sorted(x) for x in got]


def test_like_one_after_the_other(spark):
    rng = random.Random(7)
    graphs = []
    for _ in range(60):
        pool = [f"n{i}" for i in range(rng.randint(2, 8))]
        renames = {(rng.choice(pool), rng.choice(pool), rng.randint(0, 6)): rng.random() < 0.1 for _ in range(rng.randint(1, 14))}
        graphs.append((rng.sample(pool, rng.randint(0, len(pool))), [(*k, c) for k, c in renames.items()]))
    assert resolved(spark, graphs) == [brute(n, r) for n, r in graphs]


def test_long_chains(spark):
    """Whole from the end, stuck from the front; many names in one scope take few rounds."""
    began = time.monotonic()
    n = 20_000
    names = spark.range(n).selectExpr("1 AS db_id", "concat('n', id) AS name")
    for order, want in (("n - id", "applied"), ("id", "dest_exists")):
        asked = spark.range(n).selectExpr("1 AS db_id", "concat('n', id) AS old", "concat('n', id + 1) AS new", f"cast({order.replace('n', str(n), 1)} AS int) AS ordinal")
        got = {r.rename_status: r["count"] for r in resolve_renames(names, asked.selectExpr("db_id", "new AS name"), asked).groupBy("rename_status").count().collect()}
        assert got == ({"applied": n} if want == "applied" else {"dest_exists": n - 1, "applied": 1})
    assert time.monotonic() - began < 120


def test_empty(spark):
    names = spark.createDataFrame([], "db_id int, name string")
    asked = spark.createDataFrame([], "db_id int, old string, new string, ordinal int")
    assert resolve_renames(names, asked.selectExpr("db_id", "new AS name"), asked).count() == 0
