import random

import pytest
from pyspark.sql import functions as F

from covenant.operators import diff, merkle
from covenant.plans import incremental
from covenant.plans.incremental import Group, Join, Select, Source
from covenant.plans.store import CommitConflict, StoredView, VersionedStore
from tests.spent import spent


def told(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_tree_like_diff(spark, tmp_path):
    rng = random.Random(1)
    rows = [(i, rng.choice([None, "a", "b"]), rng.choice([None, 1, 2])) for i in range(3000)] + [(None, "x", 1), (7, "twice", 1)]
    gone = [r for r in rows if r[0] is None or r[0] % 97] + [(5000, "new", 1), (8, None, 9)]
    a, b = (spark.createDataFrame(x, "k int, s string, v int") for x in (rows, gone))
    old = merkle.write_tree(a, ["k"], str(tmp_path / "a"))
    new = merkle.write_tree(b, ["k"], str(tmp_path / "b"), like=old)
    assert old.bits == 8 and merkle.open_tree(spark, str(tmp_path / "b")) == new
    want = diff.keyed_diff(a, b, ["k"]).where("change <> 'same'")
    assert told(merkle.tree_diff(old, new)) == told(want)
    assert told(merkle.tree_surplus(old, new)) == told(diff.result_difference(b, a))
    assert merkle.tree_diff(old, old).count() == 0
    other = merkle.write_tree(a.limit(10), ["k"], str(tmp_path / "c"))
    with pytest.raises(ValueError):
        merkle.tree_diff(old, other)
    empty = merkle.write_tree(a.limit(0), ["k"], str(tmp_path / "d"), like=other)
    assert merkle.tree_diff(other, empty).count() == 10
    assert merkle.tree_diff(empty, merkle.write_tree(a.limit(0), ["k"], str(tmp_path / "e"), like=empty)).count() == 0


def test_tree_shuffles_little(spark, tmp_path):
    """0.1 % of rows changed: under 5 % of what a join of the snapshots shuffles."""
    a = spark.range(200_000).selectExpr("id AS k", "sha2(cast(id AS string), 256) AS s", "id % 7 AS v").repartition(8)
    b = a.withColumn("v", F.expr("CASE WHEN k % 1000 = 3 THEN v + 1 ELSE v END"))
    old = merkle.write_tree(a, ["k"], str(tmp_path / "a"))
    new = merkle.write_tree(b, ["k"], str(tmp_path / "b"), like=old)
    before = spent(spark)[1]
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert merkle.tree_diff(old, new).count() == 200
        tree = spent(spark)[1] - before
        # all columns are asked for, so that none is pruned
        diff.keyed_diff(old.rows(), new.rows(), ["k"]).where("change <> 'same'").write.format("noop").mode("overwrite").save()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    whole = spent(spark)[1] - before - tree
    assert tree < 0.05 * whole, (tree, whole)


VIEW = Group(Join(Select(Source("x"), "v IS NULL OR v <> 3", {"k": "k", "g": "g", "v": "v"}), Source("y"), ("k",)), ("g", "w"), "n", {"total": "v"}, {"low": "v"}, {"high": "v"})


def some(spark, rng, n=60):
    x = [(i, rng.choice([None, 1, 2, 3]), rng.choice(["a", "b", None]), rng.choice([None, 1, 2, 3, 4])) for i in range(n)]
    y = [(k, rng.choice(["p", "q", None])) for k in (1, 1, 2, 3)]
    return x, y


@pytest.mark.parametrize("view", [VIEW, VIEW.of, Select(Source("x"), "v > 1", {"g": "g"})])
def test_follows_like_anew(spark, tmp_path, view):
    rng = random.Random(2)
    frame = lambda x, y: {"x": spark.createDataFrame(x, "id int, k int, g string, v int"), "y": spark.createDataFrame(y, "k int, w string")}
    x, y = some(spark, rng)
    held = StoredView(spark, str(tmp_path / "v"), view)
    held.refresh(frame(x, y))
    for turn in range(3):
        was = frame(x, y)
        x = [r for r in x if rng.random() < 0.7] + [(100 * turn + i, *r[1:]) for i, r in enumerate(some(spark, rng, 15)[0], 1000)]
        y = y if turn == 0 else [r for r in y if rng.random() < 0.8] + [(2, "new")]
        now = frame(x, y)
        held.refresh(now, {t: incremental.signed_change(was[t], now[t]) for t in (("x",) if turn == 0 else ("x", "y"))})
        assert told(held.read()) == told(incremental.shown(view, incremental.state(view, now))), turn
    assert [v.number for v in held.store.versions()] == [1, 2, 3, 4]


def test_base_is_not_read_again(spark, tmp_path):
    spark.range(50_000).selectExpr("id", "id % 10 AS g", "id AS v").write.parquet(str(tmp_path / "base"))
    base = spark.read.parquet(str(tmp_path / "base"))
    view = StoredView(spark, str(tmp_path / "v"), Group(Select(Source("t"), "v >= 0"), ("g",), "n", {"total": "v"}, most={"top": "v"}))
    view.refresh({"t": base})
    delta = spark.createDataFrame([(50_001, 3, 60_000, 1), (5, 5, 5, -1)], "id long, g long, v long, __sign int")
    before = spent(spark)[0]
    view.refresh({"t": incremental.applied(base, delta, ["id"])}, {"t": delta})
    got = {r.g: (r.n, r.total, r.top) for r in view.read().collect()}
    assert got[3] == (5001, sum(range(3, 50_000, 10)) + 60_000, 60_000) and got[5] == (4999, sum(range(5, 50_000, 10)) - 5, 49_995)
    assert spent(spark)[0] - before < 1000


def test_versions(spark, tmp_path):
    store = VersionedStore(spark, str(tmp_path / "s"))
    assert store.versions() == [] and store.last() is None
    with pytest.raises(ValueError):
        store.read()
    store.commit(spark.range(1).withColumn("at", F.lit(1)), "d")
    pinned = store.read(1)
    first = store.commit(spark.range(2), "d", after=1)
    with pytest.raises(CommitConflict):
        store.commit(spark.range(9), "d", after=1)
    (tmp_path / "s" / "manifests" / "v0000000003.json").touch()  # its writer died
    other = VersionedStore(spark.newSession(), str(tmp_path / "s"))
    assert other.last() == first and other.read().count() == 2 and pinned.columns == ["id", "at"] and pinned.count() == 1
    assert other.commit(spark.range(3), "d").number == 4
    assert len(store.vacuum(keep=1)) == 3  # two versions and what lost the commit
    assert store.read().count() == 3 and [v.number for v in store.versions()] == [4]


def test_changed_definition_is_built_anew(spark, tmp_path):
    tables = {"t": spark.range(10).selectExpr("id", "id % 2 AS g")}
    path = str(tmp_path / "v")
    StoredView(spark, path, Group(Source("t"), ("g",))).refresh(tables)
    changed = StoredView(spark, path, Group(Source("t"), ("g",), sums={"s": "id"}))
    nothing = spark.createDataFrame([], "id long, g long, __sign int")
    changed.refresh(tables, {"t": nothing})
    assert told(changed.read()) == [(0, 5, 20), (1, 5, 25)]
