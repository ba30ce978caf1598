import pytest
from pyspark.sql import functions as F

from covenant.functions.logic import glob
from covenant.model import ColumnSpec, DropPolicy, KeySpec, PolicySpec, ReferenceSpec, Rule, TableContract
from covenant.operators import audit, diff, evolve, graph, policy
from covenant.plans import views
from covenant.queries_fleet import fleet
from covenant.sources import snapshot
from covenant.streaming import gate


def test_contract_round_trip():
    c = TableContract("t", (ColumnSpec("a", "int", default="1"),), (KeySpec("k", ("a",)),), (Rule("r", "a > 0"),), (ReferenceSpec("f", ("a",), "p", ("b",)),), (PolicySpec("p", roles=("x",)),))
    assert TableContract.from_json(c.to_json()) == c


def test_rename_rules():
    assert [s for *_, s in evolve.rename_status(["a", "b"], [("b", "c"), ("a", "b")])] == ["applied", "applied"]
    assert [s for *_, s in evolve.rename_status(["a", "b"], [("a", "b"), ("b", "c")])] == ["dest_exists", "applied"]
    assert [s for *_, s in evolve.rename_status(["a", "x"], [("a", "b"), ("b", "c"), ("q", "x"), ("z", "y"), ("x", "x")])] == ["applied", "missing_source", "noop", "missing_source", "noop"]


def test_glob():
    assert glob("a*[b-d]?") == "(?s)^a.*[b-d].$" and glob("a.b") == "(?s)^a\\.b$"
    with pytest.raises(ValueError):
        glob("a[b")


def test_evolution_is_idempotent_and_denies_drops(spark):
    df = spark.createDataFrame([(1, 2.5, "x"), (2, None, None)], "a int, b double, c string")
    want = TableContract("t", (ColumnSpec("a2", "bigint", renamed_from="a"), ColumnSpec("b", "int"), ColumnSpec("d", "string", not_null=True, default="'n'")))
    out, changes = evolve.evolve(df, want)
    assert out.columns == ["a2", "b", "d", "c"] and [c.action for c in changes] == ["rename", "retype", "retype", "add", "skipped"]
    assert [tuple(r) for r in out.orderBy("a2").collect()] == [(1, 2, "n", "x"), (2, None, "n", None)]
    again, later = evolve.evolve(out, want)
    assert [c.action for c in later] == ["skipped"] and diff.result_difference(out, again).count() == 0
    assert evolve.evolve(df, want, DropPolicy(frozenset({"column"})))[0].columns == ["a2", "b", "d"]
    with pytest.raises(ValueError):
        evolve.add_column(df, "e", "int", not_null=True)


def test_identity(spark):
    df = spark.range(50).withColumn("k", F.expr("(id * 37) % 50"))
    got = evolve.assign_identity(df, ["k"], "n", start=-1, increment=-1)
    assert all(r.n == -1 - r.k for r in got.collect())
    with pytest.raises(Exception, match="exhausted"):
        evolve.assign_identity(df, ["k"], "n", most=10).collect()


def test_empty_tables(spark):
    none = spark.createDataFrame([], "a int, b string")
    assert audit.primary_key(none, ["a"]).count() == 0 and audit.check(none, [Rule("r", "a > 0")]).count() == 0
    assert diff.keyed_diff(none, none, ["a"]).count() == 0 and evolve.assign_identity(none, ["a"], "n").count() == 0
    assert graph.levels(spark.createDataFrame([], "db_id int, node string"), spark.createDataFrame([], "db_id int, src string, dst string")).count() == 0


def test_policies(spark):
    df = spark.range(10)
    assert df.where(policy.read_filter([], "x")).count() == 0 and df.where(policy.read_filter([], "x", enabled=False)).count() == 10
    assert df.where(policy.read_filter([PolicySpec("p", using="id < 3")], "o", owner="o")).count() == 10
    assert df.where(policy.read_filter([PolicySpec("p", using="id < 3")], "o", owner="o", forced=True)).count() == 3
    good, bad = policy.write_check(df, [PolicySpec("p", "all", using="id < 3"), PolicySpec("q", "insert", using="true", check="id > 8")], "x", "insert")
    assert good.count() == 4 and bad.count() == 6


def test_snapshot_round_trip(spark, tmp_path):
    f = {k: v for k, v in fleet(spark, "/root/testdata/sf0.001").items() if k != "enums"}
    snapshot.write_snapshot(f, str(tmp_path))
    for k, v in f.items():
        back = snapshot.read_snapshot(spark, str(tmp_path), k).select(v.columns).withColumn("db_id", F.col("db_id").cast("bigint"))
        assert diff.result_difference(v, back).count() == 0
    (tmp_path / "c.json").write_text('{"name": "a", "kind": "table"}\n{"name": "a", "kind": "table"}')
    with pytest.raises(ValueError):
        snapshot.load_contracts(spark, [str(tmp_path / "c.json")])


def test_views(spark):
    assert views.view_order({"b": "select * from a", "a": "select 1", "c": "select * from b, a"}) == ["a", "b", "c"]
    with pytest.raises(ValueError):
        views.view_order({"a": "select * from b", "b": "select * from a"})


def test_levels_end_or_raise(spark):
    nodes = spark.createDataFrame([(1, f"n{i}") for i in range(4)], "db_id int, node string")
    edges = spark.createDataFrame([(1, f"n{i}", f"n{i + 1}") for i in range(3)], "db_id int, src string, dst string")
    assert {r.node: r.level for r in graph.levels(nodes, edges, max_rounds=4).collect()} == {"n3": 0, "n2": 1, "n1": 2, "n0": 3}
    with pytest.raises(RuntimeError):
        graph.levels(nodes, edges, max_rounds=2)


def test_a_rename_to_itself_frees_nothing(spark):
    current = spark.createDataFrame([(1, "a"), (1, "b")], "db_id int, name string")
    asked = spark.createDataFrame([(1, "b", "b", 1), (1, "a", "b", 2), (1, "a", "c", 3), (1, "b", "c", 4), (1, "c", "d", 5)], "db_id int, old string, new string, ordinal int")
    told = diff.resolve_renames(current, asked.select("db_id", F.col("new").alias("name")), asked).orderBy("ordinal").collect()
    assert [r.rename_status for r in told] == ["noop", "dest_exists", "applied", "dest_exists", "applied"]
    crossed = asked.where("ordinal = 3").withColumn("old_schema", F.lit("x")).withColumn("new_schema", F.lit("y"))
    assert diff.resolve_renames(current, crossed.select("db_id", F.col("new").alias("name")), crossed).first().rename_status == "cross_schema"


def test_delete_actions(spark):
    gone, child = spark.createDataFrame([(1,)], "k int"), spark.createDataFrame([(1,), (2,), (None,)], "f int")
    got = graph.propagate_delete(gone, "k", child, "f", "set default", "2")
    assert sorted(r.f or 0 for r in got["kept"].collect()) == [0, 2, 2] and got["violations"].count() == 0
    assert graph.propagate_delete(gone, "k", child, "f", "set default", "1")["violations"].count() == 1
    with pytest.raises(ValueError):
        graph.propagate_delete(gone, "k", child, "f", "ignore")


def test_decimals_round(spark):
    df = spark.sql("SELECT cast(x AS decimal(5,1)) AS d FROM VALUES (2.7), (2.5), (-2.5), (-2.4) t(x)")
    assert [r[0] for r in df.select(evolve.cast_value(F.col("d"), "decimal(5,1)", "int")).collect()] == [3, 3, -3, -2]


def test_value_is_a_word(spark):
    assert audit.of_value("VALUE > 0 AND 'VALUE' <> `VALUE` AND VALUES = value", "c") == "`c` > 0 AND 'VALUE' <> `VALUE` AND VALUES = `c`"


def test_globs(spark):
    names = spark.createDataFrame([("a*b",), ("axb",), ("!b",), ("cb",)], "name string")
    kept = lambda p: sorted(r[0] for r in snapshot.filter_names(names, [p]).collect())
    assert kept("a\\*b") == ["a*b"] and kept("a*b") == ["a*b", "axb"] and kept("[!c]b") == ["!b", "cb"] and kept("[^c]b") == ["!b"]


def test_a_batch_that_runs_again_is_not_doubled(spark, tmp_path):
    rows = spark.range(5).withColumn("ok", F.col("id") > 1)
    for _ in range(2):
        snapshot.write_gate(rows, [Rule("r", "ok")], f"{tmp_path}/passed/batch=0", f"{tmp_path}/aside/batch=0", "overwrite", hidden=("ok",))
    kept = spark.read.parquet(f"{tmp_path}/passed")
    assert kept.count() == 3 and "ok" not in kept.columns


def test_a_stream_without_rows(spark, tmp_path):
    spark.range(0).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("id long").parquet(f"{tmp_path}/in")
    kept, aside = gate.gate_stream(stream, [Rule("r", "id > 0")])
    assert kept.count() == 0 and aside.count() == 0 and kept.columns == ["id"] and aside.columns == ["id", "_violations"]


def test_deep_levels_end(spark):
    nodes = spark.createDataFrame([(1, f"n{i}") for i in range(6)], "db_id int, node string")
    edges = spark.createDataFrame([(1, f"n{i}", f"n{i + 1}") for i in range(5)], "db_id int, src string, dst string")
    assert {r.node: r.level for r in graph.levels(nodes, edges).collect()} == {f"n{i}": 5 - i for i in range(6)}


def test_rollout_states(spark):
    shape = "k int, v int, step string"
    old = spark.createDataFrame([(1, None, "x"), (1, 2, "x"), (2, None, "x"), (None, None, "x")], shape)
    new = spark.createDataFrame([(1, None, "y"), (1, None, "y"), (3, None, "y"), (2, 5, "y")], shape)
    told = {(r.k, r.step[0]): tuple(r)[2:] for r in evolve.rollout_states(old, new, "v", "CASE WHEN k = 2 THEN NULL ELSE 0 END", ["k"]).collect()}
    assert len(told) == 4 * 6
    assert [told[1, s] for s in "123456"] == [(1, 0, "none", False), (1, 2, "not valid", False), (0, 2, "not valid", False), (0, 2, "valid", False), (0, 2, "valid", True), (0, 2, "none", True)]
    # a default that is null leaves the check as it is, and the column is not declared
    assert [told[2, s] for s in "3456"] == [(1, 0, "not valid", False)] * 4
    assert told[3, "2"] == (0, 1, "not valid", False) and told[None, "6"] == (0, 0, "none", True)
    whole = {r.step[0]: tuple(r)[1:] for r in evolve.rollout_states(old.limit(0), new.limit(0), "v", "0").collect()}
    assert whole["1"] == (0, 0, "none", False) and whole["6"] == (0, 0, "none", True)
    assert evolve.rollout_states(old.limit(0), new.limit(0), "v", "0", ["k"]).count() == 0


def test_dangling_columns_sends_no_catalog_whole(spark):
    """Rows that come out of arrays are more than Spark's estimate of them."""
    columns = spark.range(100).selectExpr("id AS db_id", "'s' AS schema", "'t' AS table", "explode(array('a', 'b', 'c')) AS name")
    asked = spark.range(100).selectExpr("id AS db_id", "'s' AS schema", "'t' AS table", "'o' AS name", "array('a', if(id % 10 = 0, 'x', 'b')) AS columns")
    found = audit.dangling_columns(asked, columns)
    assert sorted((r.db_id, r.column) for r in found.collect()) == [(i, "x") for i in range(0, 100, 10)]
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()


def test_snapshot_has_few_files(spark, tmp_path):
    """As many files as ranges, however many databases, in their order; an empty kind too."""
    df = spark.range(400).selectExpr("id AS db_id", "'t' || id AS name", "array(map('a', id)) AS more")
    snapshot.write_snapshot({"tables": df, "none": df.limit(0)}, str(tmp_path))
    assert 0 < len(list(tmp_path.glob("tables/**/*.parquet"))) <= int(spark.conf.get("spark.sql.shuffle.partitions"))
    back = snapshot.read_snapshot(spark, str(tmp_path), "tables")
    assert back.dtypes == df.dtypes and sorted(back.collect()) == sorted(df.collect())
    assert back.where("db_id = 17").count() == 1 and snapshot.read_snapshot(spark, str(tmp_path), "none").count() == 0
