import json

import pytest
from pyspark.sql import functions as F

from covenant.model import ColumnSpec, KeySpec, ReferenceSpec, TableContract
from covenant.operators import audit
from covenant.sources import catalog, snapshot


@pytest.fixture
def folders(spark, tmp_path):
    """Two databases; a table of several files, one that files do not agree on."""
    one, two = tmp_path / "one", tmp_path / "two"
    spark.range(100).selectExpr("id", "CASE WHEN id % 10 = 0 THEN NULL ELSE id END AS v", "array(id) AS list").repartition(4).write.parquet(str(one / "many"))
    spark.range(5).selectExpr("id", "cast(id AS decimal(12,2)) AS price", "current_timestamp() AS at").coalesce(1).write.parquet(str(two / "prices.parquet"))
    spark.range(5).selectExpr("cast(id AS int) AS id").coalesce(1).write.parquet(str(two / "mixed" / "p=1"))
    spark.range(5).selectExpr("id", "'x' AS more").coalesce(1).write.parquet(str(two / "mixed" / "p=2"))
    (one / "_hidden").mkdir()
    (one / "note.txt").write_text("not a table")
    return {"one": str(one), "two": str(two)}


def test_footers(spark, folders):
    found = catalog.footers(spark, folders, files=2).cache()
    tables = {(r.db_id, r.name): (r.files, r.rows) for r in catalog.tables(found).collect()}
    assert tables == {("one", "many"): (4, 100), ("two", "prices"): (1, 5), ("two", "mixed"): (2, 10)}
    columns = {(r.table, r.name): (r.ordinal, r.type_name) for r in catalog.columns(found).collect()}
    assert columns == {("many", "id"): (1, "bigint"), ("many", "v"): (2, "bigint"), ("many", "list"): (3, "array<bigint>"), ("prices", "id"): (1, "bigint"), ("prices", "price"): (2, "decimal(12,2)"), ("prices", "at"): (3, "timestamp"), ("mixed", "id"): (1, "bigint/int"), ("mixed", "more"): (2, "string")}
    nulls = {(r.table, r.name): (r.rows, r.nulls) for r in catalog.statistics(found).collect()}
    assert nulls[("many", "v")] == (100, 10) and nulls[("many", "list")] == (100, None) and nulls[("mixed", "more")] == (10, 5)
    assert {(r.table, r.name, tuple(r.types), r.files) for r in catalog.schema_conflicts(found).collect()} == {("mixed", "id", ("bigint", "int"), 2), ("mixed", "more", ("string",), 1)}
    lows = {(r.low, r.high) for r in found.where("table = 'prices' AND name = 'id'").collect()}
    assert lows == {("0", "4")}


def test_partitions_and_pushed_names(spark, folders):
    reader = catalog.PushedReader(folders, "public", 2)
    assert len(reader.partitions()) == 4
    rest = list(reader.pushFilters([catalog.EqualTo(("db_id",), "two"), catalog.In(("table",), ("mixed", "many")), catalog.EqualTo(("name",), "id")]))
    assert [f.attribute for f in rest] == [("name",)] and [p.table for p in reader.partitions()] == ["mixed"]
    assert [p.table for p in catalog.FooterReader(folders, "public", 2, ["many"]).partitions()] == ["many", "many"]
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        found = catalog.footers(spark, folders, files=2).where("table = 'many' AND name = 'id'")
        assert found.count() == 4 and found.rdd.getNumPartitions() == 2
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def test_empty_folder(spark, tmp_path):
    assert catalog.columns(catalog.footers(spark, {"none": str(tmp_path)})).count() == 0


CONTRACT = TableContract(
    "orders", (ColumnSpec("id", "bigint", True), ColumnSpec("customer", "bigint", default="0")), (KeySpec("pk", ("id",), primary=True), KeySpec("u", ("customer", "id"))),
    references=(ReferenceSpec("fk", ("customer",), "customers", ("id",), "cascade"),),
)


def test_contract_files(spark, tmp_path):
    (tmp_path / "c.json").write_text(json.dumps({"name": "orders", "kind": "table", "definition": CONTRACT.to_json()}) + "\n" + json.dumps({"name": "note", "kind": "view", "definition": "SELECT 1"}))
    loaded = snapshot.load_contracts(spark, [str(tmp_path / "c.json")])
    assert snapshot.table_contracts(loaded, ["orders"]) == {"orders": CONTRACT}
    with pytest.raises(ValueError, match="note"):
        snapshot.table_contracts(loaded, ["orders", "note"])
    rows = {kind: [tuple(r) for r in catalog.declared_rows(loaded, kind).collect()] for kind in ("columns", "keys", "references")}
    assert rows["keys"] == [("orders", "pk", "p", ["id"]), ("orders", "u", "u", ["customer", "id"])]
    assert rows["references"] == [("orders", "fk", ["customer"], "customers", ["id"], "cascade")]
    assert rows["columns"][1][:5] == ("orders", 2, "customer", "bigint", False) and rows["columns"][1][5] == "0"


def test_spark_catalog(spark):
    spark.sql("CREATE DATABASE IF NOT EXISTS kept")
    try:
        spark.range(3).selectExpr("id", "id AS customer").write.mode("overwrite").saveAsTable("kept.orders")
        spark.range(3).createOrReplaceTempView("passing")
        catalog.declare(spark, "kept.orders", CONTRACT)
        found = catalog.spark_catalog(spark, ["kept"])
        assert [tuple(r) for r in found["tables"].collect()] == [("kept", "public", "orders")]
        assert {(r.name, r.type_name) for r in found["columns"].collect()} == {("id", "bigint"), ("customer", "bigint")}
        assert [(r.db_id, r.table, r.name) for r in found["references"].collect()] == [("kept", "orders", "fk")]
        assert audit.dangling_columns(found["references"], found["columns"]).count() == 0
        held = TableContract.from_json(found["contracts"].first().definition)
        assert held == CONTRACT
    finally:
        spark.sql("DROP DATABASE kept CASCADE")


def test_contract_of(spark):
    df = spark.range(1).select("id", F.lit("x").alias("name"))
    assert [(c.name, c.type, c.not_null) for c in catalog.contract_of("t", df).columns] == [("id", "bigint", True), ("name", "string", True)]
