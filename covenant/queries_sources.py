"""Registered queries over catalogs that exist: the given tables' own Parquet
footers, against contracts declared for them in JSON files."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from covenant.functions import lineage
from covenant.model import ColumnSpec, KeySpec, PolicySpec, ReferenceSpec, Rule, TableContract
from covenant.operators import audit, diff, graph
from covenant.queries import query, read
from covenant.shared import shared_dir
from covenant.sources import catalog, snapshot

#: The given tables as declared: columns, key, references.
TABLES: dict[str, tuple[str, tuple[str, ...], tuple[tuple[str, str, str], ...]]] = {
    "region": ("r_regionkey int, r_name string", ("r_regionkey",), ()),
    "nation": ("n_nationkey int, n_name string, n_regionkey int", ("n_nationkey",), (("n_regionkey", "region", "r_regionkey"),)),
    "customer": ("c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string", ("c_custkey",), (("c_nationkey", "nation", "n_nationkey"),)),
    "supplier": ("s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double", ("s_suppkey",), (("s_nationkey", "nation", "n_nationkey"),)),
    "part": ("p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double", ("p_partkey",), ()),
    "orders": ("o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string", ("o_orderkey",), (("o_custkey", "customer", "c_custkey"),)),
    "lineitem": (
        "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz",
        ("l_orderkey", "l_linenumber"),
        (("l_orderkey", "orders", "o_orderkey"), ("l_partkey", "part", "p_partkey"), ("l_suppkey", "supplier", "s_suppkey")),
    ),
    "events": ("event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string", ("event_id",), (("user_id", "customer", "c_custkey"),)),
    "documents": ("doc_id bigint, text string, lang string, source string, n_chars bigint", ("doc_id",), ()),
    "embeddings": ("vec_id bigint, embedding array<float>, label int", ("vec_id",), ()),
    "pages": ("page_id bigint, url string, html string", ("page_id",), ()),
    "benchmark": ("item_id bigint, text string", ("item_id",), ()),
    "labels": ("doc_id bigint, quality int, toxic int", ("doc_id",), (("doc_id", "documents", "doc_id"),)),
    "conversations": ("conv_id bigint, turn bigint, role string, text string", ("conv_id", "turn"), ()),
}


def contracts(changed: bool = False) -> dict[str, TableContract]:
    """Contracts of the given tables; ``changed``: as someone wants them to become,
    with a column more, one less, another type and a table that is not there."""
    out = {}
    for name, (listed, key, references) in TABLES.items():
        columns = [ColumnSpec(*c.split(" ")) for c in listed.split(", ")]
        if changed and name == "customer":
            columns.append(ColumnSpec("c_email", "string"))
        if changed and name == "part":
            columns = [c for c in columns if c.name != "p_brand"]
        if changed and name == "orders":
            columns = [ColumnSpec(c.name, "decimal(12,2)", True) if c.name == "o_totalprice" else c for c in columns]
        refs = tuple(ReferenceSpec(f"{name}_{column}_fkey", (column,), parent, (parent_column,)) for column, parent, parent_column in references)
        out[name] = TableContract(name, tuple(columns), (KeySpec(f"{name}_pkey", key, primary=True),), (Rule("price_positive", "o_totalprice > 0"),) if name == "orders" else (), refs)
    if changed:
        out["returns"] = TableContract("returns", (ColumnSpec("r_orderkey", "bigint", True),), references=(ReferenceSpec("returns_order_fkey", ("r_orderkey",), "orders", ("o_orderkey",)),))
    return out


def declared(spark: SparkSession, changed: bool = False) -> DataFrame:
    """The contracts, written as JSON files and loaded: one file a table."""
    path = f"{shared_dir(spark)}/contracts-{uuid.uuid4().hex}"
    rows = [(n, json.dumps({"name": n, "kind": "table", "definition": c.to_json()})) for n, c in contracts(changed).items()]
    spark.createDataFrame(rows, "table string, value string").repartition(len(rows), "table").select("value").write.text(path)
    return snapshot.load_contracts(spark, [path])


def scan(spark: SparkSession, sf: str) -> DataFrame:
    return catalog.footers(spark, {"star": sf}, tables=list(TABLES))


#: Types of DuckDB as Spark names them, and what DuckDB says of the given tables.
AS_SPARK = "CASE column_type WHEN 'INTEGER' THEN 'int' WHEN 'VARCHAR' THEN 'string' WHEN 'TIMESTAMP' THEN 'timestamp_ntz' WHEN 'FLOAT[]' THEN 'array<float>' ELSE lower(column_type) END"
DESCRIBED = "c AS (" + " UNION ALL ".join(f"SELECT '{t}' AS \"table\", CAST(row_number() OVER () AS INTEGER) AS ordinal, column_name AS name, {AS_SPARK} AS type_name, \"null\" = 'NO' AS not_null FROM (DESCRIBE {t})" for t in TABLES) + ")"
COUNTED = " UNION ALL ".join(f"SELECT '{t}' AS \"table\", '{c.split(' ')[0]}' AS name, count(*) AS rows, count(*) - count({c.split(' ')[0]}) AS nulls FROM {t}" for t, (listed, _, _) in TABLES.items() for c in listed.split(", ") if "array" not in c)


@query(f"WITH {DESCRIBED} SELECT * FROM c")
def s01_catalog_columns(spark, sf):
    return catalog.columns(scan(spark, sf)).select("table", "ordinal", "name", "type_name", "not_null")


@query(COUNTED)
def s01_footer_statistics(spark, sf):
    """Rows and nulls of every column without reading one: what a not-null audit
    asks of data whose writer kept statistics."""
    return catalog.statistics(scan(spark, sf)).where("name <> 'embedding'").select("table", "name", "rows", "nulls")


@query(f"""
WITH {DESCRIBED}, w AS (
  SELECT "table", name, CASE WHEN name = 'o_totalprice' THEN 'decimal(12,2)' ELSE type_name END AS type_name, not_null OR name = 'o_totalprice' AS not_null FROM c WHERE name <> 'p_brand'
  UNION ALL VALUES ('customer', 'c_email', 'string', false), ('returns', 'r_orderkey', 'bigint', true))
SELECT coalesce(w."table", c."table") AS "table", coalesce(w.name, c.name) AS name,
  CASE WHEN c.name IS NULL THEN 'create' WHEN w.name IS NULL THEN 'drop' WHEN c.type_name = w.type_name AND c.not_null = w.not_null THEN 'same' ELSE 'alter' END AS change,
  c.type_name AS old_type_name, w.type_name AS new_type_name
FROM c FULL JOIN w ON c."table" = w."table" AND c.name = w.name""")
def j01_declared_drift(spark, sf):
    """What it takes to bring the tables that are there to the declared contracts."""
    pick = lambda df: df.select("table", "name", "type_name", "not_null")
    wanted = catalog.declared_rows(declared(spark, True), "columns")
    return diff.keyed_diff(pick(catalog.columns(scan(spark, sf))), pick(wanted), ["table", "name"]).select("table", "name", "change", "old_type_name", "new_type_name")


@query("""SELECT "table", name, attribute, old, new FROM (VALUES ('orders', 'o_totalprice', 'type_name', 'double', 'decimal(12,2)'), ('orders', 'o_totalprice', 'not_null', 'false', 'true')) v("table", name, attribute, old, new)
WHERE EXISTS (SELECT 1 FROM (DESCRIBE orders) WHERE column_name = 'o_totalprice' AND column_type = 'DOUBLE')""")
def j02_declared_attributes(spark, sf):
    pick = lambda df: df.select("table", "name", "type_name", "not_null")
    found = diff.keyed_diff(pick(catalog.columns(scan(spark, sf))), pick(catalog.declared_rows(declared(spark, True), "columns")), ["table", "name"])
    return diff.attribute_diff(found, ["table", "name"])


#: Declared references, and those of them whose both ends are there.
REFERENCES = ", ".join(f"('{t}', '{parent}')" for t, (_, _, refs) in TABLES.items() for _, parent, _ in refs)


@query(f"WITH {DESCRIBED} SELECT DISTINCT src, dst FROM (VALUES {REFERENCES}, ('returns', 'orders')) v(src, dst) WHERE src IN (SELECT \"table\" FROM c) AND dst IN (SELECT \"table\" FROM c)")
def g03_declared_edges(spark, sf):
    """Dependencies among tables that are there: a reference of a table that is
    only declared gives none."""
    found = scan(spark, sf)
    there = catalog.tables(found).select("db_id", "schema", "name")
    references = catalog.declared_rows(declared(spark, True), "references").select(F.lit("star").alias("db_id"), F.lit("public").alias("schema"), "table", "ref_table")
    edges = graph.reference_edges(catalog.columns(found), references, there)
    return edges.join(there.select("db_id", F.col("name").alias("src")), ["db_id", "src"], "left_semi").select("src", "dst")


@query(f"WITH {DESCRIBED} SELECT \"table\", 'same' AS change, count(*) AS columns FROM c GROUP BY ALL")
def s01_dump_round_trip(spark, sf):
    """Scanned tables dumped as contracts, loaded again, and held against themselves."""
    found = scan(spark, sf)
    path = f"{shared_dir(spark)}/dump-{uuid.uuid4().hex}"
    catalog.dump(found).select("name", F.lit("table").alias("kind"), "definition").write.json(path)
    pick = lambda df: df.select("table", "name", "ordinal", "type_name", "not_null")
    loaded = catalog.declared_rows(snapshot.load_contracts(spark, [path]), "columns")
    return diff.keyed_diff(pick(catalog.columns(found)), pick(loaded), ["table", "name"]).groupBy("table", "change").agg(F.count("*").alias("columns"))


@query("""
WITH o AS (SELECT o_orderkey, CASE WHEN o_orderkey % 71 = 0 THEN -o_custkey ELSE o_custkey END AS o_custkey, CASE WHEN o_orderkey % 83 = 0 THEN -o_totalprice ELSE o_totalprice END AS o_totalprice FROM orders)
SELECT 'orders_pkey' AS rule, count(*) AS violations, min(CAST(o_orderkey AS VARCHAR)) AS sample FROM (SELECT o_orderkey FROM o GROUP BY o_orderkey HAVING count(*) > 1)
UNION ALL SELECT 'orders_o_custkey_fkey', count(*), min(CAST(o_orderkey AS VARCHAR)) FROM o WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)
UNION ALL SELECT 'price_positive', count(*), min(CAST(o_orderkey AS VARCHAR)) FROM o WHERE o_totalprice <= 0
UNION ALL SELECT 'customer_pkey', count(*), NULL FROM (SELECT c_custkey FROM customer GROUP BY 1 HAVING count(*) > 1)
UNION ALL SELECT 'customer_c_nationkey_fkey', count(*), NULL FROM customer WHERE c_nationkey NOT IN (SELECT n_nationkey FROM nation)""")
def s03_loaded_contracts(spark, sf):
    """Contracts come from files, and the tables they name are audited by them."""
    loaded = snapshot.table_contracts(declared(spark), ("orders", "customer"))
    faults = {"o_custkey": F.expr("CASE WHEN o_orderkey % 71 = 0 THEN -o_custkey ELSE o_custkey END"), "o_totalprice": F.expr("CASE WHEN o_orderkey % 83 = 0 THEN -o_totalprice ELSE o_totalprice END")}
    orders, customer = read(spark, sf, "orders").withColumns(faults), read(spark, sf, "customer")
    parents = {"customer": customer, "nation": read(spark, sf, "nation")}
    return audit.audit(orders, loaded["orders"], "o_orderkey", parents).unionByName(audit.audit(customer, loaded["customer"], "c_custkey", parents))


#: Texts that name columns, some of which are not there; literals and lambda
#: variables only look like columns.
TEXTS = (
    TableContract("orders", (ColumnSpec("o_note", "string", default="concat('o_gone', cast(o_orderkey AS string))"), ColumnSpec("o_net", "double", generated="o_totalprice - o_rebate")), checks=(Rule("known", "o_orderstatus IN ('o_lost', 'F') OR exists(array(1), o_tax -> o_tax > 0)"),)),
    TableContract("lineitem", (), (KeySpec("open", ("l_orderkey",), where="l_linestatus = 'O' AND l_deleted IS NULL"),), (Rule("parts", "l_partkey > 0 AND `l_weight` < 3"),), policies=(PolicySpec("own", using="l_suppkey = l_owner"),)),
)


@query(f"""WITH {DESCRIBED} SELECT * FROM (VALUES ('orders', 'generated', 'o_net', 'o_rebate'), ('lineitem', 'key', 'open', 'l_deleted'), ('lineitem', 'check', 'parts', 'l_weight'), ('lineitem', 'policy', 'own', 'l_owner')) v("table", kind, name, "column")
WHERE "column" NOT IN (SELECT name FROM c)""")
def c15_dangling_in_texts(spark, sf):
    """Columns that checks, defaults, generated values, keys and policies name, and
    the scanned table lacks."""
    there = catalog.columns(scan(spark, sf)).select("table", F.col("name").alias("column"))
    return lineage.used_columns(spark, TEXTS).join(there, ["table", "column"], "left_anti").select("table", "kind", "name", "column")
