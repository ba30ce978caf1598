"""Registered queries of rules over catalogs: edges of all kinds, order over kinds,
remapping of text, what is ignored or managed, and what a change of a default, a
generated column, a constraint or a view asks for. The catalogs are derived from
`customer`, a table for each row."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from covenant.functions import logic
from covenant.operators import diff, graph
from covenant.queries import FLEET, query, read
from covenant.queries_fleet import fleet
from covenant.sources import snapshot


def tables(spark, sf) -> DataFrame:
    return fleet(spark, sf)["tables"]


# -- edges and order ----------------------------------------------------------------


@query(FLEET + """
SELECT DISTINCT db_id, src, dst FROM (
  SELECT db_id, "table" AS src, 'status' AS dst FROM c WHERE name = 'status'
  UNION ALL SELECT db_id, "table", ref_table FROM r WHERE ref_table IN (SELECT name FROM t WHERE t.db_id = r.db_id)
  UNION ALL SELECT db_id, name, 'seq_' || name FROM t WHERE n % 3 = 0
  UNION ALL SELECT db_id, 'part_' || name, name FROM t WHERE n % 4 = 0
  UNION ALL SELECT db_id, 'view_' || name, name FROM t WHERE n % 5 = 0
  UNION ALL SELECT db_id, 'view_' || name, 'shared' FROM t WHERE n % 10 = 0) WHERE src <> dst""")
def g03_catalog_edges(spark, sf):
    f = fleet(spark, sf)
    t = f["tables"]
    some = lambda name, where="true", schema="schema": t.where(where).select("db_id", F.expr(f"{schema} AS schema"), F.expr(f"{name} AS name"))
    objects = reduce(DataFrame.unionByName, [some("name"), some("'seq_' || name", "n % 3 = 0"), some("'part_' || name", "n % 4 = 0"), some("'view_' || name", "n % 5 = 0"), some("'status'").distinct(), some("'shared'", schema="'public'").distinct()])
    defaults = t.select("db_id", "schema", F.col("name").alias("table"), F.expr("CASE n % 3 WHEN 0 THEN 'nextval(''app.seq_' || name || '''::regclass)' WHEN 1 THEN 'nextval(''gone'')' ELSE '1' END AS default"))
    parents = t.where("n % 4 = 0").selectExpr("db_id", "schema", "'part_' || name AS child", "name AS parent")
    uses = t.where("n % 5 = 0").selectExpr("db_id", "schema", "'view_' || name AS view", "explode(array('app.' || name, CASE WHEN n % 10 = 0 THEN 'shared' ELSE 'missing' END, 'view_' || name)) AS relation")
    return graph.catalog_edges(objects, f["columns"], f["references"], defaults, parents, uses)


@query(FLEET + """, ch AS (
  SELECT db_id, kind, name AS node, action, n AS seq, CASE WHEN n % 9 <> 0 THEN i END AS pos FROM t, (VALUES ('reference', 'drop'), ('reference', 'create'), ('view', 'drop'), ('view', 'create'), ('table', 'alter'), ('table', 'drop'), ('table', 'persist'), ('table', 'comment')) v(kind, action))
SELECT db_id, kind, node, action, CAST(row_number() OVER (PARTITION BY db_id ORDER BY CASE WHEN action = 'comment' THEN 8 WHEN kind = 'reference' THEN CASE action WHEN 'drop' THEN 0 ELSE 5 END WHEN kind = 'view' THEN CASE action WHEN 'drop' THEN 1 ELSE 6 END ELSE CASE action WHEN 'alter' THEN 2 WHEN 'persist' THEN 3 ELSE 4 END END,
  CASE WHEN action = 'drop' THEN -pos ELSE pos END NULLS FIRST, node, seq) AS INTEGER) AS step FROM ch""")
def o02_phased_order(spark, sf):
    t = tables(spark, sf)
    made = F.expr("inline(array(('reference', 'drop'), ('reference', 'create'), ('view', 'drop'), ('view', 'create'), ('table', 'alter'), ('table', 'drop'), ('table', 'persist'), ('table', 'comment'))) AS (kind, action)")
    changes = t.select("db_id", F.col("name").alias("node"), F.col("n").alias("seq"), made)
    position = t.where("n % 9 <> 0").select("db_id", F.col("name").alias("node"), F.col("i").alias("pos"))
    return graph.phased_order(changes, position).select("db_id", "kind", "node", "action", "step")


# -- filters ------------------------------------------------------------------------


@query("""
SELECT c_custkey, 'SELECT a.x, ''app.y'' AS lit FROM core.t' || c_custkey || ' a JOIN "app".u ON core.f(a.x) > myapp.z.app.w' AS definition FROM customer""")
def p04_remap_text(spark, sf):
    """app -> core and core -> app at once, not in literals nor in other names."""
    df = read(spark, sf, "customer").selectExpr("c_custkey", """concat("SELECT a.x, 'app.y' AS lit FROM app.t", c_custkey, ' a JOIN "core".u ON app.f(a.x) > myapp.z.app.w') AS definition""")
    back = snapshot.remap_text(df, {"app": "core", "core": '"app"'}, ["definition"])
    return back


@query(FLEET + """
SELECT db_id, name, max(side = 1) AS in_current, max(side = 2) AS in_desired FROM (SELECT db_id, name, n, 1 AS side FROM t UNION ALL SELECT db_id, name, n, 2 FROM t2) WHERE n % 6 = 0 GROUP BY db_id, name""")
def p05_ignored_report(spark, sf):
    current, desired = (fleet(spark, sf, x)["tables"] for x in (False, True))
    return snapshot.ignored_report(current, desired, current.where("n % 6 = 0"), ["db_id", "name"])


@query(FLEET + """
SELECT db_id, kind, count(*) AS n FROM (
  SELECT db_id, 'table' AS kind FROM t WHERE n % 8 <> 0
  UNION ALL SELECT db_id, 'index' FROM t WHERE n % 4 IN (2, 3)
  UNION ALL SELECT db_id, 'sequence' FROM t WHERE n % 3 <> 0) GROUP BY ALL""")
def p06_managed_only(spark, sf):
    t = tables(spark, sf)
    named = lambda name, kind, where="true": t.where(where).select("db_id", "schema", F.expr(f"{name} AS name"), F.lit(kind).alias("kind"))
    objects = named("name", "table").unionByName(named("'ix_' || n", "index")).unionByName(named("'seq_' || n", "sequence"))
    constraints = t.selectExpr("db_id", "schema", "'ix_' || n AS name", "element_at(array('p', 'x', 'c', 'f'), cast(n % 4 + 1 AS int)) AS type")
    kept = snapshot.managed_only(objects, constraints, named("'seq_' || n", "sequence", "n % 3 = 0"), named("name", "table", "n % 8 = 0"))
    return kept.groupBy("db_id", "kind").agg(F.count("*").alias("n"))


# -- what a change asks for ------------------------------------------------------------


def sides(spark, sf, old: str, new: str, *more: str) -> tuple[DataFrame, DataFrame]:
    df = read(spark, sf, "customer")
    return tuple(df.selectExpr("c_custkey", *(x.format(v) for x in (pair, *more))) for v, pair in ((0, old), (1, new)))


@query("SELECT c_custkey, CASE c_custkey % 6 WHEN 0 THEN 'same' WHEN 1 THEN 'set' WHEN 2 THEN 'drop' WHEN 3 THEN 'change' WHEN 4 THEN 'same' ELSE 'change' END AS action FROM customer")
def e03_default_changes(spark, sf):
    """Casts do not count, unless within a literal."""
    old = """element_at(array("'a'::character varying(40)", NULL, '0', '1', NULL, "'x::text'"), cast(c_custkey % 6 + 1 AS int)) AS default"""
    new = """element_at(array("'a'::text", "now()", NULL, '2', NULL, "'x'"), cast(c_custkey % 6 + 1 AS int)) AS default"""
    return diff.default_changes(*sides(spark, sf, old, new), ["c_custkey"])


@query("SELECT c_custkey, CASE WHEN c_custkey % 4 IN (0, 3) THEN 'same' ELSE 'rejected' END AS verdict FROM customer")
def e07_generated_changes(spark, sf):
    old, new = (f"element_at(array({x}), cast(c_custkey % 4 + 1 AS int)) AS generated" for x in ("'a + b', 'a + b', NULL, NULL", "'a + b', 'a - b', 'a + b', NULL"))
    return diff.generated_changes(*sides(spark, sf, old, new), ["c_custkey"])


@query("SELECT c_custkey, CASE c_custkey % 6 WHEN 0 THEN 'same' WHEN 1 THEN 'validate' WHEN 2 THEN 'recreate' WHEN 3 THEN 'recreate' WHEN 4 THEN 'create' ELSE 'drop' END AS action FROM customer")
def c07_validation_changes(spark, sf):
    current, desired = sides(spark, sf, "c_custkey % 6 <> 1 AS validated", "c_custkey % 6 <> 2 AS validated", "CASE WHEN c_custkey % 6 = 3 THEN 'x > {}' ELSE 'x > 0' END AS definition")
    return diff.validation_changes(current.where("c_custkey % 6 <> 4"), desired.where("c_custkey % 6 <> 5"), ["c_custkey"])


@query("SELECT c_custkey, CASE c_custkey % 7 WHEN 0 THEN 'same' WHEN 1 THEN 'replace' WHEN 2 THEN 'recreate' WHEN 3 THEN 'recreate' WHEN 4 THEN 'recreate' WHEN 5 THEN 'create' ELSE 'drop' END AS action FROM customer")
def v04_view_actions(spark, sf):
    """Same, other text, other columns, plain to stored, stored with other text, new, gone."""
    k = "c_custkey % 7"
    current, desired = sides(spark, sf, f"{k} = 4 AS stored", f"{k} IN (3, 4) AS stored", f"CASE WHEN {k} IN (1, 2, 4) THEN 'SELECT {{}}' ELSE 'SELECT 0' END AS definition")
    replaceable = read(spark, sf, "customer").selectExpr("c_custkey", f"{k} <> 2 AS replaceable")
    return diff.view_actions(current.where(f"{k} <> 5"), desired.where(f"{k} <> 6"), replaceable, ["c_custkey"], allow_drops=True)


@query("SELECT c_custkey, c_custkey % 6 IN (0, 1, 3) AS equal FROM customer")
def o06_collation_equality(spark, sf):
    pick = lambda *names: F.element_at(F.array(*map(F.lit, names)), (F.col("c_custkey") % 6 + 1).cast("int"))
    a, b = pick("C", "pg_catalog.C", "s.C", None, "de", None), pick('"C"', "C", "t.C", None, "fr", "de")
    return read(spark, sf, "customer").select("c_custkey", logic.collation_equal(a, b).alias("equal"))


@query("""
SELECT event_id, (event_id % 4 > 0) AS has, CASE WHEN event_id % 4 > 1 THEN event_id + 1 END AS second, event_id % 4 AS n, (event_id % 4 + event_id % 2) // 2 AS odd FROM events""")
def f05_json_arrays(spark, sf):
    """An array is made, told as JSON, and asked for: exists, an element, its
    length, elements that meet a predicate."""
    made = F.expr("to_json(named_struct('a', transform(filter(sequence(0, 3), i -> i < event_id % 4), i -> event_id + i)))")
    df = read(spark, sf, "events").select("event_id", made.alias("doc"))
    items = F.from_json(F.get_json_object("doc", "$.a"), "array<bigint>")
    return df.select("event_id", F.get_json_object("doc", "$.a[0]").isNotNull().alias("has"), F.get_json_object("doc", "$.a[1]").cast("bigint").alias("second"), F.size(items).cast("bigint").alias("n"), F.size(F.filter(items, lambda x: x % 2 == 1)).cast("bigint").alias("odd"))
