"""Registered queries of rules that need more than one step: rename chains, whole
contracts, reports over all kinds, namespaces, and what deletes and types do."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from covenant.functions import logic
from covenant.model import ColumnSpec, DomainSpec, ExclusionSpec, Rule, TableContract
from covenant.operators import audit, diff, evolve, graph, partition
from covenant.plans import views
from covenant.queries import FLEET, LABELS, LEGACY, query, read
from covenant.queries_fleet import fleet
from covenant.shared import shared_dir
from covenant.sources import snapshot

# -- renames ----------------------------------------------------------------------

#: Of each ten tables three are renamed in a chain, forwards or backwards.
CHAINED = "n % 10 < 3 AND n - n % 10 + 2 <= (SELECT max(n) FROM {t}) AND n >= 10"


@query(FLEET + f"""
SELECT db_id, name AS old, CASE WHEN n % 10 = 2 THEN name || '_free' ELSE 't' || (n + 1) END AS new,
  CASE WHEN n % 10 = 2 OR n // 10 % 2 = 0 THEN 'applied' ELSE 'dest_exists' END AS rename_status
FROM t WHERE {CHAINED.format(t='t')}""")
def j03_rename_chains(spark, sf):
    """a -> b, b -> c, c -> free: whole where the last comes first, else only c."""
    t = fleet(spark, sf)["tables"]
    top = t.agg(F.max("n")).first()[0] or 0
    chained = t.where(f"n % 10 < 3 AND n - n % 10 + 2 <= {top} AND n >= 10")
    asked = chained.select("db_id", F.col("name").alias("old"), F.expr("CASE WHEN n % 10 = 2 THEN name || '_free' ELSE 't' || (n + 1) END AS new"), F.expr("cast(CASE WHEN cast(n / 10 AS int) % 2 = 0 THEN 20 - n % 10 ELSE n % 10 END AS int) AS ordinal"))
    return diff.resolve_renames(t, asked.select("db_id", F.col("new").alias("name")), asked).select("db_id", "old", "new", "rename_status")


# -- deletes and types --------------------------------------------------------------


@query("""
SELECT CASE WHEN o_custkey % 97 = 0 THEN 1 ELSE o_custkey END AS o_custkey, count(*) AS rows FROM orders GROUP BY 1""")
def j09_set_default(spark, sf):
    gone = read(spark, sf, "customer").where("c_custkey % 97 = 0")
    kept = graph.propagate_delete(gone, "c_custkey", read(spark, sf, "orders"), "o_custkey", "set default", "1")["kept"]
    return kept.groupBy("o_custkey").agg(F.count("*").alias("rows"))


@query("SELECT p_partkey, CAST(CASE WHEN v < 0 THEN -floor(-v + 0.5) ELSE floor(v + 0.5) END AS BIGINT) AS whole FROM (SELECT p_partkey, CAST(p_size * 0.5 - 10 AS DECIMAL(12, 1)) AS v FROM part)")
def e04_decimal_retype(spark, sf):
    df = read(spark, sf, "part").select("p_partkey", F.expr("cast(p_size * 0.5 - 10 AS decimal(12, 1)) AS v"))
    return df.select("p_partkey", evolve.cast_value(F.col("v"), "decimal(12,1)", "bigint").alias("whole"))


@query("""
SELECT c_custkey % 5 AS pick, count(*) AS n, CASE c_custkey % 5 WHEN 0 THEN 'timestamp(3) with time zone' WHEN 1 THEN 'timestamp without time zone' WHEN 2 THEN 'time(6) without time zone[]' WHEN 3 THEN 'numeric(12,2)' ELSE 'character varying(40)[][]' END AS type_name
FROM customer GROUP BY ALL""")
def f09_type_modifiers(spark, sf):
    raw = F.element_at(F.array(*map(F.lit, ("timestamptz(3)", "timestamp", "time(6)[]", "decimal( 12, 2 )", "varchar(40)[][]"))), F.col("pick").cast("int") + 1)
    picked = read(spark, sf, "customer").select((F.col("c_custkey") % 5).alias("pick"))
    return picked.withColumn("type_name", logic.type_name(raw)).groupBy("pick", "type_name").agg(F.count("*").alias("n"))


# -- whole contracts --------------------------------------------------------------

EVENTS = TableContract(
    "events",
    (
        ColumnSpec("user_id", "bigint", not_null=True, domain=DomainSpec("user_no", "bigint", checks=(Rule("low", "VALUE < 500 OR VALUE IS NULL AND 'VALUE' = 'x'"), Rule("old", "VALUE > 0", validated=False)))),
        ColumnSpec("event_type", "string", labels=LABELS),
        ColumnSpec("day", "date", generated="to_date(ts)"),
    ),
    checks=(Rule("id_even", "event_id % 2 = 0"), Rule("later", "event_id < 0", validated=False)),
    exclusions=(ExclusionSpec("one_at_a_time", ("user_id",), "ts", "until"),),
)
EVENTS_NOW = f"SELECT event_id, CASE WHEN event_id % 43 = 0 THEN NULL ELSE user_id END AS user_id, {LEGACY} AS event_type, ts, CASE WHEN event_id % 47 = 0 THEN DATE '2000-01-01' ELSE CAST(ts AS DATE) END AS day, ts + to_minutes(CAST(1 + event_id % 12 AS INTEGER)) AS until FROM events"


@query(f"""
WITH e AS MATERIALIZED ({EVENTS_NOW}),
w AS (SELECT event_id, max(until) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) > ts AS bad FROM e WHERE user_id IS NOT NULL)
SELECT rule, count(*) FILTER (WHERE bad) AS violations, min(CAST(event_id AS VARCHAR)) FILTER (WHERE bad) AS sample FROM (
  SELECT 'user_id.not_null' AS rule, event_id, user_id IS NULL AS bad FROM e
  UNION ALL SELECT 'user_id.low', event_id, user_id >= 500 FROM e
  UNION ALL SELECT 'event_type.labels', event_id, event_type NOT IN {LABELS} FROM e
  UNION ALL SELECT 'day.generated', event_id, day IS DISTINCT FROM CAST(ts AS DATE) FROM e
  UNION ALL SELECT 'id_even', event_id, event_id % 2 <> 0 FROM e
  UNION ALL SELECT 'one_at_a_time', event_id, bad FROM w) GROUP BY rule""")
def contract_audit_events(spark, sf):
    minutes = F.expr("make_interval(0, 0, 0, 0, 0, cast(1 + event_id % 12 AS int))")
    df = read(spark, sf, "events").select("event_id", F.expr("CASE WHEN event_id % 43 = 0 THEN NULL ELSE user_id END AS user_id"), F.expr(LEGACY).alias("event_type"), "ts", F.expr("CASE WHEN event_id % 47 = 0 THEN DATE'2000-01-01' ELSE to_date(ts) END AS day"), (F.col("ts") + minutes).alias("until"))
    return audit.audit(df, EVENTS, "event_id", {}, whole=True)


# -- reports and snapshots -----------------------------------------------------------

REPORTED = FLEET + """
, tk AS (SELECT coalesce(t2.db_id, t.db_id) AS db_id, coalesce(t2.name, t.name) AS name, t.name IS NULL AS made FROM t FULL JOIN t2 ON t.db_id = t2.db_id AND t.name = t2.name WHERE t.name IS NULL OR t2.name IS NULL),
ck AS (SELECT coalesce(c2.db_id, c.db_id) AS db_id, coalesce(c2."table", c."table") AS tab, coalesce(c2.name, c.name) AS name, CASE WHEN c.name IS NULL THEN 'create' WHEN c2.name IS NULL THEN 'drop' WHEN c.type_name <> c2.type_name THEN 'alter' END AS change, c.type_name AS old, c2.type_name AS new
  FROM c FULL JOIN c2 ON c.db_id = c2.db_id AND c."table" = c2."table" AND c.name = c2.name),
rep AS (
  SELECT db_id, 'table' AS kind, name AS object, CAST(NULL AS VARCHAR) AS attribute, CASE WHEN made THEN 'create' ELSE 'skipped' END AS action, made AS executable, CAST(NULL AS VARCHAR) AS old, CAST(NULL AS VARCHAR) AS new, CASE WHEN made THEN 2 END AS phase FROM tk
  UNION ALL SELECT db_id, 'column', tab || '.' || name, NULL, 'ignored', false, NULL, NULL, NULL FROM (SELECT DISTINCT db_id, "table" AS tab, name FROM (SELECT db_id, "table", name FROM c UNION ALL SELECT db_id, "table", name FROM c2) WHERE name = 'note')
  UNION ALL SELECT db_id, 'column', tab || '.' || name, CASE WHEN change = 'alter' THEN 'type_name' END, change, true, CASE WHEN change = 'alter' THEN old END, CASE WHEN change = 'alter' THEN new END, CASE WHEN change = 'drop' THEN 4 ELSE 2 END FROM ck WHERE change IS NOT NULL AND name <> 'note')
"""


def whole_report(spark, sf) -> DataFrame:
    pick = lambda f: {"table": f["tables"].select("db_id", "name"), "column": f["columns"].select("db_id", "table", "name", "type_name")}
    current, desired = pick(fleet(spark, sf)), pick(fleet(spark, sf, True))
    keys = {"table": ("db_id", "name"), "column": ("db_id", "table", "name")}
    return diff.full_report(current, desired, keys, allowed=("column",), ignored={"column": current["column"].where("name = 'note'")})


@query(REPORTED + "SELECT * FROM rep")
def e16_whole_report(spark, sf):
    return whole_report(spark, sf)


@query(REPORTED + "SELECT kind, action, count(*) AS n FROM rep GROUP BY ALL")
def e16_report_counts(spark, sf):
    return diff.report_counts(whole_report(spark, sf))


@query(FLEET + """SELECT kind, count(*) AS rows, 0 AS different FROM (
  SELECT 'tables' AS kind FROM t UNION ALL SELECT 'columns' FROM c UNION ALL SELECT 'references' FROM r UNION ALL SELECT 'constraints' FROM t) GROUP BY kind""")
def s01_s02_round_trip(spark, sf):
    """What is written as a snapshot and scanned again differs in nothing."""
    held = {k: v for k, v in fleet(spark, sf).items() if k != "enums"}
    place = f"{shared_dir(spark)}/snapshot-{uuid.uuid4().hex}"
    snapshot.write_snapshot(held, place)
    parts = []
    for kind, df in held.items():
        back = snapshot.read_snapshot(spark, place, kind).withColumn("db_id", F.col("db_id").cast("bigint")).select(df.columns)
        different = diff.result_difference(df, back).agg(F.count("*").cast("int").alias("different"))
        parts.append(back.agg(F.count("*").alias("rows")).join(different).select(F.lit(kind).alias("kind"), "rows", "different"))
    return reduce(DataFrame.unionByName, parts)


# -- catalog rules ------------------------------------------------------------------


@query("SELECT c_nationkey, string_agg(DISTINCT CASE WHEN c_custkey % 7 = 0 THEN 'public' ELSE c_mktsegment END, ',' ORDER BY CASE WHEN c_custkey % 7 = 0 THEN 'public' ELSE c_mktsegment END) AS roles FROM customer GROUP BY ALL")
def a03_public_roles(spark, sf):
    rows = read(spark, sf, "customer").select("c_nationkey", F.col("c_mktsegment").alias("role"), (F.col("c_custkey") % 7).alias("role_id"))
    return snapshot.role_sets(rows, ["c_nationkey"], role_id="role_id").select("c_nationkey", F.array_join("roles", ",").alias("roles"))


@query(FLEET + """, o AS (
  SELECT db_id, schema, NULL AS owner, name, 'table' AS kind FROM t
  UNION ALL SELECT db_id, schema, name, CASE WHEN n % 13 = 0 THEN 't' || n ELSE 'pk_' || n END, 'primary key' FROM t
  UNION ALL SELECT db_id, schema, name, 'positive', 'check' FROM t
  UNION ALL SELECT db_id, schema, name, CASE WHEN n % 17 = 0 THEN 'positive' ELSE 'fk_' || n END, 'foreign key' FROM t
  UNION ALL SELECT db_id, schema, NULL, CASE WHEN n % 19 = 0 THEN 't' || n ELSE 'd' || n END, 'domain' FROM t
  UNION ALL SELECT db_id, schema, NULL, 's' || (n - n % 2), 'sequence' FROM t)
SELECT db_id, schema, namespace, owner, name, string_agg(DISTINCT kind, ',' ORDER BY kind) AS kinds, count(*) AS n, CASE WHEN count(DISTINCT kind) = 1 THEN 'duplicate' ELSE 'clash' END AS reason FROM (
  SELECT db_id, schema, 'relation' AS namespace, CAST(NULL AS VARCHAR) AS owner, name, kind FROM o WHERE kind IN ('table', 'primary key', 'sequence')
  UNION ALL SELECT db_id, schema, 'type', NULL, name, kind FROM o WHERE kind IN ('table', 'domain')
  UNION ALL SELECT db_id, schema, 'constraint', owner, name, kind FROM o WHERE kind IN ('primary key', 'check', 'foreign key'))
GROUP BY db_id, schema, namespace, owner, name HAVING count(*) > 1""")
def a06_namespaces(spark, sf):
    t = fleet(spark, sf)["tables"]

    def objects(kind: str, name: str, owner: str = "NULL") -> DataFrame:
        return t.select("db_id", "schema", F.expr(f"cast({owner} AS string) AS owner"), F.expr(f"{name} AS name"), F.lit(kind).alias("kind"))

    return snapshot.namespace_clashes(reduce(DataFrame.unionByName, [
        objects("table", "name"), objects("primary key", "CASE WHEN n % 13 = 0 THEN 't' || n ELSE 'pk_' || n END", "name"), objects("check", "'positive'", "name"),
        objects("foreign key", "CASE WHEN n % 17 = 0 THEN 'positive' ELSE 'fk_' || n END", "name"), objects("domain", "CASE WHEN n % 19 = 0 THEN 't' || n ELSE 'd' || n END"), objects("sequence", "'s' || (n - n % 2)"),
    ]))


@query("""
SELECT c_custkey AS enum_id, CASE c_custkey % 6 WHEN 0 THEN 'same' WHEN 1 THEN 'added' WHEN 2 THEN 'removed' WHEN 3 THEN 'reordered' WHEN 4 THEN 'same' ELSE 'bad_rename' END AS verdict FROM customer""")
def e09_enum_verdicts(spark, sf):
    """An enum a customer: a, b, c becomes what its number asks for."""
    base = read(spark, sf, "customer").select(F.col("c_custkey").alias("enum_id"), (F.col("c_custkey") % 6).alias("k"))
    listed = lambda labels: base.select("enum_id", F.posexplode(labels).alias("ordinal", "label"))
    text = lambda *labels: F.array(*map(F.lit, labels))
    k = F.col("k")
    wanted = F.when(k == 1, text("a", "x", "b", "c")).when(k == 2, text("a", "c")).when(k == 3, text("b", "a", "c")).when(k == 4, text("a", "b2", "c")).when(k == 5, text("a", "b", "c", "d")).otherwise(text("a", "b", "c"))
    renames = base.where("k IN (4, 5)").select("enum_id", F.when(k == 4, "b").otherwise("a").alias("old"), F.when(k == 4, "b2").otherwise("c").alias("new"), F.lit(1).alias("ordinal"))
    return diff.enum_verdicts(listed(text("a", "b", "c")), listed(wanted), ["enum_id"], renames)


BOUNDS = "SELECT c_nationkey AS parent, 'p' || c_custkey AS name, CASE WHEN c_custkey % 40 = 0 THEN NULL ELSE c_custkey * 10 END AS start, CASE WHEN c_custkey % 60 = 0 THEN NULL ELSE c_custkey * 10 + 10 END AS \"end\", c_custkey % 50 = 0 AS is_default FROM customer"


@query(f"""
WITH b AS ({BOUNDS}), o AS (SELECT *, row_number() OVER (PARTITION BY parent ORDER BY start NULLS FIRST, name) AS i FROM b)
SELECT y.parent, y.name FROM o y WHERE EXISTS (SELECT 1 FROM o x WHERE x.parent = y.parent AND x.i < y.i AND (x."end" IS NULL OR y.start IS NULL OR x."end" > y.start))""")
def e13_open_bounds(spark, sf):
    bounds = read(spark, sf, "customer").selectExpr("c_nationkey AS parent", "'p' || c_custkey AS name", "CASE WHEN c_custkey % 40 = 0 THEN NULL ELSE c_custkey * 10 END AS start", "CASE WHEN c_custkey % 60 = 0 THEN NULL ELSE c_custkey * 10 + 10 END AS end")
    return partition.overlapping_bounds(bounds, ["parent"]).select("parent", "name")


@query(f"WITH b AS ({BOUNDS}) SELECT parent, count(*) AS defaults FROM b WHERE is_default GROUP BY parent HAVING count(*) > 1")
def e13_repeated_defaults(spark, sf):
    bounds = read(spark, sf, "customer").selectExpr("c_nationkey AS parent", "c_custkey % 50 = 0 AS is_default")
    return partition.repeated_defaults(bounds, ["parent"])


# -- views --------------------------------------------------------------------------

NAMED = {
    "sums": "SELECT o_custkey AS customer, 'orders' AS orders, sum(o_totalprice) AS total FROM orders, (SELECT max(o_orderkey) AS top FROM orders) m WHERE o_orderkey <= m.top GROUP BY o_custkey",
    "told": "SELECT c.c_custkey, s.orders, s.total > 100000 AS rich FROM customer c JOIN sums s ON s.customer = c.c_custkey AND c.c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey < 3)",
}


@query("""
SELECT c_custkey, 'orders' AS orders, sum(o_totalprice) > 100000 AS rich FROM customer JOIN orders ON o_custkey = c_custkey
WHERE c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey < 3) GROUP BY c_custkey""")
def j11_v01_names(spark, sf):
    """Literals and columns named like tables, a derived table, a comma join and a
    subquery in ON."""
    return views.run_views(spark, {n: read(spark, sf, n) for n in ("orders", "customer", "nation")}, NAMED, "told")
