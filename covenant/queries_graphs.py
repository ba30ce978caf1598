"""Registered queries of what takes many steps: deletes that go through a graph of
references, components of dependency graphs, prefix scans over hot keys, and routing
over levels of many bounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from covenant.model import ColumnSpec, KeySpec, ReferenceSpec, TableContract
from covenant.operators import audit, deletes, diff, graph, partition, scan
from covenant.queries import CHAIN, query, read, table_edges
from covenant.queries_fleet import fleet

# -- deletes ------------------------------------------------------------------------


def table(name: str, key: tuple[str, ...], *references: ReferenceSpec, defaults: dict[str, str] | None = None) -> TableContract:
    columns = dict.fromkeys([*key, *(c for r in references for c in r.columns)])
    return TableContract(name, tuple(ColumnSpec(c, "bigint", default=(defaults or {}).get(c)) for c in columns), (KeySpec(f"{name}_pkey", key, primary=True),), references=references)


#: Who brought a customer: trees, and pairs that brought each other.
REFERRER = "CASE WHEN c_custkey % 50 = 7 THEN c_custkey + 1 WHEN c_custkey % 50 = 8 THEN c_custkey - 1 WHEN c_custkey % 3 = 0 THEN {third} END"
CLAIM = "l_linenumber = 3 AND l_orderkey % 40 = 0"

SALES = {
    "customer": table("customer", ("c_custkey",), ReferenceSpec("customer_referrer", ("referrer",), "customer", ("c_custkey",), "cascade")),
    "orders": table("orders", ("o_orderkey",), ReferenceSpec("orders_customer", ("o_custkey",), "customer", ("c_custkey",), "cascade")),
    "lineitem": table("lineitem", ("l_orderkey", "l_linenumber"), ReferenceSpec("lineitem_order", ("l_orderkey",), "orders", ("o_orderkey",), "cascade")),
    "claims": table("claims", ("claim",), ReferenceSpec("claims_order", ("on_order",), "orders", ("o_orderkey",), "restrict")),
    "events": table("events", ("event_id",), ReferenceSpec("events_customer", ("user_id",), "customer", ("c_custkey",), "set null")),
}


def sales(spark, sf) -> dict[str, DataFrame]:
    lines = read(spark, sf, "lineitem")
    return {
        "customer": read(spark, sf, "customer").withColumn("referrer", F.expr(REFERRER.format(third="c_custkey div 3"))),
        "orders": read(spark, sf, "orders"),
        "lineitem": lines,
        "claims": lines.where(CLAIM).selectExpr("l_orderkey * 10 AS claim", "l_orderkey AS on_order"),
        "events": read(spark, sf, "events"),
    }


@query(f"""
WITH RECURSIVE c AS (SELECT c_custkey, {REFERRER.format(third='c_custkey // 3')} AS referrer FROM customer),
down AS (SELECT c_custkey AS root, c_custkey AS k FROM c WHERE c_custkey % 20 = 1 UNION SELECT root, c.c_custkey FROM down JOIN c ON c.referrer = down.k),
veto AS (SELECT DISTINCT root FROM down JOIN orders ON o_custkey = k WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE {CLAIM})),
gone AS (SELECT DISTINCT k FROM down WHERE root NOT IN (SELECT root FROM veto))
SELECT 'customer' AS "table", CAST(k AS VARCHAR) AS key, 'deleted' AS what FROM gone
UNION ALL SELECT 'orders', CAST(o_orderkey AS VARCHAR), 'deleted' FROM orders WHERE o_custkey IN (FROM gone)
UNION ALL SELECT DISTINCT 'lineitem', l_orderkey || '-' || l_linenumber, 'deleted' FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_custkey IN (FROM gone))
UNION ALL SELECT 'events', CAST(event_id AS VARCHAR), 'set null' FROM events WHERE user_id IN (FROM gone)
UNION ALL SELECT 'customer', CAST(root AS VARCHAR), 'vetoed' FROM veto""")
def j09_propagated_deletes(spark, sf):
    """A chain of cascades with a self reference that has circles, a claim that
    forbids, and events that outlive their customer."""
    given = sales(spark, sf)
    found = deletes.propagate_deletes(given, SALES, "customer", given["customer"].where("c_custkey % 20 = 1").select("c_custkey"))
    row = lambda df, name, key, what: df.select(F.lit(name).alias("table"), F.expr(key).cast("string").alias("key"), F.lit(what).alias("what"))
    out = row(found.deleted["customer"], "customer", "c_custkey", "deleted").unionByName(row(found.vetoed, "customer", "c_custkey", "vetoed"))
    for name, key in (("orders", "o_orderkey"), ("lineitem", "concat(l_orderkey, '-', l_linenumber)")):
        if name in found.deleted:
            out = out.unionByName(row(found.deleted[name], name, key, "deleted"))
    lost = found.kept["events"].where("user_id IS NULL").join(given["events"].where("user_id IS NOT NULL").select("event_id"), "event_id", "left_semi")
    return out.unionByName(row(lost, "events", "event_id", "set null"))


WAITS = "c_custkey % 10 IN (3, 4, 5)"
CIRCLE = {
    "customer": table("customer", ("c_custkey",), ReferenceSpec("customer_first", ("first_order",), "orders", ("o_orderkey",), "no action")),
    "orders": table("orders", ("o_orderkey",), ReferenceSpec("orders_customer", ("o_custkey",), "customer", ("c_custkey",), "cascade")),
}


@query(f"""
WITH RECURSIVE r AS (SELECT c_custkey AS k FROM customer WHERE c_custkey % 7 <> 0), o AS (SELECT DISTINCT o_custkey AS k FROM orders),
bad AS (
  SELECT c_custkey + 1 AS k FROM customer WHERE {WAITS} AND c_custkey % 7 = 0 AND c_custkey + 1 IN (FROM r) AND c_custkey + 1 IN (FROM o)
  UNION SELECT k + 1 FROM bad WHERE k % 10 IN (3, 4, 5) AND k + 1 IN (FROM r) AND k + 1 IN (FROM o))
SELECT c_custkey, CASE WHEN c_custkey IN (FROM bad) THEN 'vetoed' WHEN c_custkey IN (FROM r) THEN 'deleted' ELSE 'kept' END AS what FROM customer""")
def j09_no_action_circle(spark, sf):
    """Customers hold on to an order, at times the next customer's: who goes depends
    on who else goes, through several rounds of vetoes."""
    orders = read(spark, sf, "orders").select("o_orderkey", "o_custkey")
    first = orders.groupBy(F.col("o_custkey").alias("of")).agg(F.min("o_orderkey").alias("first_order"))
    customer = read(spark, sf, "customer").select("c_custkey", F.expr(f"c_custkey + CASE WHEN {WAITS} THEN 1 ELSE 0 END AS of")).join(first, "of", "left").select("c_custkey", "first_order")
    found = deletes.propagate_deletes({"customer": customer, "orders": orders}, CIRCLE, "customer", customer.where("c_custkey % 7 <> 0").select("c_custkey"))
    told = lambda df, what: df.select("c_custkey", F.lit(what).alias("what"))
    kept = found.kept["customer"].join(found.vetoed, "c_custkey", "left_anti")
    return told(found.deleted["customer"], "deleted").unionByName(told(found.vetoed, "vetoed")).unionByName(told(kept, "kept"))


# -- components ---------------------------------------------------------------------


@query(CHAIN.split("walk AS")[0] + """
part AS (SELECT t.db_id, t.name AS node, CASE WHEN t.db_id % 19 = 0 AND i = 2 AND EXISTS (SELECT 1 FROM t x WHERE x.db_id = t.db_id AND x.n = t.n - 1) THEN 't' || (n - 1) ELSE t.name END AS component FROM t),
e AS (SELECT DISTINCT edge.db_id, a.component AS src, b.component AS dst FROM edge JOIN part a ON a.db_id = edge.db_id AND a.node = edge.src JOIN part b ON b.db_id = edge.db_id AND b.node = edge.dst WHERE a.component <> b.component),
walk AS (SELECT DISTINCT db_id, component AS node, 0 AS level FROM part p WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.db_id = p.db_id AND e.src = p.component)
  UNION ALL SELECT e.db_id, e.src, level + 1 FROM walk w JOIN e ON e.db_id = w.db_id AND e.dst = w.node)
SELECT p.db_id, p.node, p.component, (SELECT count(*) FROM part q WHERE q.db_id = p.db_id AND q.component = p.component) AS members, max(level) AS level
FROM part p JOIN walk w ON w.db_id = p.db_id AND w.node = p.component GROUP BY ALL""")
def g01_unit_levels(spark, sf):
    """Cycles as units: what is behind one is ordered too."""
    return graph.unit_levels(*table_edges(fleet(spark, sf)))


def ring_edges(spark, sf) -> tuple[DataFrame, DataFrame]:
    """Graphs of 40 customers each, with circles of many lengths."""
    nodes = read(spark, sf, "customer").selectExpr("c_custkey div 40 AS db_id", "c_custkey AS n", "c_custkey % 40 AS i")
    far = nodes.selectExpr("db_id", "n", "n - i + (i * 7 + db_id) % 40 AS m").where("n % 5 <> 0")
    near = nodes.where("i % 8 <> 7").selectExpr("db_id", "n", "n + 1 AS m")
    both = far.unionByName(near).select("db_id", F.col("n").cast("string").alias("src"), F.col("m").cast("string").alias("dst"))
    return nodes.select("db_id", F.col("n").cast("string").alias("node")), both


@query("""
WITH RECURSIVE v AS (SELECT c_custkey // 40 AS db_id, c_custkey AS n, c_custkey % 40 AS i FROM customer),
e AS (SELECT db_id, n, n - i + (i * 7 + db_id) % 40 AS m FROM v WHERE n % 5 <> 0 UNION SELECT db_id, n, n + 1 FROM v WHERE i % 8 <> 7),
f AS (SELECT * FROM e WHERE n <> m AND m IN (SELECT n FROM v)),
r AS (SELECT db_id, n, m FROM f UNION SELECT r.db_id, r.n, f.m FROM r JOIN f ON f.n = r.m),
s AS (SELECT db_id, n, m FROM r WHERE EXISTS (SELECT 1 FROM r x WHERE x.n = r.m AND x.m = r.n) UNION SELECT db_id, n, n FROM v)
SELECT db_id, CAST(n AS VARCHAR) AS node, min(CAST(m AS VARCHAR)) AS component, count(*) AS members FROM s GROUP BY db_id, n""")
def g02_strong_components(spark, sf):
    nodes, edges = ring_edges(spark, sf)
    return graph.strong_components(nodes, edges)


@query("""
WITH v AS (SELECT c_custkey AS n FROM customer), top AS (SELECT max(n) AS n FROM v)
SELECT 1 AS db_id, CAST(n AS VARCHAR) AS node, CAST((SELECT n FROM top) - n AS INTEGER) AS level FROM v""")
def g01_long_chain(spark, sf):
    """All customers in one chain: as many levels as rows."""
    n = read(spark, sf, "customer").select(F.lit(1).alias("db_id"), F.col("c_custkey").alias("n"))
    edges = n.select("db_id", F.col("n").cast("string").alias("src"), (F.col("n") + 1).cast("string").alias("dst"))
    return graph.levels(n.select("db_id", F.col("n").cast("string").alias("node")), edges)


# -- prefix scans over hot keys ------------------------------------------------------

#: Half of all events are one user's.
HOT_USER = "CASE WHEN event_id % 2 = 0 THEN 0 ELSE user_id END"
#: Bookings of the hot user last seconds, so that they overlap now and then.
HOT_BOOKINGS = "SELECT event_id, " + HOT_USER + " AS user_id, ts, ts + {secs} AS until FROM events"


@query(f"""
WITH b AS ({HOT_BOOKINGS.format(secs="to_seconds(60 + event_id % 3000)")})
SELECT event_id, user_id FROM (SELECT *, max(until) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS most FROM b) WHERE most > ts""")
def c11_hot_exclusion_rows(spark, sf):
    b = read(spark, sf, "events").select("event_id", F.expr(f"{HOT_USER} AS user_id"), "ts", F.expr("ts + make_interval(0, 0, 0, 0, 0, 0, 60 + event_id % 3000) AS until"))
    return audit.exclusion_rows(b, "event_id", ["user_id"], "ts", "until").select("event_id", "user_id")


@query(f"""
WITH b AS ({HOT_BOOKINGS.format(secs="to_seconds(60 + event_id % 3000)")})
SELECT least(x.event_id, y.event_id) AS a, greatest(x.event_id, y.event_id) AS b FROM b x JOIN b y ON x.user_id = y.user_id AND x.event_id < y.event_id AND x.ts < y.until AND y.ts < x.until""")
def c11_hot_exclusion_pairs(spark, sf):
    b = read(spark, sf, "events").select("event_id", F.expr(f"{HOT_USER} AS user_id"), "ts", F.expr("ts + make_interval(0, 0, 0, 0, 0, 0, 60 + event_id % 3000) AS until"))
    return audit.exclusion_pairs(b, "event_id", ["user_id"], "ts", "until")


@query(f"""
SELECT user_id, event_type, first, merged FROM (
  SELECT user_id, event_type, run, min(event_id) AS first, count(*) AS merged FROM (
    SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY event_id) AS run FROM (
      SELECT *, CASE WHEN event_type <> 'purchase' AND event_type = lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) THEN 0 ELSE 1 END AS b FROM (SELECT event_id, event_type, {HOT_USER} AS user_id FROM events)))
  GROUP BY user_id, event_type, run)""")
def w03_hot_runs(spark, sf):
    e = read(spark, sf, "events").select("event_id", "event_type", F.expr(f"{HOT_USER} AS user_id"), F.lit("").alias("told"))
    return diff.merge_runs(e, ["user_id"], "event_id", "event_type", F.col("event_type") != "purchase", "told").select("user_id", "event_type", "first", "merged")


HOT_BOUNDS = "SELECT CASE WHEN c_custkey % 2 = 0 THEN 0 ELSE c_nationkey END AS parent, 'p' || c_custkey AS name, c_custkey * 3 AS start, c_custkey * 3 + 2 + c_custkey % 17 AS \"end\" FROM customer"


@query(f"""
WITH b AS ({HOT_BOUNDS})
SELECT parent, name, m AS taken_to FROM (SELECT *, max("end") OVER (PARTITION BY parent ORDER BY start, name ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM b) WHERE start < m""")
def e13_hot_bounds(spark, sf):
    b = read(spark, sf, "customer").selectExpr("CASE WHEN c_custkey % 2 = 0 THEN 0 ELSE c_nationkey END AS parent", "'p' || c_custkey AS name", "c_custkey * 3 AS start", "c_custkey * 3 + 2 + c_custkey % 17 AS end")
    return partition.overlapping_bounds(b, ["parent"]).select("parent", "name", "taken_to")


# -- routing ------------------------------------------------------------------------

#: Bounds of widths from 1 to a million: the first are narrow, the last is open.
SKEWED = "SELECT 'w' || c_custkey AS name, CAST(pow(c_custkey, 2) / 4 AS BIGINT) AS start FROM customer"


@query(f"""
WITH s AS (SELECT name, start, lead(start) OVER (ORDER BY start, name) AS "end" FROM ({SKEWED}) WHERE start >= 100), b AS (SELECT * FROM s WHERE "end" IS NULL OR "end" > start)
SELECT o_orderkey, name AS partition FROM orders LEFT JOIN b ON o_orderkey * 3 >= start AND (o_orderkey * 3 < "end" OR "end" IS NULL)""")
def j06_skewed_bounds(spark, sf):
    """Rows meet bounds by search: no width has to be known."""
    starts = read(spark, sf, "customer").selectExpr("'w' || c_custkey AS name", "cast(pow(c_custkey, 2) / 4 AS bigint) AS start").where("start >= 100")
    keys = starts.withColumn("minus", -F.col("start"))
    after = scan.running(keys, [], ["minus", "name"], {"end": ("min", F.col("start"))}).select("name", "start", "end")
    rows = read(spark, sf, "orders").selectExpr("o_orderkey", "o_orderkey * 3 AS at")
    return partition.route_many(rows, "at", after.where("end IS NULL OR end > start")).select("o_orderkey", "partition")


@query("""
SELECT o_orderkey, CASE
  WHEN o_orderstatus IN ('F', 'O') THEN 'done' || '/' || CASE WHEN o_custkey >= 100 * (o_custkey // 100) AND o_custkey // 100 % 4 <> 3 THEN 'c' || (o_custkey // 100) ELSE 'rest' END
  ELSE 'open' END AS partition FROM orders WHERE o_orderstatus IS NOT NULL
UNION ALL SELECT o_orderkey, 'open' FROM orders WHERE o_orderstatus IS NULL""")
def e12_tree_routing(spark, sf):
    """A list, then ranges of all customers' hundreds with a default; `open` has no
    level below it, so its rows stop there."""
    orders = read(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_custkey")
    kinds = "parent string, name string, start bigint, end bigint, values array<string>, is_default boolean"
    top = spark.createDataFrame([(None, "done", None, None, ["F", "O"], False), (None, "open", None, None, None, True)], kinds)
    hundreds = read(spark, sf, "customer").selectExpr("c_custkey div 100 AS h").distinct().where("h % 4 <> 3")
    ranges = hundreds.selectExpr("'done' AS parent", "'c' || h AS name", "h * 100 AS start", "h * 100 + 100 AS end", "cast(NULL AS array<string>) AS values", "false AS is_default")
    below = ranges.unionByName(spark.createDataFrame([("done", "rest", None, None, None, True)], kinds))
    first = partition.route_tree(orders, [("o_orderstatus", top)])
    done = partition.route_tree(orders.where("o_orderstatus IN ('F', 'O')"), [("o_orderstatus", top), ("o_custkey", below)])
    return done.select("o_orderkey", "partition").unionByName(first.where("partition = 'open'").select("o_orderkey", "partition"))


# -- changed partitions, labels of many enums ----------------------------------------

PARTED = "SELECT c_nationkey AS db_id, 'p' || c_custkey AS name, 't' || (c_custkey % 5) AS parent, c_custkey * 10 AS start, c_custkey * 10 + 10 AS \"end\", c_custkey % 50 = 0 AS is_default, c_custkey AS n FROM customer"


@query(f"""
WITH a AS ({PARTED}), k AS (SELECT DISTINCT db_id, parent AS "table", db_id % 4 = 0 AND parent = 't3' AS rebuilt FROM a)
SELECT a.db_id, name, CASE WHEN n % 13 = 0 THEN 'drop' WHEN (SELECT bool_or(rebuilt) FROM k WHERE k.db_id = a.db_id AND k."table" = CASE WHEN n % 11 = 0 THEN 't0' ELSE parent END) THEN 'rebuild' WHEN n % 11 = 0 AND parent <> 't0' THEN 'reattach' ELSE 'recreate' END AS change
FROM a WHERE n % 13 = 0 OR n % 11 = 0 AND parent <> 't0' OR n % 7 = 0 OR (SELECT bool_or(rebuilt) FROM k WHERE k.db_id = a.db_id AND k."table" = CASE WHEN n % 11 = 0 THEN 't0' ELSE parent END)
UNION ALL SELECT db_id, 'q' || n, 'create' FROM a WHERE n % 17 = 0 UNION ALL SELECT db_id, "table", 'rebuild' FROM k WHERE rebuilt""")
def e13_partition_changes(spark, sf):
    """Keys, parents and bounds that change."""
    a = read(spark, sf, "customer").selectExpr("c_nationkey AS db_id", "'p' || c_custkey AS name", "'t' || (c_custkey % 5) AS parent", "c_custkey * 10 AS start", "c_custkey * 10 + 10 AS end", "c_custkey % 50 = 0 AS is_default", "c_custkey AS n")
    b = a.where("n % 13 <> 0").withColumns({"start": F.expr("CASE WHEN n % 7 = 0 THEN start + 1 ELSE start END"), "parent": F.expr("CASE WHEN n % 11 = 0 THEN 't0' ELSE parent END")})
    b = b.unionByName(a.where("n % 17 = 0").withColumn("name", F.expr("'q' || n")))
    keys = a.selectExpr("db_id", "parent AS table", "'range' AS strategy", "'id' AS key").distinct()
    wanted = keys.withColumn("key", F.expr("CASE WHEN db_id % 4 = 0 AND table = 't3' THEN 'other' ELSE key END"))
    return partition.partition_changes(a.drop("n"), b.drop("n"), keys, wanted)


#: An enum for each brand of parts, its labels the parts' names with their numbers.
PART_LABELS = "SELECT p_brand AS brand, p_name || p_partkey AS label, CAST(row_number() OVER (PARTITION BY p_brand ORDER BY {o}) AS INTEGER) AS ordinal FROM part WHERE {w}"
MIXED = "CASE WHEN p_brand LIKE '%1' THEN -p_partkey ELSE p_partkey END"


def part_labels(spark, sf, order: str, where: str) -> DataFrame:
    rows = read(spark, sf, "part").where(where).select(F.col("p_brand").alias("brand"), F.expr("p_name || p_partkey AS label"), F.expr(order).alias("o"))
    return scan.running(rows, ["brand"], ["o"], {"ordinal": ("sum", F.lit(1))}, inclusive=True).select("brand", "label", F.col("ordinal").cast("int").alias("ordinal"))


@query(f"""
WITH a AS ({PART_LABELS.format(o='p_partkey', w='true')}), b AS ({PART_LABELS.format(o=MIXED, w='p_partkey % 5 <> 0')})
SELECT brand, max(down) AS reordered FROM (SELECT a.brand, coalesce(b.ordinal < lag(b.ordinal) OVER (PARTITION BY a.brand ORDER BY a.ordinal), false) AS down FROM a JOIN b USING (brand, label)) GROUP BY brand""")
def w04_part_labels(spark, sf):
    return diff.is_reordered(part_labels(spark, sf, "p_partkey", "true"), part_labels(spark, sf, MIXED, "p_partkey % 5 <> 0"), ["brand"])


@query(f"""
WITH a AS ({PART_LABELS.format(o='p_partkey', w='p_partkey % 3 <> 0')}), b AS ({PART_LABELS.format(o='p_partkey', w='true')}),
m AS (SELECT b.*, a.label IS NOT NULL AS there, lag(b.label) OVER w AS before, first(CASE WHEN a.label IS NOT NULL THEN b.label END IGNORE NULLS) OVER (PARTITION BY b.brand ORDER BY b.ordinal ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS next FROM b LEFT JOIN a USING (brand, label) WINDOW w AS (PARTITION BY b.brand ORDER BY b.ordinal))
SELECT brand, label, CASE WHEN before IS NOT NULL THEN 'after' WHEN next IS NOT NULL THEN 'before' ELSE 'append' END AS placed, coalesce(before, next) AS neighbour FROM m WHERE NOT there""")
def w05_part_labels(spark, sf):
    return diff.insert_positions(part_labels(spark, sf, "p_partkey", "p_partkey % 3 <> 0"), part_labels(spark, sf, "p_partkey", "true"), ["brand"])
