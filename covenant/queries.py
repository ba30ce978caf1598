"""Registered queries of the contract operators, each with the same result as SQL."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from covenant.functions import logic
from covenant.model import ColumnSpec, DomainSpec, DropPolicy, KeySpec, PartitionSpec, PolicySpec, ReferenceSpec, Rule, TableContract
from covenant.operators import audit, diff, evolve, graph, partition, policy
from covenant.plans import views
from covenant.queries_fleet import COLUMNS, TABLES, fleet
from covenant.sources import snapshot
from covenant.streaming import gate as stream_gate

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        if f.__name__ in QUERIES:
            raise ValueError(f"two queries are named {f.__name__}")
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def read(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


# -- inputs with planted faults; the same arithmetic stands in the SQL -------

ORPHAN = "CASE WHEN l_partkey % 89 = 0 THEN -l_partkey WHEN l_partkey % 97 = 0 THEN NULL ELSE l_partkey END"
NULL_BALANCE = "CASE WHEN c_custkey % 97 = 0 THEN NULL ELSE c_acctbal END"
NULL_NAME = "CASE WHEN p_partkey % 97 = 0 THEN NULL ELSE p_name END"


def with_orphans(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "lineitem").withColumn("l_partkey", F.expr(ORPHAN))


def orders_now(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority")


def orders_next(spark: SparkSession, sf: str) -> DataFrame:
    old = orders_now(spark, sf)
    kept = old.where("o_orderkey % 101 <> 0").withColumn("o_totalprice", F.expr("CASE WHEN o_orderkey % 103 = 0 THEN o_totalprice + 1 ELSE o_totalprice END"))
    return kept.unionByName(old.where("o_orderkey % 107 = 0").withColumn("o_orderkey", F.expr("o_orderkey + 10000000")))


ORDERS_NOW = "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority FROM orders"
ORDERS_NEXT = """SELECT o_orderkey, o_custkey, o_orderstatus, CASE WHEN o_orderkey % 103 = 0 THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice, o_orderpriority
  FROM orders WHERE o_orderkey % 101 <> 0
  UNION ALL SELECT o_orderkey + 10000000, o_custkey, o_orderstatus, o_totalprice, o_orderpriority FROM orders WHERE o_orderkey % 107 = 0"""


def bookings(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "events").select("event_id", "user_id", "ts", (F.col("ts") + F.expr("make_interval(0,0,0,0, cast(1 + event_id % 12 as int))")).alias("until"))


BOOKINGS = "SELECT event_id, user_id, ts, ts + to_hours(CAST(1 + event_id % 12 AS INTEGER)) AS until FROM events"

# -- audits -----------------------------------------------------------------

LINEITEM = TableContract(
    "lineitem",
    (ColumnSpec("l_orderkey", "bigint", not_null=True), ColumnSpec("l_linenumber", "int", not_null=True)),
    keys=(KeySpec("lineitem_pkey", ("l_orderkey", "l_linenumber"), primary=True),),
    references=(ReferenceSpec("lineitem_part", ("l_partkey",), "part", ("p_partkey",)),),
    checks=(Rule("quantity_positive", "l_quantity > 0"), Rule("discount_small", "l_discount <= 0.09")),
)


@query(f"""
WITH l AS (SELECT * REPLACE ({ORPHAN} AS l_partkey) FROM lineitem)
SELECT 'lineitem_pkey' AS rule, count(*) AS violations, min(CAST(l_orderkey AS VARCHAR)) AS sample FROM (SELECT l_orderkey FROM l GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1)
UNION ALL SELECT 'lineitem_part', count(*), min(CAST(l_orderkey AS VARCHAR)) FROM l WHERE l_partkey IS NOT NULL AND l_partkey NOT IN (SELECT p_partkey FROM part)
UNION ALL SELECT 'quantity_positive', count(*), min(CAST(l_orderkey AS VARCHAR)) FROM l WHERE NOT (l_quantity > 0)
UNION ALL SELECT 'discount_small', count(*), min(CAST(l_orderkey AS VARCHAR)) FROM l WHERE NOT (l_discount <= 0.09)""")
def contract_audit_lineitem(spark, sf):
    return audit.audit(with_orphans(spark, sf), LINEITEM, "l_orderkey", {"part": read(spark, sf, "part")})


@query("""
SELECT 'o_custkey' AS "column", count(*) FILTER (WHERE o_orderkey % 97 = 0) AS nulls FROM orders
UNION ALL SELECT 'o_totalprice', count(*) FILTER (WHERE o_orderkey % 89 = 0) FROM orders
UNION ALL SELECT 'o_orderstatus', 0 FROM (SELECT 1)""")
def c01_not_null_counts(spark, sf):
    df = read(spark, sf, "orders").withColumns({"o_custkey": F.expr("CASE WHEN o_orderkey % 97 = 0 THEN NULL ELSE o_custkey END"), "o_totalprice": F.expr("CASE WHEN o_orderkey % 89 = 0 THEN NULL ELSE o_totalprice END")})
    return audit.null_counts(df, ["o_custkey", "o_totalprice", "o_orderstatus"])


@query("""
WITH l AS (SELECT CASE WHEN l_orderkey % 97 = 0 THEN NULL ELSE l_orderkey END AS k, l_linenumber FROM lineitem)
SELECT k AS l_orderkey, l_linenumber, CASE WHEN k IS NULL THEN 'null' ELSE 'duplicate' END AS reason, count(*) AS rows FROM l GROUP BY ALL HAVING k IS NULL OR count(*) > 1""")
def c02_primary_key(spark, sf):
    df = read(spark, sf, "lineitem").select(F.expr("CASE WHEN l_orderkey % 97 = 0 THEN NULL ELSE l_orderkey END").alias("l_orderkey"), "l_linenumber")
    return audit.primary_key(df, ["l_orderkey", "l_linenumber"])


@query(f"""
WITH p AS (SELECT {NULL_NAME} AS p_name FROM part)
SELECT p_name, count(*) AS rows FROM p WHERE p_name IS NOT NULL GROUP BY p_name HAVING count(*) > 1""")
def c03_unique(spark, sf):
    return audit.duplicate_keys(read(spark, sf, "part").withColumn("p_name", F.expr(NULL_NAME)), KeySpec("u", ("p_name",)))


@query(f"""
WITH p AS (SELECT {NULL_NAME} AS p_name FROM part)
SELECT p_name, count(*) AS rows FROM p GROUP BY p_name HAVING count(*) > 1""")
def c03_unique_nulls_not_distinct(spark, sf):
    return audit.duplicate_keys(read(spark, sf, "part").withColumn("p_name", F.expr(NULL_NAME)), KeySpec("u", ("p_name",), nulls_distinct=False))


@query("SELECT p_partkey, p_name FROM part WHERE p_name IN (SELECT p_name FROM part GROUP BY p_name HAVING count(*) > 1)")
def c03_unique_rows(spark, sf):
    return audit.duplicate_rows(read(spark, sf, "part").select("p_partkey", "p_name"), KeySpec("u", ("p_name",)))


@query("SELECT user_id, count(*) AS rows FROM events WHERE event_type = 'purchase' GROUP BY user_id HAVING count(*) > 1")
def c04_partial_unique(spark, sf):
    return audit.duplicate_keys(read(spark, sf, "events"), KeySpec("u", ("user_id",), where="event_type = 'purchase'"))


@query("SELECT lower(substr(p_name, 1, 8)) AS k0, count(*) AS rows FROM part GROUP BY 1 HAVING count(*) > 1")
def c05_expression_unique(spark, sf):
    return audit.duplicate_keys(read(spark, sf, "part"), KeySpec("u", ("lower(substr(p_name, 1, 8))",)))


@query(f"""
SELECT c_custkey, concat_ws(',', CASE WHEN NOT coalesce(b >= 0, true) THEN 'balance' END, CASE WHEN NOT coalesce(c_nationkey < 20, true) THEN 'nation' END, CASE WHEN NOT coalesce(b < 9000 OR c_mktsegment = 'BUILDING', true) THEN 'rich' END) AS violated
FROM (SELECT *, {NULL_BALANCE} AS b FROM customer)
WHERE NOT coalesce(b >= 0, true) OR NOT coalesce(c_nationkey < 20, true) OR NOT coalesce(b < 9000 OR c_mktsegment = 'BUILDING', true)""")
def c06_checks(spark, sf):
    df = read(spark, sf, "customer").withColumn("c_acctbal", F.expr(NULL_BALANCE))
    rules = [Rule("balance", "c_acctbal >= 0"), Rule("nation", "c_nationkey < 20"), Rule("rich", "c_acctbal < 9000 OR c_mktsegment = 'BUILDING'")]
    return audit.check(df, rules).select("c_custkey", F.array_join("violated", ",").alias("violated"))


@query("""
SELECT mode, count(o_orderkey) AS violations FROM (VALUES ('all'), ('backlog'), ('new_only'), ('skip')) m(mode)
LEFT JOIN (SELECT * FROM orders WHERE o_totalprice > 400000) o ON mode = 'all' OR mode = 'new_only' AND o_orderkey % 4 = 0 OR mode = 'backlog' AND o_orderkey % 4 <> 0
GROUP BY mode""")
def c07_validation_modes(spark, sf):
    df, rules = read(spark, sf, "orders"), [Rule("cheap", "o_totalprice <= 400000", validated=False)]
    parts = [audit.staged(df, rules, m, "o_orderkey % 4 = 0").agg(F.count("*").alias("violations")).select(F.lit(m).alias("mode"), "violations") for m in ("all", "backlog", "new_only", "skip")]
    return reduce(DataFrame.unionByName, parts)


@query(f"""
SELECT l_orderkey, l_linenumber, l_partkey FROM (SELECT * REPLACE ({ORPHAN} AS l_partkey) FROM lineitem) WHERE l_partkey IS NOT NULL AND l_partkey NOT IN (SELECT p_partkey FROM part)""")
def c08_foreign_key(spark, sf):
    return audit.foreign_key(with_orphans(spark, sf), ["l_partkey"], read(spark, sf, "part"), ["p_partkey"]).select("l_orderkey", "l_linenumber", "l_partkey")


@query("""
SELECT l.l_partkey, l.l_suppkey, count(*) AS rows FROM lineitem l
WHERE NOT EXISTS (SELECT 1 FROM lineitem p WHERE p.l_orderkey % 2 = 0 AND p.l_partkey = l.l_partkey AND p.l_suppkey = l.l_suppkey) GROUP BY ALL""")
def c08_foreign_key_composite(spark, sf):
    rows = read(spark, sf, "lineitem")
    return audit.foreign_key(rows, ["l_partkey", "l_suppkey"], rows.where("l_orderkey % 2 = 0").select("l_partkey", "l_suppkey"), ["l_partkey", "l_suppkey"]).groupBy("l_partkey", "l_suppkey").agg(F.count("*").alias("rows"))


@query("""
SELECT p_partkey, concat_ws(',', CASE WHEN s IS NULL THEN 'p_size.not_null' END, CASE WHEN NOT coalesce(s <= 40, true) THEN 'p_size.small' END) AS violated
FROM (SELECT p_partkey, CASE WHEN p_partkey % 97 = 0 THEN NULL ELSE p_size END AS s FROM part) WHERE s IS NULL OR s > 40""")
def c09_domain(spark, sf):
    df = read(spark, sf, "part").withColumn("p_size", F.expr("CASE WHEN p_partkey % 97 = 0 THEN NULL ELSE p_size END"))
    return audit.domain(df, DomainSpec("small_int", "int", True, (Rule("small", "VALUE <= 40"),)), ["p_size"]).select("p_partkey", F.array_join("violated", ",").alias("violated"))


LABELS = ("click", "view", "signup", "purchase", "refund")
LEGACY = "CASE WHEN event_id % 41 = 0 THEN 'legacy_' || event_type ELSE event_type END"


@query(f"SELECT event_id, t AS event_type FROM (SELECT event_id, {LEGACY} AS t FROM events) WHERE t NOT IN {LABELS}")
def c10_enum_outside(spark, sf):
    return audit.enum_outside(read(spark, sf, "events").withColumn("event_type", F.expr(LEGACY)), "event_type", LABELS).select("event_id", "event_type")


@query("""
SELECT label, CAST(ordinal AS INTEGER) AS ordinal, count(event_id) AS uses FROM (VALUES ('click', 0), ('view', 1), ('signup', 2), ('purchase', 3), ('refund', 4), ('never', 5)) l(label, ordinal) LEFT JOIN events ON event_type = label GROUP BY ALL""")
def c10_enum_usage(spark, sf):
    return audit.enum_usage(read(spark, sf, "events"), "event_type", [*LABELS, "never"])


@query(f"""
WITH b AS ({BOOKINGS})
SELECT x.event_id AS a, y.event_id AS b FROM b x JOIN b y ON x.user_id = y.user_id AND x.event_id < y.event_id AND x.ts < y.until AND y.ts < x.until""")
def c11_exclusion_pairs(spark, sf):
    return audit.exclusion_pairs(bookings(spark, sf), "event_id", ["user_id"], "ts", "until")


@query(f"""
WITH b AS ({BOOKINGS})
SELECT event_id, user_id FROM (SELECT *, max(until) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS most FROM b) WHERE most > ts""")
def c11_exclusion_rows(spark, sf):
    return audit.exclusion_rows(bookings(spark, sf), "event_id", ["user_id"], "ts", "until").select("event_id", "user_id")


FLEET = f"""
WITH t AS (SELECT c_custkey // {TABLES} AS db_id, 'app' AS schema, 't' || c_custkey AS name, c_custkey AS n, c_custkey % {TABLES} AS i FROM customer),
c AS (SELECT db_id, schema, name AS "table", n, o AS ordinal, col AS name, kind AS type_name, o <= 2 AS not_null FROM t, (VALUES {', '.join(f"({i + 1}, '{c}', '{k}')" for i, (c, k) in enumerate(COLUMNS))}) v(o, col, kind)),
t2 AS (SELECT * FROM t WHERE n % 11 <> 0),
c2 AS (SELECT db_id, schema, "table", n, ordinal, name, CASE WHEN n % 5 = 0 AND name = 'owner' THEN 'bigint' ELSE type_name END AS type_name, not_null FROM c WHERE n % 11 <> 0
  UNION ALL SELECT db_id, schema, name, n, 10, 'extra', 'text', false FROM t2 WHERE n % 7 = 0),
r AS (SELECT * FROM (SELECT db_id, schema, name AS "table", 'fk_' || name AS name, CASE WHEN n % 17 = 0 THEN 'gone' ELSE 'owner' END AS col,
  CASE WHEN db_id % 19 = 0 AND i = 1 THEN 't' || (n + 1) WHEN i > 0 THEN 't' || (n - i + i // 2) END AS ref_table FROM t) WHERE ref_table IS NOT NULL)
"""


@query(FLEET + "SELECT db_id, name, count(*) AS definitions FROM (SELECT db_id, name FROM t UNION ALL SELECT db_id, name FROM t2 WHERE n % 13 = 0) GROUP BY ALL HAVING count(*) > 1")
def c12_duplicate_definitions(spark, sf):
    a, b = fleet(spark, sf)["tables"], fleet(spark, sf, True)["tables"]
    return audit.duplicate_definitions(a.select("db_id", "name").unionByName(b.where("n % 13 = 0").select("db_id", "name")), ["db_id", "name"])


@query("""
SELECT p_partkey, concat_ws(',', CASE WHEN p_partkey % 53 = 0 THEN 'price' END, CASE WHEN length(p_name) > 14 THEN 'p_name.length' END) AS violated FROM part WHERE p_partkey % 53 = 0 OR length(p_name) > 14""")
def c13_type_conformance(spark, sf):
    df = read(spark, sf, "part").withColumn("price", F.expr("CASE WHEN p_partkey % 53 = 0 THEN 'n/a' ELSE cast(p_retailprice AS string) END"))
    return audit.type_conformance(df, {"price": "decimal(12,2)"}, {"p_name": 14}).select("p_partkey", F.array_join("violated", ",").alias("violated"))


@query("SELECT l_orderkey, count(*) AS rows FROM lineitem WHERE l_orderkey % 59 = 0 GROUP BY l_orderkey")
def c14_generated(spark, sf):
    net = "round(l_extendedprice * (1 - l_discount), 2)"
    df = read(spark, sf, "lineitem").withColumn("net", F.expr(f"{net} + CASE WHEN l_orderkey % 59 = 0 THEN 1 ELSE 0 END"))
    return audit.generated(df, "net", net).groupBy("l_orderkey").agg(F.count("*").alias("rows"))


@query(FLEET + """SELECT r.db_id, r.schema, r."table", r.name, r.col AS "column" FROM r WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.db_id = r.db_id AND c."table" = r."table" AND c.name = r.col)""")
def c15_dangling_columns(spark, sf):
    f = fleet(spark, sf)
    return audit.dangling_columns(f["references"], f["columns"])


@query("SELECT o_orderkey, CASE WHEN o_orderkey > 12000 THEN 'bounds' ELSE 'grid' END AS reason FROM orders WHERE o_orderkey > 12000 OR (o_orderkey - 1) % 3 <> 0")
def c16_sequence(spark, sf):
    return audit.sequence_values(read(spark, sf, "orders"), "o_orderkey", 1, 3, 0, 12000).select("o_orderkey", "reason")


@query("""
WITH s AS (SELECT c_custkey, c_name FROM customer WHERE c_custkey % 10 <> 0 UNION ALL SELECT c_custkey, 'Customer#' || (c_custkey % 100) FROM customer WHERE c_custkey % 20 = 0)
SELECT c_name, count(*) AS rows FROM s GROUP BY c_name HAVING count(*) > 1""")
def c17_deferred(spark, sf):
    base = read(spark, sf, "customer").select("c_custkey", "c_name")
    touched = base.where("c_custkey % 10 = 0")
    first = touched.withColumn("c_name", F.lit("same")).withColumns({"op": F.lit("update"), "seq": F.lit(1)})
    last = touched.withColumn("c_name", F.expr("'Customer#' || (c_custkey % 100)")).withColumns({"op": F.expr("CASE WHEN c_custkey % 20 = 0 THEN 'update' ELSE 'delete' END"), "seq": F.lit(2)})
    return audit.duplicate_keys(audit.net_changes(base, first.unionByName(last), ["c_custkey"], "seq"), KeySpec("u", ("c_name",)))


@query("""
WITH p AS (SELECT p_partkey, CASE WHEN p_partkey % 97 = 0 THEN NULL ELSE p_size END AS s FROM part)
SELECT '1 add check, not valid' AS step, count(*) FILTER (WHERE s IS NULL) AS nulls FROM p WHERE p_partkey % 2 = 0
UNION ALL SELECT '2 backfill', 0 UNION ALL SELECT '3 validate', 0 UNION ALL SELECT '4 set not null', 0""")
def c18_not_null_rollout(spark, sf):
    df = read(spark, sf, "part").withColumn("p_size", F.expr("CASE WHEN p_partkey % 97 = 0 THEN NULL ELSE p_size END"))
    return evolve.rollout_not_null(df, "p_size", "0", "p_partkey % 2 = 0")


@query("""
WITH p AS (SELECT p_partkey % 5 AS lot, p_partkey % 3 <> 0 AS old, p_partkey % 97 = 0 AS empty, p_partkey % 485 = 0 AS no_default FROM part),
c AS (SELECT lot, count(*) FILTER (WHERE empty AND old) AS a, count(*) FILTER (WHERE empty AND old AND no_default) AS b, count(*) FILTER (WHERE empty AND NOT old) AS r FROM p GROUP BY lot)
SELECT lot, '1 nullable' AS step, a AS nulls, 0 AS refused, 'none' AS check_state, false AS not_null FROM c
UNION ALL SELECT lot, '2 check, not valid', a, r, 'not valid', false FROM c
UNION ALL SELECT lot, '3 backfill', b, r, 'not valid', false FROM c
UNION ALL SELECT lot, '4 validate', b, r, CASE b WHEN 0 THEN 'valid' ELSE 'not valid' END, false FROM c
UNION ALL SELECT lot, '5 set not null', b, r, CASE b WHEN 0 THEN 'valid' ELSE 'not valid' END, b = 0 FROM c
UNION ALL SELECT lot, '6 drop check', b, r, CASE b WHEN 0 THEN 'none' ELSE 'not valid' END, b = 0 FROM c""")
def c18_rollout_states(spark, sf):
    df = read(spark, sf, "part").withColumn("p_size", F.expr("CASE WHEN p_partkey % 97 = 0 THEN NULL ELSE p_size END")).withColumn("lot", F.expr("p_partkey % 5"))
    old = F.expr("p_partkey % 3 <> 0")
    return evolve.rollout_states(df.where(old), df.where(~old), "p_size", "CASE WHEN p_partkey % 485 = 0 THEN NULL ELSE 0 END", ["lot"])


# -- predicates and scalar forms ------------------------------------------------


@query(f"SELECT count(*) FILTER (WHERE NOT coalesce(b >= 0, true)) AS failing, count(*) FILTER (WHERE coalesce(b >= 0, false)) AS visible, count(*) FILTER (WHERE b IS DISTINCT FROM c_acctbal) AS differing FROM (SELECT c_acctbal, {NULL_BALANCE} AS b FROM customer)")
def p07_three_valued(spark, sf):
    df = read(spark, sf, "customer").withColumn("b", F.expr(NULL_BALANCE))
    return df.agg(F.count_if(logic.fails(F.expr("b >= 0"))).alias("failing"), F.count_if(logic.visible(F.expr("b >= 0"))).alias("visible"), F.count_if(logic.differs(F.col("b"), F.col("c_acctbal"))).alias("differing"))


@query("SELECT c_mktsegment, count(*) AS n FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') GROUP BY 1")
def p08_in_any(spark, sf):
    return read(spark, sf, "customer").where(logic.any_of(F.col("c_mktsegment"), ["BUILDING", "MACHINERY"])).groupBy("c_mktsegment").agg(F.count("*").alias("n"))


@query(f"""
SELECT c_custkey, coalesce(b, -1) AS balance, CASE WHEN b > 5000 THEN 'high' WHEN b > 0 THEN 'mid' END AS band, greatest(b, 100.0) AS g, least(b, 100.0) AS l FROM (SELECT c_custkey, {NULL_BALANCE} AS b FROM customer)""")
def f01_conditional(spark, sf):
    b = F.expr(NULL_BALANCE)
    return read(spark, sf, "customer").select("c_custkey", F.coalesce(b, F.lit(-1.0)).alias("balance"), F.when(b > 5000, "high").when(b > 0, "mid").alias("band"), F.greatest(b, F.lit(100.0)).alias("g"), F.least(b, F.lit(100.0)).alias("l"))


@query(f"SELECT c_custkey, b IS NULL AS missing, coalesce(b > 0, false) AS sure, b IS NOT NULL AND c_name IS NOT NULL AS whole FROM (SELECT *, {NULL_BALANCE} AS b FROM customer)")
def f02_null_tests(spark, sf):
    df = read(spark, sf, "customer").withColumn("b", F.expr(NULL_BALANCE))
    return df.select("c_custkey", F.col("b").isNull().alias("missing"), logic.visible(F.col("b") > 0).alias("sure"), logic.row_is_not_null(F.col("b"), F.col("c_name")).alias("whole"))


@query("SELECT p_partkey, upper(p_name) AS up, lower(p_brand) || '-' || p_type AS tag, CAST(length(p_name) AS INTEGER) AS n FROM part")
def f03_strings(spark, sf):
    return read(spark, sf, "part").select("p_partkey", F.upper("p_name").alias("up"), F.concat(F.lower("p_brand"), F.lit("-"), "p_type").alias("tag"), F.length("p_name").alias("n"))


@query("SELECT o_orderkey, list_contains(['F', 'O'], o_orderstatus) AS known FROM orders")
def f04_arrays(spark, sf):
    return read(spark, sf, "orders").select("o_orderkey", F.array_contains(F.array(F.lit("F"), F.lit("O")), F.col("o_orderstatus")).alias("known"))


@query("""SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, json_exists(props, '$.k') AS has_k, '{"id":' || event_id || ',"k":' || json_extract_string(props, '$.k') || '}' AS told FROM events""")
def f05_json(spark, sf):
    k = F.get_json_object("props", "$.k").cast("int")
    return read(spark, sf, "events").select("event_id", k.alias("k"), F.get_json_object("props", "$.k").isNotNull().alias("has_k"), F.to_json(F.struct(F.col("event_id").alias("id"), k.alias("k"))).alias("told"))


@query("SELECT o_orderkey, CAST(year(o_orderdate + INTERVAL 3 MONTH) AS INTEGER) AS y, CAST(date_trunc('month', o_orderdate) AS DATE) AS m, CAST(date_diff('day', TIMESTAMP '1992-01-01', o_orderdate) AS INTEGER) AS d FROM orders")
def f06_dates(spark, sf):
    c = F.col("o_orderdate")
    return read(spark, sf, "orders").select("o_orderkey", F.year(c + F.expr("INTERVAL 3 MONTHS")).alias("y"), F.date_trunc("month", c).cast("date").alias("m"), F.datediff(c.cast("date"), F.lit("1992-01-01").cast("date")).alias("d"))


@query("SELECT p_partkey, TRY_CAST(CASE WHEN p_partkey % 53 = 0 THEN 'n/a' ELSE CAST(p_size AS VARCHAR) END AS INTEGER) AS size, p_size = CAST('10' AS INTEGER) AS ten, CAST(round_even(p_retailprice, 0) AS INTEGER) AS price FROM part")
def f07_casts(spark, sf):
    said = F.expr("try_cast(CASE WHEN p_partkey % 53 = 0 THEN 'n/a' ELSE cast(p_size AS string) END AS int)")
    return read(spark, sf, "part").select("p_partkey", said.alias("size"), (F.col("p_size") == F.lit("10").cast("int")).alias("ten"), evolve.cast_value(F.col("p_retailprice"), "double", "int").alias("price"))


@query("SELECT p_brand, p_type, CAST(row_number() OVER (ORDER BY lower(p_type), p_brand) AS INTEGER) AS place FROM (SELECT DISTINCT p_brand, CASE WHEN p_partkey % 2 = 0 THEN p_type ELSE upper(p_type) END AS p_type FROM part) QUALIFY row_number() OVER (PARTITION BY p_brand, lower(p_type) ORDER BY p_type) = 1")
def f08_collation(spark, sf):
    named = read(spark, sf, "part").select("p_brand", F.expr("CASE WHEN p_partkey % 2 = 0 THEN p_type ELSE upper(p_type) END").alias("p_type"))
    one = named.groupBy("p_brand", F.collate("p_type", "UTF8_LCASE").alias("k")).agg(F.min("p_type").alias("p_type"))
    ordered = evolve.dense_rank_rows(one.withColumn("low", F.lower("p_type")).select("p_brand", "p_type", "low"), ["low", "p_brand"], "place")
    return ordered.select("p_brand", "p_type", (F.col("place") + 1).cast("int").alias("place"))


@query(FLEET + """SELECT DISTINCT type_name, CASE type_name WHEN 'int4' THEN 'integer' WHEN 'varchar(40)' THEN 'character varying(40)' WHEN 'numeric(12, 2)' THEN 'numeric(12,2)' WHEN 'timestamptz' THEN 'timestamp with time zone' WHEN 'timestamp' THEN 'timestamp without time zone' WHEN 'int2[]' THEN 'smallint[]' ELSE type_name END AS usual FROM c""")
def f09_type_names(spark, sf):
    return fleet(spark, sf)["columns"].select("type_name", logic.type_name(F.col("type_name"), F.col("schema")).alias("usual")).distinct()


# -- diff -----------------------------------------------------------------------

DIFF = f"""
WITH a AS ({ORDERS_NOW}), b AS ({ORDERS_NEXT}),
d AS (SELECT coalesce(b.o_orderkey, a.o_orderkey) AS o_orderkey, a AS old, b AS new,
  CASE WHEN a.o_orderkey IS NULL THEN 'create' WHEN b.o_orderkey IS NULL THEN 'drop' WHEN a = b THEN 'same' ELSE 'alter' END AS change FROM a FULL JOIN b ON a.o_orderkey = b.o_orderkey)
"""


def orders_diff(spark, sf):
    return diff.keyed_diff(orders_now(spark, sf), orders_next(spark, sf), ["o_orderkey"])


@query(DIFF + "SELECT o_orderkey, change, round(old.o_totalprice, 2) AS old_price, round(new.o_totalprice, 2) AS new_price FROM d WHERE change <> 'same'")
def j01_keyed_diff(spark, sf):
    return orders_diff(spark, sf).where("change <> 'same'").select("o_orderkey", "change", F.round("old_o_totalprice", 2).alias("old_price"), F.round("new_o_totalprice", 2).alias("new_price"))


@query(DIFF + "SELECT change, count(*) AS n FROM d GROUP BY change")
def j01_diff_counts(spark, sf):
    return orders_diff(spark, sf).groupBy("change").agg(F.count("*").alias("n"))


@query(FLEET + """SELECT c.db_id, c."table", c.name, 'type_name' AS attribute, c.type_name AS old, c2.type_name AS new FROM c JOIN c2 ON c.db_id = c2.db_id AND c."table" = c2."table" AND c.name = c2.name AND c.type_name <> c2.type_name""")
def j02_attribute_diff(spark, sf):
    pick = lambda f: f["columns"].select("db_id", "table", "name", "ordinal", "type_name", "not_null")
    key = ["db_id", "table", "name"]
    return diff.attribute_diff(diff.keyed_diff(pick(fleet(spark, sf)), pick(fleet(spark, sf, True)), key), key)


RENAMES = "SELECT db_id, 't' || n AS old, CASE WHEN n % 3 = 0 THEN 't' || n || '_v2' WHEN n % 3 = 1 THEN 't' || (n + 1) ELSE 't' || n END AS new, CASE WHEN n % 3 = 1 THEN 100 - n % 50 ELSE 10 + n % 50 END AS ordinal FROM {t} WHERE n % 13 < 3"


@query(FLEET + f""", q AS ({RENAMES.format(t='t')} UNION ALL SELECT db_id, 'none' || n, 'x' || n, 1 FROM t WHERE n % 31 = 0)
-- what stands at a new name here is at most asked to keep its name, so none is freed
SELECT q.db_id, q.old, q.new, CASE WHEN q.old = q.new THEN 'noop' WHEN o.name IS NULL AND w.name IS NOT NULL THEN 'noop' WHEN o.name IS NULL THEN 'missing_source'
  WHEN w.name IS NULL THEN 'applied' ELSE 'dest_exists' END AS rename_status
FROM q LEFT JOIN t o ON o.db_id = q.db_id AND o.name = q.old LEFT JOIN t w ON w.db_id = q.db_id AND w.name = q.new""")
def j03_renames(spark, sf):
    t = fleet(spark, sf)["tables"]
    asked = t.where("n % 13 < 3").select("db_id", F.expr("'t' || n AS old"), F.expr("CASE WHEN n % 3 = 0 THEN 't' || n || '_v2' WHEN n % 3 = 1 THEN 't' || (n + 1) ELSE 't' || n END AS new"), F.expr("cast(CASE WHEN n % 3 = 1 THEN 100 - n % 50 ELSE 10 + n % 50 END AS int) AS ordinal"))
    asked = asked.unionByName(t.where("n % 31 = 0").select("db_id", F.expr("'none' || n AS old"), F.expr("'x' || n AS new"), F.lit(1).alias("ordinal")))
    wanted = asked.select("db_id", F.col("new").alias("name"))
    return diff.resolve_renames(t, wanted, asked).select("db_id", "old", "new", "rename_status")


@query("SELECT l_orderkey, l_linenumber FROM lineitem l WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_orderkey = l.l_orderkey AND o_orderkey % 7 <> 0)")
def j04_anti_join(spark, sf):
    return audit.foreign_key(read(spark, sf, "lineitem"), ["l_orderkey"], read(spark, sf, "orders").where("o_orderkey % 7 <> 0"), ["o_orderkey"]).select("l_orderkey", "l_linenumber")


@query("SELECT p_partkey, 'b' || (CAST(floor(p_retailprice / 50) AS BIGINT)) AS partition FROM part WHERE p_retailprice >= 0 AND p_retailprice < 100000")
def j06_range_join(spark, sf):
    prices = read(spark, sf, "part").select(F.floor(F.col("p_retailprice") / 50).alias("b")).distinct()
    bounds = prices.select(F.concat(F.lit("b"), "b").alias("name"), (F.col("b") * 50).cast("double").alias("start"), ((F.col("b") + 1) * 50).cast("double").alias("end"))
    return partition.route_many(read(spark, sf, "part").select("p_partkey", "p_retailprice"), "p_retailprice", bounds).select("p_partkey", "partition")


@query("SELECT o_orderkey, c_name, n_name FROM orders LEFT JOIN customer ON o_custkey = c_custkey AND c_custkey % 3 <> 0 LEFT JOIN nation ON c_nationkey = n_nationkey")
def j07_enrichment(spark, sf):
    c = read(spark, sf, "customer").where("c_custkey % 3 <> 0")
    return read(spark, sf, "orders").join(c, F.col("o_custkey") == F.col("c_custkey"), "left").join(read(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"), "left").select("o_orderkey", "c_name", "n_name")


@query(FLEET + """SELECT db_id, "table", name, CASE WHEN col = 'owner' AND substr("table", 2)::BIGINT % 4 = 0 THEN 'holder' ELSE col END AS columns FROM r""")
def j08_rename_propagation(spark, sf):
    f = fleet(spark, sf)
    renames = f["tables"].where("n % 4 = 0").select("db_id", F.col("name").alias("table"), F.lit("owner").alias("old"), F.lit("holder").alias("new"))
    return diff.propagate_column_renames(f["references"], renames).select("db_id", "table", "name", F.array_join("columns", ",").alias("columns"))


@query("""
WITH gone AS (SELECT c_custkey FROM customer WHERE c_custkey % 97 = 0), o AS (SELECT o_orderkey FROM orders WHERE o_custkey IN (FROM gone))
SELECT 'orders deleted' AS what, count(*) AS rows FROM o
UNION ALL SELECT 'lineitem set null', count(*) FROM lineitem WHERE l_orderkey IN (FROM o)
UNION ALL SELECT 'events restricted', count(*) FROM events WHERE user_id IN (FROM gone)""")
def j09_delete_propagation(spark, sf):
    gone = read(spark, sf, "customer").where("c_custkey % 97 = 0")
    orders = graph.propagate_delete(gone, "c_custkey", read(spark, sf, "orders"), "o_custkey", "cascade")["deleted"]
    items = graph.propagate_delete(orders, "o_orderkey", read(spark, sf, "lineitem"), "l_orderkey", "set null")["kept"].where("l_orderkey IS NULL")
    held = graph.propagate_delete(gone, "c_custkey", read(spark, sf, "events"), "user_id", "restrict")["violations"]
    count = lambda df, what: df.agg(F.count("*").alias("rows")).select(F.lit(what).alias("what"), "rows")
    return count(orders, "orders deleted").unionByName(count(items, "lineitem set null")).unionByName(count(held, "events restricted"))


@query(f"""
WITH a AS ({ORDERS_NOW}), b AS ({ORDERS_NEXT}), x AS (SELECT o_orderpriority, o_custkey % 10 AS g, count(*) AS n FROM a GROUP BY ALL), y AS (SELECT o_orderpriority, o_custkey % 10 AS g, count(*) AS n FROM b GROUP BY ALL)
SELECT *, CAST(sum(s) AS BIGINT) AS surplus FROM (SELECT *, 1 AS s FROM x UNION ALL SELECT *, -1 FROM y) GROUP BY o_orderpriority, g, n, s HAVING false
UNION ALL SELECT o_orderpriority, g, n, 0, CAST(sum(s) AS BIGINT) FROM (SELECT *, 1 AS s FROM x UNION ALL SELECT *, -1 FROM y) GROUP BY o_orderpriority, g, n HAVING sum(s) <> 0""".replace("SELECT *, CAST(sum(s) AS BIGINT) AS surplus FROM (SELECT *, 1 AS s FROM x UNION ALL SELECT *, -1 FROM y) GROUP BY o_orderpriority, g, n, s HAVING false\nUNION ALL SELECT o_orderpriority, g, n, 0, CAST(sum(s) AS BIGINT)", "SELECT o_orderpriority, g, n, CAST(sum(s) AS BIGINT) AS surplus"))
def u04_result_difference(spark, sf):
    told = lambda df: df.groupBy("o_orderpriority", F.expr("o_custkey % 10 AS g")).agg(F.count("*").alias("n"))
    return diff.result_difference(told(orders_now(spark, sf)), told(orders_next(spark, sf)))


@query(f"SELECT c_custkey FROM (SELECT *, {NULL_BALANCE} AS b FROM customer) WHERE (b > 0 AND c_nationkey < 10) IS DISTINCT FROM (b >= 0.5 AND c_nationkey <= 9 OR c_custkey % 50 = 0)")
def u04_predicate_difference(spark, sf):
    df = read(spark, sf, "customer").withColumn("b", F.expr(NULL_BALANCE))
    return diff.predicate_difference(df, "b > 0 AND c_nationkey < 10", "b >= 0.5 AND c_nationkey <= 9 OR c_custkey % 50 = 0").select("c_custkey")


@query("""
SELECT user_id, event_type, first, merged, actions FROM (
  SELECT user_id, event_type, run, min(event_id) AS first, count(*) AS merged, string_agg(CAST(event_id AS VARCHAR), ', ' ORDER BY event_id) AS actions FROM (
    SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY event_id) AS run FROM (
      SELECT *, CASE WHEN event_type <> 'purchase' AND event_type = lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) THEN 0 ELSE 1 END AS b FROM events))
  GROUP BY user_id, event_type, run)""")
def w03_merge_runs(spark, sf):
    e = read(spark, sf, "events").withColumn("told", F.col("event_id").cast("string"))
    return diff.merge_runs(e, ["user_id"], "event_id", "event_type", F.col("event_type") != "purchase", "told").select("user_id", "event_type", "first", "merged", "actions")


ENUM_ROWS = "SELECT n_regionkey AS by_region, n_name AS label, CAST(row_number() OVER (PARTITION BY n_regionkey ORDER BY {o}) AS INTEGER) AS ordinal FROM nation WHERE {w}"


def enum_rows(spark, sf, order, where):
    w = Window.partitionBy("n_regionkey").orderBy(*order)
    return read(spark, sf, "nation").where(where).select(F.col("n_regionkey").alias("by_region"), F.col("n_name").alias("label"), F.row_number().over(w).alias("ordinal"))


@query(f"""
WITH a AS ({ENUM_ROWS.format(o='n_name', w='true')}), b AS ({ENUM_ROWS.format(o='n_regionkey % 2 * n_nationkey, n_name', w='n_nationkey % 5 <> 0')})
SELECT by_region, max(down) AS reordered FROM (SELECT a.by_region, coalesce(b.ordinal < lag(b.ordinal) OVER (PARTITION BY a.by_region ORDER BY a.ordinal), false) AS down FROM a JOIN b USING (by_region, label)) GROUP BY by_region""")
def w04_reordered(spark, sf):
    return diff.is_reordered(enum_rows(spark, sf, ["n_name"], "true"), enum_rows(spark, sf, [F.expr("n_regionkey % 2 * n_nationkey"), "n_name"], "n_nationkey % 5 <> 0"), ["by_region"])


@query(f"""
WITH a AS ({ENUM_ROWS.format(o='n_name', w='n_nationkey % 3 <> 0')}), b AS ({ENUM_ROWS.format(o='n_name', w='true')}),
m AS (SELECT b.*, a.label IS NOT NULL AS there, lag(b.label) OVER w AS before, min(CASE WHEN a.label IS NOT NULL THEN b.label END) OVER (PARTITION BY b.by_region ORDER BY b.ordinal ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS next FROM b LEFT JOIN a USING (by_region, label) WINDOW w AS (PARTITION BY b.by_region ORDER BY b.ordinal))
SELECT by_region, label, CASE WHEN before IS NOT NULL THEN 'after' WHEN next IS NOT NULL THEN 'before' ELSE 'append' END AS placed, coalesce(before, next) AS neighbour FROM m WHERE NOT there""")
def w05_insert_positions(spark, sf):
    return diff.insert_positions(enum_rows(spark, sf, ["n_name"], "n_nationkey % 3 <> 0"), enum_rows(spark, sf, ["n_name"], "true"), ["by_region"])


@query(FLEET + """SELECT c.db_id, c."table" AS view, bool_and(c2.name IS NOT NULL AND c2.type_name = c.type_name) AS replaceable FROM c LEFT JOIN c2 ON c.db_id = c2.db_id AND c."table" = c2."table" AND c.ordinal = c2.ordinal GROUP BY ALL""")
def w06_replaceable_views(spark, sf):
    pick = lambda f: f["columns"].select("db_id", F.col("table").alias("view"), "ordinal", F.col("name").alias("column"), F.col("type_name").alias("type"))
    return diff.replaceable_views(pick(fleet(spark, sf)), pick(fleet(spark, sf, True)))


@query(FLEET + """, k AS (SELECT coalesce(t2.db_id, t.db_id) AS db_id, coalesce(t2.name, t.name) AS name, CASE WHEN t.name IS NULL THEN 'create' WHEN t2.name IS NULL THEN 'skipped' END AS action FROM t FULL JOIN t2 ON t.db_id = t2.db_id AND t.name = t2.name)
SELECT db_id, name, 'table' AS kind, action, action <> 'skipped' AS executable FROM k WHERE action IS NOT NULL AND name NOT LIKE 't%7'""")
def e16_change_report(spark, sf):
    pick = lambda f: f["tables"].select("db_id", "name", "schema")
    a, b = pick(fleet(spark, sf)), pick(fleet(spark, sf, True))
    return diff.change_report(diff.keyed_diff(a, b, ["db_id", "name"]), ["db_id", "name"], "table", ignored=a.where("name LIKE 't%7'"))


# -- evolution --------------------------------------------------------------------

ORDERS_WANTED = TableContract(
    "orders",
    (
        ColumnSpec("o_orderkey", "bigint"), ColumnSpec("customer", "int", renamed_from="o_custkey"), ColumnSpec("o_totalprice", "bigint"),
        ColumnSpec("state", "string", renamed_from="o_orderstatus"), ColumnSpec("o_orderpriority", "string"), ColumnSpec("channel", "string", not_null=True, default="'web'"),
        ColumnSpec("double_price", "double", generated="o_totalprice * 2"),
    ),
)


@query("""
SELECT o_orderkey, CAST(o_custkey AS INTEGER) AS customer, CAST(round_even(o_totalprice, 0) AS BIGINT) AS o_totalprice, o_orderstatus AS state, o_orderpriority, 'web' AS channel, o_totalprice * 2 AS double_price FROM orders""")
def e01_evolve(spark, sf):
    out, _ = evolve.evolve(orders_now(spark, sf), ORDERS_WANTED)
    again, changes = evolve.evolve(out, ORDERS_WANTED)
    if changes:
        raise AssertionError(f"a second evolution changed {changes}")
    return again


@query("SELECT o_custkey AS a, o_orderkey AS b, o_orderstatus FROM orders")
def e01_rename_swap(spark, sf):
    df = read(spark, sf, "orders").select(F.col("o_orderkey").alias("a"), F.col("o_custkey").alias("b"), "o_orderstatus")
    moved = evolve.rename_columns(df, [("a", "tmp"), ("b", "a")])
    return evolve.rename_columns(moved, [("tmp", "b")])


@query("SELECT c_custkey, CAST(NULL AS INTEGER) AS note, 7 AS rank FROM customer")
def e02_add_columns(spark, sf):
    df = read(spark, sf, "customer").select("c_custkey")
    return evolve.add_column(evolve.add_column(df, "note", "int"), "rank", "int", "7", not_null=True)


@query(f"SELECT c_custkey, coalesce({NULL_BALANCE}, 0.5) AS c_acctbal FROM customer")
def e03_backfill(spark, sf):
    return evolve.backfill(read(spark, sf, "customer").select("c_custkey", F.expr(NULL_BALANCE).alias("c_acctbal")), {"c_acctbal": "0.5"})


@query("SELECT p_partkey, CAST(round_even(p_retailprice, 0) AS BIGINT) AS price, CAST(p_size AS VARCHAR) AS size FROM part")
def e04_retype(spark, sf):
    want = TableContract("part", (ColumnSpec("p_partkey", "bigint"), ColumnSpec("price", "bigint"), ColumnSpec("size", "string")))
    return evolve.evolve(read(spark, sf, "part").select("p_partkey", F.col("p_retailprice").alias("price"), F.col("p_size").alias("size")), want)[0]


@query("SELECT s_suppkey, s_name, CAST(s_nationkey AS INTEGER) AS s_nationkey FROM supplier")
def e06_drop_policy(spark, sf):
    df = read(spark, sf, "supplier")
    want = TableContract("supplier", (ColumnSpec("s_suppkey", "bigint"), ColumnSpec("s_name", "string")))
    kept, changes = evolve.evolve(df, want)
    if [c.executable for c in changes] != [False, False] or kept.columns != df.columns:
        raise AssertionError("a drop was not denied")
    dropped, _ = evolve.evolve(df, want, DropPolicy(frozenset({"column"})))
    return dropped.join(kept.select("s_suppkey", "s_nationkey"), "s_suppkey")


@query("SELECT c_custkey, upper(c_name) || '/' || c_mktsegment AS tag FROM customer")
def e07_generated(spark, sf):
    want = TableContract("customer", (ColumnSpec("c_custkey", "bigint"), ColumnSpec("tag", "string", generated="upper(c_name) || '/' || c_mktsegment")))
    return evolve.evolve(read(spark, sf, "customer"), want, DropPolicy(frozenset({"all"})))[0]


@query("SELECT event_id, CASE event_type WHEN 'click' THEN 'view' WHEN 'view' THEN 'click' ELSE event_type END AS event_type FROM events")
def e08_enum_rename(spark, sf):
    return read(spark, sf, "events").select("event_id", evolve.rename_values(F.col("event_type"), {"click": "view", "view": "click"}).alias("event_type"))


@query("SELECT p_partkey, CAST(round_even(p_retailprice, 0) AS INTEGER) AS cost, CAST(NULL AS VARCHAR) AS unit, p_size AS size FROM part")
def e10_struct(spark, sf):
    df = read(spark, sf, "part").select("p_partkey", F.struct(F.col("p_retailprice").alias("price"), F.col("p_size").alias("size")).alias("s"))
    out = evolve.evolve_struct("s", {"price": "double", "size": "int"}, [("cost", "int"), ("unit", "string")], {"price": "cost"})
    return df.select("p_partkey", out.alias("s")).select("p_partkey", "s.*")


@query("SELECT o_orderkey, CAST(100 + 10 * (row_number() OVER (ORDER BY o_totalprice, o_orderkey) - 1) AS BIGINT) AS id FROM orders")
def e11_identity(spark, sf):
    return evolve.assign_identity(read(spark, sf, "orders").select("o_orderkey", "o_totalprice"), ["o_totalprice", "o_orderkey"], "id", start=100, increment=10).select("o_orderkey", "id")


@query("SELECT c_custkey, CAST(CASE WHEN c_custkey % 2 = 0 THEN c_custkey ELSE 1 + (row_number() OVER (ORDER BY c_custkey) - 1) % 7 END AS BIGINT) AS id FROM customer")
def e11_identity_cycle(spark, sf):
    df = read(spark, sf, "customer").select("c_custkey", F.expr("CASE WHEN c_custkey % 2 = 0 THEN c_custkey END AS id"))
    return evolve.assign_identity(df, ["c_custkey"], "id", always=False, start=1, most=7, cycle=True)


YEARS = [PartitionSpec(f"y{y}", f"TIMESTAMP_NTZ '{y}-01-01 00:00:00'", f"TIMESTAMP_NTZ '{y + 2}-01-01 00:00:00'") for y in (1992, 1994, 1996)]
STATES = [PartitionSpec("open", values=("O", "P")), PartitionSpec("other", default=True)]


@query("""
SELECT p, count(*) AS rows FROM (SELECT CASE WHEN o_orderdate >= '1992-01-01' AND o_orderdate < '1998-01-01' THEN 'y' || (1992 + 2 * ((year(o_orderdate) - 1992) // 2)) || CASE WHEN o_orderstatus IN ('O', 'P') THEN '/open' ELSE '/other' END END AS p FROM orders) GROUP BY p""")
def e12_routing(spark, sf):
    routed = partition.route(read(spark, sf, "orders"), [("o_orderdate", YEARS), ("o_orderstatus", STATES)], "p")
    return routed.groupBy("p").agg(F.count("*").alias("rows"))


@query("SELECT o_orderkey FROM orders WHERE NOT (o_orderdate >= '1992-01-01' AND o_orderdate < '1998-01-01')")
def e12_unrouted(spark, sf):
    return partition.unrouted(read(spark, sf, "orders"), [("o_orderdate", YEARS)]).select("o_orderkey")


BOUNDS = "SELECT c_nationkey AS parent, 'p' || c_custkey AS name, c_custkey AS start, c_custkey + 1 + c_custkey % 40 AS \"end\" FROM customer"


@query(f"""
WITH b AS ({BOUNDS})
SELECT parent, name FROM (SELECT *, max("end") OVER (PARTITION BY parent ORDER BY start, name ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM b) WHERE start < m""")
def e13_overlapping_bounds(spark, sf):
    b = read(spark, sf, "customer").select(F.col("c_nationkey").alias("parent"), F.expr("'p' || c_custkey AS name"), F.col("c_custkey").alias("start"), F.expr("c_custkey + 1 + c_custkey % 40 AS end"))
    return partition.overlapping_bounds(b, ["parent"]).select("parent", "name")


@query("SELECT c_nationkey AS parent, c_mktsegment AS value, count(DISTINCT c_custkey % 3) AS partitions FROM customer GROUP BY ALL HAVING count(DISTINCT c_custkey % 3) > 1")
def e13_repeated_values(spark, sf):
    lists = read(spark, sf, "customer").select(F.col("c_nationkey").alias("parent"), F.expr("c_custkey % 3 AS name"), F.col("c_mktsegment").alias("value"))
    return partition.repeated_values(lists, ["parent"])


@query("""
SELECT o_orderkey, CASE WHEN o_totalprice < 100000 THEN 'low' ELSE 'high' END AS old_partition, CASE WHEN o_totalprice < 150000 THEN 'low' ELSE 'high' END AS new_partition FROM orders WHERE o_totalprice >= 100000 AND o_totalprice < 150000""")
def e14_moved_rows(spark, sf):
    at = lambda n: [PartitionSpec("low", end=f"{n}D"), PartitionSpec("high", start=f"{n}D")]
    return partition.moved_rows(read(spark, sf, "orders"), "o_totalprice", at(100000), at(150000)).select("o_orderkey", "old_partition", "new_partition")


@query("SELECT 'p_size' AS \"column\", count(*) FILTER (WHERE p_partkey % 97 = 0) AS nulls FROM part UNION ALL SELECT 'p_name', count(*) FILTER (WHERE p_name IS NULL) FROM part")
def e05_set_not_null(spark, sf):
    df = read(spark, sf, "part").withColumn("p_size", F.expr("CASE WHEN p_partkey % 97 = 0 THEN NULL ELSE p_size END"))
    return evolve.set_not_null(df, ["p_size", "p_name"])


@query("""
WITH u AS (SELECT c_nationkey AS g, c_mktsegment AS label, count(*) AS uses FROM customer GROUP BY ALL),
a AS (SELECT g, label FROM u), b AS (SELECT g, CASE WHEN label = 'BUILDING' AND g % 2 = 0 THEN 'HOUSING' ELSE label END AS label FROM u)
SELECT coalesce(a.g, b.g) AS g, coalesce(a.label, b.label) AS label, CASE WHEN a.g IS NULL THEN 'added' ELSE 'rejected' END AS change, coalesce(u.uses, 0) AS uses
FROM a FULL JOIN b ON a.g = b.g AND a.label = b.label LEFT JOIN u ON u.g = coalesce(a.g, b.g) AND u.label = coalesce(a.label, b.label) WHERE a.g IS NULL OR b.g IS NULL""")
def e09_enum_changes(spark, sf):
    uses = read(spark, sf, "customer").groupBy(F.col("c_nationkey").alias("g"), F.col("c_mktsegment").alias("label")).agg(F.count("*").alias("uses"))
    now = uses.select("g", "label")
    wanted = now.withColumn("label", F.expr("CASE WHEN label = 'BUILDING' AND g % 2 = 0 THEN 'HOUSING' ELSE label END"))
    return diff.enum_changes(now, wanted, uses, ["g"])


@query(FLEET + """SELECT c.db_id, c."table", c.name, 'recreate' AS action FROM c JOIN c2 ON c.db_id = c2.db_id AND c."table" = c2."table" AND c.name = c2.name AND c.type_name <> c2.type_name WHERE c.n % 2 = 1
UNION ALL SELECT c.db_id, c."table", c.name, 'alter' FROM c JOIN c2 ON c.db_id = c2.db_id AND c."table" = c2."table" AND c.name = c2.name AND c.type_name <> c2.type_name WHERE c.n % 2 = 0""")
def e15_swap(spark, sf):
    pick = lambda f: f["columns"].select("db_id", "table", "name", "type_name")
    key = ["db_id", "table", "name"]
    found = diff.keyed_diff(pick(fleet(spark, sf)), pick(fleet(spark, sf, True)), key)
    return diff.swap_actions(found, key, F.expr("cast(substr(`table`, 2) AS bigint) % 2 = 0"), allow_drops=True)


@query(FLEET + """, x AS (SELECT db_id, "table", name, CASE WHEN ordinal % 3 = 0 THEN 'drop' ELSE 'alter' END AS action, ordinal % 2 = 0 AS generated FROM c)
SELECT db_id, "table", name, CAST(row_number() OVER (PARTITION BY db_id, "table" ORDER BY CASE WHEN action = 'drop' AND generated THEN 0 WHEN action <> 'drop' THEN 1 ELSE 2 END, name) AS INTEGER) AS step FROM x""")
def o03_table_steps(spark, sf):
    c = fleet(spark, sf)["columns"]
    changes = c.select("db_id", "table", "name", F.expr("CASE WHEN ordinal % 3 = 0 THEN 'drop' ELSE 'alter' END AS action"), F.expr("ordinal % 2 = 0 AS generated"))
    return diff.table_steps(changes).select("db_id", "table", "name", "step")


# -- policies -----------------------------------------------------------------------

POLICIES = [
    PolicySpec("segment", "select", using="c_mktsegment = 'BUILDING'"),
    PolicySpec("near", "all", using="c_nationkey < 5"),
    PolicySpec("solvent", "all", permissive=False, using="c_acctbal >= 0"),
    PolicySpec("auditor", "select", roles=("auditor",), using="true"),
]


@query(f"SELECT c_custkey FROM (SELECT *, {NULL_BALANCE} AS b FROM customer) WHERE (c_mktsegment = 'BUILDING' OR c_nationkey < 5) AND coalesce(b >= 0, false)")
def r01_read_filter(spark, sf):
    df = read(spark, sf, "customer").withColumn("c_acctbal", F.expr(NULL_BALANCE))
    return df.where(policy.read_filter(POLICIES, "clerk")).select("c_custkey")


@query("SELECT c_custkey, c_nationkey < 5 AND c_acctbal >= 0 AS allowed FROM customer")
def r02_write_check(spark, sf):
    good, bad = policy.write_check(read(spark, sf, "customer"), POLICIES, "clerk", "insert")
    return good.select("c_custkey", F.lit(True).alias("allowed")).unionByName(bad.select("c_custkey", F.lit(False).alias("allowed")))


@query("""
SELECT 'clerk' AS role, count(*) AS rows FROM customer WHERE (c_mktsegment = 'BUILDING' OR c_nationkey < 5) AND c_acctbal >= 0
UNION ALL SELECT 'auditor', count(*) FROM customer WHERE c_acctbal >= 0""")
def r03_roles(spark, sf):
    return policy.visible_counts(read(spark, sf, "customer"), POLICIES, ["clerk", "auditor"])


POLICY_ROWS = "SELECT 't' || c_custkey AS \"table\", 'p' AS name, c_custkey % 3 <> {a} AS permissive, CASE WHEN c_custkey % 7 = {b} THEN 'r' ELSE '*' END AS command, CASE WHEN c_custkey % 5 = {c} THEN NULL ELSE 'x > ' || c_custkey % 11 END AS using_expr, CASE WHEN c_custkey % 13 = {d} THEN 'y' END AS check_expr FROM customer WHERE c_custkey % 17 <> {e}"


@query(f"""
WITH a AS ({POLICY_ROWS.format(a=0, b=1, c=2, d=3, e=4)}), b AS ({POLICY_ROWS.format(a=1, b=1, c=3, d=4, e=5)})
SELECT coalesce(a."table", b."table") AS "table", CASE WHEN a.name IS NULL THEN 'create' WHEN b.name IS NULL THEN 'drop'
  WHEN a.command <> b.command OR a.permissive <> b.permissive OR a.using_expr IS NOT NULL AND b.using_expr IS NULL OR a.check_expr IS NOT NULL AND b.check_expr IS NULL THEN 'recreate' ELSE 'alter' END AS action
FROM a FULL JOIN b ON a."table" = b."table" WHERE a IS DISTINCT FROM b""")
def r04_policy_diff(spark, sf):
    rows = lambda **k: read(spark, sf, "customer").where(f"c_custkey % 17 <> {k['e']}").select(F.expr("'t' || c_custkey AS table"), F.lit("p").alias("name"), F.expr(f"c_custkey % 3 <> {k['a']} AS permissive"), F.expr(f"CASE WHEN c_custkey % 7 = {k['b']} THEN 'r' ELSE '*' END AS command"), (F.array().cast("array<string>") if k["a"] else F.array(F.lit("public"))).alias("roles"), F.expr(f"CASE WHEN c_custkey % 5 = {k['c']} THEN NULL ELSE 'x > ' || c_custkey % 11 END AS using_expr"), F.expr(f"CASE WHEN c_custkey % 13 = {k['d']} THEN 'y' END AS check_expr"))
    return diff.policy_diff(rows(a=0, b=1, c=2, d=3, e=4), rows(a=1, b=1, c=3, d=4, e=5)).select("table", "action")


@query("""
SELECT 'clerk' AS role, count(*) FILTER (WHERE n AND NOT o) AS gained, count(*) FILTER (WHERE o AND NOT n) AS lost FROM (SELECT (c_mktsegment = 'BUILDING' OR c_nationkey < 5) AND c_acctbal >= 0 AS o, c_nationkey < 5 OR c_custkey % 3 = 0 AS n FROM customer)
UNION ALL SELECT 'auditor', count(*) FILTER (WHERE n AND NOT o), count(*) FILTER (WHERE o AND NOT n) FROM (SELECT c_acctbal >= 0 AS o, c_nationkey < 5 OR c_custkey % 3 = 0 AS n FROM customer)""")
def r05_policy_impact(spark, sf):
    after = [PolicySpec("near", "all", using="c_nationkey < 5"), PolicySpec("third", "select", using="c_custkey % 3 = 0")]
    return policy.impact(read(spark, sf, "customer"), POLICIES, after, ["clerk", "auditor"])


# -- catalogs ------------------------------------------------------------------------


@query(FLEET + "SELECT db_id, count(*) AS n FROM t WHERE (name LIKE 't1%' OR regexp_matches(name, '^t[2-3].$')) AND name NOT LIKE '%7' GROUP BY db_id")
def p01_name_filter(spark, sf):
    t = fleet(spark, sf)["tables"]
    return snapshot.filter_names(t, ["t1*", "t[2-3]?"], ["*7"]).groupBy("db_id").agg(F.count("*").alias("n"))


def all_objects(f: dict[str, DataFrame]) -> DataFrame:
    parts = [f[k].select("db_id", "schema", "name", F.lit(kind).alias("kind")) for k, kind in (("tables", "table"), ("constraints", "constraint"), ("references", "reference"))]
    return reduce(DataFrame.unionByName, parts)


OBJECTS = "o AS (SELECT db_id, schema, name, 'table' AS kind FROM t UNION ALL SELECT db_id, schema, name || '_pkey', 'constraint' FROM t UNION ALL SELECT db_id, schema, name, 'reference' FROM r)"


@query(FLEET + f", {OBJECTS} SELECT kind, count(*) AS n FROM o WHERE kind IN ('table', 'reference') GROUP BY kind")
def p02_kind_filter(spark, sf):
    return snapshot.filter_kinds(all_objects(fleet(spark, sf)), ["table", "reference"], ["table"]).groupBy("kind").agg(F.count("*").alias("n"))


@query(FLEET + ", s AS (SELECT db_id, name, CASE WHEN n % 3 = 0 THEN 'audit' ELSE 'app' END AS schema FROM t) SELECT db_id, name, CASE schema WHEN 'app' THEN 'prod' ELSE schema END AS schema FROM s WHERE schema IN ('app', 'prod')")
def p03_p04_schemas(spark, sf):
    t = fleet(spark, sf)["tables"].withColumn("schema", F.expr("CASE WHEN n % 3 = 0 THEN 'audit' ELSE 'app' END")).select("db_id", "name", "schema")
    mapped = {"app": "prod"}
    return snapshot.remap_schemas(snapshot.filter_schemas(t, ["app"], mapped), mapped)


@query(FLEET + "SELECT db_id, name FROM t WHERE n % 6 <> 0")
def p05_ignore(spark, sf):
    t = fleet(spark, sf)["tables"]
    return snapshot.ignore(t, t.where("n % 6 = 0"), ["db_id", "name"]).select("db_id", "name")


@query(FLEET + "SELECT db_id, count(*) AS n FROM t WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.db_id = t.db_id AND r.ref_table = t.name) GROUP BY db_id")
def p06_unreferenced(spark, sf):
    f = fleet(spark, sf)
    return snapshot.ignore(f["tables"], f["references"].select("db_id", F.col("ref_table").alias("name")), ["db_id", "name"]).groupBy("db_id").agg(F.count("*").alias("n"))


@query("SELECT c_custkey AS id, c_name AS name, c_acctbal AS balance FROM customer UNION ALL SELECT s_suppkey, s_name, s_acctbal FROM supplier UNION ALL SELECT n_nationkey, n_name, NULL FROM nation")
def u05_parent_read(spark, sf):
    parent = read(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"))
    first = read(spark, sf, "supplier").select(F.col("s_acctbal").alias("balance"), F.col("s_name").alias("name"), F.col("s_suppkey").alias("id"), "s_nationkey")
    second = read(spark, sf, "nation").select(F.col("n_nationkey").cast("bigint").alias("id"), F.col("n_name").alias("name"))
    return snapshot.read_parent(parent, [first, second])


@query(FLEET + """SELECT db_id, "table", string_agg(name, ',' ORDER BY ordinal) AS columns FROM c GROUP BY ALL""")
def a01_ordered_columns(spark, sf):
    return snapshot.ordered_columns(fleet(spark, sf)["columns"], ["db_id", "table"], "ordinal", "name").select("db_id", "table", F.array_join("columns", ",").alias("columns"))


@query(FLEET + "SELECT db_id, 'active,inactive,pending' AS labels FROM (SELECT DISTINCT db_id FROM t2)")
def a02_enum_labels(spark, sf):
    e = fleet(spark, sf, True)["enums"]
    return snapshot.ordered_columns(e, ["db_id", "name"], "ordinal", "label").select("db_id", F.array_join("columns", ",").alias("labels"))


@query("SELECT c_nationkey, coalesce(string_agg(DISTINCT CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment END, ',' ORDER BY CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment END), 'public') AS roles FROM customer GROUP BY ALL")
def a03_role_sets(spark, sf):
    rows = read(spark, sf, "customer").select("c_nationkey", F.expr("CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment END AS role"))
    return snapshot.role_sets(rows, ["c_nationkey"]).select("c_nationkey", F.array_join("roles", ",").alias("roles"))


@query(FLEET + f", {OBJECTS} SELECT db_id, count(*) FILTER (WHERE kind = 'table') AS \"table\", count(*) FILTER (WHERE kind = 'constraint') AS \"constraint\", count(*) FILTER (WHERE kind = 'reference') AS reference FROM o GROUP BY db_id")
def a04_object_counts(spark, sf):
    return diff.pivot_counts(all_objects(fleet(spark, sf)), ["db_id"], ["table", "constraint", "reference"])


@query(FLEET + "SELECT db_id, bool_or(n % 11 <> 0 AND n % 5 = 0) AS drifted FROM t GROUP BY db_id")
def a05_drift(spark, sf):
    pick = lambda f: f["columns"].select("db_id", "table", "name", "type_name")
    key = ["db_id", "table", "name"]
    a, b = pick(fleet(spark, sf)), pick(fleet(spark, sf, True)).where("name <> 'extra'")
    report = diff.change_report(diff.keyed_diff(a, b, key), key, "column")
    found = report.groupBy("db_id").agg(F.bool_or("executable").alias("drifted"))
    return a.select("db_id").distinct().join(found, "db_id", "left").select("db_id", F.coalesce("drifted", F.lit(False)).alias("drifted"))


@query(FLEET + """, o AS (SELECT db_id, schema, name, 'table' AS kind FROM t UNION ALL SELECT db_id, schema, CASE WHEN n % 23 = 0 THEN 't' || n ELSE 'v' || n END, 'view' FROM t UNION ALL SELECT db_id, schema, 'v' || n, 'view' FROM t WHERE n % 29 = 0)
SELECT db_id, schema, name, string_agg(DISTINCT kind, ',' ORDER BY kind) AS kinds, count(*) AS n FROM o GROUP BY ALL HAVING count(*) > 1""".replace("GROUP BY ALL HAVING", "GROUP BY db_id, schema, name HAVING"))
def a06_name_collisions(spark, sf):
    t = fleet(spark, sf)["tables"]
    base = ["db_id", "schema"]
    objects = t.select(*base, "name", F.lit("table").alias("kind")).unionByName(t.select(*base, F.expr("CASE WHEN n % 23 = 0 THEN 't' || n ELSE 'v' || n END AS name"), F.lit("view").alias("kind"))).unionByName(t.where("n % 29 = 0").select(*base, F.expr("'v' || n AS name"), F.lit("view").alias("kind")))
    return snapshot.name_collisions(objects)


@query(FLEET + """, o AS (SELECT db_id, schema, "table", name, 'f' AS type FROM r UNION ALL SELECT db_id, schema, name, name || '_pkey', 'p' FROM t)
SELECT db_id, "table", name, CAST(row_number() OVER (PARTITION BY db_id ORDER BY schema, "table", CASE type WHEN 'p' THEN 1 ELSE 5 END, name) AS INTEGER) AS position FROM o""")
def o01_catalog_order(spark, sf):
    f = fleet(spark, sf)
    objects = f["references"].select("db_id", "schema", "table", "name", F.lit("f").alias("type")).unionByName(f["constraints"].select("db_id", "schema", "table", "name", "type"))
    return snapshot.catalog_order(objects).select("db_id", "table", "name", "position")


# -- dependencies ---------------------------------------------------------------------

LEVELS = f"""
, edge AS (SELECT db_id, "table" AS src, ref_table AS dst FROM r WHERE "table" <> ref_table AND EXISTS (SELECT 1 FROM t WHERE t.db_id = r.db_id AND t.name = ref_table)),
bad AS (SELECT DISTINCT t.db_id, t.name FROM t WHERE db_id % 19 = 0 AND i > 0 AND EXISTS (SELECT 1 FROM t x WHERE x.db_id = t.db_id AND x.i = 2)),
"""
CHAIN = FLEET.replace("WITH t AS", "WITH RECURSIVE t AS") + """
, edge AS (SELECT db_id, "table" AS src, ref_table AS dst FROM r JOIN t USING (db_id) WHERE t.name = ref_table AND "table" <> ref_table),
walk AS (SELECT db_id, name AS node, 0 AS level FROM t WHERE NOT EXISTS (SELECT 1 FROM edge e WHERE e.db_id = t.db_id AND e.src = t.name)
  UNION ALL SELECT e.db_id, e.src, level + 1 FROM walk w JOIN edge e ON e.db_id = w.db_id AND e.dst = w.node)
"""


def table_edges(f: dict[str, DataFrame]) -> tuple[DataFrame, DataFrame]:
    nodes = f["tables"].select("db_id", F.col("name").alias("node"))
    objects = f["tables"].select("db_id", "schema", "name")
    return nodes, graph.reference_edges(f["columns"], f["references"], objects)


@query(CHAIN + "SELECT t.db_id, t.name AS node, max(level) AS level FROM t LEFT JOIN walk w ON w.db_id = t.db_id AND w.node = t.name GROUP BY ALL")
def g01_levels(spark, sf):
    return graph.levels(*table_edges(fleet(spark, sf)))


@query(CHAIN + """, l AS (SELECT t.db_id, t.name AS node, max(level) AS level FROM t LEFT JOIN walk w ON w.db_id = t.db_id AND w.node = t.name GROUP BY ALL)
SELECT db_id, node, CAST(row_number() OVER (PARTITION BY db_id ORDER BY level NULLS LAST, node) AS INTEGER) AS pos FROM l""")
def g01_positions(spark, sf):
    return graph.positions(graph.levels(*table_edges(fleet(spark, sf)))).select("db_id", "node", "pos")


@query(CHAIN + "SELECT t.db_id, t.name AS node FROM t WHERE db_id % 19 = 0 AND i IN (1, 2) AND EXISTS (SELECT 1 FROM t x WHERE x.db_id = t.db_id AND x.i = 1) AND EXISTS (SELECT 1 FROM t x WHERE x.db_id = t.db_id AND x.i = 2)")
def g02_cycles(spark, sf):
    return graph.cycle_members(*table_edges(fleet(spark, sf)))


@query(CHAIN + "SELECT db_id, src, dst FROM edge")
def g03_edges(spark, sf):
    return table_edges(fleet(spark, sf))[1]


@query(CHAIN + """, hit AS (SELECT db_id, name AS node FROM t WHERE i = 3
  UNION SELECT e.db_id, e.src FROM hit h JOIN edge e ON e.db_id = h.db_id AND e.dst = h.node)
SELECT db_id, node FROM hit""")
def g05_impact(spark, sf):
    f = fleet(spark, sf)
    return graph.impact(table_edges(f)[1], f["tables"].where("i = 3").select("db_id", F.col("name").alias("node"))).select("db_id", "node")


@query(CHAIN + """, l AS (SELECT t.db_id, t.name AS node, t.n, max(level) AS level FROM t LEFT JOIN walk w ON w.db_id = t.db_id AND w.node = t.name GROUP BY ALL),
p AS (SELECT *, row_number() OVER (PARTITION BY db_id ORDER BY level NULLS LAST, node) AS pos, CASE WHEN n % 11 = 0 THEN 'drop' WHEN n % 5 = 0 THEN 'alter' WHEN n % 3 = 0 THEN 'drop_reference' ELSE 'add_reference' END AS action FROM l)
SELECT db_id, node, action, CAST(row_number() OVER (PARTITION BY db_id ORDER BY CASE action WHEN 'drop_reference' THEN 0 WHEN 'drop' THEN 1 WHEN 'alter' THEN 2 ELSE 3 END, CASE WHEN action = 'drop' THEN -pos ELSE pos END, n) AS INTEGER) AS step FROM p""")
def o02_change_order(spark, sf):
    f = fleet(spark, sf)
    at = graph.positions(graph.levels(*table_edges(f)))
    changes = f["tables"].select("db_id", F.col("name").alias("node"), F.expr("CASE WHEN n % 11 = 0 THEN 'drop' WHEN n % 5 = 0 THEN 'alter' WHEN n % 3 = 0 THEN 'drop_reference' ELSE 'add_reference' END AS action"), F.col("n").alias("seq"))
    return graph.change_order(changes, at).select("db_id", "node", "action", "step")


# -- views ---------------------------------------------------------------------------

VIEWS = {
    "spend": "SELECT o_custkey AS k, count(*) AS n, round(sum(o_totalprice), 2) AS total, max(o_orderdate) AS last FROM orders GROUP BY o_custkey HAVING count(*) > 3",
    "ranked": "SELECT k, n, total, sum(n) OVER (PARTITION BY n) AS same FROM spend",
    "told": "WITH c AS (SELECT c_custkey, c_name, c_nationkey FROM customer) SELECT c_name, n, total, same, coalesce((SELECT n_name FROM nation WHERE n_nationkey = c.c_nationkey), '?') AS home FROM ranked JOIN c ON k = c_custkey WHERE EXISTS (SELECT 1 FROM events WHERE user_id = k AND event_type = 'purchase')",
}


@query("WITH " + ", ".join(f"{n} AS ({q})" for n, q in VIEWS.items()).replace("sum(n) OVER", "CAST(sum(n) OVER").replace("(PARTITION BY n)", "(PARTITION BY n) AS BIGINT)") + " SELECT * FROM told")
def v01_view_chain(spark, sf):
    return views.run_views(spark, {n: read(spark, sf, n) for n in ("orders", "customer", "nation", "events")}, VIEWS, "told")


@query(f"""
WITH a AS ({ORDERS_NOW}), b AS ({ORDERS_NEXT}), x AS (SELECT o_custkey, count(*) AS n FROM a GROUP BY 1), y AS (SELECT o_custkey, count(*) AS n FROM b GROUP BY 1)
SELECT o_custkey, n, CAST(sum(s) AS BIGINT) AS surplus FROM (SELECT *, 1 AS s FROM y UNION ALL SELECT *, -1 FROM x) GROUP BY o_custkey, n HAVING sum(s) <> 0""")
def v03_refresh_delta(spark, sf):
    told = lambda df: df.groupBy("o_custkey").agg(F.count("*").alias("n"))
    view = views.MaterializedView(spark, "order_counts")
    view.refresh(told(orders_now(spark, sf)))
    return view.delta(told(orders_next(spark, sf)))


@query("SELECT n, count(*) AS rows FROM (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) GROUP BY n HAVING count(*) > 1")
def v05_unique_on_view(spark, sf):
    view = views.MaterializedView(spark, "counts")
    view.refresh(read(spark, sf, "orders").groupBy("o_custkey").agg(F.count("*").alias("n")))
    return audit.duplicate_keys(view.read(), KeySpec("u", ("n",)))


@query("SELECT event_id, u.k FROM events, (SELECT 0 AS k UNION ALL SELECT 1) u WHERE u.k <= CAST(json_extract_string(props, '$.k') AS INTEGER) % 2")
def j13_lateral_json(spark, sf):
    e = read(spark, sf, "events").withColumn("doc", F.expr("concat('[', array_join(transform(sequence(0, cast(get_json_object(props, '$.k') AS int) % 2), x -> concat('{\"k\":', x, '}')), ','), ']')"))
    rows = F.from_json("doc", "array<struct<k: int>>")
    return e.select("event_id", F.inline_outer(rows))


@query("SELECT event_type, count(*) FILTER (WHERE value > 100) AS big, round(sum(value) FILTER (WHERE event_id % 2 = 0), 3) AS even, count(*) AS n FROM events GROUP BY event_type")
def a09_filtered_aggregate(spark, sf):
    return spark.sql("SELECT event_type, count(*) FILTER (WHERE value > 100) AS big, round(sum(value) FILTER (WHERE event_id % 2 = 0), 3) AS even, count(*) AS n FROM {events} GROUP BY event_type", events=read(spark, sf, "events"))


@query("SELECT c_nationkey, string_agg(c_name, ';' ORDER BY c_acctbal DESC, c_custkey) AS names FROM customer GROUP BY c_nationkey")
def a10_ordered_strings(spark, sf):
    return spark.sql("SELECT c_nationkey, listagg(c_name, ';') WITHIN GROUP (ORDER BY c_acctbal DESC, c_custkey) AS names FROM {customer} GROUP BY c_nationkey", customer=read(spark, sf, "customer"))


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, CAST(grouping(l_returnflag) AS TINYINT) AS g FROM lineitem GROUP BY GROUPING SETS ((l_returnflag, l_linestatus), (l_returnflag), ())")
def a11_grouping_sets(spark, sf):
    return spark.sql("SELECT l_returnflag, l_linestatus, count(*) AS n, grouping(l_returnflag) AS g FROM {lineitem} GROUP BY GROUPING SETS ((l_returnflag, l_linestatus), (l_returnflag), ())", lineitem=read(spark, sf, "lineitem"))


@query("SELECT o_orderkey, o_custkey, count(*) OVER w AS n, round(o_totalprice - min(o_totalprice) OVER w, 2) AS above FROM orders WINDOW w AS (PARTITION BY o_custkey)")
def w01_windows(spark, sf):
    return spark.sql("SELECT o_orderkey, o_custkey, count(*) OVER w AS n, round(o_totalprice - min(o_totalprice) OVER w, 2) AS above FROM {orders} WINDOW w AS (PARTITION BY o_custkey)", orders=read(spark, sf, "orders"))


@query("SELECT DISTINCT ON (o_custkey) o_custkey, o_orderkey, round(o_totalprice, 2) AS price FROM orders ORDER BY o_custkey, o_totalprice DESC, o_orderkey")
def w02_distinct_on(spark, sf):
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return read(spark, sf, "orders").withColumn("n", F.row_number().over(w)).where("n = 1").select("o_custkey", "o_orderkey", F.round("o_totalprice", 2).alias("price"))


@query(f"SELECT c_custkey, b FROM (SELECT c_custkey, {NULL_BALANCE} AS b FROM customer) ORDER BY b DESC NULLS FIRST, c_custkey LIMIT 50 OFFSET 5")
def o04_o05_order_limit(spark, sf):
    df = read(spark, sf, "customer").select("c_custkey", F.expr(NULL_BALANCE).alias("b"))
    return df.orderBy(logic.ordered("b", descending=True), "c_custkey").offset(5).limit(50)


@query("SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
def u01_union(spark, sf):
    return read(spark, sf, "customer").select(F.col("c_nationkey").alias("k")).union(read(spark, sf, "supplier").select("s_nationkey")).distinct()


@query("SELECT o_custkey AS k FROM orders INTERSECT SELECT user_id FROM events")
def u02_intersect(spark, sf):
    return read(spark, sf, "orders").select(F.col("o_custkey").alias("k")).intersect(read(spark, sf, "events").select("user_id"))


@query("SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders")
def u03_except(spark, sf):
    return read(spark, sf, "customer").select(F.col("c_custkey").alias("k")).subtract(read(spark, sf, "orders").select("o_custkey"))


# -- gates and streams ------------------------------------------------------------------

GATE = [Rule("small", "value < 400"), Rule("known", "event_type IN ('click', 'view', 'signup', 'purchase')")]
GATED = "SELECT event_id, concat_ws(',', CASE WHEN NOT value < 400 THEN 'small' END, CASE WHEN event_type NOT IN ('click', 'view', 'signup', 'purchase') THEN 'known' END{more}) AS reasons FROM events"


def told(kept: DataFrame, aside: DataFrame) -> DataFrame:
    return kept.select("event_id", F.lit("").alias("reasons")).unionByName(aside.select("event_id", F.array_join("_violations", ",").alias("reasons")))


@query(GATED.format(more=""))
def s04_gate(spark, sf):
    return told(*snapshot.gate(read(spark, sf, "events"), GATE))


@query(GATED.format(more=", CASE WHEN user_id % 10 = 3 THEN 'reference' END"))
def t01_streaming_gate(spark, sf):
    parent = read(spark, sf, "customer").where("c_custkey % 10 <> 3")
    return told(*stream_gate.gate_stream(stream_gate.file_stream(spark, sf, "events"), GATE, parent, "user_id", "c_custkey"))


@query("SELECT user_id, event_type FROM events GROUP BY ALL")
def t02_streaming_unique(spark, sf):
    return stream_gate.unique_stream(stream_gate.file_stream(spark, sf, "events"), ["user_id", "event_type"], "ts", "3650 days").select("user_id", "event_type")


from covenant import queries_catalog, queries_graphs, queries_rules, queries_sources, queries_views  # noqa: E402, F401  register their queries here
