"""Registered queries of stored snapshots and views: difference by hash trees, views
that follow changes of their tables, and versions that other sessions read."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from covenant.operators import merkle
from covenant.operators.keyindex import KeyIndex
from covenant.plans.incremental import Group, Join, Select, Source, signed_change
from covenant.plans.store import StoredView
from covenant.queries import DIFF, ORDERS_NEXT, ORDERS_NOW, orders_next, orders_now, query, read
from covenant.shared import shared_dir, stored
from covenant.streaming import gate


def new_path(spark, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@query(DIFF + "SELECT o_orderkey, change, CASE WHEN change = 'alter' THEN new.o_totalprice - old.o_totalprice END AS raised FROM d WHERE change <> 'same'")
def u04_merkle_diff(spark, sf):
    old = merkle.write_tree(orders_now(spark, sf), ["o_orderkey"], new_path(spark, "tree"))
    new = merkle.write_tree(orders_next(spark, sf), ["o_orderkey"], new_path(spark, "tree"), like=old)
    found = merkle.tree_diff(merkle.open_tree(spark, old.path), new)
    return found.select("o_orderkey", "change", (F.col("new_o_totalprice") - F.col("old_o_totalprice")).alias("raised"))


#: Lines as a multiset without a key; some come twice, some lose a copy.
LINES = "SELECT l_orderkey, l_suppkey, l_quantity FROM lineitem"


@query(f"""
WITH a AS ({LINES}), b AS ({LINES} WHERE l_orderkey % 211 <> 0 UNION ALL {LINES} WHERE l_orderkey % 199 = 0)
SELECT l_orderkey, l_suppkey, l_quantity, CAST(sum(s) AS BIGINT) AS surplus FROM (SELECT *, 1 AS s FROM b UNION ALL SELECT *, -1 FROM a) GROUP BY ALL HAVING sum(s) <> 0""")
def u04_merkle_surplus(spark, sf):
    lines = read(spark, sf, "lineitem").select("l_orderkey", "l_suppkey", "l_quantity")
    changed = lines.where("l_orderkey % 211 <> 0").unionByName(lines.where("l_orderkey % 199 = 0"))
    old = merkle.write_tree(lines, ["l_orderkey"], new_path(spark, "tree"))
    return merkle.tree_surplus(old, merkle.write_tree(changed, ["l_orderkey"], new_path(spark, "tree"), like=old))


#: Orders of customers by nation; prices in whole units, whose sums are exact.
BY_NATION = Group(
    Join(Select(Source("orders"), "o_orderpriority <> '5-LOW'", {"k": "o_custkey", "key": "o_orderkey", "price": "cast(floor(o_totalprice) AS bigint)"}), Select(Source("customer"), columns={"k": "c_custkey", "nation": "c_nationkey"}), ("k",)),
    ("nation",), "orders", {"total": "price"}, {"first": "key"}, {"dearest": "price"},
)
NATION_SQL = """SELECT c_nationkey AS nation, count(*) AS orders, CAST(sum(floor(o_totalprice)) AS BIGINT) AS total, min(o_orderkey) AS first, CAST(max(floor(o_totalprice)) AS BIGINT) AS dearest
FROM {orders} JOIN {customer} ON o_custkey = c_custkey WHERE o_orderpriority <> '5-LOW' GROUP BY c_nationkey"""
#: Customers move to the next nation.
MOVED = "SELECT * REPLACE (CASE WHEN c_custkey % 113 = 0 THEN (c_nationkey + 1) % 25 ELSE c_nationkey END AS c_nationkey) FROM customer"


def moved(spark, sf):
    return read(spark, sf, "customer").withColumn("c_nationkey", F.expr("CASE WHEN c_custkey % 113 = 0 THEN (c_nationkey + 1) % 25 ELSE c_nationkey END"))


@query("WITH b AS (" + ORDERS_NEXT + "), m AS (" + MOVED + ") " + NATION_SQL.format(orders="b", customer="m"))
def v03_incremental_groups(spark, sf):
    """Orders come, go and change while customers move: both sides of a join change
    at once, and some groups lose their least or greatest value."""
    view = StoredView(spark, new_path(spark, "by-nation"), BY_NATION)
    before = {"orders": orders_now(spark, sf), "customer": read(spark, sf, "customer")}
    after = {"orders": orders_next(spark, sf), "customer": moved(spark, sf)}
    view.refresh(before)
    view.refresh(after, {t: signed_change(before[t], after[t]) for t in before})
    return view.read()


#: A view without groups: rows as a multiset.
PAIRS = Join(Select(Source("orders"), columns={"k": "o_custkey", "priority": "o_orderpriority"}), Select(Source("customer"), "c_acctbal > 0", {"k": "c_custkey", "segment": "c_mktsegment"}), ("k",))


@query(f"WITH b AS ({ORDERS_NEXT}) SELECT o_custkey AS k, o_orderpriority AS priority, c_mktsegment AS segment FROM b JOIN customer ON o_custkey = c_custkey WHERE c_acctbal > 0")
def v03_incremental_rows(spark, sf):
    view = StoredView(spark, new_path(spark, "pairs"), PAIRS)
    customer, before, after = read(spark, sf, "customer"), orders_now(spark, sf), orders_next(spark, sf)
    view.refresh({"orders": before, "customer": customer})
    view.refresh({"orders": after, "customer": customer}, {"orders": signed_change(before, after)})
    return view.read()


@query(f"WITH a AS ({ORDERS_NOW}), b AS ({ORDERS_NEXT}) SELECT 1 AS version, * FROM ({NATION_SQL.format(orders='a', customer='customer')}) UNION ALL SELECT 2, * FROM ({NATION_SQL.format(orders='b', customer='customer')})")
def v02_versions(spark, sf):
    """Another session reads both versions of a view that this one committed."""
    path, customer = new_path(spark, "versions"), read(spark, sf, "customer")
    view = StoredView(spark, path, BY_NATION)
    view.refresh({"orders": orders_now(spark, sf), "customer": customer})
    view.refresh({"orders": orders_next(spark, sf), "customer": customer}, {"orders": signed_change(orders_now(spark, sf), orders_next(spark, sf))})
    other = StoredView(spark.newSession(), path, BY_NATION)
    return other.read(1).select(F.lit(1).alias("version"), "*").unionByName(other.read().select(F.lit(2).alias("version"), "*"))


#: Orders come in five batches; some come again in the next one, some twice in one.
BATCHES = 5
ARRIVALS = f"SELECT o_orderkey % {BATCHES} AS batch, o_orderkey FROM orders UNION ALL SELECT o_orderkey % {BATCHES} + 1, o_orderkey FROM orders WHERE o_orderkey % 50 < 3 UNION ALL SELECT o_orderkey % {BATCHES}, o_orderkey FROM orders WHERE o_orderkey % 77 = 0"


@query(f"""
WITH a AS (SELECT batch, o_orderkey, count(*) AS rows FROM ({ARRIVALS}) GROUP BY ALL),
m AS (SELECT *, min(batch) OVER (PARTITION BY o_orderkey) < batch AS known FROM a)
SELECT batch, o_orderkey, rows, CASE WHEN known THEN 'known' ELSE 'repeated' END AS reason FROM m WHERE known OR rows > 1""")
def c02_kept_index(spark, sf):
    """Each batch is checked against the keys of all before it, without their rows."""
    orders = read(spark, sf, "orders").select((F.col("o_orderkey") % BATCHES).alias("batch"), "o_orderkey")
    arrivals = orders.unionByName(orders.where("o_orderkey % 50 < 3").withColumn("batch", F.col("batch") + 1)).unionByName(orders.where("o_orderkey % 77 = 0"))
    index, out = KeyIndex(spark, new_path(spark, "keys"), [("o_orderkey", "bigint")], 16), None
    for n in range(BATCHES + 1):
        batch = arrivals.where(F.col("batch") == n)
        found = stored(index.clashes(batch).select(F.lit(n).cast("long").alias("batch"), "o_orderkey", "rows", "reason"), "clashes")
        index.add(batch)
        out = found if out is None else out.unionByName(found)
    return out


#: Purchases refer to a signup of their user; what is younger than this is still held.
HELD = "7 days"
SURE = "(SELECT least(max(ts) FILTER (WHERE event_type = 'signup'), max(ts) FILTER (WHERE event_type = 'purchase')) FROM events) - INTERVAL 7 DAY"


@query(f"""
SELECT event_id, CASE WHEN user_id IS NULL OR EXISTS (SELECT 1 FROM events p WHERE p.event_type = 'signup' AND p.user_id = c.user_id AND p.ts >= c.ts - INTERVAL 5 DAY AND p.ts <= c.ts + INTERVAL 1 DAY) THEN 'passed' ELSE 'aside' END AS went
FROM (SELECT event_id, ts, CASE WHEN event_id % 41 = 0 THEN NULL ELSE user_id END AS user_id FROM events WHERE event_type = 'purchase') c WHERE ts < {SURE}""")
def t01_streaming_parent(spark, sf):
    """Both sides are streams: a purchase passes with a signup of five days before it
    to a day after it, and is put aside once that day is over."""
    events = gate.file_stream(spark, sf, "events")
    child = events.where("event_type = 'purchase'").select("event_id", "ts", F.expr("CASE WHEN event_id % 41 = 0 THEN NULL ELSE user_id END AS user_id"))
    parent = events.where("event_type = 'signup'").select("user_id", "ts")
    place = new_path(spark, "parents")
    gate.parent_stream(child, ["event_id"], parent, "user_id", "user_id", "ts", "ts", "5 days", "1 day", place)
    sure = read(spark, sf, "events").groupBy().agg(F.least(*(F.max(F.when(F.col("event_type") == t, F.col("ts"))) for t in ("signup", "purchase"))).alias("top")).select((F.col("top") - F.expr(f"INTERVAL {HELD}")).alias("sure"))
    went = [gate.written(spark, f"{place}/{x}", "event_id bigint, ts timestamp_ntz").select("event_id", "ts", F.lit(x).alias("went")) for x in ("passed", "aside")]
    return went[0].unionByName(went[1]).join(F.broadcast(sure), F.col("ts") < F.col("sure")).select("event_id", "went")


@query("""
SELECT event_id, CASE WHEN row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) = 1 THEN 'passed' ELSE 'repeated' END AS went FROM events""")
def t02_unique_gate(spark, sf):
    """Repeats are put aside, not lost."""
    place, events = new_path(spark, "unique"), gate.file_stream(spark, sf, "events").select("event_id", "ts", "user_id", "event_type")
    gate.unique_gate(events, ["user_id", "event_type"], ["ts", "event_id"], place, 8)
    kinds = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string"
    kept, aside = gate.written(spark, f"{place}/passed", kinds), gate.written(spark, f"{place}/aside", kinds + ", reason string")
    return kept.select("event_id", F.lit("passed").alias("went")).unionByName(aside.select("event_id", F.col("reason").alias("went")))
