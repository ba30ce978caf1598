import random
import time

import pytest

from covenant.operators import graph
from tests.spent import spent


def levels_of(nodes, edges):
    """The definition: nodes are placed once all they depend on is."""
    level, left = {}, set(nodes)
    deps = {n: {b for a, b in edges if a == n and b != n and b in left} for n in nodes}
    while front := [n for n in left if deps[n] <= level.keys()]:
        for n in front:
            level[n] = 1 + max((level[d] for d in deps[n]), default=-1)
        left -= set(front)
    return level | dict.fromkeys(left)


def units_of(nodes, edges):
    reach = {n: {n} for n in nodes}
    for _ in nodes:
        for a, b in edges:
            if a in reach and b in reach:
                reach[a] |= reach[b]
    return {n: min(m for m in reach[n] if n in reach[m]) for n in nodes}


def frames(spark, graphs):
    nodes = spark.createDataFrame([(g, n) for g, (ns, _) in enumerate(graphs) for n in ns], "db_id int, node string")
    return nodes, spark.createDataFrame([(g, a, b) for g, (_, es) in enumerate(graphs) for a, b in es], "db_id int, src string, dst string")


def random_graph(rng):
    n = rng.randint(1, 14)
    nodes = [f"n{i}" for i in range(n)]
    kind = rng.choice(["tree", "dag", "any"])
    pick = {"tree": lambda i: [(i, rng.randrange(i))] if i else [], "dag": lambda i: [(i, j) for j in range(i) if rng.random() < 0.3], "any": lambda i: [(i, rng.randrange(n)) for _ in range(rng.randint(0, 2))]}[kind]
    edges = [(nodes[a], nodes[b]) for i in range(n) for a, b in pick(i)]
    return nodes, edges + edges[:2] + [(nodes[0], "unknown"), ("unknown", nodes[0])]


@pytest.mark.parametrize("seed", range(1))
def test_levels_and_units(spark, seed):
    rng = random.Random(seed)
    graphs = [random_graph(rng) for _ in range(25)]
    nodes, edges = frames(spark, graphs)
    got = {(r.db_id, r.node): r.level for r in graph.levels(nodes, edges).collect()}
    assert got == {(g, n): v for g, (ns, es) in enumerate(graphs) for n, v in levels_of(ns, es).items()}
    found = {(r.db_id, r.node): r for r in graph.unit_levels(nodes, edges).collect()}
    for g, (ns, es) in enumerate(graphs):
        unit = units_of(ns, es)
        between = [(unit[a], unit[b]) for a, b in es if a in unit and b in unit]
        level = levels_of(set(unit.values()), between)
        for n in ns:
            r = found.pop((g, n))
            assert (r.component, r.members, r.level) == (unit[n], list(unit.values()).count(unit[n]), level[unit[n]])
    assert not found


def chain(spark, n):
    nodes = spark.range(n).selectExpr("1 AS db_id", "cast(id AS string) AS node")
    return nodes, spark.range(n - 1).selectExpr("1 AS db_id", "cast(id + 1 AS string) AS src", "cast(id AS string) AS dst")


def test_depth_costs_little(spark):
    took = []
    for n in (20, 20, 2000):
        began = time.monotonic()
        assert {int(r.node): r.level for r in graph.levels(*chain(spark, n)).collect()} == {i: i for i in range(n)}
        took.append(time.monotonic() - began)
    assert took[2] < 3 * took[1] + 2
    with pytest.raises(RuntimeError):
        graph.levels(*chain(spark, 200), max_rounds=1)


def test_long_circle_and_empty(spark):
    nodes, edges = chain(spark, 25)
    closed = edges.unionByName(spark.createDataFrame([(1, "0", "24")], "db_id int, src string, dst string"))
    assert {r.level for r in graph.levels(nodes, closed).collect()} == {None}
    assert {(r.component, r.members) for r in graph.strong_components(nodes, closed).collect()} == {("0", 25)}
    assert graph.unit_levels(nodes.limit(0), edges.limit(0)).count() == 0


def test_units_take_their_levels_once(spark):
    """Without cycles units cost little more than levels."""
    nodes = spark.range(6000).selectExpr("id div 50 AS db_id", "cast(id AS string) AS node")
    edges = spark.range(6000).where("id % 50 > 0").selectExpr("id div 50 AS db_id", "cast(id AS string) AS src", "cast(id - id % 50 + id % 50 div 2 AS string) AS dst")
    most, at = spark.conf.get("spark.sql.autoBroadcastJoinThreshold"), [spent(spark)[1]]
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for f in (graph.levels, graph.unit_levels):
            assert f(nodes, edges).where("level = 5").count() == 120 * 16
            at.append(spent(spark)[1])
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", most)
    assert at[2] - at[1] < 1.5 * (at[1] - at[0])
