import random

import pytest

from covenant.model import ColumnSpec, KeySpec, ReferenceSpec, TableContract
from covenant.operators.deletes import propagate_deletes


def contract(name, refs, defaults=None):
    """``refs``: column, parent, action."""
    columns = [ColumnSpec("id", "bigint")] + [ColumnSpec(c, "bigint", default=(defaults or {}).get(c)) for c, _, _ in refs]
    return TableContract(name, tuple(columns), (KeySpec(f"{name}_pk", ("id",), primary=True),), references=tuple(ReferenceSpec(f"{name}_{c}", (c,), p, ("id",), a) for c, p, a in refs))


def brute(tables, contracts, root, asked):
    """Vetoes are taken back to roots one by one, until none is left."""
    links = [(t, r.columns[0], r.parent, r.on_delete) for t, c in contracts.items() for r in c.references]
    defaults = {(t, c.name): c.default for t, k in contracts.items() for c in k.columns}

    def closure(roots):
        gone = {(root, r) for r in roots if r in tables[root]}
        while True:
            more = {(t, i) for t, col, p, a in links if a == "cascade" for i, row in tables[t].items() if (p, row[col]) in gone} - gone
            if not more:
                return gone
            gone |= more

    roots = set(asked) & set(tables[root])
    while True:
        gone = closure(roots)
        bad = set()
        for t, col, p, a in links:
            told = defaults[t, col]
            told = None if told is None else int(told)
            wrong = a == "restrict" or a == "no action" or a == "set default" and told is not None and (told not in tables[p] or (p, told) in gone)
            for i, row in tables[t].items():
                if wrong and (p, row[col]) in gone and (a == "restrict" or (t, i) not in gone):
                    bad.add((p, row[col]))
        vetoed = {r for r in roots if closure([r]) & bad}
        if not vetoed:
            break
        roots -= vetoed
    kept = {}
    for t, rows in tables.items():
        kept[t] = {}
        for i, row in rows.items():
            if (t, i) not in gone:
                put = dict(row)
                for u, col, p, a in links:
                    if u == t and a in ("set null", "set default") and (p, row[col]) in gone:
                        told = defaults[t, col] if a == "set default" else None
                        put[col] = None if told is None else int(told)
                kept[t][i] = put
    return gone, set(asked) & set(tables[root]) - roots, kept


def check(spark, tables, contracts, root, asked):
    frames = {}
    for t, rows in tables.items():
        columns = [c.name for c in contracts[t].columns[1:]]
        frames[t] = spark.createDataFrame([(i, *(row[c] for c in columns), "x") for i, row in rows.items()], ", ".join(f"{c} bigint" for c in ["id", *columns]) + ", extra string")
    found = propagate_deletes(frames, contracts, root, spark.createDataFrame([(a,) for a in asked], "id bigint"))
    gone, vetoed, kept = brute(tables, contracts, root, asked)
    assert {(t, r.id) for t, df in found.deleted.items() for r in df.collect()} == gone
    assert {r.id for r in found.vetoed.collect()} == vetoed
    for t, df in found.kept.items():
        assert df.columns == frames[t].columns
        assert {r.id: {c: r[c] for c in kept[t].get(r.id, {})} for r in df.collect()} == kept[t], t
    for t in set(tables) - set(found.kept):
        assert len(kept[t]) == len(tables[t])
    assert bool(vetoed) == (not found.violations.isEmpty())
    return found


@pytest.mark.parametrize("seed", range(2))
def test_random(spark, seed):
    rng = random.Random(seed)
    ref = lambda n: rng.choice([None, rng.randrange(n), rng.randrange(n)])
    a = {i: {"up": ref(12) if i % 3 else None} for i in range(12)}
    b = {i: {"a": ref(12), "c": ref(14) if rng.random() < 0.2 else None} for i in range(14)}
    c = {i: {"b": ref(14), "own": ref(14)} for i in range(14)}
    d = {i: {"b": ref(14), "a": ref(12)} for i in range(10)}
    pick = lambda: rng.choice(["set null", "set default", "restrict", "no action"])
    contracts = {
        "a": contract("a", [("up", "a", "cascade")]), "b": contract("b", [("a", "a", "cascade"), ("c", "c", rng.choice(["cascade", "no action"]))]),
        "c": contract("c", [("b", "b", "cascade"), ("own", "c", pick())], {"own": rng.choice([None, "0", "99"])}), "d": contract("d", [("b", "b", "set null"), ("a", "a", pick())], {"a": "3"}),
    }
    check(spark, {"a": a, "b": b, "c": c, "d": d}, contracts, "a", rng.sample(range(15), 5))


def test_cases(spark):
    chain = {i: {"up": i - 1 if i else None} for i in range(16)}
    only = {"a": contract("a", [("up", "a", "cascade")])}
    assert sum(df.count() for df in check(spark, {"a": chain}, only, "a", [10]).deleted.values()) == 6
    circle = {0: {"up": 1}, 1: {"up": 2}, 2: {"up": 0}, 3: {"up": 3}}
    check(spark, {"a": circle}, only, "a", [1, 3])
    check(spark, {"a": circle}, {"a": contract("a", [("up", "a", "restrict")])}, "a", [1, 3])
    check(spark, {"a": circle}, {"a": contract("a", [("up", "a", "no action")])}, "a", [0, 1, 3])
    check(spark, {"a": circle}, only, "a", [])
    with pytest.raises(ValueError):
        check(spark, {"a": circle}, {"a": contract("a", [("up", "a", "explode")])}, "a", [1])


def test_vetoes_keep_whole_trees(spark):
    """A restriction deep below one root leaves the other root's rows to go."""
    a = {1: {"up": None}, 2: {"up": 1}, 3: {"up": 2}, 4: {"up": None}, 5: {"up": 4}}
    b = {1: {"a": 3}}
    found = check(spark, {"a": a, "b": b}, {"a": contract("a", [("up", "a", "cascade")]), "b": contract("b", [("a", "a", "restrict")])}, "a", [1, 4])
    assert {r.id for r in found.vetoed.collect()} == {1}
    row = found.violations.collect()[0]
    assert (row.reference, row.child_key, row.parent_key) == ("b_a", '{"id":1}', '{"id":3}')
