"""Dependency analytics over edges ``(db_id, src, dst)``: src depends on dst.

Rounds run over all databases at once; what a round leaves is written to the shared
folder.
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce
from itertools import count

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from covenant.shared import stored, stored_with


#: Links of a chain that a round joins into one: two doublings.
HOPS = 4


def known_edges(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    known = nodes.select("db_id", "node").distinct()
    real = edges.where("src <> dst").join(known.withColumnRenamed("node", "dst"), ["db_id", "dst"], "left_semi").join(known.withColumnRenamed("node", "src"), ["db_id", "src"], "left_semi")
    return known, real.select("db_id", "src", "dst").distinct()


def stored_edges(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """`known_edges`, stored, for what reads them in many steps."""
    known = stored(nodes.select("db_id", "node").distinct(), "graph-nodes")
    return known, stored(known_edges(known, edges)[1], "graph-edges")


def levels(nodes: DataFrame, edges: DataFrame, max_rounds: int | None = None) -> DataFrame:
    """``(db_id, node, level)``: 0 for nodes without dependencies, else one more
    than the highest they depend on; null for members of cycles and nodes behind
    them. Edges to unknown nodes and to the node itself do not count.

    Rake and compress: a round settles nodes all of whose dependencies are settled,
    then those that depend on these alone; and it shortens chains. A node with one
    open dependency has the level max(floor, weight + level of that one); two such
    rules in a row are one rule again, so pointers along a chain double, `HOPS` by
    `HOPS`, and edges that lead into a chain go on to its end. Trees and chains take
    rounds by the logarithm of their depth, other graphs by what branches. More than
    ``max_rounds`` levels, if it is given, are an error."""
    return settled(*known_edges(nodes, edges), max_rounds)


def settled(known: DataFrame, real: DataFrame, max_rounds: int | None = None, floors: DataFrame | None = None) -> DataFrame:
    """`levels` of distinct nodes and edges between them; ``floors (db_id, node, floor)``
    are levels that nodes have at least."""
    linked = real.select("db_id", F.col("src").alias("node"), "dst", F.lit(1).alias("w"))
    left = known.join(linked, ["db_id", "node"], "left")
    left = left.withColumn("floor", F.lit(0)) if floors is None else left.join(floors, ["db_id", "node"], "left").withColumn("floor", F.coalesce("floor", F.lit(0)))
    left = stored(left, "graph-open")
    placed: list[DataFrame] = []
    while True:
        first = raked(left)
        second = raked(first.where("level IS NULL").drop("level", "links"))
        both = first.where("level IS NOT NULL").unionByName(second)
        state, seen = stored_with(both, "graph-raked", settled=F.count_if(F.col("level").isNotNull()), open=F.count_if(F.col("level").isNull()), top=F.max("level"))
        if max_rounds is not None and (seen["top"] or 0) >= max_rounds > 0:
            raise RuntimeError(f"levels did not end in {max_rounds} rounds")
        left = state.where("level IS NULL").drop("level")
        if seen["settled"]:
            placed.append(state.where("level IS NOT NULL"))
        if not seen["settled"] or not seen["open"]:
            rest = left.select("db_id", "node").distinct().withColumn("level", F.lit(None).cast("int"))
            return reduce(DataFrame.unionByName, [x.select("db_id", "node", "level") for x in placed], rest)
        left = stored(compressed(left), "graph-open")


def raked(left: DataFrame) -> DataFrame:
    """``left (db_id, node, dst, w, floor)``, a row for each open dependency of a node or
    one without ``dst``. Nodes without any get ``level``, their floor; the others' floors
    rise by what these settle. ``links`` is how many dependencies a node still has."""
    free = left.where("dst IS NULL").withColumn("level", F.col("floor")).withColumn("links", F.lit(0).cast("long"))
    ends = free.select("db_id", F.col("node").alias("dst"), "level")
    met = left.where("dst IS NOT NULL").join(ends, ["db_id", "dst"], "left").withColumn("at", F.col("level") + F.col("w")).drop("level")
    own = Window.partitionBy("db_id", "node")
    still = F.col("at").isNull()
    told = met.withColumns({"links": F.count_if(still).over(own), "floor": F.greatest("floor", F.coalesce(F.max("at").over(own), "floor")), "n": F.row_number().over(own.orderBy("dst"))})
    kept = told.where(still | ((F.col("links") == 0) & (F.col("n") == 1)))
    rows = kept.select("db_id", "node", F.when(still, F.col("dst")).alias("dst"), F.when(still, F.col("w")).alias("w"), "floor", "links", F.lit(None).cast("int").alias("level"))
    return rows.unionByName(free.select(*rows.columns))


def compressed(left: DataFrame) -> DataFrame:
    """``left`` with chains shortened: pointers of nodes with one open dependency jump
    ahead, and edges into such nodes lead to where they point."""
    jumps = left.where("links = 1").drop("links")
    for _ in range(HOPS // 2):
        jumps = hop(jumps)
    ends = jumps.select("db_id", F.col("node").alias("dst"), F.col("dst").alias("end"), F.col("w").alias("more"), F.col("floor").alias("low"))
    led = left.where("links > 1").join(ends, ["db_id", "dst"], "left")
    merged = led.groupBy("db_id", "node", F.coalesce("end", "dst").alias("dst")).agg(F.max(F.col("w") + F.coalesce("more", F.lit(0))).alias("w"), F.max("floor").alias("floor"), F.max(F.col("w") + F.col("low")).alias("low"))
    own = Window.partitionBy("db_id", "node")
    merged = merged.select("db_id", "node", "dst", "w", F.greatest("floor", F.coalesce(F.max("low").over(own), "floor")).alias("floor"))
    return left.where("links = 0").drop("links").unionByName(jumps).unionByName(merged)


def hop(jumps: DataFrame) -> DataFrame:
    """Pointers ``(db_id, node, dst, w, floor)`` led on by the pointer of their end. On
    a cycle of such nodes they go round; their weights stay bounded, as they are
    never used."""
    ahead = jumps.select("db_id", F.col("node").alias("dst"), F.col("dst").alias("end"), F.col("w").alias("more"), F.col("floor").alias("low"))
    met = jumps.join(ahead, ["db_id", "dst"], "left")
    far = F.least(F.col("w") + F.coalesce("more", F.lit(0)), F.lit(1 << 29))
    floor = F.least(F.greatest("floor", F.coalesce(F.col("w") + F.col("low"), "floor")), F.lit(1 << 29))
    return met.select("db_id", "node", F.coalesce("end", "dst").alias("dst"), far.alias("w"), floor.alias("floor"))


def positions(leveled: DataFrame) -> DataFrame:
    """``pos`` within the database: dependencies first, ties by name, cycles last."""
    w = Window.partitionBy("db_id").orderBy(F.asc_nulls_last("level"), "node")
    return leveled.withColumn("pos", F.row_number().over(w))


def cycle_members(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes on a path from one cycle to another or itself: what no peel from
    either end removes."""
    known, real = stored_edges(nodes, edges)
    return ahead_of_cycles(settled(known, real).where("level IS NULL").select("db_id", "node"), real)


def ahead_of_cycles(open_nodes: DataFrame, real: DataFrame) -> DataFrame:
    """`cycle_members`, of the nodes that have no level."""
    back = real.select("db_id", F.col("dst").alias("src"), F.col("src").alias("dst"))
    return levels(open_nodes, back).where("level IS NULL").select("db_id", "node")


def strong_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``(db_id, node, component, members)``: nodes that depend on each other, by the
    least of them; a node that is on no cycle is a component of its own.

    What is ahead of all cycles or behind them is trimmed (`cycle_members`). The rest
    is coloured: each node by the greatest node that depends on it, however far. A
    node of its own colour and those of its colour that it depends on in a circle are
    a component; edges between colours join no component, so the others of a colour
    go on by themselves."""
    known, real = stored_edges(nodes, edges)
    return named_components(known, cycle_components(settled(known, real).where("level IS NULL").select("db_id", "node"), real))


def cycle_components(open_nodes: DataFrame, real: DataFrame) -> DataFrame | None:
    """``(db_id, node, component, members)`` of nodes on cycles, None if there are none;
    ``open_nodes`` are those that have no level."""
    core, told = stored_with(ahead_of_cycles(open_nodes, real), "graph-core", n=F.count("*"))
    links = real.join(core.withColumnRenamed("node", "src"), ["db_id", "src"], "left_semi").join(core.withColumnRenamed("node", "dst"), ["db_id", "dst"], "left_semi")
    links, found = stored(links, "graph-edges"), []
    while told["n"]:
        colour = coloured(core, links)
        own = links.join(colour.select("db_id", F.col("node").alias("src"), F.col("colour").alias("c")), ["db_id", "src"]).join(colour.select("db_id", F.col("node").alias("dst"), F.col("colour").alias("d")), ["db_id", "dst"]).where("c = d").select("db_id", "src", "dst")
        own = stored(own, "graph-edges")
        # nodes of a colour that reach its root; the root reaches them all
        back = impact(own, colour.where("node = colour").select("db_id", "node")).select("db_id", "node")
        members = stored(colour.join(back, ["db_id", "node"], "left_semi"), "graph-component")
        found.append(members)
        core, told = stored_with(core.join(members, ["db_id", "node"], "left_anti"), "graph-core", n=F.count("*"))
        links = stored(own.join(core.withColumnRenamed("node", "src"), ["db_id", "src"], "left_semi").join(core.withColumnRenamed("node", "dst"), ["db_id", "dst"], "left_semi"), "graph-edges")
    if not found:
        return None
    held = reduce(DataFrame.unionByName, found)
    named = held.groupBy("db_id", "colour").agg(F.min("node").alias("component"), F.count("*").alias("members"))
    return held.join(named, ["db_id", "colour"]).select("db_id", "node", "component", "members")


def named_components(known: DataFrame, told: DataFrame | None) -> DataFrame:
    if told is None:
        return known.select("db_id", "node", F.col("node").alias("component"), F.lit(1).cast("long").alias("members"))
    return known.join(told, ["db_id", "node"], "left").select("db_id", "node", F.coalesce("component", "node").alias("component"), F.coalesce("members", F.lit(1).cast("long")).alias("members"))


def coloured(core: DataFrame, links: DataFrame) -> DataFrame:
    """``(db_id, node, colour)``: the greatest node from which a path leads to the
    node, itself included. A stored round takes two steps along the edges, and one to
    the colour that the colour's own node has."""
    labels = stored(core.withColumn("colour", F.col("node")), "graph-colour")
    while True:
        now = labels.withColumn("was", F.col("colour"))
        for _ in range(2):
            given = links.join(now.select("db_id", F.col("node").alias("src"), "colour"), ["db_id", "src"]).select("db_id", F.col("dst").alias("node"), "colour", F.lit(None).cast("string").alias("was"))
            now = now.unionByName(given).groupBy("db_id", "node").agg(F.max("colour").alias("colour"), F.max("was").alias("was"))
        ahead = labels.select("db_id", F.col("node").alias("colour"), F.col("colour").alias("further"))
        now = now.join(ahead, ["db_id", "colour"], "left").select("db_id", "node", F.greatest("colour", F.coalesce("further", "colour")).alias("colour"), "was")
        labels, seen = stored_with(now, "graph-colour", changed=F.count_if(F.col("colour") != F.col("was")))
        labels = labels.drop("was")
        if not seen["changed"]:
            return labels


def unit_levels(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``(db_id, node, component, members, level)``: levels where the members of a
    cycle are one unit, so that nodes behind a cycle are ordered too. Members of a
    unit share a level.

    Nodes are levelled once. Only those that this leaves open, on cycles and behind
    them, are put in units and levelled again, above what is settled."""
    known, real = stored_edges(nodes, edges)
    leveled = settled(known, real)
    done = leveled.where("level IS NOT NULL").select("db_id", "node", F.col("node").alias("component"), F.lit(1).cast("long").alias("members"), "level")
    rest, told = stored_with(leveled.where("level IS NULL").select("db_id", "node"), "graph-behind", n=F.count("*"))
    if not told["n"]:
        return done
    out = stored(real.join(rest.withColumnRenamed("node", "src"), ["db_id", "src"], "left_semi"), "graph-edges")
    units = stored(named_components(rest, cycle_components(rest, out)), "graph-units")
    at = lambda end: units.select("db_id", F.col("node").alias(end), F.col("component").alias(f"{end}_unit"))
    between = out.join(at("src"), ["db_id", "src"]).join(at("dst"), ["db_id", "dst"]).where("src_unit <> dst_unit").select("db_id", F.col("src_unit").alias("src"), F.col("dst_unit").alias("dst")).distinct()
    floors = out.join(done.select("db_id", F.col("node").alias("dst"), "level"), ["db_id", "dst"]).join(at("src"), ["db_id", "src"]).groupBy("db_id", F.col("src_unit").alias("node")).agg((F.max("level") + 1).alias("floor"))
    above = settled(units.select("db_id", F.col("component").alias("node")).distinct(), between, floors=floors).withColumnRenamed("node", "component")
    return done.unionByName(units.join(above, ["db_id", "component"]).select("db_id", "node", "component", "members", "level"))


#: Steps along edges that a stored round of `impact` takes.
STEPS = 4


def impact(edges: DataFrame, changed: DataFrame, max_rounds: int | None = None) -> DataFrame:
    """``(db_id, node, distance)``: everything that depends on a changed node. A stored
    round takes `STEPS` steps and goes on from what only the last of them reached;
    more than ``max_rounds`` rounds, if it is given, are an error."""
    seen = front = stored(changed.select("db_id", "node").distinct().withColumn("distance", F.lit(0)), "graph-seen")
    for n in count(1):
        if n == max_rounds:
            raise RuntimeError(f"impact did not end in {max_rounds} rounds")
        far, parts, at = n * STEPS, [], front.select("db_id", "node")
        for step in range(far - STEPS + 1, far + 1):
            at = edges.join(at.select("db_id", F.col("node").alias("dst")), ["db_id", "dst"]).select("db_id", F.col("src").alias("node")).distinct()
            parts.append(at.withColumn("distance", F.lit(step)))
        reached = reduce(DataFrame.unionByName, parts).groupBy("db_id", "node").agg(F.min("distance").alias("distance"))
        new, told = stored_with(reached.join(seen, ["db_id", "node"], "left_anti"), "graph-front", last=F.count_if(F.col("distance") == far))
        seen, front = seen.unionByName(new), new.where(F.col("distance") == far)
        if not told["last"]:
            return seen
        if n % 16 == 0:
            seen = stored(seen, "graph-seen")  # fewer files and a short plan


def resolve_edges(used: DataFrame, objects: DataFrame) -> DataFrame:
    """Edges ``(db_id, src, dst)`` of ``used (db_id, schema, src, name)``. A bare
    name is looked up in its own schema, then in public; names of nothing defined
    and an object's own name give no edge."""
    exact = objects.select("db_id", F.col("schema").alias("o_schema"), F.col("name").alias("o_name"))
    parts = F.split("name", r"\.")
    asked = used.withColumn("bare", F.element_at(parts, -1)).withColumn("given", F.when(F.size(parts) > 1, parts[0]))
    found = asked.join(exact, (asked["db_id"] == exact["db_id"]) & (F.col("bare") == F.col("o_name")) & (F.coalesce("given", "o_schema") == F.col("o_schema")) & (F.col("given").isNotNull() | F.col("o_schema").isin("public") | (F.col("o_schema") == F.col("schema"))))
    w = Window.partitionBy(asked["db_id"], "schema", "src", "name").orderBy(F.when(F.col("o_schema") == F.col("schema"), 0).otherwise(1))
    first = found.withColumn("__n", F.row_number().over(w)).where("__n = 1")
    return first.select(asked["db_id"], F.col("src"), F.col("o_name").alias("dst")).where("src <> dst").distinct()


def reference_edges(columns: DataFrame, references: DataFrame, objects: DataFrame) -> DataFrame:
    """Edges by name: columns to the types they use (array brackets off), tables
    to tables they refer to."""
    used = columns.select("db_id", "schema", F.col("table").alias("src"), F.regexp_replace("type_name", r"(\[\d*\])+$", "").alias("name")).unionByName(references.select("db_id", "schema", F.col("table").alias("src"), F.col("ref_table").alias("name")))
    return resolve_edges(used, objects)


#: A sequence named in a default, with or without a cast of its name.
SEQUENCE_IN_DEFAULT = r"(?i)nextval\(\s*'([^']+)'"


def catalog_edges(objects: DataFrame, columns: DataFrame, references: DataFrame, defaults: DataFrame | None = None, parents: DataFrame | None = None, uses: DataFrame | None = None) -> DataFrame:
    """`reference_edges`, and those of tables to the sequences that ``defaults
    (db_id, schema, table, default)`` draw from, of partitions and heirs to their
    parents by ``parents (db_id, schema, child, parent)``, and of views to the
    relations that ``uses (db_id, schema, view, relation)`` declares."""
    parts = [reference_edges(columns, references, objects)]
    if defaults is not None:
        drawn = defaults.select("db_id", "schema", F.col("table").alias("src"), F.regexp_extract("default", SEQUENCE_IN_DEFAULT, 1).alias("name"))
        parts.append(resolve_edges(drawn.where("name <> ''"), objects))
    if parents is not None:
        parts.append(resolve_edges(parents.select("db_id", "schema", F.col("child").alias("src"), F.col("parent").alias("name")), objects))
    if uses is not None:
        parts.append(resolve_edges(uses.select("db_id", "schema", F.col("view").alias("src"), F.col("relation").alias("name")), objects))
    return reduce(DataFrame.unionByName, parts).distinct()


def change_order(changes: DataFrame, position: DataFrame) -> DataFrame:
    """``changes (db_id, node, action, seq)`` with ``phase, pos, step``: reference
    drops, drops of views and tables (dependents first), creates and alters
    (dependencies first), reference adds; unknown positions first."""
    phase = F.when(F.col("action") == "drop_reference", 0).when(F.col("action") == "drop", 1).when(F.col("action").isin("create", "alter"), 2).otherwise(3)
    joined = changes.join(position.select("db_id", "node", "pos"), ["db_id", "node"], "left")
    signed = F.coalesce(F.when(F.col("action") == "drop", -F.col("pos")).otherwise(F.col("pos")), F.lit(-(2**31)))
    w = Window.partitionBy("db_id").orderBy("phase", "pos", "seq")
    return joined.withColumn("phase", phase).withColumn("pos", signed).withColumn("step", F.row_number().over(w))


#: Phases of an order over kinds; drops go against the dependencies.
ORDER_PHASES = {("reference", "drop"): 0, ("view", "drop"): 1, ("table", "create"): 2, ("table", "alter"): 2, ("table", "persist"): 3, ("table", "drop"): 4, ("reference", "create"): 5, ("view", "create"): 6}


def phased_order(changes: DataFrame, position: DataFrame) -> DataFrame:
    """``changes (db_id, kind, node, action, seq)`` with ``phase, pos, step``:
    references go first, then views, tables are made, altered, persisted and
    dropped, references added, and views made. Within a phase what others depend
    on comes first, or last where it is dropped; members of cycles and unknown
    nodes (no position) come before the others, by name. Pairs of kind and action
    that have no phase come last."""
    phase = F.coalesce(*[F.when((F.col("kind") == k) & (F.col("action") == a), n) for (k, a), n in ORDER_PHASES.items()], F.lit(len(ORDER_PHASES)))
    joined = changes.join(position.select("db_id", "node", "pos"), ["db_id", "node"], "left")
    signed = F.when(F.col("action") == "drop", -F.col("pos")).otherwise(F.col("pos"))
    w = Window.partitionBy("db_id").orderBy("phase", F.col("pos").asc_nulls_first(), "node", "seq")
    return joined.withColumn("phase", phase).withColumn("pos", signed).withColumn("step", F.row_number().over(w))


def propagate_delete(deleted: DataFrame, key: str, child: DataFrame, column: str, action: str, default: str | None = None) -> Mapping[str, DataFrame]:
    """What a delete of parent keys does to a child: ``kept`` rows (with nulls or
    the ``default`` expression set), rows ``deleted`` in turn, and ``violations``
    that forbid it. Actions: cascade, set null, set default, restrict, no action;
    another is an error. A default that is itself among the deleted keys is a
    violation, null passes."""
    if action not in ("cascade", "set null", "set default", "restrict", "no action"):
        raise ValueError(f"unknown action {action!r}")
    keys = deleted.select(F.col(key).alias("__gone")).distinct()
    hit = child.join(keys, child[column] == F.col("__gone"), "left_semi")
    missed = child.join(keys, child[column] == F.col("__gone"), "left_anti")
    none = child.limit(0)
    if action == "cascade":
        return {"kept": missed, "deleted": hit, "violations": none}
    if action in ("set null", "set default"):
        value = F.lit(None) if action == "set null" or default is None else F.expr(default)
        put = hit.withColumn(column, value.cast(dict(child.dtypes)[column]))
        return {"kept": missed.unionByName(put), "deleted": none, "violations": put.join(keys, put[column] == F.col("__gone"), "left_semi")}
    return {"kept": child, "deleted": none, "violations": hit}
