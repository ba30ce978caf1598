"""Routing rows to partitions, and audits of partition bounds."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from covenant.model import PartitionSpec
from covenant.operators import diff, scan
from covenant.operators.evolve import Change

#: Bounds that are written as one CASE; beyond that they are joined.
CASE_BOUNDS = 500


def bound_of(column: str, spec: PartitionSpec) -> Column:
    c = F.col(column)
    if spec.values:
        return c.cast("string").isin(list(spec.values))
    low = c >= F.expr(spec.start) if spec.start is not None else F.lit(True)
    return low & (c < F.expr(spec.end) if spec.end is not None else F.lit(True))


def partition_of(column: str, specs: Sequence[PartitionSpec]) -> Column:
    """The name of the partition that takes a value; the default one takes what no
    bound does, nulls included; null if there is none."""
    if len(specs) > CASE_BOUNDS:
        raise ValueError("join the bounds instead: see route_many")
    route = F.lit(next((s.name for s in specs if s.default), None)).cast("string")
    for s in reversed([s for s in specs if not s.default]):
        route = F.when(bound_of(column, s), F.lit(s.name)).otherwise(route)
    return route


def route(df: DataFrame, levels: Sequence[tuple[str, Sequence[PartitionSpec]]], name: str = "partition") -> DataFrame:
    """``df`` with the path of partitions over all levels; null where a level
    takes no row."""
    path = [partition_of(c, specs) for c, specs in levels]
    routed = path[0]
    for p in path[1:]:
        routed = F.when(routed.isNotNull() & p.isNotNull(), F.concat(routed, F.lit("/"), p))
    return df.withColumn(name, routed)


def unrouted(df: DataFrame, levels: Sequence[tuple[str, Sequence[PartitionSpec]]]) -> DataFrame:
    return route(df, levels, "__to").where("__to IS NULL").drop("__to")


def route_many(df: DataFrame, column: str, bounds: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Many ranges ``bounds (*by, name, start, end)``: rows and bounds are merged by one
    scan (`scan.locate`), however wide the ranges are. ``by`` names columns that
    both have: the levels above."""
    return scan.locate(df, column, bounds, by)


def route_tree(df: DataFrame, levels: Sequence[tuple[str, DataFrame]], name: str = "partition") -> DataFrame:
    """``df`` with its path of partitions over levels ``(column, bounds)`` of many bounds.

    ``bounds (parent, name, start, end, values, is_default)``: the parent is the path so
    far, null on the first level; a range, or a list of ``values`` (as text), or
    the default, which takes what no other does, nulls included. No path is given
    where a level takes no row. ``parent`` and ``name`` are distinct together.
    """
    out, lost = df.withColumn("__path", F.lit(None).cast("string")), []
    for column, bounds in levels:
        told = bounds.withColumn("__path", F.col("parent"))
        ranges = told.where("NOT is_default AND values IS NULL").select("__path", "name", "start", "end")
        out = scan.locate(out.withColumn("__top", F.coalesce("__path", F.lit(""))), column, ranges.withColumn("__top", F.coalesce("__path", F.lit(""))), ["__top"], to="__range")
        listed = told.where("NOT is_default AND values IS NOT NULL").select(F.coalesce("__path", F.lit("")).alias("__top"), F.explode("values").alias("__listed"), F.col("name").alias("__list"))
        other = told.where("is_default").select(F.coalesce("__path", F.lit("")).alias("__top"), F.col("name").alias("__other"))
        out = out.withColumn("__listed", F.col(column).cast("string")).join(listed, ["__top", "__listed"], "left").join(other, "__top", "left")
        own = F.coalesce("__range", "__list", "__other")
        out = out.select(*df.columns, F.when(F.col("__top") == "", own).otherwise(F.concat("__path", F.lit("/"), own)).alias("__path"))
        lost.append(out.where("__path IS NULL"))
        out = out.where("__path IS NOT NULL")
    return reduce(DataFrame.unionByName, lost, out).withColumnRenamed("__path", name)


def overlapping_bounds(bounds: DataFrame, by: Sequence[str]) -> DataFrame:
    """Ranges ``(*by, name, start, end)`` that begin before an earlier one ends;
    a null start or end is open. ``taken_to`` is null where that is open. What is
    taken so far comes from a prefix scan, so a parent of many ranges is spread."""
    sums = {"__seen": ("sum", F.lit(1)), "__open": ("max", F.col("end").isNull()), "taken_to": ("max", F.col("end"))}
    marked = scan.running(bounds, by, ["start", "name"], sums).withColumn("taken_to", F.when(~F.col("__open"), F.col("taken_to")))
    return marked.where(F.col("__seen").isNotNull() & (F.col("__open") | F.col("start").isNull() | (F.col("start") < F.col("taken_to")))).drop("__seen", "__open")


def repeated_defaults(bounds: DataFrame, by: Sequence[str], default: str = "is_default") -> DataFrame:
    """``(*by, defaults)``: parents with more than one default partition."""
    return bounds.where(F.col(default)).groupBy(*by).agg(F.count("*").alias("defaults")).where("defaults > 1")


def repeated_values(lists: DataFrame, by: Sequence[str]) -> DataFrame:
    """List values ``(*by, name, value)`` that several partitions of one parent take."""
    return lists.groupBy(*by, "value").agg(F.count_distinct("name").alias("partitions")).where("partitions > 1")


def moved_rows(df: DataFrame, column: str, old: Sequence[PartitionSpec], new: Sequence[PartitionSpec]) -> DataFrame:
    """Rows that another partition takes after a change of bounds."""
    both = df.withColumn("old_partition", partition_of(column, old)).withColumn("new_partition", partition_of(column, new))
    return both.where(~F.col("old_partition").eqNullSafe(F.col("new_partition")))


def bound_changes(old: Sequence[PartitionSpec], new: Sequence[PartitionSpec]) -> list[Change]:
    """A changed bound cannot be altered in place: it is recreated."""
    was, now = {s.name: s for s in old}, {s.name: s for s in new}
    out = [Change("partition", n, "create", True) for n in now if n not in was]
    out += [Change("partition", n, "recreate", True) for n in now if n in was and was[n] != now[n]]
    return out + [Change("partition", n, "skipped", False) for n in was if n not in now]


def partition_changes(current: DataFrame, desired: DataFrame, current_keys: DataFrame, desired_keys: DataFrame, scope: Sequence[str] = ("db_id",)) -> DataFrame:
    """``(*scope, name, change)`` of partitions ``(*scope, name, parent, start, end,
    is_default)`` and of the tables ``(*scope, table, strategy, key)`` they part.

    A table that is parted by another key or in another way is to ``rebuild``, with the
    partitions it keeps. A partition with another parent is to ``reattach``, with its
    bounds as they then are; one with other bounds to ``recreate``, as bounds cannot be
    altered in place. ``create`` and ``drop`` come before these. What stays is left out.
    """
    scope = list(scope)
    rebuilt = diff.keyed_diff(current_keys, desired_keys, [*scope, "table"]).where("change = 'alter'").select(*scope, F.col("table").alias("name"))
    kept = ["name", "parent", "start", "end", "is_default"]
    both = diff.keyed_diff(current.select(*scope, *kept), desired.select(*scope, *kept), [*scope, "name"])
    under = both.join(rebuilt.select(*scope, F.col("name").alias("new_parent"), F.lit(True).alias("__rebuilt")), [*scope, "new_parent"], "left")
    change = F.when(F.col("change").isin("create", "drop"), F.col("change")).when(F.col("__rebuilt"), "rebuild").when(~F.col("old_parent").eqNullSafe(F.col("new_parent")), "reattach").when(F.col("change") == "alter", "recreate")
    return under.select(*scope, "name", change.alias("change")).where("change IS NOT NULL").unionByName(rebuilt.withColumn("change", F.lit("rebuild")))
