"""Views that are kept up by what changed in their tables.

A view is a composition of `Source`, `Select` and `Join`, with a `Group` on top or none.
A change of a table is its rows with ``__sign``, 1 for a row that came and -1 for
one that went; an update is both. From signed rows of the tables follow signed
rows of the view: a selection is applied to them; of a join, what changed on one
side meets the other side, and what changed on both is taken off once. Groups keep
their number of rows and of values, so that sums and counts follow from signed
sums, and a group of no rows goes. The least and the greatest of a group follow
too, unless the very value went: such groups alone are computed anew.
"""

from __future__ import annotations

import hashlib
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from covenant.shared import stored_with

SIGN = "__sign"


@dataclass(frozen=True)
class Source:
    table: str


@dataclass(frozen=True)
class Select:
    """``columns``: Spark SQL expressions by name; none keeps all."""

    of: Source | Select | Join
    where: str = "true"
    columns: Mapping[str, str] = field(default_factory=dict)


@dataclass(frozen=True)
class Join:
    """Rows that are equal on ``on``, columns that both sides have; nulls meet nothing."""

    left: Source | Select | Join
    right: Source | Select | Join
    on: tuple[str, ...]


@dataclass(frozen=True)
class Group:
    """``sums``, ``least`` and ``most``: Spark SQL expressions by name; ``count`` names
    the number of rows. Sums of doubles may differ in their last digits from sums taken
    anew; whole and decimal numbers do not."""

    of: Source | Select | Join
    keys: tuple[str, ...]
    count: str = "n"
    sums: Mapping[str, str] = field(default_factory=dict)
    least: Mapping[str, str] = field(default_factory=dict)
    most: Mapping[str, str] = field(default_factory=dict)


View = Source | Select | Join | Group


def definition_hash(view: View) -> str:
    return hashlib.sha256(repr(view).encode()).hexdigest()


def rows(view: View, tables: Mapping[str, DataFrame]) -> DataFrame:
    """The rows of a view without groups."""
    if isinstance(view, Source):
        return tables[view.table]
    if isinstance(view, Select):
        return selected(rows(view.of, tables), view)
    return rows(view.left, tables).join(rows(view.right, tables), list(view.on))


def selected(df: DataFrame, view: Select) -> DataFrame:
    kept = df.where(view.where)
    sign = [SIGN] if SIGN in df.columns else []
    return kept.select(*(F.expr(e).alias(n) for n, e in view.columns.items()), *sign) if view.columns else kept


def change(view: View, tables: Mapping[str, DataFrame], deltas: Mapping[str, DataFrame]) -> DataFrame | None:
    """Signed rows of a view without groups, from signed rows of its tables and the
    tables as they are now; None where no table of its has changed."""
    if isinstance(view, Source):
        return deltas.get(view.table)
    if isinstance(view, Select):
        of = change(view.of, tables, deltas)
        return None if of is None else selected(of, view)
    left, right, on = change(view.left, tables, deltas), change(view.right, tables, deltas), list(view.on)
    parts = []
    if left is not None:
        parts.append(left.join(rows(view.right, tables), on))
    if right is not None:
        parts.append(rows(view.left, tables).join(right, on))
    if left is not None and right is not None:
        both = left.withColumnRenamed(SIGN, "__l").join(right.withColumnRenamed(SIGN, "__r"), on)
        parts.append(both.withColumn(SIGN, -F.col("__l") * F.col("__r")).drop("__l", "__r"))
    return reduce(DataFrame.unionByName, parts) if parts else None


def grouped(view: View, tables: Mapping[str, DataFrame]) -> Group:
    """The view as groups: one without any has a group for each distinct row."""
    return view if isinstance(view, Group) else Group(view, tuple(rows(view, tables).columns), "__n")


def state(view: View, tables: Mapping[str, DataFrame]) -> DataFrame:
    """What is stored of a view, from its tables anew."""
    g = grouped(view, tables)
    return summed(rows(g.of, tables).withColumn(SIGN, F.lit(1)), g)


def summed(signed: DataFrame, g: Group) -> DataFrame:
    sign = F.col(SIGN)
    parts = [F.sum(sign.cast("long")).alias(g.count)]
    for n, e in g.sums.items():
        parts += [F.sum(F.expr(e) * sign).alias(n), F.sum(F.when(F.expr(e).isNotNull(), sign.cast("long"))).alias(f"__of_{n}")]
    for kind, named in ((F.min, g.least), (F.max, g.most)):
        for n, e in named.items():
            parts += [kind(F.when(sign > 0, F.expr(e))).alias(n), kind(F.when(sign < 0, F.expr(e))).alias(f"__gone_{n}")]
    return signed.groupBy(*g.keys).agg(*parts)


def follow(view: View, held: DataFrame, tables: Mapping[str, DataFrame], deltas: Mapping[str, DataFrame]) -> DataFrame:
    """The state after ``deltas``, from the state ``held`` before and the tables as they
    are now. Only tables that meet a changed one in a join are read, and those of
    groups whose least or greatest value went."""
    g = grouped(view, tables)
    signed = change(g.of, tables, deltas)
    if signed is None:
        return held
    news = summed(signed, g)
    rest = [c for c in news.columns if c not in g.keys]
    keys = lambda p: [F.col(k).alias(f"{p}_{i}") for i, k in enumerate(g.keys)]
    was = held.select(*keys("__k"), *(F.col(c).alias(f"__was_{c}") for c in rest), F.lit(True).alias("__held"))
    now = news.select(*keys("__j"), *(F.col(c).alias(f"__now_{c}") for c in rest), F.lit(True).alias("__new"))
    on = reduce(Column.__and__, [F.col(f"__k_{i}").eqNullSafe(F.col(f"__j_{i}")) for i in range(len(g.keys))], F.lit(True))
    both = was.join(now, on, "full_outer")
    add = lambda c: F.when(F.col(f"__was_{c}").isNull(), F.col(f"__now_{c}")).when(F.col(f"__now_{c}").isNull(), F.col(f"__was_{c}")).otherwise(F.col(f"__was_{c}") + F.col(f"__now_{c}"))
    out, lost = {g.count: add(g.count)}, F.lit(False)
    for n in g.sums:
        out |= {n: F.when(F.coalesce(add(f"__of_{n}"), F.lit(0)) != 0, add(n)), f"__of_{n}": add(f"__of_{n}")}
    for named, pick, beyond in ((g.least, F.least, Column.__le__), (g.most, F.greatest, Column.__ge__)):
        for n in named:
            out |= {n: pick(F.col(f"__was_{n}"), F.col(f"__now_{n}")), f"__gone_{n}": F.lit(None).cast(held.schema[n].dataType)}
            lost = lost | F.coalesce(beyond(F.col(f"__now___gone_{n}"), F.col(f"__was_{n}")), F.col(f"__now___gone_{n}").isNotNull())
    told = both.select(*(F.when(F.col("__held"), F.col(f"__k_{i}")).otherwise(F.col(f"__j_{i}")).alias(k) for i, k in enumerate(g.keys)), *(c.alias(n) for n, c in out.items()), lost.alias("__lost")).where(F.col(g.count) != 0)
    if not (g.least or g.most):
        return told.select(held.columns)
    told, seen = stored_with(told, "view-state", lost=F.count_if("__lost"))
    kept = told.where("NOT __lost").select(held.columns)
    if not seen["lost"]:
        return kept
    asked = told.where("__lost").select(*keys("__k"))
    anew = rows(g.of, tables).join(asked, reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"__k_{i}")) for i, k in enumerate(g.keys)], F.lit(True)), "left_semi")
    return kept.unionByName(summed(anew.withColumn(SIGN, F.lit(1)), g))


def shown(view: View, held: DataFrame) -> DataFrame:
    """The view's rows out of its state."""
    if isinstance(view, Group):
        return held.select(*view.keys, view.count, *view.sums, *view.least, *view.most)
    return held.withColumn("__n", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__n")))).drop("__n")


def signed_change(old: DataFrame, new: DataFrame) -> DataFrame:
    """The change from ``old`` to ``new``, where it is not known otherwise."""
    parts = old.withColumn(SIGN, F.lit(-1)).unionByName(new.select(old.columns).withColumn(SIGN, F.lit(1)))
    return parts.groupBy(*old.columns).agg(F.sum(SIGN).cast("int").alias(SIGN)).where(F.col(SIGN) != 0)


def applied(old: DataFrame, delta: DataFrame, key: Sequence[str]) -> DataFrame:
    """A keyed table after a change: rows whose key went or changed are replaced."""
    kept = old.join(delta.select(*key).distinct(), list(key), "left_anti")
    return kept.unionByName(delta.where(F.col(SIGN) > 0).drop(SIGN).select(old.columns))
