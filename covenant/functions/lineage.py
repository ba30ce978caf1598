"""What names a definition uses, as Spark's own parser reads it.

Texts of views, checks, defaults and policies are parsed, not searched: literals,
comments, aliases, names of common table expressions and of lambda variables are
none of these. Definitions are metadata, so they are walked on the driver.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Mapping
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from covenant.model import TableContract

Name = tuple[str, ...]


def each(seq: Any) -> Iterator[Any]:
    return (seq.apply(i) for i in range(seq.size()))


def kind(node: Any) -> str:
    return node.getClass().getSimpleName()


def expressions(node: Any) -> Iterator[Any]:
    """An expression and all below it."""
    yield node
    for child in each(node.children()):
        yield from expressions(child)


def relations_in(plan: Any, bound: frozenset[str]) -> Iterator[Name]:
    """Relations that a parsed plan reads, but for those ``bound`` by its own names."""
    if kind(plan) == "UnresolvedRelation":
        name = tuple(each(plan.multipartIdentifier()))
        if len(name) > 1 or name[0].lower() not in bound:
            yield name
    inner = bound
    if kind(plan) == "UnresolvedWith":
        for pair in each(plan.cteRelations()):
            # a common table expression sees those before it
            yield from relations_in(pair._2(), inner)
            inner = inner | {pair._1().lower()}
    for top in each(plan.expressions()):
        for e in expressions(top):
            if kind(e) in ("ScalarSubquery", "Exists", "ListQuery", "LateralSubquery"):
                yield from relations_in(e.plan(), inner)
    for child in each(plan.children()):
        yield from relations_in(child, inner)


def relations(spark: SparkSession, query: str) -> set[Name]:
    """Names of the tables and views that a query reads, qualified as it writes them."""
    return set(relations_in(spark._jsparkSession.sessionState().sqlParser().parsePlan(query), frozenset()))


def columns_in(node: Any, bound: frozenset[str]) -> Iterator[Name]:
    """Columns of a parsed expression. In a lambda the parser takes every name for a
    variable; those that are not its arguments are columns."""
    if kind(node) in ("UnresolvedAttribute", "UnresolvedNamedLambdaVariable"):
        name = tuple(each(node.nameParts()))
        if kind(node) == "UnresolvedAttribute" or name[0].lower() not in bound:
            yield name
    elif kind(node) == "LambdaFunction":
        own = {next(each(a.nameParts())).lower() for a in each(node.arguments())}
        yield from columns_in(node.function(), bound | own)
    else:
        for child in each(node.children()):
            yield from columns_in(child, bound)


def columns(spark: SparkSession, expression: str) -> set[Name]:
    """Names of the columns that an expression reads, qualified as it writes them."""
    return set(columns_in(spark._jsparkSession.sessionState().sqlParser().parseExpression(expression), frozenset()))


def texts(contract: TableContract) -> Iterator[tuple[str, str, str]]:
    """``(kind, name, expression)`` of all that a contract declares in text. A domain's
    checks are over VALUE, so they name no column."""
    yield from (("check", r.name, r.expression) for r in contract.checks)
    for c in contract.columns:
        yield from ((k, c.name, t) for k, t in (("default", c.default), ("generated", c.generated)) if t is not None)
    yield from (("key", k.name, k.where) for k in contract.keys if k.where is not None)
    for p in contract.policies:
        yield from (("policy", p.name, t) for t in (p.using, p.check) if t is not None)


def used_columns(spark: SparkSession, contracts: Iterable[TableContract]) -> DataFrame:
    """``(table, kind, name, column)``: columns that texts of contracts use, once each, for
    joins with catalogs (`audit.dangling_columns` takes them as arrays)."""
    found = {(c.name, k, n, path[-1]) for c in contracts for k, n, text in texts(c) for path in columns(spark, text)}
    return spark.createDataFrame(sorted(found), "table string, kind string, name string, column string")


def view_uses(spark: SparkSession, views: Mapping[str, str]) -> dict[str, set[str]]:
    """By view, the others of ``views`` that it reads; names match in any case."""
    known = {v.lower(): v for v in views}
    return {v: {known[n[-1].lower()] for n in relations(spark, q) if n[-1].lower() in known and known[n[-1].lower()] != v} for v, q in views.items()}
