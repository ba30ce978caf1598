"""Contract audits: the rows that break a declared constraint.

Every audit takes a DataFrame and returns one, lazily; counts of rules in one
scan where rules allow it.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from covenant.functions.logic import fails
from covenant.model import DomainSpec, KeySpec, Rule, TableContract
from covenant.operators import scan


def null_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``(column, nulls)`` for all columns in one pass."""
    counted = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    return counted.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("nulls")) for c in columns])).alias("x")).select("x.column", "x.nulls")


def null_rows(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.where(reduce(lambda a, b: a | b, [F.col(c).isNull() for c in columns]))


def duplicate_keys(df: DataFrame, key: KeySpec) -> DataFrame:
    """Keys that several rows hold, as ``(*columns, rows)``. Column names may be
    expressions. Only groups are shuffled, partly counted before."""
    rows = df if key.where is None else df.where(F.expr(key.where))
    named = [F.expr(c).alias(f"k{i}" if not c.isidentifier() else c) for i, c in enumerate(key.columns)]
    keys = rows.select(*named)
    if key.nulls_distinct:
        keys = keys.na.drop("any")
    return keys.groupBy(*keys.columns).agg(F.count("*").alias("rows")).where("rows > 1")


def duplicate_rows(df: DataFrame, key: KeySpec) -> DataFrame:
    """The rows that share a key, by a semi-join on the clashing keys."""
    clash = duplicate_keys(df, key).drop("rows")
    held = clash.select(*[F.col(c).alias(f"__{c}") for c in clash.columns])
    return df.join(held, reduce(lambda a, b: a & b, [df[c].eqNullSafe(F.col(f"__{c}")) for c in clash.columns]), "left_semi")


def primary_key(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``(*columns, reason, rows)``: null keys and duplicate keys."""
    nulls = null_rows(df, columns).groupBy(*columns).agg(F.count("*").alias("rows")).withColumn("reason", F.lit("null"))
    double = duplicate_keys(df, KeySpec("pk", tuple(columns))).withColumn("reason", F.lit("duplicate"))
    return nulls.unionByName(double).select(*columns, "reason", "rows")


def violations(rules: Sequence[Rule]) -> Column:
    """The names of the rules that a row breaks, as an array."""
    return F.array_compact(F.array(*[F.when(fails(F.expr(r.expression)), F.lit(r.name)) for r in rules]))


def check(df: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """Rows that break any of the rules, with ``violated array<string>``; one scan."""
    return df.withColumn("violated", violations(rules)).where(F.size("violated") > 0)


def staged(df: DataFrame, rules: Sequence[Rule], mode: str, since: str | None = None) -> DataFrame:
    """Rules by what was validated: ``new_only`` checks rows that meet ``since``,
    ``backlog`` the others, ``all`` every row, ``skip`` none."""
    rows = {"all": lambda: df, "skip": lambda: df.where(F.lit(False)), "new_only": lambda: df.where(F.coalesce(F.expr(since), F.lit(False))), "backlog": lambda: df.where(~F.coalesce(F.expr(since), F.lit(False)))}[mode]()
    return check(rows, rules)


def foreign_key(child: DataFrame, columns: Sequence[str], parent: DataFrame, parent_columns: Sequence[str]) -> DataFrame:
    """Child rows without a parent; a null in any column passes. The parent's keys
    are made distinct before the anti-join."""
    keys = parent.select(*[F.col(c).alias(f"__p{i}") for i, c in enumerate(parent_columns)]).distinct()
    asked = child.where(reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in columns]))
    on = reduce(lambda a, b: a & b, [F.col(c) == F.col(f"__p{i}") for i, c in enumerate(columns)])
    return asked.join(keys, on, "left_anti")


def domain(df: DataFrame, spec: DomainSpec, columns: Sequence[str]) -> DataFrame:
    """Rows whose columns of the domain break it: ``violated`` names column.rule."""
    rules = []
    for c in columns:
        if spec.not_null:
            rules.append(Rule(f"{c}.not_null", f"`{c}` IS NOT NULL"))
        rules += [Rule(f"{c}.{r.name}", of_value(r.expression, c), r.validated) for r in spec.checks]
    return check(df, rules)


def of_value(expression: str, column: str) -> str:
    """A domain's rule for one column: the word VALUE, outside of literals and
    quoted names, stands for the column."""
    return re.sub(r"'(?:[^']|'')*'|`[^`]*`|\bVALUE\b", lambda m: f"`{column}`" if m[0].upper() == "VALUE" else m[0], expression, flags=re.I)


def column_rules(contract: TableContract) -> list[Rule]:
    """What a contract's columns demand of a row: not null, domain, labels and
    generated values, named ``column.rule``."""
    out = []
    for c in contract.columns:
        if c.not_null or c.domain is not None and c.domain.not_null:
            out.append(Rule(f"{c.name}.not_null", f"`{c.name}` IS NOT NULL"))
        if c.domain is not None:
            out += [Rule(f"{c.name}.{r.name}", of_value(r.expression, c.name), r.validated) for r in c.domain.checks]
        if c.labels:
            listed = ", ".join("'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'" for x in c.labels)
            out.append(Rule(f"{c.name}.labels", f"`{c.name}` IN ({listed})"))
        if c.generated is not None:
            out.append(Rule(f"{c.name}.generated", f"`{c.name}` <=> ({c.generated})"))
    return out


def enum_outside(df: DataFrame, column: str, labels: Sequence[str]) -> DataFrame:
    return df.where(F.col(column).isNotNull() & ~F.col(column).isin(list(labels)))


def enum_usage(df: DataFrame, column: str, labels: Sequence[str]) -> DataFrame:
    """``(label, ordinal, uses)``; unused labels have 0."""
    listed = df.sparkSession.createDataFrame([(x, i) for i, x in enumerate(labels)], "label string, ordinal int")
    used = df.groupBy(F.col(column).alias("label")).agg(F.count("*").alias("n"))
    return listed.join(used, "label", "left").select("label", "ordinal", F.coalesce("n", F.lit(0)).cast("long").alias("uses"))


def exclusion_pairs(df: DataFrame, key: str, equal: Sequence[str], lo: str, hi: str) -> DataFrame:
    """``(a, b)``: pairs of rows equal on ``equal`` whose ranges ``[lo, hi)`` overlap
    (`scan.overlaps`); a null in ``equal`` clashes with nothing."""
    return scan.overlaps(df, key, equal, lo, hi)


def exclusion_rows(df: DataFrame, key: str, equal: Sequence[str], lo: str, hi: str) -> DataFrame:
    """Rows that overlap an earlier one (by ``lo``, ``key``): no pairs are made. A null
    in ``equal`` clashes with nothing. The latest end so far comes from a prefix scan,
    so a hot value of ``equal`` is spread."""
    asked = df.where((F.col(lo) < F.col(hi)) & reduce(Column.__and__, [F.col(c).isNotNull() for c in equal], F.lit(True)))
    return scan.running(asked, equal, [lo, key], {"__most": ("max", F.col(hi))}).where(F.col("__most") > F.col(lo)).drop("__most")


def type_conformance(df: DataFrame, types: Mapping[str, str], lengths: Mapping[str, int] | None = None) -> DataFrame:
    """Rows with values that a cast would lose: ``violated`` names columns."""
    marks = [F.when(F.col(c).isNotNull() & F.expr(f"try_cast(`{c}` AS {t})").isNull(), F.lit(c)) for c, t in types.items()]
    marks += [F.when(F.char_length(c) > n, F.lit(f"{c}.length")) for c, n in (lengths or {}).items()]
    return df.withColumn("violated", F.array_compact(F.array(*marks))).where(F.size("violated") > 0)


def generated(df: DataFrame, column: str, expression: str) -> DataFrame:
    """Rows whose stored value is not what the expression gives."""
    return df.where(~F.col(column).eqNullSafe(F.expr(expression)))


def sequence_values(df: DataFrame, column: str, start: int = 1, increment: int = 1, least: int | None = None, most: int | None = None) -> DataFrame:
    """Rows whose value is out of bounds or off the grid, with ``reason``."""
    low = least if least is not None else (1 if increment > 0 else -(2**63))
    high = most if most is not None else (2**63 - 1 if increment > 0 else -1)
    c = F.col(column)
    reason = F.when((c < low) | (c > high), "bounds").when(F.pmod(c - start, F.lit(abs(increment))) != 0, "grid")
    return df.withColumn("reason", reason).where("reason IS NOT NULL")


def net_changes(base: DataFrame, changes: DataFrame, key: Sequence[str], order: str, op: str = "op") -> DataFrame:
    """The state after a batch of changes: the last one of a key wins, and op
    ``delete`` removes it. Deferred checks are audits of this state."""
    w = Window.partitionBy(*key).orderBy(F.desc(order))
    last = changes.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")
    kept = base.join(last.select(*key), list(key), "left_anti")
    return kept.unionByName(last.where(F.col(op) != "delete").select(*base.columns))


def duplicate_definitions(objects: DataFrame, key: Sequence[str]) -> DataFrame:
    return objects.groupBy(*key).agg(F.count("*").alias("definitions")).where("definitions > 1")


def dangling_columns(objects: DataFrame, columns: DataFrame, table: Sequence[str] = ("db_id", "schema", "table")) -> DataFrame:
    """``(*table, name, column)``: columns that an object names and its table lacks, once each.

    The sides are sorted and merged: catalogs come out of arrays, whose rows Spark's
    estimate does not count, and which it would send whole to every task."""
    named = objects.select(*table, "name", F.explode("columns").alias("column")).distinct()
    held = columns.select(*table, F.col("name").alias("column")).hint("merge")
    return named.join(held, [*table, "column"], "left_anti").select(*table, "name", "column")


def summary(found: Mapping[str, tuple[DataFrame, str]]) -> DataFrame:
    """``(rule, violations, sample)``: a row per audit, with the least key found;
    rules without violations have 0 and null."""
    parts = [df.agg(F.count("*").alias("violations"), F.min(F.expr(key).cast("string")).alias("sample")).select(F.lit(rule).alias("rule"), "violations", "sample") for rule, (df, key) in found.items()]
    return reduce(DataFrame.unionByName, parts)


def audit(df: DataFrame, contract: TableContract, key: str, parents: Mapping[str, DataFrame], whole: bool = False) -> DataFrame:
    """A contract's keys, references and checks as one `summary`; with ``whole``
    its exclusions and what its columns demand too. Checks and demands are counted
    in one scan, the others each by a plan of its own. Rules that are declared not
    validated are left out, as old rows need not meet them."""
    found: dict[str, tuple[DataFrame, str]] = {}
    for k in contract.keys:
        rows = primary_key(df, k.columns) if k.primary else duplicate_keys(df, k)
        found[k.name] = (rows, f"`{k.columns[0]}`" if k.columns[0] in rows.columns else rows.columns[0])
    for r in contract.references:
        found[r.name] = (foreign_key(df, r.columns, parents[r.parent], r.parent_columns), f"`{key}`")
    for e in contract.exclusions if whole else ():
        found[e.name] = (exclusion_rows(df, key, e.equal, e.lo, e.hi), f"`{key}`")
    rules = [r for r in [*(column_rules(contract) if whole else ()), *contract.checks] if r.validated]
    parts = [summary(found)] if found else []
    if rules:
        counted = df.agg(*[F.struct(F.count_if(fails(F.expr(r.expression))).alias("violations"), F.min(F.when(fails(F.expr(r.expression)), F.col(key).cast("string"))).alias("sample")).alias(f"r{i}") for i, r in enumerate(rules)])
        parts.append(counted.select(F.explode(F.array(*[F.struct(F.lit(r.name).alias("rule"), F.col(f"r{i}.violations"), F.col(f"r{i}.sample")) for i, r in enumerate(rules)])).alias("x")).select("x.*"))
    if not parts:
        return df.sparkSession.createDataFrame([], "rule string, violations long, sample string")
    return reduce(DataFrame.unionByName, parts)
