"""What a delete does to all tables that refer to the deleted rows, however far.

References form a graph of tables. Its components (a self reference, or tables
that refer to each other in a circle) are taken in the order of the references: a
table outside of any circle meets each of its references once, whatever the rows;
within a circle a semi-naive fixpoint joins only the rows that the last round added.
Rows are carried as the columns that keys and references name.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce
from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from covenant.model import ReferenceSpec, TableContract
from covenant.shared import stored

ACTIONS = ("cascade", "set null", "set default", "restrict", "no action")


@dataclass(frozen=True)
class Deletion:
    """``deleted`` and ``kept`` rows by table (only tables that a delete may reach;
    deleted rows as keys and references), ``vetoed`` roots, and the ``violations
    (reference, child, child_key, parent, parent_key)`` that veto them, keys as
    JSON."""

    deleted: Mapping[str, DataFrame]
    kept: Mapping[str, DataFrame]
    vetoed: DataFrame
    violations: DataFrame


@dataclass(frozen=True)
class Link:
    child: str
    spec: ReferenceSpec

    @property
    def parent(self) -> str:
        return self.spec.parent


def components(nodes: Iterable[str], after: Mapping[str, set[str]]) -> list[list[str]]:
    """Tables in the order of what reaches them; those in a circle together. The
    graph is that of declared tables, not of rows."""
    nodes = list(nodes)
    reach = {n: {n} for n in nodes}
    for _ in nodes:
        for n in nodes:
            reach[n] |= {x for m in after.get(n, ()) for x in reach[m]}
    left, out = list(nodes), []
    while left:
        first = next(n for n in left if all(m in reach[n] for m in left if n in reach[m]))
        group = [m for m in left if m in reach[first] and first in reach[m]]
        out.append(group)
        left = [m for m in left if m not in group]
    return out


def matches(left: DataFrame, columns: Sequence[str], right: DataFrame, others: Sequence[str], how: str, null_safe: bool = False) -> DataFrame:
    """Semi or anti join of ``left`` on distinct ``others`` of ``right``."""
    keys = right.select(*(F.col(c).alias(f"__r{i}") for i, c in enumerate(others))).distinct()
    on = [F.col(c).eqNullSafe(F.col(f"__r{i}")) if null_safe else F.col(c) == F.col(f"__r{i}") for i, c in enumerate(columns)]
    return left.join(keys, reduce(Column.__and__, on), how)


def union(parts: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


class Propagation:
    def __init__(self, tables: Mapping[str, DataFrame], contracts: Mapping[str, TableContract], root: str):
        self.tables, self.contracts, self.root = tables, contracts, root
        self.links = [Link(t, r) for t, c in contracts.items() if t in tables for r in c.references if r.parent in tables]
        for link in self.links:
            if link.spec.on_delete not in ACTIONS:
                raise ValueError(f"unknown action {link.spec.on_delete!r}")
        cascades = {t: {x.child for x in self.of("cascade") if x.parent == t} for t in tables}
        reached = {root}
        for _ in tables:
            reached |= {c for t in reached for c in cascades[t]}
        self.order = components([t for t in tables if t in reached], cascades)
        self.base = {t: self.narrow(t) for t in tables}
        for group in self.order:
            if self.circular(group):
                self.base |= {t: stored(self.base[t], f"delete-{t}") for t in group}
        self.invalid = {x for x in self.of("set default") if not self.default_exists(x)}

    def of(self, *actions: str) -> list[Link]:
        return [x for x in self.links if x.spec.on_delete in actions]

    def key(self, table: str) -> tuple[str, ...]:
        found = [k.columns for k in self.contracts[table].keys if k.primary]
        if not found:
            raise ValueError(f"{table} has no primary key")
        return found[0]

    def narrow(self, table: str) -> DataFrame:
        own = [c for k in self.contracts[table].keys if k.primary for c in k.columns]
        own += [c for x in self.links if x.child == table for c in x.spec.columns]
        own += [c for x in self.links if x.parent == table for c in x.spec.parent_columns]
        return self.tables[table].select(*dict.fromkeys(own))

    def circular(self, group: Sequence[str]) -> bool:
        return any(x.child in group and x.parent in group for x in self.of("cascade"))

    def default_row(self, link: Link) -> DataFrame:
        told = {c.name: c.default for c in self.contracts[link.child].columns}
        kinds = dict(self.tables[link.child].dtypes)
        one = self.tables[link.child].sparkSession.range(1)
        return one.select(*(F.expr(told.get(c) or "NULL").cast(kinds[c]).alias(c) for c in link.spec.columns))

    def default_exists(self, link: Link) -> bool:
        """Whether the default refers to a row, or is null somewhere."""
        row = self.default_row(link)
        null = reduce(Column.__or__, [F.col(c).isNull() for c in link.spec.columns])
        return not row.where(null).isEmpty() or not matches(row, link.spec.columns, self.base[link.parent], link.spec.parent_columns, "left_semi").isEmpty()

    def fixpoint(self, group: Sequence[str], seeds: Mapping[str, DataFrame], step: Callable[[str, str, DataFrame, Link], DataFrame], upward: bool) -> dict[str, DataFrame]:
        """Rows of a circle that ``seeds`` reach; each round joins the last one's."""
        seen = front = {t: stored(df.distinct(), f"delete-front-{t}") for t, df in seeds.items()}
        inside = [x for x in self.of("cascade") if x.child in group and x.parent in group]
        for _ in count():
            found: dict[str, list[DataFrame]] = {}
            for x in inside:
                at, to = (x.child, x.parent) if upward else (x.parent, x.child)
                if at in front:
                    found.setdefault(to, []).append(step(at, to, front[at], x))
            front = {}
            for t, parts in found.items():
                new = union(parts).distinct()
                if t in seen:
                    new = matches(new, new.columns, seen[t], new.columns, "left_anti", null_safe=True)
                new = stored(new, f"delete-front-{t}")
                if not new.isEmpty():
                    front[t] = new
            if not front:
                return seen
            seen = seen | {t: seen[t].unionByName(df) if t in seen else df for t, df in front.items()}

    def closure(self, roots: DataFrame) -> dict[str, DataFrame]:
        """What goes with ``roots`` (rows of the root table), by table."""
        down = lambda at, to, rows, x: matches(self.base[to], x.spec.columns, rows, x.spec.parent_columns, "left_semi")
        gone: dict[str, DataFrame] = {}
        for group in self.order:
            seeds: dict[str, list[DataFrame]] = {self.root: [roots]} if self.root in group else {}
            for x in self.of("cascade"):
                if x.child in group and x.parent not in group and x.parent in gone:
                    seeds.setdefault(x.child, []).append(down(x.parent, x.child, gone[x.parent], x))
            made = {t: union(parts) for t, parts in seeds.items()}
            gone |= self.fixpoint(group, made, down, False) if self.circular(group) else {t: stored(df.distinct(), f"delete-{t}") for t, df in made.items()}
        return gone

    def violations(self, gone: Mapping[str, DataFrame]) -> list[tuple[Link, DataFrame]]:
        """By reference, the child rows that forbid that their parents go."""
        out = []
        for x in self.of("restrict", "no action", "set default"):
            if x.parent not in gone:
                continue
            hit = matches(self.base[x.child], x.spec.columns, gone[x.parent], x.spec.parent_columns, "left_semi")
            if x.spec.on_delete != "restrict" and x.child in gone:
                key = self.key(x.child)
                hit = matches(hit, key, gone[x.child], key, "left_anti", null_safe=True)
            if x.spec.on_delete == "set default" and x not in self.invalid:
                if matches(self.default_row(x), x.spec.columns, gone[x.parent], x.spec.parent_columns, "left_semi").isEmpty():
                    continue
            out.append((x, stored(hit, "delete-violations")))
        return out

    def blocked(self, gone: Mapping[str, DataFrame], found: Sequence[tuple[Link, DataFrame]]) -> DataFrame:
        """Rows of the root table from which a violation is reached, going up."""
        up = lambda at, to, rows, x: matches(gone.get(to, self.base[to].limit(0)), x.spec.parent_columns, rows, x.spec.columns, "left_semi")
        stopped: dict[str, DataFrame] = {}
        for group in reversed(self.order):
            seeds: dict[str, list[DataFrame]] = {}
            for x, rows in found:
                if x.parent in group:
                    seeds.setdefault(x.parent, []).append(up(x.child, x.parent, rows, x))
            for x in self.of("cascade"):
                if x.parent in group and x.child not in group and x.child in stopped and x.parent in gone:
                    seeds.setdefault(x.parent, []).append(up(x.child, x.parent, stopped[x.child], x))
            made = {t: union(parts) for t, parts in seeds.items()}
            stopped |= self.fixpoint(group, made, up, True) if self.circular(group) and made else {t: stored(df.distinct(), f"delete-up-{t}") for t, df in made.items()}
        return stopped.get(self.root, gone[self.root].limit(0))

    def kept(self, gone: Mapping[str, DataFrame]) -> dict[str, DataFrame]:
        out = {}
        touched = {x.child for x in self.of("set null", "set default") if x.parent in gone} | set(gone)
        for t in touched:
            rows = self.tables[t]
            if t in gone:
                rows = matches(rows, self.key(t), gone[t], self.key(t), "left_anti", null_safe=True)
            for x in self.of("set null", "set default"):
                if x.child == t and x.parent in gone:
                    keys = gone[x.parent].select(*(F.col(c).alias(f"__r{i}") for i, c in enumerate(x.spec.parent_columns)), F.lit(True).alias("__hit")).distinct()
                    on = [F.col(c) == F.col(f"__r{i}") for i, c in enumerate(x.spec.columns)]
                    told = {c.name: c.default for c in self.contracts[t].columns} if x.spec.on_delete == "set default" else {}
                    kinds = dict(rows.dtypes)
                    put = {c: F.when(F.col("__hit"), F.expr(told.get(c) or "NULL").cast(kinds[c])).otherwise(F.col(c)) for c in x.spec.columns}
                    rows = rows.join(keys, reduce(Column.__and__, on), "left").withColumns(put).select(*self.tables[t].columns)
            out[t] = rows
        return out


def propagate_deletes(tables: Mapping[str, DataFrame], contracts: Mapping[str, TableContract], root: str, deleted: DataFrame) -> Deletion:
    """Delete the rows of ``root`` with the keys ``deleted`` and follow all references.

    ``cascade`` deletes what refers to a deleted row, in turn; ``set null`` and ``set
    default`` keep it with the column's declared default or null. A root is vetoed
    with all it would take along when what it reaches has a row that refers to it
    by ``restrict``, one that refers to it by ``no action`` and does not go itself,
    or one that would be given a default that refers to nothing that stays. The
    others go together, in one statement. Since vetoes leave fewer rows that go,
    and ``no action`` asks what goes, this is repeated until no root is vetoed: what
    is left is the largest set of roots that can go, as far as defaults stay valid.

    Keys of no row delete nothing. Match simple: a reference with a null refers to
    nothing. Tables need a primary key where a delete may reach them; rows that
    share a key go together. Self references and circles end, as a row is reached
    once.
    """
    p = Propagation(tables, contracts, root)
    key = p.key(root)
    roots = stored(matches(p.base[root], key, deleted, key, "left_semi").distinct(), "delete-roots")
    told: list[DataFrame] = []
    vetoed = roots.limit(0).select(*key)
    while True:
        gone = p.closure(roots)
        found = p.violations(gone)
        stopped = stored(matches(roots, key, p.blocked(gone, found), key, "left_semi", null_safe=True).select(*key), "delete-vetoed")
        for x, rows in found:
            as_text = lambda columns: F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})
            child = p.key(x.child) if any(k.primary for k in contracts[x.child].keys) else x.spec.columns
            parent_key = F.struct(*(F.col(c).alias(d) for c, d in zip(x.spec.columns, x.spec.parent_columns, strict=True)))
            told.append(rows.select(F.lit(x.spec.name).alias("reference"), F.lit(x.child).alias("child"), as_text(child).alias("child_key"), F.lit(x.parent).alias("parent"), F.to_json(parent_key).alias("parent_key")))
        if stopped.isEmpty():
            break
        vetoed = vetoed.unionByName(stopped)
        roots = stored(matches(roots, key, stopped, key, "left_anti", null_safe=True), "delete-roots")
    none = "reference string, child string, child_key string, parent string, parent_key string"
    violations = union(told).distinct() if told else roots.sparkSession.createDataFrame([], none)
    return Deletion(gone, p.kept(gone), vetoed, violations)
