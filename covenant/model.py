"""The declared side: what a table should look like."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field


@dataclass(frozen=True)
class Rule:
    """A CHECK: ``expression`` in Spark SQL passes where it is true or null."""

    name: str
    expression: str
    validated: bool = True


@dataclass(frozen=True)
class ColumnSpec:
    """``default`` and ``generated`` are Spark SQL expressions; ``renamed_from`` names
    the column it was; ``labels`` are those of its enum."""

    name: str
    type: str
    not_null: bool = False
    default: str | None = None
    generated: str | None = None
    renamed_from: str | None = None
    domain: DomainSpec | None = None
    labels: tuple[str, ...] = ()


@dataclass(frozen=True)
class KeySpec:
    """A unique key. ``where`` limits it to some rows; ``nulls_distinct`` False
    makes equal nulls clash."""

    name: str
    columns: tuple[str, ...]
    primary: bool = False
    where: str | None = None
    nulls_distinct: bool = True


@dataclass(frozen=True)
class ReferenceSpec:
    """A foreign key, match simple: any null passes."""

    name: str
    columns: tuple[str, ...]
    parent: str
    parent_columns: tuple[str, ...]
    on_delete: str = "no action"


@dataclass(frozen=True)
class DomainSpec:
    """A named bundle of rules over ``VALUE`` for the columns that use it."""

    name: str
    type: str
    not_null: bool = False
    checks: tuple[Rule, ...] = ()


@dataclass(frozen=True)
class ExclusionSpec:
    """No two rows equal on ``equal`` may overlap in ``[lo, hi)``."""

    name: str
    equal: tuple[str, ...]
    lo: str
    hi: str


@dataclass(frozen=True)
class PolicySpec:
    """A row policy. No roles means everyone; a missing ``check`` falls back to ``using``."""

    name: str
    command: str = "all"
    permissive: bool = True
    roles: tuple[str, ...] = ()
    using: str | None = None
    check: str | None = None


@dataclass(frozen=True)
class PartitionSpec:
    """A bound: a half-open range ``[start, end)``, a list of values, or the default."""

    name: str
    start: str | None = None
    end: str | None = None
    values: tuple[str, ...] = ()
    default: bool = False


@dataclass(frozen=True)
class DropPolicy:
    """Kinds of objects that may be dropped; nothing unless named."""

    allowed: frozenset[str] = frozenset()

    def allows(self, kind: str) -> bool:
        return "all" in self.allowed or kind in self.allowed


@dataclass(frozen=True)
class TableContract:
    name: str
    columns: tuple[ColumnSpec, ...]
    keys: tuple[KeySpec, ...] = ()
    checks: tuple[Rule, ...] = ()
    references: tuple[ReferenceSpec, ...] = ()
    policies: tuple[PolicySpec, ...] = field(default=())
    exclusions: tuple[ExclusionSpec, ...] = ()

    def to_json(self) -> str:
        return json.dumps(asdict(self))

    @classmethod
    def from_json(cls, text: str) -> TableContract:
        x = json.loads(text)
        keys = tuple(KeySpec(**k | {"columns": tuple(k["columns"])}) for k in x.get("keys", ()))
        refs = tuple(ReferenceSpec(**r | {"columns": tuple(r["columns"]), "parent_columns": tuple(r["parent_columns"])}) for r in x.get("references", ()))
        policies = tuple(PolicySpec(**p | {"roles": tuple(p.get("roles", ()))}) for p in x.get("policies", ()))
        exclusions = tuple(ExclusionSpec(**e | {"equal": tuple(e["equal"])}) for e in x.get("exclusions", ()))

        def column(c: dict) -> ColumnSpec:
            domain = c.get("domain")
            if domain is not None:
                domain = DomainSpec(**domain | {"checks": tuple(Rule(**r) for r in domain.get("checks", ()))})
            return ColumnSpec(**c | {"domain": domain, "labels": tuple(c.get("labels", ()))})

        return cls(x["name"], tuple(map(column, x["columns"])), keys, tuple(Rule(**r) for r in x.get("checks", ())), refs, policies, exclusions)
