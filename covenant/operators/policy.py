"""Row policies as filters."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from covenant.functions.logic import visible
from covenant.model import PolicySpec


def applies(policy: PolicySpec, command: str, role: str) -> bool:
    return policy.command in ("all", command) and (not policy.roles or role in policy.roles or "public" in policy.roles)


def combined(policies: Sequence[PolicySpec], clause: str) -> Column:
    """(any permissive) and (every restrictive); without a permissive policy nothing passes."""
    text = lambda p: p.using if clause == "using" or p.check is None else p.check
    say = lambda p: visible(F.expr(text(p))) if text(p) is not None else F.lit(True)
    allowed = reduce(lambda a, b: a | b, [say(p) for p in policies if p.permissive], F.lit(False))
    return reduce(lambda a, b: a & b, [say(p) for p in policies if not p.permissive], allowed)


def read_filter(policies: Sequence[PolicySpec], role: str, enabled: bool = True, owner: str | None = None, forced: bool = False) -> Column:
    if not enabled or owner == role and not forced:
        return F.lit(True)
    return combined([p for p in policies if applies(p, "select", role)], "using")


def write_check(df: DataFrame, policies: Sequence[PolicySpec], role: str, command: str) -> tuple[DataFrame, DataFrame]:
    """Rows that may be written and rows that may not."""
    ok = combined([p for p in policies if applies(p, command, role)], "check")
    return df.where(ok), df.where(~ok)


def visible_counts(df: DataFrame, policies: Sequence[PolicySpec], roles: Sequence[str]) -> DataFrame:
    """``(role, rows)``: rows that each role sees, in one scan."""
    counted = df.agg(*[F.count_if(read_filter(policies, r)).alias(r) for r in roles])
    return counted.select(F.explode(F.array(*[F.struct(F.lit(r).alias("role"), F.col(r).alias("rows")) for r in roles])).alias("x")).select("x.*")


def impact(df: DataFrame, before: Sequence[PolicySpec], after: Sequence[PolicySpec], roles: Sequence[str]) -> DataFrame:
    """``(role, gained, lost)`` between two sets of policies, in one scan."""
    parts: Mapping[str, tuple[Column, Column]] = {r: (read_filter(before, r), read_filter(after, r)) for r in roles}
    counted = df.agg(*[F.struct(F.count_if(~a & b).alias("gained"), F.count_if(a & ~b).alias("lost")).alias(r) for r, (a, b) in parts.items()])
    return counted.select(F.explode(F.array(*[F.struct(F.lit(r).alias("role"), F.col(f"`{r}`.gained"), F.col(f"`{r}`.lost")) for r in roles])).alias("x")).select("x.*")
