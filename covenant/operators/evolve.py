"""Schema evolution of data: from the current shape to the desired one.

All column changes of a table are one ``select``. Drops are denied unless a
policy allows them; a denied drop keeps the column and is reported.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from covenant.model import DropPolicy, TableContract
from covenant.shared import stored


@dataclass(frozen=True)
class Change:
    kind: str
    object: str
    action: str
    executable: bool
    detail: str = ""


def rename_status(current: Sequence[str], renames: Sequence[tuple[str, str]]) -> list[tuple[str, str, str]]:
    """``(old, new, status)`` in order: each rename sees the names as those before
    it left them, so b->c must come before a->b. A source that another rename
    made is missing."""
    names, out, made = set(current), [], set()
    for old, new in renames:
        if old == new:
            status = "noop"
        elif old not in names or old in made:
            status = "noop" if new in names and old not in names else "missing_source"
        elif new in names:
            status = "dest_exists"
        else:
            status = "applied"
            names = (names - {old}) | {new}
            made.add(new)
        out.append((old, new, status))
    return out


def rename_columns(df: DataFrame, renames: Sequence[tuple[str, str]]) -> DataFrame:
    """One aliased select, so chains and swaps do not cascade."""
    to = {old: new for old, new, status in rename_status(df.columns, renames) if status == "applied"}
    return df.select(*[F.col(f"`{c}`").alias(to.get(c, c)) for c in df.columns])


def cast_value(column: Column, from_type: str, to_type: str) -> Column:
    """A cast that rounds a fraction before it becomes a whole number: decimals
    half away from zero, floating numbers half to even."""
    if to_type in ("smallint", "int", "bigint", "tinyint"):
        column = F.rint(column) if from_type in ("double", "float") else F.round(column) if from_type.startswith("decimal") else column
    return column.cast(to_type)


def add_column(df: DataFrame, name: str, kind: str, default: str | None = None, not_null: bool = False) -> DataFrame:
    if not_null and default is None:
        raise ValueError(f"{name}: a column that may not be null needs a default")
    return df.withColumn(name, F.expr(default).cast(kind) if default is not None else F.lit(None).cast(kind))


def backfill(df: DataFrame, defaults: Mapping[str, str]) -> DataFrame:
    """Fill nulls with defaults; a new default alone touches no old row."""
    return df.withColumns({c: F.coalesce(F.col(c), F.expr(e).cast(dict(df.dtypes)[c])) for c, e in defaults.items()})


def evolve(df: DataFrame, desired: TableContract, policy: DropPolicy = DropPolicy(), backfilled: bool = False) -> tuple[DataFrame, list[Change]]:
    """``df`` in the desired shape and what was done: renames, adds, casts and
    computed columns, then drops. Doing it again changes nothing."""
    changes: list[Change] = []
    kinds = dict(df.dtypes)
    to: dict[str, str] = {}
    for old, new, status in rename_status(df.columns, [(c.renamed_from, c.name) for c in desired.columns if c.renamed_from]):
        if status == "applied":
            to[new] = old
            changes.append(Change("column", new, "rename", True, old))
        elif status != "noop":
            raise ValueError(f"rename {old} to {new}: {status}")
    out = []
    plain: dict[str, Column] = {}
    for spec in desired.columns:
        source = to.get(spec.name, spec.name)
        if spec.generated is not None:
            if source not in kinds:
                changes.append(Change("column", spec.name, "generate", True, spec.generated))
            plain[spec.name] = F.expr(spec.generated).cast(spec.type) if source not in kinds else F.col(f"`{source}`")
        elif source not in kinds:
            if spec.not_null and spec.default is None:
                raise ValueError(f"{spec.name}: a column that may not be null needs a default")
            changes.append(Change("column", spec.name, "add", True, spec.type))
            plain[spec.name] = (F.expr(spec.default) if spec.default is not None else F.lit(None)).cast(spec.type)
        else:
            value = F.col(f"`{source}`")
            if kinds[source] != spec.type:
                changes.append(Change("column", spec.name, "retype", True, f"{kinds[source]} -> {spec.type}"))
                value = cast_value(value, kinds[source], spec.type)
            if backfilled and spec.default is not None:
                value = F.coalesce(value, F.expr(spec.default).cast(spec.type))
            plain[spec.name] = value
        out.append(plain[spec.name].alias(spec.name))
    for c in df.columns:
        if c not in plain and c not in to.values():
            allowed = policy.allows("column")
            changes.append(Change("column", c, "drop" if allowed else "skipped", allowed))
            if not allowed:
                out.append(F.col(f"`{c}`"))
    return df.select(*out), changes


def rename_values(column: Column, renames: Mapping[str, str]) -> Column:
    """Enum labels renamed in one pass over the old ones."""
    if not renames:
        return column
    return F.coalesce(F.create_map(*[F.lit(x) for pair in renames.items() for x in pair])[column], column)


def evolve_struct(column: str, kinds: Mapping[str, str], desired: Sequence[tuple[str, str]], renames: Mapping[str, str] | None = None, policy: DropPolicy = DropPolicy()) -> Column:
    """A struct column with attributes renamed, retyped, added at the end, and
    dropped if the policy allows."""
    old_of = {new: old for old, new in (renames or {}).items()}
    fields, used = [], set()
    for name, kind in desired:
        source = old_of.get(name, name)
        used.add(source)
        value = cast_value(F.col(column)[source], kinds[source], kind) if source in kinds else F.lit(None).cast(kind)
        fields.append(value.alias(name))
    if not policy.allows("composite_type"):
        fields += [F.col(column)[k].alias(k) for k in kinds if k not in used]
    return F.when(F.col(column).isNotNull(), F.struct(*fields))


def dense_rank_rows(df: DataFrame, order: Sequence[str], name: str = "position") -> DataFrame:
    """``df`` with 0, 1, .. in the order of ``order`` (a full key), without a
    window over all rows: ranges of the key, their sizes, then numbers within."""
    ranged = df.repartitionByRange(*order).withColumn("__part", F.spark_partition_id())
    rows = stored(ranged, "ranges")
    sizes = rows.groupBy("__part").count().collect()  # a row per partition
    offsets, total = [], 0
    for r in sorted(sizes):
        offsets.append((r[0], total))
        total += r[1]
    given = df.sparkSession.createDataFrame(offsets, "__part int, __before long")
    w = Window.partitionBy("__part").orderBy(*order)
    return rows.join(F.broadcast(given), "__part").withColumn(name, F.col("__before") + F.row_number().over(w) - 1).drop("__part", "__before")


def assign_identity(df: DataFrame, order: Sequence[str], column: str, always: bool = True, start: int = 1, increment: int = 1, least: int | None = None, most: int | None = None, cycle: bool = False) -> DataFrame:
    """Sequence values by the order of a full key. ``always`` overrides given
    values; otherwise only nulls are filled. Beyond the bounds a cycling sequence
    begins again, any other is an error."""
    low = least if least is not None else (1 if increment > 0 else -(2**63))
    high = most if most is not None else (2**63 - 1 if increment > 0 else -1)
    numbered = dense_rank_rows(df, order, "__n")
    value = F.lit(start) + F.col("__n") * F.lit(increment)
    if cycle:
        first = (high - start) // increment + 1 if increment > 0 else (start - low) // -increment + 1
        again = (high - low) // abs(increment) + 1
        restart = low if increment > 0 else high
        value = F.when(F.col("__n") < first, value).otherwise(F.lit(restart) + F.pmod(F.col("__n") - first, F.lit(again)) * increment)
    else:
        value = F.when(value.between(low, high), value).otherwise(F.raise_error(F.lit("sequence is exhausted")).cast("long"))
    given = value if always or column not in df.columns else F.coalesce(F.col(column), value)
    return numbered.withColumn(column, given.cast("long")).drop("__n")


def set_not_null(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The remaining null rows of each column: it may be declared once there are none."""
    from covenant.operators.audit import null_counts

    return null_counts(df, columns)


def rollout_not_null(df: DataFrame, column: str, default: str, since: str) -> DataFrame:
    """The safe way to NOT NULL, step by step, with the nulls left after each."""
    filled = backfill(df, {column: default})
    count = lambda rows: rows.agg(F.count_if(F.col(column).isNull()).alias("nulls"))
    steps = [("1 add check, not valid", count(df.where(F.expr(since)))), ("2 backfill", count(filled)), ("3 validate", count(filled)), ("4 set not null", count(filled))]
    return reduce(DataFrame.unionByName, [d.select(F.lit(s).alias("step"), "nulls") for s, d in steps])


def rollout_states(rows: DataFrame, arriving: DataFrame, column: str, default: str, by: Sequence[str] = ()) -> DataFrame:
    """What each step of the safe way to NOT NULL leaves, for each group of ``by``.

    ``(*by, step, nulls, refused, check_state, not_null)``: a check that is not yet
    valid stands in front of ``arriving`` rows and refuses those with a null;
    ``rows``, which are older, are then filled by ``default``. The check is valid only
    if no null is left (a default may be null itself), only a valid check lets the
    column be declared, and only then does the check go. ``refused`` counts the
    arriving rows that the check keeps out as of its step.

    Both sides are read once and counted before the shuffle. Null keys are a group;
    a group of only one side has no nulls on the other. Without ``by`` empty tables
    have nothing left, with it they give an empty table. Other columns are ignored.
    """
    names = [f"__by{i}" for i in range(len(by))]
    empty, stays = F.col(column).isNull(), F.col(column).isNull() & F.expr(default).isNull()

    def side(df: DataFrame, old: bool) -> DataFrame:
        keys = [F.col(c).alias(n) for c, n in zip(by, names, strict=True)]
        return df.select(*keys, empty.alias("__null"), (stays if old else F.lit(False)).alias("__stays"), F.lit(old).alias("__old"))

    empties = {"__before": F.col("__null") & F.col("__old"), "__after": F.col("__stays"), "__out": F.col("__null") & ~F.col("__old")}
    counts = side(rows, True).unionByName(side(arriving, False)).groupBy(*names).agg(*(F.count_if(c).alias(n) for n, c in empties.items()))
    valid = F.col("__after") == 0
    checked = F.when(valid, "valid").otherwise("not valid")
    none = F.lit(0).cast("long")
    steps = [
        ("1 nullable", F.col("__before"), none, F.lit("none"), F.lit(False)),
        ("2 check, not valid", F.col("__before"), F.col("__out"), F.lit("not valid"), F.lit(False)),
        ("3 backfill", F.col("__after"), F.col("__out"), F.lit("not valid"), F.lit(False)),
        ("4 validate", F.col("__after"), F.col("__out"), checked, F.lit(False)),
        ("5 set not null", F.col("__after"), F.col("__out"), checked, valid),
        ("6 drop check", F.col("__after"), F.col("__out"), F.when(valid, "none").otherwise("not valid"), valid),
    ]
    told = [F.struct(F.lit(step).alias("step"), *(c.alias(n) for c, n in zip(cells, ("nulls", "refused", "check_state", "not_null"), strict=True))) for step, *cells in steps]
    return counts.select(*(F.col(n).alias(c) for c, n in zip(by, names, strict=True)), F.inline(F.array(*told)))
