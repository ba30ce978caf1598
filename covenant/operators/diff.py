"""Snapshot diff: what to create, alter and drop between two keyed tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from covenant.functions import logic
from covenant.operators import scan
from covenant.shared import stored, stored_with


def keyed_diff(current: DataFrame, desired: DataFrame, key: Sequence[str]) -> DataFrame:
    """``(*key, change, *old_c, *new_c)`` with change create, drop, alter or same.

    Rows meet in one full outer join by a null-safe key; the other columns are
    compared null-safe.
    """
    rest = [c for c in desired.columns if c not in key]
    side = lambda df, p: df.select(*[F.col(c).alias(f"__{p}_{c}") for c in key], *[F.col(c).alias(f"{p}_{c}") for c in rest], F.lit(True).alias(f"__{p}"))
    old, new = side(current, "old"), side(desired, "new")
    on = reduce(lambda a, b: a & b, [F.col(f"__old_{c}").eqNullSafe(F.col(f"__new_{c}")) for c in key])
    both = old.join(new, on, "full_outer")
    same = reduce(lambda a, b: a & b, [F.col(f"old_{c}").eqNullSafe(F.col(f"new_{c}")) for c in rest], F.lit(True))
    change = F.when(F.col("__old").isNull(), "create").when(F.col("__new").isNull(), "drop").when(same, "same").otherwise("alter")
    keys = [F.when(F.col("__new").isNotNull(), F.col(f"__new_{c}")).otherwise(F.col(f"__old_{c}")).alias(c) for c in key]
    return both.select(*keys, change.alias("change"), *[f"old_{c}" for c in rest], *[f"new_{c}" for c in rest])


def attribute_diff(diff: DataFrame, key: Sequence[str]) -> DataFrame:
    """``(*key, attribute, old, new)``: a row per changed attribute of an alter."""
    attributes = [c.removeprefix("new_") for c in diff.columns if c.startswith("new_")]
    if not attributes:
        return diff.where("false").select(*key, *(F.lit(None).cast("string").alias(c) for c in ("attribute", "old", "new")))
    parts = F.array(*[F.struct(F.lit(a).alias("attribute"), F.col(f"old_{a}").cast("string").alias("old"), F.col(f"new_{a}").cast("string").alias("new"), (~F.col(f"old_{a}").eqNullSafe(F.col(f"new_{a}"))).alias("changed")) for a in attributes])
    return diff.where("change = 'alter'").select(*key, F.explode(parts).alias("x")).where("x.changed").select(*key, "x.attribute", "x.old", "x.new")


def resolve_renames(current: DataFrame, desired: DataFrame, renames: DataFrame, key: str = "name", scope: Sequence[str] = ("db_id",)) -> DataFrame:
    """``renames (*scope, old, new, ordinal)`` with ``rename_status``.

    Within a scope renames are taken one after the other, by ordinal (ties by old
    and new name), each against the names that those before it left: ``noop`` for
    the same name, or where the old name is gone and the new one there;
    ``missing_source``; ``dest_exists``; ``cross_schema`` where ``renames`` has
    columns ``old_schema`` and ``new_schema`` and they differ; else ``applied``,
    which frees the old name and takes the new one. ``desired`` only says which
    renames are asked for: a new name it lacks is ignored.

    A rename asks whether its two names are there, and each was left so by the last
    rename before that touched it. With one of the two known, what the rename leaves
    is known or what the other one is, so such answers are pointers, which double
    along chains: rounds go by the logarithm of the longest chain, and no scope has
    to be in one task.
    """
    scope = list(scope)
    asked = renames.join(desired.select(*scope, F.col(key).alias("new")).distinct(), [*scope, "new"], "left_semi")
    crossed = F.coalesce(~F.col("old_schema").eqNullSafe(F.col("new_schema")), F.lit(False)) if {"old_schema", "new_schema"} <= set(renames.columns) else F.lit(False)
    turns = scan.running(asked.select(*scope, "old", "new", "ordinal", crossed.alias("__crossed")), scope, ["ordinal", "old", "new"], {"__t": ("sum", F.lit(1).cast("long"))})
    turns = stored(turns.withColumn("__t", F.coalesce("__t", F.lit(0))), "renames")
    moving = turns.where("old <> new")
    touches = moving.select(*scope, "__t", F.col("old").alias("__name"), F.lit(0).alias("__role")).unionByName(moving.select(*scope, "__t", F.col("new").alias("__name"), F.lit(1).alias("__role")))
    # what a touch leaves is named by its turn and role
    touches = scan.before(touches, [*scope, "__name"], ["__t"], {"ref": F.col("__t") * 2 + F.col("__role")})
    names = current.select(*scope, F.col(key).alias("__name"), F.lit(True).alias("__there")).distinct()
    first = F.when(F.col("ref").isNull(), F.coalesce("__there", F.lit(False)))
    told = touches.join(names, [*scope, "__name"], "left").select(*scope, "__t", "__role", first.alias("v"), "ref")
    of = lambda role, c: F.max(F.when(F.col("__role") == role, F.col(c)))
    asks = told.groupBy(*scope, "__t").agg(of(0, "v").alias("pv"), of(0, "ref").alias("pr"), of(1, "v").alias("qv"), of(1, "ref").alias("qr"))
    asks = stored(asks.join(moving.select(*scope, "__t", "__crossed"), [*scope, "__t"]), "rename-asks")
    while True:
        left = left_by(asks, scope)
        for _ in range(2):
            left = led_on(left, scope, "ref", "v", "to")
        for v, r in (("pv", "pr"), ("qv", "qr")):
            asks = answered(asks, left, scope, v, r)
        asks, seen = stored_with(asks, "rename-asks", open=F.count_if(F.col("pr").isNotNull() | F.col("qr").isNotNull()))
        if not seen["open"]:
            break
    rows = turns.join(asks.select(*scope, "__t", "pv", "qv"), [*scope, "__t"], "left")
    status = (
        F.when((F.col("old") == F.col("new")) | (~F.col("pv") & F.col("qv")), "noop")
        .when(~F.col("pv"), "missing_source")
        .when(F.col("qv"), "dest_exists")
        .when(F.col("__crossed"), "cross_schema")
        .otherwise("applied")
    )
    return rows.select(*scope, "old", "new", "ordinal", status.alias("rename_status"))


def left_by(asks: DataFrame, scope: Sequence[str]) -> DataFrame:
    """``(*scope, ref, v, to)``: whether a rename leaves its old and its new name there:
    ``v``, or what ``to`` is; neither where both of what it asks are open and differ."""
    p, q, c = F.col("pv"), F.col("qv"), F.col("__crossed")
    same = F.when(F.col("pr") == F.col("qr"), F.col("pr"))
    none, no = F.lit(None).cast("boolean"), F.lit(False)
    # the old name stays where the new one is taken or the rename crosses schemas
    old_v = F.when(~p, no).when(p, F.when(c, F.lit(True)).otherwise(q)).otherwise(F.when(~c & ~q, no).otherwise(none))
    old_to = F.when(p & ~c, F.col("qr")).when(p.isNull(), F.when(c | q, F.col("pr")).when(q.isNull(), same))
    new_v = F.when(q, F.lit(True)).when(~q, F.when(c, no).otherwise(p)).otherwise(F.when(~c & p, F.lit(True)).otherwise(none))
    new_to = F.when(~q & ~c, F.col("pr")).when(q.isNull(), F.when(c | ~p, F.col("qr")).when(p.isNull(), same))
    ends = F.explode(F.array(F.struct((F.col("__t") * 2).alias("ref"), old_v.alias("v"), old_to.alias("to")), F.struct((F.col("__t") * 2 + 1).alias("ref"), new_v.alias("v"), new_to.alias("to"))))
    return asks.select(*scope, ends.alias("x")).select(*scope, "x.ref", "x.v", F.when(F.col("x.v").isNull(), F.col("x.to")).alias("to"))


def answered(asks: DataFrame, left: DataFrame, scope: Sequence[str], v: str, r: str) -> DataFrame:
    """``asks`` with ``v`` and ``r`` replaced by what ``r`` is known or said to be."""
    ends = left.select(*scope, F.col("ref").alias(r), F.col("v").alias("__v"), F.col("to").alias("__to"))
    met = asks.join(ends, [*scope, r], "left")
    return met.withColumns({v: F.coalesce(v, "__v"), r: F.when(F.col("__v").isNull(), F.coalesce("__to", r))}).select(asks.columns)


def led_on(left: DataFrame, scope: Sequence[str], ref: str, v: str, to: str) -> DataFrame:
    """Pointers ``to`` replaced by what they point at says."""
    ends = left.select(*scope, F.col(ref).alias(to), F.col(v).alias("__v"), F.col(to).alias("__to"))
    met = left.join(ends, [*scope, to], "left")
    return met.withColumns({v: F.coalesce(v, "__v"), to: F.when(F.col("__v").isNull(), F.coalesce("__to", to))}).select(left.columns)


def apply_renames(current: DataFrame, resolved: DataFrame, key: str = "name", scope: Sequence[str] = ("db_id",)) -> DataFrame:
    """``current`` under the names that applied renames give: one pass over the
    original names."""
    to = resolved.where("rename_status = 'applied'").select(*scope, F.col("old").alias(key), "new")
    return current.join(to, [*scope, key], "left").withColumn(key, F.coalesce("new", key)).drop("new")


def propagate_column_renames(dependents: DataFrame, renames: DataFrame, scope: Sequence[str] = ("db_id", "table")) -> DataFrame:
    """``dependents`` with renamed names in ``columns array<string>``, on the same
    table only, one pass over the original names."""
    maps = renames.groupBy(*scope).agg(F.map_from_entries(F.collect_list(F.struct("old", "new"))).alias("__map"))
    joined = dependents.join(maps, list(scope), "left")
    renamed = F.transform("columns", lambda c: F.coalesce(F.try_element_at(F.col("__map"), c), c))
    return joined.withColumn("columns", F.when(F.col("__map").isNull(), F.col("columns")).otherwise(renamed)).drop("__map")


def result_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of two queries that differ, with ``surplus``: how many more times
    ``a`` has the row. Empty if the queries are equivalent on these data."""
    columns = a.columns
    signed = a.withColumn("__n", F.lit(1)).unionByName(b.select(*columns).withColumn("__n", F.lit(-1)))
    return signed.groupBy(*columns).agg(F.sum("__n").alias("surplus")).where("surplus <> 0")


def predicate_difference(df: DataFrame, a: str, b: str) -> DataFrame:
    return df.where(~F.expr(a).eqNullSafe(F.expr(b)))


def merge_runs(actions: DataFrame, by: Sequence[str], order: str, subject: str, mergeable: Column, action: str) -> DataFrame:
    """Consecutive mergeable actions on one subject become one row.

    A run ends where the subject changes and at an action that is not mergeable. Runs
    are told by prefix scans, so a key with many actions is spread; a run is a row.
    """
    marked = actions.withColumn("__ok", F.coalesce(mergeable, F.lit(False)))
    told = scan.before(marked, by, [order], {"__ok_before": F.col("__ok"), "__subject_before": F.col(subject)})
    begins = ~(F.col("__ok") & F.coalesce("__ok_before", F.lit(False)) & F.col(subject).eqNullSafe(F.col("__subject_before")))
    runs = scan.running(told, by, [order], {"__run": ("sum", begins.cast("long"))}, inclusive=True)
    return runs.groupBy(*by, "__run").agg(F.first(subject).alias(subject), F.min(order).alias("first"), F.count("*").alias("merged"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(order, action))), lambda x: x[action]), ", ").alias("actions")).drop("__run")


def is_reordered(current: DataFrame, desired: DataFrame, by: Sequence[str], value: str = "label", ordinal: str = "ordinal") -> DataFrame:
    """``(*by, reordered)``: whether shared values change their relative order."""
    both = current.select(*by, value, F.col(ordinal).alias("__cur")).join(desired.select(*by, value, F.col(ordinal).alias("__des")), [*by, value])
    w = Window.partitionBy(*by).orderBy("__cur")
    return both.withColumn("__down", F.coalesce(F.col("__des") < F.lag("__des").over(w), F.lit(False))).groupBy(*by).agg(F.max("__down").alias("reordered"))


def insert_positions(current: DataFrame, desired: DataFrame, by: Sequence[str], value: str = "label", ordinal: str = "ordinal") -> DataFrame:
    """``(*by, label, placed, neighbour)`` for new values: AFTER the desired value
    before it; a new first value BEFORE the next existing one, else appended."""
    there = current.select(*by, value, F.lit(True).alias("__there"))
    rows = desired.join(there, [*by, value], "left")
    # both neighbours by prefix scans, the next one from behind
    ahead = scan.running(rows, by, [ordinal], {"__before": ("last", F.struct(F.col(value).alias("told"))), "__at": ("sum", F.lit(-1).cast("long"))}, inclusive=False)
    existing = F.when(F.col("__there"), F.col(value))
    marked = scan.running(ahead.withColumn("__at", F.coalesce("__at", F.lit(0).cast("long"))), by, ["__at"], {"__next": ("last", existing)})
    before = F.col("__before.told")
    placed = F.when(before.isNotNull(), "after").when(F.col("__next").isNotNull(), "before").otherwise("append")
    return marked.where("__there IS NULL").select(*by, value, placed.alias("placed"), F.coalesce(before, "__next").alias("neighbour"))


def replaceable_views(current: DataFrame, desired: DataFrame, by: Sequence[str] = ("db_id", "view")) -> DataFrame:
    """``(*by, replaceable)``: the current columns (name and type) are a prefix of
    the desired ones."""
    new = desired.select(*by, "ordinal", F.col("column").alias("__name"), F.col("type").alias("__type"))
    joined = current.join(new, [*by, "ordinal"], "left")
    return joined.groupBy(*by).agg(F.bool_and(F.col("column").eqNullSafe(F.col("__name")) & F.col("type").eqNullSafe(F.col("__type"))).alias("replaceable"))


def change_report(diff: DataFrame, key: Sequence[str], kind: str, allow_drops: bool = False, ignored: DataFrame | None = None) -> DataFrame:
    """``(*key, kind, action, executable)`` of a keyed diff: drops that no policy
    allows are skipped; ignored keys vanish from both sides."""
    rows = diff.where("change <> 'same'")
    if ignored is not None:
        rows = rows.join(ignored.select(*key), list(key), "left_anti")
    drop = F.col("change") == "drop"
    action = F.when(drop & ~F.lit(allow_drops), "skipped").otherwise(F.col("change"))
    return rows.select(*key, F.lit(kind).alias("kind"), action.alias("action"), (~drop | F.lit(allow_drops)).alias("executable"))


#: Fixed order of phases in which changes are carried out.
PHASES = {"drop_reference": 0, "drop_view": 1, "create": 2, "alter": 2, "persist": 3, "drop": 4, "add_reference": 5, "create_view": 6}


def full_report(current: Mapping[str, DataFrame], desired: Mapping[str, DataFrame], keys: Mapping[str, Sequence[str]], allowed: Sequence[str] = (), ignored: Mapping[str, DataFrame] | None = None, scope: str = "db_id") -> DataFrame:
    """``(scope, kind, object, attribute, action, executable, old, new, phase)``
    over all kinds of two snapshots.

    An object is named by its key without the scope, dotted. Created and dropped
    objects are a row, altered ones a row per attribute. Drops of kinds that are
    not ``allowed`` are ``skipped``. Objects whose key is in ``ignored`` are
    reported once as ``ignored``, whatever changed.
    """
    parts = []
    for kind, key in keys.items():
        shared = [c for c in current[kind].columns if c in desired[kind].columns]
        found = keyed_diff(current[kind].select(*shared), desired[kind].select(*shared), key)
        name = F.concat_ws(".", *[c for c in key if c != scope])
        out = None
        if ignored and kind in ignored:
            marks = ignored[kind].select(*key).distinct()
            out = found.join(marks, list(key), "left_semi").select(scope, F.lit(kind).alias("kind"), name.alias("object"), F.lit(None).cast("string").alias("attribute"), F.lit("ignored").alias("action"), F.lit(None).cast("string").alias("old"), F.lit(None).cast("string").alias("new"))
            found = found.join(marks, list(key), "left_anti")
        whole = found.where("change IN ('create', 'drop')").select(scope, F.lit(kind).alias("kind"), name.alias("object"), F.lit(None).cast("string").alias("attribute"), F.when(F.col("change") == "create", "create").otherwise("drop" if kind in allowed else "skipped").alias("action"), F.lit(None).cast("string").alias("old"), F.lit(None).cast("string").alias("new"))
        altered = attribute_diff(found, key).select(scope, F.lit(kind).alias("kind"), name.alias("object"), "attribute", F.lit("alter").alias("action"), "old", "new")
        parts += [p for p in (out, whole, altered) if p is not None]
    rows = reduce(DataFrame.unionByName, parts)
    order = F.create_map(*[F.lit(x) for pair in PHASES.items() for x in pair])
    turn = F.when(F.col("kind") == "view", F.concat("action", F.lit("_view"))).when(F.col("kind") == "reference", F.when(F.col("action") == "drop", "drop_reference").otherwise("add_reference")).otherwise(F.col("action"))
    executable = F.col("action").isin("create", "alter", "drop")
    return rows.withColumn("executable", executable).withColumn("phase", F.when(executable, F.coalesce(order[turn], order[F.col("action")])))


def report_counts(report: DataFrame) -> DataFrame:
    """``(kind, action, n)``: what a report holds, skipped and ignored objects too."""
    return report.groupBy("kind", "action").agg(F.count("*").alias("n"))


def policy_diff(current: DataFrame, desired: DataFrame, key: Sequence[str] = ("table", "name")) -> DataFrame:
    """Policies: a changed command or kind, or a clause taken away, recreates;
    other changes alter. Empty roles equal ``public``."""
    norm = lambda df: df.withColumn("roles", F.when(F.size("roles") == 0, F.array(F.lit("public"))).otherwise(F.array_sort(F.array_distinct("roles"))))
    found = keyed_diff(norm(current), norm(desired), key)
    gone = reduce(lambda a, b: a | b, [F.col(f"old_{c}").isNotNull() & F.col(f"new_{c}").isNull() for c in ("using_expr", "check_expr")])
    recreate = ~F.col("old_command").eqNullSafe(F.col("new_command")) | ~F.col("old_permissive").eqNullSafe(F.col("new_permissive")) | gone
    return found.where("change <> 'same'").select(*key, F.when((F.col("change") == "alter") & recreate, "recreate").otherwise(F.col("change")).alias("action"))


def pivot_counts(objects: DataFrame, by: Sequence[str], kinds: Mapping[str, str] | Sequence[str]) -> DataFrame:
    """Objects by kind, a column per kind, 0 where there is none."""
    return objects.groupBy(*by).pivot("kind", list(kinds)).count().na.fill(0)


def table_steps(changes: DataFrame, by: Sequence[str] = ("db_id", "table")) -> DataFrame:
    """``changes (*by, name, action, generated)`` with ``step``: generated columns
    go before what they are computed from, and other columns are dropped last."""
    drop = F.col("action") == "drop"
    turn = F.when(drop & F.col("generated"), 0).when(~drop, 1).otherwise(2)
    return changes.withColumn("step", F.row_number().over(Window.partitionBy(*by).orderBy(turn, "name")))


def enum_changes(current: DataFrame, desired: DataFrame, uses: DataFrame, by: Sequence[str], value: str = "label") -> DataFrame:
    """``(*by, label, change, uses)``: labels added, and labels removed with the
    rows that use them; a removal is rejected, an addition is not."""
    both = current.select(*by, value, F.lit(True).alias("__old")).join(desired.select(*by, value, F.lit(True).alias("__new")), [*by, value], "full_outer")
    changed = both.where("__old IS NULL OR __new IS NULL").join(uses, [*by, value], "left")
    return changed.select(*by, value, F.when(F.col("__old").isNull(), "added").otherwise("rejected").alias("change"), F.coalesce("uses", F.lit(0)).cast("long").alias("uses"))


def enum_verdicts(current: DataFrame, desired: DataFrame, by: Sequence[str], renames: DataFrame | None = None, value: str = "label", ordinal: str = "ordinal") -> DataFrame:
    """``(*by, verdict)`` for enums on both sides: ``reordered`` and ``removed``
    are rejected, ``added`` and ``same`` are not. ``renames (*by, old, new,
    ordinal)`` are applied to the current labels first, each in its place; where
    one cannot be, the verdict is ``bad_rename``."""
    bad = None
    if renames is not None:
        names = current.select(*by, F.col(value).alias("name"))
        told = resolve_renames(names, desired.select(*by, F.col(value).alias("name")), renames, scope=by)
        bad = told.where("rename_status IN ('missing_source', 'dest_exists')").select(*by).distinct().withColumn("__bad", F.lit(True))
        current = apply_renames(current, told, value, by)
    both = current.select(*by, F.col(value), F.col(ordinal).alias("__cur")).join(desired.select(*by, F.col(value), F.col(ordinal).alias("__des")), [*by, value], "full_outer")
    shared = both.groupBy(*by).agg(F.count("__cur").alias("__had"), F.count("__des").alias("__has"), F.max(F.col("__cur").isNotNull() & F.col("__des").isNull()).alias("__removed"), F.max(F.col("__cur").isNull()).alias("__added")).where("__had > 0 AND __has > 0")
    order = is_reordered(current, desired, by, value, ordinal)
    rows = shared.join(order, list(by), "left")
    rows = rows.join(bad, list(by), "left") if bad is not None else rows.withColumn("__bad", F.lit(None).cast("boolean"))
    verdict = F.when(F.col("__bad"), "bad_rename").when(F.col("__removed"), "removed").when(F.col("reordered"), "reordered").when(F.col("__added"), "added").otherwise("same")
    return rows.select(*by, verdict.alias("verdict"))


def swap_actions(diff: DataFrame, key: Sequence[str], alterable: Column, allow_drops: bool) -> DataFrame:
    """``(*key, action)`` of altered objects: ``alter`` in place where it can be
    done so, else ``recreate``, which needs drops to be allowed, or ``skipped``."""
    return diff.where("change = 'alter'").select(*key, F.when(F.coalesce(alterable, F.lit(False)), "alter").otherwise("recreate" if allow_drops else "skipped").alias("action"))


def default_changes(current: DataFrame, desired: DataFrame, key: Sequence[str], value: str = "default") -> DataFrame:
    """``(*key, action)`` for keys of both sides: ``set``, ``drop``, ``change`` or
    ``same`` default. Casts do not count; none and one differ."""
    both = current.select(*key, F.col(value).alias("__old")).join(desired.select(*key, F.col(value).alias("__new")), list(key))
    old, new = logic.default_value(F.col("__old")), logic.default_value(F.col("__new"))
    action = F.when(old.eqNullSafe(new), "same").when(old.isNull(), "set").when(new.isNull(), "drop").otherwise("change")
    return both.select(*key, action.alias("action"))


def generated_changes(current: DataFrame, desired: DataFrame, key: Sequence[str], value: str = "generated") -> DataFrame:
    """``(*key, verdict)`` for keys of both sides: a column that becomes generated,
    stops being so or gets another expression is ``rejected``, else ``same``."""
    both = current.select(*key, F.col(value).alias("__old")).join(desired.select(*key, F.col(value).alias("__new")), list(key))
    return both.select(*key, F.when(F.col("__old").eqNullSafe(F.col("__new")), "same").otherwise("rejected").alias("verdict"))


def validation_changes(current: DataFrame, desired: DataFrame, key: Sequence[str], definition: str = "definition", validated: str = "validated") -> DataFrame:
    """``(*key, action)`` of constraints: ``validate`` where the definition stays
    and only the check of old rows is asked for; one that loses validation, or
    changes its definition, is ``recreate``; ``create``, ``drop`` and ``same``."""
    sides = [df.select(*key, F.lit(True).alias(f"__{n}"), F.col(definition).alias(f"__{n}_text"), F.col(validated).alias(f"__{n}_valid")) for n, df in (("old", current), ("new", desired))]
    both = sides[0].join(sides[1], list(key), "full")
    same = F.col("__old_text").eqNullSafe(F.col("__new_text"))
    kept = F.col("__old_valid").eqNullSafe(F.col("__new_valid"))
    action = F.when(F.col("__old").isNull(), "create").when(F.col("__new").isNull(), "drop").when(same & kept, "same").when(same & F.col("__new_valid"), "validate").otherwise("recreate")
    return both.select(*key, action.alias("action"))


def view_actions(current: DataFrame, desired: DataFrame, replaceable: DataFrame, by: Sequence[str] = ("db_id", "view"), allow_drops: bool = False) -> DataFrame:
    """``(*by, action)`` of views ``(*by, stored, definition)``: a view that stays
    plain and keeps its columns (``replaceable``) is ``replace``; one that turns
    into a stored view or back, or changes otherwise, is ``recreate``. What drops
    a view is ``skipped`` unless drops are allowed."""
    left = current.select(*by, F.col("stored").alias("__old"), F.col("definition").alias("__text"))
    right = desired.select(*by, F.col("stored").alias("__new"), F.col("definition").alias("__wanted"))
    both = left.join(right, list(by), "full").join(replaceable.select(*by, "replaceable"), list(by), "left")
    drop = lambda name: F.lit(name if allow_drops else "skipped")
    plain = ~F.col("__old") & ~F.col("__new")
    action = F.when(F.col("__old").isNull(), "create").when(F.col("__new").isNull(), drop("drop")).when((F.col("__old") == F.col("__new")) & F.col("__text").eqNullSafe(F.col("__wanted")), "same").when(plain & F.col("replaceable"), "replace").otherwise(drop("recreate"))
    return both.select(*by, action.alias("action"))
