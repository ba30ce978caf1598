"""Snapshots: catalogs of many databases as tables, their filters and sinks."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from covenant.functions.logic import name_matches, visible
from covenant.operators.audit import violations
from covenant.model import Rule, TableContract


def read_snapshot(spark: SparkSession, path: str, kind: str) -> DataFrame:
    return spark.read.parquet(f"{path}/{kind}")


def write_snapshot(snapshot: Mapping[str, DataFrame], path: str) -> None:
    """One table per kind, in ranges of databases. A folder for each database would be
    as many files; here a file holds many, sorted, so that a filter on ``db_id`` skips
    files and row groups by their footers. A large database is spread over files."""
    for kind, df in snapshot.items():
        spread = F.xxhash64(*(F.col(f"`{c}`") for c, t in df.dtypes if "map<" not in t and "variant" not in t))
        df.repartitionByRange("db_id", spread).sortWithinPartitions("db_id").write.mode("overwrite").parquet(f"{path}/{kind}")


CONTRACT_SCHEMA = "name string, kind string, definition string"


def load_contracts(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """Objects of JSON files; a repeated definition is an error."""
    objects = spark.read.schema(CONTRACT_SCHEMA).json(list(paths))
    double = [r.name for r in objects.groupBy("kind", "name").count().where("count > 1").orderBy("name").limit(21).collect()]
    if double:
        raise ValueError(f"defined more than once: {', '.join(double[:20])}{' and others' * (len(double) > 20)}")
    return objects


def table_contracts(objects: DataFrame, names: Sequence[str]) -> dict[str, TableContract]:
    """The contracts of the named tables out of `load_contracts`; a name that no
    file declares is an error. All of them as rows: `catalog.declared_rows`."""
    held = {r.name: TableContract.from_json(r.definition) for r in objects.where((F.col("kind") == "table") & F.col("name").isin(list(names))).collect()}
    if missing := sorted(set(names) - set(held)):
        raise ValueError(f"not declared: {', '.join(missing)}")
    return held


def filter_names(df: DataFrame, include: Sequence[str] = (), exclude: Sequence[str] = (), name: str = "name") -> DataFrame:
    return df.where(name_matches(F.col(name), include, exclude))


def filter_kinds(df: DataFrame, enable: Sequence[str] = (), disable: Sequence[str] = ()) -> DataFrame:
    """An enable list wins over a disable list; neither keeps all."""
    return df.where(F.col("kind").isin(list(enable))) if enable else df.where(~F.col("kind").isin(list(disable)))


def filter_schemas(df: DataFrame, schemas: Sequence[str], mapped: Mapping[str, str] | None = None) -> DataFrame:
    """Schemas asked for and where they are mapped to; sequences are filtered too."""
    return df.where(F.col("schema").isin([*schemas, *(mapped or {}).values()])) if schemas else df


def remap_schemas(df: DataFrame, mapped: Mapping[str, str], columns: Sequence[str] = ("schema",), reverse: bool = False) -> DataFrame:
    if len(set(mapped.values())) < len(mapped):
        raise ValueError("two schemas are mapped to one")
    pairs = {v: k for k, v in mapped.items()} if reverse else mapped
    known = F.create_map(*[F.lit(x) for p in pairs.items() for x in p])
    return df.withColumns({c: F.coalesce(known[F.col(c)], F.col(c)) for c in columns})


def remap_text(df: DataFrame, mapped: Mapping[str, str], columns: Sequence[str], reverse: bool = False) -> DataFrame:
    """Schema names before a dot, in text such as view definitions and targets of
    references, outside of string literals. All names are replaced at once, so
    that a -> b and b -> c do not run into each other."""
    if len(set(mapped.values())) < len(mapped):
        raise ValueError("two schemas are mapped to one")
    pairs = [(v, k) if reverse else (k, v) for k, v in mapped.items()]
    outside = r"(?=(?:[^']*'[^']*')*[^']*$)"

    def replaced(text: Column) -> Column:
        for n, (old, _) in enumerate(pairs):
            text = F.regexp_replace(text, rf"(?<![\w.\"\x00]){re.escape(old)}\.(?=[\w\"]){outside}|(?<!\.)\"{re.escape(old)}\"\.{outside}", f"\x00{n}\x00.")
        for n, (_, new) in enumerate(pairs):
            text = F.replace(text, F.lit(f"\x00{n}\x00."), F.lit(f"{new}."))
        return text

    return df.withColumns({c: replaced(F.col(c)) for c in columns})


def ignored_report(current: DataFrame, desired: DataFrame, ignored: DataFrame, key: Sequence[str]) -> DataFrame:
    """``(*key, in_current, in_desired)`` of the ignored objects that either side
    has, sorted."""
    held = current.select(*key, F.lit(True).alias("c"), F.lit(False).alias("d")).unionByName(desired.select(*key, F.lit(False).alias("c"), F.lit(True).alias("d")))
    hit = held.join(ignored.select(*key).distinct(), list(key), "left_semi")
    return hit.groupBy(*key).agg(F.max("c").alias("in_current"), F.max("d").alias("in_desired")).orderBy(*key)


def managed_only(objects: DataFrame, constraints: DataFrame, owned: DataFrame, extensions: DataFrame, scope: Sequence[str] = ("db_id", "schema")) -> DataFrame:
    """``objects (*scope, name, kind)`` that are managed by themselves: without
    indexes that back a primary key, unique or exclusion constraint (``type`` p, u
    or x) of their name, sequences that a column owns, and whatever belongs to an
    extension (``extensions (*scope, name, kind)``)."""
    by = [*scope, "name"]
    backing = constraints.where(F.col("type").isin("p", "u", "x")).select(*by, F.lit("index").alias("kind"))
    out = backing.unionByName(owned.select(*by, F.lit("sequence").alias("kind"))).unionByName(extensions.select(*by, "kind"))
    return objects.join(out, [*by, "kind"], "left_anti")


def ignore(df: DataFrame, ignored: DataFrame, key: Sequence[str]) -> DataFrame:
    return df.join(ignored.select(*key).distinct(), list(key), "left_anti")


def project_child(child: DataFrame, parent: DataFrame) -> DataFrame:
    """A partition's or heir's rows in the parent's columns."""
    return child.select(*[F.col(c) if c in child.columns else F.lit(None).cast(k).alias(c) for c, k in parent.dtypes])


def read_parent(parent: DataFrame, children: Sequence[DataFrame]) -> DataFrame:
    out = parent
    for c in children:
        out = out.unionByName(project_child(c, parent))
    return out


def ordered_columns(rows: DataFrame, by: Sequence[str], position: str, name: str) -> DataFrame:
    """Names in order as one array."""
    return rows.groupBy(*by).agg(F.transform(F.sort_array(F.collect_list(F.struct(position, name))), lambda x: x[name]).alias("columns"))


def role_sets(rows: DataFrame, by: Sequence[str], role: str = "role", role_id: str | None = None) -> DataFrame:
    """Distinct sorted roles; none means ``public``, and so does id 0 in the
    column ``role_id``, beside the named ones."""
    if role_id is not None:
        rows = rows.withColumn(role, F.when(F.col(role_id) == 0, F.lit("public")).otherwise(F.col(role)))
    found = rows.groupBy(*by).agg(F.array_sort(F.collect_set(role)).alias("roles"))
    return found.withColumn("roles", F.when(F.size("roles") == 0, F.array(F.lit("public"))).otherwise(F.col("roles")))


#: Fixed: the namespaces in which an object of a kind takes its name.
NAMESPACES = {
    "table": ("relation", "type"), "view": ("relation", "type"), "materialized view": ("relation", "type"),
    "sequence": ("relation",), "index": ("relation",), "composite type": ("relation", "type"), "domain": ("type",), "enum": ("type",),
    "primary key": ("relation", "constraint"), "unique": ("relation", "constraint"), "exclusion": ("relation", "constraint"),
    "check": ("constraint",), "foreign key": ("constraint",), "attribute": ("attribute",), "enum value": ("enum value",),
}


def namespace_clashes(objects: DataFrame, scope: Sequence[str] = ("db_id", "schema")) -> DataFrame:
    """``(*scope, namespace, owner, name, kinds, n, reason)`` of names claimed
    twice. ``objects (*scope, owner, name, kind)``: ``owner`` is the table, domain
    or type that a constraint, attribute or label belongs to. Relations and types
    are of the schema, the others of their owner. ``reason``: ``duplicate`` for
    objects of one kind, else ``clash``. Kinds that are not known take no name."""
    spaces = F.create_map(*[x for kind, names in NAMESPACES.items() for x in (F.lit(kind), F.array(*map(F.lit, names)))])
    claims = objects.select(*scope, "owner", "name", "kind", F.explode(spaces[F.col("kind")]).alias("namespace")).withColumn("owner", F.when(~F.col("namespace").isin("relation", "type"), F.col("owner")))
    found = claims.groupBy(*scope, "namespace", "owner", "name").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_set("kind")), ",").alias("kinds"), F.count_distinct("kind").alias("__kinds"))
    return found.where("n > 1").select(*scope, "namespace", "owner", "name", "kinds", "n", F.when(F.col("__kinds") == 1, "duplicate").otherwise("clash").alias("reason"))


def name_collisions(objects: DataFrame, scope: Sequence[str] = ("db_id", "schema")) -> DataFrame:
    """``(*scope, name, kinds, n)``: names that several objects of a namespace share."""
    found = objects.groupBy(*scope, "name").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_set("kind")), ",").alias("kinds"))
    return found.where("n > 1").select(*scope, "name", "kinds", "n")


def catalog_order(objects: DataFrame) -> DataFrame:
    """Position in a database: schema, then kind of constraint p, u, c, x, f, then name."""
    rank = F.array_position(F.array(*map(F.lit, "pucxf")), F.col("type"))
    w = Window.partitionBy("db_id").orderBy("schema", "table", rank, "name")
    return objects.withColumn("position", F.row_number().over(w))


def gate(df: DataFrame, rules: Sequence[Rule]) -> tuple[DataFrame, DataFrame]:
    """Rows that meet the rules, and the others with their reasons."""
    marked = df.withColumn("_violations", violations(rules))
    bad = F.size("_violations") > 0
    return marked.where(~bad).drop("_violations"), marked.where(visible(bad))


def write_gate(df: DataFrame, rules: Sequence[Rule], target: str, quarantine: str, mode: str = "append", hidden: Sequence[str] = ()) -> None:
    """Rules are applied once: both writes read one marked table. ``hidden``
    columns serve rules only and are not written."""
    marked = df.withColumn("_violations", violations(rules)).persist()
    try:
        marked.where(F.size("_violations") == 0).drop("_violations", *hidden).write.mode(mode).parquet(target)
        marked.where(F.size("_violations") > 0).drop(*hidden).write.mode(mode).parquet(quarantine)
    finally:
        marked.unpersist()
