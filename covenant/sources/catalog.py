"""Catalogs that exist: folders of Parquet tables and Spark's own catalog.

A folder is a database, what is in it are its tables. `Footers` is a data source
that plans a partition for some files of each table and reads their footers only:
schemas, row counts and statistics, never a row. Both give the same frames, which
the diff, audit and graph operators take:

* ``tables (db_id, schema, name, files, rows, bytes)``
* ``columns (db_id, schema, table, ordinal, name, type_name, not_null)``
* ``references`` and ``keys`` of the contracts declared for the tables.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition
from pyspark.sql.pandas.types import from_arrow_type

from covenant.model import ColumnSpec, TableContract

#: Footers that one task reads.
FILES = 64
#: Table property in Spark's catalog that holds a table's contract as JSON.
CONTRACT_PROPERTY = "covenant.contract"
FOOTER_SCHEMA = "db_id string, schema string, table string, file string, rows long, bytes long, ordinal int, name string, type_name string, not_null boolean, nulls long, low string, high string"
SCOPE = ("db_id", "schema", "table")


@dataclass
class Files(InputPartition):
    """Some files of one table."""

    db_id: str
    schema: str
    table: str
    paths: list[str]


def filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    """What reads ``path``: any store that Arrow knows by its URI, else local files."""
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


def is_data(name: str) -> bool:
    return not name.startswith(("_", "."))


class FooterReader(DataSourceReader):
    def __init__(self, databases: Mapping[str, str], schema: str, files: int, tables: Sequence[str] | None = None):
        self.databases, self.schema, self.files = databases, schema, files
        self.only: dict[str, set[str]] = {} if tables is None else {"table": set(tables)}

    def partitions(self) -> list[Files]:
        out = []
        for db_id, root in sorted(self.databases.items()):
            if db_id in self.only.get("db_id", {db_id}):
                fs, at = filesystem(root)
                for entry in sorted(fs.get_file_info(pafs.FileSelector(at)), key=lambda e: e.base_name):
                    table = entry.base_name.removesuffix(".parquet")
                    if is_data(entry.base_name) and table in self.only.get("table", {table}):
                        out += [Files(db_id, self.schema, table, paths) for paths in self.chunks(fs, entry)]
        return out

    def chunks(self, fs: pafs.FileSystem, entry: pafs.FileInfo) -> Iterator[list[str]]:
        if entry.type == pafs.FileType.File:
            found = [entry.path] if entry.path.endswith(".parquet") else []
        else:
            inside = fs.get_file_info(pafs.FileSelector(entry.path, recursive=True))
            found = sorted(e.path for e in inside if e.type == pafs.FileType.File and e.path.endswith(".parquet") and all(map(is_data, e.path[len(entry.path) :].strip("/").split("/"))))
        yield from (found[i : i + self.files] for i in range(0, len(found), self.files))

    def read(self, part: Files | None) -> Iterator[tuple]:
        if part is None:  # no partition at all was planned
            return
        fs, _ = filesystem(self.databases[part.db_id])
        for path in part.paths:
            with fs.open_input_file(path) as source:
                file = pq.ParquetFile(source)
                for column in columns_of(file):
                    yield (part.db_id, part.schema, part.table, path, file.metadata.num_rows, source.size(), *column)


class PushedReader(FooterReader):
    """Where the session pushes filters to Python data sources."""

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Names of databases and tables leave out partitions before any is read."""
        for f in filters:
            if isinstance(f, EqualTo | In) and len(f.attribute) == 1 and f.attribute[0] in ("db_id", "table"):
                values = {f.value} if isinstance(f, EqualTo) else set(f.value)
                own = self.only.setdefault(f.attribute[0], values)
                self.only[f.attribute[0]] = own & values
            else:
                yield f


def type_of(kind: pa.DataType) -> str:
    try:
        return from_arrow_type(kind, prefer_timestamp_ntz=True).simpleString()
    except Exception:  # a type that Spark does not have
        return str(kind)


def columns_of(file: pq.ParquetFile) -> Iterator[tuple]:
    """``(ordinal, name, type_name, not_null, nulls, low, high)`` of each column.
    Statistics are null for nested columns and where a row group lacks them; least
    and greatest values also for times of 96 bits, which have no order."""
    meta, leaf = file.metadata, {file.schema.column(i).path: i for i in range(len(file.schema))}
    for ordinal, field in enumerate(file.schema_arrow, 1):
        nulls = low = high = None
        kind = type_of(field.type)
        if field.name in leaf:
            if file.schema.column(leaf[field.name]).physical_type == "INT96":
                kind = "timestamp"  # an instant, whatever Arrow makes of it
            parts = [meta.row_group(g).column(leaf[field.name]).statistics for g in range(meta.num_row_groups)]
            if all(p is not None and p.has_null_count for p in parts):
                nulls = sum(p.null_count for p in parts)
            held = [p for p, g in zip(parts, range(meta.num_row_groups), strict=True) if p is None or p.null_count is None or p.null_count < meta.row_group(g).num_rows]
            if held and all(p is not None and p.has_min_max and p.physical_type != "INT96" for p in held):
                low, high = str(min(p.min for p in held)), str(max(p.max for p in held))
        yield ordinal, field.name, kind, not field.nullable, nulls, low, high


class Footers(DataSource):
    """``spark.read.format("parquet_footers")``: options ``databases`` (a JSON object
    of folders by name), ``schema``, ``files`` (footers of a task), ``tables`` (a JSON
    array; all without it) and ``pushed`` (whether the session pushes filters)."""

    @classmethod
    def name(cls) -> str:
        return "parquet_footers"

    def schema(self) -> str:
        return FOOTER_SCHEMA

    def reader(self, schema) -> FooterReader:
        kind = PushedReader if self.options.get("pushed") == "true" else FooterReader
        return kind(json.loads(self.options["databases"]), self.options.get("schema", "public"), int(self.options.get("files", FILES)), json.loads(self.options.get("tables", "null")))


def footers(spark: SparkSession, databases: Mapping[str, str], schema: str = "public", tables: Sequence[str] | None = None, files: int = FILES) -> DataFrame:
    """A row for each column of each file of the folders ``databases``, by name; of
    ``tables`` only, if they are given."""
    spark.dataSource.register(Footers)
    pushed = spark.conf.get("spark.sql.python.filterPushdown.enabled", "false")
    options = {"databases": json.dumps(dict(databases)), "schema": schema, "files": files, "pushed": pushed}
    return spark.read.format(Footers.name()).options(**options, **({} if tables is None else {"tables": json.dumps(list(tables))})).load()


def tables(found: DataFrame) -> DataFrame:
    """``(db_id, schema, name, files, rows, bytes)`` of `footers`."""
    per_file = found.groupBy(*SCOPE, "file").agg(F.first("rows").alias("rows"), F.first("bytes").alias("bytes"))
    sums = per_file.groupBy(*SCOPE).agg(F.count("*").alias("files"), F.sum("rows").alias("rows"), F.sum("bytes").alias("bytes"))
    return sums.withColumnRenamed("table", "name")


def columns(found: DataFrame) -> DataFrame:
    """``(db_id, schema, table, ordinal, name, type_name, not_null)``: each column
    as the table's files have it, the first file's place first. A type that files do
    not agree on is told as all of them, with a slash between (`schema_conflicts`)."""
    types = F.array_join(F.array_sort(F.collect_set("type_name")), "/")
    merged = found.groupBy(*SCOPE, "name").agg(F.min(F.struct("file", "ordinal")).alias("at"), types.alias("type_name"), F.min("not_null").alias("not_null"))
    place = F.row_number().over(Window.partitionBy(*SCOPE).orderBy("at.file", "at.ordinal"))
    return merged.select(*SCOPE, place.alias("ordinal"), "name", "type_name", "not_null")


def statistics(found: DataFrame) -> DataFrame:
    """``(db_id, schema, table, name, rows, nulls)`` from the footers alone; ``nulls`` is
    null where a file does not tell. Rows of files that lack a column are nulls."""
    rows = tables(found).select("db_id", "schema", F.col("name").alias("table"), F.col("rows").alias("all_rows"))
    own = found.groupBy(*SCOPE, "name").agg(F.sum("rows").alias("own_rows"), F.when(F.count("nulls") == F.count("*"), F.sum("nulls")).alias("nulls"))
    return own.join(rows, list(SCOPE)).select(*SCOPE, "name", F.col("all_rows").alias("rows"), (F.col("nulls") + F.col("all_rows") - F.col("own_rows")).alias("nulls"))


def schema_conflicts(found: DataFrame) -> DataFrame:
    """``(db_id, schema, table, name, types, files)``: columns that files of a table
    do not agree on, in type or in having them at all."""
    files = found.groupBy(*SCOPE).agg(F.count_distinct("file").alias("all_files"))
    own = found.groupBy(*SCOPE, "name").agg(F.array_sort(F.collect_set("type_name")).alias("types"), F.count_distinct("file").alias("files"))
    return own.join(files, list(SCOPE)).where("size(types) > 1 OR files < all_files").select(*SCOPE, "name", "types", "files")


def spark_catalog(spark: SparkSession, databases: Sequence[str] | None = None) -> dict[str, DataFrame]:
    """``tables``, ``columns``, ``keys``, ``references`` and ``contracts`` of Spark's own
    catalog, all databases unless some are named. What it holds is metadata that
    the driver's catalog client lists; no table is read. Views are left out."""
    found, listed, contracts = [], [], []
    for db in databases if databases is not None else [d.name for d in spark.catalog.listDatabases()]:
        for t in spark.catalog.listTables(db):
            if t.tableType in ("VIEW", "TEMPORARY"):
                continue
            name = f"`{db}`.`{t.name}`"
            found.append((db, "public", t.name))
            listed += [(db, "public", t.name, i, f.name, f.dataType.simpleString(), not f.nullable) for i, f in enumerate(spark.table(name).schema, 1)]
            held = {r.key: r.value for r in spark.sql(f"SHOW TBLPROPERTIES {name}").collect()}
            if CONTRACT_PROPERTY in held:
                contracts.append((db, "public", t.name, held[CONTRACT_PROPERTY]))
    declared = spark.createDataFrame(contracts, "db_id string, schema string, name string, definition string")
    return {
        "tables": spark.createDataFrame(found, "db_id string, schema string, name string"),
        "columns": spark.createDataFrame(listed, "db_id string, schema string, table string, ordinal int, name string, type_name string, not_null boolean"),
        "contracts": declared,
    } | {kind: declared_rows(declared, kind) for kind in ("keys", "references")}


def declare(spark: SparkSession, table: str, contract: TableContract) -> None:
    """Keep a contract with a table of Spark's catalog."""
    told = contract.to_json().replace("\\", "\\\\").replace("'", "\\'")
    spark.sql(f"ALTER TABLE {table} SET TBLPROPERTIES ('{CONTRACT_PROPERTY}' = '{told}')")


#: A contract as Spark reads its JSON; what a definition lacks is null.
DEFINITION = (
    "name string, columns array<struct<name: string, type: string, not_null: boolean, default: string, generated: string, renamed_from: string>>, "
    "keys array<struct<name: string, columns: array<string>, primary: boolean, where: string>>, "
    "checks array<struct<name: string, expression: string, validated: boolean>>, "
    "references array<struct<name: string, columns: array<string>, parent: string, parent_columns: array<string>, on_delete: string>>"
)


def declared_rows(contracts: DataFrame, kind: str) -> DataFrame:
    """What ``contracts (.., name, definition)`` declare, a row each, in the shape of the
    scanned frames: ``columns``, ``keys``, ``references`` or ``checks``. Other columns of
    ``contracts`` are scope and passed on."""
    scope = [c for c in contracts.columns if c not in ("name", "kind", "definition")]
    read = contracts.select(*scope, F.col("name").alias("table"), F.from_json("definition", DEFINITION).alias("d"))
    rows = read.select(*scope, "table", F.posexplode(f"d.{kind}").alias("at", "x"))
    if kind == "columns":
        return rows.select(*scope, "table", (F.col("at") + 1).alias("ordinal"), "x.name", F.col("x.type").alias("type_name"), F.coalesce("x.not_null", F.lit(False)).alias("not_null"), "x.default", "x.generated", "x.renamed_from")
    if kind == "references":
        return rows.select(*scope, "table", "x.name", "x.columns", F.col("x.parent").alias("ref_table"), F.col("x.parent_columns").alias("ref_columns"), F.coalesce("x.on_delete", F.lit("no action")).alias("on_delete"))
    if kind == "keys":
        return rows.select(*scope, "table", "x.name", F.when(F.col("x.primary"), "p").otherwise("u").alias("type"), "x.columns")
    return rows.select(*scope, "table", "x.name", "x.expression", F.coalesce("x.validated", F.lit(True)).alias("validated"))


def dump(found: DataFrame) -> DataFrame:
    """``(db_id, schema, name, definition)``: scanned columns as contracts in JSON, as
    `load_contracts` takes them; a row a table."""
    parts = F.struct("ordinal", "name", F.col("type_name").alias("type"), "not_null")
    held = columns(found).groupBy(*SCOPE).agg(F.sort_array(F.collect_list(parts)).alias("c"))
    listed = F.transform("c", lambda x: F.struct(x["name"].alias("name"), x["type"].alias("type"), x["not_null"].alias("not_null")))
    return held.select("db_id", "schema", F.col("table").alias("name"), F.to_json(F.struct(F.col("table").alias("name"), listed.alias("columns"))).alias("definition"))


def contract_of(name: str, df: DataFrame) -> TableContract:
    """The contract that a DataFrame's schema meets."""
    return TableContract(name, tuple(ColumnSpec(f.name, f.dataType.simpleString(), not f.nullable) for f in df.schema))
