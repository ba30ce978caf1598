"""Catalogs of many databases for the registered queries, derived from `customer`: a
table for each row, so that they grow with it. No operator uses them; catalogs that
exist come from `covenant.sources.catalog`."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Databases get so many tables each.
TABLES = 50
#: Columns of every table: name and type.
COLUMNS = (("id", "bigint"), ("owner", "int4"), ("name", "varchar(40)"), ("status", "status"), ("amount", "numeric(12, 2)"), ("created", "timestamptz"), ("updated", "timestamp"), ("flags", "int2[]"), ("note", "text"))


def fleet(spark: SparkSession, sf_dir: str, desired: bool = False) -> dict[str, DataFrame]:
    """Catalogs of many databases, one table for each customer.

    The desired side differs by arithmetic on the table number: every 11th table
    is gone, every 7th gets a new column, every 5th a wider key, and each
    database with number 19 k has a cycle of references.
    """
    base = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("n"))
    t = base.select((F.col("n") / TABLES).cast("bigint").alias("db_id"), F.lit("app").alias("schema"), F.concat(F.lit("t"), F.col("n")).alias("name"), "n", F.pmod("n", F.lit(TABLES)).alias("i"))
    if desired:
        t = t.where("n % 11 <> 0")
    listed = F.array(*[F.struct(F.lit(i + 1).alias("ordinal"), F.lit(c).alias("name"), F.lit(k).alias("type_name")) for i, (c, k) in enumerate(COLUMNS)])
    columns = t.select("db_id", "schema", F.col("name").alias("table"), "n", F.explode(listed).alias("c")).select("db_id", "schema", "table", "n", "c.ordinal", "c.name", "c.type_name", (F.col("c.ordinal") <= 2).alias("not_null"))
    if desired:
        wider = columns.withColumn("type_name", F.when((F.col("n") % 5 == 0) & (F.col("name") == "owner"), "bigint").otherwise(F.col("type_name")))
        added = t.where("n % 7 = 0").select("db_id", "schema", F.col("name").alias("table"), "n", F.lit(10).alias("ordinal"), F.lit("extra").alias("name"), F.lit("text").alias("type_name"), F.lit(False).alias("not_null"))
        columns = wider.unionByName(added)
    up = F.when(F.col("i") > 0, F.concat(F.lit("t"), (F.col("n") - F.col("i") + F.floor(F.col("i") / 2)).cast("bigint")))
    cycle = F.when((F.col("db_id") % 19 == 0) & (F.col("i") == 1), F.concat(F.lit("t"), (F.col("n") + 1).cast("bigint"))).otherwise(up)
    references = t.select("db_id", "schema", F.col("name").alias("table"), F.concat(F.lit("fk_"), F.col("name")).alias("name"), F.array(F.when(F.col("n") % 17 == 0, F.lit("gone")).otherwise(F.lit("owner"))).alias("columns"), cycle.alias("ref_table")).where("ref_table IS NOT NULL")
    keys = t.select("db_id", "schema", F.col("name").alias("table"), F.concat(F.col("name"), F.lit("_pkey")).alias("name"), F.lit("p").alias("type"), F.array(F.lit("id")).alias("columns"))
    labels = F.posexplode(F.array(*map(F.lit, ("active", "inactive", "pending") if desired else ("active", "inactive"))))
    enums = t.select("db_id", "schema").distinct().select("db_id", "schema", F.lit("status").alias("name"), labels.alias("ordinal", "label"))
    return {"tables": t, "columns": columns, "references": references, "constraints": keys, "enums": enums}
