"""The contract's write gate on streams."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from covenant.model import Rule
from covenant.operators.audit import violations
from covenant.operators.keyindex import KeyIndex
from covenant.shared import shared_dir
from covenant.sources.snapshot import write_gate


def file_stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A stream of one table's files; many small batches are not forced."""
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)


def gate_stream(stream: DataFrame, rules: Sequence[Rule], parent: DataFrame | None = None, column: str | None = None, parent_column: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Run the gate over what a stream has now; returns the tables of rows that
    passed and of rows put aside. With ``parent``, a row whose reference is
    missing there is put aside too (rule ``reference``). Each batch has a folder
    of its own that it overwrites, so a batch that runs again is not doubled. A
    stream without rows gives empty tables."""
    spark = stream.sparkSession
    place = f"{shared_dir(spark)}/gate-{uuid.uuid4().hex}"

    def batch(df: DataFrame, number: int) -> None:
        kept, aside = f"{place}/passed/batch={number}", f"{place}/aside/batch={number}"
        if parent is not None:
            keys = parent.select(F.col(parent_column).alias("__key")).distinct().withColumn("__there", F.lit(True))
            df = df.join(keys, df[column] == F.col("__key"), "left").drop("__key")
            write_gate(df, [*rules, Rule("reference", f"`{column}` IS NULL OR __there IS NOT NULL")], kept, aside, "overwrite", hidden=("__there",))
        else:
            write_gate(df, rules, kept, aside, "overwrite")

    batch(spark.createDataFrame([], stream.schema), -1)
    query = stream.writeStream.foreachBatch(batch).option("checkpointLocation", f"{place}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    kept = spark.read.schema(stream.schema).parquet(f"{place}/passed").select(stream.columns)
    aside = spark.createDataFrame([], stream.schema).withColumn("_violations", violations([Rule("r", "true")]))
    return kept, spark.read.schema(aside.schema).parquet(f"{place}/aside").select(aside.columns)


def unique_stream(stream: DataFrame, keys: Sequence[str], time: str, horizon: str) -> DataFrame:
    """The first row of each key within a horizon of event time."""
    spark = stream.sparkSession
    place = f"{shared_dir(spark)}/unique-{uuid.uuid4().hex}"
    timed = stream.withColumn("__time", F.col(time).cast("timestamp")).withWatermark("__time", horizon).dropDuplicatesWithinWatermark(list(keys)).drop("__time")
    timed.writeStream.format("parquet").option("path", f"{place}/rows").option("checkpointLocation", f"{place}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{place}/rows")


def parent_stream(child: DataFrame, key: Sequence[str], parent: DataFrame, column: str, parent_column: str, child_time: str, parent_time: str, before: str, wait: str, place: str, delay: str = "0 seconds") -> None:
    """Rows of ``child`` whose parent comes in a stream of its own go to ``place/passed``,
    those that wait in vain to ``place/aside`` with the reason ``reference``.

    A parent counts from ``before`` the child's time to ``wait`` after it. A child passes
    when its parent is there, however late that came in; it is put aside once both
    streams' times, less ``delay``, are past its wait; until then it is held. A null
    reference passes, at the end of its wait. Children are told apart by ``key``, so
    parents that come more than once let a child pass once. Runs what is there and ends; run again with the same ``place``,
    it goes on from its checkpoint. Each batch overwrites a folder of its own, so a
    batch that runs again is not doubled.
    """
    timed = lambda df, c: df.withColumn("__time", F.col(c).cast("timestamp")).withWatermark("__time", delay)
    keys = timed(parent, parent_time).select(F.col(parent_column).alias("__key"), F.col("__time").alias("__parent_time"))
    near = F.expr(f"__key = `{column}` AND __parent_time >= __time - INTERVAL {before} AND __parent_time <= __time + INTERVAL {wait}")
    joined = timed(child, child_time).join(keys, near, "left_outer").select(*child.columns, "__time", F.col("__key").isNotNull().alias("__there"))
    joined = joined.dropDuplicatesWithinWatermark(list(key)).drop("__time")

    def batch(df: DataFrame, number: int) -> None:
        write_gate(df, [Rule("reference", f"`{column}` IS NULL OR __there")], f"{place}/passed/batch={number}", f"{place}/aside/batch={number}", "overwrite", hidden=("__there",))

    joined.writeStream.outputMode("append").foreachBatch(batch).option("checkpointLocation", f"{place}/state").trigger(availableNow=True).start().awaitTermination()


def unique_gate(stream: DataFrame, keys: Sequence[str], order: Sequence[str], place: str, buckets: int = 64) -> None:
    """The first row of each key goes to ``place/passed``, ever after all others go to
    ``place/aside`` with ``reason``: ``known`` from an earlier batch, or ``repeated`` in its own,
    where rows are taken by ``order``. A key with a null is never a repeat.

    Keys that have come are kept in an index (`KeyIndex`) under ``place``, so there is no
    horizon and no state grows in memory. The index has a manifest for each batch: a
    batch that runs again asks what was known before it, and adds nothing twice.
    """
    spark = stream.sparkSession
    index = KeyIndex(spark, f"{place}/index", [(k, dict(stream.dtypes)[k]) for k in keys], buckets)

    def batch(df: DataFrame, number: int) -> None:
        there = F.expr(" AND ".join(f"`{k}` IS NOT NULL" for k in keys))
        df = df.persist()
        try:
            known = index.known(df, number).withColumn("__known", F.lit(True))
            marked = df.join(known, list(keys), "left").withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
            reason = F.when(there & F.col("__known"), "known").when(there & (F.col("__n") > 1), "repeated")
            told = marked.withColumn("reason", reason).select(*stream.columns, "reason")
            told.where("reason IS NULL").drop("reason").write.mode("overwrite").parquet(f"{place}/passed/batch={number}")
            told.where("reason IS NOT NULL").write.mode("overwrite").parquet(f"{place}/aside/batch={number}")
            if index.runs()[0] <= number:
                index.add(df)
        finally:
            df.unpersist()

    stream.writeStream.foreachBatch(batch).option("checkpointLocation", f"{place}/state").trigger(availableNow=True).start().awaitTermination()


def written(spark: SparkSession, place: str, schema: str) -> DataFrame:
    """Rows of all batches that a gate wrote to ``place``; none if it wrote nothing."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(place)
    if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        return spark.createDataFrame([], schema)
    return spark.read.schema(f"{schema}, batch int").parquet(place).drop("batch")
