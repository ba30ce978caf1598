"""Difference of two large snapshots by hash trees: only what differs is read.

A snapshot is stored by leaf, a range of its keys' hashes of about `LEAF_ROWS` rows,
with the sums of its rows' hashes by leaf and by node of the tree above. Sums do not
depend on the order of rows and count repeated ones. Two trees of one shape are
compared from the top, a level at a time, under the nodes that differ only; at
last the rows of the leaves that differ meet in an ordinary difference.
"""

from __future__ import annotations

import json
import math
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from covenant.operators import diff
from covenant.shared import stored_with

#: Rows of a leaf, about: few, so that a changed row brings few others along.
LEAF_ROWS = 16
#: Bits of a level; the top level has at most as many nodes as two of them make.
LEVEL_BITS = 4
#: Nodes or leaves that are sent to all tasks (8 bytes each); more are joined by a shuffle.
SENT_LEAVES = 1 << 20
SUMS = ("n", "a_low", "a_high", "b_low", "b_high")


@dataclass(frozen=True)
class Tree:
    """A stored snapshot: ``path`` with its rows and nodes, keys, bits of a leaf, and
    the schema of its rows."""

    spark: SparkSession
    path: str
    key: tuple[str, ...]
    bits: int
    schema: str

    def rows(self) -> DataFrame:
        return self.spark.read.schema(StructType.fromJson(json.loads(self.schema))).parquet(f"{self.path}/rows")

    def nodes(self, level: int) -> DataFrame:
        kinds = "node long, " + ", ".join(f"{c} long" for c in SUMS) + ", level int"
        return self.spark.read.schema(kinds).parquet(f"{self.path}/nodes").where(F.col("level") == level).select("node", *SUMS)

    @property
    def levels(self) -> list[int]:
        """Bits of the nodes of each level, from the top."""
        return list(range(min(self.bits, 2 * LEVEL_BITS), self.bits + 1, LEVEL_BITS))


def digest(columns: Sequence[str], seed: int) -> Column:
    """A hash that tells nulls apart by their place, which `xxhash64` alone does not."""
    return F.xxhash64(F.lit(seed), *(x for c in columns for x in (F.col(c), F.col(c).isNull())))


def write_tree(df: DataFrame, key: Sequence[str], path: str, like: Tree | None = None) -> Tree:
    """Store ``df`` as a snapshot, in the shape of ``like`` if there is one. Columns
    must be of types that Spark hashes (no maps). Rows may repeat; a null in the
    key is a value."""
    spark, key = df.sparkSession, tuple(key)
    if like is not None and like.key != key:
        raise ValueError("snapshots have different keys")
    bits = like.bits if like is not None else max(0, math.ceil(math.log2(max(df.count() / LEAF_ROWS, 1)) / LEVEL_BITS)) * LEVEL_BITS
    leaf = F.pmod(digest(key, 0), F.lit(1 << bits))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = df.withColumn("__leaf", leaf)
    placed.repartitionByRange(parts, "__leaf").sortWithinPartitions("__leaf").write.parquet(f"{path}/rows")
    tree = Tree(spark, path, key, bits, placed.schema.json())
    told = tree.rows()
    hashes = {x: digest(df.columns, s) for x, s in (("a", 1), ("b", 2))}
    halves = {f"{x}_low": h.bitwiseAND(0xFFFFFFFF) for x, h in hashes.items()} | {f"{x}_high": F.shiftright(h, 32) for x, h in hashes.items()}
    leaves = told.select(F.col("__leaf").alias("node"), F.lit(1).alias("n"), *(c.alias(n) for n, c in halves.items())).groupBy("node").agg(*(F.sum(c).alias(c) for c in SUMS))
    leaves.withColumn("level", F.lit(bits)).write.partitionBy("level").parquet(f"{path}/nodes")
    for level in reversed(tree.levels[:-1]):
        above = tree.nodes(level + LEVEL_BITS).groupBy(F.shiftright("node", LEVEL_BITS).alias("node")).agg(*(F.sum(c).alias(c) for c in SUMS))
        above.withColumn("level", F.lit(level)).write.mode("append").partitionBy("level").parquet(f"{path}/nodes")
    spark.range(1).select(F.lit(bits).alias("bits"), F.lit(list(key)).alias("key"), F.lit(tree.schema).alias("schema")).write.json(f"{path}/shape")
    return tree


def open_tree(spark: SparkSession, path: str) -> Tree:
    shape = spark.read.schema("bits int, key array<string>, schema string").json(f"{path}/shape").first()
    return Tree(spark, path, tuple(shape.key), shape.bits, shape.schema)


def differing_rows(old: Tree, new: Tree) -> tuple[DataFrame, DataFrame]:
    """The rows of both snapshots in leaves that differ."""
    if (old.key, old.bits) != (new.key, new.bits):
        raise ValueError("snapshots have different shapes: write one like the other")
    within: DataFrame | None = None
    for level in old.levels:
        x, y = old.nodes(level), new.nodes(level)
        if within is not None:
            above = within.withColumnRenamed("node", "above")
            above = F.broadcast(above) if 1 << (level - LEVEL_BITS) <= SENT_LEAVES else above  # there are no more nodes
            x, y = (df.join(above, F.shiftright("node", LEVEL_BITS) == F.col("above"), "left_semi") for df in (x, y))
        both = x.join(y.select("node", *(F.col(c).alias(f"new_{c}") for c in SUMS)), "node", "full_outer")
        same = reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"new_{c}")) for c in SUMS])
        within = both.where(~same).select("node")
    leaves, told = stored_with(within.withColumnRenamed("node", "__leaf"), "merkle-leaves", n=F.count("*"))
    sent = F.broadcast(leaves) if told["n"] <= SENT_LEAVES else leaves
    pick = lambda tree: tree.rows().join(sent, "__leaf", "left_semi").drop("__leaf")
    return pick(old), pick(new)


def tree_diff(old: Tree, new: Tree) -> DataFrame:
    """`diff.keyed_diff` without the rows that are the same."""
    x, y = differing_rows(old, new)
    return diff.keyed_diff(x, y.select(x.columns), list(old.key)).where("change <> 'same'")


def tree_surplus(old: Tree, new: Tree) -> DataFrame:
    """Rows with their ``surplus`` in ``new`` over ``old``, as multisets."""
    x, y = differing_rows(old, new)
    return diff.result_difference(y, x)
