"""Views over tables and views, and stored ones with their refresh."""

from __future__ import annotations

import uuid
from collections.abc import Collection, Mapping

from pyspark.sql import DataFrame, SparkSession

from covenant.functions import lineage
from covenant.operators.diff import result_difference
from covenant.shared import shared_dir


def view_order(views: Mapping[str, str], uses: Mapping[str, Collection[str]] | None = None) -> list[str]:
    """Names with those they use first, ties by name; a cycle is an error.
    ``uses`` names what each view reads; of a view that it lacks, Spark's parser
    tells (`lineage.view_uses`)."""
    read = lineage.view_uses(SparkSession.active(), {v: q for v, q in views.items() if not (uses and v in uses)} | {v: "SELECT 1" for v in uses or () if v in views})
    needs = {v: {w for w in views if w != v and w in (uses[v] if uses and v in uses else read[v])} for v in views}
    out: list[str] = []
    while needs:
        ready = sorted(v for v, n in needs.items() if not n - set(out))
        if not ready:
            raise ValueError(f"views depend on each other: {', '.join(sorted(needs))}")
        out += ready
        needs = {v: n for v, n in needs.items() if v not in ready}
    return out


def run_views(spark: SparkSession, tables: Mapping[str, DataFrame], views: Mapping[str, str], wanted: str, uses: Mapping[str, Collection[str]] | None = None) -> DataFrame:
    """The result of a view. Tables and the views before it become common table
    expressions, so that Spark resolves the names and texts stay as they are."""
    tag = uuid.uuid4().hex[:8]
    held = {n: f"{n}_{tag}" for n in tables}
    for n, df in tables.items():
        df.createOrReplaceTempView(held[n])
    parts = [f"`{n}` AS (SELECT * FROM `{t}`)" for n, t in held.items()] + [f"`{n}` AS ({views[n]})" for n in view_order(views, uses)]
    try:
        return spark.sql(f"WITH {', '.join(parts)} SELECT * FROM `{wanted}`")
    finally:
        for t in held.values():
            spark.catalog.dropTempView(t)


class MaterializedView:
    """A stored query result. A refresh writes a new table and then switches to
    it, so readers see the old or the new one whole."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.name, self.path, self.schema = spark, name, None, None

    def read(self) -> DataFrame:
        if self.path is None:
            raise ValueError(f"{self.name} has not been built")
        return self.spark.read.schema(self.schema).parquet(self.path)

    def refresh(self, query: DataFrame) -> None:
        path = f"{shared_dir(self.spark)}/view-{self.name}-{uuid.uuid4().hex}"
        query.write.parquet(path)
        self.path, self.schema = path, query.schema

    def delta(self, query: DataFrame) -> DataFrame:
        """What a refresh would change: rows with ``surplus`` over the stored ones."""
        return result_difference(query, self.read())
