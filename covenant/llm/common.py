"""Helpers that several of the operators share: materialised steps, arrow
batches of bounded size, held-out folds and connected components."""

from __future__ import annotations

import ctypes
import gc
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from covenant.shared import shared_dir

DOCUMENT_COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Rows of one arrow batch; texts may be long, so this is far below Spark's default.
BATCH_ROWS = 1000
#: Bytes of one arrow batch, for rows that hold packed arrays.
BATCH_BYTES = 8 << 20


def materialize(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back.

    It cuts the lineage and survives lost executors; unlike ``checkpoint()`` it
    runs the plan once and is columnar. ``options`` are the writer's.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bounded_batches(spark: SparkSession) -> None:
    """Keep arrow batches of whole texts small, unless the user chose less."""
    for key, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        key = f"spark.sql.execution.arrow.{key}"
        if not 0 < int(spark.conf.get(key).removesuffix("b")) <= most:
            spark.conf.set(key, str(most))


def fold(id_column: Column, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``; a null id counts as empty text."""
    return F.crc32(F.coalesce(id_column.cast("string"), F.lit("")).cast("binary")) % parts


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def grouped(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Tables of equal ``key`` from batches that are sorted by ``key``.

    Holds one group at a time. ``key`` must not be null.
    """
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(batch.schema.get_field_index(key)).to_numpy(zero_copy_only=False)
        cuts = np.flatnonzero(keys[1:] != keys[:-1]) + 1
        bounds = [0, *cuts.tolist(), len(keys)]
        for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
            if held and held[-1].column(batch.schema.get_field_index(key))[-1].as_py() != keys[lo]:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(lo, hi - lo))
    if held:
        yield pa.Table.from_batches(held)


def spanning(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (node, least node of its component) that join what ``a``-``b`` join."""
    nodes, flat = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = flat[: len(a)], flat[len(a) :]
    label = np.arange(len(nodes))
    while True:
        before = label.copy()
        low = np.minimum(label[x], label[y])
        np.minimum.at(label, label[x], low)
        np.minimum.at(label, label[y], low)
        np.minimum.at(label, x, low)
        np.minimum.at(label, y, low)
        label = label[label]
        if np.array_equal(before, label):
            break
    keep = label != np.arange(len(nodes))
    return nodes[keep], nodes[label[keep]]


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of undirected ``edges (a, b)``: ``(node, component)``.

    ``component`` is the least node reachable. Each round takes the least label
    over the neighbours (an aggregation with map-side combine, so hubs do no
    harm), hooks it to the node's former label, and halves the paths; the number
    of rounds is logarithmic in practice. Every round is written to the shared
    folder. Rows with a null end and loops are ignored; no edges give no rows.
    """
    both = edges.select("a", "b").where("a <> b")
    both = materialize(both.unionByName(both.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = materialize(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")), "labels")
    for _ in range(max_rounds):
        seen = both.join(labels.select(F.col("node").alias("b"), F.col("label").alias("theirs")), "b").groupBy(F.col("a").alias("node")).agg(F.min("theirs").alias("theirs"))
        low = labels.join(seen, "node").select("node", "label", F.least("label", "theirs").alias("low"))
        offers = low.select("node", "low").unionByName(low.select(F.col("label").alias("node"), "low"))
        hooked = offers.groupBy("node").agg(F.min("low").alias("label"))
        jumped = hooked.alias("x").join(hooked.select(F.col("node").alias("at"), F.col("label").alias("up")), F.col("label") == F.col("at"), "left")
        after = materialize(jumped.select("node", F.least("label", F.coalesce("up", "label")).alias("label")), "labels")
        changed = after.join(labels.withColumnRenamed("label", "old"), "node").where("label <> old").limit(1).count()
        labels = after
        if not changed:
            return labels.withColumnRenamed("label", "component")
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")


def give_back() -> None:
    """Return to the system what a Python worker has freed. It serves many tasks, and
    its allocators keep the pages of one while others, and the JVM, need them."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


#: What operators keep in a Python worker for their own later tasks.
KEPT: list[dict] = []


def forget() -> None:
    for kept in KEPT:
        kept.clear()


def map_arrow(df: DataFrame, f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str, keeps: bool = False) -> DataFrame:
    """``df.mapInArrow`` with bounded batches; a task leaves no freed memory behind, and
    begins without what others kept in its worker unless it ``keeps`` that itself."""
    bounded_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not keeps:
            forget()
        yield from f(batches)
        give_back()

    return df.mapInArrow(run, schema)
