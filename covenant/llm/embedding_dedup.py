"""Near-duplicate embeddings through a pivot-permutation index.

A vector is described by its nearest pivots (reference vectors), in their order:
the start of its permutation. Near vectors share most of it. Inverted lists hold,
for each set of ``shared`` pivots of which the nearest is among the first ``lead``
of the order, the vectors that have them so. Two vectors meet in a list just if
their count of shared pivots is high enough, with one of them in front; a pair is
verified only in the first of the lists they share. Verifying is a product of the
list's vectors in double precision. Lists above a size are cut in blocks, and
pairs of blocks are tasks of their own. There are more pivots for more vectors, so
that lists grow slower than the table.

Equal vectors are one node with a number of copies. A task returns, for each
node, the number of its links, and a spanning forest of the links, so pairs are
never listed.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from covenant.llm.common import components, grouped, map_arrow, materialize, spanning

#: Pivots at least and at most, and for each the vectors they are chosen from; in
#: between they are as many as the root of the number of vectors.
PIVOTS, MOST_PIVOTS, SAMPLE = 256, 2048, 8
#: Vectors of a list that meet in one task.
BLOCK = 2048


def usable(vector: Column) -> Column:
    """Not null, not zero, no component null, NaN or infinite."""
    sound = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return vector.isNotNull() & F.coalesce(sound, F.lit(False)) & F.exists(vector, lambda x: x != 0)


def unit(rows: np.ndarray) -> np.ndarray:
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))


def choose_pivots(vectors: np.ndarray, count: int) -> np.ndarray:
    """``count`` of the unit vectors, each the farthest from those before it."""
    if not len(vectors):
        return vectors
    chosen, near = [0], vectors @ vectors[0]
    while len(chosen) < min(count, len(vectors)):
        at = int(near.argmin())
        if near[at] > 1 - 1e-9:
            break
        chosen.append(at)
        near = np.maximum(near, vectors @ vectors[at])
    return vectors[chosen]


def describe(nodes: DataFrame, pivots: np.ndarray, nearest: int, shared: int, lead: int, kind: str) -> DataFrame:
    """``(node, copies, vector binary, lists array<long>)``: the keys of the lists
    a vector is in, sorted; ``kind`` is the type of the packed components."""
    nearest = min(nearest, len(pivots))
    shared = min(shared, nearest)
    base = len(pivots) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets = np.array([c for c in combinations(range(nearest), shared) if not c or c[0] < lead], np.int64).reshape(-1, shared)
        for batch in batches:
            if not batch.num_rows:
                continue
            raw = batch.column("embedding").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            order = np.argsort(-(unit(raw.astype(np.float64)) @ pivots.T), axis=1, kind="stable")[:, :nearest]
            chosen = np.sort(order[:, sets], axis=2)
            keys = np.zeros(chosen.shape[:2], np.int64)
            for c in range(shared):
                keys = keys * base + chosen[:, :, c] + 1
            keys.sort(axis=1)
            ends = pa.array(np.arange(0, keys.size + 1, keys.shape[1]), pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column("node"), batch.column("copies"), pa.array([x.tobytes() for x in raw.astype(kind)], pa.binary()), pa.ListArray.from_arrays(ends, pa.array(keys.ravel()))], ["node", "copies", "vector", "lists"])

    return map_arrow(nodes.select("node", "copies", "embedding"), run, "node long, copies long, vector binary, lists array<long>")


def verify(lists: DataFrame, kind: str, least: float) -> DataFrame:
    """``(a, b, n)``: for each vector of a list its new links (b null), and edges
    (n 0) of a spanning forest of these links."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nodes, edges, held = {}, [], 0

        def flush() -> pa.RecordBatch:
            a, n = np.fromiter(nodes.keys(), np.int64, len(nodes)), np.fromiter(nodes.values(), np.int64, len(nodes))
            x, y = spanning(np.concatenate([e[0] for e in edges]), np.concatenate([e[1] for e in edges])) if edges else (np.zeros(0, np.int64),) * 2
            ends = pa.concat_arrays([pa.nulls(len(a), pa.int64()), pa.array(y)])
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate([a, x])), ends, pa.array(np.concatenate([n, np.zeros(len(x), np.int64)]))], ["a", "b", "n"])

        for group in grouped(batches, "cell"):
            if group.num_rows < 2:
                continue
            node, copies, side = (group.column(c).to_numpy() for c in ("node", "copies", "side"))
            rows = unit(np.frombuffer(b"".join(group.column("vector").to_pylist()), kind).reshape(len(node), -1).astype(np.float64))
            keys = np.array(group.column("lists").to_pylist(), np.int64).reshape(len(node), -1)
            key = group.column("list")[0].as_py()
            split = side.max() > 0
            left, right = (np.flatnonzero(side == 0), np.flatnonzero(side == 1)) if split else (np.arange(len(node)),) * 2
            for at in range(0, len(left), 256):
                part = left[at : at + 256]
                i, j = np.nonzero(rows[part] @ rows[right].T >= least)
                i, j = part[i], right[j]
                if not split:
                    i, j = i[i < j], j[i < j]
                if not len(i):
                    continue
                for lo in range(0, len(i), 65536):  # the first list that both are in
                    x, y = keys[i[lo : lo + 65536]], keys[j[lo : lo + 65536]]
                    both = (x[:, :, None] == y[:, None, :]).any(axis=2)
                    first = x[np.arange(len(x)), both.argmax(axis=1)] == key
                    i[lo : lo + 65536][~first] = -1
                i, j = i[i >= 0], j[i >= 0]
                if not len(i):
                    continue
                more = np.bincount(i, copies[j], len(node)) + np.bincount(j, copies[i], len(node))
                for k in np.flatnonzero(more).tolist():
                    nodes[node[k]] = nodes.get(node[k], 0) + int(more[k])
                x, y = spanning(node[i], node[j])
                edges.append((x, y))
                held += len(x)
            if held > 200_000 or len(nodes) > 200_000:
                yield flush()
                nodes, edges, held = {}, [], 0
        if nodes:
            yield flush()

    return map_arrow(lists.select("cell", "list", "side", "node", "copies", "lists", "vector"), run, "a long, b long, n long")


def links(same: DataFrame, number: int, kind: str, least: float, pivots: int | None, nearest: int, shared: int, lead: int) -> DataFrame:
    """`verify` for the ``number`` nodes ``(node, copies, embedding)`` of one length."""
    pivots = pivots or max(PIVOTS, min(MOST_PIVOTS, int(number**0.5)))
    sample = same.select("embedding").orderBy(F.xxhash64("embedding"), "embedding").limit(SAMPLE * pivots).collect()  # SAMPLE * MOST_PIVOTS rows at most
    chosen = choose_pivots(unit(np.array([r[0] for r in sample], np.float64)), pivots)
    described = materialize(describe(same, chosen, nearest, shared, lead, kind), "vector-orders")
    listed = described.select("node", "copies", "lists", "vector", F.explode("lists").alias("list"))
    long = described.select(F.explode("lists").alias("list")).groupBy("list").count().where(F.col("count") > BLOCK).select("list", F.ceil(F.col("count") / BLOCK).cast("int").alias("blocks"))
    cut = listed.join(long, "list", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1))).withColumn("block", F.pmod(F.xxhash64("node"), "blocks").cast("int"))
    cells = cut.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("low", F.least("block", "other")).withColumn("high", F.greatest("block", "other"))
    dealt = cells.withColumn("cell", F.xxhash64("list", "low", "high")).withColumn("side", F.when(F.col("low") == F.col("high"), 0).otherwise((F.col("block") == F.col("high")).cast("int")))
    dealt = dealt.repartition("list", "low", "high").sortWithinPartitions("cell", "list", "low", "high")
    return materialize(verify(dealt, kind, least), "vector-links")


def near_duplicates(df: DataFrame, vector: str = "embedding", key: str = "vec_id", least: float = 0.9, pivots: int | None = None, nearest: int = 6, shared: int = 2, lead: int = 2) -> DataFrame:
    """``(key, n_links, component_id, kept)`` for each row.

    Vectors that are null or zero, or hold null or non-finite components, link
    with nothing; others link with vectors of their own length, and each length
    has an index of its own. Repeated rows, equal vectors and rows that repeat a
    key with another vector are linked as vectors of their own. Pivots come from
    `SAMPLE` vectors a pivot, of the length, chosen by a hash; every vector is
    indexed. Rows with a null key are counted as links and join others, but are
    no one's component, which is null where all keys are. Components other than
    floats are taken as doubles. An empty table gives an empty one; other columns
    are ignored.
    """
    single = dict(df.dtypes)[vector] == "array<float>"
    kind, packed = ("array<float>", "float32") if single else ("array<double>", "float64")
    rows = df.select(F.col(key).cast("long").alias("key"), F.col(vector).cast(kind).alias("embedding")).withColumn("usable", usable(F.col("embedding")))
    nodes = rows.where("usable").groupBy("embedding").agg(F.min("key").alias("least"), F.count("*").alias("copies"))
    nodes = materialize(nodes.withColumn("node", F.monotonically_increasing_id()), "vectors")
    sizes = nodes.groupBy(F.size("embedding").alias("size")).count().where("count > 1").orderBy("size").collect()  # a row per length
    found = None
    for r in sizes:
        part = links(nodes.where(F.size("embedding") == r["size"]), r["count"], packed, least, pivots, nearest, shared, lead)
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = df.sparkSession.createDataFrame([], "a long, b long, n long")
    counts = found.where("b IS NULL").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("more"))
    joined = nodes.join(components(found.where("b IS NOT NULL").select("a", "b")), "node", "left").withColumn("component", F.coalesce("component", "node"))
    named = joined.groupBy("component").agg(F.min("least").alias("component_id"))
    known = joined.join(named, "component").join(counts, "node", "left").select("embedding", (F.col("copies") - 1 + F.coalesce("more", F.lit(0))).alias("n_links"), "component_id")
    linked = rows.where("usable").join(known, "embedding").select("key", "n_links", "component_id")
    alone = rows.where("NOT usable").select("key", F.lit(0).cast("long").alias("n_links"), F.col("key").alias("component_id"))
    return linked.unionByName(alone).select(F.col("key").alias(key), "n_links", "component_id", F.col("key").eqNullSafe(F.col("component_id")).alias("kept"))
