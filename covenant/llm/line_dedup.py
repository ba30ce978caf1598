"""Removal of lines that many documents share, by a sharded minimal perfect hash.

Distinct line keys are hashed (two 64-bit hashes), counted, and dealt to shards.
Each shard's hashes get a minimal perfect hash: levels of bits, where a hash
takes the bit it alone maps to and otherwise goes on to the next level; the rank
of its bit is its place. That place indexes compact arrays: a 32-bit fingerprint,
the number of documents, and the document that keeps the line. Documents send
their line hashes (not lines) past the arrays of the shard concerned, and take
back the hashes to drop.

A shard whose lines occur very often is copied for several tasks, and its probes
are dealt among the copies, so a line that a third of the documents hold is
spread as well.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from covenant.llm.common import grouped, map_arrow, materialize, shuffle_partitions

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
STRIPPED = r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+\z"
#: Distinct lines in a shard, which fixes how much a task holds (about 5 MB).
SHARD_LINES = 200_000
#: Repeated ids up to so many are sent to every executor, beyond that joined.
REPEATED = 100_000
#: Bits of a level for each hash that comes to it.
GAMMA = 2.0
INDEX = "shard long, copies long, seed long, sizes array<long>, bits binary, prints binary, counts binary, keepers binary"


def mixed(a: np.ndarray, b: np.ndarray | int) -> np.ndarray:
    """A 64-bit hash of two 64-bit values."""
    with np.errstate(over="ignore"):
        z = a ^ (np.uint64(b) if isinstance(b, int) else b) * np.uint64(0x9E3779B97F4A7C15)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))


def joint(h1: np.ndarray, h2: np.ndarray, seed: int) -> np.ndarray:
    return mixed(h1, mixed(h2, seed + 1))


class PerfectHash:
    """A minimal perfect hash of distinct 64-bit keys."""

    def __init__(self, sizes: list[int], bits: np.ndarray):
        self.sizes, self.bits = sizes, bits
        self.rank = np.concatenate([[0], np.cumsum(bits, dtype=np.int64)])

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        sizes, levels = [], []
        while len(keys):
            size = max(2, int(GAMMA * len(keys)))
            at = (mixed(keys, len(sizes) + 1) % np.uint64(size)).astype(np.int64)
            alone = np.bincount(at, minlength=size) == 1
            sizes.append(size)
            levels.append(alone)
            keys = keys[~alone[at]]
        return cls(sizes, np.concatenate(levels) if levels else np.zeros(0, bool))

    def index(self, keys: np.ndarray) -> np.ndarray:
        """Places of ``keys``; for one that was not built in, any place or -1."""
        out = np.full(len(keys), -1, np.int64)
        left, base = np.arange(len(keys)), 0
        for level, size in enumerate(self.sizes):
            at = base + (mixed(keys[left], level + 1) % np.uint64(size)).astype(np.int64)
            hit = self.bits[at]
            out[left[hit]] = self.rank[at[hit]]
            left, base = left[~hit], base + size
            if not len(left):
                break
        return out


def line_key(line: Column) -> Column:
    """ASCII white space off both ends, A-Z in lower case."""
    return F.translate(F.regexp_replace(line, STRIPPED, ""), UPPER, LOWER)


def hash_pair(key: Column) -> Column:
    return F.struct(F.xxhash64(key).alias("h1"), F.xxhash64(F.lit(1), key).alias("h2"))


def probes(df: DataFrame, text: str, doc: str, min_chars: int) -> DataFrame:
    """``(doc, h1, h2)``: the distinct hashes of each row's eligible lines."""
    keys = F.array_distinct(F.filter(F.transform(F.split(F.coalesce(df[text], F.lit("")), "\n", -1), line_key), lambda k: F.char_length(k) >= min_chars))
    return df.select(df[doc].alias("doc"), F.explode(F.transform(keys, hash_pair)).alias("h")).select("doc", "h.h1", "h.h2")


def build_index(counts: DataFrame, shards: int) -> DataFrame:
    """One row of arrays for each shard; ``counts (shard, copies, h1, h2, n, keeper)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in grouped(batches, "shard"):
            h1, h2 = (group.column(c).to_numpy().view(np.uint64) for c in ("h1", "h2"))
            seed = 0
            while len(np.unique(keys := joint(h1, h2, seed))) < len(keys):
                seed += 1
            found = PerfectHash.build(keys)
            place = found.index(keys)
            order = np.empty(len(keys), np.int64)
            order[place] = np.arange(len(keys))
            prints = (h2[order] >> np.uint64(32)).astype(np.uint32)
            count = np.minimum(group.column("n").to_numpy()[order], 2**32 - 1).astype(np.uint32)
            keeper = group.column("keeper").to_numpy(zero_copy_only=False)[order]
            packed = [np.packbits(found.bits).tobytes(), prints.tobytes(), count.tobytes(), keeper.astype(np.int64).tobytes()]
            row = [group.column("shard")[0].as_py(), group.column("copies")[0].as_py(), seed, found.sizes, *packed]
            yield pa.RecordBatch.from_arrays([*(pa.array([x], pa.int64()) for x in row[:3]), pa.array([row[3]], pa.list_(pa.int64())), *(pa.array([x], pa.binary()) for x in row[4:])], ["shard", "copies", "seed", "sizes", "bits", "prints", "counts", "keepers"])

    dealt = counts.repartition("shard").sortWithinPartitions("shard").select("shard", "copies", "h1", "h2", "n", "keeper")
    return map_arrow(dealt, run, INDEX)


def probe(index: DataFrame, rows: DataFrame, min_docs: int) -> DataFrame:
    """``(doc, h1)`` of the hashes that a document loses.

    Arrays and probes meet by (shard, copy); within a task the arrays of a shard
    come first, and the probes stream past them. A shard's arrays are multiplied
    row by row, never in one batch.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple = ()
        arrays = None
        for batch in batches:
            shard, copy = batch.column("shard").to_numpy(), batch.column("copy").to_numpy()
            if not len(shard):
                continue
            cuts = np.flatnonzero((shard[1:] != shard[:-1]) | (copy[1:] != copy[:-1])) + 1
            for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), len(shard)], strict=True):
                part = batch.slice(lo, hi - lo)
                if held != (shard[lo], copy[lo]):
                    row = {c: part.column(c)[0].as_py() for c in ("seed", "sizes", "bits", "prints", "counts", "keepers")}
                    bits = np.unpackbits(np.frombuffer(row["bits"], np.uint8), count=sum(row["sizes"])).astype(bool)
                    arrays = (row["seed"], PerfectHash(row["sizes"], bits), np.frombuffer(row["prints"], np.uint32), np.frombuffer(row["counts"], np.uint32), np.frombuffer(row["keepers"], np.int64))
                    held = (shard[lo], copy[lo])
                    part = part.slice(1)
                if not part.num_rows:
                    continue
                seed, found, prints, counts, keepers = arrays
                h1, h2 = (part.column(c).to_numpy().view(np.uint64) for c in ("h1", "h2"))
                place = found.index(joint(h1, h2, seed))
                known = (place >= 0) & (prints[place] == (h2 >> np.uint64(32)).astype(np.uint32))
                docs = part.column("doc")
                number = np.asarray(docs.fill_null(0))
                loses = known & (counts[place] >= min_docs) & ((number != keepers[place]) | np.asarray(docs.is_null()))
                if loses.any():
                    yield pa.RecordBatch.from_arrays([docs.filter(pa.array(loses)), pa.array(h1[loses].view(np.int64))], ["doc", "h1"])

    none = [F.lit(None).cast(kind).alias(c) for c, kind in (("seed", "long"), ("sizes", "array<long>"), ("bits", "binary"), ("prints", "binary"), ("counts", "binary"), ("keepers", "binary"))]
    arrays = index.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1))).select("shard", "copy", F.lit(0).alias("turn"), F.lit(None).cast("long").alias("doc"), F.lit(0).cast("long").alias("h1"), F.lit(0).cast("long").alias("h2"), "seed", "sizes", "bits", "prints", "counts", "keepers")
    asked = rows.select("shard", "copy", F.lit(1).alias("turn"), "doc", "h1", "h2", *none)
    dealt = arrays.unionByName(asked).repartition("shard", "copy").sortWithinPartitions("shard", "copy", "turn")
    return map_arrow(dealt, run, "doc long, h1 long")


def repeated(df: DataFrame, text: str = "text", doc: str = "doc_id", min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """``(doc, h1)``: line hashes that each document loses."""
    spark = df.sparkSession
    found = probes(df, text, doc, min_chars)
    again = materialize(df.groupBy(df[doc].alias("doc")).count().where("count > 1 AND doc IS NOT NULL").select("doc"), "line-repeated-ids")
    few = again.limit(REPEATED + 1).count()
    once = found
    if few:  # rows of one id are one document
        ids = F.broadcast(again) if few <= REPEATED else again
        once = found.join(ids, "doc", "left_anti").unionByName(found.join(ids, "doc", "left_semi").distinct())
    counts = materialize(once.groupBy("h1", "h2").agg(F.count("doc").alias("n"), F.max("doc").alias("keeper")), "line-counts")
    total = counts.count()
    number = max(shuffle_partitions(spark), -(-total // SHARD_LINES))
    shards = F.pmod(F.xxhash64("h2", "h1"), F.lit(number))
    # rows by shard: as many as there are shards, so a broadcast of them is small
    load = counts.groupBy(shards.alias("shard")).agg(F.sum("n").alias("rows"))
    mean = F.lit(max(1000.0, counts.agg(F.sum("n")).first()[0] / number if total else 0))
    load = materialize(load.select("shard", F.ceil(F.col("rows") / (2 * mean)).alias("copies")), "line-shards")
    small = F.broadcast(load) if number <= 1_000_000 else load
    # a line whose keeper is null is kept by no document with an id
    index = build_index(counts.withColumn("shard", shards).withColumn("keeper", F.coalesce("keeper", F.lit(-(2**63)))).join(small, "shard"), number)
    asked = found.withColumn("shard", shards).join(small, "shard").withColumn("copy", F.pmod(F.xxhash64("doc"), "copies"))
    return probe(index, asked, min_docs)


def deduplicate(df: DataFrame, text: str = "text", doc: str = "doc_id", min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """``df`` with ``n_lines long``, ``n_dropped long`` and ``kept string``.

    A text is split at newlines (null or empty: one empty line). A line's key is
    the line without ASCII white space at both ends, A-Z in lower case. Keys of
    ``min_chars`` code points or more that ``min_docs`` documents or more hold are
    dropped, except from the rows of the greatest ``doc`` holding it; a line
    repeated within a document counts once but is kept or dropped throughout.
    Rows of one id count as one document but keep their own texts, and those of
    the greatest id all keep the line. Rows with a null id count as no document
    and lose such lines. Columns of ``df`` by other names are passed on; an empty
    table gives an empty one.
    """
    found = repeated(df, text, doc, min_chars, min_docs)
    lost = found.where("doc IS NOT NULL").groupBy(F.col("doc").alias("__doc")).agg(F.collect_set("h1").alias("__lost"))
    if df.where(df[doc].isNull()).head(1):  # rows without an id meet what they lose by their text
        bare = probes(df.where(df[doc].isNull()).withColumn("__text", F.xxhash64(text)), text, "__text", min_chars).join(found.where("doc IS NULL").select("h1").distinct(), "h1", "left_semi")
        lost = lost.withColumn("__hash", F.lit(0).cast("long")).unionByName(bare.groupBy(F.lit(None).cast(dict(df.dtypes)[doc]).alias("__doc"), F.col("doc").alias("__hash")).agg(F.collect_set("h1").alias("__lost")))
        joined = df.join(lost, F.col("__doc").eqNullSafe(df[doc]) & (F.col("__hash") == F.when(df[doc].isNull(), F.xxhash64(df[text])).otherwise(F.lit(0))), "left")
    else:
        joined = df.join(lost, F.col("__doc") == df[doc], "left")
    lines = F.split(F.coalesce(df[text], F.lit("")), "\n", -1)
    stays = F.filter(lines, lambda x: ~((F.char_length(line_key(x)) >= min_chars) & F.array_contains(F.col("__lost"), F.xxhash64(line_key(x)))))
    kept = F.when(F.col("__lost").isNull(), lines).otherwise(stays)
    return joined.select(*(df[c] for c in df.columns), F.size(lines).cast("long").alias("n_lines"), (F.size(lines) - F.size(kept)).cast("long").alias("n_dropped"), F.array_join(kept, "\n").alias("kept"))
