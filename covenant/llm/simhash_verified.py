"""Near-duplicates by SimHash with a given Jaccard similarity, verified.

One fingerprint and a few bits find nearly only equal sets of shingles, so here a
text has ``tables`` fingerprints of 32 bits, independent of each other. Each is the
key of a binary trie, and the trie self-join drops pairs of nodes once their paths
differ in more than ``BUDGET`` bits. What two texts differ by in one table is 0.15
of the bits at a similarity of 0.8 (a cosine of 0.889); a table finds such a pair
with probability 0.12, twenty tables with 0.92, and pairs of 0.85 with 0.99.
Candidates must also be near in the next two tables' bits (21 of 64: four standard
deviations above what 0.8 gives). What is left is verified on the whole sets of
shingles, so no pair below ``similarity`` is linked.

1. Texts of equal sets of shingles are one node, so copies are never paired.
2. Each trie is dealt out three times, with another third of its bits on top: of
   two differing bits at least one third has none. Tasks get whole subtrees.
3. First only a spanning forest of each subtree's candidates is verified, which
   joins most of a large group of near copies by a few pairs a text. Then all
   candidates that this has not joined are verified. So a group of mutual near
   copies does not become all its pairs, and no candidate between texts that are
   not joined otherwise is lost.

The walk itself meets the pairs of a subtree's near fingerprints (24 bytes a node
are held), as in `simhash`; they are neither kept nor shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from covenant.llm.common import components, map_arrow, materialize, spanning
from covenant.llm.simhash import FRONT, LOWER

BITS, THIRDS, BUDGET = 32, 3, 2
#: Bits of the third that a subtree shares (the last third has one more).
TOP = BITS // THIRDS
#: Most differing bits of the 64 of the next two tables.
NEAR = 21
#: Pairs of nodes with so few pairs of values below are compared value by value.
SMALL = 16
TABLES, SHINGLE, SIMILARITY, SEED = 20, 5, 0.8, 42


def shingles(text: str | None, width: int, seed: int) -> np.ndarray:
    """Sorted distinct hashes of a text's shingles; fewer words: one shingle."""
    words = (text or "").encode("utf-8").translate(LOWER).split()
    if not words:
        return np.empty(0, np.uint64)
    row = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    k = min(width, len(words))
    starts = np.concatenate([[0], ends[:-1]])[: len(words) - k + 1]
    h = xxhash.xxh64_intdigest
    return np.unique(np.array([h(row[a:b], seed) for a, b in zip(starts.tolist(), (ends[k - 1 :] - 1).tolist(), strict=True)], np.uint64))


def sketch(hashes: np.ndarray, tables: int) -> np.ndarray:
    """``tables`` fingerprints of 32 bits. A bit that half of the shingles have is
    that of the least shingle."""
    if not len(hashes):
        return np.zeros(tables, np.uint32)
    lanes = np.arange(1, (tables + 1) // 2 + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    total, first = np.zeros(64 * len(lanes), np.int64), None
    for lo in range(0, len(hashes), 4096):
        x = hashes[lo : lo + 4096, None] + lanes
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        bits = np.unpackbits((x ^ (x >> np.uint64(31))).view(np.uint8), axis=1)
        first = bits[0].astype(np.int64) if first is None else first
        total += bits.sum(axis=0, dtype=np.uint16)
    return np.packbits(4 * total + 2 * first - 1 > 2 * len(hashes)).view(np.uint32)[:tables]


def candidates(value: np.ndarray, check: np.ndarray, label: np.ndarray, top: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions of pairs of sorted ``value`` (32 bits below a tag) that agree in
    all but the ``BITS - top`` last bits, differ in at most ``BUDGET`` bits, are near
    by ``check``, and have different ``label``."""
    head = value >> np.uint64(BITS - top)
    lo = np.flatnonzero(np.concatenate([[True], head[1:] != head[:-1]])).astype(np.int64)
    hi = np.concatenate([lo[1:], [len(value)]]).astype(np.int64)
    big = hi - lo > 1
    lo, hi = lo[big], hi[big]
    stack = [(BITS - top - 1, lo, hi, lo, hi, np.zeros(len(lo), np.int8))]
    ones: dict[int, np.ndarray] = {}
    while stack:
        bit, lo1, hi1, lo2, hi2, diff = stack.pop()
        if len(lo1) > FRONT:
            stack += [(bit, *(v[at : at + FRONT] for v in (lo1, hi1, lo2, hi2, diff))) for at in range(0, len(lo1), FRONT)]
            continue
        size = (hi1 - lo1) * (hi2 - lo2)
        leaf = (size <= SMALL) | (bit < 0)
        if leaf.any():
            a0, wide, b0, many = lo1[leaf], (hi2 - lo2)[leaf], lo2[leaf], size[leaf]
            ends = np.cumsum(many)
            for at in range(0, int(ends[-1]) if len(ends) else 0, FRONT):  # a node of equal values may have many pairs
                flat = np.arange(at, min(at + FRONT, int(ends[-1])))
                of = np.searchsorted(ends, flat, "right")
                own = flat - (ends[of] - many[of])
                a, b = a0[of] + own // wide[of], b0[of] + own % wide[of]
                good = (a0[of] != b0[of]) | (a < b)
                a, b = a[good], b[good]
                good = (label[a] != label[b]) & (np.bitwise_count(value[a] ^ value[b]) <= BUDGET)
                a, b = a[good], b[good]
                good = np.bitwise_count(check[a] ^ check[b]) <= NEAR
                if good.any():
                    yield a[good], b[good]
            lo1, hi1, lo2, hi2, diff = (v[~leaf] for v in (lo1, hi1, lo2, hi2, diff))
        if not len(lo1):
            continue
        if bit not in ones:
            ones[bit] = np.concatenate([[0], np.cumsum((value >> np.uint64(bit)) & np.uint64(1), dtype=np.int64)])
        count = ones[bit]
        mid1, mid2 = hi1 - (count[hi1] - count[lo1]), hi2 - (count[hi2] - count[lo2])
        same, nxt = lo1 == lo2, []
        for side, (a_lo, a_hi, b_lo, b_hi, more) in enumerate(((lo1, mid1, lo2, mid2, 0), (mid1, hi1, mid2, hi2, 0), (lo1, mid1, mid2, hi2, 1), (mid1, hi1, lo2, mid2, 1))):
            keep = (a_hi > a_lo) & (b_hi > b_lo) & (diff + more <= BUDGET)
            keep &= ~same if side == 3 else ~((a_lo == b_lo) & (a_hi - a_lo == 1))  # mirrors; a leaf with itself
            nxt.append((a_lo[keep], a_hi[keep], b_lo[keep], b_hi[keep], diff[keep] + np.int8(more)))
        stack.append((bit - 1, *(np.concatenate(v) for v in zip(*nxt, strict=True))))


def trie_join(nodes: DataFrame, tables: int, forest: bool) -> DataFrame:
    """Distinct candidates ``(a, b)``, ``a < b``, of ``nodes (node, label, prints)``
    with different labels; with ``forest`` a spanning forest of each subtree's."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = np.frombuffer(b"".join(batch.column("prints").to_pylist()), np.uint32).reshape(batch.num_rows, tables).astype(np.uint64)
            for k in range(tables):
                check = prints[:, (k + 1) % tables] << np.uint64(BITS) | prints[:, (k + 2) % tables]
                for third in range(THIRDS):
                    turn = np.uint64(third * TOP)
                    turned = (prints[:, k] << turn | prints[:, k] >> (np.uint64(BITS) - turn)) & np.uint64((1 << BITS) - 1)
                    value = np.uint64((k * THIRDS + third) << BITS) | turned
                    columns = [pa.array(v.view(np.int64)) for v in (value >> np.uint64(BITS - TOP), value, check)]
                    yield pa.RecordBatch.from_arrays([*columns, batch.column("label"), batch.column("node")], ["block", "value", "check", "label", "node"])

    def walk(block: np.ndarray, value: np.ndarray, check: np.ndarray, label: np.ndarray, node: np.ndarray) -> Iterator[pa.RecordBatch]:
        order = np.argsort(value, kind="stable")
        value, check, label, node = value[order].view(np.uint64), check[order].view(np.uint64), label[order], node[order]
        found: list[tuple[np.ndarray, np.ndarray]] = []
        held = 0

        def out() -> Iterator[pa.RecordBatch]:
            a, b = (np.concatenate(v) for v in zip(*found, strict=True))
            a, b = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)]), axis=1)
            for at in range(0, len(a), 65536):
                yield pa.RecordBatch.from_arrays([pa.array(v[at : at + 65536]) for v in (a, b)], ["a", "b"])

        for i, j in candidates(value, check, label, TOP):
            found.append((node[i], node[j]))
            held += len(i)
            if held > 4 * FRONT:
                if forest:
                    found = [spanning(*(np.concatenate(v) for v in zip(*found, strict=True)))]
                    held = len(found[0][0])
                else:
                    yield from out()
                    found, held = [], 0
        if found:
            if forest:
                found = [spanning(*(np.concatenate(v) for v in zip(*found, strict=True)))]
            yield from out()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # blocks come one after the other: whole ones are walked, the last is held
        held: list[list[np.ndarray]] = []
        size = 0
        for batch in batches:
            held.append([c.to_numpy() for c in batch.columns])
            size += batch.num_rows
            if size > FRONT:
                columns = [np.concatenate(x) for x in zip(*held, strict=True)]
                cut = np.flatnonzero(columns[0][1:] != columns[0][:-1])
                cut = int(cut[-1]) + 1 if len(cut) else 0
                if cut:
                    yield from walk(*(x[:cut] for x in columns))
                held, size = [[x[cut:] for x in columns]], len(columns[0]) - cut
        if size:
            yield from walk(*(np.concatenate(x) for x in zip(*held, strict=True)))

    dealt = map_arrow(nodes.select("node", "label", "prints"), deal, "block long, value long, check long, label long, node long")
    sorted_blocks = dealt.repartition("block").sortWithinPartitions("block")
    return map_arrow(sorted_blocks, run, "a long, b long").distinct()


def verified(pairs: DataFrame, texts: DataFrame, shingle: int, similarity: float, seed: int) -> DataFrame:
    """Those of ``pairs (a, b)`` whose ``texts (node, text)`` are similar enough."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [shingles(x, shingle, seed).view(np.int64) for x in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(got, pa.list_(pa.int64()))], ["node", "hashes"])

    asked = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    known = materialize(map_arrow(texts.join(asked, "node", "left_semi").select("node", "text"), sets, "node long, hashes array<long>"), "near-sets")
    # the greater end first: a hub is mostly a least end, and its rows are split by their size then
    both = pairs.join(known.select(F.col("node").alias("b"), F.col("hashes").alias("theirs")), "b").join(known.select(F.col("node").alias("a"), "hashes"), "a")
    shared = F.size(F.array_intersect("hashes", "theirs"))
    return both.where(shared / (F.size("hashes") + F.size("theirs") - shared) >= similarity).select("a", "b")


def one_of_each(df: DataFrame, text: str = "text", key: str = "doc_id", shingle: int = SHINGLE, similarity: float = SIMILARITY, tables: int = TABLES, seed: int = SEED) -> DataFrame:
    """``df`` without near-duplicates: of each group of rows joined by links of
    ``similarity`` or more one stays, that of the least key.

    Links are Jaccard similarities of sets of shingles of ``shingle`` words (ASCII
    white space, A-Z in lower case, whole texts); a text of fewer words is one
    shingle. Texts without a word (null, empty, blank) are alike and link with no
    other. Rows without a key stay and count as texts that others link by. Of rows
    that repeat a key one of each group stays: least by the text's first 16
    characters, then by a hash of the row, so equal rows are interchangeable. Other
    columns are kept under any name but those beginning with ``__near``. An empty
    table gives an empty one. Twenty tables find 0.92 of the pairs at exactly 0.8
    and more above; ``tables`` (3 at least) raises that.
    """
    if tables < 3:
        raise ValueError("two further tables check a table's candidates")

    def printed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingles(x, shingle, seed) for x in batch.column("text").to_pylist()]
            names = [xxhash.xxh128_hexdigest(s.tobytes()) for s in sets]
            prints = [sketch(s, tables).tobytes() for s in sets]
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(names), pa.array(prints, pa.binary()), pa.array([len(s) for s in sets], pa.int64())], ["row", "name", "prints", "size"])

    rows = materialize(df.withColumn("__near", F.monotonically_increasing_id()), "near-rows")
    texts = rows.select(F.col("__near").alias("row"), F.col(text).alias("text"))
    seen = materialize(map_arrow(texts, printed, "row long, name string, prints binary, size long"), "near-prints")
    nodes = materialize(seen.groupBy("name").agg(F.min("row").alias("node"), F.first("prints").alias("prints"), F.first("size").alias("size")), "near-nodes")
    worded, texts = nodes.where("size > 0"), texts.withColumnRenamed("row", "node")

    hubs = materialize(trie_join(worded.withColumn("label", F.col("node")), tables, forest=True), "near-pairs")
    links = materialize(verified(hubs, texts, shingle, similarity, seed), "near-links")
    label = components(links)
    joined = worded.join(label, "node", "left").withColumn("label", F.coalesce("component", "node"))
    rest = materialize(trie_join(joined, tables, forest=False).join(hubs, ["a", "b"], "left_anti"), "near-pairs")
    links = links.unionByName(materialize(verified(rest, texts, shingle, similarity, seed), "near-links"))

    group = nodes.join(components(links), "node", "left").select("name", F.coalesce("component", "node").alias("group"))
    rank = F.struct(F.col(key).alias("key"), F.left(F.col(text), F.lit(16)).alias("head"), F.xxhash64(*(F.col(f"`{c}`") for c in df.columns)).alias("hash"), F.col("__near").alias("row"))
    keyed = rows.where(F.col(key).isNotNull()).select(F.col("__near").alias("row"), rank.alias("rank"))
    best = keyed.join(seen.select("row", "name"), "row").groupBy("name").agg(F.min("rank").alias("rank"))
    stays = best.join(group, "name").groupBy("group").agg(F.min("rank").alias("rank")).select(F.col("rank.row").alias("row"))
    goes = materialize(keyed.select("row").join(stays, "row", "left_anti"), "near-gone")
    return rows.join(goes, rows["__near"] == goes["row"], "left_anti").drop("__near")
