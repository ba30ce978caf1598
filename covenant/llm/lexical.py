"""Exact ranked lexical search of many items by a dual-tree search.

An item is a vector of its terms' counts times their weights, a document one of its
terms' saturated frequencies; a score is their product, a whole number. Items and
documents are put in trees whose nodes hold, for each term, the maximum over what is
below them. The product of two nodes' maxima bounds the score of every pair below
them, so a pair of nodes is dropped when it is below the weakest k-th best score of
the items under the one: a whole batch of items leaves a whole batch of documents.
What is left is expanded level by level; the leaves that are left are scored exactly.

Documents are tokenised once, into a stored index of blocks, in which only terms
that some item may have are kept: items' terms set the bits of a table of fixed
size, and a term whose bit is not set has no item. A task streams the index blocks
of a shard past the items, builds each block's tree when it comes, and keeps the best k
documents of each item, so what it holds does not grow with the documents. Document
counts, the number of documents and their length are those of all documents, so
shards' best k merge exactly. Terms are told apart by 64-bit hashes.

All numbers are whole; they are multiplied as doubles while every sum is below 2^53,
which is exact, and as 64-bit integers otherwise.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from covenant.llm.common import grouped, map_arrow, materialize, shuffle_partitions



@dataclass(frozen=True)
class Sizes:
    """How the work is cut; results do not depend on it."""

    #: Documents of an index block, and their distinct terms over all of them, at
    #: most, unless one document has more; documents of a leaf.
    block_docs: int = 2048
    block_terms: int = 1 << 18
    leaf_docs: int = 32
    #: Items that are packed and searched side by side, and their terms, at most (one
    #: item may have more); items of a leaf; children of a node.
    pack_items: int = 256
    pack_terms: int = 1 << 15
    leaf_items: int = 8
    fan: int = 4
    #: Items that a task holds; documents of a shard where there are many.
    held_items: int = 32_768
    shard_docs: int = 1 << 18
    #: Bits of the table of terms that items have.
    asked: int = 1 << 22
    #: Found documents that are merged into the best at once.
    merge: int = 1 << 14
    #: Sums below this are taken as doubles.
    exact: int = 1 << 53


#: Words a worker remembers.
CACHE_WORDS = 500_000
#: Fixed: factors of the score, and the share of the length's weight.
WEIGHT, FREQUENCY, SATURATION, LENGTH = 1000, 1_000_000_000, 12, 25
#: A term's bytes as they are, A-Z in lower case; all that parts terms as spaces.
TERM_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
INDEX = "block long, docs long, tokens long, ids array<long>, lengths binary, each binary, terms binary, counts binary"


class Asked(dict):
    """Hash by term; None for terms that no item has."""

    def __init__(self, bits: np.ndarray | None):
        super().__init__()
        self.bits = bits

    def __missing__(self, term: bytes) -> int | None:
        h = xxhash.xxh64_intdigest(term)
        got = self[term] = h if self.bits is None or self.bits[(h >> 6) % len(self.bits)] >> np.uint64(h & 63) & np.uint64(1) else None
        return got

    def of(self, text: bytes | None) -> tuple[int, list[int], list[int]]:
        """The number of terms, and the hashes and counts of those asked for."""
        if len(self) > CACHE_WORDS:
            self.clear()
        terms = (text or b"").translate(TERM_BYTES).split()
        found = [(h, n) for t, n in Counter(terms).items() if (h := self[t]) is not None]
        return len(terms), [h for h, _ in found], [n for _, n in found]


def item_terms(items: DataFrame) -> DataFrame:
    """``(item, term, n)``: how often a term is in the texts of an item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Asked(None)
        for batch in batches:
            found = [known.of(t) for t in batch.column("text").to_pylist()]
            owner = pa.array(np.repeat(np.arange(len(found)), [len(f[1]) for f in found]))
            term = np.array([h for f in found for h in f[1]], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("item").take(owner), pa.array(term), pa.array([n for f in found for n in f[2]], pa.int64())], ["item", "term", "n"])

    parts = map_arrow(items.select("item", F.col("text").cast("binary").alias("text")), run, "item long, term long, n long")
    return parts.groupBy("item", "term").agg(F.sum("n").alias("n"))


def asked_bits(terms: DataFrame, bits: int) -> np.ndarray:
    """The table of bits of ``terms (term)``, as words of 64; at most ``bits`` / 64 rows
    come to the driver, whatever the items."""
    place = F.pmod("term", F.lit(bits))
    one = F.call_function("shiftleft", F.lit(1).cast("long"), place.bitwiseAND(63).cast("int"))
    out = np.zeros(bits >> 6, np.uint64)
    for at, word in terms.groupBy(F.shiftright(place, 6).alias("at")).agg(F.bit_or(one).alias("word")).collect():
        out[at] = word % (1 << 64)
    return out


def build_index(rows: DataFrame, bits: np.ndarray, sizes: Sizes) -> DataFrame:
    """Index blocks of each input partition's whole texts, without a shuffle; in a
    partition alike documents stand side by side as far as it holds them together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, number = Asked(bits), TaskContext.get().partitionId() << 32
        held: list[tuple[int, int | None, int, list[int], list[int]]] = []
        docs = tokens = 0  # of those not told yet, with and without asked terms

        def block(part: list) -> pa.RecordBatch:
            nonlocal docs, tokens, number
            arrays = [np.array([x[2] for x in part], np.int64), np.array([len(x[3]) for x in part], np.int32), np.array([h for x in part for h in x[3]], np.uint64), np.array([n for x in part for n in x[4]], np.int32)]
            out = pa.RecordBatch.from_arrays([pa.array([number]), pa.array([docs]), pa.array([tokens]), pa.array([[x[1] for x in part]], pa.list_(pa.int64())), *(pa.array([a.tobytes()], pa.binary()) for a in arrays)], [c.split()[0] for c in INDEX.split(", ")])
            docs = tokens = 0
            number += 1
            return out

        def cut(all_of_it: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held
            held.sort(key=lambda x: (x[0], x[2]))
            while len(held) >= sizes.block_docs or all_of_it and held:
                reach = np.cumsum([len(x[3]) for x in held[: sizes.block_docs]])
                n = max(1, int(np.searchsorted(reach, sizes.block_terms, "right")))
                part, held = held[:n], held[n:]
                yield block(part)

        for batch in batches:
            for i, text in zip(batch.column("id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                length, terms, counts = known.of(text)
                docs, tokens = docs + (length > 0), tokens + length
                if terms:
                    held.append((terms[counts.index(max(counts))], i, length, terms, counts))
            if len(held) >= 8 * sizes.block_docs:
                yield from cut(False)
        yield from cut(True)
        if docs:
            yield block([])

    return map_arrow(rows.select("id", F.col("text").cast("binary").alias("text")), run, INDEX)


def document_counts(index: DataFrame) -> DataFrame:
    """``(term, docs)``: documents per term, read from the index."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for terms in batch.column("terms").to_pylist():
                term, docs = np.unique(np.frombuffer(terms, np.int64), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(term), pa.array(docs)], ["term", "docs"])

    return map_arrow(index.select("terms"), run, "term long, docs long").groupBy("term").agg(F.sum("docs").alias("docs"))


def weight_of(total: int, docs: Column) -> Column:
    """A term's weight by the documents that hold it."""
    return F.floor(F.lit(WEIGHT) * F.ln(F.lit(2.0 * total + 2) / (2 * docs + 1).cast("double"))).cast("long")


def pack_items(weighed: DataFrame, packs: int, sizes: Sizes) -> DataFrame:
    """``(pack, items, each, terms, worth)``: up to ``sizes.pack_items`` items in a row,
    those that share their weightiest term side by side. A pack may have several rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in grouped(batches, "pack"):
            own = []
            for item, w in zip(group.column("item").to_pylist(), group.column("w").to_pylist(), strict=True):
                w = sorted(((x["worth"], x["term"]) for x in w), reverse=True)
                own.append((w[0][1], item, [t for _, t in w], [x for x, _ in w]))
            own.sort()
            while own:
                reach = np.cumsum([len(x[2]) for x in own[: sizes.pack_items]])
                n = max(1, int(np.searchsorted(reach, sizes.pack_terms, "right")))
                yield packed_row(group.column("pack")[0].as_py(), own[:n])
                own = own[n:]

    dealt = weighed.repartition(packs, "pack").sortWithinPartitions("pack", "item").select("pack", "item", "w")
    return map_arrow(dealt, run, "pack long, items binary, i_each binary, i_terms binary, i_worth binary")


def packed_row(pack: int, own: list[tuple]) -> pa.RecordBatch:
    arrays = [np.array([x[1] for x in own], np.int64), np.array([len(x[2]) for x in own], np.int32), np.array([t for x in own for t in x[2]], np.int64), np.array([v for x in own for v in x[3]], np.int64)]
    return pa.RecordBatch.from_arrays([pa.array([pack]), *(pa.array([a.tobytes()], pa.binary()) for a in arrays)], ["pack", "items", "i_each", "i_terms", "i_worth"])


def tree(rows: np.ndarray, leaf: int, fan: int) -> list[np.ndarray]:
    """Coordinate maxima by level, from the leaves (of ``leaf`` rows) to the root."""
    out, size = [], leaf
    while True:
        rows = np.maximum.reduceat(rows, np.arange(0, len(rows), size), axis=0)
        out.append(rows)
        if len(rows) == 1:
            return out
        size = fan


class Documents:
    """A block of documents: sparse rows of values, and its leaves' maxima."""

    def __init__(self, row: dict, n: int, total: int):
        lengths = np.frombuffer(row["lengths"], np.int64)
        self.each = np.frombuffer(row["each"], np.int32).astype(np.int64)
        tf = np.frombuffer(row["counts"], np.int32).astype(np.int64)
        self.ids = row["ids"]
        self.columns, self.term = np.unique(np.frombuffer(row["terms"], np.uint64), return_inverse=True)
        m = (100 - LENGTH) + np.array([LENGTH * n * int(x) // total for x in lengths.tolist()], np.int64)
        self.value = FREQUENCY * tf // (1000 * tf + SATURATION * np.repeat(m, self.each))
        self.begin = np.concatenate([[0], np.cumsum(self.each)])

    def dense(self, lo: int, hi: int, use: np.ndarray, dtype: type) -> np.ndarray:
        """Rows ``lo`` to ``hi`` in the columns ``use`` (place by column, or -1)."""
        mine = slice(self.begin[lo], self.begin[hi])
        column = use[self.term[mine]]
        out = np.zeros((hi - lo, int(use.max()) + 1), dtype)
        there = column >= 0
        out[np.repeat(np.arange(hi - lo), self.each[lo:hi])[there], column[there]] = self.value[mine][there]
        return out


class Items:
    """A pack of items, and the best ``k`` documents that each has so far."""

    def __init__(self, pack: dict, k: int, sizes: Sizes):
        self.k, self.sizes = k, sizes
        self.items = np.frombuffer(pack["items"], np.int64)
        self.each = np.frombuffer(pack["i_each"], np.int32).astype(np.int64)
        self.terms, self.term = np.unique(np.frombuffer(pack["i_terms"], np.int64).view(np.uint64), return_inverse=True)
        self.worth = np.frombuffer(pack["i_worth"], np.int64)
        self.owner = np.repeat(np.arange(len(self.items)), self.each)
        self.kth = np.zeros(len(self.items), np.int64)  # 0 until there are k
        self.best = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, np.int64))
        self.found: list[tuple[np.ndarray, ...]] = []
        self.waiting = 0

    def search(self, docs: Documents) -> None:
        """Traverse the trees of these items and of a block of documents together."""
        common, mine, theirs = np.intersect1d(self.terms, docs.columns, assume_unique=True, return_indices=True)
        if not len(common):
            return
        most = np.zeros(len(self.terms), np.int64)
        np.maximum.at(most, self.term, self.worth)
        dtype = np.float64 if int(most.sum()) * (FREQUENCY // 1000) < self.sizes.exact else np.int64
        place = np.full(len(self.terms), -1)
        place[mine] = np.arange(len(common))
        own = np.zeros((len(self.items), len(common)), dtype)
        there = place[self.term] >= 0
        own[self.owner[there], place[self.term[there]]] = self.worth[there]
        use = np.full(len(docs.columns), -1)
        use[theirs] = np.arange(len(common))
        size, leaf_docs, leaf_items = len(docs.each), self.sizes.leaf_docs, self.sizes.leaf_items
        leaves = np.concatenate([docs.dense(lo, min(lo + leaf_docs, size), use, dtype).max(axis=0)[None] for lo in range(0, size, leaf_docs)])
        below, beside = tree(own, leaf_items, self.sizes.fan), [leaves, *(tree(leaves, self.sizes.fan, self.sizes.fan) if len(leaves) > 1 else [])]
        pairs = np.ones((1, 1), bool)
        for level in range(max(len(below), len(beside)) - 1, -1, -1):
            i, d = min(level, len(below) - 1), min(level, len(beside) - 1)
            pairs = self.expanded(pairs, len(below[i]), len(beside[d]))
            weakest = self.weakest(len(below[i]), i)
            rows, cols = np.flatnonzero(pairs.any(axis=1)), np.flatnonzero(pairs.any(axis=0))
            if not len(rows):
                return
            bound = np.zeros(pairs.shape, dtype)
            bound[np.ix_(rows, cols)] = below[i][rows] @ beside[d][cols].T
            pairs &= (bound > 0) & (bound >= weakest[:, None])
        # leaves with the highest bounds first, so that the k-th best rise early
        reach = np.where(pairs, bound, 0).max(axis=0)
        for leaf in np.argsort(-reach, kind="stable").tolist():
            if reach[leaf] <= 0:
                break
            weakest = self.weakest(len(below[0]), 0)
            alive = np.flatnonzero(pairs[:, leaf] & (bound[:, leaf] >= weakest))
            asked = (alive[:, None] * leaf_items + np.arange(leaf_items)).ravel()
            asked = asked[asked < len(self.items)]
            top = own[asked] @ leaves[leaf]
            asked = asked[(top > 0) & (top >= self.kth[asked])]
            if len(asked):
                lo = leaf * leaf_docs
                scores = own[asked] @ docs.dense(lo, min(lo + leaf_docs, size), use, dtype).T
                a, b = np.nonzero((scores > 0) & (scores >= self.kth[asked][:, None]))
                self.add(asked[a], scores[a, b].astype(np.int64), [docs.ids[x] for x in (lo + b).tolist()])
        self.merge()

    def expanded(self, pairs: np.ndarray, rows: int, cols: int) -> np.ndarray:
        """Pairs of children of the pairs of nodes that are left."""
        for axis, n in ((0, rows), (1, cols)):
            if n > pairs.shape[axis]:
                pairs = np.repeat(pairs, self.sizes.fan, axis=axis).take(range(n), axis=axis)
        return pairs

    def weakest(self, nodes: int, level: int) -> np.ndarray:
        """The weakest k-th best score of the items under each node of a level."""
        under = self.sizes.leaf_items * self.sizes.fan**level
        return np.minimum.reduceat(self.kth, np.arange(nodes) * under)

    def add(self, item: np.ndarray, score: np.ndarray, ids: list[int | None]) -> None:
        self.found.append((item, score, np.array([i is None for i in ids], bool), np.array([i or 0 for i in ids], np.int64)))
        self.waiting += len(ids)
        if self.waiting >= self.sizes.merge:
            self.merge()

    def merge(self) -> None:
        if not self.found:
            return
        item, score, unknown, number = (np.concatenate(x) for x in zip(self.best, *self.found, strict=True))
        self.found, self.waiting = [], 0
        order = np.lexsort((number, unknown, -score, item))
        item, score, unknown, number = (x[order] for x in (item, score, unknown, number))
        begin = np.flatnonzero(np.concatenate([[True], item[1:] != item[:-1]]))
        rank = np.arange(len(item)) - np.repeat(begin, np.diff([*begin, len(item)]))
        last = rank == self.k - 1
        self.kth[item[last]] = score[last]
        self.best = tuple(x[rank < self.k] for x in (item, score, unknown, number))

    def result(self) -> pa.RecordBatch:
        item, score, unknown, number = self.best
        return pa.RecordBatch.from_arrays([pa.array(self.items[item]), pa.array(number, mask=unknown), pa.array(score)], ["item", "doc", "score"])


def nothing(spark: SparkSession, item: str) -> DataFrame:
    return spark.createDataFrame([], f"item_id {item}, rank int, doc_id long, score long")


def rank_documents(docs: DataFrame, items: DataFrame, k: int = 20, text: str = "text", key: str = "doc_id", item_text: str = "text", item_key: str = "item_id", sizes: Sizes = Sizes()) -> DataFrame:
    """``(item_id, rank, doc_id, score)``: the best ``k`` documents of each item.

    A score is the sum, over an item's terms with repeats, of the term's weight times
    its saturated frequency in the document. Only scores above 0 count; ties go to
    the smaller id, null last. Repeated documents are ranked one by one; texts of rows that
    share an item id, or have none, are one item. Null and empty texts, and terms that
    no document holds, have no score. Empty tables give an empty one. Other columns
    do not matter. Scores are exact below 2^63, documents' terms below 2^31 each.
    ``sizes`` cut the work and change no result.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"))
    given = items.select(F.col(item_key).alias("item_id"), F.col(item_text).alias("text"))
    named = materialize(given.select("item_id").distinct().withColumn("item", F.monotonically_increasing_id()), "lexical-items")
    numbered = given.alias("g").join(named.alias("n"), F.col("g.item_id").eqNullSafe(F.col("n.item_id"))).select("item", "text")
    terms = materialize(item_terms(numbered), "lexical-terms")
    # a row group a block, so that a reader holds one block at a time
    index = materialize(build_index(rows, asked_bits(terms, sizes.asked), sizes), "lexical-index", **{"parquet.block.row.count.limit": "1"})
    total, tokens = index.agg(F.coalesce(F.sum("docs"), F.lit(0)), F.coalesce(F.sum("tokens"), F.lit(0))).first()
    number = named.count()
    if not total or not number:
        return nothing(spark, dict(given.dtypes)["item_id"])
    worth = (F.col("n") * weight_of(total, F.col("docs"))).alias("worth")
    weighed = terms.join(document_counts(index), "term").select("item", F.struct("term", worth).alias("w")).where("w.worth > 0").groupBy("item").agg(F.collect_list("w").alias("w"))
    packs = -(-number // sizes.pack_items)
    packed = materialize(pack_items(weighed.withColumn("pack", F.pmod(F.xxhash64("item"), F.lit(packs))), packs, sizes), "lexical-packs", **{"parquet.block.row.count.limit": "1"})
    shards = max(-(-total // sizes.shard_docs), min(shuffle_partitions(spark), -(-total // sizes.block_docs)))
    parts = -(-number // sizes.held_items)

    of_index = [c.split()[0] for c in INDEX.split(", ") if c.split()[0] not in ("docs", "tokens")]
    kinds = dict(index.dtypes) | dict(packed.dtypes)

    def filled(df: DataFrame, turn: int, cell: Column) -> DataFrame:
        names = [*of_index, *packed.columns[1:]]
        return df.select(cell.cast("int").alias("cell"), F.lit(turn).alias("turn"), *(F.col(c) if c in df.columns else F.lit(None).cast(kinds[c]).alias(c) for c in names))

    shard = F.pmod(F.xxhash64("block"), F.lit(shards))
    every_part, every_shard = (F.explode(F.sequence(F.lit(0), F.lit(n - 1))) for n in (parts, shards))
    held = filled(packed.withColumn("shard", every_shard), 0, F.col("shard") * parts + F.pmod("pack", F.lit(parts)))
    sent = filled(index.where(F.size("ids") > 0).withColumn("part", every_part), 1, shard * parts + F.col("part"))
    dealt = held.unionByName(sent).repartitionById(int(shards * parts), "cell").sortWithinPartitions("cell", "turn", "block")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, here = None, []
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i].as_py() for c in batch.schema.names}
                if row["cell"] != now:
                    yield from (x.result() for x in here)
                    now, here = row["cell"], []
                if row["turn"] == 0:
                    here.append(Items(row, k, sizes))
                elif here:
                    block = Documents(row, total, tokens)
                    for x in here:
                        x.search(block)
        yield from (x.result() for x in here)

    best = map_arrow(dealt, run, "item long, doc long, score long")
    rank = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc")))
    ranked = best.withColumn("rank", rank).where(F.col("rank") <= k)
    return ranked.join(named, "item").select("item_id", "rank", F.col("doc").alias("doc_id"), "score")
