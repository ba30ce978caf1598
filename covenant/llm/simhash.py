"""Near-duplicates by SimHash: fingerprints, and a binary trie self-join.

Fingerprints are 64 bits over shingles of words. Two of them link at ``budget``
or fewer differing bits. The join walks pairs of nodes of a binary trie of the
distinct fingerprints from the root down, adds up the bits in which the two
paths differ, and drops a pair of nodes once they exceed the budget.

To deal the trie out, it is built four times, each time with another quarter of
the bits on top: as at most three bits differ, one quarter of any linked pair is
equal, so both stand below the same node at depth 16 of one of the four tries.
Subtrees at that depth are what tasks get, one after the other (8 bytes a
fingerprint are held). A task returns
a spanning forest of the links it found, never the pairs themselves.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from covenant.llm.common import components, map_arrow, materialize, spanning

BITS, QUARTERS = 64, 4
#: Of a task's pairs of nodes, so many are walked at once.
FRONT = 1 << 20
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def fingerprint(text: str | None, shingle: int, seed: int) -> int:
    """SimHash of a whole text; 0 if it has no word."""
    words = (text or "").encode("utf-8").translate(LOWER).split()
    if not words:
        return 0
    row = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = np.concatenate([[0], ends[:-1]])
    k = min(shingle, len(words))
    h = xxhash.xxh64_intdigest
    hashes = np.array([h(row[a:b], seed) for a, b in zip(starts[: len(words) - k + 1].tolist(), (ends[k - 1 :] - 1).tolist(), strict=True)], np.uint64)
    total = np.zeros(BITS, np.int64)
    for lo in range(0, len(hashes), 65536):
        part = hashes[lo : lo + 65536]
        total += np.unpackbits(part.astype(">u8").view(np.uint8).reshape(len(part), 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * total > len(hashes)).tobytes(), "big")


def fingerprints(df: DataFrame, text: str = "text", key: str = "doc_id", shingle: int = 3, seed: int = 42) -> DataFrame:
    """``(key, fingerprint long)`` of each row's whole text; the long's bits are
    the fingerprint. Words are split at ASCII white space, A-Z in lower case; a
    text of fewer words than a shingle is one shingle; null and empty texts have
    fingerprint 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = np.array([fingerprint(x, shingle, seed) for x in batch.column("__text").to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.array(got.view(np.int64))], [key, "fingerprint"])

    return map_arrow(df.select(key, df[text].alias("__text")), run, f"`{key}` {dict(df.dtypes)[key]}, fingerprint long")


def popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x)


def trie_links(values: np.ndarray, top: int, budget: int) -> tuple[np.ndarray, np.ndarray]:
    """Links among the distinct ``values`` that agree in the ``top`` first bits,
    as edges (value, least value of its group)."""
    values = np.unique(values)
    head = values >> np.uint64(BITS - top)
    lo = np.flatnonzero(np.concatenate([[True], head[1:] != head[:-1]])).astype(np.int64)
    hi = np.concatenate([lo[1:], [len(values)]]).astype(np.int64)
    big = hi - lo > 1
    lo, hi = lo[big], hi[big]
    stack = [(BITS - top - 1, lo, hi, lo, hi, np.zeros(len(lo), np.int8))]
    found_a: list[np.ndarray] = []
    found_b: list[np.ndarray] = []
    held = 0
    ones: dict[int, np.ndarray] = {}
    while stack:
        bit, lo1, hi1, lo2, hi2, diff = stack.pop()
        if len(lo1) > FRONT:
            for at in range(0, len(lo1), FRONT):
                part = slice(at, at + FRONT)
                stack.append((bit, lo1[part], hi1[part], lo2[part], hi2[part], diff[part]))
            continue
        single = (hi1 - lo1 == 1) & (hi2 - lo2 == 1)
        if single.any():  # two leaves: what is left of both paths is compared at once
            a, b = lo1[single], lo2[single]
            linked = (a != b) & (popcount(values[a] ^ values[b]) <= budget)
            if linked.any():
                found_a.append(a[linked])
                found_b.append(b[linked])
                held += int(linked.sum())
                if held > 4 * FRONT:
                    x, y = spanning(np.concatenate(found_a), np.concatenate(found_b))
                    found_a, found_b, held = [x], [y], len(x)
            lo1, hi1, lo2, hi2, diff = (v[~single] for v in (lo1, hi1, lo2, hi2, diff))
        if not len(lo1) or bit < 0:
            continue
        if bit not in ones:
            ones[bit] = np.concatenate([[0], np.cumsum((values >> np.uint64(bit)) & np.uint64(1), dtype=np.int64)])
        count = ones[bit]
        mid1, mid2 = hi1 - (count[hi1] - count[lo1]), hi2 - (count[hi2] - count[lo2])
        same = (lo1 == lo2) & (hi1 == hi2)
        nxt = []
        for a_lo, a_hi, b_lo, b_hi, more in ((lo1, mid1, lo2, mid2, 0), (mid1, hi1, mid2, hi2, 0), (lo1, mid1, mid2, hi2, 1), (mid1, hi1, lo2, mid2, 1)):
            keep = (a_hi > a_lo) & (b_hi > b_lo) & (diff + more <= budget)
            if more and a_lo is mid1:
                keep &= ~same  # the mirror of the pair before
            if not more:
                keep &= ~(same & (a_hi - a_lo == 1))  # a leaf with itself
            nxt.append((a_lo[keep], a_hi[keep], b_lo[keep], b_hi[keep], diff[keep] + np.int8(more)))
        stack.append((bit - 1, *(np.concatenate(v) for v in zip(*nxt, strict=True))))
    if not found_a:
        return values[:0], values[:0]
    x, y = spanning(np.concatenate(found_a), np.concatenate(found_b))
    return values[x], values[y]


def link_edges(distinct: DataFrame, budget: int = 3) -> DataFrame:
    """Edges ``(a, b)`` of a spanning forest of the links among the distinct
    values of ``fingerprint``."""
    if not 0 <= budget < QUARTERS:
        raise ValueError(f"a budget of {budget} needs more than {QUARTERS} quarters")
    width = BITS // QUARTERS

    def walk(q: np.ndarray, f: np.ndarray) -> Iterator[pa.RecordBatch]:
        for k in np.unique(q).tolist():
            turn, back = np.uint64(k * width), np.uint64((BITS - k * width) % BITS)
            mine = f[q == k]
            a, b = trie_links((mine << turn) | (mine >> back) if k else mine, width, budget)
            a, b = ((v >> turn) | (v << back) if k else v for v in (a, b))
            for lo in range(0, len(a), 65536):
                yield pa.RecordBatch.from_arrays([pa.array(v[lo : lo + 65536].view(np.int64)) for v in (a, b)], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # blocks come one after the other: whole ones are walked, the last is held
        held: list[list[np.ndarray]] = []
        size = 0
        for batch in batches:
            held.append([batch.column(c).to_numpy() for c in ("quarter", "block", "fingerprint")])
            size += batch.num_rows
            if size > FRONT:
                q, block, f = (np.concatenate(x) for x in zip(*held, strict=True))
                cut = np.flatnonzero((q[1:] != q[:-1]) | (block[1:] != block[:-1]))
                cut = int(cut[-1]) + 1 if len(cut) else 0
                yield from walk(q[:cut], f[:cut].view(np.uint64))
                held, size = [[x[cut:] for x in (q, block, f)]], 0
        if held:
            q, _, f = (np.concatenate(x) for x in zip(*held, strict=True))
            yield from walk(q, f.view(np.uint64))

    quarters = distinct.select("fingerprint", F.explode(F.array(*map(F.lit, range(QUARTERS)))).alias("quarter"))
    block = F.expr(f"shiftrightunsigned(fingerprint, {BITS - width} - {width} * quarter) & {(1 << width) - 1}")
    dealt = quarters.withColumn("block", block).repartition("quarter", "block").sortWithinPartitions("quarter", "block")
    return map_arrow(dealt.select("quarter", "block", "fingerprint"), run, "a long, b long")


def classes(df: DataFrame, text: str = "text", key: str = "doc_id", shingle: int = 3, seed: int = 42, budget: int = 3) -> DataFrame:
    """``(key, fingerprint long, component long, component_id)`` for each row: as
    `cluster`, with the component's own name beside its least key."""
    seen = materialize(fingerprints(df, text, key, shingle, seed), "simhash")
    nodes = materialize(seen.groupBy("fingerprint").agg(F.min(key).alias("least")), "simhash-distinct")
    found = components(link_edges(nodes, budget))
    named = nodes.join(found.withColumnRenamed("node", "fingerprint"), "fingerprint", "left").withColumn("component", F.coalesce("component", "fingerprint"))
    leasts = named.groupBy("component").agg(F.min("least").alias("component_id"))
    return seen.join(named.join(leasts, "component").select("fingerprint", "component", "component_id"), "fingerprint").select(key, "fingerprint", "component", "component_id")


def cluster(df: DataFrame, text: str = "text", key: str = "doc_id", shingle: int = 3, seed: int = 42, budget: int = 3) -> DataFrame:
    """``(key, fingerprint string, component_id)`` for each row.

    ``component_id`` is the least key reachable over links. Rows of equal
    fingerprint are one node, so copies are never paired; repeated rows stay
    repeated. A null key is passed over when a component's least key is chosen
    (null only if all are null). Null, empty and blank texts share fingerprint 0
    and link like any other. An empty table gives an empty one.
    """
    found = classes(df, text, key, shingle, seed, budget)
    return found.select(key, F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")
