"""Language-model scores by a Katz bigram model.

All tokens of all training texts count. The share of a word is a base share, for
a word of count c (c + 0.5) / (N + 0.5 (V + 1)); an unseen word has that of c = 0.
The share of v after u is evaluated recursively: d(n) n / c(u) if the pair was
seen n times, else the backoff weight of u times the share of v one level down.
Counts up to 5 are discounted by Good-Turing; the weight of u is what discounts
left of 1, by what the base gives to words not seen after u, so that the shares
given u sum to exactly 1. After a u whose followers all have higher counts nothing
is left: there half an occurrence is kept for the unseen, n / (c(u) + 0.5).

The tables are partitioned, and no task or driver holds one whole:

* texts become chunks of tokens, stored by chunk (`tokenized`); what follows are
  two exchanges of packed arrays between chunks and tables, each one row for a
  chunk and a partition;
* words go to partitions by hash, are counted, and each chunk gets back numbers
  and counts of its own words (`count_words`);
* distinct pairs go to partitions by their history u, are counted, and each chunk
  gets back its pairs' counts, and what the backoff weights of its histories are
  made of where a pair is unseen (`count_pairs`). A history that would fill more
  than a part of a partition is spread by v; there are at most `SPLIT` such a
  partition, and their sums are sent to all executors.

A chunk then scores its own texts, so rows need no key.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from covenant.llm.common import fold, grouped, map_arrow, materialize, shared_dir, shuffle_partitions

LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: Hash of the end of a text; and number of the history of a first token.
END, START = 0x656E64, 0
#: Tokens of a chunk, and words whose hashes a task remembers.
CHUNK, CACHE_WORDS = 1_500_000, 400_000
#: Tokens that a partition of the pairs has on average at most.
PART_TOKENS = 5_000_000
#: Counts up to this are discounted.
DISCOUNTED = 5
#: A history of more than 1 / SPLIT of a partition's tokens is spread.
SPLIT = 4
ONE_ROW = {"parquet.block.row.count.limit": "1"}


class Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        got = self[word] = xxhash.xxh64_intdigest(word)
        return got


def pack(values: np.ndarray) -> bytes:
    """Numbers of 0 or more as compressed planes of bytes."""
    values = np.ascontiguousarray(values, np.uint64)
    width = max(1, (int(values.max(initial=0)).bit_length() + 7) // 8)
    planes = np.ascontiguousarray(values.view(np.uint8).reshape(-1, 8)[:, :width].T)
    return bytes([width]) + zstandard.compress(planes.tobytes(), 3)


def unpack(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(data[1:]), np.uint8).reshape(data[0], -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, : data[0]] = planes.T
    return out.view(np.uint64).ravel().astype(np.int64)


def scatter(part: np.ndarray) -> tuple[list[int], list[np.ndarray]]:
    """The parts that occur, and the places of each (in their order)."""
    order = np.argsort(part, kind="stable")
    found, starts = np.unique(part[order], return_index=True)
    return found.tolist(), np.split(order, starts[1:])


def spread(values: np.ndarray, parts: int) -> np.ndarray:
    """A part for each number."""
    z = values.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    z = (z ^ (z >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return ((z >> np.uint64(32)) % np.uint64(parts)).astype(np.int64)


def tokenized(rows: DataFrame, key_type: str, parts: int) -> str:
    """A stored table of chunks, bucketed by ``chunk`` so that joins leave it in
    place: keys and training marks of texts, their sizes in tokens, the chunk's
    distinct words (hashes, commonest first) with their counts in training texts,
    and all tokens as places among these words. Returns its name."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Hashes()
        number = TaskContext.get().partitionId() << 32
        keys: list[pa.Array] = []
        tokens: list[int] = []
        marks, sizes = [], []

        def flush() -> pa.RecordBatch:
            hashes = np.array(tokens, np.uint64)
            words, place, n = np.unique(hashes, return_inverse=True, return_counts=True)
            order = np.argsort(-n, kind="stable")
            rank = np.empty(len(words), np.int64)
            rank[order] = np.arange(len(words))
            place = rank[place]
            trained = np.bincount(place[np.repeat(np.array(marks, bool), sizes)], minlength=len(words))
            held = pa.concat_arrays(keys)
            packed = [np.array(marks, np.uint8).tobytes(), pack(np.array(sizes)), words[order].tobytes(), pack(trained), pack(place)]
            return pa.RecordBatch.from_arrays([pa.array([number]), pa.ListArray.from_arrays(pa.array([0, len(held)], pa.int32()), held), *(pa.array([x], pa.binary()) for x in packed)], ["chunk", "keys", "train", "sizes", "words", "counts", "tokens"])

        for batch in batches:
            lo = 0
            for i, (mark, text) in enumerate(zip(batch.column("train").to_pylist(), batch.column("text").to_pylist(), strict=True)):
                words = text.encode("utf-8").translate(LOWER).split()
                tokens.extend(map(known.__getitem__, words))
                tokens.append(END)
                marks.append(mark)
                sizes.append(len(words) + 1)
                if len(tokens) >= CHUNK:
                    keys.append(batch.column("key").slice(lo, i + 1 - lo))
                    lo = i + 1
                    yield flush()
                    number += 1
                    keys, tokens, marks, sizes = [], [], [], []
                if len(known) > CACHE_WORDS:
                    known.clear()
            keys.append(batch.column("key").slice(lo))
        if tokens:
            yield flush()

    name = f"katz_chunks_{uuid.uuid4().hex}"
    chunks = map_arrow(rows, run, f"chunk long, keys array<{key_type}>, train binary, sizes binary, words binary, counts binary, tokens binary")
    chunks.write.options(**ONE_ROW).option("path", f"{shared_dir(rows.sparkSession)}/{name}").bucketBy(parts, "chunk").saveAsTable(name)
    return name


def count_words(chunks: DataFrame, parts: int) -> DataFrame:
    """``(chunk, part, places, numbers, totals, tokens, words)``: for each chunk and
    partition the places of the chunk's words there, the words' numbers (1 or
    more) and counts in all training texts; and, with a null chunk, how many
    training tokens and words the partition has."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, words, counts in zip(batch.column("chunk").to_pylist(), batch.column("words").to_pylist(), batch.column("counts").to_pylist(), strict=True):
                words, counts = np.frombuffer(words, np.uint64), unpack(counts)
                asked, cut = scatter((words % np.uint64(parts)).astype(np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(asked, pa.int32()), pa.array([chunk] * len(asked), pa.int64()), pa.array([pack(x) for x in cut]), pa.array([words[x].tobytes() for x in cut], pa.binary()), pa.array([pack(counts[x]) for x in cut])], ["part", "chunk", "places", "words", "counts"])

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in grouped(batches, "part"):
            held = [np.frombuffer(x, np.uint64) for x in group.column("words").to_pylist()]
            words, place = np.unique(np.concatenate(held), return_inverse=True)
            total = np.bincount(place, np.concatenate([unpack(x) for x in group.column("counts").to_pylist()]), len(words)).astype(np.int64)
            rank = np.empty(len(words), np.int64)
            rank[np.argsort(-total, kind="stable")] = np.arange(len(words))
            part = group.column("part")[0].as_py()
            number = rank * parts + part + 1
            ends = np.cumsum([0, *map(len, held)])
            mine = [place[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]
            n = len(mine)
            columns = [group.column("chunk").combine_chunks(), pa.array([part] * n, pa.int32()), group.column("places").combine_chunks(), pa.array([pack(number[x]) for x in mine]), pa.array([pack(total[x]) for x in mine]), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64())]
            names = ["chunk", "part", "places", "numbers", "totals", "tokens", "words"]
            yield pa.RecordBatch.from_arrays(columns, names)
            yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.array([part], pa.int32()), *(pa.nulls(1, pa.binary()) for _ in range(3)), pa.array([int(total.sum())]), pa.array([int((total > 0).sum())])], names)

    asked = map_arrow(chunks.select("chunk", "words", "counts"), ask, "part int, chunk long, places binary, words binary, counts binary")
    dealt = asked.repartitionById(parts, "part").sortWithinPartitions("part", "chunk")
    return map_arrow(dealt, answer, "chunk long, part int, places binary, numbers binary, totals binary, tokens long, words long")


class Chunk:
    """The tokens of a chunk by the words' numbers, and its distinct pairs."""

    def __init__(self, row: dict, texts: int):
        self.sizes = unpack(row["sizes"])
        self.train = np.frombuffer(row["train"], np.uint8).astype(bool)
        count = len(row["words"]) // 8
        number, total = np.zeros(count + 1, np.int64), np.zeros(count + 1, np.int64)
        for part in row["own"]:
            at = unpack(part["places"])
            number[at], total[at] = unpack(part["numbers"]), unpack(part["totals"])
        number[count], total[count] = START, texts  # of the history of a first token
        self.total, tokens = total, unpack(row["tokens"])
        self.tokens = tokens
        before = np.concatenate([[count], tokens[:-1]])
        self.starts = np.concatenate([[0], np.cumsum(self.sizes)[:-1]]).astype(np.int64)
        before[self.starts] = count
        self.pairs, self.place = np.unique(before * (count + 1) + tokens, return_inverse=True)
        self.u, self.v = self.pairs // (count + 1), self.pairs % (count + 1)
        self.u_number, self.v_number = number[self.u], number[self.v]

    def parts(self, parts: int, each: float) -> dict[int, np.ndarray]:
        """The pairs of each partition that has any, by history and word."""
        salts = 1 + (self.total[self.u] * SPLIT / max(each, 1)).astype(np.int64)
        part = spread(self.u_number * 1_000_003 + np.where(salts > 1, self.v_number % salts, 0), parts)
        order = np.lexsort((self.v_number, self.u_number))
        found, places = scatter(part[order])
        return {p: order[x] for p, x in zip(found, places, strict=True)}


def history_sums(index: np.ndarray, size: int, n: np.ndarray, base: np.ndarray) -> np.ndarray:
    """By history: pairs seen once to five times, tokens of the others, and the
    base shares of all followers."""
    columns = [np.bincount(index[n == r], minlength=size) for r in range(1, DISCOUNTED + 1)]
    often = n > DISCOUNTED
    return np.stack([*columns, np.bincount(index[often], n[often], size), np.bincount(index[n > 0], base[n > 0], size)], axis=1).astype(np.float64)


def count_pairs(resolved: DataFrame, texts: int, parts: int, each: float, room: float) -> DataFrame:
    """The pair table and what chunks asked of it, as rows of three kinds.

    ``pairs``: a partition's distinct pairs ``(u, v, n)``, packed, with ``of`` (how
    many were seen once, twice .. six times). ``answer``: for a chunk, counts of
    its pairs in the order asked, twice as great and odd where the history has no
    discounted follower; and sums of the histories with an unseen pair. ``spread``:
    a partition's sums of the histories that are spread over several.
    """

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                chunk = Chunk(row, texts)
                seen = np.bincount(chunk.place[np.repeat(chunk.train, chunk.sizes)], minlength=len(chunk.pairs))
                out: list[list] = [[], [], [], [], [], []]
                for p, at in chunk.parts(parts, each).items():
                    u = chunk.u_number[at]
                    first = np.flatnonzero(np.concatenate([[True], u[1:] != u[:-1]]))
                    wide = (chunk.total[chunk.u[at[first]]] * SPLIT >= max(each, 1)).astype(np.int64)
                    values = (p, np.diff(u[first], prepend=0) * 2 + wide, np.diff([*first, len(at)]), chunk.v_number[at], chunk.total[chunk.v[at]], seen[at])
                    for column, value in zip(out, values, strict=True):
                        column.append(value if value is p else pack(value))
                yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int32()), pa.array([row["chunk"]] * len(out[0]), pa.int64()), *(pa.array(x, pa.binary()) for x in out[1:])], ["part", "chunk", "us", "runs", "vs", "totals", "seen"])

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["kind", "part", "chunk", "of", "us", "vs", "ns", "sums"]

        def rows(kind: str, part: int, chunks: list, of: list, *data: list) -> pa.RecordBatch:
            n = len(chunks)
            return pa.RecordBatch.from_arrays([pa.array([kind] * n), pa.array([part] * n, pa.int32()), pa.array(chunks, pa.int64()), pa.array(of, pa.list_(pa.int64())), *(pa.array(x, pa.binary()) for x in data)], names)

        for group in grouped(batches, "part"):
            part, chunks = group.column("part")[0].as_py(), group.column("chunk").to_pylist()
            us, runs = ([unpack(x) for x in group.column(c).to_pylist()] for c in ("us", "runs"))
            wide = np.concatenate([x & 1 for x in us])
            us = [np.cumsum(x >> 1) for x in us]
            history, at = np.unique(np.concatenate(us), return_inverse=True)
            is_wide = np.zeros(len(history), bool)
            is_wide[at[wide > 0]] = True
            u = np.repeat(at, np.concatenate(runs))
            v, total, seen = (np.concatenate([unpack(x) for x in group.column(c).to_pylist()]) for c in ("vs", "totals", "seen"))
            pairs, first, place = np.unique(u * (int(v.max()) + 1) + v, return_index=True, return_inverse=True)
            n = np.bincount(place, seen, len(pairs)).astype(np.int64)
            u_of = u[first]
            sums = history_sums(u_of, len(history), n, (total[first] + 0.5) / room)
            known = n > 0
            of = np.bincount(np.minimum(n[known], DISCOUNTED + 2), minlength=DISCOUNTED + 3)[1 : DISCOUNTED + 2]
            yield rows("pairs", part, [None], [of.tolist()], [pack(np.diff(history[u_of[known]], prepend=0))], [pack(v[first][known])], [pack(n[known])], [None])
            if is_wide.any():
                yield rows("spread", part, [None], [None], [pack(history[is_wide])], [None], [None], [sums[is_wide].tobytes()])
            full = sums[:, :DISCOUNTED].sum(axis=1) == 0
            ends = np.cumsum([0, *(int(x.sum()) for x in runs)])
            for chunk, lo, hi in zip(chunks, ends[:-1], ends[1:], strict=True):
                mine, of_u = n[place[lo:hi]], u[lo:hi]
                wanted = np.unique(of_u[mine == 0])
                wanted = wanted[~is_wide[wanted]]
                told = [pack(sums[wanted, c].astype(np.int64)) for c in range(DISCOUNTED + 1)]
                ends_of = np.cumsum([0, *map(len, told)])
                data = np.array([len(ends_of), *ends_of], np.int64).tobytes() + b"".join(told) + sums[wanted, -1].tobytes()
                yield rows("answer", part, [chunk], [None], [pack(history[wanted])], [None], [pack(2 * mine + full[of_u])], [data])

    asked = map_arrow(resolved, ask, "part int, chunk long, us binary, runs binary, vs binary, totals binary, seen binary")
    dealt = asked.repartitionById(parts, "part").sortWithinPartitions("part", "chunk")
    return map_arrow(dealt, answer, "kind string, part int, chunk long, of array<long>, us binary, vs binary, ns binary, sums binary")


def told_sums(data: bytes, size: int) -> np.ndarray:
    """`history_sums` as packed in an answer."""
    count = int(np.frombuffer(data, np.int64, 1)[0])
    ends = np.frombuffer(data, np.int64, count, 8)
    body = 8 * (count + 1)
    columns = [unpack(data[body + a : body + b]) for a, b in zip(ends[:-1], ends[1:], strict=True)]
    return np.stack([*columns, np.frombuffer(data, np.float64, size, body + int(ends[-1]))], axis=1)


def good_turing(counts: dict[int, int]) -> list[float]:
    """Discounts of the counts 1 to `DISCOUNTED`, by Katz; where the counts of
    counts give none between 0 and 1, half an occurrence is taken off."""
    n = [0.0, *(float(counts.get(r, 0)) for r in range(1, DISCOUNTED + 2))]
    common = (DISCOUNTED + 1) * n[DISCOUNTED + 1] / n[1] if n[1] else 1.0
    out = []
    for r in range(1, DISCOUNTED + 1):
        d = ((r + 1) * n[r + 1] / (r * n[r]) - common) / (1 - common) if n[r] and common < 1 else 0.0
        out.append(d if 0 < d < 1 else (r - 0.5) / r)
    return out


def backoff(sums: np.ndarray, discounts: np.ndarray) -> np.ndarray:
    """log10 backoff weights of histories; that of one never followed is 0."""
    r = np.arange(1, DISCOUNTED + 1)
    seen, whole = sums[:, :DISCOUNTED], sums[:, :DISCOUNTED] @ r + sums[:, DISCOUNTED]
    lost = seen @ (r * (1 - discounts))
    left = np.where(lost > 0, lost / np.maximum(whole, 1), 0.5 / (whole + 0.5))
    return np.where(whole > 0, np.log10(left) - np.log10(np.maximum(1 - sums[:, -1], 1e-300)), 0.0)


def score(df: DataFrame, text: str = "text", key: str = "doc_id", parts: int = 5, left_out: int = 1) -> DataFrame:
    """``(key, held_out, n_tokens, n_known, train_tokens, base_score, score)``.

    Words are split at ASCII white space, A-Z in lower case; every text ends with
    an end token, so null and empty texts have one token. Rows whose fold is not
    ``left_out`` train; repeated rows train as often as they are there, and score
    alike; null keys count as empty text in the fold. Without training rows N and
    V are 0 and every token has the share 1. An empty table gives an empty one;
    other columns are ignored. Words are told apart by 64-bit hashes.
    """
    spark = df.sparkSession
    rows = df.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"), (fold(F.col(key), parts) != left_out).alias("train"))
    texts = rows.where("train").count()
    buckets = shuffle_partitions(spark)
    name = tokenized(rows, dict(rows.dtypes)["key"], buckets)
    chunks = spark.table(name)
    words = materialize(count_words(chunks, buckets), "katz-words", **ONE_ROW)
    total, distinct = words.where("chunk IS NULL").agg(F.coalesce(F.sum("tokens"), F.lit(0)), F.coalesce(F.sum("words"), F.lit(0))).first()
    room = total + 0.5 * (distinct + 1)
    own = words.where("chunk IS NOT NULL").groupBy("chunk").agg(F.collect_list(F.struct("places", "numbers", "totals")).alias("own"))
    resolved = chunks.select("chunk", "keys", "train", "sizes", "words", "tokens").join(own, "chunk")
    pair_parts = max(buckets, math.ceil(total / PART_TOKENS))
    each = total / pair_parts
    counted = materialize(count_pairs(resolved.drop("keys"), texts, pair_parts, each, room), "katz-pairs", **ONE_ROW)
    of = counted.where("kind = 'pairs'").agg(*(F.coalesce(F.sum(F.col("of")[r]), F.lit(0)) for r in range(DISCOUNTED + 1))).first()
    discounts = np.array(good_turing(dict(enumerate(of, 1))))
    wide: dict[int, np.ndarray] = {}  # of at most SPLIT histories a partition, and START
    for r in counted.where("kind = 'spread'").select("us", "sums").toLocalIterator():
        numbers = unpack(r.us)
        for u, sums in zip(numbers.tolist(), np.frombuffer(r["sums"], np.float64).reshape(len(numbers), -1), strict=True):
            wide[u] = wide[u] + sums if u in wide else sums
    wide_u = np.array(sorted(wide), np.int64)
    wide_sums = np.stack([wide[u] for u in wide_u.tolist()]) if len(wide_u) else np.zeros((0, DISCOUNTED + 2))
    table = spark.sparkContext.broadcast((wide_u, wide_sums))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wide_u, wide_sums = table.value
        rate = np.concatenate([[1.0], discounts])
        for batch in batches:
            keys = batch.column("keys")
            for i, row in enumerate(batch.drop_columns(["keys"]).to_pylist()):
                chunk = Chunk(row, texts)
                asked_of = chunk.parts(pair_parts, each)
                n, full = np.zeros(len(chunk.pairs), np.int64), np.zeros(len(chunk.pairs), bool)
                numbers, weights = [wide_u], [backoff(wide_sums, discounts)]
                for part in row["answers"]:
                    at = asked_of[part["part"]]
                    told = unpack(part["ns"])
                    n[at], full[at] = told >> 1, (told & 1).astype(bool)
                    asked = unpack(part["us"])
                    numbers.append(asked)
                    weights.append(backoff(told_sums(part["sums"], len(asked)), discounts))
                of_u, at = np.unique(np.concatenate(numbers), return_index=True)
                weight = np.concatenate(weights)[at]
                if len(wide_u):  # the partitions of a spread history know only some of its followers
                    at = np.minimum(np.searchsorted(wide_u, chunk.u_number), len(wide_u) - 1)
                    hit = wide_u[at] == chunk.u_number
                    full[hit] = (wide_sums[at[hit], :DISCOUNTED].sum(axis=1) == 0)
                base = np.log10((chunk.total + 0.5) / room)
                history = chunk.total[chunk.u].astype(np.float64)
                seen = n > 0
                share = np.zeros(len(n))
                few = np.where(n <= DISCOUNTED, n, 0)
                share[seen] = np.log10(rate[few[seen]] * n[seen] / (history[seen] + 0.5 * full[seen]))
                if len(of_u):
                    at = np.minimum(np.searchsorted(of_u, chunk.u_number[~seen]), len(of_u) - 1)
                    share[~seen] = np.where(of_u[at] == chunk.u_number[~seen], weight[at], 0.0)
                share[~seen] += base[chunk.v[~seen]]
                known = (chunk.total > 0)[chunk.tokens]
                columns = [~chunk.train, chunk.sizes, np.add.reduceat(known.astype(np.int64), chunk.starts), np.full(len(chunk.sizes), total), np.add.reduceat(base[chunk.tokens], chunk.starts), np.add.reduceat(share[chunk.place], chunk.starts)]
                yield pa.RecordBatch.from_arrays([keys.slice(i, 1).flatten(), *map(pa.array, columns)], [key, "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    answers = counted.where("kind = 'answer'").groupBy("chunk").agg(F.collect_list(F.struct("part", "us", "ns", "sums")).alias("answers"))
    scored = resolved.join(answers, "chunk")
    return map_arrow(scored, run, f"`{key}` {dict(rows.dtypes)['key']}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
