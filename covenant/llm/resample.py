"""Importance resampling towards a target distribution, by distributed radix sort.

Features are runs of one to ``n`` words, hashed to `BUCKETS` buckets. A bucket's
gain is the logarithm of how much denser it is in the target than in the
documents; a document's weight is the sum of its features' gains, looked up in one
array. Gumbel noise from a hash of the id is added, so the documents of the
highest scores are a sample without replacement by importance.

They are found by an LSD radix sort over the digits of a composite key, the score
downwards, then the id. Each pass is a stable counting sort spread over blocks of
positions: rows are counted by block and digit; a row's destination is the number of
rows with smaller digits, plus those of its digit in earlier blocks, plus those
before it in its own block. The last destinations are the ranks. A pass shuffles
the narrow rows once, by block and digit, so neither a digit nor a key that many
rows share makes a large task; no text is shuffled at all.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from covenant.llm.common import map_arrow, materialize, shuffle_partitions

#: Buckets of features; longest run of words; seed of the noise.
BUCKETS, RUN, SEED = 10_000, 1, 2024
#: Words of a document that can be drawn, and percent that are.
LEAST_WORDS, PERCENT = 20, 10
#: Gains and noise are told in thousandths.
SCALE = 1000
#: A word's bytes as they are, A-Z in lower case; all that parts words as spaces.
WORD_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
#: Words whose buckets a worker remembers.
CACHE_WORDS = 500_000
#: Bits of a digit; rows of a block of positions at least and at most.
DIGIT_BITS, BLOCK_ROWS = 15, (256, 1 << 18)


class Buckets(dict):
    """Bucket by feature, or what ``values`` has there."""

    def __init__(self, buckets: int, values: list[int] | None = None):
        super().__init__()
        self.buckets, self.values = buckets, values

    def __missing__(self, feature: bytes) -> int:
        at = zlib.crc32(feature) % self.buckets
        got = self[feature] = at if self.values is None else self.values[at]
        return got


def features_of(text: bytes | None, n: int) -> tuple[int, list[bytes]]:
    """The number of words of a text, and its features with repeats."""
    words = (text or b"").translate(WORD_BYTES).split()
    out = words
    for k in range(2, n + 1):
        out = out + [b" ".join(words[i : i + k]) for i in range(len(words) - k + 1)]
    return len(words), out


def bucket_counts(df: DataFrame, text: str = "text", n: int = RUN, buckets: int = BUCKETS) -> np.ndarray:
    """How many features each bucket has, over all texts; ``buckets`` numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, total = Buckets(buckets), np.zeros(buckets, np.int64)
        for batch in batches:
            for t in batch.column("text").to_pylist():
                found = Counter(features_of(t, n)[1])
                np.add.at(total, np.fromiter(map(known.__getitem__, found), np.int64, len(found)), np.fromiter(found.values(), np.int64, len(found)))
                if len(known) > CACHE_WORDS:
                    known.clear()
        there = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(there), pa.array(total[there])], ["bucket", "n"])

    parts = map_arrow(df.select(df[text].cast("binary").alias("text")), run, "bucket long, n long")
    out = np.zeros(buckets, np.int64)
    for bucket, count in parts.groupBy("bucket").agg(F.sum("n")).collect():  # at most `buckets` rows
        out[bucket] = count
    return out


def gains(raw: np.ndarray, target: np.ndarray) -> list[int]:
    """By bucket: the logarithm of the ratio of smoothed shares, in thousandths."""
    s_all, t_all, k = float(raw.sum()), float(target.sum()), len(raw)
    return [math.floor(SCALE * math.log((t + 1.0) * (s_all + k) / ((s + 1.0) * (t_all + k)))) for s, t in zip(raw.tolist(), target.tolist(), strict=True)]


def weigh(df: DataFrame, by_bucket: list[int], text: str = "text", key: str = "doc_id", n: int = RUN) -> DataFrame:
    """``(id, n_words, n_features, weight)`` of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Buckets(len(by_bucket), by_bucket)
        for batch in batches:
            words, size, weight = [], [], []
            for t in batch.column("text").to_pylist():
                count, found = features_of(t, n)
                words.append(count)
                size.append(len(found))
                weight.append(sum(map(known.__getitem__, found)))
                if len(known) > CACHE_WORDS:
                    known.clear()
            yield pa.RecordBatch.from_arrays([batch.column("id"), *(pa.array(x, pa.int64()) for x in (words, size, weight))], ["id", "n_words", "n_features", "weight"])

    return map_arrow(df.select(df[key].cast("long").alias("id"), df[text].cast("binary").alias("text")), run, "id long, n_words long, n_features long, weight long")


def noise(key: Column, seed: int) -> Column:
    """Gumbel noise by a hash of ``key``, in thousandths; a null key is empty text."""
    told = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))).cast("binary"), 256)
    h = F.conv(F.substring(told, 1, 8), 16, 10).cast("double")
    return F.floor(-SCALE * F.ln(-F.ln((h + 0.5) / float(1 << 32)))).cast("long")


def radix_sort(rows: DataFrame, keys: Sequence[tuple[str, int]], block: int) -> DataFrame:
    """``rows`` with ``pos``: their place, from 0, in the order of ``keys``.

    ``keys`` are columns of numbers of 0 or more with their bits, the most
    significant first. ``rows`` has a column ``pos``, distinct and stable, in whose
    order the first pass takes them. Each pass is written to the shared folder.
    """
    for column, bits in reversed(keys):
        passes = -(-bits // DIGIT_BITS)
        width = -(-bits // max(passes, 1))
        for at in range(passes):
            digit = F.shiftrightunsigned(F.col(column), at * width).bitwiseAND((1 << width) - 1).cast("int")
            cut = rows.withColumns({"__digit": digit, "__part": F.floor(F.col("pos") / F.lit(block)).cast("long")})
            counts = cut.groupBy("__part", "__digit").agg(F.count("*").alias("__n"))
            sums = cut.groupBy("__digit").agg(F.count("*").alias("n")).orderBy("__digit").collect()  # at most 2 ** DIGIT_BITS rows
            base = np.cumsum([0, *(r["n"] for r in sums)])[:-1].tolist()
            smaller = rows.sparkSession.createDataFrame([(r["__digit"], b) for r, b in zip(sums, base, strict=True)], "__digit int, __base long")
            earlier = F.coalesce(F.sum("__n").over(Window.partitionBy("__digit").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
            starts = counts.withColumn("__before", earlier).join(F.broadcast(smaller), "__digit").select("__part", "__digit", (F.col("__base") + F.col("__before")).alias("__start"))
            own = cut.withColumn("__own", F.row_number().over(Window.partitionBy("__part", "__digit").orderBy("pos")) - 1)
            moved = own.join(starts, ["__part", "__digit"]).withColumn("pos", F.col("__start") + F.col("__own"))
            rows = materialize(moved.select(*rows.columns), "radix")
    return rows


def draw(scored: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS) -> DataFrame:
    """``scored (pos, id, n_words, score, ..)`` with ``rank``: from 1 for the drawn,
    null for the others. Ties go to the smaller id, null last."""
    able = scored.where(F.col("n_words") >= least_words)
    n, low, high, first, last = able.agg(F.count("*"), F.min("score"), F.max("score"), F.min("id"), F.max("id")).first()
    quota = percent * n // 100
    others = scored.where(F.col("n_words") < least_words)
    if not quota:
        return scored.withColumn("rank", F.lit(None).cast("long"))
    first, last = (0, 0) if first is None else (first, last)
    by_score, by_id = (high - low).bit_length(), (last - first + 1).bit_length()
    down = F.lit(high) - F.col("score")
    if by_id > 62:  # ids far apart: as unsigned numbers, and null by a digit of its own
        keyed = able.withColumns({"__high": down * 2 + F.col("id").isNull().cast("long"), "__low": F.coalesce("id", F.lit(0)).bitwiseXOR(F.lit(-(1 << 63)))})
        keys = [("__high", by_score + 1), ("__low", 64)]
    else:
        up = F.coalesce(F.col("id") - F.lit(first), F.lit(last - first + 1))
        if by_score + by_id <= 62:
            keyed, keys = able.withColumn("__key", F.shiftleft(down, by_id).bitwiseOR(up)), [("__key", by_score + by_id)]
        else:
            keyed, keys = able.withColumns({"__high": down, "__low": up}), [("__high", by_score), ("__low", by_id)]
    block = min(max(n // (4 * shuffle_partitions(scored.sparkSession)), BLOCK_ROWS[0]), BLOCK_ROWS[1])
    ranked = radix_sort(keyed, keys, block).drop(*(c for c, _ in keys))
    rank = F.when(F.col("pos") < quota, F.col("pos") + 1)
    return ranked.withColumn("rank", rank).unionByName(others.withColumn("rank", F.lit(None).cast("long")))


def resample(df: DataFrame, target: DataFrame, text: str = "text", key: str = "doc_id", target_text: str = "text", n: int = RUN, buckets: int = BUCKETS, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED) -> DataFrame:
    """``(key, n_words, n_features, weight, score, rank)``, a row for each row of
    ``df``; ``rank`` from 1 for the ``percent`` of the documents with at least
    ``least_words`` words that are drawn, null for the others.

    Null and empty texts have no feature and weigh 0. Rows that repeat an id have
    the same noise, and are drawn one by one; their order among equal scores is
    any. Rows without an id share the noise of an empty one and come last among
    equal scores. Empty tables count no feature; an empty ``df`` gives an empty
    table. Other columns do not matter.
    """
    by_bucket = gains(bucket_counts(df, text, n, buckets), bucket_counts(target, target_text, n, buckets))
    weighed = weigh(df, by_bucket, text, key, n)
    scored = weighed.withColumn("score", F.col("weight") + noise(F.col("id"), seed)).withColumn("pos", F.monotonically_increasing_id())
    drawn = draw(materialize(scored, "resample-scored"), percent, least_words)
    return drawn.select(F.col("id").alias(key), "n_words", "n_features", "weight", "score", "rank")
