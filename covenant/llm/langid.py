"""Language identification by interpolated Kneser-Ney character models.

Each language has a model of the characters of its words (an end mark included),
given up to four before them. Lower orders count in how many ways a gram can be
preceded, and every order passes what its discount takes to the next lower one.
The models are stored together: for each order a sorted array of gram hashes with
a column of probabilities per language, and one of context hashes with the share
that a context passes on. Texts get the language of the lowest cross-entropy per
character; a temperature fitted on tuning rows turns the differences into a
score, and a bound on the cross-entropy, fitted on the same rows, marks texts in
none of the languages.

Learning reads at most about ``max_rows`` rows a language, chosen by a hash. The
model is sent to every executor, so its size is bounded by parameters of `learn`,
``max_languages`` and ``max_grams``; more is an error, never a smaller model.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from covenant.llm.common import fold, map_arrow, materialize

WORD = re.compile(r"[^\W\d_]+")
BEGIN, END = "\x02", "\x03"
ORDER = 5
UND = "und"
CACHE_WORDS = 400_000
FACTOR = np.uint64(0x9E3779B97F4A7C15)


def chained(h: np.ndarray, c: np.ndarray) -> np.ndarray:
    """The hash of a gram, from that of all but its last character, and this."""
    with np.errstate(over="ignore"):
        z = (h ^ (h >> np.uint64(29))) * FACTOR + (c + np.uint64(1)) * np.uint64(0xBF58476D1CE4E5B9)
        return z ^ (z >> np.uint64(32))


def hashes(grams: list[str]) -> np.ndarray:
    """Hashes of grams of one length."""
    if not grams:
        return np.zeros(0, np.uint64)
    points = np.frombuffer("".join(grams).encode("utf-32-le"), np.uint32).reshape(len(grams), -1).astype(np.uint64)
    h = np.zeros(len(grams), np.uint64)
    for c in range(points.shape[1]):
        h = chained(h, points[:, c])
    return h


@dataclass
class Model:
    languages: list[str] = field(default_factory=list)
    floor: np.ndarray = field(default_factory=lambda: np.zeros(0, np.float32))
    grams: list[tuple[np.ndarray, np.ndarray]] = field(default_factory=list)
    passed: list[tuple[np.ndarray, np.ndarray]] = field(default_factory=list)
    temperature: float = 1.0
    bound: float = float("inf")

    @classmethod
    def build(cls, counts: dict[str, dict[str, int]]) -> Model:
        """From the counts of the longest grams of every language."""
        languages = sorted(counts)
        levels: list[list[dict[str, int]]] = []
        for lang in languages:
            by: list[dict[str, int]] = [defaultdict(int) for _ in range(ORDER + 1)]
            for gram, n in counts[lang].items():
                by[len(gram)][gram] += n
            for n in range(ORDER, 1, -1):
                for gram in by[n]:
                    by[n - 1][gram[1:]] += 1
            levels.append(by)
        charset = {g for by in levels for g in by[1]}
        uniform = 1.0 / (len(charset) + 1)
        model = cls(languages)
        lower: dict[str, int] = {}
        values = np.zeros((0, 0))
        for n in range(1, ORDER + 1):
            names = sorted({g for by in levels for g in by[n]})
            contexts = sorted({g[:-1] for g in names})
            at = {c: i for i, c in enumerate(contexts)}
            where = np.array([at[g[:-1]] for g in names], np.int64)
            cnt = np.array([[by[n].get(g, 0) for by in levels] for g in names], np.float64).reshape(len(names), len(languages))
            total, types = np.zeros((len(contexts), len(languages))), np.zeros((len(contexts), len(languages)))
            np.add.at(total, where, cnt)
            np.add.at(types, where, cnt > 0)
            once, twice = (cnt == 1).sum(axis=0), (cnt == 2).sum(axis=0)
            discount = np.clip(np.where(once > 0, once / np.maximum(once + 2.0 * twice, 1), 0.5), 0.1, 0.95)
            passed = np.where(total > 0, discount * types / np.maximum(total, 1), 1.0)
            below = values[[lower[g[1:]] for g in names]] if n > 1 else np.full((len(names), len(languages)), uniform)
            own = np.where(total[where] > 0, np.maximum(cnt - discount, 0) / np.maximum(total[where], 1), 0.0)
            values = own + passed[where] * below
            lower = {g: i for i, g in enumerate(names)}
            for keys, table, store in ((hashes(names), values, model.grams), (hashes(contexts), passed, model.passed)):
                order = np.argsort(keys)
                store.append((keys[order], table[order].astype(np.float32)))
            if n == 1:
                model.floor = (passed[0] * uniform).astype(np.float32)
        return model

    def log2(self, words: list[str]) -> np.ndarray:
        """Log2 probability of each word in each language."""
        text = "".join(f"{BEGIN}{w}{END}" for w in words)
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        sizes = np.array([len(w) + 2 for w in words], np.int64)
        starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        inside = np.arange(len(points)) - np.repeat(starts, sizes)
        p = np.empty((len(points), len(self.languages)), np.float32)
        h = np.zeros(len(points), np.uint64)
        for n in range(1, ORDER + 1):
            before = np.concatenate([np.zeros(1, np.uint64), h[:-1]]) if n > 1 else h
            h = chained(before, points)
            use = np.flatnonzero(inside >= max(1, n - 1))
            place, hit = found(self.grams[n - 1][0], h[use])
            if n == 1:
                p[use] = self.floor
            else:
                at, known = found(self.passed[n - 1][0], before[use[~hit]])
                p[use[~hit][known]] *= self.passed[n - 1][1][at[known]]
            p[use[hit]] = self.grams[n - 1][1][place[hit]]
        p[starts] = 1.0
        return np.add.reduceat(np.log2(p), starts, axis=0)


def found(keys: np.ndarray, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of ``asked`` in the sorted ``keys``, and whether they are there."""
    if not len(keys):
        return np.zeros(len(asked), np.int64), np.zeros(len(asked), bool)
    at = np.minimum(np.searchsorted(keys, asked), len(keys) - 1)
    return at, keys[at] == asked


class Scorer:
    """Cross-entropies of texts, remembering the words it has seen."""

    def __init__(self, model: Model):
        self.model = model
        self.forget()

    def forget(self) -> None:
        self.index: dict[str, int] = {}
        self.table = np.zeros((0, len(self.model.languages)), np.float32)

    def entropies(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Bits a character in each language, and the characters, of each text;
        texts without a letter have none."""
        if len(self.index) > CACHE_WORDS:
            self.forget()
        index = self.index
        ids, ends, chars = [], [], []
        for x in texts:
            words = WORD.findall(x.lower()) if x else []
            if not any(c.isalpha() for w in words for c in w):
                words = []
            for w in words:
                ids.append(index.setdefault(w, len(index)))
            ends.append(len(ids))
            chars.append(sum(map(len, words)) + len(words))
        fresh = list(index)[len(self.table) :]
        parts = [self.table] + [self.model.log2(fresh[k : k + 20000]).astype(np.float32) for k in range(0, len(fresh), 20000)]
        self.table = np.concatenate(parts)
        total = np.zeros((len(texts), len(self.model.languages)))
        lo = 0
        for k, hi in enumerate(ends):
            for at in range(lo, hi, 65536):
                total[k] += self.table[ids[at : min(hi, at + 65536)]].sum(axis=0, dtype=np.float64)
            lo = hi
        size = np.array(chars, np.int64)
        return -total / np.maximum(size, 1)[:, None], size


def posterior(bits: np.ndarray, temperature: float) -> np.ndarray:
    z = -temperature * bits
    z = np.exp(z - z.max(axis=1, keepdims=True))
    return z / z.sum(axis=1, keepdims=True)


def learn(docs: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", parts: int = 3, left_out: int = 1, max_rows: int = 1500, max_languages: int = 500, max_grams: int = 5_000_000) -> Model:
    """Learn from rows with a text and a language whose fold is not ``left_out``.

    One row in five of the sample is not counted but used for tuning. Without
    any rows the model has no languages.
    """
    rows = docs.select(F.col(key).alias("__key"), F.col(text).alias("text"), F.col(lang).alias("lang")).where(F.col("text").isNotNull() & F.col("lang").isNotNull() & (fold(F.col(key), parts) != left_out))
    sizes = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count("*").alias("n")).limit(max_languages + 1).collect()}
    if len(sizes) > max_languages:
        raise ValueError(f"more than {max_languages} languages")
    if not sizes:
        return Model()
    spark = docs.sparkSession
    share = spark.createDataFrame([(k, min(1.0, max_rows / n)) for k, n in sizes.items()], "lang string, share double")
    chance = F.pmod(F.xxhash64(F.lit("language"), "__key"), F.lit(1 << 30)) / float(1 << 30)
    tune = F.pmod(F.xxhash64(F.lit("tune"), "__key"), F.lit(5)) == 0
    sample = materialize(rows.join(F.broadcast(share), "lang").where(chance < F.col("share")).select("lang", "text", tune.alias("tune")), "language-sample")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words: Counter = Counter()
            for name, x in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
                words.update((name, w) for w in WORD.findall(x.lower()))
            seen: Counter = Counter()
            for (name, w), n in words.items():
                s = f"{BEGIN}{w}{END}"
                for i in range(1, len(s)):
                    seen[name, s[max(0, i - ORDER + 1) : i + 1]] += n
            yield pa.RecordBatch.from_pydict({"lang": pa.array([k[0] for k in seen], pa.string()), "gram": pa.array([k[1] for k in seen], pa.string()), "n": pa.array(seen.values(), pa.int64())})

    table = map_arrow(sample.where("not tune").select("lang", "text"), count, "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    got = table.limit(max_grams + 1).toArrow()  # bounded by the sample, and checked
    if got.num_rows > max_grams:
        raise ValueError(f"more than {max_grams} grams: take a smaller max_rows")
    counts: dict[str, dict[str, int]] = defaultdict(dict)
    for name, gram, n in zip(*(got.column(c).to_pylist() for c in ("lang", "gram", "n")), strict=True):
        counts[name][gram] = n
    if not counts:
        return Model()
    model = Model.build(counts)
    shared = spark.sparkContext.broadcast(model)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for batch in batches:
            bits, size = scorer.entropies(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("lang"), pa.array(bits.tolist(), pa.list_(pa.float64())), pa.array(size)], ["lang", "bits", "size"])

    tuned = [r for r in map_arrow(sample.where("tune").select("lang", "text"), measure, "lang string, bits array<double>, size long").where("size > 0").collect() if r.lang in counts]
    if tuned:
        bits = np.array([r.bits for r in tuned])
        own = np.array([model.languages.index(r.lang) for r in tuned])
        row = np.arange(len(own))
        loss = {t: -np.log(np.maximum(posterior(bits, t)[row, own], 1e-9)).mean() for t in (1.0, 2.0, 4.0, 8.0, 16.0, 32.0)}
        model.temperature = min(loss, key=lambda t: (loss[t], t))
        model.bound = float(np.quantile(bits[row, own], 0.999) * 1.1)
    return model


def identify(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred string, score double, bits double, rejected boolean``.

    Texts that are null or have no letter are ``und`` with score 0 and rejected;
    other texts get a learned language, and are rejected (not renamed) where even
    its model finds them unlikely. Whole texts are read, row by row, so repeated
    rows agree; an empty table gives an empty one; columns of ``docs`` are passed
    on, except ones named like the added.
    """
    added = ("lang_pred", "score", "bits", "rejected")
    keep = [c for c in docs.columns if c not in added]
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        names = np.array([*shared.value.languages, UND], object)
        for batch in batches:
            n = batch.num_rows
            if not n or len(names) == 1:
                best, score, bits, rejected = np.zeros(n, np.int64), np.zeros(n), np.zeros(n), np.ones(n, bool)
            else:
                all_bits, size = scorer.entropies(batch.column("__text").to_pylist())
                best, none = all_bits.argmin(axis=1), size == 0
                score = np.where(none, 0.0, posterior(all_bits, shared.value.temperature).max(axis=1))
                bits = np.where(none, 0.0, all_bits.min(axis=1))
                rejected = none | (bits > shared.value.bound)
                best = np.where(none, len(names) - 1, best)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(names[best].tolist(), pa.string()), pa.array(score), pa.array(bits), pa.array(rejected)], [*keep, *added])

    kinds = dict(docs.dtypes)
    schema = "".join(f"`{c}` {kinds[c]}, " for c in keep) + "lang_pred string, score double, bits double, rejected boolean"
    return map_arrow(docs.select(*keep, docs[text].alias("__text")), run, schema)
