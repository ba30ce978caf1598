"""Toxicity by a learned lexicon, matched with spelling errors, read in context.

1. A lexicon is learned from labelled training rows: words, and stems (first
   letters that many words share), that toxic texts hold far more often, by their
   length in words, than others. Repeats within a row count less and less.
2. The lexicon is a trie. A Levenshtein automaton for each of its terms is run
   along that trie all at once: a state is the set of (trie node, edits so far)
   that the letters read can stand for, and states are made when first met. A
   word is out once its set is empty, mostly after a few letters.
3. Each hit is looked at in a window of characters around it: within quotation
   marks, or next to a word of reporting, it is likely mention and not abuse. Words
   of reporting are learned: those that stand before hits in clean training rows
   and hardly in toxic ones, beside a few given to start with.
4. How dense a term is in a text is told by chance: how likely as many hits, at the
   rate that clean training rows have, are in a text of as many words. One hit in a
   short text may say more than three in a long one.
5. For every (term, edits, density, mention or not), the smoothed share of toxic texts
   among training rows is its weight; a text's score joins the weights of its hits as
   independent causes.

Learning reads at most about ``max_rows`` training rows of either label (chosen by a
hash of the id, so that the choice does not depend on order), which bounds what
the driver holds; every term that tells among them is taken, and all else covers
every row.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator, Set

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from covenant.llm.common import fold, map_arrow, materialize

WORD = re.compile(r"[^\W\d_]+")
STEM_CHARS = (4, 5, 6, 7)
#: Characters looked at before and behind a hit.
WINDOW = 60
QUOTES = {'"': '"', "“": "”", "„": "“”", "«": "»", "‘": "’", "‹": "›"}
#: Words of reporting known before any are learned.
REPORTING = frozenset("word words term called quote quoted quotes said says saying slur wort sagte nannte begriff zitat mot terme dit appelé cité palabra término dijo llamó cita".split())
#: What a mention counts where training rows show nothing of it.
MENTION = 0.3
#: Least surprise (a chi-square of one degree) of a term, above what the number of terms calls for.
SURPRISE = 2.0
#: Toxic rows that hold a term at least, and how much denser it is there at least.
LEAST_ROWS, DENSER = 4, 4.0
#: A text holds a term more densely by one level for each of these chances, one in
#: ten to this power, that its hits stay below.
LEVELS = (1, 3, 6, 10)
#: What the lowest level counts where training rows show nothing of it.
LOWEST = 0.3
#: Clean rows in which a word must stand before a hit to be one of reporting.
LEAST_REPORTS = 4
CACHE_WORDS = 300_000


def edits(term: str) -> int:
    """Edits allowed in a term: none in the shortest, two in long ones."""
    return 0 if len(term) < 4 else 1 if len(term) < 9 else 2


class Lexicon:
    """A trie of terms and the automaton of all their misspellings.

    Terms are (text, is a stem). `find` gives the terms within the allowed edits
    of a word that are nearest to it; a stem is compared with the word's
    beginning.
    """

    def __init__(self, terms: Iterable[tuple[str, bool]]):
        self.terms = list(terms)
        self.children: list[dict[str, int]] = [{}]
        self.ends: list[list[int]] = [[]]
        self.budget = [0]
        for k, (term, _) in enumerate(self.terms):
            node = 0
            for c in term:
                self.budget[node] = max(self.budget[node], edits(term))
                if c not in self.children[node]:
                    self.children[node][c] = len(self.children)
                    self.children.append({})
                    self.ends.append([])
                    self.budget.append(0)
                node = self.children[node][c]
            self.budget[node] = max(self.budget[node], edits(term))
            self.ends[node].append(k)
        self.forget()

    def forget(self) -> None:
        self.sets: list[tuple[tuple[int, int], ...]] = []
        self.numbers: dict[tuple[tuple[int, int], ...], int] = {}
        self.steps: list[dict[str, int]] = []
        self.stems: list[tuple[tuple[int, int], ...]] = []
        self.words: list[tuple[tuple[int, int], ...]] = []
        self.state({0: 0})

    def state(self, reached: dict[int, int]) -> int:
        """The number of a set of nodes with their edits, missing letters included."""
        queue = list(reached.items())
        while queue:
            node, e = queue.pop()
            if e < self.budget[node]:
                for child in self.children[node].values():
                    if e + 1 <= self.budget[child] and reached.get(child, 9) > e + 1:
                        reached[child] = e + 1
                        queue.append((child, e + 1))
        key = tuple(sorted(reached.items()))
        if key not in self.numbers:
            self.numbers[key] = len(self.sets)
            self.sets.append(key)
            self.steps.append({})
            ended = [(k, e) for node, e in key for k in self.ends[node] if e <= edits(self.terms[k][0])]
            self.stems.append(tuple(x for x in ended if self.terms[x[0]][1]))
            self.words.append(tuple(x for x in ended if not self.terms[x[0]][1]))
        return self.numbers[key]

    def step(self, number: int, c: str) -> int:
        reached: dict[int, int] = {}
        for node, e in self.sets[number]:
            for letter, child in self.children[node].items():
                cost = e + (letter != c)
                if cost <= self.budget[child] and reached.get(child, 9) > cost:
                    reached[child] = cost
            if e + 1 <= self.budget[node] and reached.get(node, 9) > e + 1:
                reached[node] = e + 1
        found = self.steps[number][c] = self.state(reached) if reached else -1
        return found

    def find(self, word: str) -> dict[int, int]:
        if len(self.sets) > CACHE_WORDS:
            self.forget()
        got: dict[int, int] = {}
        at = 0
        for c in word:
            after = self.steps[at].get(c)
            at = self.step(at, c) if after is None else after
            if at < 0:
                break
            for k, e in self.stems[at]:
                got[k] = min(e, got.get(k, 9))
        for k, e in self.words[at] if at >= 0 else ():
            got[k] = min(e, got.get(k, 9))
        least = min(got.values(), default=0)
        return {k: e for k, e in got.items() if e == least}


def words_before(text: str, start: int) -> list[str]:
    """The last words of the line, within the window, before ``start``."""
    return WORD.findall(text[max(0, start - WINDOW) : start].rpartition("\n")[2].lower())[-3:]


def mention(text: str, start: int, end: int, reporting: Set[str] = REPORTING) -> bool:
    """Whether what stands at ``start:end`` is quoted or reported."""
    before, after = text[max(0, start - WINDOW) : start].rpartition("\n")[2], text[end : end + WINDOW].partition("\n")[0]
    for opening, closing in QUOTES.items():
        if opening in closing:
            if before.count(opening) % 2 and opening in after:
                return True
        elif (at := before.rfind(opening)) >= 0 and not any(c in before[at + 1 :] for c in closing) and any(c in after for c in closing):
            return True
    return any(w in reporting for w in words_before(text, start))


class Reader:
    """Finds the lexicon's hits in texts, and remembers words it has seen."""

    def __init__(self, terms: Iterable[tuple[str, bool]], reporting: Set[str] = REPORTING):
        self.lexicon, self.reporting = Lexicon(terms), reporting
        self.seen: dict[str, dict[int, int] | None] = {}

    def hits(self, text: str | None) -> list[tuple[int, int, int, int, bool]]:
        """(term, edits, start, end, mention) of each hit in a whole text."""
        return self.read(text)[0]

    def read(self, text: str | None) -> tuple[list[tuple[int, int, int, int, bool]], int]:
        """The hits in a whole text, and its number of words."""
        if not text:
            return [], 0
        low = text.lower()
        if len(low) != len(text):  # a letter whose lower case is longer: keep places right
            low = "".join(x if len(x := c.lower()) == 1 else c for c in text)
        seen, found = self.seen, {}
        words = WORD.findall(low)
        for w in set(words):
            try:
                got = seen[w]
            except KeyError:
                if len(seen) >= CACHE_WORDS:
                    seen.clear()
                got = seen[w] = self.lexicon.find(w) or None
            if got is not None:
                found[w] = got
        if not found:
            return [], len(words)
        out = []
        for m in WORD.finditer(low):
            for k, e in found.get(m[0], {}).items():
                out.append((k, e, m.start(), m.end(), mention(low, m.start(), m.end(), self.reporting)))
        return out, len(words)


def level(count: int, expected: float) -> int:
    """How many of `LEVELS` the chance of ``count`` hits or more stays below, where
    a Poisson law lets ``expected`` (above 0) be expected."""
    if count <= expected:
        return 0
    part = total = 1.0  # the tail's terms by its first
    i = count
    while part > 1e-12 * total:
        i += 1
        part *= expected / i
        total += part
    power = (expected - count * math.log(expected) + math.lgamma(count + 1) - math.log(total)) / math.log(10)
    return sum(power >= x for x in LEVELS)


def evidence(hits: list[tuple[int, int, int, int, bool]], words: int, rates: dict[tuple[int, int], float]) -> set[tuple[int, int, int, bool]]:
    """(term, edits, level, mention) of a text with so many words; who reaches a
    level has those below it too."""
    counts = Counter((k, e, quoted) for k, e, _, _, quoted in hits)
    return {(k, e, n, quoted) for (k, e, quoted), c in counts.items() for n in range(level(c, rates[k, e] * words) + 1)}


class Model:
    """Terms, the weights of what they show, the score of a text without hits, the
    words of reporting, and how many hits of each (term, edits) a word of a clean
    text brings."""

    def __init__(self, terms: list[tuple[str, bool]], weights: dict[tuple[int, int, int, bool], float], base: float, reporting: Set[str] = REPORTING, rates: dict[tuple[int, int], float] | None = None):
        self.terms, self.weights, self.base, self.reporting, self.rates = terms, weights, base, reporting, rates or {}

    def score(self, hits: list[tuple[int, int, int, int, bool]], words: int) -> float:
        best: dict[tuple[int, bool], float] = defaultdict(float)
        for k, e, n, quoted in evidence(hits, words, self.rates):
            best[k, quoted] = max(best[k, quoted], self.weights.get((k, e, n, quoted), 0.0))
        clean = 1 - self.base
        for w in best.values():
            clean *= 1 - w
        return 1 - clean


def least_pair(text: str | None) -> int:
    """The least hash of a text's pairs of words, which near copies mostly share."""
    words = (text or "").lower().split()
    return min((xxhash.xxh64_intdigest(f"{a} {b}") >> 1 for a, b in zip(words, words[1:], strict=False)), default=xxhash.xxh64_intdigest(" ".join(words)) >> 1)


def sample(docs: DataFrame, labels: DataFrame, text: str, key: str, label: str, parts: int, left_out: int, max_rows: int) -> tuple[DataFrame, dict[int, float]]:
    """``(text, toxic, words)`` of training rows, at most about ``max_rows`` of either
    label, and for each label how many rows one of them stands for."""
    rows = labels.select(F.col(key).alias("__key"), F.col(label).cast("int").alias("toxic")).where(F.col("toxic").isin(0, 1) & F.col("__key").isNotNull() & (fold(F.col(key), parts) != left_out))
    counts = {r.toxic: r.n for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}  # two rows at most
    share = {k: min(1.0, max_rows / n) for k, n in counts.items()}
    chance = F.pmod(F.xxhash64(F.lit("toxicity"), "__key"), F.lit(1 << 30)) / float(1 << 30)
    chosen = rows.where(chance < F.when(F.col("toxic") == 1, F.lit(share.get(1, 1.0))).otherwise(F.lit(share.get(0, 1.0))))
    # at most about 2 * max_rows ids: small enough to send
    got = docs.select(F.col(key).alias("__key"), F.col(text).alias("text")).join(F.broadcast(chosen), "__key").select("__key", "text", "toxic")

    def alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            group = pa.array([least_pair(x) for x in batch.column("text").to_pylist()], pa.int64())
            words = pa.array([len(WORD.findall((x or "").lower())) for x in batch.column("text").to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("__key").cast(pa.int64()), batch.column("text"), batch.column("toxic"), group, words], ["key", "text", "toxic", "group", "words"])

    # copies of a text are one witness: else words that only they hold would seem to tell
    one = map_arrow(got.withColumn("__key", F.xxhash64("__key")), alike, "key long, text string, toxic int, group long, words long").groupBy("toxic", "group").agg(F.min_by(F.struct("text", "words"), "key").alias("one"))
    return materialize(one.select("one.text", "toxic", "one.words"), "toxic-sample"), {k: 1 / s for k, s in share.items()}


def learn(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", label: str = "toxic", parts: int = 3, left_out: int = 1, max_rows: int = 10_000) -> Model:
    """Learn a model from rows whose fold is not ``left_out``.

    Rows without text, id or a label of 0 or 1 teach nothing; without any
    training rows of both labels the model has no terms and a base of 0.
    """
    rows, stands = sample(docs, labels, text, key, label, parts, left_out, max_rows)
    of = {r.toxic: r for r in rows.groupBy("toxic").agg(F.count("*").alias("n"), F.sum("words").alias("words")).collect()}  # two rows at most
    if not all(x in of and of[x].words for x in (0, 1)):
        return Model([], {}, 0.0)
    sizes = {x: of[x].n for x in of}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: dict[tuple[str, bool], list[float]] = defaultdict(lambda: [0, 0, 0.0, 0.0])
            for x, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
                held: Counter = Counter()
                for w, n in Counter(WORD.findall((x or "").lower())).items():
                    if len(w) >= STEM_CHARS[0]:
                        held[w, False] += n
                    held.update({(w[:c], True): n for c in STEM_CHARS if len(w) > c})
                for k, n in held.items():
                    seen[k][toxic] += 1
                    seen[k][2 + toxic] += math.log2(1 + n)
            keys, cells = list(seen), list(zip(*seen.values(), strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.bool_()), *(pa.array(c, kind) for c, kind in zip(cells, (pa.int64(), pa.int64(), pa.float64(), pa.float64()), strict=True))], ["term", "stem", "clean", "toxic", "clean_mass", "toxic_mass"])

    counted = map_arrow(rows.select("text", "toxic"), count, "term string, stem boolean, clean long, toxic long, clean_mass double, toxic_mass double").groupBy("term", "stem").agg(*(F.sum(c).alias(c) for c in ("clean", "toxic", "clean_mass", "toxic_mass")))
    frequent = materialize(counted.where(F.col("toxic") >= LEAST_ROWS), "toxic-terms")
    denser = (F.col("toxic_mass") / of[1].words) / ((F.col("clean_mass") + 1) / of[0].words)
    # repeats in a row are not independent: masses count as many as rows are toxic
    good = F.col("clean_mass") * F.col("toxic") / F.col("toxic_mass")
    # twice the log-likelihood ratio against equal density: chance finds among millions of terms stay below
    both, part = F.col("toxic") + good, of[1].words / (of[0].words + of[1].words)
    surprise = 2 * (F.col("toxic") * F.log(F.col("toxic") / (both * part)) + F.when(good > 0, good * F.log(good / (both * (1 - part)))).otherwise(0.0))
    # chance in one of as many terms; no more than the bounded sample has
    found = frequent.where((denser >= DENSER) & (surprise >= 2 * math.log(frequent.count() + 1) + SURPRISE)).select("term", "stem", "toxic").collect()
    terms = choose([(r.term, r.stem, r.toxic) for r in found])
    reporting, clean_hits = around_hits(rows, terms, sizes)
    rates = {(k, e): (clean_hits.get((k, e), 0) + 0.5) / of[0].words for k in range(len(terms)) for e in range(edits(terms[k][0]) + 1)}

    def observe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(terms, reporting)
        seen: Counter = Counter()
        for batch in batches:
            for x, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
                shown = evidence(*reader.read(x), rates)
                seen.update((*s, toxic) for s in shown)
                seen[-1, 0, 0, False, toxic] += not shown
        keys = list(seen)
        yield pa.RecordBatch.from_pydict({"term": pa.array([k[0] for k in keys], pa.int64()), "edits": pa.array([k[1] for k in keys], pa.int64()), "level": pa.array([k[2] for k in keys], pa.int64()), "quoted": pa.array([k[3] for k in keys], pa.bool_()), "toxic": pa.array([k[4] for k in keys], pa.int64()), "n": pa.array([seen[k] for k in keys], pa.int64())})

    # rows: terms x edits x levels x two
    table = map_arrow(rows.select("text", "toxic"), observe, "term long, edits long, level long, quoted boolean, toxic long, n long").groupBy("term", "edits", "level", "quoted").agg(
        F.sum(F.col("n") * F.col("toxic")).alias("bad"), F.sum(F.col("n") * (1 - F.col("toxic"))).alias("good")).collect()
    shown = {(r.term, r.edits, r.level, r.quoted): (r.bad * stands[1], r.good * stands[0]) for r in table}
    bad, good = shown.pop((-1, 0, 0, False), (0.0, 0.0))
    weights = {}
    for k in range(len(terms)):
        for e in range(edits(terms[k][0]) + 1):
            for n in range(len(LEVELS) + 1):
                # what chance brings says little, and a misspelled stem too little by
                # itself: training rows must show it; denser is at first worth as much
                prior = LOWEST if n == 0 else max(w, prior) if n > 1 else 0.9 if e == 0 else 0.5 if terms[k][1] else 0.8
                b, g = shown.get((k, e, n, False), (0.0, 0.0))
                # only clear evidence counts
                w = (b + 2 * prior) / (b + g + 2)
                if w >= 0.6:
                    weights[k, e, n, False] = min(w, 0.99)
                    b, g = shown.get((k, e, n, True), (0.0, 0.0))
                    weights[k, e, n, True] = min((b + 2 * MENTION) / (b + g + 2), w)
    return Model(terms, weights, min(0.5, bad / (bad + good + 1)), reporting, rates)


def around_hits(rows: DataFrame, terms: list[tuple[str, bool]], sizes: dict[int, int]) -> tuple[frozenset[str], dict[tuple[int, int], int]]:
    """Words of reporting, and hits of each (term, edits) in clean rows.

    Words of reporting stand shortly before hits in at least ``LEAST_REPORTS`` clean
    rows and, by the shares of either label, in toxic rows hardly ever. ``rows`` is
    the bounded sample, so what is sent back is bounded by it."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(terms)
        seen: Counter = Counter()
        for batch in batches:
            for x, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
                hits = reader.hits(x)
                seen.update({(w, -1, 0, toxic) for _, _, start, _, _ in hits for w in words_before(x, start)})
                seen.update((None, k, e, toxic) for k, e, _, _, _ in hits)
        keys = list(seen)
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), *(pa.array([k[i] for k in keys], pa.int64()) for i in (1, 2, 3)), pa.array([seen[k] for k in keys], pa.int64())], ["word", "term", "edits", "toxic", "n"])

    counted = map_arrow(rows.select("text", "toxic"), count, "word string, term long, edits long, toxic long, n long").groupBy("word", "term", "edits").agg(F.sum(F.col("n") * F.col("toxic")).alias("bad"), F.sum(F.col("n") * (1 - F.col("toxic"))).alias("good"))
    share = (F.col("bad") / sizes[1]) / (F.col("bad") / sizes[1] + F.col("good") / sizes[0])
    got = counted.where(F.col("word").isNull() | (F.col("good") >= LEAST_REPORTS) & (share <= 0.1)).collect()
    return REPORTING | {r.word for r in got if r.word is not None}, {(r.term, r.edits): r.good for r in got if r.word is None}


def choose(found: list[tuple[str, bool, int]]) -> list[tuple[str, bool]]:
    """Of words and stems that tell, those that tell most: a stem instead of its
    words if it reaches well beyond each of them, the longest stem of those that
    reach about as far."""
    words = {t: n for t, stem, n in found if not stem}
    stems = {t: n for t, stem, n in found if stem}
    of_words, of_stems = sorted(words), sorted(stems)
    kept: dict[str, int] = {}

    def under(ordered: list[str], start: str) -> list[str]:
        return ordered[bisect_left(ordered, start) : bisect_left(ordered, start + chr(0x10FFFF))]

    def has_stem(term: str) -> bool:
        return any(term[:c] in kept for c in STEM_CHARS)

    for t in sorted(of_stems, key=len):
        covered = max((words[w] for w in under(of_words, t)), default=0)
        if stems[t] < 1.5 * covered or has_stem(t):
            continue
        best = max((x for x in under(of_stems, t) if stems[x] >= 0.98 * stems[t]), key=lambda x: (len(x), stems[x]))
        kept[best] = stems[best]
    both = [(n, t, True) for t, n in kept.items()] + [(n, w, False) for w, n in words.items() if not has_stem(w)]
    return [(t, stem) for n, t, stem in sorted(both, key=lambda x: (-x[0], x[1]))]


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with ``score double`` and ``hits array<struct<term, word_start,
    word_end, edits, mention>>``, of every whole text.

    Null and empty texts have no hits and the score of a text without any. Rows
    are scored one by one, so repeated rows get the same score; other columns
    are passed on (one named score or hits is replaced); an empty table gives an
    empty one.
    """
    keep = [c for c in docs.columns if c not in ("score", "hits")]
    kinds = dict(docs.dtypes)
    terms, reporting = model.terms, model.reporting

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(terms, reporting)
        kind = pa.list_(pa.struct([("term", pa.string()), ("word_start", pa.int64()), ("word_end", pa.int64()), ("edits", pa.int64()), ("mention", pa.bool_())]))
        for batch in batches:
            found, words = zip(*(reader.read(x) for x in batch.column("__text").to_pylist()), strict=True) if batch.num_rows else ((), ())
            scores = pa.array([model.score(h, n) for h, n in zip(found, words, strict=True)], pa.float64())
            told = pa.array([[{"term": terms[k][0], "word_start": a, "word_end": b, "edits": e, "mention": q} for k, e, a, b, q in h] for h in found], kind)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), scores, told], [*keep, "score", "hits"])

    schema = ", ".join(f"`{c}` {kinds[c]}" for c in keep) + ", score double, hits array<struct<term: string, word_start: bigint, word_end: bigint, edits: bigint, mention: boolean>>"
    return map_arrow(docs.select(*keep, docs[text].alias("__text")), run, schema)
