"""Byte-level BPE encoding and decoding as a monoid tree reduction.

A text is cut in halves down to leaves; each leaf is encoded on its own, and
neighbours are joined by encoding a window around the seam anew. The window
grows until everything outside of it provably stays as it is, so the result is
that of encoding the whole text at once. There are three levels of this:

* text to words. A piece begins wherever white space follows another character,
  whatever stands around. The window grows on either side of the seam to such a
  place; tokens outside of it stay (`Bpe.mend`). A text without such places goes
  by the next level.
* text to pieces. A piece is a match of the split pattern, which never looks
  back. Left of a seam a match is final if it ends three characters before the
  seam (the pattern's longest look-ahead). Right of it all matches are final
  from the first place where the new matches end at an old boundary.
* piece to tokens. A token sequence is the encoding of its bytes if each pair of
  neighbours is what the pair's own bytes encode to; inside both halves that
  holds already, so only the ends of the window need a look.

Decoding concatenates token bytes up the same kind of tree; bytes need no
mending at a seam.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import re
from bisect import bisect_left
from collections.abc import Iterator, Sequence
from itertools import chain
from pathlib import Path

import pyarrow as pa
import regex
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame, SparkSession

from covenant.llm.common import KEPT, map_arrow

#: Characters of a text, and bytes of a piece, up to which a leaf is encoded directly.
TEXT_LEAF, PIECE_LEAF = 1024, 256
#: The pattern never looks further ahead than this from where a match begins.
LOOK_AHEAD = 3
#: Words whose tokens a task remembers before it begins anew.
CACHE_WORDS = 500_000
SINGLE = [bytes([i]) for i in range(256)]
#: A vocabulary is sent to every executor, so its size is checked.
MAX_VOCABULARY_BYTES = 64 << 20


def read_ranks(path: str) -> dict[bytes, int]:
    """The ranks in a file of lines "base64 rank"."""
    data = Path(path).read_bytes()
    if len(data) > MAX_VOCABULARY_BYTES:
        raise ValueError(f"{path} holds {len(data)} bytes, more than {MAX_VOCABULARY_BYTES}")
    return {base64.b64decode(a): int(b) for a, b in (x.split() for x in data.splitlines() if x)}


class Words(dict):
    """Tokens of stretches: a space, and what follows it up to another space."""

    def __init__(self, coder: Bpe):
        self.coder = coder

    def __missing__(self, word: str) -> tuple[int, ...]:
        ids = tuple(self.coder.region(" " + word))
        if len(word) <= 64:
            if len(self) >= CACHE_WORDS:
                self.clear()
            self[word] = ids
        return ids


class Bpe:
    """Encodes and decodes with one vocabulary. Not shared between threads."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.bytes_of = {v: k for k, v in ranks.items()}
        self.pattern = regex.compile(pattern)
        self.none = max(ranks.values(), default=0) + 1
        self.longest = max(map(len, ranks), default=0)
        self.fits: dict[tuple[int, int], bool] = {}
        self.sizes = [0] * self.none
        for token, rank in ranks.items():
            self.sizes[rank] = len(token)
        self.words = Words(self)
        self.odd = re.compile(r"\s ")
        self.word_start = re.compile(r"(?<=\S)(?= )")
        self.joins = 0

    # -- tokens of one piece ------------------------------------------------

    def merge(self, piece: bytes) -> list[int]:
        """Tokens of ``piece`` by merging the pair of least rank, leftmost first."""
        ranks = self.ranks
        if len(piece) <= 64:
            parts, none = [*map(SINGLE.__getitem__, piece)], self.none
            pairs = [ranks.get(piece[i : i + 2], none) for i in range(len(piece) - 1)]
            while pairs and (best := min(pairs)) < none:
                i = pairs.index(best)
                joined = parts[i] = parts[i] + parts[i + 1]
                del parts[i + 1], pairs[i]
                if i:
                    pairs[i - 1] = ranks.get(parts[i - 1] + joined, none)
                if i < len(pairs):
                    pairs[i] = ranks.get(joined + parts[i + 1], none)
            return [ranks[x] for x in parts]
        parts = [piece[i : i + 1] for i in range(len(piece))]
        after = list(range(1, len(parts) + 1))
        before = list(range(-1, len(parts) - 1))
        heap = [(r, i, 2) for i in range(len(parts) - 1) if (r := ranks.get(parts[i] + parts[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, size = heapq.heappop(heap)
            j = after[i] if parts[i] else len(parts)
            if j >= len(parts) or len(parts[i]) + len(parts[j]) != size:
                continue
            parts[i] += parts[j]
            parts[j] = b""
            after[i] = after[j]
            if after[i] < len(parts):
                before[after[i]] = i
            for k in (before[i], i):
                if k >= 0 and after[k] < len(parts) and (r := ranks.get(x := parts[k] + parts[after[k]])) is not None:
                    heapq.heappush(heap, (r, k, len(x)))
        return [ranks[x] for x in parts if x]

    def stable(self, a: int, b: int) -> bool:
        """Whether tokens ``a`` and ``b`` stay apart as neighbours."""
        known = self.fits.get((a, b))
        if known is None:
            if len(self.fits) > CACHE_WORDS:
                self.fits.clear()
            known = self.fits[a, b] = self.merge(self.bytes_of[a] + self.bytes_of[b]) == [a, b]
        return known

    def join(self, left: list[int], right: list[int]) -> list[int]:
        """The encoding of the bytes of ``left`` and then of ``right``."""
        if not left or not right:
            return left + right
        n = 0
        while True:
            i, j = max(0, len(left) - n), min(n, len(right))
            middle = self.merge(b"".join(self.bytes_of[x] for x in left[i:] + right[:j]))
            row = left[i - 1 : i] * (i > 0) + middle + right[j : j + 1]
            if (i == 0 or len(row) < 2 or self.stable(row[0], row[1])) and (j == len(right) or len(row) < 2 or self.stable(row[-2], row[-1])):
                return left[:i] + middle + right[j:]
            n = max(1, 2 * n)

    def tokens(self, piece: bytes) -> list[int]:
        """Tokens of a piece; a piece that is a token itself is that token."""
        if (whole := self.ranks.get(piece)) is not None:
            return [whole]
        return self._tokens(piece)

    def _tokens(self, piece: bytes) -> list[int]:
        if len(piece) <= max(PIECE_LEAF, self.longest):
            return self.merge(piece)
        half = len(piece) // 2
        return self.join(self._tokens(piece[:half]), self._tokens(piece[half:]))

    # -- pieces of one text -------------------------------------------------

    def cuts(self, text: str, lo: int, hi: int) -> list[int]:
        """Ends of the pieces of ``text[lo:hi]``, taken as a text of its own."""
        if hi - lo <= TEXT_LEAF:
            return [m.end() for m in self.pattern.finditer(text, lo, hi)]
        half = (lo + hi) // 2
        left, right = self.cuts(text, lo, half), self.cuts(text, half, hi)
        keep = bisect_left(left, half - LOOK_AHEAD + 1)
        ends, start = left[:keep], left[keep - 1] if keep else lo
        old = 0
        for m in self.pattern.finditer(text, start, hi):
            ends.append(m.end())
            while old < len(right) and right[old] < m.end():
                old += 1
            if m.end() == half or old < len(right) and right[old] == m.end():
                return ends + right[old + (m.end() != half) :]
        return ends

    # -- whole texts --------------------------------------------------------

    def region(self, text: str) -> list[int]:
        """Tokens of a stretch of text by the tree over its pieces."""
        got: list[int] = []
        at = 0
        for end in self.cuts(text, 0, len(text)):
            known = self.words.get(text[at + 1 : end]) if text[at] == " " else None
            got += self.tokens(text[at:end].encode("utf-8")) if known is None else known
            at = end
        return got

    def leaf(self, text: str) -> list[int]:
        """Tokens of a leaf, whose words' tokens are remembered.

        A word is what stands from one space after another character to the next
        such; where no space follows white space, these are all spaces.
        """
        if self.odd.search(text) is None:
            lead, *words = text.split(" ")
        else:
            lead, *words = self.word_start.split(text)
            words = [x[1:] for x in words]
        return [*(self.region(lead) if lead else ()), *chain.from_iterable(map(self.words.__getitem__, words))]

    def mend(self, text: str, lo: int, half: int, hi: int, left: list[int], right: list[int]) -> list[int]:
        """Tokens of ``text[lo:hi]`` from those of its halves.

        A space after another character within the left half begins a piece in
        the half and in the whole, and so does one within the right half: tokens
        before the first and after the second stay, what is between is encoded.
        """
        self.joins += 1
        i, j = half, half
        while (i := text.rfind(" ", lo + 1, i)) >= 0 and text[i - 1].isspace():
            pass
        while (j := text.find(" ", j + 1, hi)) >= 0 and text[j - 1].isspace():
            pass
        if i < 0 and j < 0:
            return self.region(text[lo:hi])
        i, j = lo if i < 0 else i, hi if j < 0 else j
        keep, skip = len(left), 0
        gone = len(text[i:half].encode("utf-8"))
        while gone > 0:
            keep -= 1
            gone -= self.sizes[left[keep]]
        gone = len(text[half:j].encode("utf-8"))
        while gone > 0:
            gone -= self.sizes[right[skip]]
            skip += 1
        return left[:keep] + (self.leaf(text[i:j]) if j - i <= TEXT_LEAF else self.region(text[i:j])) + right[skip:]

    def _encode(self, text: str, lo: int, hi: int) -> list[int]:
        if hi - lo <= TEXT_LEAF:
            return self.leaf(text[lo:hi])
        half = (lo + hi) // 2
        return self.mend(text, lo, half, hi, self._encode(text, lo, half), self._encode(text, half, hi))

    def encode(self, text: str | None) -> list[int]:
        """Token ids of a whole text; a null text counts as empty."""
        if not text:
            return []
        if len(text) > TEXT_LEAF and self.word_start.search(text) is None:
            return self.region(text)
        return self._encode(text, 0, len(text))

    def decode(self, ids: Sequence[int]) -> bytes:
        """The bytes of ``ids``, concatenated up a tree of halves."""
        if len(ids) > 65536:
            half = len(ids) // 2
            return self.decode(ids[:half]) + self.decode(ids[half:])
        return b"".join(map(self.bytes_of.__getitem__, ids))


#: Coders of this Python worker: what they remember serves its later tasks too.
CODERS: dict[tuple[str, int, str], Bpe] = {}
KEPT.append(CODERS)


def coder_of(path: str, ranks: dict[bytes, int], pattern: str) -> Bpe:
    key = (path, len(ranks), pattern)
    if key not in CODERS:
        CODERS.clear()
        CODERS[key] = Bpe(ranks, pattern)
    return CODERS[key]


def broadcast_ranks(spark: SparkSession, path: str) -> Broadcast:
    """The vocabulary, sent once; `read_ranks` bounds its size."""
    return spark.sparkContext.broadcast(read_ranks(path))


def encode(df: DataFrame, path: str, pattern: str, text: str = "text", keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """``keep`` columns and ``ids array<int>`` of every row's whole text.

    Rows are neither joined nor shuffled, so nulls, ties and repeated rows need
    no rule: each row gives one row. Null and empty texts have no ids; an empty
    table gives an empty one. Only ``keep`` and ``text`` are read, so further
    columns of any name do no harm.
    """
    shared = broadcast_ranks(df.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = coder_of(path, shared.value, pattern)
        for batch in batches:
            ids = pa.array([coder.encode(x) for x in batch.column("__text").to_pylist()], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), ids], [*keep, "ids"])

    picked = df.select(*keep, df[text].alias("__text"))
    return map_arrow(picked, run, ", ".join(f"`{c}` {kind}" for c, kind in df.select(*keep).dtypes) + ", ids array<int>", keeps=True)


def decode(df: DataFrame, path: str, ids: str = "ids", keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """``keep`` columns and ``bytes binary``, what ``ids`` stand for.

    Null ids give empty bytes; an id outside of the vocabulary is an error.
    """
    shared = broadcast_ranks(df.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = coder_of(path, shared.value, "")
        for batch in batches:
            out = pa.array([coder.decode(x or ()) for x in batch.column("__ids").to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), out], [*keep, "bytes"])

    picked = df.select(*keep, df[ids].alias("__ids"))
    return map_arrow(picked, run, ", ".join(f"`{c}` {kind}" for c, kind in df.select(*keep).dtypes) + ", bytes binary", keeps=True)


def round_trip(df: DataFrame, path: str, pattern: str, text: str = "text", keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """Encode and decode in one pass and keep digests only: ``n_tokens long,
    ids_sha256 string`` (of the ids joined by spaces) and ``decoded_sha256
    string``. Rows and nulls as in `encode`."""
    shared = broadcast_ranks(df.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = coder_of(path, shared.value, pattern)
        digits = {v: str(v) for v in shared.value.values()}
        for batch in batches:
            counts, told, back = [], [], []
            for x in batch.column("__text").to_pylist():
                ids = coder.encode(x)
                counts.append(len(ids))
                told.append(hashlib.sha256(" ".join(map(digits.__getitem__, ids)).encode()).hexdigest())
                back.append(hashlib.sha256(coder.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(counts, pa.int64()), pa.array(told, pa.string()), pa.array(back, pa.string())], [*keep, "n_tokens", "ids_sha256", "decoded_sha256"])

    picked = df.select(*keep, df[text].alias("__text"))
    return map_arrow(picked, run, ", ".join(f"`{c}` {kind}" for c, kind in df.select(*keep).dtypes) + ", n_tokens long, ids_sha256 string, decoded_sha256 string", keeps=True)
