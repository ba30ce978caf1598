"""Chat formatting by columnar byte assembly.

Turns of many conversations are laid out at once: the lengths of all segments
(marks, roles, texts) give offsets by a cumulative sum, the offsets give for each
byte of the output its place in a pool of marks and contents, and one gather
copies them into a buffer that becomes an Arrow column as it is.

A control string inside a text gets a backslash after its first character, and a
backslash is doubled, so marks in the output are the template's own and reading
back restores every text.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from covenant.llm.common import grouped, map_arrow


@dataclass(frozen=True)
class Template:
    """Marks around a turn: ``turn role text_mark text end``. ``others`` are
    control strings of further models, which texts must not smuggle in."""

    turn: str = "<|turn|>"
    text: str = "<|text|>"
    end: str = "<|end|>"
    others: tuple[str, ...] = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|endoftext|>")
    learned: str = "assistant"

    def __post_init__(self) -> None:
        if any(len(x) < 2 or "\\" in x for x in self.controls()):
            raise ValueError("control strings have two characters or more and no backslash")

    def controls(self) -> tuple[str, ...]:
        return (self.turn, self.text, self.end, *self.others)

    def pattern(self) -> re.Pattern[str]:
        return re.compile("|".join([r"\\", *(f"{re.escape(x[0])}(?={re.escape(x[1:])})" for x in self.controls())]))


def escaped(text: str, pattern: re.Pattern[str]) -> str:
    return pattern.sub(lambda m: m[0] + "\\", text)


def unescaped(text: str, template: Template) -> str:
    return re.sub(r"(?s)(.)\\", lambda m: m[1], text) if "\\" in text else text


def assemble(roles: list[str], texts: list[str], starts: np.ndarray, template: Template) -> tuple[pa.Array, list[list[dict[str, int]]]]:
    """Conversations whose turns begin at ``starts``: their formatted texts, and
    the code points that the loss covers."""
    pattern = template.pattern()
    turns = len(roles)
    marks = [template.turn.encode(), template.text.encode(), template.end.encode()]
    names = [escaped(x, pattern).encode() for x in roles]
    bodies = [escaped(x, pattern).encode() for x in texts]
    pool = np.frombuffer(b"".join([*marks, *names, *bodies]), np.uint8)
    sizes = np.fromiter(map(len, [*marks, *names, *bodies]), np.int64)
    places = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    row = np.arange(turns)
    order = np.stack([np.zeros_like(row), 3 + row, np.ones_like(row), 3 + turns + row, np.full_like(row, 2)], axis=1).ravel()
    length = sizes[order]
    offset = np.concatenate([[0], np.cumsum(length)])
    gather = np.repeat(places[order] - offset[:-1], length) + np.arange(offset[-1])
    out = pool[gather] if len(gather) else np.zeros(0, np.uint8)
    begins = offset[5 * np.concatenate([starts, [turns]])]
    column = pa.StringArray.from_buffers(len(starts), pa.py_buffer(begins.astype(np.int32).tobytes()), pa.py_buffer(out.tobytes()))
    points = np.concatenate([[0], np.cumsum((out & 0xC0) != 0x80, dtype=np.int64)])
    spans: list[list[dict[str, int]]] = [[] for _ in starts]
    owner = np.searchsorted(starts, row, side="right") - 1
    for i in np.flatnonzero([x == template.learned for x in roles]):
        first = points[begins[owner[i]]]
        spans[owner[i]].append({"from": int(points[offset[5 * i + 3]] - first), "to": int(points[offset[5 * i + 4]] - first)})
    return column, spans


def format_chats(turns: DataFrame, template: Template = Template()) -> DataFrame:
    """``(conv_id, formatted string, loss array<struct<from, to>>)`` of rows
    ``(conv_id, turn, role, text)``, a row per conversation, by turn.

    Null roles and texts count as empty. Rows of equal turn are ordered by role
    and text, and repeated rows stay. Rows without an id make one conversation
    without an id, apart from those of any id. An empty table gives an empty one; other columns are ignored.
    A conversation becomes one text, so its task holds it whole.
    """
    span = pa.list_(pa.struct([("from", pa.int64()), ("to", pa.int64())]))

    def emit(ids: list, roles: list[str], texts: list[str], starts: list[int]) -> pa.RecordBatch:
        column, spans = assemble(roles, texts, np.array(starts, np.int64), template)
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), column, pa.array(spans, span)], ["conv_id", "formatted", "loss"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, roles, texts, starts, held = [], [], [], [], 0
        for group in grouped(batches, "__group"):
            starts.append(len(roles))
            ids.append(group.column("conv_id")[0].as_py())
            roles += group.column("role").to_pylist()
            texts += group.column("text").to_pylist()
            held += group.nbytes
            if held > 4 << 20:
                yield emit(ids, roles, texts, starts)
                ids, roles, texts, starts, held = [], [], [], [], 0
        if ids:
            yield emit(ids, roles, texts, starts)

    whole = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").alias("__turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce(F.col("conv_id").cast("long").cast("string"), F.lit("")).alias("__group"))
    dealt = whole.repartition("__group").sortWithinPartitions("__group", "__turn", "role", "text").select("__group", "conv_id", "role", "text")
    return map_arrow(dealt, run, "conv_id long, formatted string, loss array<struct<from: bigint, to: bigint>>")


def read_turns(formatted: str, template: Template = Template()) -> list[tuple[str, str]]:
    """The (role, text) turns of a formatted conversation."""
    out = []
    for part in formatted.split(template.turn)[1:]:
        role, _, rest = part.partition(template.text)
        text, _, after = rest.partition(template.end)
        if after:
            raise ValueError("something stands between turns")
        out.append((unescaped(role, template), unescaped(text, template)))
    return out


def read_back(chats: DataFrame, template: Template = Template()) -> DataFrame:
    """What the formatted texts hold: ``n_turns, turns_sha256, loss_chars,
    loss_sha256, formatted_chars`` by ``conv_id``, read from the output alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, spans in zip(batch.column("formatted").to_pylist(), batch.column("loss").to_pylist(), strict=True):
                turns = read_turns(text, template)
                lost = "".join(unescaped(text[s["from"] : s["to"]], template) for s in spans)
                told = "".join(f"{role}\n{said}\n" for role, said in turns)
                rows.append((len(turns), hashlib.sha256(told.encode()).hexdigest(), len(lost), hashlib.sha256(lost.encode()).hexdigest(), len(text)))
            columns = list(zip(*rows, strict=True)) or [()] * 5
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            names = ["n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
            yield pa.RecordBatch.from_arrays([batch.column("conv_id"), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], ["conv_id", *names])

    return map_arrow(chats.select("conv_id", "formatted", "loss"), run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
