import collections
import hashlib
import os

import duckdb
from hypothesis import given, settings
from hypothesis import strategies as st

from covenant.llm import chat, queries

T = chat.Template()
SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01")
PIECE = st.one_of(st.text(max_size=6), st.sampled_from([*T.controls(), "\\", "<", "<|", "[", "<<s>>", "[[INST]", "é漢😀"]))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.tuples(st.sampled_from(["user", "assistant", "", "a\\b<|text|>"]), st.lists(PIECE, max_size=6).map("".join)), min_size=1, max_size=5), min_size=1, max_size=5))
def test_reads_back(chats):
    roles = [r for c in chats for r, _ in c]
    texts = [t for c in chats for _, t in c]
    starts = [sum(map(len, chats[:i])) for i in range(len(chats))]
    column, spans = chat.assemble(roles, texts, __import__("numpy").array(starts), T)
    for c, formatted, marked in zip(chats, column.to_pylist(), spans, strict=True):
        assert chat.read_turns(formatted) == c
        assert [chat.unescaped(formatted[s["from"] : s["to"]], T) for s in marked] == [t for r, t in c if r == "assistant"]
        assert formatted.count(T.turn) == formatted.count(T.text) == formatted.count(T.end) == len(c)
        assert not any(x in formatted for x in T.others)


def brute(rows):
    held = collections.defaultdict(list)
    for c, n, r, t in rows:
        held[c].append((n is not None, n, r or "", t or ""))
    hexed = lambda s: hashlib.sha256(s.encode()).hexdigest()
    out = {}
    for c, turns in held.items():
        turns.sort()
        lost = "".join(t for *_, r, t in turns if r == "assistant")
        out[c] = (len(turns), hexed("".join(f"{r}\n{t}\n" for *_, r, t in turns)), len(lost), hexed(lost))
    return out


def test_frame(spark):
    rows = [(1, 1, "assistant", "b</s>"), (1, 0, "user", "a"), (1, 1, "assistant", "b</s>"), (None, 0, None, None), (2, 0, "assistant", "é\\<|end|>" * 50000), (3, 5, "system", "")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, formatted string")
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in chat.read_back(chat.format_chats(df)).collect()}
    assert got == brute(rows)
    assert chat.read_back(chat.format_chats(df.limit(0))).count() == 0


def test_least_id_and_none(spark):
    rows = [(-(1 << 63), 0, "user", "least"), (None, 0, "user", "none"), (-1, 0, "user", "x"), (10, 0, "user", "y"), (2, 0, "user", "z")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in chat.read_back(chat.format_chats(df)).collect()}
    assert got == brute(rows) and len(got) == 5


def test_query_like_sql(spark):
    con = duckdb.connect()
    con.execute(f"create view conversations as select * from '{SF}/conversations.parquet'")
    columns = "conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars"
    want = sorted(con.execute(f"select {columns} from ({queries.ORACLE_SQL['op9_chat']})").fetchall())
    got = sorted(tuple(r) for r in queries.QUERIES["op9_chat"](spark, SF).select(*columns.split(", ")).collect())
    assert got == want and got[0][0] == -1 and got[0][1] == 2
