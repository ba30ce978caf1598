import base64
import hashlib
import random

import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from covenant.llm import bpe, common

PATH = P.path("byte_bpe_50k.tiktoken")
RANKS = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
ORACLE = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=RANKS, special_tokens={})
CODER = bpe.Bpe(RANKS, P.PATTERN)


@settings(max_examples=400, deadline=None)
@given(st.one_of(st.text(), st.text(alphabet=" \n\t 'srelvdm1²aé", max_size=80), st.text(alphabet="ab \n", max_size=300)))
def test_encode_like_tiktoken(text):
    ids = CODER.encode(text)
    assert ids == ORACLE.encode_ordinary(text)
    assert CODER.decode(ids) == text.encode()


def test_joins_like_whole(monkeypatch):
    monkeypatch.setattr(bpe, "TEXT_LEAF", 7)
    monkeypatch.setattr(bpe, "PIECE_LEAF", 4)
    small = bpe.Bpe(RANKS, P.PATTERN)
    small.longest = 0
    rng = random.Random(1)
    for alphabet in ("ab", "a", "abcdefghij", "the quick'll  \n\nbrown", "aé²'  x1", "-=#/ a"):
        for n in (0, 1, 5, 17, 60, 300, 700):
            text = "".join(rng.choice(alphabet) for _ in range(n))
            got = small.region(text)
            assert small.decode(got) == text.encode()
            want = [i for p in small.pattern.findall(text) for i in ([RANKS[p.encode()]] if p.encode() in RANKS else small.merge(p.encode()))]
            assert got == want == ORACLE.encode_ordinary(text)
            assert small.encode(text) == want


@pytest.mark.parametrize("text", ["a" * 30000, "ab" * 9000 + " " * 500 + "x", "=" * 5000 + "\n" * 5000, "word " * 20000])
def test_very_long(text):
    assert CODER.encode(text) == ORACLE.encode_ordinary(text)


def test_frame(spark):
    rows = [(1, "The cat's  hat\n\n", "x"), (1, "The cat's  hat\n\n", "x"), (2, None, "y"), (3, "", None), (None, "é", "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = sorted(map(tuple, bpe.round_trip(df, PATH, P.PATTERN).collect()), key=str)
    hexed = lambda b: hashlib.sha256(b).hexdigest()
    want = []
    for i, t, _ in rows:
        ids = ORACLE.encode_ordinary(t or "")
        want.append((i, len(ids), hexed(" ".join(map(str, ids)).encode()), hexed((t or "").encode())))
    assert got == sorted(want, key=str)
    encoded = bpe.encode(df, PATH, P.PATTERN)
    assert {(r.doc_id, bytes(r.bytes).decode()) for r in bpe.decode(encoded, PATH).collect()} == {(i, t or "") for i, t, _ in rows}
    assert bpe.round_trip(df.limit(0), PATH, P.PATTERN).count() == 0


def test_tree_is_the_path_of_texts():
    """Most documents are joined from leaves, and give what tiktoken gives."""
    import pyarrow.parquet as pq

    texts = pq.read_table("/root/testdata/sf0.01/documents.parquet").column("text").to_pylist()
    long = [x for x in texts if x and len(x) > bpe.TEXT_LEAF]
    coder = bpe.Bpe(RANKS, P.PATTERN)
    assert [coder.encode(x) for x in texts] == [ORACLE.encode_ordinary(x or "") for x in texts]
    assert coder.joins >= len(long) > len(texts) / 3


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=" \n\t 'sa.é1", max_size=120), st.integers(2, 9))
def test_any_cut_mends(text, leaf):
    before, bpe.TEXT_LEAF = bpe.TEXT_LEAF, leaf
    try:
        assert CODER.encode(text) == ORACLE.encode_ordinary(text)
    finally:
        bpe.TEXT_LEAF = before


def test_other_tasks_forget_the_coders():
    """What a worker remembers of words does not stay while it serves other operators."""
    bpe.CODERS[("path", 0, "")] = None
    common.forget()
    assert not bpe.CODERS
