import collections
import hashlib
import os
import random
import re

import duckdb
import numpy as np

from covenant.llm import line_dedup, queries

WHITE = "".join(map(chr, [0x20, *range(9, 14)]))


def brute(rows, min_chars=40, min_docs=5):
    key = lambda x: "".join(c.lower() if "A" <= c <= "Z" else c for c in x.strip(WHITE))
    held = collections.defaultdict(list)
    for i, t in rows:
        for k in {key(x) for x in (t or "").split("\n")}:
            if len(k) >= min_chars:
                held[k].append(i)
    common = {k: max(set(v) - {None}) for k, v in held.items() if len(set(v) - {None}) >= min_docs}
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if key(x) not in common or i is not None and common[key(x)] == i]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=str)


def test_perfect_hash():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 1000, 50000):
        keys = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64))
        found = line_dedup.PerfectHash.build(keys)
        assert sorted(found.index(keys).tolist()) == list(range(len(keys)))


def test_like_brute_force(spark):
    rng = random.Random(5)
    lines = [w * 9 + " é "[: rng.randint(0, 3)] for w in ("Alpha beta ", "GAMMA\tdelta", "short", "ünï cödé x", "\u0085 odd ends \u0085", "same here ")] + ["", " ", "tiny"]
    rows = [(i, "\n".join(rng.choice(["", " ", "\t\r", "\x0b"]) + rng.choice([str.lower, str.upper, str])(rng.choice(lines)) + rng.choice(["", " ", "\r"]) for _ in range(rng.randint(0, 7)))) for i in range(60)]
    rows += [(3, rows[3][1]), (59, lines[0]), (None, lines[0] + "\n" + lines[1]), (None, None), (70, None), (71, ""), (72, (lines[0] + "\n") * 20000)]
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, doc string, h1 long")
    got = sorted(((r.doc_id, r.n_lines, r.n_dropped, r.kept) for r in line_dedup.deduplicate(df).collect()), key=str)
    assert got == brute(rows)
    assert any(r[2] for r in got)
    assert any(r[0] is None and r[2] for r in got) and any(r[0] is None and not r[2] for r in got)
    assert line_dedup.deduplicate(df.limit(0)).count() == 0


def test_repeated_ids_are_one_document(spark):
    """As the query's SQL has it: five rows of three ids are three documents."""
    line = "a line that is longer than forty characters, at least"
    rows = [(1, line)] * 3 + [(2, line), (3, line)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id, r.n_lines, r.n_dropped) for r in line_dedup.deduplicate(df).collect())
    assert got == [(1, 1, 0)] * 3 + [(2, 1, 0), (3, 1, 0)]
    more = df.unionByName(spark.createDataFrame([(4, line), (5, line)], df.schema))
    assert sorted((r.doc_id, r.n_dropped) for r in line_dedup.deduplicate(more).collect()) == [(1, 1)] * 3 + [(2, 1), (3, 1), (4, 1), (5, 0)]


def test_a_hot_shard_is_copied(spark, monkeypatch):
    """A line that most documents hold: its shard is met by several tasks."""
    lines = ["a line that nearly every document has, word for word", *(f"line number {i} of a document, longer than forty" for i in range(40))]
    rows = [(i, lines[0] + "\n" + lines[1 + i % 40]) for i in range(6000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id, r.n_lines, r.n_dropped, r.kept) for r in line_dedup.deduplicate(df).collect())
    assert got == sorted(brute(rows))


def test_query_like_sql(spark):
    path = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01")
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{path}/documents.parquet'")
    want = sorted(con.execute("select doc_id, n_lines, n_dropped, kept_sha256 from (" + queries.ORACLE_SQL["op4_line_dedup"] + ")").fetchall())
    got = sorted(tuple(r) for r in queries.QUERIES["op4_line_dedup"](spark, path).collect())
    assert got == want and sum(r[2] for r in got) > 0
    docs = [tuple(r) for r in spark.read.parquet(f"{path}/documents.parquet").select("doc_id", "text").collect()]
    assert got == sorted((a, b, c, hashlib.sha256(d.encode()).hexdigest()) for a, b, c, d in brute(docs))
    assert re.match("[0-9a-f]{64}$", got[0][3])
