import math

import numpy as np

from covenant.llm import embedding_dedup


def brute(ids, vectors, least=0.9):
    ok = [v is not None and all(x is not None and math.isfinite(x) for x in v) and any(v) for v in vectors]
    rows = np.array([v for v, k in zip(vectors, ok, strict=True) if k], np.float32).astype(float)
    rows /= np.linalg.norm(rows, axis=1, keepdims=True)
    at = [i for i, k in enumerate(ok) if k]
    near = np.concatenate([rows[k : k + 1000] @ rows.T >= least for k in range(0, len(rows), 1000)])
    np.fill_diagonal(near, False)
    links, least_of = {}, {}
    for n, i in enumerate(at):
        links[i] = int(near[n].sum())
    label = np.array([ids[i] for i in at])
    linked = {n: np.flatnonzero(near[n]) for n in np.flatnonzero(near.any(axis=1)).tolist()}
    while True:
        new = label.copy()
        for n, others in linked.items():
            new[n] = min(label[n], label[others].min())
        if (new == label).all():
            break
        label = new
    least_of = {i: int(label[n]) for n, i in enumerate(at)}
    return [(ids[i], links.get(i, 0), least_of.get(i, ids[i]), least_of.get(i, ids[i]) == ids[i]) for i in range(len(ids))]


def test_small(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "BLOCK", 40)
    rng = np.random.default_rng(5)
    vectors = [list(map(float, v)) for v in rng.standard_normal((150, 16))]
    for base in range(5):
        vectors += [[float(x) for x in np.array(vectors[base]) + 0.12 * rng.standard_normal(16)] for _ in range(20 + 60 * (base == 0))]
    vectors += [vectors[3]] * 4 + [[2 * x for x in vectors[3]], None, [0.0] * 16, [float("nan")] + [1.0] * 15, [float("inf")] + [1.0] * 15, [None] + [1.0] * 15, []]
    ids = rng.permutation(len(vectors)).tolist()
    df = spark.createDataFrame([(i, v, i, 1) for i, v in zip(ids, vectors, strict=True)], "vec_id long, embedding array<float>, rep long, copies int")
    got = sorted(tuple(r) for r in embedding_dedup.near_duplicates(df, pivots=64, nearest=8).collect())
    want = sorted(brute(ids, vectors))
    assert sum(r[1] for r in got) >= 0.98 * sum(r[1] for r in want) and all(g[1] <= w[1] for g, w in zip(got, want, strict=True))
    assert [g[2] for g in got] == [w[2] for w in want]
    assert embedding_dedup.near_duplicates(df.limit(0)).count() == 0
    one = embedding_dedup.near_duplicates(spark.createDataFrame([(7, [1.0, 2.0]), (7, [1.0, 2.0])], "vec_id long, embedding array<float>")).collect()
    assert [tuple(r) for r in one] == [(7, 1, 7, True)] * 2


def test_recall(spark):
    """Default parameters, on the table's own vectors and planted neighbours whose
    cosine is just above the threshold."""
    rows = [(r.vec_id, list(r.embedding)) for r in spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select("vec_id", "embedding").collect()]
    rng = np.random.default_rng(11)
    top = max(i for i, _ in rows) + 1
    for n, at in enumerate(rng.permutation(len(rows))[:800].tolist()):
        v = np.array(rows[at][1], float)
        v /= np.linalg.norm(v)
        side = rng.standard_normal(len(v))
        side -= side @ v * v
        cosine = rng.uniform(0.901, 0.93)
        rows.append((top + n, list(map(float, np.float32(cosine * v + (1 - cosine**2) ** 0.5 * side / np.linalg.norm(side))))))
    want = {r[0]: r for r in brute([i for i, _ in rows], [v for _, v in rows])}
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = {r.vec_id: tuple(r) for r in embedding_dedup.near_duplicates(df).collect()}
    links = sum(r[1] for r in want.values())
    assert links >= 1600 and sum(r[1] for r in got.values()) >= 0.9 * links
    assert all(got[i][1] <= want[i][1] for i in want)


def test_repeated_ids_null_ids_and_doubles(spark):
    """Rows are told apart by their vectors, not by their ids; doubles stay doubles."""
    a, b, near_a = [1.0, 0.0, 0.0], [0.0, 1.0, 0.0], [1.0, 0.1, 0.0]
    edge = [0.9, (1 - 0.9**2) ** 0.5 * (1 - 1e-12), 0.0]
    rows = [(7, a), (7, b), (8, near_a), (None, b), (None, [0.0, 0.0, 1.0]), (9, [1.0, 0.0])]
    got = sorted((tuple(r) for r in embedding_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()), key=str)
    assert got == sorted([(7, 1, 7, True), (7, 1, 7, True), (8, 1, 7, False), (None, 1, 7, False), (None, 0, None, True), (9, 0, 9, True)], key=str)
    exact = embedding_dedup.near_duplicates(spark.createDataFrame([(1, a), (2, edge)], "vec_id long, embedding array<double>")).collect()
    assert [r.n_links for r in exact] == [1, 1]


def test_each_length_links(spark):
    """Vectors of a minority length link too, and none keeps the others from linking."""
    rng = np.random.default_rng(8)
    vectors, ids = [], []
    for size, n in ((8, 30), (5, 3), (3, 1)):
        for v in rng.standard_normal((n, size)):
            vectors += [list(map(float, np.float32(v))), list(map(float, np.float32(v + 0.01)))][: 1 if size == 3 else 2]
    df = spark.createDataFrame(list(enumerate(vectors)), "vec_id long, embedding array<float>")
    got = {r.vec_id: (r.n_links, r.component_id) for r in embedding_dedup.near_duplicates(df).collect()}
    for size in (8, 5, 3):
        ids = [i for i, v in enumerate(vectors) if len(v) == size]
        for i, links, component, _ in brute(ids, [vectors[i] for i in ids]):
            assert got[i] == (links, component)
        assert size == 3 or any(got[i][0] for i in ids)
