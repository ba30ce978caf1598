import os

import duckdb
import pytest
from pyspark.sql import functions as F

from covenant.llm import mixing, queries

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01")


def test_marginals_meet_targets(spark):
    rows = [(s, lang, t, float(m)) for (s, lang, t), m in zip([(s, x, t) for s in "abc" for x in "xy" for t in "pq"], [5, 1, 9, 30, 2, 2, 7, 1, 100, 3, 4, 6], strict=True)]
    cells = spark.createDataFrame(rows, "source string, lang string, topic string, mass double")
    goal = {"source": {"a": 1, "b": 2, "c": 1}, "lang": {"x": 3, "y": 1}, "topic": {"p": 1, "q": 1}}
    got = mixing.rake(cells, targets=goal, rounds=24)
    for d, want in goal.items():
        for r in got.groupBy(d).agg(F.sum("weight").alias("w")).collect():
            assert r.w == pytest.approx(want[r[d]] / sum(want.values()), abs=1e-9)
    for share in (0.1, 0.5, 0.95, 1.0):
        c = mixing.calibrate(got, share).agg(F.sum(F.col("chance") * F.col("mass")), F.max("chance")).first()
        assert c[0] == pytest.approx(share * sum(r[3] for r in rows), rel=1e-6) or share == 1.0
        assert c[1] <= 1


def test_query_like_sql(spark):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{SF}/documents.parquet'")
    columns = "doc_id, source, lang, topic, tokens, scale, chance, sampled"
    want = sorted(con.execute(f"select {columns} from ({queries.ORACLE_SQL['op10_mixing']})").fetchall())
    got = sorted(tuple(r) for r in queries.QUERIES["op10_mixing"](spark, SF).select(*columns.split(", ")).collect())
    assert got == want and 0 < sum(r[-1] for r in got) < len(got)


def test_odd_rows(spark):
    rows = [(1, "a b c " * 50, None, "s"), (2, None, "en", None), (3, "", "en", "s"), (None, "hello " * 9, "de", "t"), (1, "a b c " * 50, None, "s")] + [(i, "x | y " * (i % 7), "en", "s") for i in range(10, 60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumn("topic", F.lit("clash")).withColumn("mass", F.lit(1))
    got = mixing.mix(df).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    assert by[2].chance == 0 and not by[2].sampled and by[3].chance == 0 and by[10].topic == "list" and by[14].topic == "prose"
    assert len({r.sampled for r in got if r.doc_id == 1}) == 1
    assert mixing.mix(df.limit(0)).count() == 0
    assert mixing.mix(df, alpha=1.0, share=1.0).where("sampled").count() == sum(bool(r[1]) for r in rows)


def test_copies_meet_targets(spark):
    """The small source cannot supply half of the tokens: the sample falls short, copies do not."""
    rows = [(i, "some words " * 8, "en", "big" if i % 10 else "small") for i in range(4000)]
    mixed = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"), targets={"source": {"big": 1, "small": 1}}, share=0.8)
    got = {r.value: r for r in mixing.marginals(mixed).where("dimension = 'source'").collect()}
    assert got["small"].own == pytest.approx(0.1) and got["small"].target == pytest.approx(0.5)
    assert got["small"].sampled == pytest.approx(0.1 / 0.8) and got["small"].short and not got["big"].short
    copied = dict(mixed.groupBy("source").agg(F.sum(F.col("copies") * F.col("tokens"))).collect())
    total = mixed.agg(F.sum("tokens")).first()[0]
    assert copied["small"] == pytest.approx(0.4 * total, rel=0.05) and copied["big"] == pytest.approx(0.4 * total, rel=0.05)


def test_calibration_ends_at_a_solution(spark):
    """Weights that halve from cell to cell: a step fixes only some of the cells that are left."""
    n, share = 80, 0.95
    raked = spark.createDataFrame([(i, 1.0, 0.5**i / (2 - 2.0 ** (1 - n))) for i in range(n)], "cell long, mass double, weight double")
    got = mixing.calibrate(raked, share).agg(F.sum("chance"), F.max("chance"), F.sum((F.col("chance") == 1).cast("int"))).first()
    assert got[0] == pytest.approx(share * n) and got[1] == 1 and 0 < got[2] < n
