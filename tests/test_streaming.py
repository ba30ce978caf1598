from datetime import datetime, timedelta

from pyspark.sql import functions as F

from covenant.streaming import gate

START = datetime(2024, 1, 1)


def put(spark, folder, name, rows, kinds):
    spark.createDataFrame(rows, kinds).coalesce(1).write.mode("append").parquet(str(folder / name))


def stream(spark, folder, name, kinds):
    return spark.readStream.schema(kinds).option("maxFilesPerTrigger", 1).parquet(str(folder / name))


def held(spark, place, kinds, more=""):
    got = []
    for went in ("passed", "aside"):
        df = gate.written(spark, f"{place}/{went}", kinds + (more if went == "aside" else ""))
        got.append(sorted(((r.id, r.reason) if "reason" in df.columns else r.id) for r in df.collect()))
    return tuple(got)


def test_late_parents_and_restart(spark, tmp_path):
    """Children before, with and after their parent, several batches, then a new start
    from the checkpoint."""
    kinds, at = "id int, parent int, at timestamp", lambda h: START + timedelta(hours=h)
    parents = "k int, at timestamp"
    place = str(tmp_path / "out")

    def run():
        gate.parent_stream(stream(spark, tmp_path, "c", kinds), ["id"], stream(spark, tmp_path, "p", parents), "parent", "k", "at", "at", "100 hours", "3 hours", place)
        return held(spark, place, kinds)

    put(spark, tmp_path, "c", [(1, 10, at(1)), (2, 20, at(1)), (3, None, at(1)), (4, 30, at(2))], kinds)
    put(spark, tmp_path, "p", [(10, at(0)), (10, at(1))], parents)
    assert run() == ([1], [])  # the others wait
    put(spark, tmp_path, "p", [(20, at(3)), (99, at(9))], parents)  # 20 is late for its child, but in time
    put(spark, tmp_path, "c", [(5, 99, at(9)), (6, 77, at(9))], kinds)
    passed, aside = run()
    assert passed == [1, 2, 3, 5] and aside == [4]
    put(spark, tmp_path, "p", [(1000, at(50))], parents)
    put(spark, tmp_path, "c", [(7, 1000, at(50))], kinds)
    assert run() == ([1, 2, 3, 5, 7], [4, 6])
    reasons = gate.written(spark, f"{place}/aside", kinds + ", _violations array<string>")
    assert {tuple(r._violations) for r in reasons.collect()} == {("reference",)}


def test_repeats_are_put_aside(spark, tmp_path):
    kinds, place = "id int, k string, n int", str(tmp_path / "out")
    run = lambda: gate.unique_gate(stream(spark, tmp_path, "r", kinds), ["k"], ["id"], place, 4)
    put(spark, tmp_path, "r", [(1, "a", 1), (2, "a", 2), (3, None, 3), (4, None, 4)], kinds)
    put(spark, tmp_path, "r", [(5, "b", 1), (6, "a", 1)], kinds)
    run()
    want = ([1, 3, 4, 5], [(2, "repeated"), (6, "known")])
    got = held(spark, place, kinds, ", reason string")
    assert ([x for x in got[0]], got[1]) == want
    put(spark, tmp_path, "r", [(7, "b", 1), (8, "c", 1)], kinds)
    run()
    got = held(spark, place, kinds, ", reason string")
    assert got == ([1, 3, 4, 5, 8], [(2, "repeated"), (6, "known"), (7, "known")])


def test_a_batch_that_runs_again(spark, tmp_path):
    """The index has the batch already, its folders are overwritten: nothing is doubled."""
    import os
    import shutil

    kinds, place = "id int, k string, n int", tmp_path / "out"
    run = lambda: gate.unique_gate(stream(spark, tmp_path, "r", kinds), ["k"], ["id"], str(place), 4)
    put(spark, tmp_path, "r", [(1, "a", 1), (2, "a", 2)], kinds)
    run()
    # as if it had stopped before Spark noted the end of the batch
    for name in os.listdir(place / "state" / "commits"):
        os.remove(place / "state" / "commits" / name)
    shutil.rmtree(place / "passed")
    run()
    assert held(spark, str(place), kinds, ", reason string") == ([1], [(2, "repeated")])


def test_nothing_came(spark, tmp_path):
    kinds = "id int, k string, n int"
    put(spark, tmp_path, "r", [], kinds)
    gate.unique_gate(stream(spark, tmp_path, "r", kinds), ["k"], ["id"], str(tmp_path / "out"), 4)
    assert gate.written(spark, str(tmp_path / "out" / "passed"), kinds).count() == 0
    assert gate.written(spark, str(tmp_path / "nowhere"), kinds).where(F.lit(True)).count() == 0
