import sqlite3
import time

import pytest
from pyspark.sql import types as T

from rivulet.operators import zset
from rivulet.operators.incremental import Scan, Views
from rivulet.sources import files
from rivulet.streaming import driver


def test_csv_both_ways(spark, tmp_path):
    schema = T.StructType([T.StructField("b", T.BooleanType()), T.StructField("s", T.StringType()), T.StructField("n", T.IntegerType())])
    rows = [(True, "Mihai", 0), (False, "Leonid", 1), (True, None, None), (True, 'say "hi"', 3)]
    files.write_csv(spark.createDataFrame(rows, schema), str(tmp_path / "c"))
    text = "\n".join(sorted("".join(p.read_text() for p in (tmp_path / "c").glob("part-*")).strip().split("\n")))
    assert 'true,"Mihai",0' in text and "true,," in text and '"say ""hi"""' in text
    (tmp_path / "in.csv").write_text('true,"Mihai",0\nfalse,Leonid,1\ntrue,,\n')
    assert set(map(tuple, files.read_csv(spark, str(tmp_path / "in.csv"), schema).collect())) == set(rows[:3])


def test_sqlite(spark, tmp_path):
    path = str(tmp_path / "t.db")
    with sqlite3.connect(path) as db:
        db.execute("CREATE TABLE t1 (id INT, name VARCHAR, flag BOOL)")
        db.executemany("INSERT INTO t1 VALUES (?, ?, ?)", [(73, "name1", True), (74, None, False)])
    schema = T.StructType([T.StructField("id", T.IntegerType()), T.StructField("name", T.StringType()), T.StructField("flag", T.BooleanType())])
    assert sorted(map(tuple, files.read_sqlite(spark, path, "t1", schema).collect())) == [(73, "name1", True), (74, None, False)]


def test_files_drive_a_view(spark, tmp_path):
    schema = spark.createDataFrame([], "k int, v int, __w long").schema
    path = tmp_path / "changes"
    for i, rows in enumerate([[(1, 5, 1), (2, 7, 1)], [(1, 6, 1)], [(1, 5, -1)]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(path / f"{i}"))
    plain = T.StructType(schema.fields[:2])
    views = Views(spark, {"v": Scan("t").aggregate(["k"], s="sum(v)", n="count(*)")}, {"t": plain})
    out = []
    steps = driver.run_files(spark, views, "t", str(path / "*"), schema, lambda n, z: out.append([tuple(r) for r in z["v"].collect()]), files_a_step=1)
    total: dict = {}
    for rows in out:
        for k, s, n, w in rows:
            total[(k, s, n)] = total.get((k, s, n), 0) + w
    assert steps >= 3 and {k: w for k, w in total.items() if w} == {(1, 6, 1): 1, (2, 7, 1): 1}


def test_a_stream_that_takes_too_long_is_no_success(spark, tmp_path):
    for i in range(4):
        spark.createDataFrame([(i,)], "k int").coalesce(1).write.parquet(str(tmp_path / "slow" / f"{i}"))
    sink = lambda n, z: time.sleep(2)
    plain = T.StructType([T.StructField("k", T.IntegerType())])
    with pytest.raises(TimeoutError):
        driver.run_files(spark, Views(spark, {"v": Scan("t")}, {"t": plain}), "t", str(tmp_path / "slow" / "*"), plain, sink, timeout=1)
    assert not spark.streams.active


def test_the_streamed_query_deals_each_change_to_several_tasks(spark, tmp_path, monkeypatch):
    """A change is read, written and taken by as many tasks as its table has parts, in one step."""
    from rivulet.queries import incremental

    spark.range(0, 2000, 1, 4).selectExpr("id AS o_orderkey", "IF(id % 9 = 0, NULL, id % 70) AS o_custkey").write.parquet(str(tmp_path / "orders.parquet"))
    read, steps, run = set(), [], driver.run_files

    def counted(session, views, table, path, *args, **options):
        read.update(session.read.parquet(path).inputFiles())
        steps.append(run(session, views, table, path, *args, **options))

    monkeypatch.setattr(driver, "run_files", counted)
    got = incremental.queries()["stream_files_view"](spark, str(tmp_path)).collect()
    assert sorted(map(str, got)) == sorted(map(str, spark.read.parquet(str(tmp_path / "orders.parquet")).groupBy("o_custkey").count().toDF("o_custkey", "n").collect()))
    assert sum(steps) == 3 and len(read) >= 3 * 4


def _grouped(spark, home):
    return Views(spark, {"v": Scan("t").aggregate(["k"], n="count(*)"), "m": Scan("t").aggregate(["k"], hi="max(v)")}, {"t": T._parse_datatype_string("k int, v int")}, str(home))


def test_another_driver_goes_on_from_the_states(spark, tmp_path):
    schema = T._parse_datatype_string("k int, v int")
    path, home, checkpoint = tmp_path / "changes", tmp_path / "home", str(tmp_path / "checkpoint")
    spark.createDataFrame([(1, 5), (1, 7)], schema).coalesce(1).write.parquet(str(path / "0"))
    out = []
    sink = lambda n, z: out.append({v: sorted(map(tuple, x.collect())) for v, x in z.items()})
    assert driver.run_files(spark, _grouped(spark, home), "t", str(path / "*"), schema, sink, checkpoint) == 1
    spark.createDataFrame([(1, 6)], schema).coalesce(1).write.parquet(str(path / "1"))
    assert driver.run_files(spark, _grouped(spark, home), "t", str(path / "*"), schema, sink, checkpoint) == 1
    assert out == [{"v": [(1, 2, 1)], "m": [(1, 7, 1)]}, {"v": [(1, 2, -1), (1, 3, 1)], "m": []}]
    with pytest.raises(ValueError, match="states aren't in"):
        driver.run_files(spark, _grouped(spark, tmp_path / "elsewhere"), "t", str(path / "*"), schema, sink, checkpoint)
    with pytest.raises(ValueError, match="states of other views"):
        Views(spark, {"v": Scan("t").distinct()}, {"t": schema}, str(home))


@pytest.mark.parametrize("when", ["before the manifest", "after the manifest"])
def test_a_driver_that_dies_in_a_step_counts_nothing_twice(spark, tmp_path, monkeypatch, when):
    schema = T._parse_datatype_string("k int, v int")
    path, home, checkpoint = tmp_path / "changes", tmp_path / "home", str(tmp_path / "checkpoint")
    for i, rows in enumerate([[(1, 5), (2, 7)], [(1, 6)], [(2, 1)]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(path / f"{i}"))
    given, broken = {}, []

    def sink(n, z):
        rows = {v: sorted(map(tuple, x.collect())) for v, x in z.items()}
        if n == 1 and when == "after the manifest" and not broken:
            broken.append(n)
            raise RuntimeError("dies")
        assert given.setdefault(n, rows) == rows

    from rivulet.operators import incremental

    commit = incremental.write_text

    def dies(spark, at, text):
        if "000000002" in at and not broken:
            broken.append(at)
            raise RuntimeError("dies")
        commit(spark, at, text)

    if when == "before the manifest":
        monkeypatch.setattr(incremental, "write_text", dies)
    with pytest.raises(Exception, match="dies"):
        driver.run_files(spark, _grouped(spark, home), "t", str(path / "*"), schema, sink, checkpoint)
    driver.run_files(spark, _grouped(spark, home), "t", str(path / "*"), schema, sink, checkpoint, forget=True)
    total = {}
    for rows in given.values():
        for k, n, w in rows["v"]:
            total[k, n] = total.get((k, n), 0) + w
    assert sorted(given) == [0, 1, 2] and {x for x, w in total.items() if w} == {(1, 2), (2, 2)}


def test_states_are_summed_up_and_read_by_touched_keys(spark, tmp_path, monkeypatch):
    from rivulet.operators import incremental

    monkeypatch.setattr(incremental, "COMPACT", 3)
    schema = T._parse_datatype_string("k int, v int")
    for most in (10_000, 0):  # keys handed to the scan, and joined
        monkeypatch.setattr(incremental, "MOST_HASHES", most)
        views, sums = _grouped(spark, tmp_path / f"home{most}"), {}
        for i in range(9):
            for k, hi, w in map(tuple, views.step({"t": spark.createDataFrame([(i % 3, i, 1), *([(0, 3, -1)] if i == 5 else [])], "k int, v int, __w long")})["m"].collect()):
                sums[k, hi] = sums.get((k, hi), 0) + w
        assert {x for x, w in sums.items() if w} == {(0, 6), (1, 7), (2, 8)}
        assert all(len(paths) <= 3 for paths in views.store.logs.values())
        logs = len(list((tmp_path / f"home{most}").glob("*.*")))
        assert logs < 9 * 3 + 10
        views.close()
        assert not (tmp_path / f"home{most}").exists()
    del schema


@pytest.mark.parametrize("make", [
    lambda a, b: a.aggregate(["k"], n="count(*)"),
    lambda a, b: a.join(b, [("k", "j")]),
    lambda a, b: a.outer_join(b, [("k", "j")]),
    lambda a, b: a.outer_join(b, [("k", "j")], "full"),
    lambda a, b: a.except_(b),
    lambda a, b: a.except_(b, all=True),
    lambda a, b: a.intersect(b),
    lambda a, b: a.union(b.select("j AS k")),
    lambda a, b: a.aggregate(["k"], n="count(*)").aggregate(["n"], c="count(*)"),
], ids=["aggregate", "join", "left", "full", "except", "except_all", "intersect", "union", "view_on_view"])
def test_steps_that_touch_thousands_of_keys(spark, make):
    """Each step's keys, some of them touched before, are handed to the scan of a state."""
    from rivulet.session import engine_session

    session = engine_session(spark)
    changes = [[session.range(lo, hi, 1, 1).selectExpr(f"id AS {c}") for c in "kj"] for lo, hi in ((0, 6000), (1000, 9500))]
    views = Views(session, {"v": make(Scan("a"), Scan("b"))}, {"a": changes[0][0].schema, "b": changes[0][1].schema})
    steps = zset.integrate([views.step({"a": a, "b": b})["v"] for a, b in changes])
    whole = Views(session, {"v": make(Scan("a"), Scan("b"))}, {"a": changes[0][0].schema, "b": changes[0][1].schema})
    once = whole.step({"a": changes[0][0].union(changes[1][0]), "b": changes[0][1].union(changes[1][1])})["v"]
    assert zset.differentiate(steps, once).count() == 0
    views.close()
    whole.close()


def test_event_time_windows(spark, tmp_path):
    df = spark.sql("SELECT TIMESTAMP_NTZ '2024-01-01 00:00:05' AS ts, 'a' AS k UNION ALL SELECT TIMESTAMP_NTZ '2024-01-01 00:00:15', 'a'")
    df.write.parquet(str(tmp_path / "e"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "e"))
    q = driver.windowed_counts(stream, "ts", "10 seconds", "1 minute", None, "k").writeStream.outputMode("complete").format("memory").queryName("w").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(r.n for r in spark.table("w").collect()) == [1, 1]


def test_empty_zset(spark):
    z = zset.empty(spark, spark.createDataFrame([], "a int").schema)
    assert zset.columns(z) == ["a"] and zset.consolidate(z).count() == 0
