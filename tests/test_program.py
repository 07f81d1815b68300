"""The two-row table of the survey's fixtures: queries and the rows they must give, as a batch and step by step."""

import json
import math
import re

import pytest
from pyspark.sql import functions as F

from rivulet import cli, dialect, slt
from rivulet.operators import zset
from rivulet.plans.program import Program, ProgramError

DDL = "CREATE TABLE T (COL1 INT NOT NULL, COL2 DOUBLE NOT NULL, COL3 BOOLEAN NOT NULL, COL4 VARCHAR NOT NULL, COL5 INT, COL6 DOUBLE)"
ROWS = "INSERT INTO T VALUES (10, 12.0, true, 'Hi', NULL, NULL), (10, 1.0, false, 'Hi', 1, 0.0)"

CASES = [
    ("SELECT T.COL3 FROM T", [(True,), (False,)]),
    ("SELECT COL5 > 10 AND COL3 FROM T", [(None,), (False,)]),
    ("SELECT COL1 / COL5 FROM T", [(None,), (10,)]),
    ("SELECT 1 / 0", [(None,)]),
    ("SELECT COL2 / 0.0E0 > 1 FROM T", [(True,), (True,)]),
    ("SELECT COL1 + COL2 FROM T", [(22.0,), (11.0,)]),
    ("SELECT -COL1, +COL5 FROM T", [(-10, None), (-10, 1)]),
    ("SELECT COL4 || ' ' || COL4 FROM T", [("Hi Hi",), ("Hi Hi",)]),
    ("SELECT COL4 || NULL FROM T", [(None,), (None,)]),
    ("SELECT SUM(COL1) FROM T WHERE FALSE", [(None,)]),
    ("SELECT COUNT(*), COUNT(COL5) FROM T", [(2, 1)]),
    ("SELECT SUM(DISTINCT COL1), SUM(COL2) FROM T", [(10, 13.0)]),
    ("SELECT 3 IN (SELECT COL5 FROM T)", [(None,)]),
    ("SELECT 1 IN (SELECT COL5 FROM T)", [(True,)]),
    ("SELECT 3 NOT IN (SELECT COL1 FROM T)", [(True,)]),
    ("SELECT 34 / SUM(1) FROM T", [(17,)]),
    ("SELECT 91 + NULLIF(93, 38)", [(184,)]),
    ("SELECT T1.COL3, T2.COL3 FROM T AS T1 LEFT JOIN T AS T2 ON T1.COL1 = T2.COL5", [(True, None), (False, None)]),
    ("SELECT T1.COL3, T2.COL3 FROM T AS T1 FULL JOIN T AS T2 ON T1.COL1 = T2.COL5", [(True, None), (False, None), (None, True), (None, False)]),
    ("SELECT COUNT(*) OVER (ORDER BY COL1 RANGE UNBOUNDED PRECEDING) FROM T", [(2,), (2,)]),
    ("SELECT COUNT(*) OVER (ORDER BY COL1 RANGE BETWEEN 2 PRECEDING AND 1 PRECEDING) FROM T", [(0,), (0,)]),
    ("SELECT COL1 FROM T UNION SELECT COL1 FROM T", [(10,)]),
    ("SELECT COL1 FROM T UNION ALL SELECT COL1 FROM T", [(10,)] * 4),
    ("SELECT COL5 FROM T EXCEPT SELECT 1", [(None,)]),
    ("SELECT COL1 FROM T INTERSECT SELECT 10", [(10,)]),
    ("SELECT COL3 FROM T GROUP BY COL3", [(True,), (False,)]),
    ("SELECT COL1, COUNT(*) FROM T GROUP BY COL1 HAVING COUNT(*) > 1", [(10, 2)]),
    ("SELECT CASE WHEN COL1 > 5 THEN COL4 ELSE 'no' END FROM T", [("Hi",), ("Hi",)]),
    ("SELECT COL5 IS DISTINCT FROM COL1, COL5 <=> NULL FROM T", [(True, True), (True, False)]),
    ("SELECT (COL5 > 0) IS TRUE, (COL5 > 0) IS NOT FALSE FROM T", [(False, True), (True, True)]),
    ("SELECT ARRAY[COL1, 5][1], ARRAY[1, 2][3], ARRAY[1][0] FROM T", [(10, None, None), (10, None, None)]),
    ("SELECT X FROM T, UNNEST(ARRAY[1, 2]) AS U(X)", [(1,), (2,), (1,), (2,)]),
    ("SELECT X, I FROM UNNEST(ARRAY['a', 'b']) WITH ORDINALITY AS U(X, I)", [("a", 1), ("b", 2)]),
    ("SELECT COL1 >= ALL (SELECT COL1 FROM T), COL1 > ANY (SELECT COL5 FROM T) FROM T", [(True, True), (True, True)]),
    ("SELECT UNIQUE (SELECT COL1 FROM T), UNIQUE (SELECT COL5 FROM T)", [(False, True)]),
    ("SELECT ST_DISTANCE(ST_POINT(COL2, 0), ST_POINT(0, 0)) FROM T", [(12.0,), (1.0,)]),
    ("SELECT COL2, COL6 FROM T ORDER BY COL6 DESC", [(1.0, 0.0), (12.0, None)]),
    ("SELECT (SELECT MAX(COL2) FROM T) - COL2 FROM T", [(0.0,), (11.0,)]),
    ("SELECT '1' + 2", [(3.0,)]),
    ("SELECT CAST(2147483648 AS INT)", [(-2147483648,)]),
    ("SELECT MOD(7, 0), MOD(-7, 3)", [(None, -1)]),
    ("SELECT EXTRACT(CENTURY FROM DATE '2001-01-01'), EXTRACT(DECADE FROM DATE '1999-01-01'), EXTRACT(DOW FROM DATE '2024-01-07')", [(21, 199, 1)]),
    ("SELECT CAST(FLOOR(TIMESTAMP_NTZ '2024-01-10 05:00:00' TO WEEK) AS STRING)", [("2024-01-07 00:00:00",)]),
]


def key(row):
    return tuple((x is not None, str(type(x)), x) for x in row)


def same(got, want):
    return sorted(map(tuple, got), key=key) == sorted(want, key=key)


@pytest.fixture(scope="module")
def program(spark):
    p = Program(spark)
    p.sql(f"{DDL}; {ROWS}")
    return p


@pytest.mark.parametrize(("sql", "want"), CASES, ids=[c[0][:60] for c in CASES])
def test_batch(program, sql, want):
    assert same(program.sql(sql).collect(), want)


STEPPED = [c for c in CASES if "T" in c[0].split() or "FROM T" in c[0]]


@pytest.mark.parametrize(("sql", "want"), STEPPED[::4], ids=[c[0][:60] for c in STEPPED[::4]])
def test_insert_nothing_retract(spark, program, sql, want):
    """+R gives +V, no change gives none, -R gives what leads back to the view of no rows."""
    p = Program(spark)
    p.sql(DDL)
    p.sql(f"CREATE VIEW V AS {sql}")
    rows = zset.weighted(program.spark.table("T"))
    rows = p.spark.createDataFrame(rows.collect(), rows.schema)
    first = p.step({"T": rows})["V"]
    assert same(zset.rows(first).collect(), want)
    assert p.step({})["V"].count() == 0
    last = p.step({"T": zset.negate(rows)})["V"]
    total = zset.consolidate(zset.plus(first, last.toDF(*first.columns)))
    empty = Program(spark)
    empty.sql(DDL)
    assert same(zset.rows(total).collect(), [tuple(r) for r in empty.sql(sql).collect()])


def test_float_division_by_zero(program):
    (a, b), (c, d) = sorted(map(tuple, program.sql("SELECT COL2, COL6 / COL6 FROM T").collect()))
    assert math.isnan(b) and d is None


def test_declarations(spark):
    p = Program(spark)
    p.sql("""
        CREATE TABLE A (id INT NOT NULL, v DECIMAL(50, 20), s VARCHAR(3) ARRAY, d DATE, "Odd name" DOUBLE); -- a comment; with a semicolon
        CREATE TABLE B AS SELECT id FROM A;
        CREATE VIEW inner_view AS SELECT id, v FROM A;
        CREATE VIEW V (X, Y) AS SELECT id, v FROM inner_view WHERE id > 1;
        INSERT INTO A (id, v, d, s, "Odd name") VALUES (2, 1.5, '1997-02-29', array('toolong'), 1.0);
        INSERT INTO A SELECT * FROM A
    """)
    assert [tuple(r) for r in p.output("V").collect()] == [(2, p.output("V").first()[1])] * 2
    assert p.contents["A"].select("d", "s").first() == (None, ["toolong"])
    schema = json.loads(p.schema())
    assert [f["name"] for f in schema["outputs"][1]["fields"]] == ["X", "Y"]
    assert p.sql("CREATE VIEW dup AS SELECT id, id + 1, id FROM A") is None and p.output("dup").columns == ["id", "EXPR$1", "EXPR$2"]
    assert schema["inputs"][0]["fields"][:2] == [{"name": "id", "type": "INTEGER", "nullable": False}, {"name": "v", "type": "DECIMAL(38, 10)", "nullable": True}]
    assert any("Table 'B' is not used" in w["message"] for w in p.warnings) and any("precision" in w["message"] for w in p.warnings)
    assert '"A" -> "inner_view"' in p.dot() and "Physical Plan" in p.explain("V")
    p.sql("DROP TABLE B")
    assert "B" not in p.tables


@pytest.mark.parametrize("sql", [
    "CREATE VIEW V AS SELECT nothing FROM nowhere",
    "CREATE TABLE X (a MULTISET)",
    "CREATE TABLE X (a INT, CHECK (a > 0))",
    "CREATE VIEW V AS SELECT rand() AS r",
    "CREATE VIEW V AS SELECT CURRENT_TIMESTAMP AS t",
    "UPDATE T SET a = 1",
    "CREATE TABLE T1 (a INT, b INT); INSERT INTO T1 (a) VALUES (1)",
    "CREATE TABLE T1 (a INT); CREATE TABLE T1 (b INT)",
    "DROP TABLE missing",
])
def test_errors_are_reported(spark, sql):
    with pytest.raises(ProgramError) as e:
        Program(spark).sql(sql)
    assert e.value.report["message"] and not e.value.report["warning"]


def test_random_changes_add_up_to_the_view(spark):
    import random

    from rivulet.operators.incremental import Scan, Views

    r = random.Random(7)
    schema = "k int, v int, s string"
    a, b = Scan("a"), Scan("b")
    views = {
        "join": a.join(b.select("k AS k2", "v AS v2"), [("k", "k2")]).select("k", "v", "v2"),
        "left": a.select("k", "v").outer_join(b.select("k AS k2", "s AS s2"), [("k", "k2")]),
        "full": a.select("k", "v").outer_join(b.select("k AS k2", "s AS s2"), [("k", "k2")], "full"),
        "distinct": a.select("k", "s").distinct(),
        "sums": a.aggregate(["k"], n="count(*)", c="count(v)", t="sum(v)", m="avg(v)"),
        "extremes": a.aggregate(["k"], lo="min(v)", hi="max(s)", d="count(DISTINCT s)"),
        "total": a.aggregate([], n="count(*)", t="sum(v)"),
        "except": a.select("k").except_(b.select("k")),
        "except_all": a.select("k", "s").except_(b.select("k", "s"), all=True),
        "intersect_all": a.select("k").intersect(b.select("k"), all=True),
        "union": a.select("k").union(b.select("k")),
        "window": a.window(["k"], w="sum(v) OVER (PARTITION BY k ORDER BY v RANGE BETWEEN 2 PRECEDING AND CURRENT ROW)").select("k", "v", "w"),
        "top": a.top(["k"], ["v DESC NULLS LAST", "s", "k"], 1).select("k", "v", "s"),
    }
    types = spark.createDataFrame([], schema).schema
    running = Views(spark, views, {"a": types, "b": types})
    held = {"a": [], "b": []}
    sums = {}
    for _ in range(3):
        change = {}
        for t, rows in held.items():
            gone = [rows.pop(r.randrange(len(rows))) for _ in range(min(len(rows), r.randrange(3)))]
            new = [(r.choice([None, 1, 2, 3]), r.choice([None, 1, 2, 5]), r.choice(["x", "y", None])) for _ in range(r.randrange(1, 6))]
            rows += new
            change[t] = spark.createDataFrame([(*x, w) for w, xs in ((1, new), (-1, gone)) for x in xs], f"{schema}, __w long")
        for n, z in running.step(change).items():
            sums[n] = z if n not in sums else zset.plus(sums[n], z)
    fresh = Views(spark, views, {"a": types, "b": types})
    want = fresh.step({t: spark.createDataFrame(rows, types) for t, rows in held.items()})
    for n in views:
        got = sorted(map(str, zset.consolidate(sums[n]).collect()))
        assert got == sorted(map(str, want[n].collect())), n


def test_negative_weights_are_an_error(spark):
    z = zset.from_rows(spark, [(1,)], "a int", -1)
    with pytest.raises(Exception, match="deleted more often"):
        zset.rows(z).collect()
    assert zset.distinct(zset.plus(z, z)).count() == 0


def test_sqllogictest_script(spark):
    script = """
# a comment
hash-threshold 8
statement ok
CREATE TABLE t1(a INTEGER, b INTEGER, c VARCHAR(30))

statement ok
INSERT INTO t1 VALUES(1, 2, 'x'), (3, NULL, 'y')

statement error
INSERT INTO nowhere VALUES(1)

skipif postgresql
statement ok
NOT EVEN SQL

onlyif mysql
query I nosort
SELECT nothing

query IIT rowsort
SELECT a, b, c FROM t1
----
1 2 x
3 NULL y

query R nosort
SELECT a / 2.0 FROM t1 ORDER BY a
----
0.500
1.500

query I valuesort
SELECT a FROM t1 UNION ALL SELECT a + 1 FROM t1
----
4 values hashing to 7fe29dd9abdc5d81d7a9b6da0c4b9a6c

query I nosort
SELECT count(*) FROM t1
----
99

halt

query I nosort
not reached
"""
    import hashlib

    digest = hashlib.md5(b"1\n2\n3\n4\n").hexdigest()
    result = slt.run(spark, script.replace("7fe29dd9abdc5d81d7a9b6da0c4b9a6c", digest))
    assert (result.passed, result.skipped) == (6, 2) and len(result.failed) == 1 and "got ['2']" in result.failed[0][1]


def test_command_line(spark, tmp_path, capsys):
    (tmp_path / "tables").mkdir()
    spark.range(5).select(F.col("id").cast("int").alias("a")).write.parquet(str(tmp_path / "tables/t.parquet"))
    sql = tmp_path / "p.sql"
    sql.write_text("CREATE TABLE t (a INT); CREATE TABLE u (a INT); CREATE VIEW v AS SELECT a FROM t WHERE a > 2;")
    assert cli.main([str(sql), "-js", "--tables", str(tmp_path / "tables"), "--out", str(tmp_path / "out")], spark) == 0
    said = capsys.readouterr()
    assert json.loads(said.out)["outputs"][0]["name"] == "v" and "Table 'u' is not used" in said.err
    assert sorted(r.a for r in spark.read.parquet(str(tmp_path / "out/v")).collect()) == [3, 4]
    sql.write_text("CREATE TABLE t (a INT);\nCREATE VIEW v AS\n  SELECT FROM FROM;\nCREATE VIEW w AS SELECT a,\n  nothing FROM t;\nCREATE TABLE t (b INT)")
    assert cli.main([str(sql), "-je"], spark) == 1
    found = json.loads(capsys.readouterr().err.strip().splitlines()[-1])
    assert [(r["start_line_number"], r["start_column"], r["end_line_number"], r["end_column"]) for r in found[1:]] == [(5, 3, 5, 9), (6, 1, 6, 22)]
    assert found[0]["start_line_number"] in (2, 3) and found[0]["end_line_number"] == 3 and all(r["error_type"] and r["message"] and not r["warning"] for r in found)


def test_grouped_sql_is_maintained_from_changes(spark):
    p = Program(spark)
    p.sql("""
        CREATE TABLE t (k INT, v INT, d DOUBLE);
        CREATE TABLE u (k INT, name VARCHAR);
        CREATE VIEW a AS SELECT name, COUNT(*) AS n, SUM(v + 1) AS s, MAX(d) AS m FROM t JOIN u ON t.k = u.k WHERE v > 0 GROUP BY name;
        CREATE VIEW g AS SELECT COUNT(*) AS n, SUM(v) AS s, SUM(d) AS f FROM t;
        CREATE VIEW h AS SELECT k + 1 AS k1, COUNT(v) FROM t GROUP BY k + 1;
    """)
    rows = lambda *r: p.spark.createDataFrame(list(r), "k int, v int, d double, __w long")
    names = p.spark.createDataFrame([(1, "x"), (2, "y")], "k int, name string")
    outs = [p.step(d) for d in ({"t": rows((1, 1, 0.5, 1), (1, None, 9.0, 1), (2, 5, 2.0, 2)), "u": names}, {"t": rows((1, 3, 0.1, 1), (2, 5, 2.0, -1))}, {"t": rows((2, 5, 2.0, -1))})]
    total = {n: sorted(tuple(r) for r in zset.rows(zset.consolidate(zset.plus(*(o[n] for o in outs)))).collect()) for n in ("a", "g", "h")}
    assert total["a"] == [("x", 2, 6, 0.5)] and total["h"] == [(2, 2)]
    assert total["g"][0][:2] == (3, 4) and total["g"][0][2] == pytest.approx(9.6)
    assert p.output("a").schema["s"].dataType == outs[0]["a"].schema["s"].dataType


#: Queries over t and u, and whether they are computed whole in a step.
STEPPED_QUERIES = [
    ("SELECT a + 1 AS x FROM t WHERE v > 2", False),
    ("SELECT DISTINCT a FROM t", False),
    ("SELECT a, count(*) AS c, sum(v) AS s, avg(v) AS m, count(v) FILTER (WHERE v > 3) AS f FROM t GROUP BY a HAVING count(*) > 1", False),
    ("SELECT a, min(v) AS lo, max(b) AS hi, count(DISTINCT b) AS d FROM t GROUP BY a", False),
    ("SELECT t.a, u.b FROM t LEFT JOIN u ON t.a = u.a AND u.v > t.v", False),
    ("SELECT t.a, u.a AS ua FROM t FULL JOIN u ON t.a = u.a", False),
    ("SELECT a FROM t EXCEPT SELECT a FROM u", False),
    ("SELECT a FROM t INTERSECT ALL SELECT a FROM u", False),
    ("SELECT a, v, sum(v) OVER (PARTITION BY b ORDER BY v) AS w FROM t", False),
    ("SELECT a FROM (SELECT a, row_number() OVER (PARTITION BY a ORDER BY v, b) AS r FROM t) x WHERE r = 1", False),
    ("SELECT a FROM t WHERE v > (SELECT avg(v) FROM u)", False),
    ("SELECT a FROM t WHERE a IN (SELECT a FROM u) AND NOT EXISTS (SELECT 1 FROM u WHERE u.b = t.b)", False),
    ("SELECT a, a IN (SELECT a FROM u) AS i FROM t", False),
    ("SELECT a, (SELECT max(v) FROM u WHERE u.a = t.a) AS m FROM t", False),
    ("SELECT x.a, y.a AS ya FROM t x JOIN t y ON x.a = y.v", False),
    ("SELECT t.a, u.b FROM t JOIN u ON t.v < u.v", False),
    ("SELECT a, e FROM t, UNNEST(ARRAY[a, 1]) AS q(e)", False),
    ("WITH c AS (SELECT a, count(*) AS n FROM t GROUP BY a) SELECT x.n FROM c x JOIN c y ON x.a = y.a", False),
    ("SELECT count(*) AS n, sum(v) / count(*) AS m FROM t", False),
    ("SELECT a FROM t ORDER BY a, v, b LIMIT 3", True),
    ("SELECT a FROM t WHERE a NOT IN (SELECT a FROM u)", True),
    ("SELECT max(v) AS m FROM t", True),
    ("WITH RECURSIVE r(n) AS (SELECT 1 UNION ALL SELECT n + 1 FROM r WHERE n < 3) SELECT n, a FROM r JOIN t ON n = a", True),
]


@pytest.mark.parametrize(("sql", "whole"), STEPPED_QUERIES, ids=[q[:70] for q, _ in STEPPED_QUERIES])
def test_views_by_steps_are_the_views_of_all_rows(spark, sql, whole):
    """The sum of a view's changes is the view over the final tables, and only some views are computed whole."""
    ddl, schema = "CREATE TABLE t (a INT, b VARCHAR, v BIGINT); CREATE TABLE u (a INT, b VARCHAR, v BIGINT)", "a int, b string, v long, __w long"
    p = Program(spark)
    p.sql(f"{ddl}; CREATE VIEW inner_view AS {sql}; CREATE VIEW w AS SELECT * FROM inner_view")
    steps = [
        {"t": [(1, "x", 5, 2), (2, "y", 1, 1), (None, "z", 3, 1), (3, None, None, 1), (5, "x", 2, 1)], "u": [(1, "x", 6, 1), (2, "q", 0, 1), (None, "z", 1, 1), (3, "w", 7, 2)]},
        {"t": [(1, "x", 5, -1), (2, "y", 1, -1)]},
        {},
        {"u": [(3, "w", 7, -1), (5, "x", 2, 1)], "t": [(2, "k", 9, 1), (3, "w", 4, 1), (None, "z", 3, -1)]},
    ]
    outs, held = [], {"t": {}, "u": {}}
    for change in steps:
        outs.append(p.step({t: p.spark.createDataFrame(rows, schema) for t, rows in change.items()}))
        for t, rows in change.items():
            for *row, w in rows:
                held[t][tuple(row)] = held[t].get(tuple(row), 0) + w
    assert outs[2]["w"].count() == 0
    batch = Program(spark)
    for t, rows in held.items():
        batch.table(t, p.tables[t], batch.spark.createDataFrame([r for r, w in rows.items() for _ in range(w)], p.tables[t]))
    want = batch.sql(sql)
    for v in ("inner_view", "w"):
        total = zset.rows(zset.consolidate(zset.plus(*(o[v] for o in outs))))
        assert same(total.collect(), [tuple(r) for r in want.collect()])
        assert [f.dataType for f in total.schema] == [f.dataType for f in want.schema]
    assert any("computed whole" in w["message"] for w in p.warnings) == whole


@pytest.mark.parametrize("sql", [
    "SELECT t.a, u.b FROM t JOIN u ON t.a = u.b",
    "SELECT a FROM t UNION SELECT b + 500 FROM u",
    "SELECT t.a, u.b FROM t LEFT JOIN u ON t.a = u.b AND u.b % 2 = 0",
], ids=["join", "union", "left_join"])
def test_programs_whose_steps_touch_thousands_of_keys(spark, sql):
    """The second step's keys, some of them touched before, are handed to the scan of a state."""
    p, whole = Program(spark), Program(spark)
    for q in (p, whole):
        q.sql(f"CREATE TABLE t (a BIGINT); CREATE TABLE u (b BIGINT); CREATE VIEW v AS {sql}")
    numbers = lambda q, *ends: {t: q.spark.range(*ends, 1, 1).selectExpr(f"id AS {c}") for t, c in (("t", "a"), ("u", "b"))}
    steps = zset.integrate([p.step(numbers(p, 0, 6000))["v"], p.step(numbers(p, 1000, 9500))["v"]])
    first, second = numbers(whole, 0, 6000), numbers(whole, 1000, 9500)
    once = whole.step({t: first[t].union(second[t]) for t in first})["v"]
    assert once.count() > 0 and zset.differentiate(steps, once).count() == 0


def test_a_program_goes_on_from_its_home(spark, tmp_path):
    def program():
        p = Program(spark, home=str(tmp_path / "home"))
        p.sql("CREATE TABLE t (a INT); INSERT INTO t VALUES (1); CREATE VIEW v AS SELECT a, count(*) AS n FROM t GROUP BY a")
        return p

    one = [(1,)]
    assert sorted(map(tuple, program().step()["v"].collect())) == [(1, 1, 1)]
    p = program()
    assert sorted(map(tuple, p.step({"t": p.spark.createDataFrame(one, "a int")})["v"].collect())) == [(1, 1, -1), (1, 2, 1)]


NULLS = "CREATE TABLE t (a INT, b INT); INSERT INTO t VALUES (1, 1), (NULL, 2); CREATE TABLE q (\"a b\" INT, c INT, random INT); INSERT INTO q VALUES (1, 2, 3)"


@pytest.mark.parametrize(("sql", "want"), [
    ("SELECT a FROM t WHERE (3 IN (SELECT a FROM t)) IS NULL", [(1,), (None,)]),
    ("SELECT a, a IN (SELECT a FROM t) FROM t", [(1, True), (None, None)]),
    ("SELECT CASE WHEN a IN (SELECT a FROM t) THEN 1 ELSE 0 END FROM t", [(1,), (0,)]),
    ("SELECT b FROM t WHERE NOT (b IN (SELECT a FROM t))", []),
    ("SELECT b FROM t WHERE b IN (SELECT a FROM t) OR b = 2", [(1,), (2,)]),
    ("SELECT b FROM t WHERE a IN (SELECT a FROM t) AND b < 5", [(1,)]),
    ("SELECT b, b + 1 > ALL (SELECT b FROM t) FROM t", [(1, False), (2, True)]),
    ("SELECT b FROM t WHERE b - -1 >= ANY (SELECT b + 1 FROM t WHERE b = 2)", [(2,)]),
    ("SELECT \"a b\" AS x, c, random FROM q", [(1, 2, 3)]),
    ("SELECT UNIQUE (SELECT * FROM t), UNIQUE (SELECT b FROM t)", [(True, True)]),
    ("SELECT x, y FROM UNNEST(ARRAY[1, 2], ARRAY['a']) AS u(x, y)", [(1, "a"), (2, None)]),
    ("SELECT x, y, i FROM UNNEST(ARRAY[1, 2], ARRAY['a', 'b']) WITH ORDINALITY AS u(x, y, i)", [(1, "a", 1), (2, "b", 2)]),
    ("SELECT CAST(b AS VARCHAR) FROM t", [("1",), ("2",)]),
], ids=lambda x: x if isinstance(x, str) else "")
def test_values_of_predicates_and_names(spark, sql, want):
    p = Program(spark)
    p.sql(NULLS)
    assert same(p.sql(sql).collect(), want)


def test_what_has_no_fixed_value_is_told_by_the_plan(spark):
    p = Program(spark)
    p.sql(f"{NULLS}; CREATE VIEW fine AS SELECT random, 'right now ' AS w FROM q")
    for i, sql in enumerate(("SELECT rand() AS r", "SELECT a FROM t WHERE a IN (SELECT unix_timestamp(now()))", "SELECT uuid() AS u FROM t", "SELECT current_date AS d")):
        with pytest.raises(ProgramError, match="no fixed value"):
            p.sql(f"CREATE VIEW v{i} AS {sql}")


def test_strict_mode(spark):
    p = Program(spark, strict=True)
    p.sql("CREATE TABLE t (s VARCHAR, i INT, d DECIMAL(10, 2), ts TIMESTAMP); INSERT INTO t VALUES ('x', 2147483647, 1.25, TIMESTAMP_NTZ '2024-01-01 10:00:00.123456'), ('12', 2, 1.35, NULL), (NULL, 3, 2.5, NULL)")
    from decimal import Decimal as D

    assert same(p.sql("SELECT CAST(s AS INT), CAST(s AS DOUBLE), CAST(s AS BOOLEAN), CAST(s AS DECIMAL(5, 1)) FROM t").collect(), [(0, 0.0, False, D("0.0")), (12, 12.0, False, D("12.0")), (None, None, None, None)])
    sums = p.sql("SELECT SUM(i) AS s, AVG(i) AS a, SUM(DISTINCT i) AS d FROM t")
    assert [t for _, t in sums.dtypes] == ["int"] * 3 and tuple(sums.first()) == (-2147483644, 715827884, -2147483644)
    assert same(p.sql("SELECT ROUND(d, 1), ROUND(d) FROM t").collect(), [(D("1.2"), D(1)), (D("1.4"), D(1)), (D("2.5"), D(2))])
    assert p.sql("SELECT CAST(ts AS VARCHAR) FROM t WHERE ts IS NOT NULL").first()[0] == "2024-01-01 10:00:00"
    assert str(p.sql("SELECT CAST('2024-01-01 10:00:00.1235' AS TIMESTAMP)").first()[0]) == "2024-01-01 10:00:00.124000"
    assert p.sql("SELECT CAST(s AS DATE) FROM t WHERE s = 'x'").first()[0] is None
    plain = Program(spark)
    assert plain.sql("SELECT CAST('x' AS INT)").first()[0] is None


def test_a_step_starts_from_what_tables_hold(spark, tmp_path):
    spark.createDataFrame([(1, 10), (1, 20), (2, 5)], "k int, v int").write.parquet(str(tmp_path / "o"))
    p = Program(spark)
    p.read("o", str(tmp_path / "o"))
    p.sql("CREATE TABLE c (k INT, name VARCHAR); INSERT INTO c VALUES (1, 'a'), (2, 'b')")
    p.sql("CREATE VIEW big AS SELECT k, count(*) AS n, sum(v) AS s FROM o GROUP BY k; CREATE VIEW named AS SELECT c.name, o.v FROM o JOIN c ON o.k = c.k")
    total = {"big": {}, "named": {}}

    def add(out):
        for view, z in out.items():
            for *row, w in map(tuple, z.collect()):
                total[view][tuple(row)] = total[view].get(tuple(row), 0) + w
        return {view: {row: w for row, w in rows.items() if w} for view, rows in total.items()}

    got = add(p.step({"o": p.spark.createDataFrame([(1, 20, -1), (2, 7, 1)], "k int, v int, __w long")}))
    assert got == {"big": {(1, 1, 10): 1, (2, 2, 12): 1}, "named": {("a", 10): 1, ("b", 5): 1, ("b", 7): 1}}
    p.sql("INSERT INTO c VALUES (2, 'bb')")
    got = add(p.step({"o": p.spark.createDataFrame([(1, 1)], "k int, v int")}))
    assert got == {"big": {(1, 2, 11): 1, (2, 2, 12): 1}, "named": {("a", 10): 1, ("a", 1): 1, ("b", 5): 1, ("b", 7): 1, ("bb", 5): 1, ("bb", 7): 1}}


@pytest.mark.parametrize(("sql", "changed"), [
    ("SELECT approx_count_distinct(a) AS x, count(DISTINCT a) AS y FROM s", 1),
    ("SELECT g, APPROX_COUNT_DISTINCT ( ALL b, 0.02) FILTER (WHERE a > 9) AS x, count(*) AS n, count(DISTINCT a) AS y FROM s GROUP BY g HAVING approx_count_distinct(a + b) > 0", 2),
    ("SELECT g, x.k FROM s, (SELECT approx_count_distinct(b) - count(DISTINCT a) AS k FROM s) x WHERE a < (SELECT count(DISTINCT b) - approx_count_distinct(a) FROM s)", 2),
    ("SELECT approx_count_distinct(a) AS x, count(a) AS y FROM s", 0),
    ("SELECT (SELECT approx_count_distinct(a) FROM s) AS x, count(DISTINCT a) AS y FROM s", 0),
    ("SELECT a, approx_count_distinct(b) OVER (PARTITION BY g) AS x FROM s", 0),
])
def test_sketches_beside_distinct(spark, sql, changed):
    """There is one for a group, not one for each distinct value, and it gives what it gave."""
    p = Program(spark)
    rows = p.spark.range(3000).selectExpr("id % 700 AS a", "IF(id % 5 = 0, NULL, id) AS b", "id % 3 AS g")
    p.table("s", rows.schema, rows)
    p.sql(f"CREATE VIEW v AS {sql}")
    assert len(re.findall(r"approx_count_distinct\s*\(DISTINCT ", p.views["v"].query, re.I)) == changed
    want = sorted(map(tuple, p.spark.sql(dialect.rewritten(sql)).collect()))
    assert sorted(map(tuple, p.output("v").collect())) == want
    assert sorted(map(tuple, zset.rows(p.step()["v"]).collect())) == want


def test_tasks_are_dealt_few_bytes(spark):
    """A task's hash tables grow with what it is dealt: not with the caller's 64 MB of shuffled rows and 128 MB of a file."""
    most = {"spark.sql.adaptive.advisoryPartitionSizeInBytes": 8 << 20, "spark.sql.files.maxPartitionBytes": 16 << 20}
    caller = spark.newSession()
    assert all(int(Program(caller).spark.conf.get(k)) == n for k, n in most.items())
    for k in most:
        caller.conf.set(k, "1m")
    assert all(int(Program(caller).spark.conf.get(k)) == 1 << 20 for k in most)
    assert all(caller.conf.get(k) == "1m" for k in most)


def test_halt_of_other_databases_does_not_end_a_script():
    rest = "\nhalt\n\nstatement ok\nCREATE TABLE t (a INT)\n"
    for condition, n in (("onlyif mssql", 1), (f"skipif {slt.DATABASE}", 1), (f"onlyif {slt.DATABASE}", 0), ("", 0)):
        assert [r.kind for r in slt.parse(condition + rest)] == ["statement"] * n
