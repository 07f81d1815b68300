"""Column recipes and rewrites, one by one."""

import math

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rivulet import dialect, types
from rivulet.functions import recipes as r
from rivulet.session import engine_session

ROW = "SELECT 7 AS a, -2 AS b, 0 AS z, CAST(NULL AS INT) AS n, 7.0D AS d, 0.0D AS e, double('NaN') AS nan, TIMESTAMP_NTZ '2024-02-29 13:14:15.678' AS t, DATE '1999-12-31' AS y, array(4, 5, NULL) AS xs, array(9) AS one, CAST(NULL AS ARRAY<INT>) AS none, 'true' AS yes, 'x' AS bad, '12' AS num, 3.0D AS px, 4.0D AS py"

def cases():
    return [
        (r.int_divide(F.col("a"), F.col("b"), "int"), -3), (r.int_divide(F.col("a"), F.col("z")), None), (r.int_divide(F.col("a"), F.col("n")), None),
        (r.ieee_divide(F.col("d"), F.col("e")), math.inf), (r.ieee_divide(-F.col("d"), F.col("e")), -math.inf), (r.ieee_divide(F.col("n").cast("double"), F.col("e")), None), (r.ieee_divide(F.col("d"), F.lit(2.0)), 3.5),
        (r.modulo(F.col("a"), F.col("z")), None), (r.modulo(F.col("b"), F.lit(3)), -2),
        (r.cast_or(F.col("bad"), "int", 0), 0), (r.cast_or(F.col("num"), "int", 0), 12), (r.cast_or(F.col("n").cast("string"), "int", 0), None),
        (r.truth(F.col("yes")), True), (r.truth(F.col("bad")), False), (r.truth(F.col("n").cast("string")), None),
        (r.timestamp_text(F.col("t")), "2024-02-29 13:14:15"), (r.to_millis(F.expr("TIMESTAMP_NTZ '2024-01-01 00:00:00.0015'")).cast("string"), "2024-01-01 00:00:00.002"),
        (r.decade(F.col("y")), 199), (r.century(F.col("y")), 20), (r.millennium(F.col("y")), 2),
        (r.floor_week(F.col("t")).cast("string"), "2024-02-25 00:00:00"), (r.millisecond(F.col("t")), 15678), (r.epoch(F.col("t")), 1709212455),
        (r.cardinality(F.col("xs")), 3), (r.cardinality(F.col("none")), None), (r.element(F.col("one")), 9), (r.element(F.col("xs")), None),
        (r.at(F.col("xs"), F.lit(1)), 4), (r.at(F.col("xs"), F.lit(0)), None), (r.at(F.col("xs"), F.lit(9)), None), (r.at(F.col("xs"), F.lit(-1)), None),
        (r.distance(r.point(F.col("px"), F.col("py")), r.point(F.lit(0.0), F.lit(0.0))), 5.0), (r.point(F.col("n"), F.col("px")), None),
    ]


@pytest.fixture(scope="module")
def row(spark):
    return engine_session(spark).sql(ROW)


def test_recipes(row):
    made = cases()
    got = row.select(*(c.alias(f"c{i}") for i, (c, _) in enumerate(made))).first()
    for i, (_, want) in enumerate(made):
        assert got[i] == want, (i, got[i], want)
    assert math.isnan(row.select(r.ieee_divide(F.col("e"), F.col("e"))).first()[0]) and math.isnan(row.select(r.ieee_divide(F.col("nan"), F.col("e"))).first()[0])


def test_average_of_integers(spark):
    df = spark.createDataFrame([(1, 3), (1, 4), (2, None)], "k int, v int")
    assert {x.k: x.a for x in df.groupBy("k").agg(r.average_int(F.col("v")).alias("a")).collect()} == {1: 3, 2: None}


def test_statements():
    assert dialect.statements("SELECT ';' ; -- a;b\n SELECT 2 /* ; */;;") == ["SELECT ';'", "SELECT 2"]


@pytest.mark.parametrize(("sql", "want"), [
    ("SELECT ARRAY[1, 2]", "SELECT array(1, 2)"),
    ("SELECT a.b[i + 1]", "SELECT IF((i + 1) >= 1, try_element_at(a.b, CAST(i + 1 AS INT)), NULL)"),
    ("SELECT x FROM t WHERE x IN (SELECT y FROM u)", "SELECT x FROM t WHERE x IN (SELECT y FROM u)"),
    ("SELECT '[1]' AS s", "SELECT '[1]' AS s"),
    ("SELECT FLOOR(x)", "SELECT FLOOR(x)"),
    ("SELECT EXTRACT(YEAR FROM t)", "SELECT EXTRACT(YEAR FROM t)"),
])
def test_rewrites(sql, want):
    assert dialect.rewritten(sql) == want


@pytest.mark.parametrize(("text", "want"), [
    ("INT8", T.LongType()), ("varchar(20)", T.StringType()), ("DECIMAL(10, 2)", T.DecimalType(10, 2)), ("NUMERIC", T.DecimalType(38, 10)), ("DECIMAL(5)", T.DecimalType(5, 0)),
    ("DOUBLE PRECISION", T.DoubleType()), ("INT ARRAY ARRAY", T.ArrayType(T.ArrayType(T.IntegerType()))), ("TIMESTAMP(3)", T.TimestampNTZType()), ("GEOMETRY", types.POINT), ("uint64", T.LongType()),
])
def test_types(text, want):
    assert types.parse_type(text) == want


@pytest.mark.parametrize("text", ["MAP", "VARBINARY(3)", "INT MULTISET", "TIME"])
def test_types_that_tables_cannot_have(text):
    with pytest.raises(types.UnsupportedType):
        types.parse_type(text)
