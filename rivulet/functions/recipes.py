"""Column expressions; all stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def int_divide(a: Column, b: Column, kind: str = "bigint") -> Column:
    """Truncating integer division; null for a zero divisor."""
    return F.when(b != 0, F.call_function("div", a, b)).cast(kind)


def ieee_divide(a: Column, b: Column) -> Column:
    """Division of doubles: x / 0 is an infinity or NaN, never null unless an operand is."""
    nan, inf = F.lit(float("nan")), F.lit(float("inf"))
    by_zero = F.when((a == 0) | F.isnan(a), nan).when(a > 0, inf).otherwise(-inf)
    return F.when(a.isNull() | b.isNull(), F.lit(None).cast("double")).when(b == 0, by_zero).otherwise(a / b)


def modulo(a: Column, b: Column) -> Column:
    """Remainder with the dividend's sign; null for a zero divisor."""
    return F.try_mod(a, b)


def cast_or(x: Column, kind: str, other) -> Column:
    """A string's value of type kind; other if it has none; null for null."""
    return F.when(x.isNotNull(), F.coalesce(x.try_cast(kind), F.lit(other).cast(kind)))


def truth(x: Column) -> Column:
    """A string as BOOLEAN: true for 'true' alone, null for null."""
    return F.when(x.isNotNull(), F.lower(x) == "true")


def timestamp_text(ts: Column) -> Column:
    """A timestamp as text, without its fraction."""
    return F.date_format(ts, "yyyy-MM-dd HH:mm:ss")


def to_millis(ts: Column) -> Column:
    """A timestamp rounded to milliseconds."""
    return F.date_trunc("MILLISECOND", ts + F.expr("INTERVAL '0.0005' SECOND"))


def decade(x: Column) -> Column:
    return F.call_function("div", F.year(x), F.lit(10)).cast("bigint")


def century(x: Column) -> Column:
    return F.call_function("div", F.year(x) + 99, F.lit(100)).cast("bigint")


def millennium(x: Column) -> Column:
    return F.call_function("div", F.year(x) + 999, F.lit(1000)).cast("bigint")


def floor_week(x: Column) -> Column:
    """Midnight of the Sunday on or before x."""
    day = x.cast("date")
    return F.date_sub(day, F.dayofweek(day) - 1).cast("timestamp_ntz")


def millisecond(ts: Column) -> Column:
    """Milliseconds within the minute, seconds included."""
    return F.floor(F.extract(F.lit("second"), ts) * 1000).cast("bigint")


def epoch(ts: Column) -> Column:
    """Whole seconds since 1970, cut toward zero."""
    return F.unix_timestamp(ts.cast("timestamp"))


def cardinality(a: Column) -> Column:
    return F.when(a.isNotNull(), F.size(a))


def element(a: Column) -> Column:
    """The element of an array of one; null for any other."""
    return F.when(F.size(a) == 1, F.get(a, F.lit(0)))


def at(a: Column, i: Column) -> Column:
    """The i-th element, from 1; null where there is none."""
    return F.when(i >= 1, F.get(a, (i - 1).cast("int")))


def point(x: Column, y: Column) -> Column:
    return F.when(x.isNotNull() & y.isNotNull(), F.struct(x.cast("double").alias("x"), y.cast("double").alias("y")))


def distance(p: Column, q: Column) -> Column:
    return F.sqrt(F.pow(p["x"] - q["x"], F.lit(2)) + F.pow(p["y"] - q["y"], F.lit(2)))


def average_int(x: Column) -> Column:
    """An aggregate: the mean of integers as an integer, cut toward zero."""
    return F.when(F.count(x) > 0, F.call_function("div", F.sum(x), F.count(x)))


#: SQL functions of programs; they are expanded into the plan, so Catalyst sees through them.
MACROS = [
    "CREATE OR REPLACE TEMPORARY FUNCTION st_point(x DOUBLE, y DOUBLE) RETURNS STRUCT<x: DOUBLE, y: DOUBLE> RETURN IF(x IS NULL OR y IS NULL, NULL, named_struct('x', x, 'y', y))",
    "CREATE OR REPLACE TEMPORARY FUNCTION st_distance(p STRUCT<x: DOUBLE, y: DOUBLE>, q STRUCT<x: DOUBLE, y: DOUBLE>) RETURNS DOUBLE RETURN sqrt(pow(p.x - q.x, 2) + pow(p.y - q.y, 2))",
    "CREATE OR REPLACE TEMPORARY FUNCTION floor_week(t TIMESTAMP_NTZ) RETURNS TIMESTAMP_NTZ RETURN CAST(date_sub(CAST(t AS DATE), dayofweek(t) - 1) AS TIMESTAMP_NTZ)",
    "CREATE OR REPLACE TEMPORARY FUNCTION ieee_division(a DOUBLE, b DOUBLE) RETURNS DOUBLE RETURN CASE WHEN a IS NULL OR b IS NULL THEN NULL WHEN b = 0 THEN CASE WHEN a = 0 OR isnan(a) THEN double('NaN') WHEN a > 0 THEN double('Infinity') ELSE double('-Infinity') END ELSE a / b END",
]


def register(spark) -> None:
    for macro in MACROS:
        spark.sql(macro)
