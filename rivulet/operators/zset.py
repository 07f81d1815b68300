"""Z-sets: tables whose rows carry a signed weight in column __w."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

W = "__w"


def weighted(df: DataFrame, weight: int = 1) -> DataFrame:
    """A plain table as a Z-set; one that has weights stays as it is."""
    return df if W in df.columns else df.withColumn(W, F.lit(weight).cast("bigint"))


def columns(z: DataFrame) -> list[str]:
    return [c for c in z.columns if c != W]


def empty(spark: SparkSession, schema: T.StructType) -> DataFrame:
    """No rows, in a form from which Catalyst sees that there are none."""
    fields = [f for f in schema.fields if f.name != W]
    return spark.range(1).where(F.lit(False)).select(*(F.lit(None).cast(f.dataType).alias(f.name) for f in fields), F.lit(0).cast("bigint").alias(W))


def consolidate(z: DataFrame) -> DataFrame:
    """One row for each value, with the sum of its weights; zero weights go."""
    names = columns(z)
    return z.groupBy(*(F.col(f"`{c}`") for c in names)).agg(F.sum(W).alias(W)).where(F.col(W) != 0)


def plus(*zs: DataFrame) -> DataFrame:
    """The sum: all rows of all (UNION ALL)."""
    out = zs[0]
    for z in zs[1:]:
        out = out.unionByName(z.select(out.columns))
    return out


def negate(z: DataFrame) -> DataFrame:
    return z.withColumn(W, -F.col(W))


def minus(a: DataFrame, b: DataFrame) -> DataFrame:
    return plus(a, negate(b))


def distinct(z: DataFrame) -> DataFrame:
    """Weight 1 for each row of positive weight."""
    return consolidate(z).where(F.col(W) > 0).withColumn(W, F.lit(1).cast("bigint"))


def rows(z: DataFrame) -> DataFrame:
    """The plain table: each row as often as its weight says. A negative weight is an error."""
    n = F.when(F.col(W) < 0, F.raise_error(F.lit("a row was deleted more often than inserted"))).otherwise(F.col(W))
    repeated = F.when(n > 0, F.sequence(F.lit(1).cast("bigint"), n)).otherwise(F.array().cast("array<bigint>"))
    return z.withColumn(W, F.explode(repeated)).drop(W)


def from_rows(spark: SparkSession, data: list, schema: T.StructType | str, weight: int = 1) -> DataFrame:
    return weighted(spark.createDataFrame(data, schema), weight)


def integrate(changes: list[DataFrame]) -> DataFrame:
    """The state that a run of changes leads to."""
    return consolidate(plus(*changes))


def differentiate(now: DataFrame, before: DataFrame) -> DataFrame:
    """The change from one state to another."""
    return consolidate(minus(now, before))
