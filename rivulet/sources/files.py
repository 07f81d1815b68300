"""Tables from files and databases, and to files."""

from __future__ import annotations

import sqlite3

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Comma-separated, no header, empty fields null; the schema is declared, never guessed."""
    return spark.read.schema(schema).option("header", False).option("nullValue", "").option("ignoreLeadingWhiteSpace", True).csv(path)


def write_csv(df: DataFrame, path: str, null: str = "") -> None:
    """Comma-separated, no header, strings in double quotes, nulls as given."""
    text = [F.col(f"`{f.name}`") if isinstance(f.dataType, T.StringType) else F.col(f"`{f.name}`").cast("string") for f in df.schema]
    quoted = [F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"')) if isinstance(f.dataType, T.StringType) else c for c, f in zip(text, df.schema, strict=True)]
    df.select(F.concat_ws(",", *(F.coalesce(c, F.lit(null)) for c in quoted)).alias("value")).write.text(path)


def read_jdbc(spark: SparkSession, url: str, table: str, **options: str) -> DataFrame:
    """A database table through its JDBC driver; partitionColumn and bounds in options split the read."""
    return spark.read.format("jdbc").options(url=url, dbtable=table, **options).load()


def read_sqlite(spark: SparkSession, path: str, table: str, schema: T.StructType, parts: int = 8) -> DataFrame:
    """A table of a SQLite file that all executors can open, read in ranges of its row numbers."""
    names = [f.name for f in schema]
    with sqlite3.connect(path) as db:
        low, high = db.execute(f'SELECT min(rowid), max(rowid) FROM "{table}"').fetchone()
    if low is None:
        return spark.createDataFrame([], schema)
    step = max(1, -(-(high - low + 1) // parts))
    ranges = spark.range(low, high + 1, step, parts)
    logical = [isinstance(f.dataType, T.BooleanType) for f in schema]

    def rows(batches):
        import pandas as pd

        for pdf in batches:
            with sqlite3.connect(f"file:{path}?mode=ro", uri=True) as db:
                for a in pdf["id"]:
                    got = db.execute(f'SELECT {", ".join(names)} FROM "{table}" WHERE rowid >= ? AND rowid < ?', (int(a), int(a) + step)).fetchall()
                    yield pd.DataFrame([[None if v is None else bool(v) if b else v for v, b in zip(r, logical, strict=True)] for r in got], columns=names)

    return ranges.mapInPandas(rows, schema)
