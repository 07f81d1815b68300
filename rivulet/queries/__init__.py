"""Queries of the engine's operators, each with its DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from rivulet.plans.program import Program
from rivulet.queries import incremental, sqlviews

FLAGSHIP = """
CREATE VIEW sales AS
  SELECT n_name, l_extendedprice * (1 - l_discount) AS revenue, o_orderkey
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
  WHERE o_totalprice > 50000;
CREATE VIEW by_nation AS
  SELECT n_name, count(*) AS n, ROUND(sum(revenue), 2) AS revenue, count(DISTINCT o_orderkey) AS orders FROM sales GROUP BY n_name;
"""
FLAGSHIP_SQL = """
SELECT n_name, count(*) AS n, ROUND(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(DISTINCT o_orderkey) AS orders
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
WHERE o_totalprice > 50000 GROUP BY n_name
"""


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A program of two views over four tables."""
    program = Program(spark)
    for t in ("lineitem", "orders", "customer", "nation"):
        program.read(t, f"{sf_dir}/{t}.parquet")
    program.sql(FLAGSHIP)
    return program.output("by_nation")


def queries() -> dict:
    return {"nested_views": flagship} | sqlviews.queries() | incremental.queries()


def oracle_sql() -> dict[str, str]:
    return {"nested_views": FLAGSHIP_SQL} | sqlviews.oracle_sql() | incremental.oracle_sql()
