"""Views that are maintained from changes; each is compared with the same view over the final tables.

A table comes in three steps: most rows, then rows that do not stay together with the
rest, then the deletion of those. The sum of a view's changes must be the view.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rivulet.operators import zset
from rivulet.operators.incremental import Constant, Node, Scan, Views
from rivulet.plans.program import Program
from rivulet.session import engine_session, list_names, shared_path
from rivulet.sources import files
from rivulet.streaming import driver


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _steps(df: DataFrame, key: str) -> list[DataFrame]:
    """Three changes whose sum is df: two parts of it with rows beside them, then those rows' deletion."""
    part = F.pmod(F.xxhash64(key), F.lit(10))
    beside = df.where(part >= 7).withColumn(key, F.col(key) + 1_000_000_000)
    return [df.where(part < 5), zset.plus(zset.weighted(df.where(part >= 5)), zset.weighted(beside)), zset.weighted(beside, -1)]


KEYS = {"lineitem": "l_orderkey", "orders": "o_orderkey", "customer": "c_custkey", "events": "event_id", "embeddings": "vec_id"}


def maintained(tables: list[str], make: Callable[..., Node]) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        session = engine_session(spark)
        frames = {t: _read(session, sf_dir, t) for t in tables}
        views = Views(session, {"v": make(*(Scan(t) for t in tables))}, {t: f.schema for t, f in frames.items()})
        changes = {t: _steps(f, KEYS[t]) for t, f in frames.items()}
        outs = [views.step({t: c[i] for t, c in changes.items()})["v"] for i in range(3)]
        return zset.rows(zset.consolidate(zset.plus(*outs)))

    return query


def _program(sql: str, tables: list[str]) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        p = Program(spark)
        frames = {t: _read(p.spark, sf_dir, t) for t in tables}
        for t, f in frames.items():
            p.table(t, f.schema)
        p.sql(sql)
        changes = {t: _steps(f, KEYS[t]) for t, f in frames.items()}
        outs = [p.step({t: c[i] for t, c in changes.items()}) for i in range(3)]
        last = list(p.views)[-1]
        return zset.rows(zset.consolidate(zset.plus(*(o[last] for o in outs))))

    return query


def _consolidated(spark: SparkSession, sf_dir: str) -> DataFrame:
    changes = _steps(_read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), "o_orderkey")
    return zset.rows(zset.consolidate(zset.plus(*(zset.weighted(c) for c in changes))))


def _algebra(spark: SparkSession, sf_dir: str) -> DataFrame:
    z = zset.weighted(_read(spark, sf_dir, "customer").select("c_nationkey"))
    return zset.consolidate(zset.minus(zset.plus(z, z), zset.negate(zset.distinct(z)))).select("c_nationkey", F.col(zset.W).alias("w"))


def _differentiated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The integral of changes, and the change between two states, put together again."""
    changes = [zset.weighted(c) for c in _steps(_read(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), "c_custkey")]
    first, last = zset.integrate(changes[:1]), zset.integrate(changes)
    return zset.rows(zset.integrate([first, zset.differentiate(last, first)]))


def _constant(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that come with the first step and never change, beside a table's."""
    session = engine_session(spark)
    nation = _read(session, sf_dir, "nation").select("n_name")
    node = Scan("nation").union_all(Constant(lambda s: s.sql("SELECT 'nowhere' AS n_name")))
    views = Views(session, {"v": node}, {"nation": nation.schema})
    outs = [views.step(d)["v"] for d in ({"nation": nation}, {}, {"nation": zset.weighted(nation.where("n_name < 'C'"), -1)})]
    return zset.rows(zset.integrate(outs))


def _declared(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DDL, INSERT of values and of a table, views with column lists, a view that is not an output."""
    p = Program(spark)
    p.read("region", f"{sf_dir}/region.parquet")
    p.sql("""
        CREATE TABLE t (id INT NOT NULL, d DECIMAL(6, 2), s VARCHAR(2), on_day DATE);
        INSERT INTO t VALUES (1, 1.25, 'long text', '2024-02-29'), (2, NULL, NULL, '2023-02-29');
        INSERT INTO t (s, id, on_day, d) VALUES ('x', 3, NULL, 2);
        INSERT INTO t SELECT * FROM t;
    """)
    p.sql("CREATE VIEW inner_view (k, n) AS SELECT id, count(*) FROM t GROUP BY id", output=False)
    p.sql("CREATE VIEW v AS SELECT k, n, r_name, CAST(d AS DECIMAL(6, 2)) AS d, s, CAST(on_day AS STRING) AS on_day FROM inner_view JOIN region ON k = r_regionkey JOIN (SELECT DISTINCT * FROM t) x ON id = k")
    return p.output("v")


def _csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table written as CSV and read with its declared schema."""
    df = _read(spark, sf_dir, "customer").withColumn("c_mktsegment", F.expr("nullif(c_mktsegment, 'BUILDING')"))
    path = shared_path(spark, "csv")
    files.write_csv(df, path)
    return files.read_csv(spark, path, df.schema)


def _streamed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A view over a stream of files: two insertions and a deletion. The files of each are a step, which a stream takes that goes on from the one before."""
    session = engine_session(spark)
    orders = _read(session, sf_dir, "orders").select("o_orderkey", "o_custkey")
    path, checkpoint = shared_path(session, "changes"), shared_path(session, "stream")
    views = Views(session, {"v": Scan("orders").aggregate(["o_custkey"], n="count(*)")}, {"orders": orders.schema})
    outs: list[DataFrame] = []
    for i, c in enumerate(_steps(orders, "o_orderkey")):
        zset.weighted(c).write.parquet(f"{path}/{i}")
        number = max(1, len(list_names(session, f"{path}/{i}")))
        driver.run_files(session, views, "orders", f"{path}/*", zset.weighted(orders).schema, lambda _, out: outs.append(out["v"]), checkpoint, number)
    return zset.rows(zset.integrate(outs))


_JOIN = "SELECT o_orderkey, l_linenumber, o_orderstatus FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE l_quantity > 40"

QUERIES = {
    "zset_consolidate": (_consolidated, "SELECT o_orderkey, o_custkey FROM orders"),
    "zset_algebra": (_algebra, "SELECT c_nationkey, CAST(2 * count(*) + 1 AS BIGINT) AS w FROM customer GROUP BY c_nationkey"),
    "zset_integrate_differentiate": (_differentiated, "SELECT c_custkey, c_nationkey FROM customer"),
    "inc_constant": (_constant, "SELECT n_name FROM nation WHERE n_name >= 'C' UNION ALL SELECT 'nowhere'"),
    "program_ddl_insert": (_declared, "SELECT CAST(k AS INTEGER) AS k, CAST(2 AS BIGINT) AS n, r_name, CAST(d AS DECIMAL(6, 2)) AS d, s, on_day FROM (VALUES (1, 1.25, 'long text', '2024-02-29'), (2, NULL, NULL, NULL), (3, 2, 'x', NULL)) t(k, d, s, on_day) JOIN region ON k = r_regionkey"),
    "csv_round_trip": (_csv, "SELECT c_custkey, c_name, c_nationkey, c_acctbal, nullif(c_mktsegment, 'BUILDING') AS c_mktsegment FROM customer"),
    "stream_files_view": (_streamed, "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey"),
    "inc_filter_project": (maintained(["orders"], lambda o: o.where("o_totalprice > 100000").select("o_orderkey", "o_orderstatus || '!' AS s")), "SELECT o_orderkey, o_orderstatus || '!' AS s FROM orders WHERE o_totalprice > 100000"),
    "inc_union_all": (maintained(["orders"], lambda o: o.select("o_orderkey AS k").union_all(o.where("o_orderstatus = 'F'").select("o_orderkey AS k"))), "SELECT o_orderkey AS k FROM orders UNION ALL SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F'"),
    "inc_union": (maintained(["orders"], lambda o: o.select("o_orderstatus AS k").union(o.select("o_orderpriority AS k"))), "SELECT o_orderstatus AS k FROM orders UNION SELECT o_orderpriority FROM orders"),
    "inc_unnest": (maintained(["embeddings"], lambda e: e.select("vec_id", "embedding AS a").unnest("a", "x", "i").select("vec_id", "x", "i")), "SELECT vec_id, unnest(embedding) AS x, CAST(unnest(range(1, len(embedding) + 1)) AS INTEGER) AS i FROM embeddings"),
    "inc_join": (maintained(["orders", "lineitem"], lambda o, li: o.select("o_orderkey", "o_orderstatus").join(li.where("l_quantity > 40").select("l_orderkey", "l_linenumber"), [("o_orderkey", "l_orderkey")]).select("o_orderkey", "l_linenumber", "o_orderstatus")), _JOIN),
    "inc_outer_join": (maintained(["customer", "orders"], lambda c, o: c.select("c_custkey").outer_join(o.where("o_totalprice > 250000").select("o_orderkey", "o_custkey"), [("c_custkey", "o_custkey")]).select("c_custkey", "o_orderkey")), "SELECT c_custkey, o_orderkey FROM customer LEFT JOIN (SELECT * FROM orders WHERE o_totalprice > 250000) ON c_custkey = o_custkey"),
    "inc_full_join": (maintained(["customer", "orders"], lambda c, o: c.where("c_acctbal > 0").select("c_custkey").outer_join(o.where("o_totalprice > 250000").select("o_orderkey", "o_custkey"), [("c_custkey", "o_custkey")], "full").select("c_custkey", "o_orderkey")), "SELECT c_custkey, o_orderkey FROM (SELECT * FROM customer WHERE c_acctbal > 0) FULL JOIN (SELECT * FROM orders WHERE o_totalprice > 250000) ON c_custkey = o_custkey"),
    "inc_distinct": (maintained(["lineitem"], lambda li: li.select("l_suppkey", "l_returnflag").distinct()), "SELECT DISTINCT l_suppkey, l_returnflag FROM lineitem"),
    "inc_aggregate": (maintained(["lineitem"], lambda li: li.select("l_suppkey", "l_linenumber", "CAST(l_quantity AS DECIMAL(12, 2)) AS q", "NULLIF(l_returnflag, 'R') AS f").aggregate(["l_suppkey"], n="count(*)", c="count(f)", s="sum(l_linenumber)", a="avg(l_linenumber)")), "SELECT l_suppkey, count(*) AS n, count(NULLIF(l_returnflag, 'R')) AS c, CAST(sum(l_linenumber) AS BIGINT) AS s, avg(l_linenumber) AS a FROM lineitem GROUP BY l_suppkey"),
    "inc_aggregate_float": (maintained(["lineitem"], lambda li: li.select("l_returnflag", "l_quantity").aggregate(["l_returnflag"], s="sum(l_quantity)").select("l_returnflag", "round(s, 2) AS s")), "SELECT l_returnflag, round(sum(l_quantity), 2) AS s FROM lineitem GROUP BY l_returnflag"),
    "inc_min_max": (maintained(["lineitem"], lambda li: li.select("l_suppkey", "l_extendedprice").aggregate(["l_suppkey"], lo="min(l_extendedprice)", hi="max(l_extendedprice)")), "SELECT l_suppkey, min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM lineitem GROUP BY l_suppkey"),
    "inc_count_distinct": (maintained(["lineitem"], lambda li: li.select("l_returnflag", "l_suppkey").aggregate(["l_returnflag"], d="count(DISTINCT l_suppkey)")), "SELECT l_returnflag, count(DISTINCT l_suppkey) AS d FROM lineitem GROUP BY l_returnflag"),
    "inc_global": (maintained(["lineitem"], lambda li: li.select("l_linenumber").aggregate([], n="count(*)", s="sum(l_linenumber)")), "SELECT count(*) AS n, CAST(sum(l_linenumber) AS BIGINT) AS s FROM lineitem"),
    "inc_global_empty": (maintained(["lineitem"], lambda li: li.where("l_linenumber < 0").select("l_linenumber").aggregate([], n="count(*)", s="sum(l_linenumber)")), "SELECT CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS s"),
    "inc_window": (maintained(["events"], lambda e: e.select("event_id", "user_id", "value", "unix_timestamp(CAST(ts AS TIMESTAMP)) AS t").window(["user_id"], c="count(*) OVER (PARTITION BY user_id ORDER BY t RANGE BETWEEN 86400 PRECEDING AND CURRENT ROW)").select("event_id", "c")), "SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY CAST(epoch(date_trunc('second', ts)) AS BIGINT) RANGE BETWEEN 86400 PRECEDING AND CURRENT ROW) AS c FROM events"),
    "inc_top_k": (maintained(["orders"], lambda o: o.select("o_custkey", "o_orderkey", "o_totalprice").top(["o_custkey"], ["o_totalprice DESC", "o_orderkey"], 2).select("o_custkey", "o_orderkey")), "SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders) WHERE r <= 2"),
    "inc_except": (maintained(["customer", "orders"], lambda c, o: c.select("c_custkey AS k").except_(o.where("o_totalprice > 300000").select("o_custkey AS k"))), "SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_totalprice > 300000"),
    "inc_except_all": (maintained(["customer", "orders"], lambda c, o: o.select("o_custkey AS k").except_(c.select("c_custkey AS k"), all=True)), "SELECT o_custkey AS k FROM orders EXCEPT ALL SELECT c_custkey FROM customer"),
    "inc_intersect": (maintained(["customer", "orders"], lambda c, o: c.select("c_custkey AS k").intersect(o.select("o_custkey AS k"))), "SELECT c_custkey AS k FROM customer INTERSECT SELECT o_custkey FROM orders"),
    "inc_view_on_view": (maintained(["orders"], lambda o: o.select("o_custkey", "o_orderkey").aggregate(["o_custkey"], n="count(*)").aggregate(["n"], c="count(*)")), "SELECT n, count(*) AS c FROM (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey) GROUP BY n"),
    "program_step_join": (_program(f"CREATE VIEW v AS {_JOIN}", ["orders", "lineitem"]), _JOIN),
    "program_step_nested_views": (_program("CREATE VIEW big AS SELECT o_custkey, o_totalprice FROM orders WHERE o_totalprice > 150000; CREATE VIEW v AS SELECT o_custkey, count(*) AS n FROM big GROUP BY o_custkey HAVING count(*) > 2", ["orders"]), "SELECT o_custkey, count(*) AS n FROM orders WHERE o_totalprice > 150000 GROUP BY o_custkey HAVING count(*) > 2"),
}

#: SQL views that are maintained step by step: the view, its tables, and DuckDB's SQL where it isn't the same.
_STEPS = {
    "distinct": ("SELECT DISTINCT l_suppkey, l_returnflag FROM lineitem", ["lineitem"], None),
    "union": ("SELECT o_custkey AS k FROM orders UNION SELECT c_custkey + 100000 FROM customer", ["orders", "customer"], None),
    "left_join": ("SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_totalprice > 250000", ["customer", "orders"], None),
    "full_join": ("SELECT c_custkey, o_orderkey FROM (SELECT * FROM customer WHERE c_acctbal > 0) c FULL JOIN (SELECT * FROM orders WHERE o_totalprice > 250000) o ON c_custkey = o_custkey", ["customer", "orders"], None),
    "having": ("SELECT o_custkey, count(*) AS n, max(o_orderkey) AS m FROM orders GROUP BY o_custkey HAVING count(*) > 12", ["orders"], None),
    "over": ("SELECT o_orderkey, count(*) OVER (PARTITION BY o_custkey ORDER BY o_orderdate RANGE UNBOUNDED PRECEDING) AS n FROM orders", ["orders"], None),
    "top_per_group": ("SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders) x WHERE r <= 2", ["orders"], None),
    "except": ("SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_totalprice > 300000", ["customer", "orders"], None),
    "except_all": ("SELECT o_custkey AS k FROM orders EXCEPT ALL SELECT c_custkey FROM customer", ["orders", "customer"], None),
    "in": ("SELECT o_orderkey, o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 5000) AS i FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')", ["orders", "customer"], None),
    "correlated": ("SELECT c_custkey, (SELECT max(o_orderkey) FROM orders WHERE o_custkey = c_custkey) AS m FROM customer", ["customer", "orders"], None),
    "scalar": ("SELECT o_orderkey FROM orders WHERE o_orderkey > (SELECT avg(c_custkey) * 20 FROM customer)", ["orders", "customer"], None),
    "self_join": ("SELECT a.o_orderkey, b.o_orderkey AS other FROM orders a JOIN orders b ON a.o_custkey = b.o_custkey AND a.o_orderdate < b.o_orderdate", ["orders"], None),
    "rollup": ("SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)", ["lineitem"], None),
    "unnest": ("SELECT vec_id, x FROM embeddings e, UNNEST(e.embedding) AS t(x)", ["embeddings"], "SELECT vec_id, unnest(embedding) AS x FROM embeddings"),
    "expression_over_sums": ("SELECT o_custkey, sum(o_orderkey) / count(*) AS m FROM orders GROUP BY o_custkey", ["orders"], "SELECT o_custkey, CAST(sum(o_orderkey) // count(*) AS BIGINT) AS m FROM orders GROUP BY o_custkey"),
}
for _name, (_sql, _tables, _duck) in _STEPS.items():
    QUERIES[f"program_step_{_name}"] = (_program(f"CREATE VIEW v AS {_sql}", _tables), _duck or _sql)


def _redeclared(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table with another one's schema, and one that is dropped and declared anew."""
    p = Program(spark)
    p.read("region", f"{sf_dir}/region.parquet")
    p.sql("""
        CREATE TABLE likewise AS SELECT r_regionkey, r_name FROM region;
        INSERT INTO likewise VALUES (7, 'NOWHERE');
        CREATE TABLE gone (a INT);
        DROP TABLE gone;
        CREATE TABLE gone (r_regionkey INT, r_name VARCHAR);
        INSERT INTO gone SELECT * FROM region;
        CREATE VIEW v AS SELECT * FROM likewise UNION ALL SELECT r_regionkey, r_name FROM gone
    """)
    return p.output("v")


QUERIES["program_ctas_drop"] = (_redeclared, "SELECT r_regionkey, r_name FROM region UNION ALL SELECT 7, 'NOWHERE'")


def queries() -> dict:
    return {n: q for n, (q, _) in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {n: sql for n, (_, sql) in QUERIES.items()}
