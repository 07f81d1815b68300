"""Queries that are SQL views of a program, in the engine's dialect, with the same in DuckDB's."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from rivulet.plans.program import Program

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "embeddings")

#: name -> (dialect, DuckDB or None where both read the same)
QUERIES: dict[str, tuple[str, str | None]] = {}


def add(name: str, sql: str, duck: str | None = None) -> None:
    QUERIES[name] = (sql, duck)


# --- scans, projections, filters ---
add("scan_project", "SELECT l_orderkey, l_linenumber, l_quantity * 2 AS q2 FROM lineitem")
add("filter_comparison", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 250000 AND o_orderstatus <> 'F'")
add("filter_null_semantics", "SELECT o_orderkey FROM orders WHERE NULLIF(o_orderstatus, 'O') = 'F' OR (NULLIF(o_orderstatus, 'O') IS NULL AND NOT (NULLIF(o_orderpriority, '1-URGENT') = '5-LOW'))")
add("filter_between", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity BETWEEN 10 AND 12 AND l_discount NOT BETWEEN 0.02 AND 0.08")
add("filter_in_list", "SELECT c_custkey FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') AND c_nationkey NOT IN (1, 2, 3)")
add("distinct_rows", "SELECT DISTINCT c_nationkey, c_mktsegment FROM customer")
add("case_searched", "SELECT o_orderkey, CASE WHEN o_totalprice > 300000 THEN 'high' WHEN o_totalprice > 100000 THEN 'mid' ELSE 'low' END AS band FROM orders")
add("case_switched", "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 END AS code FROM orders")
add("coalesce_nullif", "SELECT o_orderkey, COALESCE(NULLIF(o_orderstatus, 'F'), 'none') AS s FROM orders")
add("cte", "WITH big AS (SELECT o_custkey, o_totalprice FROM orders WHERE o_totalprice > 200000), n AS (SELECT o_custkey, count(*) AS c FROM big GROUP BY o_custkey) SELECT * FROM n WHERE c > 1")
add("values_constant", "SELECT a, b FROM (VALUES (1, 'x'), (2, NULL), (3, 'z')) AS t(a, b)")
add("select_constant", "SELECT 0 AS zero, 'a' || 'b' AS ab, 1 + 2 AS three")

# --- arithmetic ---
add("arith_int_div", "SELECT l_orderkey, l_linenumber, l_linenumber / 2 AS d, (l_orderkey - 100) / 7 AS e FROM lineitem", "SELECT l_orderkey, l_linenumber, l_linenumber // 2 AS d, CAST(trunc((l_orderkey - 100) / 7.0) AS BIGINT) AS e FROM lineitem")
add("arith_div_by_zero", "SELECT l_orderkey, l_linenumber, 10 / (l_linenumber - 1) AS d FROM lineitem", "SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber = 1 THEN NULL ELSE 10 // (l_linenumber - 1) END AS d FROM lineitem")
add("arith_mod", "SELECT l_orderkey, l_linenumber, MOD(l_orderkey, 7) AS m, (l_linenumber - 4) % 3 AS s FROM lineitem")
add("arith_mod_zero", "SELECT l_orderkey, l_linenumber, MOD(l_orderkey, l_linenumber - 1) AS m FROM lineitem", "SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber = 1 THEN NULL ELSE l_orderkey % (l_linenumber - 1) END AS m FROM lineitem")
add("arith_wraps", "SELECT o_orderkey, CAST(2147483647 + CAST(o_orderkey AS INT) AS INT) AS w FROM orders", "SELECT o_orderkey, CAST((2147483647 + o_orderkey + 2147483648) % 4294967296 - 2147483648 AS INTEGER) AS w FROM orders")
add("arith_decimal", "SELECT l_orderkey, l_linenumber, CAST(CAST(l_extendedprice AS DECIMAL(12, 2)) * CAST(l_discount AS DECIMAL(4, 2)) AS DECIMAL(18, 4)) AS v FROM lineitem")
add("float_div_ieee", "SELECT l_orderkey, l_linenumber, CASE WHEN CAST(l_linenumber AS DOUBLE) / (l_linenumber - 1) > 1e300 THEN 'inf' ELSE 'finite' END AS k, CASE WHEN isnan((l_linenumber - 1) / CAST(l_linenumber - 1 AS DOUBLE)) THEN 'nan' ELSE 'number' END AS z FROM lineitem", "SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber = 1 THEN 'inf' ELSE 'finite' END AS k, CASE WHEN l_linenumber = 1 THEN 'nan' ELSE 'number' END AS z FROM lineitem")
add("unary_bits", "SELECT l_orderkey, l_linenumber, -l_linenumber AS n, +l_orderkey AS p, l_orderkey & 6 AS a, l_orderkey | 1 AS o, shiftleft(l_orderkey, 2) AS s FROM lineitem", "SELECT l_orderkey, l_linenumber, -l_linenumber AS n, l_orderkey AS p, l_orderkey & 6 AS a, l_orderkey | 1 AS o, l_orderkey << 2 AS s FROM lineitem")
add("round_abs_ln_log10_power_sqrt", "SELECT l_orderkey, l_linenumber, ABS(l_quantity - 25) AS a, ROUND(LN(l_quantity), 6) AS l, ROUND(LOG10(l_quantity), 6) AS g, POWER(l_linenumber, 2) AS p, ROUND(SQRT(l_quantity), 6) AS s, ROUND(CAST(l_extendedprice AS DECIMAL(12, 2)), 1) AS r FROM lineitem")
add("concat_null", "SELECT c_custkey, c_name || '/' || NULLIF(c_mktsegment, 'BUILDING') AS s FROM customer")
add("is_distinct", "SELECT o_orderkey, NULLIF(o_orderstatus, 'F') IS DISTINCT FROM NULLIF(o_orderstatus, 'O') AS d, NULLIF(o_orderstatus, 'F') IS NOT DISTINCT FROM NULL AS n FROM orders")
add("is_true_family", "SELECT o_orderkey, (NULLIF(o_orderstatus, 'F') = 'O') IS TRUE AS t, (NULLIF(o_orderstatus, 'F') = 'O') IS NOT TRUE AS nt, (NULLIF(o_orderstatus, 'F') = 'O') IS FALSE AS f, (NULLIF(o_orderstatus, 'F') = 'O') IS NOT FALSE AS nf FROM orders")
add("boolean_3vl", "SELECT o_orderkey, (NULLIF(o_orderstatus, 'F') = 'O') AND o_totalprice > 100000 AS a, (NULLIF(o_orderstatus, 'F') = 'O') OR o_totalprice > 100000 AS o, NOT (NULLIF(o_orderstatus, 'F') = 'O') AS n FROM orders")
add("cast_matrix", "SELECT l_orderkey, l_linenumber, CAST(l_quantity AS INT) AS i, CAST(l_linenumber AS STRING) AS s, CAST(CAST(l_orderkey AS STRING) AS BIGINT) AS b, CAST(l_linenumber - 1 AS BOOLEAN) AS t, CAST(l_linenumber > 2 AS INT) AS f, CAST(l_discount AS DECIMAL(5, 3)) AS d FROM lineitem", "SELECT l_orderkey, l_linenumber, CAST(trunc(l_quantity) AS INTEGER) AS i, CAST(l_linenumber AS VARCHAR) AS s, CAST(CAST(l_orderkey AS VARCHAR) AS BIGINT) AS b, CAST(l_linenumber - 1 AS BOOLEAN) AS t, CAST(l_linenumber > 2 AS INTEGER) AS f, CAST(l_discount AS DECIMAL(5, 3)) AS d FROM lineitem")
add("cast_bad_text", "SELECT c_custkey, CAST(CAST(c_mktsegment AS DATE) AS STRING) AS d, CAST(CAST('1997-02-29' AS DATE) AS STRING) AS leap, CAST(CAST('2020-02-29' AS DATE) AS STRING) AS fine FROM customer", "SELECT c_custkey, CAST(TRY_CAST(c_mktsegment AS DATE) AS VARCHAR) AS d, CAST(TRY_CAST('1997-02-29' AS DATE) AS VARCHAR) AS leap, '2020-02-29' AS fine FROM customer")

# --- joins ---
add("inner_join", "SELECT c_custkey, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey")
add("join_residual_theta", "SELECT o_orderkey, l_linenumber FROM orders JOIN lineitem ON o_orderkey = l_orderkey AND l_extendedprice > o_totalprice / 3.0", "SELECT o_orderkey, l_linenumber FROM orders JOIN lineitem ON o_orderkey = l_orderkey AND l_extendedprice > o_totalprice / 3.0")
add("theta_join", "SELECT a.n_name AS a, b.r_name AS b FROM nation a JOIN region b ON a.n_nationkey < b.r_regionkey")
add("cross_join", "SELECT n_name, r_name FROM nation CROSS JOIN region")
add("comma_join", "SELECT n_name, r_name FROM nation, region WHERE n_regionkey = r_regionkey")
add("left_join", "SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_totalprice > 300000")
add("right_join", "SELECT s_suppkey, n_name FROM (SELECT * FROM supplier WHERE s_acctbal > 5000) s RIGHT JOIN nation ON s_nationkey = n_nationkey")
add("full_outer_join", "SELECT c_custkey, s_suppkey FROM (SELECT * FROM customer WHERE c_acctbal < 0) c FULL OUTER JOIN (SELECT * FROM supplier WHERE s_acctbal > 0) s ON c_custkey = s_suppkey")
add("self_join", "SELECT a.n_name AS a, b.n_name AS b FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey")
add("natural_using_join", "SELECT l_orderkey, o_custkey, l_linenumber FROM (SELECT o_orderkey AS l_orderkey, o_custkey FROM orders) o JOIN lineitem USING (l_orderkey) WHERE l_quantity > 48")
add("multi_join_bushy", "SELECT r_name, n_name, CAST(count(*) AS BIGINT) AS n, ROUND(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey JOIN supplier ON l_suppkey = s_suppkey AND s_nationkey = c_nationkey GROUP BY r_name, n_name")
add("semi_exists", "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 250000)")
add("anti_not_exists", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)")
add("range_join", "SELECT e.event_id, n.n_nationkey FROM events e JOIN nation n ON e.user_id % 25 = n.n_nationkey AND e.value BETWEEN n.n_regionkey * 10 AND n.n_regionkey * 10 + 20")

# --- subqueries ---
add("in_subquery", "SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
add("not_in_subquery_null", "SELECT n_nationkey FROM nation WHERE n_nationkey NOT IN (SELECT NULLIF(c_nationkey, 3) FROM customer)")
add("in_subquery_3vl", "SELECT n_nationkey, n_nationkey IN (SELECT NULLIF(r_regionkey, 2) FROM region) AS i, n_nationkey NOT IN (SELECT r_regionkey FROM region) AS j FROM nation")
add("quantified_any_all", "SELECT n_nationkey, n_nationkey > ANY (SELECT r_regionkey FROM region) AS a, n_nationkey >= ALL (SELECT r_regionkey FROM region) AS b, n_nationkey = ANY (SELECT NULLIF(r_regionkey, 1) FROM region) AS c FROM nation")
add("unique_predicate", "SELECT 'by region' AS k, UNIQUE (SELECT n_regionkey FROM nation) AS u UNION ALL SELECT 'by key', UNIQUE (SELECT n_nationkey FROM nation)", "SELECT 'by region' AS k, (SELECT count(*) = count(DISTINCT n_regionkey) FROM nation) AS u UNION ALL SELECT 'by key', (SELECT count(*) = count(DISTINCT n_nationkey) FROM nation)")
add("scalar_subquery", "SELECT o_orderkey FROM orders WHERE o_totalprice > (SELECT avg(o_totalprice) FROM orders)")
add("scalar_subquery_projected", "SELECT n_name, (SELECT max(r_regionkey) FROM region) - n_regionkey AS d FROM nation")
add("correlated_scalar", "SELECT c_custkey, (SELECT CAST(count(*) AS BIGINT) FROM orders WHERE o_custkey = c_custkey) AS n FROM customer")
add("correlated_agg_filter", "SELECT o_orderkey FROM orders o WHERE o_totalprice > (SELECT 1.5 * avg(o_totalprice) FROM orders i WHERE i.o_custkey = o.o_custkey)")

# --- aggregates ---
add("group_agg", "SELECT l_returnflag, l_linestatus, count(*) AS n, ROUND(sum(l_quantity), 2) AS q, ROUND(avg(l_discount), 6) AS d, min(l_shipdate) AS lo, max(l_extendedprice) AS hi FROM lineitem GROUP BY l_returnflag, l_linestatus")
add("group_null_key", "SELECT NULLIF(o_orderstatus, 'F') AS k, count(*) AS n FROM orders GROUP BY NULLIF(o_orderstatus, 'F')")
add("group_expression", "SELECT l_linenumber / 2 AS k, count(*) AS n FROM lineitem GROUP BY l_linenumber / 2", "SELECT l_linenumber // 2 AS k, count(*) AS n FROM lineitem GROUP BY 1")
add("global_agg", "SELECT count(*) AS n, count(NULLIF(o_orderstatus, 'F')) AS c, CAST(sum(o_orderkey) AS BIGINT) AS s, min(o_totalprice) AS lo, max(o_orderpriority) AS hi FROM orders")
add("global_agg_empty", "SELECT count(*) AS n, sum(o_totalprice) AS s, max(o_orderkey) AS m FROM orders WHERE o_orderkey < 0")
add("having", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 12")
add("count_distinct", "SELECT l_returnflag, count(DISTINCT l_suppkey) AS s FROM lineitem GROUP BY l_returnflag")
add("sum_distinct", "SELECT l_returnflag, CAST(sum(DISTINCT l_linenumber) AS BIGINT) AS s FROM lineitem GROUP BY l_returnflag")
add("multi_distinct", "SELECT count(DISTINCT l_suppkey) AS a, count(DISTINCT l_partkey) AS b, count(*) AS c, CAST(sum(DISTINCT l_linenumber) AS BIGINT) AS d FROM lineitem")
add("constant_agg", "SELECT max(6) AS m, 34 / sum(1) AS d FROM region", "SELECT max(6) AS m, CAST(34 // sum(1) AS BIGINT) AS d FROM region")
add("group_without_agg", "SELECT p_brand FROM part GROUP BY p_brand")
add("nested_aggregates", "SELECT avg(n) AS a, max(n) AS m FROM (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey) x")
add("avg_int", "SELECT l_returnflag, sum(l_linenumber) div count(l_linenumber) AS a FROM lineitem GROUP BY l_returnflag", "SELECT l_returnflag, CAST(sum(l_linenumber) // count(l_linenumber) AS BIGINT) AS a FROM lineitem GROUP BY l_returnflag")

# --- windows: RANGE frames over an integer key ---
_E = "(SELECT *, unix_timestamp(CAST(ts AS TIMESTAMP)) AS t FROM events) e"
_D = "(SELECT *, CAST(epoch(date_trunc('second', ts)) AS BIGINT) AS t FROM events) e"
for _name, _agg in (("count", "count(*)"), ("sum", "ROUND(sum(value), 2)"), ("avg", "ROUND(avg(value), 9)"), ("min", "min(value)"), ("max", "max(value)")):
    _over = "OVER (PARTITION BY user_id ORDER BY t RANGE BETWEEN 86400 PRECEDING AND CURRENT ROW)"
    _call = _agg.replace("(value)", f"(value) {_over}") if "value" in _agg else f"count(*) {_over}"
    add(f"range_window_{_name}", f"SELECT event_id, {_call} AS w FROM {_E}", f"SELECT event_id, {_call} AS w FROM {_D}")
add("two_windows", f"SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY t RANGE BETWEEN 3600 PRECEDING AND 1 PRECEDING) AS a, count(*) OVER (PARTITION BY event_type ORDER BY t RANGE BETWEEN 600 PRECEDING AND 600 FOLLOWING) AS b FROM {_E}", f"SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY t RANGE BETWEEN 3600 PRECEDING AND 1 PRECEDING) AS a, count(*) OVER (PARTITION BY event_type ORDER BY t RANGE BETWEEN 600 PRECEDING AND 600 FOLLOWING) AS b FROM {_D}")
add("window_unbounded", f"SELECT event_id, max(value) OVER (PARTITION BY user_id ORDER BY t RANGE UNBOUNDED PRECEDING) AS m FROM {_E}", f"SELECT event_id, max(value) OVER (PARTITION BY user_id ORDER BY t RANGE UNBOUNDED PRECEDING) AS m FROM {_D}")

# --- order, limits, set operations ---
add("order_multi", "SELECT o_orderstatus, o_totalprice, o_orderkey FROM orders ORDER BY o_orderstatus ASC, o_totalprice DESC, o_orderkey")
add("order_nulls", "SELECT NULLIF(o_orderstatus, 'F') AS s, o_orderkey FROM orders ORDER BY 1, 2")
add("top_k", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
add("limit_offset", "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 5 OFFSET 7")
add("union_distinct", "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
add("union_all", "SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier")
add("except_distinct", "SELECT n_nationkey AS k FROM nation EXCEPT SELECT s_nationkey FROM supplier WHERE s_acctbal > 7000")
add("except_all", "SELECT c_nationkey AS k FROM customer EXCEPT ALL SELECT s_nationkey FROM supplier")
add("intersect_distinct", "SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier")
add("intersect_all", "SELECT c_nationkey AS k FROM customer INTERSECT ALL SELECT s_nationkey FROM supplier")

# --- times ---
add("date_parts", "SELECT o_orderkey, CAST(EXTRACT(YEAR FROM o_orderdate) AS BIGINT) AS y, CAST(EXTRACT(MONTH FROM o_orderdate) AS BIGINT) AS m, CAST(EXTRACT(DAY FROM o_orderdate) AS BIGINT) AS d, CAST(EXTRACT(QUARTER FROM o_orderdate) AS BIGINT) AS q, EXTRACT(DECADE FROM o_orderdate) AS de, EXTRACT(CENTURY FROM o_orderdate) AS ce, EXTRACT(MILLENNIUM FROM o_orderdate) AS mi, EXTRACT(ISOYEAR FROM o_orderdate) AS iy, CAST(EXTRACT(WEEK FROM o_orderdate) AS BIGINT) AS w, EXTRACT(DOW FROM o_orderdate) AS dw, EXTRACT(ISODOW FROM o_orderdate) AS idw, CAST(EXTRACT(DOY FROM o_orderdate) AS BIGINT) AS dy, EXTRACT(EPOCH FROM o_orderdate) AS ep FROM orders", "SELECT o_orderkey, year(o_orderdate) AS y, month(o_orderdate) AS m, day(o_orderdate) AS d, quarter(o_orderdate) AS q, year(o_orderdate) // 10 AS de, (year(o_orderdate) + 99) // 100 AS ce, (year(o_orderdate) + 999) // 1000 AS mi, isoyear(o_orderdate) AS iy, week(o_orderdate) AS w, dayofweek(o_orderdate) + 1 AS dw, isodow(o_orderdate) AS idw, dayofyear(o_orderdate) AS dy, CAST(epoch(o_orderdate) AS BIGINT) AS ep FROM orders")
add("time_parts", "SELECT event_id, CAST(HOUR(ts) AS BIGINT) AS h, CAST(MINUTE(ts) AS BIGINT) AS m, CAST(SECOND(ts) AS BIGINT) AS s, EXTRACT(MILLISECOND FROM ts) AS ms, EXTRACT(MICROSECOND FROM ts) AS us FROM events", "SELECT event_id, hour(ts) AS h, minute(ts) AS m, second(ts) AS s, CAST(millisecond(ts) AS BIGINT) AS ms, CAST(microsecond(ts) AS BIGINT) AS us FROM events")
add("timestampadd_diff", "SELECT event_id, TIMESTAMPADD(MONTH, 2, ts) AS a, TIMESTAMPADD(SECOND, -90, ts) AS b, TIMESTAMPDIFF(HOUR, TIMESTAMP_NTZ '2024-01-01 00:00:00', ts) AS h FROM events", "SELECT event_id, ts + INTERVAL 2 MONTH AS a, ts - INTERVAL 90 SECOND AS b, CAST(trunc(epoch(ts - TIMESTAMP '2024-01-01 00:00:00') / 3600) AS BIGINT) AS h FROM events")
add("floor_week_sunday", "SELECT event_id, FLOOR(ts TO WEEK) AS w, FLOOR(ts TO HOUR) AS h, CEIL(ts TO DAY) AS d FROM events", "SELECT event_id, CAST(CAST(ts AS DATE) - CAST(dayofweek(ts) AS INTEGER) AS TIMESTAMP) AS w, date_trunc('hour', ts) AS h, CASE WHEN date_trunc('day', ts) = ts THEN ts ELSE CAST(date_trunc('day', ts) AS TIMESTAMP) + INTERVAL 1 DAY END AS d FROM events")
add("interval_arith", "SELECT o_orderkey, o_orderdate + INTERVAL 3 DAY AS a, o_orderdate - INTERVAL '2' HOUR AS b, o_orderdate + INTERVAL '1-2' YEAR TO MONTH AS c FROM orders", "SELECT o_orderkey, o_orderdate + INTERVAL 3 DAY AS a, o_orderdate - INTERVAL 2 HOUR AS b, o_orderdate + INTERVAL 14 MONTH AS c FROM orders")
add("timestamp_text", "SELECT event_id, date_format(ts, 'yyyy-MM-dd HH:mm:ss') AS s, CAST(CAST(ts AS DATE) AS STRING) AS d FROM events", "SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS s, CAST(CAST(ts AS DATE) AS VARCHAR) AS d FROM events")

# --- arrays, geometry ---
add("array_index_cardinality_element", "SELECT vec_id, CAST(embedding[1] AS DOUBLE) AS a, CAST(embedding[100000] AS DOUBLE) AS b, CARDINALITY(embedding) AS c, ARRAY[vec_id, label][2] AS d, embedding[0] IS NULL AS z FROM embeddings", "SELECT vec_id, CAST(embedding[1] AS DOUBLE) AS a, CAST(NULL AS DOUBLE) AS b, len(embedding) AS c, CAST(label AS BIGINT) AS d, true AS z FROM embeddings")
add("array_element", "SELECT label, IF(size(a) = 1, element_at(a, 1), NULL) AS e FROM (SELECT DISTINCT label, ARRAY[label] AS a FROM embeddings) x", "SELECT DISTINCT label, label AS e FROM embeddings")
add("unnest", "SELECT vec_id, x FROM embeddings e, UNNEST(e.embedding) AS t(x)", "SELECT vec_id, unnest(embedding) AS x FROM embeddings")
add("unnest_ordinality", "SELECT vec_id, x, i FROM embeddings e, UNNEST(e.embedding) WITH ORDINALITY AS t(x, i)", "SELECT vec_id, unnest(embedding) AS x, CAST(unnest(range(1, len(embedding) + 1)) AS INTEGER) AS i FROM embeddings")
add("double_unnest", "SELECT vec_id, x, y FROM embeddings e, UNNEST(e.embedding) AS t(x), UNNEST(ARRAY[e.vec_id, e.label]) AS u(y)", "SELECT vec_id, x, unnest(b) AS y FROM (SELECT vec_id, unnest(embedding) AS x, [vec_id, CAST(label AS BIGINT)] AS b FROM embeddings)")
add("geo_distance", "SELECT c_custkey, ROUND(ST_DISTANCE(ST_POINT(c_acctbal, CAST(c_nationkey AS DOUBLE)), ST_POINT(0, 0)), 6) AS d FROM customer", "SELECT c_custkey, ROUND(sqrt(pow(c_acctbal, 2) + pow(c_nationkey, 2)), 6) AS d FROM customer")

# --- beyond the core: what Spark has at hand ---
add("agg_filter", "SELECT o_custkey, count(*) FILTER (WHERE o_orderstatus = 'F') AS f, ROUND(sum(o_totalprice) FILTER (WHERE o_totalprice > 100000), 2) AS s FROM orders GROUP BY o_custkey")
add("grouping_sets", "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY GROUPING SETS ((l_returnflag), (l_linestatus), ())")
add("rollup", "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
add("cube", "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
add("row_number_topk", "SELECT o_custkey, o_orderkey, r FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders) x WHERE r <= 3", "SELECT o_custkey, o_orderkey, CAST(r AS INTEGER) AS r FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders) x WHERE r <= 3")
add("lag_lead", "SELECT event_id, lag(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p, lead(event_id, 2) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events")
add("rank_ntile", "SELECT s_suppkey, CAST(rank() OVER (ORDER BY s_nationkey) AS BIGINT) AS r, CAST(dense_rank() OVER (ORDER BY s_nationkey) AS BIGINT) AS d FROM supplier")
add("bool_aggregates", "SELECT l_returnflag, bool_or(l_quantity > 49) AS s, every(l_quantity > 0) AS e FROM lineitem GROUP BY l_returnflag", "SELECT l_returnflag, bool_or(l_quantity > 49) AS s, bool_and(l_quantity > 0) AS e FROM lineitem GROUP BY l_returnflag")
add("strings", "SELECT p_partkey, lower(p_name) AS l, upper(p_brand) AS u, regexp_extract(p_type, '([A-Z]+)', 1) AS r, split_part(p_name, ' ', 2) AS s, length(p_name) - length(replace(p_name, 'a', '')) AS a FROM part", "SELECT p_partkey, lower(p_name) AS l, upper(p_brand) AS u, regexp_extract(p_type, '([A-Z]+)', 1) AS r, split_part(p_name, ' ', 2) AS s, CAST(length(p_name) - length(replace(p_name, 'a', '')) AS INTEGER) AS a FROM part")
add("greatest_least_like", "SELECT l_orderkey, l_linenumber, GREATEST(l_quantity, 25) AS g, LEAST(l_quantity, 25) AS s FROM lineitem WHERE l_returnflag LIKE 'R%'")
add("tumble", "SELECT window_start AS s, event_type, count(*) AS n FROM TABLE(TUMBLE(TABLE events, DESCRIPTOR(ts), INTERVAL '1' HOUR)) GROUP BY window_start, event_type", "SELECT date_trunc('hour', ts) AS s, event_type, count(*) AS n FROM events GROUP BY ALL")
add("hop", "SELECT unix_timestamp(CAST(window_start AS TIMESTAMP)) AS s, count(*) AS n FROM TABLE(HOP(TABLE events, DESCRIPTOR(ts), INTERVAL '1' HOUR, INTERVAL '2' HOURS)) GROUP BY window_start", "SELECT CAST(epoch(date_trunc('hour', ts)) AS BIGINT) - 3600 * i AS s, count(*) AS n FROM events, range(2) r(i) GROUP BY ALL")
add("session", "SELECT user_id, unix_timestamp(session_window.start) AS s, count(*) AS n FROM events GROUP BY user_id, session_window(CAST(ts AS TIMESTAMP), '6 hours')", "SELECT user_id, CAST(epoch(date_trunc('second', min(ts))) AS BIGINT) AS s, count(*) AS n FROM (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS g FROM (SELECT *, CASE WHEN ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL 6 HOUR OR lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) IS NULL THEN 1 ELSE 0 END AS fresh FROM events)) GROUP BY user_id, g")
add("top_category_per_window", "SELECT h, event_type, n FROM (SELECT h, event_type, n, max(n) OVER (PARTITION BY h) AS m FROM (SELECT date_trunc('DAY', ts) AS h, event_type, count(*) AS n FROM events GROUP BY date_trunc('DAY', ts), event_type) a) b WHERE n = m", "SELECT h, event_type, n FROM (SELECT h, event_type, n, max(n) OVER (PARTITION BY h) AS m FROM (SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS h, event_type, count(*) AS n FROM events GROUP BY 1, 2) a) b WHERE n = m")


# --- more scalars ---
add("interval_multiply", "SELECT o_orderkey, o_orderdate + INTERVAL 1 DAY * (o_orderkey % 5) AS a, o_orderdate - INTERVAL 2 HOUR * 3 AS b FROM orders", "SELECT o_orderkey, o_orderdate + INTERVAL 1 DAY * (o_orderkey % 5) AS a, o_orderdate - INTERVAL 6 HOUR AS b FROM orders")
add("date_difference", "SELECT o_orderkey, datediff(CAST(o_orderdate AS DATE), DATE '1995-01-01') AS d, TIMESTAMPDIFF(MONTH, TIMESTAMP_NTZ '1990-01-15 00:00:00', o_orderdate) AS m FROM orders", "SELECT o_orderkey, CAST(CAST(o_orderdate AS DATE) - DATE '1995-01-01' AS INTEGER) AS d, CAST((year(o_orderdate) - 1990) * 12 + month(o_orderdate) - 1 - CASE WHEN day(o_orderdate) < 15 THEN 1 ELSE 0 END AS BIGINT) AS m FROM orders")
add("date_compare", "SELECT o_orderkey FROM orders WHERE o_orderdate BETWEEN TIMESTAMP_NTZ '1994-01-01 00:00:00' AND TIMESTAMP_NTZ '1994-12-31 23:59:59' OR CAST(o_orderdate AS DATE) = DATE '1996-02-29'", "SELECT o_orderkey FROM orders WHERE o_orderdate BETWEEN TIMESTAMP '1994-01-01 00:00:00' AND TIMESTAMP '1994-12-31 23:59:59' OR CAST(o_orderdate AS DATE) = DATE '1996-02-29'")
add("struct_field", "SELECT o_orderkey, s.k AS k, s.p AS p FROM (SELECT o_orderkey, named_struct('k', o_custkey, 'p', o_orderpriority) AS s FROM orders) x", "SELECT o_orderkey, o_custkey AS k, o_orderpriority AS p FROM orders")
add("cast_text_strict", "SELECT p_partkey, CASE WHEN p_brand IS NULL THEN NULL ELSE COALESCE(try_cast(p_brand AS INT), 0) END AS i, COALESCE(try_cast(CAST(p_size AS STRING) AS DOUBLE), 0.0D) AS d, lower(p_brand) = 'true' AS b FROM part", "SELECT p_partkey, CASE WHEN p_brand IS NULL THEN NULL ELSE COALESCE(TRY_CAST(p_brand AS INTEGER), 0) END AS i, CAST(p_size AS DOUBLE) AS d, lower(p_brand) = 'true' AS b FROM part")
add("int_casts_wrap", "SELECT o_orderkey, CAST(o_orderkey * 1000 AS SMALLINT) AS s, CAST(o_orderkey * 10000000 AS INT) AS i FROM orders", "SELECT o_orderkey, CAST((o_orderkey * 1000 + 32768) % 65536 - 32768 AS SMALLINT) AS s, CAST((o_orderkey * 10000000 + 2147483648) % 4294967296 - 2147483648 AS INTEGER) AS i FROM orders")
add("round_half_even", "SELECT l_orderkey, l_linenumber, bround(CAST(l_extendedprice AS DECIMAL(12, 2)), 1) AS r FROM lineitem", "SELECT l_orderkey, l_linenumber, CAST(round_even(CAST(l_extendedprice AS DECIMAL(12, 2)), 1) AS DECIMAL(12, 1)) AS r FROM lineitem")
add("exists_projected", "SELECT n_name, EXISTS (SELECT 1 FROM supplier WHERE s_nationkey = n_nationkey AND s_acctbal > 9000) AS e FROM nation")
add("case_null_types", "SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber > 5 THEN NULL WHEN l_linenumber > 3 THEN l_quantity ELSE 0 END AS c FROM lineitem")
add("unnest_zip", "SELECT vec_id, a, b FROM embeddings e, UNNEST(e.embedding, reverse(e.embedding)) AS z(a, b)", "SELECT vec_id, unnest(embedding) AS a, unnest(list_reverse(embedding)) AS b FROM embeddings")
add("lateral_join", "SELECT n_name, x.s_suppkey FROM nation, LATERAL (SELECT s_suppkey FROM supplier WHERE s_nationkey = n_nationkey AND s_acctbal > 5000) x", "SELECT n_name, s_suppkey FROM nation JOIN supplier ON s_nationkey = n_nationkey WHERE s_acctbal > 5000")
add("recursive_cte", "WITH RECURSIVE t(n) AS (SELECT 1 UNION ALL SELECT n + 1 FROM t WHERE n < 20) SELECT n FROM t")
# for each purchase the time of the user's last view at or before it
add("asof_join", "SELECT event_id, seen FROM (SELECT event_id, event_type, last_value(CASE WHEN event_type = 'view' THEN ts END) IGNORE NULLS OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS seen FROM events) x WHERE event_type = 'purchase'", "SELECT p.event_id, v.ts AS seen FROM (SELECT * FROM events WHERE event_type = 'purchase') p ASOF LEFT JOIN (SELECT DISTINCT user_id, ts FROM events WHERE event_type = 'view') v ON p.user_id = v.user_id AND p.ts >= v.ts")

# --- auctions: orders stand for auctions, line items for bids, customers for persons ---
_B = "(SELECT l_orderkey AS auction, l_suppkey AS bidder, l_extendedprice AS price, l_shipdate AS bid_at, l_linenumber AS n, l_returnflag AS channel FROM lineitem) b"
add("auction_currency", f"SELECT auction, bidder, CAST(CAST(price AS DECIMAL(12, 2)) * CAST(0.908 AS DECIMAL(4, 3)) AS DECIMAL(18, 5)) AS price FROM {_B}")
add("auction_selection", f"SELECT auction, price FROM {_B} WHERE MOD(auction, 123) = 0")
add("auction_local_items", "SELECT c_name, n_name, o_orderkey FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE o_orderstatus = 'O' AND (n_name LIKE 'A%' OR n_name LIKE 'C%' OR n_nationkey = 7)")
add("auction_average_final", f"SELECT o_orderpriority, ROUND(avg(f), 2) AS a FROM (SELECT o_orderkey, o_orderpriority, max(price) AS f FROM orders JOIN {_B} ON o_orderkey = auction AND bid_at BETWEEN o_orderdate AND o_orderdate + INTERVAL 60 DAY GROUP BY o_orderkey, o_orderpriority) x GROUP BY o_orderpriority")
add("auction_winning_bids", f"SELECT auction, bidder, price FROM (SELECT *, row_number() OVER (PARTITION BY auction ORDER BY price DESC, n, bidder) AS r FROM {_B}) x WHERE r = 1")
add("auction_latest_bid", f"SELECT auction, bidder, max(bid_at) AS last FROM {_B} GROUP BY auction, bidder")
add("auction_channel_stats", f"SELECT channel, count(*) AS total, count(*) FILTER (WHERE price < 10000) AS low, count(*) FILTER (WHERE price >= 10000 AND price < 50000) AS mid, count(DISTINCT bidder) AS bidders, count(DISTINCT auction) FILTER (WHERE price < 10000) AS low_auctions FROM {_B} GROUP BY channel")
add("auction_daily_range", f"SELECT auction, CAST(CAST(bid_at AS DATE) AS STRING) AS day, count(*) AS n, min(price) AS lo, max(price) AS hi FROM {_B} GROUP BY auction, CAST(CAST(bid_at AS DATE) AS STRING)", f"SELECT auction, CAST(CAST(bid_at AS DATE) AS VARCHAR) AS day, count(*) AS n, min(price) AS lo, max(price) AS hi FROM {_B} GROUP BY ALL")
add("auction_hour_case", "SELECT event_id, CASE WHEN HOUR(ts) >= 8 AND HOUR(ts) <= 18 THEN 'day' WHEN HOUR(ts) <= 6 OR HOUR(ts) >= 20 THEN 'night' ELSE 'other' END AS part, length(props) - length(replace(props, 'k', '')) AS k FROM events", "SELECT event_id, CASE WHEN hour(ts) >= 8 AND hour(ts) <= 18 THEN 'day' WHEN hour(ts) <= 6 OR hour(ts) >= 20 THEN 'night' ELSE 'other' END AS part, CAST(length(props) - length(replace(props, 'k', '')) AS INTEGER) AS k FROM events")
add("auction_rows_frame", f"SELECT auction, n, ROUND(avg(price) OVER (PARTITION BY auction ORDER BY n, price, bidder ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 6) AS a FROM {_B}")

# --- values of predicates, names, syntax ---
_N = "(SELECT NULLIF(n_regionkey, 2) AS k, n_nationkey FROM nation)"
add("in_subquery_where_null", f"SELECT n_nationkey FROM nation WHERE (n_nationkey IN (SELECT k FROM {_N} s)) IS NULL")
add("in_subquery_same_table", "SELECT n_nationkey, n_nationkey IN (SELECT n_regionkey FROM nation) AS i, CASE WHEN n_nationkey + 1 NOT IN (SELECT n_regionkey FROM nation WHERE n_regionkey > 1) THEN 'out' ELSE 'in' END AS c FROM nation")
add("all_compound_left", "SELECT n_nationkey, n_nationkey + 2 * n_regionkey > ALL (SELECT n_regionkey FROM nation) AS a, n_nationkey - 1 = ANY (SELECT n_regionkey FROM nation) AS s FROM nation", "SELECT n_nationkey, n_nationkey + 2 * n_regionkey > (SELECT max(n_regionkey) FROM nation) AS a, n_nationkey - 1 IN (SELECT n_regionkey FROM nation) AS s FROM nation")
add("quoted_names", 'SELECT "o key", "select" FROM (SELECT o_orderkey AS "o key", o_orderstatus AS "select" FROM orders) x WHERE "select" = \'F\'')
add("unique_star", "SELECT UNIQUE (SELECT * FROM nation) AS u, UNIQUE (SELECT n_regionkey FROM nation) AS v, UNIQUE (SELECT r_name, r_regionkey FROM region) AS w", "SELECT true AS u, false AS v, true AS w")
add("array_set_agg", "SELECT n_regionkey, array_join(array_sort(array_agg(n_nationkey)), ',') AS a, array_join(array_sort(collect_set(n_nationkey % 3)), ',') AS s FROM nation GROUP BY n_regionkey", "SELECT n_regionkey, array_to_string(list_sort(list(n_nationkey)), ',') AS a, array_to_string(list_sort(list(DISTINCT n_nationkey % 3)), ',') AS s FROM nation GROUP BY n_regionkey")
add("sum_of_nothing_is_zero", "SELECT COALESCE(SUM(o_orderkey), 0) AS s, COUNT(*) AS n FROM orders WHERE o_orderkey < 0", "SELECT CAST(COALESCE(SUM(o_orderkey), 0) AS BIGINT) AS s, COUNT(*) AS n FROM orders WHERE o_orderkey < 0")
add("approximate_counts", "SELECT abs(approx_count_distinct(l_partkey) - count(DISTINCT l_partkey)) <= 0.1 * count(DISTINCT l_partkey) AS near FROM lineitem", "SELECT true AS near")
add("cast_text_numbers", "SELECT l_orderkey, l_linenumber, CAST(CAST(l_quantity AS VARCHAR) AS DOUBLE) AS d, CAST(CAST(l_quantity AS VARCHAR) AS DECIMAL(10, 2)) AS c, CAST(CASE WHEN l_linenumber > 2 THEN 'true' ELSE 'false' END AS BOOLEAN) AS b, CAST('no number' AS DOUBLE) AS x FROM lineitem", "SELECT l_orderkey, l_linenumber, l_quantity AS d, CAST(l_quantity AS DECIMAL(10, 2)) AS c, l_linenumber > 2 AS b, CAST(NULL AS DOUBLE) AS x FROM lineitem")
add("cast_date_times", "SELECT o_orderkey, CAST(CAST(o_orderdate AS DATE) AS TIMESTAMP_NTZ) AS t, CAST(CAST(CAST(o_orderdate AS DATE) AS VARCHAR) || ' 01:02:03.004' AS TIMESTAMP_NTZ) AS s FROM orders", "SELECT o_orderkey, CAST(CAST(o_orderdate AS DATE) AS TIMESTAMP) AS t, CAST(CAST(o_orderdate AS DATE) AS TIMESTAMP) + INTERVAL 3723004 MILLISECOND AS s FROM orders")
add("floor_ceil_numbers", "SELECT l_orderkey, l_linenumber, FLOOR(l_extendedprice) AS f, CEIL(-l_extendedprice) AS c FROM lineitem", "SELECT l_orderkey, l_linenumber, CAST(floor(l_extendedprice) AS BIGINT) AS f, CAST(ceil(-l_extendedprice) AS BIGINT) AS c FROM lineitem")

#: Queries of programs in strict mode.
STRICT: dict[str, tuple[str, str]] = {
    "strict_casts": ("SELECT p_partkey, CAST(p_brand AS INT) AS i, CAST(NULLIF(p_name, p_name) AS INT) AS z, CAST(CAST(p_size AS VARCHAR) AS INT) AS n, CAST(p_type AS DOUBLE) AS d, CAST(p_brand AS DECIMAL(6, 2)) AS c, CAST(p_brand AS BOOLEAN) AS b FROM part", "SELECT p_partkey, COALESCE(TRY_CAST(p_brand AS INTEGER), 0) AS i, CAST(NULL AS INTEGER) AS z, p_size AS n, COALESCE(TRY_CAST(p_type AS DOUBLE), 0) AS d, CAST(0 AS DECIMAL(6, 2)) AS c, lower(p_brand) = 'true' AS b FROM part"),
    "strict_sum_avg": ("SELECT l_returnflag, SUM(l_linenumber) AS s, AVG(l_linenumber) AS a, SUM(DISTINCT l_linenumber) AS d FROM lineitem GROUP BY l_returnflag", "SELECT l_returnflag, CAST(sum(l_linenumber) AS INTEGER) AS s, CAST(sum(l_linenumber) // count(l_linenumber) AS INTEGER) AS a, CAST(sum(DISTINCT l_linenumber) AS INTEGER) AS d FROM lineitem GROUP BY l_returnflag"),
    "strict_millis": ("SELECT event_id, CAST(ts AS VARCHAR) AS s, unix_micros(CAST(date_format(ts, 'yyyy-MM-dd HH:mm:ss.SSSSSS') AS TIMESTAMP)) AS u FROM events", "SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS s, (epoch_us(ts) + 500) // 1000 * 1000 AS u FROM events"),
    "strict_round": ("SELECT l_orderkey, l_linenumber, ROUND(CAST(l_extendedprice AS DECIMAL(12, 2)), 1) AS r FROM lineitem", "SELECT l_orderkey, l_linenumber, CAST(round_even(CAST(l_extendedprice AS DECIMAL(12, 2)), 1) AS DECIMAL(12, 1)) AS r FROM lineitem"),
}


def run(name: str) -> Callable[[SparkSession, str], DataFrame]:
    sql = (STRICT.get(name) or QUERIES[name])[0]

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        program = Program(spark, strict=name in STRICT)
        words = sql.lower()
        for t in TABLES:
            if t in words:
                program.read(t, f"{sf_dir}/{t}.parquet")
        program.sql(f"CREATE VIEW v AS {sql}")
        return program.output("v")

    return query


def queries() -> dict:
    return {n: run(n) for n in (*QUERIES, *STRICT)}


def oracle_sql() -> dict[str, str]:
    return {n: duck or sql for n, (sql, duck) in (QUERIES | STRICT).items()}
