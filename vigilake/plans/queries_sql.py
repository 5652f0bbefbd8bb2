"""Queries of the SQL surface: one text for both engines wherever their dialects agree."""

from __future__ import annotations

from pyspark.sql import SparkSession

from .queries_core import QUERIES

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "conversations")

_BOTH = {
    "sql_join_inner": "SELECT o_orderkey, c_name, n_name FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE o_orderpriority LIKE '1%'",
    "sql_join_left": "SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderstatus = 'F' GROUP BY c_custkey",
    "sql_join_right": "SELECT n_name, s_suppkey FROM supplier RIGHT JOIN nation ON s_nationkey = n_nationkey",
    "sql_join_full": "SELECT c_custkey, s_suppkey FROM (SELECT * FROM customer WHERE c_custkey % 3 = 0) c FULL JOIN (SELECT * FROM supplier WHERE s_suppkey % 2 = 0) s ON c_custkey = s_suppkey",
    "sql_join_full_whole": "SELECT c_custkey, s_suppkey FROM customer FULL JOIN supplier ON c_custkey = s_suppkey",
    "sql_join_semi": "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 100000)",
    "sql_join_anti": "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)",
    "sql_join_cross_small": "SELECT r_name, n_name FROM region CROSS JOIN nation WHERE r_regionkey <> n_regionkey",
    "sql_join_theta": "SELECT a.n_name AS a, b.n_name AS b FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey",
    "sql_group_having": "SELECT l_returnflag, l_linestatus, count(*) AS n, CAST(round(sum(l_quantity), 2) AS DOUBLE) AS qty FROM lineitem GROUP BY l_returnflag, l_linestatus HAVING count(*) > 10",
    "sql_filter_aggregate": "SELECT l_returnflag, count(*) FILTER (WHERE l_discount > 0.05) AS discounted, count(DISTINCT l_suppkey) AS suppliers FROM lineitem GROUP BY l_returnflag",
    "sql_rollup": "SELECT n_regionkey, n_name, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY ROLLUP (n_regionkey, n_name)",
    "sql_cube": "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)",
    "sql_grouping_sets": "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY GROUPING SETS ((l_returnflag), (l_linestatus), ())",
    "sql_distinct": "SELECT DISTINCT p_brand, p_size FROM part",
    "sql_topk": "SELECT c_custkey, total FROM (SELECT c_custkey, total, row_number() OVER (ORDER BY total DESC, c_custkey) AS r FROM (SELECT o_custkey AS c_custkey, CAST(round(sum(o_totalprice), 2) AS DOUBLE) AS total FROM orders GROUP BY o_custkey) t) x WHERE r <= 10",
    "sql_rank": "SELECT p_partkey, rank() OVER (PARTITION BY p_brand ORDER BY p_retailprice) AS r, dense_rank() OVER (PARTITION BY p_brand ORDER BY p_size) AS d, ntile(4) OVER (PARTITION BY p_brand ORDER BY p_partkey) AS q FROM part",
    "sql_lag": "SELECT event_id, lag(event_id, 1) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before, lead(event_type, 1) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS following FROM events",
    "sql_frame": "SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS n, first_value(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS first_id, max(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS top FROM events",
    "sql_qualify": "SELECT user_id, event_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) AS r FROM events) x WHERE r = 1",
    "sql_union": "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey AS k FROM supplier",
    "sql_union_all": "SELECT 'c' AS kind, c_nationkey AS k FROM customer UNION ALL SELECT 's' AS kind, s_nationkey AS k FROM supplier",
    "sql_intersect": "SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey AS k FROM supplier",
    "sql_except": "SELECT n_nationkey AS k FROM nation EXCEPT SELECT s_nationkey AS k FROM supplier",
    "sql_except_all": "SELECT c_nationkey AS k FROM customer EXCEPT ALL SELECT s_nationkey AS k FROM supplier",
    "sql_cte": "WITH big AS (SELECT * FROM orders WHERE o_totalprice > 150000), n AS (SELECT o_custkey, count(*) AS n FROM big GROUP BY o_custkey) SELECT c_name, n.n AS orders FROM n JOIN customer ON c_custkey = n.o_custkey",
    "sql_recursive": "WITH RECURSIVE t(n) AS (SELECT 1 UNION ALL SELECT n + 1 FROM t WHERE n < 25) SELECT n, n_name FROM t JOIN nation ON n_nationkey = n - 1",
    "sql_subquery_scalar": "SELECT p_partkey FROM part WHERE p_retailprice > (SELECT avg(p_retailprice) FROM part)",
    "sql_subquery_in": "SELECT s_suppkey FROM supplier WHERE s_suppkey IN (SELECT l_suppkey FROM lineitem WHERE l_quantity > 49)",
    "sql_subquery_correlated": "SELECT o_orderkey FROM orders o WHERE o_totalprice = (SELECT max(o_totalprice) FROM orders i WHERE i.o_custkey = o.o_custkey)",
    "sql_case_coalesce": "SELECT event_id, CASE WHEN value > 90 THEN 'high' WHEN value > 50 THEN 'mid' ELSE 'low' END AS band, coalesce(nullif(event_type, 'view'), 'none') AS kind FROM events",
    "sql_order_limit": "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25 OFFSET 10",
    "sql_string_functions": "SELECT c_custkey, upper(c_name) AS u, substring(c_name, 1, 5) AS s, length(c_name) AS n, concat(c_mktsegment, '-', c_name) AS c FROM customer",
}
_DIALECTS = {
    "sql_asof": (
        "SELECT event_id, quote_id FROM (SELECT event_id, event_type, last_value(CASE WHEN event_type = 'view' THEN event_id END, true) OVER (PARTITION BY user_id ORDER BY ts, event_type = 'purchase', event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS quote_id FROM events WHERE event_type IN ('purchase', 'view')) WHERE event_type = 'purchase' AND quote_id IS NOT NULL",
        "SELECT e.event_id, q.event_id AS quote_id FROM (SELECT * FROM events WHERE event_type = 'purchase') e ASOF JOIN (SELECT user_id, ts, max(event_id) AS event_id FROM events WHERE event_type = 'view' GROUP BY user_id, ts) q ON q.user_id = e.user_id AND e.ts >= q.ts",
    ),
    "sql_range_join": (
        "SELECT a.event_id AS a, b.event_id AS b FROM events a JOIN events b ON a.user_id = b.user_id AND b.ts > a.ts AND b.ts <= a.ts + INTERVAL 1 HOUR",
        "SELECT a.event_id AS a, b.event_id AS b FROM events a JOIN events b ON a.user_id = b.user_id AND b.ts > a.ts AND b.ts <= a.ts + INTERVAL 1 HOUR",
    ),
    "sql_pivot": (
        "SELECT * FROM (SELECT user_id, event_type FROM events) PIVOT (count(*) FOR event_type IN ('click' AS click, 'view' AS view, 'error' AS error))",
        "SELECT user_id, nullif(count(*) FILTER (WHERE event_type = 'click'), 0) AS click, nullif(count(*) FILTER (WHERE event_type = 'view'), 0) AS view, nullif(count(*) FILTER (WHERE event_type = 'error'), 0) AS error FROM events GROUP BY user_id",
    ),
    "sql_unpivot": (
        "SELECT p_partkey, name, v FROM (SELECT p_partkey, p_brand, p_type FROM part) UNPIVOT (v FOR name IN (p_brand AS brand, p_type AS type))",
        "SELECT p_partkey, 'brand' AS name, p_brand AS v FROM part UNION ALL SELECT p_partkey, 'type' AS name, p_type AS v FROM part",
    ),
    "sql_unnest": (
        "SELECT p_partkey, word FROM part LATERAL VIEW explode(split(p_name, ' ')) t AS word",
        "SELECT p_partkey, unnest(string_split(p_name, ' ')) AS word FROM part",
    ),
    "sql_lateral": (
        "SELECT n_name, s.s_suppkey FROM nation, LATERAL (SELECT s_suppkey FROM supplier WHERE s_nationkey = n_nationkey) s",
        "SELECT n_name, s.s_suppkey FROM nation, LATERAL (SELECT s_suppkey FROM supplier WHERE s_nationkey = n_nationkey) s",
    ),
    "sql_json": (
        "SELECT event_id, CAST(get_json_object(props, '$.k') AS BIGINT) AS k FROM events",
        "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events",
    ),
    "sql_list_functions": (
        "SELECT user_id, array_join(sort_array(collect_set(event_type)), ',') AS kinds, size(collect_set(event_type)) AS n FROM events GROUP BY user_id",
        "SELECT user_id, array_to_string(list_sort(list(DISTINCT event_type)), ',') AS kinds, CAST(count(DISTINCT event_type) AS INTEGER) AS n FROM events GROUP BY user_id",
    ),
    "sql_quantiles": (
        "SELECT event_type, round(percentile(value, 0.5), 6) AS median, round(percentile(value, 0.9), 6) AS p90 FROM events GROUP BY event_type",
        "SELECT event_type, round(quantile_cont(value, 0.5), 6) AS median, round(quantile_cont(value, 0.9), 6) AS p90 FROM events GROUP BY event_type",
    ),
    "sql_time_bucket": (
        "SELECT date_format(date_trunc('HOUR', ts), 'yyyy-MM-dd HH') AS hour, event_type, count(*) AS n FROM events GROUP BY 1, 2",
        "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H') AS hour, event_type, count(*) AS n FROM events GROUP BY 1, 2",
    ),
    "sql_max_by": (
        "SELECT user_id, max_by(event_id, struct(ts, event_id)) AS last_id FROM events GROUP BY user_id",
        "SELECT user_id, arg_max(event_id, {'t': ts, 'e': event_id}) AS last_id FROM events GROUP BY user_id",
    ),
}


def views(spark: SparkSession, sf_dir: str) -> None:
    for name in TABLES:
        spark.read.parquet(f"{sf_dir}/{name}.parquet").createOrReplaceTempView(name)


def _runner(sql: str):
    def run(spark: SparkSession, sf_dir: str):
        views(spark, sf_dir)
        return spark.sql(sql)

    return run


for _name, _sql in _BOTH.items():
    QUERIES[_name] = (_runner(_sql), _sql)
for _name, (_spark_sql, _duck_sql) in _DIALECTS.items():
    QUERIES[_name] = (_runner(_spark_sql), _duck_sql)
