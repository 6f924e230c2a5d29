"""Plain SQL over channels: filters, joins, aggregates, windows, sets, order and functions."""

from __future__ import annotations

from .catalog import statement


def money(x: str) -> str:
    """A sum that doesn't depend on the order of its terms."""
    return f"cast(sum(cast({x} AS decimal(18,2))) AS double)"


# Filters and projections.
statement("copy_region", "SELECT * FROM tpch.region")
statement("filter_int_gt", "SELECT p_partkey, p_size FROM tpch.part WHERE p_size > 40")
statement("filter_double_ge", "SELECT c_custkey, c_acctbal FROM tpch.customer WHERE c_acctbal >= 5000.0")
statement("filter_str_eq", "SELECT c_custkey, c_name FROM tpch.customer WHERE c_mktsegment = 'BUILDING'")
statement("filter_str_order", "SELECT n_nationkey, n_name FROM tpch.nation WHERE n_name < 'NATION_15' AND n_name >= 'A'")
statement("filter_ne", "SELECT o_orderkey, o_orderstatus FROM tpch.orders WHERE o_orderstatus != 'F'")
statement("filter_and_or_not", "SELECT l_orderkey, l_linenumber FROM tpch.lineitem WHERE (l_quantity > 45 OR l_discount < 0.01) AND NOT l_returnflag = 'N'")
statement("filter_in", "SELECT l_orderkey, l_linenumber, l_returnflag FROM tpch.lineitem WHERE l_returnflag IN ('A', 'R') AND l_linenumber IN (1, 3)")
statement("filter_like", "SELECT p_partkey, p_name FROM tpch.part WHERE p_name LIKE '%e%' AND p_type LIKE '%E%'")
statement("filter_between", "SELECT o_orderkey, o_totalprice FROM tpch.orders WHERE o_totalprice BETWEEN 1000 AND 50000")
statement("filter_null", "SELECT event_id FROM tpch.events WHERE props IS NOT NULL AND value IS NOT NULL")
statement("filter_time_range", "SELECT event_id, ts FROM tpch.events WHERE ts = '[1970/01/01 00:00:00 - 2024/01/15 12:00:00]'", "SELECT event_id, ts FROM events WHERE ts >= timestamp '1970-01-01 00:00:00' AND ts <= timestamp '2024-01-15 12:00:00'")
statement("filter_time_open_end", "SELECT event_id, ts FROM tpch.events WHERE ts = '[2024/01/15 00:00:00 - ]'", "SELECT event_id, ts FROM events WHERE ts >= timestamp '2024-01-15 00:00:00'")
statement("filter_time_open_start", "SELECT event_id, ts FROM tpch.events WHERE ts = '[ - 2024/01/10 00:00:00]'", "SELECT event_id, ts FROM events WHERE ts <= timestamp '2024-01-10 00:00:00'")
statement("project_alias", "SELECT l_orderkey AS order_key, l_linenumber AS line, cast(cast(l_extendedprice AS decimal(18,2)) * (1 - cast(l_discount AS decimal(4,2))) AS double) AS net FROM tpch.lineitem WHERE l_orderkey < 100")
statement("case_expression", "SELECT p_partkey, CASE WHEN p_size < 10 THEN 'small' WHEN p_size < 30 THEN 'middle' ELSE 'large' END AS size_class FROM tpch.part")
statement("cast_and_try", "SELECT o_orderkey, cast(o_totalprice AS int) AS whole, cast(o_orderkey AS string) AS key_text FROM tpch.orders", "SELECT o_orderkey, cast(trunc(o_totalprice) AS int) AS whole, cast(o_orderkey AS varchar) AS key_text FROM orders")

# Joins.
statement("join_inner", "SELECT n.n_name, r.r_name FROM tpch.nation n JOIN tpch.region r ON n.n_regionkey = r.r_regionkey")
statement("join_using", "SELECT s.s_name, n.n_name FROM tpch.supplier s JOIN tpch.nation n ON s.s_nationkey = n.n_nationkey WHERE s.s_acctbal > 0")
statement("join_large", f"SELECT o.o_orderpriority, count(*) AS lines, {money('l.l_extendedprice')} AS price FROM tpch.lineitem l JOIN tpch.orders o ON l.l_orderkey = o.o_orderkey GROUP BY o.o_orderpriority")
statement("join_left", "SELECT c.c_custkey, count(o.o_orderkey) AS n_orders FROM tpch.customer c LEFT JOIN tpch.orders o ON c.c_custkey = o.o_custkey AND o.o_orderstatus = 'P' GROUP BY c.c_custkey")
statement("join_right", "SELECT c.c_custkey, n.n_nationkey FROM tpch.customer c RIGHT JOIN tpch.nation n ON c.c_nationkey = n.n_nationkey AND c.c_acctbal > 9900")
statement("join_full", "SELECT s.s_suppkey, c.c_custkey FROM tpch.supplier s FULL JOIN tpch.customer c ON s.s_suppkey = c.c_custkey")
statement("join_cross", "SELECT a.r_name AS left_name, b.r_name AS right_name FROM tpch.region a CROSS JOIN tpch.region b")
statement("join_theta", "SELECT a.n_nationkey AS a, b.n_nationkey AS b FROM tpch.nation a JOIN tpch.nation b ON a.n_nationkey < b.n_nationkey AND a.n_regionkey <> b.n_regionkey")
statement("join_semi_in", "SELECT p_partkey FROM tpch.part WHERE p_partkey IN (SELECT l_partkey FROM tpch.lineitem WHERE l_quantity > 49)")
statement("join_semi_exists", "SELECT o_orderkey FROM tpch.orders WHERE EXISTS (SELECT 1 FROM tpch.lineitem WHERE l_orderkey = o_orderkey AND l_discount > 0.09)")
statement("join_anti_not_exists", "SELECT c_custkey FROM tpch.customer WHERE NOT EXISTS (SELECT 1 FROM tpch.orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')")
statement("join_anti_not_in", "SELECT s_suppkey FROM tpch.supplier WHERE s_suppkey NOT IN (SELECT l_suppkey FROM tpch.lineitem WHERE l_quantity > 49 AND l_discount > 0.09)")
statement("join_range", "SELECT n.n_nationkey, count(*) AS parts FROM tpch.nation n JOIN tpch.part p ON p.p_size BETWEEN n.n_nationkey AND n.n_nationkey + 2 GROUP BY n.n_nationkey")
statement("join_comma", "SELECT n_name, r_name FROM tpch.nation, tpch.region WHERE n_regionkey = r_regionkey AND r_regionkey > 0")

# Aggregates.
statement("agg_group", f"SELECT l_returnflag, l_linestatus, count(*) AS n, {money('l_quantity')} AS qty, min(l_extendedprice) AS low, max(l_extendedprice) AS high FROM tpch.lineitem GROUP BY l_returnflag, l_linestatus")
statement("agg_avg", "SELECT l_returnflag, round(avg(l_quantity), 6) AS avg_qty FROM tpch.lineitem GROUP BY l_returnflag")
statement("agg_global", f"SELECT count(*) AS n, {money('o_totalprice')} AS total, max(o_orderdate) AS newest FROM tpch.orders")
statement("agg_having_order_limit", "SELECT o_custkey, count(*) AS n FROM tpch.orders GROUP BY o_custkey HAVING count(*) > 5 ORDER BY n DESC, o_custkey LIMIT 20")
statement("agg_count_distinct", "SELECT l_returnflag, count(DISTINCT l_partkey) AS parts, count(DISTINCT l_suppkey) AS supps FROM tpch.lineitem GROUP BY l_returnflag")
statement("agg_conditional", f"SELECT o_orderpriority, sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS finished, {money('CASE WHEN o_totalprice > 100000 THEN o_totalprice ELSE 0 END')} AS big FROM tpch.orders GROUP BY o_orderpriority", f"SELECT o_orderpriority, cast(sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS bigint) AS finished, {money('CASE WHEN o_totalprice > 100000 THEN o_totalprice ELSE 0 END')} AS big FROM orders GROUP BY o_orderpriority")
statement("agg_filter_clause", "SELECT l_linestatus, count(*) FILTER (WHERE l_quantity > 25) AS large FROM tpch.lineitem GROUP BY l_linestatus")
statement("agg_rollup", "SELECT l_returnflag, l_linestatus, count(*) AS n FROM tpch.lineitem GROUP BY ROLLUP(l_returnflag, l_linestatus)")
statement("agg_cube", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM tpch.orders GROUP BY CUBE(o_orderstatus, o_orderpriority)")
statement("agg_grouping_sets", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM tpch.orders GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), ())")
statement("agg_with_rollup", "SELECT o_orderstatus, count(*) AS n FROM tpch.orders GROUP BY o_orderstatus WITH ROLLUP", "SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY ROLLUP(o_orderstatus)")
statement("agg_quantile_exact", "SELECT l_returnflag, percentile(l_quantity, 0.5) AS median FROM tpch.lineitem GROUP BY l_returnflag", "SELECT l_returnflag, quantile_cont(l_quantity, 0.5) AS median FROM lineitem GROUP BY l_returnflag")
statement("agg_corr_stddev", "SELECT round(corr(l_quantity, l_extendedprice), 6) AS c, round(stddev_pop(l_quantity), 6) AS s FROM tpch.lineitem")
statement("distinct_rows", "SELECT DISTINCT l_returnflag, l_linestatus FROM tpch.lineitem")

# Windows.
statement("window_ranking", "SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS rn, rank() OVER (PARTITION BY o_custkey ORDER BY o_orderstatus) AS rk, dense_rank() OVER (PARTITION BY o_custkey ORDER BY o_orderstatus) AS dr FROM tpch.orders", "SELECT o_orderkey, cast(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS int) AS rn, cast(rank() OVER (PARTITION BY o_custkey ORDER BY o_orderstatus) AS int) AS rk, cast(dense_rank() OVER (PARTITION BY o_custkey ORDER BY o_orderstatus) AS int) AS dr FROM orders")
statement("window_ntile", "SELECT c_custkey, ntile(4) OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal, c_custkey) AS quarter FROM tpch.customer", "SELECT c_custkey, cast(ntile(4) OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal, c_custkey) AS int) AS quarter FROM customer")
statement("window_lag_lead", "SELECT o_orderkey, lag(o_totalprice) OVER w AS previous, lead(o_totalprice, 2) OVER w AS later FROM tpch.orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)")
statement("window_first_last", "SELECT o_orderkey, first_value(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS first_order, nth_value(o_orderkey, 2) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS second_order FROM tpch.orders")
statement("window_rows_frame", "SELECT l_orderkey, l_linenumber, max(l_quantity) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_extendedprice, l_partkey, l_suppkey ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS near FROM tpch.lineitem")
statement("window_range_frame", "SELECT p_partkey, count(*) OVER (PARTITION BY p_brand ORDER BY p_size RANGE BETWEEN 5 PRECEDING AND CURRENT ROW) AS near FROM tpch.part")
statement("window_share_of_total", "SELECT o_orderstatus, count(*) AS n, round(count(*) * 100.0 / sum(count(*)) OVER (), 4) AS share FROM tpch.orders GROUP BY o_orderstatus", "SELECT o_orderstatus, count(*) AS n, round(count(*) * 100.0 / sum(count(*)) OVER (), 4) AS share FROM orders GROUP BY o_orderstatus")
statement("window_empty_over", "SELECT r_regionkey, count(*) OVER () AS n FROM tpch.region")
statement("topk_per_group", "SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT o_custkey, o_orderkey, o_totalprice, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM tpch.orders) t WHERE rn <= 3")

# Order, limits, sets and subqueries.
statement("order_multi_key", "SELECT c_custkey, c_mktsegment, c_acctbal FROM tpch.customer ORDER BY c_mktsegment ASC, c_acctbal DESC, c_custkey LIMIT 50")
statement("topk", "SELECT l_orderkey, l_linenumber, l_extendedprice FROM tpch.lineitem ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber LIMIT 10")
statement("paging", "SELECT o_orderkey FROM tpch.orders ORDER BY o_orderkey LIMIT 20 OFFSET 40")
statement("union_all", "SELECT n_name AS name FROM tpch.nation UNION ALL SELECT r_name AS name FROM tpch.region")
statement("union_distinct", "SELECT l_returnflag AS f FROM tpch.lineitem UNION SELECT o_orderstatus AS f FROM tpch.orders")
statement("intersect_rows", "SELECT c_nationkey AS k FROM tpch.customer INTERSECT SELECT s_nationkey AS k FROM tpch.supplier")
statement("except_rows", "SELECT p_partkey AS k FROM tpch.part EXCEPT SELECT l_partkey AS k FROM tpch.lineitem WHERE l_quantity > 49")
statement("intersect_all", "SELECT c_nationkey AS k FROM tpch.customer INTERSECT ALL SELECT s_nationkey AS k FROM tpch.supplier")
statement("except_all", "SELECT c_nationkey AS k FROM tpch.customer EXCEPT ALL SELECT s_nationkey AS k FROM tpch.supplier")
statement("cte", "WITH big AS (SELECT o_custkey, o_totalprice FROM tpch.orders WHERE o_totalprice > 200000) SELECT o_custkey, count(*) AS n FROM big GROUP BY o_custkey")
statement("subquery_scalar", "SELECT c_custkey FROM tpch.customer WHERE c_acctbal > (SELECT max(s_acctbal) * 0.9 FROM tpch.supplier)")
statement("subquery_correlated", "SELECT o_orderkey FROM tpch.orders o WHERE o.o_totalprice = (SELECT max(i.o_totalprice) FROM tpch.orders i WHERE i.o_custkey = o.o_custkey)")
statement("derived_table", "SELECT seg, max(n) AS most FROM (SELECT c_mktsegment AS seg, c_nationkey, count(*) AS n FROM tpch.customer GROUP BY c_mktsegment, c_nationkey) t GROUP BY seg")

# Functions.
statement("string_functions", "SELECT p_partkey, upper(p_name) AS up, length(p_type) AS len, substring(p_brand, 1, 3) AS head, replace(p_type, ' ', '_') AS under, concat(p_brand, '-', p_name) AS joined FROM tpch.part", "SELECT p_partkey, upper(p_name) AS up, cast(length(p_type) AS int) AS len, substring(p_brand, 1, 3) AS head, replace(p_type, ' ', '_') AS under, concat(p_brand, '-', p_name) AS joined FROM part")
statement("string_regexp", "SELECT c_custkey, regexp_extract(c_name, '([0-9]+)', 1) AS digits FROM tpch.customer WHERE c_name RLIKE '7$'", "SELECT c_custkey, regexp_extract(c_name, '([0-9]+)', 1) AS digits FROM customer WHERE regexp_matches(c_name, '7$')")
statement("date_functions", "SELECT o_orderkey, year(o_orderdate) AS y, month(o_orderdate) AS m, date_trunc('month', o_orderdate) AS month_start, datediff(o_orderdate, timestamp'1992-01-01 00:00:00') AS days FROM tpch.orders", "SELECT o_orderkey, cast(year(o_orderdate) AS int) AS y, cast(month(o_orderdate) AS int) AS m, cast(date_trunc('month', o_orderdate) AS timestamp) AS month_start, cast(datediff('day', timestamp '1992-01-01 00:00:00', o_orderdate) AS int) AS days FROM orders")
statement("math_functions", "SELECT p_partkey, abs(p_size - 25) AS off, mod(p_size, 7) AS rest, round(sqrt(p_retailprice), 4) AS root, floor(p_retailprice) AS low, ceil(p_retailprice) AS high FROM tpch.part", "SELECT p_partkey, abs(p_size - 25) AS off, mod(p_size, 7) AS rest, round(sqrt(p_retailprice), 4) AS root, cast(floor(p_retailprice) AS bigint) AS low, cast(ceil(p_retailprice) AS bigint) AS high FROM part")
statement("json_functions", "SELECT event_id, get_json_object(props, '$.k') AS k FROM tpch.events", "SELECT event_id, json_extract_string(props, '$.k') AS k FROM events")
statement("array_functions", "SELECT o_custkey, size(collect_set(o_orderstatus)) AS kinds, array_join(sort_array(collect_set(o_orderpriority)), ',') AS priorities FROM tpch.orders GROUP BY o_custkey", "SELECT o_custkey, cast(len(list_distinct(list(o_orderstatus))) AS int) AS kinds, array_to_string(list_sort(list_distinct(list(o_orderpriority))), ',') AS priorities FROM orders GROUP BY o_custkey")
statement("null_functions", "SELECT event_id, coalesce(props, 'none') AS p, nullif(event_type, 'click') AS t FROM tpch.events")

# Time buckets.
statement("granularity_hour", "SELECT event_type, count(*) AS n FROM tpch.events GROUP BY event_type GRANULARITY 3600", "SELECT make_timestamp((epoch_us(ts) // 3600000000) * 3600000000) AS time_bucket, event_type, count(*) AS n FROM events GROUP BY 1, 2")
statement("granularity_having", "SELECT user_id, count(*) AS n FROM tpch.events GROUP BY user_id GRANULARITY 86400 HAVING count(*) > 1", "SELECT make_timestamp((epoch_us(ts) // 86400000000) * 86400000000) AS time_bucket, user_id, count(*) AS n FROM events GROUP BY 1, 2 HAVING count(*) > 1")
statement("granularity_alone", "SELECT count(*) AS n FROM tpch.events GRANULARITY 60", "SELECT make_timestamp((epoch_us(ts) // 60000000) * 60000000) AS time_bucket, count(*) AS n FROM events GROUP BY 1")
