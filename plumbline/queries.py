"""Queries over the star schema: for each its text in the dialect, and the same in DuckDB's SQL."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .checker.verify import Verifier
from .engine import Engine
from .functions.typing import Policies
from .operators.compare import bag_difference, list_difference
from .sources.constraints import violations
from .sources.schema import Check, Column, ForeignKey, Schema, Table, Unique

KEYS = {
    "region": ("r_regionkey",), "nation": ("n_nationkey",), "customer": ("c_custkey",), "supplier": ("s_suppkey",),
    "part": ("p_partkey",), "orders": ("o_orderkey",), "lineitem": (), "events": ("event_id",),
}

#: name -> (dialect, DuckDB); None where both are the same text
SQL: dict[str, tuple[str, str | None]] = {}


def _add(name: str, text: str, oracle: str | None = None) -> None:
    SQL[name] = (text, oracle)


# -- scans, projection, filters, naming
_add("scan_project_filter", "SELECT l_orderkey, l_linenumber, l_extendedprice * (1.0 - l_discount) AS price FROM lineitem WHERE l_quantity > 25.0 AND l_returnflag = 'R'", "SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, l_extendedprice * (1.0::DOUBLE - l_discount) AS price FROM lineitem WHERE l_quantity > 25 AND l_returnflag = 'R'")
_add("unit_relation", "SELECT 1 AS one, 'a' AS letter, TRUE AS yes", "SELECT 1::BIGINT AS one, 'a' AS letter, TRUE AS yes")
_add("from_first", "FROM region", "SELECT r_regionkey::BIGINT AS r_regionkey, r_name FROM region")
_add("wildcards", "SELECT n.*, r.r_name FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey", "SELECT n_nationkey::BIGINT AS n_nationkey, n_name, n_regionkey::BIGINT AS n_regionkey, r_name FROM nation JOIN region ON n_regionkey = r_regionkey")
_add("column_aliases", "SELECT x.key, x.label FROM region x (key, label) WHERE x.key < 3", "SELECT r_regionkey::BIGINT AS key, r_name AS label FROM region WHERE r_regionkey < 3")
_add("retained_source_name", "SELECT n.n_nationkey AS id FROM nation n ORDER BY n.n_nationkey DESC LIMIT 7", "SELECT n_nationkey::BIGINT AS id FROM nation ORDER BY n_nationkey DESC LIMIT 7")
_add("cte_derived_nested", "WITH spent AS (SELECT o_custkey AS k, SUM(o_totalprice) AS total FROM orders GROUP BY o_custkey), rich (k) AS (SELECT k FROM spent WHERE total > 500000.0) SELECT d.c_custkey, d.c_name FROM (SELECT c_custkey, c_name FROM customer) d JOIN rich ON d.c_custkey = rich.k", "WITH spent AS (SELECT o_custkey AS k, SUM(o_totalprice) AS total FROM orders GROUP BY 1), rich AS (SELECT k FROM spent WHERE total > 500000) SELECT c_custkey, c_name FROM customer JOIN rich ON c_custkey = rich.k")
_add("parenthesised_join", "SELECT c.c_custkey, n.n_name, r.r_name FROM customer c JOIN (nation n JOIN region r ON n.n_regionkey = r.r_regionkey) ON c.c_nationkey = n.n_nationkey", "SELECT c_custkey, n_name, r_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
# -- predicates
_E = "(SELECT event_id, NULLIF(user_id % 5, 0) AS a, NULLIF(event_id % 3, 0) AS b FROM events) e"
_D = "(SELECT event_id, NULLIF(user_id % 5, 0)::BIGINT AS a, NULLIF(event_id % 3, 0)::BIGINT AS b FROM events) e"
_add("three_valued_logic", f"SELECT event_id, a > 2 AND b = 1 AS x, a > 2 OR b = 1 AS y, NOT a > 2 AS z, (a > 2) IS TRUE AS t, (a > 2) IS NOT FALSE AS f, (a > 2) IS UNKNOWN AS u, a IS NULL AS n FROM {_E}", f"SELECT event_id, a > 2 AND b = 1 AS x, a > 2 OR b = 1 AS y, NOT a > 2 AS z, coalesce(a > 2, false) AS t, coalesce(a > 2, true) AS f, (a > 2) IS NULL AS u, a IS NULL AS n FROM {_D}")
_add("null_safe_compare", f"SELECT event_id, a <=> b AS same, a IS DISTINCT FROM b AS other, a IS NOT DISTINCT FROM b AS again FROM {_E}", f"SELECT event_id, a IS NOT DISTINCT FROM b AS same, a IS DISTINCT FROM b AS other, a IS NOT DISTINCT FROM b AS again FROM {_D}")
_add("row_compare", f"SELECT event_id, (a, b) = (1, 2) AS x, (a, b) IN ((1, 1), (2, 2)) AS y, (a, b) <> (b, a) AS z FROM {_E}", f"SELECT event_id, a = 1 AND b = 2 AS x, (a = 1 AND b = 1) OR (a = 2 AND b = 2) AS y, NOT (a = b AND b = a) AS z FROM {_D}")
_add("between_in_like", "SELECT p_partkey FROM part WHERE p_size BETWEEN 5 AND 25 AND p_size NOT IN (7, 9) AND (p_name LIKE '%a%' OR p_name LIKE 'b%' OR p_type NOT LIKE '%Z')", "SELECT p_partkey FROM part WHERE p_size BETWEEN 5 AND 25 AND p_size NOT IN (7, 9) AND (contains(p_name, 'a') OR starts_with(p_name, 'b') OR NOT ends_with(p_type, 'Z'))")
_add("case_if_coalesce", f"SELECT event_id, CASE WHEN a > 2 THEN 'hi' WHEN a IS NULL THEN 'none' ELSE 'lo' END AS c, CASE b WHEN 1 THEN 10 WHEN 2 THEN 20 END AS d, IF(a > b, a, b) AS e, COALESCE(a, b, 0) AS f, IFNULL(a, -1) AS g, NULLIF(a, b) AS h, ISNULL(b) AS i FROM {_E}", f"SELECT event_id, CASE WHEN a > 2 THEN 'hi' WHEN a IS NULL THEN 'none' ELSE 'lo' END AS c, (CASE b WHEN 1 THEN 10 WHEN 2 THEN 20 END)::BIGINT AS d, CASE WHEN a > b THEN a ELSE b END AS e, coalesce(a, b, 0::BIGINT) AS f, coalesce(a, -1::BIGINT) AS g, nullif(a, b) AS h, b IS NULL AS i FROM {_D}")
# -- functions
_add("arith_div_zero", "SELECT event_id, user_id + 2 * event_id - 1 AS a, -user_id AS b, event_id / (user_id % 3) AS c, event_id % (user_id % 3) AS d, MOD(event_id, 7) AS e, value / (value - value) AS f, +user_id AS g FROM events", "SELECT event_id, user_id + 2 * event_id - 1 AS a, -user_id AS b, event_id::DOUBLE / nullif(user_id % 3, 0) AS c, event_id % nullif(user_id % 3, 0) AS d, event_id % 7 AS e, value / nullif(value - value, 0) AS f, user_id AS g FROM events")
_add("rounding", "SELECT c_custkey, ABS(c_acctbal) AS a, SIGN(c_acctbal) AS b, FLOOR(c_acctbal) AS c, CEIL(c_acctbal) AS d, ROUND(c_acctbal) AS e, TRUNCATE(c_acctbal, 0) AS f, POWER(c_acctbal, 2) AS g, ROUND(c_custkey, -1) AS h, TRUNCATE(c_custkey, -1) AS i, CEILING(c_acctbal / 7.0) AS j FROM customer", "SELECT c_custkey, abs(c_acctbal) AS a, sign(c_acctbal)::BIGINT AS b, floor(c_acctbal)::BIGINT AS c, ceil(c_acctbal)::BIGINT AS d, round(c_acctbal) AS e, trunc(c_acctbal) AS f, c_acctbal * c_acctbal AS g, c_custkey AS h, (c_custkey - c_custkey % 10)::BIGINT AS i, ceil(c_acctbal / 7)::BIGINT AS j FROM customer")
_add("casts", "SELECT o_orderkey, CAST(o_orderstatus = 'F' AS INTEGER) AS a, CAST(o_orderkey % 2 AS BOOLEAN) AS b, CAST(o_orderkey AS DECIMAL(10, 2)) AS c, CAST('12' AS INT) AS d, CAST('1996-01-02' AS DATE) AS e, o_orderdate > DATE '1996-01-02' AS f FROM orders", "SELECT o_orderkey, (o_orderstatus = 'F')::INT::BIGINT AS a, (o_orderkey % 2) <> 0 AS b, o_orderkey::DOUBLE AS c, 12::BIGINT AS d, DATE '1996-01-02' AS e, o_orderdate::DATE > DATE '1996-01-02' AS f FROM orders")
_add("strings", "SELECT c_custkey, CONCAT(c_name, '-', c_mktsegment) AS a, c_name || '!' AS b, LENGTH(c_name) AS c, LEFT(c_name, 4) AS d, RIGHT(c_name, 3) AS e, SUBSTRING(c_name, 2, 5) AS f, SUBSTRING(c_name FROM 3) AS g, CHAR_LENGTH(c_mktsegment) AS h FROM customer", "SELECT c_custkey, c_name || '-' || c_mktsegment AS a, c_name || '!' AS b, length(c_name) AS c, left(c_name, 4) AS d, right(c_name, 3) AS e, substring(c_name, 2, 5) AS f, substring(c_name, 3) AS g, length(c_mktsegment) AS h FROM customer")
_add("dates", "SELECT o_orderkey, YEAR(o_orderdate) AS a, MONTH(o_orderdate) AS b, DAY(o_orderdate) AS c, QUARTER(o_orderdate) AS d, WEEKDAY(o_orderdate) AS e, DAYOFWEEK(o_orderdate) AS f, LAST_DAY(o_orderdate) AS g, TO_DAYS(o_orderdate) AS h, DATEDIFF(o_orderdate, DATE '1995-01-01') AS i, o_orderdate - DATE '1995-01-01' AS j, o_orderdate + INTERVAL '3' DAY AS k, DATE_SUB(o_orderdate, INTERVAL 2 DAY) AS l, EXTRACT(YEAR FROM o_orderdate) AS m, TIMESTAMPDIFF(DAY, o_orderdate, DATE '1999-01-01') AS n, ADDDATE(o_orderdate, 5) AS o, STR_TO_DATE('1996-02-03', '%Y-%m-%d') AS p, DATE(o_orderdate) AS q FROM orders", "SELECT o_orderkey, year(d) AS a, month(d) AS b, day(d) AS c, quarter(d) AS d, isodow(d) - 1 AS e, dayofweek(d) + 1 AS f, last_day(d) AS g, (d - DATE '1970-01-01')::BIGINT + 719528 AS h, d - DATE '1995-01-01' AS i, d - DATE '1995-01-01' AS j, d + 3 AS k, d - 2 AS l, year(d) AS m, DATE '1999-01-01' - d AS n, d + 5 AS o, DATE '1996-02-03' AS p, d AS q FROM (SELECT o_orderkey, o_orderdate::DATE AS d FROM orders)")
# -- joins
_add("comma_product", "SELECT r.r_name, n.n_name FROM region r, nation n WHERE r.r_regionkey <> n.n_regionkey", "SELECT r_name, n_name FROM region, nation WHERE r_regionkey <> n_regionkey")
_add("cross_join", "SELECT r.r_name, s.r_name AS other FROM region r CROSS JOIN region s", "SELECT r.r_name, s.r_name AS other FROM region r CROSS JOIN region s")
_add("inner_join", "SELECT o.o_orderkey, c.c_name FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey WHERE o.o_totalprice > 100000.0", "SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_totalprice > 100000")
_add("join_without_constraint", "SELECT COUNT(*) AS n FROM region JOIN nation", "SELECT count(*) AS n FROM region, nation")
_add("theta_join", "SELECT a.n_nationkey AS x, b.n_nationkey AS y FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey", "SELECT a.n_nationkey::BIGINT AS x, b.n_nationkey::BIGINT AS y FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey")
_add("left_join", "SELECT c.c_custkey, o.o_orderkey FROM customer c LEFT JOIN orders o ON c.c_custkey = o.o_custkey AND o.o_totalprice > 300000.0", "SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_totalprice > 300000")
_add("right_join", "SELECT c.c_custkey, o.o_orderkey FROM orders o RIGHT OUTER JOIN customer c ON c.c_custkey = o.o_custkey AND o.o_totalprice > 300000.0", "SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_totalprice > 300000")
_add("full_join", "SELECT c.c_custkey, s.s_suppkey FROM customer c FULL JOIN supplier s ON c.c_custkey = s.s_suppkey AND c.c_nationkey <> s.s_nationkey", "SELECT c_custkey, s_suppkey FROM customer FULL JOIN supplier ON c_custkey = s_suppkey AND c_nationkey <> s_nationkey")
_X = "(SELECT n_nationkey AS k, n_name AS a FROM nation WHERE n_nationkey < 15) x"
_Y = "(SELECT n_nationkey AS k, n_regionkey AS b FROM nation WHERE n_nationkey > 10) y"
_DX, _DY = _X.replace("n_nationkey AS k", "n_nationkey::BIGINT AS k"), _Y.replace("n_nationkey AS k", "n_nationkey::BIGINT AS k").replace("n_regionkey AS b", "n_regionkey::BIGINT AS b")
_add("using_join", f"SELECT * FROM {_X} JOIN {_Y} USING (k)", f"SELECT * FROM {_DX} JOIN {_DY} USING (k)")
_add("using_full_join", f"SELECT k, x.k AS xk, y.k AS yk, a, b FROM {_X} FULL JOIN {_Y} USING (k)", f"SELECT coalesce(x.k, y.k) AS k, x.k AS xk, y.k AS yk, a, b FROM {_DX} FULL JOIN {_DY} ON x.k = y.k")
_add("natural_join", f"SELECT * FROM {_X} NATURAL LEFT JOIN {_Y}", f"SELECT x.k, a, b FROM {_DX} LEFT JOIN {_DY} ON x.k = y.k")
_add("natural_right_join", f"SELECT * FROM {_X} NATURAL RIGHT JOIN {_Y}", f"SELECT y.k, a, b FROM {_DX} RIGHT JOIN {_DY} ON x.k = y.k")
_add("self_join", "SELECT a.c_custkey AS x, COUNT(*) AS n FROM customer a JOIN customer b ON a.c_nationkey = b.c_nationkey GROUP BY a.c_custkey", "SELECT a.c_custkey AS x, count(*) AS n FROM customer a JOIN customer b ON a.c_nationkey = b.c_nationkey GROUP BY 1")
# -- aggregation
_add("grouped_aggregate", "SELECT l_returnflag, l_linestatus, COUNT(*) AS n, ROUND(SUM(l_quantity), 2) AS q, ROUND(AVG(l_extendedprice), 2) AS p, MIN(l_shipdate) AS a, MAX(l_shipdate) AS b, SUM(l_linenumber) AS s, COUNT(DISTINCT l_suppkey) AS d FROM lineitem GROUP BY l_returnflag, l_linestatus", "SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS q, round(avg(l_extendedprice), 2) AS p, min(l_shipdate)::DATE AS a, max(l_shipdate)::DATE AS b, sum(l_linenumber)::BIGINT AS s, count(DISTINCT l_suppkey) AS d FROM lineitem GROUP BY 1, 2")
_add("global_aggregate", "SELECT COUNT(*) AS n, COUNT(a) AS na, SUM(a) AS s, AVG(a) AS m, MIN(a) AS lo, MAX(a) AS hi, SUM(a > 2) AS t, MAX(a > 2) AS u FROM " + _E, "SELECT count(*) AS n, count(a) AS na, sum(a)::BIGINT AS s, avg(a) AS m, min(a) AS lo, max(a) AS hi, sum((a > 2)::INT)::BIGINT AS t, max(a > 2) AS u FROM " + _D)
_add("empty_input_aggregate", "SELECT COUNT(*) AS n, COUNT(r_regionkey) AS m, SUM(r_regionkey) AS s, MAX(r_name) AS x FROM region WHERE r_regionkey < 0", "SELECT count(*) AS n, count(r_regionkey) AS m, sum(r_regionkey)::BIGINT AS s, max(r_name) AS x FROM region WHERE r_regionkey < 0")
_add("group_ordinal_alias", "SELECT o_orderstatus AS s, YEAR(o_orderdate) AS y, COUNT(*) AS n FROM orders GROUP BY 1, y", "SELECT o_orderstatus AS s, year(o_orderdate) AS y, count(*) AS n FROM orders GROUP BY 1, 2")
_add("group_column_before_alias", "SELECT n_nationkey % 2 AS n_regionkey, COUNT(*) AS n FROM nation GROUP BY n_nationkey % 2, n_regionkey", "SELECT n_nationkey::BIGINT % 2 AS n_regionkey, count(*) AS n FROM nation GROUP BY n_nationkey::BIGINT % 2, nation.n_regionkey")
_add("group_expression", "SELECT o_custkey % 10 + 1 AS k, MAX(o_totalprice) - MIN(o_totalprice) AS d FROM orders GROUP BY o_custkey % 10", "SELECT o_custkey % 10 + 1 AS k, max(o_totalprice) - min(o_totalprice) AS d FROM orders GROUP BY o_custkey % 10")
_add("having", "SELECT o_custkey, COUNT(*) AS n FROM orders GROUP BY o_custkey HAVING COUNT(*) > 12", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) > 12")
_add("having_alias", "SELECT n_regionkey + 10 AS n_regionkey, COUNT(*) AS c FROM nation GROUP BY n_nationkey, n_regionkey HAVING n_regionkey > 12 AND c > 0", "SELECT n_regionkey::BIGINT + 10 AS n_regionkey, count(*) AS c FROM nation GROUP BY n_nationkey, nation.n_regionkey HAVING nation.n_regionkey + 10 > 12")
_add("having_without_group", "SELECT COUNT(*) AS n FROM orders HAVING COUNT(*) > 1", "SELECT count(*) AS n FROM orders HAVING count(*) > 1")
_add("count_distinct_tuple", f"SELECT b, COUNT(DISTINCT a, event_id % 4) AS n, SUM(DISTINCT a) AS s, AVG(DISTINCT a) AS m, MIN(DISTINCT a) AS l FROM {_E} GROUP BY b", f"SELECT b, count(DISTINCT CASE WHEN a IS NOT NULL THEN (a, event_id % 4) END) AS n, sum(DISTINCT a)::BIGINT AS s, avg(DISTINCT a) AS m, min(a) AS l FROM {_D} GROUP BY b")
_add("fd_grouping", "SELECT c.c_custkey, c.c_name, c.c_mktsegment, COUNT(o.o_orderkey) AS n FROM customer c LEFT JOIN orders o ON c.c_custkey = o.o_custkey GROUP BY c.c_custkey", "SELECT c_custkey, c_name, c_mktsegment, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY 1, 2, 3")
_add("aggregate_expressions", "SELECT o_orderstatus, ROUND(SUM(o_totalprice) / COUNT(o_orderkey), 2) AS m, CASE WHEN COUNT(*) > 5000 THEN 'many' ELSE 'few' END AS size FROM orders GROUP BY o_orderstatus", "SELECT o_orderstatus, round(sum(o_totalprice) / count(o_orderkey), 2) AS m, CASE WHEN count(*) > 5000 THEN 'many' ELSE 'few' END AS size FROM orders GROUP BY 1")
# -- windows
_add("row_number", "SELECT event_id, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) AS r FROM events", "SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts::DATE DESC, event_id) AS r FROM events")
_add("rank_dense_rank", "SELECT c_custkey, RANK() OVER (ORDER BY c_nationkey) AS r, DENSE_RANK() OVER (PARTITION BY c_mktsegment ORDER BY c_nationkey DESC) AS d, RANK() OVER (PARTITION BY c_mktsegment) AS one FROM customer", "SELECT c_custkey, rank() OVER (ORDER BY c_nationkey NULLS FIRST) AS r, dense_rank() OVER (PARTITION BY c_mktsegment ORDER BY c_nationkey DESC NULLS LAST) AS d, 1::BIGINT AS one FROM customer")
_add("window_whole", "SELECT o_orderkey, COUNT(*) OVER (PARTITION BY o_custkey) AS n, MAX(o_totalprice) OVER (PARTITION BY o_custkey) AS m, MIN(o_orderdate) OVER (PARTITION BY o_custkey) AS d, COUNT(*) OVER (PARTITION BY NULL) AS everything FROM orders", "SELECT o_orderkey, count(*) OVER (PARTITION BY o_custkey) AS n, max(o_totalprice) OVER (PARTITION BY o_custkey) AS m, min(o_orderdate) OVER (PARTITION BY o_custkey)::DATE AS d, count(*) OVER () AS everything FROM orders")
_add("window_running", "SELECT o_orderkey, SUM(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate) AS s, COUNT(*) OVER (PARTITION BY o_custkey ORDER BY o_orderdate) AS n, AVG(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate) AS m FROM orders", "SELECT o_orderkey, sum(o_orderkey) OVER w AS s, count(*) OVER w AS n, avg(o_orderkey) OVER w AS m FROM (SELECT o_orderkey, o_custkey, o_orderdate::DATE AS d FROM orders) WINDOW w AS (PARTITION BY o_custkey ORDER BY d)".replace("sum(o_orderkey) OVER w AS s", "(sum(o_orderkey) OVER w)::BIGINT AS s"))
_add("window_distinct", "SELECT event_id, COUNT(DISTINCT event_type) OVER (PARTITION BY user_id) AS n, SUM(DISTINCT event_id % 10) OVER (PARTITION BY user_id ORDER BY event_id) AS s FROM events", "SELECT event_id, count(DISTINCT event_type) OVER (PARTITION BY user_id) AS n, (sum(DISTINCT event_id % 10) OVER (PARTITION BY user_id ORDER BY event_id))::BIGINT AS s FROM events")
_add("first_value", "SELECT o_orderkey, FIRST_VALUE(o_orderstatus) OVER (PARTITION BY o_custkey ORDER BY o_totalprice, o_orderkey) AS f, CASE WHEN ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) = 1 THEN 'first' ELSE 'later' END AS g FROM orders", "SELECT o_orderkey, first_value(o_orderstatus) OVER (PARTITION BY o_custkey ORDER BY o_totalprice, o_orderkey) AS f, CASE WHEN row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) = 1 THEN 'first' ELSE 'later' END AS g FROM orders")
_add("window_nulls_order", f"SELECT event_id, DENSE_RANK() OVER (ORDER BY a NULLS LAST, b DESC NULLS FIRST) AS r FROM {_E}", f"SELECT event_id, dense_rank() OVER (ORDER BY a NULLS LAST, b DESC NULLS FIRST) AS r FROM {_D}")
# -- order, slices, distinct
_add("order_by", f"SELECT a, b, event_id FROM {_E} ORDER BY a DESC, b, 3 LIMIT 50", f"SELECT a, b, event_id FROM {_D} ORDER BY a DESC NULLS LAST, b NULLS FIRST, event_id LIMIT 50")
_add("limit_offset", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10 OFFSET 5", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10 OFFSET 5")
_add("limit_comma", "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 3, 4", "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 4 OFFSET 3")
_add("order_in_derived", "SELECT t.o_orderkey + 1 AS k FROM (SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey) t LIMIT 5", "SELECT o_orderkey + 1 AS k FROM (SELECT o_orderkey FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 5)")
_add("distinct", f"SELECT DISTINCT a, b FROM {_E}", f"SELECT DISTINCT a, b FROM {_D}")
# -- set operations
_C, _S = "SELECT c_nationkey AS k FROM customer", "SELECT s_nationkey AS k FROM supplier"
_DC, _DS = _C.replace("c_nationkey", "c_nationkey::BIGINT"), _S.replace("s_nationkey", "s_nationkey::BIGINT")
for _op in ("UNION", "INTERSECT", "EXCEPT"):
    for _all in ("", " ALL"):
        _add(f"{_op}{_all}".lower().replace(" ", "_"), f"{_C} {_op}{_all} {_S}", f"{_DC} {_op}{_all} {_DS}")
_add("set_precedence", f"{_C} UNION {_S} INTERSECT SELECT n_nationkey AS k FROM nation WHERE n_nationkey > 20 ORDER BY k", f"SELECT * FROM ({_DC} UNION {_DS} INTERSECT SELECT n_nationkey::BIGINT AS k FROM nation WHERE n_nationkey > 20) ORDER BY k")
# -- subqueries
_add("exists", "SELECT c_custkey FROM customer c WHERE EXISTS (SELECT 1 AS one FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 350000.0)", "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 350000)")
_add("not_exists", "SELECT c_custkey FROM customer c WHERE NOT EXISTS (SELECT 1 AS one FROM orders o WHERE o.o_custkey = c.c_custkey)", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
_add("in_subquery", "SELECT c_custkey FROM customer WHERE c_nationkey IN (SELECT s_nationkey FROM supplier WHERE s_acctbal > 0.0)", "SELECT c_custkey FROM customer WHERE c_nationkey IN (SELECT s_nationkey FROM supplier WHERE s_acctbal > 0)")
_add("not_in_subquery", f"SELECT event_id FROM {_E} WHERE a NOT IN (SELECT n_regionkey FROM nation WHERE n_nationkey > 22)", f"SELECT event_id FROM {_D} WHERE a NOT IN (SELECT n_regionkey FROM nation WHERE n_nationkey > 22)")
_add("in_projection_3vl", f"SELECT event_id, a IN (SELECT NULLIF(r_regionkey, 1) AS k FROM region) AS x, a NOT IN (SELECT r_regionkey FROM region WHERE r_regionkey < 3) AS y, (a IN (SELECT r_regionkey FROM region WHERE r_regionkey > 9)) IS NULL AS z FROM {_E}", f"SELECT event_id, a IN (SELECT nullif(r_regionkey, 1) FROM region) AS x, a NOT IN (SELECT r_regionkey FROM region WHERE r_regionkey < 3) AS y, (a IN (SELECT r_regionkey FROM region WHERE r_regionkey > 9)) IS NULL AS z FROM {_D}")
_add("row_in_subquery", f"SELECT event_id, (a, b) IN (SELECT n_regionkey, NULLIF(n_nationkey % 3, 0) AS k FROM nation WHERE n_nationkey < 7) AS x FROM {_E}", f"SELECT event_id, CASE WHEN EXISTS (SELECT 1 FROM w WHERE a = p AND b = q) THEN true WHEN EXISTS (SELECT 1 FROM w WHERE coalesce(a = p, true) AND coalesce(b = q, true)) THEN NULL ELSE false END AS x FROM {_D}, (SELECT 1) WHERE true".replace("SELECT event_id", "WITH w AS (SELECT n_regionkey::BIGINT AS p, nullif(n_nationkey % 3, 0)::BIGINT AS q FROM nation WHERE n_nationkey < 7) SELECT event_id", 1))
_add("quantified", "SELECT n_nationkey FROM nation WHERE n_regionkey = ANY (SELECT r_regionkey FROM region WHERE r_regionkey > 2) OR n_nationkey <> ALL (SELECT s_nationkey FROM supplier)", "SELECT n_nationkey::BIGINT AS n_nationkey FROM nation WHERE n_regionkey IN (SELECT r_regionkey FROM region WHERE r_regionkey > 2) OR n_nationkey NOT IN (SELECT s_nationkey FROM supplier)")
_add("scalar_subquery", "SELECT c_custkey, (SELECT MAX(o_totalprice) FROM orders o WHERE o.o_custkey = c.c_custkey) AS m, (SELECT COUNT(*) FROM orders o WHERE o.o_custkey = c.c_custkey) AS n, (SELECT r_name FROM region ORDER BY r_name DESC LIMIT 1) AS r FROM customer c", "SELECT c_custkey, (SELECT max(o_totalprice) FROM orders WHERE o_custkey = c_custkey) AS m, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) AS n, (SELECT r_name FROM region ORDER BY r_name DESC LIMIT 1) AS r FROM customer")
_add("correlated_top_one", "SELECT c_custkey, (SELECT o_orderkey FROM orders o WHERE o.o_custkey = c.c_custkey ORDER BY 1 DESC LIMIT 1) AS k FROM customer c", "SELECT c_custkey, (SELECT max(o_orderkey) FROM orders WHERE o_custkey = c_custkey) AS k FROM customer")
_add("deep_correlation", "SELECT n_nationkey FROM nation n WHERE EXISTS (SELECT 1 AS one FROM customer c WHERE c.c_nationkey = n.n_nationkey AND EXISTS (SELECT 1 AS one FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_orderkey % 25 = n.n_nationkey))", "SELECT n_nationkey::BIGINT AS n_nationkey FROM nation n WHERE EXISTS (SELECT 1 FROM customer c JOIN orders o ON o.o_custkey = c.c_custkey WHERE c.c_nationkey = n.n_nationkey AND o.o_orderkey % 25 = n.n_nationkey)")
_add("level_skipping", "SELECT n_nationkey FROM nation n WHERE EXISTS (SELECT 1 AS one FROM region r WHERE r.r_regionkey < 2 AND EXISTS (SELECT 1 AS one FROM supplier s WHERE s.s_nationkey = n.n_nationkey))", "SELECT n_nationkey::BIGINT AS n_nationkey FROM nation n WHERE n_nationkey IN (SELECT s_nationkey FROM supplier)")
_add("exists_in_projection", "SELECT c_custkey, EXISTS (SELECT 1 AS one FROM orders o WHERE o.o_custkey = c.c_custkey) AS e, CASE WHEN c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P') THEN 'p' ELSE 'n' END AS f FROM customer c", "SELECT c_custkey, EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey) AS e, CASE WHEN c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P') THEN 'p' ELSE 'n' END AS f FROM customer")
_add("having_subquery", "SELECT o_custkey, SUM(o_totalprice) AS s FROM orders GROUP BY o_custkey HAVING MAX(o_totalprice) >= (SELECT MAX(o_totalprice) FROM orders) AND o_custkey IN (SELECT c_custkey FROM customer)", "SELECT o_custkey, sum(o_totalprice) AS s FROM orders GROUP BY 1 HAVING max(o_totalprice) >= (SELECT max(o_totalprice) FROM orders)")


def session_engine(spark: SparkSession, sf_dir: str, texts: tuple[str, ...] = ()) -> Engine:
    """An engine with the tables that the texts mention, or all."""
    words = {w for t in texts for w in re.findall(r"\w+", t.lower())}
    return Engine(spark).read_parquet(sf_dir, KEYS, [t for t in KEYS if not texts or t in words])


def _runner(text: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: session_engine(spark, sf_dir, (text, "region")).sql(text)


QUERIES = {name: _runner(text) for name, (text, _) in SQL.items()}
ORACLES = {name: oracle or text for name, (text, oracle) in SQL.items()}


# -- policies, constraints, comparisons and verdicts: queries that are more than one text
def _first_row_grouping(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = Engine(spark, Policies(first_row_grouping=True)).read_parquet(sf_dir, KEYS, ["orders"])
    return engine.sql("SELECT o_custkey, o_orderkey AS first_order, COUNT(*) AS n FROM orders GROUP BY o_custkey")


def _mysql_coercion(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = Engine(spark, Policies(mysql_coercion=True)).read_parquet(sf_dir, KEYS, ["nation"])
    return engine.sql("SELECT n_nationkey, n_nationkey = 3.0 AS a, n_nationkey + TRUE AS b, CAST(n_nationkey AS DOUBLE) AS c FROM nation WHERE n_regionkey")


def _ignored_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = Engine(spark, Policies(ignore_top_level_order=True)).read_parquet(sf_dir, KEYS, ["region"])
    text = "SELECT r_name FROM region ORDER BY r_name"
    return engine.sql(text).select("r_name", F.lit(engine.bind(text).ordered).alias("ordered"))


def _exact_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = Engine(spark, exact=True).read_parquet(sf_dir, KEYS, ["customer"])
    out = engine.sql("SELECT c_custkey, c_custkey / 3 AS third, TRUNCATE(c_custkey / 7, 3) AS cut, ROUND(c_custkey / 8, 2) AS near FROM customer")
    return out.select("c_custkey", *[F.col(c).cast("decimal(18,9)").cast("string").alias(c) for c in ("third", "cut", "near")])


STAR = (
    ForeignKey("nation", ("n_regionkey",), "region", ("r_regionkey",)),
    ForeignKey("customer", ("c_nationkey",), "nation", ("n_nationkey",)),
    ForeignKey("orders", ("o_custkey",), "customer", ("c_custkey",)),
    ForeignKey("lineitem", ("l_orderkey",), "orders", ("o_orderkey",)),
    Unique("nation", ("n_name",)),
    Unique("customer", ("c_nationkey",)),
    Check("lineitem.l_quantity BETWEEN 1 AND 50"),
    Check("orders.o_totalprice > 1000.0"),
)


def _constraint_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many rows or keys violate each declaration."""
    engine = session_engine(spark, sf_dir)
    engine.constraints = STAR
    found = [(n, df) for n, df in violations(engine.frames, engine.schema.validate()) if not n.startswith("not null")]
    counts = [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("name"), "n") for name, df in found]
    return reduce(DataFrame.unionAll, counts)


_BAG = ("SELECT o_custkey AS k, o_orderstatus AS s FROM orders", "SELECT o_custkey AS k, o_orderstatus AS s FROM orders WHERE o_orderstatus <> 'P' UNION ALL SELECT c_custkey, 'P' AS s FROM customer")


def _bag_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = session_engine(spark, sf_dir)
    return bag_difference(*map(engine.sql, _BAG))


def _bag_equality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows on which two ways to say the same differ: none."""
    engine = session_engine(spark, sf_dir)
    left = engine.sql("SELECT l_orderkey, l_linenumber FROM lineitem WHERE NOT (l_quantity > 25.0) AND l_returnflag IN ('A', 'R')")
    right = engine.sql("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity <= 25.0 AND l_returnflag = 'A' UNION ALL SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_returnflag = 'R' AND l_quantity <= 25.0")
    return bag_difference(left, right).agg(F.count(F.lit(1)).alias("differing"))


def _list_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places at which two rankings differ."""
    engine = session_engine(spark, sf_dir)
    left = engine.sql("SELECT s_suppkey AS k, s_acctbal AS a FROM supplier")
    right = engine.sql("SELECT s_suppkey AS k, s_acctbal AS a FROM supplier")
    return list_difference(left, right, [F.col("a").desc(), F.col("k").asc()], [F.abs("a").desc(), F.col("k").asc()]).select(F.col("__n").cast("long").alias("place"))


_PART = Schema((Table("part", (Column("partkey", "int", False), Column("size", "int"), Column("retail", "bool"))),))
_ORDERS = Schema((Table("orders", (Column("orderkey", "int"), Column("parent", "int")), ("orderkey",)),))
_LINES = Schema((Table("lines", (Column("price", "num"), Column("shipped", "date"), Column("at", "time"), Column("big", "int"))),))
_PAIRS = [
    ("negated_comparison", _PART, "SELECT partkey FROM part WHERE NOT (size >= 30 OR retail)", "SELECT partkey FROM part WHERE size < 30 AND NOT retail", "equivalent"),
    ("unknown_is_not_true", _PART, "SELECT size FROM part WHERE size <> 7 OR size = 7", "SELECT size FROM part", "different"),
    ("self_join_without_key", Schema((Table("region", (Column("name", "text", False),)),)), "SELECT a.name FROM region a, region b WHERE a.name = b.name", "SELECT name FROM region", "different"),
    ("self_join_on_key", _ORDERS, "SELECT a.orderkey, b.parent FROM orders a JOIN orders b ON a.orderkey = b.orderkey", "SELECT orderkey, parent FROM orders", "equivalent"),
    ("exists_and_in", _ORDERS, "SELECT orderkey FROM orders o WHERE EXISTS (SELECT 1 AS one FROM orders c WHERE c.parent = o.orderkey)", "SELECT orderkey FROM orders WHERE orderkey IN (SELECT parent FROM orders)", "equivalent"),
    ("not_in_with_nulls", _ORDERS, "SELECT orderkey FROM orders WHERE orderkey NOT IN (SELECT parent FROM orders)", "SELECT orderkey FROM orders o WHERE NOT EXISTS (SELECT 1 AS one FROM orders c WHERE c.parent = o.orderkey)", "different"),
    ("twice_by_count_and_by_number", _PART, "SELECT size FROM part GROUP BY size HAVING COUNT(*) >= 2", "SELECT size FROM (SELECT size, ROW_NUMBER() OVER (PARTITION BY size ORDER BY partkey) AS r FROM part) t WHERE r = 2", "equivalent"),
    ("order_of_nulls", _PART, "SELECT size FROM part ORDER BY size NULLS FIRST", "SELECT size FROM part ORDER BY size NULLS LAST", "different"),
    ("list_and_bag", _PART, "SELECT size FROM part ORDER BY size", "SELECT size FROM part", "unsupported_sql"),
    ("ungrouped_column", _PART, "SELECT retail, size FROM part GROUP BY retail", "SELECT retail, size FROM part", "type_error"),
    ("other_types", _PART, "SELECT size FROM part", "SELECT retail FROM part", "different"),
    ("count_as_sum_of_cases", _PART, "SELECT COUNT(size) AS n FROM part", "SELECT COALESCE(SUM(CASE WHEN size IS NULL THEN 0 ELSE 1 END), 0) AS n FROM part", "equivalent"),
    ("row_numbers_moved", _PART, "SELECT partkey, ROW_NUMBER() OVER (ORDER BY partkey, size, retail) + 1 AS n FROM part", "SELECT partkey, 1 + RANK() OVER (ORDER BY partkey, size, retail) AS n FROM part", "different"),
    ("shares_of_a_count", _PART, "SELECT retail, COUNT(*) * 2 AS n FROM part GROUP BY retail", "SELECT retail, SUM(2) AS n FROM part GROUP BY retail", "equivalent"),
    ("folded_constants", _PART, "SELECT size FROM part WHERE size < 2 * 3 + FLOOR(1.5)", "SELECT size FROM part WHERE size <= 6 AND TRUNCATE(1.239, 2) = 1.23", "equivalent"),
]
#: Pairs that rounding, wrapping or a value left out would decide wrongly.
_SOUND = [
    ("half_a_second", _LINES, "SELECT big FROM lines WHERE at = TIME '10:30:00.5'", "SELECT big FROM lines WHERE FALSE", "different"),
    ("within_a_second", _LINES, "SELECT big FROM lines WHERE at > TIME '10:30:00.2' AND at < TIME '10:30:00.7'", "SELECT big FROM lines WHERE FALSE", "different"),
    ("no_time_between", _LINES, "SELECT big FROM lines WHERE at > TIME '10:30:00.000001' AND at < TIME '10:30:00.000002'", "SELECT big FROM lines WHERE FALSE", "equivalent"),
    ("last_day", _LINES, "SELECT big FROM lines WHERE shipped <= DATE '9999-12-31'", "SELECT big FROM lines WHERE shipped IS NOT NULL", "equivalent"),
    ("first_day", _LINES, "SELECT big FROM lines WHERE shipped < DATE '0001-01-01'", "SELECT big FROM lines WHERE FALSE", "equivalent"),
    ("largest_integer", _LINES, "SELECT big FROM lines WHERE big <= 9223372036854775807", "SELECT big FROM lines WHERE big IS NOT NULL", "equivalent"),
    ("thirds", _LINES, "SELECT big / 3 * 3 AS x FROM lines", "SELECT big * 1.0 AS x FROM lines", "solver"),
    ("small_divisor", _LINES, "SELECT price / 0.0000001 AS x FROM lines WHERE price = 0.0000001", "SELECT 1.0 AS x FROM lines WHERE price = 0.0000001", "solver"),
    ("beyond_64_bits", _LINES, "SELECT big FROM lines WHERE big = 9000000000000000000 AND big + big > big", "SELECT big FROM lines WHERE big = 9000000000000000000", "solver"),
    ("large_product", _LINES, "SELECT 20000000000 * 2.0 * price AS x FROM lines", "SELECT 40000000000.0 * price AS x FROM lines", "solver"),
    ("tenths", _LINES, "SELECT price FROM lines WHERE price + 0.1 + 0.2 = 0.3 AND price = 0.0", "SELECT price FROM lines WHERE price = 0.0", "solver"),
    ("many_literals", _LINES, "SELECT big FROM lines WHERE big IN (10, 20, 30, 40, 50, 60, 70, 80, 90, 95) AND big + 0 <> 95", "SELECT big FROM lines WHERE big IN (10, 20, 30, 40, 50, 60, 70, 80, 90, 95)", "different"),
]


def _verdict(v) -> str:
    return {"Equivalent": "equivalent", "Different": "different"}.get(type(v).__name__) or v.reason.value


def _verdicts(pairs: list) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = Verifier(spark).verify_many([(schema, a, b) for _, schema, a, b, _ in pairs])
        return spark.createDataFrame([(p[0], _verdict(v)) for p, v in zip(pairs, found, strict=True)], "pair string, verdict string")

    return run


def _verify_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = Schema((Table("items", (Column("id", "int", False),)),))
    found = Verifier(spark).verify_bounds(schema, "SELECT a.id FROM items a, items b WHERE a.id <> b.id", "SELECT id FROM items WHERE FALSE", [1, 2, 3])
    return spark.createDataFrame([(b, _verdict(v)) for b, v in found.items()], "bound int, verdict string")


QUERIES |= {
    "first_row_grouping": _first_row_grouping, "mysql_coercion": _mysql_coercion, "ignored_order": _ignored_order, "exact_numbers": _exact_numbers,
    "constraint_violations": _constraint_violations, "bag_difference": _bag_difference, "bag_equality": _bag_equality, "list_difference": _list_difference,
    "verify_pairs": _verdicts(_PAIRS), "verify_soundness": _verdicts(_SOUND), "verify_bounds": _verify_bounds,
}


def _orphans(table: str, column: str, other: str, key: str) -> str:
    return f"SELECT 'foreign key {table}' AS name, count(*) AS n FROM {table} WHERE {column} IS NOT NULL AND {column} NOT IN (SELECT {key} FROM {other})"


def _repeats(kind: str, table: str, column: str) -> str:
    return f"SELECT '{kind} {table}' AS name, count(*) AS n FROM (SELECT {column} FROM {table} WHERE {column} IS NOT NULL GROUP BY 1 HAVING count(*) > 1)"


ORACLES |= {
    "first_row_grouping": "SELECT o_custkey, min(o_orderkey) AS first_order, count(*) AS n FROM orders GROUP BY 1",
    "mysql_coercion": "SELECT n_nationkey::BIGINT AS n_nationkey, n_nationkey = 3 AS a, n_nationkey::BIGINT + 1 AS b, n_nationkey::DOUBLE AS c FROM nation WHERE n_regionkey <> 0",
    "ignored_order": "SELECT r_name, false AS ordered FROM region",
    "exact_numbers": "SELECT c_custkey, a // 1000000000 || '.' || lpad((a % 1000000000)::VARCHAR, 9, '0') AS third, b // 1000 || '.' || lpad((b % 1000)::VARCHAR, 3, '0') || '000000' AS cut, c // 100 || '.' || lpad((c % 100)::VARCHAR, 2, '0') || '0000000' AS near FROM (SELECT c_custkey, (c_custkey * 2000000000 + 3) // 6 AS a, c_custkey * 1000 // 7 AS b, (c_custkey * 200 + 8) // 16 AS c FROM customer)",
    "constraint_violations": " UNION ALL ".join(
        [_repeats("primary key", t, k[0]) for t, k in KEYS.items() if k]
        + [_orphans("nation", "n_regionkey", "region", "r_regionkey"), _orphans("customer", "c_nationkey", "nation", "n_nationkey"), _orphans("orders", "o_custkey", "customer", "c_custkey"), _orphans("lineitem", "l_orderkey", "orders", "o_orderkey")]
        + [_repeats("unique", "nation", "n_name"), _repeats("unique", "customer", "c_nationkey")]
        + ["SELECT 'check lineitem.l_quantity BETWEEN 1 AND 50' AS name, count(*) AS n FROM lineitem WHERE NOT l_quantity BETWEEN 1 AND 50", "SELECT 'check orders.o_totalprice > 1000.0' AS name, count(*) AS n FROM orders WHERE NOT o_totalprice > 1000"]
    ),
    "bag_difference": "SELECT k, s, sum(d)::BIGINT AS surplus FROM (SELECT o_custkey AS k, o_orderstatus AS s, 1 AS d FROM orders UNION ALL SELECT o_custkey, o_orderstatus, -1 FROM orders WHERE o_orderstatus <> 'P' UNION ALL SELECT c_custkey, 'P', -1 FROM customer) GROUP BY 1, 2 HAVING sum(d) <> 0",
    "bag_equality": "SELECT 0::BIGINT AS differing",
    "list_difference": "SELECT x.n AS place FROM (SELECT s_suppkey, row_number() OVER (ORDER BY s_acctbal DESC, s_suppkey) AS n FROM supplier) x JOIN (SELECT s_suppkey, row_number() OVER (ORDER BY abs(s_acctbal) DESC, s_suppkey) AS n FROM supplier) y ON x.n = y.n WHERE x.s_suppkey <> y.s_suppkey",
    **{
        name: "SELECT * FROM (VALUES " + ", ".join(f"('{n}', '{v}')" for n, _, _, _, v in pairs) + ") t(pair, verdict)"
        for name, pairs in (("verify_pairs", _PAIRS), ("verify_soundness", _SOUND))
    },
    "verify_bounds": "SELECT * FROM (VALUES (1::INT, 'equivalent'), (2, 'different'), (3, 'different')) t(bound, verdict)",
}
