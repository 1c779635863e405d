"""The relational queries over the supplied tables: each in the engine's dialect and in DuckDB's SQL."""

from __future__ import annotations

from collections.abc import Callable
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import joins, ordering
from ..sources.files import Files
from .builder import Builder
from .parser import parse


#: Tables opened so far by session, with the time of their last change: schema and files are looked up again once that differs.
_OPEN: WeakKeyDictionary = WeakKeyDictionary()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    opened, path = _OPEN.setdefault(spark, {}), f"{sf_dir}/{name}.parquet"
    now = Files(spark).changed(path)
    if opened.get(path, (None,))[0] != now:
        opened[path] = now, spark.read.parquet(path)
    return opened[path][1]


def run(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """A dialect query over the Parquet tables of a folder."""
    return Builder(spark, lambda name: table(spark, sf_dir, name)).run(parse(sql))


#: name: (dialect, DuckDB or None where the text is the same)
SQL: dict[str, tuple[str, str | None]] = {
    "scan_project": ("SELECT p_partkey, p_name, p_size size_of FROM part", None),
    "select_star": ("SELECT * FROM nation", None),
    "filter_cmp_3vl": (
        "SELECT l_orderkey, l_linenumber FROM lineitem WHERE (l_quantity > 45 OR l_discount >= 0.09) AND NOT l_returnflag = 'R' AND l_tax <> 0.02", None),
    "filter_null": (
        "SELECT d.doc_id, l.quality FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id WHERE l.quality IS NULL OR l.toxic IS NOT NULL AND l.quality = 1", None),
    "filter_3vl_null_not": (
        "SELECT COUNT(*) AS n FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id WHERE NOT (l.quality = 1 AND d.n_chars > 100)", None),
    "filter_like": (
        "SELECT p_partkey, p_name FROM part WHERE p_name LIKE '%a_1%' AND p_type NOT LIKE 'S%'", None),
    "filter_between_in": (
        "SELECT p_partkey FROM part WHERE p_size BETWEEN 10 AND 20 AND p_size NOT BETWEEN 13 AND 14 AND p_brand IN ('Brand#11', 'Brand#23', 'Brand#45') AND p_size NOT IN (11, 12)", None),
    "filter_in_null": (
        "SELECT n_nationkey FROM nation WHERE n_regionkey IN (1, NULL) AND n_nationkey NOT IN (3, 4)", None),
    "filter_not_in_null": ("SELECT COUNT(*) AS n FROM nation WHERE n_regionkey NOT IN (1, NULL)", None),
    "filter_bool_number": (
        "SELECT COUNT(*) AS n FROM nation WHERE (n_regionkey = 1) = 1", "SELECT COUNT(*) AS n FROM nation WHERE CAST(n_regionkey = 1 AS INTEGER) = 1"),
    "point_lookup": ("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey = 77", None),
    "range_scan": ("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey BETWEEN 100 AND 299", None),
    "range_count": ("SELECT COUNT(*) AS n FROM orders WHERE o_orderkey >= 1 AND o_orderkey <= 5000", None),
    "composite_lookup": ("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_orderkey = 33 AND l_linenumber >= 2", None),
    "covering_scan": ("SELECT o_custkey FROM orders WHERE o_custkey < 50", None),
    "count_star": ("SELECT COUNT(*) AS n FROM lineitem", None),
    "one_row_expr": ("SELECT 1+2*3 AS a, 10%3 AS b, (1+2)*3 AS c, -7%3 AS d", None),
    "one_row_false": ("SELECT 1 AS one WHERE FALSE", None),
    "one_row_count": ("SELECT COUNT(*) AS n", None),
    "one_row_having": ("SELECT 1 AS one HAVING TRUE", "SELECT 1 AS one"),
    "derived_table": (
        "SELECT s.f, COUNT(*) AS n FROM (SELECT l_returnflag AS f, l_quantity AS q FROM lineitem WHERE l_quantity > 10) s WHERE s.q < 40 GROUP BY s.f", None),
    "derived_join": (
        "SELECT c.c_custkey, t.n FROM customer c INNER JOIN (SELECT o_custkey AS k, COUNT(*) AS n FROM orders GROUP BY o_custkey) t ON c.c_custkey = t.k WHERE t.n > 12", None),
    "inner_join": ("SELECT n.n_name, r.r_name FROM nation n INNER JOIN region r ON n.n_regionkey = r.r_regionkey", None),
    "left_join": (
        "SELECT c.c_custkey, o.o_orderkey FROM customer c LEFT JOIN orders o ON c.c_custkey = o.o_custkey AND o.o_totalprice > 300000", None),
    "left_anti_null": (
        "SELECT c.c_custkey FROM customer c LEFT JOIN orders o ON c.c_custkey = o.o_custkey WHERE o.o_orderkey IS NULL", None),
    "cross_join": ("SELECT r.r_name, n.n_name FROM region r CROSS JOIN nation n WHERE n.n_nationkey < 3", None),
    "self_join": (
        "SELECT a.n_name AS left_name, b.n_name AS right_name FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey WHERE a.n_nationkey < b.n_nationkey", None),
    "multi_join": (
        "SELECT r.r_name, COUNT(*) AS n_orders, ROUNDED.x AS one FROM region r JOIN nation n ON r.r_regionkey = n.n_regionkey JOIN customer c ON c.c_nationkey = n.n_nationkey "
        "JOIN orders o ON o.o_custkey = c.c_custkey CROSS JOIN (SELECT 1 AS x) ROUNDED WHERE o.o_orderstatus = 'F' GROUP BY r.r_name, ROUNDED.x", None),
    "theta_join": ("SELECT n.n_nationkey, r.r_regionkey FROM nation n JOIN region r ON n.n_regionkey < r.r_regionkey OR n.n_nationkey = r.r_regionkey", None),
    "theta_left_join": ("SELECT r.r_regionkey, n.n_nationkey FROM region r LEFT JOIN nation n ON n.n_nationkey > r.r_regionkey * 10", None),
    "join_count": ("SELECT COUNT(*) AS n FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey", None),
    "plain_agg": (
        "SELECT COUNT(*) AS n, COUNT(l_tax) AS nt, SUM(l_linenumber) AS s, AVG(l_linenumber) AS a, MIN(l_shipdate) AS lo, MAX(l_returnflag) AS hi FROM lineitem",
        "SELECT COUNT(*) AS n, COUNT(l_tax) AS nt, CAST(SUM(l_linenumber) AS BIGINT) AS s, AVG(l_linenumber) AS a, MIN(l_shipdate) AS lo, MAX(l_returnflag) AS hi FROM lineitem"),
    "empty_agg": (
        "SELECT COUNT(*) AS n, COUNT(l_tax) AS nt, SUM(l_linenumber) AS s, AVG(l_tax) AS a, MIN(l_tax) AS lo FROM lineitem WHERE FALSE",
        "SELECT COUNT(*) AS n, COUNT(l_tax) AS nt, CAST(SUM(l_linenumber) AS BIGINT) AS s, AVG(l_tax) AS a, MIN(l_tax) AS lo FROM lineitem WHERE FALSE"),
    "distinct_aggs": (
        "SELECT COUNT(DISTINCT l_suppkey) AS c, SUM(DISTINCT l_linenumber) AS s, AVG(DISTINCT l_linenumber) AS a, MIN(DISTINCT l_linenumber) AS lo, MAX(DISTINCT l_linenumber) AS hi FROM lineitem",
        "SELECT COUNT(DISTINCT l_suppkey) AS c, CAST(SUM(DISTINCT l_linenumber) AS BIGINT) AS s, AVG(DISTINCT l_linenumber) AS a, MIN(l_linenumber) AS lo, MAX(l_linenumber) AS hi FROM lineitem"),
    "group_by": ("SELECT l_returnflag, l_linestatus, COUNT(*) AS n, MIN(l_quantity) AS lo, MAX(l_quantity) AS hi FROM lineitem GROUP BY l_returnflag, l_linestatus", None),
    "group_null": (
        "SELECT l.quality AS q, COUNT(*) AS n FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id GROUP BY l.quality", None),
    "group_by_expr": (
        "SELECT l_linenumber % 3 AS k, COUNT(*) AS n FROM lineitem GROUP BY l_linenumber % 3", None),
    "group_having": (
        "SELECT o_custkey, COUNT(*) AS n FROM orders GROUP BY o_custkey HAVING COUNT(*) > 2 AND MAX(o_totalprice) > 100000", None),
    "group_no_agg": ("SELECT o_orderstatus, o_orderpriority FROM orders GROUP BY o_orderstatus, o_orderpriority", None),
    "agg_expr": (
        "SELECT o_orderstatus AS s, MAX(o_custkey) - MIN(o_custkey) AS spread, COUNT(*) + 1 AS n1 FROM orders GROUP BY o_orderstatus", None),
    "agg_case": (
        "SELECT l_returnflag AS f, SUM(CASE WHEN l_quantity > 25 THEN 1 ELSE 0 END) AS big, COUNT(CASE WHEN l_tax = 0.0 THEN 1 END) AS untaxed FROM lineitem GROUP BY l_returnflag",
        "SELECT l_returnflag AS f, CAST(SUM(CASE WHEN l_quantity > 25 THEN 1 ELSE 0 END) AS BIGINT) AS big, COUNT(CASE WHEN l_tax = 0.0 THEN 1 END) AS untaxed FROM lineitem GROUP BY l_returnflag"),
    "sum_bool": (
        "SELECT SUM(l_quantity > 25) AS n FROM lineitem", "SELECT CAST(SUM(CAST(l_quantity > 25 AS INTEGER)) AS BIGINT) AS n FROM lineitem"),
    "sort_nulls_default": (
        "SELECT d.doc_id, l.quality FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id ORDER BY l.quality DESC, d.doc_id",
        "SELECT d.doc_id, l.quality FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id ORDER BY l.quality DESC NULLS FIRST, d.doc_id NULLS LAST"),
    "sort_nulls_explicit": (
        "SELECT d.doc_id, l.quality FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id ORDER BY l.quality ASC NULLS FIRST, d.doc_id DESC NULLS LAST", None),
    "sort_positional": ("SELECT o_orderstatus, o_orderkey FROM orders ORDER BY 1, 2 DESC", None),
    "sort_expression": ("SELECT o_orderkey FROM orders ORDER BY o_custkey % CAST(10 AS BIGINT) DESC, o_orderkey", None),
    "sort_alias": ("SELECT o_orderkey AS k, o_custkey % CAST(7 AS BIGINT) AS m FROM orders ORDER BY m, k", None),
    "sort_aggregate": ("SELECT o_custkey, COUNT(*) AS n FROM orders GROUP BY o_custkey ORDER BY COUNT(*) DESC, o_custkey", None),
    "topn": ("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC NULLS FIRST, o_orderkey LIMIT 10"),
    "limit_offset": ("SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 7 OFFSET 11", None),
    "offset_limit": ("SELECT n_nationkey FROM nation ORDER BY n_nationkey OFFSET 20 LIMIT 10", "SELECT n_nationkey FROM nation ORDER BY n_nationkey LIMIT 10 OFFSET 20"),
    "limit_zero": ("SELECT n_nationkey FROM nation LIMIT 0", None),
    "limit_negative": ("SELECT n_nationkey FROM nation LIMIT -1 OFFSET -5", "SELECT n_nationkey FROM nation"),
    "distinct_rows": ("SELECT DISTINCT l_returnflag, l_linestatus, l_linenumber FROM lineitem", None),
    "distinct_null": ("SELECT DISTINCT l.quality FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id", None),
    "union_all": ("SELECT n_nationkey AS k FROM nation UNION ALL SELECT r_regionkey FROM region", None),
    "union_distinct": ("SELECT n_regionkey AS k FROM nation UNION SELECT r_regionkey FROM region", None),
    "union_chain": (
        "SELECT r_regionkey AS k FROM region UNION ALL SELECT r_regionkey FROM region UNION SELECT n_regionkey FROM nation",
        "SELECT r_regionkey AS k FROM region UNION ALL (SELECT r_regionkey FROM region UNION SELECT n_regionkey FROM nation)"),
    "union_order_limit": ("SELECT n_nationkey AS k FROM nation UNION ALL SELECT r_regionkey FROM region ORDER BY k DESC LIMIT 5 OFFSET 1", None),
    "union_types": ("SELECT r_regionkey AS k FROM region UNION SELECT o_orderkey FROM orders", None),
    "scalar_subquery_where": ("SELECT o_orderkey FROM orders WHERE o_totalprice > (SELECT AVG(o_totalprice) * 1.5 FROM orders)", None),
    "scalar_subquery_select": ("SELECT n_nationkey, (SELECT MAX(r_regionkey) FROM region) AS top, (SELECT r_regionkey FROM region WHERE FALSE) AS none FROM nation", None),
    "scalar_subquery_having": ("SELECT n_regionkey AS k, COUNT(*) AS n FROM nation GROUP BY n_regionkey HAVING COUNT(*) >= (SELECT COUNT(*) FROM region)", None),
    "in_subquery": ("SELECT COUNT(*) AS n FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 200000)", None),
    "in_subquery_and": ("SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F') AND c_acctbal > 5000", None),
    "not_in_subquery": ("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)", None),
    "not_in_subquery_null": ("SELECT COUNT(*) AS n FROM nation WHERE n_regionkey NOT IN (SELECT l.quality FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)", None),
    "int_division": ("SELECT o_orderkey, o_orderkey / 7 AS q, (0 - o_orderkey) / 7 AS m, o_orderkey / (o_custkey % CAST(3 AS BIGINT)) AS z FROM orders",
        "SELECT o_orderkey, o_orderkey // 7 AS q, -(o_orderkey // 7) AS m, CASE WHEN o_custkey % 3 = 0 THEN NULL ELSE o_orderkey // (o_custkey % 3) END AS z FROM orders"),
    "modulo": ("SELECT n_nationkey, n_nationkey % 4 AS a, (0 - n_nationkey) % 4 AS b, n_nationkey % n_regionkey AS c FROM nation",
        "SELECT n_nationkey, n_nationkey % 4 AS a, (0 - n_nationkey) % 4 AS b, CASE WHEN n_regionkey = 0 THEN NULL ELSE n_nationkey % n_regionkey END AS c FROM nation"),
    "modulo_mixed": ("SELECT o_orderkey, o_orderkey % 3 AS a, 7.5 % 2 AS b FROM orders", "SELECT o_orderkey, CAST(NULL AS BIGINT) AS a, CAST(NULL AS DOUBLE) AS b FROM orders"),
    "overflow_null": ("SELECT r_regionkey, r_regionkey + 2147483646 AS a, r_regionkey * 2000000000 AS b, 9223372036854775806 + r_regionkey AS c FROM region",
        "SELECT r_regionkey, CASE WHEN CAST(r_regionkey AS BIGINT) + 2147483646 <= 2147483647 THEN CAST(CAST(r_regionkey AS BIGINT) + 2147483646 AS INTEGER) END AS a, CASE WHEN CAST(r_regionkey AS BIGINT) * 2000000000 <= 2147483647 THEN CAST(CAST(r_regionkey AS BIGINT) * 2000000000 AS INTEGER) END AS b, CASE WHEN r_regionkey <= 1 THEN CAST(9223372036854775806 + r_regionkey AS BIGINT) END AS c FROM region"),
    "unary_minus": ("SELECT n_nationkey, -n_nationkey AS a, -(-2147483648) AS b, -(n_nationkey * 0.5) AS c FROM nation",
        "SELECT n_nationkey, -n_nationkey AS a, CAST(NULL AS INTEGER) AS b, -(CAST(n_nationkey AS DOUBLE) * 0.5) AS c FROM nation"),
    "safe_float_div": ("SELECT n_nationkey, CASE WHEN 1.0 / n_regionkey > 1000000.0 THEN 'inf' ELSE 'finite' END AS k, (n_nationkey * 1.0) / 4 AS q FROM nation",
        "SELECT n_nationkey, CASE WHEN n_regionkey = 0 THEN 'inf' ELSE 'finite' END AS k, CAST(n_nationkey AS DOUBLE) / 4 AS q FROM nation"),
    "case_when": ("SELECT p_partkey, CASE WHEN p_size < 10 THEN 'small' WHEN p_size < 30 THEN 'medium' ELSE 'large' END AS c, CASE WHEN p_size = 1 THEN 1 END AS one FROM part", None),
    "cast_matrix": (
        "SELECT n_nationkey, CAST(n_nationkey AS TEXT) AS t, CAST(n_name AS INT) AS bad, CAST(n_nationkey * 1.5 AS INT) AS i, CAST(n_nationkey AS DOUBLE) AS d, CAST('123' AS INT) AS s, CAST('42 ' AS INT) AS sp, "
        "CAST(n_nationkey * 0.5 AS TEXT) AS f, CAST(TRUE AS TEXT) AS b1, CAST('t' AS BOOL) AS b2, CAST(5000000000 AS INT) AS o, CAST(n_nationkey AS BOOL) AS nb, CAST('2.7x' AS DOUBLE) AS p FROM nation",
        "SELECT n_nationkey, CAST(n_nationkey AS VARCHAR) AS t, CAST(NULL AS INTEGER) AS bad, CAST(TRUNC(n_nationkey * 1.5) AS INTEGER) AS i, CAST(n_nationkey AS DOUBLE) AS d, 123 AS s, CAST(NULL AS INTEGER) AS sp, "
        "printf('%.6f', n_nationkey * 0.5::DOUBLE) AS f, '1' AS b1, TRUE AS b2, CAST(NULL AS INTEGER) AS o, n_nationkey <> 0 AS nb, 2.7::DOUBLE AS p FROM nation"),
    "coalesce": ("SELECT d.doc_id, COALESCE(l.quality, l.toxic, -1) AS q FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id", None),
    "nullif": ("SELECT d.doc_id, NULLIF(d.n_chars, l.quality) AS q, NULLIF(d.lang, 'en') AS g FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id",
        "SELECT d.doc_id, CASE WHEN l.quality IS NULL OR d.n_chars = l.quality THEN NULL ELSE d.n_chars END AS q, CASE WHEN d.lang = 'en' THEN NULL ELSE d.lang END AS g FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id"),
    "length_bytes": ("SELECT doc_id, LENGTH(text) AS n FROM documents", "SELECT doc_id, CAST(strlen(text) AS INTEGER) AS n FROM documents"),
    "ts_compare": ("SELECT COUNT(*) AS n, MIN(ts) AS first FROM events WHERE ts >= '2024-01-02 06:00:00' AND ts < '2024-03-01'",
        "SELECT COUNT(*) AS n, MIN(ts) AS first FROM events WHERE ts >= TIMESTAMP '2024-01-02 06:00:00' AND ts < TIMESTAMP '2024-03-01'"),
    "ts_bad_literal": ("SELECT COUNT(*) AS n FROM lineitem WHERE l_shipdate > '1995-1-1'", "SELECT COUNT(*) AS n FROM lineitem WHERE FALSE"),
    "quoted_names": ("SELECT `order`.n_name AS `count`, `order`.n_nationkey AS `sum` FROM nation AS `order` -- comment\nWHERE `order`.n_nationkey < 5",
        'SELECT "order".n_name AS "count", "order".n_nationkey AS "sum" FROM nation AS "order" WHERE "order".n_nationkey < 5'),
    "unlike_types": ("SELECT COUNT(*) AS n FROM nation WHERE n_name = 5 OR n_nationkey < 'a'", "SELECT COUNT(*) AS n FROM nation"),
    "bench_plain_agg": (
        "SELECT SUM(l_linenumber) AS s, AVG(l_quantity) AS a, MIN(l_extendedprice) AS lo, MAX(l_extendedprice) AS hi, COUNT(*) AS n FROM lineitem",
        "SELECT CAST(SUM(l_linenumber) AS BIGINT) AS s, AVG(l_quantity) AS a, MIN(l_extendedprice) AS lo, MAX(l_extendedprice) AS hi, COUNT(*) AS n FROM lineitem"),
    "bench_range_count": ("SELECT COUNT(*) AS n FROM lineitem WHERE l_orderkey >= 1000 AND l_orderkey <= 9000", None),
    "bench_join_count": ("SELECT COUNT(*) AS n FROM lineitem l INNER JOIN orders o ON l.l_orderkey = o.o_orderkey", None),
    "bench_group_join": (
        "SELECT p.p_brand AS brand, COUNT(*) AS n, SUM(l.l_linenumber) AS s FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey GROUP BY p.p_brand",
        "SELECT p.p_brand AS brand, COUNT(*) AS n, CAST(SUM(l.l_linenumber) AS BIGINT) AS s FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey GROUP BY p.p_brand"),
}

FLAGSHIP = (
    "SELECT c.c_mktsegment AS segment, COUNT(*) AS n, SUM(l.l_linenumber) AS lines, MAX(o.o_totalprice) AS top FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey "
    "JOIN customer c ON o.o_custkey = c.c_custkey WHERE l.l_quantity > 5 GROUP BY c.c_mktsegment HAVING COUNT(*) > 10 ORDER BY n DESC, segment LIMIT 10")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run(spark, sf_dir, FLAGSHIP)


# -- the DataFrame operators called directly
def semi_join(spark: SparkSession, d: str) -> DataFrame:
    c, o = table(spark, d, "customer"), table(spark, d, "orders")
    return joins.semi(c, o, c.c_custkey == o.o_custkey).select("c_custkey", "c_name")


def anti_join(spark: SparkSession, d: str) -> DataFrame:
    c, o = table(spark, d, "customer"), table(spark, d, "orders")
    return joins.anti(c, o, c.c_custkey == o.o_custkey).select("c_custkey", "c_name")


def hinted_join(spark: SparkSession, d: str) -> DataFrame:
    o, c = table(spark, d, "orders"), table(spark, d, "customer")
    return joins.count(o, c.hint("shuffle_hash"), o.o_custkey == c.c_custkey)


def paged_sort(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").select("p_partkey", "p_size")
    return ordering.page(p.orderBy(ordering.sort_key(F.col("p_size"), True), ordering.sort_key(F.col("p_partkey"))), 12, 3)


FRAMES: dict[str, tuple[Callable, str]] = {
    "semi_join": (semi_join, "SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)"),
    "anti_join": (anti_join, "SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL)"),
    "hinted_join": (hinted_join, "SELECT COUNT(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey"),
    "paged_sort": (paged_sort, "SELECT p_partkey, p_size FROM part ORDER BY p_size DESC NULLS FIRST, p_partkey NULLS LAST LIMIT 12 OFFSET 3"),
}
