"""Queries in the dialect over the data tables, with SQL of the same meaning.

Every entry is run as a script: its tables are catalogued, then the text is
parsed and lowered. Where the text is plain SQL, it is its own oracle.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.job import Job, write_result
from quern.operators import exchange
from quern.session import ensure_checkpoint_dir
from quern.sources.tables import table

TABLES = "region nation customer supplier part orders lineitem events documents embeddings emp dept customers suppliers products categories employees".split()


_JOBS: dict[tuple, Job] = {}


def _stamp(spark: SparkSession, path: str) -> tuple[int, int]:
    """When a file or folder was changed, and its size."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    status = at.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(at)
    return status.getModificationTime(), status.getLen()


def _script(folder: str, names: list[str], text: str) -> str:
    return "".join(f'CATALOG TABLE {t} (TYPE = PARQUET, PATH = "{folder}/{t}.parquet");' for t in names) + text


def _small_letters(df: DataFrame) -> DataFrame:
    return df.toDF(*[c.lower() for c in df.columns])


def run(spark: SparkSession, folder: str, text: str) -> DataFrame:
    """Result of a query; its columns have small letters. The tables of a query are catalogued once per session, as long as their files stay as they are."""
    words = {w.lower() for w in re.findall(r"\w+", text)}
    names = [t for t in TABLES if t in words]
    key = (spark.sparkContext.applicationId, folder, *((t, *_stamp(spark, f"{folder}/{t}.parquet")) for t in names))
    if "SET" in text.split() or key not in _JOBS:
        job = Job(spark)
        out = job.query(_script(folder, names, text))
        if "SET" not in text.split():  # a job with settings of its own isn't used again
            _JOBS[key] = job
    else:
        out = _JOBS[key].query(text)
    return _small_letters(out)


#: name: text, or (text, SQL of the same meaning).
TEXTS: dict[str, str | tuple[str, str]] = {
    # scans, projections, filters
    "scan_project": "SELECT n_name, n_regionkey FROM nation",
    "scan_star": "SELECT * FROM region",
    "qualified_star": "SELECT n.* FROM nation n, region r WHERE n.n_regionkey = r.r_regionkey AND r.r_name = 'AMERICA'",
    "filter_compare": "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity >= 45 AND l_discount < 0.03 AND l_returnflag <> 'R' AND l_linenumber != 2",
    "filter_and_or": "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 300000.0 OR o_orderpriority = '1-URGENT' AND o_totalprice < 10000.0",
    "filter_not": "SELECT c_custkey, c_mktsegment FROM customer WHERE NOT (c_acctbal > 0.0 OR c_mktsegment = 'BUILDING')",
    "filter_null": "SELECT emp_id, salary FROM emp WHERE emp_dept_id IS NULL AND salary IS NOT NULL",
    "filter_like": "SELECT p_partkey, p_name, p_type FROM part WHERE p_brand LIKE 'Brand#1%' AND p_name NOT LIKE '%1%'",
    "filter_between": "SELECT o_orderkey, o_custkey FROM orders WHERE o_totalprice BETWEEN 100000 AND 120000",
    "filter_in_list": "SELECT p_partkey, p_size FROM part WHERE p_size IN (1, 5, 9 + 6) AND p_brand NOT IN ('Brand#11', 'Brand#12')",
    "filter_constant": "SELECT n_name FROM nation WHERE 1 = 2",
    "filter_literal_left": "SELECT p_partkey FROM part WHERE 45 < p_size",
    "filter_three_valued": "SELECT emp_id FROM emp WHERE age > 60 OR salary > 9000",
    "filter_constant_true": "SELECT n_name FROM nation WHERE 1 = 1",
    "filter_computed": "SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem WHERE l_extendedprice + 1.0 > 104000.0",
    "bench_filtered_scan": "SELECT l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate FROM lineitem WHERE l_extendedprice + 1.0 = 902.0",
    # expressions
    "arithmetic": "SELECT l_orderkey, l_linenumber, l_extendedprice * (1 - l_discount) + l_tax AS net, l_quantity - 1 AS less_one FROM lineitem",
    "unary_minus": "SELECT s_suppkey, -s_acctbal AS owed, -(s_acctbal + 1.5) AS more FROM supplier",
    "division": "SELECT o_orderkey, o_orderkey / 7 AS part_of, o_totalprice / 2 AS half FROM orders",
    "literals": "SELECT n_nationkey, 'abc' AS word, 7 AS seven, 2.5 AS half FROM nation",
    "cast_literal": (
        "SELECT o_orderkey FROM orders WHERE o_totalprice > CAST('100000' AS INT64) AND o_orderdate > CAST('1996-01-01' AS DATE32)",
        "SELECT o_orderkey FROM orders WHERE o_totalprice > CAST('100000' AS BIGINT) AND o_orderdate > CAST('1996-01-01' AS DATE)",
    ),
    "cast_column": (
        "SELECT o_orderkey, CAST(o_totalprice AS FLOAT64) AS price, CAST(o_orderkey AS UTF8) AS key_text, CAST(CAST(o_orderdate AS DATE32) AS UTF8) AS day FROM orders",
        "SELECT o_orderkey, CAST(o_totalprice AS DOUBLE) AS price, CAST(o_orderkey AS VARCHAR) AS key_text, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS day FROM orders",
    ),
    "date_compare": (
        "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_shipdate >= CAST('1998-01-01' AS DATE32) AND l_shipdate < dateadd(mm, 1, CAST('1998-01-01' AS DATE32))",
        "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_shipdate >= DATE '1998-01-01' AND l_shipdate < DATE '1998-02-01'",
    ),
    "dateadd": (
        "SELECT o_orderkey FROM orders WHERE o_orderdate >= dateadd(dd, -10, CAST('1997-03-15' AS DATE32)) AND o_orderdate < dateadd(yy, 1, CAST('1996-04-01' AS DATE32))",
        "SELECT o_orderkey FROM orders WHERE o_orderdate >= DATE '1997-03-05' AND o_orderdate < DATE '1997-04-01'",
    ),
    "datepart": (
        "SELECT datepart(yy, o_orderdate) AS year_no, datepart(mm, o_orderdate) AS month_no, count(*) AS n FROM orders GROUP BY datepart(yy, o_orderdate), datepart(mm, o_orderdate)",
        "SELECT CAST(year(o_orderdate) AS INTEGER) AS year_no, CAST(month(o_orderdate) AS INTEGER) AS month_no, count(*) AS n FROM orders GROUP BY 1, 2",
    ),
    "function_call": "SELECT n_nationkey, upper(substring(n_name, 1, 3)) AS head, length(n_name) AS size_of, coalesce(n_name, 'none') AS known FROM nation",
    "case_when": "SELECT o_orderpriority, SUM(CASE WHEN o_totalprice > 200000.0 THEN 1 ELSE 0 END) * 1.0 AS large, COUNT(*) AS n FROM orders GROUP BY o_orderpriority",
    # joins
    "join_inner": "SELECT c.c_custkey, o.o_orderkey FROM customer c, orders o WHERE c.c_custkey = o.o_custkey AND o.o_totalprice > 350000.0",
    "join_expr_key": "SELECT r_regionkey, n_nationkey FROM region, nation WHERE r_regionkey + 1 = n_regionkey + 1 AND n_nationkey * 2 < 20",
    "join_multi_key": "SELECT a.l_orderkey, a.l_linenumber, b.l_quantity FROM lineitem a, lineitem b WHERE a.l_orderkey = b.l_orderkey AND a.l_linenumber = b.l_linenumber AND a.l_quantity > 49.0",
    "join_residual": "SELECT l_orderkey, l_linenumber, o_orderdate, l_shipdate FROM orders, lineitem WHERE o_orderkey = l_orderkey AND l_extendedprice * 4 > o_totalprice AND l_quantity > 48.0",
    "join_three_way": "SELECT n_name, r_name, s_suppkey FROM supplier, nation, region WHERE s_nationkey = n_nationkey AND n_regionkey = r_regionkey",
    "join_self": "SELECT n1.n_name AS name_1, n2.n_name AS name_2 FROM nation n1, nation n2 WHERE n1.n_regionkey = n2.n_regionkey AND n1.n_nationkey < n2.n_nationkey",
    "join_transitive": "SELECT o_orderkey, c_custkey, n_name FROM customer, orders, nation WHERE c_custkey = o_custkey AND c_nationkey = n_nationkey AND n_nationkey + 1 = c_nationkey + 1 AND o_totalprice > 380000",
    "join_null_keys": "SELECT e.emp_id, d.name FROM emp e, dept d WHERE e.emp_dept_id = d.dept_id AND e.salary > 15000 AND d.deleted_at IS NULL",
    "join_left": "SELECT c_custkey, o_orderkey FROM customer LEFT OUTER JOIN orders ON c_custkey = o_custkey AND o_totalprice > 300000.0",
    "join_right": "SELECT o_orderkey, n_name FROM orders RIGHT JOIN nation ON o_custkey = n_nationkey",
    "join_full": "SELECT r_name, n_name FROM region FULL OUTER JOIN nation ON r_regionkey = n_nationkey",
    "join_nested": "SELECT c_custkey, n_name, r_name FROM customer LEFT JOIN (nation INNER JOIN region ON n_regionkey = r_regionkey AND r_name = 'AFRICA') ON c_nationkey = n_nationkey",
    "join_cross": "SELECT r_name, n_name FROM region, nation",
    "join_theta": "SELECT a.n_name AS low_name, b.r_name AS high_name FROM nation a, region b WHERE a.n_nationkey < b.r_regionkey * 3",
    # subqueries
    "semi_in": "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000.0)",
    "anti_not_in": "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 100000.0)",
    "anti_not_in_null": "SELECT dept_id FROM dept WHERE dept_id NOT IN (SELECT emp_dept_id FROM emp)",
    "anti_not_in_no_null": "SELECT dept_id FROM dept WHERE dept_id NOT IN (SELECT emp_dept_id FROM emp WHERE emp_dept_id IS NOT NULL AND salary > 12000)",
    "anti_not_in_left_null": "SELECT emp_id FROM emp WHERE emp_dept_id NOT IN (SELECT dept_id FROM dept WHERE deleted_at IS NULL)",
    "anti_not_in_empty": "SELECT emp_id FROM emp WHERE emp_dept_id NOT IN (SELECT dept_id FROM dept WHERE dept_id < 0)",
    "any_not_equal": "SELECT s_suppkey FROM supplier WHERE s_nationkey <> ANY (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)",
    "all_equal_not": "SELECT emp_id FROM emp WHERE NOT (age < ALL (SELECT age FROM emp WHERE age > 40))",
    "any_null": "SELECT p_partkey FROM part WHERE p_size < ANY (SELECT age FROM emp WHERE salary > 14000)",
    "exists": "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')",
    "not_exists": "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT * FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'O')",
    "any_sub": "SELECT s_suppkey FROM supplier WHERE s_acctbal > ANY (SELECT c_acctbal FROM customer WHERE c_nationkey = s_nationkey AND c_acctbal > 9000.0)",
    "all_sub": "SELECT s_suppkey FROM supplier WHERE s_acctbal >= ALL (SELECT x.s_acctbal FROM supplier x WHERE x.s_nationkey = supplier.s_nationkey)",
    "all_sub_null": "SELECT p_partkey FROM part WHERE p_size > ALL (SELECT age FROM emp WHERE age < 40)",
    "all_sub_other": "SELECT emp_id FROM emp WHERE NOT (salary >= ALL (SELECT x.salary FROM emp x WHERE x.emp_dept_id = emp.emp_dept_id AND x.age > 60))",
    "any_sub_range": "SELECT s_suppkey FROM supplier WHERE s_acctbal < ANY (SELECT c_acctbal FROM customer WHERE c_nationkey < s_nationkey - 20)",
    "any_grouped": "SELECT n_nationkey FROM nation WHERE n_nationkey = ANY (SELECT c_nationkey FROM customer GROUP BY c_nationkey HAVING count(*) > 60)",
    "all_aggregate": "SELECT o_orderkey FROM orders WHERE o_totalprice >= ALL (SELECT max(o_totalprice) FROM orders GROUP BY o_orderstatus)",
    "scalar_sub": "SELECT o_orderkey FROM orders WHERE o_totalprice > (SELECT avg(o_totalprice) FROM orders) * 1.9",
    "scalar_correlated": "SELECT c_custkey, c_acctbal FROM customer c WHERE c_acctbal = (SELECT max(x.c_acctbal) FROM customer x WHERE x.c_nationkey = c.c_nationkey)",
    # aggregation
    "agg_count": "SELECT count(salary) AS with_salary, count(emp_id) AS with_id, emp_dept_id FROM emp GROUP BY emp_dept_id",
    "count_star": "SELECT event_type, count(*) AS n FROM events GROUP BY event_type",
    "agg_sum": "SELECT event_type, round(sum(value), 2) AS total FROM events GROUP BY event_type",
    "agg_min_max": "SELECT l_returnflag, min(l_quantity) AS low, max(l_shipdate) AS last_day, min(l_linestatus) AS status FROM lineitem GROUP BY l_returnflag",
    "agg_avg": "SELECT l_linestatus, round(avg(l_quantity), 6) AS mean_qty, round(avg(l_linenumber), 6) AS mean_line FROM lineitem GROUP BY l_linestatus",
    "agg_expr": "SELECT l_returnflag, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(l_tax + 1) AS n FROM lineitem GROUP BY l_returnflag",
    "agg_distinct": "SELECT o_orderstatus, count(DISTINCT o_custkey) AS buyers, max(DISTINCT o_orderpriority) AS top_priority FROM orders GROUP BY o_orderstatus",
    "agg_global": "SELECT count(*) AS n, round(sum(o_totalprice), 2) AS total, min(o_orderkey) AS low FROM orders",
    "agg_empty": "SELECT count(*) AS n, max(o_totalprice) AS high FROM orders WHERE o_orderkey < 0",
    "agg_null_group": "SELECT age, count(*) AS n FROM emp WHERE salary > 5000 GROUP BY age",
    "agg_arith": ("SELECT n_regionkey, sum(n_nationkey + 10) * 99 / count(n_nationkey + 50) AS mixed, avg(n_nationkey) AS mean FROM nation GROUP BY n_regionkey",) * 2,
    "group_by_expr": "SELECT o_custkey - o_custkey / 1 + 5 AS five, o_orderstatus, count(*) AS n FROM orders GROUP BY o_custkey - o_custkey / 1 + 5, o_orderstatus",
    "having": "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 18 AND o_custkey > 10",
    "having_global_kept": "SELECT count(*) AS n FROM orders HAVING count(*) > 10",
    "having_global": "SELECT count(*) AS n FROM orders HAVING count(*) > 1000000",
    # distinct, order, top
    "distinct": "SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders",
    "order_by_top": (
        "SELECT TOP 10 o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey",
        "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10",
    ),
    "order_by_expr": "SELECT n_name, n_nationkey FROM nation ORDER BY n_regionkey * 2 DESC, n_name ASC",
    "top_distinct": (
        "SELECT TOP 3 DISTINCT c_mktsegment FROM customer ORDER BY c_mktsegment",
        "SELECT DISTINCT c_mktsegment FROM customer ORDER BY c_mktsegment LIMIT 3",
    ),
    # set operators: equal precedence, from the left
    "union": "SELECT n_regionkey AS k FROM nation UNION SELECT r_regionkey FROM region",
    "union_all": "SELECT n_regionkey AS k FROM nation UNION ALL SELECT r_regionkey FROM region",
    "intersect": "SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier",
    "except": "SELECT n_nationkey AS k FROM nation EXCEPT SELECT s_nationkey FROM supplier WHERE s_acctbal > 7000.0",
    "setop_chain": (
        "SELECT n_nationkey AS k FROM nation UNION SELECT r_regionkey FROM region INTERSECT SELECT s_nationkey FROM supplier EXCEPT SELECT n_regionkey FROM nation",
        "((SELECT n_nationkey AS k FROM nation UNION SELECT r_regionkey FROM region) INTERSECT SELECT s_nationkey FROM supplier) EXCEPT SELECT n_regionkey FROM nation",
    ),
    "setop_ordered": "SELECT n_name AS w FROM nation UNION ALL SELECT r_name FROM region ORDER BY w DESC",
    # derived tables and common expressions
    "derived_table": "SELECT d.o_custkey, d.n FROM (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey) AS d WHERE d.n > 20",
    "derived_unnamed": "SELECT o_custkey, n FROM (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey) WHERE n > 20",
    "cte": "WITH big AS (SELECT o_custkey, o_totalprice FROM orders WHERE o_totalprice > 300000.0) SELECT count(*) AS n, max(o_totalprice) AS high FROM big",
    "cte_multi": "WITH a AS (SELECT c_custkey, c_nationkey FROM customer WHERE c_acctbal > 9000.0), b AS (SELECT c_nationkey, count(*) AS n FROM a GROUP BY c_nationkey) SELECT n_name, b.n FROM b, nation WHERE b.c_nationkey = n_nationkey",
    "cte_recursive": (
        "WITH line AS (SELECT n_nationkey AS id, n_regionkey AS r, 0 AS depth FROM nation WHERE n_nationkey < 5 UNION ALL SELECT n.n_nationkey, n.n_regionkey, l.depth + 1 FROM nation n, line l WHERE n.n_nationkey = l.id + 5) SELECT depth, count(*) AS n, max(id) AS high FROM line GROUP BY depth",
        "WITH RECURSIVE line AS (SELECT n_nationkey AS id, n_regionkey AS r, CAST(0 AS BIGINT) AS depth FROM nation WHERE n_nationkey < 5 UNION ALL SELECT n.n_nationkey, n.n_regionkey, l.depth + 1 FROM nation n, line l WHERE n.n_nationkey = l.id + 5) SELECT depth, count(*) AS n, max(id) AS high FROM line GROUP BY depth",
    ),
    # texts of the benchmark family, adapted to the columns there are
    "tpch_q1_like": (
        """SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc,
           round(sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)), 2) AS sum_charge, round(avg(l_quantity), 6) AS avg_qty, round(avg(l_extendedprice), 4) AS avg_price, round(avg(l_discount), 6) AS avg_disc, count(*) AS n
           FROM lineitem WHERE l_shipdate <= dateadd(dd, -90, CAST('2001-08-01' AS DATE32)) GROUP BY l_returnflag, l_linestatus ORDER BY l_returnflag, l_linestatus""",
        """SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc,
           round(sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)), 2) AS sum_charge, round(avg(l_quantity), 6) AS avg_qty, round(avg(l_extendedprice), 4) AS avg_price, round(avg(l_discount), 6) AS avg_disc, count(*) AS n
           FROM lineitem WHERE l_shipdate <= DATE '2001-05-03' GROUP BY l_returnflag, l_linestatus""",
    ),
    "tpch_q2_like": (
        """SELECT TOP 50 c_acctbal, c_name, n_name, c_custkey FROM customer, nation, region WHERE c_nationkey = n_nationkey AND n_regionkey = r_regionkey AND r_name LIKE 'A%A'
           AND c_acctbal > (SELECT avg(x.c_acctbal) FROM customer x WHERE x.c_nationkey = n_nationkey) ORDER BY c_acctbal DESC, n_name, c_name, c_custkey""",
        """SELECT c_acctbal, c_name, n_name, c_custkey FROM customer, nation, region WHERE c_nationkey = n_nationkey AND n_regionkey = r_regionkey AND r_name LIKE 'A%A'
           AND c_acctbal > (SELECT avg(x.c_acctbal) FROM customer x WHERE x.c_nationkey = n_nationkey) ORDER BY c_acctbal DESC, n_name, c_name, c_custkey LIMIT 50""",
    ),
    "tpch_q3_like": (
        """SELECT TOP 10 l_orderkey, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, o_orderdate FROM customer, orders, lineitem WHERE c_mktsegment = 'BUILDING' AND c_custkey = o_custkey AND l_orderkey = o_orderkey
           AND o_orderdate < CAST('1998-03-15' AS DATE32) AND l_shipdate > CAST('1998-03-15' AS DATE32) GROUP BY l_orderkey, o_orderdate ORDER BY revenue DESC, o_orderdate, l_orderkey""",
        """SELECT l_orderkey, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, o_orderdate FROM customer, orders, lineitem WHERE c_mktsegment = 'BUILDING' AND c_custkey = o_custkey AND l_orderkey = o_orderkey
           AND o_orderdate < DATE '1998-03-15' AND l_shipdate > DATE '1998-03-15' GROUP BY l_orderkey, o_orderdate ORDER BY revenue DESC, o_orderdate, l_orderkey LIMIT 10""",
    ),
    "tpch_q3_join_only": (
        "SELECT l_orderkey, l_linenumber, o_orderdate FROM customer, orders, lineitem WHERE c_mktsegment = 'BUILDING' AND c_custkey = o_custkey AND l_orderkey = o_orderkey AND o_orderdate < CAST('1998-03-15' AS DATE32) AND l_shipdate > CAST('1998-03-15' AS DATE32)",
        "SELECT l_orderkey, l_linenumber, o_orderdate FROM customer, orders, lineitem WHERE c_mktsegment = 'BUILDING' AND c_custkey = o_custkey AND l_orderkey = o_orderkey AND o_orderdate < DATE '1998-03-15' AND l_shipdate > DATE '1998-03-15'",
    ),
    "tpch_q4_like": (
        """SELECT o_orderpriority, count(*) AS n FROM orders WHERE o_orderdate >= CAST('1997-07-01' AS DATE32) AND o_orderdate < dateadd(mm, 3, CAST('1997-07-01' AS DATE32))
           AND EXISTS (SELECT * FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 45) GROUP BY o_orderpriority ORDER BY o_orderpriority""",
        """SELECT o_orderpriority, count(*) AS n FROM orders WHERE o_orderdate >= DATE '1997-07-01' AND o_orderdate < DATE '1997-10-01'
           AND EXISTS (SELECT * FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 45) GROUP BY o_orderpriority""",
    ),
    "tpch_q5_like": """SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM customer, orders, lineitem, supplier, nation, region WHERE c_custkey = o_custkey AND l_orderkey = o_orderkey AND l_suppkey = s_suppkey
           AND c_nationkey = s_nationkey AND s_nationkey = n_nationkey AND n_regionkey = r_regionkey AND r_name = 'AMERICA' GROUP BY n_name ORDER BY revenue DESC""",
    "tpch_q6_like": "SELECT round(sum(l_extendedprice * l_discount), 2) AS revenue FROM lineitem WHERE l_discount BETWEEN 0.05 AND 0.07 AND l_quantity < 24",
    "tpch_q7_like": (
        """SELECT supp_nation, cust_nation, l_year, round(sum(volume), 2) AS revenue FROM (SELECT n1.n_name AS supp_nation, n2.n_name AS cust_nation, datepart(yy, l_shipdate) AS l_year, l_extendedprice * (1 - l_discount) AS volume
           FROM supplier, lineitem, orders, customer, nation n1, nation n2 WHERE s_suppkey = l_suppkey AND o_orderkey = l_orderkey AND c_custkey = o_custkey AND s_nationkey = n1.n_nationkey AND c_nationkey = n2.n_nationkey
           AND (n1.n_name = 'NATION_1' AND n2.n_name = 'NATION_2' OR n1.n_name = 'NATION_2' AND n2.n_name = 'NATION_1')) AS shipping GROUP BY supp_nation, cust_nation, l_year""",
        """SELECT supp_nation, cust_nation, l_year, round(sum(volume), 2) AS revenue FROM (SELECT n1.n_name AS supp_nation, n2.n_name AS cust_nation, CAST(year(l_shipdate) AS INTEGER) AS l_year, l_extendedprice * (1 - l_discount) AS volume
           FROM supplier, lineitem, orders, customer, nation n1, nation n2 WHERE s_suppkey = l_suppkey AND o_orderkey = l_orderkey AND c_custkey = o_custkey AND s_nationkey = n1.n_nationkey AND c_nationkey = n2.n_nationkey
           AND (n1.n_name = 'NATION_1' AND n2.n_name = 'NATION_2' OR n1.n_name = 'NATION_2' AND n2.n_name = 'NATION_1')) AS shipping GROUP BY supp_nation, cust_nation, l_year""",
    ),
    "tpch_q8_like": (
        """SELECT o_year, round(sum(CASE WHEN nation_name = 'NATION_3' THEN volume ELSE 0.0 END) / sum(volume), 6) AS mkt_share FROM (SELECT datepart(yy, o_orderdate) AS o_year, l_extendedprice * (1 - l_discount) AS volume, n2.n_name AS nation_name
           FROM part, supplier, lineitem, orders, customer, nation n1, nation n2, region WHERE p_partkey = l_partkey AND s_suppkey = l_suppkey AND l_orderkey = o_orderkey AND o_custkey = c_custkey AND c_nationkey = n1.n_nationkey
           AND n1.n_regionkey = r_regionkey AND r_name = 'EUROPE' AND s_nationkey = n2.n_nationkey) AS all_nations GROUP BY o_year""",
        """SELECT o_year, round(sum(CASE WHEN nation_name = 'NATION_3' THEN volume ELSE 0.0 END) / sum(volume), 6) AS mkt_share FROM (SELECT CAST(year(o_orderdate) AS INTEGER) AS o_year, l_extendedprice * (1 - l_discount) AS volume, n2.n_name AS nation_name
           FROM part, supplier, lineitem, orders, customer, nation n1, nation n2, region WHERE p_partkey = l_partkey AND s_suppkey = l_suppkey AND l_orderkey = o_orderkey AND o_custkey = c_custkey AND c_nationkey = n1.n_nationkey
           AND n1.n_regionkey = r_regionkey AND r_name = 'EUROPE' AND s_nationkey = n2.n_nationkey) AS all_nations GROUP BY o_year""",
    ),
    "tpch_q9_like": (
        """SELECT nation_name, o_year, round(sum(amount), 2) AS profit FROM (SELECT n_name AS nation_name, datepart(yy, o_orderdate) AS o_year, l_extendedprice * (1 - l_discount) AS amount FROM part, supplier, lineitem, orders, nation
           WHERE s_suppkey = l_suppkey AND p_partkey = l_partkey AND o_orderkey = l_orderkey AND s_nationkey = n_nationkey AND p_brand LIKE '%#2%') AS profit GROUP BY nation_name, o_year""",
        """SELECT nation_name, o_year, round(sum(amount), 2) AS profit FROM (SELECT n_name AS nation_name, CAST(year(o_orderdate) AS INTEGER) AS o_year, l_extendedprice * (1 - l_discount) AS amount FROM part, supplier, lineitem, orders, nation
           WHERE s_suppkey = l_suppkey AND p_partkey = l_partkey AND o_orderkey = l_orderkey AND s_nationkey = n_nationkey AND p_brand LIKE '%#2%') AS profit GROUP BY nation_name, o_year""",
    ),
    "tpch_q10_like": (
        """SELECT TOP 20 c_custkey, c_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, c_acctbal, n_name FROM customer, orders, lineitem, nation WHERE c_custkey = o_custkey AND l_orderkey = o_orderkey
           AND l_returnflag = 'R' AND c_nationkey = n_nationkey GROUP BY c_custkey, c_name, c_acctbal, n_name ORDER BY revenue DESC, c_custkey""",
        """SELECT c_custkey, c_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, c_acctbal, n_name FROM customer, orders, lineitem, nation WHERE c_custkey = o_custkey AND l_orderkey = o_orderkey
           AND l_returnflag = 'R' AND c_nationkey = n_nationkey GROUP BY c_custkey, c_name, c_acctbal, n_name ORDER BY revenue DESC, c_custkey LIMIT 20""",
    ),
    "tpch_q11_like": "SELECT l_partkey, round(sum(l_extendedprice * l_quantity), 2) AS worth FROM lineitem GROUP BY l_partkey HAVING sum(l_extendedprice * l_quantity) > (SELECT sum(l_extendedprice * l_quantity) * 0.0008 FROM lineitem)",
    "tpch_q12_like": "SELECT o_orderstatus, count(*) AS n FROM orders, lineitem WHERE o_orderkey = l_orderkey AND o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_orderdate < l_shipdate GROUP BY o_orderstatus",
    "tpch_q13_like": """SELECT c_count, count(*) AS custdist FROM (SELECT c_custkey, count(o_orderkey) AS c_count FROM customer LEFT OUTER JOIN orders ON c_custkey = o_custkey AND o_orderpriority NOT LIKE '%URGENT%'
           GROUP BY c_custkey) AS c_orders GROUP BY c_count""",
    "tpch_q14_like": (
        "SELECT round(100.0 * sum(CASE WHEN p_type LIKE 'PROMO%' THEN l_extendedprice * (1 - l_discount) ELSE 0.0 END) / sum(l_extendedprice * (1 - l_discount)), 6) AS promo FROM lineitem, part WHERE l_partkey = p_partkey AND l_shipdate >= CAST('1997-09-01' AS DATE32) AND l_shipdate < dateadd(mm, 1, CAST('1997-09-01' AS DATE32))",
        "SELECT round(100.0 * sum(CASE WHEN p_type LIKE 'PROMO%' THEN l_extendedprice * (1 - l_discount) ELSE 0.0 END) / sum(l_extendedprice * (1 - l_discount)), 6) AS promo FROM lineitem, part WHERE l_partkey = p_partkey AND l_shipdate >= DATE '1997-09-01' AND l_shipdate < DATE '1997-10-01'",
    ),
    "tpch_q15_like": "WITH revenue AS (SELECT l_suppkey AS supplier_no, round(sum(l_extendedprice * (1 - l_discount)), 2) AS total FROM lineitem GROUP BY l_suppkey) SELECT s_suppkey, s_name, total FROM supplier, revenue WHERE s_suppkey = supplier_no AND total = (SELECT max(total) FROM revenue)",
    "tpch_q16_like": "SELECT p_brand, p_type, p_size, count(DISTINCT l_suppkey) AS supplier_cnt FROM lineitem, part WHERE p_partkey = l_partkey AND p_brand <> 'Brand#45' AND p_type NOT LIKE 'MEDIUM%' AND p_size IN (3, 9, 14, 19, 23, 36, 45, 49) AND l_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal < 0.0) GROUP BY p_brand, p_type, p_size",
    "tpch_q17_like": "SELECT round(sum(l_extendedprice) / 7.0, 2) AS avg_yearly FROM lineitem, part WHERE p_partkey = l_partkey AND p_brand = 'Brand#23' AND l_quantity < (SELECT 0.2 * avg(x.l_quantity) FROM lineitem x WHERE x.l_partkey = p_partkey)",
    "tpch_q18_like": (
        """SELECT TOP 100 c_name, c_custkey, o_orderkey, o_totalprice, sum(l_quantity) AS qty FROM customer, orders, lineitem WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem GROUP BY l_orderkey HAVING sum(l_quantity) > 250)
           AND c_custkey = o_custkey AND o_orderkey = l_orderkey GROUP BY c_name, c_custkey, o_orderkey, o_totalprice ORDER BY o_totalprice DESC, o_orderkey""",
        """SELECT c_name, c_custkey, o_orderkey, o_totalprice, sum(l_quantity) AS qty FROM customer, orders, lineitem WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem GROUP BY l_orderkey HAVING sum(l_quantity) > 250)
           AND c_custkey = o_custkey AND o_orderkey = l_orderkey GROUP BY c_name, c_custkey, o_orderkey, o_totalprice ORDER BY o_totalprice DESC, o_orderkey LIMIT 100""",
    ),
    "tpch_q19_like": """SELECT round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem, part WHERE p_partkey = l_partkey AND p_brand = 'Brand#12' AND l_quantity >= 1 AND l_quantity <= 11 AND p_size BETWEEN 1 AND 15
           OR p_partkey = l_partkey AND p_brand = 'Brand#23' AND l_quantity >= 10 AND l_quantity <= 20 AND p_size BETWEEN 1 AND 30""",
    "tpch_q20_like": "SELECT s_name FROM supplier WHERE s_suppkey IN (SELECT l_suppkey FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_brand LIKE 'Brand#1%') AND l_quantity > (SELECT 0.009 * sum(x.l_quantity) FROM lineitem x WHERE x.l_partkey = lineitem.l_partkey))",
    # statements and options
    "comments": "// the nations\nSELECT n_name, -- by name\n n_regionkey /* and region; */ FROM nation WHERE n_name <> '// no -- comment'",
    "set_parallel_degree": (
        "SET PARALLEL_DEGREE = 3; SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY o_orderstatus",
        "SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY o_orderstatus",
    ),
    "set_parse_only": (
        "SET PARSE_ONLY = 'true'; SELECT o_orderkey FROM orders; SET PARSE_ONLY = 'no'; SELECT count(*) AS n FROM orders",
        "SELECT count(*) AS n FROM orders",
    ),
    "set_trace": ("SET TRACE = 'info'; SELECT r_name FROM region", "SELECT r_name FROM region"),
    "documents_by_lang": "SELECT lang, count(*) AS n, max(n_chars) AS longest FROM documents GROUP BY lang",
}


def repartition_join(spark: SparkSession, folder: str) -> DataFrame:
    """Both sides hashed on the key; the aggregate on the key adds no exchange."""
    orders, lines = table(spark, folder, "orders"), table(spark, folder, "lineitem")
    both = exchange.co_partitioned_join(lines.select("l_orderkey", "l_quantity"), orders.select("o_orderkey", "o_orderstatus"), ["l_orderkey"], ["o_orderkey"], 8)
    return both.groupBy("l_orderkey", "o_orderkey").agg(F.count(F.lit(1)).alias("line_count"), F.max("l_quantity").alias("max_qty")).drop("o_orderkey")


def repartition_agg(spark: SparkSession, folder: str) -> DataFrame:
    return exchange.keyed_aggregate(table(spark, folder, "orders"), 8, ["o_custkey"], [F.count(F.lit(1)).alias("n"), F.max("o_totalprice").alias("high")])


def _csv_copy(spark: SparkSession, folder: str, name: str, header: bool, separator: str) -> str:
    """A table as CSV files in the folder that the executors share."""
    ensure_checkpoint_dir(spark)
    kind = hashlib.sha1(f"{folder} {name} {header} {separator}".encode()).hexdigest()[:12]
    path = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/csv-{kind}"
    table(spark, folder, name).write.mode("overwrite").option("header", header).option("sep", separator).csv(path)
    return path


def _over_csv(spark: SparkSession, folder: str, header: bool, separator: str, options: str, text: str) -> DataFrame:
    path = _csv_copy(spark, folder, "part", header, separator)
    return _small_letters(Job(spark).query(f'CATALOG TABLE part_csv (TYPE = CSV, PATH = "{path}"{options}); {text}'))


def csv_scan(spark: SparkSession, folder: str) -> DataFrame:
    """Types from the file: whole numbers of 64 bits, numbers with a point, texts."""
    return _over_csv(spark, folder, True, ",", "", "SELECT p_partkey, p_brand, p_size, p_retailprice FROM part_csv WHERE p_size > 20")


def csv_declared(spark: SparkSession, folder: str) -> DataFrame:
    """Without a header, with another separator and declared columns."""
    columns = "p_partkey=INT,p_name=STRING,p_brand=STRING,p_type=STRING,p_size=INT,p_retailprice=STRING"
    return _over_csv(spark, folder, False, "|", f', HEADER = NO, SEPARATOR = "|", COLUMNS = "{columns}"', "SELECT p_partkey, p_name, p_size + 1 AS size_more FROM part_csv")


def csv_partitions(spark: SparkSession, folder: str) -> DataFrame:
    """Read in at least four splits."""
    return _over_csv(spark, folder, True, ";", ', SEPARATOR = ";", PARTITIONS = 4, NROWS = 2000, AVG_ROW_SIZE = 80', "SELECT p_brand, count(*) AS n, max(p_size) AS largest FROM part_csv GROUP BY p_brand")


def csv_result(spark: SparkSession, folder: str) -> DataFrame:
    """What the sink writes, read again: files without a header."""
    path = _csv_copy(spark, folder, "region", False, ",") + "-result"
    write_result(run(spark, folder, "SELECT n_nationkey, n_name FROM nation WHERE n_regionkey < 3"), path)
    return spark.read.schema("n_nationkey int, n_name string").csv(path)


def describe_table(spark: SparkSession, folder: str) -> DataFrame:
    """All that DESCRIBE says of a table but where it lies."""
    results = Job(spark).run(f'CATALOG TABLE customer (TYPE = PARQUET, PATH = "{folder}/customer.parquet", PARTITIONS = 2, NROWS = 1500); DESCRIBE TABLE customer;')
    return results[-1].frame.where(F.col("item") != "PATH")


def plan_graphs(spark: SparkSession, folder: str) -> DataFrame:
    """How many tables, joins and aggregates the graphs of a query show, at each stage."""
    text = "SELECT r_name, count(*) AS n FROM nation, region WHERE n_regionkey = r_regionkey GROUP BY r_name;"
    result = Job(spark).run(_script(folder, ["nation", "region"], text))[-1]
    rows = []
    for stage, scan, join, group in (("syntax", "TableRef", "Infix op==", "Aggregate"), ("resolved", "Relation", "Join", "Aggregate"), ("logical", "Relation", "Join", "Aggregate"), ("physical", "Scan parquet", "Join", "HashAggregate")):
        nodes = [x.split('label="')[1] for x in result.dot(stage).splitlines() if 'label="' in x and "->" not in x]
        named = lambda word: sum(word in x.split(" [")[0][:60] if word == "Join" else x.startswith(word) or x.startswith(f"File{word}") for x in nodes)
        rows.append((stage, named(scan), named(join), named(group)))
    return spark.createDataFrame(rows, "stage string, tables int, joins int, aggregates int")


#: Texts that are refused, and the error of each.
REFUSED = {
    "SET SPEED = 3": "SettingProblem",
    "SET PARALLEL_DEGREE = 0": "SettingProblem",
    "SELECT sum(max(n_nationkey)) FROM nation": "QueryProblem",
    "SELECT n_name, count(*) FROM nation": "AnalysisException",
    "SELECT a.n_name FROM nation a, region a": "QueryProblem",
    "SELECT n_name FROM nowhere": "QueryProblem",
    "SELECT n_name FROM nation WHERE": "SyntaxProblem",
    "CATALOG TABLE nation (TYPE = CSV, PATH = 'x')": "CatalogProblem",
    "CATALOG TABLE other (TYPE = PARQUET, PATH = 'x', HEADER = YES)": "CatalogProblem",
}


def refused(spark: SparkSession, folder: str) -> DataFrame:
    """What is no statement, has no meaning or breaks a rule, and the error that it gives."""
    rows = []
    for text in REFUSED:
        try:
            Job(spark).run(_script(folder, ["nation", "region"], text))
            rows.append((text, "none"))
        except Exception as e:  # noqa: BLE001
            rows.append((text, type(e).__name__))
    return spark.createDataFrame(rows, "statement string, error string")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {name: partial(run, text=t if isinstance(t, str) else t[0]) for name, t in TEXTS.items()}
QUERIES |= {
    f.__name__: f
    for f in (repartition_join, repartition_agg, csv_scan, csv_declared, csv_partitions, csv_result, describe_table, plan_graphs, refused)
}

_MIXED = {
    "agg_arith": "SELECT n_regionkey, CAST(sum(n_nationkey + 10) * 99 AS DOUBLE) / count(n_nationkey + 50) AS mixed, avg(n_nationkey) AS mean FROM nation GROUP BY n_regionkey",
    "literals": "SELECT n_nationkey, 'abc' AS word, CAST(7 AS BIGINT) AS seven, CAST(2.5 AS DOUBLE) AS half FROM nation",
    "exists": "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')",
    "function_call": "SELECT n_nationkey, upper(substring(n_name, 1, 3)) AS head, CAST(length(n_name) AS INTEGER) AS size_of, coalesce(n_name, 'none') AS known FROM nation",
    "case_when": "SELECT o_orderpriority, CAST(SUM(CASE WHEN o_totalprice > 200000.0 THEN 1 ELSE 0 END) AS DOUBLE) AS large, COUNT(*) AS n FROM orders GROUP BY o_orderpriority",
}
ORACLE_SQL: dict[str, str] = {name: _MIXED.get(name, t if isinstance(t, str) else t[1]) for name, t in TEXTS.items()}
ORACLE_SQL |= {
    "repartition_join": "SELECT l_orderkey, count(*) AS line_count, max(l_quantity) AS max_qty FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY l_orderkey",
    "repartition_agg": "SELECT o_custkey, count(*) AS n, max(o_totalprice) AS high FROM orders GROUP BY o_custkey",
    "comments": "SELECT n_name, n_regionkey FROM nation",
    "csv_scan": "SELECT p_partkey, p_brand, CAST(p_size AS BIGINT) AS p_size, p_retailprice FROM part WHERE p_size > 20",
    "csv_declared": "SELECT p_partkey, p_name, CAST(p_size + 1 AS BIGINT) AS size_more FROM part",
    "csv_partitions": "SELECT p_brand, count(*) AS n, CAST(max(p_size) AS BIGINT) AS largest FROM part GROUP BY p_brand",
    "csv_result": "SELECT n_nationkey, n_name FROM nation WHERE n_regionkey < 3",
    "describe_table": """SELECT 'COLUMN ' || upper(column_name) AS item, CASE column_type WHEN 'BIGINT' THEN 'bigint' WHEN 'INTEGER' THEN 'int' WHEN 'DOUBLE' THEN 'double' ELSE 'string' END AS value
                         FROM (DESCRIBE customer)
                         UNION ALL VALUES ('TABLE', 'CUSTOMER'), ('TYPE', 'PARQUET'), ('PARTITIONS', '2'), ('NROWS', '1500'), ('AVG_ROW_SIZE', '1')""",
    "plan_graphs": "SELECT * FROM (VALUES ('syntax', 2, 1, 1), ('resolved', 2, 1, 1), ('logical', 2, 1, 1), ('physical', 2, 1, 2)) AS x(stage, tables, joins, aggregates)",
    "refused": "SELECT * FROM (VALUES " + ", ".join(f"('{t.replace(chr(39), chr(39) * 2)}', '{e}')" for t, e in REFUSED.items()) + ") AS x(statement, error)",
}
