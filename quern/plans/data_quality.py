"""Queries of the general data operators (problems 2, 3, 5, 6) and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.operators import hierarchy as H
from quern.operators import references as R
from quern.operators import reject as J
from quern.operators import skew as S
from quern.sources.tables import table

HOT_FIELDS = (("emp.emp_dept_id", "emp", "emp_dept_id"), ("products.categoryID", "products", "categoryID"))
HOT_SHARE = 0.05


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    parts = [
        S.heavy_keys(table(spark, folder, name), key, HOT_SHARE).select(F.lit(field).alias("ref_field"), F.col(key).cast("long").alias("hot_key"))
        for field, name, key in HOT_FIELDS
    ]
    return parts[0].unionByName(parts[1])


def _rounded_stats(df: DataFrame, key: str, value: str) -> DataFrame:
    stats = S.per_key_stats(df, key, value, HOT_SHARE)
    return stats.withColumn("value_sum", F.round("value_sum", 2)).withColumn("value_avg", F.round("value_avg", 4))


def p2_salary_by_dept(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded_stats(table(spark, folder, "emp"), "emp_dept_id", "salary")


def p2_price_by_category(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded_stats(table(spark, folder, "products"), "categoryID", "unitPrice")


def p2_emp_dept_lives(spark: SparkSession, folder: str) -> DataFrame:
    """Rows of emp joined to the department row alive at updated_at, counted per department name."""
    dept = table(spark, folder, "dept").select("dept_id", F.col("name").alias("dept_name"), "created_at", "deleted_at")
    emp = table(spark, folder, "emp").select("emp_id", "emp_dept_id", "updated_at")
    joined = S.skew_join(emp, dept, "emp_dept_id", "dept_id")
    alive = (F.col("created_at") <= F.col("updated_at")) & (F.col("deleted_at").isNull() | (F.col("updated_at") < F.col("deleted_at")))
    return joined.where(alive).groupBy("dept_name").agg(F.count(F.lit(1)).alias("emp_rows"), F.countDistinct("dept_id").alias("dept_ids"))


def _tree(spark: SparkSession, folder: str) -> DataFrame:
    return H.hierarchy(table(spark, folder, "employees"), "employeeID", "reportsTo")


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return _tree(spark, folder).select(F.col("node").alias("employee_id"), "root_id", "tree_depth", "path_ids")


def p3_descendants(spark: SparkSession, folder: str) -> DataFrame:
    return H.descendants(_tree(spark, folder)).select(F.col("ancestor").alias("employee_id"), F.col("node").alias("descendant_id"), "distance")


def p3_cycles(spark: SparkSession, folder: str) -> DataFrame:
    """Employees whose line never ends; is_back_edge marks one link per cycle."""
    endless = _tree(spark, folder).where(F.col("tree_depth") == -1)
    return endless.select(F.col("node").alias("employee_id"), F.col("parent").alias("reports_to"), "is_back_edge")


RAW_EMP = [("name", "string", None), ("age", "long", J.whole_number(0, 120)), ("emp_dept_id", "long", None), ("salary", "double", J.unsigned_decimal)]
RAW_EMPLOYEES = [
    ("employeeID", "long", None),
    ("lastName", "string", None),
    ("firstName", "string", None),
    ("title", "string", None),
    ("hireDate", "timestamp", None),
    ("country", "string", None),
    ("notes", "string", None),
    ("reportsTo", "long", None),
]


def _parsed(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return J.parse_records(table(spark, folder, name), "line_id", "line_text", RAW_EMP if name == "raw_emp" else RAW_EMPLOYEES)


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    parts = [
        J.rejects(_parsed(spark, folder, name), "line_id").select(F.lit(name).alias("raw_table"), "line_id", F.col("reject_reason").alias("reason"))
        for name in ("raw_emp", "raw_employees")
    ]
    return parts[0].unionByName(parts[1])


def p5_emp_rows(spark: SparkSession, folder: str) -> DataFrame:
    return J.valid_rows(_parsed(spark, folder, "raw_emp"))


def p5_employees_rows(spark: SparkSession, folder: str) -> DataFrame:
    return J.valid_rows(_parsed(spark, folder, "raw_employees"))


REFERENCES = (
    ("emp.emp_dept_id", "emp", "emp_id", "emp_dept_id", "dept", "dept_id"),
    ("products.categoryID", "products", "productID", "categoryID", "categories", "categoryID"),
    ("products.supplierID", "products", "productID", "supplierID", "suppliers", "supplierID"),
)


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    parts = [
        R.orphan_references(
            table(spark, folder, child), key, ref, "updated_at", table(spark, folder, parent), parent_key, "created_at", "deleted_at", ref_field=field
        )
        for field, child, key, ref, parent, parent_key in REFERENCES
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def p6_report(spark: SparkSession, folder: str) -> DataFrame:
    return R.orphan_report(p6_found(spark, folder))


def _stats_sql(name: str, key: str, value: str) -> str:
    return f"""
        SELECT "{key}" AS "{key}", CAST(count(*) AS BIGINT) AS key_rows, CAST(count("{value}") AS BIGINT) AS value_rows,
               CAST(count(DISTINCT "{value}") AS BIGINT) AS distinct_values,
               round(sum("{value}"), 2) AS value_sum, round(sum("{value}") / nullif(count("{value}"), 0), 4) AS value_avg,
               min("{value}") AS value_min, max("{value}") AS value_max,
               "{key}" IS NOT NULL AND count(*) >= {HOT_SHARE} * (SELECT count(*) FROM {name}) AS is_hot
        FROM {name} GROUP BY "{key}" """


def _hot_sql(field: str, name: str, key: str) -> str:
    return f"""SELECT '{field}' AS ref_field, "{key}" AS hot_key FROM {name} WHERE "{key}" IS NOT NULL
               GROUP BY "{key}" HAVING count(*) >= {HOT_SHARE} * (SELECT count(*) FROM {name})"""


def _orphan_sql(field: str, child: str, key: str, ref: str, parent: str, parent_key: str) -> str:
    return f"""
        SELECT DISTINCT '{field}' AS ref_field, c."{key}" AS child_key,
               CASE WHEN p.k IS NULL THEN 'missing' WHEN c.updated_at < p.first_begin THEN 'late' ELSE 'deleted' END AS reason,
               strftime(c.updated_at, '%Y-%m') AS ym
        FROM {child} c LEFT JOIN (SELECT "{parent_key}" AS k, min(created_at) AS first_begin FROM {parent} GROUP BY 1) p ON c."{ref}" = p.k
        WHERE c."{ref}" IS NOT NULL AND NOT EXISTS (
            SELECT 1 FROM {parent} q WHERE q."{parent_key}" = c."{ref}" AND q.created_at <= c.updated_at
            AND (q.deleted_at IS NULL OR c.updated_at < q.deleted_at))"""


_P6 = " UNION ALL ".join(_orphan_sql(*r) for r in REFERENCES)

_P3_TREE = """
    WITH RECURSIVE e AS (SELECT "employeeID" AS id, min("reportsTo") AS up FROM employees GROUP BY 1),
    t AS (
        SELECT id, id AS root_id, 0 AS d, CAST(id AS VARCHAR) AS path FROM e
        WHERE up IS NULL OR up NOT IN (SELECT id FROM e)
        UNION ALL
        SELECT e.id, t.root_id, t.d + 1, t.path || '/' || CAST(e.id AS VARCHAR) FROM e JOIN t ON e.up = t.id
    ) """

_P3_CYCLES = (
    _P3_TREE
    + """, endless AS (SELECT id, up FROM e WHERE id NOT IN (SELECT id FROM t)),
    line AS (SELECT id AS start, up AS met FROM endless UNION SELECT line.start, x.up FROM line JOIN endless x ON line.met = x.id),
    back AS (SELECT start FROM line GROUP BY start HAVING bool_or(met = start) AND min(met) = start)
    SELECT id AS employee_id, up AS reports_to, id IN (SELECT start FROM back) AS is_back_edge FROM endless"""
)

# a field, and a record of fields, as the dialect of the records has them
_FIELD = """(?:"(?:[^"]|"")*"|[^",]*)"""


def _records_sql(name: str, fields: int) -> str:
    """Records ``r`` with quotes_ok, columns and, where both are right, the fields f1 .. unquoted and trimmed."""
    record = ",".join(f"({_FIELD})" for _ in range(fields))

    def field(k: int) -> str:
        raw = f"regexp_extract(x, '^{record}$', {k})"
        bare = f"""CASE WHEN {raw} LIKE '"%' THEN replace(substr({raw}, 2, length({raw}) - 2), '""', '"') ELSE {raw} END"""
        return f"nullif(nullif(regexp_replace({bare}, '^\\s+|\\s+$', '', 'g'), ''), 'NULL') AS f{k}"

    return f"""
        a AS (SELECT line_id, regexp_replace(coalesce(line_text, ''), '\\r$', '') AS x FROM {name}),
        b AS (SELECT line_id, x, regexp_full_match(x, '{_FIELD}(?:,{_FIELD})*') AS quotes_ok,
                     length(regexp_replace(regexp_replace(x, '"(?:[^"]|"")*"', '', 'g'), '[^,]', '', 'g')) + 1 AS columns FROM a),
        r AS (SELECT line_id, quotes_ok, columns, {", ".join(field(k) for k in range(1, fields + 1))} FROM b)"""


_EMP_VALUES = "(f2 IS NULL OR coalesce(regexp_full_match(f2, '[0-9]+') AND TRY_CAST(f2 AS DOUBLE) <= 120, false)) AND (f4 IS NULL OR regexp_full_match(f4, '[0-9]+([.][0-9]*)?|[.][0-9]+'))"
_LONG = "CASE WHEN regexp_full_match({0}, '[+-]?[0-9]+') THEN TRY_CAST({0} AS BIGINT) END"
_DAY = "CASE WHEN regexp_full_match({0}, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}') THEN TRY_CAST({0} AS TIMESTAMP) END"


def _unfit_sql(columns: list[tuple[str, str, str]]) -> str:
    """Names of the columns whose text isn't of their kind, joined by commas."""
    parts = ", ".join(f"CASE WHEN {field} IS NOT NULL AND {typed} IS NULL THEN '{name}' END" for name, field, typed in columns)
    return f"nullif(concat_ws(',', {parts}), '')"


_REJECTS_SQL = {
    name: f"""SELECT '{name}' AS raw_table, line_id, CASE WHEN NOT quotes_ok THEN 'quoting' WHEN columns <> {fields} THEN 'columns' ELSE 'value' END AS reason
              FROM (WITH {_records_sql(name, fields)} SELECT * FROM r) WHERE NOT quotes_ok OR columns <> {fields} {extra}"""
    for name, fields, extra in (("raw_emp", 4, f"OR NOT ({_EMP_VALUES})"), ("raw_employees", 8, ""))
}
_EMP_SQL = f"""WITH {_records_sql("raw_emp", 4)}
    SELECT line_id, f1 AS name, TRY_CAST(f2 AS BIGINT) AS age, {_LONG.format("f3")} AS emp_dept_id, TRY_CAST(f4 AS DOUBLE) AS salary,
           {_unfit_sql([("emp_dept_id", "f3", _LONG.format("f3"))])} AS unfit_columns
    FROM r WHERE quotes_ok AND columns = 4 AND {_EMP_VALUES}"""
_EMPLOYEES_SQL = f"""WITH {_records_sql("raw_employees", 8)}
    SELECT line_id, {_LONG.format("f1")} AS "employeeID", f2 AS "lastName", f3 AS "firstName", f4 AS title, {_DAY.format("f5")} AS "hireDate", f6 AS country, f7 AS notes,
           {_LONG.format("f8")} AS "reportsTo",
           {_unfit_sql([("employeeID", "f1", _LONG.format("f1")), ("hireDate", "f5", _DAY.format("f5")), ("reportsTo", "f8", _LONG.format("f8"))])} AS unfit_columns
    FROM r WHERE quotes_ok AND columns = 8"""

QUERIES = {
    "p2_found": p2_found,
    "p2_salary_by_dept": p2_salary_by_dept,
    "p2_price_by_category": p2_price_by_category,
    "p2_emp_dept_lives": p2_emp_dept_lives,
    "p3_found": p3_found,
    "p3_descendants": p3_descendants,
    "p3_cycles": p3_cycles,
    "p5_found": p5_found,
    "p5_emp_rows": p5_emp_rows,
    "p5_employees_rows": p5_employees_rows,
    "p6_found": p6_found,
    "p6_report": p6_report,
}

ORACLE_SQL = {
    "p2_found": " UNION ALL ".join(_hot_sql(*f) for f in HOT_FIELDS),
    "p2_salary_by_dept": _stats_sql("emp", "emp_dept_id", "salary"),
    "p2_price_by_category": _stats_sql("products", "categoryID", "unitPrice"),
    "p2_emp_dept_lives": """
        SELECT d.name AS dept_name, CAST(count(*) AS BIGINT) AS emp_rows, CAST(count(DISTINCT d.dept_id) AS BIGINT) AS dept_ids
        FROM emp e JOIN dept d ON e.emp_dept_id = d.dept_id AND d.created_at <= e.updated_at
             AND (d.deleted_at IS NULL OR e.updated_at < d.deleted_at)
        GROUP BY d.name""",
    "p3_found": _P3_TREE
    + """SELECT id AS employee_id, root_id, d AS tree_depth, path AS path_ids FROM t
         UNION ALL SELECT id, -1, -1, '' FROM e WHERE id NOT IN (SELECT id FROM t)""",
    "p3_descendants": _P3_TREE
    + """, u AS (SELECT id AS employee_id, id, 0 AS distance FROM t
                 UNION ALL SELECT u.employee_id, e.id, u.distance + 1 FROM u JOIN e ON e.up = u.id)
         SELECT employee_id, id AS descendant_id, distance FROM u WHERE distance > 0""",
    "p3_cycles": _P3_CYCLES,
    "p5_found": " UNION ALL ".join(_REJECTS_SQL.values()),
    "p5_emp_rows": _EMP_SQL,
    "p5_employees_rows": _EMPLOYEES_SQL,
    "p6_found": _P6,
    "p6_report": f"SELECT ref_field, reason, ym, CAST(count(*) AS BIGINT) AS orphans FROM ({_P6}) GROUP BY ref_field, reason, ym",
}
