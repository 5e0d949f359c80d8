"""Queries of the text operators (problems 1, 4, 7 to 10) and their SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import addresses, mixing, names, packing, percentiles, sentences, tokens
from quern.session import cut_lineage, shuffled
from quern.sources.tables import table

#: More pack limits than this are refused, as each is a plan of its own.
MAX_LIMITS = 1000
SHARES = (0.05, 0.25, 0.5, 0.75, 0.95, 0.99)


def _records(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    """Customers and suppliers together, under keys such as c:ABCDE and s:12."""
    c = table(spark, folder, "customers").select(F.concat(F.lit("c:"), "customerID").alias("key"), *columns)
    s = table(spark, folder, "suppliers").select(F.concat(F.lit("s:"), F.col("supplierID").cast("string")).alias("key"), *columns)
    return c.unionByName(s).where(F.col("key").isNotNull())


def _name_records(spark: SparkSession, folder: str) -> DataFrame:
    firms = _records(spark, folder, "companyName").select(F.lit("company").alias("name_kind"), "key", F.col("companyName").alias("name"))
    persons = _records(spark, folder, "contactName").where(F.col("key").startswith("c:")).select(F.lit("contact").alias("name_kind"), "key", F.col("contactName").alias("name"))
    given = firms.unionByName(persons)
    return given.where(F.col("name").isNotNull() & (F.col("name") != "NULL")).distinct()


def _name_members(spark: SparkSession, folder: str) -> DataFrame:
    records = cut_lineage(_name_records(spark, folder))
    return cut_lineage(names.class_members(records, names.link_names(records)))


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return names.class_pairs(_name_members(spark, folder))


def p1_classes(spark: SparkSession, folder: str) -> DataFrame:
    """One row per record: its class and number of links."""
    return _name_members(spark, folder)


def _place_members(spark: SparkSession, folder: str) -> DataFrame:
    return cut_lineage(addresses.link_addresses(_records(spark, folder, "address", "city", "postalCode")))


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    return addresses.place_pairs(_place_members(spark, folder))


def p7_classes(spark: SparkSession, folder: str) -> DataFrame:
    """One row per record with a readable address: its class and number of links."""
    return _place_members(spark, folder)


def _percentiles(spark: SparkSession, folder: str, name: str, group: str, value: str, rel_error: float = 0.0) -> DataFrame:
    """Daily summaries, combined, and the percentiles of all days."""
    daily = percentiles.summarise(table(spark, folder, name), group, value, F.to_date("loaded_at"), rel_error)
    found = percentiles.percentiles(percentiles.combine(daily), SHARES)
    return found.withColumnRenamed("grp", group).withColumn("value", F.round("value", 6))


def p4_day_and_total_percentiles(spark: SparkSession, folder: str) -> DataFrame:
    """Of the summaries kept per day: percentiles of each day, and (null day) of all days combined."""
    daily = cut_lineage(percentiles.summarise(table(spark, folder, "emp"), "emp_dept_id", "salary", F.to_date("loaded_at")))
    every = percentiles.combine(daily).withColumn("period", F.lit(None).cast("date"))
    both = daily.unionByName(every).select(F.struct("period", F.col("grp").alias("dept")).alias("grp"), "val", "n")
    found = percentiles.percentiles(both, SHARES, rows=2 * daily.count())  # all days together have no more than the days
    return found.select(F.date_format("grp.period", "yyyy-MM-dd").alias("load_day"), F.col("grp.dept").alias("emp_dept_id"), "percentile", F.round("value", 6).alias("value"), "group_rows")


def p4_salary_percentiles(spark: SparkSession, folder: str) -> DataFrame:
    return _percentiles(spark, folder, "emp", "emp_dept_id", "salary")


def p4_price_percentiles(spark: SparkSession, folder: str) -> DataFrame:
    return _percentiles(spark, folder, "products", "categoryID", "unitPrice")


def p4_salary_within_1_percent(spark: SparkSession, folder: str) -> DataFrame:
    """From summaries of bounded size, with a relative error of at most 0.01."""
    return _percentiles(spark, folder, "emp", "emp_dept_id", "salary", 0.01)


def p4_daily_summaries(spark: SparkSession, folder: str) -> DataFrame:
    """What is kept per day: values and counts."""
    daily = percentiles.summarise(table(spark, folder, "emp"), "emp_dept_id", "salary", F.to_date("loaded_at"))
    return daily.select(F.date_format("period", "yyyy-MM-dd").alias("load_day"), F.col("grp").alias("emp_dept_id"), F.col("val").alias("salary"), "n")


def _document_tokens(spark: SparkSession, folder: str) -> DataFrame:
    texts = table(spark, folder, "documents").where(F.col("text").isNotNull())
    return cut_lineage(tokens.token_counts(texts, "doc_id", "text", ("source",)))


def _pack_limits(spark: SparkSession, folder: str) -> list:
    """Rows of pack_limits; more than MAX_LIMITS are refused."""
    limits = table(spark, folder, "pack_limits").limit(MAX_LIMITS + 1).collect()
    if len(limits) > MAX_LIMITS:
        raise ValueError(f"more than {MAX_LIMITS} pack limits")
    return limits


def p8_containers(spark: SparkSession, folder: str) -> DataFrame:
    """All documents in containers of each capacity of pack_limits (a small fixed table)."""
    counted = _document_tokens(spark, folder)
    rows = counted.count()
    limits = _pack_limits(spark, folder)
    parts = [
        packing.pack(counted, "doc_id", "tokens", [r["capacity_tokens"]], rows=rows).select(
            F.lit(r["limit_name"]).alias("limit_name"),
            "container_id",
            "capacity",
            F.col("item").alias("doc_id"),
            "piece_no",
            "position",
            F.col("piece_start").alias("token_start"),
            F.col("piece_size").alias("token_count"),
        )
        for r in limits
    ]
    return reduce(DataFrame.unionByName, parts)


def p8_mixed_capacities(spark: SparkSession, folder: str) -> DataFrame:
    """All documents in containers of the permitted capacities, chosen jointly and downsized."""
    counted = _document_tokens(spark, folder)
    caps = [r["capacity_tokens"] for r in _pack_limits(spark, folder)]
    packed = packing.pack(counted, "doc_id", "tokens", caps)
    return packed.select(
        "container_id", "capacity", F.col("item").alias("doc_id"), "piece_no", "position", F.col("piece_start").alias("token_start"), F.col("piece_size").alias("token_count")
    )


def p8_checks(spark: SparkSession, folder: str) -> DataFrame:
    """What must hold of the packings, counted: one row for each limit, and one (``mixed``) for all capacities together."""
    counted = _document_tokens(spark, folder)
    rows = counted.count()
    limits = _pack_limits(spark, folder)
    jobs = [(r["limit_name"], [r["capacity_tokens"]]) for r in limits] + [("mixed", [r["capacity_tokens"] for r in limits])]
    parts = []
    for name, caps in jobs:
        largest = max(caps)
        packed = cut_lineage(packing.pack(counted, "doc_id", "tokens", caps, rows=rows))
        box = packed.groupBy("container_id", "capacity").agg(F.sum("piece_size").alias("held"), F.max(F.col("position") + F.col("piece_size")).alias("reach"))
        boxes = box.agg(
            F.coalesce(F.sum(((F.col("held") > F.col("capacity")) | (F.col("reach") != F.col("held")) | ~F.col("capacity").isin(caps)).cast("long")), F.lit(0)).alias("wrong_containers"),
            (F.count("container_id") - F.count_distinct("container_id")).alias("container_ids_twice"),
            (F.sum("held") >= 0.9 * F.sum("capacity")).alias("nine_tenths_full"),
        )
        own = packed.groupBy("item").agg(F.sum("piece_size").alias("placed"), F.count(F.lit(1)).alias("pieces"))
        joined = counted.groupBy(F.col("doc_id").alias("item")).agg(F.max("tokens").alias("tokens")).join(shuffled(own), "item", "full")
        cut_right = F.col("pieces") == F.greatest(F.ceil(F.col("tokens") / F.lit(largest)), F.lit(1))
        docs = joined.agg(F.count("pieces").alias("documents"), F.coalesce(F.sum((~F.coalesce((F.col("placed") == F.col("tokens")) & cut_right, F.lit(False))).cast("long")), F.lit(0)).alias("wrong_documents"))
        parts.append(docs.join(F.broadcast(boxes)).select(F.lit(name).alias("limit_name"), "documents", "wrong_documents", "wrong_containers", "container_ids_twice", "nine_tenths_full"))
    return reduce(DataFrame.unionByName, parts)


def p9_checks(spark: SparkSession, folder: str) -> DataFrame:
    """What must hold of the mix, for each target: no record too often, no other source, and the share reached within 0.02."""
    targets = table(spark, folder, "mix_targets")
    drawn = cut_lineage(mixing.draw(_document_tokens(spark, folder), targets))
    most = drawn.groupBy("source", "doc_id").agg(F.count(F.lit(1)).alias("n"), F.max("copy_no").alias("last"))
    too_often = most.join(F.broadcast(targets), "source", "left").where(F.col("max_repeats").isNull() | (F.col("n") > F.col("max_repeats")) | (F.col("n") != F.col("last")))
    wrong = too_often.agg(F.count(F.lit(1)).alias("wrong_records"))
    weight = targets.agg(F.sum("target_weight").alias("all_weight"))
    reached = mixing.shares(drawn, targets).join(F.broadcast(weight)).join(F.broadcast(wrong))
    off = F.abs(F.col("reached_share") - F.col("target_weight") / F.col("all_weight"))
    return reached.select("source", "max_repeats", "wrong_records", (off <= 0.02).alias("share_reached"))


def p9_mix(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.draw(_document_tokens(spark, folder), table(spark, folder, "mix_targets"))


def p9_shares(spark: SparkSession, folder: str) -> DataFrame:
    targets = table(spark, folder, "mix_targets")
    return mixing.shares(mixing.draw(_document_tokens(spark, folder), targets), targets)


def p10_found(spark: SparkSession, folder: str) -> DataFrame:
    return sentences.sentence_units(table(spark, folder, "documents").select("doc_id", "text"))


def _percentile_sql(name: str, group: str, value: str) -> str:
    parts = [
        f"""SELECT "{group}", CAST({p} AS DOUBLE) AS percentile, round(quantile_cont("{value}", {p}), 6) AS value, CAST(count("{value}") AS BIGINT) AS group_rows
            FROM {name} WHERE "{value}" IS NOT NULL GROUP BY "{group}" """
        for p in SHARES
    ]
    return " UNION ALL ".join(parts)


QUERIES = {
    "p1_found": p1_found,
    "p1_classes": p1_classes,
    "p7_found": p7_found,
    "p7_classes": p7_classes,
    "p4_day_and_total_percentiles": p4_day_and_total_percentiles,
    "p4_salary_percentiles": p4_salary_percentiles,
    "p4_price_percentiles": p4_price_percentiles,
    "p4_salary_within_1_percent": p4_salary_within_1_percent,
    "p4_daily_summaries": p4_daily_summaries,
    "p8_containers": p8_containers,
    "p8_mixed_capacities": p8_mixed_capacities,
    "p8_checks": p8_checks,
    "p9_mix": p9_mix,
    "p9_checks": p9_checks,
    "p9_shares": p9_shares,
    "p10_found": p10_found,
}

# the middle of the bucket that a value falls in: what is within 0.01 of it
_BUCKET = "CASE WHEN salary = 0 THEN salary ELSE sign(salary) * pow(1.01 / 0.99, ceil(ln(abs(salary)) / ln(1.01 / 0.99))) * 2 / (1.01 / 0.99 + 1) END"
_WITHIN_SQL = " UNION ALL ".join(
    f"""SELECT emp_dept_id, CAST({p} AS DOUBLE) AS percentile, round(quantile_cont(v, {p}), 6) AS value, CAST(count(v) AS BIGINT) AS group_rows
        FROM (SELECT emp_dept_id, {_BUCKET} AS v FROM emp WHERE salary IS NOT NULL) GROUP BY emp_dept_id"""
    for p in SHARES
)

_DAYS_SQL = " UNION ALL ".join(
    f"""SELECT strftime(CAST(loaded_at AS DATE), '%Y-%m-%d') AS load_day, emp_dept_id, CAST({p} AS DOUBLE) AS percentile,
               round(quantile_cont(salary, {p}), 6) AS value, CAST(count(salary) AS BIGINT) AS group_rows
        FROM emp WHERE salary IS NOT NULL GROUP BY GROUPING SETS ((CAST(loaded_at AS DATE), emp_dept_id), (emp_dept_id))"""
    for p in SHARES
)

ORACLE_SQL = {
    "p8_checks": """SELECT limit_name, (SELECT CAST(count(*) AS BIGINT) FROM documents WHERE text IS NOT NULL) AS documents, CAST(0 AS BIGINT) AS wrong_documents,
                           CAST(0 AS BIGINT) AS wrong_containers, CAST(0 AS BIGINT) AS container_ids_twice, true AS nine_tenths_full
                    FROM (SELECT limit_name FROM pack_limits UNION ALL SELECT 'mixed')""",
    "p9_checks": "SELECT source, max_repeats, CAST(0 AS BIGINT) AS wrong_records, true AS share_reached FROM mix_targets",
    "p4_day_and_total_percentiles": _DAYS_SQL,
    "p4_salary_within_1_percent": _WITHIN_SQL,
    "p4_salary_percentiles": _percentile_sql("emp", "emp_dept_id", "salary"),
    "p4_price_percentiles": _percentile_sql("products", "categoryID", "unitPrice"),
    "p4_daily_summaries": """SELECT strftime(loaded_at, '%Y-%m-%d') AS load_day, emp_dept_id, salary, CAST(count(*) AS BIGINT) AS n
                             FROM emp WHERE salary IS NOT NULL GROUP BY 1, 2, 3""",
}
