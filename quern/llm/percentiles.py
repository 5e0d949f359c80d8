"""Percentiles per group from summaries that add up, by one distributed sort.

A summary is a table of values and their counts per group (and per day or file);
summaries are combined by adding counts. Percentiles come from a range sort over
(group, value): counts per partition give the offset of every group in every
partition, so that target positions are found where they lie and neighbouring
order statistics are interpolated. A group of any size is spread over partitions.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.session import cut_lineage, partitions_for, shuffled


def summarise(df: DataFrame, group: str, value: str, period: Column | None = None, rel_error: float = 0.0) -> DataFrame:
    """Counts of values: columns ``period`` (if given), ``grp``, ``val``, ``n``.

    With ``rel_error`` 0 values are kept as they are and percentiles are exact.
    With ``rel_error`` e above 0, values are rounded to the middle of logarithmic
    buckets, which bounds the size of a summary whatever the number of rows, and
    every reported order statistic v' obeys |v' - v| <= e * |v|. Null and NaN
    values are left out; a null group is a group. Repeated rows count as often as
    they come. An empty table has an empty summary.
    """
    if not 0 <= rel_error < 1:
        raise ValueError("rel_error must be at least 0 and below 1")
    v = F.col(value).cast("double")
    if rel_error:
        gamma = (1 + rel_error) / (1 - rel_error)
        step = F.ceil(F.log(F.abs(v)) / F.lit(math.log(gamma)))
        middle = F.pow(F.lit(gamma), step) * F.lit(2.0) / F.lit(gamma + 1)
        v = F.when(v == 0, v).otherwise(F.signum(v) * middle)
    keys = [F.col(group).alias("grp"), v.alias("val")]
    if period is not None:
        keys.insert(0, period.alias("period"))
    known = F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))
    return df.where(known).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


def combine(summaries: DataFrame) -> DataFrame:
    """One summary of several: the counts of all periods added up."""
    return summaries.groupBy("grp", "val").agg(F.sum("n").alias("n"))


def percentiles(summary: DataFrame, shares: Sequence[float], rows_per_task: int = 250_000, rows: int | None = None) -> DataFrame:
    """``grp``, ``percentile``, ``value``, ``group_rows`` for every group and share.

    The percentile p of n values is the order statistic at position p * (n - 1),
    with linear interpolation between neighbours, so that it is exact for an exact
    summary. Groups of one value have it as every percentile. Values are not rounded. ``rows`` is about how many rows the summary has, where that is
    known: it is then neither counted nor kept on disk before it is sorted.
    """
    if not shares or any(not 0 <= p <= 1 for p in shares):
        raise ValueError("shares must be between 0 and 1")
    counted = summary.select("grp", "val", "n")
    if rows is None:
        counted = cut_lineage(counted)
        rows = counted.count()
    tasks = partitions_for(rows, rows_per_task, least=2)
    # the sort: equal (grp, val) pairs are one row, so ranges cut any group evenly
    sorted_rows = cut_lineage(counted.repartitionByRange(tasks, "grp", "val").select("*", F.spark_partition_id().alias("pid")))
    per_part = sorted_rows.groupBy("grp", "pid").agg(F.sum("n").alias("part_n"))
    by_part = Window.partitionBy("grp").orderBy("pid")
    whole = Window.partitionBy("grp")
    offsets = per_part.select(
        F.col("grp").alias("g"),
        F.col("pid").alias("p"),
        (F.sum("part_n").over(by_part) - F.col("part_n")).alias("before_part"),
        F.sum("part_n").over(whole).alias("group_rows"),
    )
    within = Window.partitionBy("grp", "pid").orderBy("val").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = sorted_rows.withColumn("upto", F.sum("n").over(within))
    placed = ranked.join(shuffled(offsets), F.col("grp").eqNullSafe(F.col("g")) & (F.col("pid") == F.col("p"))).select(
        "grp",
        "val",
        "group_rows",
        (F.col("before_part") + F.col("upto") - F.col("n")).alias("first_pos"),
        (F.col("before_part") + F.col("upto") - 1).alias("last_pos"),
    )
    wanted = F.explode(F.array(*[F.lit(float(p)) for p in shares])).alias("percentile")
    position = F.col("percentile") * (F.col("group_rows") - 1)
    low, high = F.floor(position), F.ceil(position)
    hits = placed.select("*", wanted).where(
        ((F.col("first_pos") <= low) & (low <= F.col("last_pos"))) | ((F.col("first_pos") <= high) & (high <= F.col("last_pos")))
    )
    at_low = F.max(F.when((F.col("first_pos") <= low) & (low <= F.col("last_pos")), F.col("val")))
    at_high = F.max(F.when((F.col("first_pos") <= high) & (high <= F.col("last_pos")), F.col("val")))
    ends = hits.groupBy("grp", "percentile", "group_rows").agg(at_low.alias("lo"), at_high.alias("hi"))
    share = position - F.floor(position)
    return ends.select("grp", "percentile", (F.col("lo") + (F.col("hi") - F.col("lo")) * share).alias("value"), "group_rows")
