"""References to parent rows that are missing, ended or not yet begun.

References and parent lifetimes are brought to the same task by key, sorted by
time, and merged in one linear pass with running aggregates: the latest end among
the lifetimes begun so far tells whether a parent is alive.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.operators.skew import ROWS_PER_TASK, heavy_parts, spread

#: End of a lifetime that has not ended.
OPEN_END = "9999-12-31 23:59:59.999999"


def orphan_references(
    children: DataFrame,
    child_key: str,
    reference: str,
    time: str,
    parents: DataFrame,
    parent_key: str,
    created: str | None = None,
    deleted: str | None = None,
    ref_field: str | None = None,
    rows_per_task: int = ROWS_PER_TASK,
) -> DataFrame:
    """One row per child row whose reference has no parent alive at ``time``.

    Columns: ``ref_field``, ``child_key``, ``reason``, ``ym``. The reason is
    ``missing`` if the key has no parent row at all, ``late`` if every parent row
    with it is created after ``time``, otherwise ``deleted``. Lifetimes include
    ``created`` and exclude ``deleted``; a null ``deleted`` has not ended, a null
    ``created`` began before all time. Null references are left out. A child with
    null ``time`` can only be ``missing``, with null ``ym``. Repeated child rows
    give one row.

    References with a key of more than ``rows_per_task`` rows are spread over as
    many tasks as they need, to each of which the lifetimes of that key are copied.
    """
    label = ref_field or reference
    parts, _ = heavy_parts(children.select(F.col(reference).cast("long").alias("k")), "k", rows_per_task)
    open_end = F.to_timestamp_ntz(F.lit(OPEN_END))
    never = F.lit(None).cast("timestamp_ntz")
    known = children.select(F.col(reference).cast("long").alias("k"), F.col(child_key).cast("long").alias("child"), F.col(time).cast("timestamp_ntz").alias("at"))
    tasks = F.coalesce("__tasks", F.lit(1).cast("long"))
    # copies of a child go to different tasks where they were read apart; the result is distinct
    refs = spread(known.where(F.col("k").isNotNull()), "k", parts).select(
        "k",
        F.pmod(F.xxhash64("child", "at", F.spark_partition_id()), tasks).alias("salt"),
        F.lit(2).alias("kind"),
        "at",
        "child",
        never.alias("begin"),
        never.alias("end"),
    )
    lives = parents.select(
        F.col(parent_key).cast("long").alias("k"),
        (F.col(created).cast("timestamp_ntz") if created else never).alias("begin"),
        F.coalesce(F.col(deleted).cast("timestamp_ntz"), open_end).alias("end") if deleted else open_end.alias("end"),
    )
    lives = spread(lives.where(F.col("k").isNotNull()).distinct(), "k", parts).withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), tasks - 1))).drop("__tasks")
    no_child = F.lit(None).cast("long").alias("child")
    # kind 0 sorts before all times and says that the key exists; kind 1 begins a lifetime
    exists = lives.select("k", "salt").distinct().select("k", "salt", F.lit(0).alias("kind"), never.alias("at"), no_child, never.alias("begin"), never.alias("end"))
    starts = lives.select("k", "salt", F.lit(1).alias("kind"), F.col("begin").alias("at"), no_child, "begin", "end")
    stream = refs.unionByName(exists).unionByName(starts)
    so_far = (
        Window.partitionBy("k", "salt")
        .orderBy(F.when(F.col("kind") == 0, 0).otherwise(1), F.col("at").asc_nulls_first(), "kind")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    merged = stream.select(
        "k",
        "kind",
        "at",
        "child",
        F.max(F.when(F.col("kind") == 0, 1)).over(so_far).alias("known"),
        F.max("end").over(so_far).alias("latest_end"),
    ).where(F.col("kind") == 2)
    reason = (
        F.when(F.col("known").isNull(), "missing")
        .when(F.col("at").isNull(), F.lit(None))
        .when(F.col("latest_end").isNull(), "late")
        .when(F.col("latest_end") <= F.col("at"), "deleted")
    )
    return (
        merged.select(
            F.lit(label).alias("ref_field"),
            F.col("child").alias("child_key"),
            reason.alias("reason"),
            F.date_format("at", "yyyy-MM").alias("ym"),
        )
        .where(F.col("reason").isNotNull())
        .distinct()
    )


def orphan_report(orphans: DataFrame) -> DataFrame:
    """Orphan references counted per field, reason and month: adds ``orphans``."""
    return orphans.groupBy("ref_field", "reason", "ym").agg(F.count(F.lit(1)).alias("orphans"))
