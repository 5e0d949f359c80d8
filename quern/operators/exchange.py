"""Explicit exchanges and partition-wise work for users of the DataFrame API."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.session import shuffled


def _columns(keys: Sequence[str | Column]) -> list[Column]:
    return [F.expr(k) if isinstance(k, str) else k for k in keys]


def repartition(df: DataFrame, parts: int, keys: Sequence[str | Column]) -> DataFrame:
    """Hash rows by all key expressions into ``parts`` partitions.

    Joins and aggregates on the same keys then need no exchange of their own.
    """
    if parts < 1 or not keys:
        raise ValueError("parts must be positive, and there must be keys")
    return df.repartition(parts, *_columns(keys))


def co_partitioned_join(left: DataFrame, right: DataFrame, left_keys: Sequence[str], right_keys: Sequence[str], parts: int, how: str = "inner") -> DataFrame:
    """Join two tables that are hashed alike first, so that later steps on the keys stay in place.

    As both sides are exchanged already, neither is broadcast on top of that.
    """
    if len(left_keys) != len(right_keys) or not left_keys:
        raise ValueError("both sides need as many keys")
    a, b = repartition(left, parts, left_keys), repartition(right, parts, right_keys)
    condition = None
    for x, y in zip(left_keys, right_keys):
        step = F.expr(x) == F.expr(y)
        condition = step if condition is None else condition & step
    return a.join(shuffled(b), condition, how)


def keyed_aggregate(df: DataFrame, parts: int, keys: Sequence[str], aggregates: Sequence[Column]) -> DataFrame:
    """Partial aggregates, one exchange on the keys, final aggregates, in at most ``parts`` partitions.

    Spark plans both phases of a grouped aggregate itself, so that hot keys shrink before the exchange; its
    partitions are then put together into ``parts`` without another one. Only if more partitions
    than the session's are wanted are the groups, not the rows, dealt out once more.
    """
    if parts < 1:
        raise ValueError("parts must be positive")
    out = df.groupBy(*[F.expr(k).alias(k) for k in keys]).agg(*aggregates)
    if parts <= int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")):
        return out.coalesce(parts)
    return out.repartition(parts, *[F.col(f"`{k}`") for k in keys])
