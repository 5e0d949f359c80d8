"""Heavy keys: find them, aggregate and join without one task holding them.

Row counts per key are never gathered in one place. A first pass counts rows per
hash bucket (a one-row count sketch of fixed size); only keys that fall in a
bucket which could hold a heavy key are counted exactly in the second pass, so no
heavy key is missed and no light key is reported.

What counts as heavy follows from what a task can hold, not from a share of the
table: a key is treated apart as soon as it has more rows than one task should
work on, and is spread over as many tasks as its own rows need.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Buckets of the sketch: bounds what the driver gets from the first pass.
SKETCH_BUCKETS = 4096
#: Rows of one key that a task works on; a key with more is heavy.
ROWS_PER_TASK = 100_000
#: Heavy keys at most: bounds the table of them, which is broadcast.
MOST_HEAVY = 100_000
#: Heavy keys up to this number are told by an expression, more by a broadcast join.
FEW_HEAVY = 32
#: Rows and bytes (as JSON text) of a join's other side up to which its heavy part is broadcast.
BROADCAST_ROWS, BROADCAST_BYTES = 100_000, 32 << 20


def _sketch(df: DataFrame, key: str, buckets: int) -> tuple[Column, dict[int | None, int]]:
    """The bucket of a row, and the rows of every bucket; null keys are in the bucket None."""
    bucket = F.when(F.col(key).isNotNull(), F.pmod(F.xxhash64(F.col(key)), F.lit(buckets)))
    return bucket, {r["b"]: r["count"] for r in df.select(bucket.alias("b")).groupBy("b").count().collect()}


def _above(df: DataFrame, key: str, bucket: Column, sketch: dict[int | None, int], least: float) -> DataFrame:
    hot = [b for b, rows in sketch.items() if b is not None and rows >= least]
    if not hot:
        return df.select(key).where(F.lit(False)).withColumn("key_rows", F.lit(0).cast("long"))
    return df.select(key).where(bucket.isin(hot)).groupBy(key).agg(F.count(F.lit(1)).alias("key_rows")).where(F.col("key_rows") >= F.lit(least))


def heavy_keys(df: DataFrame, key: str, share: float = 0.05, buckets: int = SKETCH_BUCKETS) -> DataFrame:
    """Keys that hold at least ``share`` of all rows: columns ``key``, ``key_rows``.

    Null keys and repeated rows count towards all rows; null is never a heavy
    key. An empty table has none. At most ``1 / share`` rows come out, which
    bounds every broadcast of the result. Other columns of ``df`` are not read.
    """
    if not 0 < share <= 1:
        raise ValueError("share must be above 0 and at most 1")
    bucket, sketch = _sketch(df, key, buckets)
    return _above(df, key, bucket, sketch, share * sum(sketch.values()))


def heavy_parts(df: DataFrame, key: str, rows_per_task: int = ROWS_PER_TASK, share: float | None = None, buckets: int = SKETCH_BUCKETS) -> tuple[list[tuple], int]:
    """``(key, rows, tasks)`` of every key with more than ``rows_per_task`` rows, and the number of all rows.

    ``tasks`` is how many tasks its rows need. With ``share``, keys that hold that
    share of all rows are among them, however few their rows are. A table so large
    that more than MOST_HEAVY keys could be heavy has the limit raised to that
    part of its rows, so that the list stays bounded: a key that counts as light
    then has at most a MOST_HEAVY-th of all rows. Null is never heavy.
    """
    if rows_per_task < 1:
        raise ValueError("rows_per_task must be positive")
    bucket, sketch = _sketch(df, key, buckets)
    total = sum(sketch.values())
    least = max(rows_per_task + 1, total / MOST_HEAVY)
    if share is not None:
        least = min(least, max(share * total, 1))
    found = _above(df, key, bucket, sketch, least).collect()
    return sorted((r[key], r["key_rows"], -(-r["key_rows"] // rows_per_task)) for r in found), total


def _table(df: DataFrame, key: str, parts: list[tuple], column: str = "__hot_key") -> DataFrame:
    """The heavy keys with their ``__tasks``, to be broadcast: MOST_HEAVY rows at most."""
    kind = df.schema[key].dataType.simpleString()
    return F.broadcast(df.sparkSession.createDataFrame([(k, n) for k, _, n in parts], f"{column} {kind}, __tasks long"))


def spread(df: DataFrame, key: str, parts: list[tuple]) -> DataFrame:
    """``df`` with ``__tasks``: for rows of heavy keys how many tasks the key needs, else null."""
    if len(parts) <= FEW_HEAVY:  # few keys go into the expression itself
        tasks = F.lit(None).cast("long")
        for k, _, n in parts:
            tasks = F.when(F.col(key) == F.lit(k), F.lit(n).cast("long")).otherwise(tasks)
        return df.withColumn("__tasks", tasks)
    hot = _table(df, key, parts)
    return df.join(hot, F.col(key) == F.col("__hot_key"), "left").drop("__hot_key")


def _small(df: DataFrame, rows: int, size: int) -> bool:
    """Whether ``df`` has at most ``rows`` rows and ``size`` bytes; reads no more than it must."""
    head = df.limit(rows + 1).agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length(F.to_json(F.struct("*")))).alias("size")).first()
    return head["n"] <= rows and (head["size"] or 0) <= size


def skew_join(
    left: DataFrame,
    right: DataFrame,
    key: str,
    right_key: str | None = None,
    how: str = "inner",
    rows_per_task: int = ROWS_PER_TASK,
    broadcast_rows: int = BROADCAST_ROWS,
    broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """Join ``left`` to ``right`` on one key, whose heavy values are treated apart.

    ``how`` is ``inner`` or ``left``. Heavy keys are those with more than
    ``rows_per_task`` rows on either side. Left rows of these meet the matching
    right rows by a broadcast join if those are at most ``broadcast_rows`` and
    ``broadcast_bytes`` (measured first). Beyond that the side of a key with more rows is
    dealt over as many tasks as it needs, and rows of the other side are copied to
    each. Other keys go through an ordinary shuffled join, and both parts are united.
    Null keys match nothing. Right columns whose names are on the left, too, get
    the suffix ``_right``; the key comes once when ``right_key`` isn't given.
    """
    if how not in ("inner", "left"):
        raise ValueError("how must be inner or left")
    other = right_key or key
    taken = set(left.columns) - ({key} if other == key else set())
    right = right.select(*[right[c].alias(f"{c}_right" if c in taken else c) for c in right.columns])
    other = f"{other}_right" if other in taken else other
    l_tasks, r_tasks = ({k: n for k, _, n in heavy_parts(df, c, rows_per_task)[0]} for df, c in ((left, key), (right, other)))
    marked = "__right_key"

    def joined(a: DataFrame, b: DataFrame, how: str, extra: Column | None = None) -> DataFrame:
        b = b.withColumnRenamed(other, marked)
        condition = a[key] == b[marked]
        if extra is not None:
            condition = condition & extra
        out = a.join(b, condition, how)
        return out.drop(marked) if other == key else out.withColumnRenamed(marked, other)

    heavy = sorted({*l_tasks, *r_tasks})
    if not heavy:
        return joined(left, right, how)
    # rows of a key are dealt on the side that needs more tasks, and copied to each on the other
    deal_left = {k: l_tasks.get(k, 1) >= r_tasks.get(k, 1) for k in heavy}
    l_deal = [(k, 0, l_tasks.get(k, 1) if deal_left[k] else 1) for k in heavy]
    r_deal = [(k, 0, 1 if deal_left[k] else r_tasks[k]) for k in heavy]
    l_copy, r_copy = [(k, 0, n) for k, _, n in r_deal], [(k, 0, n) for k, _, n in l_deal]
    l_df, l_key, r_df, r_key = left, key, right, other
    hot_left = l_df.join(_table(l_df, l_key, l_deal), F.col(l_key) == F.col("__hot_key")).drop("__hot_key")
    hot_right = r_df.join(_table(r_df, r_key, r_deal), F.col(r_key) == F.col("__hot_key")).drop("__hot_key")
    cold_left = l_df.join(_table(l_df, l_key, l_deal), F.col(l_key) == F.col("__hot_key"), "left_anti")
    cold_right = r_df.join(_table(r_df, r_key, r_deal), F.col(r_key) == F.col("__hot_key"), "left_anti")
    cold = joined(cold_left, cold_right, how)
    plain_left, plain_right = hot_left.drop("__tasks"), hot_right.drop("__tasks")
    if _small(plain_right, broadcast_rows, broadcast_bytes):
        return cold.unionByName(joined(plain_left, F.broadcast(plain_right), how))

    def dealt(df: DataFrame, column: str, names: list[str], copies: list[tuple], out: str) -> DataFrame:
        """Rows with the task of their key: one of its ``__tasks``, or each where the other side is dealt."""
        plain = [F.col(c) for c in names if "map<" not in dict(df.dtypes)[c]]
        # copies of a row are apart where they were read apart
        mine = F.pmod(F.xxhash64(*plain, F.spark_partition_id()), F.col("__tasks")).cast("long")
        renamed = _table(df, column, copies, "__copy_key").withColumnRenamed("__tasks", "__copies")
        with_copies = df.join(renamed, F.col(column) == F.col("__copy_key")).drop("__copy_key")
        each = F.when(F.col("__copies") > 1, F.sequence(F.lit(0).cast("long"), F.col("__copies") - 1)).otherwise(F.array(mine))
        return with_copies.withColumn(out, F.explode(each)).drop("__tasks", "__copies")

    a = dealt(hot_left, l_key, left.columns, l_copy, "__task_l")
    b = dealt(hot_right, r_key, right.columns, r_copy, "__task_r")
    united = cold.unionByName(joined(a, b, "inner", F.col("__task_l") == F.col("__task_r")).drop("__task_l", "__task_r"))
    if how == "left":  # heavy keys without any right row; there are MOST_HEAVY keys at most
        present = plain_right.select(F.col(r_key).alias("__present")).distinct()
        alone = plain_left.join(F.broadcast(present), F.col(l_key) == F.col("__present"), "left_anti")
        united = united.unionByName(joined(alone, plain_right.where(F.lit(False)), how))
    return united


def per_key_stats(df: DataFrame, key: str, value: str, share: float = 0.05, rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """Rows, non-null values, distinct values, sum, mean, least and greatest value of every key.

    Columns: ``key``, ``key_rows``, ``value_rows``, ``distinct_values``,
    ``value_sum``, ``value_avg``, ``value_min``, ``value_max``, ``is_hot`` (whether
    the key holds ``share`` of all rows). All
    rows with a null key form one key. Rows of keys that are heavy by ``share`` or
    ``rows_per_task`` are split off by a broadcast join with the table of heavy keys: they
    shrink to one row per (key, value) on the map side, are spread
    over tasks by (key, value), and only sums of these reach the task of the key. The
    rest is grouped by key, and both parts are united. Nothing is rounded. An empty
    table gives no row; a key without any value has null statistics and zero counts.
    """
    parts, total = heavy_parts(df, key, rows_per_task, share)
    rows = df.select(key, value)
    v = F.col(value)
    measures = (
        F.count(F.lit(1)).alias("key_rows"),
        F.count(v).alias("value_rows"),
        F.count_distinct(v).alias("distinct_values"),
        F.sum(v).alias("value_sum"),
        F.min(v).alias("value_min"),
        F.max(v).alias("value_max"),
    )
    out = rows.groupBy(key).agg(*measures)
    if parts:
        hot = _table(df, key, parts)
        on = F.col(key) == F.col("__hot_key")
        out = rows.join(hot, on, "left_anti").groupBy(key).agg(*measures)
        pairs = rows.join(hot, on).groupBy(key, value).agg(F.count(F.lit(1)).alias("__n"))
        n = F.col("__n")
        merged = pairs.groupBy(key).agg(
            F.sum(n).alias("key_rows"),
            F.coalesce(F.sum(F.when(v.isNotNull(), n)), F.lit(0).cast("long")).alias("value_rows"),
            F.count(v).alias("distinct_values"),
            F.sum(v * n).alias("value_sum"),
            F.min(v).alias("value_min"),
            F.max(v).alias("value_max"),
        )
        out = out.unionByName(merged)
    hottest = [k for k, n, _ in parts if n >= share * total]
    is_hot = F.coalesce(F.col(key).isin(hottest), F.lit(False)) if hottest else F.lit(False)
    mean = F.col("value_sum") / F.when(F.col("value_rows") > 0, F.col("value_rows"))
    return out.select(key, "key_rows", "value_rows", "distinct_values", "value_sum", mean.alias("value_avg"), "value_min", "value_max", is_hot.alias("is_hot"))

