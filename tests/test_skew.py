from collections import Counter

import pytest
from pyspark.sql import functions as F

from quern.operators import skew


def frame(spark, rows, schema="k long, v double, x string"):
    return spark.createDataFrame(rows, schema)


def test_heavy_keys_count_all_rows(spark):
    rows = [(1, 1.0, "a")] * 6 + [(None, 1.0, "a")] * 4 + [(k, 2.0, None) for k in range(10, 20)]
    got = {r["k"]: r["key_rows"] for r in skew.heavy_keys(frame(spark, rows), "k", 0.3).collect()}
    assert got == {1: 6}  # 6 of 20, nulls and repeats counted
    assert skew.heavy_keys(frame(spark, rows), "k", 0.31).collect() == []
    assert skew.heavy_keys(frame(spark, []), "k", 0.05).collect() == []


def test_heavy_keys_against_brute_force(spark):
    rows = [(int(i % 7 if i % 3 else 0), float(i), None) for i in range(3000)]
    want = {k: n for k, n in Counter(r[0] for r in rows).items() if n >= 0.05 * len(rows)}
    got = {r["k"]: r["key_rows"] for r in skew.heavy_keys(frame(spark, rows), "k", 0.05).collect()}
    assert got == want


def test_heavy_parts_follow_the_rows_of_a_task(spark):
    rows = [(1, 1.0, "a")] * 25 + [(2, 1.0, "a")] * 10 + [(None, 1.0, "a")] * 50 + [(3, 1.0, "a")]
    assert skew.heavy_parts(frame(spark, rows), "k", 10) == ([(1, 25, 3)], 86)
    assert skew.heavy_parts(frame(spark, rows), "k", 1000, share=0.1) == ([(1, 25, 1), (2, 10, 1)], 86)
    assert skew.heavy_parts(frame(spark, []), "k", 1, share=0.1) == ([], 0)
    with pytest.raises(ValueError):
        skew.heavy_parts(frame(spark, rows), "k", 0)


def test_skew_join_equals_plain_join(spark):
    left = frame(spark, [(i % 4 if i % 5 else None, float(i), "l") for i in range(200)])
    right = spark.createDataFrame([(k, f"d{k}", "r") for k in (0, 0, 1, 3, None)], "k long, d string, x string")
    wide = spark.createDataFrame([(k % 3, f"d{k}", "r") for k in range(150)], "k long, d string, x string")
    for a, b in ((left, right), (left, wide), (wide.select("k", F.lit(1.5).alias("v"), "x"), left.select("k", F.col("v").cast("string").alias("d"), "x"))):
        for how in ("inner", "left"):
            plain = a.join(b.withColumnRenamed("x", "x_right"), "k", how)
            for limit in ({}, {"broadcast_rows": 0}, {"broadcast_bytes": 10}):  # by broadcast, and dealt over tasks
                got = skew.skew_join(a, b, "k", how=how, rows_per_task=7, **limit)
                assert got.columns == ["k", "v", "x", "d", "x_right"]
                assert Counter(map(tuple, got.collect())) == Counter(map(tuple, plain.select(got.columns).collect()))


def test_skew_join_of_two_sides_that_are_as_heavy(spark):
    left = spark.createDataFrame([(i % 2, i) for i in range(60)], "k long, v long")
    right = spark.createDataFrame([(i % 2, i) for i in range(60)] + [(7, 7)], "k long, w long")
    got = skew.skew_join(left, right, "k", rows_per_task=10, broadcast_rows=0)
    assert sorted(map(tuple, got.collect())) == sorted((a % 2, a, b) for a in range(60) for b in range(60) if a % 2 == b % 2)


def test_copies_of_one_row_are_dealt_apart(spark):
    left = spark.range(0, 4000, 1, 8).select(F.lit(1).cast("long").alias("k"), F.create_map(F.lit("a"), F.lit("b")).alias("m"))
    right = spark.createDataFrame([(1, "x")] * 3, "k long, w string")
    got = skew.skew_join(left, right, "k", rows_per_task=500, broadcast_rows=0)
    assert got.count() == 12_000 and skew.heavy_parts(left, "k", 500)[0] == [(1, 4000, 8)]


def test_no_task_of_a_dealt_join_has_many_more_rows_than_wanted(spark):
    """One key holds 1 % of the rows, far below any share, and both sides are too large to broadcast."""
    n = 40_000
    left = spark.range(n).select(F.when(F.col("id") % 100 == 0, -1).otherwise(F.col("id") % 5000).alias("k"), F.col("id").alias("v"))
    right = spark.range(60).select(F.lit(-1).cast("long").alias("k"), F.col("id").alias("w"))
    got = skew.skew_join(left, right, "k", rows_per_task=50, broadcast_rows=0)
    a = got.groupBy(F.pmod(F.xxhash64("k", "v"), F.lit(8))).count().collect()
    assert sum(r["count"] for r in a) == n // 100 * 60
    assert dict((k, t) for k, _, t in skew.heavy_parts(left, "k", 50)[0])[-1] == 8


def test_skew_join_with_two_key_names_and_clashing_columns(spark):
    left = frame(spark, [(1, 1.0, "a"), (2, 2.0, "b")])
    right = spark.createDataFrame([(1, 5.0)], "k long, v double")
    for rows in (1, 1000):
        got = skew.skew_join(left.unionByName(left), right.withColumnRenamed("k", "id"), "k", "id", rows_per_task=rows)
        assert got.columns == ["k", "v", "x", "id", "v_right"]
        assert [tuple(r) for r in got.collect()] == [(1, 1.0, "a", 1, 5.0)] * 2


def test_per_key_stats(spark):
    rows = [(1, 2.0, "a"), (1, 2.0, "a"), (1, None, "b"), (2, None, "b"), (None, 7.0, "c")]
    got = {r["k"]: r.asDict() for r in skew.per_key_stats(frame(spark, rows), "k", "v", 0.5).collect()}
    assert got[1] == {"k": 1, "key_rows": 3, "value_rows": 2, "distinct_values": 1, "value_sum": 4.0, "value_avg": 2.0, "value_min": 2.0, "value_max": 2.0, "is_hot": True}
    assert got[2]["value_rows"] == 0 and got[2]["value_sum"] is None and not got[2]["is_hot"]
    assert got[None]["key_rows"] == 1 and not got[None]["is_hot"]
    assert skew.per_key_stats(frame(spark, []), "k", "v").collect() == []


def test_plan_of_stats_aggregates_before_each_exchange(spark):
    plan = skew.per_key_stats(frame(spark, [(1, 1.0, "a")] * 9).repartition(3), "k", "v")._jdf.queryExecution().executedPlan().toString()
    assert "partial_count" in plan


def test_stats_of_heavy_keys_are_made_apart_and_united(spark):
    rows = [(1, float(i % 3), "a") for i in range(20)] + [(k, 1.0, "b") for k in range(2, 8)] + [(None, 1.0, "c")]
    got = skew.per_key_stats(frame(spark, rows), "k", "v", 0.5)
    assert "Union" in got._jdf.queryExecution().optimizedPlan().toString()
    assert {r["k"]: (r["key_rows"], r["distinct_values"], r["is_hot"]) for r in got.collect()} == {1: (20, 3, True), None: (1, 1, False), **{k: (1, 1, False) for k in range(2, 8)}}
