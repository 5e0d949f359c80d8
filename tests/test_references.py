from datetime import datetime as D

import pytest

from quern.operators.references import orphan_references, orphan_report

PARENT = "pid long, created_at timestamp_ntz, deleted_at timestamp_ntz, at string"
CHILD = "cid long, ref long, t timestamp_ntz, k string"


def found(spark, children, parents, **more):
    c, p = spark.createDataFrame(children, CHILD), spark.createDataFrame(parents, PARENT)
    out = orphan_references(c, "cid", "ref", "t", p, "pid", "created_at", "deleted_at", **more)
    return sorted((r["child_key"], r["reason"], r["ym"]) for r in out.collect())


PARENTS = [
    (1, D(2023, 1, 1), None, "x"),
    (2, D(2023, 1, 1), D(2023, 3, 1), "x"),
    (2, D(2023, 5, 1), D(2023, 6, 1), "x"),
    (3, D(2024, 1, 1), None, "x"),
    (4, None, D(2023, 2, 1), "x"),
    (None, D(2023, 1, 1), None, "x"),
]


@pytest.mark.parametrize("rows", [1, 1000])  # repeated keys dealt over tasks, no key dealt
def test_reasons(spark, rows):
    children = [
        (1, 1, D(2023, 4, 1), "a"),
        (2, 2, D(2023, 3, 1), "a"),  # the end is excluded
        (3, 2, D(2023, 2, 28), "a"),
        (4, 2, D(2023, 5, 1), "a"),  # the beginning is included
        (5, 2, D(2023, 7, 1), "a"),
        (6, 3, D(2023, 12, 31), "a"),
        (7, 9, D(2023, 4, 1), "a"),
        (8, None, D(2023, 4, 1), "a"),
        (7, 9, D(2023, 4, 1), "b"),  # repeated
        (9, 4, D(2022, 1, 1), "a"),  # began before all time
        (10, 4, D(2023, 2, 1), "a"),
        (11, 9, None, "a"),
        (12, 1, None, "a"),
    ]
    assert found(spark, children, PARENTS, rows_per_task=rows) == [
        (2, "deleted", "2023-03"),
        (5, "deleted", "2023-07"),
        (6, "late", "2023-12"),
        (7, "missing", "2023-04"),
        (10, "deleted", "2023-02"),
        (11, "missing", None),
    ]


def test_many_dealt_keys(spark, monkeypatch):
    from quern.operators import skew

    children = [(i, i % 7, D(2023, 1 + i % 12, 1), "a") for i in range(200)]
    parents = [(k, D(2023, 3, 1), D(2023, 9, 1), "x") for k in range(5)]
    want = found(spark, children, parents)
    assert found(spark, children, parents, rows_per_task=5) == want
    monkeypatch.setattr(skew, "FEW_HEAVY", 2)
    assert found(spark, children, parents, rows_per_task=5) == want


def test_empty_tables(spark):
    assert found(spark, [], PARENTS) == []
    assert found(spark, [(1, 1, D(2023, 1, 1), "a")], []) == [(1, "missing", "2023-01")]


def test_report(spark):
    c = spark.createDataFrame([(i, 9, D(2023, 1 + i % 2, 1), "a") for i in range(6)], CHILD)
    p = spark.createDataFrame([], PARENT)
    out = orphan_references(c, "cid", "ref", "t", p, "pid", "created_at", "deleted_at", ref_field="a.b")
    assert sorted(map(tuple, orphan_report(out).collect())) == [("a.b", "missing", "2023-01", 3), ("a.b", "missing", "2023-02", 3)]


def test_parents_without_lifetimes(spark):
    c = spark.createDataFrame([(1, 1, D(2023, 1, 1), "a"), (2, 2, D(2023, 1, 1), "a")], CHILD)
    p = spark.createDataFrame([(1,)], "pid long")
    assert [r["child_key"] for r in orphan_references(c, "cid", "ref", "t", p, "pid").collect()] == [2]
