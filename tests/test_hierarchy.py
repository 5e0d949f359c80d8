import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.operators import hierarchy as H
from quern.operators.components import connected_components

ROWS = [(1, None), (2, 1), (3, 1), (4, 2), (5, 99), (6, 7), (7, 6), (8, 6), (9, 9), (10, 8), (4, 2)]
WANT = {
    1: (1, 0, "1", 3),
    2: (1, 1, "1/2", 1),
    3: (1, 1, "1/3", 0),
    4: (1, 2, "1/2/4", 0),
    5: (5, 0, "5", 0),
    **{k: (-1, -1, "", -1) for k in (6, 7, 8, 9, 10)},
}


def as_dict(df):
    return {r["node"]: (r["root_id"], r["tree_depth"], r["path_ids"], r["descendants"]) for r in df.collect()}


@pytest.mark.parametrize("limit", [1000, 0])  # in one task, and by pointer doubling
def test_small_forest(spark, limit):
    df = spark.createDataFrame([(a, b, "x") for a, b in ROWS], "id long, up long, node string")
    got = H.hierarchy(df, "id", "up", max_component_rows=limit)
    assert as_dict(got) == WANT
    back = [r["node"] for r in got.where("is_back_edge").collect()]
    assert len(back) == 2 and 9 in back and ({6, 7} & set(back))


def test_back_edges_do_not_depend_on_the_way_or_the_order_of_rows(spark):
    rows = [(20, 21), (21, 22), (22, 20), (1, 22), (30, 31), (31, 30), (2, 31), (9, 9)]
    for given in (rows, rows[::-1]):
        walked = H.walk(np.array([r[0] for r in given]), np.array([r[1] for r in given]), np.ones(len(given), bool))
        assert sorted(walked.loc[walked.is_back_edge, "node"]) == [9, 20, 30]
    df = spark.createDataFrame(rows, "id long, up long")
    for limit in (1000, 0):
        got = H.hierarchy(df, "id", "up", max_component_rows=limit).where("is_back_edge").collect()
        assert sorted(r["node"] for r in got) == [9, 20, 30]


def test_empty_and_null_nodes(spark):
    df = spark.createDataFrame([(None, 1)], "id long, up long")
    assert H.hierarchy(df, "id", "up").collect() == []


def brute(rows):
    up = dict(rows)
    out = {}
    for node in up:
        line, seen = [node], {node}
        while up.get(line[-1]) is not None and up[line[-1]] in up:
            nxt = up[line[-1]]
            if nxt in seen:
                line = None
                break
            line.append(nxt)
            seen.add(nxt)
        out[node] = (-1, -1, "") if line is None else (line[-1], len(line) - 1, "/".join(map(str, line[::-1])))
    return out


@pytest.mark.parametrize("limit", [1000, 3])
def test_random_forests(spark, limit):
    rnd = random.Random(5)
    rows = [(i, rnd.choice([None, 500, rnd.randrange(120), max(i - 1, 0)])) for i in range(120)]
    got = {k: v[:3] for k, v in as_dict(H.hierarchy(spark.createDataFrame(rows, "id long, up long"), "id", "up", max_component_rows=limit)).items()}
    assert got == brute(rows)


def test_both_ways_count_the_same_descendants(spark):
    rnd = random.Random(6)
    rows = [(i, rnd.choice([None, rnd.randrange(90), max(i - 1, 0), i // 2])) for i in range(90)]
    df = spark.createDataFrame(rows, "id long, up long")
    walked, doubled = (as_dict(H.hierarchy(df, "id", "up", max_component_rows=n)) for n in (1000, 1))
    assert walked == doubled and max(x[3] for x in walked.values()) > 5


def test_deep_line(spark):
    rows = [(i, i - 1 if i else None) for i in range(300)]
    for limit in (1000, 10):
        tree = H.hierarchy(spark.createDataFrame(rows, "id long, up long"), "id", "up", max_component_rows=limit)
        assert tree.agg(F.max("tree_depth")).first()[0] == 299


def test_descendants(spark):
    tree = H.hierarchy(spark.createDataFrame([(1, None), (2, 1), (3, 2), (6, 7), (7, 6)], "id long, up long"), "id", "up")
    assert sorted(map(tuple, H.descendants(tree).collect())) == [(1, 2, 1), (1, 3, 2), (2, 3, 1)]


def test_walk_without_rows():
    assert len(H.walk(np.array([], np.int64), np.array([], np.int64), np.array([], bool))) == 0


def test_components(spark):
    rnd = random.Random(2)
    edges = [(rnd.randrange(200), rnd.randrange(200)) for _ in range(120)] + [(None, 3), (4, 4), (1000, 1)] + [(500 + i, 501 + i) for i in range(40)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            ra, rb = root(a), root(b)
            parent[max(ra, rb)] = min(ra, rb)
    want = {x: root(x) for x in list(parent)}
    for block in (100_000, 30):  # one block, and rounds over several
        got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "src long, dst long"), block_edges=block).collect()}
        assert got == want
    assert connected_components(spark.createDataFrame([], "src long, dst long")).collect() == []
