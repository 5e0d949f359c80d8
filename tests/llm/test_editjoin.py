import random

import pytest

from quern.llm import editjoin as E


def osa(a, b):
    d = [[i + j if i * j == 0 else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i][j] = min(d[i][j], d[i - 2][j - 2] + 1)
    return d[-1][-1]


def words(rnd, n, alphabet="abc", longest=9):
    return ["".join(rnd.choice(alphabet) for _ in range(rnd.randrange(longest))) for _ in range(n)]


@pytest.mark.parametrize("k", [0, 1, 2, 3])
def test_distances(k):
    rnd = random.Random(k)
    a, b = words(rnd, 3000), words(rnd, 3000)
    assert E.distances(a, b, k).tolist() == [min(osa(x, y), k + 1) for x, y in zip(a, b)]


def strings(rnd, n):
    out = words(rnd, n, "ab", 8) + words(rnd, n, "abcdefgh", 16)
    for t in words(rnd, n, "abcdefgh", 14):  # neighbours swapped, also across the borders of segments
        out.append(t)
        for at in range(len(t) - 1):
            out.append(t[:at] + t[at + 1] + t[at] + t[at + 2 :])
    return sorted(set(out))


@pytest.mark.parametrize("k, hot", [(1, 40), (2, 40), (2, 3), (2, 0), (3, 2)])
def test_join_against_brute_force(spark, k, hot):
    rnd = random.Random(k + hot)
    left, right = strings(rnd, 25), strings(rnd, 15)
    index = spark.createDataFrame(list(enumerate(left)), "id long, s string")
    probes = spark.createDataFrame([(10_000 + i, t) for i, t in enumerate(right)], "probe_id long, t string")
    got = {(r["id"], r["probe_id"]): r["distance"] for r in E.edit_join(index, probes, k, hot).collect()}
    want = {}
    for i, s in enumerate(left):
        d = E.distances([s] * len(right), right, k)
        want |= {(i, 10_000 + j): int(d[j]) for j in range(len(right)) if d[j] <= k}
    assert got == want


def test_join_with_itself_finds_every_pair_once(spark):
    given = strings(random.Random(9), 20)
    index = spark.createDataFrame(list(enumerate(given)), "id long, s string")
    got = {(r["id"], r["probe_id"]) for r in E.edit_join(index, index.selectExpr("id AS probe_id", "s AS t", "false AS longer"), 2, 5).collect()}
    want = {(i, j) for i, s in enumerate(given) for j, d in enumerate(E.distances([s] * len(given), given, 2)) if d <= 2 and i < j}
    assert {(min(p), max(p)) for p in got} == want


def test_one_long_string_costs_the_others_nothing():
    many = ["abcdef"] * 5000 + ["x" * 20_000]
    assert E.distances(many, ["abcdfe"] * 5000 + ["x" * 19_999], 2).tolist() == [1] * 5001


def test_empty_tables(spark):
    none = spark.createDataFrame([], "id long, s string")
    assert E.edit_join(none, none.toDF("probe_id", "t"), 2).collect() == []
