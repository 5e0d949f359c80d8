import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.llm import percentiles as P

SHARES = [0.0, 0.1, 0.5, 0.9, 1.0]


def frame(spark, rows):
    return spark.createDataFrame(rows, "g string, v double, day int, grp string")


def rows_of(n, seed=1):
    rnd = random.Random(seed)
    return [(rnd.choice(["a", "a", "a", "b", None]), rnd.choice([None, 0.0, -3.5, float(rnd.randrange(50)), rnd.expovariate(0.001)]), rnd.randrange(4), "x") for _ in range(n)]


def want(rows):
    out = {}
    for g in {r[0] for r in rows}:
        v = [r[1] for r in rows if r[0] == g and r[1] is not None]
        if v:
            out[g] = {p: (round(float(np.quantile(v, p)), 6), len(v)) for p in SHARES}
    return out


@pytest.mark.parametrize("per_task", [10, 1000])
def test_exact_from_daily_summaries(spark, per_task):
    rows = rows_of(600)
    daily = P.summarise(frame(spark, rows), "g", "v", F.col("day"))
    got = {}
    for r in P.percentiles(P.combine(daily), SHARES, rows_per_task=per_task).collect():
        got.setdefault(r["grp"], {})[r["percentile"]] = (r["value"], r["group_rows"])
    expected = want(rows)
    assert got.keys() == expected.keys()
    for g in got:
        for p in SHARES:
            assert got[g][p][1] == expected[g][p][1] and got[g][p][0] == pytest.approx(expected[g][p][0], abs=2e-6)


def test_error_bound(spark):
    rows = [r for r in rows_of(500, 2) if r[1] is not None]
    summary = P.summarise(frame(spark, rows), "g", "v", rel_error=0.05)
    got = {(r["grp"], r["percentile"]): r["value"] for r in P.percentiles(summary, [0.0, 1.0]).collect()}
    for g in {r[0] for r in rows}:
        v = [r[1] for r in rows if r[0] == g]
        for p, exact in ((0.0, min(v)), (1.0, max(v))):
            assert abs(got[g, p] - exact) <= 0.05 * abs(exact) + 1e-6
    assert summary.count() < P.summarise(frame(spark, rows), "g", "v").count()


def test_ties_nan_single_and_empty(spark):
    rows = [("a", 1.0, 1, "x")] * 5 + [("b", 2.0, 1, "x"), ("c", None, 1, "x"), ("d", float("nan"), 1, "x")]
    got = {(r["grp"], r["percentile"]): (r["value"], r["group_rows"]) for r in P.percentiles(P.summarise(frame(spark, rows), "g", "v"), [0.25, 0.5]).collect()}
    assert got == {("a", 0.25): (1.0, 5), ("a", 0.5): (1.0, 5), ("b", 0.25): (2.0, 1), ("b", 0.5): (2.0, 1)}
    assert P.percentiles(P.summarise(frame(spark, []), "g", "v"), [0.5]).collect() == []


def test_small_values_keep_their_bound(spark):
    df = frame(spark, [("a", 1e-7, 0, "x"), ("a", 3e-7, 0, "x")])
    got = {r["percentile"]: r["value"] for r in P.percentiles(P.summarise(df, "g", "v", rel_error=0.01), [0.0, 1.0]).collect()}
    assert abs(got[0.0] - 1e-7) <= 1e-9 and abs(got[1.0] - 3e-7) <= 3e-9
