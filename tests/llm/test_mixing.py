from collections import Counter

import pytest

from quern.llm import mixing as M


def test_capped_poisson_has_the_wanted_mean():
    for cap in (1, 2, 8, 1000):
        for rate in (0.0, 0.3, 0.9 * cap, float(cap)):
            cdf = M.capped_poisson(rate, cap)
            assert len(cdf) == cap and cdf == sorted(cdf)
            assert sum(1 - c for c in cdf) == pytest.approx(min(rate, cap), abs=1e-6)


def test_rates():
    rates = M.mix_rates({"a": 100, "b": 1000}, {"a": (0.5, 2), "b": (0.5, 4), "c": (1.0, 1)})
    assert rates == {"a": 2.0, "b": pytest.approx(0.2)}
    assert M.mix_rates({}, {"a": (1.0, 1)}) == {}


def inputs(spark):
    rows = [(i, "a" if i % 10 == 0 else "b", 10 + i % 7, "z") for i in range(4000)] + [(9000, "x", 5, "z"), (9001, None, 5, "z")]
    targets = [("a", 0.4, 3), ("b", 0.6, 1), ("empty", 0.2, 2), ("null", None, 1)]
    return (
        spark.createDataFrame(rows, "doc_id long, source string, tokens long, copy_no string"),
        spark.createDataFrame(targets, "source string, target_weight double, max_repeats int"),
    )


def test_shares_and_repeats(spark):
    docs, targets = inputs(spark)
    drawn = M.draw(docs, targets)
    rows = drawn.collect()
    assert {r["source"] for r in rows} == {"a", "b"}
    most = Counter(r["doc_id"] for r in rows)
    assert all(n <= (3 if d % 10 == 0 else 1) for d, n in most.items())
    assert sorted({r["copy_no"] for r in rows}) == [1, 2, 3]
    share = {r["source"]: r["reached_share"] for r in M.shares(drawn, targets).collect()}
    assert share["a"] == pytest.approx(0.4, abs=0.01) and share["b"] == pytest.approx(0.6, abs=0.01)
    assert share["empty"] == 0.0 and set(share) == {"a", "b", "empty", "null"}
    assert rows == M.draw(docs, targets).collect()  # the same again
    orders = [r["mix_order"] for r in rows]
    assert orders == sorted(orders)


def test_more_repeats_than_can_be_drawn_are_refused(spark):
    docs, _ = inputs(spark)
    targets = spark.createDataFrame([("a", 0.4, M.MAX_REPEATS + 1), ("b", 0.6, 1)], "source string, target_weight double, max_repeats int")
    with pytest.raises(ValueError):
        M.draw(docs, targets)


def test_many_repeats_are_drawn_in_full(spark):
    docs = spark.createDataFrame([(i, "a", 10) for i in range(40)] + [(1000 + i, "b", 10) for i in range(6000)], "doc_id long, source string, tokens long")
    targets = spark.createDataFrame([("a", 0.5, 200), ("b", 0.5, 1)], "source string, target_weight double, max_repeats int")
    drawn = M.draw(docs, targets)
    counts = Counter(r["doc_id"] for r in drawn.where("source = 'a'").collect())
    assert sum(counts.values()) == pytest.approx(6000, abs=120) and max(counts.values()) <= 200 and min(counts.values()) > 100


def test_the_rate_follows_the_numbers_that_were_hashed():
    """Copies at the steps have the wanted size, whatever the sizes in the slots."""
    slots = {s: (50 if s % 3 else 900) for s in range(M.SLOTS)}
    whole = sum(slots.values())
    for rate, cap in ((0.2, 1), (0.7, 2), (2.5, 8)):
        steps = M.calibrated(slots, rate, cap)
        got = sum(n * sum(max(0.0, min(1.0, (s + 1) - c * M.SLOTS)) for c in steps) for s, n in slots.items())
        assert got == pytest.approx(rate * whole, rel=1e-6)
    assert M.calibrated(slots, 3.0, 3) == [0.0] * 3 and M.calibrated({}, 0.0, 2) == [1.0] * 2


def test_more_pack_limits_than_can_be_read_are_refused(spark, tmp_path):
    from quern.llm import plans

    spark.range(1001).selectExpr("cast(id AS string) AS limit_name", "id + 1 AS capacity_tokens").write.parquet(f"{tmp_path}/pack_limits.parquet")
    spark.createDataFrame([(1, "a", "x y")], "doc_id long, source string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    for query in (plans.p8_containers, plans.p8_mixed_capacities):
        with pytest.raises(ValueError):
            query(spark, str(tmp_path))


def test_empty(spark):
    docs, targets = inputs(spark)
    assert M.draw(docs.where("false"), targets).collect() == []
    assert M.draw(docs, targets.where("false")).collect() == []
