import random
from collections import defaultdict

import numpy as np
import pytest

from quern.llm import packing as P


def packed(spark, sizes, caps, shard=1000):
    df = spark.createDataFrame([(i, n, "z") for i, n in enumerate(sizes)], "id long, n long, item string")
    return P.pack(df, "id", "n", caps, items_per_shard=shard).collect()


@pytest.mark.parametrize("caps, shard", [([100], 1000), ([100], 50), ([50, 100, 400], 1000)])
def test_every_item_once_and_no_container_too_full(spark, caps, shard):
    rnd = random.Random(7)
    sizes = [rnd.choice([0, 1, rnd.randrange(100), rnd.randrange(1000), max(caps), max(caps) + 1]) for _ in range(400)]
    rows = packed(spark, sizes, caps, shard)
    boxes, items = defaultdict(list), defaultdict(list)
    for r in rows:
        boxes[r["container_id"], r["capacity"]].append((r["position"], r["piece_size"]))
        items[r["item"]].append((r["piece_no"], r["piece_start"], r["piece_size"]))
    for (_, cap), parts in boxes.items():
        parts.sort()
        assert cap in caps and sum(n for _, n in parts) <= cap
        at = 0
        for position, n in parts:
            assert position == at
            at += n
    for i, n in enumerate(sizes):
        parts = sorted(items[i])
        assert sum(p[2] for p in parts) == n and len(parts) == max(1, -(-n // max(caps)))
    assert len({c for c, _ in boxes}) == len(boxes)


def test_little_room_is_left(spark):
    rnd = random.Random(1)
    sizes = [rnd.randrange(1, 300) for _ in range(3000)]
    rows = packed(spark, sizes, [512], 5000)
    used = len({r["container_id"] for r in rows})
    assert used <= 1.005 * sum(sizes) / 512 + 1


def test_joint_capacities_beat_the_largest_alone(spark):
    sizes = [60] * 7
    rows = packed(spark, sizes, [64, 256])
    total = sum({r["container_id"]: r["capacity"] for r in rows}.values())
    assert total == 7 * 64  # 4 + 3 items in two of 256 would waste more
    one = packed(spark, [60], [64, 256])
    assert one[0]["capacity"] == 64


def total(sizes, caps):
    return int(P.best_fit(np.array(sizes), caps)[2].sum())


def test_a_capacity_that_the_items_fill_is_opened():
    box, _, fitted = P.best_fit(np.array([550] * 1000), [1100, 2000])
    assert set(fitted) == {1100} and len(fitted) == 500


def test_several_capacities_never_waste_more_than_one_of_them():
    rnd = random.Random(4)
    for _ in range(60):
        caps = sorted(rnd.sample(range(40, 2000), 3))
        sizes = [rnd.randrange(1, rnd.choice([caps[0], caps[1], caps[2]])) for _ in range(rnd.choice([1, 5, 200]))]
        alone = [total(sizes, [c]) for c in caps if c >= max(sizes)]
        assert total(sizes, caps) <= min(alone)
        assert total(sizes, caps) >= sum(sizes)


def test_capacities_are_chosen_jointly():
    """No single capacity does: pairs of 500 fill 1000, and 1300 stands alone in 1400."""
    sizes = [1300] * 10 + [500] * 40
    assert total(sizes, [1000, 1400]) == 10 * 1400 + 20 * 1000 < total(sizes, [1400])


def test_very_large_capacity_takes_no_room_of_its_own():
    box, offset, fitted = P.best_fit(np.array([10**12, 5, 0]), [10**13])
    assert len(fitted) == 1 and sorted(offset.tolist()) == [0, 10**12, 10**12 + 5]


def test_empty_null_and_repeated(spark):
    assert packed(spark, [], [10]) == []
    rows = packed(spark, [None, 3], [10])
    assert sorted(r["piece_size"] for r in rows) == [0, 3]
    df = spark.createDataFrame([(1, 4), (1, 4)], "id long, n long")
    assert P.pack(df, "id", "n", [10]).count() == 2
    with pytest.raises(ValueError):
        P.pack(df, "id", "n", [])
