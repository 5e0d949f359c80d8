"""Items of varying size packed into containers of permitted capacities.

Variable-capacity best fit: items go, largest first, into the open container
with the least room that holds them. Where none does, a container is opened with the permitted
capacity that is expected to waste least for what it will hold, which is foreseen by filling it with the
items that are left. In the end every container is downsized to the least capacity that holds its
contents. Items are dealt out at random to shards of bounded size, which are packed
each in one task; a shard leaves at most a few containers that aren't full.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from itertools import accumulate
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.session import partitions_for, ship_package


#: Items that are foreseen for a container to be opened; beyond that, small ones are taken to fill it.
FORESEEN = 64


def foreseen_waste(room: int, ascending: list[int], sums: list[int], left: int, fitted: Sequence[int], used: int) -> tuple[int, int]:
    """Unused room and contents of a container of ``used + room``, filled with the largest of the ``left`` least items that fit, and downsized."""
    for _ in range(FORESEEN):
        if not left or room < ascending[0]:
            break
        if sums[left - 1] <= room:  # all that is left fits
            used, room = used + sums[left - 1], room - sums[left - 1]
            break
        left = bisect_right(ascending, room, 0, left) - 1
        used, room = used + ascending[left], room - ascending[left]
    else:
        used, room = used + room, 0
    return fitted[bisect_left(fitted, used)] - used, used


def _pack(sizes: list[int], order: list[int], openable: Sequence[int], fitted: Sequence[int]) -> tuple[list[int], list[int], list[int]]:
    """Container and offset of every item, and what each container holds. ``openable`` are the capacities to open, ``fitted`` those to downsize to."""
    ascending = [sizes[i] for i in reversed(order)]
    sums = list(accumulate(ascending))
    used: list[int] = []
    rooms: list[int] = []  # rooms of open containers, each once, in order
    by_room: dict[int, list[int]] = {}
    box, offset = [0] * len(sizes), [0] * len(sizes)
    left = len(order)
    for i in order:
        size = sizes[i]
        left -= 1
        at = bisect_left(rooms, size)
        if at < len(rooms):
            room = rooms[at]
            b = by_room[room].pop()
            if not by_room[room]:
                del by_room[room], rooms[at]
        else:
            room = openable[-1]
            if len(openable) > 1:
                best = None
                for cap in openable[bisect_left(openable, size) :]:
                    waste, held = foreseen_waste(cap - size, ascending, sums, left, fitted, size)
                    # least waste for each unit held; of equal ones the largest
                    if best is None or waste * best[1] <= best[0] * held:
                        best, room = (waste, max(held, 1)), cap
            b = len(used)
            used.append(0)
        box[i], offset[i] = b, used[b]
        used[b] += size
        room -= size
        if room in by_room:
            by_room[room].append(b)
        else:
            by_room[room] = [b]
            insort(rooms, room)
    return box, offset, used


def best_fit(sizes: np.ndarray, capacities: Sequence[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Container and offset of every item, capacity of every container.

    Sizes are at most the largest capacity. Capacities are chosen jointly, at each
    opening by the least foreseen waste; the same items are also packed with each
    capacity alone that holds them all, and the packing with the least total capacity is
    taken (of equal ones that with the fewest containers), so that several capacities never waste more than one of them. Items of size 0 join a container that is there.
    """
    caps = sorted({int(c) for c in capacities})
    order = np.argsort(-sizes, kind="stable").tolist()
    items = sizes.tolist()
    most = max(items, default=0)
    best = None
    for openable in [caps, *([c] for c in caps if c >= most and len(caps) > 1)]:
        box, offset, used = _pack(items, order, openable, caps)
        fitted = [caps[bisect_left(caps, max(u, 1))] for u in used]
        cost = (sum(fitted), len(fitted))
        if best is None or cost < best[0]:
            best = (cost, box, offset, fitted)
    return tuple(np.array(x, np.int64) for x in best[1:])


def pieces(df: DataFrame, key: str, size: str, capacity: int) -> DataFrame:
    """Items no larger than ``capacity``: ``item``, ``piece_no``, ``piece_start``, ``piece_size``.

    Only an item that alone is larger is cut, into full containers and a rest.
    """
    n = F.col(size)
    full = F.greatest(F.ceil(n / F.lit(capacity)).cast("int"), F.lit(1))
    cut = df.select(F.col(key).alias("item"), n.alias("whole"), F.explode(F.sequence(F.lit(0), full - 1)).alias("piece_no"))
    start = F.col("piece_no").cast("long") * F.lit(capacity)
    return cut.select("item", "piece_no", start.alias("piece_start"), F.least(F.col("whole") - start, F.lit(capacity).cast("long")).alias("piece_size"))


def pack(df: DataFrame, key: str, size: str, capacities: Sequence[int], items_per_shard: int = 20_000, rows: int | None = None) -> DataFrame:
    """Container and position of every item of ``df`` (columns ``key`` and ``size``).

    Columns: ``container_id``, ``capacity`` (of the container, after downsizing),
    ``item``, ``piece_no``, ``position`` (offset in the container), ``piece_start``
    and ``piece_size`` (the part of the item, in size units). Every item is placed
    exactly once, whole unless it is larger than the largest capacity. Items of
    size 0 or null size 0 are placed, too. Repeated rows are separate items. An
    empty table has no rows. ``rows`` spares a count if it is known.
    """
    if not capacities or min(capacities) < 1:
        raise ValueError("capacities must be positive")
    ship_package(df.sparkSession)
    largest = max(capacities)
    items = pieces(df.select(key, F.coalesce(F.col(size).cast("long"), F.lit(0).cast("long")).alias(size)), key, size, largest)
    shards = partitions_for(df.count() if rows is None else rows, items_per_shard)
    kind = dict(items.dtypes)["item"]
    schema = f"container_id string, capacity long, item {kind}, piece_no int, position long, piece_start long, piece_size long"
    caps = tuple(capacities)

    def fill(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = [b for b in batches if len(b)]
        if not parts:
            return
        got = pd.concat(parts, ignore_index=True)
        for shard, own in got.groupby("shard", sort=True):
            box, offset, fitted = best_fit(own["piece_size"].to_numpy(np.int64), caps)
            own = own.assign(container_id=[f"{shard}-{b}" for b in box], capacity=fitted[box], position=offset)
            yield own.iloc[np.lexsort((offset, box))][["container_id", "capacity", "item", "piece_no", "position", "piece_start", "piece_size"]]

    # the piece number spreads the parts of one very large item over shards
    shard = F.pmod(F.xxhash64("item", "piece_no", F.lit(17)), F.lit(shards)).cast("int")
    return items.withColumn("shard", shard).repartition(shards, "shard").mapInPandas(fill, schema)
