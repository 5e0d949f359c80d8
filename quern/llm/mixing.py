"""Records of several sources mixed to target shares by Poisson replication.

Every record is repeated a Poisson number of times, drawn by inverting the
distribution at a uniform number hashed from its key and a seed, with the mean
repetition rate that its source needs. That number is hashed once; as more copies come with a higher rate
whatever the numbers are, the rate of a source is then set so that its copies have the wanted size.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: More sources than this are refused, as rates are worked out in the driver from SLOTS sums each.
MAX_SOURCES = 2_000
#: Slots of the uniform numbers for which the sizes of a source are summed.
SLOTS = 256
#: Targets with more repeats than this are refused, as each is a step of a distribution.
MAX_REPEATS = 1_000


def poisson_steps(lam: float, cap: int) -> list[float]:
    """Distribution function of a Poisson number with mean ``lam`` at 0 .. cap - 1: a record of uniform number u has as many copies as steps are at most u."""
    if math.isinf(lam):
        return [0.0] * cap
    if lam <= 0:
        return [1.0] * cap
    log_term, total, out = -lam, 0.0, []  # logarithms, as e^-lam is 0 for a computer from 746 on
    for k in range(cap):
        total += math.exp(log_term)
        out.append(min(total, 1.0))
        log_term += math.log(lam / (k + 1))
    return out


def _solve(reached, wanted: float, high: float) -> float:
    """The least ``lam`` up to ``high`` at which the rising function ``reached`` has ``wanted``."""
    low = 0.0
    for _ in range(60):
        lam = (low + high) / 2
        if reached(lam) < wanted:
            low = lam
        else:
            high = lam
    return (low + high) / 2


def capped_poisson(rate: float, cap: int) -> list[float]:
    """Distribution function of min(Poisson, cap) with mean ``rate``, at 0 .. cap - 1."""
    if rate >= cap:
        return poisson_steps(math.inf, cap)
    # the mean of a count is the sum over k of P(count > k)
    return poisson_steps(_solve(lambda lam: sum(1 - c for c in poisson_steps(lam, cap)), rate, 4.0 * cap + 60.0) if rate > 0 else 0.0, cap)


def calibrated(slots: dict[int, int], rate: float, cap: int) -> list[float]:
    """Steps at which copies of a source have the size that ``rate`` times all of it is.

    ``slots`` has the size of the records by SLOTS-th of their uniform numbers, within which
    size is taken to be spread evenly. The expected steps are those of ``capped_poisson``.
    """
    if rate >= cap or rate <= 0:
        return capped_poisson(rate, cap)
    above = [0.0] * (SLOTS + 1)
    for s in range(SLOTS - 1, -1, -1):
        above[s] = above[s + 1] + slots.get(s, 0)

    def size_above(u: float) -> float:
        at = min(int(u * SLOTS), SLOTS - 1)
        return above[at + 1] + (above[at] - above[at + 1]) * (at + 1 - u * SLOTS)

    lam = _solve(lambda x: sum(size_above(c) for c in poisson_steps(x, cap)), rate * above[0], 4.0 * cap + 60.0)
    return poisson_steps(lam, cap)


def mix_rates(sizes: dict[str, int], targets: dict[str, tuple[float, int]], total: float | None = None) -> dict[str, float]:
    """Mean repetition rate per source.

    Without ``total``, the mix is as large as it can be with every source at its
    share: the first source to use up its repeats bounds it. With ``total``, sources
    that can't give their share are used up to their repeats. Sources without
    records or weight get no rate; shares are of the weights that remain.
    """
    live = {s: (w, m) for s, (w, m) in targets.items() if w and w > 0 and m and m > 0 and sizes.get(s, 0) > 0}
    weight = sum(w for w, _ in live.values())
    if not live:
        return {}
    if total is None:
        total = min(m * sizes[s] / (w / weight) for s, (w, m) in live.items())
    return {s: min(float(m), w / weight * total / sizes[s]) for s, (w, m) in live.items()}


def draw(counted: DataFrame, targets: DataFrame, key: str = "doc_id", source: str = "source", size: str = "tokens", seed: int = 0, total: float | None = None) -> DataFrame:
    """``key``, ``source``, ``copy_no`` (from 1), ``size``, ``mix_order`` of the drawn records.

    ``targets`` has ``source``, ``target_weight`` and ``max_repeats``; sources that
    it doesn't name, a null source and null weights draw nothing. No record comes
    more often than its source's ``max_repeats``, which may be MAX_REPEATS at most:
    more raises an error. Each record has one uniform number, hashed from its key and ``seed``; the
    sizes of each source are summed by slots of it, which says what any rate would draw, and
    the rate that draws the wanted share is taken. The rows are in global random order: by ``mix_order`` within
    partitions that are ranges of it. Same input, same result; repeated keys are
    drawn alike. Empty tables give no rows.
    """
    rows = targets.select("source", "target_weight", "max_repeats").where(F.col("source").isNotNull()).limit(MAX_SOURCES + 1).collect()
    if len(rows) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    if any((r["max_repeats"] or 0) > MAX_REPEATS for r in rows):
        raise ValueError(f"max_repeats above {MAX_REPEATS}")
    wanted = {r["source"]: (r["target_weight"] or 0.0, r["max_repeats"] or 0) for r in rows}
    spark = counted.sparkSession
    uniform = F.shiftrightunsigned(F.xxhash64(F.col(key), F.lit(seed)), 11).cast("double") / F.lit(float(2**53))
    slots: dict[str, dict[int, int]] = {s: {} for s in wanted}
    if wanted:
        by_slot = counted.where(F.col(source).isin(list(wanted))).groupBy(source, F.floor(uniform * SLOTS).alias("__slot")).agg(F.sum(size).alias("__size"))
        for r in by_slot.collect():
            slots[r[0]][r["__slot"]] = int(r["__size"] or 0)
    rates = mix_rates({s: sum(x.values()) for s, x in slots.items()}, wanted, total)
    steps = [(s, calibrated(slots[s], rate, wanted[s][1])) for s, rate in sorted(rates.items())]
    plan = spark.createDataFrame(steps, "__source string, __steps array<double>")  # a row per source: its bound was checked above
    known = counted.join(F.broadcast(plan), F.col(source) == F.col("__source")).withColumn("__u", uniform)
    copies = known.withColumn("__n", F.size(F.filter("__steps", lambda c: c <= F.col("__u")))).where(F.col("__n") > 0)
    copies = copies.withColumn("copy_no", F.explode(F.sequence(F.lit(1), F.col("__n"))))
    out = copies.select(key, source, "copy_no", size, F.xxhash64(F.col(key), F.col("copy_no"), F.lit(seed - 1)).alias("mix_order"))
    return out.repartitionByRange(F.col("mix_order")).sortWithinPartitions("mix_order", key, "copy_no")


def shares(drawn: DataFrame, targets: DataFrame, source: str = "source", size: str = "tokens") -> DataFrame:
    """Target and reached share of each source in ``targets``, with the numbers behind it."""
    got = drawn.groupBy(F.col(source).alias("__s")).agg(
        F.count(F.lit(1)).alias("drawn_rows"), F.max("copy_no").alias("most_repeats"), F.sum(size).alias("drawn_size")
    )
    everything = got.agg(F.sum("drawn_size").alias("all_size"))
    size_of = F.coalesce("drawn_size", F.lit(0).cast("long"))
    return (
        targets.join(F.broadcast(got), F.col("source") == F.col("__s"), "left")
        .join(F.broadcast(everything))
        .select(
            "source",
            "target_weight",
            "max_repeats",
            F.coalesce("drawn_rows", F.lit(0).cast("long")).alias("drawn_rows"),
            F.coalesce("most_repeats", F.lit(0)).alias("most_repeats"),
            size_of.alias("drawn_size"),
            F.round(size_of / F.col("all_size"), 6).alias("reached_share"),
        )
    )
