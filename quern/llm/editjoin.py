"""Strings within a small edit distance, by the pigeonhole principle.

A string is cut into k + 1 segments; if another one is within k edits (insertions,
deletions, substitutions and swaps of neighbours), at least one segment occurs in it,
shifted by k positions at most. An edit is charged to the segment it lies in, a swap
across a border to the segment right of it; so a segment that nothing is charged to is
found as it is, or with its last letter taken from behind the one that follows it, which undoes such a swap.
Segments go into an inverted index (by length, segment number and text), substrings of
the probes look it up, and a banded edit distance verifies.

A segment shared by very many strings isn't joined as it is: the rest of the
strings must be within k as well, so it is cut into k + 1 segments in turn and both
segments together are the key, and so on while a key is still shared by many. No candidate is lost by that.

Keys are numbers: hashes of substrings, taken from prefix hashes of all strings of a
length at once. Equal hashes of different segments only add candidates.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.session import cut_lineage, ship_package, shuffled

#: A key of more index strings than this is refined by one more segment.
HOT_SEGMENT = 40
#: Segments of a key at most; by then little of a string is left over.
MOST_SEGMENTS = 4
#: Rows of keys that a task hands on at once.
BATCH_ROWS = 100_000


def distances(left: Sequence[str], right: Sequence[str], k: int) -> np.ndarray:
    """Edit distances (insert, delete, substitute, swap of neighbours), k + 1 where above k.

    All pairs of about one length advance together through a band of 2k + 1
    diagonals, so that one long string costs the others nothing.
    """
    n = len(left)
    out = np.full(n, k + 1, np.int16)
    la = np.fromiter(map(len, left), np.int64, n)
    lb = np.fromiter(map(len, right), np.int64, n)
    able = np.abs(la - lb) <= k
    wide = np.maximum(la, lb)
    limit = 16
    while able.any():
        at = np.flatnonzero(able & (wide <= limit))
        if len(at):
            out[at] = _band([left[i] for i in at], [right[i] for i in at], la[at], lb[at], k)
            able[at] = False
        limit *= 2
    return out


def _band(left: list[str], right: list[str], la: np.ndarray, lb: np.ndarray, k: int) -> np.ndarray:
    n, far = len(left), k + 1
    out = np.full(n, far, np.int16)
    wide = max(int(la.max()), int(lb.max()), 1)
    a = np.ascontiguousarray(np.array(left, f"U{wide}").view(np.uint32).reshape(n, wide).T)
    b = np.ascontiguousarray(np.array(right, f"U{wide}").view(np.uint32).reshape(n, wide).T)
    # diagonal d holds cell (i, j = i + d - k); two rows back are kept for swaps
    band = 2 * k + 1
    row = np.full((band, n), far, np.int16)
    before = row.copy()
    for d in range(k, band):
        row[d] = d - k
    none = la == 0
    out[none] = np.minimum(lb[none], far)
    for i in range(1, wide + 1):
        new = np.full((band, n), far, np.int16)
        ca = a[i - 1]
        for d in range(band):
            j = i + d - k
            if j < 0 or j > wide:
                continue
            if j == 0:
                new[d] = i
                continue
            cb = b[j - 1]
            cell = row[d] + (ca != cb)
            if d + 1 < band:
                cell = np.minimum(cell, row[d + 1] + 1)
            if d > 0:
                cell = np.minimum(cell, new[d - 1] + 1)
            if i > 1 and j > 1:
                swap = (ca == b[j - 2]) & (a[i - 2] == cb)
                cell = np.where(swap, np.minimum(cell, before[d] + 1), cell)
            new[d] = np.minimum(cell, far)
        before, row = row, new
        ends = np.flatnonzero(la == i)
        if len(ends):
            at = lb[ends] - i + k
            fits = (at >= 0) & (at < band)
            out[ends[fits]] = row[at[fits], ends[fits]]
    return np.minimum(out, far)


def cuts(length: int, k: int) -> list[tuple[int, int]]:
    """Start and end of the k + 1 segments of a string, as even as can be."""
    base, more = divmod(length, k + 1)
    out, at = [], 0
    for i in range(k + 1):
        end = at + base + (i >= k + 1 - more)
        out.append((at, end))
        at = end
    return out


def windows(length: int, k: int, longer: bool = True) -> Iterator[tuple[int, int, int, int, bool]]:
    """Where a probe looks: length of the index string, segment, start, size, and whether its last letter is taken from one further on."""
    for other in range(max(length - k, 0), length + (k if longer else 0) + 1):
        gap = length - other
        for i, (a, b) in enumerate(cuts(other, k)):
            size = b - a
            for at in range(max(0, a - k), min(length - size, a + k) + 1):
                # what lies left of the segment and what lies right of it differ by so many letters
                shift = abs(at - a) + abs(gap - (at - a))
                if shift <= k:
                    yield other, i, at, size, False
                if shift < k and i < k and size and at + size < length:
                    yield other, i, at, size, True


_BASE = np.uint64(0x100000001B3)


def _mix(h: np.ndarray, length: int, segment: int, key: np.ndarray | None) -> np.ndarray:
    """Hash of a segment, its place and the key it refines, well spread over 64 bits."""
    x = h ^ np.uint64((length * 64 + segment + 1) * 0x9E3779B97F4A7C15 & (2**64 - 1))
    if key is not None:
        x = x + key.view(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB), (31, None)):
        x = x ^ (x >> np.uint64(shift))
        if factor:
            x = x * np.uint64(factor)
    return x.view(np.int64)


class _Prefixes:
    """Prefix hashes of strings of one length."""

    def __init__(self, strings: list[str], length: int):
        n = len(strings)
        self.codes = np.ascontiguousarray(np.array(strings, f"U{length}").view(np.uint32).reshape(n, length).T) if length else np.zeros((0, n), np.uint32)
        self.hashes = np.zeros((length + 1, n), np.uint64)
        self.powers = [np.uint64(1)]
        for i in range(length):
            self.hashes[i + 1] = self.hashes[i] * _BASE + (self.codes[i] + np.uint64(1))
            self.powers.append(self.powers[-1] * _BASE)

    def part(self, a: int, b: int) -> np.ndarray:
        return self.hashes[b] - self.hashes[a] * self.powers[b - a]

    def swapped(self, at: int, size: int) -> np.ndarray:
        """The part with its last letter replaced by the one after it."""
        return self.part(at, at + size - 1) * _BASE + (self.codes[at + size] + np.uint64(1))


def letters(strings: Sequence[str]) -> np.ndarray:
    """Which letters a string has, as bits: an edit changes two at most."""
    out = np.zeros(len(strings), np.int64)
    for row, s in enumerate(strings):
        bits = 0
        for c in set(s):
            bits |= 1 << (ord(c) * 7 & 63)
        out[row] = bits - (1 << 64) if bits >> 63 else bits
    return out


def keys_of(strings: Sequence[str], k: int, probe: bool, longer: np.ndarray | None = None, old: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Blocks of keys: row, key, start of the segment, and its size (negative if its last letter is from one further on)."""
    sizes = np.fromiter(map(len, strings), np.int64, len(strings))
    groups = sizes * 2 + (np.asarray(longer, bool) if longer is not None else 1)
    with np.errstate(over="ignore"):
        for group in np.unique(groups):
            rows = np.flatnonzero(groups == group)
            length = int(group) // 2
            most = max(1, BATCH_ROWS // (length + 1))
            for at in range(0, len(rows), most):
                own = rows[at : at + most]
                found = _Prefixes([strings[i] for i in own], length)
                salt = None if old is None else old[own]
                if not probe:
                    for i, (a, b) in enumerate(cuts(length, k)):
                        yield own, _mix(found.part(a, b), length, i, salt), np.full(len(own), a), np.full(len(own), b - a)
                    continue
                for other, i, start, size, swap in windows(length, k, bool(group % 2)):
                    if not swap:
                        yield own, _mix(found.part(start, start + size), other, i, salt), np.full(len(own), start), np.full(len(own), size)
                        continue
                    real = np.flatnonzero(found.codes[start + size - 1] != found.codes[start + size])
                    if len(real):
                        key = _mix(found.swapped(start, size)[real], other, i, None if salt is None else salt[real])
                        yield own[real], key, np.full(len(real), start), np.full(len(real), -size)


def rest_of(s: str, start: int, size: int) -> str:
    """What is left of a string without the segment at ``start``."""
    if size < 0:  # its last letter stood one further on
        return s[: start] + s[start - size - 1] + s[start - size + 1 :]
    return s[:start] + s[start + size :]


def _keyed(k: int, probe: bool, first: bool):
    """Explode rows ``id, s, rest, letters`` by the keys of ``rest``; a probe's may be of longer strings, too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            ids, texts = batch.column("id"), batch.column("s")
            if first:
                rests, bits = texts.to_pylist(), pa.array(letters(texts.to_pylist()))
                longer, old = batch.column("longer").to_numpy(zero_copy_only=False), None
            else:
                bits, longer = batch.column("letters"), None
                at, size = batch.column("start").to_numpy(), batch.column("size").to_numpy()
                rests = [rest_of(s, a, n) for s, a, n in zip(batch.column("rest").to_pylist(), at.tolist(), size.tolist())]
                old = batch.column("key").to_numpy()
            own = pa.array(rests, pa.string())
            waiting, rows = [], 0

            def flush() -> pa.RecordBatch:
                row, key, start, size = (np.concatenate([x[c] for x in waiting]) for c in range(4))
                if probe:  # a key that a row has twice is looked up once
                    once = _first_of(row, key)
                    row, key, start, size = row[once], key[once], start[once], size[once]
                take = pa.array(row)
                columns = [ids.take(take), texts.take(take), own.take(take), bits.take(take), pa.array(key), pa.array(start, pa.int32()), pa.array(size, pa.int32())]
                return pa.RecordBatch.from_arrays(columns, names=["id", "s", "rest", "letters", "key", "start", "size"])

            for block in keys_of(rests, k, probe, longer if probe else None, old):
                waiting.append(block)
                rows += len(block[0])
                if rows >= BATCH_ROWS:
                    yield flush()
                    waiting, rows = [], 0
            if rows:
                yield flush()

    return run


def _first_of(row: np.ndarray, key: np.ndarray) -> np.ndarray:
    """One place of every (row, key)."""
    order = np.lexsort((key, row))
    r, c = row[order], key[order]
    new = np.ones(len(order), bool)
    new[1:] = (r[1:] != r[:-1]) | (c[1:] != c[:-1])
    return order[new]


_KEYED = "id long, s string, rest string, letters long, key long, start int, size int"


def edit_join(index: DataFrame, probes: DataFrame, k: int, hot: int = HOT_SEGMENT) -> DataFrame:
    """Pairs ``id``, ``probe_id``, ``distance`` of strings within ``k`` edits, a swap of neighbours counted as one.

    ``index`` has distinct ``id`` (long) and ``s``, ``probes`` have ``probe_id``
    (long) and ``t``; both are non-null. Probes may have a boolean ``longer``: where it is false,
    only index strings up to the probe's length are looked for, which finds every pair once if both sides
    are the same strings. A pair with equal ids isn't reported. Strings
    shorter than k + 1 have empty segments and are compared with all others that
    short, which is a bounded set of texts if the strings are distinct. Empty tables give no rows.
    """
    ship_package(index.sparkSession)
    longer = F.col("longer") if "longer" in probes.columns else F.lit(True)
    entries = index.select("id", "s", F.lit(True).alias("longer")).mapInArrow(_keyed(k, False, True), _KEYED)
    sought = probes.select(F.col("probe_id").alias("id"), F.col("t").alias("s"), longer.alias("longer")).mapInArrow(_keyed(k, True, True), _KEYED)
    found = []
    for depth in range(1, MOST_SEGMENTS + 1):
        entries = cut_lineage(entries)
        counts = entries.groupBy("key").agg(F.count(F.lit(1)).alias("entries"))
        sought = cut_lineage(sought.join(shuffled(counts), "key"))
        last = depth == MOST_SEGMENTS
        ready = sought if last else sought.where(F.col("entries") <= hot)
        looked = ready.select("key", F.col("id").alias("probe_id"), F.col("s").alias("t"), F.col("letters").alias("t_letters"))
        near = F.bit_count(F.col("letters").bitwiseXOR(F.col("t_letters"))) <= 2 * k
        met = looked.join(shuffled(entries.select("key", "id", "s", "letters")), "key").where(near & (F.col("id") != F.col("probe_id")))
        found.append(met.select("id", "s", "probe_id", "t"))
        crowded = sought.where(F.col("entries") > hot)
        if last or not crowded.limit(1).count():
            break
        hot_keys = counts.where(F.col("entries") > hot).select("key")
        entries = entries.join(shuffled(hot_keys), "key", "left_semi").mapInArrow(_keyed(k, False, False), _KEYED)
        sought = crowded.select("id", "s", "rest", "letters", "key", "start", "size").mapInArrow(_keyed(k, True, False), _KEYED)

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            d = distances(batch["s"].tolist(), batch["t"].tolist(), k)
            yield pd.DataFrame({"id": batch["id"], "probe_id": batch["probe_id"], "distance": d.astype(np.int32)})[d <= k]

    pairs = found[0]
    for more in found[1:]:
        pairs = pairs.unionByName(more)
    # verified where they meet: only the few that hold are exchanged
    return pairs.mapInPandas(verify, "id long, probe_id long, distance int").groupBy("id", "probe_id").agg(F.min("distance").alias("distance"))
