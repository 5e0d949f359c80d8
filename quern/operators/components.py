"""Connected components of an undirected graph: blocks first, then star contractions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.session import cut_lineage, partitions_for, shuffled

#: Edges that one task contracts on its own before tasks exchange anything.
BLOCK_EDGES = 400_000


def contract(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every node of the edges but the least of its component, and that least node."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = at[: len(a)], at[len(a) :]
    low = np.arange(len(nodes))
    while True:
        left, right = low[a], low[b]
        apart = left != right
        if not apart.any():
            break
        left, right = left[apart], right[apart]
        least = np.minimum(left, right)
        np.minimum.at(low, left, least)
        np.minimum.at(low, right, least)
        while not np.array_equal(low, low[low]):
            low = low[low]
    moved = low != np.arange(len(nodes))
    return nodes[moved], nodes[low[moved]]


def _contract_block(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    parts = [x for x in batches if len(x)]
    if parts:
        edges = pd.concat(parts)
        u, v = contract(edges["u"].to_numpy(np.int64), edges["v"].to_numpy(np.int64))
        yield pd.DataFrame({"u": u, "v": v})


def connected_components(edges: DataFrame, left: str = "src", right: str = "dst", max_rounds: int = 60, block_edges: int = BLOCK_EDGES) -> DataFrame:
    """``node``, ``component`` for every node of ``edges``; the component is its least node.

    Edges are dealt into blocks of about ``block_edges``, each contracted to stars
    in one task. With more than one block, rounds follow that link every node to the least
    neighbour, first for larger neighbours (large star), then for smaller ones
    (small star); their number grows with the logarithm of the diameter. Least
    neighbours are found by partial aggregation, so a hub with very many
    neighbours isn't gathered in one task. Every round is checkpointed. Nulls and
    loops are no edges; repeated edges count once; an empty input gives no rows.
    """
    a, b = F.col(left).cast("long"), F.col(right).cast("long")
    links = cut_lineage(
        edges.where(a.isNotNull() & b.isNotNull() & (a != b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    )
    blocks = partitions_for(links.count(), block_edges)
    links = cut_lineage(links.repartition(blocks).mapInPandas(_contract_block, "u long, v long").distinct())
    before = None
    for _ in range(max_rounds if blocks > 1 else 0):
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        # large star: neighbours above u are linked to the least of u's neighbourhood
        large = both.where(F.col("v") > F.col("u")).join(shuffled(low), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: u and its neighbours below are linked to the least of these
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(shuffled(low), "u")
            .select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u"), F.col("m").alias("v")))).alias("e"))
            .select("e.u", "e.v")
            .where(F.col("u") != F.col("v"))
            .distinct()
        )
        links = cut_lineage(small)
        now = tuple(links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == before:
            break
        before = now
    else:
        if blocks > 1:
            raise RuntimeError("components have not settled; raise max_rounds")
    roots = links.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return links.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
