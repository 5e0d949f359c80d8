"""Parent-child links to roots, depths, paths, descendants and cycles.

Components are found first; the rows of a component then meet in one task, which
walks each tree depth-first with node colours. A component above
``max_component_rows`` never meets in one task: its paths are built by pointer
doubling over the whole cluster, with the same result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.operators.components import connected_components
from quern.session import cut_lineage, partitions_for, ship_package, shuffled

RESULT = "node long, parent long, root_id long, tree_depth int, path_ids string, descendants long, is_back_edge boolean"
WHITE, GREY, BLACK = 0, 1, 2


def walk(ids: np.ndarray, parents: np.ndarray, has_parent: np.ndarray) -> pd.DataFrame:
    """Depth-first walk over complete components; ``ids`` are distinct.

    A node whose parent is absent from ``ids`` is a root. Nodes that no root
    reaches lie on or below a cycle: root -1, depth -1, empty path. One link per
    cycle, found when following parents from a grey node to a grey one, is its back
    edge: that of its least node. ``descendants`` counts nodes below; on a cycle it is -1.
    """
    n = len(ids)
    order = np.argsort(ids, kind="stable")
    at = np.searchsorted(ids[order], parents).clip(0, max(n - 1, 0))
    known = has_parent & (n > 0)
    if n:
        known &= ids[order][at] == parents
    up = np.where(known, order[at] if n else 0, -1)
    by_parent = np.argsort(up, kind="stable")
    first = np.searchsorted(up[by_parent], np.arange(-1, n + 1))
    children = by_parent
    colour = np.zeros(n, np.int8)
    root, depth, below = np.full(n, -1, np.int64), np.full(n, -1, np.int64), np.full(n, -1, np.int64)
    path: list[str] = [""] * n
    back = np.zeros(n, bool)
    text = ids.astype(str)
    for start in children[first[0] : first[1]]:  # the roots: up is -1
        stack = [int(start)]
        trail: list[str] = []
        while stack:
            node = stack.pop()
            if node < 0:  # leaving: all below are done
                node = ~node
                colour[node] = BLACK
                trail.pop()
                kids = children[first[node + 1] : first[node + 2]]
                below[node] = len(kids) + below[kids].sum()
                continue
            colour[node] = GREY
            trail.append(text[node])
            root[node], depth[node], path[node] = ids[start], len(trail) - 1, "/".join(trail)
            stack.append(~node)
            stack.extend(children[first[node + 1] : first[node + 2]].tolist())
    for start in np.flatnonzero(colour == WHITE):
        node, seen = int(start), []
        while colour[node] == WHITE:
            colour[node] = GREY
            seen.append(node)
            parent = int(up[node])
            if colour[parent] == GREY:  # the cycle is closed: its least node has the back edge
                back[min(seen[seen.index(parent) :], key=ids.__getitem__)] = True
            node = parent
        colour[seen] = BLACK
    return pd.DataFrame(
        {
            "node": ids,
            "parent": pd.array(np.where(has_parent, parents, 0), dtype="Int64"),
            "root_id": root,
            "tree_depth": depth.astype(np.int32),
            "path_ids": path,
            "descendants": below,
            "is_back_edge": back,
        }
    ).assign(parent=lambda d: d.parent.mask(~has_parent))


def _walk_partition(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    parts = [b for b in batches if len(b)]
    if not parts:
        return
    rows = pd.concat(parts, ignore_index=True)
    has = rows["parent"].notna().to_numpy()
    out = walk(rows["node"].to_numpy(np.int64), rows["parent"].fillna(0).to_numpy(np.int64), has)
    step = 4096  # paths can be long: hand them on in small batches
    for at in range(0, len(out), step):
        yield out.iloc[at : at + step]


def _settle(state: DataFrame) -> DataFrame:
    """Double the pointers ``up`` until only lines that never end keep one."""
    open_rows = None
    while True:
        hop = state.select(F.col("node").alias("up"), F.col("up").alias("up2"), F.col("top").alias("top2"), F.col("steps").alias("steps2"), F.col("low").alias("low2"))
        state = cut_lineage(
            state.join(shuffled(hop), "up", "left").select(
                "node",
                "parent",
                F.coalesce("top2", "top").alias("top"),
                F.col("up2").alias("up"),
                (F.col("steps") + F.coalesce("steps2", F.lit(0))).alias("steps"),
                F.least("low", "low2").alias("low"),
            )
        )
        left = state.where(F.col("up").isNotNull()).count()
        # depths have no gaps: a round that ends no line leaves only endless ones
        if left == 0 or left == open_rows:
            return state
        open_rows = left


def _cycle_low(endless: DataFrame) -> DataFrame:
    """``node`` of every cycle's least node, for nodes on or below cycles."""
    state, before = endless.select("node", F.col("parent").alias("up"), F.least("node", "parent").alias("low")), None
    while True:
        hop = state.select(F.col("node").alias("up"), F.col("up").alias("up2"), F.col("low").alias("low2"))
        state = cut_lineage(state.join(shuffled(hop), "up").select("node", F.col("up2").alias("up"), F.least("low", "low2").alias("low")))
        # pointers that reach as many nodes as before are on the cycles; their minima
        # then cover whole cycles once another round changes none
        now = tuple(state.agg(F.countDistinct("up"), F.sum(F.col("low").cast("decimal(38,0)"))).first())
        if now == before:
            break
        before = now
    on_cycle = state.select(F.col("up").alias("node")).distinct()
    return on_cycle.join(shuffled(state.select("node", "low")), "node").where(F.col("node") == F.col("low")).select("node")


def double_pointers(nodes: DataFrame) -> DataFrame:
    """The result of ``walk`` for components of any size, by pointer doubling."""
    known = nodes.select(F.col("node").alias("parent"), F.lit(True).alias("__known"))
    up = F.when(F.col("__known"), F.col("parent"))
    links = cut_lineage(nodes.join(shuffled(known), "parent", "left").select("node", "parent", up.alias("up")))
    steps = F.when(F.col("up").isNull(), 0).otherwise(1).cast("long")
    state = _settle(links.select("node", "parent", "up", F.coalesce("up", "node").alias("top"), steps.alias("steps"), F.least("node", "up").alias("low")))
    ended = state.where(F.col("up").isNull()).select("node", "parent", "top", "steps")
    start = ended.join(shuffled(links.select("node", "up")), "node")
    paths = cut_lineage(start.select("node", "parent", "up", "top", "steps", F.col("node").cast("string").alias("path"), F.lit(1).cast("long").alias("below")))
    while paths.where(F.col("up").isNotNull()).limit(1).count():
        # ``up`` is 2^j links above; ``below`` counts the subtree down to 2^j - 1 links, and so do
        # those of the nodes 2^j links below, whose sum adds the next 2^j levels
        deeper = paths.where(F.col("up").isNotNull()).groupBy("up").agg(F.sum("below").alias("more")).withColumnRenamed("up", "node")
        hop = paths.select(F.col("node").alias("up"), F.col("up").alias("up2"), F.col("path").alias("path2"))
        paths = cut_lineage(
            paths.join(shuffled(hop), "up", "left")
            .join(shuffled(deeper), "node", "left")
            .select(
                "node",
                "parent",
                F.col("up2").alias("up"),
                "top",
                "steps",
                F.concat_ws("/", "path2", "path").alias("path"),
                (F.col("below") + F.coalesce("more", F.lit(0).cast("long"))).alias("below"),
            )
        )
    tree = paths.select(
        "node",
        "parent",
        F.col("top").alias("root_id"),
        F.col("steps").cast("int").alias("tree_depth"),
        F.col("path").alias("path_ids"),
        (F.col("below") - 1).alias("descendants"),
        F.lit(False).alias("is_back_edge"),
    )
    endless = cut_lineage(state.where(F.col("up").isNotNull()).select("node", "parent"))
    closing = _cycle_low(endless).withColumn("__back", F.lit(True))
    loop = endless.join(shuffled(closing), "node", "left").select(
        "node",
        "parent",
        F.lit(-1).cast("long").alias("root_id"),
        F.lit(-1).alias("tree_depth"),
        F.lit("").alias("path_ids"),
        F.lit(-1).cast("long").alias("descendants"),
        F.coalesce("__back", F.lit(False)).alias("is_back_edge"),
    )
    return tree.unionByName(loop)


def hierarchy(df: DataFrame, node: str, parent: str, max_component_rows: int = 200_000, rows_per_task: int = 100_000) -> DataFrame:
    """Root, depth, path, number of descendants and back edges for every node.

    Columns: ``node``, ``parent``, ``root_id``, ``tree_depth``, ``path_ids`` (ids
    from the root down, joined by ``/``), ``descendants``, ``is_back_edge``. A
    root has a null parent or one that is no node; its depth is 0. Nodes whose
    line of parents never reaches a root get root -1, depth -1, an empty path and
    -1 descendants; the link of each cycle's least node is its back edge. Rows with a null
    node are left out; repeated rows give one node, with the least parent if they
    differ. An empty table gives no rows.

    Rows of a component meet in one task unless they are more than
    ``max_component_rows``; such a component is done by pointer doubling.
    """
    ship_package(df.sparkSession)
    nodes = cut_lineage(
        df.select(F.col(node).cast("long").alias("node"), F.col(parent).cast("long").alias("parent"))
        .where(F.col("node").isNotNull())
        .groupBy("node")
        .agg(F.min("parent").alias("parent"))
    )
    ids = nodes.select(F.col("node").alias("parent"))
    found = connected_components(nodes.join(shuffled(ids), "parent", "left_semi"), "node", "parent")
    placed = cut_lineage(nodes.join(shuffled(found), "node", "left").withColumn("component", F.coalesce("component", "node")))
    sizes = placed.groupBy("component").count()
    large = sizes.where(F.col("count") > max_component_rows).select("component")
    rows = placed.count()
    has_large = bool(large.limit(1).count())
    small = placed.join(shuffled(large), "component", "left_anti") if has_large else placed
    tasks = partitions_for(rows, rows_per_task)
    walked = small.repartition(tasks, "component").select("node", "parent").mapInPandas(_walk_partition, RESULT)
    if not has_large:
        return walked
    return walked.unionByName(double_pointers(placed.join(shuffled(large), "component", "left_semi").select("node", "parent")))


def descendants(tree: DataFrame) -> DataFrame:
    """All pairs ``ancestor``, ``node``, ``distance`` (1 or more) of ``hierarchy``'s rows.

    Paths are taken apart in place, without a join; nodes on or below cycles are
    in no pair.
    """
    ids = F.split("path_ids", "/")
    above = tree.where(F.col("tree_depth") > 0).select("node", "tree_depth", F.posexplode(ids).alias("at", "a"))
    return above.where(F.col("at") < F.col("tree_depth")).select(
        F.col("a").cast("long").alias("ancestor"), "node", (F.col("tree_depth") - F.col("at")).alias("distance")
    )
