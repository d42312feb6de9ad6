"""Connected components of a graph given as an edge table, by repeated hooking and contraction; nothing is collected."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, stored

#: Edges of a contracted graph that one task joins at the end, instead of rounds of shuffles over ever fewer edges.
LAST = 1 << 16


def smallest_roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest index in the component of each of ``n`` indices."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        while True:
            up = new[new]
            if (up == new).all():
                break
            new = up
        if (new == root).all():
            return root
        root = new


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All edges (u, v) of a task -> (n, to): nodes that they connect have the same ``to``."""
    edges = pa.Table.from_batches(batches)
    u, v = (c.to_numpy() for c in edges.columns)
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    to = nodes[smallest_roots(len(nodes), at[: len(u)], at[len(u) :])]
    yield pa.RecordBatch.from_arrays([pa.array(x, edges.schema.field(0).type) for x in (nodes, to)], names=["n", "to"])


def connected_components(edges: DataFrame, last: int = LAST) -> DataFrame:
    """(u, v) -> (node, root): nodes with equal root are connected. Nodes without edges do not appear.

    In each round every node hooks to the first of itself and its neighbours, in the order of the ids at first and then in
    the order of a hash salted by the round, and the graph is contracted to the hooks' targets. Stars vanish in one
    round, long chains shrink by a constant factor in expectation. A hub's edges are combined before the shuffle. When a
    contracted graph has ``last`` edges or fewer, whatever the input's size, one task connects what is left.
    """
    e = stored(edges.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).where(F.col("u") != F.col("v")).distinct())
    where_to = None
    turn, left = 0, e.count()
    while left:
        if turn and left <= last:
            one = e.coalesce(1)
            hooks, left = stored(map_batches(one, _joined, one.select(F.col("u").alias("n"), F.col("v").alias("to")).schema)), 0
        else:
            rank = (lambda c: c) if turn == 0 else (lambda c, t=turn: F.xxhash64(c, F.lit(t)))
            both = e.select("u", "v").union(e.select(F.col("v"), F.col("u")))
            hooks = both.groupBy(F.col("u").alias("n")).agg(F.min(F.struct(rank(F.col("v")).alias("r"), F.col("v").alias("to"))).alias("m"))
            own = F.struct(rank(F.col("n")).alias("r"), F.col("n").alias("to"))
            hooks = stored(hooks.select("n", F.least("m", own)["to"].alias("to")))
            a, b = hooks.select(F.col("n").alias("u"), F.col("to").alias("pu")), hooks.select(F.col("n").alias("v"), F.col("to").alias("pv"))
            moved = e.join(a, "u").join(b, "v").where(F.col("pu") != F.col("pv"))
            e = stored(moved.select(F.least("pu", "pv").alias("u"), F.greatest("pu", "pv").alias("v")).distinct())
            left = e.count()
        if where_to is None:
            where_to = hooks.select(F.col("n").alias("node"), F.col("to").alias("root"))
        else:
            step = hooks.select(F.col("n").alias("root"), F.col("to").alias("next"))
            where_to = stored(where_to.join(step, "root", "left").select("node", F.coalesce("next", "root").alias("root")))
        turn += 1
    if where_to is None:
        return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return where_to
