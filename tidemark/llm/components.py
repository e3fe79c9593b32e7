"""Connected components of a graph given by its edges, without gathering any of them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_size, stable

#: Edges of a partition, and the most that a task holds at once.
PER_TASK, HELD = 100_000, 1_000_000


def forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A star for each component of the edges: (its least node, another)."""
    nodes, ends = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = ends[: len(u)], ends[len(u) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[a], label[b])
        after = label.copy()
        for side in (a, b, label[a], label[b]):
            np.minimum.at(after, side, low)
        after = after[after]
        if (after == label).all():
            break
        label = after
    out = label != np.arange(len(nodes))
    return nodes[label[out]], nodes[out]


def _stars(edges: DataFrame) -> DataFrame:
    """The edges of each partition as stars that join the same nodes."""

    def shrink(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        u, v = [], []
        for b in batches:
            u.append(b["u"].to_numpy(np.int64))
            v.append(b["v"].to_numpy(np.int64))
            if sum(map(len, u)) >= HELD:
                u, v = ([x] for x in forest(np.concatenate(u), np.concatenate(v)))
                if len(u[0]) > HELD // 2:  # hardly fewer: hand them on, so that they aren't gone through again and again
                    yield pd.DataFrame({"u": u[0], "v": v[0]})
                    u, v = [], []
        if u:
            yield pd.DataFrame(dict(zip("uv", forest(np.concatenate(u), np.concatenate(v)), strict=True)))

    return edges.select("u", "v").mapInPandas(shrink, "u long, v long")


def components(edges: DataFrame, per_task: int = PER_TASK) -> DataFrame:
    """(node, component): for each node of (u, v) the least node that it is joined to.

    Every partition, of some per_task edges, first joins what it can on its own, which is all there is to do for a graph
    of one partition. Else two steps follow, and all is repeated until nothing changes: every node hands its larger
    neighbours the least of its neighbours and itself, then its smaller ones. Each of these is a
    minimum, summed up on the map side, and a join on the node; the minima of hubs are handed out instead.
    Nodes without an edge do not appear; empty edges give no rows.
    """
    now = stable(edges.where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct())
    was = None
    # no step adds an edge, and any change puts a smaller u in some edge's place: if both figures repeat, nothing changed
    while (state := now.agg(F.count(F.lit(1)), F.sum(F.col("u").cast("decimal(20,0)"))).first()) != was:
        was = state
        # as few partitions as the edges need: every one is a file for each exchange and step
        k = 1 + state[0] // per_task
        now = stable(_stars(now.coalesce(k)))
        if k == 1 and state[0] < HELD:
            break
        both = now.select("u", "v").union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = stable(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count(F.lit(1)).alias("n")).coalesce(k))
        large = by_size(both.where("v > u"), least, "u", "n", 2 * state[0]).select(F.col("m").alias("u"), "v").where("u <> v").coalesce(k)
        large = stable(large.distinct().coalesce(k))
        # smaller side: v's neighbours below it, all handed the least of them
        low = large.groupBy("v").agg(F.min("u").alias("m"))
        small = large.join(low, "v").select(F.col("m").alias("u"), F.explode(F.array("u", "v")).alias("v")).where("u <> v").coalesce(k).distinct().coalesce(k)
        now = stable(small)
    return now.select(F.col("v").alias("node"), F.col("u").alias("component")).union(now.select(F.col("u"), F.col("u"))).distinct()
