"""Connected components of a link table, by repeated contraction on Spark."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelcast.llm.common import cut_lineage


def connected_components(edges: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """(node, root) for every node of ``edges`` (two long columns); equal root = same component.

    Each round sends every node to the first node of its neighbourhood in a random order of that
    round (the first round uses the natural order, which suits star-shaped links) and keeps the
    links between different images, so a component of n nodes is gone after O(log n) rounds. The
    maps of all rounds are then composed from the last to the first. Maps and links of a round are
    checkpointed; a hub's links are pre-aggregated, and joins on a hub are left to the skew join.

    Null ends and self-links are ignored; an empty table gives an empty result.
    """
    links = cut_lineage(
        edges.where(F.col(u) != F.col(v)).select(F.least(u, v).alias("u"), F.greatest(u, v).alias("v")).distinct()
    )
    maps: list[DataFrame] = []
    while not links.isEmpty():
        seed = len(maps)

        def rank(c, seed=seed):
            return F.struct((F.xxhash64(c, F.lit(seed)) if seed else c).alias("h"), c.alias("id"))

        ends = links.select("u", "v").union(links.select(F.col("v"), F.col("u")))
        step = ends.groupBy("u").agg(F.min(rank(F.col("v"))).alias("m"))
        step = cut_lineage(step.select(F.col("u").alias("node"), F.least("m", rank(F.col("u")))["id"].alias("to")))
        maps.append(step)
        left = step.select(F.col("node").alias("u"), F.col("to").alias("a"))
        right = step.select(F.col("node").alias("v"), F.col("to").alias("b"))
        moved = links.join(left, "u").join(right, "v").where("a != b")
        links = cut_lineage(moved.select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct())
    if not maps:
        return links.select(F.col("u").alias("node"), F.col("v").alias("root"))
    roots = maps.pop().select("node", F.col("to").alias("root"))
    while maps:
        later = roots.select(F.col("node").alias("to"), F.col("root").alias("later"))
        roots = maps.pop().join(later, "to", "left").select("node", F.coalesce("later", "to").alias("root"))
    return cut_lineage(roots)


class Forest:
    """Disjoint sets over 0..n-1, joined by whole arrays of pairs; the root of a set is its smallest member."""

    def __init__(self, n: int):
        self.parent = np.arange(n, dtype=np.int64)

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            a, b = self.parent[a], self.parent[b]
            keep = a != b
            a, b = a[keep], b[keep]
            np.minimum.at(self.parent, np.maximum(a, b), np.minimum(a, b))
            while True:
                up = self.parent[self.parent]
                if np.array_equal(up, self.parent):
                    break
                self.parent = up

    def links(self) -> tuple[np.ndarray, np.ndarray]:
        """(member, root) of every member that is not its own root."""
        member = np.flatnonzero(self.parent != np.arange(len(self.parent)))
        return member, self.parent[member]
