"""Connected components of link tables, by alternating star contractions."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm import base


class Forest:
    """Union-find over small integers; the smaller root wins."""

    def __init__(self, n: int):
        self.up = list(range(n))
        self.trees = n

    def find(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        self.trees -= 1
        return True


def spanning(links: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    """A spanning forest of links between any integers, each tree as a star on its least."""
    ids = np.unique(np.array(list(links), dtype=np.int64))
    at = {int(x): i for i, x in enumerate(ids)}
    forest = Forest(len(ids))
    for a, b in links:
        forest.join(at[a], at[b])
    return [(int(ids[i]), int(ids[r])) for i in range(len(ids)) if (r := forest.find(i)) != i]


def components(links: DataFrame) -> DataFrame:
    """links(u, v), longs in any order, repeated or with nulls or self-links (ignored) ->
    (node, component): the least node that links reach from it, for every linked node.

    Large-star and small-star rounds until nothing changes; each is a partial
    aggregation for the least neighbour (so a hub costs one row a task) and a join that
    Spark may split by rows. Each round is written to the shared folder; nothing but the
    two figures that tell the end comes to the driver.
    """
    u, v, m = F.col("u"), F.col("v"), F.col("m")
    links = links.where(u.isNotNull() & v.isNotNull() & (u != v))
    edges = base.written(links.select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v")).distinct(), "links")

    def figures(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    n = base.parts(edges.sparkSession)

    def read(df: DataFrame, rows: int) -> DataFrame:
        """The shuffled rows, in fewer tasks where they are few for as many partitions."""
        tasks = max(2, rows // 16384)
        return df.coalesce(tasks) if tasks < n else df

    before = figures(edges)
    while before[0]:
        both = edges.union(edges.select(v, u)).toDF("u", "v")
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where(v > u).select(v.alias("u"), m.alias("v")).where(u != v)
        large = read(read(large, before[0]).distinct(), before[0])
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where(v != m).select(v.alias("u"), m.alias("v")).union(least.select(u, m))
        new = base.written(read(read(small, before[0]).distinct(), before[0]), "links")
        base.drop(edges)
        edges, after = new, figures(new)
        if after == before:
            break
        before = after
    return edges.select(u.alias("node"), v.alias("component")).union(edges.select(v.alias("node"), v.alias("component")).distinct())
