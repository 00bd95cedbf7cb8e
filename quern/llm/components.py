"""Connected components of a graph of links, by alternating stars over DataFrames."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.storage import materialise, release


def local_roots(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """For nodes 0..n-1 linked pairwise, each node's smallest reachable node: minimum labels with pointer jumping."""
    root = np.arange(n, dtype=np.int64)
    while len(left):
        low = np.minimum(root[left], root[right])
        np.minimum.at(root, root[left], low)
        np.minimum.at(root, root[right], low)
        while True:
            up = root[root]
            if np.array_equal(up, root):
                break
            root = up
        open_ = root[left] != root[right]
        left, right = left[open_], right[open_]
    return root


def _state(df: DataFrame) -> tuple:
    return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def connected_components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component): component is the smallest node reachable over the links of columns a and b.

    Large-star and small-star rounds run until the edge set stays as it is. A node's neighbours are never gathered: each
    round is a partial minimum for every node and a join of the edges with those minima; minima are written first, so that
    adaptive execution can split a hot node's edges; the tables of a round go when the next is written. Null ends and self links are ignored; nodes without links are absent.
    """
    e = materialise(
        edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(f"{a} is not null and {b} is not null and u <> v").distinct(),
        "links",
    )
    state = _state(e)
    while state[0]:
        both = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = materialise(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")), "large", rows=state[0])
        star = materialise(both.join(large, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct(), "star", rows=state[0])
        small = materialise(star.groupBy("u").agg(F.min("v").alias("m")), "small", rows=state[0])
        joined = star.join(small, "u")
        links = materialise(
            joined.select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x"))
            .select("x.u", "x.v")
            .where("u <> v")
            .distinct(),
            "links",
            rows=state[0],
        )
        for done in (e, large, star, small):
            release(done)
        e = links
        before, state = state, _state(e)
        if state == before:
            break
    nodes = e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
