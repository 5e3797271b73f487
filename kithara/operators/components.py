"""Connected components of an edge table, by alternating large-star and small-star steps.

Kiveris et al., "Connected Components in MapReduce and Beyond" (2014). Every round is two
aggregations by node with map-side combine and two joins; nothing is gathered by component, so a
component may hold any share of all nodes. The least neighbours, one row a node, are written before
they are joined: where they are small they are broadcast, and else adaptive execution can split the
partition in which the edges of a hub meet. Each round is written to the shared folder, which also
cuts the lineage; what a round no longer needs is deleted. Once no more than LOCAL_EDGES edges are left, a
bound that does not depend on the input, one task finishes; the roots are the same.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kithara.session import dropped, written

#: Edges that one task may finish.
LOCAL_EDGES = 1 << 14


def _stars(edges: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """One large-star step then one small-star step, and the tables they read; edges are (a, b) with a > b."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m"))
    least = written(least.select("u", F.least("u", "m").alias("m")), "least")
    large = both.filter("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).filter("a > b").distinct()
    large = written(large, "large")
    small = written(large.groupBy("a").agg(F.min("b").alias("m")), "small")
    moved = large.join(small, "a").filter("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(small.select("a", F.col("m").alias("b"))).distinct(), [least, large, small]


def _finished(edges: DataFrame) -> DataFrame:
    """(node, root) of few edges, in one task."""

    def one(p: pd.DataFrame) -> pd.DataFrame:
        names, place = np.unique(p[["a", "b"]].to_numpy(), return_inverse=True)
        parent = list(range(len(names)))

        def find(x: int) -> int:
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        for a, b in place.reshape(-1, 2).tolist():
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
        return pd.DataFrame({"node": names, "root": names[[find(x) for x in range(len(names))]]})

    kind = dict(edges.dtypes)["a"]
    return edges.select(F.lit(0).alias("all"), "a", "b").groupBy("all").applyInPandas(one, f"node {kind}, root {kind}")


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)")).alias("h")).first()
    return row["n"], row["h"]


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", most_rounds: int = 50) -> DataFrame:
    """(node, root) for every node that has an edge to another; root is the component's least node.

    Null ends and loops are no edges; repeated edges count once; an empty table gives an empty result.
    """
    edges = edges.select(F.greatest(src, dst).alias("a"), F.least(src, dst).alias("b")).filter(F.col(src).isNotNull() & F.col(dst).isNotNull() & (F.col("a") > F.col("b")))
    edges = written(edges.distinct(), "edges")
    state = _state(edges)
    for _ in range(most_rounds):
        if state[0] <= LOCAL_EDGES:
            return _finished(edges)
        stars, used = _stars(edges)
        after = written(stars, "stars")
        found = _state(after)
        for table in (edges, *used):
            dropped(table)
        edges, was, state = after, state, found
        if state == was:
            break
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    roots = edges.select(F.col("b").alias("node")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots.select("node", F.col("node").alias("root")))
