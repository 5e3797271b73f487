"""Minimum spanning forests of an edge table, by Borůvka's rounds.

In each round every component takes its least edge (ties by the edges' ends, so no cycles arise), the
components that these edges join become one by pointer jumping, and edges inside a component go. Components
at least halve, so rounds are few; each is joins and sums with map-side combine. Once no more than
LOCAL_EDGES edges are left one task finishes; that bound is documented, and the forest is the same.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kithara.session import written

#: Edges that one task may finish.
LOCAL_EDGES = 1_000_000


def kruskal(a: np.ndarray, b: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Which edges are in the forest, taken in the given order."""
    names, place = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = place[: len(a)].tolist(), place[len(a) :].tolist()
    parent, kept = list(range(len(names))), []
    for e in order.tolist():
        u, v = x[e], y[e]
        while parent[u] != u:
            parent[u] = parent[parent[u]]
            u = parent[u]
        while parent[v] != v:
            parent[v] = parent[parent[v]]
            v = parent[v]
        if u != v:
            parent[max(u, v)] = min(u, v)
            kept.append(e)
            if len(kept) == len(names) - 1:
                break
    return np.array(kept, np.int64)


def _roots(chosen: DataFrame) -> DataFrame:
    """(c, root) from (c, to), the component that each joins; two that join each other are led by the lesser."""
    back = chosen.select(F.col("c").alias("to"), F.col("to").alias("_back"))
    up = chosen.join(back, "to", "left")
    up = written(up.select("c", F.when((F.col("_back") == F.col("c")) & (F.col("c") < F.col("to")), F.col("c")).otherwise(F.col("to")).alias("root")), "up")
    while True:
        over = up.select(F.col("c").alias("root"), F.col("root").alias("_over"))
        after = written(up.join(over, "root").select("c", F.col("_over").alias("root"), (F.col("_over") != F.col("root")).alias("_new")), "jumped")
        more = after.filter("_new").limit(1).count()
        up = after.drop("_new")
        if not more:
            return up


def spanning_forest(edges: DataFrame, local_edges: int | None = None) -> DataFrame:
    """(a, b, weight): a minimum spanning forest of edges (a, b, weight), ties by the ends.

    Loops and null ends are no edges; repeated edges count once, at their least weight; an empty table gives no edges.
    """
    local_edges = LOCAL_EDGES if local_edges is None else local_edges
    rows = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.col("weight").cast("double").alias("weight")).filter("a < b and weight is not null")
    left = written(rows.groupBy("a", "b").agg(F.min("weight").alias("weight")).select(F.col("a").alias("ca"), F.col("b").alias("cb"), F.struct("weight", "a", "b").alias("edge")), "edges")
    found = left.select("edge.*").limit(0)
    while (n := left.count()) > local_edges:
        both = left.unionByName(left.select(F.col("cb").alias("ca"), F.col("ca").alias("cb"), "edge"))
        chosen = written(both.groupBy(F.col("ca").alias("c")).agg(F.min(F.struct("edge", "cb")).alias("m")).select("c", F.col("m.cb").alias("to"), "m.edge"), "chosen")
        found = written(found.unionByName(chosen.select("edge.*").distinct()), "forest")
        root = _roots(chosen.select("c", "to"))
        side = lambda c: root.select(F.col("c").alias(c), F.col("root").alias(f"r{c}"))  # noqa: E731, B023
        left = left.join(side("ca"), "ca").join(side("cb"), "cb").filter("rca <> rcb")
        left = written(left.groupBy(F.least("rca", "rcb").alias("ca"), F.greatest("rca", "rcb").alias("cb")).agg(F.min("edge").alias("edge")), "left")
    if not n:
        return found.select("a", "b", "weight")

    def one(p: pd.DataFrame) -> pd.DataFrame:
        order = np.lexsort((p["b"], p["a"], p["weight"]))
        return p.iloc[kruskal(p["ca"].to_numpy(), p["cb"].to_numpy(), order)][["weight", "a", "b"]]

    rest = left.select(F.lit(0).alias("all"), "ca", "cb", "edge.*").groupBy("all").applyInPandas(one, "weight double, a long, b long")
    return found.unionByName(rest).select("a", "b", "weight")
