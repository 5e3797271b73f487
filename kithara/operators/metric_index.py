"""Exact neighbours with metric pruning: points stored by pivot and ring, visited in order of their bounds.

Every point belongs to its nearest pivot, and the points of a pivot are cut by their distance to it into
rings of RING points. By the triangle inequality no point of a ring is nearer to a query than the query's
distance to the pivot lies outside of the ring's; nor, for another pivot than its own, nearer than the plane
between both. A query visits rings in order of this bound, first as many as hold k points, then more,
until the bound exceeds its k-th distance so far. So queries meet only the rings that may matter, and
what is compared does not grow with the square of the points where these have structure. Without structure
(few rings are excluded) all points are compared block by block, with the same rows.

Pivots are a bounded sample (PIVOTS), sent to all tasks with four numbers for each ring (MOST_RINGS). Rings come from
ranks over ranges, so one pivot's points are split even if they are all the same. Rings stand on shelves, about one for
each core, and the queries of a shelf are dealt into at most about four parts (more where their bytes exceed a block): a query goes
once to each shelf where it visits anything, so what is moved grows with the points, not with the visits.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kithara.operators import knn
from kithara.operators.ranges import ranked_in_ranges
from kithara.session import written

#: Points of a ring and queries of a part at least; pivots at most (and one for each ring's worth of points).
RING, ASKS, PIVOTS = 4096, 4096, 4096
#: Rings at most, beyond which they are longer; every task knows them all (40 bytes each).
MOST_RINGS = 1 << 18
#: Share of all visits (a query, a ring) beyond which the index does not pay: all points are compared block by block.
MOST_SHARE = 0.5
#: Rings that a query visits more in each round, once it has k candidates; the last round takes all that its bound allows.
ROUNDS = (4, 32, None)
SEED = 23


@dataclass
class _Plan:
    """What every task needs to know of the index."""

    pivots: np.ndarray
    cell: np.ndarray
    low: np.ndarray
    high: np.ndarray
    count: np.ndarray
    shelves: np.ndarray  # the ring with which each shelf begins

    def bounds(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each query and ring: a lower bound of all distances, and the distance to the pivot."""
        d = _distances(x, self.pivots)
        own = d.argmin(1)
        names, place = np.unique(own, return_inverse=True)
        apart = _distances(self.pivots[names], self.pivots)[place]
        with np.errstate(divide="ignore", invalid="ignore"):
            plane = np.where(apart > 0, (d**2 - d[np.arange(len(x)), own][:, None] ** 2) / (2 * apart), 0)
        d, plane = d[:, self.cell], plane[:, self.cell]
        return np.maximum(np.maximum(d - self.high, self.low - d), np.maximum(plane, 0)), d

    def visits(self, x: np.ndarray, theta: np.ndarray, seen: np.ndarray, least: int, more: int | None) -> np.ndarray:
        """Which rings each query visits next: of those not seen yet, nearest bound first, as many as hold `least` points, or
        `more` rings (all, for None) within theta."""
        bound, d = self.bounds(x)
        slack = 1e-9 * (1 + d.max(1, initial=0))
        key = np.where(seen, np.inf, bound + 1e-9 * d)
        some = min(least or more or len(self.cell), len(self.cell))
        at = np.argpartition(key, some - 1, axis=1)[:, :some]
        chosen = np.zeros(key.shape, bool)
        if least:
            at = np.take_along_axis(at, np.take_along_axis(key, at, 1).argsort(1), 1)
            held = np.cumsum(self.count[at], 1) - self.count[at]
            np.put_along_axis(chosen, at, held < least, 1)
            return chosen & ~seen
        np.put_along_axis(chosen, at, True, 1)
        return chosen & ~seen & (bound <= (theta + slack)[:, None])


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    out = (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * a @ b.T
    return np.sqrt(np.maximum(out, 0))


def _next(b: pa.RecordBatch, plan: _Plan, least: int, more: int | None) -> tuple[np.ndarray, np.ndarray]:
    """Of rows (id, vector, theta, seen): the rings seen so far, and those to visit next."""
    x = knn.matrix(b.column(1))[:, : plan.pivots.shape[1]]
    n = len(plan.cell)
    seen = np.zeros((len(x), n), bool)
    for i, bits in enumerate(b.column(3).to_pylist()):
        if bits is not None:
            seen[i] = np.unpackbits(np.frombuffer(bits, np.uint8), count=n)
    return seen, plan.visits(x, b.column(2).to_numpy(), seen, least, more)


class PivotIndex:
    """An index of points (key, vector) for exact nearest-neighbour and radius queries. visits counts the rings that queries have met."""

    def __init__(self, points: DataFrame, key: str = "point_id", vector: str = "embedding", ring: int = RING, asks: int = ASKS, pivots: int = PIVOTS) -> None:
        self.spark, self.key, self.vector, self.asks, self.visits = points.sparkSession, key, vector, asks, 0
        own = knn.named(points, key, vector)
        n = own.count()
        ring = max(ring, -(-n // MOST_RINGS))
        chosen = own.select(F.xxhash64("id", F.lit(SEED)).alias("o"), "id", "vector").orderBy("o", "id").limit(max(1, min(pivots, n // ring))).collect()
        centre = np.array([r["vector"] for r in chosen], float).reshape(len(chosen), len(chosen[0]["vector"]) if chosen else 0)

        def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                x = knn.matrix(b.column(1))
                for i in range(0, len(x), 1024):
                    d = _distances(x[i : i + 1024], centre)
                    cell = d.argmin(1)
                    # the pivot's distance as it is, so that bounds hold to the last digits
                    exact = np.sqrt(((x[i : i + 1024] - centre[cell]) ** 2).sum(1))
                    part = b.slice(i, len(d))
                    yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(cell, pa.int32()), pa.array(exact)], names=["id", "vector", "cell", "d"])

        cells = own.mapInArrow(placed, "id long, vector array<double>, cell int, d double") if n else own.select("id", "vector", F.lit(0).alias("cell"), F.lit(0.0).alias("d"))
        cells = ranked_in_ranges(cells, ["cell"], ["d", "id"], "place").withColumn("part", F.expr(f"place div {ring}"))
        cells = written(cells.select("id", "vector", "cell", "part", "d"), "rings")
        stats = cells.groupBy("cell", "part").agg(F.min("d").alias("low"), F.max("d").alias("high"), F.count("*").alias("n")).toPandas().sort_values(["cell", "part"], ignore_index=True)
        # Rings stand on shelves of about as many points, as many as there are cores, or more where their bytes ask for them.
        most = max(knn.BLOCK, knn.BLOCK_BYTES // (8 * max(1, centre.shape[1])))
        shelves = max(1, min(len(stats), max(self.spark.sparkContext.defaultParallelism, -(-n // most))))
        ends = np.cumsum(stats["n"].to_numpy(int))
        begin = np.unique(np.searchsorted(ends, n * np.arange(shelves) / shelves, "right")) if n else np.zeros(1, int)
        self.most = most
        self.plan = self.spark.sparkContext.broadcast(_Plan(centre, stats["cell"].to_numpy(int), stats["low"].to_numpy(), stats["high"].to_numpy(), stats["n"].to_numpy(int), begin))
        # A ring's number is its place among the rings of all pivots: those before its pivot's, and its part.
        first = stats.groupby("cell").size().reindex(range(len(centre)), fill_value=0).cumsum().shift(fill_value=0)
        before = self.spark.createDataFrame([(int(c), int(v)) for c, v in first.items()], "cell int, before int")
        ring_of = (F.col("before") + F.col("part")).cast("int")
        on = self.spark.createDataFrame([(s, int(b), int(e)) for s, (b, e) in enumerate(zip(begin, [*begin[1:], len(stats)], strict=True))], "shelf int, begin int, end int")
        placed_ = cells.join(before, "cell").select("id", "vector", ring_of.alias("ring"))
        # one row a shelf: as many as there are cores, or blocks of bytes
        self.points = placed_.join(F.broadcast(on), (F.col("ring") >= F.col("begin")) & (F.col("ring") < F.col("end"))).select("id", "vector", "shelf", (F.col("ring") - F.col("begin")).alias("ring"))
        self.rings, self.n = len(stats), n

    def _share(self, asks: DataFrame, queries: int) -> float:
        """What share of all visits that could be (a query, a ring) the bounds allow."""
        plan = self.plan

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                n = sum(int(_next(b.slice(i, 256), plan.value, 0, None)[1].sum()) for i in range(0, b.num_rows, 256))
                yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], names=["n"])

        return (asks.mapInArrow(run, "n long").agg(F.sum("n")).first()[0] or 0) / max(1, queries * self.rings)

    def _planned(self, asks: DataFrame, least: int, more: int | None) -> DataFrame:
        """asks (id, vector, theta, seen) that have rings to visit, with the shelves of these and a bit for each ring of a shelf."""
        plan = self.plan

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                begin = plan.value.shelves
                for i in range(0, b.num_rows, 256):
                    part = b.slice(i, 256)
                    seen, now = _next(part, plan.value, least, more)
                    on = np.logical_or.reduceat(now, begin, axis=1)
                    bits = [np.packbits(now[:, a:e], axis=1) for a, e in zip(begin, [*begin[1:], now.shape[1]], strict=True)]
                    to = [np.flatnonzero(r) for r in on]
                    after = [r.tobytes() for r in np.packbits(seen | now, axis=1)]
                    told = [[{"shelf": int(s), "mask": bits[s][j].tobytes()} for s in r] for j, r in enumerate(to)]
                    kind = pa.list_(pa.struct([("shelf", pa.int32()), ("mask", pa.binary())]))
                    yield pa.RecordBatch.from_arrays(
                        [*part.columns[:3], pa.array(after, pa.binary()), pa.array(now.sum(1), pa.int64()), pa.array(told, kind)], names=["id", "vector", "theta", "seen", "visits", "to"]
                    )

        schema = "id long, vector array<double>, theta double, seen binary, visits long, to array<struct<shelf:int,mask:binary>>"
        return written(asks.mapInArrow(run, schema).filter("visits > 0"), "visits")

    def _compared(self, planned: DataFrame, use, points: DataFrame | None = None) -> DataFrame:
        """use(query ids, queries, point ids, points) over each ring and the queries that visit it, by shelves and parts of the queries.

        A query goes once to each shelf and a point to each part of its shelf's queries, however many rings are visited.
        points: (id, vector) that `use` sees in place of the index's own.
        """
        own = self.points if points is None else self.points.drop("vector").join(points, "id")
        each = planned.select("id", "vector", F.explode("to").alias("to")).select("id", "vector", "to.shelf", "to.mask")
        size = max(self.asks, min(self.most, -(-planned.count() // 4)))
        load = written(each.groupBy("shelf").agg(F.ceil(F.count("*") / size).cast("int").alias("parts")), "load")
        unit = lambda part: (F.col("shelf").cast("long") * (1 << 31) + part).alias("cell")
        asks = each.join(load, "shelf").select(unit(F.pmod(F.xxhash64("id"), F.col("parts"))), F.lit(True).alias("is_query"), "id", "vector", F.lit(0).alias("ring"), "mask")
        own = own.join(load, "shelf").withColumn("_part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        own = own.select(unit(F.col("_part")), F.lit(False).alias("is_query"), "id", "vector", "ring", F.lit(None).cast("binary").alias("mask"))
        both = own.unionByName(asks).repartition("cell").sortWithinPartitions("cell", "is_query", "ring", "id")
        return both.mapInArrow(lambda b: knn.pairs(b, use), "src long, dst long, dist double")

    def _asks(self, queries: DataFrame, theta: float) -> DataFrame:
        return queries.select("id", "vector", F.lit(theta).alias("theta"), F.lit(None).cast("binary").alias("seen"))

    def nearest(self, queries: DataFrame, k: int) -> DataFrame:
        """The k nearest points of each query, as edges (src, rank, dst, dist)."""
        own = knn.named(queries, self.key, self.vector)
        asks, n = self._asks(own, float("inf")), own.count()
        found = self.spark.createDataFrame([], "src long, rank int, dst long, dist double")
        if not self.rings:
            return found
        for more in (0, *ROUNDS):
            if more == ROUNDS[0] and self.rings > more and self._share(asks, n) > MOST_SHARE:
                self.visits += n * self.rings
                return written(knn.ranked(knn.block_by_block(own, self.points.select("id", "vector"), knn.k_best(k)), k), "found")
            planned = self._planned(asks, k if more == 0 else 0, more)
            visits = planned.agg(F.sum("visits")).first()[0] or 0
            if not visits:
                break
            self.visits += visits
            found = written(knn.merged(found, self._compared(planned, knn.k_best(k)), k), "found")
            theta = found.filter(F.col("rank") == k - 1).select(F.col("src").alias("id"), F.col("dist").alias("theta"))
            asks = planned.select("id", "vector", "seen").join(theta, "id", "left").select("id", "vector", F.coalesce("theta", F.lit(float("inf"))).alias("theta"), "seen")
        return found

    def compared(self, queries: DataFrame, radius: float, use, full: list[DataFrame] | None = None) -> DataFrame:
        """What `use` gives over the rings that hold every pair of a query and a point within the radius.

        full: for queries and points (id, vector), what `use` sees: vectors that go on beyond those that bounds are told by.
        """
        if not self.rings:
            return self.spark.createDataFrame([], "src long, dst long, dist double")
        own, points = (knn.named(queries, self.key, self.vector), None) if full is None else full
        asks, n = self._asks(own, float(radius)), own.count()
        if self._share(asks, n) > MOST_SHARE:
            self.visits += n * self.rings
            return knn.block_by_block(own, self.points.select("id", "vector") if points is None else points, use)
        planned = self._planned(asks, 0, None)
        self.visits += planned.agg(F.sum("visits")).first()[0] or 0
        return self._compared(planned, use, points)

    def within(self, queries: DataFrame, radius: float) -> DataFrame:
        """All pairs (src, dst, dist) of a query and a point no farther apart than the radius."""
        return self.compared(queries, radius, knn.all_within(radius))
