"""Exact nearest neighbours by Euclidean distance, and what is read off neighbour lists.

Lists are edge tables (src, rank, dst, dist); rank 0 is the point itself where it is among the
candidates, then by distance, then by id.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kithara.operators.forest import kruskal
from kithara.operators.ranges import ranked_in_ranges
from kithara.session import is_whole, written

#: A task multiplies one block of queries with one block of candidates. Points in a block at least (where there
#: are as many), and bytes at most: rows are copied once for each block of the other side, so large blocks move less. As many
#: blocks as cores ask for serve any points until blocks reach these bytes, so what is moved grows with the points.
BLOCK, BLOCK_BYTES = 4096, 64 << 20
#: Pairs that are compared without an index, at most.
DIRECT = 1 << 26
#: Numbers that hold differences of vectors at once, pairs of a block that wait for their forest, and distances held at once.
DIFFERENCES, WAITING, PRODUCTS = 1 << 23, 1 << 20, 1 << 21
#: Nearest candidates are sought for ROWS queries at once, among FIRST candidates exactly and then WIDE at a time; where more than
#: MANY pairs come into question, again in double precision. FAR: a square beyond all others.
ROWS, FIRST, WIDE, MANY, FAR = 256, 512, 2048, 1 << 15, 1e30


def matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def _ring_by_ring(t: pa.Table, n: int, ids: np.ndarray, x: np.ndarray, use) -> Iterator[tuple]:
    """use over each ring of a cell's points and the queries that visit it, made fewer rows where `use` knows how."""
    rings = t.column("ring").to_numpy()[:n]
    masks = t.column("mask").slice(n).to_pylist()
    visits = np.unpackbits(np.frombuffer(b"".join(masks), np.uint8).reshape(len(masks), -1), axis=1)
    cut = np.concatenate([[0], np.flatnonzero(np.diff(rings)) + 1, [n]])
    fold, held, rows = getattr(use, "fold", None), [], 0

    def folded() -> list[tuple]:
        all_ = tuple(np.concatenate(c) for c in zip(*held, strict=True))
        kept = fold(*all_)
        return [tuple(c[kept] for c in all_)]

    limit = WAITING
    for a, e in zip(cut[:-1], cut[1:], strict=True):
        who = n + np.flatnonzero(visits[:, rings[a]])
        if len(who):
            for found in use(ids[who], x[who], ids[a:e], x[a:e]):
                if fold is None:
                    yield found
                    continue
                held.append(found)
                rows += len(found[0])
                if rows > limit:
                    held = folded()
                    rows = len(held[0][0])
                    limit = max(WAITING, 2 * rows)
    if held:
        yield from folded()


def pairs(batches: Iterator[pa.RecordBatch], use) -> Iterator[pa.RecordBatch]:
    """Calls use(query ids, queries, ids, points) for each cell of rows (cell, is_query, id, vector), sorted so.

    With columns ring and mask (points: the ring's place in the cell, sorted by it; queries: a bit for each ring
    that they visit) it is called for each ring.
    """
    held: list[pa.RecordBatch] = []

    def cell() -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(held).combine_chunks()
        asks = t.column("is_query").to_numpy()
        n = len(asks) - int(asks.sum())
        if 0 < n < len(asks):
            ids, x = t.column("id").to_numpy(), matrix(t.column("vector").combine_chunks())
            if "ring" in t.column_names:
                out = _ring_by_ring(t, n, ids, x, use)
            else:
                out = use(ids[n:], x[n:], ids[:n], x[:n])
            waiting, rows = [], 0
            for found in out:
                waiting.append(found)
                rows += len(found[0])
                if rows >= 1 << 16:
                    yield batch(waiting)
                    waiting, rows = [], 0
            if waiting:
                yield batch(waiting)

    def batch(out: list[tuple]) -> pa.RecordBatch:
        src, dst, dist = (np.concatenate(c) for c in zip(*out, strict=True))
        return pa.RecordBatch.from_arrays([pa.array(src), pa.array(dst), pa.array(dist)], names=["src", "dst", "dist"])

    for b in batches:
        cells = b.column(0).to_numpy()
        cut = np.concatenate([[0], np.flatnonzero(np.diff(cells)) + 1, [len(cells)]])
        for a, e in zip(cut[:-1], cut[1:], strict=True):
            if a < e:
                if held and held[0].column(0)[0].as_py() != cells[a]:
                    yield from cell()
                    held = []
                held.append(b.slice(a, e - a))
    if held:
        yield from cell()


def _cells(queries: DataFrame, points: DataFrame) -> DataFrame:
    """Every block of queries with every block of candidates; there are cells enough for all cores where blocks are not the least."""
    first = points.select(F.size("vector").alias("n")).first()
    most = max(BLOCK, BLOCK_BYTES // (8 * max(1, first["n"] if first else 1)))
    sides = 2 * math.isqrt(points.sparkSession.sparkContext.defaultParallelism) + 1
    n, m = (max(1, -(-rows // most), min(-(-rows // BLOCK), sides)) for rows in (queries.count(), points.count()))
    own = lambda k: F.pmod(F.xxhash64("id"), F.lit(k)).cast("int")
    all_ = lambda k: F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    a = points.select(own(m).alias("p"), all_(n).alias("q"), F.lit(False).alias("is_query"), "id", "vector")
    b = queries.select(all_(m).alias("p"), own(n).alias("q"), F.lit(True).alias("is_query"), "id", "vector")
    both = a.unionByName(b).select((F.col("p") * n + F.col("q")).cast("long").alias("cell"), "is_query", "id", "vector")
    return both.repartition("cell").sortWithinPartitions("cell", "is_query", "id")


def named(points: DataFrame, key: str, vector: str) -> DataFrame:
    return points.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("vector"))


def check_finite(points: DataFrame, vector: str = "embedding") -> None:
    """An error if a vector is null, or holds a null or non-finite component."""
    x = F.col(vector).cast("array<double>")
    good = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    bad = points.filter(~F.coalesce(good, F.lit(False))).count()
    if bad:
        raise ValueError(f"{bad} vectors are null or not finite")


def folding(fold):
    """Gives a `use` the function that makes fewer rows (src, dst, dist) of what it gave for several parts of a block."""

    def marked(use):
        use.fold = fold
        return use

    return marked


def slices(n: int, m: int) -> Iterator[slice]:
    """Of n queries as many at once as m candidates allow."""
    step = max(1, min(256, PRODUCTS // max(1, m)))
    return (slice(i, i + step) for i in range(0, n, step))


def k_best(k: int):
    """For `pairs`: the k nearest candidates of each query.

    Squared distances in single precision, of vectors moved to their middle and scaled to length 1, and the bound of their
    error tell what may be nearer than the k nearest so far; distances of these few are computed from the vectors as they are.
    """

    def fold(src: np.ndarray, dst: np.ndarray, dist: np.ndarray) -> np.ndarray:
        order = np.lexsort((dst, dst != src, dist, src))
        own = src[order]
        return order[np.arange(len(own)) - np.searchsorted(own, own) < k]

    @folding(fold)
    def use(q_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, x: np.ndarray) -> Iterator[tuple]:
        middle = x.mean(0)
        scale = np.sqrt(max(((y - middle) ** 2).sum(1).max() for z in (q, x) for y in np.array_split(z, -(-len(z) // WIDE)))) or 1.0
        place = lambda y: (y - middle) / scale
        slack = 4 * (x.shape[1] + 8) * 2.0**-24
        single = None
        if len(x) > FIRST:  # (vector, its square) in single precision, in multiples of eight, with points that nothing is near to
            single = np.zeros((-(-len(x) // 8) * 8, x.shape[1] + 1), np.float32)
            single[len(x) :, -1] = FAR
            for i in range(0, len(x), WIDE):
                y = place(x[i : i + WIDE])
                single[i : i + len(y), :-1], single[i : i + len(y), -1] = y, (y * y).sum(1)
        ends = [0, min(FIRST, len(x)), *range(FIRST + WIDE, len(x), WIDE), len(x)]
        for i in range(0, len(q), ROWS):
            part, own = q[i : i + ROWS], q_ids[i : i + ROWS]
            asks = place(part)
            squares = (asks * asks).sum(1)
            twice = np.concatenate([-2 * asks, np.ones((len(part), 1))], 1, dtype=np.float32)
            theta = np.full(len(part), np.inf)  # the k-th distance so far, squared
            held, rows, folded = [], 0, 0
            for c, e in zip(ends[:-1], ends[1:], strict=True):
                if c == e:
                    continue
                row = None
                if c:
                    limit = np.nextafter(np.minimum(theta - squares + slack, FAR / 2).astype(np.float32), np.float32(FAR))
                    row, col = _true(twice @ single[c : -(-e // 8) * 8].T <= limit[:, None])
                if row is None or len(row) > MANY:
                    y = place(x[c:e])
                    rough = (y * y).sum(1)[None, :] - 2 * asks @ y.T
                    edge = np.partition(rough, min(k, e - c) - 1, axis=1)[:, min(k, e - c) - 1]
                    row, col = np.nonzero(rough <= (np.minimum(theta - squares, edge) + 1e-9)[:, None])
                if len(row):
                    held.append((own[row], ids[c + col], distances(part, x[c:e], row, col), row))
                    rows += len(row)
                if held and (e == len(x) or e >= 2 * folded or rows > MANY):
                    src, dst, dist, row = (np.concatenate(h) for h in zip(*held, strict=True))
                    order = np.lexsort((dst, dst != src, dist, row))
                    nth = np.arange(len(order)) - np.searchsorted(row[order], row[order])
                    full = order[nth == k - 1]
                    theta[row[full]] = (dist[full] / scale) ** 2
                    order = order[nth < k]
                    held, rows, folded = [(src[order], dst[order], dist[order], row[order])], 0, e
            yield from (h[:3] for h in held)

    return use


def _true(found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of the few true values; rows are multiples of eight long."""
    words = np.flatnonzero(found.view(np.uint64))
    word, byte = np.nonzero(found.reshape(-1, 8)[words])
    return np.divmod(8 * words[word] + byte, found.shape[1])


def distances(q: np.ndarray, x: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of the pairs (q[a], x[b]), in memory that does not grow with them."""
    step = max(1, DIFFERENCES // max(1, x.shape[1]))
    parts = [np.sqrt(((x[b[i : i + step]] - q[a[i : i + step]]) ** 2).sum(1)) for i in range(0, len(a), step)]
    return np.concatenate(parts) if parts else np.zeros(0)


def _rough(q: np.ndarray, x: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, float]]:
    """By `slices` of queries: the place of the first, they, their squared distances by the matrix product, and what these may be off."""
    squares = (x * x).sum(1)
    for at in slices(len(q), len(x)):
        part = q[at]
        rough = (part * part).sum(1)[:, None] + squares[None, :] - 2 * part @ x.T
        yield at.start, part, rough, 1e-9 * (1 + np.abs(rough).max())


def near_pairs(q: np.ndarray, x: np.ndarray, radius: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Places and distances of the pairs no farther apart than the radius, some queries at once."""
    for i, part, rough, off in _rough(q, x):
        a, b = np.nonzero(rough <= radius * radius + off)
        dist = distances(part, x, a, b)
        near = dist <= radius
        yield i + a[near], b[near], dist[near]


def all_within(radius: float):
    """For `pairs`: all candidates no farther than the radius."""

    def use(q_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, x: np.ndarray) -> Iterator[tuple]:
        for a, b, dist in near_pairs(q, x, radius):
            yield q_ids[a], ids[b], dist

    return use


def connecting(radius: float):
    """For `pairs`: of the pairs src < dst within the radius, some that connect what all connect; fewer than the points of both blocks."""

    @folding(lambda src, dst, dist: kruskal(src, dst, np.arange(len(src))))
    def use(q_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, x: np.ndarray) -> Iterator[tuple]:
        label = np.arange(len(x))  # candidates that queries so far connect have one label
        for i, part, rough, off in _rough(q, x):
            near = rough <= radius * radius - off
            a, b = np.nonzero((rough <= radius * radius + off) & ~near)
            near[a, b] = distances(part, x, a, b) <= radius
            near &= q_ids[i : i + len(part), None] < ids[None, :]
            src, dst = [], []
            for r in np.flatnonzero(near.any(1)):
                met = np.flatnonzero(near[r])
                own = label[met]
                if (own == own[0]).all():
                    met = met[:1]
                else:
                    names, first = np.unique(own, return_index=True)
                    joined = np.zeros(len(x), bool)
                    joined[names] = True
                    label[joined[label]] = names[0]
                    met = met[first]
                src.append(np.full(len(met), r))
                dst.append(met)
            if src:
                src, dst = np.concatenate(src), np.concatenate(dst)
                yield q_ids[i + src], ids[dst], distances(part, x, src, dst)

    return use


def lightest(radius: float):
    """For `pairs` of vectors that end in a weight: a minimum spanning forest of the pairs src < dst within the radius, each
    weighing the largest of its distance and both ends' weights. The union of such forests holds one of all pairs."""

    def fold(src: np.ndarray, dst: np.ndarray, weight: np.ndarray) -> np.ndarray:
        return kruskal(src, dst, np.lexsort((dst, src, weight)))

    @folding(fold)
    def use(q_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, x: np.ndarray) -> Iterator[tuple]:
        held = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]

        def kept() -> list[np.ndarray]:
            forest = fold(*held)
            return [c[forest] for c in held]

        for a, b, dist in near_pairs(q[:, :-1], x[:, :-1], radius):
            once = q_ids[a] < ids[b]
            a, b, dist = a[once], b[once], dist[once]
            new = q_ids[a], ids[b], np.maximum(dist, np.maximum(q[a, -1], x[b, -1]))
            held = [np.concatenate(c) for c in zip(held, new, strict=True)]
            if len(held[0]) > WAITING:
                held = kept()
        if len(held[0]):
            yield tuple(kept())

    return use


def least_reach(radius: float):
    """For `pairs` of vectors that end in a weight: for each query the other candidate within the radius for which the larger
    of distance and the candidate's weight is least."""

    def fold(src: np.ndarray, dst: np.ndarray, weight: np.ndarray) -> np.ndarray:
        order = np.lexsort((dst, weight, src))
        return order[np.diff(src[order], prepend=src[order][:1] - 1) != 0]

    @folding(fold)
    def use(q_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, x: np.ndarray) -> Iterator[tuple]:
        for a, b, dist in near_pairs(q[:, :-1], x[:, :-1], radius):
            other = q_ids[a] != ids[b]
            a, b, dist = a[other], b[other], dist[other]
            weight = np.maximum(dist, x[b, -1])
            order = np.lexsort((ids[b], weight, a))
            order = order[np.diff(a[order], prepend=-1) > 0]
            yield q_ids[a[order]], ids[b[order]], weight[order]

    return use


def in_groups(use):
    """For `pairs` of vectors that end in a group's number: `use` over the queries and candidates of each group."""

    def of_each(q_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, x: np.ndarray) -> Iterator[tuple]:
        a, b = np.argsort(q[:, -1], kind="stable"), np.argsort(x[:, -1], kind="stable")
        one, other = q[a, -1], x[b, -1]
        for g in np.intersect1d(one, other):
            own = a[np.searchsorted(one, g) : np.searchsorted(one, g, "right")]
            near = b[np.searchsorted(other, g) : np.searchsorted(other, g, "right")]
            yield from use(q_ids[own], q[own, :-1], ids[near], x[near, :-1])

    return folding(getattr(use, "fold", None))(of_each)


def _few(queries: DataFrame, points: DataFrame) -> bool:
    return queries.count() * points.count() <= DIRECT


def nearest(queries: DataFrame, points: DataFrame, k: int, key: str = "point_id", vector: str = "embedding") -> DataFrame:
    """The k nearest points of each query, itself included where it is a point.

    Up to DIRECT pairs are compared block by block; beyond, an index leaves out what cannot be near. The rows are the same.
    """
    if not _few(queries, points):
        from kithara.operators.metric_index import PivotIndex

        return PivotIndex(points, key, vector).nearest(queries, k)
    return ranked(block_by_block(named(queries, key, vector), named(points, key, vector), k_best(k)), k)


def compared(queries: DataFrame, points: DataFrame, radius: float, use, key: str = "point_id", vector: str = "embedding", weight: str | None = None) -> DataFrame:
    """What `use` (`all_within`, `connecting`, `lightest`, `least_reach`) gives over blocks that together hold every pair of a
    query and a point within the radius. weight: a column that follows each vector."""
    full = [named(f, key, vector) if weight is None else _weighted(f, key, vector, weight) for f in (queries, points)]
    if not _few(queries, points):
        from kithara.operators.metric_index import PivotIndex

        return PivotIndex(points, key, vector).compared(queries, radius, use, None if weight is None else full)
    return block_by_block(*full, use)


def block_by_block(queries: DataFrame, points: DataFrame, use) -> DataFrame:
    """What `use` gives over blocks of (id, vector) that together hold every pair."""
    return _cells(queries, points).mapInArrow(lambda b: pairs(b, use), "src long, dst long, dist double")


def _weighted(points: DataFrame, key: str, vector: str, weight: str) -> DataFrame:
    return named(points.withColumn(vector, F.concat(F.col(vector).cast("array<double>"), F.array(F.col(weight).cast("double")))), key, vector)


def within(points: DataFrame, radius: float, key: str = "point_id", vector: str = "embedding") -> DataFrame:
    """All pairs (src, dst, dist) of points no farther apart than the radius, each point with itself too."""
    return compared(points, points, radius, all_within(radius), key, vector)


def ranked(edges: DataFrame, k: int) -> DataFrame:
    """The k nearest of each src, with rank from 0."""
    order = Window.partitionBy("src").orderBy("dist", (F.col("dst") != F.col("src")), "dst")
    return edges.withColumn("rank", F.row_number().over(order) - 1).filter(F.col("rank") < k).select("src", "rank", "dst", "dist")


def merged(one: DataFrame, other: DataFrame, k: int) -> DataFrame:
    """The k nearest of two lists over disjoint candidates."""
    return ranked(one.select("src", "dst", "dist").unionByName(other.select("src", "dst", "dist")), k)


def truncated(points: DataFrame, size: int, key: str = "point_id", source: str = "source") -> DataFrame:
    """points with the first `size` of the background only, by key; a size that the background does not have is an error."""
    rest = points.filter(F.col(source) == "background")
    n = rest.count()
    if not 0 < size <= n:
        raise ValueError(f"{size} of {n} background points")
    kept = written(ranked_in_ranges(rest.select(key), [], [key], "_place").filter(F.col("_place") < size).select(key), "kept")
    return points.filter(F.col(source) != "background").unionByName(rest.join(kept, key, "left_semi"))


def fingerprint(points: DataFrame, key: str = "point_id", vector: str = "embedding") -> str:
    """The same for the same points in any order, and for hardly any others: their number and two sums of hashes."""
    own = named(points, key, vector)
    sums = [F.sum(F.xxhash64("id", "vector", F.lit(seed)).cast("decimal(38,0)")) for seed in (1, 2)]
    n, *parts = own.agg(F.count("*"), *sums).first()
    return f"{n:x}_" + "_".join(f"{int(p or 0) % (1 << 64):016x}" for p in parts)


def stored_self_block(points: DataFrame, k: int, folder: str, key: str = "point_id", vector: str = "embedding", rebuild: bool = False) -> DataFrame:
    """Neighbour lists of points among themselves, read from `folder` if a run over the same points and k has left them there.

    A block is a table named by k and the points' fingerprint, so lists of other points (another or a truncated
    background) are never taken for these. A table that was not written to its end does not count.
    """
    path = f"{folder.rstrip('/')}/self_{k}_{fingerprint(points, key, vector)}"
    if rebuild or not is_whole(points.sparkSession, path):
        nearest(points, points, k, key, vector).write.mode("overwrite").parquet(path)
    return points.sparkSession.read.parquet(path)


def split_nearest(points: DataFrame, k: int, key: str = "point_id", vector: str = "embedding", source: str = "source", stored: str | None = None, rebuild: bool = False) -> DataFrame:
    """Joint neighbour lists of sample and background from the four blocks of the two sources.

    stored: a folder in which the lists of each source among itself are kept between runs; those across are always computed.
    """
    parts = {s: points.filter(F.col(source) == s) for s in ("sample", "background")}

    def block(a: str, b: str) -> DataFrame:
        if a == b and stored is not None:
            return stored_self_block(parts[a], k, stored, key, vector, rebuild)
        return nearest(parts[a], parts[b], k, key, vector)

    rows = [merged(block(a, "sample"), block(a, "background"), k) for a in parts]
    return rows[0].unionByName(rows[1])


def kth_distance(edges: DataFrame, kth: int) -> DataFrame:
    """(point_id, d): the distance in the kth returned column, the point itself being the first."""
    return edges.filter(F.col("rank") == kth - 1).select(F.col("src").alias("point_id"), F.col("dist").alias("d"))


def first_neighbour_distance(edges: DataFrame) -> DataFrame:
    """(point_id, d): the distance of the nearest other point."""
    return edges.filter("src <> dst").groupBy(F.col("src").alias("point_id")).agg(F.min("dist").alias("d"))


def neighbour_graph(edges: DataFrame) -> DataFrame:
    """Undirected edges (a, b, weight) with a < b and weight 1 / (1 + dist); repeated ones take the least distance."""
    pairs = edges.filter("src <> dst and dst >= 0").groupBy(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).agg(F.min("dist").alias("dist"))
    return pairs.select("a", "b", (1 / (1 + F.col("dist"))).alias("weight"))


def density_by_length(edges: DataFrame, lengths: DataFrame, kth: int = 5) -> DataFrame:
    """(length, n, mean_d, median_d): the kth neighbour's distance by sequence length."""
    d = edges.filter(F.col("rank") == kth).select(F.col("src").alias("point_id"), "dist")
    return d.join(lengths, "point_id").groupBy("length").agg(F.count("*").alias("n"), F.avg("dist").alias("mean_d"), F.median("dist").alias("median_d"))
