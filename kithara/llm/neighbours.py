"""Approximate nearest neighbours by learned partitions.

A nearest-neighbour graph of a bounded sample is cut into balanced parts with few cut edges
(recursive bisection, refined by swaps); a small network learns which parts hold the neighbours of a
vector (after Dong et al., "Learning Space Partitions for Nearest Neighbor Search", 2020). Every
row of the table is filed under its most probable part; a query is sent to its several most probable
parts and ranked there by the exact inner product in double precision. How many parts are probed is
measured: the fewest at which held-back sample vectors find RECALL of their true neighbours.

A part of many rows is dealt to tasks as blocks, and so are its queries, so one task holds one block
of either whatever the sizes; a table of more rows than fit the most parts has longer parts of more
blocks, and loses nothing. Each block returns each query's nearest few only, and of these only what
reaches the k-th best score among the sampled rows of the query's probed parts.

Defined results: null ids and vectors that are null, zero, of another length than most, or hold
null or non-finite components take no part; rows that repeat an id are one candidate with its
nearest vector, and as a query that id has its least vector; ties go to the smaller id; a query for
which the probed parts hold fewer than k candidates is searched in all parts; columns other than
those named are not read, whatever their names (texts, long or short, play no part); an empty table
gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kithara.session import written

#: Vectors that the graph and the network are fitted to, at most.
SAMPLE = 8192
EDGES, HIDDEN, EPOCHS, SEED = 10, 128, 20, 9
#: Parts follow the rows; there are not more than the sample can fit, eight vectors a part.
ROWS_A_PART, LEAST_PARTS, MOST_PARTS = 500, 64, SAMPLE // 8
RECALL = 0.93
ROW_BLOCK, QUERY_BLOCK = 8192, 4096


@dataclass
class Router:
    weights: list[np.ndarray]
    parts: int
    probes: int
    ids: np.ndarray | None = None  # of the sample, and its vectors and parts
    vectors: np.ndarray | None = None
    filed: np.ndarray | None = None

    def scores(self, x: np.ndarray) -> np.ndarray:
        w1, b1, w2, b2 = self.weights
        norm = np.linalg.norm(x, axis=1, keepdims=True)
        return np.maximum((x / np.where(norm > 0, norm, 1)) @ w1 + b1, 0) @ w2 + b2

    def bounds(self, ids: np.ndarray, x: np.ndarray, probed: np.ndarray, k: int) -> np.ndarray:
        """For each query the k-th best score among sampled rows of its probed parts: no less can be needed."""
        out = np.full(len(x), -np.inf)
        for i in range(0, len(x), 256):
            s = x[i : i + 256] @ self.vectors.T
            open_ = np.zeros((len(s), self.parts), bool)
            np.put_along_axis(open_, probed[i : i + 256], True, axis=1)
            s[~open_[:, self.filed] | (ids[i : i + 256, None] == self.ids[None, :])] = -np.inf
            if s.shape[1] >= k:
                out[i : i + 256] = -np.partition(-s, k - 1, axis=1)[:, k - 1]
        return out


def neighbour_graph(x: np.ndarray, k: int) -> np.ndarray:
    """The k rows of largest inner product with each row, itself excluded."""
    out = np.empty((len(x), k), np.int64)
    for i in range(0, len(x), 512):
        s = x[i : i + 512] @ x.T
        s[np.arange(len(s)), np.arange(i, i + len(s))] = -np.inf
        out[i : i + 512] = np.argpartition(-s, k - 1, axis=1)[:, :k]
    return out


def _bisected(src: np.ndarray, dst: np.ndarray, n: int, rng: np.random.Generator) -> np.ndarray:
    """Two halves of n nodes with few edges between them."""
    degree = np.maximum(np.bincount(src, minlength=n), 1)
    x = rng.normal(size=n)
    for _ in range(40):
        x = 0.5 * x + 0.5 * np.bincount(src, x[dst], n) / degree
        x -= x.mean()
        x /= max(np.abs(x).max(), 1e-12)
    side = np.zeros(n, bool)
    side[np.argsort(x, kind="stable")[n // 2 :]] = True
    for _ in range(30):
        across = side[src] != side[dst]
        gain = np.bincount(src, np.where(across, 1.0, -1.0), n)
        a, b = np.flatnonzero(~side), np.flatnonzero(side)
        a, b = a[np.argsort(-gain[a], kind="stable")], b[np.argsort(-gain[b], kind="stable")]
        m = min(len(a), len(b))
        worth = int((gain[a[:m]] + gain[b[:m]] > 0).sum())
        if not worth:
            break
        move = max(1, worth // 4)
        before = across.sum()
        flipped = side.copy()
        flipped[a[:move]], flipped[b[:move]] = True, False
        if (flipped[src] != flipped[dst]).sum() >= before:
            break
        side = flipped
    return side


def balanced_parts(graph: np.ndarray, parts: int) -> np.ndarray:
    """A part for each node; parts is a power of two, and sizes differ by at most one each halving."""
    n, rng = len(graph), np.random.default_rng(SEED)
    src = np.concatenate([np.repeat(np.arange(n), graph.shape[1]), graph.ravel()])
    dst = np.concatenate([graph.ravel(), np.repeat(np.arange(n), graph.shape[1])])
    part = np.zeros(n, np.int64)
    done = 1
    while done < parts:
        nxt = part * 2
        for p in range(done):
            own = np.flatnonzero(part == p)
            place = np.full(n, -1)
            place[own] = np.arange(len(own))
            inside = (part[src] == p) & (part[dst] == p)
            nxt[own] += _bisected(place[src[inside]], place[dst[inside]], len(own), rng)
        part, done = nxt, done * 2
    return part


def fit(x: np.ndarray, total: int, k: int) -> Router:
    """A router from sampled vectors of a table of `total` vectors."""
    x = x.astype(np.float32)
    parts = LEAST_PARTS
    while parts < MOST_PARTS and parts * ROWS_A_PART < total:
        parts *= 2
    while parts > 1 and len(x) < 8 * parts:
        parts //= 2
    rng = np.random.default_rng(SEED)
    dim = x.shape[1]
    weights = [rng.normal(0, dim**-0.5, (dim, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN**-0.5, (HIDDEN, parts)), np.zeros(parts)]
    router = Router([w.astype(np.float32) for w in weights], parts, parts)
    if parts == 1:
        return router
    held = np.arange(len(x)) % 8 == 0
    own, tests = x[~held], x[held][:512]
    graph = neighbour_graph(own, min(EDGES, len(own) - 1))
    part = balanced_parts(graph, parts)
    target = np.zeros((len(own), parts), np.float32)
    for c in [part, *part[graph].T]:
        target[np.arange(len(own)), c] += 1
    target /= target.sum(1, keepdims=True)
    unit = own / np.maximum(np.linalg.norm(own, axis=1, keepdims=True), 1e-30)
    w, moments, step = router.weights, [[np.zeros_like(a), np.zeros_like(a)] for a in router.weights], 0
    for epoch in range(EPOCHS):
        order = rng.permutation(len(own))
        for i in range(0, len(order), 64):
            b = order[i : i + 64]
            hidden = np.maximum(unit[b] @ w[0] + w[1], 0)
            z = hidden @ w[2] + w[3]
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            d = (p - target[b]) / len(b)
            back = (d @ w[2].T) * (hidden > 0)
            step += 1
            for a, m, g in zip(w, moments, (unit[b].T @ back, back.sum(0), hidden.T @ d, d.sum(0)), strict=True):
                m[0] += 0.1 * (g - m[0])
                m[1] += 0.001 * (g * g - m[1])
                a -= 0.003 * (1 - epoch / EPOCHS) * (m[0] / (1 - 0.9**step)) / (np.sqrt(m[1] / (1 - 0.999**step)) + 1e-8)
    filed = router.scores(own).argmax(1)
    near = np.argsort(-(tests @ own.T), axis=1, kind="stable")[:, :k]
    rank = np.empty((len(tests), parts), np.int64)
    np.put_along_axis(rank, np.argsort(-router.scores(tests), axis=1, kind="stable"), np.arange(parts)[None, :].repeat(len(tests), 0), axis=1)
    found = np.take_along_axis(rank, filed[near], axis=1)
    router.probes = next((m for m in range(1, parts + 1) if (found < m).mean() >= RECALL), parts)
    return router


def usable(vector: Column, length: int | None = None) -> Column:
    """Whether a vector takes part."""
    x = vector.cast("array<double>")
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    good = vector.isNotNull() & finite & F.exists(x, lambda v: v != 0)
    return F.coalesce(good if length is None else good & (F.size(vector) == length), F.lit(False))


def _matrix(column: pa.Array, length: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, length)


def nearest_in_block(ids: np.ndarray, x: np.ndarray, q_ids: np.ndarray, q: np.ndarray, bound: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each query its k nearest ids of the block and their scores, best first; ids are ascending.

    Scores below a query's bound are left out.
    """
    head = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]]))
    names = ids[head]
    single = len(head) == len(ids)
    for i in range(0, len(q), 256):
        rough = q[i : i + 256] @ x.T
        if not single:
            rough = np.maximum.reduceat(rough, head, axis=1)
        rough[q_ids[i : i + 256, None] == names[None, :]] = -np.inf
        m = min(k, rough.shape[1])
        edge = np.maximum(-np.partition(-rough, m - 1, axis=1)[:, m - 1], bound[i : i + 256])
        for j in range(len(rough)):
            slack = 1e-12 * max(1.0, float(np.abs(rough[j][np.isfinite(rough[j])]).max(initial=0)))
            pick = np.flatnonzero((rough[j] >= edge[j] - slack) & np.isfinite(rough[j]))
            if single:
                exact = (x[pick] * q[i + j]).sum(1)
            else:
                ends = np.append(head[1:], len(ids))
                exact = np.array([(x[head[c] : ends[c]] * q[i + j]).sum(1).max() for c in pick])
            best = np.lexsort((names[pick], -exact))[:k] if len(pick) else pick
            yield q_ids[i + j], names[pick][best], exact[best] if len(pick) else np.zeros(0)


def _searched(length: int, k: int):
    """Turns rows (cell, is_query, id, vector, bound), sorted so, into (query_id, vec_id, score)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        names = ["query_id", "vec_id", "score"]

        def cell(t: pa.Table) -> Iterator[pa.RecordBatch]:
            t = t.combine_chunks()
            asks = t.column("is_query").to_numpy()
            n = len(asks) - int(asks.sum())
            if not 0 < n < len(asks):
                return
            ids, x = t.column("id").to_numpy(), _matrix(t.column("vector").combine_chunks(), length)
            found = [(np.full(len(v), a), v, s) for a, v, s in nearest_in_block(ids[:n], x[:n], ids[n:], x[n:], t.column("bound").to_numpy()[n:], k)]
            cols = [np.concatenate(c) for c in zip(*found, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0]), pa.array(cols[1]), pa.array(cols[2], pa.float64())], names=names)

        for b in batches:
            cells = b.column(0).to_numpy()
            cut = np.concatenate([[0], np.flatnonzero(np.diff(cells)) + 1, [len(cells)]])
            for a, e in zip(cut[:-1], cut[1:], strict=True):
                if a == e:
                    continue
                piece = pa.Table.from_batches([b.slice(a, e - a)])
                if held and held[0].column(0)[0].as_py() != cells[a]:
                    yield from cell(pa.concat_tables(held))
                    held = []
                held.append(piece)
        if held:
            yield from cell(pa.concat_tables(held))

    return run


def search(vectors: DataFrame, is_query: Column, k: int = 20, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score) for each row that is_query holds for, against all others."""
    spark = vectors.sparkSession
    rows = vectors.select(F.col(key).cast("long").alias("id"), F.col(vector).alias("vector"), F.coalesce(is_query, F.lit(False)).alias("is_query")).filter("id is not null")
    sizes = rows.filter(usable(F.col("vector"))).groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), "n").first()
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if sizes is None:
        return empty
    length, total = sizes["n"], sizes["count"]
    rows = rows.filter(usable(F.col("vector"), length))
    order = F.xxhash64("id", F.lit(SEED))
    drawn = rows.select("id", "vector", order.alias("o")).orderBy("o", "id", "vector").limit(SAMPLE).select("id", "vector").toPandas().drop_duplicates("id")
    x = np.array([np.asarray(v, np.float64) for v in drawn["vector"]]).reshape(-1, length)
    router = fit(x, total, k)
    router.ids, router.vectors, router.filed = drawn["id"].to_numpy(), x, router.scores(x.astype(np.float32)).argmax(1)
    shared = spark.sparkContext.broadcast(router)
    kind = dict(rows.dtypes)["vector"]

    def routed(n: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            r = shared.value
            for b in batches:
                x = _matrix(b.column(1), length)
                best = np.argsort(-r.scores(x.astype(np.float32)), axis=1, kind="stable")[:, :n]
                bound = r.bounds(b.column(0).to_numpy(), x, best[:, : r.probes], k) if n > 1 else np.full(len(x), -np.inf)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(list(best.astype(np.int32)), pa.list_(pa.int32())), pa.array(bound)], names=["id", "vector", "parts", "bound"])

        return run

    filed = rows.select("id", "vector").mapInArrow(routed(1), f"id long, vector {kind}, parts array<int>, bound double")
    filed = written(filed.select("id", "vector", F.col("parts")[0].alias("part")), "filed")
    asked = rows.filter("is_query").groupBy("id").agg(F.min("vector").alias("vector"))
    asked = written(asked.mapInArrow(routed(router.parts), f"id long, vector {kind}, parts array<int>, bound double"), "asked")

    def found(queries: DataFrame, probes: int) -> DataFrame:
        queries = queries.select("id", "vector", "bound", F.explode(F.slice("parts", 1, probes)).alias("part"))
        n = filed.groupBy("part").agg(F.ceil(F.count("*") / ROW_BLOCK).cast("int").alias("row_blocks"))
        m = queries.groupBy("part").agg(F.ceil(F.count("*") / QUERY_BLOCK).cast("int").alias("query_blocks"))
        blocks = written(n.join(m, "part"), "blocks")
        own = lambda c: F.pmod(F.xxhash64("id", F.lit(1)), F.col(c)).cast("int")
        all_ = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
        a = filed.join(blocks, "part").select("part", own("row_blocks").alias("r"), all_("query_blocks").alias("q"), F.lit(False).alias("is_query"), "id", "vector", F.lit(None).cast("double").alias("bound"))
        b = queries.join(blocks, "part").select("part", all_("row_blocks").alias("r"), own("query_blocks").alias("q"), F.lit(True).alias("is_query"), "id", "vector", "bound")
        cells = a.unionByName(b).select(F.xxhash64("part", "r", "q").alias("cell"), "is_query", "id", "vector", "bound")
        cells = cells.repartition("cell").sortWithinPartitions("cell", "is_query", "id")
        near = cells.mapInArrow(_searched(length, k), "query_id long, vec_id long, score double")
        near = near.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
        best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        return near.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)

    out = written(found(asked, router.probes), "nearest")
    if router.probes < router.parts:
        short = asked.join(out.filter(F.col("rank") == k).select(F.col("query_id").alias("id")), "id", "left_anti")
        if not short.isEmpty():
            again = found(short.withColumn("bound", F.lit(float("-inf"))), router.parts)
            out = out.join(short.select(F.col("id").alias("query_id")), "query_id", "left_anti").unionByName(again)
    return out.select("query_id", "rank", "vec_id", "score")
