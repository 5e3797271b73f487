"""SimHash near-duplicates with pigeonring filtering.

A fingerprint is cut into five consecutive segments on a ring. If two fingerprints differ in at
most 4 bits, then for some first segment every chain of 1, 2, ... 5 consecutive segments from it
differs in at most its proportional share of the budget: 0, 1, 2, 3, 4 bits (Qin and Xiao,
"Pigeonring", 2018). So only fingerprints that agree in a whole segment meet; the chains then prune
them before the full Hamming check. With many fingerprints the second link of the chain (at most
one differing bit) becomes part of the key as well, as a segment with one bit masked.

Equal fingerprints are one row from the start. A bucket gives only edges that span what it links,
never all pairs. A bucket of many fingerprints is dealt to tasks as pairs of blocks, so no task
holds more than two blocks, and no pair is lost.

Nothing is gathered by component. Names of components, one row each, are written before they are
joined with their members, so that adaptive execution can split the partition of a large one.

Defined results: a null or empty text has fingerprint zero, which links like any other; a text of
fewer words than a shingle is one shingle, and a very long one counts whole; a bit that is set in
just half of the shingles is 0; rows with a null id take part but never name a component; repeated
rows are kept; an empty table gives an empty result; input columns named like the added ones are
replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kithara.llm.words import Words, byte_buffer, slices, xxh64
from kithara.operators.components import connected_components
from kithara.session import free_of, written

#: Bits of the five segments, from the lowest.
SEGMENTS = (13, 13, 13, 13, 12)
OFFSETS = (0, 13, 26, 39, 52)
BITS = 4
#: Fingerprints that a bucket should hold; above MEAN on average, keys use two links of the chain.
MEAN, BLOCK = 64, 2048

_SPREAD = np.array([[(b >> j) & 1 for j in range(8)] for b in range(256)], np.uint8).view("<u8").ravel()
_MASKS = np.array([((1 << n) - 1) << o for n, o in zip(SEGMENTS, OFFSETS, strict=True)], np.uint64)


def _votes(hashes: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Set bits by position over hashes[at[i]:at[i+1]], for each i."""
    runs = np.unique(np.concatenate([at[:-1], np.concatenate([np.arange(a, b, 255) for a, b in zip(at[:-1], at[1:], strict=True)])]))
    sums = np.add.reduceat(_SPREAD[hashes.view(np.uint8).reshape(-1, 8)], runs, axis=0)
    each = sums.view(np.uint8).reshape(len(runs), 64)
    return np.add.reduceat(each, np.searchsorted(runs, at[:-1]), axis=0, dtype=np.int64)


def fingerprints(texts: pa.Array, shingle: int = 4, seed: int = 42) -> np.ndarray:
    """The 64-bit SimHash of each text."""
    raw, off = byte_buffer(texts)
    out = np.zeros(len(texts), np.uint64)
    for i, j in slices(off):
        w = Words(raw[off[i] : off[j]], off[i : j + 1] - off[i], joined=True)
        n = np.diff(w.first)
        full = n > 0
        count = np.where(n >= shingle, n - shingle + 1, 1)[full]
        if not len(count):
            continue
        at = np.concatenate([[0], np.cumsum(count)])
        head = np.repeat(w.first[:-1][full] - at[:-1], count) + np.arange(at[-1])
        tail = head + np.repeat(np.minimum(n[full], shingle) - 1, count)
        votes = _votes(xxh64(w.low, w.start[head], w.end[tail], seed), at)
        bits = votes * 2 > count[:, None]
        out[i:j][full] = np.packbits(bits, axis=1, bitorder="little").view("<u8").ravel()
    return out


def with_fingerprint(docs: DataFrame, text: str = "text", shingle: int = 4, keep: tuple = ("doc_id",)) -> DataFrame:
    """The columns `keep` and fp, the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = pa.array(fingerprints(b.column(len(keep)), shingle).view(np.int64))
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], fp], names=[*keep, "fp"])

    docs = docs.select(*keep, F.col(text).alias("text_"))
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields[: len(keep)])
    return docs.mapInArrow(run, f"{types}, fp long")


def _keys(deep: bool) -> F.Column:
    """All keys of a fingerprint; the lowest three bits of a key say which segment begins the chain."""
    part = lambda i: F.shiftrightunsigned("fp", OFFSETS[i]).bitwiseAND((1 << SEGMENTS[i]) - 1)
    keys = []
    for i in range(5):
        first, j = F.shiftleft(part(i), 3).bitwiseOR(F.lit(i).cast("long")), (i + 1) % 5
        if not deep:
            keys.append(first)
            continue
        for bit in range(SEGMENTS[j]):
            second = part(j).bitwiseAND(((1 << SEGMENTS[j]) - 1) & ~(1 << bit))
            keys.append(F.shiftleft(F.shiftleft(second, 4).bitwiseOR(F.lit(bit).cast("long")), 16).bitwiseOR(first))
    return F.array(*keys)


def _near(one: np.ndarray, all_: np.ndarray, first: int) -> np.ndarray:
    """Which pairs pass every link of the chain from segment `first`; the last link is the full check."""
    x = one ^ all_
    passed = np.ones(x.shape, bool)
    mask = np.uint64(0)
    for k in range(1, 5):
        mask |= _MASKS[(first + k) % 5]
        passed &= np.bitwise_count(x & mask) <= k
        if not passed.any():
            break
    return passed & (np.bitwise_count(x) <= BITS)


def _span(fps: np.ndarray, first: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Edges that connect whatever is linked within one bucket: fewer than its fingerprints."""
    linked = np.zeros(len(fps), bool)
    for i in range(0, len(fps), 256):
        near = _near(fps[i : i + 256, None], fps[None, :], first)
        linked[i : i + 256] |= near.sum(1) > 1
    open_, edges = fps[linked], []
    while len(open_):
        front, open_ = [open_[0]], open_[1:]
        while front and len(open_):
            one = front.pop()
            near = _near(np.array([one]), open_, first)
            if near.any():
                found = open_[near]
                edges.append((np.full(len(found), one), found))
                front.extend(found)
                open_ = open_[~near]
    return edges


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges from rows (key, cell, fp) that come sorted by cell; one cell is held at a time."""

    def edges(cells: np.ndarray, keys: np.ndarray, fps: np.ndarray) -> pa.RecordBatch | None:
        cut = np.concatenate([[0], np.flatnonzero(np.diff(cells)) + 1, [len(cells)]])
        found = [e for a, b in zip(cut[:-1], cut[1:], strict=True) if b - a > 1 for e in _span(np.unique(fps[a:b]), int(keys[a] & 7))]
        if not found:
            return None
        src, dst = (np.concatenate(x).view(np.int64) for x in zip(*found, strict=True))
        return pa.RecordBatch.from_arrays([pa.array(src), pa.array(dst)], names=["src", "dst"])

    held = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)]
    for b in batches:
        new = [b.column(i).to_numpy(zero_copy_only=False) for i in range(3)]
        new[2] = new[2].view(np.uint64)
        rows = [np.concatenate(x) for x in zip(held, new, strict=True)]
        last = np.searchsorted(rows[0], rows[0][-1]) if len(rows[0]) else 0
        if last and (out := edges(*(x[:last] for x in (rows[0], rows[1], rows[2])))):
            yield out
        held = [x[last:] for x in rows]
    if len(held[0]) and (out := edges(*held)):
        yield out


def links(fps: DataFrame) -> DataFrame:
    """Edges (src, dst) between distinct fingerprints `fp`, spanning all that differ in at most 4 bits."""
    total = fps.count()
    keyed = fps.select("fp", F.explode(_keys(total > MEAN << 13)).alias("key"))
    sizes = keyed.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    hot = written(sizes.filter(F.col("n") > BLOCK).select("key", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks")), "hot_buckets")
    keyed = keyed.join(hot, "key", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    keyed = keyed.withColumn("own", F.pmod(F.xxhash64("fp", F.lit(3)), F.col("blocks")).cast("int"))
    keyed = keyed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    # The cell of the pair of blocks (i, j), i <= j, of a bucket is named by a hash of all three.
    cell = F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other")).alias("cell")
    keyed = keyed.select(cell, "key", "fp").repartition("cell").sortWithinPartitions("cell", "key")
    return keyed.mapInArrow(_cells, "src long, dst long")


def _rooted(docs: DataFrame, key: str, text: str) -> tuple[DataFrame, DataFrame]:
    """Rows (key, same, fp) with `same` a hash of the text, and the root of each fp."""
    slim = docs.select(F.col(key).alias("key"), F.xxhash64(text).alias("same"), text)
    rows = written(with_fingerprint(slim, text, keep=("key", "same")), "fingerprints")
    nodes = rows.select("fp").distinct()
    stars = connected_components(links(written(nodes, "distinct")))
    roots = nodes.join(stars.withColumnRenamed("node", "fp"), "fp", "left")
    return rows, written(roots.select("fp", F.coalesce("root", "fp").alias("root")), "roots")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row a document: `key`, fp, component_id (least key that links reach, own one included)."""
    rows, roots = _rooted(docs, key, text)
    least = rows.groupBy("fp").agg(F.min("key").alias("least")).join(roots, "fp")
    names = written(least.groupBy("root").agg(F.min("least").alias("component_id")), "names")
    nodes = written(roots.join(names, "root").select("fp", "component_id"), "components")
    # A fingerprint that a third of all rows have is one key of this join; the other side has one row for it.
    return rows.join(nodes, "fp").select(F.col("key").alias(key), "fp", "component_id")


def representatives(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One document of each group of near-duplicates, with all its columns: that of the least key.

    Of rows that repeat key and text, one stays. A null key comes after all others.
    """
    docs = free_of(docs, ["_same"])
    rows, roots = _rooted(docs, key, text)
    own = F.struct(F.col("key").isNull().alias("none"), "key", "same")
    least = rows.groupBy("fp").agg(F.min(own).alias("own")).join(roots, "fp")
    leaders = least.groupBy("root").agg(F.min("own").alias("own")).select(F.col("own.key").alias("_key"), F.col("own.same").alias("_same"))
    leaders = written(leaders, "leaders")
    docs = docs.withColumn("_same", F.xxhash64(text))
    kept = docs.join(leaders.withColumnRenamed("_same", "_as"), F.col(key).eqNullSafe(F.col("_key")) & (F.col("_same") == F.col("_as")), "left_semi")
    single = rows.groupBy("key", "same").count().filter("count > 1").isEmpty()
    return (kept if single else kept.dropDuplicates([key, "_same"])).drop("_same")
