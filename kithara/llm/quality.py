"""Quality: a convolutional network over bytes, trained in numpy.

Each byte has a learned embedding of DIM numbers. Learned filters of WIDTH bytes stand at every byte; their
maxima over each chunk of 2 HOP bytes, a chunk at every HOP bytes, are a chunk's features, so chunks
overlap by half and cover the whole document, however long. The means and the maxima of the features over all
chunks go through one hidden layer into one probability. The means tell how much of a document
looks a certain way, and where few filters find anything the text repeats itself.

It learns from whole texts, drawn by hash in equal numbers of each class; the sample is bounded by its bytes
(SAMPLE texts of each class, SAMPLE_BYTES in all, LONGEST each, at most). A quarter of it is not trained on but sets the
scale of the scores to the true shares of the classes. Only the text is an input of a score; scoring
reads whole texts, in windows of SLICE bytes.

Defined results: a null or empty text is scored as one chunk of padding, a very long one by all its chunks;
labels that are null count for nothing and a text labelled both ways is of low quality; of the texts of one id
the least is learned from; with only one class labelled, every score is that class's smoothed share; ties do not
arise (scores are by text) and repeated rows are scored alike; an empty table gives an empty result; an input
column named like the added one is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from kithara.llm.toxicity import _scaled, _sigmoid
from kithara.llm.words import byte_buffer
from kithara.session import free_of, written

#: Texts of each class that a model is fitted to, at most, their bytes, and the bytes of one such text.
SAMPLE, SAMPLE_BYTES, LONGEST = 3000, 4 << 20, 256 << 10
DIM, WIDTH, FILTERS, HIDDEN = 8, 8, 32, 16
#: Bytes from one chunk to the next; a chunk has twice as many.
HOP = 128
PAD = 256  # the symbol around texts
EPOCHS, BATCH_BYTES, RATE, SEED = 6, 48 << 10, 0.02, 5
#: Bytes that are convolved at once.
SLICE = 256 << 10


@dataclass
class Model:
    params: dict[str, np.ndarray] = field(default_factory=dict)
    scale: tuple[float, float] = (1.0, 0.0)
    constant: float | None = None


def laid_out(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The symbols of texts, each after WIDTH - 1 of padding and padded to whole hops, and the hop each begins with.

    The padding before the next text ends the windows that begin in a text's last symbols.
    """
    size = np.diff(off)
    hops = -(-(size + WIDTH - 1) // HOP)
    first = np.concatenate([[0], np.cumsum(hops)])
    out = np.full(first[-1] * HOP + WIDTH, PAD, np.int16)
    place = np.arange(len(raw)) + np.repeat(first[:-1] * HOP + WIDTH - 1 - (off[:-1] - off[0]), size)
    out[place] = raw
    return out, first


def hop_maxima(p: dict[str, np.ndarray], symbols: np.ndarray, where: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
    """For each hop and filter the maximum over the windows that begin in the hop; where: and which window has it."""
    x = p["bytes"][symbols].ravel()
    hops, rows = (len(symbols) - WIDTH) // HOP, HOP // WIDTH
    filters = p["filters"]
    best = np.full((hops, FILTERS), -np.inf, np.float32)
    at = np.zeros((hops, FILTERS), np.int64) if where else None
    for phase in range(WIDTH):  # windows that begin at this phase lie one after another
        windows = x[phase * DIM : phase * DIM + hops * HOP * DIM].reshape(-1, WIDTH * DIM) @ filters
        windows = windows.reshape(hops, rows, FILTERS)
        if where:
            k = windows.argmax(1)
            top = np.take_along_axis(windows, k[:, None], 1)[:, 0]
            better = top > best
            at[better] = (np.arange(hops)[:, None] * HOP + k * WIDTH + phase)[better]
            np.maximum(best, top, out=best)
        else:
            np.maximum(best, windows.max(1), out=best)
    return best, at


def chunk_bounds(first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first hop of each chunk, and the chunk each text begins with; a text of one hop is one chunk."""
    hops = np.diff(first)
    chunks = np.maximum(hops - 1, 1)
    begin = np.concatenate([[0], np.cumsum(chunks)])
    return np.arange(begin[-1]) + np.repeat(first[:-1] - begin[:-1], chunks), begin


def _dense(p: dict[str, np.ndarray], pooled: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    hidden = np.maximum(pooled @ p["hidden"] + p["hidden_bias"], 0)
    return hidden, hidden @ p["out"] + p["out_bias"][0]


def pooled_features(p: dict[str, np.ndarray], best: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Means and maxima over each text's chunks of the features, the chunks' maxima."""
    start, begin = chunk_bounds(first)
    after = np.minimum(start + 1, np.repeat(first[1:] - 1, np.diff(begin)))
    f = np.maximum(np.maximum(best[start], best[after]) + p["bias"], 0)
    mean = np.add.reduceat(f, begin[:-1]) / np.diff(begin)[:, None]
    return np.concatenate([mean, np.maximum.reduceat(f, begin[:-1])], axis=1)


def logits(m: Model, raw: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Of all texts raw[off[i] : off[i + 1]]; convolved SLICE bytes at a time."""
    symbols, first = laid_out(raw, off)
    step = SLICE // HOP
    best = [hop_maxima(m.params, symbols[a * HOP : min(a + step, first[-1]) * HOP + WIDTH])[0] for a in range(0, int(first[-1]), step)]
    return _dense(m.params, pooled_features(m.params, np.concatenate(best), first))[1]


def score_texts(m: Model, texts: pa.Array) -> np.ndarray:
    if m.constant is not None or not len(texts):
        return np.full(len(texts), m.constant or 0.0)
    raw, off = byte_buffer(texts)
    z = np.empty(len(texts))
    i = 0
    while i < len(texts):
        j = max(i + 1, int(np.searchsorted(off, off[i] + 4 * SLICE, "right")) - 1)
        z[i:j] = logits(m, raw[off[i] : off[j]], off[i : j + 1] - off[i])
        i = j
    return _sigmoid(m.scale[0] * z + m.scale[1])


def started(seed: int = SEED) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    normal = lambda scale, *shape: rng.normal(0, scale, shape).astype(np.float32)
    p = {"bytes": normal(0.5, 257, DIM), "filters": normal(0.25, WIDTH * DIM, FILTERS), "bias": np.zeros(FILTERS, np.float32)}
    p |= {"hidden": normal(0.2, 2 * FILTERS, HIDDEN), "hidden_bias": np.zeros(HIDDEN, np.float32), "out": normal(0.3, HIDDEN), "out_bias": np.zeros(1, np.float32)}
    return p


def gradients(p: dict[str, np.ndarray], raw: np.ndarray, off: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
    """Of the mean log loss over some texts."""
    symbols, first = laid_out(raw, off)
    best, at = hop_maxima(p, symbols, where=True)
    start, begin = chunk_bounds(first)
    count = np.diff(begin)
    after = np.minimum(start + 1, np.repeat(first[1:] - 1, count))
    second = best[after] > best[start]
    window = np.where(second, at[after], at[start])
    f = np.maximum(np.where(second, best[after], best[start]) + p["bias"], 0)
    mean, top = np.add.reduceat(f, begin[:-1]) / count[:, None], np.maximum.reduceat(f, begin[:-1])
    pooled = np.concatenate([mean, top], axis=1)
    hidden, z = _dense(p, pooled)
    delta = ((_sigmoid(z) - y) / len(y)).astype(np.float32)
    g = {"out": hidden.T @ delta, "out_bias": delta.sum(keepdims=True)}
    back = delta[:, None] * p["out"] * (hidden > 0)
    g |= {"hidden": pooled.T @ back, "hidden_bias": back.sum(0)}
    back = back @ p["hidden"].T
    of = np.repeat(np.arange(len(y)), count)
    grad = (back[:, :FILTERS] / count[:, None])[of]
    is_top = f == top[of]
    shared = np.add.reduceat(is_top.astype(np.float32), begin[:-1])  # equal maxima share the gradient
    grad = (grad + is_top * (back[:, FILTERS:] / shared)[of]) * (f > 0)
    g["bias"] = grad.sum(0)
    chunk, filt = np.nonzero(grad)
    value = grad[chunk, filt].astype(np.float32)
    seen = symbols[window[chunk, filt][:, None] + np.arange(WIDTH)]
    filters = np.zeros((FILTERS, WIDTH * DIM), np.float32)
    order = np.argsort(filt, kind="stable")
    ends = np.searchsorted(filt[order], np.arange(FILTERS + 1))
    table = np.zeros((257, DIM), np.float32)
    for k in range(FILTERS):
        own = order[ends[k] : ends[k + 1]]
        if len(own):
            filters[k] = value[own] @ p["bytes"][seen[own]].reshape(len(own), -1)
            for w in range(WIDTH):
                weight = np.bincount(seen[own, w], value[own], 257).astype(np.float32)
                table += weight[:, None] * p["filters"][w * DIM : (w + 1) * DIM, k]
    g |= {"filters": filters.T, "bytes": table}
    return g


def _trained(texts: list[np.ndarray], y: np.ndarray) -> dict[str, np.ndarray]:
    """Adam over batches of about BATCH_BYTES bytes, in a seeded order."""
    rng, p = np.random.default_rng(SEED), started()
    one, two = ({k: np.zeros_like(v) for k, v in p.items()} for _ in range(2))
    size = np.array([len(t) + HOP for t in texts])
    total = EPOCHS * (int(size.sum()) // BATCH_BYTES + 1)
    t = 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(texts))
        batch = np.cumsum(size[order]) // BATCH_BYTES
        for own in np.split(order, np.flatnonzero(np.diff(batch)) + 1):
            t += 1
            off = np.concatenate([[0], np.cumsum([len(texts[i]) for i in own])])
            g = gradients(p, np.concatenate([texts[i] for i in own]), off, y[own])
            rate = RATE * max(0.05, 1 - t / total) * np.sqrt(1 - 0.99**t) / (1 - 0.9**t)
            for k, v in p.items():
                one[k] = 0.9 * one[k] + 0.1 * g[k]
                two[k] = 0.99 * two[k] + 0.01 * g[k] ** 2
                v -= rate * one[k] / (np.sqrt(two[k]) + 1e-6)
    return p


def fit(texts: list[bytes], good: np.ndarray, counts: tuple[int, int]) -> Model:
    """A model from sampled texts in hash order; counts: labelled texts of low and of good quality in all."""
    if min(good.sum(), (1 - good).sum()) < 2:
        return Model(constant=(counts[1] + 0.5) / (sum(counts) + 1))
    nth = np.zeros(len(good), int)
    for c in (0, 1):
        nth[good == c] = np.arange((good == c).sum())
    held = nth % 4 == 1
    raw = [np.frombuffer(t, np.uint8) for t in texts]
    m = Model(_trained([t for t, x in zip(raw, held, strict=True) if not x], good[~held].astype(np.float32)))
    z = np.array([logits(m, t, np.array([0, len(t)]))[0] for t, x in zip(raw, held, strict=True) if x], float)
    y = good[held].astype(float)
    weight = np.where(y > 0, counts[1] / max(y.sum(), 1), counts[0] / max((1 - y).sum(), 1)) * len(y) / sum(counts)
    m.scale = _scaled(z, y, weight)
    return m


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", learn: Column | None = None, sample: int = SAMPLE, sample_bytes: int = SAMPLE_BYTES) -> Model:
    """Fit to labelled documents; learn: a condition on `labels` that says which may be used."""
    labels = labels if learn is None else labels.filter(learn)
    known = labels.filter(F.col(label).isNotNull() & F.col(key).isNotNull()).groupBy(F.col(key).alias("_key")).agg(F.min((F.col(label) > 0).cast("int")).alias("_good"))
    sized = docs.select(F.col(key).alias("_key"), F.octet_length(F.coalesce(text, F.lit(""))).alias("_size")).join(known, "_key").groupBy("_key", "_good").agg(F.max("_size").alias("_size"))
    sized = written(sized.withColumn("_order", F.xxhash64("_key", F.lit(SEED))), "labelled")
    counts = {r["_good"]: r["n"] for r in sized.groupBy("_good").agg(F.count("*").alias("n")).collect()}
    few = [sized.filter((F.col("_good") == c) & (F.col("_size") <= LONGEST)).orderBy("_order", "_key").limit(sample) for c in (0, 1)]
    upto = Window.partitionBy("_good").orderBy("_order", "_key")  # over `sample` rows at most
    ids = few[0].unionByName(few[1]).withColumn("_upto", F.sum(F.col("_size").cast("long")).over(upto)).filter(F.col("_upto") <= sample_bytes)
    ids = written(ids.select("_key", "_good", "_order"), "sample")
    found = docs.select(F.col(key).alias("_key"), F.coalesce(F.col(text), F.lit("")).alias("_text")).join(F.broadcast(ids), "_key")
    got = found.groupBy("_key", "_good", "_order").agg(F.min("_text").alias("_text")).toPandas().sort_values(["_order", "_key"])
    return fit([t.encode() for t in got["_text"]], got["_good"].to_numpy(dtype=int), (counts.get(0, 0), counts.get(1, 0)))


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """All rows with their columns and quality_score."""
    docs = free_of(docs, ["quality_score"])
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = docs.columns
    at, schema = names.index(text), docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(score_texts(shared.value, b.column(at)))], names=[*names, "quality_score"])

    return docs.mapInArrow(run, StructType([*schema.fields, StructField("quality_score", DoubleType())]))
