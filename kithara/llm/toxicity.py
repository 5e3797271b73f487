"""Toxicity: a convolutional text classifier over hashed word embeddings, trained in numpy.

A word (ASCII letters and digits and non-ASCII bytes, lower-cased) takes the sum of two rows of two
hashed tables, so that a rare word shares both rows with another almost never. Filters of widths 1,
2 and 3 run over the words of a whole text, each keeps its maximum, and a logistic layer reads the
maxima. The first dimension of the tables starts from how much more often toxic texts hold the
word than clean ones; gradient steps (Adagrad) then fit everything.

Every labelled text is learned from, whole, and none reaches the driver. Texts are packed once into blocks of about
BLOCK texts, dealt and ordered by a hash. Counts of words go over all blocks. In each of EPOCHS rounds a task goes through
each of its blocks from the model so far, and each number of the model moves by its mean change over the blocks that
changed it. Sums are of whole numbers, so a model depends neither on the tasks nor on the order they end in; what goes to the
driver is as large as the model. A quarter of the labelled texts is not trained on but sets the scale of the scores
(logistic calibration) and a threshold for each language, from counts of all its outputs in steps of 1 / STEPS.
Labels, ids, languages and sources are never inputs of a score. Scoring reads whole texts.

Defined results: a null or empty text is scored like a text of padding only, a very long one by all
its words; labels that are null count for nothing and a text labelled both ways is toxic; of the texts
of one id the least is learned from; with only one class labelled, every score is that class's smoothed
share; a score that equals its threshold rejects; repeated rows are scored alike; an empty table gives
an empty result; input columns named like the added ones are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from kithara.llm.words import BY_ALNUM, Words, byte_buffer, slices, xxh64
from kithara.operators.ranges import ranked_in_ranges
from kithara.session import free_of, written

#: Texts of a block, about; a block ends before it holds more words than these (a longer text is a block of its own).
BLOCK, BLOCK_WORDS = 1024, 1 << 20
#: Words that `excerpt` leaves of a text, at most, and how many of them follow each other.
WORDS_A_TEXT, RUN = 2048, 64
#: Numbers that tasks sum at once, steps of a number of the model that is summed, and of an output that is counted.
PIECE, UNIT, STEPS = 1 << 16, 1 << 24, 1000
#: Bits that tell which texts may have a label.
MARKS = 1 << 24
ROWS, DIM = 1 << 17, 8
WIDTHS = ((1, 16), (2, 8), (3, 8))
GAP = 2  # padding words before each text and after the last, so that no window spans two texts
EPOCHS, BATCH, RATE, SEED = 8, 32, 0.2, 3


@dataclass
class Model:
    tables: tuple[np.ndarray, np.ndarray]
    filters: list[np.ndarray]  # for each width (width, DIM, filters)
    biases: list[np.ndarray]
    out: np.ndarray
    out_bias: float
    scale: tuple[float, float]
    thresholds: dict[str, float]
    threshold: float
    constant: float | None = None


def word_hashes(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """For ranges i to j of the texts: the hash of each word and which word each text begins with."""
    raw, off = byte_buffer(texts)
    for i, j in slices(off, 512 << 10):
        w = Words(raw[off[i] : off[j]], off[i : j + 1] - off[i], BY_ALNUM)
        yield i, j, xxh64(w.low, w.start, w.end), w.first


def excerpt(words: np.ndarray) -> np.ndarray:
    """For callers that must bound a text (`train` and `score` do not): All words of a text, or of a longer one runs at even distances, the first and last words among them."""
    if len(words) <= WORDS_A_TEXT:
        return words
    at = np.linspace(0, len(words) - RUN, WORDS_A_TEXT // RUN).astype(np.int64)
    return words[(at[:, None] + np.arange(RUN)).ravel()]


def _padded(hashes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of the two tables for each word and padding (row ROWS), and where each text begins."""
    n = len(first) - 1
    at = first + GAP * np.arange(n + 1)
    place = np.arange(len(hashes)) + GAP * np.repeat(np.arange(1, n + 1), np.diff(first))
    one, two = np.full(at[-1] + GAP, ROWS, np.int32), np.full(at[-1] + GAP, ROWS, np.int32)
    one[place] = (hashes & np.uint64(ROWS - 1)).astype(np.int32)
    two[place] = (hashes >> np.uint64(40) & np.uint64(ROWS - 1)).astype(np.int32)
    return one, two, at


def _convolved(m: Model, x: np.ndarray) -> list[np.ndarray]:
    wide = x @ np.concatenate([f[k] for f in m.filters for k in range(len(f))], axis=1)
    out, col = [], 0
    for f in m.filters:
        w, _, n = f.shape
        c = wide[:, col : col + n].copy()
        for k in range(1, w):
            c[:-k] += wide[k:, col + k * n : col + (k + 1) * n]
        out.append(c)
        col += w * n
    return out


def logits(m: Model, hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    one, two, at = _padded(hashes, first)
    x = m.tables[0][one] + m.tables[1][two]
    pooled = [np.maximum(np.maximum.reduceat(c[: at[-1]], at[:-1], axis=0) + b, 0) for c, b in zip(_convolved(m, x), m.biases, strict=True)]
    return np.concatenate(pooled, axis=1) @ m.out + m.out_bias


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def score_texts(m: Model, texts: pa.Array) -> np.ndarray:
    if m.constant is not None:
        return np.full(len(texts), m.constant)
    z = np.zeros(len(texts))
    for i, j, h, first in word_hashes(texts):
        z[i:j] = logits(m, h, first)
    return _sigmoid(m.scale[0] * z + m.scale[1])


def _holding(rows: np.ndarray, at: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """How many clean and how many toxic texts hold each row of a table."""
    text = np.repeat(np.arange(len(toxic)), np.diff(at))
    pairs = np.unique(text * (ROWS + 1) + rows[: at[-1]])
    return np.bincount(toxic[pairs // (ROWS + 1)].astype(np.int64) * (ROWS + 1) + pairs % (ROWS + 1), minlength=2 * (ROWS + 1)).reshape(2, -1)


def _log_odds(held: np.ndarray, clean: int, toxic: int) -> np.ndarray:
    """How much more often toxic texts hold a table row, shrunk by two standard errors towards 0."""
    c, p = held + 0.5
    odds = np.log(p / (toxic + 1)) - np.log(c / (clean + 1))
    shrunk = np.sign(odds) * np.maximum(np.abs(odds) - 2 * np.sqrt(1 / p + 1 / c), 0)
    shrunk[ROWS] = 0
    return np.clip(shrunk, -2, 2)


def _untrained(odds: list[np.ndarray]) -> Model:
    rng = np.random.default_rng(SEED)
    tables = tuple((rng.normal(0, 0.05, (ROWS + 1, DIM))).astype(np.float32) for _ in range(2))
    for k in range(2):
        tables[k][:, 0] = odds[k]
        tables[k][ROWS] = 0
    filters = [rng.normal(0, 0.3, (w, DIM, n)).astype(np.float32) for w, n in WIDTHS]
    biases = [np.zeros(n, np.float32) for _, n in WIDTHS]
    filters[0][0, :, 0] = 0
    filters[0][0, 0, 0] = 1
    out = rng.normal(0, 0.1, sum(n for _, n in WIDTHS)).astype(np.float32)
    out[0] = 2
    return Model(tables, filters, biases, out, -2.0, (1.0, 0.0), {}, 0.5)


def _numbers(m: Model) -> np.ndarray:
    """All that is trained of a model, in one row."""
    return np.concatenate([*(x.ravel() for x in (*m.tables, *m.filters, *m.biases, m.out)), np.array([m.out_bias], np.float32)])


def _with_numbers(m: Model, x: np.ndarray) -> Model:
    parts, at = [], 0
    for old in (*m.tables, *m.filters, *m.biases, m.out):
        parts.append(x[at : at + old.size].reshape(old.shape).astype(np.float32))
        at += old.size
    n = len(m.filters)
    return Model((parts[0], parts[1]), parts[2 : 2 + n], parts[2 + n : 2 + 2 * n], parts[-1], float(x[at]), m.scale, m.thresholds, m.threshold)


def _passed(m: Model, words: np.ndarray, first: np.ndarray, toxic: np.ndarray, nth: int) -> Model:
    """The model after its nth pass (Adagrad) through the texts of one block."""
    m, rng = _with_numbers(m, _numbers(m)), np.random.default_rng([SEED, nth])
    rows, begins = _padded(words, first)[:2], first + GAP * np.arange(len(first))
    tables, filters, biases, out = m.tables, m.filters, m.biases, m.out
    sums: dict[str, np.ndarray] = {}

    def step(name: str, value: np.ndarray, grad: np.ndarray) -> None:
        s = sums.setdefault(name, np.full_like(value, 1e-2))
        s += grad * grad
        value -= RATE * grad / np.sqrt(s)

    bias = np.array([m.out_bias], np.float32)
    order = rng.permutation(len(toxic))
    for a in range(0, len(order), BATCH):
        batch = order[a : a + BATCH]
        one, two = (np.concatenate([*(rows[k][begins[d] : begins[d + 1]] for d in batch), np.full(GAP, ROWS, np.int32)]) for k in range(2))
        at = np.concatenate([[0], np.cumsum([begins[d + 1] - begins[d] for d in batch])])
        x = tables[0][one] + tables[1][two]
        maps = _convolved(m, x)
        best = [np.stack([c[s:e].argmax(0) + s for s, e in zip(at[:-1], at[1:], strict=True)]) for c in maps]
        pooled = [np.take_along_axis(c, p, 0) + b for c, p, b in zip(maps, best, biases, strict=True)]
        features = np.maximum(np.concatenate(pooled, axis=1), 0)
        delta = ((_sigmoid(features @ out + bias[0]) - toxic[batch]) / len(batch)).astype(np.float32)
        back = delta[:, None] * out[None, :] * (features > 0)
        step("out", out, features.T @ delta)
        step("out_bias", bias, delta.sum(keepdims=True))
        col, at_rows, at_grads = 0, [], []
        for k, f in enumerate(filters):
            w, _, n = f.shape
            g, p = back[:, col : col + n], best[k]
            col += n
            grad = np.zeros_like(f)
            for j in range(w):
                q = p + j
                grad[j] = np.einsum("bf,bfd->df", g, x[q])
                live = g != 0
                at_rows.append(q[live])
                at_grads.append((g[:, :, None] * f[j].T[None])[live])
            step(f"f{k}", f, grad)
            step(f"b{k}", biases[k], g.sum(0))
        where, grads = np.concatenate(at_rows), np.concatenate(at_grads)
        for k, idx in ((0, one), (1, two)):
            used, inverse = np.unique(idx[where], return_inverse=True)
            g = np.zeros((len(used), DIM), np.float32)
            np.add.at(g, inverse, grads)
            g[used == ROWS] = 0
            s = sums.setdefault(f"t{k}", np.full_like(tables[k], 1e-2))
            s[used] += g * g
            tables[k][used] -= RATE * g / np.sqrt(s[used])
    m.out_bias = float(bias[0])
    return m


def _trained(docs: list[np.ndarray], toxic: np.ndarray) -> Model:
    """What `train` makes of the texts of a single block, before it is scaled."""
    words, first = np.concatenate(docs), np.concatenate([[0], np.cumsum([len(d) for d in docs])])
    one, two, at = _padded(words, first)
    m = _untrained([_log_odds(_holding(r, at, toxic), len(toxic) - int(toxic.sum()), int(toxic.sum())) for r in (one, two)])
    for nth in range(EPOCHS):
        m = _passed(m, words, first, toxic, nth)
    return m


def _scaled(z: np.ndarray, y: np.ndarray, weight: np.ndarray, counts: tuple[float, float] | None = None) -> tuple[float, float]:
    """Slope and intercept of a weighted logistic fit of y to z, with smoothed targets (Platt); counts: texts of
    label 0 and 1, where rows stand for several."""
    neg, pos = counts or ((1 - y).sum(), y.sum())
    target = np.where(y > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
    a, b = 1.0, 0.0
    x = np.stack([z, np.ones_like(z)], 1)
    for _ in range(50):
        p = _sigmoid(a * z + b)
        grad = x.T @ (weight * (p - target)) + np.array([1e-3 * (a - 1), 0])
        hess = (x * (weight * p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
        change = np.linalg.solve(hess, grad)
        change *= min(1, 2 / max(np.abs(change).max(), 1e-9))
        a, b = a - change[0], b - change[1]
    return max(float(a), 0.05), float(b)


def _best_threshold(p: np.ndarray, y: np.ndarray, weight: np.ndarray) -> float:
    """The threshold of the best weighted F1, in the middle (by log-odds) of the gap it lies in."""
    order = np.argsort(-p, kind="stable")
    p, y, w = p[order], y[order], weight[order]
    hit, said = np.cumsum(w * y), np.cumsum(w)
    f1 = 2 * hit / (said + (w * y).sum())
    f1[:-1][p[:-1] == p[1:]] = -1
    k = int(np.argmax(f1))
    low = p[k + 1] if k + 1 < len(p) else p[k] / 2
    mid = (np.log(p[k] / (1 - p[k])) + np.log(low / (1 - low))) / 2
    return float(_sigmoid(np.array(mid)))


def _blocks(found: DataFrame) -> DataFrame:
    """Rows (held, words, first, toxic, langs) of blocks, from texts (_held, _shard, _order, _key, _toxic, _lang, _text) dealt and
    ordered so: the hashes of all words, where each text begins in them, labels (a byte each) and languages."""

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, texts, size = None, [], 0

        def block() -> pa.RecordBatch:
            words, toxic, langs = zip(*texts, strict=True)
            first = np.concatenate([[0], np.cumsum([len(w) for w in words])]).astype(np.int64)
            row = [[now[0]], [np.concatenate(words).tobytes()], [first.tobytes()], [np.array(toxic, np.int8).tobytes()], [list(langs)]]
            kinds = [pa.bool_(), pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.string())]
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(row, kinds, strict=True)], names=["held", "words", "first", "toxic", "langs"])

        for b in batches:
            held, shard, toxic, lang = (b.column(k).to_pylist() for k in range(4))
            for i, j, h, first in word_hashes(b.column(4)):
                for t in range(i, j):
                    own, n = (held[t], shard[t]), int(first[t - i + 1] - first[t - i])
                    if texts and (own != now or size + n > BLOCK_WORDS):
                        yield block()
                        texts, size = [], 0
                    now, size = own, size + n
                    texts.append((h[first[t - i] : first[t - i + 1]].copy(), toxic[t], lang[t]))
        if texts:
            yield block()

    return found.select("_held", "_shard", "_toxic", "_lang", "_text").mapInArrow(packed, "held boolean, words binary, first binary, toxic binary, langs array<string>")


def _read(b: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, list]]:
    for r in b.to_pylist():
        yield np.frombuffer(r["words"], np.uint64), np.frombuffer(r["first"], np.int64), np.frombuffer(r["toxic"], np.int8).astype(np.float32), r["langs"]


def _summed(blocks: DataFrame, sums: int, size: int, of_block, made, dtype) -> list[tuple[int, np.ndarray]]:
    """What `made` makes (of `dtype`) of the places from which and of the `sums` rows of whole numbers that `of_block` adds up over all
    blocks, piece by piece of `size` places; pieces in which all is 0 are left out. Tasks are as many as cores and their sums meet in
    tasks again, so the driver gets what is made, once, however many blocks and tasks there are."""

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((sums, size), np.int64)
        for b in batches:
            for words, first, toxic, _ in _read(b):
                of_block(total, words, first, toxic)
        for i in range(0, size, PIECE):
            if total[:, i : i + PIECE].any():
                yield pa.RecordBatch.from_arrays([pa.array([i], pa.int64()), pa.array([total[:, i : i + PIECE].tobytes()], pa.binary())], names=["piece", "numbers"])

    def added(t: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x.as_py(), np.int64) for x in t.column("numbers")).reshape(sums, -1)
        return pa.table({"piece": t.column("piece")[:1], "numbers": pa.array([made(t.column("piece")[0].as_py(), total).astype(dtype).tobytes()], pa.binary())})

    schema = "piece long, numbers binary"
    few = blocks.coalesce(max(1, blocks.sparkSession.sparkContext.defaultParallelism)).mapInArrow(parts, schema)
    # As Arrow batches: rows would be held in the driver's heap, and again as they are pickled.
    got = few.groupBy("piece").applyInArrow(added, schema).toArrow()
    return [(at.as_py(), np.frombuffer(x.as_buffer(), dtype)) for at, x in zip(*got.columns, strict=True)]


def _learned(blocks: DataFrame, clean: int, toxic: int) -> Model:
    """A model from all blocks, which hold so many clean and toxic texts."""
    spark, n = blocks.sparkSession, 2 * (ROWS + 1)

    def held(total: np.ndarray, words: np.ndarray, first: np.ndarray, toxic: np.ndarray) -> None:
        one, two, at = _padded(words, first)
        for k, rows in enumerate((one, two)):
            total[0, k * n : (k + 1) * n] += _holding(rows, at, toxic).ravel()

    counts = np.zeros(2 * n, np.int64)
    for at, part in _summed(blocks, 1, 2 * n, held, lambda at, total: total[0], np.int64):
        counts[at : at + len(part)] = part
    m = _untrained([_log_odds(c, clean, toxic) for c in counts.reshape(2, 2, -1)])
    for nth in range(EPOCHS):
        numbers = _numbers(m)
        shared = spark.sparkContext.broadcast(m)

        def moved(total: np.ndarray, words: np.ndarray, first: np.ndarray, toxic: np.ndarray, shared=shared, nth=nth) -> None:
            by = _numbers(_passed(shared.value, words, first, toxic, nth)) - _numbers(shared.value)
            steps = np.rint(by.astype(np.float64) * UNIT).astype(np.int64)
            total[0] += steps
            total[1] += steps != 0

        def after(at: int, total: np.ndarray, shared=shared) -> np.ndarray:
            return _numbers(shared.value)[at : at + total.shape[1]] + total[0] / UNIT / np.maximum(total[1], 1)

        for at, part in _summed(blocks, 2, len(numbers), moved, after, np.float32):
            numbers[at : at + len(part)] = part
        shared.destroy()
        m = _with_numbers(m, numbers)
    return m


def _calibrated(m: Model, blocks: DataFrame) -> Model:
    """The model with the scale and thresholds that the texts of all blocks ask for."""
    spark = blocks.sparkSession
    shared = spark.sparkContext.broadcast(m)

    def outputs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for words, first, toxic, langs in _read(b):
                z = np.concatenate([logits(shared.value, words[first[i] : first[j]], first[i : j + 1] - first[i]) for i, j in slices(8 * first, 1 << 20)])
                steps = np.rint(np.clip(z, -40, 40) * STEPS).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(toxic.astype(np.int64)), pa.array(steps)], names=["lang", "toxic", "z"])

    told = written(blocks.mapInArrow(outputs, "lang string, toxic long, z long").groupBy("lang", "toxic", "z").agg(F.count("*").alias("n")), "outputs")
    each = told.groupBy("lang").agg(F.sum(F.col("n") * F.col("toxic")).alias("pos"), F.sum(F.col("n") * (1 - F.col("toxic"))).alias("neg"))
    # Languages with too few texts for a threshold of their own are told together.
    few = written(each.filter("pos >= 5 and neg >= 5").select("lang", F.col("lang").alias("own")), "languages")
    got = told.join(few, "lang", "left").groupBy("own", "toxic", "z").agg(F.sum("n").alias("n")).toArrow().to_pandas().sort_values(["z", "toxic", "own"], ignore_index=True)
    z, y, n = got["z"].to_numpy(float) / STEPS, got["toxic"].to_numpy(float), got["n"].to_numpy(float)
    m.scale = _scaled(z, y, n, ((n * (1 - y)).sum(), (n * y).sum()))
    p = np.clip(_sigmoid(m.scale[0] * z + m.scale[1]), 1e-9, 1 - 1e-9)
    m.threshold = _best_threshold(p, y, n)
    for x in sorted(set(got["own"].dropna())):
        of = (got["own"] == x).to_numpy()
        m.thresholds[x] = float((n[of].sum() * _best_threshold(p[of], y[of], n[of]) + 50 * m.threshold) / (n[of].sum() + 50))
    return m


def _maybe(rows: DataFrame, known: DataFrame) -> DataFrame:
    """Rows whose _key may be among those of `known`: all that are, and few others. Told by one bit of MARKS for a hash of
    each key, so what is broadcast is bounded (MARKS / 64 rows) and grows no further with the labels."""
    at = F.pmod(F.xxhash64(F.col("_key").cast("string"), F.lit(SEED + 2)), F.lit(MARKS))
    slot, bit = F.shiftright(at, 6).alias("_slot"), at.bitwiseAND(F.lit(63)).cast("int")
    marks = written(known.select(slot, bit.alias("_bit")).groupBy("_slot").agg(F.bit_or(F.expr("shiftleft(1L, _bit)")).alias("_bits")), "marks")
    near = rows.select("*", slot, bit.alias("_bit")).join(F.broadcast(marks), "_slot")
    return near.filter("shiftrightunsigned(_bits, _bit) & 1 = 1").drop("_slot", "_bit", "_bits")


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", label: str = "toxic", learn: F.Column | None = None) -> Model:
    """Fit to all labelled documents; learn: a condition on `labels` that says which may be used."""
    labels = labels if learn is None else labels.filter(learn)
    known = labels.filter(F.col(label).isNotNull() & F.col(key).isNotNull()).groupBy(F.col(key).alias("_key")).agg(F.max((F.col(label) > 0).cast("int")).alias("_toxic"))
    known = known.join(docs.select(F.col(key).alias("_key")), "_key", "left_semi").withColumn("_order", F.xxhash64("_key", F.lit(SEED)))
    # Of each class every fourth text in order of the hash is held back for the calibration.
    known = written(ranked_in_ranges(written(known, "labels"), ["_toxic"], ["_order", "_key"], "_nth").withColumn("_held", F.col("_nth") % 4 == 1), "parts")
    counts = {(r["_toxic"], r["_held"]): r["n"] for r in known.groupBy("_toxic", "_held").agg(F.count("*").alias("n")).collect()}
    of = [counts.get((c, False), 0) + counts.get((c, True), 0) for c in (0, 1)]
    if min(of) < 2:
        empty = Model((np.zeros((0, 0)),) * 2, [], [], np.zeros(0), 0.0, (1.0, 0.0), {}, 0.5)
        empty.constant = (of[1] + 0.5) / (sum(of) + 1)
        return empty
    # Texts are dealt once, without those that surely have no label; a repeated id and a block are both within one deal.
    shard = F.pmod(F.xxhash64(F.col("_key").cast("string"), F.lit(SEED + 1)), F.lit(-(-sum(of) // BLOCK))).cast("int").alias("_shard")
    texts = _maybe(docs.select(F.col(key).alias("_key"), F.struct(F.col(text).alias("_text"), F.coalesce(F.col(lang), F.lit("")).alias("_lang")).alias("_row")), known)
    told = known.select(shard, "_key", F.struct("_toxic", "_held", "_order").alias("_label"))
    both = texts.select(shard, "_key", "_row").unionByName(told, allowMissingColumns=True).repartition("_shard")
    found = both.groupBy("_shard", "_key").agg(F.min("_row").alias("_row"), F.min("_label").alias("_label")).filter("_row is not null and _label is not null")
    found = found.select("_shard", "_key", "_label.*", "_row.*").sortWithinPartitions("_held", "_shard", "_order", "_key")
    blocks = written(_blocks(found), "blocks")
    m = _learned(blocks.filter("not held"), counts.get((0, False), 0), counts.get((1, False), 0))
    return _calibrated(m, blocks.filter("held"))


def score(docs: DataFrame, model: Model, text: str = "text", lang: str = "lang") -> DataFrame:
    """All rows with their columns and toxic_score, toxic_limit (of the language), toxic_reject."""
    spark = docs.sparkSession
    docs = free_of(docs, ["toxic_score", "toxic_limit", "toxic_reject"])
    shared = spark.sparkContext.broadcast(model)
    names = docs.columns
    at, schema = names.index(text), docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(score_texts(shared.value, b.column(at)))], names=[*names, "toxic_score"])

    scored = docs.mapInArrow(run, StructType([*schema.fields, StructField("toxic_score", DoubleType())]))
    limits = [F.lit(x) for k, v in model.thresholds.items() for x in (k, v)]
    limit = F.coalesce(F.try_element_at(F.create_map(*limits), F.col(lang)), F.lit(model.threshold)) if limits else F.lit(model.threshold)
    return scored.withColumn("toxic_limit", limit).withColumn("toxic_reject", F.col("toxic_score") >= F.col("toxic_limit"))
