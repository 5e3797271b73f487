"""LM scoring: a hashed maximum-entropy model with a class-factored softmax.

Every word of the corpus is modelled. Classes are nested, sixteen to a class: a word's path through
them is given by the leading digits of its hash, and levels are added as the counted vocabulary grows,
until a last class holds LEAF words or fewer. At each level the sixteen branches have a softmax whose
logits are the logs of the branches' exact shares plus a weight for each feature of the history:

    p(word | history) = product over levels of p(branch | class, history) * share of the word in its last class

Features are hashed n-grams and skips of whole words: the last word, the last two, the words two and
three back, and the endings of the last word and of the last two (which stand for words not seen
before). A feature and a class name a row of sixteen weights in one hashed table, whose rows follow
the number of training tokens.

Training is by distributed gradient updates over all training texts, which a hash of the key deals to
ROUNDS rounds; each text is learned from in one. In a round every task counts, for the rows its tokens
meet, how often each branch was seen and how often the model of the round, sampled once a token, would
have chosen it. The sum of the differences is the gradient of the likelihood; the update is its scaled
form, the log of the ratio of both counts. Counts are integers, so neither the order nor the number of
tasks changes a weight, and a run repeats itself.

Counts of words are exact and cover the whole corpus. They are kept by ranges of word hashes, so no
task or driver holds the vocabulary. Texts are tokenized once, into chunks: one row for some megabytes
of text, with the chunk's distinct word hashes and the texts as indices into them.

Defined results: a null or empty text is the end token alone; repeated rows are texts of their own,
and ties between words do not arise, since nothing is ranked; a very long text is one chunk of its own
and is scored whole; with no training text each token has probability 1; extra columns, of whatever
names, are not read; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kithara.llm.words import Words, byte_buffer, slices, xxh64
from kithara.session import dropped, written

#: Branches of a class, words that a last class should hold at most, and most levels (a million last classes).
WIDTH, LEAF, MOST_LEVELS = 16, 16, 5
#: Training tokens for a row of the table, and the least and most rows as powers of two (16 MB of weights; a training task holds 128 MB).
TOKENS_A_ROW, LEAST_BITS, MOST_BITS = 16, 12, 19
ROUNDS, STEP, PRIOR = 2, 2.0, 2.0
BATCH = 8192
CHUNK_BYTES = 4 << 20
RANGE_ENTRIES = 1_000_000  # entries of chunk vocabularies that a hash range should hold
BLOCK_ROWS = 4096
TASK_TOKENS = 1 << 24  # in one training task, which returns some 10 MB of counts
MOST_LOGIT = 80.0
ENDINGS = 48  # classes of words by their last two bytes; the end token and what precedes a text are two more
NO_KEY = -(2**63)
#: The end token: the hash of a byte that no word holds. And what stands before a text.
END = np.uint64(int(xxh64(np.array([32] + [0] * 8, np.uint8), np.array([0]), np.array([1]))[0]))
BEGIN = np.uint64(7)
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
#: Features by level: those of the first two levels, and those below.
LAST, LAST_TWO, TWO_BACK, THREE_BACK, ENDING, TWO_ENDINGS = range(6)
BROAD, NARROW = (LAST, LAST_TWO, TWO_BACK, THREE_BACK, ENDING, TWO_ENDINGS), (LAST, LAST_TWO, ENDING)


def _bytes(arrays: list[np.ndarray]) -> pa.Array:
    return pa.array([a.tobytes() for a in arrays], pa.binary())


CHUNK = "chunk string, keys binary, held binary, sizes binary, vocab binary, tails binary, counts binary, ids binary"


def chunks(docs: DataFrame, held: Column, key: str, text: str) -> DataFrame:
    """One row for each chunk of texts, named by the task and its place there; written once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number = TaskContext.get().partitionId(), 0
        for b in batches:
            keys = b.column(0).cast(pa.int64()).fill_null(NO_KEY).to_numpy()
            out = b.column(1).to_numpy(zero_copy_only=False).astype(np.uint8)
            raw, off = byte_buffer(b.column(2))
            for i, j in slices(off, CHUNK_BYTES):
                w = Words(raw[off[i] : off[j]], off[i : j + 1] - off[i])
                n = np.diff(w.first)
                h = np.insert(xxh64(w.low, w.start, w.end), w.first[1:], END)
                last = w.low[w.end - 1].astype(np.int64)
                prior = np.where(w.end - w.start > 1, w.low[w.end - 2], 0)
                tail = np.insert((last * 31 + prior) % ENDINGS, w.first[1:], ENDINGS).astype(np.uint8)
                vocab, at, ids = np.unique(h, return_index=True, return_inverse=True)
                train = np.repeat(out[i:j] == 0, n + 1)
                counts = np.bincount(ids[train], minlength=len(vocab)).astype(np.int32)
                kind = np.uint16 if len(vocab) <= 1 << 16 else np.uint32
                row = [keys[i:j], out[i:j], (n + 1).astype(np.int32), vocab, tail[at], counts, ids.astype(kind)]
                yield pa.RecordBatch.from_arrays([pa.array([f"{part}-{number}"]), *(_bytes([x]) for x in row)], names=[c.split()[0] for c in CHUNK.split(", ")])
                number += 1

    slim = docs.select(F.col(key).alias("key_"), F.coalesce(held, F.lit(False)).alias("held_"), F.col(text).alias("text_"))
    return written(slim.mapInArrow(run, CHUNK), "chunks")


@dataclass
class Chunk:
    keys: np.ndarray
    held: np.ndarray
    sizes: np.ndarray
    vocab: np.ndarray
    tails: np.ndarray
    ids: np.ndarray

    @staticmethod
    def of(row: dict) -> Chunk:
        vocab = np.frombuffer(row["vocab"], np.uint64)
        kind = np.uint16 if len(vocab) <= 1 << 16 else np.uint32
        return Chunk(np.frombuffer(row["keys"], np.int64), np.frombuffer(row["held"], np.uint8), np.frombuffer(row["sizes"], np.int32), vocab, np.frombuffer(row["tails"], np.uint8), np.frombuffer(row["ids"], kind))


def _grouped(batches: Iterator[pa.RecordBatch], by: str) -> Iterator[list[dict]]:
    """Lists of consecutive rows with the same value of `by`."""
    held: list[dict] = []
    for b in batches:
        for k in range(b.num_rows):
            row = b.slice(k, 1).to_pylist()[0]
            if held and held[0][by] != row[by]:
                yield held
                held = []
            held.append(row)
    if held:
        yield held


def levels_for(words: int) -> int:
    """Levels at which a last class holds LEAF of so many words, or the most there may be."""
    return next((n for n in range(MOST_LEVELS) if LEAF * WIDTH**n >= words), MOST_LEVELS)


def leaf_of(words: np.ndarray, levels: int) -> np.ndarray:
    return (words >> np.uint64(64 - 4 * levels)).astype(np.int64) if levels else np.zeros(len(words), np.int64)


def word_counts(table: DataFrame) -> DataFrame:
    """Exact counts over all chunks, by hash range.

    Rows (kind, chunk, range, data): kind 0 returns to a chunk the counts of its words in the range;
    kind 1 has the tokens and distinct words of the last classes in the range, at the levels that fit
    all entries of chunk vocabularies: data is levels, the first class, then both counts.
    """
    parts = int(table.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    total = table.agg(F.sum(F.length("vocab") / 8).alias("n")).first()["n"] or 0
    ranges = max(1, min(parts, int(total // 20_000) + 1), int(total // RANGE_ENTRIES) + 1)
    width = np.uint64(min(2**64 // ranges + 1, 2**64 - 1))
    levels = levels_for(int(total))

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                vocab, counts = np.frombuffer(row["vocab"], np.uint64), np.frombuffer(row["counts"], np.int32)
                own = np.minimum(vocab // width, np.uint64(ranges - 1)).astype(np.int64)
                cut = np.searchsorted(own, np.arange(ranges + 1))
                live = [r for r in range(ranges) if cut[r] < cut[r + 1]]
                part = lambda x: _bytes([x[cut[r] : cut[r + 1]] for r in live])  # noqa: B023, E731
                yield pa.RecordBatch.from_arrays([pa.array(live, pa.int32()), pa.array([row["chunk"]] * len(live)), part(vocab), part(counts)], names=["range", "chunk", "vocab", "counts"])

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _grouped(batches, "range"):
            vocab, counts = (np.concatenate([np.frombuffer(r[c], t) for r in rows]) for c, t in (("vocab", np.uint64), ("counts", np.int32)))
            words, place = np.unique(vocab, return_inverse=True)
            sums = np.bincount(place, counts, len(words)).astype(np.int64)
            ends = np.cumsum([len(r["vocab"]) // 8 for r in rows])
            back = np.split(sums[place], ends[:-1])
            leaf = leaf_of(words, levels)
            first = int(leaf[0])
            stats = [np.array([levels, first]), np.bincount(leaf - first, sums).astype(np.int64), np.bincount(leaf - first, sums > 0).astype(np.int64)]
            n = len(rows)
            yield pa.RecordBatch.from_arrays(
                [pa.array([0] * n + [1], pa.int32()), pa.array([r["chunk"] for r in rows] + [""]), pa.array([rows[0]["range"]] * (n + 1), pa.int32()), _bytes([*back, np.concatenate(stats)])],
                names=["kind", "chunk", "range", "data"],
            )

    spread = table.select("chunk", "vocab", "counts").mapInArrow(dealt, "range int, chunk string, vocab binary, counts binary")
    spread = spread.repartition(min(ranges, 4096), "range").sortWithinPartitions("range")
    return written(spread.mapInArrow(counted, "kind int, chunk string, range int, data binary"), "counts")


@dataclass
class Model:
    tokens: int
    distinct: int
    levels: int
    bits: int  # the table has 2 ** bits rows
    mass: np.ndarray  # smoothed tokens of each last class
    shares: list[np.ndarray]  # by level: (class, branch), logs of the branches' shares
    weights: np.ndarray | None = None  # (row, branch), in half precision; none before the first round

    @cached_property
    def table(self) -> np.ndarray:
        return self.weights.astype(np.float32)

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "table"}


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * _A
    return x ^ (x >> np.uint64(29))


def history(c: Chunk) -> list[np.ndarray]:
    """For each token of the chunk the hashes of its six features."""
    with np.errstate(over="ignore"):
        words, tails = np.append(c.vocab, BEGIN), np.append(c.tails, np.uint8(ENDINGS + 1)).astype(np.uint64)
        place = np.arange(len(c.ids)) - np.repeat(np.cumsum(c.sizes) - c.sizes, c.sizes)
        back = []
        for k in (1, 2, 3):
            at = np.full(len(c.ids), len(c.vocab), np.int64)
            at[k:] = c.ids[:-k]
            at[place < k] = len(c.vocab)
            back.append(at)
        one = _mixed(words + _A)
        pair = one[back[0]] ^ _mixed(words ^ _B)[back[1]]
        ends = tails[back[0]], tails[back[1]]
        return [one[back[0]], _mixed(pair), _mixed(words + _B)[back[1]], _mixed(words ^ _A)[back[2]], _mixed(ends[0] + (_A ^ _B)), _mixed(ends[0] * np.uint64(64) + ends[1] + (_A & _B))]


def _rows(m: Model, level: int, node: np.ndarray, features: list[np.ndarray]) -> list[np.ndarray]:
    """The table rows of the features at each token's class."""
    with np.errstate(over="ignore"):
        name = (node + WIDTH**level).astype(np.uint64) * _B
        return [(((features[f] ^ name) * _A) >> np.uint64(64 - m.bits)).astype(np.int64) for f in (BROAD if level < 2 else NARROW)]


def _branches(m: Model, level: int, node: np.ndarray, rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Logits of the branches and their exponentials, which single precision holds."""
    z = m.shares[level].take(node, axis=0)
    if m.weights is not None:
        for r in rows:
            z += m.table.take(r, axis=0)
    np.minimum(z, MOST_LOGIT, out=z)
    return z, np.exp(z)


def log_paths(m: Model, c: Chunk) -> np.ndarray:
    """For each token the natural log of its last class's probability after the history."""
    out, features = np.zeros(len(c.ids)), history(c)
    code = leaf_of(c.vocab, m.levels)[c.ids]
    for a in range(0, len(code), BATCH):
        own, at = [f[a : a + BATCH] for f in features], code[a : a + BATCH]
        for level in range(m.levels):
            node, branch = at >> 4 * (m.levels - level), (at >> 4 * (m.levels - level - 1)) & 15
            z, odds = _branches(m, level, node, _rows(m, level, node, own))
            out[a : a + BATCH] += z[np.arange(len(at)), branch] - np.log(odds.sum(1))
    return out


def tally(m: Model, c: Chunk, seen: np.ndarray, chosen: np.ndarray, round_: int) -> None:
    """Count, by row and branch, what the chunk's training tokens show and what the model would choose."""
    features, code = history(c), leaf_of(c.vocab, m.levels)[c.ids]
    with np.errstate(over="ignore"):
        place = np.arange(len(code)) - np.repeat(np.cumsum(c.sizes) - c.sizes, c.sizes)
        own = _mixed(c.keys.view(np.uint64) * _A)
        lot = _mixed(np.repeat(own, c.sizes) + place.astype(np.uint64) * _B)
    use = np.flatnonzero(np.repeat((c.held == 0) & (own % np.uint64(ROUNDS) == round_), c.sizes))
    for a in range(0, len(use), BATCH):
        pick = use[a : a + BATCH]
        own, at = [f[pick] for f in features], code[pick]
        for level in range(m.levels):
            node, branch = at >> 4 * (m.levels - level), (at >> 4 * (m.levels - level - 1)) & 15
            rows = _rows(m, level, node, own)
            run = np.cumsum(_branches(m, level, node, rows)[1], axis=1)
            with np.errstate(over="ignore"):
                draw = (_mixed(lot[pick] + np.uint64(level)) >> np.uint64(40)).astype(np.float32) / np.float32(1 << 24)
            guess = (run[:, :-1] <= (draw * run[:, -1])[:, None]).sum(1)
            for r in rows:
                np.add.at(seen, r * WIDTH + branch, np.int32(1))
                np.add.at(chosen, r * WIDTH + guess, np.int32(1))


def updated(weights: np.ndarray, seen: np.ndarray, chosen: np.ndarray) -> np.ndarray:
    """The weights after a round, from both counts."""
    return (weights + STEP / len(BROAD) * np.log((seen + PRIOR) / (chosen + PRIOR))).astype(np.float16)


def score_chunk(m: Model, c: Chunk, counts: np.ndarray) -> list[np.ndarray]:
    """keys, held, tokens, known tokens, base score and score of each text of the chunk."""
    at = np.cumsum(c.sizes) - c.sizes
    base = np.log10((counts + 0.1) / (m.tokens + 0.1 * (m.distinct + 1)))
    own = np.log((counts + 0.1) / m.mass[leaf_of(c.vocab, m.levels)])
    logs = (log_paths(m, c) + own[c.ids]) / np.log(10)
    known = np.add.reduceat((counts > 0)[c.ids].astype(np.int64), at)
    return [c.keys, c.held, c.sizes, known, np.add.reduceat(base[c.ids], at), np.add.reduceat(logs, at)]


def _packed(x: np.ndarray) -> bytes:
    """Counts of 32 bits, bytes of equal weight together, compressed."""
    return pa.compress(x.astype("<i4").view(np.uint8).reshape(-1, 4).T.tobytes(), codec="zstd", asbytes=True)


def _unpacked(data: bytes, n: int) -> np.ndarray:
    return np.frombuffer(pa.decompress(data, 4 * n, codec="zstd", asbytes=True), np.uint8).reshape(4, -1).T.copy().view("<i4").ravel()


def _tasks(table: DataFrame, tokens: int) -> DataFrame:
    """As few tasks as keep the cores busy and each below TASK_TOKENS, since each returns counts for the whole table of weights."""
    n, cores = table.rdd.getNumPartitions(), table.sparkSession.sparkContext.defaultParallelism
    want = max(cores, -(-tokens // TASK_TOKENS))
    return table.repartition(want) if n < want else table.coalesce(want)


def _prepared(counts: DataFrame) -> Model:
    """A model without weights, from the counts of last classes."""
    mass = words = None
    for r in counts.filter("kind = 1").select("data").toLocalIterator():
        (levels, first), stats = np.frombuffer(r["data"], np.int64)[:2], np.frombuffer(r["data"], np.int64)[2:].reshape(2, -1)
        if mass is None:
            mass, words = np.zeros(WIDTH**levels, np.int64), np.zeros(WIDTH**levels, np.int64)
        mass[first : first + stats.shape[1]] += stats[0]
        words[first : first + stats.shape[1]] += stats[1]
    if mass is None:
        mass = words = np.zeros(1, np.int64)
    tokens, distinct = int(mass.sum()), int(words.sum())
    levels = levels_for(distinct)
    mass = mass.reshape(WIDTH**levels, -1).sum(1) + 0.1 * (words.reshape(WIDTH**levels, -1).sum(1) + 1)
    shares, up = [], mass
    for _ in range(levels):
        down = up.reshape(-1, WIDTH)
        up = down.sum(1)
        shares.insert(0, np.log(down / up[:, None]).astype(np.float32))
    bits = min(MOST_BITS, max(LEAST_BITS, (tokens // TOKENS_A_ROW).bit_length()))
    return Model(tokens, distinct, levels, bits, mass, shares)


def train(table: DataFrame, counts: DataFrame) -> Model:
    spark, m = table.sparkSession, _prepared(counts)
    size = BLOCK_ROWS * WIDTH
    blocks = (WIDTH << m.bits) // size
    for r in range(ROUNDS if m.levels else 0):
        shared = spark.sparkContext.broadcast(m)

        def tallied(batches: Iterator[pa.RecordBatch], r: int = r, shared=shared) -> Iterator[pa.RecordBatch]:
            seen, chosen = np.zeros(WIDTH << m.bits, np.int32), np.zeros(WIDTH << m.bits, np.int32)
            for b in batches:
                for k in range(b.num_rows):
                    tally(shared.value, Chunk.of(b.slice(k, 1).to_pylist()[0]), seen, chosen, r)
            for k in range(blocks):
                at = slice(k * size, (k + 1) * size)
                if seen[at].any():
                    yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([_packed(seen[at])], pa.binary()), pa.array([_packed(chosen[at])], pa.binary())], names=["block", "seen", "chosen"])

        def summed(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            def done(block: int) -> pa.RecordBatch:
                w = shared.value.weights
                old = 0 if w is None else w.ravel()[block * size : (block + 1) * size].astype(np.float64)
                return pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), _bytes([updated(old, *total)])], names=["block", "data"])

            own, total = None, None
            for b in batches:
                for row in b.to_pylist():
                    if row["block"] != own:
                        if own is not None:
                            yield done(own)
                        own, total = row["block"], [np.zeros(size, np.int64), np.zeros(size, np.int64)]
                    total[0] += _unpacked(row["seen"], size)
                    total[1] += _unpacked(row["chosen"], size)
            if own is not None:
                yield done(own)

        sums = _tasks(table, m.tokens).select("keys", "held", "sizes", "vocab", "tails", "ids").mapInArrow(tallied, "block int, seen binary, chosen binary")
        sums = sums.repartition(min(blocks, 32), "block").sortWithinPartitions("block").mapInArrow(summed, "block int, data binary")
        after = np.zeros((1 << m.bits, WIDTH), np.float16) if m.weights is None else m.weights.copy()
        blocks_now = written(sums, "weights")
        for row in blocks_now.toLocalIterator():
            after[row["block"] * BLOCK_ROWS : (row["block"] + 1) * BLOCK_ROWS] = np.frombuffer(row["data"], np.float16).reshape(-1, WIDTH)
        dropped(blocks_now)
        shared.destroy()
        m = Model(m.tokens, m.distinct, m.levels, m.bits, m.mass, m.shares, after)
    return m


def score(docs: DataFrame, held: Column, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, held_out, n_tokens, n_known, train_tokens, base_score and score of each text.

    held: which texts the model must not learn from; where it is null, the text is learned from.
    """
    table = chunks(docs, held, key, text)
    counts = word_counts(table)
    shared = table.sparkSession.sparkContext.broadcast(train(table, counts))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _grouped(batches, "chunk"):
            m, c = shared.value, Chunk.of(rows[-1])
            own = np.concatenate([np.frombuffer(r["data"], np.int64) for r in rows[:-1]])
            keys, out, n, known, base, logs = score_chunk(m, c, own)
            arrays = [pa.array(keys, mask=keys == NO_KEY), pa.array(out.astype(bool)), pa.array(n.astype(np.int64)), pa.array(known), pa.array(np.full(len(n), m.tokens)), pa.array(base), pa.array(logs)]
            yield pa.RecordBatch.from_arrays(arrays, names=[key, "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    none = F.lit(None).cast("binary")
    blobs = ["keys", "held", "sizes", "vocab", "tails", "ids"]
    a = counts.filter("kind = 0").select("chunk", "range", "data", *(none.alias(c) for c in blobs))
    b = table.select("chunk", F.lit(2**31 - 1).alias("range"), none.alias("data"), *blobs)
    parts = max(table.count(), int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))  # a chunk or so in each
    both = a.unionByName(b).repartition(parts, "chunk").sortWithinPartitions("chunk", "range")
    return both.mapInArrow(run, f"`{key}` long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
