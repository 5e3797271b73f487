"""Benchmark decontamination: a BM25 index of test items, searched with every training passage.

The items are the indexed documents, each passage of the training text is a query. A passage is
2 L words long and begins every L words, where L is the longest item's length, so an item that lies
in a text lies in a passage whole. The score of an item is its BM25 score divided by the score it
would have if the passage held all of it, so one threshold serves items of every length. Document
frequencies and the mean length are those of all items.

The index is sparse and broadcast. Its size is bounded: it holds PASS_ENTRIES pairs of item and term at
most, and more items take more passes over the documents. The statistics are the same in every pass, so
the rows found do not depend on how items fall into passes.

The search is block-max WAND, run for many passages at once. Terms are numbered by their greatest
impact on any item. Over a passage's terms in that order, those before the running sum reaches the
threshold cannot lift an item over it by themselves; so only blocks of items that hold one of the
others are looked at. A block is skipped unless the sum of its own greatest impacts of the passage's
terms reaches the threshold; the items of the blocks that remain are scored exactly. All items at or
above the threshold are retrieved; nothing is cut off.

What was retrieved is verified by five-word shingles: `overlap` of the item's question and of its
answer must stand in the passage.

Defined results: null and empty texts match nothing; a very long text is searched whole, passage by
passage; items without words are not indexed; of an item of several rows each different row is
searched; a question or answer of fewer than five words is one shingle of its length, an empty one
needs no overlap; of the passages of a text that hold an item the best by score counts, then the
earliest; repeated documents match each; columns other than those named are not read, and `clean`
keeps them all, whatever their names; empty tables give an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from kithara.llm.words import BY_ALNUM, Words, byte_buffer, slices, xxh64
from kithara.session import free_of, written

K1, B = 1.2, 0.75
THRESHOLD, OVERLAP, SHINGLE = 0.6, 0.8, 5
SLACK = 1e-4  # a score this little below the threshold still counts
BLOCK, SHARD = 4, 1024
#: Pairs of item and term in one pass over the documents: at most 200 MB of index. More take more passes.
PASS_ENTRIES = 1_000_000


def shingles(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the runs of k words; none where there are fewer."""
    if len(h) < k or not k:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(h) - k + 1, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(k):
            out = (out ^ h[i : len(h) - k + 1 + i]) * np.uint64(0x9E3779B97F4A7C15)
            out ^= out >> np.uint64(31)
    return out


def word_hashes(texts: list[str]) -> list[np.ndarray]:
    raw, off = byte_buffer(pa.array(texts, pa.string()))
    w = Words(raw, off, BY_ALNUM)
    h = xxh64(w.low, w.start, w.end)
    return [h[a:b] for a, b in zip(w.first[:-1], w.first[1:], strict=True)]


def question_and_answer(text: str) -> tuple[str, str]:
    """The answer is the last line, or else the last sentence; without either, there is none."""
    for cut in ("\n", ". "):
        head, found, tail = text.rstrip().rpartition(cut)
        if found and head.strip() and tail.strip():
            return head, tail
    return text, ""


class Rows:
    """A sparse matrix as a hash table from row * terms + term to a value, a quarter full, probed slot by slot."""

    def __init__(self, count: int, terms: int, codes: np.ndarray, values: np.ndarray) -> None:
        self.count, self.terms = count, terms
        self.bits = (4 * len(codes)).bit_length()
        self.codes, self.values = np.full(1 << self.bits, -1), np.zeros(1 << self.bits, np.float32)
        slot, open_ = self._slot(codes), np.arange(len(codes))
        while len(open_):
            free = open_[self.codes[slot[open_]] == -1]
            _, first = np.unique(slot[free], return_index=True)
            put = free[first]
            self.codes[slot[put]], self.values[slot[put]] = codes[put], values[put]
            open_ = open_[self.codes[slot[open_]] != codes[open_]]
            slot[open_] = (slot[open_] + 1) & ((1 << self.bits) - 1)

    def _slot(self, codes: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((codes.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def at(self, codes: np.ndarray) -> np.ndarray:
        slot = self._slot(codes)
        found = self.codes[slot]
        out = np.where(found == codes, self.values[slot], np.float32(0))
        open_ = np.flatnonzero((found != codes) & (found != -1))
        slot = slot[open_]
        while len(open_):
            slot = (slot + 1) & ((1 << self.bits) - 1)
            found = self.codes[slot]
            hit = found == codes[open_]
            out[open_[hit]] = self.values[slot[hit]]
            more = ~hit & (found != -1)
            open_, slot = open_[more], slot[more]
        return out

    def sums(self, row: np.ndarray, term: np.ndarray, head: np.ndarray, size: np.ndarray) -> np.ndarray:
        """For each i the sum of row[i]'s values at term[head[i] : head[i] + size[i]]."""
        out = np.empty(len(row), np.float32)
        step = max(1, (1 << 18) // max(1, int(size.max(initial=1))))
        for a in range(0, len(row), step):
            n = size[a : a + step]
            ends = np.cumsum(n)
            at = np.repeat(head[a : a + step] - ends + n, n) + np.arange(ends[-1])
            out[a : a + step] = np.add.reduceat(self.at(np.repeat(row[a : a + step] * self.terms, n) + term[at]), ends - n)
        return out


@dataclass
class Shard:
    """An inverted index of up to SHARD items."""

    first: int  # the place of its first item among all of the index
    terms: np.ndarray  # term hashes, ascending
    number: np.ndarray  # of each term, by greatest impact
    sieve: np.ndarray  # whether a term may have these low 16 bits
    greatest: np.ndarray  # impact by term number
    impact: Rows  # by item
    block: Rows  # by block: the greatest impacts in the block
    posting_at: np.ndarray
    posting: np.ndarray  # blocks that hold a term number


@dataclass
class Item:
    item: object
    parts: tuple  # of question and answer: shingle length and distinct shingles
    terms: np.ndarray  # ascending, and of each its share of the score
    impact: np.ndarray


@dataclass
class Index:
    length: int
    items: list[Item]
    shards: list[Shard]




def build(items: list[Item], length: int) -> Index:
    """An index of weighted items; length: words of half a passage."""
    shards = []
    for a in range(0, len(items), SHARD):
        own = items[a : a + SHARD]
        size = np.array([len(x.terms) for x in own])
        terms, term = np.unique(np.concatenate([x.terms for x in own]), return_inverse=True)
        impact = np.concatenate([x.impact for x in own]).astype(np.float32)
        greatest = np.zeros(len(terms), np.float32)
        np.maximum.at(greatest, term, impact)
        order = np.argsort(greatest, kind="stable")
        number = np.empty(len(terms), np.int64)
        number[order] = np.arange(len(terms))
        term = number[term]
        blocks = -(-len(own) // BLOCK)
        each = np.repeat(np.arange(len(own)), size) * len(terms) + term
        pair = np.repeat(np.arange(len(own)) // BLOCK, size) * len(terms) + term
        pair, at = np.unique(pair, return_inverse=True)
        most = np.zeros(len(pair), np.float32)
        np.maximum.at(most, at, impact)
        block, of = pair // len(terms), pair % len(terms)
        by_term = np.lexsort((block, of))
        sieve = np.zeros(1 << 16, bool)
        sieve[(terms & np.uint64(0xFFFF)).astype(np.int64)] = True
        shards.append(Shard(
            a, terms, number, sieve, greatest[order],
            Rows(len(own), len(terms), each, impact), Rows(blocks, len(terms), pair, most),
            np.searchsorted(of[by_term], np.arange(len(terms) + 1)), block[by_term],
        ))
    return Index(length, items, shards)


def _distinct(x: np.ndarray) -> np.ndarray:
    x = np.sort(x)
    return x[np.append(True, x[1:] != x[:-1])] if len(x) else x


def search(s: Shard, h: np.ndarray, place: np.ndarray, base: np.ndarray, length: int, threshold: float) -> tuple[np.ndarray, ...]:
    """(passage, item in the shard, score) for all scores at or above the threshold.

    h: word hashes; place: of each word in its text; base: the first passage of its text.
    """
    maybe = np.flatnonzero(s.sieve[(h & np.uint64(0xFFFF)).astype(np.int64)])
    at = np.minimum(np.searchsorted(s.terms, h[maybe]), len(s.terms) - 1)
    hit = s.terms[at] == h[maybe]
    maybe, term = maybe[hit], s.number[at[hit]]
    k, v = place[maybe] // length, len(s.terms)
    own = base[maybe] + k
    codes = _distinct(np.concatenate([own * v + term, (own[k > 0] - 1) * v + term[k > 0]]))
    passage, term = codes // v, codes % v
    slack = threshold - 2 * SLACK  # sums of single floats; what is found is scored again in double precision
    none = (np.zeros(0, np.int64),) * 2 + (np.zeros(0, np.float32),)
    if not len(passage):
        return none
    most = np.bincount(passage - passage[0], s.greatest[term])
    keep = most[passage - passage[0]] >= slack
    passage, term = passage[keep], term[keep]
    if not len(passage):
        return none
    head = np.flatnonzero(np.concatenate([[True], passage[1:] != passage[:-1]]))
    size = np.diff(np.concatenate([head, [len(passage)]]))
    run = np.cumsum(s.greatest[term], dtype=np.float64)
    before = np.concatenate([[0], run])[head]
    rank = np.repeat(np.arange(len(head)), size)
    pivot = np.flatnonzero(run - before[rank] >= slack)
    n = np.diff(s.posting_at)[term[pivot]]
    ends = np.cumsum(n)
    blocks = s.posting[np.repeat(s.posting_at[term[pivot]] - ends + n, n) + np.arange(ends[-1])]
    in_all = s.block.count
    cand = _distinct(np.repeat(rank[pivot], n) * in_all + blocks)
    group, block = cand // in_all, cand % in_all
    keep = s.block.sums(block, term, head[group], size[group]) >= slack
    group = np.repeat(group[keep], BLOCK)
    item = (block[keep][:, None] * BLOCK + np.arange(BLOCK)).ravel()
    inside = item < s.impact.count
    group, item = group[inside], item[inside]
    if not len(item):
        return none
    score = s.impact.sums(item, term, head[group], size[group])
    keep = score >= slack
    return passage[head[group[keep]]], item[keep], score[keep]


def matches_of(index: Index, texts: pa.Array, threshold: float, overlap: float) -> list[tuple]:
    """(text, item, score, question overlap, answer overlap, first word of the passage), the best for each text and item."""
    raw, off = byte_buffer(texts)
    best: dict[tuple, tuple] = {}
    for a, b in slices(off):
        w = Words(raw[off[a] : off[b]], off[a : b + 1] - off[a], BY_ALNUM)
        if not len(w.start):
            continue
        h = xxh64(w.low, w.start, w.end)
        n = np.diff(w.first)
        passages = np.maximum(1, -(-n // index.length))
        base = np.cumsum(passages) - passages
        doc = np.repeat(np.arange(b - a), n)
        place = np.arange(len(h)) - w.first[doc]
        for s in index.shards:
            for passage, item, _ in zip(*search(s, h, place, base[doc], index.length, threshold), strict=True):
                d = int(np.searchsorted(base, passage, "right")) - 1
                start = (int(passage) - int(base[d])) * index.length
                own = h[w.first[d] + start : min(w.first[d] + start + 2 * index.length, w.first[d + 1])]
                i = s.first + int(item)
                it = index.items[i]
                score = float(it.impact[np.isin(it.terms, own)].sum())
                q, ans = (float(np.isin(p, shingles(own, size)).mean()) if size else 1.0 for size, p in it.parts)
                if score >= threshold - SLACK and q >= overlap and ans >= overlap:
                    found = (score, q, ans, -start)
                    best[a + d, i] = max(best.get((a + d, i), found), found)
    return [(d, i, s, q, ans, -p) for (d, i), (s, q, ans, p) in sorted(best.items())]


def weighted_items(items: DataFrame, item: str, question: str, answer: str) -> tuple[DataFrame, int, int]:
    """The different items that have words, with their terms' shares of the score; the longest's words, and all entries.

    Rows: item, q_size, q_prints, a_size, a_prints, and entries: array of (term, score), by term.
    """
    rows = items.select(F.col(item).alias("item"), F.coalesce(question, F.lit("")).alias("q"), F.coalesce(answer, F.lit("")).alias("a")).distinct()
    kind = rows.schema["item"].dataType.simpleString()
    names = ["id", "item", "words", "q_size", "q_prints", "a_size", "a_prints", "terms", "tf"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            both = [word_hashes(b.column(k).to_pylist()) for k in (2, 3)]
            words = [np.concatenate(x) for x in zip(*both, strict=True)]
            kept = pa.array([i for i, w in enumerate(words) if len(w)], pa.int64())
            found = [np.unique(words[i], return_counts=True) for i in kept.to_pylist()]
            parts = []
            for own in both:
                size = [min(SHINGLE, len(own[i])) for i in kept.to_pylist()]
                parts += [pa.array(size, pa.int32()), pa.array([np.unique(shingles(own[i], k)).tobytes() for i, k in zip(kept.to_pylist(), size, strict=True)], pa.binary())]
            lists = [pa.array([t.view(np.int64) for t, _ in found], pa.list_(pa.int64())), pa.array([n.astype(np.int32) for _, n in found], pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays([b.column(0).take(kept), b.column(1).take(kept), pa.array([len(words[i]) for i in kept.to_pylist()], pa.int32()), *parts, *lists], names=names)

    keyed = rows.select(F.xxhash64("item", "q", "a").alias("id"), "item", "q", "a")
    known = written(keyed.mapInArrow(run, f"id long, item {kind}, words int, q_size int, q_prints binary, a_size int, a_prints binary, terms array<long>, tf array<int>"), "items")
    n, mean, longest, entries = known.agg(F.count("*"), F.avg("words"), F.max("words"), F.sum(F.size("terms"))).first()
    each = known.select("id", "words", F.explode(F.arrays_zip("terms", "tf")).alias("e")).select("id", "words", F.col("e.terms").alias("term"), F.col("e.tf").alias("tf"))
    df = each.groupBy("term").agg(F.count("*").alias("df"))
    idf = F.log(1 + (n - F.col("df") + 0.5) / (F.col("df") + 0.5))
    score = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("words") / (mean or 1.0)))
    scored = each.join(df, "term").select("id", F.struct("term", score.alias("score")).alias("e"))
    scored = scored.groupBy("id").agg(F.array_sort(F.collect_list("e")).alias("entries"))
    return known.drop("terms", "tf", "words").join(scored, "id"), max(32, longest or 0), entries or 0


def matches(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", question: str = "question", answer: str = "answer", threshold: float = THRESHOLD, overlap: float = OVERLAP) -> DataFrame:
    """(key, item, bm25_share, question_overlap, answer_overlap, word) for each item that a document holds."""
    docs = docs.select(key, text)
    known, length, entries = weighted_items(items, item, question, answer)
    passes = max(1, -(-entries // PASS_ENTRIES))
    known = written(known.withColumn("pass", F.pmod(F.xxhash64("id", F.lit(5)), F.lit(passes)).cast("int")), "weighted_items")
    schema = f"`{key}` {dict(docs.dtypes)[key]}, `{item}` {dict(items.dtypes)[item]}, bm25_share double, question_overlap double, answer_overlap double, word long"
    target = to_arrow_schema(_parse_datatype_string(schema))

    def one(r: Row) -> Item:
        prints = [(r[f"{c}_size"], np.frombuffer(r[f"{c}_prints"], np.uint64)) for c in "qa"]
        score = np.array([e["score"] for e in r["entries"]])
        return Item(r["item"], tuple(prints), np.array([e["term"] for e in r["entries"]], np.int64).view(np.uint64), score / score.sum())

    out = None
    for k in range(passes):
        own = sorted((one(r) for r in known.filter(F.col("pass") == k).toLocalIterator()), key=lambda x: (str(x.item), x.terms.tobytes()))
        shared = docs.sparkSession.sparkContext.broadcast(build(own, length))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = shared.value
            for b in batches:
                found = matches_of(index, b.column(1), threshold, overlap) if index.shards else []
                d, i, *rest = zip(*found, strict=True) if found else ([],) * 6
                names = pa.array([index.items[x].item for x in i], target.field(1).type)
                arrays = [b.column(0).take(pa.array(d, pa.int64())), names, *(pa.array(x, t) for x, t in zip(rest, (pa.float64(),) * 3 + (pa.int64(),), strict=True))]
                yield pa.RecordBatch.from_arrays(arrays, names=target.names)

        part = docs.mapInArrow(run, schema)
        if passes > 1:  # one index at a time on the driver and the executors
            part = written(part, "matches")
            shared.destroy()
        out = part if out is None else out.unionByName(part)
    return out


def clean(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The documents, with all their columns, that hold no item."""
    docs = free_of(docs, ["_key", "_row"])
    held = written(matches(docs, items, key, text, **options).select(F.col(key).alias("_key")).distinct(), "contaminated")
    return docs.join(held, F.col(key).eqNullSafe(F.col("_key")), "left_anti")


def split_items(items: DataFrame, text: str = "text") -> DataFrame:
    """Items of one text, with question and answer told apart as `question_and_answer` does."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            pairs = [question_and_answer(t or "") for t in b.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([q for q, _ in pairs], pa.string()), pa.array([a for _, a in pairs], pa.string())], names=[*names, "question", "answer"])

    items = free_of(items, ["question", "answer"])
    names, at = items.columns, items.columns.index(text)
    fields = ", ".join(f"`{c}` {t}" for c, t in items.dtypes)
    return items.mapInArrow(run, f"{fields}, question string, answer string")
