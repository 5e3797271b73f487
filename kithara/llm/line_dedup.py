"""Line dedup: winnowing over line hashes.

Lines are compared by their words (lower-cased A-Z, white space apart); blank lines do not count. A
window is a line and as many after it as are needed for `least_words` words. Every window selects
the line of the least hash in it as its fingerprint. A run of lines that repeats and has
`least_words` words holds a window, so it shares a fingerprint with its other occurrence, wherever it
begins. Only selected lines are exploded and grouped; what stands in one place only is done with, and so are
the texts that have nothing else. Around the repeated ones the lines of both places are compared.

The windows that selected a repeated fingerprint are joined with the first place (by key, then line) that has the
fingerprint in the same window: one row for each later place, never all pairs. The matches are then
extended. To the left, every line begins a window, so the windows before a match are matches
themselves as far as the run goes. To the right, where lines are too few for another window, a matched
window grows line by line, and what it has grown to is again joined with the first place that agrees,
which may be another than that of the window. Matches of a document that overlap or touch are one run,
and all later runs are deleted: exactly the lines of those runs of `least_words` words or more that
stand earlier, in another document or in the same one. Every deleted line still stands somewhere.

A very common line or window is one key of the joins, whose other side has one row a key; adaptive
execution splits its partition there, and the aggregations combine before they shuffle.

Defined results: a null text stays null; documents are in order of key, nulls last; rows of one key and
different texts are ordered by a hash of the text; rows that repeat key and text count as one
document and get the same result; within a document the earliest run stays; a very long text, or line,
is compared whole; an empty table gives an empty result; input columns named like the added ones are
replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from kithara.llm.words import Words, byte_buffer, slices, xxh64
from kithara.session import free_of, written

LEAST_WORDS = 20
#: Runs of one partition that are held in memory to be met by the texts; where there are more, both are sorted.
HELD_RUNS = 1_000_000


def _grown(whole: np.ndarray, line: np.ndarray, k: int) -> np.ndarray:
    """The hashes of runs of k lines, grown by one more."""
    x = (whole ^ (line + np.uint64(k))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def parsed(texts: pa.Array) -> tuple[np.ndarray, ...]:
    """For each line that is not blank: its text, number, words and hash."""
    raw, off = byte_buffer(texts)
    none = np.zeros(0, np.int64)
    parts = [(none, none, none, none.view(np.uint64))]
    for a, b in slices(off):
        part, cuts = raw[off[a] : off[b]], off[a : b + 1] - off[a]
        breaks = np.flatnonzero(part == 10) + 1
        lines = np.unique(np.concatenate([cuts, breaks]))
        if len(lines) < 2:
            continue
        w = Words(part, lines, joined=True)
        n = np.diff(w.first)
        full = np.flatnonzero(n)
        if not len(full):
            continue
        h = xxh64(w.low, w.start[w.first[full]], w.end[w.first[full + 1] - 1])
        doc = np.searchsorted(cuts, lines[full], "right") - 1
        parts.append((doc + a, full - np.searchsorted(lines, cuts)[doc], n[full], h))
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def windows(doc: np.ndarray, n: np.ndarray, h: np.ndarray, least_words: int) -> tuple[np.ndarray, ...]:
    """For each window, as places in the given lines: first and last line, and the line of the least hash (the first of equals)."""
    words = np.cumsum(n)
    head = np.arange(len(doc))
    tail = np.searchsorted(words, words - n + least_words)
    live = tail < len(doc)
    live[live] = doc[tail[live]] == doc[live]
    head, tail = head[live], tail[live]
    spot = head.copy()
    more, k = np.flatnonzero(tail > head), 1
    while len(more):
        at = head[more] + k
        less = h[at] < h[spot[more]]
        spot[more[less]] = at[less]
        k += 1
        more = more[head[more] + k <= tail[more]]
    return head, tail, spot


def hashes(doc: np.ndarray, n: np.ndarray, h: np.ndarray, head: np.ndarray, tail: np.ndarray, least_words: int) -> tuple[np.ndarray, ...]:
    """The hash of all lines of each window. Then, for what windows can grow to: the window, the last line, the hash.

    A window grows while the lines after its first have fewer than least_words words.
    """
    words, whole = np.cumsum(n), h[head].copy()
    grown = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64))]
    with np.errstate(over="ignore"):
        more, k = np.flatnonzero(tail > head), 1
        while len(more):
            whole[more] = _grown(whole[more], h[head[more] + k], k)
            k += 1
            more = more[head[more] + k <= tail[more]]
        own, end, hash_ = np.arange(len(head)), tail.copy(), whole.copy()
        while len(own):
            end += 1
            fits = end < len(doc)
            fits[fits] = (doc[end[fits]] == doc[head[own[fits]]]) & (words[end[fits]] - words[head[own[fits]]] < least_words)
            own, end = own[fits], end[fits]
            hash_ = _grown(hash_[fits], h[end], end - head[own])
            if len(own):
                grown.append((own, end.copy(), hash_))
    return whole, *(np.concatenate(x) for x in zip(*grown, strict=True))


def _lists(values: np.ndarray, of: np.ndarray, rows: int, kind: pa.DataType) -> pa.Array:
    """One list for each of `rows` rows; of: each value's row, ascending."""
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(of, np.arange(rows + 1)).astype(np.int32)), pa.array(values, kind))


def selections(docs: DataFrame, least_words: int) -> DataFrame:
    """(key, same, number, words, hash, spots) of docs (key, same, text): the lines of each text that are not blank, and which of them its windows select."""
    kind = docs.schema["key"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            doc, number, n, h = parsed(b.column(2))
            spot = np.unique(windows(doc, n, h, least_words)[2])
            lists = [_lists(number, doc, b.num_rows, pa.int32()), _lists(n, doc, b.num_rows, pa.int32()), _lists(h.view(np.int64), doc, b.num_rows, pa.int64()), _lists(spot - np.searchsorted(doc, doc[spot]), doc[spot], b.num_rows, pa.int32())]
            yield pa.RecordBatch.from_arrays([*b.columns[:2], *lists], names=["key", "same", "number", "words", "hash", "spots"])

    found = docs.mapInArrow(run, f"key {kind}, same long, number array<int>, words array<int>, hash array<long>, spots array<int>")
    return found.filter(F.size("spots") > 0)


def _around(lines: DataFrame, least_words: int) -> DataFrame:
    """The windows of texts (key, same, number, words, hash, open) that selected one of the open lines, and what they can grow to."""
    kind = lines.schema["key"].dataType.simpleString()
    names = ["key", "same", "head", "tail", "whole", "print", "grown"]
    pair = [pa.field("tail", pa.int32()), pa.field("whole", pa.int64())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            flat = lambda i: b.column(i).flatten().to_numpy(zero_copy_only=False)  # noqa: B023, E731
            sizes = pc.list_value_length(b.column(2)).to_numpy(zero_copy_only=False)
            doc, number, n, h = np.repeat(np.arange(b.num_rows), sizes), flat(2), flat(3).astype(np.int64), flat(4).view(np.uint64)
            first = np.cumsum(sizes) - sizes
            open_ = np.zeros(len(doc), bool)
            open_[flat(5) + np.repeat(first, pc.list_value_length(b.column(5)).to_numpy(zero_copy_only=False))] = True
            head, tail, spot = windows(doc, n, h, least_words)
            kept = open_[spot]
            head, tail, spot = head[kept], tail[kept], spot[kept]
            whole, own, end, more = hashes(doc, n, h, head, tail, least_words)
            order = np.argsort(own, kind="stable")
            items = pa.StructArray.from_arrays([pa.array(number[end[order]], pa.int32()), pa.array(more[order].view(np.int64))], fields=pair)
            grown = pa.ListArray.from_arrays(pa.array(np.searchsorted(own[order], np.arange(len(head) + 1)).astype(np.int32)), items)
            at = pa.array(doc[head])
            yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), pa.array(number[head], pa.int32()), pa.array(number[tail], pa.int32()), pa.array(whole.view(np.int64)), pa.array(h[spot].view(np.int64)), grown], names=names)

    return lines.select("key", "same", "number", "words", "hash", "open").mapInArrow(run, f"key {kind}, same long, head int, tail int, whole long, print long, grown array<struct<tail: int, whole: long>>")


def repeated_runs(docs: DataFrame, least_words: int = LEAST_WORDS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, same, runs): the later repeated runs of each document that has any, in order.

    same: the text's hash. runs: array of (head, tail, source): first and last line from 0, and the key
    of the document where the first window of the run stands earlier.
    """
    docs = docs.select(F.col(key).alias("key"), F.xxhash64(text).alias("same"), F.col(text).alias("text"))
    lines = written(selections(docs, least_words), "lines")
    selected = lines.select("key", "same", F.explode(F.transform("spots", lambda i: F.struct(i.alias("spot"), F.get("hash", i).alias("print")))).alias("s")).select("key", "same", "s.*")
    spot = F.struct(F.col("key").isNull().alias("none"), "key", "same", "spot")
    prints = selected.groupBy("print").agg(F.min(spot).alias("a"), F.max(spot).alias("b")).filter("a != b").select("print")
    prints = written(prints, "prints")
    open_ = selected.join(prints, "print", "left_semi").groupBy("key", "same").agg(F.collect_set("spot").alias("open"))
    of = written(open_.select(F.col("key").alias("_key"), F.col("same").alias("_same"), "open"), "open_lines")
    near = lines.join(of, F.col("key").eqNullSafe(F.col("_key")) & (F.col("same") == F.col("_same")))
    open_ = written(_around(near, least_words), "windows")
    place = F.struct(F.col("key").isNull().alias("none"), "key", "same", "head")

    def with_first(frame: DataFrame, label: str) -> DataFrame:
        """The rows whose fingerprint stands in an equal run elsewhere, with the first such place."""
        first = frame.groupBy("print", "whole").agg(F.min(place).alias("first"), F.max(place).alias("last"))
        return frame.join(written(first.filter("first != last").drop("last"), label), ["print", "whole"])

    def later(frame: DataFrame) -> DataFrame:
        return frame.filter(place != F.col("first")).select("key", "same", "head", "tail", F.col("first.key").alias("source"))

    met = with_first(open_, "first_places")
    longer = met.select("key", "same", "head", "print", F.explode("grown").alias("g")).select("key", "same", "head", "print", "g.tail", "g.whole")
    found = later(met).unionByName(later(with_first(longer, "first_places_of_longer"))).distinct()
    in_order = Window.partitionBy("key", "same").orderBy("head", "tail")
    reach = F.max("tail").over(in_order.rowsBetween(Window.unboundedPreceding, -1))
    found = found.withColumn("fresh", (F.col("head") > F.coalesce(reach + 1, F.lit(-1))).cast("int"))
    found = found.withColumn("run", F.sum("fresh").over(in_order.rowsBetween(Window.unboundedPreceding, 0)))
    runs = found.groupBy("key", "same", "run").agg(F.min("head").alias("head"), F.max("tail").alias("tail"), F.min_by("source", F.struct("head", "tail")).alias("source"))
    return runs.groupBy("key", "same").agg(F.array_sort(F.collect_list(F.struct("head", "tail", "source"))).alias("runs"))


def dedup(docs: DataFrame, least_words: int = LEAST_WORDS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """All rows with their columns, the later repeated runs cut from `text`, and line_runs and line_count.

    line_runs: the deleted runs as in `repeated_runs` (null where nothing was deleted); line_count: the
    lines there were.
    """
    docs = free_of(docs, ["line_runs", "line_count", "_same", "_key", "_as"])
    runs = written(repeated_runs(docs, least_words, key, text), "runs")
    runs = runs.select(F.col("key").alias("_key"), F.col("same").alias("_as"), F.col("runs").alias("line_runs"))
    if runs.count() <= HELD_RUNS * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")):
        runs = runs.hint("shuffle_hash")
    rows = docs.withColumn("_same", F.xxhash64(text))
    rows = rows.join(runs, F.col(key).eqNullSafe(F.col("_key")) & (F.col("_same") == F.col("_as")), "left")
    rows = rows.select(*docs.columns, "line_runs")
    names, at = rows.columns, docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, cuts = b.column(at), b.column(len(names) - 1)
            counts = pc.add(pc.count_substring(texts, "\n"), 1).cast(pa.int64())
            cut = pc.is_valid(cuts)
            if pc.any(cut).as_py():
                fresh = []
                for t, c in zip(texts.filter(cut).to_pylist(), cuts.filter(cut).to_pylist(), strict=True):
                    lines = t.split("\n")
                    for r in reversed(c):
                        del lines[r["head"] : r["tail"] + 1]
                    fresh.append("\n".join(lines))
                texts = pc.replace_with_mask(texts, cut, pa.array(fresh, texts.type))
            columns = list(b.columns)
            columns[at] = texts
            yield pa.RecordBatch.from_arrays([*columns, counts], names=[*names, "line_count"])

    return rows.mapInArrow(run, StructType([*rows.schema.fields, StructField("line_count", LongType())]))
