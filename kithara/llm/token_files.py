"""Token ids as flat files: unsigned integers plus 64-bit document offsets, memory-mapped.

A data set is a folder with three files for each part and a manifest:

    part-N.ids      the ids of all documents of the part, one after the other, little-endian
    part-N.offsets  int64, one more than documents: where each document's ids begin in part-N.ids
    part-N.keys     int64 document keys, in order (the least int64 stands for a null key)
    manifest.json   the id type and, for each part, its files, counts and bases

Parts follow each other in ascending key order (nulls first, ties by a hash of the text). The
bases, how many ids and documents come before a part, are prefix sums of the parts' counts. A task
writes files of a name of its own and reports it; only reported files enter the manifest, so a
repeated or lost task leaves no trace in the data set.

Defined results: a null or empty text is the end id alone; a very long text is encoded whole; repeated
rows are documents of their own; columns other than those named are not read, whatever their names; an
empty table gives a manifest without parts and an empty result. A tokenizer that does not treat
white-space separated pieces independently is an error: every task compares its first text with what
the library gives for the whole of it, and the driver some odd ones.
"""

from __future__ import annotations

import json
import os
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kithara.llm.words import Words, byte_buffer, slices, xxh64
from kithara.session import new_path, written

NO_KEY = -(2**63)
#: Words whose ids an encoder remembers; beyond, it starts anew. This bounds memory, not results.
REMEMBERED = 1_000_000
#: Pieces that the library encodes in one call; its results are large until the ids are taken.
AT_ONCE = 2048


class Encoder:
    """Ids of whole texts. The tokenizer must treat white-space separated pieces independently.

    Each distinct piece is encoded once by the tokenizers library and remembered by the XXH64 of
    its bytes; the ids of a text are those of its pieces in order.
    """

    def __init__(self, path: str) -> None:
        # A task has one core; threads of the library would only wait for each other.
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self._forget()

    def _forget(self) -> None:
        """Known pieces: hashes in ascending order, and where in `flat` the ids of each stand."""
        self.hashes, self.starts, self.sizes = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int32)
        self.flat: list[np.ndarray] = [np.zeros(0, np.uint32)]

    def _learn(self, hashes: np.ndarray, pieces: Iterator[str]) -> None:
        """Add pieces, none of them known."""
        sizes, flat, pieces = [], [], iter(pieces)
        while some := list(islice(pieces, AT_ONCE)):
            # One call for many pieces; an id belongs to the piece that its first character lies in.
            done = self.tokenizer.encode(" ".join(some), add_special_tokens=False)
            lengths = np.fromiter(map(len, some), np.int64, len(some))
            at = np.fromiter((a for a, _ in done.offsets), np.int64)
            of = np.searchsorted(np.cumsum(lengths + 1), at, "right")
            sizes.append(np.bincount(of, minlength=len(some)).astype(np.int32))
            flat.append(np.array(done.ids, np.uint32))
        sizes, flat = np.concatenate(sizes), np.concatenate(flat)
        starts = np.cumsum(sizes, dtype=np.int64) - sizes + len(self.flat[0])
        self.flat = [np.concatenate([*self.flat, flat])]
        hashes = np.concatenate([self.hashes, hashes])
        order = np.argsort(hashes, kind="stable")
        self.hashes = hashes[order]
        self.starts, self.sizes = np.concatenate([self.starts, starts])[order], np.concatenate([self.sizes, sizes])[order]

    def encode(self, texts: pa.Array, end: int | None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For ranges of the texts, in order: all ids, and how many each text has, the end id included."""
        raw, off = byte_buffer(texts)
        for i, j in slices(off, 1 << 20):
            w = Words(raw[off[i] : off[j]], off[i : j + 1] - off[i], lower=False)
            distinct, at, inverse = np.unique(xxh64(w.low, w.start, w.end), return_index=True, return_inverse=True)
            if len(self.hashes) > REMEMBERED:
                self._forget()
            place = np.searchsorted(self.hashes, distinct)
            new = np.ones(len(distinct), bool)
            inside = place < len(self.hashes)
            new[inside] = self.hashes[place[inside]] != distinct[inside]
            if new.any():
                data = w.low.tobytes()
                self._learn(distinct[new], (data[a:b].decode() for a, b in zip(w.start[at[new]].tolist(), w.end[at[new]].tolist(), strict=True)))
                place = np.searchsorted(self.hashes, distinct)
            sizes = self.sizes[place][inverse]
            ids = self.flat[0][_spread(self.starts[place][inverse], sizes)]
            ends = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])[w.first]
            if end is not None:
                ids = np.insert(ids, ends[1:], end)
            yield ids, np.diff(ends) + (end is not None)

    def check(self, text: str) -> None:
        """An error unless the pieces of a text give the ids of the whole."""
        got = np.concatenate([ids for ids, _ in self.encode(pa.array([text]), None)])
        if got.tolist() != self.tokenizer.encode(text, add_special_tokens=False).ids:
            raise ValueError("this tokenizer does not treat white-space separated pieces independently")


def _spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The positions starts[i], ..., starts[i] + sizes[i] - 1 for each i."""
    total = int(sizes.sum())
    before = np.cumsum(sizes) - sizes
    return np.repeat(starts - before, sizes) + np.arange(total)


#: Texts in which a tokenizer that looks across white space shows it.
ODD_TEXTS = ("a b  c\td\n\ne ", " lead", "It's 1 000 000, isn't it ?", "e\u0301 \u0301x \u00a0y\u0085z", "the the\r\nthe\x0b\x0c.", "\U0001f600 \u4e2d \u6587 abc")


@lru_cache(maxsize=1)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def _put(folder: str, name: str, chunks: list[np.ndarray] | bytes) -> None:
    fs, base = pafs.FileSystem.from_uri(folder)
    fs.create_dir(base, recursive=True)
    with fs.open_output_stream(f"{base}/{name}") as out:
        for c in [chunks] if isinstance(chunks, bytes) else chunks:
            out.write(c if isinstance(c, bytes) else c.tobytes())


def _get(folder: str, name: str, kind: str) -> np.ndarray:
    """A file as an array: mapped where the folder is on a mounted disk, else read."""
    if urlparse(folder).scheme in ("", "file"):
        path = f"{urlparse(folder).path}/{name}"
        with open(path, "rb") as f:
            empty = not f.read(1)
        return np.zeros(0, kind) if empty else np.memmap(path, kind, "r")
    fs, base = pafs.FileSystem.from_uri(folder)
    with fs.open_input_file(f"{base}/{name}") as f:
        return np.frombuffer(f.read(), kind)


def write(docs: DataFrame, tokenizer: str, end: int | None, folder: str | None = None, key: str = "doc_id", text: str = "text") -> str:
    """Encode all texts and write a data set; returns its folder."""
    spark = docs.sparkSession
    folder = folder or new_path(spark, "tokens")
    for odd in ODD_TEXTS:
        encoder(tokenizer).check(odd)
    kind = "<u2" if max(encoder(tokenizer).tokenizer.get_vocab_size(), (end or 0) + 1) <= 1 << 16 else "<u4"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, n, total = f"part-{uuid.uuid4().hex}", 0, 0
        keys, counts, streams = [], [], None
        fs, base = pafs.FileSystem.from_uri(folder)
        for b in batches:
            if not b.num_rows:
                continue
            if streams is None:
                encoder(tokenizer).check(next((t for t in b.column(1).slice(0, 64).to_pylist() if t and len(t) < 1 << 16), ""))
                fs.create_dir(base, recursive=True)
                streams = fs.open_output_stream(f"{base}/{name}.ids")
            keys.append(b.column(0).cast(pa.int64()).fill_null(NO_KEY).to_numpy().astype("<i8"))
            n += b.num_rows
            for ids, count in encoder(tokenizer).encode(b.column(1), end):
                streams.write(ids.astype(kind).tobytes())
                counts.append(count)
                total += len(ids)
        if streams is not None:
            streams.close()
            offsets = np.concatenate([[0], np.cumsum(np.concatenate(counts))]).astype("<i8")
            _put(folder, f"{name}.offsets", [offsets])
            _put(folder, f"{name}.keys", keys)
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()]), pa.array([name]), pa.array([n]), pa.array([total])], names=["part", "name", "docs", "ids"])

    order = [F.col(key).asc_nulls_first(), F.xxhash64(text)]
    placed = docs.select(key, text).repartitionByRange(*order).sortWithinPartitions(*order)
    parts = written(placed.mapInArrow(run, "part long, name string, docs long, ids long"), "parts").orderBy("part").collect()
    entries, ids, count = [], 0, 0
    for p in parts:
        entries.append({"name": p["name"], "docs": p["docs"], "ids": p["ids"], "ids_before": ids, "docs_before": count})
        ids, count = ids + p["ids"], count + p["docs"]
    _put(folder, "manifest.json", json.dumps({"type": kind, "docs": count, "ids": ids, "parts": entries}).encode())
    return folder


def read(spark: SparkSession, folder: str, columns: str, view) -> DataFrame:
    """Rows that view(keys, offsets, ids, docs_before, ids_before) gives for each part, as a pyarrow batch."""
    manifest = json.loads(_get(folder, "manifest.json", "u1").tobytes())
    kind = manifest["type"]
    parts = [(p["name"], p["docs_before"], p["ids_before"]) for p in manifest["parts"]]
    frame = spark.createDataFrame(parts, "name string, docs_before long, ids_before long").repartition(max(1, len(parts)), "name")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for p in b.to_pylist():
                keys, offsets, ids = (_get(folder, f"{p['name']}.{x}", t) for x, t in (("keys", "<i8"), ("offsets", "<i8"), ("ids", kind)))
                yield view(keys, offsets, ids, p["docs_before"], p["ids_before"])

    return frame.mapInArrow(run, columns)


def digest(spark: SparkSession, folder: str, key: str = "doc_id") -> DataFrame:
    """`key`, start, n_tokens and ids_crc32 (over the ids as little-endian 32-bit integers) of each document."""

    def view(keys: np.ndarray, offsets: np.ndarray, ids: np.ndarray, docs_before: int, ids_before: int) -> pa.RecordBatch:
        crc = [zlib.crc32(ids[a:b].astype("<u4").tobytes()) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
        known = pa.array(np.asarray(keys), mask=np.asarray(keys) == NO_KEY)
        return pa.RecordBatch.from_arrays([known, pa.array(offsets[:-1] + ids_before), pa.array(np.diff(offsets)), pa.array(crc, pa.int64())], names=[key, "start", "n_tokens", "ids_crc32"])

    return read(spark, folder, f"`{key}` long, start long, n_tokens long, ids_crc32 long", view)


def texts_of(spark: SparkSession, folder: str, key: str = "doc_id") -> DataFrame:
    """`key` and ids (array) of each document, in no order."""

    def view(keys: np.ndarray, offsets: np.ndarray, ids: np.ndarray, docs_before: int, ids_before: int) -> pa.RecordBatch:
        known = pa.array(np.asarray(keys), mask=np.asarray(keys) == NO_KEY)
        return pa.RecordBatch.from_arrays([known, pa.LargeListArray.from_arrays(pa.array(np.asarray(offsets)), pa.array(np.asarray(ids).astype(np.int32))).cast(pa.list_(pa.int32()))], names=[key, "ids"])

    return read(spark, folder, f"`{key}` long, ids array<int>", view)
