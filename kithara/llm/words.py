"""Words of many texts at once, as positions in one byte buffer, and their hashes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SPACES = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)
PAD = 8

_lower = np.arange(256, dtype=np.uint8)
_lower[65:91] += 32
#: Whether a byte is part of a word: all but white space.
BY_SPACE = np.ones(256, bool)
BY_SPACE[list(SPACES)] = False
#: Whether a byte is part of a word: ASCII letters and digits and all of non-ASCII.
BY_ALNUM = np.zeros(256, bool)
for _low, _high in ((48, 58), (65, 91), (97, 123), (128, 256)):
    BY_ALNUM[_low:_high] = True


def byte_buffer(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of the texts, and where each begins (one more offset than texts). Nulls are empty."""
    texts = pc.fill_null(texts, "")
    wide = pa.types.is_large_string(texts.type)
    _, offsets, data = texts.buffers()
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64) if len(texts) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, off - off[0]


def slices(off: np.ndarray, size: int = 2 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about `size` bytes; a larger text is a range of its own."""
    n, i = len(off) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + size, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


class Words:
    """The words of some texts: low[start[i]:end[i]], with text t owning words first[t] to first[t+1]."""

    def __init__(self, raw: np.ndarray, off: np.ndarray, kept: np.ndarray = BY_SPACE, joined: bool = False, lower: bool = True) -> None:
        n = len(raw)
        low, word = _lower[raw] if lower else raw.copy(), kept[raw]
        edge = off[(off > 0) & (off < n)]
        begins, ends = word.copy(), word.copy()
        begins[1:] &= ~word[:-1]
        ends[:-1] &= ~word[1:]
        begins[edge] = word[edge]
        ends[edge - 1] = word[edge - 1]
        self.start, self.end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        self.first = np.searchsorted(self.start, off)
        if joined:  # one space between the words of a text
            after = np.setdiff1d(self.end, edge, assume_unique=True)
            after = after[after < n]
            keep = word
            keep[after] = True
            low[after] = 32
            place = np.cumsum(keep)
            low = low[keep]
            self.start, self.end = place[self.start] - 1, place[self.end - 1]
        self.low = np.concatenate([low, np.zeros(PAD, np.uint8)])


_P1, _P2, _P3, _P4, _P5 = (np.uint64(x) for x in (11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261))


def _rotl(x: np.ndarray, r: int) -> np.ndarray:
    return (x << np.uint64(r)) | (x >> np.uint64(64 - r))


def _round(acc: np.ndarray, lane: np.ndarray) -> np.ndarray:
    return _rotl(acc + lane * _P2, 31) * _P1


def xxh64(low: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = 0) -> np.ndarray:
    """XXH64 of each low[start:end]; low has PAD bytes more than the last end."""
    out = np.empty(len(start), np.uint64)
    for i in range(0, len(start), 1 << 15):
        out[i : i + (1 << 15)] = _xxh64(low, start[i : i + (1 << 15)], end[i : i + (1 << 15)], seed)
    return out


def _xxh64(low: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int) -> np.ndarray:
    size = max(len(low) - PAD + 1, 0)
    u64 = np.ndarray((size,), "<u8", low, strides=(1,))
    u32 = np.ndarray((size,), "<u4", low, strides=(1,))
    length = (end - start).astype(np.int64)
    at = start.astype(np.int64)
    with np.errstate(over="ignore"):
        s = np.uint64(seed)
        h = np.full(len(start), s + _P5, np.uint64)
        if (length >= 32).any():
            own = np.flatnonzero(length >= 32)
            acc = [np.full(len(own), x, np.uint64) for x in (s + _P1 + _P2, s + _P2, s, s - _P1)]
            todo, live = length[own] // 32, np.arange(len(own))
            while len(live):
                p = at[own[live]]
                for k in range(4):
                    acc[k][live] = _round(acc[k][live], u64[p + 8 * k])
                at[own[live]] += 32
                todo[live] -= 1
                live = live[todo[live] > 0]
            v = _rotl(acc[0], 1) + _rotl(acc[1], 7) + _rotl(acc[2], 12) + _rotl(acc[3], 18)
            for k in range(4):
                v = (v ^ _round(np.zeros(len(own), np.uint64), acc[k])) * _P1 + _P4
            h[own] = v
        h += length.astype(np.uint64)
        zero = np.uint64(0)
        for step in range(3):
            live = end - at >= 8
            if not live.any():
                break
            if live.all():
                h = _rotl(h ^ _round(zero, u64[at]), 27) * _P1 + _P4
                at += 8
            else:
                live = np.flatnonzero(live)
                h[live] = _rotl(h[live] ^ _round(zero, u64[at[live]]), 27) * _P1 + _P4
                at[live] += 8
        live = np.flatnonzero(end - at >= 4)
        h[live] = _rotl(h[live] ^ (u32[at[live]].astype(np.uint64) * _P1), 23) * _P2 + _P3
        at[live] += 4
        for _ in range(3):
            live = np.flatnonzero(end > at)
            if not len(live):
                break
            h[live] = _rotl(h[live] ^ (low[at[live]].astype(np.uint64) * _P5), 11) * _P1
            at[live] += 1
        h ^= h >> np.uint64(33)
        h *= _P2
        h ^= h >> np.uint64(29)
        h *= _P3
        h ^= h >> np.uint64(32)
    return h
