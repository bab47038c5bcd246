"""Batch text scanning with numpy: words of many documents at once, hashed to 64 bits.

Used inside tasks by the operators that aren't native. A batch of texts is one byte
buffer; words are found and hashed by whole-array operations, without a Python loop
over words. Only A-Z is lower-cased. All separators are ASCII, so UTF-8 bytes serve.
"""

from __future__ import annotations

import sys
import types
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

U64 = np.uint64
_BASE = U64(0x9E3779B97F4A7C15)
_INV = U64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
CHUNK_BYTES = 1 << 19

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
#: word bytes: everything but white space
BLANK_WORD = ~_SPACE
#: word bytes: 0-9, a-z (after lower-casing) and every byte of a non-ASCII character
ALNUM_WORD = np.zeros(256, dtype=bool)
ALNUM_WORD[0x30:0x3A] = True
ALNUM_WORD[0x61:0x7B] = True
ALNUM_WORD[0x80:] = True


def _pows(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, kept from task to task.

    Task code is pickled by value, so a global of this module would be made anew by each
    task; the table lives in a module of its own in the worker.
    """
    kept = sys.modules.setdefault("_quarry_powers", types.ModuleType("_quarry_powers"))
    if getattr(kept, "n", 0) < n:
        m = max(n, CHUNK_BYTES * 2)
        tables = []
        for b in (_BASE, _INV):
            t = np.full(m, b, dtype=U64)
            t[0] = 1
            np.multiply.accumulate(t, out=t)
            tables.append(t)
        kept.up, kept.down, kept.n = *tables, m
    return kept.up, kept.down


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


@dataclass
class Words:
    """Words of a slice of texts: document i has words first[i]:first[i + 1]."""

    hashes: np.ndarray
    first: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    data: np.ndarray

    def count(self) -> np.ndarray:
        return np.diff(self.first)


def _slices(offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    """Runs of documents of about CHUNK_BYTES; a longer document is a run of its own."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + CHUNK_BYTES, side="right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a text column; nulls count as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    buf = texts.buffers()[2]
    data = np.frombuffer(buf, dtype=np.uint8) if buf is not None and buf.size else np.zeros(0, dtype=np.uint8)
    return data, offsets


def scan_words(texts: pa.Array, word: np.ndarray = BLANK_WORD, hashed: bool = True) -> Iterator[tuple[int, int, Words]]:
    """Yield (i, j, Words) for runs i:j of the texts."""
    if not len(texts):
        return
    data, offsets = buffers(texts)
    for i, j in _slices(offsets):
        lo = offsets[i]
        own = offsets[i : j + 1] - lo
        low = _LOWER[data[lo : offsets[j]]]
        n = len(low)
        inside = word[low]
        begin = inside.copy()
        begin[1:] &= ~inside[:-1]
        heads = own[:-1][own[:-1] < own[1:]]
        begin[heads] = inside[heads]
        last = inside.copy()
        last[:-1] &= ~inside[1:]
        tails = heads[1:] - 1 if len(heads) else heads
        last[tails] = inside[tails]
        starts, ends = np.flatnonzero(begin), np.flatnonzero(last) + 1
        first = np.searchsorted(starts, own)
        h = np.zeros(0, dtype=U64)
        if hashed and len(starts):
            up, down = _pows(n + 1)
            total = np.zeros(n + 1, dtype=U64)
            np.cumsum((low.astype(U64) + U64(1)) * up[:n], out=total[1:])
            h = mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(U64))
        elif hashed:
            h = np.zeros(0, dtype=U64)
        yield i, j, Words(h, first, starts, ends, low)


def shingles(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of each k consecutive hashes; of all, when there are fewer (none for none)."""
    n = len(h)
    if n == 0:
        return h
    m = min(k, n)
    out = h[: n - m + 1] + U64(m)
    for i in range(1, m):
        out = out * _BASE + h[i : n - m + 1 + i]
        out ^= out >> U64(29)
    return mix(out)
