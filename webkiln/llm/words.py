"""Vectorised word hashing over Arrow string columns.

A whole Arrow batch is treated as one byte array: separators are found by table
lookup and every word's 64-bit hash comes from one prefix sum, in blocks, of a
polynomial in the bytes (arithmetic modulo 2**64), so no Python object is made per
word and the tables have a constant size.
"""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

_rng = np.random.Generator(np.random.PCG64(20240607))
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64)
_BASE = int(_rng.integers(2**61, 2**62)) * 2 + 1
_BASE_INV = pow(_BASE, -1, 2**64)
_LENGTH = np.uint64(0x9E3779B97F4A7C15)

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32
#: After lower-casing: everything ASCII that is neither a digit nor a letter.
_PUNCT = np.zeros(256, bool)
_PUNCT[0x00:0x30] = _PUNCT[0x3A:0x61] = _PUNCT[0x7B:0x80] = True

#: name -> (separator table, lower-case A-Z first)
STYLES = {"raw": (_SPACE, False), "lower": (_SPACE, True), "alnum": (_PUNCT, True)}

#: Bytes that one step of a prefix sum covers; the power tables have this many entries, whatever the text.
BLOCK = 1 << 16


def _powers_of(base: int) -> np.ndarray:
    table = np.full(BLOCK, base & (2**64 - 1), np.uint64)
    table[0] = 1
    return np.multiply.accumulate(table)


_POWER, _INVERSE = _powers_of(_BASE), _powers_of(_BASE_INV)


def release() -> None:
    """Give memory that a finished task no longer needs back to the system; workers outlive their tasks."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # no glibc: nothing to trim
        return


def releasing(task: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """``task`` for mapInArrow, with ``release`` at its end."""

    @functools.wraps(task)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from task(batches)
        finally:
            release()

    return run


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over all 64 output bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@dataclass
class Words:
    """Words of several texts in order; text i has words first[i]:first[i + 1]."""

    hashes: np.ndarray
    first: np.ndarray
    #: where each word lies among the bytes of all texts
    begin: np.ndarray
    end: np.ndarray

    @property
    def text_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts end to end, and len + 1 offsets; null is empty."""
    texts = texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts
    if texts.null_count:
        texts = texts.fill_null("")
    texts = texts.cast(pa.large_string())
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, at - at[0]


def hash_spans(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of data[begin:end] for every pair, from one prefix sum; both arrays ascend.

    The sum runs over blocks, so that memory beyond the result does not grow with the text.
    """
    at_begin, at_end = np.zeros(len(begin), np.uint64), np.zeros(len(end), np.uint64)
    carry, sums = np.uint64(0), np.zeros(BLOCK + 1, np.uint64)
    inverse = np.empty(len(begin), np.uint64)
    for k in range(-(-len(data) // BLOCK)):
        low, high = k * BLOCK, min((k + 1) * BLOCK, len(data))
        n, scale = high - low, np.uint64(pow(_BASE, low, 2**64))
        np.cumsum(_BYTE[data[low:high]] * _POWER[:n], out=sums[1 : n + 1])
        a, b = np.searchsorted(begin, (low, high))
        at_begin[a:b] = sums[begin[a:b] - low] * scale + carry
        inverse[a:b] = _INVERSE[begin[a:b] - low] * np.uint64(pow(_BASE_INV, low, 2**64))
        a, b = np.searchsorted(end, (low, high), side="right")
        at_end[a:b] = sums[end[a:b] - low] * scale + carry
        carry = sums[n : n + 1] * scale + carry
    return mix((at_end - at_begin) * inverse + (end - begin).astype(np.uint64) * _LENGTH)


def _edges(data: np.ndarray, offsets: np.ndarray, separator: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end of every word; a word never crosses the end of a text."""
    n = len(data)
    inside = ~separator[data]
    start = inside.copy()
    start[1:] &= ~inside[:-1]
    stop = inside.copy()
    stop[:-1] &= ~inside[1:]
    cuts = offsets[(offsets > 0) & (offsets < n)]
    start[cuts] = inside[cuts]
    stop[cuts - 1] = inside[cuts - 1]
    return np.flatnonzero(start), np.flatnonzero(stop) + 1


def hash_words(texts: pa.Array, style: str) -> Words:
    separator, lower = STYLES[style]
    data, offsets = text_bytes(texts)
    if not len(data):
        none = np.zeros(0, np.int64)
        return Words(np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64), none, none)
    if lower:
        data = _LOWER[data]
    begin, end = _edges(data, offsets, separator)
    return Words(hash_spans(data, begin, end), np.searchsorted(begin, offsets), begin, end)


def ngrams(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k words from every position; the last k - 1 positions are cut.

    Built by doubling: the hash of a + b words is hash(a) * C**b + hash(b).
    """
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    c = 0xD1342543DE82EF95
    done, length, block, size = None, 0, hashes, 1
    while True:
        if k & size:
            if done is None:
                done, length = block, size
            else:
                m = len(hashes) - length - size + 1
                done = done[:m] * np.uint64(pow(c, size, 2**64)) + block[length : length + m]
                length += size
        if size * 2 > k:
            break
        m = len(hashes) - 2 * size + 1
        block = block[:m] * np.uint64(pow(c, size, 2**64)) + block[size : size + m]
        size *= 2
    return mix(done[:n] + np.uint64(k))


def slices(batches: Iterator[pa.RecordBatch], text: str, most_bytes: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``most_bytes`` of text; a longer text comes alone."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = np.diff(text_bytes(batch.column(text))[1]) + 16
        part = (np.cumsum(sizes) - 1) // most_bytes
        edges = np.flatnonzero(np.diff(part, prepend=-1, append=part[-1] + 1))
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            yield batch.slice(a, b - a)
