"""Bloom filters that executors fill and whose size is checked before they are sent anywhere."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from webkiln.llm.words import mix

#: Ids up to which ``maybe_in`` builds a filter (12 MB).
MOST_FILTERED = 10_000_000


def position(h1: np.ndarray, h2: np.ndarray, i: int, level: int, n_bits: int) -> np.ndarray:
    """Bit of the i-th hash; every level has hashes of its own, so no key fails them all."""
    shift = np.uint64((level * 0x9E3779B97F4A7C15) % 2**64)
    return mix(h1 + np.uint64(i) * (h2 | np.uint64(1)) + shift) % np.uint64(n_bits)


def n_bits_for(n_keys: int, rate: float) -> int:
    return max(64, math.ceil(-n_keys * math.log(rate) / math.log(2) ** 2))


@dataclass
class Bloom:
    """Bits, in 64-bit words, and hash count; two 64-bit hashes of a key, salted by level, give its positions."""

    words: np.ndarray
    n_bits: int
    n_hashes: int
    level: int

    def hits(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        found = np.ones(len(h1), bool)
        for i in range(self.n_hashes):
            at = position(h1, h2, i, self.level, self.n_bits)
            found &= (self.words[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) == 1
        return found


def bloom_of(keys: DataFrame, n_keys: int, rate: float, level: int) -> Bloom:
    """Fold all keys' bits (from their hashes h1 and h2) on the executors; only the finished words reach the driver.

    The filter has n_bits_for(n_keys, rate) bits; the caller checks that before.
    """
    n_bits = n_bits_for(n_keys, rate)
    n_hashes = max(1, round(n_bits / n_keys * math.log(2)))

    def fold(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            h1, h2 = (frame[c].to_numpy().view(np.uint64) for c in ("h1", "h2"))
            at = np.concatenate([position(h1, h2, i, level, n_bits) for i in range(n_hashes)])
            word, bit = (at >> np.uint64(6)).astype(np.int64), np.left_shift(np.uint64(1), at & np.uint64(63))
            order = np.argsort(word, kind="stable")
            word, bit = word[order], bit[order]
            first = np.flatnonzero(np.diff(word, prepend=-1))
            if len(first):
                yield pd.DataFrame({"word": word[first], "bits": np.bitwise_or.reduceat(bit, first).view(np.int64)})

    folded = keys.select("h1", "h2").mapInPandas(fold, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits"))
    found = folded.toArrow()  # at most 16 bytes for every 8 of the filter
    words = np.zeros(n_bits // 64 + 1, np.uint64)
    words[found.column("word").to_numpy()] = found.column("bits").to_numpy().view(np.uint64)
    return Bloom(words, n_bits, n_hashes, level)


def hashes(*columns: str) -> tuple[Column, Column]:
    """The two hashes of a key that a filter takes, as h1 and h2."""
    return F.xxhash64(*columns).alias("h1"), F.xxhash64(F.lit(11), *columns).alias("h2")


def sent_filter(ids: DataFrame, *columns: str):
    """A broadcast filter of the ``columns`` of ``ids`` (distinct); None beyond MOST_FILTERED rows."""
    n = ids.count()
    if n > MOST_FILTERED:
        return None
    found = bloom_of(ids.select(*hashes(*columns)), n, 0.01, 0) if n else Bloom(np.zeros(2, np.uint64), 64, 1, 0)
    return ids.sparkSession.sparkContext.broadcast(found)


def hit_by(shared, *columns: str) -> Column:
    """Whether a row passes a broadcast filter."""

    @F.pandas_udf(T.BooleanType())
    def listed(h1: pd.Series, h2: pd.Series) -> pd.Series:
        return pd.Series(shared.value.hits(*(h.to_numpy(np.int64).view(np.uint64) for h in (h1, h2))))

    return listed(*hashes(*columns))


def maybe_in(ids: DataFrame, *columns: str) -> Column | None:
    """A condition that holds for every row whose ``columns`` are in ``ids`` (distinct), and for few others.

    None beyond MOST_FILTERED rows, where all rows have to take part in the join.
    """
    shared = sent_filter(ids, *columns)
    return None if shared is None else hit_by(shared, *columns)
