"""Bloom filters, built by an aggregate and probed by columns or on the driver.

One 64-bit hash is halved into h1 and an odd h2; bit i of k is (h1 + i * h2) modulo the number of bits. The halves keep
the arithmetic in 64 bits. Filters are tables of (word, bits), so no task or driver has to hold a large one.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import Key, raw


@dataclass(frozen=True)
class BloomSize:
    bits: int
    hashes: int

    def __post_init__(self) -> None:
        if self.bits < 1 or self.hashes < 1 or self.bits % 64:
            raise ValueError("a filter has whole words and at least one hash")


def size(keys: int = 1, rate: float = 0.01) -> BloomSize:
    """Bits and hashes for so many keys at this rate of false positives."""
    if not 0 < rate < 1:
        raise ValueError("the rate lies between 0 and 1")
    bits = max(64, math.ceil(-max(1, keys) * math.log(rate) / math.log(2) ** 2))
    bits = -(-bits // 64) * 64
    return BloomSize(bits, max(1, round(bits / max(1, keys) * math.log(2))))


def _halves(key: Column) -> tuple[Column, Column]:
    h = F.xxhash64(key)
    return h.bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(h, 32).bitwiseOR(F.lit(1))


def positions(key: Column, s: BloomSize) -> Column:
    """The key's bits, as an array."""
    h1, h2 = _halves(key)
    return F.array(*((h1 + h2 * i) % s.bits for i in range(s.hashes)))


_WORD_AND_BIT = ("p div 64 AS word", "shiftleft(1L, cast(p % 64 AS INT)) AS bit")


def build(keys: DataFrame, s: BloomSize, column: str = "key") -> DataFrame:
    """word, bits of the filter over a column."""
    at = keys.select(F.explode(positions(F.col(column), s)).alias("p"))
    return at.selectExpr(*_WORD_AND_BIT).groupBy("word").agg(F.bit_or("bit").alias("bits"))


def may_contain(keys: DataFrame, words: DataFrame, s: BloomSize, column: str = "key") -> DataFrame:
    """The distinct keys that the filter may contain: all of their bits are set."""
    at = keys.select(column).distinct().select(column, F.explode(F.array_distinct(positions(F.col(column), s))).alias("p"))
    at = at.selectExpr(column, *_WORD_AND_BIT)
    hit = at.join(words, "word", "left").withColumn("set", F.coalesce(F.col("bits").bitwiseAND(F.col("bit")) != 0, F.lit(False)))
    return hit.groupBy(column).agg(F.min("set").alias("all")).where("all").select(column)


def places(key: Key, s: BloomSize) -> list[int]:
    """The key's bits, as `positions` has them."""
    h = xxhash.xxh64_intdigest(raw(key), 42)
    h1, h2 = h & 0xFFFFFFFF, (h >> 32) | 1
    return [(h1 + i * h2) % s.bits for i in range(s.hashes)]


def probe(key: Key, words: np.ndarray, s: BloomSize) -> bool:
    """Whether a filter held as an array of words may contain a key."""
    return all(int(words[p // 64]) >> (p % 64) & 1 for p in places(key, s))
