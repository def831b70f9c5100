"""Latest-version-wins resolution: the kernel that every read and every merge goes through.

`latest` aggregates map-side before its one shuffle. Only predicates on `key` may go below it (Catalyst pushes them, as
`key` is the grouping key); filters on value or tombstone come after, or older versions would come back.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import MAX_SEQUENCE


def latest(log: DataFrame) -> DataFrame:
    """key, sequence, tombstone, value of each key's greatest sequence, tombstones included (compaction, memtable)."""
    last = F.max(F.struct("sequence", "tombstone", "value")).alias("last")
    return log.groupBy("key").agg(last).select("key", "last.sequence", "last.tombstone", "last.value")


def visible(log: DataFrame) -> DataFrame:
    """key, value of the keys that are not deleted."""
    return latest(log).where(~F.col("tombstone")).select("key", "value")


def merge(levels: Sequence[DataFrame]) -> DataFrame:
    """The versions of several levels together."""
    return reduce(DataFrame.unionByName, levels)


def compacted(levels: Sequence[DataFrame]) -> DataFrame:
    """One row per key over all levels; tombstones stay, so that a file left behind brings nothing back."""
    return latest(merge(levels))


def flushed(log: DataFrame, level: str) -> DataFrame:
    """Versions collapsed within each level: `level`, key, sequence, tombstone, value."""
    last = F.max(F.struct("sequence", "tombstone", "value")).alias("last")
    return log.groupBy(level, "key").agg(last).select(level, "key", "last.sequence", "last.tombstone", "last.value")


def batches(log: DataFrame) -> DataFrame:
    """batch_id, first_sequence, last_sequence, entries of each atomic batch."""
    return log.groupBy("batch_id").agg(F.min("sequence").alias("first_sequence"), F.max("sequence").alias("last_sequence"), F.count("*").alias("entries"))


def replayed(log: DataFrame, expected: DataFrame) -> DataFrame:
    """The rows of the longest run of complete batches.

    expected: batch_id, entries as committed. The first batch with fewer or more rows ends the replay; it and all later
    ones are left out.
    """
    found = log.groupBy("batch_id").agg(F.count("*").alias("found"))
    broken = expected.join(found, "batch_id", "left").where(F.coalesce("found", F.lit(0)) != F.col("entries"))
    end = broken.agg(F.min("batch_id")).scalar()
    return log.where(F.col("batch_id") < F.coalesce(end, F.lit(MAX_SEQUENCE)))
