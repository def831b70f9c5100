"""Streaming ingest into a store, and a running latest-wins view.

Latest-wins does not depend on arrival: the sequence decides, so late rows do no harm and no watermark is needed for
right results. State of the running view grows with the number of keys.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.store import Database


def into(db: Database, order: str, name: str) -> Callable[[DataFrame, int], None]:
    """A `foreachBatch` function: each micro-batch (key, value, `order`) is one atomic commit.

    `name` tells streams apart: a query keeps its name as long as it keeps its checkpoint. The manifest that commits a
    batch also names it, so a batch that a restarted query repeats is in the store once.
    """

    def write(batch: DataFrame, number: int) -> None:
        db.write_frame(batch, order, (name, number))

    return write


def running_latest(log: DataFrame) -> DataFrame:
    """key, sequence, tombstone, value of a streaming log, for update or complete output mode."""
    last = F.max(F.struct("sequence", "tombstone", "value")).alias("last")
    return log.groupBy("key").agg(last).select("key", "last.sequence", "last.tombstone", "last.value")
