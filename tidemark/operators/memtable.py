"""The unflushed versions: a small ordered table on the driver, one version per key."""

from __future__ import annotations

from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..model import Entry, Key, entry_schema, raw


class Memtable:
    """Bounded by the store's `memtable_max_entries`, but for the batch that goes over it."""

    def __init__(self, entries: Iterable[Entry] = ()) -> None:
        self.rows: dict[Key, Entry] = {}
        for e in entries:
            self.upsert(e)

    def upsert(self, entry: Entry) -> None:
        """Replace the key's version unless it is newer; of equal sequences the later arrival stays."""
        old = self.rows.get(entry.key)
        if old is None or entry.sequence >= old.sequence:
            self.rows[entry.key] = entry

    def get(self, key: Key) -> Entry | None:
        """The key's version, a tombstone too."""
        return self.rows.get(key)

    def entries(self) -> list[Entry]:
        """All versions in byte order of their keys."""
        return [self.rows[k] for k in sorted(self.rows, key=raw)]

    def clear(self) -> None:
        self.rows.clear()

    def __len__(self) -> int:
        return len(self.rows)

    def frame(self, spark: SparkSession, binary: bool = False) -> DataFrame:
        return frame_of(spark, self.entries(), binary)


def frame_of(spark: SparkSession, entries: list[Entry], binary: bool = False) -> DataFrame:
    """A few entries as a frame."""
    kind = pa.binary() if binary else pa.string()
    columns = [pa.array([getattr(e, c) for e in entries], k) for c, k in (("key", kind), ("sequence", pa.int64()), ("tombstone", pa.bool_()), ("value", kind))]
    return spark.createDataFrame(pa.table(columns, names=["key", "sequence", "tombstone", "value"]), entry_schema(binary))
