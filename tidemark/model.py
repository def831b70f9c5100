"""Rows, options, errors and validation of the versioned key-value model.

A log row is one version of a key: key, sequence, tombstone, value. Of all versions of a key the one with the greatest
sequence counts; a tombstone hides the key. Keys compare as unsigned bytes. An empty value is a value; null means delete.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MAX_SEQUENCE = 2**63 - 1
Key = str | bytes


class InvalidKey(ValueError):
    """An empty key."""


class TooLong(ValueError):
    """A key, bound, value or batch over its limit."""


class CorruptionError(RuntimeError):
    """A stored file that is not what was written."""


@dataclass(frozen=True)
class Options:
    # fixed values: the defaults that callers of such a store expect
    memtable_max_entries: int = 1024
    compaction_trigger: int = 4
    max_key_bytes: int = 4 << 10
    max_value_bytes: int = 4 << 20
    sync_writes: bool = True
    #: Keys and values as bytes instead of text.
    binary: bool = False
    #: Rows of a segment in a file, about.
    rows_per_file: int = 500_000
    #: Read and check every segment when a store is opened.
    verify: bool = True

    def __post_init__(self) -> None:
        if self.memtable_max_entries < 1:
            raise ValueError("memtable_max_entries must be positive")
        if self.compaction_trigger < 2:
            raise ValueError("compaction_trigger must be 2 or more")
        if self.max_key_bytes < 1 or self.max_value_bytes < 1:
            raise ValueError("size limits must be positive")


@dataclass(frozen=True)
class Entry:
    sequence: int
    tombstone: bool
    key: Key
    value: Key


@dataclass(frozen=True)
class Mutation:
    key: Key
    value: Key | None  # None deletes


@dataclass
class Stats:
    memtable_entries: int = 0
    segment_count: int = 0
    sequence: int = 0
    writes: int = 0
    reads: int = 0
    bloom_filter_negatives: int = 0
    flushes: int = 0
    compactions: int = 0
    range_scans: int = 0
    range_entries_returned: int = 0


def entry_schema(binary: bool = False) -> T.StructType:
    kind = T.BinaryType() if binary else T.StringType()
    return T.StructType([T.StructField("key", kind, False), T.StructField("sequence", T.LongType(), False), T.StructField("tombstone", T.BooleanType(), False), T.StructField("value", kind, False)])


def raw(x: Key) -> bytes:
    return x if isinstance(x, bytes) else x.encode()


def check_key(key: Key, options: Options) -> None:
    if not key:
        raise InvalidKey("key is empty")
    check_bound(key, options)


def check_bound(bound: Key, options: Options) -> None:
    if len(raw(bound)) > options.max_key_bytes:
        raise TooLong(f"key has more than {options.max_key_bytes} bytes")


def check_mutation(m: Mutation, options: Options) -> None:
    check_key(m.key, options)
    if m.value is not None and len(raw(m.value)) > options.max_value_bytes:
        raise TooLong(f"value has more than {options.max_value_bytes} bytes")


def check_frame(mutations: DataFrame, options: Options) -> int:
    """Number of rows of a frame of mutations (key, value); raises as `check_mutation` does. One aggregate."""
    bad = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0))
    r = mutations.agg(
        F.count("*").alias("n"),
        bad(F.col("key").isNull() | (F.octet_length("key") == 0)).alias("empty"),
        bad(F.octet_length("key") > options.max_key_bytes).alias("keys"),
        bad(F.octet_length("value") > options.max_value_bytes).alias("values"),
    ).first()
    if r.empty:
        raise InvalidKey(f"{r.empty} keys are empty")
    if r["keys"]:
        raise TooLong(f"{r['keys']} keys have more than {options.max_key_bytes} bytes")
    if r["values"]:
        raise TooLong(f"{r['values']} values have more than {options.max_value_bytes} bytes")
    return r.n
