"""Point, range and prefix reads over a log, in byte order, with the limit after resolution."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..model import Key
from .resolve import latest, visible


def successor(prefix: bytes) -> bytes | None:
    """The least byte string above all that start with `prefix`; None if there is no bound."""
    cut = prefix.rstrip(b"\xff")
    return cut[:-1] + bytes([cut[-1] + 1]) if cut else None


def _is_binary(log: DataFrame) -> bool:
    return dict(log.dtypes)["key"] == "binary"


def _lit(log: DataFrame, key: Key) -> Column:
    if _is_binary(log):
        return F.lit(bytearray(key if isinstance(key, bytes) else key.encode()))
    return F.lit(key)


def in_range(log: DataFrame, start: Key = "", end: Key = "") -> DataFrame:
    """Rows with start <= key < end; an empty end is no bound. The bounds reach the Parquet scan."""
    if end and start >= end:
        return log.limit(0)
    if start:
        log = log.where(F.col("key") >= _lit(log, start))
    return log.where(F.col("key") < _lit(log, end)) if end else log


def with_prefix(log: DataFrame, prefix: Key = "") -> DataFrame:
    """Rows whose key starts with `prefix`: pushed down as such for text, as a range for bytes."""
    if not prefix:
        return log
    if _is_binary(log):
        first = prefix if isinstance(prefix, bytes) else prefix.encode()
        return in_range(log, first, successor(first) or b"")
    return log.where(F.col("key").startswith(prefix))


def _ordered(rows: DataFrame, limit: int | None) -> DataFrame:
    rows = rows.orderBy("key")
    return rows if limit is None else rows.limit(limit)


def get(log: DataFrame, key: Key) -> DataFrame:
    """key, value: one row, or none."""
    return visible(log.where(F.col("key") == _lit(log, key)))


def multi_get(log: DataFrame, keys: DataFrame) -> DataFrame:
    """key, value (null: not there) for each row of `keys`; only versions of asked keys are resolved."""
    asked = log.join(keys.select("key").distinct(), "key", "left_semi")
    return keys.select("key").join(visible(asked), "key", "left")


def scan(log: DataFrame, start: Key = "", end: Key = "", limit: int | None = None) -> DataFrame:
    """key, value of start <= key < end, ascending, `limit` visible rows at most."""
    return _ordered(visible(in_range(log, start, end)), limit)


def scan_prefix(log: DataFrame, prefix: Key = "", limit: int | None = None) -> DataFrame:
    """key, value of the keys that start with `prefix`, ascending."""
    return _ordered(visible(with_prefix(log, prefix)), limit)


def segment_scan(segment: DataFrame, start: Key = "", end: Key = "", limit: int | None = None) -> DataFrame:
    """A segment's own rows in key order, tombstones included and counted."""
    return _ordered(in_range(segment, start, end).select("key", "sequence", "tombstone", "value"), limit)


def entries(log: DataFrame) -> DataFrame:
    """All latest versions in key order, tombstones included."""
    return latest(log).orderBy("key")


def multi_scan(log: DataFrame, ranges: DataFrame, limit: int) -> DataFrame:
    """range_id, key, value: for each row of `ranges` (range_id, start, end; null or empty: no bound) its first `limit`
    visible rows.

    Keys and bounds are dealt by key range together and counted in order, which gives each bound the number of keys
    below it; a range then fetches its rows by rank. Work grows with keys, ranges and rows returned, not their product.
    """
    view = visible(log)
    empty = F.lit(bytearray()) if _is_binary(log) else F.lit("")
    start = ranges.select("range_id", F.coalesce("start", empty).alias("key"), F.lit(True).alias("first"))
    end = ranges.where(F.octet_length("end") > 0).select("range_id", F.col("end").alias("key"), F.lit(False).alias("first"))
    keys = view.select("key", "value", F.lit(None).cast(dict(ranges.dtypes)["range_id"]).alias("range_id"), F.lit(None).cast("boolean").alias("first"), F.lit(1).alias("is_key"))
    bounds = start.unionByName(end).withColumn("value", empty).withColumn("is_key", F.lit(0))
    # a bound sorts in front of its own key, so it counts the keys below it
    # kept: both uses must see the same parts, and a range exchange samples its bounds anew each time it runs. A
    # checkpoint lies in the cluster's shared folder and survives lost executors; without one (local mode) on disk.
    dealt = keys.unionByName(bounds).repartitionByRange("key").sortWithinPartitions("key", "is_key").withColumn("_part", F.spark_partition_id())
    context = log.sparkSession.sparkContext
    shared = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    dealt = dealt.checkpoint() if shared else dealt.persist(StorageLevel.DISK_ONLY)
    own = Window.partitionBy("_part").orderBy("key", "is_key").rowsBetween(Window.unboundedPreceding, -1)
    counted = dealt.withColumn("_own", F.coalesce(F.sum("is_key").over(own), F.lit(0)))
    totals = dealt.groupBy("_part").agg(F.sum("is_key").alias("_n"))
    before = totals.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))  # a row a part
    ranked = counted.join(F.broadcast(before), "_part").withColumn("rank", F.col("_own") + F.col("_before"))
    asked = ranked.where("is_key = 0").groupBy("range_id").agg(F.max(F.when(F.col("first"), F.col("rank"))).alias("a"), F.max(F.when(~F.col("first"), F.col("rank"))).alias("b"))
    asked = asked.withColumn("b", F.least(F.col("a") + limit, F.coalesce(F.col("b"), F.col("a") + limit)) - 1).where("a <= b")
    asked = asked.select("range_id", F.explode(F.sequence("a", "b")).alias("rank"))
    return asked.join(ranked.where("is_key = 1").select("rank", "key", "value"), "rank").select("range_id", "key", "value")
