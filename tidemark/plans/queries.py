"""The registered queries of the store's operators, each with DuckDB SQL over the same tables."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import bloom, codec
from ..model import Mutation, Options
from ..operators import reads, resolve
from ..sources.segment import verified
from ..sources.store import Database
from .logs import SQL as LOGS
from .logs import customers, events_log, orders_log

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def _query(sql: str | None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _latest(source: str) -> str:
    return f"(SELECT * FROM {source} QUALIFY row_number() OVER (PARTITION BY key ORDER BY sequence DESC) = 1)"


def _with(body: str) -> str:
    return f"WITH {LOGS.strip()}\n{body}"


def _visible(source: str, where: str = "true", tail: str = "") -> str:
    return _with(f"SELECT key, value FROM {_latest(source)} WHERE NOT tombstone AND {where} {tail}")


def _nth(log: DataFrame, deleted: bool) -> str:
    """The smallest key that is (not) deleted."""
    return resolve.latest(log).where(F.col("tombstone") == deleted).agg(F.min("key")).first()[0] or ""


@_query(_with(f"SELECT key, value FROM {_latest('l1')} WHERE key = (SELECT min(key) FROM {_latest('l1')} WHERE NOT tombstone)"))
def q01_point_get_live(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = events_log(spark, sf_dir)
    return reads.get(log, _nth(log, False))


@_query(_with(f"SELECT k.key, v.value FROM (SELECT min(key) AS key FROM {_latest('l1')} GROUP BY tombstone) k LEFT JOIN (SELECT * FROM {_latest('l1')} WHERE NOT tombstone) v USING (key)"))
def q02_point_get_deleted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A deleted key, whose value is null, beside a live one."""
    log = events_log(spark, sf_dir)
    keys = resolve.latest(log).groupBy("tombstone").agg(F.min("key").alias("key")).select("key")
    return reads.multi_get(log, keys)


@_query(_with("SELECT batch_id, key, value FROM l1 QUALIFY row_number() OVER (PARTITION BY batch_id, key ORDER BY sequence DESC) = 1"))
def q03_batch_last_duplicate_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve.flushed(events_log(spark, sf_dir), "batch_id").select("batch_id", "key", "value")


@_query(_visible("l1", "key >= 'user:000020' AND key < 'user:000080'"))
def q04_range_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reads.scan(events_log(spark, sf_dir), "user:000020", "user:000080")


@_query(_visible("l1", "key >= 'user:000100'"))
def q05_range_scan_unbounded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reads.scan(events_log(spark, sf_dir), "user:000100", "")


@_query(_visible("l1", "key >= 'user:000010'", "ORDER BY key LIMIT 25"))
def q06_range_scan_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reads.scan(events_log(spark, sf_dir), "user:000010", "", 25)


@_query(_visible("l1", "false"))
def q07_range_scan_inverted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reads.scan(events_log(spark, sf_dir), "user:000080", "user:000020")


@_query(_visible("l1", "starts_with(key, 'user:00001')"))
def q08_prefix_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reads.scan_prefix(events_log(spark, sf_dir), "user:00001")


@_query(_visible("l1", "true", "ORDER BY key LIMIT 20"))
def q09_prefix_scan_empty_prefix_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reads.scan_prefix(events_log(spark, sf_dir), "", 20)


@_query(_visible("l1"))
def q10_visible_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve.visible(events_log(spark, sf_dir))


@_query(_visible("l1"))
def q11_multi_level_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = events_log(spark, sf_dir)
    level = F.pmod(F.expr("sequence div 2500"), F.lit(4))
    levels = [resolve.latest(log.where(level == k)) for k in range(4)]
    return resolve.visible(resolve.merge(levels))


@_query(_visible("(SELECT * FROM l1 UNION ALL SELECT * FROM l2)"))
def q12_multi_keyspace_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve.visible(resolve.merge([events_log(spark, sf_dir), orders_log(spark, sf_dir)]))


@_query(_with(f"SELECT key, sequence, tombstone, value FROM {_latest('l1')}"))
def q13_compaction_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = events_log(spark, sf_dir).drop("batch_id")
    old, new = log.where(F.col("sequence") <= 5000), log.where(F.col("sequence") > 5000)
    return resolve.compacted([resolve.latest(old), resolve.latest(new)])


@_query(_with(f"SELECT key, sequence, tombstone, value FROM {_latest('l2')}"))
def q14_compaction_idempotent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve.compacted([resolve.compacted([orders_log(spark, sf_dir).drop("batch_id")])])


@_query(_with(f"SELECT key, value FROM {_latest('l1')} WHERE NOT tombstone"))
def q15_stale_version_rejected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A second arrival of every version, under an older sequence, changes nothing."""
    log = events_log(spark, sf_dir)
    stale = log.withColumn("sequence", F.col("sequence") - 1_000_000_000).withColumn("value", F.lit("stale")).withColumn("tombstone", F.lit(False))
    return resolve.visible(log.unionByName(stale))


@_query(_with("SELECT batch_id, min(sequence) AS first_sequence, max(sequence) AS last_sequence, count(*)::BIGINT AS entries FROM l1 GROUP BY batch_id"))
def q16_batch_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve.batches(events_log(spark, sf_dir))


@_query(_with(f"SELECT key, sequence, tombstone, value FROM {_latest('l1')} WHERE key >= 'user:000050' ORDER BY key LIMIT 20"))
def q17_segment_scan_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    segment = resolve.latest(events_log(spark, sf_dir))
    return reads.segment_scan(segment, "user:000050", "", 20)


@_query(_visible("(SELECT * FROM l1 WHERE batch_id < 60)"))
def q18_replay_valid_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An entry of batch 60 is missing, so the batches before it apply."""
    log = events_log(spark, sf_dir)
    expected = log.groupBy("batch_id").agg(F.count("*").alias("entries"))
    torn = log.where((F.col("batch_id") != 60) | (F.col("sequence") % 100 != 1))
    return resolve.visible(resolve.replayed(torn, expected))


@_query(_with("SELECT level, key, sequence, tombstone, value FROM (SELECT *, (sequence - 1) // 2500 AS level FROM l1) QUALIFY row_number() OVER (PARTITION BY level, key ORDER BY sequence DESC) = 1"))
def q19_flush_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = events_log(spark, sf_dir).withColumn("level", F.expr("(sequence - 1) div 2500"))
    return resolve.flushed(log, "level")


@_query(_with(f"SELECT max(sequence) AS sequence, (SELECT count(*) FROM l1)::BIGINT AS writes, (count(*) FILTER (WHERE NOT tombstone))::BIGINT AS live_keys, (count(*) FILTER (WHERE tombstone))::BIGINT AS tombstones FROM {_latest('l1')}"))
def q20_stats_logical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One shuffle: versions are counted in the aggregate that resolves them."""
    log = events_log(spark, sf_dir)
    last = F.max(F.struct("sequence", "tombstone"))
    keys = log.groupBy("key").agg(last.alias("last"), F.count("*").alias("n"))
    gone = F.col("last.tombstone")
    return keys.agg(F.max("last.sequence").alias("sequence"), F.sum("n").alias("writes"), F.count(F.when(~gone, 1)).alias("live_keys"), F.count(F.when(gone, 1)).alias("tombstones"))


def _little_endian(number: str, size: int) -> str:
    return "[" + ", ".join(f"({number} >> {8 * k}) & 255" for k in range(size)) + "]"


def _bytes(text: str) -> str:
    return f"list_transform(range(octet_length(encode({text}))), lambda k: ('0x' || substr(hex(encode({text})), 2 * k + 1, 2))::BIGINT)"


#: An entry's bytes as numbers; the checksum takes each, and then eight single bits (-1).
_ENTRY = " || ".join([_little_endian("tombstone::BIGINT", 1), _little_endian("sequence", 8), _little_endian("octet_length(encode(key))::BIGINT", 4), _little_endian("octet_length(encode(value))::BIGINT", 4), _bytes("key"), _bytes("value")])
_STEPS = f"flatten(list_transform({_ENTRY}, lambda b: [b, -1, -1, -1, -1, -1, -1, -1, -1]))"
_CRC = f"xor(list_reduce(list_prepend(4294967295, {_STEPS}), lambda c, b: CASE WHEN b >= 0 THEN xor(c, b) WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END), 4294967295)"


@_query(_with(f"SELECT key, sequence, {_CRC}::BIGINT AS crc FROM l1"))
def q21_entry_checksums(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events_log(spark, sf_dir).select("key", "sequence", codec.checksum().alias("crc"))


@_query(_with("SELECT DISTINCT key FROM l1"))
def q22_bloom_no_false_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The keys that the filter lets pass: all of those it was built of."""
    keys = events_log(spark, sf_dir).select("key").distinct()
    size = bloom.size(keys.count())
    return bloom.may_contain(keys, bloom.build(keys, size), size).select("key")


@_query(_with(f"SELECT count(*)::BIGINT AS entries, max(sequence) AS max_sequence, 0::BIGINT AS order_violations FROM {_latest('l1')}"))
def q23_verify_segment(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = resolve.latest(events_log(spark, sf_dir))
    return verified(rows.repartitionByRange("key").sortWithinPartitions("key")).select("entries", "max_sequence", "order_violations")


@_query(_with(f"SELECT k.key, v.value FROM (SELECT 'user:' || lpad(CAST(c_custkey AS VARCHAR), 6, '0') AS key FROM customer) k LEFT JOIN (SELECT key, value FROM {_latest('l1')} WHERE NOT tombstone) v USING (key)"))
def q24_multi_get(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.concat(F.lit("user:"), F.lpad(F.col("c_custkey").cast("string"), 6, "0")).alias("key"))
    return reads.multi_get(events_log(spark, sf_dir), keys)


@_query("SELECT c_name AS key, c_mktsegment AS value FROM customer WHERE c_name >= 'Customer#000000100' AND c_name < 'Customer#000000900'")
def q25_range_scan_stored_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reads.scan(customers(spark, sf_dir), "Customer#000000100", "Customer#000000900")


@_query("SELECT doc_id, octet_length(encode(text))::BIGINT AS bytes FROM documents ORDER BY text, doc_id LIMIT 100")
def q26_byte_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first texts in unsigned byte order, in four languages."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return d.orderBy("text", "doc_id").limit(100).select("doc_id", F.octet_length("text").cast("long").alias("bytes"))


@_query(_with(f"SELECT key, max(CASE WHEN keep THEN value END) AS value FROM (SELECT key, value, row_number() OVER (PARTITION BY key ORDER BY sequence DESC) = 1 AND NOT tombstone AS keep FROM l1 WHERE sequence <= 5000) GROUP BY key HAVING bool_or(keep)"))
def q27_time_travel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The view as of a sequence (an extension)."""
    return resolve.visible(events_log(spark, sf_dir).where(F.col("sequence") <= 5000))


_RANGES = "(SELECT c_custkey AS range_id, 'user:' || lpad(CAST(c_custkey % 150 AS VARCHAR), 6, '0') AS start, 'user:' || lpad(CAST(c_custkey % 150 + 40 AS VARCHAR), 6, '0') AS stop FROM customer)"


@_query(_with(f"SELECT range_id, key, value FROM {_RANGES} r JOIN (SELECT key, value FROM {_latest('l1')} WHERE NOT tombstone) v ON v.key >= r.start AND v.key < r.stop QUALIFY row_number() OVER (PARTITION BY range_id ORDER BY key) <= 10"))
def q28_multi_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A range for each customer, ten rows at most from each (an extension)."""
    name = lambda n: F.concat(F.lit("user:"), F.lpad(n.cast("string"), 6, "0"))
    at = F.col("c_custkey") % 150
    ranges = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("range_id"), name(at).alias("start"), name(at + 40).alias("end"))
    return reads.multi_scan(events_log(spark, sf_dir), ranges, 10)


def _shared(spark: SparkSession) -> str:
    """A fresh path in the folder that driver and executors share."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="tidemark-")
    return f"{base.rstrip('/')}/tidemark-store-{uuid.uuid4().hex}"


@_query(_with(f"SELECT key, value FROM {_latest('l1')} WHERE NOT tombstone AND key <> 'user:000001' UNION ALL SELECT 'user:last', 'é'"))
def q29_store_on_disk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log through a store's files: two frames, a flush, a compaction, a batch in the log; opened again, which verifies the
    segment and replays the batch. The store stays in the shared folder, as the result reads it."""
    path, options = _shared(spark), Options(sync_writes=False)
    log = events_log(spark, sf_dir).select("key", F.when(~F.col("tombstone"), F.col("value")).alias("value"), "sequence")
    db = Database(spark, path, options)
    db.put("user:000001", "overwritten")
    db.write_frame(log.where("sequence <= 5000"), "sequence")  # flushes what was put
    db.write_frame(log.where("sequence > 5000"), "sequence")
    db.compact()
    db.write_batch([Mutation("user:last", "e"), Mutation("user:000001", None), Mutation("user:last", "é")])
    return Database(spark, path, options).view()
