"""Segments: immutable tables sorted by key, one version per key, with row checksums and a Bloom filter.

A segment is a folder with a name of its own, which no other attempt to write a segment uses, so a writer that loses a
race leaves what has been committed alone. `create` reads back and verifies what it wrote. Every read compares the rows'
checksums, and Parquet those of its pages. In the folder, `rows` is Parquet, dealt into files by key range and sorted in each, with Parquet's own Bloom
filter on the key; `bloom.words` (small filters) or `bloom` (a table of words) is probed without opening `rows`.
"""

from __future__ import annotations

import io
import uuid
from dataclasses import asdict, dataclass

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import bloom, codec
from ..model import CorruptionError, Entry, Key, entry_schema, raw
from ..operators import reads
from ..operators.memtable import Memtable
from .files import Files

#: A filter of this many words at most is held on the driver (1 MiB); of a larger one, the words asked for are read.
HELD_WORDS = 1 << 17


#: Parquet compares the checksums of pages; a key is not looked for in dictionaries first, as these are not checked then.
_READ = {"parquet.page.verify-checksum.enabled": "true", "parquet.filter.dictionary.enabled": "false"}
_BAD = "a row's checksum is wrong"


def _folder(id: int, attempt: str) -> str:
    return f"segments/{id:020d}-{attempt}" if attempt else f"segments/{id:020d}"


def corrupted(e: Exception) -> bool:
    """Whether a failure of Spark is one of a segment's contents."""
    return any(x in str(e) for x in (_BAD, "ParquetDecodingException", "ParquetCrypto", "could not verify page integrity", "CRC checksum", "CANNOT_READ_FILE", "FAILED_READ_FILE", "is not a Parquet file", "ChecksumException"))


@dataclass(frozen=True)
class SegmentInfo:
    id: int
    entries: int
    max_sequence: int
    min_key: str  # hexadecimal
    max_key: str
    bits: int
    hashes: int
    attempt: str = ""

    def as_dict(self) -> dict:
        return asdict(self)

    @property
    def folder(self) -> str:
        return _folder(self.id, self.attempt)

    def overlaps(self, start: bytes, end: bytes | None) -> bool:
        """Whether keys from start up to end (excluded; None: no bound) can be in it."""
        return start <= bytes.fromhex(self.max_key) and (end is None or bytes.fromhex(self.min_key) < end)


class Segment:
    def __init__(self, spark: SparkSession, files: Files, info: SegmentInfo, binary: bool = False) -> None:
        self.spark, self.files, self.info, self.binary = spark, files, info, binary
        self._words: np.ndarray | None = None

    @staticmethod
    def columns(binary: bool) -> T.StructType:
        return T.StructType([*entry_schema(binary).fields, T.StructField("crc", T.LongType(), False)])

    @classmethod
    def create(cls, spark: SparkSession, files: Files, id: int, rows: DataFrame, binary: bool = False, sync: bool = False, rows_per_file: int = 500_000, most: int | None = None, trusted: bool = False) -> Segment:
        """Write rows (key, sequence, tombstone, value; one per key), and read them again.

        most: an upper bound of the number of rows, if known. Repeated keys raise ValueError (they are looked for unless
        `trusted`: rows of an aggregate by key), as does an empty frame.
        """
        attempt = uuid.uuid4().hex
        folder = _folder(id, attempt)
        rows = rows.select("key", "sequence", "tombstone", "value").withColumn("crc", codec.checksum())
        most = rows.count() if most is None else most
        written = cls._written(spark, files, folder, rows, binary, rows_per_file, most)
        s = verified(written, F.min("low").alias("low"), F.max("high").alias("high")).first()
        keys = s.entries if trusted or not s.entries else written.select("key").distinct().count()
        if not s.entries or keys != s.entries:
            files.delete(folder)
            raise ValueError("a segment has one row for each key, and at least one")
        if s.order_violations or s.crc_mismatches:
            files.delete(folder)
            raise CorruptionError(f"segment {id} is not what was written: {s.asDict()}")
        size = bloom.size(s.entries)
        words = bloom.build(written, size)
        held = None
        if size.bits <= 64 * HELD_WORDS:
            held = np.zeros(size.bits // 64, np.uint64)
            found = words.toArrow()
            held[found.column("word").to_numpy()] = found.column("bits").to_numpy().view(np.uint64)
        else:
            words.repartitionByRange(64, "word").sortWithinPartitions("word").write.parquet(files.path(f"{folder}/bloom"))
        low, high = (raw(bytes(x) if isinstance(x, bytearray) else x).hex() for x in (s.low, s.high))
        return cls._opened(spark, files, SegmentInfo(id, s.entries, s.max_sequence, low, high, size.bits, size.hashes, attempt), binary, sync, held)

    @classmethod
    def of_memtable(cls, spark: SparkSession, files: Files, id: int, table: Memtable, binary: bool = False, sync: bool = False) -> Segment:
        """The segment of a memtable: the driver has its rows, and writes the one file without a job."""
        return cls.of_entries(spark, files, id, table.entries(), binary, sync)

    @classmethod
    def of_entries(cls, spark: SparkSession, files: Files, id: int, entries: list[Entry], binary: bool = False, sync: bool = False) -> Segment:
        """The segment of a few entries, one for each key, in order."""
        size, attempt = bloom.size(len(entries)), uuid.uuid4().hex
        kind = pa.binary() if binary else pa.string()
        columns = [pa.array([getattr(e, c) for e in entries], k) for c, k in (("key", kind), ("sequence", pa.int64()), ("tombstone", pa.bool_()), ("value", kind))]
        columns.append(pa.array([codec.crc32(codec.encode(e)) for e in entries], pa.int64()))
        out = io.BytesIO()
        pq.write_table(pa.table(columns, names=cls.columns(binary).names), out, compression="snappy", write_page_checksum=True)
        data = out.getvalue()
        if cls._decoded(data, binary) != entries:
            raise CorruptionError(f"segment {id} is not what was written")
        files.make(f"{_folder(id, attempt)}/rows")
        files.publish(f"{_folder(id, attempt)}/rows/part-00000.snappy.parquet", data, sync)
        held = np.zeros(size.bits // 64, np.uint64)
        for e in entries:
            for at in bloom.places(e.key, size):
                held[at // 64] |= np.uint64(1 << at % 64)
        low, high = raw(entries[0].key).hex(), raw(entries[-1].key).hex()
        return cls._opened(spark, files, SegmentInfo(id, len(entries), max(e.sequence for e in entries), low, high, size.bits, size.hashes, attempt), binary, sync, held)

    @staticmethod
    def _decoded(data: bytes, binary: bool) -> list[Entry]:
        """The entries of a file's bytes, checksums compared."""
        try:
            t = pq.read_table(io.BytesIO(data), page_checksum_verification=True)
        except (OSError, pa.ArrowException) as e:
            raise CorruptionError("a segment's file can't be read") from e
        out = [Entry(*row) for row in zip(*(t.column(c).to_pylist() for c in ("sequence", "tombstone", "key", "value")), strict=True)]
        if [codec.crc32(codec.encode(e)) for e in out] != t.column("crc").to_pylist():
            raise CorruptionError(_BAD)
        return out

    def held_entries(self) -> list[Entry]:
        """All entries, read by the driver: for small segments."""
        names = [n for n in self.files.names(f"{self.info.folder}/rows") if n.endswith(".parquet")]
        return [e for n in names for e in self._decoded(self.files.read(f"{self.info.folder}/rows/{n}"), self.binary)]

    @classmethod
    def _written(cls, spark: SparkSession, files: Files, folder: str, rows: DataFrame, binary: bool, rows_per_file: int, most: int) -> DataFrame:
        parts = -(-most // rows_per_file)
        out = (rows.coalesce(1) if parts <= 1 else rows.repartitionByRange(parts, "key")).sortWithinPartitions("key")
        path = files.path(f"{folder}/rows")
        out.write.option("parquet.bloom.filter.enabled#key", "true").option("parquet.bloom.filter.expected.ndv#key", str(max(1, min(most, rows_per_file)))).parquet(path)
        return spark.read.schema(cls.columns(binary)).options(**_READ).parquet(path)

    @classmethod
    def _opened(cls, spark: SparkSession, files: Files, info: SegmentInfo, binary: bool, sync: bool, held: np.ndarray | None) -> Segment:
        if held is not None:
            files.publish(f"{info.folder}/bloom.words", held.astype("<u8").tobytes(), sync)
        if sync:
            files.sync_folder(info.folder)
        out = cls(spark, files, info, binary)
        out._words = held
        return out

    def rows(self) -> DataFrame:
        """key, sequence, tombstone, value, crc; reading a value fails if its row's checksum is wrong."""
        # in a column, not in a filter: there Catalyst may put a key that is asked for in place of each row's own
        whole = F.when(F.col("crc") == codec.checksum(), F.col("value")).otherwise(F.raise_error(F.lit(_BAD)))
        return self._rows().withColumn("value", whole)

    def _rows(self) -> DataFrame:
        return self.spark.read.schema(self.columns(self.binary)).options(**_READ).parquet(self.files.path(f"{self.info.folder}/rows"))

    def entries(self) -> DataFrame:
        return reads.segment_scan(self.rows())

    def scan(self, start: Key = "", end: Key = "", limit: int | None = None) -> DataFrame:
        """Own rows of start <= key < end, tombstones included."""
        return reads.segment_scan(self.rows(), start, end, limit)

    def get(self, key: Key) -> DataFrame:
        """The key's own version, a tombstone too."""
        return self.rows().where(F.col("key") == reads._lit(self.rows(), key)).select("key", "sequence", "tombstone", "value")

    def may_contain(self, key: Key) -> bool:
        size = bloom.BloomSize(self.info.bits, self.info.hashes)
        if size.bits <= 64 * HELD_WORDS:
            if self._words is None:
                self._words = np.frombuffer(self.files.read(f"{self.info.folder}/bloom.words"), "<u8")
            return bloom.probe(key, self._words, size)
        words = self.spark.read.schema("word long, bits long").parquet(self.files.path(f"{self.info.folder}/bloom"))
        asked = self.spark.range(1).select(F.lit(raw(key) if self.binary else key).alias("key"))
        return not bloom.may_contain(asked, words, size).isEmpty()

    def verify(self) -> None:
        """Raise CorruptionError unless all rows are whole and in order, and agree with the manifest."""
        try:
            r = verified(self._rows()).first()
        except Exception as e:
            raise CorruptionError(f"segment {self.info.id} can't be read") from e
        if r.order_violations or r.crc_mismatches or (r.entries, r.max_sequence) != (self.info.entries, self.info.max_sequence):
            raise CorruptionError(f"segment {self.info.id}: {r.asDict()}")


def verified(rows: DataFrame, *more: Column) -> DataFrame:
    """entries, max_sequence, order_violations, crc_mismatches of a segment's rows: one row (more: over each task's low
    and high keys).

    Order is checked within each task's rows, and between tasks by their first and last keys (a row a task).
    """
    rows = rows.withColumn("_at", F.monotonically_increasing_id()).withColumn("_task", F.spark_partition_id())
    own = Window.partitionBy("_task").orderBy("_at")
    bad = F.when(F.lag("key").over(own) >= F.col("key"), 1).otherwise(0)
    wrong = F.when(F.col("crc") != codec.checksum(), 1).otherwise(0) if "crc" in rows.columns else F.lit(0)
    rows = rows.withColumn("_bad", bad).withColumn("_wrong", wrong)
    tasks = rows.groupBy("_task").agg(F.min("key").alias("low"), F.max("key").alias("high"), F.count("*").alias("n"), F.max("sequence").alias("last"), F.sum("_bad").alias("bad"), F.sum("_wrong").alias("wrong"))
    apart = F.when(F.lag("high").over(Window.orderBy("low", "high")) >= F.col("low"), 1).otherwise(0)
    return tasks.withColumn("_apart", apart).agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("entries"),
        F.max("last").alias("max_sequence"),
        *more,
        F.coalesce(F.sum(F.col("bad") + F.col("_apart")), F.lit(0)).alias("order_violations"),
        F.coalesce(F.sum("wrong"), F.lit(0)).alias("crc_mismatches"),
    )
