"""Token ids in ORC files (operator 10): run-length encoded integers, row indexes and Bloom filters on document ids.

Documents are range-partitioned by id, sorted, encoded and written, one file a partition. Readers split the files by
stripe; a lookup by `doc_id` is pushed down to stripe statistics, row indexes and Bloom filters.

Null text: the empty text, so its ids are the end id alone. Null `doc_id` sorts first. Rows that repeat a `doc_id` each
keep their own ids, ordered by a hash of the text (equal rows: in any order, which changes nothing). An empty table:
no rows. Extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import encoder, scratch, small_batches, written

SCHEMA = "part int, pos long, doc_id long, ids array<int>"
OPTIONS = {"orc.bloom.filter.columns": "doc_id", "orc.bloom.filter.fpp": "0.01", "orc.create.index": "true", "orc.row.index.stride": "2000", "orc.stripe.size": str(32 << 20), "compression": "lz4"}


def write_tokens(docs: DataFrame, path: str, tokenizer: str = "byte_bpe_50k.json", end_id: int = 2) -> None:
    """Write the ids of every whole text and `end_id` after each, in ascending `doc_id` order, as ORC under `path`.

    `part` and `pos` give the order over all files. The text crosses the network once, in the range exchange.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part, pos = encoder(tokenizer), TaskContext.get().partitionId(), 0
        for b in batches:
            ids = [np.append(x, np.uint32(end_id)) for x in enc.many(b.column("text").to_pylist())]
            ends = np.cumsum([0, *map(len, ids)]).astype(np.int32)
            flat = np.concatenate(ids).astype(np.int32) if ids else np.zeros(0, np.int32)
            n = len(ids)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n, part, np.int32)), pa.array(np.arange(pos, pos + n)), b.column("doc_id"), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], names=["part", "pos", "doc_id", "ids"])
            pos += n

    small_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("_h"))
    rows = rows.repartitionByRange("doc_id", "_h").sortWithinPartitions("doc_id", "_h").select("doc_id", "text")
    rows.mapInArrow(encode, SCHEMA).write.options(**OPTIONS).orc(path)


def read_tokens(spark: SparkSession, path: str, doc_ids: list[int] | None = None) -> DataFrame:
    """part, pos, doc_id, ids of all documents, or of those asked for (pruned by metadata)."""
    rows = spark.read.schema(SCHEMA).orc(path)
    return rows if doc_ids is None else rows.where(F.col("doc_id").isin([int(x) for x in doc_ids]))


def with_starts(rows: DataFrame) -> DataFrame:
    """Per document of the files: doc_id, start, n_tokens, ids_crc32.

    `start` is a prefix sum in two levels: over the files' totals (a row a file), and within each file.
    """

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column("ids")
            ends = np.asarray(lists.offsets)
            flat = np.asarray(lists.values).astype("<u4")
            crc = np.array([zlib.crc32(flat[a:z]) for a, z in zip(ends[:-1], ends[1:], strict=True)], np.int64)
            yield pa.RecordBatch.from_arrays([b.column("part"), b.column("pos"), b.column("doc_id"), pa.array(np.diff(ends).astype(np.int64)), pa.array(crc)], names=["part", "pos", "doc_id", "n_tokens", "ids_crc32"])

    small_batches(rows.sparkSession)
    # written, as it is read twice: the files of ids are read once
    rows = written(rows.mapInArrow(digest, "part int, pos long, doc_id long, n_tokens long, ids_crc32 long"), "token-digest")
    totals = rows.groupBy("part").agg(F.sum("n_tokens").alias("_n"))
    before = totals.select("part", (F.sum("_n").over(Window.orderBy("part")) - F.col("_n")).alias("_before"))
    within = Window.partitionBy("part").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_within", F.coalesce(F.sum("n_tokens").over(within), F.lit(0)))
    return rows.join(before, "part").select("doc_id", (F.col("_before") + F.col("_within")).alias("start"), "n_tokens", "ids_crc32")


def op10_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "tokens")
    write_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), path)
    return with_starts(read_tokens(spark, path))
