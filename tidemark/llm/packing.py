"""Best-two-fit packing (operator 7).

Documents become token ids plus an end id; longer ones than the capacity are cut into whole sequences, with the rest
as first piece. Packing needs the pieces' lengths only, and there are at most `capacity` distinct ones, so the driver
packs the histogram of lengths (bounded whatever the input): a sequence is filled greedily with the longest pieces
that fit, then its smallest piece is exchanged for two unpacked ones that fill the wider gap more tightly. What a
filled sequence looks like depends only on which lengths are left, so the same one is repeated until a length runs
out. Executors then turn (length, rank within the length) into a sequence and an offset by binary search.

Null text: the empty text (one piece, the end id alone). Rows that repeat a `doc_id` are packed each; null `doc_id`
too. An empty table: no rows. Extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import encoder, small_batches, written

#: Pieces of one length in one part at most about this many, so that ranks are found in many tasks.
PART_ROWS = 50_000


def best_two_fit(histogram: dict[int, int], capacity: int) -> list[tuple[list[int], int]]:
    """(lengths in a sequence, number of such sequences), for a histogram of lengths from 1 to `capacity`."""
    left = np.zeros(capacity + 1, np.int64)
    for n, k in histogram.items():
        left[n] = k
    there = left > 0
    out = []

    def longest(most: int) -> int:
        hit = np.flatnonzero(there[1 : most + 1])
        return int(hit[-1]) + 1 if len(hit) else 0

    def take(n: int, by: int = 1) -> None:
        left[n] -= by
        there[n] = left[n] > 0

    while n := longest(capacity):
        filled, gap = [], capacity
        while n:
            filled.append(n)
            take(n)
            gap -= n
            n = longest(gap) if gap else 0
        while gap and len(filled) > 1:
            small = filled[-1]
            for total in range(gap + small, small, -1):
                a = np.flatnonzero(there[1:total] & there[total - 1 : 0 : -1]) + 1
                a = a[(2 * a < total) | ((2 * a == total) & (left[a] > 1))]
                if len(a):
                    break
            else:
                break
            take(small, -1)
            pair = [int(total - a[-1]), int(a[-1])]
            for n in pair:
                take(n)
            filled = sorted(filled[:-1] + pair, reverse=True)
            gap += small - total
        uses = {n: filled.count(n) for n in filled}
        more = int(min(left[n] // k for n, k in uses.items()))
        # the last of a length is left for another round: with one of it less, a pair of equals may be gone
        more = max(0, more - 1) if more and any(left[n] - more * k < 2 for n, k in uses.items()) else more
        for n, k in uses.items():
            take(n, more * k)
        out.append((filled, 1 + more))
    return out


def intervals(packed: list[tuple[list[int], int]]) -> dict[str, np.ndarray]:
    """Where the k-th piece of each length goes: key (length and first rank), first sequence, uses, offsets."""
    key, base, uses, at, offsets, rank, first = [], [], [], [], [], {}, 0
    for filled, times in packed:
        places: dict[int, list[int]] = {}
        offset = 0
        for n in filled:
            places.setdefault(n, []).append(offset)
            offset += n
        for n, own in places.items():
            r = rank.get(n, 0)
            key.append((n << 48) + r)
            base.append(first)
            uses.append(len(own))
            at.append(len(offsets))
            offsets += own
            rank[n] = r + times * len(own)
        first += times
    order = np.argsort(np.array(key, np.int64))
    return {k: np.array(v, np.int64)[order] for k, v in (("key", key), ("base", base), ("uses", uses), ("at", at))} | {"offsets": np.array(offsets, np.int64)}


def pieces(docs: DataFrame, tokenizer: str, end_id: int, capacity: int) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        for b in batches:
            rows: list[list[int]] = [[], [], [], [], []]
            for i, ids in zip(b.column("doc_id").to_pylist(), enc.many(b.column("text").to_pylist()), strict=True):
                ids = np.append(ids, np.uint32(end_id)).astype("<u4")
                start, n = 0, len(ids) % capacity or capacity
                for k in range(-(-len(ids) // capacity)):
                    for column, v in zip(rows, (i, k, start, n, zlib.crc32(ids[start : start + n])), strict=True):
                        column.append(v)
                    start, n = start + n, capacity
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(rows, kinds, strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    small_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return docs.mapInArrow(cut, "doc_id long, piece int, start long, length long, ids_crc32 long")


def pack(docs: DataFrame, tokenizer: str = "byte_bpe_50k.json", end_id: int = 0, capacity: int = 2048) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece of every document."""
    spark = docs.sparkSession
    rows = written(pieces(docs, tokenizer, end_id, capacity), "pieces")
    histogram = {r.length: r["count"] for r in rows.groupBy("length").count().collect()}
    where = spark.sparkContext.broadcast(intervals(best_two_fit(histogram, capacity)))

    # ranks within a length, in two levels, so that a length that many pieces share is dealt over many tasks
    parts = max(64, sum(histogram.values()) // PART_ROWS)
    rows = rows.withColumn("_part", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(parts)).cast("int"))
    counts = rows.groupBy("length", "_part").count()
    counts = counts.select(F.col("length").alias("_l"), F.col("_part").alias("_p"), (F.sum("count").over(Window.partitionBy("length").orderBy("_part")) - F.col("count")).alias("_before"))
    own = Window.partitionBy("length", "_part").orderBy("doc_id", "piece", "ids_crc32")
    rows = rows.withColumn("_own", F.row_number().over(own) - 1)
    rows = rows.join(counts, (rows["length"] == counts["_l"]) & (rows["_part"] == counts["_p"]))
    rows = rows.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("_own") + F.col("_before")).alias("_rank"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = where.value
        for b in batches:
            n, rank = (b.column(c).to_numpy() for c in ("length", "_rank"))
            i = np.searchsorted(w["key"], (n.astype(np.int64) << 48) + rank, "right") - 1
            k = rank - (w["key"][i] & ((1 << 48) - 1))
            sequence, offset = w["base"][i] + k // w["uses"][i], w["offsets"][w["at"][i] + k % w["uses"][i]]
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(sequence), pa.array(offset)], names=[*b.schema.names[:5], "sequence_id", "offset"])

    return rows.mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
