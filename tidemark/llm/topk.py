"""Exact top-k inner products with a three-phase uniform threshold (operator 6).

The components are split into `lists` blocks; a vector's partial scores over the blocks are its entries in the lists.

1. Each task gathers its local score list: the rows that are best in the first list, `WIDE * k` a query and chunk, with
   their exact scores. The k-th best gathered score of a query is a safe cutoff, since that many rows reach it.
2. The cutoffs are broadcast, a number a query. A row that reaches its query's cutoff has an entry of at least
   cutoff / lists in some list, and its known entries plus the largest value that the last list can have (Cauchy-Schwarz)
   reach the cutoff. Rows for which all lists but the last rule this out are left there.
3. Only for the rest is the last list computed, which gives their exact scores; a task returns its k best at most.

Queries are rows of the table that a condition picks; they are handled in blocks of bounded bytes, each against all
rows. Rows are known by a number of their own, so rows that repeat a `vec_id` are queries each and candidates each, for
one another too; only a query's own row is left out. Components become floor(scale * x), so scores are integers, which
have to fit 64 bits. Vectors that are null or hold null or non-finite components take no part; vectors of different
lengths do not meet, empty ones score 0. Ties: the smaller `vec_id`, null last. Empty tables give no rows; extra columns
are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import scratch, small_batches, written

#: Bytes of the query vectors in a block; queries and rows that are multiplied at once.
BLOCK, QUERIES, ROWS = 32 << 20, 1024, 2048
#: Rows of a chunk whose exact scores a query gathers, times k.
WIDE = 4


class Vectors(NamedTuple):
    """Rows of one length: numbers, ids (0 where null), whether they are null, integer vectors."""

    rid: np.ndarray
    id: np.ndarray
    null: np.ndarray
    x: np.ndarray

    def part(self, which) -> Vectors:
        return Vectors(*(a[which] for a in self))


def _vectors(table: pa.Table | pa.RecordBatch, scale: float) -> Iterator[Vectors]:
    """The rows of each length."""
    if isinstance(table, pa.Table):
        table = table.combine_chunks().to_batches()[0] if table.num_rows else pa.RecordBatch.from_arrays([pa.array([], f.type) for f in table.schema], schema=table.schema)
    lists = table.column("embedding")
    ends = np.asarray(lists.offsets)
    flat = np.floor(scale * np.asarray(lists.values).astype(np.float64))
    own = np.asarray(table.column("rid"))
    ids, null = np.asarray(table.column("vec_id").fill_null(0)), np.asarray(table.column("vec_id").is_null())
    n = np.diff(ends)
    for d in np.unique(n):
        rows = np.flatnonzero(n == d)
        yield Vectors(own[rows], ids[rows], null[rows], flat[ends[rows][:, None] + np.arange(d)])


def _chunks(batches: Iterator[pa.RecordBatch], scale: float) -> Iterator[Vectors]:
    """Batches in groups of about ROWS rows."""
    held, n = [], 0
    for b in batches:
        held.append(b)
        n += b.num_rows
        if n >= ROWS:
            yield from _vectors(pa.Table.from_batches(held), scale)
            held, n = [], 0
    if held:
        yield from _vectors(pa.Table.from_batches(held), scale)


def exact(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Integer products of the rows of q with the rows of x, one by one; floats while they hold them exactly."""
    if not q.size:
        return np.zeros(len(q), np.int64)
    if np.abs(q).max() * np.abs(x).max() * q.shape[1] < 2.0**53:
        return np.einsum("ij,ij->i", q, x).astype(np.int64)
    return np.array([sum(int(a) * int(b) for a, b in zip(i, j, strict=True)) for i, j in zip(q, x, strict=True)], np.int64)


def local_list(q: Vectors, x: Vectors, first: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(query, row) of the rows that are best in the first list."""
    part = q.x[:, first] @ x.x[:, first].T
    n = min(most, part.shape[1])
    rows = np.argpartition(-part, n - 1, axis=1)[:, :n]
    at = np.repeat(np.arange(len(part)), n), rows.reshape(-1)
    other = q.rid[at[0]] != x.rid[at[1]]
    return at[0][other], at[1][other]


def survivors(q: Vectors, x: Vectors, cuts: Sequence[np.ndarray], cutoff: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(query, row) of those that all lists but the last do not rule out. Bounds carry a slack for rounding."""
    *known, last = cuts
    share = (cutoff / len(cuts))[:, None]
    rest = np.linalg.norm(q.x[:, last], axis=1)[:, None] * np.linalg.norm(x.x[:, last], axis=1)[None, :]
    least = np.abs(rest).max(initial=0.0)
    total, reached = np.zeros_like(rest), rest * (1 + 1e-9) + 1 >= share
    for c in known:
        part = q.x[:, c] @ x.x[:, c].T
        least = max(least, np.abs(part).max(initial=0.0))
        reached |= part * (1 + 1e-9) + 1 >= share
        total += part
    may = reached & (total + rest + (1 + 1e-9 * least) >= cutoff[:, None])
    may &= q.rid[:, None] != x.rid[None, :]
    return np.nonzero(may)


class Best:
    """The k best (score, id) of each query: larger scores first, then smaller ids, null last."""

    def __init__(self, k: int) -> None:
        self.k, self.held, self.n = k, [], 0

    def add(self, query: np.ndarray, score: np.ndarray, id_: np.ndarray, null: np.ndarray) -> None:
        self.held.append((query, score, id_, null))
        self.n += len(query)
        if self.n > 1 << 18:
            self.held = [self.top()]
            self.n = len(self.held[0][0])

    def top(self) -> tuple[np.ndarray, ...]:
        if not self.held:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)
        query, score, id_, null = (np.concatenate(a) for a in zip(*self.held, strict=True))
        order = np.lexsort((id_, null, -score, query))
        query = query[order]
        rank = np.arange(len(query)) - np.searchsorted(query, query, "left")
        order = order[rank < self.k]
        return tuple(np.concatenate(a)[order] for a in zip(*self.held, strict=True))


_OUT = "query long, query_id long, vec_id long, score long"


def _search(rows: DataFrame, queries: pa.Table, k: int, lists: int, scale: float) -> DataFrame:
    """query (its row's number), query_id, vec_id, score: each task's k best at most, for one block of queries."""
    spark = rows.sparkSession
    held = spark.sparkContext.broadcast({v.x.shape[1]: v for v in _vectors(queries, scale)})  # BLOCK bytes at most

    def scan(batches: Iterator[pa.RecordBatch], cutoffs: dict[int, int] | None) -> Iterator[pa.RecordBatch]:
        best = {d: Best(k) for d in held.value}
        for x in _chunks(batches, scale):
            d = x.x.shape[1]
            if d not in best:
                continue
            cuts = np.array_split(np.arange(d), max(2, lists))
            for a in range(0, len(held.value[d].rid), QUERIES):
                q = held.value[d].part(slice(a, a + QUERIES))
                if cutoffs is None:
                    i, j = local_list(q, x, cuts[0], WIDE * k)
                else:
                    i, j = survivors(q, x, cuts, np.array([cutoffs.get(int(r), -np.inf) for r in q.rid]))
                for b in range(0, len(i), 1 << 16):
                    ii, jj = i[b : b + (1 << 16)], j[b : b + (1 << 16)]
                    best[d].add(a + ii, exact(q.x[ii], x.x[jj]), x.id[jj], x.null[jj])
        for d, b in best.items():
            at, score, id_, null = b.top()
            q = held.value[d]
            yield pa.RecordBatch.from_arrays([pa.array(q.rid[at]), pa.array(q.id[at], mask=q.null[at]), pa.array(id_, mask=null), pa.array(score)], names=["query", "query_id", "vec_id", "score"])

    local = rows.mapInArrow(lambda it: scan(it, None), _OUT)
    rank = Window.partitionBy("query").orderBy(F.desc("score"))
    kth = local.withColumn("_r", F.row_number().over(rank)).where(F.col("_r") == k).select("query", "score")
    cut = spark.sparkContext.broadcast({r["query"]: r.score for r in kth.collect()})  # a number per query of the block
    return rows.mapInArrow(lambda it: scan(it, cut.value), _OUT)


def top_k(vectors: DataFrame, queries: Column, k: int = 5, lists: int = 8, scale: float = 256.0, block: int = BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score: the k best other rows of `vectors` (vec_id, embedding) for each row that fits the
    condition `queries`."""
    spark = vectors.sparkSession
    small_batches(spark)
    whole = F.col("embedding").isNotNull() & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    picked = F.coalesce(queries, F.lit(False)).alias("picked")
    # written with a number for each row, which any later read of the table sees again
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding", picked).where(whole)
    rows = written(rows.withColumn("rid", F.monotonically_increasing_id()), "vectors")
    size = rows.where("picked").agg(F.sum(8 * F.size("embedding") + 16)).first()[0] or 0
    path, blocks = scratch(spark, "topk"), -(-size // block)
    for n in range(blocks):
        own = rows.where(F.col("picked") & (F.pmod(F.xxhash64("rid"), F.lit(blocks)) == n)).select("rid", "vec_id", "embedding")
        _search(rows.select("rid", "vec_id", "embedding"), own.toArrow(), k, lists, scale).write.mode("append").parquet(path)
    if not blocks:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    found = spark.read.schema(_OUT).parquet(path)
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("vec_id")))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op6_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 50 == 0)


SQL = """
WITH v AS (SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.rid, q.vec_id AS query_id, c.vec_id,
             CAST(list_sum(list_transform(generate_series(1, len(q.e)), lambda i: q.e[i] * c.e[i])) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.rid <> c.rid AND len(q.e) = len(c.e))
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5
"""
