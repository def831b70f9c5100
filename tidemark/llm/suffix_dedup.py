"""Removal of repeated long strings with a logarithmic family of sparse suffix arrays (operator 8).

A byte goes if it lies in a `length`-byte string that also starts anywhere else in the input, the same document
included. Suffixes are sampled: every window of `length` bytes picks the smallest hash among its `gram`-byte strings, so
equal windows pick the same place, and only those suffixes are kept. Each stands for a run of neighbouring windows.

`SuffixLevels` keeps the family. A suffix array is a table of (head, gram, run, ...), in buckets by hash of the first
two and sorted in each: head is the suffix's first eight bytes (`gram`, if fewer) as a number, so order is that of the suffixes; ties go by
the hash of their first `gram` bytes, and then by the hash of all bytes that the run's windows have (their context).
A new batch of documents

1. is stored by row, and its suffixes are sampled and sorted into an array of their own;
2. is merge-scanned with the array of each level: merge joins, without an exchange, find the suffixes of both that have
   their first `gram` bytes in common with another one; only these are grouped. Runs with equal contexts are repeated in
   all their windows.
   Otherwise the windows of the different runs are compared one by one: the stored texts give the contexts, also those
   of earlier batches;
3. goes to level 0; two arrays of a level are merge-joined into one of the next. Of suffixes with equal contexts one stays.

So documents of earlier batches lose what a later one repeats, and `removed` gives all batches or the latest alone.

Hot groups: equal runs are collapsed by each sampling task before the exchange, and once more in the array. Grams with
more than `CROWDED` different runs are compared in aggregates instead of in one task: by blocks of `WINDOWS` windows,
and window by window where these differ.

Comparisons use two 64-bit hashes (a run's gram and content, a window's gram and content; within the few thousand
windows that a task holds at once, one of both). Documents are rows; a row is known by its id (a hash of the text where
null) and a 64-bit hash of id and text, so equal rows share their spans, and count as repeats of each other. Null text:
empty. Texts shorter than `length`: untouched. Very long texts are hashed in segments. Empty tables give no rows; extra
columns are ignored, whatever their names.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bucketed, buckets, dropped, release, scratch, small_batches, table, written

LENGTH, GRAM = 200, 40
#: Grams with more different runs than this are compared in an aggregate.
CROWDED = 20_000
#: Bytes hashed at once.
SEGMENT = 1 << 19
#: Suffixes of a task among which equal runs are collapsed.
COLLAPSED = 1 << 17
_BASE = 0x9E3779B97F4A7C15
#: Contexts that a task cuts out at once.
CUT = 4096
#: Windows of a block, in groups that are compared in an aggregate.
WINDOWS = 16
_ROW = ["r1", "r2"]
_KEY = ["head", "gram"]
_OWN = [*_ROW, "s", "n", "at"]
_LINES = "dup boolean, head long, gram long, run long, r1 long, r2 long, s int, n short, at short, m long"


@functools.cache
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A random number for each byte; powers of the base and of its inverse modulo 2^64."""

    def powers(base: int) -> np.ndarray:
        out, n = np.ones(SEGMENT + 1, np.uint64), 1
        while n < len(out):
            m = min(n, len(out) - n)
            out[n : n + m] = out[:m] * np.uint64(pow(base, n, 1 << 64))
            n += m
        return out

    return np.random.default_rng(8).integers(0, 1 << 64, 256, np.uint64), powers(_BASE), powers(pow(_BASE, -1, 1 << 64))


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


def _sums(b: np.ndarray) -> np.ndarray:
    """Sums from which the hash of any of the bytes' substrings follows."""
    code, _, inverse = _tables()
    out = np.zeros(len(b) + 1, np.uint64)
    np.cumsum(code[b] * inverse[: len(b)], out=out[1:])
    return out


def _hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return (sums[end] - sums[start]) * _tables()[1][start]


def runs(pieces: list[bytes], length: int, gram: int) -> tuple[np.ndarray, ...]:
    """head, gram, run, piece, first window, number of windows, place of the suffix after the first window of each sampled
    suffix; at most SEGMENT bytes in all."""
    sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
    offsets = np.cumsum(sizes) - sizes
    b = np.frombuffer(b"".join(pieces), np.uint8)
    sums = _sums(b)
    at = np.arange(len(b) - gram + 1)
    h = _mix(_hash(sums, at, at + gram))
    wide, done = length - gram + 1, 1
    least = (h & ~np.uint64(SEGMENT - 1)) | at.astype(np.uint64)  # ties: the first place
    while 2 * done <= wide:
        least = np.minimum(least[:-done], least[done:])
        done *= 2
    if wide > done:
        least = np.minimum(least[: len(least) - (wide - done)], least[wide - done :])
    windows = np.concatenate([np.arange(o, o + n - length + 1) for o, n in zip(offsets, sizes, strict=True)])
    place = (least[windows] & np.uint64(SEGMENT - 1)).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
    n = np.diff(np.append(first, len(place)))
    start, place = windows[first], place[first]
    end = start + n - 1 + length
    run = _mix(_hash(sums, start, end) + n.astype(np.uint64) * np.uint64(0x2545F4914F6CDD1D) + (place - start).astype(np.uint64))
    piece = np.searchsorted(offsets, start, "right") - 1
    first8 = np.lib.stride_tricks.sliding_window_view(np.concatenate([b, np.zeros(8, np.uint8)]), 8)[place]
    head = np.ascontiguousarray(first8).view(">u8")[:, 0].astype(np.uint64)
    head = (head >> np.uint64(8 * (8 - min(8, gram)))) ^ np.uint64(1 << 63)
    return head, h[place], run, piece, start - offsets[piece], n, place - start


def stored(docs: DataFrame) -> DataFrame:
    """r1, r2, doc_id, bytes of each row."""
    doc_id, text = F.col("doc_id").cast("long"), F.coalesce("text", F.lit(""))
    return docs.select(F.coalesce(doc_id, F.xxhash64(F.lit(1), text)).alias("r1"), F.xxhash64(doc_id, text).alias("r2"), doc_id.alias("doc_id"), text.cast("binary").alias("bytes"))


def suffixes(texts: DataFrame, length: int, gram: int) -> DataFrame:
    """The sampled suffixes of r1, r2, bytes. Equal runs among COLLAPSED suffixes of a task become one row (m: their
    number); each of those is given as well, as a row with `dup`."""

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: list[tuple[np.ndarray, ...]] = []
        rows = 0

        def close(pieces: list[bytes], r1: list[int], r2: list[int], shift: list[int]) -> None:
            nonlocal rows
            if pieces:
                head, g, r, piece, s, n, at = runs(pieces, length, gram)
                made.append((head.view(np.int64), g.view(np.int64), r.view(np.int64), np.array(r1, np.int64)[piece], np.array(r2, np.int64)[piece], (s + np.array(shift, np.int64)[piece]).astype(np.int32), n.astype(np.int16), at.astype(np.int16)))
                rows += len(n)

        def collapse() -> Iterator[pa.RecordBatch]:
            nonlocal rows
            if not made:
                return
            columns = [np.concatenate(c) for c in zip(*made, strict=True)]
            made.clear()
            rows = 0
            order = np.lexsort((columns[2], columns[1]))
            columns = [c[order] for c in columns]
            new = np.concatenate([[True], (columns[1][1:] != columns[1][:-1]) | (columns[2][1:] != columns[2][:-1])])
            first = np.flatnonzero(new)
            m = np.diff(np.append(first, len(new)))
            dup = np.repeat(m > 1, m)
            names = ["dup", "head", "gram", "run", *_OWN, "m"]
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(first), bool)), *(pa.array(c[first]) for c in columns), pa.array(m)], names=names)
            if dup.any():
                yield pa.RecordBatch.from_arrays([pa.array(np.ones(dup.sum(), bool)), *(pa.array(c[dup]) for c in columns), pa.array(np.ones(dup.sum(), np.int64))], names=names)

        for b in batches:
            held: tuple[list, list, list, list] = ([], [], [], [])
            size = 0
            for x, y, whole in zip(b.column("r1").to_pylist(), b.column("r2").to_pylist(), b.column("bytes"), strict=True):
                whole = whole.as_py()
                for a in range(0, len(whole) - length + 1, SEGMENT - length + 1):
                    part = whole[a : a + SEGMENT]
                    if size + len(part) > SEGMENT:
                        close(*held)
                        held, size = ([], [], [], []), 0
                    for column, v in zip(held, (part, x, y, a), strict=True):
                        column.append(v)
                    size += len(part)
                    if rows >= COLLAPSED:
                        yield from collapse()
            close(*held)
        yield from collapse()

    small_batches(texts.sparkSession)
    return texts.select("r1", "r2", "bytes").mapInArrow(sample, _LINES)


class SuffixLevels:
    """Sparse suffix arrays in levels; level k holds an array of 2^k batches or nothing. `add` takes new batches of
    documents (doc_id, text); `removed` gives them without what any of them repeats."""

    def __init__(self, spark: SparkSession, length: int = LENGTH, gram: int = GRAM, crowded: int | None = None) -> None:
        self.spark, self.length, self.gram = spark, length, gram
        self.crowded = CROWDED if crowded is None else crowded
        self.buckets = buckets(spark)
        self.levels: list[str | None] = []
        self.texts: list[str] = []  # by batch
        self.spans: list[DataFrame] = []

    def add(self, docs: DataFrame) -> None:
        """Store a batch, find what it repeats of itself and of all batches before it, and add its array."""
        spark = self.spark
        rows = stored(docs).repartition(self.buckets, *_ROW)
        self.texts.append(bucketed(rows, "texts", self.buckets, _ROW, _ROW, compression="zstd"))
        path = scratch(spark, "suffixes")
        suffixes(table(spark, self.texts[-1]), self.length, self.gram).write.partitionBy("dup").parquet(path)
        sampled = spark.read.schema(_LINES).parquet(path)
        lines = sampled.where("not dup").drop("dup").repartition(self.buckets, *_KEY)
        batch = bucketed(lines, "array", self.buckets, _KEY, [*_KEY, "run"])
        shared = written(self.merge_scan(table(spark, batch)), "shared")
        span = (*_ROW, F.col("s").cast("long").alias("a"), (F.col("s") + F.col("n") - 1 + self.length).cast("long").alias("b"))
        spans = sampled.where("dup").select(*span).union(shared.where("full and m = 1").select(*span))
        self.spans.append(written(spans.unionByName(self.compared(shared.where("edge"))), "spans"))
        dropped(spark, path)
        self._push(batch)
        release(spark)

    def merge_scan(self, new: DataFrame) -> DataFrame:
        """The suffixes of a new batch's array and of the levels' arrays whose gram occurs again, once in the new batch at
        least: with full (all windows repeated), edge (to be compared; one of the runs that are equal), crowded."""
        gram, run = Window.partitionBy(*_KEY), Window.partitionBy(*_KEY, "run")
        several = new.groupBy(*_KEY).count().where(F.col("count") > 1).select(*_KEY).hint("merge")
        parts, rest = [new.join(several, _KEY, "left_semi")], new.join(several, _KEY, "left_anti")
        for level in self.levels:
            if level:
                old = table(self.spark, level)
                parts += [rest.join(old.select(*_KEY).hint("merge"), _KEY, "left_semi"), old.join(new.select(*_KEY).hint("merge"), _KEY, "left_semi")]
                rest = rest.join(old.select(*_KEY).hint("merge"), _KEY, "left_anti")
        # all parts lie by hash of the key, so the groups need no exchange either
        met = functools.reduce(DataFrame.unionByName, parts)
        own = F.struct(*_OWN)
        met = met.withColumn("full", F.sum("m").over(run) > 1).withColumn("_own", F.min(own).over(run) == own)
        several, crowded = F.min("run").over(gram) != F.max("run").over(gram), F.sum(F.col("_own").cast("int")).over(gram) > self.crowded
        met = met.withColumn("edge", several & F.col("_own")).withColumn("crowded", crowded).drop("_own")
        return met.where("edge or (full and m = 1)")

    def compared(self, edges: DataFrame) -> DataFrame:
        """r1, r2, a, b of the windows that different runs of a gram share."""
        spark, length = self.spark, self.length
        edge = F.struct(*_KEY, "crowded", "full", *(F.col(c).cast("long").alias(c) for c in ("s", "n", "at"))).alias("e")
        per_row = bucketed(edges.select(*_ROW, edge).repartition(self.buckets, *_ROW).groupBy(*_ROW).agg(F.collect_set("e").alias("edges")), "edges", self.buckets, _ROW, _ROW)

        def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                column = b.column("edges")
                count, edges, whole = column.value_lengths().to_numpy(), column.flatten(), b.column("bytes")
                own = np.repeat(np.arange(len(count)), count)
                first, n = edges.field("s").to_numpy(), edges.field("n").to_numpy()
                for k in range(0, len(own), CUT):
                    o, e = pa.array(own[k : k + CUT]), edges.slice(k, CUT)
                    context, at, row = [], -1, b""
                    for i in range(k, min(k + CUT, len(own))):
                        if own[i] != at:
                            at, row = own[i], whole[int(own[i])].as_py()
                        context.append(row[first[i] : first[i] + n[i] - 1 + length])
                    names = [*_KEY, "crowded", "full", "s", "at"]
                    yield pa.RecordBatch.from_arrays([*(b.column(c).take(o) for c in _ROW), *(e.field(c) for c in names), pa.array(context, pa.binary())], names=[*_ROW, *names, "bytes"])

        kind = "r1 long, r2 long, head long, gram long, crowded boolean, full boolean, s long, at long, bytes binary"
        # one join a batch of texts, so that none needs an exchange
        parts = [table(spark, t).join(table(spark, per_row), _ROW).select(*_ROW, "bytes", "edges").mapInArrow(cut, kind) for t in self.texts]
        contexts = written(functools.reduce(DataFrame.union, parts), "contexts")
        dropped(spark, per_row)
        few = contexts.where("not crowded").select(*_KEY, *_ROW, "s", "full", "bytes").repartition(*_KEY).sortWithinPartitions(*_KEY)
        out = few.mapInArrow(functools.partial(_compare, length=length), "r1 long, r2 long, a long, b long")
        crowd = contexts.where("crowded")
        return out if crowd.isEmpty() else out.unionByName(self._crowd(crowd))

    def _crowd(self, contexts: DataFrame) -> DataFrame:
        """As `compared`, for grams with many different runs: by aggregates, first over blocks of windows, which settle
        most, then over single windows of one block of each kind."""
        length = self.length

        def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                h, own, j = _window_hashes(b.column("bytes").to_pylist(), length)
                left = b.column("at").to_numpy()[own] - j  # bytes in front of the suffix; equal windows have equal ones
                new = np.flatnonzero(np.concatenate([[True], (own[1:] != own[:-1]) | (left[1:] // WINDOWS != left[:-1] // WINDOWS)])) if len(own) else np.zeros(0, np.int64)
                n = np.diff(np.append(new, len(own)))
                kind = np.add.reduceat(_mix(h + left.astype(np.uint64)), new) if len(new) else np.zeros(0, np.uint64)
                first, ends = pa.array(own[new]), pa.array(np.append(new, len(own)).astype(np.int32))
                columns = [b.column("gram").take(first), pa.array(kind.view(np.int64)), b.column("r1").take(first), b.column("r2").take(first), pa.array(b.column("s").to_numpy()[own[new]] + j[new]), pa.array(n), b.column("full").take(first), pa.ListArray.from_arrays(ends, pa.array(h.view(np.int64)))]
                yield pa.RecordBatch.from_arrays(columns, names=["gram", "kind", *_ROW, "a", "n", "full", "h"])

        def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                n = b.column("n").to_numpy()
                own = np.repeat(np.arange(len(n)), n)
                j = np.arange(len(own)) - np.repeat(np.cumsum(n) - n, n)
                own_ = pa.array(own)
                yield pa.RecordBatch.from_arrays([b.column("gram").take(own_), b.column("h").flatten(), b.column("r1").take(own_), b.column("r2").take(own_), pa.array(b.column("a").to_numpy()[own] + j), b.column("done").take(own_)], names=["gram", "h", *_ROW, "a", "done"])

        made = written(contexts.mapInArrow(blocks, "gram long, kind long, r1 long, r2 long, a long, n long, full boolean, h array<long>"), "blocks")
        own = F.struct(*_ROW, "a")
        same = written(made.groupBy("gram", "kind").agg(F.count("*").alias("c"), F.min(own).alias("own")).where("c > 1").select("gram", "kind", "own"), "same")
        whole = made.where("not full").join(same, ["gram", "kind"], "left_semi").select(*_ROW, "a", (F.col("a") + F.col("n") - 1 + length).alias("b"))
        one = made.join(same, ["gram", "kind"], "left").where(F.col("own").isNull() | (F.col("own") == own))
        one = one.select("gram", *_ROW, "a", "n", "h", (F.col("full") | F.col("own").isNotNull()).alias("done"))
        windows = written(one.mapInArrow(spread, "gram long, h long, r1 long, r2 long, a long, done boolean"), "windows")
        again = written(windows.groupBy("gram", "h").count().where(F.col("count") > 1).select("gram", "h"), "again")
        rest = windows.where("not done").join(again, ["gram", "h"], "left_semi")
        return whole.union(rest.select(*_ROW, "a", (F.col("a") + length).alias("b")))

    def _push(self, batch: str) -> None:
        """Put a batch's array on level 0, and merge levels of one size as a carry does."""
        # an array lies by hash of head and gram, which is enough for joins by these and run
        self.spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
        own = F.min(F.struct(*_OWN)).alias("own")
        one = table(self.spark, batch).groupBy(*_KEY, "run").agg(own, F.sum("m").alias("m")).select(*_KEY, "run", "own.*", "m")
        gone, level = [batch], 0
        while level < len(self.levels) and (old := self.levels[level]):
            path = self._write(self.merged(table(self.spark, old), one), level + 1)
            dropped(self.spark, old, *gone)
            one, gone, self.levels[level], level = table(self.spark, path), [path], None, level + 1
        if level == 0:
            gone = [self._write(one, 0)]
            dropped(self.spark, batch)
        self.levels += [None] * (level + 1 - len(self.levels))
        self.levels[level] = gone[0]

    def _write(self, rows: DataFrame, level: int) -> str:
        return bucketed(rows, f"array-l{level}", self.buckets, _KEY, [*_KEY, "run"])

    def merged(self, x: DataFrame, y: DataFrame) -> DataFrame:
        """Two arrays as one: a full merge join without an exchange; of equal runs the first owner stays."""
        keys = [*_KEY, "run"]
        x, y = x.alias("x"), y.hint("merge").alias("y")
        both = x.join(y, functools.reduce(lambda p, q: p & q, (F.col(f"x.{k}") == F.col(f"y.{k}") for k in keys)), "full_outer")
        own = F.least(*(F.when(F.col(f"{t}.m").isNotNull(), F.struct(*(F.col(f"{t}.{c}").alias(c) for c in _OWN))) for t in "xy")).alias("own")
        m = (F.coalesce("x.m", F.lit(0)) + F.coalesce("y.m", F.lit(0))).alias("m")
        return both.select(*(F.coalesce(f"x.{k}", f"y.{k}").alias(k) for k in keys), own, m).select(*keys, "own.*", "m")

    def removed(self, latest: bool = False, texts: bool = False) -> DataFrame:
        """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row of all batches (or the latest), and `kept`
        (binary) if `texts`."""
        if not self.texts:
            return self.spark.createDataFrame([], _DIGEST + (", kept binary" if texts else ""))
        spans = functools.reduce(DataFrame.union, self.spans).select(*_ROW, F.struct("a", "b").alias("span"))
        per_row = spans.groupBy(*_ROW).agg(F.collect_set("span").alias("spans"))
        per_row = bucketed(per_row, "spans", self.buckets, _ROW, _ROW)
        parts = [table(self.spark, t).join(table(self.spark, per_row), _ROW, "left").select("doc_id", "bytes", "spans") for t in (self.texts[-1:] if latest else self.texts)]
        names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", *(["kept"] if texts else [])]

        def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                made = [(whole, _merged([(x["a"], x["b"]) for x in spans or []])) for whole, spans in zip(b.column("bytes").to_pylist(), b.column("spans").to_pylist(), strict=True)]
                digests = [_digest(*x) for x in made]
                columns = [b.column("doc_id"), *(pa.array([d[k] for d in digests], pa.int64()) for k in range(3)), pa.array([d[3] for d in digests], pa.string())]
                columns += [pa.array([_kept(*x) for x in made], pa.binary())] if texts else []
                yield pa.RecordBatch.from_arrays(columns, names=names)

        return functools.reduce(DataFrame.union, [p.mapInArrow(digest, _DIGEST + (", kept binary" if texts else "")) for p in parts])


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _kept(whole: bytes, spans: list[tuple[int, int]]) -> bytes:
    at, parts = 0, []
    for a, b in spans:
        parts.append(whole[at:a])
        at = b
    return b"".join([*parts, whole[at:]])


def _digest(whole: bytes, spans: list[tuple[int, int]]) -> tuple[int, int, int, str]:
    return len(whole), sum(b - a for a, b in spans), len(spans), hashlib.sha256(_kept(whole, spans)).hexdigest()


_DIGEST = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def _window_hashes(contexts: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, context number and place of every window of the contexts."""
    hashes, owner, place, k = [], [], [], 0
    while k < len(contexts):
        stop, size = k, 0
        while stop < len(contexts) and size + len(contexts[stop]) <= SEGMENT:
            size += len(contexts[stop])
            stop += 1
        sizes = np.fromiter(map(len, contexts[k:stop]), np.int64, stop - k)
        offsets, n = np.cumsum(sizes) - sizes, sizes - length + 1
        own = np.repeat(np.arange(stop - k), n)
        j = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        at = offsets[own] + j
        hashes.append(_mix(_hash(_sums(np.frombuffer(b"".join(contexts[k:stop]), np.uint8)), at, at + length)))
        owner.append(own + k)
        place.append(j)
        k = stop
    return tuple(np.concatenate(x) for x in (hashes, owner, place)) if hashes else (np.zeros(0, np.uint64), *[np.zeros(0, np.int64)] * 2)


def _compare(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """r1, r2, a, b of windows that occur in two contexts of a gram; the rows come sorted by gram."""

    def close(table: pa.Table) -> Iterator[pa.RecordBatch]:
        if not table.num_rows:
            return
        h, own, j = _window_hashes(table.column("bytes").to_pylist(), length)
        h = _mix(h + table.column("gram").to_numpy().view(np.uint64)[own] * np.uint64(0x2545F4914F6CDD1D))
        order = np.argsort(h)
        h = h[order]
        same = h[1:] == h[:-1]
        twice = np.zeros(len(h), bool)
        twice[order[1:][same]] = twice[order[:-1][same]] = True
        del h, order, same
        twice &= ~table.column("full").to_numpy(zero_copy_only=False)[own]
        own, j = own[twice], j[twice]
        new = np.flatnonzero(np.concatenate([[True], (own[1:] != own[:-1]) | (j[1:] != j[:-1] + 1)])) if len(own) else np.zeros(0, np.int64)
        last = np.append(new[1:], len(own)) - 1 if len(own) else new
        s = table.column("s").to_numpy()[own[new]]
        yield pa.RecordBatch.from_arrays([*(pa.array(table.column(c).to_numpy()[own[new]]) for c in _ROW), pa.array(s + j[new]), pa.array(s + j[last] + length)], names=[*_ROW, "a", "b"])

    held: list[pa.RecordBatch] = []
    rows = 0
    for b in batches:
        held.append(b)
        rows += b.num_rows
        if rows >= 2048:  # whole grams only; the last may go on in the next batch
            table = pa.Table.from_batches(held)
            head, g = table.column("head").to_numpy(), table.column("gram").to_numpy()
            cut = int(np.flatnonzero((g != g[-1]) | (head != head[-1]))[-1]) + 1 if (g != g[-1]).any() else 0
            yield from close(table.slice(0, cut))
            held = table.slice(cut).to_batches()
            rows = table.num_rows - cut
    if held:
        yield from close(pa.Table.from_batches(held))


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, batches: int = 4, texts: bool = False, crowded: int | None = None) -> DataFrame:
    """`SuffixLevels.removed` of all rows, which are dealt to batches by a hash of their id and added one after another."""
    levels = SuffixLevels(docs.sparkSession, length, gram, crowded)
    for k in range(batches):
        levels.add(docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(batches)) == k))
    out = levels.removed(texts=texts)
    dropped(docs.sparkSession, *(level for level in levels.levels if level))
    return out


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


#: Windows by their MD5, cut from blocks of 512, as cutting from a long text takes time in proportion to its length.
SQL = """
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, '')))::BIGINT AS n FROM documents
), w AS (
  SELECT r, s, md5_number(substr(part, 2 * (s % 512)::BIGINT + 1, 400)) AS k
  FROM (SELECT r, part, unnest(range(b, least(b + 512, n - 199))) AS s
        FROM (SELECT r, n, b, substr(h, 2 * b + 1, 1422) AS part FROM (SELECT r, n, h, unnest(range(0, n - 199, 512)) AS b FROM d)))
), twice AS (
  SELECT r, s FROM w WHERE k IN (SELECT k FROM w GROUP BY k HAVING count(*) > 1)
), spans AS (
  SELECT r, min(s) AS a, max(s) + 200 AS b
  FROM (SELECT r, s, sum(new) OVER (PARTITION BY r ORDER BY s) AS g
        FROM (SELECT r, s, CASE WHEN s <= lag(s) OVER (PARTITION BY r ORDER BY s) + 200 THEN 0 ELSE 1 END AS new FROM twice))
  GROUP BY r, g
), kept AS (
  SELECT r, a, b, lag(b, 1, 0) OVER (PARTITION BY r ORDER BY a) AS was FROM (SELECT r, a, b FROM spans UNION ALL SELECT r, n, n FROM d)
)
SELECT doc_id, n AS n_bytes, (sum(k.b - k.a))::BIGINT AS n_removed, (count(*) FILTER (WHERE k.b > k.a))::BIGINT AS n_spans,
       sha256(unhex(string_agg(substr(h, 2 * was + 1, 2 * (k.a - was)), '' ORDER BY k.a, k.b))) AS kept_sha256
FROM d JOIN kept k USING (r) GROUP BY r, doc_id, n
"""
