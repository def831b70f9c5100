"""SimHash near-dedup (operator 5).

Fingerprints: words are parted by ASCII white space, A-Z lower-cased; a shingle's XXH64 (seed 42) votes on each of 64
bits, repeats included. Texts with fewer words than a shingle have one shingle, texts without words the fingerprint 0.

Links, at `radius` or fewer differing bits: a fingerprint is embedded as the bit counts of 32 segments of two bits,
written in unary, so that the Manhattan distance of two embeddings is a population count; it never exceeds the Hamming
distance. The 32 coordinates are dealt to `radius + 3` blocks; two embeddings within `radius` of each other agree in
at least three whole blocks, so cells of a grid on each three blocks hold all links (range join on grid cells). In the
join's condition the Manhattan bound comes first, then the exact distance, and a pair counts in its first common cell
only. Equal fingerprints are collapsed beforehand, so copies cost nothing there.

`near_duplicates` works at a similarity instead (Jaccard on sets of shingles), in two passes, both verified on whole
texts. The first joins clumps of copies at little cost: its candidates come from the grid and from bands of a
one-permutation min-hash, in whose cells each member meets `PICKS` members only. The second finds every link that is
left: sets are put in one order of all shingles, and two that are alike share so many of their first shingles (a prefix
filter, exact under any order; shingles that are common in a sample come last, so that cells stay small). Members of a
cell that the first pass has joined are not compared again. Texts are known by 128 bits of hash.

Tables that grow with the documents meet in sorted shuffles, so the driver's memory doesn't grow with them; broadcast are
the texts that pairs ask for, up to `FEW`, and by Spark's own choice crowded cells and groups, whose estimates hold.

Null or empty text: no words. Very long texts are read whole, a row at a time. Null ids have no part in a component's
smallest id (null where all are null); of a group, `deduplicate` keeps the smallest id, null last, ties by hash of the
text, and one of rows that repeat both. Repeated rows are linked like any others. Empty tables give no rows; extra
columns are kept by `near_duplicates` and `deduplicate`, whatever their names (but `_nd_group`, which the former adds).
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh, packed, shuffled, small_batches, written
from .components import components

SEGMENTS = 32
_LOW = 0x5555555555555555
#: Min-hash: bands times rows bins. At similarity 0.8 a pair misses every band with a chance of 0.00005.
BANDS, ROWS = 25, 5
#: Members of a cell of the grid beyond which it is divided again.
CROWDED = 2000
#: Members of a min-hash cell that all of its members are compared with in the first pass.
PICKS = 3
#: Texts, about, from which the order of shingles is learned, and shingles kept of them.
SAMPLE, COMMON = 4096, 1 << 16
#: Shingles that a task which verifies pairs holds, about.
HELD = 1 << 20
#: Texts up to which a table of their hashes is broadcast.
FEW = 1 << 16


def shingle_hashes(text: str | None, words: int) -> np.ndarray:
    """XXH64 of each shingle, in order."""
    import xxhash

    w = (text or "").encode().lower().split()
    if len(w) <= words:
        return np.array([xxhash.xxh64_intdigest(b" ".join(w), 42)] if w else [], np.uint64)
    whole = b" ".join(w)
    ends = np.cumsum(np.fromiter(map(len, w), np.int64, len(w)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    digest = xxhash.xxh64_intdigest
    pairs = zip(starts[: len(w) - words + 1].tolist(), ends[words - 1 :].tolist(), strict=True)
    return np.fromiter((digest(whole[a:z], 42) for a, z in pairs), np.uint64, len(w) - words + 1)


def fingerprint(hashes: np.ndarray) -> int:
    """The majority of each bit, as a signed 64-bit integer."""
    if not len(hashes):
        return 0
    votes = np.zeros(64, np.int64)
    for a in range(0, len(hashes), 1 << 16):
        votes += np.unpackbits(hashes[a : a + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * votes > len(hashes), bitorder="little").view(np.int64)[0])


def bands(hashes: np.ndarray) -> np.ndarray:
    """A key for each band of the one-permutation min-hash; empty bins borrow from the next full one."""
    n = BANDS * ROWS
    mixed = hashes * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(32)
    bins = np.full(n, np.iinfo(np.uint64).max, np.uint64)
    np.minimum.at(bins, (mixed % np.uint64(n)).astype(np.int64), mixed)
    full = np.flatnonzero(bins != np.iinfo(np.uint64).max)
    if not len(full):
        return np.zeros(BANDS, np.int64)
    bins = bins[full[np.searchsorted(full, np.arange(n)) % len(full)]] + np.arange(n, dtype=np.uint64)
    key = np.zeros(BANDS, np.uint64)
    for row in bins.reshape(BANDS, ROWS).T:
        key = (key + row) * np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(32)
    return key.view(np.int64)


def prefix(hashes: np.ndarray, similarity: float, common: tuple[np.ndarray, np.ndarray]) -> tuple[int, np.ndarray]:
    """Number of different shingles, and the first of them in the common order: one of these is in any set as similar.

    common: sorted shingles and their counts; the others count 0. The empty set has one token of its own.
    """
    x = np.unique(hashes)
    if not len(x):
        return 0, np.zeros(1, np.int64)
    known, counts = common
    count = np.zeros(len(x), np.int64)
    if len(known):
        at = np.minimum(np.searchsorted(known, x), len(known) - 1)
        count = np.where(known[at] == x, counts[at], 0)
    first = len(x) - math.ceil(similarity * len(x) - 1e-6) + 1
    return len(x), x[np.argsort(count, kind="stable")[:first]].view(np.int64)


def common_shingles(texts: DataFrame, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles in three or more of a sample of the different texts (k1, k2, text), sorted, and their counts."""
    n = max(1, texts.count() // SAMPLE)
    sample = texts.where(F.pmod("k1", F.lit(n)) == 0).groupBy("k1", "k2").agg(F.first("text").alias("text")).select("text")

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for t in b.column("text"):
                yield pa.RecordBatch.from_arrays([pa.array(np.unique(shingle_hashes(t.as_py(), words)).view(np.int64))], names=["h"])

    found = sample.mapInArrow(spread, "h long").groupBy("h").count().where(F.col("count") > 2).orderBy(F.desc("count"), "h").limit(COMMON).toArrow()
    h, count = found.column("h").to_numpy().view(np.uint64), found.column("count").to_numpy()
    order = np.argsort(h)
    return h[order], count[order]


def fingerprints(docs: DataFrame, words: int) -> DataFrame:
    """doc_id, fp of each row."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = [fingerprint(shingle_hashes(t.as_py(), words)) for t in b.column("text")]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(fp, pa.int64())], names=["doc_id", "fp"])

    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(count, "doc_id long, fp long")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def embedding(fp: Column) -> Column:
    """Bit counts of the two-bit segments, each in unary: 00, 01 or 11."""
    low = F.lit(_LOW)
    a, b = fp.bitwiseAND(low), F.shiftrightunsigned(fp, 1).bitwiseAND(low)
    return a.bitwiseOR(b).bitwiseOR(F.shiftleft(a.bitwiseAND(b), 1))


def _blocks(segments: list[int], n: int) -> list[int]:
    """Bit masks of the segments, dealt to n blocks."""
    edges = [round(k * len(segments) / n) for k in range(n + 1)]
    return [sum(3 << 2 * s for s in segments[a:z]) for a, z in zip(edges, edges[1:], strict=False)]


def _agreeing(apart: Column, masks: list[Column]) -> Column:
    """A bit for each block in which two embeddings agree."""
    out = F.lit(0)
    for k, m in enumerate(masks):
        out = out.bitwiseOR(F.when(apart.bitwiseAND(m) == 0, F.lit(1 << k)).otherwise(F.lit(0)))
    return out


def links(fps: DataFrame, radius: int = 4, crowded: int = CROWDED) -> DataFrame:
    """a, b of every pair of the distinct fingerprints `fp` that differ in at most `radius` bits, a < b.

    The members of a cell with more than `crowded` of them are dealt to cells of a second grid, on three of `radius + 3`
    blocks of the segments that the first cell leaves open: the same argument holds for these.
    """
    n = radius + 3
    combos = [sum(1 << k for k in c) for c in combinations(range(n), 3)]
    below = F.array(*(F.lit(((1 << m.bit_length() - 1) - 1) & ~m if m in combos else 0) for m in range(1 << n)))
    masks = _blocks(list(range(SEGMENTS)), n)

    def covered(blocks: list[int], combo: int) -> int:
        return sum(x for k, x in enumerate(blocks) if combo >> k & 1)

    rows = fps.select("fp", embedding(F.col("fp")).alias("u"))
    cells = [F.struct(F.lit(m).alias("m"), F.xxhash64(F.lit(m), F.col("u").bitwiseAND(F.lit(_signed(covered(masks, m))))).alias("h")) for m in combos]
    rows = rows.select("fp", F.explode(F.array(*cells)).alias("c")).select("fp", F.col("c.m").cast("short").alias("m"), "c.h")
    full = written(rows.groupBy("m", "h").count().where(F.col("count") > crowded).select("m", "h"), "crowded")

    def pairs(cells: DataFrame, on: list[str], inner: bool) -> DataFrame:
        x, y = cells.alias("x"), cells.alias("y")
        apart = embedding(F.col("x.fp")).bitwiseXOR(embedding(F.col("y.fp")))
        m = F.col("x.m").cast("int")
        same = _agreeing(apart, [F.lit(_signed(k)) for k in masks])
        near = (F.bit_count(apart) <= radius) & (F.bit_count(F.col("x.fp").bitwiseXOR(F.col("y.fp"))) <= radius)
        first = (same.bitwiseAND(m) == m) & (same.bitwiseAND(F.get(below, m)) == 0)
        if inner:
            m2 = F.col("x.m2").cast("int")
            same2 = _agreeing(apart, [F.get(F.get(open_blocks, m), F.lit(k)) for k in range(n)])
            first = first & (same2.bitwiseAND(m2) == m2) & (same2.bitwiseAND(F.get(below, m2)) == 0)
        cell = functools.reduce(lambda p, q: p & q, (F.col(f"x.{c}") == F.col(f"y.{c}") for c in on))
        return shuffled(x).join(y, cell & (F.col("x.fp") < F.col("y.fp")) & near & first).select(F.col("x.fp").alias("a"), F.col("y.fp").alias("b"))

    left_open = {m: _blocks([s for s in range(SEGMENTS) if not covered(masks, m) >> 2 * s & 1], n) for m in combos}
    open_blocks = F.array(*(F.array(*(F.lit(_signed(k)) for k in left_open.get(m, [0]))) for m in range(1 << n)))
    open_cells = F.array(*(F.array(*(F.lit(_signed(covered(left_open[m], c))) for c in combos)) if m in left_open else F.array(F.lit(0).cast("long")) for m in range(1 << n)))
    dense = rows.join(full, ["m", "h"], "left_semi").select("fp", "m", "h", F.posexplode(F.get(open_cells, F.col("m").cast("int"))).alias("k", "mask"))
    dense = dense.select("fp", "m", F.get(F.array(*map(F.lit, combos)), F.col("k")).cast("short").alias("m2"), F.xxhash64("h", "m", "k", embedding(F.col("fp")).bitwiseAND(F.col("mask"))).alias("h2"))
    return pairs(rows.join(full, ["m", "h"], "left_anti"), ["h", "m"], False).union(pairs(dense, ["h2", "m", "m2"], True))


def group(docs: DataFrame, words: int = 4, radius: int = 4) -> DataFrame:
    """doc_id, fp, component_id of every row."""
    rows = written(fingerprints(docs, words), "fingerprints")
    fps = written(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    roots = components(links(fps, radius))
    own = fps.join(shuffled(roots), fps["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    own = written(own, "roots")
    ids = written(own.groupBy("root").agg(F.min("least").alias("component_id")), "ids")
    return rows.join(shuffled(own.join(shuffled(ids), "root").select("fp", "component_id")), "fp").select("doc_id", "fp", "component_id")


def op5_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = group(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _left_open(sketches: DataFrame, roots: DataFrame, similarity: float) -> DataFrame:
    """a, b of all pairs of nodes with different roots that may be as similar, by the prefix filter.

    Two alike sets overlap by similarity / (1 + similarity) of their sizes' sum at least, so the first shingle they share
    must have as many left behind it, itself included, in both. In each cell the pairs within its most frequent root
    are left out before the join. Of the pairs that meet, those stay whose prefixes share enough: what two sets share is
    either in both prefixes, or behind the prefix of the one whose prefix ends first.
    """
    tokens = sketches.select("node", "n", F.posexplode("prefix").alias("at", "token")).select("token", "node", "n", (F.col("n") - F.col("at")).alias("rest"))
    shared = written(tokens.groupBy("token").count().where(F.col("count") > 1).select("token"), "shared")
    tokens = tokens.join(shuffled(shared), "token", "left_semi").join(shuffled(roots), "node", "left").withColumn("root", F.coalesce("root", "node"))
    tokens = written(tokens, "tokens")
    heads = tokens.groupBy("token", "root").count().groupBy("token").agg(F.max_by("root", "count").alias("most"), F.count("*").alias("roots"))
    heads = written(heads.where(F.col("roots") > 1).select("token", "most"), "heads")
    tokens = written(tokens.join(shuffled(heads), "token"), "open")
    x, y = tokens.where(F.col("root") != F.col("most")).alias("x"), tokens.alias("y")
    overlap = F.lit(similarity / (1 + similarity)) * (F.col("x.n") + F.col("y.n")) - 1e-6
    alike = (F.col("x.rest") >= overlap) & (F.col("y.rest") >= overlap)
    once = (F.col("y.root") == F.col("y.most")) | (F.col("x.node") < F.col("y.node"))
    both = shuffled(x).join(y, (F.col("x.token") == F.col("y.token")) & (F.col("x.root") != F.col("y.root")) & once & alike)
    met = both.select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b")).distinct()
    own = sketches.select("node", "n", "prefix")
    a, b = (own.select(*(F.col(c).alias(f"{c}_{k}") for c in own.columns)) for k in "ab")
    sets = met.join(shuffled(a), met["a"] == a["node_a"]).join(shuffled(b), met["b"] == b["node_b"])
    rest = F.greatest(F.col("n_a") - F.size("prefix_a"), F.col("n_b") - F.size("prefix_b"))
    missing = F.lit(similarity / (1 + similarity)) * (F.col("n_a") + F.col("n_b")) - rest - 1e-6
    return sets.where(F.size(F.array_intersect("prefix_a", "prefix_b")) >= missing).select("a", "b")


def _verified(pairs: DataFrame, texts: DataFrame, names: DataFrame, words: int, similarity: float) -> DataFrame:
    """The pairs a, b of nodes whose texts (k1, k2, text; names: k1, k2, node) are as similar."""
    pairs = written(pairs.distinct(), "pairs")
    # the texts that occur in pairs, one row each; copies are collapsed before the shuffle
    asked = pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).distinct()
    asked = written(names.join(shuffled(asked), "node", "left_semi"), "asked")
    if asked.count() <= FEW:
        whole = texts.join(F.broadcast(asked), ["k1", "k2"]).groupBy("node").agg(F.first("text").alias("text"))
    else:
        whole = texts.groupBy("k1", "k2").agg(F.first("text").alias("text")).join(shuffled(asked), ["k1", "k2"]).select("node", "text")
    whole = written(whole, "texts")
    ta, tb = (whole.select(F.col("node").alias(k), F.col("text").alias(f"t{k}")) for k in "ab")
    both = pairs.join(shuffled(ta), "a").join(shuffled(tb), "b")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets: dict[int, np.ndarray] = {}
        size = 0

        def known(node: int, text: pa.Scalar) -> np.ndarray:
            nonlocal size
            if node not in sets:
                if size > HELD:
                    sets.clear()
                    size = 0
                sets[node] = np.unique(shingle_hashes(text.as_py(), words))
                size += len(sets[node])
            return sets[node]

        for b in batches:
            keep = []
            for i, s, j, t in zip(b.column("a").to_pylist(), b.column("ta"), b.column("b").to_pylist(), b.column("tb"), strict=True):
                x, y = known(i, s), known(j, t)
                common = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(common >= similarity * (len(x) + len(y) - common))
            keep = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column("a").filter(keep), b.column("b").filter(keep)], names=["a", "b"])

    return written(both.select("a", "b", "ta", "tb").mapInArrow(verify, "a long, b long"), "alike")


def _hashes(text: Column | str) -> tuple[Column, Column]:
    text = F.coalesce(text, F.lit(""))
    return F.xxhash64(text), F.xxhash64(F.lit(1), text)


def near_duplicates(docs: DataFrame, words: int = 5, similarity: float = 0.8, radius: int = 4) -> DataFrame:
    """All rows and columns, with _nd_group: rows with the same one are alike, directly or through others."""
    spark = docs.sparkSession
    small_batches(spark)
    k1, k2 = _hashes("text")
    texts = docs.select(k1.alias("k1"), k2.alias("k2"), "text")
    held = spark.sparkContext.broadcast(common_shingles(texts, words))  # COMMON shingles at most

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp, keys, sizes, first = [], [], [], []
            for t in b.column("text"):
                h = shingle_hashes(t.as_py(), words)
                fp.append(fingerprint(h))
                keys.append(bands(h))
                n, p = prefix(h, similarity, held.value)
                sizes.append(n)
                first.append(p)
            keys = np.array(keys, np.int64).reshape(-1)
            ends = np.arange(0, len(keys) + 1, BANDS, dtype=np.int32)
            cuts = np.cumsum([0, *map(len, first)], dtype=np.int32)
            first = np.concatenate([np.zeros(0, np.int64), *first])
            columns = [b.column("k1"), b.column("k2"), pa.array(fp, pa.int64()), pa.ListArray.from_arrays(pa.array(ends), pa.array(keys)), pa.array(sizes, pa.int32()), pa.ListArray.from_arrays(pa.array(cuts), pa.array(first))]
            yield pa.RecordBatch.from_arrays(columns, names=["k1", "k2", "fp", "keys", "n", "prefix"])

    # copies: the same sketch, so one row of each text is left, which gets a number
    sketches = texts.mapInArrow(sketch, "k1 long, k2 long, fp long, keys array<long>, n int, prefix array<long>")
    sketches = sketches.groupBy("k1", "k2").agg(*(F.first(c).alias(c) for c in ("fp", "keys", "n", "prefix")))
    sketches = written(sketches.withColumn("node", F.monotonically_increasing_id()), "sketches")
    names = sketches.select("k1", "k2", "node")
    cells = sketches.select("node", F.posexplode("keys").alias("band", "key"))
    picks = F.array(*(F.min_by("node", F.xxhash64(F.lit(k), "band", "node")) for k in range(PICKS)))
    picked = cells.groupBy("band", "key").agg(F.array_distinct(picks).alias("picks"), F.count("*").alias("n")).where(F.col("n") > 1)
    # aggregates are written before they are joined back, so that Spark can split a hot cell's other side
    banded = cells.join(shuffled(written(picked.drop("n"), "picked")), ["band", "key"]).select(F.col("node").alias("a"), F.explode("picks").alias("b")).where(F.col("a") != F.col("b"))
    fps = written(sketches.groupBy("fp").agg(F.min("node").alias("node")), "distinct")
    same = sketches.join(shuffled(fps.withColumnRenamed("node", "b")), "fp").where(F.col("node") != F.col("b")).select(F.col("node").alias("a"), "b")
    near = links(fps, radius)
    least = {k: shuffled(fps.select(F.col("fp").alias(k), F.col("node").alias(f"n{k}"))) for k in "ab"}
    near = near.join(least["a"], "a").join(least["b"], "b").select(F.col("na").alias("a"), F.col("nb").alias("b"))
    pairs = banded.union(same).union(near).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    alike = _verified(pairs, texts, names, words, similarity)
    joined = written(components(alike), "joined")
    more = _verified(_left_open(sketches, joined, similarity), texts, names, words, similarity)
    # the second pass links groups of the first
    roots = components(joined.select(F.col("node").alias("a"), F.col("root").alias("b")).union(more))
    # a group goes by the hashes of its root's text; texts that are alone go by their own
    of = names.select(F.col("k1").alias("g1"), F.col("k2").alias("g2"), F.col("node").alias("root"))
    groups = written(names.join(shuffled(roots), "node").join(shuffled(of), "root").select("k1", "k2", "g1", "g2"), "groups")
    columns = [c for c in docs.columns if c != "_nd_group"]
    keyed = docs.select(packed(columns).alias("row"), k1.alias("k1"), k2.alias("k2"))
    group = F.struct(F.coalesce("g1", "k1").alias("k1"), F.coalesce("g2", "k2").alias("k2")).alias("_nd_group")
    return keyed.join(groups, ["k1", "k2"], "left").select("row.*", group)


def deduplicate(docs: DataFrame, words: int = 5, similarity: float = 0.8, radius: int = 4) -> DataFrame:
    """One row of each group of near-duplicates: that with the smallest id (null last)."""
    columns = docs.columns
    own = docs.select("doc_id", "text", *(h.alias(c) for h, c in zip(_hashes("text"), ("h1", "h2"), strict=True)))
    grouped = near_duplicates(own, words, similarity, radius)
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "h1", "h2")
    first = written(grouped.groupBy("_nd_group").agg(F.min(order).alias("first")), "first").select(F.col("first.doc_id").alias("_id"), F.col("first.h1").alias("_h1"), F.col("first.h2").alias("_h2"))
    h1, h2 = _hashes(docs["text"])
    kept = docs.join(first, docs["doc_id"].eqNullSafe(first["_id"]) & (h1 == first["_h1"]) & (h2 == first["_h2"]), "left_semi")
    # rows that repeat id and text
    hashed = fresh(columns, "hash")
    return kept.withColumn(hashed, F.struct(*_hashes(kept["text"]))).dropDuplicates(["doc_id", hashed]).select(*columns)
