"""Line dedup over levelled sorted runs of line hashes (operator 3), DataFrame functions only.

A store keeps, for line keys, the number of documents that have them, as runs of (h1, h2, n). A run is a table in
buckets by hash, sorted in each, so runs meet each other and new batches by merge joins without an exchange. A new
batch of documents is merge-anti-joined with the runs: keys that a run has settled (it counts them in `documents`
documents already) need no more counting; the batch adds its other keys as a run of its own to level 0. Two runs of a
level are merge-joined into one run of the next level.

A line is common if its count over all runs reaches `documents`, which needs the runs of all batches; then the lines of
all documents meet the common keys in one join. Keys are compared by 128 bits of hash. The runs lie in the shared
folder, so a lost executor costs a reread.

With `keep_first`, the document with the smallest id (null last) among those that share a common line keeps it; else
all lose it. Runs then carry that document as well, and a batch's key is settled only by a run with an earlier one.

One document is one row, whatever its `doc_id`. Null or empty text: one empty line, which has no key and stays. Very
long texts are split like others, a line a row. Repeated rows count and are cleaned each; ties for the first document
go by a hash of the text. Empty tables give no rows. All columns are kept, but for `_ld_lines` and `_ld_dropped`, which
are the operator's.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, bucketed, buckets, dropped, packed, table, written

BLANK = " \t\n\x0b\x0c\r"


def _key(line: Column) -> Column:
    return ascii_lower(F.trim(line, F.lit(BLANK)))


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _hashed(docs: DataFrame, least: int, *keep: str) -> DataFrame:
    """keep, _ld_pos, h1, h2 of every line that has a key of at least `least` code points."""
    rows = docs.select(*keep, F.posexplode(_lines(F.col("text"))).alias("_ld_pos", "_ld_line"))
    rows = rows.withColumn("_ld_key", _key(F.col("_ld_line"))).where(F.length("_ld_key") >= max(1, least))
    return rows.select(*keep, "_ld_pos", F.xxhash64("_ld_key").alias("h1"), F.xxhash64(F.lit(1), "_ld_key").alias("h2"))


def _order():
    return F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("h")).alias("first")


class LineRuns:
    """The levelled runs. `add` takes batches of documents; `clean` applies what all batches so far have shown."""

    def __init__(self, spark: SparkSession, documents: int = 10, least: int = 1, keep_first: bool = False) -> None:
        self.spark, self.documents, self.least, self.keep_first = spark, documents, least, keep_first
        self.buckets = buckets(spark)
        self.levels: list[str | None] = []

    def runs(self) -> list[str]:
        return [r for r in self.levels if r]

    def merged(self, x: DataFrame, y: DataFrame) -> DataFrame:
        """Counts over two runs: a full merge join. They lie by hash alike, so no exchange and no sort is needed."""
        x, y = x.alias("x"), y.hint("merge").alias("y")
        both = x.join(y, (F.col("x.h1") == F.col("y.h1")) & (F.col("x.h2") == F.col("y.h2")), "full_outer")
        n = F.coalesce("x.n", F.lit(0)) + F.coalesce("y.n", F.lit(0))
        first = [F.least("x.first", "y.first").alias("first")] if self.keep_first else []
        return both.select(F.coalesce("x.h1", "y.h1").alias("h1"), F.coalesce("x.h2", "y.h2").alias("h2"), n.alias("n"), *first)

    def _write(self, rows: DataFrame, tag: str) -> str:
        return bucketed(rows, f"lines-{tag}", self.buckets, ["h1", "h2"], ["h1", "h2"])

    def _push(self, run: str) -> None:
        """Put a run on level 0, and compact the levels that are full, as a carry does."""
        level = 0
        while level < len(self.levels) and (old := self.levels[level]):
            made = self._write(self.merged(table(self.spark, old), table(self.spark, run)), f"l{level + 1}")
            dropped(self.spark, old, run)
            self.levels[level], run, level = None, made, level + 1
        self.levels += [None] * (level + 1 - len(self.levels))
        self.levels[level] = run

    def _keys(self, docs: DataFrame, *keep: str) -> DataFrame:
        """keep, h1, h2 of every distinct key of each document."""
        keys = F.array_distinct(F.transform(_lines(F.col("text")), lambda x: _key(x)))
        keys = docs.select(*keep, F.explode(F.filter(keys, lambda k: F.length(k) >= max(1, self.least))).alias("_ld_key"))
        return keys.select(*keep, F.xxhash64("_ld_key").alias("h1"), F.xxhash64(F.lit(1), "_ld_key").alias("h2"))

    def unsettled(self, batch: DataFrame) -> DataFrame:
        """The rows of a batch's counts whose key no run has settled: merge anti-joins with one run after another."""
        for run in self.runs():
            b, r = batch.alias("b"), table(self.spark, run).where(F.col("n") >= self.documents).hint("merge").alias("r")
            same = (F.col("b.h1") == F.col("r.h1")) & (F.col("b.h2") == F.col("r.h2"))
            batch = b.join(r, same & (F.col("r.first") <= F.col("b.first")) if self.keep_first else same, "left_anti")
        return batch

    def add(self, docs: DataFrame, batches: int = 1) -> None:
        """Count the keys of new documents, each counting once for a key, into runs of level 0.

        With more than one batch, the rows are dealt to batches by text and hashed in one pass; the batches then follow
        one another, each meeting the runs of those before it.
        """
        first = [_order()] if self.keep_first else []
        part = docs.select("text", F.pmod(F.coalesce(F.xxhash64("text"), F.lit(0)), F.lit(batches)).alias("_ld_batch"), *first)
        counts = []
        for k in range(batches):
            own = F.col("_ld_batch") == k
            counts.append(F.count(F.when(own, 1)).alias(f"n{k}"))
            counts += [F.min(F.when(own, F.col("first"))).alias(f"first{k}")] if self.keep_first else []
        keys = self._keys(part, "_ld_batch", *(["first"] if self.keep_first else []))
        hashed = self._write(keys.groupBy("h1", "h2").agg(*counts), "batches")
        for k in range(batches):
            more = [F.col(f"first{k}").alias("first")] if self.keep_first else []
            batch = table(self.spark, hashed).where(F.col(f"n{k}") > 0).select("h1", "h2", F.col(f"n{k}").alias("n"), *more)
            self._push(self._write(self.unsettled(batch), "l0"))
        dropped(self.spark, hashed)

    def common(self) -> DataFrame:
        """h1, h2 (and first) of the keys in at least `documents` documents, over all runs."""
        if not self.runs():
            none = self.spark.range(0).select(F.col("id").alias("h1"), F.col("id").alias("h2"))
            return none.withColumn("first", F.struct(F.lit(False).alias("none"), F.col("h1").alias("doc_id"), F.col("h1").alias("h"))) if self.keep_first else none
        rows = functools.reduce(self.merged, [table(self.spark, r) for r in self.runs()])
        return rows.where(F.col("n") >= self.documents).drop("n")

    def drop(self) -> None:
        """Delete the runs."""
        dropped(self.spark, *self.runs())
        self.levels = []

    def clean(self, docs: DataFrame) -> DataFrame:
        """docs with `text` without common lines, and _ld_lines, _ld_dropped: numbers of lines before, and of those gone.

        Only hashes of lines meet the runs; what is left to drop is joined to the rows by id and text hash.
        """
        own = ("_ld_lines", "_ld_dropped")
        columns = [c for c in docs.columns if c not in own]
        docs = docs.select("doc_id", "text", packed(c for c in columns if c not in ("doc_id", "text")).alias("_ld_rest"), F.xxhash64("text").alias("_ld_h"))
        lines = _hashed(docs, self.least, "doc_id", "_ld_h")
        # written, so that both sides of the join are exchanged for it alone and Spark can split a common key's lines
        common = written(self.common(), "common-lines")
        if self.keep_first:
            mine = F.col("doc_id").cast("long").eqNullSafe(F.col("first.doc_id")) & (F.col("_ld_h") == F.col("first.h"))
            drop = lines.join(common, ["h1", "h2"]).where(~mine)
        else:
            drop = lines.join(common, ["h1", "h2"], "left_semi")
        drop = drop.groupBy("doc_id", "_ld_h").agg(F.collect_set("_ld_pos").alias("_ld_drop"))
        drop = drop.select(F.col("doc_id").alias("_ld_id"), F.col("_ld_h").alias("_ld_hash"), "_ld_drop")
        out = docs.join(drop, docs["doc_id"].eqNullSafe(drop["_ld_id"]) & (docs["_ld_h"] == drop["_ld_hash"]), "left")
        lines_ = _lines(F.col("text"))
        keep = F.array_except(F.sequence(F.lit(0), F.size(lines_) - 1), F.col("_ld_drop"))
        text = F.when(F.col("_ld_drop").isNull(), F.col("text")).otherwise(F.array_join(F.transform(keep, lambda i: F.get(lines_, i)), "\n"))
        counts = (F.size(lines_).cast("long"), F.coalesce(F.size("_ld_drop"), F.lit(0)).cast("long"))
        out = out.select("doc_id", text.alias("text"), "_ld_rest", *(c.alias(name) for c, name in zip(counts, own, strict=True)))
        return out.select(*(F.col(c) if c in ("doc_id", "text") else F.col("_ld_rest").getField(c).alias(c) for c in columns), *own)


def drop_common_lines(docs: DataFrame, documents: int = 10, least: int = 1, batches: int = 4, keep_first: bool = False) -> DataFrame:
    """The rows without lines whose key is in at least `documents` of them (see `LineRuns.clean`)."""
    runs = LineRuns(docs.sparkSession, documents, least, keep_first)
    runs.add(docs, batches)
    out = runs.clean(docs)  # has read the runs
    runs.drop()
    return out


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = drop_common_lines(docs)
    return out.select("doc_id", F.col("_ld_lines").alias("n_lines"), F.col("_ld_dropped").alias("n_dropped"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
l AS (SELECT rid, doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM d),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
c AS (SELECT key FROM k WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT rid) >= 10)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (WHERE c.key IS NOT NULL)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE c.key IS NULL), '')) AS kept_sha256
FROM k LEFT JOIN c USING (key) GROUP BY rid, doc_id
"""
