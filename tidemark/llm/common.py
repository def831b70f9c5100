"""Shared helpers: the cluster's shared folder, written and bucketed intermediate tables, and the tokenizer."""

from __future__ import annotations

import contextlib
import functools
import gc
import itertools
import re
import tempfile
import uuid
import zipfile
from collections.abc import Iterable, Iterator, Sequence
from pathlib import Path

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Rows per Arrow batch, so that a batch of long documents stays within a worker's memory.
ARROW_ROWS = 256


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: `spark.checkpoint.dir`. In local mode alone (tests), where it is unset,
    one of our own."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("tidemark.shared.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="tidemark-")
        spark.conf.set("tidemark.shared.dir", base)
    return base.rstrip("/")


def _made(spark: SparkSession) -> dict[str, str | None]:
    """The paths in the shared folder that this session has made, with the name of the table there, if it is one."""
    context = spark.sparkContext
    if not hasattr(context, "_tidemark_made"):
        context._tidemark_made = {}
    return context._tidemark_made


def scratch(spark: SparkSession, tag: str) -> str:
    """A fresh path in the shared folder."""
    path = f"{shared_dir(spark)}/tidemark-{tag}-{uuid.uuid4().hex}"
    _made(spark)[path] = None
    return path


def written(df: DataFrame, tag: str) -> DataFrame:
    """`df` written as Parquet in the shared folder and read again: cuts lineage, and survives lost executors."""
    spark = df.sparkSession
    path = scratch(spark, tag)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def shuffled(df: DataFrame) -> DataFrame:
    """`df` for a join by sorted shuffles, whatever its estimated size: it is never broadcast, and the other side only if
    that is asked for.

    Spark takes an exploded array for as large as the array's table, and Parquet's compressed bytes for rows; a broadcast
    on such an estimate is built in the driver's memory, which then grows with the input.
    """
    return df.hint("merge")


def buckets(spark: SparkSession) -> int:
    """Buckets of a new table: as many as an exchange has partitions, so that its output needs no other one."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def bucketed(df: DataFrame, tag: str, n: int, keys: Sequence[str], order: Sequence[str], **options: str) -> str:
    """`df`, which lies by hash of `keys` already, as a table of n buckets in the shared folder, one sorted file a bucket.

    Joins, aggregates and windows by `keys` over such tables need no exchange; unions of tables with the same n neither.
    Their order is used, too (a session setting, left in place as plans run later). Returns the path: see `table`.
    """
    spark = df.sparkSession
    spark.conf.set("spark.sql.legacy.bucketedTableScan.outputOrdering", "true")
    if buckets(spark) != n:
        df = df.repartition(n, *keys)
    path = scratch(spark, tag)
    name = "tidemark_" + re.sub(r"\W", "_", path.rsplit("/tidemark-", 1)[1])
    _made(spark)[path] = name
    df.write.bucketBy(n, *keys).sortBy(*order).options(path=path, **options).saveAsTable(name)
    return path


def table(spark: SparkSession, path: str) -> DataFrame:
    """What `bucketed` has written."""
    return spark.table(_made(spark)[path])


def dropped(spark: SparkSession, *paths: str) -> None:
    """Delete intermediate tables that nothing reads any more."""
    for path in paths:
        if name := _made(spark).pop(path, None):
            spark.sql(f"DROP TABLE IF EXISTS {name}")
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def cleanup(spark: SparkSession) -> int:
    """Delete all intermediate tables of this session, once the results that rest on them have been used; their number."""
    paths = list(_made(spark))
    dropped(spark, *paths)
    return len(paths)


def release(spark: SparkSession) -> None:
    """Let the driver forget finished steps, so that Spark deletes their shuffle files."""
    gc.collect()
    with contextlib.suppress(AttributeError):
        spark._jvm.System.gc()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once a session, so that their Python workers can import it."""
    context = spark.sparkContext
    if not getattr(context, "_tidemark_shipped", False):
        package = Path(__file__).resolve().parents[1]
        archive = Path(tempfile.mkdtemp(prefix="tidemark-")) / "tidemark.zip"
        with zipfile.ZipFile(archive, "w") as z:
            for f in sorted(package.rglob("*.py")):
                z.write(f, f.relative_to(package.parent))
        context.addPyFile(str(archive))
        context._tidemark_shipped = True


def small_batches(spark: SparkSession) -> None:
    """Bound the rows of an Arrow batch that goes to Python (a session setting, left in place as plans run later)."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))


def packed(columns: Iterable[str]) -> Column:
    """Columns as fields of one, so that their names can't clash with an operator's own."""
    return F.struct(*([F.col(f"`{c}`") for c in columns] or [F.lit(None).cast("int").alias("_")]))


def fresh(columns: Sequence[str], name: str) -> str:
    """A column name that is not in use."""
    while name.lower() in {c.lower() for c in columns}:
        name += "_"
    return name


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z only. `lower` is faster but maps other letters too, so it serves pure ASCII alone."""
    return F.when(F.octet_length(c) == F.length(c), F.lower(c)).otherwise(F.translate(c, UPPER, UPPER.lower()))


def chunks(texts: Iterable[str], most: int = 1 << 20) -> Iterator[list[str]]:
    """Groups of texts with about `most` characters each."""
    out, n = [], 0
    for t in texts:
        out.append(t)
        n += len(t)
        if n >= most:
            yield out
            out, n = [], 0
    if out:
        yield out


# --- tokenizer -------------------------------------------------------------------------------------------------

#: Texts made of these characters alone are split into pre-tokens here; on them Python's classes agree with the
#: tokenizer's. All other texts go through the tokenizer whole.
_UNSURE = re.compile("[^\t\n\r\x20-\x7e¡-±´-¸º»¿-ɏ–-…]")
#: The byte-level pre-tokenizer's published pattern, in Python's syntax, with the most frequent case in front.
_PRE_TOKEN = re.compile(r" ?[A-Za-zªµºÀ-ÖØ-öø-ɏ]+|'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")
#: A single space between two letters always starts a pre-token, so a text may be cut in front of it.
_CUT = re.compile("(?<=[A-Za-z]) (?=[A-Za-z])")
_PIECE = 1 << 18


class _Slots(dict):
    """Pre-token to slot; an unseen one gets the next slot and waits to be encoded."""

    def __init__(self, *old: Iterable) -> None:
        super().__init__(*old)
        self.waiting: list[str] = []

    def __missing__(self, word: str) -> int:
        slot = self[word] = len(self)
        self.waiting.append(word)
        return slot


class Encoder:
    """Whole texts to ids with the `tokenizers` library, without special tokens.

    Byte-level BPE never merges over a pre-token's end, so each distinct pre-token is encoded once and its ids are
    looked up afterwards. `most` bounds the table: when it is full, pre-tokens of one group of texts go. Long texts are handled
    piece by piece, cut where a pre-token begins.
    """

    def __init__(self, path: str, most: int = 400_000) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.model = self.tokenizer.model
        # byte-level vocabularies write a byte as a letter: itself if it is visible, else the next from 256 on
        seen = [*range(33, 127), *range(161, 173), *range(174, 256)]
        self.letters = {b: chr(b) for b in seen} | {b: chr(256 + k) for k, b in enumerate(x for x in range(256) if x not in seen)}
        self.most = most
        self._keep(None)

    def _keep(self, which: np.ndarray | None) -> None:
        """Keep these slots; None: none."""
        if which is None:
            self.slots, self.flat, self.used = _Slots(), np.zeros(1 << 16, np.uint32), 0
            self.start, self.length, self.hits = (np.zeros(1 << 14, np.int64) for _ in range(3))
            return
        words = list(self.slots)
        self.slots = _Slots(zip((words[i] for i in which.tolist()), range(len(which)), strict=True))
        n = self.length[which]
        ends = np.cumsum(n)
        self.flat = self.flat[np.arange(ends[-1]) + np.repeat(self.start[which] - (ends - n), n)]
        self.used, self.start, self.length, self.hits = len(self.flat), ends - n, n, np.zeros(len(n), np.int64)

    def _learn(self) -> None:
        """Encode the waiting pre-tokens with the tokenizer's model."""
        words, self.slots.waiting = self.slots.waiting, []
        known = len(self.slots) - len(words)
        tokenize, letters = self.model.tokenize, self.letters
        lists = [[t.id for t in tokenize(w.encode().decode("latin-1").translate(letters))] for w in words]
        n = np.fromiter(map(len, lists), np.int64, len(lists))
        ids = np.fromiter(itertools.chain.from_iterable(lists), np.uint32, n.sum())
        while self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros(len(self.flat) + len(ids), np.uint32)])
        while len(self.slots) > len(self.start):
            self.start, self.length, self.hits = (np.concatenate([x, np.zeros(len(x) + len(words), np.int64)]) for x in (self.start, self.length, self.hits))
        self.flat[self.used : self.used + len(ids)] = ids
        self.start[known : len(self.slots)], self.length[known : len(self.slots)] = self.used + np.cumsum(n) - n, n
        self.used += len(ids)

    def _pieces(self, texts: list[str]) -> list[np.ndarray]:
        words = [_PRE_TOKEN.findall(t) for t in texts]
        ends = np.cumsum([0, *map(len, words)])
        slot = np.fromiter(map(self.slots.__getitem__, itertools.chain.from_iterable(words)), np.int64, ends[-1])
        if self.slots.waiting:
            self._learn()
        n = self.length[slot]
        after = np.concatenate([[0], np.cumsum(n)])
        ids = self.flat[np.arange(after[-1]) + np.repeat(self.start[slot] - after[:-1], n)]
        self.hits[slot] += 1  # once for each group of texts
        if len(self.slots) > self.most:
            often = np.flatnonzero(self.hits[: len(self.slots)] > 1)
            self._keep(often if 0 < len(often) < self.most // 2 else None)
        return np.split(ids, after[ends[1:-1]]) if len(texts) > 1 else [ids]

    def many(self, texts: Iterable[str | None]) -> Iterator[np.ndarray]:
        """Ids of each whole text (None: of the empty text), as unsigned 32-bit integers."""
        for group in chunks((t or "" for t in texts), _PIECE):
            parts: list[list[int]] = []
            pieces: list[str] = []
            for t in group:
                own, at = [], 0
                while at < len(t):
                    cut = _CUT.search(t, at + _PIECE) if len(t) - at > _PIECE else None
                    end = cut.start() if cut else len(t)
                    own.append(len(pieces))
                    pieces.append(t[at:end])
                    at = end
                parts.append(own)
            whole = [i for i, t in enumerate(pieces) if _UNSURE.search(t) or any(s in t for s in self.special)]
            ids: dict[int, np.ndarray] = {}
            if whole:
                made = self.tokenizer.encode_batch_fast([pieces[i] for i in whole], add_special_tokens=False)
                ids = {i: np.array(e.ids, np.uint32) for i, e in zip(whole, made, strict=True)}
            rest = [i for i in range(len(pieces)) if i not in ids]
            for some in (rest[k : k + 256] for k in range(0, len(rest), 256)):
                ids |= dict(zip(some, self._pieces([pieces[i] for i in some]), strict=True))
            for own in parts:
                yield ids[own[0]] if len(own) == 1 else np.concatenate([np.zeros(0, np.uint32), *(ids[i] for i in own)])

    def __call__(self, text: str | None) -> np.ndarray:
        return next(self.many([text]))


@functools.cache
def encoder(path: str) -> Encoder:
    """One per worker process; `path` may be a vocabulary file of public_tokenizers, by name."""
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    return Encoder(vocabulary(path))


def vocabulary(path: str) -> str:
    """A path as given, or the place of the public vocabulary of this name on this machine."""
    if "/" in path:
        return path
    import public_tokenizers

    return public_tokenizers.path(path)
