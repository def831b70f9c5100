"""Language identification by mixture inference (operator 2).

Training counts hashed character trigrams per language over a bounded, documented sample of labelled rows: up to
`SAMPLE` documents a language, chosen by the smallest hash of their id in each of `SAMPLE` slots, whole texts. All labels
are learned; more than `MAX_LANGS` of them are an error. The model is a table of smoothed trigram probabilities.

For each document, expectation-maximisation estimates the shares of all languages from its trigrams; the languages by
falling share give nested sets, each is fitted again, and the set with the best likelihood less a penalty (a multiple
of BIC's) is kept. The language with the largest share is predicted; the score is its share times its probability
against the other languages alone. Ties go to the first language by name.

`und` with score 0: null text, text without a letter, or no language learned. Repeated rows are judged each, null ids
are judged but not learned from, empty tables give no rows, and other columns are kept if asked for, whatever their
names (`lid_lang`, `lid_score` and `lid_langs` are the operator's). Whole texts are counted, very long ones in segments.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import chunks, fresh, small_batches

BUCKETS = 1 << 16
SAMPLE = 256
MAX_LANGS = 500
#: Bytes of a table of trigrams by languages that a task works on, about.
HELD = 32 << 20
SEGMENT = 1 << 18


class Model(NamedTuple):
    langs: list[str]
    p: np.ndarray  # buckets x languages


@functools.cache
def _letter() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def _hashes(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of the trigram around each letter, and the letters' places; everything else counts as a space."""
    cp = np.frombuffer(f" {text} ".encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letter()[cp]
    cp = np.where(letter, cp, np.uint32(32))
    at = np.flatnonzero(letter[1:-1])
    h = cp[at] * np.uint32(0x9E3779B1) ^ cp[at + 1] * np.uint32(0x85EBCA77) ^ cp[at + 2] * np.uint32(0xC2B2AE3D)
    h ^= h >> np.uint32(15)
    return ((h * np.uint32(0x2C1B3C6D)) >> np.uint32(16)).astype(np.int64), at


def _counts(texts: Sequence[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text number, bucket and count of all trigrams, in order of the texts."""
    keys, counts, run, starts, n = [], [], [], [], 0

    def close() -> None:
        nonlocal run, starts, n
        if run:
            h, at = _hashes("  ".join(run))
            ends = np.cumsum([len(t) + 2 for t in run])
            own = np.searchsorted(ends, at, "right")
            k, c = np.unique(np.array(starts)[own] * BUCKETS + h, return_counts=True)
            keys.append(k)
            counts.append(c)
        run, starts, n = [], [], 0

    for i, text in enumerate(texts):
        low = (text or "").lower()
        if len(low) > SEGMENT:
            close()
            dense = np.zeros(BUCKETS, np.int64)
            for a in range(0, len(low), SEGMENT):
                dense += np.bincount(_hashes(low[a : a + SEGMENT])[0], minlength=BUCKETS)
            k = np.flatnonzero(dense)
            keys.append(i * BUCKETS + k)
            counts.append(dense[k])
            continue
        run.append(low)
        starts.append(i)
        n += len(low)
        if n >= SEGMENT:
            close()
    close()
    k = np.concatenate(keys) if keys else np.zeros(0, np.int64)
    return k // BUCKETS, k % BUCKETS, np.concatenate(counts) if counts else k


def train(labelled: DataFrame, sample: int = SAMPLE, max_langs: int = MAX_LANGS, smooth: float = 0.5) -> Model:
    """A model from rows of doc_id, text, lang (null ids and labels take no part)."""
    spark = labelled.sparkSession
    small_batches(spark)
    rows = labelled.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", "text", "lang")
    slots = rows.groupBy("lang", F.pmod(F.xxhash64("doc_id"), F.lit(sample)).alias("slot"))
    slots = slots.agg(F.min_by("doc_id", F.xxhash64(F.lit(7), "doc_id")).alias("doc_id"))
    if (n := rows.select("lang").distinct().count()) > max_langs:
        raise ValueError(f"{n} labels; a model has {max_langs} languages at most")
    chosen = spark.createDataFrame(slots.select("doc_id", "lang").collect(), "doc_id long, lang string")  # at most max_langs * sample rows
    texts = rows.join(F.broadcast(chosen), ["doc_id", "lang"]).groupBy("doc_id", "lang").agg(F.max("text").alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names, own = np.unique(np.array(b.column("lang").to_pylist(), object), return_inverse=True)
            which, h, c = _counts(b.column("text").to_pylist())
            k, at = np.unique(own[which] * BUCKETS + h, return_inverse=True)
            total = np.bincount(at, c, len(k)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(names[k // BUCKETS], pa.string()), pa.array((k % BUCKETS).astype(np.int32)), pa.array(total)], names=["lang", "bucket", "n"])

    found = texts.mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    names = sorted(set(found.column("lang").to_pylist()))
    p = np.full((BUCKETS, len(names)), smooth)
    own = np.array([names.index(x) for x in found.column("lang").to_pylist()], np.int64)
    p[found.column("bucket").to_numpy(), own] += found.column("n").to_numpy()
    return Model(names, (p / p.sum(0)).astype(np.float32))


def _em(p: np.ndarray, c: np.ndarray, own: np.ndarray, starts: np.ndarray, share: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Shares after EM, and log-likelihoods with them. Shares of 0 stay 0."""
    total = np.add.reduceat(c, starts)[:, None]
    for _ in range(rounds):
        part = p * share[own]
        part *= (c / part.sum(1))[:, None]
        share = np.add.reduceat(part, starts, axis=0) / total
    return share, np.add.reduceat(c * np.log((p * share[own]).sum(1)), starts)


def shares(model: Model, texts: Sequence[str | None], penalty: float = 3.0, rounds: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """Of each text: the shares of the languages kept (zeros: undetermined), and the best one's probability alone."""
    n, k = len(texts), len(model.langs)
    out, sure = np.zeros((n, k)), np.zeros(n)
    which, h, c = _counts(texts)
    if not k or not len(which):
        return out, sure
    texts_at, starts = np.unique(which, return_index=True)
    own = np.searchsorted(texts_at, which)
    p, c = model.p[h].astype(np.float64), c.astype(np.float64)
    size = np.add.reduceat(c, starts)
    alone = np.add.reduceat(c[:, None] * np.log(p), starts, axis=0)
    top = alone.argmax(1)
    probability = 1 / np.exp(alone - alone.max(1, keepdims=True)).sum(1)
    best, value = np.eye(k)[top], alone.max(1)
    full, _ = _em(p, c, own, starts, np.full((len(starts), k), 1 / k), rounds)
    order = np.argsort(-full, axis=1, kind="stable")
    for m in range(2, k + 1):  # the m languages with the largest shares, where the m-th has any worth a test
        try_ = np.flatnonzero(full[np.arange(len(starts)), order[:, m - 1]] > 0.01)
        if not len(try_):
            break
        pick = np.isin(own, try_)
        pp, cc, oo = p[pick], c[pick], np.searchsorted(try_, own[pick])
        ss = np.searchsorted(oo, np.arange(len(try_)))
        at = full[try_].copy()
        np.put_along_axis(at, order[try_][:, m:], 0.0, axis=1)
        at, like = _em(pp, cc, oo, ss, at / at.sum(1, keepdims=True), rounds)
        like -= penalty * (m - 1) * np.log(size[try_] + 1) / 2
        better = like > value[try_]
        best[try_[better]], value[try_[better]] = at[better], like[better]
    out[texts_at], sure[texts_at] = best, probability
    return out, sure


def bounded_shares(model: Model, texts: Sequence[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """`shares`, a bounded number of characters at a time."""
    most = max(1 << 14, HELD // 8 // max(1, len(model.langs)))
    parts = [shares(model, group) for group in chunks((t or "" for t in texts), most)]
    empty = np.zeros((0, len(model.langs))), np.zeros(0)
    return tuple(np.concatenate(x) for x in zip(empty, *parts, strict=True))


def identify(docs: DataFrame, model: Model, keep: Sequence[str] | None = None) -> DataFrame:
    """`keep` (all columns if None), lid_lang, lid_score, lid_langs (number of languages kept)."""
    spark = docs.sparkSession
    small_batches(spark)
    keep = list(docs.columns if keep is None else keep)
    held = spark.sparkContext.broadcast(model)  # at most MAX_LANGS columns of a fixed number of buckets
    new = [T.StructField("lid_lang", T.StringType()), T.StructField("lid_score", T.DoubleType()), T.StructField("lid_langs", T.IntegerType())]

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        names = np.array([*m.langs, "und"], object)
        for b in batches:
            share, sure = bounded_shares(m, b.column(0).to_pylist())
            has = share.any(axis=1) if len(m.langs) else np.zeros(b.num_rows, bool)
            top = np.where(has, share.argmax(1), len(m.langs)) if len(m.langs) else np.zeros(b.num_rows, int)
            score = np.clip(share.max(1) * sure, 0, 1) if len(m.langs) else np.zeros(b.num_rows)
            yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array(names[top], pa.string()), pa.array(score), pa.array((share > 0).sum(1).astype(np.int32))], names=[*keep, "lid_lang", "lid_score", "lid_langs"])

    rows = docs.select(F.col("text").alias("_lid_text"), *keep)
    return rows.mapInArrow(judge, T.StructType([*docs.select(*keep).schema.fields, *new]))


def keep_identified(docs: DataFrame, model: Model, least: float = 0.25) -> DataFrame:
    """The rows, with all their columns, whose language set is sure: one of several languages has won by its penalised
    likelihood, one of a single language needs a probability of `least` against the others alone.

    Without any language learned, rows with a letter are kept.
    """
    spark = docs.sparkSession
    small_batches(spark)
    held = spark.sparkContext.broadcast(model)
    own = fresh(docs.columns, "lid_text")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        for b in batches:
            texts = b.column(own).to_pylist()
            if m.langs:
                share, sure = bounded_shares(m, texts)
                kept = (share > 0).sum(1)
                good = (kept > 1) | ((kept == 1) & (sure >= least))
            else:
                good = np.array([any(map(str.isalpha, t or "")) for t in texts], bool)
            yield b.filter(pa.array(good)).drop_columns([own])

    return docs.withColumn(own, F.col("text")).mapInArrow(keep, docs.schema)


def held_out(doc_id: str = "doc_id"):
    """The fixed fold: crc32 of the id as text, modulo 4, is 2 (a null id is not in it)."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang").withColumn("held_out", held_out())
    model = train(docs.where(~F.col("held_out")))
    out = identify(docs.select("doc_id", "text", "held_out"), model, ["doc_id", "held_out"])
    return out.select("doc_id", "held_out", F.col("lid_lang").alias("lang_pred"), F.col("lid_score").alias("score"), F.col("lid_langs").alias("n_langs"))
