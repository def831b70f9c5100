"""Benchmark decontamination by template canonicalisation (operator 9).

Words become template tokens: numbers, names (capitalised inside a sentence) and units (after a number) become typed
placeholders, everything else is lower-cased. Windows of lower-cased words are used beside them, as case may be lost.
Scripts that do not part words have a token a character.

Windows of `WINDOW` tokens of the benchmark (whole items where those are shorter) are a table of hashes. Documents are
sifted by two bit filters of bounded size, one of the benchmark's words and one of its windows; the windows that pass
are hash-joined with the table, once whatever the benchmark's size. Each document and item that meet are lined up on
diagonals, token by token, and their slots checked: equal names, numbers and units of the item must stand for equal ones
in the document, and different names and units for different ones. Inconsistent slots void what rests on placeholders:
only the diagonal's plain windows count then, those that agree word by word.

A document is contaminated by an item if its lined-up tokens cover `COVERAGE` of the item, or if it repeats `VERBATIM`
or more of its words in a row. Re-parameterised questions are those whose slots differ.

Items with fewer than `LEAST` words, or windows with fewer than half literal words, say too little and match nothing;
null texts neither. Very long texts are read whole, a row at a time. Repeated rows are judged each, and so are items
that repeat an id. Empty tables: nothing found. Extra columns are kept by `decontaminate`, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small_batches, written

WINDOW, LEAST, COVERAGE, VERBATIM = 8, 4, 0.6, 13
#: Bits of a filter, at most, and for each entry.
MOST_BITS, BITS = 1 << 26, 32
#: Words known to a task's table of attributes, which starts again when full and with each task.
KNOWN = 100_000
NUM, NAME, UNIT = 1, 2, 3
#: Thai to Lao, Myanmar, Khmer, kana and Han: no spaces between words.
_UNPARTED = "\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff"
_ENDS = ".!?\n\u3002\uff01\uff1f"
_WORD = re.compile(f"[^\\W_{_UNPARTED}]+|[{_UNPARTED}]|[{_ENDS}]")
NUMBERS = frozenset("zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion".split())
UNITS = frozenset(
    "mm cm m km inch inches foot feet yard yards mile miles meter meters metre metres kilometer kilometers kilometre kilometres "
    "mg g kg gram grams kilogram kilograms ounce ounces pound pounds ton tons ml l liter liters litre litres gallon gallons cup cups "
    "second seconds minute minutes hour hours day days week weeks month months year years "
    "cent cents dollar dollars euro euros percent degree degrees mph kmh watt watts volt volts".split()
)


class Found(NamedTuple):
    n_words: int  # of the item, lined up
    coverage: float
    renamed: bool  # a slot differs


class _Numbers(dict):
    """Word to number; an unseen one gets the next number and waits for its attributes."""

    def __init__(self) -> None:
        super().__init__()
        self.waiting: list[str] = []

    def __missing__(self, word: str) -> int:
        own = self[word] = len(self)
        self.waiting.append(word)
        return own


class Filter:
    """A set of 64-bit numbers in a bounded number of bits: no false negatives."""

    def __init__(self, words: np.ndarray) -> None:
        self.words, self.mask = words, np.uint64(64 * len(words) - 1)

    def has(self, numbers: np.ndarray) -> np.ndarray:
        out = np.ones(len(numbers), bool)
        for p in (numbers & self.mask, (numbers >> np.uint64(32)) & self.mask):
            out &= (self.words[(p >> np.uint64(6)).astype(np.int64)] >> (p & np.uint64(63)) & np.uint64(1)).astype(bool)
        return out


def filter_of(numbers: DataFrame, column: str) -> Filter:
    """The filter of a column, built by an aggregate; at most MOST_BITS / 64 words come to the driver."""
    n = numbers.count()
    bits = min(MOST_BITS, max(1 << 12, 1 << (BITS * n).bit_length()))
    h = F.col(column)
    at = numbers.select(F.explode(F.array(h.bitwiseAND(F.lit(bits - 1)), F.shiftrightunsigned(h, 32).bitwiseAND(F.lit(bits - 1)))).alias("p"))
    found = at.selectExpr("p div 64 AS word", "shiftleft(1L, cast(p % 64 AS INT)) AS bit").groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    words = np.zeros(bits // 64, np.uint64)
    words[found.column("word").to_numpy()] = found.column("bits").to_numpy().view(np.uint64)
    return Filter(words)


class Words:
    """Texts as arrays: the literal code and kind of each word, kept for each distinct one."""

    def __init__(self, known: Filter | None = None) -> None:
        """known: each word is marked as being in it, or not."""
        self.codes = known
        self.clear()

    def clear(self) -> None:
        self.number = _Numbers()
        self.lower, self.kind, self.known = np.zeros(0, np.uint64), np.zeros(0, np.int8), np.zeros(0, bool)

    def _learn(self) -> None:
        words, self.number.waiting = self.number.waiting, []
        known = len(self.number) - len(words)
        if len(self.number) > len(self.lower):
            room = len(self.lower) + len(words)
            self.lower = np.concatenate([self.lower, np.zeros(room, np.uint64)])
            self.kind = np.concatenate([self.kind, np.zeros(room, np.int8)])
            self.known = np.concatenate([self.known, np.zeros(room, bool)])
        low = [w.lower() for w in words]
        codes = np.fromiter(map(_code, low), np.uint64, len(low))
        self.lower[known : len(self.number)] = codes
        if self.codes is not None:
            self.known[known : len(self.number)] = self.codes.has(codes)
        self.kind[known : len(self.number)] = np.fromiter(map(_kind, words, low), np.int8, len(low))

    def read(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Literal code, kind and mark of each word."""
        words = _WORD.findall(text)
        own = np.fromiter(map(self.number.__getitem__, words), np.int64, len(words))
        if self.number.waiting:
            self._learn()
        out = self.lower[own], self.kind[own], self.known[own]
        if len(self.number) > KNOWN:
            self.clear()
        return out


def _kind(word: str, low: str) -> int:
    """1 number, 2 capitalised, 4 sentence end, 8 unit."""
    if word in _ENDS:
        return 4
    return (low[0].isdigit() or low in NUMBERS) + 2 * (word[0].isupper() and word[1:].islower()) + 8 * (low in UNITS)


def _code(word: str) -> int:
    return xxhash.xxh64_intdigest(word, 9) | 4


def template(words: Words, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Template tokens, literal codes and marks of a text's words."""
    literal, kind, known = words.read(text)
    end = kind == 4
    start = np.concatenate([[True], end[:-1]]) if len(end) else end
    literal, kind, known, start = literal[~end], kind[~end], known[~end], start[~end]
    out = literal.copy()
    number = (kind & 1) > 0
    out[number] = NUM
    out[((kind & 2) > 0) & ~start & ~number] = NAME
    after = np.concatenate([[False], number[:-1]]) if len(number) else number
    out[((kind & 8) > 0) & after] = UNIT
    return out, literal, known


def _hashes_at(tokens: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    h = np.zeros(len(at), np.uint64)
    for k in range(n):
        h = h * np.uint64(0x9E3779B97F4A7C15) + tokens[at + k]
        h ^= h >> np.uint64(31)
    return h


def _hashes(tokens: np.ndarray, n: int) -> np.ndarray:
    return _hashes_at(tokens, np.arange(max(0, len(tokens) - n + 1)), n)


class Item(NamedTuple):
    template: np.ndarray
    literal: np.ndarray
    slot: np.ndarray
    n: int  # words of a window
    hashes: np.ndarray  # sorted
    places: np.ndarray


def item(words: Words, text: str | None) -> Item | None:
    """A benchmark item with its windows; None if it says too little."""
    tokens, literal, _ = template(words, text or "")
    n = min(WINDOW, len(tokens))
    if n < LEAST:
        return None
    h, plain = _hashes(tokens, n), _hashes(literal, n)
    literals = np.convolve(tokens > UNIT, np.ones(n, int), "valid")
    # plain windows as well: they hold where case does not tell a name from another word
    a, b = np.flatnonzero(2 * literals >= n), np.flatnonzero(plain != h)
    hashes, places = np.concatenate([h[a], plain[b]]), np.concatenate([a, b])
    order = np.argsort(hashes, kind="stable")
    return Item(tokens, literal, tokens <= UNIT, n, hashes[order], places[order])


def sift(words: Words, windows: Filter, lengths: Sequence[int], text: str | None) -> np.ndarray:
    """The hashes of a text's windows that may be the benchmark's."""
    if not text:
        return np.zeros(0, np.uint64)
    tokens, literal, known = template(words, text)
    out = [np.zeros(0, np.uint64)]
    for own, fine in ((tokens, known | (tokens <= UNIT)), (literal, known)):
        gone = np.concatenate([[0], np.cumsum(~fine)])
        for n in lengths:
            if len(own) >= n:
                h = _hashes_at(own, np.flatnonzero(gone[n:] == gone[:-n]), n)
                out.append(h[windows.has(h)])
    return np.unique(np.concatenate(out))


class Document:
    """A text's words, and its window hashes by length."""

    def __init__(self, words: Words, text: str) -> None:
        self.template, self.literal, _ = template(words, text)
        self.known: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def hashes(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n not in self.known:
            self.known[n] = _hashes(self.template, n), _hashes(self.literal, n)
        return self.known[n]


def judge(known: Item, doc: Document) -> Found | None:
    """Whether an item contaminates a document."""
    literal, hits = doc.literal, []
    for plain, h in enumerate(doc.hashes(known.n)):
        at = np.flatnonzero(np.isin(h, known.hashes))
        first, last = np.searchsorted(known.hashes, h[at], "left"), np.searchsorted(known.hashes, h[at], "right")
        for a, x, y in zip(at.tolist(), first.tolist(), last.tolist(), strict=True):
            hits += [(a - int(known.places[i]), int(known.places[i]), plain) for i in range(x, y)]
    diagonals: dict[int, tuple[set[int], set[int]]] = {}
    for shift, place, plain in hits:
        every, word_by_word = diagonals.setdefault(shift, (set(), set()))
        every.update(range(place, place + known.n))
        if plain:
            word_by_word.update(range(place, place + known.n))
    covered: set[int] = set()
    renamed, most = False, 0
    for shift, (places, word_by_word) in diagonals.items():
        at = np.array(sorted(places))
        theirs, own, slot = literal[at + shift], known.literal, known.slot
        pairs = {(int(a), int(b)) for a, b, s in zip(own[at], theirs, slot[at], strict=True) if s}
        fixed = {(int(a), int(b)) for a, b, s in zip(own[at], theirs, slot[at] & (known.template[at] != NUM), strict=True) if s}
        if len({a for a, _ in pairs}) < len(pairs) or len({b for _, b in fixed}) < len(fixed):
            if not word_by_word:
                continue
            # inconsistent slots void what rests on placeholders only
            places = word_by_word
            at = np.array(sorted(places))
            theirs = literal[at + shift]
            pairs = {(int(a), int(a)) for a in own[at][slot[at]]}
        same = np.concatenate([[False], (own[at] == theirs), [False]])
        step = np.concatenate([[False], np.diff(at) == 1, [False]])
        run = 0
        for k in range(1, len(same) - 1):
            run = (run + 1 if k > 1 and step[k - 1] else 1) if same[k] else 0
            most = max(most, run)
        covered |= places
        renamed = renamed or any(a != b for a, b in pairs)
    share = len(covered) / len(known.template)
    return Found(len(covered), share, renamed) if share >= COVERAGE or most >= VERBATIM else None


def _found(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, k1, k2 (of the text), item_id, n_words, coverage, renamed of every contaminated document and item."""
    spark = docs.sparkSession
    small_batches(spark)
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").alias("item_text")).where(F.col("text").isNotNull())
    items = written(items.withColumn("item", F.monotonically_increasing_id()), "items")

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for b in batches:
            for own, text in zip(b.column("item").to_pylist(), b.column("item_text"), strict=True):
                if made := item(words, text.as_py()):
                    h, code = np.unique(made.hashes), np.unique(made.literal)
                    n = np.concatenate([np.full(len(h), made.n), np.zeros(len(code), int)])
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(n), own, np.int64)), pa.array(n.astype(np.int32)), pa.array(np.concatenate([h, code]).view(np.int64))], names=["item", "n", "h"])

    made = written(items.mapInArrow(spread, "item long, n int, h long"), "windows")
    windows = made.where("n > 0")
    lengths = sorted(r.n for r in windows.select("n").distinct().collect())  # of LEAST to WINDOW
    filters = spark.sparkContext.broadcast((filter_of(made.where("n = 0").select("h").distinct(), "h"), filter_of(windows.select("h").distinct(), "h")))  # of bounded size

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, some = filters.value
        words = Words(known)
        for b in batches:
            h = [sift(words, some, lengths, t.as_py()) for t in b.column("text")]
            which = pa.array([len(x) > 0 for x in h], pa.bool_())
            found = pa.array([x.view(np.int64) for x in h if len(x)], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([b.column("doc_id").filter(which), b.column("text").filter(which), found], names=["doc_id", "text", "h"])

    sifted = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(keep, "doc_id long, text string, h array<long>")
    sifted = written(sifted.withColumn("row", F.monotonically_increasing_id()), "sifted")
    pairs = sifted.select("row", F.explode("h").alias("h")).join(windows.select("h", "item"), "h").select("row", "item").distinct()
    pairs = written(pairs, "met")
    both = pairs.join(items, "item").join(sifted.drop("h"), "row").sortWithinPartitions("row")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, known, row, doc = Words(), {}, None, None
        for b in batches:
            out = []
            for own, number, doc_id, text, item_id, item_text in zip(*(b.column(c) for c in ("row", "item", "doc_id", "text", "item_id", "item_text")), strict=True):
                if own.as_py() != row:
                    row, doc = own.as_py(), Document(words, text.as_py())
                if number.as_py() not in known:
                    if len(known) > 1000:
                        known.clear()
                    known[number.as_py()] = item(words, item_text.as_py())
                if found := judge(known[number.as_py()], doc):
                    out.append((doc_id.as_py(), text.as_py(), item_id.as_py(), *found))
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.float64(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], kind) for k, kind in enumerate(kinds)], names=["doc_id", "text", "item_id", "n_words", "coverage", "renamed"])

    found = both.select("row", "item", "doc_id", "text", "item_id", "item_text").mapInArrow(verify, "doc_id long, text string, item_id long, n_words long, coverage double, renamed boolean")
    return written(found.select("doc_id", F.xxhash64("text").alias("k1"), F.xxhash64(F.lit(1), "text").alias("k2"), "item_id", "n_words", "coverage", "renamed"), "contaminated")


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, n_words, coverage, renamed of every contaminated document and item."""
    return _found(docs, benchmark).drop("k1", "k2")


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows, with all their columns, that no item contaminates."""
    found = _found(docs, benchmark).select("k1", "k2").distinct()
    return docs.join(found, (F.xxhash64(docs["text"]) == found["k1"]) & (F.xxhash64(F.lit(1), docs["text"]) == found["k2"]), "left_anti")


def op9_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
