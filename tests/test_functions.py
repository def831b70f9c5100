import struct
import zlib

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.functions import bloom, codec
from tidemark.model import CorruptionError, Entry, InvalidKey, Options, TooLong, check_frame
from tidemark.operators.memtable import Memtable


def test_memtable_orders_and_updates(spark):
    rows = [(1, "charlie", "3"), (2, "alpha", "1"), (3, "bravo", "2"), (4, "bravo", "updated"), (1, "bravo", "stale")]
    table = Memtable(Entry(s, False, k, v) for s, k, v in rows)
    assert [(e.key, e.value) for e in table.entries()] == [("alpha", "1"), ("bravo", "updated"), ("charlie", "3")]
    assert len(table) == 3 and table.get("bravo").sequence == 4
    assert [r.key for r in table.frame(spark).collect()] == ["alpha", "bravo", "charlie"]
    table.clear()
    assert table.get("alpha") is None


def test_bloom_filter(spark):
    size = bloom.size(1000, 0.01)
    keys = spark.range(1000).select(F.format_string("present-%d", "id").alias("key"))
    words = bloom.build(keys, size).persist()
    assert bloom.may_contain(keys, words, size).count() == 1000
    absent = spark.range(10_000).select(F.format_string("absent-%d", "id").alias("key"))
    hits = {r.key for r in bloom.may_contain(absent, words, size).collect()}
    assert len(hits) < 300
    import numpy as np

    held = np.zeros(size.bits // 64, np.uint64)
    for r in words.collect():
        held[r.word] = np.uint64(r.bits & (1 << 64) - 1)
    assert all(bloom.probe(f"present-{i}", held, size) for i in range(1000))
    assert {f"absent-{i}" for i in range(10_000) if bloom.probe(f"absent-{i}", held, size)} == hits


def test_bloom_sizes():
    assert bloom.size(1, 0.01) == bloom.BloomSize(64, 44)
    assert bloom.size(150).bits == 1472 and bloom.size(150).hashes == 7
    for bad in (0, 1, -1, 2):
        with pytest.raises(ValueError):
            bloom.size(10, bad)
    with pytest.raises(ValueError):
        bloom.BloomSize(65, 1)


def test_encoding_and_checksums(spark):
    rows = [("k", 1, False, "v"), ("é", 2**40 + 5, True, ""), ("key", 255, False, "wärme"), ("x" * 300, 256, False, "y" * 70_000)]
    frame = spark.createDataFrame(rows, "key string, sequence long, tombstone boolean, value string")
    made = frame.select("key", codec.encoded(F.col("key"), F.col("sequence"), F.col("tombstone"), F.col("value")).alias("b"), codec.checksum().alias("c")).collect()
    for (k, s, t, v), r in zip(rows, made, strict=True):
        want = struct.pack("<BQII", t, s, len(k.encode()), len(v.encode())) + k.encode() + v.encode()
        assert bytes(r.b) == want == codec.encode(Entry(s, t, k, v))
        assert r.c == zlib.crc32(want) == codec.crc32(want)
        assert codec.decode(want) == Entry(s, t, k, v)


def test_columns_decode_what_is_encoded(spark):
    entries = [Entry(1, False, b"k", b"v"), Entry(2**40 + 5, True, "é".encode(), b""), Entry(255, False, b"x" * 300, b"y" * 70_000), Entry(0, False, b"", b"")]
    good = [codec.encode(e) for e in entries]
    bad = [b"", good[0][:-1], good[0] + b"z", b"\x02" + good[0][1:], good[0][:16], b"\x00" + b"\xff" * 8 + good[0][9:]]
    rows = spark.createDataFrame([(bytearray(b),) for b in good + bad], "b binary").select(codec.decoded(F.col("b")).alias("e")).collect()
    assert [Entry(r.e.sequence, r.e.tombstone, bytes(r.e.key), bytes(r.e.value)) for r in rows[:4]] == entries
    assert [r.e for r in rows[4:]] == [None] * 6
    for size, n in ((1, 200), (2, 40_000), (4, 2**31 + 7), (8, 2**62 + 9)):
        r = spark.range(1).select(codec.little_endian(F.lit(n), size).alias("b")).select("b", codec.read_little_endian(F.col("b"), 0, size).alias("n")).first()
        assert (bytes(r.b), r.n) == (n.to_bytes(size, "little"), n)


@given(st.binary(max_size=40))
def test_decoding_is_strict(data):
    try:
        e = codec.decode(data, binary=True)
    except CorruptionError:
        return
    assert codec.encode(e) == data


def test_frames_are_validated_in_one_pass(spark):
    ok = spark.createDataFrame([("a", "1"), ("b", None)], "key string, value string")
    assert check_frame(ok, Options()) == 2
    assert check_frame(ok.limit(0), Options()) == 0
    for rows, error in (([("", "x")], InvalidKey), ([(None, "x")], InvalidKey), ([("é" * 3, "x")], TooLong), ([("a", "x" * 9)], TooLong)):
        with pytest.raises(error):
            check_frame(spark.createDataFrame(rows, "key string, value string"), Options(max_key_bytes=5, max_value_bytes=8))
