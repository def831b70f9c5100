"""Entry encoding and checksums, as columns and on the driver.

An entry is: tombstone (1 byte), sequence (8), key length (4), value length (4), key, value; numbers little-endian.
"""

from __future__ import annotations

import struct
import zlib

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..model import CorruptionError, Entry, raw

_HEAD = struct.Struct("<BQII")


def little_endian(number: Column, size: int) -> Column:
    """The number's last `size` bytes, the least first."""
    digits = F.lpad(F.hex(number.cast("long")), 16, "0")
    return F.unhex(F.concat(*(F.substring(digits, 15 - 2 * k, 2) for k in range(size))))


def encoded(key: Column, sequence: Column, tombstone: Column, value: Column) -> Column:
    """The entry's bytes."""
    return F.concat(little_endian(tombstone.cast("int"), 1), little_endian(sequence, 8), little_endian(F.octet_length(key), 4), little_endian(F.octet_length(value), 4), key.cast("binary"), value.cast("binary"))


def read_little_endian(data: Column, at: int, size: int) -> Column:
    """The number in `size` bytes from byte `at` (from 0); null if there are fewer, or if it exceeds a long."""
    digits = F.concat(*(F.hex(F.substring(data, at + 1 + k, 1)) for k in reversed(range(size))))
    number = F.conv(digits, 16, 10).try_cast("long")
    return F.when(F.octet_length(data) >= at + size, number)


def decoded(data: Column) -> Column:
    """key, sequence, tombstone, value (key and value as bytes) of encoded entries; null for bytes that are no entry."""
    flag, sequence, k, v = (read_little_endian(data, at, n) for at, n in ((0, 1), (1, 8), (9, 4), (13, 4)))
    whole = (flag <= 1) & (F.octet_length(data) == k + v + _HEAD.size) & sequence.isNotNull()
    key = F.substring(data, F.lit(_HEAD.size + 1), k.cast("int"))
    value = F.substring(data, (k + _HEAD.size + 1).cast("int"), v.cast("int"))
    return F.when(whole, F.struct(key.alias("key"), sequence.alias("sequence"), (flag == 1).alias("tombstone"), value.alias("value")))


def checksum(key: str = "key", sequence: str = "sequence", tombstone: str = "tombstone", value: str = "value") -> Column:
    """CRC-32 of the entry's bytes."""
    return F.crc32(encoded(F.col(key), F.col(sequence), F.col(tombstone), F.col(value)))


def encode(e: Entry) -> bytes:
    key, value = raw(e.key), raw(e.value)
    return _HEAD.pack(e.tombstone, e.sequence, len(key), len(value)) + key + value


def decode(data: bytes, binary: bool = False) -> Entry:
    """The entry of exactly these bytes."""
    if len(data) < _HEAD.size:
        raise CorruptionError("entry is cut short")
    tombstone, sequence, k, v = _HEAD.unpack_from(data)
    if tombstone > 1 or len(data) != _HEAD.size + k + v:
        raise CorruptionError("entry does not fit its header")
    key, value = data[_HEAD.size : _HEAD.size + k], data[_HEAD.size + k :]
    return Entry(sequence, bool(tombstone), key if binary else key.decode(), value if binary else value.decode())


def crc32(data: bytes) -> int:
    return zlib.crc32(data)
