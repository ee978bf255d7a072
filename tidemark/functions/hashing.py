"""Functions without a Spark built-in, as Arrow-batched UDFs: hashes, time-ordered ids, CBOR."""

from __future__ import annotations

import json
import os
import struct
import time

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_MASK64 = (1 << 64) - 1
_MASK32 = (1 << 32) - 1


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fnv1a_64(data: bytes) -> int:
    """FNV-1a, 64 bits, as a signed long."""
    h = 0xCBF29CE484222325
    for b in data:
        h = (h ^ b) * 0x100000001B3 & _MASK64
    return _signed(h)


def murmur3_32(data: bytes, seed: int = 0) -> int:
    """MurmurHash3 x86 32 bits, as a non-negative long."""
    rotl = lambda x, r: (x << r | x >> (32 - r)) & _MASK32
    scramble = lambda k: rotl(k * 0xCC9E2D51 & _MASK32, 15) * 0x1B873593 & _MASK32
    h, body = seed, len(data) & ~3
    for (k,) in struct.iter_unpack("<I", data[:body]):
        h = (rotl(h ^ scramble(k), 13) * 5 + 0xE6546B64) & _MASK32
    if tail := data[body:]:
        h ^= scramble(int.from_bytes(tail, "little"))
    h ^= len(data)
    h = (h ^ h >> 16) * 0x85EBCA6B & _MASK32
    h = (h ^ h >> 13) * 0xC2B2AE35 & _MASK32
    return h ^ h >> 16


def xxh3_64(data: bytes) -> int:
    return _signed(xxhash.xxh3_64_intdigest(data))


def xxh3_128(data: bytes) -> bytes:
    return xxhash.xxh3_128_digest(data)


def uuid7(now_ms: int, random: bytes) -> str:
    """RFC 9562 version 7: 48 bits of milliseconds, version, variant, 74 random bits."""
    body = bytearray(now_ms.to_bytes(6, "big") + random[:10])
    body[6] = body[6] & 0x0F | 0x70
    body[8] = body[8] & 0x3F | 0x80
    h = body.hex()
    return f"{h[:8]}-{h[8:12]}-{h[12:16]}-{h[16:20]}-{h[20:]}"


class CborError(ValueError):
    pass


def decode_cbor(data: bytes):
    """A CBOR item as Python data: integers, floats, strings, bytes, arrays, maps, simple values."""
    value, at = _cbor_item(data, 0)
    if at != len(data):
        raise CborError("bytes after the item")
    return value


def _cbor_head(data: bytes, at: int) -> tuple[int, int, int | None, int]:
    first = data[at]
    major, info = first >> 5, first & 31
    if info < 24:
        return major, info, info, at + 1
    if info < 28:
        n = 1 << (info - 24)
        return major, info, int.from_bytes(data[at + 1 : at + 1 + n], "big"), at + 1 + n
    if info == 31:
        return major, info, None, at + 1
    raise CborError("reserved length")


def _cbor_item(data: bytes, at: int):
    major, info, n, at = _cbor_head(data, at)
    if major == 0:
        return n, at
    if major == 1:
        return -1 - n, at
    if major in (2, 3):
        if n is None:  # chunks up to a break
            parts = []
            while data[at] != 0xFF:
                part, at = _cbor_item(data, at)
                parts.append(part)
            return (b"" if major == 2 else "").join(parts), at + 1
        raw = data[at : at + n]
        if len(raw) != n:
            raise CborError("cut short")
        return (raw if major == 2 else raw.decode()), at + n
    if major in (4, 5):
        items, left = [], None if n is None else n * (major - 3)
        while left is None or left:
            if left is None and data[at] == 0xFF:
                at += 1
                break
            item, at = _cbor_item(data, at)
            items.append(item)
            left = left if left is None else left - 1
        return (items if major == 4 else dict(zip(map(str, items[::2]), items[1::2], strict=True))), at
    if major == 6:
        return _cbor_item(data, at)  # tags don't change the value
    if info == 25:
        return struct.unpack(">e", n.to_bytes(2, "big"))[0], at
    if info == 26:
        return struct.unpack(">f", n.to_bytes(4, "big"))[0], at
    if info == 27:
        return struct.unpack(">d", n.to_bytes(8, "big"))[0], at
    return {20: False, 21: True}.get(info), at


def cbor_to_json(data: bytes) -> str | None:
    """The item as JSON text, bytes as hex; None if the bytes are no CBOR."""
    try:
        return json.dumps(decode_cbor(data), default=lambda x: x.hex() if isinstance(x, bytes) else str(x), separators=(",", ":"))
    except (CborError, IndexError, UnicodeDecodeError, ValueError, struct.error):
        return None


def _over_bytes(function, returns: T.DataType, arrow: pa.DataType):
    @F.arrow_udf(returns)
    def run(column: pa.Array) -> pa.Array:
        return pa.array([None if b is None else function(b) for b in column.to_pylist()], arrow)

    return run


#: Longer values are hashed one by one; shorter ones together, position by position.
TOGETHER_BYTES = 4096


def _together(column: pa.Array, one, several) -> pa.Array:
    """Hashes of a binary column: ``several`` takes the bytes, and the starts and lengths of values
    sorted from long to short; nulls stay null."""
    rows = np.flatnonzero(column.is_valid().to_numpy(zero_copy_only=False))
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    lengths = np.diff(offsets)
    out = np.zeros(len(column), np.int64)
    short = rows[lengths[rows] <= TOGETHER_BYTES]
    short = short[np.argsort(-lengths[short], kind="stable")]
    out[short] = several(data, offsets[short].astype(np.int64), lengths[short])
    for i in rows[lengths[rows] > TOGETHER_BYTES]:
        out[i] = one(data[offsets[i] : offsets[i + 1]].tobytes())
    return pa.array(out, pa.int64(), mask=~column.is_valid().to_numpy(zero_copy_only=False))


def fnv1a_64_several(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    h = np.full(len(starts), 0xCBF29CE484222325, np.uint64)
    for at in range(int(lengths.max(initial=0))):
        n = int(np.searchsorted(-lengths, -at, "left"))  # so many values go on
        h[:n] = (h[:n] ^ data[starts[:n] + at]) * np.uint64(0x100000001B3)
    return h.view(np.int64)


def murmur3_32_several(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    u = np.uint32
    rotl = lambda x, r: x << u(r) | x >> u(32 - r)
    scramble = lambda k: rotl(k * u(0xCC9E2D51), 15) * u(0x1B873593)
    h, blocks = np.zeros(len(starts), u), lengths // 4
    for at in range(int(blocks.max(initial=0))):
        n = int(np.searchsorted(-blocks, -at, "left"))
        k = sum(data[starts[:n] + 4 * at + j].astype(u) << u(8 * j) for j in range(4))
        h[:n] = rotl(h[:n] ^ scramble(k), 13) * u(5) + u(0xE6546B64)
    k = np.zeros(len(starts), u)
    for j in range(3):
        has = np.flatnonzero(lengths % 4 > j)
        k[has] |= data[starts[has] + 4 * blocks[has] + j].astype(u) << u(8 * j)
    h ^= scramble(k) ^ lengths.astype(u)  # a tail of nothing scrambles to nothing
    h = (h ^ h >> u(16)) * u(0x85EBCA6B)
    h = (h ^ h >> u(13)) * u(0xC2B2AE35)
    return (h ^ h >> u(16)).astype(np.int64)


def _hashed_together(one, several):
    @F.arrow_udf(T.LongType())
    def run(column: pa.Array) -> pa.Array:
        return _together(column, one, several)

    return run


def _bytes(c: Column) -> Column:
    return c.cast("binary")


def fnv(c: Column) -> Column:
    return _hashed_together(fnv1a_64, fnv1a_64_several)(_bytes(c))


def murmur3(c: Column) -> Column:
    return _hashed_together(murmur3_32, murmur3_32_several)(_bytes(c))


def xxh3(c: Column) -> Column:
    return _over_bytes(xxh3_64, T.LongType(), pa.int64())(_bytes(c))


def xxh128(c: Column) -> Column:
    return _over_bytes(xxh3_128, T.BinaryType(), pa.binary())(_bytes(c))


def cbor_json(c: Column) -> Column:
    return _over_bytes(cbor_to_json, T.StringType(), pa.string())(_bytes(c))


def uuidv7() -> Column:
    @F.arrow_udf(T.StringType())
    def run(column: pa.Array) -> pa.Array:
        now = time.time_ns() // 1_000_000
        return pa.array([uuid7(now, os.urandom(10)) for _ in range(len(column))], pa.string())

    return run.asNondeterministic()(F.rand())
