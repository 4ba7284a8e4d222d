"""Words and their hashes over whole Arrow columns, without a Python object per word.

A word is a run of bytes other than 0x20 and 0x09-0x0D, which in UTF-8 is the same as
``[^\\x20\\x09-\\x0D]+`` over code points. A word's hash is the sum of a 64-bit mix of each byte
and its place in the word, so that no structure of long words cancels out. A window's hash is a
polynomial over its words' hashes modulo the prime 2**61 - 1 (Rabin-Karp), built from halves.
"""

from __future__ import annotations

import ctypes

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
BASE = 0x9E3779B97F4A7C15 | 1
PRIME = (1 << 61) - 1
#: (seed of word hashes, base of window hashes) of two independent hashes.
ONE = (0xD1342543DE82EF95, 0x0B5297A4D3F1C68E % PRIME)
TWO = (0x2545F4914F6CDD1D, 0x1A2F8C3B7E90D455 % PRIME)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit values that spreads every bit."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def byte_values(lower: bool, seed: int = ONE[0]) -> np.ndarray:
    values = mix(np.arange(1, 257, dtype=U) * U(seed))
    if lower:
        values[65:91] = values[97:123]
    return values


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, U)
    if n:
        out[0] = 1
    np.multiply.accumulate(out, out=out)
    return out


class Powers:
    """Powers of the base and of its inverse, as long as any chunk so far needed."""

    def __init__(self, base: int = BASE) -> None:
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.empty(0, U)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            self.up, self.down = powers(self.base, n), powers(self.inverse, n)
        return self.up[:n], self.down[:n]


def utf8(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string column and where each row starts (one more than rows); null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.binary() if pa.types.is_string(column.type) else pa.large_binary()).cast(pa.large_binary()), b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = column.buffers()[2]
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)), offsets


def chunks(data: np.ndarray, offsets: np.ndarray, limit: int = 1 << 20):
    """Row ranges of about ``limit`` bytes (a longer text stands alone), as (first row, bytes, starts)."""
    row, rows = 0, len(offsets) - 1
    while row < rows:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + limit, side="right")) - 1)
        yield row, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


def word_spans(data: np.ndarray, offsets: np.ndarray, separators: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First byte, byte behind the end, and row of every word."""
    if not len(data):
        none = np.empty(0, np.int64)
        return none, none, none
    word = ~separators[data]
    first, last = word.copy(), word.copy()
    first[1:] &= ~word[:-1]
    last[:-1] &= ~word[1:]
    full = np.flatnonzero(offsets[1:] > offsets[:-1])
    first[offsets[full]] = word[offsets[full]]
    last[offsets[full + 1] - 1] = word[offsets[full + 1] - 1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return start, end, np.searchsorted(offsets[1:], start, side="right")


def white_space() -> np.ndarray:
    separators = np.zeros(256, bool)
    separators[[9, 10, 11, 12, 13, 32]] = True
    return separators


def span_hashes(values: np.ndarray, start: np.ndarray, end: np.ndarray, base: Powers) -> np.ndarray:
    """A hash of values[start:end] for every span, from one prefix sum."""
    up, down = base.get(len(values))
    sums = np.zeros(len(values) + 1, U)
    np.cumsum(values * up, out=sums[1:])
    return mix((sums[end] - sums[start]) * down[start] + (end - start).astype(U))


def word_hashes(values: np.ndarray, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash of the bytes data[start:end] of every word; words do not overlap and ascend."""
    length = end - start
    sums = np.zeros(int(length.sum()) + 1, U)
    behind = np.cumsum(length)
    place = np.arange(len(sums) - 1, dtype=np.int64) - np.repeat(behind - length, length)
    bytes_ = data[place + np.repeat(start, length)]
    np.cumsum(mix(values[bytes_] + place.view(U) * U(0x9E3779B97F4A7C15)), out=sums[1:])
    return mix(sums[behind] - sums[behind - length] + length.view(U))


def _times(a: np.ndarray, b: int) -> np.ndarray:
    """a * b modulo PRIME of values below it, without wider integers."""
    half, low = U(31), U((1 << 31) - 1)
    high, rest = a >> half, a & low
    b_high, b_rest = U(b >> 31), U(b & ((1 << 31) - 1))
    middle = high * b_rest + rest * b_high
    total = high * b_high * U(2) + (middle >> U(30)) + ((middle & U((1 << 30) - 1)) << half) + rest * b_rest
    return _reduce(total)


def _reduce(x: np.ndarray) -> np.ndarray:
    x = (x & U(PRIME)) + (x >> U(61))
    return x - U(PRIME) * (x >= U(PRIME))


def _polynomials(words: np.ndarray, width: int, base: int) -> np.ndarray:
    """The polynomial of words[i : i + width] for every i, in steps that double the width."""
    one, out, have, span = _reduce(words >> U(3)), None, 0, 1
    while True:
        if width & span:
            if out is None:
                out = one
            else:
                n = len(words) - have - span + 1
                out = _reduce(_times(out[:n], pow(base, span, PRIME)) + one[have : have + n])
            have += span
        if have == width:
            return out
        one = _reduce(_times(one[:-span], pow(base, span, PRIME)) + one[span:])
        span *= 2


def window_hashes(words: np.ndarray, row: np.ndarray, width: int, base: int) -> tuple[np.ndarray, np.ndarray]:
    """Index of the first word, and a hash, for every ``width`` consecutive words of one row."""
    if len(words) < width:
        return np.empty(0, np.int64), np.empty(0, U)
    first = np.flatnonzero(row[width - 1 :] == row[: len(row) - width + 1])
    return first, mix(_polynomials(words, width, base)[first] + U(width * BASE % (1 << 64)))


def small_batches(spark, rows: int = 1000) -> None:
    """Let this session hand at most ``rows`` rows at once to Python: texts may be long, and both the
    executor and its workers hold whole batches. Results don't depend on it."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= rows:
        spark.conf.set(name, str(rows))


def release() -> None:
    """Give memory that is free in this worker back to the system: it may stay idle beside others."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def hash_long(x: np.ndarray, seed: np.ndarray | int = 42) -> np.ndarray:
    """Spark's xxhash64 of a long column, as int64; ``seed``: the hash of the columns before it."""
    p1, p2, p3, p4, p5 = (U(v) for v in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
    turn = lambda v, n: (v << U(n)) | (v >> U(64 - n))
    h = (np.full(len(x), seed, np.int64) if isinstance(seed, int) else seed).view(U) + p5 + U(8)
    h ^= turn(x.astype(np.int64).view(U) * p2, 31) * p1
    h = turn(h, 27) * p1 + p4
    h = (h ^ (h >> U(33))) * p2
    h = (h ^ (h >> U(29))) * p3
    return (h ^ (h >> U(32))).view(np.int64)
