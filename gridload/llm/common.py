"""Helpers shared by the operators: staged tables, byte tokeniser, 64-bit hashes, bounded prefilter.

The tokeniser and the hashes are numpy over the UTF-8 bytes of one Arrow batch, inside tasks that Spark
schedules; a batch is cut into slices of bounded bytes, so memory doesn't follow the batch size. A
64-bit hash stands for a word or shingle throughout: for 10^9 different values the chance that two
given ones meet is 5e-20, and operators that compare whole sets or windows compare many at once.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridload.session import scratch_path
from gridload.sources.tables import table  # noqa: F401  (re-exported for the operators)

#: Words: runs without blanks (space, tab to carriage return). The pattern for JVM and SQL use.
WORD = r"[^\x20\x09-\x0D]+"

_M1 = np.uint64(0xBF58476D1CE4E5B9)
_M2 = np.uint64(0x94D049BB133111EB)
_GOLD = np.uint64(0x9E3779B97F4A7C15)
_S31, _S27, _S30 = np.uint64(31), np.uint64(27), np.uint64(30)
_MASKS = np.array([(1 << (8 * k)) - 1 for k in range(9)], dtype=np.uint64)
_LONG_WORD = 4096


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared scratch folder and read it back: cuts lineage, survives lost executors."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def source_order(col: Column) -> list[Column]:
    """Order by code point, null last."""
    return [col.isNull().asc(), col.asc()]


def blank_mask() -> np.ndarray:
    """True for bytes that belong to a word under ``WORD``."""
    m = np.ones(256, dtype=bool)
    m[[0x20, *range(0x09, 0x0E)]] = False
    return m


def alnum_mask() -> np.ndarray:
    """True for ASCII digits and letters and every byte of a non-ASCII character."""
    m = np.zeros(256, dtype=bool)
    for lo, hi in ((0x30, 0x3A), (0x41, 0x5B), (0x61, 0x7B), (0x80, 0x100)):
        m[lo:hi] = True
    return m


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = (x ^ (x >> _S30)) * _M1
    x = (x ^ (x >> _S27)) * _M2
    return x ^ (x >> _S31)


def text_slices(col: pa.Array, max_bytes: int = 4 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Yield (first row, end row, bytes, offsets) slices of a string column; null counts as empty.

    A slice holds at most ``max_bytes`` unless one text alone is longer.
    """
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = pc.fill_null(col.cast(pa.large_string()), "")
    if len(col) == 0:
        return
    off = np.frombuffer(col.buffers()[1], dtype=np.int64)[col.offset: col.offset + len(col) + 1]
    raw = col.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8) if raw is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < len(col):
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + max_bytes, side="right")) - 1)
        hi = min(hi, len(col))
        yield lo, hi, data[off[lo]: off[hi]], off[lo: hi + 1] - off[lo]
        lo = hi


class Words:
    """Words of a slice: 64-bit ``hash`` per word, ``start``/``end`` byte, ``bounds`` (first word of each text)."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, mask: np.ndarray):
        raw = data.tobytes()
        pad = np.frombuffer(raw.translate(_LOWER.tobytes()) + bytes(8), dtype=np.uint8)
        inside = np.frombuffer(raw.translate(mask.tobytes()), dtype=bool)
        first, last = inside.copy(), inside.copy()
        np.greater(inside[1:], inside[:-1], out=first[1:])
        np.greater(inside[:-1], inside[1:], out=last[:-1])
        cut = offsets[(offsets > 0) & (offsets < len(data))]
        first[cut], last[cut - 1] = inside[cut], inside[cut - 1]
        self.start = np.flatnonzero(first)
        self.end = np.flatnonzero(last) + 1
        self.bounds = np.searchsorted(self.start, offsets)
        self.count = np.diff(self.bounds)
        self.hash = _hash_spans(pad, self.start, self.end)


def _hash_spans(pad: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of each byte span, eight bytes a step; spans of over 4 KB go through BLAKE2."""
    size = end - start
    h = mix(size.astype(np.uint64) + _GOLD)
    if not len(start):
        return h
    eight = np.ndarray(shape=(len(pad) - 7,), dtype="<u8", buffer=pad, strides=(1,))
    live, at = None, 0
    short = np.flatnonzero(size <= _LONG_WORD) if size.max() > _LONG_WORD else None
    live = short
    while True:
        s, left = (start, size) if live is None else (start[live], size[live])
        part = eight[s + at] & _MASKS[np.minimum(left - at, 8)]
        if live is None:
            h = mix(h ^ part)
        else:
            h[live] = mix(h[live] ^ part)
        at += 8
        more = np.flatnonzero(left > at)
        live = more if live is None else live[more]
        if not len(live):
            break
    if short is not None:
        for i in np.flatnonzero(size > _LONG_WORD):
            digest = hashlib.blake2b(pad[start[i]: end[i]].tobytes(), digest_size=8).digest()
            h[i] = np.frombuffer(digest, dtype="<u8")[0]
    return h


def grams(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of ``k`` consecutive words; entry i covers words i to i+k-1 (texts not regarded)."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    g = mix(words[:n] + np.uint64(k))
    for j in range(1, k):
        g = mix(g * _GOLD ^ words[j: j + n])
    return g


def gram_starts(bounds: np.ndarray, k: int) -> np.ndarray:
    """Word indexes at which a run of ``k`` words lies within one text."""
    n = int(bounds[-1])
    ok = np.ones(n, dtype=bool)
    for j in range(1, k):
        back = bounds[1:] - j
        ok[back[back >= bounds[:-1]]] = False
    return np.flatnonzero(ok)


def as_long(x: np.ndarray) -> np.ndarray:
    """The same 64 bits as a signed Spark long."""
    return x.view(np.int64)


def lists(flat: pa.Array, counts: np.ndarray) -> pa.ListArray:
    """A list column from flat values and the length of each row."""
    off = np.zeros(len(counts) + 1, dtype=np.int32)
    np.cumsum(counts, out=off[1:])
    return pa.ListArray.from_arrays(pa.array(off, pa.int32()), flat)


class BoundedFilter:
    """A one-hash Bloom filter of fixed size over 64-bit hashes, used only as a prefilter.

    Its size is a constant (``2^bits`` bits: 4 MB at the default 25), so it may be broadcast whatever the
    input. When the input outgrows it, it lets more rows pass; the exact join behind it decides, so
    results never depend on it.
    """

    def __init__(self, spark: SparkSession, df: DataFrame, hash_col: str, bits: int = 25):
        self.bits = bits
        slot = F.shiftrightunsigned(F.col(hash_col), 64 - bits)
        cells = (df.select(slot.alias("s")).groupBy(F.shiftright("s", 6).alias("w"))
                 .agg(F.expr("bit_or(shiftleft(1L, cast(s % 64 AS int)))").alias("b")).toPandas())
        words = np.zeros(1 << (bits - 6), dtype=np.uint64)
        words[cells["w"].to_numpy(dtype=np.int64)] = cells["b"].to_numpy(dtype=np.int64).view(np.uint64)
        self.shared = spark.sparkContext.broadcast(words)

    def tester(self):
        """A function for tasks: mask of the hashes that may be in the set."""
        shared, shift = self.shared, np.uint64(64 - self.bits)

        def may_hold(h: np.ndarray) -> np.ndarray:
            slot = h >> shift
            return (shared.value[slot >> np.uint64(6)] >> (slot & np.uint64(63))) & np.uint64(1) == 1

        return may_hold
