"""Shared helpers: table readers, scratch tables, and vectorised word hashing over Arrow buffers."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from functools import wraps

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import discard, read, scratch_dir, spread, stored  # noqa: F401  (for the operators)

WHITE = np.zeros(256, bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_P = np.uint64(0x9E3779B97F4A7C15)
_P_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(read(spark, sf_dir, name))


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (bijective), elementwise."""
    x = x ^ (x >> np.uint64(30))
    x = x * _M1
    x ^= x >> np.uint64(27)
    x *= _M2
    x ^= x >> np.uint64(31)
    return x


def string_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and row offsets (starting at 0) of a string column; null counts as empty."""
    if pa.types.is_dictionary(column.type):
        column = column.dictionary_decode()
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()).fill_null(b"")
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, off, data = column.buffers()
    off = np.frombuffer(off, np.int64, n + 1, column.offset * 8)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[off[0] : off[-1]], off - off[0]


_POWERS: list[np.ndarray] = []


def _powers(n: int) -> list[np.ndarray]:
    """p^i and p^-i modulo 2^64, for i below n at least."""
    if not _POWERS or len(_POWERS[0]) < n:
        n = (n | 0x3FFFF) + 1
        up, down = np.full(n, _P, np.uint64), np.full(n, _P_INVERSE, np.uint64)
        up[0] = down[0] = 1
        _POWERS[:] = np.multiply.accumulate(up), np.multiply.accumulate(down)
    return _POWERS


class Rolling:
    """Hashes of any byte ranges of a buffer, by prefix sums of b_i * p^i modulo 2^64."""

    def __init__(self, data: np.ndarray):
        n = len(data)
        up, self.down = _powers(n + 1)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:n], out=self.sums[1:])

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.down[start])

    def all(self, k: int) -> np.ndarray:
        """The hash of the k bytes from each place on."""
        m = max(0, len(self.sums) - k)
        return mix((self.sums[k:] - self.sums[:m]) * self.down[:m])


def word_bounds(inside: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of true, which no row boundary (off) is inside of."""
    n = len(inside)
    cut = np.zeros(n + 1, bool)
    cut[off] = True
    start, stop = inside.copy(), inside.copy()
    start[1:] &= ~inside[:-1] | cut[1:n]
    stop[:-1] &= ~inside[1:] | cut[1:n]
    return np.flatnonzero(start), np.flatnonzero(stop) + 1


def word_hashes(data: np.ndarray, off: np.ndarray, white: np.ndarray = WHITE) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of each word (runs of bytes that aren't white, A-Z lowered) of all rows, and word offsets by row."""
    if len(data) == 0:
        return np.zeros(0, np.uint64), np.zeros(len(off), np.int64)
    s, e = word_bounds(~white[data], off)
    return Rolling(LOWER[data])(s, e), np.searchsorted(s, off).astype(np.int64)


def shingles(words: np.ndarray, woff: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each row's k-word shingles; a row with 1 to k-1 words has its whole sequence as the one shingle."""
    n = np.diff(woff)
    count = np.where(n >= k, n - k + 1, (n > 0).astype(np.int64))
    soff = np.zeros(len(woff), np.int64)
    np.cumsum(count, out=soff[1:])
    total = int(soff[-1])
    if total == 0:
        return np.zeros(0, np.uint64), soff
    row = np.repeat(np.arange(len(n)), count)
    at = np.arange(total) - soff[row] + woff[row]
    h = np.zeros(total, np.uint64)
    last = len(words) - 1
    left = woff[row + 1] - at
    for j in range(k):
        part = words[np.minimum(at + j, last)]
        h = np.where(left > j, mix(h * _P + part + np.uint64(j + 1)), h)
    return h, soff


def small_batches(spark: SparkSession, mb: int = 2) -> None:
    """Bound the Arrow batches that Python workers get by bytes, so long texts don't add up."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(mb << 20))


#: Bytes of batches after which a worker gives back what it has freed.
GIVE_BACK = 16 << 20


def give_back() -> None:
    """Return freed memory, which Arrow and the C library keep for later, to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc only
    if trim is not None:
        trim(0)


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, for mapInArrow: freed memory goes back now and then and when a task ends, as Spark keeps its Python workers for the tasks and stages to come."""

    @wraps(run)
    def whole(batches):
        def given():
            size = 0
            for batch in batches:
                size += batch.nbytes
                yield batch
                if size > GIVE_BACK:
                    give_back()
                    size = 0

        yield from run(given())
        give_back()

    return whole


def hash_bitmap(hashes: DataFrame, bits: int) -> np.ndarray:
    """A bitmap (as bytes) of the low bits of 64-bit hashes, the one column of hashes; bits (a power of 2, 32,768 at least) is its size whatever comes in."""
    slot = F.col(hashes.columns[0]).bitwiseAND(bits - 1) + 1
    maps = hashes.select(slot.alias("x")).groupBy(F.bitmap_bucket_number("x").alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("x")).alias("m"))
    out = np.zeros(bits // 8, np.uint8)
    for r in maps.toLocalIterator():  # bits / 32,768 rows of 4 KB at most
        own = np.frombuffer(r.m, np.uint8)
        out[(r.k - 1) * 4096 : (r.k - 1) * 4096 + len(own)] = own
    return out


def texts_of(batch: pa.RecordBatch, name: str | int = "text") -> list[str]:
    """A batch's strings; null counts as empty."""
    return batch.column(name).fill_null("").to_pylist()


def longs(x: np.ndarray) -> pa.Array:
    """64-bit values, unsigned ones with the same bits, as a column of long."""
    return pa.array(x.view(np.int64) if x.dtype == np.uint64 else x, pa.int64())


def schema_of(df: DataFrame, names: list[str]) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*names).schema)


def row_groups(off: np.ndarray, most: int = 4096, size: int = 1 << 18):
    """Consecutive row ranges of at most so many rows, and of so many bytes unless they are one row."""
    a, n = 0, len(off) - 1
    while a < n:
        b = min(n, a + most, max(a + 1, int(np.searchsorted(off, off[a] + size, "right")) - 1))
        yield a, b
        a = b


#: Bits of a token that go with the row in one sort key.
TOKEN_BITS = 52


def distinct_tokens(h: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each row's distinct tokens (52 bits of the hash) in order, their rows, and row offsets; at most 4,096 rows."""
    row = np.repeat(np.arange(len(off) - 1, dtype=np.uint64), np.diff(off))
    key = np.sort(row << np.uint64(TOKEN_BITS) | h >> np.uint64(64 - TOKEN_BITS))
    if len(key):
        key = key[np.concatenate(([True], key[1:] != key[:-1]))]
    row = (key >> np.uint64(TOKEN_BITS)).astype(np.int64)
    return key & np.uint64((1 << TOKEN_BITS) - 1), row, np.searchsorted(row, np.arange(len(off))).astype(np.int64)
