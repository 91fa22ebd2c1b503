"""Tables, scratch tables and text buffers that the operators share."""

from __future__ import annotations

from typing import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession, functions as F

from meshspark.session import scratch_path, ship_package

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query and, where SQL can say it, its DuckDB twin."""
    def register(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship_package(spark)
            return fn(spark, sf_dir)
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return register


def unused(columns: list[str], name: str) -> str:
    """``name``, with underscores before it until no column is called so (names differ by more than case)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def keep(df: DataFrame, name: str) -> DataFrame:
    """Write an intermediate table to the shared folder and read it back: a short lineage that survives lost executors."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    """The session's shuffle partition count, which the caller sizes with the data."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def row_key(*columns: str):
    """A 128-bit key of a row as two longs; equal rows have equal keys, other rows do not meet by accident."""
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in columns]
    digest = F.md5(F.concat_ws("\x01", *parts))
    return F.struct(F.conv(F.substring(digest, 1, 15), 16, 10).cast("long").alias("a"),
                    F.conv(F.substring(digest, 16, 15), 16, 10).cast("long").alias("b"))


def buffer_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and its row offsets, from 0; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + n + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    return data[offsets[0]:offsets[-1]], offsets - offsets[0]


def sliced(batches, limit: int = 1 << 20, column: str = "text"):
    """Record batches cut so that each holds about ``limit`` text bytes or a single row."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        sizes = np.asarray(pa.compute.fill_null(pa.compute.binary_length(batch.column(column)), 0))
        ends = np.cumsum(sizes, dtype=np.int64)
        at = 0
        while at < batch.num_rows:
            before = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, before + limit, side="right")))
            yield batch.slice(at, to - at)
            at = to


SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LONG_WORD = 256


def words_of(data: np.ndarray, offsets: np.ndarray, breaks: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words (by default [^\\x20\\x09-\\x0D]+) of all rows: start, end (byte positions) and row of each."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    inside = ~breaks[data]
    before = np.empty(len(data), bool)
    before[0] = False
    before[1:] = inside[:-1]
    first = offsets[:-1]
    cut = first[(first < len(data)) & (first > 0)]
    before[cut] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.empty(len(data), bool)
    after[-1] = False
    after[:-1] = inside[1:]
    after[cut - 1] = False
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(offsets, starts, side="right") - 1


def mixed(h: np.ndarray) -> np.ndarray:
    """Finalizer: every input bit reaches every output bit."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word, the same in every batch: eight bytes a step; words of 256 bytes or more go through BLAKE2."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    import hashlib
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[:len(data)] = data
    eight = np.lib.stride_tricks.as_strided(padded[:8].view(np.uint64), (len(data) + 1,), (1,))
    size = ends - starts
    h = size.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    live, at, left = np.arange(len(starts)), starts, size
    while len(live):
        part = eight[at]
        short = left < 8
        part[short] &= (np.uint64(1) << (np.uint64(8) * left[short].astype(np.uint64))) - np.uint64(1)
        h[live] = mixed((h[live] ^ part) * np.uint64(0xD6E8FEB86659FD93))
        more = (left > 8) & (size[live] < _LONG_WORD)
        live, at, left = live[more], at[more] + 8, left[more] - 8
    for i in np.flatnonzero(size >= _LONG_WORD):
        h[i] = int.from_bytes(hashlib.blake2b(data[starts[i]:ends[i]].tobytes(), digest_size=8).digest(), "little")
    return h


def ngram_hashes(h: np.ndarray, row: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all n-word windows inside rows, and the index of the first word of each."""
    if len(h) < n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    first = np.flatnonzero(row[n - 1:] == row[:len(row) - n + 1])
    g = np.zeros(len(first), np.uint64)
    for i in range(n):
        g = g * np.uint64(0x9E3779B97F4A7C15) + h[first + i]
    return mixed(g), first


def per_row(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of a per-byte array over every row."""
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]


def ragged(sizes: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Indices at[i], at[i] + 1, ... of ``sizes[i]`` elements for each i, one after the other."""
    before = np.cumsum(sizes) - sizes
    return np.repeat(at - before, sizes) + np.arange(int(sizes.sum()))


def distinct_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of each byte string data[start:end] (equal strings, equal numbers) and the index of the first one of each number.

    Exact: eight bytes a step refine the classes of the step before; strings of 256 bytes or more are compared whole.
    """
    import pandas as pd
    n = len(starts)
    number = np.zeros(n, np.int64)
    if not n:
        return number, number
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[:len(data)] = data
    eight = np.lib.stride_tricks.as_strided(padded[:8].view(np.uint64), (len(data) + 1,), (1,))
    size = ends - starts
    made = 0
    live = np.flatnonzero(size < _LONG_WORD)
    at, left, known = starts[live], size[live], np.zeros(len(live), np.int64)
    while len(live):
        part = eight[at]
        short = left < 8
        part[short] &= (np.uint64(1) << (np.uint64(8) * left[short].astype(np.uint64))) - np.uint64(1)
        code, values = pd.factorize(part)
        # a string that ends here differs from one that goes on, and zero bytes at its end from padding
        known, values = pd.factorize((known * len(values) + code) * 10 + np.minimum(left, 9))
        more = left > 8
        number[live[~more]] = made + known[~more]
        made += len(values)
        live, at, left, known = live[more], at[more] + 8, left[more] - 8, known[more]
    whole: dict[bytes, int] = {}
    for i in np.flatnonzero(size >= _LONG_WORD):
        number[i] = made + whole.setdefault(data[starts[i]:ends[i]].tobytes(), len(whole))
    number, values = pd.factorize(number)
    first = np.empty(len(values), np.int64)
    first[number[::-1]] = np.arange(n)[::-1]
    return number, first


LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32
