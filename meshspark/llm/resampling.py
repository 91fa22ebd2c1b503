"""Importance resampling towards a target distribution, with hashed word n-gram features.

The CRC of a feature is needed once per distinct feature of a block of texts. Distinct features are laid out by equal length
in two-dimensional byte arrays; all CRCs of an array advance together, one column of bytes at a time, and go back to the
places of their features. Counts per hash bucket of corpus and target give every bucket a gain; a document weighs the mean
gain of its features, and adding Gumbel noise to the weights turns a draw without replacement into a sort.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from meshspark.llm.shared import LOWER, buffer_of, distinct_words, keep, query, ragged, read, sliced, words_of

BUCKETS = 10_000
BLOCK_BYTES = 8 << 20
WIDEST = 256

# Fixed value: word breaks are [\x00-\x2F\x3A-\x60\x7B-\x7F] after lower-casing.
BREAKS = np.zeros(256, bool)
BREAKS[[*range(0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]] = True


def crc_table() -> np.ndarray:
    """CRC-32 of the single bytes, from the reflected polynomial."""
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(0xEDB88320), t >> 1).astype(np.uint32)
    return t


_TABLE = crc_table()


def crc_columns(rows: np.ndarray) -> np.ndarray:
    """CRC-32 of every row of a two-dimensional byte array."""
    c = np.full(len(rows), 0xFFFFFFFF, np.uint32)
    for column in np.ascontiguousarray(rows.T):
        c = _TABLE[(c ^ column) & np.uint32(0xFF)] ^ (c >> np.uint32(8))
    return ~c


def crc_by_length(data: np.ndarray, at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """CRC-32 of the byte strings data[at:at + size], grouped by equal length; past ``WIDEST`` bytes one string at a time."""
    import zlib
    out = np.empty(len(at), np.uint32)
    order = np.argsort(size, kind="stable")
    edges = np.flatnonzero(np.diff(size[order], prepend=-1))
    for a, b in zip(edges, [*edges[1:], len(order)]):
        rows, width = order[a:b], int(size[order[a]])
        if width > WIDEST:
            for i in rows:
                out[i] = zlib.crc32(data[at[i]:at[i] + width])
        else:
            out[rows] = crc_columns(data[at[rows, None] + np.arange(width)])
    return out


def _stretches(data: np.ndarray, offsets: np.ndarray, limit: int):
    """(bytes, offsets, lead): the block itself, or stretches of a single long row; a stretch with ``lead`` starts with the last word of the one before."""
    if len(offsets) != 2 or len(data) <= limit:
        yield data, offsets, False
        return
    at, end, lead = 0, 0, False
    while end < len(data):
        rest = np.flatnonzero(BREAKS[data[end + limit:]])[:1]
        end = end + limit + int(rest[0]) if len(rest) else len(data)
        cut = np.array([0, end - at])
        yield data[at:end], cut, lead
        starts = words_of(data[at:end], cut, BREAKS)[0]
        at, lead = (at + int(starts[-1]), True) if len(starts) else (end, False)


def features(data: np.ndarray, offsets: np.ndarray, buckets: int, lead: bool = False):
    """(bucket, row) of every run of one or two consecutive words, repeats included; with ``lead`` the first word alone does not count."""
    import pandas as pd
    starts, ends, row = words_of(data, offsets, BREAKS)
    word, first = distinct_words(data, starts, ends)
    if not len(word):
        return np.zeros(0, np.int64), row
    at, size = starts[first], (ends - starts)[first]
    pair_at = np.flatnonzero(row[1:] == row[:-1])
    pair, values = pd.factorize(word[pair_at] * len(first) + word[pair_at + 1])
    a, b = np.divmod(values, len(first))
    wide = size[a] + 1 + size[b]
    begin = np.cumsum(wide) - wide
    joined = np.full(int(wide.sum()), 0x20, np.uint8)
    joined[ragged(size[a], begin)] = data[ragged(size[a], at[a])]
    joined[ragged(size[b], begin + size[a] + 1)] = data[ragged(size[b], at[b])]
    one = (crc_by_length(data, at, size) % np.uint32(buckets)).astype(np.int64)[word]
    two = (crc_by_length(joined, begin, wide) % np.uint32(buckets)).astype(np.int64)[pair]
    skip = 1 if lead else 0
    return np.concatenate([one[skip:], two]), np.concatenate([row[skip:], row[pair_at]])


def _blocks(batches):
    for b in sliced(batches, BLOCK_BYTES):
        data, offsets = buffer_of(b.column("text"))
        yield b, LOWER[data], offsets


def bucket_counts(docs: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Features of all texts per hash bucket; every task sends its sums, the driver receives one row per bucket."""
    def run(batches):
        total = np.zeros(buckets, np.int64)
        for _, data, offsets in _blocks(batches):
            for part, cut, lead in _stretches(data, offsets, BLOCK_BYTES):
                total += np.bincount(features(part, cut, buckets, lead)[0], minlength=buckets)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], names=["bucket", "n"])

    rows = docs.select("text").mapInArrow(run, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(buckets, np.int64)
    for r in rows:
        out[r.bucket] = r.n
    return out


def bucket_gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of smoothed bucket shares, target to corpus, floored."""
    n, s, t = len(corpus), float(corpus.sum()), float(target.sum())
    return np.array([math.floor(1000 * math.log((float(b) + 1) * (s + n) / ((float(a) + 1) * (t + n)))) for a, b in zip(corpus, target)], np.int64)


def _noise(text: str) -> int:
    h = int(hashlib.sha256(text.encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def weigh(docs: DataFrame, gains: np.ndarray, seed: int = 7) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score) of every row of docs (doc_id, text)."""
    from pyspark.sql.pandas.types import to_arrow_type
    kind = docs.schema["doc_id"].dataType
    names = ["doc_id", "n_words", "n_features", "weight", "score"]

    def run(batches):
        for b, data, offsets in _blocks(batches):
            n = b.num_rows
            count, total, repeated = np.zeros(n, np.int64), np.zeros(n, np.int64), 0
            for part, cut, lead in _stretches(data, offsets, BLOCK_BYTES):
                bucket, row = features(part, cut, len(gains), lead)
                value = np.zeros(len(bucket) + 1, np.int64)
                order = np.argsort(row, kind="stable")
                np.cumsum(gains[bucket][order], out=value[1:])
                edge = np.searchsorted(row[order], np.arange(n + 1))
                count += np.diff(edge)
                total += value[edge[1:]] - value[edge[:-1]]
            weight = np.where(count > 0, total // np.maximum(count, 1), 0)
            noise = np.array([_noise(k) for k in b.column("key").to_pylist()], np.int64)
            columns = [b.column("doc_id"), pa.array((count + 1) // 2), pa.array(count), pa.array(weight), pa.array(weight + noise)]
            yield pa.RecordBatch.from_arrays(columns, schema=schema)

    schema = pa.schema([("doc_id", to_arrow_type(kind)), *[(c, pa.int64()) for c in names[1:]]])
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    return docs.select("doc_id", "text", key.alias("key")).mapInArrow(
        run, f"doc_id {kind.simpleString()}, " + ", ".join(f"{c} bigint" for c in names[1:]))


def ranked(rows: DataFrame, order: list, name: str) -> DataFrame:
    """Rows numbered from 1 in one global order: sorted by ranges, numbered inside each range, shifted by the sizes of the ranges before.

    ``order`` must tell rows apart, so that equal leading values may lie in several ranges.
    """
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    placed = keep(placed, "ranked-rows").withColumn("_range", F.shiftright("_at", 33))
    sizes = placed.groupBy("_range").agg(F.count("*").alias("_n"))  # one row per range
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    return placed.join(F.broadcast(starts), "_range") \
        .withColumn(name, F.col("_start") + F.col("_at").bitwiseAND((1 << 33) - 1) + 1).drop("_at", "_range", "_start")


def resample(docs: DataFrame, target: DataFrame, percent: int = 25, min_words: int = 20, buckets: int = BUCKETS, seed: int = 7) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) of every row of docs (doc_id, text); ``target`` is any table with ``text``.

    Of the documents with at least ``min_words`` words the ``percent`` with the highest scores are drawn and ranked from 1; ties go
    to the smaller doc_id, equal rows follow one another. Null and empty texts have no features, weight 0 and no rank; a null
    doc_id draws its noise from the empty id and comes before others at equal score; an empty table gives an empty one, an
    empty target counts 0 in every bucket. Texts above ``BLOCK_BYTES`` are read in stretches. Other columns are ignored.
    """
    gains = bucket_gains(bucket_counts(docs, buckets), bucket_counts(target, buckets))
    rows = keep(weigh(docs, gains, seed).withColumn("_in", F.col("n_words") >= min_words)
                .withColumn("_row", F.monotonically_increasing_id()), "weighed")
    drawn = percent * rows.filter("_in").count() // 100
    placed = ranked(rows, [F.col("_in").desc(), F.col("score").desc(), F.col("doc_id").asc(), F.col("_row").asc()], "_rank")
    rank = F.when(F.col("_in") & (F.col("_rank") <= drawn), F.col("_rank"))
    return placed.select("doc_id", "n_features", "weight", "score", rank.alias("rank"))


@query("op11_importance_resampling")
def op11_importance_resampling(spark, sf_dir):
    return resample(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
