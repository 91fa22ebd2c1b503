"""Near copies by exact Jaccard similarity of five-word shingles.

Every text has a SimHash fingerprint over its shingles; the Gray-order index of ``simhash`` links fingerprints at three or fewer differing
bits, and their texts are candidates. That is about 0.98 in similarity, so MinHash values in bands widen the search down to 0.8: texts that
share a band are candidates too. Candidates chain to loose clusters. Texts of one
cluster meet in one task, which counts their common shingles exactly and links those at a similarity of 0.8 or more. A cluster too
large for a task is cut into blocks and every pair of blocks meets. A pair at exactly 0.8 shares no band with a probability of
(1 - 0.8^5)^28, about 2 in 100,000, and less above; nothing else can lose a link.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from meshspark.llm import simhash
from meshspark.llm.shared import buffer_of, keep, mixed, ngram_hashes, partitions, sliced, unused, word_hashes, words_of
from meshspark.operators.graph import components

WORDS = 5
BANDS, ROWS = 28, 5
BLOCK = 2_000_000
_PRIME = np.uint64(0x9E3779B97F4A7C15)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def shingle_sets(column) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes of the five-word shingles (ASCII-lower-cased words) of every row, and row offsets.

    A shorter text is one shingle of all its words; null and empty texts share the shingle of no word.
    """
    data, offsets = buffer_of(column)
    data = _LOWER[data]
    starts, ends, row = words_of(data, offsets)
    h = word_hashes(data, starts, ends)
    g, first = ngram_hashes(h, row, WORDS)
    n = np.bincount(row, minlength=len(offsets) - 1)
    at = np.cumsum(n) - n
    short = np.flatnonzero(n < WORDS)
    whole = np.zeros(len(short), np.uint64)
    for k in range(WORDS):
        more = n[short] > k
        whole[more] = mixed((whole[more] ^ h[at[short[more]] + k]) * _PRIME + np.uint64(k + 1))
    rows, values = np.concatenate([row[first], short]), np.concatenate([g, whole])
    order = np.lexsort((values, rows))
    rows, values = rows[order], values[order]
    new = np.ones(len(rows), bool)
    new[1:] = (rows[1:] != rows[:-1]) | (values[1:] != values[:-1])
    return values[new], np.searchsorted(rows[new], np.arange(len(offsets)))


def _set_ids(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each set."""
    sums = np.add.reduceat(mixed(values ^ _PRIME), at[:-1])
    return mixed(mixed(sums) + np.diff(at).astype(np.uint64)).view(np.int64)


def bands(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """One key per set and band, from the smallest of its hashes under ``ROWS`` random orders."""
    salts = np.random.default_rng(5).integers(0, 1 << 63, (BANDS * ROWS, 2), dtype=np.uint64)
    out = np.zeros((len(at) - 1, BANDS), np.uint64)
    for k, (add, times) in enumerate(salts):
        low = np.minimum.reduceat((values ^ add) * (times | np.uint64(1)), at[:-1])
        out[:, k // ROWS] = mixed((out[:, k // ROWS] ^ low) * _PRIME + np.uint64(k + 1))
    return out.view(np.int64)


def fingerprints(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """SimHash of each set: a bit is set if over half of its hashes have it."""
    h, half = mixed(values), np.diff(at)
    out = np.zeros(len(half), np.uint64)
    for k in range(64):
        ones = np.add.reduceat((h >> np.uint64(k)) & np.uint64(1), at[:-1]).astype(np.int64)
        out |= (2 * ones > half).astype(np.uint64) << np.uint64(k)
    return out.view(np.int64)


def _printed(batches):
    for b in sliced(batches):
        values, at = shingle_sets(b.column("text"))
        keys = pa.ListArray.from_arrays(pa.array(np.arange(b.num_rows + 1, dtype=np.int32) * BANDS), pa.array(bands(values, at).ravel()))
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("_text"), pa.array(_set_ids(values, at)), pa.array(np.diff(at)),
                                          pa.array(fingerprints(values, at)), keys], names=["doc_id", "_text", "set", "size", "fp", "bands"])


def linked_sets(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Component label (index of a member) of each set under links at a Jaccard similarity of 0.8 or more, counted exactly.

    A search over the sets not yet reached: each one is compared once with all that are left, through lists of the sets per shingle.
    """
    size = np.diff(at)
    label = np.arange(len(size))
    _, code = np.unique(values, return_inverse=True)
    owner = np.repeat(label, size)
    left, lists, held = len(size), None, 0
    reached = np.zeros(len(size), bool)
    for seed in range(len(size)):
        if reached[seed]:
            continue
        reached[seed] = True
        left -= 1
        queue = [seed]
        while queue and left:
            x = queue.pop()
            if lists is None or left < held // 2:
                open_ = np.flatnonzero(~reached[owner])
                open_ = open_[np.argsort(code[open_], kind="stable")]
                lists, first, held = owner[open_], np.searchsorted(code[open_], np.arange(code.max() + 2)), left
            c = code[at[x]:at[x + 1]]
            n = first[c + 1] - first[c]
            c, n = c[n > 0], n[n > 0]
            if not len(c):
                continue
            place = np.arange(int(n.sum())) + np.repeat(first[c] - (np.cumsum(n) - n), n)
            common = np.bincount(lists[place], minlength=len(size))
            near = np.flatnonzero((9 * common >= 4 * (size + size[x])) & (common > 0) & ~reached)
            reached[near] = True
            label[near] = seed
            left -= len(near)
            queue += near.tolist()
        if not left:
            break
    return label


def _linked(batches):
    """Stars (a, b) of the components inside each group; rows come sorted by group."""
    held, group = {}, None

    def stars():
        ids = np.array(list(held), np.int64)
        at = np.concatenate([[0], np.cumsum([len(v) for v in held.values()])])
        label = linked_sets(np.concatenate(list(held.values())), at)
        own = np.flatnonzero(label != np.arange(len(ids)))
        return pa.RecordBatch.from_arrays([pa.array(ids[label[own]]), pa.array(ids[own])], names=["a", "b"])

    for b in batches:
        for part in sliced([b]):
            values, at = shingle_sets(part.column("text"))
            keys = zip(*[part.column(c).to_pylist() for c in ("cluster", "i", "j", "set")])
            for k, (*key, own) in enumerate(keys):
                if key != group:
                    if len(held) > 1:
                        yield stars()
                    held, group = {}, key
                held[own] = values[at[k]:at[k + 1]]
    if len(held) > 1:
        yield stars()


def _clusters(sets: DataFrame) -> DataFrame:
    """(set, cluster): sets joined by linked fingerprints and shared bands, without those that have neither."""
    keys = sets.select("set", F.posexplode("bands").alias("band", "key"))
    shared = keys.groupBy("band", "key").agg(F.min("set").alias("a"), F.max("set").alias("_last")).filter("a < _last").drop("_last")
    banded = keys.join(shared, ["band", "key"]).filter("set <> a").select("a", F.col("set").alias("b"))
    edges = keep(banded.unionByName(_fingerprint_edges(sets)).distinct(), "candidate-edges")
    return _components(edges).withColumnRenamed("comp", "cluster")


def _fingerprint_edges(sets: DataFrame) -> DataFrame:
    """(a, b): sets of one fingerprint as stars, and their least sets where the Gray-order index links two fingerprints."""
    least = keep(sets.groupBy("fp").agg(F.min("set").alias("a")), "fingerprints")
    same = sets.select("set", "fp").join(least, "fp").filter("set <> a").select("a", F.col("set").alias("b"))
    found = simhash.links(least.select("fp")).withColumnsRenamed({"a": "fa", "b": "fb"})
    linked = found.join(least.select(F.col("fp").alias("fa"), "a"), "fa").join(least.select(F.col("fp").alias("fb"), F.col("a").alias("b")), "fb")
    return same.unionByName(linked.select("a", "b"))


def _components(edges: DataFrame) -> DataFrame:
    ends = edges.select(F.explode(F.array("a", "b")).alias("v")).distinct()
    g = F.lit(0).alias("g")
    return components(edges.select(g, "a", "b"), ends.select(g, "v")).select(F.col("v").alias("set"), "comp")


def links(docs: DataFrame, prints: DataFrame, block: int = BLOCK) -> DataFrame:
    """Edges (a, b) between sets whose components are those of all links. docs: (doc_id, text, _text); prints: as ``_printed``.

    One text stands for each set. ``block`` bounds the shingles of a block; a task holds two blocks.
    """
    spark = docs.sparkSession
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_text")).alias("first")
    sets = keep(prints.groupBy("set").agg(first, F.first("size").alias("size"), F.first("fp").alias("fp"), F.first("bands").alias("bands")), "shingle-sets")
    of = keep(sets.drop("fp", "bands").join(_clusters(sets), "set"), "shingle-clusters")
    parts = of.groupBy("cluster").agg(F.ceil(F.sum("size") / block).cast("int").alias("blocks"))
    of = of.join(parts, "cluster").withColumn("own", F.pmod(F.xxhash64("set"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    of = of.select("set", "cluster", "own", F.col("first.doc_id").alias("_id"), F.col("first._text").alias("_hash"), other) \
        .select("set", "cluster", "_id", "_hash", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
    same = docs["doc_id"].eqNullSafe(of["_id"]) & (docs["_text"] == of["_hash"])
    met = docs.select("doc_id", "_text", "text").join(of, same).select("cluster", "i", "j", "set", "text")
    return met.repartition(partitions(spark), "cluster", "i", "j").sortWithinPartitions("cluster", "i", "j") \
        .mapInArrow(_linked, "a bigint, b bigint")


def drop_near_copies(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """One document of each component of near copies in the columns of ``docs``: the smallest doc_id (null last), then the smallest
    hash of the text.

    Rows are told apart by id and text, so documents that share an id, or have none, do not stand for each other. Texts without
    words are copies of each other. Null and empty texts have no words, texts are read whole, an empty table gives an empty one, and
    input columns of any other name come back as they are.
    """
    own = unused(docs.columns, "_text")
    d = docs.withColumn(own, F.xxhash64("text"))
    texts = d.select("doc_id", F.col(own).alias("_text"), "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    prints = keep(texts.mapInArrow(_printed, f"doc_id {kind}, _text bigint, set bigint, size bigint, fp bigint, bands array<bigint>"), "shingle-prints")
    comp = _components(keep(links(texts, prints, block), "near-copies"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_text")).alias("first")
    keepers = prints.drop("fp", "bands").join(comp, "set", "left").groupBy(F.coalesce("comp", "set").alias("component")).agg(first) \
        .select(F.col("first.doc_id").alias("_id"), F.col("first._text").alias("_hash"))
    same = d["doc_id"].eqNullSafe(keepers["_id"]) & (d[own] == keepers["_hash"])
    return d.join(keepers, same, "left_semi").dropDuplicates(["doc_id", own]).drop(own)
