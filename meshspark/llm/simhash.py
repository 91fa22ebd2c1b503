"""SimHash near-duplicates through a Gray-order hierarchical index.

Distinct fingerprints meet in groups that share a block of bits: of four blocks, two fingerprints at three or fewer
differing bits share at least one. Groups that are too large are split by blocks of the remaining bits, and so on, until the
bits left bound their size. Inside a task, fingerprints stand in Gray order, so neighbours share most bits; runs of them form
nodes that hold the bits all members have in common, and runs of nodes form the levels above. Two nodes that differ in more than
three common bits have no link below them and are pruned as a whole, and so are two nodes already in one component.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from meshspark.llm.shared import keep, partitions, query, read, unused
from meshspark.operators.graph import components

SEED = 42
WORDS = 3
BITS = 3
FAN = 8
GROUP_ROWS = 20_000
CHUNK_ROWS = 200_000
PAIRS = 1_000_000


def _hashes(text: str, words: int, seed: int) -> np.ndarray:
    """XXH64 of every shingle of ASCII-lower-cased words."""
    import xxhash
    parts = text.encode().lower().split()
    if not parts:
        return np.zeros(0, np.uint64)
    joined = b" ".join(parts)
    if len(parts) < words:
        return np.array([xxhash.xxh64_intdigest(joined, seed)], np.uint64)
    ends, at = [], -1
    for p in parts:
        at += len(p) + 1
        ends.append(at)
    starts = [0] + [e + 1 for e in ends[:len(parts) - words]]
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[a:b], seed) for a, b in zip(starts, ends[words - 1:])], np.uint64)


def fingerprint_of(text: str, words: int = WORDS, seed: int = SEED) -> int:
    """A bit is set if over half the shingle hashes have it; 0 for a text without words."""
    h = _hashes(text, words, seed)
    if not len(h):
        return 0
    ones = np.zeros(64, np.int64)
    for at in range(0, len(h), 1 << 14):
        part = h[at:at + (1 << 14)].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view(np.uint64)[0])


def _fingerprints(words: int, seed: int):
    def run(batches):
        for b in batches:
            known = {}
            out = np.zeros(b.num_rows, np.uint64)
            for i, t in enumerate(b.column("text")):
                text = t.as_py() or ""
                if text not in known:
                    known[text] = fingerprint_of(text, words, seed)
                out[i] = known[text]
            names = [c for c in b.schema.names if c != "text"]
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in names], pa.array(out.view(np.int64))], names=[*names, "fp"])
    return run


def fingerprints(docs: DataFrame, columns: list[str], words: int = WORDS, seed: int = SEED) -> DataFrame:
    """``columns`` of docs plus ``fp``, the fingerprint as a signed long. Null texts count as empty. No shuffle."""
    d = docs.select(*columns, "text")
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in d.schema if f.name != "text")
    return d.mapInArrow(_fingerprints(words, seed), kinds + ", fp bigint")


def gray_rank(x: np.ndarray) -> np.ndarray:
    """Place of a bit pattern in the reflected Gray sequence."""
    for s in (1, 2, 4, 8, 16, 32):
        x = x ^ (x >> np.uint64(s))
    return x


def _chunks(choices: tuple[int, ...]) -> list[np.ndarray]:
    """The four blocks that the bits left by earlier choices are cut into."""
    left = np.arange(64)
    for c in choices:
        blocks = np.array_split(left, 4)
        left = np.concatenate([b for i, b in enumerate(blocks) if i != c])
    return np.array_split(left, 4)


def _split(level: int):
    """Four rows per fingerprint, one per block of the bits that its group does not yet share."""
    def run(batches):
        for b in batches:
            fp = np.asarray(b.column("fp")).view(np.uint64)
            path = np.asarray(b.column("path"))
            key = np.asarray(b.column("key"))
            out = []
            for p in np.unique(path):
                own = path == p
                choices = tuple(int(p) // 4 ** (level - 1 - i) % 4 for i in range(level))
                for c, bits in enumerate(_chunks(choices)):
                    value = np.zeros(int(own.sum()), np.int64)
                    for i, bit in enumerate(bits):
                        value |= ((fp[own] >> np.uint64(bit)) & np.uint64(1)).astype(np.int64) << i
                    out.append((fp[own], np.full(len(value), p * 4 + c, np.int64), (key[own] << len(bits)) | value))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([o[0] for o in out]).view(np.int64)),
                                                  *[pa.array(np.concatenate([o[i] for o in out])) for i in (1, 2)]],
                                                 names=["fp", "path", "key"])
    return run


def _roots(parent: np.ndarray) -> np.ndarray:
    while True:
        up = parent[parent]
        if np.array_equal(up, parent):
            return parent
        parent = up


def _union(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    while True:
        la, lb = label[a], label[b]
        differ = la != lb
        if not differ.any():
            return label
        a, b = a[differ], b[differ]
        parent = np.arange(len(label))
        np.minimum.at(parent, np.maximum(la, lb)[differ], np.minimum(la, lb)[differ])
        label = _roots(parent)[label]


class _Level:
    """Nodes of one level: first child, child count, and the bits that all members have in common."""

    def __init__(self, first, count, mask, bits, group):
        self.first, self.count, self.mask, self.bits, self.group = first, count, mask, bits, group


def build_index(fp: np.ndarray, group: np.ndarray) -> list[_Level]:
    """Levels from the fingerprints (sorted by group and Gray rank) up to one root per group."""
    n = len(fp)
    levels = [_Level(np.arange(n), np.zeros(n, np.int64), np.full(n, ~np.uint64(0)), fp, group)]
    while True:
        low = levels[-1]
        edge = np.ones(len(low.group), bool)
        edge[1:] = low.group[1:] != low.group[:-1]
        head = np.flatnonzero(edge)
        place = np.arange(len(low.group)) - np.repeat(head, np.diff(head, append=len(low.group)))
        first = np.flatnonzero(place % FAN == 0)
        ones = np.bitwise_and.reduceat(low.bits & low.mask, first)
        zeros = np.bitwise_and.reduceat(~low.bits & low.mask, first)
        levels.append(_Level(first, np.diff(first, append=len(low.group)), ones | zeros, ones, low.group[first]))
        if len(first) == len(head):
            return levels


def linked_labels(fp: np.ndarray, group: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Component label (index of a member) of each fingerprint under links inside groups, by search over pairs of nodes."""
    label = np.arange(len(fp))
    if len(fp) < 2:
        return label
    levels = build_index(fp, group)
    top = len(levels) - 1
    roots = np.arange(len(levels[top].first))
    stack = [(top, roots, roots)]
    while stack:
        depth, a, b = stack.pop()
        if len(a) > PAIRS:
            for at in reversed(range(0, len(a), PAIRS)):
                stack.append((depth, a[at:at + PAIRS], b[at:at + PAIRS]))
            continue
        one = _colour(levels, label, depth)
        open_ = (one[a] < 0) | (one[a] != one[b])
        a, b = a[open_], b[open_]
        if depth == 0:
            label = _union(label, a, b)
            continue
        node, low = levels[depth], levels[depth - 1]
        na, nb = node.count[a], node.count[b]
        total = na * nb
        for part in np.array_split(np.arange(len(a)), max(1, int(total.sum()) // PAIRS + 1)):
            if not len(part):
                continue
            width = total[part]
            at = np.arange(int(width.sum())) - np.repeat(np.cumsum(width) - width, width)
            across = np.repeat(nb[part], width)
            x = np.repeat(node.first[a[part]], width) + at // across
            y = np.repeat(node.first[b[part]], width) + at % across
            ok = (x < y) if depth == 1 else (x <= y)
            x, y = x[ok], y[ok]
            apart = np.bitwise_count((low.bits[x] ^ low.bits[y]) & low.mask[x] & low.mask[y])
            near = apart <= bits
            x, y = x[near], y[near]
            if depth == 1:
                label = _union(label, x, y)
            elif len(x):
                nearest_first = np.argsort(y - x, kind="stable")
                stack.append((depth - 1, x[nearest_first], y[nearest_first]))
    return label


def _colour(levels, label, depth) -> np.ndarray:
    """Per node the label that all its members have, or -1."""
    low = high = label
    for lev in levels[1:depth + 1]:
        low, high = np.minimum.reduceat(low, lev.first), np.maximum.reduceat(high, lev.first)
    return np.where(low == high, low, -1)


def _search(bits: int):
    """Links of whole groups, as stars of local components; batches of a partition are cut at group borders."""
    def links(key, fp):
        _, group = np.unique(key, return_inverse=True)
        order = np.lexsort((gray_rank(fp), group))
        fp, group = fp[order], group[order]
        label = linked_labels(fp, group, bits)
        own = np.flatnonzero(label != np.arange(len(fp)))
        return pa.RecordBatch.from_arrays([pa.array(fp[label[own]].view(np.int64)), pa.array(fp[own].view(np.int64))], names=["a", "b"])

    def run(batches):
        held_key, held_fp = [], []
        size = 0
        for b in batches:
            held_key.append(np.stack([np.asarray(b.column("path")), np.asarray(b.column("key"))], axis=1))
            held_fp.append(np.asarray(b.column("fp")).view(np.uint64))
            size += b.num_rows
            if size < CHUNK_ROWS:
                continue
            key, fp = np.concatenate(held_key), np.concatenate(held_fp)
            last = np.flatnonzero((key[:-1] != key[1:]).any(axis=1))
            cut = int(last[-1]) + 1 if len(last) else 0
            if cut:
                yield links(_ids(key[:cut]), fp[:cut])
            held_key, held_fp, size = [key[cut:]], [fp[cut:]], len(fp) - cut
        if size:
            yield links(_ids(np.concatenate(held_key)), np.concatenate(held_fp))
    return run


def _ids(key: np.ndarray) -> np.ndarray:
    """Numbers of the runs of equal rows."""
    change = np.zeros(len(key), np.int64)
    change[1:] = (key[1:] != key[:-1]).any(axis=1)
    return np.cumsum(change)


def links(distinct: DataFrame, bits: int = BITS, group_rows: int = GROUP_ROWS) -> DataFrame:
    """Edges (a, b) between distinct fingerprints whose components are those of all links at ``bits`` (at most 3) differing bits.

    distinct: (fp) without repeats. Groups above ``group_rows`` are split again: at five splits at most 2**15 different fingerprints
    can share the other bits, so every group fits one task whatever the input.
    """
    if not 0 <= bits <= 3:
        raise ValueError("four blocks find links at 3 or fewer differing bits")
    spark = distinct.sparkSession
    current = distinct.select("fp", F.lit(0).cast("long").alias("path"), F.lit(0).cast("long").alias("key"))
    found, level = None, 0
    while True:
        rows = keep(current.mapInArrow(_split(level), "fp bigint, path bigint, key bigint"), "fingerprint-groups")
        level += 1
        large = rows.groupBy("path", "key").count().filter(F.col("count") > group_rows).select("path", "key")
        hot = level < 5 and not large.isEmpty()
        small = rows.join(large, ["path", "key"], "left_anti") if hot else rows
        edges = small.repartition(partitions(spark), "path", "key").sortWithinPartitions("path", "key") \
            .mapInArrow(_search(bits), "a bigint, b bigint")
        found = edges if found is None else found.unionByName(edges)
        if not hot:
            return found.distinct()
        current = rows.join(large, ["path", "key"], "left_semi")


def near_duplicates(docs: DataFrame, columns: list[str] | None = None, words: int = WORDS, bits: int = BITS, seed: int = SEED) -> DataFrame:
    """``columns`` (default doc_id) of every document plus fp, component (smallest fp that links reach) and component_id, the
    smallest doc_id in it.

    Texts without words have fingerprint 0 and link like any other; null ids do not count as smallest, and a component of null ids
    has a null component_id; equal rows each stay; an empty table gives an empty one. Copies share a fingerprint and meet in one
    row before any pairing. Input columns of the three names are replaced.
    """
    columns = [c for c in (columns or ["doc_id"]) if c not in ("fp", "component", "component_id")]
    prints = keep(fingerprints(docs, columns, words, seed), "fingerprints")
    distinct = prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
    g = F.lit(0).alias("g")
    edges = links(distinct.select("fp"), bits).select(g, "a", "b")
    comp = components(edges, distinct.select(g, F.col("fp").alias("v"))).select(F.col("v").alias("fp"), F.col("comp").alias("component"))
    of = keep(distinct.join(comp, "fp"), "fingerprint-components")
    least = of.groupBy("component").agg(F.min("least").alias("component_id"))
    return prints.join(of.join(least, "component").select("fp", "component", "component_id"), "fp") \
        .select(*columns, "fp", "component", "component_id")


def drop_near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """One document of each component in the columns of ``docs``: the smallest doc_id (null last), then the smallest hash of the text.

    Rows are told apart by id and text, so documents that share an id, or have none, do not stand for each other. Null and
    empty texts share the fingerprint zero, texts are read whole, an empty table gives an empty one, and input columns of any other
    name come back as they are.
    """
    own = unused(docs.columns, "_text")
    d = docs.withColumn(own, F.xxhash64("text"))
    found = near_duplicates(d.select("doc_id", "text", F.col(own).alias("_text")), ["doc_id", "_text"], **options)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_text")).alias("first")
    keepers = found.groupBy("component").agg(first).select(F.col("first.doc_id").alias("_id"), F.col("first._text").alias("_hash"))
    same = d["doc_id"].eqNullSafe(keepers["_id"]) & (d[own] == keepers["_hash"])
    return d.join(keepers, same, "left_semi").dropDuplicates(["doc_id", own]).drop(own)


@query("op7_simhash")
def op7_simhash(spark, sf_dir):
    found = near_duplicates(read(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
