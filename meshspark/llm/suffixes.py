"""Exact removal of repeated byte strings with a sparse suffix array, sorted deep and shallow.

Every window of ``length`` bytes chooses an anchor, the smallest hash among its 64-byte grams; equal windows choose the same place, so
repeats can be found among the suffixes and reversed prefixes at anchors alone, about one per 170 bytes. Anchors whose
gram occurs once are dropped. The others carry a context, all windows that chose them; equal contexts are one class. Classes
with one gram meet in a task, which sorts their suffixes and their reversed prefixes: multikey quicksort down to a shallow
depth, then a blind trie for each group with a longer common prefix. Two contexts that agree for R bytes from the anchor
on and L bytes before it share exactly the windows that start between length - R and L bytes before it.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from meshspark.llm.shared import buffer_of, keep, mixed, partitions, query, read, row_key, sliced

LENGTH = 400
GRAM = 64
SHALLOW = 96
CLASSES_PER_TASK_GROUP = 20_000
_rng = np.random.default_rng(97)
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_ROW = "ra bigint, rb bigint, key bigint, ca bigint, cb bigint, pos bigint, low bigint, high bigint"


class Powers:
    """Powers of the hash base and of its inverse, grown on demand."""

    def __init__(self):
        self.up, self.down = np.ones(1, np.uint64), np.ones(1, np.uint64)

    def get(self, n: int):
        if len(self.up) < n:
            m = 1 << (n - 1).bit_length()
            self.up, self.down = [np.cumprod(np.append(np.uint64(1), np.full(m - 1, b, np.uint64)), dtype=np.uint64)
                                  for b in (_BASE, pow(_BASE, -1, 1 << 64))]
        return self.up[:n], self.down[:n]


def gram_hashes(data: np.ndarray, size: int, powers: Powers) -> np.ndarray:
    """Hash of every ``size``-byte string of the buffer, the same wherever it stands."""
    if len(data) < size:
        return np.zeros(0, np.uint64)
    up, down = powers.get(len(data))
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * up, out=total[1:])
    return mixed((total[size:] - total[:-size]) * down[:len(data) - size + 1])


def anchors(data: np.ndarray, offsets: np.ndarray, length: int, gram: int, powers: Powers):
    """(gram hash, anchor, first window, last window, row) for each maximal run of windows with one anchor; byte positions."""
    h = gram_hashes(data, gram, powers)
    width = length - gram + 1
    size = np.diff(offsets)
    valid = np.zeros(len(data) + 1, np.int32)
    long_ = size >= length
    valid[offsets[:-1][long_]] += 1
    valid[offsets[1:][long_] - length + 1] -= 1
    p = np.flatnonzero(np.cumsum(valid)[:-1])
    if not len(p):
        return (np.zeros(0, np.uint64), *[np.zeros(0, np.int64)] * 4)
    ranked = (h & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(h), dtype=np.uint64)  # ties go to the left
    grid = np.full(-(-len(h) // width) * width, ~np.uint64(0))
    grid[:len(h)] = ranked
    grid = grid.reshape(-1, width)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    back = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    at = (np.minimum(back[p], ahead[p + width - 1]) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    new = np.ones(len(p), bool)
    new[1:] = (at[1:] != at[:-1]) | (p[1:] != p[:-1] + 1)
    first = np.flatnonzero(new)
    low, high = p[first], p[np.append(first[1:], len(p)) - 1]
    return h[at[first]], at[first], low, high, np.searchsorted(offsets, low, side="right") - 1


def _anchor_rows(length: int, gram: int, with_context: bool):
    def run(batches):
        powers = Powers()
        for b in sliced(batches):
            data, offsets = buffer_of(b.column("text"))
            key, at, low, high, row = anchors(data, offsets, length, gram, powers)
            if not len(key):
                continue
            keys = pa.array(key.view(np.int64))
            if not with_context:
                yield pa.RecordBatch.from_arrays([keys], names=["key"])
                continue
            raw = data.tobytes()
            digest = b"".join(hashlib.blake2b(raw[x:y + length], digest_size=16, salt=(a - x).to_bytes(8, "little")).digest()
                              for a, x, y in zip(at.tolist(), low.tolist(), high.tolist()))
            c = np.frombuffer(digest, np.int64).reshape(-1, 2)
            base = offsets[row]
            owner = pa.array(row)
            yield pa.RecordBatch.from_arrays(
                [b.column("ra").take(owner), b.column("rb").take(owner), keys, pa.array(np.ascontiguousarray(c[:, 0])),
                 pa.array(np.ascontiguousarray(c[:, 1])), pa.array(at - base), pa.array(low - base), pa.array(high - base)],
                names=["ra", "rb", "key", "ca", "cb", "pos", "low", "high"])
    return run


def common_prefix(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    x = int.from_bytes(a[:n], "big") ^ int.from_bytes(b[:n], "big")
    return n - (x.bit_length() + 7) // 8


class _Node:
    __slots__ = ("depth", "children", "same")

    def __init__(self, depth, same=None):
        self.depth, self.children, self.same = depth, {}, same  # a leaf has the list of its equal strings


def _blind_order(strings: list[bytes], group: list[int]) -> list[int]:
    """Order by a blind trie: inner nodes keep only the depth at which strings part and their next bytes.

    A string goes down by its own bytes without comparing, meets some leaf, finds in one comparison how far it agrees with
    it, and splits the path there.
    """
    root = None
    step = lambda s, d: s[d] if d < len(s) else -1
    for i in group:
        s = strings[i]
        if root is None:
            root = _Node(len(s), [i])
            continue
        node = root
        while node.same is None:
            node = node.children.get(step(s, node.depth)) or next(iter(node.children.values()))
        other = strings[node.same[0]]
        n = common_prefix(s, other)
        if n == len(s) == len(other):
            node.same.append(i)
            continue
        up, node = None, root
        while node.same is None and node.depth <= n:
            if node.depth == n:
                break
            up, node = node, node.children[step(s, node.depth)]
        if node.same is None and node.depth == n:
            node.children[step(s, n)] = _Node(len(s), [i])
            continue
        fork = _Node(n)
        fork.children = {step(other, n): node, step(s, n): _Node(len(s), [i])}
        if up is None:
            root = fork
        else:
            up.children[step(s, up.depth)] = fork
    out, stack = [], [root]
    while stack:
        node = stack.pop()
        if node.same is not None:
            out += node.same
        else:
            stack += [node.children[c] for c in sorted(node.children, reverse=True)]
    return out


def deep_shallow(strings: list[bytes], shallow: int = SHALLOW) -> list[int]:
    """Sorted order: multikey quicksort on 8-byte characters to the shallow depth, blind tries for what still agrees there."""
    out: list[int] = []
    stack = [(list(range(len(strings))), 0)]
    while stack:
        group, depth = stack.pop()
        if len(group) < 2:
            out += group
        elif depth >= shallow:
            out += _blind_order(strings, group)
        else:
            char = {i: strings[i][depth:depth + 8] for i in group}
            pivot = sorted(char[i] for i in (group[0], group[len(group) // 2], group[-1]))[1]
            same = [i for i in group if char[i] == pivot]
            stack.append(([i for i in group if char[i] > pivot], depth))
            if len(pivot) < 8:  # the strings end here and are equal
                stack.append((same, shallow) if len(same) < 2 else (same, 1 << 30))
            else:
                stack.append((same, depth + 8))
            stack.append(([i for i in group if char[i] < pivot], depth))
    return out


def _agreements(strings: list[bytes]):
    """Sorted order, place of each string in it, and common prefixes of neighbours."""
    order = deep_shallow(strings)
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    lcp = np.array([0] + [common_prefix(strings[a], strings[b]) for a, b in zip(order, order[1:])], np.int64)
    return np.array(order), place, lcp


def _with_all(i: int, sorted_) -> np.ndarray:
    """Common prefix of string i with every other one: minima of neighbour values on the way."""
    order, place, lcp = sorted_
    at = place[i]
    out = np.zeros(len(order), np.int64)
    out[order[at + 1:]] = np.minimum.accumulate(lcp[at + 1:])
    out[order[:at]] = np.minimum.accumulate(lcp[at:0:-1])[::-1]
    return out


def shared_windows(contexts: list[bytes], before: list[int], length: int) -> list[list[tuple[int, int]]]:
    """Per context, the ranges of d (bytes from window start to anchor) whose window also occurs in another context."""
    right = _agreements([c[b:] for c, b in zip(contexts, before)])
    left = _agreements([c[:b][::-1] for c, b in zip(contexts, before)])
    out = []
    for i in range(len(contexts)):
        r, ell = _with_all(i, right), _with_all(i, left)
        ok = length - r <= ell
        ok[i] = False
        out.append(_merged(np.stack([length - r[ok], ell[ok] + 1], axis=1)))
    return out


def _merged(ranges: np.ndarray) -> list[tuple[int, int]]:
    """Union of half-open ranges; touching ranges become one."""
    if not len(ranges):
        return []
    ranges = ranges[np.argsort(ranges[:, 0], kind="stable")]
    top = np.maximum.accumulate(ranges[:, 1])
    first = np.flatnonzero(np.append(True, ranges[1:, 0] > top[:-1]))
    return list(zip(ranges[first, 0].tolist(), top[np.append(first[1:], len(ranges)) - 1].tolist()))


_RANGES = pa.list_(pa.struct([("from", pa.int64()), ("to", pa.int64())]))
_CLASS = "key bigint, ca bigint, cb bigint"


def _contexts(length: int):
    """Cut the contexts of the chosen anchors out of their texts."""
    def run(batches):
        for b in sliced(batches):
            out = []
            for text, wanted in zip(b.column("text").to_pylist(), b.column("wanted").to_pylist()):
                raw = (text or "").encode()
                out += [(w["key"], w["ca"], w["cb"], w["pos"] - w["low"], raw[w["low"]:w["high"] + length]) for w in wanted]
            if out:
                x = list(zip(*out))
                yield pa.RecordBatch.from_arrays([*[pa.array(c, pa.int64()) for c in x[:4]], pa.array(x[4], pa.binary())],
                                                 names=["key", "ca", "cb", "before", "context"])
    return run


def _solve(length: int):
    """Groups of one gram, streamed in key order."""
    def done(rows):
        spans = shared_windows([r["context"] for r in rows], [r["before"] for r in rows], length)
        return [{"key": r["key"], "ca": r["ca"], "cb": r["cb"], "spans": [{"from": a, "to": b} for a, b in s]} for r, s in zip(rows, spans) if s]

    schema = pa.schema([("key", pa.int64()), ("ca", pa.int64()), ("cb", pa.int64()), ("spans", _RANGES)])

    def run(batches):
        group = []
        for b in batches:
            out = []
            for r in b.to_pylist():
                if group and group[-1]["key"] != r["key"]:
                    out += done(group) if len(group) > 1 else []
                    group = []
                group.append(r)
            if out:
                yield pa.RecordBatch.from_pylist(out, schema)
        if len(group) > 1:
            yield pa.RecordBatch.from_pylist(done(group), schema)
    return run


def _window_hashes(length: int):
    """All windows of a context by two hashes, for grams with very many contexts."""
    def run(batches):
        powers = Powers()
        for b in batches:
            for r in b.to_pylist():
                data = np.frombuffer(r["context"], np.uint8)
                one = gram_hashes(data, length, powers)
                two = gram_hashes(data[::-1], length, powers)[::-1]
                d = r["before"] - np.arange(len(one))
                n = len(one)
                yield pa.RecordBatch.from_arrays([pa.array(one.view(np.int64)), pa.array(np.ascontiguousarray(two).view(np.int64)),
                                                  *[pa.array(np.full(n, r[c])) for c in ("key", "ca", "cb")], pa.array(d)],
                                                 names=["ha", "hb", "key", "ca", "cb", "d"])
    return run


def repeated(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, group_classes: int = CLASSES_PER_TASK_GROUP) -> DataFrame:
    """(ra, rb, spans array<struct<from, to>>): byte ranges of texts covered by repeated strings of ``length`` bytes.

    docs: (ra, rb, text), where the pair identifies a row's content; equal rows are separate places. Texts without repeats are left out.
    A gram with more than ``group_classes`` different contexts is not sorted in one task: its windows are compared by 128-bit
    hashes in a grouped count, which gives the same ranges.
    """
    spark = docs.sparkSession
    keys = docs.select("text").mapInArrow(_anchor_rows(length, gram, False), "key bigint").groupBy("key").count() \
        .filter("count > 1").select("key")
    rows = docs.mapInArrow(_anchor_rows(length, gram, True), _ROW)
    rows = keep(rows.join(keys, "key", "left_semi").select("ra", "rb", "key", "ca", "cb", "pos", "low", "high"), "anchors")
    classes = rows.groupBy("key", "ca", "cb").agg(F.count("*").alias("n"), F.min(F.struct("ra", "rb", "pos", "low", "high")).alias("rep"))
    classes = keep(classes, "anchor-classes")
    several = classes.groupBy("key").agg(F.count("*").alias("m")).filter("m > 1")
    copies = classes.filter("n > 1").select("key", "ca", "cb", F.array(F.struct(
        (F.col("rep.pos") - F.col("rep.high")).alias("from"), (F.col("rep.pos") - F.col("rep.low") + 1).alias("to"))).alias("spans"))
    wanted = classes.join(several, "key").groupBy("rep.ra", "rep.rb").agg(F.collect_list(
        F.struct("key", "ca", "cb", F.col("rep.pos").alias("pos"), F.col("rep.low").alias("low"), F.col("rep.high").alias("high"))).alias("wanted"))
    source = docs.join(wanted, ["ra", "rb"]).dropDuplicates(["ra", "rb"]).select("text", "wanted")
    contexts = keep(source.mapInArrow(_contexts(length), _CLASS + ", before bigint, context binary"), "contexts")
    large = several.filter(F.col("m") > group_classes).select("key")
    hot = contexts.join(large, "key", "left_semi")
    sorted_ = contexts.join(large, "key", "left_anti").repartition(partitions(spark), "key").sortWithinPartitions("key") \
        .mapInArrow(_solve(length), _CLASS + ", spans array<struct<from:bigint,to:bigint>>")
    windows = hot.mapInArrow(_window_hashes(length), "ha bigint, hb bigint, " + _CLASS + ", d bigint")
    twice = windows.groupBy("ha", "hb").count().filter("count > 1").select("ha", "hb")
    hashed = windows.join(twice, ["ha", "hb"], "left_semi").groupBy("key", "ca", "cb").agg(
        F.collect_list(F.struct(F.col("d").alias("from"), (F.col("d") + 1).alias("to"))).alias("spans"))
    found = copies.unionByName(sorted_).unionByName(hashed).select("key", "ca", "cb", F.explode("spans").alias("s"))
    places = rows.select("key", "ca", "cb", "ra", "rb", "pos").distinct()
    span = F.struct((F.col("pos") - F.col("s.to") + 1).alias("from"), (F.col("pos") - F.col("s.from") + length).alias("to"))
    return places.join(found, ["key", "ca", "cb"]).select("ra", "rb", span.alias("s")).groupBy("ra", "rb") \
        .agg(F.collect_set("s").alias("spans"))


def _without(batches):
    for b in sliced(batches):
        texts, removed, runs, sizes = [], [], [], []
        for text, spans in zip(b.column("text").to_pylist(), b.column("_spans").to_pylist()):
            raw = (text or "").encode()
            merged = _merged(np.array([(s["from"], s["to"]) for s in spans or []], np.int64).reshape(-1, 2))
            parts, at = [], 0
            for x, y in merged:
                parts.append(raw[at:x])
                at = y
            parts.append(raw[at:])
            texts.append(b"".join(parts))
            sizes.append(len(raw))
            removed.append(len(raw) - len(texts[-1]))
            runs.append([{"from": x, "to": y} for x, y in merged])
        names = [c for c in b.schema.names if c not in ("_spans", "text")]
        yield pa.RecordBatch.from_arrays([*[b.column(c) for c in names], pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()),
                                          pa.array(runs, _RANGES), pa.array(texts, pa.binary())],
                                         names=[*names, "n_bytes", "n_removed", "removed", "kept"])


def remove_repeats(docs: DataFrame, columns: list[str] | None = None, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """``columns`` (default doc_id) of every document plus n_bytes, n_removed, removed (ranges) and kept (bytes left).

    Removed is every byte covered by a string of ``length`` bytes that also starts anywhere else in any text, judged on the input.
    Cuts may fall inside a character, so what is left is bytes. Null and empty texts lose nothing; equal rows count as separate places,
    so long copies vanish altogether; an empty table gives an empty one; input columns of the new names are replaced.
    """
    columns = [c for c in (columns or ["doc_id"]) if c not in ("n_bytes", "n_removed", "removed", "kept", "text")]
    d = docs.select(*columns, "text").withColumn("_r", row_key("doc_id", "text")).withColumn("_ra", F.col("_r.a")).withColumn("_rb", F.col("_r.b"))
    spans = repeated(d.select(F.col("_ra").alias("ra"), F.col("_rb").alias("rb"), "text"), length, gram) \
        .select(F.col("ra").alias("_ra"), F.col("rb").alias("_rb"), F.col("spans").alias("_spans"))
    joined = d.drop("_r").join(spans, ["_ra", "_rb"], "left").select(*columns, "text", "_spans")
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in joined.schema if f.name in columns)
    return joined.mapInArrow(_without, kinds + ", n_bytes bigint, n_removed bigint, removed array<struct<from:bigint,to:bigint>>, kept binary")


@query("op6_suffix_dedup")
def op6_suffix_dedup(spark, sf_dir):
    out = remove_repeats(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_bytes", "n_removed", F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"),
                      F.make_valid_utf8(F.col("kept").cast("string")).alias("kept_text"))
