"""Phrase collocations from a weighted de Bruijn graph of words.

Nodes are runs of n - 1 words, edges runs of n words between overlapping nodes. A block of texts builds its own graph: every word starts
one edge, cut short where its piece ends. Only distinct edges with their weights come from the text; the weight of a
shorter run is the flow out of it, that is the edges that go on from it plus the ends of pieces in it. Weights add up over blocks, so blocks
send packed rows by hash bucket and a bucket adds them up; no run is sent by one block twice, however often it occurs.
In the graph of frequent edges, nodes whose whole flow comes in by one edge and leaves by one edge are compacted into
paths; all runs inside a path have its weight, and only the outer nodes of a path need a weight of their own.
"""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from meshspark.llm.shared import LOWER, buffer_of, distinct_words, keep, mixed, partitions, query, read, sliced, words_of
from meshspark.operators import ordinals

BLOCK_WORDS = 1_500_000
BUCKETS_PER_PARTITION = 2
STRETCH = 512
SEEDS = 4

# What ends a piece, what parts words.
ENDS = np.zeros(256, bool)
ENDS[[ord(c) for c in ".,;:!?\n\x0b\x0c\r"]] = True
BREAKS = ENDS.copy()
BREAKS[[0x20, 0x09]] = True

WORDS, NODES, EDGES = 1, 2, 3
_BLOCK = pa.schema([("bucket", pa.int32()), ("kind", pa.int32()), ("packed", pa.binary())])


def _factorized(*columns: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Class of every row of the columns and the distinct rows, by their values."""
    import pandas as pd
    code, values = pd.factorize(columns[0])
    parts = [values]
    for c in columns[1:]:
        part, v = pd.factorize(c)
        code, both = pd.factorize(code * max(1, len(v)) + part)
        old, new = np.divmod(both, max(1, len(v)))
        parts = [p[old] for p in parts] + [v[new]]
    return code, parts


def block_graph(word: np.ndarray, goes_on: np.ndarray, n: int):
    """(columns of word numbers, weights) of all runs of n, n - 1, ... 1 words.

    ``goes_on[i]``: word i + 1 follows word i in the same piece. Edges are counted; all shorter runs get their flow.
    """
    size = len(word)
    base = int(word.max()) + 2 if size else 2
    columns, alive = [word.astype(np.int32) + np.int32(1)], np.ones(size, bool)  # 0: the piece has ended
    for k in range(1, n):
        gap = min(k, size)
        alive[:size - gap] &= goes_on[k - 1:size - gap + k - 1]
        alive[size - gap:] = False
        columns.append(np.where(alive, np.append(columns[0][gap:], np.zeros(gap, np.int32)), np.int32(0)))
    if base ** n < 1 << 64:
        key = columns[0].astype(np.uint64)
        for c in columns[1:]:
            key *= np.uint64(base)
            key += c.astype(np.uint64)
        del columns, alive
        key, weight = np.unique(key, return_counts=True)
        edges = []
        for _ in range(n):
            edges.append((key % np.uint64(base)).astype(np.int32))
            key //= np.uint64(base)
        edges = edges[::-1]
    else:
        order = np.lexsort(columns[::-1])
        edges = [c[order] for c in columns]
        first = np.flatnonzero(np.append(True, np.any([c[1:] != c[:-1] for c in edges], axis=0)))
        edges, weight = [c[first] for c in edges], np.diff(first, append=size)
    for k in range(n, 0, -1):
        whole = np.flatnonzero(edges[k - 1])
        yield [c[whole] - np.int32(1) for c in edges[:k]], weight[whole]
        if k > 1:  # the flow of a node is the weight of all edges that leave it, those that end in it included; they are neighbours
            new = np.flatnonzero(np.append(True, np.any([c[1:] != c[:-1] for c in edges[:k - 1]], axis=0)))
            edges, weight = [c[new] for c in edges[:k - 1]], np.add.reduceat(weight, new)


def _planes(values: np.ndarray) -> bytes:
    """Bytes of equal weight together: small numbers compress to little."""
    v = np.ascontiguousarray(values)
    return np.ascontiguousarray(v.view(np.uint8).reshape(len(v), -1).T).tobytes()


def _unplanes(raw: bytes, at: int, n: int, kind) -> tuple[np.ndarray, int]:
    width = np.dtype(kind).itemsize
    planes = np.frombuffer(raw, np.uint8, n * width, at).reshape(width, n)
    return np.ascontiguousarray(planes.T).view(kind).reshape(-1), at + n * width


def _pack(columns: list[np.ndarray], weight: np.ndarray, hashes: np.ndarray, tool) -> bytes:
    """Sorted runs over the list of their words' hashes."""
    words, local = np.unique(np.concatenate(columns), return_inverse=True)
    first = np.diff(local[:len(weight)], prepend=0).astype("<u4")
    rest = local[len(weight):].astype("<u4")
    raw = struct.pack("<qqq", len(columns), len(weight), len(words)) + hashes[words].tobytes() + _planes(first) + _planes(rest) \
        + _planes(weight.astype("<i8"))
    return tool.compress(raw)


def _unpack(blob: bytes, tool) -> tuple[list[np.ndarray], np.ndarray]:
    raw = tool.decompress(blob)
    k, n, m = struct.unpack("<qqq", raw[:24])
    words = np.frombuffer(raw, np.int64, m, 24)
    first, at = _unplanes(raw, 24 + 8 * m, n, "<u4")
    rest, at = _unplanes(raw, at, n * (k - 1), "<u4")
    weight, _ = _unplanes(raw, at, n, "<i8")
    return [words[np.cumsum(first.astype(np.int64))], *words[rest].reshape(k - 1, n)], weight


def _pack_words(hashes, checks, weight, items: list[bytes], langs: list[bytes], tool) -> bytes:
    sizes = np.array([len(x) for x in items + langs], "<u4")
    return tool.compress(struct.pack("<q", len(items)) + hashes.tobytes() + checks.tobytes() + _planes(weight.astype("<i8"))
                         + _planes(sizes) + b"".join(items) + b"".join(langs))


def _unpack_words(blob: bytes, tool):
    raw = tool.decompress(blob)
    n = struct.unpack("<q", raw[:8])[0]
    hashes, checks = np.frombuffer(raw, np.int64, n, 8), np.frombuffer(raw, np.int64, n, 8 + 8 * n)
    weight, at = _unplanes(raw, 8 + 16 * n, n, "<i8")
    sizes, at = _unplanes(raw, at, 2 * n, "<u4")
    ends = np.cumsum(sizes.astype(np.int64)) + at
    return hashes, checks, weight, raw, ends - sizes, ends


def _bucket_rows(keys: np.ndarray, buckets: int):
    """Row numbers of each bucket that has rows."""
    bucket = (keys % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    edges = np.flatnonzero(np.diff(bucket[order], prepend=-1))
    return [(int(bucket[order[a]]), order[a:b]) for a, b in zip(edges, [*edges[1:], len(order)])]


class _Block:
    """Words of one block of texts by number: their hashes, languages and bytes, and the block as a sequence of numbers."""

    def __init__(self, seed: int):
        self.seed, self.known, self.items, self.digests = seed, {}, [], bytearray()
        self.numbers, self.goes_on, self.count = [], [], 0

    def add(self, data, offsets, langs: list[str]):
        import xxhash
        starts, ends, row = words_of(data, offsets, BREAKS)
        if not len(starts):
            return
        seps = np.cumsum(ENDS[data])[starts]
        self.goes_on.append(np.append((row[1:] == row[:-1]) & (seps[1:] == seps[:-1]), False))
        word, first = distinct_words(data, starts, ends)
        names: dict[str, int] = {}
        lang = np.array([names.setdefault(x, len(names)) for x in langs], np.int64)[row]
        local, (of_word, of_lang) = _factorized(word, lang)
        tags = [x.encode() for x in names]
        number = np.empty(len(of_word), np.int32)
        for i, (a, b, g) in enumerate(zip(starts[first][of_word].tolist(), ends[first][of_word].tolist(), of_lang.tolist())):
            item = (tags[g], data[a:b].tobytes())
            n = self.known.get(item)
            if n is None:
                n = self.known[item] = len(self.items)
                self.items.append(item)
                self.digests += xxhash.xxh3_128_digest(item[0] + b"\x00" + item[1], self.seed)
            number[i] = n
        self.numbers.append(number[local])
        self.count += len(local)

    def packed(self, n: int, buckets: int):
        """Rows (bucket, kind, packed)."""
        import zstandard
        tool = zstandard.ZstdCompressor(level=3)
        pair = np.frombuffer(bytes(self.digests), np.int64).reshape(-1, 2)
        hashes, checks = np.ascontiguousarray(pair[:, 0]), np.ascontiguousarray(pair[:, 1])
        self.known = {}
        word, goes_on = np.concatenate(self.numbers), np.concatenate(self.goes_on)
        self.numbers, self.goes_on = [], []
        for columns, weight in block_graph(word, goes_on, n):
            key = np.zeros(len(weight), np.uint64)
            for c in columns:
                key = mixed(key * np.uint64(0x9E3779B97F4A7C15) + hashes[c].view(np.uint64))
            for bucket, rows in _bucket_rows(key, buckets):
                if len(columns) == 1:
                    at = columns[0][rows]
                    blob = _pack_words(hashes[at], checks[at], weight[rows], [self.items[i][1] for i in at], [self.items[i][0] for i in at], tool)
                else:
                    blob = _pack([c[rows] for c in columns], weight[rows], hashes, tool)
                yield bucket, len(columns), blob


def _blocks(n: int, buckets: int, seed: int):
    def batch(rows):
        b, k, p = zip(*rows)
        return pa.RecordBatch.from_arrays([pa.array(b, pa.int32()), pa.array(k, pa.int32()), pa.array(p, pa.binary())], schema=_BLOCK)

    def sent(block):
        rows, size = [], 0
        for r in block.packed(n, buckets):
            rows.append(r)
            size += len(r[2])
            if size > 4 << 20:
                yield batch(rows)
                rows, size = [], 0
        if rows:
            yield batch(rows)

    def run(batches):
        block = _Block(seed)
        for b in sliced(batches):
            data, offsets = buffer_of(b.column("text"))
            block.add(LOWER[data], offsets, b.column("lang").to_pylist())
            if block.count >= BLOCK_WORDS:
                yield from sent(block)
                block = _Block(seed)
        if block.count:
            yield from sent(block)
    return run


_RUN = pa.schema([("kind", pa.int32()), ("h1", pa.int64()), ("h2", pa.int64()), ("h3", pa.int64()), ("n", pa.int64()),
                  ("word", pa.string()), ("lang", pa.string()), ("clash", pa.bool_())])


def _added(least: int):
    """Weights of all blocks together; a bucket holds one kind at a time. Runs below ``least`` end here."""
    def words(blobs, tool):
        parts = [_unpack_words(b, tool) for b in blobs]
        hashes, checks, weight = (np.concatenate([p[i] for p in parts]) for i in range(3))
        code, (distinct,) = _factorized(hashes)
        total = np.bincount(code, weights=weight, minlength=len(distinct)).astype(np.int64)
        first = np.empty(len(distinct), np.int64)
        first[code[::-1]] = np.arange(len(code))[::-1]
        clash = bool((checks != checks[first[code]]).any())
        which = np.repeat(np.arange(len(parts)), [len(p[0]) for p in parts])
        inside = np.concatenate([np.arange(len(p[0])) for p in parts])

        def text(i, langs):
            p = parts[which[i]]
            j = inside[i] + (len(p[0]) if langs else 0)
            return p[3][p[4][j]:p[5][j]].decode()

        keep_ = np.flatnonzero(total >= least)
        tags = [text(i, True) for i in first]
        sums: dict[str, int] = {}
        for t, w in zip(tags, total.tolist()):
            sums[t] = sums.get(t, 0) + w
        n = len(keep_)
        none = pa.nulls(n, pa.int64())
        yield [pa.array(np.full(n, WORDS), pa.int32()), pa.array(distinct[keep_]), none, none, pa.array(total[keep_]),
               pa.array([text(first[i], False) for i in keep_], pa.string()), pa.array([tags[i] for i in keep_], pa.string()),
               pa.array(np.full(n, clash))]
        m = len(sums)
        none = pa.nulls(m, pa.int64())
        yield [pa.array(np.zeros(m), pa.int32()), none, none, none, pa.array(list(sums.values()), pa.int64()), pa.nulls(m, pa.string()),
               pa.array(list(sums), pa.string()), pa.array(np.full(m, clash))]

    def runs(kind, blobs, tool):
        parts = [_unpack(b, tool) for b in blobs]
        code, columns = _factorized(*[np.concatenate([p[0][i] for p in parts]) for i in range(kind)])
        total = np.bincount(code, weights=np.concatenate([p[1] for p in parts]), minlength=len(columns[0])).astype(np.int64)
        rows = np.flatnonzero(total >= least)
        n = len(rows)
        filled = [pa.array(c[rows]) for c in columns] + [pa.nulls(n, pa.int64())] * (3 - kind)
        yield [pa.array(np.full(n, kind), pa.int32()), *filled, pa.array(total[rows]), pa.nulls(n, pa.string()), pa.nulls(n, pa.string()),
               pa.array(np.zeros(n, bool))]

    def run(batches):
        import zstandard
        tool = zstandard.ZstdDecompressor()
        group, blobs = None, []

        def done():
            for columns in words(blobs, tool) if group[1] == WORDS else runs(group[1], blobs, tool):
                if len(columns[0]):
                    yield pa.RecordBatch.from_arrays(columns, schema=_RUN)

        for b in batches:
            for bucket, kind, packed in zip(*(b.column(c).to_pylist() for c in ("bucket", "kind", "packed"))):
                if group is not None and group != (bucket, kind):
                    yield from done()
                    blobs = []
                group = (bucket, kind)
                blobs.append(packed)
        if group is not None:
            yield from done()
    return run


def frequent_runs(docs: DataFrame, least: int = 10) -> DataFrame:
    """(kind, h1, h2, h3, n, word, lang): runs of kind = 1, 2 or 3 words (as word hashes) that occur ``least`` times or more.

    Kind 1 carries the word and its language; kind 0 rows add up to the word occurrences of a language. Words are told apart by 64 bits;
    another 64 bits are compared, and should two words ever meet, the texts are read again with another seed.
    """
    spark = docs.sparkSession
    source = docs.select("text", F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"))
    buckets = partitions(spark) * BUCKETS_PER_PARTITION
    for seed in range(SEEDS):
        sent = source.mapInArrow(_blocks(3, buckets, seed), "bucket int, kind int, packed binary")
        runs = sent.repartition(partitions(spark), "bucket").sortWithinPartitions("bucket", "kind").mapInArrow(
            _added(least), "kind int, h1 bigint, h2 bigint, h3 bigint, n bigint, word string, lang string, clash boolean")
        runs = keep(runs, "frequent-runs")
        if runs.filter("clash").isEmpty():
            return runs.drop("clash")
    raise RuntimeError(f"word hashes met with {SEEDS} seeds")


def compact(runs: DataFrame) -> DataFrame:
    """(words array<bigint>, weight, first, last): paths of frequent edges in stretches of at most ``STRETCH`` edges.

    An edge leads to the next one where the node between them has no other flow. Pointers along these links double
    their reach in each round; pieces end, so paths do, and the rounds are the logarithm of the longest piece that recurs. ``first``
    and ``last`` are the weights of the outer nodes.
    """
    nodes = runs.filter(F.col("kind") == NODES)
    edges = runs.filter(F.col("kind") == EDGES).select("h1", "h2", "h3", F.col("n").alias("weight"))
    tails = nodes.select("h1", "h2", F.col("n").alias("first"))
    heads = nodes.select(F.col("h1").alias("h2"), F.col("h2").alias("h3"), F.col("n").alias("last"))
    edges = keep(edges.join(tails, ["h1", "h2"]).join(heads, ["h2", "h3"]), "graph-edges")
    to = edges.filter("weight = first").select(F.col("h1").alias("h2"), F.col("h2").alias("h3"), F.struct("h1", "h2", "h3").alias("next"))
    links = edges.filter("weight = last").join(to, ["h2", "h3"]) \
        .select(F.struct("h1", "h2", "h3").alias("edge"), "next", F.lit(1).cast("long").alias("steps"))
    links = keep(links, "graph-links")
    while True:
        ahead = links.select(F.col("edge").alias("next"), F.col("next").alias("far"), F.col("steps").alias("more"))
        doubled = links.join(ahead, "next", "left").select(
            "edge", F.coalesce("far", "next").alias("next"), (F.col("steps") + F.coalesce("more", F.lit(0))).alias("steps"),
            F.col("far").isNotNull().alias("moved"))
        doubled = keep(doubled, "graph-links")
        links = doubled.drop("moved")
        if doubled.filter("moved").isEmpty():
            break
    on_path = edges.withColumn("edge", F.struct("h1", "h2", "h3")).join(links, "edge", "left") \
        .withColumn("end", F.coalesce("next", "edge")).withColumn("back", F.coalesce("steps", F.lit(0)))
    item = F.struct((-F.col("back")).alias("at"), "h1", "h2", "h3", "weight", "first", "last")
    stretch = F.floor(F.col("back") / STRETCH).alias("stretch")
    paths = on_path.groupBy("end", stretch).agg(F.array_sort(F.collect_list(item)).alias("e"))
    words = F.concat(F.col("e.h1"), F.array(F.element_at("e", -1).h2, F.element_at("e", -1).h3))
    return paths.select(words.alias("words"), F.element_at("e", 1).weight.alias("weight"),
                        F.element_at("e", 1)["first"].alias("first"), F.element_at("e", -1)["last"].alias("last"))


def _exact_score(a: str, left: str, right: str):
    """floor(1000000 a a / (left right)) in decimals of 38 digits: exact for counts of up to 15 digits."""
    whole = lambda c: f"cast({c} as decimal(15,0))"
    return F.expr(f"cast(1000000 as decimal(7,0)) * ({whole(a)} * {whole(a)}) div ({whole(left)} * {whole(right)})")


def collocations(docs: DataFrame, least: int = 10, inside: int = 50, top: int = 2000) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the best phrases of two or three words of each language.

    docs: (text, lang; other columns are ignored). Null texts have no words, null languages are ``und``; repeated rows count again; a
    language without a phrase that occurs ``least`` times has no rows; an empty table gives an empty one; ranks break
    ties by weight and phrase. Dropped is a phrase inside a longer one that has ``inside`` percent of its occurrences.
    """
    runs = frequent_runs(docs, least)
    paths = keep(compact(runs), "graph-paths")
    at = F.explode(F.sequence(F.lit(0), F.size("words") - 3))
    triples = paths.select("*", at.alias("i")).select(
        *[F.get("words", F.col("i") + k).alias(f"h{k + 1}") for k in range(3)], F.col("weight").alias("a"),
        F.when(F.col("i") == 0, F.col("first")).otherwise(F.col("weight")).alias("left2"),
        F.when(F.col("i") == F.size("words") - 3, F.col("last")).otherwise(F.col("weight")).alias("right2"))
    around = paths.select("weight", F.explode(F.sequence(F.lit(0), F.size("words") - 2)).alias("i"), "words") \
        .groupBy(F.get("words", F.col("i")).alias("h1"), F.get("words", F.col("i") + 1).alias("h2")).agg(F.max("weight").alias("longer"))
    pairs = runs.filter(F.col("kind") == NODES).select("h1", "h2", F.col("n").alias("a")).join(around, ["h1", "h2"], "left") \
        .filter(F.coalesce(100 * F.col("longer") < inside * F.col("a"), F.lit(True)))
    none = F.lit(None).cast("bigint")
    wanted = pairs.select("h1", "h2", none.alias("h3"), F.col("h2").alias("h_last"), "a", none.alias("left2"), none.alias("right2")) \
        .unionByName(triples.withColumn("h_last", F.col("h3")))
    words = runs.filter(F.col("kind") == WORDS).select("h1", "n", "word", "lang")
    spread = ["h1", "h2", "h3"]
    named = ordinals.attach(wanted, words.select("h1", F.col("n").alias("left1"), F.col("word").alias("w1"), "lang"), ["h1"], spread)
    named = ordinals.attach(named, words.select(F.col("h1").alias("h_last"), F.col("n").alias("right1"), F.col("word").alias("w_last")), ["h_last"], spread)
    two, three = named.filter("h3 is null"), named.filter("h3 is not null")
    three = ordinals.attach(three, words.select(F.col("h1").alias("h2"), F.col("word").alias("w2")), ["h2"], spread)
    two = two.select("lang", F.concat_ws(" ", "w1", "w_last").alias("phrase"), "a", F.array(
        F.struct(_exact_score("a", "left1", "right1").alias("score"), F.lit(1).alias("k"), F.col("left1").alias("l"), F.col("right1").alias("r"))).alias("cuts"))
    three = three.select("lang", F.concat_ws(" ", "w1", "w2", "w_last").alias("phrase"), "a", F.array(
        F.struct(_exact_score("a", "left1", "right2").alias("score"), F.lit(1).alias("k"), F.col("left1").alias("l"), F.col("right2").alias("r")),
        F.struct(_exact_score("a", "left2", "right1").alias("score"), F.lit(2).alias("k"), F.col("left2").alias("l"), F.col("right1").alias("r"))).alias("cuts"))
    scored = two.unionByName(three).select("lang", "phrase", "a", F.array_min("cuts").alias("cut")) \
        .select("lang", "phrase", "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), F.col("cut.score").alias("score"))
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    part = F.pmod(F.xxhash64("phrase"), F.lit(256))
    best = scored.withColumn("_part", part) \
        .withColumn("rank", F.row_number().over(Window.partitionBy("lang", "_part").orderBy(*order))).filter(F.col("rank") <= top)
    best = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).filter(F.col("rank") <= top)
    sizes = runs.filter("kind = 0").groupBy("lang").agg(F.sum("n").alias("n"))
    return best.join(sizes, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


@query("op13_collocations")
def op13_collocations(spark, sf_dir):
    return collocations(read(spark, sf_dir, "documents"))
