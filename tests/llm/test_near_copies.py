import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

import corpus_pipeline
from meshspark.llm import near_copies, simhash


def shingles(text):
    w = (text or "").split()
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)}


def plain_keepers(docs):
    """Smallest id of each component under brute-force Jaccard, and the number of links between different texts."""
    sets = {i: shingles(t.lower() if t else t) for i, t in docs.items()}
    held = {}
    for i, s in sets.items():
        for x in s:
            held.setdefault(x, []).append(i)
    root = {i: i for i in docs}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    n = 0
    for i in sorted(sets):
        common = {}
        for x in sets[i]:
            for j in held[x]:
                if j < i:
                    common[j] = common.get(j, 0) + 1
        for j, c in common.items():
            if 9 * c >= 4 * (len(sets[i]) + len(sets[j])):
                n += sets[i] != sets[j]
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i for i in docs if find(i) == i}, n


def test_stage_against_brute_force_jaccard(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    want, n = plain_keepers({r.doc_id: r.text for r in docs.collect()})
    assert n > 0
    assert {r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, sf).collect()} == want


def test_edited_copies_and_blocks(spark):
    rng = random.Random(4)
    texts = [[f"w{rng.randrange(5000)}" for _ in range(rng.randrange(60, 200))] for _ in range(40)]
    for k in range(200):  # up to a tenth of the words differ, so pairs lie on both sides of 0.8
        base = list(texts[0] if k < 80 else texts[k % 40])
        for _ in range(rng.randrange(1, max(2, len(base) // 40))):
            base[rng.randrange(len(base))] = f"x{rng.randrange(5000)}"
        texts.append(base)
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)] + [(900, None), (901, ""), (902, "one two"), (903, "One  two"), (904, "two one")]
    want, n = plain_keepers(dict(rows))
    assert n > 20
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for block in (near_copies.BLOCK, 1500):
        assert {r.doc_id for r in near_copies.drop_near_copies(docs, block).collect()} == want
    shared = spark.createDataFrame([(None, "one two three four"), (None, "five six seven eight"), (4, "nine ten"), (4, "twelve"), (4, "twelve")], docs.schema)
    assert near_copies.drop_near_copies(shared).count() == 4
    assert near_copies.drop_near_copies(docs.limit(0)).count() == 0


def test_columns_named_as_inner_ones_come_back(spark):
    rows = [(1, "a b c d e f", "x", 5), (2, "a b c d e f", "y", 6), (3, "other words stand in this text", None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _text string, __TEXT long")
    for out in (near_copies.drop_near_copies(docs), simhash.drop_near_duplicates(docs)):
        assert out.columns == docs.columns and sorted(map(tuple, out.collect()), key=lambda r: r[0]) == [rows[0], rows[2]]


def test_candidates_come_from_the_fingerprint_index(spark):
    # one word of 400 differs: the fingerprints link; no band at all is given, so nothing else can join the two
    words = [f"w{i}" for i in range(400)]
    texts = [" ".join(words), " ".join(words[:-1] + ["other"]), " ".join(f"v{i}" for i in range(400))]
    values, at = near_copies.shingle_sets(pa.array(texts))
    fp = near_copies.fingerprints(values, at)
    assert int(np.bitwise_count((fp[0] ^ fp[1]).view(np.uint64))) <= 3 < int(np.bitwise_count((fp[0] ^ fp[2]).view(np.uint64)))
    none = F.array().cast("array<bigint>").alias("bands")
    sets = spark.createDataFrame([(i, int(f)) for i, f in enumerate(fp)], "set long, fp long").select("set", "fp", none)
    got = {r["set"]: r.cluster for r in near_copies._clusters(sets).collect()}
    assert got == {0: 0, 1: 0}
