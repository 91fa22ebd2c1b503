import re

import numpy as np
import xxhash

from meshspark.llm import simhash
from meshspark.llm.shared import QUERIES


def plain_print(text):
    w = re.findall("[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    s = [" ".join(w[i:i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(prints):
    fps = np.array(list(prints.values()), np.uint64)
    ids = np.array(list(prints), np.int64)
    label = ids.copy()
    near = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 3
    while True:
        new = np.where(near, label[None, :], np.iinfo(np.int64).max).min(axis=1)
        if (new == label).all():
            return dict(zip(ids.tolist(), label.tolist()))
        label = new


def test_query_against_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in QUERIES["op7_simhash"](spark, sf).collect()}
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    prints = {i: plain_print(t) for i, t in docs.items()}
    comp = plain_components(prints)
    assert got == {i: (f"{prints[i]:016x}", comp[i]) for i in docs}


def test_links_of_dense_groups_and_splits(spark):
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    fps = [base]
    for _ in range(60):
        flips = np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 64, (40, 2)).astype(np.uint64), axis=1)
        fps.append(base ^ flips)
    fps.append(np.array([base[0] ^ np.uint64(x) for x in range(512)]))
    fps = np.unique(np.concatenate(fps))
    label = plain_components(dict(enumerate(fps)))
    df = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long")
    for rows in (20000, 25):
        edges = [(r.a, r.b) for r in simhash.links(df, group_rows=rows).collect()]
        at = {int(x): i for i, x in enumerate(fps.view(np.int64))}
        got = simhash._union(np.arange(len(fps)), np.array([at[a] for a, _ in edges]), np.array([at[b] for _, b in edges]))
        assert len(set(zip(got.tolist(), label.values()))) == len(set(label.values())) == len(set(got.tolist()))


def test_odd_rows(spark):
    rows = [(5, None, "a"), (3, "", "b"), (None, "x y z w", "c"), (8, "x  y\tz W", "d"), (8, "x  y\tz W", "d"), (9, "only", "e")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, component_id string")
    got = sorted([(r.doc_id or -1, r.component_id) for r in simhash.near_duplicates(docs).collect()])
    assert got == [(-1, 8), (3, 3), (5, 3), (8, 8), (8, 8), (9, 9)]
    assert sorted(r.doc_id for r in simhash.drop_near_duplicates(docs).collect()) == [3, 8, 9]
    shared = spark.createDataFrame([(None, "one two three four"), (None, "five six seven eight"), (4, "nine ten eleven"), (4, "twelve thirteen"), (4, "twelve thirteen")],
                                   "doc_id long, text string")
    assert simhash.drop_near_duplicates(shared).count() == 4
    assert simhash.near_duplicates(docs.limit(0)).count() == 0
