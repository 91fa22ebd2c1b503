import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from meshspark.llm import resampling
from meshspark.llm.shared import QUERIES

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain_features(text):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    return w + [f"{a} {b}" for a, b in zip(w, w[1:])]


def plain(docs, target, percent=25, least=20, buckets=10000):
    """Brute force: rows (doc_id, n_features, weight, score, rank) of (doc_id, text) pairs."""
    code = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = (Counter(code(f) for x in texts for f in plain_features(x)) for texts in ([x for _, x in docs], target))
    big_s, big_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (big_s + buckets) / ((s[b] + 1) * (big_t + buckets)))) for b in range(buckets)]
    rows = []
    for i, text in docs:
        f = plain_features(text)
        weight = sum(gain[code(x)] for x in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"7:{i}".encode()).hexdigest()[:8], 16)
        rows.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    able = sorted((r for r in rows if (r[1] + 1) // 2 >= least), key=lambda r: (-r[3], r[0]))
    for k, r in enumerate(able[:percent * len(able) // 100]):
        r[4] = k + 1
    return sorted(map(tuple, rows))


def test_query_against_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    target = [r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    got = QUERIES["op11_importance_resampling"](spark, sf)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert sorted(map(tuple, got.collect())) == plain(docs, target)


def test_crc_of_all_lengths():
    words = [bytes((7 * i + j) % 256 for j in range(i)) for i in [*range(1, 300), 5, 5, 1000]]
    data = np.frombuffer(b"".join(words), np.uint8)
    size = np.array([len(w) for w in words])
    assert resampling.crc_by_length(data, np.cumsum(size) - size, size).tolist() == [zlib.crc32(w) for w in words]


@pytest.mark.parametrize("block", [64, 8 << 20])
def test_odd_rows(spark, monkeypatch, block):
    monkeypatch.setattr(resampling, "BLOCK_BYTES", block)
    long_ = " ".join(f"Wort{i % 77}é" for i in range(3000))
    texts = [None, "", " \n ", "...", "One", "a-b a-b A-B \x00 a", "日本語 テスト ١٢ ẛ", "x" * 700 + " y", long_, long_, "z" * 300, " ,".join("abc" * 30)]
    rows = [(i, t, "clash", 5) for i, t in enumerate(texts)] + [(8, long_, "clash", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, rank string, _n int")
    target = spark.createDataFrame([("wort1é wort2é", 1), (None, 2)], "text string, key int")
    got = resampling.resample(docs, target, percent=60, min_words=3)
    key = lambda r: tuple(-1 if x is None else x for x in r)
    want = plain([r[:2] for r in rows], ["wort1é wort2é", None], 60, 3)
    assert sorted(map(tuple, got.collect()), key=key) == sorted(want, key=key)
    assert resampling.resample(docs.limit(0), target).count() == 0
    nobody = resampling.resample(docs.withColumn("doc_id", docs.doc_id.cast("string")).na.replace({"1": None}, subset=["doc_id"]), target.limit(0))
    assert nobody.count() == len(rows)
    none = spark.createDataFrame([(None, "a b c d"), (None, "a b c d"), (2, "a")], "doc_id long, text string")
    out = resampling.resample(none, target, percent=100, min_words=2).collect()
    assert sorted(r["rank"] for r in out if r["rank"]) == [1, 2] and len({r.score for r in out if r.doc_id is None}) == 1


def test_long_words_and_stretches():
    text = ("ab " * 50 + "q" * 500 + " " + "cd ef " * 40 + "  " * 100 + "gh").encode()
    data = np.frombuffer(text, np.uint8)
    whole = sorted(resampling.features(data, np.array([0, len(data)]), 1000)[0].tolist())
    for limit in (3, 7, 64, 333):
        parts = [resampling.features(d, c, 1000, lead)[0] for d, c, lead in resampling._stretches(data, np.array([0, len(data)]), limit)]
        assert sorted(np.concatenate(parts).tolist()) == whole
