import zlib

import numpy as np
import pyarrow as pa

from meshspark.llm import nbsvm
from meshspark.llm.shared import QUERIES, buffer_of, mixed, ngram_hashes, word_hashes, words_of


def auc(score, y):
    order = np.argsort(score)
    rank = np.empty(len(order))
    rank[order] = np.arange(1, len(order) + 1)
    n1 = (y == 1).sum()
    return (rank[y == 1].sum() - n1 * (n1 + 1) / 2) / (n1 * (len(y) - n1))


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    got = QUERIES["op8_quality_classifier"](spark, sf).toPandas()
    docs = spark.read.parquet(f"{sf}/documents.parquet").toPandas()
    assert sorted(got.doc_id) == sorted(docs.doc_id) and got.score.between(0, 1).all()
    assert (got.held_out == [zlib.crc32(str(i).encode()) % 3 == 1 for i in got.doc_id]).all()
    assert (got.predicted == (got.score >= 0.5)).all()
    labels = spark.read.parquet(f"{sf}/labels.parquet").toPandas()
    m = got[got.held_out].merge(labels, on="doc_id")
    print("AUC", auc(m.score.to_numpy(), m.quality.to_numpy()), "accuracy", (m.predicted == m.quality).mean())
    assert auc(m.score.to_numpy(), m.quality.to_numpy()) > 0.95 and (m.predicted == m.quality).mean() > 0.9


def test_indicators_are_distinct_per_row():
    col, at = nbsvm.indicators(pa.array(["a b a b", None, "", "ab"]))
    assert np.diff(at).tolist() == [2 + 2 + 4, 0, 0, 1]
    again, _ = nbsvm.indicators(pa.array(["ab"]))
    assert again.tolist() == col[at[3]:].tolist()


def test_indicators_come_from_one_sort_of_narrow_keys(monkeypatch):
    def column(key):
        return int(key) & (nbsvm.COLUMNS - 1)

    def plain(text):
        data, offsets = buffer_of(pa.array([text]))
        starts, ends, row = words_of(data, offsets)
        h = word_hashes(data, starts, ends)
        grams = mixed(np.array([a | b << 8 | c << 16 | 1 << 40 for a, b, c in zip(*(data[i:].tolist() for i in range(3)))], np.uint64))
        return sorted({column(k) for k in (*h, *ngram_hashes(h, row, 2)[0], *grams)})

    def refuse(*_, **__):
        raise AssertionError("np.unique takes ten times as long as the sort")

    texts = ["a b a b", None, "", "ab", "Zähne und Zähne, dicht an dicht", "x" * 5000, "a b a b"]
    sizes = set()
    monkeypatch.setattr(nbsvm.np, "min_scalar_type", lambda n, f=np.min_scalar_type: sizes.add(f(n).itemsize) or f(n))
    monkeypatch.setattr(nbsvm.np, "unique", refuse)
    col, at = nbsvm.indicators(pa.array(texts))
    assert [col[a:b].tolist() for a, b in zip(at[:-1], at[1:])] == [plain(t) for t in texts]
    many = 33_000  # more rows than fit in keys of four bytes
    col, at = nbsvm.indicators(pa.array(["ab cd"] * many))
    assert col.reshape(many, -1).tolist() == [plain("ab cd")] * many and (np.diff(at) == len(col) // many).all()
    assert sizes == {4, 8}


def test_odd_rows(spark):
    docs = spark.createDataFrame([(i, ("good words here " if i % 2 else "junk *** !!! ") * (i % 5 + 1), "s") for i in range(60)]
                                 + [(None, None, "s"), (70, "", "s"), (70, "", "s"), (71, "good " * 50000, "s")],
                                 "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)] + [(None, 1), (70, None)], "doc_id long, quality int")
    model = nbsvm.fit(docs, labels)
    got = nbsvm.score(docs, model).toPandas()
    assert len(got) == 64 and all((r.score > 0.5) == (r.doc_id % 2 == 1) for r in got[got.doc_id < 60].itertuples())
    assert nbsvm.score(docs.limit(0), model).count() == 0
    flat = nbsvm.fit(docs, labels.limit(0))
    assert set(nbsvm.score(docs, flat).toPandas().score) == {0.5}
