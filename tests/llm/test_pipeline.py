import hashlib
import re

import pytest
from test_near_copies import plain_keepers

import corpus_pipeline
from meshspark.llm import cleaning, leaks, secrets

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def clean(text):
    words = WORD.findall(text)
    tri = list(zip(words, words[1:], words[2:]))
    often = {t for t in tri if tri.count(t) > 1} if len(tri) < 4000 else set()
    hit = {i + k for i, t in enumerate(tri) if t in often for k in range(3)}
    if len(words) < 50 or 100 * len(hit) > 50 * len(words):
        return None
    lines = text.split("\n")
    bad = [bool(WORD.search(x)) and cleaning.line_verdict(x, len(WORD.findall(x))) != "" for x in lines]
    if sum(len(WORD.findall(x)) for x, b in zip(lines, bad) if b) > cleaning.MAX_LOST * len(words):
        return None
    return "\n".join(x for x, b in zip(lines, bad) if not b)


def terms(text):
    return re.findall(r"[a-z0-9\x80-\U0010ffff]+", text.lower())


@pytest.fixture(scope="module")
def plain(spark, sf):
    docs = {r.doc_id: r.asDict() for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    kept = {i: dict(d, text=t) for i, d in docs.items() if (t := clean(d["text"] or "")) is not None}
    stay, _ = plain_keepers({i: d["text"] for i, d in kept.items()})
    kept = {i: d for i, d in kept.items() if i in stay}
    items = [terms(r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    for i in list(kept):
        w = terms(kept[i]["text"])
        if any(leaks.common_subsequence(x, w[s:s + 96]) >= 0.8 * len(x) for x in items if set(x) & set(w) for s in range(0, len(w), 16)):
            del kept[i]
    for d in kept.values():
        for _, _, pattern, group, least in secrets.RULES[:1]:
            d["secret"] = [m.group(0) for m in re.finditer(pattern, d["text"]) if len(m.group(group)) >= least]
    return kept


def test_pipeline_against_brute_force(spark, sf, plain):
    rows = corpus_pipeline.run(spark, sf).collect()
    got = {r.doc_id: r for r in rows}
    taken = {i: sum(r.taken for r in rows if r.doc_id == i) for i in got}
    places = [r.position for r in rows if r.position is not None]
    assert places == sorted(places) and len({(r.doc_id, r["pass"]) for r in rows}) == len(rows) > len(got)
    assert set(got) == set(plain)
    sizes = {}
    for i, r in got.items():
        assert not any(s in r.text for s in plain[i]["secret"]) and r.n_chars == len(r.text)
        if not plain[i]["secret"] and not re.search("[0-9a-f]{16}", plain[i]["text"]):
            assert r.text == plain[i]["text"]
        assert r["size"] == len(WORD.findall(r.text))
        sizes.setdefault(r.source, []).append(i)
    for source, ids in sizes.items():
        assert sum(taken[i] for i in ids) == int(got[ids[0]].target + 0.5)
        start = 0
        for i in sorted(ids, key=lambda i: (hashlib.md5(str(i).encode()).hexdigest(), i)):
            r = got[i]
            want = sum(max(0, min(r["size"], int(r.target + 0.5) - start - p * r.source_size)) for p in range(2))
            assert taken[i] == want
            start += r["size"]


def test_stages_return_the_columns_of_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert len(corpus_pipeline.STAGES) == 5
    for name, stage in corpus_pipeline.STAGES[:-1]:
        for d in (docs.limit(20), docs.limit(0)):
            out = stage(spark, d, sf)
            assert out.columns == docs.columns and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema]
            assert out.count() <= d.count(), name
    assert corpus_pipeline.STAGES[-1][1](spark, docs.limit(0), sf).count() == 0


def test_clashing_names_and_null_rows(spark, sf):
    rows = [(1, None, "x"), (None, "a b " * 60 + ".", None), (2, "", None), (3, "Some words that differ from all others here.", "x")]
    d = spark.createDataFrame([(*r, "en", 5, 7) for r in rows], "doc_id long, text string, source string, lang string, size int, n_words int")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, d, sf)
        assert set(d.columns) <= set(out.columns) and out.select("doc_id", "text").distinct().count() <= 4, name
