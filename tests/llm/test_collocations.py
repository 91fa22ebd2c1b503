import random
import re
from collections import Counter

from pyspark.sql import functions as F

from meshspark.llm import collocations
from meshspark.llm.shared import QUERIES


def plain(docs, least=10, inside=50, top=2000):
    """Brute force over (text, lang) pairs."""
    count = {}
    for text, lang in docs:
        f = count.setdefault("und" if lang is None else lang, Counter())
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", re.sub("[A-Z]", lambda m: m.group().lower(), text or "")):
            w = re.findall(r"[^\x20\x09]+", piece)
            for k in (1, 2, 3):
                f.update(tuple(w[i:i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, f in count.items():
        n = sum(v for p, v in f.items() if len(p) == 1)
        drop = {q for p, v in f.items() if len(p) == 3 and v >= least for q in (p[:2], p[1:]) if 100 * v >= inside * f[q]}
        rows = []
        for p, a in f.items():
            if len(p) > 1 and a >= least and p not in drop:
                score, k = min((1000000 * a * a // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
                rows.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        out += [(lang, i + 1, p.decode(), -a, left, right, n, -s) for i, (s, a, p, left, right) in enumerate(sorted(rows)[:top])]
    return sorted(out)


def test_query_against_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    got = QUERIES["op13_collocations"](spark, sf)
    docs = [(r.text, r.lang) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    want = plain(docs)
    assert sorted(map(tuple, got.collect())) == want and len(want) > 1000


def test_small_blocks_and_small_alphabet(spark, monkeypatch):
    monkeypatch.setattr(collocations, "BLOCK_WORDS", 500)
    monkeypatch.setattr(collocations, "STRETCH", 4)
    rng = random.Random(3)
    docs = [(" ".join(rng.choices("a b c d e A . x, y", k=60)), rng.choice(["l1", "l2", None, "und"])) for _ in range(300)]
    song = " ".join(f"w{i}" for i in range(40))
    docs += [(song + rng.choice(["", " a", ". b"]), "l1") for _ in range(25)] + [("q\x00 q " + "z" * 400 + " q", "l2")] * 12
    table = spark.createDataFrame(docs, "text string, lang string")
    for least, inside, top in ((10, 50, 2000), (3, 20, 7), (1, 100, 50)):
        got = collocations.collocations(table, least, inside, top)
        assert sorted(map(tuple, got.collect())) == plain(docs, least, inside, top)


def test_paths_hold_all_edges(spark, monkeypatch):
    monkeypatch.setattr(collocations, "STRETCH", 8)
    song = " ".join(f"w{i}" for i in range(40))
    rows = [(song, "l")] * 4 + [("w5 w6 w7 other", "l")] * 3
    runs = collocations.frequent_runs(spark.createDataFrame(rows, "text string, lang string"), 3)
    word = {r.h1: r.word for r in runs.filter("kind = 1").collect()}
    paths = [([word[h] for h in r.words], r.weight) for r in collocations.compact(runs).collect()]
    edges = Counter()
    for w, n in paths:
        assert len(w) <= 10
        edges.update({tuple(w[i:i + 3]): n for i in range(len(w) - 2)})
    want = {tuple(f"w{j}" for j in range(i, i + 3)): 4 for i in range(38)}
    want[("w5", "w6", "w7")] = 7
    want[("w6", "w7", "other")] = 3
    assert edges == want and len(paths) < 10


def test_odd_rows(spark):
    rows = [(None, "l", 1), ("", None, 2), (" \t ", "l", 3), (".!?", "l", 4), ("a b", None, 5), ("a b", "und", 6), ("x " * 200000, "big", 7)]
    docs = spark.createDataFrame([(r[0], r[1], "c", r[2]) for r in rows], "text string, lang string, phrase string, h1 int")
    got = sorted(map(tuple, collocations.collocations(docs, 2).collect()))
    assert got == plain([r[:2] for r in rows], 2)
    assert collocations.collocations(docs.limit(0)).count() == 0


def test_scores_pass_64_bits(spark):
    rng = random.Random(9)
    cases = [(a, left, right) for a in (1, 7, 10**9 + 7, 987654321012345) for left, right in [(a, a), (a + rng.randrange(9), min(3 * a, 10**15 - 1)), (10**15 - 1, a)]]
    t = spark.createDataFrame(cases, "a long, l long, r long").select("*", collocations._exact_score("a", "l", "r").alias("s"))
    assert all(r.s == 1000000 * r.a * r.a // (r.l * r.r) for r in t.collect())
    assert dict(t.dtypes)["s"] == "bigint" and t.agg(F.count("*")).first()[0] == len(cases)
