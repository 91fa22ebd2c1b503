import collections
import re

from meshspark.llm import cleaning
from meshspark.llm.shared import QUERIES

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def base(text):
    w = WORD.findall(text)
    windows = list(zip(w, w[1:], w[2:]))
    n, hit, seen, dup = collections.Counter(windows), set(), set(), 0
    for k, x in enumerate(windows):
        if n[x] > 1:
            hit |= {k, k + 1, k + 2}
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), dup, len(hit), len(w) < 50 or 100 * len(hit) > 50 * len(w)


def test_query_against_brute_force_and_labels(spark):
    sf = "/root/testdata/sf0.01"
    got = QUERIES["op4_quality_rules"](spark, sf).toPandas().set_index("doc_id")
    docs = spark.read.parquet(f"{sf}/documents.parquet").toPandas().set_index("doc_id")
    labels = spark.read.parquet(f"{sf}/labels.parquet").toPandas().set_index("doc_id")
    for i, text in docs.text.items():
        assert tuple(got.loc[i])[:6] == base(text or ""), i
    ok = got.loc[labels.index]
    assert ok[(labels.quality == 1) & ~ok.base_failed].kept.all()
    assert not ok[labels.quality == 0].kept.any()


def test_odd_inputs(spark):
    long = "word" * 100 + " " + " ".join(f"w{i}é" for i in range(30000)) + "."
    rows = [(1, None, 5), (2, "", 5), (3, long, 5), (3, long, 5), (4, "\x0b\x1c  x y z " * 20, 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kept int")
    out = cleaning.measure(docs).toPandas()
    assert len(out) == 5 and out[out.doc_id == 3].kept.tolist() == [True, True] and not out[out.doc_id == 2].kept.any()
    for r in out.itertuples():
        text = dict((a, b) for a, b, _ in rows)[r.doc_id] or ""
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == base(text)
    assert cleaning.measure(docs.limit(0)).count() == 0


def test_lines_go_first(spark):
    good = "\n".join(f"Line{i} says{i} that{i} number{i} is here{i}." for i in range(12))
    menu = "home | about | news | shop"
    rows = [(1, good + "\n" + menu + "\nReleased under the MIT License.", 1), (2, "\n".join([menu] * 9 + [good]), 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars long")
    got = {r.doc_id: r for r in cleaning.clean(docs).collect()}
    assert got[1].text == good and got[1].n_chars == len(good) and list(got) == [1]
    assert cleaning.line_verdict("A B C *** $$$ !!", 6) == "punctuation" and cleaning.line_verdict("A plain line.", 3) == ""
