import hashlib
import random

import public_tokenizers
import pytest
import sentencepiece

from meshspark.llm import pieces
from meshspark.llm.shared import QUERIES

PATH = public_tokenizers.path("piece_bpe_32k.model")
ODD = ["", " ", "   ", "a", " a", "a  b ", "\n", "a\tb\r\n\n c", "ﬁ①Ａ é é", "x▁y ▁ ▁▁", "<s>ab</s><unk><0x0A>", "\x00a\x00", "😀𝒳😀",
       "日本語のテキスト、漢字。", "مرحبا بالعالم", "z" * 3000, "abab" * 2000, "1234567890 3.14159", "    def f(x):\n        return x+1\n",
       " " * 500, "don't  won't", " 　﻿", "ÀÉÎ õ ß", "http://example.org/?a=b&c=%20"]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


def test_odd_and_random_texts(library):
    e = pieces.Encoder(PATH)
    rng = random.Random(5)
    vocabulary = list(e.ids)
    texts = ODD + ["".join(rng.choices(vocabulary, k=60)).replace("▁", rng.choice([" ", "▁"])) for _ in range(400)]
    texts += ["".join(rng.choices("ab ehinorst\n", k=200)) for _ in range(200)] + ["".join(rng.choices("▁ etaoin", k=40)) for _ in range(200)]
    flat, offsets = e.encode_block(texts)
    for i, t in enumerate(texts):
        assert flat[offsets[i]:offsets[i + 1]].tolist() == library.encode(t), t[:80]
    # whole texts without cuts at impossible neighbours give the same ids: the cuts lose nothing
    for t in texts[:120]:
        assert e.to_ids(e.encode(library.normalize(t))) == library.encode(t)


def test_positions_fail_and_are_taken_back():
    """A model in which the longest match first is wrong: only backtracking finds the merged result."""
    e = pieces.Encoder(PATH)
    e.ids = {p: i for i, p in enumerate(["a", "b", "c", "d", "ab", "cd", "bc", "abc"])}
    e.rank = {"bc": 0, "ab": 1, "cd": 2, "abc": 3}
    e.pairs, e.prefix = {}, {}
    import ahocorasick
    e.automaton = ahocorasick.Automaton()
    for p in e.ids:
        e.automaton.add_word(p, len(p))
    e.automaton.make_automaton()
    rng = random.Random(1)
    for _ in range(500):
        t = "".join(rng.choices("abcd", k=rng.randint(1, 12)))
        assert e.encode(t) == e.merged(t)


def test_query_against_library(spark, library):
    sf = "/root/testdata/sf0.01"
    got = {r.doc_id: r for r in QUERIES["op12_sentencepiece"](spark, sf).collect()}
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    assert len(got) == len(rows)
    for r in rows:
        ids = library.encode(r.text or "")
        want = (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest())
        assert (got[r.doc_id].n_tokens, got[r.doc_id].ids_sha256, got[r.doc_id].decoded_sha256) == want


def test_odd_rows(spark, library):
    rows = [(i, t, [1]) for i, t in enumerate([None, *ODD, "word " * 200000])] + [(3, ODD[2], [2])]
    docs = spark.createDataFrame(rows, "doc_id int, text string, ids array<int>")
    out = pieces.decode(pieces.encode(docs, PATH), PATH)
    got = out.collect()
    assert out.columns == ["doc_id", "text", "ids", "decoded"] and len(got) == len(rows)
    for r in got:
        ids = library.encode(r.text or "")
        assert r.ids == ids and r.decoded == (library.decode(ids) if ids else "")
    assert pieces.decode(pieces.encode(docs.limit(0), PATH), PATH).count() == 0
    assert [r.decoded for r in pieces.decode(spark.createDataFrame([(None,), ([],)], "ids array<int>"), PATH).collect()] == ["", ""]
