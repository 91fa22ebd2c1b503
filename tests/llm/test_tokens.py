import public_tokenizers
from tokenizers import Tokenizer

from meshspark.llm import tokens
from meshspark.llm.shared import QUERIES

PATH = public_tokenizers.path("byte_bpe_50k.json")


def test_query_against_library(spark):
    sf = "/root/testdata/sf0.01"
    got = QUERIES["op2_token_counts"](spark, sf).toPandas().set_index("doc_id")
    docs = spark.read.parquet(f"{sf}/documents.parquet").toPandas()
    t = Tokenizer.from_file(PATH)
    assert len(got) == len(docs)
    for i, text in zip(docs.doc_id, docs.text):
        n = len(t.encode(text or "", add_special_tokens=False).ids)
        assert tuple(got.loc[i]) == (len((text or "").encode()), n, n > 512)


def test_odd_texts(spark):
    texts = [None, "", " ", "  \n\n a  b\t\tc \n", "it's we'll I'M don't", "x<|endoftext|>y  <|endoftext|> z", "a\x1c\x1db\x85c 　d e",
             "日本語 テスト ١٢٣ ½² 𝒳𝒴 \U0001f600!!", "ᲉࢗꟚ\U00010d4a\U0001e5d0 ẛ́x", "word " * 30000, "z" * 5000,
             "".join(chr(c) for c in range(1, 0x3000) if not 0xD800 <= c < 0xE000), "a  b", "a  b"]
    docs = spark.createDataFrame([(i % 11, t, "q") for i, t in enumerate(texts)], "doc_id int, text string, block string")
    got = sorted((r.doc_id, r.n_tokens) for r in tokens.count_tokens(docs, PATH).collect())
    t = Tokenizer.from_file(PATH)
    assert got == sorted((i % 11, len(t.encode(x or "", add_special_tokens=False).ids)) for i, x in enumerate(texts))
    assert tokens.count_tokens(docs.limit(0), PATH).count() == 0
