import hashlib
import random

from hypothesis import given, settings, strategies as st

from meshspark.llm import suffixes as s
from meshspark.llm.shared import QUERIES


def brute(texts, length):
    seen = {}
    raws = [(t or "").encode() for t in texts]
    for k, raw in enumerate(raws):
        for p in range(len(raw) - length + 1):
            seen.setdefault(hashlib.blake2b(raw[p:p + length], digest_size=16).digest(), []).append((k, p))
    cover = [bytearray(len(r)) for r in raws]
    for places in seen.values():
        if len(places) > 1:
            for k, p in places:
                cover[k][p:p + length] = b"\x01" * length
    return [(len(r), sum(c), sum(1 for i, x in enumerate(c) if x and (i == 0 or not c[i - 1])),
             hashlib.sha256(bytes(b for b, x in zip(r, c) if not x)).hexdigest()) for r, c in zip(raws, cover)]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text("ab", max_size=40).map(lambda t: (t * 6)[:120].encode()), min_size=1, max_size=40))
def test_sorted_order(strings):
    for shallow in (8, 16, 96):
        assert [strings[i] for i in s.deep_shallow(strings, shallow)] == sorted(strings)


def test_query_against_brute_force(spark, sf):
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in QUERIES["op6_suffix_dedup"](spark, sf).collect()}
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    want = dict(zip([r.doc_id for r in rows], brute([r.text for r in rows], 400)))
    assert got == want and sum(w[1] for w in want.values()) > 0


def test_odd_rows_and_shifted_repeats(spark):
    rng = random.Random(9)
    base = "".join(rng.choice("abcdefg é\n") for _ in range(3000))
    texts = [None, "", "short", base, base, base[:1500] + "X" + base[1500:], "q" * 900, "ab" * 500, base[100:600] + base[50:520]]
    texts += [f"{i}" + "".join(rng.choice("xyz") for _ in range(i % 7)) + base[200:700 + i] + f"tail {i} " + base[40 * i:40 * i + 450] for i in range(40)]
    docs = spark.createDataFrame([(i if i != 4 else 3, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, kept int")
    want = sorted(brute(texts, 400))
    got = s.remove_repeats(docs).collect()
    assert sorted((r.n_bytes, r.n_removed, len(r.removed), hashlib.sha256(r.kept).hexdigest()) for r in got) == want
    keyed = docs.select(s.row_key("doc_id", "text").alias("k"), "text").select("k.a", "k.b", "text").toDF("ra", "rb", "text")
    ranges = lambda n: {(r.ra, r.rb): s._merged(s.np.array([(x["from"], x["to"]) for x in r.spans])) for r in s.repeated(keyed, group_classes=n).collect()}
    assert ranges(2000) == ranges(3)
    assert s.remove_repeats(docs.limit(0)).count() == 0
