import random
import re

from meshspark.llm import leaks
from meshspark.llm.shared import QUERIES


def terms(text):
    return re.findall(r"[a-z0-9\x80-\U0010ffff]+", text.lower())


def test_common_subsequence():
    rng = random.Random(3)
    for _ in range(100):
        a, b = [rng.randrange(5) for _ in range(rng.randrange(1, 30))], [rng.randrange(5) for _ in range(rng.randrange(30))]
        d = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                d[i + 1][j + 1] = d[i][j] + 1 if x == y else max(d[i][j + 1], d[i + 1][j])
        assert leaks.common_subsequence(a, b) == d[-1][-1]


def test_query_finds_all_copies_and_nothing_clean(spark):
    sf = "/root/testdata/sf0.01"
    got = {(r.doc_id, r.item_id) for r in QUERIES["op5_decontamination"](spark, sf).collect()}
    docs = {r.doc_id: " ".join(terms(r.text or "")) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    items = {r.item_id: terms(r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()}
    whole = {(d, i) for d, t in docs.items() for i, w in items.items() if f" {' '.join(w)} " in f" {t} "}
    assert len(whole) > 10 and whole <= got
    for d, i in got - whole:  # every further find shares most words of the item within a short stretch
        words = docs[d].split()
        assert max(leaks.common_subsequence(items[i], words[s:s + 96]) for s in range(0, max(1, len(words)), 8)) >= 0.6 * len(items[i])


def test_paraphrases_and_odd_rows(spark):
    rng = random.Random(5)
    vocab = ["".join(rng.choice("bcdfglmnprst") + rng.choice("aeiou") for _ in range(rng.randint(1, 4))) for _ in range(4000)]
    draw = lambda n: [rng.choice(vocab) for _ in range(n)]
    items = [draw(rng.randint(20, 60)) for _ in range(30)] + [draw(300)]
    docs = [draw(rng.randint(5, 400)) for _ in range(400)]
    planted = set()
    for k in range(60):
        i = k % 31
        w = list(items[i])
        if k >= 31:  # reworded: an eighth of the words replaced, some dropped
            w = [rng.choice(vocab) if rng.random() < 0.12 else x for x in w if rng.random() > 0.04]
        at = rng.randint(0, len(docs[k]))
        docs[k] = docs[k][:at] + w + docs[k][at:]
        planted.add((k, i))
    rows = [(i, " ".join(d), 1) for i, d in enumerate(docs)] + [(500, None, 1), (501, "", 1), (None, " ".join(items[0]), 1), (0, " ".join(docs[0]), 1)]
    d = spark.createDataFrame(rows, "doc_id long, text string, item_id int")
    b = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)] + [(90, None), (91, "the"), (92, "")], "item_id long, text string")
    got = [(r.doc_id, r.item_id) for r in leaks.find_leaks(d, b).collect()]
    assert len(got) == len(set(got)) and set(got) == planted | {(None, 0)}
    left = [r.doc_id for r in leaks.drop_leaks(d, b).collect()]
    assert None not in left and {500, 501} <= set(left) and not set(left) & {i for i, _ in planted}
    assert leaks.find_leaks(d.limit(0), b).count() == 0 and leaks.find_leaks(d, b.limit(0)).count() == 0


def test_reordered_items(spark):
    rng = random.Random(8)
    vocab = ["".join(rng.choice("bcdfglmnprst") + rng.choice("aeiou") for _ in range(rng.randint(1, 4))) for _ in range(4000)]
    draw = lambda n: [rng.choice(vocab) for _ in range(n)]
    items = [[draw(rng.randint(6, 12)) for _ in range(rng.randint(2, 5))] for _ in range(30)]
    docs = [draw(rng.randint(5, 300)) for _ in range(120)]
    planted = set()
    for k in range(90):
        sentences = [list(s) for s in items[k % 30]]
        if k < 30:
            w = sum(reversed(sentences), [])
        elif k < 60:  # halves swapped
            w = sum(sentences, [])
            w = w[len(w) // 2:] + w[:len(w) // 2]
        else:  # in reverse order and a word in ten replaced
            w = sum(reversed(sentences), [])
            for x in rng.sample(range(len(w)), len(w) // 10):
                w[x] = rng.choice(vocab)
        at = rng.randint(0, len(docs[k]))
        docs[k] = docs[k][:at] + w + docs[k][at:]
        planted.add((k, k % 30))
    d = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(docs)], "doc_id long, text string")
    b = spark.createDataFrame([(i, " ".join(" ".join(s) + "." for s in x)) for i, x in enumerate(items)], "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in leaks.find_leaks(d, b).collect()} == planted


def test_items_of_the_table_in_other_order(spark):
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.1/benchmark.parquet").collect()]
    found = 0
    for b in leaks._blocks(spark.createDataFrame(list(enumerate(texts)), "item_id long, text string")):
        for piece, clauses in zip(b.pieces, b.clauses):
            assert sum(map(len, clauses)) == len(piece)
            swapped = list(piece[len(piece) // 2:]) + list(piece[:len(piece) // 2])
            found += leaks.common_words(piece, clauses, leaks.np.array(swapped)) >= leaks.MIN_COMMON * len(piece)
    assert found > 0.95 * len(texts)


def made_up(seed, size=4000):
    rng = random.Random(seed)
    vocab = ["".join(rng.choice("bcdfglmnprst") + rng.choice("aeiou") for _ in range(rng.randint(1, 4))) for _ in range(size)]
    return rng, lambda n: [rng.choice(vocab) for _ in range(n)]


def tables(spark, docs, items):
    return (spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(docs)], "doc_id long, text string"),
            spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)], "item_id int, text string"))


def test_scattered_words_are_mostly_rejected_by_the_cosine_alone(spark):
    rng, draw = made_up(21, 1000)
    items = [draw(6) for _ in range(20)]
    docs = [draw(200) for _ in range(800)]
    for k, w in enumerate(items):  # all words in order, six apart, among others: no passage is about the item
        for j, x in enumerate(w):
            docs[k][60 + 6 * j] = x
        docs[20 + k][100:106] = w
    d, b = tables(spark, docs, items)
    copies = {(20 + k, k) for k in range(20)}
    got = {(r.doc_id, r.item_id) for r in leaks.find_leaks(d, b).collect()}
    without = {(r.doc_id, r.item_id) for r in leaks.find_leaks(d, b, min_cosine=-1.0).collect()}
    assert copies <= got < without and len(without) >= 35
    assert 2 * len(got - copies) < len(without - copies), (len(got), len(without))


def test_recall_by_share_of_replaced_words(spark):
    rng, draw = made_up(22)
    items = [draw(rng.randint(15, 60)) for _ in range(50)]
    shares, docs, planted = (0.1, 0.2, 0.3, 0.5), [draw(rng.randint(20, 300)) for _ in range(400)], {}
    for s, share in enumerate(shares):
        for i, item in enumerate(items):
            w = [rng.choice(draw(3)) if rng.random() < share else x for x in item]
            k = s * 50 + i
            at = rng.randint(0, len(docs[k]))
            docs[k][at:at] = w
            planted[k, i] = share
    d, b = tables(spark, docs, items)
    got, checks_alone = ({(r.doc_id, r.item_id) for r in leaks.find_leaks(d, b, c).collect()} for c in (leaks.MIN_COSINE, -1.0))
    found = {s: sum(1 for p, x in planted.items() if x == s and p in got) / 50 for s in shares}
    assert got <= set(planted) and len(got) >= 0.97 * len(checks_alone)
    assert found[0.1] == 1.0 and found[0.2] >= 0.9 and found[0.3] >= 0.75, found


def test_short_items_long_texts_and_unsearched_ones(spark):
    rng, draw = made_up(23)
    items = [draw(4), draw(2), draw(30), draw(5), ["alone"], []]
    docs = [draw(300) for _ in range(20)] + [draw(3 * leaks.STRIP)]
    docs[0][10:14] = items[0]
    docs[1][50:52] = items[1]
    docs[2][50:53] = [items[1][0], "between", items[1][1]]
    docs[3][7:8] = ["alone"]
    for at in (leaks.STRIP - 10, 2 * leaks.STRIP + 5, 3 * leaks.STRIP - 30):
        docs[20][at:at + 30] = items[2]
    docs[20][leaks.STRIP + 1000:leaks.STRIP + 1005] = items[3]
    d, b = tables(spark, docs, items)
    got = {(r.doc_id, r.item_id): r for r in leaks.find_leaks(d, b).collect()}
    text = [" ".join(x) for x in docs]
    exact = {(i, j) for i, t in enumerate(text) for j in range(4) if f" {' '.join(items[j])} " in f" {t} "}
    assert set(got) == exact >= {(0, 0), (1, 1), (20, 2), (20, 3)}
    assert abs(got[20, 3].start - leaks.STRIP - 1000) <= 8
    assert sorted(r.item_id for r in leaks.unsearched(b).collect()) == [4, 5]
    for at in (leaks.STRIP - 10, 3 * leaks.STRIP - 30):  # alone, so that no other place can stand in
        one = docs[4] + draw(3 * leaks.STRIP - 300)
        one[at:at + 30] = items[2]
        hit = leaks.find_leaks(*tables(spark, [one], items[2:3])).collect()
        assert len(hit) == 1 and hit[0].common == 1.0 and abs(hit[0].start - at) <= 8


def test_clashing_columns(spark):
    rng, draw = made_up(24)
    items = [draw(30)]
    d, b = tables(spark, [draw(20) + items[0], draw(50)], items)
    d = d.withColumn("_bad", d.doc_id).withColumn("item_id", d.doc_id)
    left = leaks.drop_leaks(d, b)
    assert left.columns == d.columns and [r.doc_id for r in left.collect()] == [1]
