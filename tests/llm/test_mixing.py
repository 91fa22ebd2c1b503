from pyspark.sql import functions as F

from meshspark.llm import mixing


def test_targets_share_the_excess(spark):
    rows = [("a", 100, 5.0), ("b", 100, 2.0), ("c", 1000, 1.0), (None, 10, 5.0), ("z", 0, 2.0)]
    got = {r.source: r.target for r in mixing.targets(spark.createDataFrame(rows, "source string, source_size long, weight double")).collect()}
    left, full = dict((s, w) for s, _, w in rows), {}
    size, total = {s: n for s, n, _ in rows}, 1.5 * 1210
    while True:
        level = (total - sum(full.values())) / sum(left.values())
        over = [s for s in left if left[s] * level > 2 * size[s]]
        if not over:
            break
        for s in over:
            full[s] = 2 * size[s]
            del left[s]
    want = {**full, **{s: w * level for s, w in left.items()}}
    assert all(abs(got[s] - want[s]) < 1e-9 for s in want) and abs(sum(got.values()) - total) < 1e-9


def test_positions_follow_the_schedule(spark):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("w x y").alias("text"), F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("source"))
    knots = "array<struct<t:double,w:double>>"
    plan = spark.createDataFrame([("a", [(0.0, 2.0), (1.0, 0.0)]), ("b", [(0.0, 0.0), (0.5, 0.0), (1.0, 4.0)])], f"source string, knots {knots}")
    out = mixing.mix(docs, plan, share=1.0).toPandas()
    for s, cdf in (("a", lambda t: 2 * t - t * t), ("b", lambda t: max(0.0, 2 * t - 1) ** 2)):
        p = sorted(x["position"] for ps in out[out.source == s].passes for x in ps)
        n = len(p)
        assert all(abs(cdf(t) - i / n) < 1e-6 for i, t in enumerate(p))
    order = [r.position for r in mixing.in_training_order(mixing.mix(docs, plan, share=1.0)).collect()]
    assert [x for x in order if x is not None] == sorted(x for x in order if x is not None)


def test_odd_rows(spark):
    rows = [(1, None, None), (2, "", "s"), (3, "a b", "s"), (3, "a b", "s"), (None, "a b c", None), (4, "w " * 50000, "big")]
    docs = spark.createDataFrame([(*r, "t") for r in rows], "doc_id long, text string, source string, target string")
    out = mixing.mix(docs).toPandas()
    assert len(out) == 6 and (out.taken <= 2 * out["size"]).all() and out[out.doc_id == 1].taken.item() == 0
    for _, g in out.groupby("source", dropna=False):
        assert g.taken.sum() == int(g.target.iloc[0] + 0.5)
    assert mixing.mix(docs.limit(0)).count() == 0
    again = mixing.mix(docs.repartition(5)).toPandas()
    assert sorted(zip(out.doc_id.fillna(-1), out.taken)) == sorted(zip(again.doc_id.fillna(-1), again.taken))


def test_every_pass_has_its_place_and_columns_come_back(spark):
    rows = [(i, "a b c d", "s", i, -i, "p") for i in range(10)] + [(99, None, "s", 0, 0, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, _h long, _Size long, pass string")
    mixed = mixing.mix(docs)
    assert {(r.doc_id, r._h, r._Size) for r in mixed.collect()} == {(r[0], r[3], r[4]) for r in rows}
    got = mixing.training_rows(mixed).collect()
    taken = {r.doc_id: r.taken for r in mixed.collect()}
    assert len(got) == sum(len(r.passes) or 1 for r in mixed.collect()) > len(rows)
    assert all(sum(r.taken for r in got if r.doc_id == i) == n for i, n in taken.items())
    places = [r.position for r in got]
    assert places[-1] is None and places[:-1] == sorted(places[:-1]) and len(set(places)) == len(places)
