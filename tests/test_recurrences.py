"""Scans of composed maps against plain loops."""

import random

import pytest

from meshspark.operators import temporal as tp


def plain_ema(rows, alpha):
    out, last = {}, {}
    for k, o, v in sorted(rows):
        prev = last.get(k)
        value = alpha * v + (1 - alpha) * prev[1] if prev and prev[0] == o - 1 else v
        last[k] = (o, value)
        out[k, o] = value
    return out


@pytest.mark.parametrize("alpha", [0.3, 0.004, 0.97, 1.0])
def test_long_histories_with_gaps(spark, alpha):
    rng = random.Random(1)
    rows = [("a", o, rng.uniform(-5, 100)) for o in range(-300, 3000) if rng.random() > 0.002] + [("b", o, rng.random()) for o in range(500) if rng.random() > 0.4] \
        + [("c", 76, 1.0), ("d", 77, 2.0), ("d", 78, 4.0), ("e", 0, float("1e9"))] + [("e", o, 0.0) for o in range(1, 200)]
    got = {(r.k, r.cycle): r.blended for r in tp.ema_by_key(spark.createDataFrame(rows, "k string, cycle long, v double"), ["k"], "cycle", "v", alpha).collect()}
    want = plain_ema(rows, alpha)
    assert got.keys() == want.keys()
    worst = max(abs(got[k] - v) / max(1.0, abs(v)) for k, v in want.items() if k[0] != "e")
    assert worst < 1e-10
    assert all(abs(got[k] - v) <= 1e9 * 1e-12 for k, v in want.items())


def plain_fit(rows, margin=1.7):
    out = {}
    for run in sorted({r[0] for r in rows}):
        seen = box = None
        for _, c, *b in sorted(r for r in rows if r[0] == run):
            lo, hi = b[0::2], b[1::2]
            seen = (lo, hi) if seen is None else ([min(x, y) for x, y in zip(lo, seen[0])], [max(x, y) for x, y in zip(hi, seen[1])])
            refit = box is None or any(x < y for x, y in zip(seen[0], box[0])) or any(x > y for x, y in zip(seen[1], box[1]))
            if refit:
                mid, half = [(x + y) / 2.0 for x, y in zip(*seen)], [max((y - x) / 2.0, 1e-3) * margin for x, y in zip(*seen)]
                box = ([m - h for m, h in zip(mid, half)], [m + h for m, h in zip(mid, half)])
            out[run, c] = (refit, box[0], box[1], list(seen[0]), list(seen[1]))
    return out


def test_view_box_of_growing_bounds(spark):
    rng = random.Random(2)
    rows = []
    for run in range(3):
        at = [0.0, 0.0, 0.0]
        for c in range(0, 2500, 1 if run else 7):
            at = [x + rng.gauss(0.01 * run, 0.2) for x in at]
            rows.append((run, c, *[v for x in at for v in (x - rng.random(), x + rng.random())]))
    columns = ", ".join(f"{m}_{a} double" for a in "xyz" for m in ("min", "max"))
    got = {(r.run_id, r.cycle): (r.refit, [r[f"lo_{a}"] for a in "xyz"], [r[f"hi_{a}"] for a in "xyz"], [r[f"min_{a}"] for a in "xyz"], [r[f"max_{a}"] for a in "xyz"])
           for r in tp.grow_only_fit(spark.createDataFrame(rows, f"run_id long, cycle long, {columns}")).collect()}
    want = plain_fit(rows)
    assert got == want and 5 < sum(v[0] for v in want.values()) < 100
    assert tp.grow_only_fit(spark.createDataFrame([], f"run_id long, cycle long, {columns}")).count() == 0
