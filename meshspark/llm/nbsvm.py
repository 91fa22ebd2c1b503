"""Quality classifier: naive Bayes support vectors.

Indicators of word 1-grams, word 2-grams and byte 3-grams are hashed into a fixed number of columns, scaled by the log ratio of
their counts in the two classes, and a linear hinge-loss model is fitted on the scaled rows by dual coordinate descent.
Class counts cover all labelled training rows; the descent sees a bounded sample of them.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from meshspark.llm.shared import buffer_of, keep, mixed, ngram_hashes, query, read, sliced, word_hashes, words_of

COLUMNS = 1 << 17
FIT_ROWS = 12_000
EPOCHS = 8


@dataclass
class Model:
    """scale: log-count ratio of every column; weight: what the descent gave it; bias."""
    scale: np.ndarray
    weight: np.ndarray
    bias: float


def indicators(column) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashed features of every row: (columns, offsets by row). A null text has none."""
    data, offsets = buffer_of(column)
    n = len(offsets) - 1
    starts, ends, row = words_of(data, offsets)
    h = word_hashes(data, starts, ends)
    pairs, first = ngram_hashes(h, row, 2)
    kind = np.min_scalar_type(max(n, 1) * COLUMNS)  # four bytes a key up to 32,767 rows
    keys = [(row, h), (row[first], pairs)]
    if len(data) >= 3:
        byte = data.astype(np.uint32)
        three = byte[:-2] | (byte[1:-1] << np.uint32(8)) | (byte[2:] << np.uint32(16))
        owner = np.repeat(np.arange(n, dtype=kind), np.diff(offsets))
        inside = owner[2:] == owner[:-2]
        keys.append((owner[:-2][inside], mixed(three[inside] | np.uint64(1 << 40))))
    flat = np.concatenate([r.astype(kind) * COLUMNS + (k & np.uint64(COLUMNS - 1)).astype(kind) for r, k in keys])
    flat.sort()  # np.unique hashes the keys before it sorts them, which takes ten times as long here
    new = np.ones(len(flat), bool)
    new[1:] = flat[1:] != flat[:-1]
    flat = flat[new]
    return (flat % COLUMNS).astype(np.int32), np.searchsorted(flat, np.arange(n + 1) * COLUMNS)


def _class_counts(batches):
    """Per task: in how many texts of each class every column occurs; a column of -1 counts the texts."""
    total = np.zeros((2, COLUMNS + 1), np.int64)
    for b in sliced(batches):
        col, at = indicators(b.column("text"))
        y = np.asarray(b.column("y"))
        of = np.repeat(y, np.diff(at))
        for c in (0, 1):
            total[c, :COLUMNS] += np.bincount(col[of == c], minlength=COLUMNS)
            total[c, COLUMNS] += int((y == c).sum())
    hit = np.flatnonzero(total.sum(axis=0))
    name = np.where(hit == COLUMNS, -1, hit)
    yield pa.RecordBatch.from_arrays([pa.array(name), pa.array(total[0, hit]), pa.array(total[1, hit])], names=["col", "n0", "n1"])


def _feature_rows(batches):
    for b in sliced(batches):
        col, at = indicators(b.column("text"))
        cols = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(col))
        yield pa.RecordBatch.from_arrays([b.column("y"), b.column("draw"), cols], names=["y", "draw", "cols"])


def descend(rows: list[np.ndarray], y: np.ndarray, scale: np.ndarray, epochs: int = EPOCHS, cost: float = 1.0, seed: int = 7):
    """Dual coordinate descent for the squared hinge loss on unit-length scaled rows; classes weigh alike."""
    w, bias = np.zeros(len(scale)), 0.0
    share = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())) * len(y)
    diag = 0.5 / (cost * share)
    x = [scale[r] for r in rows]
    x = [v / max(np.sqrt(v @ v), 1e-12) for v in x]
    square = np.array([v @ v for v in x]) + 1.0
    alpha = np.zeros(len(rows))
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            g = y[i] * (w[rows[i]] @ x[i] + bias) - 1 + diag[i] * alpha[i]
            if g >= 0 and alpha[i] == 0:
                continue
            new = max(alpha[i] - g / (square[i] + diag[i]), 0.0)
            step = (new - alpha[i]) * y[i]
            alpha[i] = new
            w[rows[i]] += step * x[i]
            bias += step
    return w, bias


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", fit_rows: int = FIT_ROWS, smooth: float = 1.0) -> Model:
    """Model from docs (doc_id, text) that have a 0/1 label in labels (doc_id, label).

    The descent takes the ``fit_rows`` labelled rows of smallest doc_id hash, all of them if there are fewer; it runs in one task,
    whose input that bounds. Null labels and ids are no training rows; without rows of both classes the model is constant.
    """
    # a shuffled join whatever the number of labels: the plan, and what it costs a row, is the same at every size
    known = labels.select("doc_id", F.col(label).alias("y")).filter("y in (0, 1)").hint("merge")
    train = docs.select("doc_id", "text").join(known, "doc_id") \
        .select("text", F.col("y").cast("long").alias("y"), F.xxhash64("doc_id").alias("draw"))
    train = keep(train, "labelled-texts")
    counts = train.select("text", "y").mapInArrow(_class_counts, "col bigint, n0 bigint, n1 bigint") \
        .groupBy("col").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")).toPandas()
    n = {c: np.zeros(COLUMNS) for c in ("n0", "n1")}
    texts = counts[counts.col == -1]
    counts = counts[counts.col >= 0]
    for c in n:
        n[c][counts.col.to_numpy()] = counts[c].to_numpy()
    zero = Model(np.zeros(COLUMNS), np.zeros(COLUMNS), 0.0)
    if texts.empty or texts.n0.item() == 0 or texts.n1.item() == 0:
        return zero
    p, q = (n["n1"] + smooth) / (texts.n1.item() + 2 * smooth), (n["n0"] + smooth) / (texts.n0.item() + 2 * smooth)
    scale = np.log(p / q)
    share = min(1.0, (1.25 * fit_rows + 200) / (texts.n0.item() + texts.n1.item()))  # only so many rows meet in one task
    low = F.pmod("draw", F.lit(1 << 30)) < int(share * (1 << 30))
    sample = train.filter(low).orderBy(F.pmod("draw", F.lit(1 << 30)), "draw", "y").limit(fit_rows).mapInArrow(_feature_rows, "y bigint, draw bigint, cols array<int>")

    def learn(_, pdf):
        pdf = pdf.sort_values("draw", kind="stable")
        w, bias = descend([np.asarray(c, np.int64) for c in pdf.cols], np.where(pdf.y.to_numpy() > 0, 1.0, -1.0), scale)
        return pd.DataFrame({"weight": [w.astype("<f8").tobytes()], "bias": [bias]})

    got = sample.groupBy(F.lit(0).alias("one")).applyInPandas(learn, "weight binary, bias double").first()
    return Model(scale, np.frombuffer(got.weight, "<f8"), got.bias)


def _scorer(model):
    def run(batches):
        m = model.value
        product = m.weight * m.scale
        for b in sliced(batches):
            col, at = indicators(b.column("text"))
            top = np.concatenate([[0.0], np.cumsum(product[col])])
            norm = np.concatenate([[0.0], np.cumsum(m.scale[col] ** 2)])
            length = np.sqrt(np.maximum(norm[at[1:]] - norm[at[:-1]], 0.0))
            margin = (top[at[1:]] - top[at[:-1]]) / np.maximum(length, 1e-12) + m.bias
            score = 1.0 / (1.0 + np.exp(-2.0 * margin))
            names = [c for c in b.schema.names if c != "text"]
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in names], pa.array(score)], names=[*names, "score"])
    return run


def score(docs: DataFrame, model: Model, columns: list[str] | None = None) -> DataFrame:
    """``columns`` (default doc_id) and a score in 0 to 1 for every row; 0.5 is the decision border.

    Nothing but the text enters. Null and empty texts get the score of the bias; equal texts score alike; an empty table gives an
    empty one; an input column named score is replaced. The model has a fixed size, so it is broadcast.
    """
    columns = [c for c in (columns or ["doc_id"]) if c not in ("score", "text")]
    d = docs.select(*columns, "text")
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in d.schema if f.name != "text")
    sent = docs.sparkSession.sparkContext.broadcast(model)
    return d.mapInArrow(_scorer(sent), kinds + ", score double")


def held_out(third: int = 1):
    """True for the third of all ids that never trains; a null id is not held out and has no label."""
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3)) == third, F.lit(False))


@query("op8_quality_classifier")
def op8_quality_classifier(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs.filter(~held_out()), read(spark, sf_dir, "labels").filter(~held_out()))
    return score(docs, model).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
