"""Quality classifier: a linear hinge-loss model over n-gram indicators scaled by naive Bayes ratios.

The n-grams are byte 3- and 4-grams of the text, hashed to ``DIM`` indicators, and n-grams
over the word stream in which a word equal to the one before it is written as one mark:
"the same word again", once, twice and three times in a row.
"""

from __future__ import annotations

from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trustkpi.llm.shared import arrow_map, text_map
from trustkpi.session import stage

DIM_BITS = 18
DIM = 1 << DIM_BITS
MARKS = 3
# Bound of the labelled rows the model is fitted on: those with the lowest hash of their id.
TRAIN_ROWS = 10_000
EPOCHS = 12
COST = 1.0
SMOOTH = 1.0
ACCEPT = 0.3


@dataclass
class Model:
    """``weight`` and ``scale`` per feature; a margin becomes a score by ``slope`` and ``shift``."""

    weight: np.ndarray
    scale: np.ndarray
    bias: float
    slope: float
    shift: float


def features(text: bytes | None) -> np.ndarray:
    """Sorted distinct feature numbers of a whole text."""
    text = text or b""
    raw = np.frombuffer(text, np.uint8).astype(np.uint32)
    found = []
    if len(raw) >= 3:
        three = (raw[:-2] << np.uint32(16)) | (raw[1:-1] << np.uint32(8)) | raw[2:]
        found.append((three * np.uint32(0x9E3779B1)) >> np.uint32(32 - DIM_BITS))
        four = (three[:-1] << np.uint32(8)) | raw[3:]
        found.append((four * np.uint32(0x85EBCA6B)) >> np.uint32(32 - DIM_BITS))
    words = text.split()
    again = bytes(map(eq, words, words[1:]))
    marks = [DIM + k for k in range(MARKS) if b"\x01" * (k + 1) in again]
    return np.unique(np.concatenate([*found, np.array(marks, np.uint32)])).astype(np.uint32)


def held_out(id_col: str = "doc_id") -> Column:
    """Rows kept from training: crc32 of the id as text is divisible by 5. A null id is not held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5 == 0, F.lit(False))


def training_sample(docs: DataFrame, labels: DataFrame, label: str, rows: int, id_col: str, text_col: str) -> DataFrame:
    """(y, text) of at most ``rows`` labelled documents that are not held out.

    Labels that are null, have no id or contradict each other are left out; of several
    documents with one id the least text is taken.
    """
    chosen = (
        labels.where(F.col(id_col).isNotNull() & F.col(label).isin(0, 1)).where(~held_out(id_col))
        .groupBy(F.col(id_col).alias("_id")).agg(F.min(label).alias("y"), F.max(label).alias("other"))
        .where("y = other").orderBy(F.xxhash64("_id"), "_id").limit(rows).select("_id", "y")
    )
    chosen = stage(chosen, "label-sample")
    texts = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    # The sample has at most ``rows`` rows of two numbers.
    return texts.join(F.broadcast(chosen), "_id").groupBy("_id", "y").agg(F.min("text").alias("text"))


def _descend(rows: list[np.ndarray], y: np.ndarray, scale: np.ndarray, norm: np.ndarray, cost: np.ndarray, epochs: int):
    """Dual coordinate descent for the hinge loss; the last weight is the bias."""
    weight = np.zeros(len(scale) + 1)
    alpha = np.zeros(len(rows))
    rng = np.random.default_rng(7)
    values = [scale[r] / n for r, n in zip(rows, norm)]
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            r, x = rows[i], values[i]
            gradient = y[i] * (weight[r] @ x + weight[-1]) - 1.0
            square = 2.0 if len(r) else 1.0  # unit rows and the bias
            new = min(max(alpha[i] - gradient / square, 0.0), cost[i])
            step = (new - alpha[i]) * y[i]
            if step:
                alpha[i] = new
                weight[r] += step * x
                weight[-1] += step
    return weight[:-1], float(weight[-1])


def _calibrate(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a logistic curve through held-back margins, with softened targets."""
    up, down = (y > 0).sum(), (y < 0).sum()
    target = np.where(y > 0, (up + 1) / (up + 2), 1 / (down + 2))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-(a * margin + b)))
        s = np.maximum(p * (1 - p), 1e-9)
        g = np.array([((p - target) * margin).sum() + 1e-3 * a, (p - target).sum()])
        h = np.array([[(s * margin**2).sum() + 1e-3, (s * margin).sum()], [(s * margin).sum(), s.sum() + 1e-9]])
        d = np.linalg.solve(h, g)
        a, b = a - np.clip(d[0], -2, 2), b - np.clip(d[1], -2, 2)
        if np.abs(d).max() < 1e-8:
            break
    return float(max(a, 0.0)), float(b)


def fit_rows(rows: list[np.ndarray], y01: np.ndarray) -> Model:
    """Model from feature rows and 0/1 labels; one label only, or none, gives a constant score."""
    n, up = len(rows), int(y01.sum())
    if up in (0, n):
        rate = (up + 1) / (n + 2)
        return Model(np.zeros(DIM + MARKS), np.zeros(DIM + MARKS), 0.0, 0.0, float(np.log(rate / (1 - rate))))
    y = np.where(y01 > 0, 1.0, -1.0)
    one = np.full(DIM + MARKS, SMOOTH)
    zero = np.full(DIM + MARKS, SMOOTH)
    for r, label in zip(rows, y01):
        (one if label else zero)[r] += 1
    scale = np.log((one / one.sum()) / (zero / zero.sum()))
    norm = np.array([max(np.sqrt((scale[r] ** 2).sum()), 1e-12) for r in rows])
    cost = COST * np.where(y > 0, n / (2 * up), n / (2 * (n - up)))
    kept_back = np.arange(n) % 4 == 3
    if len(set(y[kept_back])) < 2 or len(set(y[~kept_back])) < 2:
        kept_back[:] = False
    train = np.flatnonzero(~kept_back)
    weight, bias = _descend([rows[i] for i in train], y[train], scale, norm[train], cost[train], EPOCHS)
    back = np.flatnonzero(kept_back) if kept_back.any() else train
    margin = np.array([(weight[rows[i]] @ scale[rows[i]]) / norm[i] + bias for i in back])
    slope, shift = _calibrate(margin, y[back])
    return Model(weight * scale, scale**2, bias, slope, shift)


def fit(
    docs: DataFrame, labels: DataFrame, label: str = "quality", rows: int = TRAIN_ROWS,
    id_col: str = "doc_id", text_col: str = "text",
) -> Model:
    """Fit on a bounded sample of labelled documents; features are computed where the texts are."""
    sample = training_sample(docs, labels, label, rows, id_col, text_col)

    def row_features(texts):
        return [pa.array([features(t).tobytes() for t in texts], pa.binary())]

    def fit_task(batches):
        ids, rows_, ys = [], [], []
        for batch in batches:
            ids += batch.column(0).to_pylist()
            ys += batch.column(1).to_pylist()
            rows_ += [np.frombuffer(b, np.uint32) for b in batch.column(2).to_pylist()]
        order = sorted(range(len(ids)), key=lambda i: str(ids[i]))
        model = fit_rows([rows_[i] for i in order], np.array([ys[i] for i in order], np.int64))
        yield pa.RecordBatch.from_pylist(
            [{
                "weight": model.weight.astype(np.float32).tobytes(), "scale": model.scale.astype(np.float32).tobytes(),
                "bias": model.bias, "slope": model.slope, "shift": model.shift,
            }]
        )

    found = text_map(sample, row_features, "f binary", keep=["_id", "y"]).repartition(1)
    row = arrow_map(found, fit_task, "weight binary, scale binary, bias double, slope double, shift double").first()
    if row is None:
        return fit_rows([], np.zeros(0, np.int64))
    return Model(
        np.frombuffer(row["weight"], np.float32), np.frombuffer(row["scale"], np.float32),
        row["bias"], row["slope"], row["shift"],
    )


def score_text(text: bytes | None, model: Model) -> float:
    f = features(text)
    norm = max(float(np.sqrt(model.scale[f].sum(dtype=np.float64))), 1e-12)
    margin = float(model.weight[f].sum(dtype=np.float64)) / norm + model.bias
    return float(1 / (1 + np.exp(-np.clip(model.slope * margin + model.shift, -500, 500))))


def with_score(docs: DataFrame, model: Model, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``docs`` with ``score`` in 0 to 1, likelier good the higher; a null text counts as empty."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # of fixed size

    def run(texts):
        return [pa.array([score_text(t, shared.value) for t in texts], pa.float64())]

    return text_map(docs, run, "score double", text_col, keep)


def classify(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None
) -> DataFrame:
    """Rows of ``docs`` with ``held_out``, ``score`` and ``predicted`` (1 from ``ACCEPT`` on).

    The id decides only which labelled rows may train; the score comes from the text
    alone. Without usable labels every score is 0.5. Repeated rows get equal scores.
    """
    scored = with_score(docs, fit(docs, labels, id_col=id_col, text_col=text_col), text_col, keep)
    return scored.withColumn("held_out", held_out(id_col)).withColumn(
        "predicted", F.when(F.col("score") >= ACCEPT, 1).otherwise(0)
    )
