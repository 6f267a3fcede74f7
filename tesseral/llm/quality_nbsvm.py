"""Quality classifier: naive Bayes support vectors.

Binary indicators of hashed byte 3- and 4-grams, and of bigrams of one word twice, are scaled by the log-count ratios of the two classes; a linear
hinge-loss model is fitted to them by dual coordinate descent; a logistic curve turns margins to probabilities.
"""

from __future__ import annotations

from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .common import text_of
from .features import BITS, buckets, sample

GRAMS = 2 << BITS
#: Bigrams of a word and itself, whichever word: one indicator for each share of a text's bigrams that they pass.
SAME = (0.02, 0.1, 0.3, 0.6)
SIZE = GRAMS + 8
#: The labelled rows that the model is fitted on, at most about so many.
FIT_ROWS = 4000
THRESHOLD = 0.3


def indicators(data: np.ndarray) -> np.ndarray:
    """Distinct features of one text, ascending."""
    seen = np.zeros(SIZE, bool)
    seen[buckets(data, 3)] = True
    seen[1 << BITS :][buckets(data, 4)] = True
    words = data.tobytes().split()
    same = sum(map(eq, words, words[1:]))
    for i, share in enumerate(SAME):
        seen[GRAMS + i] = same > share * (len(words) - 1) and same > 2
    return np.flatnonzero(seen)


@dataclass
class Model:
    weights: np.ndarray
    bias: float
    slope: float
    offset: float

    def score(self, data: np.ndarray) -> float:
        found = indicators(data)
        margin = (float(self.weights[found].sum()) / np.sqrt(len(found)) if len(found) else 0.0) + self.bias
        return float(1 / (1 + np.exp(-np.clip(self.slope * margin + self.offset, -50, 50))))


def descend(rows: list[np.ndarray], scale: np.ndarray, y: np.ndarray, cost: np.ndarray, epochs: int, seed: int) -> tuple[np.ndarray, float]:
    """min |w|^2 / 2 + sum cost_i * hinge(y_i (w.x_i + b)) by coordinate descent in the dual; x has unit-length scaling.

    The bias is the weight of a constant feature 1.
    """
    n = len(rows)
    w, b, alpha = np.zeros(SIZE), 0.0, np.zeros(n)
    norm = [np.sqrt(max(1, len(r))) for r in rows]
    square = np.array([float(scale[r] @ scale[r]) / m**2 + 1.0 for r, m in zip(rows, norm, strict=True)])
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        moved = 0.0
        for i in rng.permutation(n):
            value = scale[rows[i]] / norm[i]
            gradient = y[i] * (w[rows[i]] @ value + b) - 1.0
            new = min(max(alpha[i] - gradient / square[i], 0.0), cost[i])
            step = (new - alpha[i]) * y[i]
            if step:
                w[rows[i]] += step * value
                b += step
                moved = max(moved, abs(step))
            alpha[i] = new
        if moved < 1e-4:
            break
    return w, b


def logistic(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of P(y = 1 | margin), by Newton steps on smoothed targets."""
    pos, neg = max(1, int((y > 0).sum())), max(1, int((y < 0).sum()))
    target = np.where(y > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
    a, b = 1.0, float(np.log(pos / neg))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * margin + b, -50, 50)))
        r = p - target
        h = np.maximum(p * (1 - p), 1e-9)
        g = np.array([r @ margin + 1e-3 * (a - 1), r.sum()])
        hess = np.array([[h @ (margin * margin) + 1e-3, h @ margin], [h @ margin, h.sum() + 1e-3]])
        step = np.linalg.solve(hess, g)
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-6:
            break
    return (a, b) if a > 0 else (1.0, float(np.log(pos / neg)))


def fit_rows(rows: list[np.ndarray], labels: list[int], smooth: float = 1.0, cost: float = 1.0, epochs: int = 12, seed: int = 2) -> Model:
    """A model of the labelled rows; with one class only, or none, it says how common the class is."""
    y = np.where(np.asarray(labels, np.int64) == 1, 1.0, -1.0)
    if not len(y) or len(set(y)) < 2:
        share = 0.5 if not len(y) else (1 - 1e-3 if y[0] > 0 else 1e-3)
        return Model(np.zeros(SIZE), 0.0, 1.0, float(np.log(share / (1 - share))))
    counts = np.full((2, SIZE), smooth)
    for row, side in zip(rows, y, strict=True):
        counts[int(side > 0), row] += 1
    ratio = np.log(counts[1] / counts[1].sum()) - np.log(counts[0] / counts[0].sum())
    share = (y > 0).mean()
    weight = cost * np.where(y > 0, 0.5 / share, 0.5 / (1 - share))
    fold = np.random.default_rng(seed).integers(0, 3, len(y))
    margin = np.zeros(len(y))
    for f in range(3):  # margins of rows that the weights have not seen, for the curve
        own = np.flatnonzero(fold != f)
        if len(set(y[own])) < 2:
            continue
        w, b = descend([rows[i] for i in own], ratio, y[own], weight[own], max(2, epochs // 2), seed)
        w = w * ratio
        for i in np.flatnonzero(fold == f):
            margin[i] = w[rows[i]].sum() / np.sqrt(max(1, len(rows[i]))) + b
    slope, offset = logistic(margin, y)
    w, b = descend(rows, ratio, y, weight, epochs, seed)
    return Model(w * ratio, b, slope, offset)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", rows: int = FIT_ROWS, seed: int = 2) -> Model:
    """Learns from labels whose crc32(id as text) mod 5 is not 0; null ids, labels and labels other than 0 and 1 are left out."""
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).where("id IS NOT NULL AND y IN (0, 1)")
    known = known.where(~held_out(F.col("id"))).groupBy("id").agg(F.max("y").alias("y"))
    texts = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text")).where("id IS NOT NULL")

    def run(batches):
        for batch in batches:
            found = []
            for _, _, data, offsets in K.chunks(batch.column("text")):
                for i in range(len(offsets) - 1):
                    seen = np.zeros(SIZE, bool)  # as bits, so that no text sends more than SIZE / 8 bytes
                    seen[indicators(data[offsets[i] : offsets[i + 1]])] = True
                    found.append(np.packbits(seen).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("y"), pa.array(found, pa.binary())], names=["id", "y", "grams"])

    drawn = sample(texts, known, rows, seed, "id").select("id", "y", "text").mapInArrow(run, "id long, y int, grams binary").toArrow().sort_by([("id", "ascending"), ("grams", "ascending")])
    grams = [np.flatnonzero(np.unpackbits(np.frombuffer(x.as_buffer(), np.uint8), count=SIZE)).astype(np.int32) for x in drawn.column("grams")]
    return fit_rows(grams, drawn.column("y").to_pylist(), seed=seed)


def held_out(column, folds: int = 5, fold: int = 0):
    """Whether crc32 of the id as text leaves that remainder; a null id is not held out."""
    return F.coalesce(F.crc32(column.cast("string").cast("binary")) % folds == fold, F.lit(False))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(id, score, predicted) for every row, by the text alone. A null text scores as an empty one: by the bias."""
    shared = docs.sparkSession.sparkContext.broadcast(Model(model.weights.astype(np.float32), model.bias, model.slope, model.offset))

    def run(batches):
        model = shared.value
        for batch in batches:
            found = [model.score(data[offsets[i] : offsets[i + 1]]) for _, _, data, offsets in K.chunks(batch.column(1)) for i in range(len(offsets) - 1)]
            found = np.array(found, np.float64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found), pa.array((found >= threshold).astype(np.int32))], names=[id_col, "score", "predicted"])

    kind = dict(docs.dtypes)[id_col]
    return docs.select(id_col, text_of(text_col).alias("text")).mapInArrow(run, f"`{id_col}` {kind}, score double, predicted int")


def keep_good(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows that the model accepts, with all their columns; no shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(Model(model.weights.astype(np.float32), model.bias, model.slope, model.offset))
    at = docs.columns.index(text_col)

    def run(batches):
        model = shared.value
        for batch in batches:
            good = [model.score(data[offsets[i] : offsets[i + 1]]) >= threshold for _, _, data, offsets in K.chunks(batch.column(at).cast(pa.string())) for i in range(len(offsets) - 1)]
            yield batch.filter(pa.array(good, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
