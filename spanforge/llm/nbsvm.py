"""Quality classifier: a linear support vector machine over n-gram indicators scaled by naive Bayes log-count ratios.

Features are indicators of hashed word 1- and 2-grams and, so that unseen words count too, of 1- and 2-grams of word
shapes (runs of letters and digits folded). ``r = ln((p / |p|) / (q / |q|))`` with ``p`` and ``q`` the
smoothed counts of documents of either class that hold a feature; a document is the vector of its features' ``r``, made
unit length. Hinge loss is minimised by dual coordinate descent, classes weighted to the same sum.

Labelled rows are used only where crc32 of the id, as text, leaves another remainder than 1 modulo 3. The fit takes at
most ``MOST_LABELLED`` ids of them, those with the least hash, and of their texts, in this order, as many as have
``MOST_BYTES`` together; these bounds, which are documented here and are parameters, keep the fit's size fixed while
scoring covers every row. The score is a logistic function of the margin,
fitted on the margins of a part of these rows that the machine was not fitted on (one of five, by hash).

Edge cases: null text is empty and an empty text gets the score of the bias alone; without labels of both classes the
score is the share of label 1 (0.5 without any); an id with labels that clash is not learnt from, one with the same label
twice counts once, rows that repeat an id are all learnt from; a null id is not held out and never labelled; an empty table gives an
empty result; lang, source and ids are no features.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Windows, Words, chunks, mix

BITS = 18
MOST_LABELLED, MOST_BYTES = 6000, 64 << 20
COST, EPOCHS = 1.0, 20
HELD_OUT = 1


def _shape_table() -> np.ndarray:
    """Signs by byte: lower-case letters and all bytes beyond ASCII to a, upper case to A, digits to 0, the rest as it is."""
    table = np.arange(256, dtype=np.uint8)
    table[ord("a") : ord("z") + 1] = ord("a")
    table[ord("A") : ord("Z") + 1] = ord("A")
    table[ord("0") : ord("9") + 1] = ord("0")
    table[128:] = ord("a")
    return table


_SHAPES = _shape_table()


def _shapes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Shapes of all texts with runs of one sign folded, and their offsets."""
    shape = _SHAPES[data]
    keep = np.ones(len(shape), dtype=bool)
    keep[1:] = shape[1:] != shape[:-1]
    keep[offsets[:-1][offsets[:-1] < len(shape)]] = True
    return shape[keep], np.append(0, np.cumsum(keep))[offsets]


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different features of each text, text after text, and the texts' offsets in them."""
    found = []
    for kind, (own, at) in enumerate(((data, offsets), _shapes(data, offsets))):
        words = Words(own, at)
        n, doc = len(words), np.repeat(np.arange(len(at) - 1), np.diff(words.first))
        runs = Windows(words.hashes())
        for k in (1, 2):
            if n >= k:
                h = mix(runs.of(np.arange(n - k + 1), k) ^ np.uint64(kind * 7 + k))
                same = doc[: n - k + 1] == doc[k - 1 :]
                found.append((doc[: n - k + 1][same] << BITS) | (h[same] >> np.uint64(64 - BITS)).astype(np.int64))
    both = np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)
    return both & ((1 << BITS) - 1), np.searchsorted(both >> BITS, np.arange(len(offsets)))


class Model:
    """score(features, offsets) of a fitted machine; ``weights`` has r folded in, ``scale`` is r itself."""

    def __init__(self, weights: np.ndarray, scale: np.ndarray, bias: float, slope: float, shift: float, constant: float | None = None):
        self.weights, self.scale, self.bias, self.slope, self.shift, self.constant = weights, scale, bias, slope, shift, constant

    def margins(self, ids: np.ndarray, at: np.ndarray) -> np.ndarray:
        n = len(at) - 1
        row = np.repeat(np.arange(n), np.diff(at))
        size = np.sqrt(np.bincount(row, np.square(self.scale[ids]), n))
        return np.bincount(row, self.weights[ids], n) / np.maximum(size, 1e-12) + self.bias

    def scores(self, ids: np.ndarray, at: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(at) - 1, self.constant)
        return 1 / (1 + np.exp(-np.clip(self.slope * self.margins(ids, at) + self.shift, -30, 30)))


def log_count_ratio(rows: list[np.ndarray], labels: np.ndarray) -> np.ndarray:
    size = 1 << BITS
    p = 1.0 + np.bincount(np.concatenate([r for r, y in zip(rows, labels) if y > 0]), minlength=size)
    q = 1.0 + np.bincount(np.concatenate([r for r, y in zip(rows, labels) if y < 0]), minlength=size)
    return np.log((p / p.sum()) / (q / q.sum()))


def dual_coordinate_descent(rows: list[np.ndarray], values: list[np.ndarray], labels: np.ndarray, costs: np.ndarray, epochs: int = EPOCHS, seed: int = 0) -> tuple[np.ndarray, float]:
    """Weights and bias of least hinge loss: max over 0 <= alpha_i <= cost_i of the dual, one coordinate at a time."""
    w, bias, alpha = np.zeros(1 << BITS), 0.0, np.zeros(len(rows))
    square = np.array([v @ v + 1.0 for v in values])
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        worst = 0.0
        for i in rng.permutation(len(rows)):
            gradient = labels[i] * (w[rows[i]] @ values[i] + bias) - 1
            new = min(max(alpha[i] - gradient / square[i], 0.0), costs[i])
            if (step := (new - alpha[i]) * labels[i]) != 0.0:
                w[rows[i]] += step * values[i]  # features of a row are all different
                bias += step
                alpha[i] = new
                worst = max(worst, abs(step))
        if worst < 1e-4:
            break
    return w, bias


def _calibrated(margins: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the logistic function of most likelihood, by Newton's method with a little shrinkage."""
    x = np.stack([margins, np.ones(len(margins))], axis=1)
    target, theta = (labels > 0).astype(float), np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ theta, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2), x.T @ (target - p) - 1e-3 * (theta - [1.0, 0.0]))
        theta = theta + step
        if np.abs(step).max() < 1e-9:
            break
    return (float(theta[0]), float(theta[1])) if theta[0] > 0 else (1.0, 0.0)


def fit(rows: list[np.ndarray], labels: np.ndarray, apart: np.ndarray) -> Model:
    """``labels``: 1 or -1; ``apart``: rows for the calibration only."""
    if not len(rows) or (labels > 0).all() or (labels < 0).all():
        return Model(np.zeros(1), np.zeros(1), 0.0, 1.0, 0.0, 0.5 if not len(rows) else float((labels > 0).mean()))
    used = ~apart
    if len(set(labels[used])) < 2:
        used = np.ones(len(rows), dtype=bool)
    own, y = [r for r, u in zip(rows, used) if u], labels[used]
    r = log_count_ratio(own, y)
    values = [r[x] / max(1e-12, float(np.linalg.norm(r[x]))) for x in own]
    costs = COST * len(y) / 2 / np.where(y > 0, (y > 0).sum(), (y < 0).sum())
    w, bias = dual_coordinate_descent(own, values, y, costs)
    model = Model(w * r, r, bias, 1.0, 0.0)
    check = [x for x, a in zip(rows, apart) if a] if apart.any() and len(set(labels[apart])) == 2 else rows
    truth = labels[apart] if check is not rows else labels
    margins = model.margins(np.concatenate(check), np.append(0, np.cumsum([len(x) for x in check])))
    model.slope, model.shift = _calibrated(margins, truth)
    return model


def remainder(doc_id: str) -> F.Column:
    return F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(3))


def labelled_features(docs: DataFrame, labels: DataFrame, most: int = MOST_LABELLED, most_bytes: int = MOST_BYTES) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Features, labels and calibration marks of the rows that are learnt from; none of them is held out."""
    chosen = (
        labels.select(F.col("doc_id").alias("id"), "quality").where("id is not null and quality in (0, 1)").where(remainder("id") != HELD_OUT)
        .groupBy("id").agg(F.min("quality").alias("quality"), F.max("quality").alias("other")).where("quality = other")
        .orderBy(F.xxhash64("id"), "id").limit(most)
    )
    ids = {row.id: row.quality for row in chosen.collect()}  # at most ``most``, in the order of their hashes
    whose = lambda known: F.col("id").isin(list(known)) if len(known) <= 50 else F.expr(f"id in ({','.join(map(str, known))})")
    few = docs.select(F.col("doc_id").alias("id"), F.col("text"))
    sizes = {r["id"]: r["size"] for r in few.where(whose(ids)).groupBy("id").agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0))).alias("size")).collect()}
    room = np.cumsum([sizes.get(i, 0) for i in ids])
    ids = {i: y for (i, y), upto in zip(ids.items(), room.tolist()) if upto <= most_bytes}
    few = few.where(whose(ids))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, offsets in chunks(batch.column(1)):
                found, at = features(data, offsets)
                lists = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(found.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), lists], ["id", "found"])

    table = few.mapInArrow(rows, "id long, found array<int>").toArrow()
    order = sorted(range(table.num_rows), key=lambda k: table["id"][k].as_py())
    whose = table["id"].to_pylist()
    found = [table["found"][k].values.to_numpy().astype(np.int64) for k in order]
    y = np.array([1.0 if ids[whose[k]] == 1 else -1.0 for k in order])
    apart = np.array([zlib.crc32(b"calibrate" + str(whose[k]).encode()) % 5 == 0 for k in order], dtype=bool)
    return found, y, apart


def score(docs: DataFrame, model: Model) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 2 << BITS numbers

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            for i, j, data, offsets in chunks(batch.column(1)):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(own.scores(*features(data, offsets)))], ["doc_id", "score"])

    scored = docs.select("doc_id", "text").mapInArrow(rows, "doc_id long, score double")
    return scored.select("doc_id", F.coalesce(remainder("doc_id") == HELD_OUT, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def classify(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", most: int = MOST_LABELLED) -> DataFrame:
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return score(docs, fit(*labelled_features(docs, labels, most)))
