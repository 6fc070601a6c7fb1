"""Quality classifier: naive Bayes log-count ratios scale n-gram indicators of a linear support vector machine."""

from __future__ import annotations

import math
from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parcelworks.llm.common import tune

#: Bits of a feature's number, byte n-gram lengths, and the bound of the labelled sample that the model is fitted on.
BITS, ORDERS, SAMPLE = 18, (1, 2, 3), 4000


def indicators(text: str | None, bits: int = BITS, orders: tuple[int, ...] = ORDERS) -> np.ndarray:
    """Sorted numbers of the n-grams that occur in the whole text: byte n-grams hashed to ``bits`` bits, and as numbers 0
    to 3 the word pair of a word and itself, if it occurs at least 1, 3, 10 or 30 times."""
    data = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8).astype(np.uint64)
    seen = np.zeros(1 << bits, bool)
    gram = np.zeros(len(data), np.uint64)
    for n in range(1, max(orders) + 1):
        if len(data) < n:
            break
        gram = (gram[: len(data) - n + 1] << np.uint64(8)) | data[n - 1 :]
        if n in orders:
            seen[((gram + np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)] = True
    words = (text or "").split()
    seen[:4] = [sum(map(eq, words, words[1:])) >= n for n in (1, 3, 10, 30)]
    return np.flatnonzero(seen).astype(np.int32)


class Classifier:
    """Weights of the features, an offset, and the slope and offset that turn a margin into a probability."""

    def __init__(self, features: list[np.ndarray], labels: np.ndarray, bits: int = BITS, cost: float = 1.0, blend: float = 0.25, seed: int = 1):
        self.bits = bits
        self.weights, self.offset, self.slope, self.shift = np.zeros(1 << bits), 0.0, 0.0, 0.0
        n, good = len(labels), int(labels.sum())
        self.prior = (good + 1) / (n + 2)
        if not 0 < good < n:  # one class or none: the prior is all there is to say
            self.shift = math.log(self.prior / (1 - self.prior))
            return
        order = np.random.default_rng(seed).permutation(n)
        margins = np.zeros(n)
        for part in range(2):  # margins of rows that the fit has not seen set the probabilities
            out = np.zeros(n, bool)
            out[order[part::2]] = True
            if 0 < labels[~out].sum() < (~out).sum():
                w, b = _fit([f for f, o in zip(features, out, strict=True) if not o], labels[~out], bits, cost, blend, seed)
                margins[out] = [w[f].sum() + b for f, o in zip(features, out, strict=True) if o]
        self.weights, self.offset = _fit(features, labels, bits, cost, blend, seed)
        self.slope, self.shift = _platt(margins, labels)
        self.weights = self.weights.astype(np.float32)

    def score(self, features: np.ndarray) -> float:
        z = self.slope * (float(self.weights[features].sum(dtype=np.float64)) + self.offset) + self.shift
        return 1 / (1 + math.exp(-z)) if z > -700 else 0.0


def _fit(features: list[np.ndarray], labels: np.ndarray, bits: int, cost: float, blend: float, seed: int, rounds: int = 12) -> tuple[np.ndarray, float]:
    """Weights and offset: dual coordinate descent for the hinge loss over indicators times their log-count ratio."""
    y = np.where(labels == 1, 1.0, -1.0)
    counts = np.ones((2, 1 << bits))
    for f, label in zip(features, labels, strict=True):
        counts[int(label)][f] += 1
    ratio = np.log(counts[1] / counts[1].sum()) - np.log(counts[0] / counts[0].sum())
    norm = np.array([1.0 / math.sqrt(float((ratio[f] ** 2).sum()) + 1) for f in features])  # rows of unit length, offset included
    rows = [np.append(ratio[f] * s, s) for f, s in zip(features, norm, strict=True)]
    at = [np.append(f, 1 << bits) for f in features]
    square = np.array([float(r @ r) for r in rows])
    share = [len(y) / (2 * max(1, int((labels == k).sum()))) for k in (0, 1)]  # both classes weigh the same
    most = np.array([cost * share[int(k)] for k in labels])
    alpha, w = np.zeros(len(y)), np.zeros((1 << bits) + 1)
    rng = np.random.default_rng(seed)
    for _ in range(rounds):
        moved = 0.0
        for i in rng.permutation(len(y)):
            gradient = y[i] * float(w[at[i]] @ rows[i]) - 1
            new = min(max(alpha[i] - gradient / square[i], 0.0), most[i])
            if new != alpha[i]:
                w[at[i]] += (new - alpha[i]) * y[i] * rows[i]
                moved = max(moved, abs(new - alpha[i]))
                alpha[i] = new
        if moved < 1e-3:
            break
    w[:-1] *= ratio
    used = w[:-1] != 0
    if used.any():  # drawn towards the mean weight, as pure naive Bayes would have it
        w[:-1][used] = (1 - blend) * w[:-1][used] + blend * float(np.abs(w[:-1][used]).mean()) * np.sign(w[:-1][used])
    return w[:-1], float(w[-1])


def _platt(margins: np.ndarray, labels: np.ndarray, rounds: int = 100) -> tuple[float, float]:
    """Slope and shift of the logistic curve through margins and labels, by Newton steps with smoothed targets."""
    good, bad = int(labels.sum()), int(len(labels) - labels.sum())
    target = np.where(labels == 1, (good + 1) / (good + 2), 1 / (bad + 2))
    scale = float(np.abs(margins).mean()) or 1.0
    x = np.stack([margins / scale, np.ones(len(margins))], 1)
    a = np.array([0.0, math.log((good + 1) / (bad + 1))])
    loss = lambda v: float(np.logaddexp(0, x @ v).sum() - target @ (x @ v))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ a, -500, 500)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-9 * np.eye(2), x.T @ (target - p))
        size = 1.0
        while size > 1e-6 and loss(a + size * step) > loss(a):
            size /= 2
        a = a + size * step
        if np.abs(size * step).max() < 1e-8:
            break
    return float(a[0] / scale), float(a[1])


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, bits: int = BITS) -> Classifier:
    """Fit on at most ``sample`` of the labelled rows, those of least hash of their id.

    ``docs`` is (doc_id, text), ``labels`` (doc_id, label 0 or 1); other labels and null ids are left out, and an id
    with several labels counts with the least, one with several texts with the greatest. Only the sample's feature numbers reach the driver.
    """
    tune(docs.sparkSession)
    chosen = labels.where("doc_id is not null and label in (0, 1)").groupBy("doc_id").agg(F.min("label").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "label").agg(F.max("text").alias("text")).select("doc_id", "text", F.col("label").cast("int").alias("label"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [indicators(t, bits).tobytes() for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.binary()), batch.column(2)], names=["doc_id", "features", "label"])

    found = rows.mapInArrow(run, "doc_id long, features binary, label int").toArrow()
    order = np.argsort(found.column("doc_id").to_numpy(), kind="stable")
    features = [np.frombuffer(f.as_py(), np.int32) for f in found.column("features")]
    return Classifier([features[i] for i in order], found.column("label").to_numpy()[order].astype(np.int64) if len(order) else np.empty(0, np.int64), bits)


def score(docs: DataFrame, model: Classifier, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score): the probability of label 1 from the whole text; null and empty texts get the features of none.

    Rows are kept as they are, repeated ones and such with a null id too.
    """
    tune(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [model.score(indicators(t, model.bits)) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], names=["doc_id", "score"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, score double")


def keep_good(docs: DataFrame, model: Classifier, threshold: float, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, with all their columns, that score ``threshold`` or more."""
    tune(docs.sparkSession)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array([model.score(indicators(t, model.bits)) >= threshold for t in batch.column(at).to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
