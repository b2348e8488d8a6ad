"""Quality classifier: random-indexing word vectors, pooled, under a small network.

Each hashed word has a sparse random index vector; its context vector is the sum
of its neighbours' index vectors over all documents, for which no label is
needed. Words count twice, as themselves and as their shape (runs of capitals, letters, digits
and signs). A document is the mean of its words' context vectors, the mean of
its shapes', and the mean product of the index vectors of adjacent words, which
is large where words repeat. Two dense layers in numpy turn that into a
probability, whose temperature is fitted on labelled rows kept from training.

Defined cases: a null or empty text is the zero vector and gets a score; equal
texts get equal scores; a document labelled twice counts as 1 if one label is 1;
without labels of both classes every score is the share of ones (0.5 without
labels). Other columns are not kept.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stormframe.llm.common import crc_bucket
from stormframe.llm.labelled import bounded, sigmoid, summed, table_of, texts_of

WORDS, DIM, NONZERO, REACH, SEED = 1 << 14, 32, 6, 2, 20
#: Bound of the fit of the network: labelled rows, of which one in five fits the temperature.
ROWS, KEPT_OUT = 8000, 5
HIDDEN, STEPS, RATE, DECAY = 32, 400, 0.01, 1e-4
THRESHOLD = 0.3

_CLASSES = bytes(65 if 65 <= b < 91 else 97 if 97 <= b < 123 or b >= 128 else 48 if 48 <= b < 58 else b for b in range(256))


def _index_vectors() -> np.ndarray:
    """A few signed ones for each hashed word, from a fixed seed."""
    random = np.random.default_rng(SEED)
    out = np.zeros((WORDS, DIM), np.float32)
    at = random.integers(0, DIM, (WORDS, NONZERO))
    np.put_along_axis(out, at, random.choice(np.array([-1, 1], np.float32), (WORDS, NONZERO)), axis=1)
    return out


INDEX = _index_vectors()


def word_ids(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of a text's words, and of their shapes."""
    raw = (text or "").encode()
    classes = np.frombuffer(raw.translate(_CLASSES), np.uint8)
    runs = classes[np.flatnonzero(np.diff(classes, prepend=0))].tobytes() if len(classes) else b""
    hashed = lambda found: np.fromiter(map(zlib.crc32, found), np.int64, len(found)) & (WORDS - 1)
    return hashed(raw.split()), hashed(runs.split())


def _add_contexts(table: np.ndarray, batch: pd.DataFrame) -> None:
    """Neighbours' index vectors, for words in the first half of the columns and shapes in the second."""
    for text in batch["text"]:
        for half, ids in enumerate(word_ids(text)):
            around = np.zeros((len(ids), DIM), np.float32)
            for k in range(1, min(REACH, len(ids) - 1) + 1):
                around[k:] += INDEX[ids[:-k]]
                around[:-k] += INDEX[ids[k:]]
            if len(ids):
                order = np.argsort(ids, kind="stable")
                own, start = np.unique(ids[order], return_index=True)
                table[own, half * DIM : (half + 1) * DIM] += np.add.reduceat(around[order], start, axis=0)


@dataclass
class QualityModel:
    contexts: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    layers: tuple[np.ndarray, ...] | None
    temperature: float
    prior: float

    def pooled(self, text: str | None) -> np.ndarray:
        out = np.zeros(3 * DIM + 1, np.float32)
        for half, ids in enumerate(word_ids(text)):
            if len(ids):
                count = np.bincount(ids, minlength=1)
                own = np.flatnonzero(count)
                out[half * DIM : (half + 1) * DIM] = (count[own] / len(ids)) @ self.contexts[own, half * DIM : (half + 1) * DIM]
                if half == 0 and len(ids) > 1:
                    out[2 * DIM : 3 * DIM] = np.einsum("ij,ij->j", INDEX[ids[1:]], INDEX[ids[:-1]]) / len(ids)
                    out[3 * DIM] = (ids[1:] == ids[:-1]).mean()
        return out

    def logits(self, x: np.ndarray) -> np.ndarray:
        if self.layers is None:
            return np.full(len(x), self.prior)
        a, b, c, d = self.layers
        return (np.tanh(((x - self.mean) / self.scale) @ a + b) @ c + d)[:, 0]

    def scores(self, texts) -> list[float]:
        if not len(texts):
            return []
        x = np.array([self.pooled(t) for t in texts])
        # One row at a time, so that a score does not depend on the rows beside it.
        return [float(sigmoid(self.logits(row[None])[0] / self.temperature)) for row in x]


def fit_quality(docs: DataFrame, labels: DataFrame, learn: Column, label: str = "quality", rows: int = ROWS) -> QualityModel:
    """Learn vectors from all documents, network and temperature from at most ``rows`` labelled ones for which ``learn`` holds."""
    sample = texts_of(docs, bounded(labels, label, learn, rows))
    n = {r["label"]: r["count"] for r in sample.groupBy("label").count().collect()}
    prior = float(np.log((n.get(1, 0) + 1) / (n.get(0, 0) + 1)))
    zero = np.zeros(3 * DIM + 1, np.float32)
    if not n.get(0) or not n.get(1):
        return QualityModel(np.zeros((WORDS, 2 * DIM), np.float32), zero, zero + 1, None, 1.0, prior)
    contexts = table_of(summed(docs.select("text"), _add_contexts, WORDS, 2 * DIM), WORDS, 2 * DIM)
    for half in (slice(0, DIM), slice(DIM, 2 * DIM)):
        contexts[:, half] /= np.maximum(np.linalg.norm(contexts[:, half], axis=1, keepdims=True), 1e-6)
    contexts = contexts.astype(np.float32)
    model = QualityModel(contexts, zero, zero + 1, None, 1.0, prior)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def vectors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [shared.value.pooled(t).tobytes() for t in batch["text"]]
            yield pd.DataFrame({"doc_id": batch["doc_id"], "label": batch["label"], "x": found})

    read = sample.mapInPandas(vectors, "doc_id long, label int, x binary").toPandas().sort_values("doc_id")
    x, y = np.array([np.frombuffer(v, np.float32) for v in read["x"]]), read["label"].to_numpy(float)
    kept_out = read["doc_id"].map(lambda d: zlib.crc32(b"t%d" % d) % KEPT_OUT == 0).to_numpy()
    if len(set(y[~kept_out])) < 2:
        kept_out[:] = False
    model.mean, model.scale = x[~kept_out].mean(axis=0), x[~kept_out].std(axis=0) + 1e-3
    model.layers = _network((x[~kept_out] - model.mean) / model.scale, y[~kept_out])
    if kept_out.any():
        model.temperature = _temperature(model.logits(x[kept_out]), y[kept_out])
    return model


def _network(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, ...]:
    random = np.random.default_rng(SEED)
    w = [random.normal(0, x.shape[1] ** -0.5, (x.shape[1], HIDDEN)), np.zeros(HIDDEN), random.normal(0, HIDDEN**-0.5, (HIDDEN, 1)), np.zeros(1)]
    m, v = [np.zeros_like(p) for p in w], [np.zeros_like(p) for p in w]
    for t in range(1, STEPS + 1):
        hidden = np.tanh(x @ w[0] + w[1])
        d = (sigmoid((hidden @ w[2] + w[3])[:, 0]) - y)[:, None] / len(y)
        back = (d @ w[2].T) * (1 - hidden**2)
        grads = [x.T @ back + DECAY * w[0], back.sum(axis=0), hidden.T @ d + DECAY * w[2], d.sum(axis=0)]
        for p, g, a, b in zip(w, grads, m, v, strict=True):
            a += 0.1 * (g - a)
            b += 0.001 * (g * g - b)
            p -= RATE * (a / (1 - 0.9**t)) / (np.sqrt(b / (1 - 0.999**t)) + 1e-8)
    return tuple(w)


def _temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The divisor of the logits with the least log loss on rows kept from training."""
    grid = np.geomspace(0.25, 8, 61)
    loss = [-(y * np.log(p) + (1 - y) * np.log(1 - p)).mean() for p in (np.clip(sigmoid(logits / t), 1e-9, 1 - 1e-9) for t in grid)]
    return float(grid[int(np.argmin(loss))])


def score_quality(docs: DataFrame, model: QualityModel) -> DataFrame:
    """All columns of the documents and ``quality_score``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series(shared.value.scores(texts), dtype="float64")

    return docs.withColumn("quality_score", score("text"))


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    model = fit_quality(docs, labels, crc_bucket(F.col("doc_id"), 5) != 0)
    return score_quality(docs.select("doc_id", "text"), model).select(
        "doc_id",
        (crc_bucket(F.col("doc_id"), 5) == 0).alias("held_out"),
        F.col("quality_score").alias("score"),
        (F.col("quality_score") >= THRESHOLD).cast("int").alias("predicted"),
    )
