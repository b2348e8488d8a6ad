"""Toxicity: a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

The n-grams of the lower-cased text are hashed into a table of fixed size; a
feature is the presence of a bucket. Over a bounded sample of labelled rows the
log ratio of a bucket's smoothed rates in both classes is taken, the buckets
with the surest difference are kept, and a logistic regression is fitted on
presence times ratio. Scoring reads whole texts and moves nothing.

Defined cases: a null or empty text has no features and gets the score of the
intercept; a text shorter than an n-gram has none of that length; equal texts
get equal scores; a document labelled twice counts as 1 if one label is 1;
without labels of both classes every score is the share of ones (0.5 without
labels). Other columns are not kept.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stormframe.llm.common import crc_bucket
from stormframe.llm.labelled import bounded, sigmoid, summed, table_of, texts_of

LENGTHS, BUCKETS = (4, 6), 1 << 20
#: Bounds of the fit: labelled rows of each class, and features.
ROWS, FEATURES = 5000, 20_000
THRESHOLD = 0.3
SMOOTH, DECAY, STEPS, BATCH, RATE, SUPPORT, SURE, SEED = 1.0, 1e-3, 300, 512, 0.05, 3, 2.0, 6


def buckets(text: str) -> np.ndarray:
    """The bucket of every n-gram of a text, in order, with repeats."""
    c = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)
    found = []
    for n in LENGTHS:
        if len(c) >= n:
            h = np.full(len(c) - n + 1, n, np.uint32)
            for k in range(n):
                h = (h ^ c[k : len(c) - n + 1 + k]) * np.uint32(0x9E3779B1)
            found.append((h ^ (h >> np.uint32(15))) & np.uint32(BUCKETS - 1))
    return np.concatenate(found) if found else np.zeros(0, np.uint32)


@dataclass
class ToxicityModel:
    """``place`` maps a bucket to its feature or -1; ``weight`` holds ratio times coefficient."""

    place: np.ndarray
    weight: np.ndarray
    intercept: float

    def present(self, text: str | None) -> np.ndarray:
        at = self.place[buckets(text or "")]
        return np.unique(at[at >= 0])

    def score(self, text: str | None) -> float:
        return float(sigmoid(np.array(self.intercept + self.weight[self.present(text)].sum())))


def _count(table: np.ndarray, batch: pd.DataFrame) -> None:
    for text, label in zip(batch["text"], batch["label"], strict=True):
        table[np.unique(buckets(text)), int(label)] += 1


def fit_toxicity(docs: DataFrame, labels: DataFrame, learn: Column, label: str = "toxic", rows: int = ROWS) -> ToxicityModel:
    """Learn from at most ``rows`` labelled documents of each class for which ``learn`` holds."""
    known = labels.filter(learn & F.col("doc_id").isNotNull() & F.col(label).isin(0, 1))
    ones, zeros = (known.agg(F.count_if(F.col(label) == k).alias("n")).first()["n"] for k in (1, 0))
    empty = ToxicityModel(np.full(BUCKETS, -1, np.int32), np.zeros(0), float(np.log((ones + 1) / (zeros + 1))))
    if not ones or not zeros:
        return empty
    chosen = bounded(known, label, F.col(label) == 1, rows).unionByName(bounded(known, label, F.col(label) == 0, rows))
    sample = texts_of(docs, chosen.groupBy("doc_id").agg(F.max("label").alias("label")))
    n = {r["label"]: r["count"] for r in sample.groupBy("label").count().collect()}
    if len(n) < 2:
        return empty
    seen = table_of(summed(sample, _count, BUCKETS, 2), BUCKETS, 2)
    rate = (seen + SMOOTH) / (np.array([n[0], n[1]]) + 2 * SMOOTH)
    spread = np.sqrt((rate * (1 - rate) / np.array([n[0], n[1]])).sum(axis=1))
    sure = np.where(seen.sum(axis=1) >= SUPPORT, np.abs(rate[:, 1] - rate[:, 0]) / spread, 0)
    kept = np.sort(np.argsort(-sure, kind="stable")[:FEATURES])
    kept = kept[sure[kept] >= SURE]
    ratio = np.log(rate[kept, 1] / rate[kept, 0])
    place = np.full(BUCKETS, -1, np.int32)
    place[kept] = np.arange(len(kept))
    model = ToxicityModel(place, ratio, 0.0)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [shared.value.present(t).astype("<i4").tobytes() for t in batch["text"]]
            yield pd.DataFrame({"doc_id": batch["doc_id"], "label": batch["label"], "at": found})

    read = sample.mapInPandas(features, "doc_id long, label int, at binary").toPandas().sort_values("doc_id")
    coefficient, intercept = _regression([np.frombuffer(x, "<i4") for x in read["at"]], read["label"].to_numpy(float), ratio)
    # The sample is balanced; the labels need not be.
    prior = np.log(ones / zeros) - np.log(n[1] / n[0])
    return ToxicityModel(place, ratio * coefficient, float(intercept + prior))


def _regression(at: list[np.ndarray], y: np.ndarray, ratio: np.ndarray) -> tuple[np.ndarray, float]:
    """Logistic regression on presence times ratio, by Adam on batches of rows in a fixed order, at a falling rate.

    A step costs the same however many rows the sample has; a sample of one batch is used whole in every step.
    """
    random, size = np.random.default_rng(SEED), min(BATCH, len(y))
    w, m, v = np.zeros(len(ratio) + 1), np.zeros(len(ratio) + 1), np.zeros(len(ratio) + 1)
    queue = np.zeros(0, np.int64)
    for t in range(1, STEPS + 1):
        if len(queue) < size:
            queue = np.concatenate([queue, random.permutation(len(y))])
        batch, queue = queue[:size], queue[size:]
        row, col = np.repeat(np.arange(size), [len(at[k]) for k in batch]), np.concatenate([at[k] for k in batch])
        value = ratio[col]
        off = sigmoid(np.bincount(row, value * w[col], size) + w[-1]) - y[batch]
        g = np.append(np.bincount(col, value * off[row], len(ratio)) / size + DECAY * w[:-1], off.mean())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= RATE * (1 - (t - 1) / STEPS) * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w[:-1], float(w[-1])


def score_toxicity(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """``doc_id, score`` of every whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def scores(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"doc_id": batch["doc_id"], "score": [shared.value.score(t) for t in batch["text"]]})

    return docs.select("doc_id", "text").mapInPandas(scores, "doc_id long, score double")


def toxicity_digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    model = fit_toxicity(docs, labels, crc_bucket(F.col("doc_id"), 4) != 2)
    return score_toxicity(docs, model).select(
        "doc_id",
        (crc_bucket(F.col("doc_id"), 4) == 2).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )
