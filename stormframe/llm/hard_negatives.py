"""Hard negatives: an exact search for inner products in buckets of like norm.

Rows are dealt out by falling norm and cut into segments, and a segment into
buckets. No product of an anchor with a row of a bucket exceeds the product of
the anchor's norm and the bucket's greatest norm (Cauchy-Schwarz). A search asks,
for a window of scores, for the first few rows in it; a bucket whose bound lies
under the window's lower limit, or under the score of the last of the rows found
so far, is left out, and so are all buckets after it. The segments of the
greatest norms are searched first, so that the others start with a running
limit, and pairs of an anchor block and a segment that no window can reach are
never put together. What remains is worked through in blocks: a block of anchors
against a segment of rows, each of bounded bytes.

Positives come from such a search among rows of the anchor's label, with an open
window; then each positive's score sets a window for rows of other labels.

Defined cases: a row with a null id, label or vector, or with a null or
non-finite component, takes no part; nor does one whose scaled vector has a
squared length of 2**62 or more, as its products may not fit a long. Of rows with
one id the first in the order of label and vector counts. Vectors of another
length than the anchor's are not compared with it, and one of no components
scores 0. Ties go to the smaller id. An anchor without positives, and a positive
without rows in its window, give no row. Other columns are not kept.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stormframe.llm.common import stored

SCALE, ANCHOR_EVERY, COUNT, LEAST_PERCENT = 256, 100, 5, 80


class Sizes(NamedTuple):
    """Rows of a bucket; bytes of a segment's and of a block's vectors."""

    bucket: int = 1024
    segment: int = 4 << 20
    block: int = 2 << 20


SIZES = Sizes()
#: Windows that are weighed at once.
AT_ONCE = 1024
#: Metadata of segments and blocks are joined in so many parts.
PARTS = 16
LARGEST = 2.0**62
NONE = np.iinfo(np.int64).min


def usable(rows: DataFrame, id_col: str, vector_col: str, label: Column, scale: float = SCALE) -> DataFrame:
    """``id, label, vector, squared``: the rows that take part, their components scaled and rounded down."""
    told = rows.select(F.col(id_col).cast("long").alias("id"), label.cast("long").alias("label"), F.col(vector_col).alias("raw"))
    finite, scaled, length = _over("raw", scale)
    told = told.filter("id is not null and label is not null and raw is not null").filter(finite).withColumn("squared", length)
    told = told.filter(F.col("squared") < LARGEST).select("id", "label", scaled.alias("vector"), "squared")
    twice = stored(told.groupBy("id").agg(F.count("*").alias("n")).filter("n > 1").select("id"))
    if twice.isEmpty():
        return told
    first = told.join(twice, "id").groupBy("id").agg(F.min(F.struct("label", "vector", "squared")).alias("r")).select("id", "r.*")
    return told.join(twice, "id", "left_anti").unionByName(first)


def _over(column: str, scale: float) -> tuple[Column, Column, Column]:
    """Whether a vector is finite, its scaled components, and their squared length."""
    down = lambda x: F.floor(x.cast("double") * scale)
    finite = F.forall(column, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    length = F.aggregate(column, F.lit(0.0), lambda s, x: s + down(x).cast("double") * down(x).cast("double"))
    return finite, F.transform(column, down), length


PACK = "pack long, width int, top double, n int, ids binary, labels binary, vectors binary, tops binary"


def packed(rows: DataFrame, limit: int, bucket: int) -> DataFrame:
    """Rows by width and falling norm in packs of at most ``limit`` bytes; in each bucket of a pack they stand by id.

    ``top`` is a pack's greatest norm, ``tops`` that of each bucket.
    """

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept: list[tuple] = []
        for batch in batches:
            for row in zip(batch["width"], batch["id"], batch["label"], batch["squared"], batch["vector"], strict=True):
                if kept and (row[0] != kept[0][0] or len(kept) >= max(bucket, limit // (8 * max(1, row[0])))):
                    yield _pack(kept, bucket)
                    kept = []
                kept.append(row)
        if kept:
            yield _pack(kept, bucket)

    order = [F.col("width"), F.desc("squared"), F.col("id")]
    dealt = rows.withColumn("width", F.size("vector")).repartitionByRange(*order).sortWithinPartitions(*order)
    out = dealt.mapInPandas(pack, PACK.replace("pack long, ", ""))
    return stored(out.withColumn("pack", F.monotonically_increasing_id()))


def _pack(rows: list[tuple], bucket: int) -> pd.DataFrame:
    width, n = int(rows[0][0]), len(rows)
    ids, labels = (np.array([r[k] for r in rows], np.int64) for k in (1, 2))
    norms = np.sqrt(np.array([r[3] for r in rows], np.float64))
    vectors = np.array([r[4] for r in rows], np.int64).reshape(n, width)
    order = np.concatenate([k + np.argsort(ids[k : k + bucket], kind="stable") for k in range(0, n, bucket)])
    tops = np.array([norms[k] for k in range(0, n, bucket)])
    row = (width, norms[0], n, ids[order].tobytes(), labels[order].tobytes(), vectors[order].tobytes(), tops.tobytes())
    return pd.DataFrame([row], columns=["width", "top", "n", "ids", "labels", "vectors", "tops"])


#: Rounding of a bound of norms, which are square roots.
SLACK = 1 + 1e-9


def first_in_windows(anchors: dict, ask: np.ndarray, same: bool, segment: dict, count: int, bucket: int) -> np.ndarray:
    """``(window, id, score)`` of the first rows of a segment in each window.

    A row of ``ask`` is a window: the anchor's place, its lowest and highest
    score, and the score that a row must reach to be among the first so far.
    """
    place, low, high, reach = ask.T
    low = np.maximum(low, reach)
    norm = anchors["norms"][place]
    scores, ids = np.full((len(ask), count), NONE), np.full((len(ask), count), np.iinfo(np.int64).max)
    for k, top in enumerate(segment["tops"]):
        cut = slice(k * bucket, (k + 1) * bucket)
        own = segment["ids"][cut]
        limit = np.maximum(low, scores[:, -1])
        live = np.flatnonzero(norm * top * SLACK >= limit)
        if not len(live):
            break
        for at in range(0, len(live), AT_ONCE):
            w = live[at : at + AT_ONCE]
            rows, back = np.unique(place[w], return_inverse=True)
            product = _products(anchors["vectors"][rows], segment["vectors"][cut])[back]
            fits = (segment["labels"][cut] == anchors["labels"][place[w], None]) == same
            fits &= (own != anchors["ids"][place[w], None]) & (product >= limit[w, None]) & (product <= high[w, None])
            some = np.flatnonzero(fits.any(axis=1))
            if not len(some):
                continue
            best = _first(np.where(fits[some], product[some], NONE), count)
            new = np.take_along_axis(product[some], best, 1)
            new[~np.take_along_axis(fits[some], best, 1)] = NONE
            both, names = np.hstack([scores[w[some]], new]), np.hstack([ids[w[some]], own[best]])
            order = np.lexsort((names, -np.maximum(both, NONE + 1)), axis=1)[:, :count]
            scores[w[some]], ids[w[some]] = np.take_along_axis(both, order, 1), np.take_along_axis(names, order, 1)
    window, rank = np.nonzero(scores > NONE)
    return np.column_stack([window, ids[window, rank], scores[window, rank]])


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer products: in doubles while they hold each partial sum."""
    if a.size and b.size and float(np.abs(a).max()) * float(np.abs(b).max()) * a.shape[1] < 2.0**53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a @ b.T


def _first(product: np.ndarray, count: int) -> np.ndarray:
    """Places of the greatest values of each row, earlier places first among equals."""
    size = product.shape[1]
    if size <= count:
        return np.argsort(-np.maximum(product, NONE + 1), axis=1, kind="stable")
    if abs(product[product > NONE]).max(initial=0) < (1 << 62) // size:
        key = np.where(product > NONE, product * size + (size - 1 - np.arange(size)), NONE)
        return np.argpartition(key, size - count, axis=1)[:, size - count :]
    return np.argsort(-np.maximum(product, NONE + 1), axis=1, kind="stable")[:, :count]


def _opened(row: pd.Series) -> dict:
    vectors = np.frombuffer(row["vectors"], np.int64).reshape(int(row["n"]), int(row["width"]))
    return {
        "ids": np.frombuffer(row["ids"], np.int64),
        "labels": np.frombuffer(row["labels"], np.int64),
        "tops": np.frombuffer(row["tops"], np.float64),
        "vectors": vectors,
        "norms": np.sqrt((vectors.astype(np.float64) ** 2).sum(axis=1)),
    }


def search(anchors: DataFrame, segments: DataFrame, asked: DataFrame, same: bool, count: int, bucket: int) -> DataFrame:
    """``window, id, score``: the first rows, by score and id, in each window of ``asked: window, block, place, low, high``."""
    payload = lambda df, key, s: df.select(F.col("pack").alias(key), *[F.col(c).alias(c + s) for c in ("width", "n", "ids", "labels", "vectors", "tops")])
    told = segments.select(F.col("pack").alias("segment"), F.col("width"), F.col("top").alias("segment_top"))
    lead = told.groupBy("width").agg(F.max_by("segment", F.struct("segment_top", "segment")).alias("segment"))
    blocks = anchors.select(F.col("pack").alias("block"), "width", F.col("top").alias("block_top"))

    def run(group: pd.DataFrame) -> pd.DataFrame:
        row = group.iloc[0]
        block, segment = (_opened(row[[c + s for c in ("width", "n", "ids", "labels", "vectors", "tops")]].rename(lambda c: c[:-1])) for s in "ab")
        ask = np.stack([np.asarray(row[c], np.int64) for c in ("places", "lows", "highs", "reaches")], axis=1)
        found = first_in_windows(block, ask, same, segment, count, bucket)
        return pd.DataFrame({"window": np.asarray(row["windows"], np.int64)[found[:, 0]], "id": found[:, 1], "score": found[:, 2]})

    def round_of(pairs: DataFrame, windows: DataFrame) -> DataFrame:
        listed = F.collect_list(F.struct("place", "low", "high", "reach", "window"))
        names = {"places": "place", "lows": "low", "highs": "high", "reaches": "reach", "windows": "window"}
        asks = windows.groupBy("block").agg(listed.alias("w")).select("block", *[F.col("w")[c].alias(n) for n, c in names.items()])
        ready = pairs.join(payload(segments, "segment", "b"), "segment").join(payload(anchors, "block", "a").join(asks, "block"), "block")
        return stored(ready.groupBy("segment", "block").applyInPandas(run, "window long, id long, score long"))

    open_ = asked.withColumn("reach", F.lit(NONE + 1))
    first = round_of(blocks.join(lead, "width").select("block", "segment"), open_)
    ended = first.groupBy("window").agg(F.count("*").alias("n"), F.min("score").alias("s")).filter(F.col("n") >= count).select("window", F.col("s").alias("reached"))
    asked = stored(asked.join(ended, "window", "left").withColumn("reach", F.coalesce("reached", F.lit(NONE + 1))).drop("reached"))
    least = asked.groupBy("block").agg(F.min(F.greatest("low", "reach")).alias("least"))
    # The greatest product of a block and a segment must reach the least limit of the block's windows.
    others = told.join(lead.select("segment"), "segment", "left_anti").withColumn("part", F.pmod(F.xxhash64("segment"), F.lit(PARTS)))
    spread = blocks.join(least, "block").withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
    pairs = others.join(spread, ["width", "part"]).filter(F.col("segment_top") * F.col("block_top") * SLACK >= F.col("least")).select("block", "segment")
    rest = round_of(pairs, asked)
    rank = F.row_number().over(Window.partitionBy("window").orderBy(F.desc("score"), "id"))
    return first.unionByName(rest).withColumn("rank", rank).filter(F.col("rank") <= count)


def anchor_places(anchors: DataFrame) -> DataFrame:
    """``block, place, anchor`` of each row of anchor packs."""

    def places(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for block, ids in zip(batch["pack"], batch["ids"], strict=True):
                ids = np.frombuffer(ids, np.int64)
                yield pd.DataFrame({"block": block, "place": np.arange(len(ids)), "anchor": ids})

    return anchors.select("pack", "ids").mapInPandas(places, "block long, place long, anchor long")


def hard_negatives(
    rows: DataFrame, anchor: Column | None = None, id_col: str = "vec_id", vector_col: str = "embedding", label: Column | None = None, count: int = COUNT, least_percent: int = LEAST_PERCENT, sizes: Sizes = SIZES
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    ``anchor`` is a condition on ``id``; without it all rows whose id is divisible by 100 are anchors.
    """
    used = stored(usable(rows, id_col, vector_col, F.col("label") if label is None else label))
    segments = packed(used, sizes.segment, sizes.bucket)
    anchors = packed(used.filter(F.col("id") % ANCHOR_EVERY == 0 if anchor is None else anchor), sizes.block, sizes.bucket)
    places = stored(anchor_places(anchors).withColumn("window", F.monotonically_increasing_id()))
    everything = places.select("window", "block", "place", F.lit(NONE + 1).alias("low"), F.lit(-(NONE + 1)).alias("high"))
    positives = search(anchors, segments, everything, True, count, sizes.bucket).join(places, "window")
    windows = positives.select("block", "place", "anchor", F.col("id").alias("positive"), F.col("score").alias("high"))
    # Scores are under 2**62, so the percentage is taken of quotient and remainder apart.
    whole, part = F.expr("high div 100"), F.col("high") % 100
    low = whole * least_percent + F.ceil(part * least_percent / 100)
    windows = stored(windows.withColumn("low", low.cast("long")).filter("low <= high").withColumn("window", F.monotonically_increasing_id()))
    found = search(anchors, segments, windows.select("window", "block", "place", "low", "high"), False, count, sizes.bucket)
    names = {"anchor": "anchor_id", "positive": "positive_id", "id": "negative_id", "high": "positive_score", "score": "negative_score"}
    out = found.join(windows.select("window", "anchor", "positive", "high"), "window").withColumnsRenamed(names)
    return out.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")


def negatives_digest(embeddings: DataFrame, sizes: Sizes = SIZES) -> DataFrame:
    """The contract's labels: ids divisible by 7 have the next label."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(embeddings.select("vec_id", "embedding", "label"), label=label, sizes=sizes)
