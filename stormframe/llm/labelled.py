"""Bounded samples of labelled rows, and sums of dense tables over all partitions."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stormframe.llm.common import checkpointed

#: Partitions that a bounded sample is read in; bytes of a table that are summed together; groups that partial sums are added up in first.
PARTS, CHUNK_BYTES, SHARES = 8, 1 << 16, 64


def bounded(labels: DataFrame, label: str, wanted: Column, rows: int) -> DataFrame:
    """At most ``rows`` labelled ids in the order of a hash of the id, which no source or time follows."""
    known = labels.filter(wanted & F.col("doc_id").isNotNull() & F.col(label).isin(0, 1)).groupBy("doc_id").agg(F.max(label).alias("label"))
    return known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)


def texts_of(docs: DataFrame, chosen: DataFrame) -> DataFrame:
    """``label, text`` of the chosen ids: a bounded side is sent to the texts, which stay where they are."""
    found = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "label", F.coalesce("text", F.lit("")).alias("text"))
    # The few rows found are dealt out anew; merging partitions instead would read all texts in as few tasks.
    return checkpointed(found.repartition(PARTS))


def _chunk(width: int) -> int:
    """Rows of a 32-bit table of that width in a chunk."""
    return max(1, CHUNK_BYTES // (4 * width))


def summed(texts: DataFrame, add: Callable[[np.ndarray, pd.DataFrame], None], rows: int, width: int) -> DataFrame:
    """A dense (rows, width) table of sums, as ``chunk, sums`` rows of 64-bit numbers.

    ``add`` puts a batch into its partition's table of 32-bit numbers. Its chunks
    that hold anything are then added one after the other, first in SHARES
    groups, then in one for each chunk, so that a task holds one table and one
    batch however many partitions there are. Sums of whole numbers are the same in any order.
    """
    step = _chunk(width)

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table = np.zeros((rows, width), np.float32)
        for batch in batches:
            add(table, batch)
        for k in range(0, rows, step):
            part = table[k : k + step]
            if part.any():
                yield pd.DataFrame({"chunk": [k], "sums": [part.astype(np.float64).tobytes()]})

    def total(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for chunk, raw in zip(batch["chunk"], batch["sums"], strict=True):
                part = np.frombuffer(raw, np.float64)
                sums[chunk] = sums[chunk] + part if chunk in sums else part
        for chunk, part in sums.items():
            yield pd.DataFrame({"chunk": [chunk], "sums": [part.tobytes()]})

    kind = "chunk long, sums binary"
    parts = texts.mapInPandas(partial, kind).withColumn("share", F.pmod(F.xxhash64(F.spark_partition_id()), F.lit(SHARES)))
    shares = parts.repartition("chunk", "share").select("chunk", "sums").mapInPandas(total, kind)
    return shares.repartition("chunk").mapInPandas(total, kind)


def table_of(chunks: DataFrame, rows: int, width: int) -> np.ndarray:
    """The summed table on the driver; its size is a parameter."""
    out = np.zeros((rows, width))
    for r in chunks.toLocalIterator():
        got = np.frombuffer(r["sums"], np.float64).reshape(-1, width)
        out[r["chunk"] : r["chunk"] + len(got)] = got
    return out


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))
