"""Best-fit packing of documents into sequences, under conflicts of source and duplicate cluster.

Documents are dealt into shards by a hash of their id and text, whatever their
source (so rows that share an id, or have none, are spread),
and each shard is packed by itself: longest first, each document into the bin
with the least room left that takes it and holds neither its source nor its
duplicate cluster. Bins lie in lists by the room they have left; a bitmap of the
lists in use gives the successor of a length, and the search goes on from list
to list until a bin's two bitmaps, of sources and of clusters, are both free of
the document's bits. Only where no bin fits is a new one opened. Bits are given
within a shard, one each, so bitmaps are exact.

Defined cases: a document longer than a sequence is cut into parts, of which
all but the last fill a bin alone; a null length counts as 0 and still gets a
place; a null source or cluster conflicts with nothing; rows with equal ids are
packed as often as they occur; ties go by id, then part; an empty table gives no
rows. The result does not depend on how rows are partitioned.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CAPACITY = 2048
#: Documents of a shard, about.
SHARD = 4096

PLACED = "doc_id long, part int, length int, source string, bin_id long, bin_offset int"


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+"))


def best_fit(lengths: list[int], sources: list, clusters: list, capacity: int) -> list[tuple[int, int]]:
    """Bin and offset of each item, in the order given."""
    rooms: list[list[int]] = [[] for _ in range(capacity + 1)]  # bins by room left
    used = 0  # a bit for each list that is not empty
    room, held_sources, held_clusters = [], [], []
    bits: tuple[dict, dict] = ({}, {})

    def bit(kind: int, name) -> int:
        return 0 if name is None else 1 << bits[kind].setdefault(name, len(bits[kind]))

    placed = []
    for length, source, cluster in zip(lengths, sources, clusters, strict=True):
        s, c = bit(0, source), bit(1, cluster)
        found, ahead = -1, used >> length
        at = length
        while ahead:
            skip = (ahead & -ahead).bit_length() - 1
            at += skip
            for b in rooms[at]:
                if not held_sources[b] & s and not held_clusters[b] & c:
                    found = b
                    break
            if found >= 0:
                break
            ahead >>= skip + 1
            at += 1
        if found < 0:
            found = len(room)
            room.append(capacity)
            held_sources.append(0)
            held_clusters.append(0)
        else:
            rooms[at].remove(found)
            if not rooms[at]:
                used &= ~(1 << at)
        placed.append((found, capacity - room[found]))
        room[found] -= length
        held_sources[found] |= s
        held_clusters[found] |= c
        rooms[room[found]].append(found)
        used |= 1 << room[found]
    return placed


def pack(docs: DataFrame, capacity: int = CAPACITY, shard: int = SHARD) -> DataFrame:
    """Place ``doc_id, source, cluster, length`` rows: one row per part, with bin and offset."""
    shards = docs.count() // shard + 1
    part = F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.col("length") / capacity).cast("int") - 1)))
    parts = (
        docs.select("doc_id", F.col("source").cast("string").alias("source"), "cluster", F.coalesce("length", F.lit(0)).cast("int").alias("length"))
        .withColumn("part", part)
        .withColumn("length", F.least(F.lit(capacity), F.col("length") - F.col("part") * capacity).cast("int"))
        .withColumn("shard", F.pmod(F.xxhash64("doc_id", "cluster", "part"), F.lit(shards)))
    )

    def packed(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["length", "doc_id", "part", "source", "cluster"], ascending=[False, True, True, True, True], kind="stable")
        often = group["cluster"].value_counts()
        clusters = [c if often.get(c, 0) > 1 else None for c in group["cluster"]]
        sources = [None if pd.isna(s) else s for s in group["source"]]
        placed = best_fit(group["length"].tolist(), sources, clusters, capacity)
        out = group[["doc_id", "part", "length", "source"]].copy()
        out["bin_id"] = [(int(key[0]) << 32) + b for b, _ in placed]
        out["bin_offset"] = [o for _, o in placed]
        return out

    return parts.groupBy("shard").applyInPandas(packed, PLACED)


def pack_documents(docs: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Pack documents by their words; documents with the same text are one cluster."""
    return pack(
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"),
            "source",
            F.xxhash64(F.coalesce("text", F.lit(""))).alias("cluster"),
            word_count(F.col("text")).alias("length"),
        ),
        capacity,
    )
