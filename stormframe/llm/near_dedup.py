"""Near-duplicate detection: banded MinHash, odd sketches, and links confirmed on full shingle sets.

Texts with equal shingle sets fall into classes first; classes are compared by
their least document. MinHash bands propose candidates. A class's MinHash
samples are also folded into a parity bitmap, its odd sketch; the population
count of the XOR of two bitmaps estimates a high similarity, and candidates
far below the threshold go no further. Links are confirmed on the full sets.

Candidates of a bucket are first compared with its least class only. Buckets
whose members then still lie in several components are worked through exactly,
in blocks: every member against all those outside its component, so that no
link between different texts is lost, while at most one link a member is passed
on and no list of pairs of a group is made. Members of a bucket's main component
are copied once for each block of members outside it. Components come from rounds of joins.

Defined cases: A-Z are lower-cased, words are runs without ASCII white space; a
text with fewer words than a shingle is one shingle; a null text or one without
words has an empty set, is linked with nothing and stays; equal texts, repeated
rows included, share a class. ``component_id`` is the least id of a component,
and ``kept`` is true for one row of it: of the rows with that id (rows of a null
id count as one id, after all others) those with the least hash of their text,
and of repeated rows one. Different texts of one id are judged apart. Other
columns pass through ``near_groups`` and a clashing name is replaced. The digest
has its SQL's ``kept``, which is told by the id alone.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from stormframe.llm.common import checkpointed, fresh_name, stored
from stormframe.llm.components import connected_components

SHINGLE = 5
BITS, SEED = 512, 8


class Banding(NamedTuple):
    """A threshold in percent with the bands that find it, and the estimate under which candidates are dropped."""

    link: int
    bands: int
    rows: int
    least_estimate: float


#: The bands miss a pair just at the threshold less than once in a million pairs; the estimate lies six standard errors
#: under it.
LINK_85, LINK_80 = Banding(85, 24, 5, 0.6), Banding(80, 27, 4, 0.55)
#: Members of a bucket that one task compares with as many others.
BLOCK = 512
MEMORY = 500_000

_MIX = np.uint64(0x9E3779B97F4A7C15)


@functools.cache
def _multipliers(count: int) -> np.ndarray:
    return np.random.default_rng(SEED).integers(1, 1 << 63, count, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > MEMORY:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


_HASHES = _WordHashes()


def shingles(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """The sorted distinct 64-bit shingle hashes of a text."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(_HASHES.__getitem__, words), np.uint64, len(words))
    n, size = max(1, len(h) - size + 1), min(size, len(h))
    s = np.full(n, size, np.uint64)
    for k in range(size):
        s = (s ^ h[k : k + n]) * _MIX
        s ^= s >> np.uint64(29)
    return np.unique(s)


def signature(s: np.ndarray, by: Banding = LINK_85) -> tuple[np.ndarray, np.ndarray]:
    """Band keys and odd sketch of a non-empty set, both as 64-bit words."""
    multipliers = _multipliers(by.bands * by.rows)
    least = np.full(len(multipliers), np.iinfo(np.uint64).max, np.uint64)
    for k in range(0, len(s), 4096):
        np.minimum(least, (s[k : k + 4096, None] * multipliers).min(axis=0), out=least)
    keys = np.arange(1, by.bands + 1, dtype=np.uint64)
    for column in least.reshape(by.bands, by.rows).T:
        keys = (keys ^ column) * _MIX
        keys ^= keys >> np.uint64(31)
    # The sample is the set of (position, minimum); each member flips one bit.
    member = (least ^ multipliers) * _MIX
    bits = np.bincount((member >> np.uint64(55)).astype(np.int64), minlength=BITS) & 1
    return keys.view(np.int64), np.packbits(bits.astype(np.uint8)).view(np.int64)


def estimate(flipped, by: Banding = LINK_85):
    """Similarity from the count of differing bits of two odd sketches; a numpy array or a Column."""
    log = F.ln if isinstance(flipped, Column) else np.log
    low = F.greatest(F.lit(1e-9), 1 - 2 * flipped / BITS) if isinstance(flipped, Column) else np.maximum(1e-9, 1 - 2 * flipped / BITS)
    return 1 + BITS / (4 * by.bands * by.rows) * log(low)


def differing_bits(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)


def row_key(id_col: str, text_col: str) -> tuple[Column, Column, Column]:
    """``missing, id, h``: rows that agree in these repeat one document. None of them is null."""
    missing = F.col(id_col).isNull()
    return missing, F.coalesce(F.col(id_col).cast("long"), F.lit(0)), F.xxhash64(F.coalesce(text_col, F.lit("")), missing)


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    missing, key, h = row_key(id_col, text_col)
    return docs.select(missing.alias("missing"), key.alias("id"), h.alias("h"), F.col(text_col).alias("text"))


def signatures(docs: DataFrame, id_col: str, text_col: str, by: Banding = LINK_85) -> DataFrame:
    """``missing, id, h, n, class, bands, sketch`` of every row; class is a digest of the set, null where that is empty."""

    def sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for *key, text in zip(batch["missing"], batch["id"], batch["h"], batch["text"], strict=True):
                s = shingles(text)
                keys, sketch = signature(s, by) if len(s) else (None, None)
                rows.append((*key, len(s), hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None, keys, sketch))
            yield pd.DataFrame(rows, columns=["missing", "id", "h", "n", "class", "bands", "sketch"])

    return keyed(docs, id_col, text_col).mapInPandas(sign, "missing boolean, id long, h long, n long, class binary, bands array<long>, sketch array<long>")


def full_sets(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id, shingles`` of the wanted classes ``id, rep``; a repeated row gives its class again."""

    def sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"id": batch["id"], "shingles": [shingles(t).tobytes() for t in batch["text"]]})

    named = wanted.select(F.col("id").alias("node"), "rep.id", "rep.h")
    picked = keyed(docs, id_col, text_col).join(named, ["id", "h"]).select(F.col("node").alias("id"), "text")
    return picked.mapInPandas(sets, "id long, shingles binary")


def linked(a: Column, b: Column, by: Banding) -> Column:
    """Whether two full sets reach the threshold."""

    @F.pandas_udf(BooleanType())
    def reach(a: pd.Series, b: pd.Series) -> pd.Series:
        out = []
        for x, y in zip(a, b, strict=True):
            s, t = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            both = np.intersect1d(s, t, assume_unique=True).size
            out.append(100 * both >= by.link * (s.size + t.size - both))
        return pd.Series(out, dtype="bool")

    return reach(a, b)


def _links_in_block(group: pd.DataFrame, by: Banding) -> pd.DataFrame:
    """One verified link for each two components of a block's members that any link joins."""
    group = group.drop_duplicates("id").sort_values("id")
    ids, sets = group["id"].to_numpy(), [np.frombuffer(x, np.uint64) for x in group["shingles"]]
    sizes = np.array([len(s) for s in sets])
    _, inverse = np.unique(np.concatenate(sets), return_inverse=True)
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    sketches = np.array(group["sketch"].tolist(), np.int64).view(np.uint64)
    part, flags, found = group["component"].to_numpy().copy(), np.zeros(inverse.max() + 1, bool), []
    for k in range(len(ids)):
        near = estimate(np.bitwise_count(sketches ^ sketches[k]).sum(axis=1), by) >= by.least_estimate
        near &= part != part[k]
        near[:k] = False
        if not near.any():
            continue
        own = inverse[starts[k] : starts[k] + sizes[k]]
        flags[own] = True
        both = np.add.reduceat(flags[inverse], starts, dtype=np.int64)
        flags[own] = False
        for j in np.flatnonzero(near & (100 * both >= by.link * (sizes + sizes[k] - both))):
            if part[j] != part[k]:
                found.append((ids[k], ids[j]))
                part[part == part[j]] = part[k]
    return pd.DataFrame(found, columns=["a", "b"], dtype="int64")


def near_links(classes: DataFrame, docs: DataFrame, id_col: str, text_col: str, by: Banding, repeated: bool) -> DataFrame:
    """Links ``a, b`` between classes, enough to connect whatever any link connects."""
    members = classes.select("id", F.explode("bands").alias("key"))
    # Stored before the join, so that adaptive execution can split a key of very many members.
    heads = stored(members.groupBy("key").agg(F.min("id").alias("head"), F.count("*").alias("size")).filter("size > 1"))
    shared = checkpointed(members.join(heads, "key"))
    sketches = classes.select("id", "sketch")
    wanted = classes.join(shared.select("id").distinct(), "id", "left_semi")
    sets = full_sets(docs, wanted, id_col, text_col)
    sets = checkpointed(sets.dropDuplicates(["id"]) if repeated else sets)
    pairs = shared.filter("id <> head").select("id", "head").distinct()
    likely = (
        pairs.join(sketches, "id")
        .join(sketches.select(F.col("id").alias("head"), F.col("sketch").alias("sketch2")), "head")
        .filter(estimate(differing_bits(F.col("sketch"), F.col("sketch2")), by) >= by.least_estimate)
        .select("id", "head")
    )
    tested = likely.join(sets, "id").join(sets.select(F.col("id").alias("head"), F.col("shingles").alias("shingles2")), "head")
    first = checkpointed(tested.filter(linked(F.col("shingles"), F.col("shingles2"), by)).select(F.col("head").alias("a"), F.col("id").alias("b")))
    part = connected_components(first).select(F.col("node").alias("id"), "component")
    placed = shared.filter("size > 2").join(part, "id", "left").select("key", "id", F.coalesce("component", "id").alias("component"))
    placed = stored(placed)
    parts = placed.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.min_by("component", "id").alias("main"))
    mixed = parts.filter("low <> high").select("key", "main")
    apart = F.col("component") != F.col("main")
    counted = stored(placed.join(mixed, "key").groupBy("key", "main").agg(F.count_if(~apart).alias("inside"), F.count_if(apart).alias("outside")))
    # Members of the main component, mostly all, are dealt out in blocks once; those outside it meet every block.
    blocks, others = (F.ceil(F.col(c) / BLOCK).cast("int") for c in ("inside", "outside"))
    placed = placed.join(counted, "key").withColumns({"blocks": blocks, "others": others, "apart": apart})
    placed = placed.withColumn("mine", F.pmod(F.xxhash64("id"), F.when(F.col("apart"), F.col("others")).otherwise(F.col("blocks"))).cast("int"))
    pair = lambda low, high: F.struct(low.alias("low"), high.alias("high"))
    upto = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    mine = F.col("mine")
    outside = F.concat(
        F.transform(upto("blocks"), lambda k: pair(k, mine)),
        F.transform(F.filter(upto("others"), lambda k: k != mine), lambda k: pair(F.col("blocks") + F.least(k, mine), F.greatest(k, mine))),
    )
    inside = F.transform(upto("others"), lambda k: pair(mine, k))
    dealt = placed.select("key", "id", "component", F.explode(F.when(F.col("apart"), outside).otherwise(inside)).alias("block"))
    dealt = dealt.select("key", "id", "component", "block.low", "block.high")
    ready = dealt.join(sketches, "id").join(sets, "id").select("key", "low", "high", "id", "component", "sketch", "shingles")
    second = ready.groupBy("key", "low", "high").applyInPandas(lambda group: _links_in_block(group, by), "a long, b long")
    return first.unionByName(second)


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", by: Banding = LINK_85) -> DataFrame:
    """All rows and columns, with ``n_shingles, component_id, kept``."""
    signed = checkpointed(signatures(docs, id_col, text_col, by))
    documents = signed.groupBy("missing", "id", "h").agg(F.first("n").alias("n"), F.first("class").alias("class"), F.count("*").alias("rows"))
    repeated = not documents.filter("rows > 1 and class is not null").isEmpty()
    classes = (
        signed.filter(F.col("class").isNotNull())
        .groupBy("class")
        .agg(F.min(F.struct("missing", "id", "h")).alias("rep"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch"))
    )
    # Classes have numbers of their own, as several may share an id or have none.
    classes = checkpointed(classes.withColumn("id", F.monotonically_increasing_id()))
    part = connected_components(near_links(classes, docs, id_col, text_col, by, repeated)).select(F.col("node").alias("id"), "component")
    linked_classes = classes.select("id", "class", "rep").join(part, "id")
    best = linked_classes.groupBy("component").agg(F.min("rep").alias("best"))
    named = classes.select("id", "class", "rep").join(linked_classes.join(best, "component").select("id", "best"), "id", "left")
    named = named.select(F.col("class").alias("class_"), F.coalesce("best", "rep").alias("rep"))
    key, h, rows = (fresh_name(docs, c) for c in ("id_", "h_", "rows_"))
    told = documents.join(named, F.col("class") == F.col("class_"), "left").select(
        F.col("id").alias(key),
        F.col("h").alias(h),
        F.when(F.col("class").isNotNull(), F.col("rows")).otherwise(0).alias(rows),
        F.col("n").alias("n_shingles"),
        F.when(~F.coalesce("rep.missing", "missing"), F.coalesce("rep.id", "id")).alias("component_id"),
        (F.col("class").isNull() | ((F.col("id") == F.col("rep.id")) & (F.col("h") == F.col("rep.h")))).alias("kept"),
    )
    _, own, own_h = row_key(id_col, text_col)
    plain = docs.drop("n_shingles", "component_id", "kept").withColumns({key: own, h: own_h})
    if not repeated:
        return plain.join(told, [key, h]).drop(key, h, rows)
    # Of the rows that repeat a document that stays, the first in the order of their other columns is kept.
    told = checkpointed(told)
    twice = told.filter(F.col("kept") & (F.col(rows) > 1)).select(key, h)
    tag = fresh_name(docs, "tag_")
    order = F.struct(F.xxhash64(*[c for c in plain.columns if not plain.schema[c].dataType.typeName() == "map"]).alias("x"), F.monotonically_increasing_id().alias("k"))
    again = stored(plain.join(twice, [key, h], "left_semi").withColumn(tag, order))
    first = again.groupBy(key, h).agg(F.min(tag).alias("first_"))
    chosen = again.join(first, [key, h]).join(told.drop("kept"), [key, h]).withColumn("kept", F.col(tag) == F.col("first_")).drop(tag, "first_")
    others = plain.join(twice, [key, h], "left_anti").join(told, [key, h])
    return others.unionByName(chosen).drop(key, h, rows)


def near_digest(docs: DataFrame) -> DataFrame:
    kept = F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)).alias("kept")
    return near_groups(docs.select("doc_id", "text")).select("doc_id", "n_shingles", "component_id", kept)
