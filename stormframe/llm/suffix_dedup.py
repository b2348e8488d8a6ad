"""Removing long repeats by merging the Burrows-Wheeler transforms of shards.

A byte goes if a string of 200 bytes that covers it also starts anywhere else,
in the same document or another.

1. Texts are read for anchors (``repeats``): only runs of windows whose anchor
   occurs twice or more can repeat. Runs with one digest of 128 bits are one
   string with a multiplicity; an anchor with one such string has nothing to be
   merged with, and all its windows repeat if it occurs twice.
2. The strings of the other anchors are cut from the texts; those with an anchor
   in common meet in one task, where they form shards. Each shard is sorted on
   its own and turned into its Burrows-Wheeler transform: the symbol before each
   suffix, in the order of the suffixes. A symbol is 40 bytes, named exactly.
   The transforms are then merged by refining their interleave, which is all
   that a round keeps: it starts with one shard after the other, and each round
   reads the symbols in the order of the interleave and distributes the shards'
   numbers, stably, by symbol. After k rounds suffixes are in the order of k
   symbols; the round in which two neighbours part gives their common prefix.
   No suffix is sorted again: a shard's suffixes keep the order it came with.
3. Intervals whose common prefixes reach 200 bytes, and which stand for two
   places or more, are the repeats. They go back to all places of their strings,
   and per document their union is cut out.

An anchor with more than HOT strings (a line that a third of all documents
share, each with other words after it) has their bytes told with the runs, and is split by what its windows must also
have in common: the 176 bytes around the anchor that all windows with the anchor
at one of 25 places hold. Groups that are still over HOT are split by 196 bytes, then
by all 200, where a group is one string. So no task has to take in all strings of an anchor.

Defined cases: a null or empty text, and one under 200 bytes, keeps everything;
matches never cross documents; equal texts of 200 bytes or more, repeated rows
included, lose everything; a null id is a value of its own; other columns pass
through ``remove_repeats``. Removal may cut a character in two: what is left of
it is dropped from the text column, while the digest is of the bytes.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stormframe.llm.common import fresh_name, stored
from stormframe.llm.repeats import WINDOW, runs

#: Bytes of strings that one task merges at once, about; bytes of a shard, at most; bytes of a symbol.
TASK_BYTES, SHARD_BYTES, SYMBOL = 1_000_000, 60_000, 40
#: Strings of an anchor that may meet in one task, and the places of the anchor that groups of a larger one share.
HOT, SPLITS = 2000, (25, 5, 1)
_MIX = np.uint64(0x9E3779B97F4A7C15)


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id, h, text``: a text's spans depend on the text alone, so its hash completes the key of rows that share an id."""
    text = F.coalesce(text_col, F.lit(""))
    return docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63))).alias("id"), F.xxhash64(text).alias("h"), text.alias("text"))


def find_anchors(texts: DataFrame) -> DataFrame:
    """``anchor, n``: how often each anchor of a batch of texts owns a run."""

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found, n = np.unique(np.concatenate([runs(text.encode())[0] for text in batch["text"]] or [np.zeros(0, np.int64)]), return_counts=True)
            yield pd.DataFrame({"anchor": found, "n": n})

    return texts.mapInPandas(find, "anchor long, n long")


RUN = ["anchor", "run", "run2"]


def find_runs(texts: DataFrame, kept: list[int]) -> DataFrame:
    """Each run with a digest of its bytes and of the anchor's place in it, its first window and number of windows.

    A run of the anchors to be kept brings its bytes, once in a batch.
    """
    wanted = np.array(kept, np.int64)

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            parts: list[list[np.ndarray]] = [[] for _ in range(8)]
            for key, h, text in zip(batch["id"], batch["h"], batch["text"], strict=True):
                raw = text.encode()
                anchor, _, first, count, place = runs(raw)
                ends = (first + count - 1 + WINDOW).tolist()
                told = [hashlib.blake2b(raw[a:b], digest_size=16, salt=b"%d" % p).digest() for a, b, p in zip(first.tolist(), ends, place.tolist(), strict=True)]
                digest = np.frombuffer(b"".join(told), np.int64).reshape(-1, 2)
                for part, values in zip(parts, (np.full(len(anchor), key), np.full(len(anchor), h), anchor, digest[:, 0], digest[:, 1], first, count, place), strict=True):
                    part.append(values)
            names = ("id", "h", *RUN, "first", "n", "place")
            out = pd.DataFrame({name: np.concatenate(part) if part else [] for name, part in zip(names, parts, strict=True)})
            out["piece"] = None
            row_of = np.repeat(np.arange(len(batch)), [len(part) for part in parts[0]])
            own = out[np.isin(out["anchor"], wanted)].drop_duplicates(RUN)
            out.loc[own.index, "piece"] = [batch["text"].iat[row_of[k]].encode()[a : a + n - 1 + WINDOW] for k, a, n in zip(own.index, own["first"], own["n"], strict=True)]
            yield out

    return texts.mapInPandas(find, "id long, h long, anchor long, run long, run2 long, first int, n int, place int, piece binary")


def stable_order(x: np.ndarray) -> np.ndarray:
    """The stable order of non-negative numbers under 2**32, by halves."""
    order = np.argsort((x & 0xFFFF).astype(np.uint16), kind="stable")
    if len(x) and x.max() >> 16:
        order = order[np.argsort((x[order] >> 16).astype(np.uint16), kind="stable")]
    return order


def symbol_names(text: np.ndarray) -> np.ndarray:
    """A number for the SYMBOL bytes at each position; equal numbers mean equal bytes. The last bytes of the text have none."""
    n = len(text) - SYMBOL
    word = np.zeros(n + SYMBOL - 7, np.uint64)
    for k in range(8):
        word = word << np.uint64(8) | text[k : k + len(word)]
    parts = [word[k : k + n] for k in range(0, SYMBOL, 8)]
    mixed = np.zeros(n, np.uint64)
    for part in parts:
        mixed = (mixed ^ part) * _MIX
        mixed ^= mixed >> np.uint64(29)
    order = np.argsort(mixed, kind="stable")
    differ = np.zeros(max(0, n - 1), bool)
    for part in parts:
        differ |= np.diff(part[order]) != 0
    fresh = np.diff(mixed[order]) != 0
    if (differ & ~fresh).any():
        # Two different symbols have one hash: order by the bytes themselves.
        order = np.lexsort(parts)
        fresh = np.zeros(n - 1, bool)
        for part in parts:
            fresh |= np.diff(part[order]) != 0
    names = np.zeros(len(text), np.int32)
    names[order] = np.cumsum(np.concatenate([[False], fresh]))[:n] if n else 0
    return names


def shard_transform(names: np.ndarray, start: np.ndarray, end: np.ndarray, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """The suffixes of positions low to high in order, and the symbol before each (-1 at the start of a string).

    Suffixes with less than a symbol left come first, in the order of positions; no two of them are alike.
    """
    at = np.arange(low, high)
    short = at[end[at] - at <= SYMBOL]
    _, local = np.unique(names[low:high], return_inverse=True)
    local, order = local.astype(np.uint16), at
    for _ in range(int((end[at] - start[at]).max() - 1) // SYMBOL + 1):
        before = order[order - start[order] >= SYMBOL] - SYMBOL
        order = np.concatenate([short, before[np.argsort(local[before - low], kind="stable")]])
    inside = order - start[order] >= SYMBOL
    return order, np.where(inside, names[np.where(inside, order - SYMBOL, 0)], -1)


def merge_transforms(transforms: list[np.ndarray], short: list[int], rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """The interleave of the shards after so many rounds, and the common prefix, in symbols, of each suffix with the one before.

    ``short`` counts the suffixes at the head of each shard that have no symbol.
    A common prefix of ``rounds`` symbols or more reads ``rounds``.
    """
    number = np.arange(len(transforms), dtype=np.uint16)
    symbols = np.concatenate(transforms).astype(np.int32)
    shard = np.repeat(number, [len(t) for t in transforms])
    head = np.repeat(number, short)
    common = np.full(len(symbols), rounds, np.int8)
    common[:1] = 0
    block = np.zeros(len(symbols), np.int32)
    own, place = np.empty(len(symbols), np.int32), np.arange(len(symbols), dtype=np.int32)
    for k in range(rounds):
        # The suffixes of a shard stand in its own order, so the interleave alone says which one is meant.
        own[np.argsort(shard, kind="stable")] = place
        symbol = symbols[own]
        source = place[symbol >= 0]
        order = stable_order(symbol[source])
        symbol, source = symbol[source][order], source[order]
        block = block[source]
        parted = np.ones(len(symbols), bool)
        parted[len(head) + 1 :] = (symbol[1:] != symbol[:-1]) | (block[1:] != block[:-1])
        common[parted & (common == rounds)] = k
        shard = np.concatenate([head, shard[source]])
        block = np.cumsum(parted, dtype=np.int32)
    return shard, common


def merged_intervals(strings: list[bytes], weight: np.ndarray) -> np.ndarray:
    """Whether the 200-byte string at each position of the joined strings occurs twice or more.

    ``weight`` is how often each string occurs in the corpus.
    """
    sizes = np.array([len(s) + 1 for s in strings])
    text = np.frombuffer(b"\0".join([*strings, b"\0" * SYMBOL]), np.uint8)
    end = np.repeat(np.cumsum(sizes), sizes)
    start = end - np.repeat(sizes, sizes)
    names = symbol_names(text)
    shards, low = [], 0
    shard_of = (np.cumsum(sizes) - 1) // SHARD_BYTES
    for high in np.cumsum(np.bincount(shard_of, sizes).astype(np.int64)).tolist():
        if high > low:
            shards.append(shard_transform(names, start, end, low, high))
        low = high
    short = [int((end[order] - order <= SYMBOL).sum()) for order, _ in shards]
    shard, common = merge_transforms([t for _, t in shards], short, WINDOW // SYMBOL)
    at = np.empty(len(shard), np.int64)
    at[np.argsort(shard, kind="stable")] = np.concatenate([order for order, _ in shards])
    interval = np.cumsum(common < WINDOW // SYMBOL) - 1
    often = np.bincount(interval, np.repeat(weight, sizes)[at]) > 1
    out = np.zeros(len(end), bool)
    out[at] = often[interval]
    out &= end - 1 - np.arange(len(end)) >= WINDOW
    return out[np.arange(len(end)) != end - 1]


def spans_of(flags: np.ndarray) -> list[tuple[int, int]]:
    """Start and end of each stretch of true values."""
    edges = np.flatnonzero(np.diff(np.concatenate([[0], flags.view(np.int8), [0]])))
    return list(zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True))


PIECE = "key long, key2 long, anchor long, run long, run2 long, m long, low int, n int, place int, piece binary"
PIECES = [c.split()[0] for c in PIECE.split(", ")]
SPANS = "array<struct<a:int,b:int>>"


def split(piece: bytes, n: int, place: int, by: int) -> list[tuple[int, int, int, int, int]]:
    """``key, key2, low, n, place`` of the stretches of a string whose windows have the anchor at ``by`` neighbouring places.

    The key is a digest of the bytes around the anchor that all windows of such a
    stretch hold, whatever the string, so equal windows have equal keys.
    """
    out = []
    for group in range((place - n + 1) // by, place // by + 1):
        low, high = max(0, place - group * by - by + 1), min(n - 1, place - group * by)
        shared = piece[place - group * by : place - group * by + WINDOW + 1 - by]
        digest = hashlib.blake2b(shared, digest_size=16, salt=b"%d/%d" % (group, by)).digest()
        key, key2 = np.frombuffer(digest, np.int64).tolist()
        out.append((key, key2, low, high - low + 1, place - low))
    return out


def _grouped(strings: DataFrame, hot: int) -> DataFrame:
    """Each string in the group of its anchor, and those of an anchor with more than HOT strings in the groups of their stretches."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            large = batch["kinds"] > hot
            plain = batch[~large]
            yield plain.assign(key=plain["anchor"], key2=0, low=0)[columns]
            rows = []
            for r in batch[large].itertuples():
                for key, key2, low, n, place in split(r.piece, r.n, r.place, SPLITS[0]):
                    rows.append((key, key2, r.anchor, r.run, r.run2, r.m, low, n, place, r.piece[low : low + n - 1 + WINDOW], r.id, r.h, r.first))
            yield pd.DataFrame(rows, columns=columns)

    columns = [*PIECES, "id", "h", "first"]
    return strings.mapInPandas(each, PIECE + ", id long, h long, first int")


def _resplit(pieces: DataFrame, by: int) -> DataFrame:
    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for r in batch.itertuples():
                for key, key2, low, n, place in split(r.piece, r.n, r.place, by):
                    rows.append((key, key2, r.anchor, r.run, r.run2, r.m, r.low + low, n, place, r.piece[low : low + n - 1 + WINDOW]))
            yield pd.DataFrame(rows, columns=batch.columns)

    return pieces.mapInPandas(each, PIECE)


def _merge(group: pd.DataFrame) -> pd.DataFrame:
    group = group.drop_duplicates(["key", "key2", *RUN, "low"]).sort_values(["key", "key2", *RUN, "low"])
    strings = group["piece"].tolist()
    repeated = merged_intervals(strings, group["m"].to_numpy(np.float64))
    starts = np.concatenate([[0], np.cumsum([len(s) for s in strings])])
    spans = [[{"a": a + low, "b": b + low} for a, b in spans_of(repeated[x:y])] for x, y, low in zip(starts[:-1], starts[1:], group["low"], strict=True)]
    out = pd.DataFrame({**{c: group[c] for c in RUN}, "spans": spans})
    return out[out["spans"].map(len) > 0]


def _split_hot(pieces: DataFrame, hot: int) -> tuple[list[DataFrame], DataFrame | None]:
    """Pieces in groups that a task may take, and the spans of those that had to be split down to single windows."""
    ready, groups = [], ["key", "key2"]
    for by in SPLITS[1:]:
        sizes = stored(pieces.groupBy(*groups).agg(F.count("*").alias("strings")))
        large = sizes.filter(F.col("strings") > hot).select(*groups)
        ready.append(pieces.join(large, groups, "left_anti"))
        if large.isEmpty():
            return ready, None
        pieces = stored(_resplit(pieces.join(large, groups, "left_semi").select(PIECES), by))
    # A group of single windows is one string; a repeated row gives it again.
    narrow = pieces.select(*groups, *RUN, "low", "m").dropDuplicates([*groups, *RUN, "low"])
    often = stored(narrow.groupBy(*groups).agg(F.sum("m").alias("all")).filter("`all` > 1").select(*groups))
    spans = F.array(F.struct(F.col("low").alias("a"), (F.col("low") + 1).alias("b"))).cast(SPANS)
    return ready, pieces.join(often, groups, "left_semi").select(*RUN, spans.alias("spans"))


def repeat_spans(texts: DataFrame, hot: int = HOT) -> DataFrame:
    """``id, h, spans array<struct<first, spans>>``: repeated window starts, by run, of texts that have any."""
    often = stored(find_anchors(texts).groupBy("anchor").agg(F.sum("n").alias("n")).filter("n > 1"))
    # Anchors that may have more than HOT strings, one in HOT runs at most: their strings are told with
    # the runs, so texts are dealt out once, for the other strings and for what is left of them.
    many = [r["anchor"] for r in often.filter(F.col("n") > hot).select("anchor").collect()]
    found = stored(find_runs(texts, many).join(often, "anchor", "left_semi"))
    told = F.min(F.struct("id", "h", "first", "n", "place")).alias("at"), F.first("piece", ignorenulls=True).alias("piece")
    strings = stored(found.groupBy(*RUN).agg(F.count("*").alias("m"), *told))
    kinds = stored(strings.groupBy("anchor").agg(F.count("*").alias("kinds")))
    strings = strings.join(kinds, "anchor").select(*RUN, "m", "at.*", "kinds", "piece")
    whole = strings.filter("kinds = 1 and m > 1").select(*RUN, F.array(F.struct(F.lit(0).alias("a"), F.col("n").alias("b"))).cast(SPANS).alias("spans"))
    several = strings.filter("kinds > 1")
    total = several.agg(F.coalesce(F.sum(F.col("n") + WINDOW), F.lit(0)).alias("bytes"), F.max("kinds").alias("most")).first()
    apart, warm, decided = several, None, whole
    if (total["most"] or 0) > hot:
        ready, single = _split_hot(stored(_grouped(several, hot)), hot)
        apart = ready[0].filter("piece is null")
        warm = functools.reduce(DataFrame.unionByName, [part.select(PIECES) for part in ready]).filter("piece is not null")
        decided = decided if single is None else decided.unionByName(single)
    cuts = apart.groupBy("id", "h").agg(F.collect_list(F.struct(*RUN, "m", "first", "n", "place")).alias("cuts"))

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for text, wanted in zip(batch["text"], batch["cuts"], strict=True):
                raw = text.encode()
                for c in wanted:
                    rows.append((c["anchor"], 0, c["anchor"], c["run"], c["run2"], c["m"], 0, c["n"], c["place"], raw[c["first"] : c["first"] + c["n"] - 1 + WINDOW]))
            yield pd.DataFrame(rows, columns=PIECES)

    pieces = texts.join(cuts, ["id", "h"]).select("text", "cuts").mapInPandas(cut, PIECE)
    pieces = pieces if warm is None else pieces.unionByName(warm)
    bucket = F.pmod(F.xxhash64("key", "key2"), F.lit(total["bytes"] // TASK_BYTES + 1))
    decided = decided.unionByName(pieces.withColumn("bucket", bucket).groupBy("bucket").applyInPandas(_merge, f"anchor long, run long, run2 long, spans {SPANS}"))
    # The pieces of a run are put together before they meet its occurrences.
    decided = decided.groupBy(*RUN).agg(F.flatten(F.collect_list("spans")).alias("spans"))
    return found.join(decided, RUN).groupBy("id", "h").agg(F.collect_list(F.struct("first", "spans")).alias("spans"))


def cut_out(raw: bytes, spans) -> tuple[bytes, int, int]:
    """What is left of a text, the bytes removed, and the maximal removed stretches."""
    if spans is None or not len(spans):
        return raw, 0, 0
    edge = np.zeros(len(raw) + 1, np.int32)
    for s in spans:
        for x in s["spans"]:
            edge[s["first"] + x["a"]] += 1
            edge[s["first"] + x["b"] - 1 + WINDOW] -= 1
    gone = np.cumsum(edge[:-1]) > 0
    return np.frombuffer(raw, np.uint8)[~gone].tobytes(), int(gone.sum()), len(spans_of(gone))


def _with_spans(docs: DataFrame, id_col: str, text_col: str, hot: int) -> DataFrame:
    texts = keyed(docs, id_col, text_col)
    return texts.join(repeat_spans(texts, hot), ["id", "h"], "left")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All rows and columns; the text column without its repeated stretches."""
    key, h, spans = (fresh_name(docs, c) for c in ("id_", "h_", "spans_"))
    texts = keyed(docs, id_col, text_col)
    found = repeat_spans(texts).select(F.col("id").alias(key), F.col("h").alias(h), F.col("spans").alias(spans))
    own = docs.withColumns({key: F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63))), h: F.xxhash64(F.coalesce(text_col, F.lit("")))})
    joined = own.join(found, [key, h], "left").drop(key, h)
    schema, names = docs.schema, docs.columns

    def cleaned(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            left = [t if s is None else cut_out(t.encode(), s)[0].decode(errors="ignore") for t, s in zip(batch[text_col], batch[spans], strict=True)]
            batch[text_col] = left
            yield batch[names]

    return joined.mapInPandas(cleaned, schema)


DIGEST = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def repeat_digest(docs: DataFrame, hot: int = HOT) -> DataFrame:
    def digest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for key, text, spans in zip(batch["id"], batch["text"], batch["spans"], strict=True):
                raw = text.encode()
                left, gone, stretches = cut_out(raw, spans)
                rows.append((key, len(raw), gone, stretches, hashlib.sha256(left).hexdigest()))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in DIGEST.split(", ")])

    own = F.nullif(F.col("id"), F.lit(-(1 << 63))).alias("id")
    return _with_spans(docs, "doc_id", "text", hot).select(own, "text", "spans").mapInPandas(digest, DIGEST)
