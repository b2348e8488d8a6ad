"""Alignment of two tokenizers: where both end a token, and which of their ids meet there.

Both encodings of a text cover the same bytes. A two-pointer merge of the
cumulative ends of their tokens cuts them into groups at the offsets where both
end, and each two tokens of the two sides within a group are linked. Neither
tokenizer joins a blank to a character before it that is not white space, so a
text is cut there first; each such part is encoded and merged once and then
remembered, in a memory of bounded size, and a long text streams through in
stretches. A document's pairs are added up before anything is shuffled. Spark
counts in how many documents a pair is linked, finds each id's highest count on
either side, and joins both back to the pairs of every document.

Defined cases: a null or empty text, and one whose tokens on a side do not spell
a blank and the text (as one with the blank mark U+2581), has no tokens: zeros,
and '' for the digest. Special strings in a text are ordinary text. Repeated
rows count as documents of their own. Other columns are not kept.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import public_tokenizers
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from stormframe.llm.common import stored
from stormframe.llm.token_counts import _byte_letters

SIDE_A, SIDE_B = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Parts that a worker remembers (and 16 times as many characters); characters of a stretch, and of documents that are worked on together.
MEMORY, STRETCH, CHARS = 400_000, 1 << 20, 1 << 20
#: A pair of ids is a key: the id of side A times this, plus that of side B.
SHIFT = 1 << 20
#: Counts of at most so many pairs are sent to every task (24 bytes each).
BROADCAST_PAIRS = 1_000_000

#: A blank after a character that is not white space, with more text after it; white space at the end stays with the last part.
CUT = re.compile(r"(?<=\S) (?=\s*\S)")


class Growing:
    """A numpy array that grows at its end."""

    def __init__(self, kind: str) -> None:
        self.data, self.size = np.zeros(1024, kind), 0

    def extend(self, values) -> None:
        values = np.asarray(values, self.data.dtype)
        if self.size + len(values) > len(self.data):
            self.data = np.concatenate([self.data[: self.size], np.zeros(max(len(values), self.size), self.data.dtype)])
        self.data[self.size : self.size + len(values)] = values
        self.size += len(values)


class Aligner:
    """Two tokenizers and the parts that they have cut into groups."""

    def __init__(self, path_a: str, path_b: str) -> None:
        # Spark deals out the work; threads of the library's own only take each other's time.
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        letters = _byte_letters()
        with open(path_a, encoding="utf-8") as f:
            vocabulary = json.load(f)["model"]["vocab"]
        self.bytes_a = [b""] * (max(vocabulary.values()) + 1)
        for t, i in vocabulary.items():
            if all(c in letters for c in t):
                self.bytes_a[i] = bytes(map(letters.get, t))
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        self.bytes_b = [self._piece(i) for i in range(self.b.get_piece_size())]
        self.size_a, self.size_b = (np.fromiter(map(len, x), np.int64, len(x)) for x in (self.bytes_a, self.bytes_b))
        self.told = [f"{i}{mark}" for side, marks in ((self.size_a, ",|"), (self.size_b, ",;")) for mark in marks for i in range(len(side))]
        self.clear()

    def _piece(self, i: int) -> bytes:
        name = self.b.id_to_piece(i)
        return bytes([int(name[3:5], 16)]) if self.b.is_byte(i) else name.replace("\u2581", " ").encode()

    def clear(self) -> None:
        self.known: dict[str, int] = {}
        self.chars, self.cleared = 0, getattr(self, "cleared", 0) + 1
        self.written: list[str] = []
        self.sizes, self.starts, self.links, self.odd = Growing("int64"), Growing("int64"), Growing("int64"), Growing("bool")

    def learn(self, parts: list[str]) -> None:
        """Encode and merge parts; the blank before each is not in the part."""
        raw = np.fromiter((1 + len(p.encode()) for p in parts), np.int64, len(parts))
        sides_a = [e.ids for e in self.a.encode_batch_fast([" " + p for p in parts], add_special_tokens=False)]
        sides_b = self.b.encode(parts, num_threads=1)
        whole = [self._spelled(self.bytes_a, a) == b" " + p.encode() == self._spelled(self.bytes_b, b) for p, a, b in zip(parts, sides_a, sides_b, strict=True)]
        if not all(whole):
            sides_a, sides_b = ([ids if ok else [] for ids, ok in zip(side, whole, strict=True)] for side in (sides_a, sides_b))
            raw = np.where(whole, raw, 0)
        for part in parts:
            self.known[part] = len(self.known)
            self.chars += len(part)
        n_a, n_b = (np.fromiter(map(len, side), np.int64, len(parts)) for side in (sides_a, sides_b))
        a, b = (np.fromiter(itertools.chain.from_iterable(side), np.int64, int(n.sum())) for side, n in ((sides_a, n_a), (sides_b, n_b)))
        ends, group_a, group_b = common_ends(self.size_a[a], self.size_b[b])
        upto = np.searchsorted(ends, np.cumsum(raw), side="right")
        n_groups = np.diff(upto, prepend=0)
        in_a, in_b = np.bincount(group_a, minlength=len(ends)), np.bincount(group_b, minlength=len(ends))
        links = linked(a, b, group_a, in_a, in_b)
        in_part = np.add.reduceat(np.append(in_a * in_b, 0), np.append(0, upto)[:-1])
        n_links = np.where(n_groups > 0, in_part, 0)
        # Each token's text with what follows it: a comma in its group, a bar after side A, a semicolon after side B.
        before_a, before_b = np.cumsum(in_a) - in_a, np.cumsum(in_b) - in_b
        places_a, places_b = np.arange(len(a)), np.arange(len(b))
        told = np.empty(len(a) + len(b), np.int64)
        last_a, last_b = places_a + 1 == (before_a + in_a)[group_a], places_b + 1 == (before_b + in_b)[group_b]
        told[places_a + before_b[group_a]] = a + last_a * len(self.size_a)
        told[places_b + (before_a + in_a)[group_b]] = b + (2 * len(self.size_a) + last_b * len(self.size_b))
        texts, at = [*map(self.told.__getitem__, told.tolist())], 0
        for n, ok in zip((n_a + n_b).tolist(), whole, strict=True):
            self.written.append("".join(texts[at : at + n])[:-1] if ok else None)
            at += n
        self.starts.extend(self.links.size + np.cumsum(n_links) - n_links)
        self.sizes.extend(np.column_stack([n_a, n_b, n_groups, n_links]).ravel())
        self.links.extend(links)
        # A blank after such a part is no boundary.
        self.odd.extend([not p or p[-1].isspace() for p in parts])

    @staticmethod
    def _spelled(spelling: list[bytes], ids: list[int]) -> bytes:
        return b"".join(map(spelling.__getitem__, ids))

    def places(self, parts: list[str]) -> list[int]:
        """Where the memory holds each part; those that it lacks are learned."""
        at = [*map(self.known.get, parts)]
        if None in at:
            new = [*dict.fromkeys(p for p, k in zip(parts, at, strict=True) if k is None)]
            if len(self.known) + len(new) > MEMORY or self.chars > 16 * MEMORY:
                self.clear()
                new = [*dict.fromkeys(parts)]
            for k in range(0, len(new), 16384):
                self.learn(new[k : k + 16384])
            at = [*map(self.known.get, parts)]
        return at

    def align_all(self, texts: list[str | None], stretch: int = STRETCH) -> Iterator[tuple]:
        """``align`` of each text; the parts of short texts are learned together."""
        short = [text.split(" ") if text and len(text) <= stretch else [] for text in texts]
        at = self.places([*itertools.chain.from_iterable(short)])
        seen, ready, start = self.cleared, [], 0
        for parts in short:
            ready.append(np.array(at[start : start + len(parts)], np.int64))
            start += len(parts)
        for text, known in zip(texts, ready, strict=True):
            plain = len(known) and seen == self.cleared and not self.odd.data[known].any()
            yield self.align(text, [known] if plain else (np.array(self.places(parts)) for parts in cut(text or "", stretch)))

    def align(self, text: str | None, stretches) -> tuple:
        """Tokens of both sides, groups, links, the digest of the groups, and the different pairs with their links."""
        nothing = (0, 0, 0, 0, "", np.zeros(0, np.int64), np.zeros(0, np.int64))
        if not text:
            return nothing
        totals, digest, pairs, times = np.zeros(4, np.int64), hashlib.sha256(), [], []
        for at in stretches:
            try:
                told = ";".join(map(self.written.__getitem__, at.tolist()))
            except TypeError:
                return nothing
            digest.update((";" + told if pairs else told).encode())
            sizes = self.sizes.data.reshape(-1, 4)[at]
            totals += sizes.sum(axis=0)
            n = sizes[:, 3]
            ends = np.cumsum(n)
            links = self.links.data[np.repeat(self.starts.data[at] - ends + n, n) + np.arange(ends[-1])]
            found = np.unique(links, return_counts=True)
            pairs.append(found[0])
            times.append(found[1])
        if len(pairs) > 1:
            keys, place = np.unique(np.concatenate(pairs), return_inverse=True)
            pairs, times = [keys], [np.bincount(place, np.concatenate(times)).astype(np.int64)]
        return (*totals.tolist(), digest.hexdigest(), pairs[0], times[0])


def cut(text: str, size: int) -> Iterator[list[str]]:
    """The parts of a text, in stretches of bounded size unless one part is longer."""
    at = 0
    while at < len(text):
        end = at + size
        if end < len(text):
            m = CUT.search(text, end)
            end = m.start() if m else len(text)
        yield CUT.split(text[at:end])
        at = end + 1


def common_ends(sizes_a: np.ndarray, sizes_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The offsets where tokens of both sides end, and the group of each token.

    A merge of the two rising sequences of ends: a token is in the group of the
    first common end that is not before its own.
    """
    ends_a, ends_b = np.cumsum(sizes_a), np.cumsum(sizes_b)
    ends = np.intersect1d(ends_a, ends_b, assume_unique=True)
    return ends, np.searchsorted(ends, ends_a), np.searchsorted(ends, ends_b)


def linked(a: np.ndarray, b: np.ndarray, group_a: np.ndarray, in_a: np.ndarray, in_b: np.ndarray) -> np.ndarray:
    """The key of each link: every token of side A with every token of side B of its group."""
    n = in_b[group_a]
    first = (np.cumsum(in_b) - in_b)[group_a]
    places = np.repeat(first - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
    return np.repeat(a, n) * SHIFT + b[places]


@functools.cache
def aligner(path_a: str, path_b: str) -> Aligner:
    return Aligner(path_a, path_b)


ALIGNED = "n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, times array<long>"


def align_texts(docs: DataFrame, side_a: str = SIDE_A, side_b: str = SIDE_B, id_col: str = "doc_id", text_col: str = "text", stretch: int = STRETCH) -> DataFrame:
    """A row for each document: its sizes, its groups' digest, its different pairs and how many links each has."""
    kind = dict(docs.dtypes)[id_col]

    def aligned(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tool = aligner(public_tokenizers.path(side_a), public_tokenizers.path(side_b))
        names = [id_col, *(c.split()[0] for c in ALIGNED.split(", "))]
        for batch in batches:
            texts, keys = batch[text_col].tolist(), batch[id_col].tolist()
            sizes = np.cumsum([len(t or "") for t in texts]) // CHARS
            for chunk in np.split(np.arange(len(texts)), np.flatnonzero(np.diff(sizes)) + 1):
                rows = [(keys[k], *told) for k, told in zip(chunk, tool.align_all([texts[k] for k in chunk], stretch), strict=True)]
                yield pd.DataFrame(rows, columns=names)

    return docs.select(id_col, text_col).mapInPandas(aligned, f"`{id_col}` {kind}, {ALIGNED}")


def pair_counts(aligned: DataFrame) -> DataFrame:
    """``pair, n, best_a, best_b``: documents that hold a pair, and whether no pair of its id, on either side, has more."""
    counts = stored(aligned.select(F.explode_outer("pairs").alias("pair")).filter("pair is not null").groupBy("pair").agg(F.count("*").alias("n")))
    a, b = F.shiftright("pair", SHIFT.bit_length() - 1).alias("a"), F.col("pair").bitwiseAND(F.lit(SHIFT - 1)).alias("b")
    split = counts.select("pair", "n", a, b)
    most_a, most_b = split.groupBy("a").agg(F.max("n").alias("most_a")), split.groupBy("b").agg(F.max("n").alias("most_b"))
    joined = split.join(most_a, "a").join(most_b, "b")
    return stored(joined.select("pair", "n", (F.col("n") == F.col("most_a")).alias("best_a"), (F.col("n") == F.col("most_b")).alias("best_b")))


def align_corpus(
    docs: DataFrame, side_a: str = SIDE_A, side_b: str = SIDE_B, id_col: str = "doc_id", text_col: str = "text", broadcast_pairs: int = BROADCAST_PAIRS, stretch: int = STRETCH
) -> DataFrame:
    """Sizes and digest of each document, ``n_best, n_best_b`` (links whose count is their id's highest) and ``count_sum``."""
    aligned = stored(align_texts(docs, side_a, side_b, id_col, text_col, stretch).withColumn("row_", F.monotonically_increasing_id()))
    counts = pair_counts(aligned)
    if counts.count() <= broadcast_pairs:
        counts = F.broadcast(counts)
    each = aligned.select("row_", F.posexplode_outer("pairs").alias("k", "pair"), "times").select("row_", "pair", F.get("times", F.col("k")).alias("t")).filter("pair is not null")
    if_best = lambda c: F.sum(F.when(F.col(c), F.col("t")).otherwise(0)).alias(c)
    told = each.join(counts, "pair").groupBy("row_").agg(if_best("best_a"), if_best("best_b"), F.sum(F.col("t") * F.col("n")).alias("total"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    plain = aligned.drop("pairs", "times").join(told, "row_", "left")
    return plain.select(id_col, "n_a", "n_b", "n_groups", "n_links", zero("best_a").alias("n_best"), zero("best_b").alias("n_best_b"), zero("total").alias("count_sum"), "groups_sha256")
