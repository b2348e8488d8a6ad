"""Token counts by prefix dynamic programming over a byte-level BPE vocabulary.

For every prefix of a word the table keeps the last token of its encoding and
the number of tokens. The last token of a prefix is the one vocabulary entry
ending there that stays apart, when encoded, from the last token of the prefix
before it; so one pass gives the count at every prefix. Word tables add up to a
table over all prefixes of a text, which answers how many tokens a truncated
text has, and how much of a text fits a budget, without encoding again.

Defined cases: a null or empty text has no tokens and fits with no characters;
special strings in a text count as one token, as the tokenizer's default has
it; equal texts get equal rows; a long word costs its length times the longest
token at most. Word tables are kept in a memory of bounded size. Other columns are not
kept.
"""

from __future__ import annotations

import functools
import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
import public_tokenizers
import regex
from pyspark.sql import DataFrame

VOCABULARY = "byte_bpe_50k.json"
LIMIT = 1024
#: Words whose totals a worker remembers; the longest of them.
MEMORY, LONGEST = 1_000_000, 200

# Fixed value: the word pattern of this vocabulary's family.
WORDS = regex.compile(r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+")
SUFFIX = regex.compile(r"'(?:ll|ve|re)")
BLANK = regex.compile(r"\p{White_Space}+")


def _byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in the vocabulary file."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


class PrefixCounter:
    """Counts at prefixes for one vocabulary file."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = _byte_letters()
        raw = lambda s: bytes(letters[c] for c in s)
        self.special = {t["content"] for t in spec["added_tokens"] if t.get("special")}
        self.tokens = {raw(t) for t in spec["model"]["vocab"] if t not in self.special}
        merges = spec["model"]["merges"]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in merges]
        self.rank = {(raw(a), raw(b)): k for k, (a, b) in enumerate(pairs)}
        self.begins = {t[:k] for t in self.tokens for k in range(1, len(t) + 1)}
        self.split = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.total = _Totals(self)
        self._apart: dict[tuple[bytes, bytes], bool] = {}

    def merge(self, word: bytes) -> list[bytes]:
        """Plain merging in order of rank; here only for words of one or two tokens."""
        parts = [word[i : i + 1] for i in range(len(word))]
        while len(parts) > 1:
            best, at = min((self.rank.get(p, 1 << 60), i) for i, p in enumerate(zip(parts, parts[1:], strict=False)))
            if best == 1 << 60:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def apart(self, a: bytes, b: bytes) -> bool:
        """Whether a and b, side by side, encode as just these two tokens."""
        known = self._apart.get((a, b))
        if known is None:
            if len(self._apart) > MEMORY:
                self._apart.clear()
            known = self._apart[(a, b)] = self.merge(a + b) == ([a, b] if a else [b])
        return known

    def word_prefixes(self, word: bytes) -> list[int]:
        """The token count of each byte prefix of a word, the empty one first."""
        size = len(word)
        counts, last = [0] + [-1] * size, [b""] * (size + 1)
        tokens, begins, known = self.tokens, self.begins, self._apart
        for start in range(size):
            here, n = last[start], counts[start] + 1
            for end in range(start + 1, size + 1):
                token = word[start:end]
                if token not in begins:
                    break
                # Just one start is right for each end.
                if counts[end] < 0 and token in tokens:
                    ok = known.get((here, token))
                    if self.apart(here, token) if ok is None else ok:
                        counts[end], last[end] = n, token
        return counts

    def _parts(self, text: str) -> Iterator[tuple[str, bool]]:
        at = 0
        for m in self.split.finditer(text) if self.split else ():
            yield text[at : m.start()], False
            yield m[0], True
            at = m.end()
        yield text[at:], False

    def count(self, text: str | None) -> int:
        return sum(1 if special else sum(map(self.total.__getitem__, WORDS.findall(part))) for part, special in self._parts(text or ""))

    def prefix_counts(self, text: str | None) -> list[int]:
        """The token count of each code-point prefix of a text, the empty one first."""
        out, before = [0], 0
        for part, special in self._parts(text or ""):
            if special:
                # A prefix that ends inside a special string is ordinary text.
                head, start = previous, out[-1] - self.count(previous)  # noqa: F821
                out += [start + self.count(head + part[:k]) for k in range(1, len(part))] + [out[-1] + 1]
            else:
                words = WORDS.findall(part)
                for k, word in enumerate(words):
                    at = before = out[-1] if k == 0 else before
                    if SUFFIX.fullmatch(word):
                        inner = [*range(1, len(word)), self.total[word]]
                    else:
                        table, size, inner = self.word_prefixes(word.encode()), 0, []
                        for c in word:
                            size += len(c.encode())
                            inner.append(table[size])
                    if k and BLANK.fullmatch(words[k - 1]) and BLANK.match(word[:1]):
                        # Blanks at the end of a prefix are one word, with those before them.
                        inner[0] = self.word_prefixes((words[k - 1] + word[0]).encode())[-1] - self.total[words[k - 1]]
                    out += [at + n for n in inner]
                    before = at + self.total[word]
            previous = part if not special else ""
        return out

    def fitting(self, text: str | None, budget: int) -> int:
        """The code points of the longest prefix with at most ``budget`` tokens."""
        text, used, chars = text or "", 0, 0
        for part, special in self._parts(text):
            words = [part] if special else WORDS.findall(part)
            sizes = np.fromiter((1 if special else self.total[w] for w in words), np.int64, len(words))
            ends = used + np.cumsum(sizes)
            k = int(np.searchsorted(ends, budget, side="right"))
            if k < len(words):
                whole = sum(map(len, words[:k]))
                # The cut is in this word; the table of the text around it is exact.
                near = "".join(words[max(0, k - 1) : k + 1])
                lead = len(words[k - 1]) if k else 0
                base = int(ends[k - 1]) - (int(sizes[k - 1]) if k else 0) if k else used
                if special:
                    return chars + whole
                table = self.prefix_counts(near)
                fits = [j for j in range(lead, len(near) + 1) if base + table[j] <= budget]
                return chars + whole + (fits[-1] - lead if fits else 0)
            used, chars = int(ends[-1]) if len(ends) else used, chars + len(part)
        return chars


class _Totals(dict):
    """Total count of a word. When the memory is full, it becomes the old one, from which words in use come back."""

    def __init__(self, counter: PrefixCounter) -> None:
        self.counter, self.old = counter, {}

    def __missing__(self, word: str) -> int:
        n = self.old.get(word)
        if n is None:
            n = self.counter.word_prefixes(word.encode())[-1]
        if len(word) <= LONGEST:
            if len(self) >= MEMORY // 2:
                self.old = dict(self)
                self.clear()
            self[word] = n
        return n


@functools.cache
def counter(path: str) -> PrefixCounter:
    return PrefixCounter(path)


COUNTS = "doc_id long, n_bytes long, n_tokens long, over_limit boolean, fit_chars long"


def token_counts(docs: DataFrame, vocabulary: str = VOCABULARY, limit: int = LIMIT) -> DataFrame:
    """Tokens of each whole text, whether they pass the limit, and how many characters fit it."""

    def counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table = counter(public_tokenizers.path(vocabulary))
        for batch in batches:
            rows = []
            for key, text in zip(batch["doc_id"], batch["text"], strict=True):
                text = text or ""
                n = table.count(text)
                rows.append((key, len(text.encode()), n, n > limit, len(text) if n <= limit else table.fitting(text, limit)))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in COUNTS.split(", ")])

    return docs.select("doc_id", "text").mapInPandas(counts, COUNTS)
