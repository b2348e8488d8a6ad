"""SentencePiece encoding and decoding by a streaming search.

The scores of a BPE model rank its merges. Its segmentation is the one in which
each two neighbours stay apart when they are merged on their own, and each
prefix of a text has just one last piece that does so: a back-pointer holds only
there, and the ids are the library's. For other models the search is Viterbi's:
the segmentation with the highest sum of piece scores; among equal sums the one
whose last piece is longest, decided from left to right. Characters that no
piece covers become byte pieces, for Viterbi ten below the lowest score. The
search keeps a window of the longest piece only, and commits ids as soon as all
surviving back-pointer paths meet in one boundary, so a text of any length
streams through.

Each whole text is fed in blocks. No piece holds a blank after another character,
so the paths always meet at a blank that follows one, and nothing behind it
depends on what came before: the text between two such commits and its ids are
remembered, in a memory of bounded size, and stepped over where they come again.
For a BPE model the same goes for boundaries between word characters and others,
which no piece of the model crosses.

Defined cases: a null or empty text has no ids; every text decodes to itself
(the blank mark U+2581 in a text is written as bytes); equal texts get equal
ids. Other columns are not kept.
"""

from __future__ import annotations

import functools
import hashlib
import re
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
import public_tokenizers
from pyspark.sql import DataFrame

MODEL = "piece_bpe_32k.model"
MEMORY, LONGEST = 1_000_000, 200
#: Pieces, neighbours and steps of the search that are remembered.
KNOWN = 1_000_000
#: Characters of a text that are fed at a time.
BLOCK = 4096
MARK = "▁"
#: Text up to the next blank that follows another character.
PART = re.compile(r" *[^ ]+| +")
# Fixed values of the model file: kinds of pieces that text can match, and of bytes.
MATCHED, BYTE = (1, 4), 6
# Where the model file says how it was trained, and the value for BPE.
TRAINER, MODEL_TYPE, BPE = 2, 3, 2


def _fields(data: bytes) -> Iterator[tuple[int, bytes | int]]:
    """The fields of a protocol-buffer message."""
    at = 0

    def number() -> int:
        nonlocal at
        value = shift = 0
        while True:
            b = data[at]
            at += 1
            value |= (b & 0x7F) << shift
            shift += 7
            if b < 0x80:
                return value

    while at < len(data):
        key = number()
        kind = key & 7
        if kind == 0:
            yield key >> 3, number()
        else:
            size = {1: 8, 5: 4}.get(kind) or number()
            yield key >> 3, data[at : at + size]
            at += size


class Pieces:
    """The pieces of one model file, searched by their sums of scores."""

    def __init__(self, path: str) -> None:
        with open(path, "rb") as f:
            model = f.read()
        self.ids: dict[str, int] = {}
        self.score: list[float] = []
        self.plain: list[bytes] = []
        self.byte: dict[int, int] = {}
        for field, body in _fields(model):
            if field == 1:
                told = dict(_fields(body))
                name, kind = told[1].decode(), told.get(3, 1)
                if kind == BYTE:
                    self.byte[int(name[1:-1], 16)] = len(self.score)
                    self.plain.append(bytes([int(name[1:-1], 16)]))
                else:
                    self.plain.append(name.replace(MARK, " ").encode() if kind in MATCHED else b"")
                    if kind in MATCHED:
                        self.ids.setdefault(name.replace(MARK, " "), len(self.score))
                self.score.append(struct.unpack("<f", told[2])[0] if 2 in told else 0.0)
        self.longest = max(map(len, self.ids))
        # The score of each piece, and None for what only begins one.
        self.walk: dict[str, float | None] = {t[:k]: None for t in self.ids for k in range(1, len(t))}
        self.walk.update((t, self.score[i]) for t, i in self.ids.items())
        self.unknown = min(self.score) - 10.0
        self.cut_at_blanks = not any(re.search(r"[^ ] ", p) for p in self.ids)
        self.memory = _Memory()

    def stream(self) -> StreamingViterbi | StreamingMerges:
        return StreamingViterbi(self)

    def encode(self, text: str | None) -> bytes:
        """The ids of a text as little-endian 32-bit numbers."""
        if not text:
            return b""
        text, stream = " " + text, self.stream()
        return b"".join(stream.add(text[k : k + BLOCK], k + BLOCK >= len(text)) for k in range(0, len(text), BLOCK))

    def decode(self, ids: bytes) -> bytes:
        """The UTF-8 bytes of a text."""
        return b"".join(map(self.plain.__getitem__, np.frombuffer(ids, "<i4").tolist()))[1:]


class _Memory:
    """Ids of text between two certain boundaries; when one half is full, the older one is forgotten."""

    def __init__(self) -> None:
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def put(self, part: str, ids: bytes) -> None:
        if len(self.new) >= MEMORY // 2:
            self.new, self.old = {}, self.new
        self.new[part] = ids


class StreamingViterbi:
    """Feed text, get the ids that can no longer change; ``finish`` gives the rest.

    Starts are weighed one after the other, each with the window of the longest
    piece after it in sight. Where all surviving paths meet in one boundary, what
    lies before it is committed. ``commits`` counts the commits of the search made
    while text was still to come, ``held`` is the most characters open at one.
    """

    def __init__(self, pieces: Pieces) -> None:
        self.pieces = pieces
        self.text, self.at = "", 0  # what was fed, and the base in it: boundaries are counted from there
        self.certain = pieces.cut_at_blanks  # whether nothing after the base depends on what came before
        self.told: list[int] = []  # ids since the base
        self.sent = 0  # so many of them are given out
        self.commits = self.held = 0
        self._restart()

    def _restart(self) -> None:
        self.best, self.back = [0.0], [-1]  # of each boundary
        self.start = self.far = 0  # the next start to weigh, and the furthest boundary that a path has reached
        self.done = 0  # the last committed boundary

    def feed(self, text: str) -> list[int]:
        return np.frombuffer(self.add(text, False), "<i4").tolist()

    def finish(self) -> list[int]:
        return np.frombuffer(self.add("", True), "<i4").tolist()

    def add(self, text: str, last: bool) -> bytes:
        """The ids that are certain with this text, all of them if it is the last."""
        self.text, self.at = self.text[self.at :] + text, 0
        size, out = len(self.text), []
        upto = size if last else size - self.pieces.longest
        while self.at + self.done < size:
            if self.certain and not self.start:
                self._recall(last, out)
            if not self._search(upto, last, out):
                break
        self._send(out)
        return b"".join(out)

    def _send(self, out: list[bytes]) -> None:
        out.append(struct.pack(f"<{len(self.told) - self.sent}i", *self.told[self.sent :]))
        self.sent = len(self.told)

    def _recall(self, last: bool, out: list[bytes]) -> None:
        """Step over parts that the search has been through before, as far as they follow each other."""
        memory, text, at = self.pieces.memory, self.text, self.at
        new, old, size = memory.new.get, memory.old.get, len(self.text)
        for m in PART.finditer(text, at):
            part = m[0]
            ids = new(part)
            if ids is None:
                ids = old(part)
                if ids is None:
                    break
                memory.put(part, ids)
            if m.end() == size and not last:
                break
            out.append(ids)
            at = m.end()
        self.at = at

    def _search(self, upto: int, last: bool, out: list[bytes]) -> bool:
        """Weigh starts and commit where the paths meet, up to a certain boundary; False where that needs more text."""
        while self.at + self.start < upto:
            self._weigh(min(self.start + self.pieces.longest, upto - self.at))
            meeting = self.start if self.far == self.start else self._meeting()
            if meeting > self.done and self._commit(meeting, last, out):
                return True
        return False

    def _grow(self, to: int) -> None:
        """Room for boundaries up to this one."""
        more = to + 1 - len(self.back)
        if more > 0:
            self.best += [float("-inf")] * more
            self.back += [-1] * more

    def _weigh(self, upto: int) -> None:
        """Weigh all pieces of each start, until the paths meet or the window is through; ties stay with the earlier start."""
        text = self.text[self.at : self.at + upto + self.pieces.longest]
        self._grow(len(text))
        best, back, walk, nothing, unknown = self.best, self.back, self.pieces.walk.get, float("inf"), self.pieces.unknown
        start, far, size = self.start, self.far, len(text) + 1
        while start < upto:
            here = best[start]
            far = max(far, start + 1)
            if here + unknown > best[start + 1]:
                best[start + 1], back[start + 1] = here + unknown, start
            for end in range(start + 1, size):
                score = walk(text[start:end], nothing)
                if score is None:
                    continue
                if score == nothing:
                    break
                if here + score > best[end]:
                    best[end], back[end], far = here + score, start, max(far, end)
            start += 1
            if far == start:
                break
        self.start, self.far = start, far

    def _meeting(self) -> int:
        """The last boundary on all paths that can still be extended."""
        live = {k for k in range(self.start, self.far + 1) if self.back[k] >= 0}
        while len(live) > 1:
            last = max(live)
            live.discard(last)
            live.add(max(0, self.back[last]))
        return min(live.pop(), self.start) if live else 0

    def _commit(self, upto: int, last: bool, out: list[bytes]) -> bool:
        """The ids before a boundary no longer change; True where nothing after it depends on them."""
        self.told += self._ids(upto)
        self.held = max(self.held, self.far - self.done)
        at, self.done, now = self.at, upto, self.at + upto
        more = now < len(self.text)
        self.commits += more or not last
        if self.pieces.cut_at_blanks and (self.text[now] == " " != self.text[now - 1] if more else last):
            if self.certain and upto <= LONGEST:
                self.pieces.memory.put(self.text[at:now], struct.pack(f"<{len(self.told)}i", *self.told))
            self._base(upto, out, True)
            self._restart()
            return True
        if upto > LONGEST:
            self._drop(upto)
            self._base(upto, out, False)
        return False

    def _ids(self, upto: int) -> list[int]:
        """The ids from the last commit to a boundary."""
        ids, end, at = [], upto, self.at
        while end > self.done:
            begin = self.back[end]
            text = self.text[at + begin : at + end]
            piece = self.pieces.ids.get(text)
            if piece is None:
                ids += [self.pieces.byte[b] for b in reversed(text.encode())]
            else:
                ids.append(piece)
            end = begin
        return ids[::-1]

    def _base(self, upto: int, out: list[bytes], certain: bool) -> None:
        """Count boundaries from a committed one on."""
        self._send(out)
        self.at, self.certain, self.told, self.sent = self.at + upto, certain, [], 0

    def _drop(self, upto: int) -> None:
        """Forget what lies before a boundary."""
        base = self.best[upto]
        self.best = [x - base for x in self.best[upto : self.far + 1]]
        self.back = [-1, *(b - upto if b >= 0 else -1 for b in self.back[upto + 1 : self.far + 1])]
        self.start, self.far, self.done = self.start - upto, self.far - upto, 0


class _Piece:
    """A piece as the last one before a boundary."""

    __slots__ = ("ids", "left", "near", "rank", "right", "text")

    def __init__(self, text: str, ids: bytes, rank: int) -> None:
        self.text, self.ids = text, ids
        self.rank = rank  # the place of its last merge in the order of merges, -1 for one character
        self.left = self.right = self  # what its last merge joined
        self.near: dict[_Piece, bool] = {}  # whether a piece stays apart from this one


class _Reached(dict):
    """The longest end of the text read that begins a piece; by the next character, that one's. Each is worked out where a text first takes it."""

    __slots__ = ("ending", "few", "open", "pieces", "text")

    def __init__(self, pieces: MergedPieces, text: str) -> None:
        self.pieces, self.text = pieces, text
        ends = [text[-k:] for k in range(len(text), 0, -1)]
        self.ending = [(len(t), node) for t in ends if (len(t) == 1 or t in pieces.ids) and (node := pieces.node(t))]  # the longest first
        self.open = [len(t) for t in ends if t in pieces.begun]  # how far back a piece that goes on may have begun
        self.few = not self.open or self.open[0] == 1

    def __missing__(self, char: str) -> _Reached:
        found = self[char] = self.pieces.reached(self.text + char)
        return found


class MergedPieces(Pieces):
    """The pieces of a BPE model, in the order of its merges."""

    def __init__(self, path: str) -> None:
        super().__init__(path)
        self.begun = {t[:k] for t in self.ids for k in range(1, len(t))}
        scores = sorted({self.score[i] for i in self.ids.values()}, reverse=True)
        place = {x: k for k, x in enumerate(scores)}
        self.rank = {t: place[self.score[i]] for t, i in self.ids.items()}
        self.part = self._parts()
        self.forget()

    def _parts(self) -> re.Pattern[str]:
        """Text up to the next boundary that no piece crosses: before a blank, or between word characters and others."""
        if not self.cut_at_blanks:
            return re.compile(r"(?s).+")
        pairs = {t[k : k + 2] for t in self.ids for k in range(len(t) - 1)}
        word = {c for t in self.ids for c in t if c.isalnum()}
        # Characters that a piece joins to others do not count as word characters.
        while mixed := {c for a, b in pairs if " " not in (a, b) and (a in word) != (b in word) for c in (a, b)} & word:
            word -= mixed
        if not word:
            return PART
        kind = "".join(map(re.escape, sorted(word)))
        return re.compile(f" *[{kind}]+| *[^ {kind}]+| +")

    def forget(self) -> None:
        self.nodes: dict[str, _Piece | None] = {}
        self.states: dict[str, _Reached] = {}
        self.none = _Piece("", b"", -1)
        self.root = _Reached(self, "")
        self.n_known = 0

    def trim(self) -> None:
        """Forget what was found out once it is too much; a search under way goes on with what it holds."""
        if self.n_known > KNOWN:
            self.forget()

    def stream(self) -> StreamingMerges:
        return StreamingMerges(self)

    def merge(self, text: str) -> tuple[str, str] | None:
        """Plain merging, highest score first and then leftmost, of one piece: the two parts joined last, None where it does not come about."""
        parts, none, get = list(text), len(self.rank), self.rank.get
        ranks = [get(a + b, none) for a, b in zip(parts, parts[1:], strict=False)]
        while len(parts) > 2:
            best = min(ranks)
            if best == none:
                return None
            at = ranks.index(best)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del ranks[at]
            if at:
                ranks[at - 1] = get(parts[at - 1] + parts[at], none)
            if at < len(ranks):
                ranks[at] = get(parts[at] + parts[at + 1], none)
        return parts[0], parts[1]

    def node(self, text: str) -> _Piece | None:
        """A piece, or a character that no piece covers; None for a piece whose own text is encoded otherwise."""
        if text in self.nodes:
            return self.nodes[text]
        piece = self.ids.get(text)
        ids = [self.byte[b] for b in text.encode()] if piece is None else [piece]
        found = _Piece(text, struct.pack(f"<{len(ids)}i", *ids), self.rank[text] if len(text) > 1 else -1)
        if len(text) > 1:
            if joined := self.merge(text):
                found.left, found.right = map(self.node, joined)
            else:
                found = None
        self.nodes[text] = found
        self.n_known += 1
        return found

    def reached(self, text: str) -> _Reached:
        while len(text) > 1 and text not in self.walk:
            text = text[1:]
        found = self.states.get(text)
        if found is None:
            found = self.states[text] = _Reached(self, text)
        self.n_known += 1
        return found

    def apart(self, before: _Piece, piece: _Piece) -> bool:
        """Whether two pieces, side by side, are encoded as just these two.

        Their merges are undone from the last one on. They stay apart if what
        touches at the boundary was at no time to be joined before the merge
        undone last; of equal merges the left one goes first.
        """
        a, b, limit, get, ok = before, piece, len(self.rank), self.rank.get, True
        while a.text:
            if get(a.text + b.text, limit) < limit:
                ok = False
                break
            if a.rank > b.rank:
                limit, a = a.rank, a.right
            elif b.rank >= 0:
                limit, b = b.rank + 1, b.left
            else:
                break
        before.near[piece] = ok
        self.n_known += 1
        return ok


class StreamingMerges:
    """The same window and commits; a back-pointer holds where the last two pieces stay apart.

    Just one start is right for each end, so ends are weighed one after the other
    and a back-pointer is never replaced. The meeting of paths is looked for where
    at most the last character may begin a piece that goes on, and at each
    character once the window is through. ``commits`` counts those that the search
    commits, ``held`` is the most characters open at one.
    """

    def __init__(self, pieces: MergedPieces) -> None:
        self.pieces = pieces
        self.text = ""  # the begin of a part that is not searched yet
        self.before = ""  # the last character of a part that is searched and may go on
        self.commits = self.held = 0
        self._restart()

    def _restart(self) -> None:
        self.last = [self.pieces.none]  # the piece that ends at each boundary, from the base on
        self.reached = self.pieces.root
        self.done = 0  # the last committed boundary

    def feed(self, text: str) -> list[int]:
        return np.frombuffer(self.add(text, False), "<i4").tolist()

    def finish(self) -> list[int]:
        return np.frombuffer(self.add("", True), "<i4").tolist()

    def add(self, text: str, last: bool) -> bytes:
        """The ids that are certain with this text, all of them if it is the last."""
        pieces, text, self.text = self.pieces, self.text + text, ""
        at, out, tail = 0, [], ""
        if self.before:
            at = pieces.part.match(self.before + text).end() - 1
            out.append(self._search(text[:at], last or at < len(text)))
        parts = pieces.part.findall(text, at)
        if parts and not last:
            tail = parts.pop()
        found = list(map(pieces.memory.new.get, parts))
        for k, ids in enumerate(found):
            if ids is None:
                found[k] = self._part(parts[k])
        out += found
        if len(tail) > pieces.longest:
            out.append(self._search(tail, False))
        else:
            self.text = tail
        return b"".join(out)

    def _part(self, part: str) -> bytes:
        """The ids of a part, remembered or searched."""
        memory = self.pieces.memory
        ids = memory.new.get(part)
        if ids is None:
            ids = memory.old.get(part)
            if ids is None:
                ids = self._search(part, True)
            if len(part) <= LONGEST:
                memory.put(part, ids)
        return ids

    def _search(self, text: str, ends: bool) -> bytes:
        """The ids that are certain with this text of a part, all of them where the part ends."""
        pieces, reached, last, done, out = self.pieces, self.reached, self.last, self.done, []
        end, longest = len(last) - 1, pieces.longest
        for char in text:
            reached = reached[char]
            end += 1
            for size, piece in reached.ending:
                before = last[end - size]
                ok = before.near.get(piece)
                if pieces.apart(before, piece) if ok is None else ok:
                    last.append(piece)
                    break
            if reached.few or end - done > longest:
                meeting = self._meeting(end, reached.open)
                if meeting > done:
                    self.held = max(self.held, end - done)
                    self.commits += 1
                    out.append(self._ids(meeting, done))
                    done = meeting
                    if end > LONGEST:
                        del last[:done]
                        end, done = end - done, 0
                        pieces.trim()
        self.reached, self.done, self.before = reached, done, text[-1:] or self.before
        if ends:
            out.append(self._ids(end, done))
            self.before = ""
            pieces.trim()
            self._restart()
        return b"".join(out)

    def _meeting(self, end: int, begun: list[int]) -> int:
        """The last boundary on all paths that can still be extended."""
        live = {end, *(end - k for k in begun)}
        while len(live) > 1:
            furthest = max(live)
            live.discard(furthest)
            live.add(furthest - len(self.last[furthest].text))
        return live.pop()

    def _ids(self, upto: int, done: int) -> bytes:
        """The ids from the last commit to a boundary."""
        found, last = [], self.last
        while upto > done:
            piece = last[upto]
            found.append(piece.ids)
            upto -= len(piece.text)
        return b"".join(found[::-1])


@functools.cache
def pieces(path: str) -> Pieces:
    with open(path, "rb") as f:
        trainer = next((dict(_fields(body)) for field, body in _fields(f.read()) if field == TRAINER), {})
    return MergedPieces(path) if trainer.get(MODEL_TYPE, 1) == BPE else Pieces(path)


def encode_text(docs: DataFrame, model: str = MODEL, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, ids array<int>)`` of each whole text."""
    kind = dict(docs.dtypes)[id_col]

    def encoded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        p = pieces(public_tokenizers.path(model))
        for batch in batches:
            yield pd.DataFrame({id_col: batch[id_col], "ids": [np.frombuffer(p.encode(t), "<i4") for t in batch[text_col]]})

    return docs.select(id_col, text_col).mapInPandas(encoded, f"`{id_col}` {kind}, ids array<int>")


def decode_ids(encoded: DataFrame, model: str = MODEL, id_col: str = "doc_id") -> DataFrame:
    """``(id, text)`` of rows of ids."""
    kind = dict(encoded.dtypes)[id_col]

    def decoded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        p = pieces(public_tokenizers.path(model))
        for batch in batches:
            texts = ["" if x is None else p.decode(np.asarray(x, "<i4").tobytes()).decode(errors="replace") for x in batch["ids"]]
            yield pd.DataFrame({id_col: batch[id_col], "text": texts})

    return encoded.select(id_col, "ids").mapInPandas(decoded, f"`{id_col}` {kind}, text string")


DIGEST = "doc_id long, n_bytes long, n_ids long, ids_sha256 string, decoded_sha256 string, round_trip boolean"


def piece_digest(docs: DataFrame, model: str = MODEL) -> DataFrame:
    """Encode each whole text, decode the ids, and digest both."""

    def digest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        p = pieces(public_tokenizers.path(model))
        for batch in batches:
            rows = []
            for key, text in zip(batch["doc_id"], batch["text"], strict=True):
                ids = p.encode(text)
                raw, back = (text or "").encode(), p.decode(ids)
                rows.append((key, len(raw), len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(back).hexdigest(), back == raw))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in DIGEST.split(", ")])

    return docs.select("doc_id", "text").mapInPandas(digest, DIGEST)
