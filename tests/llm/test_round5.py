"""Pieces are merged once each, and text that no piece crosses is remembered apart."""

import random

import numpy as np
import public_tokenizers
import sentencepiece
from stormframe.llm import pieces

PATH = public_tokenizers.path(pieces.MODEL)
SYLLABLES = "th he in er an ing ed ion ou tion ble ly é ß 日 ² 7 19 . ,\n *** $% _ - \t ( ); ▂ \U0001f300".split(" ")


def made(r, n):
    return "".join(r.choice(SYLLABLES) + " " * (r.random() < 0.3) * r.randrange(1, 4) for _ in range(n))


def ids(encoded):
    return np.frombuffer(encoded, "<i4").tolist()


def test_search_does_no_merging_of_neighbours(monkeypatch):
    library, ours, merged, plain = sentencepiece.SentencePieceProcessor(model_file=PATH), pieces.MergedPieces(PATH), [], pieces.MergedPieces.merge
    monkeypatch.setattr(pieces.MergedPieces, "merge", lambda self, text: merged.append(text) or plain(self, text))
    r = random.Random(8)
    for text in (made(r, 2000) for _ in range(5)):
        assert ids(ours.encode(text)) == library.encode(text)
    assert merged and len(merged) == len(set(merged)) and set(merged) <= set(ours.ids)


def test_words_are_remembered_apart_from_marks():
    library, ours = sentencepiece.SentencePieceProcessor(model_file=PATH), pieces.MergedPieces(PATH)
    marks = [".", ",", "!", "***", "$$$", ");\n", "\n\n", "²."]
    text = " ".join(word + mark for word in ("thantion", "heing", "ouat") for mark in marks)
    assert ids(ours.encode(text)) == library.encode(text)
    assert set(ours.memory.new) == {" thantion", " heing", " ouat", *marks}


def test_ids_do_not_depend_on_what_is_remembered(monkeypatch):
    library, r = sentencepiece.SentencePieceProcessor(model_file=PATH), random.Random(9)
    texts = [made(r, 1500), made(r, 1500).replace(" ", ""), "theing" * 900, "x" * 3000, "=" * 700, " " * 500 + "a", "กำ" * 300]
    want = [library.encode(t) for t in texts]
    for known, block, longest, memory in ((50, 7, 5, 4), (1000, 64, 200, 50), (10**6, 4096, 20, 10**6)):
        for name, value in (("KNOWN", known), ("BLOCK", block), ("LONGEST", longest), ("MEMORY", memory)):
            monkeypatch.setattr(pieces, name, value)
        ours = pieces.MergedPieces(PATH)
        for part in (ours.part, pieces.PART, pieces.re.compile(r"(?s).+")):  # also with fewer certain cuts, or none
            ours.part = part
            ours.memory = pieces._Memory()
            assert [ids(ours.encode(t)) for t in texts] == want
        stream = ours.stream()
        early = sum(len(stream.feed(texts[1][k : k + 50])) for k in range(0, len(texts[1]), 50))
        assert early > 0 and stream.commits > 100 and stream.held <= 4 * ours.longest


def test_neighbours_stay_apart_as_merging_has_it():
    ours, r = pieces.MergedPieces(PATH), random.Random(10)
    get, some = ours.rank.get, sorted(t for t in ours.ids if len(t) < 5)

    def merged(text):
        parts = list(text)
        while len(parts) > 1:
            best, at = min((get(a + b, 1 << 60), k) for k, (a, b) in enumerate(zip(parts, parts[1:], strict=False)))
            if best == 1 << 60:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    told = set()
    for _ in range(20000):
        a, b = r.choice(some), r.choice(some)
        if r.random() < 0.5:
            whole = r.choice(some) + a
            k = r.randrange(1, len(whole))
            a, b = whole[:k], whole[k:]
        if a in ours.ids and b in ours.ids:
            x, y = ours.node(a), ours.node(b)
            assert (x is not None) == (merged(a) == [a]) and (y is not None) == (merged(b) == [b])
            if x and y:
                told.add(ok := ours.apart(x, y))
                assert ok == (merged(a + b) == [a, b])
    assert told == {True, False}
