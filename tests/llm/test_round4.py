"""Strings of hot anchors are told with the runs, so texts are dealt out once."""

import hashlib
import random
import string

from stormframe.llm import suffix_dedup

TEXT = "doc_id long, text string"


def brute_removal(texts):
    seen = {}
    for raw in texts:
        for k in range(len(raw) - 199):
            seen[raw[k : k + 200]] = seen.get(raw[k : k + 200], 0) + 1
    out = []
    for raw in texts:
        gone = [False] * len(raw)
        for k in range(len(raw) - 199):
            if seen[raw[k : k + 200]] > 1:
                gone[k : k + 200] = [True] * 200
        left = bytes(b for b, g in zip(raw, gone, strict=True) if not g)
        out.append((len(raw), sum(gone), sum(g and not p for g, p in zip(gone, [False, *gone], strict=False)), hashlib.sha256(left).hexdigest()))
    return out


def test_hot_strings_need_no_second_deal_of_texts(spark, monkeypatch):
    r = random.Random(4)
    words = lambda n: "".join(r.choices(string.ascii_lowercase + " é", k=n))
    line, other = words(230), words(260)
    texts = [words(r.randrange(150)) + line + words(r.randrange(150)) for _ in range(30)] + [words(90) + other + words(90) for _ in range(4)]
    texts += [texts[0], texts[0], other, "", None, words(400)]
    plans, kept = [], suffix_dedup.stored
    monkeypatch.setattr(suffix_dedup, "stored", lambda df: plans.append(df._jdf.queryExecution().analyzed().toString()) or kept(df))
    want = brute_removal([(t or "").encode() for t in texts])
    docs = spark.createDataFrame(list(enumerate(texts)), TEXT)
    for hot in (1, 8, 2000):
        got = [tuple(x)[1:] for x in suffix_dedup.repeat_digest(docs, hot=hot).orderBy("doc_id").collect()]
        assert got == want
    assert len(plans) > 12 and not any("cuts" in p for p in plans)
