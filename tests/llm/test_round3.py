"""Hard negatives, decontamination and alignment against brute force, with nulls, ties, repeated rows and odd columns."""

import collections
import hashlib
import math
import random
import re
import string

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from stormframe.llm import decontaminate, hard_negatives, token_alignment
from tokenizers import Tokenizer

VECTOR = "vec_id long, embedding array<float>, label int"


def brute_negatives(rows, count=5):
    used = {}
    for key, vector, label in rows:
        if key is None or label is None or vector is None or any(x is None or not math.isfinite(x) for x in vector):
            continue
        told = ((label + 1) % 10 if key % 7 == 0 else label, [math.floor(float(np.float32(x)) * 256) for x in vector])
        used[key] = min(used.get(key, told), told)
    out = set()
    for a, (label, v) in used.items():
        if a % 100:
            continue
        scored = sorted((-sum(x * y for x, y in zip(v, w, strict=True)), k, own) for k, (own, w) in used.items() if k != a and len(w) == len(v))
        for p, positive, _ in [s for s in scored if s[2] == label][:count]:
            inside = [s for s in scored if s[2] != label and 80 * -p <= 100 * -s[0] <= 100 * -p][:count]
            out |= {(a, positive, k + 1, s[1], -p, -s[0]) for k, s in enumerate(inside)}
    return out


@pytest.mark.parametrize("bucket", [1024, 8])
def test_hard_negatives(spark, bucket):
    r = random.Random(bucket)
    rows = [(k, [r.gauss(0, 1) * (1 + k % 9) for _ in range(6)], r.randrange(3)) for k in range(900)]
    rows += [(1000 + k, rows[100][1], k % 3) for k in range(60)]  # ties
    rows += [(2000, None, 1), (2100, [1.0] * 6, None), (2200, [None] * 6, 1), (2300, [float("nan")] * 6, 1), (2400, [float("inf")] * 6, 2), (None, [1.0] * 6, 1)]
    rows += [(2500, [0.0] * 6, 1), (2600, [1.0, 2.0], 0), (2601, [1.0, 2.5], 0), (2602, [1.0, 2.0], 1), (2700, [], 0), (2701, [], 0), (2702, [], 1)]
    rows += [rows[200], (300, rows[7][1], 2), (300, rows[7][1], 2)]  # repeated rows and a shared id
    told = spark.createDataFrame([(*x, "label") for x in rows], VECTOR + ", block string")
    got = [tuple(x) for x in hard_negatives.negatives_digest(told, hard_negatives.Sizes(bucket, 4000, 400)).collect()]
    assert len(got) == len(set(got)) and set(got) == brute_negatives(rows)


def test_hard_negatives_of_nothing_and_of_great_numbers(spark):
    assert hard_negatives.negatives_digest(spark.createDataFrame([], VECTOR)).count() == 0
    rows = [(k, [3e5 + k, -2e5, 1e5 * (k % 4)], k % 2) for k in range(0, 400, 5)] + [(1, [1e30, 0.0, 0.0], 1)]
    got = {tuple(x) for x in hard_negatives.negatives_digest(spark.createDataFrame(rows, VECTOR)).collect()}
    assert got == brute_negatives(rows[:-1]) and got


def test_kernel_prunes_and_stays_exact():
    r = np.random.default_rng(3)
    vectors = np.sort(r.integers(-50, 50, (4096, 4)), axis=0)
    vectors = vectors[np.argsort(-(vectors**2).sum(axis=1))]
    norms = np.sqrt((vectors**2).sum(axis=1))
    side = {"ids": np.arange(4096), "labels": np.zeros(4096, np.int64), "vectors": vectors, "norms": norms, "tops": norms[::1024]}
    seen = []
    exact, hard_negatives._products = hard_negatives._products, lambda a, b: seen.append(b) or exact(a, b)
    try:
        ask = np.array([[4095, hard_negatives.NONE + 1, 1 << 60, hard_negatives.NONE + 1]])
        got = hard_negatives.first_in_windows(side, ask, True, side, 5, 1024)
    finally:
        hard_negatives._products = exact
    products = vectors @ vectors[4095]
    want = sorted((-int(products[k]), k) for k in range(4095))[:5]
    assert [(-s, k) for _, k, s in got.tolist()] == want and len(seen) < 4


WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute_leaks(texts, items, size=10):
    low = lambda t: WORD.findall((t or "").translate(str.maketrans(string.ascii_uppercase, string.ascii_lowercase)))
    windows = collections.defaultdict(set)
    for key, text in items:
        w = low(text)
        for k in range(max(1, len(w) - size + 1)) if w else ():
            windows[tuple(w[k : k + size])].add(key)
    out = []
    for key, text in texts:
        w, hit, found = low(text), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in windows:
                    hit.update(range(k, k + n))
                    found |= windows[tuple(w[k : k + n])]
        names = sorted(str(x) for x in found if x is not None)
        out.append((key, len(w), len(hit), len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), bool(hit)))
    return out


@pytest.mark.parametrize("limit", [decontaminate.BROADCAST_CHARS, 0])
def test_decontamination(spark, limit):
    r = random.Random(12)
    some = lambda n: " ".join(r.choice("a b c d é Ab 7 ñu x1".split()) for _ in range(n))
    items = [(k, some(r.choice([1, 3, 9, 10, 11, 25]))) for k in range(10, 25)] + [(2, None), (3, ""), (4, "?!"), (None, some(12)), (5, some(4)), (5, some(14))]
    items += [items[1]]
    texts = [None, "", "...", "É", "x1", "A B", some(9)] + [some(r.randrange(80)) for _ in range(40)]
    texts += [f"{some(5)}, {t}\n{some(3)}" for _, t in items if t] + [some(4000)]
    rows = [*enumerate(texts), (3, texts[-2]), (7, texts[7]), (7, texts[7]), (None, texts[-2]), (None, texts[8]), (None, texts[8])]
    docs = spark.createDataFrame([(k, t, "s", "own") for k, t in rows], "doc_id long, text string, h string, hit string")
    out = decontaminate.decontaminate(docs, spark.createDataFrame(items, "item_id long, text string"), limit=limit)
    assert out.columns[:4] == docs.columns and out.filter("h = 's' and hit = 'own'").count() == len(rows)
    got = out.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated").collect()
    assert collections.Counter(map(tuple, got)) == collections.Counter(brute_leaks(rows, items))
    none = docs.filter("doc_id < 0")
    assert decontaminate.leak_digest(none, spark.createDataFrame(items, "item_id long, text string")).count() == 0
    clean = decontaminate.leak_digest(docs, spark.createDataFrame([], "item_id long, text string"))
    assert clean.filter("contaminated").count() == 0 and clean.count() == len(rows)


def brute_alignment(texts):
    a = Tokenizer.from_file(public_tokenizers.path(token_alignment.SIDE_A))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(token_alignment.SIDE_B))
    letters = token_alignment._byte_letters()
    plain = lambda i: bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()
    told = []
    for text in texts:
        ids_a = a.encode(" " + text, add_special_tokens=False).ids if text else []
        ids_b = b.encode(text) if text else []
        raw_a, raw_b = [bytes(map(letters.get, a.id_to_token(i))) for i in ids_a], [plain(i) for i in ids_b]
        if not text or b"".join(raw_a) != (" " + text).encode() or b"".join(raw_b) != (" " + text).encode():
            told.append(None)
            continue
        ends_a, ends_b = np.cumsum([*map(len, raw_a)]), np.cumsum([*map(len, raw_b)])
        cuts = np.intersect1d(ends_a, ends_b)
        parts = [([], []) for _ in cuts]
        for side, (ids, ends) in enumerate(((ids_a, ends_a), (ids_b, ends_b))):
            for i, e in zip(ids, ends, strict=True):
                parts[int(np.searchsorted(cuts, e))][side].append(i)
        told.append((len(ids_a), len(ids_b), parts, [(x, y) for p, q in parts for x in p for y in q]))
    counts = collections.Counter(pair for t in told if t for pair in set(t[3]))
    best = collections.defaultdict(int)
    for (x, _), n in counts.items():
        best[x] = max(best[x], n)
    for k, t in enumerate(told):
        if t is None:
            yield (k, 0, 0, 0, 0, 0, 0, "")
            continue
        n_a, n_b, parts, links = t
        text = ";".join(f"{','.join(map(str, p))}|{','.join(map(str, q))}" for p, q in parts)
        yield (k, n_a, n_b, len(parts), len(links), sum(counts[x] == best[x[0]] for x in links), sum(counts[x] for x in links), hashlib.sha256(text.encode()).hexdigest())


ODD = [None, "", " ", "  ", "a", " a", "a ", "a  ", "\n", "\n a\n\n b \n", "ab 'll x <|endoftext|>y", "</s> <s> <unk>", "é日本 語\n\n x", "▁ x", "x▁", "\x00 \x1c a\x1c b", "a  b　 c  d", "x" * 3000, "日本語 " * 300, "🙂👩‍👩‍👧 é", "a\tb\t c \r\n d", "the the the", "the the the", "don't 12 345 ,,; x's"]


@pytest.mark.parametrize(("stretch", "pairs"), [(token_alignment.STRETCH, token_alignment.BROADCAST_PAIRS), (7, 0)])
def test_alignment(spark, stretch, pairs):
    texts = ODD + [r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").orderBy("doc_id").limit(120).collect()]
    docs = spark.createDataFrame([(k, t, 1) for k, t in enumerate(texts)], "doc_id long, text string, n_a int").repartition(4)
    out = token_alignment.align_corpus(docs, broadcast_pairs=pairs, stretch=stretch).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
    assert sorted(map(tuple, out.collect())) == list(brute_alignment(texts))
    assert token_alignment.align_corpus(docs.filter("doc_id < 0")).count() == 0


def test_alignment_memory_is_bounded(monkeypatch):
    paths = [public_tokenizers.path(x) for x in (token_alignment.SIDE_A, token_alignment.SIDE_B)]
    whole, small = token_alignment.Aligner(*paths), token_alignment.Aligner(*paths)
    texts = [" ".join(f"w{k}x{j}" for j in range(40)) for k in range(8)]
    want = [t[:5] for t in whole.align_all(texts * 2)]
    monkeypatch.setattr(token_alignment, "MEMORY", 50)
    assert [t[:5] for x in texts * 2 for t in small.align_all([x])] == want and len(small.known) <= 50


def test_pipeline_stages_keep_columns_of_any_name(spark):
    import corpus_pipeline
    from pyspark.sql import functions as F

    r = random.Random(9)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(r.randrange(2, 9)))
    texts = [" ".join(word() for _ in range(120)) + "." for _ in range(60)]
    texts += texts[:3] + [None, ""]
    rows = [(k, t, "en", "s", len(t or ""), f"own {k}", k * 3, -0.5, "c", k / 2) for k, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, kept string, N_shingles int, quality_score double, component_id string, n_words double")
    labels = spark.createDataFrame([(k, k % 2, 0) for k in range(60)], "doc_id long, quality int, toxic int")
    told = {r[0]: r[5:] for r in rows}
    for name, stage in corpus_pipeline.STAGES[:4]:
        if name == "quality classifier":
            folder = docs.sparkSession.sparkContext.getCheckpointDir()
            labels.write.mode("overwrite").parquet(f"{folder}/labels.parquet")
            out = stage(spark, docs.filter("text <> ''"), folder)
        else:
            out = stage(spark, docs, "")
        assert out.columns == docs.columns and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema]
        got = out.select("doc_id", "kept", "N_shingles", "quality_score", "component_id", "n_words").collect()
        assert got and all(told[x[0]] == tuple(x[1:]) for x in got)
        assert stage(spark, docs.filter(F.lit(False)), folder if name == "quality classifier" else "").count() == 0
