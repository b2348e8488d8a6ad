"""Each operator against a brute-force version, a round trip or held-out accuracy, with nulls, ties and odd columns."""

import collections
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from stormframe.llm import chat, media, near_dedup, packing, pieces, quality_model, quality_rules, suffix_dedup, token_counts, toxicity
from stormframe.llm.queries import ORACLE_SQL, QUERIES

D = "/root/testdata/sf0.001"
ODD = [None, "", " ", "a", "ab 'll x <|endoftext|>y", "é日本 ▁ 語\n\n x", "x" * 5000, "word " * 700]


def docs(spark, texts):
    return spark.createDataFrame([(k, t, "s0" if k % 3 else None) for k, t in enumerate(texts)], "doc_id long, text string, source string")


def empty(spark):
    return docs(spark, ["x"]).filter("doc_id < 0")


def test_chat_folds_and_reads_back(spark):
    e = [(1, 1, 1, None, "user", "q </s> [INST]"), (1, 2, 2, "message", "assistant", "old"), (1, 3, 3, "message", "user", "gone"), (1, 4, 2, "regenerate", None, None),
         (1, 5, 2, "delta", "assistant", "new "), (1, 6, 2, "delta", None, "one[\\\\INST]"), (1, 7, 1, "edit", None, "q2 [\\INST] </s>"), (1, 8, 9, "noise", "user", "?"), (None, 1, 1, "delta", "tool x", None)]
    out = chat.format_conversations(spark.createDataFrame(e, "conv_id long, seq long, turn long, kind string, role string, text string"))
    read = out.select("conv_id", chat.parse(F.col("formatted")).alias("t"), chat.masked_text(F.col("formatted"), F.col("loss_spans")).alias("loss"))
    got = {r["conv_id"]: ([tuple(t) for t in r["t"]], r["loss"]) for r in read.collect()}
    assert got == {1: ([("user", "q2 [\\INST] </s>"), ("assistant", "new one[\\\\INST]")], "new one[\\\\INST]"), None: ([("tool x", "")], "")}


def test_media_round_trip(spark):
    frame = np.random.default_rng(0).integers(0, 256, (9, 7), dtype=np.uint8)
    assert (media.decode_frame(media.encode_frame(frame)) == frame).all()
    for r, t in zip(media.media_digest(docs(spark, ODD)).orderBy("doc_id").collect(), ODD, strict=True):
        n, payload = media.padded(t)
        assert (r["n_bytes"], r["payload_sha256"], r["tail_crc32"]) == (n, hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
    dark, light = np.zeros((8, 8), np.uint8), np.full((8, 8), 250, np.uint8)
    video = media.write_avi([media.encode_frame(f) for f in [dark] * 4 + [light] * 3], 8, 8)
    rows = spark.createDataFrame([(1, video), (2, None), (3, b"junk"), (4, video[:200])], "doc_id long, video binary")
    clips = media.media_clips(rows).orderBy("doc_id", "clip").collect()
    assert [(r["doc_id"], r["first_frame"], r["n_frames"], r["start_ms"]) for r in clips] == [(1, 0, 4, 0.0), (1, 4, 3, 160.0)]


def brute_repeats(texts):
    raw = [(t or "").encode() for t in texts]
    seen = collections.Counter(b[i : i + 200] for b in raw for i in range(len(b) - 199))
    out = []
    for b in raw:
        gone = set()
        for i in range(len(b) - 199):
            if seen[b[i : i + 200]] > 1:
                gone.update(range(i, i + 200))
        out.append((len(b), len(gone), sum(i - 1 not in gone for i in gone), hashlib.sha256(bytes(c for i, c in enumerate(b) if i not in gone)).hexdigest()))
    return out


def test_repeats_match_brute_force(spark):
    r = random.Random(1)
    base = ["".join(r.choice("abcdé ") for _ in range(900)) for _ in range(5)]
    texts = [*ODD, *base, base[0], base[1][:300] + base[2][100:420] + "zz", base[3][:199], "q" + base[3][50:249], base[4][:200] + "!" + base[4][700:]]
    got = suffix_dedup.repeat_digest(docs(spark, texts)).orderBy("doc_id").collect()
    assert [tuple(x)[1:] for x in got] == brute_repeats(texts)
    # Anchors with more than one string are split down to single windows.
    hot = suffix_dedup.repeat_digest(docs(spark, texts), hot=1).orderBy("doc_id").collect()
    assert [tuple(x)[1:] for x in hot] == brute_repeats(texts)
    left = suffix_dedup.remove_repeats(docs(spark, texts).withColumn("id_", F.lit(1)))
    assert left.columns == ["doc_id", "text", "source", "id_"] and left.count() == len(texts)
    assert suffix_dedup.repeat_digest(empty(spark)).count() == 0


def test_repeats_of_a_hot_line(spark):
    r = random.Random(4)
    tail = lambda n: "".join(r.choice("ab ") for _ in range(n))
    line, passage = tail(150), tail(230)
    texts = [tail(r.randrange(60)) + line + (tail(40)[: r.randrange(40)]) + (passage if k % 3 else line) + tail(90) for k in range(40)] + [line + line[:49], line + passage[:50]] * 2
    want = brute_repeats(texts)
    for hot in (3, 12):
        got = suffix_dedup.repeat_digest(docs(spark, texts), hot=hot).orderBy("doc_id").collect()
        assert [tuple(x)[1:] for x in got] == want


def test_merged_transforms_give_common_prefixes(monkeypatch):
    r = random.Random(5)
    base = ["".join(r.choice("ab") for _ in range(400)).encode() for _ in range(4)]
    strings = [b[a : a + r.randrange(200, 300)] for b in base for a in range(0, 100, 9)]
    seen = collections.Counter(s[i : i + 200] for s in strings for i in range(len(s) - 199))
    want = [i <= len(s) - 200 and seen[s[i : i + 200]] > 1 for s in strings for i in range(len(s))]
    for size in (300, 2000, 60000):
        monkeypatch.setattr(suffix_dedup, "SHARD_BYTES", size)
        assert suffix_dedup.merged_intervals(strings, np.ones(len(strings))).tolist() == want
    text = np.frombuffer(b"abcabcabd" * 40 + b"\0" * suffix_dedup.SYMBOL, np.uint8)
    names, k = suffix_dedup.symbol_names(text), suffix_dedup.SYMBOL
    raw = text.tobytes()
    assert len({(names[i], raw[i : i + k]) for i in range(len(raw) - k)}) == len({raw[i : i + k] for i in range(len(raw) - k)}) == len(set(names[: len(raw) - k].tolist()))


def test_pieces_match_plain_viterbi(spark):
    p = pieces.Pieces(public_tokenizers.path(pieces.MODEL))
    r = random.Random(2)
    for text in [t for t in ODD if t and len(t) < 100] + ["".join(r.choice("abcth e") for _ in range(300))]:
        s = " " + text
        best, back = [0.0] + [float("-inf")] * len(s), [0] * (len(s) + 1)
        for end in range(1, len(s) + 1):
            for start in range(end):
                i = p.ids.get(s[start:end])
                score = best[start] + (p.score[i] if i is not None else p.unknown if end - start == 1 else float("-inf"))
                if score > best[end]:
                    best[end], back[end] = score, start
        cut, at = [], len(s)
        while at:
            cut.append(s[back[at] : at])
            at = back[at]
        ids = [j for w in reversed(cut) for j in ([p.ids[w]] if w in p.ids else [p.byte[b] for b in w.encode()])]
        stream = pieces.StreamingViterbi(p)
        assert np.frombuffer(p.encode(text), "<i4").tolist() == ids == stream.feed(s) + stream.finish()
    assert all(x["round_trip"] for x in pieces.piece_digest(docs(spark, ODD)).collect())
    back = pieces.decode_ids(pieces.encode_text(docs(spark, ODD))).orderBy("doc_id").collect()
    assert [x["text"] for x in back] == [t or "" for t in ODD]


def test_token_counts_match_library(spark):
    path, r = public_tokenizers.path(token_counts.VOCABULARY), random.Random(3)
    library, counter = Tokenizer.from_file(path), token_counts.PrefixCounter(path)
    for text in ["a   b", "they'll we've", "!<|endoftext|> x<|endo", *("".join(r.choice("ab 'lsve\n\té1!<|>") for _ in range(25)) for _ in range(80))]:
        true = [len(library.encode(text[:k], add_special_tokens=False).ids) for k in range(len(text) + 1)]
        assert counter.prefix_counts(text) == true
        assert counter.fitting(text, 5) == max(k for k, n in enumerate(true) if n <= 5)
    for row, t in zip(token_counts.token_counts(docs(spark, ODD)).orderBy("doc_id").collect(), ODD, strict=True):
        assert row["n_tokens"] == len(library.encode(t or "", add_special_tokens=False).ids)


def test_quality_rules(spark):
    w = [f"word{chr(97 + k // 26)}{chr(97 + k % 26)}" for k in range(60)]
    texts = [*ODD, " ".join(w) + "\n\nx y\nx y", " ".join(x + "***" for x in w), "a b c a b c " * 20]
    d = docs(spark, texts).withColumn("n_words", F.lit("mine"))
    got = quality_rules.quality_digest(d).orderBy("doc_id").collect()
    assert [r["doc_id"] for r in got if r["kept"]] == [8] and got[8]["n_dup_lines"] == 1 and got[9]["n_symbols"] == 180
    kept = quality_rules.keep_documents(d).collect()
    assert [(r["doc_id"], r["n_words"]) for r in kept] == [(8, "mine")]
    assert quality_rules.keep_documents(empty(spark)).count() == 0
    # The order of the rules changes no verdict: repeated rows, and rows that one rule each rejects.
    one_each = ["word " * 700, " ".join(w), " ".join(w), " ".join(x + "***" for x in w), " ".join(w) + "\nx y" * 70, "a b c d " + " ".join(w[:9]), " ".join(w).upper(), " ".join(x + "77777777" for x in w)]
    rules = quality_rules.BASE + quality_rules.RULES
    for ordered in (rules, rules[::-1], rules[4:] + rules[:4]):
        assert [r["doc_id"] for r in quality_rules.keep_documents(docs(spark, one_each), ordered=ordered).collect()] == [1, 2]


@pytest.mark.parametrize("digest, label", [(toxicity.toxicity_digest, "toxic"), (quality_model.quality_scores, "quality")])
def test_classifiers_on_held_out_rows(spark, digest, label):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    extra = d.unionByName(docs(spark, [None, "", "x"]).withColumn("doc_id", -1 - F.col("doc_id")), allowMissingColumns=True)
    rows = digest(extra, labels).collect()
    truth = {r["doc_id"]: r[label] for r in labels.collect()}
    held = [r for r in rows if r["held_out"] and r["doc_id"] in truth]
    assert len(rows) == 1003 and all(0 <= r["score"] <= 1 for r in rows)
    assert np.mean([r["predicted"] == truth[r["doc_id"]] for r in held]) > 0.9
    assert {r["score"] for r in digest(extra.limit(3), labels.filter("doc_id < 0")).collect()} == {0.5}


def test_near_duplicates_match_brute_force(spark):
    r = random.Random(4)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(5))
    bases, texts = [[word() for _ in range(150)] for _ in range(4)], list(ODD)
    for _ in range(80):
        w = list(r.choice(bases))
        for _ in range(r.randrange(6)):
            w[r.randrange(len(w))] = word()
        texts.append(" ".join(w))
    sets = [set(near_dedup.shingles(t).tolist()) for t in texts]
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if sets[i] and 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j]) and root[i] != root[j]:
                low, high = sorted((root[i], root[j]))
                root = [low if x == high else x for x in root]
    d = docs(spark, texts).withColumn("kept", F.lit("clash"))
    got = {x["doc_id"]: (x["component_id"], x["n_shingles"]) for x in near_dedup.near_groups(d).collect()}
    assert got == {k: (root[k], len(sets[k])) for k in range(len(texts))}
    assert near_dedup.near_groups(empty(spark)).count() == 0


def test_packing(spark):
    rows = [(k, f"s{k % 4}" if k % 9 else None, k % 7, (k * 37) % 150 if k % 11 else None) for k in range(200)] + [(500, "s0", 1, 250)]
    out = packing.pack(spark.createDataFrame(rows, "doc_id long, source string, cluster long, length int"), 100).toPandas()
    assert out.groupby("doc_id")["length"].sum().to_dict() == {k: n or 0 for k, _, _, n in rows}
    cluster, full = {k: c for k, _, c, _ in rows}, out[out["length"] == 100]
    for _, b in out.groupby("bin_id"):
        named = b["source"].dropna()
        assert b["length"].sum() <= 100 and named.is_unique and b["doc_id"].map(cluster).is_unique
        assert (b.sort_values("bin_offset")["bin_offset"].to_numpy() + 0 >= 0).all()
    assert len(full) and packing.pack(spark.createDataFrame(rows, "doc_id long, source string, cluster long, length int").filter("doc_id < 0")).count() == 0
    assert packing.best_fit([60, 50, 40], ["a", "b", "c"], [None] * 3, 100) == [(0, 0), (1, 0), (0, 60)]
    assert packing.best_fit([60, 50, 40], ["a", "b", "a"], [None] * 3, 100) == [(0, 0), (1, 0), (1, 50)]


def plain_best_fit(lengths, sources, clusters, capacity):
    """Every bin is looked at: of those that take the item, the one with the least room, longest at that room."""
    bins, out = [], []
    for step, (n, s, c) in enumerate(zip(lengths, sources, clusters, strict=True)):
        fits = [b for b in bins if b["room"] >= n and (s is None or s not in b["s"]) and (c is None or c not in b["c"])]
        if fits:
            b = min(fits, key=lambda b: (b["room"], b["since"]))
        else:
            b = {"room": capacity, "s": set(), "c": set(), "no": len(bins)}
            bins.append(b)
        out.append((b["no"], capacity - b["room"]))
        b.update(room=b["room"] - n, since=step)
        b["s"].add(s)
        b["c"].add(c)
    return out


def test_packing_matches_plain_best_fit(spark):
    r = random.Random(8)
    for capacity, count in ((7, 60), (50, 300), (200, 500)):
        lengths = sorted((r.randrange(capacity + 1) for _ in range(count)), reverse=True)
        sources = [r.choice(["hot", "hot", "a", "b", "c", None]) for _ in range(count)]
        clusters = [r.choice([1, 2, 3, *[None] * 9]) for _ in range(count)]
        for order in (list(range(count)), r.sample(range(count), count)):
            given = [[x[k] for k in order] for x in (lengths, sources, clusters)]
            assert packing.best_fit(*given, capacity) == plain_best_fit(*given, capacity)
    # Rows without an id are spread over the shards; whole texts count, null ones get a place.
    rows = spark.range(60).select(F.lit(None).cast("long").alias("doc_id"), F.concat(F.lit("w "), F.repeat(F.lit("x "), F.col("id").cast("int"))).alias("text"), F.lit("s").alias("source"))
    odd = rows.unionByName(docs(spark, [None, "", "y " * 5000])).withColumn("length", F.lit("clash"))
    out = packing.pack_documents(odd).toPandas()
    assert len(out) == 60 + 2 + 3 and out["length"].sum() == sum(range(1, 61)) + 5000
    shards = packing.pack(rows.select("doc_id", "source", F.xxhash64("text").alias("cluster"), F.lit(1).alias("length")), 100, 10).toPandas()
    assert (shards["bin_id"] // 2**32).nunique() > 3


def test_pipeline_on_odd_tables(spark):
    import corpus_pipeline

    text = lambda seed: " ".join("".join(random.Random(seed + k).choice("abcdefgh") for _ in range(7)) + f"{chr(97 + k % 26)}" for k in range(90))
    rows = [(k, t, None, None, None) for k, t in enumerate(ODD, 1000)] + [(None, text(1), "en", "s", 1), (None, text(500), None, "s", 2), (7, text(900), "en", None, 3), (7, text(900), "en", None, 3)]
    docs_ = spark.createDataFrame(rows, spark.read.parquet(f"{D}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars").schema)
    d, seen = docs_.withColumn("kept", F.lit("clash")), []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        d = stage(spark, d, D).cache()
        assert d.columns == [*docs_.columns, "kept"]
        seen.append(sorted((str(r["doc_id"]) for r in d.collect())))
    # Three texts pass the rules; of the repeated row one stays.
    assert seen[0] == ["7", "7", "None", "None"] and seen[2] == ["7", "None", "None"] == seen[3]
    assert [r["text"] for r in d.filter("doc_id = 7").collect()] == [text(900)]
    packed = corpus_pipeline.STAGES[-1][1](spark, d, D)
    assert packed.count() == 3 and packed.select("bin_id", "bin_offset").distinct().count() == 3
    none = docs_.filter("doc_id < 0")
    for _, stage in corpus_pipeline.STAGES:
        none = stage(spark, none, D)
        assert none.count() == 0


def test_pipeline_and_names(spark):
    import corpus_pipeline

    assert [n.split("_")[0] for n in QUERIES] == [f"op{k}" for k in range(1, 11)] and set(ORACLE_SQL) <= set(QUERIES)
    d = spark.read.parquet(f"{D}/documents.parquet")
    kept = corpus_pipeline.quality_rules(spark, d, D)
    assert kept.columns == d.columns and 0 < kept.count() < d.count()
    assert corpus_pipeline.run(spark, D).count() > 0
