
import random

import corpus_pipeline
import numpy as np
import public_tokenizers
import sentencepiece
from stormframe.llm import near_dedup, pieces

ROW = "doc_id long, text string, lang string, source string, n_chars long"


def rows(spark, pairs):
    return spark.createDataFrame([(k, t, "en", "s", len(t or "")) for k, t in pairs], ROW)


def test_pipeline_stage_links_from_080_on(spark):
    r = random.Random(5)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(6))
    texts = []
    for changed in range(24):
        # A change at k of 200 words, five apart or more, replaces five shingles of 196.
        base = [word() for _ in range(200)]
        copy = list(base)
        for at in range(2, 2 + 10 * (changed % 6), 10):
            copy[at] = word()
        texts += [" ".join(base), " ".join(copy)]
    sets = [set(near_dedup.shingles(t).tolist()) for t in texts]
    near = lambda x, y, least: 100 * len(x & y) >= least * len(x | y)
    assert any(near(x, y, 80) and not near(x, y, 85) for x, y in zip(sets[::2], sets[1::2], strict=True))
    kept = {k for k in range(len(texts)) if not any(near(sets[k], sets[j], 80) for j in range(k))}
    out = corpus_pipeline.minhash_near_dedup(spark, rows(spark, enumerate(texts)), "")
    assert {x["doc_id"] for x in out.collect()} == kept


def test_piece_ids_match_library(spark):
    path, r = public_tokenizers.path(pieces.MODEL), random.Random(6)
    library, ours = sentencepiece.SentencePieceProcessor(model_file=path), pieces.pieces(path)
    d = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    texts = [" population the government", "x" * 5000, " " * 300, "  a   b ", "\u65e5\u672c\u8a9e \U0001f300\n\n x", "\x00\u00e9" * 70]
    texts += ["".join(r.choice("abcth eing") for _ in range(600)).replace(" ", "" if k % 2 else " ") for k in range(20)]
    texts += [x["text"] for x in d.collect() if x["text"]]
    assert len(ours.encode("population the government")) == 4 * 3
    for text in texts:
        ids = library.encode(text)
        if "\u2581" not in text:  # the library takes the mark for a blank; here it is written as bytes
            assert np.frombuffer(ours.encode(text), "<i4").tolist() == ids
            stream, got = ours.stream(), []
            for k in range(0, len(text) + 1, 97):
                got += stream.feed((" " + text)[k : k + 97])
            assert got + stream.finish() == ids


def test_pieces_are_committed_while_text_streams(spark):
    path = public_tokenizers.path(pieces.MODEL)
    library, ours = sentencepiece.SentencePieceProcessor(model_file=path), pieces.MergedPieces(path)
    text = " ".join(f"word{k} untimely remembrances of a gathering" for k in range(3000))
    stream, got, before_end = ours.stream(), [], 0
    for k in range(0, len(text) + 1, 1000):
        got += stream.feed((" " + text)[k : k + 1000])
        before_end = len(got)
    assert got + stream.finish() == library.encode(text)
    # All but the last window is out before the end, by commits of the search, which holds no more than two windows.
    assert len(library.encode(text)) - before_end <= ours.longest and stream.commits > 1000
    assert stream.held <= 2 * ours.longest
    assert np.frombuffer(ours.encode(text), "<i4").tolist() == library.encode(text)  # now from memory
    # Without blanks no boundary is certain beforehand: the paths have to meet.
    joined = text.replace(" ", "")
    stream = ours.stream()
    assert np.frombuffer(stream.add(" " + joined, True), "<i4").tolist() == library.encode(joined)
    assert stream.commits > len(joined) // 100 and stream.held <= 4 * ours.longest


def test_one_row_of_a_group_through_stages_3_and_4(spark):
    r = random.Random(7)
    text = lambda: " ".join("".join(r.choice("abcdefgh") for _ in range(6)) for _ in range(60))
    twice, none, near, shared, other, nulls, many = (text() for _ in range(7))
    pairs = [(1, twice), (1, twice), (None, none), (3, near), (None, near + " end"), (4, shared), (4, other), (2, other), (None, nulls), (None, nulls)]
    pairs += [(6, many), (5, many), (5, many), (7, ""), (None, None), (0, text())]
    d = rows(spark, pairs)
    out = corpus_pipeline.minhash_near_dedup(spark, d, "").cache()
    expected = [(1, twice), (None, none), (3, near), (4, shared), (2, other), (None, nulls), (5, many), (7, ""), (None, None), pairs[-1]]
    assert sorted(map(str, expected)) == sorted(str((x["doc_id"], x["text"])) for x in out.collect())
    after = corpus_pipeline.suffix_array_dedup(spark, out, "")
    assert sorted(map(str, [(k, t or "") for k, t in expected])) == sorted(str((x["doc_id"], x["text"] or "")) for x in after.collect())
    told = {(x["doc_id"], x["text"]): x["component_id"] for x in near_dedup.near_groups(d).collect()}
    assert [told[k] for k in ((4, other), (4, shared), (None, none), (None, near + " end"), (6, many))] == [2, 4, None, 3, 5]
