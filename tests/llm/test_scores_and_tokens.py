"""Language-model scores and the alignment of two tokenizers against brute force."""

import random
import zlib

import brute
import pytest

from hirelake.llm import alignment, backoff
from hirelake.llm.encode import _byte_of_character
from hirelake.llm.queries import bpe_50k, installed

FOLDER = "/root/testdata/sf0.001"
ODD = [
    (None, None), (7, ""), (5, "x\x00y  É É\n\n z"), (5, "x\x00y É É"), (5, "x\x00y É É"), (6, "a▁b"), (8, "</s> <unk> <|endoftext|> a"),
    (9, " "), (10, "\n"), (11, "日本語 ① ﬁ\r\n\tb 😀"), (12, "<0x41> a\na\n"), (13, "w" * 3000), (None, "x A a ÉA"),
]


@pytest.fixture(scope="module")
def rows(spark):
    rng, words = random.Random(3), [f"W{i}" for i in range(300)]
    long = [(10_000, " ".join(rng.choice(words) for _ in range(20_000)))]
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").orderBy("doc_id")
    return [tuple(r) for r in docs.collect() if len(r.text) < 5000] + ODD, long


def frame(spark, rows):
    return spark.createDataFrame([(*r, "clash", 1) for r in rows], "doc_id long, text string, chunk string, n long")


def in_order(rows):
    return sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[2], str(r)))


@pytest.mark.parametrize("order", [1, 2, 3])
def test_language_model_scores(spark, rows, order):
    some = rows[0] + rows[1]
    # Many small chunks and buckets, so that counts meet from many sides.
    got = backoff.language_model_scores(frame(spark, some), order=order, chunk_bytes=50_000, bucket_bytes=2_000)
    got = in_order(tuple(r)[:7] for r in got.collect())
    want = in_order(brute.language_model(some, order, 500.0))
    assert [r[:5] for r in got] == [r[:5] for r in want]
    for g, w in zip(got, want, strict=True):
        assert g[5:] == pytest.approx(w[5:], abs=1e-6)


def test_language_model_without_training_or_rows(spark):
    held = [(i, "a b") for i in range(40) if zlib.crc32(str(i).encode()) % 7 == 2]
    for r in backoff.language_model_scores(frame(spark, held)).collect():
        assert r.held_out and r.n_tokens == 3 and r.n_known == r.train_tokens == r.base_score == r.score == 0
    assert backoff.language_model_scores(frame(spark, held).limit(0)).count() == 0


def test_counts_above_one_byte():
    import numpy as np

    counts = np.array([0, 1, 254, 255, 256, 10**12])
    assert backoff.unpack_counts(*backoff.pack_counts(counts)).tolist() == counts.tolist()
    for kind in ("u1", "<u2"):
        assert alignment.unpacked(*alignment.packed(counts, kind), kind).tolist() == counts.tolist()


def test_model_beats_single_words_on_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    scores = backoff.language_model_scores(docs).filter("held_out").selectExpr("sum(score) AS s", "sum(base_score) AS b").first()
    assert scores.s > 0.95 * scores.b


@pytest.fixture(scope="module")
def encoders():
    import sentencepiece
    import tokenizers

    a, byte = tokenizers.Tokenizer.from_file(bpe_50k()), _byte_of_character()
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=installed("piece_bpe_32k.model"))

    def encode_a(text):
        return [(i, bytes(byte[c] for c in a.id_to_token(i))) for i in a.encode(" " + text, add_special_tokens=False).ids]

    def encode_b(text):
        pieces = [(i, b.id_to_piece(i)) for i in b.encode(text)]
        return [(i, bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode()) for i, p in pieces]

    return encode_a, encode_b


@pytest.mark.parametrize("chunk", [3_000, 4_000_000])
def test_alignment(spark, rows, encoders, chunk):
    some = rows[0]
    got = alignment.aligned_tokens(frame(spark, some), bpe_50k(), installed("piece_bpe_32k.model"), chunk_chars=chunk)
    assert in_order(map(tuple, got.collect())) == in_order(brute.alignment(some, *encoders))


def test_alignment_of_a_long_text_and_of_nothing(spark, rows, encoders):
    got = alignment.aligned_tokens(frame(spark, rows[1]), bpe_50k(), installed("piece_bpe_32k.model")).first()
    text = rows[1][0][1]
    assert (got.n_a, got.n_b) == tuple(len(e(text)) for e in encoders) and got.n_links == got.n_a + got.n_b - got.n_groups
    assert alignment.aligned_tokens(frame(spark, ODD).limit(0), bpe_50k(), installed("piece_bpe_32k.model")).count() == 0


def test_cached_words_and_whole_texts_agree(rows, encoders):
    small = alignment.TwoEncoders(bpe_50k(), installed("piece_bpe_32k.model"), cache_words=40)
    texts = [t for _, t in rows[0] if t]
    for (a, b), text in zip(small.encode(texts), texts, strict=True):
        whole = small._whole(text)
        assert (a, b) == whole
