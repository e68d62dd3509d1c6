"""Operators on documents against brute force, with nulls, empty and long texts, ties, repeats and clashing columns."""

import hashlib
import inspect
import random
import re
import zlib
from collections import Counter, defaultdict

import brute
import numpy as np
import pytest

from hirelake.llm import jaccard, mixing, packing, pii, quality, substrings, token_output, toxicity
from hirelake.llm.encode import BpeEncoder
from hirelake.llm.packing import best_fit, cut_points
from hirelake.llm.queries import bpe_50k
from hirelake.llm.token_output import best_fit_decreasing

RNG = random.Random(5)
VOCABULARY = [f"w{i}" for i in range(400)]


def prose(n):
    return " ".join(RNG.choice(VOCABULARY) for _ in range(n))


ODD_TEXTS = [
    None, "", " ", "\n", "one", "x  y", "tabs\tand\n\nlines \r\n", "É ñ ünï cødé 汉字 😀", "<|endoftext|> it's", "a b c d e",
    "word " * 300, prose(3000),
]


@pytest.fixture(scope="module")
def docs(spark):
    texts = [*ODD_TEXTS, prose(120), prose(90)]
    shared = prose(80)
    texts += [f"{prose(30)} {shared} {prose(30)}", f"{prose(5)} {shared}", texts[-1]]
    rows = [(i, t, f"s{i % 3}" if i % 4 else None, i, "clash") for i, t in enumerate(texts)]
    rows += [rows[12], (None, texts[12], "s1", 0, "clash"), (None, None, None, None, None)]
    return rows, spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long, node string").cache()


@pytest.fixture
def nothing(spark):
    return spark.createDataFrame([], "doc_id long, text string, source string")


def test_encoder_gives_the_ids_of_the_tokenizer():
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(bpe_50k())
    texts = [t or "" for t in ODD_TEXTS]
    encoder = BpeEncoder(bpe_50k(), cache_words=50)
    for _ in range(2):
        got = [np.frombuffer(x, "<u4").tolist() for x in encoder.encode(texts)]
        assert got == [whole.encode(t, add_special_tokens=False).ids for t in texts]


def test_packing_is_gapless_and_lossless(docs, nothing):
    rows, df = docs
    got = packing.best_fit_packing(df, bpe_50k(), size=256, pieces_per_group=20).collect()
    encoder = BpeEncoder(bpe_50k())
    want = Counter()
    for doc, text, *_ in rows:
        data = encoder.encode([text or ""])[0] + b"\0\0\0\0"
        for k, (start, n) in enumerate(cut_points(len(data) // 4, 256)):
            want[doc, k, start, n, zlib.crc32(data[4 * start : 4 * (start + n)])] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    sequences = defaultdict(list)
    for r in got:
        sequences[r.sequence_id].append((r.offset, r.length))
    for places in sequences.values():
        ends = np.cumsum([n for _, n in sorted(places)]).tolist()
        assert [o for o, _ in sorted(places)] == [0, *ends[:-1]] and ends[-1] <= 256
    assert packing.best_fit_packing(nothing, bpe_50k()).count() == 0


def test_best_fit_takes_the_fullest_bin_and_closes_the_fullest():
    assert best_fit([6, 5, 4, 3], 10, 10)[0] == [0, 1, 0, 1]
    where, offset = best_fit([6, 7, 8, 2, 3], 10, 2)
    assert where == [0, 1, 2, 2, 0] and offset == [0, 0, 0, 8, 6]  # 8 closes the bin with 7
    lengths = [RNG.randint(1, 2048) for _ in range(5000)]
    assert max(best_fit(sorted(lengths, reverse=True), 2048, 16384)[0]) + 1 <= sum(lengths) / 2048 * 1.02 + 1


def test_best_fit_decreasing_against_a_scan():
    lengths = [RNG.randint(1, 64) for _ in range(300)]
    free, want = [], []
    for i in sorted(range(300), key=lambda i: (-lengths[i], i)):
        fits = [f for f in free if f[0] >= lengths[i]]
        best = min(fits, key=lambda f: f[0], default=None)
        if best is None:
            free.append(best := [64, len(want)])
            want.append([])
        want[best[1]].append(i)
        best[0] -= lengths[i]
    got = best_fit_decreasing(lengths, 64)
    filled = lambda bins: sorted(sum(lengths[i] for i in b) for b in bins)
    assert filled(got) == filled(want) and sorted(sum(got, [])) == list(range(300))


def test_token_output_round_trip(docs, nothing, tmp_path, spark):
    rows, df = docs
    token_output.write_token_files(df, f"{tmp_path}/ids", bpe_50k(), size=128, window_tokens=2000)
    packed = spark.read.parquet(f"{tmp_path}/ids")
    assert packed.filter("size(ids) <> 128 OR position_resets <> slice(cu_seqlens, 1, size(doc_ids))").count() == 0
    assert packed.count() == packed.select("sequence_id").distinct().count()
    got = defaultdict(list)
    for r in token_output.unpacked(packed).collect():
        assert r.positions == list(range(len(r.ids)))
        got[r.doc_id].append((r.start, r.ids))
    encoder = BpeEncoder(bpe_50k())
    ids = {d: [*np.frombuffer(encoder.encode([t or ""])[0], "<u4").tolist(), 0] for d, t, *_ in rows if d not in (None, 12)}
    assert all(sum((x for _, x in sorted(got[d])), []) == want for d, want in ids.items())
    assert token_output.packed_sequences(nothing, bpe_50k()).count() == 0


def test_repeated_passages(docs, nothing, spark):
    rows, df = docs
    got = Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256, r.kept_text) for r in substrings.repeated_passages_removed(df).collect())
    want = Counter()
    for (doc, *_), (n, gone, kept) in zip(rows, brute.repeats_removed([r[1] for r in rows]), strict=True):
        want[doc, n, gone, hashlib.sha256(kept.encode()).hexdigest(), kept] += 1
    assert got == want and sum(r[2] for r in want) > 300
    assert substrings.repeated_passages_removed(nothing).count() == 0


def test_jaccard_classes(docs, nothing, spark):
    rows = [(d, t) for d, t, *_ in docs[0]]
    base = [f"b{i}" for i in range(150)]
    for k in range(40):  # near copies of one text, some of them closer to it than to each other
        changed = [w if i not in (k, k + 50, k + 97) else f"c{k}" for i, w in enumerate(base)]
        rows.append((1000 + k, " ".join(changed)))
    rows += [(2000, " ".join(base)), (2001, "x y"), (2002, "x  y"), (2003, "x y z")]
    links = list(brute.jaccard_links([t for _, t in rows]))
    group, n = brute.grouped(len(rows), links), Counter(i for pair in links for i in pair)
    least = {}
    for i, g in enumerate(group):
        ids = [x for x in (least.get(g), rows[i][0]) if x is not None]
        least[g] = min(ids, default=None)
    want = Counter((d, least[group[i]], n[i]) for i, (d, _) in enumerate(rows))
    df = spark.createDataFrame([(d, t, "clash") for d, t in rows], "doc_id long, text string, node string")
    got = jaccard.jaccard_classes(df, bucket_limit=8, block_limit=16).collect()  # small limit: buckets are split and cut into blocks
    assert Counter((r.doc_id, r.class_id, r.n_links) for r in got) == want
    kept = jaccard.without_near_copies(df)
    assert kept.columns == df.columns and kept.count() == len(set(group))
    assert jaccard.jaccard_classes(nothing).count() == 0 and jaccard.without_near_copies(nothing).count() == 0


def test_runs_needed_grow_with_depth_and_recall():
    assert jaccard.runs_needed(0.9, 1) < jaccard.runs_needed(0.9, 3) < jaccard.runs_needed(0.999, 3)


def test_toxicity_learns_rare_words_and_leaves_clean_texts(spark, nothing):
    rows, labels = [], []
    for i in range(400):
        toxic = i % 4 == 0
        text = prose(60) + (f" vile{RNG.choice('abcdef')} " + prose(20) + " grub" if toxic else "")
        rows.append((i, text, "clash"))
        if i % 2 == 0:
            labels.append((i, int(toxic)))
    rows += [(1000, None, ""), (1001, "", ""), (None, "grub vilea", ""), (1002, "GRUB Vileb " + prose(40), "")]
    labels += [(0, 1), (3, None), (None, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, score string")
    lab = spark.createDataFrame(labels, "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.toxicity_scores(df, lab).collect()}
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got.values())
    assert all(r.held_out == (zlib.crc32(str(d).encode()) % 5 == 0) for d, r in got.items() if d is not None)
    assert sum(got[i].predicted != (i % 4 == 0) for i in range(400)) <= 8
    assert got[None].predicted == 1 and got[1002].predicted == 1 and got[1000].predicted == got[1001].predicted == 0
    assert got[None].evidence[0].toxic == 1
    kept = toxicity.without_toxic(df, lab)
    assert kept.columns == df.columns
    assert {r.doc_id for r in kept.collect()} == {d for d, r in got.items() if not r.predicted}
    assert [r.score for r in toxicity.toxicity_scores(df, lab.limit(0)).collect()] == [0.0] * len(rows)
    assert toxicity.toxicity_scores(nothing, lab).count() == 0


def test_toxicity_compares_all_words_of_the_examples(spark):
    rows = [(i, prose(40) + (f" vile{RNG.choice('abc')} grub" if i % 4 == 0 else "")) for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    lab = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(200)], "doc_id long, toxic int")
    model = toxicity.fitted(df, lab)
    training = [t.lower() for i, t in rows if zlib.crc32(str(i).encode()) % 5]
    known = {w for t in training for w in re.findall(r"\w+", t)}
    known = {(0, w.encode()) for w in known} | {(n, w.encode()[:n]) for w in known for n in toxicity.STEMS if len(w.encode()) > n}
    assert len(model.vocabulary) == len(known)
    # Also a clean text, without any word that tells, has neighbours.
    assert all(len(r.evidence) == 3 for r in toxicity.toxicity_scores(df, lab).collect())


@pytest.mark.parametrize(("common", "dense"), [(4096, False), (12, False), (12, True), (0, False)])
def test_block_max_index_is_exact(monkeypatch, common, dense):
    monkeypatch.setattr(toxicity, "COMMON", common)
    monkeypatch.setattr(toxicity, "DENSE", common)
    monkeypatch.setattr(toxicity, "GROUP", 4)
    rng = np.random.default_rng(3)
    examples = []
    for _ in range(300):
        t = np.sort(rng.choice(40, rng.integers(0, 8), replace=False))
        examples.append((t, rng.integers(1, 4, len(t))))
    idf = rng.uniform(1, 5, 40)
    index = toxicity.BlockMaxIndex(examples, idf, block=16, span=8, dense=dense)
    whole = np.zeros((300, 40))
    for i, (t, n) in enumerate(examples):
        whole[i, t] = index.weights(t, n)
    for i in range(0, 300, 7):
        cosine = np.round(whole @ whole[i], 9)
        order = [j for j in np.lexsort((np.arange(300), -cosine)) if cosine[j] > 0 and j != i][:10]
        assert [j for j, _ in index.nearest(*examples[i], 10, but=i)] == order


def test_quality_counts_and_verdicts(docs, nothing, spark):
    rows, df = docs
    labels = spark.createDataFrame([(12, 1), (13, 1), (10, 0), (10, 1), (None, 0), (11, None)], "doc_id long, quality int")
    got = quality.quality_verdicts(df, labels).collect()
    counts = Counter((r.doc_id, (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words)) for r in got)
    assert counts == Counter((d, brute.quality_counts(t)) for d, t, *_ in rows)
    assert all(r.base_failed == (r.n_words < 50 or 2 * r.n_repeat_words > r.n_words) for r in got)
    assert not any(r.kept and r.base_failed for r in got)
    assert quality.quality_verdicts(nothing, labels).count() == 0


def test_quality_threshold_reads_every_label(spark):
    """The same cut as one sorted walk over all rows, equal scores and both ends included; no number of labels is too many."""
    assert "sample" not in inspect.signature(quality.quality_verdicts).parameters
    rng = random.Random(9)
    for n, gap in ((400, 0.0), (400, 0.6), (3, 0.5)):
        rows = [(round(rng.random() + gap * q, 2), q) for q in (rng.randrange(2) for _ in range(n))] + [(0.5, 0), (0.5, 1)]
        cuts = sorted({x for x, _ in rows})
        good, bad = [x for x, q in rows if q], [x for x, q in rows if not q]
        best, want = 1.0, float("-inf")
        for i, c in enumerate(cuts):
            rate = sum(x > c for x in good) / len(good) + sum(x <= c for x in bad) / len(bad)
            if rate > best:
                best, want = rate, (c + cuts[i + 1]) / 2 if i + 1 < len(cuts) else float("inf")
        assert quality.best_threshold(spark.createDataFrame(rows, "llr double, quality int")) == want
    assert quality.best_threshold(spark.createDataFrame([(0.1, 1)], "llr double, quality int")) == float("-inf")


def test_quality_parts_signs_from_prose(spark):
    rows = [(i, prose(80) if i % 2 else " ".join(f"{w}%%%" for w in prose(80).split())) for i in range(200)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(0, 200, 3)], "doc_id long, quality int")
    got = quality.quality_verdicts(spark.createDataFrame(rows, "doc_id long, text string"), labels).collect()
    assert all(r.kept == bool(r.doc_id % 2) for r in got)


PERSONAL = [
    None, "", "write to a.b+c@mail.example.com, x@y or @z.com; a@b.c_d@e.f", "1.2.3.4.5 and 256.1.1.1 and 001.02.3.0255 9.9.9.9",
    "4111 1111 1111 1111 or 4111-1111-1111-1112, 4111  1111", "+1 (705) 555-6638, +12 3, ++44 20 7946 0958- +1.2.3.4.5.6.7.8.",
    "IBAN GB82 WEST 1234 5698 7654 32 is ours; GB00 WEST 1234 5698 7654 32", "visa card 378282246310005 here, " + "and so on " * 9 + "378282246310005 x",
    "call me, phone 555-123-4567 é 😀 tel +49 30 1234567 in", "a" * 50_000 + "@" + "b.c" * 3, "1" * 5000 + ".2.3.4", "7 " * 3000, "x@y" + ".z" * 20_000,
]


def test_personal_data(spark, nothing):
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(PERSONAL)], "doc_id long, text string, base string")
    got = {r.doc_id: r for r in pii.digest(df).collect()}
    for i, text in enumerate(PERSONAL):
        want = [f"{k}:{a}:{b}" for k, a, b in brute.personal_data(text)]
        assert got[i].base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest(), (i, want, got[i].spans)
        assert [s for s in got[i].spans.split(",") if s][: len(want)] == want
        assert [got[i][f"n_{k}"] for k in pii.BASE_KINDS] == [sum(w.startswith(k) for w in want) for k in pii.BASE_KINDS]
    extra = {i: [s.split(":")[0] for s in r.spans.split(",") if s.split(":")[0] in pii.EXTRA_KINDS] for i, r in got.items()}
    assert extra[6] == ["iban"] and extra[7] == ["short_card"] and extra[8] == ["local_phone"]
    hidden = {r.doc_id: r for r in pii.redacted(df).collect()}
    assert hidden[6].text == "IBAN <IBAN> is ours; GB00 WEST 1234 5698 7654 32" and hidden[0].text is None and hidden[1].text == ""
    assert hidden[8].text == "call me, phone <LOCAL_PHONE> é 😀 tel <PHONE> in" and pii.redacted(df).columns == df.columns
    assert pii.digest(nothing).count() == 0 and pii.redacted(nothing).count() == 0


def test_ibans_whatever_follows(spark):
    de, gb, no = "DE89 3704 0044 0532 0130 00", "GB82WEST12345698765432", "NO9386011117947"
    cases = [
        (f"{de} BIC COBADEFFXXX", "<IBAN> BIC COBADEFFXXX"), (f"to {gb} Please pay", "to <IBAN> Please pay"),
        (f"IBAN {no} 2024-01-01", "IBAN <IBAN> 2024-01-01"), (f"é😀 {de} {gb} {no}.", "é😀 <IBAN> <IBAN> <IBAN>."),
        (f"{de}, {gb} X", "<IBAN>, <IBAN> X"), (f"{gb}x {de[:-1]}1 A", f"{gb}x {de[:-1]}1 A"), (f"{gb} " + "A1 " * 40, "<IBAN> " + "A1 " * 40),
    ]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "doc_id long, text string")
    assert [r.text for r in pii.redacted(df).orderBy("doc_id").collect()] == [want for _, want in cases]


def test_mixing(docs, nothing, spark):
    rows, df = docs
    got = mixing.mixed_sizes(df).collect()
    assert sorted(r.size for r in got) == sorted(len(brute.words(t)) for _, t, *_ in rows)
    out = mixing.emitted(df)
    assert out.columns == df.columns and out.count() == sum(r.copies for r in got)
    assert mixing.mixed_sizes(nothing).count() == 0 and mixing.emitted(nothing).count() == 0
    many = [(i, prose(RNG.randint(1, 60)), "abcd"[min(i % 10, 3)] if i % 50 else None) for i in range(4000)]
    first = mixing.mixed_sizes(spark.createDataFrame(many, "doc_id long, text string, source string"))
    again = mixing.mixed_sizes(spark.createDataFrame(many[::-1], "doc_id long, text string, source string"))
    assert sorted(map(tuple, first.collect())) == sorted(map(tuple, again.collect()))
    taken, target, size = Counter(), {}, {}
    for r in first.collect():
        taken[r.source_size] += r.taken
        target[r.source_size], size[r.source_size] = r.target, r.source_size
        assert r.taken <= 3 * r.size
    total = sum(size.values())
    assert abs(sum(target.values()) - total) < 1e-6 * total
    assert all(t <= 3 * s * (1 + 1e-12) and abs(taken[s] - t) <= 130 for s, t in target.items())
    assert any(abs(t - 3 * s) < 1e-6 for s, t in target.items())


def test_capped_targets_by_rounds(spark):
    sizes = {"a": 1000.0, "b": 5.0, "c": 7.0, "d": 40.0, None: 100.0}
    weights = dict(zip(sizes, (1, 2, 3, 1, 2), strict=True))
    total, fixed = sum(sizes.values()), {}
    while True:
        rest, w = total - sum(fixed.values()), sum(weights[s] for s in sizes if s not in fixed)
        over = [s for s in sizes if s not in fixed and rest * weights[s] / w > 3 * sizes[s]]
        if not over:
            break
        fixed |= {s: 3 * sizes[s] for s in over}
    want = {s: fixed.get(s, rest * weights[s] / w) for s in sizes}
    df = spark.createDataFrame([(s, int(n)) for s, n in sizes.items()], "source string, source_size long")
    got = {r.source: r.target for r in mixing.source_targets(df).collect()}
    assert got == pytest.approx(want)
