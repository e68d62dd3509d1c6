"""Texts travel once to the toxicity workers, and leaders of blocks bound the nearest examples."""

import numpy as np

from hirelake.llm import toxicity

WORDS = ["kind", "warm", "note", "plain", "awful", "nasty", "rude", "vile"]


def tables(spark):
    docs = [(i, " ".join(WORDS[4 * (i % 2) :][:4]) + f" w{i}", "s") for i in range(60)] + [(None, None, "s"), (60, "", None)]
    return spark.createDataFrame(docs, "doc_id long, text string, source string"), spark.createDataFrame(
        [(i, i % 2) for i in range(60)], "doc_id long, toxic int"
    )


def test_without_toxic_sends_each_text_once(spark, capsys):
    docs, labels = tables(spark)
    kept = toxicity.without_toxic(docs, labels)
    kept.explain(True)
    assert "_text" not in capsys.readouterr().out
    scores = {r.doc_id: r.score for r in toxicity.toxicity_scores(docs, labels).collect()}
    assert kept.columns == docs.columns
    assert sorted(r.doc_id or -1 for r in kept.collect()) == sorted(d or -1 for d, s in scores.items() if s < 0.5)
    assert 0 < kept.count() < docs.count()


def test_text_column_in_capitals(spark):
    docs, labels = tables(spark)
    capitals = docs.withColumnRenamed("text", "TEXT")
    assert toxicity.without_toxic(capitals, labels).count() == toxicity.without_toxic(docs, labels).count()


def test_nearest_with_many_blocks_and_a_part_block():
    rng = np.random.default_rng(5)
    # More than `COMMON` terms, so that both parts of the index take part; 203 examples leave the last block of 8 in part.
    size, terms = 203, 3000
    odds = 1 / np.arange(1, terms + 1)
    examples = [(np.unique(rng.choice(terms, 60, p=odds / odds.sum())), None) for _ in range(size)]
    examples = [(t, np.ones(len(t), np.int32)) for t, _ in examples]
    idf = 1 + rng.random(terms)
    index = toxicity.BlockMaxIndex(examples, idf, span=8)
    whole = np.zeros((size, terms))
    for i, (t, n) in enumerate(examples):
        whole[i, t] = index.weights(t, n)
    assert index.block == 32
    for k in (1, 3, 25, 40, 203):
        found = index.nearest_of(examples, k)
        cosine = np.rint(whole @ whole.T * 1e9)
        for row, near in zip(cosine, found, strict=True):
            best = np.sort(row)[::-1][:k]
            assert np.allclose([c * 1e9 for _, c in near], best[best > 0], atol=2)
