"""Quality rules and a hashed n-gram log-likelihood ratio between trusted documents and the whole corpus."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from hirelake.llm.common import materialise, shuffle_width
from hirelake.llm.words import WHITE, TextRun, grams, inside, mix, prefix_counts, text_runs

MEASURES = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, llr double"
SYMBOLS = np.zeros(256, dtype=bool)
SYMBOLS[list(b"#*$%&|<>")] = True


def base_measures(run: TextRun) -> dict[str, np.ndarray]:
    """The plain counts of each document; every one is exact and over the whole text."""
    words = run.words()
    first, last = run.bounds[:-1], run.bounds[1:]
    lead = prefix_counts(~WHITE[run.data] & ((run.data & 0xC0) != 0x80))  # first bytes of characters inside words
    symbol = prefix_counts(SYMBOLS[run.data])
    lines = run.lines()
    white = prefix_counts(~WHITE[run.data])
    worded = white[lines.end] > white[lines.begin]
    owner = lines.owner()[worded].astype(np.uint64)
    distinct = np.unique(mix(run.hashes(lines)[worded] ^ mix(owner, 11), 12), return_index=True)[1]
    n_lines = np.bincount(owner.astype(np.int64), minlength=len(run))
    n_distinct = np.bincount(owner[distinct].astype(np.int64), minlength=len(run))
    h = run.hashes(words)
    three, whole = grams(h, 3), inside(words, 3)
    at = np.flatnonzero(whole)
    key = mix(three[at] ^ mix(words.owner()[at].astype(np.uint64), 13), 14)
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    again = np.zeros(len(at), dtype=bool)
    again[1:] |= same
    again[:-1] |= same
    covered = np.zeros(len(h) + 3, dtype=np.int64)
    starts = at[order[again]]
    covered[starts] += 1
    covered[starts + 3] -= 1
    repeat = prefix_counts(np.cumsum(covered)[: len(h)] > 0)
    return {
        "n_words": words.count,
        "word_chars": lead[last] - lead[first],
        "n_symbols": symbol[last] - symbol[first],
        "n_dup_lines": n_lines - n_distinct,
        "n_repeat_words": repeat[words.last] - repeat[words.first],
    }


def gram_buckets(run: TextRun, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(document, bucket) of every token and every pair of neighbouring tokens."""
    s = run.tokens()
    h, owner = run.hashes(s), s.owner()
    two, whole = grams(h, 2), inside(s, 2)
    at = np.flatnonzero(whole)
    both = np.concatenate([h, two[at]])
    return np.concatenate([owner, owner[at]]), (mix(both, 15) % np.uint64(buckets)).astype(np.int64)


def bucket_counts(docs: DataFrame, buckets: int) -> DataFrame:
    """(bucket, n, trusted): n-grams of all documents and of those whose `quality` is 1; one row per bucket and task
    leaves a task."""

    def run(batches):
        total = np.zeros((2, buckets), dtype=np.int64)
        for batch in batches:
            trusted = np.array([q == 1 for q in batch.column(1).to_pylist()], dtype=bool)
            for a, b, texts in text_runs(batch.column(0)):
                owner, bucket = gram_buckets(texts, buckets)
                total[0] += np.bincount(bucket, minlength=buckets)
                total[1] += np.bincount(bucket[trusted[a:b][owner]], minlength=buckets)
        names = ["bucket", "n", "trusted"]
        yield pa.record_batch([pa.array(np.arange(buckets), pa.int32()), pa.array(total[0]), pa.array(total[1])], names=names)

    per_task = docs.select("text", "quality").mapInArrow(run, "bucket int, n long, trusted long")
    return per_task.groupBy("bucket").agg(F.sum("n").alias("n"), F.sum("trusted").alias("trusted"))


def with_quality(docs: DataFrame, labelled: DataFrame) -> DataFrame:
    """Every document and its label, if it has one. Always by a shuffle, of one copy of the texts, at any size: the labels
    grow with the documents and need not fit a broadcast."""
    return docs.join(labelled.hint("merge"), "doc_id", "left")


def log_ratios(counts: DataFrame, buckets: int, smoothing: float = 1.0) -> np.ndarray:
    """log p(bucket | trusted) - log p(bucket | corpus), both smoothed; `buckets` numbers, whatever the corpus."""
    raw, trusted = np.full(buckets, smoothing), np.full(buckets, smoothing)
    for row in counts.collect():
        raw[row.bucket] += row.n
        trusted[row.bucket] += row.trusted
    return np.log(trusted / trusted.sum()) - np.log(raw / raw.sum())


def measured(docs: DataFrame, ratios: np.ndarray) -> DataFrame:
    """MEASURES of each document; llr is the mean log ratio of its n-grams, 0 where it has none."""

    def run(batches):
        for batch in batches:
            for a, b, texts in text_runs(batch.column(1)):
                owner, bucket = gram_buckets(texts, len(ratios))
                total = np.bincount(owner, weights=ratios[bucket], minlength=len(texts))
                llr = total / np.maximum(1, np.bincount(owner, minlength=len(texts)))
                base = [pa.array(v.astype(np.int64)) for v in base_measures(texts).values()]
                ids = batch.column(0).slice(a, b - a)
                yield pa.record_batch([ids, *base, pa.array(llr)], names=[x.split()[0] for x in MEASURES.split(", ")])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, MEASURES)


def best_threshold(scores: DataFrame) -> float:
    """The cut that parts good from bad labels with the highest mean of both hit rates; the lowest of equal cuts.

    `scores` is every labelled document (llr, quality). Ranges of llr are summed in their own tasks; one row per range
    comes here. Without both labels everything passes.
    """
    good, bad = F.count_if(F.col("quality") == 1), F.count_if(F.col("quality") != 1)
    ranges = scores.repartitionByRange(shuffle_width(scores.sparkSession), "llr").groupBy("llr").agg(good.alias("g"), bad.alias("b"))
    counts = materialise(ranges.withColumn("part", F.spark_partition_id()), "label-counts")
    parts = sorted(counts.groupBy("part").agg(F.min("llr").alias("first"), F.sum("g").alias("g"), F.sum("b").alias("b")).collect(), key=lambda r: r["first"])
    n_good, n_bad = sum(r["g"] for r in parts), sum(r["b"] for r in parts)
    if not n_good or not n_bad:
        return float("-inf")
    before, g, b = [], 0, 0
    for i, r in enumerate(parts):
        before.append((r["part"], g, b, parts[i + 1]["first"] if i + 1 < len(parts) else None))
        g, b = g + r["g"], b + r["b"]
    offsets = scores.sparkSession.createDataFrame(before, "part int, g0 long, b0 long, following double")
    inside = W.partitionBy("part").orderBy("llr")
    sums = (
        counts.join(F.broadcast(offsets), "part")
        .withColumns({"n": F.col("g0") + F.sum("g").over(inside), "m": F.col("b0") + F.sum("b").over(inside)})
        .withColumn("up", F.coalesce(F.lead("llr").over(inside), "following"))
    )
    rate = (F.lit(n_good) - F.col("n")) / F.lit(n_good) + F.col("m") / F.lit(n_bad)
    best = sums.withColumn("rate", rate).agg(F.max(F.struct("rate", (-F.col("llr")).alias("at"), "up")).alias("x")).first()["x"]
    if best["rate"] <= 1.0:
        return float("-inf")
    return float("inf") if best["up"] is None else (-best["at"] + best["up"]) / 2


def quality_verdicts(docs: DataFrame, labels: DataFrame, buckets: int = 1 << 14) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, llr.

    A document fails the base rules with under 50 words or more than half of them inside repeated three-word windows.
    Otherwise the mean log ratio of its hashed one- and two-token n-grams decides, between the multinomial of trusted
    documents (label quality 1) and that of the corpus. Corpus counts run over all documents, trusted counts and the
    threshold over all labelled ones. The threshold is one number for all documents: reruns agree.

    Null text: no words, so it fails. Documents without label: judged alike. A document with two labels counts as the
    lower. Null doc_id: judged, never labelled. Repeated rows: each judged, each counted. Empty labels: all pass
    that pass the base rules. Other columns are not read.
    """
    labelled = labels.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    labelled = materialise(labelled.filter("quality IN (0, 1)"), "labelled")
    docs = docs.select("doc_id", "text")
    ratios = log_ratios(bucket_counts(with_quality(docs, labelled), buckets), buckets)
    found = materialise(measured(docs, ratios), "measured")
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    found = found.withColumn("base_failed", failed)
    cut = best_threshold(found.filter(~F.col("base_failed")).join(labelled, "doc_id"))
    verdict = ~F.col("base_failed") & (F.col("llr") >= F.lit(cut))
    return found.withColumn("kept", verdict).select(*[c for c in found.columns if c != "llr"], "kept", "llr")
