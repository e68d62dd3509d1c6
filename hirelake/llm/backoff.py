"""Log-probabilities of texts by a weighted backoff automaton over the n-grams of the training texts."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hirelake.llm.words import GRAM_BASE, mix, text_runs

START, END = np.uint64(0x5354415254), np.uint64(0x454E44)
REQUESTS = "chunk int, bucket int, size int, keys binary, small binary, big binary"
ANSWERS = "chunk int, bucket int, size int, small binary, big binary, n_tokens long, n_types long"
SCORED = (
    "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, vocabulary long"
)


def pack_counts(counts: np.ndarray) -> tuple[bytes, bytes]:
    """One byte a count; 255 stands for the next of the long ones."""
    return np.minimum(counts, 255).astype(np.uint8).tobytes(), counts[counts >= 255].astype("<u8").tobytes()


def unpack_counts(small: bytes, big: bytes) -> np.ndarray:
    counts = np.frombuffer(small, np.uint8).astype(np.int64)
    counts[counts == 255] = np.frombuffer(big, "<u8")
    return counts


class ChunkGrams:
    """The distinct n-grams of some documents, each document between a start and an end mark.

    `keys[k]` are the sorted 64-bit digests of the distinct n-grams of k + 1 tokens, `at[k]` says which of them begins at
    each place (-1 where the document ends before it is full), `seen[k]` at which place one can be read.
    """

    def __init__(self, texts: pa.Array, order: int):
        hashes, counts = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        for _, _, run in text_runs(pc.ascii_lower(texts)):
            words = run.words()
            hashes.append(run.hashes(words))
            counts.append(words.count)
        self.sizes = np.concatenate(counts) + 2
        self.last = np.cumsum(self.sizes) - 1
        self.first = self.last - self.sizes + 1
        tokens = np.empty(int(self.sizes.sum()), np.uint64)
        inner = np.ones(len(tokens), dtype=bool)
        inner[self.first] = inner[self.last] = False
        tokens[inner] = np.concatenate(hashes)
        tokens[self.first], tokens[self.last] = START, END
        self.owner = np.repeat(np.arange(len(self.sizes)), self.sizes)
        self.keys, self.at, self.seen, gram = [], [], [], mix(tokens, 51)
        for k in range(order):
            if k:
                gram = mix(gram[:-1] * GRAM_BASE + tokens[k:], 51 + k)
            whole = self.owner[: len(gram)] == self.owner[k:]
            keys, seen, which = np.unique(gram[whole], return_index=True, return_inverse=True)
            at = np.full(len(tokens), -1)
            at[: len(gram)][whole] = which
            self.keys.append(keys)
            self.at.append(at)
            self.seen.append(np.flatnonzero(whole)[seen])

    def counts(self, size: int, of: np.ndarray) -> np.ndarray:
        """How often each n-gram stands in the documents that `of` marks."""
        inside = (self.at[size] >= 0) & of[self.owner]
        return np.bincount(self.at[size][inside], minlength=len(self.keys[size]))


START_KEY = mix(np.array([START]), 51)[0]


def _bucket_bounds(keys: np.ndarray, bits: int) -> np.ndarray:
    """Sorted keys are in bucket order; first place of each bucket and the end."""
    if bits == 0:
        return np.array([0, len(keys)])
    starts = np.arange(1 << bits, dtype=np.uint64) << np.uint64(64 - bits)
    return np.append(np.searchsorted(keys, starts), len(keys))


def _requests(order: int, bits: int, docs: pa.Table) -> pa.Table:
    """The n-grams a chunk will meet, with their counts in its training documents, by leading bits of the digest."""
    chunk = docs.column("chunk")[0].as_py()
    grams = ChunkGrams(docs.column("text").combine_chunks(), order)
    train = ~np.array(docs.column("held_out"), dtype=bool)
    drop, rows = min(bits // 8, 7), []
    for size, keys in enumerate(grams.keys):
        counts, bounds = grams.counts(size, train), _bucket_bounds(keys, bits)
        # Whole bytes that the bucket number tells are not sent.
        raw = keys.astype("<u8").view(np.uint8).reshape(-1, 8)[:, : 8 - drop]
        for b in np.flatnonzero(np.diff(bounds)).tolist():
            i, j = bounds[b], bounds[b + 1]
            rows.append((chunk, b, size, raw[i:j].tobytes(), *pack_counts(counts[i:j])))
    kinds = [pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
    return pa.table([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=_names(REQUESTS))


def _names(schema: str) -> list[str]:
    return [x.split()[0] for x in schema.split(", ")]


def _answers(bits: int, asked: pa.Table) -> pa.Table:
    """Counts over all chunks for every n-gram of one bucket, sent back in the order of each request."""
    asked = asked.sort_by([("size", "ascending"), ("chunk", "ascending")])
    chunks, buckets, sizes, blobs, small, big = (asked.column(n).to_pylist() for n in _names(REQUESTS))
    width, rows = 8 - min(bits // 8, 7), []
    for size in sorted(set(sizes)):
        own = [i for i, s in enumerate(sizes) if s == size]
        raw = np.frombuffer(b"".join(blobs[i] for i in own), np.uint8).reshape(-1, width)
        keys = np.zeros((len(raw), 8), np.uint8)
        keys[:, :width] = raw
        keys = keys.view("<u8")[:, 0]
        if width < 8:
            keys = keys | (np.uint64(buckets[0]) << np.uint64(64 - bits) & np.uint64(2**64 - (1 << 8 * width)))
        distinct, which = np.unique(keys, return_inverse=True)
        parts = np.concatenate([unpack_counts(small[i], big[i]) for i in own])
        totals = np.zeros(len(distinct), np.int64)
        np.add.at(totals, which, parts)
        words = totals[distinct != START_KEY] if size == 0 else np.zeros(0, np.int64)
        stats, every, place = [int(words.sum()), int((words > 0).sum())], totals[which], 0
        for i in own:
            n = len(small[i])
            rows.append((chunks[i], buckets[i], size, *pack_counts(every[place : place + n]), *stats))
            stats, place = [0, 0], place + n
    kinds = [pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.int64(), pa.int64()]
    return pa.table([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=_names(ANSWERS))


class BackoffAutomaton:
    """States are the known n-grams shorter than the order (0 is the empty one, reached when all fails).

    An arc reads a token: `arcs[state * width + token]` is (log10 probability, next state). A state without an arc for the
    token fails to the state of its n-gram less the first token, at the cost of `weight`. The probability of an n-gram is
    (count + prior * probability of the n-gram less its first token) / (count of its context + prior), so each state's
    arcs and failures add up to 1; without context it is (count + 1) / (tokens + types + 1), which leaves one share for
    all unknown words.
    """

    def __init__(self, grams: ChunkGrams, counts: list[np.ndarray], tokens: int, types: int, prior: float):
        order, n = len(counts), [len(k) for k in grams.keys]
        if n != [len(c) for c in counts]:
            raise ValueError("the documents were not read in the same order twice")
        self.width = max(n[0], 1)
        base = np.concatenate([[1], 1 + np.cumsum(n)])
        word = np.arange(n[0])
        p = (counts[0] + 1) / (tokens + types + 1)
        state, failure, weight = [np.zeros(1, np.int64)], [np.zeros(1, np.int64)], [np.zeros(1)]
        arc, cost, follow = [], [], []
        for k in range(order):
            known = counts[k] > 0
            if k:
                at = grams.seen[k]
                context, shorter = grams.at[k - 1][at], grams.at[k - 1][at + 1]
                word = grams.at[0][at + k]
                p = (counts[k] + prior * p[shorter]) / (counts[k - 1][context] + prior)
                source, lower = base[k - 1] + context, base[k - 1] + shorter
            else:
                source = lower = np.zeros(n[0], np.int64)
                known = known & (grams.keys[0] != START_KEY)
            own = base[k] + np.arange(n[k]) if k + 1 < order else lower
            arc.append((source * self.width + word)[known])
            cost.append(np.log10(p[known]))
            follow.append(own[known])
            if k + 1 < order:
                failure.append(lower)
                weight.append(np.log10(prior / (counts[k] + prior)))
        self.arcs = dict(
            zip(np.concatenate(arc).tolist(), zip(np.concatenate(cost).tolist(), np.concatenate(follow).tolist(), strict=True), strict=True)
        )
        self.failure, self.weight = np.concatenate(failure).tolist(), np.concatenate(weight).tolist()
        self.unknown = float(np.log10(1 / (tokens + types + 1)))
        begun = np.flatnonzero(grams.keys[0] == START_KEY)
        self.start = int(1 + begun[0]) if order > 1 and len(begun) and counts[0][begun[0]] else 0

    def score(self, tokens: list[int]) -> float:
        """One pass over the tokens, carrying the state."""
        arcs, failure, weight, width = self.arcs.get, self.failure, self.weight, self.width
        state, total = self.start, 0.0
        for token in tokens:
            arc = arcs(state * width + token)
            while arc is None and state:
                total += weight[state]
                state = failure[state]
                arc = arcs(state * width + token)
            if arc is None:
                total += self.unknown
            else:
                total += arc[0]
                state = arc[1]
        return total


def _scores(order: int, prior: float, docs: pa.Table, answers: pa.Table) -> pa.Table:
    kinds = [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.int64()]
    if not docs.num_rows:
        return pa.table([pa.array([], k) for k in kinds], names=_names(SCORED))
    grams = ChunkGrams(docs.column("text").combine_chunks(), order)
    answers = answers.sort_by([("size", "ascending"), ("bucket", "ascending")])
    _, _, sizes, small, big, n_tokens, n_types = (answers.column(n).to_pylist() for n in _names(ANSWERS))
    tokens, types = next((t, v) for s, t, v in zip(sizes, n_tokens, n_types, strict=True) if s < 0)
    counts = [
        np.concatenate([np.zeros(0, np.int64), *(unpack_counts(a, b) for s, a, b in zip(sizes, small, big, strict=True) if s == k)])
        for k in range(order)
    ]
    automaton = BackoffAutomaton(grams, counts, tokens, types, prior)
    real = np.ones(len(grams.owner), dtype=bool)
    real[grams.first] = False
    owner, count = grams.owner[real], counts[0][grams.at[0][real]]
    n = len(grams.sizes)
    base = np.bincount(owner, np.log10((count + 1) / (tokens + types + 1)), n)
    known = np.bincount(owner[count > 0], minlength=n)
    score = []
    for first, last in zip((grams.first + 1).tolist(), (grams.last + 1).tolist(), strict=True):
        score.append(automaton.score(grams.at[0][first:last].tolist()))
    columns = [
        docs.column("doc_id"), docs.column("held_out"), grams.sizes - 1, known, np.full(n, tokens), base, score, np.full(n, types),
    ]
    return pa.table([c.cast(k) if isinstance(c, pa.ChunkedArray) else pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=_names(SCORED))


def held_out(doc_id: str, folds: int = 7, fold: int = 2) -> Column:
    """Which documents teach nothing: crc32 of the id as text has remainder `fold`. A null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % folds == fold


def language_model_scores(
    docs: DataFrame,
    held: Column | None = None,
    order: int = 2,
    prior: float = 500.0,
    chunk_bytes: int = 8_000_000,
    bucket_bytes: int = 4_000_000,
) -> DataFrame:
    """log10 probability of every whole text under the n-grams of the documents that `held` does not mark.

    No task holds the model. Documents are dealt by hash into chunks of about `chunk_bytes`; each chunk asks for the
    counts of its distinct n-grams, with its own training counts, in buckets by digest (about `bucket_bytes` of texts'
    worth each); a bucket adds up what all chunks say and answers each in the order it asked, so a count travels as one
    byte or nine; then each chunk builds the part of the automaton that its texts can reach and walks every text once. A
    frequent n-gram is one entry per chunk, so no bucket is hot.

    A row's chunk depends on its place in the table, so that rows which repeat do not meet in one chunk; `docs` must be read
    in the same order each time, as files are. Tokens are the words with A-Z lower-cased and one end per document. Null or empty text: the end alone. Null doc_id:
    kept, and training. Repeated rows: each counts and each is scored. No training document: all tokens are unknown and the
    scores are 0 for one share of all. Empty table: no rows. Other columns are not read. n-grams meet by 64-bit digests.
    """
    held = held_out("doc_id") if held is None else held
    docs = docs.select(F.col("doc_id").cast("long"), held.alias("held_out"), F.coalesce("text", F.lit("")).alias("text"))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_chunks = 1 + size // chunk_bytes
    bits = min(24, max(0, (size // bucket_bytes).bit_length()))
    dealt = docs.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "text", F.monotonically_increasing_id()), F.lit(n_chunks)).cast("int"))
    asked = dealt.groupBy("chunk").applyInArrow(lambda docs: _requests(order, bits, docs), REQUESTS)
    answers = asked.groupBy("bucket").applyInArrow(lambda asked: _answers(bits, asked), ANSWERS)
    totals = answers.agg(F.sum("n_tokens").alias("n_tokens"), F.sum("n_types").alias("n_types")).select(
        F.explode(F.sequence(F.lit(0), F.lit(int(n_chunks - 1)))).alias("chunk"), F.lit(0).alias("bucket"), F.lit(-1).alias("size"),
        F.lit(b"").alias("small"), F.lit(b"").alias("big"), "n_tokens", "n_types",
    )
    told = answers.unionAll(totals).groupBy("chunk")
    return dealt.groupBy("chunk").cogroup(told).applyInArrow(lambda docs, told: _scores(order, prior, docs, told), SCORED)
