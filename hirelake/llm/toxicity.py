"""Toxicity from the nearest labelled examples: exact TF-IDF cosine by a block-max index of all their terms, calibrated votes."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hirelake.llm.common import materialise, per_worker
from hirelake.llm.words import LETTER, TextRun, mix, text_runs

#: Beside whole words, their first so many bytes are terms: endings vary more than stems.
STEMS = (5, 7)
#: So many terms count as common in an index that skips by bounds, and in a dense one.
COMMON, DENSE = 2048, 1024
#: Common terms in a group that shares one norm per example, and examples in a block.
GROUP, SPAN = 32, 64
#: Bounds are in single precision; sums of at most 2 048 products of weights below 1 differ by less than this.
SLACK = 1e-5
SCORED = (
    "doc_id long, held_out boolean, score double, predicted int, "
    "evidence array<struct<doc_id:long,toxic:int,cosine:double>>"
)


def terms_of(run: TextRun) -> tuple[np.ndarray, np.ndarray]:
    """(document, term) of every lower-case word and stem, with repeats."""
    s = run.tokens()
    word = LETTER[run.data[s.begin]] if len(s.begin) else np.zeros(0, bool)
    s_owner = s.owner()[word]
    s.begin, s.end = s.begin[word], s.end[word]
    owners, terms = [s_owner], [mix(run.hashes(s), 31)]
    whole = s.end
    for n in STEMS:
        longer = whole - s.begin > n
        s.end = np.minimum(whole, s.begin + n)
        owners.append(s_owner[longer])
        terms.append(mix(run.hashes(s)[longer], 31 + n))
    return np.concatenate(owners), np.concatenate(terms)


def _lower(column: pa.Array) -> pa.Array:
    return pc.utf8_lower(column.cast(pa.large_string()).fill_null(""))


class Vocabulary:
    """Sorted term hashes with a first place for each value of their leading bits, so that finding one is a short walk."""

    def __init__(self, terms: np.ndarray):
        self.size = len(terms)
        self.terms = np.append(terms, np.uint64(2**64 - 1))
        bits = max(1, self.size.bit_length() + 1)
        self.shift = np.uint64(64 - bits)
        self.first = np.searchsorted(terms, np.arange(1 << bits, dtype=np.uint64) << self.shift)
        self.steps = int(np.bincount((terms >> self.shift).astype(np.int64), minlength=1).max()) if self.size else 0

    def __len__(self) -> int:
        return self.size

    def places(self, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the terms are known, and the numbers of those."""
        at = self.first[(terms >> self.shift).astype(np.int64)]
        for _ in range(self.steps):
            at += self.terms[at] < terms
        known = (self.terms[at] == terms) & (at < self.size)
        return known, at[known]


def term_counts(run: TextRun, vocabulary: Vocabulary) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, number of the term in the vocabulary, occurrences), by document and term."""
    owner, term = terms_of(run)
    if not len(vocabulary) or not len(term):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    known, at = vocabulary.places(term)
    key, n = np.unique(owner[known].astype(np.int64) * len(vocabulary) + at, return_counts=True)
    return key // len(vocabulary), key % len(vocabulary), n


def _ranges(begin: np.ndarray, n: np.ndarray) -> np.ndarray:
    """begin, begin + 1, ... of each range, one after the other."""
    return np.repeat(begin - np.cumsum(n) + n, n) + np.arange(int(n.sum()))


class BlockMaxIndex:
    """The examples' vectors by term, in two parts: telling terms (few postings, much weight) and common ones.

    A query first reads the lists of its telling terms; the k-th best of these sums is a cosine that the final k-th best
    cannot be below. The common terms' postings stand in blocks of examples, and of each (term, block) the largest weight is
    known: a block that cannot reach that cosine with all its largest weights is skipped. In the other blocks an example is
    read only if the norms of its common terms, by groups of terms, let it reach the k-th best. So `nearest_of` is exact.
    Equal cosines rank by example number. `dense`: the common terms are few and added to all examples at once, for weights
    that let no bound skip much. `block` queries are taken at a time.
    """

    def __init__(
        self, examples: list[tuple[np.ndarray, np.ndarray]], idf: np.ndarray, block: int = 32, span: int = SPAN, dense: bool = False
    ):
        term = np.concatenate([t for t, _ in examples] or [np.zeros(0)], dtype=np.int32, casting="unsafe")
        count = np.concatenate([n for _, n in examples] or [np.zeros(0, np.int32)])
        owner = np.repeat(np.arange(len(examples), dtype=np.int32), [len(t) for t, _ in examples])
        order = np.argsort(term, kind="stable")
        self._build(term[order], owner[order], count[order], len(examples), idf, block, span, dense)

    @classmethod
    def of_postings(
        cls, term: np.ndarray, owner: np.ndarray, count: np.ndarray, size: int, idf: np.ndarray, dense: bool = False
    ) -> BlockMaxIndex:
        """From postings that are already in order of term and example: nothing is sorted or held twice."""
        index = cls.__new__(cls)
        index._build(term, owner, count, size, idf, 32, SPAN, dense)
        return index

    def _build(self, term, owner, count, size: int, idf: np.ndarray, block: int, span: int, dense: bool) -> None:
        self.idf, self.block, self.size, self.span = idf, block, size, span
        self.blocks = -(-size // span)
        width = self.blocks * span
        weight = (1 + np.log(count)) * idf[term]
        weight /= np.sqrt(np.bincount(owner, weight * weight, size))[owner]
        length = np.bincount(term, minlength=len(idf))
        # Long lists of light terms cost most and tell least.
        common = np.argsort(idf / np.maximum(length, 1), kind="stable")[: DENSE if dense else COMMON]
        self.column = np.full(len(idf), -1, dtype=np.int32)
        self.column[common] = np.arange(len(common))
        self.columns = len(common)
        at = self.column[term]
        telling = at < 0
        self.owner, self.weight = owner[telling].astype(np.int32), weight[telling]
        self.start = np.zeros(len(idf) + 1, dtype=np.int64)
        np.cumsum(np.where(self.column < 0, length, 0), out=self.start[1:])
        at, owner, weight = at[~telling], owner[~telling], weight[~telling]
        self.dense = None
        if dense:
            self.dense = np.zeros((len(common), width))
            self.dense[at, owner] = weight
            return
        self.largest = np.zeros((len(common), self.blocks), dtype=np.float32)
        np.maximum.at(self.largest, (at, owner // span), weight.astype(np.float32))
        self.groups = np.arange(0, len(common), GROUP)
        norms = np.bincount((at // GROUP) * width + owner, weight * weight, len(self.groups) * width)
        self.norms = np.sqrt(norms).astype(np.float32).reshape(len(self.groups), width)
        order = np.argsort(owner, kind="stable")
        self.row_column, self.row_weight = at[order].astype(np.int16), weight[order]
        self.row_start = np.zeros(size + 1, dtype=np.int64)
        np.cumsum(np.bincount(owner, minlength=size), out=self.row_start[1:])

    def weights(self, terms: np.ndarray, counts: np.ndarray) -> np.ndarray:
        w = (1 + np.log(counts)) * self.idf[terms]
        return w / np.sqrt((w * w).sum()) if len(w) else w

    def _cosines(self, queries: list[tuple[np.ndarray, np.ndarray]], k: int) -> np.ndarray:
        """Queries by examples; examples that cannot be among the first k keep what the telling terms give."""
        term = np.concatenate([t for t, _ in queries]).astype(np.int64)
        weight = np.concatenate([self.weights(t, n) for t, n in queries])
        query = np.repeat(np.arange(len(queries)), [len(t) for t, _ in queries])
        at, width = self.column[term], self.blocks * self.span
        head = np.zeros((len(queries), self.columns))
        head[query[at >= 0], at[at >= 0]] = weight[at >= 0]
        term, weight, query = term[at < 0], weight[at < 0], query[at < 0]
        n = self.start[term + 1] - self.start[term]
        entry = _ranges(self.start[term], n)
        where = np.repeat(query * width, n) + self.owner.take(entry)
        total = np.bincount(where, np.repeat(weight, n) * self.weight.take(entry), len(queries) * width)
        total = total.reshape(-1, width).astype(float, copy=False)
        if self.dense is not None:
            total = total + head @ self.dense
        elif self.columns:
            self._add_common(total, head, k)
        return total[:, : self.size]

    def _add_common(self, total: np.ndarray, head: np.ndarray, k: int) -> None:
        """What the common terms give to those examples that can still be among the first k.

        Some k examples that lead so far are read at once: the least of their whole sums is what all others must reach.
        """
        rows = len(total)
        so_far, least, first = total.copy(), np.zeros((rows, 1)), np.zeros(total.shape, dtype=bool)
        parts = so_far.reshape(rows, self.blocks, self.span)
        lead = parts.argmax(axis=2)
        top = np.take_along_axis(parts, lead[:, :, None], axis=2)[:, :, 0]
        if self.size >= k:
            if self.size >= k * self.span:
                # Any k examples give a bound; the leaders of the k best blocks are found without ordering all examples.
                whole = self.size // self.span
                blocks = np.argpartition(top[:, :whole], whole - k, axis=1)[:, whole - k :]
                at = blocks * self.span + np.take_along_axis(lead, blocks, axis=1)
            else:
                at = np.argpartition(total[:, : self.size], self.size - k, axis=1)[:, self.size - k :]
            np.put_along_axis(first, at, True, axis=1)
            self._read_rows(total, head, np.repeat(np.arange(rows), k), at.ravel())
            least = np.take_along_axis(total, at, axis=1).min(axis=1)[:, None] - SLACK
        small = head.astype(np.float32)
        reach = top + small @ self.largest >= least
        norms = np.sqrt(np.add.reduceat(small * small, self.groups, axis=1))
        hopeful = (so_far + norms @ self.norms >= least) & np.repeat(reach, self.span, axis=1) & ~first
        query, example = np.divmod(np.flatnonzero(hopeful), hopeful.shape[1])
        real = example < self.size
        self._read_rows(total, head, query[real], example[real])

    def _read_rows(self, total: np.ndarray, head: np.ndarray, query: np.ndarray, example: np.ndarray) -> None:
        """Adds the common terms' part of some (query, example) cells, about a million weights at a time."""
        n = self.row_start[example + 1] - self.row_start[example]
        flat, base = head.ravel(), query * self.columns
        cuts = np.flatnonzero(np.diff(np.cumsum(n) // 1_000_000, prepend=-1)).tolist() + [len(n)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            entry = _ranges(self.row_start[example[a:b]], n[a:b])
            given = flat.take(np.repeat(base[a:b], n[a:b]) + self.row_column.take(entry)) * self.row_weight.take(entry)
            total[query[a:b], example[a:b]] += np.bincount(np.repeat(np.arange(b - a), n[a:b]), given, b - a)

    def nearest_of(
        self, queries: list[tuple[np.ndarray, np.ndarray]], k: int, but: list[int] | None = None
    ) -> list[list[tuple[int, float]]]:
        """For each query the k examples (number, cosine) with the highest cosine above 0, without its example of `but`."""
        if not self.size:
            return [[] for _ in queries]
        out = []
        for a in range(0, len(queries), self.block):
            cosine = self._cosines(queries[a : a + self.block], k + (but is not None))
            if but is not None:
                own = np.array(but[a : a + self.block])
                cosine[np.flatnonzero(own >= 0), own[own >= 0]] = 0
            # Cosine and example in one whole number, all different: what is cut off is never one of several equals.
            rank = np.rint(cosine * 1e9).astype(np.int64) * self.size + np.arange(self.size - 1, -1, -1)
            best = np.partition(rank, -k, axis=1)[:, -k:] if self.size > k else rank
            for row in np.sort(best, axis=1)[:, ::-1].tolist():
                found = (divmod(r, self.size) for r in row)
                out.append([(self.size - 1 - i, min(1.0, c / 1e9)) for c, i in found if c > 0])
        return out

    def nearest(self, terms: np.ndarray, counts: np.ndarray, k: int, but: int = -1) -> list[tuple[int, float]]:
        found = self.nearest_of([(terms, counts)], k + 1)[0]
        return [x for x in found if x[0] != but][:k]


@dataclass(frozen=True)
class Vote:
    """Share of label 1 among the nearest `neighbours`: each weighs cosine ** power over its distance, and a weight of
    `doubt` speaks for label 0, as far neighbours alone prove little."""

    neighbours: int
    power: float = 1.0
    doubt: float = 1.0

    def __call__(self, found: list[tuple[int, float]], labels: np.ndarray) -> float | None:
        """None without neighbours."""
        if not found:
            return None
        weights = [c**self.power / (1.02 - c) for _, c in found[: self.neighbours]]
        return sum(w * labels[i] for w, (i, _) in zip(weights, found, strict=False)) / (self.doubt + sum(weights))


@dataclass
class Examples:
    """The examples' postings in order of term and example, examples by doc_id; bounded by the number of examples."""

    vocabulary: Vocabulary
    term: np.ndarray
    owner: np.ndarray
    count: np.ndarray
    doc_ids: list[int]
    label: np.ndarray
    idf: np.ndarray | None = None
    share: np.ndarray | None = None

    @classmethod
    def received(cls, sent: Broadcast) -> Examples:
        """Only plain arrays travel in a broadcast, so that a worker needs no class of this package to read them."""
        values = dict(sent.value)
        return cls(Vocabulary(values.pop("terms")), **values)

    def plain(self) -> dict:
        names = ("term", "owner", "count", "doc_ids", "label", "idf", "share")
        return {"terms": self.vocabulary.terms[: len(self.vocabulary)]} | {n: getattr(self, n) for n in names}

    def vectors(self, which: np.ndarray):
        """(terms, counts) of some examples."""
        mine = np.zeros(len(self.label), dtype=bool)
        mine[which] = True
        at = np.flatnonzero(mine[self.owner])
        at = at[np.argsort(self.owner[at], kind="stable")]
        cuts = np.searchsorted(self.owner[at], which).tolist() + [len(at)]
        for i, j in zip(cuts, cuts[1:], strict=False):
            yield self.term[at[i:j]], self.count[at[i:j]]

    def index(self, by_strength: int, which: np.ndarray | None = None) -> BlockMaxIndex:
        """Of all examples or of some, whose labels alone give the strengths."""
        which = np.arange(len(self.label)) if which is None else which
        number = np.full(len(self.label), -1, dtype=np.int32)
        number[which] = np.arange(len(which))
        owner = number[self.owner]
        term, owner, count = (x[owner >= 0] for x in (self.term, owner, self.count))
        idf = self.idf * strengths(term, owner, self.label[which], len(self.idf)) ** by_strength
        return BlockMaxIndex.of_postings(term, owner, count, len(which), idf, dense=not by_strength)


def strengths(term: np.ndarray, owner: np.ndarray, labels: np.ndarray, size: int) -> np.ndarray:
    """How much each term says about the label: size of its smoothed log odds, and a little for all."""
    kind = labels[owner]
    in_one, in_zero = (np.bincount(term[kind == k], minlength=size) for k in (1, 0))
    ones, zeros = int(labels.sum()), int((1 - labels).sum())
    prior = 2 * ones / max(1, ones + zeros)
    odds = np.log((in_one + prior + 1e-9) / (ones + 2)) - np.log((in_zero + 2 - prior + 1e-9) / (zeros + 2))
    return 0.05 + np.abs(odds)


def fold_of(n: int) -> np.ndarray:
    return np.arange(n) % 5


def fold_neighbours(examples: Examples, by_strength: int, j: int, neighbours: int) -> list[list[tuple[int, float]]]:
    """The nearest of the other four fifths for each example of fifth `j`; only those four's labels give the strengths."""
    fold = fold_of(len(examples.label))
    rest, own = np.flatnonzero(fold != j), np.flatnonzero(fold == j)
    found = examples.index(by_strength, rest).nearest_of(list(examples.vectors(own)), neighbours)
    return [[(int(rest[x]), c) for x, c in near] for near in found]


def cross_validated(spark: SparkSession, examples: Broadcast, neighbours: int) -> tuple[int, Vote, list[float | None]]:
    """Whether terms count by TF-IDF alone (0) or times their strength (1), which vote, and the examples' votes.

    Each fifth of the examples votes over the other four, one task for each fifth and form. Of all choices the one with
    the least log loss is taken, calibrated on four fifths and held against the fifth; of equal ones the first.
    """

    def run(batches):
        own_examples = Examples.received(examples)
        for batch in batches:
            for form, j in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = fold_neighbours(own_examples, form, j, neighbours)
                own = np.flatnonzero(fold_of(len(own_examples.label)) == j)
                n = [len(f) for f in found]
                columns = [pa.array(np.full(sum(n), form), pa.int32()), pa.array(np.repeat(own, n), pa.int32())]
                columns += [pa.array([i for f in found for i, _ in f], pa.int32()), pa.array([c for f in found for _, c in f], pa.float64())]
                yield pa.record_batch(columns, names=["form", "example", "i", "c"])

    todo = spark.range(10).select((F.col("id") % 2).cast("int").alias("form"), F.floor(F.col("id") / 2).cast("int").alias("fold"))
    # Plain columns, nearest first for each example; bounded by the number of examples.
    rows = todo.repartition(10, "form", "fold").mapInArrow(run, "form int, example int, i int, c double").toArrow()
    labels, weights = examples.value["label"], examples.value["share"]
    fold = fold_of(len(labels))
    best, least = (0, Vote(neighbours), [None] * len(labels)), np.inf
    for form in (0, 1):
        found: list[list[tuple[int, float]]] = [[] for _ in labels]
        own = rows.filter(pc.equal(rows.column("form"), form))
        for x, i, c in zip(*(own.column(name).to_pylist() for name in ("example", "i", "c")), strict=True):
            found[x].append((i, c))
        for k in [neighbours, *(n for n in (7, 3) if n < neighbours)]:
            for power, doubt in ((1.0, 1.0), (1.0, 0.1), (1.0, 0.01), (3.0, 0.1), (3.0, 0.01)):
                vote = Vote(k, power, doubt)
                votes = [vote(f, labels) for f in found]
                loss = 0.0
                for j in range(5):
                    rest, own = np.flatnonzero(fold != j), np.flatnonzero(fold == j)
                    told = Calibration([votes[i] for i in rest], labels[rest], weights[rest])
                    p = np.clip([told(votes[i]) for i in own], 1e-3, 1 - 1e-3)
                    loss -= float((weights[own] * np.log(np.where(labels[own] == 1, p, 1 - p))).sum())
                if loss < least - 1e-9:
                    best, least = (form, vote, votes), loss
    return best


class Calibration:
    """From votes to probabilities: isotonic steps through cross-validated votes, weighted to the labels' true shares."""

    def __init__(self, votes: list[float | None], labels: np.ndarray, weights: np.ndarray):
        none = np.array([v is None for v in votes], dtype=bool)
        self.silent = self._share(labels[none], weights[none], labels, weights)
        rows = sorted((v, w * y, w) for v, y, w in zip(votes, labels.tolist(), weights.tolist(), strict=True) if v is not None)
        steps: list[list[float]] = []  # [first vote, last vote, weight of label 1, weight]
        for v, one, w in rows:
            steps.append([v, v, one, w])
            while len(steps) > 1 and steps[-2][2] * steps[-1][3] >= steps[-1][2] * steps[-2][3]:
                last = steps.pop()
                steps[-1] = [steps[-1][0], last[1], steps[-1][2] + last[2], steps[-1][3] + last[3]]
        self.at = np.array([x for s in steps for x in s[:2]])
        self.share = np.array([x for s in steps for x in [s[2] / s[3]] * 2])

    @staticmethod
    def _share(labels, weights, every, every_weight) -> float:
        """Share of label 1, drawn a little towards the overall one where there are few rows."""
        prior = float((every * every_weight).sum() / every_weight.sum()) if len(every) else 0.0
        return float((labels * weights).sum() + prior) / float(weights.sum() + 1)

    def __call__(self, v: float | None) -> float:
        if v is None or not len(self.at):
            return self.silent
        return float(np.interp(v, self.at, self.share))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def _examples(docs: DataFrame, labels: DataFrame, each: int) -> tuple[DataFrame, dict[int, int]]:
    """(doc_id, toxic) of at most `each` training labels of either kind, chosen by hash, and how many there are in all."""
    training = (
        labels.filter("doc_id IS NOT NULL AND toxic IN (0, 1)")
        .filter(~held_out(F.col("doc_id")))
        .groupBy(F.col("doc_id").cast("long").alias("doc_id"))
        .agg(F.max("toxic").cast("int").alias("toxic"))
    )
    kinds = [training.filter(F.col("toxic") == t).orderBy(F.xxhash64("doc_id"), "doc_id").limit(each) for t in (0, 1)]
    counts = {r.toxic: r["n"] for r in training.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    return materialise(kinds[0].unionByName(kinds[1]), "examples"), counts


def _example_vectors(texts: DataFrame) -> Examples:
    """All terms of the examples, and of each example its terms and counts, doc_id and label, by doc_id.

    Rows are taken one after the other and only their numbers kept, so the driver holds the vectors once.
    """

    def run(batches):
        for batch in batches:
            for a, b, t in text_runs(_lower(batch.column(0))):
                owner, term = terms_of(t)
                order = np.argsort(owner, kind="stable")
                cuts = np.searchsorted(owner[order], np.arange(b - a + 1)).tolist()
                own = [np.unique(term[order[x:y]], return_counts=True) for x, y in zip(cuts, cuts[1:], strict=False)]
                columns = [pa.array([x.tobytes() for x, _ in own], pa.binary())]
                columns += [pa.array([n.astype(np.int32).tobytes() for _, n in own], pa.binary())]
                sides = [batch.column(1).slice(a, b - a), batch.column(2).slice(a, b - a)]
                yield pa.record_batch(sides + columns, names=["doc_id", "toxic", "terms", "counts"])

    schema = "doc_id long, toxic int, terms binary, counts binary"
    rows = materialise(texts.select("text", "doc_id", "toxic").mapInArrow(run, schema), "example-vectors")
    terms = rows.select("terms").mapInArrow(_distinct, "term long").distinct().toArrow().column("term").to_numpy()
    every = np.sort(terms.view(np.uint64))
    numbers, counts, keys = [], [], []
    # One row at a time, by order of id; equal rows are alike, so their order makes no difference.
    for r in rows.orderBy("doc_id", "toxic", "terms", "counts").toLocalIterator():
        numbers.append(np.searchsorted(every, np.frombuffer(r.terms, np.uint64)).astype(np.int32))
        counts.append(np.frombuffer(r.counts, np.int32))
        keys.append((r.doc_id, r.toxic))
    owner = np.repeat(np.arange(len(keys), dtype=np.int32), [len(n) for n in numbers])
    term, count = (np.concatenate(x) if x else np.zeros(0, np.int32) for x in (numbers, counts))
    del numbers, counts
    order = np.argsort(term, kind="stable")
    label = np.array([t for _, t in keys], dtype=np.int64)
    return Examples(Vocabulary(every), term[order], owner[order], count[order], [d for d, _ in keys], label)


def _distinct(batches):
    """Distinct terms of a batch of rows of term digests."""
    for batch in batches:
        parts = [np.frombuffer(x, np.uint64) for x in batch.column(0).to_pylist()]
        every = np.unique(np.concatenate(parts)) if parts else np.zeros(0, np.uint64)
        yield pa.record_batch([pa.array(every.view(np.int64))], names=["term"])


def _document_counts(docs: DataFrame, vocabulary: Vocabulary) -> tuple[np.ndarray, int]:
    """In how many of all documents each term stands, and how many documents there are."""
    size = len(vocabulary)

    def run(batches):
        total = np.zeros(size + 1, dtype=np.int64)
        for batch in batches:
            total[size] += batch.num_rows
            for _, _, t in text_runs(_lower(batch.column(0))):
                total[:size] += np.bincount(term_counts(t, vocabulary)[1], minlength=size)
        there = np.flatnonzero(total)
        yield pa.record_batch([pa.array(there, pa.int32()), pa.array(total[there])], names=["term", "n"])

    sums = docs.select("text").mapInArrow(run, "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    total = np.zeros(size + 1, dtype=np.int64)
    total[sums.column("term").to_numpy()] = sums.column("n").to_numpy()
    return total[:size], int(total[size])


@dataclass
class Model:
    """A fitted index; its size is bounded by the number of examples. Workers get the examples once and build it once."""

    examples: Broadcast
    by_strength: int
    vote: Vote
    calibrated: Calibration
    vocabulary: Vocabulary
    neighbours: int
    key: str

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "vocabulary"}

    def index(self) -> tuple[BlockMaxIndex, Examples, dict[int, int]]:
        """The index, the examples and the place of each by doc_id."""

        def build():
            e = Examples.received(self.examples)
            index = e.index(self.by_strength)
            # What was sent is needed no more once the index stands.
            self.examples.__dict__.pop("_value", None)
            e.term = e.owner = e.count = e.idf = e.share = None
            return index, e, {d: i for i, d in enumerate(e.doc_ids)}

        return per_worker("toxicity", self.key, build)

    def scores(self, column: pa.Array, ids: pa.Array | None = None) -> list[tuple[float, list[dict]]]:
        """(score, evidence) of each text; with `ids`, an example is not its own neighbour."""
        out, (index, e, place) = [], self.index()
        own = [-1] * len(column) if ids is None else [place.get(d, -1) for d in ids.to_pylist()]
        for a, b, t in text_runs(_lower(column)):
            owner, term, n = term_counts(t, e.vocabulary)
            cuts = np.searchsorted(owner, np.arange(b - a + 1)).tolist()
            queries = [(term[x:y], n[x:y]) for x, y in zip(cuts, cuts[1:], strict=False)]
            for found in index.nearest_of(queries, max(self.vote.neighbours, 3), own[a:b]):
                proof = [{"doc_id": e.doc_ids[i], "toxic": int(e.label[i]), "cosine": c} for i, c in found[:3]]
                out.append((self.calibrated(self.vote(found, e.label)), proof))
        return out


def fitted(docs: DataFrame, labels: DataFrame, examples_each: int = 4096, neighbours: int = 15) -> Model:
    """Examples are at most `examples_each` training rows of either label, chosen by hash (training rows have crc32(doc_id)
    mod 5 other than 0). All their terms make the vector space; document frequencies are counted over all documents.
    Cross-validation on the examples (`cross_validated`) chooses whether TF-IDF stands alone or times each term's strength,
    and the vote; its votes calibrate, weighted to the true shares of the labels.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    picked, counts = _examples(docs, labels, examples_each)
    examples = _example_vectors(docs.join(F.broadcast(picked), "doc_id"))
    df, n = _document_counts(docs, examples.vocabulary)
    here = np.bincount(examples.label, minlength=2)
    examples.idf = np.log((1 + n) / (1 + df)) + 1
    examples.share = np.array([counts[t] / here[t] for t in examples.label.tolist()])
    spark, vocabulary, label, share = docs.sparkSession, examples.vocabulary, examples.label, examples.share
    sent = spark.sparkContext.broadcast(examples.plain())
    by_strength, vote, votes = cross_validated(spark, sent, neighbours)
    return Model(sent, by_strength, vote, Calibration(votes, label, share), vocabulary, neighbours, uuid.uuid4().hex)


def toxicity_scores(docs: DataFrame, labels: DataFrame, **parameters) -> DataFrame:
    """doc_id, held_out, score, predicted, evidence of every document, over its whole text.

    Each document votes over its nearest examples (see `fitted`) by exact cosine, near ones more, and the vote is
    calibrated. A document without a known term gets the share that such examples have. `evidence` holds the three
    nearest examples. The index is bounded, so each task holds it and no text is shuffled.

    Only the text is an input of a score. Null and empty text: scored as without known terms. Null doc_id: scored, not
    held out, never an example. Null toxic: no label; two labels for a document: the higher. Repeated rows: each scored
    alike. An example does not vote on itself. No labels at all: score 0. Empty table: no rows. Other columns are not read.
    """
    model = fitted(docs, labels, **parameters)

    def run(batches):
        for batch in batches:
            out = model.scores(batch.column(0), batch.column(1))
            score = np.array([s for s, _ in out], dtype=np.float64)
            kinds = pa.list_(pa.struct([("doc_id", pa.int64()), ("toxic", pa.int32()), ("cosine", pa.float64())]))
            arrays = [pa.array(score), pa.array((score >= 0.5).astype(np.int32)), pa.array([p for _, p in out], kinds)]
            names = ["doc_id", "held_out", "score", "predicted", "evidence"]
            yield pa.record_batch([batch.column(1), batch.column(2), *arrays], names=names)

    doc_id = F.col("doc_id").cast("long")
    return docs.select("text", doc_id.alias("doc_id"), held_out(doc_id).alias("held_out")).mapInArrow(run, SCORED)


def without_toxic(docs: DataFrame, labels: DataFrame, **parameters) -> DataFrame:
    """`docs` without the documents whose score is 0.5 or more; the columns stay, whatever their names. Texts are scored where
    they lie. Null ids and texts and repeated rows are scored as in `toxicity_scores`; an empty table stays empty."""
    model = fitted(docs, labels, **parameters)

    at = [c.lower() for c in docs.columns].index("text")

    def run(batches):
        for batch in batches:
            texts = batch.column(0).field(at)
            clean = pa.array([s < 0.5 for s, _ in model.scores(texts, batch.column(1))], pa.bool_())
            yield batch.select([0]).filter(clean)

    # The text goes to the workers once, inside its row.
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").cast("long").alias("_id"))
    return rows.mapInArrow(run, rows.select("row").schema).select("row.*")
