"""Hard negatives by threshold joins: partial scores over indexed dimensions, pruned by the norms of the rest."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from hirelake.llm.common import materialise

#: Anchors scored at once, and the parts into which the dimensions are cut.
SLICE, BLOCKS = 64, 4
FOUND = "anchor_row long, row long, positive_id long, positive_score long"
MINED = (
    "anchor_id long, anchor_row long, positive_id long, place int, positive_score long, negative_id long, row long, negative_score long"
)
#: An id that is null comes after all others.
LAST = np.iinfo(np.int64).max


def matrix(lists: pa.ChunkedArray, width: int) -> np.ndarray:
    """Lists of integers as rows; a shorter one goes on with zeros."""
    lists = lists.combine_chunks()
    counts, flat = np.asarray(lists.value_lengths()), np.asarray(lists.flatten())
    out = np.zeros((len(counts), width), np.int64)
    out[np.repeat(np.arange(len(counts)), counts), np.arange(len(flat)) - np.repeat(np.cumsum(counts) - counts, counts)] = flat
    return out


class ThresholdIndex:
    """Finds all pairs whose inner product reaches a threshold, without a full product where norms rule it out.

    Dimensions stand in the order of falling energy, in a few blocks. For a threshold, a vector is indexed under its leading
    blocks only: the first ones after which the norm of its rest times that of any query's rest is below the threshold, so
    that no pair reaches it by the rest alone. Partial scores are added up block by block over the vectors indexed there;
    a pair goes on if its partial score plus the product of both rests' norms reaches the threshold, and is then finished
    over the blocks left out.
    """

    def __init__(self, vectors: np.ndarray, queries: np.ndarray):
        energy = (vectors.astype(np.float64) ** 2).sum(axis=0)
        order = np.argsort(-energy, kind="stable")
        vectors, queries = vectors[:, order], queries[:, order]
        self.bounds = np.unique(np.linspace(0, vectors.shape[1], BLOCKS + 1).astype(int))
        self.tails, self.query_tails = self._tails(vectors), self._tails(queries)
        largest = self.tails[:, 0].max(initial=0) * self.query_tails[:, 0].max(initial=0)
        # Sums of integers are exact in any order while no partial one leaves the mantissa; beyond, Python's integers.
        self.kind = np.float32 if largest < 2**23 else np.float64 if largest < 2**52 else object
        self.vectors, self.queries = vectors.astype(self.kind), queries.astype(self.kind)

    def _tails(self, x: np.ndarray) -> np.ndarray:
        """Norms of what is left from each block on, and 0 at the end; a little too long rather than too short."""
        squares = np.add.reduceat(x.astype(np.float64) ** 2, self.bounds[:-1], axis=1) if x.shape[1] else np.zeros((len(x), 0))
        rest = np.cumsum(squares[:, ::-1], axis=1)[:, ::-1]
        return np.sqrt(np.concatenate([rest, np.zeros((len(x), 1))], axis=1)) * (1 + 1e-6)

    def reaching(self, which: np.ndarray, need: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place in `which`, vector, score) of every pair of these queries that scores `need` of the query or more."""
        q, rest, blocks = self.queries[which], self.query_tails[which], list(zip(self.bounds, self.bounds[1:], strict=False))
        least = need.min()
        reach = rest.max(axis=0) * self.tails >= least
        # Number of indexed blocks: up to the first rest that cannot reach the threshold (all, where it is 0 or less).
        indexed = np.where(reach.all(axis=1), len(blocks), np.argmin(reach, axis=1))
        if least <= 0:
            indexed[:] = len(blocks)
        rows = np.argsort(-indexed, kind="stable")
        rows = rows[indexed[rows] > 0]
        score = np.zeros((len(which), len(rows)), self.kind)
        slack = np.asarray(need, np.float64)[:, None] - 0.5
        for b, (i, j) in enumerate(blocks):
            here = int(np.searchsorted(-indexed[rows], -b, side="left"))
            score[:, :here] += q[:, i:j] @ self.vectors[rows[:here], i:j].T
            if b + 1 == len(blocks) // 2 and self.kind is not object:
                reach = rest[:, b + 1 : b + 2] * self.tails[rows, b + 1]
                alive = ((score + reach >= slack).any(axis=0)) | (indexed[rows] <= b)
                rows, score = rows[alive], score[:, alive]
        done = indexed[rows]
        at, column = np.nonzero((score + rest[:, done] * self.tails[rows, done] >= slack).astype(bool))
        row, total = rows[column], score[at, column]
        for b, (i, j) in enumerate(blocks):
            more = np.flatnonzero(done[column] <= b)
            if len(more):
                total[more] += (q[at[more], i:j] * self.vectors[row[more], i:j]).sum(axis=1)
        total = np.array([max(-(2**63), min(2**63 - 1, int(x))) for x in total], np.int64) if self.kind is object else total.astype(np.int64)
        keep = total >= need[at]
        return at[keep], row[keep], total[keep]


class Side:
    """Rows of a cell: place in the table, id, label and integers."""

    def __init__(self, rows: pa.Table, width: int, lead: str = ""):
        self.row = np.asarray(rows.column(f"{lead}row"))
        self.id = np.asarray(rows.column(f"{lead}vec_id").fill_null(LAST))
        self.label = np.asarray(rows.column(f"{lead}label"))
        self.x = matrix(rows.column(f"{lead}q"), width)


def _width(*lists: pa.ChunkedArray) -> int:
    return max([1, *(int(np.asarray(x.combine_chunks().value_lengths()).max(initial=0)) for x in lists)])


def _firsts(group: np.ndarray, score: np.ndarray, ids: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """Places of the first `n` of each group: higher scores, then smaller ids, then earlier rows."""
    order = np.lexsort((rows, ids, -score, group))
    g = group[order]
    begin = np.flatnonzero(np.append(True, g[1:] != g[:-1])) if len(g) else np.zeros(0, int)
    rank = np.arange(len(g)) - np.repeat(begin, np.diff(np.append(begin, len(g))))
    return order[rank < n]


def _ids(values: np.ndarray) -> pa.Array:
    return pa.array(values, pa.int64(), mask=values == LAST)


def _slices(index: np.ndarray):
    for i in range(0, len(index), SLICE):
        yield index[i : i + SLICE]


def _positives(n: int, rows: pa.Table, anchors: pa.Table) -> pa.Table:
    """The first `n` rows of one part of a label for each anchor of the label: thresholds fall until there are so many."""
    names = [x.split()[0] for x in FOUND.split(", ")]
    out = [[], [], [], []]
    if rows.num_rows and anchors.num_rows:
        width = _width(rows.column("q"), anchors.column("a_q"))
        x, a = Side(rows, width), Side(anchors, width, "a_")
        index = ThresholdIndex(x.x, a.x)
        highest = index.query_tails[:, 0] * index.tails[:, 0].max()
        for which in _slices(np.arange(len(a.row))):
            for share in (0.75, 0.5, 0.25, None):
                need = np.full(len(which), -(2**63), np.int64) if share is None else (share * highest[which]).astype(np.int64)
                at, row, score = index.reaching(which, need)
                other = x.row[row] != a.row[which[at]]
                at, row, score = at[other], row[other], score[other]
                full = (np.bincount(at, minlength=len(which)) >= n) | (share is None)
                use = np.flatnonzero(full[at])
                at, row, score = at[use], row[use], score[use]
                take = _firsts(at, score, x.id[row], x.row[row], n)
                for c, values in zip(out, (a.row[which[at[take]]], x.row[row[take]], x.id[row[take]], score[take]), strict=True):
                    c.append(values)
                which = which[~full]
                if not len(which):
                    break
    anchor, row, ids, score = (np.concatenate([np.zeros(0, np.int64), *c]) for c in out)
    return pa.table([pa.array(anchor), pa.array(row), _ids(ids), pa.array(score)], names=names)


def _negatives(n: int, low: int, high: int, rows: pa.Table, anchors: pa.Table) -> pa.Table:
    """The first `n` rows of one part for each anchor and positive: other labels, scores in the positive's window."""
    names = [x.split()[0] for x in MINED.split(", ")]
    out = [[] for _ in names]
    if rows.num_rows and anchors.num_rows:
        width = _width(rows.column("q"), anchors.column("a_q"))
        x, a = Side(rows, width), Side(anchors, width, "a_")
        index = ThresholdIndex(x.x, a.x)
        positives = anchors.column("a_positives").to_pylist()
        k = max(map(len, positives))
        # Places without a positive, or with one below 0 whose window is empty, have a window that nothing is in.
        windows = [[(-(-low * p["s"] // 100), high * p["s"] // 100) if p["s"] >= 0 else (1, 0) for p in ps] for ps in positives]
        windows = np.array([w + [(1, 0)] * (k - len(w)) for w in windows], np.int64)
        begin, end = windows[:, :, 0], windows[:, :, 1]
        real = begin <= end
        p_id = np.array([[LAST if p["id"] is None else p["id"] for p in ps] + [0] * (k - len(ps)) for ps in positives], np.int64)
        p_score = np.array([[p["s"] for p in ps] + [0] * (k - len(ps)) for ps in positives], np.int64)
        lowest, top = np.where(real, begin, LAST).min(axis=1), np.where(real, end, LAST).min(axis=1)
        for which in _slices(np.flatnonzero(real.any(axis=1))):
            for share in (0.75, 0.5, 0.0):
                need = np.maximum(lowest[which], (share * top[which]).astype(np.int64))
                at, row, score = index.reaching(which, need)
                other = x.label[row] != a.label[which[at]]
                at, row, score = at[other], row[other], score[other]
                found, full = [], np.ones(len(which), dtype=bool)
                for p in range(k):
                    b, e = begin[which, p], end[which, p]
                    inside = np.flatnonzero((score >= b[at]) & (score <= e[at]))
                    full &= (np.bincount(at[inside], minlength=len(which)) >= n) | (need <= b) | (b > e)
                    found.append(inside)
                for p, inside in enumerate(found):
                    inside = inside[full[at[inside]]]
                    i, j, s = at[inside], row[inside], score[inside]
                    take = _firsts(i, s, x.id[j], x.row[j], n)
                    i, j, s = which[i[take]], j[take], s[take]
                    parts = (a.id[i], a.row[i], p_id[i, p], np.full(len(i), p), p_score[i, p], x.id[j], x.row[j], s)
                    for c, values in zip(out, parts, strict=True):
                        c.append(values)
                which = which[~full]
                if not len(which):
                    break
    columns = [np.concatenate([np.zeros(0, np.int64), *c]) for c in out]
    made = [_ids(c) if name.endswith("_id") else pa.array(c) for name, c in zip(names, columns, strict=True)]
    made[3] = made[3].cast(pa.int32())
    return pa.table(made, names=names)


def _dealt(df: DataFrame, own: str, others: str, own_parts: Column, other_parts: Column) -> DataFrame:
    """Each row in one of its own parts, once for every part of the other side."""
    return df.withColumn(own, F.pmod(F.xxhash64("row"), own_parts)).withColumn(
        others, F.explode(F.sequence(F.lit(0).cast("long"), other_parts.cast("long") - 1))
    )


def _renamed(df: DataFrame) -> DataFrame:
    """The anchors' side of a cogroup, which comes from the same table as the other."""
    return df.select(*[F.col(c).alias(f"a_{c}") for c in df.columns])


def _parts(n: Column, size: int) -> Column:
    return F.greatest(F.ceil(n / F.lit(size)), F.lit(1)).cast("long")


def hard_negatives(
    vectors: DataFrame,
    anchor: Column,
    n_positives: int = 5,
    n_negatives: int = 10,
    low: int = 30,
    high: int = 90,
    cell_values: int = 4_000_000,
    anchor_values: int = 500_000,
) -> DataFrame:
    """For each anchor and each of its nearest rows of the same label, the nearest rows of other labels that score between
    `low` and `high` per cent of that positive.

    `vectors` has vec_id, label and q (integers); the score is the integer inner product. Rows meet anchors in cells of
    about `cell_values` numbers and `anchor_values` anchor numbers, positives among the cells of their label, so a hot
    label is many cells. In a cell a threshold join runs with falling thresholds until every window is full or all of it
    is seen; no cell returns more than the first rows of each window, and the first of all cells' firsts are the result.

    Null vec_id: no anchor, but may be found, after equals. Equal scores: smaller vec_id, then earlier row. Repeated rows:
    each stands for itself, so an anchor's copy is another row. An empty vector scores 0 with all; a shorter vector goes
    on with zeros. Scores beyond 64 bits stop there. Empty table: no rows. Other columns are not read.
    """
    kept = vectors.select("vec_id", "label", "q", F.coalesce(anchor, F.lit(False)).alias("anchor"))
    items = materialise(kept.withColumn("row", F.monotonically_increasing_id()), "vectors")
    n, m, width = items.agg(F.count("*"), F.count_if("anchor"), F.coalesce(F.max(F.size("q")), F.lit(0))).first()
    per_cell, per_block = max(1, cell_values // max(width, 1)), max(1, anchor_values // max(width, 1))

    labels = items.groupBy(F.col("label").alias("of")).agg(F.count("*").alias("n"), F.count_if("anchor").alias("m")).filter("m > 0")
    same = items.join(labels, F.col("label") == F.col("of"))
    parts, blocks = _parts(F.col("n"), per_cell), _parts(F.col("m"), per_block)
    cell, wanted = ["label", "part", "block"], ["row", "vec_id", "label", "q", "part", "block"]
    rows = _dealt(same, "part", "block", parts, blocks).select(*wanted)
    asked = _dealt(same.filter("anchor"), "block", "part", blocks, parts).select(*wanted)
    asked = _renamed(asked).groupBy("a_label", "a_part", "a_block")
    near = rows.groupBy(*cell).cogroup(asked).applyInArrow(lambda x, a: _positives(n_positives, x, a), FOUND)
    first = W.partitionBy("anchor_row").orderBy(F.desc("positive_score"), F.asc_nulls_last("positive_id"), "row")
    near = near.withColumn("place", F.row_number().over(first)).filter(F.col("place") <= n_positives)
    each = F.struct("place", F.col("positive_id").alias("id"), F.col("positive_score").alias("s"))
    near = near.groupBy("anchor_row").agg(F.sort_array(F.collect_list(each)).alias("positives"))

    ready = items.filter("anchor").join(near, F.col("row") == F.col("anchor_row"))
    parts, blocks = _parts(F.lit(n), per_cell), _parts(F.lit(m), per_block)
    rows = _dealt(items, "part", "block", parts, blocks).select(*wanted)
    asked = _renamed(_dealt(ready, "block", "part", blocks, parts).select(*wanted, "positives")).groupBy("a_part", "a_block")
    mined = rows.groupBy("part", "block").cogroup(asked).applyInArrow(lambda x, a: _negatives(n_negatives, low, high, x, a), MINED)
    order = W.partitionBy("anchor_row", "place").orderBy(F.desc("negative_score"), F.asc_nulls_last("negative_id"), "row")
    ranked = mined.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n_negatives)
    return ranked.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def integer_vectors(vectors: DataFrame) -> DataFrame:
    """vec_id, label and floor(256 x) of each component; rows with a null label, a null vector, or a null or non-finite
    component are left out. Every label whose vec_id divides by 7 moves on by one, modulo 10."""
    number = F.coalesce(F.col("embedding").isNotNull() & F.forall("embedding", _finite), F.lit(False))
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label").cast("long") + 1) % 10).otherwise(F.col("label").cast("long"))
    return vectors.filter(number & F.col("label").isNotNull()).select(
        F.col("vec_id").cast("long").alias("vec_id"), moved.alias("label"),
        F.transform("embedding", lambda x: F.floor(x.cast("double") * 256).cast("long")).alias("q"),
    )


def _finite(x: Column) -> Column:
    x = x.cast("double")
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
