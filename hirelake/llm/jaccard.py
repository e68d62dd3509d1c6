"""N-gram Jaccard join by chosen paths: sets are split on sampled shared tokens, small buckets compared, runs repeated."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from hirelake.llm.common import materialise, shuffle_width
from hirelake.llm.graph import Forest, components
from hirelake.llm.words import TextRun, grams, inside, mix, text_runs

SETS = "doc_id long, fp long, node long, n long, sketch array<long>, paths array<long>"
SAMPLE = 64


def shingles(run: TextRun, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(document, hash) of the distinct runs of `width` words, by document and hash.

    A document with fewer words, but at least one, has one shingle: all its words.
    """
    s = run.words()
    h = run.hashes(s)
    at = np.flatnonzero(inside(s, width))
    owners, values = [s.owner()[at]], [grams(h, width)[at]]
    for n in range(1, width):
        short = np.flatnonzero(s.count == n)
        owners.append(short)
        values.append(mix(grams(h, n)[s.first[short]], 50 + n))
    owner, value = np.concatenate(owners), np.concatenate(values)
    order = np.lexsort((value, owner))
    owner, value = owner[order], value[order]
    new = np.ones(len(owner), dtype=bool)
    new[1:] = (owner[1:] != owner[:-1]) | (value[1:] != value[:-1])
    return owner[new], value[new]


def _lists(values: np.ndarray, cuts: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(np.ascontiguousarray(values).view(np.int64)))


def token_sets(docs: DataFrame, width: int, threshold: float, runs: int) -> DataFrame:
    """SETS of each document: `node` is a digest of its shingle set, `sketch` its SAMPLE smallest spread hashes, `paths`
    the first step of every run: each shingle is chosen with chance 1 / (threshold * n), alike in all documents."""

    def run(batches):
        for batch in batches:
            for a, b, t in text_runs(batch.column(0)):
                owner, value = shingles(t, width)
                n = np.bincount(owner, minlength=len(t))
                spread = mix(value, 61)
                order = np.lexsort((spread, owner))
                cuts = np.concatenate([[0], np.cumsum(n)])
                rank = np.arange(len(owner)) - np.repeat(cuts[:-1], n)
                small = spread[order][rank < SAMPLE]
                node = np.zeros(len(t), np.uint64)
                np.add.at(node, owner, mix(value, 62))
                node = mix(node ^ mix(n.astype(np.uint64), 63), 64)
                limit = np.minimum(2.0**64 / (threshold * np.maximum(n, 1)), 2.0**64 - 2048).astype(np.uint64)[owner]
                chosen = [(owner[m := mix(value, 100 + r) < limit], mix(value[m], 1000 + r)) for r in range(runs)]
                by, path = (np.concatenate(x) for x in zip(*chosen, strict=True))
                order = np.argsort(by, kind="stable")
                steps = np.concatenate([[0], np.cumsum(np.bincount(by, minlength=len(t)))])
                sketch_cuts = np.concatenate([[0], np.cumsum(np.minimum(n, SAMPLE))])
                arrays = [
                    batch.column(1).slice(a, b - a), batch.column(2).slice(a, b - a), pa.array(node.view(np.int64)),
                    pa.array(n), _lists(small, sketch_cuts), _lists(path[order], steps),
                ]
                yield pa.record_batch(arrays, names=[x.split()[0] for x in SETS.split(", ")])

    return docs.select("text", F.col("doc_id").cast("long"), F.xxhash64("text").alias("fp")).mapInArrow(run, SETS)


def runs_needed(recall: float, depth: int) -> int:
    """Runs until a pair at the threshold meets with chance `recall`, down to `depth` steps.

    Such a pair shares one chosen token per step on average, so a run that must go d deep keeps it with chance
    1 - q(d), where q(0) = 0 and q(d) = exp(q(d - 1) - 1).
    """
    q = 0.0
    for _ in range(depth):
        q = math.exp(q - 1)
    return math.ceil(math.log(1 - recall) / math.log(q))


def deeper(rows: DataFrame, threshold: float) -> DataFrame:
    """(path, node) of the next step of rows (path, node, sketch): tokens chosen anew for each path."""

    def run(batches):
        for batch in batches:
            sketch = batch.column(2)
            n = np.diff(sketch.offsets.to_numpy())
            value = sketch.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
            path = np.repeat(batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64), n)
            node = np.repeat(batch.column(1).to_numpy(zero_copy_only=False), n)
            limit = np.repeat(np.minimum(2.0**64 / (threshold * np.maximum(n, 1)), 2.0**64 - 2048).astype(np.uint64), n)
            key = mix(value ^ mix(path, 71), 72)
            m = key < limit
            yield pa.record_batch([pa.array(mix(key[m] ^ path[m], 73).view(np.int64)), pa.array(node[m])], names=["path", "node"])

    return rows.select("path", "node", "sketch").mapInArrow(run, "path long, node long")


def sketch_similarity(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Jaccard of pairs of sketches (rows, padded with distinct high numbers at the end): the share of common hashes among
    the SAMPLE smallest of both; exact where both sets are whole in their sketches."""
    both = np.sort(np.concatenate([left, right], axis=1), axis=1)
    twice = both[:, 1:] == both[:, :-1]
    real = both < PAD
    rank = np.cumsum(np.concatenate([np.ones((len(both), 1), bool), ~twice], axis=1), axis=1)
    seen = np.minimum(SAMPLE, np.where(real, rank, 0).max(axis=1))
    common = (twice & (rank[:, 1:] <= SAMPLE) & real[:, 1:]).sum(axis=1)
    return common / np.maximum(seen, 1)


PAD = np.uint64(0xFFFFFFFFFFFFFF00)


def _matrix(sketch: pa.ListArray) -> np.ndarray:
    n = np.diff(sketch.offsets.to_numpy())
    value = sketch.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
    out = np.tile(PAD + np.arange(SAMPLE, dtype=np.uint64), (len(n), 1))
    row = np.repeat(np.arange(len(n)), n)
    col = np.arange(len(value)) - np.repeat(np.cumsum(n) - n, n)
    out[row, col] = np.minimum(value, PAD - np.uint64(1))
    return out


def _padded_apart(m: np.ndarray) -> np.ndarray:
    """The right side of a pair pads with other numbers, so that padding never counts as common."""
    return np.where(m >= PAD, m + np.uint64(SAMPLE), m)


def bucket_links(table: pa.Table, least: float, pair_limit: int = 8) -> pa.Table:
    """(a, b): links that connect, inside each bucket (path) of the table, all sets whose sketches are similar enough.

    Pairs that earlier links connect already are not compared again, so a bucket of near copies costs about one
    comparison per member. Small buckets are compared all at once.
    """
    table = table.combine_chunks().sort_by([("path", "ascending"), ("node", "ascending")])
    path = table["path"].to_numpy()
    node = table["node"].to_numpy()
    if not len(path):
        return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
    ids, number = np.unique(node, return_inverse=True)
    first = np.zeros(len(ids), np.int64)
    first[number] = np.arange(len(node))
    column = table["sketch"].combine_chunks()
    sketch = _matrix(column.take(pa.array(first)))
    other = _padded_apart(sketch)
    starts = np.flatnonzero(np.concatenate([[True], path[1:] != path[:-1]]))
    sizes = np.diff(np.append(starts, len(path)))
    forest, out = Forest(len(ids)), []

    def link(i: int, j: int) -> None:
        if forest.join(i, j):
            out.append((i, j))

    pairs = []
    for n in range(2, pair_limit + 1):
        at = starts[sizes == n]
        if len(at):
            i, j = np.triu_indices(n, 1)
            pairs.append(np.stack([number[at[:, None] + i].ravel(), number[at[:, None] + j].ravel()], axis=1))
    if pairs:
        every = np.unique(np.concatenate(pairs), axis=0)
        every = every[every[:, 0] != every[:, 1]]
        for k in range(0, len(every), 20_000):
            part = every[k : k + 20_000]
            for i, j in part[sketch_similarity(sketch[part[:, 0]], other[part[:, 1]]) >= least].tolist():
                link(i, j)
    for s, n in zip(starts[sizes > pair_limit].tolist(), sizes[sizes > pair_limit].tolist(), strict=True):
        members = np.unique(number[s : s + n])
        for i in members.tolist():
            root = forest.find(i)
            rest = np.array([j for j in members.tolist() if forest.find(j) != root], dtype=np.int64)
            for k in range(0, len(rest), 20_000):
                part = rest[k : k + 20_000]
                like = sketch_similarity(np.broadcast_to(sketch[i], (len(part), SAMPLE)), other[part]) >= least
                for j in part[like].tolist():
                    link(i, j)
    a, b = zip(*out, strict=True) if out else ((), ())
    return pa.table({"a": pa.array(ids[list(a)] if a else [], pa.int64()), "b": pa.array(ids[list(b)] if b else [], pa.int64())})


def _in_groups(rows: DataFrame, key: list[Column], per_group: int) -> DataFrame:
    """`rows` with a column `group`: rows of one key share a group, and groups hold about `per_group` rows."""
    groups = max(4 * shuffle_width(rows.sparkSession), rows.count() // per_group + 1)
    return rows.withColumn("group", F.pmod(F.xxhash64(*key), F.lit(groups)))


def candidate_links(
    sets: DataFrame, threshold: float, least: float, bucket_limit: int, block_limit: int, depth: int, per_group: int
) -> DataFrame:
    """Links (a, b) that connect all pairs of sets which met in a bucket and whose sketches are similar enough.

    `sets` has one row per node. Buckets above `bucket_limit` go one step deeper, up to `depth` steps. What is still larger
    then are near copies, which cost little more than a comparison per member (see `bucket_links`); above `block_limit`
    they are cut into blocks, and every two blocks meet in a bucket of their own.
    """
    sketches = sets.select("node", "sketch")
    rows = sets.select(F.explode("paths").alias("path"), "node").distinct()
    ready = []
    for step in range(1, depth + 1):
        rows = materialise(rows, "paths")
        sizes = rows.groupBy("path").agg(F.count("*").alias("m")).filter("m > 1")
        met = rows.join(sizes, "path")
        if step < depth:
            ready.append(met.filter(F.col("m") <= bucket_limit).select("path", "node"))
            large = met.filter(F.col("m") > bucket_limit).join(sketches, "node")
            rows = deeper(large, threshold).distinct()
            continue
        blocks = F.ceil(F.col("m") / block_limit).cast("int")
        own = F.pmod(F.xxhash64("node"), blocks).cast("int")
        cut = met.withColumns({"blocks": blocks, "own": own}).withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        cell = F.xxhash64("path", F.least("own", "with"), F.greatest("own", "with"))
        ready.append(cut.select(F.when(F.col("blocks") > 1, cell).otherwise(F.col("path")).alias("path"), "node"))
    every = ready[0]
    for more in ready[1:]:
        every = every.unionByName(more)
    full = materialise(every, "buckets").join(sketches, "node")
    grouped = _in_groups(materialise(full, "buckets"), [F.col("path")], per_group)
    return grouped.groupBy("group").applyInArrow(lambda t: bucket_links(t, least), "a long, b long")


def exact_links(table: pa.Table, threshold: float, width: int) -> pa.Table:
    """(node, links, other) of the cells in the table: how much weight of other sets each set links with, and links that
    connect the same sets (then `other` is set and `links` is 0)."""
    out: list[tuple[int, int, int | None]] = []
    table = table.combine_chunks().sort_by([("cell", "ascending"), ("node", "ascending")])
    cell, node = table["cell"].to_numpy(), table["node"].to_numpy()
    keep = np.ones(len(cell), dtype=bool)
    keep[1:] = (cell[1:] != cell[:-1]) | (node[1:] != node[:-1])  # a repeated row of the chosen document
    table = table.filter(pa.array(keep)).combine_chunks()
    cell = table["cell"].to_numpy()
    starts = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]])).tolist() if len(cell) else []
    for s, e in zip(starts, [*starts[1:], len(cell)], strict=True):
        _cell_links(table.slice(s, e - s), threshold, width, out)
    columns = list(zip(*out, strict=True)) if out else [[], [], []]
    return pa.table(dict(zip(["node", "links", "other"], [pa.array(c, pa.int64()) for c in columns], strict=True)))


def _cell_links(part: pa.Table, threshold: float, width: int, out: list) -> None:
    node, weight, own = (part[c].to_pylist() for c in ("node", "copies", "own"))
    same_block = part["i"][0].as_py() == part["j"][0].as_py()
    owners, values = [], []
    for a, _, t in text_runs(part["text"]):
        owner, value = shingles(t, width)
        owners.append(owner + a)
        values.append(value)
    owner, value = np.concatenate(owners), np.concatenate(values)
    size = np.bincount(owner, minlength=len(node))
    number = np.unique(value, return_inverse=True)[1]
    cuts = np.concatenate([[0], np.cumsum(size)])
    mark, forest = np.zeros(int(number.max(initial=-1)) + 1, dtype=np.int32), Forest(len(node))
    block, weights = np.array(own), np.array(weight)
    links = np.zeros(len(node), dtype=np.int64)
    for i in range(len(node)):
        mine = number[cuts[i] : cuts[i + 1]]
        mark[mine] = 1
        low = cuts[i + 1]
        common = np.zeros(len(node), dtype=np.int64)
        if low < len(number):
            common[i + 1 :] = np.add.reduceat(np.append(mark[number[low:]], 0), np.minimum(cuts[i + 1 : -1] - low, len(number) - low))
        mark[mine] = 0
        union = size[i] + size - common
        like = (common > 0) & (common >= threshold * union - 1e-9) & (size > 0)
        if not same_block:
            like &= block != block[i]
        for j in np.flatnonzero(like).tolist():
            links[i] += weights[j]
            links[j] += weights[i]
            if forest.join(i, j):
                out.append((node[i], 0, node[j]))
    out.extend((node[i], int(n), None) for i, n in enumerate(links.tolist()) if n)


def jaccard_classes(
    docs: DataFrame,
    threshold: float = 0.8,
    width: int = 5,
    recall: float = 0.9999,
    depth: int = 3,
    bucket_limit: int = 256,
    block_limit: int = 4096,
    slack: float = 0.2,
    per_group: int = 4_000,
) -> DataFrame:
    """(doc_id, fp, class_id, n_links, copies, kept) of each document: the classes of the join "Jaccard >= threshold".

    1. Each text becomes its set of `width`-word shingles; texts with equal sets are one node with a number of copies.
    2. Chosen paths: in every run each node chooses about 1 / threshold of its tokens by hash, the same hash for all, and
       goes into a bucket per chosen token. Buckets above `bucket_limit` are split again by tokens chosen for that path.
       Small buckets are compared by sketch, `slack` below the threshold. `runs_needed` repeats until the target recall.
    3. The links found connect nodes into candidate components. Inside each, all sets are compared exactly, in cells of two
       blocks of at most 256 sets, so a link that every run missed is still found if both ends are connected otherwise,
       and each pair counts once. Cells return a count per set and connecting links, never pairs.
    4. Components of the exact links are the classes; class_id is the smallest doc_id, n_links the number of other
       documents (copies included) at or above the threshold, kept is true for one document of each class.

    Nothing is dropped: buckets above the limit at the last step and large components are cut into blocks that all meet.
    A text with one to four words is one shingle of all its words. No words (null, empty): links with nothing, class_id is
    its own doc_id, kept. Null doc_id: takes part, sorts last, class_id null if no other is in its class. Repeated rows:
    copies of each other, all rows returned, kept is equal on rows alike in doc_id and text. `fp` is xxhash64(text). Nodes
    are 64-bit digests of sets. Empty table: no rows. Other columns are not read.
    """
    runs = runs_needed(recall, depth)
    rows = materialise(token_sets(docs, width, threshold, runs), "sets")
    first = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "fp")
    with_words = rows.filter("n > 0")
    nodes = with_words.groupBy("node").agg(
        F.count("*").alias("copies"), F.min(first).alias("first"), F.any_value("sketch").alias("sketch"), F.any_value("paths").alias("paths")
    )
    nodes = materialise(nodes, "nodes")
    near = materialise(candidate_links(nodes, threshold, threshold - slack, bucket_limit, block_limit, depth, per_group), "near")
    together = components(near)
    sizes = together.groupBy("component").agg(F.count("*").alias("m"))
    members = (
        together.withColumnRenamed("id", "node")
        .join(sizes, "component")
        .join(nodes.select("node", "copies", "first"), "node")
        .withColumn("blocks", F.ceil(F.col("m") / 256).cast("int"))
        .withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
        .select("component", "node", "copies", "blocks", "own", "first.doc_id", "first.fp")
    )
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("fp"))
    on = texts["doc_id"].eqNullSafe(members["doc_id"]) & (texts["fp"] == members["fp"])
    held = texts.join(members, on).select("component", "node", "copies", "blocks", "own", "text")
    cells = held.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumns(
        {"i": F.least("own", "with"), "j": F.greatest("own", "with")}
    )
    cells = cells.withColumn("cell", F.xxhash64("component", "i", "j")).drop("component", "blocks", "with")
    groups = max(4 * shuffle_width(docs.sparkSession), together.count() // 500 + 1)
    found = (
        cells.withColumn("group", F.pmod(F.col("cell"), F.lit(groups)))
        .groupBy("group")
        .applyInArrow(lambda t: exact_links(t, threshold, width), "node long, links long, other long")
    )
    found = materialise(found, "exact")
    classes = components(found.filter("other IS NOT NULL").select(F.col("node").alias("a"), F.col("other").alias("b")))
    links = found.filter("other IS NULL").groupBy("node").agg(F.sum("links").alias("links"))
    node_class = (
        nodes.select("node", "copies", "first")
        .join(links, "node", "left")
        .join(classes.withColumnRenamed("id", "node"), "node", "left")
        .withColumn("component", F.coalesce("component", "node"))
    )
    best = node_class.groupBy("component").agg(F.min("first").alias("best"))
    node_class = node_class.join(best, "component").select("node", "copies", "links", "best")
    decided = rows.select("doc_id", "fp", F.when(F.col("n") > 0, F.col("node")).alias("node")).join(node_class, "node", "left")
    own = F.col("best.doc_id").eqNullSafe(F.col("doc_id")) & (F.col("best.fp") == F.col("fp"))
    alone = F.col("best").isNull()
    return decided.select(
        "doc_id",
        "fp",
        F.when(alone, F.col("doc_id")).otherwise(F.col("best.doc_id")).alias("class_id"),
        F.when(alone, 0).otherwise(F.coalesce("links", F.lit(0)) + F.col("copies") - 1).cast("long").alias("n_links"),
        F.coalesce("copies", F.lit(1)).alias("copies"),
        (alone | own).alias("kept"),
    )


def without_near_copies(docs: DataFrame, **parameters) -> DataFrame:
    """`docs` with one document of each class; rows alike in doc_id and text count once. The columns stay."""
    kept = jaccard_classes(docs, **parameters).filter("kept").select("doc_id", "fp").distinct()
    kept = materialise(kept, "kept").select(F.col("doc_id").alias("_id"), F.col("fp").alias("_fp"))
    rows = docs.select(
        F.struct(*docs.columns).alias("row"), F.col("doc_id").cast("long").alias("_doc"), F.xxhash64("text").alias("_fp")
    )
    # The digest leads: a table without any doc_id is then still dealt evenly.
    joined = rows.join(kept, (rows["_fp"] == kept["_fp"]) & rows["_doc"].eqNullSafe(kept["_id"]), "left_semi")
    one = F.row_number().over(W.partitionBy("_fp", "_doc").orderBy(F.lit(0)))
    return joined.withColumn("_n", one).filter("_n = 1").select("row.*")
