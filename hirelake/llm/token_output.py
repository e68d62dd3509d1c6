"""Packed token-id files: best-fit-decreasing with a segment tree, cumulative segment lengths, position resets."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hirelake.llm.common import per_worker
from hirelake.llm.encode import BpeEncoder, text_runs
from hirelake.llm.packing import cut_points

ROWS = (
    "sequence_id long, n_tokens int, ids array<int>, cu_seqlens array<int>, position_resets array<int>, "
    "doc_ids array<long>, pieces array<int>, starts array<long>"
)


class CapacityTree:
    """Segment tree over free capacities: how many open bins have each, and the smallest one at or above a need."""

    def __init__(self, capacity: int):
        self.leaves = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.leaves)

    def add(self, free: int, by: int) -> None:
        node = self.leaves + free
        while node:
            self.count[node] += by
            node >>= 1

    def smallest(self, need: int) -> int:
        """-1 where no bin has that much room."""
        count, node = self.count, self.leaves + need
        if count[node]:
            return need
        while node > 1:
            if not node & 1 and count[node + 1]:
                node += 1
                while node < self.leaves:
                    node = 2 * node if count[2 * node] else 2 * node + 1
                return node - self.leaves
            node >>= 1
        return -1


def best_fit_decreasing(lengths: list[int], capacity: int) -> list[list[int]]:
    """Item numbers of each bin, longest first, each into the fullest bin that takes it."""
    tree, at, bins = CapacityTree(capacity), {}, []
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        free = tree.smallest(lengths[i])
        if free < 0:
            free, where = capacity, len(bins)
            bins.append([])
        else:
            where = at[free].pop()
            tree.add(free, -1)
        bins[where].append(i)
        free -= lengths[i]
        if free:
            at.setdefault(free, []).append(where)
            tree.add(free, 1)
    return bins


def packed_sequences(
    docs: DataFrame, tokenizer: str, size: int = 2048, pad_id: int = 0, window_tokens: int = 4_000_000
) -> DataFrame:
    """Rows of exactly `size` ids: a table of them is the id matrix.

    Each task packs its own documents in windows of `window_tokens`, so nothing is shuffled and memory is bounded; a
    window leaves about one unfilled row. Segment k of a row spans cu_seqlens[k] to cu_seqlens[k + 1] and is piece
    pieces[k] of document doc_ids[k], from its id starts[k] on; positions restart at 0 at each of position_resets, and ids
    after n_tokens are padding. Documents longer than `size` are cut into whole pieces, the odd one first; nothing is
    lost: concatenating a document's pieces gives its ids and the closing id 0 (see `unpacked`).

    Null text: one segment, the closing id. Null doc_id: kept. Repeated rows: each is packed. Empty table: no rows.
    Other columns are not read.
    """

    def close(pieces: list[tuple], first: int) -> pa.RecordBatch:
        bins = best_fit_decreasing([len(p[3]) // 4 for p in pieces], size)
        own = [pieces[i] for items in bins for i in items]
        matrix = np.full((len(bins), size), pad_id, dtype=np.int32)
        lengths = np.array([len(p[3]) // 4 for p in own])
        segments = np.cumsum([0, *map(len, bins)])
        used = np.add.reduceat(lengths, segments[:-1])
        at = 0
        for row, n, items in zip(matrix, used.tolist(), bins, strict=True):
            row[:n] = np.frombuffer(b"".join([p[3] for p in own[at : at + len(items)]]), dtype="<u4")
            at += len(items)
        # Where a segment begins in its row; a row's bounds are these and its number of tokens.
        begins = np.cumsum(lengths) - lengths - np.repeat(np.cumsum(used) - used, np.diff(segments))
        bounds = np.insert(begins, segments[1:], used)
        lists = lambda values, ends, kind: pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values, kind))
        columns = [
            pa.array(np.arange(first, first + len(bins))), pa.array(used, pa.int32()),
            lists(matrix.reshape(-1), np.arange(len(bins) + 1) * size, pa.int32()),
            lists(bounds, segments + np.arange(len(bins) + 1), pa.int32()), lists(begins, segments, pa.int32()),
            *[lists([p[k] for p in own], segments, kind) for k, kind in enumerate((pa.int64(), pa.int32(), pa.int64()))],
        ]
        return pa.record_batch(columns, names=[x.split()[0] for x in ROWS.split(", ")])

    def run(batches):
        encoder, pieces, held = per_worker("bpe", tokenizer, lambda: BpeEncoder(tokenizer)), [], 0
        first = TaskContext.get().partitionId() << 36
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for a, b in text_runs(texts):
                for doc, data in zip(ids[a:b], encoder.encode([t or "" for t in texts[a:b]]), strict=True):
                    data += b"\0\0\0\0"
                    for k, (start, n) in enumerate(cut_points(len(data) // 4, size)):
                        pieces.append((doc, k, start, data[4 * start : 4 * (start + n)]))
                    held += len(data) // 4
                    if held >= window_tokens:
                        yield (done := close(pieces, first))
                        first, pieces, held = first + done.num_rows, [], 0
        if pieces:
            yield close(pieces, first)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, ROWS)


def write_token_files(docs: DataFrame, path: str, tokenizer: str, **options) -> None:
    """The packed rows as Parquet files under `path`, one file per task, each an id matrix with its bounds."""
    packed_sequences(docs, tokenizer, **options).write.option("compression", "zstd").parquet(path)


def unpacked(rows: DataFrame) -> DataFrame:
    """(doc_id, piece, start, ids, positions) of every segment: the exact inverse of packing."""
    each = F.explode(F.arrays_zip("doc_ids", "pieces", "starts", "position_resets", F.slice("cu_seqlens", 2, F.size("doc_ids"))))
    parts = rows.select("ids", each.alias("s"))
    begin, end = F.col("s.position_resets"), F.col("s.4")
    return parts.select(
        F.col("s.doc_ids").alias("doc_id"), F.col("s.pieces").alias("piece"), F.col("s.starts").alias("start"),
        F.slice("ids", begin + 1, end - begin).alias("ids"), F.sequence(F.lit(0), end - begin - 1).alias("positions"),
    )
