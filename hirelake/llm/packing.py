"""Best-fit packing of tokenised documents into sequences (bounded space, online)."""

from __future__ import annotations

import zlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hirelake.llm.common import materialise, per_worker
from hirelake.llm.encode import BpeEncoder, text_runs

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def cut_points(n: int, size: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids: whole pieces of `size`, the odd one first."""
    head = n % size
    bounds = [0, *range(head or size, n + 1, size)]
    return [(a, b - a) for a, b in zip(bounds, bounds[1:], strict=False)]


def token_pieces(docs: DataFrame, tokenizer: str, size: int = 2048) -> DataFrame:
    """One row per piece of at most `size` ids of each document: its ids, then id 0.

    A null text is empty, so every document has at least one piece. Only documents longer than `size` are cut.
    """

    def run(batches):
        encoder = per_worker("bpe", tokenizer, lambda: BpeEncoder(tokenizer))
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for a, b in text_runs(texts):
                rows = []
                for doc, data in zip(ids[a:b], encoder.encode([t or "" for t in texts[a:b]]), strict=True):
                    data += b"\0\0\0\0"
                    for k, (start, n) in enumerate(cut_points(len(data) // 4, size)):
                        rows.append((doc, k, start, n, zlib.crc32(data[4 * start : 4 * (start + n)])))
                columns = list(zip(*rows, strict=True))
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
                names = ["doc_id", "piece", "start", "length", "ids_crc32"]
                yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, PIECES)


def best_fit(lengths: list[int], capacity: int, open_bins: int) -> tuple[list[int], list[int]]:
    """(bin, offset) of each item in the order given, with at most `open_bins` bins open at any time.

    Bit f of one integer says that a bin with f free places is open. An item goes to the fullest bin that takes it: the
    lowest set bit at or above its length. Where none does, a new bin opens; if that is one too many, the fullest bin
    (the lowest set bit of all) closes for good.
    """
    free_bits, open_now, bins = 0, 0, 0
    at: list[list[int]] = [[] for _ in range(capacity + 1)]
    bin_of, offset_of = [], []
    for length in lengths:
        fits = free_bits >> length
        if fits:
            free = length + (fits & -fits).bit_length() - 1
            where = at[free].pop()
            if not at[free]:
                free_bits ^= 1 << free
            open_now -= 1
        else:
            if open_now == open_bins:
                fullest = (free_bits & -free_bits).bit_length() - 1
                at[fullest].pop()
                if not at[fullest]:
                    free_bits ^= 1 << fullest
                open_now -= 1
            where, free, bins = bins, capacity, bins + 1
        bin_of.append(where)
        offset_of.append(capacity - free)
        free -= length
        if free:
            at[free].append(where)
            free_bits |= 1 << free
            open_now += 1
    return bin_of, offset_of


def best_fit_packing(
    docs: DataFrame, tokenizer: str, size: int = 2048, open_bins: int = 16384, pieces_per_group: int = 50_000
) -> DataFrame:
    """Every piece of every document with its place: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Tokenising needs no shuffle; its rows are a few numbers per piece and are written once. Pieces are then dealt by hash
    into groups of about `pieces_per_group`, each packed by one task: the groups grow in number with the data, never in
    size, and each leaves at most its last bins unfilled. In a group the pieces arrive longest first, then by document and
    piece number: short ones then fill what long ones left, and reruns agree.

    Null text: one piece, the closing id. Null doc_id: kept. Repeated rows: each is packed. Empty table: no rows. Other
    columns are not read.
    """
    pieces = materialise(token_pieces(docs, tokenizer, size), "pieces")
    groups = max(1, -(-pieces.count() // pieces_per_group))

    def pack(table: pa.Table) -> pa.Table:
        table = table.select(["doc_id", "piece", "start", "length", "ids_crc32", "group"]).sort_by(
            [("length", "descending"), ("doc_id", "ascending"), ("piece", "ascending"), ("ids_crc32", "ascending")]
        )
        where, offset = best_fit(table["length"].to_pylist(), size, open_bins)
        first = (table["group"][0].as_py() if table.num_rows else 0) << 32
        table = table.drop_columns("group")
        table = table.append_column("sequence_id", pa.array([first + w for w in where], pa.int64()))
        return table.append_column("offset", pa.array(offset, pa.int64()))

    dealt = pieces.withColumn("group", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", F.monotonically_increasing_id()), F.lit(groups)))
    return dealt.groupBy("group").applyInArrow(pack, PIECES + ", sequence_id long, offset long")
