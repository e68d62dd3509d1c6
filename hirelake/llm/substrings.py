"""Substring dedup: fixed blocks as anchors, rolling probes, hits extended to maximal exact repeats."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hirelake.llm.common import shuffle_width
from hirelake.llm.words import Spans, TextRun, grams, inside, mix, text_runs

KEPT = ["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"]
SETS = "bucket int, chunk long, keys binary"
#: Bytes of a probe's key: 38 bits of hash and two flags; the bucket number adds its own bits.
PROBE_BYTES = 5
BLOCK, MANY = 1, 2


def block_starts(s: Spans, block: int) -> np.ndarray:
    """True where a position is a multiple of `block` words from the start of its document."""
    return (np.arange(len(s.begin)) - np.repeat(s.first, s.count)) % block == 0


def _packed(values: np.ndarray, width: int) -> np.ndarray:
    """The low `width` bytes of each number, as rows of bytes."""
    return np.ascontiguousarray(values.astype("<u8")).view(np.uint8).reshape(-1, 8)[:, :width]


def _unpacked(data: bytes, width: int) -> np.ndarray:
    rows = np.frombuffer(data, np.uint8).reshape(-1, width)
    out = np.zeros((len(rows), 8), np.uint8)
    out[:, :width] = rows
    return out.view("<u8").ravel()


def _by_bucket(chunk: int, bucket: np.ndarray, rows: np.ndarray) -> pa.Table:
    """One table row per bucket, holding its rows of bytes end to end."""
    order = np.argsort(bucket, kind="stable")
    bucket, rows = bucket[order], rows[order]
    cuts = np.flatnonzero(np.diff(bucket)) + 1
    parts = np.split(rows, cuts) if len(rows) else []
    names = bucket[np.concatenate([[0], cuts])] if len(rows) else bucket
    return pa.table(
        {
            "bucket": pa.array(names, pa.int32()),
            "chunk": pa.array(np.full(len(parts), chunk), pa.int64()),
            "keys": pa.array([p.tobytes() for p in parts], pa.binary()),
        }
    )


def _repeated(many: np.ndarray, *keys: np.ndarray) -> np.ndarray:
    """Which entries have a key that occurs twice or more over all entries; `many` marks those that do so in their own
    chunk."""
    order = np.lexsort(keys)
    same = _same_as_next(order, *keys)
    hit = many[order].copy()
    hit[1:] |= same
    hit[:-1] |= same
    out = np.empty(len(many), dtype=bool)
    out[order] = hit
    return out


def _same_as_next(order: np.ndarray, *keys: np.ndarray) -> np.ndarray:
    return np.logical_and.reduce([k[order][1:] == k[order][:-1] for k in keys])


def _long_rows(pairs: np.ndarray, many: np.ndarray) -> np.ndarray:
    """12 bytes of each window: 64 bits of its first hash, 31 of its second and the flag."""
    second = (pairs[:, 1] & np.uint64(0xFFFFFFFE)) | many.astype(np.uint64)
    return np.concatenate([_packed(pairs[:, 0], 8), _packed(second, 4)], axis=1)


def _long_columns(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return _unpacked(rows[:, :8].tobytes(), 8), _unpacked(rows[:, 8:].tobytes(), 4)


class Windows:
    """What one run of documents has at each word position."""

    def __init__(self, run: TextRun, window: int, block: int):
        self.words = run.words()
        self.hashes = run.hashes(self.words)
        n = len(self.hashes)
        self.window, self.block = window, block
        self.probe_at = np.flatnonzero(inside(self.words, block))
        self.probes = grams(self.hashes, block)
        self.is_block = block_starts(self.words, block)
        self.whole = inside(self.words, window)
        self.n = n

    def candidates(self, known: np.ndarray) -> np.ndarray:
        """Starts of windows whose one whole block has its hash among `known` (sorted): no other can be a repeat."""
        at = np.flatnonzero(self.whole)
        if not len(at) or not len(known):
            return at[:0]
        from_start = at - np.repeat(self.words.first, self.words.count)[at]
        anchor = at + (-from_start) % self.block
        key = probe_key(self.probes[anchor])
        i = np.minimum(np.searchsorted(known, key), len(known) - 1)
        return at[known[i] == key]

    def long_hashes(self, at: np.ndarray) -> np.ndarray:
        """Two 64-bit hashes of each window at `at`."""
        if not len(at):
            return np.zeros((0, 2), np.uint64)
        return np.stack([grams(self.hashes, self.window, 1)[at], grams(mix(self.hashes, 21), self.window, 2)[at]], axis=1)


def probe_key(h: np.ndarray) -> np.ndarray:
    """The part of a probe's hash that is kept, above two bits for flags."""
    return (h & np.uint64((1 << (8 * PROBE_BYTES - 2)) - 1)) << np.uint64(2)


def bucket_of(h: np.ndarray, buckets: int) -> np.ndarray:
    """From the bits that `probe_key` leaves out."""
    return ((h >> np.uint64(40)) % np.uint64(buckets)).astype(np.int64)


def _chunk_of(table: pa.Table) -> int:
    return table["chunk"][0].as_py()


def repeated_passages_removed(
    docs: DataFrame,
    window: int = 35,
    chunk_characters: int = 4_000_000,
    bucket_probes: int = 4_000_000,
) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256, kept_text): every word goes that a repeated window covers.

    A window is `window` consecutive words of one document; it is a repeat when the same words also start anywhere else,
    in any document or the same. All windows are judged on the input. Blocks are the non-overlapping runs of
    (window + 1) / 2 words from each document's start: every window holds exactly one whole.

    1. Index and probe. Documents are dealt by hash into chunks. Each chunk sends every rolling probe (the hash of each
       run of a block's length) once, with flags for "is a block here" and "more than once here", packed by bucket of
       the hash. A bucket finds the probes that occur twice or more anywhere and tells each chunk which of its blocks do.
    2. Extend. A window is a candidate if its block was hit. Chunks send 95-bit hashes of their candidates, once each,
       and buckets find those that occur twice or more. Neighbouring ones make the maximal repeats.
    3. Remove. Chunks get 64 bits of their repeated windows back and drop the words that these cover.

    A passage that many documents share costs a bucket one entry per chunk, never a pair; a hit is confirmed by 95 bits
    of the whole window. The number of chunks and buckets follows the length of all texts, so none of them grows; their
    rows carry many hashes each. The text is shuffled once: all three steps read the same exchange.

    Null text: no words. Documents shorter than a window: kept whole. Empty: the digest of nothing. Null doc_id: kept.
    Repeated rows: each other's repeats. Empty table: no rows. Other columns are not read.
    """
    block = (window + 1) // 2
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    total = texts.agg(F.sum(F.length("text"))).first()[0] or 0
    chunks = max(shuffle_width(spark), total // chunk_characters + 1)
    buckets = max(shuffle_width(spark), total // (5 * bucket_probes) + 1)
    dealt = texts.withColumn("chunk", F.pmod(F.xxhash64("doc_id", F.length("text")), F.lit(chunks)))

    def probes(table: pa.Table) -> pa.Table:
        kept = []
        for _, _, run in text_runs(table["text"]):
            w = Windows(run, window, block)
            h = w.probes[w.probe_at]
            kept.append((h, w.is_block[w.probe_at]))
        h, is_block = (np.concatenate(x) for x in zip(*kept, strict=True)) if kept else (np.zeros(0, np.uint64), np.zeros(0, bool))
        order = np.argsort(h, kind="stable")
        h, is_block = h[order], is_block[order]
        starts = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, np.int64)
        flags = np.logical_or.reduceat(is_block, starts).astype(np.uint64) * np.uint64(BLOCK) if len(h) else h
        flags = flags + (np.diff(np.append(starts, len(h))) > 1).astype(np.uint64) * np.uint64(MANY)
        h = h[starts]
        return _by_bucket(_chunk_of(table), bucket_of(h, buckets), _packed(probe_key(h) | flags, PROBE_BYTES))

    def hit_blocks(table: pa.Table) -> pa.Table:
        keys = [_unpacked(k, PROBE_BYTES) for k in table["keys"].to_pylist()]
        flat = np.concatenate(keys)
        hit = _repeated((flat & np.uint64(MANY)) > 0, flat >> np.uint64(2)) & ((flat & np.uint64(BLOCK)) > 0)
        out = [_packed(k[m] & ~np.uint64(3), PROBE_BYTES).tobytes() for k, m in _split(keys, hit)]
        return _answers(table, out)

    def long_probes(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return _by_bucket(0, np.zeros(0, np.int64), np.zeros((0, 12), np.uint8))
        known = np.sort(_unpacked(b"".join(right["keys"].to_pylist()), PROBE_BYTES))
        found = []
        for _, _, run in text_runs(left["text"]):
            w = Windows(run, window, block)
            found.append(w.long_hashes(w.candidates(known)))
        pairs = np.concatenate(found)
        order = np.lexsort((pairs[:, 1], pairs[:, 0]))
        first = np.concatenate([[True], ~_same_as_next(order, pairs[:, 0], pairs[:, 1])])[: len(order)]
        starts = np.flatnonzero(first)
        once = pairs[order[starts]]
        many = np.diff(np.append(starts, len(order))) > 1
        return _by_bucket(_chunk_of(left), (once[:, 0] % np.uint64(buckets)).astype(np.int64), _long_rows(once, many))

    def repeated_windows(table: pa.Table) -> pa.Table:
        rows = [np.frombuffer(k, np.uint8).reshape(-1, 12) for k in table["keys"].to_pylist()]
        first, second = _long_columns(np.concatenate(rows))
        hit = _repeated((second & np.uint64(1)) > 0, first, second >> np.uint64(1))
        out = [r[m][:, :8].tobytes() for r, m in _split(rows, hit)]
        return _answers(table, out)

    def removed(left: pa.Table, right: pa.Table) -> pa.Table:
        known = np.sort(_unpacked(b"".join(right["keys"].to_pylist()), 8))
        ids, texts, out = left["doc_id"].to_pylist(), left["text"].to_pylist(), []
        for a, b, run in text_runs(left["text"]):
            w = Windows(run, window, block)
            drop = np.zeros(w.n, dtype=bool)
            if len(known):
                at = np.flatnonzero(w.whole)
                key = grams(w.hashes, window, 1)[at]
                edge = np.zeros(w.n + 1, dtype=np.int64)
                hits = at[known[np.minimum(np.searchsorted(known, key), len(known) - 1)] == key]
                edge[hits] += 1
                edge[hits + window] -= 1
                drop = np.cumsum(edge)[: w.n] > 0
            for k in range(b - a):
                gone = drop[w.words.first[k] : w.words.last[k]]
                words = texts[a + k].encode().split()
                if gone.any():
                    words = [x for x, g in zip(words, gone.tolist(), strict=True) if not g]
                kept = b" ".join(words)
                out.append((ids[a + k], len(gone), int(gone.sum()), hashlib.sha256(kept).hexdigest(), kept.decode()))
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        columns = list(zip(*out, strict=True)) if out else [[]] * 5
        return pa.table(dict(zip(KEPT, [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], strict=True)))

    hits = dealt.groupBy("chunk").applyInArrow(probes, SETS).groupBy("bucket").applyInArrow(hit_blocks, "chunk long, keys binary")
    by_chunk = dealt.groupBy("chunk")
    longer = by_chunk.cogroup(hits.groupBy("chunk")).applyInArrow(long_probes, SETS)
    repeats = longer.groupBy("bucket").applyInArrow(repeated_windows, "chunk long, keys binary")
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string"
    return by_chunk.cogroup(repeats.groupBy("chunk")).applyInArrow(removed, schema)


def _split(parts: list[np.ndarray], mask: np.ndarray):
    """Each part with its own stretch of `mask`."""
    at = 0
    for p in parts:
        yield p, mask[at : at + len(p)]
        at += len(p)


def _answers(table: pa.Table, keys: list[bytes]) -> pa.Table:
    """Back to each chunk what it is to know, where there is anything."""
    rows = [(c, k) for c, k in zip(table["chunk"].to_pylist(), keys, strict=True) if k]
    return pa.table({"chunk": pa.array([c for c, _ in rows], pa.int64()), "keys": pa.array([k for _, k in rows], pa.binary())})
