"""Two tokenizers over the same bytes: common ends, overlapping tokens and how often each pair of ids overlaps."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hirelake.llm.common import materialise, per_worker
from hirelake.llm.encode import BpeEncoder, text_runs

#: A document's place in its run stands above the byte offset in a document-end key.
PLACE = 40
LINKED = (
    "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, chunk long, low binary, high binary, "
    "times binary, many binary, pairs array<long>, counts array<long>"
)
ALIGNED = (
    "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
)


class TwoEncoders:
    """Ids of blank + text by a byte-level BPE file (A) and of the text by a sentencepiece model (B).

    Neither joins what a single blank or newline parts, so texts of words parted so are put together from a bounded cache
    of word ids; all other texts are encoded whole. Strings of special tokens are ordinary text.
    """

    def __init__(self, bpe_file: str, piece_model: str, cache_words: int = 150_000):
        import sentencepiece

        self.a = BpeEncoder(bpe_file)
        if self.a.merges is None:
            raise ValueError("not a byte-level BPE file")
        self.a.whole.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=piece_model)
        self.length_a = self.a.length_of
        sp = self.b
        self.bytes_b = [
            bytes([int(p[3:5], 16)]) if sp.is_byte(i) else p.replace("▁", " ").encode()
            for i, p in ((i, sp.id_to_piece(i)) for i in range(sp.vocab_size()))
        ]
        self.length_b = np.array([len(x) for x in self.bytes_b], dtype=np.int64)
        self.cache_words = cache_words
        self.after_blank: dict[str, tuple[bytes, bytes] | None] = {}
        self.after_line: dict[str, tuple[bytes, bytes] | None] = {}

    def _learn(self, words: set[str], cache: dict, lead: str) -> None:
        plain = [w for w in words if w and not w[0].isspace() and not w[-1].isspace()]
        cache.update(dict.fromkeys(words))
        if not plain:
            return
        text = lead.join(["", *plain])
        a = self.a.merges.encode_ordinary(text)
        # The model puts a blank before a text, which is the first word's own unless a newline comes first.
        b = self.b.encode(text[1:] if lead == " " else text, num_threads=1)[lead != " " :]
        if b"".join([self.bytes_b[i] for i in b]) != text.encode():
            if len(plain) > 1:
                half = len(plain) // 2
                self._learn(set(plain[:half]), cache, lead)
                self._learn(set(plain[half:]), cache, lead)
            return
        ends = np.cumsum([len(w.encode()) + 1 for w in plain])
        parts = []
        for ids, lengths in ((np.array(a, "<u4"), self.length_a), (np.array(b, "<u4"), self.length_b)):
            cut = 4 * (np.searchsorted(np.cumsum(lengths[ids]), ends) + 1)
            data = ids.tobytes()
            parts.append([data[i:j] for i, j in zip([0, *cut.tolist()], cut.tolist(), strict=False)])
        cache.update(zip(plain, zip(*parts, strict=True), strict=True))

    def _whole(self, text: str) -> tuple[bytes, bytes]:
        wanted, b = (" " + text).encode(), self.b.encode(text, num_threads=1)
        a = self.a.whole.encode(" " + text, add_special_tokens=False).ids
        if b"".join([self.bytes_b[i] for i in b]) != wanted or self.length_a[a].sum() != len(wanted):
            return b"", b""
        return np.array(a, "<u4").tobytes(), np.array(b, "<u4").tobytes()

    def encode(self, texts: list[str]) -> list[tuple[bytes, bytes]]:
        """No ids for empty texts and for those whose tokens' bytes are not blank + text."""
        lines = [[line.split(" ") for line in t.split("\n")] for t in texts]
        blank, line = self.after_blank, self.after_line
        if len(blank) + len(line) > self.cache_words:
            blank.clear()
            line.clear()
        new = {w for t in lines for ws in t for w in ws[1:] if w not in blank} | {t[0][0] for t in lines if t[0][0] not in blank}
        self._learn(new, blank, " ")
        self._learn({ws[0] for t in lines for ws in t[1:] if ws[0] not in line}, line, "\n")
        out = []
        for text, rows in zip(texts, lines, strict=True):
            try:
                units = [blank[w] for w in rows[0]]
                for ws in rows[1:]:
                    units.append(line[ws[0]])
                    units += [blank[w] for w in ws[1:]]
                out.append((b"".join([u[0] for u in units]), b"".join([u[1] for u in units])))
            except TypeError:  # an odd word
                out.append(self._whole(text) if text else (b"", b""))
        return out


def id_lists(parts: list[bytes]) -> pa.ListArray:
    bounds = np.cumsum([0, *[len(p) // 4 for p in parts]])
    return pa.LargeListArray.from_arrays(pa.array(bounds, pa.int64()), pa.array(np.frombuffer(b"".join(parts), "<u4").astype(np.int64)))


def ends(ids: pa.ListArray, lengths: np.ndarray, name: str) -> pa.Table:
    """Document-end keys: the place of each token's document and the byte at which the token ends in it."""
    flat, parent = pc.list_flatten(ids), pc.list_parent_indices(ids)
    size = pc.take(pa.array(lengths), flat)
    total = pc.cumulative_sum(size)
    # Segmented: less the running total before the document's first token.
    lists = pc.list_value_length(ids).to_numpy(zero_copy_only=False)
    first = np.cumsum(lists) - lists
    before = np.concatenate([[0], total.to_numpy()])[first]
    end = pc.subtract(total, pc.take(pa.array(before), parent))
    return pa.table({"key": pc.bit_wise_or(pc.shift_left(parent, PLACE), end), name: flat})


class Alignment:
    """Links and groups of a run of documents.

    The ends of both tokenizers cut the bytes into stretches; each stretch lies in one A and one B token and is one link, as
    two tokens overlap in one stretch only. Ends that both share close a group.
    """

    def __init__(self, a: pa.ListArray, b: pa.ListArray, length_a: np.ndarray, length_b: np.ndarray):
        self.n_docs = len(a)
        met = ends(a, length_a, "a").join(ends(b, length_b, "b"), "key", join_type="full outer", use_threads=False)
        met = met.sort_by("key").combine_chunks()
        own_a, own_b = (met.column(c).combine_chunks() for c in "ab")
        self.ends_a, self.ends_b = (pc.is_valid(c).to_numpy(zero_copy_only=False) for c in (own_a, own_b))
        self.common = self.ends_a & self.ends_b
        # A stretch belongs to the next token that ends; both end with the document, so this never leaves it.
        self.id_a, self.id_b = (pc.fill_null_backward(c).to_numpy() for c in (own_a, own_b))
        self.parent = pc.shift_right(met.column("key").combine_chunks(), PLACE).to_numpy()

    def per_doc(self, flag: np.ndarray) -> np.ndarray:
        return np.bincount(self.parent[flag], minlength=self.n_docs)

    def links(self) -> pa.Table:
        """(doc, pair, n) with the B id above the A id in `pair`."""
        pair = self.id_b << 32 | self.id_a
        met = pa.table({"doc": self.parent, "pair": pair})
        return met.group_by(["doc", "pair"], use_threads=False).aggregate([([], "count_all")]).rename_columns(["doc", "pair", "n"])

    def digests(self, texts: pa.Array, size_a: int) -> list[str]:
        """SHA-256 of `a,a|b;a|b,b` of each document; the empty text where there are no tokens.

        `texts` holds each A id with a comma and with a bar, then each B id with a comma and with a semicolon.
        """
        group = np.cumsum(self.common) - self.common
        upto_a, upto_b = np.cumsum(self.ends_a)[self.common], np.append(0, np.cumsum(self.ends_b)[self.common])
        at_a, at_b = np.flatnonzero(self.ends_a), np.flatnonzero(self.ends_b)
        codes = np.empty(len(at_a) + len(at_b), np.int64)
        codes[np.arange(len(at_a)) + upto_b[group[at_a]]] = 2 * self.id_a[at_a] + self.common[at_a]
        codes[np.arange(len(at_b)) + upto_a[group[at_b]]] = 2 * (size_a + self.id_b[at_b]) + self.common[at_b]
        said = pc.take(texts, pa.array(codes))
        bounds = np.frombuffer(said.buffers()[1], np.int64)[: len(codes) + 1]
        data = said.buffers()[2] or b""
        tokens = np.cumsum(np.append(0, self.per_doc(self.ends_a) + self.per_doc(self.ends_b)))
        at, view = bounds[tokens].tolist(), memoryview(data)
        return [hashlib.sha256(view[i : j - 1]).hexdigest() if j > i else "" for i, j in zip(at, at[1:], strict=False)]


def packed(values: np.ndarray, kind: str) -> tuple[bytes, bytes]:
    """Small numbers, the largest of which stands for the next of the large ones."""
    top = np.iinfo(kind).max
    return np.minimum(values, top).astype(kind).tobytes(), values[values >= top].astype("<u8").tobytes()


def unpacked(small: bytes, large: bytes, kind: str) -> np.ndarray:
    values = np.frombuffer(small, kind).astype(np.int64)
    values[values == np.iinfo(kind).max] = np.frombuffer(large, "<u8")
    return values


def _chunk(number: int, docs: list[tuple], links: pa.Table) -> pa.RecordBatch:
    """The rows of one chunk's documents and one row of its distinct pairs with partial counts, commonest first."""
    pairs = links.group_by("pair", use_threads=False).aggregate([("n", "sum")]).sort_by([("n_sum", "descending"), ("pair", "ascending")])
    place = pc.index_in(links.column("pair"), pairs.column("pair")).to_numpy()
    doc, n = links.column("doc").to_numpy(), links.column("n").to_numpy()
    order = np.lexsort((place, doc))
    place, n = place[order], n[order]
    bounds = np.searchsorted(doc[order], np.arange(len(docs) + 1)).tolist()
    rows = [
        (*d, number, *packed(place[i:j], "<u2"), *packed(n[i:j], "u1"), None, None)
        for d, i, j in zip(docs, bounds, bounds[1:], strict=False)
    ]
    rows.append((*[None] * 6, number, *[None] * 4, pairs.column("pair").to_pylist(), pairs.column("n_sum").to_pylist()))
    kinds = [pa.int64()] * 5 + [pa.string(), pa.int64()] + [pa.binary()] * 4 + [pa.list_(pa.int64())] * 2
    columns = zip(zip(*rows, strict=True), kinds, strict=True)
    return pa.record_batch([pa.array(c, k) for c, k in columns], names=[x.split()[0] for x in LINKED.split(", ")])


def linked_documents(docs: DataFrame, bpe_file: str, piece_model: str, chunk_chars: int = 4_000_000) -> DataFrame:
    """Every document's tokens, groups and links, and per chunk of consecutive documents its pairs with partial counts."""

    def run(batches):
        held, found, tables, chars = [], 0, [], 0
        encoders = per_worker("two", (bpe_file, piece_model), lambda: TwoEncoders(bpe_file, piece_model))
        size_a, size_b = len(encoders.length_a), len(encoders.length_b)
        texts = pa.array(
            [f"{i}{c}" for i in range(size_a) for c in ",|"] + [f"{i}{c}" for i in range(size_b) for c in ",;"], pa.large_string()
        )
        number = TaskContext.get().partitionId() << 33
        for batch in batches:
            ids, whole = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for i, j in text_runs(whole):
                both = encoders.encode([t or "" for t in whole[i:j]])
                a, b = id_lists([x for x, _ in both]), id_lists([y for _, y in both])
                run = Alignment(a, b, encoders.length_a, encoders.length_b)
                columns = [run.per_doc(run.ends_a), run.per_doc(run.ends_b), run.per_doc(run.common), run.per_doc(run.parent >= 0)]
                held += zip(ids[i:j], *[c.tolist() for c in columns], run.digests(texts, size_a), strict=True)
                links = run.links()
                tables.append(links.set_column(0, "doc", pc.add(links.column("doc"), found)))
                found += j - i
                chars += sum(len(t or "") for t in whole[i:j])
                if chars >= chunk_chars:
                    yield _chunk(number, held, pa.concat_tables(tables))
                    number, held, found, tables, chars = number + 1, [], 0, [], 0
        if held:
            yield _chunk(number, held, pa.concat_tables(tables))

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, LINKED)


def _totals(docs: pa.Table, told: pa.Table) -> pa.Table:
    """Per document: links whose count is the highest of their B id, and the sum of the links' counts."""
    count, best = np.zeros(told.num_rows, np.int64), np.zeros(told.num_rows, np.int64)
    at = told.column("place").to_numpy()
    count[at], best[at] = told.column("n").to_numpy(), told.column("best").to_numpy(zero_copy_only=False)
    low, high, times, many = (docs.column(c).to_pylist() for c in ("low", "high", "times", "many"))
    n_best, total = [], []
    for a, b, c, d in zip(low, high, times, many, strict=True):
        place, n = unpacked(a, b, "<u2"), unpacked(c, d, "u1")
        n_best.append(int(n @ best[place]))
        total.append(int(n @ count[place]))
    names = [x.split()[0] for x in ALIGNED.split(", ")]
    added = {"n_best": pa.array(n_best, pa.int64()), "count_sum": pa.array(total, pa.int64())}
    return pa.table([added[c] if c in added else docs.column(c) for c in names], names=names)


def aligned_tokens(docs: DataFrame, bpe_file: str, piece_model: str, chunk_chars: int = 4_000_000) -> DataFrame:
    """How the tokens of two tokenizers lie over each other, per document, with corpus-wide counts of linked id pairs.

    Arrow batches do the work inside a task: lists of ids are flattened with their parent indices, byte lengths summed up
    by document, and the two sides' document-end keys joined; grouping gives partial counts per chunk of consecutive
    documents, which Spark merges. A pair travels once per chunk, however many documents hold it, so no pair is hot, and
    each chunk's counts come back to its documents. Documents are written once, without their texts, in between.

    Null or empty text, or one whose tokens do not spell blank + text: zeros and an empty digest, and no part in the
    counts. Null doc_id: kept. Repeated rows: each counts. Empty table: no rows. Other columns are not read.
    """
    rows = materialise(linked_documents(docs, bpe_file, piece_model, chunk_chars), "aligned")
    each = rows.filter("pairs IS NOT NULL").select("chunk", F.posexplode(F.arrays_zip("pairs", "counts")).alias("place", "p"))
    asked = each.select(
        F.col("chunk").alias("asker"), F.col("place").cast("long").alias("place"), F.col("p.pairs").alias("pair"), F.col("p.counts").alias("part")
    )
    counted = asked.groupBy("pair").agg(F.sum("part").alias("n"))
    highest = counted.groupBy(F.shiftright("pair", 32).alias("b")).agg(F.max("n").alias("top"))
    marked = counted.join(highest, F.shiftright("pair", 32) == F.col("b")).select("pair", "n", (F.col("n") == F.col("top")).alias("best"))
    told = asked.join(marked, "pair").select("asker", "place", "n", "best").groupBy("asker")
    whole = rows.filter("pairs IS NULL").drop("pairs", "counts").groupBy("chunk")
    return whole.cogroup(told).applyInArrow(lambda docs, told: _totals(docs, told), ALIGNED)
