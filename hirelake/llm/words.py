"""Words and word n-grams of whole Arrow batches as numpy arrays of 64-bit hashes."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

BASE = np.uint64(0x9E3779B97F4A7C15)
GRAM_BASE = np.uint64(0xD6E8FEB86659FD93)


def _inverse(x: int) -> int:
    return pow(x, -1, 1 << 64)


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """Spreads 64-bit numbers over all bits (the finaliser of splitmix64); one to one for a given salt."""
    x = x + np.uint64((salt * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) % (1 << 64))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: A random odd number for each byte, from a fixed start.
BYTE_VALUES = mix(np.arange(256, dtype=np.uint64), 1) | np.uint64(1)
WHITE = np.zeros(256, dtype=bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True
#: Letters, digits, underscore and all bytes of longer characters; the rest of what is not white counts as signs.
LETTER = np.zeros(256, dtype=bool)
LETTER[[*range(0x30, 0x3A), *range(0x41, 0x5B), 0x5F, *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


@dataclass
class Spans:
    """Stretches of bytes in document order: begin, end, and the first and last + 1 of each document."""

    begin: np.ndarray
    end: np.ndarray
    first: np.ndarray
    last: np.ndarray

    @property
    def count(self) -> np.ndarray:
        return self.last - self.first

    def owner(self) -> np.ndarray:
        """Number of the document of each stretch."""
        return np.repeat(np.arange(len(self.first)), self.count)


class TextRun:
    """Some documents' bytes in one array; `bounds` has one more entry than there are documents."""

    def __init__(self, data: np.ndarray, bounds: np.ndarray):
        self.data, self.bounds = data, bounds.astype(np.int64)
        n = len(data) + 1
        power = np.full(n, BASE, dtype=np.uint64)
        power[0] = 1
        back = np.full(n, np.uint64(_inverse(int(BASE))), dtype=np.uint64)
        back[0] = 1
        np.multiply.accumulate(power, out=power)
        np.multiply.accumulate(back, out=back)
        self.back = back
        self.prefix = np.zeros(n, dtype=np.uint64)
        np.cumsum(BYTE_VALUES[data] * power[:-1], out=self.prefix[1:])

    def __len__(self) -> int:
        return len(self.bounds) - 1

    def hashes(self, s: Spans) -> np.ndarray:
        """Equal stretches of bytes have equal hashes, wherever they stand."""
        return mix((self.prefix[s.end] - self.prefix[s.begin]) * self.back[s.begin], 2)

    def _spans(self, inside: np.ndarray, breaks: np.ndarray | None = None) -> Spans:
        """Maximal stretches of `inside`, parted at document bounds and at `breaks` (a stretch may begin there)."""
        n = len(self.data)
        opens = np.ones(n + 1, dtype=bool)
        opens[1:n] = ~inside[:-1]
        if breaks is not None:
            opens[:n] |= breaks
        opens[self.bounds] = True
        begin = np.flatnonzero(inside & opens[:n])
        closes = opens[1:].copy()
        closes[: n - 1] |= ~inside[1:]
        end = np.flatnonzero(inside & closes) + 1
        at = np.searchsorted(begin, self.bounds)
        return Spans(begin, end, at[:-1], at[1:])

    def words(self) -> Spans:
        return self._spans(~WHITE[self.data])

    def tokens(self) -> Spans:
        """Runs of letters and runs of signs."""
        letter = LETTER[self.data]
        turn = np.zeros(len(self.data), dtype=bool)
        turn[1:] = letter[1:] != letter[:-1]
        return self._spans(~WHITE[self.data], turn)

    def lines(self) -> Spans:
        """Newline-split lines that are not empty."""
        return self._spans(self.data != 0x0A)


def text_runs(column: pa.Array, limit: int = 1_000_000):
    """(from, to, TextRun) over the rows of a string column, about `limit` bytes at a time; null is empty.

    Only the run at hand has arrays of its own; a text above the limit makes a run alone.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    if len(column) == 0:
        return
    at = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    every = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    if column.null_count:  # the buffer may hold bytes under a null
        column = pa.array(column.to_pylist(), pa.large_string()).fill_null("")
        _, offsets, data = column.buffers()
        at = np.frombuffer(offsets, dtype=np.int64)[: len(column) + 1]
        every = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    a = 0
    while a < len(column):
        b = max(a + 1, int(np.searchsorted(at, at[a] + limit, side="right")) - 1)
        b = min(b, len(column))
        yield a, b, TextRun(every[at[a] : at[b]], at[a : b + 1] - at[a])
        a = b


def grams(hashes: np.ndarray, n: int, salt: int = 0) -> np.ndarray:
    """Hash of the n consecutive words from each position on; the last n - 1 positions are cut off.

    Windows may cross documents; see `inside`.
    """
    if len(hashes) < n:
        return np.zeros(0, np.uint64)
    base = (int(GRAM_BASE) * (2 * salt + 1)) % (1 << 64)
    # Sum of w[i + j] * base^j, doubled up: the window of a + b words is one of a and one of b.
    total, width, have, piece = np.zeros(len(hashes) - n + 1, np.uint64), 0, 1, hashes
    left = n
    while left:
        if left & 1:
            total = total + piece[width : width + len(total)] * np.uint64(pow(base, width, 1 << 64))
            width += have
        left >>= 1
        if left:
            piece = piece[: len(piece) - have] + piece[have:] * np.uint64(pow(base, have, 1 << 64))
            have *= 2
    return mix(total, 3 + salt)


def inside(s: Spans, n: int) -> np.ndarray:
    """Which of `grams`' positions have all n words in one document."""
    ends = np.repeat(s.last, s.count)
    at = np.arange(max(0, len(s.begin) - n + 1))
    return at + n <= ends[: len(at)]


def prefix_counts(flags: np.ndarray) -> np.ndarray:
    """Running totals with a leading 0, so that the sum over [a, b) is out[b] - out[a]."""
    out = np.zeros(len(flags) + 1, dtype=np.int64)
    np.cumsum(flags, out=out[1:])
    return out
