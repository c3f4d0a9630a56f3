"""Array views of text batches: bytes, words, lines and their 64-bit hashes, without a loop per word.

A batch of strings is one byte buffer and an offset per document. Words are maximal runs of
bytes outside 0x20 and 0x09-0x0D; in UTF-8 that is the same as `[^\\x20\\x09-\\x0D]+` on
characters. A span's hash is the difference of two prefix sums of byte * BASE**position,
divided by BASE**start (modulo 2**64), then mixed, so equal strings have equal hashes wherever
they stand.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard

CHUNK_BYTES = 1 << 20
_BASE = 0x9E3779B97F4A7C15
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
u64 = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers whose output bits all depend on all input bits."""
    x = x ^ (x >> u64(31))
    x = x * u64(0x7FB5D329728EA185)
    x = x ^ (x >> u64(27))
    x = x * u64(0x81DADEF4BC2DD44D)
    return x ^ (x >> u64(33))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64 for i < n."""
    if len(_powers[0]) < n:
        for k, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            steps = np.full(max(n, CHUNK_BYTES + (1 << 18)), base, u64)
            steps[0] = 1
            _powers[k] = np.cumprod(steps)
    return _powers[0][:n], _powers[1][:n]


def chunks(strings: pa.Array | pa.ChunkedArray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, "Text"]]:
    """(first row, row after the last, Text) of consecutive pieces of about `limit` bytes; null is empty."""
    if isinstance(strings, pa.ChunkedArray):
        strings = strings.combine_chunks() if strings.num_chunks != 1 else strings.chunk(0)
    strings = strings.cast(pa.large_string())
    n = len(strings)
    if n == 0:
        return
    _, offs, data = strings.buffers()
    off = np.frombuffer(offs, np.int64)[strings.offset : strings.offset + n + 1]
    buf = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    if strings.null_count:
        # a null may own bytes; take the array again with empty strings instead
        strings = strings.fill_null("")
        yield from chunks(strings, limit)
        return
    lo = 0
    while lo < n:
        hi = int(np.searchsorted(off, off[lo] + limit, side="right")) - 1
        hi = min(n, max(hi, lo + 1))
        yield lo, hi, Text(buf[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])
        lo = hi


class Text:
    """One chunk. `off[i]:off[i+1]` are document i's bytes in `buf`."""

    def __init__(self, buf: np.ndarray, off: np.ndarray):
        self.buf, self.off, self.n = buf, off, len(off) - 1
        self._prefix: np.ndarray | None = None

    def lower_ascii(self) -> "Text":
        buf = self.buf.copy()
        up = (buf >= 65) & (buf <= 90)
        buf[up] += 32
        return Text(buf, self.off)

    def doc_of(self, at: np.ndarray) -> np.ndarray:
        """The document of each byte position (of a byte that exists)."""
        return np.searchsorted(self.off, at, side="right") - 1

    def count_by_doc(self, mask: np.ndarray) -> np.ndarray:
        """How many true bytes each document has."""
        c = np.zeros(len(mask) + 1, np.int64)
        np.cumsum(mask, out=c[1:])
        return c[self.off[1:]] - c[self.off[:-1]]

    def word_bounds(self) -> tuple[np.ndarray, np.ndarray]:
        """Start and end of each word; documents' borders end words too."""
        inside = ~_SPACE[self.buf]
        first = inside.copy()
        first[1:] &= ~inside[:-1]
        edge = self.off[:-1][(self.off[:-1] < self.off[1:])]
        first[edge] = inside[edge]
        last = inside.copy()
        last[:-1] &= ~inside[1:]
        edge = self.off[1:][(self.off[:-1] < self.off[1:])] - 1
        last[edge] = inside[edge]
        return np.flatnonzero(first), np.flatnonzero(last) + 1

    def line_bounds(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, end and document of each line cut at \\n; an empty document is one empty line."""
        nl = np.flatnonzero(self.buf == 10)
        starts = np.concatenate([self.off[:-1], nl + 1])
        doc = np.concatenate([np.arange(self.n), self.doc_of(nl) if len(nl) else np.zeros(0, np.int64)])
        # by document, then position: a break at a document's end starts an empty last line
        order = np.lexsort((starts, doc))
        starts, doc = starts[order], doc[order]
        ends = np.empty_like(starts)
        ends[:-1] = starts[1:] - 1
        is_last = np.ones(len(starts), bool)
        is_last[:-1] = doc[1:] != doc[:-1]
        ends[is_last] = self.off[1:][doc[is_last]]
        return starts, ends, doc

    def hashes(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """A 64-bit hash of each span."""
        up, down = powers(len(self.buf) + 1)
        if self._prefix is None:
            self._prefix = np.zeros(len(self.buf) + 1, u64)
            np.cumsum((self.buf.astype(u64) + u64(1)) * up[:-1], out=self._prefix[1:])
        h = (self._prefix[end] - self._prefix[start]) * down[start]
        return mix(h ^ ((end - start).astype(u64) << u64(48)))


def ngram_hashes(words: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(index of the first word, hash) of each run of n words inside one document."""
    if len(words) < n:
        return np.zeros(0, np.int64), np.zeros(0, u64)
    at = np.flatnonzero(doc[n - 1 :] == doc[: len(doc) - n + 1])
    h = np.zeros(len(at), u64)
    for k in range(n):
        h = h * u64(0xD1342543DE82EF95) + words[at + k]
    return at, mix(h + u64(n))


def rows_of_counts(sorted_doc: np.ndarray, n: int) -> np.ndarray:
    """Offsets of each document's slice in an array sorted by document."""
    return np.searchsorted(sorted_doc, np.arange(n + 1))


def blobs(values: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """A binary array whose i-th value is the bytes of values[offsets[i]:offsets[i+1]]."""
    values = np.ascontiguousarray(values)
    offs = (offsets * values.itemsize).astype(np.int64)
    return pa.Array.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(offs), pa.py_buffer(values)]).cast(pa.binary())


def pack_bytes(values: np.ndarray) -> bytes:
    return zstandard.compress(np.ascontiguousarray(values).tobytes(), 3)


def unpack_bytes(raw: bytes) -> bytes:
    return zstandard.decompress(raw)


def pack_numbers(values: np.ndarray) -> bytes:
    """64-bit integers, all first bytes first, so that compression finds the zeros."""
    return pack_bytes(values.astype("<i8").view(np.uint8).reshape(-1, 8).T)


def unpack_numbers(raw: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(unpack_bytes(raw), np.uint8).reshape(8, -1).T).view("<i8").ravel()
