"""Word arithmetic over Arrow string batches, used inside tasks.

A word is ``[^\\x20\\x09-\\x0D]+``.  Everything works on the UTF-8 bytes of a
whole Arrow string column at once, so a task never loops over words in Python.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa

BLANK = np.zeros(256, bool)
BLANK[[0x20, *range(0x09, 0x0E)]] = True

_BASE = 0x9E3779B97F4A7C15
_powers = np.ones(1, np.uint64)
_inverse = np.ones(1, np.uint64)


def _powers_to(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n of the hash base and of its inverse modulo 2**64."""
    global _powers, _inverse
    if len(_powers) <= n:
        step = np.full(max(n + 1, 1 << 20), _BASE, np.uint64)
        step[0] = 1
        _powers = np.cumprod(step)
        step[1:] = pow(_BASE, -1, 1 << 64)
        _inverse = np.cumprod(step)
    return _powers, _inverse


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (a finalizer, one to one)."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def slices(batches, column: str = "text", most_bytes: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that the texts of each piece have at most ``most_bytes`` (one row at least)."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        ends = Texts(batch.column(batch.schema.get_field_index(column))).offset[1:]
        at = 0
        while at < n:
            base = ends[at - 1] if at else 0
            stop = max(at + 1, int(np.searchsorted(ends, base + most_bytes, side="right")))
            yield batch.slice(at, stop - at)
            at = stop


class Texts:
    """A column of texts as bytes, with words and hashes worked out once when asked for. Null counts as empty."""

    def __init__(self, column: pa.Array):
        if isinstance(column, pa.ChunkedArray):
            column = column.combine_chunks()
        column = column.fill_null("") if column.null_count else column
        wide = pa.types.is_large_string(column.type)
        _, offsets, data = column.buffers()
        n = len(column)
        if n:
            offset = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
        else:
            offset = np.zeros(1, np.int64)
        size = int(offset[-1] - offset[0])
        self.byte = np.frombuffer(data, np.uint8)[offset[0] : offset[-1]] if size else np.zeros(0, np.uint8)
        self.offset = offset - offset[0]
        self.n = n

    def per_text(self, flags: np.ndarray) -> np.ndarray:
        """Sum a flag or count for each byte over each text."""
        total = np.zeros(len(flags) + 1, np.int64)
        np.cumsum(flags, out=total[1:])
        return total[self.offset[1:]] - total[self.offset[:-1]]

    @cached_property
    def solid(self) -> np.ndarray:
        return ~BLANK[self.byte]

    @cached_property
    def spans(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, end, text index) of every word."""
        if not len(self.byte):
            none = np.zeros(0, np.int64)
            return none, none, none
        solid = self.solid
        first = np.zeros(len(solid) + 1, bool)
        first[self.offset[:-1]] = True
        begins = solid.copy()
        begins[1:] &= ~solid[:-1] | first[1:-1]
        start = np.flatnonzero(begins)
        # a word ends where the next byte is blank or belongs to another text
        ends = solid.copy()
        ends[:-1] &= ~solid[1:] | first[1:-1]
        end = np.flatnonzero(ends) + 1
        text = np.searchsorted(self.offset, start, side="right") - 1
        return start, end, text

    @cached_property
    def prefix(self) -> np.ndarray:
        """prefix[k]: the polynomial of the first k bytes modulo 2**64."""
        power, _ = _powers_to(len(self.byte))
        h = np.zeros(len(self.byte) + 1, np.uint64)
        np.cumsum((self.byte.astype(np.uint64) + np.uint64(1)) * power[: len(self.byte)], out=h[1:])
        return h

    def hashes(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """64-bit hashes of byte ranges; equal ranges have equal hashes wherever they stand."""
        _, inverse = _powers_to(len(self.byte))
        return mix((self.prefix[end] - self.prefix[start]) * inverse[start])

    @cached_property
    def word_hash(self) -> np.ndarray:
        start, end, _ = self.spans
        return self.hashes(start, end)

    @cached_property
    def n_words(self) -> np.ndarray:
        return np.bincount(self.spans[2], minlength=self.n).astype(np.int64)

    def windows(self, width: int) -> tuple[np.ndarray, np.ndarray]:
        """(index of the first word, hash) of every run of ``width`` words inside one text."""
        text, h = self.spans[2], self.word_hash
        m = len(h) - width + 1
        if m <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        whole = np.flatnonzero(text[:m] == text[width - 1 :])
        run = np.zeros(m, np.uint64)
        for j in range(width):
            run = run * np.uint64(0x2545F4914F6CDD1D) + h[j : j + m]
        return whole, mix(run[whole])

    @cached_property
    def joined(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(bytes, start, end): all words with one space after each, and where each word stands there."""
        start, end, _ = self.spans
        size = end - start
        total = int(size.sum())
        data = np.full(total + len(size), 0x20, np.uint8)
        data[np.arange(total) + np.repeat(np.arange(len(size)), size)] = self.byte[self.solid]
        first = np.cumsum(size + 1) - (size + 1)
        return data, first, first + size


def lowered(texts: Texts) -> Texts:
    """The same texts with A-Z in lower case."""
    upper = (texts.byte >= 0x41) & (texts.byte <= 0x5A)
    texts.byte = texts.byte + (upper * np.uint8(0x20))
    return texts


def strings(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.Array:
    """The byte ranges as an Arrow string array."""
    size = end - start
    offsets = np.zeros(len(size) + 1, np.int64)
    np.cumsum(size, out=offsets[1:])
    at = np.repeat(start - offsets[:-1], size) + np.arange(offsets[-1])
    return pa.LargeStringArray.from_buffers(len(size), pa.py_buffer(offsets), pa.py_buffer(data[at]))
