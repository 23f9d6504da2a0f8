"""Vectorised words of UTF-8 text batches, without a Python object per word.

A word is a maximal run of bytes outside ``[\\x20\\x09-\\x0D]``.  A batch is kept as one buffer in
which every word is followed by one space, so the bytes of any run of words are one slice.
Word hashes take eight bytes at a time, each group of eight through a bijection of its own, so
that no pattern of letters collides by construction; equal words have equal hashes in every
batch, task and run.  Hashes only find candidates and count; what operators call equal they tell
by the words themselves or by BLAKE2b digests of their bytes.  Null texts have no words.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

SEGMENT = 1 << 18  # words hashed at a time
CHUNK = 1 << 20  # bytes of text worked on at a time
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_MASK = np.array([(1 << (8 * k)) - 1 for k in range(9)], np.uint64)
_LANE = np.uint64(0x9E3779B97F4A7C15)
_LENGTH = np.uint64(0xD1342543DE82EF95)


class Words(NamedTuple):
    """data: all words, each with a space after it; word i is data[start[i]:end[i]]; row r has the
    words first[r]:first[r + 1]."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word."""
        padded = np.concatenate([self.data, np.zeros(8, np.uint8)])
        lane = np.ndarray((len(self.data) + 1,), "<u8", buffer=padded.data, strides=(1,))
        out = np.empty(len(self.start), np.uint64)
        with np.errstate(over="ignore"):
            for a in range(0, len(out), SEGMENT):
                start, size = self.start[a : a + SEGMENT], (self.end - self.start)[a : a + SEGMENT]
                total = mix64((lane[start] & _MASK[np.minimum(size, 8)]) ^ _LANE)
                long = np.flatnonzero(size > 8)
                if len(long):
                    more = (size[long] - 1) // 8
                    at = np.cumsum(more) - more
                    k = np.arange(int(more.sum())) - np.repeat(at, more) + 1
                    left = np.minimum(np.repeat(size[long], more) - 8 * k, 8)
                    part = lane[np.repeat(start[long], more) + 8 * k] & _MASK[left]
                    total[long] += np.add.reduceat(mix64(part ^ ((k + 1).astype(np.uint64) * _LANE)), at)
                out[a : a + SEGMENT] = mix64(total + size.astype(np.uint64) * _LENGTH)
        return out

    def bytes_of(self, i: int, j: int) -> bytes:
        """Words i to j - 1, each with a space after it."""
        return self.data[self.start[i] : self.end[j - 1] + 1].tobytes() if j > i else b""

    def gather(self, i: np.ndarray, n: int) -> bytes:
        """The n words from each i on, one run after the other."""
        start, size = self.start[i], self.end[i + n - 1] + 1 - self.start[i]
        ends = np.cumsum(size)
        return self.data[np.arange(int(ends[-1]) if len(i) else 0) + np.repeat(start - (ends - size), size)].tobytes()


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on uint64, in place on a copy."""
    x = x.astype(np.uint64, copy=True)
    with np.errstate(over="ignore"):
        x ^= x >> np.uint64(32)
        x *= np.uint64(0xD6E8FEB86659FD93)
        x ^= x >> np.uint64(32)
        x *= np.uint64(0xD6E8FEB86659FD93)
        x ^= x >> np.uint64(32)
    return x


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the n+1 offsets of its rows; null rows are empty."""
    if column.null_count:
        column = column.fill_null("")
    large = pa.types.is_large_string(column.type)
    bufs = column.buffers()
    offs = np.frombuffer(bufs[1], np.int64 if large else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if bufs[2] is None or offs[-1] == offs[0]:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    data = np.frombuffer(bufs[2], np.uint8)[offs[0] : offs[-1]]
    return data, offs - offs[0]


def split_words(column: pa.Array, lower: bool = False) -> Words:
    """The words of each row; ``lower``: with A-Z in lower case."""
    data, offsets = text_bytes(column)
    rows = np.arange(len(offsets) - 1)
    data = np.insert(data, offsets[1:], 0x20)  # rows end words
    if lower:
        data = LOWER[data]
    space = _SPACE[data]
    first_space = space.copy()
    first_space[1:] &= ~space[:-1]
    first_space[:1] = False
    stop = np.flatnonzero(first_space)
    first = np.concatenate([[0], np.searchsorted(stop, offsets[1:] + rows, "right")])
    data = np.where(space, np.uint8(0x20), data)[~space | first_space]
    end = np.flatnonzero(data == 0x20)
    return Words(data, np.concatenate([np.zeros(min(1, len(end)), np.int64), end[:-1] + 1]), end, first)


def chunks(batch: pa.RecordBatch, column: str = "text", limit: int = CHUNK) -> Iterator[pa.RecordBatch]:
    """Slices of whole rows with at most ``limit`` bytes of text, or one longer row."""
    col = batch.column(batch.schema.get_field_index(column))
    _, offs = text_bytes(col)
    at = 0
    while at < batch.num_rows:
        end = int(np.searchsorted(offs, offs[at] + limit, "right")) - 1
        end = min(batch.num_rows, max(at + 1, end))
        yield batch.slice(at, end - at)
        at = end


def shingle_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of n consecutive words, len(h)-n+1 of them."""
    m = len(h) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(m, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(n):
            out = out * np.uint64(0xA24BAED4963EE407) + h[k : k + m]
    return mix64(out)
