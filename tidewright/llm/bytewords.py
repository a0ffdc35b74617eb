"""Vectorised words and shingles of Arrow text columns.

A word is a maximal run of bytes outside ``\\x20\\x09-\\x0D``; A-Z may be lower-cased first.
Everything here works on whole Arrow batches with NumPy, in slices of bounded bytes, so that no
Python object is made per word.  Words and shingles are identified by well-mixed 64-bit hashes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Bytes of text worked on at once; one longer text makes a slice of its own.
SLICE_BYTES = 4 << 20
#: Words longer than this are hashed one by one with BLAKE2b instead of in 8-byte steps.
LONG_WORD = 256

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Bytes between words made of letters and digits alone; any byte beyond ASCII belongs to a word.
MARKS = np.array([not (chr(b).isalnum() or b > 127) for b in range(256)])
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_KEEP = np.array([(1 << (8 * k)) - 1 for k in range(8)] + [2**64 - 1], np.uint64)
_M1, _M2, _M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers whose output bits all depend on all input bits (SplitMix64)."""
    x = x + _M1
    x ^= x >> np.uint64(30)
    x *= _M2
    x ^= x >> np.uint64(27)
    x *= _M3
    x ^= x >> np.uint64(31)
    return x


def text_slices(column: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of consecutive slices; a null text has no bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()) if not pa.types.is_large_string(column.type) else column
    n = len(column)
    if not n:
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64, n + 1, column.offset * 8)
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    if column.null_count:  # what a null row spans is not text
        column = column.fill_null("")
        offsets = np.frombuffer(column.buffers()[1], np.int64, n + 1, column.offset * 8)
        data = column.buffers()[2]
        data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    row = 0
    while row < n:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + most, "right")) - 1)
        end = min(end, n)
        yield row, end, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


@dataclass
class Words:
    """Words of a slice: ``data`` bytes, ``starts``/``ends`` of words, ``first[d]:first[d + 1]`` the words of document d."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray

    def hashes(self) -> np.ndarray:
        return hash_spans(self.data, self.starts, self.ends)

    def strings(self) -> list[bytes]:
        raw = self.data.tobytes()
        return [raw[a:b] for a, b in zip(self.starts.tolist(), self.ends.tolist())]


def words(data: np.ndarray, offsets: np.ndarray, lower: bool = True, breaks: np.ndarray = _SPACE) -> Words:
    data = _LOWER[data] if lower else data
    solid = ~breaks[data]
    opens, closes = solid.copy(), solid.copy()
    opens[1:] &= ~solid[:-1]
    closes[:-1] &= ~solid[1:]
    cuts = offsets[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(data))]
    opens[cuts] = solid[cuts]
    closes[cuts - 1] = solid[cuts - 1]
    starts = np.flatnonzero(opens)
    return Words(data, starts, np.flatnonzero(closes) + 1, np.searchsorted(starts, offsets))


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte spans, eight bytes a step."""
    sizes = ends - starts
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    eights = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))
    out = mix(sizes.astype(np.uint64))
    alive = np.flatnonzero((sizes > 0) & (sizes <= LONG_WORD))
    at, left = starts[alive], sizes[alive]
    while len(alive):
        out[alive] = mix(out[alive] ^ (eights[at] & _KEEP[np.minimum(left, 8)]))
        more = left > 8
        alive, at, left = alive[more], at[more] + 8, left[more] - 8
    for k in np.flatnonzero(sizes > LONG_WORD).tolist():
        out[k] = np.uint64(int.from_bytes(hashlib.blake2b(data[starts[k] : ends[k]].tobytes(), digest_size=8).digest(), "little"))
    return out


def shingle_hashes(hashes: np.ndarray, first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``width`` words within a document, and where each document's begin.

    A document of 1 to width - 1 words has its whole sequence as its one shingle.
    """
    n = len(hashes)
    counts = np.diff(first)
    made = np.where(counts >= width, counts - width + 1, np.minimum(counts, 1))
    begin = np.concatenate(([0], np.cumsum(made)))
    if not n:
        return np.zeros(0, np.uint64), begin
    at = np.arange(begin[-1]) + np.repeat(first[:-1] - begin[:-1], made)
    sizes = np.repeat(np.minimum(counts, width), made)
    out = mix(sizes.astype(np.uint64))
    for k in range(width):
        step = hashes[np.minimum(at + k, n - 1)]
        out = np.where(k < sizes, mix(out ^ step), out) if (sizes <= k).any() else mix(out ^ step)
    return out, begin
