"""Hashed word shingles of many texts at once, and sorted sets of hashes as few bytes.

Words are runs of bytes other than ``[\\x20\\x09-\\x0D]``, A-Z in lower case. They are hashed in the UTF-8 buffer they come in: a
word's hash is a polynomial over random values of its bytes, taken as the difference of two running sums.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from plumbline.llm.common import mixed

WORDS_A_SHINGLE = 5
#: bytes of text that a task works on at a time
SLICE_BYTES = 2_000_000
#: bytes hashed at a time; a longer text is taken whole
_PIECE = 1 << 20


def _constants() -> tuple[np.ndarray, np.ndarray, int, int]:
    """A value for each byte (0 for blanks, equal for a letter and its capital), whether it is a blank, the base and its inverse."""
    value = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
    value[65:91] = value[97:123]
    blank = np.zeros(256, bool)
    blank[[9, 10, 11, 12, 13, 32]] = True
    value[blank] = 0
    base = 0xD6E8FEB86659FD93
    return value, blank, base, pow(base, -1, 1 << 64)


_VALUE, _BLANK, _BASE, _INVERSE = _constants()
_PLACES = mixed(np.arange(11, 11 + 64, dtype=np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)) | np.uint64(1)


class Hasher:
    """Word and shingle hashes; holds the powers of the base."""

    def __init__(self):
        self.powers = self.inverses = np.zeros(0, np.uint64)

    def _grown(self, n: int) -> None:
        if len(self.powers) < n:
            n = max(n, _PIECE)
            for name, base in (("powers", _BASE), ("inverses", _INVERSE)):
                steps = np.full(n, base, np.uint64)
                steps[0] = 1
                setattr(self, name, np.cumprod(steps, dtype=np.uint64))

    def words(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the words of the segments ``data[bounds[i]:bounds[i + 1]]``, and how many words each has."""
        return self.placed(data, bounds)[:2]

    def placed(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """``words``, and the first byte of each word and the byte behind it."""
        parts = [[np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]]
        at, n = 0, len(bounds) - 1
        while at < n:
            to = max(at + 1, int(np.searchsorted(bounds, bounds[at] + _PIECE, "right")) - 1)
            hashes, counts, starts, ends = self._piece(data[bounds[at]:bounds[to]], bounds[at:to + 1] - bounds[at])
            for part, own in zip(parts, (hashes, counts, starts + bounds[at], ends + bounds[at])):
                part.append(own)
            at = to
        return tuple(np.concatenate(p) for p in parts)

    def _piece(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        if not len(data):
            none = np.zeros(0, np.int64)
            return none.astype(np.uint64), np.zeros(len(bounds) - 1, np.int64), none, none
        self._grown(len(data))
        blank = _BLANK[data]
        cut = np.zeros(len(data) + 1, bool)
        cut[bounds] = True
        cut[1:] |= blank  # a word ends before each blank ...
        ends = np.flatnonzero(~blank & (cut[1:] | np.append(blank[1:], True))) + 1
        before = np.append(True, blank[:-1])  # ... and starts behind one
        before[bounds[bounds < len(data)]] = True
        starts = np.flatnonzero(~blank & before)
        sums = np.cumsum(_VALUE[data] * self.powers[:len(data)], dtype=np.uint64)
        whole = sums[ends - 1]
        whole[starts > 0] -= sums[starts[starts > 0] - 1]
        hashes = mixed(whole * self.inverses[starts] + (ends - starts).astype(np.uint64))
        return hashes, np.diff(np.searchsorted(starts, bounds)), starts, ends

    def sets(self, data: np.ndarray, bounds: np.ndarray, size: int = WORDS_A_SHINGLE, least_words: int = 1) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sorted distinct shingle hashes of each segment one after the other, how many each has, and its number of words. A segment
        with fewer words than a shingle has one shingle, one with fewer than ``least_words`` none."""
        words, counts = self.words(data, bounds)
        ends = np.cumsum(counts)
        starts = ends - counts
        used = counts >= max(1, least_words)
        n = np.where(used, np.maximum(counts - size + 1, 1), 0)
        first = np.repeat(starts, n) + (np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n))
        width = np.repeat(np.minimum(counts, size), n)
        flat = width.astype(np.uint64)
        for j in range(size):
            if len(words):
                part = words[np.minimum(first + j, len(words) - 1)]
                flat += np.where(j < width, (part ^ (part >> np.uint64(29))) * _PLACES[j], np.uint64(0))
        flat = mixed(flat)
        stops = np.cumsum(n)
        for a, b in zip((stops - n)[used].tolist(), stops[used].tolist()):
            flat[a:b].sort()
        new = np.ones(len(flat), bool)
        new[1:] = flat[1:] != flat[:-1]
        new[(stops - n)[used]] = True
        running = np.concatenate([[0], np.cumsum(new)])
        return flat[new], running[stops] - running[stops - n], counts


def windows(words: np.ndarray, size: int, reach: int, shingle: int = WORDS_A_SHINGLE, every: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Places of windows of ``size`` words, and the hashes of these windows; ``size`` is a multiple of ``shingle``.

    A window starts where the shingle hash is the smallest of some ``reach`` neighbouring ones, so two texts that share
    ``size + reach - 1`` words or more in a row have a window in common, wherever it stands. Of equal windows of a text the first counts,
    or ``every`` one.
    """
    n = len(words) - size + 1
    if n < 1:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    runs = word_runs(words, shingle)
    view = np.lib.stride_tricks.sliding_window_view(runs, min(reach, len(runs)))
    at = np.unique(view.argmin(1) + np.arange(len(view)))
    at = at[at < n]
    hashes = window_hashes(runs, at, size, shingle)
    if every:
        return at, hashes
    hashes, first = np.unique(hashes, return_index=True)
    return at[first], hashes


def word_runs(words: np.ndarray, shingle: int = WORDS_A_SHINGLE) -> np.ndarray:
    """Hash of the ``shingle`` words that start at each word but the last ones."""
    n = max(0, len(words) - shingle + 1)
    total = np.zeros(n, np.uint64)
    for j in range(shingle):
        part = words[j:n + j]
        total += (part ^ (part >> np.uint64(29))) * _PLACES[j]
    return mixed(total)


def window_hashes(runs: np.ndarray, at: np.ndarray, size: int, shingle: int = WORDS_A_SHINGLE) -> np.ndarray:
    """Hashes of the windows of ``size`` words at the given places; ``runs`` are those of ``word_runs``."""
    hashes = np.zeros(len(at), np.uint64)
    for j in range(size // shingle):
        hashes += (runs[at + j * shingle] ^ np.uint64(j)) * _PLACES[16 + j]
    return mixed(hashes)


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a text column and the bounds of its values; NULL is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        column = column.chunk(0) if isinstance(column, pa.ChunkedArray) else column
    column = column.fill_null("") if column.null_count else column
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    bounds = np.frombuffer(column.buffers()[1], kind, len(column) + 1, column.offset * np.dtype(kind).itemsize).astype(np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data[bounds[0]:bounds[-1]], bounds - bounds[0]


def slices(batches: Iterator[pa.RecordBatch], at: int, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of the batches in runs whose texts (column ``at``) have at most so many bytes, or one longer text: a batch has some
    thousand rows however long they are, and what is computed from each byte or word takes many times their size."""
    for batch in batches:
        bounds, start = buffers(batch.column(at))[1], 0
        while start < batch.num_rows:
            stop = max(start + 1, int(np.searchsorted(bounds, bounds[start] + most, "right")) - 1)
            yield batch.slice(start, stop - start)
            start = stop


def pack_sorted(values: np.ndarray) -> bytes:
    """Sorted unsigned 64-bit numbers as the bytes of their differences, byte by byte of the same place."""
    steps = np.diff(values, prepend=np.uint64(0)).astype("<u8")
    return zlib.compress(np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 8).T).tobytes(), 1)


def unpack_sorted(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zlib.decompress(data), np.uint8)
    steps = np.ascontiguousarray(planes.reshape(8, -1).T).view("<u8").reshape(-1)
    return np.cumsum(steps, dtype=np.uint64)


def to_bytes(values: np.ndarray) -> bytes:
    """The low 48 bits of each number; two of some hundred shingles of a pair agree in them by chance once in 10^9 pairs."""
    return np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()


def from_bytes(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(data, np.uint8).reshape(-1, 6)
    return out.view("<u8").reshape(-1)
