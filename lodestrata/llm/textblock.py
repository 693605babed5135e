"""Vectorised word and shingle hashing over Arrow string columns.

A column of texts is handled as one byte buffer with document offsets, cut into blocks of bounded
bytes, so the work per word is a handful of numpy operations and no Python object is made per word.

Words are maximal runs of bytes outside [\\x20\\x09-\\x0D], which on UTF-8 equals `[^\\x20\\x09-\\x0D]+`
on code points. A word's hash is a polynomial in its bytes modulo 2**64 through a finaliser; equal
words always have equal hashes, and different words collide with a probability of about 2**-64.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 1 << 18

_BASE = 0x9E3779B97F4A7C15 | 1
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

_BASES = (_BASE, 0xD6E8FEB86659FD93 | 1)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}
#: Bytes whose powers are held in tables; longer blocks are hashed in strips of so many.
_STRIP = 1 << 19


def _power_tables(which: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i up to _STRIP; made once in a process."""
    if which not in _powers:
        tables = []
        for base in (_BASES[which], pow(_BASES[which], -1, 1 << 64)):
            table = np.ones(_STRIP + 1, dtype=np.uint64)
            done = 1
            while done < len(table):
                step = np.uint64(pow(base, done, 1 << 64))
                more = min(done, len(table) - done)
                table[done : done + more] = table[:more] * step
                done += more
            tables.append(table)
        _powers[which] = (tables[0], tables[1])
    return _powers[which]


def mix64(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64 (a bijection of 64-bit words)."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class TextBlock:
    """Some documents' bytes, one after another; `offsets` has the bounds of each document."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data = data
        self.offsets = offsets
        self.n_docs = len(offsets) - 1
        self._sums: dict[int, np.ndarray] = {}

    def lowered(self) -> TextBlock:
        return TextBlock(_LOWER[self.data], self.offsets)

    def is_space(self) -> np.ndarray:
        return _SPACE[self.data]

    def per_doc(self, flags: np.ndarray) -> np.ndarray:
        """Sum of a per-byte array of flags by document."""
        out = np.zeros(self.n_docs, dtype=np.int64)
        some = np.flatnonzero(np.diff(self.offsets))
        if len(some):
            out[some] = np.add.reduceat(flags, self.offsets[some], dtype=np.int64)
        return out

    def word_bounds(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts and ends of the words, and for each document the index of its first word (n_docs + 1)."""
        n = len(self.data)
        if not n:
            none = np.zeros(0, dtype=np.int64)
            return none, none, np.zeros(self.n_docs + 1, dtype=np.int64)
        inside = ~self.is_space()
        cut = np.zeros(n + 1, dtype=bool)
        cut[self.offsets] = True
        starts = inside.copy()
        starts[1:] &= ~inside[:-1] | cut[1:n]
        ends = inside.copy()
        ends[:-1] &= ~inside[1:] | cut[1:n]
        starts, ends = np.flatnonzero(starts), np.flatnonzero(ends) + 1
        return starts, ends, np.searchsorted(starts, self.offsets)

    def _strip_sums(self, which: int) -> Iterator[tuple[int, np.ndarray]]:
        """Sums of data[i] * base**i up to each place, in strips: first place, sums at it and the places after it."""
        up, base, carry = _power_tables(which)[0], _BASES[which], np.uint64(0)
        for at in range(0, len(self.data) + 1, _STRIP):
            part = self.data[at : at + _STRIP]
            sums = np.zeros(len(part) + 1, dtype=np.uint64)
            np.cumsum((part.astype(np.uint64) + np.uint64(1)) * up[: len(part)], out=sums[1:])
            if at:
                sums *= np.uint64(pow(base, at, 1 << 64))
                sums += carry
            carry = sums[-1]
            yield at, sums

    def _sums_at(self, which: int, *places: np.ndarray) -> list[np.ndarray]:
        """The sums at ascending places. Only those of one strip are held at a time."""
        if len(self.data) < _STRIP:
            if which not in self._sums:
                (_, self._sums[which]), = self._strip_sums(which)
            return [self._sums[which][p] for p in places]
        found = [np.zeros(len(p), dtype=np.uint64) for p in places]
        for at, sums in self._strip_sums(which):
            for p, out in zip(places, found):
                a, b = np.searchsorted(p, [at, at + _STRIP])
                out[a:b] = sums[p[a:b] - at]
        return found

    def span_hashes(self, starts: np.ndarray, ends: np.ndarray, which: int = 0) -> np.ndarray:
        """64-bit hashes of the byte spans, whose starts and ends both ascend; `which` (0 or 1) picks one of two independent functions."""
        first, last = self._sums_at(which, starts, ends)
        down = _power_tables(which)[1]
        last -= first
        if len(self.data) < _STRIP:
            last *= down[starts]
        else:
            inverse = pow(_BASES[which], -1, 1 << 64)
            jumps = np.array([pow(inverse, at, 1 << 64) for at in range(0, len(self.data) + 1, _STRIP)], dtype=np.uint64)
            last *= down[starts % _STRIP] * jumps[starts // _STRIP]
        last += (ends - starts).astype(np.uint64)
        return mix64(last)

    def line_bounds(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts and ends (without the \\n) of the lines, and for each document the index of its first line; an empty document has one line."""
        breaks = self.data == 10
        at = np.flatnonzero(breaks)
        starts = np.sort(np.concatenate([self.offsets[:-1], at + 1]), kind="stable")
        ends = np.sort(np.concatenate([self.offsets[1:], at]), kind="stable")
        first = np.zeros(self.n_docs + 1, dtype=np.int64)
        np.cumsum(self.per_doc(breaks) + 1, out=first[1:])
        return starts, ends, first


_PLACE = mix64(np.arange(1, 65, dtype=np.uint64) * np.uint64(_BASE)) | np.uint64(1)


def windows(words: np.ndarray, first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all `width`-word windows inside documents.

    Returns the hashes, the index of each window's first word, and each document's first window.
    """
    n = len(words) - width + 1
    counts = np.diff(first)
    inner = np.maximum(counts - width + 1, 0)
    pointer = np.zeros(len(first), dtype=np.int64)
    np.cumsum(inner, out=pointer[1:])
    if n <= 0 or not pointer[-1]:
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64), np.zeros(len(first), dtype=np.int64)
    sums = words[:n] * _PLACE[0]
    for j in range(1, width):
        sums += words[j : j + n] * _PLACE[j]
    whole = np.repeat(first[:-1] - pointer[:-1], inner) + np.arange(pointer[-1])
    return mix64(sums[whole]), whole, pointer


def shingles(words: np.ndarray, first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Window hashes with their document pointers; a document of fewer words has one, of its whole sequence."""
    hashes, _, pointer = windows(words, first, width)
    counts = np.diff(first)
    short = np.flatnonzero((counts > 0) & (counts < width))
    if not len(short):
        return hashes, pointer
    own, few = first[short], counts[short]
    extra = few.astype(np.uint64) * _PLACE[63:]
    for j in range(width - 1):
        has = few > j
        extra[has] += words[own[has] + j] * _PLACE[j]
    added = np.zeros(len(counts), dtype=np.int64)
    added[short] = 1
    return np.insert(hashes, pointer[short], mix64(extra)), pointer + np.concatenate([[0], np.cumsum(added)])


def blocks(texts: pa.Array, block_bytes: int = BLOCK_BYTES) -> Iterator[tuple[int, int, TextBlock]]:
    """Cut a string column (null: empty) into runs of rows of about `block_bytes` bytes; yields first row, end row, block.

    One text longer than that is a block of its own; texts are never cut. What is made of a block takes about 20
    bytes for each of its bytes, most of it flags of bytes and numbers of words, so that bounds the longest text.
    """
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    n = len(texts)
    if not n:
        return
    wide = pa.types.is_large_string(texts.type)
    _, raw_offsets, raw = texts.buffers()
    offsets = np.frombuffer(raw_offsets, dtype=np.int64 if wide else np.int32)[texts.offset : texts.offset + n + 1].astype(np.int64)
    data = np.frombuffer(raw, dtype=np.uint8) if raw is not None else np.zeros(0, dtype=np.uint8)
    row = 0
    while row < n:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + block_bytes, side="right")) - 1)
        end = min(end, n)
        yield row, end, TextBlock(data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row])
        row = end
