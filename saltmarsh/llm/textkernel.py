"""Vectorised word hashing over Arrow text columns, for use inside Spark tasks.

Everything here works on whole Arrow batches: a text column is read as one byte buffer with offsets, words are found by
comparing neighbouring bytes, and polynomial (Rabin-Karp) hashes come from prefix sums modulo 2**64.  No Python object is
made for a word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
#: Bytes of text handled at once; bounds the working memory of a task (about 60 bytes for each).
SLICE_BYTES = 1 << 19

_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
#: Bases for hashes of word runs: each gives 64 bits of its own.
_WORD_BASES = (0xD1342543DE82EF95, 0xAF251AF3B0F025B5)
_WORD_INVERSES = tuple(pow(b, -1, 1 << 64) for b in _WORD_BASES)

#: Which bytes part words: white space, or every ASCII character that is no letter.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
NO_LETTER = np.array([b < 128 and not chr(b).isalpha() for b in range(256)])

_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 ... base**(n-1) modulo 2**64; kept between calls."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, 1 << 16)
        have = np.full(size, base, U64)
        have[0] = 1
        have = np.multiply.accumulate(have)
        if size <= 4 * SLICE_BYTES:
            _powers[base] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (the finaliser of splitmix64)."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a text or binary column and n + 1 offsets into them; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    kind = pa.large_binary()
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    if not pa.types.is_large_binary(column.type):
        column = column.cast(kind)
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, 8 * column.offset) if len(column) else np.zeros(1, np.int64)
    body = column.buffers()[2] if len(column) else None
    data = np.frombuffer(body, np.uint8) if body is not None and body.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges [i, j) of at most about ``limit`` bytes each; a longer text stands alone."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


class Words:
    """The words of several texts: maximal runs of bytes that are no separators (space and 0x09 to 0x0D).

    ``start`` and ``end`` index ``data``; text d has words first[d] to first[d + 1] - 1; ``hash`` has 64 bits for each word.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, separators: np.ndarray = SPACE):
        n = len(data)
        self.data, self.offsets = data, offsets
        gap = separators[data]
        before = np.empty(n, bool)
        after = np.empty(n, bool)
        if n:
            before[1:] = gap[:-1]
            before[0] = True
            after[:-1] = gap[1:]
            after[-1] = True
            cuts = offsets[:-1][offsets[:-1] < n]
            before[cuts] = True
            after[cuts[cuts > 0] - 1] = True
        self.start = np.flatnonzero(~gap & before)
        self.end = np.flatnonzero(~gap & after) + 1
        self.first = np.searchsorted(self.start, offsets)
        self._sums: np.ndarray | None = None

    def sums(self) -> np.ndarray:
        if self._sums is None:
            self._sums = np.zeros(len(self.data) + 1, U64)
            np.cumsum((self.data.astype(U64) + U64(1)) * powers(_BASE, len(self.data)), out=self._sums[1:])
        return self._sums

    def hash_spans(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        sums = self.sums()
        return mix((sums[end] - sums[start]) * powers(_BASE_INVERSE, len(sums))[start] + (end - start).astype(U64))

    @property
    def hash(self) -> np.ndarray:
        return self.hash_spans(self.start, self.end)

    def text_of(self) -> np.ndarray:
        """For each word the number of its text."""
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def gram_hashes(words: np.ndarray, size: int, which: int = 0) -> np.ndarray:
    """Rabin-Karp hashes of every ``size`` neighbouring word hashes; len(words) - size + 1 of them, over text borders too.

    ``which`` (0 or 1) chooses the base: both together are 128 bits.
    """
    n = len(words)
    if n < size:
        return np.zeros(0, U64)
    sums = np.zeros(n + 1, U64)
    np.cumsum(words * powers(_WORD_BASES[which], n), out=sums[1:])
    return mix((sums[size:] - sums[:-size]) * powers(_WORD_INVERSES[which], n)[: n - size + 1])


def gram_starts(first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the words at which a run of ``size`` words of one text starts, and the number of that text."""
    count = np.maximum(np.diff(first) - size + 1, 0)
    text = np.repeat(np.arange(len(count)), count)
    begin = np.cumsum(count) - count
    return np.arange(len(text)) - begin[text] + first[:-1][text], text


def shingles(words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of ``size`` words and the number of their text, in order.

    A text of fewer words, but at least one, has the run of all its words as its one shingle; a text without words has none.
    """
    h = words.hash
    at, text = gram_starts(words.first, size)
    whole = gram_hashes(h, size)[at] if len(at) else np.zeros(0, U64)
    count = np.diff(words.first)
    short = np.flatnonzero((count > 0) & (count < size))
    if not len(short):
        return whole, text
    sums = np.zeros(len(h) + 1, U64)
    np.cumsum(h * powers(_WORD_BASES[0], len(h)), out=sums[1:])
    a, b = words.first[short], words.first[short + 1]
    few = mix((sums[b] - sums[a]) * powers(_WORD_INVERSES[0], len(h))[a] + count[short].astype(U64))
    text = np.concatenate([text, short])
    order = np.argsort(text, kind="stable")
    return np.concatenate([whole, few])[order], text[order]


def sliding_argmin(x: np.ndarray, width: int) -> np.ndarray:
    """For every ``width`` neighbours the index of their minimum, the leftmost of equals."""

    def better(left: np.ndarray, right: np.ndarray) -> np.ndarray:
        return np.where(x[right] < x[left], right, left)

    have, step = np.arange(len(x)), 1
    while step * 2 <= width:
        have = better(have[:-step], have[step:])
        step *= 2
    rest = width - step
    return better(have[: len(have) - rest], have[rest:]) if rest else have
