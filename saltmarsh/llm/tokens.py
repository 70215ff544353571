"""Token ids of whole texts, those that the tokenizers library gives.

A byte-level vocabulary parts a text before it merges, and never joins what stands before a space to a word behind it.  So a text
is cut there and between kinds of ASCII characters, each new piece goes through tokenizers once, and the ids are put together again
by their places.  A word of letters alone, which the vocabulary doesn't part, goes to its merges at once.
"""

from __future__ import annotations

import json
import os
from itertools import chain
from operator import attrgetter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import text_groups
from .textkernel import utf8

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks use the cores already

#: Pieces whose ids are kept between batches, and the longest of them in bytes; bounds the table.
MOST_PIECES, LONGEST = 1_000_000, 64

TOKENIZER = "byte_bpe_50k.json"

#: Slots of the table of pieces, a power of two that it fills by half at most.
SLOTS = 1 << (2 * MOST_PIECES - 1).bit_length()

#: Of each byte: 0 white space, control or not ASCII, 1 letter, 2 digit, 3 other visible character.
_KIND = np.array([0 if not 0x20 < b < 0x7F else 1 if chr(b).isalpha() else 2 if chr(b).isdigit() else 3 for b in range(256)], np.uint8)

#: Bytes of ASCII letters and of the letters from U+00C0 to U+023F, but for the signs of times and division among these.
_LETTER = np.array([chr(b).isalpha() and b < 0x80 or 0x80 <= b < 0xC0 or 0xC3 <= b <= 0xC8 for b in range(256)])


def _characters() -> np.ndarray:
    """Of each byte the character that stands for it in a byte-level vocabulary: itself if visible, or one from U+0100 on."""
    shown = np.array([0x21 <= b <= 0x7E or 0xA1 <= b <= 0xFF and b != 0xAD for b in range(256)])
    return np.where(shown, np.arange(256), 0xFF + np.cumsum(~shown)).astype("<u4")


_CHARACTERS = _characters()


def cut_places(data: np.ndarray) -> np.ndarray:
    """Ascending places at which texts may be cut: ids of the parts are then those of the whole.

    A run of white space gives its last space to the word behind it and nothing else.  So a cut is right before a space that a
    visible ASCII character or a letter from U+00C0 to U+023F follows; it is also right where one precedes the space, which then
    begins the run.  A line feed or tab between two of these is a run of its own, and both its ends are cuts.  Letters, digits and
    other visible characters never share a token; only an apostrophe may take letters behind it.
    """
    if len(data) < 2:
        return np.zeros(0, np.int64)
    kind = _KIND[data]
    left, right = kind[:-1], kind[1:]
    cut = (left != right) & (left > 0) & (right > 0) & (data[:-1] != 0x27)
    two = (data >= 0xC3) & (data <= 0xC8)  # first bytes of the characters from U+00C0 to U+023F; none of them is white space
    begins, ends = (kind > 0) | two, kind > 0
    ends[1:] |= two[:-1]
    white, before, after = data[1:-1], ends[:-2], begins[2:]
    single = ((white == 0x0A) | (white == 0x09)) & before & after
    cut[:-1] |= (white == 0x20) & (after | before & (data[2:] >= 0x80)) | single
    cut[1:] |= single
    return np.flatnonzero(cut) + 1


def words(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Of each piece, which has at least one byte: whether it is letters alone, with or without one space before them."""
    letter = _LETTER[data]
    letter[1:] &= ~((data[:-1] == 0xC3) & ((data[1:] == 0x97) | (data[1:] == 0xB7)))
    first, n = offsets[:-1], np.diff(offsets)
    spaced = (data[first] == 0x20) & (n > 1)
    return np.add.reduceat(letter, first, dtype=np.int64) == n - spaced


def hashes(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """64 bits of each piece, from eight of its bytes at a time."""
    n = np.diff(offsets)
    eight = np.lib.stride_tricks.sliding_window_view(np.append(data, np.zeros(8, np.uint8)), 8)
    out = n.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    at = np.arange(len(n))
    for k in range(0, int(n.max(initial=0)), 8):
        at = at[n[at] > k]
        word = np.ascontiguousarray(eight[offsets[at] + k]).view("<u8")[:, 0]
        spare = (8 * np.maximum(k + 8 - n[at], 0)).astype(np.uint64)
        mixed = (out[at] ^ (word << spare)) * np.uint64(0xFF51AFD7ED558CCD)
        out[at] = (mixed ^ (mixed >> np.uint64(32))) * np.uint64(0xC4CEB9FE1A85EC53)
    return out ^ (out >> np.uint64(29))


class Grown:
    """An array that values are added to; ``n`` of them count."""

    def __init__(self, kind: str):
        self.room, self.n = np.zeros(1024, kind), 0

    def add(self, values: np.ndarray) -> None:
        if self.n + len(values) > len(self.room):
            self.room = np.append(self.room[: self.n], np.zeros(self.n // 2 + 2 * len(values), self.room.dtype))
        self.room[self.n : self.n + len(values)] = values
        self.n += len(values)

    def all(self) -> np.ndarray:
        return self.room[: self.n]


class Pieces:
    """Known pieces by number, found by their bytes.  Slots lead to them by a hash; what is found is compared byte by byte.

    Of pieces with the same 64 bits only one is found; the others are taken as new each time.
    """

    def __init__(self):
        self.slots = np.full(SLOTS, -1, np.int32)
        self.hash, self.data, self.offsets = Grown("<u8"), Grown("u1"), Grown("<i8")
        self.offsets.add(np.zeros(1, np.int64))

    def __len__(self) -> int:
        return self.hash.n

    def all(self) -> pa.LargeBinaryArray:
        return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(self), [None, pa.py_buffer(self.offsets.all()), pa.py_buffer(self.data.all())])

    def find(self, pieces: pa.LargeBinaryArray, hashed: np.ndarray) -> np.ndarray:
        """Each piece's number, or -1."""
        out = np.full(len(pieces), -1, np.int64)
        known, slot, open_ = self.hash.all(), (hashed & np.uint64(SLOTS - 1)).astype(np.int64), np.arange(len(pieces))
        while len(open_):
            number = self.slots[slot[open_]]
            open_, number = open_[number >= 0], number[number >= 0]
            same = known[number] == hashed[open_]
            out[open_[same]] = number[same]
            open_ = open_[~same]
            slot[open_] = (slot[open_] + 1) % SLOTS
        found = np.flatnonzero(out >= 0)
        same = pc.equal(self.all().take(pa.array(out[found])), pieces.take(pa.array(found)))
        out[found[~same.to_numpy(zero_copy_only=False)]] = -1
        return out

    def add(self, pieces: pa.LargeBinaryArray, hashed: np.ndarray) -> None:
        """Gives pieces that are not known the next numbers."""
        data, offsets = utf8(pieces)
        number = len(self) + np.arange(len(pieces))
        self.hash.add(hashed)
        self.offsets.add(self.data.n + offsets[1:])
        self.data.add(data)
        slot, open_ = (hashed & np.uint64(SLOTS - 1)).astype(np.int64), np.arange(len(pieces))
        while len(open_):
            free = open_[self.slots[slot[open_]] < 0]
            self.slots[slot[free]] = number[free]  # of several for a slot the last one gets it
            open_ = open_[self.slots[slot[open_]] != number[open_]]
            slot[open_] = (slot[open_] + 1) % SLOTS


class Encoder:
    """Ids of texts under a tokenizers file, without special tokens added; each text's as little-endian 32-bit numbers.

    Texts that hold an added token's string, and vocabularies that are not plain byte-level ones, go through tokenizers whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        with open(path, encoding="utf-8") as f:
            model = json.load(f)
        parts = model.get("pre_tokenizer") or {}
        self.by_piece = model["model"].get("type") == "BPE" and parts.get("type") == "ByteLevel" and not parts.get("add_prefix_space") and parts.get("use_regex", True) and not model.get("normalizer")
        self.by_piece = self.by_piece and all(chr(c) in model["model"]["vocab"] for c in _CHARACTERS)  # a byte without a token would be dropped
        self.bytes_of = np.zeros(self.tokenizer.get_vocab_size() + 1, np.int64)  # a byte-level token has a character for each byte
        if self.by_piece:
            for token, i in model["model"]["vocab"].items():
                self.bytes_of[i] = len(token)
        self._forget()

    def _forget(self, keep: bool = False) -> None:
        """Begins the table of pieces again, with those of the old one that came a second time if they are half of it at most."""
        again = np.flatnonzero(self.used[: len(self.known)]) if keep else np.zeros(0, np.int64)
        old = (self.known, self.first.all(), self.size.all(), self.flat.all()) if 0 < len(again) <= MOST_PIECES // 2 else None
        self.known, self.used = Pieces(), np.zeros(MOST_PIECES, bool)
        self.first, self.size = Grown("<i8"), Grown("<i8")
        self.flat, self.kept = Grown("<u4"), 0
        if old:
            known, first, size, flat = old
            first, size = first[again], size[again]
            end = np.cumsum(size)
            self.known.add(known.all().take(pa.array(again)), known.hash.all()[again])
            self.first.add(end - size)
            self.size.add(size)
            self.flat.add(flat[np.repeat(first - (end - size), size) + np.arange(end[-1])])
            self.kept = self.flat.n

    def _through(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")

    def _merged(self, pieces: pa.LargeBinaryArray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces of words(), one after another, and how many each has."""
        data, offsets = utf8(pieces)
        text = np.insert(_CHARACTERS[data], offsets[1:-1], 0).tobytes().decode("utf-32-le")
        flat = np.fromiter(map(attrgetter("id"), chain.from_iterable(map(self.model.tokenize, text.split("\0")))), "<u4")
        stop = np.searchsorted(np.cumsum(self.bytes_of[flat]), offsets[1:], "left") + 1
        return flat, np.diff(stop, prepend=0)

    def _encoded(self, pieces: pa.LargeBinaryArray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct pieces, one after another, and how many each has."""
        data, offsets = utf8(pieces)
        word = words(data, offsets) & (np.diff(offsets) <= LONGEST)
        order = np.append(np.flatnonzero(word), np.flatnonzero(~word))
        both = [f(pieces.take(pa.array(at))) for f, at in ((self._merged, np.flatnonzero(word)), (self._parted, np.flatnonzero(~word))) if len(at)]
        flat, size = np.concatenate([x for x, _ in both]), np.zeros(len(pieces), np.int64)
        size[order] = np.concatenate([x for _, x in both])
        first = np.zeros(len(pieces), np.int64)
        first[order] = np.cumsum(size[order]) - size[order]
        end = np.cumsum(size)
        return flat[np.repeat(first - (end - size), size) + np.arange(end[-1])], size

    def _parted(self, pieces: pa.LargeBinaryArray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct pieces of any kind, one after another, and how many each has.

        Most go through tokenizers as one text, each behind a token of its own where it must not follow the piece before; the ids are
        parted by their bytes.
        """
        data, offsets = utf8(pieces)
        n = np.diff(offsets)
        first, second = data[offsets[:-1]], data[np.minimum(offsets[:-1] + 1, len(data) - 1)]
        kind, spaced = _KIND[first], (first == 0x20) & (n > 1)
        plain = spaced & (_KIND[second] > 0)
        lead = np.where(plain, 0, np.where((kind > 1) & (first != 0x20) | spaced & (second >= 0x80), 1, np.where((kind == 1) & (first != 0x20), 2, 3)))
        size = np.zeros(len(n), np.int64)
        whole = pieces.to_pylist()
        alone = np.flatnonzero(lead == 3).tolist()
        together = np.flatnonzero(lead < 3)
        text = b"".join([(b"", b" a", b" 1")[k] + whole[i] for i, k in zip(together.tolist(), lead[together].tolist(), strict=True)])
        flat = self._through(text.decode())
        stop = np.searchsorted(np.cumsum(self.bytes_of[flat]), np.cumsum(n[together] + 2 * (lead[together] > 0)), "left") + 1
        begin = np.append(0, stop[:-1]) + (lead[together] > 0)
        size[together] = stop - begin
        own = {i: self._through(whole[i].decode()) for i in alone}
        size[alone] = [len(x) for x in own.values()]
        # The ids of pieces on their own go behind the others, and each piece's are then taken from its place.
        at = np.zeros(len(n), np.int64)
        at[together] = begin
        at[alone] = len(flat) + np.cumsum(size[alone]) - size[alone]
        pool, end = np.concatenate([flat, *own.values()]), np.cumsum(size)
        return pool[np.repeat(at - (end - size), size) + np.arange(end[-1])], size

    def _ids_of(self, pieces: pa.LargeBinaryArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All ids in one array, and each distinct piece's first place and number in it.

        New pieces are kept, but for long ones and those that the table has no room for, whose ids stand behind the others until
        the next call.
        """
        if len(self.known) + len(pieces) > MOST_PIECES:
            self._forget(len(pieces) <= MOST_PIECES // 2)
        self.flat.n = self.kept
        data, offsets = utf8(pieces)
        short, hashed = np.flatnonzero(np.diff(offsets) <= LONGEST), np.zeros(len(pieces), np.uint64)
        brief = pieces.take(pa.array(short))
        hashed[short] = hashes(*utf8(brief))
        number = np.full(len(pieces), -1, np.int64)
        number[short] = self.known.find(brief, hashed[short])
        found, new = np.flatnonzero(number >= 0), np.flatnonzero(number < 0)
        first, size = np.zeros(len(pieces), np.int64), np.zeros(len(pieces), np.int64)
        self.used[number[found]] = True
        first[found], size[found] = self.first.all()[number[found]], self.size.all()[number[found]]
        if len(new):
            long = np.diff(offsets)[new] > LONGEST
            new = np.append(new[~long], new[long])
            flat, size[new] = self._encoded(pieces.take(pa.array(new)))
            first[new] = self.kept + np.cumsum(size[new]) - size[new]
            self.flat.add(flat)
            keep = new[: min(np.count_nonzero(~long), MOST_PIECES - len(self.known))]
            self.known.add(pieces.take(pa.array(keep)), hashed[keep])
            self.first.add(first[keep])
            self.size.add(size[keep])
            self.kept += int(size[keep].sum())
        return self.flat.all(), first, size

    def _joined(self, texts: list[str]) -> list[bytes]:
        data, offsets = utf8(pa.array(texts, pa.large_string()))
        mark = np.zeros(len(data), bool)
        mark[cut_places(data)] = True
        mark[offsets[:-1][offsets[:-1] < len(data)]] = True
        bounds = np.append(np.flatnonzero(mark), len(data)).astype(np.int64)
        pieces = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(bounds) - 1, [None, pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(data))])
        known = pieces.dictionary_encode()
        at = known.indices.to_numpy()
        flat, first, size = self._ids_of(known.dictionary)
        first, size = first[at], size[at]
        stop = np.append(0, np.cumsum(size))
        ids = flat[np.repeat(first - stop[:-1], size) + np.arange(stop[-1])]
        edge = stop[np.searchsorted(bounds, offsets)]
        return [ids[a:b].tobytes() for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True)]

    def __call__(self, texts: list[str]) -> list[bytes]:
        out: list[bytes] = []
        for group in text_groups(texts, 1 << 22):
            whole = [not self.by_piece or any(a in t for a in self.added) for t in group]
            joined = iter(self._joined([t for t, w in zip(group, whole, strict=True) if not w]) if not all(whole) else [])
            out += [self._through(t).tobytes() if w else next(joined) for t, w in zip(group, whole, strict=True)]
        return out


def vocabulary(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
