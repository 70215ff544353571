"""SentencePiece encoding and decoding: unigram Viterbi over a double-array trie, byte fallback, white-space markers.

A model is read from its file: pieces, their kinds and their log scores.  A unigram model states log probabilities; a model of
merges states the rank of each merge as a negative number, which is turned into a log score by Zipf's law, -log(2 + rank).
Where no piece contains a marker behind another character (checked when the model is read), the best segmentation of a text is
that of its words, each with the markers before it; the ids of words are worked out once and kept.  Long words without a space go
through the same lattice in windows, about a hundred bytes of memory for each byte of a window and sixteen for each of the word.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batches, table, text_groups

MARK = "▁"
MODEL = "piece_bpe_32k.model"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
#: Below the least score by so much: a character that no piece covers.
PENALTY = 10.0
KEPT_WORDS = 100_000
#: Rows of a batch handled at once.
_ROWS = 500
_CHUNK = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")
#: Bytes of new words handled at once; a word of more than _LONG bytes goes by itself, in windows of _SLICE.
_SLICE, _LONG = 1 << 16, 1 << 12


@dataclass
class DoubleArray:
    """A trie in three arrays: the child of state s by byte b is base[s] + b if check of that is s; value is a piece or -1."""

    base: np.ndarray
    check: np.ndarray
    value: np.ndarray

    @staticmethod
    def build(keys: list[bytes], values: list[int]) -> DoubleArray:
        children: list[dict[int, int]] = [{}]
        final = [-1]
        for key, value in zip(keys, values, strict=True):
            node = 0
            for b in key:
                nxt = children[node].get(b)
                if nxt is None:
                    nxt = children[node][b] = len(children)
                    children.append({})
                    final.append(-1)
                node = nxt
            final[node] = value
        size = len(children) * 2 + 512
        base, check, value_at = [0] * size, [-1] * size, [-1] * size
        check[0] = 0
        place = {0: 0}
        free = [c + 1 for c in range(256)]  # by least byte: no slot below, from which that byte's base is positive, is free
        hint = 1  # nodes of several children look on from the last one's place
        queue = [0]
        for node in queue:
            s = place[node]
            value_at[s] = final[node]
            below = sorted(children[node])
            if not below:
                continue
            slot = free[below[0]] if len(below) == 1 else max(hint, below[0] + 1)
            while True:
                while check[slot] >= 0:
                    slot += 1
                b = slot - below[0]
                while b + 256 >= len(check):
                    base.extend([0] * size)
                    check.extend([-1] * size)
                    value_at.extend([-1] * size)
                if all(check[b + c] < 0 for c in below):
                    break
                slot += 1
            if len(below) > 1:
                hint = slot
            else:
                free[below[0]] = slot
            base[s] = b
            for c in below:
                check[b + c] = s
                place[children[node][c]] = b + c
                queue.append(children[node][c])
        last = max(i for i, c in enumerate(check) if c >= 0) + 257
        pad = max(0, last - len(check))
        return DoubleArray(*(np.array((x + [fill] * pad)[:last], np.int32) for x, fill in ((base, 0), (check, -1), (value_at, -1))))


@dataclass
class PieceModel:
    pieces: list[str]
    kinds: np.ndarray
    scores: np.ndarray
    unknown: int
    dummy_prefix: bool
    byte_ids: np.ndarray | None
    trie: DoubleArray
    by_words: bool

    @staticmethod
    def read(path: str) -> PieceModel:
        from sentencepiece import sentencepiece_model_pb2 as pb

        proto = pb.ModelProto()
        with open(path, "rb") as f:
            proto.ParseFromString(f.read())
        spec = proto.normalizer_spec
        if spec.precompiled_charsmap or spec.remove_extra_whitespaces or not spec.escape_whitespaces or proto.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("a model whose normaliser changes texts, or with markers behind words, is not supported")
        pieces = [p.piece for p in proto.pieces]
        kinds = np.array([p.type for p in proto.pieces])
        stated = np.array([p.score for p in proto.pieces], np.float64)
        scores = stated if proto.trainer_spec.model_type == pb.TrainerSpec.UNIGRAM else -np.log(2.0 - np.minimum(stated, 0))
        return PieceModel.of(pieces, kinds, scores, spec.add_dummy_prefix, proto.trainer_spec.byte_fallback)

    @staticmethod
    def of(pieces: list[str], kinds: np.ndarray, scores: np.ndarray, dummy_prefix: bool = True, byte_fallback: bool = True) -> PieceModel:
        usable = [i for i, k in enumerate(kinds) if k in (NORMAL, USER) and pieces[i]]
        by_byte = {pieces[i]: i for i, k in enumerate(kinds) if k == BYTE}
        names = [f"<0x{b:02X}>" for b in range(256)]
        byte_ids = np.array([by_byte[n] for n in names]) if byte_fallback and all(n in by_byte for n in names) else None
        unknown = next((i for i, k in enumerate(kinds) if k == UNKNOWN), 0)
        trie = DoubleArray.build([pieces[i].encode() for i in usable], usable)
        return PieceModel(pieces, np.asarray(kinds), np.asarray(scores, np.float32), unknown, dummy_prefix, byte_ids, trie, not any(MARK in pieces[i].lstrip(MARK) for i in usable))


class Segmenter:
    """Ids of words and texts; a worker keeps one for its model."""

    def __init__(self, model: PieceModel):
        self.model = model
        usable = np.isin(model.kinds, (NORMAL, USER))
        self.poor = np.float32((model.scores[usable].min() if usable.any() else 0) - PENALTY)
        self.longest = max((len(p.encode()) for p, u in zip(model.pieces, usable, strict=True) if u), default=1)
        self.words: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        marker = MARK.encode()
        self.bytes_of = [p.encode().replace(marker, b" ") for p in model.pieces]
        for i, k in enumerate(model.kinds):
            if k == CONTROL:
                self.bytes_of[i] = b""
            elif k == UNKNOWN:
                self.bytes_of[i] = " ⁇ ".encode()
            elif k == BYTE:
                self.bytes_of[i] = bytes([int(model.pieces[i][3:5], 16)])

    def _hits(self, data: np.ndarray, end: np.ndarray, starts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For the lengths 1, 2 and so on: the bytes at which a piece of that length matches, and which."""
        trie = self.model.trie
        at, state = starts, np.zeros(len(starts), np.int64)
        for k in range(self.longest):
            inside = at + k < end[at]
            at, state = at[inside], state[inside]
            if not len(at):
                return
            nxt = trie.base[state].astype(np.int64) + data[at + k]
            ok = (trie.check[nxt] == state) & (nxt > 0)
            at, state = at[ok], nxt[ok]
            value = trie.value[state]
            hit = value >= 0
            yield at[hit], value[hit]

    def _matches(self, data: np.ndarray, end: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """score and piece of the match of each length (row) at each byte; starts are the bytes that begin a character."""
        score = np.full((self.longest, len(data)), -np.inf, np.float32)
        piece = np.full((self.longest, len(data)), -1, np.int32)
        k = 0
        for at, value in self._hits(data, end, starts):
            score[k, at] = self.model.scores[value]
            piece[k, at] = value
            k += 1
        return score[:k], piece[:k]

    def _long(self, word: bytes) -> np.ndarray:
        """Ids of one long word: the same lattice, window by window, of which the best step into each byte is all that stays."""
        n = len(word)
        best, step, chosen = array("d", [-np.inf]) * (n + 1), array("i", [0]) * (n + 1), array("i", [0]) * (n + 1)
        best[0] = 0.0
        for a in range(0, n, _SLICE):
            data = np.frombuffer(word, np.uint8, min(_SLICE + self.longest, n - a), a)
            starts = np.flatnonzero((data[:_SLICE] & 0xC0) != 0x80)
            found = [(at, np.full(len(at), k + 1), value) for k, (at, value) in enumerate(self._hits(data, np.full(len(data), len(data)), starts))]
            lead = data[starts]
            width = np.minimum(np.where(lead < 0x80, 1, np.where(lead < 0xE0, 2, np.where(lead < 0xF0, 3, 4))), n - a - starts)
            covered = np.zeros(len(data) + 1, bool)
            of_width = np.zeros(len(data) + 1, np.int64)
            of_width[starts] = width
            for at, size, _ in found:
                covered[at[of_width[at] == size]] = True
            bare = ~covered[starts]
            found.append((starts[bare], width[bare], np.full(int(bare.sum()), -1)))
            at, size, value = (np.concatenate(x) for x in zip(*found, strict=True))
            weight = np.where(value >= 0, self.model.scores[value], self.poor).astype(np.float64)
            order = np.argsort(at, kind="stable")
            for s, k, v, w in zip((at + a)[order].tolist(), size[order].tolist(), value[order].tolist(), weight[order].tolist(), strict=True):
                total = best[s] + w
                if total >= best[s + k]:  # of equals the shortest last piece
                    best[s + k], step[s + k], chosen[s + k] = total, k, v
        ids: list[int] = []
        at = n
        while at:
            begin = at - step[at]
            if chosen[at] >= 0:
                ids.append(chosen[at])
            elif self.model.byte_ids is None:
                ids.append(self.model.unknown)
            else:
                ids += [int(self.model.byte_ids[b]) for b in reversed(word[begin:at])]
            at = begin
        return np.array(ids[::-1], "<i4")

    def _viterbi(self, words: list[bytes]) -> list[np.ndarray]:
        """Ids of each word; the words are in order of length, longest first."""
        data = np.frombuffer(b"".join(words), np.uint8)
        size = np.array([len(w) for w in words])
        first = np.cumsum(size) - size
        end = np.repeat(first + size, size)
        starts = np.flatnonzero((data & 0xC0) != 0x80)
        score, piece = self._matches(data, end, starts)
        lead = data[starts]
        width = np.minimum(np.where(lead < 0x80, 1, np.where(lead < 0xE0, 2, np.where(lead < 0xF0, 3, 4))), end[starts] - starts)
        if len(score) < 4:
            more = 4 - len(score)
            score = np.concatenate([score, np.full((more, len(data)), -np.inf, np.float32)])
            piece = np.concatenate([piece, np.full((more, len(data)), -1, np.int32)])
        bare = np.isneginf(score[width - 1, starts])
        score[width[bare] - 1, starts[bare]] = self.poor
        most = int(np.flatnonzero((score > -np.inf).any(1)).max()) + 1
        score, piece = score[:most], piece[:most]
        node = first + np.arange(len(words))
        best = np.full(len(data) + len(words), -np.inf, np.float32)
        back = np.zeros(len(best), np.int32)
        best[node] = 0
        for e in range(1, int(size[0]) + 1):
            m = int(np.searchsorted(-size, -e, "right"))
            span = np.arange(1, min(most, e) + 1)
            begin = e - span
            total = best[node[:m, None] + begin] + score[span - 1, first[:m, None] + begin]
            pick = total.argmax(1)
            best[node[:m] + e] = total[np.arange(m), pick]
            back[node[:m] + e] = span[pick]
        owner, where, ids = [], [], []
        live, at = np.arange(len(words)), size.copy()
        while len(live):
            step = back[node[live] + at[live]]
            at[live] -= step
            begin = first[live] + at[live]
            owner.append(live)
            where.append(at[live].copy())
            ids.append(np.where(piece[step - 1, begin] >= 0, piece[step - 1, begin], -step))
            live = live[at[live] > 0]
        owner, where, ids = (np.concatenate(x) for x in (owner, where, ids))
        order = np.lexsort((where, owner))
        owner, where, ids = owner[order], where[order], ids[order]
        missing = np.flatnonzero(ids < 0)
        if len(missing):
            model = self.model
            if model.byte_ids is None:
                ids[missing] = model.unknown
            else:
                repeat = np.where(ids < 0, -ids, 1)
                begin = np.cumsum(repeat) - repeat
                lane = np.arange(int(repeat.sum())) - np.repeat(begin, repeat)
                o, w, i = (np.repeat(x, repeat) for x in (owner, where, ids))
                ids = np.where(i < 0, model.byte_ids[data[np.minimum(first[o] + w + lane, len(data) - 1)]], i)
                owner = o
        cuts = np.searchsorted(owner, np.arange(1, len(words)))
        return np.split(ids.astype("<i4"), cuts)

    def _learn(self, words: list[str]) -> None:
        coded = sorted(((w.encode(), w) for w in words), key=lambda x: -len(x[0]))
        i = 0
        while i < len(coded) and len(coded[i][0]) > _LONG:
            self.words[coded[i][1]] = self._long(coded[i][0]).tobytes()
            i += 1
        while i < len(coded):
            j, room = i, _SLICE
            while j < len(coded) and (j == i or room >= len(coded[j][0])):
                room -= len(coded[j][0])
                j += 1
            part = coded[i:j]
            self.words.update((w, ids.tobytes()) for (_, w), ids in zip(part, self._viterbi([c for c, _ in part]), strict=True))
            i = j

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text, little-endian 32-bit."""
        return [ids for group in text_groups(texts) for ids in self._encode(group)]

    def _encode(self, texts: list[str]) -> list[bytes]:
        if len(self.words) > KEPT_WORDS:
            self.older, self.words = self.words, {}
        chunks = []
        for text in texts:
            marked = text.replace(" ", MARK)
            if text and self.model.dummy_prefix:
                marked = MARK + marked
            if not self.model.by_words:
                chunks.append([marked] if marked else [])
            elif MARK + MARK in marked or not marked.startswith(MARK):
                chunks.append(_CHUNK.findall(marked))
            else:
                chunks.append([MARK + w for w in marked[1:].split(MARK)])
        known = self.words
        new = {w for c in chunks for w in c if w not in known}
        known.update((w, self.older[w]) for w in new if w in self.older)
        new = [w for w in new if w not in known]
        if new:
            self._learn(new)
        get = self.words.__getitem__
        out = [b"".join(map(get, c)) for c in chunks]
        for w in new:
            if len(w) > _LONG:  # not worth keeping
                del self.words[w]
        return out

    def decode(self, ids: list[bytes]) -> list[str]:
        """Texts of ids; bytes that are no UTF-8 become U+FFFD, and the space that encoding put first goes."""
        out, of = [], self.bytes_of.__getitem__
        for packed in ids:
            text = b"".join(map(of, np.frombuffer(packed, "<i4").tolist()))
            if self.model.dummy_prefix and text.startswith(b" "):
                text = text[1:]
            out.append(text.decode("utf-8", "replace"))
        return out


_segmenters: dict[str, Segmenter] = {}


def _segmenter(path: str) -> Segmenter:
    if path not in _segmenters:
        _segmenters[path] = Segmenter(PieceModel.read(path))
    return _segmenters[path]


def vocabulary(name: str = MODEL) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def encode_pieces(docs: DataFrame, path: str | None = None) -> DataFrame:
    """docs with ``ids`` (binary, little-endian 32-bit) of its text; null text gives null, an empty text no ids.

    ``path`` is the model's file on every executor.  A column ``ids`` of docs is replaced; an empty table gives an empty table.
    """
    path = path or vocabulary()
    others = [c for c in docs.columns if c != "ids"]
    row = docs.select("text", F.struct(*[F.col(f"`{c}`") for c in others if c != "text"]).alias("row"))

    def kernel(part: pa.RecordBatch) -> pa.RecordBatch:
        texts = part.column(0).to_pylist()
        ids = _segmenter(path).encode([t or "" for t in texts])
        return pa.RecordBatch.from_arrays([part.column(1), part.column(0), pa.array([None if t is None else x for t, x in zip(texts, ids, strict=True)], pa.binary())], names=["row", "text", "ids"])

    out = row.mapInArrow(batches(kernel, _ROWS), f"row {row.schema['row'].dataType.simpleString()}, text string, ids binary")
    return out.select(*[F.col("text" if c == "text" else f"row.`{c}`").alias(c) for c in others], "ids")


def decode_pieces(rows: DataFrame, path: str | None = None) -> DataFrame:
    """rows with ``decoded``, the text of its ``ids``; null gives null.  A column ``decoded`` is replaced."""
    path = path or vocabulary()
    others = [c for c in rows.columns if c != "decoded"]
    row = rows.select("ids", F.struct(*[F.col(f"`{c}`") for c in others]).alias("row"))

    def kernel(part: pa.RecordBatch) -> pa.RecordBatch:
        ids = part.column(0).to_pylist()
        texts = _segmenter(path).decode([x or b"" for x in ids])
        return pa.RecordBatch.from_arrays([part.column(1), pa.array([None if x is None else t for x, t in zip(ids, texts, strict=True)], pa.string())], names=["row", "decoded"])

    out = row.mapInArrow(batches(kernel, _ROWS), f"row {row.schema['row'].dataType.simpleString()}, decoded string")
    return out.select(*[F.col(f"row.`{c}`").alias(c) for c in others], "decoded")


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every text, and the text decoded from them: sizes, digests and whether it is the text again.

    The given model is one of merges, so these are the ids of the unigram model whose log scores follow from its ranks (see above), not
    those that merging would give.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = decode_pieces(encode_pieces(docs))
    return out.select(
        "doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_ids"), F.crc32("ids").alias("ids_crc32"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"), F.col("decoded").eqNullSafe(F.col("text")).alias("round_trip"),
    )
