"""Removal of word windows that occur more than once in a corpus (Rabin-Karp windows, counted in Spark).

A window is ``window`` consecutive words of one document.  Every word that some repeated window covers is removed; windows
are judged on the input.  Two exact filters keep the shuffles small:

1. Each window names its *anchor*: the place of the least hash (the leftmost of equals) among the shorter runs of words
   inside it.  Equal windows have equal anchors at equal distances, so a window whose anchor hash occurs at no other place
   cannot be repeated.  Neighbouring windows mostly share a place; one row stands for such a run of windows, about a tenth
   of the number of windows.
2. Only windows with a repeated anchor are hashed as a whole (128 bits) and counted.

Both are done on distinct texts: all windows of a text that several documents have are repeated anyway.  Before either shuffle
every Arrow batch settles what repeats inside it and sends one row for each hash, so a passage that a third of all documents
share reaches the shuffle once per batch.  The texts themselves are shuffled once, by a hash of theirs, which both the counting and
the removal read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import textkernel as K
from .common import batches, table

WINDOW = 35

_FOUND = "h long, h2 long, twice boolean, k1 long, k2 long, s int, n int"


def _settle(h: np.ndarray, h2: np.ndarray, k1: np.ndarray, k2: np.ndarray, s: np.ndarray, n: np.ndarray, last: np.ndarray, shared: np.ndarray | None = None) -> pa.RecordBatch | None:
    """One row for each hash of the batch, and the rows whose hash repeats inside it.

    h and h2 are one hash of 128 bits.  twice: false: occurs once here, the row says where; true: occurs more than once here.  Rows already settled have a null
    h.  ``last`` marks rows whose predecessor does not touch them, so that settled neighbours are sent as one.  ``shared`` marks
    rows of texts with copies: these count as repeated and are not reported back.
    """
    if not len(h):
        return None
    order = np.lexsort((h2, h)) if h2.any() else np.argsort(h, kind="stable")
    new = np.ones(len(h), bool)
    new[1:] = (h[order][1:] != h[order][:-1]) | (h2[order][1:] != h2[order][:-1])
    at = np.flatnonzero(new)
    count = np.diff(np.append(at, len(h)))
    many = np.zeros(len(h), bool)
    repeated = count > 1
    if shared is not None:
        repeated |= np.logical_or.reduceat(shared[order], at)
    many[order] = np.repeat(repeated, count)
    once = np.flatnonzero(~many)
    heads = order[at[repeated]]
    local = np.flatnonzero(many if shared is None else many & ~shared)
    if len(local):
        cut = last[local].copy()
        cut[0] = True
        cut[1:] |= local[1:] != local[:-1] + 1
        begin = np.flatnonzero(cut)
        length = np.add.reduceat(n[local], begin)
        local = local[begin]
    else:
        length = n[local]
    rows = np.concatenate([once, heads, local])
    sent = np.concatenate([np.zeros(len(once), bool), np.ones(len(heads), bool), np.ones(len(local), bool)])
    size = np.concatenate([n[once], n[heads], length]).astype(np.int32)
    done = np.arange(len(rows)) >= len(once) + len(heads)
    return pa.RecordBatch.from_arrays(
        [pa.array(h[rows].view(np.int64), mask=done), pa.array(h2[rows].view(np.int64), mask=done), pa.array(sent), pa.array(k1[rows]), pa.array(k2[rows]), pa.array(s[rows].astype(np.int32)), pa.array(size)],
        names=["h", "h2", "twice", "k1", "k2", "s", "n"],
    )


def _repeated(found: DataFrame) -> DataFrame:
    """(k1, k2, s, n) of the rows of _settle whose hash occurs at more than one place in all batches."""
    spread = F.when(F.col("h").isNull(), F.xxhash64("k1", "s")).otherwise(F.col("h"))
    keyed = found.withColumn("settled", F.col("h").isNull()).withColumn("h", spread)
    by = Window.partitionBy("h", "h2", "settled")
    # Copies of a text in other batches send the same place again, so what counts is that places differ.
    other = [F.min(c).over(by) != F.max(c).over(by) for c in ("k1", "k2", "s")]
    many = F.max("twice").over(by) | other[0] | other[1] | other[2]
    return keyed.withColumn("many", many).where("settled or (many and not twice)").select("k1", "k2", "s", "n")


def _runs(window: int, gram: int):
    def kernel(part: pa.RecordBatch) -> pa.RecordBatch | None:
        part = part.take(pa.array(np.sort(np.unique(part.column(1).to_numpy(), return_index=True)[1])))
        data, off = K.utf8(part.column(0))
        k1, k2 = (part.column(i).to_numpy() for i in (1, 2))
        out: list[list[np.ndarray]] = []
        for i, j in K.slices(off):
            words = K.Words(data[off[i] : off[j]], off[i : j + 1] - off[i])
            at, text = K.gram_starts(words.first, window)
            if not len(at):
                continue
            grams = K.gram_hashes(words.hash, gram)
            place = K.sliding_argmin(grams, window - gram + 1)[at]
            new = np.ones(len(at), bool)
            new[1:] = (place[1:] != place[:-1]) | (text[1:] != text[:-1])
            run = np.flatnonzero(new)
            first = np.ones(len(run), bool)
            first[1:] = text[run][1:] != text[run][:-1]
            out.append([grams[place[run]], np.zeros(len(run), K.U64), k1[i:j][text[run]], k2[i:j][text[run]], at[run] - words.first[text[run]], np.diff(np.append(run, len(at))), first])
        return _settle(*(np.concatenate(x) for x in zip(*out, strict=True))) if out else None

    return kernel


def _spread(spans: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row number, start and length of every span of a list column."""
    spans = spans.fill_null([]) if spans.null_count else spans
    off = spans.offsets.to_numpy()
    inner = spans.values.slice(off[0], off[-1] - off[0])
    return np.repeat(np.arange(len(spans)), np.diff(off)), inner.field("s").to_numpy(zero_copy_only=False), inner.field("n").to_numpy(zero_copy_only=False)


def _covered(row: np.ndarray, s: np.ndarray, n: np.ndarray, first: np.ndarray, extra: int) -> np.ndarray:
    """True for the words of each span, ``extra`` words past its end included; spans are clipped to their text."""
    total = int(first[-1])
    a = first[row] + s
    b = np.minimum(a + n + extra, first[row + 1])
    marks = np.zeros(total + 1, np.int64)
    np.add.at(marks, a, 1)
    np.add.at(marks, b, -1)
    return np.cumsum(marks)[:total] > 0


def _windows(window: int):
    def kernel(part: pa.RecordBatch) -> pa.RecordBatch | None:
        data, off = K.utf8(part.column(0))
        k1, k2 = (part.column(i).to_numpy(zero_copy_only=False) for i in (1, 2))
        row, s, n = _spread(part.column(3))
        copies = part.column(4).to_numpy() > 1
        out: list[list[np.ndarray]] = []
        shared: list[np.ndarray] = []
        for i, j in K.slices(off):
            words = K.Words(data[off[i] : off[j]], off[i : j + 1] - off[i])
            here = (row >= i) & (row < j)
            wanted = _covered(row[here] - i, s[here], n[here], words.first, 0)
            at, text = K.gram_starts(words.first, window)
            keep = wanted[at]
            at, text = at[keep], text[keep]
            if not len(at):
                continue
            last = np.ones(len(at), bool)
            last[1:] = (text[1:] != text[:-1]) | (at[1:] != at[:-1] + 1)
            hashes = words.hash
            h, h2 = (K.gram_hashes(hashes, window, k)[at] for k in (0, 1))
            out.append([h, h2, k1[i:j][text], k2[i:j][text], at - words.first[text], np.ones(len(at), np.int64), last])
            shared.append(copies[i:j][text])
        return _settle(*(np.concatenate(x) for x in zip(*out, strict=True)), np.concatenate(shared)) if out else None

    return kernel


def _kept(window: int):
    """Text without the words that a window starting in one of the spans covers, and how many words there were."""

    def kernel(part: pa.RecordBatch) -> pa.RecordBatch:
        data, off = K.utf8(part.column(0))
        row, s, n = _spread(part.column(1))
        copies = part.column(2).to_numpy() > 1
        texts: list[bytes] = []
        counts: list[np.ndarray] = []
        removed: list[np.ndarray] = []
        for i, j in K.slices(off):
            body = data[off[i] : off[j]]
            words = K.Words(body, off[i : j + 1] - off[i])
            here = (row >= i) & (row < j)
            gone = _covered(row[here] - i, s[here], n[here], words.first, window - 1) if here.any() else np.zeros(len(words.start), bool)
            total = np.diff(words.first)
            gone |= np.repeat(copies[i:j] & (total >= window), total)
            stay = ~gone
            sums = np.concatenate([[0], np.cumsum(gone)])
            lost = sums[words.first[1:]] - sums[words.first[:-1]]
            counts.append(total)
            removed.append(lost)
            # Bytes of kept words, each followed by one space: mark them on the buffer and take them in one go.
            length = (words.end - words.start)[stay]
            begin = np.cumsum(length + 1) - (length + 1)
            size = int((length + 1).sum())
            owner = np.repeat(np.arange(len(length)), length + 1)
            source = words.start[stay][owner] + (np.arange(size) - begin[owner])
            joined = body[np.minimum(source, max(len(body) - 1, 0))] if size else np.zeros(0, np.uint8)
            if size:
                joined = joined.copy()
                joined[begin + length] = 32
            kept_words = np.concatenate([[0], np.cumsum(stay)])[words.first]
            edge = np.append(begin, size)[kept_words]
            whole = joined.tobytes()
            texts += [whole[a : b - 1] if b > a else b"" for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True)]
        return pa.RecordBatch.from_arrays(
            [pa.array(texts, pa.binary()), pa.array(np.concatenate(counts).astype(np.int64)), pa.array(np.concatenate(removed).astype(np.int64)), *part.columns[3:]],
            names=["kept", "n_words", "n_removed", *part.schema.names[3:]],
        )

    return kernel


def _keys(text: Column) -> list[Column]:
    return [F.xxhash64(text).alias("k1"), F.xxhash64(F.lit("saltmarsh"), text).alias("k2")]


def kept_texts(docs: DataFrame, window: int = WINDOW, gram: int | None = None) -> DataFrame:
    """(k1, k2, kept, n_words, n_removed) for each distinct text; the keys are hashes of the text, kept is binary."""
    gram = gram or (window + 1) // 2
    raw = docs.select(F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    keyed = raw.select("text", *_keys(F.col("text")))
    runs = keyed.mapInArrow(batches(_runs(window, gram)), _FOUND)
    spans = _repeated(runs).groupBy("k1", "k2").agg(F.collect_set(F.struct("s", "n")).alias("spans"))
    texts = keyed.groupBy("k1", "k2").agg(F.first("text").alias("text"), F.count("*").alias("copies"))
    suspects = texts.join(spans, ["k1", "k2"]).select("text", "k1", "k2", "spans", "copies")
    windows = suspects.mapInArrow(batches(_windows(window)), _FOUND)
    found = _repeated(windows).groupBy("k1", "k2").agg(F.collect_list(F.struct("s", "n")).alias("spans"))
    joined = texts.join(found, ["k1", "k2"], "left").select("text", "spans", "copies", "k1", "k2")
    return joined.mapInArrow(batches(_kept(window)), "kept binary, n_words long, n_removed long, k1 long, k2 long")


def substring_dedup(docs: DataFrame, window: int = WINDOW, gram: int | None = None) -> DataFrame:
    """docs with ``kept_text`` (kept words joined by one space), ``n_words`` and ``n_removed`` beside its own columns.

    docs needs doc_id and text; every other column is carried unchanged, and columns of docs named as the new ones are replaced.
    Null text counts as no words; fewer words than ``window`` make no window, so nothing goes.  Rows repeated in whole count as
    documents of their own: each one's windows occur in the other.  An empty table gives an empty table.  Distinct texts are told
    apart, and windows counted, by 128 bits of hash.
    """
    new = ("kept_text", "n_words", "n_removed")
    others = [c for c in docs.columns if c not in new]
    text = F.coalesce("text", F.lit("")).cast("binary")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in others if c != "text"]).alias("row"), *_keys(text))
    out = rows.join(kept_texts(docs, window, gram), ["k1", "k2"])
    return out.select(*[F.col(f"row.`{c}`").alias(c) for c in others if c != "text"], F.col("kept").cast("string").alias("kept_text"), "n_words", "n_removed")


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words removed from, and kept in, every document; windows of 35 words."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    digests = kept_texts(docs).select("k1", "k2", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
    rows = docs.select("doc_id", *_keys(F.coalesce("text", F.lit("")).cast("binary")))
    return rows.join(digests, ["k1", "k2"]).select("doc_id", "n_words", "n_removed", "kept_sha256")


OP6_SQL = r"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), win AS (
  SELECT doc_id, i, sha256(array_to_string(w[i:i+34], ' ')) AS h
  FROM words, unnest(range(1, len(w) - 33)) AS t(i) WHERE len(w) >= 35
), rep AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY h) AS c FROM win) WHERE c > 1
), gone AS (
  SELECT doc_id, list(DISTINCT p) AS ps FROM (SELECT doc_id, unnest(range(i, i + 35)) AS p FROM rep) GROUP BY doc_id
), each AS (
  SELECT d.doc_id, t.p, d.w[t.p] AS word, g.ps IS NOT NULL AND list_contains(g.ps, t.p) AS out
  FROM words d LEFT JOIN gone g USING (doc_id), unnest(range(1, len(d.w) + 1)) AS t(p)
), kept AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY p) FILTER (NOT out) AS k, count(*) FILTER (out) AS n FROM each GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(k.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(k.k, '')) AS kept_sha256
FROM words d LEFT JOIN kept k USING (doc_id)
"""
