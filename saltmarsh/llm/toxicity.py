"""Toxicity: a cumulative-link ordinal regression from sparse word features to severity grades.

Features are the words of a text (runs of letters, lower case) and their beginnings, hashed; each counts once per text.  One
weight vector serves every threshold: P(grade > k) = sigmoid(score - threshold[k]) with increasing thresholds.  The expected
severity is the sum of these probabilities over k.  The weights are FTRL-proximal with an elastic net, so that most are zero and
a text is scored by the few features that have a weight.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textkernel as K
from .common import batches, forget, saved, table, with_answers
from .sparse import Ftrl, Rows

BITS, PREFIXES, TOXIC_ROWS, CLEAN_ROWS, EPOCHS = 20, (5, 6, 7), 2500, 10_000, 4
#: A feature is learnt if it occurs in at least MIN_ROWS and MIN_SHARE of the sample, and in at most MAX_SHARE of the clean rows.
MIN_ROWS, MIN_SHARE, MAX_SHARE = 3, 5e-4, 0.05
#: The least distance between neighbouring thresholds.
GAP = 0.05
U64 = np.uint64


def features(data: np.ndarray, offsets: np.ndarray, bits: int = BITS, prefixes: tuple[int, ...] = PREFIXES, only: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(text, feature) without repeats, sorted; with ``only`` (a mask over features) just those."""
    words = K.Words(data, offsets, K.NO_LETTER)
    text = words.text_of()
    keys = []
    size = words.end - words.start
    for n in (0, *prefixes):
        some = np.flatnonzero(size > n) if n else slice(None)
        start = words.start[some]
        h = words.hash_spans(start, start + n) if n else words.hash
        feature = (K.mix(h + U64(n)) >> U64(64 - bits)).astype(np.int64)
        owner = text[some]
        if only is not None:
            keep = only[feature]
            feature, owner = feature[keep], owner[keep]
        keys.append((owner << bits) | feature)
    key = np.unique(np.concatenate(keys))
    return key >> bits, key & ((1 << bits) - 1)


@dataclass
class SeverityModel:
    """weights by feature, and increasing thresholds between the grades 0, 1, ..., len(thresholds)."""

    weights: np.ndarray
    thresholds: np.ndarray
    bits: int = BITS
    prefixes: tuple[int, ...] = PREFIXES

    def above(self, texts: pa.Array) -> np.ndarray:
        """P(grade > k) of each text and threshold k."""
        score = np.zeros(len(texts))
        data, off = K.utf8(texts)
        some = self.weights != 0
        for i, j in K.slices(off):
            text, feature = features(data[off[i] : off[j]], off[i : j + 1] - off[i], self.bits, self.prefixes, some)
            score[i:j] = np.bincount(text, self.weights[feature], j - i)
        return 1 / (1 + np.exp(np.clip(self.thresholds - score[:, None], -60, 60)))


def ordinal_slopes(score: float, thresholds: np.ndarray, grade: int) -> tuple[float, np.ndarray]:
    """Slopes of -log P(grade) by the score and by each threshold.

    P(g) = sigmoid(b[g + 1]) - sigmoid(b[g]) with b[k] = threshold[k - 1] - score, open at both ends.
    """
    cut = np.concatenate([[0.0], 1 / (1 + np.exp(-np.clip(thresholds - score, -60, 60))), [1.0]])
    slope = cut * (1 - cut)
    p = max(cut[grade + 1] - cut[grade], 1e-9)
    push = np.zeros(len(cut))
    push[grade + 1] -= slope[grade + 1] / p
    push[grade] += slope[grade] / p
    return (slope[grade + 1] - slope[grade]) / p, push[1:-1]


def in_order(thresholds: np.ndarray, gap: float = GAP) -> np.ndarray:
    """Each threshold at least ``gap`` above the one before; those that are so already stay as they are."""
    out = thresholds.copy()
    for k in range(1, len(out)):
        out[k] = max(out[k], out[k - 1] + gap)
    return out


def fit_ordinal(rows: Rows, grade: np.ndarray, features: int, grades: int, epochs: int = EPOCHS, alpha: float = 0.2, beta: float = 1.0, l1: float = 0.004, l2: float = 0.01, rate: float = 0.3, seed: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds by FTRL (weights) and AdaGrad (thresholds); ``l1`` is for each row."""
    model, rng = Ftrl(features, 1, alpha, beta, l1 * len(rows), l2), np.random.default_rng(seed)
    thresholds, seen = np.linspace(1.0, 3.0, grades - 1), np.zeros(grades - 1)
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            at, value = rows.row(i)
            w = model.weights(at)[:, 0]
            by_score, push = ordinal_slopes(float(value @ w), thresholds, int(grade[i]))
            model.step(at, w[:, None], (value * by_score)[:, None])
            seen += push**2
            thresholds = in_order(thresholds - rate * push / (1 + np.sqrt(seen)))
    return model.weights()[:, 0], thresholds


def severity_grades(rows: Rows, toxic: np.ndarray, words: np.ndarray, features: int) -> np.ndarray:
    """Grades 0, 1 and 2 from yes-or-no labels: 2 where the share of telling features is above the median of the toxic rows.

    A feature tells if it is at least eight times as frequent among toxic rows as among the others, and in three of them.
    """
    bad, good = np.zeros(features, np.int32), np.zeros(features, np.int32)
    for i in range(len(rows)):
        (bad if toxic[i] else good)[rows.row(i)[0]] += 1
    telling = (bad >= 3) & ((bad + 0.5) / (toxic.sum() + 1) >= 8 * (good + 0.5) / ((1 - toxic).sum() + 1))
    share = np.array([telling[rows.row(i)[0]].sum() for i in range(len(rows))]) / np.maximum(words, 1)
    middle = np.median(share[toxic > 0]) if toxic.any() else 0.0
    return np.where(toxic > 0, 1 + (share > middle), 0)


def _present(bits: int, prefixes: tuple[int, ...]):
    """(feature, rows, clean): in how many texts of the batch each feature occurs, and in how many clean ones."""

    def kernel(part: pa.RecordBatch) -> pa.RecordBatch:
        data, off = K.utf8(part.column(2))
        toxic = part.column(1).to_numpy()
        rows, clean = np.zeros(1 << bits, np.int64), np.zeros(1 << bits, np.int64)
        for i, j in K.slices(off):
            text, feature = features(data[off[i] : off[j]], off[i : j + 1] - off[i], bits, prefixes)
            rows += np.bincount(feature, minlength=1 << bits)
            clean += np.bincount(feature[toxic[i:j][text] == 0], minlength=1 << bits)
        at = np.flatnonzero(rows)
        return pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(rows[at]), pa.array(clean[at])], names=["feature", "rows", "clean"])

    return kernel


def _featured(bits: int, prefixes: tuple[int, ...], useful: np.ndarray):
    """(h, toxic, size, features): the number of a text's features, and its useful ones packed as 32-bit numbers."""

    def kernel(part: pa.RecordBatch) -> pa.RecordBatch:
        data, off = K.utf8(part.column(2))
        only = np.zeros(1 << bits, bool)
        only[useful] = True
        size, packed = [], []
        for i in range(part.num_rows):
            _, feature = features(data[off[i] : off[i + 1]], off[i : i + 2] - off[i], bits, prefixes)
            size.append(len(feature))
            packed.append(feature[only[feature]].astype("<i4").tobytes())
        return pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(size, pa.int32()), pa.array(packed, pa.binary())], names=["h", "toxic", "size", "features"])

    return kernel


def train_severity_model(docs: DataFrame, labels: DataFrame, toxic_rows: int = TOXIC_ROWS, clean_rows: int = CLEAN_ROWS, bits: int = BITS, prefixes: tuple[int, ...] = PREFIXES) -> SeverityModel:
    """Learns from the documents that ``labels`` (doc_id, toxic) marks; rows with a null in either are left out.

    Of several labels of an id, one that says toxic wins; of several documents of an id, the least text counts.  About
    ``toxic_rows`` and ``clean_rows`` labelled ids, chosen by a hash, are the sample: the stated bound.  Spark counts the features
    over it, and only the numbers of the useful ones are brought to the driver.  Without toxic or without clean labels every
    document has grade 0.
    """
    known = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max(F.when(F.col("toxic") > 0, 1).otherwise(0)).alias("toxic"))
    sizes = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    empty = SeverityModel(np.zeros(1 << bits), np.array([30.0, 31.0]), bits, prefixes)
    if len(sizes) < 2:
        return empty
    place = F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1 << 20)) / float(1 << 20)
    share = F.when(F.col("toxic") == 1, min(1.0, toxic_rows / sizes[1])).otherwise(min(1.0, clean_rows / sizes[0]))
    chosen = F.broadcast(known.where(place < share))  # about toxic_rows + clean_rows ids with a flag, each once
    texts = docs.where("text is not null").select("doc_id", F.lower("text").alias("text")).join(chosen, "doc_id").groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.min("text").alias("text"))
    texts = saved(texts.select(F.xxhash64("doc_id").alias("h"), "toxic", "text"), "labelled")
    many = {r["toxic"]: r["count"] for r in texts.groupBy("toxic").count().collect()}
    if len(many) < 2:
        return empty
    counts = texts.mapInArrow(batches(_present(bits, prefixes)), "feature int, rows long, clean long").groupBy("feature").agg(F.sum("rows").alias("rows"), F.sum("clean").alias("clean"))
    telling = counts.where((F.col("rows") >= max(MIN_ROWS, MIN_SHARE * sum(many.values()))) & (F.col("clean") <= MAX_SHARE * many[0])).select("feature")
    useful = np.sort(telling.toArrow().column(0).to_numpy())
    sample = texts.mapInArrow(batches(_featured(bits, prefixes, useful)), "h long, toxic int, size int, features binary").toArrow().sort_by([("h", "ascending"), ("features", "ascending")])
    forget(texts)
    toxic, size = sample.column("toxic").to_numpy().astype(float), sample.column("size").to_numpy()
    rows = Rows.packed(sample.column("features"))
    del sample
    weights, thresholds = fit_ordinal(rows, severity_grades(rows, toxic, size, 1 << bits), 1 << bits, 3)
    return SeverityModel(weights, thresholds, bits, prefixes)


def score_severity(docs: DataFrame, model: SeverityModel) -> DataFrame:
    """docs with ``severity`` (expected grade), ``grade`` (of the grades, the likeliest) and ``toxic`` (P(grade > 0) >= 0.5).

    Columns of these names are replaced.  Null or empty text, or text without letters, has the grade of no evidence.  Rows
    repeated in whole get the same answer each; an empty table gives an empty table.
    """
    some = np.flatnonzero(model.weights)
    packed = some, model.weights[some], len(model.weights), model.thresholds, model.bits, model.prefixes

    def kernel(texts: pa.Array) -> pa.StructArray:
        at, value, size, thresholds, bits, prefixes = packed
        weights = np.zeros(size)
        weights[at] = value
        above = SeverityModel(weights, thresholds, bits, prefixes).above(texts)
        exact = -np.diff(np.concatenate([np.ones((len(above), 1)), above, np.zeros((len(above), 1))], 1), axis=1)
        return pa.StructArray.from_arrays([pa.array(above.sum(1)), pa.array(exact.argmax(1).astype(np.int32)), pa.array(above[:, 0] >= 0.5)], ["severity", "grade", "toxic"])

    return with_answers(docs, F.lower("text"), kernel, "severity double, grade int, toxic boolean")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected severity, grade and toxic flag of every document, learnt from the table of labels."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return score_severity(docs, train_severity_model(docs, table(spark, sf_dir, "labels"))).select("doc_id", "severity", "grade", "toxic")
