"""Language identification: multinomial logistic regression on TF-IDF character n-grams.

Document frequencies are counted over all training rows.  The weights come from follow-the-regularised-leader (elastic net) on a
bounded, hash-chosen sample of them, ``per_language`` rows of each language; a fifth of the sample only sets the temperature.
n-grams are hashed into ``1 << bits`` features; a feature's value is its share of the document's n-grams times its inverse
document frequency, so a document's score is a mean over its n-grams and a whole text needs one pass.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textkernel as K
from .common import batches, table, with_answers
from .sparse import Ftrl, Rows

ORDERS, BITS, PER_LANGUAGE, EPOCHS = (1, 2, 3), 15, 600, 4
UNKNOWN = "und"
#: Size of a row of features, in which a mean inverse frequency is about 1.
SCALE = 8.0
U64 = np.uint64
_FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], U64)


def code_points(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All code points of a text column and n + 1 offsets into them; null counts as empty."""
    data, off = K.utf8(texts)
    lead = (data & 0xC0) != 0x80
    at = np.flatnonzero(lead)
    b = data[at].astype(np.uint32)
    size = np.where(b < 0x80, 1, np.where(b < 0xE0, 2, np.where(b < 0xF0, 3, 4)))
    out = np.where(size == 1, b, b & (0x7F >> size))
    last = len(data) - 1
    for k in (1, 2, 3):
        more = np.flatnonzero(size > k)
        out[more] = (out[more] << 6) | (data[np.minimum(at[more] + k, last)] & 0x3F)
    return out.astype(np.uint32), np.searchsorted(at, off)


def grams(points: np.ndarray, offsets: np.ndarray, orders: tuple[int, ...], bits: int):
    """For each order: the features of all n-grams, and for each text where its own begin and end among them."""
    wide = points.astype(U64) + U64(1)
    for n in orders:
        count = len(points) - n + 1
        if count <= 0:
            yield np.zeros(0, np.int64), np.zeros(len(offsets) - 1, np.int64), np.zeros(len(offsets) - 1, np.int64)
            continue
        h = np.full(count, n, U64)
        for k in range(n):
            h += wide[k : k + count] * _FACTORS[k]
        begin = np.minimum(offsets[:-1], count)
        yield (K.mix(h) >> U64(64 - bits)).astype(np.int64), begin, np.maximum(np.minimum(offsets[1:] - n + 1, count), begin)


def _present(orders: tuple[int, ...], bits: int):
    """In how many texts of the batch each feature occurs."""

    def kernel(part: pa.RecordBatch) -> pa.RecordBatch:
        df = np.zeros(1 << bits, np.int64)
        off = K.utf8(part.column(0))[1]
        for i, j in K.slices(off):
            points, o = code_points(part.column(0).slice(i, j - i))
            key = []
            text = np.repeat(np.arange(j - i), np.diff(o))
            for feature, _, _ in grams(points, o, orders, bits):
                n = len(points) - len(feature)
                whole = text[: len(feature)] == text[n:] if n else slice(None)
                key.append((text[: len(feature)][whole] << bits) | feature[whole])
            seen = np.zeros((j - i) << bits, bool) if (j - i) << bits <= 1 << 26 else None
            if seen is not None:
                for k in key:
                    seen[k] = True
                df += seen.reshape(j - i, 1 << bits).sum(0)
            else:
                df += np.bincount(np.unique(np.concatenate(key)) & ((1 << bits) - 1), minlength=1 << bits)
        at = np.flatnonzero(df)
        return pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(df[at])], names=["feature", "df"])

    return kernel


def _counted(orders: tuple[int, ...], bits: int):
    """Features and counts of each text as packed bytes."""

    def kernel(part: pa.RecordBatch) -> pa.RecordBatch:
        packed = []
        for i in range(part.num_rows):
            points, o = code_points(part.column(1).slice(i, 1))
            count = np.zeros(1 << bits, np.int64)
            for feature, _, _ in grams(points, o, orders, bits):
                count += np.bincount(feature, minlength=1 << bits)
            at = np.flatnonzero(count)
            packed.append(np.stack([at, count[at]]).astype(np.int32).tobytes())
        return pa.RecordBatch.from_arrays([part.column(0), pa.array(packed, pa.binary()), part.column(2)], names=["lang", "counts", "h"])

    return kernel


@dataclass
class LanguageModel:
    """weights: (features, languages) with the inverse document frequencies and the temperature worked in."""

    languages: list[str]
    weights: np.ndarray
    bias: np.ndarray
    orders: tuple[int, ...] = ORDERS
    bits: int = BITS

    def probabilities(self, texts: pa.Array) -> np.ndarray:
        out = np.zeros((len(texts), len(self.languages)))
        off = K.utf8(texts)[1]
        for i, j in K.slices(off):
            points, o = code_points(texts.slice(i, j - i))
            total = np.zeros(j - i)
            score = np.zeros((j - i, len(self.languages)))
            for feature, begin, end in grams(points, o, self.orders, self.bits):
                total += end - begin
                some = np.flatnonzero(end > begin)
                if len(some):
                    cuts = np.stack([begin[some], end[some]], 1).reshape(-1)
                    cuts = cuts[:-1] if cuts[-1] == len(feature) else cuts
                    for c in range(len(self.languages)):
                        score[some, c] += np.add.reduceat(self.weights[c][feature], cuts)[::2]
            out[i:j] = score / np.maximum(total, 1)[:, None]
        out += self.bias
        out = np.exp(out - out.max(1, keepdims=True))
        return out / out.sum(1, keepdims=True)


def _softmax(x: np.ndarray) -> np.ndarray:
    x = np.exp(x - x.max(-1, keepdims=True))
    return x / x.sum(-1, keepdims=True)


def fit_multinomial(rows: Rows, y: np.ndarray, features: int, classes: int, epochs: int = EPOCHS, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.02, l2: float = 0.02, seed: int = 5) -> np.ndarray:
    """Weights (features, classes) by FTRL over ``epochs`` passes in shuffled order."""
    model, rng = Ftrl(features, classes, alpha, beta, l1, l2), np.random.default_rng(seed)
    target = np.eye(classes)[y]
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            at, value = rows.row(i)
            w = model.weights(at)
            model.step(at, w, np.outer(value, _softmax(value @ w) - target[i]))
    return model.weights()


def fit_temperature(scores: np.ndarray, y: np.ndarray) -> float:
    """The divisor of the scores with the least log loss, by golden-section search on its logarithm.

    Of n rows, each target keeps 1 / (n + 2) for the other classes, so a fold without errors doesn't call for certainty.
    """
    if not len(y) or scores.shape[1] < 2:
        return 1.0
    rest = 1 / (len(y) + 2)
    target = np.full(scores.shape, rest / (scores.shape[1] - 1))
    target[np.arange(len(y)), y] = 1 - rest

    def loss(t: float) -> float:
        return float(-(target * np.log(_softmax(scores / np.exp(t)) + 1e-300)).sum(1).mean())

    a, b, g = -4.0, 3.0, (5**0.5 - 1) / 2
    for _ in range(40):
        c, d = b - g * (b - a), a + g * (b - a)
        a, b = (a, d) if loss(c) < loss(d) else (c, b)
    return float(np.exp((a + b) / 2))


def train_language_model(docs: DataFrame, learn: Column, per_language: int = PER_LANGUAGE, orders: tuple[int, ...] = ORDERS, bits: int = BITS) -> LanguageModel:
    """Learns from text and lang of the rows of ``docs`` for which ``learn`` holds and both are there; doc_id only deals rows out.

    About ``per_language`` rows of each language are brought to the driver as packed feature counts: the stated bound.
    """
    rows = docs.where(learn).where("lang is not null and text is not null").select("lang", F.lower("text").alias("text"), "doc_id")
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    if not sizes:
        return LanguageModel([], np.zeros((0, 1 << bits)), np.zeros(0), orders, bits)
    total = sum(sizes.values())
    df = np.zeros(1 << bits)
    for r in rows.select("text").mapInArrow(batches(_present(orders, bits)), "feature int, df long").groupBy("feature").agg(F.sum("df").alias("df")).collect():
        df[r["feature"]] = r["df"]
    idf = np.log((1 + total) / (1 + df)) + 1

    place = F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1 << 20)) / float(1 << 20)
    share = F.coalesce(*[F.when(F.col("lang") == name, min(1.0, per_language / n)) for name, n in sizes.items()])
    chosen = rows.where(place < share).select("lang", "text", F.xxhash64("doc_id", F.lit("fold")).alias("h"))
    sample = chosen.mapInArrow(batches(_counted(orders, bits)), "lang string, counts binary, h long").toArrow().sort_by([("h", "ascending"), ("lang", "ascending"), ("counts", "ascending")])
    languages = sorted(set(sample.column("lang").to_pylist()))
    values, y, calibrate = [], [], []
    for h, lang, packed in zip(*(sample.column(c) for c in ("h", "lang", "counts")), strict=True):
        at, count = np.frombuffer(packed.as_py(), np.int32).reshape(2, -1)
        if len(at):
            value = count * idf[at] / count.sum() * SCALE
            # The last feature is the bias.
            values.append((np.append(at, np.int32(1 << bits)), np.append(value.astype(np.float32), np.float32(1))))
            y.append(languages.index(lang.as_py()))
            calibrate.append(h.as_py() % 5 == 0)
    y, calibrate = np.array(y, int), np.array(calibrate, bool)
    fit, kept = (Rows.of([v for v, c in zip(values, calibrate, strict=True) if c == wanted]) for wanted in (False, True))
    del sample, values
    weights = fit_multinomial(fit, y[~calibrate], (1 << bits) + 1, len(languages))
    scores = np.array([value @ weights[at] for at, value in map(kept.row, range(len(kept)))]).reshape(-1, len(languages))
    t = fit_temperature(scores, y[calibrate])
    return LanguageModel(languages, (weights[:-1] * idf[:, None] * SCALE / t).T.copy(), weights[-1] / t, orders, bits)


def identify_languages(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """docs with ``lang_pred`` and ``score`` (0 to 1), read from its text alone; columns of these names are replaced.

    ``und`` with score 0 where text is null, empty or has no letter, and everywhere if the model has seen no language.  Rows
    repeated in whole get the same answer each; an empty table gives an empty table.
    """

    def kernel(texts: pa.Array) -> pa.StructArray:
        known = texts.is_valid().to_numpy(zero_copy_only=False)
        if model.languages:
            p = model.probabilities(texts)
            best = p.argmax(1)
            names = pa.array(np.where(known, np.array(model.languages, object)[best], UNKNOWN), pa.string())
            score = np.where(known, p[np.arange(len(p)), best], 0.0)
        else:
            names, score = pa.array([UNKNOWN] * len(texts), pa.string()), np.zeros(len(texts))
        return pa.StructArray.from_arrays([names, pa.array(score)], ["lang_pred", "score"])

    return with_answers(docs, F.when(F.col("text").rlike(r"\p{L}"), F.lower("text")), kernel, "lang_pred string, score double")


def held_out(doc_id: Column) -> Column:
    """The fifth of the documents that no model learns from; a null id is held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The predicted language of every document; a fifth of the ids is held out of the training."""
    docs = table(spark, sf_dir, "documents")
    model = train_language_model(docs.select("doc_id", "text", "lang"), ~held_out(F.col("doc_id")))
    return identify_languages(docs.select("doc_id", "text", held_out(F.col("doc_id")).alias("held_out")), model).select("doc_id", "held_out", "lang_pred", "score")
