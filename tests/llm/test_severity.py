"""Severity and grade of every document against plain Python: words, their beginnings, and the cumulative link, one text at a time."""

import math
import re

import numpy as np
import pyarrow as pa
import pytest

from saltmarsh.llm import textkernel as K
from saltmarsh.llm import toxicity

SF = "/root/testdata/sf0.001"


def number(beginning, kind, bits):
    """The feature of a word (kind 0), or of its first ``kind`` bytes."""
    words = K.Words(*K.utf8(pa.array([beginning], pa.binary())), K.NO_LETTER)
    return int(K.mix(words.hash_spans(np.array([0]), np.array([len(beginning)])) + np.uint64(kind))[0]) >> (64 - bits)


def plain(text, model):
    found = set()
    for word in re.findall(rb"[a-z\x80-\xff]+", (text or "").lower().encode()):
        found.add(number(word, 0, model.bits))
        found.update(number(word[:n], n, model.bits) for n in model.prefixes if len(word) > n)
    score = sum(model.weights[f] for f in found)
    above = [1 / (1 + math.exp(t - score)) for t in model.thresholds]
    exact = [a - b for a, b in zip([1.0, *above], [*above, 0.0])]
    return sum(above), exact.index(max(exact)), above[0] >= 0.5


def test_every_document_against_plain_python(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    model = toxicity.train_severity_model(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    assert np.count_nonzero(model.weights) > 20 and len(model.thresholds) == 2
    texts = {r.doc_id: r.text for r in docs.collect()}
    got = {r.doc_id: r for r in toxicity.score_severity(docs, model).collect()}
    assert got.keys() == texts.keys()
    for doc_id, text in texts.items():
        severity, grade, toxic = plain(text, model)
        r = got[doc_id]
        assert r.severity == pytest.approx(severity, abs=1e-9) and (r.grade, r.toxic) == (grade, toxic)
    # Severity is the expected grade: the sum of grades times their chances, between none and the highest.
    assert {r.grade for r in got.values()} >= {0} and all(0 <= r.severity <= 2 for r in got.values())
