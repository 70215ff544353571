"""Normalisation in Python: few texts at once, whatever the size of the batch."""

import tracemalloc
import unicodedata

import pyarrow as pa
from pyspark.sql import functions as F

from saltmarsh.functions import text


def test_few_texts_are_python_objects_at_once():
    texts = pa.array(["漢é" * 5_000 + str(i) for i in range(4_000)] + [None])
    tracemalloc.start()
    out = text._each(texts, lambda x: unicodedata.normalize("NFC", x))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert out.equals(texts) and peak < 20_000_000
    assert text._each(texts.slice(0, 0), str).equals(texts.slice(0, 0))


def test_normal_forms(spark):
    rows = spark.createDataFrame([(None,), ("",), ("abc",), ("Straße Éa \u0301 ſΣς",), ("e\u0301",), ("\u1112\u1161\u11ab ﬁ",)] * 150, "s string").coalesce(1)
    for r in rows.select("s", text.nfkc_casefold(F.col("s")).alias("k"), text.nfc(F.col("s")).alias("n")).collect():
        assert r.k == (None if r.s is None else unicodedata.normalize("NFKC", r.s).casefold()) and r.n == (None if r.s is None else unicodedata.normalize("NFC", r.s))
