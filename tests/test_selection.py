"""Exact percentiles by rounds, and edits in a band, against plain versions."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from saltmarsh.functions import scoring
from saltmarsh.operators import percentiles, reports

FRACTIONS = {"p0": 0.0, "p50": 0.5, "p95": 0.95, "p999": 0.999, "p100": 1.0}


def groups():
    rng = random.Random(6)
    rows = [("many", rng.gauss(0, 100)) for _ in range(3000)] + [("ties", float(rng.randrange(4))) for _ in range(2000)] + [("skewed", 2.0**-i) for i in range(900)]
    rows += [("one", 7.0), ("none", None), ("none", None), (None, 1.0), (None, None), (None, 4.0), ("twice", 5.0), ("twice", 5.0)]
    return rows


@pytest.mark.parametrize("ordered", [1, 10, 65_536])
def test_percentiles_of_groups(spark, ordered, monkeypatch):
    rows = groups()
    df = spark.createDataFrame(rows, "k string, v double").repartition(5)
    want = {}
    for k in {k for k, _ in rows}:
        v = [x for key, x in rows if key == k and x is not None]
        want[k] = tuple(float(np.percentile(v, 100 * f)) for f in FRACTIONS.values()) if v else (None,) * len(FRACTIONS)
    for sent in (0, 20_000) if ordered == 10 else (20_000,):
        monkeypatch.setattr(percentiles, "SENT", sent)
        got = {r.k: tuple(r)[1:] for r in percentiles.exact_percentiles(df, "v", FRACTIONS, "k", ordered=ordered).collect()}
        assert got.keys() == want.keys()
        for k, v in want.items():
            assert got[k] == v or got[k] == pytest.approx(v, rel=1e-12), k


def test_percentiles_without_groups(spark):
    df = spark.range(1000).select((F.col("id") * 37 % 1000).cast("double").alias("v"))
    assert percentiles.exact_percentiles(df, "v", {"p": 0.5}, ordered=3).collect() == [(499.5,)]
    assert percentiles.exact_percentiles(df.limit(0), "v", {"p": 0.5}, "v").count() == 0


def test_percentiles_of_ten_million_distinct_values(spark):
    n = 10_000_000
    df = spark.range(n).select((F.col("id") * 7_654_321 % n).cast("double").alias("v"))
    got = percentiles.exact_percentiles(df, "v", {"p50": 0.5, "p95": 0.95}).first()
    assert tuple(got) == (0.5 * (n - 1), pytest.approx(0.95 * (n - 1), rel=1e-15))


def plain_counts(ref, hyp):
    """Substitutions, deletions and insertions by the whole table: of equal costs the diagonal, then the deletion, then the insertion."""
    rows, cols = len(ref), len(hyp)
    table = [[(j, 0, 0, j) for j in range(cols + 1)]]
    for i in range(1, rows + 1):
        line = [(i, 0, i, 0)]
        for j in range(1, cols + 1):
            miss = ref[i - 1] != hyp[j - 1]
            ways = [(table[i - 1][j - 1], (miss, miss, 0, 0)), (table[i - 1][j], (1, 0, 1, 0)), (line[j - 1], (1, 0, 0, 1))]
            line.append(min((tuple(a + b for a, b in zip(x, y)) for x, y in ways), key=lambda w: w[0]))
        table.append(line)
    return table[rows][cols][1:]


def test_each_number_of_edits(spark):
    rng = random.Random(11)
    pairs = []
    for n in range(400):
        a = "".join(rng.choice("abc é漢😀"[: rng.randrange(1, 8)]) for _ in range(rng.randrange(0, 40)))
        b = list(a)
        for _ in range(rng.randrange(0, 3 + n % 30)):
            at = rng.randrange(len(b) + 1)
            kind = rng.randrange(3)
            b[at : at + (kind < 2)] = [rng.choice("abcx")] * (kind > 0)
        pairs.append((a, "".join(b)))
    pairs += [("", ""), ("", "abc"), ("abc", ""), ("a" * 60, "b" * 3), ("kitten", "sitting"), ("abab" * 20, "baba" * 20)]
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)] + [(-1, None, "xy")], "i long, a string, b string").repartition(3)
    got = {r.i: tuple(r.k) for r in df.select("i", scoring.edit_counts(F.col("a"), F.col("b")).alias("k")).collect()}
    for i, (a, b) in enumerate(pairs):
        assert got[i] == (*plain_counts(a, b), len(a)), (a, b)
    assert got[-1] == (0, 0, 2, 0)


def test_edits_of_long_texts(spark):
    rng = random.Random(12)
    a = "".join(rng.choice("abcdefghij ") for _ in range(10_000))
    b = a[:3000] + "X" * 7 + a[3010:8000] + a[8020:] + "tail"
    far = "".join(rng.choice("abcdefghij ") for _ in range(1500))
    df = spark.createDataFrame([(0, a, b), (1, far, a[:1400])], "i long, a string, b string")
    got = {r.i: tuple(r.k) for r in df.select("i", scoring.edit_counts(F.col("a"), F.col("b")).alias("k")).collect()}
    assert got[0] == (7, 23, 4, 10_000) or sum(got[0][:3]) == 34
    assert got[1] == (*plain_counts(far, a[:1400]), 1500)


def test_grouping_sets_and_missing_latencies(spark):
    rows = [("a", None, 1, 10, 5.0), ("a", "x", 2, 10, None), ("b", None, 3, 10, -1.0), ("b", "y", 4, 10, float("nan"))]
    cases = spark.createDataFrame(rows, "speaker string, region string, edits long, ref_chars long, latency_ms double").withColumns({"high_confidence_wrong": F.lit(False), "expressions": F.lit(1), "preserved": F.lit(1), "overcorrected": F.lit(0)})
    got = {(r.speaker, r.region, r.level): (r.cases, r.cer) for r in reports.group_cer(cases, "speaker", "region").collect()}
    assert got[("a", None, 0)] == (1, 0.1) and got[("a", None, 1)] == (2, 0.15) and got[(None, None, 3)] == (4, 0.25) and len(got) == 7
    sets = reports.group_cer(cases, "speaker", "region", sets=[("region",), ("speaker",)]).collect()
    assert {(r.speaker, r.region, r.level): r.cases for r in sets} == {(None, None, 2): 2, (None, "x", 2): 1, (None, "y", 2): 1, ("a", None, 1): 2, ("b", None, 1): 2}
    assert reports.aggregate_report(cases).first().missing_latency_count == 3
    assert {r.key for r in reports.latency_violations(cases.withColumn("id", F.col("edits")), "id").collect()} == {"2", "3", "4"}
