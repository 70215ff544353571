"""Edits by bits: the same as by the built-in distance and by the grid, and far fewer steps than cells."""

import random

from pyspark.sql import functions as F

from saltmarsh.functions import scoring


def _pairs(n: int, most: int) -> list[tuple[str, str]]:
    rng = random.Random(3)
    text = lambda: "".join(rng.choice("abcé漢😀") for _ in range(rng.randrange(most)))
    pairs = [(text(), text()) for _ in range(n)]
    return [*pairs, *[(a, a[:5] + b[:3] + a[8:]) for a, b in pairs], *[(a, a) for a, _ in pairs]]


def test_counts_of_the_same_path_as_the_grid():
    for a, b in _pairs(300, 90):
        k = scoring._counted(a, b)
        assert sum(k) == scoring._distance(a, b) and k[2] - k[1] == len(b) - len(a)
        if a and b:
            assert scoring._align([a], [b], [sum(k)])[0] == k[0]


def test_columns_are_one_step_for_each_character():
    assert sum(1 for _ in scoring._columns("a" * 5000, "b" * 40)) == 40


def test_long_pairs_take_the_grid(spark, monkeypatch):
    df = spark.createDataFrame([*_pairs(20, 60), (None, "ab"), ("ab", None)], "a string, b string").coalesce(1)
    found = df.select("a", "b", scoring.edit_counts(F.col("a"), F.col("b")).alias("k"), scoring.edit_distance(F.col("a"), F.col("b")).alias("d"), F.levenshtein("a", "b").alias("w")).collect()
    assert all(r.d == r.w and (r.w is None or r.k.substitutions + r.k.deletions + r.k.insertions == r.w) for r in found)
    monkeypatch.setattr(scoring, "_CELLS", 400)
    a, b = zip(*[(r.a, r.b) for r in found if r.w is not None], strict=True)
    import pandas as pd

    grid = scoring._edit_counts.func(pd.Series(a), pd.Series(b), pd.Series([r.w for r in found if r.w is not None]))
    assert [tuple(x) for x in grid.itertuples(index=False)] == [tuple(r.k) for r in found if r.w is not None]
