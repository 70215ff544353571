"""Collocations against counting every phrase."""

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from saltmarsh.llm import phrases as P
from saltmarsh.llm import textkernel as K

LOWER = {c: c + 32 for c in range(65, 91)}


def pieces(text):
    for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
        yield re.findall(r"[^\x20\x09]+", piece)


def expected(rows, support, most, top, inside=50):
    count, words = {}, Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for w in pieces(text):
            words[lang] += len(w)
            for k in range(1, most + 1):
                count.setdefault(lang, Counter()).update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, f in count.items():
        candidates = {p: a for p, a in f.items() if len(p) > 1 and a >= support}
        kept = []
        for p, a in candidates.items():
            if any(len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)) and 100 * b >= inside * a for q, b in candidates.items()):
                continue
            score, k = min((1_000_000 * a * a // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
            kept.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        out += [(lang, i, p.decode(), -a, left, right, words[lang], -score) for i, (score, a, p, left, right) in enumerate(sorted(kept)[:top], 1)]
    return sorted(out)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    words = "the The of river stone é Ä 漢字 don't a-b  x cloud ÉTÉ ß".split(" ")
    rows = []
    for i in range(160):
        text = "".join(rng.choice(words) + rng.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n", "\x0b", "; "]) for _ in range(rng.randrange(60)))
        rows.append((rng.choice(["en", "en", "en", "fr", None]), text))
    rows += [("en", rows[0][1])] * 30 + [("en", None), (None, ""), ("de", " .. \t"), ("xx", "once only"), ("und", "und words und words"), ("one", "word " * 4000)]
    return rows


@pytest.mark.parametrize("support, most, top, shards", [(10, 3, 2000, 4), (3, 4, 20, 2), (1, 2, 2000, 1), (40, 3, 5, 7)])
def test_collocations_against_counting(spark, rows, support, most, top, shards):
    docs = spark.createDataFrame(rows, "lang string, text string").withColumns({"n": F.lit(1), "phrase": F.lit("x"), "shard": F.lit(9)}).repartition(4)
    got = sorted(map(tuple, P.collocations(docs, support, most, top, shards=shards).collect()))
    assert got == expected(rows, support, most, top)


def test_empty_tables_and_texts(spark):
    none = spark.createDataFrame([], "lang string, text string")
    assert P.collocations(none).count() == 0
    assert P.collocations(spark.createDataFrame([(None, None), ("en", " ")], "lang string, text string")).count() == 0


def test_exact_beyond_64_bits(spark):
    big = spark.createDataFrame([(10**10, 10**10, 10**10 + 1), (3, 3, 9), (7, 10**9, 10**9)], "a long, l long, r long")
    got = [r[0] for r in big.select(P._score(F.col("a"), F.col("l"), F.col("r"))).collect()]
    assert got == [1_000_000 * 10**20 // (10**10 * (10**10 + 1)), 333_333, 0]


def test_long_texts_are_cut_between_words():
    rng = random.Random(9)
    texts = ["a b", "", "".join(rng.choice(["ab", "c", "é", " ", "  ", ". ", "\n"]) for _ in range(4000)), "x" * 700, " " * 900 + "end", "p q r"]
    data, offsets = K.utf8(pa.array(texts))
    for limit in (16, 100, 1 << 19):
        for k in (1, 2, 3):
            found = Counter()
            for i, d, off, counts in P.parts_of(data, offsets, k - 1, limit):
                grams = P.Grams(d, off, counts)
                plain, begin = grams.plain()
                for at in grams.starts(k).tolist():
                    stop = begin[at + k - 1] + grams.words.end[at + k - 1] - grams.words.start[at + k - 1]
                    found[i + int(grams.text[at]), plain[begin[at] : stop].tobytes().decode()] += 1
            want = Counter((i, " ".join(w[j : j + k])) for i, t in enumerate(texts) for w in pieces(t) for j in range(len(w) - k + 1))
            assert found == want


def test_maps_of_bits():
    keys = np.random.default_rng(1).integers(0, 2**64 - 1, 500, dtype=np.uint64)
    for ranges, bits in ((0, 20), (6, 20)):
        bitmap = bytearray(1 << (bits - 3))
        for number in range(1 << ranges):
            own = keys[(keys >> np.uint64(64 - ranges)).astype(np.int64) == number] if ranges else keys
            own = np.unique(own[:200])
            if len(own):
                body = own.tobytes() + np.full(len(own), 2, "<u4").tobytes() + np.full(len(own), 2, "<u4").tobytes()
                out = P._frequent(ranges, bits)(pa.table({"range": [number], "n": [len(own)], "body": pa.array([body], pa.binary())}))
                piece = out.column("bits")[0].as_py()
                bitmap[number * len(piece) : (number + 1) * len(piece)] = piece
                assert P._marked(np.frombuffer(bytes(bitmap), np.uint8), own).all()
        assert P._marked(np.frombuffer(bytes(bitmap), np.uint8), ~keys).mean() < 0.01
