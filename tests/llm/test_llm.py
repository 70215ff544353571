"""The operators on large corpora against brute force, exact round trips and planted cases."""

import hashlib
import json
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from saltmarsh.llm import common, language_id, near_dedup, ogg, packing, sentencepiece, sparse, spotsigs, substring_dedup, textkernel, toolcalls, toxicity, warc_fixity
from saltmarsh.llm.components import connected_components

SF = "/root/testdata/sf0.001"
WORDS = "the of and alpha beta gamma delta river stone cloud ember forest north wind lamp harbor signal copper".split()


def passage(rng, n):
    return " ".join(rng.choice(WORDS) + str(rng.randrange(300)) for _ in range(n))


@pytest.fixture(scope="module")
def odd(spark):
    rng = random.Random(4)
    shared = passage(rng, 60)
    rows = [(i, passage(rng, 80), "en", "s", 1) for i in range(12)]
    rows += [(20, None, None, None, None), (21, "", "en", "s", 0), (22, " \n\t ", "de", "s", 3), (23, "12 34 !!", "en", "s", 8), (24, "é" * 5000, "fr", "s", 5000), (25, "a b c", "en", "s", 5)]
    rows += [(30, f"one {shared} two", "en", "s", 1), (31, f"three four {shared} five", "en", "s", 1), (32, "und " * 90, "de", "s", 1)]
    rows += [(40, rows[0][1], "en", "s", 1), (40, rows[0][1], "en", "s", 1), (None, rows[1][1] + " x", "en", "s", 1), (41, rows[2][1].replace("alpha", "omega", 1), "en", "s", 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")


def test_windows_against_brute_force(spark, odd):
    docs = [(r.doc_id, r.text or "") for r in odd.collect()]
    words = [re.findall(r"[^\x20\x09-\x0D]+", t) for _, t in docs]
    for window in (5, 35):
        starts = Counter(tuple(w[i : i + window]) for w in words for i in range(len(w) - window + 1))
        want = Counter()
        for (doc, _), w in zip(docs, words, strict=True):
            gone = {p for i in range(len(w) - window + 1) if starts[tuple(w[i : i + window])] > 1 for p in range(i, i + window)}
            want[(doc, len(w), len(gone), " ".join(x for p, x in enumerate(w) if p not in gone))] += 1
        clash = odd.withColumns({"kept_text": F.lit(1), "spans": F.lit(2), "k1": F.lit(3), "row": F.lit(4)})
        got = substring_dedup.substring_dedup(clash, window)
        assert {"spans", "k1", "row", "lang"} <= set(got.columns)
        assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in got.collect()) == want
    assert substring_dedup.substring_dedup(odd.limit(0)).count() == 0


def shingle_bag(t):
    w = (t or "").lower().split()
    return Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else Counter([tuple(w)] if w else [])


def links_by_brute_force(texts):
    """Pairs of keys of ``texts`` with a weighted Jaccard similarity of 0.8 or more."""
    bags = {k: shingle_bag(t) for k, t in texts.items()}
    df = Counter(s for b in bags.values() for s in b)
    weight = {k: {s: n * np.log1p(len(texts) / df[s]) for s, n in b.items()} for k, b in bags.items()}
    ids, out = list(texts), set()
    for i, a in enumerate(ids):
        for b in ids[:i]:
            least = sum(min(w, weight[b][s]) for s, w in weight[a].items() if s in weight[b])
            if least and least >= 0.8 * (sum(weight[a].values()) + sum(weight[b].values()) - least) - 1e-9:
                out.add((min(a, b), max(a, b)))
    return out


def components_by_brute_force(ids, links):
    parent = {d: d for d in ids}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        x, y = sorted((root(a), root(b)))
        parent[y] = x
    return {d: root(d) for d in ids}


def test_near_duplicates_against_brute_force(spark):
    rng = random.Random(9)
    base = [passage(rng, 120).split() for _ in range(6)]
    rows = []
    for b, words in enumerate(base):
        for k in range(8):
            copy = list(words)
            for _ in range(k % 4):
                copy[rng.randrange(len(copy))] = f"edit{rng.randrange(10**6)}"
            rows.append((100 * b + k, " ".join(copy)))
    rows += [(1000, None), (1001, ""), (1002, ""), (1003, "few words"), (1004, "Few Words")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("node", F.lit("clash"))
    got = {r.doc_id: r.class_id for r in near_dedup.near_duplicates(df).collect()}
    want = components_by_brute_force([d for d, _ in rows], links_by_brute_force(dict(rows)))
    assert got == want
    kept = {r.doc_id for r in near_dedup.keep_one_of_each(df.drop("node")).collect()}
    assert kept == set(want.values())
    assert near_dedup.near_duplicates(df.limit(0)).count() == 0 and near_dedup.keep_one_of_each(df.limit(0)).count() == 0


def test_one_of_each_keeps_rows_without_words(spark):
    rows = [(None, None, 1), (None, "", 1), (None, "  ", 1), (7, None, 1), (7, "", 1), (7, "", 1), (7, "a word", 1), (7, "A Word", 2), (8, "a word", 1), (None, "other", 1), (None, "other", 1)]
    got = Counter((r.doc_id, (r.text or "").lower()) for r in near_dedup.keep_one_of_each(spark.createDataFrame(rows, "doc_id long, text string, row int")).collect())
    assert got == Counter({(None, ""): 2, (None, "  "): 1, (7, ""): 3, (7, "a word"): 1, (None, "other"): 1})


def test_large_group_of_near_copies(spark):
    # A hub that all are like, with variants that are not like each other, beside exact copies of the hub.
    rng = random.Random(21)
    hub = passage(rng, 300).split()
    rows = [(k, " ".join(hub)) for k in range(60)]
    for k in range(100, 190):
        words = list(hub)
        for p in rng.sample(range(0, 300, 5), 7 + k % 9):
            words[p] = f"edit{rng.randrange(10**9)}"
        rows.append((k, " ".join(words)))
    got = {r.doc_id: r.class_id for r in near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == components_by_brute_force([d for d, _ in rows], links_by_brute_force(dict(rows)))
    assert len(set(got.values())) > 1


def nodes_of(spark, rows, similarity=0.8):
    """weighed_texts of (key, text): node, weight, shingles and so on."""
    known = spark.createDataFrame([(bytearray(k.to_bytes(16, "big")), bytearray(t.encode())) for k, t in rows], "node binary, text binary")
    return near_dedup.weighed_texts(known, len(rows), sum(len(t) for _, t in rows), similarity)


def test_exact_join_by_prefixes(spark):
    rng = random.Random(5)
    base, rows = [passage(rng, 150).split() for _ in range(2)], []
    for k in range(160):
        words = list(base[k % 2])
        for _ in range(rng.randrange(5)):
            words[rng.randrange(len(words))] = f"edit{rng.randrange(40)}"
        rows.append((k, " ".join(words[: rng.randrange(138, 151)])))
    nodes = nodes_of(spark, rows)
    members = spark.createDataFrame([(1, bytearray(k.to_bytes(16, "big"))) for k, _ in rows], "bucket long, node binary")
    none = spark.createDataFrame([], "node binary, component binary")
    want = links_by_brute_force(dict(rows))
    pairs = near_dedup._unmet(members, none, nodes, len(rows), 0.8)
    got = {tuple(sorted(int.from_bytes(x, "big") for x in (r.a, r.b))) for r in near_dedup._verified(pairs, nodes, len(rows), 0.8).collect()}
    assert len(want) > 20 and got == want and pairs.count() < len(rows) * (len(rows) - 1) // 4


def test_weights_have_the_real_document_frequencies(spark):
    # 1000 documents in several groups and ranges, so that frequencies come from many of them.
    rng = random.Random(12)
    shared = {n: passage(rng, 40) for n in (2, 3, 5, 30, 400)}
    docs = [passage(rng, 20) + "".join(" " + p for n, p in shared.items() if k % 1000 < n) for k in range(1000)]
    counts = Counter()
    for t in docs:
        counts.update(shingle_bag(t).keys())
    near_dedup.GROUP_BYTES, near_dedup.RANGE_BYTES, before = 100_000, 150_000, (near_dedup.GROUP_BYTES, near_dedup.RANGE_BYTES)
    try:
        got = {int.from_bytes(r.node, "big"): r for r in nodes_of(spark, list(enumerate(docs)), 0.0).collect()}
    finally:
        near_dedup.GROUP_BYTES, near_dedup.RANGE_BYTES = before
    assert len(got) == len(docs)
    for k, t in enumerate(docs):
        bag = shingle_bag(t)
        assert got[k].weight == pytest.approx(sum(n * np.log1p(len(docs) / counts[s]) for s, n in bag.items()))
        assert sorted(np.frombuffer(got[k].dfs, "<u4")) == sorted(counts[s] for s in bag if counts[s] > 1)


def test_links_follow_the_real_document_frequencies(spark):
    # Both texts share 85 shingles of weight log(1 + N / 4) and differ in 9 each of log(1 + N): 0.8 or more only where all weigh alike.
    rng = random.Random(13)
    shared = passage(rng, 89)
    rows = [(0, f"{shared} {passage(rng, 9)}"), (1, f"{shared} {passage(rng, 9)}"), *((k, f"{shared} {passage(rng, 400)}") for k in (2, 3))]
    rows += [(k, passage(rng, 12)) for k in range(10, 1010)]
    got = {r.doc_id: r.class_id for r in near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {d: d for d, _ in rows}


def test_join_that_spreads_hot_keys(spark):
    left = spark.createDataFrame([(1, i) for i in range(50)] + [(k, k) for k in range(2, 30)] + [(None, 7)] * 20, "k int, v int")
    right = spark.createDataFrame([(k, f"r{k}") for k in range(0, 20)], "k int, name string")
    for share in (5, 1000):
        got = Counter((r.k, r.v, r.name) for r in common.join_spread(left, right, "k", share).collect())
        assert got == Counter((r.k, r.v, f"r{r.k}" if r.k is not None and r.k < 20 else None) for r in left.collect())


def test_components(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 160)] + [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(40)] + [(5, 5), (None, 3)]
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        return x if parent[x] == x else root(parent[x])

    for a, b in edges:
        if a is not None and b is not None and a != b:
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a int, b int")).collect()}
    assert got == {x: root(x) for x in list(parent)}


def test_sampler_matches_similarity():
    sample = near_dedup.Sampler(600)
    shingles = textkernel.mix(np.arange(1, 401, dtype=np.uint64)) & np.uint64((1 << 48) - 1)
    a, b = shingles[:300], shingles[60:360]
    wa, wb = np.ones(300), np.where(np.arange(300) % 3 == 0, 2.0, 1.0)
    x, y = (sample(np.array([0]), s, w)[0] for s, w in ((a, wa), (b, wb)))
    inside = dict(zip(a.tolist(), wa, strict=True)), dict(zip(b.tolist(), wb, strict=True))
    keys = inside[0].keys() | inside[1].keys()
    want = sum(min(inside[0].get(k, 0), inside[1].get(k, 0)) for k in keys) / sum(max(inside[0].get(k, 0), inside[1].get(k, 0)) for k in keys)
    assert abs((x == y).mean() - want) < 0.06


def test_language_id(spark, odd):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = language_id.train_language_model(docs, ~language_id.held_out(F.col("doc_id")))
    out = language_id.identify_languages(docs.where(language_id.held_out(F.col("doc_id"))), model)
    assert out.where("lang_pred = lang").count() >= 0.9 * out.count()
    rest = {r.doc_id: (r.lang_pred, r.score) for r in language_id.identify_languages(odd.withColumn("row", F.lit(1)), model).where("doc_id between 20 and 25").collect()}
    assert all(rest[k] == ("und", 0.0) for k in (20, 21, 22, 23)) and rest[25][0] in model.languages
    assert all(0 <= s <= 1 for _, s in rest.values())
    empty = language_id.train_language_model(docs.limit(0), F.lit(True))
    assert {r.lang_pred for r in language_id.identify_languages(odd, empty).collect()} == {"und"}


def test_code_points():
    texts = ["aé한😀", "", None, "x"]
    points, off = language_id.code_points(pa.array(texts))
    assert [points[a:b].tolist() for a, b in zip(off[:-1], off[1:], strict=True)] == [[ord(c) for c in t or ""] for t in texts]


def test_toxicity(spark, odd):
    rng = random.Random(1)
    rows = [(i, passage(rng, 30) + (" vilest" * (1 + i % 5) if i % 4 == 0 else ""), int(i % 4 == 0)) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.train_severity_model(df.select("doc_id", "text"), df.where("doc_id < 300").select("doc_id", "toxic"))
    out = toxicity.score_severity(df.withColumnRenamed("toxic", "y"), model).where("doc_id >= 300").collect()
    assert sum(r.toxic == (r.y == 1) for r in out) >= 0.97 * len(out) and all(0 <= r.severity <= 2 for r in out)
    assert (np.diff(model.thresholds) > 0).all()
    assert toxicity.score_severity(odd, model).count() == odd.count()
    none = toxicity.train_severity_model(df.select("doc_id", "text"), df.select("doc_id", F.lit(None).cast("int").alias("toxic")))
    assert not toxicity.score_severity(odd, none).where("toxic").count()


def plain_ftrl(steps, features, outputs, alpha, beta, l1, l2):
    """Weights after steps of (features, gradient of each output by the weights), one coordinate at a time."""
    z, n = np.zeros((features, outputs)), np.zeros((features, outputs))

    def weight(i, k):
        return 0.0 if abs(z[i, k]) <= l1 else -(z[i, k] - np.sign(z[i, k]) * l1) / ((beta + n[i, k] ** 0.5) / alpha + l2)

    for at, gradient_of in steps:
        w = np.array([[weight(i, k) for k in range(outputs)] for i in at])
        for j, (i, g) in enumerate(zip(at, gradient_of(w), strict=True)):
            for k in range(outputs):
                sigma = ((n[i, k] + g[k] ** 2) ** 0.5 - n[i, k] ** 0.5) / alpha
                z[i, k] += g[k] - sigma * w[j, k]
                n[i, k] += g[k] ** 2
    return np.array([[weight(i, k) for k in range(outputs)] for i in range(features)])


def test_ftrl_against_plain_steps():
    rng = np.random.default_rng(6)
    made = [(np.sort(rng.choice(12, 4, replace=False)), rng.random(4)) for _ in range(40)]
    y = rng.integers(0, 3, 40)
    got = language_id.fit_multinomial(sparse.Rows.of(made), y, 12, 3, epochs=2, l1=0.5)
    order = np.random.default_rng(5)
    rows = [i for _ in range(2) for i in order.permutation(40)]

    def step(i):
        at, value = made[i]

        def gradient(w):
            score = [sum(v * w[j][k] for j, v in enumerate(value)) for k in range(3)]
            p = np.exp(score) / np.exp(score).sum()
            return [[v * (p[k] - (y[i] == k)) for k in range(3)] for v in value]

        return at, gradient

    assert np.allclose(got, plain_ftrl([step(i) for i in rows], 12, 3, 0.5, 1.0, 0.5, 0.02)) and (got == 0).any() and (got != 0).any()


def test_temperature_against_a_grid():
    rng = np.random.default_rng(2)
    y = rng.integers(0, 4, 500)
    scores = 6 * (np.eye(4)[y] + rng.normal(0, 0.6, (500, 4)))
    rest = 1 / 502
    target = np.where(np.eye(4)[y] > 0, 1 - rest, rest / 3)

    def loss(t):
        p = np.exp(scores / t - (scores / t).max(1, keepdims=True))
        return -(target * np.log(p / p.sum(1, keepdims=True))).sum(1).mean()

    grid = np.exp(np.linspace(-4, 3, 7001))
    assert language_id.fit_temperature(scores, y) == pytest.approx(grid[np.argmin([loss(t) for t in grid])], rel=0.01)
    assert language_id.fit_temperature(np.zeros((0, 4)), np.zeros(0, int)) == 1.0


def test_ordinal_thresholds_and_slopes():
    for n in (1000, 12_500):
        rows = sparse.Rows(np.zeros(n + 1, np.int64), np.zeros(0, np.int32), None)
        _, t = toxicity.fit_ordinal(rows, np.repeat([0, 1, 2], [n * 8 // 10, n // 10, n // 10]), 4, 3)
        assert np.abs(t - np.log([4, 9])).max() < 0.1
    assert toxicity.in_order(np.array([1.0, 2.0])).tolist() == [1.0, 2.0] and toxicity.in_order(np.array([1.0, 0.0]))[1] == 1.0 + toxicity.GAP
    t, e = np.array([0.7, 1.9]), 1e-6

    def loss(score, t, g):
        p = np.concatenate([[0], 1 / (1 + np.exp(score - t)), [1]])
        return -np.log(p[g + 1] - p[g])

    for g in range(3):
        for score in (-1.0, 0.4, 3.0):
            by_score, push = toxicity.ordinal_slopes(score, t, g)
            assert by_score == pytest.approx((loss(score + e, t, g) - loss(score - e, t, g)) / (2 * e), abs=1e-5)
            assert push == pytest.approx([(loss(score, t + e * u, g) - loss(score, t - e * u, g)) / (2 * e) for u in np.eye(2)], abs=1e-5)


def test_toxicity_of_odd_tables(spark, odd):
    docs = spark.createDataFrame([(i, "kind words here" if i % 2 else "vile words here") for i in range(40)] + [(1, "vile vile")] * 3, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 0 if i % 2 else 1) for i in range(40)] + [(0, 0), (2, None), (None, 1)] + [(3, 0)] * 50, "doc_id long, toxic int")
    model = toxicity.train_severity_model(docs, labels)
    again = toxicity.train_severity_model(docs, labels.distinct())
    assert np.array_equal(model.weights, again.weights) and np.array_equal(model.thresholds, again.thresholds)
    clash = docs.withColumns({"severity": F.lit("mine"), "h": F.lit(1), "row": F.lit(2)})
    out = toxicity.score_severity(clash, model)
    assert set(out.columns) == {"doc_id", "text", "h", "row", "severity", "grade", "toxic"} and out.count() == docs.count()
    assert toxicity.score_severity(docs.limit(0), model).count() == 0


def plain_crc(data):
    r = 0
    for x in data:
        r ^= x << 24
        for _ in range(8):
            r = ((r << 1) ^ 0x04C11DB7) & 0xFFFFFFFF if r & 0x80000000 else (r << 1) & 0xFFFFFFFF
    return r


def test_ogg(spark, odd):
    rng = random.Random(3)
    raw = bytes(rng.randrange(256) for _ in range(576 * 130))
    assert ogg.checksum(raw[:999]) == plain_crc(raw[:999])
    media = ogg.multiplex(raw)
    assert ogg.describe(media)[0] == raw and "errors=0" in ogg.describe(media)[1]
    for frame, n, streams in ((288, 301, 2), (1152, 301, 2), (1152, 40, 2), (100, 7, 3), (600, 65, 1)):
        some = raw[: 100 + frame * n % 5000] + bytes(frame * n - 100)
        assert ogg.describe(ogg.multiplex(some, frame=frame, streams=streams))[0] == some
        assert "errors=0" in ogg.describe(ogg.multiplex(some, frame=frame, streams=streams))[1]
    # A lost page takes its packets with it; all others keep their timestamps.
    long_signal = bytes(rng.randrange(256) for _ in range(288 * 400))
    whole = ogg.multiplex(long_signal, frame=288)
    at = [m.start() for m in re.finditer(b"OggS", whole)]
    times = [{(n, t, end): p for t, n, end, p in ogg.timeline(ogg.demultiplex(x)[0])} for x in (whole, whole[: at[3]] + whole[at[4] :])]
    assert len(times[0]) == 400 and len(times[1]) == 336 and times[1].items() <= times[0].items()
    assert min(times[0])[1:] == (0.0, 288 / ogg.RATE)
    broken = bytearray(media)
    broken[len(media) // 2] ^= 1
    assert "errors=0" not in ogg.describe(bytes(broken))[1]
    long = ogg.write_stream([b"x" * 200_000, b"y" * 255, b""], [1, 2, 3], 7, b"h")
    streams, _ = ogg.demultiplex(b"".join(long))
    assert [len(p) for p in streams[0].packets] == [1, 200_000, 255, 0] and streams[0].granules[-1] == 3
    got = ogg.inspect_ogg(ogg.encode_ogg(odd)).collect()
    texts = [(r.text or "").encode() for r in odd.collect()]
    want = Counter()
    for t in texts:
        payload = t + b"\xff" * (-len(t) % 576 if t else 576)
        want[(len(t), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))] += 1
    assert Counter((r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in got) == want
    assert ogg.describe(b"junk")[0] == b"" and ogg.inspect_ogg(spark.createDataFrame([(None,)], "media binary")).first().feature is None


def test_sentencepiece(spark, odd):
    from sentencepiece import SentencePieceProcessor
    from sentencepiece import sentencepiece_model_pb2 as pb

    model = sentencepiece.PieceModel.read(sentencepiece.vocabulary())
    mine = sentencepiece.Segmenter(model)
    proto = pb.ModelProto()
    with open(sentencepiece.vocabulary(), "rb") as f:
        proto.ParseFromString(f.read())
    proto.trainer_spec.model_type = pb.TrainerSpec.UNIGRAM
    for piece, score in zip(proto.pieces, model.scores, strict=True):
        piece.score = float(score)
    theirs = SentencePieceProcessor(model_proto=proto.SerializeToString())
    texts = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()] + ["", "  a  b ", "héllo ☃ 😀", "\n\ta", " ", "日本語", "   "]
    ids = [np.frombuffer(x, "<i4").tolist() for x in mine.encode(texts)]
    for t, x in zip(texts, ids, strict=True):
        y = theirs.encode(t)
        cost = lambda z: sum(float(model.scores[i]) for i in z)
        assert x == y or cost(x) == pytest.approx(cost(y), rel=1e-5, abs=1e-2)  # ties, and sums of 32-bit numbers
    assert mine.decode(mine.encode(texts)) == texts
    out = sentencepiece.decode_pieces(sentencepiece.encode_pieces(odd)).collect()
    assert all(r.decoded == r.text for r in out)
    trie = sentencepiece.DoubleArray.build([b"a", b"ab", b"b"], [0, 1, 2])
    state = trie.base[0] + ord("a")
    assert trie.check[state] == 0 and trie.value[state] == 0


def test_long_words(monkeypatch):
    import time

    model = sentencepiece.PieceModel.read(sentencepiece.vocabulary())
    rng = random.Random(11)
    words = ["".join(rng.choice(a) for _ in range(n)) for a in ("abcdeéß", "日本語ab", "the", "x😀\x07") for n in (1, 7, 300, 900)]
    whole = sentencepiece.Segmenter(model)._viterbi
    windows = sentencepiece.Segmenter(model)
    cost = lambda ids: sum(float(model.scores[i]) for i in ids)
    for size in (64, 1 << 16):
        monkeypatch.setattr(sentencepiece, "_SLICE", size)
        for w in words:
            a, b = whole([w.encode()])[0].tolist(), windows._long(w.encode()).tolist()
            assert a == b or cost(a) == pytest.approx(cost(b), rel=1e-5)  # sums of 32-bit numbers against 64
            assert windows.decode([np.array(b, "<i4").tobytes()]) == [w]
    text = "".join(rng.choice("abcdefghij") for _ in range(300_000))
    began = time.perf_counter()
    ids = windows.encode([text, "a b"])
    assert windows.decode(ids) == [text, "a b"] and time.perf_counter() - began < 30 and not any(len(w) > 5000 for w in windows.words)


def test_models_with_a_normaliser_are_refused(tmp_path):
    from sentencepiece import sentencepiece_model_pb2 as pb

    proto = pb.ModelProto()
    with open(sentencepiece.vocabulary(), "rb") as f:
        proto.ParseFromString(f.read())
    proto.normalizer_spec.remove_extra_whitespaces = True
    (tmp_path / "m").write_bytes(proto.SerializeToString())
    with pytest.raises(ValueError):
        sentencepiece.PieceModel.read(str(tmp_path / "m"))


def test_packing(spark, odd):
    from tokenizers import Tokenizer

    docs = odd.where("doc_id is not null").dropDuplicates(["doc_id"])
    out = packing.packed_documents(docs).collect()
    encode = Tokenizer.from_file(packing.vocabulary())
    ids = {r.doc_id: [*encode.encode(r.text or "", add_special_tokens=False).ids, 2] for r in docs.collect()}
    sequences = {}
    for r in out:
        assert zlib.crc32(np.array(ids[r.doc_id][r.start : r.start + r.length], "<u4").tobytes()) == r.ids_crc32
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert sum(r.length for r in out) == sum(map(len, ids.values()))
    for group in sequences.values():
        at = 0
        for offset, length in sorted(group):
            assert offset == at
            at += length
        assert at <= 1024
    rng = np.random.default_rng(0)
    histogram = np.bincount(np.minimum(rng.geometric(0.004, 30_000), 1024), minlength=1025)
    plan = packing.make_plan(histogram)
    used = np.zeros(1025, np.int64)
    for pattern, n in zip(plan.lengths, plan.count, strict=True):
        assert sum(pattern) <= 1024 and n > 0
        np.add.at(used, list(pattern), n)
    assert (used == histogram).all() and sum(plan.count) <= 1.01 * -(-(np.arange(1025) * histogram).sum() // 1024)
    assert packing.packed_documents(odd.limit(0)).count() == 0


def test_spotsigs(spark, odd):
    rows = sorted(((r.doc_id, r.text or "") for r in odd.where("doc_id is not null").dropDuplicates(["doc_id"]).collect()))
    got = {r.doc_id: r for r in spotsigs.edited_fingerprints(odd.where("doc_id is not null").dropDuplicates(["doc_id"])).collect()}
    anchors = set(spotsigs.ANCHORS.split())

    def sigs(t):
        w = re.findall(r"[^\W_]+", t.lower())
        content = [i for i, x in enumerate(w) if x not in anchors]
        found = {f"{w[i]} {w[j]}" for i, j in zip(content, content[1:]) if i and w[i - 1] in anchors}
        return {hashlib.md5(x.encode()).hexdigest()[:12] for x in found or ({"=" + " ".join(w)} if w else set())}

    for k, (doc, t) in enumerate(rows):
        after = rows[(k + 1) % len(rows)][1]
        q = len(t) // 4
        edited = t[: len(t) - q] + after[:q]
        a, b, c = sigs(t), sigs(edited), sigs(after)
        like = lambda x, y: 1.0 if not x | y else len(x & y) / len(x | y)
        r = got[doc]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        of = lambda x: {x[i : i + 12] for i in range(0, len(x), 12)}
        assert (r.fingerprint, r.edited_fingerprint) == ("".join(sorted(a)), "".join(sorted(b)))
        assert r.near_edited == pytest.approx(like(of(r.fingerprint), of(r.edited_fingerprint)), abs=1e-8)
        assert r.near_next == pytest.approx(like(a, c), abs=1e-8)
    assert spotsigs.edited_fingerprints(odd.limit(0)).count() == 0 and spotsigs.edited_fingerprints(odd).count() == odd.count()
    assert "Python" not in spotsigs.edited_fingerprints(odd)._jdf.queryExecution().toString()


def test_likeness_of_sets_of_unlike_lengths(spark):
    df = spark.createDataFrame([(["a", "b"], ["a", *[f"x{i}" for i in range(59)]]), ([], []), (["a"], [])], "a array<string>, b array<string>")
    assert [r[0] for r in df.select(spotsigs.likeness(F.col("a"), F.col("b"))).collect()] == [pytest.approx(1 / 61), 1.0, 0.0]


def test_alike_fingerprints_by_partition(spark):
    rng = random.Random(8)
    texts = []
    for _ in range(6):
        base = [f"the {rng.choice(WORDS)}{rng.randrange(99)} {rng.choice(WORDS)}{rng.randrange(99)}" for _ in range(60)]
        for k in range(10):
            texts.append(" ".join(x for x in base if rng.random() > 0.01 * k))
    rows = [*enumerate(texts), (500, texts[0]), (501, None), (502, "!"), (None, texts[3])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    sets = {}
    for r in df.where("doc_id is not null").select("doc_id", spotsigs.signatures(F.col("text")).alias("s")).orderBy("doc_id").collect():
        if r.s:
            sets.setdefault(frozenset(r.s), r.doc_id)
    want = {(min(i, j), max(i, j)) for x, i in sets.items() for y, j in sets.items() if i < j and len(x & y) >= 0.8 * len(x | y)}
    found = spotsigs.alike_pairs(df)
    assert {(r.a, r.b) for r in found.collect()} == want and len(want) > 20
    assert "Python" not in found._jdf.queryExecution().toString() and spotsigs.alike_pairs(df.limit(0)).count() == 0


CALLS = "call_id string, tool string, arguments string, parents array<string>"


def test_tool_calls(spark):
    calls = [("a", "search", '{"query":"x","limit":3}', None), ("b", "search", '{ "limit" : 0, "query":"y" }', ["a"]), ("c", "nope", "{}", ["b", "b", None]), ("d", "search", "bad", ["zzz"]), ("p", "search", None, ["q"]), ("q", "summarise", "[1]", ["p"]), (None, None, "{}", None)]
    calls += [(f"k{i}", "search", '{"query":"k","limit":1,"exact":"no"}', [f"k{i - 1}"]) for i in range(1, 40)]
    calls += [("a", "search", '{"query":"again","limit":1}', []), ("below", "search", "{}", ["p", "a"])]
    odd = spark.createDataFrame(calls, CALLS).withColumns({"level": F.lit(1), "up": F.lit(2), "content": F.lit(3)})
    got = toolcalls.link_tool_calls(odd, spark.createDataFrame([("a", "r1"), ("a", "r0"), ("z", "x"), (None, "n")], "call_id string, content string"), toolcalls.TOOLS).collect()
    assert len(got) == len(calls) and sum(r.call_id == "a" for r in got) == 2
    got = {r.call_id: r for r in got if "again" not in r.canonical}
    assert json.loads(got["a"].canonical) == {"arguments": {"limit": 3, "query": "x"}, "id": "a", "result": "r0", "tool": "search"} and got["a"].n_results == 2 and got["a"].status == "linked"
    assert (got["b"].level, got["b"].errors) == (1, "limit: below 1") and got["c"].errors == "no such tool: nope" and got["c"].level == 2 and got["d"].errors == "not JSON" and got["d"].level == 0
    assert got["p"].cyclic and got["q"].cyclic and got["p"].level is None and got["q"].errors == "not an object" and got["below"].cyclic and got["below"].level is None
    assert got["k39"].level == 38 and got["k5"].errors == "exact: not boolean" and got[None].level is None and not got[None].cyclic
    none = spark.createDataFrame([], CALLS)
    assert toolcalls.link_tool_calls(none, none.select("call_id", F.col("tool").alias("content")), toolcalls.TOOLS).count() == 0


def test_levels_of_graphs_against_brute_force(spark):
    rng = random.Random(17)
    calls = {f"c{i}": {f"c{rng.randrange(i)}" for _ in range(rng.randrange(4))} if i else set() for i in range(120)}
    calls |= {f"h{i}": {"c0"} for i in range(60)}  # one call that very many use
    calls |= {"x": {"y", "c3"}, "y": {"z"}, "z": {"x"}, "under": {"x", "c1"}}
    levels = {}

    def level(c, way=()):
        if c in way:
            return None
        if c not in levels:
            above = [level(p, (*way, c)) for p in calls[c]]
            levels[c] = None if None in above else max(above, default=-1) + 1
        return levels[c]

    for c in calls:
        if c not in ("x", "y", "z", "under"):
            level(c)
    rows = [(c, None, None, sorted(p)) for c, p in calls.items()]
    got = {r.call_id: (r.level, r.cyclic) for r in toolcalls.call_levels(spark.createDataFrame(rows, CALLS)).collect()}
    assert got == {c: (levels.get(c), c not in levels) for c in calls}


def test_canonical_json(spark):
    digits = "12345678901234567890123456789012345678901234567890"
    cases = {
        '{"b": 1e2, "a": 100.0}': '{"a":100,"b":100}', "[2.0, -0, 0.10, 1E-7, 0.000001]": "[2,0,0.1,1e-7,0.000001]", digits: f"1.234567890123456789012345678901234567890123456789e+49", "1e400": "1e+400", '{"a":1,"a":2}': None, "01": None, "1.": None, "nope": None, "": None,
        '{"n1": "n2", "s": "a \\"1\\" \\\\", "t": [true, null, "x 5, 6"]}': '{"n1":"n2","s":"a \\"1\\" \\\\","t":[true,null,"x 5, 6"]}', "123456789012345678901": "123456789012345678901", "-12.50e1": "-125", '"é\\u0041"': '"éA"',
    }
    df = spark.createDataFrame([(k,) for k in cases] + [(None,)], "t string")
    got = {r.t: r.c for r in df.select("t", toolcalls.canonical_json(F.col("t")).alias("c")).collect()}
    assert got == cases | {None: None}


def test_schemas(spark):
    schema = {
        "type": "object", "required": ["who", "tags"], "additionalProperties": False,
        "properties": {
            "who": {"type": "object", "properties": {"name": {"type": "string", "pattern": "^[a-z]+$", "maxLength": 5}, "age": {"type": "integer", "minimum": 0, "maximum": 150}}, "required": ["name"]},
            "tags": {"type": "array", "items": {"type": "string", "enum": ["x", "y"]}, "minItems": 1}, "mode": {"enum": ["on", 1, None, True]}, "size": {"type": ["number", "null"]},
        },
    }
    cases = {
        '{"who":{"name":"bob","age":3},"tags":["x","y"],"mode":1,"size":2.5}': "", '{"who":{"name":"bob","age":30000000000000000000000},"tags":["x"],"mode":"on"}': "who.age: above 150",
        '{"who":{"age":-1.5},"tags":[]}': "tags: fewer than 1; who.age: not integer; who.name: missing", '{"who":{"name":"Bob Bobson","age":1e1},"tags":["x","z",3]}': "tags[]: none of its values; tags[]: not string; who.name: longer than 5; who.name: not like its pattern",
        '{"who":[],"tags":"x","more":1,"mode":false,"size":"2"}': "mode: none of its values; more: unknown; size: not number or null; tags: not array; who: not object", "{}": "tags: missing; who: missing", "[]": "not an object", "{": "not JSON",
    }
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    got = {r.t: r.e for r in df.select("t", F.array_join(toolcalls.argument_errors(F.lit("f"), F.col("t"), {"f": schema}), "; ").alias("e")).collect()}
    assert got == cases


def test_fixity(spark):
    rows = [(i, f"record {i}") for i in range(300)]
    harmed = [(i, t + "!" if i in (7, 250) else t) for i, t in rows[:-1]]
    a, b = (warc_fixity.merkle_tree(spark.createDataFrame(x, "key long, record string"), 4) for x in (rows, harmed))
    found = warc_fixity.audit(a, b, 4).where("level = 0").collect()
    shifted = {r.node for r in found}
    assert {7, 250, 299} <= shifted and next(r for r in found if r.node == 299).replica_digest is None
    assert warc_fixity.audit(a, a, 4).count() == 1
    # The root by brute force.
    level = [hashlib.sha256(t.encode()).hexdigest() for _, t in rows]
    while len(level) > 1:
        level = [hashlib.sha256("".join(level[i : i + 4]).encode()).hexdigest() for i in range(0, len(level), 4)]
    assert a[-1].first().digest == level[0]
    empty = warc_fixity.merkle_tree(spark.createDataFrame([], "key long, record string"), 4)
    assert len(empty) == 1 and empty[0].count() == 0
    # Trees of unequal height: the records that one replica lacks, and no equal node.
    few = warc_fixity.merkle_tree(spark.createDataFrame(rows[:18], "key long, record string"), 4)
    assert len(few) < len(a)
    for found in (warc_fixity.audit(a, few, 4), warc_fixity.audit(few, a, 4)):
        assert {r.node for r in found.where("level = 0").collect()} == set(range(18, 300)) and found.where("digest = replica_digest").count() == 0
    assert {r.node for r in warc_fixity.audit(a, empty, 4).where("level = 0 and replica_digest is null").collect()} == set(range(300))
    odd = spark.createDataFrame([(None, "x"), (None, None), (5, "b"), (5, "a"), (5, "a")], "key long, record string").withColumns({"node": F.lit(1), "bucket": F.lit(2)})
    sizes = {(r.node, r.key, r.begin, r.end) for r in warc_fixity.merkle_tree(odd)[0].collect()}
    assert {n for n, *_ in sizes} == set(range(5)) and max(e for *_, e in sizes) == 4 and sum(k is None for _, k, *_ in sizes) == 2


def test_pipeline_stages(spark, odd):
    docs = spark.read.parquet(f"{SF}/documents.parquet").unionByName(odd)
    columns = docs.columns
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == columns
        assert out.count() <= docs.count()
    kept = corpus_pipeline.known_language(spark, docs, SF)
    assert {20, 21, 22, 23}.isdisjoint({r.doc_id for r in kept.where("source = 's'").select("doc_id").collect()})
    assert corpus_pipeline.STAGES[-1][1](spark, kept, SF).count() >= kept.count()


M64 = (1 << 64) - 1


def plain_mix(x):
    x ^= x >> 30
    x = x * 0xBF58476D1CE4E5B9 & M64
    x ^= x >> 27
    x = x * 0x94D049BB133111EB & M64
    return x ^ (x >> 31)


def plain_language(model, t):
    """Language and probability, n-gram by n-gram."""
    if t is None or not re.search(r"[^\W\d_]", t):
        return "und", 0.0
    points, score, total = [ord(c) + 1 for c in t.lower()], np.zeros(len(model.languages)), 0
    for n in model.orders:
        for i in range(len(points) - n + 1):
            h = (n + sum(points[i + k] * int(language_id._FACTORS[k]) for k in range(n))) & M64
            score += model.weights[:, plain_mix(h) >> (64 - model.bits)]
            total += 1
    score = score / max(total, 1) + model.bias
    p = np.exp(score - score.max())
    return model.languages[int(p.argmax())], float(p.max() / p.sum())


def plain_toxic(model, t):
    """P(grade > 0) of a text, word by word."""
    features = set()
    for w in re.findall(rb"(?:[A-Za-z]|[\x80-\xff])+", (t or "").lower().encode()):
        for n in (0, *model.prefixes):
            part = w[:n] if n else w
            if not n or len(w) > n:
                h = plain_mix((sum((b + 1) * pow(textkernel._BASE, i, 1 << 64) for i, b in enumerate(part)) + len(part)) & M64)
                features.add(plain_mix((h + n) & M64) >> (64 - model.bits))
    return 1 / (1 + np.exp(model.thresholds[0] - sum(model.weights[f] for f in features)))


def plain_windows(texts, window=35):
    words = {k: re.findall(r"[^\x20\x09-\x0D]+", t or "") for k, t in texts.items()}
    starts = Counter(tuple(w[i : i + window]) for w in words.values() for i in range(len(w) - window + 1))
    out = {}
    for k, w in words.items():
        gone = {p for i in range(len(w) - window + 1) if starts[tuple(w[i : i + window])] > 1 for p in range(i, i + window)}
        out[k] = " ".join(x for p, x in enumerate(w) if p not in gone)
    return out


@pytest.fixture(scope="module")
def small_corpus(spark, odd, tmp_path_factory):
    folder = f"file://{tmp_path_factory.mktemp('corpus')}"
    docs = spark.read.parquet(f"{SF}/documents.parquet").unionByName(odd.withColumn("doc_id", F.col("doc_id") + 5000))
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.read.parquet(f"{SF}/labels.parquet").write.parquet(f"{folder}/labels.parquet")
    return folder


def test_pipeline_against_plain_python(spark, small_corpus):
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{small_corpus}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    model = language_id.train_language_model(docs.select("doc_id", "text", "lang"), ~language_id.held_out(F.col("doc_id")))
    told = [plain_language(model, t) for _, t in rows]
    kept = [r for r, (lang, p) in zip(rows, told, strict=True) if lang != "und" and p >= corpus_pipeline.LEAST_SCORE]
    assert 100 < len(kept) < len(rows)
    first = corpus_pipeline.known_language(spark, docs, small_corpus)
    assert Counter((r.doc_id, r.text) for r in first.collect()) == Counter(kept)

    severity = toxicity.train_severity_model(first.select("doc_id", "text"), spark.read.parquet(f"{small_corpus}/labels.parquet"))
    clean = [(d, t) for d, t in kept if plain_toxic(severity, t) < 0.5]
    second = corpus_pipeline.not_toxic(spark, first, small_corpus)
    assert len(clean) < len(kept) and Counter((r.doc_id, r.text) for r in second.collect()) == Counter(clean)

    texts = {k: t for k, (_, t) in enumerate(clean)}
    classes = components_by_brute_force(list(texts), links_by_brute_force(texts))
    least = {}
    for k, c in classes.items():
        d = clean[k][0]
        if c not in least or (d is not None, d) < (clean[least[c]][0] is not None, clean[least[c]][0]):
            least[c] = k
    of_class = {}
    for k, c in classes.items():
        of_class.setdefault(c, []).append(clean[k])
    want = {c: min(d for d, _ in m if d is not None) if any(d is not None for d, _ in m) else None for c, m in of_class.items()}
    third = corpus_pipeline.one_of_each(spark, second, small_corpus)
    single = [(r.doc_id, r.text) for r in third.collect()]
    assert len(single) < len(clean) and Counter(d for d, _ in single) == Counter(want.values()) and set(single) <= set(clean)

    passages = plain_windows({d: t for d, t in single})
    fourth = corpus_pipeline.without_repeats(spark, third, small_corpus)
    got = {r.doc_id: (r.text, r.n_chars) for r in fourth.collect()}
    assert got == {d: (t, len(t)) for d, t in passages.items()}

    encode = Tokenizer.from_file(packing.vocabulary())
    ids = {d: [*encode.encode(t, add_special_tokens=False).ids, 2] for d, t in passages.items()}
    out = corpus_pipeline.run(spark, small_corpus).collect()
    pieces = {}
    for r in out:
        assert zlib.crc32(np.array(ids[r.doc_id][r.start : r.start + r.length], "<u4").tobytes()) == r.ids_crc32
        pieces.setdefault(r.doc_id, []).append((r.piece, r.start, r.length))
    assert set(pieces) == set(ids)
    for d, p in pieces.items():
        assert sum(n for *_, n in p) == len(ids[d]) and [x for x, *_ in sorted(p)] == list(range(len(p))) and all(n == 1024 for _, _, n in sorted(p)[1:])
    filled = Counter()
    for r in out:
        filled[r.sequence_id] += r.length
    assert max(filled.values()) <= 1024


def test_pipeline_of_empty_tables_and_of_nothing_kept(spark, tmp_path):
    docs = spark.createDataFrame([(1, None, "en", "s", 0), (2, "12 !", "en", "s", 4)], "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for name, rows in (("none", docs.limit(0)), ("dropped", docs)):
        rows.write.parquet(f"file://{tmp_path}/{name}/documents.parquet")
        labels.write.parquet(f"file://{tmp_path}/{name}/labels.parquet")
        out = corpus_pipeline.run(spark, f"file://{tmp_path}/{name}")
        assert out.count() == 0 and "sequence_id" in out.columns


def test_encoder_equals_tokenizers():
    from tokenizers import Tokenizer

    theirs, mine = Tokenizer.from_file(packing.vocabulary()), packing.Encoder(packing.vocabulary())
    assert mine.by_piece
    rng = random.Random(4)
    alphabets = ["ab9. \t\n\r\x0b\x0c\x1c\x1f\x85'!", " ''slt.é", "ab c\n\t'", "é ü1 2.", "한국 日本", "\u00a0\u2003\u200b x", "😀👍🏽\u200d", "".join(map(chr, range(32, 127)))]
    texts = ["".join(rng.choice(a) for _ in range(rng.randrange(40))) for a in alphabets for _ in range(300)]
    texts += ["".join(chr(rng.choice([*range(1, 0xD800), *range(0xE000, 0x20000)])) for _ in range(20)) for _ in range(500)] + ["<|endoftext|>", "a<|endoftext|>b", "'s 'll 'T", " " * 50]
    texts += [" " * 2_000_000, "\n" * 1_500_000] + [c * 200_000 for c in ("a", "a b", " é", "!? ", "漢")]
    for t, ids in zip(texts, mine(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == theirs.encode(t, add_special_tokens=False).ids, t[:60]


def test_empty_and_clashing_tables(spark, odd):
    none = odd.limit(0)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = language_id.train_language_model(docs, F.lit(True))
    assert language_id.identify_languages(none, model).count() == 0
    clash = odd.withColumns({"lang_pred": F.lit("mine"), "score": F.lit("mine"), "row": F.lit(1)})
    out = language_id.identify_languages(clash, model)
    assert dict(out.dtypes)["score"] == "double" and out.where("lang_pred = 'mine'").count() == 0 and out.count() == odd.count()
    assert ogg.inspect_ogg(ogg.encode_ogg(none)).count() == 0
    media = ogg.inspect_ogg(ogg.encode_ogg(odd.withColumns({"n_bytes": F.lit("x"), "media": F.lit("x"), "feature": F.lit("x"), "row": F.lit(1)})))
    assert media.columns.count("feature") == 1 and media.where("feature = 'x'").count() == 0 and media.count() == odd.count()
    assert sentencepiece.encode_pieces(none).count() == 0
    packed, _ = packing.pack(packing.token_pieces(odd.select("doc_id", "text", F.lit(1).alias("sequence_id"), F.lit(2).alias("offset"), F.lit(3).alias("part"), F.lit(4).alias("size")), packing.vocabulary()).drop("ids"))
    got = packed.collect()
    places = {(r.sequence_id, r.offset) for r in got}
    assert len(places) == len(got) and sum(r.doc_id is None for r in got) >= 1 and {"part", "size"} <= set(packed.columns)
