"""Scoring, reports, governance, calibration, gate, audio, sources and streams on small inputs."""

import datetime as dt
import hashlib
import io
import json
import math
import struct
import unicodedata
import zipfile

import duckdb
import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import __spark_entry__ as entry
from saltmarsh.functions import audio, scoring, text
from saltmarsh.operators import calibration, contracts, gate, governance, history, reports
from saltmarsh.plans import queries as plans
from saltmarsh.sources import files, inference
from saltmarsh.streaming import streams

SF = "/root/testdata/sf0.001"


def plain_counts(ref, hyp):
    table = [[(j, 0, 0, j) for j in range(len(hyp) + 1)]]
    for i, a in enumerate(ref, 1):
        row = [(i, 0, i, 0)]
        for j, b in enumerate(hyp, 1):
            c, s, d, n = table[i - 1][j - 1]
            best = (c + (a != b), s + (a != b), d, n)
            c, s, d, n = table[i - 1][j]
            best = (c + 1, s, d + 1, n) if c + 1 < best[0] else best
            c, s, d, n = row[j - 1]
            best = (c + 1, s, d, n + 1) if c + 1 < best[0] else best
            row.append(best)
        table.append(row)
    return table[-1][-1]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.text("abé한", max_size=8), st.text("abé한", max_size=8)), min_size=1, max_size=6))
def test_alignment(pairs):
    # As in the operator, a pair with an empty side is padded like the others.
    refs, hyps = zip(*pairs)
    if max(map(len, refs)) and max(map(len, hyps)):
        want = [plain_counts(a, b) for a, b in pairs]
        assert scoring._align(list(refs), list(hyps), [w[0] for w in want]).tolist() == [w[1] for w in want]


def test_edit_counts_and_normalisation(spark):
    rows = [("니 지금 어데고?", "니지금어디고"), ("", ""), ("", "ab"), ("ab", ""), (None, "x"), ("kitten", "sitting")]
    df = spark.createDataFrame(rows, "r string, h string")
    out = df.select(scoring.edit_counts(text.normalize_for_cer(F.col("r")), text.normalize_for_cer(F.col("h"))).alias("k"), scoring.cer(text.normalize_for_cer(F.col("r")), text.normalize_for_cer(F.col("h"))).alias("c")).collect()
    assert [tuple(r.k) for r in out] == [(1, 0, 0, 6), (0, 0, 0, 0), (0, 0, 2, 0), (0, 2, 0, 2), (0, 0, 1, 0), (2, 0, 1, 6)]
    assert out[0].c == pytest.approx(1 / 6) and out[1].c == 0 and out[2].c == 2


def test_text_functions(spark):
    df = spark.createDataFrame([("Straße Ａ-1!", '"a", "b"', "x/y z.wav", "rec.01.a")], "a string, b string, c string, d string")
    r = df.select(text.surface_key(F.col("a")).alias("k"), text.pool_surface_key(F.col("a")).alias("p"), text.split_label_terms(F.col("b")).alias("t"), text.safe_record_name(F.col("c")).alias("n"), text.source_recording_id(F.col("d")).alias("s"), text.tokens_without_punct(F.col("a")).alias("w"), text.audio_suffix(F.col("c")).alias("x")).first()
    assert (r.k, r.p, r.t, r.n, r.s, r.w, r.x) == ("strassea1", "strassea-1!", ["a", "b"], "x-y-z.wav", "rec", ["Straße", "Ａ1"], ".wav")
    import uuid

    got = df.select(text.import_utterance_id(F.lit("i"), F.lit("p"), F.lit("s")).alias("u")).first().u
    assert got == str(uuid.uuid5(uuid.NAMESPACE_URL, "i:p:s"))


def test_queries_match_sql(spark):
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")

    def rows(frame):
        def cell(v):
            if v is None or v is pd.NA or v is pd.NaT or v != v:
                return "null"
            return f"{float(v):.6f}" if isinstance(v, (int, float, np.integer, np.floating)) and not isinstance(v, bool) else str(v)[:19]

        return sorted(tuple(cell(v) for v in r) for r in frame[sorted(frame.columns)].itertuples(index=False))

    for name, query in plans.QUERIES.items():
        got = query(spark, SF).toPandas()
        if name in plans.SQL:
            assert rows(got) == rows(con.sql(plans.SQL[name]).df()), name


@pytest.fixture(scope="module")
def turns(spark, tmp_path_factory):
    folder = f"file://{tmp_path_factory.mktemp('turns')}"
    same = "the same forty characters begin both turns, but then "
    rows = [(1, 0, "user", same + "one ends here"), (1, 1, "assistant", same + "the other goes on, and on"), (2, 0, "user", "Où est la gare, là-bas\u00a0?"), (2, 1, "assistant", "Ou\u0300 est la guerre ?"), (7, 0, "user", "한국말 잘하네"), (7, 1, "assistant", "")]
    spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").write.parquet(f"{folder}/conversations.parquet")
    return folder, rows


def test_whole_turns_are_scored(spark, turns):
    folder, rows = turns
    plain = lambda t: "".join(c for c in unicodedata.normalize("NFC", t) if unicodedata.category(c)[0] not in "ZP")
    want = {f"{a[0]}:{a[1]}": (plain_counts(plain(a[3]), plain(b[3])), len(plain(a[3])), len(plain(b[3]))) for a, b in zip(rows[::2], rows[1::2], strict=True)}
    q = plans.QUERIES
    assert {r.case_id: (r.edits, r.ref_chars) for r in q["case_scores"](spark, folder).collect()} == {k: (c[0], n) for k, (c, n, _) in want.items()}
    assert {r.case_id: (r.edits, r.longer) for r in q["edit_counts"](spark, folder).collect()} == {k: (c[0], m - n) for k, (c, n, m) in want.items()}
    r = q["aggregate_report"](spark, folder).first()
    assert (r.utterance_count, r.cer) == (3, round(sum(c[0] for c, _, _ in want.values()) / sum(n for _, n, _ in want.values()), 6))


def test_alignment_of_long_texts():
    rng = np.random.default_rng(3)
    pairs = [("".join(rng.choice(list("abcé"), n)), "".join(rng.choice(list("abcé"), m))) for n, m in ((300, 280), (150, 310), (1, 90), (200, 1), (0, 5), (5, 0))]
    want = [plain_counts(a, b)[:2] for a, b in pairs]
    assert scoring._align(*map(list, zip(*pairs)), [e for e, _ in want]).tolist() == [s for _, s in want]


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    folder = f"file://{tmp_path_factory.mktemp('corpus')}"
    docs = [(1, "Die Straße, ＡＢ!", "de", "src1"), (2, "die STRASSE ab", "de", "src5"), (3, "Cafe\u0301 No. ①", "fr", "src2"), (4, "café no 1", "fr", "src3"), (5, "plain words", "en", "src2"), (6, "Plain, words!", "en", "src2"), (7, None, "en", "src4"), (8, "", "es", "src4"), (9, "benchmark  ÍTEM", "es", "src6")]
    spark.createDataFrame([(*r, len(r[1] or "")) for r in docs], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(50, "Benchmark ítem.")], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    spark.createDataFrame([(4, 1, 0), (5, 0, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder, docs


def folded(t):
    return "".join(c for c in unicodedata.normalize("NFKC", t).casefold() if unicodedata.category(c)[0] in "LN")


def test_surface_keys_of_every_script(spark, corpus):
    folder, docs = corpus
    assert {r.doc_id: r.surface_key for r in plans.QUERIES["surface_keys"](spark, folder).collect()} == {d: t if t is None else folded(t) for d, t, *_ in docs}
    got = {(r.surface, r.n, r.first_id, r.splits, r.level) for r in plans.QUERIES["duplicate_surface_groups"](spark, folder).collect()}
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    assert got == {(sha("diestrasseab"), 2, 1, "train,validation", "error"), (sha("caféno1"), 2, 3, "train", "warning"), (sha("plainwords"), 2, 5, "train", "warning")}


def test_leakage_and_exclusions_by_surface_key(spark, corpus):
    folder, _ = corpus
    q = plans.QUERIES
    surface = lambda name: {(r.key, r.detail) for r in q[name](spark, folder).where("rule = 'surface'").collect()}
    assert surface("leakage_check") == {("1", "validation"), ("9", "b2")}
    assert surface("exclusion_check") == {(k, "warning") for k in ("3", "4", "5", "6", "9")}
    assert {r.value for r in q["exclusion_registry"](spark, folder).where("kind = 'surface'").collect()} == {"benchmarkítem"}


def test_coverage_of_all_rows(spark, tmp_path, turns):
    spark.createDataFrame([(k,) for k in (1, 14, 50, 60)], "c_custkey long").write.parquet(f"file://{tmp_path}/customer.parquet")
    spark.createDataFrame([(1,), *[(14,)] * 5, (50,), (70,)], "o_custkey long").write.parquet(f"file://{tmp_path}/orders.parquet")
    got = {(r.rule, r.key, r.detail) for r in plans.QUERIES["coverage_check"](spark, f"file://{tmp_path}").collect()}
    assert got == {("duplicate", "14", "5"), ("missing", "60", "0"), ("unexpected", "70", "1")}
    r = plans.QUERIES["inference_summary"](spark, turns[0]).first()
    assert (r.missing, r.unexpected, r.duplicate, r.failed, r.status) == (0, 0, 0, 0, "complete")


def test_benchmark_hash(spark, corpus):
    folder, docs = corpus
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    want = {}
    for source in {r[3] for r in docs}:
        buckets = {}
        for d, t, lang, s in sorted(docs, key=lambda r: str(r[0])):
            if s == source:
                row = {"utterance_id": d, "surface_text": t, "expressions": sorted(lang)}
                buckets.setdefault(hashlib.md5(str(d).encode()).hexdigest()[:6], []).append(sha(json.dumps({k: v for k, v in row.items() if v is not None}, ensure_ascii=False, separators=(",", ":"))))
        coarse = {}
        for b in sorted(buckets):
            coarse.setdefault(b[:3], []).append(sha("".join(buckets[b])))
        want[source] = sha("".join(sha("".join(coarse[b])) for b in sorted(coarse)))
    assert {r.source: r.semantic_hash for r in plans.QUERIES["benchmark_identity"](spark, folder).collect()} == want
    rows = [("x", 1, "a", ["p", "q"]), ("x", 2, "b", ["p"]), ("y", 2, "b", ["p"]), ("y", 1, "a", ["q", "p"]), ("z", 1, "b", ["p", "q"]), ("z", 2, "a", ["p"])]
    h = {r.source: r.semantic_hash for r in governance.benchmark_identity(spark.createDataFrame(rows, "source string, utterance_id int, surface_text string, expressions array<string>")).collect()}
    assert h["x"] == h["y"] != h["z"]


def test_entry(spark):
    assert entry.entry(spark).count() == 1
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_empty_report(spark):
    none = spark.createDataFrame([], "edits int, ref_chars int, high_confidence_wrong boolean, latency_ms double, expressions int, preserved int, overcorrected int")
    r = reports.aggregate_report(none).first()
    assert (r.utterance_count, r.cer, r.dialect_preservation_rate, r.context_overcorrection_rate, r.p95_latency_ms) == (0, 0, 1, 0, 0)


def test_exact_percentiles(spark):
    rng = np.random.default_rng(1)
    values = {None: rng.random(301).round(2), "a": rng.integers(0, 3, 1000) * 1.5, "b": np.array([7.0]), "c": rng.normal(0, 9, 2000)}
    rows = [(g, float(x)) for g, v in values.items() for x in v] + [("a", None), ("none", None)]
    df = spark.createDataFrame(rows, "g string, v double")
    names = {"p0": 0.0, "p50": 0.5, "p95": 0.95, "p100": 1.0}
    got = {r.g: [r[n] for n in names] for r in reports.exact_percentiles(df, "v", names, "g").collect()}
    assert got.pop("none") == [None] * 4 and set(got) == set(values)
    for g, v in values.items():
        assert got[g] == pytest.approx(np.percentile(v, [0, 50, 95, 100]).tolist(), abs=1e-9)
    every = np.concatenate(list(values.values()))
    assert reports.exact_percentiles(df, "v", names).first().p95 == pytest.approx(np.percentile(every, 95))
    assert reports.exact_percentiles(df.limit(0), "v", names, "g").count() == 0


def test_latest_breaks_ties_by_text(spark):
    t = dt.datetime(2024, 1, 1)
    df = spark.createDataFrame([(1, 9, t, "a"), (1, 10, t, "b")], "prediction_id int, review_id int, created_at timestamp, verdict string")
    r = history.latest_by(df, "prediction_id", "created_at", "review_id").first()
    assert (r.review_id, r.revisions) == (9, 2)


def test_gate(spark):
    base = {"candidate": "x", "benchmark_integrity_passed": True, "reproducibility_passed": True, "pilot_fine_tuned_cer": 0.05, "pilot_fine_tuned_dialect_preservation": 0.93, "pilot_pretrained_empty_outputs": 3, "pilot_fine_tuned_empty_outputs": 0, "human_review_complete": False, "human_fine_tuned_preference_rate": 0.0, "independent_test_complete": False, "standard_regression_complete": False}
    rest = {f"{a}_{m}_{w}": 0.5 for a in ("independent", "standard") for m in ("pretrained", "fine_tuned") for w in ("cer", "dialect_preservation", "empty_outputs")} | {f"{a}_{w}": 100 for a in ("independent", "standard") for w in ("utterances", "speakers")}
    done = {"human_review_complete": True, "human_fine_tuned_preference_rate": 0.9, "independent_test_complete": True, "standard_regression_complete": True, "independent_fine_tuned_cer": 0.1, "independent_fine_tuned_dialect_preservation": 0.9}
    rows = [base | rest, base | rest | done | {"candidate": "y"}, base | rest | done | {"candidate": "z", "pilot_fine_tuned_cer": 0.9}, base | rest | done | {"candidate": "w", "standard_fine_tuned_cer": 0.9}]
    got = {r.candidate: (r.status, r.passed, r.failed, r.pending) for r in gate.gate_assessment(spark.createDataFrame([{k: float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else v for k, v in r.items()} for r in rows])).collect()}
    assert got["x"] == ("FAIL", 5, 0, 3) and got["y"][0] == "PASS" and got["z"][0] == "CONDITIONAL PASS" and got["w"][0] == "FAIL"


def test_calibration(spark):
    form = "array<struct<form:string,plain:string,status:string>>"
    df = spark.createDataFrame([("abcd", "bc", [], []), ("abcd", "x", [("ab", "ab", "candidate")], []), ("abcd", "x", [], [("cd", "cd", "approved")]), ("abcd", "x", [], [])], f"h string, s string, v {form}, t {form}")
    got = [tuple(r.x)[:2] for r in df.select(calibration.classify_expression(F.col("h"), F.col("s"), F.col("v"), F.col("t")).alias("x")).collect()]
    assert got == [("EXACT_SURFACE", "NO_ERROR"), ("ACCEPTABLE_VARIANT", "AMBIGUOUS_VARIANT"), ("STANDARD_EQUIVALENT", "DIALECT_TO_STANDARD"), ("MISSING", "DIALECT_EXPRESSION_LOST")]
    one = spark.createDataFrame([("a b a", [("a", "z")])], "h string, v array<struct<form:string,surface:string>>")
    assert one.select(calibration.substitute_variants(F.col("h"), F.col("v"))).first()[0] == "z b a"
    kinds = spark.createDataFrame([(["DIALECT_TO_STANDARD"],), (["WORD_BOUNDARY_ERROR"],), (["NO_ERROR"],), (["DIALECT_TO_STANDARD", "PHONETIC_SUBSTITUTION"],)], "e array<string>")
    assert [r[0] for r in kinds.select(calibration.failure_candidates(F.col("e"))).collect()] == [["LANGUAGE_MODEL_BIAS"], ["DECODING"], [], ["LANGUAGE_MODEL_BIAS", "MODEL"]]


def test_contracts_and_governance(spark):
    paths = spark.createDataFrame([("derived/asr_16k_mono/a.wav",), ("/x",), ("a/../b",), ("c:\\x",), ("a//b",)], "p string")
    assert [r[0] for r in paths.select(contracts.safe_relative_path(F.col("p"))).collect()] == [True, False, False, False, False]
    spec = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", None), ("d", "4")], "path string, expected_sha256 string")
    have = spark.createDataFrame([("a", "1"), ("b", "x"), ("c", "3"), ("e", "5")], "path string, sha256 string")
    assert {r.path: r.status for r in governance.artifact_audit(spec, have).collect()} == {"a": "verified", "b": "mismatch", "c": "unpinned", "d": "missing", "e": "unexpected"}
    plan = governance.leakage_check(spark.createDataFrame([(1, "s", ["a"], "k")], "utterance_id int, speaker_id string, lineage array<string>, surface_key string"), spark.createDataFrame([(1, "s", ["a"], "k", "b")], "utterance_id int, speaker_id string, lineage array<string>, surface_key string, benchmark_id string"))
    assert plan.count() == 4
    assert "CartesianProduct" not in plan._jdf.queryExecution().toString()


def wav(samples, rate=16_000):
    body = (np.asarray(samples) * 32767).astype("<i2").tobytes()
    return b"RIFF" + struct.pack("<I", 36 + len(body)) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, rate, rate * 2, 2, 16) + b"data" + struct.pack("<I", len(body)) + body


def test_audio(spark):
    x = 0.5 * np.sin(2 * math.pi * 220 * np.arange(8000) / 16_000)
    df = spark.createDataFrame([("a", wav(x)), ("b", wav(x)[:-10]), ("c", b"")], "path string, content binary")
    heads = {r.path: r for r in audio.wav_headers(df).collect()}
    assert heads["a"].frames == 8000 and heads["a"].rate == 16_000 and heads["b"].error and heads["c"].error
    out = df.where("path = 'a'").select(audio.decode_pcm16(F.col("content")).alias("s")).select("s", audio.audio_quality(F.col("s"), 16_000).alias("q"))
    q = out.first().q
    assert q.peak == pytest.approx(0.5, abs=1e-3) and q.rms_dbfs == pytest.approx(-9.03, abs=0.02) and q.warnings == []
    snap = audio.acoustic_snapshot(out.select("s"), "s", 16_000).first()
    assert len(snap.log_mel) == 48 and len(snap.envelope) == 200 and snap.f0[3].f0_hz == pytest.approx(220, abs=3) and not snap.truncated
    assert len(audio.log_mel_of(np.zeros(10), 16_000)[0]) == 1


def test_sources(spark, tmp_path):
    table = f"file://{tmp_path}/t"
    a = spark.createDataFrame([(1, "x"), (2, "y")], "k int, v string")
    assert files.append_immutable(a, table, "k").count() == 0
    assert files.append_immutable(spark.createDataFrame([(2, "y"), (3, "z")], "k int, v string"), table, "k").count() == 0
    assert spark.read.parquet(table).count() == 3
    assert [r.k for r in files.append_immutable(spark.createDataFrame([(2, "other"), (4, "q")], "k int, v string"), table, "k").collect()] == [2]
    assert spark.read.parquet(table).count() == 3
    (tmp_path / "p.md").write_text("# x\n- T004-S001: one\n- T004-S002: two\n- T004-S002: again\n")
    assert sorted((r.number, r.n) for r in files.read_prompt_sheet(spark, f"file://{tmp_path}/p.md").collect()) == [(1, 1), (2, 2)]
    rec = tmp_path / "rec"
    rec.mkdir()
    for name in ("New Recording.m4a", "New Recording 2.m4a", "x.m4a", "x.txt", ".hidden"):
        (rec / name).write_bytes(b"1")
    got = {r.name: (r.number, r.status) for r in files.list_recordings(spark, f"file://{rec}").collect()}
    assert got == {"New Recording.m4a": (1, "ok"), "New Recording 2.m4a": (2, "ok"), "x.m4a": (None, "unexpected"), "x.txt": (None, "unsupported")}
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        z.writestr("a/b.txt", "hi")
        z.writestr("../evil", "no")
    members = files.package_members(spark.createDataFrame([("p", buffer.getvalue()), ("q", b"no")], "path string, content binary")).collect()
    assert {(m.package, m.member, m.problem) for m in members} == {("p", "a/b.txt", None), ("p", "../evil", "unsafe path"), ("q", None, "not a ZIP file")}
    (tmp_path / "l.jsonl").write_text('{"a": 1}\n\nnope\n[1]\n')
    from pyspark.sql import types as T

    lines = files.read_predictions(spark, f"file://{tmp_path}/l.jsonl", T.StructType([T.StructField("a", T.IntegerType())]), "reject").collect()
    assert sorted(str(r.problem) for r in lines) == ["None", "blank", "not JSON", "not an object"]
    ok = inference.transcribe_with(spark.createDataFrame([("u", b"ab", 100.0), ("v", None, 1.0)], "utterance_id string, content binary, duration_ms double"), lambda: lambda b: b.decode().upper()).collect()
    assert {(r.utterance_id, r.hypothesis, r.status) for r in ok} == {("u", "AB", "ok"), ("v", None, "failed")}


def test_streams(spark, tmp_path):
    rows = [("p1", "r1", "a", 10.0, dt.datetime(2024, 1, 1, 0, 5)), ("p1", "r2", "b", 30.0, dt.datetime(2024, 1, 1, 0, 6)), ("p2", "r3", "c", 20.0, dt.datetime(2024, 1, 1, 2, 0))]
    df = spark.createDataFrame(rows, "prediction_id string, review_id string, verdict string, latency_ms double, created_at timestamp")
    df.write.parquet(f"file://{tmp_path}/in")

    def run(make, mode):
        stream = make(spark.readStream.schema(df.schema).parquet(f"file://{tmp_path}/in"))
        q = stream.writeStream.format("memory").queryName(f"q{mode}{abs(hash(make)) % 1000}").outputMode(mode).trigger(availableNow=True).start()
        q.awaitTermination()
        return spark.table(q.name).collect()

    assert {(r.prediction_id, r.review_id, r.revisions) for r in run(streams.latest_review_stream, "complete")} == {("p1", "r2", 2), ("p2", "r3", 1)}
    scored = lambda s: streams.quality_monitor(s.withColumns({"edits": F.lit(1), "ref_chars": F.lit(4), "high_confidence_wrong": F.lit(False)}), "1 hour")
    assert sorted((r.cases, r.cer, r.p50_latency_ms) for r in run(scored, "complete")) == [(1, 0.25, 20.0), (2, 0.25, 20.0)]
    once = lambda s: streams.ingest_predictions(s.withColumns({"reference": F.lit("ab"), "hypothesis": F.lit("ac"), "confidence": F.lit(0.9)}))
    assert sorted((r.prediction_id, r.cer) for r in run(once, "append")) == [("p1", 0.5), ("p2", 0.5)]
    assert {r.events for r in run(lambda s: streams.session_metrics(s, "prediction_id"), "complete")} == {2, 1}


def test_repeated_roles_are_counted_not_sorted(spark):
    rows = [(1, "a", "x", None), (1, "a", "x", None), (1, "a", "y", "x"), (2, "a", "z", "x"), (None, "b", "z", "z"), (None, "b", "y", None), (3, None, None, None), (3, None, "q", "q")]
    found = governance.lineage_chain(spark.createDataFrame(rows, "utterance_id int, role string, sha256 string, parent_sha256 string"))
    assert sorted((r.rule, r.key or "", r.detail or "") for r in found.collect()) == [("parent_missing", "", "z"), ("parent_missing", "2", "z"), ("role_repeated", "", "b"), ("role_repeated", "1", "a"), ("role_repeated", "3", "")]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan
