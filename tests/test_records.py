"""Operators over records, held-out sets, files and streams that have no statement in SQL, on small inputs."""

import datetime as dt
import json

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from saltmarsh.functions import audio, text
from saltmarsh.operators import contracts, gate, governance, history, reports, training
from saltmarsh.sources import files
from saltmarsh.streaming import streams
from test_core import wav


def found(df):
    return {tuple(r) for r in df.collect()}


def test_audio_probe(spark):
    x = 0.5 * np.sin(np.arange(1600) / 20)
    good, silent = wav(x), wav(np.zeros(10))
    have = spark.createDataFrame([("a", good), ("b", silent), ("c", b"no")], "path string, content binary")
    import hashlib

    m = spark.createDataFrame([("u1", "a", hashlib.sha256(good).hexdigest()), ("u2", "b", "x"), ("u3", "c", "x"), ("u4", "d", "x")], "utterance_id string, path string, audio_sha256 string")
    got = {r.utterance_id: r for r in audio.audio_probe(have, m).collect()}
    s = np.frombuffer(good[44:], "<i2") / 32768
    assert got["u1"].hash_matches_manifest and got["u1"].waveform_nonempty and got["u1"].sample_count == 1600 and got["u1"].duration_ms == 100.0
    assert got["u1"].rms_amplitude == pytest.approx(np.sqrt((s**2).mean()), abs=1e-7) and got["u1"].nonzero_sample_ratio == pytest.approx((s != 0).mean(), abs=1e-7) and got["u1"].peak_amplitude == pytest.approx(abs(s).max(), abs=1e-7)
    assert not got["u2"].waveform_nonempty and got["u2"].rms_amplitude == 0 and got["u3"].sample_count is None and not got["u4"].hash_matches_manifest


def test_labels_and_rows(spark):
    schema = "labels array<struct<surface_form:string,normalized_forms:array<string>>>"
    df = spark.createDataFrame([([('"a", "b"', ['"x"', '"y"']), ("c", ["p", "q"]), ('"d", "e"', ["z"])],), ([],), (None,)], schema)
    got = [r.x for r in df.select(text.expand_labels(F.col("labels")).alias("x")).collect()]
    assert [(r.surface_form, r.normalized_forms, r.problem) for r in got[0]] == [("a", ["x"], None), ("b", ["y"], None), ("c", ["p", "q"], None), ("d", ["z"], "counts differ"), ("e", ["z"], "counts differ")] and got[1] == [] and got[2] is None
    one = spark.createDataFrame([(2, (1, None), "é")], "b int, a struct<z:int,y:string>, c string")
    assert one.select(files.canonical_row(one)).first()[0] == '{"a":{"y":null,"z":1},"b":2,"c":"é"}'
    line = spark.createDataFrame([(1, "a|b", "c", 1234.5, [("x", "preserved")], ["MODEL"])], "case_id int, reference string, hypothesis string, cer double, matches array<struct<surface_form:string,match_status:string>>, flags array<string>")
    assert files.report_lines(line).first().line == "| 1 | a\\|b | c | 1234.5000 | x: preserved | MODEL |"
    assert files.report_lines(line.drop("matches", "flags")).first().line == "| 1 | a\\|b | c | 1234.5000 |"


def test_files(spark, tmp_path, monkeypatch):
    rec = tmp_path / "rec"
    rec.mkdir()
    for name in ("New Recording.m4a", "New Recording 1.m4a", "New Recording 2.m4a"):
        (rec / name).write_bytes(b"12345")
    (rec / "long.m4a").write_bytes(b"x" * 50)
    got = {r.name: (r.number, r.status) for r in files.list_recordings(spark, f"file://{rec}").collect()}
    assert got["New Recording 1.m4a"] == (1, "ok") and got["New Recording.m4a"] == (1, "duplicate") and got["New Recording 2.m4a"] == (2, "ok")
    monkeypatch.setattr(files, "MAX_BYTES", 20)
    assert {(r.path.rpartition("/")[2], r.problem, r.content is None) for r in files.read_audio(spark, f"file://{rec}", "*.m4a").collect()} == {(f"New Recording{s}.m4a", None, False) for s in ("", " 1", " 2")} | {("long.m4a", "too large", True)}
    manifest = spark.createDataFrame([("a", "1"), ("b", "2")], "path string, sha256 string")
    out = f"file://{tmp_path}/export"
    assert found(files.verified_export(manifest, spark.createDataFrame([("a", "1"), ("b", "x")], "path string, sha256 string"), out)) == {("b", "mismatch")}
    assert not (tmp_path / "export").exists() and files.verified_export(manifest, manifest, out).count() == 0 and spark.read.json(out).count() == 2
    files.write_sorted_jsonl(spark.range(100), f"file://{tmp_path}/sorted", "id", files=4)
    parts = sorted((tmp_path / "sorted").glob("part*"))
    assert [json.loads(x)["id"] for p in parts for x in p.read_text().splitlines()] == list(range(100)) and len(parts) > 1
    (tmp_path / "p.jsonl").write_text('{"prompt_id": "p1", "target_expressions": ["a"]}\n')
    assert files.read_collection_prompts(spark, f"file://{tmp_path}/p.jsonl").first().target_expressions == ["a"]
    (tmp_path / "r").mkdir()
    (tmp_path / "r" / "1.json").write_text('{\n "id": 1\n}')
    assert files.read_records(spark, f"file://{tmp_path}/r", T.StructType([T.StructField("id", T.IntegerType())])).first().id == 1
    cases = spark.createDataFrame([(1, ["MODEL"]), (2, [])], "id int, flags array<string>")
    files.append_errors(cases, f"file://{tmp_path}/errors")
    files.append_errors(cases, f"file://{tmp_path}/errors")
    assert spark.read.json(f"file://{tmp_path}/errors").count() == 2
    entries = spark.createDataFrame([(1, "train"), (2, "validation")], "id int, split string")
    none = spark.createDataFrame([], "rule string")
    assert not files.export_training_rows(entries, none.union(spark.createDataFrame([("x",)], "rule string")), f"file://{tmp_path}/rows")
    assert files.export_training_rows(entries, none, f"file://{tmp_path}/rows") and spark.read.json(f"file://{tmp_path}/rows/split=train").count() == 1


def test_precomputed_predictions(spark, tmp_path):
    (tmp_path / "p.jsonl").write_text('{"utterance_id": "a", "text": "x"}\n\n{"utterance_id": "b"}\n{"utterance_id": "b"}\n{"utterance_id": "z"}\nno\n')
    schema = T.StructType([T.StructField("utterance_id", T.StringType()), T.StructField("text", T.StringType())])
    rows, wrong = files.precomputed(files.read_predictions(spark, f"file://{tmp_path}/p.jsonl", schema, "reject"), spark.createDataFrame([("a",), ("b",), ("c",)], "utterance_id string"))
    assert [(r.utterance_id, r.record.text) for r in rows.collect()] == [("a", "x")]
    assert found(wrong.select("rule", "key")) == {("line", "blank"), ("line", "not JSON"), ("missing", "c"), ("duplicate", "b"), ("unexpected", "z")}


def test_contracts(spark):
    schema = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.StructType([T.StructField("c", T.LongType())]))])
    df = spark.createDataFrame([(1, '{"a":1,"b":{"c":1,"d":2},"e":3}'), (2, '{"a":1}'), (3, None)], "k int, j string")
    assert found(contracts.strict_fields(df, "j", schema, "k")) == {("unknown_fields", "1", "e,b.d")}
    assert contracts.stripped(spark.createDataFrame([(" a ", 1)], "s string, n int")).first() == ("a", 1)
    m = spark.createDataFrame([(1, "p", True, "b", "1"), (1, "p", False, "b", "2")], "utterance_id int, audio_path string, frozen boolean, benchmark_id string, benchmark_version string")
    assert {r for r, _ in found(contracts.manifest_shape(m, 3, ("b", "1")))} == {"count", "ids_repeat", "paths_repeat", "not_frozen", "other_benchmark"}
    assert contracts.inference_view(m.withColumn("surface_text", F.lit("x"))).columns == m.columns
    heads = spark.createDataFrame([("a", None, 16_000, 1, 2, 1, 16_000, 1.0), ("b", "bad", None, None, None, None, None, None), ("c", None, 8000, 2, 1, 3, 0, 5.0)], "path string, error string, rate int, channels int, width int, format int, frames long, declared_s double")
    assert {(r, k) for r, k in found(contracts.audio_contract(heads))} == {("corrupt", "b"), *[(r, "c") for r in ("rate", "channels", "width", "compressed", "empty", "duration")]}
    assets = [("u", "original", "1", None, 44_100, 2, "aac", []), ("u", "master", "2", "1", 48_000, 1, "pcm_s16le", ["decode"]), ("u", "asr_16k_mono", "3", "9", 8000, 1, "pcm_s16le", ["a", "b"]), ("v", "original", "4", None, 1, 1, "x", ["cut"]), ("v", "derived", "5", "4", 1, 1, "x", ["c"])]
    a = spark.createDataFrame(assets, "utterance_id string, role string, sha256 string, parent_sha256 string, rate int, channels int, codec string, transformation array<string>")
    assert found(governance.audio_lineage_contract(a)) == {("parent_missing", "u", "3"), ("one_transformation", "u", "3"), ("asr_format", "u", "3"), ("original_transformed", "v", "4")}
    assert ("role_missing", "v", "asr_16k_mono") in found(governance.audio_lineage_contract(a.where("role <> 'derived'")))


def test_import(spark):
    prompts = spark.createDataFrame([(1, "one"), (2, "two"), (3, "Bench!")], "number int, text string")
    recs = spark.createDataFrame([("r1", 1, "ok", 5, "h1"), ("r2", 2, "ok", 0, "h2"), ("r3", 3, "ok", 5, "h1"), ("x", None, "unsupported", 5, "h"), ("r9", 9, "ok", 5, "h9")], "name string, number int, status string, length long, sha256 string")
    frozen = spark.createDataFrame([("bench@1", "me", ["h1"], "bench")], "benchmark string, speaker_id string, lineage array<string>, surface_text string")
    items, errors = training.import_plan(prompts, recs, frozen, 1, 4, "me", {"storage_allowed": True, "research_use_allowed": True, "model_training_allowed": True}, "bench@1")
    assert found(items.select("prompt_id", "source_filename")) == {("T004-S001", "r1"), ("T004-S003", "r3")}
    assert found(errors) == {("recording", "unsupported: x"), ("missing_recording", "4"), ("outside_range", "9"), ("missing_prompt", "4"), ("speaker_in_benchmark", "me"), ("empty_recording", "r2"), ("audio_in_benchmark", "r1"), ("audio_in_benchmark", "r3"), ("surface_in_benchmark", "3"), ("duplicate_audio", "h1"), ("mapped_count", "2")}
    clean = training.import_plan(prompts.where("number < 3"), recs.where("number < 3").withColumns({"length": F.lit(1).cast("long"), "sha256": F.col("name")}), frozen, 1, 2, "you", {}, "bench@1")
    assert found(clean[1]) == {("consent", c) for c in training.CONSENTS} and clean[0].count() == 2
    with pytest.raises(ValueError):
        training.build_manifest(prompts, "b", "1", "unassigned")
    decisions = spark.createDataFrame([(1, "approved", "new", "accepted"), (2, "approved", None, "frozen")], "utterance_id int, status string, new_text string, outcome string")
    now = spark.createDataFrame([(1, "label_v3", "old"), (2, "label_v1", "x")], "utterance_id int, label_version string, surface_text string")
    assert found(training.review_decisions_applied(decisions, now)) == {(1, "approved", "new", "label_v4")}
    t = dt.datetime(2024, 1, 1)
    listing = history.newest_first(spark.createDataFrame([(1, t), (2, None), (3, t + dt.timedelta(1)), (0, t)], "id int, at timestamp"), "at", "id", 3)
    assert [r.id for r in listing.collect()] == [3, 0, 1]


def test_suite(spark):
    entries = [(c, f"u{k}", f"s{k % 2}", None, f"h{k}", [f"h{k}"], "abcd efgh", ["abcd"], f"audio/{k}.wav") for c in ("good", "leaky") for k in range(4)]
    m = spark.createDataFrame(entries, "candidate string, utterance_id string, speaker_id string, source_recording_id string, audio_sha256 string, audio_lineage array<string>, surface_text string, dialect_expressions array<string>, audio_filepath string")
    arm = lambda h: m.select("candidate", "utterance_id", F.lit(h).alias("hypothesis"), F.lit(10.0).alias("latency_ms"))
    excluded = spark.createDataFrame([("surface", "abcdefgh"), ("recording", "r"), ("audio", "zz")], "kind string, value string")
    leaky = m.where("candidate = 'leaky'").withColumn("audio_lineage", F.array(F.lit("zz"))).unionByName(m.where("candidate = 'good'"))
    heads = spark.createDataFrame([(f"audio/{k}.wav", f"h{k}", 16_000, 1, 2, 10, None) for k in range(3)] + [("audio/3.wav", "other", 16_000, 1, 2, 10, None)], "path string, sha256 string, rate int, channels int, width int, frames int, error string")
    base = m.select("candidate").distinct().withColumns({"benchmark_integrity_passed": F.lit(True), "pilot_fine_tuned_cer": F.lit(0.0), "pilot_fine_tuned_dialect_preservation": F.lit(1.0), "pilot_pretrained_empty_outputs": F.lit(0), "pilot_fine_tuned_empty_outputs": F.lit(0)})
    ok = base.select("candidate", F.lit(True).alias("passed"), F.lit(True).alias("bundle_passed"))
    human = base.select("candidate", F.lit(True).alias("complete"), F.lit(0.9).alias("preference_rate"))
    criteria = gate.CRITERIA | {f"{s}_min_{w}": 2 for s in ("independent", "standard") for w in ("utterances", "speakers")}
    assessed, evidence, findings = gate.gate_suite({"independent": (leaky, arm("abxx"), arm("abcd efgh")), "standard": (m, arm("abcd efgh"), arm("abcd efgh"))}, excluded, base, ok, human, criteria)
    checks = gate.checks(evidence, criteria)
    assert found(checks.where("outcome <> 'passed'")) == set() and found(assessed) == {("good", 13, 0, 0, "PASS")}
    assert found(findings.where("rule = 'audio_overlap'").select("candidate", "set", "level")) == {("leaky", "independent", "error")} and findings.where("level = 'warning' and rule = 'surface_overlap'").count() == 16
    late = human.withColumn("preference_rate", F.lit(None).cast("double"))
    e = gate.gate_suite({"independent": (m, arm("abxx"), arm("abcd efgh")), "standard": (m, arm("x"), arm("x"))}, excluded, base, ok, late, criteria)[1].first()
    assert e.review_without_key and not e.human_review_complete
    few = governance.evaluation_set_check(m.where("candidate = 'good'"), excluded, 5, 3, True, heads, by="candidate")
    assert {(r.rule, r.key) for r in few.where("level = 'error'").collect()} == {("too_few_utterances", "4"), ("too_few_speakers", "2"), ("audio_hash", "audio/3.wav")}
    out = governance.evaluation_set_check(m.withColumn("audio_filepath", F.lit("../x")).withColumn("dialect_expressions", F.array().cast("array<string>")), excluded, 1, 1, True, heads, by="candidate")
    assert {r.rule for r in out.where("level = 'error'").collect()} == {"path_escapes", "no_expressions"}


def test_report_texts(spark):
    df = spark.createDataFrame([("Task-005b-x",), ("run",)], "e string")
    assert [r[0] for r in df.select(reports.report_title(F.col("e"))).collect()] == ["# TASK-005B Human-reviewed Baseline Report", "# Human-reviewed Surface ASR Baseline Report"]
    r = spark.createDataFrame([(0, 2, 0.0, 3, None), (1, 0, 0.5, 3, "c")], "with_confidence int, uncertain int, context_overcorrection_rate double, language_model_bias int, checkpoint_identifier string")
    assert [len(x.limitations) for x in reports.limitations(r).collect()] == [5, 1]


def test_queue_and_transcription_in_batch(spark):
    waiting = streams.review_queue_stream(spark.createDataFrame([("p", "prediction", 1), ("q", "prediction", 1), ("q", "review", None), ("r", "prediction", 0)], "prediction_id string, kind string, flags int"))
    assert {r.prediction_id for r in waiting.where("waiting").collect()} == {"p"}
