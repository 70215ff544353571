"""Lineage to the root, archives as closures, and audits, on small cases."""

from pyspark.sql import functions as F

from saltmarsh.functions import text
from saltmarsh.operators import audits, calibration, closure, governance


def test_every_asset_to_its_root(spark):
    chain = [("long", str(i), str(i - 1) if i else None) for i in range(300)]
    rows = [*chain, ("ring", "a", "c"), ("ring", "b", "a"), ("ring", "c", "b"), ("ring", "tail", "a"), ("self", "x", "x"), ("hang", "m", "gone"), ("hang", "n", "m"), ("two", "r1", None), ("two", "r2", None), ("two", "k", "r2"), (None, "q", None), (None, "p", "q"), ("other", "1", "0")]
    got = {(r.utterance_id, r.sha256): (r.ended, r.root_sha256, r.depth) for r in closure.lineage_roots(spark.createDataFrame(rows, "utterance_id string, sha256 string, parent_sha256 string")).collect()}
    assert all(got["long", str(i)] == ("root", "0", i) for i in range(300))
    assert {k: v for k, v in got.items() if k[0] != "long"} == {
        ("ring", "a"): ("cycle", None, None), ("ring", "b"): ("cycle", None, None), ("ring", "c"): ("cycle", None, None), ("ring", "tail"): ("cycle", None, None), ("self", "x"): ("cycle", None, None), ("hang", "m"): ("dangling", "m", 0),
        ("hang", "n"): ("dangling", "m", 1), ("two", "r1"): ("root", "r1", 0), ("two", "r2"): ("root", "r2", 0), ("two", "k"): ("root", "r2", 1), (None, "q"): ("root", "q", 0), (None, "p"): ("root", "q", 1), ("other", "1"): ("dangling", "1", 0),
    }


def test_lineage_rules(spark):
    rows = [("u", "original", "1", None, 44_100, 2, "aac"), ("u", "master_48k_stereo", "2", "1", 48_000, 2, "pcm_s24le"), ("u", "asr_16k_mono", "3", "2", 16_000, 1, "pcm_s16le"), ("v", "original", "4", None, 8000, 1, None), ("v", "original", "5", None, 8000, 1, None), ("w", "tts_48k_mono", "6", "6", 48_000, 1, None)]
    got = closure.lineage_violations(spark.createDataFrame(rows, "utterance_id string, role string, sha256 string, parent_sha256 string, rate int, channels int, codec string"))
    assert {tuple(r) for r in got.collect()} == {("two_roots", "v", "2"), ("cycle", "w", "6"), ("no_root", "w", "0"), ("format", "w", "6")}


def test_what_goes_with_a_record(spark):
    make = lambda rows, kind: spark.createDataFrame(rows, kind)
    tables = {
        "records": make([(1,), (2,), (3,)], "id long"),
        "predictions": make([(10, 1, "a"), (11, 2, "a"), (12, 1, "b"), (13, None, "c")], "id long, of long, file string"),
        "reviews": make([(100, 10), (101, 11), (102, 12)], "id long, of long"),
        "lists": make([("l1", [2, 3]), ("l2", [3, 1]), ("l3", None)], "id string, of array<bigint>"),
        "reports": make([("r1", "about <1> and <2>"), ("r2", "about <12>"), ("r3", None)], "id string, body string"),
        "notes": make([("n1", "n3"), ("n2", "n1"), ("n3", "n2"), ("n4", None)], "id string, before string"),
        "files": make([("a",), ("b",), ("c",), ("d",)], "id string"),
    }
    links = [closure.Link("predictions", "of", "records"), closure.Link("reviews", "of", "predictions"), closure.Link("lists", "of", "records", "array"), closure.Link("reports", "body", "records", "text", ("<", ">")), closure.Link("notes", "before", "notes")]
    gone = closure.archive_closure({"records": make([(1,), (99,)], "id long"), "notes": make([("n2",)], "id string")}, tables, links, {"files": [("predictions", "file")]})
    assert {name: {r.id for r in g.collect()} for name, g in gone.items()} == {"records": {1}, "predictions": {10, 12}, "reviews": {100, 102}, "lists": {"l2"}, "reports": {"r1"}, "notes": {"n1", "n2", "n3"}, "files": {"b"}}
    for kept, archived in closure.archive_split(gone, tables).values():
        assert not {r.id for r in kept.collect()} & {r.id for r in archived.collect()}
    none = closure.archive_closure({}, tables, links)
    assert all(g.isEmpty() for g in none.values())


def test_quoted_lists_mean_the_same(spark):
    kind = "source string, utterance_id int, surface_text string, labels array<struct<surface_form:string,normalized_forms:array<string>>>"
    stored = spark.createDataFrame([("x", 1, "t", [('"a1", "b2"', ["p", "q"])]), ("y", 1, "t", [("c", [])]), ("z", 1, "t", None)], kind)
    canonical = spark.createDataFrame([("x", 1, "t", [("b2", ["q"]), ("a1", ["p"])]), ("y", 1, "T", [("c", [])]), ("w", 1, "t", None)], kind)
    got = {r.source: (r.stored_raw, r.canonical_raw, r.stored_structure, r.decision) for r in audits.benchmark_audit(stored, canonical).collect()}
    assert got == {"x": (1, 2, "legacy_quoted_compound", "audited_semantic_equivalence_keep_version"), "y": (1, 1, "expanded_labels", "different_content"), "z": (0, None, "expanded_labels", "only_stored"), "w": (None, 0, None, "only_canonical")}
    terms = spark.createDataFrame([('" s0-0 ", "11"',)], "t string").select(text.split_label_terms(F.col("t")).alias("t")).first().t
    assert terms == ["s0-0", "11"]


def test_bundles_and_members(spark):
    index = spark.createDataFrame([("b", p, s, h) for p, s, h in (("ok", 1, "1"), ("size", 1, "1"), ("hash", 1, "1"), ("lost", 1, "1"), ("link", 1, "1"), ("../up", 1, "1"), ("/abs", 1, "1"), ("", 1, "1"), ("ok", 1, "1"), (None, 1, "1"))], "bundle string, relative_path string, size_bytes int, sha256 string")
    files = spark.createDataFrame([("b", p, s, h, k) for p, s, h, k in (("ok", 1, "1", False), ("size", 2, "1", False), ("hash", 1, "2", None), ("link", 1, "1", True), ("more", 1, "1", False), ("MANIFEST.json", 9, "m", False))], "bundle string, path string, size int, sha256 string, is_symlink boolean")
    found = audits.bundle_audit(index, files)
    assert sorted((r.path, r.status) for r in found.collect()) == sorted([("ok", "verified"), ("size", "size_mismatch"), ("hash", "hash_mismatch"), ("lost", "missing"), ("link", "missing"), ("more", "unexpected"), ("../up", "unsafe"), ("/abs", "unsafe"), ("", "unsafe"), ("", "unsafe"), ("ok", "duplicate")])
    assert audits.bundle_result(found).first().passed is False and audits.bundle_result(found.where("status = 'verified'")).first().passed
    stated = spark.createDataFrame([("b", "m"), ("c", "m")], "bundle string, sha256 string")
    assert {(r.bundle, r.matches) for r in audits.manifest_check(stated, files).collect()} == {("b", True), ("c", False)}
    members = spark.createDataFrame([("a/", "dir"), ("a/b", "file"), ("../c", "file"), ("d", "symlink"), ("e\\f", "file")], "name string, kind string")
    assert {tuple(r) for r in audits.member_safety(members).collect()} == {("unsafe_path", "../c"), ("unsupported_member", "d"), ("unsafe_path", "e\\f")}


def test_blinded_reviews(spark):
    d = audits.DECISIONS
    kind = "review int, position int, item_id string, utterance_id string, " + ", ".join(f"{c} string" for c in d) + ", status string"
    full = ("A", *["x"] * 6)
    results = spark.createDataFrame([(1, 0, "i", "u", *full, "complete"), (1, 1, "j", "v", "B", *["x"] * 6, "complete"), (1, 2, "k", "w", "tie", *["x"] * 6, "complete"), (2, 0, "i", "u", "A", *["x"] * 5, None, "in_progress"), (3, 0, "k", "u", *full, "complete"), (3, 2, "m", "n", *full, "complete")], kind)
    queue = spark.createDataFrame([(1, 0, "i", "u"), (1, 1, "j", "v"), (1, 2, "k", "w"), (2, 0, "i", "u"), (3, 0, "i", "u"), (3, 1, "m", "n")], "review int, position int, item_id string, utterance_id string")
    key = spark.createDataFrame([(1, "i", "ours", "base"), (1, "j", "ours", "base"), (2, "i", "ours", "base"), (3, "k", "ours", "base")], "review int, item_id string, A string, B string")
    assert {tuple(r) for r in audits.blind_review_violations(queue, results, True).collect()} == {("pair_differs", "3/0"), ("row_missing", "3/1"), ("row_extra", "3/2"), ("key_before_completion", "2")}
    assert {(r.review, r.total_items, r.reviewed_items) for r in audits.blind_review_status(results).collect()} == {(1, 3, 3), (2, 1, 0), (3, 2, 2)}
    got = {r.review: (r.wins, r.losses, r.ties, r.decisive, r.preference_rate) for r in audits.blind_review_summary(results, key, "ours", "base").collect()}
    assert got == {1: (1, 1, 1, 2, 0.5), 3: (1, 0, 0, 1, 1.0)}


def test_repeated_rules_and_members_of_groups(spark):
    rules = spark.createDataFrame([("s", ["b"], []), ("s", ["a"], []), ("t", [], [])], "surface_form string, variants array<string>, standards array<string>")
    for r in (rules, rules.orderBy("variants")):
        got = calibration.attach_rules(spark.createDataFrame([("s",), ("t",), ("z",)], "surface_form string"), r).collect()
        assert {(x.surface_form, tuple(x.variants) if x.variants is not None else None, x.rule_count) for x in got} == {("s", ("a",), 2), ("t", (), 1), ("z", None, None)}
    entries = spark.createDataFrame([(1, "A b", "train"), (2, "a B!", "validation"), (3, "c", "train")], "utterance_id int, surface_text string, split string")
    assert {(r.utterance_id, r.level) for r in governance.duplicate_surface_members(entries).collect()} == {(1, "error"), (2, "error")}
    ids = entries.select(text.import_utterance_id(F.lit("i"), F.lit("p"), F.lit("s"), "name").alias("u")).first().u
    import uuid

    assert ids == str(uuid.uuid5(uuid.NAMESPACE_URL, "name:i:p:s"))
