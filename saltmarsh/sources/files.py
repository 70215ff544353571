"""Readers and writers: records, predictions, audio, packages, prompt sheets, immutable tables and exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.governance import coverage_check
from .packages import MAX_BYTES, package_members  # noqa: F401


def read_records(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A folder of JSON documents, one a file; a malformed one fails the query."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)


def read_predictions(spark: SparkSession, path: str, schema: T.StructType, blank: str = "skip") -> DataFrame:
    """Lines of JSON as a struct ``record`` beside the raw ``line``; ``problem`` says what is wrong with a line.

    Blank lines are left out (``skip``) or are a problem (``reject``).
    """
    lines = spark.read.text(path).withColumnRenamed("value", "line")
    empty = F.trim("line") == ""
    lines = lines.where(~empty) if blank == "skip" else lines
    parsed = F.try_parse_json("line")
    problem = F.when(empty, "blank").when(parsed.isNull(), "not JSON").when(~F.schema_of_variant(parsed).startswith("OBJECT"), "not an object")
    return lines.select("line", F.from_json("line", schema).alias("record"), problem.alias("problem"))


def precomputed(lines: DataFrame, manifest: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows, violations) of predictions made elsewhere: lines of read_predictions(blank="reject") against a manifest.

    The records have utterance_id.  Rows are the manifest's entries with their record, of ids that occur once; a blank or broken line is a
    violation, and so is an id that is missing, unexpected or there more than once.
    """
    good = lines.where("problem is null").select("record", "record.utterance_id")
    once = good.groupBy("utterance_id").agg(F.count("*").alias("_n"), F.first("record").alias("record")).where("_n = 1").drop("_n")
    broken = lines.where("problem is not null").select(F.lit("line").alias("rule"), F.col("problem").alias("key"), F.col("line").alias("detail"))
    return manifest.join(once, "utterance_id"), broken.unionByName(coverage_check(manifest, good, "utterance_id"))


def read_audio(spark: SparkSession, path: str, pattern: str = "*.wav") -> DataFrame:
    """path, length, content, sha256 and problem of files; those of more than MAX_BYTES have null content and are ``too large``.

    Sizes are listed without reading; only the content of files that are small enough is read.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(path)
    small = files.where(F.col("length") <= MAX_BYTES).select("path", "length", "content", F.sha2("content", 256).alias("sha256"), F.lit(None).cast("string").alias("problem"))
    large = files.where(F.col("length") > MAX_BYTES).select("path", "length", F.lit(None).cast("binary").alias("content"), F.lit(None).cast("string").alias("sha256"), F.lit("too large").alias("problem"))
    return small.unionByName(large)


def list_recordings(spark: SparkSession, path: str) -> DataFrame:
    """Numbers of files named New Recording [n].m4a (none: 1); ``status`` tells other names; hidden files are left out.

    Of several files of one number all but the first by name are ``duplicate``.
    """
    files = spark.read.format("binaryFile").load(path).select("path", "length")
    name = F.url_decode(F.element_at(F.split("path", "/"), -1))
    digits = F.regexp_extract("name", r"^New Recording(?: (\d+))?\.m4a$", 1)
    files = files.select(name.alias("name"), "length").where(~F.startswith(F.col("name"), F.lit("."))).withColumn("digits", digits)
    fits = F.col("name").rlike(r"^New Recording(?: \d+)?\.m4a$")
    status = F.when(fits, "ok").when(F.col("name").rlike(r"\.m4a$"), "unexpected").otherwise("unsupported")
    numbered = files.select("name", "length", F.when(fits, F.when(F.col("digits") == "", 1).otherwise(F.col("digits").cast("int"))).alias("number"), status.alias("status"))
    place = F.row_number().over(Window.partitionBy("number").orderBy("name"))
    return numbered.withColumn("status", F.when(F.col("number").isNotNull() & (place > 1), "duplicate").otherwise(F.col("status")))


def read_prompt_sheet(spark: SparkSession, path: str) -> DataFrame:
    """(number, text, n) of lines ``- T004-S001: text``; n above 1 is a repeated number."""
    pattern = r"^- T\d{3}-S(\d{3}): (.+)$"
    lines = spark.read.text(path).where(F.col("value").rlike(pattern))
    rows = lines.select(F.regexp_extract("value", pattern, 1).cast("int").alias("number"), F.trim(F.regexp_extract("value", pattern, 2)).alias("text"))
    return rows.groupBy("number").agg(F.min("text").alias("text"), F.count("*").alias("n"))


def read_collection_prompts(spark: SparkSession, path: str) -> DataFrame:
    schema = "schema_version string, prompt_id string, recommended_split string, elicitation_text string, target_expressions array<string>, scenario string, prompt_status string, approved_by string"
    return spark.read.schema(schema).json(path)


def row_hash(df: DataFrame, *leave: str) -> Column:
    """SHA-256 of canonical_row."""
    return F.sha2(canonical_row(df, *leave), 256)


def append_immutable(df: DataFrame, path: str, key: str) -> DataFrame:
    """Adds the rows whose key the Parquet table at ``path`` lacks; returns the conflicts: same key, other content.

    Equal rows are left alone.  One writer at a time; nothing is written if there is a conflict.  ``path`` may not exist yet.
    """
    spark = df.sparkSession
    fs_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not fs_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(fs_path):
        clash = df.groupBy(key).agg(F.countDistinct(row_hash(df)).alias("contents")).where("contents > 1")
        if clash.isEmpty():
            df.dropDuplicates([key]).write.parquet(path)
        return clash.select(key)
    have = spark.read.schema(df.schema).parquet(path).join(df.select(key).distinct(), key, "left_semi")  # only rows that come again are hashed
    old = have.select(key, row_hash(have).alias("old"))
    new = df.withColumn("_new", row_hash(df))
    inside = new.groupBy(key).agg(F.countDistinct("_new").alias("contents")).where("contents > 1").select(key)
    clash = new.join(old, key).where("_new <> old").select(key).union(inside).distinct()
    if clash.isEmpty():
        df.join(old, key, "left_anti").dropDuplicates([key]).write.mode("append").parquet(path)
    return clash


def append_errors(cases: DataFrame, path: str) -> None:
    """Appends cases with failure flags to a JSON-lines export."""
    cases.where(F.size("flags") > 0).write.mode("append").json(path)


def write_sorted_jsonl(df: DataFrame, path: str, *order: str, files: int | None = None) -> None:
    """JSON lines in order over files that are ranges of it (as many as shuffle partitions, or ``files``); same rows, same lines."""
    ranged = df.repartitionByRange(*order) if files is None else df.repartitionByRange(files, *order)
    ranged.sortWithinPartitions(*order).write.json(path)


def export_training_rows(entries: DataFrame, violations: DataFrame, path: str) -> bool:
    """Writes the rows by split, if there are no violations; says whether it did."""
    if not violations.isEmpty():
        return False
    entries.write.partitionBy("split").json(path)
    return True


def verified_files(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """manifest (path, sha256) with status verified, missing or mismatch from files (path, sha256)."""
    have = files.select("path", F.col("sha256").alias("found"))
    status = F.when(F.col("found").isNull(), "missing").when(F.col("found") == F.col("sha256"), "verified").otherwise("mismatch")
    return manifest.join(have, "path", "left").withColumn("status", status).drop("found")


def verified_export(manifest: DataFrame, files: DataFrame, path: str) -> DataFrame:
    """Writes manifest (path, sha256, more) as JSON lines if all its files are there with their hashes; gives those that aren't."""
    wrong = verified_files(manifest, files).where("status <> 'verified'").select("path", "status")
    if wrong.isEmpty():
        manifest.write.json(path)
    return wrong


def canonical_row(df: DataFrame, *leave: str) -> Column:
    """A row as JSON with its columns, and the fields of structs in them, in order of name; nulls stay."""
    def ordered(c: Column, kind: T.DataType) -> Column:
        if isinstance(kind, T.StructType):
            return F.when(c.isNotNull(), F.struct(*[ordered(c[f.name], f.dataType).alias(f.name) for f in sorted(kind.fields, key=lambda f: f.name)]))
        if isinstance(kind, T.ArrayType):
            return F.transform(c, lambda x: ordered(x, kind.elementType))
        return c

    fields = sorted((f for f in df.schema.fields if f.name not in leave), key=lambda f: f.name)
    return F.to_json(F.struct(*[ordered(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in fields]), {"ignoreNullFields": "false"})


def report_lines(cases: DataFrame) -> DataFrame:
    """Table lines of a report: id, texts with bars escaped, error rate with four decimals.

    With ``matches`` (array of structs surface_form and match_status) a cell of these, and with ``flags`` one of the failure types.
    """

    def cell(c: str) -> Column:
        return F.regexp_replace(F.coalesce(F.col(c), F.lit("")), r"\|", r"\\|")

    cells = [F.col("case_id").cast("string"), cell("reference"), cell("hypothesis"), F.format_string("%.4f", "cer")]
    if "matches" in cases.columns:
        told = F.transform("matches", lambda m: F.concat(m["surface_form"], F.lit(": "), m["match_status"]))
        cells.append(F.regexp_replace(F.coalesce(F.array_join(told, ", "), F.lit("")), r"\|", r"\\|"))
    if "flags" in cases.columns:
        cells.append(F.array_join("flags", ", "))
    return cases.select("case_id", F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("line"))
