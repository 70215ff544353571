"""A training corpus from the table of documents: language, toxicity, near copies, repeated passages, packed sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from saltmarsh.llm import language_id, near_dedup, packing, substring_dedup, toxicity
from saltmarsh.llm.common import mark, saved, sweep, table

#: A document of which the best language is less likely than this is not in a language that the model knows.
LEAST_SCORE = 0.5


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the model knows; no text, no letters, or no clear language: they go."""
    model = language_id.train_language_model(docs.select("doc_id", "text", "lang"), ~language_id.held_out(F.col("doc_id")))
    found = language_id.identify_languages(docs, model).where((F.col("lang_pred") != language_id.UNKNOWN) & (F.col("score") >= LEAST_SCORE))
    return found.select(docs.columns)


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are more likely clean than of any grade of toxicity."""
    model = toxicity.train_severity_model(docs.select("doc_id", "text"), table(spark, sf_dir, "labels"))
    return toxicity.score_severity(docs, model).where("not toxic").select(docs.columns)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: that of the least doc_id, where any has one."""
    return near_dedup.keep_one_of_each(docs)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the words of passages of 35 words that occur more than once; n_chars follows."""
    out = substring_dedup.substring_dedup(docs)
    return out.withColumn("text", F.col("kept_text")).withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents' ids and their places in sequences of 1024."""
    return packing.packed_documents(docs)


STAGES = [
    ("language ID", known_language),
    ("toxicity", not_toxic),
    ("MinHash near-dedup", one_of_each),
    ("substring dedup", without_repeats),
    ("best-fit packing", packed),
]

#: Classifiers and sampling have no SQL form; every stage, and run() with its sequences, is tested against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order over the table of documents, each one's rows written to the shared folder and read again."""
    docs, since = table(spark, sf_dir, "documents"), mark()
    for name, stage in STAGES[:-1]:
        own = name.replace(" ", "-").lower()
        docs = saved(stage(spark, docs, sf_dir), own)
        sweep(spark, since, own)  # the tables of the stage, and the rows of the one before
    return STAGES[-1][1](spark, docs, sf_dir)
