"""A cleaning pipeline over `documents`: five stages, each written as Parquet and read again.

Columns: a stage needs doc_id and text, the first one lang too; it returns the columns it was
given, in their order, whatever they are called (names that begin with two underscores are the
operators' own). An empty table stays empty. Repeated rows count as rows until the near-copy
stage, which leaves one of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecpress.llm import decontamination, language_id, line_dedup, near_copies, packing
from vecpress.llm.common import materialize, release, written
from vecpress.llm.queries import tokenizer_path


def keep_known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose language is undetermined: null texts and texts without a letter, and
    all documents if no row has a language to learn from. Rows with a null or repeated doc_id are
    judged by their texts like others; texts of any length are read whole."""
    marked = language_id.identify(docs, docs.columns, ("__lang", "__score"))
    return marked.where(F.col("__lang") != language_id.UNDETERMINED).select(*docs.columns)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes lines that five documents share out of all but the one with the largest doc_id;
    n_chars, if it is there, follows the text of documents that lost a line. A null text becomes
    an empty one. Rows with a null doc_id count for no line and keep theirs; rows that repeat a
    doc_id are one document for the count, and none of them loses lines to the other."""
    out = line_dedup.dedup_lines(docs, names=("__n_lines", "__n_dropped"))
    if "n_chars" in docs.columns:
        cut = F.col("__n_dropped") > 0
        out = out.withColumn("n_chars", F.when(cut, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group whose five-word shingles are alike at 0.8 or more: the row
    with the smallest doc_id, and of rows that repeat it the one with the smallest text hash.
    Texts without a word are alike. Rows with a null doc_id all stay, though they link others."""
    return near_copies.keep_first(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that contain a benchmark item. Items or texts that are null or have no word
    match nothing; rows with a null doc_id stay; of rows that share a doc_id those that hold an
    item go. An empty benchmark drops none."""
    return decontamination.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the documents that stay into sequences of at most 4096 tokens: the pieces of `op2`,
    without other columns. A null or empty text is the end token; each repeated row is packed."""
    return packing.pack_documents(docs, tokenizer_path())


STAGES = [
    ("language_id", keep_known_language),
    ("line_dedup", drop_repeated_lines),
    ("near_dedup", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("best_fit_packing", pack_sequences),
]

#: Trained networks, fingerprints and tokenizers are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each one's result written to the shared folder. A stage's own
    tables and its input are deleted when its result is there."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), written()
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
        release(spark, before, docs)
    return STAGES[-1][1](spark, docs, sf_dir)
