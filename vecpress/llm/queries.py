"""The registered queries of the training-data operators, and the DuckDB SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from vecpress.llm import chat_format, conversation_repair, decontamination, language_id, line_dedup, lm_scoring, nearest, packing
from vecpress.llm import sharding, simhash, spelling_variants, token_counts, toxicity


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def _op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.digest(_documents(spark, sf_dir))


def _op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_documents(spark, sf_dir), tokenizer_path())


def _op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.digest(_documents(spark, sf_dir))


def _op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.digest(_documents(spark, sf_dir))


def _op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest.digest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def _op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contained(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def _op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.digest(_documents(spark, sf_dir))


def _op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.digest(_documents(spark, sf_dir))


def _op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_format.digest(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def _op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(_documents(spark, sf_dir).select("doc_id", "text"), tokenizer_path())


def _op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.digest(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def _op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_repair.digest(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def _op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants.group_variants(_documents(spark, sf_dir))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_shard_splitters": _op1,
        "op2_best_fit_packing": _op2,
        "op3_language_id": _op3,
        "op4_stupid_backoff": _op4,
        "op5_nearest_blocks": _op5,
        "op6_decontamination": _op6,
        "op7_line_dedup": _op7,
        "op8_simhash": _op8,
        "op9_chat_rotation": _op9,
        "op10_token_counts": _op10,
        "op11_toxicity": _op11,
        "op12_conversation_repair": _op12,
        "op13_spelling_variants": _op13,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op4_stupid_backoff": lm_scoring.ORACLE,
        "op5_nearest_blocks": nearest.ORACLE,
        "op7_line_dedup": line_dedup.ORACLE,
        "op9_chat_rotation": chat_format.ORACLE,
        "op13_spelling_variants": spelling_variants.ORACLE,
    }
