"""Queries of this package, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roadlake.functions.storage import written
from roadlake.llm import byte_bpe, decontamination, language_id, license_scan, personal_data, quality_knn, quality_rules, repeated_strings, secret_scan, simhash, source_audit, token_counts, vector_codes
from roadlake.llm.oracles import ORACLE


def vocabulary_path(name: str = "byte_bpe_multi_50k.tiktoken") -> str:
    """Where the public rank file lies; callers of the operators may name any other."""
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _remainder(modulus: int, value: int):
    """Whether crc32 of the id, as text, leaves this remainder; a null id never does."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus == value, F.lit(False))


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.predictions(table(spark, sf_dir, "documents"), _remainder(4, 2))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    lengths = docs.select(byte_bpe.token_lengths(spark, vocabulary_path(), F.col("text")).alias("n"))
    return token_counts.context_limits(written(token_counts.length_histogram(lengths, F.col("n"))))


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.encode_digests(table(spark, sf_dir, "documents"), vocabulary_path())


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan_digests(table(spark, sf_dir, "documents"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.digests(table(spark, sf_dir, "documents"))


def op6_repeated_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_strings.digests(table(spark, sf_dir, "documents"))


def op7_quality_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_knn.predictions(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), _remainder(3, 1))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.verdicts(table(spark, sf_dir, "documents"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.digests(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents"))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.codes(table(spark, sf_dir, "embeddings"))


def op12_source_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_audit.audit(table(spark, sf_dir, "documents"))


def op13_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data.scan_digests(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    first = (op1_language_id, op2_token_counts, op3_byte_bpe, op4_secret_scan, op5_simhash, op6_repeated_strings, op7_quality_knn)
    return {f.__name__: f for f in (*first, op8_quality_rules, op9_decontamination, op10_license_scan, op11_vector_codes, op12_source_audit, op13_personal_data)}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
