"""The registered queries of the subpackage and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from seqloom.llm import common

#: The surrogates' key; a caller of the operator brings its own.
KEY = "not a secret: for reproducible queries"


def op3_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from seqloom.llm import pii

    return pii.report(spark, common.table(spark, sf_dir, "documents"), KEY)


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from seqloom.llm import quality

    return quality.score(spark, common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels"))


def op5_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    from seqloom.llm import ann

    return ann.search(spark, common.table(spark, sf_dir, "embeddings"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from seqloom.llm import toxicity

    return toxicity.scored(spark, common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels"))


def op1_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    from seqloom.llm import lm

    return lm.score(spark, common.table(spark, sf_dir, "documents"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from seqloom.llm import line_dedup

    return line_dedup.report(spark, common.table(spark, sf_dir, "documents"))


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from seqloom.llm import decontaminate

    return decontaminate.report(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))


def op9_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from seqloom.llm import near_dups

    return near_dups.find(spark, common.table(spark, sf_dir, "documents"))


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from seqloom.llm import bpe

    return bpe.digests(spark, common.table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from seqloom.llm import secrets

    return secrets.report(spark, common.table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_lm, op2_line_dedup, op3_surrogates, op4_quality, op5_neighbours, op6_toxicity, op7_decontaminate, op8_secrets, op9_minhash, op10_bpe)}


def oracles() -> dict[str, str]:
    from seqloom.llm import decontaminate, line_dedup

    return {"op2_line_dedup": line_dedup.ORACLE_SQL, "op7_decontaminate": decontaminate.oracle()}
