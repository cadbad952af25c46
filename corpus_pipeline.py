"""A corpus in five stages, each of which reads the whole output of the one before.

Documents that score as toxic go; chunks of lines that occur elsewhere go, and documents of which nothing is left with them;
one document of each group of near duplicates stays; documents that hold a benchmark item go; what is left is encoded and
decoded.

Defined cases: rows are judged by their own texts, with or without doc_id; null and empty texts pass all stages as they are;
rows repeated whole stay together; an empty table gives an empty result, tables without labels or items reject nothing by
them; other columns, whatever their names, pass the first four stages. Line dedup takes the lines of near copies too, so a
near copy comes to the near-duplicate stage as what sets it apart.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from seqloom.llm import bpe, common, decontaminate, line_dedup, near_dups
from seqloom.llm import toxicity as tox

#: Near duplicates share this percentage of their five-word shingles or more.
SIMILARITY = 80


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return tox.clean(common.prepare(spark), docs, common.table(spark, sf_dir, "labels"))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return line_dedup.dedup(spark, docs, drop_emptied=True)


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dups.keep(spark, docs, SIMILARITY)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs, common.table(spark, sf_dir, "benchmark"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe.digests(spark, docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("toxicity", toxicity),
    ("line dedup", dedup_lines),
    ("near dedup", dedup_documents),
    ("decontamination", decontaminated),
    ("byte-level BPE", encoded),
]
#: A trained classifier, signatures and merges by rank are beyond SQL; the stages are tested one by one.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.settle(spark, stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)
