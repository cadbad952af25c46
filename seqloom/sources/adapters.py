"""Tables as token sequences: tablet, pos (from 0), tok, stratum, with a position that orders a tablet's tokens."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from seqloom.operators.relational import dealt


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: Column) -> Column:
    """Lower-case runs of a-z."""
    return F.filter(F.split(F.lower(text), "[^a-z]+"), lambda w: w != "")


def syllables(text: Column) -> Column:
    """Consonant-vowel syllables, an initial consonant or `ng` and one vowel."""
    return F.regexp_extract_all(F.lower(text), F.lit("((?:ng|[ghkmnprtv])?[aeiou])"), 1)


def doc_words(spark: SparkSession, sf_dir: str, stratum: str = "lang", following: bool = False) -> DataFrame:
    """Words of documents. following: with nxt, the word after it (null after the last), and size, the words of its document, which
    both are at hand where a document is read, and else take a shuffle of all words."""
    own = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("tablet"), F.col(stratum).alias("stratum"), words(F.col("text")).alias("w"))
    if not following:
        return own.select("tablet", "stratum", F.posexplode("w").alias("pos", "tok"))
    own = own.select("tablet", "stratum", "w", F.posexplode("w").alias("pos", "tok"))
    return own.select("tablet", "stratum", "pos", "tok", F.get("w", F.col("pos") + 1).alias("nxt"), F.size("w").alias("size"))


def doc_sequences(spark: SparkSession, sf_dir: str, stratum: str = "lang") -> DataFrame:
    """tablet, stratum, seq: each document's words in order as one array; documents without words have no row."""
    own = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("tablet"), F.col(stratum).alias("stratum"), words(F.col("text")).alias("seq"))
    return own.where(F.size("seq") > 0)


def doc_syllables(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("tablet"), F.col("lang").alias("stratum"), syllables(F.col("text")).alias("w"))
    return own.select("tablet", "stratum", F.posexplode("w").alias("pos", "tok"))


def user_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = read(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "ts")
    own = dealt(own, own, "user_id")
    pos = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    return own.select(F.col("user_id").alias("tablet"), F.when(F.col("user_id") % 2 == 0, "pre").otherwise("post").alias("stratum"), pos.alias("pos"), F.col("event_type").alias("tok"), "ts")


def conversation_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = read(spark, sf_dir, "conversations")
    pos = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role")) - 1
    return own.select(F.col("conv_id").alias("tablet"), F.lit("all").alias("stratum"), pos.alias("pos"), F.col("role").alias("tok"))


def part_baskets(spark: SparkSession, sf_dir: str, as_stored: bool = False) -> DataFrame:
    """Part brands by order, early or late by ship date. as_stored: lines of equal number and part, which may differ in stratum,
    stay as the files have them; else any of them is first."""
    stored = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row")] if as_stored else []
    item = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_shipdate", *stored)
    part = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("tok"), "p_type")
    pos = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", *(["file", "row"] if as_stored else []))) - 1
    stratum = F.when(F.year("l_shipdate") < 1998, "pre").otherwise("post")
    return dealt(item.join(part, "l_partkey"), item, "l_orderkey").select(F.col("l_orderkey").alias("tablet"), stratum.alias("stratum"), pos.alias("pos"), "tok", "p_type")
