"""Readers and writers of token corpora: JSON, XML, CSV, text and count tables in; Parquet, JSON, CSV and Markdown out.

Every reader declares its schema; unreadable records are kept in `_corrupt_record` and can be counted, none is dropped silently.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from seqloom.functions import codes

GLYPH = "struct<position int, side string, line string, glyph_num string, barthel_code string, horley_code string, horley_components array<string>, inverted boolean, uncertain boolean>"
TABLET = f"tablet_id string, cluster string, glyphs array<{GLYPH}>, _corrupt_record string"
SIDES = {"a": 0, "b": 1, "c": 2, "r": 0, "v": 1}


def tablets(spark: SparkSession, path: str) -> DataFrame:
    """One JSON document a tablet; its file's stem where it has no id."""
    own = spark.read.schema(TABLET).option("multiLine", True).option("mode", "PERMISSIVE").json(path)
    stem = F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)\.json$", 1)
    return own.withColumn("tablet_id", F.coalesce("tablet_id", stem))


def corrupt(rows: DataFrame) -> int:
    return rows.cache().where("_corrupt_record is not null").count()


def metadata(spark: SparkSession, path: str) -> DataFrame:
    """A JSON object of objects by tablet: tablet_id, name, min_ce, max_ce, median_ce."""
    item = "map<string, struct<name: string, min_CE: int, max_CE: int, median_CE: double>>"
    own = spark.read.text(path, wholetext=True).select(F.from_json("value", item).alias("m"))
    own = own.select(F.explode("m").alias("tablet_id", "v")).where(~F.col("tablet_id").startswith("_"))
    return own.select("tablet_id", F.col("v.name").alias("name"), F.col("v.min_CE").alias("min_ce"), F.col("v.max_CE").alias("max_ce"), F.col("v.median_CE").alias("median_ce"))


def corpus(tablets: DataFrame, metadata: DataFrame, least: int) -> DataFrame:
    """Tablets with metadata and at least `least` glyphs, with the middle of their dates."""
    own = tablets.where(F.size("glyphs") >= least).join(F.broadcast(metadata), "tablet_id")
    return own.withColumn("midpoint", codes.midpoint(F.col("median_ce"), F.col("min_ce"), F.col("max_ce")))


def reading_order(tablets: DataFrame, uncertain: bool = False) -> DataFrame:
    """Tokens in reading order: sides, lines, places in a line; a line of which more than half is inverted runs backwards;
    a glyph without a code gives its components; uncertain ones only on demand."""
    side = F.lower(F.coalesce(F.col("g.side"), F.lit("a")))
    rank = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for p in SIDES.items() for x in p]), side), F.lit(9))
    own = tablets.select("tablet_id", F.posexplode("glyphs").alias("k", "g"))
    own = own.select("tablet_id", "k", side.alias("side"), rank.alias("side_rank"), F.coalesce(F.col("g.line").try_cast("int"), F.lit(0)).alias("line"), F.coalesce(F.col("g.glyph_num").try_cast("int"), F.lit(0)).alias("num"), "g")
    line = Window.partitionBy("tablet_id", "side", "line")
    back = 2 * F.count_if(F.coalesce(F.col("g.inverted"), F.lit(False))).over(line) > F.count("*").over(line)
    own = own.withColumn("back", back)
    own = own if uncertain else own.where(~F.coalesce(F.col("g.uncertain"), F.lit(False)))
    code = F.when(F.length(F.col("g.horley_code")) > 0, F.array("g.horley_code")).otherwise(F.coalesce("g.horley_components", F.array().cast("array<string>")))
    own = own.select("tablet_id", "side", "side_rank", "line", F.when(F.col("back"), -F.col("num")).otherwise(F.col("num")).alias("at"), F.when(F.col("back"), -F.col("k")).otherwise(F.col("k")).alias("tie"), F.posexplode(code).alias("part", "tok"))
    order = Window.partitionBy("tablet_id").orderBy("side_rank", "line", "at", "tie", "part")
    return own.select(F.col("tablet_id").alias("tablet"), "side", "line", (F.row_number().over(order) - 1).alias("pos"), "tok")


def lines(tokens: DataFrame) -> DataFrame:
    """One row a line, with its tokens and the parity of its number."""
    seq = F.transform(F.array_sort(F.collect_list(F.struct("pos", "tok"))), lambda x: x["tok"])
    return tokens.groupBy("tablet", "side", "line").agg(seq.alias("seq")).withColumn("parity", F.when(F.pmod("line", F.lit(2)) == 1, "odd").otherwise("even"))


def xml_tablets(spark: SparkSession, path: str) -> DataFrame:
    """tablet_id, side, line, position, code from XML of sides, lines and glyphs; empty codes dropped, `_` read as `?`."""
    glyph = "array<struct<_ceipp string>>"
    schema = f"_id string, side array<struct<_name string, line array<struct<_number string, glyph {glyph}>>>>"
    own = spark.read.format("xml").option("rowTag", "tablet").schema(schema).load(path)
    own = own.select(F.col("_id").alias("tablet_id"), F.posexplode("side").alias("i", "s")).select("tablet_id", "i", F.col("s._name").alias("side"), F.posexplode("s.line").alias("j", "l"))
    own = own.select("tablet_id", "i", "side", "j", F.col("l._number").alias("line"), F.posexplode("l.glyph").alias("k", "g")).where("length(g._ceipp) > 0")
    order = Window.partitionBy("tablet_id").orderBy("i", "j", "k")
    return own.select("tablet_id", "side", "line", F.row_number().over(order).alias("position"), F.translate("g._ceipp", "_", "?").alias("code"))


def passages(spark: SparkSession, path: str) -> DataFrame:
    """CSV of passages: the first row of an id is its canonical form, the rest are variants."""
    schema = "passage_id string, tablet_id string, side string, stratum string, start_position int, glyph_sequence string"
    own = spark.read.schema(schema).option("header", True).option("enforceSchema", False).csv(path)
    own = own.withColumn("ord", F.monotonically_increasing_id()).withColumn("form", F.filter(F.split(F.trim("glyph_sequence"), r"\s+"), lambda x: x != ""))
    rank = F.row_number().over(Window.partitionBy("passage_id").orderBy("ord"))
    return own.withColumn("canonical", rank == 1).drop("glyph_sequence")


def passage_json(spark: SparkSession, path: str) -> DataFrame:
    """Nested passages; `variants` or else `attestations`, `tablet_id` or else `tablet`."""
    v = "array<struct<form: array<string>, tablet_id: string, tablet: string, stratum: string, side: string, start_position: int>>"
    own = spark.read.schema(f"passages array<struct<passage_id: string, canonical_form: array<string>, variants: {v}, attestations: {v}>>").option("multiLine", True).json(path)
    own = own.select(F.explode("passages").alias("p")).select("p.passage_id", F.col("p.canonical_form").alias("canonical"), F.explode(F.coalesce("p.variants", "p.attestations")).alias("v"))
    return own.select("passage_id", "canonical", F.col("v.form").alias("form"), F.coalesce("v.tablet_id", "v.tablet").alias("tablet_id"), "v.stratum", F.coalesce("v.start_position", F.lit(-1)).alias("start_position"))


def boundaries(passages: DataFrame) -> DataFrame:
    """(tablet_id, position) of the first and last place of each form."""
    ends = F.array("start_position", F.col("start_position") + F.size("form") - 1)
    return passages.where("start_position >= 0 and size(form) > 0").select("tablet_id", F.explode(ends).alias("position")).distinct()


def parallels(spark: SparkSession, path: str) -> DataFrame:
    """CSV of ID, Line, Sequence: padded ids, tablet, side, line and codes; rows without codes are dropped."""
    own = spark.read.schema("ID string, Line string, Sequence string").option("header", True).csv(path)
    own = own.select(F.concat(F.lit("H"), F.lpad("ID", 3, "0")).alias("passage_id"), codes.line_field(F.col("Line")).alias("l"), codes.code_sequence(F.col("Sequence")).alias("codes"))
    return own.where(F.size("codes") > 0).select("passage_id", "l.*", "codes")


def count_table(spark: SparkSession, path: str, order: int) -> DataFrame:
    """Lines `count TAB t1,t2,..` as a model table; comments, malformed lines and n-grams over the order are left out."""
    own = spark.read.text(path).where("value not like '#%'").select(F.split_part("value", F.lit("\t"), F.lit(1)).try_cast("long").alias("f"), F.split(F.split_part("value", F.lit("\t"), F.lit(2)), ",").alias("t"))
    own = own.where(F.col("f").isNotNull() & (F.size("t") <= order) & (F.get("t", F.lit(0)) != ""))
    return own.select(F.size("t").alias("n"), F.slice("t", F.lit(1), F.size("t") - 1).alias("ctx"), F.element_at("t", -1).alias("tok"), "f").groupBy("n", "ctx", "tok").agg(F.sum("f").alias("f"))


def frequency_list(spark: SparkSession, path: str) -> DataFrame:
    """Lines `count TAB word`: normalised words in order, the first of equals."""
    own = spark.read.text(path).withColumn("ord", F.monotonically_increasing_id())
    own = own.select(F.split_part("value", F.lit("\t"), F.lit(1)).try_cast("long").alias("f"), codes.normalised(F.split_part("value", F.lit("\t"), F.lit(2))).alias("word"), "ord").where("f is not null and word <> ''")
    return own.groupBy("word").agg(F.min_by("f", "ord").alias("f"), F.min("ord").alias("ord"))


def text_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.col("_metadata.file_name").alias("file"), F.col("value").alias("line"))


def write_table(rows: DataFrame, path: str, *by: str, mode: str = "overwrite") -> None:
    writer = rows.write.mode(mode)
    (writer.partitionBy(*by) if by else writer).parquet(path)


def write_json(rows: DataFrame, path: str) -> None:
    rows.select(F.to_json(F.struct("*")).alias("value")).write.mode("overwrite").text(path)


def write_csv(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("header", True).csv(path)


def markdown(rows: DataFrame, most: int = 100) -> str:
    """A report of the first rows, which is a document for people and so bounded."""
    head = "| " + " | ".join(rows.columns) + " |\n|" + "---|" * len(rows.columns)
    return "\n".join([head, *["| " + " | ".join("" if v is None else str(v) for v in r) + " |" for r in rows.limit(most).collect()]])


def checksum(spark: SparkSession, path: str) -> str:
    """SHA-256 over the bytes of the files, in order of their paths; one partition of them at a time reaches the driver."""
    own, whole = spark.read.format("binaryFile").load(path).select("path", "content").orderBy("path"), hashlib.sha256()
    for row in own.toLocalIterator():
        whole.update(row.content)
    return whole.hexdigest()


def stamped(rows: DataFrame, **facts: object) -> DataFrame:
    """rows with a constant struct of what made them."""
    return rows.withColumn("_provenance", F.struct(*[F.lit(v).alias(k) for k, v in facts.items()]))
