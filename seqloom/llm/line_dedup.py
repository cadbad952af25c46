"""Line dedup by content-defined chunks of lines, in DataFrame functions only.

A text is its lines, cut at newlines. Each line has a hash, and each pair of neighbouring lines a rolling hash of the two. Two
bits of it place boundaries: the first says in which class chunks begin before the pair, the second in which class they end
after it. In each of the four pairs of classes a chunk runs from each beginning to the next end. All boundaries so depend on
lines within the chunk, a passage has the same chunks wherever it stands, and any two lines in a row are a chunk of some pair
of classes: no repeated passage of two lines or more escapes, but for pieces under MIN_BYTES bytes, as two very short lines meet
by chance. Of chunks with equal bytes the first place, the smallest (doc_id, line), stays; at every other the lines are removed.
A removed line always has an equal one at an earlier place, and the earliest is never removed.

Defined cases: null and empty texts have no chunk and stay as they are; rows without doc_id come after all others; rows
repeated whole are treated alike and keep what each other holds, rows that share a doc_id only are told apart by their texts;
a copy of a document of one line stays; a text of which nothing is left becomes empty, or its row goes with drop_emptied; an
empty table gives an empty table; other columns, whatever their names, come through unchanged, but for `n_chars`, which
follows the new text where it exists.

Plan: hashes alone go through the aggregation, with partial sums, so a chunk that is everywhere costs one row a task, and
through a join that splits skewed keys. Chunks of a document that repeat one other document at the same distance become one
stretch, whose bytes are fetched once. Bitmaps of fixed size tell which texts are asked for or lose lines; no other text
leaves its task.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from seqloom.llm import common

MIN_LINES, MIN_BYTES = 2, 40
#: Bits of the rolling hash that begin and end chunks.
BEGIN, END = 3, 4
#: Bits of a bitmap of documents.
BITS = 1 << 25


def line_hash(line: Column) -> Column:
    return F.conv(F.substring(F.md5(line.cast("binary")), 1, 8), 16, 10).cast("long")


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value computed once."""
    return F.get(F.transform(F.array(value), use), 0)


def _spans(rolled: Column) -> Column:
    """The chunks of all pairs of classes: start and size in lines, both from the rolling hashes of the pairs of lines."""
    bit = lambda x, k: F.shiftright(x, k) % 2

    def of(begin: int, end: int) -> Column:
        ends = F.filter(F.transform(rolled, lambda x, i: F.when(bit(x, END) == end, i)), lambda i: i.isNotNull())

        def to(last: Column, previous: Column) -> Column:
            own = F.filter(F.sequence(previous + 1, last), lambda i: bit(F.get(rolled, i), BEGIN) == begin)
            return F.transform(own, lambda i: F.struct(i.alias("start"), (last - i + MIN_LINES).alias("size")))

        return _let(ends, lambda e: F.flatten(F.transform(e, lambda last, k: to(last, F.when(k == 0, -1).otherwise(F.get(e, k - 1))))))

    return F.concat(*[of(begin, end) for begin in (0, 1) for end in (0, 1)])


def piece(lines: Column, start: Column, size: Column) -> Column:
    return F.array_join(F.slice(lines, start + 1, size), "\n")


def chunks(text: Column) -> Column:
    """Array of structs of the chunks that may be removed: start (from 0), size, and a hash of the bytes."""

    def taken(lines: Column) -> Column:
        rolled = _let(F.transform(lines, line_hash), lambda h: F.zip_with(F.slice(h, 1, F.size(h) - 1), F.slice(h, 2, F.size(h) - 1), lambda a, b: a + b * 3))
        texts = F.transform(_let(rolled, _spans), lambda s: F.struct(s["start"].alias("start"), s["size"].alias("size"), piece(lines, s["start"], s["size"]).alias("t")))
        fit = F.filter(texts, lambda s: F.octet_length(s["t"]) >= MIN_BYTES)
        return F.transform(fit, lambda s: F.struct(s["start"].alias("start"), s["size"].alias("size"), F.xxhash64(s["t"]).alias("hash")))

    return _let(F.split(text, "\n", -1), taken)


def _keyed(docs: DataFrame) -> DataFrame:
    """id, version, text: what tells a text from all others. Rows without doc_id come last."""
    return docs.select(common.order_id("doc_id").alias("id"), F.xxhash64("text").alias("version"), "text")


def _places(docs: DataFrame) -> DataFrame:
    """A row for each chunk: hash and its place, with the version of the document's text."""
    own = _keyed(docs).where(F.contains("text", F.lit("\n"))).select("id", "version", F.explode(chunks(F.col("text"))).alias("c"))
    return own.select("c.hash", F.struct("id", "c.start", "version", "c.size").alias("place"))


def _stretches(docs: DataFrame) -> DataFrame:
    """What is to go if its bytes are equal: start and size in (id, version), and where they stand first: f_id, f_version, f_start."""
    places = _places(docs)
    at = lambda p: F.struct(f"{p}.id", f"{p}.start")
    first = places.groupBy("hash").agg(F.min("place").alias("first"), F.max("place").alias("last")).where(at("first") < at("last"))
    copies = places.join(first.select("hash", "first"), "hash").where(at("place") > at("first"))
    shift = F.col("place.start") - F.col("first.start")
    copies = copies.select("place.*", F.col("first.id").alias("f_id"), F.col("first.version").alias("f_version"), shift.alias("shift"))
    # Chunks that touch or overlap become one.
    keys = ["id", "version", "f_id", "f_version", "shift"]
    run = Window.partitionBy(*keys).orderBy("start")
    before = F.max(F.col("start") + F.col("size")).over(run.rowsBetween(Window.unboundedPreceding, -1))
    copies = copies.withColumn("opens", F.coalesce(F.col("start") > before, F.lit(True)).cast("int")).withColumn("no", F.sum("opens").over(run.rowsBetween(Window.unboundedPreceding, 0)))
    merged = copies.groupBy(*keys, "no").agg(F.min("start").alias("start"), F.max(F.col("start") + F.col("size")).alias("end"))
    return merged.select("id", "version", "start", (F.col("end") - F.col("start")).alias("size"), "f_id", "f_version", (F.col("start") - F.col("shift")).alias("f_start"))


def dedup(spark: SparkSession, docs: DataFrame, drop_emptied: bool = False) -> DataFrame:
    """docs with the repeated chunks taken out of their texts; all rows and columns stay, but with drop_emptied those rows whose
    text had a character other than white space and has none any more."""
    names = docs.columns
    asked = common.settle(spark, _stretches(docs), "stretches")
    sources = common.sieve(_keyed(docs), asked.select("f_id", "f_version"), ["id", "version"], BITS)
    fetched = asked.join(sources.withColumnsRenamed({"id": "f_id", "version": "f_version"}), ["f_id", "f_version"])
    fetched = fetched.select("id", "version", F.struct("start", "size", _let(F.split("text", "\n", -1), lambda ls: piece(ls, F.col("f_start"), F.col("size"))).alias("bytes")).alias("g"))
    id_, version, gone = common.fresh(docs, "id", "version", "gone")
    losses = fetched.groupBy(F.col("id").alias(id_), F.col("version").alias(version)).agg(F.collect_set("g").alias(gone))

    def left(lines: Column) -> Column:
        equal = F.filter(gone, lambda g: piece(lines, g["start"], g["size"]) == g["bytes"])  # bytes decide
        numbers = F.flatten(F.transform(equal, lambda g: F.sequence(g["start"], g["start"] + g["size"] - 1)))
        return F.transform(F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), numbers), lambda i: F.get(lines, i))

    keyed = docs.withColumns({id_: common.order_id("doc_id"), version: F.xxhash64("text")})
    keys = asked.select("id", "version")
    touched = common.sieve(keyed, keys, [id_, version], BITS).join(losses, [id_, version], "left")
    new = F.when(F.col(gone).isNull(), F.col("text")).otherwise(F.array_join(_let(F.split("text", "\n", -1), left), "\n"))
    touched = touched.withColumn(version, F.col("text")).withColumn("text", new)
    if drop_emptied:
        touched = touched.where(F.coalesce(~F.rlike(version, F.lit(r"\S")) | F.rlike("text", F.lit(r"\S")), F.lit(True)))
    if "n_chars" in names:
        touched = touched.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return touched.select(*names).unionByName(common.sieve(keyed, keys, [id_, version], BITS, inside=False).select(*names))


def report(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """doc_id, text after removal, and how many characters went."""
    common.prepare(spark)
    out = dedup(spark, docs.select("doc_id", "text", F.length("text").alias("was")))
    return out.select("doc_id", "text", (F.col("was") - F.length("text")).cast("long").alias("removed_chars"))


ORACLE_SQL = f"""
WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS lines, unnest(lines) AS line, generate_subscripts(lines, 1) AS i FROM documents WHERE text IS NOT NULL),
h AS (SELECT *, ('0x' || substr(md5(line), 1, 8))::BIGINT AS h FROM l),
r AS (SELECT *, h + 3 * lead(h) OVER (PARTITION BY doc_id ORDER BY i) AS rolled FROM h),
p AS (SELECT doc_id, lines, i, min(CASE WHEN (rolled >> {END}) % 2 = y THEN i END) OVER (PARTITION BY doc_id, y ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) + 1 AS j FROM r, (SELECT unnest([0, 1]) AS y)),
k AS (SELECT doc_id, i, j, array_to_string(lines[i:j], chr(10)) AS chunk FROM p WHERE j IS NOT NULL),
f AS (SELECT *, min((doc_id, i)) OVER (PARTITION BY chunk) AS first FROM k WHERE octet_length(encode(chunk)) >= {MIN_BYTES}),
g AS (SELECT DISTINCT doc_id, unnest(range(i, j + 1)) AS i FROM f WHERE (doc_id, i) > first),
t AS (SELECT doc_id, coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE g.i IS NULL), '') AS text FROM l LEFT JOIN g USING (doc_id, i) GROUP BY doc_id)
SELECT d.doc_id, t.text, (length(d.text) - length(t.text))::BIGINT AS removed_chars FROM documents d LEFT JOIN t USING (doc_id)
"""
