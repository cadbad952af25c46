"""Benchmark decontamination by spaced seeds, in DataFrame functions only.

A seed looks at consecutive words through a fixed mask and hashes only the words at the mask's ones, so a substituted word at
a zero doesn't matter. Benchmark items and documents are hashed at every position under every mask; equal hashes give an
alignment of item and document, in which all words of the item are compared in place. A document is contaminated by an item
if SHARE of the item's words stand in place, or if some stretch of the alignment scores RUN (a word in place adds 1, another
takes away 2; never below 0).

Words are `[^\\x20\\x09-\\x0D]+` of the lower-cased text. All items of SPAN words or more have the seeds of MASKS; those under
LONG words, in which SHARE allows substitutions that every one of these may meet, have those of SHORT_MASKS too: together they
find every placing of the substitutions that SHARE allows (enumerated in the tests). Items under SPAN words are hashed whole,
with each single word left out where SHARE allows one substitution, so nothing is missed there either.

Defined cases: null and empty texts and items have no words and match nothing, nor do items without item_id; rows are judged by
their own texts, with or without doc_id; repeated rows are judged alike; ties can't arise, as all items found are listed; empty
tables give no match; other columns of the documents, whatever their names, come through `clean` unchanged.

Plan: the words of a document stay in its row, windows and masks are generated beside them, and the seeds of the benchmark,
being few, are broadcast after their number is checked (MAX_BROADCAST). No shuffle happens before the verified matches, which
are grouped by document with partial sums. Beyond that number seeds and positions alone are shuffled, and only texts with a
hit follow, chosen by a bitmap of fixed size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqloom.llm import common

#: Fixed masks; each has weight 6 of span 9.
MASKS = ("110100111", "111011010", "101110011")
#: For items under LONG words.
SHORT_MASKS = ("11011", "110101")
SPAN, LONG = len(MASKS[0]), 25
SHARE, RUN = 0.8, 13
MAX_BROADCAST = 400_000
#: Bits of the bitmap of documents with a hit.
BITS = 1 << 25


def words(text: Column) -> Column:
    """Array of words; a text without any gives one empty string."""
    return F.split(F.btrim(F.lower(text), F.lit(" \t\n\x0b\x0c\r")), "[ \t-\r]+")


def masks(lengths: list[int]) -> list[tuple[str, int, int]]:
    """The masks that items of these numbers of words need, each with the least and the greatest number it is for."""
    out = []
    if any(n >= SPAN for n in lengths):
        out += [(m, SPAN, 2**31 - 1) for m in MASKS]
    if any(SPAN <= n < LONG for n in lengths):
        out += [(m, SPAN, LONG - 1) for m in SHORT_MASKS]
    for n in sorted({n for n in lengths if n < SPAN}):
        free = n - 1 >= SHARE * n
        out += [("1" * k + "0" + "1" * (n - k - 1), n, n) for k in range(n)] if free else [("1" * n, n, n)]
    return out


def _seeds(rows: DataFrame, under: list[tuple[str, int, int]], item: bool) -> DataFrame:
    """rows with `words` and `n`: one row for each window and mask, with its position `at` and its hash `seed`."""

    def seed(no: int, mask: str, lo: int, hi: int) -> Column:
        own = F.xxhash64(F.lit(no), *[F.get(F.col("words"), F.col("at") + k) for k, c in enumerate(mask) if c == "1"])
        return F.when((F.col("at") + len(mask) <= F.col("n")) & (F.col("n").between(lo, hi) if item else F.lit(True)), own)

    if not under:
        return rows.withColumn("at", F.lit(0)).withColumn("seed", F.lit(0).cast("long")).where("false")
    out = rows.withColumn("at", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    return out.withColumn("seed", F.explode(F.array(*[seed(no, *m) for no, m in enumerate(under)]))).where("seed is not null")


def matches(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """id (see common.order_id), version, item_id, matched (most words of the item in place in one alignment), item_words of each
    contamination of a text."""
    items = benchmark.where("item_id is not null and text is not null").select("item_id", words(F.col("text")).alias("words")).distinct()
    items = items.withColumn("n", F.size("words")).where("n > 1 or words[0] <> ''")
    under = masks([r.n for r in items.select(F.least("n", F.lit(LONG)).alias("n")).distinct().collect()])  # LONG numbers at most
    seeds = _seeds(items, under, True).select("seed", "item_id", F.col("at").alias("item_at"), F.col("n").alias("item_n")).distinct()
    small = seeds.limit(MAX_BROADCAST + 1).count() <= MAX_BROADCAST
    own = docs.select(common.order_id("doc_id").alias("id"), F.xxhash64("text").alias("version"), words(F.col("text")).alias("words")).withColumn("n", F.size("words")).where("n > 0")
    shift = F.col("at") - F.col("item_at")
    start = F.greatest(F.col("shift"), F.lit(0))
    region = F.slice("words", start + 1, F.greatest(F.least(F.col("shift") + F.col("item_n"), F.col("n")) - start, F.lit(0)))
    of_item = items.select("item_id", F.col("words").alias("item"))
    by = ["id", "version", "item_id", "shift"]
    if small:
        hits = _seeds(own, under, False).join(F.broadcast(seeds), "seed").withColumn("shift", shift)
        # The words beside the item go along as a key, so that the many hits of one alignment become one before the shuffle.
        hits = hits.select(*by, region.alias("region")).groupBy(*by, "region").agg(F.count("*").alias("hits")).join(F.broadcast(of_item), "item_id")
    else:
        hits = _seeds(own, under, False).select("id", "version", "at", "seed").join(seeds, "seed").withColumn("shift", shift)
        hits = hits.groupBy(*by, "item_n").agg(F.count("*").alias("hits"))
        near = common.sieve(own, hits.select("id", "version"), ["id", "version"], BITS).dropDuplicates(["id", "version"])
        hits = hits.join(near, ["id", "version"]).select(*by, region.alias("region"), "hits").join(of_item, "item_id")
    skipped = F.greatest(-F.col("shift"), F.lit(0))
    same = F.transform("item", lambda w, j: F.coalesce(F.get("region", j - skipped) == w, F.lit(False)))
    run = F.aggregate(
        same,
        F.struct(F.lit(0).alias("now"), F.lit(0).alias("best"), F.lit(0).alias("all")),
        lambda a, s: F.struct(
            F.greatest(F.lit(0), a["now"] + F.when(s, 1).otherwise(-2)).alias("now"),
            F.greatest(a["best"], a["now"] + F.when(s, 1).otherwise(-2)).alias("best"),
            (a["all"] + s.cast("int")).alias("all"),
        ),
    )
    hits = hits.select("id", "version", "item_id", F.size("item").alias("item_words"), F.when(F.col("hits") > 0, run).alias("run"))
    hits = hits.where((F.col("run.all") >= SHARE * F.col("item_words")) | (F.col("run.best") >= RUN))
    return hits.groupBy("id", "version", "item_id").agg(F.max("run.all").cast("long").alias("matched"), F.max("item_words").cast("long").alias("item_words"))


def report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """For each document: doc_id, contaminated, items (ids of the items found, in order)."""
    found = matches(docs, benchmark).groupBy("id", "version").agg(F.array_sort(F.collect_set("item_id")).alias("items"))
    out = docs.select("doc_id", common.order_id("doc_id").alias("id"), F.xxhash64("text").alias("version")).join(found, ["id", "version"], "left")
    return out.select("doc_id", F.col("items").isNotNull().alias("contaminated"), F.concat_ws(",", "items").alias("items"))


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without the contaminated ones."""
    id_, version = common.fresh(docs, "id", "version")
    found = matches(docs, benchmark).select(F.col("id").alias(id_), F.col("version").alias(version)).distinct()
    keyed = docs.withColumns({id_: common.order_id("doc_id"), version: F.xxhash64("text")})
    return keyed.join(found, [id_, version], "left_anti").select(*docs.columns)


def oracle() -> str:
    """The same in SQL: whole alignments are compared, at every shift where a seed's words agree."""
    one = lambda mask, cond: "(" + " AND ".join([cond, *(f"d.words[d.at + {k}] = b.words[b.at + {k}]" for k, c in enumerate(mask) if c == "1")]) + ")"
    on = " OR ".join([*(one(m, "true") for m in MASKS), *(one(m, f"len(b.words) < {LONG}") for m in SHORT_MASKS)])
    return f"""
WITH w AS (SELECT doc_id AS id, list_filter(regexp_split_to_array(lower(text), '[ \\t-\\r]+'), lambda x: x <> '') AS words FROM documents),
v AS (SELECT item_id AS id, list_filter(regexp_split_to_array(lower(text), '[ \\t-\\r]+'), lambda x: x <> '') AS words FROM benchmark),
d AS (SELECT id, words, unnest(range(1, len(words) + 1)) AS at FROM w),
b AS (SELECT id, words, unnest(range(1, len(words) + 1)) AS at FROM v WHERE len(words) >= {SPAN}),
s AS (SELECT DISTINCT d.id AS doc_id, b.id AS item_id, d.at - b.at AS shift FROM d JOIN b ON d.words[d.at] = b.words[b.at] AND ({on})
  UNION SELECT d.id, v.id, d.at - 1 FROM d JOIN v ON len(v.words) BETWEEN 1 AND {SPAN - 1} AND d.at + len(v.words) - 1 <= len(d.words)),
m AS (SELECT doc_id, item_id, shift, len(v.words) AS n, list_transform(range(1, len(v.words) + 1), lambda j: (j + shift BETWEEN 1 AND len(w.words)) AND w.words[j + shift] = v.words[j]) AS same FROM s JOIN w ON w.id = doc_id JOIN v ON v.id = item_id),
p AS (SELECT doc_id, item_id, shift, n, unnest(same) AS same, generate_subscripts(same, 1) AS j FROM m),
c AS (SELECT *, sum(CASE WHEN same THEN 1 ELSE -2 END) OVER (PARTITION BY doc_id, item_id, shift ORDER BY j) AS t FROM p),
r AS (SELECT doc_id, item_id, n, t - least(0, min(t) OVER (PARTITION BY doc_id, item_id, shift ORDER BY j)) AS run, count(*) FILTER (WHERE same) OVER (PARTITION BY doc_id, item_id, shift) AS n_same FROM c),
f AS (SELECT DISTINCT doc_id, item_id FROM r WHERE n_same >= {SHARE} * n OR run >= {RUN}),
g AS (SELECT doc_id, string_agg(item_id::VARCHAR, ',' ORDER BY item_id) AS items FROM f GROUP BY doc_id)
SELECT doc_id, g.items IS NOT NULL AS contaminated, coalesce(g.items, '') AS items FROM documents LEFT JOIN g USING (doc_id)
"""
