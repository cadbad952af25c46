"""Edit distance, alignment, substitution mining and similarity joins over token sequences."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqloom.functions.stats import double
from seqloom.operators.graph import components  # noqa: F401 part of this module's interface too

ALPHABET = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"


def lettered(tokens: DataFrame) -> DataFrame:
    """tablet, word: each tablet's tokens as one character each, for the built-in edit distance. ASCII for up to 62 types;
    beyond that, characters from U+10000 on (a million types, checked)."""
    code = tokens.select("tok").distinct().withColumn("k", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("tok")))
    ascii_ = F.substring(F.lit(ALPHABET), F.col("k"), F.lit(1))
    wide = F.when(F.col("k") < 0x100000, F.decode(F.unhex(F.lpad(F.hex(F.col("k") + 0xFFFF), 8, "0")), "UTF-32")).otherwise(F.raise_error(F.lit("too many types of tokens for one character each")))
    code = code.withColumn("c", F.when(F.max("k").over(Window.partitionBy(F.lit(0))) <= len(ALPHABET), ascii_).otherwise(wide))
    own = tokens.join(F.broadcast(code), "tok").groupBy("tablet").agg(F.array_sort(F.collect_list(F.struct("pos", "c"))).alias("s"))
    return own.select("tablet", F.array_join(F.transform("s", lambda x: x["c"]), "").alias("word"))


def similar(words: DataFrame, most: int = 1) -> DataFrame:
    """Pairs (a, b) of rows within `most` edits: words of equal or near length that share one of most + 1 pieces, at most
    `most` places apart. The pieces make an equality join; no pair without a common piece is formed."""
    n, k = F.length("word"), most + 1
    cut = lambda i: F.floor(n * i / k).cast("int")
    pieces = words.select("tablet", "word", F.explode(F.array(*[F.struct(cut(i).alias("at"), (cut(i + 1) - cut(i)).alias("len"), F.substring(F.col("word"), cut(i) + 1, cut(i + 1) - cut(i)).alias("piece"), n.alias("n")) for i in range(k)])).alias("p"))
    left = pieces.select(F.col("tablet").alias("a"), F.col("word").alias("x"), "p.at", "p.piece", F.explode(F.sequence(F.greatest(F.lit(0), F.col("p.n") - most), F.col("p.n") + most)).alias("m"))
    left = left.select("a", "x", "piece", "m", F.explode(F.sequence(F.greatest(F.lit(0), F.col("at") - most), F.col("at") + most)).alias("at"))
    lengths = words.select(F.length("word").alias("n")).distinct()
    shapes = lengths.select("n", F.explode(F.sequence(F.greatest(F.lit(0), F.col("n") - most), F.col("n") + most)).alias("of"))
    widths = shapes.select("n", F.explode(F.array_distinct(F.array(*[(F.floor(F.col("of") * (i + 1) / k) - F.floor(F.col("of") * i / k)).cast("int") for i in range(k)]))).alias("width")).distinct()
    right = words.withColumn("n", n).join(F.broadcast(widths), "n").where(F.col("width") <= F.col("n"))
    right = right.select(F.col("tablet").alias("b"), F.col("word").alias("y"), F.col("n").alias("m"), "width", F.explode(F.sequence(F.lit(0), F.col("n") - F.col("width"))).alias("at"))
    right = right.withColumn("piece", F.substring(F.col("y"), F.col("at") + 1, F.col("width")))
    both = left.join(right, ["m", "at", "piece"]).where("a < b").select("a", "b", "x", "y").distinct()
    return both.withColumn("distance", F.levenshtein("x", "y")).where(F.col("distance") <= most).select("a", "b", "distance")


def equal_groups(rows: DataFrame, key: str, least: int = 2) -> DataFrame:
    """Values of the key on at least `least` tablets."""
    return rows.groupBy(key).agg(F.count("*").alias("n"), F.count_distinct("tablet").alias("tablets")).where(F.col("tablets") >= least)


def substitutions(forms: DataFrame) -> DataFrame:
    """From (passage, tablet, form array): pairs of tokens that alone differ between two forms of a passage, trimmed to the
    shorter. A form with one place left out is the key of an equality join."""
    n = F.size("form")
    own = forms.select("passage", "tablet", "form", F.explode(F.sequence(F.lit(1), n)).alias("at"))
    own = own.withColumn("rest", F.concat(F.slice("form", 1, F.col("at") - 1), F.slice("form", F.col("at") + 1, n))).withColumn("tok", F.element_at("form", F.col("at")))
    one = own.select("passage", "rest", "at", "tok").distinct()  # however many tablets share it
    a, b = one.select("passage", "rest", "at", F.col("tok").alias("a")), one.select("passage", "rest", "at", F.col("tok").alias("b"))
    both = a.join(b, ["passage", "rest", "at"]).where("a < b")
    return both.groupBy("a", "b").agg(F.count_distinct("passage").alias("passages"), F.count_distinct(F.struct("passage", "rest", "at")).alias("slots"))


def consensus(forms: DataFrame) -> DataFrame:
    """From (passage, stratum, ord, form): the most frequent token of each place, the first seen among equals."""
    cells = forms.select("passage", "stratum", "ord", F.posexplode("form").alias("at", "tok"))
    c = cells.groupBy("passage", "stratum", "at", "tok").agg(F.count("*").alias("n"), F.min("ord").alias("seen"))
    rank = F.row_number().over(Window.partitionBy("passage", "stratum", "at").orderBy(F.desc("n"), "seen", "tok"))
    return c.withColumn("rank", rank).where("rank = 1").select("passage", "stratum", "at", "tok", "n")


def changes(consensus: DataFrame, one: str, two: str) -> DataFrame:
    """Places where the consensus of two strata differs, up to the shorter one."""
    a = consensus.where(F.col("stratum") == one).select("passage", "at", F.col("tok").alias("old"))
    b = consensus.where(F.col("stratum") == two).select("passage", "at", F.col("tok").alias("new"))
    return a.join(b, ["passage", "at"]).where("old <> new")


def omission_rates(forms: DataFrame, canonical: DataFrame) -> DataFrame:
    """Per code: share of variants that end before a canonical place of it."""
    slots = canonical.select("passage", F.posexplode("canonical").alias("at", "tok"))
    own = slots.join(forms.select("passage", F.size("form").alias("n")), "passage")
    return own.groupBy("tok").agg(F.count("*").alias("variants"), F.count_if(F.col("n") <= F.col("at")).alias("omitted"), F.avg((F.col("n") <= F.col("at")).cast("double")).alias("rate"))


def best_overlap(found: DataFrame, reference: DataFrame) -> DataFrame:
    """Per found class (cls, members): the reference class of the largest Jaccard similarity, through shared members only."""
    f = found.select("cls", "members", F.explode("members").alias("m"))
    r = reference.select(F.col("cls").alias("ref"), F.col("members").alias("theirs"), F.explode("members").alias("m"))
    pairs = f.join(r, "m").select("cls", "members", "ref", "theirs").distinct()
    j = double(F.size(F.array_intersect("members", "theirs"))) / F.size(F.array_union("members", "theirs"))
    rank = F.row_number().over(Window.partitionBy("cls").orderBy(F.desc("jaccard"), "ref"))
    return pairs.withColumn("jaccard", j).withColumn("rank", rank).where("rank = 1").select("cls", "ref", "jaccard")


def needleman_wunsch(a: list, b: list) -> list[tuple]:
    """Global alignment, +1 for equal and -1 for unequal tokens and gaps; ties prefer a pair, then a gap in b."""
    rows = [[-j for j in range(len(b) + 1)]]
    for i, x in enumerate(a, 1):
        row = [-i]
        for j, y in enumerate(b, 1):
            row.append(max(rows[-1][j - 1] + (1 if x == y else -1), rows[-1][j] - 1, row[-1] - 1))
        rows.append(row)
    i, j, out = len(a), len(b), []
    while i or j:
        if i and j and rows[i][j] == rows[i - 1][j - 1] + (1 if a[i - 1] == b[j - 1] else -1):
            i, j = i - 1, j - 1
            out.append((a[i], b[j]))
        elif i and rows[i][j] == rows[i - 1][j] - 1:
            i -= 1
            out.append((a[i], None))
        else:
            j -= 1
            out.append((None, b[j]))
    return out[::-1]


def align(pairs: DataFrame) -> DataFrame:
    """rows with arrays x and y get `cells`, the aligned tokens: a Pandas UDF, as the table of scores is sequential."""

    @F.pandas_udf("array<struct<x string, y string>>")
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([[{"x": p, "y": q} for p, q in needleman_wunsch(list(a), list(b))] for a, b in zip(x, y, strict=True)])

    return pairs.withColumn("cells", run("x", "y"))


def interest(rows: DataFrame, kind: Column, length: Column, *by: str) -> DataFrame:
    """Weighted count of changes over the passage's length, times 5, at most 10."""
    w = F.when(kind == "substitution", 4.0).when(kind == "insertion", 2.0).when(kind == "deletion", 1.0).otherwise(0.5)
    return rows.groupBy(*by).agg(F.round(F.least(F.lit(10.0), 5 * F.sum(w) / F.max(length)), 3).alias("interest"))

