"""Passages that several tablets share, and pairs of places: rates of change, pair features, evidence of strata.

forms: passage, tablet, ord, form (array), a row an attestation. canonical: passage, canonical (array).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqloom.functions.stats import cosine, double, entropy_of
from seqloom.operators import alignment as al
from seqloom.operators import ngrams as ng
from seqloom.operators.profiles import place


def slots(canonical: DataFrame) -> DataFrame:
    return canonical.select("passage", F.posexplode("canonical").alias("at", "tok"))


def mismatch_rates(forms: DataFrame, canonical: DataFrame) -> DataFrame:
    """Per token: attestations that reach a canonical place of it, how many have another token there, and the share. Cells are counted by
    passage and place first, so a passage of many attestations is a count a token, whatever its size."""
    cells = forms.select("passage", F.posexplode("form").alias("at", "own")).groupBy("passage", "at", "own").agg(F.count("*").alias("f"))
    own = slots(canonical).join(cells, ["passage", "at"]).groupBy("tok").agg(F.sum("f").alias("covered"), F.sum(F.when(F.col("own") != F.col("tok"), F.col("f")).otherwise(0)).alias("other"))
    return own.select("tok", "covered", "other", (double("other") / F.col("covered")).alias("rate"))


def absence_rates(forms: DataFrame, canonical: DataFrame) -> DataFrame:
    """Per token: passages whose canonical form has it, their attestations without it, and the one over the other, which may exceed 1;
    `thin` under five passages."""
    with_ = canonical.select("passage", F.explode(F.array_distinct("canonical")).alias("tok"))
    size = forms.groupBy("passage").agg(F.count("*").alias("all"))
    held = forms.select("passage", F.explode(F.array_distinct("form")).alias("tok")).groupBy("passage", "tok").agg(F.count("*").alias("held"))
    own = with_.join(size, "passage", "left").join(held, ["passage", "tok"], "left")
    absent = F.coalesce("all", F.lit(0)) - F.coalesce("held", F.lit(0))
    out = own.groupBy("tok").agg(F.count("*").alias("passages"), F.sum(absent).alias("absent"))
    return out.select("tok", "passages", "absent", (double("absent") / F.col("passages")).alias("rate"), (F.col("passages") < 5).alias("thin"))


def place_spread(tokens: DataFrame) -> DataFrame:
    """Per token: tablets, and the population deviation and mean of its mean relative places in them; null under two tablets."""
    own = tokens.withColumn("rel", place("tablet")).groupBy("tok", "tablet").agg(F.avg("rel").alias("m"))
    enough = F.count("*") > 1
    return own.groupBy("tok").agg(F.count("*").alias("tablets"), F.when(enough, F.stddev_pop("m")).alias("sigma"), F.when(enough, F.avg("m")).alias("mean_place"))


def thirds_entropy(tokens: DataFrame) -> DataFrame:
    """tok, h: entropy over the thirds of tablets, cut at 0.33 and 0.67 of pos / n, over that of equal shares."""
    w = Window.partitionBy("tablet")
    at = double(F.row_number().over(w.orderBy("pos")) - 1) / F.count("*").over(w)
    third = F.when(F.col("at") < 0.33, 0).when(F.col("at") < 0.67, 1).otherwise(2)
    return tokens.withColumn("at", at).groupBy("tok", third.alias("third")).agg(F.count("*").alias("f")).groupBy("tok").agg(entropy_of(F.col("f"), 3.0).alias("h"))


def relative_pmi(tokens: DataFrame) -> DataFrame:
    """src, dst, mi: pointwise information of bigrams in bits, at least 0, over the largest (0 if none is above 0)."""
    c, uni = ng.bigrams(tokens), tokens.groupBy("tok").agg(F.count("*").alias("u"))
    n = c.agg(F.sum("f").alias("nb")).crossJoin(uni.agg(F.sum("u").alias("nu")))
    own = c.join(uni, "tok").join(uni.select(F.col("tok").alias("nxt"), F.col("u").alias("v")), "nxt").crossJoin(F.broadcast(n))
    mi = F.log2(double("f") / F.col("nb") / (double("u") / F.col("nu") * (double("v") / F.col("nu")) + 1e-12) + 1e-12)
    own = own.select(F.col("tok").alias("src"), F.col("nxt").alias("dst"), F.greatest(F.lit(0.0), mi).alias("mi"))
    return own.crossJoin(F.broadcast(own.agg(F.max("mi").alias("top")))).select("src", "dst", F.coalesce(F.try_divide("mi", "top"), F.lit(0.0)).alias("mi"))


def token_stats(tokens: DataFrame, forms: DataFrame, canonical: DataFrame) -> DataFrame:
    """tok, p, ic (p squared over the largest), place_h, rate of mismatch (0 where the token is in no canonical form)."""
    c = tokens.groupBy("tok").agg(F.count("*").alias("f"))
    own = c.crossJoin(F.broadcast(c.agg(F.sum("f").alias("n"), F.max("f").alias("top")))).join(thirds_entropy(tokens), "tok")
    own = own.join(mismatch_rates(forms, canonical).select("tok", "rate"), "tok", "left")
    return own.select("tok", (double("f") / F.col("n")).alias("p"), F.pow(double("f") / F.col("top"), F.lit(2)).alias("ic"), F.col("h").alias("place_h"), F.coalesce("rate", F.lit(0.0)).alias("rate"))


def shared_places(forms: DataFrame, canonical: DataFrame, most: int = 100, most_tablets: int = 8) -> DataFrame:
    """Pairs of places at which two tablets have the canonical token of one place of a passage: passage, at, tok, tablet_a, pos_a, tablet_b,
    pos_b, in order of ord. forms also holds start, the place of the form in its tablet. Passages of more than `most` attestations or
    `most_tablets` tablets are no parallels, so a passage gives a bounded number of pairs."""
    size = forms.groupBy("passage").agg(F.count("*").alias("n"), F.count_distinct("tablet").alias("k")).where((F.col("n") <= most) & (F.col("k") <= most_tablets))
    cells = forms.join(size.select("passage"), "passage").select("passage", "tablet", "ord", "start", F.posexplode("form").alias("at", "tok"))
    own = cells.join(slots(canonical), ["passage", "at", "tok"])
    side = lambda s: own.select("passage", "at", "tok", F.col("tablet").alias(f"tablet_{s}"), (F.col("start") + F.col("at")).alias(f"pos_{s}"), F.col("ord").alias(f"ord_{s}"))
    both = side("a").join(side("b"), ["passage", "at", "tok"]).where("ord_a < ord_b and tablet_a <> tablet_b")
    return both.drop("ord_a", "ord_b")


def pair_features(pairs: DataFrame, tokens: DataFrame, stats: DataFrame, pmi: DataFrame, vectors: DataFrame | None = None) -> DataFrame:
    """Eight features in [0, 1] of pairs (tablet_a, pos_a, tok_a, tablet_b, pos_b, tok_b): differences of information, of place entropy and of
    mismatch, information with the tokens before and after a, ratio of rates, likeness of vectors (tok, vector; 0 without), and difference of
    relative places. Tokens without statistics count as rare, with a place entropy of 0.5."""
    w = ng.order()
    around = tokens.select("tablet", "pos", F.lag("tok").over(w).alias("left"), F.lead("tok").over(w).alias("right"))
    size = tokens.groupBy("tablet").agg(F.count("*").alias("n"))
    own = pairs.join(around.select(F.col("tablet").alias("tablet_a"), F.col("pos").alias("pos_a"), "left", "right"), ["tablet_a", "pos_a"], "left")
    for s in ("a", "b"):
        mine = stats.select(F.col("tok").alias(f"tok_{s}"), *[F.col(c).alias(f"{c}_{s}") for c in ("p", "ic", "place_h", "rate")])
        own = own.join(mine, f"tok_{s}", "left").join(size.select(F.col("tablet").alias(f"tablet_{s}"), F.col("n").alias(f"n_{s}")), f"tablet_{s}", "left")
        if vectors is not None:
            own = own.join(vectors.select(F.col("tok").alias(f"tok_{s}"), F.col("vector").alias(f"v_{s}")), f"tok_{s}", "left")
    own = own.join(pmi.select(F.col("src").alias("left"), F.col("dst").alias("tok_a"), F.col("mi").alias("mi_left")), ["left", "tok_a"], "left")
    own = own.join(pmi.select(F.col("src").alias("tok_a"), F.col("dst").alias("right"), F.col("mi").alias("mi_right")), ["tok_a", "right"], "left")

    def gap(c: str, none: float) -> Column:
        return F.abs(F.coalesce(f"{c}_a", F.lit(none)) - F.coalesce(f"{c}_b", F.lit(none)))

    rel = lambda s: double(f"pos_{s}") / F.greatest(F.coalesce(f"n_{s}", F.lit(0)) - 1, F.lit(1))
    p = [F.coalesce(f"p_{s}", F.lit(1e-10)) for s in ("a", "b")]
    alike = F.coalesce((cosine(F.col("v_a"), F.col("v_b")) + 1) / 2, F.lit(0.0)) if vectors is not None else F.lit(0.0)
    raw = {
        "ic_gap": gap("ic", 0.0), "place_gap": gap("place_h", 0.5), "rate_gap": gap("rate", 0.0), "mi_left": F.coalesce("mi_left", F.lit(0.0)), "mi_right": F.coalesce("mi_right", F.lit(0.0)),
        "ratio": F.least(*p) / F.greatest(*p), "alike": alike, "distance": F.abs(rel("a") - rel("b")),
    }
    return own.select("tablet_a", "pos_a", "tok_a", "tablet_b", "pos_b", "tok_b", *[F.greatest(F.lit(0.0), F.least(F.lit(1.0), e)).alias(c) for c, e in raw.items()])


def crossed_bigrams(tokens: DataFrame, early: DataFrame, late: DataFrame) -> DataFrame:
    """early, late, f: neighbours of which one is among the early tokens (tok) and the other among the late, in either order. A pair that is
    both ways round counts once, as it stands."""
    c = ng.bigrams(tokens)
    mark = lambda own, at, rows, name: own.join(rows.select(F.col("tok").alias(at)).distinct().withColumn(name, F.lit(True)), at, "left")
    for at, k in (("tok", 1), ("nxt", 2)):
        c = mark(mark(c, at, early, f"e{k}"), at, late, f"l{k}")
    straight, turned = F.col("e1") & F.col("l2"), F.col("l1") & F.col("e2")
    own = c.where(F.coalesce(straight, F.lit(False)) | F.coalesce(turned, F.lit(False)))
    first = F.coalesce(straight, F.lit(False))
    return own.groupBy(F.when(first, F.col("tok")).otherwise(F.col("nxt")).alias("early"), F.when(first, F.col("nxt")).otherwise(F.col("tok")).alias("late")).agg(F.sum("f").alias("f"))


def last_records(records: DataFrame, key: str, order: str) -> DataFrame:
    """The last record of each key."""
    rest = [c for c in records.columns if c != key]
    own = records.groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("r"))
    return own.select(key, *[F.col("r")[c].alias(c) for c in rest])


def corroborated(changes: DataFrame, leans: DataFrame) -> DataFrame:
    """changes (old, new, ...) with old_lean, new_lean from leans (tok, lean) and what they say: contradicts if the old token leans late or
    the new one early, else supports if one leans as it should, else neutral."""
    own = changes
    for c in ("old", "new"):
        own = own.join(leans.select(F.col("tok").alias(c), F.col("lean").alias(f"{c}_lean")), c, "left")
    is_ = lambda c, v: F.coalesce(F.col(c) == v, F.lit(False))
    says = F.when(is_("old_lean", "post") | is_("new_lean", "pre"), "contradicts").when(is_("old_lean", "pre") | is_("new_lean", "post"), "supports").otherwise("neutral")
    return own.select(*changes.columns, "old_lean", "new_lean", says.alias("evidence"))


def class_scores(found: DataFrame, reference: DataFrame) -> DataFrame:
    """Of classes (cls, members): how many of each are matched by one of the other with a Jaccard similarity over 0.5, and recall, precision
    and F1 of it; 0 without classes."""
    hit = lambda a, b: a.agg(F.count("*").alias("n")).crossJoin(al.best_overlap(a, b).agg(F.count_if(F.col("jaccard") > 0.5).alias("m")))
    own = hit(reference, found).toDF("n_reference", "matched").crossJoin(hit(found, reference).toDF("n_found", "matching"))
    share = lambda m, n: F.coalesce(F.try_divide(double(m), double(n)), F.lit(0.0))
    own = own.withColumns({"recall": share("matched", "n_reference"), "precision": share("matching", "n_found")})
    return own.withColumn("f1", F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), F.lit(0.0)))


def change_periods(changes: DataFrame, tablets: DataFrame) -> DataFrame:
    """Per passage: the period s, with a bit for each changed place (under 63), and whether f(x) = x | s has it over the vectors of its
    tablets. changes: passage, at; tablets: passage, tablet, stratum, late (places with direct evidence of the new token, or null without
    evidence). Early tablets are 0, late ones s; undated ones take their evidence, those without any and excluded ones are left out."""
    s = changes.select("passage", "at").distinct().groupBy("passage").agg(F.bit_or(bit_of(F.col("at"))).alias("s"))
    own = tablets.join(s, "passage")
    late = F.aggregate("late", F.lit(0).cast("long"), lambda x, at: x.bitwiseOR(bit_of(at)))
    x = F.when(F.col("stratum") == "pre", F.lit(0).cast("long")).when(F.col("stratum") == "post", F.col("s")).when(F.col("stratum") != "excluded", late)
    own = own.withColumn("x", x).where("x is not null")
    holds = F.col("x").bitwiseOR(F.col("s")) == F.col("x").bitwiseXOR(F.col("s")).bitwiseOR(F.col("s"))
    got = own.groupBy("passage").agg(F.count_if(F.col("x") == 0).alias("early"), F.count_if(F.col("x") == F.col("s")).alias("late"), F.bool_and(holds).alias("holds"))
    return s.join(got, "passage", "left").select("passage", "s", F.coalesce("early", F.lit(0)).alias("early"), F.coalesce("late", F.lit(0)).alias("late"), F.coalesce("holds", F.lit(True)).alias("holds"))


def bit_of(at: Column) -> Column:
    """The number with the bit `at` alone, as a long."""
    return F.pow(F.lit(2.0), at).cast("long")


def recurrent(codes: DataFrame, least: int = 3, tablets: int = 2) -> DataFrame:
    """Compounds (tablet, code): occurrences, tablets, and whether they recur, `least` times in `tablets` tablets or more."""
    own = codes.where(F.col("code").rlike(r"[:.\-();]")).groupBy("code", "tablet").agg(F.count("*").alias("f"))
    own = own.groupBy("code").agg(F.sum("f").alias("occurrences"), F.count("*").alias("tablets"))
    return own.withColumn("structural", (F.col("occurrences") >= least) & (F.col("tablets") >= tablets))
