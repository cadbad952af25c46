"""Profiles of token types: fingerprints and the roles they give, tests of candidates, and the two sides of a tablet.

Results have one row a type, at most, or one a tablet; what is broadcast is a row of totals.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqloom.functions.stats import double, entropy_of
from seqloom.operators import language_models as lm
from seqloom.operators import ngrams as ng

#: The least skew of a determinative, and the fewest occurrences that make a skew reliable.
LEAST_SKEW, RELIABLE = 1 / 3, 10


def place(*line: str) -> Column:
    """pos order in the line over n - 1, 0 in lines of one token."""
    w = Window.partitionBy(*line)
    return double(F.row_number().over(w.orderBy("pos")) - 1) / F.greatest(F.count("*").over(w) - 1, F.lit(1))


def place_entropy(tokens: DataFrame, *line: str, bins: int = 10, base: float | None = None) -> DataFrame:
    """tok, n, h: entropy of a token's bins of relative place in its lines; over that of `bins` equal shares, unless a base is given."""
    at = F.least(F.floor(F.col("rel") * bins), F.lit(bins - 1))
    c = tokens.withColumn("rel", place(*line)).groupBy("tok", at.alias("bin")).agg(F.count("*").alias("f"))
    return c.groupBy("tok").agg(F.sum("f").alias("n"), entropy_of(F.col("f"), base or float(bins)).alias("h"))


def fingerprint(tokens: DataFrame, line: list[str], least: int = 5, central: DataFrame | None = None) -> DataFrame:
    """Features of each type of `least` occurrences or more. tokens: tablet, pos, tok, the columns of `line`, and `boundary`, whether the
    place is the edge of a passage. central: tok, betweenness, pagerank; types that it lacks have 0 of both."""
    freq = tokens.groupBy("tok").agg(F.count("*").alias("frequency"), F.count_if("boundary").alias("edges"))
    total = freq.agg(F.sum("frequency").alias("n"), F.count("*").alias("types"))
    c = ng.bigrams(tokens)
    after = c.groupBy("tok").agg(F.count("*").alias("succ"))
    before = c.groupBy(F.col("nxt").alias("tok")).agg(F.count("*").alias("pred"), entropy_of(F.col("f")).alias("h_pred"))
    near = c.select("tok", F.col("nxt").alias("x")).union(c.select(F.col("nxt"), F.col("tok"))).distinct().groupBy("tok").agg(F.count("*").alias("near"))
    own = freq.where(F.col("frequency") >= least).crossJoin(F.broadcast(total))
    for part in (near, after, before, place_entropy(tokens, *line).select("tok", F.col("h").alias("positional_entropy"))):
        own = own.join(part, "tok", "left")
    own = own.join(central.select("tok", "betweenness", "pagerank"), "tok", "left") if central is not None else own.withColumns({"betweenness": F.lit(0.0), "pagerank": F.lit(0.0)})
    none = F.lit(0)
    succ, pred = double(F.coalesce("succ", none)), double(F.coalesce("pred", none))
    bound = 1 - F.col("h_pred") / F.log2(F.greatest("types", F.lit(2)))
    return own.select(
        "tok",
        "frequency",
        F.coalesce("betweenness", F.lit(0.0)).alias("betweenness"),
        F.coalesce("pagerank", F.lit(0.0)).alias("pagerank"),
        "positional_entropy",
        (double(F.coalesce("near", none)) / F.col("frequency")).alias("neighbor_diversity"),
        (double("frequency") / F.col("n")).alias("own_frequency"),
        F.coalesce(F.greatest(F.lit(0.0), F.least(F.lit(1.0), bound)), F.lit(0.0)).alias("slot_predictability"),
        (double("edges") / F.col("frequency")).alias("passage_anchor_score"),
        F.coalesce(F.try_divide(succ - pred, succ + pred), F.lit(0.0)).alias("direction_skew"),
    )


def thresholds(features: DataFrame, reliable: int = RELIABLE) -> DataFrame:
    """One row of cuts. Percentiles are exact, over one row a type."""
    skew = F.percentile(F.when(F.col("frequency") >= reliable, F.abs("direction_skew")), 0.9)
    mid = [F.coalesce(F.percentile(c, 0.5), F.lit(0.0)).alias(f"median_{c}") for c in ("neighbor_diversity", "positional_entropy", "slot_predictability")]
    high = F.coalesce(F.percentile("own_frequency", 0.75), F.lit(0.0)).alias("freq_hi")
    return features.agg(F.coalesce(F.avg("betweenness"), F.lit(0.0)).alias("mean_betweenness"), *mid, high, F.greatest(F.coalesce(skew, F.lit(LEAST_SKEW)), F.lit(LEAST_SKEW)).alias("dirskew_hi"))


def assigned(features: DataFrame, anchor: float = 0.5, reliable: int = RELIABLE) -> DataFrame:
    """tok, role, subtype, rule: strong skew makes a determinative, a frequent type in predictable slots a particle, a free one a
    logogram, the rest is phonetic. Edges of passages override the subtype."""
    own = features.crossJoin(F.broadcast(thresholds(features, reliable)))
    skewed = (F.abs("direction_skew") >= F.col("dirskew_hi")) & (F.col("frequency") >= reliable)
    bound = F.col("slot_predictability") > F.col("median_slot_predictability")
    particle = (F.col("own_frequency") >= F.col("freq_hi")) & bound & (F.col("positional_entropy") < F.col("median_positional_entropy"))
    free = (F.col("positional_entropy") > F.col("median_positional_entropy")) & (F.col("slot_predictability") < F.col("median_slot_predictability"))
    pick = lambda a, b, c, d: F.when(skewed, a).when(particle, b).when(free, c).otherwise(d)
    side = F.when(F.col("direction_skew") > 0, "determinative:proclitic").otherwise("determinative:postclitic")
    edge = F.col("passage_anchor_score") >= anchor
    rule = pick(side, F.lit("particle"), F.lit("logogram"), F.lit("default"))
    return own.select(
        "tok",
        pick(F.lit("taxogram"), F.lit("taxogram"), F.lit("logogram"), F.lit("phonetic")).alias("role"),
        F.when(edge, "anchor").otherwise(pick(F.lit("determinative"), F.lit("particle"), F.lit(None), F.lit(None))).alias("subtype"),
        F.when(edge, F.concat(rule, F.lit("+anchor"))).otherwise(rule).alias("rule"),
    )


def role_stability(one: DataFrame, two: DataFrame) -> DataFrame:
    """Of types with a role in both: how many keep it, their share (null without any), and those that change it, in order."""
    own = one.select("tok", F.col("role").alias("a")).join(two.select("tok", F.col("role").alias("b")), "tok")
    same = F.col("a") == F.col("b")
    return own.agg(F.count("*").alias("shared"), F.count_if(same).alias("stable"), F.avg(same.cast("double")).alias("stability"), F.array_sort(F.collect_list(F.when(~same, F.col("tok")))).alias("changed"))


def anchored_entropy(tokens: DataFrame, bins: int = 10, least: int = 5) -> DataFrame:
    """tok, score: how far the entropy of place in tablets lies below the mean of all types of `least` occurrences, in population
    deviations, through the logistic function. Rarer types have no score."""
    own = place_entropy(tokens, "tablet", bins=bins, base=2.0)
    seen = F.when(F.col("n") >= least, F.col("h"))
    base = own.agg(F.avg(seen).alias("m"), F.count(seen).alias("k"), F.stddev_pop(seen).alias("s"))
    z = (F.col("m") - seen) / F.greatest(F.when(F.col("k") > 1, F.col("s")).otherwise(1.0), F.lit(1e-9))
    return own.crossJoin(F.broadcast(base)).select("tok", (1 / (1 + F.exp(-z))).alias("score"))


def section_share(tokens: DataFrame, within: Column, section: Column) -> DataFrame:
    """tok, score: of its occurrences in one tablet, the share in a section of it; 0 for types that the tablet lacks, null for all
    without the tablet."""
    c = tokens.groupBy("tok").agg(F.count_if(within & section).alias("hits"), F.count_if(within).alias("n"))
    size = c.agg(F.sum("n").alias("size"))
    share = F.coalesce(F.try_divide(double("hits"), double("n")), F.lit(0.0))
    return c.crossJoin(F.broadcast(size)).select("tok", F.when(F.col("size") > 0, share).alias("score"))


def focus_share(tokens: DataFrame, focus: Column) -> DataFrame:
    """tok, focus_rate and other_rate a thousand, ratio of them (specificity), score: rate in the focus over that in all, from 1 (0) to 5
    (1); null without any focus."""
    c = tokens.groupBy("tok").agg(F.count_if(focus).alias("a"), F.count("*").alias("f"))
    size = c.agg(F.sum("a").alias("na"), F.sum("f").alias("nf"))
    own = c.crossJoin(F.broadcast(size))
    one = F.lit(1)
    inside = F.col("a") / F.greatest("na", one)
    outside = (F.col("f") - F.col("a")) / F.greatest(F.col("nf") - F.col("na"), one)
    score = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (inside / (F.col("f") / F.col("nf")) - 1) / 4))
    return own.select("tok", "f", (1000 * inside).alias("focus_rate"), (1000 * outside).alias("other_rate"), (1000 * inside / F.greatest(1000 * outside, F.lit(0.001))).alias("specificity"), F.when(F.col("na") > 0, score).alias("score"))


def tabulated(tokens: DataFrame, table: DataFrame) -> DataFrame:
    """tok, score: 0.8, 0.5 or 0.2 by the confidence (high, medium, low) that a table gives, 0.3 for another, 0 outside the table."""
    own = tokens.select("tok").distinct().join(table.select("tok", "confidence").withColumn("listed", F.lit(True)), "tok", "left")
    level = F.when(F.col("confidence") == "high", 0.8).when(F.col("confidence") == "medium", 0.5).when(F.col("confidence") == "low", 0.2).otherwise(0.3)
    return own.select("tok", F.when(F.col("listed"), level).otherwise(0.0).alias("score"))


def combined(tests: dict[str, DataFrame], least: int = 2) -> DataFrame:
    """tok, flags (scores over 0.5), overall (mean of those that aren't null) of types with `least` flags; each test is (tok, score)."""
    rows = None
    for own in tests.values():
        rows = own.select("tok", "score") if rows is None else rows.unionByName(own.select("tok", "score"))
    if rows is None:
        raise ValueError("candidates need a test")
    own = rows.groupBy("tok").agg(F.count_if(F.col("score") > 0.5).alias("flags"), F.coalesce(F.avg("score"), F.lit(0.0)).alias("overall"))
    return own.where(F.col("flags") >= least)


def edge_share(tokens: DataFrame, *line: str, share: float = 0.15) -> DataFrame:
    """tok, n, edge_fraction: occurrences in the first max(1, int(share n)) or the last int(share n) places of a line."""
    w = Window.partitionBy(*line)
    at, n = F.row_number().over(w.orderBy("pos")) - 1, F.count("*").over(w)
    cut = F.floor(n * F.lit(share))
    edge = (at < F.greatest(F.lit(1), cut)) | (at >= n - cut)
    return tokens.withColumn("edge", edge).groupBy("tok").agg(F.count("*").alias("n"), (double(F.count_if("edge")) / F.count("*")).alias("edge_fraction"))


def logograms(tokens: DataFrame, focus: Column, line: list[str], marks: list[str], passages: DataFrame, window: int = 8, least: int = 3) -> DataFrame:
    """Confidence that a type is a logogram: specificity of the focus (0.3), a place in a key passage (0.3), edges of lines (0.2), company
    of the marks (0.2, the larger rate). passages: canonical (array), key."""
    own = focus_share(tokens, focus).where(F.col("f") >= least).select("tok", F.col("f").alias("n"), F.round("specificity", 3).alias("specificity"))
    edges = edge_share(tokens, *line).select("tok", F.round("edge_fraction", 4).alias("edge_fraction"))
    key = passages.where("key").select(F.explode("canonical").alias("tok")).distinct().withColumn("in_key", F.lit(True))
    own = own.join(edges, "tok").join(key, "tok", "left").withColumn("in_key", F.coalesce("in_key", F.lit(False)))
    for k, mark in enumerate(marks):
        own = own.join(ng.cooccurrence(tokens, mark, window).select("tok", F.col("rate").alias(f"company{k}")), "tok", "left")
    near = F.greatest(F.lit(0.0), *[F.coalesce(f"company{k}", F.lit(0.0)) for k in range(len(marks))], F.lit(0.0))
    score = 0.3 * F.least(F.col("specificity") / 5, F.lit(1.0)) + 0.3 * F.col("in_key").cast("double") + 0.2 * F.col("edge_fraction") + 0.2 * near
    own = own.withColumn("confidence", F.round(score, 4))
    verdict = F.when(F.col("confidence") >= 0.55, "strong").when(F.col("confidence") >= 0.4, "moderate").otherwise("weak")
    return own.select("tok", "n", "specificity", "in_key", "edge_fraction", near.alias("company"), "confidence", verdict.alias("verdict"))


def sides_first(tokens: DataFrame, first: str) -> DataFrame:
    """The table with the places of side `first` before those of the others in each tablet; pos counts anew."""
    rank = F.row_number().over(Window.partitionBy("tablet").orderBy((F.col("side") != first).cast("int"), "side", "pos")) - 1
    return tokens.withColumn("pos", rank)


def pooled_perplexity() -> Column:
    """The perplexity of all tablets together, from (n, perplexity) of each."""
    return F.pow(F.lit(2.0), F.sum(F.col("n") * F.log2("perplexity")) / F.sum("n"))


def preferred() -> Column:
    """The order of less perplexity; ba if they are equal to nine digits."""
    return F.when(F.round("ppl_ab", 9) < F.round("ppl_ba", 9), "ab").otherwise("ba")


def side_order(tokens: DataFrame, order: int = 2, alpha: float = 0.5) -> DataFrame:
    """tablet, n, ppl_ab, ppl_ba, winner, margin: each tablet under a model of all others, by both orders of its sides."""
    ab = lm.leave_one_out(sides_first(tokens, "a"), order, alpha).withColumnRenamed("perplexity", "ppl_ab")
    ba = lm.leave_one_out(sides_first(tokens, "b"), order, alpha).select("tablet", F.col("perplexity").alias("ppl_ba"))
    own = ab.join(ba, "tablet")
    return own.select("tablet", "n", "ppl_ab", "ppl_ba", preferred().alias("winner"), F.abs(F.col("ppl_ab") - F.col("ppl_ba")).alias("margin"))


def side_votes(tokens: DataFrame, orders: tuple[int, ...] = (2, 3)) -> DataFrame:
    """n (order), ppl_ab, ppl_ba, prefers: the sides' order by pooled perplexity, a row an order of the model."""
    rows = None
    for n in orders:
        both = []
        for name, first in (("ppl_ab", "a"), ("ppl_ba", "b")):
            both.append(lm.leave_one_out(sides_first(tokens, first), n).agg(pooled_perplexity().alias(name)))
        own = both[0].crossJoin(F.broadcast(both[1])).select(F.lit(n).alias("n"), "ppl_ab", "ppl_ba", preferred().alias("prefers"))
        rows = own if rows is None else rows.unionByName(own)
    return rows


def crossings(tokens: DataFrame, first: str) -> DataFrame:
    """Two tokens where a tablet passes from one side to the other, as a table of tablets of two tokens."""
    own = sides_first(tokens, first)
    w = ng.order()
    own = own.withColumn("nxt", F.lead("tok").over(w)).withColumn("over", F.lead("side").over(w)).where(F.col("over") != F.col("side"))
    return own.select(F.struct("tablet", "pos").alias("tablet"), F.posexplode(F.array("tok", "nxt")).alias("pos", "tok"))


def crossing_order(tokens: DataFrame, least: int = 10) -> DataFrame:
    """n, ppl_ab, ppl_ba, prefers, strength over passages between sides alone; no row under `least` of them."""
    both = []
    for name, first in (("ab", "a"), ("ba", "b")):
        own = crossings(tokens, first)
        both.append(lm.leave_one_out(own).agg(F.count("*").alias(f"n_{name}"), pooled_perplexity().alias(f"ppl_{name}")))
    margin = F.abs(F.col("ppl_ab") - F.col("ppl_ba"))
    own = both[0].crossJoin(F.broadcast(both[1])).where(F.col("n_ab") >= least)
    strength = F.when(margin > 1, "strong").when(margin > 0.1, "moderate").otherwise("weak")
    return own.select(F.col("n_ab").alias("n"), "ppl_ab", "ppl_ba", preferred().alias("prefers"), strength.alias("strength"))


def side_information(tokens: DataFrame) -> DataFrame:
    """mi, h_a, h_b, nmi, tablets: information that the types of side a give on those of side b, over pairs of types within tablets that
    have both. Counts by tablet and type come first, so a tablet adds its types' pairs, not its tokens'."""
    c = tokens.groupBy("tablet", "side", "tok").agg(F.count("*").alias("f"))
    a = c.where("side = 'a'").select("tablet", F.col("tok").alias("x"), F.col("f").alias("fa"))
    b = c.where("side = 'b'").select("tablet", F.col("tok").alias("y"), F.col("f").alias("fb"))
    joint = a.join(b, "tablet").groupBy("x", "y").agg(F.sum(F.col("fa") * F.col("fb")).alias("f"))
    both = a.select("tablet").distinct().join(b.select("tablet").distinct(), "tablet")
    ca = a.join(both, "tablet", "left_semi").groupBy("x").agg(F.sum("fa").alias("ca"))
    cb = b.join(both, "tablet", "left_semi").groupBy("y").agg(F.sum("fb").alias("cb"))
    na, nb = ca.agg(F.sum("ca").alias("na"), entropy_of(F.col("ca")).alias("h_a")), cb.agg(F.sum("cb").alias("nb"), entropy_of(F.col("cb")).alias("h_b"))
    n = joint.agg(F.sum("f").alias("nf")).crossJoin(na).crossJoin(nb)
    own = joint.join(ca, "x").join(cb, "y").crossJoin(F.broadcast(n))
    p = double("f") / F.col("nf")
    own = own.groupBy("h_a", "h_b").agg(F.sum(p * F.log2(p / (double("ca") / F.col("na") * (double("cb") / F.col("nb"))))).alias("mi"))
    nmi = F.coalesce(F.try_divide(F.col("mi"), (F.col("h_a") + F.col("h_b")) / 2), F.lit(0.0))
    return own.crossJoin(F.broadcast(both.agg(F.count("*").alias("tablets")))).select("mi", "h_a", "h_b", nmi.alias("nmi"), "tablets")
