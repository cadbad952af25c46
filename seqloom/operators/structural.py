"""Periodicity, mirrors, parity spectra: structure tests over positions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from seqloom.functions.stats import double, entropy_of


def phase_coherence(tokens: DataFrame, periods: list[int], least: int = 3) -> DataFrame:
    """Per tablet and token: the largest |sum exp(2 pi i pos / period)| / m over the periods, first period among equals."""
    own = tokens.select("tablet", "tok", "pos", F.explode(F.array(*[F.lit(p) for p in periods])).alias("period"))
    angle = 2 * F.pi() * F.col("pos") / F.col("period")
    c = own.groupBy("tablet", "tok", "period").agg(F.count("*").alias("m"), F.sum(F.cos(angle)).alias("x"), F.sum(F.sin(angle)).alias("y")).where(F.col("m") >= least)
    c = c.withColumn("coherence", F.sqrt(F.col("x") ** 2 + F.col("y") ** 2) / F.col("m"))
    rank = F.row_number().over(Window.partitionBy("tablet", "tok").orderBy(F.desc(F.round("coherence", 8)), "period"))
    return c.withColumn("rank", rank).where("rank = 1").select("tablet", "tok", "m", "period", "coherence")


def slots(tokens: DataFrame) -> DataFrame:
    """Per tablet and token: distinct stretches between its places over all of them, CV of the gaps (population), entropy of the
    tokens that follow it."""
    w, t = Window.partitionBy("tablet").orderBy("pos"), Window.partitionBy("tablet", "tok").orderBy("pos")
    own = tokens.withColumn("nxt", F.lead("tok").over(w)).withColumn("to", F.lead("pos").over(t))
    seq = tokens.groupBy("tablet").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "tok"))), lambda x: x["tok"]).alias("seq"))
    gaps = own.where("to is not null").join(seq, "tablet").withColumn("slice", F.expr("slice(seq, cast(pos + 2 as int), cast(to - pos - 1 as int))"))
    d = gaps.groupBy("tablet", "tok").agg(F.count("*").alias("slots"), (double(F.count_distinct("slice")) / F.count("*")).alias("distinctness"), F.try_divide(F.stddev_pop(double(F.col("to") - F.col("pos"))), F.avg(F.col("to") - F.col("pos"))).alias("gap_cv"))
    heads = own.where("nxt is not null").groupBy("tablet", "tok", "nxt").agg(F.count("*").alias("f")).groupBy("tablet", "tok").agg(entropy_of(F.col("f")).alias("head_entropy"))
    return d.join(heads, ["tablet", "tok"])


def candidates(tokens: DataFrame, least: int, share: float) -> DataFrame:
    """tablet, tok, m of tokens that occur `least` times on a tablet or more and make up a share of its tokens."""
    c = tokens.groupBy("tablet", "tok").agg(F.count("*").alias("m"))
    n = c.groupBy("tablet").agg(F.sum("m").alias("n"))
    return c.join(n, "tablet").where((F.col("m") >= least) & (F.col("m") >= share * F.col("n"))).select("tablet", "tok", "m")


def section_coherence(tokens: DataFrame, periods: list[int], least: int, share: float, slots_least: int, distinct: float) -> DataFrame:
    """Per tablet the largest phase coherence of its candidates that have `slots_least` slots or more, a share of `distinct` of them
    different ones; tablets without one don't appear."""
    own = candidates(tokens, least, share).select("tablet", "tok")
    gated = slots(tokens).where((F.col("slots") >= slots_least) & (F.col("distinctness") >= distinct)).select("tablet", "tok")
    found = phase_coherence(tokens, periods, 1).join(own, ["tablet", "tok"], "left_semi").join(gated, ["tablet", "tok"], "left_semi")
    return found.groupBy("tablet").agg(F.max("coherence").alias("coherence"))


def _arms(tokens: list) -> list[tuple[int, int]]:
    """(l + r, arm) of every place and gap of the tokens with a matching pair around it, by Manacher's algorithm."""
    out, n = [], len(tokens)
    for gap in (0, 1):  # around a place, around the gap before it
        radius, lo, hi = [0] * n, 0, -1
        for i in range(n):
            k = 0 if i > hi else min(radius[lo + hi - i + gap], hi - i + 1)
            while i - k - gap >= 0 and i + k < n and tokens[i - k - gap] == tokens[i + k]:
                k += 1
            radius[i] = k
            if i + k - 1 > hi:
                lo, hi = i - k + 1 - gap, i + k - 1
            arm = k - 1 + gap
            if arm > 0:
                out.append((2 * i - gap, arm))
    return out


def _span(tokens: list, centre: int, arm: int, least: int, distinct: float, over: int) -> int:
    """The deepest part of an arm, from the centre on, of `least` tokens or more of which a share of `distinct` differ; 0 if none is
    deeper than `over`."""
    seen, best = set(), 0
    for s in range(1, arm + 1):
        seen.add(tokens[(centre + 1) // 2 - s if centre % 2 else centre // 2 - s])
        if s >= least and len(seen) >= distinct * s:
            best = s
    return best if best > over else 0


def mirror_span(tokens: DataFrame, least: int = 1, distinct: float = 0.0) -> DataFrame:
    """Per tablet: the longest arm for which tokens match symmetrically around a place or a gap, all nearer ones too, and how many
    centres have one. Arms count from `least` tokens on, up to where a share of `distinct` of their tokens still differ, which keeps
    runs of one token out. Arms have any length; a tablet's tokens are read in one task. Tablets without a match don't appear;
    a null token matches none."""

    @F.pandas_udf("struct<arm int, centres long>")
    def run(sequences: pd.Series) -> pd.DataFrame:
        rows = []
        for own in sequences:
            own = [object() if x is None else x for x in own]
            arms = _arms(own)
            best = 0
            for centre, arm in sorted(arms, key=lambda x: -x[1]):
                if arm <= best:
                    break
                best = max(best, _span(own, centre, arm, least, distinct, best))
            rows.append((best, len(arms)))
        return pd.DataFrame(rows, columns=["arm", "centres"])

    own = tokens.groupBy("tablet").agg(F.array_sort(F.collect_list(F.struct("pos", "tok"))).alias("s"))
    own = own.select("tablet", run(F.transform("s", lambda x: x["tok"])).alias("m"))
    return own.select("tablet", "m.arm", "m.centres").where("arm > 0")


def walsh(truth: DataFrame, bits: int) -> DataFrame:
    """W(s) = sum over x of (-1)^(f(x) + |x & s|) of a truth table (x, f); bits is small, both sides have 2^bits rows."""
    s = truth.sparkSession.range(1 << bits).select(F.col("id").alias("s"))
    sign = F.when((F.bit_count(F.col("x").bitwiseAND(F.col("s"))) + F.col("f")) % 2 == 0, 1).otherwise(-1)
    return truth.select(F.col("x").cast("long"), "f").join(F.broadcast(s), F.lit(True)).groupBy("s").agg(F.sum(sign).alias("w"))


def agreement(spectrum: DataFrame, bits: int) -> DataFrame:
    """Of each slope, the share of points where the best affine function with it agrees."""
    return spectrum.select("s", "w", ((F.abs("w") + (1 << bits)) / F.lit(2.0 * (1 << bits))).alias("agreement"))


def affine_share(truth: DataFrame) -> DataFrame:
    """Share of pairs with f(x) ^ f(y) = f(x ^ y), and with f(0) added; a fixed, small domain."""
    t = truth.select(F.col("x").cast("long"), F.col("f").cast("int"))
    a, b, c = (t.select(F.col("x").alias(n), F.col("f").alias(f"f{n}")) for n in "xyz")
    both = a.join(F.broadcast(b), F.lit(True)).withColumn("z", F.col("x").bitwiseXOR(F.col("y"))).join(F.broadcast(c), "z")
    zero = t.where("x = 0").select(F.col("f").alias("f0"))
    both = both.join(F.broadcast(zero), F.lit(True)).withColumn("v", F.col("fx").bitwiseXOR(F.col("fy")).bitwiseXOR(F.col("fz")))
    return both.agg(F.avg((F.col("v") == 0).cast("double")).alias("linear"), F.avg((F.col("v") == F.col("f0")).cast("double")).alias("affine"))


def hidden_period(measured: DataFrame, bits: int) -> DataFrame:
    """The smallest s > 0 with |y & s| even for all measured y, per group; candidates are the 2^bits numbers."""
    s = measured.sparkSession.range(1, 1 << bits).select(F.col("id").alias("s"))
    ok = measured.join(F.broadcast(s), F.lit(True)).groupBy("grp", "s").agg(F.bool_and(F.bit_count(F.col("y").cast("long").bitwiseAND(F.col("s"))) % 2 == 0).alias("ok"))
    return ok.where("ok").groupBy("grp").agg(F.min("s").alias("period"))


def assignment_weights(spark: SparkSession, priors: list[float]) -> DataFrame:
    """All 2^n assignments of n undated tablets with the product of their priors, normalised (n is a small parameter)."""
    p = F.lit(1.0)
    for k, x in enumerate(priors):
        p = p * F.when(F.shiftright("id", k).bitwiseAND(F.lit(1)) == 1, x).otherwise(1 - x)
    own = spark.range(1 << len(priors)).withColumn("p", p)
    return own.crossJoin(F.broadcast(own.agg(F.sum("p").alias("all")))).select(F.col("id").alias("assignment"), (F.col("p") / F.col("all")).alias("weight"))


def best_affine(spectrum: DataFrame, bits: int) -> DataFrame:
    """s, w, constant, agreement: the slope of the largest |w|, the smallest of equal ones, with 1 added where w is negative."""
    top = spectrum.agg(F.min_by(F.struct("s", "w"), F.struct(-F.abs("w"), "s")).alias("b")).select("b.s", "b.w")
    return agreement(top, bits).select("s", "w", (F.col("w") < 0).cast("int").alias("constant"), "agreement")
