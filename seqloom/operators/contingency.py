"""Contrasts of two strata: likelihood ratios, odds, multiple testing, stability under reassignment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqloom.functions.stats import chi2_sf, double, g2, log_odds
from seqloom.operators.relational import running

SCENARIOS = ("all_late", "alternate", "first_fifth")


def contrast(tokens: DataFrame, one: str, two: str, *by: str, threshold: float = 3.841) -> DataFrame:
    """Per token: counts in both strata (0 where absent), G2, log odds, rates per 1000, and the stratum it leans to."""
    own = tokens.where(F.col("stratum").isin(one, two)).groupBy(*by, "tok").agg(F.count_if(F.col("stratum") == one).alias("f1"), F.count_if(F.col("stratum") == two).alias("f2"))
    totals = own.groupBy(*by).agg(F.sum("f1").alias("n1"), F.sum("f2").alias("n2"))
    own = own.join(F.broadcast(totals), list(by)) if by else own.crossJoin(F.broadcast(totals))
    f1, f2, n1, n2 = (F.col(c) for c in ("f1", "f2", "n1", "n2"))
    own = own.withColumn("g2", g2(f1, f2, n1 - f1, n2 - f2)).withColumn("log_odds", log_odds(f1, n1, f2, n2))
    lean = F.when(F.col("g2") < threshold, "neutral").when(F.col("log_odds") > 0, one).otherwise(two)
    return own.select(*by, "tok", "f1", "f2", "g2", "log_odds", F.try_divide(1000 * double(f1), double(n1)).alias("rate1"), F.try_divide(1000 * double(f2), double(n2)).alias("rate2"), lean.alias("lean"))


def corrected(rows: DataFrame, tests_per_key: int = 2, alpha: float = 0.05) -> DataFrame:
    """p values of the g2 column, Bonferroni-corrected over tests_per_key tests a row."""
    n = rows.agg((F.count("*") * tests_per_key).alias("tests"))
    out = rows.withColumn("p", chi2_sf(F.col("g2"))).crossJoin(F.broadcast(n))
    out = out.withColumn("p_adj", F.least(F.lit(1.0), F.col("p") * F.col("tests")))
    return out.withColumn("significant", F.col("p_adj") < alpha)


def benjamini_hochberg(rows: DataFrame, q: float, *by: str, key: str = "tok") -> DataFrame:
    """rows with `rank` and `rejected`; rows without p take no part."""
    own = rows.where("p is not null and not isnan(p)")
    w = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    ranked = own.withColumn("rank", F.row_number().over(w.orderBy("p", key))).withColumn("m", F.count("*").over(w))
    ok = F.when(F.col("p") <= F.col("rank") * q / F.col("m"), F.col("rank"))
    return ranked.withColumn("last", F.max(ok).over(w)).withColumn("rejected", F.coalesce(F.col("rank") <= F.col("last"), F.lit(False))).drop("last")


def scenarios(tokens: DataFrame, unknown: Column) -> DataFrame:
    """The table under three reassignments of unknown tablets: all late; every second one early; the first fifth of their tokens early."""
    own = tokens.withColumn("unknown", unknown)
    order = own.where("unknown").groupBy("tablet").agg(F.count("*").alias("size")).withColumn("__one", F.lit(1))
    early = order.agg(F.greatest(F.lit(1), F.bround(0.2 * F.sum("size"))).alias("early"))
    before = running(order, "tablet", "size").select("tablet", "__one", "before")
    numbers = running(before.withColumnRenamed("before", "__before"), "tablet", "__one").select("tablet", (F.col("before") + 1).alias("__n"), F.col("__before").alias("before"))
    out = own.join(numbers, "tablet", "left").crossJoin(F.broadcast(early))
    rank = F.row_number().over(Window.partitionBy("tablet").orderBy("pos")) - 1
    out = out.withColumn("rank", F.col("before") + rank)
    pick = {
        "all_late": F.lit("post"),
        "alternate": F.when(F.col("__n") % 2 == 1, "pre").otherwise("post"),
        "first_fifth": F.when(F.col("rank") < F.col("early"), "pre").otherwise("post"),
    }
    return out.select(
        "tablet", "pos", "tok",
        F.explode(F.array(*[F.struct(F.lit(s).alias("scenario"), F.when(F.col("unknown"), pick[s]).otherwise(F.col("stratum")).alias("stratum")) for s in SCENARIOS])).alias("s"),
    ).select("tablet", "pos", "tok", "s.scenario", "s.stratum")


def scenario_summary(stats: DataFrame, value: str = "ic") -> DataFrame:
    """From (scenario, stratum, value): the difference of strata by scenario, and its relative variation over all."""
    d = stats.groupBy("scenario").agg((F.max(F.when(F.col("stratum") == "pre", F.col(value))) - F.max(F.when(F.col("stratum") == "post", F.col(value)))).alias("delta"))
    w = Window.partitionBy(F.lit(0))
    variation = F.try_divide(F.max("delta").over(w) - F.min("delta").over(w), F.max(F.abs("delta")).over(w))
    return d.withColumn("variation", variation).withColumn("robust", (F.min("delta").over(w) > 0) & (variation <= 0.1))


def stability(contrasts: DataFrame) -> DataFrame:
    """From contrasts by scenario: per token, in how many it is significant, whether always with one lean."""
    own = contrasts.where("lean <> 'neutral'").groupBy("tok").agg(F.count("*").alias("n"), F.count_distinct("lean").alias("leans"), F.min("lean").alias("lean"))
    return own.withColumn("stable", (F.col("n") == len(SCENARIOS)) & (F.col("leans") == 1))


def set_overlap(contrasts: DataFrame) -> DataFrame:
    """Jaccard similarity of the sets of significant tokens of each two scenarios; 1 for two empty ones."""
    sets = contrasts.groupBy("scenario").agg(F.collect_set(F.when(F.col("lean") != "neutral", F.col("tok"))).alias("s"))
    a, b = sets.select(F.col("scenario").alias("a"), F.col("s").alias("x")), sets.select(F.col("scenario").alias("b"), F.col("s").alias("y"))
    both, all_ = F.size(F.array_intersect("x", "y")), F.size(F.array_union("x", "y"))
    return a.join(F.broadcast(b), F.col("a") < F.col("b")).select("a", "b", both.alias("core"), all_.alias("any"), F.coalesce(F.try_divide(double(both), double(all_)), F.lit(1.0)).alias("jaccard"))


def line_scenarios(lines: DataFrame, unknown: Column) -> DataFrame:
    """The lines of tablets (tablet, line, parity, stratum, ...) under the reassignments, at line grain: unknown tablets all late; every second
    one early; the first fifth of each one's lines early, one at least."""
    own = lines.withColumn("unknown", unknown)
    tablets = own.where("unknown").select("tablet", F.lit(1).alias("__one")).distinct()
    tablets = running(tablets, "tablet", "__one").select("tablet", (F.col("before") + 1).alias("__n"))
    w = Window.partitionBy("tablet")
    own = own.join(tablets, "tablet", "left").withColumn("__k", F.dense_rank().over(w.orderBy("line")))
    own = own.withColumn("__early", F.greatest(F.lit(1), F.bround(0.2 * F.max("__k").over(w))))
    pick = {
        "all_late": F.lit("post"),
        "alternate": F.when(F.col("__n") % 2 == 1, "pre").otherwise("post"),
        "first_fifth": F.when(F.col("__k") <= F.col("__early"), "pre").otherwise("post"),
    }
    each = F.explode(F.array(*[F.struct(F.lit(s).alias("scenario"), F.when(F.col("unknown"), pick[s]).otherwise(F.col("stratum")).alias("stratum")) for s in SCENARIOS]))
    rest = [c for c in lines.columns if c != "stratum"]
    return own.select(*rest, each.alias("s")).select(*rest, "s.scenario", "s.stratum")
