"""Feature vectors, clusters and small classifiers over tables."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqloom.functions.stats import cosine, double, js_divergence


def centroids(points: DataFrame, by: str, vector: str) -> DataFrame:
    """Mean vector of each group, by dimension."""
    dims = points.select(by, F.posexplode(vector).alias("k", "x")).groupBy(by, "k").agg(F.avg(double("x")).alias("x"))
    return dims.groupBy(by).agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "x"))), lambda s: s["x"]).alias("centroid"))


def nearest_centroids(points: DataFrame, centres: DataFrame, by: str, vector: str, k: int = 1) -> DataFrame:
    """The k centroids nearest to each point by cosine. Centroids are one a class, a bounded set."""
    sim = points.join(F.broadcast(centres.withColumnRenamed(by, "centre")), F.lit(True)).withColumn("similarity", F.round(cosine(F.col(vector), F.col("centroid")), 6))
    rank = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("similarity"), "centre"))
    return sim.withColumn("rank", rank).where(F.col("rank") <= k).select("id", "centre", "rank", "similarity")


def adjusted_rand(labels: DataFrame, a: str, b: str) -> DataFrame:
    """Adjusted Rand index of two labellings from their contingency table."""
    two = lambda c: double(c) * (double(c) - 1) / 2
    cell = labels.groupBy(a, b).agg(F.count("*").alias("n"))
    sums = cell.agg(F.sum(two("n")).alias("s"), F.sum("n").alias("n"))
    left = cell.groupBy(a).agg(F.sum("n").alias("n")).agg(F.sum(two("n")).alias("x"))
    right = cell.groupBy(b).agg(F.sum("n").alias("n")).agg(F.sum(two("n")).alias("y"))
    own = sums.crossJoin(left).crossJoin(right)
    expected = F.col("x") * F.col("y") / two("n")
    return own.select("n", F.try_divide(F.col("s") - expected, (F.col("x") + F.col("y")) / 2 - expected).alias("ari"))


def purity(labels: DataFrame, cluster: str, label: str) -> DataFrame:
    """Per cluster: size, the commonest label (smallest among equals) and its share."""
    c = labels.groupBy(cluster, label).agg(F.count("*").alias("n"))
    best = F.max_by(F.col(label), F.struct("n", -F.col(label)))
    return c.groupBy(cluster).agg(F.sum("n").alias("size"), best.alias("top"), (double(F.max("n")) / F.sum("n")).alias("purity"))


def moments(rows: DataFrame, value: str, *by: str) -> DataFrame:
    """Population skewness and kurtosis and the bimodality coefficient (null under four rows)."""
    n = double(F.count("*"))
    g, k = F.skewness(value), F.kurtosis(value)
    bc = (g**2 + 1) / (k + F.try_divide(3 * (n - 1) ** 2, (n - 2) * (n - 3)))
    return rows.groupBy(*by).agg(F.count("*").alias("n"), g.alias("skewness"), k.alias("kurtosis"), F.when(F.count("*") >= 4, bc).alias("bimodality"))


def percentile_rank(rows: DataFrame, value: str, key: str) -> DataFrame:
    """Order of the value, ties by key, over n - 1."""
    w = Window.partitionBy(F.lit(0))
    return rows.withColumn("percentile", F.try_divide(double(F.row_number().over(w.orderBy(value, key)) - 1), double(F.count("*").over(w) - 1)))


def classify(rows: DataFrame, frequency: Column, omission: Column, entropy: Column) -> DataFrame:
    """Ordered rules: unknown, taxogram, logogram, phonetic."""
    label = F.when(frequency < 3, "unknown").when(omission > 0.3, "taxogram").when((entropy < 0.5) & (frequency < 20), "logogram").otherwise("phonetic")
    return rows.withColumn("label", label)


def roles(features: DataFrame) -> DataFrame:
    """Roles by thresholds that come from the features: determinative, particle, logogram, else default."""
    cut = features.agg(F.percentile("slot_predictability", 0.75).alias("c1"), F.percentile("neighbor_diversity", 0.9).alias("c2"), F.percentile("neighbor_diversity", 0.5).alias("c3"))
    own = features.crossJoin(F.broadcast(cut))
    role = F.when(F.col("slot_predictability") >= F.col("c1"), "determinative").when(F.col("neighbor_diversity") >= F.col("c2"), "particle").when(F.col("neighbor_diversity") < F.col("c3"), "logogram").otherwise("default")
    return own.select("tok", "neighbor_diversity", "slot_predictability", role.alias("role"))


def stability(tokens: DataFrame, bins: int, least: int = 3) -> DataFrame:
    """Per token: 1 - mean Jensen-Shannon divergence of its position bins over pairs of strata; null under `least` strata.

    The columns are token, stratum and bin; pairs are of strata, of which there are few."""
    c = tokens.groupBy("tok", "stratum", "bin").agg(F.count("*").alias("f"))
    dist = c.groupBy("tok", "stratum").agg(F.map_from_entries(F.collect_list(F.struct("bin", "f"))).alias("m"), F.sum("f").alias("n"))
    dist = dist.select("tok", "stratum", F.array(*[F.coalesce(double(F.try_element_at("m", F.lit(k))), F.lit(0.0)) / F.col("n") for k in range(bins)]).alias("p"))
    a, b = dist.select("tok", F.col("stratum").alias("sa"), F.col("p").alias("pa")), dist.select("tok", F.col("stratum").alias("sb"), F.col("p").alias("pb"))
    pairs = a.join(b, "tok").where("sa < sb").groupBy("tok").agg((1 - F.avg(js_divergence(F.col("pa"), F.col("pb")))).alias("stability"))
    n = dist.groupBy("tok").agg(F.count("*").alias("strata"))
    return n.join(pairs, "tok", "left").select("tok", "strata", F.when(F.col("strata") >= least, F.col("stability")).alias("stability"))


def naive_bayes(train: DataFrame, rows: DataFrame, columns: list[str], label: str, floor: float = 1.0) -> DataFrame:
    """Gaussian class posteriors; variances are at least `floor`; entropy of the posterior in bits."""
    stats = train.groupBy(label).agg(F.count("*").alias("n"), *[F.avg(double(c)).alias(f"m_{c}") for c in columns], *[F.greatest(F.lit(floor), F.var_pop(double(c))).alias(f"v_{c}") for c in columns])
    lp = F.ln(double("n"))
    for c in columns:
        lp = lp - 0.5 * F.ln(2 * F.pi() * F.col(f"v_{c}")) - (double(c) - F.col(f"m_{c}")) ** 2 / (2 * F.col(f"v_{c}"))
    own = rows.join(F.broadcast(stats), F.lit(True)).select("id", label, lp.alias("lp"))
    w = Window.partitionBy("id")
    p = F.exp(F.col("lp") - F.max("lp").over(w))
    return own.withColumn("e", p).withColumn("p", F.col("e") / F.sum("e").over(w)).select("id", label, "p")


def iou(a: Column, b: Column) -> Column:
    """Overlap over union of boxes (x0, y0, x1, y1)."""
    side = lambda lo, hi: F.greatest(F.lit(0.0), F.least(a[hi], b[hi]) - F.greatest(a[lo], b[lo]))
    inter = side("x0", "x1") * side("y0", "y1")
    area = lambda c: (c["x1"] - c["x0"]) * (c["y1"] - c["y0"])
    return F.coalesce(F.try_divide(inter, area(a) + area(b) - inter), F.lit(0.0))


def non_maximum(boxes: DataFrame, limit: float = 0.3) -> DataFrame:
    """Per group: boxes from large to small, each kept unless it overlaps a kept one by more than the limit. The choice is
    sequential within a group, one image."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.assign(area=(frame.x1 - frame.x0) * (frame.y1 - frame.y0)).sort_values(["area", "box"], ascending=[False, True])
        kept: list = []
        for r in frame.itertuples():
            for q in kept:
                i = max(0.0, min(r.x1, q.x1) - max(r.x0, q.x0)) * max(0.0, min(r.y1, q.y1) - max(r.y0, q.y0))
                if i > limit * (r.area + q.area - i):
                    break
            else:
                kept.append(r)
        return pd.DataFrame({"grp": [r.grp for r in kept], "box": [r.box for r in kept]}).astype({"grp": "int64", "box": "int64"})

    return boxes.groupBy("grp").applyInPandas(run, "grp long, box long")


def top_pairs(left: DataFrame, right: DataFrame, k: int, least: float) -> DataFrame:
    """The most similar pairs of two small galleries: the first 3k by cosine, those over `least`, k of them."""
    sim = left.join(F.broadcast(right), F.lit(True)).withColumn("similarity", F.round(cosine(F.col("u"), F.col("v")), 6))
    first = sim.orderBy(F.desc("similarity"), "a", "b").limit(3 * k).where(F.col("similarity") >= least)
    return first.orderBy(F.desc("similarity"), "a", "b").limit(k).select("a", "b", "similarity")
