"""Stochastic search over assignments of tokens to symbols, and what is computed from its samples."""

from __future__ import annotations

import math
import random
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from seqloom.functions.stats import double


def log_matrix(bigrams: DataFrame, alpha: float = 0.01) -> DataFrame:
    """Add-alpha natural log probabilities (src, dst, lp) over all pairs of the bounded symbol set."""
    sym = bigrams.select(F.col("src").alias("s")).union(bigrams.select(F.col("dst").alias("s"))).distinct()
    full = sym.select(F.col("s").alias("src")).join(F.broadcast(sym.select(F.col("s").alias("dst"))), F.lit(True)).join(bigrams, ["src", "dst"], "left")
    c = double(F.coalesce("f", F.lit(0))) + alpha
    return full.select("src", "dst", F.ln(c / F.sum(c).over(Window.partitionBy("src"))).alias("lp"))


def anneal(spark: SparkSession, counts: dict[tuple[int, int], int], scores: list[list[float]], chains: int, steps: int, seed: int, cap: int = 4, weight: float = 1.0) -> DataFrame:
    """Metropolis chains over maps of tokens to symbols, one chain a row, so chains run wherever there are cores.

    counts: bigrams of token numbers; scores: log probabilities of symbol pairs. A move gives one token another symbol or swaps
    two; its change of score is computed from the bigrams of the tokens it touches only. Symbols used more than `cap` times
    cost a squared penalty.
    """
    if not counts or not scores:
        raise ValueError("chains need bigrams and scores")
    n, m = 1 + max(max(k) for k in counts), len(scores)
    shared = spark.sparkContext.broadcast((counts, scores))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pairs, lp = shared.value
        touch: list[list[tuple[int, int, int]]] = [[] for _ in range(n)]
        for (a, b), c in pairs.items():
            touch[a].append((a, b, c))
            if a != b:
                touch[b].append((a, b, c))
        for frame in batches:
            for chain in frame["chain"]:
                rng = random.Random(seed * 1_000_003 + int(chain))
                now = [rng.randrange(m) for _ in range(n)]
                used = [now.count(s) for s in range(m)]
                penalty = lambda: weight * sum(max(0, u - cap) ** 2 for u in used)  # noqa: E731, B023
                value = sum(c * lp[now[a]][now[b]] for (a, b), c in pairs.items()) - penalty()
                rows, taken = [], 0
                for step in range(steps):
                    x = rng.randrange(n)
                    y = rng.randrange(n) if rng.random() < 0.5 else None
                    new = {x: rng.randrange(m)} if y is None else {x: now[y], y: now[x]}
                    edges = {e for t in new for e in touch[t]}
                    before = sum(c * lp[now[a]][now[b]] for a, b, c in edges) - penalty()
                    old = {t: now[t] for t in new}
                    for t, s in new.items():
                        used[now[t]] -= 1
                        used[s] += 1
                        now[t] = s
                    delta = sum(c * lp[now[a]][now[b]] for a, b, c in edges) - penalty() - before
                    if delta >= 0 or rng.random() < math.exp(delta):
                        value += delta
                        taken += 1
                    else:
                        for t, s in old.items():
                            used[now[t]] -= 1
                            used[s] += 1
                            now[t] = s
                    if step % 10 == 9:
                        rows.append((int(chain), step, value, taken / (step + 1), ",".join(map(str, now))))
                yield pd.DataFrame(rows, columns=["chain", "iteration", "log_posterior", "acceptance", "assignment"])

    return spark.range(chains, numPartitions=chains).select(F.col("id").alias("chain")).mapInPandas(run, "chain long, iteration long, log_posterior double, acceptance double, assignment string")


def gelman_rubin(samples: DataFrame, value: str) -> DataFrame:
    """R-hat over chains of (chain, iteration, value); null for one chain or no variation within."""
    by = samples.groupBy("chain").agg(F.count("*").alias("n"), F.avg(value).alias("m"), F.var_samp(value).alias("v"))
    own = by.agg(F.count("*").alias("chains"), F.min("n").alias("n"), F.var_samp("m").alias("b"), F.avg("v").alias("w"))
    n = double("n")
    r = F.sqrt(((n - 1) / n * F.col("w") + F.col("b")) / F.col("w"))
    return own.select("chains", "n", F.when((F.col("chains") > 1) & (F.col("w") >= 1e-10), r).alias("rhat"))


def geweke(samples: DataFrame, value: str, first: float = 0.1, last: float = 0.5) -> DataFrame:
    """z of the means of the first and last shares of each chain; 0 under ten samples."""
    w = Window.partitionBy("chain")
    own = samples.withColumn("k", F.row_number().over(w.orderBy("iteration")) - 1).withColumn("n", F.count("*").over(w))
    a, b = F.col("k") < F.floor(F.col("n") * first), F.col("k") >= F.col("n") - F.floor(F.col("n") * last)
    s = own.groupBy("chain").agg(F.max("n").alias("n"), *[f(F.when(c, F.col(value))).alias(f"{x}{i}") for i, c in (("a", a), ("b", b)) for x, f in (("m", F.avg), ("v", F.var_samp), ("k", F.count))])
    z = F.try_divide(F.col("ma") - F.col("mb"), F.sqrt(F.col("va") / F.col("ka") + F.col("vb") / F.col("kb")))
    return s.select("chain", F.when(F.col("n") < 10, 0.0).otherwise(z).alias("z"))


def votes(hypotheses: DataFrame, least: float) -> DataFrame:
    """From (run, sign, value, confidence): the value most runs agree on, its share and mean confidence, where the share is enough."""
    runs = hypotheses.agg(F.count_distinct("run").alias("runs"))
    c = hypotheses.groupBy("sign", "value").agg(F.count("*").alias("votes"), F.avg("confidence").alias("confidence"))
    rank = F.row_number().over(Window.partitionBy("sign").orderBy(F.desc("votes"), "value"))
    own = c.withColumn("rank", rank).where("rank = 1").crossJoin(F.broadcast(runs)).withColumn("share", double("votes") / F.col("runs"))
    return own.where(F.col("share") >= least).select("sign", "value", "votes", "share", "confidence")


def run_stability(hypotheses: DataFrame) -> DataFrame:
    """stable: one value in all runs; partial: one value in some; unstable: several."""
    runs = hypotheses.agg(F.count_distinct("run").alias("runs"))
    c = hypotheses.groupBy("sign").agg(F.count_distinct("run").alias("seen"), F.count_distinct("value").alias("values")).crossJoin(F.broadcast(runs))
    return c.select("sign", F.when(F.col("values") > 1, "unstable").when(F.col("seen") == F.col("runs"), "stable").otherwise("partial").alias("state"))


def agreement(hypotheses: DataFrame, key: str) -> DataFrame:
    """FULL, MAJORITY (two thirds) or DIVERGE, by the commonest value at each key."""
    c = hypotheses.groupBy(key, "value").agg(F.count("*").alias("n"))
    own = c.groupBy(key).agg(F.sum("n").alias("n"), F.max("n").alias("top"))
    return own.select(key, "n", "top", F.when(F.col("top") == F.col("n"), "FULL").when(3 * F.col("top") >= 2 * F.col("n"), "MAJORITY").otherwise("DIVERGE").alias("verdict"))


def quadratic_terms(unigram: DataFrame, pairs: DataFrame, one_hot: float, capacity: float) -> DataFrame:
    """Upper triangle of a quadratic model over variables `token:symbol`: unigram gains, one symbol a token, a capacity a symbol,
    and gains of adjacent tokens. unigram: (tok, sym, gain); pairs: (i, j, gain) of variables."""
    v = F.concat_ws(":", "tok", "sym")
    own = unigram.select(v.alias("i"), v.alias("j"), (-F.col("gain") - one_hot).alias("q"))
    a = unigram.select("tok", F.col("sym").alias("s1"))
    b = unigram.select("tok", F.col("sym").alias("s2"))
    row = a.join(b, "tok").where("s1 < s2").select(F.concat_ws(":", "tok", "s1").alias("i"), F.concat_ws(":", "tok", "s2").alias("j"), F.lit(2 * one_hot).alias("q"))
    c = unigram.select(F.col("tok").alias("t1"), "sym").join(unigram.select(F.col("tok").alias("t2"), "sym"), "sym").where("t1 < t2")
    cap = c.select(F.concat_ws(":", "t1", "sym").alias("i"), F.concat_ws(":", "t2", "sym").alias("j"), F.lit(capacity).alias("q"))
    more = pairs.select(F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j"), (-F.col("gain")).alias("q"))
    return own.unionByName(row).unionByName(cap).unionByName(more).groupBy("i", "j").agg(F.sum("q").alias("q"))


def ising(terms: DataFrame) -> DataFrame:
    """Fields h of x = (1 - z) / 2 from quadratic terms; couplings are q / 4 off the diagonal."""
    linear = terms.where("i = j").select("i", (-F.col("q") / 2).alias("h"))
    off = terms.where("i <> j")
    half = off.select("i", (-F.col("q") / 4).alias("h")).unionByName(off.select(F.col("j").alias("i"), (-F.col("q") / 4).alias("h")))
    return linear.unionByName(half).groupBy("i").agg(F.sum("h").alias("h"))


def good_share(scores: DataFrame, value: str, tau: float) -> DataFrame:
    """Share of scores at or over min + tau (max - min), and quantiles."""
    cut = scores.agg((F.min(value) + tau * (F.max(value) - F.min(value))).alias("cut"))
    return scores.crossJoin(F.broadcast(cut)).agg(
        F.count("*").alias("n"),
        F.count_if(F.col(value) >= F.col("cut")).alias("good"),
        (double(F.count_if(F.col(value) >= F.col("cut"))) / F.count("*")).alias("p_good"),
        F.percentile(value, 0.5).alias("median"),
        F.percentile(value, 0.99).alias("p99"),
    )


def binomial_interval(k: int, n: int, alpha: float = 0.05) -> tuple[float, float]:
    """Exact (Clopper-Pearson) interval by bisection on the binomial tail."""

    def tail(p: float) -> float:  # P(X >= k)
        return sum(math.exp(math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p)) for i in range(k, n + 1)) if 0 < p < 1 else float(p >= 1)

    def upper(p: float) -> float:  # P(X <= k)
        return sum(math.exp(math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p)) for i in range(k + 1)) if 0 < p < 1 else float(p <= 0)

    def solve(f, rising: bool) -> float:  # noqa: ANN001
        lo, hi = 0.0, 1.0
        for _ in range(200):
            mid = (lo + hi) / 2
            if (f(mid) > alpha / 2) == rising:
                hi = mid
            else:
                lo = mid
        return (lo + hi) / 2

    return (0.0 if k == 0 else solve(tail, True)), (1.0 if k == n else solve(upper, False))


def ising_model(terms: DataFrame) -> DataFrame:
    """kind (field, coupling, offset), i, j, value of x = (1 - z) / 2 from quadratic terms; one offset, 0 without terms."""
    none = F.lit(None).cast("string")
    fields = ising(terms).select(F.lit("field").alias("kind"), "i", none.alias("j"), F.col("h").alias("value"))
    couplings = terms.where("i <> j").groupBy("i", "j").agg(F.sum(F.col("q") / 4).alias("value")).select(F.lit("coupling").alias("kind"), "i", "j", "value")
    offset = terms.agg(F.coalesce(F.sum(F.col("q") / F.when(F.col("i") == F.col("j"), 2).otherwise(4)), F.lit(0.0)).alias("value"))
    return fields.unionByName(couplings).unionByName(offset.select(F.lit("offset").alias("kind"), none.alias("i"), none.alias("j"), "value"))


def chosen(sample: DataFrame) -> DataFrame:
    """sign, value: of each sign the first value that is on, else the first of all. sample: sign, k (order of the value), value, x (0 or 1)."""
    first = F.min_by("value", F.struct((F.col("x") != 1).cast("int"), "k"))
    return sample.groupBy("sign").agg(first.alias("value"))


def choice_confidence(sample: DataFrame, reads: DataFrame) -> DataFrame:
    """sign, value, confidence: the share of reads, by their occurrences, in which the value chosen from the best sample is on; 1 without
    reads. reads: read, occurrences, sign, value, x."""
    total = reads.select("read", "occurrences").distinct().agg(F.sum("occurrences").alias("total"))
    own = chosen(sample)
    on = reads.where("x = 1").groupBy("sign", "value").agg(F.sum("occurrences").alias("on"))
    share = F.when(F.coalesce("total", F.lit(0)) == 0, 1.0).otherwise(double(F.coalesce("on", F.lit(0))) / F.col("total"))
    return own.join(on, ["sign", "value"], "left").crossJoin(F.broadcast(total)).select("sign", "value", share.alias("confidence"))


def priorities(tokens: DataFrame, weight: float = 1.0) -> DataFrame:
    """tok, priority: weight of information (ic) times 1 + weight (1 - entropy of place over the largest); tokens without an entropy
    count as the largest. tokens: tok, ic, place_h."""
    top = tokens.agg(F.greatest(F.coalesce(F.max("place_h"), F.lit(0.0)), F.lit(1e-9)).alias("top"))
    free = F.coalesce("place_h", "top") / F.col("top")
    return tokens.crossJoin(F.broadcast(top)).select("tok", (F.coalesce("ic", F.lit(0.0)) * (1 + weight * (1 - free))).alias("priority"))


def typed(rows: DataFrame, threshold: float) -> DataFrame:
    """tok, type: phonogram in the cluster of the larger mean frequency (the first of equal ones), logogram in the other, unresolved where
    neither posterior reaches the threshold. rows: tok, frequency, p0, p1."""
    hard = (F.col("p1") > F.col("p0")).cast("int")
    mean = lambda k: F.coalesce(F.avg(F.when(hard == k, F.col("frequency"))), F.lit(0.0))
    phonograms = rows.agg((mean(1) > mean(0)).cast("int").alias("cluster"))
    kind = F.when(F.greatest("p0", "p1") < threshold, "unresolved").when(hard == F.col("cluster"), "phonogram").otherwise("logogram")
    return rows.crossJoin(F.broadcast(phonograms)).select("tok", kind.alias("type"))


def threshold_sweep(rows: DataFrame, thresholds: list[float]) -> DataFrame:
    """By threshold: tokens of each type, and the share of those that are resolved there and under the first threshold that agree."""
    base = typed(rows, thresholds[0]).where("type <> 'unresolved'").select("tok", F.col("type").alias("base"))
    out = None
    for t in thresholds:
        own = typed(rows, t).join(base, "tok", "left")
        same = F.when(F.col("base").isNotNull() & (F.col("type") != "unresolved"), (F.col("type") == F.col("base")).cast("double"))
        own = own.agg(*[F.count_if(F.col("type") == k).alias(f"n_{k}") for k in ("phonogram", "logogram", "unresolved")], F.coalesce(F.avg(same), F.lit(1.0)).alias("agreement"))
        own = own.select(F.lit(t).alias("threshold"), "*")
        out = own if out is None else out.unionByName(own)
    return out


def robust_weight(weights: DataFrame) -> DataFrame:
    """expected: the sum of weights where the change holds. weights: weight, holds."""
    return weights.agg(F.coalesce(F.sum(F.when(F.col("holds"), F.col("weight"))), F.lit(0.0)).alias("expected"))
