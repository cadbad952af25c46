"""Windows over token sequences: bigrams, successors, boundaries, patterns, chains."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from seqloom.functions.stats import double, entropy_of


def order() -> WindowSpec:
    """Tokens of a tablet in order."""
    return Window.partitionBy("tablet").orderBy("pos")


def with_next(tokens: DataFrame, span: str = "tablet") -> DataFrame:
    """Adds nxt, the token that follows within the tablet (or, with span='stratum', in the stratum's tablets end to end). Tables that
    bring nxt, within the tablet, keep it; across tablets, the last tokens then get theirs from a row a tablet, and others stay where they are."""
    if "nxt" in tokens.columns:
        if span == "tablet":
            return tokens
        ends = tokens.groupBy("stratum", "tablet").agg(F.min_by("tok", "pos").alias("head"), F.max_by("tok", "pos").alias("tok"), F.max("pos").alias("pos"))
        ends = ends.withColumn("nxt", F.lead("head").over(Window.partitionBy("stratum").orderBy("tablet")))
        columns = ["stratum", "tablet", "pos", "tok", "nxt"]
        return tokens.where("nxt is not null").select(*columns).unionByName(ends.select(*columns))
    if span == "tablet":
        return tokens.withColumn("nxt", F.lead("tok").over(order()))
    # Within tablets in parallel; across them with one row a tablet, which brings the first token of the next one.
    w = Window.partitionBy("stratum", "tablet").orderBy("pos")
    heads = tokens.groupBy("stratum", "tablet").agg(F.min_by("tok", "pos").alias("head"))
    heads = heads.select("stratum", "tablet", F.lead("head").over(Window.partitionBy("stratum").orderBy("tablet")).alias("next_head"))
    own = tokens.withColumn("nxt", F.lead("tok").over(w)).withColumn("is_last", F.lead("pos").over(w).isNull())
    own = own.join(heads, ["stratum", "tablet"]).withColumn("nxt", F.when(F.col("is_last"), F.col("next_head")).otherwise(F.col("nxt")))
    return own.select(*tokens.columns, "nxt")


def bigrams(tokens: DataFrame, *by: str, span: str = "tablet") -> DataFrame:
    return with_next(tokens, span).where("nxt is not null").groupBy(*by, "tok", "nxt").agg(F.count("*").alias("f"))


def conditional_entropy(tokens: DataFrame, *by: str, span: str = "tablet") -> DataFrame:
    """H(next | token) in bits: H(pair) - H(first)."""
    c = bigrams(tokens, *by, span=span)
    pair = c.groupBy(*by).agg(F.sum("f").alias("n"), entropy_of(F.col("f")).alias("h2"))
    first = c.groupBy(*by, "tok").agg(F.sum("f").alias("f")).groupBy(*by).agg(entropy_of(F.col("f")).alias("h1"))
    both = pair.join(first, list(by)) if by else pair.crossJoin(first)
    return both.select(*by, "n", (F.col("h2") - F.col("h1")).alias("h_cond"))


def pmi_edges(tokens: DataFrame, least: int = 2, floor: float | None = None, base: float = 2.718281828459045) -> DataFrame:
    """Bigrams of at least `least` occurrences with pointwise information (bigrams over bigrams, tokens over tokens)."""
    c = bigrams(tokens)
    uni = tokens.groupBy("tok").agg(F.count("*").alias("u"))
    totals = c.agg(F.sum("f").alias("nb")).crossJoin(uni.agg(F.sum("u").alias("nu")))
    e = c.where(F.col("f") >= least).join(uni.withColumnRenamed("u", "us"), "tok").join(uni.select(F.col("tok").alias("nxt"), F.col("u").alias("ut")), "nxt").crossJoin(F.broadcast(totals))
    p = double("f") / F.col("nb")
    pmi = F.ln(p / ((double("us") / F.col("nu")) * (double("ut") / F.col("nu")))) / F.ln(F.lit(base))
    e = e.select(F.col("tok").alias("src"), F.col("nxt").alias("dst"), F.col("f").alias("n"), pmi.alias("pmi"), (pmi / (-F.ln(p) / F.ln(F.lit(base)))).alias("npmi"))
    return e if floor is None else e.where(F.col("pmi") >= floor)


def successor_entropy(tokens: DataFrame, base: float = 2.0) -> DataFrame:
    return bigrams(tokens).groupBy("tok").agg(F.sum("f").alias("n"), entropy_of(F.col("f"), base).alias("h"))


def roles(tokens: DataFrame) -> DataFrame:
    """neighbor_diversity (distinct neighbours over types), slot_predictability (share of the likeliest successor), direction_skew."""
    c = bigrams(tokens)
    types = tokens.agg(F.count_distinct("tok").alias("k"))
    after = c.groupBy("tok").agg(F.sum("f").alias("out"), F.max("f").alias("top"), F.count("*").alias("n_after"))
    before = c.groupBy(F.col("nxt").alias("tok")).agg(F.sum("f").alias("into"), F.count("*").alias("n_before"))
    near = c.select("tok", F.col("nxt").alias("x")).union(c.select(F.col("nxt").alias("tok"), F.col("tok").alias("x"))).groupBy("tok").agg(F.count_distinct("x").alias("near"))
    both = near.join(after, "tok", "left").join(before, "tok", "left").crossJoin(F.broadcast(types))
    n1, n2 = double(F.coalesce("n_after", F.lit(0))), double(F.coalesce("n_before", F.lit(0)))
    return both.select("tok", (double("near") / F.col("k")).alias("neighbor_diversity"), F.coalesce(double("top") / F.col("out"), F.lit(0.0)).alias("slot_predictability"), F.try_divide(n1 - n2, n1 + n2).alias("direction_skew"))


def segments(tokens: DataFrame, threshold: float | None = None) -> DataFrame:
    """Cut after each token whose successor entropy is over the threshold (mean and one population deviation), not after the last."""
    h = successor_entropy(tokens).select("tok", "h")
    cut = h.agg((F.avg("h") + F.stddev_pop("h")).alias("cut")) if threshold is None else h.agg(F.lit(threshold).alias("cut"))
    own = with_next(tokens).join(F.broadcast(h), "tok", "left").crossJoin(F.broadcast(cut))
    own = own.withColumn("end", ((F.col("h") > F.col("cut")) & F.col("nxt").isNotNull()).cast("int"))
    before = F.coalesce(F.sum("end").over(order().rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    own = own.withColumn("segment", before)
    return own.groupBy("tablet", "segment").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "tok"))), lambda x: x["tok"]), " ").alias("toks"), F.count("*").alias("size"))


def reversed_order(tokens: DataFrame) -> DataFrame:
    return tokens.withColumn("pos", -F.col("pos"))


def boundary_entropy(tokens: DataFrame, line: Column) -> DataFrame:
    """Conditional entropy of pairs within a line and of pairs across lines."""
    own = tokens.withColumn("line", line)
    pairs = own.withColumn("nxt", F.lead("tok").over(order())).withColumn("kind", F.when(F.lead("line").over(order()) == F.col("line"), "within").otherwise("across")).where("nxt is not null")
    c = pairs.groupBy("kind", "tok", "nxt").agg(F.count("*").alias("f"))
    pair = c.groupBy("kind").agg(F.sum("f").alias("n"), entropy_of(F.col("f")).alias("h2"))
    first = c.groupBy("kind", "tok").agg(F.sum("f").alias("f")).groupBy("kind").agg(entropy_of(F.col("f")).alias("h1"))
    return pair.join(first, "kind").select("kind", "n", (F.col("h2") - F.col("h1")).alias("h_cond"))


def cooccurrence(tokens: DataFrame, context: str, window: int = 8) -> DataFrame:
    """Per token: how often the context token stands within `window` places, both ends included, the token itself not."""
    flag = (F.col("tok") == context).cast("int")
    near = F.greatest(F.coalesce(F.max(flag).over(order().rowsBetween(-window, -1)), F.lit(0)), F.coalesce(F.max(flag).over(order().rowsBetween(1, window)), F.lit(0)))
    return tokens.withColumn("near", near).groupBy("tok").agg(F.count("*").alias("n"), F.sum("near").alias("with_context"), (double(F.sum("near")) / F.count("*")).alias("rate"))


def windows(tokens: DataFrame, n: int) -> DataFrame:
    """gram: the n tokens from each position on, where there are n."""
    gram = F.array(*[F.lead("tok", k).over(order()) if k else F.col("tok") for k in range(n)])
    last = F.lead("tok", n - 1).over(order()) if n > 1 else F.col("tok")
    return tokens.withColumn("gram", gram).withColumn("__last", last).where("__last is not null").drop("__last")


def ngram_index(tokens: DataFrame, longest: int = 8) -> DataFrame:
    """Counts of all n-grams up to a length, with the number of tablets."""
    parts = [windows(tokens, n).select("tablet", F.lit(n).alias("n"), F.array_join("gram", " ").alias("gram")) for n in range(1, longest + 1)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy("n", "gram").agg(F.count("*").alias("f"), F.count_distinct("tablet").alias("tablets"))


def abab(tokens: DataFrame) -> DataFrame:
    """Positions where a b a b starts, a and b unequal."""
    t = [F.col("tok"), *[F.lead("tok", k).over(order()) for k in (1, 2, 3)]]
    own = tokens.select("tablet", "pos", t[0].alias("a"), t[1].alias("b"), t[2].alias("c"), t[3].alias("d"))
    return own.where("a = c and b = d and a <> b").select("tablet", "pos", "a", "b")


def find_patterns(tokens: DataFrame, patterns: DataFrame) -> DataFrame:
    """Occurrences of each pattern (name, pattern array): an equality join per pattern length, no pass over all pairs."""
    out = None
    for n in sorted(r[0] for r in patterns.select(F.size("pattern")).distinct().collect()):
        own = windows(tokens, n).join(F.broadcast(patterns.where(F.size("pattern") == n)), F.col("gram") == F.col("pattern")).select("name", "tablet", "pos")
        out = own if out is None else out.unionByName(own)
    return patterns.join(tokens, F.lit(False)).select("name", "tablet", "pos") if out is None else out


def chains(rows: DataFrame, at: str, gap: float, *by: str) -> DataFrame:
    """Rows whose order values follow within `gap` make one chain: first, last and size."""
    w = Window.partitionBy(*by).orderBy(at)
    new = F.coalesce((F.col(at) - F.lag(at).over(w) > gap).cast("int"), F.lit(0))
    own = rows.withColumn("__new", new).withColumn("chain", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return own.groupBy(*by, "chain").agg(F.min(at).alias("first"), F.max(at).alias("last"), F.count("*").alias("size"))


def context_windows(tokens: DataFrame, half: int = 2, pad: str = "<pad>") -> DataFrame:
    """The tokens around each, padded at the ends."""
    around = [F.coalesce(F.lead("tok", -k).over(order()) if k < 0 else F.lag("tok", k).over(order()), F.lit(pad)) for k in (*range(half, 0, -1), *range(-1, -half - 1, -1))]
    return tokens.select("tablet", "pos", "tok", F.array_join(F.array(*around), " ").alias("context"))
