"""Queries on feature vectors and on samples of searches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.functions import codes as co
from seqloom.functions.stats import rounded
from seqloom.operators import features as fe
from seqloom.operators import information as info
from seqloom.operators import ngrams as ng
from seqloom.operators import search as se
from seqloom.plans.registry import query
from seqloom.sources import adapters as src

_CEN = """pt AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS k FROM embeddings), ce AS (SELECT label, list(x ORDER BY k) AS c FROM (SELECT label, k, avg(x) AS x FROM pt GROUP BY ALL) GROUP BY label)"""
_COS = "round(list_dot_product({a}, {b}) / sqrt(list_dot_product({a}, {a}) * list_dot_product({b}, {b})), 6)"


def _points(spark: SparkSession, d: str) -> DataFrame:
    return src.read(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "label", "embedding")


@query(
    f"""WITH {_CEN}, s AS (SELECT vec_id AS id, ce.label AS centre, {_COS.format(a="embedding::DOUBLE[]", b="c")} AS similarity FROM embeddings, ce), r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY similarity DESC, centre) AS rank FROM s)
 SELECT id, centre, rank, similarity FROM r WHERE rank <= 2"""
)
def centroid_knn(spark: SparkSession, d: str) -> DataFrame:
    p = _points(spark, d)
    return fe.nearest_centroids(p, fe.centroids(p, "label", "embedding"), "label", "embedding", 2)


_NEAR = f"{_CEN}, s AS (SELECT vec_id AS id, embeddings.label AS label, ce.label AS centre, {_COS.format(a='embedding::DOUBLE[]', b='c')} AS similarity FROM embeddings, ce), nr AS (SELECT id, label, centre FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY similarity DESC, centre) AS r FROM s) WHERE r = 1)"


def _assigned(spark: SparkSession, d: str) -> DataFrame:
    p = _points(spark, d)
    near = fe.nearest_centroids(p, fe.centroids(p, "label", "embedding"), "label", "embedding", 1)
    return near.join(p.select("id", "label"), "id").select("id", "label", "centre")


@query(
    f"""WITH {_NEAR}, c AS (SELECT label, centre, count(*) AS n FROM nr GROUP BY ALL), q AS (SELECT (SELECT sum(n * (n - 1) / 2.0) FROM c) AS s, (SELECT sum(n) FROM c)::DOUBLE AS n, (SELECT sum(n * (n - 1) / 2.0) FROM (SELECT sum(n) AS n FROM c GROUP BY label)) AS x, (SELECT sum(n * (n - 1) / 2.0) FROM (SELECT sum(n) AS n FROM c GROUP BY centre)) AS y)
 SELECT n::BIGINT AS n, round((s - x * y / (n * (n - 1) / 2)) / ((x + y) / 2 - x * y / (n * (n - 1) / 2)), 6) AS ari FROM q"""
)
def ari_contingency(spark: SparkSession, d: str) -> DataFrame:
    return rounded(fe.adjusted_rand(_assigned(spark, d), "label", "centre"))


@query(f"WITH {_NEAR}, c AS (SELECT label, centre, count(*) AS n FROM nr GROUP BY ALL) SELECT centre, sum(n)::BIGINT AS size, arg_max(label, (n, -label)) AS top, round(max(n) / sum(n)::DOUBLE, 6) AS purity FROM c GROUP BY centre")
def cluster_purity(spark: SparkSession, d: str) -> DataFrame:
    return rounded(fe.purity(_assigned(spark, d), "centre", "label"))


@query(f"WITH {_CEN}, s AS (SELECT a.label AS a, b.label AS b, {_COS.format(a='a.c', b='b.c')} AS similarity FROM ce a, ce b WHERE a.label < b.label) SELECT a, b, similarity FROM (SELECT * FROM s ORDER BY similarity DESC, a, b LIMIT 30) WHERE similarity >= -0.5 ORDER BY similarity DESC, a, b LIMIT 10")
def top_centroid_pairs(spark: SparkSession, d: str) -> DataFrame:
    c = fe.centroids(_points(spark, d), "label", "embedding")
    left, right = c.select(F.col("label").alias("a"), F.col("centroid").alias("u")), c.select(F.col("label").alias("b"), F.col("centroid").alias("v"))
    pairs = left.join(F.broadcast(right), F.col("a") < F.col("b"))
    from seqloom.functions.stats import cosine

    sim = pairs.withColumn("similarity", F.round(cosine(F.col("u"), F.col("v")), 6)).orderBy(F.desc("similarity"), "a", "b").limit(30)
    return sim.where("similarity >= -0.5").orderBy(F.desc("similarity"), "a", "b").limit(10).select("a", "b", "similarity")


@query(
    """WITH z AS (SELECT p_brand, p_retailprice AS v, avg(p_retailprice) OVER w AS m FROM part WINDOW w AS (PARTITION BY p_brand)), c AS (SELECT p_brand, count(*) AS n, avg((v - m) ** 2) AS m2, avg((v - m) ** 3) AS m3, avg((v - m) ** 4) AS m4 FROM z GROUP BY p_brand),
 g AS (SELECT p_brand, n, m3 / m2 ** 1.5 AS g, m4 / m2 ** 2 - 3 AS k FROM c) SELECT p_brand, n, round(g, 6) AS skewness, round(k, 6) AS kurtosis, round(CASE WHEN n >= 4 THEN (g ** 2 + 1) / (k + 3.0 * (n - 1) ** 2 / ((n - 2) * (n - 3))) END, 6) AS bimodality FROM g"""
)
def typology_moments(spark: SparkSession, d: str) -> DataFrame:
    return rounded(fe.moments(src.read(spark, d, "part"), "p_retailprice", "p_brand"))


@query("SELECT c_custkey, round((row_number() OVER (ORDER BY c_acctbal, c_custkey) - 1) / (count(*) OVER () - 1)::DOUBLE, 6) AS percentile FROM customer")
def percentile_ranks(spark: SparkSession, d: str) -> DataFrame:
    return rounded(fe.percentile_rank(src.read(spark, d, "customer").select("c_custkey", "c_acctbal"), "c_acctbal", "c_custkey").select("c_custkey", "percentile"))


_ROLES = """k AS (SELECT count(DISTINCT tok)::DOUBLE AS k FROM dw), bg AS (SELECT tok, nxt, count(*) AS f FROM (SELECT tok, lead(tok) OVER (PARTITION BY tablet ORDER BY pos) AS nxt FROM dw) WHERE nxt IS NOT NULL GROUP BY ALL),
 a AS (SELECT tok, sum(f)::DOUBLE AS o, max(f)::DOUBLE AS m FROM bg GROUP BY tok), n AS (SELECT tok, count(DISTINCT x)::DOUBLE AS near FROM (SELECT tok, nxt AS x FROM bg UNION ALL SELECT nxt, tok FROM bg) GROUP BY tok),
 ft AS (SELECT tok, near / k AS neighbor_diversity, coalesce(m / o, 0) AS slot_predictability FROM n LEFT JOIN a USING (tok), k JOIN (SELECT tok AS tk FROM dw GROUP BY tok HAVING count(*) >= 20) q ON true WHERE tk = tok)"""


@query(
    f"""WITH {_ROLES}, c AS (SELECT quantile_cont(slot_predictability, 0.75) AS c1, quantile_cont(neighbor_diversity, 0.9) AS c2, quantile_cont(neighbor_diversity, 0.5) AS c3 FROM ft)
 SELECT tok, round(neighbor_diversity, 6) AS neighbor_diversity, round(slot_predictability, 6) AS slot_predictability, CASE WHEN slot_predictability >= c1 THEN 'determinative' WHEN neighbor_diversity >= c2 THEN 'particle' WHEN neighbor_diversity < c3 THEN 'logogram' ELSE 'default' END AS role FROM ft, c""",
    "dw",
)
def fingerprint_roles(spark: SparkSession, d: str) -> DataFrame:
    t = src.doc_words(spark, d, following=True)
    often = info.counts(t).where("f >= 20").select("tok")
    return rounded(fe.roles(ng.roles(t).join(often, "tok")))


@query(
    """WITH b AS (SELECT tok, ts::DATE - DATE '2024-01-01' AS dd, least(pos // 10, 4) AS bin FROM ue), c AS (SELECT tok, dd // 6 AS stratum, bin, count(*) AS f FROM b GROUP BY ALL), n AS (SELECT tok, stratum, sum(f)::DOUBLE AS n FROM c GROUP BY ALL),
 p AS (SELECT n.tok, n.stratum, bn.bin, coalesce(f, 0) / n AS p FROM n CROSS JOIN (SELECT unnest(range(5)) AS bin) bn LEFT JOIN c ON c.tok = n.tok AND c.stratum = n.stratum AND c.bin = bn.bin),
 j AS (SELECT a.tok, a.stratum AS sa, b.stratum AS sb, sum(CASE WHEN a.p > 0 THEN 0.5 * a.p * log2(a.p / ((a.p + b.p) / 2)) ELSE 0 END + CASE WHEN b.p > 0 THEN 0.5 * b.p * log2(b.p / ((a.p + b.p) / 2)) ELSE 0 END) AS js FROM p a JOIN p b ON a.tok = b.tok AND a.bin = b.bin AND a.stratum < b.stratum GROUP BY ALL)
 SELECT tok, count(DISTINCT n.stratum) AS strata, round(1 - any_value(m), 6) AS stability FROM n JOIN (SELECT tok, avg(js) AS m FROM j GROUP BY tok) USING (tok) GROUP BY tok""",
    "ue",
)
def js_stability(spark: SparkSession, d: str) -> DataFrame:
    t = src.user_events(spark, d)
    day = F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date"))
    own = t.select("tok", F.floor(day / 6).alias("stratum"), F.least(F.floor(F.col("pos") / 10), F.lit(4)).cast("int").alias("bin"))
    return rounded(fe.stability(own, 5))


@query(
    """WITH s AS (SELECT c_mktsegment AS seg, count(*)::DOUBLE AS n, avg(c_acctbal) AS m1, greatest(1, var_pop(c_acctbal)) AS v1, avg(c_nationkey::DOUBLE) AS m2, greatest(1, var_pop(c_nationkey::DOUBLE)) AS v2 FROM customer GROUP BY ALL),
 l AS (SELECT s_suppkey AS id, seg, ln(n) - 0.5 * ln(2 * pi() * v1) - (s_acctbal - m1) ** 2 / (2 * v1) - 0.5 * ln(2 * pi() * v2) - (s_nationkey - m2) ** 2 / (2 * v2) AS lp FROM supplier, s), e AS (SELECT *, exp(lp - max(lp) OVER (PARTITION BY id)) AS e FROM l)
 SELECT id, seg, round(e / sum(e) OVER (PARTITION BY id), 6) AS p FROM e"""
)
def gnb_dating(spark: SparkSession, d: str) -> DataFrame:
    train = src.read(spark, d, "customer").select(F.col("c_mktsegment").alias("seg"), F.col("c_acctbal").alias("x"), F.col("c_nationkey").alias("y"))
    rows = src.read(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("x"), F.col("s_nationkey").alias("y"))
    return rounded(fe.naive_bayes(train, rows, ["x", "y"], "seg"))


@query("SELECT a.p_size AS a, b.p_size AS b, CASE WHEN a.p_size = b.p_size THEN 0 WHEN a.p_size // 10 = b.p_size // 10 THEN 1 ELSE 2 END AS distance FROM (SELECT DISTINCT p_size FROM part) a, (SELECT DISTINCT p_size FROM part) b")
def tree_distance(spark: SparkSession, d: str) -> DataFrame:
    s = src.read(spark, d, "part").select(F.col("p_size").alias("a")).distinct()
    return s.join(F.broadcast(s.withColumnRenamed("a", "b")), F.lit(True)).select("a", "b", co.tree_distance(F.col("a"), F.col("b")).alias("distance"))


@query()
def non_maximum_boxes(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    x, y = (k % 37).cast("double"), (k % 23).cast("double")
    boxes = src.read(spark, d, "part").select((k % 11).alias("grp"), k.alias("box"), x.alias("x0"), y.alias("y0"), (x + 3 + F.col("p_size") % 5).alias("x1"), (y + 3 + k % 4).alias("y1"))
    return fe.non_maximum(boxes)


# Hypotheses: each supplier is a run that gives a part a value.
_HYP = """hy AS (SELECT l_suppkey % 7 AS run, l_partkey AS sign, mode_value AS value, confidence FROM (SELECT l_suppkey % 7 AS l_suppkey, l_partkey, min(l_linenumber) AS mode_value, avg(ln(l_extendedprice)) AS confidence FROM lineitem GROUP BY l_suppkey % 7, l_partkey))"""


def _hypotheses(spark: SparkSession, d: str) -> DataFrame:
    own = src.read(spark, d, "lineitem").groupBy((F.col("l_suppkey") % 7).alias("run"), F.col("l_partkey").alias("sign"))
    return own.agg(F.min("l_linenumber").alias("value"), F.avg(F.ln("l_extendedprice")).alias("confidence"))


@query(f"WITH {_HYP}, c AS (SELECT sign, value, count(*) AS votes, avg(confidence) AS confidence FROM hy GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY sign ORDER BY votes DESC, value) AS k FROM c) SELECT sign, value, votes, round(votes / (SELECT count(DISTINCT run) FROM hy)::DOUBLE, 6) AS share, round(confidence, 6) AS confidence FROM r WHERE k = 1 AND votes / (SELECT count(DISTINCT run) FROM hy)::DOUBLE >= 0.5")
def consensus_votes(spark: SparkSession, d: str) -> DataFrame:
    return rounded(se.votes(_hypotheses(spark, d), 0.5))


@query(f"WITH {_HYP} SELECT sign, CASE WHEN count(DISTINCT value) > 1 THEN 'unstable' WHEN count(DISTINCT run) = (SELECT count(DISTINCT run) FROM hy) THEN 'stable' ELSE 'partial' END AS state FROM hy GROUP BY sign")
def run_stability(spark: SparkSession, d: str) -> DataFrame:
    return se.run_stability(_hypotheses(spark, d))


@query(f"WITH {_HYP}, c AS (SELECT sign, value, count(*) AS n FROM hy GROUP BY ALL) SELECT sign, sum(n)::BIGINT AS n, max(n) AS top, CASE WHEN max(n) = sum(n) THEN 'FULL' WHEN 3 * max(n) >= 2 * sum(n) THEN 'MAJORITY' ELSE 'DIVERGE' END AS verdict FROM c GROUP BY sign")
def hypothesis_agreement(spark: SparkSession, d: str) -> DataFrame:
    return se.agreement(_hypotheses(spark, d), "sign")


# Chains: events of users by number modulo 4, valued by `value`.
_CH = "ch AS (SELECT user_id % 4 AS chain, row_number() OVER (PARTITION BY user_id % 4 ORDER BY event_id) AS iteration, value AS v FROM events)"


def _chains(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    own = src.read(spark, d, "events").select((F.col("user_id") % 4).alias("chain"), "event_id", F.col("value").alias("v"))
    return own.select("chain", F.row_number().over(Window.partitionBy("chain").orderBy("event_id")).alias("iteration"), "v")


@query(f"WITH {_CH}, b AS (SELECT chain, count(*) AS n, avg(v) AS m, var_samp(v) AS s FROM ch GROUP BY chain) SELECT count(*) AS chains, min(n) AS n, round(sqrt(((min(n) - 1)::DOUBLE / min(n) * avg(s) + var_samp(m)) / avg(s)), 6) AS rhat FROM b")
def rhat_chains(spark: SparkSession, d: str) -> DataFrame:
    return rounded(se.gelman_rubin(_chains(spark, d), "v"))


@query(f"WITH {_CH}, k AS (SELECT *, iteration - 1 AS k, count(*) OVER (PARTITION BY chain) AS n FROM ch), a AS (SELECT chain, avg(v) AS m, var_samp(v) AS s, count(*) AS c FROM k WHERE k < floor(n * 0.1) GROUP BY chain), b AS (SELECT chain, avg(v) AS m, var_samp(v) AS s, count(*) AS c FROM k WHERE k >= n - floor(n * 0.5) GROUP BY chain) SELECT chain, round((a.m - b.m) / sqrt(a.s / a.c + b.s / b.c), 6) AS z FROM a JOIN b USING (chain)")
def geweke_chains(spark: SparkSession, d: str) -> DataFrame:
    return rounded(se.geweke(_chains(spark, d), "v"))


@query("WITH c AS (SELECT min(o_totalprice) + 0.9 * (max(o_totalprice) - min(o_totalprice)) AS cut FROM orders) SELECT count(*) AS n, count(*) FILTER (WHERE o_totalprice >= cut) AS good, round(count(*) FILTER (WHERE o_totalprice >= cut) / count(*)::DOUBLE, 6) AS p_good, round(quantile_cont(o_totalprice, 0.5), 6) AS median, round(quantile_cont(o_totalprice, 0.99), 6) AS p99 FROM orders, c")
def good_share(spark: SparkSession, d: str) -> DataFrame:
    return rounded(se.good_share(src.read(spark, d, "orders"), "o_totalprice", 0.9))


# Unigram gains of event types by user parity, as tokens and symbols; pairs of adjacent types.
_Q = """un AS (SELECT event_type AS tok, (user_id % 3)::VARCHAR AS sym, ln(count(*)::DOUBLE) AS gain FROM events GROUP BY ALL), pr AS (SELECT concat(tok, ':0') AS i, concat(nxt, ':1') AS j, ln(f::DOUBLE) AS gain FROM eb),
 tm AS (SELECT concat(tok, ':', sym) AS i, concat(tok, ':', sym) AS j, -gain - 10 AS q FROM un UNION ALL SELECT concat(a.tok, ':', a.sym), concat(b.tok, ':', b.sym), 20 FROM un a JOIN un b ON a.tok = b.tok AND a.sym < b.sym UNION ALL SELECT concat(a.tok, ':', a.sym), concat(b.tok, ':', b.sym), 5 FROM un a JOIN un b ON a.sym = b.sym AND a.tok < b.tok UNION ALL SELECT least(i, j), greatest(i, j), -gain FROM pr),
 qu AS (SELECT i, j, sum(q)::DOUBLE AS q FROM tm GROUP BY i, j)"""


def _terms(spark: SparkSession, d: str) -> DataFrame:
    e = src.read(spark, d, "events")
    uni = e.groupBy(F.col("event_type").alias("tok"), (F.col("user_id") % 3).cast("string").alias("sym")).agg(F.ln(F.count("*").cast("double")).alias("gain"))
    b = ng.bigrams(src.user_events(spark, d)).select(F.concat("tok", F.lit(":0")).alias("i"), F.concat("nxt", F.lit(":1")).alias("j"), F.ln(F.col("f").cast("double")).alias("gain"))
    return se.quadratic_terms(uni, b, 10.0, 5.0)


@query(f"WITH {_Q} SELECT i, j, round(q, 6) AS q FROM qu", "ue", "eb")
def qubo_terms(spark: SparkSession, d: str) -> DataFrame:
    return rounded(_terms(spark, d))


@query(f"WITH {_Q} SELECT i, round(sum(h), 6) AS h FROM (SELECT i, -q / 2 AS h FROM qu WHERE i = j UNION ALL SELECT i, -q / 4 FROM qu WHERE i <> j UNION ALL SELECT j, -q / 4 FROM qu WHERE i <> j) GROUP BY i", "ue", "eb")
def ising_fields(spark: SparkSession, d: str) -> DataFrame:
    return rounded(se.ising(_terms(spark, d)))


@query("WITH s AS (SELECT unnest(['click', 'error', 'purchase', 'signup', 'view']) AS s), m AS (SELECT a.s AS src, b.s AS dst, coalesce(f, 0) + 0.01 AS c FROM s a CROSS JOIN s b LEFT JOIN eb ON eb.tok = a.s AND eb.nxt = b.s) SELECT src, dst, round(ln((c / sum(c) OVER (PARTITION BY src))::DOUBLE), 6) AS lp FROM m", "ue", "eb")
def transition_matrix(spark: SparkSession, d: str) -> DataFrame:
    b = ng.bigrams(src.user_events(spark, d)).select(F.col("tok").alias("src"), F.col("nxt").alias("dst"), "f")
    return rounded(se.log_matrix(b))


@query()
def mcmc_chains(spark: SparkSession, d: str) -> DataFrame:
    """Chains that map event types to role-like symbols; the tables of counts and scores are a few numbers."""
    b = ng.bigrams(src.user_events(spark, d)).collect()
    names = sorted({r.tok for r in b} | {r.nxt for r in b})
    counts = {(names.index(r.tok), names.index(r.nxt)): r.f for r in b}
    lp = se.log_matrix(ng.bigrams(src.conversation_roles(spark, d)).select(F.col("tok").alias("src"), F.col("nxt").alias("dst"), "f")).collect()
    syms = sorted({r.src for r in lp})
    scores = [[next(r.lp for r in lp if r.src == a and r.dst == c) for c in syms] for a in syms]
    return se.anneal(spark, counts, scores, 4, 200, 42)
