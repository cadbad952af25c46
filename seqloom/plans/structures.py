"""Queries on structure and graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.functions.stats import rounded
from seqloom.operators import graph as gr
from seqloom.operators import ngrams as ng
from seqloom.operators import structural as st
from seqloom.plans.registry import ORACLES, h, query
from seqloom.sources import adapters as src


@query(
    """WITH c AS (SELECT tablet, tok, period, count(*) AS m, sqrt(sum(cos(2 * pi() * pos / period)) ** 2 + sum(sin(2 * pi() * pos / period)) ** 2) / count(*) AS coherence FROM ue, (SELECT unnest([2, 3, 4, 5, 7]) AS period) GROUP BY ALL HAVING count(*) >= 5),
 r AS (SELECT *, row_number() OVER (PARTITION BY tablet, tok ORDER BY round(coherence, 8) DESC, period) AS k FROM c) SELECT tablet, tok, m, period, round(coherence, 6) AS coherence FROM r WHERE k = 1""",
    "ue",
)
def phase_coherence(spark: SparkSession, d: str) -> DataFrame:
    return rounded(st.phase_coherence(src.user_events(spark, d), [2, 3, 4, 5, 7], 5))


@query(
    f"""WITH o AS (SELECT *, lead(tok) OVER (PARTITION BY tablet ORDER BY pos) AS nxt, lead(pos) OVER (PARTITION BY tablet, tok ORDER BY pos) AS t2 FROM ue), s AS (SELECT tablet, list(tok ORDER BY pos) AS seq FROM ue GROUP BY tablet),
 g AS (SELECT tablet, tok, count(*) AS slots, count(DISTINCT seq[pos + 2:t2]) / count(*)::DOUBLE AS distinctness, stddev_pop((t2 - pos)::DOUBLE) / avg(t2 - pos) AS gap_cv FROM o JOIN s USING (tablet) WHERE t2 IS NOT NULL GROUP BY ALL),
 hd AS (SELECT tablet, tok, {h()} AS he FROM (SELECT tablet, tok, nxt, count(*) AS f FROM o WHERE nxt IS NOT NULL GROUP BY ALL) GROUP BY ALL)
 SELECT tablet, tok, slots, round(distinctness, 6) AS distinctness, round(gap_cv, 6) AS gap_cv, round(he, 6) AS head_entropy FROM g JOIN hd USING (tablet, tok)""",
    "ue",
)
def slot_statistics(spark: SparkSession, d: str) -> DataFrame:
    return rounded(st.slots(src.user_events(spark, d)))


_PHASE = ORACLES["phase_coherence"].replace("count(*) >= 5", "count(*) >= 1")


@query(f"WITH cc AS (SELECT tablet, tok, count(*) AS m, sum(count(*)) OVER (PARTITION BY tablet) AS n FROM ue GROUP BY tablet, tok) SELECT p.tablet, max(p.coherence) AS coherence FROM ({_PHASE}) p JOIN ({ORACLES['slot_statistics']}) s ON s.tablet = p.tablet AND s.tok = p.tok JOIN cc ON cc.tablet = p.tablet AND cc.tok = p.tok WHERE cc.m >= 3 AND cc.m >= 0.1 * cc.n AND s.slots >= 2 AND s.distinctness >= 0.5 GROUP BY p.tablet", "ue")
def section_coherence(spark: SparkSession, d: str) -> DataFrame:
    return rounded(st.section_coherence(src.user_events(spark, d), [2, 3, 4, 5, 7], 3, 0.1, 2, 0.5))


_ARMS = """b AS (SELECT l.tablet, l.pos + r.pos AS centre, (r.pos - l.pos + 1) // 2 AS s, l.tok AS tok, l.tok = r.tok AS same FROM ue l JOIN ue r ON l.tablet = r.tablet AND r.pos > l.pos),
 k AS (SELECT *, sum((NOT same)::INT) OVER (PARTITION BY tablet, centre ORDER BY s) AS bad FROM b)"""


@query(f"WITH {_ARMS}, m AS (SELECT tablet, centre, max(s) AS arm FROM k WHERE bad = 0 GROUP BY ALL) SELECT tablet, max(arm)::INT AS arm, count(*) AS centres FROM m GROUP BY tablet", "ue")
def mirror_span(spark: SparkSession, d: str) -> DataFrame:
    return st.mirror_span(src.user_events(spark, d))


@query(
    f"""WITH {_ARMS}, g AS (SELECT tablet, centre, list(tok ORDER BY s) AS arm FROM k WHERE bad = 0 GROUP BY ALL), q AS (SELECT tablet, centre, arm, unnest(range(1, len(arm) + 1)) AS s FROM g)
 SELECT tablet, max(s)::INT AS arm, (SELECT count(*) FROM g WHERE g.tablet = q.tablet) AS centres FROM q WHERE s >= 2 AND list_unique(arm[1:s]) >= 0.6 * s GROUP BY tablet""",
    "ue",
)
def mirror_gated(spark: SparkSession, d: str) -> DataFrame:
    return st.mirror_span(src.user_events(spark, d), 2, 0.6)


# Truth table: is the extended price of the parts of a size class over the median of all classes?
_TT = """q AS (SELECT x, coalesce(v, 0) AS v FROM (SELECT unnest(range(64)) AS x) LEFT JOIN (SELECT p_partkey % 64 AS x, sum(p_size)::DOUBLE AS v FROM part GROUP BY 1) USING (x)), tt AS (SELECT x, (v > (SELECT quantile_cont(v, 0.5) FROM q))::INT AS f FROM q)"""


def _truth(spark: SparkSession, d: str) -> DataFrame:
    v = src.read(spark, d, "part").groupBy((F.col("p_partkey") % 64).alias("x")).agg(F.sum("p_size").cast("double").alias("v"))
    q = spark.range(64).select(F.col("id").alias("x")).join(v, "x", "left").select("x", F.coalesce("v", F.lit(0.0)).alias("v"))
    return q.crossJoin(F.broadcast(q.agg(F.percentile("v", 0.5).alias("m")))).select("x", (F.col("v") > F.col("m")).cast("int").alias("f"))


_W = "w AS (SELECT s, sum(CASE WHEN (bit_count((x & s)::BIGINT) + f) % 2 = 0 THEN 1 ELSE -1 END)::BIGINT AS w FROM tt, (SELECT unnest(range(64)) AS s) GROUP BY s)"


@query(f"WITH {_TT}, {_W} SELECT s, w, round((abs(w) + 64) / 128.0, 6) AS agreement FROM w")
def walsh_spectrum(spark: SparkSession, d: str) -> DataFrame:
    return rounded(st.agreement(st.walsh(_truth(spark, d), 6), 6))


@query(f"WITH {_TT}, p AS (SELECT xor(xor(a.f, b.f), c.f) AS v FROM tt a, tt b JOIN tt c ON c.x = xor(a.x, b.x)) SELECT round(avg((v = 0)::INT::DOUBLE), 6) AS linear, round(avg((v = (SELECT f FROM tt WHERE x = 0))::INT::DOUBLE), 6) AS affine FROM p")
def affine_structure(spark: SparkSession, d: str) -> DataFrame:
    return rounded(st.affine_share(_truth(spark, d)))


# Measurements: numbers made orthogonal to a hidden one by flipping its lowest bit.
@query(
    """WITH z AS (SELECT o_custkey % 50 AS grp, 1 + o_custkey % 50 % 31 AS s, o_orderkey % 32 AS y FROM orders), y AS (SELECT grp, CASE WHEN bit_count((y & s)::BIGINT) % 2 = 1 THEN xor(y, s & -s) ELSE y END AS y FROM z)
 SELECT grp, min(s) AS period FROM (SELECT grp, s FROM y, (SELECT unnest(range(1, 32)) AS s) GROUP BY ALL HAVING bool_and(bit_count((y & s)::BIGINT) % 2 = 0)) GROUP BY grp"""
)
def simon_period(spark: SparkSession, d: str) -> DataFrame:
    own = src.read(spark, d, "orders").select((F.col("o_custkey") % 50).alias("grp"), (F.col("o_orderkey") % 32).alias("y")).withColumn("s", 1 + F.col("grp") % 31)
    odd = F.bit_count(F.col("y").bitwiseAND(F.col("s"))) % 2 == 1
    own = own.withColumn("y", F.when(odd, F.col("y").bitwiseXOR(F.col("s").bitwiseAND(-F.col("s")))).otherwise(F.col("y")))
    return st.hidden_period(own.select("grp", "y"), 5)


@query(
    """WITH a AS (SELECT i AS id, (CASE WHEN i & 1 = 1 THEN 0.3 ELSE 0.7 END) * (CASE WHEN i & 2 = 2 THEN 0.5 ELSE 0.5 END) * (CASE WHEN i & 4 = 4 THEN 0.9 ELSE 0.1 END) * (CASE WHEN i & 8 = 8 THEN 0.25 ELSE 0.75 END) AS p FROM (SELECT unnest(range(16)) AS i))
 SELECT id::BIGINT AS assignment, round(p::DOUBLE / (SELECT sum(p) FROM a)::DOUBLE, 6) AS weight FROM a"""
)
def scenario_weights(spark: SparkSession, d: str) -> DataFrame:
    return rounded(st.assignment_weights(spark, [0.3, 0.5, 0.9, 0.25]))


# Bigram graph of part brands within orders.
_G = """eg AS (SELECT src, dst, count(*)::DOUBLE AS weight FROM (SELECT substr(tok, 7) AS src, lead(substr(tok, 7)) OVER (PARTITION BY tablet ORDER BY pos) AS dst FROM pb) WHERE dst IS NOT NULL GROUP BY ALL HAVING count(*) >= 2)"""


def _graph(spark: SparkSession, d: str) -> DataFrame:
    t = src.part_baskets(spark, d).withColumn("tok", F.substring("tok", 7, 99))
    return ng.bigrams(t).where("f >= 2").select(F.col("tok").alias("src"), F.col("nxt").alias("dst"), F.col("f").cast("double").alias("weight"))


_N = "nn AS (SELECT src AS node FROM eg UNION SELECT dst FROM eg)"


@query(f"WITH {_G}, {_N}, c AS (SELECT count(*) - 1 AS n FROM nn) SELECT node, round(coalesce(i, 0) / n::DOUBLE, 6) AS in_degree, round(coalesce(o, 0) / n::DOUBLE, 6) AS out_degree, coalesce(st, 0)::DOUBLE AS strength FROM nn LEFT JOIN (SELECT src AS node, count(*) AS o, sum(weight) AS st FROM eg GROUP BY 1) USING (node) LEFT JOIN (SELECT dst AS node, count(*) AS i FROM eg GROUP BY 1) USING (node), c", "pb")
def degree_centrality(spark: SparkSession, d: str) -> DataFrame:
    return rounded(gr.degrees(_graph(spark, d)))


def _ranks(rounds: int) -> str:
    parts = ["r0 AS (SELECT node, 1.0::DOUBLE / (SELECT count(*) FROM nn) AS rank FROM nn)"]
    for k in range(rounds):
        parts.append(
            f"r{k + 1} AS (SELECT nn.node, 0.15 / c.n + 0.85 * (coalesce(g.got, 0) + l.lost / c.n) AS rank FROM nn LEFT JOIN (SELECT dst, sum(weight / total * rank) AS got FROM eg JOIN ot USING (src) JOIN r{k} ON r{k}.node = eg.src GROUP BY dst) g ON g.dst = nn.node, (SELECT coalesce(sum(rank), 0) AS lost FROM r{k} WHERE node NOT IN (SELECT src FROM eg)) l, (SELECT count(*)::DOUBLE AS n FROM nn) c)"
        )
    return "ot AS (SELECT src, sum(weight) AS total FROM eg GROUP BY src), " + ", ".join(parts)


@query(f"WITH {_G}, {_N}, {_ranks(6)} SELECT node, round(rank, 6) AS rank FROM r6", "pb")
def pagerank_brands(spark: SparkSession, d: str) -> DataFrame:
    return rounded(gr.pagerank(_graph(spark, d), 6))


def _hits(rounds: int) -> str:
    parts = ["h0 AS (SELECT node, 1.0::DOUBLE AS hub FROM nn)"]
    for k in range(rounds):
        parts.append(f"a{k + 1} AS (SELECT dst AS node, sum(weight * hub) / sum(sum(weight * hub)) OVER () AS authority FROM eg JOIN h{k} ON node = src GROUP BY dst)")
        parts.append(f"h{k + 1} AS (SELECT src AS node, sum(weight * authority) / sum(sum(weight * authority)) OVER () AS hub FROM eg JOIN a{k + 1} ON node = dst GROUP BY src)")
    return ", ".join(parts)


@query(f"WITH {_G}, {_N}, {_hits(3)} SELECT node, round(coalesce(hub, 0), 6) AS hub, round(coalesce(authority, 0), 6) AS authority FROM nn LEFT JOIN h3 USING (node) LEFT JOIN a3 USING (node)", "pb")
def hits_brands(spark: SparkSession, d: str) -> DataFrame:
    return rounded(gr.hits(_graph(spark, d), 3))


@query()
def path_centrality(spark: SparkSession, d: str) -> DataFrame:
    return gr.paths(_graph(spark, d).withColumn("grp", F.lit("brands")))


@query(
    """WITH bg AS (SELECT tok, nxt, count(*) AS f FROM (SELECT tok, lead(tok) OVER (PARTITION BY tablet ORDER BY pos) AS nxt FROM dw) WHERE nxt IS NOT NULL GROUP BY ALL), u AS (SELECT tok, count(*) AS c FROM dw GROUP BY tok), z AS (SELECT (SELECT sum(f)::DOUBLE FROM bg) AS nb, (SELECT sum(c)::DOUBLE FROM u) AS nu),
 o AS (SELECT bg.tok AS node, max(ln((f / nb) / ((a.c / nu) * (b.c / nu)))) AS top, any_value(a.c) AS n FROM bg JOIN u a ON a.tok = bg.tok JOIN u b ON b.tok = nxt, z WHERE f >= 2 GROUP BY 1)
 SELECT node, round(top, 6) AS top, n FROM o WHERE top > 2 * (SELECT avg(top) FROM o) AND n < (SELECT quantile_cont(n, 0.5) FROM o)""",
    "dw",
)
def determinative_candidates(spark: SparkSession, d: str) -> DataFrame:
    t = src.doc_words(spark, d, following=True)
    own = ng.pmi_edges(t, 2).groupBy(F.col("src").alias("node")).agg(F.max("pmi").alias("top"))
    own = own.join(t.groupBy(F.col("tok").alias("node")).agg(F.count("*").alias("n")), "node")
    return rounded(gr.outliers(own, "top", "n"))


_SH = """sa AS (SELECT stratum, tok AS node, count(*)::DOUBLE / sum(count(*)) OVER (PARTITION BY stratum) AS v FROM pb GROUP BY stratum, tok), sb AS (SELECT coalesce(a.node, b.node) AS node, coalesce(a.v, 0) AS o, coalesce(b.v, 0) AS n FROM (SELECT * FROM sa WHERE stratum = 'pre') a FULL JOIN (SELECT * FROM sa WHERE stratum = 'post') b ON a.node = b.node)"""


@query(f'WITH {_SH} SELECT node, round(o, 6) AS "old", round(n, 6) AS "new", round(n - o, 6) AS delta, abs(n - o) > (SELECT stddev_pop(n - o) FROM sb) AS candidate FROM sb', "pb")
def diachronic_shift(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    c = src.part_baskets(spark, d).groupBy("stratum", F.col("tok").alias("node")).agg(F.count("*").alias("f"))
    c = c.withColumn("v", F.col("f") / F.sum("f").over(Window.partitionBy("stratum")))
    return rounded(gr.shift(c.where("stratum = 'pre'"), c.where("stratum = 'post'"), "v"))


@query(f"WITH {_G}, tw AS (SELECT x.src AS a, y.dst AS c FROM eg x JOIN eg y ON x.dst = y.src WHERE x.src <> y.dst) SELECT a, count(*) AS compositions, count(d.src) AS closed FROM tw LEFT JOIN eg d ON d.src = a AND d.dst = c GROUP BY a", "pb")
def triangle_closure(spark: SparkSession, d: str) -> DataFrame:
    return gr.closure(_graph(spark, d))
