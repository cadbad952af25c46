"""Queries on fingerprints, candidates and the sides of tablets. A tablet is an order; its first three parts are side a."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.functions.stats import rounded
from seqloom.operators import profiles as pr
from seqloom.plans.registry import h, query
from seqloom.sources import adapters as src

_SD = "sd AS (SELECT tablet, stratum, tok, pos, CASE WHEN pos < 3 THEN 'a' ELSE 'b' END AS side FROM pb)"


def _sided(spark: SparkSession, d: str) -> DataFrame:
    own = src.part_baskets(spark, d)
    return own.select("tablet", "stratum", "tok", "pos", F.when(F.col("pos") < 3, "a").otherwise("b").alias("side"), (F.col("pos") == 0).alias("boundary"))


def _finger(t: str, p: str = "") -> str:
    """Fingerprints of table t, with names that begin with p."""
    return f"""{p}fq AS (SELECT tok, count(*) AS frequency, count(*) FILTER (WHERE pos = 0) AS edges FROM {t} GROUP BY tok), {p}tt AS (SELECT sum(frequency)::DOUBLE AS n, count(*) AS types FROM {p}fq),
 {p}bg AS (SELECT tok, nxt, count(*) AS f FROM (SELECT tok, lead(tok) OVER (PARTITION BY tablet ORDER BY pos) AS nxt FROM {t}) WHERE nxt IS NOT NULL GROUP BY ALL),
 {p}af AS (SELECT tok, count(*) AS succ FROM {p}bg GROUP BY tok), {p}be AS (SELECT nxt AS tok, count(*) AS pred, {h()} AS h_pred FROM {p}bg GROUP BY nxt),
 {p}ne AS (SELECT tok, count(*) AS near FROM (SELECT tok, nxt FROM {p}bg UNION SELECT nxt, tok FROM {p}bg) GROUP BY tok),
 {p}pl AS (SELECT tok, least(floor((row_number() OVER w - 1)::DOUBLE / greatest(count(*) OVER (PARTITION BY tablet, side) - 1, 1) * 10), 9) AS bin FROM {t} WINDOW w AS (PARTITION BY tablet, side ORDER BY pos)),
 {p}pe AS (SELECT tok, {h(base="10")} AS positional_entropy FROM (SELECT tok, bin, count(*) AS f FROM {p}pl GROUP BY ALL) GROUP BY tok),
 {p}ft AS (SELECT tok, frequency, positional_entropy, coalesce(near, 0) / frequency::DOUBLE AS neighbor_diversity, frequency / n AS own_frequency, coalesce(greatest(0, least(1, 1 - h_pred / log2(greatest(types, 2)))), 0)::DOUBLE AS slot_predictability,
  edges / frequency::DOUBLE AS passage_anchor_score, coalesce((coalesce(succ, 0) - coalesce(pred, 0)) / nullif(coalesce(succ, 0) + coalesce(pred, 0), 0)::DOUBLE, 0) AS direction_skew
  FROM {p}fq LEFT JOIN {p}ne USING (tok) LEFT JOIN {p}af USING (tok) LEFT JOIN {p}be USING (tok) LEFT JOIN {p}pe USING (tok), {p}tt WHERE frequency >= 5)"""


def _cuts(p: str = "") -> str:
    return f"""{p}th AS (SELECT quantile_cont(neighbor_diversity, 0.5) AS median_neighbor_diversity, quantile_cont(positional_entropy, 0.5) AS median_positional_entropy, quantile_cont(slot_predictability, 0.5) AS median_slot_predictability,
 quantile_cont(own_frequency, 0.75) AS freq_hi, greatest(coalesce(quantile_cont(abs(direction_skew), 0.9) FILTER (WHERE frequency >= 10), 1 / 3), 1 / 3) AS dirskew_hi FROM {p}ft)"""


def _roles(t: str, p: str = "") -> str:
    return f"""{_finger(t, p)}, {_cuts(p)}, {p}k AS (SELECT *, CASE WHEN abs(direction_skew) >= dirskew_hi AND frequency >= 10 THEN 'determinative' WHEN own_frequency >= freq_hi AND slot_predictability > median_slot_predictability AND positional_entropy < median_positional_entropy THEN 'particle'
 WHEN positional_entropy > median_positional_entropy AND slot_predictability < median_slot_predictability THEN 'logogram' ELSE 'default' END AS k FROM {p}ft, {p}th),
 {p}ro AS (SELECT tok, CASE k WHEN 'logogram' THEN 'logogram' WHEN 'default' THEN 'phonetic' ELSE 'taxogram' END AS role, CASE WHEN passage_anchor_score >= 0.5 THEN 'anchor' WHEN k IN ('determinative', 'particle') THEN k END AS subtype,
 CASE WHEN k = 'determinative' THEN k || CASE WHEN direction_skew > 0 THEN ':proclitic' ELSE ':postclitic' END ELSE k END || CASE WHEN passage_anchor_score >= 0.5 THEN '+anchor' ELSE '' END AS rule FROM {p}k)"""


_FEATURES = ("positional_entropy", "neighbor_diversity", "own_frequency", "slot_predictability", "passage_anchor_score", "direction_skew")


@query(f"WITH {_SD}, {_finger('sd')} SELECT tok, frequency, {', '.join(f'round({c}, 6) AS {c}' for c in _FEATURES)} FROM ft", "pb")
def fingerprint_features(spark: SparkSession, d: str) -> DataFrame:
    return rounded(pr.fingerprint(_sided(spark, d), ["tablet", "side"]).drop("betweenness", "pagerank"))


@query(f"WITH {_SD}, {_finger('sd')}, {_cuts()} SELECT round(median_neighbor_diversity, 6) AS median_neighbor_diversity, round(median_positional_entropy, 6) AS median_positional_entropy, round(median_slot_predictability, 6) AS median_slot_predictability, round(freq_hi, 6) AS freq_hi, round(dirskew_hi, 6) AS dirskew_hi FROM th", "pb")
def fingerprint_thresholds(spark: SparkSession, d: str) -> DataFrame:
    return rounded(pr.thresholds(pr.fingerprint(_sided(spark, d), ["tablet", "side"])).drop("mean_betweenness"))


@query(f"WITH {_SD}, {_roles('sd')} SELECT tok, role, subtype, rule FROM ro", "pb")
def fingerprint_assigned(spark: SparkSession, d: str) -> DataFrame:
    return pr.assigned(pr.fingerprint(_sided(spark, d), ["tablet", "side"]))


@query(
    f"""WITH {_SD}, s1 AS (SELECT * FROM sd WHERE stratum = 'pre'), s2 AS (SELECT * FROM sd WHERE stratum = 'post'), {_roles('s1', 'a')}, {_roles('s2', 'b')}
 SELECT count(*) AS shared, count(*) FILTER (WHERE aro.role = bro.role) AS stable, round(avg((aro.role = bro.role)::INT::DOUBLE), 6) AS stability, coalesce(list(tok ORDER BY tok) FILTER (WHERE aro.role <> bro.role), []) AS changed FROM aro JOIN bro USING (tok)""",
    "pb",
)
def fingerprint_stability(spark: SparkSession, d: str) -> DataFrame:
    own = _sided(spark, d)
    by = [pr.assigned(pr.fingerprint(own.where(F.col("stratum") == s), ["tablet", "side"])) for s in ("pre", "post")]
    return rounded(pr.role_stability(*by))


@query(f"WITH {_SD}, {_finger('sd')} SELECT tok, frequency AS n, round(positional_entropy, 6) AS h FROM fq JOIN pe USING (tok)", "pb")
def positional_entropy_line(spark: SparkSession, d: str) -> DataFrame:
    return rounded(pr.place_entropy(_sided(spark, d), "tablet", "side"))


# Candidates: early orders are the focus and the tablet, first places its section; brands by their last digit are in a table.
_CAND = f"""bn AS (SELECT tok, least(floor(pos::DOUBLE / greatest(count(*) OVER (PARTITION BY tablet) - 1, 1) * 10), 9) AS bin FROM pb), hh AS (SELECT tok, sum(f) AS n, {h()} AS h FROM (SELECT tok, bin, count(*) AS f FROM bn GROUP BY ALL) GROUP BY tok),
 hb AS (SELECT avg(h) AS m, CASE WHEN count(*) > 1 THEN stddev_pop(h) ELSE 1 END AS s FROM hh WHERE n >= 5), ca AS (SELECT tok, count(*) AS f, count(*) FILTER (WHERE stratum = 'pre') AS a, count(*) FILTER (WHERE stratum = 'pre' AND pos = 0) AS hits FROM pb GROUP BY tok), sz AS (SELECT sum(a)::DOUBLE AS na, sum(f)::DOUBLE AS nf FROM ca),
 t1 AS (SELECT tok, CASE WHEN n >= 5 THEN 1 / (1 + exp(-(m - h) / greatest(s, 1e-9))) END AS score FROM hh, hb), t2 AS (SELECT tok, CASE WHEN na > 0 THEN coalesce(hits / nullif(a, 0)::DOUBLE, 0) END AS score FROM ca, sz),
 t4 AS (SELECT tok, CASE tok[-1] WHEN '1' THEN 0.8 WHEN '2' THEN 0.5 WHEN '3' THEN 0.2 WHEN '5' THEN 0 ELSE 0.3 END AS score FROM ca), t5 AS (SELECT tok, CASE WHEN na > 0 THEN least(1, greatest(0, (a / na / (f / nf) - 1) / 4)) END AS score FROM ca, sz)"""


def _tests(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    own = src.part_baskets(spark, d)
    early, digit = F.col("stratum") == "pre", F.substring("p_brand", -1, 1)
    level = F.when(digit == "1", "high").when(digit == "2", "medium").when(digit == "3", "low").otherwise("other")
    table = src.read(spark, d, "part").select(F.col("p_brand").alias("tok"), level.alias("confidence")).where(digit != "5").distinct()
    return {"place": pr.anchored_entropy(own), "section": pr.section_share(own, early, F.col("pos") == 0), "table": pr.tabulated(own, table), "focus": pr.focus_share(own, early)}


@query(f"WITH {_CAND} SELECT t1.tok, round(t1.score, 6) AS place, round(t2.score, 6) AS section, round(t4.score::DOUBLE, 6) AS listed, round(t5.score::DOUBLE, 6) AS focus FROM t1 JOIN t2 USING (tok) JOIN t4 USING (tok) JOIN t5 USING (tok)", "pb")
def candidate_tests(spark: SparkSession, d: str) -> DataFrame:
    own = _tests(spark, d)
    out = own["place"].withColumnRenamed("score", "place")
    for name, as_ in (("section", "section"), ("table", "listed"), ("focus", "focus")):
        out = out.join(own[name].select("tok", F.col("score").alias(as_)), "tok")
    return rounded(out)


@query(f"WITH {_CAND} SELECT tok, count(*) FILTER (WHERE score > 0.5) AS flags, round(coalesce(avg(score::DOUBLE), 0), 6) AS overall FROM (FROM t1 UNION ALL FROM t2 UNION ALL FROM t4 UNION ALL FROM t5) GROUP BY tok HAVING count(*) FILTER (WHERE score > 0.5) >= 1", "pb")
def candidate_scores(spark: SparkSession, d: str) -> DataFrame:
    return rounded(pr.combined(_tests(spark, d), 1))


_EDGE = """eg AS (SELECT tok, avg((i < greatest(1, floor(n * 0.15::DOUBLE)) OR i >= n - floor(n * 0.15::DOUBLE))::INT::DOUBLE) AS edge_fraction, count(*) AS n FROM (SELECT tok, row_number() OVER (PARTITION BY tablet, side ORDER BY pos) - 1 AS i, count(*) OVER (PARTITION BY tablet, side) AS n FROM {t}) GROUP BY tok)"""


@query(f"WITH {_SD}, {_EDGE.format(t='sd')} SELECT tok, n, round(edge_fraction, 6) AS edge_fraction FROM eg", "pb")
def line_edges(spark: SparkSession, d: str) -> DataFrame:
    return rounded(pr.edge_share(_sided(spark, d), "tablet", "side"))


_MARKS = ("Brand#1", "Brand#2")
_NEAR = "greatest(coalesce(max((tok = '{m}')::INT) OVER (PARTITION BY tablet ORDER BY pos ROWS BETWEEN 8 PRECEDING AND 1 PRECEDING), 0), coalesce(max((tok = '{m}')::INT) OVER (PARTITION BY tablet ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND 8 FOLLOWING), 0))"


@query(
    f"""WITH {_SD}, {_EDGE.format(t='sd')}, ca AS (SELECT tok, count(*) AS f, count(*) FILTER (WHERE stratum = 'pre') AS a FROM sd GROUP BY tok), sz AS (SELECT sum(a) AS na, sum(f) AS nf FROM ca),
 sp AS (SELECT tok, f, round(1000 * (a / greatest(na, 1)::DOUBLE) / greatest(1000 * ((f - a) / greatest(nf - na, 1)::DOUBLE), 0.001), 3) AS specificity FROM ca, sz WHERE f >= 3),
 ky AS (SELECT DISTINCT tok FROM sd JOIN orders ON o_orderkey = tablet WHERE o_totalprice > 499900), co AS (SELECT tok, greatest(avg(x::DOUBLE), avg(y::DOUBLE)) AS company FROM (SELECT tok, {_NEAR.format(m=_MARKS[0])} AS x, {_NEAR.format(m=_MARKS[1])} AS y FROM sd) GROUP BY tok),
 sc AS (SELECT sp.tok, f AS n, specificity, ky.tok IS NOT NULL AS in_key, round(edge_fraction, 4) AS edge_fraction, company FROM sp JOIN eg USING (tok) JOIN co USING (tok) LEFT JOIN ky USING (tok)),
 cf AS (SELECT *, round(0.3::DOUBLE * least(specificity / 5, 1) + 0.3::DOUBLE * in_key::INT + 0.2::DOUBLE * edge_fraction + 0.2::DOUBLE * company, 4) AS confidence FROM sc)
 SELECT tok, n, round(specificity, 6) AS specificity, in_key, round(edge_fraction, 6) AS edge_fraction, round(company, 6) AS company, confidence, CASE WHEN confidence >= 0.55 THEN 'strong' WHEN confidence >= 0.4 THEN 'moderate' ELSE 'weak' END AS verdict FROM cf""",
    "pb",
)
def logogram_candidates(spark: SparkSession, d: str) -> DataFrame:
    own = _sided(spark, d)
    orders = src.read(spark, d, "orders").select(F.col("o_orderkey").alias("tablet"), (F.col("o_totalprice") > 499900).alias("key"))
    passages = own.join(orders.where("key"), "tablet").groupBy("tablet").agg(F.collect_list("tok").alias("canonical")).withColumn("key", F.lit(True))
    return rounded(pr.logograms(own, F.col("stratum") == "pre", ["tablet", "side"], list(_MARKS), passages))


# The tables with side b first, and of passages between sides.
_BA = "ba AS (SELECT tablet, side, tok, row_number() OVER (PARTITION BY tablet ORDER BY (side <> 'b')::INT, side, pos) - 1 AS pos FROM sd)"
_CROSS = """{p}y AS (SELECT tablet, tok, side, lead(tok) OVER w AS nxt, lead(side) OVER w AS nside FROM {t} WINDOW w AS (PARTITION BY tablet ORDER BY pos)),
 {p} AS (SELECT tablet, 0 AS pos, tok FROM {p}y WHERE nside <> side UNION ALL SELECT tablet, 1, nxt FROM {p}y WHERE nside <> side)"""


def _loo(name: str, t: str, order: int = 2) -> str:
    """A table (tablet, n, ppl) of tablets under a model of all others."""
    lags = " || ' ' || ".join(f"coalesce(lag(tok, {k}) OVER (PARTITION BY tablet ORDER BY pos), '<s>')" for k in range(order - 1, 0, -1))
    return f"""{name}e AS (SELECT tablet, tok, {lags} AS c FROM (SELECT tablet, pos, tok FROM {t} UNION ALL SELECT tablet, count(*), '</s>' FROM {t} GROUP BY tablet)), {name}m AS (SELECT tablet, c, tok, count(*) AS m FROM {name}e GROUP BY ALL),
 {name}f AS (SELECT c, tok, sum(m)::BIGINT AS f FROM {name}m GROUP BY ALL), {name}t AS (SELECT c, sum(f)::BIGINT AS t FROM {name}f GROUP BY c), {name}o AS (SELECT tablet, c, sum(m)::BIGINT AS mt FROM {name}m GROUP BY ALL), {name}v AS (SELECT count(DISTINCT tok) + 2 AS v FROM {t}),
 {name} AS (SELECT tablet, sum(m)::BIGINT AS n, pow(2, -sum(m * log2((f - m + 0.5) / (t - mt + 0.5 * v))) / sum(m)) AS ppl FROM {name}m JOIN {name}f USING (c, tok) JOIN {name}t USING (c) JOIN {name}o USING (tablet, c), {name}v GROUP BY tablet)"""


_POOL = "pow(2, sum(n * log2(ppl)) / sum(n))"
_WIN = "CASE WHEN round(ppl_ab, 9) < round(ppl_ba, 9) THEN 'ab' ELSE 'ba' END"


@query(f"WITH {_SD}, {_BA}, {_loo('p', 'sd')}, {_loo('q', 'ba')}, j AS (SELECT tablet, p.n, p.ppl AS ppl_ab, q.ppl AS ppl_ba FROM p JOIN q USING (tablet)) SELECT tablet, n, round(ppl_ab, 6) AS ppl_ab, round(ppl_ba, 6) AS ppl_ba, {_WIN} AS winner, round(abs(ppl_ab - ppl_ba), 6) AS margin FROM j", "pb")
def side_order_by_tablet(spark: SparkSession, d: str) -> DataFrame:
    return rounded(pr.side_order(_sided(spark, d)))


@query(
    f"""WITH {_SD}, {_BA}, {_loo('p', 'sd')}, {_loo('q', 'ba')}, {_loo('r', 'sd', 3)}, {_loo('s', 'ba', 3)}, j AS (SELECT 2 AS n, (SELECT {_POOL} FROM p) AS ppl_ab, (SELECT {_POOL} FROM q) AS ppl_ba UNION ALL SELECT 3, (SELECT {_POOL} FROM r), (SELECT {_POOL} FROM s))
 SELECT n, round(ppl_ab, 6) AS ppl_ab, round(ppl_ba, 6) AS ppl_ba, {_WIN} AS prefers FROM j""",
    "pb",
)
def side_order_votes(spark: SparkSession, d: str) -> DataFrame:
    return rounded(pr.side_votes(_sided(spark, d)))


@query(
    f"""WITH {_SD}, {_BA}, {_CROSS.format(p='xa', t='sd')}, {_CROSS.format(p='xb', t='ba')}, {_loo('p', 'xa')}, {_loo('q', 'xb')}, j AS (SELECT (SELECT count(*) FROM p) AS n, (SELECT {_POOL} FROM p) AS ppl_ab, (SELECT {_POOL} FROM q) AS ppl_ba)
 SELECT n, round(ppl_ab, 6) AS ppl_ab, round(ppl_ba, 6) AS ppl_ba, {_WIN} AS prefers, CASE WHEN abs(ppl_ab - ppl_ba) > 1 THEN 'strong' WHEN abs(ppl_ab - ppl_ba) > 0.1 THEN 'moderate' ELSE 'weak' END AS strength FROM j WHERE n >= 10""",
    "pb",
)
def side_order_crossings(spark: SparkSession, d: str) -> DataFrame:
    return rounded(pr.crossing_order(_sided(spark, d)))


@query(
    f"""WITH {_SD}, c AS (SELECT tablet, side, tok, count(*) AS f FROM sd GROUP BY ALL), bo AS (SELECT tablet FROM c GROUP BY tablet HAVING count(DISTINCT side) = 2), a AS (SELECT tablet, tok AS x, f AS fa FROM c JOIN bo USING (tablet) WHERE side = 'a'), b AS (SELECT tablet, tok AS y, f AS fb FROM c JOIN bo USING (tablet) WHERE side = 'b'),
 jo AS (SELECT x, y, sum(fa * fb)::DOUBLE AS f FROM a JOIN b USING (tablet) GROUP BY ALL), pa AS (SELECT x, sum(fa) AS f FROM a GROUP BY x), pb2 AS (SELECT y, sum(fb) AS f FROM b GROUP BY y), ha AS (SELECT {h()} AS h_a, sum(f)::DOUBLE AS na FROM pa), hb AS (SELECT {h()} AS h_b, sum(f)::DOUBLE AS nb FROM pb2), nj AS (SELECT sum(f) AS nf FROM jo),
 m AS (SELECT h_a, h_b, sum(jo.f / nf * log2(jo.f / nf / (pa.f / na * (pb2.f / nb)))) AS mi FROM jo JOIN pa USING (x) JOIN pb2 USING (y), ha, hb, nj GROUP BY ALL)
 SELECT round(mi, 6) AS mi, round(h_a, 6) AS h_a, round(h_b, 6) AS h_b, round(mi / ((h_a + h_b) / 2), 6) AS nmi, (SELECT count(*) FROM bo) AS tablets FROM m""",
    "pb",
)
def side_information(spark: SparkSession, d: str) -> DataFrame:
    return rounded(pr.side_information(_sided(spark, d)))
