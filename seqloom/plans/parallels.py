"""Queries on passages and pairs of places. A passage is a customer, its attestations the orders, their forms the parts' brands."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.functions import codes as co
from seqloom.functions.stats import rounded
from seqloom.operators import contingency as con
from seqloom.operators import ngrams as ng
from seqloom.operators import parallels as pa
from seqloom.plans.contrasts import _contrast
from seqloom.plans.registry import h, query
from seqloom.plans.scalars import _CODE, _codes
from seqloom.sources import adapters as src
from seqloom.sources.storage import cut

_FM = """fm AS (SELECT o_custkey AS passage, tablet, min(stratum) AS stratum, list(substr(tok, 7, 1) ORDER BY pos) AS form FROM pb JOIN orders ON o_orderkey = tablet GROUP BY tablet, o_custkey),
 cn AS (SELECT passage, arg_min(form, (-len(form), tablet)) AS canonical FROM fm GROUP BY passage), sl AS (SELECT passage, ix - 1 AS ix, canonical[ix] AS tok FROM (SELECT *, unnest(range(1, len(canonical) + 1)) AS ix FROM cn)),
 ce AS (SELECT passage, tablet, ix - 1 AS ix, form[ix] AS own FROM (SELECT *, unnest(range(1, len(form) + 1)) AS ix FROM fm)), tk AS (SELECT tablet, ix AS pos, own AS tok FROM ce)"""


def _tokens(spark: SparkSession, d: str) -> DataFrame:
    return src.part_baskets(spark, d).withColumn("tok", F.substring("tok", 7, 1))


def _forms(spark: SparkSession, d: str) -> DataFrame:
    own = _tokens(spark, d).groupBy("tablet").agg(F.array_sort(F.collect_list(F.struct("pos", "tok"))).alias("f"))
    passage = src.read(spark, d, "orders").select(F.col("o_orderkey").alias("tablet"), F.col("o_custkey").alias("passage"))
    return own.join(passage, "tablet").select("passage", "tablet", F.col("tablet").alias("ord"), F.lit(0).alias("start"), F.transform("f", lambda x: x["tok"]).alias("form"))


def _canonical(forms: DataFrame) -> DataFrame:
    return forms.groupBy("passage").agg(F.min_by("form", F.struct(-F.size("form"), "ord")).alias("canonical"))


_MM = "mm AS (SELECT tok, count(*) AS covered, count(*) FILTER (WHERE own <> tok) AS other, avg((own <> tok)::INT::DOUBLE) AS rate FROM sl JOIN ce USING (passage, ix) GROUP BY tok)"


@query(f"WITH {_FM}, {_MM} SELECT tok, covered, other, round(rate, 6) AS rate FROM mm", "pb")
def mismatch_rates(spark: SparkSession, d: str) -> DataFrame:
    forms = _forms(spark, d)
    return rounded(pa.mismatch_rates(forms, _canonical(forms)))


@query(
    f"""WITH {_FM}, w AS (SELECT DISTINCT passage, tok FROM sl), x AS (SELECT w.tok, w.passage, count(*) FILTER (WHERE NOT list_contains(form, w.tok)) AS absent FROM w JOIN fm USING (passage) GROUP BY ALL)
 SELECT tok, count(*) AS passages, sum(absent)::BIGINT AS absent, round(sum(absent) / count(*)::DOUBLE, 6) AS rate, count(*) < 5 AS thin FROM x GROUP BY tok""",
    "pb",
)
def absence_rates(spark: SparkSession, d: str) -> DataFrame:
    forms = _forms(spark, d)
    return rounded(pa.absence_rates(forms, _canonical(forms)))


@query(
    """WITH r AS (SELECT tablet, tok, pos::DOUBLE / greatest(count(*) OVER (PARTITION BY tablet) - 1, 1) AS rel FROM pb), m AS (SELECT tablet, tok, avg(rel) AS m FROM r GROUP BY ALL)
 SELECT tok, count(*) AS tablets, round(CASE WHEN count(*) > 1 THEN stddev_pop(m) END, 6) AS sigma, round(CASE WHEN count(*) > 1 THEN avg(m) END, 6) AS mean_place FROM m GROUP BY tok""",
    "pb",
)
def place_spread(spark: SparkSession, d: str) -> DataFrame:
    return rounded(pa.place_spread(src.part_baskets(spark, d)))


_TH = f"""ta AS (SELECT tok, CASE WHEN x < 0.33::DOUBLE THEN 0 WHEN x < 0.67::DOUBLE THEN 1 ELSE 2 END AS third FROM (SELECT tok, pos::DOUBLE / count(*) OVER (PARTITION BY tablet) AS x FROM tk)), th AS (SELECT tok, {h(base="3")} AS h FROM (SELECT tok, third, count(*) AS f FROM ta GROUP BY ALL) GROUP BY tok)"""
_RP = """rb AS (SELECT tok, nxt, count(*) AS f FROM (SELECT tok, lead(tok) OVER (PARTITION BY tablet ORDER BY pos) AS nxt FROM tk) WHERE nxt IS NOT NULL GROUP BY ALL), ru AS (SELECT tok, count(*)::DOUBLE AS u FROM tk GROUP BY tok), rn AS (SELECT (SELECT sum(f) FROM rb)::DOUBLE AS nb, (SELECT sum(u) FROM ru) AS nu),
 rm AS (SELECT rb.tok AS src, nxt AS dst, greatest(0, log2(f / nb / (a.u / nu * (b.u / nu) + 1e-12) + 1e-12)) AS m FROM rb JOIN ru a ON a.tok = rb.tok JOIN ru b ON b.tok = nxt, rn), rp AS (SELECT src, dst, coalesce(m / nullif(max(m) OVER (), 0), 0) AS mi FROM rm)"""


@query(f"WITH {_FM}, {_TH} SELECT tok, round(h, 6) AS h FROM th", "pb")
def thirds_entropy(spark: SparkSession, d: str) -> DataFrame:
    return rounded(pa.thirds_entropy(_tokens(spark, d)))


@query(f"WITH {_FM}, {_RP} SELECT src, dst, round(mi, 6) AS mi FROM rp", "pb")
def relative_pmi(spark: SparkSession, d: str) -> DataFrame:
    return rounded(pa.relative_pmi(_tokens(spark, d)))


_ST = "st AS (SELECT tok, u / nu AS p, (u / max(u) OVER ()) ** 2 AS ic, h AS place_h, coalesce(rate, 0) AS rate FROM ru JOIN th USING (tok) LEFT JOIN mm USING (tok), rn)"


@query(f"WITH {_FM}, {_MM}, {_TH}, {_RP}, {_ST} SELECT tok, round(p, 6) AS p, round(ic, 6) AS ic, round(place_h, 6) AS place_h, round(rate, 6) AS rate FROM st", "pb")
def token_stats(spark: SparkSession, d: str) -> DataFrame:
    forms = _forms(spark, d)
    return rounded(pa.token_stats(_tokens(spark, d), forms, _canonical(forms)))


_SP = """ok AS (SELECT passage FROM fm GROUP BY passage HAVING count(*) <= 100 AND count(DISTINCT tablet) <= 8), va AS (SELECT passage, ix, tok, tablet FROM ce JOIN sl USING (passage, ix) JOIN ok USING (passage) WHERE own = tok),
 pp AS (SELECT passage, ix, a.tok, a.tablet AS tablet_a, ix AS pos_a, b.tablet AS tablet_b, ix AS pos_b FROM va a JOIN va b USING (passage, ix) WHERE a.tablet < b.tablet)"""


@query(f"WITH {_FM}, {_SP} SELECT passage, ix AS slot, tok, tablet_a, pos_a, tablet_b, pos_b FROM pp", "pb")
def shared_places(spark: SparkSession, d: str) -> DataFrame:
    forms = _forms(spark, d)
    return pa.shared_places(forms, _canonical(forms)).withColumnRenamed("at", "slot")


@query(
    f"""WITH {_FM}, {_MM}, {_TH}, {_RP}, {_ST}, {_SP}, ar AS (SELECT tablet, pos, lag(tok) OVER w AS l, lead(tok) OVER w AS r FROM tk WINDOW w AS (PARTITION BY tablet ORDER BY pos)), n AS (SELECT tablet, count(*) AS n FROM tk GROUP BY tablet),
 oo AS (SELECT pp.*, b2.tok AS tok_b FROM pp JOIN tk b2 ON b2.tablet = tablet_b AND b2.pos = pos_b)
 SELECT tablet_a, pos_a, oo.tok AS tok_a, tablet_b, pos_b, tok_b, round(abs(x.ic - y.ic), 6) AS ic_gap, round(abs(x.place_h - y.place_h), 6) AS place_gap, round(abs(x.rate - y.rate), 6) AS rate_gap, round(coalesce(ml.mi, 0), 6) AS mi_left, round(coalesce(mr.mi, 0), 6) AS mi_right,
 round(least(x.p, y.p) / greatest(x.p, y.p), 6) AS ratio, 0::DOUBLE AS alike, round(abs(pos_a / greatest(na.n - 1, 1)::DOUBLE - pos_b / greatest(nb.n - 1, 1)::DOUBLE), 6) AS distance
 FROM oo JOIN st x ON x.tok = oo.tok JOIN st y ON y.tok = tok_b JOIN n na ON na.tablet = tablet_a JOIN n nb ON nb.tablet = tablet_b LEFT JOIN ar ON ar.tablet = tablet_a AND ar.pos = pos_a LEFT JOIN rp ml ON ml.src = l AND ml.dst = oo.tok LEFT JOIN rp mr ON mr.src = oo.tok AND mr.dst = r""",
    "pb",
)
def pair_features(spark: SparkSession, d: str) -> DataFrame:
    # Both are read many times over; written once, they save the join and the window behind each reading.
    tokens, forms = cut(_tokens(spark, d)), cut(_forms(spark, d))
    canonical = _canonical(forms)
    pairs = pa.shared_places(forms, canonical).select("tablet_a", "pos_a", F.col("tok").alias("tok_a"), "tablet_b", "pos_b", F.col("tok").alias("tok_b"))
    return rounded(pa.pair_features(pairs, tokens, pa.token_stats(tokens, forms, canonical), pa.relative_pmi(tokens)))


@query(
    f"""WITH {_contrast('pb', threshold=0.5)}, b AS (SELECT tok, nxt, count(*) AS f FROM (SELECT tok, lead(tok) OVER (PARTITION BY tablet ORDER BY pos) AS nxt FROM pb) WHERE nxt IS NOT NULL GROUP BY ALL)
 SELECT CASE WHEN x.lean = 'pre' THEN b.tok ELSE nxt END AS early, CASE WHEN x.lean = 'pre' THEN nxt ELSE b.tok END AS late, sum(b.f)::BIGINT AS f FROM b JOIN con x ON x.tok = b.tok JOIN con y ON y.tok = nxt WHERE (x.lean, y.lean) IN (('pre', 'post'), ('post', 'pre')) GROUP BY ALL""",
    "pb",
)
def crossed_bigrams(spark: SparkSession, d: str) -> DataFrame:
    own = src.part_baskets(spark, d)
    leans = con.contrast(own, "pre", "post", threshold=0.5)
    return pa.crossed_bigrams(own, leans.where("lean = 'pre'"), leans.where("lean = 'post'"))


@query(
    f"""WITH {_contrast('pb', threshold=0.5)}, ch AS (SELECT DISTINCT a.tok AS old, b.tok AS new FROM pb a JOIN pb b ON a.tablet = b.tablet AND b.pos = a.pos + 1 WHERE a.tok <> b.tok)
 SELECT old, new, x.lean AS old_lean, y.lean AS new_lean, CASE WHEN x.lean = 'post' OR y.lean = 'pre' THEN 'contradicts' WHEN x.lean = 'pre' OR y.lean = 'post' THEN 'supports' ELSE 'neutral' END AS evidence FROM ch LEFT JOIN con x ON x.tok = old LEFT JOIN con y ON y.tok = new""",
    "pb",
)
def corroborated_changes(spark: SparkSession, d: str) -> DataFrame:
    own = src.part_baskets(spark, d)
    changes = ng.bigrams(own).where("tok <> nxt").select(F.col("tok").alias("old"), F.col("nxt").alias("new"))
    return pa.corroborated(changes, con.contrast(own, "pre", "post", threshold=0.5))


@query("SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id, arg_max(event_type, (ts, event_id)) AS event_type FROM events GROUP BY user_id")
def last_records(spark: SparkSession, d: str) -> DataFrame:
    own = src.read(spark, d, "events").select("user_id", "event_id", "event_type", F.struct("ts", "event_id").alias("at"))
    return pa.last_records(own, "user_id", "at").drop("at")


@query(
    """WITH f AS (SELECT p_brand AS cls, list(DISTINCT p_size) AS members FROM part GROUP BY ALL), g AS (SELECT p_type AS cls, list(DISTINCT p_size) AS members FROM part GROUP BY ALL),
 j AS (SELECT f.cls, g.cls AS ref, len(list_intersect(f.members, g.members)) / len(list_distinct(f.members || g.members))::DOUBLE AS jaccard FROM f, g),
 c AS (SELECT (SELECT count(*) FROM g) AS n_reference, (SELECT count(DISTINCT ref) FROM j WHERE jaccard > 0.5) AS matched, (SELECT count(*) FROM f) AS n_found, (SELECT count(DISTINCT cls) FROM j WHERE jaccard > 0.5) AS matching), r AS (SELECT *, matched / n_reference::DOUBLE AS r, matching / n_found::DOUBLE AS p FROM c)
 SELECT n_reference, matched, n_found, matching, round(r, 6) AS recall, round(p, 6) AS precision, round(coalesce(2 * p * r / nullif(p + r, 0), 0), 6) AS f1 FROM r"""
)
def class_scores(spark: SparkSession, d: str) -> DataFrame:
    own = src.read(spark, d, "part")
    of = lambda c: own.groupBy(F.col(c).alias("cls")).agg(F.collect_set("p_size").alias("members"))
    return rounded(pa.class_scores(of("p_brand"), of("p_type")))


@query(
    f"""WITH {_FM}, ds AS (SELECT passage, ix, tablet FROM ce JOIN sl USING (passage, ix) WHERE own <> tok), s AS (SELECT passage, bit_or((1::BIGINT << ix::INT)) AS s FROM ds GROUP BY passage), ev AS (SELECT passage, tablet, bit_or(1::BIGINT << ix::INT) AS x FROM ds GROUP BY ALL),
 v AS (SELECT passage, s, CASE stratum WHEN 'pre' THEN 0 ELSE coalesce(ev.x, 0) END AS x FROM s JOIN fm USING (passage) LEFT JOIN ev USING (passage, tablet))
 SELECT passage, s, count(*) FILTER (WHERE x = 0) AS early, count(*) FILTER (WHERE x = s) AS late, bool_and((x | s) = (xor(x, s) | s)) AS holds FROM v GROUP BY passage, s""",
    "pb",
)
def change_periods(spark: SparkSession, d: str) -> DataFrame:
    forms = _forms(spark, d)
    cells = forms.select("passage", "tablet", F.posexplode("form").alias("at", "own")).join(pa.slots(_canonical(forms)), ["passage", "at"]).where("own <> tok")
    late = cells.groupBy("passage", "tablet").agg(F.collect_list("at").alias("late"))
    stratum = src.part_baskets(spark, d).groupBy("tablet").agg(F.min("stratum").alias("own"))
    tablets = forms.select("passage", "tablet").join(late, ["passage", "tablet"], "left").join(stratum, "tablet")
    tablets = tablets.select("passage", "tablet", F.when(F.col("own") == "pre", "pre").otherwise("undated").alias("stratum"), F.coalesce("late", F.array().cast("array<int>")).alias("late"))
    return pa.change_periods(cells, tablets)


@query(
    f"""WITH c AS (SELECT p_size AS tablet, {_CODE} AS code FROM part) SELECT code, count(*) AS occurrences, count(DISTINCT tablet) AS tablets, count(*) >= 3 AND count(DISTINCT tablet) >= 2 AS structural FROM c WHERE regexp_matches(code, '[:.\\-();]') GROUP BY code"""
)
def recurrent_compounds(spark: SparkSession, d: str) -> DataFrame:
    return pa.recurrent(_codes(spark, d).select(F.col("p_size").alias("tablet"), "code"))


@query(
    f"""WITH c AS (SELECT p_partkey, {_CODE} AS code FROM part) SELECT p_partkey, CASE WHEN code IN ('', '?', '_') OR regexp_matches(code, '[-.:;(]') THEN NULL ELSE lpad(nullif(regexp_extract(code, '^[0-9]{{1,3}}'), ''), 3, '0') END AS base FROM c"""
)
def canonical_base(spark: SparkSession, d: str) -> DataFrame:
    return _codes(spark, d).select("p_partkey", co.canonical_base(F.col("code")).alias("base"))
