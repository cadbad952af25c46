"""Queries on assignments, typologies, sums of models and line scenarios."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.functions.stats import rounded
from seqloom.operators import contingency as con
from seqloom.operators import information as info
from seqloom.operators import language_models as lm
from seqloom.operators import ngrams as ng
from seqloom.operators import profiles as pr
from seqloom.operators import search as se
from seqloom.operators import structural as st
from seqloom.plans.features import _Q, _terms
from seqloom.plans.models import _ALPHA, _model
from seqloom.plans.registry import h, query
from seqloom.plans.statistics import _PMI
from seqloom.plans.structures import _TT, _W, _truth
from seqloom.sources import adapters as src


@query(
    f"""WITH {_Q} SELECT 'field' AS kind, i, NULL AS j, round(sum(h), 6) AS value FROM (SELECT i, -q / 2 AS h FROM qu WHERE i = j UNION ALL SELECT i, -q / 4 FROM qu WHERE i <> j UNION ALL SELECT j, -q / 4 FROM qu WHERE i <> j) GROUP BY i
 UNION ALL SELECT 'coupling', i, j, round(q / 4, 6) FROM qu WHERE i <> j UNION ALL SELECT 'offset', NULL, NULL, round(sum(CASE WHEN i = j THEN q / 2 ELSE q / 4 END), 6) FROM qu""",
    "ue",
    "eb",
)
def ising_model(spark: SparkSession, d: str) -> DataFrame:
    return rounded(se.ising_model(_terms(spark, d)))


# A read is a user; a sign is an event type, its values the parities of the number of such events.
_RD = """rd AS (SELECT user_id AS read, 1 + user_id % 3 AS occurrences, event_type AS sign, v AS value, v AS k, (n % 2 = v)::INT AS x FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL), (SELECT unnest([0, 1]) AS v)),
 sm AS (SELECT sign, value, k, x FROM rd WHERE read = (SELECT min(read) FROM rd))"""


def _reads(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    c = src.read(spark, d, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    own = c.select(F.col("user_id").alias("read"), (1 + F.col("user_id") % 3).alias("occurrences"), F.col("event_type").alias("sign"), "n", F.explode(F.array(F.lit(0), F.lit(1))).alias("value"))
    own = own.withColumn("k", F.col("value")).withColumn("x", (F.col("n") % 2 == F.col("value")).cast("int"))
    least = own.agg(F.min("read").alias("least"))
    return own.crossJoin(F.broadcast(least)).where("read = least").select("sign", "k", "value", "x"), own


@query(
    f"""WITH {_RD}, ch AS (SELECT sign, arg_min(value, ((x <> 1)::INT, k)) AS value FROM sm GROUP BY sign), ts AS (SELECT sum(occurrences) AS total FROM (SELECT DISTINCT read, occurrences FROM rd)), o AS (SELECT sign, value, sum(occurrences) AS n FROM rd WHERE x = 1 GROUP BY ALL)
 SELECT sign, value, round(coalesce(n, 0) / total::DOUBLE, 6) AS confidence FROM ch LEFT JOIN o USING (sign, value), ts"""
)
def choice_confidence(spark: SparkSession, d: str) -> DataFrame:
    return rounded(se.choice_confidence(*_reads(spark, d)))


_ICH = f"""c AS (SELECT tok, count(*)::DOUBLE AS f FROM pb GROUP BY tok), hh AS (SELECT tok, {h(base="10")} AS place_h FROM (SELECT tok, bin, count(*) AS f FROM (SELECT tok, least(floor(pos::DOUBLE / greatest(count(*) OVER (PARTITION BY tablet) - 1, 1) * 10), 9) AS bin FROM pb) GROUP BY ALL) GROUP BY tok),
 ih AS (SELECT tok, (f / max(f) OVER ()) ** 2 AS ic, place_h, f FROM c JOIN hh USING (tok))"""


def _ic_place(spark: SparkSession, d: str) -> DataFrame:
    own = src.part_baskets(spark, d)
    return info.ic_contributions(own).join(pr.place_entropy(own, "tablet").select("tok", F.col("h").alias("place_h")), "tok").select("tok", F.col("relative").alias("ic"), "place_h", "f")


@query(f"WITH {_ICH} SELECT tok, round(ic * (1 + (1 - place_h / max(place_h) OVER ())), 6) AS priority FROM ih", "pb")
def decoding_priority(spark: SparkSession, d: str) -> DataFrame:
    return rounded(se.priorities(_ic_place(spark, d)))


_TY = f"{_ICH}, ty AS (SELECT tok, f, ic AS p1, 1 - ic AS p0 FROM ih), cl AS (SELECT (coalesce(avg(f) FILTER (WHERE p1 > p0), 0) > coalesce(avg(f) FILTER (WHERE p1 <= p0), 0))::INT AS k FROM ty)"
_KIND = "CASE WHEN greatest(p0, p1) < {t} THEN 'unresolved' WHEN (p1 > p0)::INT = k THEN 'phonogram' ELSE 'logogram' END"


def _posteriors(spark: SparkSession, d: str) -> DataFrame:
    return _ic_place(spark, d).select("tok", F.col("f").alias("frequency"), (1 - F.col("ic")).alias("p0"), F.col("ic").alias("p1"))


@query(f"WITH {_TY} SELECT tok, {_KIND.format(t=0.8)} AS type FROM ty, cl", "pb")
def typology_assigned(spark: SparkSession, d: str) -> DataFrame:
    return se.typed(_posteriors(spark, d), 0.8)


@query(
    f"""WITH {_TY}, b AS (SELECT tok, p0, p1, k, t, {_KIND.format(t=0.6)} AS base, {_KIND.format(t='t')} AS type FROM ty, cl, (SELECT unnest([0.6, 0.7, 0.9]) AS t))
 SELECT t::DOUBLE AS threshold, count(*) FILTER (WHERE type = 'phonogram') AS n_phonogram, count(*) FILTER (WHERE type = 'logogram') AS n_logogram, count(*) FILTER (WHERE type = 'unresolved') AS n_unresolved, coalesce(avg((type = base)::INT::DOUBLE) FILTER (WHERE type <> 'unresolved' AND base <> 'unresolved'), 1) AS agreement FROM b GROUP BY t""",
    "pb",
)
def typology_sweep(spark: SparkSession, d: str) -> DataFrame:
    return rounded(se.threshold_sweep(_posteriors(spark, d), [0.6, 0.7, 0.9]))


@query(f"WITH {_TT}, {_W} SELECT s, w, (w < 0)::INT AS constant, round((abs(w) + 64) / 128.0, 6) AS agreement FROM w ORDER BY abs(w) DESC, s LIMIT 1")
def best_affine(spark: SparkSession, d: str) -> DataFrame:
    return rounded(st.best_affine(st.walsh(_truth(spark, d), 6), 6))


@query(f"WITH {_PMI}, m AS (SELECT src, avg(pmi) AS mean FROM e WHERE pmi >= 0 GROUP BY src) SELECT tok, round(coalesce(mean, 0), 6) AS mean_pmi FROM u LEFT JOIN m ON src = tok", "ue", "eb")
def pmi_node_mean(spark: SparkSession, d: str) -> DataFrame:
    own = src.user_events(spark, d)
    mean = ng.pmi_edges(own, 2, 0.0).groupBy(F.col("src").alias("tok")).agg(F.avg("pmi").alias("mean_pmi"))
    return rounded(own.select("tok").distinct().join(mean, "tok", "left").select("tok", F.coalesce("mean_pmi", F.lit(0.0)).alias("mean_pmi")))


@query(f"WITH {_ALPHA} SELECT tablet, count(*) AS n, round(sum(lp), 6) AS score FROM lp GROUP BY tablet", "ue")
def sequence_scores(spark: SparkSession, d: str) -> DataFrame:
    t, m = _model(spark, d)
    return rounded(lm.additive(t, m, 3).groupBy("tablet").agg(F.count("*").alias("n"), F.sum("lp").alias("score")))


# Orders are tablets, parts' line numbers lines; orders divisible by 3 count as undated.
_LS = """li AS (SELECT tablet, stratum, pos AS line, pos % 2 AS parity, tok FROM pb), un AS (SELECT tablet, row_number() OVER (ORDER BY tablet) AS k FROM (SELECT DISTINCT tablet FROM li WHERE tablet % 3 = 0)),
 lk AS (SELECT li.*, un.k, line + 1 AS r, greatest(1, round_even(0.2 * (max(line) OVER (PARTITION BY tablet) + 1), 0)) AS early FROM li LEFT JOIN un USING (tablet)),
 ls AS (SELECT parity, tok, scenario, CASE WHEN k IS NULL THEN stratum WHEN scenario = 'all_late' THEN 'post' WHEN scenario = 'alternate' THEN CASE WHEN k % 2 = 1 THEN 'pre' ELSE 'post' END WHEN r <= early THEN 'pre' ELSE 'post' END AS stratum FROM lk, (SELECT unnest(['all_late', 'alternate', 'first_fifth']) AS scenario))"""


@query(f"WITH {_LS} SELECT scenario, stratum, parity, sum(f)::BIGINT AS n_tokens, round(sum(f::DOUBLE * (f - 1)) / (sum(f)::DOUBLE * (sum(f) - 1)), 6) AS ic, round({h()}, 6) AS entropy FROM (SELECT scenario, stratum, parity, tok, count(*) AS f FROM ls GROUP BY ALL) GROUP BY ALL", "pb")
def scenario_parity(spark: SparkSession, d: str) -> DataFrame:
    lines = src.part_baskets(spark, d, as_stored=True).select("tablet", "stratum", F.col("pos").alias("line"), (F.col("pos") % 2).alias("parity"), "tok")
    own = con.line_scenarios(lines, F.col("tablet") % 3 == 0)
    return rounded(info.unigram_stats(own, "scenario", "stratum", "parity").select("scenario", "stratum", "parity", "n_tokens", "ic", "entropy"))
