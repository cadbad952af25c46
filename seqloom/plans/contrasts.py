"""Queries that contrast strata."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.functions.stats import rounded
from seqloom.operators import contingency as con
from seqloom.operators import information as info
from seqloom.plans.registry import h, query
from seqloom.sources import adapters as src


def _x(e: str) -> str:
    return f"(CASE WHEN ({e}) > 0 THEN ({e}) * ln(({e})::DOUBLE) ELSE 0 END)"


def _contrast(table: str, by: str = "", threshold: float = 3.841) -> str:
    a, b, c, d = "f1", "f2", "(n1 - f1)", "(n2 - f2)"
    g2 = f"greatest(0, 2 * ({_x(a)} + {_x(b)} + {_x(c)} + {_x(d)} + {_x('n1 + n2')} - {_x('f1 + f2')} - {_x('n1 - f1 + n2 - f2')} - {_x('n1')} - {_x('n2')}))"
    own = f"{by}, " if by else ""
    over = f"OVER (PARTITION BY {by})" if by else "OVER ()"
    return f"""k AS (SELECT {own}tok, count(*) FILTER (WHERE stratum = 'pre') AS f1, count(*) FILTER (WHERE stratum = 'post') AS f2 FROM {table} WHERE stratum IN ('pre', 'post') GROUP BY ALL),
 n AS (SELECT *, (sum(f1) {over})::BIGINT AS n1, (sum(f2) {over})::BIGINT AS n2 FROM k), g AS (SELECT *, {g2} AS g2, ln((f1 + 0.5) / (n1 + 1.0)) - ln((f2 + 0.5) / (n2 + 1.0)) AS lo FROM n),
 con AS (SELECT {own}tok, f1, f2, g2, lo AS log_odds, 1000.0 * f1 / n1 AS rate1, 1000.0 * f2 / n2 AS rate2, CASE WHEN g2 < {threshold} THEN 'neutral' WHEN lo > 0 THEN 'pre' ELSE 'post' END AS lean FROM g)"""


_Z = "sqrt(g2 / 2)"
_T = f"(1 / (1 + 0.3275911 * {_Z}))"
_P = f"({_T} * (0.254829592 + {_T} * (-0.284496736 + {_T} * (1.421413741 + {_T} * (-1.453152027 + {_T} * 1.061405429)))) * exp(-g2 / 2))"
_OUT = "SELECT tok, f1, f2, round(g2, 6) AS g2, round(log_odds, 6) AS log_odds, round(rate1, 6) AS rate1, round(rate2, 6) AS rate2, lean FROM con"


def _brands(spark: SparkSession, d: str) -> DataFrame:
    return con.contrast(src.part_baskets(spark, d), "pre", "post")


@query(f"WITH {_contrast('pb')} {_OUT}", "pb")
def g2_part_prepost(spark: SparkSession, d: str) -> DataFrame:
    return rounded(_brands(spark, d))


@query(f"WITH {_contrast('ue')} {_OUT}", "ue")
def g2_events(spark: SparkSession, d: str) -> DataFrame:
    return rounded(con.contrast(src.user_events(spark, d), "pre", "post"))


@query(f"WITH {_contrast('pb')} SELECT tok, round({_P}, 6) AS p, round(least(1, {_P} * 2 * (SELECT count(*) FROM con)), 6) AS p_adj, least(1, {_P} * 2 * (SELECT count(*) FROM con)) < 0.05 AS significant FROM con", "pb")
def g2_bonferroni(spark: SparkSession, d: str) -> DataFrame:
    return rounded(con.corrected(_brands(spark, d)).select("tok", "p", "p_adj", "significant"))


@query(
    f"""WITH {_contrast('pb')}, p AS (SELECT tok, {_P} AS p FROM con), r AS (SELECT *, row_number() OVER (ORDER BY p, tok) AS rank, count(*) OVER () AS m FROM p)
 SELECT tok, rank, coalesce(rank <= (SELECT max(rank) FROM r WHERE p <= rank * 0.5 / m), false) AS rejected FROM r""",
    "pb",
)
def bh_reject_parts(spark: SparkSession, d: str) -> DataFrame:
    return con.benjamini_hochberg(con.corrected(_brands(spark, d)), 0.5).select("tok", "rank", "rejected")


# Users whose number is divisible by 3 count as undated.
_SCEN = """un AS (SELECT tablet, row_number() OVER (ORDER BY tablet) AS k, coalesce(sum(size) OVER (ORDER BY tablet ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, greatest(1, round_even(0.2 * sum(size) OVER (), 0)) AS early FROM (SELECT tablet, count(*) AS size FROM ue WHERE tablet % 3 = 0 GROUP BY tablet)),
 sc AS (SELECT tablet, tok, scenario, CASE WHEN k IS NULL THEN stratum WHEN scenario = 'all_late' THEN 'post' WHEN scenario = 'alternate' THEN CASE WHEN k % 2 = 1 THEN 'pre' ELSE 'post' END ELSE CASE WHEN before + pos < early THEN 'pre' ELSE 'post' END END AS stratum
 FROM ue LEFT JOIN un USING (tablet), (SELECT unnest(['all_late', 'alternate', 'first_fifth']) AS scenario))"""


def _scenarios(spark: SparkSession, d: str) -> DataFrame:
    return con.scenarios(src.user_events(spark, d), F.col("tablet") % 3 == 0)


_IC = f"ics AS (SELECT scenario, stratum, sum(f)::BIGINT AS n_tokens, sum(f::DOUBLE * (f - 1)) / (sum(f)::DOUBLE * (sum(f) - 1)) AS ic, {h()} AS entropy FROM (SELECT scenario, stratum, tok, count(*) AS f FROM sc GROUP BY ALL) GROUP BY ALL)"


@query(f"WITH {_SCEN}, {_IC} SELECT scenario, stratum, n_tokens, round(ic, 6) AS ic, round(entropy, 6) AS entropy FROM ics", "ue")
def scenario_ic(spark: SparkSession, d: str) -> DataFrame:
    return rounded(info.unigram_stats(_scenarios(spark, d), "scenario", "stratum").select("scenario", "stratum", "n_tokens", "ic", "entropy"))


@query(
    f"""WITH {_SCEN}, {_IC}, dl AS (SELECT scenario, max(ic) FILTER (WHERE stratum = 'pre') - max(ic) FILTER (WHERE stratum = 'post') AS delta FROM ics GROUP BY scenario)
 SELECT scenario, round(delta, 6) AS delta, round((max(delta) OVER () - min(delta) OVER ()) / max(abs(delta)) OVER (), 6) AS variation, min(delta) OVER () > 0 AND (max(delta) OVER () - min(delta) OVER ()) / max(abs(delta)) OVER () <= 0.1 AS robust FROM dl""",
    "ue",
)
def scenario_sensitivity(spark: SparkSession, d: str) -> DataFrame:
    return rounded(con.scenario_summary(info.unigram_stats(_scenarios(spark, d), "scenario", "stratum")))


def _by_scenario(spark: SparkSession, d: str) -> DataFrame:
    return con.contrast(_scenarios(spark, d), "pre", "post", "scenario", threshold=0.5)


@query(f"WITH {_SCEN}, {_contrast('sc', 'scenario', 0.5)} SELECT tok, count(*) AS n, count(DISTINCT lean) AS leans, min(lean) AS lean, count(*) = 3 AND count(DISTINCT lean) = 1 AS stable FROM con WHERE lean <> 'neutral' GROUP BY tok", "ue")
def scenario_stability(spark: SparkSession, d: str) -> DataFrame:
    return con.stability(_by_scenario(spark, d))


@query(
    f"""WITH {_SCEN}, {_contrast('sc', 'scenario', 0.5)}, s AS (SELECT scenario, coalesce(list(DISTINCT tok) FILTER (WHERE lean <> 'neutral'), []) AS s FROM con GROUP BY scenario)
 SELECT x.scenario AS a, y.scenario AS b, len(list_intersect(x.s, y.s))::INT AS core, len(list_distinct(x.s || y.s))::INT AS any, round(coalesce(len(list_intersect(x.s, y.s)) / nullif(len(list_distinct(x.s || y.s)), 0)::DOUBLE, 1), 6) AS jaccard FROM s x JOIN s y ON x.scenario < y.scenario""",
    "ue",
)
def scenario_jaccard(spark: SparkSession, d: str) -> DataFrame:
    return rounded(con.set_overlap(_by_scenario(spark, d)))
