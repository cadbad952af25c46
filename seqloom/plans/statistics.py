"""Queries on frequencies, information and n-grams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.functions.stats import double, rounded
from seqloom.operators import information as info
from seqloom.operators import ngrams as ng
from seqloom.plans.registry import h, query
from seqloom.sources import adapters as src

_UNI = f"""SELECT {{by}}, sum(f)::BIGINT AS n_tokens, count(*) AS n_types, round(CASE WHEN sum(f) > 1 THEN sum(f::DOUBLE * (f - 1)) / (sum(f)::DOUBLE * (sum(f) - 1)) END, 6) AS ic,
 round({h()}, 6) AS entropy, round(CASE WHEN sum(f) > 1 THEN sum(f::DOUBLE * (f - 1)) / (sum(f)::DOUBLE * (sum(f) - 1)) END * count(*), 6) AS norm_ic, round(1 / count(*)::DOUBLE, 6) AS ic_uniform,
 round(count(*) / sum(f)::DOUBLE, 6) AS ttr, count(*) FILTER (WHERE f = 1) AS hapax
FROM (SELECT {{by}}, tok, count(*) AS f FROM {{t}} GROUP BY ALL) GROUP BY ALL"""


@query(_UNI.format(by="stratum", t="dw"), "dw")
def ic_by_lang(spark: SparkSession, d: str) -> DataFrame:
    return rounded(info.unigram_stats(src.doc_words(spark, d), "stratum"))


@query(_UNI.format(by="source AS stratum", t="dw").replace("GROUP BY ALL", "GROUP BY ALL", 1).replace("SELECT source AS stratum, sum", "SELECT stratum, sum"), "dw")
def ttr_hapax_by_source(spark: SparkSession, d: str) -> DataFrame:
    return rounded(info.unigram_stats(src.doc_words(spark, d, "source"), "stratum"))


@query(_UNI.format(by="stratum", t="ds"), "ds")
def syllable_stats(spark: SparkSession, d: str) -> DataFrame:
    return rounded(info.unigram_stats(src.doc_syllables(spark, d), "stratum"))


@query(_UNI.format(by="parity", t="(SELECT l_linenumber % 2 AS parity, p_brand AS tok FROM lineitem JOIN part ON p_partkey = l_partkey)"))
def ic_by_line_parity(spark: SparkSession, d: str) -> DataFrame:
    own = src.read(spark, d, "lineitem").join(src.read(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return rounded(info.unigram_stats(own.select((F.col("l_linenumber") % 2).alias("parity"), F.col("p_brand").alias("tok")), "parity"))


@query(f"SELECT stratum, sum(f)::BIGINT AS n, round({h()}, 6) AS entropy FROM (SELECT stratum, tok, count(*) AS f FROM ue GROUP BY ALL) GROUP BY ALL", "ue")
def entropy_by_stratum(spark: SparkSession, d: str) -> DataFrame:
    return rounded(info.unigram_stats(src.user_events(spark, d), "stratum").select("stratum", F.col("n_tokens").alias("n"), "entropy"))


@query(
    f"""WITH b AS (SELECT stratum, tok, least(floor(CASE WHEN count(*) OVER w1 > 1 THEN pos::DOUBLE / (count(*) OVER w1 - 1) ELSE 0.5 END * 5), 4) AS bin FROM ue WINDOW w1 AS (PARTITION BY tablet)),
 c AS (SELECT stratum, bin, tok, count(*) AS f FROM b GROUP BY ALL),
 w AS (SELECT stratum, {h()} AS h, sum(f) AS n FROM (SELECT stratum, tok, sum(f) AS f FROM c GROUP BY ALL) GROUP BY ALL),
 e AS (SELECT stratum, sum(nb * hb) AS s FROM (SELECT stratum, bin, {h()} AS hb, sum(f) AS nb FROM c GROUP BY ALL) GROUP BY ALL)
 SELECT stratum, n::BIGINT AS n, round(h, 6) AS h, round(h - s / n, 6) AS mi FROM w JOIN e USING (stratum)""",
    "ue",
)
def positional_mi(spark: SparkSession, d: str) -> DataFrame:
    return rounded(info.positional_mi(src.user_events(spark, d)))


@query(
    f"""WITH b AS (SELECT tok, least(floor(CASE WHEN count(*) OVER w1 > 1 THEN pos::DOUBLE / (count(*) OVER w1 - 1) ELSE 0.5 END * 10), 9) AS bin FROM dw WINDOW w1 AS (PARTITION BY tablet)),
 c AS (SELECT bin, tok, count(*) AS f FROM b GROUP BY ALL)
 SELECT tok, sum(f)::BIGINT AS n, round({h(base="10")}, 6) AS h_norm, round(sum(f * bin) / sum(f), 6) AS mean_bin FROM c GROUP BY tok HAVING sum(f) >= 50""",
    "dw",
)
def positional_entropy_word(spark: SparkSession, d: str) -> DataFrame:
    return rounded(info.positional_entropy(src.doc_words(spark, d), 10, 50))


@query(
    """WITH r AS (SELECT stratum, ln(row_number() OVER (PARTITION BY stratum ORDER BY f DESC, tok)::DOUBLE) AS x, ln(f::DOUBLE) AS y FROM (SELECT stratum, tok, count(*) AS f FROM dw GROUP BY ALL))
 SELECT stratum, count(*) AS n_types, round(regr_slope(y, x), 6) AS slope, round(regr_intercept(y, x), 6) AS intercept, round(regr_r2(y, x), 6) AS r2 FROM r GROUP BY stratum""",
    "dw",
)
def zipf_ols_by_lang(spark: SparkSession, d: str) -> DataFrame:
    return rounded(info.zipf(src.doc_words(spark, d), "stratum"))


@query(
    """WITH c AS (SELECT stratum, tok, count(*) AS f FROM dw GROUP BY ALL), m AS (SELECT *, min(f) OVER (PARTITION BY stratum) AS least FROM c)
 SELECT stratum, round(1 + count(*) / sum(ln(f::DOUBLE / least)), 6) AS alpha FROM m GROUP BY stratum""",
    "dw",
)
def zipf_exponent_by_lang(spark: SparkSession, d: str) -> DataFrame:
    return rounded(info.zipf_exponent(src.doc_words(spark, d), "stratum"))


@query(
    """WITH x AS (SELECT l_returnflag, l_quantity, l_extendedprice, rank() OVER (PARTITION BY l_returnflag ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_returnflag, l_quantity) - 1) / 2.0 AS a,
  rank() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice) + (count(*) OVER (PARTITION BY l_returnflag, l_extendedprice) - 1) / 2.0 AS b FROM lineitem)
 SELECT l_returnflag, count(*) AS n, round(corr(a::DOUBLE, b::DOUBLE), 6) AS rho FROM x GROUP BY ALL"""
)
def spearman_quantity_price(spark: SparkSession, d: str) -> DataFrame:
    own = src.read(spark, d, "lineitem").select("l_returnflag", "l_quantity", "l_extendedprice")
    return rounded(info.spearman(own, "l_quantity", "l_extendedprice", "l_returnflag"))


@query(
    """WITH r AS (SELECT tablet, tok, count(*) AS f, count(*)::DOUBLE / any_value(n) AS r FROM (SELECT tablet, tok, count(*) OVER (PARTITION BY tablet) AS n FROM dw) GROUP BY ALL)
 SELECT tok, sum(f)::BIGINT AS f, count(*) AS tablets, round(CASE WHEN count(*) > 1 THEN greatest(0, least(1, 1 - stddev_samp(r) / avg(r))) ELSE 0 END, 6) AS consistency FROM r GROUP BY tok HAVING sum(f) >= 20""",
    "dw",
)
def cross_tablet_consistency(spark: SparkSession, d: str) -> DataFrame:
    return rounded(info.consistency(src.doc_words(spark, d, following=True), 20))


@query("""WITH c AS (SELECT tok, count(*) AS f FROM pb GROUP BY tok) SELECT tok, f, round((f / (SELECT sum(f)::DOUBLE FROM c)) ** 2, 6) AS p2, round((f / (SELECT max(f)::DOUBLE FROM c)) ** 2, 6) AS relative FROM c""", "pb")
def ic_contributions(spark: SparkSession, d: str) -> DataFrame:
    return rounded(info.ic_contributions(src.part_baskets(spark, d)))


_SPECTRUM = f"""s AS (SELECT tablet, tok, lead(tok) OVER (PARTITION BY tablet ORDER BY pos) AS nxt FROM ue),
 u AS (SELECT tablet, sum(f)::BIGINT AS n_tokens, CASE WHEN sum(f) > 1 THEN sum(f::DOUBLE * (f - 1)) / (sum(f)::DOUBLE * (sum(f) - 1)) END AS ic, {h()} AS h1, count(*) FILTER (WHERE f = 1) / count(*)::DOUBLE AS hapax_rate FROM (SELECT tablet, tok, count(*) AS f FROM s GROUP BY ALL) GROUP BY tablet),
 p AS (SELECT tablet, tok, nxt, count(*) AS f FROM s WHERE nxt IS NOT NULL GROUP BY ALL), p2 AS (SELECT tablet, {h()} AS h12 FROM p GROUP BY tablet),
 l AS (SELECT tablet, {h()} AS hl FROM (SELECT tablet, tok, sum(f) AS f FROM p GROUP BY ALL) GROUP BY tablet), r AS (SELECT tablet, {h()} AS hr FROM (SELECT tablet, nxt, sum(f) AS f FROM p GROUP BY ALL) GROUP BY tablet),
 sp AS (SELECT tablet, n_tokens, ic, hapax_rate, greatest(0, hl + hr - h12) AS bigram_mi, CASE WHEN h1 > 0 THEN greatest(0, (h1 - (h12 - hl)) / h1) ELSE 0 END AS entropy_decay FROM u JOIN p2 USING (tablet) JOIN l USING (tablet) JOIN r USING (tablet))"""


@query(f"WITH {_SPECTRUM} SELECT tablet, n_tokens, round(ic, 6) AS ic, round(hapax_rate, 6) AS hapax_rate, round(bigram_mi, 6) AS bigram_mi, round(entropy_decay, 6) AS entropy_decay FROM sp", "ue")
def spectrum_features(spark: SparkSession, d: str) -> DataFrame:
    return rounded(info.spectrum(src.user_events(spark, d)))


@query(
    f"""WITH {_SPECTRUM}, b AS (SELECT min(ic) AS a0, max(ic) AS a1, min(bigram_mi) AS b0, max(bigram_mi) AS b1, min(entropy_decay) AS c0, max(entropy_decay) AS c1 FROM sp)
 SELECT tablet, round(0.4 * (ic - a0) / (a1 - a0) + 0.3 * (bigram_mi - b0) / (b1 - b0) + 0.3 * (1 - (entropy_decay - c0) / (c1 - c0)), 4) AS score FROM sp, b""",
    "ue",
)
def spectrum_scores(spark: SparkSession, d: str) -> DataFrame:
    s = info.normalised(info.spectrum(src.user_events(spark, d)), "ic", "bigram_mi", "entropy_decay")
    return rounded(s.select("tablet", (0.4 * F.col("ic") + 0.3 * F.col("bigram_mi") + 0.3 * (1 - F.col("entropy_decay"))).alias("score")), 4)


@query("SELECT tok, nxt, f FROM eb", "ue", "eb")
def bigram_counts_events(spark: SparkSession, d: str) -> DataFrame:
    return ng.bigrams(src.user_events(spark, d))


_COND = f"""WITH p AS (SELECT {{by}}, tok, nxt, count(*) AS f FROM (SELECT stratum, tok, lead(tok) OVER (PARTITION BY {{part}}) AS nxt FROM {{t}}) WHERE nxt IS NOT NULL GROUP BY ALL),
 a AS (SELECT {{by}}, sum(f)::BIGINT AS n, {h()} AS h2 FROM p GROUP BY {{by}}), b AS (SELECT {{by}}, {h()} AS h1 FROM (SELECT {{by}}, tok, sum(f) AS f FROM p GROUP BY ALL) GROUP BY {{by}})
 SELECT {{by}}, n, round(h2 - h1, 6) AS h_cond FROM a JOIN b USING ({{by}})"""


@query(_COND.format(by="stratum", part="tablet ORDER BY pos", t="ue"), "ue")
def cond_entropy_events(spark: SparkSession, d: str) -> DataFrame:
    return rounded(ng.conditional_entropy(src.user_events(spark, d), "stratum"))


@query(_COND.format(by="stratum", part="stratum ORDER BY tablet, pos", t="dw"), "dw")
def cond_entropy_pooled(spark: SparkSession, d: str) -> DataFrame:
    return rounded(ng.conditional_entropy(src.doc_words(spark, d, following=True), "stratum", span="stratum"))


@query(
    f"""WITH x AS (SELECT 'forward' AS direction, tok, lead(tok) OVER (PARTITION BY tablet ORDER BY pos) AS nxt FROM cr UNION ALL SELECT 'reversed', tok, lag(tok) OVER (PARTITION BY tablet ORDER BY pos) FROM cr),
 p AS (SELECT direction, tok, nxt, count(*) AS f FROM x WHERE nxt IS NOT NULL GROUP BY ALL)
 SELECT direction, a.n, round(a.h2 - b.h1, 6) AS h_cond FROM (SELECT direction, sum(f)::BIGINT AS n, {h()} AS h2 FROM p GROUP BY direction) a JOIN (SELECT direction, {h()} AS h1 FROM (SELECT direction, tok, sum(f) AS f FROM p GROUP BY ALL) GROUP BY direction) b USING (direction)""",
    "cr",
)
def forward_reverse_entropy(spark: SparkSession, d: str) -> DataFrame:
    t = src.conversation_roles(spark, d)
    both = t.withColumn("direction", F.lit("forward")).unionByName(ng.reversed_order(t).withColumn("direction", F.lit("reversed")))
    both = both.withColumn("tablet", F.struct("direction", "tablet"))
    return rounded(ng.conditional_entropy(both, "direction"))


_PMI = """t AS (SELECT sum(f)::DOUBLE AS nb FROM eb), u AS (SELECT tok, count(*)::DOUBLE AS c FROM ue GROUP BY tok), v AS (SELECT sum(c) AS nu FROM u),
 e AS (SELECT eb.tok AS src, nxt AS dst, f AS n, ln((f / nb) / ((a.c / nu) * (b.c / nu))) AS pmi, f / nb AS p FROM eb JOIN u a ON a.tok = eb.tok JOIN u b ON b.tok = nxt, t, v WHERE f >= 2)"""


@query(f"WITH {_PMI} SELECT src, dst, n, round(pmi, 6) AS pmi, round(pmi / -ln(p), 6) AS npmi FROM e WHERE pmi >= 0", "ue", "eb")
def pmi_edges_events(spark: SparkSession, d: str) -> DataFrame:
    return rounded(ng.pmi_edges(src.user_events(spark, d), 2, 0.0))


@query(f"WITH {_PMI}, q AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY round(pmi / -ln(p), 6) DESC, dst) AS rank FROM e) SELECT src, dst, round(pmi / -ln(p), 6) AS npmi, rank FROM q WHERE rank <= 5", "ue", "eb")
def npmi_successor(spark: SparkSession, d: str) -> DataFrame:
    from seqloom.operators.relational import top_k

    e = ng.pmi_edges(src.user_events(spark, d), 2).select("src", "dst", F.round("npmi", 6).alias("npmi"))
    return top_k(e, 5, ["src"], F.desc("npmi"), F.col("dst"))


@query(f"SELECT tok, sum(f)::BIGINT AS n, round({h()}, 6) AS h FROM eb GROUP BY tok", "ue", "eb")
def successor_entropy(spark: SparkSession, d: str) -> DataFrame:
    return rounded(ng.successor_entropy(src.user_events(spark, d)))


@query(f"SELECT tok, sum(f)::BIGINT AS n, round({h(base='exp(1)')}, 6) AS h FROM eb GROUP BY tok", "ue", "eb")
def successor_entropy_nats(spark: SparkSession, d: str) -> DataFrame:
    return rounded(ng.successor_entropy(src.user_events(spark, d), 2.718281828459045))


@query(
    """WITH k AS (SELECT count(DISTINCT tok)::DOUBLE AS k FROM ue), a AS (SELECT tok, sum(f)::DOUBLE AS o, max(f)::DOUBLE AS m, count(*) AS na FROM eb GROUP BY tok), b AS (SELECT nxt AS tok, count(*) AS nb FROM eb GROUP BY nxt),
 n AS (SELECT tok, count(DISTINCT x)::DOUBLE AS near FROM (SELECT tok, nxt AS x FROM eb UNION ALL SELECT nxt, tok FROM eb) GROUP BY tok)
 SELECT tok, round(near / k, 6) AS neighbor_diversity, round(coalesce(m / o, 0), 6) AS slot_predictability, round((coalesce(na, 0) - coalesce(nb, 0))::DOUBLE / nullif(coalesce(na, 0) + coalesce(nb, 0), 0), 6) AS direction_skew FROM n LEFT JOIN a USING (tok) LEFT JOIN b USING (tok), k""",
    "ue",
    "eb",
)
def neighbor_roles(spark: SparkSession, d: str) -> DataFrame:
    return rounded(ng.roles(src.user_events(spark, d)))


@query(
    f"""WITH hh AS (SELECT tok, {h()} AS h FROM eb GROUP BY tok), c AS (SELECT avg(h) + stddev_pop(h) AS cut FROM hh),
 x AS (SELECT tablet, pos, tok, lead(tok) OVER (PARTITION BY tablet ORDER BY pos) AS nxt FROM ue), y AS (SELECT x.*, (coalesce(h > cut, false) AND nxt IS NOT NULL)::INT AS e FROM x LEFT JOIN hh USING (tok), c),
 z AS (SELECT *, coalesce(sum(e) OVER (PARTITION BY tablet ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS segment FROM y)
 SELECT tablet, segment::BIGINT AS segment, string_agg(tok, ' ' ORDER BY pos) AS toks, count(*) AS size FROM z GROUP BY ALL""",
    "ue",
    "eb",
)
def morpheme_segments(spark: SparkSession, d: str) -> DataFrame:
    return ng.segments(src.user_events(spark, d))


@query(
    f"""WITH x AS (SELECT tok, lead(tok) OVER w AS nxt, CASE WHEN lead(pos // 4) OVER w = pos // 4 THEN 'within' ELSE 'across' END AS kind FROM ue WINDOW w AS (PARTITION BY tablet ORDER BY pos)),
 p AS (SELECT kind, tok, nxt, count(*) AS f FROM x WHERE nxt IS NOT NULL GROUP BY ALL)
 SELECT kind, n, round(h2 - h1, 6) AS h_cond FROM (SELECT kind, sum(f)::BIGINT AS n, {h()} AS h2 FROM p GROUP BY kind) JOIN (SELECT kind, {h()} AS h1 FROM (SELECT kind, tok, sum(f) AS f FROM p GROUP BY ALL) GROUP BY kind) USING (kind)""",
    "ue",
)
def line_boundary_entropy(spark: SparkSession, d: str) -> DataFrame:
    return rounded(ng.boundary_entropy(src.user_events(spark, d), F.floor(F.col("pos") / 4)))


@query(
    """WITH x AS (SELECT tok, greatest(coalesce(max((tok = 'purchase')::INT) OVER (w ROWS BETWEEN 8 PRECEDING AND 1 PRECEDING), 0), coalesce(max((tok = 'purchase')::INT) OVER (w ROWS BETWEEN 1 FOLLOWING AND 8 FOLLOWING), 0)) AS near FROM ue WINDOW w AS (PARTITION BY tablet ORDER BY pos))
 SELECT tok, count(*) AS n, sum(near)::BIGINT AS with_context, round(sum(near)::DOUBLE / count(*), 6) AS rate FROM x GROUP BY tok""",
    "ue",
)
def cooccur_window8(spark: SparkSession, d: str) -> DataFrame:
    return rounded(ng.cooccurrence(src.user_events(spark, d), "purchase", 8))


@query("""SELECT tablet, pos, tok AS a, b FROM (SELECT tablet, pos, tok, lead(tok) OVER w AS b, lead(tok, 2) OVER w AS c, lead(tok, 3) OVER w AS d FROM ue WINDOW w AS (PARTITION BY tablet ORDER BY pos)) WHERE tok = c AND b = d AND tok <> b""", "ue")
def abab_pattern(spark: SparkSession, d: str) -> DataFrame:
    return ng.abab(src.user_events(spark, d))


def _grams(table: str, longest: int) -> str:
    parts = []
    for n in range(1, longest + 1):
        cols = ", ' ', ".join(["tok", *[f"lead(tok, {k}) OVER w" for k in range(1, n)]])
        last = f"lead(tok, {n - 1}) OVER w" if n > 1 else "tok"
        parts.append(f"SELECT tablet, {n} AS n, CASE WHEN {last} IS NOT NULL THEN concat({cols}) END AS gram FROM {table} WINDOW w AS (PARTITION BY tablet ORDER BY pos)")
    return " UNION ALL ".join(parts)


@query(f"SELECT n, gram, count(*) AS f, count(DISTINCT tablet) AS tablets FROM ({_grams('cr', 8)}) WHERE gram IS NOT NULL GROUP BY n, gram", "cr")
def ngram_index_1_8(spark: SparkSession, d: str) -> DataFrame:
    return ng.ngram_index(src.conversation_roles(spark, d), 8)


@query(
    """WITH x AS (SELECT tablet, pos, tok, lead(tok) OVER w AS b, lead(tok, 2) OVER w AS c FROM ue WINDOW w AS (PARTITION BY tablet ORDER BY pos))
 SELECT 'funnel' AS name, tablet, pos FROM x WHERE tok = 'view' AND b = 'click' AND c = 'purchase' UNION ALL SELECT 'return', tablet, pos FROM x WHERE tok = 'purchase' AND b = 'view'""",
    "ue",
)
def pattern_search(spark: SparkSession, d: str) -> DataFrame:
    patterns = spark.createDataFrame([("funnel", ["view", "click", "purchase"]), ("return", ["purchase", "view"])], "name string, pattern array<string>")
    return ng.find_patterns(src.user_events(spark, d), patterns)


@query(
    """WITH x AS (SELECT user_id, epoch(ts) AS t FROM events), y AS (SELECT *, coalesce((t - lag(t) OVER (PARTITION BY user_id ORDER BY t) > 86400)::INT, 0) AS n FROM x), z AS (SELECT *, sum(n) OVER (PARTITION BY user_id ORDER BY t ROWS UNBOUNDED PRECEDING) AS chain FROM y)
 SELECT user_id, chain::BIGINT AS chain, round(min(t), 3) AS first, round(max(t), 3) AS last, count(*) AS size FROM z GROUP BY ALL"""
)
def soft_chain_sessions(spark: SparkSession, d: str) -> DataFrame:
    own = src.read(spark, d, "events").select("user_id", double(F.unix_micros(F.col("ts").cast("timestamp"))).alias("t")).withColumn("t", F.col("t") / 1e6)
    return rounded(ng.chains(own, "t", 86400, "user_id"), 3)


@query(
    """SELECT tablet, pos, tok, concat_ws(' ', coalesce(lag(tok, 2) OVER w, '<pad>'), coalesce(lag(tok, 1) OVER w, '<pad>'), coalesce(lead(tok, 1) OVER w, '<pad>'), coalesce(lead(tok, 2) OVER w, '<pad>')) AS context FROM cr WINDOW w AS (PARTITION BY tablet ORDER BY pos)""",
    "cr",
)
def context_windows(spark: SparkSession, d: str) -> DataFrame:
    return ng.context_windows(src.conversation_roles(spark, d), 2)
