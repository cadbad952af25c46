"""Queries on language models, alignment, substitution and resampling."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.functions.stats import double, rounded
from seqloom.operators import alignment as al
from seqloom.operators import information as info
from seqloom.operators import language_models as lm
from seqloom.operators import resampling as rs
from seqloom.plans.registry import h, query
from seqloom.sources import adapters as src

# Places of the user event sequences with two tokens before them, and counts of n-grams up to 3.
_EV = """sq AS (SELECT tablet, pos::BIGINT + 1 AS i, tok FROM ue UNION ALL SELECT tablet, count(*) + 1, '</s>' FROM ue GROUP BY tablet),
 ev AS (SELECT tablet, i - 1 AS i, tok, coalesce(lag(tok, 1) OVER w, '<s>') AS c1, coalesce(lag(tok, 2) OVER w, '<s>') AS c2 FROM sq WINDOW w AS (PARTITION BY tablet ORDER BY i)),
 m3 AS (SELECT c2, c1, tok, count(*) AS f FROM ev GROUP BY ALL), m2 AS (SELECT c1, tok, count(*) AS f FROM ev GROUP BY ALL), m1 AS (SELECT tok, count(*) AS f FROM ev GROUP BY ALL)"""


def _model(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    t = src.user_events(spark, d)
    return t, lm.train(t, 3)


@query(f"WITH {_EV} SELECT 3 AS n, concat(c2, ' ', c1) AS ctx, tok, f FROM m3 UNION ALL SELECT 2, c1, tok, f FROM m2 UNION ALL SELECT 1, '', tok, f FROM m1", "ue")
def ngram_counts(spark: SparkSession, d: str) -> DataFrame:
    return _model(spark, d)[1].select("n", F.array_join("ctx", " ").alias("ctx"), "tok", "f")


_ALPHA = f"""{_EV}, v AS (SELECT count(*)::DOUBLE AS v FROM m1 WHERE tok <> '</s>'), t3 AS (SELECT c2, c1, sum(f)::DOUBLE AS t FROM m3 GROUP BY ALL), t2 AS (SELECT c1, sum(f)::DOUBLE AS t FROM m2 GROUP BY ALL), t1 AS (SELECT sum(f)::DOUBLE AS t FROM m1),
 lp AS (SELECT ev.tablet, ev.i, ev.tok, CASE WHEN t3.t IS NOT NULL THEN log2((coalesce(m3.f, 0) + 0.5) / (t3.t + 0.5 * v)) WHEN t2.t IS NOT NULL THEN log2((coalesce(m2.f, 0) + 0.5) / (t2.t + 0.5 * v)) + log2(0.4) ELSE log2((coalesce(m1.f, 0) + 0.5) / (t1.t + 0.5 * v)) + 2 * log2(0.4) END AS lp
 FROM ev LEFT JOIN m3 ON m3.c2 = ev.c2 AND m3.c1 = ev.c1 AND m3.tok = ev.tok LEFT JOIN t3 ON t3.c2 = ev.c2 AND t3.c1 = ev.c1 LEFT JOIN m2 ON m2.c1 = ev.c1 AND m2.tok = ev.tok LEFT JOIN t2 ON t2.c1 = ev.c1 LEFT JOIN m1 ON m1.tok = ev.tok, t1, v)"""


@query(f"WITH {_ALPHA} SELECT tablet, i, tok, round(lp, 6) AS lp FROM lp", "ue")
def ngram_logprob_alpha(spark: SparkSession, d: str) -> DataFrame:
    t, m = _model(spark, d)
    return rounded(lm.additive(t, m, 3))


@query(f"WITH {_ALPHA} SELECT tablet, count(*) AS n, round(pow(2, -avg(lp)), 6) AS perplexity FROM lp GROUP BY tablet", "ue")
def perplexity_by_tablet(spark: SparkSession, d: str) -> DataFrame:
    t, m = _model(spark, d)
    return rounded(lm.perplexity(lm.additive(t, m, 3), "tablet"))


@query(
    f"""WITH {_EV}, v AS (SELECT count(DISTINCT tok) + 2.0 AS v FROM ue), mi AS (SELECT tablet, c1, tok, count(*) AS m FROM ev GROUP BY ALL), mt AS (SELECT tablet, c1, sum(m) AS mt FROM mi GROUP BY ALL), t2 AS (SELECT c1, sum(f) AS t FROM m2 GROUP BY ALL)
 SELECT tablet, sum(m)::BIGINT AS n, round(pow(2, -sum(m * log2((f - m + 0.5) / (t - mt + 0.5 * v))) / sum(m)), 6) AS perplexity FROM mi JOIN m2 USING (c1, tok) JOIN t2 USING (c1) JOIN mt USING (tablet, c1), v GROUP BY tablet""",
    "ue",
)
def perplexity_loo(spark: SparkSession, d: str) -> DataFrame:
    return rounded(lm.leave_one_out(src.user_events(spark, d)))


@query(
    f"""WITH {_EV}, v AS (SELECT count(*)::DOUBLE AS v FROM m1 WHERE tok <> '</s>'), w1 AS (SELECT DISTINCT tok FROM m1 WHERE tok <> '</s>'), a3 AS (SELECT c2, c1, tok, f FROM m3 UNION ALL SELECT c2, c1, w1.tok, 0 FROM (SELECT DISTINCT c2, c1 FROM m3) x, w1 WHERE NOT EXISTS (FROM m3 y WHERE y.c2 = x.c2 AND y.c1 = x.c1 AND y.tok = w1.tok)),
 q AS (SELECT c2, c1, tok, f, sum(f) OVER (PARTITION BY c2, c1)::DOUBLE AS t, row_number() OVER (PARTITION BY c2, c1 ORDER BY f DESC, tok) AS rank FROM a3)
 SELECT concat(c2, ' ', c1) AS ctx, rank, tok, round(log2((f + 0.5) / (t + 0.5 * v)), 6) AS lp FROM q, v WHERE rank <= 3""",
    "ue",
)
def topk_next(spark: SparkSession, d: str) -> DataFrame:
    return rounded(lm.top_next(_model(spark, d)[1], 3, 3))


def _cut(k: int) -> str:
    return f"CASE WHEN y IS NULL OR n{k} = 0 THEN 0.75 ELSE least(1, greatest(0, {k} - {k + 1} * y * n{k + 1} / n{k}::DOUBLE)) END AS d{k}"


_D = f"""al AS (SELECT 1 AS n, f FROM m1 UNION ALL SELECT 2, f FROM m2 UNION ALL SELECT 3, f FROM m3), nk AS (SELECT n, count(*) FILTER (WHERE f = 1) AS n1, count(*) FILTER (WHERE f = 2) AS n2, count(*) FILTER (WHERE f = 3) AS n3, count(*) FILTER (WHERE f = 4) AS n4 FROM al GROUP BY n),
 y AS (SELECT *, n1::DOUBLE / nullif(n1 + 2 * n2, 0) AS y FROM nk), dc AS (SELECT n, n1, n2, n3, n4, {_cut(1)}, {_cut(2)}, {_cut(3)} FROM y)"""


@query(f"WITH {_EV}, {_D} SELECT n, n1, n2, n3, n4, round(d1, 6) AS d1, round(d2, 6) AS d2, round(d3, 6) AS d3 FROM dc", "ue")
def discounts_counts_of_counts(spark: SparkSession, d: str) -> DataFrame:
    return rounded(lm.discounts(_model(spark, d)[1]))


def _fold(p: str, f: str, s: str, c: str) -> str:
    cut = f"CASE {f} WHEN 1 THEN {c}.d1 WHEN 2 THEN {c}.d2 ELSE {c}.d3 END"
    return f"CASE WHEN {s}.t IS NULL THEN {p} ELSE coalesce(greatest(0, {f} - {cut}), 0) / {s}.t + ({c}.d1 * {s}.k1 + {c}.d2 * {s}.k2 + {c}.d3 * {s}.k3) / {s}.t * {p} END"


_KS = "sum(f)::DOUBLE AS t, count(*) FILTER (WHERE f = 1) AS k1, count(*) FILTER (WHERE f = 2) AS k2, count(*) FILTER (WHERE f >= 3) AS k3"


@query(
    f"""WITH {_EV}, {_D}, s2 AS (SELECT c1, {_KS} FROM m2 GROUP BY c1), s3 AS (SELECT c2, c1, {_KS} FROM m3 GROUP BY c2, c1), z AS (SELECT sum(f)::DOUBLE AS un, count(*) AS uv FROM m1),
 a AS (SELECT ev.*, (m1.f + 1) / (un + uv) AS p1 FROM ev JOIN m1 USING (tok), z),
 b AS (SELECT a.*, {_fold('p1', 'm2.f', 's2', 'q')} AS p2 FROM a LEFT JOIN s2 USING (c1) LEFT JOIN m2 ON m2.c1 = a.c1 AND m2.tok = a.tok, (SELECT * FROM dc WHERE n = 2) q),
 c AS (SELECT b.*, {_fold('p2', 'm3.f', 's3', 'q')} AS p3 FROM b LEFT JOIN s3 USING (c2, c1) LEFT JOIN m3 ON m3.c2 = b.c2 AND m3.c1 = b.c1 AND m3.tok = b.tok, (SELECT * FROM dc WHERE n = 3) q)
 SELECT tablet, i, tok, round(p3, 6) AS p, round(log2(p3), 6) AS lp FROM c""",
    "ue",
)
def kn_prob(spark: SparkSession, d: str) -> DataFrame:
    t, m = _model(spark, d)
    return rounded(lm.interpolated(t, m, 3))


@query("WITH k AS (SELECT DISTINCT tok FROM dw WHERE stratum = 'en') SELECT stratum, count(*) AS n, count(*) FILTER (WHERE k.tok IS NULL) AS oov FROM dw LEFT JOIN k ON k.tok = dw.tok GROUP BY stratum", "dw")
def oov_by_lang(spark: SparkSession, d: str) -> DataFrame:
    t = src.doc_words(spark, d)
    return lm.out_of_vocabulary(t, lm.train(t.where("stratum = 'en'"), 1))


# The distinct daily event sequences of users, as words of one letter a type.
_WORDS = """al AS (SELECT tok, substr('0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ', row_number() OVER (ORDER BY tok)::INT, 1) AS c FROM (SELECT DISTINCT tok FROM ue)),
 dy AS (SELECT tablet, string_agg(c, '' ORDER BY pos) AS word FROM ue JOIN al USING (tok) GROUP BY tablet, ts::DATE), wd AS (SELECT DISTINCT word AS tablet, word FROM dy)"""


def _days(spark: SparkSession, d: str) -> DataFrame:
    return al.lettered(src.user_events(spark, d).withColumn("tablet", F.struct("tablet", F.to_date("ts").alias("day"))))


@query(f"WITH {_WORDS} SELECT a.tablet AS a, b.tablet AS b, levenshtein(a.word, b.word)::INT AS distance FROM wd a JOIN wd b ON a.tablet < b.tablet WHERE levenshtein(a.word, b.word) <= 1", "ue")
def lev_band_join(spark: SparkSession, d: str) -> DataFrame:
    return al.similar(_days(spark, d).select(F.col("word").alias("tablet"), "word").distinct(), 1)


@query(f"WITH {_WORDS} SELECT word, count(*) AS n, count(DISTINCT tablet) AS tablets FROM dy GROUP BY word HAVING count(DISTINCT tablet) >= 2", "ue")
def passage_multi_group(spark: SparkSession, d: str) -> DataFrame:
    return al.equal_groups(_days(spark, d).select("word", F.col("tablet.tablet").alias("tablet")), "word")


# Orders as forms of their brands' last digits, one passage by the priority and number of lines.
_FORMS = """fm AS (SELECT concat(o_orderpriority, '-', any_value(n)) AS passage, l_orderkey AS tablet, l_orderkey AS ord, CASE WHEN l_orderkey % 2 = 0 THEN 'pre' ELSE 'post' END AS stratum, list(substr(p_brand, 7, 1) ORDER BY l_linenumber, l_partkey) AS form
 FROM (SELECT *, count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem) JOIN part ON p_partkey = l_partkey JOIN orders ON o_orderkey = l_orderkey GROUP BY l_orderkey, o_orderpriority)"""


def _forms(spark: SparkSession, d: str) -> DataFrame:
    item = src.read(spark, d, "lineitem").join(src.read(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    form = F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", F.substring("p_brand", 7, 1).alias("b")))), lambda x: x["b"])
    own = item.groupBy(F.col("l_orderkey").alias("tablet")).agg(form.alias("form"), F.count("*").alias("n"))
    own = own.join(src.read(spark, d, "orders"), F.col("tablet") == F.col("o_orderkey"))
    return own.select(F.concat_ws("-", "o_orderpriority", F.col("n").cast("string")).alias("passage"), "tablet", F.col("tablet").alias("ord"), F.when(F.col("tablet") % 2 == 0, "pre").otherwise("post").alias("stratum"), "form")


_SUBST = """ex AS (SELECT passage, ix, form[1:ix - 1] || form[ix + 1:] AS rest, form[ix] AS tok FROM (SELECT passage, form, unnest(range(1, len(form) + 1)) AS ix FROM fm)), dx AS (SELECT DISTINCT * FROM ex),
 su AS (SELECT a.tok AS a, b.tok AS b, count(DISTINCT passage) AS passages, count(DISTINCT (passage, rest, ix)) AS slots FROM dx a JOIN dx b USING (passage, rest, ix) WHERE a.tok < b.tok GROUP BY ALL)"""


@query(f"WITH {_FORMS}, {_SUBST} SELECT * FROM su")
def one_slot_pairs(spark: SparkSession, d: str) -> DataFrame:
    return al.substitutions(_forms(spark, d))


@query(
    f"""WITH RECURSIVE {_FORMS}, {_SUBST}, ed AS (SELECT a, b FROM su WHERE slots >= 75 UNION SELECT b, a FROM su WHERE slots >= 75), rc AS (SELECT a AS node, a AS low FROM ed UNION SELECT rc.node, ed.b FROM rc JOIN ed ON ed.a = rc.low)
 SELECT node, min(low) AS component FROM rc GROUP BY node"""
)
def pair_components(spark: SparkSession, d: str) -> DataFrame:
    return al.components(al.substitutions(_forms(spark, d)).where("slots >= 75"))


_CONS = """ce AS (SELECT passage, stratum, ord, ix - 1 AS ix, form[ix] AS tok FROM (SELECT *, unnest(range(1, len(form) + 1)) AS ix FROM fm)), cc AS (SELECT passage, stratum, ix, tok, count(*) AS n, min(ord) AS seen FROM ce GROUP BY ALL),
 co AS (SELECT passage, stratum, ix, tok, n FROM (SELECT *, row_number() OVER (PARTITION BY passage, stratum, ix ORDER BY n DESC, seen, tok) AS r FROM cc) WHERE r = 1)"""


@query(f"WITH {_FORMS}, {_CONS} SELECT a.passage, a.ix::INT AS \"at\", a.tok AS old, b.tok AS new FROM co a JOIN co b ON a.passage = b.passage AND a.ix = b.ix WHERE a.stratum = 'pre' AND b.stratum = 'post' AND a.tok <> b.tok")
def consensus_substitutions(spark: SparkSession, d: str) -> DataFrame:
    return al.changes(al.consensus(_forms(spark, d)), "pre", "post")


@query(
    f"""WITH {_FORMS}, ca AS (SELECT split_part(passage, '-', 1) AS p, arg_min(form, (-len(form), ord)) AS canonical FROM fm GROUP BY p), sl AS (SELECT p, canonical[ix] AS tok, ix - 1 AS ix FROM (SELECT *, unnest(range(1, len(canonical) + 1)) AS ix FROM ca))
 SELECT tok, count(*) AS variants, count(*) FILTER (WHERE len(form) <= ix) AS omitted, round(avg((len(form) <= ix)::INT::DOUBLE), 6) AS rate FROM sl JOIN fm ON split_part(fm.passage, '-', 1) = p GROUP BY tok"""
)
def omission_rates(spark: SparkSession, d: str) -> DataFrame:
    own = _forms(spark, d).withColumn("passage", F.split_part("passage", F.lit("-"), F.lit(1)))
    canonical = own.groupBy("passage").agg(F.min_by("form", F.struct(-F.size("form"), "ord")).alias("canonical"))
    return rounded(al.omission_rates(own, canonical))


@query(
    """WITH f AS (SELECT p_brand AS cls, list(DISTINCT p_size) AS members FROM part GROUP BY ALL), g AS (SELECT p_type AS cls, list(DISTINCT p_size) AS members FROM part GROUP BY ALL),
 j AS (SELECT f.cls, g.cls AS ref, len(list_intersect(f.members, g.members)) / len(list_distinct(f.members || g.members))::DOUBLE AS jaccard FROM f, g), r AS (SELECT *, row_number() OVER (PARTITION BY cls ORDER BY jaccard DESC, ref) AS k FROM j WHERE jaccard > 0)
 SELECT cls, ref, round(jaccard, 6) AS jaccard FROM r WHERE k = 1"""
)
def jaccard_best_class(spark: SparkSession, d: str) -> DataFrame:
    own = src.read(spark, d, "part")
    of = lambda c: own.groupBy(F.col(c).alias("cls")).agg(F.collect_set("p_size").alias("members"))
    return rounded(al.best_overlap(of("p_brand"), of("p_type")))


@query()
def nw_align(spark: SparkSession, d: str) -> DataFrame:
    own = _forms(spark, d).groupBy("passage").agg(F.min_by("form", "ord").alias("x"), F.max_by("form", "ord").alias("y"))
    return al.align(own).select("passage", F.to_json("cells").alias("cells"))


_DRAW = "('0x' || substr(md5({}), 1, 8))::BIGINT"


@query(
    f"""WITH o AS (SELECT stratum, tok, row_number() OVER (PARTITION BY stratum ORDER BY tablet, pos) - 1 AS place, count(*) OVER (PARTITION BY stratum) AS n FROM pb),
 r AS (SELECT stratum, replica, {_DRAW.format("'42:' || replica || ':' || place")} % n AS pick FROM o, (SELECT unnest(range(2000)) AS replica)),
 c AS (SELECT stratum, replica, tok, count(*) AS f FROM r JOIN (SELECT stratum AS s, place, tok FROM o) o ON s = stratum AND place = pick GROUP BY ALL),
 b AS (SELECT stratum, replica, sum(f::DOUBLE * (f - 1)) / (sum(f)::DOUBLE * (sum(f) - 1)) AS ic FROM c GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY ic, replica) - 1 AS k FROM b)
 SELECT stratum, round(max(ic) FILTER (WHERE k = 50), 6) AS low, round(max(ic) FILTER (WHERE k = 1950), 6) AS high FROM k GROUP BY stratum""",
    "pb",
)
def bootstrap_ci(spark: SparkSession, d: str) -> DataFrame:
    return rounded(rs.interval(rs.bootstrap(src.part_baskets(spark, d), 2000, 42, "stratum"), "ic", 0.95, "stratum"))


def _null(block: int) -> str:
    turn = f"(pos + {_DRAW.format("'7:' || replica || ':' || tablet || ':turn'")} % n) % n" if block > 1 else "pos"
    key = _DRAW.format(f"'7:' || replica || ':' || tablet || ':' || (pos // {block})")
    return f"""tu AS (SELECT replica, tablet, tok, {turn} AS pos FROM (SELECT *, count(*) OVER (PARTITION BY tablet) AS n FROM ue), (SELECT unnest(range(19)) AS replica)),
 sh AS (SELECT replica, tablet, tok, row_number() OVER (PARTITION BY replica, tablet ORDER BY {key}, pos // {block}, pos) - 1 AS pos FROM tu),
 nb AS (SELECT replica, tok, lead(tok) OVER (PARTITION BY replica, tablet ORDER BY pos) AS nxt FROM sh), no AS (SELECT replica, count(*) FILTER (WHERE tok = nxt)::DOUBLE AS t FROM nb GROUP BY replica),
 ob AS (SELECT count(*) FILTER (WHERE tok = nxt)::DOUBLE AS observed FROM (SELECT tok, lead(tok) OVER (PARTITION BY tablet ORDER BY pos) AS nxt FROM ue))"""


def _repeats(tokens: DataFrame, *by: str) -> DataFrame:
    from pyspark.sql import Window

    nxt = F.lead("tok").over(Window.partitionBy(*by, "tablet").orderBy("pos"))
    return tokens.withColumn("nxt", nxt).groupBy(*by).agg(double(F.count_if(F.col("tok") == F.col("nxt"))).alias("t"))


@query(f"WITH {_null(1)} SELECT observed, count(*) FILTER (WHERE t >= observed) AS ge, round((1 + count(*) FILTER (WHERE t >= observed)) / (1.0 + count(*)), 6) AS p, round((observed - avg(t)) / stddev_pop(t), 6) AS z FROM no, ob GROUP BY observed", "ue")
def perm_pvalue(spark: SparkSession, d: str) -> DataFrame:
    t = src.user_events(spark, d)
    return rounded(rs.permutation_p(_repeats(t), _repeats(rs.shuffled(t, 19, 7), "replica"), "t"))


@query(f"WITH {_null(3)} SELECT observed, count(*) FILTER (WHERE t >= observed) AS ge, round(count(*) FILTER (WHERE t >= observed) / count(*)::DOUBLE, 6) AS p, round((observed - avg(t)) / stddev_pop(t), 6) AS z FROM no, ob GROUP BY observed", "ue")
def perm_pvalue_blocks(spark: SparkSession, d: str) -> DataFrame:
    t = src.user_events(spark, d)
    return rounded(rs.permutation_p(_repeats(t), _repeats(rs.shuffled(t, 19, 7, 3), "replica"), "t", plus_one=False))


@query(
    f"""WITH x AS (SELECT l_orderkey AS tablet, any_value(l_returnflag) AS stratum FROM (SELECT o_orderkey AS l_orderkey, o_orderstatus AS l_returnflag FROM orders) GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY {_DRAW.format("'42:' || tablet")}, tablet) AS k, count(*) OVER (PARTITION BY stratum) AS n FROM x)
 SELECT tablet, stratum, CASE WHEN k <= CASE WHEN n < 2 THEN n ELSE greatest(1, floor(n * 0.85)) END THEN 'train' ELSE 'validation' END AS part FROM r"""
)
def train_validation_split(spark: SparkSession, d: str) -> DataFrame:
    return rs.split(src.read(spark, d, "orders").select(F.col("o_orderkey").alias("tablet"), F.col("o_orderstatus").alias("stratum")), 0.85, 42)


@query(f"SELECT o_orderkey, o_totalprice FROM orders WHERE {_DRAW.format(chr(39) + '5:' + chr(39) + ' || o_orderkey')} < {int(0.1 * 2**32)}")
def hash_sample_orders(spark: SparkSession, d: str) -> DataFrame:
    return rs.sample(src.read(spark, d, "orders").select("o_orderkey", "o_totalprice"), "o_orderkey", 0.1, 5)


@query(f"SELECT stratum, round({h()}, 6) AS entropy FROM (SELECT stratum, tok, count(*) AS f FROM pb GROUP BY ALL) GROUP BY stratum", "pb")
def brand_entropy(spark: SparkSession, d: str) -> DataFrame:
    return rounded(info.unigram_stats(src.part_baskets(spark, d), "stratum").select("stratum", "entropy"))


def _bigrams(x: str, source: str, where: str) -> str:
    """SQL: a bigram model x of the places of `source` (c1, tok) that meet a condition."""
    return f"""u{x} AS (SELECT tok, count(*)::DOUBLE AS f FROM {source} WHERE {where} GROUP BY 1), z{x} AS (SELECT sum(f) AS un, count(*) AS uv FROM u{x}), g{x} AS (SELECT c1, tok, count(*) AS f FROM {source} WHERE {where} GROUP BY ALL), s{x} AS (SELECT c1, {_KS} FROM g{x} GROUP BY c1),
 n{x} AS (SELECT *, n1 / nullif(n1 + 2 * n2, 0)::DOUBLE AS y FROM (SELECT count(*) FILTER (WHERE f = 1) AS n1, count(*) FILTER (WHERE f = 2) AS n2, count(*) FILTER (WHERE f = 3) AS n3, count(*) FILTER (WHERE f = 4) AS n4 FROM g{x})), d{x} AS (SELECT {_cut(1)}, {_cut(2)}, {_cut(3)} FROM n{x})"""


def _scored(x: str, source: str, unseen: str = "p1") -> str:
    """SQL: the places of `source` with p under model x."""
    p = "(coalesce(u.f, 0) + 1) / (un + uv)"
    return f"SELECT e.*, {_fold('p1', 'g.f', 's', 'q').replace('THEN p1 ELSE', f'THEN {unseen} ELSE')} AS p FROM (SELECT e.*, {p} AS p1 FROM {source} e LEFT JOIN u{x} u ON u.tok = e.tok, z{x}) e LEFT JOIN s{x} s ON s.c1 = e.c1 LEFT JOIN g{x} g ON g.c1 = e.c1 AND g.tok = e.tok, d{x} q"


def _places(table: str, name: str) -> str:
    stops = f"SELECT tablet, any_value(stratum), max(pos) + 1, '</s>' FROM {table} GROUP BY tablet"
    return f"{name} AS (SELECT tablet, stratum, pos AS i, tok, coalesce(lag(tok) OVER (PARTITION BY tablet ORDER BY pos), '<s>') AS c1 FROM (SELECT tablet, stratum, pos, tok FROM {table} UNION ALL {stops}))"


_TWO = f"{_places('ue', 'bg')}, {_bigrams('a', 'bg', 'stratum = ' + repr('pre'))}, {_bigrams('b', 'bg', 'stratum = ' + repr('post'))}"
_WEIGHTS = {"pre": 0.7, "post": 0.2}


def _languages(spark: SparkSession, d: str) -> tuple[DataFrame, dict]:
    t = src.user_events(spark, d)
    return t, lm.train_by_stratum(t, ["pre", "post"], [2])


@query(f"WITH {_TWO}, x AS (SELECT 'pre' AS lang, * FROM ({_scored('a', 'bg')}) UNION ALL SELECT 'post', * FROM ({_scored('b', 'bg')})) SELECT tablet, lang, 2::INT AS n, round(sum(log2(p)), 6) AS lp FROM x GROUP BY ALL UNION ALL SELECT tablet, 'none', 2, round(-20.0 * count(*), 6) FROM ue GROUP BY tablet", "ue")
def lm_per_language(spark: SparkSession, d: str) -> DataFrame:
    t, models = _languages(spark, d)
    return rounded(lm.per_language(t, models, ["pre", "post", "none"], [2]))


def _ensemble(places: str) -> str:
    return f"x AS (SELECT 0.7 AS w, * FROM ({_scored('a', places)}) UNION ALL SELECT 0.2, * FROM ({_scored('b', places)})), y AS (SELECT tablet, w, sum(log2(p)) AS lp FROM x GROUP BY ALL), r AS (SELECT tablet, sum(w * lp) / sum(w) AS lp FROM y GROUP BY tablet)"


@query(f"WITH {_TWO}, {_ensemble('bg')} SELECT tablet, round(lp, 6) AS lp, 0::BIGINT AS oov, 1.0::DOUBLE AS coverage FROM r", "ue")
def lm_score(spark: SparkSession, d: str) -> DataFrame:
    t, models = _languages(spark, d)
    return rounded(lm.ensemble(t, models, _WEIGHTS))


_MAP = "mp AS (SELECT tok, max(other) AS symbol FROM (SELECT a.tok, b.tok AS other FROM (SELECT DISTINCT tok FROM ue) a JOIN (SELECT DISTINCT tok FROM ue) b ON b.tok < a.tok) GROUP BY tok), mu AS (SELECT tablet, stratum, pos, coalesce(symbol, '<UNK>') AS tok FROM ue LEFT JOIN mp USING (tok))"


@query(f"WITH {_MAP}, {_TWO}, {_places('mu', 'bm')}, {_ensemble('bm')} SELECT tablet, round(lp, 6) AS lp, 0::BIGINT AS oov, 1.0::DOUBLE AS coverage FROM r", "ue")
def lm_score_with_map(spark: SparkSession, d: str) -> DataFrame:
    t, models = _languages(spark, d)
    types = t.select("tok").distinct()
    symbols = types.join(types.select(F.col("tok").alias("other")), F.col("other") < F.col("tok")).groupBy("tok").agg(F.max("other").alias("symbol"))  # event types
    return rounded(lm.ensemble(lm.mapped(t, symbols), models, _WEIGHTS))


_CHANGED = "cu AS (SELECT tablet, stratum, pos, CASE WHEN pos % 10 = 3 THEN (SELECT min(tok) FROM ue) ELSE tok END AS tok FROM ue WHERE tablet IN (SELECT tablet FROM ue WHERE pos = 3))"


@query(
    f"WITH {_CHANGED}, {_TWO}, {_places('cu', 'bc')}, {_ensemble('bc')}, {_ensemble('bg').replace('x AS (', 'x0 AS (', 1).replace('y AS (', 'y0 AS (', 1).replace('FROM x GROUP', 'FROM x0 GROUP').replace('r AS (', 'r0 AS (', 1).replace('FROM y GROUP', 'FROM y0 GROUP')} SELECT tablet, round(r.lp - r0.lp, 6) AS delta FROM r JOIN r0 USING (tablet)",
    "ue",
)
def lm_score_delta(spark: SparkSession, d: str) -> DataFrame:
    t, models = _languages(spark, d)
    first = t.agg(F.min("tok").alias("new"))
    changes = t.where("pos % 10 = 3").select("tablet", "pos").crossJoin(F.broadcast(first))
    return rounded(lm.score_delta(t, changes, models, _WEIGHTS)).select("tablet", (F.col("delta") + 0.0).alias("delta"))


@query(f"WITH {_places('dw', 'bw')}, en AS (SELECT * FROM bw WHERE stratum = 'en'), {_bigrams('a', 'bw', 'stratum = ' + repr('fr'))}, {_bigrams('b', 'bw', 'stratum = ' + repr('en'))}, o AS ({_scored('b', 'en')}), o2 AS (SELECT tablet, stratum, i, tok, c1, p AS other FROM o), x AS ({_scored('a', 'o2', '0.85 * p1 + 0.15 * other')}) SELECT tablet, count(*) AS grams, round(sum(log2(p)), 4) AS lp FROM x GROUP BY tablet", "dw")
def kn_backoff(spark: SparkSession, d: str) -> DataFrame:
    # Words are never null. Said here, it holds for every reading of the counts, which then share one shuffle.
    places = {s: lm.events(src.doc_sequences(spark, d).where(F.col("stratum") == s), 2).where("c1 is not null and tok is not null") for s in ("en", "fr")}
    model = {s: lm.counted(own, 2) for s, own in places.items()}
    # The English model's bigrams are the distinct grams of the places.
    p = lm.graded(model["en"][2].withColumnRenamed("f", "f_second"), 2, model["fr"], model["en"], from_order=2)
    own = places["en"].join(p, ["c1", "tok"]).select("tablet", F.log2(F.greatest("p", F.lit(1e-300))).alias("lp"))
    return rounded(own.groupBy("tablet").agg(F.count("*").alias("grams"), F.sum("lp").alias("lp")), 4)
