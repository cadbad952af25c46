"""Queries on codes, dates and transcribed text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.functions import codes as co
from seqloom.functions.stats import rounded
from seqloom.plans.registry import query
from seqloom.sources import adapters as src

# Codes made from part keys: plain, with a variant, inverted, uncertain, compound, with modifiers, unreadable.
_CODE = "lpad((p_partkey % 799)::VARCHAR, 3, '0') || CASE p_partkey % 9 WHEN 0 THEN '' WHEN 1 THEN 'a' WHEN 2 THEN 'f!' WHEN 3 THEN '?' WHEN 4 THEN '.076' WHEN 5 THEN 'Va' WHEN 6 THEN ':010-0' WHEN 7 THEN ';3' ELSE ' x' END"


def _codes(spark: SparkSession, d: str) -> DataFrame:
    own = src.read(spark, d, "part")
    tail = F.element_at(F.array(*[F.lit(x) for x in ("", "a", "f!", "?", ".076", "Va", ":010-0", ";3", " x")]), (F.col("p_partkey") % 9 + 1).cast("int"))
    return own.select("p_partkey", "p_size", F.concat(F.lpad((F.col("p_partkey") % 799).cast("string"), 3, "0"), tail).alias("code"))


@query(
    f"""WITH c AS (SELECT p_partkey, {_CODE} AS code FROM part), b AS (SELECT *, regexp_replace(code, '[!?]', '', 'g') AS bare FROM c), u AS (SELECT *, code = '?' OR starts_with(code, '(') OR regexp_matches(bare, '[-.;:]') OR NOT regexp_matches(bare, '^[0-9]{{1,3}}[a-zA-Z]*$') AS bad, regexp_extract(bare, '^[0-9]{{1,3}}([a-zA-Z]*)$', 1) AS letters FROM b)
 SELECT p_partkey, CASE WHEN NOT bad THEN regexp_extract(bare, '^([0-9]{{1,3}})', 1) || regexp_extract(letters, '^([a-z])', 1) END AS base, contains(code, '!') AS inverted, contains(code, '?') AS uncertain, CASE WHEN bad THEN '' ELSE substr(letters, length(regexp_extract(letters, '^([a-z])', 1)) + 1) END AS modifiers FROM u"""
)
def code_parse(spark: SparkSession, d: str) -> DataFrame:
    return _codes(spark, d).select("p_partkey", co.parse_code(F.col("code")).alias("c")).select("p_partkey", "c.*")


@query(
    f"""SELECT p_partkey, array_to_string(list_filter(list_transform(regexp_split_to_array({_CODE}, '[.\\-:;''’]'), lambda x: regexp_replace(trim(regexp_replace(x, '[!?]+$', '')), '^0+(.)', '\\1')), lambda x: regexp_matches(x, '^[0-9]')), '|') AS parts FROM part"""
)
def compound_parts(spark: SparkSession, d: str) -> DataFrame:
    return _codes(spark, d).select("p_partkey", F.array_join(co.parts(F.col("code")), "|").alias("parts"))


@query(f"SELECT CASE WHEN regexp_matches(code, '[:.]') THEN 'ligature' WHEN contains(code, ';') THEN 'multi_sign' WHEN regexp_matches(code, '\\(.*-.*\\)|^[0-9]+-[0-9]+') THEN 'range_notation' WHEN regexp_matches(code, '[()-]') THEN 'compound' ELSE 'simple' END AS kind, count(*) AS n, count(DISTINCT code) AS codes FROM (SELECT {_CODE} AS code FROM part) GROUP BY 1")
def code_kinds(spark: SparkSession, d: str) -> DataFrame:
    return _codes(spark, d).groupBy(co.kind(F.col("code")).alias("kind")).agg(F.count("*").alias("n"), F.count_distinct("code").alias("codes"))


@query(
    f"""WITH c AS (SELECT p_partkey, {_CODE} AS code FROM part), n AS (SELECT *, try_cast(regexp_replace(code, '[^0-9]', '', 'g') AS INT) AS n FROM c)
 SELECT p_partkey, CASE WHEN n IS NULL THEN 'unknown' WHEN n BETWEEN 200 AND 299 THEN 'anthropomorphic_head' || (n // 10 % 10) WHEN n BETWEEN 1 AND 199 THEN 'objects_plants_phenomena' WHEN n BETWEEN 300 AND 399 THEN 'anthropomorphic_300series' WHEN n BETWEEN 400 AND 499 THEN 'miscellaneous_400s' WHEN n BETWEEN 500 AND 599 THEN 'miscellaneous_500s' WHEN n BETWEEN 600 AND 699 THEN 'bird_headed' WHEN n BETWEEN 700 AND 799 THEN 'zoomorphic' ELSE 'compound_or_other' END AS grp, try_cast(regexp_replace(split_part(code, '.', 1), '[^0-9]', '', 'g') AS INT) AS base_number, regexp_replace(lower(trim(code)), '(^|[^0-9])0+([0-9])', '\\1\\2', 'g') AS stripped FROM n"""
)
def code_groups(spark: SparkSession, d: str) -> DataFrame:
    c = F.col("code")
    return _codes(spark, d).select("p_partkey", co.implicit_group(c).alias("grp"), co.base_number(c).alias("base_number"), co.strip_zeros(c).alias("stripped"))


@query(
    """WITH f AS (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN chr((65 + p_partkey % 26)::INT) || 'v' || (p_partkey % 12) WHEN 1 THEN chr((65 + p_partkey % 26)::INT) || 'r' || (p_partkey % 9) || '/Bb12' WHEN 2 THEN chr((65 + p_partkey % 26)::INT) ELSE 'x' || p_partkey END AS t FROM part), h AS (SELECT p_partkey, split_part(t, '/', 1) AS h FROM f)
 SELECT p_partkey, CASE WHEN regexp_matches(h, '^[A-Z]([abrv][0-9]+|$)') THEN h[1] ELSE '?' END AS tablet, CASE WHEN regexp_matches(h, '^[A-Z][abrv][0-9]+') THEN translate(h[2], 'rv', 'ab') ELSE 'a' END AS side, CASE WHEN regexp_matches(h, '^[A-Z][abrv][0-9]+') THEN regexp_extract(h, '^[A-Z][abrv]([0-9]+)', 1)::INT ELSE -1 END AS line FROM h"""
)
def line_field_parse(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    letter = F.char((65 + k % 26).cast("int"))
    text = F.when(k % 4 == 0, F.concat(letter, F.lit("v"), k % 12)).when(k % 4 == 1, F.concat(letter, F.lit("r"), k % 9, F.lit("/Bb12"))).when(k % 4 == 2, letter).otherwise(F.concat(F.lit("x"), k))
    return src.read(spark, d, "part").select("p_partkey", co.line_field(text).alias("f")).select("p_partkey", "f.*")


@query("""SELECT p_partkey, array_to_string(list_filter(list_transform(regexp_split_to_array(replace(replace(p_name || '!.04' || '-' || p_size || '#x', '!', ''), ' ', '.'), '[.\\-]'), lambda x: trim(regexp_replace(x, '[\\t#].*$', ''))), lambda x: x <> ''), '|') AS codes FROM part""")
def sequence_parse(spark: SparkSession, d: str) -> DataFrame:
    text = F.replace(F.concat("p_name", F.lit("!.04-"), "p_size", F.lit("#x")), F.lit(" "), F.lit("."))
    return src.read(spark, d, "part").select("p_partkey", F.array_join(co.code_sequence(text), "|").alias("codes"))


@query(
    """WITH x AS (SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN 1500 + o_orderkey % 300 END AS med, 1400 + o_orderkey % 200 AS lo, 1500 + o_orderkey % 300 AS hi FROM orders)
 SELECT o_orderkey, CASE WHEN med IS NOT NULL THEN med::DOUBLE ELSE (lo + hi) / 2.0 END AS midpoint, CASE WHEN o_orderkey % 7 = 0 THEN 'given' WHEN hi <= 1600 THEN 'pre' WHEN lo >= 1650 THEN 'post' ELSE 'undated' END AS stratum, round(CASE WHEN hi = lo THEN 0.5 ELSE least(1, greatest(0, (1550 - lo) / (hi - lo)::DOUBLE)) END, 6) AS prior FROM x WHERE lo <= hi"""
)
def dating(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    own = src.read(spark, d, "orders").select("o_orderkey", F.when(k % 5 == 0, 1500 + k % 300).alias("med"), (1400 + k % 200).alias("lo"), (1500 + k % 300).alias("hi")).where("lo <= hi")
    return rounded(own.select("o_orderkey", co.midpoint(F.col("med"), F.col("lo"), F.col("hi")).alias("midpoint"), co.stratum_of_dates(F.when(k % 7 == 0, "given"), F.col("lo"), F.col("hi")).alias("stratum"), co.clamped_prior(1550, F.col("lo"), F.col("hi")).alias("prior")))


@query(
    """WITH p AS (SELECT count(*) FILTER (WHERE c_nationkey < 5)::DOUBLE AS a, count(*) FILTER (WHERE c_nationkey BETWEEN 5 AND 14)::DOUBLE AS b FROM customer)
 SELECT c_custkey, CASE WHEN c_nationkey = 24 THEN 'excluded' WHEN c_nationkey < 5 THEN 'pre' WHEN c_nationkey < 15 THEN 'post' ELSE 'unknown' END AS cluster, round(CASE WHEN c_nationkey = 24 THEN 0 WHEN c_nationkey < 5 THEN 1 WHEN c_nationkey < 15 THEN 0 ELSE a / (a + b) END, 6) AS p_pre FROM customer, p"""
)
def cluster_probability(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("c_nationkey")
    own = src.read(spark, d, "customer").select("c_custkey", F.when(n == 24, "excluded").when(n < 5, "pre").when(n < 15, "post").otherwise("unknown").alias("cluster"))
    prior = own.agg((F.count_if(F.col("cluster") == "pre") / F.count_if(F.col("cluster").isin("pre", "post"))).alias("prior"))
    p = F.when(F.col("cluster") == "pre", 1.0).when(F.col("cluster") == "unknown", F.col("prior")).otherwise(0.0)
    return rounded(own.crossJoin(F.broadcast(prior)).select("c_custkey", "cluster", p.alias("p_pre")))


@query(
    """WITH s AS (SELECT doc_id, regexp_extract_all(lower(text), '((?:ng|[ghkmnprtv])?[aeiou])', 1) AS w FROM documents)
 SELECT doc_id, len(w)::INT AS n, len(list_filter(list_transform(w, lambda t: regexp_replace(t, '^ng', 'g')), lambda t: regexp_matches(t, '^(?:[hklmnpw]?[aeiou])$')))::INT AS valid FROM s"""
)
def syllable_clean(spark: SparkSession, d: str) -> DataFrame:
    own = src.read(spark, d, "documents").select("doc_id", src.syllables(F.col("text")).alias("w"))
    return own.select("doc_id", F.size("w").alias("n"), F.size(co.clean_syllables(F.col("w"), "hawaiian")).alias("valid"))


@query(
    """WITH s AS (SELECT source, doc_id, list_filter(regexp_split_to_array(lower(text), '[^a-z]+'), lambda x: x <> '') AS w FROM documents), v AS (SELECT source, len(w) AS n, len(list_filter(w, lambda x: regexp_matches(x, '^(?:(?:ng|[fhkmnprtv])?[aeiou])+$'))) AS k FROM s)
 SELECT source, sum(n)::BIGINT AS n_words, sum(k)::BIGINT AS valid, round(sum(k) / sum(n)::DOUBLE, 6) AS share FROM v GROUP BY ROLLUP (source)"""
)
def valid_words_by_source(spark: SparkSession, d: str) -> DataFrame:
    own = src.read(spark, d, "documents").select("source", src.words(F.col("text")).alias("w"))
    own = own.select("source", F.size("w").alias("n"), F.size(F.filter("w", co.is_word)).alias("k"))
    return rounded(own.rollup("source").agg(F.sum("n").alias("n_words"), F.sum("k").alias("valid"), (F.sum("k") / F.sum("n")).alias("share")))


@query("""SELECT page_id, array_to_string(list_sort(list_distinct(list_filter(list_transform(regexp_extract_all(html, '<h1[^>]*>([^<]*)</h1>', 1), lambda x: trim(x)), lambda x: x <> ''))), '|') AS words FROM pages""")
def headwords(spark: SparkSession, d: str) -> DataFrame:
    return src.read(spark, d, "pages").select("page_id", F.array_join(co.headwords(F.col("html"), "h1"), "|").alias("words"))


@query("""SELECT l_orderkey, substr(md5(len(c) || ':' || array_to_string(list_sort(list_distinct(c)), ',')), 1, 8) AS fp FROM (SELECT l_orderkey, list((l_partkey % 50)::VARCHAR) AS c FROM lineitem GROUP BY ALL)""")
def fingerprint_codes(spark: SparkSession, d: str) -> DataFrame:
    own = src.read(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_list((F.col("l_partkey") % 50).cast("string")).alias("c"))
    return own.select("l_orderkey", co.fingerprint(F.col("c")).alias("fp"))


@query("""WITH f AS (SELECT tablet, list(tok ORDER BY pos) AS f FROM ue GROUP BY tablet) SELECT tablet, array_to_string(list_filter(range(len(f)), lambda i: f[i + 1] = 'error'), ',') AS places, array_to_string(list_filter(f, lambda x: x <> 'error'), ' ') AS rest FROM f""", "ue")
def taxogram_tags(spark: SparkSession, d: str) -> DataFrame:
    f = F.transform(F.array_sort(F.collect_list(F.struct("pos", "tok"))), lambda x: x["tok"])
    own = src.user_events(spark, d).groupBy("tablet").agg(f.alias("f"))
    return own.select("tablet", F.array_join(co.places_of(F.col("f"), F.lit("error")).cast("array<string>"), ",").alias("places"), F.array_join(F.filter("f", lambda x: x != "error"), " ").alias("rest"))


@query("""SELECT doc_id, trim(regexp_replace(regexp_replace(translate(lower(regexp_replace(text, '[\\[\\](){}]', '', 'g')), 'àáâãäåèéêëìíîïòóôõöùúûüçñýÿ', 'aaaaaaeeeeiiiiooooouuuucnyy'), '[^a-z0-9'' ]', ' ', 'g'), ' +', ' ', 'g')) AS plain FROM documents""")
def text_normalise(spark: SparkSession, d: str) -> DataFrame:
    return src.read(spark, d, "documents").select("doc_id", co.normalised(F.col("text")).alias("plain"))


@query(
    """WITH t AS (SELECT n_name AS k, n_regionkey AS tier FROM nation), x AS (SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN n_name WHEN 1 THEN replace(n_name, '_', ' _') ELSE 'zz' END AS s FROM customer JOIN nation ON n_nationkey = c_nationkey)
 SELECT c_custkey, coalesce(a.tier, b.tier, -1) AS tier FROM x LEFT JOIN t a ON a.k = s LEFT JOIN t b ON b.k = replace(s, ' ', '')"""
)
def tier_resolve(spark: SparkSession, d: str) -> DataFrame:
    """Exact key, then key without spaces, then unclassified: ordered left joins."""
    nation = src.read(spark, d, "nation")
    t = nation.select(F.col("n_name").alias("k"), F.col("n_regionkey").alias("tier"))
    x = src.read(spark, d, "customer").join(F.broadcast(nation), F.col("c_nationkey") == F.col("n_nationkey"))
    k = F.col("c_custkey")
    x = x.select("c_custkey", F.when(k % 3 == 0, F.col("n_name")).when(k % 3 == 1, F.replace("n_name", F.lit("_"), F.lit(" _"))).otherwise("zz").alias("s"))
    a, b = t.select(F.col("k").alias("k1"), F.col("tier").alias("t1")), t.select(F.col("k").alias("k2"), F.col("tier").alias("t2"))
    out = x.join(F.broadcast(a), x["s"] == F.col("k1"), "left").join(F.broadcast(b), F.replace("s", F.lit(" "), F.lit("")) == F.col("k2"), "left")
    return out.select("c_custkey", F.coalesce("t1", "t2", F.lit(-1)).alias("tier"))


# A catalog of signs from the part table: every fifth number is known, variants have a canonical sign, sizes are families.
_SIGNS = """sg AS (SELECT DISTINCT (p_partkey % 500)::VARCHAR AS code, 'fam' || (p_partkey % 500 % 7) AS fam, p_partkey % 500 % 11 = 0 AS taxogram FROM part WHERE p_partkey % 5 = 0),
 al AS (SELECT DISTINCT (p_partkey % 500)::VARCHAR AS code, (p_partkey % 500 // 10 * 10)::VARCHAR AS canonical FROM part WHERE p_partkey % 3 = 0),
 q AS (SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN lpad((p_partkey % 500)::VARCHAR, 3, '0') WHEN 1 THEN (p_partkey % 500)::VARCHAR ELSE (p_partkey % 500) || 'a' END AS code FROM part)"""


@query(
    f"""WITH {_SIGNS}, g AS (SELECT canonical, list(code ORDER BY code) AS members FROM (SELECT code, canonical FROM al UNION SELECT canonical, canonical FROM al) GROUP BY 1), z AS (SELECT *, regexp_replace(code, '^0+([0-9])', '\\1') AS bare, regexp_replace(code, '[^0-9]', '', 'g') AS digits FROM q)
 SELECT p_partkey, a.code IS NOT NULL OR b.code IS NOT NULL AS known, coalesce(a.fam, b.fam, c.fam, e.fam, 'unknown') AS family, coalesce(x.canonical, z.code) AS canonical, coalesce(a.taxogram, false) AS taxogram, array_to_string(coalesce(g.members, [z.code]), ' ') AS variants
 FROM z LEFT JOIN sg a ON a.code = z.code LEFT JOIN sg b ON b.code = z.bare LEFT JOIN sg c ON c.code = lpad(ltrim(z.digits, '0'), 3, '0') LEFT JOIN sg e ON e.code = ltrim(z.digits, '0') LEFT JOIN al x ON x.code = z.code LEFT JOIN g ON g.canonical = coalesce(x.canonical, z.code)"""
)
def catalog_lookup(spark: SparkSession, d: str) -> DataFrame:
    part, no = src.read(spark, d, "part"), F.col("p_partkey") % 500
    signs = part.where("p_partkey % 5 = 0").select(no.cast("string").alias("code"), F.concat(F.lit("fam"), (no % 7).cast("string")).alias("family"), (no % 11 == 0).alias("taxogram")).distinct()
    variants = part.where("p_partkey % 3 = 0").select(no.cast("string").alias("code"), (F.floor(no / 10) * 10).cast("string").alias("canonical")).distinct()
    code = F.when(F.col("p_partkey") % 3 == 0, F.lpad(no.cast("string"), 3, "0")).when(F.col("p_partkey") % 3 == 1, no.cast("string")).otherwise(F.concat(no.cast("string"), F.lit("a")))
    return co.catalogued(part.select("p_partkey", code.alias("code")), signs, variants).select("p_partkey", "known", "family", "canonical", "taxogram", F.array_join("variants", " ").alias("variants"))


@query(
    f"""WITH c AS (SELECT p_partkey, {_CODE} AS code FROM part), n AS (SELECT *, try_cast(regexp_replace(split_part(code, '.', 1), '[^0-9]', '', 'g') AS INT) AS base, try_cast(left(regexp_replace(code, '[^0-9]', '', 'g'), 3) AS INT) AS three FROM c)
 SELECT p_partkey, coalesce(try_cast(regexp_extract(code, '^([0-9]+)', 1) AS BIGINT) <> 0, false) AS glyph, coalesce(base BETWEEN 600 AND 699, false) AS bird_headed, coalesce(three BETWEEN 600 AND 799, false) AS iconographic FROM n"""
)
def code_checks(spark: SparkSession, d: str) -> DataFrame:
    c = F.col("code")
    bird = F.coalesce(co.base_number(c).between(600, 699), F.lit(False))
    return _codes(spark, d).select("p_partkey", co.is_glyph(c).alias("glyph"), bird.alias("bird_headed"), co.in_ranges(c, [(600, 699), (700, 799)]).alias("iconographic"))


@query("SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN 'pre_contact' WHEN 1 THEN 'post_contact' WHEN 2 THEN 'pre_contact' ELSE 'undated' END AS stratum, round(CASE WHEN p > 0 THEN -p * log2(p) ELSE 0 END + CASE WHEN p < 1 THEN -(1 - p) * log2(1 - p) ELSE 0 END, 6) AS entropy FROM (SELECT o_orderkey, (o_orderkey % 11) / 10.0::DOUBLE AS p FROM orders)")
def strata_and_entropy(spark: SparkSession, d: str) -> DataFrame:
    from seqloom.functions import stats

    label = F.element_at(F.array(*[F.lit(x) for x in (" PRE", "Late ", "pre_contact", "early", "other")]), (F.col("o_orderkey") % 5 + 1).cast("int"))
    p = (F.col("o_orderkey") % 11) / F.lit(10.0)
    return src.read(spark, d, "orders").select("o_orderkey", co.stratum(label).alias("stratum"), F.round(stats.dating_entropy(p, 1 - p), 6).alias("entropy"))


@query("SELECT p_partkey, round(levenshtein(a, b) / greatest(length(a), length(b), 1)::DOUBLE, 6) AS distance FROM (SELECT p_partkey, regexp_replace(lower(p_type), '[^a-z]', '', 'g')[1:8] AS a, regexp_replace(lower(p_name), '[^a-z]', '', 'g')[1:p_partkey % 9] AS b FROM part)")
def token_distances(spark: SparkSession, d: str) -> DataFrame:
    from seqloom.functions import stats

    bare = lambda c: F.regexp_replace(F.lower(c), "[^a-z]", "")
    split = lambda c: F.filter(F.split(c, ""), lambda x: x != "")
    a, b = split(F.substring(bare("p_type"), 1, 8)), split(F.substring(bare("p_name"), F.lit(1), (F.col("p_partkey") % 9).cast("int")))
    own = src.read(spark, d, "part").select("p_partkey", a.alias("a"), b.alias("b"))
    return own.select("p_partkey", F.round(stats.token_distance(F.col("a"), F.col("b")), 6).alias("distance"))
