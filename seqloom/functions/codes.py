"""Parsing and normalising of sign codes, dates, strata and transcribed text, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Marks that join codes, syllable patterns, folded letters, weights of certainty.
SEPARATORS = r"[.\-:;'’]"
SYLLABLE = {"rapanui": "(?:ng|[ghkmnprtv])?[aeiou]", "hawaiian": "[hklmnpw]?[aeiou]", "maori": "(?:ng|wh|[hkmnprtw])?[aeiou]"}
ACCENTED, PLAIN = "àáâãäåèéêëìíîïòóôõöùúûüçñýÿ", "aaaaaaeeeeiiiiooooouuuucnyy"


# Groups of sign numbers.
GROUPS = [
    (1, 199, "objects_plants_phenomena"),
    (300, 399, "anthropomorphic_300series"),
    (400, 499, "miscellaneous_400s"),
    (500, 599, "miscellaneous_500s"),
    (600, 699, "bird_headed"),
    (700, 799, "zoomorphic"),
]

def parse_code(code: Column) -> Column:
    """Struct of base (null if unreadable or compound), inverted, uncertain, modifiers."""
    bare = F.regexp_replace(code, "[!?]", "")
    unreadable = (code == "?") | code.startswith("(") | bare.rlike("[-.;:]") | ~bare.rlike("^[0-9]{1,3}[a-zA-Z]*$")
    digits, letters = F.regexp_extract(bare, "^([0-9]{1,3})", 1), F.regexp_extract(bare, "^[0-9]{1,3}([a-zA-Z]*)$", 1)
    variant = F.regexp_extract(letters, "^([a-z])", 1)
    return F.struct(
        F.when(~unreadable, F.concat(digits, variant)).alias("base"),
        F.contains(code, F.lit("!")).alias("inverted"),
        F.contains(code, F.lit("?")).alias("uncertain"),
        F.when(unreadable, "").otherwise(F.substring(letters, F.length(variant) + 1, F.lit(99))).alias("modifiers"),
    )


def parts(code: Column) -> Column:
    """Components of a compound: no marks, no leading zeros, those that start with a digit."""
    cut = F.transform(F.split(code, SEPARATORS), lambda x: F.regexp_replace(F.trim(F.regexp_replace(x, "[!?]+$", "")), "^0+(?=.)", ""))
    return F.when(code.startswith("("), F.array().cast("array<string>")).otherwise(F.filter(cut, lambda x: x.rlike("^[0-9]")))


def strip_zeros(code: Column) -> Column:
    """Lower case, without leading zeros in any run of digits; an all-zero run keeps one."""
    return F.regexp_replace(F.lower(F.trim(code)), r"(?<![0-9])0+(?=[0-9])", "")


def canonical_base(code: Column) -> Column:
    """The leading number of a code in three digits; null for compounds, ranges and codes without a number."""
    return F.when(~code.rlike("[-.:;(]"), F.lpad(F.nullif(F.regexp_extract(code, "^([0-9]{1,3})", 1), F.lit("")), 3, "0"))


def kind(code: Column) -> Column:
    """ligature, multi_sign, range_notation (a range in brackets or at the start), compound; simple without any separator."""
    span = r"\(.*-.*\)|^[0-9]+-[0-9]+"
    return F.when(code.rlike("[:.]"), "ligature").when(code.rlike(";"), "multi_sign").when(code.rlike(span), "range_notation").when(code.rlike(r"[()-]"), "compound").otherwise("simple")


def base_number(code: Column) -> Column:
    return F.regexp_replace(F.split_part(code, F.lit("."), F.lit(1)), "[^0-9]", "").try_cast("int")


def implicit_group(code: Column) -> Column:
    """The group of the number; 200 to 299 by the tens digit; unknown without digits, compound_or_other outside 1 to 799."""
    n = F.regexp_replace(code, "[^0-9]", "").try_cast("decimal(38,0)")
    out = F.when(n.isNull(), "unknown").when(n.between(200, 299), F.concat(F.lit("anthropomorphic_head"), (F.floor(n / 10) % 10).cast("int").cast("string")))
    for lo, hi, name in GROUPS:
        out = out.when(n.between(lo, hi), name)
    return out.otherwise("compound_or_other")


def is_glyph(code: Column, blocked: tuple[int, ...] = (0,)) -> Column:
    """Whether the code begins with a number that isn't one of the blocked ones, which stand for no sign."""
    n = F.regexp_extract(code, "^([0-9]+)", 1).try_cast("decimal(38,0)")
    return F.coalesce(~n.isin(*blocked), F.lit(False)) if blocked else n.isNotNull()


def in_ranges(code: Column, ranges: list[tuple[int, int]]) -> Column:
    """Whether the first three digits of the code make a number in one of the ranges."""
    n = F.substring(F.regexp_replace(code, "[^0-9]", ""), 1, 3).try_cast("int")
    found = F.lit(False)
    for lo, hi in ranges:
        found = found | n.between(lo, hi)
    return F.coalesce(found, F.lit(False))


def stratum(label: Column) -> Column:
    """pre_contact or post_contact of a label in any letter case; undated for all others."""
    own = F.lower(F.trim(label))
    return F.when(own.isin("pre_contact", "pre"), "pre_contact").when(own.isin("post_contact", "late"), "post_contact").otherwise("undated")


def canonical(allographs: Column, code: Column) -> Column:
    """The canonical sign of a variant; the code itself where the map has none."""
    return F.coalesce(F.try_element_at(allographs, code), code)


def known(signs: Column, code: Column) -> Column:
    """Whether the map of signs has the code, or the code without leading zeros."""
    return F.coalesce(F.map_contains_key(signs, code) | F.map_contains_key(signs, F.regexp_replace(code, "^0+(?=[0-9])", "")), F.lit(False))


def family(families: Column, code: Column) -> Column:
    """The curated family of the code, by the code, without leading zeros, or by its digits; else unknown."""
    return F.coalesce(lookup(families, code), F.lit("unknown"))


def lookup(table: Column, code: Column) -> Column:
    """A map's value for the code, the code without leading zeros, the padded number, the number; null without any."""
    digits = F.regexp_extract(code, "^0*([0-9]+)", 1)
    tries = [code, F.regexp_replace(code, "^0+(?=[0-9])", ""), F.lpad(digits, 3, "0"), digits]
    return F.coalesce(*[F.nullif(F.try_element_at(table, t), F.lit("")) for t in tries])


def catalogued(rows: DataFrame, signs: DataFrame, variants: DataFrame) -> DataFrame:
    """rows (code) with what a catalog says: known, family, canonical, taxogram, variants (all codes of the canonical sign's group, in
    order; the code alone without one). signs: code, family, taxogram; variants: code, canonical. A catalog of signs is small
    beside the rows; it joins by equality, and the optimiser broadcasts it where its size allows."""
    bare, digits = F.regexp_replace("code", "^0+(?=[0-9])", ""), F.ltrim(F.regexp_replace("code", "[^0-9]", ""), F.lit("0"))
    out = rows
    for k, key in enumerate((F.col("code"), bare, F.lpad(digits, 3, "0"), digits)):
        own = signs.select(F.col("code").alias("__key"), F.col("family").alias(f"__f{k}"), F.col("taxogram").alias(f"__t{k}"))
        out = out.join(own, key == F.col("__key"), "left").withColumn(f"__h{k}", F.col("__key").isNotNull()).drop("__key")
    groups = variants.select("code", "canonical").union(variants.select("canonical", "canonical")).groupBy("canonical").agg(F.array_sort(F.collect_set("code")).alias("variants"))
    out = out.join(variants.select(F.col("code").alias("__key"), "canonical"), F.col("code") == F.col("__key"), "left").drop("__key")
    out = out.withColumn("canonical", F.coalesce("canonical", "code")).join(groups, "canonical", "left")
    return out.select(
        *[rows[c] for c in rows.columns],
        (F.col("__h0") | F.col("__h1")).alias("known"),
        F.coalesce(*[f"__f{k}" for k in range(4)], F.lit("unknown")).alias("family"),
        "canonical",
        F.coalesce("__t0", F.lit(False)).alias("taxogram"),
        F.coalesce("variants", F.array("code")).alias("variants"),
    )


def tree_distance(a: Column, b: Column) -> Column:
    return F.when(a == b, 0).when(F.floor(a / 10) == F.floor(b / 10), 1).when(F.floor(a / 100) == F.floor(b / 100), 2).otherwise(3)


def line_field(text: Column) -> Column:
    """Struct of tablet, side (r is a, v is b), line: `Ev6/Bb12` is (E, b, 6), `A` is (A, a, -1), anything else (?, a, -1)."""
    head = F.split_part(text, F.lit("/"), F.lit(1))
    full, bare = head.rlike("^[A-Z][abrv][0-9]+"), head.rlike("^[A-Z]$")
    side = F.translate(F.substring(head, 2, 1), "rv", "ab")
    return F.struct(
        F.when(full | bare, F.substring(head, 1, 1)).otherwise("?").alias("tablet"),
        F.when(full, side).otherwise("a").alias("side"),
        F.when(full, F.regexp_extract(head, "^[A-Z][abrv]([0-9]+)", 1).try_cast("int")).otherwise(-1).alias("line"),
    )


def code_sequence(text: Column) -> Column:
    """Codes of a transcription: without `!`, cut at dots and hyphens, comments after a tab or `#` dropped."""
    cut = F.split(F.replace(text, F.lit("!"), F.lit("")), r"[.\-]")
    return F.filter(F.transform(cut, lambda x: F.trim(F.regexp_replace(x, "[\t#].*$", ""))), lambda x: x != "")


def midpoint(median: Column, low: Column, high: Column) -> Column:
    """The median date, or the middle of the range; a range in the wrong order raises."""
    bad = F.raise_error(F.lit("date range in the wrong order")).cast("double")
    return F.when(median.isNotNull(), median.cast("double")).when(low > high, bad).otherwise((low + high) / 2)


def stratum_of_dates(given: Column, low: Column, high: Column) -> Column:
    return F.when(given.isNotNull(), given).when(high <= 1600, "pre").when(low >= 1650, "post").otherwise("undated")


def clamped_prior(boundary: float, low: Column, high: Column) -> Column:
    """Share of a date range before the boundary, one half without dates."""
    share = F.try_divide(F.lit(boundary) - low, (high - low).cast("double"))
    return F.when(share.isNull(), 0.5).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), share)))


def fold(text: Column) -> Column:
    return F.translate(F.lower(text), ACCENTED, PLAIN)


def normalised(text: Column) -> Column:
    """No brackets, folded, letters, digits, apostrophes and single spaces only."""
    bare = F.regexp_replace(text, r"[\[\](){}]", "")
    return F.trim(F.regexp_replace(F.regexp_replace(fold(bare), "[^a-z0-9' ]", " "), " +", " "))


def is_syllable(token: Column, language: str) -> Column:
    return token.rlike(f"^(?:{SYLLABLE[language]})$")


def clean_syllables(tokens: Column, language: str) -> Column:
    """Initial ng written g, then valid ones only."""
    return F.filter(F.transform(tokens, lambda t: F.regexp_replace(t, "^ng", "g")), lambda t: is_syllable(t, language))


def is_word(word: Column) -> Column:
    """Open syllables only, no cluster of consonants but ng."""
    return word.rlike("^(?:(?:ng|[fhkmnprtv])?[aeiou])+$")


def fingerprint(codes: Column) -> Column:
    """Eight hexadecimal digits of md5 over the length and the sorted distinct codes."""
    return F.substring(F.md5(F.concat(F.size(codes).cast("string"), F.lit(":"), F.array_join(F.array_sort(F.array_distinct(codes)), ",")).cast("binary")), 1, 8)


def places_of(form: Column, code: Column) -> Column:
    """Places, from 0, of a code in a form."""
    return F.filter(F.transform(form, lambda x, i: F.when(x == code, i)), lambda i: i.isNotNull())


def headwords(html: Column, tag: str) -> Column:
    found = F.regexp_extract_all(html, F.lit(f"<{tag}[^>]*>([^<]*)</{tag}>"), 1)
    return F.array_sort(F.array_distinct(F.filter(F.transform(found, lambda x: F.trim(x)), lambda x: x != "")))
