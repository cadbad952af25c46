"""Profiles, passages and assignments on small tables: values by hand, brute force, empty tables."""

from __future__ import annotations

import math
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from seqloom.operators import contingency as con
from seqloom.operators import parallels as pa
from seqloom.operators import profiles as pr
from seqloom.operators import search as se
from seqloom.operators import structural as st

SCHEMA = "tablet long, pos int, tok string, side string, stratum string, boundary boolean"
TEXTS = {1: "abcabd", 2: "abxabc", 3: "ba", 4: "c", 5: "abcdabca", 6: "ccab"}


def table(spark, texts=None):
    rows = [(t, i, c, "a" if i < 3 else "b", "pre" if t % 2 else "post", i == 0) for t, s in (TEXTS if texts is None else texts).items() for i, c in enumerate(s)]
    return spark.createDataFrame(rows, SCHEMA)


def h(counts, base=2):
    n = sum(counts)
    return -sum(c / n * math.log(c / n, base) for c in counts if c)


def test_fingerprint_against_brute_force(spark):
    got = {r["tok"]: r for r in pr.fingerprint(table(spark), ["tablet", "side"], 2).collect()}
    freq = Counter("".join(TEXTS.values()))
    assert set(got) == {t for t, n in freq.items() if n >= 2}
    pairs = Counter((a, b) for s in TEXTS.values() for a, b in zip(s, s[1:]))
    bins = defaultdict(Counter)
    for s in TEXTS.values():
        for line in (s[:3], s[3:]):
            for i, c in enumerate(line):
                bins[c][min(int(i / max(len(line) - 1, 1) * 10), 9)] += 1
    for t, r in got.items():
        pred, succ = [n for (_, b), n in pairs.items() if b == t], {b for (a, b) in pairs if a == t}
        near = {b for (a, b) in pairs if a == t} | {a for (a, b) in pairs if b == t}
        assert r["neighbor_diversity"] == pytest.approx(len(near) / freq[t])
        assert r["slot_predictability"] == pytest.approx(max(0, 1 - h(pred) / math.log2(len(freq))) if pred else 0)
        assert r["direction_skew"] == pytest.approx((len(succ) - len(pred)) / (len(succ) + len(pred)))
        assert r["positional_entropy"] == pytest.approx(h(bins[t].values(), 10), abs=1e-12)
        assert r["own_frequency"] == pytest.approx(freq[t] / sum(freq.values()))
        assert r["betweenness"] == r["pagerank"] == 0


def test_central_measures_join(spark):
    central = spark.createDataFrame([("a", 0.5, 0.25)], "tok string, betweenness double, pagerank double")
    got = {r["tok"]: (r["betweenness"], r["pagerank"]) for r in pr.fingerprint(table(spark), ["tablet"], 2, central).collect()}
    assert got["a"] == (0.5, 0.25) and got["b"] == (0, 0)


def test_roles_by_hand(spark):
    cols = "tok string, frequency long, betweenness double, positional_entropy double, neighbor_diversity double, own_frequency double, slot_predictability double, passage_anchor_score double, direction_skew double"
    rows = [("skew", 20, 0.0, 0.5, 0.5, 0.1, 0.5, 0.0, 0.9), ("part", 40, 0.0, 0.1, 0.5, 0.6, 0.9, 0.6, 0.0), ("logo", 5, 0.0, 0.9, 0.5, 0.1, 0.1, 0.0, 0.9), ("rest", 5, 0.0, 0.5, 0.5, 0.1, 0.5, 0.0, 0.0)]
    got = {r["tok"]: (r["role"], r["subtype"], r["rule"]) for r in pr.assigned(spark.createDataFrame(rows, cols)).collect()}
    assert got == {"skew": ("taxogram", "determinative", "determinative:proclitic"), "part": ("taxogram", "anchor", "particle+anchor"), "logo": ("logogram", None, "logogram"), "rest": ("phonetic", None, "default")}


def test_side_orders_against_brute_force(spark):
    def perplexity(texts, held):
        counts, ctx, kinds = Counter(), Counter(), set("".join(texts.values()))
        for t, s in texts.items():
            if t != held:
                for a, b in zip("^" + s, s + "$"):
                    counts[a, b] += 1
                    ctx[a] += 1
        s = texts[held]
        lp = [math.log2((counts[a, b] + 0.5) / (ctx[a] + 0.5 * (len(kinds) + 2))) for a, b in zip("^" + s, s + "$")]
        return 2 ** (-sum(lp) / len(lp))

    turned = {t: s[3:] + s[:3] for t, s in TEXTS.items()}
    for r in pr.side_order(table(spark)).collect():
        assert r["ppl_ab"] == pytest.approx(perplexity(TEXTS, r["tablet"]))
        assert r["ppl_ba"] == pytest.approx(perplexity(turned, r["tablet"]))
        assert r["winner"] == ("ab" if r["ppl_ab"] < r["ppl_ba"] else "ba")
    assert pr.crossing_order(table(spark)).count() == 0
    assert pr.crossing_order(table(spark), 3).first()["n"] == 4


def test_change_periods_by_hand(spark):
    changes = spark.createDataFrame([("p", 0), ("p", 2), ("q", 1)], "passage string, at int")
    tablets = spark.createDataFrame(
        [("p", "A", "pre", []), ("p", "B", "post", [0]), ("p", "C", "undated", [2]), ("p", "D", "undated", None), ("p", "E", "excluded", [0])],
        "passage string, tablet string, stratum string, late array<int>",
    )
    got = {r["passage"]: tuple(r)[1:] for r in pa.change_periods(changes, tablets).collect()}
    assert got == {"p": (5, 1, 1, True), "q": (2, 0, 0, True)}


def test_shared_places_leave_out_passages_of_many(spark):
    forms = spark.createDataFrame([(p, t, t, 10, ["a", "b"]) for p, n in (("few", 3), ("many", 9)) for t in range(n)], "passage string, tablet int, ord int, start int, form array<string>")
    canonical = spark.createDataFrame([("few", ["a", "x"]), ("many", ["a", "b"])], "passage string, canonical array<string>")
    got = sorted((r["tablet_a"], r["pos_a"], r["tablet_b"], r["pos_b"]) for r in pa.shared_places(forms, canonical).collect())
    assert got == [(0, 10, 1, 10), (0, 10, 2, 10), (1, 10, 2, 10)]


def test_pair_features_are_bounded(spark):
    tokens = table(spark)
    forms = spark.createDataFrame([("p", 1, 1, 0, ["a", "b"]), ("p", 2, 2, 0, ["a", "c"])], "passage string, tablet long, ord int, start int, form array<string>")
    canonical = spark.createDataFrame([("p", ["a", "b"])], "passage string, canonical array<string>")
    vectors = spark.createDataFrame([("a", [1.0, 0.0])], "tok string, vector array<double>")
    pairs = spark.createDataFrame([(1, 0, "a", 2, 0, "a"), (1, 5, "d", 9, 0, "?")], "tablet_a long, pos_a int, tok_a string, tablet_b long, pos_b int, tok_b string")
    got = {r["tok_a"]: r for r in pa.pair_features(pairs, tokens, pa.token_stats(tokens, forms, canonical), pa.relative_pmi(tokens), vectors).collect()}
    assert len(got) == 2 and all(0 <= v <= 1 for r in got.values() for v in tuple(r)[6:])
    assert got["a"]["alike"] == pytest.approx(1) and got["a"]["ratio"] == 1 and got["d"]["alike"] == 0 and got["d"]["distance"] == 1


def test_corroboration(spark):
    changes = spark.createDataFrame([("a", "b"), ("b", "a"), ("c", "c"), ("a", "z")], "old string, new string")
    leans = spark.createDataFrame([("a", "pre"), ("b", "post"), ("c", "neutral")], "tok string, lean string")
    got = {(r["old"], r["new"]): r["evidence"] for r in pa.corroborated(changes, leans).collect()}
    assert got == {("a", "b"): "supports", ("b", "a"): "contradicts", ("c", "c"): "neutral", ("a", "z"): "supports"}


def test_choices_fall_back(spark):
    sample = spark.createDataFrame([("s", 0, "a", 0), ("s", 1, "b", 1), ("t", 0, "a", 0), ("t", 1, "b", 0)], "sign string, k int, value string, x int")
    assert {tuple(r) for r in se.chosen(sample).collect()} == {("s", "b"), ("t", "a")}
    reads = spark.createDataFrame([(1, 3, "s", "b", 1), (2, 1, "s", "b", 0)], "read int, occurrences long, sign string, value string, x int")
    assert {tuple(r) for r in se.choice_confidence(sample, reads).collect()} == {("s", "b", 0.75), ("t", "a", 0.0)}
    assert {r["confidence"] for r in se.choice_confidence(sample, reads.where("false")).collect()} == {1.0}


def test_best_slope_takes_the_first_of_equals(spark):
    spectrum = spark.createDataFrame([(0, 2), (1, -4), (2, 4)], "s long, w long")
    assert tuple(st.best_affine(spectrum, 2).first()) == (1, -4, 1, 1.0)


def test_empty_tables(spark):
    none = table(spark, {})
    forms = spark.createDataFrame([], "passage string, tablet long, ord int, start int, form array<string>")
    canonical = spark.createDataFrame([], "passage string, canonical array<string>")
    features = pr.fingerprint(none, ["tablet"])
    assert features.count() == 0 and pr.assigned(features).count() == 0
    assert tuple(pr.thresholds(features).first()) == (0, 0, 0, 0, 0, pytest.approx(1 / 3))
    assert pr.role_stability(pr.assigned(features), pr.assigned(features)).first()["stability"] is None
    for own in (pr.anchored_entropy(none), pr.section_share(none, F.lit(True), F.lit(True)), pr.focus_share(none, F.lit(True)), pr.edge_share(none, "tablet"), pr.side_order(none), pr.side_information(none), pa.place_spread(none), pa.relative_pmi(none), pa.token_stats(none, forms, canonical), pa.shared_places(forms, canonical), pa.absence_rates(forms, canonical)):
        assert own.count() == 0
    classes = spark.createDataFrame([], "cls string, members array<string>")
    assert pa.class_scores(classes, classes).first()["f1"] == 0
    assert con.line_scenarios(none.withColumn("line", F.col("pos")), F.lit(True)).count() == 0


def test_robust_weight(spark):
    weights = spark.createDataFrame([(0.5, True), (0.25, False), (0.125, True), (1.0, None)], "weight double, holds boolean")
    assert se.robust_weight(weights).first()["expected"] == 0.625
    assert se.robust_weight(weights.where("false")).first()["expected"] == 0
