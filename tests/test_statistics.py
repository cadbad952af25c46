"""Closed-form values and invariants of the statistics."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from seqloom.functions import codes as co
from seqloom.functions import stats
from seqloom.operators import alignment as al
from seqloom.operators import contingency as con
from seqloom.operators import information as info
from seqloom.operators import language_models as lm
from seqloom.operators import ngrams as ng
from seqloom.operators import resampling as rs
from seqloom.operators import search as se

TOKENS = "tablet long, pos int, tok string, stratum string"


def tokens(spark, *texts, strata="ab"):
    rows = [(i, k, t, strata[i % len(strata)]) for i, text in enumerate(texts) for k, t in enumerate(text.split())]
    return spark.createDataFrame(rows, TOKENS)


def one(rows):
    return rows.collect()[0]


def test_coincidence_of_constant_and_uniform_texts(spark):
    r = one(info.unigram_stats(tokens(spark, "x x x x", strata="a"), "stratum"))
    assert (r.ic, r.entropy, r.n_types) == (1.0, 0.0, 1)
    many = tokens(spark, " ".join(str(k % 10) for k in range(2000)), strata="a")
    r = one(info.unigram_stats(many, "stratum"))
    assert abs(r.ic - 0.1) < 0.003 and abs(r.entropy - math.log2(10)) < 1e-9


def test_empty_and_single_token_tables(spark):
    empty = spark.createDataFrame([], TOKENS)
    assert info.unigram_stats(empty, "stratum").count() == 0
    assert one(info.unigram_stats(tokens(spark, "x", strata="a"), "stratum")).ic is None


def test_likelihood_ratio(spark):
    def g(*table):
        return one(spark.range(1).select(stats.g2(*[F.lit(x) for x in table]).alias("g"))).g

    assert abs(g(10, 0, 0, 10) - 40 * math.log(2)) < 1e-9
    assert abs(g(5, 5, 5, 5)) < 1e-9 and g(0, 0, 0, 0) == 0


def test_chi_square_tail(spark):
    xs = [0.0, 0.5, 3.841458820694124, 10.0]
    got = [r.p for r in spark.createDataFrame([(x,) for x in xs], "x double").select(stats.chi2_sf(F.col("x")).alias("p")).collect()]
    assert all(abs(p - math.erfc(math.sqrt(x / 2))) < 2e-7 for p, x in zip(got, xs, strict=True))


def test_scenarios_keep_every_token(spark):
    t = tokens(spark, "a b c d e", "a b", "c d e f g h", "x", strata="pq").withColumn("stratum", F.when(F.col("tablet") == 0, "pre").otherwise("post"))
    got = con.scenarios(t, F.col("tablet") >= 2)
    assert {r.scenario: r.n for r in got.groupBy("scenario").agg(F.count("*").alias("n")).collect()} == dict.fromkeys(con.SCENARIOS, 14)


def test_rejection_is_step_up(spark):
    rows = spark.createDataFrame([("a", 0.01), ("b", 0.04), ("c", 0.03), ("d", 0.5), ("e", None)], "tok string, p double")
    got = {r.tok: r.rejected for r in con.benjamini_hochberg(rows, 0.1).collect()}
    assert got == {"a": True, "b": True, "c": True, "d": False}


def test_windows_and_patterns(spark):
    t = tokens(spark, "a b a b c", "a b")
    assert ng.abab(t).count() == 1
    assert ng.windows(t, 2).count() == 5 and ng.windows(t, 6).count() == 0
    found = ng.find_patterns(t, spark.createDataFrame([("p", ["a", "b"]), ("q", ["b", "c"])], "name string, pattern array<string>"))
    assert sorted((r.name, r.tablet, r.pos) for r in found.collect()) == [("p", 0, 0), ("p", 0, 2), ("p", 1, 0), ("q", 0, 3)]
    assert one(ng.context_windows(t.where("tablet = 1"), 1).orderBy("pos")).context == "<pad> b"


def test_additive_model_matches_arithmetic(spark):
    t = tokens(spark, "a b a", "b a")
    m = lm.train(t, 2)
    got = {(r.tablet, r.i): r.lp for r in lm.additive(t, m, 2).collect()}
    assert abs(got[0, 0] - math.log2((1 + 0.5) / (2 + 0.5 * 2))) < 1e-9
    assert lm.events(t, 3).count() == 7


def test_interpolated_probabilities_sum_to_one(spark):
    t = tokens(spark, "a b a c", "b a b", "c c a b")
    m = lm.train(t, 2)
    words = ["a", "b", "c", "</s>"]
    probe = tokens(spark, *[f"a {w}" for w in words if w != "</s>"], "a")
    p = lm.interpolated(probe, m, 2).where("i = 1")
    assert 0 < sum(r.p for r in p.collect()) <= 1 + 1e-9


def test_token_edit_distance_join(spark):
    words = ["abcd", "abcx", "abc", "xabcd", "zzzz", "a", "", "b", "abdc"]
    rows = spark.createDataFrame([(w, w) for w in words], "tablet string, word string")
    def lev(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
            row = new
        return row[-1]
    for most in (1, 2):
        want = {(a, b) for a in words for b in words if a < b and lev(a, b) <= most}
        got = {(r.a, r.b) for r in al.similar(rows, most).collect()}
        assert got <= want and {p for p in want if min(map(len, p)) > most} <= got


def test_alignment(spark):
    assert al.needleman_wunsch(list("abc"), list("abc")) == [("a", "a"), ("b", "b"), ("c", "c")]
    assert al.needleman_wunsch(list("ab"), []) == [("a", None), ("b", None)]
    assert [x for x, _ in al.needleman_wunsch(list("acd"), list("abcd"))] == ["a", None, "c", "d"]


def test_components_of_a_long_path(spark):
    path = [(k, k + 1) for k in range(100)]
    edges = spark.createDataFrame([*path, (300, 299), (500, 500), (None, 3)], "a long, b long")
    got = {r.node: r.component for r in al.components(edges).collect()}
    assert got == {**dict.fromkeys(range(101), 0), 299: 299, 300: 299, 500: 500}
    assert al.components(edges.where("a < 0")).count() == 0


def test_mirrors_of_any_length(spark):
    import random

    from seqloom.operators import structural as st

    def brute(t, least, distinct):
        best = centres = 0
        for c in range(2 * len(t) - 1):
            left, right = ((c - 1) // 2, c // 2 + 1)
            arm = []
            while left >= 0 and right < len(t) and t[left] == t[right]:
                arm.append(t[left])
                left, right = left - 1, right + 1
            centres += bool(arm)
            best = max([best, *(s for s in range(least, len(arm) + 1) if len(set(arm[:s])) >= distinct * s)])
        return best, centres

    rng = random.Random(3)
    own = {0: list("abcdefghijklmnopqrst" + "tsrqponmlkjihgfedcba"), 1: ["x"] * 50, 2: ["a"], 3: ["a", "b"]}
    own |= {k: [rng.choice("abc") for _ in range(rng.randint(1, 40))] for k in range(4, 40)}
    t = spark.createDataFrame([(k, i, x) for k, v in own.items() for i, x in enumerate(v)], "tablet long, pos long, tok string")
    for least, distinct in ((1, 0.0), (2, 0.6), (3, 1.0)):
        want = {k: brute(v, least, distinct) for k, v in own.items()}
        assert {r.tablet: (r.arm, r.centres) for r in st.mirror_span(t, least, distinct).collect()} == {k: v for k, v in want.items() if v[0]}


def test_empty_inputs(spark):
    from seqloom.operators import graph, ngrams

    edges = spark.createDataFrame([], "src string, dst string, weight double")
    assert graph.pagerank(edges).count() == 0
    tokens = spark.createDataFrame([(1, 0, "a")], "tablet long, pos long, tok string")
    assert ngrams.find_patterns(tokens, spark.createDataFrame([], "name string, pattern array<string>")).columns == ["name", "tablet", "pos"]


def test_components(spark):
    edges = spark.createDataFrame([("c", "b"), ("b", "a"), ("x", "y")], "a string, b string")
    assert {r.node: r.component for r in al.components(edges).collect()} == {"a": "a", "b": "a", "c": "a", "x": "x", "y": "x"}


def test_shuffles_keep_counts_and_repeat(spark):
    t = tokens(spark, "a b c d e f g", "a a b")
    one_, two = (sorted(map(tuple, rs.shuffled(t, 3, 5, 2).collect())) for _ in range(2))
    assert one_ == two and len(one_) == 30
    four = sorted(map(tuple, rs.shuffled(t.repartition(7), 3, 5, 2).collect()))
    assert four == one_


def test_codes(spark):
    rows = spark.createDataFrame([("?",), ("(12)",), ("076f!",), ("6aV?",), ("1.2",), ("",)], "c string")
    got = [tuple(r.p) for r in rows.select(co.parse_code(F.col("c")).alias("p")).collect()]
    assert got == [(None, False, True, ""), (None, False, False, ""), ("076f", True, False, ""), ("6a", False, True, "V"), (None, False, False, ""), (None, False, False, "")]
    lines = spark.createDataFrame([("Dr3",), ("Bv12",), ("Ev6/Bb12",), ("A",), ("zz",)], "c string")
    assert [tuple(r.p) for r in lines.select(co.line_field(F.col("c")).alias("p")).collect()] == [("D", "a", 3), ("B", "b", 12), ("E", "b", 6), ("A", "a", -1), ("?", "a", -1)]
    table = F.create_map(F.lit("6"), F.lit("x"), F.lit("007"), F.lit("y"))
    found = spark.createDataFrame([("006",), ("7",), ("9",)], "c string").select(co.lookup(table, F.col("c")).alias("v")).collect()
    assert [r.v for r in found] == ["x", "y", None]


def test_chains_repeat_and_score_fully(spark):
    counts, scores = {(0, 1): 5, (1, 0): 2, (1, 2): 1}, [[-0.1, -2.0], [-1.0, -0.5]]
    a, b = ([tuple(r) for r in se.anneal(spark, counts, scores, 2, 100, 3).orderBy("chain", "iteration").collect()] for _ in range(2))
    assert a == b and len(a) == 20
    for _, _, value, acceptance, assignment in a:
        m = [int(x) for x in assignment.split(",")]
        full = sum(c * scores[m[x]][m[y]] for (x, y), c in counts.items()) - sum(max(0, m.count(s) - 4) ** 2 for s in range(2))
        assert abs(full - value) < 1e-9 and 0 <= acceptance <= 1


def test_binomial_interval():
    lo, hi = se.binomial_interval(0, 10)
    assert lo == 0 and abs(hi - (1 - 0.025 ** (1 / 10))) < 1e-9
    lo, hi = se.binomial_interval(5, 10)
    assert abs(lo + hi - 1) < 1e-9 and 0.18 < lo < 0.19


def test_path_centrality_matches_brute_force(spark):
    import random
    from itertools import permutations

    from seqloom.operators import graph

    rng, edges, want = random.Random(4), [], {}
    for grp in ("g0", "g1", "g2", "g3"):
        n = rng.randint(3, 7)
        own = {(a, b): float(rng.choice([1, 2, 4])) for a in range(n) for b in range(n) if a != b and rng.random() < 0.45}
        own |= {(0, 1): 1.0}
        names = sorted({x for e in own for x in e})
        edges += [(grp, str(a), str(b), w) for (a, b), w in own.items()]
        # All simple paths from s to t, by length.
        best = {}
        for size in range(2, len(names) + 1):
            for p in permutations(names, size):
                steps = list(zip(p, p[1:], strict=False))
                if all(e in own for e in steps):
                    best.setdefault((p[0], p[-1]), []).append((sum(own[e] for e in steps), sum(1 / own[e] for e in steps), p))
        scale = (len(names) - 1) * (len(names) - 2) if len(names) > 2 else 1
        for v in names:
            between = 0.0
            for (s, t), found in best.items():
                short = [p for d, _, p in found if d == min(x[0] for x in found)]
                between += sum(v in p[1:-1] for p in short) / len(short) if v not in (s, t) else 0
            into = [min(x[1] for x in best[s, v]) for s in names if (s, v) in best]
            want[grp, str(v)] = (between / scale, len(into) / sum(into) * len(into) / (len(names) - 1) if into else 0.0)
    got = {(r.grp, r.node): (r.betweenness, r.closeness) for r in graph.paths(spark.createDataFrame(edges, "grp string, src string, dst string, weight double")).collect()}
    assert set(got) == set(want)
    for k, (between, close) in want.items():
        assert abs(got[k][0] - between) < 1e-9 and abs(got[k][1] - close) < 1e-9, k


def test_boxes_match_brute_force(spark):
    import random

    from pyspark.sql import functions as F

    from seqloom.operators import features

    rng, rows, want = random.Random(5), [], {}
    for grp in range(6):
        boxes = []
        for k in range(rng.randint(1, 14)):
            x, y = rng.randrange(12), rng.randrange(12)
            boxes.append((grp, k, x, y, x + rng.randint(1, 8), y + rng.randint(1, 8)))
        rows += boxes
        cells = {b[1]: {(i, j) for i in range(b[2], b[4]) for j in range(b[3], b[5])} for b in boxes}
        kept = []
        for k in sorted(cells, key=lambda k: (-len(cells[k]), k)):
            if all(len(cells[k] & cells[q]) <= 0.3 * len(cells[k] | cells[q]) for q in kept):
                kept.append(k)
        want |= {(grp, k): cells[k] for k in kept}
    boxes = spark.createDataFrame([(g, k, *map(float, b)) for g, k, *b in rows], "grp long, box long, x0 double, y0 double, x1 double, y1 double")
    assert {(r.grp, r.box) for r in features.non_maximum(boxes).collect()} == set(want)
    pairs = boxes.select("grp", F.struct("box", "x0", "y0", "x1", "y1").alias("a")).join(boxes.select("grp", F.struct("box", "x0", "y0", "x1", "y1").alias("b")), "grp")
    area = lambda r: {(i, j) for i in range(int(r.x0), int(r.x1)) for j in range(int(r.y0), int(r.y1))}
    for r in pairs.select("a", "b", features.iou(F.col("a"), F.col("b")).alias("v")).collect():
        assert abs(r.v - len(area(r.a) & area(r.b)) / len(area(r.a) | area(r.b))) < 1e-9
