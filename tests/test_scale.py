"""What queries do to their rows at size: joins, shuffles and sorts that a plan may have, and results of the paths that replace them."""

from __future__ import annotations

import hashlib
import os
from collections import Counter

import pandas as pd
import pytest

from seqloom.operators import information as info
from seqloom.operators import language_models as lm
from seqloom.operators import ngrams as ng
from seqloom.operators import relational as rel
from seqloom.operators import resampling as rs
from seqloom.plans import catalog

DIR = "/root/testdata/sf0.001"
TOKENS = "tablet long, pos int, tok string, stratum string"
data = pytest.mark.skipif(not os.path.isdir(DIR), reason="no tables")


def planned(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def no_broadcast(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield spark
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@data
def test_kn_backoff_deals_places_once(no_broadcast):
    """Places meet the probability of their gram in one join; the models' lookups are joins of distinct grams."""
    plan = planned(catalog.queries()["kn_backoff"](no_broadcast, DIR))
    assert plan.count("SortMergeJoin") <= 6


def test_sequences_and_tokens_give_the_same_places(spark):
    rows = [(i, k, t, "a") for i, text in enumerate(("a b a", "b")) for k, t in enumerate(text.split())]
    own = spark.createDataFrame(rows, TOKENS)
    whole = spark.createDataFrame([(0, ["a", "b", "a"]), (1, ["b"])], "tablet long, seq array<string>")
    assert sorted(map(tuple, lm.events(own, 2).collect())) == sorted(map(tuple, lm.events(whole, 2).collect()))


def test_running_sums_by_parts(spark):
    rows = [("g", float(k * k), k % 3 + 1) for k in range(1000)] + [("h", 5.0, 7), ("h", None, 2), ("h", float("nan"), 1)]
    got = {(g, str(k)): b for g, k, _, b in rel.running(spark.createDataFrame(rows, "g string, k double, n long"), "k", "n", "g").collect()}
    total = 0
    for _, k, n in rows[:1000]:
        assert got["g", str(k)] == total
        total += n
    assert (got["h", "5.0"], got["h", "nan"], got["h", "None"]) == (0, 7, 8)


def test_spearman_ranks_ties_at_their_mean_without_a_window_of_a_group(spark):
    xs, ys = [k % 7 for k in range(200)], [(k * k) % 31 for k in range(200)]
    own = spark.createDataFrame([("a", x, y) for x, y in zip(xs, ys)], "g string, x int, y int")
    mean = lambda v: [sum(u < w for u in v) + (v.count(w) + 1) / 2 for w in v]
    want = pd.Series(mean(xs)).corr(pd.Series(mean(ys)))
    df = info.spearman(own, "x", "y", "g")
    assert df.first()["rho"] == pytest.approx(want)
    assert "hashpartitioning(g#" not in "".join(line for line in planned(df).splitlines() if "Window" in line)
    assert "__part" in planned(df)


@data
@pytest.mark.parametrize("name", ["place_spread", "mismatch_rates", "perm_pvalue_blocks"])
def test_parts_grow_with_the_source(spark, name, monkeypatch):
    monkeypatch.setattr(rel, "STEP", 100)
    assert "REPARTITION_BY_NUM" in planned(catalog.queries()[name](spark, DIR))


def test_bootstrap_draws_by_hash_without_a_shuffle_of_draws(spark):
    own = [("g", t, p, "abc"[(t * 5 + p) % 3]) for t in range(6) for p in range(7)] + [("h", 1, 0, "z"), ("h", 2, 0, "a")]
    df = rs.bootstrap(spark.createDataFrame(own, "stratum string, tablet long, pos int, tok string"), 5, 42, "stratum")
    got = {(r["stratum"], r["replica"]): r["ic"] for r in df.collect()}
    for g in "gh":
        toks = [t for s, *_, t in own if s == g]
        for k in range(5):
            picks = Counter(toks[int(hashlib.md5(f"42:{k}:{p}".encode()).hexdigest()[:8], 16) % len(toks)] for p in range(len(toks)))
            assert got[g, k] == pytest.approx(sum(f * (f - 1) for f in picks.values()) / (len(toks) * (len(toks) - 1)))
    assert "SortMergeJoin" not in planned(df)


def test_bootstrap_ci_draws_all_replicas():
    assert "range(2000)" in catalog.oracles()["bootstrap_ci"] and "k = 1950" in catalog.oracles()["bootstrap_ci"]


@data
@pytest.mark.parametrize("name", ["cond_entropy_pooled", "fingerprint_roles", "determinative_candidates", "cross_tablet_consistency"])
def test_words_are_not_dealt_by_document(no_broadcast, name):
    """The next word comes with each word, so no window orders the words of documents; sizes of documents come with them too."""
    plan = planned(catalog.queries()[name](no_broadcast, DIR))
    assert "lead(tok#" not in plan and "SortMergeJoin [tablet" not in plan


def test_pooled_bigrams_of_words_that_bring_the_next(spark):
    texts = {3: "a b a", 1: "b", 2: "c c"}
    rows = [(t, k, w, "s", (text.split() + [None])[k + 1]) for t, text in texts.items() for k, w in enumerate(text.split())]
    own = spark.createDataFrame(rows, TOKENS + ", nxt string")
    for span in ("tablet", "stratum"):
        a, b = (sorted(map(tuple, ng.bigrams(x, span=span).collect())) for x in (own, own.drop("nxt")))
        assert a == b and a


@data
@pytest.mark.parametrize("name", ["scenario_parity", "scenario_ic"])
def test_undated_tablets_are_numbered_in_parts(spark, name):
    assert "__part" in planned(catalog.queries()[name](spark, DIR))
