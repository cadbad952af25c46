"""Readers, reading order and sequential decoders on small files."""

from __future__ import annotations

import json
import math

from pyspark.sql import functions as F

from seqloom.operators import decoding as de
from seqloom.operators import graph as gr
from seqloom.operators import structural as st
from seqloom.sources import files


def glyph(**kw):
    return {"position": 1, "side": "a", "line": "01", "glyph_num": "1", "barthel_code": "1", "horley_code": "1", "inverted": False, "uncertain": False} | kw


def test_tablets_in_reading_order(spark, tmp_path):
    own = [glyph(side="b", horley_code="x"), glyph(glyph_num="2", horley_code="b"), glyph(glyph_num="1", horley_code="a"), glyph(line="02", glyph_num="1", horley_code="c", inverted=True), glyph(line="02", glyph_num="2", horley_code="d", inverted=True), glyph(line="03", horley_code="", horley_components=["e", "f"]), glyph(line="03", glyph_num="zz", horley_code="g", uncertain=True)]
    (tmp_path / "A.json").write_text(json.dumps({"tablet_id": "A", "glyphs": own}))
    (tmp_path / "B.json").write_text("{ not json")
    rows = files.tablets(spark, str(tmp_path))
    assert files.corrupt(rows) == 1
    order = files.reading_order(rows.where("tablet_id = 'A'")).orderBy("pos")
    assert [r.tok for r in order.collect()] == ["a", "b", "d", "c", "e", "f", "x"]
    assert "g" in {r.tok for r in files.reading_order(rows.where("tablet_id = 'A'"), uncertain=True).collect()}
    assert {(r.line, r.parity): r.seq for r in files.lines(order).where("side = 'a'").collect()}[2, "even"] == ["d", "c"]
    (tmp_path / "meta").mkdir()
    (tmp_path / "meta/tablets.json").write_text(json.dumps({"_note": {"name": "x"}, "A": {"name": "one", "min_CE": 1500, "max_CE": 1600}}))
    assert [r.midpoint for r in files.corpus(rows, files.metadata(spark, str(tmp_path / "meta/tablets.json")), 2).collect()] == [1550.0]


def test_xml(spark, tmp_path):
    (tmp_path / "t.xml").write_text('<root><tablet id="A"><side name="a"><line number="1"><glyph ceipp="1_"/><glyph ceipp=""/><glyph ceipp="2"/></line></side><side name="b"><line number="1"><glyph ceipp="3"/></line></side></tablet></root>')
    assert [(r.side, r.position, r.code) for r in files.xml_tablets(spark, str(tmp_path / "t.xml")).orderBy("position").collect()] == [("a", 1, "1?"), ("a", 2, "2"), ("b", 3, "3")]


def test_passages_and_counts(spark, tmp_path):
    (tmp_path / "p.csv").write_text("passage_id,tablet_id,side,stratum,start_position,glyph_sequence\nP1,A,a,pre,0,1 2 3\nP1,B,a,post,5,1 3\n")
    rows = files.passages(spark, str(tmp_path / "p.csv"))
    assert sorted((r.canonical, r.form) for r in rows.collect()) == [(False, ["1", "3"]), (True, ["1", "2", "3"])]
    assert sorted(map(tuple, files.boundaries(rows).collect())) == [("A", 0), ("A", 2), ("B", 5), ("B", 6)]
    (tmp_path / "v.json").write_text(json.dumps({"passages": [{"passage_id": "Q", "canonical_form": ["1"], "attestations": [{"form": ["1"], "tablet": "C", "stratum": "pre"}]}]}))
    assert [tuple(r) for r in files.passage_json(spark, str(tmp_path / "v.json")).collect()] == [("Q", ["1"], ["1"], "C", "pre", -1)]
    (tmp_path / "h.csv").write_text('ID,Line,Sequence\n1,"Ar1","041-430!.040"\n2,"Bv2",""\n')
    assert [tuple(r) for r in files.parallels(spark, str(tmp_path / "h.csv")).collect()] == [("H001", "A", "a", 1, ["041", "430", "040"])]
    (tmp_path / "c.tsv").write_text("# note\n5\ta,b\n2\tb\nbad\tx\n1\ta,b,c,d\n3\ta,b\n")
    assert sorted(map(tuple, files.count_table(spark, str(tmp_path / "c.tsv"), 3).collect())) == [(1, [], "b", 2), (2, ["a"], "b", 8)]
    (tmp_path / "f.tsv").write_text("9\tÉta\n3\teta\nx\ty\n")
    assert [(r.word, r.f) for r in files.frequency_list(spark, str(tmp_path / "f.tsv")).collect()] == [("eta", 9)]


def test_sinks_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([("A", 1, "x"), ("B", 2, None)], "tablet string, n int, tok string")
    files.write_table(rows, str(tmp_path / "t"), "tablet")
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "t")).select(*rows.columns).collect())) == [("A", 1, "x"), ("B", 2, None)]
    files.write_json(files.stamped(rows, seed=1), str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).where("_provenance.seed = 1").count() == 2
    files.write_csv(rows, str(tmp_path / "c"))
    assert spark.read.option("header", True).csv(str(tmp_path / "c")).count() == 2
    assert files.markdown(rows.orderBy("n")).splitlines()[2:] == ["| A | 1 | x |", "| B | 2 |  |"]
    assert files.checksum(spark, str(tmp_path / "c")) == files.checksum(spark, str(tmp_path / "c"))


def test_decoders(spark):
    best = de.beam({("a", "b"): 3}, {("x", "y"): -0.1, ("y", "x"): -2.0, ("x", "x"): -3.0, ("y", "y"): -3.0}, ["a", "b"], ["x", "y"], 3)
    assert best[0][1] == {"a": "x", "b": "y"} and len({str(m) for _, m in best}) == len(best)
    assert de.segments([[1, 1, 0, 0], [0, 0, 1, 1]], 1, 3) == (4.0, [0, 2])
    assert de.segments([[1.0], [1.0]], 1, 3)[1] == []
    w = spark.createDataFrame([("g", i, j, float((j >= 2) == (i == 1))) for i in range(2) for j in range(4)], "grp string, w long, pos long, score double")
    assert [(r.w, r.start, r.total) for r in de.aligned(w, 1, 3).orderBy("w").collect()] == [(0, 0, 4.0), (1, 2, 4.0)]
    seq = spark.createDataFrame([(["ma", "ta", "x", "ma"],), ([],)], "seq array<string>")
    got = [[(g.start, g.size, g.gloss) for g in r.glosses] for r in de.glossed(seq, {"ma": (1, "for"), "mata": (1, "eye")}).collect()]
    assert got == [[(0, 2, "eye"), (3, 1, "for")], []]
    holes = spark.createDataFrame([(["a", None, "c"],)], "seq array<string>")
    filled = de.completed(holes, {("a", "b"): -1.0, ("b", "c"): -1.0, ("a", "a"): -0.5}, ["a", "b", "c"], 1).collect()[0].filled
    assert [(f.at, f.tok) for f in filled] == [(1, "b")]


def test_graph_measures(spark):
    edges = spark.createDataFrame([("g", "a", "b", 1.0), ("g", "b", "c", 1.0), ("g", "a", "c", 5.0)], "grp string, src string, dst string, weight double")
    got = {r.node: r for r in gr.paths(edges).collect()}
    assert got["b"].betweenness == 0.5 and got["a"].betweenness == 0
    rank = {r.node: r.rank for r in gr.pagerank(edges, 30).collect()}
    assert abs(sum(rank.values()) - 1) < 1e-9 and rank["c"] > rank["b"] > rank["a"]
    assert de.generators(edges, 1) in ([("a", 2)],)


def test_structure(spark):
    t = spark.createDataFrame([(0, k, x) for k, x in enumerate("abcxcba")] + [(1, k, x) for k, x in enumerate("abcdefg")], "tablet long, pos int, tok string")
    assert {r.tablet: r.arm for r in st.mirror_span(t).collect()} == {0: 3}
    p = spark.createDataFrame([(0, 5 * k, "x") for k in range(6)], "tablet long, pos int, tok string")
    r = st.phase_coherence(p, [3, 5]).collect()[0]
    assert r.period == 5 and math.isclose(r.coherence, 1, abs_tol=1e-9)
    linear = spark.createDataFrame([(x, bin(x & 5).count("1") % 2) for x in range(8)], "x int, f int")
    w = {r.s: r.w for r in st.walsh(linear, 3).collect()}
    assert w[5] == 8 and sum(abs(v) for v in w.values()) == 8
    assert tuple(st.affine_share(linear).collect()[0]) == (1.0, 1.0)
    y = spark.createDataFrame([(0, v) for v in range(16) if bin(v & 6).count("1") % 2 == 0], "grp int, y int")
    assert st.hidden_period(y, 4).collect()[0].period == 6
    assert abs(st.assignment_weights(spark, [0.2, 0.7]).agg(F.sum("weight")).first()[0] - 1) < 1e-12


def test_lines_of_equal_number_and_part_stay_as_stored(spark, tmp_path):
    import datetime

    from seqloom.plans import choices

    early, late = datetime.datetime(1995, 1, 1), datetime.datetime(1999, 1, 1)
    spark.createDataFrame([(7, "b")], "p_partkey long, p_brand string").selectExpr("*", "'t' AS p_type").write.parquet(f"{tmp_path}/part.parquet")
    fields = "l_orderkey long, l_linenumber int, l_partkey long, l_shipdate timestamp"
    # The second file is larger, so Spark reads it first.
    for k, rows in enumerate([[(1, 1, 7, early)], [(1, 1, 7, late), *((n, n, n, late) for n in range(10, 3000))]]):
        spark.createDataFrame(rows, fields).coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet/file={k}")
    got = {(r.stratum, r.parity) for r in choices.scenario_parity(spark, str(tmp_path)).where("scenario = 'all_late'").collect()}
    assert got == {("pre", 0), ("post", 1)}
