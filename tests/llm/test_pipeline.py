"""The queries, the pipeline and the stages on the smallest tables."""

from __future__ import annotations

import os

import pytest

import corpus_pipeline
from seqloom.llm import common, queries

DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no tables")


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_queries(spark, name):
    rows = queries.QUERIES[name](spark, DIR)
    n = common.table(spark, DIR, "documents").count()
    assert rows.count() == n if name != "op5_neighbours" else rows.count() > 0


def test_sql(spark):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    for name, sql in queries.oracles().items():
        got = con.execute(sql)
        cols = [c[0] for c in got.description]
        rows = queries.QUERIES[name](spark, DIR).select(*cols)
        assert sorted(map(tuple, rows.collect()), key=str) == sorted(got.fetchall(), key=str)


def test_stages(spark):
    docs = common.table(spark, DIR, "documents")
    names = docs.columns
    sizes = [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        docs = common.settle(spark, stage(spark, docs, DIR), "test")
        sizes.append(docs.count())
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == names
    assert sizes == sorted(sizes, reverse=True) and sizes[-1] > 0.5 * sizes[0]
    assert [k for k, _ in corpus_pipeline.STAGES] == ["toxicity", "line dedup", "near dedup", "decontamination", "byte-level BPE"]


@pytest.mark.parametrize("rows", [True, False])
def test_run(spark, tmp_path, rows):
    import random

    rng = random.Random(18)
    prose = lambda n: " ".join(f"w{rng.randrange(3000)}" for _ in range(n))
    lines = lambda k: "\n".join(prose(20) for _ in range(k))
    texts = {k: prose(60) if k % 2 else lines(4) for k in range(40)}
    bad = {k: f"{prose(20)} odiousness grimblefoul {prose(20)}" for k in range(100, 140)}
    item, near = prose(30), prose(120)
    texts |= bad | {200: texts[0], 201: texts[1], 202: f"{prose(30)} {item} {prose(10)}", 203: f"{texts[2]}\n{prose(25)}", 204: near, 205: f"{near} more words"}
    own = [(k, t, "_x", 1) for k, t in texts.items()] + [(None, texts[4], "_x", 1), (None, None, "_x", 1), (300, "", "_x", 1), (5, texts[5], "_x", 1), (5, "another text of the same id", "_x", 1)]
    docs = spark.createDataFrame(own if rows else [], "doc_id long, text string, _gone string, _version int")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(k, 1, int(k in bad)) for k in texts if k < 140], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, item), (None, "no id"), (2, None)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = [r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()]
    if not rows:
        assert got == []
        return
    # Copies, the contaminated text, toxic ones and the near copy are gone; the text with a line of its own keeps that.
    assert sorted(got, key=str) == sorted([k for k in range(40)] + [None, 5, 5, 203, 204, 300], key=str)
