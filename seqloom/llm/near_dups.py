"""Near duplicates: MinHash signatures, a multi-index Hamming join, and confirmation on the full shingle sets.

Two documents are linked if the Jaccard similarity of their sets of distinct 5-word shingles is SIMILARITY percent or more.
Signatures of up to 66 16-bit symbols are cut into chunks, at SIMILARITY 11 of 6; all pairs with 21 unequal symbols or fewer
share a chunk with one error at most, and so one of the 6 keys that leave one symbol of the chunk out. At similarity 0.85 a
pair has 9.9 unequal symbols on average with a deviation of 2.9, so a link is missed in one of some ten thousand borderline
cases, and then mostly held by other links of its group. Lower thresholds have shorter chunks, and so a wider radius, until a
pair at the threshold lies beyond it with a chance of MISS at most: at 80 percent 13 chunks of 5, all within 25 of 65 symbols.

1. Documents with equal shingle sets are one class, whose smallest doc_id stands for it; nothing below sees its copies.
2. The keys of all classes are aggregated to the smallest class of each key; keys of one class only are dropped.
3. Each class is compared with the closest of those smallest ones. The confirmed links form components.
4. Within keys that span components still, classes are compared across components by signature, in cells of bounded size:
   first, in NEAREST rounds, each with the closest one outside its component; then all pairs within the radius. They are
   confirmed on full sets, but for those whose longer signatures differ in FAR deviations more symbols than the threshold
   has them do on average (at 5, one of some three million pairs at the threshold). Pairs inside a component are already decided, so a
   dense group never spreads into all its pairs; no pair across components is skipped.

Defined cases: null, empty and wordless texts have an empty set and are linked with nothing; texts of under five words have
one shingle, the whole sequence; rows that share a doc_id are judged by their own texts, and alike if these are equal; rows
without doc_id come after all others, as if they shared the largest id (their component_id is null if no row of it has an id;
the first of a group is kept with all rows of its id); ties go to the smaller doc_id; an empty table gives an empty result;
other columns are never read, and `keep` passes them on, clashing names included.

A limit: a key that very many classes share without being similar (pages of one large template) is compared in cells of
CELL by CELL classes, so nothing is lost and no task grows, but the number of cells grows with the square of that key's
classes.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seqloom.llm import common, shingles

SIMILARITY = 85
CELL = 256
NEAREST = 2
FAR = 5
#: Rows of a few numbers that a join may broadcast, some MB in the driver.
FEW = 50_000
#: Symbols of the longer signature.
LONG = 512


#: The chance that a pair at the threshold lies beyond the radius.
MISS = 0.0002


@dataclass(frozen=True)
class Layout:
    """A signature of `chunks` chunks of `chunk` symbols; pairs within `radius` share a chunk with one error at most."""

    chunks: int
    chunk: int

    @property
    def symbols(self) -> int:
        return self.chunks * self.chunk

    @property
    def radius(self) -> int:
        return 2 * self.chunks - 1

    def missed(self, percent: int) -> float:
        q, m = 1 - percent / 100, self.symbols
        return sum(math.comb(m, k) * q**k * (1 - q) ** (m - k) for k in range(self.radius + 1, m + 1))


def layout(percent: int) -> Layout:
    """That of the longest chunks whose radius is wide enough; chunks of 2 symbols at the least."""
    for chunk in range(shingles.CHUNK, 2, -1):
        own = Layout(shingles.SYMBOLS // chunk, chunk)
        if own.missed(percent) <= MISS:
            return own
    return Layout(shingles.SYMBOLS // 2, 2)


def _sign(symbols: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.working("shingles", shingles.forget)
        for batch in batches:
            n, digests, sigs = [], [], []
            for text in batch.column(2):
                own = shingles.of(text.as_py())
                n.append(len(own))
                digests.append(shingles.digest(own) if len(own) else None)
                sigs.append(shingles.signature(own, symbols).tobytes() if len(own) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(digests, pa.binary()), pa.array(sigs, pa.binary())], ["doc_id", "version", "n", "digest", "sig"])

    return sign


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    common.working("shingles", shingles.forget)
    for batch in batches:
        ids, sets = [], []
        for node, digest, text in zip(batch.column(0), batch.column(1), batch.column(2), strict=True):
            own = shingles.of(text.as_py())
            if len(own) and shingles.digest(own) == digest.as_py():  # not another text of the same doc_id
                ids.append(node.as_py())
                sets.append(own)
        arrays = [pa.array(ids, pa.int64()), pa.array([x.tobytes() for x in sets], pa.binary()), pa.array([shingles.signature(x, LONG).tobytes() for x in sets], pa.binary())]
        yield pa.RecordBatch.from_arrays(arrays, ["id", "set", "long"])


@F.pandas_udf(T.IntegerType())
def _distance(a: pd.Series, b: pd.Series) -> pd.Series:
    if not len(a):
        return pd.Series([], dtype="int32")
    x, y = (np.frombuffer(b"".join(s), dtype=np.uint16).reshape(len(s), -1) for s in (a, b))
    return pd.Series((x != y).sum(axis=1).astype("int32"))


def _link_of(percent: int) -> Column:
    @F.pandas_udf(T.BooleanType())
    def link(a: pd.Series, b: pd.Series) -> pd.Series:
        out = []
        for p, q in zip(a, b, strict=True):
            x, y = np.frombuffer(p, dtype=np.uint64), np.frombuffer(q, dtype=np.uint64)
            both = np.concatenate([x, y])
            both.sort(kind="stable")
            same = int((both[1:] == both[:-1]).sum())
            out.append(100 * same >= percent * (len(x) + len(y) - same))
        return pd.Series(out, dtype=bool)

    return link


def _by(left: DataFrame, right: DataFrame, on: str | list[str] | Column, how: str = "inner", rows: int | None = None) -> DataFrame:
    """A join by sort and merge, or if right has FEW of counted rows at most, by broadcast. It isn't left to Spark, which takes
    exploded keys and compressed files for far smaller than they are and would collect them in the driver."""
    return left.join(F.broadcast(right) if rows is not None and rows <= FEW else right.hint("merge"), on, how)


def _keys(classes: DataFrame, form: Layout) -> DataFrame:
    """rep, id (of chunk and symbol left out), key."""
    width = 2 * form.chunk
    at = F.floor(F.col("id") / form.chunk) * width
    out = (F.col("id") % form.chunk) * 2
    cut = lambda start, n: F.substring(F.col("sig"), start.cast("int"), n.cast("int"))
    key = F.xxhash64("id", cut(at + 1, out), cut(at + out + 3, F.lit(width - 2) - out))
    return classes.withColumn("id", F.explode(F.sequence(F.lit(0), F.lit(form.symbols - 1)))).select("rep", "id", key.alias("key"))


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of pairs (a, b), those whose full sets are similar."""
    first = sets.select(F.col("id").alias("a"), F.col("set").alias("x"))
    second = sets.select(F.col("id").alias("b"), F.col("set").alias("y"))
    return _by(_by(pairs, first, "a"), second, "b").where(_link_of(percent)("x", "y")).select("a", "b")


def _across(percent: int, nearest: bool):  # noqa: ANN202
    """Pairs (a, b) of a cell, and how many symbols differ, that lie in different components, are near enough by size and
    signature, and whose first common key this is. nearest: of each class only the pair with the closest one of a component
    with a smaller id, so that a large component, which mostly has the smallest, asks for nothing."""
    share, form = percent / 100, layout(percent)
    bound = int(LONG * (1 - share) + FAR * (LONG * share * (1 - share)) ** 0.5)

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right, far = [], [], []
            for key_id, same, rows in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                f = rows.values
                rep, comp, n, block = (f.field(k).to_numpy() for k in ("rep", "comp", "n", "block"))
                sig, long = (np.frombuffer(b"".join(f.field(k).to_pylist()), dtype=np.uint16).reshape(len(rep), -1) for k in ("sig", "long"))
                chunk, out = divmod(key_id, form.chunk)
                for k in range(len(rep)):
                    if not same and not nearest and block[k] != block.min():
                        continue
                    other = np.arange(0 if nearest else k + 1, len(rep)) if same else np.flatnonzero(block != block[k])
                    lo, hi = np.minimum(n[other], n[k]), np.maximum(n[other], n[k])
                    apart = comp[other] < comp[k] if nearest else comp[other] != comp[k]
                    other = other[apart & (100 * lo >= percent * hi)]
                    if not len(other):
                        continue
                    wrong = (sig[other] != sig[k]).reshape(len(other), form.chunks, form.chunk)
                    each = wrong.sum(axis=2)
                    ok = (each.sum(axis=1) <= form.radius) & ((each <= 1).argmax(axis=1) == chunk) & (wrong[:, chunk].argmax(axis=1) == out)
                    other = other[ok]
                    away = (long[other] != long[k]).sum(axis=1)
                    other, away = other[away <= bound], away[away <= bound]
                    if nearest and len(other):
                        best = np.lexsort((rep[other], away))[:1]
                        other, away = other[best], away[best]
                    left.append(np.full(len(other), rep[k]))
                    right.append(rep[other])
                    far.append(away)
            join = lambda parts: pa.array(np.concatenate([np.empty(0, np.int64), *parts]).astype(np.int64))
            yield pa.RecordBatch.from_arrays([join(left), join(right), join(far)], ["a", "b", "far"])

    return cells


def components(spark: SparkSession, edges: DataFrame) -> DataFrame:
    """id, comp (smallest id reachable) of all that edges (a, b) touch, by large-star and small-star rounds."""
    now = common.settle(spark, edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    seen, n = None, now.count()
    while True:
        both = now.union(now.select("b", "a"))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = _by(both.where("b > a"), least, "a", rows=2 * n).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = _by(large, least, "a", rows=2 * n).select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
        now = common.settle(spark, small.where("a <> b").distinct(), "edges")
        state = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if state == seen:
            break
        seen, n = state, state[0]
    return now.select(F.col("a").alias("id"), F.col("b").alias("comp")).union(now.select(F.col("b").alias("id"), F.col("b").alias("comp"))).distinct()


def _merged(spark: SparkSession, first: DataFrame, links: DataFrame) -> DataFrame:
    """The components `first` (id, comp) after more links (a, b)."""
    n = first.count()
    name = lambda c: first.select(F.col("id").alias(c), F.col("comp").alias(f"{c}_comp"))
    edges = _by(_by(links, name("a"), "a", "left", n), name("b"), "b", "left", n).select(F.coalesce("a_comp", "a").alias("a"), F.coalesce("b_comp", "b").alias("b")).distinct()
    second = components(spark, edges).select(F.col("id").alias("old"), F.col("comp").alias("new"))
    second = common.settle(spark, second, "merged")
    kept = _by(first, second, first["comp"] == second["old"], "left", second.count()).select("id", F.coalesce("new", "comp").alias("comp"))
    added = _by(second, first, second["old"] == first["id"], "left_anti", n).select(F.col("old").alias("id"), F.col("new").alias("comp"))
    return common.settle(spark, kept.unionByName(added), "components")


def _judged(spark: SparkSession, docs: DataFrame, percent: int) -> DataFrame:
    """For every row of docs: doc_id (never null, see common.order_id), version, n, component_id."""
    common.prepare(spark)
    own, form = docs.select(common.order_id("doc_id").alias("doc_id"), F.xxhash64("text").alias("version"), "text"), layout(percent)
    signed = common.settle(spark, own.mapInArrow(_sign(form.symbols), "doc_id long, version long, n long, digest binary, sig binary"), "signed")
    classes = signed.where("digest is not null").groupBy("digest").agg(F.min("doc_id").alias("first_id"), F.first("n").alias("n"), F.first("sig").alias("sig"))
    # Below, a class goes by a number of its own, as two may have the same smallest doc_id.
    classes = common.settle(spark, classes.withColumn("rep", F.monotonically_increasing_id()), "classes")

    keys = _keys(classes, form)
    least = keys.groupBy("key", "id").agg(F.min("rep").alias("lo"), F.max("rep").alias("hi")).where("lo < hi").select("key", "id", "lo")
    shared = common.settle(spark, _by(keys, least, ["key", "id"]), "shared")
    involved = _by(shared.select("rep").distinct(), classes, "rep").select("rep", "digest", F.col("first_id").alias("doc_id"))
    sets = _by(own.select("doc_id", "text"), involved, "doc_id").select("rep", "digest", "text").mapInArrow(_sets, "id long, set binary, long binary").dropDuplicates(["id"])
    sets = common.settle(spark, sets, "sets")

    brief = classes.select("rep", "n", "sig")
    of = lambda name: brief.select(*[F.col(c).alias(f"{name}_{c}" if c != "rep" else name) for c in brief.columns])
    near = shared.where("rep <> lo").select(F.col("lo").alias("a"), F.col("rep").alias("b")).distinct()
    sized = lambda pairs: pairs.where(100 * F.least("a_n", "b_n") >= percent * F.greatest("a_n", "b_n"))
    near = sized(_by(_by(near, of("a"), "a"), of("b"), "b")).withColumn("far", _distance("a_sig", "b_sig")).where(F.col("far") <= form.radius)
    near = near.groupBy("b").agg(F.min(F.struct("far", "a")).alias("best")).select(F.col("best.a").alias("a"), "b")
    linked = common.settle(spark, _confirmed(near, sets, percent), "linked")
    placed = common.settle(spark, components(spark, linked), "components")

    signs = _by(brief, sets.select(F.col("id").alias("rep"), "long"), "rep")
    for nearest in [True] * NEAREST + [False]:
        at = _by(shared, placed, shared["rep"] == placed["id"], "left", placed.count()).select("key", shared["id"], "rep", F.coalesce("comp", "rep").alias("comp"))
        mixed = at.groupBy("key", "id").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("size")).where("lo < hi")
        mixed = common.settle(spark, mixed.select("key", "id", F.ceil(F.col("size") / CELL).cast("int").alias("cells")), "mixed")
        members = _by(_by(at, mixed, ["key", "id"], rows=mixed.count()), signs, "rep")
        members = members.withColumn("block", F.pmod(F.xxhash64("rep"), F.col("cells")).cast("int")).withColumn("to", F.explode(F.sequence(F.lit(0), F.col("cells") - 1)))
        members = members.withColumn("i", F.least("block", "to")).withColumn("j", F.greatest("block", "to"))
        cell = members.groupBy("key", "id", "i", "j").agg(F.collect_list(F.struct("rep", "comp", "n", "block", "sig", "long")).alias("rows"))  # about 2 * CELL rows
        pairs = cell.where(F.size("rows") > 1).select("id", (F.col("i") == F.col("j")).alias("same"), "rows").mapInArrow(_across(percent, nearest), "a long, b long, far long")
        if nearest:
            pairs = pairs.groupBy("a").agg(F.min(F.struct("far", "b")).alias("best")).select("a", F.col("best.b").alias("b"))
        pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        links = common.settle(spark, _confirmed(pairs, sets, percent), "linked")
        if links.isEmpty():
            continue
        placed = _merged(spark, placed, links)

    # Classes that are linked, and rows without shingles, go their own ways: no join has a key that all of them share.
    n = placed.count()
    linked = _by(classes, placed, placed["id"] == classes["rep"], rows=n).select("digest", "first_id", "comp")
    least = linked.groupBy("comp").agg(F.min("first_id").alias("least"))
    linked = _by(linked, least, "comp", rows=n).select("digest", "least")
    reps = _by(classes.select("digest", "first_id"), linked, "digest", "left", n).select("digest", F.coalesce("least", "first_id").alias("component_id"))
    out = _by(signed.select("doc_id", "version", "n", "digest"), reps, "digest").drop("digest")
    return out.unionByName(signed.where("digest is null").select("doc_id", "version", "n", F.col("doc_id").alias("component_id")))


def find(spark: SparkSession, docs: DataFrame, percent: int = SIMILARITY) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of docs."""
    given = lambda c: F.when(F.col(c) < 2**63 - 1, F.col(c)).alias(c)
    with common.brief_shuffles(spark):
        out = _judged(spark, docs, percent)
    return out.select(given("doc_id"), F.col("n").alias("n_shingles"), given("component_id"), (F.col("component_id") == F.col("doc_id")).alias("kept"))


def keep(spark: SparkSession, docs: DataFrame, percent: int = SIMILARITY) -> DataFrame:
    """docs without those that aren't the first of their group."""
    id_, version = common.fresh(docs, "id", "version")
    with common.brief_shuffles(spark):
        judged = _judged(spark, docs, percent)
    gone = judged.where("component_id <> doc_id").select(F.col("doc_id").alias(id_), F.col("version").alias(version)).distinct()
    keyed = docs.withColumns({id_: common.order_id("doc_id"), version: F.xxhash64("text")})
    return _by(keyed, gone, [id_, version], "left_anti").select(*docs.columns)
