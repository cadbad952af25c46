"""Approximate nearest neighbours by cross-polytope hashing.

A table turns unit vectors by pseudo-rotations (three rounds of random signs and a fast Hadamard transform) and files each under
the nearest signed axis of one polytope, and of a second one of fewer axes where that pays. A query looks into the buckets
whose axes are nearest to it, in each table; all vectors found there are compared exactly, by cosine in double precision.

How many tables and probes, and how many axes the second polytope has, is fitted: for FIT queries at most (those with the
smallest hashes of vec_id) the true neighbours are found by comparison with all vectors, and for each setting the number of
probes is read off that finds TARGET of them; the cheapest setting by the number of rows is taken. So the share of vectors
that a query is compared with falls as the table grows, as far as the vectors allow. Every row is indexed.

Defined cases: vectors that are null, zero, or hold null or non-finite components take no part, nor do rows without vec_id;
shorter vectors count as padded with zeros; rows repeated whole count once; equal vectors are searched as one and listed by
vec_id; ties go to the smaller vec_id; a query never finds its own vec_id; with fewer than k other vectors all are returned,
found by a second, exact pass over all vectors for the queries that the tables leave short; empty tables give empty results.

Plan: vectors and probes meet in cells, which hold a bounded block of vectors and of queries each, by counts that are
aggregated first: a crowded bucket becomes many cells, and thin ones share a cell. A cell makes a matrix product of each of its
buckets and passes on k rows a query. No pair of a query and a vector becomes a row. Vectors travel in their own precision,
once a table; queries, being few, once a probe.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from seqloom.llm import common

SEED, FIT, TARGET = 20240229, 200, 0.95
MAX_TABLES, MAX_PROBES = 12, 256
#: What a row of a probe and a filed row cost, in comparisons of two vectors.
PROBE_COST, FILE_COST = 50, 100
#: Vectors and queries of a cell, on average.
BLOCK_VECTORS, BLOCK_QUERIES = 4096, 1024


@dataclass(frozen=True)
class Settings:
    tables: int
    probes: int
    second: int  # axes of the second polytope, or 0

    def buckets(self, width: int) -> int:
        return 2 * width * max(1, 2 * self.second)


def hadamard(x: np.ndarray) -> np.ndarray:
    """Rows times the orthonormal Hadamard matrix, in n log n steps."""
    n, width = x.shape
    h = 1
    while h < width:
        x = x.reshape(n, width // (2 * h), 2, h)
        x = np.stack([x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]], axis=2).reshape(n, width)
        h *= 2
    return x / np.sqrt(width)


@lru_cache(maxsize=256)
def _signs(number: int, width: int) -> np.ndarray:
    return np.random.Generator(np.random.PCG64([SEED, number])).choice([-1.0, 1.0], (3, width))


def rotate(x: np.ndarray, number: int) -> np.ndarray:
    for signs in _signs(number, x.shape[1]):
        x = hadamard(x * signs)
    return x


def _far(x: np.ndarray, number: int, axes: int) -> np.ndarray:
    """How far each row is from each signed axis (+k, then -k) of a polytope beyond the nearest, squared."""
    y = rotate(x, number)[:, :axes]
    y = np.concatenate([y, -y], axis=1)
    return (y.max(axis=1, keepdims=True) - y) ** 2


def _polytopes(x: np.ndarray, table: int, second: int) -> list[np.ndarray]:
    own = [_far(x, 2 * table, x.shape[1])]
    return [*own, _far(x, 2 * table + 1, second)] if second else own


def bucket(x: np.ndarray, table: int, second: int) -> np.ndarray:
    """The bucket of each row."""
    one, *two = (p.argmin(axis=1) for p in _polytopes(x, table, second))
    return one * (2 * second) + two[0] if two else one


def probes(x: np.ndarray, table: int, second: int, n: int) -> np.ndarray:
    """For each row its n nearest buckets."""
    one, *two = _polytopes(x, table, second)
    m = min(n, one.shape[1])
    a = np.argpartition(one, m - 1, axis=1)[:, :m]
    if not two:
        return a
    far = two[0]
    k = min(n, far.shape[1])
    b = np.argpartition(far, k - 1, axis=1)[:, :k]
    out = np.empty((len(x), min(n, m * k)), dtype=np.int64)
    for lo in range(0, len(x), 64):
        row = slice(lo, lo + 64)
        both = (np.take_along_axis(one[row], a[row], 1)[:, :, None] + np.take_along_axis(far[row], b[row], 1)[:, None, :]).reshape(-1, m * k)
        best = np.argpartition(both, out.shape[1] - 1, axis=1)[:, : out.shape[1]]
        out[row] = np.take_along_axis(a[row], best // k, 1) * (2 * second) + np.take_along_axis(b[row], best % k, 1)
    return out


def _rank(q: np.ndarray, v: np.ndarray, of: np.ndarray, table: int, second: int) -> np.ndarray:
    """How many buckets are nearer to the query than that of its neighbour."""
    own = _polytopes(q, table, second)
    filed = [p.argmin(axis=1) for p in _polytopes(v, table, second)]
    if not second:
        return (own[0][of] < own[0][of, filed[0]][:, None]).sum(axis=1)
    order = np.sort(own[1], axis=1)
    need = own[0][of, filed[0]] + own[1][of, filed[1]]
    return np.array([np.searchsorted(order[i], x - own[0][i], side="left").sum() for i, x in zip(of, need, strict=True)])


def fit(q: np.ndarray, v: np.ndarray, of: np.ndarray, rows: int, asked: int) -> Settings:
    """The cheapest settings that find TARGET of the true neighbours v of the queries q[of], for `asked` queries of `rows`."""
    if not len(of):
        return Settings(1, 1, 0)
    width, best = q.shape[1], None
    for second in (0, *(1 << k for k in range(width.bit_length()))):
        least = None
        for table in range(MAX_TABLES):
            rank = _rank(q, v, of, table, second)
            least = rank if least is None else np.minimum(least, rank)
            own = Settings(table + 1, int(np.sort(least)[math.ceil(TARGET * len(least)) - 1]) + 1, second)
            if second and own.probes > MAX_PROBES:
                continue
            met = min(1.0, own.tables * own.probes / own.buckets(width)) * rows
            cost = asked * (met + PROBE_COST * own.tables * own.probes) + FILE_COST * rows * own.tables
            if best is None or cost < best[0]:
                best = cost, own
    return best[1]


def _matrix(vectors: pa.Array | pa.ChunkedArray, width: int) -> np.ndarray:
    """Unit rows."""
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    sizes = vectors.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    x = np.zeros((len(vectors), width))
    row = np.repeat(np.arange(len(sizes)), sizes)
    x[row, np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = vectors.flatten().to_numpy(zero_copy_only=False)
    big = np.abs(x).max(axis=1, keepdims=True, initial=0)
    x = x / np.where(big > 0, big, 1)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _file(width: int, own: Settings, query: bool):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            x = _matrix(batch.column(1), width)
            for table in range(own.tables):
                at = probes(x, table, own.second, own.probes) if query else bucket(x, table, own.second)[:, None]
                rows = pa.array(np.repeat(np.arange(len(x)), at.shape[1]))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(rows), table, np.int32)), pa.array(at.ravel().astype(np.int32)), batch.column(0).take(rows), batch.column(1).take(rows)], ["table", "bucket", "id", "vector"])

    return run


def _compare(width: int, k: int):  # noqa: ANN202
    """The k + 1 nearest classes in its bucket of each query of a cell (its own class may be among them)."""

    def run(queries: pa.Table, vectors: pa.Table) -> pa.Table:
        out: list[tuple[np.ndarray, ...]] = []
        if len(queries) and len(vectors):
            queries, vectors = queries.sort_by("bucket"), vectors.sort_by("bucket")
            q_all, v_all = _matrix(queries["vector"], width), _matrix(vectors["vector"], width)
            asked, ids_all, of_q, of_v = (t[c].to_numpy() for t, c in ((queries, "id"), (vectors, "id"), (queries, "bucket"), (vectors, "bucket")))
            for b in np.intersect1d(of_q, of_v):
                (q0, q1), (v0, v1) = (np.searchsorted(x, [b, b + 1]) for x in (of_q, of_v))
                q, v, ids = q_all[q0:q1], v_all[v0:v1], ids_all[v0:v1]
                near = q @ v.T
                least = np.partition(near, -(k + 1), axis=1)[:, [-(k + 1)]] - 1e-9 if len(v) > k + 1 else -2
                row, col = np.nonzero(near >= least)
                score = np.concatenate([np.empty(0), *((v[col[a : a + 65536]] * q[row[a : a + 65536]]).sum(axis=1) for a in range(0, len(row), 65536))])  # in one order of summation, whatever the cell
                order = np.lexsort((ids[col], -score, row))
                row, col, score = row[order], col[order], score[order]
                first = np.arange(len(row)) - np.searchsorted(row, row) <= k
                out.append((asked[q0:q1][row[first]], ids[col[first]], score[first]))
        parts = [np.concatenate(x) for x in zip(*out, strict=True)] if out else [np.empty(0)] * 3
        return pa.table({"query_id": pa.array(parts[0].astype("int64")), "class": pa.array(parts[1].astype("int64")), "score": pa.array(parts[2].astype("float64"))})

    return run


def _met(queries: DataFrame, vectors: DataFrame, width: int, k: int) -> DataFrame:
    """Compare what lies in equal buckets, cell by cell."""
    count = lambda rows, name: rows.groupBy("table", "bucket").agg(F.count("*").alias(name))
    sizes = count(queries, "q").join(count(vectors, "v"), ["table", "bucket"])
    # Small buckets share a cell, large ones have several.
    run = Window.partitionBy("table").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    grp = F.floor(F.greatest(F.sum("v").over(run) / BLOCK_VECTORS, F.sum("q").over(run) / BLOCK_QUERIES)).cast("int")
    parts = lambda n, block: F.ceil(F.col(n) / block).cast("int")
    sizes = F.broadcast(sizes.select("table", "bucket", grp.alias("grp"), parts("q", BLOCK_QUERIES).alias("nq"), parts("v", BLOCK_VECTORS).alias("nv")))  # MAX_TABLES * 4 * width ** 2 rows at most
    part = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    keys = ["table", "grp", "i", "j"]
    own = ["table", (F.col("grp") + 0).alias("grp"), "i", "j"]  # a column of each side's own
    q = queries.join(sizes, ["table", "bucket"]).withColumn("i", part("nq")).withColumn("j", every("nv")).select(*own, "bucket", "id", "vector")
    v = vectors.join(sizes, ["table", "bucket"]).withColumn("j", part("nv")).withColumn("i", every("nq")).select(*own, "bucket", "id", "vector")
    return q.groupBy(*keys).cogroup(v.groupBy(*keys)).applyInArrow(_compare(width, k), "query_id long, class long, score double")


def search(spark: SparkSession, table: DataFrame, k: int = 5, every: int = 50) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of every row whose vec_id is divisible by `every`."""
    common.prepare(spark)
    kind = table.schema["embedding"].dataType.simpleString()
    kind = kind if kind == "array<float>" else "array<double>"
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists("embedding", lambda x: x != 0)
    rows = table.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(kind).alias("vector"), fine.alias("fine"))
    rows = rows.where("vec_id is not null and fine").select("vec_id", "vector").distinct()
    # Of equal vectors, the k + 1 smallest ids can be results; the limit is applied before the shuffle too.
    first = rows.withColumn("n", F.row_number().over(Window.partitionBy("vector").orderBy("vec_id"))).where(F.col("n") <= k + 1)
    classes = first.groupBy("vector").agg(F.array_sort(F.collect_list("vec_id")).alias("members"))
    classes = common.settle(spark, classes.select(F.element_at("members", 1).alias("class"), "vector", "members"), "classes")
    asked = common.settle(spark, rows.where(F.col("vec_id") % every == 0), "asked")
    n, longest = classes.agg(F.count("*"), F.max(F.size("vector"))).first()
    width = 1 << max(0, ((longest or 1) - 1).bit_length())
    shape = f"table int, bucket int, id long, vector {kind}"
    one = lambda rows, name: rows.select(F.lit(0).alias("table"), F.lit(0).alias("bucket"), F.col(name).alias("id"), "vector")

    def best(found: DataFrame) -> DataFrame:
        one = found.groupBy("query_id", "class").agg(F.max("score").alias("score")).join(classes.select("class", "members"), "class")
        one = one.withColumn("vec_id", F.explode("members")).where("vec_id <> query_id")
        rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
        return one.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

    sample = asked.orderBy(F.xxhash64("vec_id"), "vec_id").limit(FIT)
    near = _met(one(sample, "vec_id"), one(classes, "class"), width, k).where("class <> query_id")
    near = near.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "class"))).where(F.col("rank") <= k)
    near = near.join(classes.select("class", F.col("vector").alias("near")), "class").join(sample, F.col("vec_id") == F.col("query_id")).select("vector", "near").toArrow()  # FIT * k rows at most
    own = fit(_matrix(near["vector"], width), _matrix(near["near"], width), np.arange(len(near)), n, asked.count())

    asks = asked.mapInArrow(_file(width, own, True), shape)
    filed = classes.select("class", "vector").mapInArrow(_file(width, own, False), shape)
    out = common.settle(spark, best(_met(asks, filed, width, k)), "nearest")
    short = asked.select("vec_id", "vector").join(out.where(F.col("rank") == k).select(F.col("query_id").alias("vec_id")), "vec_id", "left_anti")
    if short.isEmpty():
        return out
    full = best(_met(one(short, "vec_id"), one(classes, "class"), width, k))
    return out.join(short.select(F.col("vec_id").alias("query_id")), "query_id", "left_anti").unionByName(full)
