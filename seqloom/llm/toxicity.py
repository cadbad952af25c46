"""Toxicity: a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

A document's features are the distinct n-grams (orders 4 to 7, in bytes) of its whole lower-cased text, each white-space
character counted as a space. From a bounded sample of labelled rows come, for each n-gram, the log ratio of its smoothed
document rates in the two classes; the n-grams whose counts differ significantly (G2) are kept, their presence is multiplied
by that ratio, and a logistic regression is fitted on the products.

Defined cases: a null text scores as an empty one, which scores as a text without any kept n-gram; repeated rows score
alike; unlabelled tables, or labels of one class only, give every row the smoothed rate of toxic labels; null labels teach
nothing; other columns pass through `score_column` untouched. Scoring is a map over rows: no shuffle, nothing collected.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seqloom.llm import common

ORDERS = (4, 5, 6, 7)
#: Bounds of the training sample: labelled rows of class 0 and 1, bytes of one row (longer rows aren't sampled) and of all.
MAX_ROWS, MAX_ROW_BYTES, MAX_BYTES = (2000, 1000), 200_000, 10_000_000
MAX_FEATURES, MIN_G2, SLOTS = 3000, 24.0, 1 << 20
_MIX = np.uint64(0x9E3779B97F4A7C15)
_SPACE = np.arange(256, dtype=np.uint8)
_SPACE[9:14] = 32


def grams(text: str | None) -> Iterator[np.ndarray]:
    """Codes of the n-grams of one text, order by order: up to 7 bytes and, on top, the order; no two n-grams share a code."""
    a = _bytes(text).astype(np.uint64)
    code = a
    for n in range(2, max(ORDERS) + 1):
        if len(a) < n:
            return
        code = (code[:-1] << np.uint64(8)) | a[n - 1 :]
        if n in ORDERS:
            yield code | np.uint64(n << 56)


def _bytes(text: str | None) -> np.ndarray:
    data = f" {text.lower()} ".encode("utf-8", "surrogatepass") if text else b""
    return _SPACE[np.frombuffer(data, dtype=np.uint8)]


def _slot(codes: np.ndarray, bits: int = 20) -> np.ndarray:
    return (codes * _MIX) >> np.uint64(64 - bits)


def _slot4(codes: np.ndarray) -> np.ndarray:
    return (codes * np.uint32(2654435761)) >> np.uint32(12)


@dataclass
class Model:
    codes: np.ndarray
    weights: np.ndarray
    bias: float

    def __post_init__(self) -> None:
        # A slot holds the first of its features; the few others are compared in full.
        self.slots = np.full(SLOTS, -1, dtype=np.int32)
        rest = []
        for i, s in enumerate(_slot(self.codes)):
            if self.slots[s] < 0:
                self.slots[s] = i
            else:
                rest.append(i)
        self.rest = np.array(rest, dtype=np.int64)
        # Every feature starts with four bytes; a place where no feature's four stand isn't looked at again.
        order = self.codes >> np.uint64(56)
        first = ((self.codes & np.uint64((1 << 56) - 1)) >> (np.uint64(8) * (order - np.uint64(4)))).astype(np.uint32)
        self.gate = np.zeros(SLOTS, dtype=bool)
        self.gate[_slot4(first)] = True

    def features(self, text: str | None) -> np.ndarray:
        """Indexes of the kept n-grams that occur in the text."""
        a = _bytes(text)
        if len(a) < 4 or not len(self.codes):
            return np.empty(0, dtype=np.int64)
        b = a.astype(np.uint32)
        four = (b[:-3] << np.uint32(24)) | (b[1:-2] << np.uint32(16)) | (b[2:-1] << np.uint32(8)) | b[3:]
        at = np.flatnonzero(self.gate[_slot4(four)])
        code, found = four[at].astype(np.uint64), []
        for n in ORDERS:
            if n > 4:
                inside = at + n <= len(a)
                at, code = at[inside], code[inside]
                code = (code << np.uint64(8)) | a[at + (n - 1)]
            own = code | np.uint64(n << 56)
            k = self.slots[_slot(own)]
            k, of = k[k >= 0], own[k >= 0]
            found.append(k[self.codes[k] == of])
            if len(self.rest):
                found.append(self.rest[np.isin(self.codes[self.rest], own)])
        return np.unique(np.concatenate(found))

    def score(self, text: str | None) -> float:
        z = self.bias + float(self.weights[self.features(text)].sum())
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def _g2(p: np.ndarray, q: np.ndarray, n1: float, n0: float) -> np.ndarray:
    xlogx = lambda x: x * np.log(np.maximum(x, 1e-300))
    whole = xlogx(n1 + n0) - xlogx(n1) - xlogx(n0)
    return 2 * (xlogx(p) + xlogx(n1 - p) + xlogx(q) + xlogx(n0 - q) + whole - xlogx(p + q) - xlogx(n1 + n0 - p - q))


def fit(rows: list[tuple[str | None, int]]) -> Model:
    """Fit on (text, label) rows that fit in memory."""
    y = np.array([label for _, label in rows], dtype=np.float64)
    n1, n0 = float(y.sum()), float(len(y) - y.sum())
    none = Model(np.empty(0, np.uint64), np.empty(0), float(np.log((n1 + 1) / (n0 + 1))))
    if not n1 or not n0:
        return none
    # First counts by slot, to leave out in bounded memory what can't be significant; then exact ones of what is left.
    bits = 22
    slots = np.zeros((2, 1 << bits), dtype=np.int32)
    distinct = lambda text: np.unique(np.concatenate([*grams(text), np.empty(0, np.uint64)]))
    for text, label in rows:
        slots[label][np.unique(_slot(distinct(text), bits))] += 1
    often = np.flatnonzero(slots.sum(axis=0) >= 4)
    keep = np.zeros(1 << bits, dtype=bool)
    keep[often] = _g2(slots[1][often].astype(np.float64), slots[0][often].astype(np.float64), n1, n0) >= MIN_G2 / 2
    sets = [(s := distinct(text))[keep[_slot(s, bits)]] for text, _ in rows]
    codes = np.unique(np.concatenate(sets))
    p, q = np.zeros(len(codes)), np.zeros(len(codes))
    for s, label in zip(sets, y, strict=True):
        (p if label else q)[np.searchsorted(codes, s)] += 1
    g2 = _g2(p, q, n1, n0)
    ratio = np.log((p + 1) / (n1 + 2)) - np.log((q + 1) / (n0 + 2))
    best = np.lexsort((codes, -g2))[:MAX_FEATURES]
    best = np.sort(best[g2[best] >= MIN_G2])
    if not len(best):
        return none
    codes, ratio = codes[best], ratio[best]
    x = np.stack([_within(codes, s) for s in sets]).astype(np.float32) * ratio.astype(np.float32)
    weights, bias = _logistic(x, y)
    return Model(codes, weights * ratio, bias)


def _within(codes: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    if not len(ordered):
        return np.zeros(len(codes), dtype=bool)
    at = np.minimum(np.searchsorted(ordered, codes), len(ordered) - 1)
    return ordered[at] == codes


def _logistic(x: np.ndarray, y: np.ndarray, l2: float = 1e-3, steps: int = 400) -> tuple[np.ndarray, float]:
    """L2-regularised logistic regression by accelerated gradient descent."""
    n, d = x.shape
    top = np.random.default_rng(7).normal(size=d).astype(np.float32)
    for _ in range(12):  # largest eigenvalue of x'x/n, for the step length
        top = x.T @ (x @ top)
        top /= np.linalg.norm(top) + 1e-12
    rate = 1 / (0.25 * (np.linalg.norm(x @ top) ** 2 / n + 1) + l2)
    w, b = np.zeros(d), float(np.log(y.mean() / (1 - y.mean())))
    pw, pb = w, b
    for k in range(steps):
        m = k / (k + 3)
        vw, vb = w + m * (w - pw), b + m * (b - pb)
        e = 1 / (1 + np.exp(-np.clip(x @ vw.astype(np.float32) + vb, -30, 30))) - y
        pw, pb = w, b
        w, b = vw - rate * (x.T @ e.astype(np.float32) / n + l2 * vw), vb - rate * float(e.mean())
    return w, b


def train(docs: DataFrame, labels: DataFrame, where: Column | None = None) -> Model:
    """Fit on the sample of labelled rows: of each class the MAX_ROWS first by a hash of doc_id
    that are within the size bounds; the classes' rates of all labels set the intercept."""
    labels = labels.select("doc_id", F.col("toxic").alias("label")).where(F.col("label").isin(0, 1)).dropna()
    labels = labels if where is None else labels.where(where)
    order = F.xxhash64("doc_id")
    rate = labels.agg(F.sum("label"), F.count("*")).first()
    picked = labels.where("label = 1").orderBy(order, "doc_id").limit(MAX_ROWS[1]).union(labels.where("label = 0").orderBy(order, "doc_id").limit(MAX_ROWS[0]))
    own = docs.select("doc_id", "text")
    sizes = own.join(F.broadcast(picked), "doc_id").select("doc_id", "label", F.coalesce(F.octet_length("text"), F.lit(0)).alias("n"))
    chosen, total = [], 0
    for r in sorted(sizes.where(F.col("n") <= MAX_ROW_BYTES).groupBy("doc_id", "label").agg(F.sum("n").alias("n")).collect(), key=lambda r: r.doc_id * 2654435761 % 4294967296):
        total += r.n
        if total > MAX_BYTES:
            break
        chosen.append((r.doc_id, int(r.label)))
    if not chosen:
        return fit([])
    chosen = docs.sparkSession.createDataFrame(chosen, "doc_id long, label int")
    rows = [(r.doc_id, r.text, r.label) for r in own.join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "label").collect()]
    rows.sort(key=lambda r: (r[0], r[1] or "", r[2]))
    model = fit([r[1:] for r in rows])
    own = sum(r[2] for r in rows)
    if 0 < own < len(rows):
        ones, all_ = float(rate[0]), float(rate[1])
        model.bias += float(np.log(ones / max(1, all_ - ones)) - np.log(own / (len(rows) - own)))
    return model


def score_column(spark: SparkSession, model: Model, text: str = "text") -> Column:
    shared = spark.sparkContext.broadcast((model.codes, model.weights, model.bias))  # MAX_FEATURES numbers at most

    @F.pandas_udf(T.DoubleType())
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        common.working("toxicity")
        own = Model(*shared.value)
        for texts in batches:
            yield pd.Series([own.score(t) for t in texts], dtype="float64")

    return score(F.col(text))


def scored(spark: SparkSession, docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score, predicted; labels of held-out rows teach nothing."""
    held = common.remainder("doc_id", 3) == 1
    model = train(docs, labels, F.coalesce(~held, F.lit(True)))
    out = docs.select("doc_id", "text").withColumn("score", score_column(spark, model))
    return out.select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def clean(spark: SparkSession, docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """docs without the rows that score as toxic; their columns, whatever they are called, stay as they are."""
    held = common.remainder("doc_id", 3) == 1
    model = train(docs, labels, F.coalesce(~held, F.lit(True)))
    return docs.where(score_column(spark, model) < threshold)
