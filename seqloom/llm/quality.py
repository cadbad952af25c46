"""Quality by co-training: a classifier of the text's content and one of the page's metadata teach each other.

The text view has the words of the text, hashed, and statistics of the whole text (letters, capitals, digits, marks, word and
line lengths, repetition), each cut into ranges; the metadata view has source, language and length. Both are logistic
regressions. In each of ROUNDS rounds each view labels those of all unlabelled documents of which it is surest, 2 * SURE in the
proportion of the labels, for the other view. At the end each view is calibrated (Platt) on labelled rows that neither was
fitted on, and a regression on both calibrated logits scores every document.

Defined cases: null texts count as empty; null source or language is a value of its own; unlabelled tables, or labels of one
class, give every row the smoothed rate of good labels; null labels, and those of documents that have both, teach nothing;
rows without doc_id have no label; repeated rows score alike; ties are broken by a hash of doc_id, then by row; very long texts
are read whole; empty tables give empty results; other columns aren't read.

Plan: one map over texts makes a row of numbers for each document, which meets its label and is written. Fitting takes a
bounded sample of labelled rows (MAX_LABELLED, the first by a hash of doc_id). Each round is a map over the written rows of
all unlabelled documents, in which a task passes on its surest ones; the surest of all, a fixed number, reach the driver.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from seqloom.llm import common

MAX_LABELLED, ROUNDS, SURE, RANGES, META, WORDS = 6000, 6, 60, 12, 64, 4096
_CLASS = np.full(256, 0, dtype=np.uint8)  # 0 letters and all beyond ASCII, 1 capitals, 2 digits, 3 marks, 4 white space
_CLASS[65:91], _CLASS[48:58] = 1, 2
_CLASS[[k for k in range(33, 127) if not chr(k).isalnum()]] = 3
_CLASS[[0x20, *range(9, 14)]] = 4
_VIEWS = "row long, stats array<float>, words binary, meta array<int>"


def statistics(data: bytes, words: list[bytes], counts: Counter) -> list[float]:
    a = np.frombuffer(data, dtype=np.uint8)
    share = np.bincount(_CLASS[a], minlength=5) / max(1, len(a))
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    marks = np.bincount(a, minlength=128)
    n = max(1, len(words))
    top = max(counts.values(), default=0)
    return [
        *share.tolist(),
        float(np.log1p(len(words))),
        float(lengths.mean()) if len(words) else 0.0,
        float(lengths.std()) if len(words) else 0.0,
        len(counts) / n,
        top / n,
        sum(w == v for w, v in zip(words, words[1:], strict=False)) / n,
        float(marks[ord("|")]) / n,
        float(marks[ord("!")]) / n,
        float(marks[[ord(c) for c in "#$%&*"]].sum()) / n,
        float(marks[[ord(c) for c in ".,"]].sum()) / n,
        (data.count(b"\n") + 1) / n,
    ]


NUMBERS = 16


def text_view(text: str | None) -> tuple[list[float], bytes]:
    """The statistics, and the places of the distinct words, in order."""
    data = (text or "").encode("utf-8", "surrogatepass")
    words = data.split()
    counts = Counter(words)
    places = {zlib.crc32(w.lower()) % WORDS for w in counts}
    return statistics(data, words, counts), np.array(sorted(places), dtype=np.uint16).tobytes()


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [text_view(t.as_py()) for t in batch.column(1)]
        meta = []
        for lang, source, n in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True):
            meta.append([zlib.crc32(f"lang {lang}".encode()) % META, zlib.crc32(f"source {source}".encode()) % META, min(20, int(2 * np.log1p(max(0, n or 0))))])
        arrays = [batch.column(0), batch.column(5), pa.array([t[0] for t in texts], pa.list_(pa.float32())), pa.array([t[1] for t in texts], pa.binary()), pa.array(meta, pa.list_(pa.int32()))]
        yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "key", "stats", "words", "meta"])


@dataclass
class Rows:
    """Both views of some documents."""

    stats: np.ndarray
    words: list[bytes]
    meta: np.ndarray

    @staticmethod
    def of(batch: pa.RecordBatch | pa.Table) -> Rows:
        flat = lambda c, kind, width: np.array(batch.column(c).to_pylist(), dtype=kind).reshape(-1, width)
        return Rows(flat("stats", np.float32, NUMBERS), batch.column("words").to_pylist(), flat("meta", np.int64, 3))

    def __len__(self) -> int:
        return len(self.words)

    def take(self, at: np.ndarray) -> Rows:
        return Rows(self.stats[at], [self.words[k] for k in at], self.meta[at])

    def plus(self, other: Rows) -> Rows:
        return Rows(np.concatenate([self.stats, other.stats]), self.words + other.words, np.concatenate([self.meta, other.meta]))


class Text:
    """The text view's features: a range for each number, each word's place by the root of their number, and a one."""

    def __init__(self, rows: Rows, edges: np.ndarray) -> None:
        self.n = len(rows)
        self.ranges = np.column_stack([k * RANGES + np.searchsorted(edges[k], rows.stats[:, k]) for k in range(NUMBERS)]) if self.n else np.empty((0, NUMBERS), dtype=np.int64)
        sizes = np.array([len(w) // 2 for w in rows.words], dtype=np.int64)
        self.words = np.frombuffer(b"".join(rows.words), dtype=np.uint16).astype(np.int64) + NUMBERS * RANGES
        self.row = np.repeat(np.arange(self.n), sizes)
        self.unit = 1 / np.sqrt(np.maximum(1, sizes))

    def logit(self, w: np.ndarray) -> np.ndarray:
        return w[self.ranges].sum(axis=1) + np.bincount(self.row, w[self.words], self.n) * self.unit + w[-1]

    def gradient(self, e: np.ndarray, size: int) -> np.ndarray:
        out = np.bincount(self.ranges.ravel(), np.repeat(e, NUMBERS), size) + np.bincount(self.words, (e * self.unit)[self.row], size)
        out[-1] = e.sum()
        return out


def _fit_text(x: Text, y: np.ndarray, w: np.ndarray | None, l2: float = 1e-3) -> np.ndarray:
    """Logistic regression by gradient steps of lengths of each feature's own; w: weights to go on from."""
    size = NUMBERS * RANGES + WORDS + 1
    steps, w = (60, w.copy()) if w is not None else (200, np.zeros(size))
    past = np.full(size, 1e-8)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x.logit(w), -30, 30)))
        g = x.gradient((p - y) / len(y), size) + l2 * w
        past += g * g
        w -= 0.3 * g / np.sqrt(past)
    return w


def _meta(m: np.ndarray) -> np.ndarray:
    out = np.zeros((len(m), 2 * META + 21))
    for k, at in enumerate((0, META, 2 * META)):
        out[np.arange(len(m)), at + m[:, k]] = 1
    return out


def _fit(x: np.ndarray, y: np.ndarray, l2: float = 1e-3, steps: int = 25) -> np.ndarray:
    """Logistic regression with an intercept, by Newton's method."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (p - y) / len(y) + l2 * w
        h = (x * (p * (1 - p))[:, None]).T @ x / len(y) + l2 * np.eye(len(w))
        step = np.linalg.solve(h, g)
        w = w - step
        if np.abs(step).max() < 1e-6:
            break
    return w


def _logit(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return np.clip(x @ w[:-1] + w[-1], -20, 20)


def _both(rows: Rows, edges: np.ndarray, weights: list[np.ndarray]) -> list[np.ndarray]:
    """The logits of both views."""
    return [np.clip(Text(rows, edges).logit(weights[0]), -20, 20), _logit(_meta(rows.meta), weights[1])]


def _surest(edges: np.ndarray, weights: list[np.ndarray], numbers: tuple[int, int], known: frozenset[int]):  # noqa: ANN202
    """Of a task's rows those of which a view is surest, `numbers` of label 0 and 1, but for known ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []

        def best() -> pa.Table:
            return pa.concat_tables(t.sort_by([("z", "descending"), ("tie", "ascending"), ("row", "ascending")])[: numbers[label]] for view in (0, 1) for label in (0, 1) for t in [pa.concat_tables(held).filter((pc.field("view") == view) & (pc.field("label") == label))])

        for batch in batches:
            z = _both(Rows.of(batch), edges, weights)
            ids = batch.column("row").to_numpy()
            free = np.array([k not in known for k in ids.tolist()], dtype=bool)
            for view in (0, 1):
                for label in (0, 1):
                    sure = z[view] if label else -z[view]
                    at = np.flatnonzero(free & (sure > 0))
                    if len(at) > numbers[label]:
                        least = np.partition(sure[at], -numbers[label])[-numbers[label]]
                        at = at[sure[at] >= least]
                    own = pa.Table.from_batches([batch.take(pa.array(at))])
                    held.append(own.append_column("view", pa.array(np.full(len(at), view, np.int32))).append_column("label", pa.array(np.full(len(at), label, np.int32))).append_column("z", pa.array(sure[at])))
            held = [best()]
        if held:
            yield from held[0].to_batches()

    return run


def cotrain(spark: SparkSession, known: Rows, y: np.ndarray, pool: DataFrame) -> dict:
    """Fit both views. y: labels of the known rows, every fourth of which calibrates; pool: the rows of all other documents."""
    if len(y) < 8 or y.min() == y.max():
        rate = (y.sum() + 1) / (len(y) + 2)
        return {"rate": float(np.log(rate / (1 - rate)))}
    edges = np.quantile(known.stats, np.linspace(0, 1, RANGES + 1)[1:-1], axis=0).T
    fit = np.flatnonzero(np.arange(len(y)) % 4 != 0)
    given = [(known.take(fit), y[fit])] * 2
    used: set[int] = set()
    text = None
    good = min(2 * SURE - 1, max(1, round(2 * SURE * float(y[fit].mean()))))  # in the proportion of the labels
    numbers = (2 * SURE - good, good)
    for turn in range(ROUNDS + 1):
        text = _fit_text(Text(given[0][0], edges), given[0][1], text)
        weights = [text, _fit(_meta(given[1][0].meta), given[1][1])]
        if turn == ROUNDS:
            break
        found = pool.mapInArrow(_surest(edges, weights, numbers, frozenset(used)), f"tie long, {_VIEWS}, view int, label int, z double")
        place = F.row_number().over(Window.partitionBy("view", "label").orderBy(F.desc("z"), "tie", "row"))
        found = found.withColumn("place", place).where(F.col("place") <= F.when(F.col("label") == 1, numbers[1]).otherwise(numbers[0])).orderBy("view", "label", "place").toArrow()
        if not len(found):
            break
        rows, view, label, ids = Rows.of(found), found["view"].to_numpy(), found["label"].to_numpy(), found["row"].to_numpy()
        for k in (0, 1):
            at = np.array([i for i in np.flatnonzero(view == k) if int(ids[i]) not in used], dtype=np.int64)
            used.update(ids[at].tolist())
            given[1 - k] = given[1 - k][0].plus(rows.take(at)), np.concatenate([given[1 - k][1], label[at]])
    hold = np.setdiff1d(np.arange(len(y)), fit)
    z = _both(known.take(hold), edges, weights)
    platt = [_fit(v[:, None], y[hold], 1e-4) for v in z]
    both = np.column_stack([v * p[0] + p[1] for v, p in zip(z, platt, strict=True)])
    return {"edges": edges, "weights": weights, "platt": platt, "mix": _fit(both, y[hold], 1e-3)}


def apply(model: dict, rows: Rows) -> np.ndarray:
    """Columns: the text view's, the metadata view's, and the combined probability."""
    p = lambda z: 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    if "rate" in model:
        return np.full((len(rows), 3), p(model["rate"]))
    z = [v * c[0] + c[1] for v, c in zip(_both(rows, model["edges"], model["weights"]), model["platt"], strict=True)]
    return np.column_stack([p(z[0]), p(z[1]), p(_logit(np.column_stack(z), model["mix"]))])


def score(spark: SparkSession, docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """doc_id, held_out, text_score, meta_score, score, keep; labels of held-out rows teach nothing."""
    common.prepare(spark)
    names = set(docs.columns)
    of = lambda c, kind: F.col(c).cast(kind) if c in names else F.lit(None).cast(kind)
    key = F.coalesce(F.col("doc_id").cast("long"), F.xxhash64("text"))  # spreads rows without doc_id
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", of("lang", "string"), of("source", "string"), of("n_chars", "long"), key.alias("key"))
    rows = own.mapInArrow(_read, "doc_id long, key long, stats array<float>, words binary, meta array<int>")
    known = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("of"))
    known = known.agg(F.min("quality").alias("quality"), F.max("quality").alias("most")).where("quality = most").select("of", "quality")
    rows = rows.join(known.hint("merge"), (F.col("key") == F.col("of")) & F.col("doc_id").isNotNull(), "left").drop("of", "key")
    rows = common.settle(spark, rows.withColumn("row", F.monotonically_increasing_id()).withColumn("tie", F.xxhash64("doc_id")), "views")
    held = F.coalesce(common.remainder("doc_id", 3) == 1, F.lit(False))
    train = rows.where(F.col("quality").isNotNull() & ~held).orderBy("tie", "doc_id", "row").limit(MAX_LABELLED).toArrow()
    model = cotrain(spark, Rows.of(train), train["quality"].to_numpy().astype(np.float64), rows.where("quality is null").select("tie", "row", "stats", "words", "meta"))
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = apply(shared.value, Rows.of(batch))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array(s[:, k]) for k in range(3)]], ["doc_id", "text_score", "meta_score", "score"])

    out = rows.select("doc_id", "stats", "words", "meta").mapInArrow(run, "doc_id long, text_score double, meta_score double, score double")
    return out.select("doc_id", held.alias("held_out"), "text_score", "meta_score", "score", (F.col("score") >= threshold).cast("int").alias("keep"))
