"""Language-model scoring: a log-bilinear model trained by noise-contrastive estimation.

A word is predicted from the two before it: their vectors, each turned by a matrix of its place, add up to r, and the score of
word w is r q_w + b_w. Training is noise-contrastive (numpy, noise from the unigram distribution, shared within a batch).
As the two places only add up, the normaliser of all pairs of contexts is one matrix product of exponentials:
Z[u, v] = sum over w of exp(r1_u q_w) exp(r2_v q_w + b_w), so scoring looks three numbers up for each token and the
probabilities are exactly normalised.

The model's outcomes are the MODEL_WORDS most frequent words, the end, and BUCKETS classes for all other words by their last
two bytes; within a class a word has its share of the class's training tokens, one added to each, and one for unseen words.

Defined cases: a null text is an empty one, which has one token, its end; rows that share a doc_id are scored one by one;
held-out rows teach nothing, rows without doc_id are not held out; with nothing to learn from, all words are unseen; ties in
frequency go to the smaller word; empty tables give empty results; other columns aren't read.

Plan: texts are read twice, for the counts and into 16-bit outcomes, which are written; training and scoring read those. Words
are counted in the tasks before they are shuffled. The frequent words, KEEP at most, are broadcast with their
counts; the counts of all other words reach the texts by a join on the word, in which no word is frequent. Training is one
pass in ROUNDS rounds: each training document is in one of them, with all its positions. The tasks of a round begin from the
same start; their parameter vectors are averaged in a tree, FAN to one, so a round sends one vector a task and one to the
driver. The model so depends, within the noise of stochastic training, on how the table is split into tasks: the same files
and settings give the same scores, another split slightly other ones. Counts, base_score and the shares in classes don't.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.llm import common

MODEL_WORDS, BUCKETS, KEEP, WIDTH = 1200, 400, 120_000, 24
ROUNDS, BATCH, NOISE, RATIO, RATE = 2, 2048, 64, 16.0, 0.05
SMOOTH_WORDS = 250_000
FAN = 64
END = b""


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: dict[bytes, int] = {}

    def rows() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])

    for batch in batches:
        for text in batch.column(0):
            words = common.tokens(text.as_py())
            get = counts.get
            for w in words:
                counts[w] = get(w, 0) + 1
            counts[END] = get(END, 0) + 1
            if len(counts) >= SMOOTH_WORDS:
                yield rows()
                counts.clear()
    yield rows()


def bucket(word: bytes) -> int:
    return zlib.crc32(word[-2:]) % BUCKETS


@dataclass
class Vocabulary:
    """Frequent words with their outcome and log10(count + 1); of each class of other words, its training tokens and types."""

    words: list[bytes]
    counts: np.ndarray
    n_model: int
    class_tokens: np.ndarray
    class_types: np.ndarray
    total: int
    types: int

    @property
    def outcomes(self) -> int:
        return self.n_model + 1 + BUCKETS  # words, the end, classes

    @property
    def end(self) -> int:
        return self.n_model

    def outcome(self, place: int, word: bytes) -> int:
        return place if place < self.n_model else self.n_model + 1 + bucket(word)


def vocabulary(counts: DataFrame) -> Vocabulary:
    """From the table of (word, n); what reaches the driver is bounded by KEEP and BUCKETS."""
    total, types = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    ends = counts.where(F.col("word") == F.lit(END)).first()
    words = counts.where(F.col("word") != F.lit(END))
    # Classes of near counts; the highest that hold KEEP words at most together. No task sends more than its share of these.
    near = F.floor(16 * F.log2(F.col("n").cast("double"))).cast("int")
    least, held = None, 0
    for r in sorted(words.groupBy(near.alias("k")).agg(F.count("*").alias("words")).collect(), reverse=True):
        held += r.words
        if held > KEEP:
            break
        least = r.k
    kept = words.where(near >= least).select("word", "n").toArrow() if least is not None else pa.table({"word": pa.array([], pa.binary()), "n": pa.array([], pa.int64())})
    top = sorted(zip(kept["word"].to_pylist(), kept["n"].to_pylist(), strict=True), key=lambda r: (-r[1], r[0]))
    n_model = min(MODEL_WORDS, len(top))
    own = [w for w, _ in top]
    tokens, kinds = np.zeros(BUCKETS), np.zeros(BUCKETS)
    at = F.col("word")
    suffix = F.substring(at, -2, 2)
    for r in words.groupBy((F.crc32(suffix) % BUCKETS).alias("b")).agg(F.sum("n").alias("n"), F.count("*").alias("k")).collect():
        tokens[r.b], kinds[r.b] = r.n, r.k
    for word, n in top[:n_model]:
        b = bucket(word)
        tokens[b] -= n
        kinds[b] -= 1
    found = Vocabulary(own, np.array([n for _, n in top], dtype=np.float64), n_model, tokens, kinds, int(total), int(types))
    found.ends = int(ends.n) if ends else 0
    return found


class Reader:
    """Texts to numbers of the vocabulary."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        self.v = vocabulary
        self.place = {w: k for k, w in enumerate(vocabulary.words)}
        self.outcome = np.array([vocabulary.outcome(k, w) for k, w in enumerate(vocabulary.words)] + [0], dtype=np.int64)
        self.of_suffix: dict[bytes, int] = {}

    def rare(self, word: bytes) -> int:
        key = word[-2:]
        if key not in self.of_suffix:
            if len(self.of_suffix) > 100_000:
                self.of_suffix.clear()
            self.of_suffix[key] = self.v.n_model + 1 + bucket(word)
        return self.of_suffix[key]

    def read(self, text: str | None) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
        """Places in the vocabulary (-1: not kept), outcomes with the end, and the words that aren't kept."""
        words = common.tokens(text)
        get = self.place.get
        places = np.fromiter([get(w, -1) for w in words], np.int64, len(words))
        outcomes = np.append(self.outcome[places], self.v.end)
        at = np.flatnonzero(places < 0)
        rest = [words[k] for k in at]
        if rest:
            outcomes[at] = [self.rare(w) for w in rest]
        return places, outcomes, rest


class Model:
    """Parameters in one flat float32 vector: context vectors (the last for what is before a text), outcome vectors, biases,
    and the matrices of the two places, the farther first."""

    def __init__(self, outcomes: int, flat: np.ndarray) -> None:
        n, d = outcomes, WIDTH
        sizes = [(n + 1) * d, n * d, n, d * d, d * d]
        parts = np.split(flat, np.cumsum(sizes)[:-1])
        self.n, self.flat = n, flat
        self.context, self.target, self.bias = parts[0].reshape(n + 1, d), parts[1].reshape(n, d), parts[2]
        self.places = parts[3].reshape(d, d), parts[4].reshape(d, d)

    @staticmethod
    def start(unigram: np.ndarray) -> Model:
        rng = np.random.Generator(np.random.PCG64(11))
        n, d = len(unigram), WIDTH
        flat = np.concatenate([rng.normal(0, 0.1, (2 * n + 1) * d), np.log(unigram), np.tile(np.eye(d).ravel(), 2)])
        return Model(n, flat.astype(np.float32))

    def train(self, far: np.ndarray, near: np.ndarray, word: np.ndarray, unigram: np.ndarray, state: np.ndarray, rng: np.random.Generator) -> None:
        """One step by noise-contrastive estimation over a batch, with per-parameter step lengths."""
        noise = rng.choice(self.n, NOISE, p=unigram)
        prior = np.log(RATIO * unigram).astype(np.float32)
        x, y = self.context[far], self.context[near]
        r = x @ self.places[0] + y @ self.places[1]
        q, qn = self.target[word], self.target[noise]
        good = _sigmoid(np.einsum("ij,ij->i", r, q) + (self.bias - prior)[word]) - 1
        bad = _sigmoid(r @ qn.T + (self.bias - prior)[noise])
        bad *= np.float32(RATIO / NOISE)
        dr = good[:, None] * q + bad @ qn
        grad = Model(self.n, np.zeros_like(self.flat))
        np.matmul(x.T, dr, out=grad.places[0])
        np.matmul(y.T, dr, out=grad.places[1])
        _add(grad.context, far, dr @ self.places[0].T)
        _add(grad.context, near, dr @ self.places[1].T)
        _add(grad.target, word, good[:, None] * r)
        _add(grad.target, noise, bad.T @ r)
        grad.bias += np.bincount(word, good, self.n).astype(np.float32) + np.bincount(noise, bad.sum(axis=0), self.n).astype(np.float32)
        g = grad.flat
        g /= len(word)
        state += g * g
        step = np.sqrt(state)
        step += np.float32(1e-5)
        g *= np.float32(RATE)
        g /= step
        self.flat -= g

    def scores(self) -> tuple[np.ndarray, np.ndarray]:
        """By (farther, word) and (nearer, word)."""
        return self.context @ self.places[0] @ self.target.T, self.context @ self.places[1] @ self.target.T + self.bias

    def tables(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The scores, and the log normaliser by (farther, nearer)."""
        one, two = self.scores()
        a, b = one.max(axis=1), two.max(axis=1)
        return one, two, np.log(np.exp(one - a[:, None]) @ np.exp(two - b[:, None]).T + np.float32(1e-30)) + a[:, None] + b


def _sigmoid(x: np.ndarray) -> np.ndarray:
    """In place."""
    np.clip(x, -30, 30, out=x)
    np.negative(x, out=x)
    np.exp(x, out=x)
    x += 1
    return np.reciprocal(x, out=x)


def _add(to: np.ndarray, rows: np.ndarray, values: np.ndarray) -> None:
    """to[rows] += values, repeated rows added up; to is contiguous."""
    at = rows[:, None] * to.shape[1] + np.arange(to.shape[1])
    np.add.at(to.reshape(-1), at.ravel(), values.ravel())


def _contexts(outcomes: np.ndarray, before: int) -> tuple[np.ndarray, np.ndarray]:
    padded = np.concatenate([[before, before], outcomes])
    return padded[:-2], padded[1:-1]


def unigram(v: Vocabulary) -> np.ndarray:
    counts = np.concatenate([v.counts[: v.n_model], [v.ends], v.class_tokens]) + 1
    return counts / counts.sum()


def _batched(sequences: Iterator[np.ndarray], before: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Both contexts and the outcome of every position of sequences of outcomes, BATCH together, fewer only in the last."""
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    size = 0
    for outcomes in sequences:
        held.append((*_contexts(outcomes, before), outcomes))
        size += len(outcomes)
        if size >= BATCH:
            far, near, word = (np.concatenate(x) for x in zip(*held, strict=True))
            full = size - size % BATCH
            for k in range(0, full, BATCH):
                yield far[k : k + BATCH], near[k : k + BATCH], word[k : k + BATCH]
            held, size = [(far[full:], near[full:], word[full:])], size - full
    if size:
        far, near, word = (np.concatenate(x) for x in zip(*held, strict=True))
        yield far, near, word


def lessons(texts: Iterator[str | None], reader: Reader) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Those of texts."""
    return _batched((reader.read(text)[1] for text in texts), reader.v.outcomes)


def encoded(spark: SparkSession, texts: DataFrame, v: Vocabulary) -> DataFrame:
    """texts (doc_id, text, held_out) read once and written: row, doc_id, held_out, n (tokens), known (of kept words), base (sum of
    their log10 counts), within (log10 of shares in classes, as far as kept words go), outcomes (16-bit), rest (words not kept)."""
    shared = spark.sparkContext.broadcast(v)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = shared.value
        reader = Reader(v)
        log_count = np.append(np.log10(v.counts + 1), 0.0)
        share = np.zeros(v.outcomes)
        share[v.n_model + 1 :] = np.log10(v.class_tokens + v.class_types + 1)
        rare = np.arange(v.outcomes) > v.n_model
        for batch in batches:
            rows = []
            for text in batch.column(2):
                places, outcomes, rest = reader.read(text.as_py())
                logs = log_count[places]
                within = float(logs[rare[outcomes[:-1]]].sum() - share[outcomes].sum())
                rows.append((len(outcomes), int((places >= 0).sum()) + (v.ends > 0), float(logs.sum()) + np.log10(v.ends + 1), within, outcomes.astype(np.uint16).tobytes(), rest))
            n, known, base, value, ids, rest = zip(*rows, strict=True) if rows else ((),) * 6
            arrays = [pa.array(n, pa.int64()), pa.array(known, pa.int64()), pa.array(base, pa.float64()), pa.array(value, pa.float64()), pa.array(ids, pa.binary()), pa.array(rest, pa.list_(pa.binary()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *arrays], ["doc_id", "held_out", "n", "known", "base", "within", "outcomes", "rest"])

    own = texts.select("doc_id", "held_out", "text").mapInArrow(run, "doc_id long, held_out boolean, n long, known long, base double, within double, outcomes binary, rest array<binary>")
    return common.settle(spark, own.withColumn("row", F.monotonically_increasing_id()), "encoded")


def train(spark: SparkSession, texts: DataFrame, v: Vocabulary) -> Model:
    """texts: doc_id, text of the training documents, or what `encoded` made of them."""
    if "outcomes" not in texts.columns:
        texts = encoded(spark, texts.withColumn("held_out", F.lit(False)), v)
    noise = unigram(v)
    model, before = Model.start(noise), v.outcomes
    for turn in range(ROUNDS):
        start = spark.sparkContext.broadcast(model.flat)

        def run(batches: Iterator[pa.RecordBatch], turn: int = turn, start=start) -> Iterator[pa.RecordBatch]:  # noqa: ANN001
            own = Model(before, start.value.copy())
            state = np.full_like(own.flat, 1e-6)
            rng = np.random.Generator(np.random.PCG64(turn))
            seen = 0
            for far, near, word in _batched((np.frombuffer(x.as_py(), np.uint16).astype(np.int64) for batch in batches for x in batch.column(0)), before):
                own.train(far, near, word, noise, state, rng)
                seen += len(word)
            if seen:
                yield pa.RecordBatch.from_arrays([pa.array([float(seen)]), pa.array([own.flat.tolist()], pa.list_(pa.float32()))], ["weight", "flat"])

        share = texts.where(F.pmod(F.xxhash64("doc_id", "outcomes"), F.lit(ROUNDS)) == turn)
        parts = common.settle(spark, share.select("outcomes").mapInArrow(run, "weight double, flat array<float>"), "parameters")
        n = parts.count()
        while n > 1:
            n = -(-n // FAN)
            parts = common.settle(spark, parts.repartition(n).mapInArrow(_mean, "weight double, flat array<float>"), "parameters")
        got = parts.first()
        model = Model(v.outcomes, np.array(got["flat"], dtype=np.float32)) if got else model
    return model


def _mean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The weighted mean of the vectors of a task, with the sum of their weights."""
    weight, total = 0.0, None
    for batch in batches:
        for w, flat in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            own = w * flat.values.to_numpy().astype(np.float64)
            weight, total = weight + w, own if total is None else total + own
    if total is not None:
        yield pa.RecordBatch.from_arrays([pa.array([weight]), pa.array([(total / weight).astype(np.float32)], pa.list_(pa.float32()))], ["weight", "flat"])


def counted(spark: SparkSession, texts: DataFrame) -> tuple[DataFrame, Vocabulary]:
    """From the training documents (text): the counts of their words, and the vocabulary."""
    counts = texts.select("text").mapInArrow(_count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
    counts = common.settle(spark, counts, "words")
    return counts, vocabulary(counts)


def score(spark: SparkSession, docs: DataFrame, modulus: int = 7, held: int = 2) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    common.prepare(spark)
    out = F.coalesce(common.remainder("doc_id", modulus) == held, F.lit(False))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", out.alias("held_out"))
    counts, v = counted(spark, texts.where("not held_out"))
    own = encoded(spark, texts, v)
    return applied(spark, own, counts, v, train(spark, own.where("not held_out"), v))


def applied(spark: SparkSession, own: DataFrame, counts: DataFrame, v: Vocabulary, model: Model) -> DataFrame:
    """The columns of `score` for what `encoded` made of texts."""
    one, two, norm = model.tables()
    shared = spark.sparkContext.broadcast((model.flat, norm))
    outcomes = v.outcomes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flat, norm = shared.value
        one, two = Model(outcomes, flat).scores()
        for batch in batches:
            values = []
            for x in batch.column("outcomes"):
                word = np.frombuffer(x.as_py(), np.uint16).astype(np.int64)
                far, near = _contexts(word, outcomes)
                values.append(float((one[far, word] + two[near, word] - norm[far, near]).sum(dtype=np.float64)) / np.log(10))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(values, pa.float64())], [*batch.schema.names[:-1], "model"])

    rest = own.select("row", F.explode("rest").alias("word")).join(counts, "word")
    rest = rest.groupBy("row").agg(F.count("*").alias("more"), F.sum(F.log10(F.col("n") + 1)).alias("logs"))
    both = own.select("row", "doc_id", "held_out", "n", "known", "base", "within", "outcomes").mapInArrow(run, "row long, doc_id long, held_out boolean, n long, known long, base double, within double, model double").join(rest, "row", "left")
    logs = F.coalesce("logs", F.lit(0.0))
    every = float(np.log10(v.total + v.types + 1))
    return both.select(
        "doc_id",
        "held_out",
        F.col("n").alias("n_tokens"),
        (F.col("known") + F.coalesce("more", F.lit(0))).alias("n_known"),
        F.lit(v.total).cast("long").alias("train_tokens"),
        (F.col("base") + logs - F.col("n") * F.lit(every)).alias("base_score"),
        (F.col("model") + F.col("within") + logs).alias("score"),
    )
