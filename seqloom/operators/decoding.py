"""Sequential decoders: beams, segmental alignment, dictionary glossing, masked completion. One group or sequence a call, spread by
applyInPandas or Arrow UDFs; within one the work is sequential."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def beam(counts: dict[tuple[str, str], int], scores: dict[tuple[str, str], float], signs: list[str], symbols: list[str], width: int = 20, floor: float = -12.0) -> list[tuple[float, dict[str, str]]]:
    """The best maps of signs to symbols, extended sign by sign in the given order; equal maps count once."""
    beams: list[tuple[float, dict[str, str]]] = [(0.0, {})]
    for sign in signs:
        grown = []
        for value, own in beams:
            for s in symbols:
                new = {**own, sign: s}
                gain = sum(c * scores.get((new[a], new[b]), floor) for (a, b), c in counts.items() if sign in (a, b) and a in new and b in new)
                grown.append((value + gain, new))
        grown.sort(key=lambda x: (-x[0], sorted(x[1].items())))
        beams = grown[:width]
    return beams


def segments(scores: list[list[float]], least: int, most: int) -> tuple[float, list[int]]:
    """scores[i][j]: gain of token j in window i. Consecutive windows of `least` to `most` tokens that maximise the total;
    the start of each, or -inf and nothing where the tokens don't suffice."""
    n, m = len(scores[0]) if scores else 0, len(scores)
    none = float("-inf")
    best, back = [[none] * (n + 1) for _ in range(m + 1)], [[0] * (n + 1) for _ in range(m + 1)]
    best[0] = [0.0] * (n + 1)
    for i in range(1, m + 1):
        total = [0.0]
        for x in scores[i - 1]:
            total.append(total[-1] + x)
        for j in range(1, n + 1):
            for k in range(least, min(most, j) + 1):
                v = best[i - 1][j - k] + total[j] - total[j - k]
                if v > best[i][j]:
                    best[i][j], back[i][j] = v, j - k
    end = max(range(n + 1), key=lambda j: (best[m][j], -j))
    out = []
    for i in range(m, 0, -1):
        if best[i][end] == none:
            return none, []
        end = back[i][end]
        out.append(end)
    return max(best[m]), out[::-1]


def aligned(windows: DataFrame, least: int, most: int) -> DataFrame:
    """From (grp, w, pos, score): the start of each window of the best segmentation of each group."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        table = frame.pivot(index="w", columns="pos", values="score").sort_index().sort_index(axis=1).fillna(0.0)
        value, starts = segments(table.to_numpy().tolist(), least, most)
        return pd.DataFrame({"grp": frame["grp"].iloc[0], "w": table.index[: len(starts)].to_numpy(), "start": [int(table.columns[s]) for s in starts], "total": value}).astype({"w": "int64", "start": "int64"})

    return windows.groupBy("grp").applyInPandas(run, "grp string, w long, start long, total double")


def glossed(sequences: DataFrame, lexicon: dict[str, tuple[int, str]], longest: int = 4) -> DataFrame:
    """Greedy left-to-right glosses of `seq`: of the windows at a place the best tier, then the longest, wins. lexicon: joined
    tokens to (tier, gloss), a bounded table."""
    shared = sequences.sparkSession.sparkContext.broadcast(lexicon)

    @F.pandas_udf("array<struct<start int, size int, tier int, gloss string>>")
    def run(seqs: pd.Series) -> pd.Series:
        out = []
        for seq in seqs:
            at, found = 0, []
            while seq is not None and at < len(seq):
                tries = [(shared.value[w][0], -k, w) for k in range(1, longest + 1) if at + k <= len(seq) and (w := "".join(seq[at : at + k])) in shared.value]
                if tries:
                    tier, k, w = min(tries)
                    found.append({"start": at, "size": -k, "tier": tier, "gloss": shared.value[w][1]})
                    at -= k
                else:
                    at += 1
            out.append(found)
        return pd.Series(out)

    return sequences.withColumn("glosses", run("seq"))


def completed(sequences: DataFrame, model: dict[tuple[str, str], float], vocabulary: list[str], k: int, floor: float = -20.0) -> DataFrame:
    """The k likeliest tokens for each null of `seq`, by the bigram log probabilities on both sides."""
    shared = sequences.sparkSession.sparkContext.broadcast((model, vocabulary))

    @F.pandas_udf("array<struct<at int, rank int, tok string, lp double>>")
    def run(seqs: pd.Series) -> pd.Series:
        lp, words = shared.value
        out = []
        for seq in seqs:
            found = []
            for i, x in enumerate(seq if seq is not None else ()):
                if x is None:
                    left = seq[i - 1] if i else "<s>"
                    right = seq[i + 1] if i + 1 < len(seq) else "</s>"
                    score = lambda w: lp.get((left, w), floor) + (lp.get((w, right), floor) if right is not None else 0.0)  # noqa: E731, B023
                    found += [{"at": i, "rank": r + 1, "tok": w, "lp": score(w)} for r, w in enumerate(sorted(words, key=lambda w: (-score(w), w))[:k])]
            out.append(found)
        return pd.Series(out)

    return sequences.withColumn("filled", run("seq"))


def generators(edges: DataFrame, most: int = 20) -> list[tuple[str, int]]:
    """Greedy cover of edges by nodes, `most` of them: each round one aggregation on the cluster and one row to the driver."""
    left, out = edges.select("src", "dst").distinct(), []
    for _ in range(most):
        ends = left.select(F.explode(F.array_distinct(F.array("src", "dst"))).alias("node"))
        top = ends.groupBy("node").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "node").first()
        if top is None:
            break
        out.append((top.node, top.n))
        left = left.where((F.col("src") != top.node) & (F.col("dst") != top.node))
    return out
