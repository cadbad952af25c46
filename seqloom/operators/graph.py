"""Measures on weighted bigram graphs (src, dst, weight)."""

from __future__ import annotations

import heapq
from collections import defaultdict

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.functions.stats import double
from seqloom.sources.storage import cut


def nodes(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("src").alias("node")).union(edges.select(F.col("dst").alias("node"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, component (smallest node reachable) of edges (a, b), by large-star and small-star rounds until nothing changes; a
    path of n nodes takes some log n of them. Nodes of loops only are their own components; null ends take no part."""
    edges = edges.where("a is not null and b is not null").select("a", "b")
    all_ = cut(edges.select(F.col("a").alias("node")).union(edges.select(F.col("b").alias("node"))).distinct())
    now = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    seen = None
    while True:
        both = now.union(now.select("b", "a"))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
        now = cut(small.where("a <> b").distinct())
        state = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if state == seen:
            return all_.join(now.withColumnRenamed("a", "node"), "node", "left").select("node", F.coalesce("b", "node").alias("component"))
        seen = state


def degrees(edges: DataFrame) -> DataFrame:
    """In and out degree over n - 1."""
    out = edges.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("o"), F.sum("weight").alias("strength"))
    into = edges.groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("i"))
    all_ = nodes(edges)
    n = all_.agg((F.count("*") - 1).alias("n"))
    own = all_.join(out, "node", "left").join(into, "node", "left").crossJoin(F.broadcast(n))
    share = lambda c: F.coalesce(F.try_divide(double(c), double("n")), F.lit(0.0))
    return own.select("node", share("i").alias("in_degree"), share("o").alias("out_degree"), F.coalesce("strength", F.lit(0.0)).alias("strength"))


def pagerank(edges: DataFrame, rounds: int = 10, damping: float = 0.85) -> DataFrame:
    """Power iteration with weighted out-edges; nodes without any spread evenly. Every fourth round is checkpointed."""
    edges = cut(edges)
    all_ = cut(nodes(edges))
    n = max(1, all_.count())
    out = edges.groupBy("src").agg(F.sum("weight").alias("total"))
    share = edges.join(out, "src").select("src", "dst", (F.col("weight") / F.col("total")).alias("share"))
    sinks = all_.join(out.withColumnRenamed("src", "node"), "node", "left_anti")
    rank = all_.withColumn("rank", F.lit(1.0 / n))
    for k in range(rounds):
        got = share.join(rank, share["src"] == rank["node"]).groupBy("dst").agg(F.sum(F.col("share") * F.col("rank")).alias("got"))
        lost = sinks.join(rank, "node").agg(F.coalesce(F.sum("rank"), F.lit(0.0)).alias("lost"))
        rank = all_.join(got, all_["node"] == got["dst"], "left").crossJoin(F.broadcast(lost))
        rank = rank.select("node", ((1 - damping) / n + damping * (F.coalesce("got", F.lit(0.0)) + F.col("lost") / n)).alias("rank"))
        rank = cut(rank) if k % 4 == 3 else rank
    return rank


def hits(edges: DataFrame, rounds: int = 5) -> DataFrame:
    """Hubs and authorities by power iteration, each normalised to sum 1."""
    edges = cut(edges)
    hub = nodes(edges).withColumn("hub", F.lit(1.0))
    one = lambda rows, key, value, name: rows.groupBy(F.col(key).alias("node")).agg(F.sum(value).alias(name))
    norm = lambda rows, name: rows.crossJoin(F.broadcast(rows.agg(F.sum(name).alias("__t")))).select("node", (F.col(name) / F.col("__t")).alias(name))
    for _ in range(rounds):
        auth = norm(one(edges.join(hub, edges["src"] == hub["node"]), "dst", F.col("weight") * F.col("hub"), "authority"), "authority")
        hub = norm(one(edges.join(auth, edges["dst"] == auth["node"]), "src", F.col("weight") * F.col("authority"), "hub"), "hub")
        hub = cut(hub)
    return nodes(edges).join(hub, "node", "left").join(auth, "node", "left").select("node", F.coalesce("hub", F.lit(0.0)).alias("hub"), F.coalesce("authority", F.lit(0.0)).alias("authority"))


def paths(edges: DataFrame) -> DataFrame:
    """Betweenness (weight as distance) and closeness (1 / weight as distance), one graph a group `grp`. Shortest paths from
    every node need a whole graph in one place, so a group is a bigram graph over a bounded vocabulary."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        names = sorted(set(frame["src"]) | set(frame["dst"]))
        near, far = defaultdict(list), defaultdict(list)
        for s, t, w in zip(frame["src"], frame["dst"], frame["weight"], strict=True):
            near[s].append((t, w))
            far[t].append((s, 1 / w))
        n, between, close = len(names), dict.fromkeys(names, 0.0), {}
        for s in names:
            dist, count, before, order, heap = {s: 0.0}, defaultdict(float), defaultdict(list), [], [(0.0, s)]
            count[s], done = 1.0, set()
            while heap:
                d, v = heapq.heappop(heap)
                if v in done:
                    continue
                done.add(v)
                order.append(v)
                for t, w in near[v]:
                    if t not in dist or d + w < dist[t] - 1e-12:
                        dist[t], count[t], before[t] = d + w, count[v], [v]
                        heapq.heappush(heap, (d + w, t))
                    elif abs(d + w - dist[t]) <= 1e-12 and t not in done:
                        count[t] += count[v]
                        before[t].append(v)
            credit = defaultdict(float)
            for v in reversed(order):
                for u in before[v]:
                    credit[u] += count[u] / count[v] * (1 + credit[v])
                if v != s:
                    between[v] += credit[v]
            dist, heap, done = {s: 0.0}, [(0.0, s)], set()
            while heap:
                d, v = heapq.heappop(heap)
                if v in done:
                    continue
                done.add(v)
                for t, w in far[v]:
                    if t not in dist or d + w < dist[t]:
                        dist[t] = d + w
                        heapq.heappush(heap, (d + w, t))
            total = sum(dist.values())
            close[s] = (len(dist) - 1) / total * (len(dist) - 1) / (n - 1) if total and n > 1 else 0.0
        scale = 1 / ((n - 1) * (n - 2)) if n > 2 else 1.0
        return pd.DataFrame({"grp": frame["grp"].iloc[0], "node": names, "betweenness": [between[v] * scale for v in names], "closeness": [close[v] for v in names]})

    return edges.groupBy("grp").applyInPandas(run, "grp string, node string, betweenness double, closeness double")


def shift(before: DataFrame, after: DataFrame, column: str) -> DataFrame:
    """Full outer difference of a measure, and whether it is over one population deviation."""
    both = before.select("node", F.col(column).alias("old")).join(after.select("node", F.col(column).alias("new")), "node", "full_outer")
    both = both.select("node", F.coalesce("old", F.lit(0.0)).alias("old"), F.coalesce("new", F.lit(0.0)).alias("new")).withColumn("delta", F.col("new") - F.col("old"))
    return both.crossJoin(F.broadcast(both.agg(F.stddev_pop("delta").alias("sd")))).select("node", "old", "new", "delta", (F.abs("delta") > F.col("sd")).alias("candidate"))


def outliers(rows: DataFrame, column: str, size: str) -> DataFrame:
    """Rows whose measure is over twice the mean and whose size is under the median."""
    cut = rows.agg((2 * F.avg(column)).alias("__cut"), F.percentile(size, 0.5).alias("__median"))
    return rows.crossJoin(F.broadcast(cut)).where((F.col(column) > F.col("__cut")) & (F.col(size) < F.col("__median"))).drop("__cut", "__median")


def closure(edges: DataFrame) -> DataFrame:
    """Per first node: compositions a-b-c with c other than a, and how many have an edge a-c."""
    a = edges.select(F.col("src").alias("a"), F.col("dst").alias("b"))
    c = edges.select(F.col("src").alias("b"), F.col("dst").alias("c"))
    two = a.join(c, "b").where("a <> c")
    direct = edges.select(F.col("src").alias("a"), F.col("dst").alias("c"), F.lit(1).alias("hit")).distinct()
    return two.join(direct, ["a", "c"], "left").groupBy("a").agg(F.count("*").alias("compositions"), F.count("hit").alias("closed"))
