"""Measures that search: betweenness, best partition, small-worldness.  One graph, of bounded size, is one group.

Edges are (KEY, src, dst, w) with positive weights; n nodes are numbered 0..n-1.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvane.operators import graph as G
from corvane.operators.edges import KEY


def _dense(frame: pd.DataFrame, n: int) -> np.ndarray:
    m = np.zeros((n, n))
    off = frame[frame["src"] != frame["dst"]]
    np.add.at(m, (off["src"].to_numpy(), off["dst"].to_numpy()), off["w"].to_numpy())
    return m


def _keys(edges: DataFrame) -> str:
    kinds = dict(edges.dtypes)
    return ", ".join(f"{k} {kinds[k]}" for k in KEY)


def betweenness(edges: DataFrame, n: int) -> DataFrame:
    """(KEY, node, value): weighted betweenness over lengths 1/w, by accumulating dependencies from each source (Brandes 2001)."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        m = _dense(frame, n)
        near = [[(int(j), 1 / m[i, j]) for j in np.flatnonzero(m[i] > 0)] for i in range(n)]
        total = np.zeros(n)
        for s in range(n):
            dist, count, before = np.full(n, np.inf), np.zeros(n), [[] for _ in range(n)]
            dist[s], count[s], done, heap = 0.0, 1.0, [], [(0.0, s)]
            seen = np.zeros(n, bool)
            while heap:
                d, u = heapq.heappop(heap)
                if seen[u]:
                    continue
                seen[u] = True
                done.append(u)
                for v, w in near[u]:
                    if d + w < dist[v] - 1e-12:
                        dist[v], count[v], before[v] = d + w, count[u], [u]
                        heapq.heappush(heap, (d + w, v))
                    elif abs(d + w - dist[v]) <= 1e-12 and not seen[v]:
                        count[v] += count[u]
                        before[v].append(u)
            gain = np.zeros(n)
            for v in reversed(done):
                for u in before[v]:
                    gain[u] += count[u] / count[v] * (1 + gain[v])
                if v != s:
                    total[v] += gain[v]
        return pd.DataFrame({k: frame[k].iloc[0] for k in KEY} | {"node": np.arange(n, dtype=np.int32), "value": total})

    return edges.select(*KEY, "src", "dst", "w").groupBy(*KEY).applyInPandas(run, f"{_keys(edges)}, node int, value double")


def _local_moving(b: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Labels after moving nodes, in the given order, to the module of largest gain until none moves; b is a modularity matrix."""
    n = len(b)
    label = np.arange(n)
    for _ in range(100):
        moved = False
        for i in order:
            gain = np.bincount(label, weights=b[i], minlength=n)
            gain[label[i]] -= b[i, i]
            best = int(np.argmax(np.round(gain, 12)))
            if gain[best] > gain[label[i]] + 1e-12:
                label[i], moved = best, True
        if not moved:
            break
    return np.unique(label, return_inverse=True)[1]


def louvain(m: np.ndarray, seed: int) -> tuple[float, np.ndarray]:
    """(modularity, labels) of a directed weighted graph: local moving, then the same on modules as nodes, until nothing changes."""
    total = m.sum()
    if total <= 0:
        return 0.0, np.zeros(len(m), int)
    b = m / total - np.outer(m.sum(1), m.sum(0)) / total**2
    b = (b + b.T) / 2
    rng, label, small = np.random.default_rng(seed), np.arange(len(m)), b
    while True:
        found = _local_moving(small, rng.permutation(len(small)))
        label = found[label]
        if found.max() + 1 == len(small):
            break
        join = np.eye(found.max() + 1)[found]
        small = join.T @ small @ join
    return float(np.trace(np.eye(label.max() + 1)[label].T @ b @ np.eye(label.max() + 1)[label])), label


def best_partition(edges: DataFrame, n: int, restarts: int = 20) -> DataFrame:
    """(KEY, node, module, q): the best of seeded restarts, each a row of its own group; ties go to the least label vector, q <= 0 to one module.

    Modules are numbered by their least node.
    """
    seeds = edges.select(*KEY, "src", "dst", "w").withColumn("seed", F.explode(F.sequence(F.lit(0), F.lit(restarts - 1))))

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        q, label = louvain(_dense(frame, n), int(frame["seed"].iloc[0]))
        label = np.zeros(n, int) if q <= 1e-12 else label
        first: dict[int, int] = {}
        label = [first.setdefault(int(x), len(first)) for x in label]
        return pd.DataFrame({k: [frame[k].iloc[0]] for k in KEY} | {"q": [round(max(q, 0.0), 12)], "labels": [label]})

    each = seeds.groupBy(*KEY, "seed").applyInPandas(run, f"{_keys(edges)}, q double, labels array<int>")
    best = each.withColumn("_r", F.row_number().over(Window.partitionBy(*KEY).orderBy(F.col("q").desc(), "labels"))).filter("_r = 1")
    return best.select(*KEY, F.posexplode("labels").alias("node", "module"), "q")


def small_worldness(edges: DataFrame, nodes: DataFrame, seed: int, clustering: DataFrame | None = None, path_length: DataFrame | None = None) -> DataFrame:
    """(KEY, value): (C / C_random) / (L / L_random), against one seeded random graph of equal density for each graph; null where undefined.

    clustering and path_length (KEY, value) of the graphs themselves are worked out unless they are given.
    """
    n = nodes.count()
    size = edges.filter("src <> dst AND w > 0").groupBy(*KEY).agg(F.count(F.lit(1)).alias("m"))
    pairs = nodes.select(F.col("node").alias("src")).crossJoin(nodes.select(F.col("node").alias("dst"))).filter("src <> dst")
    draw = F.pmod(F.xxhash64(F.lit(seed), *KEY, "src", "dst"), F.lit(1 << 40)) / float(1 << 40)
    noise = size.crossJoin(F.broadcast(pairs)).withColumn("w", draw)
    ranked = noise.withColumn("_r", F.row_number().over(Window.partitionBy(*KEY).orderBy(F.col("w").desc(), "src", "dst"))).filter("_r <= m").select(*KEY, "src", "dst", "w")

    def both(e: DataFrame, tag: str, c: DataFrame | None, p: DataFrame | None) -> DataFrame:
        c, p = G.clustering(e, nodes) if c is None else c, G.path_length(e, G.distances(e, n)) if p is None else p
        return c.withColumnRenamed("value", "c" + tag).join(p.withColumnRenamed("value", "l" + tag), KEY)

    j = both(edges, "", clustering, path_length).join(both(ranked, "_random", None, None), KEY)
    return j.select(*KEY, F.try_divide(F.try_divide("c", "c_random"), F.try_divide("l", "l_random")).alias("value"))
