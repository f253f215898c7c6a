"""Measures of many small weighted directed graphs, all graphs in one plan.

Input edges are (KEY, src, dst, w) after `edges.sanitise`; zero weights mean no edge.  `nodes` lists the nodes that every
graph has.  Results are (KEY, value) unless a docstring says otherwise.  An undefined value is null.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions.stages import stage_table
from corvane.operators.edges import KEY, dense, lengths


def graphs(edges: DataFrame) -> DataFrame:
    return edges.select(*KEY).distinct()


def distances(edges: DataFrame, n_nodes: int, key: list[str] = KEY) -> DataFrame:
    """(key, src, dst, d): shortest directed distances over lengths 1/w, by repeated squaring in (min, +).

    A round joins paths end to end and doubles the number of edges that a path may have, so ceil(log2(n)) rounds are enough;
    each round is a stage table, and rounds end when no distance gets shorter.
    """
    d = stage_table(edges.filter("src <> dst AND w > 0").groupBy(*key, "src", "dst").agg(F.min(1 / F.col("w")).alias("d")), "distance")
    for _ in range(max(1, (max(n_nodes, 2) - 1).bit_length())):
        on = d.select(*key, F.col("src").alias("mid"), "dst", F.col("d").alias("d2"))
        two = d.select(*key, "src", F.col("dst").alias("mid"), "d").join(on, [*key, "mid"]).filter("src <> dst").select(*key, "src", "dst", (F.col("d") + F.col("d2")).alias("d"))
        new = stage_table(d.unionByName(two).groupBy(*key, "src", "dst").agg(F.min("d").alias("d")), "distance")
        same = new.count() == d.count() and not new.join(d, [*key, "src", "dst", "d"], "left_anti").limit(1).count()
        d = new
        if same:
            break
    return d


def _per_graph(edges: DataFrame, values: DataFrame, default=None) -> DataFrame:
    out = graphs(edges).join(values, KEY, "left")
    return out if default is None else out.withColumn("value", F.coalesce("value", F.lit(default)))


def global_efficiency(edges: DataFrame, d: DataFrame, n: int) -> DataFrame:
    """Mean of 1/d over ordered pairs; pairs without a path count 0; null for fewer than two nodes."""
    total = d.filter("src <> dst").groupBy(*KEY).agg((F.sum(1 / F.col("d")) / (n * (n - 1) if n > 1 else None)).alias("value"))
    return _per_graph(edges, total, 0.0 if n > 1 else None)


def path_length(edges: DataFrame, d: DataFrame) -> DataFrame:
    """Mean of the finite positive distances."""
    return _per_graph(edges, d.filter("src <> dst AND d > 0").groupBy(*KEY).agg(F.avg("d").alias("value")))


def diameter(edges: DataFrame, d: DataFrame) -> DataFrame:
    return _per_graph(edges, d.filter("src <> dst AND d > 0").groupBy(*KEY).agg(F.max("d").alias("value")))


def local_efficiency(edges: DataFrame) -> DataFrame:
    """Mean over nodes with two neighbours or more of the efficiency of the subgraph that their in- and out-neighbours induce."""
    e = edges.filter("src <> dst AND w > 0").select(*KEY, "src", "dst", "w")
    near = e.select(*KEY, F.col("src").alias("centre"), F.col("dst").alias("node")).unionByName(e.select(*KEY, F.col("dst").alias("centre"), F.col("src").alias("node"))).distinct()
    size = near.groupBy(*KEY, "centre").agg(F.count(F.lit(1)).alias("k")).filter("k > 1")
    inside = e.join(near.withColumnRenamed("node", "src"), [*KEY, "src"]).join(near.withColumnRenamed("node", "dst"), [*KEY, "centre", "dst"])
    most = size.agg(F.max("k")).first()[0] or 2
    d = distances(inside, most, [*KEY, "centre"]).groupBy(*KEY, "centre").agg(F.sum(1 / F.col("d")).alias("s"))
    each = size.join(d, [*KEY, "centre"], "left").select(*KEY, (F.coalesce("s", F.lit(0.0)) / (F.col("k") * (F.col("k") - 1))).alias("e"))
    return _per_graph(edges, each.groupBy(*KEY).agg(F.avg("e").alias("value")))


def _cycles(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(KEY, node, cycles, possible) of weighted directed triangles (Fagiolo 2007)."""
    e = edges.filter("src <> dst AND w > 0").select(*KEY, "src", "dst", F.cbrt("w").alias("c"))
    both = e.unionByName(e.select(*KEY, F.col("dst").alias("src"), F.col("src").alias("dst"), "c"))
    s = both.groupBy(*KEY, "src", "dst").agg(F.sum("c").alias("s"))
    a, b, c = s.select(*KEY, F.col("src").alias("i"), F.col("dst").alias("j"), F.col("s").alias("s1")), s.select(*KEY, F.col("src").alias("j"), F.col("dst").alias("k"), F.col("s").alias("s2")), s.select(*KEY, F.col("src").alias("k"), F.col("dst").alias("i"), F.col("s").alias("s3"))
    cycles = a.join(b, [*KEY, "j"]).join(c, [*KEY, "k", "i"]).groupBy(*KEY, F.col("i").alias("node")).agg((F.sum(F.col("s1") * F.col("s2") * F.col("s3")) / 2).alias("cycles"))
    degree = both.groupBy(*KEY, F.col("src").alias("node")).agg(F.count(F.lit(1)).alias("deg"))
    mutual = e.select(*KEY, "src", "dst").join(e.select(*KEY, F.col("dst").alias("src"), F.col("src").alias("dst")), [*KEY, "src", "dst"]).groupBy(*KEY, F.col("src").alias("node")).agg(F.count(F.lit(1)).alias("rec"))
    grid = graphs(edges).crossJoin(F.broadcast(nodes.select("node")))
    out = grid.join(cycles, [*KEY, "node"], "left").join(degree, [*KEY, "node"], "left").join(mutual, [*KEY, "node"], "left").fillna(0, ["deg", "rec"]).fillna(0.0, ["cycles"])
    return out.withColumn("possible", F.col("deg") * (F.col("deg") - 1) - 2 * F.col("rec"))


def node_clustering(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(KEY, node, value): 0 for nodes in no cycle."""
    return _cycles(edges, nodes).select(*KEY, "node", F.when(F.col("cycles") > 0, F.col("cycles") / F.col("possible")).otherwise(0.0).alias("value"))


def clustering(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    return node_clustering(edges, nodes).groupBy(*KEY).agg(F.avg("value").alias("value"))


def transitivity(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Sum of cycles over sum of possible cycles, over nodes in a cycle; 0 without cycles."""
    c = _cycles(edges, nodes).filter("cycles > 0")
    return _per_graph(edges, c.groupBy(*KEY).agg((F.sum("cycles") / F.sum("possible")).alias("value")), 0.0)


def node_strength(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(KEY, node, s_in, s_out, s_total, balance)."""
    e = edges.filter("src <> dst")
    out = e.groupBy(*KEY, F.col("src").alias("node")).agg(F.sum("w").alias("s_out"))
    into = e.groupBy(*KEY, F.col("dst").alias("node")).agg(F.sum("w").alias("s_in"))
    grid = graphs(edges).crossJoin(F.broadcast(nodes.select("node")))
    both = grid.join(out, [*KEY, "node"], "left").join(into, [*KEY, "node"], "left").fillna(0.0, ["s_in", "s_out"])
    return both.select(*KEY, "node", "s_in", "s_out", (F.col("s_in") + F.col("s_out")).alias("s_total"), (F.col("s_out") - F.col("s_in")).alias("balance"))


def mean_strength(edges: DataFrame, n: int) -> DataFrame:
    """Mean of in- plus out-strength: 2 * sum(w) / n."""
    return _per_graph(edges, edges.filter("src <> dst").groupBy(*KEY).agg((2 * F.sum("w") / n).alias("value")), 0.0)


def weight_statistics(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(KEY, density, mean, sd, median, max, min, cv) over all ordered pairs, zeros among them; cv is null where the mean is 0."""
    return dense(edges, nodes, diagonal=False).groupBy(*KEY).agg(
        F.avg((F.col("w") > 0).cast("double")).alias("density"), F.avg("w").alias("mean"), F.stddev_pop("w").alias("sd"), F.percentile("w", 0.5).alias("median"), F.max("w").alias("max"), F.min("w").alias("min"),
        F.try_divide(F.stddev_pop("w"), F.avg("w")).alias("cv"),
    )


def _degrees(e: DataFrame) -> DataFrame:
    out = e.groupBy(*KEY, F.col("src").alias("node")).agg(F.count(F.lit(1)).alias("k_out"))
    into = e.groupBy(*KEY, F.col("dst").alias("node")).agg(F.count(F.lit(1)).alias("k_in"))
    return out.join(into, [*KEY, "node"], "full").fillna(0, ["k_out", "k_in"])


def rich_club(edges: DataFrame, level: int = 1) -> DataFrame:
    """Weight between nodes of total degree `level` or more, over the weight of as many of the strongest edges."""
    e = edges.filter("src <> dst AND w > 0")
    rich = _degrees(e).filter(F.col("k_in") + F.col("k_out") >= level).select(*KEY, "node")
    own = e.join(rich.withColumnRenamed("node", "src"), [*KEY, "src"]).join(rich.withColumnRenamed("node", "dst"), [*KEY, "dst"]).groupBy(*KEY).agg(F.count(F.lit(1)).alias("n"), F.sum("w").alias("s"))
    ranked = e.withColumn("r", F.row_number().over(Window.partitionBy(*KEY).orderBy(F.col("w").desc(), "src", "dst")))
    best = ranked.join(own, KEY).filter("r <= n").groupBy(*KEY).agg(F.sum("w").alias("top"), F.first("s").alias("s"))
    return _per_graph(edges, best.select(*KEY, (F.col("s") / F.col("top")).alias("value")))


def assortativity(edges: DataFrame) -> DataFrame:
    """Mean of the out-in, in-out, out-out and in-in degree correlations over edges; null where degrees do not vary."""
    e = edges.filter("src <> dst AND w > 0").select(*KEY, "src", "dst")
    k = _degrees(e)
    j = e.join(k.select(*KEY, F.col("node").alias("src"), F.col("k_out").alias("so"), F.col("k_in").alias("si")), [*KEY, "src"]).join(k.select(*KEY, F.col("node").alias("dst"), F.col("k_out").alias("do"), F.col("k_in").alias("di")), [*KEY, "dst"])

    def r(a: str, b: str):
        x, y = F.col(a), F.col(b)
        half = F.avg((x + y) / 2)
        return F.try_divide(F.avg(x * y) - half * half, F.avg((x * x + y * y) / 2) - half * half)

    four = j.groupBy(*KEY).agg(*[r(a, b).alias(a + b) for a, b in (("so", "di"), ("si", "do"), ("so", "do"), ("si", "di"))])
    return _per_graph(edges, four.select(*KEY, ((F.col("sodi") + F.col("sido") + F.col("sodo") + F.col("sidi")) / 4).alias("value")))


def spectral_radius(edges: DataFrame) -> DataFrame:
    """Largest |eigenvalue| of each graph's matrix; a group is one matrix of bounded size."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        nodes, at = np.unique(np.concatenate([frame["src"], frame["dst"]]), return_inverse=True)
        m = np.zeros((len(nodes), len(nodes)))
        np.add.at(m, (at[: len(frame)], at[len(frame) :]), frame["w"])
        return pd.DataFrame({k: [frame[k].iloc[0]] for k in KEY} | {"value": [float(np.abs(np.linalg.eigvals(m)).max())]})

    types = dict(edges.dtypes)
    return edges.select(*KEY, "src", "dst", "w").groupBy(*KEY).applyInPandas(run, ", ".join(f"{k} {types[k]}" for k in KEY) + ", value double")


def modularity(edges: DataFrame, partition: DataFrame) -> DataFrame:
    """Directed modularity (Leicht and Newman 2008) of a given partition (KEY, node, module)."""
    e = edges.filter("src <> dst AND w > 0").select(*KEY, "src", "dst", "w")
    p = partition.select(*KEY, "node", "module")
    m = e.groupBy(*KEY).agg(F.sum("w").alias("m"))
    inside = e.join(p.select(*KEY, F.col("node").alias("src"), F.col("module").alias("a")), [*KEY, "src"]).join(p.select(*KEY, F.col("node").alias("dst"), F.col("module").alias("b")), [*KEY, "dst"]).filter("a = b").groupBy(*KEY, F.col("a").alias("module")).agg(F.sum("w").alias("inside"))
    out = e.join(p.withColumnRenamed("node", "src"), [*KEY, "src"]).groupBy(*KEY, "module").agg(F.sum("w").alias("o"))
    into = e.join(p.withColumnRenamed("node", "dst"), [*KEY, "dst"]).groupBy(*KEY, "module").agg(F.sum("w").alias("i"))
    joined = out.join(into, [*KEY, "module"], "full").join(inside, [*KEY, "module"], "left").fillna(0.0, ["o", "i", "inside"]).join(m, KEY)
    return joined.groupBy(*KEY).agg(F.sum(F.col("inside") / F.col("m") - F.col("o") * F.col("i") / (F.col("m") * F.col("m"))).alias("value"))


def module_order(strengths: DataFrame, partition: DataFrame) -> DataFrame:
    """(KEY, node, module, place, starts): modules by their least node, nodes by strength and then number; starts marks a new module."""
    least = F.min("node").over(Window.partitionBy(*KEY, "module"))
    j = partition.join(strengths.select(*KEY, "node", "s_total"), [*KEY, "node"]).withColumn("_least", least)
    by = Window.partitionBy(*KEY).orderBy("_least", F.col("s_total").desc(), "node")
    return j.select(*KEY, "node", "module", F.row_number().over(by).alias("place"), (F.lag("_least").over(by).isNull() | (F.lag("_least").over(by) != F.col("_least"))).alias("starts"))


__all__ = ["assortativity", "clustering", "diameter", "distances", "global_efficiency", "lengths", "local_efficiency", "mean_strength", "modularity", "module_order", "node_clustering", "node_strength", "path_length", "rich_club", "spectral_radius", "transitivity", "weight_statistics"]
