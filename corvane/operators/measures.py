"""All scalar measures of many graphs side by side; distances and cycles, which several of them need, are found once."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions.stages import stage_table
from corvane.operators import graph as G
from corvane.operators import partition as P
from corvane.operators.edges import KEY

SEED = 42


class Shared:
    """Graphs (KEY, src, dst, w) over nodes (node), and what their measures have in common, as stage tables made on first use.

    Nodes are few, as in one montage: they are numbered in one task.
    """

    def __init__(self, edges: DataFrame, nodes: DataFrame):
        self.edges, self.nodes = edges, nodes.select("node")

    @cached_property
    def n(self) -> int:
        return self.nodes.count()

    @cached_property
    def distances(self) -> DataFrame:
        return G.distances(self.edges, self.n)

    @cached_property
    def cycles(self) -> DataFrame:
        return stage_table(G._cycles(self.edges, self.nodes), "cycles")

    @cached_property
    def weights(self) -> DataFrame:
        return stage_table(G.weight_statistics(self.edges, self.nodes), "weights")

    @cached_property
    def numbered(self) -> DataFrame:
        """The edges with nodes as numbers from 0, in the order of the nodes."""
        number = self.nodes.withColumn("_at", (F.row_number().over(Window.orderBy("node")) - 1).cast("int"))
        end = lambda c: F.broadcast(number.select(F.col("node").alias(c), F.col("_at").alias(f"_{c}")))
        e = self.edges.join(end("src"), "src").join(end("dst"), "dst")
        return stage_table(e.select(*KEY, F.col("_src").alias("src"), F.col("_dst").alias("dst"), "w"), "numbered")

    @cached_property
    def clustering(self) -> DataFrame:
        return self.cycles.groupBy(*KEY).agg(F.avg(F.when(F.col("cycles") > 0, F.col("cycles") / F.col("possible")).otherwise(0.0)).alias("value"))

    @cached_property
    def path_length(self) -> DataFrame:
        return G.path_length(self.edges, self.distances)


def _transitivity(s: Shared) -> DataFrame:
    own = s.cycles.groupBy(*KEY).agg(F.try_divide(F.sum(F.when(F.col("cycles") > 0, F.col("cycles"))), F.sum(F.when(F.col("cycles") > 0, F.col("possible")))).alias("value"))
    return own.withColumn("value", F.coalesce("value", F.lit(0.0)))


MEASURES: dict[str, Callable[[Shared], DataFrame]] = {
    "global_efficiency": lambda s: G.global_efficiency(s.edges, s.distances, s.n),
    "local_efficiency": lambda s: G.local_efficiency(s.edges),
    "clustering": lambda s: s.clustering,
    "transitivity": _transitivity,
    "modularity": lambda s: P.best_partition(s.numbered, s.n).groupBy(*KEY).agg(F.max("q").alias("value")),
    "mean_strength": lambda s: G.mean_strength(s.edges, s.n),
    "betweenness": lambda s: P.betweenness(s.numbered, s.n).groupBy(*KEY).agg(F.avg("value").alias("value")),
    "rich_club": lambda s: G.rich_club(s.edges),
    "assortativity": lambda s: G.assortativity(s.edges),
    "spectral_radius": lambda s: G.spectral_radius(s.edges),
    "small_worldness": lambda s: P.small_worldness(s.edges, s.nodes, SEED, s.clustering, s.path_length),
    "diameter": lambda s: G.diameter(s.edges, s.distances),
    **{c: (lambda s, c=c: s.weights.select(*KEY, F.col(c).alias("value"))) for c in ("density", "mean", "sd", "median", "max", "min", "cv")},
    "path_length": lambda s: s.path_length,
}
