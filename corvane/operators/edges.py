"""Edge tables of many small directed graphs: cleaning, normalising, thresholds, vectors.

A graph is named by KEY; an edge row is (KEY, src, dst, w).  A node table lists the nodes that graphs of a cohort share;
it has at most a few hundred rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

KEY = ["grp", "subject"]


def graph() -> WindowSpec:
    """All rows of one graph."""
    return Window.partitionBy(*KEY)



def sanitise(edges: DataFrame) -> DataFrame:
    """Self edges, negative, null, NaN and infinite weights become 0."""
    bad = (F.col("src") == F.col("dst")) | F.col("w").isNull() | F.isnan("w") | (F.abs("w") == float("inf")) | (F.col("w") < 0)
    return edges.withColumn("w", F.when(bad, 0.0).otherwise(F.col("w")))


def dense(edges: DataFrame, nodes: DataFrame, diagonal: bool = True) -> DataFrame:
    """Every ordered pair of nodes of every graph; pairs without an edge weigh 0."""
    n = nodes.select("node")
    pairs = n.select(F.col("node").alias("src")).crossJoin(n.select(F.col("node").alias("dst")))
    pairs = pairs if diagonal else pairs.filter("src <> dst")
    grid = edges.select(*KEY).distinct().crossJoin(F.broadcast(pairs))
    return grid.join(edges.select(*KEY, "src", "dst", "w"), [*KEY, "src", "dst"], "left").withColumn("w", F.coalesce("w", F.lit(0.0)))


def lengths(edges: DataFrame) -> DataFrame:
    """1/w of positive edges as `d`."""
    return edges.filter("src <> dst AND w > 0").select(*KEY, "src", "dst", (1 / F.col("w")).alias("d"))


def normalise(matrix: DataFrame, mode: str = "minmax") -> DataFrame:
    """Scale every graph's weights by all its cells, the diagonal among them.

    minmax: (w - min) / (max - min), all 0 for a constant matrix; maxabs: w / max |w|; zscore: population sd with a
    guard of 1e-10; none: as it is.  Cells that are not finite count as 0 for minmax and are an error otherwise.
    """
    w = F.col("w")
    finite = F.when(w.isNull() | F.isnan(w) | (F.abs(w) == float("inf")), 0.0).otherwise(w)
    if mode == "minmax":
        lo, hi = F.min(finite).over(graph()), F.max(finite).over(graph())
        return matrix.withColumn("w", F.when(hi > lo, (finite - lo) / (hi - lo)).otherwise(0.0))
    checked = F.when(finite != w, F.raise_error(F.lit("weights must be finite"))).otherwise(w)
    if mode == "maxabs":
        top = F.max(F.abs(checked)).over(graph())
        return matrix.withColumn("w", F.when(top > 0, checked / top).otherwise(0.0))
    if mode == "zscore":
        return matrix.withColumn("w", (checked - F.avg(checked).over(graph())) / (F.stddev_pop(checked).over(graph()) + 1e-10))
    return matrix.withColumn("w", checked)


def threshold(matrix: DataFrame, method: str = "percentile", value: float = 90) -> DataFrame:
    """Weights strictly above a percentile of the graph, an absolute value, or mean + value * sd; others become 0."""
    if method == "absolute":
        return matrix.withColumn("w", F.when(F.col("w") > value, F.col("w")).otherwise(0.0))
    cut = F.percentile("w", value / 100) if method == "percentile" else F.avg("w") + value * F.stddev_pop("w")
    cuts = matrix.groupBy(*KEY).agg(cut.alias("_cut"))
    return matrix.join(cuts, KEY).withColumn("w", F.when(F.col("w") > F.col("_cut"), F.col("w")).otherwise(0.0)).drop("_cut")


def binarise(matrix: DataFrame, value: float = 0) -> DataFrame:
    return matrix.withColumn("w", (F.col("w") > value).cast("int"))


def swapped(matrix: DataFrame, name: str = "w_back") -> DataFrame:
    """Every row with the weight of the edge in the other direction."""
    back = matrix.select(*KEY, F.col("dst").alias("src"), F.col("src").alias("dst"), F.col("w").alias(name))
    return matrix.join(back, [*KEY, "src", "dst"], "left")


def symmetric(a: Column, b: Column, method: str = "average") -> Column:
    """A cell and its mirror as one value."""
    return {"average": (a + b) / 2, "max": F.greatest(a, b), "min": F.least(a, b)}[method]


def symmetrise(matrix: DataFrame, method: str = "average") -> DataFrame:
    return swapped(matrix).withColumn("w", symmetric(F.col("w"), F.coalesce("w_back", F.lit(0.0)), method)).drop("w_back")


def asymmetric_cells(matrix: DataFrame, rtol: float = 1e-5, atol: float = 1e-8) -> DataFrame:
    """(KEY, n): cells that differ from their mirror by more than atol + rtol * |mirror|."""
    off = F.abs(F.col("w") - F.col("w_back")) > atol + rtol * F.abs("w_back")
    return swapped(matrix).groupBy(*KEY).agg(F.sum(off.cast("long")).alias("n"))


def edge_vector(matrix: DataFrame, directed: bool = True) -> DataFrame:
    """(KEY, n, vector): weights in row-major order, off the diagonal or above it."""
    own = matrix.filter("src <> dst" if directed else "src < dst")
    packed = F.array_sort(F.collect_list(F.struct("src", "dst", "w")))
    return own.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n"), F.transform(packed, lambda x: x["w"]).alias("vector"))


def vector_edges(vectors: DataFrame) -> DataFrame:
    """Both triangles again from upper-triangle vectors of n(n-1)/2 weights."""
    n = ((1 + F.sqrt(1 + 8 * F.size("vector"))) / 2).cast("int")
    pairs = F.expr("flatten(transform(sequence(0, n - 2), i -> transform(sequence(i + 1, n - 1), j -> named_struct('src', i, 'dst', j))))")
    flat = vectors.withColumn("n", n).filter("n >= 2").withColumn("p", pairs).select(*KEY, F.posexplode(F.arrays_zip("p", "vector")).alias("i", "z"))
    upper = flat.select(*KEY, F.col("z.p.src").alias("src"), F.col("z.p.dst").alias("dst"), F.col("z.vector").alias("w"))
    return upper.unionByName(upper.select(*KEY, F.col("dst").alias("src"), F.col("src").alias("dst"), "w"))


def transformations(matrix: DataFrame) -> DataFrame:
    """natural, mean, centred and rank (ties averaged, over the number of edges) of the edges above the diagonal."""
    own = matrix.filter("src < dst")
    ties = Window.partitionBy(*KEY, "w")
    rank = (F.rank().over(graph().orderBy("w")) + (F.count(F.lit(1)).over(ties) - 1) / 2) / F.count(F.lit(1)).over(graph())
    return own.select(*KEY, "src", "dst", F.col("w").alias("natural"), F.avg("w").over(graph()).alias("mean"), (F.col("w") - F.avg("w").over(graph())).alias("centred"), rank.alias("rank"))


def quality_report(matrix: DataFrame) -> DataFrame:
    """One row for each graph: counts of bad cells, shares of exact 0 and 1, mean, sd and median asymmetry of edges."""
    off = swapped(matrix.filter("src <> dst"))
    return off.groupBy(*KEY).agg(
        F.sum((F.isnan("w") | (F.abs("w") == float("inf"))).cast("long")).alias("n_bad"),
        (F.max(F.abs("w")) == 0).alias("all_zero"),
        F.avg((F.col("w") == 0).cast("double")).alias("share_zero"),
        F.avg((F.col("w") == 1).cast("double")).alias("share_one"),
        F.avg("w").alias("mean_w"),
        F.stddev_pop("w").alias("sd_w"),
        F.percentile(F.abs(F.col("w") - F.col("w_back")), 0.5).alias("asymmetry"),
    )


def relative_gap(value: Column, target: Column) -> Column:
    """(value - target) / |target|, with a denominator of 1 for targets of at most 1e-10."""
    return (value - target) / F.when(F.abs(target) <= 1e-10, 1.0).otherwise(F.abs(target))
