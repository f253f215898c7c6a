"""What-if reweighting of graphs over a table of candidates, and choices among them.

matrix: dense (KEY, src, dst, w).  candidates: (KEY, cand, node, amount).  baseline: (KEY, node, x) activations.
Every transform is keyed by candidate, so a sweep over all nodes and amounts is one plan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.operators.edges import KEY
from corvane.operators.graph import spectral_radius

CAND = [*KEY, "cand"]
TINY = 1e-10


def candidate_grid(graphs: DataFrame, nodes: DataFrame, amounts: list[float]) -> DataFrame:
    """Every graph, node and amount; cand numbers node and amount."""
    spark = graphs.sparkSession
    a = spark.createDataFrame([*enumerate(amounts)], "_i int, amount double")
    grid = nodes.select("node").crossJoin(F.broadcast(a)).withColumn("cand", (F.col("node") * len(amounts) + F.col("_i")).cast("int")).drop("_i")
    return graphs.select(*KEY).distinct().crossJoin(F.broadcast(grid)).select(*CAND, "node", "amount")


def propagation(matrix: DataFrame, normalisation: str = "spectral_radius", constant: float = 0.01) -> DataFrame:
    """The matrix without its diagonal; divided by its spectral radius (diagonal included) plus a constant, or as it is."""
    off = matrix.filter("src <> dst")
    if normalisation == "none":
        return off
    radius = spectral_radius(matrix).withColumnRenamed("value", "_r")
    return off.join(radius, KEY).withColumn("w", F.col("w") / (F.col("_r") + constant)).drop("_r")


def incident_change(matrix: DataFrame, candidates: DataFrame, scope: str = "incident") -> DataFrame:
    """(CAND, src, dst, w, new): a signed total spread over a node's edges in proportion to |w|, signs kept.

    scope: incoming, outgoing or incident.  A node without weight in its scope is an error.
    """
    hit = {"incoming": F.col("dst") == F.col("node"), "outgoing": F.col("src") == F.col("node"), "incident": (F.col("src") == F.col("node")) | (F.col("dst") == F.col("node"))}[scope]
    j = matrix.filter("src <> dst").join(candidates, KEY).withColumn("_hit", hit)
    total = F.sum(F.when(F.col("_hit"), F.abs("w")).otherwise(0.0)).over(Window.partitionBy(*CAND))
    delta = F.when(F.col("_hit"), F.signum("w") * F.col("amount") * F.abs("w") / total).otherwise(0.0)
    return j.withColumn("new", F.when(total > 0, F.col("w") + delta).otherwise(F.raise_error(F.lit("the node has no weight to change")))).select(*CAND, "node", "amount", "src", "dst", "w", "new")


def _reach(p: DataFrame, candidates: DataFrame, baseline: DataFrame, scale: float) -> DataFrame:
    """(CAND, amount, to, x, push): 1 at the node itself plus scale * P[to, node]."""
    spread = p.select(*KEY, F.col("src").alias("to"), F.col("dst").alias("node"), F.col("w").alias("p"))
    base = baseline.select(*KEY, F.col("node").alias("to"), "x")
    j = candidates.join(base, KEY).join(spread, [*KEY, "to", "node"], "left")
    return j.withColumn("push", F.when(F.col("to") == F.col("node"), 1.0).otherwise(0.0) + scale * F.coalesce("p", F.lit(0.0)))


def additive_shift(p: DataFrame, candidates: DataFrame, baseline: DataFrame, scale: float = 0.75) -> DataFrame:
    """(CAND, to, x, final, ratio, clipped): amount added to the node and, scaled, to its direct neighbours; one hop only."""
    j = _reach(p, candidates, baseline, scale).withColumn("final", F.col("x") + F.col("amount") * F.col("push"))
    return with_ratio(j).select(*CAND, "to", "x", "final", "ratio", "clipped")


def log_gain(p: DataFrame, candidates: DataFrame, baseline: DataFrame, scale: float = 0.75) -> DataFrame:
    """(CAND, to, x, final, ratio, clipped): activations times exp(amount * push)."""
    j = _reach(p, candidates, baseline, scale).withColumn("final", F.col("x") * F.exp(F.col("amount") * F.col("push")))
    return with_ratio(j).select(*CAND, "to", "x", "final", "ratio", "clipped")


def with_ratio(df: DataFrame, low: float = 0.1, high: float = 10.0) -> DataFrame:
    """ratio (final + 1e-10) / (x + 1e-10), and clipped to [low, high]."""
    ratio = (F.col("final") + TINY) / (F.col("x") + TINY)
    return df.withColumn("ratio", ratio).withColumn("clipped", F.least(F.greatest(ratio, F.lit(low)), F.lit(high)))


def coactivation(matrix: DataFrame, ratios: DataFrame, exponent: float = 1.0, fraction: float = 1.0) -> DataFrame:
    """(CAND, src, dst, w, new): w + fraction * (w * (R_src * R_dst) ** exponent - w); fraction between 0 and 1."""
    if not 0 <= fraction <= 1:
        raise ValueError("fraction must be between 0 and 1")
    r = ratios.select(*CAND, F.col("to").alias("_n"), F.col("clipped").alias("_r"))
    a = r.withColumnsRenamed({"_n": "src", "_r": "_a"})
    b = r.withColumnsRenamed({"_n": "dst", "_r": "_b"})
    j = matrix.join(a, [*KEY, "src"]).join(b, [*CAND, "dst"])
    return j.withColumn("new", F.col("w") + fraction * (F.col("w") * F.pow(F.col("_a") * F.col("_b"), F.lit(exponent)) - F.col("w"))).select(*CAND, "src", "dst", "w", "new")


def change_statistics(changed: DataFrame) -> DataFrame:
    """(CAND, mean_abs, top, bottom, up, down, relative): of new - w; relative over |w| > 1e-10."""
    d = F.col("new") - F.col("w")
    return changed.groupBy(*CAND).agg(
        F.avg(F.abs(d)).alias("mean_abs"), F.max(d).alias("top"), F.min(d).alias("bottom"), F.sum((d > TINY).cast("long")).alias("up"), F.sum((d < -TINY).cast("long")).alias("down"),
        F.coalesce(F.avg(F.when(F.abs("w") > TINY, F.abs(d) / F.abs("w"))), F.lit(0.0)).alias("relative"),
    )


def constraint_values(ratios: DataFrame, low: float = 0.1, high: float = 10.0) -> DataFrame:
    """(CAND, under, over, violation, feasible): low - min ratio, max ratio - high, the sum of what is positive."""
    a = ratios.groupBy(*CAND).agg((low - F.min("ratio")).alias("under"), (F.max("ratio") - high).alias("over"))
    v = F.greatest("under", F.lit(0.0)) + F.greatest("over", F.lit(0.0))
    return a.withColumn("violation", v).withColumn("feasible", v <= TINY)


def objective(value: Column, baseline: Column) -> Column:
    """|value - baseline| over |baseline|, with 1 for baselines within 1e-10 of 0."""
    return F.abs(value - baseline) / F.when(F.abs(baseline) < TINY, 1.0).otherwise(F.abs(baseline))


def pareto_front(df: DataFrame, by: list[str], objectives: list[str], ident: str = "cand") -> DataFrame:
    """Feasible rows that no other feasible row of the key dominates (no worse in all objectives, better in one).

    Rows of a key are candidates of one unit: at most nodes times amounts.  Two objectives take a running minimum of the second
    over values of the first; of more, all pairs of a key's candidates are compared.  A null objective neither dominates nor is dominated.
    """
    own = df.filter("feasible") if "feasible" in df.columns else df
    if len(objectives) == 2:
        a, b = objectives
        before = F.min("_least").over(Window.partitionBy(*by).orderBy(a).rowsBetween(Window.unboundedPreceding, -1))
        least = own.filter(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(*by, a).agg(F.min(b).alias("_least")).withColumn("_before", before)
        beaten = (F.col("_before") <= F.col(b)) | (F.col("_least") < F.col(b))
        return own.join(least, [*by, a], "left").filter(~F.coalesce(beaten, F.lit(False))).select(*df.columns)
    other = own.select(*by, F.col(ident).alias("_id"), *[F.col(o).alias("_" + o) for o in objectives])
    worse = [F.col("_" + o) <= F.col(o) for o in objectives]
    better = [F.col("_" + o) < F.col(o) for o in objectives]
    cond, some = worse[0], better[0]
    for w, b in zip(worse[1:], better[1:], strict=True):
        cond, some = cond & w, some | b
    dominated = own.join(other, by).filter(cond & some).select(*by, ident).distinct()
    return own.join(dominated, [*by, ident], "left_anti")


def ideal_choice(front: DataFrame, by: list[str], objectives: list[str], ident: str = "cand", k: int = 1, zero: bool = True) -> DataFrame:
    """The k rows of each key nearest to the ideal point (0, or the front's minimum), with rank, distance and strength 1/rank."""
    w = Window.partitionBy(*by)
    d = F.sqrt(sum((F.col(o) - (F.lit(0.0) if zero else F.min(o).over(w))) ** 2 for o in objectives))
    ranked = front.withColumn("distance", F.round(d, 9)).withColumn("rank", F.row_number().over(w.orderBy("distance", ident)))
    return ranked.filter(F.col("rank") <= k).withColumn("strength", 1 / F.col("rank"))


def weighted_choice(front: DataFrame, by: list[str], weights: dict[str, float], ident: str = "cand") -> DataFrame:
    """The row of each key with the least weighted sum of objectives; the first candidate on ties."""
    s = sum(F.col(o) * x for o, x in weights.items())
    return front.withColumn("score", F.round(s, 9)).withColumn("_r", F.row_number().over(Window.partitionBy(*by).orderBy("score", ident))).filter("_r = 1").drop("_r")
