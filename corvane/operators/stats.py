"""Tests, corrections and intervals over long tables, one plan for all keys.

A `long` table has key columns, grp ('Healthy' or another group) and value; null and NaN values take no part.
Random draws are a function of (seed, draw, row), so they do not depend on partitions.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from corvane.functions.tails import binomial_tail, chi2_tail, normal_two_sided, t_two_sided
from corvane.operators.ranks import numbered
from corvane.operators.resampling import fold, median_draws

HEALTHY = "Healthy"


def u_two_sided(small: int, large: int, u: float) -> float:
    """Exact two-sided p of Mann-Whitney's U without ties, from the numbers of arrangements by U."""
    top = small * large
    ways = np.zeros(top + 1)
    ways[0] = 1
    for k in range(1, small + 1):  # the Gaussian binomial coefficient: times (1 - q^(large + k)) / (1 - q^k)
        step = large + k
        if step <= top:
            ways[step:] -= ways[:-step].copy()
        for i in range(k, top + 1):
            ways[i] += ways[i - k]
    tail = int(min(u, top - u))
    return min(1.0, 2 * float(ways[: tail + 1].sum() / ways.sum()))


def signed_rank_two_sided(n: int, w: float) -> float:
    """Exact two-sided p of the smaller signed-rank sum of n pairs without ties or zeros."""
    ways = np.zeros(n * (n + 1) // 2 + 1)
    ways[0] = 1
    for k in range(1, n + 1):
        ways[k:] += ways[:-k].copy()
    return min(1.0, 2 * float(ways[: int(w) + 1].sum() / 2.0**n))


@F.pandas_udf(DoubleType())
def exact_u(small: pd.Series, large: pd.Series, u: pd.Series) -> pd.Series:
    """u_two_sided for each key; null where `small` is."""
    return pd.Series([None if pd.isna(a) else u_two_sided(int(a), int(b), float(x)) for a, b, x in zip(small, large, u, strict=True)], dtype="float64")


@F.pandas_udf(DoubleType())
def exact_signed_rank(n: pd.Series, w: pd.Series) -> pd.Series:
    return pd.Series([None if pd.isna(a) else signed_rank_two_sided(int(a), float(x)) for a, x in zip(n, w, strict=True)], dtype="float64")


def finite(df: DataFrame, name: str = "value") -> DataFrame:
    return df.filter(F.col(name).isNotNull() & ~F.isnan(name))


def average_rank(by: list[str], value: str) -> Column:
    """Rank with ties averaged."""
    return F.rank().over(Window.partitionBy(*by).orderBy(value)) + (F.count(F.lit(1)).over(Window.partitionBy(*by, value)) - 1) / 2


def mann_whitney(long: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n1, n2, u, p): U of the Healthy group and its two-sided p.

    p is exact where the smaller group has at most 8 values and no value is tied, and otherwise the tie-corrected normal
    tail with continuity.  p is null where a group is empty and 1 where all values are equal.  Ranks of values come from counts by value, so
    a key with very many rows is first reduced to its distinct values.
    """
    counts = finite(long).groupBy(*keys, "value").agg(F.count(F.lit(1)).alias("c"), F.sum((F.col("grp") == HEALTHY).cast("long")).alias("c1"))
    below = F.coalesce(F.sum("c").over(Window.partitionBy(*keys).orderBy("value").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rank = below + (F.col("c") + 1) / 2
    sums = counts.withColumn("rank", rank).groupBy(*keys).agg(F.sum("c1").alias("n1"), (F.sum("c") - F.sum("c1")).alias("n2"), F.sum(F.col("rank") * F.col("c1")).alias("r1"), F.sum(F.col("c") * (F.col("c") * F.col("c") - 1.0)).alias("t"), F.sum("c").alias("n"))
    u = F.col("r1") - F.col("n1") * (F.col("n1") + 1) / 2
    sd = F.sqrt(F.col("n1") * F.col("n2") / 12 * ((F.col("n") + 1) - F.try_divide(F.col("t"), F.col("n") * (F.col("n") - 1.0))))
    z = F.greatest(F.abs(F.col("u") - F.col("n1") * F.col("n2") / 2) - 0.5, F.lit(0.0)) / F.col("sd")
    small = (F.least("n1", "n2") <= 8) & (F.col("t") == 0)
    p = F.when((F.col("n1") == 0) | (F.col("n2") == 0), None).when(F.col("sd") == 0, 1.0).when(small, exact_u(F.when(small, F.least("n1", "n2")), F.greatest("n1", "n2"), F.col("u"))).otherwise(F.least(normal_two_sided(z), F.lit(1.0)))
    return sums.withColumn("u", u).withColumn("sd", sd).withColumn("p", p).select(*keys, "n1", "n2", "u", "p")


def adjust(df: DataFrame, p: str = "p", method: str = "fdr_bh", by: list[str] | None = None, tie: list[str] | None = None) -> DataFrame:
    """df with p_adj: Bonferroni, Benjamini-Hochberg or Holm over the non-null p of each `by`; null p stays null."""
    part = Window.partitionBy(*(by or [F.lit(0)]))
    own = df.withColumn("_m", F.count(p).over(part)).withColumn("_rank", F.row_number().over(part.orderBy(F.col(p).asc_nulls_last(), *(tie or []))))
    x = F.col(p)
    if method == "bonferroni":
        adj = F.least(x * F.col("_m"), F.lit(1.0))
    elif method == "holm":
        adj = F.least(F.max((F.col("_m") - F.col("_rank") + 1) * x).over(part.orderBy("_rank")), F.lit(1.0))
    else:
        adj = F.least(F.min(x * F.col("_m") / F.col("_rank")).over(part.orderBy(F.col("_rank").desc())), F.lit(1.0))
    return own.withColumn("p_adj", F.when(x.isNotNull(), adj)).drop("_m", "_rank")


def group_statistics(long: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, mean1, sd1, mean2, sd2): population sd by group."""
    v1, v2 = (F.when(F.col("grp") == HEALTHY, F.col("value")), F.when(F.col("grp") != HEALTHY, F.col("value")))
    return finite(long).groupBy(*keys).agg(F.avg(v1).alias("mean1"), F.stddev_pop(v1).alias("sd1"), F.avg(v2).alias("mean2"), F.stddev_pop(v2).alias("sd2"))


def cohens_d(long: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, d): difference of means, Healthy minus other, over the pooled sample sd; 0 for no spread."""
    v1, v2 = (F.when(F.col("grp") == HEALTHY, F.col("value")), F.when(F.col("grp") != HEALTHY, F.col("value")))
    n1, n2 = F.count(v1), F.count(v2)
    pooled = F.sqrt(((n1 - 1) * F.var_samp(v1) + (n2 - 1) * F.var_samp(v2)) / (n1 + n2 - 2))
    return finite(long).groupBy(*keys).agg(F.when(pooled > 0, (F.avg(v1) - F.avg(v2)) / pooled).otherwise(0.0).alias("d"))


def one_sample_t(edges: DataFrame, keys: list[str], popmean: float = 0.0, least: int = 2) -> DataFrame:
    """(keys, n, mean, t, p): two-sided; a constant series has p 1 when it equals popmean and 0 otherwise; null below `least` values."""
    agg = finite(edges, "w").groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg("w").alias("mean"), F.stddev_samp("w").alias("sd"))
    t = F.when(F.col("sd") > 0, (F.col("mean") - popmean) / (F.col("sd") / F.sqrt("n")))
    p = F.when(F.col("n") < least, None).when(F.col("sd") == 0, F.when(F.col("mean") == popmean, 1.0).otherwise(0.0)).otherwise(t_two_sided(F.col("t"), (F.col("n") - 1).cast("int")))
    return agg.withColumn("t", t).withColumn("p", p).select(*keys, "n", "mean", "t", "p")


def wilcoxon(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n, w_plus, w_minus, rank_biserial, p) of (before, after): zeros removed, ties averaged; p is 1 without differences.

    p is exact for at most 50 pairs without ties and zeros, and the tie-corrected normal tail otherwise.
    """
    d = pairs.withColumn("d", F.col("before") - F.col("after"))
    own = d.filter("d <> 0").withColumn("a", F.round(F.abs("d"), 9)).withColumn("rank", average_rank(keys, "a")).withColumn("c", F.count(F.lit(1)).over(Window.partitionBy(*keys, "a")))
    s = own.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col("d") > 0, F.col("rank")).otherwise(0.0)).alias("w_plus"), F.sum(F.when(F.col("d") < 0, F.col("rank")).otherwise(0.0)).alias("w_minus"), F.sum(F.col("c") * F.col("c") - 1.0).alias("t"))
    s = s.join(pairs.groupBy(*keys).agg(F.count(F.col("before") - F.col("after")).alias("all_")), keys)
    mu = F.col("n") * (F.col("n") + 1) / 4
    sd = F.sqrt(F.col("n") * (F.col("n") + 1) * (2 * F.col("n") + 1) / 24 - F.col("t") / 48)
    small = (F.col("n") <= 50) & (F.col("t") == 0) & (F.col("n") == F.col("all_"))
    p = F.when(small, exact_signed_rank(F.when(small, F.col("n")), F.least("w_plus", "w_minus"))).otherwise(F.least(normal_two_sided(F.abs(F.least("w_plus", "w_minus") - mu) / sd), F.lit(1.0)))
    out = pairs.select(*keys).distinct().join(s, keys, "left")
    total = F.col("w_plus") + F.col("w_minus")
    return out.select(*keys, F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("w_plus", F.lit(0.0)).alias("w_plus"), F.coalesce("w_minus", F.lit(0.0)).alias("w_minus"), F.coalesce((F.col("w_plus") - F.col("w_minus")) / total, F.lit(0.0)).alias("rank_biserial"), F.coalesce(p, F.lit(1.0)).alias("p"))


def friedman(wide: DataFrame, unit: str, columns: list[str]) -> DataFrame:
    """One row (n, statistic, p) over complete rows of `columns`, ties averaged and corrected; equal rows give (0, 1)."""
    k = len(columns)
    rows = wide.dropna(subset=columns).select(F.col(unit).alias("row"), F.explode(F.create_map(*[x for c in columns for x in (F.lit(c), F.col(c))])).alias("c", "v"))
    ranked = rows.withColumn("rank", average_rank(["row"], "v")).withColumn("ties", F.count(F.lit(1)).over(Window.partitionBy("row", "v")))
    by = ranked.groupBy("c").agg(F.count(F.lit(1)).alias("n"), F.sum("rank").alias("r"), F.sum(F.col("ties") * F.col("ties") - 1.0).alias("t"))
    s = by.agg(F.max("n").alias("n"), F.sum(F.col("r") * F.col("r")).alias("rr"), F.sum("t").alias("t"))
    raw = 12 / (F.col("n") * k * (k + 1)) * F.col("rr") - 3 * F.col("n") * (k + 1)
    correction = 1 - F.col("t") / (F.col("n") * k * (k * k - 1))
    stat = F.when(correction > 1e-12, raw / correction).otherwise(0.0)
    return s.withColumn("statistic", F.round(stat, 9)).select("n", "statistic", chi2_tail(F.greatest("statistic", F.lit(0.0)), k - 1).alias("p"))


def wilson(successes: Column, n: Column, z: float = 1.959963984540054) -> tuple[Column, Column]:
    """Ends of the 95 % Wilson score interval."""
    share = successes / n
    middle, width = share + z * z / (2 * n), z * F.sqrt(share * (1 - share) / n + z * z / (4 * n * n))
    return (middle - width) / (1 + z * z / n), (middle + width) / (1 + z * z / n)


def mad_iqr(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, median, mad, iqr): raw median absolute deviation and linear-interpolated quartile range."""
    med = df.groupBy(*keys).agg(F.percentile(value, 0.5).alias("median"), (F.percentile(value, 0.75) - F.percentile(value, 0.25)).alias("iqr"))
    return df.join(med, keys).groupBy(*keys, "median", "iqr").agg(F.percentile(F.abs(F.col(value) - F.col("median")), 0.5).alias("mad")).select(*keys, "median", "mad", "iqr")


def fisher(a: Column, b: Column, c: Column, d: Column) -> Column:
    """Two-sided p of a 2x2 table: the share of tables with the same margins that are no likelier."""
    zero = F.struct(*[F.lit(0.0).alias(x) for x in ("ln", "tail", "all")])

    def side(p: Column, q: Column, r: Column, s: Column) -> Column:
        """Tables on one side of the given one, whose cells p and q shrink: each from its neighbour, relative to the given one."""
        steps = F.when(F.least(p, q) >= 1, F.sequence(F.lit(1).cast("long"), F.greatest(F.least(p, q), F.lit(1)).cast("long"))).otherwise(F.array().cast("array<long>"))

        def add(t: Column, i: Column) -> Column:
            ln = t["ln"] + F.log((p - i + 1).cast("double") * (q - i + 1)) - F.log((r + i).cast("double") * (s + i))
            return F.struct(ln.alias("ln"), (t["tail"] + F.when(ln <= 1e-7, F.exp(ln)).otherwise(0.0)).alias("tail"), (t["all"] + F.exp(ln)).alias("all"))

        return F.aggregate(steps, zero, add)

    up, down = side(b, c, a, d), side(a, d, b, c)
    return F.least((1 + up["tail"] + down["tail"]) / (1 + up["all"] + down["all"]), F.lit(1.0))


def selection_superiority(counts: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, top, node, n_top, n_node, p, p_adj): the most chosen node (least number on ties) against each other one, exact binomial, BH."""
    order = Window.partitionBy(*keys).orderBy(F.col("n").desc(), "node")
    ranked = counts.withColumn("_r", F.row_number().over(order))
    top = ranked.filter("_r = 1").select(*keys, F.col("node").alias("top"), F.col("n").alias("n_top"))
    others = ranked.filter("_r > 1").join(top, keys).select(*keys, "top", "node", "n_top", F.col("n").alias("n_node"))
    return adjust(others.withColumn("p", binomial_tail(F.col("n_top"), F.col("n_top") + F.col("n_node"))), "p", "fdr_bh", keys, ["node"])


#: Modulus of `mixed`, a prime.
_M = 2**31 - 1


def mixed(a: Column, b: Column, seed: int = 42) -> Column:
    """A whole number below 2**31 - 1 for each pair of whole numbers, by two squarings: the same in Spark, numpy and SQL."""
    x = F.pmod(a * 69621 + b * 48271 + seed, F.lit(_M).cast("long"))
    y = F.pmod(x * x + a, F.lit(_M).cast("long"))
    return F.pmod(y * y + F.pmod(b, F.lit(_M).cast("long")), F.lit(_M).cast("long"))


def _mixed(a: np.ndarray, b: np.ndarray, seed: int = 42) -> np.ndarray:
    x = (a * 69621 + b * 48271 + seed) % _M
    y = (x * x + a) % _M
    return (y * y + b % _M) % _M


def _signed_sums(at: np.ndarray, u: np.ndarray, v: np.ndarray, seed: int, draws: int = 256) -> np.ndarray:
    """For each draw the sum of v, negative where _mixed(draw, u) is odd; some draws at a time, so that a step stays in the cache."""
    out, add, low = np.empty(len(at)), u * 48271 + seed, u % _M
    for k in range(0, len(at), draws):
        a = at[k : k + draws, None]
        x = (a * 69621 + add) % _M
        y = fold(x * x + a)
        out[k : k + draws] = v.sum() - 2.0 * ((fold(y * y + low) & 1).astype(float) @ v)
    return out


def duck_mixed(a: str, b: str, seed: int = 42) -> str:
    x = f"(({a} * 69621 + {b} * 48271 + {seed}) % {_M})"
    y = f"(({x} * {x} + {a}) % {_M})"
    return f"(({y} * {y} + {b} % {_M}) % {_M})"


def sign_flip(differences: DataFrame, keys: list[str], unit: str = "unit", value: str = "value", permutations: int = 10_000, seed: int = 42, rows: int = 256) -> DataFrame:
    """(keys, n, mean, p): one-sided p of mean > 0 under random signs of the differences; 1 for means <= 0 and without differences.

    With few enough differences other than 0 all sign patterns are counted; otherwise `permutations` are drawn, and the
    observed one counts as one more.  `unit` is a whole number; the sign of draw b for unit u is a bit of mixed(b, u), so
    draws don't depend on partitions.  Each batch of rows gives the partial sums of all draws, one row for each.
    """
    kinds = dict(differences.dtypes)
    own = differences.select(*keys, F.col(unit).cast("long").alias("u"), F.col(value).cast("double").alias("v")).filter("v IS NOT NULL AND NOT isnan(v)")
    agg = own.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg("v").alias("mean"), F.sum((F.abs("v") > 1e-12).cast("long")).alias("nz"))
    few = min(20, permutations.bit_length() - 1)
    at = np.arange(1, permutations + 1, dtype=np.int64)

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            for key, part in frame.groupby(keys, dropna=False):
                total = np.zeros(permutations)
                for k in range(0, len(part), rows):
                    u, v = part["u"].to_numpy()[k : k + rows], part["v"].to_numpy()[k : k + rows]
                    total += _signed_sums(at, u, v, seed)
                yield pd.DataFrame(dict(zip(keys, key, strict=True)) | {"perm": at, "s": total})

    large = own.join(agg.filter(F.col("nz") > few).select(*keys), keys, "left_semi")
    drawn = large.mapInPandas(sums, ", ".join(f"{k} {kinds[k]}" for k in keys) + ", perm long, s double").groupBy(*keys, "perm").agg(F.sum("s").alias("s"))
    hits = drawn.join(agg, keys).groupBy(*keys).agg(((F.sum((F.col("s") / F.col("n") >= F.col("mean") - 1e-12).cast("long")) + 1) / (permutations + 1)).alias("p"))
    # every pattern of the signs of at most 20 numbers
    patterns = own.filter("abs(v) > 1e-12").join(agg.filter(F.col("nz") <= few), keys).groupBy(*keys, "n", "mean").agg(F.collect_list("v").alias("vs"))
    flipped = F.aggregate(F.sequence(F.lit(0), F.size("vs") - 1), F.lit(0.0), lambda t, i: t + F.when((F.shiftright("mask", 0).bitwiseAND(F.pow(F.lit(2), i).cast("int"))) == 0, 1.0).otherwise(-1.0) * F.get("vs", i))
    each = patterns.withColumn("mask", F.explode(F.sequence(F.lit(0), F.pow(F.lit(2), F.size("vs")).cast("int") - 1))).withColumn("m", flipped / F.col("n"))
    exact = each.groupBy(*keys).agg(F.avg((F.col("m") >= F.col("mean") - 1e-12).cast("double")).alias("p"))
    return agg.join(hits.unionByName(exact), keys, "left").select(*keys, "n", "mean", F.when(F.col("mean") <= 0, 1.0).otherwise(F.coalesce("p", F.lit(1.0))).alias("p"))


def bootstrap(df: DataFrame, keys: list[str], value: str, statistic=None, resamples: int = 200, seed: int = 42, level: float = 0.95) -> DataFrame:
    """(keys, n, low, high): percentile interval of any aggregate over resampled rows of each key; of the median unless `statistic` is given.

    Rows of a key are numbered by value, and draw j of resample b takes row mixed(b, j) modulo n.  A median is found by the
    numbers alone, so its draws are no rows; for other aggregates resamples are a join on that number.
    """
    if statistic is None:
        rows = numbered(df.filter(F.col(value).isNotNull()).select(*keys, value), keys, [value], "_i").withColumn("_i", F.col("_i") - 1)
        found = median_draws(rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")), keys, resamples, seed).select(*keys, "n", "_b", F.explode(F.array("_lo", "_hi")).alias("_i"))
        stats = found.join(rows, [*keys, "_i"]).groupBy(*keys, "n", "_b").agg(F.avg(value).alias("_s"))
        return stats.groupBy(*keys, "n").agg(F.percentile("_s", (1 - level) / 2).alias("low"), F.percentile("_s", (1 + level) / 2).alias("high"))
    rows = df.filter(F.col(value).isNotNull()).withColumn("_i", (F.row_number().over(Window.partitionBy(*keys).orderBy(value)) - 1).cast("long"))
    sizes = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    draws = sizes.withColumn("_b", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(resamples).cast("long")))).withColumn("_j", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n")))).withColumn("_i", mixed(F.col("_b"), F.col("_j"), seed) % F.col("n"))
    stats = draws.join(rows.select(*keys, "_i", value), [*keys, "_i"]).groupBy(*keys, "n", "_b").agg(statistic(F.col(value)).alias("_s"))
    return stats.groupBy(*keys, "n").agg(F.percentile("_s", (1 - level) / 2).alias("low"), F.percentile("_s", (1 + level) / 2).alias("high"))
