"""Pairwise estimators beyond one window: spectral Granger, orthogonalised envelopes, and multitaper spectra.

Samples are (grp, subject, channel, epoch, k, v), pairs (grp, subject, src, dst).  Whole recordings go through joins and
aggregates; a subject's Gram table, bounded by channels and lags, is finished in a grouped function.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.operators.connectivity import EPS, PAIR, TINY, by_frequency, corr
from corvane.operators.signals import EPOCH
from corvane.operators.var import SUBJECT, by_subject, lag_matrices

COEFFICIENTS = ("aa", "ab", "ba", "bb")  # of a pair (a, b): from a to a, from b to a, from a to b, from b to b


def bivariate(gram: DataFrame, order: int, ridge: float = 0.0) -> DataFrame:
    """(PAIR, aa, ab, ba, bb, va, vab, vb): for src < dst the lag coefficients, as arrays, and the residual sums of products of an autoregression of those two channels alone."""
    kind = dict(gram.dtypes)["i"]

    def kernel(names: list[str], full: np.ndarray) -> list[tuple]:
        n, out = len(names), []
        for i in range(n):
            for j in range(i + 1, n):
                own = np.array([lag * n + c for lag in range(order + 1) for c in (i, j)])
                g = full[np.ix_(own, own)]
                xx, xy = g[2:, 2:], g[2:, :2]
                coef = np.linalg.lstsq(xx + ridge * np.eye(2 * order), xy, rcond=None)[0]
                left = g[:2, :2] - coef.T @ xy - xy.T @ coef + coef.T @ xx @ coef
                a = lag_matrices(coef, 2)
                out.append((names[i], names[j], *[a[:, t, s].tolist() for t, s in ((0, 0), (0, 1), (1, 0), (1, 1))], left[0, 0], left[0, 1], left[1, 1]))
        return out

    arrays = ", ".join(f"{c} array<double>" for c in COEFFICIENTS)
    return by_subject(gram, kernel, order, f"src {kind}, dst {kind}, {arrays}, va double, vab double, vb double")


def _transfer(name: str, order: int, own: bool) -> tuple[Column, Column]:
    """Real and imaginary part of (1 if own) - sum of a_k exp(-2 pi i f k)."""
    re, im = F.lit(1.0 if own else 0.0), F.lit(0.0)
    for k in range(order):
        angle = 2 * math.pi * (k + 1) * F.col("f")
        re, im = re - F.col(name)[k] * F.cos(angle), im + F.col(name)[k] * F.sin(angle)
    return re, im


def _flow(own: tuple[Column, Column], other: tuple[Column, Column], v_from: Column, v_both: Column, v_to: Column) -> Column:
    """ln of a target's spectrum over its part without the source's own noise; own is the source's transfer to itself, other to the target.

    The spectrum is |own|^2 v_to - 2 re(own conj(other)) v_both + |other|^2 v_from over the squared determinant, which cancels.
    """
    (a, b), (c, d) = own, other
    whole = (a * a + b * b) * v_to - 2 * (a * c + b * d) * v_both + (c * c + d * d) * v_from
    share = v_both / v_to
    rest = v_to * ((a - share * c) * (a - share * c) + (b - share * d) * (b - share * d))
    return F.when((v_from <= EPS) | (v_to <= EPS), 0.0).otherwise(F.greatest(F.log(F.greatest(whole, F.lit(EPS)) / F.greatest(rest, F.lit(EPS))), F.lit(0.0)))


def spectral_granger(pairs: DataFrame, order: int, bands: dict[str, tuple[float, float]], points: int = 24) -> DataFrame:
    """(PAIR, band, gc) of both directions of the pairs of `bivariate`: the mean over `points` frequencies, in cycles per sample, of each band."""
    grid = pairs.sparkSession.createDataFrame([(b, float(f)) for b, (lo, hi) in bands.items() for f in np.linspace(lo, hi, points)], "band string, f double")
    at = pairs.crossJoin(F.broadcast(grid))  # a few dozen frequencies, set by the caller
    aa, ab, ba, bb = (_transfer(c, order, c in ("aa", "bb")) for c in COEFFICIENTS)
    va, vab, vb = F.col("va"), F.col("vab"), F.col("vb")
    both = at.withColumns({"there": _flow(aa, ba, va, vab, vb), "back": _flow(bb, ab, vb, vab, va)}).groupBy(*PAIR, "band").agg(F.avg("there").alias("there"), F.avg("back").alias("back"))
    ends = F.explode(F.array(F.struct(F.col("src").alias("s"), F.col("dst").alias("d"), F.col("there").alias("gc")), F.struct(F.col("dst").alias("s"), F.col("src").alias("d"), F.col("back").alias("gc")))).alias("e")
    return both.select("grp", "subject", "band", ends).select("grp", "subject", F.col("e.s").alias("src"), F.col("e.d").alias("dst"), "band", "e.gc")


# ---------------------------------------------------------------- envelopes


def analytic(samples: DataFrame, n: int) -> DataFrame:
    """(EPOCH, k, re, im): analytic signals of epochs of n samples, by a join to the circular kernel of the transform (n x n rows, n a few hundred at most)."""
    h = np.zeros(n)
    h[0], h[1 : (n + 1) // 2] = 1, 2
    if n % 2 == 0:
        h[n // 2] = 1
    kernel = np.fft.ifft(h)
    rows = [(m, k, 1.0 if m == k else 0.0, float(kernel[(k - m) % n].imag)) for m in range(n) for k in range(n)]
    basis = samples.sparkSession.createDataFrame(rows, "m int, k int, c double, h double")
    return samples.withColumnRenamed("k", "m").join(F.broadcast(basis), "m").groupBy(*EPOCH, "k").agg(F.sum(F.col("v") * F.col("c")).alias("re"), F.sum(F.col("v") * F.col("h")).alias("im"))


def orthogonalised_envelopes(parts: DataFrame) -> DataFrame:
    """(PAIR, w), src < dst: mean of both directions' |correlation| of a channel's log envelope with the other's, taken from the part of it that is orthogonal to the channel.

    Parts are analytic signals.  Orthogonal parts under TINY count as 0, so a mixture without lag gives about 0.
    """
    size = F.sqrt(F.col("re") ** 2 + F.col("im") ** 2)
    own = parts.withColumn("size", size).select("grp", "subject", "epoch", "k", "channel", "re", "im", "size")
    a = own.withColumnsRenamed({"channel": "src", "re": "ra", "im": "ia", "size": "sa"})
    b = own.withColumnsRenamed({"channel": "dst", "re": "rb", "im": "ib", "size": "sb"}).drop("sb")
    j = a.join(b, ["grp", "subject", "epoch", "k"]).filter("src <> dst")
    across = F.abs(F.col("ib") * F.col("ra") - F.col("rb") * F.col("ia"))
    orthogonal = F.when((F.col("sa") > TINY) & (across > TINY * F.col("sa")), across / F.col("sa")).otherwise(0.0)
    logs = j.select(*PAIR, F.log(F.col("sa") + EPS).alias("own"), F.log(orthogonal + EPS).alias("other"))
    one = logs.groupBy(*PAIR).agg(F.abs(F.coalesce(corr("own", "other"), F.lit(0.0))).alias("w"))
    return one.groupBy("grp", "subject", F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).agg(F.avg("w").alias("w"))


# ---------------------------------------------------------------- tapers


def sine_tapers(n: int, count: int) -> list[list[float]]:
    return [[math.sqrt(2 / (n + 1)) * math.sin(math.pi * t * (k + 1) / (n + 1)) for k in range(n)] for t in range(1, count + 1)]


def multitaper(samples: DataFrame, tapers: list[list[float]], low: float, high: float) -> DataFrame:
    """(EPOCH, taper, f, re, im): demeaned epochs times each taper, DFT bins j/n with low <= j/n <= high and j > 0, by a join to tapers and basis in one."""
    n = len(tapers[0])
    bins = [j for j in range(1, n // 2 + 1) if low - 1e-12 <= j / n <= high + 1e-12]
    rows = [(t, k, j, w[k] * math.cos(2 * math.pi * j * k / n), -w[k] * math.sin(2 * math.pi * j * k / n)) for t, w in enumerate(tapers) for j in bins for k in range(n)]
    basis = samples.sparkSession.createDataFrame(rows, "taper int, k int, f int, c double, s double")
    centred = samples.withColumn("v", F.col("v") - F.avg("v").over(Window.partitionBy(*EPOCH)))
    return centred.join(F.broadcast(basis), "k").groupBy(*EPOCH, "taper", "f").agg(F.sum(F.col("v") * F.col("c")).alias("re"), F.sum(F.col("v") * F.col("s")).alias("im"))


def taper_cross(spectra: DataFrame) -> DataFrame:
    """(PAIR, epoch, f, re, im, pa, pb), src < dst: cross-spectra and powers of an epoch, averaged over its tapers."""
    s = spectra.select("grp", "subject", "epoch", "taper", "f", "channel", "re", "im")
    a = s.withColumnsRenamed({"channel": "src", "re": "ra", "im": "ia"})
    b = s.withColumnsRenamed({"channel": "dst", "re": "rb", "im": "ib"})
    ra, ia, rb, ib = map(F.col, ("ra", "ia", "rb", "ib"))
    x = a.join(b, ["grp", "subject", "epoch", "taper", "f"]).filter("src < dst").groupBy(*PAIR, "epoch", "f")
    x = x.agg(F.avg(ra * rb + ia * ib).alias("re"), F.avg(ia * rb - ra * ib).alias("im"), F.avg(ra * ra + ia * ia).alias("pa"), F.avg(rb * rb + ib * ib).alias("pb"))
    return x.withColumn("im", F.when(F.abs("im") < TINY, 0.0).otherwise(F.col("im")))


def taper_measures(x: DataFrame, band: str = "band") -> DataFrame:
    """(PAIR, band, coherence, imcoh, plv, ciplv, dwpli2) of taper_cross rows with a band: each a mean over the band's bins, imcoh of magnitudes, dwpli2 at least 0."""
    clip = lambda c: F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0))
    s, a, q = F.sum("im"), F.sum(F.abs("im")), F.sum(F.col("im") ** 2)
    lag = x.groupBy(*PAIR, band, "f").agg(F.when(a * a - q > EPS, (s * s - q) / (a * a - q)).otherwise(0.0).alias("dwpli2"))
    bands = x.select("f", band).distinct()  # a row for each bin
    f = by_frequency(x).join(F.broadcast(bands), "f").join(lag, [*PAIR, band, "f"])
    return f.groupBy(*PAIR, band).agg(
        F.avg(F.sqrt(F.col("cre") ** 2 + F.col("cim") ** 2)).alias("coherence"),
        F.avg(F.abs("cim")).alias("imcoh"),
        F.avg(F.sqrt(F.col("pre") ** 2 + F.col("pim") ** 2)).alias("plv"),
        F.avg(clip(F.abs("pim") / F.sqrt(F.greatest(1 - F.col("pre") ** 2, F.lit(EPS))))).alias("ciplv"),
        F.greatest(F.avg("dwpli2"), F.lit(0.0)).alias("dwpli2"),
    )


def split_slope(x: DataFrame, band: str = "band") -> DataFrame:
    """(PAIR, band, psi) of ordered pairs: the signed phase slope of src < dst where it is positive, its negative part as dst to src."""
    w = Window.partitionBy(*PAIR, band).orderBy("f")
    bands = x.select("f", band).distinct()
    c = by_frequency(x).join(F.broadcast(bands), "f").withColumns({"nre": F.lead("cre").over(w), "nim": F.lead("cim").over(w)})
    signed = c.groupBy(*PAIR, band).agg(F.coalesce(F.sum(F.col("cre") * F.col("nim") - F.col("cim") * F.col("nre")), F.lit(0.0)).alias("psi"))
    zero = F.lit(0.0)
    ends = F.explode(F.array(F.struct(F.col("src").alias("s"), F.col("dst").alias("d"), F.greatest(F.col("psi"), zero).alias("v")), F.struct(F.col("dst").alias("s"), F.col("src").alias("d"), F.greatest(-F.col("psi"), zero).alias("v")))).alias("e")
    return signed.select("grp", "subject", band, ends).select("grp", "subject", F.col("e.s").alias("src"), F.col("e.d").alias("dst"), band, F.col("e.v").alias("psi"))
