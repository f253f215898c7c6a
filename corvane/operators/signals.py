"""Epochs, windows, spectra and quality of multichannel signals.

signal: (grp, subject, channel, t, v).  epoch samples: (grp, subject, channel, epoch, k, v).  A long row for each sample
suits short epochs; for long ones `packed` and `spectrum_arrow` keep an epoch in one array and emit only the bins of a band.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

UNIT = ["grp", "subject", "channel"]
EPOCH = [*UNIT, "epoch"]


def epochs(signal: DataFrame, samples: int, overlap: int = 0, key: list[str] = UNIT) -> DataFrame:
    """Cut t into epochs of `samples` with `overlap`; the last partial epoch is dropped, but a recording shorter than one epoch gives one, padded with zeros."""
    step = samples - overlap
    n = signal.groupBy(*key).agg((F.max("t") + 1).alias("_n"))
    last = F.greatest(F.floor((F.col("_n") - samples) / step), F.lit(0))
    first = F.greatest(F.ceil((F.col("t") - samples + 1) / step), F.lit(0))
    upto = F.least(F.floor(F.col("t") / step), F.col("_last"))
    j = signal.join(n.withColumn("_last", last), key).withColumn("_first", first).withColumn("_upto", upto).filter("_first <= _upto")
    cut = j.withColumn("epoch", F.explode(F.sequence(F.col("_first").cast("int"), F.col("_upto").cast("int")))).withColumn("k", (F.col("t") - F.col("epoch") * step).cast("int"))
    short = n.filter(F.col("_n") < samples).select(*key, F.lit(0).alias("epoch"), F.explode(F.sequence(F.col("_n").cast("int"), F.lit(samples - 1))).alias("k"), F.lit(0.0).alias("v"))
    return cut.select(*key, "epoch", "k", "v").unionByName(short)


def packed(samples: DataFrame) -> DataFrame:
    """(EPOCH, x): samples of an epoch as one array of floats in order."""
    return samples.groupBy(*EPOCH).agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "v"))), lambda s: s["v"].cast("float")).alias("x"))


def standardised(samples: DataFrame, key: list[str] = UNIT) -> DataFrame:
    """v minus the channel's mean over its population sd; a constant channel is an error."""
    w = Window.partitionBy(*key)  # not a join: samples and their own sums come from one pass
    s = samples.withColumns({"_m": F.avg("v").over(w), "_sd": F.stddev_pop("v").over(w)})
    z = F.when(F.col("_sd") > 0, (F.col("v") - F.col("_m")) / F.col("_sd")).otherwise(F.raise_error(F.lit("a channel is constant")))
    return s.withColumn("v", z).drop("_m", "_sd")


def apply_standardisation(samples: DataFrame, stats: DataFrame, key: list[str]) -> DataFrame:
    """Standardise with stored (key, m, sd)."""
    return samples.join(stats, key).withColumn("v", (F.col("v") - F.col("m")) / F.col("sd")).drop("m", "sd")


def mixed(signal: DataFrame, weights: DataFrame) -> DataFrame:
    """Linear recombination of channels at every sample: weights (channel, out_channel, g)."""
    return signal.join(F.broadcast(weights), "channel").groupBy("grp", "subject", F.col("out_channel").alias("channel"), "t").agg(F.sum(F.col("g") * F.col("v")).alias("v"))


def spectrum(samples: DataFrame, n: int, low: float, high: float) -> DataFrame:
    """(EPOCH, f, re, im): demeaned, symmetric Hann window, DFT bins j/n with low <= j/n <= high and j > 0, by a join to the basis.

    Frequencies are in cycles per sample; n is at most a few hundred, so the basis table has a bounded number of rows.
    """
    spark = samples.sparkSession
    hann = [0.5 - 0.5 * math.cos(2 * math.pi * k / (n - 1)) for k in range(n)]
    rows = [(k, j, hann[k] * math.cos(2 * math.pi * j * k / n), -hann[k] * math.sin(2 * math.pi * j * k / n)) for j in range(1, n // 2 + 1) if low - 1e-12 <= j / n <= high + 1e-12 for k in range(n)]
    basis = spark.createDataFrame(rows, "k int, f int, c double, s double")
    centred = samples.withColumn("v", F.col("v") - F.avg("v").over(Window.partitionBy(*EPOCH)))
    return centred.join(F.broadcast(basis), "k").groupBy(*EPOCH, "f").agg(F.sum(F.col("v") * F.col("c")).alias("re"), F.sum(F.col("v") * F.col("s")).alias("im"))


def spectrum_arrow(epochs_: DataFrame, low: float, high: float) -> DataFrame:
    """The same spectrum from packed epochs of any length, by an FFT for each array; only the bins of the band leave Python."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in batches:
            out = []
            for x in s:
                v = np.asarray(x, float)
                n = len(v)
                z = np.fft.rfft((v - v.mean()) * (0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n) / max(n - 1, 1)))) if n else np.zeros(0, complex)
                j = np.arange(len(z))
                keep = (j > 0) & (j / max(n, 1) >= low - 1e-12) & (j / max(n, 1) <= high + 1e-12)
                out.append((j[keep].tolist(), z.real[keep].tolist(), z.imag[keep].tolist()))
            yield pd.DataFrame(out, columns=["f", "re", "im"])

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.DataFrame]}
    z = F.pandas_udf(run, "f array<int>, re array<double>, im array<double>")
    flat = epochs_.select(*EPOCH, z("x").alias("z")).select(*EPOCH, F.explode(F.arrays_zip("z.f", "z.re", "z.im")).alias("b"))
    return flat.select(*EPOCH, F.col("b.f").alias("f"), F.col("b.re").alias("re"), F.col("b.im").alias("im"))


def welch(samples: DataFrame, n: int, segment: int, fs: float = 1.0) -> DataFrame:
    """(UNIT, f, psd): periodic Hann segments with half overlap, constant detrend, density scaling, one-sided, averaged over epochs and segments."""
    spark, step = samples.sparkSession, segment // 2
    hann = [0.5 - 0.5 * math.cos(2 * math.pi * k / segment) for k in range(segment)]
    scale = 1 / (fs * sum(h * h for h in hann))
    basis = spark.createDataFrame([(k, j, hann[k] * math.cos(2 * math.pi * j * k / segment), -hann[k] * math.sin(2 * math.pi * j * k / segment)) for j in range(segment // 2 + 1) for k in range(segment)], "kk int, f int, c double, s double")
    starts = F.array(*[F.lit(a) for a in range(0, n - segment + 1, step)])
    cut = samples.withColumn("a", F.explode(starts)).withColumn("kk", F.col("k") - F.col("a")).filter(F.col("kk").between(0, segment - 1))
    own = [*EPOCH, "a"]
    z = cut.withColumn("v", F.col("v") - F.avg("v").over(Window.partitionBy(*own))).join(F.broadcast(basis), "kk").groupBy(*own, "f").agg(F.sum(F.col("v") * F.col("c")).alias("re"), F.sum(F.col("v") * F.col("s")).alias("im"))
    sides = F.when((F.col("f") == 0) | ((F.col("f") == segment // 2) & F.lit(segment % 2 == 0)), 1.0).otherwise(2.0)
    return z.groupBy(*UNIT, "f").agg(F.avg(F.col("re") * F.col("re") + F.col("im") * F.col("im")).alias("p")).select(*UNIT, "f", (F.col("p") * scale * sides).alias("psd"))


def band_power(psd: DataFrame, low: int, high: int) -> DataFrame:
    """(UNIT, power): trapezoid over bins low..high."""
    w = Window.partitionBy(*UNIT).orderBy("f")
    own = psd.filter(F.col("f").between(low, high)).withColumn("_p", F.lead("psd").over(w)).withColumn("_f", F.lead("f").over(w))
    return own.groupBy(*UNIT).agg(F.coalesce(F.sum((F.col("psd") + F.col("_p")) / 2 * (F.col("_f") - F.col("f"))), F.lit(0.0)).alias("power"))


def spectral_entropy(psd: DataFrame, low: int, high: int) -> DataFrame:
    own = psd.filter(F.col("f").between(low, high)).withColumn("_p", F.try_divide("psd", F.sum("psd").over(Window.partitionBy(*UNIT))))
    return own.groupBy(*UNIT).agg(F.coalesce(F.sum(-F.col("_p") * F.log(F.col("_p") + 1e-12)), F.lit(0.0)).alias("entropy"))


def hjorth(samples: DataFrame) -> DataFrame:
    """(EPOCH, activity, mobility, complexity) with population variances; 0 where undefined."""
    w = Window.partitionBy(*EPOCH).orderBy("k")
    d = samples.withColumn("d1", F.col("v") - F.lag("v").over(w)).withColumn("d2", F.col("d1") - F.lag("d1").over(w))
    a = d.groupBy(*EPOCH).agg(F.var_pop("v").alias("v0"), F.var_pop("d1").alias("v1"), F.var_pop("d2").alias("v2"))
    mobility = F.when(F.col("v0") > 1e-12, F.sqrt(F.col("v1") / F.col("v0"))).otherwise(0.0)
    complexity = F.when((F.col("v1") > 1e-12) & (F.col("v0") > 1e-12), F.sqrt(F.col("v2") / F.col("v1")) / F.sqrt(F.col("v1") / F.col("v0"))).otherwise(0.0)
    return a.select(*EPOCH, F.col("v0").alias("activity"), mobility.alias("mobility"), complexity.alias("complexity"))


def rms(samples: DataFrame, key: list[str] = UNIT) -> DataFrame:
    return samples.groupBy(*key).agg(F.sqrt(F.avg(F.col("v") * F.col("v"))).alias("rms"))


def baseline_activation(signal: DataFrame) -> DataFrame:
    """(UNIT, value): time mean of each channel, min-max over a subject's channels, into 0.1 to 1."""
    m = signal.groupBy(*UNIT).agg(F.avg("v").alias("m"))
    w = Window.partitionBy("grp", "subject")
    return m.select(*UNIT, ((F.col("m") - F.min("m").over(w)) / (F.max("m").over(w) - F.min("m").over(w) + 1e-10) * 0.9 + 0.1).alias("value"))


def quality(signal: DataFrame) -> DataFrame:
    """One row for each subject: channels, samples, non-finite values, mean/max/min |v|, flat channels (sd < 1e-6), noisy ones (sd above mean + 3 sd of sds)."""
    bad = F.isnan("v") | (F.abs("v") == float("inf")) | F.col("v").isNull()
    ch = signal.groupBy(*UNIT).agg(F.count(F.lit(1)).alias("n"), F.sum(bad.cast("long")).alias("bad"), F.avg(F.abs("v")).alias("m"), F.max(F.abs("v")).alias("hi"), F.min(F.abs("v")).alias("lo"), F.stddev_pop("v").alias("sd"))
    w = Window.partitionBy("grp", "subject")
    ch = ch.withColumn("noisy", F.col("sd") > F.avg("sd").over(w) + 3 * F.stddev_pop("sd").over(w))
    return ch.groupBy("grp", "subject").agg(F.count(F.lit(1)).alias("channels"), F.max("n").alias("samples"), F.sum("bad").alias("n_bad"), F.avg("m").alias("mean_abs"), F.max("hi").alias("max_abs"), F.min("lo").alias("min_abs"), F.sum((F.col("sd") < 1e-6).cast("long")).alias("flat"), F.sum(F.col("noisy").cast("long")).alias("noisy"))


def split_half(samples: DataFrame) -> DataFrame:
    """Every sample in split `full` and in `odd` (epoch 0, 2, ...) or `even`."""
    return samples.withColumn("split", F.explode(F.array(F.lit("full"), F.when(F.col("epoch") % 2 == 0, "odd").otherwise("even"))))


def reversed_time(samples: DataFrame, n: int) -> DataFrame:
    return samples.withColumn("k", n - 1 - F.col("k"))


def lagged(samples: DataFrame, order: int) -> DataFrame:
    """Rows k >= order with columns l1..l<order>; lags never cross an epoch."""
    w = Window.partitionBy(*EPOCH).orderBy("k")
    return samples.withColumns({f"l{i}": F.lag("v", i).over(w) for i in range(1, order + 1)}).filter(F.col("k") >= order)


def invalid_subjects(samples: DataFrame, least_epochs: int = 2, least_channels: int = 2, least_samples: int = 16) -> DataFrame:
    """(grp, subject, reason) of subjects that spectra can't use."""
    a = samples.groupBy("grp", "subject").agg(F.countDistinct("epoch").alias("e"), F.countDistinct("channel").alias("c"), F.countDistinct("k").alias("s"), F.max((F.col("v").isNull() | F.isnan("v") | (F.abs("v") == float("inf"))).cast("int")).alias("b"))
    reason = F.when(F.col("e") < least_epochs, "epochs").when(F.col("c") < least_channels, "channels").when(F.col("s") < least_samples, "samples").when(F.col("b") > 0, "values")
    return a.withColumn("reason", reason).filter("reason IS NOT NULL").select("grp", "subject", "reason")
