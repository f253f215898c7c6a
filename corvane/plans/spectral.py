"""Queries over event signals: epochs, spectra, signal features and connectivity, with their DuckDB texts."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.functions.stages import stage_table
from corvane.operators import connectivity as C
from corvane.operators import signals as S
from corvane.plans.network import r
from corvane.sources import adapters as A

N = A.EPOCH
#: Bands in bins of N samples.
BANDS = {"delta": (1, 3), "alpha": (4, 6), "beta": (7, 10)}
#: Bins of all bands, and the window of `signals.spectrum`.
BINS, HANN = list(range(1, N // 2 + 1)), 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(N) / (N - 1))


def samples(spark: SparkSession, sf: str) -> DataFrame:
    return A.epoch_sample(spark, sf)


def spectrum(spark, sf) -> DataFrame:
    """All bins of all bands, as a stage table: the pair self join reads it twice."""
    return stage_table(S.spectrum(samples(spark, sf), N, 0.05, 0.5), "spectrum")


def banded(df: DataFrame) -> DataFrame:
    band = F.when(F.col("f") <= 3, "delta").when(F.col("f") <= 6, "alpha").otherwise("beta")
    return df.withColumn("band", band)


def c01_epochs(spark, sf):
    return S.epochs(A.signal(spark, sf), 20).groupBy("subject", "epoch").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("v"), 4).alias("total"))


def c01_overlapping_epochs(spark, sf):
    return S.epochs(A.signal(spark, sf), 50, 20).groupBy("subject", "channel", "epoch").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("v"), 4).alias("total"))


def c03_band_fan_out(spark, sf):
    bands = spark.createDataFrame([(b, i) for i, b in enumerate(BANDS)], "band string, ord int")
    return samples(spark, sf).crossJoin(F.broadcast(bands)).groupBy("band", "ord", "channel").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("v"), 6).alias("mean"))


def c07_channel_mixing(spark, sf):
    """Each channel minus the mean of all: an average reference as a mixing matrix."""
    names = A.table(spark, sf, "events").select("event_type").distinct()
    k = names.agg(F.count(F.lit(1)).alias("k"))
    w = names.select(F.col("event_type").alias("channel")).crossJoin(names.select(F.col("event_type").alias("out_channel"))).crossJoin(F.broadcast(k))
    w = w.select("channel", "out_channel", (F.when(F.col("channel") == F.col("out_channel"), 1.0).otherwise(0.0) - 1 / F.col("k")).alias("g"))
    return S.mixed(A.signal(spark, sf), w).groupBy("subject", "channel").agg(F.round(F.avg("v"), 6).alias("mean"), F.round(F.max("v"), 6).alias("top"))


def c08_c25_standardised(spark, sf):
    return S.standardised(A.signal(spark, sf)).select("subject", "channel", "t", r("v"))


def c09_spectrum(spark, sf):
    return S.spectrum(samples(spark, sf), N, 0.05, 0.5).select("subject", "channel", "epoch", "f", F.round(F.col("re") + 0.0, 6).alias("re"), F.round(F.col("im") + 0.0, 6).alias("im")).withColumns({c: F.when(F.abs(c) < 1e-6, 0.0).otherwise(F.col(c)) for c in ("re", "im")})


def _psd(spark, sf):
    return S.welch(samples(spark, sf), N, 10)


def c10_welch(spark, sf):
    return _psd(spark, sf).select("subject", "channel", "f", r("psd"))


def c11_band_power(spark, sf):
    return S.band_power(_psd(spark, sf), 1, 3).select("subject", "channel", r("power"))


def c12_spectral_entropy(spark, sf):
    return S.spectral_entropy(_psd(spark, sf), 1, 5).select("subject", "channel", r("entropy", 5))


def c13_hjorth(spark, sf):
    return S.hjorth(samples(spark, sf)).select("subject", "channel", "epoch", r("activity", 4), r("mobility"), r("complexity"))


def c17_band_rms(spark, sf):
    return S.rms(samples(spark, sf)).select("subject", "channel", r("rms"))


def c18_baseline_activation(spark, sf):
    return S.baseline_activation(A.signal(spark, sf)).select("subject", "channel", r("value"))


def c19_quality(spark, sf):
    return S.quality(A.signal(spark, sf)).select("grp", "subject", "channels", "samples", "n_bad", r("mean_abs"), r("max_abs"), r("min_abs"), "flat", "noisy")


def c20_split_half(spark, sf):
    return S.split_half(samples(spark, sf)).groupBy("subject", "split").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("v"), 4).alias("total"))


def c21_time_reversal(spark, sf):
    return S.reversed_time(samples(spark, sf), N).select("subject", "channel", "epoch", "k", r("v", 4))


def c22_lag_design(spark, sf):
    return S.lagged(samples(spark, sf), 2).groupBy("subject", "channel").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(F.col("v") * F.col("l1")), 4).alias("s1"), F.round(F.sum(F.col("v") * F.col("l2")), 4).alias("s2"))


def c24_invalid_subjects(spark, sf):
    return S.invalid_subjects(samples(spark, sf).filter("v > 0"), 6, 5, 16)


def c24_invalid_recordings(spark, sf):
    """All samples of recordings that end early for some users, lack a channel for others, and hold a value that is not finite for others again."""
    s = samples(spark, sf).filter("(subject % 5 <> 1 OR epoch < subject % 3) AND (subject % 5 <> 2 OR channel = 'view') AND (subject % 5 <> 4 OR k < subject % 20)")
    bad = (F.col("subject") % 5 == 3) & (F.col("epoch") == 2) & (F.col("k") == F.col("subject") % 20)
    return S.invalid_subjects(s.withColumn("v", F.when(bad, float("inf")).otherwise(F.col("v"))))


def _cross(spark, sf, ordered=False):
    return banded(C.cross(spectrum(spark, sf), ordered))


def _per_band(x: DataFrame, f) -> DataFrame:
    out = [f(x.filter(F.col("band") == b).drop("band")).withColumn("band", F.lit(b)) for b in BANDS]
    return out[0].unionByName(out[1]).unionByName(out[2])


def d01_cross_spectrum(spark, sf):
    x = C.cross(S.spectrum(samples(spark, sf), N, 0.05, 0.5)).groupBy("subject", "src", "dst", "f").agg(F.sum("re").alias("re"), F.sum("im").alias("im"))
    return x.select("subject", "src", "dst", "f", *[F.round(F.when(F.abs(c) < 1e-6, 0.0).otherwise(F.col(c)), 3).alias(c) for c in ("re", "im")])


def d02_d08_undirected(spark, sf):
    x = stage_table(_cross(spark, sf), "cross")
    return _per_band(x, C.undirected).select("band", "subject", "src", "dst", *[r(c, 5) for c in ("coherence", "imcoh", "plv", "ciplv", "ppc", "pli", "dwpli2")])


def d09_d11_directed(spark, sf):
    x = stage_table(_cross(spark, sf, True), "cross")
    return _per_band(x, C.directed).select("band", "subject", "src", "dst", *[r(c, 5) for c in ("dpli", "dwpli", "psi")])


def d17_ordered_pairs(spark, sf):
    n = A.table(spark, sf, "events").select(F.col("event_type").alias("src")).distinct()
    return n.crossJoin(n.withColumnRenamed("src", "dst")).filter("src <> dst")


def d20_gram(spark, sf):
    return C.gram(samples(spark, sf), 1).select("subject", "i", "li", "j", "lj", r("s", 4))


def d31_correlation(spark, sf):
    return C.correlation_edges(samples(spark, sf)).select("subject", "src", "dst", r("cov", 4), r("cor"), r("shrunk"))


def d34_split_half_reliability(spark, sf):
    x = S.split_half(samples(spark, sf)).filter("split <> 'full'")
    parts = [C.correlation_edges(x.filter(F.col("split") == h).drop("split")).withColumn("split", F.lit(h)).withColumn("cor", F.round("cor", 9)) for h in ("odd", "even")]
    out = C.split_half_reliability(parts[0].unionByName(parts[1]), "cor")
    return out.select("subject", r("spearman"), r("pearson"), r("error"), r("jaccard"))


_BASIS = f"basis AS (SELECT k::INTEGER AS k, f::INTEGER AS f, h * cos(2 * pi() * f * k / {N}.0) AS c, -h * sin(2 * pi() * f * k / {N}.0) AS s FROM (SELECT k, 0.5 - 0.5 * cos(2 * pi() * k / {N - 1}.0) AS h FROM range(0, {N}) a(k)), range(1, {N // 2 + 1}) b(f))"
_SPEC = "spec AS MATERIALIZED (SELECT grp, subject, channel, epoch, f, sum(v * c) AS re, sum(v * s) AS im FROM (SELECT grp, subject, channel, epoch, k, v - avg(v) OVER (PARTITION BY grp, subject, channel, epoch) AS v FROM epoch_sample) JOIN basis USING (k) GROUP BY ALL)"
_CROSS = "crs AS MATERIALIZED (SELECT *, CASE WHEN abs(im0) < 1e-9 THEN 0 ELSE im0 END AS im FROM (SELECT a.subject, a.channel AS src, b.channel AS dst, a.epoch, a.f, CASE WHEN a.f <= 3 THEN 'delta' WHEN a.f <= 6 THEN 'alpha' ELSE 'beta' END AS band, a.re * b.re + a.im * b.im AS re, a.im * b.re - a.re * b.im AS im0, a.re ** 2 + a.im ** 2 AS pa, b.re ** 2 + b.im ** 2 AS pb FROM spec a JOIN spec b ON a.grp = b.grp AND a.subject = b.subject AND a.epoch = b.epoch AND a.f = b.f AND a.channel <> b.channel))"
_FREQ = "freq AS (SELECT *, sre / den AS cre, sim / den AS cim FROM (SELECT band, subject, src, dst, f, count(*) AS e, sum(re) AS sre, sum(im) AS sim, sqrt(greatest(sum(pa), 1e-12) * greatest(sum(pb), 1e-12)) AS den, avg(CASE WHEN sqrt(re ** 2 + im ** 2) > 1e-9 THEN re / sqrt(re ** 2 + im ** 2) ELSE 0 END) AS pre, avg(CASE WHEN sqrt(re ** 2 + im ** 2) > 1e-9 THEN im / sqrt(re ** 2 + im ** 2) ELSE 0 END) AS pim FROM crs GROUP BY ALL))"
_WELCH = [
    "wbasis AS (SELECT kk::INTEGER AS kk, f::INTEGER AS f, h, h * cos(2 * pi() * f * kk / 10.0) AS c, -h * sin(2 * pi() * f * kk / 10.0) AS s FROM (SELECT kk, 0.5 - 0.5 * cos(2 * pi() * kk / 10.0) AS h FROM range(0, 10) a(kk)), range(0, 6) b(f))",
    "seg AS (SELECT grp, subject, channel, epoch, a, k - a AS kk, v - avg(v) OVER (PARTITION BY grp, subject, channel, epoch, a) AS v FROM epoch_sample, (VALUES (0), (5), (10)) st(a) WHERE k - a BETWEEN 0 AND 9)",
    "psd AS MATERIALIZED (SELECT subject, channel, f, avg(re ** 2 + im ** 2) / (SELECT sum(h * h) FROM wbasis WHERE f = 0) * CASE WHEN f IN (0, 5) THEN 1 ELSE 2 END AS psd FROM (SELECT subject, channel, epoch, a, f, sum(v * c) AS re, sum(v * s) AS im FROM seg JOIN wbasis USING (kk) GROUP BY ALL) GROUP BY subject, channel, f)",
]
_HJ = "d AS (SELECT *, d1 - lag(d1) OVER w AS d2 FROM (SELECT *, v - lag(v) OVER w AS d1 FROM epoch_sample WINDOW w AS (PARTITION BY subject, channel, epoch ORDER BY k)) WINDOW w AS (PARTITION BY subject, channel, epoch ORDER BY k))"


def _sp(body, *more):
    return A.sql("epoch_sample", body, *more)


_COR = "(SELECT {split} a.grp, a.subject, a.channel AS src, b.channel AS dst, covar_samp(a.v, b.v) AS cov, coalesce(CASE WHEN isnan(corr(a.v, b.v)) THEN 0 ELSE corr(a.v, b.v) END, 0) AS cor FROM epoch_sample a JOIN epoch_sample b ON a.subject = b.subject AND a.epoch = b.epoch AND a.k = b.k AND a.channel < b.channel GROUP BY ALL)"
SQL = {
    "c01_epochs": _sp("SELECT subject, epoch, count(*) AS n, round(sum(v), 4) AS total FROM epoch_sample GROUP BY ALL"),
    "c01_overlapping_epochs": A.sql("signal", "SELECT subject, channel, CAST(e AS INTEGER) AS epoch, count(*) AS n, round(sum(v), 4) AS total FROM signal, range(0, 3) r(e) WHERE t >= e * 30 AND t < e * 30 + 50 GROUP BY ALL"),
    "c03_band_fan_out": _sp("SELECT band, ord, channel, count(*) AS n, round(avg(v), 6) AS mean FROM epoch_sample, (VALUES ('delta', 0), ('alpha', 1), ('beta', 2)) b(band, ord) GROUP BY ALL"),
    "c07_channel_mixing": A.sql("signal", "SELECT subject, channel, round(avg(x), 6) AS mean, round(max(x), 6) AS top FROM (SELECT subject, channel, v - avg(v) OVER (PARTITION BY subject, t) AS x FROM signal) GROUP BY ALL"),
    "c08_c25_standardised": A.sql("signal", "SELECT subject, channel, t, round((v - avg(v) OVER w) / stddev_pop(v) OVER w, 6) AS v FROM signal WINDOW w AS (PARTITION BY subject, channel)"),
    "c09_spectrum": _sp("SELECT subject, channel, epoch, f, CASE WHEN abs(round(re, 6)) < 1e-6 THEN 0 ELSE round(re, 6) END AS re, CASE WHEN abs(round(im, 6)) < 1e-6 THEN 0 ELSE round(im, 6) END AS im FROM spec", _BASIS, _SPEC),
    "c10_welch": _sp("SELECT subject, channel, f, round(psd, 6) AS psd FROM psd", *_WELCH),
    "c11_band_power": _sp("SELECT subject, channel, round(coalesce(sum((psd + p2) / 2 * (f2 - f)), 0), 6) AS power FROM (SELECT *, lead(psd) OVER w AS p2, lead(f) OVER w AS f2 FROM psd WHERE f BETWEEN 1 AND 3 WINDOW w AS (PARTITION BY subject, channel ORDER BY f)) GROUP BY ALL", *_WELCH),
    "c12_spectral_entropy": _sp("SELECT subject, channel, round(coalesce(sum(-p * ln(p + 1e-12)), 0), 5) AS entropy FROM (SELECT subject, channel, psd / nullif(sum(psd) OVER (PARTITION BY subject, channel), 0) AS p FROM psd WHERE f BETWEEN 1 AND 5) GROUP BY ALL", *_WELCH),
    "c13_hjorth": _sp("SELECT subject, channel, epoch, round(v0, 4) AS activity, round(CASE WHEN v0 > 1e-12 THEN sqrt(v1 / v0) ELSE 0 END, 6) AS mobility, round(CASE WHEN v0 > 1e-12 AND v1 > 1e-12 THEN sqrt(v2 / v1) / sqrt(v1 / v0) ELSE 0 END, 6) AS complexity FROM (SELECT subject, channel, epoch, var_pop(v) AS v0, var_pop(d1) AS v1, var_pop(d2) AS v2 FROM d GROUP BY ALL)", _HJ),
    "c17_band_rms": _sp("SELECT subject, channel, round(sqrt(avg(v * v)), 6) AS rms FROM epoch_sample GROUP BY ALL"),
    "c18_baseline_activation": A.sql("signal", "SELECT subject, channel, round((m - min(m) OVER w) / (max(m) OVER w - min(m) OVER w + 1e-10) * 0.9 + 0.1, 6) AS value FROM (SELECT subject, channel, avg(v) AS m FROM signal GROUP BY ALL) WINDOW w AS (PARTITION BY subject)"),
    "c19_quality": A.sql("signal", "SELECT grp, subject, count(*) AS channels, max(n) AS samples, 0::BIGINT AS n_bad, round(avg(m), 6) AS mean_abs, round(max(hi), 6) AS max_abs, round(min(lo), 6) AS min_abs, count(*) FILTER (WHERE sd < 1e-6) AS flat, count(*) FILTER (WHERE noisy) AS noisy FROM (SELECT *, sd > avg(sd) OVER (PARTITION BY subject) + 3 * stddev_pop(sd) OVER (PARTITION BY subject) AS noisy FROM (SELECT grp, subject, channel, count(*) AS n, avg(abs(v)) AS m, max(abs(v)) AS hi, min(abs(v)) AS lo, stddev_pop(v) AS sd FROM signal GROUP BY ALL)) GROUP BY grp, subject"),
    "c20_split_half": _sp("SELECT subject, split, count(*) AS n, round(sum(v), 4) AS total FROM (SELECT subject, 'full' AS split, v FROM epoch_sample UNION ALL SELECT subject, CASE WHEN epoch % 2 = 0 THEN 'odd' ELSE 'even' END, v FROM epoch_sample) GROUP BY ALL"),
    "c21_time_reversal": _sp(f"SELECT subject, channel, epoch, {N - 1} - k AS k, round(v, 4) AS v FROM epoch_sample"),
    "c22_lag_design": _sp("SELECT subject, channel, count(*) AS n, round(sum(v * l1), 4) AS s1, round(sum(v * l2), 4) AS s2 FROM (SELECT *, lag(v, 1) OVER w AS l1, lag(v, 2) OVER w AS l2 FROM epoch_sample WINDOW w AS (PARTITION BY subject, channel, epoch ORDER BY k)) WHERE k >= 2 GROUP BY ALL"),
    "c24_invalid_subjects": _sp("SELECT grp, subject, reason FROM (SELECT grp, subject, CASE WHEN count(DISTINCT epoch) < 6 THEN 'epochs' WHEN count(DISTINCT channel) < 5 THEN 'channels' WHEN count(DISTINCT k) < 16 THEN 'samples' END AS reason FROM epoch_sample WHERE v > 0 GROUP BY ALL) WHERE reason IS NOT NULL"),
    "c24_invalid_recordings": _sp("SELECT grp, subject, reason FROM (SELECT grp, subject, CASE WHEN count(DISTINCT epoch) < 2 THEN 'epochs' WHEN count(DISTINCT channel) < 2 THEN 'channels' WHEN count(DISTINCT k) < 16 THEN 'samples' WHEN bool_or(subject % 5 = 3 AND epoch = 2 AND k = subject % 20) THEN 'values' END AS reason FROM epoch_sample WHERE (subject % 5 <> 1 OR epoch < subject % 3) AND (subject % 5 <> 2 OR channel = 'view') AND (subject % 5 <> 4 OR k < subject % 20) GROUP BY ALL) WHERE reason IS NOT NULL"),
    "d01_cross_spectrum": _sp("SELECT subject, src, dst, f, round(CASE WHEN abs(re) < 1e-6 THEN 0 ELSE re END, 3) AS re, round(CASE WHEN abs(im) < 1e-6 THEN 0 ELSE im END, 3) AS im FROM (SELECT subject, src, dst, f, sum(re) AS re, sum(im) AS im FROM crs WHERE src < dst GROUP BY ALL)", _BASIS, _SPEC, _CROSS),
    "d02_d08_undirected": _sp(
        "SELECT band, subject, src, dst, round(coherence, 5) AS coherence, round(imcoh, 5) AS imcoh, round(plv, 5) AS plv, round(ciplv, 5) AS ciplv, round(ppc, 5) AS ppc, round(pli, 5) AS pli, round(dwpli2, 5) AS dwpli2 FROM fr JOIN po USING (band, subject, src, dst)",
        _BASIS, _SPEC, _CROSS, _FREQ,
        "fr AS (SELECT band, subject, src, dst, avg(sqrt(cre ** 2 + cim ** 2)) AS coherence, avg(abs(cim)) AS imcoh, avg(sqrt(pre ** 2 + pim ** 2)) AS plv, avg(least(greatest(abs(pim) / sqrt(greatest(1 - pre ** 2, 1e-12)), 0), 1)) AS ciplv, avg(least(greatest((e * (pre ** 2 + pim ** 2) - 1) / greatest(e - 1, 1), 0), 1)) AS ppc FROM freq WHERE src < dst GROUP BY ALL)",
        "po AS (SELECT band, subject, src, dst, abs(sum(sign(im))) / count(*)::DOUBLE AS pli, CASE WHEN sum(abs(im)) ** 2 - sum(im ** 2) > 1e-12 THEN least(greatest((sum(im) ** 2 - sum(im ** 2)) / (sum(abs(im)) ** 2 - sum(im ** 2)), 0), 1) ELSE 0 END AS dwpli2 FROM crs WHERE src < dst GROUP BY ALL)",
    ),
    "d09_d11_directed": _sp(
        "SELECT band, subject, src, dst, round(dpli, 5) AS dpli, round(dwpli, 5) AS dwpli, round(coalesce(psi, 0), 5) AS psi FROM po LEFT JOIN sl USING (band, subject, src, dst)",
        _BASIS, _SPEC, _CROSS, _FREQ,
        "po AS (SELECT band, subject, src, dst, greatest(least(2 * (avg(CAST(im > 0 AS DOUBLE)) - 0.5), 1), 0) AS dpli, CASE WHEN sum(abs(im)) > 1e-12 THEN greatest(sum(im) / sum(abs(im)), 0) ELSE 0 END AS dwpli FROM crs GROUP BY ALL)",
        "sl AS (SELECT band, subject, src, dst, greatest(avg(cre * nim - cim * nre), 0) AS psi FROM (SELECT *, lead(cre) OVER w AS nre, lead(cim) OVER w AS nim FROM freq WINDOW w AS (PARTITION BY band, subject, src, dst ORDER BY f)) WHERE nre IS NOT NULL GROUP BY ALL)",
    ),
    "d17_ordered_pairs": "SELECT a.event_type AS src, b.event_type AS dst FROM (SELECT DISTINCT event_type FROM events) a, (SELECT DISTINCT event_type FROM events) b WHERE a.event_type <> b.event_type",
    "d20_gram": _sp("SELECT a.subject, a.channel AS i, a.l AS li, b.channel AS j, b.l AS lj, round(sum(a.x * b.x), 4) AS s FROM fl a JOIN fl b ON a.subject = b.subject AND a.epoch = b.epoch AND a.k = b.k GROUP BY ALL", "fl AS (SELECT subject, epoch, k, channel, 0 AS l, v AS x FROM epoch_sample WHERE k >= 1 UNION ALL SELECT subject, epoch, k + 1, channel, 1, v FROM epoch_sample WHERE k < 19)"),
    "d31_correlation": _sp("SELECT subject, src, dst, round(cov, 4) AS cov, round(cor, 6) AS cor, round(cor * 0.95, 6) AS shrunk FROM " + _COR.format(split="")),
    "d34_split_half_reliability": _sp(
        "SELECT subject, round(CASE WHEN isnan(corr(ra, rb)) THEN NULL ELSE corr(ra, rb) END, 6) AS spearman, round(CASE WHEN isnan(corr(a, b)) THEN NULL ELSE corr(a, b) END, 6) AS pearson, round(2 * sqrt(sum((a - b) ** 2)) / nullif(sqrt(sum(a ** 2)) + sqrt(sum(b ** 2)), 0), 6) AS error, round(count(*) FILTER (WHERE ta AND tb) / (count(*) FILTER (WHERE ta OR tb))::DOUBLE, 6) AS jaccard FROM rk GROUP BY subject",
        "cr AS (SELECT split, subject, src, dst, round(cor, 9) AS cor FROM " + _COR.format(split="a.epoch % 2 AS split,") + ")",
        "jn AS (SELECT o.subject, o.src, o.dst, o.cor AS a, e.cor AS b FROM cr o JOIN cr e ON o.subject = e.subject AND o.src = e.src AND o.dst = e.dst AND o.split = 0 AND e.split = 1)",
        "rk AS (SELECT *, rank() OVER (PARTITION BY subject ORDER BY a) + (count(*) OVER (PARTITION BY subject, a) - 1) / 2.0 AS ra, rank() OVER (PARTITION BY subject ORDER BY b) + (count(*) OVER (PARTITION BY subject, b) - 1) / 2.0 AS rb, row_number() OVER (PARTITION BY subject ORDER BY a DESC, src, dst) <= greatest(1, ceil(count(*) OVER (PARTITION BY subject) * 0.1)) AS ta, row_number() OVER (PARTITION BY subject ORDER BY b DESC, src, dst) <= greatest(1, ceil(count(*) OVER (PARTITION BY subject) * 0.1)) AS tb FROM jn)",
    ),
}
QUERIES = {k: v for k, v in list(globals().items()) if k[:1] in "cd" and k[1:3].isdigit() and callable(v)}
