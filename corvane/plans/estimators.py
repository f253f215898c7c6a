"""Queries of spectral Granger and its reversal, orthogonalised envelopes and multitaper estimators."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from corvane.functions.stages import stage_table
from corvane.operators import pairwise as P
from corvane.operators import recordings as X
from corvane.plans import spectral
from corvane.plans.network import r
from corvane.plans.spectral import N, _sp
from corvane.sources import adapters as A

TAPERS, RIDGE, POINTS = 3, 1.0, 24
BANDS = {"delta": (0.05, 0.15), "alpha": (0.2, 0.3), "beta": (0.35, 0.5)}


def _granger(spark, sf, order: int, back: bool = False) -> DataFrame:
    """(SUBJECT, src, dst, band, gc), and `reversed` of reversed epochs."""
    kernel = X.granger_rows(order, RIDGE, BANDS, POINTS, back)
    return X.apply(A.recordings(spark, sf), A.BINS, N, kernel, ["src", "dst", "band"], ["gc", "reversed"] if back else ["gc"])


def d15_spectral_granger(spark, sf):
    return _granger(spark, sf, 1).select("subject", "src", "dst", "band", r("gc", 4))


def d16_reversed_granger(spark, sf):
    """The same of reversed epochs, beside the flow of the epochs as they are: a true flow turns round."""
    return _granger(spark, sf, 1, True).select("subject", "src", "dst", "band", r("gc", 4), r("reversed", 4))


def d15_granger_of_three_lags(spark, sf):
    return _granger(spark, sf, 3).select("subject", "src", "dst", "band", r("gc", 3))


def d19_orthogonalised_envelopes(spark, sf):
    parts = stage_table(P.analytic(spectral.samples(spark, sf), N), "analytic")
    return P.orthogonalised_envelopes(parts).select("subject", "src", "dst", r("w", 4))


def _tapered(spark, sf, rows, values: list[str]) -> DataFrame:
    kernel = rows(np.array(P.sine_tapers(N, TAPERS)), spectral.BINS, spectral.BANDS)
    return X.apply(A.recordings(spark, sf), A.BINS, N, kernel, ["src", "dst", "band"], values, TAPERS)


def d12_d14_multitaper(spark, sf):
    names = ["coherence", "imcoh", "plv", "ciplv", "dwpli2"]
    return _tapered(spark, sf, X.taper_rows, names).select("subject", "src", "dst", "band", *[r(c, 4) for c in names])


def d13_multitaper_slope(spark, sf):
    return _tapered(spark, sf, X.slope_rows, ["psi"]).select("subject", "src", "dst", "band", r("psi", 4))


def _granger_sql(name: str, reverse: bool) -> list[str]:
    """Common table expressions that end in `name` (subject, src, dst, band, gc): an order-1 fit of each pair by two normal equations."""
    order = "k DESC" if reverse else "k"
    bands = ", ".join(f"('{b}', {lo}, {hi})" for b, (lo, hi) in BANDS.items())
    flow = lambda o_re, o_im, c_re, c_im, vf, vt: f"CASE WHEN {vf} <= 1e-12 OR {vt} <= 1e-12 THEN 0 ELSE greatest(ln(greatest(({o_re} ** 2 + {o_im} ** 2) * {vt} - 2 * ({o_re} * {c_re} + {o_im} * {c_im}) * vab + ({c_re} ** 2 + {c_im} ** 2) * {vf}, 1e-12) / greatest({vt} * (({o_re} - vab / {vt} * {c_re}) ** 2 + ({o_im} - vab / {vt} * {c_im}) ** 2), 1e-12)), 0) END"
    return [
        f"{name}_c AS MATERIALIZED (SELECT subject, channel, epoch, k, v, lag(v) OVER (PARTITION BY subject, channel, epoch ORDER BY {order}) AS p FROM (SELECT subject, channel, epoch, k, v - avg(v) OVER (PARTITION BY subject, channel) AS v FROM epoch_sample))",
        f"{name}_s AS (SELECT a.subject, a.channel AS src, b.channel AS dst, sum(a.v * a.v) AS yaa, sum(a.v * b.v) AS yab, sum(b.v * b.v) AS ybb, sum(a.p * a.p) AS xaa, sum(a.p * b.p) AS xab, sum(b.p * b.p) AS xbb, sum(a.p * a.v) AS xaa_, sum(b.p * a.v) AS xba_, sum(a.p * b.v) AS xab_, sum(b.p * b.v) AS xbb_ FROM {name}_c a JOIN {name}_c b ON a.subject = b.subject AND a.epoch = b.epoch AND a.k = b.k AND a.channel < b.channel WHERE a.p IS NOT NULL GROUP BY ALL)",
        f"{name}_f AS (SELECT *, ((xbb + {RIDGE}) * xaa_ - xab * xba_) / det AS caa, ((xaa + {RIDGE}) * xba_ - xab * xaa_) / det AS cab, ((xbb + {RIDGE}) * xab_ - xab * xbb_) / det AS cba, ((xaa + {RIDGE}) * xbb_ - xab * xab_) / det AS cbb FROM (SELECT *, (xaa + {RIDGE}) * (xbb + {RIDGE}) - xab * xab AS det FROM {name}_s))",
        f"{name}_v AS (SELECT subject, src, dst, caa, cab, cba, cbb, yaa - 2 * (caa * xaa_ + cab * xba_) + caa * caa * xaa + 2 * caa * cab * xab + cab * cab * xbb AS va, yab - cba * xaa_ - cbb * xba_ - caa * xab_ - cab * xbb_ + caa * cba * xaa + (caa * cbb + cab * cba) * xab + cab * cbb * xbb AS vab, ybb - 2 * (cba * xab_ + cbb * xbb_) + cba * cba * xaa + 2 * cba * cbb * xab + cbb * cbb * xbb AS vb FROM {name}_f)",
        f"{name}_t AS (SELECT subject, src, dst, band, va, vab, vb, 1 - caa * cos(w) AS aar, caa * sin(w) AS aai, -cab * cos(w) AS abr, cab * sin(w) AS abi, -cba * cos(w) AS bar, cba * sin(w) AS bai, 1 - cbb * cos(w) AS bbr, cbb * sin(w) AS bbi FROM {name}_v, (SELECT band, 2 * pi() * (lo + (hi - lo) * i / {POINTS - 1}.0) AS w FROM (VALUES {bands}) b(band, lo, hi), range({POINTS}) p(i)))",
        f"{name} AS (SELECT subject, src, dst, band, avg({flow('aar', 'aai', 'bar', 'bai', 'va', 'vb')}) AS gc FROM {name}_t GROUP BY ALL UNION ALL SELECT subject, dst, src, band, avg({flow('bbr', 'bbi', 'abr', 'abi', 'vb', 'va')}) FROM {name}_t GROUP BY ALL)",
    ]


_PARTS = f"an AS MATERIALIZED (SELECT subject, channel, epoch, b.k, sum(CASE WHEN e.k = b.k THEN v ELSE 0 END) AS re, sum(v * CASE WHEN (b.k - e.k) % 2 = 0 THEN 0 ELSE 2 / {N}.0 / tan(pi() * (b.k - e.k) / {N}.0) END) AS im FROM epoch_sample e, range({N}) b(k) GROUP BY ALL)"
_TAPERED = [
    f"tb AS (SELECT t::INTEGER AS taper, k::INTEGER AS k, f::INTEGER AS f, h * cos(2 * pi() * f * k / {N}.0) AS c, -h * sin(2 * pi() * f * k / {N}.0) AS s FROM (SELECT t, k, sqrt(2 / {N + 1}.0) * sin(pi() * t * (k + 1) / {N + 1}.0) AS h FROM range(1, {TAPERS + 1}) a(t), range({N}) b(k)), range(1, {N // 2 + 1}) c(f))",
    "ts AS MATERIALIZED (SELECT subject, channel, epoch, taper, f, sum(v * c) AS re, sum(v * s) AS im FROM (SELECT subject, channel, epoch, k, v - avg(v) OVER (PARTITION BY subject, channel, epoch) AS v FROM epoch_sample) JOIN tb USING (k) GROUP BY ALL)",
    "tx AS MATERIALIZED (SELECT * REPLACE (CASE WHEN abs(im) < 1e-9 THEN 0 ELSE im END AS im) FROM (SELECT a.subject, a.channel AS src, b.channel AS dst, a.epoch, a.f, CASE WHEN a.f <= 3 THEN 'delta' WHEN a.f <= 6 THEN 'alpha' ELSE 'beta' END AS band, avg(a.re * b.re + a.im * b.im) AS re, avg(a.im * b.re - a.re * b.im) AS im, avg(a.re ** 2 + a.im ** 2) AS pa, avg(b.re ** 2 + b.im ** 2) AS pb FROM ts a JOIN ts b ON a.subject = b.subject AND a.epoch = b.epoch AND a.taper = b.taper AND a.f = b.f AND a.channel < b.channel GROUP BY ALL))",
    "tf AS MATERIALIZED (SELECT *, sre / den AS cre, sim / den AS cim FROM (SELECT subject, src, dst, band, f, sum(re) AS sre, sum(im) AS sim, sqrt(greatest(sum(pa), 1e-12) * greatest(sum(pb), 1e-12)) AS den, avg(CASE WHEN sqrt(re ** 2 + im ** 2) > 1e-9 THEN re / sqrt(re ** 2 + im ** 2) ELSE 0 END) AS pre, avg(CASE WHEN sqrt(re ** 2 + im ** 2) > 1e-9 THEN im / sqrt(re ** 2 + im ** 2) ELSE 0 END) AS pim, CASE WHEN sum(abs(im)) ** 2 - sum(im ** 2) > 1e-12 THEN (sum(im) ** 2 - sum(im ** 2)) / (sum(abs(im)) ** 2 - sum(im ** 2)) ELSE 0 END AS wp FROM tx GROUP BY ALL))",
]
SQL = {
    "d15_spectral_granger": _sp("SELECT subject, src, dst, band, round(gc, 4) AS gc FROM g", *_granger_sql("g", False)),
    "d16_reversed_granger": _sp("SELECT subject, src, dst, band, round(g.gc, 4) AS gc, round(h.gc, 4) AS reversed FROM g JOIN h USING (subject, src, dst, band)", *_granger_sql("g", False), *_granger_sql("h", True)),
    "d19_orthogonalised_envelopes": _sp(
        "SELECT subject, least(src, dst) AS src, greatest(src, dst) AS dst, round(avg(w), 4) AS w FROM (SELECT subject, src, dst, coalesce(abs(CASE WHEN isnan(corr(own, other)) THEN 0 ELSE corr(own, other) END), 0) AS w FROM lg GROUP BY ALL) GROUP BY ALL",
        _PARTS,
        "lg AS (SELECT subject, src, dst, ln(sa + 1e-12) AS own, ln(CASE WHEN sa > 1e-9 AND x > 1e-9 * sa THEN x / sa ELSE 0 END + 1e-12) AS other FROM (SELECT a.subject, a.channel AS src, b.channel AS dst, sqrt(a.re ** 2 + a.im ** 2) AS sa, abs(b.im * a.re - b.re * a.im) AS x FROM an a JOIN an b ON a.subject = b.subject AND a.epoch = b.epoch AND a.k = b.k AND a.channel <> b.channel))",
    ),
    "d12_d14_multitaper": _sp("SELECT subject, src, dst, band, round(avg(sqrt(cre ** 2 + cim ** 2)), 4) AS coherence, round(avg(abs(cim)), 4) AS imcoh, round(avg(sqrt(pre ** 2 + pim ** 2)), 4) AS plv, round(avg(least(greatest(abs(pim) / sqrt(greatest(1 - pre ** 2, 1e-12)), 0), 1)), 4) AS ciplv, round(greatest(avg(wp), 0), 4) AS dwpli2 FROM tf GROUP BY ALL", *_TAPERED),
    "d13_multitaper_slope": _sp("SELECT subject, CASE WHEN d THEN src ELSE dst END AS src, CASE WHEN d THEN dst ELSE src END AS dst, band, round(CASE WHEN d THEN greatest(p, 0) ELSE greatest(-p, 0) END, 4) AS psi FROM (SELECT subject, src, dst, band, coalesce(sum(cre * nim - cim * nre), 0) AS p FROM (SELECT *, lead(cre) OVER w AS nre, lead(cim) OVER w AS nim FROM tf WINDOW w AS (PARTITION BY subject, src, dst, band ORDER BY f)) GROUP BY ALL), (VALUES (true), (false)) v(d)", *_TAPERED),
}
QUERIES = {k: v for k, v in list(globals().items()) if k[:1] == "d" and k[1:3].isdigit() and callable(v)}
