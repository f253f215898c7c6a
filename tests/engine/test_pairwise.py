"""Flows with a known direction, mixtures without lag, and plain numpy for the pairwise estimators."""

import numpy as np
import pytest
from corvane.operators import connectivity as C
from corvane.operators import pairwise as P
from corvane.operators import signals as S
from pyspark.sql import functions as F
from test_operators import samples
from test_var import chain  # noqa: F401

EPS = 1e-12


def flows(spark, x, order):
    pairs = P.bivariate(C.gram(samples(spark, x), order), order)
    return {(r["src"], r["dst"], r["band"]): r["gc"] for r in P.spectral_granger(pairs, order, {"all": (0.02, 0.48), "low": (0.05, 0.15)}, 30).collect()}


def test_flow_follows_the_chain_and_turns_round_with_time(spark, chain):  # noqa: F811
    g, back = flows(spark, chain, 2), flows(spark, chain[:, :, ::-1], 2)
    assert len(g) == 12
    for a, b in (("c0", "c1"), ("c1", "c2")):
        assert g[a, b, "all"] > 5 * g[b, a, "all"] and g[a, b, "all"] > 0.1
        assert (g[a, b, "all"] - g[b, a, "all"]) > 0 > (back[a, b, "all"] - back[b, a, "all"])


def test_flow_equals_transfer_matrices(spark, chain):  # noqa: F811
    """The closed form against the spectral matrix H S H* of a plain fit of two channels."""
    order, g = 2, flows(spark, chain, 2)
    x = chain[:, [0, 2]]
    y = np.concatenate([e[:, order:].T for e in x])
    past = np.concatenate([np.concatenate([e[:, order - k : e.shape[1] - k].T for k in range(1, order + 1)], axis=1) for e in x])
    coef = np.linalg.lstsq(past, y, rcond=None)[0]
    left = y - past @ coef
    v = left.T @ left
    for band, lo, hi in (("all", 0.02, 0.48), ("low", 0.05, 0.15)):
        total = np.zeros((2, 2))
        for f in np.linspace(lo, hi, 30):
            a = np.eye(2) - sum(coef[2 * k : 2 * k + 2].T * np.exp(-2j * np.pi * f * (k + 1)) for k in range(order))
            h = np.linalg.inv(a)
            s = (h @ v @ h.conj().T).real
            for src, dst in ((0, 1), (1, 0)):
                own = (v[src, src] - v[src, dst] ** 2 / v[dst, dst]) * abs(h[dst, src]) ** 2
                total[src, dst] += np.log(s[dst, dst] / (s[dst, dst] - own)) / 30
        assert (g["c0", "c2", band], g["c2", "c0", band]) == pytest.approx((total[0, 1], total[1, 0]), rel=1e-6)


def test_flow_of_constant_channels_is_none(spark):
    x = np.zeros((2, 2, 40))
    x[:, 0] = np.random.default_rng(1).normal(size=(2, 40))
    assert set(flows(spark, x, 1).values()) == {0.0}


def hilbert(x):
    n = x.shape[-1]
    h = np.zeros(n)
    h[0], h[1 : (n + 1) // 2] = 1, 2
    if n % 2 == 0:
        h[n // 2] = 1
    return np.fft.ifft(np.fft.fft(x) * h)


@pytest.mark.parametrize("n", [20, 21])
def test_orthogonalised_envelopes(spark, n):
    rng = np.random.default_rng(n)
    x = rng.normal(size=(8, 4, n))
    x[:, 3] = 2.5 * x[:, 0]  # a mixture without lag
    z = hilbert(x)
    parts = P.analytic(samples(spark, x), n)
    got = {(r["channel"], r["epoch"], r["k"]): complex(r["re"], r["im"]) for r in parts.collect()}
    assert all(got[f"c{c}", e, k] == pytest.approx(z[e, c, k], abs=1e-9) for e in range(8) for c in range(4) for k in range(n))
    w = {(r["src"], r["dst"]): r["w"] for r in P.orthogonalised_envelopes(parts).collect()}
    assert len(w) == 6 and w["c0", "c3"] == pytest.approx(0, abs=1e-9)
    for a, b in ((0, 1), (1, 2), (0, 2)):
        both = []
        for i, j in ((a, b), (b, a)):
            left, right = z[:, i].ravel(), z[:, j].ravel()
            across = np.abs((right * left.conj()).imag) / np.abs(left)
            both.append(abs(np.corrcoef(np.log(np.abs(left) + EPS), np.log(across + EPS))[0, 1]))
        assert w[f"c{a}", f"c{b}"] == pytest.approx(np.mean(both), abs=1e-6)


def test_multitaper_measures_and_slope(spark):
    rng = np.random.default_rng(3)
    n, epochs = 32, 12
    source = rng.normal(size=(epochs, n + 2))
    x = np.stack([source[:, 2:], source[:, :-2], rng.normal(size=(epochs, n))], axis=1) + 0.1 * rng.normal(size=(epochs, 3, n))  # c0 leads c1 by two samples
    tapers = np.array(P.sine_tapers(n, 3))
    assert tapers @ tapers.T == pytest.approx(np.eye(3), abs=1e-12)
    spectra = P.multitaper(samples(spark, x), tapers.tolist(), 0.1, 0.4)
    cross = P.taper_cross(spectra).withColumn("band", F.lit("b"))
    bins = [j for j in range(1, n // 2 + 1) if 0.1 <= j / n <= 0.4]
    z = np.fft.fft((x - x.mean(axis=2, keepdims=True))[:, :, None] * tapers, axis=3)[:, :, :, bins]
    got = {(r["src"], r["dst"]): r for r in P.taper_measures(cross).collect()}
    for a, b in ((0, 1), (0, 2), (1, 2)):
        s = (z[:, a] * z[:, b].conj()).mean(axis=1)
        pa, pb = (np.abs(z[:, a]) ** 2).mean(axis=1), (np.abs(z[:, b]) ** 2).mean(axis=1)
        c = s.sum(axis=0) / np.sqrt(pa.sum(axis=0) * pb.sum(axis=0))
        u = (s / np.abs(s)).mean(axis=0)
        im = s.imag
        w = ((im.sum(axis=0)) ** 2 - (im**2).sum(axis=0)) / (np.abs(im).sum(axis=0) ** 2 - (im**2).sum(axis=0))
        want = [np.abs(c).mean(), np.abs(c.imag).mean(), np.abs(u).mean(), np.clip(np.abs(u.imag) / np.sqrt(1 - u.real**2), 0, 1).mean(), max(w.mean(), 0)]
        assert [got[f"c{a}", f"c{b}"][k] for k in ("coherence", "imcoh", "plv", "ciplv", "dwpli2")] == pytest.approx(want, abs=1e-7)
    slope = {(r["src"], r["dst"]): r["psi"] for r in P.split_slope(cross).collect()}
    assert len(slope) == 6 and all(min(slope[f"c{a}", f"c{b}"], slope[f"c{b}", f"c{a}"]) == 0 for a, b in ((0, 1), (0, 2), (1, 2)))
    assert slope["c0", "c1"] > 10 * slope["c1", "c0"] and slope["c0", "c1"] > 0.5


def test_reversed_epochs_are_reversed(spark):
    x = np.arange(12.0).reshape(1, 1, 12)
    got = {r["k"]: r["v"] for r in S.reversed_time(samples(spark, x), 12).collect()}
    assert [got[k] for k in range(12)] == list(range(11, -1, -1))
