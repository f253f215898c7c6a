"""Planted chains and closed forms for autoregression, filters and matrix logarithms."""

import numpy as np
import pytest
from corvane.operators import connectivity as C
from corvane.operators import signals as S
from corvane.operators import var as V
from test_operators import samples


@pytest.fixture(scope="module")
def chain():
    rng = np.random.default_rng(17)
    x = np.zeros((6, 3, 160))
    for e in range(6):
        n = rng.normal(size=(3, 160))
        for t in range(1, 160):
            x[e, :, t] = 0.4 * x[e, :, t - 1] + n[:, t]
            x[e, 1, t] += 0.7 * x[e, 0, t - 1]
            x[e, 2, t] += 0.7 * x[e, 1, t - 1]
    return x


def test_chain_is_recovered(spark, chain):
    g = C.gram(samples(spark, chain), 2).cache()
    a = {(r["lag"], r["source"], r["target"]): r["a"] for r in V.coefficients(g, 2).collect()}
    assert a[1, "c0", "c1"] == pytest.approx(0.7, abs=0.1) and abs(a[1, "c1", "c0"]) < 0.1 and a[1, "c1", "c2"] == pytest.approx(0.7, abs=0.1)
    d = V.diagnostics(g, 2).first()
    assert d["stable"] and d["radius"] < 1
    x = chain[:, :, 2:].transpose(1, 0, 2).reshape(3, -1).T
    past = np.concatenate([chain[:, :, 1:-1].transpose(1, 0, 2).reshape(3, -1), chain[:, :, :-2].transpose(1, 0, 2).reshape(3, -1)]).T
    assert d["mse"] == pytest.approx(((x - past @ np.linalg.lstsq(past, x, rcond=None)[0]) ** 2).sum(), rel=1e-6)
    w = {(r["src"], r["dst"]): r["w"] for r in V.conditional_wald(g, 2, 10.0, 948).collect()}
    assert w["c0", "c1"] > 3 * w["c1", "c0"] and w["c1", "c2"] > 3 * w["c2", "c1"]
    f = {(r["src"], r["dst"]): r for r in V.spectral_directed(g, 2, {"all": (0.05, 0.4)}).collect()}
    assert f["c0", "c1"]["pdc"] > 5 * f["c1", "c0"]["pdc"] and f["c0", "c2"]["dtf"] > 5 * f["c2", "c0"]["dtf"]


def test_band_pass_keeps_the_band_and_its_phase(spark):
    t = np.arange(400) / 100
    inside, outside = np.sin(2 * np.pi * 10 * t), np.sin(2 * np.pi * 35 * t)
    x = (inside + outside)[None, None, :]
    y = np.array(V.band_pass(S.packed(samples(spark, x)), 8, 13, 100).first()["x"])
    assert np.abs(y - inside)[100:300].max() < 0.02
    b, a = V.butterworth(4, 0.16, 0.26)
    w = np.exp(-1j * np.pi * np.array([0.16, 0.26, 0.2039]))
    gain = np.abs(np.polyval(b[::-1], w) / np.polyval(a[::-1], w))
    assert gain[:2] == pytest.approx([np.sqrt(0.5)] * 2, abs=1e-6) and gain[2] == pytest.approx(1, abs=1e-3)
    with pytest.raises(ValueError):
        V.band_pass(S.packed(samples(spark, x)), 8, 60, 100)


def test_envelopes_and_resampling(spark):
    t = np.arange(256) / 64
    amp = 1 + 0.5 * np.sin(2 * np.pi * 0.5 * t)
    x = np.stack([amp * np.sin(2 * np.pi * 8 * t), amp * np.sin(2 * np.pi * 8 * t + 1.0), np.sin(2 * np.pi * 8 * t + 0.3)])[None]
    p = S.packed(samples(spark, x))
    w = {(r["src"], r["dst"]): r["w"] for r in V.envelope_correlation(p).collect()}
    assert w["c0", "c1"] > 0.95
    y = V.resample(p.filter("channel = 'c2'"), 1, 2).first()["x"]
    assert len(y) == 128 and np.abs(np.array(y) - np.sin(2 * np.pi * 8 * t[::2] + 0.3))[20:100].max() < 0.02


def test_matrix_logarithm(spark):
    m = np.array([[2.0, 0.5], [0.5, 1.0]])
    rows = spark.createDataFrame([("Healthy", 1, i, j, float(m[i, j])) for i in range(2) for j in range(i, 2)], "grp string, subject int, src int, dst int, w double")
    got = {(r["src"], r["dst"]): r["w"] for r in V.log_euclidean(rows).collect()}
    val, vec = np.linalg.eigh(m)
    g = (vec * np.log(val)) @ vec.T
    assert got == pytest.approx({(0, 0): g[0, 0], (0, 1): g[0, 1] * np.sqrt(2), (1, 1): g[1, 1]})


def test_best_candidate_is_stable_then_close_then_simple(spark):
    rows = [("Healthy", 1, 1, 1.0, False, 0.1), ("Healthy", 1, 2, 1.0, True, 0.5), ("Healthy", 1, 3, 1.0, True, 0.5), ("Healthy", 1, 2, 10.0, True, 0.5)]
    best = V.select_order(spark.createDataFrame(rows, "grp string, subject int, ord int, ridge double, stable boolean, mse double")).first()
    assert (best["ord"], best["ridge"]) == (2, 10.0)
