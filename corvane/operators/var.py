"""Vector autoregression from Gram sums, its spectral connectivity, and kernels over packed epochs.

`connectivity.gram` makes the only pass over samples.  What is left for one subject is a matrix of (channels * lags) squared
numbers, bounded by the channel count, and is finished in a function of one row a subject.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SUBJECT = ["grp", "subject"]


#: Types of the columns that `by_subject` gives.
_ARROW = {"string": pa.string(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_(), "array<double>": pa.list_(pa.float64())}


def by_subject(gram: DataFrame, kernel: Callable[[list[str], np.ndarray], list[tuple]], order: int, fields: str) -> DataFrame:
    """(SUBJECT, fields): the rows of kernel(channels, Gram matrix [lag * channel, lag * channel]) of each subject.

    A subject's sums are one row and a batch of subjects one call: a data frame for each of them costs more than its algebra.
    """
    kinds, columns = dict(gram.dtypes), [x.split() for x in fields.split(", ")]
    rows = gram.groupBy(*SUBJECT).agg(F.collect_list(F.struct("i", "li", "j", "lj", "s")).alias("_g"))
    packed = rows.select(*SUBJECT, *[F.col(f"_g.{c}").alias(c) for c in ("i", "li", "j", "lj", "s")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(at, 256) for b in batches for at in range(0, b.num_rows, 256)):
            *key, i, li, j, lj, s = batch.columns
            at = np.concatenate([[0], np.cumsum(pc.list_value_length(i).to_numpy(zero_copy_only=False))]).astype(int)
            coded = pa.concat_arrays([i.flatten(), j.flatten()]).dictionary_encode()
            words = sorted(coded.dictionary.to_pylist())
            place = {c: k for k, c in enumerate(words)}
            codes = np.array([place[c] for c in coded.dictionary.to_pylist()], int)[coded.indices.to_numpy(zero_copy_only=False)].reshape(2, -1)
            li, lj, s = (x.flatten().to_numpy(zero_copy_only=False) for x in (li, lj, s))
            out = []
            for k in range(batch.num_rows):
                own = slice(at[k], at[k + 1])
                names, p = np.unique(codes[0, own], return_inverse=True)
                n = len(names)
                full = np.zeros(((order + 1) * n, (order + 1) * n))
                full[li[own] * n + p, lj[own] * n + np.searchsorted(names, codes[1, own])] = s[own]
                out.append(kernel([words[c] for c in names], full))
            row = pa.array(np.repeat(np.arange(len(out)), [len(o) for o in out]))
            flat = [pa.array([r[c] for o in out for r in o], _ARROW[kind]) for c, (_, kind) in enumerate(columns)]
            yield pa.RecordBatch.from_arrays([*[x.take(row) for x in key], *flat], names=[*SUBJECT, *[name for name, _ in columns]])

    return packed.mapInArrow(run, ", ".join(f"{k} {kinds[k]}" for k in SUBJECT) + f", {fields}")


def _fit(full: np.ndarray, n: int, ridge: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(X'X + ridge, coefficients [lag * channel, target], Y'Y)."""
    xx = full[n:, n:] + ridge * np.eye(len(full) - n)
    return xx, np.linalg.solve(xx, full[n:, :n]), full[:n, :n]


def lag_matrices(coef: np.ndarray, n: int) -> np.ndarray:
    """[lag, target, source] of coefficients whose rows are lag-major predictors."""
    return coef.reshape(-1, n, n).transpose(0, 2, 1)


def companion_radius(a: np.ndarray) -> float:
    """Largest |eigenvalue| of the companion matrix; below 1 the process is stable."""
    p, n, _ = a.shape
    c = np.zeros((p * n, p * n))
    c[:n] = np.concatenate(list(a), axis=1)
    c[n:, : (p - 1) * n] = np.eye((p - 1) * n)
    return float(np.abs(np.linalg.eigvals(c)).max())


def coefficients(gram: DataFrame, order: int, ridge: float = 0.0) -> DataFrame:
    """(SUBJECT, lag, target, source, a)."""

    def kernel(names: list[str], full: np.ndarray) -> list[tuple]:
        a = lag_matrices(_fit(full, len(names), ridge)[1], len(names))
        return [(k + 1, names[t], names[s], a[k, t, s]) for k in range(order) for t in range(len(names)) for s in range(len(names))]

    return by_subject(gram, kernel, order, "lag int, target string, source string, a double")


def residuals(samples: DataFrame, coef: DataFrame) -> DataFrame:
    """(SUBJECT, epoch, channel, k, e): v minus the fit by all channels one k before, for (SUBJECT, lag 1, target, source, a).

    A subject's coefficients are one row, joined by subject; channels of an instant are a row too, so nothing is multiplied
    by targets and shuffled.  The join is a sorted one, as small Parquet files of samples are no small tables in memory.
    """
    at = samples.repartition(*SUBJECT).groupBy(*SUBJECT, "epoch", "k").agg(F.collect_list(F.struct("channel", "v")).alias("_now"))
    w = Window.partitionBy(*SUBJECT, "epoch").orderBy("k")
    before = F.when(F.lag("k").over(w) == F.col("k") - 1, F.lag("_now").over(w))
    past = at.withColumn("_before", before).filter("_before IS NOT NULL").withColumn("_past", F.map_from_entries("_before"))
    each = coef.groupBy(*SUBJECT, "target").agg(F.collect_list(F.struct("source", "a")).alias("_a")).groupBy(*SUBJECT).agg(F.map_from_entries(F.collect_list(F.struct("target", "_a"))).alias("_coef"))
    now = past.join(each.hint("merge"), SUBJECT).select(*SUBJECT, "epoch", "k", "_past", "_coef", F.explode("_now").alias("_x"))
    known = F.filter(F.try_element_at("_coef", F.col("_x.channel")), lambda z: F.map_contains_key("_past", z["source"]))
    fit = F.aggregate(known, F.lit(0.0), lambda s, z: s + z["a"] * F.try_element_at("_past", z["source"]))
    return now.select(*SUBJECT, "epoch", F.col("_x.channel").alias("channel"), "k", (F.col("_x.v") - F.when(F.size(known) > 0, fit)).alias("e")).filter("e IS NOT NULL")


def diagnostics(gram: DataFrame, order: int, ridge: float = 0.0) -> DataFrame:
    """(SUBJECT, radius, stable, condition, mse): stability, condition of the normal matrix and the sum of squared residuals over channels."""

    def kernel(names: list[str], full: np.ndarray) -> list[tuple]:
        xx, coef, yy = _fit(full, len(names), ridge)
        radius = companion_radius(lag_matrices(coef, len(names)))
        plain = xx - ridge * np.eye(len(xx))
        left = float(np.trace(yy - 2 * coef.T @ xx @ coef + coef.T @ plain @ coef))
        return [(radius, radius < 1, float(np.linalg.cond(xx)), left)]

    return by_subject(gram, kernel, order, "radius double, stable boolean, condition double, mse double")


def conditional_wald(gram: DataFrame, order: int, ridge: float = 10.0, rows: int = 1) -> DataFrame:
    """(SUBJECT, src, dst, w): log1p of the block Wald statistic over the order, for source's lags in target's equation given all others."""

    def kernel(names: list[str], full: np.ndarray) -> list[tuple]:
        xx, coef, yy = _fit(full, len(names), ridge)
        n, inverse = len(names), np.linalg.pinv(xx)
        left = np.maximum(np.diag(yy - coef.T @ (xx - ridge * np.eye(len(xx))) @ coef), 1e-12) / max(rows - len(xx), 1)
        out = []
        for s in range(n):
            at = np.arange(order) * n + s
            block = np.linalg.pinv(inverse[np.ix_(at, at)])
            for t in range(n):
                if s != t:
                    b = coef[at, t]
                    out.append((names[s], names[t], math.log1p(max(float(b @ block @ b) / left[t], 0.0) / order)))
        return out

    return by_subject(gram, kernel, order, "src string, dst string, w double")


def spectral_directed(gram: DataFrame, order: int, bands: dict[str, tuple[float, float]], ridge: float = 0.0, points: int = 24) -> DataFrame:
    """(SUBJECT, band, src, dst, pdc, dtf): mean over `points` frequencies (cycles per sample) of partial directed coherence and directed transfer."""

    def kernel(names: list[str], full: np.ndarray) -> list[tuple]:
        n, out = len(names), []
        a = lag_matrices(_fit(full, n, ridge)[1], n)
        for band, (low, high) in bands.items():
            pdc, dtf = np.zeros((n, n)), np.zeros((n, n))
            for f in np.linspace(low, high, points):
                z = np.eye(n) - sum(a[k] * np.exp(-2j * np.pi * f * (k + 1)) for k in range(order))
                pdc += np.abs(z) / np.maximum(np.sqrt((np.abs(z) ** 2).sum(axis=0, keepdims=True)), 1e-12) / points
                h = np.abs(np.linalg.inv(z))
                dtf += h / np.maximum(np.sqrt((h**2).sum(axis=1, keepdims=True)), 1e-12) / points
            out += [(band, names[s], names[t], pdc[t, s], dtf[t, s]) for s in range(n) for t in range(n) if s != t]
        return out

    return by_subject(gram, kernel, order, "band string, src string, dst string, pdc double, dtf double")


def select_order(errors: DataFrame) -> DataFrame:
    """(SUBJECT, ord, ridge) of the best candidate rows (SUBJECT, ord, ridge, stable, mse): stable first, least error, small order, large ridge."""
    best = F.min(F.struct((~F.col("stable")).alias("u"), F.round("mse", 12).alias("m"), F.col("ord").alias("o"), (-F.col("ridge")).alias("r")))
    return errors.groupBy(*SUBJECT).agg(best.alias("b")).select(*SUBJECT, F.col("b.o").alias("ord"), (-F.col("b.r")).alias("ridge"))


def log_euclidean(edges: DataFrame, floor: float = 1e-7) -> DataFrame:
    """(SUBJECT, src, dst, w), src <= dst: V log(max(lambda, floor)) V' of the symmetrised matrix (SUBJECT, src, dst, w); off-diagonal times sqrt(2)."""
    kinds = dict(edges.dtypes)

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        names = sorted(set(frame["src"]) | set(frame["dst"]))
        at = {c: k for k, c in enumerate(names)}
        m = np.zeros((len(names), len(names)))
        i, j = frame["src"].map(at).to_numpy(), frame["dst"].map(at).to_numpy()
        m[i, j] = frame["w"]
        m = np.where(m == 0, m.T, m)
        val, vec = np.linalg.eigh((m + m.T) / 2)
        g = (vec * np.log(np.maximum(val, floor))) @ vec.T
        a, b = np.triu_indices(len(names))
        w = g[a, b] * np.where(a == b, 1.0, math.sqrt(2))
        return pd.DataFrame({"src": [names[k] for k in a], "dst": [names[k] for k in b], "w": w}).assign(**{k: frame[k].iloc[0] for k in SUBJECT})[[*SUBJECT, "src", "dst", "w"]]

    return edges.groupBy(*SUBJECT).applyInPandas(run, ", ".join(f"{k} {kinds[k]}" for k in SUBJECT) + f", src {kinds['src']}, dst {kinds['dst']}, w double")


# ---------------------------------------------------------------- kernels over packed epochs


def butterworth(order: int, low: float, high: float) -> tuple[np.ndarray, np.ndarray]:
    """(b, a) of a digital band-pass; low and high are fractions of the Nyquist frequency (bilinear transform of the analogue prototype)."""
    w1, w2 = 4 * math.tan(math.pi * low / 2), 4 * math.tan(math.pi * high / 2)
    width, centre = w2 - w1, math.sqrt(w1 * w2)
    poles = np.exp(1j * np.pi * (2 * np.arange(1, order + 1) + order - 1) / (2 * order)) * width / 2
    root = np.sqrt(poles**2 - centre**2 + 0j)
    p = np.concatenate([poles + root, poles - root])
    zp = (4 + p) / (4 - p)
    gain = (width**order * 4.0**order / np.prod(4 - p)).real
    return gain * np.poly(np.concatenate([np.ones(order), -np.ones(order)])).real, np.poly(zp).real


def _filter(b: np.ndarray, a: np.ndarray, x: np.ndarray, state: np.ndarray) -> np.ndarray:
    z, out = state.copy(), np.empty(x.shape)
    for k in range(x.shape[-1]):
        v = x[..., k]
        y = b[0] * v + z[..., 0]
        z[..., :-1] = z[..., 1:] + b[1:-1] * v[..., None] - a[1:-1] * y[..., None]
        z[..., -1] = b[-1] * v - a[-1] * y
        out[..., k] = y
    return out


def zero_phase(b: np.ndarray, a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Rows of x forward and backward, with odd padding of three times the filter length and the steady state as start."""
    pad = min(3 * max(len(a), len(b)), x.shape[-1] - 1)
    m = len(a) - 1
    companion = np.zeros((m, m))
    companion[:, 0], companion[:-1, 1:] = -a[1:], np.eye(m - 1)
    start = np.linalg.solve(np.eye(m) - companion, b[1:] - a[1:] * b[0])
    y = np.concatenate([2 * x[..., :1] - x[..., pad:0:-1], x, 2 * x[..., -1:] - x[..., -2 : -pad - 2 : -1]], axis=-1) if pad > 0 else x
    y = _filter(b, a, y, start * y[..., :1])[..., ::-1]
    y = _filter(b, a, y, start * y[..., :1])[..., ::-1]
    return y[..., pad : y.shape[-1] - pad] if pad > 0 else y


def _arrow(kernel, nested: bool = False):
    """A column function of arrays, or of arrays of them; the kernel takes those of one length in a batch as rows of a matrix."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            rows = [np.asarray(x, float) for x in ((x for own in s for x in own) if nested else s)]
            out = np.empty(len(rows), object)
            sizes = np.array([len(x) for x in rows])
            for n in np.unique(sizes):
                own = np.flatnonzero(sizes == n)
                for i, y in zip(own, kernel(np.stack([rows[i] for i in own])), strict=True):
                    out[i] = y
            if nested:
                ends = np.cumsum([len(own) for own in s])
                out = [out[end - len(own) : end].tolist() for own, end in zip(s, ends, strict=True)]
            yield pd.Series(out, dtype=object)

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(run, "array<array<double>>" if nested else "array<double>")


def band_pass(epochs: DataFrame, low: float, high: float, fs: float, order: int = 4) -> DataFrame:
    """Packed epochs filtered without phase shift between low and high Hz."""
    if not 0 < low < high < fs / 2:
        raise ValueError("the band must lie below the Nyquist frequency")
    b, a = butterworth(order, 2 * low / fs, 2 * high / fs)
    return epochs.withColumn("x", _arrow(lambda x: zero_phase(b, a, x))("x"))


def envelope(x: np.ndarray, eps: float = 1e-12) -> np.ndarray:
    """ln of the analytic signal's magnitude plus eps."""
    n = x.shape[-1]
    h = np.zeros(n)
    h[0] = 1
    h[1 : (n + 1) // 2] = 2
    if n % 2 == 0:
        h[n // 2] = 1
    return np.log(np.abs(np.fft.ifft(np.fft.fft(x) * h)) + eps)


def log_envelopes(epochs: DataFrame) -> DataFrame:
    return epochs.withColumn("x", _arrow(envelope)("x"))


def resample(epochs: DataFrame, up: int, down: int) -> DataFrame:
    """Packed epochs at up/down times the rate, by a windowed-sinc FIR of ten zero crossings a side; equal rates are copied."""
    g = math.gcd(up, down)
    up, down = up // g, down // g
    if up == down:
        return epochs
    half = 10 * max(up, down)
    t = np.arange(-half, half + 1)
    taps = np.sinc(t / max(up, down)) / max(up, down) * np.hanning(2 * half + 3)[1:-1] * up

    def kernel(x: np.ndarray) -> np.ndarray:
        wide = np.zeros((len(x), x.shape[1] * up))
        wide[:, ::up] = x
        return np.stack([np.convolve(row, taps)[half : half + len(row) : down] for row in wide])

    return epochs.withColumn("x", _arrow(kernel)("x"))


def envelope_correlation(epochs: DataFrame) -> DataFrame:
    """(SUBJECT, src, dst, w): |correlation| of log envelopes over all epochs and samples; channels of an epoch meet in one row."""
    from corvane.operators.connectivity import corr

    rows = epochs.groupBy(*SUBJECT, "epoch").agg(F.collect_list(F.struct("channel", "x")).alias("_c"))
    own = rows.select(*SUBJECT, F.zip_with("_c.channel", _arrow(envelope, nested=True)("_c.x"), lambda c, x: F.struct(c.alias("channel"), x.alias("x"))).alias("_c"))
    pairs = own.select(*SUBJECT, "_c", F.explode("_c").alias("a")).select(*SUBJECT, "a", F.explode("_c").alias("b")).filter("a.channel < b.channel")
    flat = pairs.select(*SUBJECT, F.col("a.channel").alias("src"), F.col("b.channel").alias("dst"), F.explode(F.zip_with("a.x", "b.x", lambda p, q: F.struct(p.alias("va"), q.alias("vb")))).alias("z"))
    both = flat.select(*SUBJECT, "src", "dst", "z.va", "z.vb").filter("va IS NOT NULL AND vb IS NOT NULL")
    return both.groupBy(*SUBJECT, "src", "dst").agg(F.coalesce(F.abs(corr("va", "vb")), F.lit(0.0)).alias("w"))
