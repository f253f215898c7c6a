"""Pairwise connectivity from spectra: one cross-spectrum table, every estimator an aggregate of it.

spectrum rows: (grp, subject, channel, epoch, f, re, im).  Edges are (grp, subject, src, dst, ...).  Undirected measures
have src < dst.  EPS floors powers and denominators; imaginary parts below TINY count as 0, so that rounding noise has no sign.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EPS, TINY = 1e-12, 1e-9
PAIR = ["grp", "subject", "src", "dst"]


def corr(a: str, b: str) -> Column:
    """Pearson correlation of values that are there in pairs; null where a side does not vary, by its ends: merged variances of equal values are not exactly 0."""
    varies = (F.max(a) > F.min(a)) & (F.max(b) > F.min(b))
    return F.when(varies, F.try_divide(F.covar_pop(a, b), F.sqrt(F.var_pop(a) * F.var_pop(b))))


def cross(spectrum: DataFrame, ordered: bool = False) -> DataFrame:
    """(PAIR, epoch, f, re, im, pa, pb): X_src * conj(X_dst) and both powers; the self join is by subject, epoch and bin."""
    s = spectrum.select("grp", "subject", "epoch", "f", "channel", "re", "im")
    a = s.withColumnsRenamed({"channel": "src", "re": "ra", "im": "ia"})
    b = s.withColumnsRenamed({"channel": "dst", "re": "rb", "im": "ib"})
    j = a.join(b, ["grp", "subject", "epoch", "f"]).filter("src <> dst" if ordered else "src < dst")
    re, im = F.col("ra") * F.col("rb") + F.col("ia") * F.col("ib"), F.col("ia") * F.col("rb") - F.col("ra") * F.col("ib")
    im = F.when(F.abs(im) < TINY, 0.0).otherwise(im)
    return j.select(*PAIR, "epoch", "f", re.alias("re"), im.alias("im"), (F.col("ra") ** 2 + F.col("ia") ** 2).alias("pa"), (F.col("rb") ** 2 + F.col("ib") ** 2).alias("pb"))


def _floor(c: Column) -> Column:
    return F.greatest(c, F.lit(EPS))


def by_frequency(x: DataFrame) -> DataFrame:
    """(PAIR, f, e, cre, cim, pre, pim): coherency and mean unit phasor over epochs."""
    mag = F.sqrt(F.col("re") ** 2 + F.col("im") ** 2)
    unit = lambda c: F.when(mag > TINY, F.col(c) / mag).otherwise(0.0)
    a = x.groupBy(*PAIR, "f").agg(F.count(F.lit(1)).alias("e"), F.sum("re").alias("sre"), F.sum("im").alias("sim"), F.sum("pa").alias("spa"), F.sum("pb").alias("spb"), F.avg(unit("re")).alias("pre"), F.avg(unit("im")).alias("pim"))
    den = F.sqrt(_floor(F.col("spa")) * _floor(F.col("spb")))
    return a.select(*PAIR, "f", "e", (F.col("sre") / den).alias("cre"), (F.col("sim") / den).alias("cim"), "pre", "pim")


def undirected(x: DataFrame) -> DataFrame:
    """coherence, imcoh, plv, ciplv, ppc by averaging over bins; pli and dwpli2 pooled over epochs and bins."""
    plv2 = F.col("pre") ** 2 + F.col("pim") ** 2
    clip = lambda c: F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0))
    f = by_frequency(x).groupBy(*PAIR).agg(
        F.avg(F.sqrt(F.col("cre") ** 2 + F.col("cim") ** 2)).alias("coherence"),
        F.avg(F.abs("cim")).alias("imcoh"),
        F.avg(F.sqrt(plv2)).alias("plv"),
        F.avg(clip(F.abs("pim") / F.sqrt(_floor(1 - F.col("pre") ** 2)))).alias("ciplv"),
        F.avg(clip((F.col("e") * plv2 - 1) / F.greatest(F.col("e") - 1, F.lit(1)))).alias("ppc"),
    )
    s, a, q = F.sum("im"), F.sum(F.abs("im")), F.sum(F.col("im") ** 2)
    pooled = x.groupBy(*PAIR).agg((F.abs(F.sum(F.signum("im"))) / F.count(F.lit(1))).alias("pli"), F.when(a * a - q > EPS, clip((s * s - q) / (a * a - q))).otherwise(0.0).alias("dwpli2"))
    return f.join(pooled, PAIR)


def directed(x: DataFrame) -> DataFrame:
    """dpli, dwpli and the positive part of the phase-slope index of ordered pairs."""
    pooled = x.groupBy(*PAIR).agg(
        F.greatest(F.least(2 * (F.avg((F.col("im") > 0).cast("double")) - 0.5), F.lit(1.0)), F.lit(0.0)).alias("dpli"),
        F.when(F.sum(F.abs("im")) > EPS, F.greatest(F.sum("im") / F.sum(F.abs("im")), F.lit(0.0))).otherwise(0.0).alias("dwpli"),
    )
    w = Window.partitionBy(*PAIR).orderBy("f")
    c = by_frequency(x).withColumn("nre", F.lead("cre").over(w)).withColumn("nim", F.lead("cim").over(w)).filter("nre IS NOT NULL")
    slope = c.groupBy(*PAIR).agg(F.greatest(F.avg(F.col("cre") * F.col("nim") - F.col("cim") * F.col("nre")), F.lit(0.0)).alias("psi"))
    return pooled.join(slope, PAIR, "left").fillna(0.0, ["psi"])


def correlation_edges(samples: DataFrame, shrink: float = 0.05) -> DataFrame:
    """(PAIR, cov, cor, shrunk) of concatenated epochs: sample covariance, correlation, and the correlation shrunk to the identity; pairs with a constant channel have cor 0."""
    a = samples.select("grp", "subject", "epoch", "k", F.col("channel").alias("src"), F.col("v").alias("va"))
    b = samples.select("grp", "subject", "epoch", "k", F.col("channel").alias("dst"), F.col("v").alias("vb"))
    j = a.join(b, ["grp", "subject", "epoch", "k"]).filter("src < dst").groupBy(*PAIR).agg(F.covar_samp("va", "vb").alias("cov"), F.coalesce(corr("va", "vb"), F.lit(0.0)).alias("cor"))
    return j.withColumn("shrunk", F.col("cor") * (1 - shrink))


def gram(samples: DataFrame, order: int) -> DataFrame:
    """(grp, subject, i, li, j, lj, s): sums of products of lagged channels, the only pass over samples that a VAR fit needs.

    Lag 0 is the target; lags 1..order are predictors; rows before `order` in an epoch take no part.
    Channels of an epoch meet in one row, whose products are summed there, so sums of epochs are shuffled and not products of samples.
    Missing values take no part; repeated rows count as often as they are there.
    """
    w = Window.partitionBy("grp", "subject", "channel", "epoch").orderBy("k")
    lags = samples.withColumn("_x", F.array(*[F.lag("v", i).over(w).cast("double") for i in range(order + 1)])).filter(F.col("k") >= order)
    rows = lags.groupBy("grp", "subject", "epoch").agg(F.collect_list(F.struct("channel", "k", "_x")).alias("_r"))
    packed = rows.select("grp", "subject", F.col("_r.channel").alias("c"), F.transform("_r.k", lambda k: k.cast("long")).alias("k"), F.flatten("_r._x").alias("x"))
    m, kinds = order + 1, dict(samples.dtypes)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(at, 256) for b in batches for at in range(0, b.num_rows, 256)):
            grp, subject, c, k, x = batch.columns
            at = np.concatenate([[0], np.cumsum(pc.list_value_length(c).to_numpy(zero_copy_only=False))]).astype(int)
            coded = c.flatten().dictionary_encode()
            codes, times = coded.indices.to_numpy(zero_copy_only=False), k.flatten().to_numpy(zero_copy_only=False)
            flat = x.flatten()
            valid, values = flat.is_valid().to_numpy(zero_copy_only=False).reshape(-1, m), flat.fill_null(0.0).to_numpy(zero_copy_only=False).reshape(-1, m)
            out = []
            for i in range(batch.num_rows):
                own = slice(at[i], at[i + 1])
                out.append((i, *_products(codes[own], times[own], values[own], valid[own])))
            row = np.repeat([o[0] for o in out], [len(o[5]) for o in out])
            a, la, b_, lb, s, known = (np.concatenate([o[n] for o in out]) for n in range(1, 7))
            names = coded.dictionary
            yield pa.RecordBatch.from_arrays(
                [grp.take(pa.array(row)), subject.take(pa.array(row)), names.take(pa.array(a)), pa.array(la, pa.int32()), names.take(pa.array(b_)), pa.array(lb, pa.int32()), pa.array(s, mask=~known)],
                names=["grp", "subject", "i", "li", "j", "lj", "s"],
            )

    one = packed.mapInArrow(sums, f"grp {kinds['grp']}, subject {kinds['subject']}, i {kinds['channel']}, li int, j {kinds['channel']}, lj int, s double")
    return one.groupBy("grp", "subject", "i", "li", "j", "lj").agg(F.sum("s").alias("s"))


def _products(codes: np.ndarray, times: np.ndarray, values: np.ndarray, valid: np.ndarray) -> tuple[np.ndarray, ...]:
    """(i, li, j, lj, s, known) of one epoch: sums over times of products of the lagged channels that are there at the same time; unknown without a value."""
    names, c = np.unique(codes, return_inverse=True)
    ks, t = np.unique(times, return_inverse=True)
    n, m = len(names), values.shape[1]
    x, have, there = np.zeros((len(ks), n, m)), np.zeros((len(ks), n, m)), np.zeros((len(ks), n))
    np.add.at(x, (t, c), values)
    np.add.at(have, (t, c), valid)
    there[t, c] = 1
    x, have = x.reshape(len(ks), -1), have.reshape(len(ks), -1)
    known = have.T @ have > 0
    if np.isfinite(x).all():
        s = x.T @ x
    else:  # a value that is not finite belongs to its own pairs only
        s = np.array([np.where((have[:, [p]] > 0) & (have > 0), x[:, [p]] * x, 0.0).sum(axis=0) for p in range(n * m)])
    a, la, b, lb = (g.ravel() for g in np.meshgrid(np.arange(n), np.arange(m), np.arange(n), np.arange(m), indexing="ij"))
    met = (there.T @ there > 0)[a, b]
    p, q = a * m + la, b * m + lb
    return names[a[met]], la[met], names[b[met]], lb[met], s[p, q][met], known[p, q][met]


def split_half_reliability(edges: DataFrame, value: str, top: float = 0.1) -> DataFrame:
    """(grp, subject, spearman, pearson, error, jaccard) between edges of splits `odd` and `even` (columns split, PAIR, value)."""
    a = edges.filter("split = 'odd'").select(*PAIR, F.col(value).alias("a"))
    b = edges.filter("split = 'even'").select(*PAIR, F.col(value).alias("b"))
    j, key = a.join(b, PAIR), ["grp", "subject"]
    g = Window.partitionBy(*key)
    rank = lambda c: F.rank().over(g.orderBy(c)) + (F.count(F.lit(1)).over(Window.partitionBy(*key, c)) - 1) / 2
    best = lambda c: F.row_number().over(g.orderBy(F.col(c).desc(), "src", "dst")) <= F.greatest(F.lit(1), F.ceil(F.count(F.lit(1)).over(g) * top))
    r = j.withColumns({"ra": rank("a"), "rb": rank("b"), "ta": best("a"), "tb": best("b")})
    both, either = F.sum((F.col("ta") & F.col("tb")).cast("long")), F.sum((F.col("ta") | F.col("tb")).cast("long"))
    size = F.sqrt(F.sum(F.col("a") ** 2)) + F.sqrt(F.sum(F.col("b") ** 2))
    return r.groupBy(*key).agg(corr("ra", "rb").alias("spearman"), corr("a", "b").alias("pearson"), F.try_divide(2 * F.sqrt(F.sum((F.col("a") - F.col("b")) ** 2)), size).alias("error"), (both / either).alias("jaccard"))
