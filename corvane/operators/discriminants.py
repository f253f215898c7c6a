"""Nearest-neighbour votes, linear discriminants with shrinkage, and calibrated margins.

Rows are (subject, y, x): y is 0 or 1 and x has p numbers without nulls.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.operators.manyfits import _added, _columns


def z_scores(rows: DataFrame, by: DataFrame, p: int) -> DataFrame:
    """rows with x as z-scores by the means and population deviations of `by`; a column that doesn't vary there is only centred."""
    at = [F.col("x")[i] for i in range(p)]
    row = by.agg(*[F.avg(c).alias(f"m{i}") for i, c in enumerate(at)], *[F.stddev_pop(c).alias(f"s{i}") for i, c in enumerate(at)]).first()
    return rows.withColumn("x", F.array(*[(c - F.lit(row[f"m{i}"] or 0.0)) / F.lit(row[f"s{i}"] or 1.0) for i, c in enumerate(at)]))


def _nearest(ids: np.ndarray, points: np.ndarray, k: int):
    """Of each asked point the k nearest rows of a task, kept from batch to batch; a row doesn't count for its own id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = np.full((len(ids), k), np.inf)
        refs, labels = np.zeros((len(ids), k), np.int64), np.zeros((len(ids), k), np.int64)
        for b in batches:
            if not b.num_rows:
                continue
            x, y = _columns(b)
            own = b.column("subject").to_numpy()
            for at in range(0, len(x), 512):
                part, name, label = x[at : at + 512], own[at : at + 512], y[at : at + 512].astype(np.int64)
                d = np.round(np.sqrt(((points[:, None, :] - part[None]) ** 2).sum(axis=2)), 9) if points.size * len(part) < 1 << 24 else np.stack([np.round(np.sqrt(((p - part) ** 2).sum(axis=1)), 9) for p in points])
                d[ids[:, None] == name[None]] = np.inf
                d, r, c = np.concatenate([best, d], axis=1), np.concatenate([refs, np.broadcast_to(name, d.shape)], axis=1), np.concatenate([labels, np.broadcast_to(label, d.shape)], axis=1)
                order = np.lexsort((r, d), axis=1)[:, :k]  # of equal distances the smaller id
                best, refs, labels = (np.take_along_axis(v, order, 1) for v in (d, r, c))
        found = np.isfinite(best)
        yield pa.record_batch({"ask": pa.array(np.repeat(ids, k)[found.ravel()]), "d": pa.array(best[found]), "ref": pa.array(refs[found]), "y": pa.array(labels[found])})

    return run


def knn(asked: DataFrame, rows: DataFrame, k: int = 15, block: int = 1024) -> DataFrame:
    """(ask, n, p): share of class 1 among the k nearest rows (subject, y, x) of each asked row (ask, x), by weights 1 / distance.

    A row at distance 0 leaves the vote to such rows; a row is no neighbour of its own id; of equal distances the smaller id
    is nearer.  Asked rows go over all rows in blocks of about `block`; a task sends the k nearest of its rows, and those are merged.
    """
    blocks, out = max(1, -(-asked.count() // block)), None
    for j in range(blocks):
        own = asked.filter(F.pmod(F.xxhash64("ask"), F.lit(blocks)) == j).select("ask", "x").collect()  # about `block` rows, whatever the table
        if not own:
            continue
        near = rows.select("subject", "y", "x").mapInArrow(_nearest(np.array([r["ask"] for r in own], np.int64), np.array([r["x"] for r in own], float), k), "ask long, d double, ref long, y long")
        out = near if out is None else out.unionByName(near)
    if out is None:
        return asked.select("ask", F.lit(0).cast("long").alias("n"), F.lit(None).cast("double").alias("p")).limit(0)
    top = out.withColumn("r", F.row_number().over(Window.partitionBy("ask").orderBy("d", "ref"))).filter(F.col("r") <= k)
    zero = F.min("d").over(Window.partitionBy("ask")) == 0
    voted = top.withColumn("w", F.when(zero, (F.col("d") == 0).cast("double")).otherwise(1 / F.col("d")))
    return voted.groupBy("ask").agg(F.count(F.lit(1)).alias("n"), (F.sum(F.col("w") * F.col("y")) / F.sum("w")).alias("p"))


def class_moments(rows: DataFrame, p: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(n, means, population deviations) of both classes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        total = np.zeros((2, 2, p + 1))
        for b in batches:
            x, y = _columns(b)
            for c in (0, 1):
                own = x[y == c]
                total[c, 0, :p] += own.sum(axis=0)
                total[c, 1, :p] += (own**2).sum(axis=0)
                total[c, :, p] += len(own)
        yield total

    total = _added(rows, run, (2, 2, p + 1))
    n = total[:, 0, p]
    mean, square = total[:, 0, :p] / n[:, None], total[:, 1, :p] / n[:, None]
    return n, mean, np.sqrt(np.maximum(square - mean**2, 0))


def shrinkage(gram: np.ndarray, fourth: float, n: float) -> float:
    """Ledoit and Wolf's share of the scaled identity, from the sums of products of centred rows and of their squared lengths squared."""
    p, cov = len(gram), gram / n
    mu = np.trace(cov) / p
    spread = ((cov**2).sum() - p * mu**2) / p
    noise = min((fourth / n - (cov**2).sum()) / (n * p), spread)
    return 0.0 if noise <= 0 or spread <= 0 else float(noise / spread)


def discriminant(rows: DataFrame, p: int, share: float | None = None) -> tuple[np.ndarray, float]:
    """(coefficients, intercept) of the linear discriminant with class covariances shrunk to the scaled identity.

    share is the identity's part of a covariance; None takes Ledoit and Wolf's for the standardised rows of each class.
    Both classes need a row.  Rows are only read for sums of products, p x p numbers a class.
    """
    n, mean, sd = class_moments(rows, p)
    if not n.all():
        raise ValueError("both classes need rows")
    scale = np.where(sd > 0, sd, 1.0) if share is None else np.ones_like(sd)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        total = np.zeros((2, p + 1, p))
        for b in batches:
            x, y = _columns(b)
            for c in (0, 1):
                z = (x[y == c] - mean[c]) / scale[c]
                total[c, :p] += z.T @ z
                total[c, p, 0] += ((z**2).sum(axis=1) ** 2).sum()
        yield total

    total, cov = _added(rows, run, (2, p + 1, p)), np.zeros((p, p))
    for c in (0, 1):
        own, part = total[c, :p] / n[c], share if share is not None else shrinkage(total[c, :p], total[c, p, 0], n[c])
        shrunk = (1 - part) * own + part * np.trace(own) / p * np.eye(p)
        cov += n[c] / n.sum() * scale[c][:, None] * shrunk * scale[c]
    w = np.linalg.lstsq(cov, mean.T, rcond=None)[0].T
    edge = -0.5 * (mean * w).sum(axis=1) + np.log(n / n.sum())
    return w[1] - w[0], float(edge[1] - edge[0])


def linear_score(x: str, coefficients: np.ndarray, intercept: float) -> Column:
    """The decision value: coefficients times x, plus the intercept."""
    w = F.array(*[F.lit(float(c)) for c in coefficients])
    return F.aggregate(F.zip_with(x, w, lambda a, b: a * b), F.lit(float(intercept)), lambda s, v: s + v)


def platt(scores: DataFrame, keys: list[str], steps: int = 50) -> DataFrame:
    """(keys, a, b): the sigmoid 1 / (1 + exp(-(a * f + b))) of decision values (keys, y, f), all keys at once.

    Targets are (n1 + 1) / (n1 + 2) and 1 / (n0 + 2), as usual for small samples.  Every Newton step is one aggregate; keys are few.
    """
    sizes = scores.groupBy(*keys).agg(F.sum("y").alias("_n1"), F.sum(1 - F.col("y")).alias("_n0"), F.avg("f").alias("_m"), F.coalesce(F.nullif(F.stddev_pop("f"), F.lit(0.0)), F.lit(1.0)).alias("_s"))
    own = sizes.collect()
    spark, kind = scores.sparkSession, ", ".join(f"{k} {t}" for k, t in scores.dtypes if k in keys)
    fitted = {tuple(r[k] for k in keys): (0.0, float(np.log((r["_n1"] + 1) / (r["_n0"] + 1)))) for r in own}
    scale = {tuple(r[k] for k in keys): (r["_m"], r["_s"]) for r in own}
    t = F.when(F.col("y") == 1, (F.col("_n1") + 1) / (F.col("_n1") + 2)).otherwise(1 / (F.col("_n0") + 2))
    z, p = (F.col("f") - F.col("_m")) / F.col("_s"), 1 / (1 + F.exp(-(F.col("_a") * F.col("_z") + F.col("_b"))))
    data = scores.join(F.broadcast(sizes), keys).select(*keys, t.alias("_t"), z.alias("_z"))
    for _ in range(steps):
        now = spark.createDataFrame([(*k, *v) for k, v in fitted.items()], f"{kind}, _a double, _b double")
        left, weight = F.col("_p") - F.col("_t"), F.col("_p") * (1 - F.col("_p"))
        sums = data.join(F.broadcast(now), keys).withColumn("_p", p).groupBy(*keys).agg(F.sum(left * F.col("_z")).alias("ga"), F.sum(left).alias("gb"), F.sum(weight * F.col("_z") ** 2).alias("aa"), F.sum(weight * F.col("_z")).alias("ab"), F.sum(weight).alias("bb")).collect()
        most = 0.0
        for r in sums:
            key = tuple(r[k] for k in keys)
            step = np.linalg.solve([[r["aa"] + 1e-12, r["ab"]], [r["ab"], r["bb"] + 1e-12]], [r["ga"], r["gb"]])
            step *= min(1.0, 2.0 / max(np.abs(step).max(), 1e-300))
            fitted[key], most = (float(fitted[key][0] - step[0]), float(fitted[key][1] - step[1])), max(most, np.abs(step).max())
        if most < 1e-10:
            break
    rows = [(*k, float(a / scale[k][1]), float(b - a * scale[k][0] / scale[k][1])) for k, (a, b) in fitted.items()]
    return spark.createDataFrame(rows, f"{kind}, a double, b double")
