"""Many logistic models at once: one Newton iteration of all of them is one pass over the rows.

Rows are (subject, y, x, train, test): x has p numbers without nulls, and bit s of `train` or `test` says that the row takes part
in the fit or the scoring of split s.  A model has a split, columns of x and an inverse regularisation.  Tasks add up
gradients and Hessians of all models over their rows, Spark adds up the tasks, and only those sums, which grow with the
models and not with the rows, reach the driver.  Columns are standardised by the training rows of their split; a covariate's
linear part, learned on the same rows, can be taken out before.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.functions.stages import stage_table
from corvane.operators.ranks import numbered
from corvane.operators.rollups import probability_metrics

#: Numbers of standardised columns that are held at once, about.
HELD = 1 << 21
STEPS, CLOSE, LONGEST = 50, 1e-9, 5.0


class Models(NamedTuple):
    """Of each model its split, its columns and its inverse regularisation."""

    split: np.ndarray
    columns: np.ndarray
    c: np.ndarray


class Scales(NamedTuple):
    """Of each split the means and deviations of the columns after the covariate's linear part went, the slopes, and the covariate's mean."""

    mean: np.ndarray
    sd: np.ndarray
    slope: np.ndarray
    centre: np.ndarray


def _columns(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    return b.column("x").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1), b.column("y").to_numpy().astype(float)


def _in_split(b: pa.RecordBatch, mask: str, s: int) -> np.ndarray:
    return b.column(mask).to_numpy() >> s & 1 == 1


def _added(rows: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[np.ndarray]], shape: tuple[int, ...]) -> np.ndarray:
    """The sum of the arrays that the tasks give, each of the same shape."""

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for a in run(b for b in batches if b.num_rows):
            at = np.flatnonzero(a.ravel())
            yield pa.record_batch({"at": pa.array(at), "value": pa.array(a.ravel()[at])})

    out = np.zeros(int(np.prod(shape)))
    for at, value in rows.mapInArrow(cells, "at long, value double").groupBy("at").agg(F.sum("value")).collect():
        out[at] = value
    return out.reshape(shape)


def scales(rows: DataFrame, splits: int, p: int, covariate: bool = False) -> Scales:
    """Moments of the training rows of each split; with `covariate`, the number after the p columns of x is taken out of them."""
    width = p + covariate

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        total = np.zeros((splits, 3, width + 1))
        for b in batches:
            x, _ = _columns(b)
            for s in range(splits):
                own = x[_in_split(b, "train", s)]
                total[s, 0, :width] += own.sum(axis=0)
                total[s, 1, :width] += (own**2).sum(axis=0)
                total[s, 2, :width] += (own * own[:, -1:]).sum(axis=0)
                total[s, :, width] += len(own)
        yield total

    total = _added(rows, run, (splits, 3, width + 1))
    n = np.maximum(total[:, 0, width:], 1)
    mean, square, cross = (total[:, k, :width] / n for k in range(3))
    var = np.maximum(square - mean**2, 0)
    if not covariate:
        return Scales(mean, _deviation(var, square), np.zeros((splits, p)), np.zeros(splits))
    spread, centre = var[:, p:], mean[:, p:]
    cov = cross[:, :p] - mean[:, :p] * centre
    slope = np.where(spread > 1e-12, cov / np.maximum(spread, 1e-12), 0)
    return Scales(mean[:, :p], _deviation(np.maximum(var[:, :p] - slope * cov, 0), square[:, :p]), slope, centre[:, 0])


def _deviation(var: np.ndarray, square: np.ndarray) -> np.ndarray:
    """Roots of variances; 1 where a column doesn't vary, as usual for scalers."""
    return np.where(var > 1e-12 * np.maximum(square, 1e-12), np.sqrt(var), 1.0)


def _standard(x: np.ndarray, own: np.ndarray, by: Scales, s: int) -> np.ndarray:
    p = by.mean.shape[1]
    z = x[own, :p] - by.mean[s]
    if x.shape[1] > p:
        z = z - (x[own, p] - by.centre[s])[:, None] * by.slope[s]
    return z / by.sd[s]


def _chunks(models: Models, splits: int, rows: int) -> list[list[np.ndarray]]:
    """Of each split its models in groups that a batch's columns fit."""
    size = max(1, HELD // max(1, rows * models.columns.shape[1]))
    own = [np.flatnonzero(models.split == s) for s in range(splits)]
    return [[o[at : at + size] for at in range(0, len(o), size)] for o in own]


def _probability(z: np.ndarray, theta: np.ndarray) -> np.ndarray:
    eta = np.einsum("nmq,mq->nm", z, theta[:, :-1]) + theta[:, -1]
    return 1 / (1 + np.exp(-np.clip(eta, -500, 500)))


def fit(rows: DataFrame, models: Models, by: Scales) -> np.ndarray:
    """(models, columns + 1): coefficients of standardised columns and intercepts that minimise |w|^2 / 2 + c * log loss."""
    q, splits = models.columns.shape[1], len(by.mean)
    theta, live = np.zeros((len(models.split), q + 1)), np.arange(len(models.split))
    for _ in range(STEPS):
        now, at = Models(*(v[live] for v in models)), theta[live]

        def run(batches: Iterator[pa.RecordBatch], now: Models = now, at: np.ndarray = at) -> Iterator[np.ndarray]:
            total = np.zeros((len(now.split), q + 1, q + 2))  # Hessian, and the gradient in the last column
            for b in batches:
                x, y = _columns(b)
                for s, groups in enumerate(_chunks(now, splits, len(x))):
                    own = _in_split(b, "train", s)
                    if not own.any() or not groups:
                        continue
                    z = _standard(x, own, by, s)
                    for g in groups:
                        part = z[:, now.columns[g]]
                        p = _probability(part, at[g])
                        left, weight = p - y[own][:, None], p * (1 - p)
                        total[g, :q, q + 1] += np.einsum("nmq,nm->mq", part, left)
                        total[g, q, q + 1] += left.sum(axis=0)
                        total[g, :q, :q] += np.matmul((part * weight[:, :, None]).transpose(1, 2, 0), part.transpose(1, 0, 2))
                        edge = np.einsum("nmq,nm->mq", part, weight)
                        total[g, :q, q] += edge
                        total[g, q, :q] += edge
                        total[g, q, q] += weight.sum(axis=0)
            yield total

        sums = _added(rows, run, (len(live), q + 1, q + 2)) * models.c[live, None, None]
        ridge = np.diag([1.0] * q + [1e-10])
        step = np.linalg.solve(sums[:, :, : q + 1] + ridge, (sums[:, :, q + 1] + at * np.diag(ridge))[:, :, None])[:, :, 0]
        size = np.abs(step).max(axis=1)
        theta[live] = at - step * np.minimum(1, LONGEST / np.maximum(size, 1e-300))[:, None]
        live = live[size > CLOSE]
        if not len(live):
            return theta
    raise RuntimeError(f"{len(live)} models did not settle")


def right_answers(rows: DataFrame, models: Models, by: Scales, theta: np.ndarray) -> np.ndarray:
    """(models, 2): scored rows, and those whose class the model tells."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        total = np.zeros((len(models.split), 2))
        for b in batches:
            x, y = _columns(b)
            for s, groups in enumerate(_chunks(models, len(by.mean), len(x))):
                own = _in_split(b, "test", s)
                if own.any():
                    z = _standard(x, own, by, s)
                    for g in groups:
                        total[g, 0] += own.sum()
                        total[g, 1] += ((_probability(z[:, models.columns[g]], theta[g]) > 0.5) == (y[own][:, None] > 0.5)).sum(axis=0)
        yield total

    return _added(rows, run, (len(models.split), 2))


def predictions(rows: DataFrame, models: Models, by: Scales, theta: np.ndarray) -> DataFrame:
    """(subject, y, model, p): a row for each model of each split that scores a row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x, y = _columns(b)
            for s, groups in enumerate(_chunks(models, len(by.mean), len(x))):
                own = np.flatnonzero(_in_split(b, "test", s))
                for g in groups if len(own) else []:
                    p = _probability(_standard(x, own, by, s)[:, models.columns[g]], theta[g])
                    at = np.repeat(own, len(g))
                    yield pa.record_batch({"subject": b.column("subject").take(pa.array(at)), "y": pa.array(y[at].astype(np.int32)), "model": pa.array(np.tile(g, len(own)).astype(np.int32)), "p": pa.array(p.ravel())})

    return rows.mapInArrow(run, f"subject {dict(rows.dtypes)['subject']}, y int, model int, p double")


def in_folds(data: DataFrame, k: int, fold: str = "fold") -> DataFrame:
    """data (subject, y, x, fold) with the masks of k splits: split s trains on all folds but s."""
    bit = F.element_at(F.array(*[F.lit(1 << s).cast("long") for s in range(k)]), F.col(fold).cast("int") + 1)
    return data.select("subject", F.col("y").cast("int").alias("y"), "x", (F.lit((1 << k) - 1).cast("long") - bit).alias("train"), bit.alias("test"))


def triplet_search(data: DataFrame, p: int, k: int = 5, c: float = 1.0) -> DataFrame:
    """(rank, a, b, c, accuracy, sd, wa, wb, wc) of all C(p, 3) column triplets of (subject, y, x, fold), best first.

    accuracy and sd are over the k folds, w the coefficients of the last fold's model.  Equal accuracies keep the order of the
    triplets.  A row of the result is a model, so the result is bounded by p, whatever the rows.
    """
    rows, chosen = in_folds(data, k), np.array(list(combinations(range(p), 3)))
    m = len(chosen)
    models = Models(np.repeat(np.arange(k), m), np.tile(chosen, (k, 1)), np.full(k * m, c))
    by = scales(rows, k, p)
    theta = fit(rows, models, by)
    told = right_answers(rows, models, by, theta).reshape(k, m, 2)
    share = told[:, :, 1] / np.maximum(told[:, :, 0], 1)
    accuracy, sd, last = share.mean(axis=0), share.std(axis=0), theta.reshape(k, m, 4)[-1, :, :3]
    order = np.argsort(-np.round(accuracy, 12), kind="stable")
    out = [(r + 1, *map(int, chosen[i]), float(accuracy[i]), float(sd[i]), *map(float, last[i])) for r, i in enumerate(order)]
    return data.sparkSession.createDataFrame(out, "rank int, a int, b int, c int, accuracy double, sd double, wa double, wb double, wc double")


def nested_folds(data: DataFrame, p: int, repeats: int = 1, k: int = 5, inner: int = 3, grid: tuple[float, ...] = (0.03, 0.3, 3.0), covariate: bool = False, order: Callable[[int], Column] = lambda repeat: F.xxhash64("subject", F.lit(repeat))) -> DataFrame:
    """(subject, y, repeat, fold, c, p): every subject scored once a repeat by a model that has not seen its fold.

    Inverse regularisation is chosen by AUC on inner folds of each training part, the smaller one on ties.  With `covariate`
    the last number of x is no column: its linear part is taken out of the columns by each split's training rows alone.
    Outer folds deal the rows of a class in turn by `order`, inner folds by a hash of subject and outer fold.
    """
    out = None
    for repeat in range(repeats):
        dealt = outer_folds(data, k, order(repeat))
        train, test = F.lit(0).cast("long"), F.lit(0).cast("long")
        for o in range(k):
            own = F.pmod(F.xxhash64("subject", F.lit(repeat), F.lit(o)), F.lit(inner))
            for mask, s in [(F.col("fold") == o, o), *[((F.col("fold") != o) & (own == j), k + o * inner + j) for j in range(inner)]]:
                seen = ~mask if s < k else (F.col("fold") != o) & ~mask
                train, test = train.bitwiseOR(F.when(seen, F.lit(1 << s)).otherwise(F.lit(0)).cast("long")), test.bitwiseOR(F.when(mask, F.lit(1 << s)).otherwise(F.lit(0)).cast("long"))
        rows = dealt.select("subject", F.col("y").cast("int").alias("y"), "x", train.alias("train"), test.alias("test"))
        splits, g = k * (1 + inner), len(grid)
        models = Models(np.repeat(np.arange(splits), g), np.tile(np.arange(p), (splits * g, 1)), np.tile(np.array(grid, float), splits))
        by = scales(rows, splits, p, covariate)
        theta = fit(rows, models, by)
        held = predictions(rows, models, by, theta)
        judged = held.filter(F.col("model") >= k * g).select("y", "p", F.floor((F.col("model") - k * g) / (inner * g)).cast("int").alias("fold"), F.pmod("model", F.lit(g)).alias("choice"), F.floor(F.col("model") / g).alias("split"))
        auc = probability_metrics(judged, ["fold", "choice", "split"], "y", "p").groupBy("fold", "choice").agg(F.avg("auc").alias("auc"))
        best = {r["fold"]: int(-r["m"]["choice"]) for r in auc.groupBy("fold").agg(F.max(F.struct(F.round("auc", 12).alias("auc"), (-F.col("choice")).alias("choice"))).alias("m")).collect()}
        kept = F.create_map(*[F.lit(v) for o in range(k) for v in (o * g + best.get(o, 0), float(grid[best.get(o, 0)]))])
        one = held.withColumn("c", kept[F.col("model")]).filter("c IS NOT NULL").select("subject", "y", F.lit(repeat).alias("repeat"), F.floor(F.col("model") / g).cast("int").alias("fold"), "c", "p")
        out = one if out is None else out.unionByName(one)
    return out


def outer_folds(data: DataFrame, k: int, order: Column) -> DataFrame:
    """data with stratified folds 0..k-1 dealt in the given order within each class."""
    return stage_table(numbered(data.withColumn("_order", order), ["y"], ["_order", "subject"], "_n").withColumn("fold", ((F.col("_n") - 1) % k).cast("int")).drop("_n", "_order"), "folds")
