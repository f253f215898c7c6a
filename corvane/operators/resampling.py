"""Resamples whose draws are a function of (draw, row): drawn in blocks of resamples by tasks, so that draws are never rows.

Draw j of resample b takes row mixed(b, j, seed) modulo n.  Medians are found by rank: below a window of ranks draws are
counted, inside it they are kept, so memory follows the root of n.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.functions.stages import stage_table
from corvane.operators.ranks import numbered

BLOCKS, CHUNK, _M = 200, 1 << 16, 2**31 - 1


def fold(x: np.ndarray) -> np.ndarray:
    """x modulo 2**31 - 1 for x below 2**62 + 2**31."""
    x = (x & _M) + (x >> 31)
    x = (x & _M) + (x >> 31)
    return np.where(x == _M, 0, x)


def drawn(b: int, n: int, seed: int) -> Iterator[np.ndarray]:
    """Numbers, from 0, of the n rows of resample b, some at a time."""
    for at in range(1, n + 1, CHUNK):
        j = np.arange(at, min(at + CHUNK, n + 1), dtype=np.int64)
        x = (b * 69621 + j * 48271 + seed) % _M
        y = fold(x * x + b)
        yield fold(y * y + j % _M) % n


def middle(parts: Callable[[], Iterator[np.ndarray]], n: int) -> tuple[int, int]:
    """The ranks of places (n - 1) // 2 and n // 2 among n ranks below n, which `parts` gives anew at each call."""
    want, half = ((n - 1) // 2, n // 2), int(8 * n**0.5) + 16
    while True:
        low, high, below, kept = n // 2 - half, n // 2 + half, 0, []
        for r in parts():
            below += int(np.count_nonzero(r < low))
            kept.append(r[(r >= low) & (r < high)])
        own = np.concatenate(kept)
        if below <= want[0] and want[1] < below + len(own):
            own = np.partition(own, sorted({want[0] - below, want[1] - below}))
            return int(own[want[0] - below]), int(own[want[1] - below])
        half *= 4  # sixteen standard deviations off: a wider window


def _span(block: int, resamples: int) -> range:
    return range(1 + block * resamples // BLOCKS, 1 + (block + 1) * resamples // BLOCKS)


def _dealt(df: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of df for each block of resamples, a block of a key in one partition."""
    return df.withColumn("_block", F.explode(F.sequence(F.lit(0), F.lit(BLOCKS - 1)))).repartition(BLOCKS, *keys, "_block")


def median_draws(sizes: DataFrame, keys: list[str], resamples: int, seed: int) -> DataFrame:
    """(keys, n, _b, _lo, _hi): numbers of the rows in the middle of each resample of (keys, n), whose rows are numbered by value."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            for _, one in frame.iterrows():
                n, bs = int(one["n"]), _span(int(one["_block"]), resamples)
                found = [middle(lambda b=b: drawn(b, n, seed), n) for b in bs]
                yield pd.DataFrame({k: pd.Series([one[k]] * len(bs), dtype=frame[k].dtype) for k in keys} | {"n": n, "_b": list(bs), "_lo": [x[0] for x in found], "_hi": [x[1] for x in found]})

    kinds = dict(sizes.dtypes)
    return _dealt(sizes.select(*keys, "n"), keys).mapInPandas(run, ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), "n long, _b long, _lo long, _hi long"]))


def _packed(rows: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """(keys, _chunk, columns): whole numbers of rows numbered `_i` from 0 as arrays of up to CHUNK, in their order."""
    cells = rows.groupBy(*keys, F.floor(F.col("_i") / CHUNK).alias("_chunk")).agg(F.array_sort(F.collect_list(F.struct("_i", *columns))).alias("_c"))
    return cells.select(*keys, "_chunk", *[F.col(f"_c.{c}").cast("array<int>").alias(c) for c in columns])


def joint_medians(rows: DataFrame, unit: str, columns: list[str], resamples: int, seed: int) -> DataFrame:
    """(_b, columns): medians of every column over rows resampled together, in the order of `unit`.

    A task gets a block of resamples and the rows' ranks in each column, four bytes each; values stay where they are.
    """
    placed = numbered(rows.select(unit, *columns), [], [unit], "_i").withColumn("_i", F.col("_i") - 1)
    for k, c in enumerate(columns):
        placed = numbered(placed, [], [c], f"_r{k}").withColumn(f"_r{k}", F.col(f"_r{k}") - 1)
    placed = stage_table(placed, "ranked")
    ranks = [f"_r{k}" for k in range(len(columns))]

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        own = frame.sort_values("_chunk")
        at = [np.concatenate([np.asarray(x, np.int32) for x in own[r]]) for r in ranks]
        n, out = len(at[0]), []
        for b in _span(int(own["_block"].iloc[0]), resamples):
            for k, r in enumerate(at):
                out.append((b, k, *middle(lambda r=r, b=b: (r[i] for i in drawn(b, n, seed)), n)))
        return pd.DataFrame(out, columns=["_b", "_k", "_lo", "_hi"])

    found = _dealt(_packed(placed, [], ranks), []).groupBy("_block").applyInPandas(run, "_b long, _k int, _lo long, _hi long")
    ends = found.select("_b", "_k", F.explode(F.array("_lo", "_hi")).alias("_r"))
    values = placed.select(F.explode(F.array(*[F.struct(F.lit(k).alias("_k"), F.col(f"_r{k}").alias("_r"), F.col(c).cast("double").alias("v")) for k, c in enumerate(columns)])).alias("x")).select("x.*")
    return ends.join(values, ["_k", "_r"]).groupBy("_b").agg(*[F.avg(F.when(F.col("_k") == k, F.col("v"))).alias(c) for k, c in enumerate(columns)])


def auc_draws(rows: DataFrame, keys: list[str], resamples: int, seed: int) -> DataFrame:
    """(keys, _b, d): AUC(b) - AUC(a) of each resample within the classes of (keys, y, subject, a, b); null without both classes.

    A task gets a block of resamples and, of a key's rows, their places among its distinct scores; rank sums come from counts by place.
    """
    own = numbered(rows.filter("y IS NOT NULL").select(*keys, "y", "subject", "a", "b"), [*keys, "y"], ["subject"], "_i").withColumn("_i", F.col("_i") - 1)
    for c in ("a", "b"):
        places = numbered(own.select(*keys, c).distinct(), keys, [c], "_p").select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col(c).alias("_v"), (F.col("_p") - 1).alias(f"_p{c}"))
        on = F.col(c).eqNullSafe(F.col("_v"))
        for i, k in enumerate(keys):
            on = on & F.col(k).eqNullSafe(F.col(f"_k{i}"))
        own = own.join(places, on).select(*own.columns, f"_p{c}")
    kinds = dict(own.dtypes)

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        own = frame.sort_values("_chunk")
        classes = [(y, *[np.concatenate([np.asarray(x, np.int32) for x in part[c]]) for c in ("_pa", "_pb")]) for y, part in own.groupby("y")]
        wide = [max(int(part[s].max()) for part in classes) + 1 for s in (1, 2)]
        n, p = sum(len(part[1]) for part in classes), sum(int(y) * len(a) for y, a, _ in classes)
        bs, ds = _span(int(own["_block"].iloc[0]), resamples), []
        for b in bs:
            counts = [[np.zeros(w, np.int64), np.zeros(w, np.int64)] for w in wide]  # of each score: all, and those of class 1
            for y, *places in classes:
                for i in drawn(b, len(places[0]), seed):
                    for s in (0, 1):
                        c = np.bincount(places[s][i], minlength=wide[s])
                        counts[s][0] += c
                        if y == 1:
                            counts[s][1] += c
            ra, rb = (float((ones * (np.cumsum(every) - every + (every + 1) / 2)).sum()) for every, ones in counts)
            ds.append((rb - ra) / (p * (n - p)) if p * (n - p) else None)
        return pd.DataFrame({k: [own[k].iloc[0]] * len(bs) for k in keys} | {"_b": list(bs), "d": pd.Series(ds, dtype="float64")})

    packed = _packed(own, [*keys, "y"], ["_pa", "_pb"])
    found = _dealt(packed, keys).groupBy(*keys, "_block").applyInPandas(run, ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), "_b long, d double"]))
    return found.withColumn("d", F.when(~F.isnan("d"), F.col("d")))
