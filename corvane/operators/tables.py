"""Small table rules: feature columns, band orders, exchange files, matched points and resampled comparisons."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions.stages import shared_dir
from corvane.operators.resampling import auc_draws, joint_medians
from corvane.sources.runs import required


def finite(c: str) -> Column:
    """Whether a column is neither null nor NaN nor infinite."""
    return F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))


def complete_features(features: DataFrame, feature: str = "ord", value: str = "value") -> DataFrame:
    """features without those that are null or NaN for any subject."""
    bad = features.groupBy(feature).agg(F.max((~finite(value)).cast("int")).alias("_bad")).filter("_bad = 1")
    return features.join(bad, feature, "left_anti")


def aligned(features: DataFrame, names: list[str], feature: str = "feature") -> DataFrame:
    """Only the named features, with `place` in the order of the names; a name that no row has is an error."""
    order = features.sparkSession.createDataFrame([*enumerate(names)], f"place int, {feature} string")
    lacking = [r[feature] for r in order.join(features.select(feature).distinct(), feature, "left_anti").collect()]  # at most the names
    if lacking:
        raise ValueError(f"missing features: {', '.join(sorted(lacking))}")
    return features.join(F.broadcast(order), feature)


def zero_filled(measures: DataFrame, keys: list[str], bands: list[str], names: list[str]) -> DataFrame:
    """One row for each of `keys` with a column measure_band for every pair; 0 where there is none or it isn't finite."""
    cells = [F.coalesce(F.max(F.when((F.col("band") == b) & (F.col("measure") == m) & finite("value"), F.col("value"))), F.lit(0.0)).alias(f"{m}_{b}") for m in names for b in bands]
    return measures.groupBy(*keys).agg(*cells)


def band_order(df: DataFrame, stored: list[str], band: str = "band") -> DataFrame:
    """(band, place): the bands of df in the stored order, bands that it doesn't name after them by name."""
    known = df.sparkSession.createDataFrame([*enumerate(stored)], f"_o int, {band} string")
    own = df.select(band).distinct().join(F.broadcast(known), band, "left")
    return own.select(band, F.row_number().over(Window.orderBy(F.col("_o").asc_nulls_last(), band)).alias("place"))  # bands are few


def zero_diagonal(edges: DataFrame, w: str = "w") -> DataFrame:
    """Weights that aren't finite, and the diagonal, as 0."""
    return edges.withColumn(w, F.when(F.col("src") == F.col("dst"), 0.0).when(finite(w), F.col(w)).otherwise(0.0))


def upper_vector(symmetric: DataFrame) -> DataFrame:
    """The upper triangle with its diagonal; off-diagonal cells times sqrt(2), so that the norm stays that of the matrix."""
    return symmetric.filter("src <= dst").withColumn("w", F.when(F.col("src") == F.col("dst"), F.col("w")).otherwise(F.col("w") * F.sqrt(F.lit(2.0))))


def stacked_bands(edges: DataFrame, keys: list[str], bands: list, band: str = "band") -> DataFrame:
    """(keys, n, vector): weights of all bands in their order and in row-major order; a key that lacks a band or a finite weight is an error."""
    place = F.array_position(F.array(*map(F.lit, bands)), F.col(band))
    rows = edges.filter(place > 0).groupBy(*keys).agg(F.count_distinct(band).alias("_b"), F.sum((~finite("w")).cast("long")).alias("_bad"), F.array_sort(F.collect_list(F.struct(place.alias("o"), "src", "dst", "w"))).alias("cells"))
    whole = F.when((F.col("_b") == len(bands)) & (F.col("_bad") == 0), F.col("cells.w")).otherwise(F.raise_error(F.lit("a band is missing or a weight is not finite")))
    return rows.select(*keys, F.size("cells").alias("n"), whole.alias("vector"))


def held_out(samples: DataFrame, keys: list[str], share: float = 0.25) -> DataFrame:
    """samples with `part`: the last round(share * epochs) epochs are 'validate', the others 'train'; v is standardised by the training part."""
    last = samples.groupBy(*keys).agg(F.max("epoch").alias("_e")).withColumn("_first", F.col("_e") + 1 - F.bround((F.col("_e") + 1) * share))
    own = samples.join(last, keys).withColumn("part", F.when(F.col("epoch") >= F.col("_first"), "validate").otherwise("train"))
    stats = own.filter("part = 'train'").groupBy(*keys, "channel").agg(F.avg("v").alias("_m"), F.stddev_pop("v").alias("_s"))
    return own.join(stats, [*keys, "channel"]).withColumn("v", (F.col("v") - F.col("_m")) / F.greatest("_s", F.lit(1e-12))).drop("_e", "_first", "_m", "_s")


def first_available(grid: DataFrame, tables: list[DataFrame], keys: list[str], value: str = "value") -> DataFrame:
    """grid with `value` from the first table that has one for the key, and `source`, its number; a key without any is an error."""
    out = grid
    for k, t in enumerate(tables):
        out = out.join(t.select(*keys, F.col(value).alias(f"_{k}")), keys, "left")
    have = [F.when(F.col(f"_{k}").isNotNull(), k) for k in range(len(tables))]
    return out.select(*keys, F.coalesce(*[f"_{k}" for k in range(len(tables))], F.raise_error(F.lit("no baseline for a key"))).alias(value), F.coalesce(*have).alias("source"))


def exchanged_json(df: DataFrame) -> DataFrame:
    """df written as JSON into the shared folder and read with its schema."""
    path = f"{shared_dir(df.sparkSession)}/exchange-{uuid.uuid4().hex}"
    df.write.json(path)
    return df.sparkSession.read.schema(df.schema).json(path)


def exchanged_csv(df: DataFrame, columns: list[str]) -> DataFrame:
    """df written as CSV with a header and read with its schema; a missing column is an error."""
    path = f"{shared_dir(df.sparkSession)}/exchange-{uuid.uuid4().hex}"
    required(df, columns).write.option("header", True).csv(path)
    return df.sparkSession.read.schema(df.schema).option("header", True).csv(path)


def points(measures: DataFrame, keys: list[str], names: list[str], target: DataFrame) -> DataFrame:
    """(keys, a column for each name, reason): values relative to target (measure, t); reason names what is missing or not finite, else null."""
    rel = measures.join(F.broadcast(target), "measure").withColumn("v", (F.col("value") - F.col("t")) / F.when(F.abs("t") < 1e-10, 1.0).otherwise(F.abs("t")))
    wide = rel.groupBy(*keys).agg(*[F.max(F.when(F.col("measure") == n, F.col("v"))).alias(n) for n in names])
    reason = F.concat_ws(",", *[F.when(~finite(n), n) for n in names])
    return wide.select(*keys, *names, F.when(reason != "", reason).alias("reason"))


def rank_probabilities(wide: DataFrame, unit: str, columns: list[str], resamples: int) -> DataFrame:
    """(name, p): how often each column has the largest median over units resampled together; ties share."""
    medians = joint_medians(wide.dropna(subset=columns), unit, columns, resamples, 42)
    best = F.greatest(*columns)
    ties = sum((F.col(c) == best).cast("int") for c in columns)
    shares = medians.select(*[F.when(F.col(c) == best, 1 / ties).otherwise(0.0).alias(c) for c in columns]).agg(*[F.avg(c).alias(c) for c in columns])
    return shares.select(F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).alias("p")) for c in columns])).alias("x")).select("x.*")


def auc_difference(scores: DataFrame, keys: list[str], resamples: int, level: float = 0.95) -> DataFrame:
    """(keys, low, high): interval of AUC(b) - AUC(a) of (y, subject, a, b) over subjects resampled within each class; null without both classes."""
    d = auc_draws(scores, keys, resamples, 7)
    return d.groupBy(*keys).agg(F.percentile("d", (1 - level) / 2).alias("low"), F.percentile("d", (1 + level) / 2).alias("high"))
