"""Bookkeeping of runs: multi-file joins, contracts, resume, failures, completeness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def concatenated(samples: DataFrame, keys: list[str], part: str = "file", t: str = "t") -> DataFrame:
    """Files of a subject end to end in the order of their names: each file's samples start where the one before ended."""
    sizes = samples.groupBy(*keys, part).agg((F.max(t) + 1).alias("_n"))
    order = Window.partitionBy(*keys).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    return samples.join(sizes.withColumn("_offset", F.coalesce(F.sum("_n").over(order), F.lit(0))).drop("_n"), [*keys, part]).withColumn(t, F.col(t) + F.col("_offset")).drop("_offset")


def dropped(df: DataFrame, names: DataFrame, name: str) -> DataFrame:
    """df without the rows whose `name` is listed."""
    return df.join(names.select(name).distinct(), name, "left_anti")


def mixed_contracts(files: DataFrame, keys: list[str], contract: list[str]) -> DataFrame:
    """(keys, n): keys whose files do not all agree on the contract columns."""
    return files.groupBy(*keys).agg(F.count_distinct(F.struct(*contract)).alias("n")).filter("n > 1")


def complete_epochs(samples: DataFrame, keys: list[str], length: int, t: str = "t") -> DataFrame:
    """(keys, epoch, n): whole epochs only."""
    e = F.floor(F.col(t) / length).cast("int")
    return samples.groupBy(*keys, e.alias("epoch")).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") == length)


def missing_cells(have: DataFrame, grid: DataFrame, on: list[str]) -> DataFrame:
    """Cells of a grid without a row."""
    return grid.select(*on).join(have.select(*on).distinct(), on, "left_anti")


def still_to_do(tasks: DataFrame, done: DataFrame, keys: list[str], parameters: str = "params") -> DataFrame:
    """Tasks without a finished row of equal parameters."""
    return tasks.join(done.select(*keys, parameters).distinct(), [*keys, parameters], "left_anti")


def reusable(caches: DataFrame, version: int, families: list[str]) -> DataFrame:
    """Caches of the same version that hold all requested families."""
    return caches.filter((F.col("version") == version) & (F.size(F.array_except(F.array(*map(F.lit, families)), "families")) == 0))


def zeros_on_failure(edges: DataFrame, grid: DataFrame, on: list[str], w: str = "w") -> tuple[DataFrame, DataFrame]:
    """(matrix, failures): the grid with 0 for cells of failed units, and the units that have no cell at all."""
    unit = [c for c in on if c not in ("src", "dst")]
    filled = grid.join(edges, on, "left").withColumn(w, F.coalesce(w, F.lit(0.0)))
    return filled, grid.select(*unit).distinct().join(edges.select(*unit).distinct(), unit, "left_anti")


def required(df: DataFrame, columns: list[str]) -> DataFrame:
    """df, or an error that names the columns it lacks."""
    lacking = [c for c in columns if c not in df.columns]
    if lacking:
        raise ValueError(f"missing columns: {', '.join(lacking)}")
    return df


def checked(condition: Column, message: str, value: Column) -> Column:
    """value where the condition holds, an error elsewhere."""
    return F.when(condition, value).otherwise(F.raise_error(F.lit(message)))
