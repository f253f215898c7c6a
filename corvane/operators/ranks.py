"""Row numbers and prefix sums without a window that holds a whole group: sorted ranges, and sums of what lies before each."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions.stages import stage_table

_ROW = (1 << 33) - 1


def numbered(df: DataFrame, keys: list[str], order: list[str], name: str = "n") -> DataFrame:
    """df with row numbers 1, 2, ... within `keys` by `order`, as row_number() gives them; nulls come first.

    Rows are dealt into ranges of (keys, order), so one key with all rows fills all tasks.  A range's rows are numbered where they
    are written; then each key needs, for each range, only the number of its rows in earlier ranges.
    """
    own = [f"`{c}`" for c in [*keys, *order]]
    placed = df.repartitionByRange(*own).sortWithinPartitions(*own).withColumn("_at", F.monotonically_increasing_id())
    placed = stage_table(placed.withColumn("_part", F.shiftright("_at", 33).cast("int")), "ranges")
    same = [F.col(f"k{i}").eqNullSafe(F.col(f"`{c}`")) for i, c in enumerate(keys)]
    counts = placed.groupBy(F.col("_part").alias("part"), *[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(keys)]).agg(F.count(F.lit(1)).alias("c"), F.min("_at").alias("first"))
    before = Window.partitionBy(*[f"k{i}" for i in range(len(keys))]).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("before", F.coalesce(F.sum("c").over(before), F.lit(0))).drop("c")  # a row for each key of each range
    on = F.col("part") == F.col("_part")
    for condition in same:
        on = on & condition
    found = placed.join(offsets, on).withColumn(name, F.col("_at") - F.col("first") + 1 + F.col("before"))
    return found.select(*df.columns, name)
