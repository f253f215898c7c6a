"""Epochs and their quality on event streams; the same functions run on batch tables.

Events are (ts, unit, channel, value).  Epochs are event-time windows with optional overlap; on a stream, rows later than the
watermark are dropped and an epoch is emitted once, when the watermark passes its end.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windows(events: DataFrame, length: str, slide: str | None = None, late: str = "1 day", keys: tuple[str, ...] = ("unit", "channel")) -> DataFrame:
    """events grouped into windows; the watermark has no effect on a batch table."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", length, slide or length), *keys)


def epoch_quality(events: DataFrame, length: str, slide: str | None = None, late: str = "1 day", keys: tuple[str, ...] = ("unit", "channel")) -> DataFrame:
    """(start, keys, n, rms, n_bad, flat): values of an epoch, root mean square of the finite ones, count of others, no spread."""
    bad = F.col("value").isNull() | F.isnan("value") | (F.abs("value") == float("inf"))
    good = F.when(~bad, F.col("value"))
    agg = windows(events, length, slide, late, keys).agg(F.count(F.lit(1)).alias("n"), F.sqrt(F.avg(good * good)).alias("rms"), F.sum(bad.cast("long")).alias("n_bad"), (F.max(good) - F.min(good)).alias("spread"))
    return agg.select(F.col("window.start").alias("start"), *keys, "n", "rms", "n_bad", (F.coalesce("spread", F.lit(0.0)) < 1e-6).alias("flat"))


def start_epoch_quality(events: DataFrame, path: str, checkpoint: str, **options):
    """A query that appends finished epochs to Parquet files; the checkpoint folder makes it restartable with each epoch written once."""
    return epoch_quality(events, **options).writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
