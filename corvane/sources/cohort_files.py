"""Cohorts as files: scans that set broken subjects aside, and partitioned epochs with an index.

A cohort is a folder with Hive partitions grp= and subject=, Parquet files below.  A packed one has partitions grp=, files that hold
many subjects each, and an index of them beside it: files then follow the rows and not the subjects.  Folders are listed and read
by Spark, so they may be in any store that it reads.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SAMPLES = "channel string, t long, v double"


def _from_path(path: Column, name: str) -> Column:
    """The value of a partition in a file's path, decoded."""
    value = F.url_decode(F.regexp_replace(F.regexp_extract(path, f"/{name}=([^/]*)/", 1), r"\+", "%2B"))
    return F.when(value != "__HIVE_DEFAULT_PARTITION__", value)


def cohort_files(spark: SparkSession, root: str) -> DataFrame:
    """(grp, subject, path, file, length) of a cohort's Parquet files, without reading them."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(root)
    return found.select(_from_path(F.col("path"), "grp").alias("grp"), _from_path(F.col("path"), "subject").alias("subject"), "path", F.regexp_extract("path", "[^/]*$", 0).alias("file"), "length")


def scan_cohort(spark: SparkSession, root: str, least: int = 2, schema: str = SAMPLES, index: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(samples, quarantine): (grp, subject, channel, t, v) of good subjects and (grp, subject, reason) of the others.

    Reasons, the first that holds: 'unreadable' if a file gives no row, 'values' if a sample is null or not finite, 'short' if a
    channel has fewer than `least` samples.  One bad file sets its subject aside and no other; nothing is dropped unseen.
    A packed cohort comes with its index (grp, subject, file, n): a file that gives another number of a subject's rows is 'unreadable' for it.
    """
    raw = spark.read.schema(f"{schema}, grp string, subject string").option("ignoreCorruptFiles", "true").parquet(root)
    read = raw.select("grp", "subject", "channel", "v", F.col("_metadata.file_name").alias("file"))
    bad = F.col("v").isNull() | F.isnan("v") | (F.abs("v") == float("inf"))
    channels = read.groupBy("grp", "subject", "file", "channel").agg(F.count(F.lit(1)).alias("n"), F.max(bad.cast("int")).alias("bad"))
    files = cohort_files(spark, root).withColumn("n", F.lit(None).cast("long")) if index is None else index
    told = channels.groupBy(F.col("grp").alias("g"), F.col("subject").alias("s"), F.col("file").alias("f")).agg(F.sum("n").alias("m"))
    same = (F.col("file") == F.col("f")) & F.col("grp").eqNullSafe(F.col("g")) & F.col("subject").eqNullSafe(F.col("s")) & (F.coalesce("n", "m") == F.col("m"))
    silent = files.join(told, same, "left_anti").select("grp", "subject", F.lit(1).alias("order"))
    whole = channels.groupBy("grp", "subject", "channel").agg(F.sum("n").alias("n"), F.max("bad").alias("bad"))
    poor = whole.filter(F.col("bad") == 1).select("grp", "subject", F.lit(2).alias("order")).unionByName(whole.filter(F.col("n") < least).select("grp", "subject", F.lit(3).alias("order")))
    reason = F.element_at(F.array(F.lit("unreadable"), F.lit("values"), F.lit("short")), F.min("order"))
    quarantine = silent.unionByName(poor).groupBy("grp", "subject").agg(reason.alias("reason"))
    aside = quarantine.select(F.col("grp").alias("g"), F.col("subject").alias("s"))
    return raw.join(aside, F.col("grp").eqNullSafe(F.col("g")) & F.col("subject").eqNullSafe(F.col("s")), "left_anti").select("grp", "subject", "channel", "t", "v"), quarantine


def write_cohort(samples: DataFrame, root: str) -> None:
    """Samples (grp, subject, channel, t, v) as a cohort, one task for each subject's files."""
    samples.select("grp", F.col("subject").cast("string").alias("subject"), "channel", F.col("t").cast("long").alias("t"), "v").repartition("grp", "subject").write.mode("overwrite").partitionBy("grp", "subject").parquet(root)


def write_packed(samples: DataFrame, root: str) -> DataFrame:
    """The index of samples (grp, subject, channel, t, v) after they are written as a packed cohort; a subject's rows are in one file.

    The index (grp, subject, file, n), a row for each subject and file, goes to <root>-index, from the files as they are then.
    """
    flat = samples.select("grp", F.col("subject").cast("string").alias("subject"), "channel", F.col("t").cast("long").alias("t"), "v")
    flat.repartition("grp", "subject").sortWithinPartitions("grp", "subject").write.mode("overwrite").partitionBy("grp").parquet(root)
    back = samples.sparkSession.read.schema("subject string, grp string").parquet(root)
    index = back.groupBy("grp", "subject", F.col("_metadata.file_name").alias("file")).agg(F.count(F.lit(1)).alias("n"))
    index.write.mode("overwrite").parquet(f"{root}-index")
    return samples.sparkSession.read.schema(index.schema).parquet(f"{root}-index")


def write_epochs(epochs: DataFrame, root: str, fs: float) -> DataFrame:
    """The index of epochs (grp, band, subject, channel, epoch, x) after they are written: partitions grp and band, 32-bit arrays.

    The index (grp, band, subject, path, fs, channels, epochs, samples), a row for each subject and file, goes to <root>-index; it is read from the
    files as they are, so it names only what is there.
    """
    kinds = dict(epochs.dtypes)
    flat = epochs.select("grp", "band", "subject", "channel", "epoch", F.col("x").cast("array<float>").alias("x"))
    flat.repartition("grp", "band", "subject").sortWithinPartitions("grp", "band", "subject", "channel", "epoch").write.mode("overwrite").partitionBy("grp", "band").parquet(root)
    back = read_epochs(epochs.sparkSession, root, kinds["subject"], kinds["channel"], kinds["epoch"])
    index = back.select("*", F.col("_metadata.file_path").alias("path")).groupBy("grp", "band", "subject", "path").agg(F.lit(float(fs)).alias("fs"), F.count_distinct("channel").alias("channels"), F.count_distinct("epoch").alias("epochs"), F.sum(F.size("x")).alias("samples"))
    index.write.mode("overwrite").parquet(f"{root}-index")
    return epochs.sparkSession.read.parquet(f"{root}-index")


def read_epochs(spark: SparkSession, root: str, subject: str = "long", channel: str = "string", epoch: str = "int") -> DataFrame:
    """Epochs of a partitioned table; filters on grp and band read only their folders."""
    return spark.read.schema(f"subject {subject}, channel {channel}, epoch {epoch}, x array<float>, grp string, band string").parquet(root)
