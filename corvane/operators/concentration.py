"""Where choices fall: counts and weights of all choices and by band, and their concentration against a uniform null."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvane.operators.stats import selection_superiority

#: Draws of one seed, so that a rerun of a lost task draws the same.
BLOCK = 1000


def region_statistics(selection: DataFrame) -> DataFrame:
    """(scope, node, hard, hard_share, weighted, weighted_share, top, p, p_adj) of selections (band, node, rnk, strength).

    scope is 'overall' or a band: both kinds of rows come from one pass by grouping sets.  hard counts first places, weighted
    adds up strengths; p is the exact binomial of the scope's most chosen node (least node on ties) against each other one, null
    for itself.  A band may not be called 'overall'.
    """
    sets = selection.groupingSets([[F.col("band"), F.col("node")], [F.col("node")]], F.col("band"), F.col("node"))
    counts = sets.agg(F.sum((F.col("rnk") == 1).cast("long")).alias("hard"), F.sum("strength").alias("weighted"), F.grouping(F.col("band")).alias("all"))
    counts = counts.select(F.when(F.col("all") == 1, "overall").otherwise(F.col("band")).alias("scope"), "node", "hard", "weighted")
    own = Window.partitionBy("scope")
    shares = counts.withColumns({"hard_share": F.try_divide(F.col("hard"), F.sum("hard").over(own)), "weighted_share": F.try_divide(F.col("weighted"), F.sum("weighted").over(own))})
    tests = selection_superiority(counts.select("scope", "node", F.col("hard").alias("n")), ["scope"]).select("scope", "node", "top", "p", "p_adj")
    first = F.first("top", True).over(own)
    return shares.join(tests, ["scope", "node"], "left").select("scope", "node", "hard", "hard_share", "weighted", "weighted_share", F.coalesce(first, "node").alias("top"), "p", "p_adj")


def uniform_draws(spark, keys: list[tuple[str, int, int]], draws: int, seed: int = 42) -> DataFrame:
    """(key, draw, top, entropy): of each draw of n choices among `targets` equal targets the largest share and the normalised entropy, for (key, n, targets).

    A draw is a multinomial, made of one binomial for each target, so a row is a draw: n has no part in the number of
    rows.  Blocks of draws have seeds of their own.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for block in b.column("id").to_pylist():
                for at, (key, n, targets) in enumerate(keys):
                    size = min(BLOCK, draws - block * BLOCK)
                    c = np.random.default_rng([seed, at, block]).multinomial(n, np.full(targets, 1 / targets), size) / max(n, 1)
                    entropy = -np.sum(np.where(c > 0, c * np.log(np.where(c > 0, c, 1)), 0), axis=1) / (math.log(targets) if targets > 1 else 1)
                    yield pa.record_batch({"key": pa.array([key] * size), "draw": pa.array(block * BLOCK + np.arange(size)), "top": pa.array(c.max(axis=1)), "entropy": pa.array(np.abs(entropy))})

    return spark.range(-(-draws // BLOCK)).mapInArrow(run, "key string, draw long, top double, entropy double")


def uniform_concentration(counts: DataFrame, targets: int, draws: int = 100_000, seed: int = 42) -> DataFrame:
    """(key, n, top_share, entropy, null_top_low, null_top_high, null_entropy_low, null_entropy_high, p_top, p_entropy) of counts (key, node, c).

    Nodes without a choice count among the `targets`.  Limits are the middle 99 % of the draws; p adds the observed value to both
    sides.  Keys are few, and only their sizes reach the driver.
    """
    share = F.col("c") / F.sum("c").over(Window.partitionBy("key"))
    seen = counts.filter("c > 0").withColumn("s", share).groupBy("key").agg(F.sum("c").alias("n"), F.max("s").alias("top_share"), F.abs(F.sum(-F.col("s") * F.log("s")) / (math.log(targets) if targets > 1 else 1.0)).alias("observed"))
    sizes = [(r["key"], int(r["n"]), targets) for r in seen.select("key", "n").orderBy("key").collect()]
    if not sizes:
        return seen.select("key", "n", "top_share", F.col("observed").alias("entropy"), *[F.lit(None).cast("double").alias(c) for c in ("null_top_low", "null_top_high", "null_entropy_low", "null_entropy_high", "p_top", "p_entropy")])
    j = uniform_draws(counts.sparkSession, sizes, draws, seed).join(F.broadcast(seen), "key")  # a row a key
    near = 1e-12
    limits = lambda c: [F.percentile(c, q) for q in (0.005, 0.995)]
    (tl, th), (el, eh) = limits("top"), limits("entropy")
    return j.groupBy("key", "n", "top_share", F.col("observed")).agg(
        tl.alias("null_top_low"), th.alias("null_top_high"), el.alias("null_entropy_low"), eh.alias("null_entropy_high"),
        ((F.sum((F.col("top") >= F.col("top_share") - near).cast("long")) + 1) / (draws + 1)).alias("p_top"),
        ((F.sum((F.col("entropy") <= F.col("observed") + near).cast("long")) + 1) / (draws + 1)).alias("p_entropy"),
    ).withColumnRenamed("observed", "entropy")
