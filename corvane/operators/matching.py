"""One-to-one matching by age, and greedy choices that use up what they take."""

from __future__ import annotations

import heapq

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions.stages import stage_table
from corvane.operators.ranks import numbered


def _spend(heap: list, weight: float) -> list[tuple[float, float]]:
    """Breakpoints taken from the top of a heap of (key, weight), up to `weight` together; the last one is split."""
    out = []
    while weight > 0:
        key, own = heapq.heappop(heap)
        part = min(own, weight)
        out.append((key, part))
        if own > part:
            heapq.heappush(heap, (key, own - part))
        weight -= part
    return out


def unmatched(ages: list[float], few: list[int], many: list[int]) -> list[int]:
    """How many of the larger side stay alone at each age, when all of the smaller side are matched at the least total difference.

    On a line matched pairs needn't cross, so the total is the sum over gaps between ages of gap * |u - c|: c is the surplus of
    the larger side so far and u how many of it stay alone so far.  The least total as a function of u is convex; it is
    kept by its breakpoints on both sides of its minimum, and u is read back from the minima.  Work and memory follow the
    distinct ages, not the people.
    """
    left, right, shift = [(0, float("inf"))], [(0, float("inf"))], 0  # keys: minus the position, and the position less the shift
    surplus, lows = 0, []
    for i, (a, b) in enumerate(zip(few, many)):
        shift += b  # u may grow by up to b here
        surplus += b - a
        if i + 1 < len(ages):
            gap = float(ages[i + 1] - ages[i])
            heapq.heappush(left, (-surplus, gap))
            for key, w in _spend(left, gap):
                heapq.heappush(right, (-key - shift, w))
            heapq.heappush(right, (surplus - shift, gap))
            for key, w in _spend(right, gap):
                heapq.heappush(left, (-(key + shift), w))
        lows.append((-left[0][0], right[0][0] + shift))
    u, out = sum(many) - sum(few), [0] * len(ages)
    for i in range(len(ages) - 1, -1, -1):
        low, high = lows[i - 1] if i else (0, 0)
        before = min(max(u - many[i], low), u, max(high, u - many[i]))
        out[i], u = u - before, before
    return out


def _plan(frame: pd.DataFrame) -> pd.DataFrame:
    """(stratum, age, keep0, keep1, before0, before1): matched people of both sides at each age, and at smaller ages."""
    f = frame.sort_values("age")
    sides = [f["n0"].tolist(), f["n1"].tolist()]
    larger = int(sum(sides[1]) > sum(sides[0]))
    alone = unmatched(f["age"].tolist(), sides[1 - larger], sides[larger])
    sides[larger] = [n - a for n, a in zip(sides[larger], alone)]
    keep = [pd.Series(s, dtype="int64") for s in sides]
    return pd.DataFrame({"stratum": f["stratum"].to_numpy(), "age": f["age"].to_numpy(), **{f"keep{k}": keep[k].to_numpy() for k in (0, 1)}, **{f"before{k}": (keep[k].cumsum() - keep[k]).to_numpy() for k in (0, 1)}})


def age_matches(people: DataFrame) -> DataFrame:
    """(stratum, subject0, subject1, age0, age1, difference): pairs of side 0 and side 1 of a stratum, without replacement, at the least total age difference.

    people: (subject, side, stratum, age).  All of a stratum's smaller side are matched; a stratum of one side has no
    pair, and people without an age or side take no part.  Who of an age is matched goes by subject.  People are
    numbered in ranges and paired by number; only counts by age, of which there are few, meet in one task.
    """
    own = people.filter("age IS NOT NULL AND side IN (0, 1)").select("subject", F.col("side").cast("int").alias("side"), "stratum", F.col("age").cast("double").alias("age"))
    kind = dict(own.dtypes)
    counts = own.groupBy("stratum", "age").agg(F.count(F.when(F.col("side") == 0, 1)).alias("n0"), F.count(F.when(F.col("side") == 1, 1)).alias("n1"))
    plan = stage_table(counts.groupBy("stratum").applyInPandas(_plan, f"stratum {kind['stratum']}, age double, keep0 long, keep1 long, before0 long, before1 long"), "plan")
    placed = numbered(own, ["stratum", "side", "age"], ["subject"], "_n").join(plan, ["stratum", "age"])
    side = lambda k: placed.filter((F.col("side") == k) & (F.col("_n") <= F.col(f"keep{k}"))).select("stratum", (F.col(f"before{k}") + F.col("_n")).alias("_at"), F.col("subject").alias(f"subject{k}"), F.col("age").alias(f"age{k}"))
    pairs = side(0).join(side(1), ["stratum", "_at"])
    return pairs.select("stratum", "subject0", "subject1", "age0", "age1", F.abs(F.col("age0") - F.col("age1")).alias("difference"))


def greedy_unique(sources: DataFrame, targets: DataFrame, keys: list[str], most: int = 256) -> DataFrame:
    """(keys, ord, target, source, distance): targets in their order each take the nearest source of their key that none before has taken.

    sources: (keys, name, x, y, z), targets: (keys, ord, name, x, y, z).  Distances are between directions, times the median
    length of the key's targets; of equal distances the lesser name is nearer.  Points at the origin have no direction and
    take no part; targets for which no source is left have no row.  A key has up to `most` targets, as electrodes have; more are an
    error.  Of sources there may be any number: a target finds one that is left among as many nearest names as its key has targets.
    """

    def unit(df: DataFrame, p: str, *more: str) -> DataFrame:
        r = F.sqrt(F.col("x") ** 2 + F.col("y") ** 2 + F.col("z") ** 2)
        return df.filter(r > 0).select(*keys, *more, F.col("name").alias(p), *[(F.col(a) / r).alias(p + a) for a in "xyz"], r.alias(p + "r"))

    if targets.groupBy(*keys).count().filter(F.col("count") > most).limit(1).count():
        raise ValueError(f"a key has more than {most} targets")
    t = unit(targets, "t", "ord")
    scale = t.groupBy(*keys).agg(F.percentile("tr", 0.5).alias("scale"))
    d = F.round(F.sqrt(sum((F.col("s" + a) - F.col("t" + a)) ** 2 for a in "xyz")) * F.col("scale"), 9)
    named = unit(sources, "s").filter("s IS NOT NULL").join(F.broadcast(t.join(scale, keys)), keys).groupBy(*keys, "ord", "t", "s").agg(F.min(d).alias("distance"))
    close = named.withColumn("_n", F.row_number().over(Window.partitionBy(*keys, "ord", "t").orderBy("distance", "s"))).filter(F.col("_n") <= most)
    near = close.groupBy(*keys, "ord", "t").agg(F.array_sort(F.collect_list(F.struct("distance", F.col("s").alias("source")))).alias("near"))
    lists = near.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("ord", F.col("t").alias("target"), "near"))).alias("asked"))
    kind = dict(lists.dtypes)["asked"]
    ordinal, name = kind.split("ord:")[1].split(",")[0], dict(sources.dtypes)["name"]
    start = F.array().cast(f"array<struct<ord:{ordinal},target:{dict(targets.dtypes)['name']},source:{name},distance:double>>")

    def take(done, one):
        free = F.filter(one["near"], lambda c: ~F.array_contains(F.transform(done, lambda x: x["source"]), c["source"]))
        first = F.get(free, F.lit(0))
        return F.when(first.isNull(), done).otherwise(F.array_append(done, F.struct(one["ord"].alias("ord"), one["target"].alias("target"), first["source"].alias("source"), first["distance"].alias("distance"))))

    return lists.select(*keys, F.explode(F.aggregate("asked", start, take)).alias("c")).select(*keys, "c.ord", "c.target", "c.source", "c.distance")
