"""Exact tails and draws against plain enumeration."""

import itertools

import numpy as np
import pytest
from corvane.operators import labels, rollups, stats, tables
from pyspark.sql import functions as F


@pytest.mark.parametrize("small,large", [(1, 4), (2, 3), (3, 5), (4, 4)])
def test_u_tail_counts_arrangements(small, large):
    n = small + large
    us = [sum(c) - small * (small - 1) // 2 for c in itertools.combinations(range(n), small)]
    for u in range(small * large + 1):
        low = min(u, small * large - u)
        assert abs(stats.u_two_sided(small, large, u) - min(1.0, 2 * sum(x <= low for x in us) / len(us))) < 1e-12


@pytest.mark.parametrize("n", [1, 4, 8])
def test_signed_rank_tail_counts_signs(n):
    ws = [sum(k + 1 for k in range(n) if mask >> k & 1) for mask in range(2**n)]
    for w in range(n * (n + 1) // 4 + 1):
        assert abs(stats.signed_rank_two_sided(n, w) - min(1.0, 2 * sum(x <= w for x in ws) / len(ws))) < 1e-12


def test_small_groups_have_exact_p(spark):
    rows = [("a", "Healthy", v) for v in (1.0, 2.5, 9.0)] + [("a", "Patient", v) for v in (0.5, 3.0, 4.0, 7.5, 8.0)]
    rows += [("b", "Healthy", 1.0), ("b", "Patient", 1.0), ("b", "Patient", 2.0)]
    got = {r["k"]: r for r in stats.mann_whitney(spark.createDataFrame(rows, "k string, grp string, value double"), ["k"]).collect()}
    assert abs(got["a"]["p"] - stats.u_two_sided(3, 5, got["a"]["u"])) < 1e-12
    assert got["b"]["p"] is not None and got["b"]["p"] != stats.u_two_sided(1, 2, got["b"]["u"])  # tied values: the normal tail
    pairs = spark.createDataFrame([("a", x, 0.0) for x in (1.0, -2.0, 3.0, 4.5, 6.0)], "k string, before double, after double")
    row = stats.wilcoxon(pairs, ["k"]).first()
    assert (row["w_minus"], row["p"]) == (2.0, stats.signed_rank_two_sided(5, 2))


def test_sign_flips(spark):
    few, many = [0.5, -0.25, 1.0, 0.0, 2.0], np.random.default_rng(0).normal(0.2, 1, 40).tolist()
    rows = [("few", k, v) for k, v in enumerate(few)] + [("many", k, v) for k, v in enumerate(many)] + [("low", 1, -1.0), ("none", 1, None)]
    got = {r["k"]: r["p"] for r in stats.sign_flip(spark.createDataFrame(rows, "k string, unit long, value double").repartition(3), ["k"], permutations=4000, rows=7).collect()}
    nz = [v for v in few if v]
    means = [sum(x * v for x, v in zip(signs, nz)) / len(few) for signs in itertools.product([1, -1], repeat=len(nz))]
    assert abs(got["few"] - np.mean([m >= np.mean(few) - 1e-12 for m in means])) < 1e-12
    b, u = np.arange(1, 4001)[:, None], np.arange(40)[None, :]
    flips = np.where(stats._mixed(b, u) % 2 == 0, 1.0, -1.0) @ np.array(many) / 40
    assert abs(got["many"] - ((flips >= np.mean(many) - 1e-12).sum() + 1) / 4001) < 1e-12 and got["low"] == 1.0
    assert 0.4 < np.mean(stats._mixed(b, u) % 2) < 0.6


def test_mixed_is_the_same_in_spark(spark):
    rows = [(a, b) for a in (0, 1, 77, 10**6) for b in (0, 5, 10**9, 2**31)]
    got = spark.createDataFrame(rows, "a long, b long").select(stats.mixed(F.col("a"), F.col("b")).alias("m")).collect()
    assert [r["m"] for r in got] == [int(stats._mixed(np.int64(a), np.int64(b))) for a, b in rows]


def test_nearest_row_does_not_depend_on_blocks(spark):
    rng = np.random.default_rng(1)
    v = rng.normal(size=(60, 4))
    df = spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(v)], "id long, v array<double>")
    got = {r["id"]: r["nearest"] for r in rollups.nearest(df.filter("id % 3 = 0"), df.select(F.col("id").alias("ref"), F.col("v").alias("u")), "id", "ref", block=5).collect()}
    d = np.sqrt(((v[:, None] - v[None]) ** 2).mean(axis=2)) + np.diag(np.full(60, np.inf))
    assert got == {k: int(d[k].argmin()) for k in range(0, 60, 3)}


def test_nearest_row_of_copies_and_of_vectors_with_gaps(spark):
    """Ties of copies and within a rounded digit go to the least id, as do rows without a distance."""
    rng = np.random.default_rng(5)
    v = np.repeat(rng.integers(0, 4, size=(40, 3)).astype(float), 50, axis=0) + np.where(rng.random((2000, 1)) < 0.3, 1e-7, 0.0)
    data = [(k, x.tolist()) for k, x in enumerate(v)] + [(3000, None), (3001, [1.0, None, 2.0]), (3003, [float("inf"), 0.0, 0.0])]
    df = spark.createDataFrame(data, "id long, v array<double>")
    found = rollups.nearest(df.filter("id % 30 = 0 OR id = 3003"), df.select(F.col("id").alias("ref"), F.col("v").alias("u")), "id", "ref", block=9).collect()
    got = {r["id"]: (r["nearest"], r["distance"]) for r in found}
    d = np.floor(np.sqrt(((v[:, None] - v[None]) ** 2).sum(axis=2) / 3) * 1e6 + 0.5) / 1e6 + np.diag(np.full(2000, np.inf))
    assert got == {k: (int(d[k].argmin()), pytest.approx(d[k].min())) for k in range(0, 2000, 30)} | {3000: (0, None), 3003: (0, None)}


def test_regions_follow_the_written_name(spark):
    got = spark.createDataFrame([("T5-REF",), ("t6",), ("P7",), ("T3",), ("FC1",), ("x",)], "n string").select(labels.region(F.col("n")).alias("r"), labels.canonical_name(F.col("n")).alias("c")).collect()
    assert [tuple(r) for r in got] == [("temporal", "P7"), ("temporal", "t6"), ("parietal", "P7"), ("temporal", "T7"), ("frontal", "FC1"), ("other", "x")]


def test_table_rules_name_what_is_missing(spark):
    f = spark.createDataFrame([(1, "a", 1.0), (1, "b", 2.0)], "subject long, feature string, value double")
    with pytest.raises(ValueError, match="missing features: c"):
        tables.aligned(f, ["a", "c"])
    e = spark.createDataFrame([("s", "1", 0, 1, 2.0)], "unit string, band string, src long, dst long, w double")
    with pytest.raises(Exception, match="a band is missing"):
        tables.stacked_bands(e, ["unit"], ["1", "2"]).collect()
    grid = spark.createDataFrame([(1,)], "k long")
    with pytest.raises(Exception, match="no baseline"):
        tables.first_available(grid, [grid.withColumn("value", F.lit(1.0)).filter("k = 2")], ["k"]).collect()
