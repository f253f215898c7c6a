"""The measures side by side equal each measure by itself."""

import numpy as np
import pytest
from corvane.functions import registry
from corvane.operators import graph as G
from corvane.operators import measures as M
from corvane.operators import partition as P
from pyspark.sql import functions as F


@pytest.fixture(scope="module")
def graphs(spark):
    rng = np.random.default_rng(4)
    rows = [("g", f"s{s}", f"n{i}", f"n{j}", float(np.round(rng.random() + 0.05, 3))) for s in range(3) for i in range(6) for j in range(6) if i != j and rng.random() < 0.55]
    return spark.createDataFrame(rows, "grp string, subject string, src string, dst string, w double").cache(), spark.createDataFrame([(f"n{i}",) for i in range(6)], "node string")


def test_all_twenty_measures(spark, graphs):
    e, n = graphs
    got = {}
    for r in registry.all_measures(e, n).collect():
        got.setdefault(r["measure"], {})[r["subject"]] = r["value"]
    assert len(got) == 20 == len(M.MEASURES) and all(set(v) == {"s0", "s1", "s2"} for v in got.values())
    d, x = G.distances(e, 6), e.select("grp", "subject", F.substring("src", 2, 1).cast("int").alias("src"), F.substring("dst", 2, 1).cast("int").alias("dst"), "w")
    alone = {
        "global_efficiency": G.global_efficiency(e, d, 6), "path_length": G.path_length(e, d), "diameter": G.diameter(e, d), "clustering": G.clustering(e, n), "transitivity": G.transitivity(e, n),
        "local_efficiency": G.local_efficiency(e), "mean_strength": G.mean_strength(e, 6), "rich_club": G.rich_club(e), "assortativity": G.assortativity(e), "spectral_radius": G.spectral_radius(e),
        "small_worldness": P.small_worldness(e, n, M.SEED), "betweenness": P.betweenness(x, 6).groupBy("grp", "subject").agg(F.avg("value").alias("value")), "modularity": P.best_partition(x, 6).groupBy("grp", "subject").agg(F.max("q").alias("value")),
        **{c: G.weight_statistics(e, n).select("grp", "subject", F.col(c).alias("value")) for c in ("density", "mean", "sd", "median", "max", "min", "cv")},
    }
    assert set(alone) == set(got)
    for name, table in alone.items():
        for r in table.collect():
            assert got[name][r["subject"]] == (pytest.approx(r["value"]) if r["value"] is not None else None), name


def test_a_measure_of_ones_own_takes_part(spark, graphs):
    e, n = graphs
    registry.register_measure("edges", lambda e, n: e.groupBy("grp", "subject").agg(F.count(F.lit(1)).alias("value")))
    try:
        got = {r["subject"]: r["value"] for r in registry.all_measures(e, n, ["edges"]).collect()}
        assert got == {r["subject"]: float(r["count"]) for r in e.groupBy("subject").count().collect()}
    finally:
        registry.MEASURES.pop("edges")


def test_fronts_of_two_objectives_equal_all_pairs(spark):
    from corvane.operators import whatif as W

    rng = np.random.default_rng(9)
    value = lambda: [None, float(rng.integers(0, 8))][int(rng.random() < 0.95)]
    rows = [(k, i, value(), value(), bool(rng.random() < 0.9)) for k in ("x", "y") for i in range(60)]
    got = {(r["k"], r["cand"]) for r in W.pareto_front(spark.createDataFrame(rows, "k string, cand int, a double, b double, feasible boolean"), ["k"], ["a", "b"]).collect()}
    able = [r for r in rows if r[4]]
    beats = lambda p, q: None not in (*p[2:4], *q[2:4]) and p[2] <= q[2] and p[3] <= q[3] and (p[2] < q[2] or p[3] < q[3])
    assert got == {r[:2] for r in able if not any(o[0] == r[0] and beats(o, r) for o in able)}


def test_small_graphs_need_one_pass(spark, monkeypatch):
    """No joins, stage tables or groups of Python a measure; sparse graphs, single edges and self edges agree with the joins."""
    from corvane.operators import stacks

    rng = np.random.default_rng(7)
    rows = [("g", f"s{s}", i, j, float(np.round(rng.random() + 0.05, 2))) for s in range(12) for i in range(5) for j in range(5) if i != j and rng.random() < 0.1 + 0.07 * s] + [("g", "one", 1, 3, 0.5), ("g", "self", 2, 2, 0.5)]
    e, n = spark.createDataFrame(rows, "grp string, subject string, src int, dst int, w double").cache(), spark.createDataFrame([(i,) for i in range(5)], "node int")
    with monkeypatch.context() as m:
        m.setattr(M, "stage_table", lambda *_: pytest.fail("a stage table"))
        found = registry.all_measures(e, n)
        plan = found._jdf.queryExecution().toString()
        assert plan.count("Join") <= 4 and "FlatMapGroupsInPandas" not in plan  # the join is that of the pairs to be drawn, in each of four plans
        got = {tuple(r[:3]): r["value"] for r in found.collect()}
    monkeypatch.setattr(stacks, "MOST_NODES", 1)
    want = {tuple(r[:3]): r["value"] for r in registry.all_measures(e, n).collect()}
    assert set(got) == set(want)
    for k, v in want.items():
        assert got[k] == (pytest.approx(v, abs=1e-9) if v is not None else None), k
