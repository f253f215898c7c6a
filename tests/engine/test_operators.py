"""Golden values, dense numpy versions and invariants of the operators."""

import math

import numpy as np
import pytest
from corvane.functions import registry, tails
from corvane.operators import connectivity as C
from corvane.operators import edges as E
from corvane.operators import graph as G
from corvane.operators import labels as L
from corvane.operators import models as M
from corvane.operators import rollups as R
from corvane.operators import signals as S
from corvane.operators import stats as T
from corvane.operators import whatif as W
from corvane.streaming import epochs as K
from pyspark.sql import functions as F

EDGE = "grp string, subject string, src int, dst int, w double"


def edges(spark, matrix, subject="s"):
    n = len(matrix)
    return spark.createDataFrame([("Healthy", subject, i, j, float(matrix[i][j])) for i in range(n) for j in range(n) if matrix[i][j]] or [("Healthy", subject, 0, 0, 0.0)], EDGE)


def nodes(spark, n):
    return spark.createDataFrame([(i,) for i in range(n)], "node int")


def value(df):
    return df.first()["value"]


@pytest.fixture(scope="module")
def random_graph():
    rng = np.random.default_rng(3)
    m = rng.random((9, 9)) * (rng.random((9, 9)) < 0.45)
    np.fill_diagonal(m, 0)
    return m


def shortest(m):
    d = np.where(m > 0, 1 / np.where(m > 0, m, 1), np.inf)
    np.fill_diagonal(d, 0)
    for k in range(len(m)):
        d = np.minimum(d, d[:, [k]] + d[[k], :])
    return d


def efficiency(m):
    d = shortest(m)
    off = ~np.eye(len(m), dtype=bool)
    return (1 / d[off]).sum() / (len(m) * (len(m) - 1))


def test_graph_measures_equal_dense_ones(spark, random_graph):
    m, e, n = random_graph, edges(spark, random_graph), nodes(spark, 9)
    d = G.distances(e, 9)
    dense = shortest(m)
    off = ~np.eye(9, dtype=bool)
    finite = dense[off][np.isfinite(dense[off])]
    assert value(G.global_efficiency(e, d, 9)) == pytest.approx(efficiency(m))
    assert value(G.path_length(e, d)) == pytest.approx(finite.mean()) and value(G.diameter(e, d)) == pytest.approx(finite.max())
    local = [efficiency(m[np.ix_(k, k)]) for k in (np.flatnonzero((m[i] > 0) | (m[:, i] > 0)) for i in range(9)) if len(k) > 1]
    assert value(G.local_efficiency(e)) == pytest.approx(np.mean(local))
    a, s = (m > 0).astype(float), np.cbrt(m) + np.cbrt(m).T
    cyc, deg = np.diag(s @ s @ s) / 2, (a + a.T).sum(1)
    possible = deg * (deg - 1) - 2 * np.diag(a @ a)
    assert value(G.clustering(e, n)) == pytest.approx(np.mean(np.where(cyc > 0, cyc / np.where(cyc > 0, possible, 1), 0)))
    assert value(G.transitivity(e, n)) == pytest.approx(cyc[cyc > 0].sum() / possible[cyc > 0].sum())
    assert value(G.spectral_radius(e)) == pytest.approx(np.abs(np.linalg.eigvals(m)).max())
    assert value(G.mean_strength(e, 9)) == pytest.approx(2 * m.sum() / 9)
    assert value(G.rich_club(e)) == pytest.approx(1.0)
    p = spark.createDataFrame([("Healthy", "s", i, i % 3) for i in range(9)], "grp string, subject string, node int, module int")
    lab, total = np.arange(9) % 3, m.sum()
    q = sum(m[np.ix_(lab == k, lab == k)].sum() / total - m[lab == k].sum() * m[:, lab == k].sum() / total**2 for k in range(3))
    assert value(G.modularity(e, p)) == pytest.approx(q)
    assert set(registry.all_measures(e, n, ["density", "clustering"]).select("measure").toPandas()["measure"]) == {"density", "clustering"}


def test_normalisation_keeps_its_invariants(spark):
    n = nodes(spark, 2)
    a, b = (E.normalise(E.dense(edges(spark, np.array([[0, 0.2], [0.5, 0]]) * k), n)).orderBy("src", "dst").select("w").toPandas()["w"] for k in (1, 10))
    assert np.allclose(a, b)
    bad = spark.createDataFrame([("Healthy", "s", 0, 1, float("nan"))], EDGE)
    with pytest.raises(Exception, match="finite"):
        E.normalise(bad, "none").collect()
    clean = {(r["src"], r["dst"]): r["w"] for r in E.sanitise(spark.createDataFrame([("Healthy", "s", 0, 0, 3.0), ("Healthy", "s", 0, 1, -1.0), ("Healthy", "s", 1, 0, math.inf), ("Healthy", "s", 1, 2, None)], EDGE)).collect()}
    assert set(clean.values()) == {0.0}


def test_edge_vector_of_the_golden_matrix(spark):
    m = edges(spark, [[0, 0.2, 0.3], [0.2, 0, 0.4], [0.3, 0.4, 0]])
    assert E.edge_vector(m, directed=False).first()["vector"] == [0.2, 0.3, 0.4]
    assert E.asymmetric_cells(m).first()["n"] == 0
    back = {(r["src"], r["dst"]): r["w"] for r in E.vector_edges(E.edge_vector(m, directed=False)).collect()}
    assert back[0, 1] == back[1, 0] == 0.2 and back[2, 1] == 0.4 and len(back) == 6


def test_tails_have_textbook_values(spark):
    row = spark.range(1).select(
        tails.normal_two_sided(F.lit(1.959963985)).alias("z"), tails.t_two_sided(F.lit(2.228138852), F.lit(10)).alias("t10"), tails.t_two_sided(F.lit(12.7062047), F.lit(1)).alias("t1"), tails.t_two_sided(F.lit(2.364624252), F.lit(7)).alias("t7"),
        tails.chi2_tail(F.lit(5.991464547), 2).alias("c2"), tails.chi2_tail(F.lit(7.814727903), 3).alias("c3"), tails.binomial_tail(F.lit(8), F.lit(10)).alias("b"), tails.binomial_tail(F.lit(1), F.lit(0)).alias("none"), T.fisher(F.lit(8), F.lit(2), F.lit(1), F.lit(5)).alias("f"),
    ).first()
    for k in ("z", "t10", "t1", "t7", "c2", "c3"):
        assert row[k] == pytest.approx(0.05, abs=2e-6)
    assert row["b"] == pytest.approx(56 / 1024) and row["none"] is None and row["f"] == pytest.approx(0.034965, abs=1e-5)


def test_label_rules(spark):
    rows = spark.createDataFrame([("Fp1-REF", "Fp1", "L", "frontal"), ("T5", "P7", "L", "temporal"), (" Cz ", "Cz", "M", "central"), ("O2", "O2", "R", "occipital"), ("CP4", "CP4", "R", "parietal"), ("EKG", "EKG", "M", "other")], "name string, canonical string, side string, region string")
    c = F.col("name")
    for r in rows.select("canonical", "side", "region", L.canonical_name(c).alias("a"), L.side(c).alias("b"), L.region(c).alias("d")).collect():
        assert (r["a"], r["b"], r["d"]) == (r["canonical"], r["side"], r["region"])
    s, b = L.split_unit(F.lit("a::b::c"))
    assert tuple(spark.range(1).select(s, b, L.base_electrode(F.lit("E12/fp1 x")), L.mirror(F.lit("F3"))).first()) == ("a::b", "c", "FP1", "F4")
    src = spark.createDataFrame([("a", 1.0, 0.0, 0.0), ("b", 0.0, 1.0, 0.1)], "name string, x double, y double, z double")
    assert {r["channel"]: r["alias"] for r in L.nearest_alias(src, src.limit(2), 0.05).collect()} == {"a": "a", "b": "b"}


SAMPLE = "grp string, subject int, channel string, epoch int, k int, v double"


def samples(spark, x):
    """x[epoch, channel, sample]"""
    return spark.createDataFrame([("Healthy", 1, f"c{c}", e, k, float(x[e, c, k])) for e in range(x.shape[0]) for c in range(x.shape[1]) for k in range(x.shape[2])], SAMPLE)


def test_both_spectrum_paths_agree(spark):
    x = np.random.default_rng(1).normal(size=(3, 2, 24))
    s = samples(spark, x)
    a = {tuple(r[:5]): (r["re"], r["im"]) for r in S.spectrum(s, 24, 0.05, 0.4).collect()}
    b = {tuple(r[:5]): (r["re"], r["im"]) for r in S.spectrum_arrow(S.packed(s.withColumn("v", F.col("v").cast("float"))), 0.05, 0.4).collect()}
    assert a.keys() == b.keys() and len(a) > 20
    for k, v in a.items():
        assert v == pytest.approx(b[k], abs=1e-5)


def test_zero_lag_and_delay_are_told_apart(spark):
    rng = np.random.default_rng(11)
    t = np.arange(64) / 64
    x = np.zeros((12, 3, 64))
    for e in range(12):
        ph = rng.uniform(0, 2 * np.pi)
        x[e, 0] = np.sin(2 * np.pi * 12 * t + ph) + 0.02 * rng.normal(size=64)
        x[e, 1] = np.sin(2 * np.pi * 12 * t + ph) + 0.02 * rng.normal(size=64)
        x[e, 2] = np.sin(2 * np.pi * 12 * t + ph - 1.2) + 0.02 * rng.normal(size=64)
    spec = S.spectrum(samples(spark, x), 64, 11 / 64, 13 / 64)
    u = {(r["src"], r["dst"]): r for r in C.undirected(C.cross(spec)).collect()}
    assert u["c0", "c1"]["coherence"] > 0.95 and u["c0", "c1"]["plv"] > 0.95 and u["c0", "c1"]["imcoh"] < 0.1
    assert u["c0", "c2"]["imcoh"] > 0.5 and u["c0", "c2"]["dwpli2"] > 0.8
    d = {(r["src"], r["dst"]): r for r in C.directed(C.cross(spec, ordered=True)).collect()}
    assert d["c0", "c2"]["dwpli"] > 0.9 and d["c2", "c0"]["dwpli"] == 0


def test_rms_hjorth_and_short_epochs(spark):
    x = np.array([[[3, 4], [0, 0]], [[0, 0], [6, 8]]], float)
    assert sorted(r["rms"] for r in S.rms(samples(spark, x)).collect()) == pytest.approx([math.sqrt(25 / 4), math.sqrt(100 / 4)])
    sig = spark.createDataFrame([("Healthy", 1, "c", t, 1.0) for t in range(7)], "grp string, subject int, channel string, t int, v double")
    one = S.epochs(sig, 10).collect()
    assert len(one) == 10 and sum(r["v"] for r in one) == 7 and {r["epoch"] for r in one} == {0}
    two = S.epochs(sig, 4, 2).groupBy("epoch").count().collect()
    assert {r["epoch"]: r["count"] for r in two} == {0: 4, 1: 4}


def test_what_if_golden_values(spark):
    m = E.dense(edges(spark, [[0, 0.2, 0.6], [0.2, 0, 0.4], [0.6, 0.4, 0]]), nodes(spark, 3))
    c = spark.createDataFrame([("Healthy", "s", 0, 0, 0.8), ("Healthy", "s", 1, 0, -0.8), ("Healthy", "s", 2, 1, 0.0)], "grp string, subject string, cand int, node int, amount double")
    done = W.incident_change(m, c).withColumn("d", F.col("new") - F.col("w"))
    total = {r["cand"]: r["s"] for r in done.groupBy("cand").agg(F.sum(F.abs("d")).alias("s")).collect()}
    assert total == pytest.approx({0: 0.8, 1: 0.8, 2: 0.0})
    first = {(r["src"], r["dst"]): r["d"] for r in done.filter("cand = 0").collect()}
    assert first[0, 2] / first[0, 1] == pytest.approx(3) and first[1, 2] == 0
    base = spark.createDataFrame([("Healthy", "s", i, x) for i, x in enumerate([2.0, 3.0, 4.0])], "grp string, subject string, node int, x double")
    g = spark.createDataFrame([("Healthy", "s", 0, 0, 0.0), ("Healthy", "s", 1, 0, math.log(2)), ("Healthy", "s", 2, 0, -math.log(2))], c.schema)
    r = {(x["cand"], x["to"]): x["ratio"] for x in W.log_gain(W.propagation(m, "none"), g, base).collect()}
    assert all(r[0, i] == pytest.approx(1) for i in range(3)) and r[1, 0] == pytest.approx(2) and all(r[1, i] * r[2, i] == pytest.approx(1) for i in range(3))
    ratios = W.log_gain(W.propagation(m, "none"), g, base)
    still = W.coactivation(m, ratios, 1.25, 0.0).filter("abs(new - w) > 1e-12")
    assert still.count() == 0
    chain = E.dense(edges(spark, [[0, 0.6, 0], [0.6, 0, 0.4], [0, 0.4, 0]]), nodes(spark, 3))
    out = {x["to"]: x["final"] for x in W.additive_shift(W.propagation(chain, "none"), g.filter("cand = 1").withColumn("amount", F.lit(0.2)), base).collect()}
    assert out[2] == 4.0 and out[0] == pytest.approx(2.2) and out[1] == pytest.approx(3 + 0.2 * 0.75 * 0.6)


def test_front_and_choice(spark):
    df = spark.createDataFrame([("u", 0, 1.0, 3.0, True), ("u", 1, 2.0, 2.0, True), ("u", 2, 3.0, 3.0, True), ("u", 3, 0.0, 0.0, False)], "k string, cand int, a double, b double, feasible boolean")
    front = W.pareto_front(df, ["k"], ["a", "b"])
    assert sorted(r["cand"] for r in front.collect()) == [0, 1]
    assert W.ideal_choice(front, ["k"], ["a", "b"]).first()["cand"] == 1 and W.weighted_choice(front, ["k"], {"a": 1.0}).first()["cand"] == 0


def test_metrics_and_selection(spark):
    y = spark.createDataFrame([("m", 0, 0.01), ("m", 0, 0.1), ("m", 1, 0.9), ("m", 1, 0.99)], "k string, y_true int, p double")
    m = R.probability_metrics(y, ["k"]).first()
    assert m["auc"] == 1 and m["balanced_accuracy"] == 1
    gate = spark.range(1).select(R.acceptance(F.lit(0.80), F.lit(0.69), F.lit(0.18)).alias("x"), R.acceptance(F.lit(0.80), F.lit(0.69), F.lit(0.18), (0.75, 0.65, 0.2)).alias("y")).first()
    assert (gate["x"], gate["y"]) == ("balanced_accuracy", "")
    c = spark.createDataFrame([("b", 0, 9), ("b", 1, 1), ("b", 2, 9)], "band string, node int, n long")
    rows = {r["node"]: r for r in T.selection_superiority(c, ["band"]).collect()}
    assert rows[1]["top"] == 0 and rows[2]["p"] > 0.4 and rows[1]["p_adj"] >= rows[1]["p"] == pytest.approx(11 / 1024)
    one = T.one_sample_t(spark.createDataFrame([(1, 1.0), (1, 2.0), (1, 3.0), (2, 5.0), (2, 5.0)], "e int, w double"), ["e"]).orderBy("e").collect()
    assert one[0]["p"] == pytest.approx(0.0741799, abs=1e-6) and one[1]["p"] == 0


def test_resampling_is_stable_and_sensible(spark):
    df = spark.createDataFrame([("a", float(v)) for v in range(40)], "k string, value double")
    one, two = (T.bootstrap(df.repartition(n), ["k"], "value", resamples=80).first() for n in (1, 5))
    assert tuple(one) == tuple(two) and one["low"] < 19.5 < one["high"]
    d = spark.createDataFrame([("up", i, 1.0 + i) for i in range(12)] + [("none", i, (-1.0) ** i) for i in range(12)], "k string, unit int, value double")
    p = {r["k"]: r["p"] for r in T.sign_flip(d, ["k"], permutations=400).collect()}
    assert p["up"] < 0.02 and p["none"] > 0.3


def test_models_learn_and_residuals_lose_the_covariate(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(60, 4))
    y = (np.arange(60) % 2).astype(int)
    x[:, 0] += 2.5 * y
    df = spark.createDataFrame([(i, int(y[i]), *map(float, x[i])) for i in range(60)], "subject int, y int, x0 double, x1 double, x2 double, x3 double")
    p = M.out_of_fold(df, 4, k=3)
    assert p.count() == 60 and R.probability_metrics(p.withColumn("k", F.lit(1)), ["k"], "y", "p").first()["auc"] > 0.85
    aged = spark.createDataFrame([(float(a), 2.0 * a + 3, -0.5 * a + 7) for a in range(20, 30)], "age double, e0 double, e1 double")
    out = M.Residualizer("age", ["e0", "e1"]).fit(aged).transform(aged).toPandas()
    assert out["e0"].std() < 1e-9 and out["e1"].std() < 1e-9 and "age" not in out
    pts = spark.createDataFrame([(float(a + rng.normal() * 0.1), float(a)) for a in [0] * 12 + [9] * 12], "u double, v double")
    assert M.select_kmeans(pts, ["u", "v"], 4)[0] == 2


def test_streamed_epochs_equal_batch_ones(spark, tmp_path):
    rows = spark.sql("SELECT timestamp_seconds(1704067200 + id * 60) AS ts, id % 3 AS unit, 'c' AS channel, cast(id % 7 AS double) AS value FROM range(300)")
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    K.start_epoch_quality(stream, str(tmp_path / "out"), str(tmp_path / "cp"), length="1 hour", late="0 seconds").awaitTermination(120)
    got = {tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    batch = {tuple(r) for r in K.epoch_quality(rows, "1 hour").collect()}
    assert got and got <= batch and len(batch) - len(got) <= 3  # the last window stays open


def test_signal_keeps_every_event_type(spark, tmp_path):
    from corvane.sources import adapters

    spark.range(300).selectExpr("1L AS user_id", "concat('e', id) AS event_type", "timestamp_seconds(1704067200 + id) AS ts", "1.0D AS value").write.parquet(f"{tmp_path}/events.parquet")
    assert adapters.signal(spark, str(tmp_path)).select("channel").distinct().count() == 300
