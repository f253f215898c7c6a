"""Small cases of what went wrong on larger tables: bins at half seconds, sums of products, residuals, many sources, large margins."""

import glob
import math
import os

import duckdb
import numpy as np
import pytest
from corvane.operators import connectivity as C
from corvane.operators import matching as H
from corvane.operators import pairwise as W
from corvane.operators import resampling as X
from corvane.operators import rollups as R
from corvane.operators import stats as T
from corvane.operators import var as V
from corvane.plans import models, selections
from corvane.sources import adapters as A
from corvane.sources import cohort_files as K
from pyspark.sql import functions as F


def test_signal_takes_the_nearest_second(spark, tmp_path):
    rows = [(1, "a", "2024-01-01 05:59:59.4", 1.0), (1, "a", "2024-01-01 05:59:59.6", 2.0), (1, "b", "2023-12-31 23:59:59.7", 4.0), (2, "b", "2024-01-30 23:59:59.9", 8.0), (3, "b", "2020-01-01 00:00:00", 16.0)]
    spark.createDataFrame(rows, "user_id long, event_type string, ts string, value double").withColumn("ts", F.col("ts").cast("timestamp_ntz")).write.parquet(f"{tmp_path}/events.parquet")
    got = A.signal(spark, str(tmp_path)).collect()
    assert len(got) == 3 * 2 * A.BINS
    assert {(r["subject"], r["channel"], r["t"]): r["v"] for r in got if r["v"]} == {(1, "a", 0): 1.0, (1, "a", 1): 2.0, (1, "b", 0): 4.0}


def _late_events(spark, path: str) -> str:
    rows = [(1, "a", "2024-01-01 11:59:59.4", 1.0), (1, "a", "2024-01-01 11:59:59.6", 2.0), (1, "a", "2024-01-02 23:59:59.7", 4.0)]
    spark.createDataFrame(rows, "user_id long, event_type string, ts string, value double").withColumn("ts", F.col("ts").cast("timestamp_ntz")).write.parquet(f"{path}/events.parquet")
    return str(path)


def _sql_rows(path: str, text: str) -> list[tuple]:
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{path}/events.parquet/*.parquet'")
    return sorted(con.execute(text).fetchall())


def test_sliding_windows_take_the_nearest_second(spark, tmp_path):
    path = _late_events(spark, tmp_path)
    got = sorted(tuple(r) for r in models.k01_event_epochs(spark, path).collect())
    assert got == _sql_rows(path, models.SQL["k01_event_epochs"]) and len(got) == 5


def test_daily_quality_takes_the_nearest_second(spark, tmp_path):
    path = _late_events(spark, tmp_path)
    got = sorted(tuple(r) for r in models.k02_epoch_quality(spark, path).collect())
    assert got == _sql_rows(path, models.SQL["k02_epoch_quality"]) and [r[0] for r in got] == [1704067200, 1704240000]


def test_correlation_with_equal_values_is_none(spark):
    """Sums of tasks with uneven numbers of rows are merged, one of them empty at first; equal values do not vary for all that."""
    x = spark.range(0, 60, 1, 3).select("id", F.explode(F.sequence(F.lit(1), 3 + F.col("id"))).alias("n")).select((F.col("id") % 17 + F.col("n") % 5).cast("double").alias("a"), F.lit(math.log(1e-12)).alias("b"), F.col("id") % 7 > 2, F.col("n") % 3)
    x = x.toDF("a", "b", "u", "w")
    found = x.groupBy("u", "w").agg(C.corr("a", "b").alias("c"), C.corr("b", "a").alias("d"), C.corr("a", "a").alias("e")).collect()
    assert [r[2:] for r in found] == [(None, None, pytest.approx(1.0))] * 6


def test_folds_of_equal_orders_follow_the_ties(spark):
    """Orders that repeat, in tasks of any number: rows of equal order are dealt by subject, so folds do not hang on who arrives first."""
    rows = [(i, i % 2) for i in range(2000)]
    seen = {y: sorted((i % 7, i) for i, z in rows if z == y) for y in (0, 1)}
    want = {i: k % 5 for own in seen.values() for k, (_, i) in enumerate(own)}
    frame = spark.createDataFrame(rows, "subject long, y int").orderBy(F.rand(3))
    for parts in (1, 5):
        found = R.folds(frame.repartition(parts), "y", F.col("subject") % 7, 5, ["subject"])
        assert {r["subject"]: r["fold"] for r in found.collect()} == want


def test_greedy_choice_among_many_sources(spark):
    """More sources than the bound on targets, with repeated names: each target takes the nearest name that is left."""
    rng = np.random.default_rng(3)
    p, q = rng.normal(size=(600, 3)), rng.normal(size=(4, 3))
    names = [f"s{i % 450}" for i in range(600)]
    sources = spark.createDataFrame([("u", names[i], *map(float, p[i])) for i in range(600)], "k string, name string, x double, y double, z double")
    targets = spark.createDataFrame([("u", i, f"t{i}", *map(float, q[i])) for i in range(4)], "k string, ord int, name string, x double, y double, z double")
    unit, scale, used, want = p / np.linalg.norm(p, axis=1)[:, None], np.median(np.linalg.norm(q, axis=1)), set(), []
    for i, t in enumerate(q):
        d = np.round(np.linalg.norm(unit - t / np.linalg.norm(t), axis=1) * scale, 9)
        best = min((d[j], names[j]) for j in range(600) if names[j] not in used)
        used.add(best[1])
        want.append((i, best[1], pytest.approx(best[0], abs=1e-8)))
    assert sorted((r["ord"], r["source"], r["distance"]) for r in H.greedy_unique(sources, targets, ["k"]).collect()) == want


def test_fisher_of_large_and_small_tables(spark):
    """Against all tables by lgamma; work follows the margins, not their square."""
    tables = [(3, 1, 1, 3), (0, 0, 4, 5), (0, 7, 9, 0), (20_400, 20_100, 19_900, 20_300), (60_000, 60_000, 60_000, 60_000)]

    def exact(a, b, c, d):
        lf = lambda n: math.lgamma(n + 1.0)
        ln = lambda x: -lf(x) - lf(a + b - x) - lf(a + c - x) - lf(d - a + x)
        all_ = [ln(x) - ln(a) for x in range(max(0, a - d), min(a + b, a + c) + 1)]
        return min(1.0, sum(math.exp(x) for x in all_ if x <= 1e-7) / sum(math.exp(min(x, 700)) for x in all_))

    got = spark.createDataFrame([(i, *t) for i, t in enumerate(tables)], "i int, a long, b long, c long, d long").withColumn("p", T.fisher(*map(F.col, "abcd"))).orderBy("i").collect()
    assert [r["p"] for r in got] == pytest.approx([exact(*t) for t in tables], abs=1e-7)


def test_gram_of_gaps_repeats_and_values_that_are_not_finite(spark):
    """Against a loop over pairs of samples at the same time."""
    rows = [("g", 1, c, e, k, float(3 * k + ord(c) - 96 + e)) for e in range(2) for c in "abc" for k in range(5) if (c, e, k) != ("b", 0, 3)]
    rows[0], rows[-1] = (*rows[0][:5], None), (*rows[-1][:5], float("inf"))
    rows.append(("g", 1, "d", 1, 7, 2.0))
    got = {(r["i"], r["li"], r["j"], r["lj"]): r["s"] for r in C.gram(spark.createDataFrame(rows, "grp string, subject long, channel string, epoch int, k int, v double"), 1).collect()}
    lags = {}
    for c in "abcd":
        for e in range(2):
            own = sorted((k, v) for _, _, c_, e_, k, v in rows if (c_, e_) == (c, e))
            for at, (k, v) in enumerate(own):
                if k >= 1:
                    lags[c, e, k] = (v, own[at - 1][1] if at else None)
    want = {}
    for (c, e, k), x in lags.items():
        for (d, e_, k_), y in lags.items():
            if (e, k) == (e_, k_):
                for li in (0, 1):
                    for lj in (0, 1):
                        old = want.get((c, li, d, lj))
                        product = None if x[li] is None or y[lj] is None else x[li] * y[lj]
                        want[c, li, d, lj] = product if old is None else old if product is None else old + product
    assert got == want


def test_residuals_need_the_sample_before(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(2, 2, 6))
    rows = [("g", 1, f"c{c}", e, k, float(x[e, c, k])) for e in range(2) for c in range(2) for k in range(6) if (e, c, k) != (1, 1, 2) and not (e == 0 and k == 3)]
    a = {("c0", "c0"): 0.5, ("c0", "c1"): -0.2, ("c1", "c0"): 0.1, ("c1", "c1"): 0.7}
    coef = spark.createDataFrame([("g", 1, 1, t, s, v) for (t, s), v in a.items()], "grp string, subject long, lag int, target string, source string, a double")
    frame = spark.createDataFrame(rows, "grp string, subject long, channel string, epoch int, k int, v double")
    found = V.residuals(frame, coef)
    assert "BroadcastHashJoin" not in found._jdf.queryExecution().toString()
    v = {r[2:5]: r[5] for r in rows}
    want = {(c, e, k): y - sum(a[c, s] * v[s, e, k - 1] for s in ("c0", "c1") if (s, e, k - 1) in v) for (c, e, k), y in v.items() if any((s, e, k - 1) in v for s in ("c0", "c1"))}
    assert {(r["channel"], r["epoch"], r["k"]): r["e"] for r in found.collect()} == pytest.approx(want)


def test_resamples_by_rank_agree_with_drawn_rows(spark):
    """Medians and differences of AUC of every resample against rows drawn one by one; the windows of ranks are exact where they miss, too."""
    rng = np.random.default_rng(6)
    for n in (1, 2, 7, 70_000):
        for b in (1, 9_999):
            rows = np.concatenate(list(X.drawn(b, n, 42)))
            assert rows.tolist() == (T._mixed(np.int64(b), np.arange(1, n + 1)) % n).tolist()
            assert X.middle(lambda: iter([rows]), n) == (np.sort(rows)[(n - 1) // 2], np.sort(rows)[n // 2])
    low = np.zeros(100_000, np.int64)
    assert X.middle(lambda: iter([low]), len(low)) == (0, 0)
    values = rng.integers(0, 9, (11, 2)).astype(float)
    got = {r["_b"]: (r["p"], r["q"]) for r in X.joint_medians(spark.createDataFrame([(i * 3, *map(float, v)) for i, v in enumerate(values)], "unit int, p double, q double"), "unit", ["p", "q"], 230, 42).collect()}
    assert got == {b: tuple(np.median(values[T._mixed(np.int64(b), np.arange(1, 12)) % 11], axis=0)) for b in range(1, 231)}
    scores = [("k", i, i % 3 == 0, float(rng.integers(0, 6)), float(rng.integers(0, 6))) for i in range(20)] + [("none", 1, True, 0.5, 0.5)]
    found = X.auc_draws(spark.createDataFrame([(k, i, int(y), a, b) for k, i, y, a, b in scores], "k string, subject int, y int, a double, b double"), ["k"], 210, 7).collect()
    parts = [np.array([s[3:] for s in scores[:20] if s[2] == y]) for y in (False, True)]
    for b in range(1, 211):
        no, yes = (x[T._mixed(np.int64(b), np.arange(1, len(x) + 1), 7) % len(x)] for x in parts)
        auc = [np.mean((yes[:, None, s] > no[None, :, s]) + 0.5 * (yes[:, None, s] == no[None, :, s])) for s in (0, 1)]
        assert [r["d"] for r in found if (r["k"], r["_b"]) == ("k", b)] == pytest.approx([auc[1] - auc[0]])
    assert all(r["d"] is None for r in found if r["k"] == "none")


def test_signed_sums_take_the_drawn_signs():
    rng = np.random.default_rng(2)
    at, u, v = np.arange(1, 601), rng.integers(-50, 3_000_000_000, 70), rng.normal(size=70)
    signs = np.where(T._mixed(at[:, None], u[None, :]) % 2 == 0, 1.0, -1.0)
    assert T._signed_sums(at, u, v, 42) == pytest.approx(signs @ v, abs=1e-9)


def test_regions_read_the_net_once(spark, monkeypatch):
    """Trade is joined and written once for a query, not once more for the list of its graphs."""
    from corvane.plans import network

    made, stage = [], network.stage_table
    monkeypatch.setattr(network, "stage_table", lambda df, name: made.append(name) or stage(df, name))
    for query in (network.e07_modularity_of_regions, network.e31_module_order):
        made.clear()
        query(spark, "/root/testdata/sf0.001")
        assert made == ["net"]


def test_kernels_take_arrays_of_one_length_together(spark):
    """Lengths mixed in a batch, each against the kernel of its array alone."""
    rng = np.random.default_rng(12)
    rows = [("g", i, "c", 0, rng.normal(size=n).tolist()) for i, n in enumerate([20, 7, 20, 1, 7, 20, 33])]
    frame = spark.createDataFrame(rows, "grp string, subject long, channel string, epoch int, x array<double>").coalesce(1)
    b, a = V.butterworth(4, 0.2, 0.6)
    for table, alone in ((V.band_pass(frame, 2.0, 6.0, 20.0), lambda x: V.zero_phase(b, a, x)), (V.log_envelopes(frame), V.envelope), (V.resample(frame, 3, 2), None)):
        got = {r["subject"]: r["x"] for r in table.collect()}
        assert len(got) == 7
        for _, i, _, _, x in rows:
            assert len(got[i]) == (len(x) if alone else math.ceil(len(x) * 3 / 2))
            assert alone is None or got[i] == pytest.approx(alone(np.array(x)).tolist(), abs=1e-12)
    flat, stacked = rng.normal(size=(5, 40)), []
    for x in flat:  # sample by sample, as one array was filtered before
        z, y = np.zeros(len(a) - 1), []
        for v in x:
            y.append(b[0] * v + z[0])
            z = np.append(z[1:], 0.0) + b[1:] * v - a[1:] * y[-1]
        stacked.append(y)
    assert V._filter(b, a, flat, np.zeros((5, len(a) - 1))) == pytest.approx(np.array(stacked), abs=1e-12)


def test_cohort_scan_has_fewer_files_than_subjects(spark, tmp_path, monkeypatch):
    """200 users in at most a file for each group and shuffle partition, with the subjects that a folder for each of them gives."""
    rows = [(i, i % 200, "ab"[i // 200 % 2], float(i)) for i in range(1700)]
    spark.createDataFrame(rows, "event_id long, user_id long, event_type string, value double").write.parquet(f"{tmp_path}/events.parquet")
    monkeypatch.setattr(selections, "_root", lambda spark, name: f"file://{tmp_path}/cohort")
    got = {r["subject"]: (r["status"], r["samples"], r["channels"]) for r in selections.a01_cohort_scan(spark, str(tmp_path)).collect()}
    assert 0 < len(glob.glob(f"{tmp_path}/cohort/**/*.parquet", recursive=True)) <= 8
    own = {u: [i for i in range(1700) if i % 200 == u] for u in range(200)}
    assert got == {u: ("values", None, None) if u % 7 == 3 and any(i % 3 == 0 for i in x) else ("read", len(x), 2) for u, x in own.items()}


def test_broken_packed_files_set_their_subjects_aside(spark, tmp_path):
    """A file that can't be read, one that is gone and one that lost rows: each subject of theirs is named, and no other."""
    root = f"file://{tmp_path}/cohort"
    rows = [("g", str(s) if s else None, "x", t, float(s + t)) for s in range(40) for t in range(5)]
    samples = spark.createDataFrame(rows, "grp string, subject string, channel string, t long, v double")
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        index = K.write_packed(samples, root)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    assert sorted((r["grp"], r["subject"] or "", r["n"]) for r in index.collect()) == sorted(("g", str(s) if s else "", 5) for s in range(40))
    good, aside = K.scan_cohort(spark, root, 2, index=index)
    assert aside.count() == 0 and sorted(map(str, good.collect())) == sorted(map(str, samples.collect()))
    files = sorted(glob.glob(f"{tmp_path}/cohort/grp=g/*.parquet"))
    assert len(files) == 4
    lost = {r["subject"] for r in index.filter(F.col("file").isin([os.path.basename(f) for f in files[:3]])).collect()}
    short = spark.read.parquet(f"file://{files[2]}").filter("t < 4").coalesce(1)
    short.write.parquet(f"file://{tmp_path}/short")
    for f in files[:3]:
        os.remove(f)
        os.remove(f"{os.path.dirname(f)}/.{os.path.basename(f)}.crc")
    with open(files[0], "wb") as f:
        f.write(b"not a table")
    os.rename(glob.glob(f"{tmp_path}/short/*.parquet")[0], files[2])
    good, aside = K.scan_cohort(spark, root, 2, index=index)
    assert sorted((r["subject"] or "", r["reason"]) for r in aside.collect()) == sorted((s or "", "unreadable") for s in lost)
    assert {r["subject"] for r in good.select("subject").distinct().collect()} == {str(s) if s else None for s in range(40)} - lost


def test_fits_of_many_subjects_are_rows_and_not_groups(spark):
    """Against numpy for 300 subjects of two to four channels, some without a group; no subject is a Python group of its own."""
    rng = np.random.default_rng(7)
    data = {(("g", None)[s % 2], s): rng.normal(size=(2 + s % 3, 12)) for s in range(300)}
    rows = [(g, s, "wxyz"[c], 0, k, float(x[c, k])) for (g, s), x in data.items() for c in range(len(x)) for k in range(12)]
    gram = C.gram(spark.createDataFrame(rows, "grp string, subject long, channel string, epoch int, k int, v double"), 1).cache()
    fits = V.coefficients(gram, 1, 0.5)
    for one in (fits, V.diagnostics(gram, 1), V.conditional_wald(gram, 1), V.spectral_directed(gram, 1, {"all": (0.1, 0.4)}), W.bivariate(gram, 1)):
        assert "FlatMapGroupsInPandas" not in one._jdf.queryExecution().toString()
    got = {(r["grp"], r["subject"], r["target"], r["source"]): r["a"] for r in fits.collect()}
    want = {}
    for (g, s), x in data.items():
        now, past = x[:, 1:], x[:, :-1]
        a = np.linalg.solve(past @ past.T + 0.5 * np.eye(len(x)), past @ now.T)
        want |= {(g, s, "wxyz"[t], "wxyz"[c]): a[c, t] for t in range(len(x)) for c in range(len(x))}
    assert got == pytest.approx(want, rel=1e-9, abs=1e-9)
    gram.unpersist()
