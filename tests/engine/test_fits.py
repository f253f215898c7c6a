"""Many models at once, discriminants, votes and calibration against plain numpy; row numbers against a window."""

from itertools import combinations

import numpy as np
import pytest
from corvane.operators import discriminants as D
from corvane.operators import manyfits as X
from corvane.operators import ranks
from pyspark.sql import Window
from pyspark.sql import functions as F

RNG = np.random.default_rng(11)
N, P = 240, 5
Y = (RNG.random(N) < 0.45).astype(int)
DATA = RNG.normal(size=(N, P)) * [1, 3, 0.5, 2, 1] + np.outer(Y, [0.8, 0.0, 0.4, -1.0, 0.0]) + [0, 5, 0, -2, 1]
FOLD = np.arange(N) % 4


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame([(i, int(Y[i]), DATA[i].tolist(), int(FOLD[i])) for i in range(N)], "subject long, y int, x array<double>, fold int").repartition(3).cache()


def ridge_fit(x, y, c):
    z, w = np.c_[x, np.ones(len(x))], np.zeros(x.shape[1] + 1)
    keep = np.r_[np.ones(x.shape[1]), 0]
    for _ in range(60):
        p = 1 / (1 + np.exp(-z @ w))
        w = w - np.linalg.solve(c * (z * (p * (1 - p))[:, None]).T @ z + np.diag(keep), c * z.T @ (p - y) + keep * w)
    return w


def test_all_triplets_equal_separate_fits(rows):
    want = []
    for t in combinations(range(P), 3):
        shares = []
        for k in range(4):
            a, b = DATA[FOLD != k][:, t], DATA[FOLD == k][:, t]
            m, s = a.mean(axis=0), a.std(axis=0)
            w = ridge_fit((a - m) / s, Y[FOLD != k], 1.0)
            shares.append((((b - m) / s @ w[:3] + w[3] > 0) == (Y[FOLD == k] == 1)).mean())
        want.append((t, np.mean(shares), np.std(shares), w[:3]))
    want.sort(key=lambda v: -round(v[1], 12))
    got = sorted(X.triplet_search(rows, P, 4).collect(), key=lambda r: r["rank"])
    assert [(r["a"], r["b"], r["c"]) for r in got] == [w[0] for w in want] and len(got) == 10
    for r, w in zip(got, want):
        assert (r["accuracy"], r["sd"]) == pytest.approx((w[1], w[2])) and [r["wa"], r["wb"], r["wc"]] == pytest.approx(w[3], abs=1e-7)


def test_nested_folds_choose_and_predict_like_separate_fits(rows):
    got = X.nested_folds(rows.drop("fold"), P, k=3, inner=3, grid=(0.01, 1.0), order=lambda _: F.col("subject")).collect()
    assert sorted(r["subject"] for r in got) == list(range(N))
    fold = {r["subject"]: r["fold"] for r in got}
    assert all(fold[i] == sum(Y[:i] == Y[i]) % 3 for i in range(N))
    for o in range(3):
        own = [r for r in got if r["fold"] == o]
        train = [i for i in range(N) if fold[i] != o]
        c = {r["c"] for r in own}.pop()
        m, s = DATA[train].mean(axis=0), DATA[train].std(axis=0)
        w = ridge_fit((DATA[train] - m) / s, Y[train], c)
        for r in own:
            assert r["p"] == pytest.approx(1 / (1 + np.exp(-((DATA[r["subject"]] - m) / s @ w[:P] + w[P]))), abs=1e-7)


def test_a_test_row_does_not_enter_its_folds_slope(spark, rows):
    age = np.linspace(20, 80, N)
    with_age = [(i, int(Y[i]), [*map(float, DATA[i] + 0.05 * age[i]), float(age[i])], int(FOLD[i])) for i in range(N)]
    moved = [(i, y, [1000.0 * v for v in x[:-1]] + [5.0] if f == 0 else x, f) for i, y, x, f in with_age]
    schema = "subject long, y int, x array<double>, fold int"
    one, two = (X.scales(X.in_folds(spark.createDataFrame(d, schema), 4), 4, P, True) for d in (with_age, moved))
    assert one.slope[0] == pytest.approx(two.slope[0]) and one.centre[0] == two.centre[0] and one.sd[0] == pytest.approx(two.sd[0])
    train = FOLD != 0
    x = DATA[train] + 0.05 * age[train, None]
    slope = [np.polyfit(age[train], x[:, j], 1)[0] for j in range(P)]
    assert one.slope[0] == pytest.approx(slope) and one.sd[0] == pytest.approx((x - np.outer(age[train], slope)).std(axis=0))
    assert not np.allclose(one.slope[1], two.slope[1])


def test_neighbours_vote_by_distance(spark, rows):
    got = {r["ask"]: (r["n"], r["p"]) for r in D.knn(rows.filter("subject % 10 = 0").select(F.col("subject").alias("ask"), "x"), rows, 7, block=5).collect()}
    assert len(got) == 24
    for i, (n, p) in got.items():
        d = np.sqrt(((DATA - DATA[i]) ** 2).sum(axis=1))
        d[i] = np.inf
        near = np.argsort(d, kind="stable")[:7]
        assert n == 7 and p == pytest.approx((Y[near] / d[near]).sum() / (1 / d[near]).sum())
    few = spark.createDataFrame([(1, 1, [0.0]), (2, 0, [0.0]), (3, 1, [0.0]), (4, 0, [2.0])], "subject long, y int, x array<double>")
    asked = spark.createDataFrame([(1, [0.0]), (9, [2.0]), (8, [1.0])], "ask long, x array<double>")
    assert {r["ask"]: (r["n"], r["p"]) for r in D.knn(asked, few, 3).collect()} == {1: (3, 0.5), 9: (3, 0.0), 8: (3, pytest.approx(2 / 3))}
    assert D.knn(asked.limit(0), few, 3).collect() == []


@pytest.mark.parametrize("share", [None, 0.2])
def test_discriminant_equals_numpy(rows, share):
    cov, means, prior = np.zeros((P, P)), [], []
    for c in (0, 1):
        x = DATA[Y == c]
        z = x - x.mean(axis=0)
        s = z.std(axis=0) if share is None else np.ones(P)
        z = z / s
        emp, n = z.T @ z / len(z), len(z)
        part = share
        if share is None:  # over all pairs of columns, as the estimator is defined
            mu = np.trace(emp) / P
            d2 = ((emp - mu * np.eye(P)) ** 2).sum() / P
            b2 = sum(((np.outer(v, v) - emp) ** 2).sum() for v in z) / n**2 / P
            part = min(b2, d2) / d2
        cov += n / N * s[:, None] * ((1 - part) * emp + part * np.trace(emp) / P * np.eye(P)) * s
        means.append(x.mean(axis=0))
        prior.append(n / N)
    w = np.linalg.solve(cov, np.array(means).T).T
    edge = [-0.5 * m @ v + np.log(p) for m, v, p in zip(means, w, prior)]
    coefficients, intercept = D.discriminant(rows, P, share)
    assert coefficients == pytest.approx(w[1] - w[0], rel=1e-7) and intercept == pytest.approx(edge[1] - edge[0], rel=1e-7)
    got = {r["subject"]: r["f"] for r in rows.select("subject", D.linear_score("x", coefficients, intercept).alias("f")).collect()}
    assert [got[i] for i in range(N)] == pytest.approx((DATA @ coefficients + intercept).tolist())


def test_sigmoids_of_all_keys_minimise_their_loss(spark):
    f = RNG.normal(size=300) * 2
    y = (RNG.random(300) < 1 / (1 + np.exp(-(1.5 * f - 0.5)))).astype(int)
    fold = np.arange(300) % 3
    got = {r["fold"]: (r["a"], r["b"]) for r in D.platt(spark.createDataFrame([(int(k), int(v), float(x)) for k, v, x in zip(fold, y, f)], "fold int, y int, f double"), ["fold"]).collect()}
    for k, (a, b) in got.items():
        own, yes = f[fold == k], y[fold == k] == 1
        t = np.where(yes, (yes.sum() + 1) / (yes.sum() + 2), 1 / ((~yes).sum() + 2))
        p = 1 / (1 + np.exp(-(a * own + b)))
        assert abs((p - t).sum()) < 1e-6 and abs(((p - t) * own).sum()) < 1e-6 and a > 0


def test_numbers_equal_a_window(spark):
    df = spark.createDataFrame([(None if i % 11 == 0 else i % 3 if i % 2 else 7, (i * 37) % 101, i) for i in range(500)], "k int, v int, i long").repartition(4)
    want = df.withColumn("n", F.row_number().over(Window.partitionBy("k").orderBy("v", "i")))
    assert sorted(map(str, ranks.numbered(df, ["k"], ["v", "i"]).collect())) == sorted(map(str, want.withColumn("n", F.col("n").cast("long")).collect()))
    assert [r["n"] for r in ranks.numbered(df.limit(9), [], ["i"]).orderBy("i").collect()] == list(range(1, 10))
    assert ranks.numbered(df.limit(0), ["k"], ["i"]).collect() == []
