"""Betweenness, partitions and small-worldness on graphs with known answers."""

import numpy as np
import pytest
from corvane.operators import partition as P
from test_operators import edges, nodes


def test_betweenness_of_a_path_and_a_star(spark):
    path = np.zeros((4, 4))
    for i in range(3):
        path[i, i + 1] = path[i + 1, i] = 0.5
    star = np.zeros((4, 4))
    star[0, 1:] = star[1:, 0] = 1.0
    got = {r["node"]: r["value"] for r in P.betweenness(edges(spark, path), 4).collect()}
    assert got == {0: 0, 1: 4, 2: 4, 3: 0}
    assert {r["node"]: r["value"] for r in P.betweenness(edges(spark, star), 4).collect()} == {0: 6, 1: 0, 2: 0, 3: 0}
    square = np.zeros((4, 4))
    for a, b in ((0, 1), (1, 3), (0, 2), (2, 3)):
        square[a, b] = 1.0
    assert {r["node"]: r["value"] for r in P.betweenness(edges(spark, square), 4).collect()} == {0: 0, 1: 0.5, 2: 0.5, 3: 0}


def test_two_strong_pairs_are_two_modules(spark):
    m = np.full((4, 4), 0.05)
    m[0, 1] = m[1, 0] = m[2, 3] = m[3, 2] = 1.0
    np.fill_diagonal(m, 0)
    for _ in range(2):
        got = P.best_partition(edges(spark, m), 4, 5).orderBy("node").collect()
        assert [r["module"] for r in got] == [0, 0, 1, 1]
    lab = np.array([0, 0, 1, 1])
    q = sum(m[np.ix_(lab == k, lab == k)].sum() / m.sum() - m[lab == k].sum() * m[:, lab == k].sum() / m.sum() ** 2 for k in (0, 1))
    assert got[0]["q"] == pytest.approx(q)


def test_a_ring_of_cliques_is_a_small_world(spark):
    m = np.zeros((12, 12))
    for k in range(3):
        m[4 * k : 4 * k + 4, 4 * k : 4 * k + 4] = 1
        m[4 * k, (4 * k + 4) % 12] = m[(4 * k + 4) % 12, 4 * k] = 1
    np.fill_diagonal(m, 0)
    one, two = (P.small_worldness(edges(spark, m), nodes(spark, 12), 3).first()["value"] for _ in range(2))
    assert one == two and one > 1
