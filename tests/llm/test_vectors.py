import hashlib
import math
import random
from collections import defaultdict

import duckdb
import numpy as np
import pytest
from brute import SF
from corvane.llm import vector_codes, whitening

SCHEMA = "vec_id long, embedding array<float>, label int, code string"


def plain_codes(rows, entries=256, parts=4, rounds=4):
    """rows: (vec_id, embedding, label); Python integers all the way."""
    kept = [(i, [math.floor(1024 * c) for c in e], lab) for i, e, lab in rows if e is not None and all(c is not None and math.isfinite(c) for c in e)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    length = -(-max(len(x) for _, x, _ in kept) // parts)
    cut = lambda x: [(x + [0] * (length * parts - len(x)))[p * length : (p + 1) * length] for p in range(parts)]
    vectors = [cut(x) for _, x, _ in kept]
    books = [[list(v[p]) for v in vectors[:entries]] for p in range(parts)]

    def assign():
        return [[min((sum((a - b) ** 2 for a, b in zip(v[p], c)), k) for k, c in enumerate(books[p])) for p in range(parts)] for v in vectors]

    for _ in range(rounds):
        found = assign()
        for p in range(parts):
            own = defaultdict(list)
            for v, f in zip(vectors, found):
                own[f[p][1]].append(v[p])
            for k, members in own.items():
                books[p][k] = [sum(c) // len(members) for c in zip(*members)]
    found = assign()
    sha = hashlib.sha256(",".join(str(c) for book in books for entry in book for c in entry).encode()).hexdigest()
    by_label = defaultdict(int)
    for (_, _, lab), f in zip(kept, found):
        by_label[lab] += sum(d for d, _ in f)
    return [(i, "".join(f"{k:02x}" for _, k in f), sum(d for d, _ in f), by_label[lab], sha) for (i, _, lab), f in zip(kept, found)]


def in_order(rows):
    return sorted((tuple(r) for r in rows), key=lambda r: tuple((x is not None, x) for x in r))


def random_vectors(n, dims=8, seed=1, spread=3):
    rng = random.Random(seed)
    centres = [[rng.uniform(-1, 1) for _ in range(dims)] for _ in range(5)]
    return [(i, [float(np.float32(rng.choice(centres)[d] + rng.gauss(0, 0.1) * spread)) for d in range(dims)], rng.choice([None, 1, 2])) for i in range(n)]


@pytest.mark.parametrize("entries,listed", [(256, 16), (12, 3), (5, 16), (1, 16), (2, 4)])
def test_codes_equal_plain_rounds(spark, entries, listed):
    rows = random_vectors(160, seed=entries)
    df = spark.createDataFrame([(*r, "x") for r in rows], SCHEMA)
    assert in_order(vector_codes.vector_codes(df, entries=entries, listed=listed).collect()) == in_order(plain_codes(rows, entries))


def test_codes_equal_their_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{SF}/embeddings.parquet'")
    found = con.execute(vector_codes.SQL["op11_vector_codes"])
    df = vector_codes.op11_vector_codes(spark, SF)
    assert df.columns == [d[0] for d in found.description]
    assert in_order(df.collect()) == in_order(found.fetchall())


def test_codes_of_odd_rows(spark):
    rows = random_vectors(30, dims=6, seed=4)
    rows += [(None, rows[0][1], 1), (None, rows[1][1], None), (3, rows[2][1], 1), (3, rows[2][1], 1), (50, None, 1), (51, [1.0, None, 0.0, 0.0, 0.0, 0.0], 1), (52, [float("nan")] * 6, 1), (53, [float("inf")] * 6, 2)]
    rows += [(54, [0.25], 7), (55, [], 7), (56, [1e5] * 6, 8), (57, [-1e5] * 6, 8)]
    df = spark.createDataFrame([(*r, None) for r in rows], SCHEMA)
    assert in_order(vector_codes.vector_codes(df, entries=9, listed=3).collect()) == in_order(plain_codes(rows, 9))
    assert vector_codes.vector_codes(df.filter("vec_id BETWEEN 50 AND 53")).collect() == []
    assert len(vector_codes.vector_codes(spark.createDataFrame([(1, [3e38, 1.0, -3e38, 0.0], 1, "")] * 3, SCHEMA)).collect()) == 3


def test_bounds_settle_parts_without_distances():
    """After small moves nearly all parts settle by their bounds, and entries equal those of a whole search."""
    rng = np.random.default_rng(5)
    book = rng.integers(-1000, 1000, (64, 4))
    x = book[rng.integers(0, 64, 3000)] + rng.integers(-60, 60, (3000, 4))
    own, _, near, lower, outer = vector_codes.whole_search(x, book, 8)
    new = book + rng.integers(-3, 4, book.shape)
    moves = np.sqrt(((new - book) ** 2).sum(axis=1)) * 1.0001
    lower, outer = vector_codes.half_down(lower), vector_codes.half_down(outer)
    got, best, *_, needed = vector_codes.settle(x, new, moves, own, near, lower, outer, 8)
    assert (got == vector_codes.squared(x, new).argmin(axis=1)).all() and (best == vector_codes.squared(x, new).min(axis=1)).all()
    assert (needed == 0).mean() > 0.8 and (needed > 8).mean() < 0.02


# ---------------------------------------------------------------- whitening


def plain_whitening(rows, most=16):
    """rows: (vec_id, embedding) -> sorted (vec_id, deviation), whitened values by row, explained shares, n."""
    kept = [(i, e) for i, e in rows if e is not None and all(c is not None and math.isfinite(c) for c in e)]
    length = max(len(e) for _, e in kept)
    x = np.array([[math.floor(64 * c) + 10**6 for c in list(e) + [0.0] * (length - len(e))] for _, e in kept], np.int64)
    fit = np.unique(x, axis=0)
    n, s = len(fit), fit.sum(axis=0)
    centred = (n * fit - s) / n
    cov = centred.T @ centred / n
    e, u = np.linalg.eigh(cov)
    e, u = e[::-1][:most], u[:, ::-1][:, :most]
    with np.errstate(divide="ignore", invalid="ignore"):
        return [i for i, _ in kept], ((n * x - s) ** 2).sum(axis=1), ((n * x - s) / n) @ u / np.sqrt(np.maximum(e, 0)), np.maximum(e, 0) / np.trace(cov), n


def whitened_equals(got, rows, live=None):
    ids, deviation, values, explained, n = plain_whitening(rows)
    size = values.shape[1]
    live = size if live is None else live
    assert len(got) == len(ids) * size and {r["n"] for r in got} == {n}
    by_id = defaultdict(dict)
    for r in got:
        by_id[r["vec_id"]].setdefault(r["component"], []).append(r)
    for k in range(1, live + 1):
        pairs = [(r["whitened"], v[k - 1]) for i, v in zip(ids, values) if i is not None and ids.count(i) == 1 for r in by_id[i][k]]
        a, b = np.array(pairs).T
        assert min(np.abs(a - b).max(), np.abs(a + b).max()) < 1e-9
        assert {r["explained"] for r in got if r["component"] == k}.pop() == pytest.approx(explained[k - 1], rel=1e-9)
    assert all(r["whitened"] is None and r["explained"] == 0 for r in got if r["component"] > live)
    want = defaultdict(list)
    for i, d in zip(ids, deviation):
        want[i].append(int(d))
    assert {i: sorted(r["deviation"] for r in c[1]) for i, c in by_id.items()} == {i: sorted(v) for i, v in want.items()}
    assert len({r["identity_error"] for r in got}) == 1 and got[0]["identity_error"] < 1e-9


def test_whitening_equals_numpy(spark):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    whitened_equals(whitening.op12_embedding_whitening(spark, SF).collect(), rows)


def test_whitening_in_many_blocks_and_splits(spark):
    """Blocks of 16 rows, one for each task of a product: folding, splits and rows of zeros change nothing."""
    rows = [(i, e) for i, e, _ in random_vectors(700, dims=5, seed=8)]
    rows += [(1000 + k, rows[0][1]) for k in range(300)]
    df = spark.createDataFrame([(*r, 1, "") for r in rows], SCHEMA).repartition(5)
    whitened_equals(whitening.whitened_vectors(df, block=1, meet=1).collect(), rows)


def test_whitening_of_odd_rows(spark):
    rows = [(i, e) for i, e, _ in random_vectors(40, dims=3, seed=9)]
    rows += [(None, rows[0][1]), (7, rows[1][1]), (7, rows[1][1]), (60, None), (61, [1.0, None, 0.0]), (62, [float("nan")] * 3), (63, [float("-inf")] * 3), (64, [0.5]), (65, [])]
    df = spark.createDataFrame([(*r, None, "") for r in rows], SCHEMA)
    whitened_equals(whitening.whitened_vectors(df).collect(), rows)
    assert whitening.whitened_vectors(df.filter("vec_id BETWEEN 60 AND 63")).collect() == []


def test_whitening_without_variance(spark):
    flat = [(i, [*e, 2.0, e[0]]) for i, e, _ in random_vectors(50, dims=3, seed=10)]  # one constant dimension and one that repeats another
    whitened_equals(whitening.whitened_vectors(spark.createDataFrame([(*r, 1, "") for r in flat], SCHEMA)).collect(), flat, live=3)
    same = whitening.whitened_vectors(spark.createDataFrame([(i, [1.0, 2.0], 1, "") for i in range(5)], SCHEMA)).collect()
    assert len(same) == 10 and {(r["n"], r["deviation"], r["whitened"], r["explained"], r["identity_error"]) for r in same} == {(1, 0, None, None, 0.0)}


def test_whitening_of_huge_entries(spark):
    rows = [(i, [float(np.float32(1e9 * math.sin(i * 7 + d))) for d in range(2)], 1, "") for i in range(200)]
    got = whitening.whitened_vectors(spark.createDataFrame(rows, SCHEMA)).collect()
    x = [[math.floor(64 * c) for c in r[1]] for r in rows]
    s = [sum(c) for c in zip(*x)]
    exact = {r[0]: sum((200 * a - b) ** 2 for a, b in zip(v, s)) for r, v in zip(rows, x)}
    assert {r["vec_id"]: r["deviation"] for r in got} == {i: v if v < 1 << 63 else None for i, v in exact.items()}
