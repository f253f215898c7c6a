import random

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from brute import SF, words
from corvane.llm import simhash


def fingerprint(text, size=4):
    w = [bytes(c + 32 if 65 <= c <= 90 else c for c in x) for x in words(text)]
    if not w:
        return 0
    k = min(size, len(w))
    hashes = [xxhash.xxh64_intdigest(b" ".join(w[i : i + k]), 42) for i in range(len(w) - k + 1)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(fps, bits):
    """The class of each fingerprint, as the least position that links reach, from all pairs."""
    root = list(range(len(fps)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, x in enumerate(fps):
        for j in range(i):
            if (x ^ fps[j]).bit_count() <= bits:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(i) for i in range(len(fps))]


def expected(rows, bits=4):
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    fps = [fingerprint(t) for _, t in rows]
    return [(i, f"{f:016x}", rows[g][0]) for (i, _), f, g in zip(rows, fps, groups(fps, bits))]


def in_order(rows):
    return sorted((tuple(r) for r in rows), key=lambda r: tuple((x is not None, x) for x in r))


def test_equals_all_pairs_on_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert in_order(simhash.op13_simhash_dedup(spark, SF).collect()) == in_order(expected([(r["doc_id"], r["text"]) for r in docs.collect()]))


@pytest.mark.parametrize("bits", [0, 1, 3, 4, 7])
def test_grid_connects_what_all_pairs_connect(spark, bits):
    rng = random.Random(bits)
    fps = {rng.getrandbits(64) for _ in range(40)}
    for x in list(fps):
        for _ in range(rng.randrange(6)):
            for b in rng.sample(range(64), rng.randrange(1, bits + 3)):
                x ^= 1 << b
            fps.add(x)
    fps = sorted(fps)
    df = spark.createDataFrame([(x - (1 << 64) if x >> 63 else x,) for x in fps], "fp long")
    at = {x: k for k, x in enumerate(fps)}
    links = [(at[x % (1 << 64)], at[y % (1 << 64)]) for x, y in simhash.grid_links(df, bits).collect()]
    assert all((fps[x] ^ fps[y]).bit_count() <= bits for x, y in links)
    root = list(range(len(fps)))
    for _ in fps:
        for x, y in links:
            root[x] = root[y] = min(root[x], root[y])
    assert root == groups(fps, bits)


def test_crowded_cell_in_blocks(spark):
    """A chain of fingerprints, each four bits from the next, among thousands in one region: the chain isn't broken by blocks."""
    rng = random.Random(2)
    base, free = rng.getrandbits(64), rng.sample(range(64), 14)
    fps = sorted({base ^ sum(1 << b for b in free if rng.random() < 0.5) for _ in range(1500)})
    df = spark.createDataFrame([(x - (1 << 64) if x >> 63 else x,) for x in fps], "fp long")
    links = simhash.grid_links(df, 4, block=16).collect()
    at = {x: k for k, x in enumerate(fps)}
    root = list(range(len(fps)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for x, y in links:
        assert (x % (1 << 64) ^ y % (1 << 64)).bit_count() <= 4
        a, b = sorted((find(at[x % (1 << 64)]), find(at[y % (1 << 64)])))
        root[b] = a
    assert [find(k) for k in range(len(fps))] == groups(fps, 4)


def test_counts_bound_the_distance_from_below():
    rng = np.random.default_rng(1)
    x, y = (rng.integers(0, 1 << 63, 20000, np.uint64) * np.uint64(2) + rng.integers(0, 2, 20000, np.uint64) for _ in range(2))
    plain = lambda v: np.array([[(int(a) >> 2 * k & 3).bit_count() for k in range(32)] for a in v[:500]])
    manhattan = np.bitwise_count(simhash.counts(x) ^ simhash.counts(y))
    assert (manhattan[:500] == np.abs(plain(x) - plain(y)).sum(axis=1)).all() and (manhattan <= np.bitwise_count(x ^ y)).all()


def test_odd_rows(spark):
    t = "One two three four five six seven"
    rows = [(None, t), (5, t.upper()), (5, "x"), (6, ""), (7, None), (8, " \n\t"), (9, "x"), (9, "x"), (10, "A b"), (3, "word " * 400_000)]
    docs = spark.createDataFrame([(i, x, "f") for i, x in rows], "doc_id long, text string, fp string")
    assert in_order(simhash.simhash_dedup(docs).collect()) == in_order(expected(rows))
    assert simhash.simhash_dedup(docs.limit(0)).collect() == []


def test_fingerprints_do_not_depend_on_blocks(monkeypatch):
    rng = random.Random(3)
    texts = [" ".join(str(rng.randrange(50)) for _ in range(rng.randrange(0, 300))) for _ in range(60)]
    want = [fingerprint(t) for t in texts]
    for group in (1, 500, 1 << 20):
        monkeypatch.setattr(simhash, "GROUP", group)
        assert simhash.fingerprints(pa.array(texts)).tolist() == want
