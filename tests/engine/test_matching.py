"""Matching against all alignments, greedy choices against a loop, concentration against exact chances, broken files in a cohort."""

import itertools
import math
import os
import random
from urllib.parse import unquote

import numpy as np
import pytest
from corvane.operators import concentration as Q
from corvane.operators import matching as H
from corvane.sources import cohort_files as K
from pyspark.sql import functions as F


def least_total(few, many):
    """Least total difference when all of `few` are matched, over all order-preserving alignments."""
    few, many = sorted(few), sorted(many)
    best = [0.0] * (len(many) + 1)
    for x in few:
        row = [math.inf] * (len(many) + 1)
        for j, y in enumerate(many, 1):
            row[j] = min(row[j - 1], best[j - 1] + abs(x - y))
        best = row
    return min(best)


def test_order_preserving_alignments_hold_the_least_total():
    rng = random.Random(1)
    for _ in range(60):
        few, many = [rng.randrange(9) for _ in range(3)], [rng.randrange(9) for _ in range(5)]
        assert least_total(few, many) == min(sum(abs(a - b) for a, b in zip(few, p)) for p in itertools.permutations(many, 3))


def test_counts_by_age_give_the_least_total():
    rng = random.Random(2)
    for _ in range(1500):
        span = rng.choice([3, 10, 60])
        sides = sorted(([rng.randrange(span) / rng.choice([1, 2]) for _ in range(rng.randrange(0, 25))] for _ in range(2)), key=len)
        ages = sorted(set(sides[0] + sides[1]))
        if not ages:
            continue
        few, many = ([s.count(a) for a in ages] for s in sides)
        alone = H.unmatched(ages, few, many)
        assert all(0 <= x <= n for x, n in zip(alone, many)) and sum(alone) == len(sides[1]) - len(sides[0])
        kept = [a for a, n, x in zip(ages, many, alone) for _ in range(n - x)]
        assert sum(abs(a - b) for a, b in zip(sorted(sides[0]), kept)) == pytest.approx(least_total(*sides))


def test_age_matches(spark):
    rng = random.Random(3)
    people = [(i, rng.randrange(2), rng.choice(["f", "m"]), float(rng.randrange(20, 40))) for i in range(150)]
    people += [(1000 + i, 1, "f", 30.0) for i in range(60)] + [(2000, 0, "x", 50.0), (2001, None, "f", 30.0), (2002, 1, "f", None)]
    got = H.age_matches(spark.createDataFrame(people, "subject long, side int, stratum string, age double").repartition(5)).collect()
    by_id = {p[0]: p for p in people}
    assert len({r["subject0"] for r in got}) == len({r["subject1"] for r in got}) == len(got)
    for r in got:
        a, b = by_id[r["subject0"]], by_id[r["subject1"]]
        assert (a[1], b[1]) == (0, 1) and a[2] == b[2] == r["stratum"] and abs(a[3] - b[3]) == r["difference"]
    for s in "fm":
        sides = sorted(([p[3] for p in people if p[1] == k and p[2] == s and p[3] is not None] for k in (0, 1)), key=len)
        own = [r["difference"] for r in got if r["stratum"] == s]
        assert len(own) == len(sides[0]) and sum(own) == pytest.approx(least_total(*sides))
    assert H.age_matches(spark.createDataFrame([], "subject long, side int, stratum string, age double")).collect() == []


def test_greedy_choices_use_up_sources(spark):
    rng = random.Random(4)
    point = lambda: tuple(rng.choice([-1.0, 0.0, 0.5, 1.0]) for _ in range(3))
    sources, targets = [("u", f"s{i}", *point()) for i in range(7)] + [("v", "only", 1.0, 0.0, 0.0)], [("u", i, f"t{i}", *point()) for i in range(9)] + [("v", 5, "b", 0.0, 1.0, 0.0), ("v", 2, "a", 0.0, 0.0, 1.0)]
    got = H.greedy_unique(spark.createDataFrame(sources, "k string, name string, x double, y double, z double"), spark.createDataFrame(targets, "k string, ord int, name string, x double, y double, z double"), ["k"])
    want = []
    for key in "uv":
        unit = lambda p: np.array(p) / np.linalg.norm(p)
        own = {n: unit(p) for k, n, *p in sources if k == key and any(p)}
        asked = sorted((o, n, p) for k, o, n, *p in targets if k == key and any(p))
        scale = np.median([np.linalg.norm(p) for _, _, p in asked])
        for o, n, p in asked:
            if own:
                d, s = min((round(float(np.linalg.norm(v - unit(p)) * scale), 9), s) for s, v in own.items())
                own.pop(s)
                want.append((key, o, n, s, pytest.approx(d, abs=1e-8)))
    assert sorted(map(tuple, got.collect())) == want
    with pytest.raises(ValueError):
        H.greedy_unique(spark.createDataFrame(sources, "k string, name string, x double, y double, z double"), spark.createDataFrame(targets, "k string, ord int, name string, x double, y double, z double"), ["k"], most=5)


def test_concentration_agrees_with_exact_chances(spark):
    counts = spark.createDataFrame([("a", 1, 6), ("a", 2, 2), ("a", 3, 0), ("b", 1, 3), ("b", 2, 3), ("b", 3, 3)], "key string, node int, c long")
    got = {r["key"]: r for r in Q.uniform_concentration(counts, 3, 40_000).collect()}
    for key, own in (("a", (6, 2, 0)), ("b", (3, 3, 3))):
        n = sum(own)
        entropy = lambda c: abs(sum(-x / n * math.log(x / n) for x in c if x)) / math.log(3)
        ways = [(math.factorial(n) / math.prod(map(math.factorial, c)) / 3**n, c) for c in itertools.product(range(n + 1), repeat=3) if sum(c) == n]
        r = got[key]
        assert (r["n"], r["top_share"], r["entropy"]) == (n, pytest.approx(max(own) / n), pytest.approx(entropy(own)))
        assert r["p_top"] == pytest.approx(sum(p for p, c in ways if max(c) >= max(own)), abs=0.01)
        assert r["p_entropy"] == pytest.approx(sum(p for p, c in ways if entropy(c) <= entropy(own) + 1e-12), abs=0.01)
    again = {r["key"]: r for r in Q.uniform_concentration(counts.repartition(3), 3, 40_000).collect()}
    assert got == again


def test_a_broken_subject_is_set_aside_alone(spark, tmp_path):
    root = f"file://{tmp_path}/cohort"
    rows = [("Healthy" if s % 2 else "Patient", str(s) if s else "a b/c", c, t, float(s + t)) for s in range(6) for c in ("x", "y") for t in range(5)]
    rows = [r for r in rows if not (r[1] == "4" and r[2] == "y" and r[3] > 0)] + [("Healthy", "7", "x", 0, float("inf")), ("Healthy", "7", "x", 1, 1.0)]
    K.write_cohort(spark.createDataFrame(rows, "grp string, subject string, channel string, t long, v double"), root)
    for folder, _, names in os.walk(f"{tmp_path}/cohort"):
        if folder.endswith("subject=3"):
            for n in names:
                if n.endswith(".parquet"):
                    with open(f"{folder}/{n}", "wb") as f:
                        f.write(b"not a table")
                else:
                    os.remove(f"{folder}/{n}")
    good, aside = K.scan_cohort(spark, root, least=2)
    assert sorted(map(tuple, aside.collect())) == [("Healthy", "3", "unreadable"), ("Healthy", "7", "values"), ("Patient", "4", "short")]
    assert {r["subject"] for r in good.select("subject").distinct().collect()} == {"1", "2", "5", "a b/c"} and good.count() == 40


def test_epoch_sink_has_an_index_and_prunes(spark, tmp_path):
    root = f"file://{tmp_path}/epochs"
    rows = [(g, b, s, c, e, [float(s + e)] * 3) for g, s in (("Healthy", 1), ("Patient", 2)) for b in ("alpha", "beta") for c in ("x", "y") for e in range(4)]
    index = K.write_epochs(spark.createDataFrame(rows, "grp string, band string, subject long, channel string, epoch int, x array<double>"), root, 250.0)
    own = index.collect()
    assert len(own) == 4 and all((r["fs"], r["channels"], r["epochs"], r["samples"]) == (250.0, 2, 4, 24) for r in own)
    assert all(os.path.exists("/" + unquote(r["path"]).removeprefix("file:").lstrip("/")) for r in own)
    one = K.read_epochs(spark, root).filter("band = 'alpha' AND grp = 'Patient'")
    plan = one._jdf.queryExecution().toString()
    assert "PartitionFilters: [" in plan and "alpha" in plan.split("PartitionFilters: [")[1].split("]")[0]
    assert one.count() == 8 and len(one.select(F.col("_metadata.file_path")).distinct().collect()) == 1
