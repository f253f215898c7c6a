"""Queries over trade networks: edge utilities and graph measures, each with its DuckDB text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corvane.functions.stages import stage_table
from corvane.operators import edges as E
from corvane.operators import graph as G
from corvane.sources import adapters as A

KEY = E.KEY
_ROUND = 6


def r(name: str, digits: int = _ROUND):
    return F.round(F.col(name), digits).alias(name)


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("node"))


def raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.sanitise(A.edge(spark, sf_dir))


def matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Min-max normalised dense matrices of all graphs, diagonal included."""
    return E.normalise(E.dense(raw(spark, sf_dir), nodes(spark, sf_dir)))


def net(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positive normalised edges as a stage table: the measures read them several times."""
    return stage_table(matrix(spark, sf_dir).filter("w > 0"), "net")


_CLEAN = """clean AS (SELECT grp, subject, src, dst, CASE WHEN src = dst OR w < 0 THEN 0 ELSE w END AS w FROM edge),
    graphs AS (SELECT DISTINCT grp, subject FROM edge),
    grid AS (SELECT g.grp, g.subject, a.n_nationkey AS src, b.n_nationkey AS dst, coalesce(c.w, 0.0) AS w
        FROM graphs g, nation a, nation b LEFT JOIN clean c ON c.grp = g.grp AND c.subject = g.subject AND c.src = a.n_nationkey AND c.dst = b.n_nationkey),
    matrix AS (SELECT grp, subject, src, dst, CASE WHEN max(w) OVER g > min(w) OVER g THEN (w - min(w) OVER g) / (max(w) OVER g - min(w) OVER g) ELSE 0.0 END AS w
        FROM grid WINDOW g AS (PARTITION BY grp, subject)),
    net AS (SELECT * FROM matrix WHERE w > 0)"""


def _sql(body: str, *more: str) -> str:
    return A.sql("edge", body, _CLEAN, *more)


_N = "(SELECT count(*) FROM nation)"
_DIST = ["d0 AS MATERIALIZED (SELECT grp, subject, src, dst, min(1 / w) AS d FROM net WHERE src <> dst GROUP BY ALL)"]
for _k in range(5):
    _DIST.append(
        f"d{_k + 1} AS MATERIALIZED (SELECT grp, subject, src, dst, min(d) AS d FROM (SELECT * FROM d{_k} UNION ALL SELECT a.grp, a.subject, a.src, b.dst, a.d + b.d FROM d{_k} a JOIN d{_k} b ON a.grp = b.grp AND a.subject = b.subject AND a.dst = b.src WHERE a.src <> b.dst) GROUP BY ALL)"
    )
_CYCLES = [
    "sym AS MATERIALIZED (SELECT grp, subject, src, dst, sum(c) AS s FROM (SELECT grp, subject, src, dst, cbrt(w) AS c FROM net UNION ALL SELECT grp, subject, dst, src, cbrt(w) FROM net) GROUP BY ALL)",
    "cyc AS (SELECT a.grp, a.subject, a.src AS node, sum(a.s * b.s * c.s) / 2 AS cycles FROM sym a JOIN sym b ON a.grp = b.grp AND a.subject = b.subject AND a.dst = b.src JOIN sym c ON b.grp = c.grp AND b.subject = c.subject AND b.dst = c.src AND c.dst = a.src GROUP BY ALL)",
    "deg AS (SELECT grp, subject, node, count(*) AS deg FROM (SELECT grp, subject, src AS node FROM net UNION ALL SELECT grp, subject, dst FROM net) GROUP BY ALL)",
    "rec AS (SELECT a.grp, a.subject, a.src AS node, count(*) AS rec FROM net a JOIN net b ON a.grp = b.grp AND a.subject = b.subject AND a.src = b.dst AND a.dst = b.src GROUP BY ALL)",
    "tri AS (SELECT g.grp, g.subject, n.n_nationkey AS node, coalesce(cycles, 0) AS cycles, coalesce(deg, 0) * (coalesce(deg, 0) - 1) - 2 * coalesce(rec, 0) AS possible FROM graphs g CROSS JOIN nation n LEFT JOIN cyc ON cyc.grp = g.grp AND cyc.subject = g.subject AND cyc.node = n.n_nationkey LEFT JOIN deg ON deg.grp = g.grp AND deg.subject = g.subject AND deg.node = n.n_nationkey LEFT JOIN rec ON rec.grp = g.grp AND rec.subject = g.subject AND rec.node = n.n_nationkey)",
]
_WEIGHTS = "weights AS (SELECT * FROM matrix WHERE src <> dst)"


def b13_sanitised_edges(spark, sf):
    return raw(spark, sf).select(*KEY, "src", "dst", r("w", 4))


def b14_edge_lengths(spark, sf):
    return E.lengths(matrix(spark, sf)).select(*KEY, "src", "dst", r("d"))


def b15_off_diagonal_weights(spark, sf):
    return E.dense(raw(spark, sf), nodes(spark, sf), diagonal=False).select(*KEY, "src", "dst", r("w", 4))


def b16_minmax(spark, sf):
    return matrix(spark, sf).select(*KEY, "src", "dst", r("w"))


def b16_maxabs(spark, sf):
    return E.normalise(E.dense(raw(spark, sf), nodes(spark, sf)), "maxabs").select(*KEY, "src", "dst", r("w"))


def b17_zscore(spark, sf):
    return E.normalise(E.dense(raw(spark, sf), nodes(spark, sf)), "zscore").select(*KEY, "src", "dst", r("w"))


def b18_threshold_percentile(spark, sf):
    return E.threshold(E.dense(raw(spark, sf), nodes(spark, sf)), "percentile", 90).select(*KEY, "src", "dst", r("w", 4))


def b18_threshold_sd(spark, sf):
    return E.threshold(matrix(spark, sf), "sd", 1.5).select(*KEY, "src", "dst", r("w"))


def b19_binarised(spark, sf):
    return E.binarise(matrix(spark, sf), 0.05).select(*KEY, "src", "dst", "w")


def b20_symmetrised(spark, sf):
    m = stage_table(matrix(spark, sf), "matrix")
    back = m.select(*KEY, F.col("dst").alias("src"), F.col("src").alias("dst"), F.col("w").alias("v"))
    return m.join(back, [*KEY, "src", "dst"]).select(*KEY, "src", "dst", *[F.round(E.symmetric(F.col("w"), F.col("v"), how), 6).alias(how) for how in ("average", "max", "min")])


def b21_edge_vector(spark, sf):
    v = E.edge_vector(matrix(spark, sf))
    return v.select(*KEY, "n", F.concat_ws(",", F.transform("vector", lambda x: F.round(x * 1000000).cast("long").cast("string"))).alias("vector"))


def b22_asymmetric_cells(spark, sf):
    return E.asymmetric_cells(matrix(spark, sf))


def b23_vector_to_edges(spark, sf):
    return E.vector_edges(E.edge_vector(matrix(spark, sf), directed=False)).select(*KEY, "src", "dst", r("w"))


def b24_transformations(spark, sf):
    return E.transformations(E.symmetrise(matrix(spark, sf))).select(*KEY, "src", "dst", r("natural"), r("mean"), r("centred"), r("rank"))


def d35_matrix_quality(spark, sf):
    return E.quality_report(matrix(spark, sf)).select(*KEY, "n_bad", "all_zero", r("share_zero"), r("share_one"), r("mean_w"), r("sd_w"), r("asymmetry"))


def _distances(spark, sf):
    e = net(spark, sf)
    n = nodes(spark, sf).count()
    return e, G.distances(e, n), n


def e01_distances(spark, sf):
    return _distances(spark, sf)[1].select(*KEY, "src", "dst", r("d"))


def e02_global_efficiency(spark, sf):
    e, d, n = _distances(spark, sf)
    return G.global_efficiency(e, d, n).select(*KEY, r("value"))


def e05_clustering(spark, sf):
    return G.clustering(net(spark, sf), nodes(spark, sf)).select(*KEY, r("value"))


def e06_transitivity(spark, sf):
    return G.transitivity(net(spark, sf), nodes(spark, sf)).select(*KEY, r("value"))


def e08_mean_strength(spark, sf):
    return G.mean_strength(matrix(spark, sf), nodes(spark, sf).count()).select(*KEY, r("value"))


def e10_rich_club(spark, sf):
    return G.rich_club(net(spark, sf), 20).select(*KEY, r("value"))


def e11_assortativity(spark, sf):
    return G.assortativity(net(spark, sf)).select(*KEY, r("value"))


def e12_spectral_radius(spark, sf):
    return G.spectral_radius(net(spark, sf)).select(*KEY, r("value", 4))


def e14_diameter(spark, sf):
    e, d, _ = _distances(spark, sf)
    return G.diameter(e, d).select(*KEY, r("value"))


def e15_e21_weight_statistics(spark, sf):
    return G.weight_statistics(matrix(spark, sf), nodes(spark, sf)).select(*KEY, *[r(c) for c in ("density", "mean", "sd", "median", "max", "min", "cv")])


def e22_path_length(spark, sf):
    e, d, _ = _distances(spark, sf)
    return G.path_length(e, d).select(*KEY, r("value"))


def e25_node_measures(spark, sf):
    e, n = net(spark, sf), nodes(spark, sf)
    s = G.node_strength(e, n).join(G.node_clustering(e, n).withColumnRenamed("value", "clustering"), [*KEY, "node"])
    return s.select(*KEY, "node", *[r(c) for c in ("s_in", "s_out", "s_total", "balance", "clustering")])


def e26_node_summary(spark, sf):
    s = G.node_strength(net(spark, sf), nodes(spark, sf))
    v = F.coalesce(F.nanvl("s_total", F.lit(0.0)), F.lit(0.0))
    return s.groupBy(*KEY).agg(F.round(F.avg(v), 6).alias("mean"), F.round(F.stddev_pop(v), 6).alias("sd"), F.round(F.percentile(v, 0.5), 6).alias("median"), F.round(F.max(v), 6).alias("max"), F.round(F.min(v), 6).alias("min"))


def _regions(spark, sf, e):
    n = A.table(spark, sf, "nation").select(F.col("n_nationkey").alias("node"), F.col("n_regionkey").alias("module"))
    return n.crossJoin(G.graphs(e))


def e07_modularity_of_regions(spark, sf):
    e = net(spark, sf)
    return G.modularity(e, _regions(spark, sf, e)).select(*KEY, r("value"))


def e31_module_order(spark, sf):
    e = net(spark, sf)
    s = G.node_strength(e, nodes(spark, sf)).withColumn("s_total", F.round("s_total", 9))
    return G.module_order(s, _regions(spark, sf, e)).select(*KEY, "node", "module", "place", "starts")


def f07_swapped_join(spark, sf):
    return E.swapped(raw(spark, sf).filter("w > 0")).select(*KEY, "src", "dst", r("w", 4), r("w_back", 4))


def flagship(spark, sf):
    """Which weight measures tell the two cohorts of trade graphs apart: means by group, Mann-Whitney U and adjusted p."""
    from corvane.operators import stats as S

    wide = G.weight_statistics(matrix(spark, sf), nodes(spark, sf))
    long = wide.select(*KEY, F.explode(F.create_map(*[x for c in ("density", "mean", "sd", "median", "max", "cv") for x in (F.lit(c), F.round(c, 9))])).alias("measure", "value")).withColumn("band", F.lit("all"))
    tests = S.adjust(S.mann_whitney(long, ["band", "measure"]), "p", "fdr_bh", [])
    return tests.select("band", "measure", "n1", "n2", r("u"), r("p"), r("p_adj"))


def e09_betweenness(spark, sf):
    from corvane.operators import partition as P

    return P.betweenness(net(spark, sf), nodes(spark, sf).count()).groupBy(*KEY).agg(F.round(F.avg("value"), 4).alias("value"))


def e30_best_partition(spark, sf):
    from corvane.operators import partition as P

    return P.best_partition(net(spark, sf), nodes(spark, sf).count()).select(*KEY, "node", "module", r("q"))


def e13_small_worldness(spark, sf):
    from corvane.operators import partition as P

    return P.small_worldness(net(spark, sf), nodes(spark, sf), 42).select(*KEY, r("value", 4))


def _both(name):
    return f"SELECT grp, subject, src, dst, round({name}, 6) AS w FROM "


_MW = """values_ AS ({values}),
    ranked AS (SELECT *, rank() OVER (PARTITION BY band, measure ORDER BY value) + (count(*) OVER (PARTITION BY band, measure, value) - 1) / 2.0 AS rk,
        count(*) OVER (PARTITION BY band, measure, value) AS ties FROM values_ WHERE value IS NOT NULL),
    sums AS (SELECT band, measure, count(*) FILTER (WHERE grp = 'Healthy') AS n1, count(*) FILTER (WHERE grp <> 'Healthy') AS n2,
        coalesce(sum(rk) FILTER (WHERE grp = 'Healthy'), 0) AS r1, sum(ties * ties - 1.0) AS t, count(*) AS n FROM ranked GROUP BY ALL),
    us AS (SELECT *, r1 - n1 * (n1 + 1) / 2.0 AS u, n1 * n2 / 2.0 AS mu, sqrt(n1 * n2 / 12.0 * ((n + 1) - t / (n * (n - 1.0)))) AS sd FROM sums),
    few AS (SELECT DISTINCT CAST(least(n1, n2) AS INTEGER) AS small, CAST(n1 + n2 AS INTEGER) AS n FROM us WHERE least(n1, n2) BETWEEN 1 AND 8 AND t = 0),
    ways(small, n, i, k, s, c) AS (
        SELECT small, n, 0, 0, 0, 1.0::DOUBLE FROM few
        UNION ALL SELECT small, n, i + 1, k + taken, s + taken * (i + 1), sum(c) FROM ways, (VALUES (0), (1)) v(taken) WHERE i < n AND k + taken <= small GROUP BY ALL),
    tails AS (SELECT small, n, s - small * (small + 1) // 2 AS v, sum(c) OVER (PARTITION BY small, n ORDER BY s) / sum(c) OVER (PARTITION BY small, n) AS below FROM ways WHERE i = n AND k = small),
    tested AS (SELECT band, measure, n1, n2, u, CASE WHEN n1 = 0 OR n2 = 0 THEN NULL WHEN sd = 0 THEN 1.0 WHEN below IS NOT NULL THEN least(1.0, 2 * below) ELSE least(1.0, {tail}) END AS p
        FROM us LEFT JOIN tails ON us.t = 0 AND tails.small = least(n1, n2) AND tails.n = n1 + n2 AND tails.v = least(u, n1 * n2 - u))"""


def mann_whitney_sql(values: str) -> str:
    """`tested`: U and p by the same rules in SQL; `ways` counts the sets of `k` of the first `i` ranks by their sum."""
    from corvane.functions.tails import duck_two_sided

    return _MW.format(values=values, tail=duck_two_sided("greatest(abs(u - mu) - 0.5, 0) / sd"))


def bh_sql(partition: str = "") -> str:
    by = f"PARTITION BY {partition}" if partition else ""
    return f"least(1.0, min(p * m / rk) OVER ({by} ORDER BY rk DESC ROWS UNBOUNDED PRECEDING))"


_FLAG_VALUES = " UNION ALL ".join(f"SELECT grp, subject, 'all' AS band, '{m}' AS measure, round({x}, 9) AS value FROM weights GROUP BY grp, subject" for m, x in (("density", "avg(CAST(w > 0 AS DOUBLE))"), ("mean", "avg(w)"), ("sd", "stddev_pop(w)"), ("median", "quantile_cont(w, 0.5)"), ("max", "max(w)"), ("cv", "CASE WHEN avg(w) <> 0 THEN stddev_pop(w) / avg(w) END")))

_R = "grp, subject, "
SQL = {
    "b13_sanitised_edges": _sql("SELECT grp, subject, src, dst, round(w, 4) AS w FROM clean"),
    "b14_edge_lengths": _sql("SELECT grp, subject, src, dst, round(1 / w, 6) AS d FROM net WHERE src <> dst"),
    "b15_off_diagonal_weights": _sql("SELECT grp, subject, src, dst, round(w, 4) AS w FROM grid WHERE src <> dst"),
    "b16_minmax": _sql(_both("w") + "matrix"),
    "b16_maxabs": _sql(_both("CASE WHEN max(abs(w)) OVER g > 0 THEN w / max(abs(w)) OVER g ELSE 0 END") + "grid WINDOW g AS (PARTITION BY grp, subject)"),
    "b17_zscore": _sql(_both("(w - avg(w) OVER g) / (stddev_pop(w) OVER g + 1e-10)") + "grid WINDOW g AS (PARTITION BY grp, subject)"),
    "b18_threshold_percentile": _sql("SELECT grp, subject, src, dst, round(CASE WHEN w > q THEN w ELSE 0 END, 4) AS w FROM grid JOIN (SELECT grp, subject, quantile_cont(w, 0.9) AS q FROM grid GROUP BY ALL) USING (grp, subject)"),
    "b18_threshold_sd": _sql("SELECT grp, subject, src, dst, round(CASE WHEN w > q THEN w ELSE 0 END, 6) AS w FROM matrix JOIN (SELECT grp, subject, avg(w) + 1.5 * stddev_pop(w) AS q FROM matrix GROUP BY ALL) USING (grp, subject)"),
    "b19_binarised": _sql("SELECT grp, subject, src, dst, CAST(w > 0.05 AS INTEGER) AS w FROM matrix"),
    "b20_symmetrised": _sql("SELECT a.grp, a.subject, a.src, a.dst, round((a.w + b.w) / 2, 6) AS average, round(greatest(a.w, b.w), 6) AS max, round(least(a.w, b.w), 6) AS min FROM cells a JOIN cells b ON a.grp = b.grp AND a.subject = b.subject AND a.src = b.dst AND a.dst = b.src", "cells AS MATERIALIZED (SELECT * FROM matrix)"),
    "b21_edge_vector": _sql("SELECT grp, subject, count(*) AS n, string_agg(CAST(CAST(round(w * 1000000) AS BIGINT) AS VARCHAR), ',' ORDER BY src, dst) AS vector FROM matrix WHERE src <> dst GROUP BY ALL"),
    "b22_asymmetric_cells": _sql("SELECT a.grp, a.subject, CAST(sum(CAST(abs(a.w - b.w) > 1e-8 + 1e-5 * abs(b.w) AS BIGINT)) AS BIGINT) AS n FROM matrix a JOIN matrix b ON a.grp = b.grp AND a.subject = b.subject AND a.src = b.dst AND a.dst = b.src GROUP BY ALL"),
    "b23_vector_to_edges": _sql("SELECT grp, subject, src, dst, round(w, 6) AS w FROM matrix WHERE src < dst UNION ALL SELECT grp, subject, dst, src, round(w, 6) FROM matrix WHERE src < dst"),
    "b24_transformations": _sql(
        "SELECT grp, subject, src, dst, round(w, 6) AS natural, round(avg(w) OVER g, 6) AS mean, round(w - avg(w) OVER g, 6) AS centred, round((rank() OVER (PARTITION BY grp, subject ORDER BY w) + (count(*) OVER (PARTITION BY grp, subject, w) - 1) / 2.0) / count(*) OVER g, 6) AS rank FROM sy WINDOW g AS (PARTITION BY grp, subject)",
        "sy AS (SELECT a.grp, a.subject, a.src, a.dst, (a.w + b.w) / 2 AS w FROM matrix a JOIN matrix b ON a.grp = b.grp AND a.subject = b.subject AND a.src = b.dst AND a.dst = b.src WHERE a.src < a.dst)",
    ),
    "d35_matrix_quality": _sql("SELECT a.grp, a.subject, 0::BIGINT AS n_bad, max(abs(a.w)) = 0 AS all_zero, round(avg(CAST(a.w = 0 AS DOUBLE)), 6) AS share_zero, round(avg(CAST(a.w = 1 AS DOUBLE)), 6) AS share_one, round(avg(a.w), 6) AS mean_w, round(stddev_pop(a.w), 6) AS sd_w, round(quantile_cont(abs(a.w - b.w), 0.5), 6) AS asymmetry FROM matrix a JOIN matrix b ON a.grp = b.grp AND a.subject = b.subject AND a.src = b.dst AND a.dst = b.src WHERE a.src <> a.dst GROUP BY ALL"),
    "e01_distances": _sql("SELECT grp, subject, src, dst, round(d, 6) AS d FROM d5", *_DIST),
    "e02_global_efficiency": _sql(f"SELECT grp, subject, round(coalesce(sum(1 / d), 0) / ({_N} * ({_N} - 1)), 6) AS value FROM graphs LEFT JOIN d5 USING (grp, subject) GROUP BY ALL", *_DIST),
    "e05_clustering": _sql("SELECT grp, subject, round(avg(CASE WHEN cycles > 0 THEN cycles / possible ELSE 0 END), 6) AS value FROM tri GROUP BY ALL", *_CYCLES),
    "e06_transitivity": _sql("SELECT grp, subject, round(coalesce(sum(cycles) FILTER (WHERE cycles > 0) / sum(possible) FILTER (WHERE cycles > 0), 0), 6) AS value FROM tri GROUP BY ALL", *_CYCLES),
    "e08_mean_strength": _sql(f"SELECT grp, subject, round(2 * sum(w) / {_N}, 6) AS value FROM matrix WHERE src <> dst GROUP BY ALL"),
    "e10_rich_club": _sql(
        "SELECT g.grp, g.subject, round(s / top, 6) AS value FROM graphs g LEFT JOIN (SELECT k.grp, k.subject, any_value(k.s) AS s, sum(o.w) AS top FROM own k JOIN ordered o ON k.grp = o.grp AND k.subject = o.subject AND o.rk <= k.n GROUP BY ALL) t ON g.grp = t.grp AND g.subject = t.subject",
        "rich AS (SELECT grp, subject, node FROM (SELECT grp, subject, src AS node FROM net UNION ALL SELECT grp, subject, dst FROM net) GROUP BY ALL HAVING count(*) >= 20)",
        "own AS (SELECT n.grp, n.subject, count(*) AS n, sum(w) AS s FROM net n JOIN rich a ON a.grp = n.grp AND a.subject = n.subject AND a.node = n.src JOIN rich b ON b.grp = n.grp AND b.subject = n.subject AND b.node = n.dst GROUP BY ALL)",
        "ordered AS (SELECT *, row_number() OVER (PARTITION BY grp, subject ORDER BY w DESC, src, dst) AS rk FROM net)",
    ),
    "e11_assortativity": _sql(
        "SELECT grp, subject, round((" + " + ".join(f"(avg({a} * {b}) - avg(({a} + {b}) / 2.0) ** 2) / nullif(avg(({a} * {a} + {b} * {b}) / 2.0) - avg(({a} + {b}) / 2.0) ** 2, 0)" for a, b in (("so", "di"), ("si", "dout"), ("so", "dout"), ("si", "di"))) + ") / 4, 6) AS value FROM ends GROUP BY ALL",
        "kk AS (SELECT grp, subject, node, sum(o) AS o, sum(i) AS i FROM (SELECT grp, subject, src AS node, 1 AS o, 0 AS i FROM net UNION ALL SELECT grp, subject, dst, 0, 1 FROM net) GROUP BY ALL)",
        "ends AS (SELECT n.grp, n.subject, a.o::DOUBLE AS so, a.i::DOUBLE AS si, b.o::DOUBLE AS dout, b.i::DOUBLE AS di FROM net n JOIN kk a ON a.grp = n.grp AND a.subject = n.subject AND a.node = n.src JOIN kk b ON b.grp = n.grp AND b.subject = n.subject AND b.node = n.dst)",
    ),
    "e14_diameter": _sql("SELECT grp, subject, round(max(d), 6) AS value FROM graphs LEFT JOIN d5 USING (grp, subject) GROUP BY ALL", *_DIST),
    "e15_e21_weight_statistics": _sql("SELECT grp, subject, round(avg(CAST(w > 0 AS DOUBLE)), 6) AS density, round(avg(w), 6) AS mean, round(stddev_pop(w), 6) AS sd, round(quantile_cont(w, 0.5), 6) AS median, round(max(w), 6) AS max, round(min(w), 6) AS min, round(stddev_pop(w) / nullif(avg(w), 0), 6) AS cv FROM weights GROUP BY ALL", _WEIGHTS),
    "e22_path_length": _sql("SELECT grp, subject, round(avg(d), 6) AS value FROM graphs LEFT JOIN d5 USING (grp, subject) GROUP BY ALL", *_DIST),
    "e25_node_measures": _sql(
        "SELECT t.grp, t.subject, t.node, round(coalesce(i.s, 0), 6) AS s_in, round(coalesce(o.s, 0), 6) AS s_out, round(coalesce(i.s, 0) + coalesce(o.s, 0), 6) AS s_total, round(coalesce(o.s, 0) - coalesce(i.s, 0), 6) AS balance, round(CASE WHEN cycles > 0 THEN cycles / possible ELSE 0 END, 6) AS clustering FROM tri t LEFT JOIN (SELECT grp, subject, dst AS node, sum(w) AS s FROM net GROUP BY ALL) i ON i.grp = t.grp AND i.subject = t.subject AND i.node = t.node LEFT JOIN (SELECT grp, subject, src AS node, sum(w) AS s FROM net GROUP BY ALL) o ON o.grp = t.grp AND o.subject = t.subject AND o.node = t.node",
        *_CYCLES,
    ),
    "e26_node_summary": _sql("SELECT grp, subject, round(avg(s), 6) AS mean, round(stddev_pop(s), 6) AS sd, round(quantile_cont(s, 0.5), 6) AS median, round(max(s), 6) AS max, round(min(s), 6) AS min FROM (SELECT grp, subject, node, sum(w) AS s FROM (SELECT grp, subject, src AS node, w FROM matrix UNION ALL SELECT grp, subject, dst, w FROM matrix) GROUP BY ALL) GROUP BY ALL"),
    "e07_modularity_of_regions": _sql(
        "SELECT m.grp, m.subject, round(sum(coalesce(i.s, 0) / m.m - coalesce(o.s, 0) * coalesce(t.s, 0) / (m.m * m.m)), 6) AS value FROM tot m CROSS JOIN (SELECT DISTINCT n_regionkey AS module FROM nation) r LEFT JOIN (SELECT grp, subject, a, sum(w) AS s FROM lab WHERE a = b GROUP BY ALL) i ON i.grp = m.grp AND i.subject = m.subject AND i.a = r.module LEFT JOIN (SELECT grp, subject, a, sum(w) AS s FROM lab GROUP BY ALL) o ON o.grp = m.grp AND o.subject = m.subject AND o.a = r.module LEFT JOIN (SELECT grp, subject, b, sum(w) AS s FROM lab GROUP BY ALL) t ON t.grp = m.grp AND t.subject = m.subject AND t.b = r.module GROUP BY m.grp, m.subject",
        "lab AS (SELECT n.*, x.n_regionkey AS a, y.n_regionkey AS b FROM net n JOIN nation x ON n.src = x.n_nationkey JOIN nation y ON n.dst = y.n_nationkey)",
        "tot AS (SELECT grp, subject, sum(w) AS m FROM net GROUP BY ALL)",
    ),
    "e31_module_order": _sql(
        "SELECT grp, subject, node, module, row_number() OVER o AS place, lag(least_) OVER o IS NULL OR lag(least_) OVER o <> least_ AS starts FROM (SELECT *, min(node) OVER (PARTITION BY grp, subject, module) AS least_ FROM st) WINDOW o AS (PARTITION BY grp, subject ORDER BY least_, s DESC, node)",
        "st AS (SELECT m.grp, m.subject, m.node, n.n_regionkey AS module, round(sum(w), 9) AS s FROM (SELECT grp, subject, src AS node, w FROM matrix UNION ALL SELECT grp, subject, dst, w FROM matrix) m JOIN nation n ON n.n_nationkey = m.node WHERE (grp, subject) IN (SELECT (grp, subject) FROM net) GROUP BY ALL)",
    ),
    "f07_swapped_join": _sql("SELECT a.grp, a.subject, a.src, a.dst, round(a.w, 4) AS w, round(b.w, 4) AS w_back FROM clean a LEFT JOIN clean b ON a.grp = b.grp AND a.subject = b.subject AND a.src = b.dst AND a.dst = b.src AND b.w > 0 WHERE a.w > 0"),
    "flagship": _sql(f"SELECT band, measure, n1, n2, round(u, 6) AS u, round(p, 6) AS p, round({bh_sql()}, 6) AS p_adj FROM (SELECT *, row_number() OVER (ORDER BY p, measure) AS rk, count(*) OVER () AS m FROM tested)", _WEIGHTS, mann_whitney_sql(_FLAG_VALUES)),
}
QUERIES = {k: v for k, v in list(globals().items()) if k == "flagship" or (k[:1] in "bdef" and k[1:3].isdigit() and callable(v))}
