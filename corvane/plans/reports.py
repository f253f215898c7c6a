"""Queries for run bookkeeping and reports, with their DuckDB texts."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from corvane.operators import rollups as R
from corvane.operators import stats as S
from corvane.plans.network import KEY, _sql, matrix, nodes, r
from corvane.sources import adapters as A
from corvane.sources import runs


# ---------------------------------------------------------------- A


def a02_concatenated_files(spark, sf):
    s = A.signal(spark, sf).select("subject", "channel", F.concat(F.lit("f"), F.floor(F.col("t") / 50).cast("string")).alias("file"), (F.col("t") % 50).alias("t"), "v")
    s = s.groupBy("subject", "file", "t").agg(F.round(F.sum("v"), 4).alias("v"))
    return runs.concatenated(s, ["subject"]).select("subject", "t", "v")


def a03_drop_list(spark, sf):
    names = A.table(spark, sf, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n")).orderBy("n", "event_type").limit(2).select(F.col("event_type").alias("channel"))
    return runs.dropped(A.signal(spark, sf), names, "channel").groupBy("channel").agg(F.count(F.lit(1)).alias("n"))


def a04_mixed_contracts(spark, sf):
    f = A.table(spark, sf, "orders").select("o_custkey", "o_orderstatus", "o_orderpriority")
    return runs.mixed_contracts(f, ["o_custkey"], ["o_orderstatus"])


def a06_complete_epochs(spark, sf):
    return runs.complete_epochs(A.signal(spark, sf), ["subject", "channel"], 50)


def a08_missing_edges(spark, sf):
    n = nodes(spark, sf)
    pairs = n.select(F.col("node").alias("src")).crossJoin(n.select(F.col("node").alias("dst"))).filter("src <> dst")
    e = A.edge(spark, sf)
    return runs.missing_cells(e, e.select(*KEY).distinct().crossJoin(F.broadcast(pairs)), [*KEY, "src", "dst"]).groupBy(*KEY).agg(F.count(F.lit(1)).alias("missing"))


def a16_still_to_do(spark, sf):
    c = A.table(spark, sf, "customer").select("c_custkey", F.concat_ws(":", F.lit("v2"), "c_mktsegment").alias("params"))
    done = A.table(spark, sf, "orders").join(A.table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey")).filter("o_orderstatus = 'O'").select("c_custkey", F.concat_ws(":", F.when(F.col("o_orderkey") % 2 == 0, "v2").otherwise("v1"), "c_mktsegment").alias("params"))
    return runs.still_to_do(c, done, ["c_custkey"])


def a17_reusable_caches(spark, sf):
    o = A.table(spark, sf, "orders").groupBy("o_custkey").agg(F.collect_set("o_orderpriority").alias("families"), (F.count(F.lit(1)) % 3).cast("int").alias("version"))
    return runs.reusable(o, 1, ["1-URGENT", "5-LOW"]).select("o_custkey")


def a20_id_mismatches(spark, sf):
    e = A.edge(spark, sf).select("subject").distinct().withColumn("e", F.lit(1))
    m = matrix(spark, sf).groupBy("subject").agg(F.count(F.lit(1)).alias("cells"), F.sum(F.isnan("w").cast("long")).alias("bad"))
    return e.join(m, "subject", "full").select("subject", F.col("e").isNull().alias("no_edges"), "cells", "bad")


# ---------------------------------------------------------------- E


def e28_strength_features(spark, sf):
    m = matrix(spark, sf)
    rows = m.groupBy(*KEY, F.col("src").alias("node")).agg(F.round(F.sum("w"), 6).alias("row_sum"))
    cols = m.groupBy(*KEY, F.col("dst").alias("node")).agg(F.round(F.sum("w"), 6).alias("col_sum"))
    return rows.join(cols, [*KEY, "node"])


def e29_wide_measures(spark, sf):
    m = matrix(spark, sf).filter("src <> dst").groupBy(*KEY).agg(F.avg("w").alias("mean"), F.max("w").alias("max"), F.stddev_pop("w").alias("sd"))
    long = m.select("subject", F.explode(F.create_map(*[x for c in ("mean", "max", "sd") for x in (F.lit(f"graph_all_{c}"), F.round(c, 6))])).alias("k", "v"))
    return long.groupBy("subject").pivot("k", ["graph_all_mean", "graph_all_max", "graph_all_sd"]).agg(F.first("v"))


def e32_module_boundaries(spark, sf):
    n = A.table(spark, sf, "nation").orderBy("n_regionkey", "n_nationkey").select("n_regionkey", "n_nationkey")
    w = Window.orderBy("n_regionkey", "n_nationkey")  # one row for each node of one partition: a few dozen
    return n.withColumn("place", F.row_number().over(w)).withColumn("before", F.lag("n_regionkey").over(w)).filter("before IS NOT NULL AND before <> n_regionkey").select("place", "n_regionkey")


# ---------------------------------------------------------------- F


def f05_channel_pairs(spark, sf):
    c = A.table(spark, sf, "events").select("user_id", "event_type").distinct()
    return c.select("user_id", F.col("event_type").alias("a")).join(c.select("user_id", F.col("event_type").alias("b")), "user_id").filter("a < b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("subjects"))


def f15_f16_fused_sets(spark, sf):
    f = A.feature(spark, sf)
    sets = spark.createDataFrame([("low", 0, 15), ("high", 48, 63), ("both", 0, 15), ("both", 48, 63)], "fset string, lo int, hi int")
    return f.join(F.broadcast(sets), (F.col("ord") >= F.col("lo")) & (F.col("ord") <= F.col("hi"))).groupBy("fset", "subject").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 5).alias("total"))


# ---------------------------------------------------------------- G


def g01_mean_matrix(spark, sf):
    return A.edge(spark, sf).groupBy("src", "dst").agg(F.round(F.avg("w"), 2).alias("w"))


def g03_edge_tests(spark, sf):
    t = S.one_sample_t(A.edge(spark, sf).filter("src < dst"), ["src", "dst"], 70000.0, 3).filter("p IS NOT NULL")
    return t.select("src", "dst", "n", r("mean", 2), r("t", 4), F.when(F.col("p") < 0.5, "low").otherwise("high").alias("side"))


def g13_top_features(spark, sf):
    d = S.cohens_d(A.feature(spark, sf).select(F.when(F.col("y") == 1, "Healthy").otherwise("Patient").alias("grp"), "ord", "value"), ["ord"]).withColumn("size", F.round(F.abs("d"), 6))
    return d.orderBy(F.col("size").desc(), "ord").limit(10).select("ord", "size")


def g20_combined_scores(spark, sf):
    s = A.selection(spark, sf).groupBy("band", "node").agg(F.sum("strength").alias("s"))
    return s.select("band", "node", F.round("s", 6).alias("score"), F.round(F.col("s") / F.max("s").over(Window.partitionBy("band")), 6).alias("rate"))


def g22_best_closeness(spark, sf):
    return A.selection(spark, sf).groupBy("unit").agg(F.min(F.round(F.abs(F.col("rev") - 100000), 2)).alias("closeness"))


def g23_target_polarity(spark, sf):
    s = A.selection(spark, sf).filter("rnk = 1").withColumn("polarity", F.when(F.col("rev") < 80000, "suppression").otherwise("enhancement"))
    return s.groupBy("node").agg(F.sum((F.col("polarity") == "suppression").cast("long")).alias("suppression"), F.sum((F.col("polarity") == "enhancement").cast("long")).alias("enhancement"), F.count(F.lit(1)).alias("total"))


def g24_solution_audit(spark, sf):
    s = A.selection(spark, sf)
    return s.groupBy("band").agg(F.count(F.lit(1)).alias("solutions"), F.sum((F.col("rev") > 0).cast("long")).alias("with_metadata"), F.sum((F.col("rev") < 20000).cast("long")).alias("infeasible"))


def g28_subject_table(spark, sf):
    s = A.selection(spark, sf).filter("rnk <= 2").groupBy("band", "unit").agg(F.max(F.when(F.col("rnk") == 1, F.col("rev"))).alias("initial"), F.max(F.when(F.col("rnk") == 2, F.col("rev"))).alias("final"), F.max(F.when(F.col("rnk") == 1, F.col("node"))).alias("target")).dropna()
    gain = (F.col("initial") - F.col("final")) / F.col("initial")
    return s.select("band", "unit", "target", F.round(gain, 6).alias("improvement"), (gain > 0.1).alias("responder"))


def g29_band_summary(spark, sf):
    s = g28_subject_table(spark, sf)
    lo, hi = S.wilson(F.col("k"), F.col("n"))
    a = s.groupBy("band").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("responder").cast("long")).alias("k"), F.round(F.percentile("improvement", 0.5), 6).alias("median"))
    return a.select("band", "n", "median", F.round(F.col("k") / F.col("n"), 6).alias("rate"), F.round(lo, 6).alias("low"), F.round(hi, 6).alias("high"))


def g31_g32_name_lists(spark, sf):
    s = A.selection(spark, sf).groupBy("band", "node").agg(F.round(F.sum("strength"), 6).alias("s"))
    top = R.top_per_key(s, ["band"], [F.col("s").desc(), "node"], 5)
    return top.groupBy("band").agg(F.concat_ws(",", F.transform(F.array_sort(F.collect_list(F.struct("rank", "node"))), lambda x: x["node"].cast("string"))).alias("nodes"))


def g33_summary_row(spark, sf):
    e = A.edge(spark, sf)
    return e.agg(F.countDistinct("subject").alias("graphs"), F.countDistinct(F.when(F.col("grp") == "Healthy", F.col("subject"))).alias("healthy"), F.countDistinct("src").alias("sources"), F.count(F.lit(1)).alias("edges"))


def g34_shares(spark, sf):
    s = A.selection(spark, sf).filter("rnk = 1")
    t = s.groupBy("band", "node").agg(F.count(F.lit(1)).alias("n"))
    return t.select("band", "node", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("band")), 6).alias("share"))


def g35_front_summary(spark, sf):
    s = A.selection(spark, sf)
    return s.groupBy("band").agg(F.count(F.lit(1)).alias("size"), F.round(F.min("rev"), 4).alias("low"), F.round(F.max("rev"), 4).alias("high"), F.countDistinct("node").alias("nodes"), F.countDistinct("unit").alias("units"))


def g37_finite_measures(spark, sf):
    m = A.measure(spark, sf)
    n = m.groupBy("band").agg(F.countDistinct("subject").alias("all"))
    ok = m.groupBy("band", "measure").agg(F.count(F.when(~F.isnan("value"), 1)).alias("n"))
    return ok.join(n, "band").filter(F.col("n") == F.col("all")).select("band", "measure")


def g44_group_points(spark, sf):
    return A.measure(spark, sf).groupBy("grp", "subject").pivot("measure", ["chars", "length", "lines"]).agg(F.round(F.avg("value"), 6)).dropna()


# ---------------------------------------------------------------- H, I


def h17_conservative_winner(spark, sf):
    b = g29_band_summary(spark, sf)
    best = b.agg(F.max(F.struct("low", "band")).alias("m")).select(F.col("m.band").alias("winner"), F.col("m.low").alias("bound"))
    rivals = b.crossJoin(F.broadcast(best)).filter("band <> winner").agg(F.max("high").alias("other"))
    return best.crossJoin(rivals).select("winner", F.when(F.col("bound") > F.col("other"), "wins").otherwise("inconclusive").alias("verdict"))


def i24_calibration_error(spark, sf):
    m = R.probability_metrics(A.oof(spark, sf), ["repeat"])
    return m.select("repeat", r("ece"))


def i27_model_choice(spark, sf):
    m = R.probability_metrics(A.oof(spark, sf), ["band", "repeat"]).withColumns({c: F.round(c, 6) for c in ("auc", "brier", "ece")})
    near = m.withColumn("best", F.max("auc").over(Window.partitionBy("band"))).filter("auc >= best - 0.02")
    return R.keep_first(near, ["band"], ["brier", "ece", F.col("auc").desc(), "repeat"]).select("band", "repeat", "auc", "brier")


def i34_change_distance(spark, sf):
    s = A.selection(spark, sf).filter("rnk <= 2")
    z = s.groupBy("band", "unit").agg((F.max("rev") - F.min("rev")).alias("d"))
    sd = s.groupBy("band").agg(F.stddev_samp("rev").alias("sd"))
    return z.join(F.broadcast(sd), "band").groupBy("band").agg(F.round(F.sqrt(F.avg((F.col("d") / F.col("sd")) ** 2)), 6).alias("rms"))


_F1 = "first_ AS (SELECT * FROM selection WHERE rnk = 1)"
_SUBJ = "st AS (SELECT band, unit, target, (i - f) / i AS g FROM (SELECT band, unit, max(rev) FILTER (WHERE rnk = 1) AS i, max(rev) FILTER (WHERE rnk = 2) AS f, max(node) FILTER (WHERE rnk = 1) AS target FROM selection WHERE rnk <= 2 GROUP BY ALL) WHERE f IS NOT NULL)"
_Z = "1.959963984540054"
_BAND = f"bs AS (SELECT band, n, median, round(k / n, 6) AS rate, round(((k / n + {_Z} * {_Z} / (2 * n)) - {_Z} * sqrt(k / n * (1 - k / n) / n + {_Z} * {_Z} / (4.0 * n * n))) / (1 + {_Z} * {_Z} / n), 6) AS low, round(((k / n + {_Z} * {_Z} / (2 * n)) + {_Z} * sqrt(k / n * (1 - k / n) / n + {_Z} * {_Z} / (4.0 * n * n))) / (1 + {_Z} * {_Z} / n), 6) AS high FROM (SELECT band, count(*) AS n, (count(*) FILTER (WHERE g > 0.1))::DOUBLE AS k, round(quantile_cont(round(g, 6), 0.5), 6) AS median FROM st GROUP BY band))"
_CLIP = "clip AS (SELECT band, repeat, y_true, least(greatest(p, 1e-7), 1 - 1e-7) AS p FROM oof)"


def _metrics(by):
    from corvane.plans.cohort import _metrics_sql

    return _metrics_sql(by)


SQL = {
    "a02_concatenated_files": A.sql("signal", "SELECT subject, t::BIGINT AS t, round(sum(v), 4) AS v FROM signal GROUP BY ALL"),
    "a03_drop_list": A.sql("signal", "SELECT channel, count(*) AS n FROM signal WHERE channel NOT IN (SELECT event_type FROM (SELECT event_type, count(*) AS n FROM events GROUP BY 1 ORDER BY n, event_type LIMIT 2)) GROUP BY channel"),
    "a04_mixed_contracts": "SELECT o_custkey, count(DISTINCT o_orderstatus) AS n FROM orders GROUP BY 1 HAVING n > 1",
    "a06_complete_epochs": A.sql("signal", "SELECT subject, channel, CAST(t // 50 AS INTEGER) AS epoch, count(*) AS n FROM signal GROUP BY ALL HAVING n = 50"),
    "a08_missing_edges": _sql("SELECT g.grp, g.subject, count(*) AS missing FROM graphs g, nation a, nation b WHERE a.n_nationkey <> b.n_nationkey AND NOT EXISTS (SELECT 1 FROM edge e WHERE e.grp = g.grp AND e.subject = g.subject AND e.src = a.n_nationkey AND e.dst = b.n_nationkey) GROUP BY ALL"),
    "a16_still_to_do": "SELECT c_custkey, 'v2:' || c_mktsegment AS params FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'O' AND o_orderkey % 2 = 0)",
    "a17_reusable_caches": "SELECT o_custkey FROM orders GROUP BY 1 HAVING count(*) % 3 = 1 AND bool_or(o_orderpriority = '1-URGENT') AND bool_or(o_orderpriority = '5-LOW')",
    "a20_id_mismatches": _sql("SELECT subject, false AS no_edges, count(*) AS cells, 0::BIGINT AS bad FROM matrix GROUP BY subject"),
    "e28_strength_features": _sql("SELECT a.grp, a.subject, a.node, row_sum, col_sum FROM (SELECT grp, subject, src AS node, round(sum(w), 6) AS row_sum FROM matrix GROUP BY ALL) a JOIN (SELECT grp, subject, dst AS node, round(sum(w), 6) AS col_sum FROM matrix GROUP BY ALL) b ON a.grp = b.grp AND a.subject = b.subject AND a.node = b.node"),
    "e29_wide_measures": _sql("SELECT subject, round(avg(w), 6) AS graph_all_mean, round(max(w), 6) AS graph_all_max, round(stddev_pop(w), 6) AS graph_all_sd FROM matrix WHERE src <> dst GROUP BY subject"),
    "e32_module_boundaries": "SELECT place, n_regionkey FROM (SELECT n_regionkey, row_number() OVER w AS place, lag(n_regionkey) OVER w AS b FROM nation WINDOW w AS (ORDER BY n_regionkey, n_nationkey)) WHERE b <> n_regionkey",
    "f05_channel_pairs": "WITH c AS (SELECT DISTINCT user_id, event_type FROM events) SELECT x.event_type AS a, y.event_type AS b, count(*) AS subjects FROM c x JOIN c y ON x.user_id = y.user_id AND x.event_type < y.event_type GROUP BY ALL",
    "f15_f16_fused_sets": A.sql("feature", "SELECT fset, subject, count(*) AS n, round(sum(value), 5) AS total FROM feature, (VALUES ('low', 0, 15), ('high', 48, 63), ('both', 0, 15), ('both', 48, 63)) s(fset, lo, hi) WHERE ord BETWEEN lo AND hi GROUP BY ALL"),
    "g01_mean_matrix": A.sql("edge", "SELECT src, dst, round(avg(w), 2) AS w FROM edge GROUP BY ALL"),
    "g13_top_features": A.sql("feature", "SELECT CAST(ord AS INTEGER) AS ord, round(abs((m1 - m2) / sp), 6) AS size FROM (SELECT ord, avg(value) FILTER (WHERE y = 1) AS m1, avg(value) FILTER (WHERE y = 0) AS m2, sqrt(((count(*) FILTER (WHERE y = 1) - 1) * var_samp(value) FILTER (WHERE y = 1) + (count(*) FILTER (WHERE y = 0) - 1) * var_samp(value) FILTER (WHERE y = 0)) / (count(*) - 2)) AS sp FROM feature GROUP BY ord) ORDER BY size DESC, ord LIMIT 10"),
    "g20_combined_scores": A.sql("selection", "SELECT band, node, round(s, 6) AS score, round(s / max(s) OVER (PARTITION BY band), 6) AS rate FROM (SELECT band, node, sum(strength) AS s FROM selection GROUP BY ALL)"),
    "g22_best_closeness": A.sql("selection", "SELECT unit, min(round(abs(rev - 100000), 2)) AS closeness FROM selection GROUP BY unit"),
    "g23_target_polarity": A.sql("selection", "SELECT node, count(*) FILTER (WHERE rev < 80000) AS suppression, count(*) FILTER (WHERE rev >= 80000) AS enhancement, count(*) AS total FROM first_ GROUP BY node", _F1),
    "g24_solution_audit": A.sql("selection", "SELECT band, count(*) AS solutions, count(*) FILTER (WHERE rev > 0) AS with_metadata, count(*) FILTER (WHERE rev < 20000) AS infeasible FROM selection GROUP BY band"),
    "g28_subject_table": A.sql("selection", "SELECT band, unit, target, round(g, 6) AS improvement, g > 0.1 AS responder FROM st", _SUBJ),
    "g29_band_summary": A.sql("selection", "SELECT * FROM bs", _SUBJ, _BAND),
    "g31_g32_name_lists": A.sql("selection", "SELECT band, string_agg(node::VARCHAR, ',' ORDER BY k) AS nodes FROM (SELECT *, row_number() OVER (PARTITION BY band ORDER BY s DESC, node) AS k FROM (SELECT band, node, round(sum(strength), 6) AS s FROM selection GROUP BY ALL)) WHERE k <= 5 GROUP BY band"),
    "g33_summary_row": A.sql("edge", "SELECT count(DISTINCT subject) AS graphs, count(DISTINCT subject) FILTER (WHERE grp = 'Healthy') AS healthy, count(DISTINCT src) AS sources, count(*) AS edges FROM edge"),
    "g34_shares": A.sql("selection", "SELECT band, node, round(n / (sum(n) OVER (PARTITION BY band))::DOUBLE, 6) AS share FROM (SELECT band, node, count(*) AS n FROM first_ GROUP BY ALL)", _F1),
    "g35_front_summary": A.sql("selection", "SELECT band, count(*) AS size, round(min(rev), 4) AS low, round(max(rev), 4) AS high, count(DISTINCT node) AS nodes, count(DISTINCT unit) AS units FROM selection GROUP BY band"),
    "g37_finite_measures": A.sql("measure", "SELECT band, measure FROM (SELECT band, measure, count(value) AS n FROM measure GROUP BY ALL) JOIN (SELECT band, count(DISTINCT subject) AS k FROM measure GROUP BY band) USING (band) WHERE n = k"),
    "g44_group_points": A.sql("measure", "SELECT grp, subject, round(avg(value) FILTER (WHERE measure = 'chars'), 6) AS chars, round(avg(value) FILTER (WHERE measure = 'length'), 6) AS length, round(avg(value) FILTER (WHERE measure = 'lines'), 6) AS lines FROM measure GROUP BY ALL"),
    "h17_conservative_winner": A.sql("selection", "SELECT winner, CASE WHEN bound > (SELECT max(high) FROM bs WHERE band <> winner) THEN 'wins' ELSE 'inconclusive' END AS verdict FROM (SELECT band AS winner, low AS bound FROM bs ORDER BY low DESC, band DESC LIMIT 1)", _SUBJ, _BAND),
    "i24_calibration_error": A.sql("oof", "SELECT repeat, round(ece, 6) AS ece FROM metrics", _CLIP, _metrics("repeat")),
    "i27_model_choice": A.sql("oof", "SELECT band, repeat, auc, brier FROM (SELECT *, row_number() OVER (PARTITION BY band ORDER BY brier, ece, auc DESC, repeat) AS k FROM (SELECT *, max(auc) OVER (PARTITION BY band) AS best FROM (SELECT band, repeat, round(auc, 6) AS auc, round(brier, 6) AS brier, round(ece, 6) AS ece FROM metrics)) WHERE auc >= best - 0.02) WHERE k = 1", _CLIP, _metrics("band, repeat")),
    "i34_change_distance": A.sql("selection", "SELECT band, round(sqrt(avg((d / sd) ** 2)), 6) AS rms FROM (SELECT band, unit, max(rev) - min(rev) AS d FROM selection WHERE rnk <= 2 GROUP BY ALL) JOIN (SELECT band, stddev_samp(rev) AS sd FROM selection WHERE rnk <= 2 GROUP BY band) USING (band) GROUP BY band"),
}
QUERIES = {k: v for k, v in list(globals().items()) if k[:1] in "aefghi" and k[1:3].isdigit() and callable(v)}
