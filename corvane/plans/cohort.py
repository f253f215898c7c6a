"""Queries over cohorts: group tests, selections, predictions, joins and rankings, with their DuckDB texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corvane.functions.tails import binomial_tail, duck_chi2_tail, duck_two_sided
from corvane.operators import rollups as R
from corvane.operators import stats as S
from corvane.operators.ranks import numbered
from corvane.plans.network import bh_sql, mann_whitney_sql, r
from corvane.sources import adapters as A

BANDS = ["de", "en", "es", "fr"]
#: Resamples and sign flips of the queries.
RESAMPLES = 10_000


def d_rounded(df: DataFrame, *names: str, digits: int = 6) -> DataFrame:
    return df.withColumns({n: F.round(n, digits) for n in names})


# ---------------------------------------------------------------- F


def f01_inner_join(spark: SparkSession, sf: str) -> DataFrame:
    p, c = A.participant(spark, sf), A.table(spark, sf, "customer").select(F.col("c_custkey").alias("subject"), "c_name")
    return p.join(c, "subject").select("subject", "c_name", "grp", "age", "gender")


def f02_left_to_grid(spark, sf):
    sel = A.selection(spark, sf)
    grid = A.participant(spark, sf).select(F.col("subject").alias("unit")).crossJoin(F.broadcast(sel.select("band").distinct()))
    best = sel.filter("rnk = 1").select("unit", "band", "node")
    return grid.join(best, ["unit", "band"], "left").select("unit", "band", "node", F.when(F.col("node").isNull(), "no_result").otherwise("selected").alias("status"))


def f03_semi_join(spark, sf):
    return A.participant(spark, sf).join(A.selection(spark, sf).select(F.col("unit").alias("subject")), "subject", "left_semi").select("subject", "grp", "age")


def f04_anti_join(spark, sf):
    return A.participant(spark, sf).join(A.selection(spark, sf).select(F.col("unit").alias("subject")), "subject", "left_anti").select("subject", "grp")


def f04_without_urgent_orders(spark, sf):
    """Participants of whom no order of the first priority has a selection."""
    urgent = A.selection(spark, sf).filter("band = '1-URGENT' AND rnk = 5").select(F.col("unit").alias("subject"))
    return A.participant(spark, sf).join(urgent, "subject", "left_anti").select("subject", "grp")


def f06_candidate_grid(spark, sf):
    n = A.table(spark, sf, "nation").select(F.col("n_nationkey").alias("node"))
    return n.crossJoin(F.broadcast(A.selection(spark, sf).select("band").distinct())).select("node", "band")


def f08_nearest_row(spark, sf):
    f = A.table(spark, sf, "embeddings").select("vec_id", "label", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    asked = f.filter("vec_id % 100 = 0")  # the query rows; they search all rows
    return R.nearest(asked.select("vec_id", "v"), f.select(F.col("vec_id").alias("ref"), F.col("v").alias("u")), "vec_id", "ref").select("vec_id", "nearest", "distance")


def f10_id_intersection(spark, sf):
    a, b, c = (A.table(spark, sf, t).select(F.col(k).cast("long").alias("subject")) for t, k in (("customer", "c_custkey"), ("orders", "o_custkey"), ("labels", "doc_id")))
    return a.intersect(b).intersect(c)


def f11_cohort_alignment(spark, sf):
    return R.cohort_alignment(A.selection(spark, sf), "unit", "band")


def f12_symmetric_difference(spark, sf):
    a = A.table(spark, sf, "orders").select(F.col("o_custkey").alias("subject")).distinct().withColumn("a", F.lit(1))
    b = A.table(spark, sf, "labels").select(F.col("doc_id").alias("subject")).distinct().withColumn("b", F.lit(1))
    return a.join(b, "subject", "full").filter("a IS NULL OR b IS NULL").select("subject", F.when(F.col("a").isNull(), "labels").otherwise("orders").alias("only_in"))


def f13_union_all(spark, sf):
    a = A.participant(spark, sf).select(F.lit("customer").alias("kind"), "subject", "grp")
    b = A.measure(spark, sf).filter("measure = 'chars'").select(F.lit("document").alias("kind"), "subject", "grp", "band")
    return a.unionByName(b, allowMissingColumns=True)


def f14_keep_first(spark, sf):
    o = A.table(spark, sf, "orders").select("o_custkey", "o_orderpriority", "o_orderkey", "o_totalprice")
    return R.keep_first(o, ["o_custkey", "o_orderpriority"], ["o_orderkey"]).select("o_custkey", "o_orderpriority", "o_orderkey", r("o_totalprice", 2))


# ---------------------------------------------------------------- G


def g05_feature_statistics(spark, sf):
    f = A.feature(spark, sf).select(F.when(F.col("y") == 1, "Healthy").otherwise("Patient").alias("grp"), "ord", F.round("value", 6).alias("value"))
    return S.group_statistics(f, ["ord"]).join(S.mann_whitney(f, ["ord"]), "ord").select("ord", r("mean1"), r("sd1"), r("mean2"), r("sd2"), r("u"), r("p"))


def g06_baselines(spark, sf):
    b = A.measure(spark, sf).filter("grp = 'Healthy'").groupBy("measure").agg(F.avg("value").alias("m"))
    return b.select("measure", F.round(F.when(F.abs("m") < 1e-10, 1.0).otherwise(F.col("m")), 6).alias("baseline"))


def g07_directions(spark, sf):
    s = S.group_statistics(A.measure(spark, sf), ["measure"])
    return s.select("measure", F.when(F.col("mean2") > F.col("mean1"), "minimise").otherwise("maximise").alias("direction"))


def _subject_p(spark, sf):
    return A.oof(spark, sf).groupBy("band", "subject", "y_true").agg(F.round(F.avg("p"), 9).alias("p"))


def a14_i56_oof_means(spark, sf):
    return d_rounded(_subject_p(spark, sf), "p")


def g08_stable_percent_rank(spark, sf):
    return R.stable_percent_rank(_subject_p(spark, sf), ["band"], ["p", "subject"]).select("band", "subject", r("pct"))


def g09_average_percent_rank(spark, sf):
    return R.average_percent_rank(_subject_p(spark, sf), ["band"], "p").select("band", "subject", r("pct"))


def g10_rank_across_bands(spark, sf):
    sel = A.selection(spark, sf).filter("rnk = 1")
    ranked = R.stable_percent_rank(sel, ["band"], ["rev", "unit"])
    agg = ranked.groupBy("unit").agg(F.avg("pct").alias("pct"), F.min("rev").alias("least"), F.count(F.lit(1)).alias("bands")).withColumn("pct", F.round("pct", 9))
    return numbered(agg, [], ["pct", "unit"], "place").select("unit", r("pct"), r("least", 4), "bands", F.col("place").cast("int").alias("place"))


def g11_g12_rejection_sweep(spark, sf):
    out = R.rejected(_subject_p(spark, sf), ["band"], ["p", "subject"], [0, 10, 20, 30, 40, 50])
    return out.groupBy("percent", "band").agg(F.count(F.lit(1)).alias("n"), F.concat_ws(",", F.array_sort(F.collect_list("subject")).cast("array<string>")).alias("ids"))


def g15_top_per_key(spark, sf):
    o = A.table(spark, sf, "orders").select("o_custkey", "o_orderpriority", "o_orderkey", "o_totalprice")
    return R.top_per_key(o, ["o_custkey"], [F.col("o_totalprice").desc(), "o_orderkey"], 3).select("o_custkey", "o_orderkey", "rank", r("strength"))


def g16_node_selections(spark, sf):
    return R.node_selections(A.selection(spark, sf), []).select("node", "hard", r("weighted"))


def g17_top_rows(spark, sf):
    n = R.node_selections(A.selection(spark, sf), []).withColumn("weighted", F.round("weighted", 6)).withColumn("rate", F.col("weighted") / F.max("weighted").over(Window.partitionBy(F.lit(0))))
    return n.orderBy(F.col("weighted").desc(), "node").limit(5).select("node", "weighted", r("rate"))


def g18_band_scores(spark, sf):
    return A.selection(spark, sf).groupBy("band", "node").agg(F.round(F.sum("strength"), 6).alias("score"), F.countDistinct("unit").alias("units"))


def g19_validity_weighted(spark, sf):
    sel = A.selection(spark, sf)
    validity = sel.filter("rnk = 1").groupBy("band").agg(F.percentile(F.col("rev") / 1e6, 0.5).alias("v"))
    scores = sel.groupBy("band", "node").agg(F.sum("strength").alias("s")).join(F.broadcast(validity), "band")
    return scores.groupBy("node").agg(F.round(F.sum("s"), 6).alias("raw"), F.round(F.sum(F.col("s") * F.least(F.greatest("v", F.lit(0.0)), F.lit(1.0))), 6).alias("weighted"))


def g21_node_by_band(spark, sf):
    names = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
    p = A.selection(spark, sf).groupBy("node").pivot("band", names).agg(F.round(F.sum("strength"), 6))
    return p.select("node", *[F.coalesce(F.col(f"`{n}`"), F.lit(0.0)).alias(f"b{n[0]}") for n in names])


def g25_target_counts(spark, sf):
    sel = A.selection(spark, sf).filter("rnk = 1")
    grid = A.table(spark, sf, "nation").select(F.col("n_nationkey").alias("node")).crossJoin(F.broadcast(sel.select("band").distinct()))
    c = sel.groupBy("band", "node").agg(F.count(F.lit(1)).alias("n"))
    full = grid.join(c, ["band", "node"], "left").fillna(0, ["n"])
    return full.select("band", "node", "n", F.round(100 * F.col("n") / F.sum("n").over(Window.partitionBy("band")), 6).alias("percent"))


def g26_cross_band_agreement(spark, sf):
    t = A.selection(spark, sf).filter("rnk = 1").groupBy("unit").agg(F.countDistinct("node").alias("targets"))
    return t.groupBy("targets").agg(F.count(F.lit(1)).alias("units"))


def g27_target_entropy(spark, sf):
    c = A.selection(spark, sf).filter("rnk = 1").groupBy("band", "node").agg(F.count(F.lit(1)).alias("n"))
    return d_rounded(R.normalised_entropy(c, ["band"], 25), "entropy")


def g30_paired_wide(spark, sf):
    w = A.selection(spark, sf).filter("rnk = 1").groupBy("unit").pivot("band", ["1-URGENT", "2-HIGH", "5-LOW"]).agg(F.first("rev"))
    return w.toDF("unit", "urgent", "high", "low").dropna().select("unit", r("urgent", 4), r("high", 4), r("low", 4))


def g02_group_mean(spark, sf):
    return A.edge(spark, sf).groupBy("grp", "src", "dst").agg(F.round(F.avg("w"), 2).alias("w"), F.count(F.lit(1)).alias("n"))


def a11_participant_join(spark, sf):
    p = A.participant(spark, sf).select("subject", "age", "gender")
    return A.selection(spark, sf).filter("rnk = 1").withColumnRenamed("unit", "subject").join(p, "subject", "left").select("band", "subject", "node", "age", "gender")


def a21_completeness_audit(spark, sf):
    return f02_left_to_grid(spark, sf).groupBy("band").agg(F.sum((F.col("status") == "selected").cast("long")).alias("selected"), F.sum((F.col("status") == "no_result").cast("long")).alias("no_result"))


# ---------------------------------------------------------------- H


def h02_mann_whitney(spark, sf):
    return S.mann_whitney(A.measure(spark, sf), ["band", "measure"]).select("band", "measure", "n1", "n2", r("u"), r("p"))


def h03_corrections(spark, sf):
    t = S.mann_whitney(A.measure(spark, sf), ["band", "measure"]).select("band", "measure", "p")
    out = [S.adjust(t, "p", m, [], ["band", "measure"]).select("band", "measure", F.lit(m).alias("method"), r("p"), r("p_adj")) for m in ("fdr_bh", "bonferroni", "holm")]
    return out[0].unionByName(out[1]).unionByName(out[2])


def h04_exact_binomial(spark, sf):
    c = A.selection(spark, sf).filter("rnk = 1").groupBy("node").agg(F.sum((F.col("unit") % 2).cast("long")).alias("k"), F.count(F.lit(1)).alias("n"))
    return c.select("node", "k", "n", F.round(binomial_tail(F.col("k"), F.col("n")), 6).alias("p"))


def h11_h12_wilcoxon(spark, sf):
    w = A.selection(spark, sf).filter("rnk <= 2").groupBy("band", "unit").agg(F.max(F.when(F.col("rnk") == 1, F.col("rev"))).alias("before"), (F.max(F.when(F.col("rnk") == 2, F.col("rev"))) + 60000).alias("after")).dropna()
    return S.wilcoxon(w, ["band"]).select("band", "n", r("w_plus", 1), r("w_minus", 1), r("rank_biserial"), r("p"))


def h15_friedman(spark, sf):
    w = g30_paired_wide(spark, sf)
    return S.friedman(w, "unit", ["urgent", "high", "low"]).select("n", r("statistic"), r("p"))


def h18_wilson(spark, sf):
    c = A.participant(spark, sf).groupBy("grp").agg(F.sum("gender").alias("k"), F.count(F.lit(1)).alias("n"))
    lo, hi = S.wilson(F.col("k"), F.col("n"))
    return c.select("grp", "k", "n", F.round(lo, 6).alias("low"), F.round(hi, 6).alias("high"))


def h19_mad_iqr(spark, sf):
    return d_rounded(S.mad_iqr(A.measure(spark, sf), ["band", "measure"], "value"), "median", "mad", "iqr")


def h20_cohens_d(spark, sf):
    return d_rounded(S.cohens_d(A.measure(spark, sf), ["band", "measure"]), "d")


def h24_age_removal(spark, sf):
    return R.residuals(A.participant(spark, sf), ["gender"], "age", "balance").select("subject", r("residual", 4))


def h09_bootstrap_median(spark, sf):
    return S.bootstrap(A.measure(spark, sf), ["band", "measure"], "value", resamples=RESAMPLES).select("band", "measure", "n", r("low"), r("high"))


def h07_sign_flip(spark, sf):
    d = A.selection(spark, sf).filter("rnk <= 2").groupBy("band", "unit").agg((F.max(F.when(F.col("rnk") == 1, F.col("rev"))) - F.max(F.when(F.col("rnk") == 2, F.col("rev"))) - 60000).alias("value")).dropna()
    return S.sign_flip(d, ["band"], permutations=RESAMPLES).select("band", "n", r("mean", 4), r("p"))


def h05_selection_superiority(spark, sf):
    c = A.selection(spark, sf).filter("rnk = 1").groupBy("band", "node").agg(F.count(F.lit(1)).alias("n"))
    return S.selection_superiority(c, ["band"]).select("band", "top", "node", "n_top", "n_node", r("p"), r("p_adj"))


# ---------------------------------------------------------------- I


def i04_stratified_folds(spark, sf):
    f = A.feature(spark, sf).filter("ord = 0").select("subject", "y")
    return R.folds(f, "y", (F.col("subject") * 7919) % 10007, 5, ["subject"]).select("subject", "y", F.col("fold").cast("long").alias("fold"))


def i23_probability_metrics(spark, sf):
    m = R.probability_metrics(A.oof(spark, sf), ["band", "repeat"])
    return d_rounded(m, *[c for c in m.columns if c not in ("band", "repeat", "n")])


def i25_calibration_curve(spark, sf):
    return d_rounded(R.calibration_curve(A.oof(spark, sf), ["band"]), "predicted", "observed")


def i28_evidence_gate(spark, sf):
    m = R.probability_metrics(A.oof(spark, sf), ["band"])
    return m.select("band", R.acceptance(F.col("auc"), F.col("balanced_accuracy"), F.col("brier")).alias("failed"))


def i32_ood_distance(spark, sf):
    f = A.feature(spark, sf)
    s = f.filter("y = 1").groupBy("ord").agg(F.avg("value").alias("m"), F.stddev_samp("value").alias("sd"))
    z = (F.col("value") - F.col("m")) / F.col("sd")
    return f.join(F.broadcast(s), "ord").groupBy("subject").agg(F.round(F.sqrt(F.avg(z * z)), 6).alias("rms"))


def b26_scaled_features(spark, sf):
    f = A.feature(spark, sf)
    w = Window.partitionBy("ord")
    v = F.col("value")
    q = f.groupBy("ord").agg(F.percentile("value", 0.5).alias("med"), (F.percentile("value", 0.75) - F.percentile("value", 0.25)).alias("iqr"))
    return f.withColumn("zscore", F.round((v - F.avg(v).over(w)) / F.stddev_pop(v).over(w), 6)).withColumn("minmax", F.round((v - F.min(v).over(w)) / (F.max(v).over(w) - F.min(v).over(w)), 6)).join(F.broadcast(q), "ord").select("subject", "ord", "zscore", "minmax", F.round((v - F.col("med")) / F.col("iqr"), 6).alias("robust"))


_SEL1 = "first_ AS (SELECT * FROM selection WHERE rnk = 1)"
_SUBJ = "subj AS (SELECT band, subject, y_true, round(avg(p), 9) AS p FROM oof GROUP BY ALL)"
_WIDE = "wide AS (SELECT unit, max(rev) FILTER (WHERE band = '1-URGENT') AS urgent, max(rev) FILTER (WHERE band = '2-HIGH') AS high, max(rev) FILTER (WHERE band = '5-LOW') AS low FROM first_ GROUP BY unit HAVING urgent IS NOT NULL AND high IS NOT NULL AND low IS NOT NULL)"
_GRID = "grid AS (SELECT subject AS unit, band FROM participant, (SELECT DISTINCT band FROM selection))"
_STATUS = "status AS (SELECT g.unit, g.band, f.node, CASE WHEN f.node IS NULL THEN 'no_result' ELSE 'selected' END AS status FROM grid g LEFT JOIN first_ f USING (unit, band))"
_PAIR = "pair AS (SELECT band, unit, max(rev) FILTER (WHERE rnk = 1) AS before, max(rev) FILTER (WHERE rnk = 2) + 60000 AS after FROM selection WHERE rnk <= 2 GROUP BY ALL HAVING after IS NOT NULL)"
_MEASURES = "SELECT grp, band, measure, value FROM measure"
_CLIP = "clip AS (SELECT band, repeat, y_true, least(greatest(p, 1e-7), 1 - 1e-7) AS p FROM oof)"


def _metrics_sql(by: str) -> str:
    return f"""byp AS (SELECT {by}, p, count(*) AS c, sum(y_true) AS pos FROM clip GROUP BY ALL),
    cum AS (SELECT *, c - pos AS neg, coalesce(sum(c - pos) OVER (PARTITION BY {by} ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below,
        sum(pos) OVER (PARTITION BY {by} ORDER BY p DESC ROWS UNBOUNDED PRECEDING) AS tpc, sum(c) OVER (PARTITION BY {by} ORDER BY p DESC ROWS UNBOUNDED PRECEDING) AS nc FROM byp),
    tot AS (SELECT {by}, sum(c) AS n, coalesce(sum(pos) FILTER (WHERE p >= 0.5), 0) AS tp, coalesce(sum(neg) FILTER (WHERE p >= 0.5), 0) AS fp, coalesce(sum(pos) FILTER (WHERE p < 0.5), 0) AS fn, coalesce(sum(neg) FILTER (WHERE p < 0.5), 0) AS tn,
        sum(pos * (below + neg / 2.0)) AS a, sum(pos * tpc / nc::DOUBLE) AS ap, sum(pos * (1 - p) * (1 - p) + neg * p * p) AS b, -sum(pos * ln(p) + neg * ln(1 - p)) AS ll FROM cum GROUP BY ALL),
    bins AS (SELECT {by}, sum(abs(bp - bs)) / sum(bc) AS ece FROM (SELECT {by}, least(floor(p * 10), 9) AS bin, sum(c) AS bc, sum(pos) AS bp, sum(c * p) AS bs FROM byp GROUP BY ALL) GROUP BY ALL),
    metrics AS (SELECT {by}, CAST(n AS BIGINT) AS n, a / nullif((tp + fn) * (tn + fp), 0) AS auc, ap / nullif(tp + fn, 0) AS ap, (tp + tn) / n::DOUBLE AS accuracy, (tp / nullif(tp + fn, 0)::DOUBLE + tn / nullif(tn + fp, 0)::DOUBLE) / 2 AS balanced_accuracy,
        2 * tp / nullif(2 * tp + fp + fn, 0)::DOUBLE AS f1, tp / nullif(tp + fn, 0)::DOUBLE AS sensitivity, tn / nullif(tn + fp, 0)::DOUBLE AS specificity, b / n AS brier, ll / n AS log_loss, ece FROM tot JOIN bins USING ({by}))"""


SQL = {
    "f01_inner_join": A.sql("participant", "SELECT subject, c_name, grp, age, gender FROM participant JOIN customer ON subject = c_custkey"),
    "f02_left_to_grid": A.sql("selection participant", "SELECT * FROM status", _SEL1, _GRID, _STATUS),
    "f03_semi_join": A.sql("selection participant", "SELECT subject, grp, age FROM participant WHERE subject IN (SELECT unit FROM selection)"),
    "f04_without_urgent_orders": A.sql("selection participant", "SELECT subject, grp FROM participant WHERE subject NOT IN (SELECT unit FROM selection WHERE band = '1-URGENT' AND rnk = 5)"),
    "f04_anti_join": A.sql("selection participant", "SELECT subject, grp FROM participant WHERE subject NOT IN (SELECT unit FROM selection)"),
    "f06_candidate_grid": A.sql("selection", "SELECT n_nationkey AS node, band FROM nation, (SELECT DISTINCT band FROM selection)"),
    "f08_nearest_row": """WITH pairs AS (SELECT e.vec_id, f.vec_id AS ref, i, e.embedding[i]::DOUBLE - f.embedding[i]::DOUBLE AS x FROM embeddings e, embeddings f, range(1, 65) r(i) WHERE e.vec_id % 100 = 0 AND e.vec_id <> f.vec_id),
        ds AS (SELECT vec_id, ref, round(sqrt(sum(x * x) / 64), 6) AS d FROM pairs GROUP BY ALL)
        SELECT vec_id, ref AS nearest, d AS distance FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY d, ref) AS k FROM ds) WHERE k = 1""",
    "f10_id_intersection": "SELECT c_custkey AS subject FROM customer INTERSECT SELECT o_custkey FROM orders INTERSECT SELECT doc_id FROM labels",
    "f11_cohort_alignment": A.sql("selection", "SELECT band, count(*) AS original, count(*) FILTER (WHERE k = nb) AS common, count(*) FILTER (WHERE k < nb) AS excluded FROM (SELECT *, count(*) OVER (PARTITION BY unit) AS k FROM (SELECT DISTINCT unit, band FROM selection)), (SELECT count(DISTINCT band) AS nb FROM selection) GROUP BY band"),
    "f12_symmetric_difference": "SELECT subject, CASE WHEN a IS NULL THEN 'labels' ELSE 'orders' END AS only_in FROM (SELECT DISTINCT o_custkey AS subject, 1 AS a FROM orders) FULL JOIN (SELECT DISTINCT doc_id AS subject, 1 AS b FROM labels) USING (subject) WHERE a IS NULL OR b IS NULL",
    "f13_union_all": A.sql("participant measure", "SELECT 'customer' AS kind, subject, grp, NULL::VARCHAR AS band FROM participant UNION ALL SELECT 'document', subject, grp, band FROM measure WHERE measure = 'chars'"),
    "f14_keep_first": "SELECT o_custkey, o_orderpriority, o_orderkey, round(o_totalprice, 2) AS o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderkey) AS k FROM orders) WHERE k = 1",
    "g02_group_mean": A.sql("edge", "SELECT grp, src, dst, round(avg(w), 2) AS w, count(*) AS n FROM edge GROUP BY ALL"),
    "g05_feature_statistics": A.sql("feature", "SELECT band AS ord, round(m1, 6) AS mean1, round(s1, 6) AS sd1, round(m2, 6) AS mean2, round(s2, 6) AS sd2, round(u, 6) AS u, round(p, 6) AS p FROM tested JOIN (SELECT ord AS band, avg(v) FILTER (WHERE y = 1) AS m1, stddev_pop(v) FILTER (WHERE y = 1) AS s1, avg(v) FILTER (WHERE y = 0) AS m2, stddev_pop(v) FILTER (WHERE y = 0) AS s2 FROM (SELECT ord, y, round(value, 6) AS v FROM feature) GROUP BY ALL) USING (band)", mann_whitney_sql("SELECT CASE WHEN y = 1 THEN 'Healthy' ELSE 'Patient' END AS grp, CAST(ord AS INTEGER) AS band, '' AS measure, round(value, 6) AS value FROM feature")),
    "g06_baselines": A.sql("measure", "SELECT measure, round(CASE WHEN abs(avg(value)) < 1e-10 THEN 1.0 ELSE avg(value) END, 6) AS baseline FROM measure WHERE grp = 'Healthy' GROUP BY measure"),
    "g07_directions": A.sql("measure", "SELECT measure, CASE WHEN avg(value) FILTER (WHERE grp <> 'Healthy') > avg(value) FILTER (WHERE grp = 'Healthy') THEN 'minimise' ELSE 'maximise' END AS direction FROM measure GROUP BY measure"),
    "a14_i56_oof_means": A.sql("oof", "SELECT band, subject, y_true, round(p, 6) AS p FROM subj", _SUBJ),
    "g08_stable_percent_rank": A.sql("oof", "SELECT band, subject, round(CASE WHEN count(*) OVER (PARTITION BY band) > 1 THEN (row_number() OVER (PARTITION BY band ORDER BY p, subject) - 1) / (count(*) OVER (PARTITION BY band) - 1.0) ELSE 0 END, 6)::DOUBLE AS pct FROM subj", _SUBJ),
    "g09_average_percent_rank": A.sql("oof", "SELECT band, subject, round((rank() OVER (PARTITION BY band ORDER BY p) + (count(*) OVER (PARTITION BY band, p) - 1) / 2.0) / count(*) OVER (PARTITION BY band), 6)::DOUBLE AS pct FROM subj", _SUBJ),
    "g10_rank_across_bands": A.sql("selection", "SELECT unit, round(pct, 6) AS pct, round(least_, 4) AS least, bands, row_number() OVER (ORDER BY pct, unit) AS place FROM (SELECT unit, round(avg(pc), 9) AS pct, min(rev) AS least_, count(*) AS bands FROM (SELECT *, CASE WHEN count(*) OVER (PARTITION BY band) > 1 THEN (row_number() OVER (PARTITION BY band ORDER BY rev, unit) - 1)::DOUBLE / (count(*) OVER (PARTITION BY band) - 1) ELSE 0.0 END AS pc FROM first_) GROUP BY unit)", _SEL1),
    "g11_g12_rejection_sweep": A.sql("oof", "SELECT CAST(percent AS INTEGER) AS percent, band, count(*) AS n, string_agg(CAST(subject AS VARCHAR), ',' ORDER BY subject) AS ids FROM (SELECT *, row_number() OVER (PARTITION BY band ORDER BY p, subject) AS k, count(*) OVER (PARTITION BY band) AS n FROM subj), range(0, 60, 10) q(percent) WHERE k <= ceil(percent * n / 100.0) GROUP BY ALL", _SUBJ),
    "g15_top_per_key": "SELECT o_custkey, o_orderkey, CAST(k AS INTEGER) AS rank, round(1.0 / k, 6)::DOUBLE AS strength FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS k FROM orders) WHERE k <= 3",
    "g16_node_selections": A.sql("selection", "SELECT node, count(*) FILTER (WHERE rnk = 1) AS hard, round(sum(strength), 6) AS weighted FROM selection GROUP BY node"),
    "g17_top_rows": A.sql("selection", "SELECT node, weighted, round(weighted / max(weighted) OVER (), 6) AS rate FROM (SELECT node, round(sum(strength), 6) AS weighted FROM selection GROUP BY node) ORDER BY weighted DESC, node LIMIT 5"),
    "g18_band_scores": A.sql("selection", "SELECT band, node, round(sum(strength), 6) AS score, count(DISTINCT unit) AS units FROM selection GROUP BY ALL"),
    "g19_validity_weighted": A.sql("selection", "SELECT node, round(sum(s), 6) AS raw, round(sum(s * least(greatest(v, 0), 1)), 6) AS weighted FROM (SELECT band, node, sum(strength) AS s FROM selection GROUP BY ALL) JOIN (SELECT band, quantile_cont(rev / 1e6, 0.5) AS v FROM first_ GROUP BY band) USING (band) GROUP BY node", _SEL1),
    "g21_node_by_band": A.sql("selection", "SELECT node, " + ", ".join(f"round(coalesce(sum(strength) FILTER (WHERE band[1] = '{k}'), 0), 6) AS b{k}" for k in "12345") + " FROM selection GROUP BY node"),
    "g25_target_counts": A.sql("selection", "SELECT band, node, n, round(100 * n / (sum(n) OVER (PARTITION BY band))::DOUBLE, 6) AS percent FROM (SELECT b.band, n_nationkey AS node, count(f.node) AS n FROM nation CROSS JOIN (SELECT DISTINCT band FROM first_) b LEFT JOIN first_ f ON f.band = b.band AND f.node = n_nationkey GROUP BY ALL)", _SEL1),
    "g26_cross_band_agreement": A.sql("selection", "SELECT targets, count(*) AS units FROM (SELECT unit, count(DISTINCT node) AS targets FROM first_ GROUP BY unit) GROUP BY targets", _SEL1),
    "g27_target_entropy": A.sql("selection", "SELECT band, round(abs(sum(-p * ln(p))) / ln(25), 6) AS entropy FROM (SELECT band, count(*) / sum(count(*)) OVER (PARTITION BY band)::DOUBLE AS p FROM first_ GROUP BY band, node) GROUP BY band", _SEL1),
    "g30_paired_wide": A.sql("selection", "SELECT unit, round(urgent, 4) AS urgent, round(high, 4) AS high, round(low, 4) AS low FROM wide", _SEL1, _WIDE),
    "a11_participant_join": A.sql("selection participant", "SELECT band, unit AS subject, node, age, gender FROM first_ LEFT JOIN participant ON unit = subject", _SEL1),
    "a21_completeness_audit": A.sql("selection participant", "SELECT band, count(*) FILTER (WHERE status = 'selected') AS selected, count(*) FILTER (WHERE status = 'no_result') AS no_result FROM status GROUP BY band", _SEL1, _GRID, _STATUS),
    "h02_mann_whitney": A.sql("measure", "SELECT band, measure, n1, n2, round(u, 6) AS u, round(p, 6) AS p FROM tested", mann_whitney_sql(_MEASURES)),
    "h03_corrections": A.sql("measure", f"SELECT band, measure, 'fdr_bh' AS method, round(p, 6) AS p, CASE WHEN p IS NOT NULL THEN round({bh_sql()}, 6) END AS p_adj FROM ps UNION ALL SELECT band, measure, 'bonferroni', round(p, 6), CASE WHEN p IS NOT NULL THEN round(least(p * m, 1.0), 6) END FROM ps UNION ALL SELECT band, measure, 'holm', round(p, 6), CASE WHEN p IS NOT NULL THEN round(least(max((m - rk + 1) * p) OVER (ORDER BY rk ROWS UNBOUNDED PRECEDING), 1.0), 6) END FROM ps", mann_whitney_sql(_MEASURES), "ps AS (SELECT band, measure, p, row_number() OVER (ORDER BY p NULLS LAST, band, measure) AS rk, count(p) OVER () AS m FROM tested)"),
    "h04_exact_binomial": A.sql("selection", "SELECT node, CAST(k AS BIGINT) AS k, n, round((SELECT least(sum(exp(lgamma(n + 1.0) - lgamma(i + 1.0) - lgamma(n - i + 1.0) - n * ln(2))), 1.0) FROM range(CAST(k AS BIGINT), n + 1) q(i)), 6) AS p FROM (SELECT node, sum(unit % 2) AS k, count(*) AS n FROM first_ GROUP BY node)", _SEL1),
    "h11_h12_wilcoxon": A.sql("selection", f"SELECT band, n, round(wp, 1) AS w_plus, round(wm, 1) AS w_minus, round((wp - wm) / (wp + wm), 6) AS rank_biserial, round(least(1.0, {duck_two_sided('abs(least(wp, wm) - n * (n + 1) / 4.0) / sqrt(n * (n + 1.0) * (2 * n + 1) / 24 - t / 48)')}), 6) AS p FROM (SELECT band, count(*) AS n, coalesce(sum(rk) FILTER (WHERE d > 0), 0)::DOUBLE AS wp, coalesce(sum(rk) FILTER (WHERE d < 0), 0)::DOUBLE AS wm, sum(c * c - 1.0) AS t FROM rk_ GROUP BY band)", _PAIR, "rk_ AS (SELECT *, rank() OVER (PARTITION BY band ORDER BY a) + (count(*) OVER (PARTITION BY band, a) - 1) / 2.0 AS rk, count(*) OVER (PARTITION BY band, a) AS c FROM (SELECT band, before - after AS d, round(abs(before - after), 9) AS a FROM pair) WHERE d <> 0)"),
    "h15_friedman": A.sql("selection", f"SELECT n, round(stat, 6) AS statistic, round({duck_chi2_tail('stat', 2)}, 6) AS p FROM (SELECT max(n) AS n, round((12.0 / (max(n) * 3 * 4) * sum(r * r) - 3.0 * max(n) * 4) / (1 - sum(t) / (max(n) * 3 * 8.0)), 9) AS stat FROM (SELECT c, count(*) AS n, sum(rk) AS r, sum(ties * ties - 1.0) AS t FROM (SELECT *, rank() OVER (PARTITION BY unit ORDER BY v) + (count(*) OVER (PARTITION BY unit, v) - 1) / 2.0 AS rk, count(*) OVER (PARTITION BY unit, v) AS ties FROM (SELECT unit, 'u' AS c, round(urgent, 4) AS v FROM wide UNION ALL SELECT unit, 'h', round(high, 4) FROM wide UNION ALL SELECT unit, 'l', round(low, 4) FROM wide)) GROUP BY c))", _SEL1, _WIDE),
    "h18_wilson": A.sql("participant", "SELECT grp, CAST(k AS BIGINT) AS k, n, round(((k / n + z * z / (2 * n)) - z * sqrt(k / n * (1 - k / n) / n + z * z / (4.0 * n * n))) / (1 + z * z / n), 6) AS low, round(((k / n + z * z / (2 * n)) + z * sqrt(k / n * (1 - k / n) / n + z * z / (4.0 * n * n))) / (1 + z * z / n), 6) AS high FROM (SELECT grp, sum(gender)::DOUBLE AS k, count(*) AS n, 1.959963984540054::DOUBLE AS z FROM participant GROUP BY grp)"),
    "h19_mad_iqr": A.sql("measure", "SELECT band, measure, round(med, 6) AS median, round(quantile_cont(abs(value - med), 0.5), 6) AS mad, round(iqr, 6) AS iqr FROM measure JOIN (SELECT band, measure, quantile_cont(value, 0.5) AS med, quantile_cont(value, 0.75) - quantile_cont(value, 0.25) AS iqr FROM measure GROUP BY ALL) USING (band, measure) GROUP BY band, measure, med, iqr"),
    "h20_cohens_d": A.sql("measure", "SELECT band, measure, round(CASE WHEN sp > 0 THEN (m1 - m2) / sp ELSE 0 END, 6) AS d FROM (SELECT band, measure, avg(value) FILTER (WHERE grp = 'Healthy') AS m1, avg(value) FILTER (WHERE grp <> 'Healthy') AS m2, sqrt(((count(*) FILTER (WHERE grp = 'Healthy') - 1) * var_samp(value) FILTER (WHERE grp = 'Healthy') + (count(*) FILTER (WHERE grp <> 'Healthy') - 1) * var_samp(value) FILTER (WHERE grp <> 'Healthy')) / (count(*) - 2)) AS sp FROM measure GROUP BY ALL)"),
    "h24_age_removal": A.sql("participant", "SELECT subject, round(balance - b * (age - mx), 4) AS residual FROM participant JOIN (SELECT gender, coalesce(regr_slope(balance, age), 0) AS b, avg(age) AS mx FROM participant GROUP BY gender) USING (gender)"),
    "h07_sign_flip": A.sql("selection", f"SELECT a.band, a.n, round(a.mean, 4) AS mean, round(CASE WHEN a.mean <= 0 THEN 1.0 ELSE (h.hits + 1) / {RESAMPLES + 1}.0 END, 6) AS p FROM tot a JOIN (SELECT band, count(*) AS hits FROM flips JOIN tot USING (band) WHERE m >= mean - 1e-12 GROUP BY band) h USING (band)", "diffs AS (SELECT band, unit, max(rev) FILTER (WHERE rnk = 1) - max(rev) FILTER (WHERE rnk = 2) - 60000 AS value FROM selection WHERE rnk <= 2 GROUP BY ALL HAVING value IS NOT NULL)", "tot AS (SELECT band, count(*) AS n, avg(value) AS mean FROM diffs GROUP BY band)", f"flips AS (SELECT band, b, avg(CASE WHEN {S.duck_mixed('b', 'unit')} % 2 = 0 THEN value ELSE -value END) AS m FROM diffs, range(1, {RESAMPLES + 1}) q(b) GROUP BY ALL)"),
    "h09_bootstrap_median": A.sql("measure", "SELECT band, measure, n, round(quantile_cont(s, 0.025), 6) AS low, round(quantile_cont(s, 0.975), 6) AS high FROM stat GROUP BY ALL", "own AS (SELECT band, measure, value, row_number() OVER (PARTITION BY band, measure ORDER BY value) - 1 AS i FROM measure WHERE value IS NOT NULL)", "sizes AS (SELECT band, measure, count(*) AS n FROM own GROUP BY ALL)", f"drawn AS (SELECT band, measure, n, b, {S.duck_mixed('b', 'j')} % n AS i FROM sizes, range(1, {RESAMPLES + 1}) q(b), LATERAL (SELECT unnest(range(1, n + 1)) AS j))", "stat AS (SELECT band, measure, n, b, quantile_cont(value, 0.5) AS s FROM drawn JOIN own USING (band, measure, i) GROUP BY ALL)"),
    "h05_selection_superiority": A.sql("selection", f"SELECT band, top, node, n_top, n_node, round(p, 6) AS p, round({bh_sql('band')}, 6) AS p_adj FROM (SELECT *, row_number() OVER (PARTITION BY band ORDER BY p, node) AS rk, count(*) OVER (PARTITION BY band) AS m FROM (SELECT b.band, t.node AS top, b.node, t.n AS n_top, b.n AS n_node, (SELECT least(sum(exp(lgamma(t.n + b.n + 1.0) - lgamma(i + 1.0) - lgamma(t.n + b.n - i + 1.0) - (t.n + b.n) * ln(2))), 1.0) FROM range(t.n, t.n + b.n + 1) q(i)) AS p FROM cn b JOIN cn t ON b.band = t.band AND t.k = 1 AND b.k > 1))", _SEL1, "cn AS (SELECT *, row_number() OVER (PARTITION BY band ORDER BY n DESC, node) AS k FROM (SELECT band, node, count(*) AS n FROM first_ GROUP BY ALL))"),
    "i04_stratified_folds": A.sql("feature", "SELECT subject, y, (row_number() OVER (PARTITION BY y ORDER BY subject * 7919 % 10007) - 1) % 5 AS fold FROM feature WHERE ord = 0"),
    "i23_probability_metrics": A.sql("oof", "SELECT band, repeat, n, " + ", ".join(f"round({c}, 6) AS {c}" for c in ("auc", "ap", "accuracy", "balanced_accuracy", "f1", "sensitivity", "specificity", "brier", "log_loss", "ece")) + " FROM metrics", _CLIP, _metrics_sql("band, repeat")),
    "i25_calibration_curve": A.sql("oof", "SELECT band, CAST(bin AS INTEGER) AS bin, count(*) AS n, round(avg(p), 6) AS predicted, round(avg(y_true), 6) AS observed FROM (SELECT o.*, (SELECT count(*) FROM unnest(e.e) u(x) WHERE x < o.p) AS bin FROM oof o JOIN (SELECT band, quantile_cont(p, [0.125, 0.25, 0.375, 0.5, 0.625, 0.75, 0.875]) AS e FROM oof GROUP BY band) e ON o.band = e.band) GROUP BY ALL"),
    "i28_evidence_gate": A.sql("oof", "SELECT band, concat_ws(',', CASE WHEN auc < 0.75 THEN 'auc' END, CASE WHEN balanced_accuracy < 0.70 THEN 'balanced_accuracy' END, CASE WHEN brier > 0.20 THEN 'brier' END) AS failed FROM metrics", _CLIP, _metrics_sql("band")),
    "i32_ood_distance": A.sql("feature", "SELECT subject, round(sqrt(avg(((value - m) / sd) ** 2)), 6) AS rms FROM feature JOIN (SELECT ord, avg(value) AS m, stddev_samp(value) AS sd FROM feature WHERE y = 1 GROUP BY ord) USING (ord) GROUP BY subject"),
    "b26_scaled_features": A.sql("feature", "SELECT subject, CAST(ord AS INTEGER) AS ord, round((value - avg(value) OVER o) / stddev_pop(value) OVER o, 6) AS zscore, round((value - min(value) OVER o) / (max(value) OVER o - min(value) OVER o), 6) AS minmax, round((value - med) / iqr, 6) AS robust FROM feature JOIN (SELECT ord, quantile_cont(value, 0.5) AS med, quantile_cont(value, 0.75) - quantile_cont(value, 0.25) AS iqr FROM feature GROUP BY ord) USING (ord) WINDOW o AS (PARTITION BY ord)"),
}
QUERIES = {k: v for k, v in list(globals().items()) if k[:1] in "abfghi" and k[1:3].isdigit() and callable(v)}
