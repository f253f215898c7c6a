"""Further queries: feature tables, exchange, matched points, resampled comparisons, estimators and measures side by side."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions import registry
from corvane.functions.stages import stage_table
from corvane.functions.tails import duck_two_sided
from corvane.operators import connectivity as C
from corvane.operators import edges as E
from corvane.operators import graph as G
from corvane.operators import labels as L
from corvane.operators import measures
from corvane.operators import models as M
from corvane.operators import recordings as X
from corvane.operators import rollups as R
from corvane.operators import signals as S
from corvane.operators import stacks
from corvane.operators import stats as T
from corvane.operators import tables as B
from corvane.operators import var as V
from corvane.operators import whatif as W
from corvane.plans import cohort, network, spectral, sweeps
from corvane.plans.network import KEY, matrix, net, nodes, r
from corvane.sources import adapters as A

STORED_BANDS = ["fr", "xx", "en"]
RESAMPLES = cohort.RESAMPLES
MEASURES = ["chars", "length", "lines"]

# ---------------------------------------------------------------- A, B


def a09_channel_metadata_json(spark, sf):
    c = A.table(spark, sf, "events").select(F.col("user_id").alias("subject"), F.col("event_type").alias("channel")).distinct()
    return B.exchanged_json(L.order_channels(c).select("subject", "channel", "ord"))


def a10_ranking_csv(spark, sf):
    s = A.selection(spark, sf).groupBy("node").agg(F.round(F.sum("strength"), 6).alias("score"), F.count(F.lit(1)).alias("n"))
    return B.exchanged_csv(s, ["node", "score"]).orderBy(F.col("score").desc(), "node")


def a19_failure_manifest(spark, sf):
    """Subjects without a result for a band, with what is missing, sorted."""
    lacking = cohort.f02_left_to_grid(spark, sf).filter("status = 'no_result'").groupBy(F.col("unit").alias("subject"))
    return lacking.agg(F.concat(F.lit("no result for "), F.concat_ws(", ", F.array_sort(F.collect_list("band")))).alias("message")).orderBy("subject")


def b07_nearest_alias(spark, sf):
    own = A.table(spark, sf, "supplier").select(F.col("s_name").alias("name"), (F.col("s_acctbal").cast("double") / 1000).alias("x"), (F.col("s_suppkey") % 13 - 6).cast("double").alias("y"), (F.col("s_suppkey") % 7 + 1).cast("double").alias("z"))
    to = A.table(spark, sf, "nation").select(F.col("n_name").alias("name"), (F.col("n_nationkey") % 5 - 2).cast("double").alias("x"), (F.col("n_nationkey") % 7 - 3).cast("double").alias("y"), (F.col("n_nationkey") / 5 + 1).cast("double").alias("z"))
    return L.nearest_alias(own, to, 1.0).select("channel", "alias", r("distance"))


def b12_display_cleanup(spark, sf):
    return sweeps._names(spark, sf).select("p_partkey", L.without_reference(F.col("name")).alias("label"))


def _by_quarter(spark, sf) -> DataFrame:
    e = E.dense(network.raw(spark, sf), nodes(spark, sf), diagonal=False)
    return e.withColumns({"unit": F.regexp_extract("subject", "^(.*)-[0-9]$", 1), "band": F.substring("subject", -1, 1)})


def b25_stacked_bands(spark, sf):
    e = _by_quarter(spark, sf)
    whole = e.groupBy("unit").agg(F.count_distinct("band").alias("k")).filter("k = 4").select("unit")  # the last year has fewer quarters
    v = B.stacked_bands(e.join(whole, "unit", "left_semi"), ["grp", "unit"], ["1", "2", "3", "4"])
    return v.select("grp", "unit", F.col("n").cast("long").alias("n"), F.sha2(F.concat_ws(",", F.transform("vector", lambda x: F.round(x, 0).cast("long").cast("string"))), 256).alias("vector"))


def _gapped(spark, sf) -> DataFrame:
    f = A.feature(spark, sf)
    return f.withColumn("value", F.when((F.col("subject") % 97 == 0) & (F.col("ord") % 10 == 3), float("nan")).otherwise(F.col("value")))


def b27_complete_features(spark, sf):
    return B.complete_features(_gapped(spark, sf)).groupBy("ord").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 6).alias("mean"))


def b28_schema_alignment(spark, sf):
    f = A.feature(spark, sf).withColumn("feature", F.concat(F.lit("x"), F.col("ord")))
    return B.aligned(f, ["x9", "x2", "x40", "x0"]).select("subject", "feature", "place", r("value"))


def b34_zero_filled(spark, sf):
    w = B.zero_filled(A.measure(spark, sf), ["subject", "grp"], cohort.BANDS, MEASURES)
    return w.select("subject", (F.col("grp") != "Healthy").cast("int").alias("label"), *[f"{m}_{b}" for m in MEASURES for b in cohort.BANDS])


def b37_band_order(spark, sf):
    return B.band_order(A.measure(spark, sf), STORED_BANDS)


def b38_rows_of_one_band(spark, sf):
    m = A.measure(spark, sf)
    wanted = L.resolve_band(F.lit(None).cast("string"), F.lit(2), F.array(*map(F.lit, cohort.BANDS)))
    return m.filter(F.col("band") == wanted).select("subject", "band", "measure", r("value"))


def b39_detection_matrix(spark, sf):
    return E.symmetrise(E.dense(network.raw(spark, sf), nodes(spark, sf))).select(*KEY, "src", "dst", r("w", 5))


def b40_zero_diagonal(spark, sf):
    return B.zero_diagonal(A.edge(spark, sf)).select(*KEY, "src", "dst", r("w", 4))


# ---------------------------------------------------------------- C


def c14_feature_rows(spark, sf):
    """Per subject and channel: log power, entropy and mean Hjorth values."""
    p, e, h = (stage_table(x, "feature") for x in (spectral.c11_band_power(spark, sf), spectral.c12_spectral_entropy(spark, sf), spectral.c13_hjorth(spark, sf)))
    mean = h.groupBy("subject", "channel").agg(*[(F.avg(c) + 1e-8).alias(c) for c in ("activity", "mobility", "complexity")])  # means of rounded values: no ties when they are rounded again
    return p.join(e, ["subject", "channel"]).join(mean, ["subject", "channel"]).select("subject", "channel", F.round(F.log10(F.col("power") + 1e-12), 4).alias("log_power"), r("entropy", 5), r("activity", 3), r("mobility", 5), r("complexity", 5))


def c23_held_out_epochs(spark, sf):
    h = B.held_out(spectral.samples(spark, sf), ["grp", "subject"])
    return h.groupBy("subject", "channel", "part").agg(F.count_distinct("epoch").alias("epochs"), F.count(F.lit(1)).alias("n"), F.round(F.avg("v"), 5).alias("mean"))


def c26_baseline_vector(spark, sf):
    grid = A.signal(spark, sf).select("subject", "channel").distinct()
    rms = S.rms(spectral.samples(spark, sf)).filter("subject % 3 = 0").select("subject", "channel", F.col("rms").alias("value"))
    stored = A.table(spark, sf, "events").filter("user_id % 3 = 1").groupBy(F.col("user_id").alias("subject"), F.col("event_type").alias("channel")).agg(F.round(F.avg("value"), 6).alias("value"))
    scaled = S.baseline_activation(A.signal(spark, sf)).select("subject", "channel", "value")
    return B.first_available(grid, [rms, stored, scaled], ["subject", "channel"]).select("subject", "channel", r("value"), "source")


def _packed(spark, sf) -> DataFrame:
    return S.packed(spectral.samples(spark, sf))


def _checked(epochs: DataFrame) -> DataFrame:
    return epochs.select("subject", "channel", "epoch", F.size("x").alias("n"), F.round(F.aggregate("x", F.lit(0.0), lambda s, v: s + v * v), 3).alias("energy"))


def c02_c04_band_pass(spark, sf):
    return _checked(V.band_pass(_packed(spark, sf), 2.0, 6.0, 20.0))


def c05_broadband(spark, sf):
    """Filtered, resampled to half the rate and standardised."""
    x = V.resample(V.band_pass(_packed(spark, sf), 1.0, 8.0, 20.0), 1, 2)
    flat = x.select("grp", "subject", "channel", "epoch", F.posexplode("x").alias("k", "v"))
    w = Window.partitionBy("grp", "subject", "channel")  # not a join, which would filter twice
    return flat.withColumns({"m": F.avg("v").over(w), "s": F.stddev_pop("v").over(w)}).select("subject", "channel", "epoch", "k", F.round((F.col("v") - F.col("m")) / F.greatest("s", F.lit(1e-12)), 4).alias("v"))


def c06_resampled(spark, sf):
    return _checked(V.resample(_packed(spark, sf), 3, 2))


def c16_envelopes(spark, sf):
    return _checked(V.log_envelopes(_packed(spark, sf)))


# ---------------------------------------------------------------- D


def d39_all_estimators(spark, sf):
    """Every estimator of every band in one long table."""
    kernel = X.estimator_rows(spectral.HANN, spectral.BINS, spectral.BANDS)
    x = X.apply(A.recordings(spark, sf), A.BINS, spectral.N, kernel, ["band", "src", "dst", "method"], ["w"])
    return x.select("band", "subject", "src", "dst", "method", r("w", 5))


def d18_envelope_correlation(spark, sf):
    return V.envelope_correlation(_packed(spark, sf)).select("subject", "src", "dst", r("w", 4))


def _gram(spark, sf, order: int = 1) -> DataFrame:
    return stage_table(C.gram(S.standardised(spectral.samples(spark, sf)), order), "gram")


def d21_conditional_wald(spark, sf):
    return V.conditional_wald(_gram(spark, sf), 1, 10.0, 114).select("subject", "src", "dst", r("w", 4))


def d22_d24_directed(spark, sf):
    bands = {"delta": (0.05, 0.15), "alpha": (0.2, 0.3), "beta": (0.35, 0.5)}
    return V.spectral_directed(_gram(spark, sf), 1, bands, 1.0).select("subject", "band", "src", "dst", r("pdc", 4), r("dtf", 4))


def d25_d40_diagnostics(spark, sf):
    return V.diagnostics(_gram(spark, sf), 1, 1.0).select("subject", r("radius", 4), "stable", r("mse", 2))


def d26_order_choice(spark, sf):
    out = None
    for order in (1, 2):
        g = _gram(spark, sf, order)
        for ridge in (1.0, 10.0):
            one = V.diagnostics(g, order, ridge).select("grp", "subject", F.lit(order).alias("ord"), F.lit(ridge).alias("ridge"), "stable", "mse")
            out = one if out is None else out.unionByName(one)
    return V.select_order(out).select("subject", "ord", "ridge")


def d28_residual_autocorrelation(spark, sf):
    """Mean |lag-1|, mean and largest |correlation| of residuals over channels and lags 1 to 3, inside epochs, of an order-1 fit of standardised samples."""
    c = X.apply(A.recordings(spark, sf), A.BINS, spectral.N, X.autocorrelation_rows(1.0), [], ["lag1", "mean", "top"])
    return c.select("subject", r("lag1", 4), r("mean", 4), r("top", 4))


def d42_pooled_lag1(spark, sf):
    """Correlation of consecutive residual rows, all channels together, across epoch ends too."""
    return X.apply(A.recordings(spark, sf), A.BINS, spectral.N, X.pooled_rows(1.0), [], ["lag1"]).select("subject", r("lag1", 4))


def d32_log_euclidean(spark, sf):
    """Of shrunk correlation matrices with their diagonal."""
    c = C.correlation_edges(spectral.samples(spark, sf)).select("grp", "subject", "src", "dst", F.col("shrunk").alias("w"))
    n = spectral.samples(spark, sf).select("grp", "subject", F.col("channel").alias("src"), F.col("channel").alias("dst"), F.lit(1.0).alias("w")).distinct()
    return V.log_euclidean(c.unionByName(n)).select("subject", "src", "dst", r("w", 4))


def d33_upper_vector(spark, sf):
    return B.upper_vector(E.symmetrise(matrix(spark, sf))).select(*KEY, "src", "dst", r("w"))


def d37_reliability_summary(spark, sf):
    d = spectral.d34_split_half_reliability(spark, sf)
    return d.groupBy((F.col("subject") % 2).alias("part")).agg(F.round(F.percentile("spearman", 0.5), 5).alias("median_spearman"), F.round(F.avg("spearman"), 5).alias("mean_spearman"), F.round(F.percentile("error", 0.5), 5).alias("median_error"), F.round(F.percentile("jaccard", 0.5), 5).alias("median_jaccard"), F.count("spearman").alias("n"))


# ---------------------------------------------------------------- E, F, G

_NESTED = {"assortativity": "e11_assortativity", "clustering": "e05_clustering", "diameter": "e14_diameter", "global_efficiency": "e02_global_efficiency", "mean_strength": "e08_mean_strength", "path_length": "e22_path_length", "transitivity": "e06_transitivity"}
_WEIGHTS = ["density", "mean", "sd", "median", "max", "min", "cv"]


def e04_local_efficiency(spark, sf):
    return G.local_efficiency(net(spark, sf)).select(*KEY, r("value"))


def e23_all_measures(spark, sf):
    out = registry.all_measures(net(spark, sf), nodes(spark, sf), [*_NESTED, *_WEIGHTS])
    return out.select(*KEY, "measure", r("value"))


def e24_measures_of_connectivity(spark, sf):
    """Measures of every subject, estimator and band in one long table."""
    return _measures_of_connectivity(spark, sf, ["clustering", "density", "mean", "mean_strength", "transitivity"])


def _measures_of_connectivity(spark, sf, names: list[str]) -> DataFrame:
    """Measures of the rounded estimators of `d39_all_estimators`: in one pass over recordings where there are few channels, else by joins."""
    listed = sorted(x["node"] for x in A.table(spark, sf, "events").select(F.col("event_type").alias("node")).filter("node IS NOT NULL").distinct().limit(stacks.MOST_NODES + 1).collect())
    if not 2 <= len(listed) <= stacks.MOST_NODES or not registry.built_in(names):
        m = registry.all_measures(*_connectivity(spark, sf), names)
        part = F.split("subject", "[|]")
        return m.select(part[0].alias("subject"), part[1].alias("method"), part[2].alias("band"), "measure", r("value", 4))
    rows, kernel = A.recordings(spark, sf), X.graph_rows(spectral.HANN, spectral.BINS, spectral.BANDS, names)
    if "small_worldness" in names:
        rows = rows.withColumn("draws", _draws(len(listed)))
    m = X.apply(rows, A.BINS, spectral.N, kernel, ["method", "band", "measure"], ["value"], 5)
    return m.select(F.col("subject").cast("string").alias("subject"), "method", "band", "measure", F.round(F.when(~F.isnan("value"), F.col("value")), 4).alias("value"))


def _draws(n: int) -> Column:
    """The draws of `stacks.measures` for the graph of every method and band, in order: a number for each ordered pair of different channels."""
    keys = F.array(*[F.concat_ws("|", "subject", F.lit(m), F.lit(b)) for m in X.UNDIRECTED + X.DIRECTED for b in spectral.BANDS])
    ordered = F.array(*[F.struct(F.col("channels")[i].alias("src"), F.col("channels")[j].alias("dst")) for i in range(n) for j in range(n) if i != j])
    one = lambda k, p: F.pmod(F.xxhash64(F.lit(measures.SEED), F.lit("all"), k, p["src"], p["dst"]), F.lit(1 << 40)) / float(1 << 40)
    return F.flatten(F.transform(keys, lambda k: F.transform(ordered, lambda p: one(k, p))))


def _connectivity(spark, sf) -> tuple[DataFrame, DataFrame]:
    """(edges, nodes) of every subject, estimator and band as graphs of their own."""
    x = d39_all_estimators(spark, sf).filter("w > 0").select(F.lit("all").alias("grp"), F.concat_ws("|", "subject", "method", "band").alias("subject"), "src", "dst", "w")
    both = x.filter("NOT (subject LIKE '%dpli|%' OR subject LIKE '%psi|%' OR subject LIKE '%|dwpli|%')").select("grp", "subject", F.col("dst").alias("src"), F.col("src").alias("dst"), "w")
    e = stage_table(x.unionByName(both), "net")  # undirected estimators count both ways
    n = A.table(spark, sf, "events").select(F.col("event_type").alias("node")).distinct()
    return e, n


def e23_twenty_measures(spark, sf):
    """All built-in measures of every trade graph, those of partitions and random graphs among them."""
    return registry.all_measures(net(spark, sf), nodes(spark, sf)).select(*KEY, "measure", r("value", 4))


def e24_twenty_measures_of_connectivity(spark, sf):
    """All built-in measures of every subject, estimator and band."""
    return _measures_of_connectivity(spark, sf, sorted(registry.MEASURES))


def g14_rank_lookup(spark, sf):
    s = cohort.g18_band_scores(spark, sf)
    return s.withColumn("place", F.row_number().over(Window.partitionBy("band").orderBy(F.col("score").desc(), "node"))).filter("place = 3").select("band", "node", "score", "place")


def _targets(spark, sf) -> DataFrame:
    return A.measure(spark, sf).filter("grp = 'Healthy'").groupBy("measure").agg(F.avg("value").alias("t"))


def g36_g43_group_points(spark, sf):
    p = B.points(A.measure(spark, sf), ["grp", "subject", "band"], MEASURES, _targets(spark, sf))
    return p.select("grp", "subject", "band", *[r(m) for m in MEASURES], "reason")


def g39_probability_change(spark, sf):
    o = A.oof(spark, sf).groupBy("band", "subject").agg(F.max(F.when(F.col("repeat") == 0, F.col("p"))).alias("initial"), F.max(F.when(F.col("repeat") == 2, F.col("p"))).alias("final"))
    return o.select("band", "subject", r("initial"), r("final"), F.round(F.col("initial") - F.col("final"), 6).alias("improvement"))


def g42_before_after(spark, sf):
    s = A.selection(spark, sf).groupBy("band", "unit").agg(F.max(F.when(F.col("rnk") == 2, F.col("rev"))).alias("before"), F.max(F.when(F.col("rnk") == 1, F.col("rev"))).alias("after"), F.count(F.lit(1)).alias("k"))
    return s.select("band", "unit", r("before", 4), r("after", 4), F.when(F.col("before").isNull(), "no second solution").when(F.col("k") < 5, "short list").alias("reason"))


def g45_top_nodes(spark, sf):
    """The first five nodes of each band by count and by weight in one table."""
    s = A.selection(spark, sf).groupBy("band", "node").agg(F.sum((F.col("rnk") == 1).cast("long")).cast("double").alias("count"), F.round(F.sum("strength"), 6).alias("weight"))
    long = s.select("band", "node", F.explode(F.create_map(F.lit("count"), F.col("count"), F.lit("weight"), F.col("weight"))).alias("kind", "score"))
    return long.withColumn("place", F.row_number().over(Window.partitionBy("band", "kind").orderBy(F.col("score").desc(), "node"))).filter("place <= 5")


# ---------------------------------------------------------------- H


def h06_rank_weights(spark, sf):
    s = A.selection(spark, sf).groupBy("unit", "node").agg(F.sum("strength").alias("w"))
    return s.filter("w > 0").select("unit", "node", r("w"))


def h13_metric_tests(spark, sf):
    w = A.selection(spark, sf).filter("rnk <= 2").groupBy("band", "unit").agg(F.max(F.when(F.col("rnk") == 1, F.col("rev"))).alias("before"), (F.max(F.when(F.col("rnk") == 2, F.col("rev"))) + 60000).alias("after")).dropna()
    m = w.groupBy("band").agg(F.percentile("before", 0.5).alias("m1"), F.percentile("after", 0.5).alias("m2"))
    t = T.adjust(T.wilcoxon(w, ["band"]), "p", "holm", [], ["band"])
    return t.join(m, "band").select("band", r("m1", 4), r("m2", 4), r("rank_biserial"), r("p"), r("p_adj"))


def h16_rank_probabilities(spark, sf):
    p = B.rank_probabilities(cohort.g30_paired_wide(spark, sf), "unit", ["urgent", "high", "low"], RESAMPLES)
    return p.select("name", r("p"))


def h21_fisher(spark, sf):
    p = A.participant(spark, sf).join(A.selection(spark, sf).filter("rnk = 1").select("band", F.col("unit").alias("subject")), "subject")
    case = lambda g, x: F.sum(((F.col("grp") == g) & (F.col("gender") == x)).cast("long"))
    t = p.groupBy("band").agg(case("Healthy", 0).alias("a"), case("Healthy", 1).alias("b"), case("Patient", 0).alias("c"), case("Patient", 1).alias("d"))
    return t.select("band", "a", "b", "c", "d", F.round(T.fisher(F.col("a"), F.col("b"), F.col("c"), F.col("d")), 6).alias("p"))


def h23_auc_difference(spark, sf):
    s = A.oof(spark, sf).groupBy("band", "subject", F.col("y_true").alias("y")).agg(F.max(F.when(F.col("repeat") == 0, F.col("p"))).alias("a"), F.max(F.when(F.col("repeat") == 1, F.col("p"))).alias("b"))
    return B.auc_difference(s, ["band"], RESAMPLES).select("band", r("low"), r("high"))


# ---------------------------------------------------------------- I, J, L


def i05_repeated_folds(spark, sf):
    """Three repeats of five stratified folds; the repeat is part of the stratum, so no stratum is dealt twice."""
    f = A.feature(spark, sf).filter("ord = 0").select("subject", "y").withColumn("repeat", F.explode(F.array(*map(F.lit, range(3)))))
    place = F.row_number().over(Window.partitionBy("repeat", "y").orderBy((F.col("subject") * 7919 + F.col("repeat") * 104729) % 10007, "subject"))
    return f.select("subject", "y", "repeat", ((place - 1) % 5).cast("int").alias("fold"))


def i33_manifold_distance(spark, sf):
    """RMS z-distance of every hundredth row to the nearest row of class 1, by statistics of class 1."""
    f = A.feature(spark, sf)
    s = f.filter("y = 1").groupBy("ord").agg(F.avg("value").alias("m"), F.stddev_samp("value").alias("sd"))
    z = f.join(F.broadcast(s), "ord").groupBy("subject", "y").agg(F.array_sort(F.collect_list(F.struct("ord", ((F.col("value") - F.col("m")) / F.col("sd")).alias("z")))).alias("c")).select("subject", "y", F.col("c.z").alias("v"))
    z = stage_table(z, "scaled")
    return R.nearest(z.filter("subject % 100 = 0").select("subject", "v"), z.filter("y = 1").select(F.col("subject").alias("ref"), F.col("v").alias("u")), "subject", "ref")


def i09_i22_classifiers(spark, sf):
    """Probabilities of the odd subjects by every classifier, trained on the even ones."""
    from pyspark.ml import Pipeline

    d = stage_table(M.wide(A.feature(spark, sf).select("subject", "y", "ord", "value"), 64), "wide")
    train, test = d.filter("subject % 2 = 0"), d.filter("subject % 2 = 1")
    n, out = train.count(), None
    for name in ("logistic", "elastic_net", "linear_svm", "gaussian_nb", "random_forest", "gradient_boosting"):
        model = Pipeline(stages=[*M.preprocessing(64, 20), M.classifier(name, 1.0, n)]).fit(train)
        one = M.probability(model.transform(test)).select("subject", "y", F.lit(name).alias("model"), F.round("p", 3).alias("p"))
        out = one if out is None else out.unionByName(one)
    return out


def i53_kmeans(spark, sf):
    c = A.participant(spark, sf).select("subject", "age", "balance")
    k, found = M.select_kmeans(c, ["age", "balance"], 4)
    return found.groupBy("cluster").agg(F.count(F.lit(1)).alias("n")).withColumn("k", F.lit(k))


def j01_propagation(spark, sf):
    return W.propagation(matrix(spark, sf)).select(*KEY, "src", "dst", r("w", 5))


def j08_renormalised_update(spark, sf):
    """Co-activation update, then min-max, of every candidate."""
    c = W.coactivation(matrix(spark, sf), sweeps._gain(spark, sf), 1.0, 1.0)
    key = [*KEY, "cand"]
    s = c.groupBy(*key).agg(F.min("new").alias("lo"), F.max("new").alias("hi"), F.avg("new").alias("m"), F.stddev_pop("new").alias("s"))
    span = F.col("hi") - F.col("lo")
    return s.select(*key, F.round(F.when(span > 0, (F.col("m") - F.col("lo")) / span).otherwise(0.0), 6).alias("mean"), F.round(F.when(span > 0, F.col("s") / span).otherwise(0.0), 6).alias("sd"))


def j15_initial_metrics(spark, sf):
    s = G.weight_statistics(matrix(spark, sf), nodes(spark, sf))
    full = F.greatest(*[F.col(c).isNull().cast("int") for c in ("density", "mean", "cv")]) == 0
    return s.select(*KEY, *[F.round(F.when(full, F.col(c)), 6).alias(c) for c in ("density", "mean", "cv")])


def l05_node_statistics(spark, sf):
    """Node strengths of each graph by every registered statistic."""
    s = G.node_strength(net(spark, sf), nodes(spark, sf))
    return s.groupBy(*KEY).agg(*[F.round(fn(F.col("s_total")), 6).alias(name) for name, fn in sorted(registry.STATISTICS.items()) if name in ("mean", "median", "sd", "max", "min")])


# ---------------------------------------------------------------- SQL

_S1 = "first_ AS (SELECT * FROM selection WHERE rnk = 1)"
_SYM = "sym_ AS (SELECT a.grp, a.subject, a.src, a.dst, (a.w + b.w) / 2 AS w FROM cells a JOIN cells b ON a.grp = b.grp AND a.subject = b.subject AND a.src = b.dst AND a.dst = b.src)"
_RMS = "SELECT subject, channel, sqrt(avg(v * v)) AS value FROM epoch_sample GROUP BY ALL"
SQL = {
    "a09_channel_metadata_json": "SELECT user_id AS subject, event_type AS channel, CAST(row_number() OVER (PARTITION BY user_id ORDER BY event_type) - 1 AS INTEGER) AS ord FROM (SELECT DISTINCT user_id, event_type FROM events)",
    "a10_ranking_csv": A.sql("selection", "SELECT node, round(sum(strength), 6) AS score, count(*) AS n FROM selection GROUP BY node"),
    "a19_failure_manifest": A.sql("selection participant", "SELECT unit AS subject, 'no result for ' || string_agg(band, ', ' ORDER BY band) AS message FROM status WHERE status = 'no_result' GROUP BY unit", cohort._SEL1, cohort._GRID, cohort._STATUS),
    "b07_nearest_alias": """WITH t AS (SELECT n_name AS name, x / r AS x, y / r AS y, z / r AS z, r FROM (SELECT *, sqrt(x * x + y * y + z * z) AS r FROM (SELECT n_name, (n_nationkey % 5 - 2)::DOUBLE AS x, (n_nationkey % 7 - 3)::DOUBLE AS y, n_nationkey / 5.0::DOUBLE + 1 AS z FROM nation)) WHERE r > 0),
        s AS (SELECT s_name AS name, x / r AS x, y / r AS y, z / r AS z FROM (SELECT *, sqrt(x * x + y * y + z * z) AS r FROM (SELECT s_name, s_acctbal::DOUBLE / 1000 AS x, (s_suppkey % 13 - 6)::DOUBLE AS y, (s_suppkey % 7 + 1)::DOUBLE AS z FROM supplier)) WHERE r > 0),
        d AS (SELECT s.name AS channel, t.name AS alias, sqrt((s.x - t.x) ** 2 + (s.y - t.y) ** 2 + (s.z - t.z) ** 2) * (SELECT quantile_cont(r, 0.5) FROM t) AS d FROM s, t)
        SELECT channel, alias, round(d, 6) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY channel ORDER BY d, alias) AS k FROM d) WHERE k = 1 AND d <= 1.0""",
    "b12_display_cleanup": f"WITH {sweeps._NAMES} SELECT p_partkey, clean AS label FROM names",
    "b25_stacked_bands": network._sql("SELECT grp, unit, count(*) AS n, sha256(string_agg(CAST(CAST(round(w) AS BIGINT) AS VARCHAR), ',' ORDER BY band, src, dst)) AS vector FROM by_quarter WHERE unit IN (SELECT unit FROM by_quarter GROUP BY unit HAVING count(DISTINCT band) = 4) GROUP BY ALL", "by_quarter AS (SELECT *, left(subject, length(subject) - 2) AS unit, right(subject, 1) AS band FROM grid WHERE src <> dst)"),
    "b27_complete_features": A.sql("feature", "SELECT CAST(ord AS INTEGER) AS ord, count(*) AS n, round(avg(value), 6) AS mean FROM feature WHERE ord % 10 <> 3 OR NOT EXISTS (SELECT 1 FROM embeddings WHERE vec_id % 97 = 0) GROUP BY ord"),
    "b28_schema_alignment": A.sql("feature", "SELECT subject, 'x' || ord AS feature, CAST(CASE ord WHEN 9 THEN 0 WHEN 2 THEN 1 WHEN 40 THEN 2 ELSE 3 END AS INTEGER) AS place, round(value, 6) AS value FROM feature WHERE ord IN (9, 2, 40, 0)"),
    "b34_zero_filled": A.sql("measure", "SELECT subject, CAST(grp <> 'Healthy' AS INTEGER) AS label, " + ", ".join(f"coalesce(max(value) FILTER (WHERE band = '{b}' AND measure = '{m}'), 0) AS {m}_{b}" for m in MEASURES for b in cohort.BANDS) + " FROM measure GROUP BY subject, grp"),
    "b37_band_order": A.sql("measure", "SELECT band, CAST(row_number() OVER (ORDER BY CASE band WHEN 'fr' THEN 0 WHEN 'en' THEN 2 ELSE 9 END, band) AS INTEGER) AS place FROM (SELECT DISTINCT band FROM measure)"),
    "b38_rows_of_one_band": A.sql("measure", "SELECT subject, band, measure, round(value, 6) AS value FROM measure WHERE band = 'es'"),
    "b39_detection_matrix": network._sql("SELECT a.grp, a.subject, a.src, a.dst, round((a.w + b.w) / 2, 5) AS w FROM cells a JOIN cells b ON a.grp = b.grp AND a.subject = b.subject AND a.src = b.dst AND a.dst = b.src", "cells AS MATERIALIZED (SELECT * FROM grid)"),
    "b40_zero_diagonal": A.sql("edge", "SELECT grp, subject, src, dst, round(CASE WHEN src = dst THEN 0.0 ELSE w END, 4) AS w FROM edge"),
    "c14_feature_rows": f"WITH p AS ({spectral.SQL['c11_band_power']}), e AS ({spectral.SQL['c12_spectral_entropy']}), h AS ({spectral.SQL['c13_hjorth']}), m AS (SELECT subject, channel, avg(activity) + 1e-8 AS activity, avg(mobility) + 1e-8 AS mobility, avg(complexity) + 1e-8 AS complexity FROM h GROUP BY ALL) SELECT subject, channel, round(log10(power + 1e-12), 4) AS log_power, round(entropy, 5) AS entropy, round(activity, 3) AS activity, round(mobility, 5) AS mobility, round(complexity, 5) AS complexity FROM p JOIN e USING (subject, channel) JOIN m USING (subject, channel)",
    "c23_held_out_epochs": A.sql("epoch_sample", "SELECT subject, channel, part, count(DISTINCT epoch) AS epochs, count(*) AS n, round(avg((v - m) / greatest(s, 1e-12)), 5) AS mean FROM (SELECT *, avg(v) FILTER (WHERE part = 'train') OVER w AS m, stddev_pop(v) FILTER (WHERE part = 'train') OVER w AS s FROM (SELECT *, CASE WHEN epoch >= 4 THEN 'validate' ELSE 'train' END AS part FROM epoch_sample) WINDOW w AS (PARTITION BY subject, channel)) GROUP BY ALL"),
    "c26_baseline_vector": A.sql("epoch_sample", "SELECT subject, channel, round(coalesce(a.value, b.value, c.value), 6) AS value, CASE WHEN a.value IS NOT NULL THEN 0 WHEN b.value IS NOT NULL THEN 1 ELSE 2 END AS source FROM c LEFT JOIN a USING (subject, channel) LEFT JOIN b USING (subject, channel)", f"a AS (SELECT * FROM ({_RMS}) WHERE subject % 3 = 0)", "b AS (SELECT user_id AS subject, event_type AS channel, round(avg(value), 6) AS value FROM events WHERE user_id % 3 = 1 GROUP BY ALL)", "c AS (SELECT subject, channel, (m - min(m) OVER w) / (max(m) OVER w - min(m) OVER w + 1e-10) * 0.9 + 0.1 AS value FROM (SELECT subject, channel, avg(v) AS m FROM signal GROUP BY ALL) WINDOW w AS (PARTITION BY subject))"),
    "d33_upper_vector": network._sql("SELECT grp, subject, src, dst, round(CASE WHEN src = dst THEN w ELSE w * sqrt(2.0) END, 6) AS w FROM sym_ WHERE src <= dst", "cells AS MATERIALIZED (SELECT * FROM matrix)", _SYM),
    "d37_reliability_summary": f"SELECT subject % 2 AS part, round(quantile_cont(spearman, 0.5), 5) AS median_spearman, round(avg(spearman), 5) AS mean_spearman, round(quantile_cont(error, 0.5), 5) AS median_error, round(quantile_cont(jaccard, 0.5), 5) AS median_jaccard, count(spearman) AS n FROM ({spectral.SQL['d34_split_half_reliability']}) GROUP BY ALL",
    "d39_all_estimators": f"WITH u AS MATERIALIZED ({spectral.SQL['d02_d08_undirected']}), d AS MATERIALIZED ({spectral.SQL['d09_d11_directed']}) " + " UNION ALL ".join(f"SELECT band, subject, src, dst, '{m}' AS method, {m} AS w FROM {t}" for t, names in (("u", ("coherence", "imcoh", "plv", "ciplv", "ppc", "pli", "dwpli2")), ("d", ("dpli", "dwpli", "psi"))) for m in names),
    "e23_all_measures": f"WITH ws AS MATERIALIZED ({network.SQL['e15_e21_weight_statistics']}) " + " UNION ALL ".join([*(f"SELECT grp, subject, '{m}' AS measure, value FROM ({network.SQL[q]})" for m, q in _NESTED.items()), *(f"SELECT grp, subject, '{m}', {m} FROM ws" for m in _WEIGHTS)]),
    "g14_rank_lookup": A.sql("selection", "SELECT band, node, score, CAST(k AS INTEGER) AS place FROM (SELECT *, row_number() OVER (PARTITION BY band ORDER BY score DESC, node) AS k FROM (SELECT band, node, round(sum(strength), 6) AS score FROM selection GROUP BY ALL)) WHERE k = 3"),
    "g36_g43_group_points": A.sql("measure", "SELECT grp, subject, band, " + ", ".join(f"round(max(v) FILTER (WHERE measure = '{m}'), 6) AS {m}" for m in MEASURES) + ", NULL::VARCHAR AS reason FROM (SELECT m.*, (value - t) / CASE WHEN abs(t) < 1e-10 THEN 1 ELSE abs(t) END AS v FROM measure m JOIN (SELECT measure, avg(value) AS t FROM measure WHERE grp = 'Healthy' GROUP BY measure) USING (measure)) GROUP BY ALL"),
    "g39_probability_change": A.sql("oof", "SELECT band, subject, round(i, 6) AS initial, round(f, 6) AS final, round(i - f, 6) AS improvement FROM (SELECT band, subject, max(p) FILTER (WHERE repeat = 0) AS i, max(p) FILTER (WHERE repeat = 2) AS f FROM oof GROUP BY ALL)"),
    "g42_before_after": A.sql("selection", "SELECT band, unit, round(b, 4) AS before, round(a, 4) AS after, CASE WHEN b IS NULL THEN 'no second solution' WHEN k < 5 THEN 'short list' END AS reason FROM (SELECT band, unit, max(rev) FILTER (WHERE rnk = 2) AS b, max(rev) FILTER (WHERE rnk = 1) AS a, count(*) AS k FROM selection GROUP BY ALL)"),
    "g45_top_nodes": A.sql("selection", "SELECT band, node, kind, score, CAST(k AS INTEGER) AS place FROM (SELECT *, row_number() OVER (PARTITION BY band, kind ORDER BY score DESC, node) AS k FROM (SELECT band, node, 'count' AS kind, (count(*) FILTER (WHERE rnk = 1))::DOUBLE AS score FROM selection GROUP BY ALL UNION ALL SELECT band, node, 'weight', round(sum(strength), 6) FROM selection GROUP BY ALL)) WHERE k <= 5"),
    "h06_rank_weights": A.sql("selection", "SELECT unit, node, round(sum(strength), 6) AS w FROM selection GROUP BY ALL"),
    "h13_metric_tests": f"WITH t AS ({cohort.SQL['h11_h12_wilcoxon'].replace('round(least(1.0, ', '(least(1.0, ', 1).replace(', 6) AS p FROM', ') AS p FROM', 1)}), m AS ({A.sql('selection', 'SELECT band, quantile_cont(before, 0.5) AS m1, quantile_cont(after, 0.5) AS m2 FROM pair GROUP BY band', cohort._PAIR)}) SELECT band, round(m1, 4) AS m1, round(m2, 4) AS m2, rank_biserial, round(p, 6) AS p, round(least(max((k - rk + 1) * p) OVER (ORDER BY rk ROWS UNBOUNDED PRECEDING), 1.0), 6) AS p_adj FROM (SELECT *, row_number() OVER (ORDER BY p, band) AS rk, count(*) OVER () AS k FROM t) JOIN m USING (band)",
    "h16_rank_probabilities": A.sql("selection", " UNION ALL ".join(f"SELECT '{c}' AS name, round(avg(CASE WHEN {c} = greatest(urgent, high, low) THEN 1.0 / (CAST(urgent = greatest(urgent, high, low) AS INTEGER) + CAST(high = greatest(urgent, high, low) AS INTEGER) + CAST(low = greatest(urgent, high, low) AS INTEGER)) ELSE 0 END), 6)::DOUBLE AS p FROM medians" for c in ("urgent", "high", "low")), cohort._SEL1, cohort._WIDE, "rows_ AS (SELECT row_number() OVER (ORDER BY unit) - 1 AS i, round(urgent, 4) AS urgent, round(high, 4) AS high, round(low, 4) AS low FROM wide)", f"medians AS MATERIALIZED (SELECT b, quantile_cont(urgent, 0.5) AS urgent, quantile_cont(high, 0.5) AS high, quantile_cont(low, 0.5) AS low FROM (SELECT b, {T.duck_mixed('b', 'j')} % n AS i FROM (SELECT count(*) AS n FROM rows_), range(1, {RESAMPLES + 1}) q(b), LATERAL (SELECT unnest(range(1, n + 1)) AS j)) JOIN rows_ USING (i) GROUP BY b)"),
    "h21_fisher": A.sql("selection participant", "SELECT band, a, b, c, d, round(least((SELECT sum(CASE WHEN l <= l0 + 1e-7 THEN exp(l) ELSE 0 END) FROM (SELECT lgamma(a + b + 1.0) - lgamma(x + 1.0) - lgamma(a + b - x + 1.0) + lgamma(c + d + 1.0) - lgamma(a + c - x + 1.0) - lgamma(d - a + x + 1.0) - lgamma(a + b + c + d + 1.0) + lgamma(a + c + 1.0) + lgamma(b + d + 1.0) AS l, lgamma(a + b + 1.0) - lgamma(a + 1.0) - lgamma(b + 1.0) + lgamma(c + d + 1.0) - lgamma(c + 1.0) - lgamma(d + 1.0) - lgamma(a + b + c + d + 1.0) + lgamma(a + c + 1.0) + lgamma(b + d + 1.0) AS l0 FROM range(greatest(0, a - d), least(a + b, a + c) + 1) q(x))), 1.0), 6) AS p FROM cells", "cells AS (SELECT band, count(*) FILTER (WHERE grp = 'Healthy' AND gender = 0) AS a, count(*) FILTER (WHERE grp = 'Healthy' AND gender = 1) AS b, count(*) FILTER (WHERE grp = 'Patient' AND gender = 0) AS c, count(*) FILTER (WHERE grp = 'Patient' AND gender = 1) AS d FROM selection JOIN participant ON unit = subject WHERE rnk = 1 GROUP BY band)"),
    "h23_auc_difference": A.sql("oof", "SELECT band, round(quantile_cont(d, 0.025), 6) AS low, round(quantile_cont(d, 0.975), 6) AS high FROM (SELECT band, bb, (sum(rb) FILTER (WHERE y = 1) - sum(ra) FILTER (WHERE y = 1)) / nullif((sum(y) * (count(*) - sum(y)))::DOUBLE, 0) AS d FROM ranked_ GROUP BY ALL) GROUP BY band", "sc AS (SELECT band, subject, y_true AS y, max(p) FILTER (WHERE repeat = 0) AS a, max(p) FILTER (WHERE repeat = 1) AS b FROM oof GROUP BY ALL)", "rws AS (SELECT *, row_number() OVER (PARTITION BY band, y ORDER BY subject) - 1 AS i FROM sc)", f"drawn AS (SELECT band, y, bb, {T.duck_mixed('bb', 'j', 7)} % n AS i FROM (SELECT band, y, count(*) AS n FROM rws GROUP BY ALL), range(1, {RESAMPLES + 1}) q(bb), LATERAL (SELECT unnest(range(1, n + 1)) AS j))", "ranked_ AS (SELECT band, bb, y, rank() OVER (PARTITION BY band, bb ORDER BY a) + (count(*) OVER (PARTITION BY band, bb, a) - 1) / 2.0 AS ra, rank() OVER (PARTITION BY band, bb ORDER BY b) + (count(*) OVER (PARTITION BY band, bb, b) - 1) / 2.0 AS rb FROM drawn JOIN rws USING (band, y, i))"),
    "i05_repeated_folds": A.sql("feature", "SELECT subject, y, CAST(repeat AS INTEGER) AS repeat, CAST((row_number() OVER (PARTITION BY repeat, y ORDER BY (subject * 7919 + repeat * 104729) % 10007, subject) - 1) % 5 AS INTEGER) AS fold FROM feature, range(0, 3) q(repeat) WHERE ord = 0"),
    "i33_manifold_distance": A.sql("feature", "SELECT subject, ref AS nearest, d AS distance FROM (SELECT *, row_number() OVER (PARTITION BY subject ORDER BY d, ref) AS k FROM (SELECT a.subject, b.subject AS ref, round(sqrt(avg((a.z - b.z) ** 2)), 6) AS d FROM zs a JOIN zs b ON a.ord = b.ord AND a.subject <> b.subject WHERE a.subject % 100 = 0 AND b.y = 1 GROUP BY ALL)) WHERE k = 1", "zs AS MATERIALIZED (SELECT subject, y, ord, (value - m) / sd AS z FROM feature JOIN (SELECT ord, avg(value) AS m, stddev_samp(value) AS sd FROM feature WHERE y = 1 GROUP BY ord) USING (ord))"),
    "j08_renormalised_update": network._sql("SELECT grp, subject, cand, round(CASE WHEN hi > lo THEN (m - lo) / (hi - lo) ELSE 0 END, 6) AS mean, round(CASE WHEN hi > lo THEN s / (hi - lo) ELSE 0 END, 6) AS sd FROM (SELECT grp, subject, cand, min(new) AS lo, max(new) AS hi, avg(new) AS m, stddev_pop(new) AS s FROM (SELECT a.grp, a.subject, a.cand, n.w * a.clipped * b.clipped AS new FROM matrix n JOIN moved a ON a.grp = n.grp AND a.subject = n.subject AND a.to_ = n.src JOIN moved b ON b.grp = n.grp AND b.subject = n.subject AND b.to_ = n.dst AND a.cand = b.cand) GROUP BY grp, subject, cand)", *sweeps._GAIN),
    "j15_initial_metrics": network._sql("SELECT grp, subject, round(CASE WHEN cv IS NULL THEN NULL ELSE density END, 6) AS density, round(CASE WHEN cv IS NULL THEN NULL ELSE mean END, 6) AS mean, round(cv, 6) AS cv FROM (SELECT grp, subject, avg(CAST(w > 0 AS DOUBLE)) AS density, avg(w) AS mean, stddev_pop(w) / nullif(avg(w), 0) AS cv FROM weights GROUP BY ALL)", network._WEIGHTS),
    "l05_node_statistics": network.SQL["e26_node_summary"],
}
QUERIES = {k: v for k, v in list(globals().items()) if k[:1] in "abcdeghijl" and k[1:3].isdigit() and callable(v)}
