"""Queries of searches over many models, of nested validation, and of the classifiers that Spark ML lacks."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.functions.stages import stage_table
from corvane.operators import discriminants as D
from corvane.operators import manyfits as X
from corvane.operators import models as M
from corvane.operators import rollups as R
from corvane.plans.network import r
from corvane.sources import adapters as A

WIDE, TRIPLETS, NEIGHBOURS, REPEATS = 64, 16, 15, 2


def rows(spark, sf, n: int = WIDE) -> DataFrame:
    """(subject, y, x): the first n numbers of every embedding; classes as in the feature table."""
    e = A.table(spark, sf, "embeddings").filter("label IS NOT NULL")
    return e.select(F.col("vec_id").alias("subject"), (F.col("label") < 5).cast("int").alias("y"), F.transform(F.slice("embedding", 1, n), lambda v: v.cast("double")).alias("x"))


def i06_i07_triplets(spark, sf):
    """All triplets of the first 16 columns by five-fold accuracy, all their models fitted together."""
    dealt = X.outer_folds(rows(spark, sf, TRIPLETS), 5, F.pmod(F.col("subject") * 7919, F.lit(10007)))
    return X.triplet_search(dealt, TRIPLETS).select("rank", "a", "b", "c", r("accuracy"), r("sd"), r("wa", 4), r("wb", 4), r("wc", 4))


def i17_nested_out_of_fold(spark, sf):
    """Scores of two repeats of nested validation: of each repeat, and of the subjects' means (repeat -1)."""
    p = stage_table(X.nested_folds(rows(spark, sf), WIDE, REPEATS), "nested")
    mean = p.groupBy("subject", "y").agg(F.avg("p").alias("p")).select("y", "p", F.lit(-1).alias("repeat"))
    m = R.probability_metrics(p.select("y", "p", "repeat").unionByName(mean), ["repeat"], "y", "p")
    return m.select("repeat", "n", F.lit(WIDE + 1).alias("parameters"), *[r(c, 3) for c in ("auc", "ap", "balanced_accuracy", "brier")])


def i44_age_residualised(spark, sf):
    """Out-of-fold probabilities after each training part's own linear age effect went from the columns."""
    age = A.participant(spark, sf).select("subject", "age")
    own = rows(spark, sf).join(age, "subject").withColumn("x", F.concat("x", F.array("age"))).drop("age")
    return X.nested_folds(own, WIDE, covariate=True).select("subject", "y", "fold", "c", r("p", 3))


def i22_knn(spark, sf):
    """Every hundredth row by its 15 nearest among all others, on z-scores."""
    own = rows(spark, sf)
    z = stage_table(D.z_scores(own, own, WIDE), "scaled")
    return D.knn(z.filter("subject % 100 = 0").select(F.col("subject").alias("ask"), "x"), z, NEIGHBOURS).select("ask", "n", r("p", 5))


def i22_shrunk_discriminant(spark, sf):
    """Probabilities of the odd subjects by a discriminant of the even ones, with the shares of the identity that the data ask for and with fixed ones."""
    own = stage_table(rows(spark, sf), "rows")
    train, test, out = own.filter("subject % 2 = 0"), own.filter("subject % 2 = 1"), None
    for name, share in (("auto", None), ("0.2", 0.2), ("0.8", 0.8)):
        w, b = D.discriminant(train, WIDE, share)
        one = test.select("subject", "y", F.lit(name).alias("shrinkage"), F.round(1 / (1 + F.exp(-D.linear_score("x", w, b))), 4).alias("p"))
        out = one if out is None else out.unionByName(one)
    return out


def i22_calibrated_svm(spark, sf):
    """Probabilities of the odd subjects: the mean of three linear machines, each calibrated on the third of the even subjects that it has not seen."""
    wide = stage_table(M.wide(A.feature(spark, sf).select("subject", "y", "ord", "value"), WIDE), "wide")
    train, test = wide.filter("subject % 2 = 0").withColumn("fold", F.pmod(F.floor(F.col("subject") / 2), F.lit(3)).cast("int")), wide.filter("subject % 2 = 1")
    n, held, asked = train.count(), None, None
    margin = vector_to_array("rawPrediction")[1].alias("f")
    for fold in range(3):
        model = Pipeline(stages=[*M.preprocessing(WIDE, 30), M.classifier("linear_svm", 1.0, n)]).fit(train.filter(F.col("fold") != fold))
        for_fit = model.transform(train.filter(F.col("fold") == fold)).select("fold", F.col("y").cast("int").alias("y"), margin)
        scored = model.transform(test).select("subject", "y", F.lit(fold).alias("fold"), margin)
        held, asked = (for_fit, scored) if held is None else (held.unionByName(for_fit), asked.unionByName(scored))
    fitted = D.platt(stage_table(held, "margins"), ["fold"])
    p = 1 / (1 + F.exp(-(F.col("a") * F.col("f") + F.col("b"))))
    return asked.join(F.broadcast(fitted), "fold").groupBy("subject", "y").agg(F.round(F.avg(p), 3).alias("p"))


SQL = {
    "i22_knn": f"""
        WITH long AS (SELECT vec_id AS subject, CAST(label < 5 AS INTEGER) AS y, i, embedding[i]::DOUBLE AS v FROM embeddings, unnest(range(1, {WIDE + 1})) u(i) WHERE label IS NOT NULL),
        m AS (SELECT i, avg(v) AS m, stddev_pop(v) AS s FROM long GROUP BY i),
        z AS MATERIALIZED (SELECT subject, y, list((v - m) / CASE WHEN s = 0 THEN 1 ELSE s END ORDER BY i) AS x FROM long JOIN m USING (i) GROUP BY subject, y),
        d AS (SELECT a.subject AS ask, b.subject AS ref, b.y, round(list_distance(a.x, b.x), 9) AS d FROM z a JOIN z b ON a.subject % 100 = 0 AND a.subject <> b.subject),
        t AS (SELECT *, min(d) OVER (PARTITION BY ask) AS low FROM d QUALIFY row_number() OVER (PARTITION BY ask ORDER BY d, ref) <= {NEIGHBOURS})
        SELECT ask, count(*) AS n, round(sum(w * y) / sum(w), 5) AS p FROM (SELECT ask, y, CASE WHEN low = 0 THEN CAST(d = 0 AS DOUBLE) ELSE 1 / d END AS w FROM t) GROUP BY ask""",
}
QUERIES = {k: v for k, v in list(globals().items()) if k[:1] == "i" and k[1:3].isdigit() and callable(v)}
