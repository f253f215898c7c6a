"""Feature matrices, classifiers and validation on Spark ML.

Folds are a column, predictions a long table (subject, y, p, fold, repeat), so every score is an aggregate.
"""

from __future__ import annotations

from pyspark.ml import Estimator, Model, Pipeline
from pyspark.ml.classification import GBTClassifier, LinearSVC, LogisticRegression, NaiveBayes, RandomForestClassifier
from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import BinaryClassificationEvaluator, ClusteringEvaluator
from pyspark.ml.feature import PCA, Imputer, StandardScaler, UnivariateFeatureSelector, VarianceThresholdSelector, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.operators.rollups import folds


def wide(features: DataFrame, n: int, keys: tuple[str, ...] = ("subject", "y")) -> DataFrame:
    """(keys, x0..x<n-1>) from long rows (keys, ord, value); missing values are null."""
    return features.groupBy(*keys).pivot("ord", list(range(n))).agg(F.first("value")).toDF(*keys, *[f"x{i}" for i in range(n)])


def preprocessing(n: int, top: int | None = None, scale: bool = True) -> list:
    """Median imputation, zero-variance drop, scaling and the F-test's best `top` features, as pipeline stages ending in `features`."""
    cols = [f"x{i}" for i in range(n)]
    stages: list = [Imputer(strategy="median", inputCols=cols, outputCols=[f"i{c}" for c in cols]), VectorAssembler(inputCols=[f"i{c}" for c in cols], outputCol="v0"), VarianceThresholdSelector(featuresCol="v0", outputCol="v1", varianceThreshold=0.0)]
    last = "v1"
    if scale:
        stages.append(StandardScaler(inputCol=last, outputCol="v2", withMean=True))
        last = "v2"
    if top and top < n:
        stages.append(UnivariateFeatureSelector(featuresCol=last, labelCol="y", outputCol="features", selectionMode="numTopFeatures").setFeatureType("continuous").setLabelType("categorical").setSelectionThreshold(top))
    else:
        stages.append(VectorAssembler(inputCols=[last], outputCol="features"))
    return stages


def classifier(name: str, c: float = 1.0, n: int = 100, seed: int = 7):
    """A classifier by name; `c` is the inverse regularisation of the usual linear models, so regParam is 1 / (c * n)."""
    made = {
        "logistic": lambda: LogisticRegression(labelCol="y", regParam=1 / (c * n)),
        "elastic_net": lambda: LogisticRegression(labelCol="y", regParam=1 / (c * n), elasticNetParam=0.5),
        "linear_svm": lambda: LinearSVC(labelCol="y", regParam=1 / (c * n)),
        "gaussian_nb": lambda: NaiveBayes(labelCol="y", modelType="gaussian"),
        "random_forest": lambda: RandomForestClassifier(labelCol="y", numTrees=50, seed=seed),
        "gradient_boosting": lambda: GBTClassifier(labelCol="y", maxIter=20, seed=seed),
    }
    if name not in made:
        raise ValueError(f"no such model: {name}")
    return made[name]()


def probability(df: DataFrame) -> DataFrame:
    """df with p: probability of class 1, or the logistic of the margin where a model has none."""
    if "probability" in df.columns:
        return df.withColumn("p", vector_to_array("probability")[1])
    return df.withColumn("p", 1 / (1 + F.exp(-vector_to_array("rawPrediction")[1])))


def out_of_fold(data: DataFrame, n: int, name: str = "logistic", k: int = 5, top: int | None = None, c: float = 1.0, order=None) -> DataFrame:
    """(subject, y, fold, p): every subject scored once by a model that has not seen its fold."""
    dealt = folds(data, "y", F.xxhash64("subject") if order is None else order, k, ["subject"]).cache()
    size, out = dealt.count(), None
    for fold in range(k):
        model = Pipeline(stages=[*preprocessing(n, top), classifier(name, c, size)]).fit(dealt.filter(F.col("fold") != fold))
        one = probability(model.transform(dealt.filter(F.col("fold") == fold))).select("subject", "y", "fold", "p")
        out = one if out is None else out.unionByName(one)
    return out


def nested_out_of_fold(data: DataFrame, n: int, grid: tuple[float, ...] = (0.03, 0.3, 3.0), k: int = 5, inner: int = 3) -> DataFrame:
    """(subject, y, fold, c, p): regularisation chosen by AUC on inner folds of each training part."""
    dealt = folds(data, "y", F.xxhash64("subject"), k, ["subject"])
    size, out = data.count(), None
    for fold in range(k):
        lr = LogisticRegression(labelCol="y")
        params = ParamGridBuilder().addGrid(lr.regParam, [1 / (c * size) for c in grid]).build()
        train = folds(dealt.filter(F.col("fold") != fold), "y", F.xxhash64("subject", F.lit(fold)), inner, ["subject"]).withColumn("inner", F.col("fold").cast("int"))
        cv = CrossValidator(estimator=Pipeline(stages=[*preprocessing(n), lr]), estimatorParamMaps=params, evaluator=BinaryClassificationEvaluator(labelCol="y"), foldCol="inner", numFolds=inner)
        best = cv.fit(train).bestModel
        chosen = 1 / (best.stages[-1].getRegParam() * size)
        one = probability(best.transform(dealt.filter(F.col("fold") == fold))).select("subject", "y", "fold", F.lit(round(chosen, 9)).alias("c"), "p")
        out = one if out is None else out.unionByName(one)
    return out


def coefficients(model, names: list[str]) -> list[tuple[str, float]]:
    """(feature, coefficient) by size, largest first."""
    return sorted(zip(names, model.stages[-1].coefficients.toArray().tolist(), strict=True), key=lambda x: (-abs(x[1]), x[0]))


def projection(data: DataFrame, n: int, fit_on: str) -> DataFrame:
    """(subject, y, pc1, pc2): scaler and two components fitted on rows where `fit_on` holds, applied to all."""
    cols = [f"x{i}" for i in range(n)]
    stages = [VectorAssembler(inputCols=cols, outputCol="v"), StandardScaler(inputCol="v", outputCol="s", withMean=True), PCA(k=2, inputCol="s", outputCol="pc")]
    pc = vector_to_array("pc")
    return Pipeline(stages=stages).fit(data.filter(fit_on)).transform(data).select("subject", "y", pc[0].alias("pc1"), pc[1].alias("pc2"))


def select_kmeans(points: DataFrame, cols: list[str], most: int = 6, seed: int = 42) -> tuple[int, DataFrame]:
    """(k, points with cluster): k from 2 to `most` by silhouette, the smaller k on ties; fewer than three points are one cluster."""
    if points.count() < 3:
        return 1, points.withColumn("cluster", F.lit(0))
    data = VectorAssembler(inputCols=cols, outputCol="features").transform(points).cache()
    judge, best = ClusteringEvaluator(), None
    for k in range(2, most + 1):
        found = KMeans(k=k, seed=seed).fit(data).transform(data)
        if found.select("prediction").distinct().count() < 2:
            continue
        score = round(judge.evaluate(found), 9)
        if best is None or score > best[0]:
            best = (score, k, found)
    if best is None:
        return 1, points.withColumn("cluster", F.lit(0))
    return best[1], best[2].drop("features").withColumnRenamed("prediction", "cluster")


class ResidualizerModel(Model):
    """Takes a stored linear part in a covariate out of feature columns."""

    def __init__(self, covariate: str, fitted: list[tuple[str, float, float]]):
        super().__init__()
        self.covariate, self.fitted = covariate, fitted

    def _transform(self, df: DataFrame) -> DataFrame:
        return df.withColumns({c: F.col(c) - slope * (F.col(self.covariate) - mean) for c, slope, mean in self.fitted}).drop(self.covariate)


class Residualizer(Estimator):
    """Learns, on training rows, each column's slope in a covariate; constant covariates have slope 0."""

    def __init__(self, covariate: str, columns: list[str]):
        super().__init__()
        self.covariate, self.columns = covariate, columns

    def _fit(self, df: DataFrame) -> ResidualizerModel:
        row = df.agg(*[F.coalesce(F.regr_slope(c, self.covariate), F.lit(0.0)).alias(c) for c in self.columns], F.avg(self.covariate).alias("_mean")).first()
        return ResidualizerModel(self.covariate, [(c, row[c], row["_mean"] or 0.0) for c in self.columns])
