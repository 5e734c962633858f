"""Predicting a subject's age from aggregated features, with Spark ML."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.feature import (
    Imputer, StandardScaler, UnivariateFeatureSelector, VarianceThresholdSelector, VectorAssembler,
)
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

METRICS = ("mae", "rmse", "r2")
PARALLEL = 6  # fits at once: boosting runs hundreds of short jobs that leave cores idle between them


def encode(subjects: DataFrame) -> DataFrame:
    """Sex as 1 (male), 0 (female), 0.5 (unknown); age as the label."""
    first = F.upper(F.substring("sex", 1, 1))
    return subjects.withColumns({
        "sex_code": F.when(first == "M", 1.0).when(first == "F", 0.0).otherwise(0.5),
        "label": F.col("age").cast("double"),
    }).where(F.col("label").isNotNull())


def feature_stages(features: list[str], top_k: int | None) -> list:
    """Median imputation, low-variance removal, F-test selection, scaling."""
    filled = [f"{f}_filled" for f in features]
    stages = [
        Imputer(strategy="median", inputCols=features, outputCols=filled),
        VectorAssembler(inputCols=[*filled, "sex_code"], outputCol="raw"),
        VarianceThresholdSelector(varianceThreshold=1e-8, featuresCol="raw", outputCol="varied"),
    ]
    last = "varied"
    if top_k is not None:
        pick = UnivariateFeatureSelector(featuresCol="varied", outputCol="picked", labelCol="label", selectionMode="numTopFeatures")
        stages.append(pick.setFeatureType("continuous").setLabelType("continuous").setSelectionThreshold(top_k))
        last = "picked"
    return [*stages, StandardScaler(inputCol=last, outputCol="features", withMean=True)]


def regressors(seed: int = 42) -> dict:
    return {
        "ridge": LinearRegression(regParam=10.0, elasticNetParam=0.0),
        "elastic_net": LinearRegression(regParam=1.0, elasticNetParam=0.5),
        "random_forest": RandomForestRegressor(numTrees=50, maxDepth=5, seed=seed),
        "gradient_boosting": GBTRegressor(maxIter=50, maxDepth=3, seed=seed),
    }


def evaluate_models(
    subjects: DataFrame, features: list[str], top_k: int | None = None, folds: int | None = 5,
    models: tuple[str, ...] | None = None, seed: int = 42,
) -> tuple[DataFrame, dict]:
    """(scores, fitted pipelines): test MAE, RMSE and R2 on a held-out fifth and,
    with ``folds``, the cross-validated MAE.

    Parts and folds follow a hash of the ``subject`` column, so they are the
    same however the rows are partitioned.
    """
    spark = subjects.sparkSession
    part = F.pmod(F.xxhash64(F.col("subject"), F.lit(seed)), F.lit(5 * (folds or 1)))
    rows = encode(subjects).withColumn("part", part)
    train = rows.where("part % 5 > 0").withColumn("fold", F.floor(F.col("part") / 5).cast("int"))
    chosen = {n: m for n, m in regressors(seed).items() if models is None or n in models}
    parts = [(train.where(F.col("fold") != k), train.where(F.col("fold") == k), ("mae",)) for k in range(folds or 0)]
    parts.append((train, rows.where("part % 5 = 0"), METRICS))
    fit = inheritable_thread_target(spark)(lambda own, other, metrics: _fitted(own, other, features, top_k, chosen, metrics))
    with ThreadPoolExecutor(PARALLEL) as pool:
        *crossed, (stages, made) = pool.map(fit, *zip(*parts))
    scores = {n: [m for _, by_name in crossed for m in by_name[n][1]] for n in chosen}
    out = [(n, sum(scores[n]) / folds if folds else None, *metrics) for n, (_, metrics) in made.items()]
    fitted = {n: PipelineModel([*stages, model]) for n, (model, _) in made.items()}
    return spark.createDataFrame(out, "model string, cv_mae double, mae double, rmse double, r2 double"), fitted


def _fitted(
    train: DataFrame, test: DataFrame, features: list[str], top_k: int | None, models: dict, metrics: tuple[str, ...],
) -> tuple[list, dict]:
    """Fitted feature stages, and by name each model with its metrics on
    ``test``.  The stages are fitted once and their vectors kept for all models."""
    prepared = Pipeline(stages=feature_stages(features, top_k)).fit(train)
    own, other = (prepared.transform(df).select("label", "features").persist() for df in (train, test))
    made = {}
    for name, model in models.items():
        fitted = model.fit(own)
        guess = fitted.transform(other).persist()
        made[name] = fitted, [float(RegressionEvaluator(metricName=m).evaluate(guess)) for m in metrics]
        guess.unpersist()
    own.unpersist()
    other.unpersist()
    return prepared.stages, made


def importances(pipeline, features: list[str], top: int = 20) -> list[tuple[str, float]]:
    """The heaviest features of a fitted tree model."""
    names = [*features, "sex_code"]
    for stage in pipeline.stages:
        if hasattr(stage, "selectedFeatures"):
            names = [names[i] for i in stage.selectedFeatures]
    weights = pipeline.stages[-1].featureImportances.toArray()
    return sorted(zip(names, map(float, weights)), key=lambda p: (-p[1], p[0]))[:top]
