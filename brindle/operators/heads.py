"""Logistic heads with balanced classes, a grid over grouped folds, and sigmoid calibration."""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

GRID = (0.001, 0.01, 0.1)


def train(df: DataFrame, features: str, label: str, fold: str, grid: tuple = GRID, folds: int = 3) -> LogisticRegressionModel:
    """The regularisation that is best over the folds (whole groups each), classes weighted to the same sum."""
    d = df.select(array_to_vector(features).alias("x"), F.col(label).cast("double").alias("y"), F.col(fold).alias("fold"))
    n = {r.y: r.n for r in d.groupBy("y").agg(F.count("*").alias("n")).collect()}
    total = sum(n.values())
    weight = F.lit(1.0)
    for y, k in n.items():
        weight = F.when(F.col("y") == y, total / (len(n) * k)).otherwise(weight)
    lr = LogisticRegression(featuresCol="x", labelCol="y", weightCol="w", maxIter=50)
    cv = CrossValidator(
        estimator=lr, estimatorParamMaps=ParamGridBuilder().addGrid(lr.regParam, list(grid)).build(),
        evaluator=BinaryClassificationEvaluator(labelCol="y", weightCol="w"), numFolds=folds, foldCol="fold",
    )
    return cv.fit(d.withColumn("w", weight)).bestModel


def calibrate(df: DataFrame, score: str, label: str) -> tuple[float, float]:
    """(a, b) of 1 / (1 + exp(a s + b)), fitted on the decision values of a frozen model."""
    m = LogisticRegression(featuresCol="x", labelCol="y", maxIter=100).fit(df.select(array_to_vector(F.array(F.col(score).cast("double"))).alias("x"), F.col(label).cast("double").alias("y")))
    return -float(m.coefficients[0]), -float(m.intercept)


def evaluate(model: LogisticRegressionModel, df: DataFrame, features: str, label: str) -> DataFrame:
    """One row: rows, share right at 0.5, recall of the positive class."""
    p = model.transform(df.select(array_to_vector(features).alias("x"), F.col(label).cast("int").alias("y"))).select("y", vector_to_array("probability")[1].alias("p"))
    right = (F.col("p") >= 0.5).cast("int") == F.col("y")
    return p.agg(F.count("*").alias("n"), F.avg(right.cast("double")).alias("accuracy"), F.avg(F.when(F.col("y") == 1, right.cast("double"))).alias("recall"))
