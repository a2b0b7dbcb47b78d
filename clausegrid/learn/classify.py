"""Classifiers for clauses and vectors, as pyspark.ml pipelines."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import (
    LinearSVC, LogisticRegression, MultilayerPerceptronClassifier, NaiveBayes, OneVsRest,
)
from pyspark.ml.feature import IDF, HashingTF, RegexTokenizer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clausegrid.operators.labels import confusion_matrix
from clausegrid.operators.sampling import train_test_split


def train_text_classifier(train: DataFrame, text: str, label: str, features: int = 1 << 16) -> PipelineModel:
    """Hashed tf-idf words and logistic regression. Rows without text or label are left out."""
    known = train.where(F.col(text).isNotNull() & F.col(label).isNotNull()).select(
        F.col(text).alias("text"), F.col(label).cast("double").alias("label")
    )
    stages = [
        RegexTokenizer(inputCol="text", outputCol="words", pattern=r"\s+"),
        HashingTF(inputCol="words", outputCol="tf", numFeatures=features),
        IDF(inputCol="tf", outputCol="features"),
        LogisticRegression(maxIter=30, regParam=0.01),
    ]
    return Pipeline(stages=stages).fit(known)


def classify_text(model: PipelineModel, df: DataFrame, text: str, out: str, names: dict[int, str] | None = None) -> DataFrame:
    """Rows with text, plus ``out`` (class or its name) and ``<out>_prob`` (probability of class 1)."""
    scored = model.transform(df.where(F.col(text).isNotNull()).withColumnRenamed(text, "text"))
    label = F.col("prediction").cast("int")
    if names:
        label = F.element_at(F.create_map(*[F.lit(x) for kv in names.items() for x in kv]), label)
    prob = vector_to_array("probability")[1]
    rows = scored.select("*", label.alias(out), prob.alias(f"{out}_prob"))
    return rows.drop("words", "tf", "features", "rawPrediction", "probability", "prediction").withColumnRenamed("text", text)


def evaluate_text_classifier(
    df: DataFrame, key: str, text: str, label: str, test: float = 0.25, seed: int = 1
) -> tuple[PipelineModel, DataFrame]:
    """Model from the training side, and the confusion matrix of the held-out side.

    The split comes first and depends on the id only, so no held-out row shapes the model.
    """
    split = train_test_split(df.where(F.col(label).isNotNull()), key, test, seed)
    model = train_text_classifier(split.where(~F.col("is_test")), text, label)
    scored = classify_text(model, split.where("is_test"), text, "yhat")
    return model, confusion_matrix(scored, label, "yhat")


def vector_classifiers(hidden: int = 100, dims: int = 64, classes: int = 10, seed: int = 7) -> dict:
    """One-vs-rest linear SVM, Gaussian naive Bayes and a dense net with one hidden layer."""
    return {
        "svm": OneVsRest(classifier=LinearSVC(maxIter=30, regParam=0.01), parallelism=4),
        "bayes": NaiveBayes(modelType="gaussian"),
        "net": MultilayerPerceptronClassifier(layers=[dims, hidden, classes], maxIter=60, seed=seed),
    }


def classify_vectors(
    df: DataFrame, key: str, vec: str, label: str, models: dict, test: float = 0.2, seed: int = 1
) -> DataFrame:
    """(key, label, one prediction column per model) for the held-out rows."""
    rows = df.select(key, F.col(label).cast("double").alias("label"), array_to_vector(F.col(vec).cast("array<double>")).alias("features"))
    split = train_test_split(rows, key, test, seed)
    train, held = split.where(~F.col("is_test")).drop("is_test"), split.where("is_test").drop("is_test")
    train.cache()
    out = held
    for name, estimator in models.items():
        fitted = estimator.fit(train)
        scored = fitted.transform(out)
        keep = [c for c in out.columns] + [F.col("prediction").cast("int").alias(name)]
        out = scored.select(*keep)
    train.unpersist()
    return out.select(key, F.col("label").cast("int").alias(label), *models)
