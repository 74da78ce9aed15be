"""Softmax head on frozen features, batch scoring and grouped cross-validation."""

from __future__ import annotations

from functools import reduce

from pyspark.ml.classification import (
    LogisticRegression,
    MultilayerPerceptronClassifier,
)
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from splitwarden.operators.folds import N_FOLDS, group_kfold
from splitwarden.operators.scale import materialise
from splitwarden.operators.splits import SEED


def _vectors(df: DataFrame) -> DataFrame:
    return df.withColumn(
        "features", array_to_vector(F.col("embedding").cast("array<double>"))
    ).withColumn("label", F.col("class_index").cast("double"))


def fit_head(
    df: DataFrame, inputs: int, classes: int, hidden: int | None = None, seed: int = SEED, rounds: int = 20
):
    """A dense head with softmax output; ``hidden`` units when given, else one layer."""
    if hidden:
        learner = MultilayerPerceptronClassifier(
            layers=[inputs, hidden, classes], maxIter=rounds, seed=seed
        )
    else:
        learner = LogisticRegression(family="multinomial", maxIter=rounds, regParam=0.01)
    return learner.fit(_vectors(df))


def score(df: DataFrame, model) -> DataFrame:
    """Add ``y_true`` and ``probs``."""
    scored = model.transform(_vectors(df))
    return scored.select(
        *df.columns,
        F.col("class_index").cast("int").alias("y_true"),
        vector_to_array("probability").alias("probs"),
    )


def cross_validate(
    df: DataFrame,
    inputs: int,
    classes: int,
    k: int = N_FOLDS,
    seed: int = SEED,
    hidden: int | None = None,
    rounds: int = 20,
) -> DataFrame:
    """Out-of-fold predictions: each fold is scored by a head fitted on the other folds."""
    folds = materialise(group_kfold(df, k, seed), "folds")
    parts = []
    for fold in range(1, k + 1):
        model = fit_head(
            folds.filter(F.col("fold") != fold), inputs, classes, hidden, seed + fold, rounds
        )
        parts.append(score(folds.filter(F.col("fold") == fold), model))
    return reduce(DataFrame.unionByName, parts).withColumns(
        {"seed": F.lit(seed), "fold_seed": F.lit(seed) + F.col("fold")}
    )
