"""Projections and mixtures of vectors, on Spark ML."""

from __future__ import annotations

from math import log, pi

import numpy as np
from pyspark.ml.clustering import GaussianMixture
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def as_features(df: DataFrame, vector: str = "embedding") -> DataFrame:
    return df.withColumn("features", array_to_vector(F.col(vector).cast("array<double>")))


def projected(df: DataFrame, vector: str = "embedding", k: int = 2) -> DataFrame:
    """df with xy: the first principal components, for a map of the corpus."""
    d = as_features(df, vector)
    return PCA(k=k, inputCol="features", outputCol="pc").fit(d).transform(d).withColumn("xy", vector_to_array("pc")).drop("features", "pc")


def _single(d: DataFrame, n: int, dimensions: int) -> tuple[float, None] | None:
    """BIC of one Gaussian, in closed form; none for fewer than two rows."""
    if n < 2:
        return None
    x = [vector_to_array("features")[k] for k in range(dimensions)]
    row = d.agg(*[F.covar_pop(a, b) for a in x for b in x]).first()
    cov = np.array(row, float).reshape(dimensions, dimensions) + 1e-6 * np.eye(dimensions)
    loglik = -n / 2 * (dimensions * log(2 * pi) + np.linalg.slogdet(cov)[1] + np.trace(np.linalg.solve(cov, cov - 1e-6 * np.eye(dimensions))))
    parameters = dimensions + dimensions * (dimensions + 1) / 2
    return parameters * log(n) - 2 * loglik, None


def mixture(df: DataFrame, most: int = 6, vector: str = "embedding", dimensions: int = 4, least: float = 0.1, seed: int = 42) -> DataFrame:
    """df with cluster: the first component of a Gaussian mixture that holds a row with at least that probability. The number
    of components, 1 to `most` and below the number of rows, is the one of the least BIC, on principal components of the vectors."""
    d = as_features(projected(df, vector, dimensions).drop(vector).withColumnRenamed("xy", vector), vector)
    n = d.count()
    best = _single(d, n, dimensions)
    for k in range(2, min(most, n - 1) + 1):  # Spark fits two components at least
        model = GaussianMixture(k=k, seed=seed, featuresCol="features", probabilityCol="p", predictionCol="likeliest").fit(d)
        parameters = k * (dimensions + dimensions * (dimensions + 1) / 2) + k - 1
        bic = parameters * log(max(n, 1)) - 2 * model.summary.logLikelihood
        if best is None or bic < best[0]:
            best = (bic, model)
    if best is None or best[1] is None:
        return d.withColumn("cluster", F.lit(0)).drop("features")
    p = vector_to_array("p")
    out = best[1].transform(d).withColumn("p", p)
    first = F.get(F.filter(F.transform("p", lambda x, i: F.when(x > least, i)), lambda i: i.isNotNull()), F.lit(0))
    return out.withColumn("cluster", F.coalesce(first, F.col("likeliest"))).drop("features", "p", "likeliest")
